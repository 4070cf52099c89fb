"""Substring dedup over words by super-k-mers: the later copy of a passage is removed word by word."""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestrata.llm.common import lean, row_slices, text_buffer, word_spans
from cuestrata.llm.windows import Bucket, Unit, keyed_texts, power_grams, repeated_spans, span_mask, spans_of, with_spans

WORDS, MINIMISER = 50, 24


def solve_first(bucket: Bucket, unit: Unit) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Windows that start in a document with a smaller id.

    A member whose packed string stands in an earlier document loses all of its windows.  For
    the others, the windows of all distinct strings are sorted by hash, and equal hashes are
    told apart by their words, so counts are exact.
    """
    lo = np.full(len(bucket.packs), np.iinfo(np.int64).max)
    np.minimum.at(lo, bucket.string, bucket.ids)
    later = np.flatnonzero(bucket.ids > lo[bucket.string])
    yield later, np.zeros(len(later), np.int64), bucket.n[later], True

    strings = np.flatnonzero(bucket.shared)
    if not len(strings):
        return
    raw = b"".join(bucket.packs[s] for s in strings)
    off = np.cumsum([0, *(len(bucket.packs[s]) for s in strings)])
    buf = np.frombuffer(raw, np.uint8)
    values, first = unit.tokens(buf, off)
    starts, ends, _ = word_spans(buf, off)
    each = bucket.windows[strings]
    of = np.repeat(np.arange(len(strings)), each)
    place = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    token = first[of] + place
    hashes = power_grams(values, unit.length)[token]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    again = order[np.append(same, False) | np.append(False, same)]
    least: dict[bytes, int] = {}
    a, b = starts[token[again]].tolist(), ends[token[again] + unit.length - 1].tolist()
    own = lo[strings][of[again]].tolist()
    texts = [raw[x:y] for x, y in zip(a, b, strict=True)]
    for text, x in zip(texts, own, strict=True):
        if x < least.get(text, x + 1):
            least[text] = x
    gone = np.zeros(len(of), bool)
    gone[again] = [least[t] < x for t, x in zip(texts, own, strict=True)]
    begin, end = spans_of_rows(gone, each)
    member_of = bucket.ids == lo[bucket.string]
    yield *spread(bucket, member_of, strings[of[begin]], place[begin], place[end - 1] + 1), True


def spans_of_rows(mask: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true values that don't cross from one row to the next; ``each`` has the rows' sizes."""
    begin, end = spans_of(mask)
    cuts = np.unique(np.cumsum(each))
    inner = cuts[(cuts > 0) & (cuts < len(mask))]
    inner = inner[mask[inner - 1] & mask[inner]]
    return np.sort(np.append(begin, inner)), np.sort(np.append(end, inner))


def spread(bucket: Bucket, chosen: np.ndarray, string: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window ranges of strings, for each chosen member that has the string."""
    member = np.flatnonzero(chosen)
    member = member[np.argsort(bucket.string[member], kind="stable")]
    lo = np.searchsorted(bucket.string[member], string, "left")
    hi = np.searchsorted(bucket.string[member], string, "right")
    times = hi - lo
    span = np.repeat(np.arange(len(string)), times)
    nth = np.arange(len(span)) - np.repeat(np.cumsum(times) - times, times)
    return member[lo[span] + nth], a[span], b[span]


def removed_words(docs: DataFrame, words: int = WORDS, minimiser: int = MINIMISER) -> DataFrame:
    """doc_id, text, spans: word ranges that windows of ``words`` words from earlier documents cover.

    Null texts count as empty.  A null doc_id comes after all others.  Rows with one doc_id are
    one document as to what is earlier: repeated rows don't remove each other's words.  Extra
    columns are not looked at.
    """
    unit = Unit(True, words, minimiser)
    return with_spans(docs, repeated_spans(keyed_texts(docs), unit, True, solve_first))


def dedup_words(docs: DataFrame, words: int = WORDS, minimiser: int = MINIMISER) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for a, b in row_slices(off):
                part = buf[off[a] : off[b]]
                starts, ends, first = word_spans(part, off[a : b + 1] - off[a])
                gone = span_mask(batch.column(2).slice(a, b - a), first)
                raw = part.tobytes()
                left = np.flatnonzero(~gone)
                kept_words = [raw[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist(), strict=True)]
                cut = np.searchsorted(left, first).tolist()
                total = np.diff(first)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(total, pa.int64()), pa.array(total - np.diff(cut), pa.int64()),
                    pa.array([b" ".join(kept_words[x:y]).decode("utf-8", "replace") for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"])

    return removed_words(docs, words, minimiser).mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept string")


def dedup_words_digests(docs: DataFrame) -> DataFrame:
    return dedup_words(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))




