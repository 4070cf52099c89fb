"""Language ID by a string kernel with Nyström landmarks and one-versus-rest kernel ridge regression.

The kernel is a blended spectrum with presence features: the number of different character
n-grams (n = 1, 2, 3) that two texts share, divided by the geometric mean of their own
numbers.  Characters are whole code points of any script.  Landmarks are a bounded sample of
training texts, and n-grams are those that occur in a landmark, since others add nothing to a
product with one.  Landmarks times the regression's coefficients give one weight for each n-gram
and language, so texts are scored in batches as sums of the weights of their n-grams.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestrata.llm.bpe import LETTER, classes
from cuestrata.llm.common import by_row, lean, row_slices, text_buffer

#: Bounds of the sample: texts and landmarks for each language, and bytes of a text that may be in it.
SAMPLE, LANDMARKS, SAMPLE_BYTES = 400, 40, 1 << 16
RIDGE, SHARPNESS = 1e-3, 8.0
#: Rows scored at once, bytes of their presence matrix, code points of a long text taken at once.
ROWS, PRESENCE_BYTES, PIECE = 512, 1 << 25, 1 << 20
CODES = 0x110000
UNKNOWN = "und"


@dataclass
class Grams:
    """Columns of n-gram numbers: an open hash table of which an eighth is filled at most."""

    keys: np.ndarray
    columns: np.ndarray
    size: int

    @classmethod
    def build(cls, grams: np.ndarray) -> Grams:
        """Table of different n-gram numbers; the i-th has column i."""
        bits = max(10, (8 * len(grams)).bit_length())
        out = cls(np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32), len(grams))
        column, at = np.arange(len(grams), dtype=np.int32), out._slots(grams)
        while len(column):
            free = out.keys[at] < 0
            out.keys[at[free]] = grams[column[free]]  # of several, the last stays
            out.columns[at[free]] = column[free]
            left = out.columns[at] != column
            column, at = column[left], (at[left] + 1) & (len(out.keys) - 1)
        return out

    def _slots(self, grams: np.ndarray) -> np.ndarray:
        mixed = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Column of each n-gram, -1 where no landmark has it."""
        at = self._slots(grams)
        seen = self.keys[at]
        hit = seen == grams
        out = np.where(hit, self.columns[at], -1)
        open_ = np.flatnonzero(~hit & (seen >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.keys) - 1)
            seen = self.keys[at]
            hit = seen == grams[open_]
            out[open_[hit]] = self.columns[at[hit]]
            go = ~hit & (seen >= 0)
            open_, at = open_[go], at[go]
        return out


@dataclass
class Model:
    langs: list[str]
    grams: Grams
    weights: np.ndarray  # languages x n-grams

    def rows(self) -> int:
        """Rows that are scored at once."""
        return min(ROWS, max(1, PRESENCE_BYTES // max(1, self.grams.size)))

    def scores(self, presence: np.ndarray) -> np.ndarray:
        row, column = np.divmod(np.flatnonzero(presence), max(1, self.grams.size))
        norm = np.sqrt(np.maximum(np.bincount(row, minlength=len(presence)), 1.0))
        return np.stack([np.bincount(row, weights=w[column], minlength=len(presence)) / norm for w in self.weights], axis=1)


def gram_ids(codes: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, n-gram number) for n = 1, 2, 3; n-grams don't cross rows."""
    s = codes.astype(np.int64)
    yield row, s
    two = s[:-1] * CODES + s[1:]
    same = row[1:] == row[:-1]
    yield row[:-1][same], (CODES + two)[same]
    three = two[:-1] * CODES + s[2:]
    same = row[2:] == row[:-2]
    yield row[:-2][same], (CODES + CODES**2 + three)[same]


def add_presence(out: np.ndarray, codes: np.ndarray, row: np.ndarray, grams: Grams) -> None:
    for r, g in gram_ids(codes, row):
        column = grams.find(g)
        known = column >= 0
        out[r[known], column[known]] = True


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS) -> Model | None:
    """Model from (text, language) rows of the sample; the first ``landmarks`` of each language are its landmarks."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    codes = [code_points(t) for t, _ in rows]
    taken: Counter = Counter()
    chosen = []
    for i, (_, lang) in enumerate(rows):
        if taken[lang] < landmarks and len(codes[i]) > 2:
            taken[lang] += 1
            chosen.append(i)
    if not chosen:
        chosen = [0]
    different = lambda c: np.unique(np.concatenate([g for _, g in gram_ids(c, np.zeros(len(c), np.int32))]))
    held = [different(codes[i]) for i in chosen]
    own = np.sqrt(np.maximum([len(g) for g in held], 1.0))
    known, column = np.unique(np.concatenate(held), return_inverse=True)
    grams = Grams.build(known)
    # landmarks of each n-gram, one list after the other
    order = np.argsort(column, kind="stable")
    member = by_row(np.array([len(g) for g in held]))[order]
    count = np.bincount(column, minlength=len(known))
    first = np.cumsum(count) - count
    kernel = np.zeros((len(rows), len(chosen)))
    for i, c in enumerate(codes):
        mine = grams.find(different(c))
        mine = mine[mine >= 0]
        n = count[mine]
        at = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        kernel[i] = np.bincount(member[at], minlength=len(chosen)) / (np.sqrt(max(len(mine), 1)) * own)
    among = kernel[chosen]
    value, vector = np.linalg.eigh((among + among.T) / 2)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])  # Nyström map
    mapped = kernel @ root
    target = np.array([[1.0 if lang == x else -1.0 for x in langs] for _, lang in rows])
    of_lang = Counter(lang for _, lang in rows)
    balance = np.array([1 / of_lang[lang] for _, lang in rows]) * len(rows) / len(langs)
    weighted = mapped * balance[:, None]
    solved = np.linalg.solve(mapped.T @ weighted + RIDGE * len(rows) * np.eye(mapped.shape[1]), weighted.T @ target)
    share = (root @ solved) / own[:, None]
    weights = [np.bincount(column[order], weights=w[member], minlength=len(known)) for w in share.T]
    return Model(langs, grams, np.array(weights, np.float32))


def fold(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def sample(docs: DataFrame, per_lang: int = SAMPLE) -> list[tuple[str, str]]:
    """The ``per_lang`` different labelled texts of each language with the smallest hashes, or all it has: no more for a larger table."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    known = known.select("text", "lang", F.xxhash64("text", F.lit("sample")).alias("h"))
    # equal texts have one hash, so a large group of copies counts once and is folded before anything is fetched
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return []
    below = lambda limits: F.col("h") <= F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("lang")]
    # several times the hashes that are needed, by the share of the range in which they lie
    drawn = below({lang: min((1 << 63) - 1, (4 * per_lang << 64) // max(1, n) - (1 << 63)) for lang, n in counts.items()})
    hashes = defaultdict(list)
    for r in known.where(drawn).select("lang", "h").distinct().collect():
        hashes[r["lang"]].append(r["h"])
    picked = known.where(below({lang: sorted(h)[:per_lang][-1] for lang, h in hashes.items()})).select("text", "lang").distinct()
    return [(r.text, r.lang) for r in picked.orderBy(F.xxhash64("text", F.lit("order")), "text", "lang").collect()]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of each whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        rows = own.rows() if own else ROWS
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for a, b in row_slices(off):
                for lo in range(a, b, rows):
                    hi = min(lo + rows, b)
                    raw = buf[off[lo] : off[hi]].tobytes()
                    langs, scores = [UNKNOWN] * (hi - lo), np.zeros(hi - lo)
                    if own:
                        texts = [raw[x:y].decode("utf-8", "replace").lower() for x, y in zip((off[lo:hi] - off[lo]).tolist(), (off[lo + 1 : hi + 1] - off[lo]).tolist(), strict=True)]
                        x, letters = _features(own, texts)
                        margin = own.scores(x) * SHARPNESS
                        odds = np.exp(margin - margin.max(axis=1, keepdims=True))
                        odds /= odds.sum(axis=1, keepdims=True)
                        best = odds.argmax(axis=1)
                        langs = [own.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                        scores = np.where(letters, odds[np.arange(len(best)), best], 0.0).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def _features(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Presence matrix and whether each text has a letter."""
    out = np.zeros((len(texts), model.grams.size), bool)
    letters = np.zeros(len(texts), bool)
    if len(texts) == 1:  # may be very long: piece by piece
        for at in range(0, len(texts[0]), PIECE):
            codes = np.frombuffer(texts[0][at : at + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
            letters[0] |= bool((classes()[codes] == LETTER).any())
            add_presence(out, codes, np.zeros(len(codes), np.int32), model.grams)
        return out, letters
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = by_row(np.array([len(t) for t in texts]))
    letters[row[classes()[codes] == LETTER]] = True
    add_presence(out, codes, row, model.grams)
    return out, letters


def identify_languages(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the labelled rows that aren't held out.

    Null texts and texts without a letter are ``und`` with score 0, and so is all if nothing can be
    learned from.  A null doc_id counts as empty text in the fold.  Repeated rows each give a row;
    texts of any length are read whole; other columns are not looked at; an empty table gives no rows.
    """
    model = fit(sample(docs.where(fold(folds) != held)))
    return predict(docs, model).select("doc_id", (fold(folds) == held).alias("held_out"), "lang_pred", "score")
