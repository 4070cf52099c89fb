"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Texts are cut into pre-tokens in whole slices with numpy.  Within a pre-token, the pairs that
may merge wait in one bucket per merge rank; a three-level bitmap finds the lowest occupied
rank by find-first-set, and entries whose pair has changed meanwhile are skipped.  A merge
costs constant time apart from its bucket, so a pre-token of a megabyte is no special case.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuestrata.llm.common import SLICE_BYTES, lean, row_slices, text_buffer

#: Pre-tokens up to this many bytes are remembered, in so many entries at most, by a Python worker.
REMEMBER_BYTES, REMEMBER = 64, 400_000
LETTER, NUMBER, OTHER, SPACE = range(4)
#: The code points of Unicode's White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


class RankQueue:
    """Buckets of positions by rank, with a bitmap of three levels over the occupied ranks."""

    def __init__(self):
        self.top, self.mid, self.leaf, self.buckets = 0, {}, {}, {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.fill(rank, [position])
        else:
            heappush(bucket, position)

    def fill(self, rank: int, positions: list[int]) -> None:
        """A new bucket; ``positions`` ascend, which makes them a heap."""
        self.buckets[rank] = positions
        a, b = rank >> 6, rank >> 12
        self.leaf[a] = self.leaf.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def lowest(self) -> int:
        """Find-first-set, level by level."""
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        bits = self.leaf[a]
        return a << 6 | (bits & -bits).bit_length() - 1

    def drop(self, rank: int) -> None:
        """Remove an empty bucket and clear its bits."""
        del self.buckets[rank]
        a, b = rank >> 6, rank >> 12
        self.leaf[a] &= ~(1 << (rank & 63))
        if not self.leaf[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)


def byte_pair_ranks(ranks: dict[bytes, int]) -> np.ndarray:
    """Rank of each pair of bytes, -1 where it is no token."""
    table = np.full(1 << 16, -1, np.int32)
    for token, rank in ranks.items():
        if len(token) == 2:
            table[token[0] << 8 | token[1]] = rank
    return table


def merge(pieces: list[bytes], ranks: dict[bytes, int], pairs: np.ndarray) -> list[tuple[int, ...]]:
    """Token ids of each pre-token: always the lowest-ranked pair first, the leftmost of equals.

    The pre-tokens stand end to end in one linked list and share one queue; as no pair
    crosses from one to the next, each gets the merges that it would get alone.
    """
    data = b"".join(pieces)
    n = len(data)
    cuts = np.cumsum([0, *map(len, pieces)])
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True
    raw = np.frombuffer(data, np.uint8).astype(np.int32)
    ranked = np.full(n, -1, np.int32)
    ranked[:-1] = pairs[raw[:-1] << 8 | raw[1:]]
    ranked[cuts[1:] - 1] = -1
    queue, there = RankQueue(), np.flatnonzero(ranked >= 0)
    there = there[np.argsort(ranked[there], kind="stable")]
    bucket_rank, bucket_at = np.unique(ranked[there], return_index=True)
    for rank, positions in zip(bucket_rank.tolist(), np.split(there, bucket_at[1:]), strict=True) if len(there) else ():
        queue.fill(rank, positions.tolist())

    current = ranked.tolist()  # rank of the pair that starts here
    end = list(range(1, n + 1))  # of the part that starts here; the next part starts there
    before = list(range(-1, n))
    edges, get, buckets = edge.tolist(), ranks.get, queue.buckets
    while queue.top:
        rank = queue.lowest()
        bucket, lower = buckets[rank], False
        while bucket and not lower:
            i = heappop(bucket)
            if current[i] != rank:
                continue  # stale
            j = end[i]
            end[i] = stop = end[j]
            current[i] = current[j] = -1
            if not edges[stop]:
                before[stop] = i
                r = get(data[i : end[stop]])
                if r is not None:
                    current[i] = r
                    queue.push(r, i)
                    lower = r < rank
            if not edges[i]:
                h = before[i]
                r = get(data[h:stop])
                if r is None:
                    current[h] = -1
                else:
                    current[h] = r
                    queue.push(r, h)
                    lower = lower or r < rank
        if not bucket:
            queue.drop(rank)
    out = []
    for i, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        ids = []
        while i < stop:
            ids.append(ranks[data[i : end[i]]])
            i = end[i]
        out.append(tuple(ids))
    return out


@lru_cache(1)
def classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            table[c] = LETTER
        elif major == "N":
            table[c] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def pretoken_spans(codes: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of texts that stand end to end.

    A run of letters, numbers or other characters is a pre-token, together with one plain
    space just before it.  An apostrophe on its own takes a contraction's letters from the run
    that follows.  Of white space before more text, the last character is left out; alone it
    is a pre-token unless the following run takes it.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[codes]
    first = np.zeros(n, bool)
    first[row_starts[row_starts < n]] = True
    first[0] = True
    head = first.copy()
    head[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(head)
    stop = np.append(start[1:], n)
    what = kind[start]
    follows = np.append(~first[start[1:]], False)  # the next run is of the same text
    space = what == SPACE
    plain_end = codes[stop - 1] == 0x20

    given = space & follows & plain_end  # its last character goes to the next run
    take = ~space & np.append(False, given[:-1])
    begin, finish = start - take, stop.copy()

    alone = (what == OTHER) & (stop - start == 1) & (codes[start] == 0x27) & ~take & follows
    at = np.flatnonzero(alone)
    at = at[what[at + 1] == LETTER]
    if len(at):
        c1 = codes[start[at + 1]]
        c2 = np.where(stop[at + 1] - start[at + 1] > 1, codes[np.minimum(start[at + 1] + 1, n - 1)], 0)
        is_in = lambda c, s: np.isin(c, np.array([ord(x) for x in s], codes.dtype))
        size = np.where(is_in(c1, "stmd"), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size = np.where((c1 == ord(a)) & (c2 == ord(b)), 2, size)
        finish[at] += size
        begin[at + 1] += size
    keep = ~space & (finish > begin)
    body_end = np.where(follows, stop - 1, stop)
    body = space & (body_end > start)
    last = space & follows & ~plain_end
    starts = np.concatenate([begin[keep], start[body], stop[last] - 1])
    ends = np.concatenate([finish[keep], body_end[body], stop[last]])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def safe_cuts(raw: bytes, limit: int = SLICE_BYTES) -> list[int]:
    """Where a long text can be cut without changing its pre-tokens: before a space between printable ASCII."""
    cuts, at = [0], limit
    while at < len(raw):
        at = raw.find(b" ", at)
        if at < 0 or at + 1 >= len(raw):
            break
        if 0x20 < raw[at - 1] < 0x7F and 0x20 < raw[at + 1] < 0x7F:
            cuts.append(at)
            at += limit
        else:
            at += 1
    return [*cuts, len(raw)]


class Encoder:
    """Encodes slices of texts; remembers short pre-tokens up to a bound."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs, self.known = ranks, byte_pair_ranks(ranks), {}

    def _all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each pre-token of a slice."""
        known, ranks = self.known, self.ranks
        new = {p for p in pieces if p not in known}
        if len(known) + len(new) > REMEMBER:
            known.clear()
            new = set(pieces)
        rest = []
        for p in new:
            rank = ranks.get(p)
            if rank is None:
                rest.append(p)
            else:
                known[p] = (rank,)
        if rest:
            known.update(zip(rest, merge(rest, ranks, self.pairs), strict=True))
        out = list(map(known.__getitem__, pieces))
        for p in rest:
            if len(p) > REMEMBER_BYTES:
                del known[p]
        return out

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
        """Ids of each row of a slice."""
        raw = buf.tobytes()
        codes = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
        place = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(width, out=place[1:])
        rows = np.searchsorted(place, offsets)
        starts, ends = pretoken_spans(codes, rows[:-1])
        found = self._all([raw[a:b] for a, b in zip(place[starts].tolist(), place[ends].tolist(), strict=True)])
        cuts = np.searchsorted(starts, rows).tolist()
        return [list(chain.from_iterable(found[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank file: base64 of a token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids for each whole text; the text column is replaced by it.

    Null and empty texts give no ids; every row gives one row; other columns stay, whatever
    their names, and a column already named like the new one is replaced.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    kept = [c for c in docs.columns if c not in (text, ids)]
    frame = docs.select(*kept, F.col(text).alias(ids))
    schema = T.StructType([*(frame.schema[c] for c in kept), T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            buf, off = text_buffer(batch.column(len(kept)))
            for a, b in row_slices(off):
                part = buf[off[a] : off[b]]
                if b - a == 1 and len(part) > 2 * SLICE_BYTES:
                    cuts = safe_cuts(part.tobytes())
                    rows = [[x for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) for x in encoder.encode(part[lo:hi], np.array([0, hi - lo]))[0]]]
                else:
                    rows = encoder.encode(part, off[a : b + 1] - off[a])
                ends = np.cumsum([0, *map(len, rows)])
                values = np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(kept))), column], names=[*kept, ids])

    return frame.mapInArrow(lean(run), schema)


def decode(frame: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``frame`` with the bytes of its token ids; null ids give no bytes.

    Every row gives one row, in whatever number of ids; other columns stay, and one already
    named like the new one is replaced.
    """
    tokens = frame.sparkSession.sparkContext.broadcast({rank: token for token, rank in load_ranks(path).items()})
    kept = [c for c in frame.columns if c != out]
    source = frame.select(*kept)
    place = kept.index(ids)
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = tokens.value.__getitem__
        for batch in batches:
            lists = batch.column(place)
            texts = [b"".join(map(token, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else b"" for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*kept, out])

    return source.mapInArrow(lean(run), schema)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = decode(encode(docs.select("doc_id", "text"), path), path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
