"""Toxicity by weak supervision.

1. Words and word beginnings that mark toxic texts are mined from a bounded sample of labelled
   rows; sorted by kind and half they are the lexicons of the voters.  Pattern voters look at
   the form of a text.
2. Every text of the corpus gets its votes; votes are counted by pattern of votes, a table
   whose size the number of voters bounds.
3. A generative label model explains that table by a hidden label, which the labelled rows show: by
   expectation maximisation it estimates how often each voter fires under either label, and, along the tree of the
   strongest conditional dependencies, how voters depend on each other.
4. A linear classifier is trained on the model's posterior labels of a bounded sample and scores
   every text by its features alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestrata.llm.common import by_row, forget, lean, lower_ascii, row_slices, span_hashes, stage, text_buffer
from cuestrata.llm.language import fold

#: Bounds: toxic rows that are mined, times as many others, bytes of a text in it, lexicon entries, rows for the classifier.
MINED, CLEAN_TIMES, MINED_BYTES, LEXICON, TRAINED = 4000, 3, 1 << 16, 3000, 40_000
#: An entry is this many times more frequent (log) in mined toxic texts, and its log likelihood ratio to
#: chance is at least so much, which leaves about one accidental entry among a million.
LOG_ODDS, EVIDENCE = 1.5, 14.0
#: What a labelled row counts in the label model, an unlabelled one being 1.
KNOWN = 4.0
BEGINNINGS = (4, 5, 6)
LEXICON_VOTERS = 2 * (1 + len(BEGINNINGS))
PATTERNS = ("dense", "shouting", "exclaiming", "short")
VOTERS = LEXICON_VOTERS + len(PATTERNS)

_WORD = np.zeros(256, bool)
_WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words: letters and non-ASCII characters."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = _WORD[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (~np.append(False, solid[:-1]) | edge[:-1]))
    ends = np.flatnonzero(solid & (~np.append(solid[1:], False) | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def features_of(word: bytes) -> list[tuple[int, bytes]]:
    """(kind, bytes): the word itself is kind 0, a proper beginning of n bytes has its place in BEGINNINGS."""
    return [(0, word), *((k + 1, word[:n]) for k, n in enumerate(BEGINNINGS) if len(word) > n)]


def mine(docs: DataFrame, known: DataFrame) -> list[tuple[int, bytes, float]]:
    """Lexicon (kind, bytes, log odds), strongest first, from the labelled rows given."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= MINED_BYTES))
    marked = keyed.select("doc_id", "hash").join(known, "doc_id")
    counts = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    part = F.pmod(F.xxhash64("hash", F.lit("mined")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("toxic") == 1, min(1.0, MINED / max(1, counts.get(1, 0)))).otherwise(min(1.0, CLEAN_TIMES * MINED / max(1, counts.get(0, 0))))
    # one row of each chosen text: as many as MINED and CLEAN_TIMES say, about, however large the table is
    picked = marked.where(part < rate).groupBy("hash", "toxic").agg(F.min("doc_id").alias("doc_id"))
    chosen = keyed.join(F.broadcast(picked), ["doc_id", "hash"]).select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column(0))
            toxic = batch.column(1).to_pylist()
            found: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for r in range(batch.num_rows):
                part = lower_ascii(buf[off[r] : off[r + 1]])
                starts, ends, _ = word_bounds(part, np.array([0, len(part)]))
                raw = part.tobytes()
                words = {raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)}
                found[int(toxic[r] == 1)].update({f for w in words for f in features_of(w)})
            keys = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays([
                pa.array([k for k, _ in keys], pa.int32()), pa.array([w for _, w in keys], pa.binary()),
                pa.array([found[1][x] for x in keys], pa.int64()), pa.array([found[0][x] for x in keys], pa.int64())], names=["kind", "entry", "toxic", "clean"])

    sums = chosen.mapInArrow(lean(run), "kind int, entry binary, toxic long, clean long").groupBy("kind", "entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sizes = picked.agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic"), F.count(F.when(F.col("toxic") == 0, 1)).alias("clean")).first()
    odds = F.log(((F.col("toxic") + 0.5) / (sizes.toxic + 1.0)) / ((F.col("clean") + 0.5) / (sizes.clean + 1.0)))
    share = (sizes.toxic + 0.5) / (sizes.toxic + sizes.clean + 1.0)
    every = F.col("toxic") + F.col("clean")
    surprise = lambda n, p: F.when(n > 0, n * F.log(n / (every * p))).otherwise(0.0)
    evidence = surprise(F.col("toxic"), share) + surprise(F.col("clean"), 1 - share)
    best = sums.withColumn("odds", odds).where((F.col("odds") >= LOG_ODDS) & (evidence >= EVIDENCE))
    return [(r.kind, bytes(r.entry), r.odds) for r in best.orderBy(F.desc("odds"), F.desc("toxic"), "kind", "entry").limit(LEXICON).collect()]


@dataclass
class Voters:
    """The lexicon as hash tables by kind, and the votes of whole texts."""

    tables: list[tuple[np.ndarray, np.ndarray]]  # by kind: sorted hashes, entry numbers
    half: np.ndarray  # of each entry
    size: int

    @staticmethod
    def build(lexicon: list[tuple[int, bytes, float]]) -> Voters:
        tables, half = [], np.zeros(len(lexicon), np.int64)
        for kind in range(1 + len(BEGINNINGS)):
            own = [i for i, (k, _, _) in enumerate(lexicon) if k == kind]
            raw = b"".join(lexicon[i][1] for i in own)
            ends = np.cumsum([0, *(len(lexicon[i][1]) for i in own)])
            hashes = span_hashes(np.frombuffer(raw, np.uint8), ends[:-1], ends[1:])
            half[own] = np.arange(len(own)) % 2
            order = np.argsort(hashes)
            tables.append((hashes[order], np.array(own, np.int64)[order]))
        return Voters(tables, half, len(lexicon))

    def look(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Votes of each row as bits, and the (row, entry) pairs found, without repeats."""
        rows = len(offsets) - 1
        upper = (buf >= 65) & (buf <= 90)
        low = lower_ascii(buf)
        starts, ends, row = word_bounds(low, offsets)
        found_row, found_entry = [], []
        votes = np.zeros(rows, np.int64)
        for kind, (hashes, entries) in enumerate(self.tables):
            if not len(hashes) or not len(starts):
                continue
            n = BEGINNINGS[kind - 1] if kind else 0
            some = np.flatnonzero(ends - starts > n)
            h = span_hashes(low, starts[some], starts[some] + n if n else ends[some])
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[at] == h
            r, e = row[some][hit], entries[at[hit]]
            found_row.append(r)
            found_entry.append(e)
            np.bitwise_or.at(votes, r, np.int64(1) << (2 * kind + self.half[e]))
        if found_row:
            pairs = np.unique(np.concatenate(found_row) * max(1, self.size) + np.concatenate(found_entry))
            pair_row, pair_entry = pairs // max(1, self.size), pairs % max(1, self.size)
        else:
            pair_row = pair_entry = np.zeros(0, np.int64)
        words = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
        of = by_row(np.diff(offsets))
        letters = np.bincount(of[_WORD[buf]], minlength=rows)
        capital = np.bincount(of[upper], minlength=rows)
        marks = np.bincount(of[buf == 33], minlength=rows)
        hits = np.bincount(pair_row, minlength=rows)
        shape = [hits * 50 >= np.maximum(words, 1), capital * 2 > np.maximum(letters, 1), marks >= 3, (words > 0) & (words < 20)]
        for k, fires in enumerate(shape):
            votes |= fires.astype(np.int64) << (LEXICON_VOTERS + k)
        return votes, pair_row, pair_entry


def voted(docs: DataFrame, voters: Voters) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, draw (0 to 1, from the text), votes, entries, for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            buf, off = text_buffer(batch.column(2))
            for a, b in row_slices(off):
                votes, row, entry = own.look(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(entry, pa.int32()))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(votes, pa.int32()), lists], names=["doc_id", "draw", "votes", "entries"])

    draw = F.pmod(F.xxhash64("text", F.lit("trained")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return docs.select(F.col("doc_id").cast("long"), draw.alias("draw"), "text").mapInArrow(lean(run), "doc_id long, draw double, votes int, entries array<int>")


class LabelModel:
    """Hidden label and votes: a tree of dependencies among voters under either label, by EM."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 30):
        """``counts`` has the rows of each pattern that are unlabelled, labelled 0 and labelled 1."""
        self.bits = (patterns[:, None] >> np.arange(VOTERS)) & 1
        scaled = counts * np.array([1.0, KNOWN, KNOWN])
        scaled = scaled / scaled.sum()
        fired = self.bits[:, :LEXICON_VOTERS].sum(axis=1)
        self.posterior = np.where(fired >= 2, 0.95, np.where(fired == 1, 0.7, 0.02))  # start: agreement of lexicons
        for _ in range(rounds):
            self._maximise(np.stack([scaled[:, 1] + scaled[:, 0] * (1 - self.posterior), scaled[:, 2] + scaled[:, 0] * self.posterior]))
            self.posterior = self._expect()

    def _maximise(self, mass: np.ndarray) -> None:
        self.prior = np.clip(mass.sum(axis=1), 1e-6, 1)
        n = 1e-4
        one = np.einsum("yp,pi->yi", mass, self.bits)
        both = np.einsum("yp,pi,pj->yij", mass, self.bits, self.bits)
        total = self.prior[:, None]
        self.rate = (one + n) / (total + 2 * n)  # how often each voter fires: its accuracy under either label
        joint = np.empty((2, 2, 2, VOTERS, VOTERS))
        joint[:, 1, 1], joint[:, 1, 0] = both, one[:, :, None] - both
        joint[:, 0, 1] = one[:, None, :] - both
        joint[:, 0, 0] = total[:, :, None] - joint[:, 1, 1] - joint[:, 1, 0] - joint[:, 0, 1]
        joint = np.maximum(joint, 0) + n / 4
        a, b = joint.sum(axis=2, keepdims=True), joint.sum(axis=1, keepdims=True)
        whole = joint.sum(axis=(1, 2), keepdims=True)
        self.dependence = (joint * np.log(joint * whole / (a * b))).sum(axis=(0, 1, 2))
        self.parent = self._tree(self.dependence)
        self.given = np.empty((2, 2, VOTERS))  # label, parent's vote: how often the voter fires
        for i, p in enumerate(self.parent):
            self.given[:, :, i] = self.rate[:, None, i] if p < 0 else joint[:, 1, :, i, p] / joint[:, :, :, i, p].sum(axis=1)

    @staticmethod
    def _tree(strength: np.ndarray) -> list[int]:
        """Parents in the spanning tree of the largest dependencies."""
        parent, best, source = [-1] * VOTERS, strength[0].copy(), np.zeros(VOTERS, int)
        left = set(range(1, VOTERS))
        while left:
            i = max(left, key=lambda k: (best[k], -k))
            parent[i] = int(source[i])
            left.remove(i)
            closer = strength[i] > best
            best[closer], source[closer] = strength[i][closer], i
        return parent

    def _expect(self) -> np.ndarray:
        score = np.tile(np.log(self.prior)[:, None], len(self.bits))
        for i, p in enumerate(self.parent):
            fires = self.given[:, self.bits[:, p] if p >= 0 else np.zeros(len(self.bits), int), i]
            score += np.log(np.clip(np.where(self.bits[:, i], fires, 1 - fires), 1e-9, 1))
        return 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))


@dataclass
class Linear:
    entry: np.ndarray
    form: np.ndarray
    bias: float

    def scores(self, votes: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        z = self.bias + np.bincount(row, weights=self.entry[entry], minlength=len(votes))
        for k in range(len(PATTERNS)):
            z = z + self.form[k] * (votes >> (LEXICON_VOTERS + k) & 1)
        return 1 / (1 + np.exp(-z))


def train(rows: list[tuple[int, list[int]]], target: np.ndarray, size: int, rounds: int = 300, decay: float = 1e-4) -> Linear:
    """Logistic regression on soft labels: lexicon entries found, and the form of the text; Adam steps over all rows."""
    row = by_row(np.array([len(e) for _, e in rows], np.int64))
    entry = np.array([x for _, e in rows for x in e], np.int64)
    form = np.array([[v >> (LEXICON_VOTERS + k) & 1 for k in range(len(PATTERNS))] for v, _ in rows], float).reshape(len(rows), len(PATTERNS))
    w = np.zeros(size + len(PATTERNS) + 1)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = form @ w[size:-1] + w[-1] + np.bincount(row, weights=w[entry], minlength=len(rows))
        d = (1 / (1 + np.exp(-z)) - target) / max(1, len(rows))
        g = np.concatenate([np.bincount(entry, weights=d[row], minlength=size)[:size], form.T @ d, [d.sum()]]) + decay * np.append(w[:-1], 0) / max(1, size)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    return Linear(w[:size], w[size:-1], float(w[-1]))


def score_votes(votes: DataFrame, linear: Linear) -> DataFrame:
    """doc_id, score, votes of a table that ``voted`` made."""
    shared = votes.sparkSession.sparkContext.broadcast(linear)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            votes, lists = batch.column(1).to_numpy(), batch.column(2)
            row = by_row(np.diff(lists.offsets.to_numpy()))
            scores = own.scores(votes, row, lists.flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), batch.column(1)], names=["doc_id", "score", "votes"])

    return votes.select("doc_id", "votes", "entries").mapInArrow(lean(run), "doc_id long, score double, votes int")


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic: one row per labelled document, toxic if any of its labels says so."""
    return labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> tuple[Voters, Linear, DataFrame]:
    """Voters, classifier, and the staged votes of all rows: texts are read once for them.

    Of the held-out rows, only the votes are counted, as those of unlabelled rows.
    """
    learned = fold(folds) != held
    known = known_labels(labels).where(learned)
    lexicon = mine(docs.where(learned), known)
    voters = Voters.build(lexicon)
    votes = stage(voted(docs, voters), "votes")
    counted = votes.select("doc_id", "votes").join(known, "doc_id", "left").groupBy("votes").agg(
        F.count(F.when(F.col("toxic").isNull(), 1)).alias("open"), F.count(F.when(F.col("toxic") == 0, 1)).alias("clean"), F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic"),
        F.count(F.when(learned, 1)).alias("learned"))
    table = counted.collect()  # at most 2 ** VOTERS rows
    if not table or not lexicon:
        return voters, Linear(np.zeros(len(lexicon)), np.zeros(len(PATTERNS)), -4.0), votes
    patterns = np.array([r.votes for r in table])
    model = LabelModel(patterns, np.array([[r.open, r.clean, r.toxic] for r in table], float))
    posterior = dict(zip(patterns.tolist(), model.posterior.tolist(), strict=True))
    count = max(1, sum(r.learned for r in table))
    # about TRAINED rows, however large the table is
    rows = votes.where(learned & (F.col("draw") < min(1.0, TRAINED / count))).groupBy("votes", "entries").count().collect()
    spread = [(r.votes, list(r.entries)) for r in rows for _ in range(min(r["count"], 4 * TRAINED))]
    return voters, train(spread, np.array([posterior.get(v, 0.0) for v, _ in spread]), len(lexicon)), votes


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, learned without labels of the held-out rows; their votes count as unlabelled.

    Null and empty texts are scored like any other text, by having no feature.  A document with
    several labels counts as toxic if one says so; null labels don't count.  A null doc_id
    counts as empty text in the fold.  Without labels, every score is low.  Repeated rows each give a row;
    texts of any length are scored whole; extra columns are not looked at.
    """
    _, linear, votes = fit(docs, labels, folds, held)
    return score_votes(votes, linear).select(
        "doc_id", (fold(folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored ``limit`` or more; all columns stay, whatever their names, no other row goes.

    Null and empty texts have no feature and stay; very long ones are scored whole.  Repeated
    rows are judged alike and stay or go together; an empty table stays empty.
    """
    voters, linear, votes = fit(docs, labels, folds, held)
    forget(votes)
    shared = docs.sparkSession.sparkContext.broadcast((voters, linear))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, linear = shared.value
        for batch in batches:
            buf, off = text_buffer(batch.column(place))
            for a, b in row_slices(off):
                votes, row, entry = voters.look(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                yield batch.slice(a, b - a).filter(pa.array(linear.scores(votes, row, entry) < limit))

    return docs.mapInArrow(lean(run), docs.schema)
