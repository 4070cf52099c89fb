"""Sharding over fixed virtual slots and a versioned slot-to-shard map.

Every text hashes into one of a fixed number of slots.  Bytes are summed per slot, and the map
gives each slot a shard; rebalancing edits the map and never the hash.  A slot that
outweighs its fair part is split into parts by a second hash of the text, so equal texts
stay together.  Only a text whose copies alone outweigh a shard's mean is split by rows: there are
fewer such texts than shards, and the map names them.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuestrata.llm.common import text_key, text_or_empty
from cuestrata.session import scratch

SLOTS = 4096
PARTS = 64
#: Bytes that a record costs besides its text.
OVERHEAD = 16
#: A slot heavier than this part of a shard's mean is split.
HEAVY = 0.125

Unit = tuple[int, int]


@dataclass(frozen=True)
class SlotMap:
    """Shard of each unit; a unit is (slot, part), part -1 being a slot that isn't split.

    Parts 0 to ``PARTS`` - 1 are by text.  ``hot`` numbers the texts that are split by rows, by
    digest; text k has the parts from ``PARTS * (k + 1)`` on.
    """

    version: int
    shards: int
    shard_of: dict[Unit, int]
    hot: dict[str, int] = field(default_factory=dict)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, s, p, x, None) for (s, p), x in sorted(self.shard_of.items())]
        rows += [(self.version, self.shards, None, k, None, digest) for digest, k in sorted(self.hot.items())]
        return spark.createDataFrame(rows, "version int, shards int, vslot int, part int, shard int, hot string")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write this version beside the earlier ones; an existing version is never overwritten."""
        self.frame(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{path}/version={version}").collect()
        return SlotMap(version, rows[0].shards, {(r.vslot, r.part): r.shard for r in rows if r.hot is None}, {r.hot: r.part for r in rows if r.hot is not None})

    def unit(self, slot: int, part: int) -> Unit:
        """The unit that rows of this slot and part belong to."""
        return (slot, -1) if part < PARTS and (slot, -1) in self.shard_of else (slot, part)


def record_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text plus a fixed overhead; a null text has no bytes."""
    return F.octet_length(text_or_empty(text)).cast("long") + F.lit(OVERHEAD)


def digest() -> Column:
    return F.md5(F.encode(text_or_empty(), "UTF-8"))


def place(docs: DataFrame, hot: dict[str, int] | None = None) -> DataFrame:
    """Add size, vslot and part; equal texts share both, but for the ``hot`` ones, whose rows spread over parts of their own."""
    part = F.pmod(F.xxhash64(text_or_empty(), F.lit("part")), F.lit(PARTS)).cast("int")
    if hot:
        row = F.pmod(F.xxhash64(F.col("doc_id"), text_key(), F.lit("row")), F.lit(PARTS)).cast("int")
        number = F.element_at(F.create_map(*(F.lit(x) for pair in sorted(hot.items()) for x in pair)), digest())  # fewer than shards
        part = F.coalesce((number + 1) * PARTS + row, part)
    return docs.withColumns({"size": record_size(), "vslot": F.pmod(F.xxhash64(text_or_empty()), F.lit(SLOTS)).cast("int"), "part": part})


def weights(placed: DataFrame) -> DataFrame:
    """Bytes and rows of each (slot, part): at most ``SLOTS * PARTS`` rows and ``PARTS`` a hot text, whatever the input."""
    return placed.groupBy("vslot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def collect_weights(placed: DataFrame) -> dict[Unit, tuple[int, int]]:
    """The table of ``weights`` on the driver: its size is bounded by the numbers of slots and parts."""
    return {(r.vslot, r.part): (r.bytes, r.rows) for r in weights(placed).collect()}


def hot_texts(docs: DataFrame, unit_bytes: dict[Unit, int], shards: int) -> dict[str, int]:
    """Texts whose rows outweigh a shard's mean, numbered; only units that do so themselves can hold one."""
    mean = sum(unit_bytes.values()) / shards
    heavy = sorted(u for u, b in unit_bytes.items() if b > mean)
    if not heavy:
        return {}
    here = F.lit(False)
    for s, p in heavy:  # fewer than shards
        here = here | ((F.col("vslot") == s) & (F.col("part") == p))
    sums = place(docs).where(here).groupBy(digest().alias("digest")).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > mean)
    return {r.digest: k for k, r in enumerate(sums.orderBy("digest").collect())}


def build_map(unit_bytes: dict[Unit, int], shards: int, hot: dict[str, int] | None = None) -> SlotMap:
    """First version: heaviest unit first, each to the shard that has the fewest bytes."""
    mean = sum(unit_bytes.values()) / shards
    slots: dict[int, int] = {s: 0 for s in range(SLOTS)}
    for (s, p), b in unit_bytes.items():
        if p < PARTS:
            slots[s] += b
    units = {(s, -1): b for s, b in slots.items() if b <= mean * HEAVY}
    units |= {(s, p): unit_bytes.get((s, p), 0) for s, b in slots.items() if b > mean * HEAVY for p in range(PARTS)}
    units |= {u: b for u, b in unit_bytes.items() if u[1] >= PARTS}
    return SlotMap(1, shards, _greedy(units, [0] * shards), dict(hot or {}))


def _greedy(units: dict[Unit, int], load: list[int]) -> dict[Unit, int]:
    heap, out = [(b, x) for x, b in enumerate(load)], {}
    heapq.heapify(heap)
    for unit, b in sorted(units.items(), key=lambda u: (-u[1], u[0])):
        least, x = heapq.heappop(heap)
        out[unit] = x
        heapq.heappush(heap, (least + b, x))
    return out


def rebalance(old: SlotMap, unit_bytes: dict[Unit, int], tolerance: float = 0.02, shards: int | None = None, hot: dict[str, int] | None = None) -> SlotMap:
    """Next version: single units move from the fullest to the emptiest shard while that helps.

    A slot that has become heavy is split into its parts first, which stay where they are unless they
    move.  ``shards`` is the new number of shards: units of shards that go are dealt to the emptiest ones.
    ``hot`` has texts to be split by rows besides those that are split already.  Only moved units change
    their shard, so only their rows have to be rewritten.
    """
    shards = shards or old.shards
    texts = dict(old.hot)
    for d in sorted(hot or {}):
        texts.setdefault(d, len(texts))
    mean = sum(unit_bytes.values()) / shards
    slots: dict[int, int] = {}
    for (s, p), b in unit_bytes.items():
        if p < PARTS:
            slots[s] = slots.get(s, 0) + b
    shard_of, weight = {}, {}
    for (s, p), x in old.shard_of.items():
        split = p < 0 and slots.get(s, 0) > mean * HEAVY
        for u in [(s, q) for q in range(PARTS)] if split else [(s, p)]:
            shard_of[u], weight[u] = x, slots.get(s, 0) if u[1] < 0 else unit_bytes.get(u, 0)
    for u, b in unit_bytes.items():
        if u[1] >= PARTS and u not in shard_of:  # rows of a text that has become hot
            shard_of[u], weight[u] = shard_of.get((u[0], -1), shard_of.get((u[0], 0), 0)), b
    homeless = {u: weight[u] for u, x in shard_of.items() if x >= shards}
    load, held = [0] * shards, [set() for _ in range(shards)]
    for u, x in shard_of.items():
        if u not in homeless:
            load[x] += weight[u]
            held[x].add(u)
    for u, x in _greedy(homeless, load).items():
        shard_of[u] = x
        load[x] += weight[u]
        held[x].add(u)
    while True:
        full, empty = max(range(shards), key=lambda x: (load[x], x)), min(range(shards), key=lambda x: (load[x], x))
        room = load[full] - load[empty]
        if room <= tolerance * mean:
            break
        fits = [u for u in held[full] if 0 < weight[u] < room]
        if not fits:
            break
        u = min(fits, key=lambda u: (abs(weight[u] - room / 2), u))
        shard_of[u] = empty
        load[full] -= weight[u]
        load[empty] += weight[u]
        held[full].remove(u)
        held[empty].add(u)
    return replace(old, version=old.version + 1, shards=shards, shard_of=shard_of, hot=texts)


def edited_map(docs: DataFrame, shards: int, path: str, version: int | None = None) -> tuple[SlotMap, dict[Unit, tuple[int, int]]]:
    """The next version of the map that ``path`` stores, for the sizes of ``docs``, and the (bytes, rows) of its units.

    Without a version, the first one is built and edited.  Every version is stored before it is used.
    """
    spark = docs.sparkSession
    sizes = lambda table: {u: b for u, (b, _) in table.items()}
    table = collect_weights(place(docs))
    hot = hot_texts(docs, sizes(table), shards)
    known = {} if version is None else SlotMap.load(spark, path, version).hot
    texts = dict(known)
    for d in sorted(hot):
        texts.setdefault(d, len(texts))
    if texts:
        table = collect_weights(place(docs, texts))
    if version is None:
        build_map(sizes(table), shards, texts).save(spark, path)
        version = 1
    rebalance(SlotMap.load(spark, path, version), sizes(table), shards=shards, hot=texts).save(spark, path)
    return SlotMap.load(spark, path, version + 1), table


def assign_shards(docs: DataFrame, shards: int, slot_map: SlotMap | None = None) -> DataFrame:
    """Add shard, slot (place in the shard, gapless from 0), law, grown_shard, size, text_crc32, vslot.

    The law is ``bytes``: sizes of shards are near equal.  Without a map, one is built, stored below the
    shared folder, loaded and edited (``edited_map``).  Equal texts have one shard unless they outweigh a
    shard's mean.  Null texts count as empty, a null doc_id is a value like any other, rows of one
    unit with equal doc_id are numbered by their text and, if that is equal too, in any order; an empty table
    gives no rows.  Columns of these names in the input are replaced; all others are dropped but
    doc_id, since no wide column should travel for the slot numbers.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    table = None
    if slot_map is None:
        slot_map, table = edited_map(docs, shards, scratch(spark, "slot_map"))
    placed = place(docs, slot_map.hot)
    table = table or collect_weights(placed)
    seen, first = [0] * slot_map.shards, []
    for (s, p), (_, rows) in sorted(table.items()):
        x = slot_map.shard_of[slot_map.unit(s, p)]
        first.append((s, p, x, seen[x]))
        seen[x] += rows
    where = spark.createDataFrame(first, "vslot int, part int, shard int, first long")
    numbered = placed.select(
        "doc_id", "size", F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"), "vslot", "part", text_key().alias("th")
    ).withColumn("nth", F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "th")))
    return numbered.join(F.broadcast(where), ["vslot", "part"]).select(  # SLOTS * PARTS rows and PARTS a hot text at most
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )
