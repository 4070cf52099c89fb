"""Many recordings in few text files: bucket files and a manifest of byte ranges.

A batch is written as one folder a bucket.  Rows are range-partitioned by (bucket, recording,
order), so a bucket is one file, or several whose names sort in order if it is huge.  The manifest
says where each recording's text begins in its bucket and how long it is, so anything that can
read a byte range can cut it out.  A batch becomes visible by its commit (``commits``); for each recording
the newest batch that has it counts, and all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuestrata.session import CLEANUP, stage, with_settings
from cuestrata.sources.commits import Commits

#: Bytes of a bucket in which one task looks for the recordings of lines.
PIECE = 1 << 20


class TextStore:
    """Texts of recordings named by ``keys`` below ``path``, in ``buckets`` files a batch, about."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str] = ("recording_id",), buckets: int = 64):
        self.keys, self.buckets, self.path = list(keys), buckets, path.rstrip("/")
        self.commits = Commits(spark, path)
        self.spark = spark

    def write(self, lines: DataFrame, order: str, value: str, token: str) -> bool:
        """Add the texts of a batch: ``value`` of (keys, ``order``), each followed by a line feed.

        False, and nothing written, if ``token`` is known.
        """
        if self.commits.known(token):
            return False
        folder = self.commits.folder()
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = lines.select(*self.keys, bucket.alias("bucket"), F.col(order).alias("__n"), F.col(value).alias("value"))
        ordered = rows.repartitionByRange("bucket", *self.keys, "__n").sortWithinPartitions("bucket", *self.keys, "__n")
        with with_settings(self.spark, {CLEANUP: "true"}):
            ordered.select("bucket", "value").write.partitionBy("bucket").text(f"{self.path}/{folder}/text")
        sizes = rows.groupBy("bucket", *self.keys).agg(F.sum(F.octet_length("value") + 1).cast("bigint").alias("bytes"))
        before = Window.partitionBy("bucket").orderBy(*self.keys).rowsBetween(Window.unboundedPreceding, -1)
        with with_settings(self.spark, {CLEANUP: "true"}):
            sizes.withColumn("start", F.coalesce(F.sum("bytes").over(before), F.lit(0))).write.parquet(f"{self.path}/{folder}/manifest")
        return self.commits.commit(token, folder)

    def _manifests(self) -> DataFrame | None:
        """(number, folder, keys, bucket, start, bytes) of all batches."""
        parts = [self.spark.read.parquet(f"{self.path}/{c.folder}/manifest").withColumns({"number": F.lit(c.number), "folder": F.lit(c.folder)}) for c in self.commits.live()]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def manifest(self) -> DataFrame | None:
        """Where each recording's newest text is: keys, folder, bucket, start, bytes; None before the first commit."""
        every = self._manifests()
        if every is None:
            return None
        at = F.max_by(F.struct("number", "folder", "bucket", "start", "bytes"), "number").alias("at")
        return every.groupBy(*self.keys).agg(at).select(*self.keys, "at.*")

    def read(self) -> DataFrame | None:
        """Lines (keys, ``at``, ``line``) of the newest text of each recording; ``at`` is the line's place in its bucket.

        A line's place is counted while its file is read, so lines are shuffled once, to meet the recordings of their piece of a bucket.
        """
        newest = self.manifest()
        if newest is None:
            return None
        parts = []
        for c in self.commits.live():
            text = self.spark.read.option("lineSep", "\n").text(f"{self.path}/{c.folder}/text")
            parts.append(text.select(
                F.lit(c.number).alias("number"), "bucket", F.col("_metadata.file_name").alias("__file"),
                F.col("_metadata.file_block_start").alias("__from"), F.col("value").alias("line")))
        lines, place = reduce(DataFrame.unionByName, parts), ["number", "bucket"]
        split = [*place, "__file", "__from"]
        sums = lines.groupBy(*split).agg(F.sum(F.octet_length("line") + 1).alias("__bytes"))
        before = Window.partitionBy(*place).orderBy("__file", "__from").rowsBetween(Window.unboundedPreceding, -1)
        # a row for each piece of a file that one task reads
        starts = stage(sums.select(*split, F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__start")), "starts")
        placed = lines.mapInArrow(_places, "number int, bucket int, __file string, __from bigint, line string, __in bigint").join(starts, split)
        placed = placed.select(*place, (F.col("__start") + F.col("__in")).alias("at"), F.lit(1).alias("__kind"), "line")
        placed = placed.withColumn("__piece", F.floor(F.col("at") / PIECE))
        live = newest.select("number", *self.keys, F.lit(True).alias("live"))
        heads = self._manifests().join(live, ["number", *self.keys], "left").withColumn("__piece", F.explode(F.sequence(
            F.floor(F.col("start") / PIECE), F.floor((F.col("start") + F.greatest(F.col("bytes"), F.lit(1)) - 1) / PIECE))))
        heads = heads.select(
            *place, "__piece", F.greatest("start", F.col("__piece") * PIECE).alias("at"), F.lit(0).alias("__kind"), F.struct(*self.keys, "live").alias("__of"))
        order = Window.partitionBy(*place, "__piece").orderBy("at", "__kind").rowsBetween(Window.unboundedPreceding, -1)
        owned = placed.unionByName(heads, allowMissingColumns=True).withColumn("__owner", F.last("__of", ignorenulls=True).over(order))
        return owned.where("__kind = 1 and __owner.live").select(*[F.col(f"__owner.{k}").alias(k) for k in self.keys], "at", "line")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``__in``: bytes before each line in its piece of a file, whose lines follow each other."""
    last, done = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {name: batch.column(name) for name in ("number", "bucket", "__file", "__from")}
        codes = [columns["__file"].dictionary_encode().indices if n == "__file" else c for n, c in columns.items()]
        codes = np.stack([np.asarray(c).astype(np.int64) for c in codes])
        sizes = np.asarray(pc.binary_length(batch.column("line"))).astype(np.int64) + 1
        before = np.cumsum(sizes) - sizes
        heads = np.flatnonzero(np.concatenate([[True], (codes[:, 1:] != codes[:, :-1]).any(axis=0)]))
        base = before[heads]
        here = tuple(c[0].as_py() for c in columns.values())
        if here == last:
            # goes on from the batch before
            base[0] -= done
        inside = before - np.repeat(base, np.diff([*heads, len(sizes)]))
        last, done = tuple(c[-1].as_py() for c in columns.values()), int(inside[-1] + sizes[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside, pa.int64())], names=[*batch.schema.names, "__in"])
