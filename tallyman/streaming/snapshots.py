"""Keyed tables kept between micro-batches.

A stream's state is a table with one row a key, cut into buckets by a hash of some key
columns. A micro-batch rewrites the buckets it touches, under its own version, and then
a manifest that says which version holds each bucket: a row a bucket, whatever the
table's size. So reading costs the table, not the number of batches before; a batch
reads and writes only the buckets it touches; and a batch that is repeated starts from
the manifest before it and gives the same files. A version becomes visible with its
manifest. Buckets that neither the last nor the one before uses are removed.

``stream_folder`` gives each checkpoint a folder of its own, named by the time and an id
that are drawn when the checkpoint is first used: a stream that starts again with an
empty checkpoint starts its batch numbers anew, and must not meet the old ones.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that uses this checkpoint folder; later ones sort higher."""
    path = f"{checkpoint.rstrip('/')}/stream-id"
    drawn = f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:12]}"
    spark.createDataFrame([(drawn,)], "id string").coalesce(1).write.mode("ignore").parquet(path)
    return spark.read.schema("id string").parquet(path).first()["id"]


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def _remove(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


class KeyedSnapshot:
    """A keyed table under ``root``; ``bucket_by`` are the key columns that deal rows to buckets."""

    def __init__(self, spark: SparkSession, root: str, schema: str, bucket_by: Sequence[str], buckets: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema: StructType = spark.createDataFrame([], schema).schema
        self.bucket_by, self.buckets = list(bucket_by), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c) for c in self.bucket_by]), F.lit(self.buckets)).cast("int")

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifest/version={version:012d}"

    def _manifest(self, version: int) -> dict[int, int]:
        """Which version holds each bucket after this one (none before the first)."""
        if version < 0:
            return {}
        rows = self.spark.read.schema("bucket int, held bigint").parquet(self._manifest_path(version))
        return {r["bucket"]: r["held"] for r in rows.collect()}  # a row a bucket

    def _rows(self, held: dict[int, int]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/version={v:012d}/bucket={b}" for b, v in sorted(held.items())])

    def current(self) -> DataFrame:
        """The table after the last version; the last two manifests are all there are."""
        kept = self.spark.read.schema("bucket int, held bigint, version bigint").parquet(f"{self.root}/manifest")
        last = kept.agg(F.max("version")).first()[0]
        return self._rows(self._manifest(last))

    def update(self, version: int, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Version ``version``: ``change`` gives, from the rows of the buckets that ``keys``
        touch, all rows that these buckets hold from now on."""
        before = self._manifest(version - 1)
        touched = [r[0] for r in keys.select(self.bucket().alias("bucket")).distinct().collect()]  # at most the buckets
        rows = change(self._rows({b: before[b] for b in touched if b in before}))
        named = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).withColumn("bucket", self.bucket())
        named.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/version={version:012d}")
        filled = set(r[0] for r in self.spark.read.parquet(f"{self.root}/data/version={version:012d}").select("bucket").distinct().collect()) if touched else set()
        after = {**{b: v for b, v in before.items() if b not in touched}, **{b: version for b in filled}}
        self.spark.createDataFrame(sorted(after.items()), "bucket int, held bigint").coalesce(1).write.mode("overwrite").parquet(self._manifest_path(version))
        # a repeat of this version needs the one before; nothing needs older ones (a manifest goes last)
        if version >= 2 and _exists(self.spark, self._manifest_path(version - 2)):
            for b, v in self._manifest(version - 2).items():
                if before.get(b) != v:
                    _remove(self.spark, f"{self.root}/data/version={v:012d}/bucket={b}")
            _remove(self.spark, self._manifest_path(version - 2))

    def add(self, version: int, deltas: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> None:
        """Version ``version``: the sums of each key grow by those of ``deltas``, which are
        computed once: the buckets they touch and the new sums read them."""
        held = deltas.persist()
        try:
            def grown(rows: DataFrame) -> DataFrame:
                return rows.unionByName(held.select(*rows.columns)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])

            self.update(version, held, grown)
        finally:
            held.unpersist()
