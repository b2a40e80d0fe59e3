"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyman.session import checkpoint_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, batch_bytes: int) -> SparkSession:
    """A session with the settings of ``spark`` whose Arrow passes get batches of about
    ``batch_bytes`` at most; ``spark`` keeps its own setting."""
    session = spark.newSession()
    has = session.conf.getAll
    for key, value in spark.conf.getAll.items():  # those set since the start, but for what only the start can set
        if has.get(key) != value and (session.conf.isModifiable(key) or not key.startswith("spark.") or key.startswith("spark.hadoop.")):
            session.conf.set(key, value)
    held = _bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(min(held, batch_bytes) if held > 0 else batch_bytes))
    return session


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names, so that
    further columns of the input can never clash with the operator's."""
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in columns.items()])


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, in the folder all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: later
    uses neither recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty), joined, and where each text begins and
    the last one ends."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def held_out(doc_id: Column) -> Column:
    """True for documents no model may learn from: crc32 of the id's text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def held_out_id(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def _bytes(setting: str) -> int:
    units = {"b": 0, "k": 10, "m": 20, "g": 30, "t": 40}
    s = setting.strip().lower().removesuffix("b") or "0"
    return int(float(s[:-1]) * (1 << units[s[-1]])) if s[-1] in units else int(s)


def merged_splits(df: DataFrame, least_bytes: int) -> DataFrame:
    """A scan whose tasks read at least about ``least_bytes`` each, where the session cuts
    files smaller: neighbouring splits go to one task, without a shuffle, as long as
    every core keeps a task."""
    spark = df.sparkSession
    split = max(1, _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    now, cores = df.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    n = max(cores, -(-now * split // least_bytes))
    return df.coalesce(n) if n < now else df


#: Rows of a few numbers each that may be broadcast, after they have been counted.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when it is counted to be small; beyond that a join
    shuffles both sides. For stored tables: counting reads no more than their footers."""
    return F.broadcast(df) if df.count() <= rows else df
