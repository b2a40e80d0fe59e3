"""Packing documents into fixed windows: concatenate and cut.

All documents form one long stream of token ids, each followed by a separator
id, and the stream is cut every ``length`` ids. Nothing is sorted or shuffled:

1. one pass encodes every document and writes its ids with the number of the
   partition that read it and its start inside that partition's stream;
2. the partitions' totals (one row each) are summed up in two levels, which
   gives every partition its offset in the whole stream;
3. a second pass over the stored ids cuts each document at the window borders.
   A document that crosses borders gives one boundary record for each window it
   touches, so each id lies in exactly one piece.

Only the last window can be short; it is the only padding there is.

The stored pass fixes the order: a lost executor re-reads the written ids and
never a fresh numbering. The vocabulary's rank file gives the same ids as the
``tokenizers`` file of the same vocabulary (tests compare them), several times
faster; the special token's text is recognised as ``tokenizers`` does.

Defined results for edge cases
* null or empty text: the document is its separator alone (one piece of one id);
* null ``doc_id`` and repeated rows: each row is a document of its own;
* very long texts: as many boundary records as windows;
* an empty table: no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyman.llm.common import pick, stored

LENGTH = 1024
SEPARATOR = 0
SPECIAL = {"<|endoftext|>": 50256}
#: Partitions whose totals one task of the first prefix sum holds.
PARTS_A_BLOCK = 4096
#: Bytes of pieces a task hands on at a time.
BATCH_BYTES = 8 << 20


class Encoder:
    """Ids of a text by a rank file; ``special`` texts give their own ids."""

    def __init__(self, rank_file: str, pattern: str, special: dict[str, int]):
        import re

        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        return np.concatenate([np.array([self.special[p]], np.uint32) if p in self.special else self.plain(p) for p in self.cut.split(text)])


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, separator: int = SEPARATOR,
                     special: dict[str, int] | None = None) -> DataFrame:
    """``part, part_start, doc_id, n, ids`` (little-endian unsigned 32-bit) of each
    row, the separator included; ``part_start`` counts the ids before it in its partition."""
    special = SPECIAL if special is None else special

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = Encoder(rank_file, pattern, special), TaskContext.get().partitionId(), 0
        end = np.array([separator], "<u4").tobytes()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            ids, starts, ns, blobs = zip(*rows)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part] * len(rows), pa.int64()), "part_start": pa.array(starts, pa.int64()),
                "doc_id": pa.array(ids, pa.int64()), "n": pa.array(ns, pa.int64()), "ids": pa.array(blobs, pa.binary())})

        rows: list[tuple] = []
        held = 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                blob = encoder(text.as_py() or "").astype("<u4").tobytes() + end
                rows.append((doc_id, start, len(blob) // 4, blob))
                start, held = start + len(blob) // 4, held + len(blob)
                if held >= BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "part long, part_start long, doc_id long, n long, ids binary")


def partition_offsets(encoded: DataFrame) -> DataFrame:
    """``part, part_offset``: ids in all earlier partitions, by prefix sums over blocks
    of partitions and then inside each block. One row for each scan task."""
    block = F.floor(F.col("part") / PARTS_A_BLOCK)
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total")).withColumn("block", block)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy("block").agg(F.sum("total").alias("block_total"))
    blocks = blocks.select("block", F.coalesce(F.sum("block_total").over(before), F.lit(0)).alias("block_offset"))
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inner = totals.select("block", "part", F.coalesce(F.sum("total").over(inside), F.lit(0)).alias("inner_offset"))
    return inner.join(blocks, "block").select("part", (F.col("block_offset") + F.col("inner_offset")).alias("part_offset"))


def pack(docs: DataFrame, rank_file: str, pattern: str, length: int = LENGTH, separator: int = SEPARATOR,
         special: dict[str, int] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.
    ``start`` counts the document's ids before the piece, ``offset`` those of the
    window before it; ``ids`` are little-endian unsigned 32-bit integers."""
    encoded = stored(encode_documents(pick(docs, doc_id=doc_id, text=text), rank_file, pattern, separator, special), "packing-ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                 ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])

        for b in batches:
            for doc, at, n, ids in zip(b.column("doc_id").to_pylist(), b.column("at").to_pylist(), b.column("n").to_pylist(), b.column("ids")):
                blob, begin = ids.as_buffer(), 0
                while begin < n:
                    window, offset = divmod(at + begin, length)
                    take = min(length - offset, n - begin)
                    rows.append((doc, begin, take, blob[4 * begin:4 * (begin + take)].to_pybytes(), n, window, offset))
                    begin, held = begin + take, held + 4 * take + 64
                    if held >= BATCH_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    # one row of 16 bytes for each scan task of the first pass: the bound of this broadcast
    placed = encoded.join(F.broadcast(partition_offsets(encoded)), "part")
    placed = placed.select("doc_id", (F.col("part_offset") + F.col("part_start")).alias("at"), "n", "ids")
    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
