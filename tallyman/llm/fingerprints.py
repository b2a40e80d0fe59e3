"""Document fingerprints as invertible Bloom lookup sketches.

A text is cut into paragraph cells (its lines, wrapped at spaces to at most
``WIDTH`` characters) and every cell's 64-bit digest is added to a small table
of counters: three cells of the table for each digest, each holding a count, the
sum of digests and the sum of check values. Subtracting two tables cancels what
the texts share. Peeling then recovers the differing digests: a counter of ±1
whose check value fits holds exactly one digest, which is taken out everywhere,
and so on. When peeling gets stuck the comparison is made again with tables four
times as large, under another placement. Digests that would need tables of more than
``MOST_CELLS`` counters are split by a hash into ``SHARDS`` parts, each compared by
tables of its own, so memory stays in proportion to the text; should a table six times
as large as both texts' digests not peel (digests that collide), the two lists of
digests are compared directly.

A digest's low byte is the length of its cell, so that the recovered digests say
how many characters differ: likeness = 2 × shared / (characters of both), 1 for
two texts without any cell. The n-th occurrence of a cell in a text has a digest
of its own, so repeated lines count as often as they occur.

Consecutive documents come together by ranges of the id: quantiles cut the ids
into slices, each slice gets a copy of the first document after it, and one
sorted slice is one task's stream. Texts are shuffled once.

Defined results for edge cases
* null text: as empty; empty text: no cells, a table of zeros;
* null ``doc_id``: before all others; equal ids follow each other by their text;
* very long texts: compared whole, in shards; time and memory are linear in the digests;
* repeated rows: each row is a document, its next one may equal it (likeness 1);
* a single document: it is its own next document; an empty table: no rows;
* extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.llm.common import pick

WIDTH = 80
#: Counters of a fingerprint; a multiple of the three parts a digest is placed in.
CELLS = 24
GROWTH = 4
#: Counters of the largest table, and the parts that more digests are split into.
MOST_CELLS = 3 << 18
SHARDS = 16
_CELL = re.compile(rf"\S(?:[^\n]{{0,{WIDTH - 2}}}\S)?(?!\S)|\S[^\n]{{{WIDTH - 1}}}")
_LOWEST = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (murmur3's finaliser)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def digests(text: str) -> np.ndarray:
    """One unsigned 64-bit digest for each paragraph cell, its length in the low byte."""
    import xxhash

    cells = _CELL.findall(text)
    if not cells:
        return np.empty(0, np.uint64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(c.encode("utf-8", "replace")) for c in cells), np.uint64, len(cells))
    n = np.fromiter(map(len, cells), np.uint64, len(cells))
    values, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    if len(values) < len(h):  # number the occurrences of each cell
        order = np.argsort(inverse, kind="stable")
        first = np.cumsum(counts) - counts
        nth = np.empty(len(h), np.uint64)
        nth[order] = np.arange(len(h)) - np.repeat(first, counts)
        h = np.where(nth > 0, _mix(h + nth * np.uint64(0x9E3779B97F4A7C15)), h)
    return (h & ~np.uint64(255)) | n


_NEXT = np.uint64(0x9E3779B97F4A7C15)


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """Each key's cell in each third of the table, each by a scrambled value of all 64 bits."""
    third, out, h = cells // 3, [], keys + np.uint64(cells)
    for part in range(3):
        h = _mix(h + _NEXT)
        out.append((h % np.uint64(third)).astype(np.int64) + part * third)
    return np.concatenate(out)


def _check(keys: np.ndarray) -> np.ndarray:
    return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E6C63D0876A9A47)) >> np.uint64(32)


class Sketch:
    """The table: counts, digest sums and check sums (all modulo their width)."""

    def __init__(self, keys: np.ndarray, cells: int):
        self.count, self.key, self.check = np.zeros(cells, np.int64), np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
        if len(keys):
            self._add(keys, np.ones(len(keys), np.int64))

    def _add(self, keys: np.ndarray, signs: np.ndarray) -> None:
        at = _places(keys, len(self.count))
        unsigned = signs.view(np.uint64)  # -1 is 2^64 - 1, as the sums wrap
        for table, value in ((self.count, signs), (self.key, keys * unsigned), (self.check, _check(keys) * unsigned)):
            np.add.at(table, at, np.concatenate((value, value, value)))

    def minus(self, other: "Sketch") -> "Sketch":
        out = Sketch.__new__(Sketch)
        out.count, out.key, out.check = self.count - other.count, self.key - other.key, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Digests only on the left and only on the right, or None when peeling gets stuck."""
        keys_out, signs_out, left = [], [], len(self.count)
        while left:  # every round but the last takes out a digest; a stuck table ends it
            single = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[single]
            keys = self.key[single] * sign.view(np.uint64)
            fits = self.check[single] * sign.view(np.uint64) == _check(keys)
            found = dict(zip(keys[fits].tolist(), sign[fits].tolist()))  # a digest can be alone in two cells
            if not found:
                break
            keys, signs = np.fromiter(found, np.uint64, len(found)), np.fromiter(found.values(), np.int64, len(found))
            keys_out.append(keys), signs_out.append(signs)
            self._add(keys, -signs)
            left -= 1
        if self.count.any() or self.key.any() or self.check.any():
            return None
        if not keys_out:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        keys, signs = np.concatenate(keys_out), np.concatenate(signs_out)
        return keys[signs > 0], keys[signs < 0]

    def text(self) -> str:
        parts = (self.count.astype("<i4"), self.key.astype("<u8"), self.check.astype("<u4"))
        return base64.b64encode(b"".join(p.tobytes() for p in parts)).decode()


class Version:
    """A text's digests and its sketches of the sizes asked for so far."""

    def __init__(self, text: str = "", keys: np.ndarray | None = None):
        self.keys, self.sketches = digests(text) if keys is None else keys, {}
        self.weight = weight(self.keys)

    def sketch(self, cells: int) -> Sketch:
        if cells not in self.sketches:
            self.sketches[cells] = Sketch(self.keys, cells)
        return self.sketches[cells]

    def shards(self, depth: int) -> list["Version"]:
        at = _mix(_mix(self.keys) + np.uint64(depth)) % np.uint64(SHARDS)
        return [Version(keys=self.keys[at == np.uint64(i)]) for i in range(SHARDS)]


def without(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Digests of ``a`` beyond those ``b`` has, as often as they are more."""
    keys, counts = np.unique(np.concatenate((a, b)), return_inverse=True)
    more = np.bincount(counts[:len(a)], minlength=len(keys)) - np.bincount(counts[len(a):], minlength=len(keys))
    return np.repeat(keys, np.maximum(more, 0))


def differing(a: Version, b: Version, cells: int = CELLS, depth: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Digests only in ``a``, only in ``b``, and the size of the tables that gave them.
    A failure is tried again four times as large, or larger by a power of four where
    the squared counts (a digest adds about 1 to each of three) tell of more digests."""
    enough = 6 * (len(a.keys) + len(b.keys))
    while True:
        difference = a.sketch(cells).minus(b.sketch(cells))
        about = float((difference.count ** 2).sum()) / 3
        got = difference.peel()
        if got is not None:
            return *got, cells
        cells *= GROWTH
        while cells < about and cells < enough:
            cells *= GROWTH
        if cells > max(enough, GROWTH * CELLS):
            return without(a.keys, b.keys), without(b.keys, a.keys), cells
        if cells > MOST_CELLS:
            parts = [differing(x, y, CELLS, depth + 1) for x, y in zip(a.shards(depth), b.shards(depth))]
            left, right, sizes = zip(*parts)
            return np.concatenate(left), np.concatenate(right), sum(sizes)


def weight(keys: np.ndarray) -> int:
    return int((keys & np.uint64(255)).sum())


def likeness(a: Version, b: Version, cells: int = CELLS) -> tuple[float, int]:
    total = a.weight + b.weight
    only_a, only_b, cells = differing(a, b, cells)
    return (1.0 - (weight(only_a) + weight(only_b)) / total if total else 1.0), cells


def sliced_with_next(rows: DataFrame, slices: int) -> DataFrame:
    """``rows`` (doc_id, text) cut into slices by id, sorted in each, and each slice
    followed by a copy (``tail``) of the document after it; after the last, the first.

    Only the slices' borders reach the driver: one id for each slice."""
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id"), F.lit(_LOWEST)))
    shares = [i / slices for i in range(1, slices)]
    cuts = rows.agg(F.percentile_approx("key", shares, 100 * slices).alias("cuts")).first().cuts if shares else []
    cuts = sorted(set(cuts or []))

    @F.pandas_udf("long")
    def slice_of(key):  # a binary search among the cuts
        import pandas as pd

        return pd.Series(np.searchsorted(np.array(cuts, np.int64), key.to_numpy(np.int64), side="left"))

    firsts = sorted((r.slice, r.first_key) for r in rows.select(slice_of("key").alias("slice"), "key").groupBy("slice").agg(F.min("key").alias("first_key")).collect())
    if not firsts:
        firsts = [(0, _LOWEST)]
    # the first document of each slice is also the tail of the slice before it
    spark = rows.sparkSession
    tails = spark.createDataFrame([(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)], "key long, before long")
    placed = rows.withColumn("slice", slice_of("key")).join(F.broadcast(tails), "key", "left")
    here = F.struct(F.col("slice").alias("slice"), F.lit(False).alias("tail"))
    there = F.struct(F.col("before").alias("slice"), F.lit(True).alias("tail"))
    placed = placed.withColumn("at", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))))
    placed = placed.select("at.slice", "at.tail", "key", "doc_id", "text")
    return placed.repartitionById(slices, F.col("slice").cast("int")).sortWithinPartitions("slice", "tail", "key", "text")


def fingerprint_versions(docs: DataFrame, slices: int | None = None, cells: int = CELLS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: its fingerprint, that of its edited text (the last half
    replaced by as much of the next document's start), and the likenesses."""
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    slices = slices or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                            ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                            ("cells_edited", pa.int64()), ("cells_next", pa.int64())])
        held = None  # the document before; None after a tail, as another slice begins
        for b in batches:
            out = []
            for tail, doc, now in zip(*(b.column(c).to_pylist() for c in ("tail", "doc_id", "text"))):
                if held is None and tail:
                    continue  # a further row with the tail's id
                version = Version(now)
                if held is not None:
                    doc0, text0, version0 = held
                    n = len(text0)
                    edited = text0[:n - n // 2] + now[:n // 2]
                    changed = Version(edited)
                    near_edited, c1 = likeness(version0, changed, cells)
                    near_next, c2 = likeness(version0, version, cells)
                    out.append((doc0, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), version0.sketch(cells).text(),
                                changed.sketch(cells).text(), near_edited, near_next, c1, c2))
                held = None if tail else (doc, now, version)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, cells_edited long, cells_next long"
    return sliced_with_next(rows, slices).select("tail", "doc_id", "text").mapInArrow(run, kinds)
