"""Exact top-k search by inner product with pivot-table elimination.

Vectors become integers (floor(256 × component)). For integer vectors q and x,
2<q, x> = |q|² + |x|² − d(q, x)², and the triangle inequality bounds the distance
from below by |d(q, p) − d(x, p)| for any pivot p. The largest of these over many
pivots bounds the score from above. The pivot table (each vector's distances to all
pivots) is computed once and stored beside the vectors, with a first threshold for each
query: its k-th best score among a bounded set of seed vectors.

Queries with the same nearest pivot form blocks of bounded size. A block is known by
the range of its distances to each pivot, its longest query and its least threshold; a
vector is only sent to the blocks it could have a place in. Inside a (query block ×
data block) cell candidates are evaluated in the order of their bound until the k-th
best score exceeds the next bound, so the result is exact. Each cell returns at most k
rows a query, and a ranked window merges them. What is broadcast is bounded: pivots and
seeds, and the ranges of ``BLOCKS_AT_ONCE`` query blocks; more blocks take further passes.

Defined results for edge cases
* vectors that are null, empty, or hold null or non-finite components take no
  part, nor do rows with a null id;
* a vector whose squared length (in integers) reaches 2^60 fails the job with an
  ``OverflowError``, as its scores could pass 64 bits;
* a query meets only vectors of its own dimension;
* rows that share an id are rows of their own: a query meets every row with another
  id, repeated rows as often as they occur; queries with the same id are ranked together;
* ties go to the smaller id;
* fewer candidates than k: all of them; an empty table: no rows;
* extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyman.llm.common import pick, stored

SCALE = 256
#: Bounds: pivots a dimension, vectors a dimension they and the first thresholds are chosen from.
PIVOTS = 32
SEEDS = 1024
#: Vectors of a data block and queries of a query block, about.
BLOCK = 4096
QUERY_BLOCK = 1024
#: Query blocks whose ranges are held at a time (2 × PIVOTS + 2 numbers each).
BLOCKS_AT_ONCE = 4096
#: Squared lengths from here on could lead to scores or distances beyond 64 bits.
LONGEST = 2.0 ** 60
#: Candidates evaluated before the first look at the stopping rule; four times as many before each next.
STEP = 64


def integer_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, dim, v``: the usable rows, ``v`` their components as little-endian 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("embedding").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.floor(b.column("embedding").flatten().to_numpy(zero_copy_only=False) * SCALE)
            if len(b) and not np.add.reduceat(flat * flat, np.cumsum(dims) - dims).max() < LONGEST:
                raise OverflowError("a vector is too long for scores of 64 bits")
            flat = flat.astype("<i8")
            offsets = np.concatenate([[0], np.cumsum(dims * 8)]).astype("<i4")
            v = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(dims), v], names=["vec_id", "dim", "v"])

    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).mapInArrow(run, "vec_id long, dim long, v binary")


def choose_pivots(seeds: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first among the seeds: each next pivot is the one farthest from all chosen."""
    far = ((seeds - seeds.mean(0)) ** 2).sum(1).astype(float)
    chosen = []
    for _ in range(min(n, len(seeds))):
        k = int(far.argmax())
        chosen.append(k)
        d = ((seeds - seeds[k]) ** 2).sum(1).astype(float)
        far = d if len(chosen) == 1 else np.minimum(far, d)
    return seeds[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(d2, 0).astype(float))


def best_of_block(q_ids: np.ndarray, q: np.ndarray, q_far: np.ndarray, floor: np.ndarray, x_ids: np.ndarray, x: np.ndarray,
                  x_far: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(row of q, row of x, score) of each query's k best in the block, as far as they
    reach its ``floor``, a score its k-th best is known to have."""
    out = []
    q_sq, x_sq = (q * q).sum(1), (x * x).sum(1)
    if len(q) and len(x) and float(q_sq.max()) * float(x_sq.max()) < 2.0 ** 104:  # every partial sum is an integer below 2^53
        q, x = q.astype(float), x.astype(float)
    far = np.ascontiguousarray(x_far.T)
    for i in range(len(q)):
        bound = upper_bounds(np.abs(far - q_far[i][:, None]).max(0), (q_sq[i] + x_sq).astype(float))
        left = np.flatnonzero((bound >= floor[i]) & (x_ids != q_ids[i]))
        left = left[np.argsort(-bound[left], kind="stable")]
        best, scores = np.empty(0, np.int64), np.empty(0, np.int64)  # the k first so far, best first
        at, step = 0, STEP
        while at < len(left) and not (len(best) == k and scores[-1] > bound[left[at]]):
            part = left[at:at + step]
            best, scores = np.concatenate([best, part]), np.concatenate([scores, (x[part] @ q[i]).astype(np.int64)])
            if len(best) > k:
                kept = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
                best, scores = best[kept], scores[kept]
            order = np.lexsort((best, x_ids[best], -scores))[:k]
            best, scores = best[order], scores[order]
            at, step = at + step, 4 * step  # few looks, and at most about four times what was needed
        out += zip([i] * len(best), best.tolist(), scores.tolist())
    return out


def upper_bounds(low: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Greatest score of two vectors at least ``low`` apart, whose squared lengths add up
    to ``total``, with room for rounding."""
    return (total - low * low) / 2 + 1e-9 * total + 1e-6


def _vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim)


def _table(column: pa.ChunkedArray | pa.Array, pivots: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, pivots)


def pivot_table(rows: DataFrame, dim: int, every: int, k: int, shared) -> DataFrame:
    """``vec_id, n, v`` with ``far`` (distances to the pivots, 64-bit floats), ``sq``,
    ``near`` (the nearest pivot) and, for queries, ``least``, the k-th best score among the seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s_ids, seeds, pivots = shared.value
        for b in batches:
            x, ids = _vectors(b.column("v"), dim), b.column("vec_id").to_numpy()
            far = distances(x, pivots)
            least = np.full(len(x), -math.inf)
            asked = np.flatnonzero(ids % every == 0)
            if len(seeds) >= k and len(asked):
                known = x[asked] @ seeds.T
                known = np.where(s_ids[None, :] == ids[asked, None], -(1 << 62), known)  # not its own
                least[asked] = np.partition(known, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id"), b.column("n"), b.column("v"), pa.array([f.tobytes() for f in far], pa.binary()),
                pa.array((x * x).sum(1)), pa.array(far.argmin(1).astype(np.int32)), pa.array(least)],
                names=["vec_id", "n", "v", "far", "sq", "near", "least"])

    return rows.select("vec_id", "n", "v").mapInArrow(run, "vec_id long, n long, v binary, far binary, sq long, near int, least double")


def block_ranges(asked: DataFrame, pivots: int) -> DataFrame:
    """For each query block: least and greatest distance to each pivot (``low``, ``high``),
    greatest squared length, least threshold. Combined in each task first."""
    kinds = "q_block int, low array<double>, high array<double>, sq long, least double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, far = b.column("q_block").to_numpy(), _table(b.column("far"), pivots)
            sq, least = b.column("sq").to_numpy(), b.column("least").to_numpy()
            groups = [(g, np.flatnonzero(block == g)) for g in np.unique(block)]
            yield pa.RecordBatch.from_arrays([
                pa.array([g for g, _ in groups], pa.int32()), pa.array([far[i].min(0).tolist() for _, i in groups], pa.list_(pa.float64())),
                pa.array([far[i].max(0).tolist() for _, i in groups], pa.list_(pa.float64())),
                pa.array([int(sq[i].max()) for _, i in groups], pa.int64()), pa.array([float(least[i].min()) for _, i in groups], pa.float64())],
                names=["q_block", "low", "high", "sq", "least"])

    parts = asked.select("q_block", "far", "sq", "least").mapInArrow(run, kinds)
    low = F.array(*[F.min(F.get("low", F.lit(i))) for i in range(pivots)])
    high = F.array(*[F.max(F.get("high", F.lit(i))) for i in range(pivots)])
    return parts.groupBy("q_block").agg(low.alias("low"), high.alias("high"), F.max("sq").alias("sq"), F.min("least").alias("least"))


def sent(points: DataFrame, ranges, pivots: int) -> DataFrame:
    """Each vector once for every query block that it could have a place in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, lows, highs, q_sq, least = ranges.value
        for b in batches:
            far, sq = _table(b.column("far"), pivots), b.column("sq").to_numpy().astype(float)
            for at in range(0, len(b), 256):
                f = far[at:at + 256]
                gap = np.zeros((len(f), len(blocks)))
                for p in range(pivots):
                    np.maximum(gap, lows[None, :, p] - f[:, p, None], out=gap)
                    np.maximum(gap, f[:, p, None] - highs[None, :, p], out=gap)
                row, col = np.nonzero(upper_bounds(gap, q_sq[None, :] + sq[at:at + 256, None]) >= least[None, :])
                part = b.slice(at, 256).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(blocks[col], pa.int32()), *[part.column(c) for c in ("x_block", "vec_id", "n", "v", "far")]],
                                                 names=["q_block", "x_block", "vec_id", "n", "v", "far"])

    return points.select("x_block", "vec_id", "n", "v", "far", "sq").mapInArrow(run, "q_block int, x_block int, vec_id long, n long, v binary, far binary")


def _cell(dim: int, k: int, pivots: int):
    """The task of one grid cell."""

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        got: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            (x_ids, x_n, q_ids, q_n) = (t.column(c).to_numpy() for t in (left, right) for c in ("vec_id", "n"))
            found = best_of_block(q_ids, _vectors(right.column("v"), dim), _table(right.column("far"), pivots), right.column("least").to_numpy(),
                                  x_ids, _vectors(left.column("v"), dim), _table(left.column("far"), pivots), k)
            got = [(int(q_ids[i]), int(x_ids[j]), s, min(k, int(q_n[i]) * int(x_n[j]))) for i, j, s in found]
        return pa.table({name: pa.array([r[c] for r in got], pa.int64()) for c, name in enumerate(("query_id", "vec_id", "score", "n"))})

    return cell


def top_k(rows: DataFrame, every: int, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int = PIVOTS, seeds: int = SEEDS,
          block: int = BLOCK, query_block: int = QUERY_BLOCK, blocks_at_once: int = BLOCKS_AT_ONCE) -> DataFrame:
    """For each row whose id is divisible by ``every``: ``query_id, rank, vec_id, score``."""
    vectors = integer_vectors(pick(rows, vec_id=vec_id, embedding=embedding)).groupBy("vec_id", "dim", "v").agg(F.count(F.lit(1)).alias("n"))
    data = stored(vectors, "topk-vectors")
    is_query = F.col("vec_id") % every == 0
    sizes = {r.dim: (r.n, r.queries) for r in data.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("queries")).collect()}
    spark = rows.sparkSession
    out_type = "query_id long, vec_id long, score long, n long"
    found = None
    for dim, (n, queries) in sorted(sizes.items()):
        if not queries:
            continue
        mine = data.where(F.col("dim") == dim)
        picked = mine.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id", "v").limit(seeds).collect()
        seed = np.stack([np.frombuffer(r.v, "<i8") for r in picked])
        pivot = choose_pivots(seed, pivots)
        shared = spark.sparkContext.broadcast((np.array([r.vec_id for r in picked], np.int64), seed, pivot))  # at most seeds + pivots vectors
        points = stored(pivot_table(mine, dim, every, k, shared), "topk-pivot-table")

        # query blocks: those nearest to one pivot, cut by a hash
        near = sorted((r.near, r.n) for r in points.where(is_query).groupBy("near").agg(F.count(F.lit(1)).alias("n")).collect())
        cuts = [math.ceil(m / query_block) for _, m in near]
        firsts = np.concatenate([[0], np.cumsum(cuts)]).tolist()
        spread = F.xxhash64("vec_id", "v")
        q_block = F.coalesce(*[F.when(F.col("near") == p, firsts[i] + F.pmod(spread, F.lit(cuts[i]))) for i, (p, _) in enumerate(near)]).cast("int")
        asked = points.where(is_query).withColumn("q_block", q_block)
        n_blocks = math.ceil(n / block)
        placed = points.withColumn("x_block", F.pmod(spread, F.lit(n_blocks)).cast("int"))
        for at in range(0, firsts[-1], blocks_at_once):
            some = asked.where(F.col("q_block").between(at, at + blocks_at_once - 1))
            got = sorted(block_ranges(some, len(pivot)).collect(), key=lambda r: r.q_block)  # at most blocks_at_once rows
            ranges = spark.sparkContext.broadcast((np.array([r.q_block for r in got]), np.array([r.low for r in got]), np.array([r.high for r in got]),
                                                   np.array([r.sq for r in got], float), np.array([r.least for r in got])))
            queries_there = some.select("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("x_block"), "vec_id", "n", "v", "far", "least")
            keys = ["q_block", "x_block"]
            part = sent(placed, ranges, len(pivot)).groupBy(*keys).cogroup(queries_there.groupBy(*keys)).applyInArrow(_cell(dim, k, len(pivot)), out_type)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], out_type)
    found = found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
