"""Ranked lexical search: the k best documents of every item, by dual-tree search.

The score of a document for an item is the sum, over the item's terms with repeats, of
``weight * coordinate``: a term's weight falls with the number of documents that hold it,
a document's coordinate for a term rises with the term's occurrences and falls with the
document's length (see ``weight`` and ``coordinates``; all integer arithmetic).

1. One Arrow pass over the documents counts terms; of each document only its length and
   its occurrences of the items' terms are written (``vectors``).
2. N, L and df are aggregates of that table; df of the items' terms only.
3. Items form a hierarchy, built once for a block of items and shared with all tasks: each
   node holds the largest weights of its items, coordinate by coordinate, and the weakest
   of its items' kth scores. The documents of a batch form another one, whose nodes hold the
   largest coordinates of their documents. The product of two nodes' maxima bounds every
   score between them, so a pair of nodes whose bound is below the weakest kth score, or
   zero, is dropped with all items and documents below. Surviving pairs descend in both
   hierarchies to exact integer scores.
4. The search runs twice: over a share of the documents (by hash, ``FIRST``) without known
   kth scores, then over all others with the kth scores of the first as a start, which are
   lower bounds of the final ones whatever documents came first. Each task passes on at
   most k rows an item, the second run in all about k / FIRST rows an item, whatever the
   number of documents. The result doesn't depend on order, batches or the share.

Items go in blocks of at most ``ITEMS`` items and ``TERMS`` terms with repeats, which bound what is broadcast and what
a task holds; more items mean more runs over the written vectors, never larger ones.

Defined results for edge cases
* a null, empty or termless text counts nowhere and is never found; an item without terms
  finds nothing; fewer than k documents above zero: all of them;
* documents that share an id are documents of their own, ties between them in any order
  (their rows are equal); a null ``doc_id`` takes part and comes last among equal scores;
* equal items (id and text) count once; items that share an id but not the text are ranked
  apart; a null ``item_id`` is an item like others;
* very long texts count whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyman.llm.common import joined_bytes, pick, stored

#: Most items, and terms of them with repeats, that are searched for in one run over the documents.
ITEMS, TERMS = 512, 16_000
#: One document in so many is searched first, for lower bounds of the kth scores.
FIRST = 16
#: Documents of a batch, and numbers of its matrix at most; documents and items of a leaf; children of a node.
BATCH, CELLS, LEAF, FAN = 1024, 8_000_000, 16, 4

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters; only A-Z lower-cased."""
    return (text or "").encode().translate(_LOWER).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def coordinates(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Integer coordinates from occurrences and document lengths (64-bit, rounding down)."""
    m = 100 - 25 + (25 * n.astype(np.int64) * n_docs) // n_terms
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 12 * m)


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Terms of all texts, in order, and each one's row."""
    raw, offsets = joined_bytes(texts)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(np.frombuffer(_LOWER, np.uint8)[raw]))
    words = pc.ascii_split_whitespace(plain)  # splits at blanks only: other bytes stay as they are
    row = np.repeat(np.arange(len(texts)), words.value_lengths().to_numpy(zero_copy_only=False))
    flat = words.flatten()
    real = pc.greater(pc.binary_length(flat), 0)  # none before or behind blanks at a text's ends
    return row[real.to_numpy(zero_copy_only=False)], flat.filter(real)


def vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, term, tf``: a document's length in terms, and the terms of the vocabulary
    it holds (their places, ascending) with their occurrences; a row for each document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(shared.value, pa.large_binary()).view(pa.large_string())
        size = max(1, len(names))
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.slice(at, 1000)
                row, terms = _split(b.column("text"))
                n = np.bincount(row, minlength=len(b))
                place = pc.fill_null(pc.index_in(terms, value_set=names), -1).to_numpy(zero_copy_only=False)
                key, tf = np.unique(row[place >= 0] * size + place[place >= 0], return_counts=True)
                ends = np.searchsorted(key, np.arange(1, len(b) + 1) * size)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                out = pa.RecordBatch.from_arrays([
                    b.column("doc_id"), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array((key % size).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64)))], names=["doc_id", "n", "term", "tf"])
                yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


class Items:
    """A block of items as a hierarchy over rows of weights (items in the order of their
    heaviest terms, so that neighbours share some): leaves are single items, each further
    level joins ``FAN`` neighbours to their coordinate maxima."""

    def __init__(self, bags: list[dict[int, int]], weights: np.ndarray):
        heavy = [max(bag, key=lambda t: (weights[t] * bag[t], t), default=-1) for bag in bags]
        self.order = np.array(sorted(range(len(bags)), key=lambda i: (heavy[i], i)), np.int64)
        # scores are whole in doubles where no sum can reach 2^53 (a coordinate is below 10^6)
        most = max(sum(int(weights[t]) * times for t, times in bag.items()) for bag in bags)
        self.exact = np.float64 if most * 1_000_000 < 1 << 53 else np.int64
        rows = np.zeros((len(bags), len(weights)), self.exact)
        for at, i in enumerate(self.order):
            for term, times in bags[i].items():
                rows[at, term] = weights[term] * times
        self.rows = rows
        self.levels = [rows.astype(np.float64, copy=False)]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN), axis=0))
        self.levels.reverse()

    def weakest(self, kth: np.ndarray) -> list[np.ndarray]:
        """The weakest kth score below each node, by level from the root."""
        levels = [kth]
        while len(levels[-1]) > 1:
            levels.append(np.minimum.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN)))
        return levels[::-1]


def surviving(items: Items, matrix: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """Which items (rows) may have a document of which document leaf (columns) among their
    best: dual traversal from both roots, level by level."""
    levels = [np.maximum.reduceat(matrix, np.arange(0, len(matrix), LEAF), axis=0)]
    while len(levels[-1]) > 1:
        levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN), axis=0))
    levels.reverse()
    weakest = items.weakest(kth)
    alive = np.ones((1, 1), bool)
    for step in range(max(len(items.levels), len(levels))):
        i, j = min(step, len(items.levels) - 1), min(step, len(levels) - 1)
        if step:  # children of surviving pairs, in each hierarchy that goes on
            if step < len(items.levels):
                alive = np.repeat(alive, FAN, axis=0)[:len(items.levels[i])]
            if step < len(levels):
                alive = np.repeat(alive, FAN, axis=1)[:, :len(levels[j])]
        up, down = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(up):
            break
        bound = items.levels[i][up] @ levels[j][down].T
        ok = (bound * (1 + 1e-9) >= weakest[i][up][:, None]) & (bound > 0)
        alive[np.ix_(up, down)] &= ok
    if not alive.any():
        return np.zeros((len(items.rows), len(levels[-1])), bool)
    return alive


def best_of_task(batches: Iterator[pa.RecordBatch], items: Items, n_docs: int, n_terms: int, k: int, kth: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Up to k rows ``item, doc_id, score`` of each item, from one task's vectors; ``kth`` is a
    lower bound of each item's kth score."""
    none = np.iinfo(np.int64).max  # a null id comes last
    count, width = items.rows.shape
    kth = kth[items.order].astype(np.float64)
    held = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(count)]  # scores, ids
    rows_a_batch = max(LEAF, min(BATCH, CELLS // max(1, width)))
    for whole in batches:
        ids = pc.fill_null(whole.column("doc_id"), none).to_numpy(zero_copy_only=False)
        lists = whole.column("term")
        starts = lists.offsets.to_numpy()
        term, tf = (whole.column(c).values.to_numpy() for c in ("term", "tf"))
        n = whole.column("n").to_numpy()
        # documents that hold many of the terms first: their scores raise the kth ones
        order = np.argsort(starts[:-1] - starts[1:], kind="stable")
        for at in range(0, len(order), rows_a_batch):
            here = order[at:at + rows_a_batch]
            size = starts[here + 1] - starts[here]
            row = np.repeat(np.arange(len(here)), size)
            cell = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[here], size)
            values = coordinates(tf[cell], np.repeat(n[here], size), n_docs, n_terms)
            matrix = np.zeros((len(here), width))
            matrix[row, term[cell]] = values
            alive = surviving(items, matrix, kth)
            rows, leaves = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            if not len(rows):
                continue
            some = np.concatenate([np.arange(x * LEAF, min((x + 1) * LEAF, len(here))) for x in leaves])
            scores = (items.rows[rows] @ matrix[some].astype(items.exact, copy=False).T).astype(np.int64)
            found, at_doc = np.nonzero((scores > 0) & (scores >= kth[rows][:, None]))
            cuts = np.searchsorted(found, np.arange(len(rows) + 1))
            for x, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a == b:
                    continue
                item = rows[x]
                old_scores, old_ids = held[item]
                s = np.concatenate([old_scores, scores[x, at_doc[a:b]]])
                d = np.concatenate([old_ids, ids[here[some[at_doc[a:b]]]]])
                top = np.lexsort((d, -s))[:k]
                held[item] = s[top], d[top]
                if len(top) == k:
                    kth[item] = max(kth[item], float(s[top[-1]]))
    if any(len(s) for s, _ in held):
        item = np.repeat(items.order, [len(s) for s, _ in held])
        ids = np.concatenate([d for _, d in held])
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(ids, mask=ids == none), pa.array(np.concatenate([s for s, _ in held]))],
                                         names=["item", "doc_id", "score"])


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, block: list[tuple], k: int) -> DataFrame | None:
    """``item, doc_id, score, rank`` of the items of one block (``item`` their places)."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, terms in block for t in terms})
    place = {t: i for i, t in enumerate(vocabulary)}
    held = stored(vectors(docs, vocabulary), "search-vectors")
    n_docs, n_terms = held.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    df = dict(held.select(F.explode("term").alias("term")).groupBy("term").count().collect())  # at most the block's terms
    weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    shared = spark.sparkContext.broadcast(([Counter(place[t] for t in terms) for _, terms in block], weights))

    def search(rows: DataFrame, kth: np.ndarray) -> DataFrame:
        start = spark.sparkContext.broadcast(kth)
        run = lambda batches: best_of_task(batches, Items(*shared.value), n_docs, n_terms, k, start.value.copy())
        return _ranked(rows.mapInArrow(run, "item int, doc_id long, score long"), k)

    first = F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST)) == 0
    best = stored(search(held.where(first), np.zeros(len(block), np.int64)).drop("rank"), "search-first")
    kth = np.zeros(len(block), np.int64)
    for item, n, least in best.groupBy("item").agg(F.count(F.lit(1)), F.min("score")).collect():  # a row an item
        if n == k:
            kth[item] = least
    return _ranked(best.unionByName(search(held.where(~first), kth).drop("rank")), k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", most_items: int = ITEMS, most_terms: int = TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = pick(items, item_id=item_id, text=item_text).where(F.col("text").isNotNull()).distinct()
    key = asked.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {key}, rank int, doc_id long, score long")
    block: list[tuple] = []
    terms = 0

    def searched(block: list[tuple]) -> DataFrame:
        found = search_block(rows, block, k)
        if found is None:
            return out
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, item_id {key}")
        return out.unionByName(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))

    for row in asked.orderBy("item_id", "text").toLocalIterator():  # a block of items at a time
        bag = terms_of(row["text"])
        if block and (len(block) == most_items or terms + len(bag) > most_terms):
            out, block, terms = searched(block), [], 0
        if bag:
            block.append((row["item_id"], bag))
            terms += len(bag)
    return searched(block) if block else out
