"""N-gram Jaccard join: near-duplicate groups of documents by word shingles.

Two documents link when the Jaccard similarity of their sets of five-word shingles
is at least 75 %; the result is exact. Copies (equal sets) are one *class* and are
compared once.

1. One Arrow pass hashes each document's shingles to 48 bits and writes the class
   digest, the first part of the set in a fixed order and a token bitmap (a signature).
2. Any two linked sets share a shingle among the first 25 % of their sets in that
   order. Frequent shingles, counted in a pass of their own, come last in the order,
   which keeps boilerplate out of these prefixes; whatever the list holds, the order is
   the same for all sets, so no link is lost.
3. Prefix shingles are aggregated to their smallest and largest class; those with a
   single class end there. In the others each class is compared with the smallest
   class it shares most prefix shingles with. These verified links give first
   components, so that a large group of near copies costs one comparison a class.
4. Shingles whose classes still lie in several components go through signature
   trees: a shingle's classes are cut into nodes by size and salt; node pairs survive
   unless they lie in one component, or their sizes rule out the overlap needed. A linked
   pair is looked for under its first common shingle in the order, so what comes before it
   in either set is not shared: the overlap is at most what is left of either set from
   there, and the smaller set must have it in its first seventh. Each node, and each
   surviving pair of nodes, is one group of a task, which builds the trees: their nodes
   hold the OR of their classes' bitmaps, their sizes' range and their components' range,
   from the root down to single classes. A dual traversal finds the classes that may link
   with one of another component; only these classes leave the task, never pairs.
   Their whole sets, made again from the texts, are dealt to the same groups, where all
   their overlaps are counted. Of the links only a spanning forest over the components
   leaves a group, so what leaves is less than its classes and no link that joins two
   components is lost.
5. Components of all links; each document gets the smallest id of its component.
6. Links are counted apart, since steps 3 and 4 leave out pairs that already lie in one
   component. All links lie inside components: one of two classes is one link, larger
   ones are cut into blocks of about ``BLOCK`` classes, each packed into one row (shingles
   that its sets share are held once), and each pair of blocks whose sizes allow a link
   has its overlaps counted from whole sets. Only counts a class leave a pair of blocks.

Hot shingles and hot groups are bounded everywhere: minima are combined on the map
side, joins are plain equi-joins that Spark may split, and a node holds about
``NODE`` classes and ``NODE_SHINGLES`` shingles.

The result is exact up to collisions of hashes: 48 bits for a shingle among those of two
compared sets, 64 bits for a class among all classes (one expected in 6 * 10^9 classes).

Defined results for edge cases
* null, empty or blank texts: empty set, 0 shingles, linked with nothing; texts of
  fewer than five words: one shingle, the whole sequence;
* a null ``doc_id``: a document of its own, component null, no links;
* rows with equal ids and different texts are separate documents that share an id;
* repeated rows: one result each; an empty table: no rows; extra columns are ignored;
* very long texts count whole: a task holds a small multiple of the largest set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.llm.common import broadcast_if_small, pick, stored
from tallyman.llm.components import connected_components

WORDS = 5
#: Similarity of a link, as a fraction of integers: NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 75, 100
#: Bytes kept of a shingle's hash, and least bits of a signature for each shingle.
HASH_BYTES = 6
BITS_A_SHINGLE = 2
#: Documents that make a shingle frequent, how many percent of each set are counted, and
#: how many frequent shingles are kept at most (8 bytes each, broadcast).
FREQUENT, COUNTED, MOST_FREQUENT = 24, 35, 1_000_000
#: Classes in a node of the distributed level, about, and in a node that is not cut further.
NODE, NODE_SHINGLES, LEAF = 512, 1_000_000, 8
#: Classes and shingles in a block whose links are counted at once, about; sets that have a
#: shingle at most, for it to be counted by pairs, and shingles in a dense product.
BLOCK, BLOCK_SHINGLES = 512, 500_000
RARE, COLUMNS = 16, 4096

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SHIFT = np.uint64(64 - 8 * HASH_BYTES)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending. Words end at ASCII white space;
    A-Z are lower-cased."""
    import xxhash

    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    lengths = words.value_lengths().to_numpy(zero_copy_only=False)
    flat = words.flatten()
    coded = flat.dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    stops = np.cumsum(lengths)
    if "" in names:  # what lies before or behind blanks at a text's ends
        real = codes != names.index("")
        lengths = np.add.reduceat(np.concatenate([real, [False]]), np.minimum(stops - lengths, len(real))) * (lengths > 0) if len(lengths) else lengths
        codes, stops = codes[real], np.cumsum(lengths)
    h = hashes[codes] if len(names) else np.empty(0, np.uint64)
    n = len(h) - WORDS + 1
    whole = _mix(sum(h[i:i + n] * _FACTORS[i] for i in range(WORDS))) >> _SHIFT if n > 0 else np.empty(0, np.uint64)
    out = []
    for stop, length in zip(stops.tolist(), lengths.tolist()):
        if length >= WORDS:
            out.append(np.unique(whole[stop - length:stop - WORDS + 1]))
        elif length:
            own = h[stop - length:stop]
            out.append(_mix(np.array([(own * _FACTORS[:length]).sum() + np.uint64(length)], np.uint64)) >> _SHIFT)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def in_order(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The global order: rare shingles by hash, then frequent ones by hash."""
    if not len(frequent):
        return tokens
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    hot = frequent[at] == tokens
    return np.concatenate([tokens[~hot], tokens[hot]])


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def signature(tokens: np.ndarray) -> np.ndarray:
    """The token bitmap, a power of two of 64-bit words that grows with the set. Sets that
    can link differ little in size, and the wider of two bitmaps folds to the narrower."""
    words = 4
    while 64 * words < BITS_A_SHINGLE * len(tokens):
        words *= 2
    bits = np.zeros(64 * words, np.uint8)
    bits[(_mix(tokens) & np.uint64(64 * words - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def bitmaps(blobs: pa.ChunkedArray | pa.Array, words: int | None = None) -> np.ndarray:
    """A row for each bitmap, all folded to the narrowest (or to ``words``)."""
    raw = [np.frombuffer(x.as_buffer(), "<u8") for x in blobs]
    words = min(words or 1 << 40, min((len(r) for r in raw), default=4))
    return np.stack([np.bitwise_or.reduce(r.reshape(-1, words), axis=0) for r in raw]) if raw else np.zeros((0, 4), "<u8")


def pack(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, HASH_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :HASH_BYTES] = raw
    return out.view("<u8").ravel()


def enough(overlap, n_a, n_b):
    """Whether an overlap makes two sets of these sizes link (elementwise)."""
    return DENOMINATOR * overlap >= NUMERATOR * (n_a + n_b - overlap)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def frequent_shingles(rows: DataFrame, least: int = FREQUENT, most: int = MOST_FREQUENT) -> np.ndarray:
    """Shingles that at least ``least`` documents have among the first part of their sets
    (by hash); where these are more than ``most``, those of twice as many documents, and
    so on. The list only tunes the order; ``most`` bounds what is broadcast."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = shingle_sets(b.column("text"))
            if sets:
                part = np.concatenate([s[:-(-COUNTED * len(s) // 100)] for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64))], names=["token"])

    counts = rows.select("text").mapInArrow(tokens, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.where(F.col("n") >= least), "join-counts")
    while counts.where(F.col("n") >= least).count() > most:
        least *= 2
    return np.sort(counts.where(F.col("n") >= least).select("token").toPandas()["token"].to_numpy(np.int64).astype(np.uint64))


def classes(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``doc_id, text_key, n, cls, prefix, bits`` of each row: a hash of its text, set size,
    class digest, packed prefix of the set in the global order, signature."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hot = shared.value
        for b in _slices(batches):
            sets = shingle_sets(b.column("text"))
            prefixes = [pack(in_order(s, hot)[:prefix_length(len(s))]) for s in sets]
            digest = np.array([xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) for s in sets], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest), pa.array(prefixes, pa.binary()),
                pa.array([signature(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "text_key", "n", "cls", "prefix", "bits"])

    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, n long, cls long, prefix binary, bits binary")


def prefix_rows(sets: DataFrame) -> DataFrame:
    """``key, cls, rest``: the prefix shingles of each class, and how many shingles of its
    set come from there on in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            keys = [unpack(blob.as_buffer()) for blob in b.column("prefix")]
            of = np.repeat(b.column("cls").to_numpy(), [len(k) for k in keys])
            rest = np.concatenate([n - np.arange(len(k)) for k, n in zip(keys, b.column("n").to_numpy())])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(of), pa.array(rest.astype(np.int32))], names=["key", "cls", "rest"])

    return sets.where(F.col("n") > 0).select("cls", "n", "prefix").mapInArrow(run, "key long, cls long, rest int")


def whole_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``cls, tokens``: the packed sets of the wanted classes, from one document (``doc_id,
    text_key, cls``) each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array([pack(s) for s in shingle_sets(b.column("text"))], pa.binary())], names=["cls", "tokens"])

    keyed = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    found = keyed.join(broadcast_if_small(wanted), ["doc_id", "text_key"]).select("cls", "text").mapInArrow(run, "cls long, tokens binary")
    return stored(found.groupBy("cls").agg(F.min("tokens").alias("tokens")), "join-whole")  # repeated rows give one set


def _overlap_bound(bits_a: np.ndarray, bits_b: np.ndarray, spare_a, spare_b) -> np.ndarray:
    """Most shingles that two sets can share: each shared one sets a common bit, and a set
    has ``spare`` more shingles than bits."""
    return np.bitwise_count(bits_a & bits_b).sum(-1) + np.minimum(spare_a, spare_b)


def verified(pairs: DataFrame, one: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs of classes ``a, b`` that link: first by sizes and signatures, then by whole
    sets. ``one`` has a row ``cls, n, bits, doc_id, text_key`` for each class."""

    def side(table: DataFrame, name: str, *columns: str) -> DataFrame:
        return table.select(F.col("cls").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 20_000):
            n_a, n_b = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
            widths = np.minimum(*(pc.binary_length(b.column(c)).to_numpy() // 8 for c in ("bits_a", "bits_b")))
            keep = np.zeros(len(b), bool)
            for words in np.unique(widths).tolist():
                at = np.flatnonzero(widths == words)
                bits = [bitmaps(b.column(c).take(pa.array(at)), words) for c in ("bits_a", "bits_b")]
                spare = [n[at] - np.bitwise_count(x).sum(-1) for n, x in zip((n_a, n_b), bits)]
                most = np.minimum(_overlap_bound(*bits, *spare), np.minimum(n_a[at], n_b[at]))
                keep[at] = enough(most, n_a[at], n_b[at])
            yield b.select(["a", "b"]).filter(pa.array(keep))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            keep = []
            for x, y in zip(b.column("tokens_a"), b.column("tokens_b")):
                s, t = unpack(x.as_buffer()), unpack(y.as_buffer())
                keep.append(bool(enough(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t))))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = pairs.join(side(one, "a", "n", "bits"), "a").join(side(one, "b", "n", "bits"), "b")
    near = near.where(F.least("n_a", "n_b") * DENOMINATOR >= F.greatest("n_a", "n_b") * NUMERATOR)
    near = stored(near.mapInArrow(sift, "a long, b long"), "join-sifted")
    some = near.select(F.col("a").alias("cls")).unionByName(near.select(F.col("b").alias("cls"))).distinct()
    sets = whole_sets(rows, stored(one.join(some, "cls", "left_semi").select("doc_id", "text_key", "cls"), "join-wanted"))
    whole = near.join(side(sets, "a", "tokens"), "a").join(side(sets, "b", "tokens"), "b")
    return stored(whole.select("a", "b", "tokens_a", "tokens_b").mapInArrow(compare, "a long, b long"), "join-links")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups, and where each group begins (and the last one ends), of rows
    that come sorted by ``keys``; a group may span batches."""

    def cuts(rows: pa.Table) -> list[int]:
        change = np.zeros(rows.num_rows, bool)
        for x in (rows.column(k).to_numpy() for k in keys):
            change[1:] |= x[1:] != x[:-1]
        return [0, *np.flatnonzero(change).tolist(), rows.num_rows]

    held = None
    for b in batches:
        rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        starts = cuts(rows)
        held = rows.slice(starts[-2]).combine_chunks() if rows.num_rows else rows
        if len(starts) > 2:
            yield rows.slice(0, starts[-2]).combine_chunks(), starts[:-1]
    if held is not None and held.num_rows:
        yield held, [0, held.num_rows]


class _Tree:
    """A signature tree over classes sorted by size: a node holds the OR of its bitmaps,
    its sizes' range, the most spare shingles, the most shingles from the key on, and the
    range of components."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, comp: np.ndarray, rest: np.ndarray):
        order = np.lexsort((comp, rest, n))
        self.places, n, bits, comp, rest = order, n[order], bits[order], comp[order], rest[order]
        spare = n - np.bitwise_count(bits).sum(-1)
        # level 0: the classes; each further level pairs neighbours
        self.levels = [(n, n, bits, spare, comp, comp, rest)]
        while len(self.levels[-1][0]) > 1:
            low, high, orr, sp, c0, c1, left = self.levels[-1]
            at = np.arange(0, len(low), 2)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.bitwise_or.reduceat(orr, at, axis=0),
                                np.maximum.reduceat(sp, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at), np.maximum.reduceat(left, at)))

    def pairs_with(self, other: "_Tree") -> tuple[np.ndarray, np.ndarray]:
        """Dual traversal, level by level: pairs of nodes that may hold a link descend to
        the pairs of their children. Gives pairs of the classes' places."""
        same = other is self
        i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
        up, down = len(self.levels) - 1, len(other.levels) - 1
        while True:
            a, b = self.levels[up], other.levels[down]
            low_a, high_a, _, sp_a, c0_a, c1_a, rest_a = (x[i] if k != 2 else None for k, x in enumerate(a))
            low_b, high_b, _, sp_b, c0_b, c1_b, rest_b = (x[j] if k != 2 else None for k, x in enumerate(b))
            one = (c0_a == c1_a) & (c0_b == c1_b) & (c0_a == c0_b)
            most = np.minimum(np.minimum(rest_a, rest_b), np.minimum(high_a, high_b))
            keep = ~one & enough(most, low_a, low_b)
            if same and up == down:
                keep &= i <= j if up else i < j
            at = np.flatnonzero(keep)
            for part in range(0, len(at), 100_000):  # bitmaps of the pairs that are left
                k = at[part:part + 100_000]
                bound = np.minimum(most[k], _overlap_bound(a[2][i[k]], b[2][j[k]], sp_a[k], sp_b[k]))
                keep[k] = enough(bound, low_a[k], low_b[k])
            i, j = i[keep], j[keep]
            if not (up or down) or not len(i):
                return self.places[i], other.places[j]
            if up >= down or not down:
                i, j = np.concatenate([2 * i, 2 * i + 1]), np.concatenate([j, j])
                up -= 1
                ok = i < len(self.levels[up][0])
                i, j = i[ok], j[ok]
                if not same:
                    continue
            if down:
                i, j = np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1])
                down -= 1
                ok = j < len(other.levels[down][0])
                i, j = i[ok], j[ok]


class _Members:
    """The classes of a node, or of two, and their bitmaps at every width they have."""

    def __init__(self, rows: pa.Table):
        self.n, self.comp, self.rest = (rows.column(c).to_numpy() for c in ("n", "component", "rest"))
        self.raw = [np.frombuffer(x.as_buffer(), "<u8") for x in rows.column("bits")]
        self.width = np.array([len(r) for r in self.raw])

    def folded(self, at: np.ndarray, words: int) -> np.ndarray:
        return np.stack([np.bitwise_or.reduce(self.raw[x].reshape(-1, words), axis=0) for x in at])

    def tree(self, at: np.ndarray, words: int) -> _Tree:
        return _Tree(self.n[at], self.folded(at, words), self.comp[at], self.rest[at])

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of classes of different components may link, by their bitmaps at the
        narrower one's width."""
        keep = (self.comp[i] != self.comp[j]) & enough(np.minimum(np.minimum(self.n[i], self.n[j]), np.minimum(self.rest[i], self.rest[j])), self.n[i], self.n[j])
        words = np.minimum(self.width[i], self.width[j])
        for w in np.unique(words[keep]).tolist():
            wide = np.flatnonzero(self.width >= w)
            place = np.zeros(len(self.n), np.int64)
            place[wide] = np.arange(len(wide))
            bits = self.folded(wide, w)
            spare = self.n[wide] - np.bitwise_count(bits).sum(-1)
            some = np.flatnonzero(keep & (words == w))
            for part in range(0, len(some), 100_000):
                k = some[part:part + 100_000]
                x, y = place[i[k]], place[j[k]]
                most = np.minimum(_overlap_bound(bits[x], bits[y], spare[x], spare[y]), np.minimum(self.n[i[k]], self.n[j[k]]))
                keep[k] = enough(most, self.n[i[k]], self.n[j[k]])
        return keep

    def survivors(self, split: int | None = None) -> np.ndarray:
        """Places of the classes that may link with one of another component: with any
        other class, or with one on the other side of ``split``."""
        m = len(self.n)
        if m <= LEAF and split is None:
            i, j = np.triu_indices(m, 1)
        else:
            words = int(self.width.min())
            one = np.arange(m if split is None else split)
            a = self.tree(one, words)
            i, j = a.pairs_with(a if split is None else self.tree(np.arange(split, m), words))
            j = j if split is None else j + split
        keep = self.near(i, j)
        return np.unique(np.concatenate([i[keep], j[keep]]))


_NODE_KEYS = ["key", "size_class", "early", "salt"]
_CELL = ["key", "size_x", "early_x", "salt_x", "size_y", "early_y", "salt_y"]
_CELL_TYPES = ["long", "int", "int", "int", "int", "int", "int"]
_SURVIVORS = ", ".join(f"{c} {t}" for c, t in zip(_CELL, _CELL_TYPES)) + ", side int, cls long, component long"


def _found(cells: list[np.ndarray], side: np.ndarray, rows: pa.Table, at: np.ndarray) -> pa.Table:
    kinds = [pa.int64() if t == "long" else pa.int32() for t in _CELL_TYPES]
    return pa.table([*[pa.array(c, k) for c, k in zip(cells, kinds)], pa.array(side, pa.int32()), rows.column("cls").take(pa.array(at)), rows.column("component").take(pa.array(at))],
                    names=[*_CELL, "side", "cls", "component"])


def _inside_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes that may link inside their node; rows come sorted by node."""
    for rows, starts in _whole_groups(batches, _NODE_KEYS):
        at = np.concatenate([np.empty(0, np.int64), *[start + _Members(rows.slice(start, end - start)).survivors() for start, end in zip(starts, starts[1:])]])
        node = [rows.column(c).to_numpy()[at] for c in _NODE_KEYS]
        yield from _found([*node, *node[1:]], np.zeros(len(at)), rows, at).to_batches()


def _across_nodes(left: pa.Table, right: pa.Table) -> pa.Table:
    """Classes of two nodes that may link with one of the other node."""
    columns = ["cls", "n", "rest", "bits", "component"]
    rows = pa.concat_tables([left.select(columns), right.select(columns)]).combine_chunks()
    at = _Members(rows).survivors(left.num_rows)
    cell = [np.full(len(at), left.column(c)[0].as_py()) for c in _CELL]
    return _found(cell, at >= left.num_rows, rows, at)


def spanning_links(linked: np.ndarray, component: np.ndarray, split: int) -> list[tuple[int, int]]:
    """Of the linked pairs (above the diagonal, or across ``split``) as few as join the same components."""
    label, out = component.copy(), []
    shift = 0 if split == len(component) else split
    for i in range(len(linked)):
        others = np.flatnonzero(linked[i]) + shift
        labels, first = np.unique(label[others], return_index=True)
        for own, j in zip(labels.tolist(), others[first].tolist()):
            if own != label[i]:
                out.append((i, j))
                label[label == own] = label[i]
    return out


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links ``a, b`` that join components in each group; rows come sorted by group and side."""
    for rows, starts in _whole_groups(_slices(batches), _CELL):
        cls, comp, side = (rows.column(c).to_numpy() for c in ("cls", "component", "side"))
        a, b = [], []
        for at, end in zip(starts, starts[1:]):
            sets = [unpack(x.as_buffer()) for x in rows.column("tokens").slice(at, end - at)]
            n = np.array([len(s) for s in sets])
            split = int((side[at:end] == 0).sum())
            x, y = (n, n) if split == len(n) else (n[:split], n[split:])
            shared = overlaps(sets, split)
            for i, j in spanning_links((shared > 0) & enough(shared, x[:, None], y[None, :]), comp[at:end], split):
                a.append(min(cls[at + i], cls[at + j])), b.append(max(cls[at + i], cls[at + j]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def tree_survivors(members: DataFrame, node: int = NODE, shingles: int = NODE_SHINGLES) -> DataFrame:
    """Classes that may link with one of another component under the same key: a row for
    each in each group (node, or pair of nodes) where it may. ``members`` has ``key, cls,
    rest, n, bits, component``.

    A key's classes are cut by size class (sizes that can link lie in the same or in
    neighbouring classes), by whether the key comes early in the set (as it must in the
    smaller one of a pair), and, where such a part is large, by salt."""
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DENOMINATOR / NUMERATOR)) + F.lit(1e-9)).cast("int")
    early = (NUMERATOR + DENOMINATOR) * F.col("rest") >= 2 * NUMERATOR * F.col("n")
    members = members.withColumn("size_class", step).withColumn("early", early.cast("int"))
    parts = members.groupBy("key", "size_class", "early").agg(F.greatest(F.ceil(F.count(F.lit(1)) / node), F.ceil(F.sum("n") / shingles)).alias("parts"))
    useful = members.groupBy("key").agg(F.max("early").alias("any")).where(F.col("any") == 1).select("key")
    salted = members.join(useful, "key", "left_semi").join(parts, ["key", "size_class", "early"]).withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    salted = stored(salted.select(*_NODE_KEYS, "cls", "n", "rest", "bits", "component"), "join-nodes")

    nodes = salted.groupBy(*_NODE_KEYS).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    inside = salted.where(F.col("early") == 1).join(nodes.where(F.col("c0") < F.col("c1")).select(*_NODE_KEYS), _NODE_KEYS, "left_semi")
    data = ["cls", "n", "rest", "bits", "component"]
    # hundreds of small nodes a batch, so one call a node would cost too much
    own = inside.select(*_NODE_KEYS, *data).repartition(*_NODE_KEYS).sortWithinPartitions(*_NODE_KEYS).mapInArrow(_inside_nodes, _SURVIVORS)

    # pairs of different nodes of a key: equal or neighbouring size class
    x = nodes.select("key", F.col("size_class").alias("size_x"), F.col("early").alias("early_x"), F.col("salt").alias("salt_x"), F.col("low").alias("low_x"),
                     F.col("high").alias("high_x"), F.col("rest").alias("rest_x"), F.col("c0").alias("c0_x"), F.col("c1").alias("c1_x"), F.explode(F.array(F.col("size_class"), F.col("size_class") + 1)).alias("size_class"))
    apart = x.join(nodes, ["key", "size_class"]).where(
        ((F.col("size_x") < F.col("size_class")) | (F.struct("early_x", "salt_x") < F.struct("early", "salt")))
        & ((F.col("early_x") == 1) | (F.col("early") == 1))
        & (F.least("rest_x", "rest") * (DENOMINATOR + NUMERATOR) >= NUMERATOR * (F.col("low_x") + F.col("low")))
        & ~((F.col("c0_x") == F.col("c1_x")) & (F.col("c0") == F.col("c1")) & (F.col("c0") == F.col("c0_x")))
        & (F.least("high_x", "high") * DENOMINATOR >= F.greatest("low_x", "low") * NUMERATOR))
    apart = stored(apart.withColumnsRenamed({"size_class": "size_y", "early": "early_y", "salt": "salt_y"}).select(*_CELL), "join-node-pairs")
    one = salted.withColumnsRenamed({"size_class": "size_x", "early": "early_x", "salt": "salt_x"}).join(apart, _CELL[:4])
    two = salted.withColumnsRenamed({"size_class": "size_y", "early": "early_y", "salt": "salt_y"}).join(apart, ["key", *_CELL[4:]])
    two = two.select(*[F.col(c).alias(c) for c in (*_CELL, *data)])  # columns of its own
    across = one.select(*_CELL, *data).groupBy(*_CELL).cogroup(two.groupBy(*_CELL)).applyInArrow(_across_nodes, _SURVIVORS)
    return own.unionByName(across)


def tree_links(members: DataFrame, one: DataFrame, rows: DataFrame, **limits: int) -> DataFrame:
    """Links ``a, b`` between components, found by trees and verified from whole sets in
    their groups: together with the components, they join what all links would."""
    found = stored(tree_survivors(members, **limits), "join-survivors")
    # similar sets meet under many shingles: of groups with the same classes on the same sides, one
    marks = found.withColumn("mark", F.xxhash64("cls", "side"))
    same = marks.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("first"), F.max("cls").alias("last"), F.bit_xor("mark").alias("all"), F.bit_xor(F.xxhash64("mark")).alias("all2"))
    once = same.groupBy("n", "first", "last", "all", "all2").agg(F.min(F.struct(*_CELL)).alias("cell")).select("cell.*")
    found = stored(found.join(once, _CELL, "left_semi"), "join-survivors-once")
    wanted = stored(one.join(found.select("cls").distinct(), "cls", "left_semi").select("doc_id", "text_key", "cls"), "join-tree-wanted")
    whole = found.join(whole_sets(rows, wanted), "cls").select(*_CELL, "side", "cls", "component", "tokens")
    return stored(whole.repartition(*_CELL).sortWithinPartitions(*_CELL, "side").mapInArrow(_spanning, "a long, b long").distinct(), "join-tree-links")


def overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Shared shingles of each of the first ``split`` sets with each of the others; of all
    sets with each other, above the diagonal, where ``split`` is their number."""
    m = len(sets)
    left, right = (slice(0, m), slice(0, m)) if split == m else (slice(0, split), slice(split, m))
    tokens, of = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, of = tokens[order], of[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    counts = np.diff(np.append(starts, len(tokens)))
    group = np.repeat(np.arange(len(starts)), counts)
    some, many = (counts > 1) & (counts <= RARE), counts > RARE
    out = np.zeros((m, m), np.int64)
    at = some[group]
    g, o = group[at], of[at]
    for step in range(1, int(counts[some].max(initial=1))):
        same = np.flatnonzero(g[step:] == g[:-step])
        out += np.bincount(o[same] * m + o[same + step], minlength=m * m).reshape(m, m)
    out = out[left, right]
    at = many[group]
    column, o = (np.cumsum(many) - 1)[group[at]], of[at]
    for first in range(0, int(many.sum()), COLUMNS):
        here = slice(*np.searchsorted(column, [first, first + COLUMNS]))
        dense = np.zeros((m, min(COLUMNS, int(many.sum()) - first)), np.float32)  # exact up to 2^24
        dense[o[here], column[here] - first] = 1
        out += (dense[left] @ dense[right].T).astype(np.int64)
    return np.triu(out, 1) if split == m else out


_BLOCK_KEYS = ["component", "size_class", "salt"]
_BLOCK = "cls: binary, sizes: binary, tokens: binary, places: binary"


def _packed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its classes, the sizes of their sets, the distinct shingles of all,
    and where among these each set's stand (steps, compressed). Sets of a block share most
    shingles, so a block takes little more than one of its sets. Rows come sorted by block."""
    import zstandard

    coder = zstandard.ZstdCompressor(level=1)
    kind = pa.struct([(name.split(":")[0], pa.binary()) for name in _BLOCK.split(", ")])
    for rows, starts in _whole_groups(_slices(batches), _BLOCK_KEYS):
        cls, blobs, blocks = rows.column("cls").to_numpy(), rows.column("tokens"), []
        for at, end in zip(starts, starts[1:]):
            sets = [unpack(x.as_buffer()) for x in blobs.slice(at, end - at)]
            tokens, places = np.unique(np.concatenate(sets), return_inverse=True)
            steps = np.diff(places, prepend=0).astype("<i4")
            blocks.append({"cls": cls[at:end].astype("<i8").tobytes(), "sizes": np.array([len(x) for x in sets], "<i8").tobytes(),
                           "tokens": pack(tokens), "places": coder.compress(steps.tobytes())})
        first = pa.array(starts[:-1])
        yield pa.RecordBatch.from_arrays([*[rows.column(c).combine_chunks().take(first) for c in _BLOCK_KEYS], pa.array(blocks, kind)], names=[*_BLOCK_KEYS, "block"])


def _unpacked(block: dict[str, bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    import zstandard

    sizes = np.frombuffer(block["sizes"], "<i8")
    places = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(block["places"]), "<i4"), dtype=np.int64)
    return np.frombuffer(block["cls"], "<i8"), np.split(unpack(pa.py_buffer(block["tokens"]))[places], np.cumsum(sizes)[:-1])


def _count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links a class has in each pair of blocks ``x, y`` (``y`` null: inside ``x``)."""
    for b in batches:
        for at in range(len(b)):
            cls, sets = _unpacked(b.column("x")[at].as_py())
            split, other = len(sets), b.column("y")[at].as_py()
            if other is not None:
                more, others = _unpacked(other)
                cls, sets = np.concatenate([cls, more]), sets + others
            n = np.array([len(s) for s in sets])
            x, y = (n, n) if other is None else (n[:split], n[split:])
            linked = enough(overlaps(sets, split), x[:, None], y[None, :])
            here = linked.sum(0) + linked.sum(1) if other is None else np.concatenate([linked.sum(1), linked.sum(0)])
            yield pa.RecordBatch.from_arrays([pa.array(cls[here > 0]), pa.array(here[here > 0].astype(np.int64))], names=["cls", "n_links"])


def link_counts(placed: DataFrame, one: DataFrame, rows: DataFrame) -> DataFrame:
    """``cls, n_links``: how many other classes each class links with, over all pairs.
    ``placed`` has ``node, component`` of every class with a link, ``one`` a row ``cls, n,
    doc_id, text_key`` for each class."""
    members = placed.withColumnRenamed("node", "cls").join(one.select("cls", "n", "doc_id", "text_key"), "cls")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n_here"), F.sum("n").alias("shingles"))
    members = stored(members.join(sizes, "component"), "join-placed-all")
    two = members.where(F.col("n_here") == 2).select("cls", F.lit(1).cast("long").alias("n_links"))

    # blocks: a small component whole, a larger one by size class (as in the trees) and salt
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DENOMINATOR / NUMERATOR)) + F.lit(1e-9)).cast("int")
    small = (F.col("n_here") <= BLOCK) & (F.col("shingles") <= BLOCK_SHINGLES)
    cut = members.where(F.col("n_here") > 2).withColumn("size_class", F.when(small, F.lit(0)).otherwise(step))
    parts = cut.groupBy("component", "size_class").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    cut = cut.join(parts, ["component", "size_class"]).withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    cut = stored(cut.select("component", "size_class", "salt", "cls", "n", "doc_id", "text_key"), "join-blocks")
    blocks = cut.groupBy("component", "size_class", "salt").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    x = blocks.select("component", F.col("size_class").alias("size_x"), F.col("salt").alias("salt_x"), F.col("low").alias("low_x"), F.col("high").alias("high_x"),
                      F.explode(F.array(F.col("size_class"), F.col("size_class") + 1)).alias("size_class"))
    pairs = x.join(blocks, ["component", "size_class"]).where(
        ((F.col("size_x") < F.col("size_class")) | (F.col("salt_x") <= F.col("salt")))
        & (F.least("high_x", "high") * DENOMINATOR >= F.greatest("low_x", "low") * NUMERATOR))
    pairs = stored(pairs.select("component", "size_x", "salt_x", F.col("size_class").alias("size_y"), F.col("salt").alias("salt_y")), "join-block-pairs")

    sets = whole_sets(rows, cut.select("doc_id", "text_key", "cls"))
    cut = cut.select(*_BLOCK_KEYS, "cls").join(sets, "cls")
    packed = cut.repartition(*_BLOCK_KEYS).sortWithinPartitions(*_BLOCK_KEYS).mapInArrow(_packed_blocks, f"component long, size_class int, salt int, block struct<{_BLOCK}>")
    packed = stored(packed, "join-packed-blocks")

    def named(name: str) -> DataFrame:
        return packed.withColumnsRenamed({"size_class": f"size_{name}", "salt": f"salt_{name}", "block": name})

    apart = pairs.where((F.col("size_x") < F.col("size_y")) | (F.col("salt_x") < F.col("salt_y")))
    across = apart.join(named("x"), ["component", "size_x", "salt_x"]).join(named("y"), ["component", "size_y", "salt_y"]).select("x", "y")
    # a few rows a task of much work each: dealt evenly
    across = across.repartition(F.xxhash64("x.cls", "y.cls"))
    own = packed.select(F.col("block").alias("x"), F.lit(None).cast(f"struct<{_BLOCK}>").alias("y"))
    counted = own.mapInArrow(_count_links, "cls long, n_links long").unionByName(across.mapInArrow(_count_links, "cls long, n_links long"))
    return two.unionByName(counted.groupBy("cls").agg(F.sum("n_links").alias("n_links")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", count_links: bool = True) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links, text_key`` of each row; ``n_links`` is the
    number of other classes that the row's class links with. Without ``count_links`` there
    is no ``n_links``: components need only some of the links."""
    rows = pick(docs, doc_id=doc_id, text=text)
    everything = stored(classes(rows, frequent_shingles(rows)), "join-sets")
    sets = everything.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    keyed = prefix_rows(sets)
    several = stored(keyed.groupBy("key").agg(F.min("cls").alias("lead"), F.max("cls").alias("last")).where(F.col("lead") < F.col("last")), "join-keys")
    members = stored(keyed.join(several.select("key", "lead"), "key").distinct(), "join-members")
    # one row for each class: that of the smallest id
    one = sets.groupBy("cls").agg(F.min(F.struct("doc_id", "text_key", "n", "bits")).alias("r")).select("cls", "r.*")
    one = stored(one, "join-classes")
    best = one.select("cls", "doc_id")

    # first links: each class with the lead it shares most prefix shingles with
    shared = members.where(F.col("cls") != F.col("lead")).groupBy("cls", "lead").agg(F.count(F.lit(1)).alias("n"))
    leads = shared.groupBy("cls").agg(F.max_by("lead", F.struct("n", -F.col("lead"))).alias("lead"))
    links = verified(leads.select(F.col("lead").alias("a"), F.col("cls").alias("b")), one, rows)
    first = connected_components(links)

    # keys whose classes lie in several components; of keys with the same classes, the first
    # in the order (the one with most left of the sets)
    placed = members.select("key", "cls", "rest").join(first.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    placed = stored(placed, "join-placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("n"),
                                      F.min("cls").alias("first"), F.max("cls").alias("last"), F.bit_xor("cls").alias("all"), F.bit_xor(F.xxhash64("cls")).alias("all2"), F.sum("rest").alias("rest"))
    mixed = mixed.where(F.col("c0") < F.col("c1")).groupBy("n", "first", "last", "all", "all2").agg(F.max_by("key", F.struct("rest", "key")).alias("key"))
    mixed = stored(mixed.select("key"), "join-mixed")
    rest = placed.join(mixed, "key", "left_semi").join(one.select("cls", "n", "bits"), "cls")
    links = links.unionByName(tree_links(rest, one, rows))
    final = connected_components(links)

    lowest = best.join(final.withColumnRenamed("node", "cls"), "cls").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = final.withColumnRenamed("node", "cls").join(lowest, "component").select("cls", "component_id")
    per_class = best.withColumnRenamed("doc_id", "own").join(of_class, "cls", "left")
    if count_links:
        per_class = per_class.join(link_counts(final, one, rows), "cls", "left")
    n_links = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []
    per_class = per_class.select("cls", F.coalesce("component_id", "own").alias("component_id"), *n_links)
    linked = everything.select("doc_id", "text_key", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("cls")).alias("cls"))
    out = linked.join(per_class, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *n_links, "text_key")


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component; of rows with
    equal id and text one stays. Rows without an id are only compared with each other."""
    found = near_duplicates(docs, doc_id, text, count_links=False)
    gone = found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    whole = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.join(gone, ["id", "key"], "left_anti").dropDuplicates(["id", "key"]).select("row.*")
