"""Phrase collocation mining by SON partitioning (savasere-omiecinski-navathe).

Phrases of 2 to 5 words with at least ``SUPPORT`` occurrences in their language are ranked
by how much more often they occur than their parts would by chance, at the worst cut.

1. The documents are dealt by hash into ``SHARDS`` shards. The number is fixed, so that the
   lowered support of a shard stays well above one at any input size; a shard is as large
   as the input makes it and is mined by as many tasks as it needs.
2. Each shard is mined completely at the support lowered to its share of all words: words
   first (as texts, so their counts are exact at once), then phrases of two words whose
   parts are frequent in the shard, and so on. A phrase with the support overall has at
   least the lowered one in some shard, and so have all its parts there. Phrases are
   counted under 60-bit hashes here; two that share one only look more frequent, so none
   is lost.
3. The union of the shards' frequent phrases, without those that can't reach the support
   (their counts where they are frequent, and one less than the lowered support elsewhere,
   come to less), is a bitmap for each length: ``PLACES`` bits a phrase of a few each, at
   most ``MOST_BITS`` in all; when crowded it lets more through and loses nothing.
4. One more pass counts all candidates of two words and more exactly, as texts, by language;
   the support, the parts' counts, the cuts and the containing phrases all come from that
   table and the words'.

Counts are combined in each task before they are shuffled: hashes, at most about ``HELD`` at
a time, words and candidates, at most about ``HELD_TEXTS``.

Defined results for edge cases
* null texts are empty; a null ``lang`` is ``und``; an empty ``lang`` is a language;
* repeated rows and rows that share an id count each; ``doc_id`` may be null;
* a word is whatever stands between blanks and marks, of any length; very long texts and
  words count whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyman.llm.common import broadcast_if_small, joined_bytes, merged_splits, pick, stored

#: Occurrences and words of a phrase; phrases reported of each language.
SUPPORT, LONGEST, MOST = 100, 5, 2000
#: Shards (at most 16: four bits of a key), and groups that a language's phrases are ranked in first.
SHARDS, GROUPS = 4, 32
#: Bits of a bitmap for each phrase in it, of which are set, and least and most bits of a bitmap.
BITS_A_PHRASE, PLACES, LEAST_BITS, MOST_BITS = 16, 4, 1 << 16, 1 << 30
#: Counts of hashes and of words that a task holds before it passes them on; rows of a batch.
HELD, HELD_TEXTS, ROWS = 1_500_000, 600_000, 1000
#: Bytes of input that a task of the exact pass should see at least.
SPLIT_BYTES = 64 << 20

_BLANK, _MARK = b" \t", b".,;:!?\n\x0b\x0c\r"
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_KIND = np.array([1 if b in _BLANK else 2 if b in _MARK else 0 for b in range(256)], np.uint8)
_HALF = np.uint64((1 << 30) - 1)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of a batch's texts in order: ``row`` and ``piece`` of each (pieces end at
    marks and texts), ``code`` its place in ``names``, the batch's distinct words."""

    def __init__(self, texts: pa.Array):
        raw, offsets = joined_bytes(texts)
        kind = _KIND[raw]
        inside = kind == 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[begins] = inside[begins]  # a text's first byte never continues a word
        starts = np.flatnonzero(first)
        self.row = np.searchsorted(offsets, starts, side="right") - 1
        self.piece = np.cumsum(kind == 2)[starts] + self.row
        letters = _LOWER[raw[inside]]
        places = (np.cumsum(inside)[starts] - 1).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(places, len(letters))), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.names = coded.dictionary

    def together(self, n: int) -> np.ndarray:
        """For each word, whether it and the n - 1 that follow stand in one piece."""
        out = np.zeros(len(self.piece), bool)
        if len(out) >= n:
            out[:len(out) - n + 1] = self.piece[:len(out) - n + 1] == self.piece[n - 1:]
        return out


def _languages(langs: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = langs.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _hashes(names: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), np.uint64, len(names))


class Keys:
    """60-bit hashes of the phrases (language and words) that begin at each word."""

    def __init__(self, words: Words, lang: np.ndarray, langs: list[str]):
        self.hash = _hashes(words.names.to_pylist())[words.code] if len(words.code) else np.empty(0, np.uint64)
        self.sum = (_hashes(["lang " + x for x in langs])[lang])[words.row] if len(words.row) else np.empty(0, np.uint64)
        self.n = 0

    def longer(self) -> np.ndarray:
        """Keys of the phrases of one more word (at the end of the batch: of fewer)."""
        rest = len(self.hash) - self.n
        if rest > 0:
            self.sum[:rest] += self.hash[self.n:] * _FACTORS[self.n]
        self.n += 1
        return _mix(self.sum + np.uint64(self.n)) >> np.uint64(4)


def _among(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which keys' places are all set (places as in ``_bitmap``); a key that fails at one is
    not looked up at the next."""
    found = np.arange(len(keys))
    for place in range(PLACES):
        key = keys[found]
        at = ((key & _HALF) + np.uint64(place) * ((key >> np.uint64(30)) | np.uint64(1))) & np.uint64(8 * len(bitmap) - 1)
        found = found[(bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    out = np.zeros(len(keys), bool)
    out[found] = True
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), ROWS):
            yield b.slice(at, ROWS)


def _both_parts(found: np.ndarray) -> np.ndarray:
    """Where a phrase begins whose first and last n words are found: here and one on."""
    return found & np.append(found[1:], False)


def _count_in_shards(batches: Iterator[pa.RecordBatch], length: int, below: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``key, n``: how often a task meets each phrase of ``length`` words both of whose parts
    are in the bitmap ``below``, by shard (the key's last four bits)."""
    held, room = [], HELD

    def counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*parts))
        keys, at = np.unique(keys, return_inverse=True)
        return keys, np.bincount(at, n, len(keys)).astype(np.int64)

    def rows(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1])], names=["key", "n"])

    for b in _slices(batches):
        words = Words(b.column("text"))
        lang, langs = _languages(b.column("lang"))
        keys = Keys(words, lang, langs)
        for _ in range(length - 1):
            shorter = keys.longer()
        here = words.together(length)
        here &= _both_parts(_among(shorter, below) & words.together(length - 1))
        shard = b.column("shard").to_numpy().astype(np.uint64)[words.row[here]]
        part = np.unique((keys.longer()[here] << np.uint64(4)) | shard, return_counts=True)
        held.append(part)
        room -= len(part[0])
        if room < 0:
            held = [counts(held)]
            room = HELD - len(held[0][0])
            if room < HELD // 2:
                yield rows(held[0])
                held, room = [], HELD
    if held:
        yield rows(counts(held))


class _Held:
    """Counts (several to a name) that a task has met."""

    def __init__(self, columns: int):
        self.index: dict = {}
        self.counts = np.zeros((1024, columns), np.int64)

    def add(self, names: list, counts: np.ndarray) -> None:
        at = np.fromiter((self.index.setdefault(x, len(self.index)) for x in names), np.int64, len(names))
        while len(self.index) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.counts[at] += counts

    def batch(self, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
        parts = [pa.array(x, pa.binary() if k == pa.string() else k).cast(k) for x, k in zip(list(zip(*self.index)) or [()] * len(kinds), kinds)]
        counts = [pa.array(c) for c in self.counts[:len(self.index)].T]
        self.__init__(self.counts.shape[1])
        return pa.RecordBatch.from_arrays([*parts, *counts], names=names)


def _count_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """``lang, word, n0, n1, ...``: how often a task meets each word, by shard."""
    held, columns = _Held(shards), ["lang", "word", *[f"n{s}" for s in range(shards)]]
    for b in _slices(batches):
        words = Words(b.column("text"))
        lang, langs = _languages(b.column("lang"))
        size, names = max(1, len(words.names)), words.names.to_pylist()
        found, at = np.unique(lang[words.row] * size + words.code, return_inverse=True)
        shard = b.column("shard").to_numpy()[words.row]
        counts = np.bincount(at * shards + shard, minlength=len(found) * shards).reshape(-1, shards)
        held.add([(langs[x // size].encode(), names[x % size]) for x in found.tolist()], counts)
        if len(held.index) > HELD_TEXTS:
            yield held.batch(columns, [pa.string()] * 2)
    yield held.batch(columns, [pa.string()] * 2)


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums = _hashes(["lang " + x for x in b.column("lang").to_pylist()]) + _hashes(b.column("word").cast(pa.binary()).to_pylist()) * _FACTORS[0]
        yield pa.RecordBatch.from_arrays([pa.array((_mix(sums + np.uint64(1)) >> np.uint64(4)).view(np.int64))], names=["key"])


def _combined(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """One batch, with one row a phrase."""
    table = pa.Table.from_batches(held).group_by(["lang", "phrase", "words"], use_threads=False).aggregate([("a", "sum")])
    return table.select(["lang", "phrase", "words", "a_sum"]).rename_columns(["lang", "phrase", "words", "a"]).combine_chunks().to_batches()


def _count_exactly(batches: Iterator[pa.RecordBatch], bitmaps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``lang, phrase, words, a``: how often a task meets each candidate of two words and more,
    told apart by its words."""
    held, room = [], HELD_TEXTS
    for b in _slices(batches):
        words = Words(b.column("text"))
        lang, langs = _languages(b.column("lang"))
        keys = Keys(words, lang, langs)
        size, names = max(1, len(words.names)), words.names.to_pylist()
        found = _among(keys.longer(), bitmaps[0])
        number = lang[words.row] * size + words.code  # equal for equal phrases of the length so far
        for length in range(2, LONGEST + 1):
            found = words.together(length) & _both_parts(found) & _among(keys.longer(), bitmaps[length - 1])
            at = np.flatnonzero(found)
            if not len(at):
                break
            _, first, same, n = np.unique(number[at] * size + words.code[at + length - 1], return_index=True, return_inverse=True, return_counts=True)
            number[at] = same
            begin = at[first]
            texts = zip(*[[names[c] for c in words.code[begin + step].tolist()] for step in range(length)])
            own = [langs[x] for x in lang[words.row[begin]].tolist()]
            held.append(pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([b" ".join(t) for t in texts], pa.binary()).cast(pa.string()),
                                                    pa.array([length] * len(begin), pa.int32()), pa.array(n)], names=["lang", "phrase", "words", "a"]))
            room -= len(begin)
        if room < 0:
            held = _combined(held)
            room = HELD_TEXTS - sum(map(len, held))
            if room < HELD_TEXTS // 2:
                yield from held
                held, room = [], HELD_TEXTS
    if held:
        yield from _combined(held)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The bitmap of a table of keys."""
    bits = LEAST_BITS
    n = keys.count()
    while bits < MOST_BITS and bits < BITS_A_PHRASE * n:
        bits *= 2
    low, step = F.col("key").bitwiseAND(int(_HALF)), F.shiftrightunsigned("key", 30).bitwiseOR(F.lit(1))
    places = F.array(*[(low + step * place).bitwiseAND(bits - 1) for place in range(PLACES)])
    parts = keys.select(F.explode(places).alias("at")).groupBy((F.shiftright("at", 15)).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND((1 << 15) - 1)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for part, held in parts.collect():  # 4 KB each, at most MOST_BITS in all
        out[part * 4096:(part + 1) * 4096] = np.frombuffer(held, np.uint8)
    return out


def candidates(rows: DataFrame, support: int = SUPPORT, shards: int = SHARDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Steps 1 to 3: the words' counts by shard, and a bitmap for each length of the phrases
    that some shard finds frequent."""
    sc = rows.sparkSession.sparkContext
    by_shard = [f"n{s}" for s in range(shards)]
    words = rows.mapInArrow(lambda batches: _count_words(batches, shards), ", ".join(["lang string", "word string", *[f"{n} long" for n in by_shard]]))
    words = stored(words.groupBy("lang", "word").agg(*[F.sum(n).alias(n) for n in by_shard]), "phrases-words")
    sizes = [n or 0 for n in words.agg(*[F.sum(n) for n in by_shard]).first()]
    # support * share of the words, rounded up; a shard without words has no phrases
    least = [max(1, -(-support * n // max(1, sum(sizes)))) for n in sizes]
    frequent = words.where(reduce(lambda x, y: x | y, [F.col(n) >= m for n, m in zip(by_shard, least)]))
    frequent = frequent.where(reduce(lambda x, y: x + y, [F.greatest(F.col(n), F.lit(m - 1)) for n, m in zip(by_shard, least)]) >= support).select("lang", "word")
    bitmaps = [_bitmap(stored(frequent.mapInArrow(_word_keys, "key long"), "phrases-frequent-1"))]
    shard = F.col("key").bitwiseAND(15)
    lowered = reduce(lambda rest, s: F.when(shard == s, F.lit(least[s])).otherwise(rest), range(shards), F.lit(support))
    elsewhere = sum(m - 1 for m in least)  # most occurrences of a phrase that no shard finds frequent
    for length in range(2, LONGEST + 1):
        below = sc.broadcast(bitmaps[-1])
        counted = rows.mapInArrow(lambda batches, length=length, below=below: _count_in_shards(batches, length, below.value), "key long, n long")
        counted = counted.groupBy("key").agg(F.sum("n").alias("n")).withColumn("more", F.col("n") - (lowered - 1)).where(F.col("more") > 0)
        counted = counted.groupBy(F.shiftrightunsigned("key", 4).alias("key")).agg(F.sum("more").alias("more"))
        counted = counted.where(F.col("more") + elsewhere >= support).select("key")
        bitmaps.append(_bitmap(stored(counted, f"phrases-frequent-{length}")))
    return words.select("lang", "word", reduce(lambda x, y: x + y, [F.col(n) for n in by_shard]).alias("a")), bitmaps


def collocations(docs: DataFrame, support: int = SUPPORT, most: int = MOST, shards: int = SHARDS,
                 doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases."""
    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int")
    rows = pick(docs, doc_id=doc_id, text=text, lang=lang).select("text", F.coalesce("lang", F.lit("und")).alias("lang"), shard.alias("shard"))
    words, bitmaps = candidates(rows, support, shards)
    shared = rows.sparkSession.sparkContext.broadcast(bitmaps)
    # wide tasks, as each passes a phrase on once
    counted = merged_splits(rows, SPLIT_BYTES).mapInArrow(lambda batches: _count_exactly(batches, shared.value), "lang string, phrase string, words int, a long")
    counted = counted.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= support)
    alone = words.where(F.col("a") >= support).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "a")
    counted = stored(counted.unionByName(alone), "phrases-counted")

    sizes = words.groupBy("lang").agg(F.sum("a").alias("n"))
    phrases = counted.where(F.col("words") > 1)
    parts = broadcast_if_small(counted.where(F.col("words") < LONGEST).select("lang", "phrase", "a"))
    listed = phrases.select("lang", "phrase", "a", F.split("phrase", " ", -1).alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = listed.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("head"),
                         F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))).alias("tail"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"]).join(broadcast_if_small(stored(sizes, "phrases-sizes")), "lang")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r", "n")}
    # whole numbers of up to 38 digits; the quotient is a long
    cuts = cuts.withColumn("up", (wide["a"] * wide["n"] * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)")).withColumn("down", (wide["l"] * wide["r"]).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("up div down"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.*")

    # a phrase that a longer one holds as often: then one of one more word does, too
    longer = phrases.where(F.col("words") > 2).select("lang", "a", F.split("phrase", " ", -1).alias("w"))
    inner = longer.select("lang", "a", F.explode(F.array(F.concat_ws(" ", F.slice("w", F.lit(1), F.size("w") - 1)), F.concat_ws(" ", F.slice("w", F.lit(2), F.size("w") - 1)))).alias("phrase"))
    held = inner.groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    scored = scored.join(broadcast_if_small(stored(held, "phrases-inside")), ["lang", "phrase"], "left").where(F.col("inside").isNull() | (F.col("inside") < F.col("a")))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS)))
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
