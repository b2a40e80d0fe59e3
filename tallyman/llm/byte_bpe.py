"""Byte-level BPE encoding and decoding.

Texts are split into words by the tokenizer's pattern. Each stream of documents
encodes a distinct word once: Spark's higher-order functions fold the ranked
merges over the word's bytes, looking ranks up in literal arrays. Documents travel
as the codes of their words and get their ids from the folded words.

The stages of one task form a stream without any shuffle:

1. ``regexp_extract_all`` splits each text;
2. a first Arrow pass numbers the distinct words of the stream; a row with new
   words, as byte arrays, goes out before the first document that uses them;
3. a projection folds the merges over each new word (documents pass by);
4. a second Arrow pass keeps the folded words' ids and writes each document's ids.

The numbering starts anew after ``MAX_WORDS`` words or ``MAX_WORD_BYTES`` bytes of
them, which bounds the memory of both passes; words and ids lie in arrays that grow,
some 50 bytes a word. A lost task repeats its own stream and needs nothing of another's.
Each pass holds an Arrow batch besides, in Spark's process and in Python's: a session of
``common.small_batches`` keeps these to a few MB, whatever the length of the texts.

A word that is a token as a whole is one piece from the start, as in the tiktoken
library. The fold is quadratic in the word; words above ``LONG_WORD`` bytes (runs of
symbols or blanks) take the same merges from a heap instead.

Defined results for edge cases
* null or empty text: no ids, empty decoded bytes; null ``doc_id`` is kept;
* texts with characters newer than the JVM's Unicode tables are split by the
  ``regex`` library, whose tables the pattern is meant for;
* repeated rows: one result each; an empty table: no rows; extra columns are ignored;
* ids outside the vocabulary cannot be decoded and fail the task.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyman.llm.common import joined_bytes, merged_splits, pick

#: Stands between the words of a text on their way to Python; texts that hold it are split there.
SEPARATOR = "\x1f"
LONG_WORD = 96
MAX_WORDS = 1 << 21
MAX_WORD_BYTES = 64 << 20
#: Documents that are numbered together.
SLICE = 200
#: Words a row hands to the fold, and bytes of input a task should see at least.
WORDS_A_ROW = 20_000
SPLIT_BYTES = 64 << 20
#: Codes or ids, in bytes, that become ids or texts together; and what a batch between Spark and Python should hold.
STEP_BYTES = 512 << 10
BATCH_BYTES = 4 << 20
#: Cells of a pair table that a row is tried at together.
STRETCH = 1024


def read_ranks(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PairTable:
    """The rank of every mergeable pair of pieces, as two literal arrays.

    A piece is known by its rank (its id). The first array gives a left piece its offset, the
    second holds a pair's rank at offset + right piece, together with the left piece, which
    tells it from other pairs around: the rows of a sparse matrix are pushed into each other's
    gaps. So a look-up reads two array elements, however many pairs there are."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bits = max(ranks.values()).bit_length()
        self.none = 1 << self.bits  # above every rank: the pair cannot merge
        rows: dict[int, dict[int, int]] = {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
                if left is not None and right is not None:
                    rows.setdefault(left, {})[right] = rank
        self.tables = self._placed(rows)

    def _placed(self, rows: dict[int, dict[int, int]]) -> tuple[list[int | None], list[int]]:
        offsets: list[int | None] = [None] * self.none
        cells = np.full(self.none + 2 * sum(map(len, rows.values())) + 2 * STRETCH, -1, np.int64)
        start, free = 0, np.empty(0, np.int64)
        for left in sorted(rows, key=lambda x: (-len(rows[x]), x)):  # full rows first
            right = np.array(sorted(rows[left]))
            gaps = right - right[0]
            if len(right) == 1:  # any free cell
                if not len(free):
                    cells = np.concatenate([cells, np.full(2 * STRETCH, -1, np.int64)])
                    free = np.flatnonzero(cells < 0)
                at, free = free[0], free[1:]
            else:
                while True:  # a stretch of cells for its first element after the other
                    if start + STRETCH + gaps[-1] >= len(cells):
                        cells = np.concatenate([cells, np.full(len(cells), -1, np.int64)])
                    firsts = start + np.flatnonzero(cells[start:start + STRETCH] < 0)
                    fitting = firsts[(cells[firsts[:, None] + gaps] < 0).all(axis=1)]
                    if len(fitting):
                        break
                    start += STRETCH // 4
                at = fitting[0]
            offsets[left] = int(at - right[0])  # below 0 at times
            cells[at + gaps] = (left << self.bits) | np.array([rows[left][r] for r in right.tolist()])
        return offsets, cells[:int(np.flatnonzero(cells >= 0).max(initial=0)) + 1].tolist()

    def literal(self) -> Column:
        """Both arrays, as a constant that the optimizer parses once."""
        return F.from_json(F.lit(json.dumps(self.tables, separators=(",", ":"))), "array<array<bigint>>")

    def bound(self, f) -> Column:
        """``f(tables)`` with both arrays as variables."""
        return _with(self.literal(), lambda both: _with(F.get(both, F.lit(0)), lambda offsets: _with(F.get(both, F.lit(1)), lambda cells: f((offsets, cells)))))

    def rank(self, tables: tuple[Column, Column], left: Column, right: Column) -> Column:
        """``none`` for a pair that cannot merge, or without a right piece."""
        offsets, cells = tables
        entry = F.get(cells, F.get(offsets, left) + right)
        return F.when(F.shiftright(entry, self.bits) == left, entry.bitwiseAND(self.none - 1)).otherwise(F.lit(self.none).cast("long"))


def _with(value: Column, f) -> Column:
    """``f(value)`` with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def fold_merges(pairs: PairTable, tables: tuple[Column, Column], pieces: Column) -> Column:
    """The ids of one word: its pieces (ids of its bytes), merged pair by pair in the order of rank.

    The state is one array of integers, an element for each piece: the rank of the
    pair it begins, its offset in the word, and its id, from the highest bits down. The
    smallest element is therefore the next merge, leftmost first among equal ranks,
    and a merge replaces the elements around it."""
    n, bits, none = F.size(pieces), pairs.bits, pairs.none
    places = (LONG_WORD + 2).bit_length()
    id_of = lambda e: e.bitwiseAND(none - 1)
    rank_of = lambda e: F.shiftright(e, bits + places)
    unmergeable = none << (bits + places)

    def element(rank: Column, rest: Column) -> Column:
        """A rank above the offset and id of ``rest``."""
        return F.shiftleft(rank, bits + places).bitwiseOR(rest.bitwiseAND((1 << (bits + places)) - 1))

    def merge_all(codes: Column) -> Column:
        first = F.transform(codes, lambda c, j: F.when(j + 1 < n, _with(F.get(codes, j + 1), lambda d: element(pairs.rank(tables, c, d), F.shiftleft(j.cast("long"), bits).bitwiseOR(c))))
                            .otherwise(F.shiftleft(j.cast("long"), bits).bitwiseOR(c).bitwiseOR(F.lit(unmergeable))))

        def step(state: Column, _: Column) -> Column:
            def merge(i: Column, low: Column) -> Column:  # elements i and i + 1 (from 0) become one with the rank's id
                new = rank_of(low)

                def around(left: Column, right: Column) -> Column:
                    here = low.bitwiseAND(((1 << places) - 1) << bits).bitwiseOR(new)  # its offset and id
                    begun = F.shiftleft(pairs.rank(tables, new, id_of(right)), bits + places).bitwiseOR(here)
                    return F.when(i > 0, F.flatten(F.array(F.slice(state, F.lit(1), i - 1), F.array(element(pairs.rank(tables, id_of(left), new), left), begun), F.slice(state, i + 3, n)))
                                  ).otherwise(F.flatten(F.array(F.array(begun), F.slice(state, F.lit(3), n))))

                return around(F.get(state, i - 1), F.get(state, i + 2))

            lowest = F.array_min(state)
            return _with(lowest, lambda low: F.when(low < unmergeable, _with((F.array_position(state, low) - 1).cast("int"), lambda i: merge(i, low))).otherwise(state))

        return F.aggregate(F.slice(codes, F.lit(2), n), first, step, lambda s: F.transform(s, lambda e: id_of(e).cast("int")))

    return _with(F.transform(pieces, lambda c: c.cast("long")), merge_all)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word: linked pieces and a heap of candidate pairs."""
    n = len(word)
    end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def candidate(a: int) -> tuple[int, int, int] | None:
        b = nxt[a]
        rank = ranks.get(word[a:end[b]]) if b < n else None
        return None if rank is None else (rank, a, end[b])

    heap = [c for c in map(candidate, range(n)) if c]
    heapq.heapify(heap)
    while heap:
        _, a, stop = heapq.heappop(heap)
        if not alive[a] or nxt[a] >= n or end[nxt[a]] != stop:
            continue  # one of its pieces has merged since
        b = nxt[a]
        alive[b], end[a], nxt[a] = False, stop, nxt[b]
        if nxt[b] < n:
            prev[nxt[b]] = a
        for c in (candidate(a), candidate(prev[a]) if prev[a] >= 0 else None):
            if c:
                heapq.heappush(heap, c)
    return [ranks[word[a:end[a]]] for a in range(n) if alive[a]]


def _blobs(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over one buffer: value i is data[offsets[i]:offsets[i + 1]]."""
    width = data.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype("<i4").tobytes()), pa.py_buffer(np.ascontiguousarray(data))])


def _gather(table: np.ndarray, starts: np.ndarray, counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table's stretches ``which`` one after another, and where each ends."""
    n = counts[which]
    ends = np.cumsum(n)
    at = np.repeat(starts[which] - (ends - n), n)
    at += np.arange(len(at))
    return table[at], ends


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows (from, to) of ``most`` bytes together; a larger row stands alone."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield at, stop
        at = stop


def _grown(values: np.ndarray, n: int) -> np.ndarray:
    """The same values with room for ``n``."""
    if n <= len(values):
        return values
    out = np.empty(max(n, 2 * len(values)), values.dtype)
    out[:len(values)] = values
    return out


class WordNumbers:
    """Numbers distinct words from 0 in the order they come.

    A hash table in arrays: ``slots`` holds a word's number at the first free place from its
    hash on. Equal hashes are told apart by the words themselves."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.slots = np.full(1 << 10, -1, np.int32)
        self.hashes, self.ends, self.data = np.empty(1 << 9, np.int64), np.zeros(1 << 9, np.int64), np.empty(1 << 12, np.uint8)

    @property
    def n_bytes(self) -> int:
        return int(self.ends[self.n])

    def number(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The numbers of ``words`` (distinct, ``large_binary``); a word not met before gets the next one."""
        if 2 * (self.n + len(words)) > len(self.slots):
            self.slots = np.full(1 << (2 * (self.n + len(words))).bit_length(), -1, np.int32)
            self._place(np.arange(self.n, dtype=np.int32))
        numbers, at = np.full(len(words), -1, np.int32), hashes & (len(self.slots) - 1)
        stored = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(self.ends), pa.py_buffer(self.data)])
        todo = np.arange(len(words))
        while len(todo):
            held = self.slots[at[todo]]
            todo, held = todo[held >= 0], held[held >= 0]
            like = np.flatnonzero(self.hashes[held] == hashes[todo])
            same = like[pc.equal(words.take(pa.array(todo[like])), stored.take(pa.array(held[like]))).to_numpy(zero_copy_only=False)]
            numbers[todo[same]] = held[same]
            todo = np.delete(todo, same)
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            raw, offsets = joined_bytes(words.take(pa.array(new)))
            start, stop, first = self.n, self.n + len(new), self.n_bytes
            self.hashes, self.ends, self.data = _grown(self.hashes, stop), _grown(self.ends, stop + 1), _grown(self.data, first + len(raw))
            self.hashes[start:stop], self.ends[start:stop + 1], self.data[first:first + len(raw)] = hashes[new], first + offsets, raw
            numbers[new] = np.arange(start, stop)
            self.n = stop
            self._place(numbers[new])
        return numbers

    def _place(self, numbers: np.ndarray) -> None:
        at = self.hashes[numbers] & (len(self.slots) - 1)
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            left = self.slots[at] != numbers  # the place was taken, or went to another of them
            numbers, at = numbers[left], (at[left] + 1) & (len(self.slots) - 1)


def _number_words(rank_file: str, pattern: str, max_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, known, ranks = regex.compile(pattern), WordNumbers(), read_ranks(rank_file)
        of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        kind = pa.list_(pa.list_(pa.int32()))
        schema = pa.schema([("doc_id", pa.int64()), ("is_doc", pa.bool_()), ("codes", pa.binary()), ("first_code", pa.int64()), ("words", kind), ("long_words", pa.list_(pa.binary()))])

        def word_rows(first: int, new: pa.Array) -> pa.RecordBatch:
            raw, offsets = joined_bytes(new)
            sizes, token = np.diff(offsets), np.fromiter((ranks.get(w, -1) for w in new.to_pylist()), np.int32, len(new))
            long, whole = sizes > LONG_WORD, (sizes <= LONG_WORD) & (token >= 0)
            kept = np.repeat(~long & ~whole, sizes)
            pieces = of_byte[raw]
            kept[offsets[:-1][whole]], pieces[offsets[:-1][whole]] = True, token[whole]  # a token as a whole: one piece
            ends = np.cumsum(np.where(long, 0, np.where(whole, 1, sizes)))
            rows = np.array([*range(0, len(new), WORDS_A_ROW), len(new)], np.int32)
            words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(pieces[kept]), mask=pa.array(long))
            longs = new.filter(pa.array(long)).cast(pa.binary())
            n = len(rows) - 1
            return pa.RecordBatch.from_arrays([
                pa.nulls(n, pa.int64()), pa.array([False] * n), pa.nulls(n, pa.binary()), pa.array(first + rows[:-1], pa.int64()),
                pa.ListArray.from_arrays(pa.array(rows), words), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(long)])[rows], pa.int32()), longs)], schema=schema)

        for batch in batches:
            for at in range(0, len(batch), SLICE):
                b = batch.slice(at, SLICE)
                joined = b.column("joined")
                if joined.null_count:  # some texts come whole
                    words = pa.array([split.findall(t) if j is None else j.split(SEPARATOR) if j else [] for j, t in zip(joined.to_pylist(), b.column("whole").to_pylist())], pa.list_(pa.string()))
                    lengths, coded = words.value_lengths().to_numpy(zero_copy_only=False), words.flatten().dictionary_encode()
                else:
                    words = pc.split_pattern(joined, SEPARATOR)
                    lengths = np.where(pc.equal(joined, "").to_numpy(zero_copy_only=False), 0, words.value_lengths().to_numpy(zero_copy_only=False))
                    coded = words.flatten().dictionary_encode()
                names, at_name = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
                texts = names.to_pylist()
                if "" in texts:  # of an empty text
                    at_name = at_name[at_name != texts.index("")]
                hashes = np.fromiter(map(hash, texts), np.int64, len(texts))
                names = names.cast(pa.large_binary())
                if known.n + len(names) > max_words or known.n_bytes > MAX_WORD_BYTES:
                    known.clear()
                first = known.n
                codes = known.number(names, hashes)
                new = np.flatnonzero(codes >= first)
                pa.default_memory_pool().release_unused()  # a worker's memory would keep growing
                if len(new):
                    yield word_rows(first, names.take(pa.array(new)))
                flat = codes[at_name] if len(names) else np.empty(0, np.int32)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id"), pa.array([True] * len(b)), _blobs(flat.astype("<i4"), offsets),
                    pa.nulls(len(b), pa.int64()), pa.nulls(len(b), kind), pa.nulls(len(b), pa.list_(pa.binary()))], schema=schema)
        known.clear()
        pa.default_memory_pool().release_unused()  # Spark's workers go on to other tasks

    return run, "doc_id long, is_doc boolean, codes binary, first_code long, words array<array<int>>, long_words array<binary>"


def _write_ids(rank_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks: dict[bytes, int] = {}
        # the ids of all words so far, one word after another, and where each begins
        table, starts, n_words = np.empty(1 << 10, np.int32), np.zeros(1 << 10, np.int64), 0
        names = ["doc_id", "n_tokens", "ids"]
        for b in batches:
            is_doc = b.column("is_doc").to_numpy(zero_copy_only=False)
            docs, held = [], 0

            def written() -> pa.RecordBatch:
                each = [np.frombuffer(b.column("codes")[i].as_buffer(), "<i4") for i in docs]
                ids, ends = _gather(table, starts, np.diff(starts[:n_words + 1]), np.concatenate(each))
                stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(c) for c in each])])]
                return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(docs)), pa.array(np.diff(stops), pa.int64()), _blobs(ids.astype("<u4"), stops)], names=names)

            for i in range(len(b)):
                if is_doc[i]:
                    docs.append(i)
                    held += b.column("codes")[i].as_buffer().size
                    if held >= STEP_BYTES:
                        yield written()
                        docs, held = [], 0
                    continue
                if docs:
                    yield written()
                    docs, held = [], 0
                got = b.column("ids")[i].values
                if b.column("first_code")[i].as_py() == 0:
                    n_words = 0
                if got.null_count:
                    ranks = ranks or read_ranks(rank_file)
                    rest = iter(b.column("long_words")[i].as_py())
                    got = pa.array([merge_long(next(rest), ranks) if g is None else g for g in got.to_pylist()], pa.list_(pa.int32()))
                ids, first, stop = got.flatten().to_numpy(zero_copy_only=False), int(starts[n_words]), n_words + len(got)
                table, starts = _grown(table, first + len(ids)), _grown(starts, stop + 1)
                table[first:first + len(ids)] = ids
                starts[n_words + 1:stop + 1] = first + np.cumsum(got.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
                n_words = stop
            if docs:
                yield written()
        pa.default_memory_pool().release_unused()  # Spark's workers go on to other tasks

    return run, "doc_id long, n_tokens long, ids binary"


def encode(docs: DataFrame, rank_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """``doc_id, n_tokens, ids`` of each row; ``ids`` are little-endian unsigned 32-bit integers."""
    rows = merged_splits(pick(docs, doc_id=doc_id, text=text), SPLIT_BYTES)
    text_ = F.coalesce("text", F.lit(""))
    # characters not assigned in the JVM's Unicode version, or the separator itself
    odd = text_.rlike(r"[\p{Cn}\x1f]")
    words = F.regexp_extract_all(text_, F.lit("(?U)" + pattern), F.lit(0))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(~odd, F.array_join(words, SEPARATOR)).alias("joined"), F.when(odd, text_).alias("whole"))
    numbered = rows.mapInArrow(*_number_words(rank_file, pattern, max_words))
    pairs = PairTable(read_ranks(rank_file))
    ids = pairs.bound(lambda tables: F.transform("words", lambda w: F.when(w.isNotNull(), fold_merges(pairs, tables, w))))
    folded = numbered.select("doc_id", "is_doc", "codes", "first_code", ids.alias("ids"), "long_words")
    return folded.mapInArrow(*_write_ids(rank_file))


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """``encoded`` with ``decoded``: its ids' byte pieces, one after another."""
    ranks = read_ranks(rank_file)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    table, counts = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(counts) - counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop in _runs(pc.binary_length(batch.column("ids")).to_numpy(zero_copy_only=False), STEP_BYTES):
                b = batch.slice(at, stop - at)
                each = [np.frombuffer(x.as_buffer(), "<u4") for x in b.column("ids")]
                data, ends = _gather(table, starts, counts, np.concatenate(each))
                stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(x) for x in each])])]
                yield pa.RecordBatch.from_arrays([*b.columns, _blobs(data, stops)], names=[*b.schema.names, "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
