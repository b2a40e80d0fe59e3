"""Language identification by compression.

One zstandard raw-content dictionary per language is learned from a bounded
sample of labelled documents. A text is encoded once with each dictionary; the
language whose dictionary gives the fewest bytes wins, and the prediction is
rejected (``accepted`` false) when the runner-up is nearly as small.

Each text is normalised before encoding: case-folded, reduced to its letters'
words, each distinct word once, in order of first use, and encoded in blocks of
``BLOCK_BYTES``. All words of the whole text take part. (Encoding the lower-case text
as it stands was measured too: it names fewer held-out languages rightly.)

Defined results for edge cases
* null text, empty text or text without any letter (of a Unicode letter category, so
  digits, fractions and Roman numeral signs are none): ``und``, score 0, rejected;
* null ``doc_id``: predicted like any other row, never learned from;
* null ``lang``: predicted, never learned from;
* ties between languages: the alphabetically first language, rejected;
* no labelled row at all: every row ``und``;
* repeated rows: each gets its own (equal) result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyman.llm.common import held_out, pick

#: Bounds of the learned dictionaries: sampled documents a language and bytes
#: kept of each sample, so one dictionary holds at most 256 KB; words that a
#: sample takes together from one place of its text.
SAMPLE_DOCS = 512
SAMPLE_BYTES = 512
WINDOW_WORDS = 8
#: zstandard level, and bytes encoded at a time (a dictionary fades as a window fills).
LEVEL = 3
BLOCK_BYTES = 4096
#: A prediction is accepted when the runner-up needs at least this share more bytes.
MARGIN = 0.02

_WORD = re.compile(r"[^\W\d_]+")
_HASH_RANGE = 1 << 20


def normalise(text: str) -> bytes:
    """The distinct words; nothing where the text has no letter."""
    return " ".join(dict.fromkeys(_WORD.findall(text.lower()))).encode("utf-8", "replace") if any(map(str.isalpha, text)) else b""


def sampled(text: str, most: int) -> bytes:
    """At most ``most`` bytes of a text's distinct words, from windows of ``WINDOW_WORDS``
    words all over the text, in the order of a hash of their place and the text's length."""
    words = _WORD.findall(text.lower())
    starts = range(0, len(words), WINDOW_WORDS)
    taken: dict[str, int] = {}
    size = -1
    for at in sorted(starts, key=lambda k: (zlib.crc32(b"%d %d" % (k, len(words))), k)):
        for place, word in enumerate(words[at:at + WINDOW_WORDS], at):
            if word not in taken:
                size += 1 + len(word.encode("utf-8", "replace"))
                if size > most and taken:
                    break
                taken[word] = place
        if size >= most:
            break
    return " ".join(sorted(taken, key=taken.__getitem__)).encode("utf-8", "replace")[:most]


def learn_dictionaries(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Language → dictionary content, from ``sample_docs`` labelled ids of each language
    (all, where there are fewer) that are not held out, one text each.

    Ids are chosen by their hash, first below a per-language threshold, so no sort or
    shuffle of texts is needed; what reaches the driver is bounded by languages ×
    ``sample_docs`` × ``sample_bytes``, however often an id or a row is repeated."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(_HASH_RANGE))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect()}
    if not counts:
        return {}
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & (h < max(1, math.ceil(_HASH_RANGE * min(1.0, 1.5 * sample_docs / max(n, 1))))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.to_pydict()
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array(c["lang"], pa.string()),
                "key": pa.array(c["key"], pa.int64()),
                "part": pa.array([sampled(t, sample_bytes) for t in c["text"]], pa.binary()),
            })

    picked = rows.where(chosen).select("lang", "doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    ids = picked.groupBy("lang", "doc_id").agg(F.min("key").alias("key"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = ids.withColumn("place", place).where(F.col("place") <= sample_docs).select("lang", "doc_id", "key")
    picked = picked.join(F.broadcast(ids), ["lang", "doc_id", "key"]).select("lang", "key", "text")  # a few ids a language
    parts = picked.mapInArrow(cut, "lang string, key long, part binary").groupBy("lang", "key").agg(F.min("part").alias("part")).collect()
    out: dict[str, bytes] = {}
    for lang in sorted(counts):
        mine = sorted((r.key, bytes(r.part)) for r in parts if r.lang == lang)
        out[lang] = b" ".join(p for _, p in mine)
    return out


def classify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = LEVEL, block_bytes: int = BLOCK_BYTES,
             margin: float = MARGIN) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted, encoded_bytes`` for each row.
    ``score`` is the winner's share of the likelihood that the encoded sizes imply."""
    langs = sorted(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coders = []
        for name in langs:
            d = zstandard.ZstdCompressionDict(dictionaries[name] or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            coders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        for b in batches:
            pred, score, sure, size = [], [], [], []
            for text in b.column("text").to_pylist():
                words = normalise(text) if text else b""
                if not words or not langs:
                    pred.append("und"), score.append(0.0), sure.append(False), size.append(0)
                    continue
                sizes = [sum(len(c.compress(words[i:i + block_bytes])) for i in range(0, len(words), block_bytes)) for c in coders]
                best = min(range(len(langs)), key=sizes.__getitem__)
                rest = [s for k, s in enumerate(sizes) if k != best]
                pred.append(langs[best])
                # a byte is 8 bits of evidence; damped, as blocks are not independent
                score.append(1.0 / sum(math.exp(-min(50.0, (s - sizes[best]) * 0.25)) for s in sizes))
                sure.append(not rest or min(rest) > sizes[best] * (1 + margin))
                size.append(sizes[best])
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                pa.array(sure, pa.bool_()), pa.array(size, pa.int64())],
                names=["doc_id", "held_out", "lang_pred", "score", "accepted", "encoded_bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean, encoded_bytes long")


def identify_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **params) -> DataFrame:
    """Learn from the labelled, not held-out rows of ``docs`` and classify all of them."""
    rows = pick(docs, doc_id=doc_id, text=text, lang=lang)
    return classify(rows, learn_dictionaries(rows), **params)
