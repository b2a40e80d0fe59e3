"""Quality rules: compression bands.

Text that says little compresses much (repetition), and text that is no text hardly
compresses (random characters). A document's zstandard ratio, bytes in by bytes out,
must lie in the band of its length (short texts compress less, as a frame has its own
cost and little to refer to), and so must those of its chunks of ``CHUNK`` bytes, but
for a share of at most ``BAD_CHUNKS`` percent, so that one table or one repeated
passage in a long text doesn't decide about all of it.

Before the bands come base counts on words ``[^\\x20\\x09-\\x0D]+``: ``n_words``,
``word_chars``, ``n_symbols``, ``n_dup_lines`` (lines with a word that equal an earlier
line) and ``n_repeat_words`` (words inside three-word windows that the text has at least
twice). Documents of too few words, or mostly of repeated windows, fail them.

Each row is judged alone, in one Arrow pass without a shuffle.

Defined results for edge cases
* a null, empty or blank text has no words and no ratio, and fails the base rules;
* a null ``doc_id`` is kept as it is; repeated rows give one result each;
* very long texts are read whole; memory is a small multiple of one text;
* an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.llm.common import pick

#: Words of a repeated window; fewest words and most repeated words (percent) of a document.
WINDOW, LEAST_WORDS, MOST_REPEATED = 3, 50, 50
#: Compression level; bytes of a chunk; percent of chunks that may lie outside their band.
LEVEL, CHUNK, BAD_CHUNKS = 3, 4096, 25
#: Band of a whole text by its length: up to so many bytes, least and most ratio. Prose of
#: Latin script has 0.9 at 64 bytes, 1.7 at 1 KB, 2.1 at 4 KB and 2.5 to 3 beyond 64 KB;
#: base64 stays near 1.3 and random bytes near 1 at any length.
BANDS = [(64, 0.4, 2.0), (128, 0.7, 2.4), (256, 0.9, 2.8), (512, 1.1, 3.2), (1024, 1.2, 3.4), (2048, 1.3, 3.6),
         (4096, 1.4, 3.8), (16_384, 1.45, 4.2), (65_536, 1.5, 4.8), (None, 1.5, 5.5)]
#: Band of a chunk.
CHUNK_BAND = (1.4, 4.2)

_BLANKS, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
_NOT_COUNTED = _BLANKS + bytes(range(0x80, 0xC0))  # blanks, and all but the first byte of a character

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, ratio double, n_chunks int, n_bad_chunks int, kept boolean")


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three that occurs at least twice."""
    if len(words) <= WINDOW:
        return 0
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    window = ids
    for step in range(1, WINDOW):  # numbers of ever longer windows, equal where the words are
        _, window = np.unique(window[:-1] * len(index) + ids[step:], return_inverse=True)
    many = np.bincount(window)[window] > 1
    inside = np.zeros(len(ids), bool)
    for step in range(WINDOW):
        inside[step:step + len(many)] |= many
    return int(inside.sum())


def repeated_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def chunks(raw: bytes) -> list[bytes]:
    """Pieces of ``CHUNK`` bytes; a rest of less than half a chunk joins the one before."""
    n = max(1, (len(raw) + CHUNK // 2) // CHUNK)
    return [raw[i * CHUNK:(i + 1) * CHUNK if i < n - 1 else len(raw)] for i in range(n)]


def band(length: int) -> tuple[float, float]:
    return next((least, most) for up_to, least, most in BANDS if up_to is None or length <= up_to)


def judged(raw: bytes, compressor) -> tuple[float | None, int, int, bool]:
    """Ratio of the text, its chunks, those outside their band, and the verdict."""
    if not raw:
        return None, 0, 0, False
    ratio = len(raw) / len(compressor.compress(raw))
    least, most = band(len(raw))
    parts = chunks(raw) if len(raw) > CHUNK else []
    bad = sum(not CHUNK_BAND[0] <= len(p) / len(compressor.compress(p)) <= CHUNK_BAND[1] for p in parts)
    return ratio, len(parts), bad, least <= ratio <= most and 100 * bad <= BAD_CHUNKS * len(parts)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    compressor = zstandard.ZstdCompressor(level=LEVEL)
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
    for b in batches:
        rows = []
        for text in b.column("text").cast(pa.binary()):
            raw = text.as_py() or b""
            words = raw.split()  # bytes split at ASCII blanks only
            repeated = repeated_words(words)
            failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
            ratio, n, bad, fine = judged(raw, compressor)
            rows.append((len(words), len(raw.translate(None, _NOT_COUNTED)), len(raw) - len(raw.translate(None, _SYMBOLS)),
                         repeated_lines(raw), repeated, failed, ratio, n, bad, fine and not failed))
        columns = list(zip(*rows)) or [()] * (len(names) - 1)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds[1:])]], names=names)


def compression_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts, compression ratios and the verdict ``kept`` of every row."""
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_measure, SCHEMA)
