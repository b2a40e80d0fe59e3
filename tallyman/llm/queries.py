"""The registered queries of the training-data operators, one per operator,
each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyman.llm import (byte_bpe, collocations, compression_bands, fingerprints, html_text, language_id, lexical_search, line_dedup,
                          ngram_join, packing, quality, secrets, topk)
from tallyman.llm.common import read, small_batches

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read(small_batches(spark, byte_bpe.BATCH_BYTES), sf_dir, "documents")
    encoded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, ranks)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secrets.rendered(F.col("base")), 256).alias("base_sha256"), secrets.rendered(F.col("spans")).alias("spans"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_versions(read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(read(spark, sf_dir, "documents"))


def op11_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands.compression_rules(read(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_packing": op3_packing,
    "op4_ngram_join": op4_ngram_join,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_topk": op7_topk,
    "op8_html_text": op8_html_text,
    "op9_fingerprints": op9_fingerprints,
    "op10_language_id": op10_language_id,
    "op11_compression_bands": op11_compression_bands,
    "op12_lexical_search": op12_lexical_search,
    "op13_collocations": op13_collocations,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op2_line_dedup": """
WITH docs AS (SELECT doc_id, text, coalesce(source, '') AS site, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, site, parts, unnest(range(len(parts))) AS pos FROM docs),
named AS (SELECT doc_id, site, pos, trim(parts[pos + 1]) AS line FROM lines),
bad AS (
  SELECT line, min({'doc_id': doc_id, 'pos': pos}) AS first_at FROM named
  WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 8),
gone AS (
  SELECT n.doc_id, list(n.pos) AS positions FROM named n JOIN bad b ON n.line = b.line
  WHERE {'doc_id': n.doc_id, 'pos': n.pos} <> b.first_at GROUP BY n.doc_id),
cleaned AS (
  SELECT d.doc_id, len(d.parts) AS n_lines, coalesce(len(g.positions), 0) AS n_removed,
         CASE WHEN g.positions IS NULL THEN d.text ELSE array_to_string(
           list_transform(list_filter(range(len(d.parts)), lambda i: NOT list_contains(g.positions, i)), lambda i: d.parts[i + 1]), chr(10)) END AS text
  FROM docs d LEFT JOIN gone g USING (doc_id))
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed,
       CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM cleaned
""",
    "op7_topk": """
WITH part AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM part q JOIN part x ON x.vec_id <> q.vec_id AND len(x.v) = len(q.v)
  WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op12_lexical_search": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms,
         row_number() OVER () AS row FROM documents),
found AS (SELECT row, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM found),
tf AS (
  SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, unnest(terms) AS term FROM found) GROUP BY row, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
items AS (
  SELECT item_id, row_number() OVER () AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM items) GROUP BY ALL),
scored AS (
  SELECT a.item, a.item_id, s.row, s.doc_id,
         CAST(sum(a.times * CAST(floor(1000 * ln((2 * w.n_docs + 2) / (2 * df.df + 1))) AS BIGINT)
                  * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (100 - 25 + ((25 * s.n * w.n_docs) // w.n_terms))))) AS BIGINT) AS score
  FROM asked a JOIN df USING (term) JOIN tf t USING (term) JOIN found s ON s.row = t.row, whole w GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(words)) AS HUGEINT) AS n FROM listed GROUP BY lang),
grams AS (
  SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i
  FROM listed, (VALUES (1), (2), (3), (4), (5)) t(k) WHERE len(words) >= k),
counted AS (
  SELECT lang, words[i:i + k - 1] AS words, k, CAST(count(*) AS HUGEINT) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.words, c.k, c.a, l.a AS l, r.a AS r, s.n, cut, (1000 * c.a * s.n) // (l.a * r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM counted WHERE k > 1) c
  JOIN counted l ON l.lang = c.lang AND l.words = c.words[:cut] JOIN counted r ON r.lang = c.lang AND r.words = c.words[cut + 1:]
  JOIN sizes s ON s.lang = c.lang),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, words[f:f + size - 1] AS words, max(a) AS a
  FROM (SELECT lang, words, a, k, size, unnest(range(1, k - size + 2)) AS f FROM counted, (VALUES (2), (3), (4)) t(size) WHERE size < k) GROUP BY ALL),
kept AS (SELECT w.* FROM worst w LEFT JOIN inner_parts p ON p.lang = w.lang AND p.words = w.words WHERE p.a IS NULL OR 100 * p.a < 100 * w.a),
ranked AS (SELECT *, array_to_string(words, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
""",
}
