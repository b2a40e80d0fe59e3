"""The pipeline's stages: decisions take effect, columns stay, clean documents stay."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from test_operators import EDGE, brute_components, near_rows, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)


def stage(name):
    return dict(pipeline.STAGES)[name]


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "ngram_join", "secrets", "packing"]


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    rows = near_rows()[:150] + [r for r in EDGE if r[0] != 6]
    out = stage("ngram_join")(spark, table(spark, rows), "").collect()
    groups = {c for _, _, c in brute_components(rows) if c >= 0}
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted(groups)
    assert sum(r.doc_id is None for r in out) == 1
    assert list(out[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_secret_stage_masks_and_keeps_columns(spark):
    r = random.Random(1)
    key = "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789abcdefghijkmnpqrstuvwxyz") for _ in range(44))
    rows = [(1, f"é password=abcdefabcdef123456 end {key}", "en", "s"), (2, None, None, None), (3, "clean text", "de", "t")]
    rows += [(10 + i, " ".join(words(100, i)), "en", "a") for i in range(30)]
    out = {r.doc_id: r for r in stage("secrets")(spark, table(spark, rows), "").collect()}
    assert out[1].text == "é [SECRET] end [SECRET]" and out[1].n_chars == len(out[1].text) and out[1].source == "s"
    assert out[2].text is None and out[3].text == "clean text"
    assert all(out[10 + i].text == rows[3 + i][1] for i in range(30))


@pytest.fixture(scope="module")
def whole(spark):
    return pipeline.run(spark, "/root/testdata/sf0.001")


def test_run_packs_what_the_stages_keep(spark, whole):
    rows = whole.orderBy("sequence_id", "offset").collect()
    at = 0
    for r in rows:
        assert r.sequence_id * 1024 + r.offset == at
        at += r.length
    assert {f.name for f in whole.schema} == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_quality_stage_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = stage("quality")(spark, docs, sf)
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet").dropDuplicates(["doc_id"])
    got = {(r.quality, r.stays) for r in labels.join(kept.select("doc_id").distinct().withColumn("stays", F.lit(1)), "doc_id", "left").select("quality", F.coalesce("stays", F.lit(0)).alias("stays")).collect()}
    share = lambda q: np.mean([r.stays for r in labels.where(F.col("quality") == q).join(kept.select("doc_id").distinct().withColumn("stays", F.lit(1)), "doc_id", "left")
                               .select(F.coalesce("stays", F.lit(0)).alias("stays")).collect()])
    assert got and share(1) > 0.98 and share(0) < 0.2
    assert public_tokenizers.PATTERN
