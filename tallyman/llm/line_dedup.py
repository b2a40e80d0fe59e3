"""Line dedup by the spread of a line over sites.

A line on at least ``MIN_SITES`` different sites is boilerplate: it stays where it
first occurs (smallest document id, then position) and goes everywhere else.

1. one aggregation by line hash merges a HyperLogLog sketch of the sites and finds
   the first occurrence; sketches merge on the map side, so a line that every
   document has sends one row per task;
2. lines whose estimate lies clearly above the threshold are boilerplate; lines
   near it get an exact distinct count; the table of boilerplate is written;
3. the lines are matched with that table, which gives each document the positions
   to drop, and documents are rebuilt from what is left.

Everything is DataFrame operations; no join is forced to broadcast: the written
table tells Spark its size.

Lines are compared by two 64-bit hashes of their text without blanks at the ends.

Defined results for edge cases
* blank lines stay; a null text stays null (no lines); an empty text stays empty;
* a null site is the site with the empty name;
* rows with equal id and text are one document: what stays in one stays in all;
* a null ``doc_id`` comes before all others;
* a document all of whose lines go keeps its row, with an empty text;
* an empty table: no rows; extra columns are ignored, or kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyman.llm.common import pick, stored

#: Sites a line must be found on to be boilerplate.
MIN_SITES = 8
#: Estimates within this share of the threshold are counted exactly. Sketches of
#: 2^SKETCH_BITS registers err by about 1.04 / sqrt(2^SKETCH_BITS): 3 %.
NEAR = 0.3
SKETCH_BITS = 10
_LOWEST = -(1 << 63)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _exploded(docs: DataFrame) -> DataFrame:
    """``doc, dk, site, pos, h1, h2``: a row for each line that is not blank."""
    rows = docs.select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("doc"), F.xxhash64("doc_id", "text").alias("dk"), F.coalesce("site", F.lit("")).alias("site"),
                       F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    line = F.trim("line")
    return rows.where(line != "").select("doc", "dk", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """``h1, h2, first``: the hashes of boilerplate lines and where each occurs first.
    ``docs`` has doc_id, text and site."""
    lines = _exploded(docs)
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_BITS)).alias("sites"),
        F.min(F.struct("doc", "dk", "pos")).alias("first"))
    wide = stored(spread.where(F.col("sites") >= min_sites * (1 - near)), "line-spread")
    sure = F.col("sites") > min_sites * (1 + near)
    close = wide.where(~sure)
    exact = (lines.join(close.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
             .groupBy("h1", "h2").agg(F.count("one").alias("exact")).where(F.col("exact") >= min_sites))
    found = wide.where(sure).select("h1", "h2", "first").unionByName(close.join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first"))
    return stored(found, "line-boilerplate")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR, doc_id: str = "doc_id", text: str = "text", site: str = "source",
                keep: Sequence[str] = ()) -> DataFrame:
    """Every row's ``doc_id``, cleaned ``text``, ``n_lines`` (blank ones too) and
    ``n_removed``, and the input columns named in ``keep``."""
    kept = {f"kept_{i}": name for i, name in enumerate(keep)}
    rows = pick(docs, doc_id=doc_id, text=text, site=site, **kept)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    bad = boilerplate(rows.select("doc_id", "text", "site"), min_sites, near)
    here = F.struct("doc", "dk", "pos")
    gone = _exploded(rows).join(bad, ["h1", "h2"]).where(here != F.col("first")).groupBy("doc", "dk").agg(F.collect_set("pos").alias("gone"))
    keyed = rows.withColumn("doc", F.coalesce("doc_id", F.lit(_LOWEST))).withColumn("dk", F.xxhash64("doc_id", "text"))
    joined = keyed.join(gone, ["doc", "dk"], "left")
    lines = _lines(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))  # hashed: linear in the lines
    cleaned = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return joined.select("doc_id", cleaned.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                         F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"), *[F.col(k).alias(name) for k, name in kept.items()])
