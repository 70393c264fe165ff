"""Removal of boilerplate lines by the number of distinct sites that carry them.

A HyperLogLog sketch of the sites is kept for each line key and merged by
aggregation.  Its estimate decides lines that are far from the threshold; lines
whose estimate is within ``margin`` of it (a share of the threshold, many times the
sketch's error) get an exact distinct count.  DataFrame functions only.  Lines near or above
the threshold are few; up to a counted million of them go to every task, so that the
copies of a common line are not brought together.

A line is the text between line feeds, with spaces and tabs at its ends cut; its key
is two independent hashes (96 bits).  Lines that are empty after the cut are never
boilerplate and stay.  A line counts once per site however often it stands there, so
repeated rows change nothing.  Null text is an empty document (no lines); a null site
is a site of its own.  Ties do not occur: the rule is "at least ``min_sites``".
Extra columns pass through; helper columns start with ``_ld_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilquery.llm._common import durable, sent_if_small


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    cut = F.btrim(line, F.lit(" \t"))
    return F.struct(F.xxhash64(cut).alias("a"), F.hash(cut).alias("b"))


def boilerplate(
    docs: DataFrame, *, site: str = "source", text: str = "text", min_sites: int = 8, margin: float = 0.5, lg_k: int = 10
) -> DataFrame:
    """Keys (_ld_key) of the lines that stand on at least ``min_sites`` distinct sites."""
    cut = F.filter(_lines(F.col(text)), lambda x: F.btrim(x, F.lit(" \t")) != "")
    lines = docs.select(
        F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("_ld_site"),
        F.explode(F.array_distinct(F.transform(cut, _key))).alias("_ld_key"),
    )
    spread = lines.groupBy("_ld_key").agg(F.hll_sketch_agg("_ld_site", lg_k).alias("s")).select(
        "_ld_key", F.hll_sketch_estimate("s").alias("n")
    )
    # what is never near the threshold from below leaves at once; the rest is a small part of all lines
    spread = durable(spread.where(F.col("n") >= min_sites * (1 - margin)))
    near = spread.where(F.col("n") <= min_sites * (1 + margin)).select("_ld_key")
    sure = spread.where(F.col("n") > min_sites * (1 + margin)).select("_ld_key")
    exact = (
        lines.join(sent_if_small(near), "_ld_key", "left_semi").distinct().groupBy("_ld_key").agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_sites).select("_ld_key")
    )
    return durable(sure.unionByName(exact))


def remove_boilerplate(
    docs: DataFrame, *, site: str = "source", text: str = "text", min_sites: int = 8, margin: float = 0.5, lg_k: int = 10
) -> DataFrame:
    """All rows and columns of ``docs``, text without its boilerplate lines, and _ld_lines and _ld_removed
    (lines before, lines removed)."""
    flagged = boilerplate(docs, site=site, text=text, min_sites=min_sites, margin=margin, lg_k=lg_k)
    # rows are known by the hash of their text: copies share one list of lines to remove
    own = F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"))
    hits = (
        docs.where(F.col(text).isNotNull())
        .select(own.alias("_ld_text"), F.explode(F.array_distinct(F.transform(_lines(F.col(text)), _key))).alias("_ld_key"))
        .join(sent_if_small(flagged), "_ld_key", "left_semi")
        .groupBy("_ld_text").agg(F.collect_set("_ld_key").alias("_ld_keys"))
    )
    joined = docs.withColumn("_ld_text", own).join(hits, "_ld_text", "left")
    lines = F.when(F.coalesce(F.col(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(_lines(F.col(text)))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("_ld_keys"), _key(x)))
    return (
        joined.withColumn("_ld_lines", F.size(lines).cast("long"))
        .withColumn("_ld_kept", F.when(F.col("_ld_keys").isNull(), lines).otherwise(kept))
        .withColumn("_ld_removed", F.col("_ld_lines") - F.size("_ld_kept"))
        .withColumn(text, F.when(F.col("_ld_keys").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join("_ld_kept", "\n")))
        .drop("_ld_text", "_ld_keys", "_ld_kept")
    )
