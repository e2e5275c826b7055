"""Line dedup by site-relative frequency, in DataFrame functions only.

A line that stands on more than ``ratio`` of a site's pages, and on at least ``min_pages`` of them, is boilerplate of
that site and is dropped there. A page counts once for a line however often it has it. Lines are compared without
white space around them; blank lines are never dropped. Lines are told apart by 64-bit hashes within a site.

A null site is a site of its own. A null text stays null, an empty one empty. Repeated rows are pages of their own.
Extra columns pass through, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from manyfold.llm.common import fresh, hot_keys, spread_join
from manyfold.sources.settled import settle

RATIO, MIN_PAGES = 0.1, 5
AROUND = " \t\r\f\x0b"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(AROUND))


def site_key(site: Column) -> Column:
    """Never null, so that a null site joins with itself."""
    return F.when(site.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), site.cast("string")))


def boilerplate(docs: DataFrame, site: Column, text: str, ratio: float, min_pages: int) -> tuple[DataFrame, DataFrame]:
    """site_, n_ (pages); and site_, lines_ (hashes of its boilerplate lines).

    Every such line is on a ``ratio`` of the site's pages, so a site has at most its mean lines per page / ratio.
    """
    pages = docs.select(site_key(site).alias("site_"), F.col(text).alias("text_"))
    totals = settle(pages.groupBy("site_").agg(F.count(F.lit(1)).alias("n_")), "sites")
    each = F.transform(F.filter(F.transform(lines_of(F.col("text_")), bare), lambda x: x != ""), lambda x: F.xxhash64(x))
    seen = pages.select("site_", F.explode(F.array_distinct(each)).alias("line_"))
    counts = seen.groupBy("site_", "line_").agg(F.count(F.lit(1)).alias("k_")).filter(F.col("k_") >= min_pages)
    bad = counts.join(totals, "site_").filter(F.col("k_") > ratio * F.col("n_"))
    return totals, bad.groupBy("site_").agg(F.collect_list("line_").alias("lines_"))


def drop_site_lines(docs: DataFrame, site: str = "source", text: str = "text", page: str = "doc_id", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The documents without boilerplate lines, and with line counts before and after.

    The input's columns stay, under one column ``row``; next to it stand text, n_lines and n_dropped.
    """
    totals, bad = boilerplate(docs, F.col(site), text, ratio, min_pages)
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(text).alias("text_"),
        site_key(F.col(site)).alias("site_"),
        F.xxhash64(F.col(page), F.col(text)).alias("spread_"),
    )
    joined = spread_join(rows, settle(bad, "boilerplate"), ["site_"], "spread_", hot_keys(totals, ["site_"], "n_"), "left")
    own = lines_of(F.col("text_"))
    kept = F.filter(own, lambda x: ~F.array_contains(F.col("lines_"), F.xxhash64(bare(x))) | (bare(x) == ""))
    joined = joined.withColumn("kept_", F.when(F.col("lines_").isNull(), own).otherwise(kept))
    return joined.select(
        "row",
        F.array_join("kept_", "\n").alias("text"),
        F.coalesce(F.size(own), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size(own) - F.size("kept_"), F.lit(0)).alias("n_dropped"),
    )


def without_site_lines(docs: DataFrame, site: str = "source", text: str = "text", **settings) -> DataFrame:
    """The documents with the columns they had, the text without boilerplate lines."""
    clean = fresh(docs, "clean_text")
    cleaned = drop_site_lines(docs, site, text, **settings).select("row.*", F.col("text").alias(clean))
    return cleaned.select(*[F.col(clean).alias(c) if c == text else F.col(c) for c in docs.columns])
