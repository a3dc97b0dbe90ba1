"""The pages to fetch of each search, and what is kept of the fetched ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Statuses that mean "blocked", which are skipped and don't end a search.
BLOCKED = (403, 429, 503)


def page_url(base: Column, page: Column) -> Column:
    """Page 1 is the base itself; later ones have ``page-N`` before their last path segment."""
    deep = F.concat(
        F.regexp_extract(F.rtrim(base, F.lit("/")), "^(.*)/([^/]*)$", 1), F.lit("/page-"), page.cast("string"), F.lit("/"),
        F.regexp_extract(F.rtrim(base, F.lit("/")), "^(.*)/([^/]*)$", 2),
    )
    return F.when(page <= 1, base).otherwise(deep)


def frontier(searches: DataFrame, max_pages: int = 3) -> DataFrame:
    """base, page, url of every page of every search (base)."""
    pages = searches.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(max_pages))))
    return pages.withColumn("url", page_url(F.col("base"), F.col("page")))


def first_ends(responses: DataFrame) -> DataFrame:
    """base, end (page, status, url): the first page that ends each search, where one does."""
    bad = (F.col("status") != 200) & ~F.col("status").isin(*BLOCKED)
    empty = (F.col("status") == 200) & (F.coalesce("n_listings", F.lit(0)) == 0)
    return responses.where(bad | empty).groupBy("base").agg(F.min(F.struct("page", "status", "url")).alias("end"))


def kept_responses(responses: DataFrame) -> DataFrame:
    """``responses`` (base, page, status, n_listings, ...) with status 200 before the first page that ends its search: a bad
    status, or a page without listings. ``stop_reason`` names a bad status. The first ending page a search is a map-side
    combined minimum, joined back."""
    ends = first_ends(responses)
    reason = F.when(F.col("end.status") != 200, F.concat(F.lit("http "), F.col("end.status"), F.lit(" on "), F.col("end.url")))
    rows = responses.join(ends, "base", "left").withColumn("stop_reason", reason)
    kept = (F.col("status") == 200) & (F.col("end").isNull() | (F.col("page") < F.col("end.page")))
    return rows.where(kept).drop("end")


def open_responses(responses: DataFrame) -> DataFrame:
    """Of ``responses`` what later ones may change: the pages that count so far, and each search's first ending page."""
    ends = first_ends(responses)
    rows = responses.join(ends, "base", "left")
    counts = (F.col("status") == 200) & (F.col("end").isNull() | (F.col("page") < F.col("end.page")))
    ending = F.struct("page", "status", "url") == F.col("end")
    last = rows.where(ending).select("base", "page", "url", "status", "n_listings").distinct()
    return rows.where(counts).select("base", "page", "url", "status", "n_listings").unionByName(last)


def stopped_early(responses: DataFrame) -> str | None:
    """Why the last search (by base) that met a bad status stopped; None if none did. One row reaches the driver."""
    ends = first_ends(responses)
    reason = F.concat(F.lit("http "), F.col("end.status"), F.lit(" on "), F.col("end.url"))
    return ends.where("end.status <> 200").agg(F.max_by(reason, "base")).first()[0]
