"""Line deduplication by site-relative frequency.

Pages are grouped by host. A line whose share of its host's pages exceeds the boilerplate ratio is dropped
from all pages of the host. Lines are counted under 128 bits of hash, once a page, so that the shuffle carries
16 bytes a line and combines before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of, unused
from .url_reputation import url_parts

#: Boilerplate lines, over all hosts, up to which they go to every task; more of them are joined by host.
BROADCAST_LINES = 20_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    """128 bits as a struct of two longs."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("residua"), line, F.lit(1)).alias("b"))


def boilerplate_lines(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(host, text) to (host, h, line_pages, host_pages) of the lines above the ratio.

    A host has at most (lines of a page on average) / ratio of them.
    """
    totals = pages.groupBy(F.col("host").alias("site")).agg(F.count(F.lit(1)).alias("host_pages"))
    counted = (
        pages.select("host", F.explode(F.array_distinct(lines_of(F.col("text")))).alias("line"))
        .filter(F.trim("line") != "")
        .select("host", _hash(F.col("line")).alias("h"))
        .groupBy("host", "h.a", "h.b")
        .agg(F.count(F.lit(1)).alias("line_pages"))
        .filter(F.col("line_pages") >= min_pages)
    )
    above = counted.join(totals, F.col("host").eqNullSafe(F.col("site"))).filter(F.col("line_pages") > ratio * F.col("host_pages"))
    return above.select("host", F.struct("a", "b").alias("h"), "line_pages", "host_pages")


def dedup_lines(
    docs: DataFrame,
    text_col: str = "text",
    host: Column | None = None,
    ratio: float = 0.08,
    min_pages: int = 5,
    counts: dict[str, str] | None = None,
) -> DataFrame:
    """All columns of docs, the text without boilerplate lines, then ``n_lines`` and ``n_removed`` (replaced if they exist;
    ``counts`` may give them other names).

    ``host`` (default: column ``source``) groups pages; null is a host of its own. A line is boilerplate when it is on
    more than ``ratio`` of the host's pages and on ``min_pages`` at least, so that a host of few pages loses nothing.
    Lines are compared whole, with their white space; blank lines are never dropped. A null text stays null
    and counts as a page without lines; repeated rows are pages of their own.
    """
    scratch = Scratch(docs.sparkSession)
    host = F.col("source") if host is None else host
    drop, site, own_site, left = unused(docs, "drop", "host", "own_host", "left")
    pages = docs.select(host.cast("string").alias("host"), text_of(text_col).alias("text"))
    found = scratch.table(boilerplate_lines(pages, ratio, min_pages))
    by_host = found.groupBy("host").agg(F.collect_list("h").alias(drop)).select(F.col("host").alias(site), drop)
    if found.count() <= BROADCAST_LINES:
        by_host = F.broadcast(by_host)
    joined = docs.withColumn(own_site, host.cast("string")).join(by_host, F.col(own_site).eqNullSafe(F.col(site)), "left")
    lines = lines_of(F.col(text_col).cast("string"))
    kept = F.filter(lines, lambda x: ~F.array_contains(drop, _hash(x)))
    n_lines, n_removed = (counts or {}).get("n_lines", "n_lines"), (counts or {}).get("n_removed", "n_removed")
    joined = joined.withColumns({n_lines: F.coalesce(F.size(lines), F.lit(0)), left: F.when(F.col(drop).isNull(), lines).otherwise(kept)})
    joined = joined.withColumns({n_lines: F.when(F.col(text_col).isNull(), 0).otherwise(F.col(n_lines)), n_removed: F.when(F.col(text_col).isNull(), 0).otherwise(F.col(n_lines) - F.size(left))})
    text = F.when(F.col(text_col).isNotNull() & (F.col(n_removed) > 0), F.array_join(left, "\n")).otherwise(F.col(text_col))
    return joined.withColumn(text_col, text).drop(drop, site, own_site, left)


def dedup_page_lines(pages: DataFrame, url_col: str = "url", html_col: str = "html", ratio: float = 0.08, min_pages: int = 5) -> DataFrame:
    """All columns of pages, ``host``, ``text`` without its host's boilerplate lines, ``n_lines`` and ``n_removed``.

    Columns of these names are replaced. Text is what stands between tags, a line each, trimmed, without empty lines. The host
    is the url's (see url_reputation); a null url, or one without a host, has the empty host. A null html has a null text.
    """
    text = F.regexp_replace(F.regexp_replace(html_col, r"[ \t\n\f\r]*(<[^>]*>[ \t\n\f\r]*)+", "\n"), r"\A\n|\n\z", "")
    out = pages.withColumns({"host": url_parts(F.col(url_col))[0], "text": text})
    return dedup_lines(out, "text", F.col("host"), ratio, min_pages)
