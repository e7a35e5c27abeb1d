"""Operator 9: lines that a large part of a host's pages share are dropped.

A page is a document, its host its source. Lines are compared without the white space around them;
lines without a word are never dropped nor counted. A line goes from a host's pages when at least
MIN_PAGES of them hold it and that is more than RATIO of the host's pages. A host has at most
(its pages' mean of distinct lines) / RATIO such lines, so a host's list is bounded.

Defined results: null text stays null and counts as a page of its host; a null source is the host
''; repeated rows are pages of their own; a text that loses all its lines is empty; an empty table
gives no rows; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, skew_lookup
from .quality import SPACE

RATIO = 0.1
MIN_PAGES = 3


def _key(line: Column) -> Column:
    return F.md5(F.btrim(line, F.lit(SPACE)).cast("binary"))


def _worded(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")


def host_lines(pages: DataFrame, scratch: Scratch, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> tuple[DataFrame, tuple[int, int, int]]:
    """Of pages (host, text): per host its pages and the digests of its lines over the ratio; and the hosts' and digests' number, and the pages'."""
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(_worded(F.col("text")), _key))).alias("line"))
    shared = lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = scratch.save(pages.groupBy("host").agg(F.count("*").alias("host_pages")), "totals")
    hosts, all_pages = totals.agg(F.count("*"), F.coalesce(F.sum("host_pages"), F.lit(0))).first()
    # a page has many lines, so a host's part of the shared lines goes with its part of the pages
    rated = skew_lookup(shared, totals.withColumn("pages", F.col("host_pages")), "host", ["pages"], "host_pages", all_pages, F.col("line"), size=100 * hosts)
    over = rated.filter(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("over"), F.max("pages").alias("host_pages"))
    over = scratch.save(over, "over")
    n, held = over.agg(F.count("*"), F.coalesce(F.sum(F.size("over")), F.lit(0))).first()
    return over, (n, held, all_pages)


def line_dedup(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False) -> DataFrame:
    """docs (text, source, others) with shorter texts; with counts, also n_lines and n_dropped."""
    scratch = Scratch(docs.sparkSession, "lines")
    host = F.coalesce(F.col("source"), F.lit(""))
    over, (n, held, total) = host_lines(docs.select(host.alias("host"), "text"), scratch, ratio, min_pages)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), host.alias("host"))
    joined = skew_lookup(rows, over, "host", ["over"], "host_pages", total, F.monotonically_increasing_id(), size=100 * n + 60 * held)
    bad = lambda x: F.array_contains(F.col("over"), _key(x))
    text = F.col("_row.text")
    less = F.when(F.col("over").isNull() | text.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~bad(x)), "\n"))
    out = joined.withColumn("_text", less)
    columns = [F.col("_text").alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns]
    if counts:
        columns = [c for c, name in zip(columns, docs.columns, strict=True) if name.lower() not in ("n_lines", "n_dropped")]
        was, now = F.size(_worded(text)).cast("long"), F.size(_worded(F.col("_text"))).cast("long")
        columns += [was.alias("n_lines"), (was - now).alias("n_dropped")]
    return out.select(*columns)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
k AS (SELECT rid, doc_id, host, text, list_transform(ls, lambda x: {'raw': x, 'line': trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))}) AS ls FROM d),
e AS (SELECT DISTINCT rid, host, line FROM (SELECT rid, host, unnest(list_transform(ls, lambda x: x.line)) AS line FROM k) x WHERE line <> ''),
t AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
o AS (SELECT e.host, list(e.line) AS over FROM (SELECT host, line, count(*) AS n FROM e GROUP BY host, line HAVING count(*) >= 3) e JOIN t USING (host) WHERE n > 0.1 * pages GROUP BY e.host),
j AS (SELECT k.*, coalesce(o.over, []) AS over FROM k LEFT JOIN o ON k.host = o.host)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(list_transform(list_filter(ls, lambda x: NOT list_contains(over, x.line)), lambda x: x.raw), chr(10)), '') END AS text, CAST(len(list_filter(ls, lambda x: x.line <> '')) AS BIGINT) AS n_lines, CAST(len(list_filter(ls, lambda x: x.line <> '' AND list_contains(over, x.line))) AS BIGINT) AS n_dropped FROM j
"""
