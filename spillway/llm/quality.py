"""Operator 6, native: rules of documents, and of hosts by shrunk failure rates.

A document fails the base with under 50 words, or with over half of its words in repeated windows
of three. Soft rules alone reject nothing: symbols (over a tenth as many symbols as words), lines
(over 30 % of the lines equal to an earlier one), length (words of under 3 or over 12 code points
on average). Failures of each of the five rules, and of any, are summed by host; a host's rates are shrunk to the
mean of all documents by a beta prior. Its strength follows from how much more hosts differ than
documents dealt at random would (moments weighted by the hosts' documents). A host's verdict of a soft rule is
that its shrunk rate is over `limit`; its verdict as a whole, that the shrunk rate of failing any of the five is over
`bad`. A document goes that fails a soft rule of which its host has the verdict, or any soft rule where
its host as a whole is bad. So a failure is forgiven on a host where it is rare, and documents that fail nothing stay on any host.

All of it is DataFrame functions. Metrics are written once, so texts are read once.

Defined results: null text has no words and fails the base; a null source is the host ''; repeated
rows count as often as they occur; very long texts are read whole; rates equal to a limit are not over it, and with one host or
equal hosts the prior is as strong as it gets; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, skew_lookup

#: White space, symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: A host whose shrunk rate of a soft rule is higher loses the documents that fail the rule.
LIMIT = 0.02

#: A host whose shrunk rate of failing any of the five rules is higher loses the documents that fail any soft one.
BAD = 0.25

#: Documents by which the weakest and the strongest prior count.
WEAKEST, STRONGEST = 1.0, 1e6

SOFT = ("symbols", "lines", "length")
RULES = ("short", "repeats", *SOFT)
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Up to so many repeated windows are looked up in a list; more are found by sorting windows with their places.
FEW = 16


def _size(c: Column) -> Column:
    return F.size(c).cast("long")


def with_metrics(rows: DataFrame) -> DataFrame:
    """rows (text, others) with the metrics and n_lines in place of text. Arrays are columns of their
    own before a lambda uses them, so none is made again for each element."""
    others = [c for c in rows.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.char_length(F.translate(text, SPACE, ""))
    out = rows.select(
        *others,
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "").alias("_lines"),
        bare.cast("long").alias("word_chars"),
        (bare - F.char_length(F.translate(text, SPACE + SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    words = F.col("_words")
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    keep = [*others, "word_chars", "n_symbols"]
    out = out.select(*keep, _size(words).alias("n_words"), _size(F.col("_lines")).alias("n_lines"), (_size(F.col("_lines")) - _size(F.array_distinct("_lines"))).alias("n_dup_lines"), windows.alias("_w"))
    keep += ["n_words", "n_lines", "n_dup_lines"]
    out = out.select(*keep, "_w", F.sort_array("_w").alias("_s"))
    twice = F.array_distinct(F.filter(F.col("_s"), lambda x, i: (i > 0) & (x == F.get(F.col("_s"), i - 1))))
    out = out.select(*keep, "_w", twice.alias("_d"))
    placed = F.when(F.size("_d") > FEW, F.array_sort(F.transform(F.col("_w"), lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    out = out.select(*keep, "_w", "_d", placed.alias("_p"))
    here = F.col("_p")
    few = F.filter(F.transform(F.col("_w"), lambda x, i: F.when(F.array_contains(F.col("_d"), x), i)), lambda i: i.isNotNull())
    equal = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
    many = F.sort_array(F.filter(F.transform(here, lambda x, i: F.when(equal(x, F.get(here, i - 1)) | equal(x, F.get(here, i + 1)), x["i"])), lambda i: i.isNotNull()))
    out = out.select(*keep, F.when(F.size("_d") == 0, F.array().cast("array<int>")).when(F.size("_d") <= FEW, few).otherwise(many).alias("_at"))
    at = F.col("_at")
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select(*keep, covered.alias("n_repeat_words"))


def failures() -> dict[str, Column]:
    """Each rule's failure, from the metrics, and that of any rule."""
    c = F.col
    found = {
        "short": c("n_words") < 50,
        "repeats": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
        "length": (c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 12 * c("n_words")),
    }
    return found | {"any": found["short"] | found["repeats"] | found["symbols"] | found["lines"] | found["length"]}


def strength(mean: float, spread: float, documents: float, squares: float, hosts: int) -> float:
    """Documents by which the beta prior counts, from the hosts' sum of n (rate - mean)^2: 1 / rho - 1, rho the correlation of two documents of a host."""
    chance, room = mean * (1 - mean), documents - squares / documents - (hosts - 1)
    rho = (spread / chance - (hosts - 1)) / room if chance > 0 and room > 0 else 0.0
    return min(max(1 / rho - 1, WEAKEST), STRONGEST) if rho > 0 else STRONGEST


def host_rates(measured: DataFrame) -> DataFrame:
    """One row a host: its documents, and the shrunk failure rate of each rule and of any. Only the prior's moments, a few numbers, pass the driver."""
    rules = failures()
    hosts = measured.groupBy("host").agg(F.count("*").alias("host_docs"), *[F.sum(x.cast("long")).alias(k) for k, x in rules.items()])
    n = F.col("host_docs").cast("double")
    moments = [F.sum(k).alias(f"{k}_sum") for k in rules] + [F.sum(F.col(k).cast("double") * F.col(k) / n).alias(f"{k}_spread") for k in rules]
    m = hosts.agg(F.count("*").alias("hosts"), F.sum(n).alias("documents"), F.sum(n * n).alias("squares"), *moments).first()
    shrunk = []
    for k in rules:
        mean = m[f"{k}_sum"] / m["documents"] if m["hosts"] else 0.0
        held = strength(mean, m[f"{k}_spread"] - mean * mean * m["documents"], m["documents"], m["squares"], m["hosts"]) if m["hosts"] else STRONGEST
        shrunk.append(((F.col(k) + mean * held) / (n + held)).alias(f"{k}_rate"))
    return hosts.select("host", "host_docs", *shrunk)


def _judged(docs: DataFrame, kept: Column, scratch: Scratch, limit: float, bad: float) -> DataFrame:
    """`kept` of docs as _row, with the metrics, base_failed, host_rejected and kept."""
    rows = docs.select(kept.alias("_row"), F.col("text"), F.coalesce(F.col("source"), F.lit("")).alias("host"))
    measured = scratch.save(with_metrics(rows), "measured")
    hosts = scratch.save(host_rates(measured), "hosts")
    n, total = hosts.agg(F.count("*"), F.coalesce(F.sum("host_docs"), F.lit(0))).first()
    verdicts = hosts.select("host", "host_docs", *[(F.col(f"{k}_rate") > limit).alias(f"host_{k}") for k in SOFT], (F.col("any_rate") > bad).alias("host_bad"))
    out = skew_lookup(measured, verdicts, "host", [*[f"host_{k}" for k in SOFT], "host_bad"], "host_docs", total, F.monotonically_increasing_id(), size=200 * n)
    rule = failures()
    by_host = [rule[k] & (F.col(f"host_{k}") | F.col("host_bad")) for k in SOFT]
    out = out.withColumn("base_failed", rule["short"] | rule["repeats"]).withColumn("host_rejected", by_host[0] | by_host[1] | by_host[2])
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def quality_rules(docs: DataFrame, limit: float = LIMIT, bad: float = BAD) -> DataFrame:
    """One row a document: doc_id, the metrics, base_failed, kept, and host_rejected, the host's verdict on it."""
    out = _judged(docs, F.struct("doc_id"), Scratch(docs.sparkSession, "quality"), limit, bad)
    return out.select("_row.doc_id", *METRICS, "base_failed", "kept", "host_rejected")


def quality_filter(docs: DataFrame, limit: float = LIMIT, bad: float = BAD) -> DataFrame:
    """docs without those that the rules reject."""
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _judged(docs, every, Scratch(docs.sparkSession, "quality"), limit, bad).filter("kept").select("_row.*")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
a AS (SELECT rid, doc_id, host, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
w AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM a),
g AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS win FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g WHERE win IS NOT NULL) x WHERE c > 1),
p AS (SELECT rid, count(DISTINCT i + k) AS n FROM r CROSS JOIN (VALUES (0), (1), (2)) v(k) GROUP BY rid),
m AS (SELECT a.rid, doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM a LEFT JOIN p ON a.rid = p.rid),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > n_words AS f1, 10 * n_dup_lines > 3 * n_lines AS f2, word_chars < 3 * n_words OR word_chars > 12 * n_words AS f3 FROM m),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, [sum(CAST(f1 AS INT)), sum(CAST(f2 AS INT)), sum(CAST(f3 AS INT)), sum(CAST(base_failed OR f1 OR f2 OR f3 AS INT))] AS ks FROM f GROUP BY host),
u AS (SELECT host, n, unnest([1, 2, 3, 4]) AS r, CAST(unnest(ks) AS DOUBLE) AS k FROM h),
v AS (SELECT r, sum(k) / sum(n) AS p, sum(k * k / n) AS q, sum(n) AS t, sum(n * n) AS t2, count(*) AS hosts FROM u GROUP BY r),
e AS (SELECT r, p, CASE WHEN p * (1 - p) > 0 AND t - t2 / t - (hosts - 1) > 0 THEN ((q - p * p * t) / (p * (1 - p)) - (hosts - 1)) / (t - t2 / t - (hosts - 1)) ELSE 0 END AS rho FROM v),
s AS (SELECT r, p, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1), 1e6) ELSE 1e6 END AS m FROM e),
b AS (SELECT host, bool_or(r = 1 AND (k + p * m) / (n + m) > 0.02) AS b1, bool_or(r = 2 AND (k + p * m) / (n + m) > 0.02) AS b2, bool_or(r = 3 AND (k + p * m) / (n + m) > 0.02) AS b3, bool_or(r = 4 AND (k + p * m) / (n + m) > 0.25) AS b4 FROM u JOIN s USING (r) GROUP BY host),
j AS (SELECT *, f1 AND (b1 OR b4) OR f2 AND (b2 OR b4) OR f3 AND (b3 OR b4) AS host_rejected FROM f JOIN b USING (host))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_rejected AS kept, host_rejected FROM j
"""
