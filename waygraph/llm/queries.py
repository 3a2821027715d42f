"""Queries of the training-data operators: percentiles (1), runs (2), leaks (6), mixture (7), truncation (8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.catalog import Catalog, table
from . import leaks, mixture, percentiles, runs, truncation

CATALOG = Catalog()
add = CATALOG.add


def _p1_sql() -> str:
    def value(p: int) -> str:
        lo = f"max(CASE WHEN rn = (n - 1) * {p} // 100 THEN v END)"
        hi = f"max(CASE WHEN rn = ((n - 1) * {p} + 99) // 100 THEN v END)"
        return f"{lo} + ({hi} - {lo}) * ((n - 1) * {p} % 100) / 100"

    return f"""
WITH r AS (SELECT DISTINCT query_id, repetition, duration_ns FROM timings WHERE duration_ns IS NOT NULL),
k AS (SELECT query_id, CAST(duration_ns AS DOUBLE) AS v, row_number() OVER (PARTITION BY query_id ORDER BY duration_ns) - 1 AS rn,
      count(*) OVER (PARTITION BY query_id) AS n FROM r)
SELECT query_id, n, {value(50)} AS median, {value(95)} AS p95, {value(99)} AS p99 FROM k GROUP BY query_id, n
"""


def _day():
    return F.unix_date(F.col("recorded_at").cast("date"))


@add("p1_percentiles", _p1_sql())
def p1_percentiles(spark, d):
    """Median, p95 and p99 of each query's duration; exact."""
    return percentiles.percentiles(table(spark, d, "timings"), "query_id", "duration_ns", "repetition")


@add("p1_day_summaries")
def p1_day_summaries(spark, d):
    """The summary of each day and query from which any period can be answered."""
    return percentiles.summaries(table(spark, d, "timings"), _day(), "query_id", "duration_ns", "repetition")


@add("p1_combined")
def p1_combined(spark, d):
    """Percentiles of the whole period from the days' summaries, with the bound of the rank's error."""
    return percentiles.combined(p1_day_summaries(spark, d), "query_id", "duration_ns")


@add("p1_combined_check", """SELECT query_id, count(*) AS n, TRUE AS median_ok, TRUE AS p95_ok, TRUE AS p99_ok, TRUE AS bound_ok
FROM (SELECT DISTINCT query_id, repetition, duration_ns FROM timings WHERE duration_ns IS NOT NULL AND recorded_at IS NOT NULL) GROUP BY query_id""")
def p1_combined_check(spark, d):
    """Whether the true rank of each combined percentile is within the stated bound, and the bound within its promise."""
    r = table(spark, d, "timings").where("duration_ns is not null and recorded_at is not null").select("query_id", "repetition", "duration_ns", F.to_date("recorded_at").alias("day")).distinct()
    x = r.join(p1_combined(spark, d).withColumnRenamed("n", "all"), "query_id")
    names = {"median": 50, "p95": 95, "p99": 99}
    counts = [F.count(F.when(F.col("duration_ns") < F.col(c), 1)).alias(f"{c}_below") for c in names] + [F.count(F.when(F.col("duration_ns") <= F.col(c), 1)).alias(f"{c}_upto") for c in names]
    k = x.groupBy("query_id", "all", "rank_error").agg(F.count("*").alias("n"), F.countDistinct("day").alias("days"), *counts)
    at = lambda p: F.floor((F.col("n") - 1) * p / 100)
    ok = [((F.col(f"{c}_below") - F.col("rank_error") <= at(p)) & (at(p) <= F.col(f"{c}_upto") - 1 + F.col("rank_error")) & (F.col("all") == F.col("n"))).alias(f"{c}_ok") for c, p in names.items()]
    return k.select("query_id", "n", *ok, (F.col("rank_error") <= percentiles.RANK_ERROR * F.col("n") + F.col("days")).alias("bound_ok"))


_P2 = """
WITH p AS (SELECT DISTINCT path_id, lat, lng, sampled_at FROM paths),
q AS (SELECT path_id, unnest(lat) AS a, unnest(lng) AS o, unnest(coalesce(sampled_at, [NULL FOR x IN lat])) AS t, unnest(range(len(lat))) AS i FROM p),
k AS (SELECT *, lag(a) OVER w AS a0, lag(o) OVER w AS o0 FROM q WINDOW w AS (PARTITION BY path_id ORDER BY i)),
e AS (SELECT *, coalesce(2 * 6371008.8 * asin(sqrt(pow(sin(radians(a - a0) / 2), 2)
      + cos(radians(a0)) * cos(radians(a)) * pow(sin(radians(o - o0) / 2), 2))) <= 3, FALSE) AS near FROM k),
g AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY path_id ORDER BY i) AS g FROM e),
s AS (SELECT path_id, min(i) AS start_pos, max(i) AS end_pos, count(*) AS n_points, arg_min(t, i) AS t0, arg_max(t, i) AS t1 FROM g GROUP BY path_id, g)
"""


@add("p2_found", _P2 + "SELECT path_id, start_pos, end_pos FROM s WHERE n_points >= 2")
def p2_found(spark, d):
    """Stretches of two or more near-identical successive points."""
    return runs.stops(table(spark, d, "paths"), least=2).select("path_id", "start_pos", "end_pos")


@add("p2_stops", _P2 + "SELECT path_id, start_pos, end_pos, n_points, t1 - t0 AS duration_s FROM s")
def p2_stops(spark, d):
    """Each path with every stretch turned into one stop: number of points and duration."""
    return runs.stops(table(spark, d, "paths")).select("path_id", "start_pos", "end_pos", "n_points", "duration_s")


_P6 = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, array_to_string(w[k + 1 : k + 13], ' ') AS g FROM (SELECT *, unnest(range(len(w) - 12)) AS k FROM iw WHERE len(w) >= 13)),
d AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + 13], ' ') AS g FROM (SELECT *, unnest(range(len(w) - 12)) AS k FROM dw WHERE len(w) >= 13)),
f AS (SELECT DISTINCT d.doc_id, i.item_id FROM d JOIN i ON d.g = i.g)
"""


def _leaks(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@add("p6_found", _P6 + "SELECT doc_id, item_id FROM f")
def p6_found(spark, d):
    """Documents with the items of which they hold 13 or more successive words."""
    return _leaks(spark, d).where("exact_windows > 0").select("doc_id", "item_id")


@add("p6_near")
def p6_near(spark, d):
    """The same with the number of shared windows and the greatest similarity, near matches too."""
    return _leaks(spark, d)


@add("p6_items", _P6 + "SELECT item_id, count(*) AS documents FROM f GROUP BY item_id")
def p6_items(spark, d):
    """Items that leaked, with the number of documents."""
    return p6_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


@add("p7_mixture")
def p7_mixture(spark, d):
    """The mixture: each document that is used, for which source and how often."""
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@add("p7_shares")
def p7_shares(spark, d):
    """Of each source the documents, uses, tokens and the share reached."""
    return mixture.shares(p7_mixture(spark, d), table(spark, d, "mix_targets"))


@add("p7_shares_check", "SELECT source, max(max_repeats) AS max_repeats, TRUE AS share_ok, TRUE AS repeats_ok FROM mix_targets WHERE source IS NOT NULL GROUP BY source")
def p7_shares_check(spark, d):
    """Whether each source reaches its share within half a point, and no document is used more often than it may be."""
    made = p7_shares(spark, d)
    return made.select("source", "max_repeats", (F.abs(F.col("share") - F.col("target_share")) <= 0.005).alias("share_ok"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_ok"))


@add("p8_found")
def p8_found(spark, d):
    """Documents whose text was cut."""
    return truncation.truncated(table(spark, d, "documents")).where("cut").select("doc_id")


@add("p8_evidence")
def p8_evidence(spark, d):
    """Of each text the ending, the limit it meets and the log odds that it was cut."""
    return truncation.truncated(table(spark, d, "documents"))


@add("p8_rates")
def p8_rates(spark, d):
    """How many texts of each source are cut."""
    return truncation.truncation_rates(p8_evidence(spark, d))
