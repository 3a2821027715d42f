"""Queries of benchmark statistics and tuning rules over the timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bench_stats as b
from .catalog import Catalog, table

CATALOG = Catalog()
add = CATALOG.add

_R = "r AS (SELECT DISTINCT repetition, query_id, duration_ns, status, wait_ns, latency_ns, worker, recorded_at FROM timings)"
_OK = "k AS (SELECT * FROM r WHERE duration_ns BETWEEN 1 AND 86400000000000)"


def readings(spark, d):
    """Each reading once."""
    return table(spark, d, "timings").drop("received_at").distinct()


def plausible(spark, d):
    return readings(spark, d).where("duration_ns between 1 and 86400000000000")


def _ranks(group: str, source: str = "k") -> str:
    g = group + ", " if group else ""
    return f"""SELECT {g}n, CAST(total AS DOUBLE) / n AS mean, p50, p95, max, total FROM (
  SELECT {g}count(*) AS n, CAST(sum(duration_ns) AS BIGINT) AS total, max(duration_ns) AS max,
    max(CASE WHEN rn = (cnt * 50 + 99) // 100 THEN duration_ns END) AS p50, max(CASE WHEN rn = (cnt * 95 + 99) // 100 THEN duration_ns END) AS p95
  FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY duration_ns) AS rn, count(*) OVER (PARTITION BY {group}) AS cnt FROM {source})
  GROUP BY {group})"""


@add("nearest_rank_percentiles", f"WITH {_R}, {_OK} {_ranks('query_id')}")
def nearest_rank_percentiles(spark, d):
    """Mean, nearest-rank p50 and p95, greatest and total duration of each query."""
    return b.nearest_rank(plausible(spark, d), ["query_id"], "duration_ns")


@add("sample_faults", f"""WITH {_R}, f AS (
  SELECT 'negative' AS fault FROM r WHERE duration_ns < 0 OR wait_ns < 0 OR latency_ns < 0
  UNION ALL SELECT 'latency' FROM r WHERE abs(CAST(latency_ns AS HUGEINT) - duration_ns - wait_ns) > 1
  UNION ALL SELECT 'status' FROM r WHERE status IS NULL OR status NOT IN ('found', 'unreachable', 'invalid_vertex')
  UNION ALL SELECT 'repetition' FROM r WHERE repetition IS NULL OR repetition < 1
  UNION ALL SELECT 'duplicate' FROM (SELECT query_id, repetition FROM r GROUP BY query_id, repetition HAVING count(*) > 1))
SELECT fault, count(*) AS n FROM f GROUP BY fault""")
def sample_faults(spark, d):
    """Readings that break a rule of a complete run, by rule."""
    return b.sample_faults(readings(spark, d)).groupBy("fault").agg(F.count("*").alias("n"))


@add("missing_samples", """SELECT q.query_id, 60 - coalesce(n, 0) AS missing FROM (SELECT DISTINCT query_id FROM queries) AS q
LEFT JOIN (SELECT query_id, count(DISTINCT repetition) AS n FROM timings WHERE repetition BETWEEN 1 AND 60 GROUP BY query_id) AS t ON t.query_id = q.query_id WHERE 60 - coalesce(n, 0) > 0""")
def missing_samples(spark, d):
    """Queries with fewer than sixty of the first sixty repetitions."""
    return b.missing_samples(readings(spark, d), table(spark, d, "queries"), 60)


_WALL = f"""WITH {_R}, {_OK}, w AS (SELECT repetition, CAST(sum(duration_ns) AS BIGINT) // 1000000 AS wall_ms FROM k GROUP BY repetition)"""


@add("batch_throughput", _WALL + """ SELECT count(*) AS batches, CAST(sum(wall_ms) AS DOUBLE) / count(*) AS mean_ms, min(wall_ms) AS min_ms, max(wall_ms) AS max_ms,
CAST(100 * count(*) * 1000 AS DOUBLE) / CAST(sum(wall_ms) AS DOUBLE) AS qps FROM w""")
def batch_throughput(spark, d):
    """Throughput from each repetition's total as its wall time, for 100 queries a batch."""
    w = plausible(spark, d).groupBy("repetition").agg(F.floor(F.sum("duration_ns") / F.lit(1000000)).alias("wall_ms"))
    return b.throughput(w, 100)


@add("group_latency", f"""WITH {_R}, {_OK}, g AS (SELECT query_id, CASE WHEN target IS NULL OR target < 0 THEN 'bad' ELSE 'good' END AS "group" FROM (SELECT DISTINCT query_id, target FROM queries)),
x AS (SELECT k.duration_ns, coalesce(g."group", 'other') AS "group" FROM k LEFT JOIN g ON g.query_id = k.query_id) {_ranks('"group"', 'x')}""")
def group_latency(spark, d):
    """The same statistics for groups of queries."""
    g = table(spark, d, "queries").select("query_id", "target").distinct()
    g = g.select("query_id", F.when(F.col("target").isNull() | (F.col("target") < 0), "bad").otherwise("good").alias("group"))
    return b.group_latency(plausible(spark, d), g)


_RUNS = f"""WITH {_R}, {_OK}, x AS (SELECT query_id % 5 AS size, worker, duration_ns FROM k),
y AS (SELECT size, worker, duration_ns, row_number() OVER (PARTITION BY size, worker ORDER BY duration_ns) AS rn, count(*) OVER (PARTITION BY size, worker) AS n FROM x),
runs AS (SELECT size, worker, max(n) AS index_bytes, min(duration_ns) AS build_ms, max(CASE WHEN rn = (n * 50 + 99) // 100 THEN duration_ns END) AS mean_ms,
  max(CASE WHEN rn = (n * 95 + 99) // 100 THEN duration_ns END) AS p95_ms FROM y GROUP BY size, worker),
cand AS (SELECT size, 1.01 AS weight, count(*) AS processes, median(mean_ms) AS score_ms, median(p95_ms) AS p95_ms, min(index_bytes) AS index_bytes, median(build_ms) AS build_ms FROM runs GROUP BY size)
"""


def _runs(spark, d):
    """A tuning run a (remainder of the query's number, worker), from the timings."""
    x = plausible(spark, d).select((F.col("query_id") % 5).alias("size"), "worker", "duration_ns")
    s = b.nearest_rank(x, ["size", "worker"], "duration_ns")
    low = x.groupBy("size", "worker").agg(F.min("duration_ns").alias("build_ms"))
    return s.join(low, ["size", "worker"]).select(
        F.lit(True).alias("ok"), F.lit("hpa").alias("algorithm"), "size", F.lit(1.01).alias("weight"), F.lit(True).alias("pass"),
        F.col("p50").alias("mean_ms"), F.col("p95").alias("p95_ms"), F.col("n").alias("index_bytes"), "build_ms",
    )


@add("tuning_candidates", _RUNS + "SELECT size, CAST(weight AS DOUBLE) AS weight, processes, score_ms, p95_ms, index_bytes, build_ms FROM cand")
def tuning_candidates(spark, d):
    return b.candidates(_runs(spark, d))


@add("tie_band_choice", _RUNS + """SELECT size, CAST(weight AS DOUBLE) AS weight, processes, score_ms, p95_ms, index_bytes, build_ms FROM cand
WHERE score_ms <= (SELECT min(score_ms) FROM cand) * 1.03::DOUBLE ORDER BY p95_ms, index_bytes, build_ms, size, weight LIMIT 1""")
def tie_band_choice(spark, d):
    return b.choose(b.candidates(_runs(spark, d)))


@add("median_across", _RUNS + "SELECT size, median(mean_ms) AS mean_ms_median, min(mean_ms) AS mean_ms_min, max(mean_ms) AS mean_ms_max FROM runs GROUP BY size")
def median_across(spark, d):
    return b.median_across(_runs(spark, d), ["size"], ["mean_ms"])


_GAPS = """g AS (SELECT src % 7 AS "group", CASE WHEN distance_m > 0 THEN CAST(CAST(round(distance_m) AS BIGINT) % 6 AS DOUBLE) END AS gap_percent,
  CAST(CAST(round(distance_m) AS BIGINT) % 6 AS DOUBLE) AS extra, CAST(round(distance_m) AS BIGINT) % 6 = 0 AS optimal FROM (SELECT DISTINCT src, dst, distance_m FROM graph_edges WHERE distance_m IS NOT NULL))"""
_QUALITY = f"""WITH {_GAPS}, s AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY gap_percent) AS rn, count(*) OVER (PARTITION BY "group") AS n FROM g WHERE gap_percent IS NOT NULL),
q AS (SELECT a."group", a.found, a.optimal, a.undefined, a.max_extra, c.mean_gap, c.p50_gap, c.p95_gap, c.max_gap FROM
 (SELECT "group", count(*) AS found, count(CASE WHEN optimal THEN 1 END) AS optimal, count(CASE WHEN gap_percent IS NULL THEN 1 END) AS undefined, coalesce(max(extra), 0.0) AS max_extra FROM g GROUP BY "group") AS a
 LEFT JOIN (SELECT "group", sum(gap_percent) / count(*) AS mean_gap, max(CASE WHEN rn = (n * 50 + 99) // 100 THEN gap_percent END) AS p50_gap,
  max(CASE WHEN rn = (n * 95 + 99) // 100 THEN gap_percent END) AS p95_gap, max(gap_percent) AS max_gap FROM s GROUP BY "group") AS c ON c."group" = a."group")
"""


def _gaps(spark, d):
    """Gaps made from the edges' lengths, in seven groups; undefined for edges of no length."""
    e = table(spark, d, "graph_edges").where("distance_m is not null").select("src", "dst", "distance_m").distinct()
    six = F.round("distance_m").cast("bigint") % 6
    return e.select((F.col("src") % 7).alias("group"), F.when(F.col("distance_m") > 0, six.cast("double")).alias("gap_percent"), six.cast("double").alias("extra"), (six == 0).alias("optimal"))


@add("quality_summary", _QUALITY + "SELECT * FROM q")
def quality_summary(spark, d):
    return b.quality(_gaps(spark, d), ["group"])


@add("quality_gate", _QUALITY + """SELECT "group", undefined = 0 AND coalesce(p95_gap <= 1 + 1e-7 AND max_gap <= 5 + 1e-7, FALSE) AS pass FROM q""")
def quality_gate(spark, d):
    return b.quality(_gaps(spark, d), ["group"]).select("group", b.passes().alias("pass"))


_GRID = "SELECT size, CAST(weight AS DOUBLE) AS weight FROM (SELECT unnest([250, 500, 750, 1000, 1500, 2000, 3000, 4000, 6000, 8000, 12000]) AS size), (SELECT unnest([1.005, 1.01, 1.02, 1.05]) AS weight)"


@add("tuning_grid", _GRID)
def tuning_grid(spark, d):
    return b.coarse_grid(spark)


@add("fine_grid", "SELECT DISTINCT CAST(greatest(125, least(24000, floor(p_size * 130 * f / 50 + 0.5) * 50)) AS INTEGER) AS size FROM part, (SELECT unnest([0.75::DOUBLE, 0.875::DOUBLE, 1.0::DOUBLE, 1.125::DOUBLE, 1.25::DOUBLE]) AS f)")
def fine_grid(spark, d):
    s = table(spark, d, "part").select((F.col("p_size") * 130).alias("size")).distinct()
    return b.fine_sizes(s, (0.75, 0.875, 1.0, 1.125, 1.25))


@add("break_even", _RUNS + "SELECT size, CASE WHEN base > mean_ms THEN CAST(ceil(build_ms / (base - mean_ms)) AS BIGINT) END AS queries FROM (SELECT size, score_ms AS mean_ms, build_ms, (SELECT max(score_ms) FROM cand) AS base FROM cand)")
def break_even(spark, d):
    c = b.candidates(_runs(spark, d))
    base = c.agg(F.max("score_ms").alias("base"))
    return c.crossJoin(F.broadcast(base)).select("size", b.break_even(F.col("build_ms"), F.col("base"), F.col("score_ms")).alias("queries"))
