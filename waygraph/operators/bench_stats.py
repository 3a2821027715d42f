"""Statistics of timings and of tuning runs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FOUND, INVALID, UNREACHABLE

# fixed values of the tuning rules
TIE_BAND, P95_GAP, MAX_GAP, SLACK = 1.03, 1.0, 5.0, 1e-7
SIZES = (250, 500, 750, 1000, 1500, 2000, 3000, 4000, 6000, 8000, 12000)
WEIGHTS = (1.005, 1.01, 1.02, 1.05)
FINE_STEP, FINE_LOW, FINE_HIGH = 50, 125, 24000


def nearest_rank(df: DataFrame, group: list[str], value: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """(group, n, mean, p.., max, total): nearest-rank percentiles (the value at rank ceil(p n)).

    Values are counted first, so a group is its distinct values; null values take no part.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_k"))
    up = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("_cum", F.sum("_k").over(up)).withColumn("_n", F.sum("_k").over(Window.partitionBy(*group)))
    rank = lambda p: F.floor((F.col("_n") * p + 99) / 100)
    picks = [F.min(F.when(F.col("_cum") >= rank(p), F.col(value))).alias(f"p{p}") for p in percents]
    total = F.sum(F.col(value) * F.col("_k"))
    out = c.groupBy(*group).agg(F.sum("_k").alias("n"), (total / F.sum("_k")).alias("mean"), *picks, F.max(value).alias("max"), total.alias("total"))
    return out


def sample_faults(timings: DataFrame, repetitions: int | None = None) -> DataFrame:
    """(query_id, repetition, fault): readings that no complete run may hold.

    Faults: negative, latency (off by more than 1 ns), status, repetition, duplicate.
    """
    r = timings.select("query_id", "repetition", "duration_ns", "wait_ns", "latency_ns", "status")
    bad = F.array_compact(
        F.array(
            F.when((F.col("duration_ns") < 0) | (F.col("wait_ns") < 0) | (F.col("latency_ns") < 0), "negative"),
            F.when(F.abs(F.col("latency_ns") - F.col("duration_ns") - F.col("wait_ns")) > 1, "latency"),
            F.when(~F.coalesce(F.col("status").isin(FOUND, UNREACHABLE, INVALID), F.lit(False)), "status"),
            F.when(~F.coalesce(F.col("repetition").between(1, repetitions if repetitions is not None else 2**31 - 1), F.lit(False)), "repetition"),
        )
    )
    each = r.select("query_id", "repetition", F.explode(bad).alias("fault"))
    twice = r.groupBy("query_id", "repetition").count().where("count > 1").select("query_id", "repetition", F.lit("duplicate").alias("fault"))
    return each.unionByName(twice)


def missing_samples(timings: DataFrame, queries: DataFrame, repetitions: int) -> DataFrame:
    """(query_id, missing): queries with fewer than `repetitions` different repetitions."""
    have = timings.where(F.col("repetition").between(1, repetitions)).groupBy("query_id").agg(F.countDistinct("repetition").alias("n"))
    every = queries.select("query_id").distinct().join(have, "query_id", "left")
    return every.select("query_id", (F.lit(repetitions) - F.coalesce("n", F.lit(0))).alias("missing")).where("missing > 0")


def throughput(walls: DataFrame, queries: int) -> DataFrame:
    """One row from (repetition, wall_ms): batches, mean_ms, min_ms, max_ms, qps (by wall time, not by service)."""
    return walls.agg(
        F.count("*").alias("batches"), F.avg("wall_ms").alias("mean_ms"), F.min("wall_ms").alias("min_ms"), F.max("wall_ms").alias("max_ms"),
        (F.lit(queries) * F.count("*") * 1000 / F.sum("wall_ms")).alias("qps"),
    )


def group_latency(timings: DataFrame, groups: DataFrame, value: str = "duration_ns") -> DataFrame:
    """Nearest-rank statistics of the timings of each group of queries (query_id, group); others are `other`."""
    x = timings.join(groups, "query_id", "left").withColumn("group", F.coalesce("group", F.lit("other")))
    return nearest_rank(x, ["group"], value)


def median_across(runs: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """Median, least and greatest of each value over the runs (processes) of a group: a handful of rows each."""
    return runs.groupBy(*group).agg(*[x for v in values for x in (F.percentile(v, 0.5).alias(f"{v}_median"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"))])


def quality(gaps: DataFrame, group: list[str]) -> DataFrame:
    """(group, found, optimal, undefined, mean_gap, p50_gap, p95_gap, max_gap, max_extra)."""
    base = gaps.groupBy(*group).agg(
        F.count("*").alias("found"), F.count(F.when(F.col("optimal"), 1)).alias("optimal"), F.count(F.when(F.col("gap_percent").isNull(), 1)).alias("undefined"), F.coalesce(F.max("extra"), F.lit(0.0)).alias("max_extra")
    )
    ranks = nearest_rank(gaps, group, "gap_percent").select(*group, F.col("mean").alias("mean_gap"), F.col("p50").alias("p50_gap"), F.col("p95").alias("p95_gap"), F.col("max").alias("max_gap"))
    return base.join(ranks, group, "left")


def passes() -> Column:
    """Quality gate over quality()'s columns."""
    return (F.col("undefined") == 0) & F.coalesce((F.col("p95_gap") <= P95_GAP + SLACK) & (F.col("max_gap") <= MAX_GAP + SLACK), F.lit(False))


def candidates(runs: DataFrame) -> DataFrame:
    """(size, weight, processes, score_ms, p95_ms, index_bytes, build_ms): settings of which every process passes.

    runs: a row a process - ok, algorithm, size, weight, pass, mean_ms, p95_ms, index_bytes, build_ms.
    """
    med = lambda c: F.percentile(c, 0.5)
    good = runs.where("ok and algorithm = 'hpa' and weight > 1").groupBy("size", "weight").agg(
        F.count("*").alias("processes"), med("mean_ms").alias("score_ms"), med("p95_ms").alias("p95_ms"), F.min("index_bytes").alias("index_bytes"), med("build_ms").alias("build_ms"), F.bool_and("pass").alias("_pass")
    )
    return good.where("_pass").drop("_pass")


_ORDER = ("p95_ms", "index_bytes", "build_ms", "size", "weight")


def choose(rows: DataFrame) -> DataFrame:
    """The row that wins: fastest with a band of 3 %, then the least p95, index, build, size, weight; none of none."""
    low = rows.agg(F.min("score_ms").alias("_low"))  # one row
    tied = rows.crossJoin(F.broadcast(low)).where(F.col("score_ms") <= F.col("_low") * TIE_BAND).drop("_low")
    return tied.orderBy(*_ORDER).limit(1)


def top_sizes(rows: DataFrame, count: int = 2) -> list[float]:
    """Sizes chosen one after the other, each time without the sizes before; the band is taken anew."""
    out: list[float] = []
    while len(out) < count:
        best = choose(rows.where(~F.col("size").isin(out)) if out else rows).collect()
        if not best:
            break
        out.append(best[0]["size"])
    return out


def coarse_grid(spark, sizes: tuple[int, ...] = SIZES, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    s = spark.createDataFrame([(x,) for x in sizes], "size int")
    w = spark.createDataFrame([(x,) for x in weights], "weight double")
    return s.crossJoin(w)  # two short fixed lists


def fine_sizes(sizes: DataFrame, factors: tuple[float, ...]) -> DataFrame:
    """(size): each size times each factor, rounded half up to 50, kept within the limits, distinct."""
    f = sizes.select("size", F.explode(F.array(*[F.lit(float(x)) for x in factors])).alias("f"))
    step = F.floor(F.col("size") * F.col("f") / FINE_STEP + 0.5) * FINE_STEP
    return f.select(F.greatest(F.lit(FINE_LOW), F.least(F.lit(FINE_HIGH), step)).cast("int").alias("size")).distinct()


def break_even(prep_ms: Column, base_ms: Column, mean_ms: Column) -> Column:
    """Queries after which preparation has paid for itself; null if it never does."""
    return F.when(base_ms > mean_ms, F.ceil(prep_ms / (base_ms - mean_ms)))


def balanced_schedule(pairs: int, a: str = "a", b: str = "b", seed: str = "162164") -> list[tuple[str, str]]:
    """Orders of paired runs: as many (a, b) as (b, a), or one more, in a seeded order."""
    orders = sorted(range(pairs), key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))
    return [(a, b) if i % 2 == 0 else (b, a) for i in orders]
