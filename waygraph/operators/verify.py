"""Independent checks of returned paths against the graph and known answers, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FOUND, NOT_IMPLEMENTED, close

MODES = {"optimal": "optimal", "exact": "optimal", "any": "any", "approximate": "any"}


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): values of key that only a (left) or only b (right) has."""
    x = a.select(key).distinct().withColumn("_a", F.lit(True))
    y = b.select(key).distinct().withColumn("_b", F.lit(True))
    out = x.join(y, key, "full_outer").where("_a is null or _b is null")
    return out.select(key, F.when(F.col("_b").isNull(), "left").otherwise("right").alias("side"))


def path_steps(results: DataFrame) -> DataFrame:
    """(query_id, i, src, dst): successive nodes of every path."""
    pairs = F.arrays_zip(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("src"), F.slice("path", 2, F.greatest(F.size("path"), F.lit(0))).alias("dst"))
    steps = results.where("size(path) > 1").select("query_id", F.posexplode(pairs).alias("i", "s"))
    return steps.select("query_id", "i", "s.src", "s.dst")


def missing_edges(results: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, i, src, dst): path steps that are no edge."""
    return path_steps(results).join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("query_id", "i", "src", "dst")


def path_totals(results: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, total, steps, missing): weights of each path's edges added up again; paths of one node have 0.

    Weights are added as decimals of nine places, so the order of adding makes no difference.
    """
    w = edges.groupBy("src", "dst").agg(F.min("w").alias("w"))
    steps = path_steps(results).join(w, ["src", "dst"], "left")
    agg = steps.groupBy("query_id").agg(F.sum(F.col("w").cast("decimal(28,9)")).alias("t"), F.count("*").alias("steps"), F.count(F.when(F.col("w").isNull(), 1)).alias("missing"))
    every = results.where("size(path) > 0").select("query_id").distinct().join(agg, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return every.select("query_id", zero("t").cast("double").alias("total"), zero("steps").alias("steps"), zero("missing").alias("missing"))


def judged(queries: DataFrame, results: DataFrame, answers: DataFrame, edges: DataFrame, mode: str = "optimal") -> DataFrame:
    """(query_id, error, gap_percent, extra, optimal): a row for each query that has all three.

    queries, results (status, distance, path) and answers (status, distance) by query_id. error is the
    first rule broken, or null. gap_percent is null when the optimum is 0 and the path longer.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    q = queries.select("query_id", "source", "target").distinct()
    r = results.select("query_id", F.col("status").alias("_rs"), F.col("distance").cast("double").alias("_rd"), "path")
    a = answers.select("query_id", F.col("status").alias("_as"), F.col("distance").cast("double").alias("_ad"))
    x = q.join(r, "query_id").join(a, "query_id").join(path_totals(results, edges), "query_id", "left")
    total, optimum = F.col("total"), F.col("_ad")
    hit = F.col("_rs") == FOUND
    ends = (F.element_at("path", 1) == F.col("source")) & (F.element_at("path", -1) == F.col("target"))
    best = close(total, optimum)
    rules: list[tuple[Column, str]] = [
        (F.col("_rs") == NOT_IMPLEMENTED, "not_implemented"),
        (~F.col("_rs").eqNullSafe(F.col("_as")), "wrong_status"),
        (hit & ((F.size("path") < 1) | ~F.coalesce(ends, F.lit(False))), "wrong_ends"),
        (hit & (F.col("source") == F.col("target")) & (F.size("path") != 1), "self_path"),
        (hit & (F.col("missing") > 0), "missing_edge"),
        (hit & ~close(total, F.col("_rd")), "wrong_sum"),
        (hit & (total < optimum) & ~best, "shorter_than_answer"),
    ]
    if MODES[mode] == "optimal":
        rules.append((hit & ~best, "not_optimal"))
    error = F.coalesce(*[F.when(c, F.lit(n)) for c, n in rules])
    counted = hit & F.coalesce(error.isNull() | (error == "not_optimal"), F.lit(True))
    gap = F.when(optimum > 0, F.greatest(F.lit(0.0), (total / F.nullif(optimum, F.lit(0.0)) - 1) * 100)).otherwise(F.when(best, F.lit(0.0)))
    return x.select(
        "query_id", error.alias("error"), F.when(counted, gap).alias("gap_percent"), F.when(counted, F.greatest(F.lit(0.0), total - optimum)).alias("extra"), F.when(counted, best).alias("optimal")
    )


def report(judgement: DataFrame) -> DataFrame:
    """One row: queries, errors, valid, optimal, undefined_gaps, max_gap, mean_gap, max_extra."""
    v = F.col("optimal").isNotNull()
    return judgement.agg(
        F.count("*").alias("queries"), F.count("error").alias("errors"), F.count(F.when(v, 1)).alias("valid"), F.count(F.when(F.col("optimal"), 1)).alias("optimal"),
        F.count(F.when(v & F.col("gap_percent").isNull(), 1)).alias("undefined_gaps"), F.max("gap_percent").alias("max_gap"), F.avg("gap_percent").alias("mean_gap"),
        F.coalesce(F.max("extra"), F.lit(0.0)).alias("max_extra"),
    )


def bound_violations(judgement: DataFrame, weight: float) -> DataFrame:
    """Found queries whose gap is more than the weight allows; an undefined gap is one."""
    return judgement.where(F.col("optimal").isNotNull() & (F.col("gap_percent").isNull() | (F.col("gap_percent") > (weight - 1) * 100 + 1e-6)))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows, hash - the same for the same rows in any order."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.select(h.alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, columns): rows that one has more often than the other; empty if both hold the same."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
