"""Percentiles per group over very many values, and summaries that can be put together.

percentiles: exact. A distributed sort places every value; per-partition counts give each group's
offsets; the neighbouring order statistics at the wanted position are looked up and interpolated.

summaries / combined: one sorted pass per part (day, file) keeps, of each group, one value of every
block of max(1, floor(2 * error * n)) successive values, with the block's size as weight. The summaries of any parts are
united and read by cumulative weight. Kept is the middle value of a block, so a rank read in a part
is off by at most half a block, error * n; over all parts by at most error * N (and one): that is
the stated bound, a bound on the rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sorted_groups import sort_groups

#: error of a rank as a share of a group's readings, in combined()
RANK_ERROR = 0.001
PROBS = ("0.5", "0.95", "0.99")


def _name(p: str) -> str:
    x = Fraction(p) * 100
    return "median" if x == 50 else "p" + (str(x.numerator) if x.denominator == 1 else str(float(x)).replace(".", "_"))


def _spot(n: Column, p: str) -> tuple[Column, Column]:
    """Whole position (n - 1) * p and the rest as a numerator; whole numbers only."""
    f = Fraction(p)
    at = (n.cast("long") - 1) * f.numerator
    return F.floor(at / f.denominator).cast("long"), at % f.denominator


def _readings(df: DataFrame, *groups: str) -> DataFrame:
    """Rows with a group and a value; a null tie is a tie of its own, apart from all numbers."""
    df = df.dropna(subset=[*groups, "v"])
    return df.withColumn("no_tie", F.col("tie").isNull().cast("long")).withColumn("tie", F.coalesce("tie", F.lit(0).cast("long")))


def percentiles(df: DataFrame, group: str, value: str, tie: str, probs: Sequence[str] = PROBS) -> DataFrame:
    """(group, n, median, p95, p99): exact interpolated percentiles of `value`, linear between ranks.

    Null values and null groups take no part; a group with null values only gives no row. Rows equal
    in (group, value, tie) are one reading, null being a tie like any other. Equal values of different readings count each. One reading
    gives itself at every percentile. An empty table gives no row; extra columns are ignored. Values
    are 64-bit integers; interpolation is in doubles, so exact for values up to 2^52.
    """
    fr = [Fraction(p) for p in probs]
    x = _readings(df.select(F.col(group).cast("long").alias("g"), F.col(value).cast("long").alias("v"), F.col(tie).cast("long").alias("tie")), "g")
    answer = T.StructType([T.StructField("g", T.LongType()), T.StructField("n", T.LongType())] + [T.StructField(_name(p), T.DoubleType()) for p in probs])

    def local(c: dict[str, np.ndarray], start: np.ndarray, end: np.ndarray) -> pa.Table:
        n, v = end - start, c["v"]
        out = {"g": c["g"][start], "n": n}
        for p, f in zip(probs, fr, strict=True):
            at = (n - 1) * f.numerator
            lo, rem = at // f.denominator, at % f.denominator
            a = v[start + lo].astype("f8")
            b = v[start + lo + (rem > 0)].astype("f8")
            out[_name(p)] = a + (b - a) * rem / f.denominator
        return pa.table(out)

    srt = sort_groups(x, ["g"], "v", ["tie", "no_tie"], [], local, answer, "percentiles")
    spots = {}
    for i, p in enumerate(probs):
        spots[f"lo{i}"] = lambda n, p=p: _spot(n, p)[0]
        spots[f"hi{i}"] = lambda n, p=p: _spot(n, p)[0] + (_spot(n, p)[1] > 0).cast("long")
    found = srt.at_positions(spots)
    n = F.col("_n")
    lo, hi = (lambda i: F.col(f"lo{i}").cast("double")), (lambda i: F.col(f"hi{i}").cast("double"))
    split = found.select(
        "g", n.alias("n"),
        *[(lo(i) + (hi(i) - lo(i)) * _spot(n, p)[1] / fr[i].denominator).alias(_name(p)) for i, p in enumerate(probs)],
    )
    return srt.finished().unionByName(split).withColumnRenamed("g", group)


def summaries(df: DataFrame, part: Column, group: str, value: str, tie: str, error: float = RANK_ERROR) -> DataFrame:
    """(part, group, value, weight): each part's summary, at most 1 / (2 * error) + 1 rows a group or all its values.

    `part` is a whole-number expression, such as the day since the epoch. Nulls take no part. The
    weights of a (part, group) add up to its number of readings.
    """
    x = _readings(
        df.select(part.cast("long").alias("part"), F.col(group).cast("long").alias("g"), F.col(value).cast("long").alias("v"), F.col(tie).cast("long").alias("tie")), "part", "g"
    )
    answer = T.StructType([T.StructField(k, T.LongType()) for k in ("part", "g", "v", "weight")])

    def local(c: dict[str, np.ndarray], start: np.ndarray, end: np.ndarray) -> pa.Table:
        n = end - start
        block = np.maximum(1, np.floor(2 * error * n).astype("i8"))
        k = -(-n // block)
        first = np.repeat(start, k)
        i = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        lo = i * np.repeat(block, k)
        hi = np.minimum(lo + np.repeat(block, k), np.repeat(n, k))
        return pa.table({"part": np.repeat(c["part"][start], k), "g": np.repeat(c["g"][start], k), "v": c["v"][first + (lo + hi - 1) // 2], "weight": hi - lo})

    srt = sort_groups(x, ["part", "g"], "v", ["tie", "no_tie"], [], local, answer, "summaries")
    over = Window.partitionBy("part", "g").orderBy("_pid")
    counts = srt.split_counts().select(
        "part", "g", "_pid", "_start", (F.sum("_n").over(over) - F.col("_n")).alias("off"), F.sum("_n").over(Window.partitionBy("part", "g")).alias("n")
    )
    # at most two split groups a partition: a small table
    rows = srt.split_rows().join(F.broadcast(counts), ["part", "g", "_pid"])
    rank = F.col("_at") - F.col("_start") + F.col("off")
    block = F.greatest(F.lit(1).cast("long"), F.floor(2 * error * F.col("n")))
    rows = rows.withColumn("rank", rank).withColumn("lo", F.floor(F.col("rank") / block).cast("long") * block)
    rows = rows.withColumn("hi", F.least(F.col("lo") + block, F.col("n")))
    split = rows.where(F.col("rank") == F.floor((F.col("lo") + F.col("hi") - 1) / 2)).select("part", "g", "v", (F.col("hi") - F.col("lo")).cast("long").alias("weight"))
    return srt.finished().unionByName(split).select("part", F.col("g").alias(group), F.col("v").alias(value), "weight")


def combined(summary: DataFrame, group: str, value: str, probs: Sequence[str] = PROBS) -> DataFrame:
    """(group, n, median, p95, p99, rank_error) for the union of any parts of `summary`.

    The value of the summary whose cumulative weight first exceeds (n - 1) * p; its true rank is within
    rank_error of it. rank_error is the half of the largest block, summed over the parts.
    """
    per = summary.groupBy("part", group).agg(F.max("weight").alias("block"))
    bound = per.groupBy(group).agg(F.sum(F.ceil(F.col("block") / 2)).cast("long").alias("rank_error"))
    # a hot group's summary has at most 1 / (2 * error) + 1 rows a part, whatever its number of readings
    same = summary.groupBy(group, value).agg(F.sum("weight").alias("weight"))
    over = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = same.withColumn("cum", F.sum("weight").over(over)).withColumn("n", F.sum("weight").over(Window.partitionBy(group)))
    picked = cum.groupBy(group, "n").agg(
        *[F.min(F.when(F.col("cum") > _spot(F.col("n"), p)[0], F.col(value))).cast("double").alias(_name(p)) for p in probs]
    )
    return picked.join(bound, group)
