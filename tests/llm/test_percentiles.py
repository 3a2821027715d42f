import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from waygraph.llm.percentiles import combined, percentiles, summaries

SCHEMA = "query_id long, repetition int, duration_ns long, day long, median string"


def rows_of(seed):
    rnd = random.Random(seed)
    rows = []
    for q in range(15):
        for r in range(4000 if q == 5 else rnd.randrange(1, 90)):
            rows.append((q, r, rnd.choice([rnd.randrange(-5, 10**6), 7, None]), rnd.randrange(4), "x"))
    return rows + rows[::13]


def values(rows):
    by = defaultdict(list)
    for q, r, v, *_ in dict.fromkeys(rows):
        if v is not None:
            by[q].append(v)
    return {q: sorted(v) for q, v in by.items()}


def exact(v, p):
    at = (len(v) - 1) * Fraction(p)
    lo = int(at)
    hi = min(lo + 1, len(v) - 1)
    return float(v[lo] + (v[hi] - v[lo]) * (at - lo))


@pytest.mark.parametrize("seed", [1, 2])
def test_exact(spark, seed):
    rows = rows_of(seed)
    random.Random(seed).shuffle(rows)
    want = values(rows)
    got = {r.query_id: r for r in percentiles(spark.createDataFrame(rows, SCHEMA), "query_id", "duration_ns", "repetition").collect()}
    assert set(got) == set(want)
    for q, v in want.items():
        assert got[q].n == len(v)
        for name, p in (("median", "0.5"), ("p95", "0.95"), ("p99", "0.99")):
            assert got[q][name] == pytest.approx(exact(v, p), abs=1e-6)


@pytest.mark.parametrize("error", [0.001, 0.02])
def test_combined_keeps_its_bound(spark, error):
    rows = rows_of(3)
    want = values(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    parts = summaries(df, F.col("day"), "query_id", "duration_ns", "repetition", error)
    weight = {r.query_id: r.w for r in parts.groupBy("query_id").agg(F.sum("weight").alias("w")).collect()}
    assert weight == {q: len(v) for q, v in want.items()}
    for r in combined(parts, "query_id", "duration_ns").collect():
        v = want[r.query_id]
        assert r.n == len(v) and r.rank_error <= error * len(v) + 4
        for name, p in (("median", 0.5), ("p95", 0.95), ("p99", 0.99)):
            at = (len(v) - 1) * p
            lo, hi = np.searchsorted(v, r[name], "left"), np.searchsorted(v, r[name], "right") - 1
            assert lo - r.rank_error - 1 <= at <= hi + r.rank_error + 1


def test_empty_nulls_and_overflow(spark):
    df = spark.createDataFrame([(1, 1, None, 0, ""), (None, 1, 5, 0, ""), (2, 1, 2**62, 0, ""), (2, 2, -(2**62), 0, "")], SCHEMA)
    got = percentiles(df, "query_id", "duration_ns", "repetition").collect()
    assert [(r.query_id, r.n, r.median) for r in got] == [(2, 2, 0.0)]
    assert percentiles(df.limit(0), "query_id", "duration_ns", "repetition").count() == 0
    assert combined(summaries(df.limit(0), F.col("day"), "query_id", "duration_ns", "repetition"), "query_id", "duration_ns").count() == 0


def test_a_null_tie_is_a_reading(spark):
    rows = [(1, None, 10), (1, 0, 10), (1, 1, 40), (1, None, 70), (1, None, 70), (2, None, 5), (3, 1, None)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    got = {r.query_id: (r.n, r["median"]) for r in percentiles(df, "query_id", "duration_ns", "repetition").collect()}
    assert got == {1: (4, 25.0), 2: (1, 5.0)}
    kept = summaries(df, F.col("day"), "query_id", "duration_ns", "repetition").groupBy("query_id").agg(F.sum("weight").alias("n")).collect()
    assert {r.query_id: r.n for r in kept} == {1: 4, 2: 1}
