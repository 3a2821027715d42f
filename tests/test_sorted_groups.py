import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import types as T

from waygraph.operators.sorted_groups import sort_groups

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests

ANSWER = T.StructType([T.StructField("g", T.LongType()), T.StructField("top", T.LongType())])


def top(c, start, end):
    return pa.table({"g": c["g"][start], "top": c["v"][end - 1]})


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_every_group_is_whole_or_split_once(spark, partitions):
    rng = np.random.default_rng(5)
    rows = [(int(g), int(v), i) for i, (g, v) in enumerate(zip(rng.choice([1, 2, 3, 4, 5, 6, 7, 8], 600, p=[0.5] + [0.5 / 7] * 7), rng.integers(-50, 50, 600)))]
    rows += rows[:40]  # repeated rows
    df = spark.createDataFrame(rows, "g long, v long, t long")
    s = sort_groups(df, ["g"], "v", ["t"], [], top, ANSWER, partitions=partitions)
    want = {}
    for g, v, _ in dict.fromkeys(rows):
        want.setdefault(g, []).append(v)
    mid = {r.g: (r._n, r.m) for r in s.at_positions({"m": lambda n: n - 1}).collect()}
    done = {r.g: r.top for r in s.finished().collect()}
    assert not set(mid) & set(done)
    assert set(mid) | set(done) == set(want)
    assert all(mid[g] == (len(want[g]), max(want[g])) for g in mid)
    assert all(done[g] == max(want[g]) for g in done)


def test_empty(spark):
    s = sort_groups(spark.createDataFrame([], "g long, v long, t long"), ["g"], "v", ["t"], [], top, ANSWER)
    assert s.finished().count() == 0 and s.at_positions({"m": lambda n: n - 1}).count() == 0
