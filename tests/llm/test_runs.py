import random

import numpy as np
import pytest

from waygraph.functions.geo import ground_distance
from waygraph.llm.runs import stops

SCHEMA = "path_id long, lat array<double>, lng array<double>, sampled_at array<long>, start long"


def made(seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(25):
        lat, lng, a, o = [], [], 10.0, 106.0
        for _ in range(rnd.choice([1, 2, 40, 700 if i == 3 else 5])):
            if rnd.random() < 0.4:
                a, o = a + 1e-3, o + 1e-3
            else:
                a += rnd.uniform(0, 1.6e-5)
            lat.append(None if rnd.random() < 0.02 else a)
            lng.append(o)
        t = None if i % 4 == 0 else [None if rnd.random() < 0.05 else k * 10 for k in range(len(lat))]
        rows.append((i, lat, lng, t, i))
    return rows + rows[:5] + [(99, [], [], [], 0), (98, None, None, None, 0), (None, [1.0], [1.0], None, 0)]


def brute(rows):
    out = set()
    for i, lat, lng, t, _ in rows:
        if i is None or not lat:
            continue
        runs = [[0, 0]]
        for k in range(1, len(lat)):
            a, o, b, p = (np.array([np.nan if x is None else x]) for x in (lat[k - 1], lng[k - 1], lat[k], lng[k]))
            if ground_distance(a, o, b, p)[0] <= 3:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        for a, b in runs:
            d = t[b] - t[a] if t and t[a] is not None and t[b] is not None else None
            out.add((i, a, b, b - a + 1, d))
    return out


@pytest.mark.parametrize("chunk", [1, 3, 64, 1024])
def test_like_brute_force(spark, chunk):
    rows = made(chunk)
    got = [(r.path_id, r.start_pos, r.end_pos, r.n_points, r.duration_s) for r in stops(spark.createDataFrame(rows, SCHEMA), chunk=chunk).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_one_stop_over_all_partitions_and_empty(spark):
    n = 500
    df = spark.createDataFrame([(1, [10.0] * n, [20.0] * n, list(range(n)), 0)], SCHEMA)
    got = stops(df, least=2, chunk=7).collect()
    assert [(r.start_pos, r.end_pos, r.n_points, r.duration_s) for r in got] == [(0, n - 1, n, n - 1)]
    assert stops(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [2, 64])
def test_missing_times_are_missing_there_only(spark, chunk):
    n = [10.0, 10.0, 10.0, 11.0, 11.0]
    rows = [(1, n, n, [0, 5, 9, 20, 27], 0), (2, n, n, [0, 5, 9], 0), (3, n, n, [], 0), (4, n, n, [1, 2, 4, 6, 9, 50], 0), (5, n, n, [3, 4, 5, 6, 8], 0), (6, n, n, None, 0)]
    got = {(r.path_id, r.start_pos, r.end_pos): r.duration_s for r in stops(spark.createDataFrame(rows, SCHEMA).coalesce(1), chunk=chunk).collect()}
    want = {1: (9, 7), 2: (9, None), 3: (None, None), 4: (3, 3), 5: (2, 2), 6: (None, None)}
    assert got == {(i, a, b): d for i, x in want.items() for (a, b), d in zip([(0, 2), (3, 4)], x, strict=True)}


def test_no_stage_gathers_a_table_in_one_task(spark):
    df = spark.createDataFrame(made(1), SCHEMA)
    assert "Coalesce 1" not in stops(df)._jdf.queryExecution().toString()
