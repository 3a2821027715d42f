import random
import statistics
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from waygraph.operators.spikes import ABOVE, BELOW, DAY_NS, PRIOR, frozen_readings, implausible, peaks_over_threshold, tail_cutoffs, tail_grid

SCHEMA = "query_id long, repetition int, duration_ns long, wait_ns long, recorded_at timestamp, worker string"


def brute(rows):
    out = set()
    by = defaultdict(dict)
    for q, r, d, w, *_ in rows:
        if q is not None and r is not None:
            by[q][r] = (d, w)
    for q, reps in by.items():
        for f, low in ((0, 1), (1, 0)):
            valid = [v[f] for v in reps.values() if v[f] is not None and low <= v[f] <= DAY_NS]
            for r, v in reps.items():
                if v[f] is not None and not low <= v[f] <= DAY_NS:
                    out.add((q, r))
            if valid:
                m = statistics.median(valid)
                s = statistics.median(abs(x - m) for x in valid)
                for r, v in reps.items():
                    if v[f] is not None and low <= v[f] <= DAY_NS and (v[f] - m > 10 * s or f == 0 and m - v[f] > 10 * s):
                        out.add((q, r))
            seq = [(r, reps[r][f]) for r in sorted(reps) if reps[r][f] is not None]
            i = 0
            while i < len(seq):
                j = i
                while j < len(seq) and seq[j][1] == seq[i][1]:
                    j += 1
                if j - i >= 5 and seq[i][1] != 0:
                    out |= {(q, r) for r, _ in seq[i:j]}
                i = j
    return out


def found(spark, rows, schema=SCHEMA):
    got = implausible(spark.createDataFrame(rows, schema)).where("impossible or far or frozen").collect()
    assert len(got) == len({(r.query_id, r.repetition) for r in got})
    return {(r.query_id, r.repetition) for r in got}


def made(seed, hot=True):
    rnd = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    rows = []
    for q in range(12):
        n = 900 if hot and q == 3 else rnd.randrange(1, 60)
        stuck = None
        for r in range(1, n + 1):
            if rnd.random() < 0.05:
                continue
            d = int(rnd.gauss(1_000_000, 20_000))
            w = max(0, int(rnd.gauss(3000, 900)))
            if rnd.random() < 0.03:
                d = rnd.choice([0, -5, DAY_NS + 1, DAY_NS, 1, 90_000_000, None])
            if rnd.random() < 0.03:
                w = rnd.choice([-1, 0, 10**7, None])
            stuck = stuck if stuck and rnd.random() < 0.8 else (w if rnd.random() < 0.05 else None)
            rows.append((q, r, d, stuck if stuck is not None else w, t0 + timedelta(minutes=37 * r), "w"))
    return rows + rows[::17]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = made(seed)
    random.Random(seed).shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_frozen_over_partitions(spark):
    t = datetime(2024, 1, 1)
    rows = [(7, r, 5, 0 if r % 2 else 1, t, "w") for r in range(1, 400)] + [(8, r, r, None, t, "w") for r in range(1, 5)]
    rows += [(9, 10 * r, 77 if r < 5 else 78, r, t, "w") for r in range(1, 9)]
    assert found(spark, rows) == brute(rows)


def test_nulls_empty_and_one_reading(spark):
    t = datetime(2024, 1, 1)
    assert found(spark, []) == set()
    rows = [(1, 1, None, None, None, None), (None, 1, 5, 5, t, "x"), (2, None, -5, 5, t, "x"), (3, 1, 4, 4, None, "x")]
    assert found(spark, rows) == set()
    assert found(spark, [(1, r, 5, 0, t, None) for r in (1, 2, 3)] + [(1, 4, 6, 0, t, None)]) == {(1, 4)}


def fitted(e, n, u, cap, risk):
    mean, most = np.array([e.mean()]), np.array([e.max()])
    grid = tail_grid(mean, most)
    logs = np.log1p(grid / mean * e).sum(axis=1, keepdims=True)
    return [x[0] for x in tail_cutoffs(np.array([n]), np.array([len(e)]), mean, grid, logs, np.array([u]), np.array([cap]), risk)]


@pytest.mark.parametrize("shape", [-0.3, 0.0, 0.4])
def test_pareto_cutoff_holds_its_risk(shape):
    rng = np.random.default_rng(3)
    y = rng.random(200_000)
    x = -np.log(y) if shape == 0 else (y**-shape - 1) / shape
    u = np.quantile(x, 0.98)
    e = x[x > u] - u
    got, scale, cut = fitted(e, len(x), u, np.inf, 1e-4)
    assert abs(got - shape) < 0.12 and abs(scale / (1 + shape * u) - 1) < 0.15
    assert 0.3e-4 < (x > cut).mean() < 3e-4


def test_one_peak_and_equal_peaks_have_a_finite_cutoff():
    for e in (np.array([2.0]), np.full(50, 3.0)):
        assert np.isfinite(fitted(e, 1000, 1.0, np.inf, 1e-5)[2])
    assert fitted(np.array([2.0]), 1000, 1.0, 5.0, 1e-5)[2] == 5.0


def brute_tails(rows, risk=1e-5):
    """{(query, repetition, field)} beyond the cutoff, by a plain search of the likelihood's grid."""
    out = set()
    by = {(q, r): (d, w, t) for q, r, d, w, t, *_ in rows if q is not None and r is not None}
    for q in {k[0] for k in by}:
        for f, low in ((0, 1), (1, 0)):
            x = [(r, v[f], v[2].hour) for (k, r), v in by.items() if k == q and v[f] is not None and low <= v[f] <= DAY_NS]
            if not x:
                continue
            m = statistics.median(v for _, v, _ in x)
            s = statistics.median(abs(v - m) for _, v, _ in x)
            clip = lambda v, m=m, s=s: max(-10 * s, min(10 * s, v - m))
            mid = statistics.fmean(clip(v) for _, v, _ in x)
            level = {h: statistics.fmean(clip(v) for _, v, g in x if g == h) - mid for h in {g for *_, g in x}}
            cap = 10 * s - max(map(abs, level.values()))
            u = min(3 * s, cap)
            size = {r: (abs(v - m - level[h]) if f == 0 else v - m - level[h]) for r, v, h in x}
            e = [z - u for z in size.values() if z > u]
            if not e:
                continue
            best = (-np.inf, 0, 0)
            mean = statistics.fmean(e)
            for t in [b * mean / max(e) for b in BELOW] + [0.0, *ABOVE]:
                xi = statistics.fmean(np.log1p(t * z / mean) for z in e)
                scale = xi / t if t else 1.0
                if xi >= -0.5:
                    fit = -np.log(scale) - xi - xi * xi / (2 * PRIOR**2 * len(e))
                    best = max(best, (fit, xi, scale), key=lambda b: b[0])
            _, xi, scale = best
            p = risk * len(x) / len(e)
            over = mean * scale * ((p**-xi - 1) / xi if xi else -np.log(p))
            cut = min(cap, u + max(over, 0))
            out |= {(q, r, f) for r, z in size.items() if z > cut}
    return out


def test_the_fitted_tail_decides(spark):
    rows = made(4)
    got = peaks_over_threshold(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.query_id, r.repetition, r.field) for r in got} == brute_tails(rows)
    assert any(r.far for r in got) and any(not r.far for r in got)
    flags = implausible(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.tail for r in flags if r.far)


def test_no_stage_gathers_a_table_in_one_task(spark):
    df = spark.createDataFrame(made(5), SCHEMA)
    assert "Coalesce 1" not in frozen_readings(df)._jdf.queryExecution().toString()
