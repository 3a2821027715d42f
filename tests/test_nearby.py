import random
from collections import Counter

import numpy as np
import pytest

from waygraph.functions.geo import ground_distance
from waygraph.operators import nearby, regions

SCHEMA = "id long, lat double, lon double, a_lat string"


def brute(rows, radius):
    good = {(i, a, o) for i, a, o, *_ in rows if i is not None and a is not None and o is not None and -90 <= a <= 90 and -180 <= o <= 180 and (a, o) != (0, 0)}
    out = set()
    for i, a, o in good:
        for j, b, p in good:
            if i < j and ground_distance(np.array([a]), np.array([o]), np.array([b]), np.array([p]))[0] <= radius:
                out.add((i, j))
    return out


def run(spark, rows, radius=15.0):
    got = [tuple(r) for r in nearby.near_pairs(spark.createDataFrame(rows, SCHEMA), radius).collect()]
    assert len(got) == len(set(got))
    counts = {r.id: r.neighbours for r in nearby.near_counts(spark.createDataFrame(rows, SCHEMA), radius).collect()}
    assert counts == Counter(i for p in got for i in p)
    return set(got)


@pytest.mark.parametrize("lat,lon", [(10.7, 106.7), (-33.0, 179.99995), (0.0, 0.0), (89.9999, 20.0), (-90.0, 0.0)])
def test_like_brute_force(spark, lat, lon):
    rnd = random.Random(4)
    rows = []
    for i in range(150):
        o = lon + rnd.uniform(-3, 3) * 1e-4 * (1 if abs(lat) < 80 else 1e4)
        rows.append((i, max(-90.0, min(90.0, lat + rnd.uniform(-3, 3) * 1e-4)), (o + 180) % 360 - 180, "x"))
    rows += [rows[3], (500, rows[3][1], rows[3][2], None), (501, 0.0, 0.0, None), (502, None, 1.0, None), (503, 0.0, 0.0, None), (None, lat, lon, None), (504, float("nan"), 1.0, None)]
    assert run(spark, rows) == brute([r for r in rows if r[0] != 504], 15.0)


def test_crowded_places_get_many_cells(spark, monkeypatch):
    monkeypatch.setattr(regions, "CELL", 10)
    rnd = random.Random(9)
    rows = [(i, 10 + rnd.random() * 5e-4, 106 + rnd.random() * 5e-4, None) for i in range(200)]
    assert run(spark, rows) == brute(rows, 15.0)


def test_many_ids_at_one_place_and_empty(spark):
    assert run(spark, [(i, 1.0, 1.0, None) for i in range(30)]) == {(i, j) for i in range(30) for j in range(i + 1, 30)}
    assert run(spark, []) == set()


def test_ids_with_several_positions(spark):
    rnd = random.Random(2)
    rows = [(i % 40, 10 + rnd.random() * 5e-4, 106 + rnd.random() * 5e-4, None) for i in range(90)] + [(i, 11.0, 107.0, None) for i in range(35, 45)] + [(3, 11.00001, 107.0, None), (36, 11.00001, 107.0, None)]
    assert run(spark, rows) == brute(rows, 15.0)


def test_a_crowded_place_is_counted_without_its_pairs(spark):
    df = spark.range(100_000).selectExpr("id", "10.5 as lat", "106.5 as lon").union(spark.createDataFrame([(200_000, 10.50001, 106.5)], "id long, lat double, lon double"))
    got = nearby.near_counts(df, 15.0).groupBy("neighbours").count().collect()
    assert {tuple(r) for r in got} == {(100_000, 100_001)}


def even_odd(rings, x, y):
    odd = False
    for ring in rings:
        for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ya > y) != (yb > y) and x < xa + (xb - xa) * (y - ya) / (yb - ya):
                odd = not odd
    return odd


@pytest.mark.parametrize("cell", [2000, 5])
def test_regions_like_even_odd(spark, monkeypatch, cell):
    monkeypatch.setattr(regions, "CELL", cell)
    rnd = random.Random(6)
    shapes = {}
    for k in range(60):
        cx, cy, n = rnd.uniform(0, 10), rnd.uniform(0, 10), rnd.randrange(3, 12)
        star = lambda r, cx=cx, cy=cy, n=n: [(cx + r * rnd.uniform(0.5, 1) * np.cos(2 * np.pi * i / n), cy + r * rnd.uniform(0.5, 1) * np.sin(2 * np.pi * i / n)) for i in range(n)]
        shapes[k] = [star(1.5)] if k % 3 else [star(1.5), [(cx + 0.1, cy), (cx, cy + 0.1), (cx - 0.1, cy), (cx, cy - 0.1)]]
    shapes[100] = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]]
    points = [(i, rnd.uniform(-1, 11), rnd.uniform(-1, 11), "x") for i in range(400)]
    rows = [(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings], 1.0) for k, rings in shapes.items()]
    rows += [(200, None, 1.0), (201, [], 1.0), (202, [[{"x": 1.0, "y": 1.0}, {"x": 2.0, "y": 2.0}]], 1.0), (203, [[{"x": float("nan"), "y": 1.0}, {"x": 2.0, "y": 2.0}, {"x": 3.0, "y": 1.0}]], 1.0), (None, rows[0][1], 1.0)]
    p = spark.createDataFrame([*points, points[0], (None, 1.0, 1.0, "x"), (900, None, 1.0, "x"), (901, float("nan"), 1.0, "x")], "id long, x double, y double, region string")
    r = spark.createDataFrame(rows, "region long, rings array<array<struct<x:double,y:double>>>, x double")
    got = [tuple(g) for g in regions.regions_holding(p, r).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, k) for i, x, y, _ in points for k, rings in shapes.items() if even_odd(rings, x, y)}
    assert regions.regions_holding(p.limit(0), r).count() == regions.regions_holding(p, r.limit(0)).count() == 0
