"""Which regions hold a point: trapezoidal decomposition of the regions' boundaries.

Every region's boundary is cut at its vertices into slabs, in which its edges don't cross; taken in
order from west to east, an edge and the next one bound a trapezoid of the region. The plane is then
cut into strips and each strip by walls, both at quantiles of the trapezoids' own boundaries, so that
a cell has about as many trapezoids wherever they are crowded. Trapezoids go to the cells they meet,
points to the one they lie in, found by binary search; in a cell a point finds the trapezoids that may
hold it by binary search among the ordered west edges, and the edges decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shuffle_width, written
from .sorted_groups import breaks, gather

#: trapezoids a cell has on average, strips and cells a strip at most
CELL, MOST = 2000, 1024
#: strips and cells are this many times as high and wide as an average trapezoid at least
TIMES = 4
_TRAPEZOIDS = "region long, y0 double, y1 double, w0 double, w1 double, e0 double, e1 double"

#: exact check of candidate rows: (columns of the trapezoids, columns of the points) -> which hold
Check = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]


def cut_polygon(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Trapezoids (y0, y1, w0, w1, e0, e1), one a row, of a region with rings x, y that begin at `start`.

    Inside is what an odd number of edges lies west of (holes and islands are further rings). Rings may
    be closed or not; edges must not cross.
    """
    end = np.append(start[1:], len(x))
    nxt = np.arange(1, len(x) + 1)
    nxt[end - 1] = start
    a, b = np.arange(len(x)), nxt
    low, high = np.where(y[a] <= y[b], a, b), np.where(y[a] <= y[b], b, a)
    keep = y[low] < y[high]
    low, high = low[keep], high[keep]
    cuts = np.unique(y)
    out = []
    order = np.argsort(y[low], kind="stable")
    low, high = low[order], high[order]
    first = np.searchsorted(y[low], cuts, "right")
    for i, (y0, y1) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        k = np.flatnonzero(y[high[: first[i]]] >= y1)
        if not len(k):
            continue
        xa, ya, xb, yb = x[low[k]], y[low[k]], x[high[k]], y[high[k]]
        at = lambda v, xa=xa, ya=ya, xb=xb, yb=yb: xa + (xb - xa) * ((v - ya) / (yb - ya))
        x0, x1 = at(y0), at(y1)
        o = np.argsort(x0 + x1, kind="stable")
        west, east = o[0::2], o[1::2]
        west = west[: len(east)]
        out.append(np.stack([np.full(len(east), y0), np.full(len(east), y1), x0[west], x1[west], x0[east], x1[east]], axis=1))
    return np.concatenate(out) if out else np.empty((0, 6))


def trapezoids(regions: DataFrame) -> DataFrame:
    """(region, y0, y1, w0, w1, e0, e1) of regions (region, rings: array of arrays of (x, y)).

    A region of less than three corners, or with a null or non-finite coordinate, has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for region, rings in zip(b.column("region").to_pylist(), b.column("rings").to_pylist(), strict=True):
                points = [np.array([(p["x"], p["y"]) for p in ring], dtype=float) for ring in rings or () if ring]
                if region is None or not points or not np.isfinite(np.concatenate(points)).all():
                    continue
                xy = np.concatenate(points)
                t = cut_polygon(xy[:, 0], xy[:, 1], np.cumsum([0, *map(len, points[:-1])]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), region), pa.int64()), *[pa.array(c) for c in t.T]], names=[c.split()[0] for c in _TRAPEZOIDS.split(", ")])

    return regions.select(F.col("region").cast("long").alias("region"), "rings").mapInArrow(run, _TRAPEZOIDS)


def _thinned(cuts: list[float], least: float) -> list[float]:
    out: list[float] = []
    for c in sorted(set(cuts)):
        if not out or c - out[-1] >= least:
            out.append(c)
    return out


def _quantiles(n: int) -> list[float]:
    return [i / n for i in range(1, n)]


def locate(points: DataFrame, parts: DataFrame, check: Check | None = None) -> DataFrame:
    """(point columns, region columns): pairs of a point and a trapezoid that holds it, boundaries included.

    points: x, y and long or double columns; parts: the columns of `trapezoids` beside others of these
    types, whose names differ from the points'. `check` replaces the trapezoid's edges as the last
    word. parts are read twice and should be a written table. Strips and walls (at most MOST of each
    and MOST ** 2 together) are gathered and broadcast.
    """
    spark = points.sparkSession
    west, east = F.least("w0", "w1"), F.greatest("e0", "e1")
    size = parts.agg(F.count("*").alias("n"), F.avg(F.col("y1") - F.col("y0")).alias("h"), F.avg(east - west).alias("w")).first()
    side = min(MOST, max(1, math.ceil(math.sqrt(size.n / CELL))))
    accuracy = 20 * side + 1000
    strips: list[float] = []
    if side > 1:
        strips = _thinned(parts.agg(F.percentile_approx("y0", _quantiles(side), accuracy)).first()[0], TIMES * size.h)
    strip = lambda c: F.size(F.filter(F.array(*[F.lit(s) for s in strips]).cast("array<double>"), lambda s: s <= c))
    walls = {i: [] for i in range(len(strips) + 1)}
    if side > 1:
        got = parts.groupBy(strip(F.col("y0")).alias("strip")).agg(F.percentile_approx(west, _quantiles(side), accuracy).alias("walls")).collect()
        walls |= {r.strip: _thinned(r.walls, TIMES * size.w) for r in got}
    table = F.broadcast(spark.createDataFrame(list(walls.items()), "strip int, walls array<double>"))
    cell = lambda c: F.size(F.filter("walls", lambda w: w <= c))
    p = points.withColumn("strip", strip(F.col("y"))).join(table, "strip").withColumn("cell", cell(F.col("x"))).drop("walls")
    t = parts.withColumn("west", west).withColumn("strip", F.explode(F.sequence(strip(F.col("y0")), strip(F.col("y1"))))).join(table, "strip")
    t = t.withColumn("cell", F.explode(F.sequence(cell(F.col("west")), cell(east)))).drop("walls")
    both = p.withColumn("kind", F.lit(1)).unionByName(t.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    key = ["strip", "cell"]
    rows = both.repartition(shuffle_width(spark), *key).sortWithinPartitions(*key, "kind", "west")
    ours, theirs = points.columns, parts.columns
    kinds = dict(points.dtypes) | dict(parts.dtypes)
    result = ", ".join(f"{c} {kinds[c]}" for c in (*ours, *theirs))

    def inside(t: dict[str, np.ndarray], p: dict[str, np.ndarray]) -> np.ndarray:
        share = (p["y"] - t["y0"]) / (t["y1"] - t["y0"])
        at = lambda a, b: t[a] + (t[b] - t[a]) * share
        return (p["y"] >= t["y0"]) & (p["y"] <= t["y1"]) & (p["x"] >= at("w0", "w1")) & (p["x"] <= at("e0", "e1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gather(batches)
        if t is None:
            return
        kind = t.column("kind").to_numpy()
        start = breaks(t.column("strip").to_numpy(), t.column("cell").to_numpy())
        of = np.repeat(np.arange(len(start)), np.diff(np.append(start, t.num_rows)))
        region, point = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        if not len(region) or not len(point):
            return
        a = {c: t.column(c).take(pa.array(region)).to_numpy() for c in theirs}
        b = {c: t.column(c).take(pa.array(point)).to_numpy() for c in ours}
        left, right = np.minimum(a["w0"], a["w1"]), np.maximum(a["e0"], a["e1"])
        lo, hi = _between(of[region], left, right, of[point], b["x"])
        n = np.maximum(hi - lo, 0)
        total = np.cumsum(n)
        first = 0
        while first < len(n):  # some million candidates at a time
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + (1 << 20), "right")))
            k = n[first:last]
            i = np.repeat(np.arange(first, last), k)
            j = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[first:last], k)
            x, y = {c: v[j] for c, v in a.items()}, {c: v[i] for c, v in b.items()}
            ok = (check or inside)(x, y)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(v[ok]) for v in (*y.values(), *x.values())], names=[*ours, *theirs])
            first = last

    return rows.mapInArrow(run, result)


def _between(cell: np.ndarray, left: np.ndarray, right: np.ndarray, of: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the range of trapezoids, ordered by cell and west edge, among which are all that hold it.

    The greatest east edge so far never falls within a cell, so both ends are found by binary search,
    over all cells at once: places in a cell are ranks among its edges and points.
    """
    number, values = np.concatenate([cell, cell, of]), np.concatenate([left, _running_max(cell, right), x])
    order = np.lexsort((values, number))
    rank = np.empty(len(order), "i8")
    new = np.append(True, (np.diff(number[order]) != 0) | (np.diff(values[order]) != 0))
    rank[order] = np.cumsum(new)
    r_left, r_far, r_x = np.split(rank, [len(cell), 2 * len(cell)])
    return np.searchsorted(r_far, r_x, "left"), np.searchsorted(r_left, r_x, "right")


def _running_max(cell: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Greatest value so far in each cell; cells are contiguous."""
    order = np.argsort(np.argsort(right, kind="stable"), kind="stable")
    base = cell.astype("i8") - (cell[0] if len(cell) else 0)
    best = np.maximum.accumulate(order + base * (len(right) + 1)) - base * (len(right) + 1)
    return np.sort(right)[best]


def regions_holding(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(id, region): regions (region, rings) that hold a point (id, x, y), boundaries included; each pair once.

    Points with a null or non-finite coordinate or a null id, and regions with a null number, give no
    row; regions may overlap. Extra columns are ignored; an empty table gives none.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    p = points.where(F.col("id").isNotNull() & finite("x") & finite("y")).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return locate(p, written(trapezoids(regions), "trapezoids")).select("id", "region").distinct()
