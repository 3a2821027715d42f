"""Implausible readings per source: peaks over threshold, frozen stretches, plausibility.

Every reading of a numeric field is judged against its own source:

* impossible  - outside the field's plausible range;
* tail        - peak of the seasonal residual beyond the cutoff that a generalised Pareto tail, fitted
                to all peaks of the source by maximum likelihood, sets at a fixed risk;
* far         - such a reading that also lies beyond the robust distance (10 s from m);
* frozen      - five or more successive readings (by repetition, nulls left out) with one non-zero value.

Residuals are taken from the source's hourly level; the threshold over which residuals count as peaks
is the smaller of 3 s and 10 s less the largest hourly shift, and the cutoff at most the latter, so that
no reading beyond 10 s of its source's median can stay below it. The robust rule is then checked on
the readings beyond the cutoff only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import sort_width, written
from .sorted_groups import breaks, gather, sort_groups

DAY_NS = 86_400_000_000_000


@dataclass(frozen=True)
class Field:
    """A judged field: its column, plausible range, and whether low values can be far off too."""

    column: str
    low: int
    high: int
    both_sides: bool


TIMING_FIELDS = (Field("duration_ns", 1, DAY_NS, True), Field("wait_ns", 0, DAY_NS, False))


@dataclass(frozen=True)
class Params:
    far: float = 10.0
    peak: float = 3.0
    risk: float = 1e-5
    stuck: int = 5


#: places at which a tail's profile likelihood is taken, of excesses over their mean: shape over scale,
#: below 0 as a share of the least possible value, above 0 as it is, and 0 (an exponential tail)
BELOW = tuple(-(19 - 2 * j) / 20 for j in range(10))
ABOVE = tuple(2 ** (j / 2) for j in range(-8, 15))
#: least shape, and the spread of shapes about 0 that is taken for granted before any peak is seen
LEAST_SHAPE, PRIOR = -0.5, 0.3


def tail_grid(mean: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Grid of shape / scale, one row a place and one column a tail with these mean and greatest excesses."""
    limit = mean / most
    return np.concatenate([np.outer(BELOW, limit), np.zeros((1, len(mean))), np.outer(ABOVE, np.ones(len(mean)))])


def tail_cutoffs(n: np.ndarray, k: np.ndarray, mean: np.ndarray, grid: np.ndarray, logs: np.ndarray, u: np.ndarray, cap: np.ndarray, risk: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shape, scale, cutoff) of generalised Pareto tails over u by maximum likelihood, one a column.

    n readings and k >= 1 peaks with mean excess; logs: sums of log(1 + grid * excess / mean). On the
    profile (Grimshaw) the shape is logs / k and the scale shape / grid, so the likelihood needs no
    more than these sums, which add up over partitions. A weak normal prior keeps the shape near 0
    where there are few peaks; one peak gives an exponential tail. The cutoff is exceeded by a share
    `risk` of readings; one beyond `cap` is brought back to it, since spikes among the peaks can make
    a tail so heavy that it would hide them.
    """
    with np.errstate(all="ignore"):
        shape = logs / k
        scale = np.where(grid == 0, 1.0, shape / np.where(grid == 0, 1.0, grid))
        fit = np.where(shape >= LEAST_SHAPE, -np.log(scale) - shape - shape * shape / (2 * PRIOR * PRIOR * k), -np.inf)
        best = np.argmax(fit, axis=0), np.arange(len(k))
        shape, scale = shape[best], scale[best] * mean
        x = risk * n / k
        over = np.where(shape == 0, -scale * np.log(x), scale / np.where(shape == 0, 1, shape) * (x**-shape - 1))
        return shape, scale, np.minimum(u + np.maximum(over, 0), cap)


_FLAGS = T.StructType(
    [
        T.StructField("query_id", T.LongType()), T.StructField("field", T.IntegerType()), T.StructField("repetition", T.LongType()),
        T.StructField("value", T.LongType()), T.StructField("far", T.BooleanType()),
        T.StructField("m", T.DoubleType()), T.StructField("s", T.DoubleType()), T.StructField("cutoff", T.DoubleType()),
    ]
)


def _median(v: np.ndarray) -> float:
    n = len(v)
    h = n // 2
    if n % 2:
        return float(np.partition(v, h)[h])
    p = np.partition(v, [h - 1, h])
    return (float(p[h - 1]) + float(p[h])) / 2


def _peaks(v: np.ndarray, hour: np.ndarray, both: bool, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[float, ...]]:
    """Peaks (indices), their size and far flag of one source's sorted values; (m, s, threshold, cap)."""
    n = len(v)
    h = n // 2
    m = float(v[h]) if n % 2 else (float(v[h - 1]) + float(v[h])) / 2
    d = v - m
    s = _median(np.abs(d))
    clipped = np.clip(d, -p.far * s, p.far * s)
    level = np.bincount(hour, clipped, 24)
    count = np.bincount(hour, minlength=24)
    level = np.where(count > 0, level / np.maximum(count, 1), 0.0) - clipped.mean()
    cap = p.far * s - float(np.abs(np.where(count > 0, level, 0.0)).max())
    u = min(p.peak * s, cap)
    r = d - level[hour]
    size = np.abs(r) if both else r
    peaks = np.flatnonzero(size > u)
    far = (np.abs(d[peaks]) if both else d[peaks]) > p.far * s
    return peaks, size[peaks], far, (m, s, u, cap)


def peaks_over_threshold(df: DataFrame, fields: tuple[Field, ...] = TIMING_FIELDS, params: Params = Params()) -> DataFrame:
    """Readings beyond their source's tail cutoff, one row per (reading, field); far: beyond 10 s as well.

    df: query_id, repetition, recorded_at and the fields' columns. Null or impossible values of a field
    take no part in that field. A source with one reading has s = 0 and no peak; equal readings give
    s = 0 and every other value is far. Repeated rows count once.
    """
    both = [f.both_sides for f in fields]
    hour = F.coalesce(F.hour("recorded_at"), F.lit(0)).cast("int")
    parts = [
        F.when(F.col(f.column).between(f.low, f.high), F.struct(F.lit(i).cast("int").alias("field"), F.col(f.column).cast("long").alias("value")))
        for i, f in enumerate(fields)
    ]
    long = (
        df.where(F.col("query_id").isNotNull() & F.col("repetition").isNotNull())
        .select("query_id", F.col("repetition").cast("long").alias("repetition"), hour.alias("hour"), F.explode(F.array(*parts)).alias("x"))
        .where("x is not null")
        .select("query_id", "x.field", "x.value", "repetition", "hour")
    )

    def local(c: dict[str, np.ndarray], start: np.ndarray, end: np.ndarray) -> pa.Table:
        at, sizes, fars, about, count, total = [], [], [], [], [], []
        for a, b in zip(start, end, strict=True):
            peaks, size, far, numbers = _peaks(c["value"][a:b], c["hour"][a:b], both[int(c["field"][a])], params)
            if len(peaks):
                at.append(peaks + a)
                sizes.append(size)
                fars.append(far)
                about.append(numbers)
                count.append(len(peaks))
                total.append(b - a)
        if not at:
            return pa.table({f.name: pa.array([], pa.float64()) for f in _FLAGS.fields})
        at, size, far, k = np.concatenate(at), np.concatenate(sizes), np.concatenate(fars), np.array(count)
        m, s, u, cap = np.array(about).T
        first = np.cumsum(k) - k
        excess = size - np.repeat(u, k)
        mean, most = np.add.reduceat(excess, first) / k, np.maximum.reduceat(excess, first)
        grid = tail_grid(mean, most)
        logs = np.stack([np.add.reduceat(np.log1p(np.repeat(g / mean, k) * excess), first) for g in grid])
        cut = tail_cutoffs(np.array(total), k, mean, grid, logs, u, cap, params.risk)[2]
        hit = size > np.repeat(cut, k)
        at = at[hit]
        out = {x: c[x][at] for x in ("query_id", "field", "repetition", "value")}
        return pa.table(out | {"far": far[hit]} | {x: np.repeat(y, k)[hit] for x, y in (("m", m), ("s", s), ("cutoff", cut))})

    g = ["query_id", "field"]
    srt = sort_groups(long, g, "value", ["repetition"], ["hour"], local, _FLAGS, "spikes")
    return srt.finished().unionByName(_split_peaks(srt, both, params))


def _middle(srt, name: str) -> DataFrame:
    mid = srt.at_positions({"_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.floor(n / 2)})
    return mid.select(*srt.group, F.col("_n").alias("n"), ((F.col("_lo") + F.col("_hi")) / 2).alias(name))


def _split_peaks(srt, both: list[bool], p: Params) -> DataFrame:
    """The same judgement for groups split over partitions (at most two a partition), by aggregates."""
    g = srt.group
    rows = srt.split_rows()
    centre = _middle(srt, "m")
    # four times the distance from m is a whole number, since m is a multiple of a half
    dist = rows.join(F.broadcast(centre.select(*g, "m")), g).select(
        *g, F.abs(F.col("value") * 4 - F.col("m") * 4).cast("long").alias("value"), "repetition"
    )
    empty = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("field", T.IntegerType()), T.StructField("s4", T.DoubleType())])

    def local(c: dict[str, np.ndarray], start: np.ndarray, end: np.ndarray) -> pa.Table:
        n = end - start
        s4 = (c["value"][start + (n - 1) // 2] + c["value"][start + n // 2]) / 2
        return pa.table({"query_id": c["query_id"][start], "field": c["field"][start], "s4": s4})

    again = sort_groups(dist, g, "value", ["repetition"], [], local, empty, "spread")
    spread = again.finished().unionByName(_middle(again, "s4").select(*g, "s4"))
    stats = centre.join(spread, g).select(*g, "n", "m", (F.col("s4") / 4).alias("s"))
    stats = written(stats, "centre")
    x = rows.join(F.broadcast(stats), g).withColumn("d", F.col("value") - F.col("m"))
    x = x.withColumn("c", F.greatest(F.least("d", p.far * F.col("s")), -p.far * F.col("s")))
    hourly = x.groupBy(*g, "hour").agg(F.sum("c").alias("t"), F.count("*").alias("k"))
    over = Window.partitionBy(*g)
    level = hourly.select(*g, "hour", (F.col("t") / F.col("k") - F.sum("t").over(over) / F.sum("k").over(over)).alias("level"))
    level = level.withColumn("shift", F.max(F.abs("level")).over(over))
    cap = p.far * F.col("s") - F.col("shift")
    two = F.array(*[F.lit(b) for b in both])[F.col("field")]
    side = lambda c: F.when(two, F.abs(c)).otherwise(c)
    peaks = (
        x.join(F.broadcast(level), [*g, "hour"])
        .withColumn("cap", cap)
        .withColumn("u", F.least(p.peak * F.col("s"), F.col("cap")))
        .withColumn("size", side(F.col("d") - F.col("level")))
        .where("size > u")
        .withColumn("e", F.col("size") - F.col("u"))
    )
    first = [F.first(c).alias(c) for c in ("u", "cap")]
    about = written(peaks.groupBy(*g).agg(F.first("n").cast("double").alias("n"), F.count("*").cast("double").alias("k"), F.avg("e").alias("mean"), F.max("e").alias("most"), *first), "tails")

    def add_logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a batch; its rows come group by group."""
        for b in batches:
            if not b.num_rows:
                continue
            c = {k: b.column(k).to_numpy() for k in (*g, "e", "mean", "most")}
            start = breaks(c["query_id"], c["field"])
            k = np.diff(np.append(start, b.num_rows))
            grid = tail_grid(c["mean"][start], c["most"][start])
            sums = [np.add.reduceat(np.log1p(np.repeat(t / c["mean"][start], k) * c["e"]), start) for t in grid]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(c["query_id"][start], len(grid)), pa.int64()), pa.array(np.tile(c["field"][start], len(grid)), pa.int32()),
                    pa.array(np.repeat(np.arange(len(grid)), len(start)), pa.int32()), pa.array(np.concatenate(sums), pa.float64()),
                ],
                names=["query_id", "field", "place", "logs"],
            )

    parts = peaks.select(*g, "e").join(F.broadcast(about.select(*g, "mean", "most")), g).mapInArrow(add_logs, "query_id long, field int, place int, logs double")
    # a sum a place of the grid: as many as the grid has
    logs = parts.groupBy(*g, "place").agg(F.sum("logs").alias("logs")).groupBy(*g).agg(F.sort_array(F.collect_list(F.struct("place", "logs"))).alias("logs"))

    def solve(frames):
        for f in frames:
            if len(f):
                c = {k: f[k].to_numpy() for k in ("n", "k", "mean", "most", "u", "cap")}
                sums = np.array([[x["logs"] for x in row] for row in f["logs"]]).T
                f["cutoff"] = tail_cutoffs(c["n"], c["k"], c["mean"], tail_grid(c["mean"], c["most"]), sums, c["u"], c["cap"], p.risk)[2]
                yield f[[*g, "cutoff"]]

    cuts = about.join(logs, g).mapInPandas(solve, "query_id long, field int, cutoff double")
    flagged = peaks.join(F.broadcast(cuts), g).where("size > cutoff")
    return flagged.select(*g, "repetition", "value", (side(F.col("d")) > p.far * F.col("s")).alias("far"), "m", "s", "cutoff")


_RUNS = "kind int, query_id long, repetition long, field int, pid int, side int, value long, n long, whole boolean"


def frozen_readings(df: DataFrame, fields: tuple[Field, ...] = TIMING_FIELDS, stuck: int = 5) -> DataFrame:
    """(query_id, repetition, field) of readings in `stuck` or more successive equal, non-zero values.

    Order is by repetition within query_id; null values of a field are left out; gaps in repetition do
    not interrupt. Rows equal in (query_id, repetition) count once. Sorted partitions find their own
    runs; the first and last run of each are joined over partition borders from their summaries (at
    most two a partition and field).
    """
    columns = [f.column for f in fields]
    n = sort_width(df)
    rows = df.where(F.col("query_id").isNotNull() & F.col("repetition").isNotNull()).select(
        "query_id", F.col("repetition").cast("long").alias("repetition"), *columns
    )
    key = ["query_id", "repetition"]
    srt = rows.repartitionByRange(n, *key).sortWithinPartitions(*key, *columns).withColumn("_pid", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gather(batches)
        if t is None:
            return
        pid = int(t.column("_pid")[0].as_py())
        q, rep = t.column("query_id").to_numpy(), t.column("repetition").to_numpy()
        # of repeated rows the last one in sort order stays: nulls sort first
        last = np.append(breaks(q, rep)[1:], len(q)) - 1
        for f, name in enumerate(columns):
            col = t.column(name)
            good = last[~col.is_null().to_numpy()[last]]
            if not len(good):
                continue
            v = col.fill_null(0).to_numpy()[good]
            qq, rr = q[good], rep[good]
            start = breaks(qq, v)
            end = np.append(start[1:], len(v))
            size = end - start
            edge = np.zeros(len(start), dtype=bool)
            edge[[0, -1]] = True
            hit = np.repeat((size >= stuck) & (v[start] != 0) & ~edge, size)
            yield _rows(0, qq[hit], rr[hit], f, pid, 0, v[hit], 0, False)
            for side, i in ((0, 0), (1, len(start) - 1)):
                if side and len(start) == 1:
                    continue
                a, b = start[i], end[i]
                yield _rows(1, qq[a:b], rr[a:b], f, pid, side, v[a:b], 0, False)
                yield _rows(2, qq[a : a + 1], rr[a : a + 1], f, pid, side, v[a : a + 1], b - a, len(start) == 1)

    def _rows(kind, qq, rr, f, pid, side, v, size, whole) -> pa.RecordBatch:
        m = len(qq)
        full = lambda x, t: pa.array(np.full(m, x), type=t)
        return pa.RecordBatch.from_arrays(
            [full(kind, pa.int32()), pa.array(qq, pa.int64()), pa.array(rr, pa.int64()), full(f, pa.int32()), full(pid, pa.int32()), full(side, pa.int32()), pa.array(v, pa.int64()), full(size, pa.int64()), full(whole, pa.bool_())],
            names=["kind", "query_id", "repetition", "field", "pid", "side", "value", "n", "whole"],
        )

    table = written(srt.mapInArrow(run, _RUNS), "frozen")

    # of one source and field there are at most two pieces a partition; a piece goes on where the piece
    # before it ended the partition before with the same value
    over = Window.partitionBy("query_id", "field").orderBy("pid", "side")
    fresh = ~F.coalesce((F.lag("value").over(over) == F.col("value")) & (F.lag("pid").over(over) != F.col("pid")), F.lit(False))
    pieces = table.where("kind = 2").withColumn("run", F.sum(fresh.cast("int")).over(over))
    whole = F.sum("n").over(Window.partitionBy("query_id", "field", "run"))
    joined = pieces.select("field", "pid", "side", whole.alias("total"))
    edges = table.where("kind = 1 and value <> 0").join(F.broadcast(joined.where(F.col("total") >= stuck)), ["field", "pid", "side"])
    cols = ["query_id", "repetition", "field"]
    return table.where("kind = 0").select(*cols).union(edges.select(*cols))


def impossible_readings(df: DataFrame, fields: tuple[Field, ...] = TIMING_FIELDS) -> DataFrame:
    """(query_id, repetition, field) of readings outside a field's plausible range; nulls are none."""
    bad = [F.when(~F.col(f.column).between(f.low, f.high), F.lit(i)) for i, f in enumerate(fields)]
    return (
        df.select("query_id", F.col("repetition").cast("long").alias("repetition"), F.explode(F.array(*bad)).alias("field"))
        .where("field is not null and query_id is not null and repetition is not null")
        .select("query_id", "repetition", F.col("field").cast("int").alias("field"))
    )


def implausible(df: DataFrame, fields: tuple[Field, ...] = TIMING_FIELDS, params: Params = Params()) -> DataFrame:
    """(query_id, repetition, impossible, far, frozen, tail): every reading with at least one reason.

    Rows whose query_id or repetition is null cannot be judged and give no row. An empty table gives
    none. Extra columns are ignored.
    """
    none = F.lit(False)
    pot = peaks_over_threshold(df, fields, params).select("query_id", "repetition", none.alias("impossible"), "far", none.alias("frozen"), F.lit(True).alias("tail"))
    imp = impossible_readings(df, fields).select("query_id", "repetition", F.lit(True).alias("impossible"), none.alias("far"), none.alias("frozen"), none.alias("tail"))
    fro = frozen_readings(df, fields, params.stuck).select("query_id", "repetition", none.alias("impossible"), none.alias("far"), F.lit(True).alias("frozen"), none.alias("tail"))
    kinds = ("impossible", "far", "frozen", "tail")
    return pot.unionByName(imp).unionByName(fro).groupBy("query_id", "repetition").agg(*[F.bool_or(k).alias(k) for k in kinds])
