"""Runs of near-identical consecutive events in ordered sequences.

Every path is cut into chunks of at most `chunk` points, the chunks are range-sorted, and each sorted
partition encodes its runs on its own. A run that touches the partition's first or last point is only
a summary (first and last point, positions, times); summaries are associative and are joined over the
borders where the neighbouring points are compatible. There are at most two a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import ground_distance
from ..operators.sorted_groups import breaks, gather
from ..runtime import sort_width, written

TOLERANCE_M = 3.0
CHUNK = 1024

_OUT = "edge boolean, pid int, path_id long, start_pos long, end_pos long, lat double, lng double, last_lat double, last_lng double, start_at long, end_at long"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_TYPES = [pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64(), pa.int64()]


def _numpy(a: pa.Array, fill: float) -> np.ndarray:
    return pc.fill_null(a, fill).to_numpy(zero_copy_only=False)


def _flat(t: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
    col = t.column(name)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    return col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("i8"), col.flatten()


def stops(df: DataFrame, tolerance_m: float = TOLERANCE_M, least: int = 1, chunk: int = CHUNK) -> DataFrame:
    """One row an event: (path_id, start_pos, end_pos, n_points, lat, lng, start_at, end_at, duration_s).

    A run is a longest sequence of successive points of one path in which each point after the first
    lies at most tolerance_m from the point just before it; lat and lng are its first point. Only
    events of `least` points or more are returned (1: the whole collapsed path, 2: stretches only).
    A null or non-finite coordinate is near nothing. A path of no points, null arrays or a null
    path_id gives no row. lat and lng of unequal length are read as far as both go. duration_s is null
    where a time of the run's first or last point is. Repeated rows of a path_id count once. Extra
    columns are ignored.
    """
    size = F.least(F.size("lat"), F.size("lng"))
    times = F.coalesce(F.col("sampled_at"), F.array().cast("array<long>"))
    # points beyond the last time have none
    at = F.concat(times, F.array_repeat(F.lit(None).cast("long"), F.greatest(size - F.size(times), F.lit(0))))
    cut = (
        df.where(F.col("path_id").isNotNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull())
        .select("path_id", "lat", "lng", at.alias("at"), size.cast("long").alias("size"))
        .where("size > 0")
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(chunk).cast("long"))).alias("start"))
    )
    part = lambda c: F.slice(c, F.col("start").cast("int") + 1, F.least(F.lit(chunk), F.col("size") - F.col("start")).cast("int"))
    chunks = cut.select("path_id", "start", "size", part("lat").alias("lat"), part("lng").alias("lng"), part("at").alias("at"))
    srt = chunks.repartitionByRange(sort_width(df), "path_id", "start").sortWithinPartitions("path_id", "start")
    srt = srt.withColumn("pid", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gather(batches)
        if t is None:
            return
        keep = breaks(t.column("path_id").to_numpy(), t.column("start").to_numpy())
        t = t.take(pa.array(keep)) if len(keep) < t.num_rows else t
        pid = int(t.column("pid")[0].as_py())
        n, lat = _flat(t, "lat")
        lat = _numpy(lat, np.nan)
        lng = _numpy(_flat(t, "lng")[1], np.nan)
        at = _flat(t, "at")[1]
        path = np.repeat(t.column("path_id").to_numpy(), n)
        first = np.cumsum(n) - n
        pos = np.arange(len(path)) - np.repeat(first - t.column("start").to_numpy(), n)
        no_time = at.is_null().to_numpy(zero_copy_only=False)
        at = _numpy(at, 0)
        with np.errstate(invalid="ignore"):
            near = ground_distance(lat[:-1], lng[:-1], lat[1:], lng[1:]) <= tolerance_m
        near &= (path[1:] == path[:-1]) & (pos[1:] == pos[:-1] + 1)
        a = np.append(0, np.flatnonzero(~near) + 1)
        b = np.append(a[1:], len(path)) - 1
        edge = np.zeros(len(a), dtype=bool)
        edge[0] = pos[0] > 0
        edge[-1] |= int(pos[-1]) + 1 < int(t.column("size")[-1].as_py())
        sel = edge | (b - a + 1 >= least)
        a, b, edge = a[sel], b[sel], edge[sel]
        cols = [edge, np.full(len(a), pid), path[a], pos[a], pos[b], lat[a], lng[a], lat[b], lng[b]]
        arrays = [pa.array(c, type=k) for c, k in zip(cols, _TYPES, strict=False)]
        arrays += [pa.array(at[i], type=pa.int64(), mask=no_time[i]) for i in (a, b)]
        yield from pa.table(arrays, names=_NAMES).to_batches(max_chunksize=1 << 16)

    table = written(srt.mapInArrow(run, _OUT), "runs")

    def join(f):
        f = f.sort_values(["path_id", "start_pos"], ignore_index=True)
        before = f.shift()
        with np.errstate(invalid="ignore"):
            close = ground_distance(before["last_lat"].to_numpy(), before["last_lng"].to_numpy(), f["lat"].to_numpy(), f["lng"].to_numpy()) <= tolerance_m
        goes_on = close & (f["path_id"] == before["path_id"]).to_numpy() & (f["start_pos"] == before["end_pos"] + 1).to_numpy()
        f["run"] = (~goes_on).cumsum()
        last = f.groupby("run").tail(1).set_index("run")
        out = f.groupby("run").head(1).set_index("run")
        for c in ("end_pos", "last_lat", "last_lng", "end_at"):
            out[c] = last[c]
        return out[_NAMES]

    # of one path there are at most two summaries a sorted partition
    joined = table.where("edge").groupBy("path_id").applyInPandas(join, _OUT)
    points = F.col("end_pos") - F.col("start_pos") + 1
    return (
        table.where("not edge")
        .unionByName(joined)
        .where(points >= least)
        .select("path_id", "start_pos", "end_pos", points.alias("n_points"), "lat", "lng", "start_at", "end_at", (F.col("end_at") - F.col("start_at")).alias("duration_s"))
    )
