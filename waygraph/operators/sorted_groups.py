"""Distributed sort of (group, value) with exact positions inside every group.

One range shuffle sorts all rows by (group, value, tie). A group's rows are then contiguous, so at
most the first and the last group of a sorted partition can be split over partitions. Groups that
lie in one partition are finished there in numpy. Split groups - a hot group is one - get
per-partition counts whose prefix sums are the offsets of their rows; a wanted position is found by
offset, so no task ever holds more of a group than one sorted partition of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import sort_width, written

#: what a local function gets: columns of one partition, and the start and end row of each whole group
Local = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], pa.Table]


def gather(batches: Iterator[pa.RecordBatch], schema: pa.Schema | None = None) -> pa.Table | None:
    """The batches of one task as a table; None when there are no rows."""
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept).combine_chunks() if kept else None


def breaks(*columns: np.ndarray) -> np.ndarray:
    """Start rows of the stretches on which all columns stay equal."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class SortedGroups:
    """Result of sort_groups: finished groups, and counts and rows of the split ones."""

    def __init__(self, table: DataFrame, group: list[str], value: str, rest: list[str], answer: T.StructType):
        self._table, self.group, self.value, self.rest, self._answer = table, group, value, rest, answer

    def finished(self) -> DataFrame:
        """What the local function returned for groups that lie in one partition."""
        return self._table.where("_kind = 0").select(*self._answer.fieldNames())

    def split_counts(self) -> DataFrame:
        """(group, _pid, _start, _n): where each split group's rows lie; at most two rows a partition."""
        return self._table.where("_kind = 1").select(*self.group, "_pid", "_start", "_n")

    def split_rows(self) -> DataFrame:
        """Rows of the split groups with _pid and their index _at in the sorted partition."""
        return self._table.where("_kind = 2").select(*self.group, self.value, *self.rest, "_pid", "_at")

    def at_positions(self, positions: dict[str, Callable[[Column], Column]]) -> DataFrame:
        """(group, _n, one column a name): values of split groups at 0-based positions given from n.

        The looked-up positions are at most two groups a partition times len(positions), so they
        are broadcast.
        """
        over = Window.partitionBy(*self.group).orderBy("_pid")
        counts = (
            self.split_counts()
            .withColumn("_off", F.sum("_n").over(over) - F.col("_n"))
            .withColumn("_total", F.sum("_n").over(Window.partitionBy(*self.group)))
        )
        wanted = counts.select(
            *self.group, "_pid", "_start", "_n", "_off", "_total",
            F.explode(F.array(*[F.struct(F.lit(k).alias("k"), f(F.col("_total")).cast("long").alias("p")) for k, f in positions.items()])).alias("w"),
        ).where((F.col("w.p") >= F.col("_off")) & (F.col("w.p") < F.col("_off") + F.col("_n")))
        wanted = wanted.select(
            F.col("_pid").alias("_wpid"), (F.col("_start") + F.col("w.p") - F.col("_off")).alias("_wat"),
            F.col("w.k").alias("_k"), F.col("_total"),
        )
        rows = self.split_rows()
        hit = rows.join(F.broadcast(wanted), (rows["_pid"] == wanted["_wpid"]) & (rows["_at"] == wanted["_wat"]))
        return hit.groupBy(*self.group).agg(
            F.first("_total").alias("_n"),
            *[F.max(F.when(F.col("_k") == k, F.col(self.value))).alias(k) for k in positions],
        )


def sort_groups(
    df: DataFrame, group: list[str], value: str, tie: list[str], rest: list[str], local: Local, answer: T.StructType,
    name: str = "sorted", partitions: int | None = None,
) -> SortedGroups:
    """Sort by (group, value, tie) and run `local` on every group that lies in one partition.

    Rows equal in (group, value, tie) are one row; group, value and tie are integers and not null
    (the caller filters). `rest` are further integer columns carried along. An empty input gives
    empty results. The result is written once to the shared folder.
    """
    used = [*group, value, *tie, *[c for c in rest if c not in tie]]
    n = partitions or sort_width(df)
    srt = df.select(*used).repartitionByRange(n, *group, value, *tie).sortWithinPartitions(*group, value, *tie)
    srt = srt.withColumn("_pid", F.spark_partition_id())
    base = {f.name: f for f in srt.schema.fields}
    carried = [c for c in used if c not in group and c != value]
    names = list(dict.fromkeys([*answer.fieldNames(), *group, value, *carried]))
    fields = [T.StructField("_kind", T.IntegerType())]
    fields += [T.StructField(c, (answer[c] if c in answer.fieldNames() else base[c]).dataType) for c in names]
    fields += [T.StructField(c, T.LongType()) for c in ("_pid", "_start", "_n", "_at")]
    out = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def shaped(t: pa.Table, **more: object) -> pa.Table:
        cols = []
        for f in arrow:
            if f.name in more:
                x = more[f.name]
                a = pa.array(np.full(t.num_rows, x), type=f.type) if np.isscalar(x) else pa.array(x, type=f.type)
            elif f.name in t.column_names:
                a = t.column(f.name).cast(f.type)
            else:
                a = pa.nulls(t.num_rows, f.type)
            cols.append(a)
        return pa.table(cols, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gather(batches)
        if t is None:
            return
        pid = int(t.column("_pid")[0].as_py())
        c = {k: t.column(k).to_numpy() for k in used}
        keep = breaks(*[c[k] for k in (*group, value, *tie)])
        if len(keep) < t.num_rows:
            c = {k: v[keep] for k, v in c.items()}
        start = breaks(*[c[k] for k in group])
        end = np.append(start[1:], len(c[value]))
        whole = np.arange(1, len(start) - 1)
        for i in sorted({0, len(start) - 1}):
            a, b = int(start[i]), int(end[i])
            key = pa.table({k: c[k][a : a + 1] for k in group})
            yield from shaped(key, _kind=1, _pid=pid, _start=a, _n=b - a).to_batches()
            rows = pa.table({k: c[k][a:b] for k in used})
            yield from shaped(rows, _kind=2, _pid=pid, _at=np.arange(a, b)).to_batches(max_chunksize=1 << 17)
        if len(whole):
            yield from shaped(local(c, start[whole], end[whole]), _kind=0, _pid=pid).to_batches(max_chunksize=1 << 17)

    table = written(srt.mapInArrow(run, out), name)
    return SortedGroups(table, group, value, [x for x in carried], answer)
