"""From route polylines to a graph: points, nodes with dense ids, segments, merged edges, adjacency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.projection import planar, with_projection
from ..schema import Graph


def route_points(routes: DataFrame, route: list[str]) -> DataFrame:
    """(route columns, pos, lat, lon): the points of each polyline in order; null arrays have none."""
    zipped = F.arrays_zip(F.col("lat").alias("lat"), F.col("lng").alias("lon"))
    return routes.select(*route, F.posexplode(zipped).alias("pos", "p")).select(*route, F.col("pos").cast("long").alias("pos"), (F.col("p.lat") + 0.0).alias("lat"), (F.col("p.lon") + 0.0).alias("lon"))


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with dense numbers from 0 in the given total order, without a one-task window.

    Range-sorted partitions are counted, and each row's number is its partition's offset and its
    place in the partition.
    """
    from ..runtime import shuffle_width, written

    n = shuffle_width(df.sparkSession)
    srt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    srt = srt.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    srt = written(srt.withColumn("_at", F.col("_at") - F.shiftleft(F.col("_pid").cast("long"), 33)), "numbered")
    count = srt.groupBy("_pid").agg((F.max("_at") + 1).alias("_n"))
    # one row a partition
    offset = count.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return srt.join(F.broadcast(offset), "_pid").select(*df.columns, (F.col("_off") + F.col("_at")).alias(name))


def coordinate_nodes(points: DataFrame) -> DataFrame:
    """(id, lat, lon): distinct exact coordinates, numbered from 0 by (lat, lon); null coordinates dropped."""
    return number_rows(points.select("lat", "lon").dropna().distinct(), ["lat", "lon"], "id").select("id", "lat", "lon")


def projected(nodes: DataFrame) -> DataFrame:
    """nodes with x_m, y_m; a position that has no finite projection is an error."""
    known = lambda c: F.coalesce(c, F.raise_error(F.lit("position cannot be projected")).cast("double"))
    p = with_projection(nodes.select("id", "lat", "lon"))
    return p.select("id", "lat", "lon", known(F.col("x_m")).alias("x_m"), known(F.col("y_m")).alias("y_m"))


def segments(points: DataFrame, route: list[str]) -> DataFrame:
    """(route columns, pos, lat, lon, lat2, lon2): pairs of adjacent points of one route."""
    w = Window.partitionBy(*route).orderBy("pos")
    return points.select("*", F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2")).where("lat2 is not null and lon2 is not null")


def segment_edges(segs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, w): a segment's nodes and planar length; self-loops are kept here."""
    a = nodes.select(F.col("lat"), F.col("lon"), F.col("id").alias("src"), F.col("x_m").alias("x1"), F.col("y_m").alias("y1"))
    b = nodes.select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("id").alias("dst"), F.col("x_m").alias("x2"), F.col("y_m").alias("y2"))
    return segs.join(a, ["lat", "lon"]).join(b, ["lat2", "lon2"]).select("src", "dst", planar(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("w"))


def merged_edges(edges: DataFrame, weight: str = "w") -> DataFrame:
    """(src, dst, w): self-loops and null weights dropped, parallel edges merged by the least weight."""
    return edges.where((F.col("src") != F.col("dst")) & F.col(weight).isNotNull()).groupBy("src", "dst").agg(F.min(weight).alias("w"))


def build_graph(routes: DataFrame, route: list[str]) -> Graph:
    """The graph of polylines; `route` is the key of a polyline."""
    points = route_points(routes, route)
    nodes = projected(coordinate_nodes(points))
    return Graph(nodes, merged_edges(segment_edges(segments(points, route), nodes)))


def build_stats(routes: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: records, samples, segments, loops_removed, duplicates_merged, nodes, edges.

    edges are the segments' edges before merging.
    """
    n = F.size(F.coalesce("lat", F.array().cast("array<double>"))).cast("long")
    r = routes.agg(F.count("*").alias("records"), F.coalesce(F.sum(n), F.lit(0)).alias("samples"))
    e = edges.agg(F.count("*").alias("segments"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("loops_removed"))
    m = merged_edges(edges).agg(F.count("*").alias("edges"))
    k = nodes.agg(F.count("*").alias("nodes"))
    # one row each
    one = r.crossJoin(e).crossJoin(m).crossJoin(k)
    return one.select("records", "samples", "segments", "loops_removed", (F.col("segments") - F.col("loops_removed") - F.col("edges")).alias("duplicates_merged"), "nodes", "edges")


def out_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of every node."""
    d = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def transposed(edges: DataFrame) -> DataFrame:
    """The edges against their direction."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def csr_offsets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, first, degree): where a node's edges start among all edges in (src, dst) order.

    The running total is taken over sorted partitions, not in one task.
    """
    from ..runtime import shuffle_width, written

    deg = out_degree(nodes, edges)
    n = shuffle_width(deg.sparkSession)
    srt = written(deg.repartitionByRange(n, "id").sortWithinPartitions("id").withColumn("_pid", F.spark_partition_id()), "csr")
    total = srt.groupBy("_pid").agg(F.sum("degree").alias("_t"))
    off = total.select("_pid", (F.sum("_t").over(Window.orderBy("_pid")) - F.col("_t")).alias("_off"))
    inside = F.sum("degree").over(Window.partitionBy("_pid").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("degree")
    return srt.withColumn("_in", inside).join(F.broadcast(off), "_pid").select("id", (F.col("_off") + F.col("_in")).alias("first"), "degree")


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, out: array of (dst, w) by dst)."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "w"))).alias("out"))


def bounds(nodes: DataFrame) -> DataFrame:
    """One row: min_x, max_x, min_y, max_y."""
    return nodes.agg(F.min("x_m").alias("min_x"), F.max("x_m").alias("max_x"), F.min("y_m").alias("min_y"), F.max("y_m").alias("max_y"))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def graph_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, a, b): rows that break a rule of a valid graph; empty if the graph is valid.

    Rules: no_nodes, id_gap, bad_coordinate, coordinate_order, bad_edge (self-loop, negative or not
    finite), unknown_end, duplicate_edge, self_loop.
    """
    none = F.lit(None).cast("long")
    # ids of a valid table are 0 .. n - 1; each is compared with its neighbour in order
    numbered = number_rows(nodes.select("id", "lat", "lon"), ["id", "lat", "lon"], "_no")
    gap = numbered.where(~F.col("id").eqNullSafe(F.col("_no"))).select(F.lit("id_gap").alias("rule"), F.col("id").alias("a"), F.col("_no").alias("b"))
    coordinate = nodes.where(~(finite(F.col("lat")) & finite(F.col("lon"))) | ~F.col("lat").between(-90, 90) | ~F.col("lon").between(-180, 180))
    coordinate = coordinate.select(F.lit("bad_coordinate").alias("rule"), F.col("id").alias("a"), none.alias("b"))
    nxt = numbered.select((F.col("_no") - 1).alias("_no"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("id").alias("b"))
    unordered = numbered.join(nxt, "_no").where((F.col("lat2") < F.col("lat")) | ((F.col("lat2") == F.col("lat")) & (F.col("lon2") <= F.col("lon"))))
    unordered = unordered.select(F.lit("coordinate_order").alias("rule"), F.col("id").alias("a"), "b")
    loop = edges.where("src = dst").select(F.lit("self_loop").alias("rule"), F.col("src").alias("a"), F.col("dst").alias("b"))
    weight = edges.where(~finite(F.col("w").cast("double")) | (F.col("w") < 0)).select(F.lit("bad_weight").alias("rule"), F.col("src").alias("a"), F.col("dst").alias("b"))
    ids = nodes.select("id").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("end"), "src", "dst")
    unknown = ends.join(ids, ends["end"] == ids["id"], "left_anti").select(F.lit("unknown_end").alias("rule"), F.col("src").alias("a"), F.col("dst").alias("b"))
    twice = edges.groupBy("src", "dst").count().where("count > 1").select(F.lit("duplicate_edge").alias("rule"), F.col("src").alias("a"), F.col("dst").alias("b"))
    empty = nodes.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no_nodes").alias("rule"), none.alias("a"), none.alias("b"))
    out = gap
    for part in (coordinate, unordered, loop, weight, unknown, twice, empty):
        out = out.unionByName(part)
    return out


def require_valid(nodes: DataFrame, edges: DataFrame) -> None:
    found = graph_violations(nodes, edges).limit(5).collect()
    if found:
        raise ValueError(f"invalid graph: {[tuple(r) for r in found]}")
