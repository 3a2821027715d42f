"""Two-level index: grid clusters, portals, shortcuts inside clusters, and searches on the overlay."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.projection import planar
from ..runtime import written
from ..schema import Graph
from .relax import bidirectional, point_to_point, relax

#: inner edges and portals of a cluster that one task searches
TASK_EDGES, TASK_PORTALS = 20_000, 1_000
# fixed values: default cluster size in metres and default weight
CLUSTER_M, WEIGHT = 3500.0, 1.05


@dataclass(frozen=True)
class Options:
    """Cluster size (finite, > 0) and weight (finite, > 1)."""

    cluster_m: float = CLUSTER_M
    weight: float = WEIGHT

    def __post_init__(self) -> None:
        if not (math.isfinite(self.cluster_m) and self.cluster_m > 0):
            raise ValueError("cluster size must be finite and positive")
        if not (math.isfinite(self.weight) and self.weight > 1):
            raise ValueError("weight must be finite and more than 1")


@dataclass(frozen=True)
class Index:
    """clusters (id, cluster), overlay (src, dst, w, kind, c, path), scale of the heuristic."""

    clusters: DataFrame
    overlay: DataFrame
    scale: float
    options: Options
    sha256: str | None = None

    def check(self, graph: Graph, options: Options) -> None:
        if self.sha256 != graph.sha256 or self.options.cluster_m != options.cluster_m:
            raise ValueError("the index was built for another graph or cluster size")


def grid_clusters(nodes: DataFrame, cluster_m: float) -> DataFrame:
    """(id, cx, cy, cluster): half-open grid cells from the least x and y; clusters are numbered in cell order.

    Nodes without a position are in no cluster. Only distinct cells are numbered.
    """
    pos = nodes.where("x_m is not null and y_m is not null").groupBy("id").agg(F.min("x_m").alias("x_m"), F.min("y_m").alias("y_m"))
    low = pos.agg(F.min("x_m").alias("x0"), F.min("y_m").alias("y0"))  # one row
    cell = lambda v, o: F.floor((F.col(v) - F.col(o)) / cluster_m)
    cells = pos.crossJoin(F.broadcast(low)).select("id", cell("x_m", "x0").alias("cx"), cell("y_m", "y0").alias("cy"))
    far = cells.where((F.abs("cx") >= F.lit(2**62)) | (F.abs("cy") >= F.lit(2**62)))
    from .build import number_rows

    number = number_rows(cells.select("cx", "cy").distinct(), ["cx", "cy"], "cluster")
    if not far.isEmpty():
        raise ValueError("cells beyond the range of whole numbers")
    return cells.join(number, ["cx", "cy"]).select("id", "cx", "cy", "cluster")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.count("*").alias("nodes"))


def clustered_edges(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(src, dst, w, c1, c2): edges with the clusters of their ends."""
    a = clusters.select(F.col("id").alias("src"), F.col("cluster").alias("c1"))
    b = clusters.select(F.col("id").alias("dst"), F.col("cluster").alias("c2"))
    return edges.select("src", "dst", "w").join(a, "src").join(b, "dst").select("src", "dst", "w", "c1", "c2")


def cross_edges(ce: DataFrame) -> DataFrame:
    return ce.where("c1 <> c2")


def portals(ce: DataFrame) -> DataFrame:
    """(id, cluster): both ends of every edge between clusters."""
    end = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("c1").alias("cluster")), F.struct(F.col("dst").alias("id"), F.col("c2").alias("cluster")))).alias("e")
    return cross_edges(ce).select(end).select("e.id", "e.cluster").distinct()


def heuristic_scale(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: scale, the largest share (1 at most) of the straight line that no edge undercuts.

    Edges without length on the plane say nothing; an end without a finite position makes it 0.
    """
    p = nodes.groupBy("id").agg(F.min("x_m").alias("x"), F.min("y_m").alias("y"))
    a = p.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = p.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    line = planar(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    e = edges.join(a, "src").join(b, "dst").select("w", line.alias("line"))
    bad = F.col("line").isNull() | F.isnan("line") | (F.col("line") == float("inf"))
    low = F.min(F.when(F.col("line") > 0, F.col("w") / F.col("line")))
    return e.agg(F.when(F.bool_or(bad), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.coalesce(low, F.lit(1.0)))).alias("scale"))


def shortcuts(ce: DataFrame, gates: DataFrame) -> DataFrame:
    """(src, dst, w, path, c): least distances between portals of one cluster inside it; path excludes src.

    Clusters with fewer than two portals have none. A cluster whose edges one task can hold is searched
    there with a queue a portal, all others at once set-based; both take the least (distance, steps,
    path), so the answers are the same.
    """
    many = gates.groupBy("cluster").agg(F.count("*").alias("k")).where("k > 1")
    inner = ce.where("c1 = c2").select("src", "dst", "w", F.col("c1").alias("cluster"))
    large = inner.groupBy("cluster").agg(F.count("*").alias("n")).join(many, "cluster").where((F.col("n") > TASK_EDGES) | (F.col("k") > TASK_PORTALS)).select("cluster")
    large = written(large, "large")
    start = gates.join(many, "cluster", "left_semi")
    kept = [x.join(large, "cluster", "left_anti") for x in (inner, start)]
    small = _small_shortcuts(*kept)
    if large.isEmpty():
        return small
    start, inner = start.join(large, "cluster", "left_semi"), inner.join(large, "cluster", "left_semi").drop("cluster")
    labels = relax(inner, start.select(F.col("id").alias("root"), "cluster", F.col("id").alias("node"), F.lit(0).alias("g")), ["root"])
    to = gates.select(F.col("id").alias("node"))
    hit = labels.where("node <> root").join(to, "node", "left_semi")
    wide = hit.select(F.col("root").alias("src"), F.col("node").alias("dst"), F.col("g").alias("w"), F.slice("path", 2, F.size("path")).alias("path"), F.col("cluster").alias("c"))
    return small.unionByName(wide)


def _small_shortcuts(inner: DataFrame, start: DataFrame) -> DataFrame:
    """The shortcuts of clusters with at most TASK_EDGES edges and TASK_PORTALS portals, a task a cluster."""
    kind = dict(inner.dtypes)["w"]
    out = f"src long, dst long, w {kind}, path array<long>, c long"

    def solve(edges, gates):
        import pandas as pd

        rows = []
        near: dict[int, list] = {}
        for u, v, w in zip(edges["src"].tolist(), edges["dst"].tolist(), edges["w"].tolist(), strict=True):
            near.setdefault(u, []).append((v, w))
        ends = set(gates["id"].tolist())
        for root in sorted(ends):
            best, heap = {}, [(0, 0, (root,))]
            while heap:
                g, hops, path = heapq.heappop(heap)
                u = path[-1]
                if u in best:
                    continue
                best[u] = (g, path)
                for v, w in near.get(u, ()):
                    if v not in best:
                        heapq.heappush(heap, (g + w, hops + 1, (*path, v)))
            c = int(gates["cluster"].iloc[0])
            rows += [(root, v, g, list(path[1:]), c) for v, (g, path) in best.items() if v in ends and v != root]
        return pd.DataFrame(rows, columns=["src", "dst", "w", "path", "c"])

    return inner.groupBy("cluster").cogroup(start.groupBy("cluster")).applyInPandas(solve, out)


def overlay(ce: DataFrame, short: DataFrame) -> DataFrame:
    """(src, dst, w, kind, c, path): cross edges, inner edges (cluster c) and shortcuts (cluster c)."""
    alone = F.array("dst")
    cross = cross_edges(ce).select("src", "dst", "w", F.lit("cross").alias("kind"), F.lit(None).cast("long").alias("c"), alone.alias("path"))
    inner = ce.where("c1 = c2").select("src", "dst", "w", F.lit("intra").alias("kind"), F.col("c1").alias("c"), alone.alias("path"))
    return cross.unionByName(inner).unionByName(short.select("src", "dst", "w", F.lit("shortcut").alias("kind"), "c", "path"))


#: which overlay edges a query between clusters cs and ct may use
RULE = "kind = 'cross' or (kind = 'intra' and c in (cs, ct)) or (kind = 'shortcut' and c not in (cs, ct))"


def build_index(graph: Graph, options: Options = Options()) -> Index:
    clusters = written(grid_clusters(graph.nodes, options.cluster_m), "clusters")
    ce = written(clustered_edges(graph.edges, clusters), "clustered")
    gates = written(portals(ce), "portals")
    over = written(overlay(ce, shortcuts(ce, gates)), "overlay")
    scale = heuristic_scale(graph.edges, graph.nodes).first().scale
    # rounded down, so that the heuristic stays a lower bound
    return Index(clusters, over, math.nextafter(scale * (1 - 1e-12), 0.0) if scale > 0 else 0.0, options, graph.sha256)


def transposed_index(index: Index) -> DataFrame:
    """The overlay against its direction; stored paths stay as they are (along the original edges)."""
    return index.overlay.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", "kind", "c", "path")


def index_stats(index: Index) -> DataFrame:
    """One row: clusters, portals, cross_edges, shortcuts, path_nodes, max_cluster_nodes."""
    k = F.col("kind")
    o = index.overlay
    a = o.agg(
        F.count(F.when(k == "cross", 1)).alias("cross_edges"), F.count(F.when(k == "shortcut", 1)).alias("shortcuts"),
        F.coalesce(F.sum(F.when(k == "shortcut", F.size("path"))), F.lit(0)).cast("long").alias("path_nodes"),
    )
    p = o.where(k == "cross").select(F.explode(F.array("src", "dst")).alias("id")).distinct().agg(F.count("*").alias("portals"))
    c = cluster_sizes(index.clusters).agg(F.count("*").alias("clusters"), F.max("nodes").alias("max_cluster_nodes"))
    return c.crossJoin(p).crossJoin(a)  # one row each


def overlay_route(graph: Graph, index: Index, queries: DataFrame, options: Options | None = None) -> DataFrame:
    """(query_id, status, distance, hops, path): within weight times the optimum, over the overlay.

    Queries with an end that has a position in no cluster are searched on no edges of endpoint
    clusters; nodes of a valid graph all have one. Shortcuts are replaced by their stored paths.
    """
    options = options or index.options
    index.check(graph, options)
    nodes = graph.nodes.groupBy("id").agg(F.min("x_m").alias("x_m"), F.min("y_m").alias("y_m")).join(index.clusters.select("id", "cluster"), "id", "left")
    columns = {"cs": ("source", "cluster"), "ct": ("target", "cluster")}
    raw = point_to_point(nodes, index.overlay.drop("path"), queries, index.scale or None, options.weight, F.expr(RULE), columns)
    raw = written(raw, "overlay-answers")
    return expand_paths(raw, index, queries)


def overlay_two_way(graph: Graph, index: Index, queries: DataFrame, options: Options | None = None) -> DataFrame:
    """(query_id, status, distance, path): the same answers from both ends, over the overlay and against its direction."""
    options = options or index.options
    index.check(graph, options)
    nodes = graph.nodes.select("id").distinct().join(index.clusters.select("id", "cluster"), "id", "left")
    columns = {"cs": ("source", "cluster"), "ct": ("target", "cluster")}
    raw = bidirectional(nodes, index.overlay.drop("path"), queries, options.weight, F.expr(RULE), columns, paths=True)
    return expand_paths(written(raw, "overlay-answers"), index, queries)


def expand_paths(answers: DataFrame, index: Index, queries: DataFrame) -> DataFrame:
    """Answers with every overlay step replaced by its stored path."""
    q = queries.select("query_id", "source", "target").distinct()
    at = lambda c, n: index.clusters.select(F.col("id").alias(c), F.col("cluster").alias(n))
    q = q.join(at("source", "cs"), "source", "left").join(at("target", "ct"), "target", "left").select("query_id", "cs", "ct")
    pairs = F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path")).alias("b"))).alias("i", "s")
    steps = answers.where("size(path) > 1").select("query_id", pairs).select("query_id", "i", F.col("s.a").alias("src"), F.col("s.b").alias("dst")).join(q, "query_id")
    used = steps.join(index.overlay, ["src", "dst"]).where(F.expr(RULE))
    # of parallel steps the least, as in the search
    best = used.groupBy("query_id", "i", "src").agg(F.min(F.struct("w", "path")).alias("s"))
    whole = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("i", "src", F.col("s.path").alias("p")))).alias("all"))
    path = F.concat(F.array(F.col("all")[0]["src"]), F.flatten(F.transform("all", lambda x: x["p"])))
    return answers.join(whole, "query_id", "left").select("query_id", "status", "distance", F.when(F.col("all").isNull(), F.col("path")).otherwise(path).alias("path"))
