"""Priority-queue searches, one query at a time, in parallel over queries.

For the answers that depend on the order of a queue, and for many queries on a graph small enough to
send to every worker. The size is checked against a limit first; larger graphs use operators.relax.
"""

from __future__ import annotations

import heapq
import math
import time
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shuffle_width
from ..schema import FOUND, INVALID, UNREACHABLE

#: edges and stored path nodes that are sent to a worker at most
LIMIT = 5_000_000
#: parts of a source's queries, so that a crowded source is searched by some tasks
SPLIT = 4
#: networks that have been sent to the workers: once each, not once a call
_SENT: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
ALGORITHMS = ("dijkstra", "dijkstra_baseline", "astar", "hpa", "bihpa")

_OUT = "query_id long, status string, distance double, path array<long>, service_ns long, expanded long, error string"


class Network:
    """Adjacency, positions, and optionally clusters and shortcuts."""

    def __init__(self, nodes, edges, clusters=(), shorts=(), scale: float = 0.0):
        self.pos = {i: (x, y) for i, x, y in nodes}
        self.scale = scale
        self.cluster = dict(clusters)
        self.out: dict[int, list] = {}
        self.into: dict[int, list] = {}
        for u, v, w in sorted(edges):
            self.out.setdefault(u, []).append((v, w))
            self.into.setdefault(v, []).append((u, w))
        self.short: dict[int, list] = {}
        self.short_into: dict[int, list] = {}
        self.stored = {}
        for u, v, w, path in sorted(shorts):
            self.short.setdefault(u, []).append((v, w))
            self.short_into.setdefault(v, []).append((u, w))
            self.stored[u, v] = path

    def h(self, a: int, b: int) -> float:
        if not self.scale:
            return 0.0
        (x1, y1), (x2, y2) = self.pos[a], self.pos[b]
        if None in (x1, y1, x2, y2):
            return 0.0
        return self.scale * math.hypot(x1 - x2, y1 - y2)

    def steps(self, node: int, ends: tuple, back: bool = False):
        """Overlay edges at a node, for a query between the clusters `ends`: (node, weight, is a shortcut)."""
        c = self.cluster.get(node)
        near = c in ends
        for v, w in (self.into if back else self.out).get(node, ()):
            if near or self.cluster.get(v) != c:
                yield v, w, False
        if not near:
            for v, w in (self.short_into if back else self.short).get(node, ()):
                yield v, w, True


class Tree:
    """Least distances from one source, found as far as targets have been asked for."""

    def __init__(self, net: Network, source: int):
        self.net, self.source = net, source
        self.dist, self.parent, self.done, self.heap = {source: 0.0}, {}, set(), [(0.0, source)]

    def reach(self, t: int):
        """(distance, path, expanded): goes on where the search for the last target ended."""
        dist, parent, done, heap, out, n = self.dist, self.parent, self.done, self.heap, self.net.out, 0
        while heap and t not in done:
            g, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            n += 1
            for v, w in out.get(u, ()):
                x = g + w
                if x < dist.get(v, math.inf):
                    dist[v], parent[v] = x, u
                    heapq.heappush(heap, (x, v))
        if t not in done:
            return None, [], n
        path = [t]
        while path[-1] != self.source:
            path.append(parent[path[-1]])
        return dist[t], path[::-1], n


def best_first(net: Network, s: int, t: int, weight: float, overlay: bool):
    """(distance, path, expanded): one-way search by g + weight * h; weight 0 orders by (g, node).

    Nodes are opened again when a better way to them is found.
    """
    dist, parent, done = {s: 0.0}, {}, 0
    heap = [(weight * net.h(s, t), 0.0, s)]
    ends = (net.cluster.get(s), net.cluster.get(t))
    while heap:
        _, g, u = heapq.heappop(heap)
        if g != dist[u]:
            continue
        done += 1
        if u == t:
            break
        edges = net.steps(u, ends) if overlay else ((v, w, False) for v, w in net.out.get(u, ()))
        for v, w, short in edges:
            x = g + w
            if x < dist.get(v, math.inf):
                dist[v], parent[v] = x, (u, short)
                heapq.heappush(heap, (x + weight * net.h(v, t) if weight else x, x, v))
    if t not in dist:
        return None, [], done
    return dist[t], _walk(net, s, t, parent), done


def _walk(net: Network, s: int, t: int, parent: dict) -> list[int]:
    parts, v = [], t
    while v != s:
        u, short = parent[v]
        parts.append(net.stored[u, v] if short else [v])
        v = u
    return [s, *(x for p in reversed(parts) for x in p)]


def two_way(net: Network, s: int, t: int, weight: float):
    """(distance, path, expanded): weighted bidirectional search on the overlay.

    Keys are g + weight / 2 * h to the goal - h to the root / 2; the search ends when the best meeting
    is no more than the sum of both least keys. Ties between the sides alternate.
    """
    ends = (net.cluster.get(s), net.cluster.get(t))
    dist, parent = ({s: 0.0}, {t: 0.0}), ({}, {})
    root, goal = (s, t), (t, s)
    key = lambda side, v, g: g + weight / 2 * net.h(v, goal[side]) - net.h(v, root[side]) / 2
    heaps = ([(key(0, s, 0.0), 0.0, s)], [(key(1, t, 0.0), 0.0, t)])
    best, meet, turn, done = math.inf, None, 0, 0
    while True:
        for side in (0, 1):
            while heaps[side] and heaps[side][0][1] != dist[side][heaps[side][0][2]]:
                heapq.heappop(heaps[side])
        if not heaps[0] or not heaps[1]:
            break
        low = heaps[0][0][0], heaps[1][0][0]
        if meet is not None and best <= low[0] + low[1]:
            break
        if low[0] == low[1]:
            side, turn = turn, 1 - turn
        else:
            side = 0 if low[0] < low[1] else 1
        _, g, u = heapq.heappop(heaps[side])
        done += 1
        for v, w, short in net.steps(u, ends, back=side == 1):
            x = g + w
            if x < dist[side].get(v, math.inf):
                dist[side][v], parent[side][v] = x, (u, short)
                heapq.heappush(heaps[side], (key(side, v, x), x, v))
                if (both := x + dist[1 - side].get(v, math.inf)) < best:
                    best, meet = both, v
    if meet is None:
        return None, [], done
    path = _walk(net, s, meet, parent[0])
    v = meet
    while v != t:
        u, short = parent[1][v]
        path += net.stored[v, u] if short else [u]
        v = u
    return best, path, done


def search(net: Network, algorithm: str, s: int | None, t: int | None, weight: float = 1.05, tree: Tree | None = None):
    """(status, distance, path, expanded) of one query; the distance is summed along the path again.

    tree: of the same source, from queries before; for dijkstra only.
    """
    if s not in net.pos or t not in net.pos:
        return INVALID, None, [], 0
    if s == t:
        return FOUND, 0.0, [s], 0
    if algorithm == "dijkstra":
        g, path, n = (tree or Tree(net, s)).reach(t)
    elif algorithm == "dijkstra_baseline":
        g, path, n = best_first(net, s, t, 0.0, False)
    elif algorithm == "astar":
        g, path, n = best_first(net, s, t, 1.0, False)
    elif algorithm == "hpa":
        g, path, n = best_first(net, s, t, weight, True)
    elif algorithm == "bihpa":
        g, path, n = two_way(net, s, t, weight)
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    if g is None:
        return UNREACHABLE, None, [], n
    if algorithm in ("hpa", "bihpa"):
        again = math.fsum(dict(net.out[a])[b] for a, b in zip(path, path[1:], strict=False))
        if abs(again - g) > max(1e-6, 1e-9 * max(abs(again), abs(g))):
            raise RuntimeError("a stored path does not have its shortcut's length")
        g = again
    return FOUND, g, path, n


def collect_network(nodes: DataFrame, edges: DataFrame, index=None, limit: int = LIMIT) -> Network:
    """Gather a graph (and index) that is at most `limit` edges and stored nodes; larger ones are an error."""
    size = edges.count() + nodes.count()
    shorts = index.overlay.where("kind = 'shortcut'") if index else None
    if index:
        size += shorts.agg(F.coalesce(F.sum(F.size("path")), F.lit(0))).first()[0]
    if size > limit:
        raise ValueError(f"{size} rows are more than {limit}: use the relational search")
    rows = lambda df: [tuple(r) for r in df.toLocalIterator()]
    return Network(
        rows(nodes.groupBy("id").agg(F.min("x_m"), F.min("y_m"))), rows(edges.select("src", "dst", "w")),
        rows(index.clusters.select("id", "cluster")) if index else (), rows(shorts.select("src", "dst", "w", "path")) if index else (),
        index.scale if index else 0.0,
    )


def kernel_route(net: Network, queries: DataFrame, algorithm: str = "dijkstra", weight: float = 1.05, workers: int | None = None) -> DataFrame:
    """(query_id, status, distance, path, service_ns, expanded, error): a row a query.

    dijkstra asks the queries of one source of the same tree, dijkstra_baseline keeps nothing. A query that fails gets a row with its error and a null status; others go on. The answers do not
    depend on the number of workers.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    spark = queries.sparkSession
    if net not in _SENT:
        _SENT[net] = spark.sparkContext.broadcast(net)
    sent = _SENT[net]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tree = sent.value, None
        for b in batches:
            out = []
            for q, s, t in zip(*(b.column(c).to_pylist() for c in ("query_id", "source", "target")), strict=True):
                began = time.perf_counter_ns()
                try:
                    if algorithm == "dijkstra" and s in own.pos and (tree is None or tree.source != s):
                        tree = Tree(own, s)
                    status, g, path, n = search(own, algorithm, s, t, weight, tree)
                    row = (q, status, g, path, time.perf_counter_ns() - began, n, None)
                except Exception as e:  # one query's failure is its own
                    row, tree = (q, None, None, [], time.perf_counter_ns() - began, 0, str(e)), None
                out.append(row)
            names = ["query_id", "status", "distance", "path", "service_ns", "expanded", "error"]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    q = queries.where("query_id is not null").select("query_id", "source", "target").distinct()
    n = workers or shuffle_width(spark)
    if algorithm != "dijkstra":
        return q.repartition(n, "query_id").mapInArrow(run, _OUT)
    # queries of one source together, a crowded source in some parts
    part = F.pmod(F.xxhash64("query_id"), F.lit(SPLIT))
    return q.repartition(n, "source", part).sortWithinPartitions("source").mapInArrow(run, _OUT)
