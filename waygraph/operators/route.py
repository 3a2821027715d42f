"""One call for all algorithms and both ways to run them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..schema import Graph
from .hierarchy import Options, build_index, heuristic_scale, overlay_route, overlay_two_way
from .kernel import ALGORITHMS, collect_network, kernel_route
from .relax import point_to_point

STRATEGIES = ("relational", "kernel")


def route(graph: Graph, queries: DataFrame, algorithm: str = "dijkstra", strategy: str = "relational", options: Options | None = None, index=None) -> DataFrame:
    """Answers of all queries: query_id, status, distance and, where the algorithm has one, path.

    algorithm: dijkstra, dijkstra_baseline (the same, nothing kept between calls), astar (exact, by the
    scaled heuristic), hpa, bihpa (within the weight). strategy: relational or kernel. Options are for
    hpa and bihpa only.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    tiered = algorithm in ("hpa", "bihpa")
    if options is not None and not tiered:
        raise ValueError("options are for hpa and bihpa only")
    options = options or Options()
    if tiered and index is None:
        index = build_index(graph, options)
    if index is not None and tiered:
        index.check(graph, options)
    if strategy == "kernel":
        net = collect_network(graph.nodes, graph.edges, index if tiered else None)
        if algorithm == "astar":
            net.scale = heuristic_scale(graph.edges, graph.nodes).first().scale * (1 - 1e-12)
        return kernel_route(net, queries, algorithm, options.weight)
    if algorithm == "astar":
        scale = heuristic_scale(graph.edges, graph.nodes).first().scale * (1 - 1e-12)
        return point_to_point(graph.nodes, graph.edges, queries, scale or None)
    if algorithm == "hpa":
        return overlay_route(graph, index, queries, options)
    if algorithm == "bihpa":
        return overlay_two_way(graph, index, queries, options)
    return point_to_point(graph.nodes, graph.edges, queries)
