"""Tables, statuses and tolerances of the route engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "id bigint, lat double, lon double, x_m double, y_m double"
EDGES = "src bigint, dst bigint, distance_m double"
QUERIES = "query_id bigint, source bigint, target bigint"
RESULTS = "query_id bigint, status string, distance_m double, path array<bigint>"
ANSWERS = "query_id bigint, status string, distance_m double, `group` string"
TIMINGS = "repetition int, query_id bigint, duration_ns bigint, status string, wait_ns bigint, latency_ns bigint"

# fixed values of the data model
FOUND, UNREACHABLE, INVALID, NOT_IMPLEMENTED = "found", "unreachable", "invalid_vertex", "not_implemented"
COORDINATE_CRS, DISTANCE_CRS, WEIGHT_UNIT = "EPSG:4326", "EPSG:3405", "meter"


@dataclass(frozen=True)
class Graph:
    """A directed weighted graph: nodes (id, lat, lon, x_m, y_m), edges (src, dst, w), ids 0 .. n - 1 if dense.

    w may be any additive number; whole numbers (millimetres) make sums exact.
    """

    nodes: DataFrame
    edges: DataFrame
    sha256: str | None = None


def close(a: Column, b: Column) -> Column:
    """Equal within the tolerance used everywhere: 1e-6 or 1e-9 of the larger."""
    return F.abs(a - b) <= F.greatest(F.lit(1e-6), 1e-9 * F.greatest(F.abs(a), F.abs(b)))
