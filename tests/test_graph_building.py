import pytest
from pyspark.sql import functions as F

from tests.graphs import SIX, frames
from waygraph.operators import build, hierarchy

SCHEMA = "r long, lat array<double>, lng array<double>, pos string"


def test_near_points_are_different_points(spark):
    row = (1, [10.74339581] * 4, [106.62136078, 106.62136078, 106.6213608, 106.62136078], "x")
    routes = spark.createDataFrame([row, (2, *row[1:])], SCHEMA)
    points = build.route_points(routes, ["r"])
    nodes = build.projected(build.coordinate_nodes(points))
    e = build.segment_edges(build.segments(points, ["r"]), nodes)
    s = build.build_stats(routes, e, nodes).first()
    assert (s.records, s.samples, s.segments, s.loops_removed, s.duplicates_merged, s.nodes, s.edges) == (2, 8, 6, 2, 2, 2, 2)
    assert {(r.src, r.dst) for r in build.merged_edges(e).collect()} == {(0, 1), (1, 0)}


def test_direction_and_single_point(spark):
    g = build.build_graph(spark.createDataFrame([(1, [10.767676, 10.768676], [106.689362] * 2, ""), (2, [11.0], [107.0], ""), (3, None, None, ""), (4, [], [], "")], SCHEMA), ["r"])
    assert g.nodes.count() == 3
    e = g.edges.collect()
    assert [(r.src, r.dst) for r in e] == [(0, 1)] and 100 < e[0].w < 120


def test_numbers_are_dense_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(9)
    assert all(r.k == r.n for r in build.number_rows(df, ["k"], "n").collect())
    assert build.number_rows(df.limit(0), ["k"], "n").count() == 0


def test_violations(spark):
    good = frames(spark, *SIX)
    assert build.graph_violations(good.nodes, good.edges).count() == 0

    def rules(nodes=SIX[0], edges=SIX[1]):
        g = frames(spark, nodes, edges)
        return {r.rule for r in build.graph_violations(g.nodes, g.edges).collect()}

    n, e = SIX
    assert "id_gap" in rules(n[:2] + n[3:])
    assert "bad_coordinate" in rules([(0, 91.0, *n[0][2:]), *n[1:]]) and "bad_coordinate" in rules([(0, float("nan"), *n[0][2:]), *n[1:]])
    assert "coordinate_order" in rules([(0, 10.5, *n[0][2:]), *n[1:]])
    assert rules(edges=[*e, (2, 2, 1.0)]) == {"self_loop"}
    assert rules(edges=[*e, (4, 5, -1.0)]) == {"bad_weight"} and rules(edges=[*e, (4, 5, float("inf"))]) == {"bad_weight"}
    assert rules(edges=[*e, (4, 6, 1.0)]) == {"unknown_end"}
    assert rules(edges=[*e, e[0]]) == {"duplicate_edge"}
    empty = build.graph_violations(good.nodes.limit(0), good.edges.limit(0))
    assert [r.rule for r in empty.collect()] == ["no_nodes"]
    with pytest.raises(ValueError):
        build.require_valid(good.nodes.limit(0), good.edges.limit(0))


def test_degrees_offsets_and_transpose(spark):
    g = frames(spark, *SIX)
    rows = build.csr_offsets(g.nodes, g.edges).orderBy("id").collect()
    assert [(r.first, r.degree) for r in rows] == [(0, 3), (3, 1), (4, 1), (5, 1), (6, 0), (6, 0)]
    assert {(r.src, r.dst) for r in build.transposed(g.edges).collect()} == {(b, a) for a, b, _ in SIX[1]}


def test_cells_are_half_open_and_start_at_the_least(spark):
    nodes = [(i, 10.0 + i, 106.0, x, -5.0) for i, x in enumerate((-5.0, 4.999, 5.0, 15.0))] + [(9, 20.0, 106.0, None, 0.0)]
    rows = hierarchy.grid_clusters(frames(spark, nodes, [(0, 1, 1.0)]).nodes, 10.0).orderBy("id").collect()
    assert [(r.id, r.cx, r.cluster) for r in rows] == [(0, 0, 0), (1, 0, 0), (2, 1, 1), (3, 2, 2)]


def test_scale(spark):
    def scale(nodes, edges):
        g = frames(spark, nodes, edges)
        return hierarchy.heuristic_scale(g.edges, g.nodes).first().scale

    p = [(0, 1.0, 1.0, 0.0, 0.0), (1, 2.0, 1.0, 10.0, 0.0), (2, 3.0, 1.0, 10.0, 0.0)]
    assert scale(p, [(0, 1, 5.0), (1, 2, 0.0)]) == 0.5
    assert scale(p, [(0, 1, 50.0)]) == 1.0
    assert scale([*p[:2], (2, 3.0, 1.0, None, 0.0)], [(0, 1, 50.0), (1, 2, 3.0)]) == 0.0
