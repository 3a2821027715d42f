"""Queries of graph building, routing, the index, checks and workloads over the test tables.

Weights are whole millimetres, so that sums are exact in every engine.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.projection import planar, with_projection
from ..operators import build, hierarchy, kernel, relax, verify, workload
from ..runtime import shared_dir, written
from ..schema import Graph
from ..streaming.route_stream import kernel_answers, query_stream, route_stream
from .catalog import Catalog, table

CATALOG = Catalog()
add = CATALOG.add


def nodes(spark, d):
    return table(spark, d, "graph").select("id", "lat", "lon", "x_m", "y_m").where("id is not null").distinct()


def edges(spark, d):
    e = table(spark, d, "graph_edges").select("src", "dst", F.round(F.col("distance_m") * 1000).cast("bigint").alias("w"))
    return build.merged_edges(e)


def graph(spark, d):
    return Graph(nodes(spark, d), edges(spark, d))


def queries_of(spark, d):
    return table(spark, d, "queries").select("query_id", "source", "target").distinct()


def paths(spark, d):
    """Each path once."""
    return table(spark, d, "paths").select("path_id", "RouteId", "lat", "lng").dropDuplicates(["path_id"])


N = "n AS (SELECT DISTINCT id, lat, lon, x_m, y_m FROM graph WHERE id IS NOT NULL)"
E = """e AS (SELECT src, dst, min(CAST(round(distance_m * 1000) AS BIGINT)) AS w FROM graph_edges
      WHERE distance_m IS NOT NULL AND src <> dst GROUP BY src, dst)"""
Q = "q AS (SELECT DISTINCT query_id, source, target FROM queries WHERE query_id IS NOT NULL)"
P = "p AS (SELECT DISTINCT path_id, lat, lng FROM paths)"
POINTS = P + """, pt AS (SELECT path_id, pos, lat[pos + 1] AS lat, lng[pos + 1] AS lon FROM (SELECT *, unnest(range(len(lat))) AS pos FROM p)),
sg AS (SELECT * FROM (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM pt WINDOW w AS (PARTITION BY path_id ORDER BY pos))
       WHERE lat2 IS NOT NULL AND lon2 IS NOT NULL)"""


def labels(seed: str, edge: str = "e", extra: str = "") -> str:
    """Recursive part: l(s, node, r) with the least (g, h, p) of every node that a seed reaches."""
    return f"""l(s, node, r) USING KEY (s, node) AS (
  SELECT s, s AS node, {{'g': CAST(0 AS BIGINT), 'h': CAST(0 AS BIGINT), 'p': [s]}} AS r FROM ({seed}) AS seeds
  UNION
  SELECT x.s, x.node, x.r FROM (
    SELECT f.s, {edge}.dst AS node, min({{'g': f.r.g + {edge}.w, 'h': f.r.h + 1, 'p': list_append(f.r.p, {edge}.dst)}}) AS r
    FROM l AS f JOIN {edge} ON {edge}.src = f.node {extra} GROUP BY f.s, {edge}.dst) AS x
  LEFT JOIN recurring.l AS o ON o.s = x.s AND o.node = x.node WHERE o.r IS NULL OR x.r < o.r)"""


SOURCES = "SELECT DISTINCT source AS s FROM queries WHERE source IS NOT NULL"


def text(c):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


# --- construction -------------------------------------------------------------------------------


@add("route_points", f"WITH {POINTS} SELECT path_id, pos, lat, lon FROM pt")
def route_points(spark, d):
    return build.route_points(paths(spark, d), ["path_id"])


@add("route_segments", f"WITH {POINTS} SELECT path_id, pos, lat, lon, lat2, lon2 FROM sg")
def route_segments(spark, d):
    return build.segments(route_points(spark, d), ["path_id"])


@add("dense_node_ids", f"WITH {POINTS} SELECT row_number() OVER (ORDER BY lat, lon) - 1 AS id, lat, lon FROM (SELECT DISTINCT lat, lon FROM pt WHERE lat IS NOT NULL AND lon IS NOT NULL)")
def dense_node_ids(spark, d):
    return build.coordinate_nodes(route_points(spark, d))


@add("edges_min_merge", f"WITH {E} SELECT src, dst, w FROM e")
def edges_min_merge(spark, d):
    return edges(spark, d)


@add("route_graph_edges")
def route_graph_edges(spark, d):
    """The graph of all paths: nodes numbered, projected, segments merged."""
    return build.build_graph(paths(spark, d), ["path_id"]).edges


@add("build_stats", f"""WITH {POINTS},
k AS (SELECT path_id, pos, lat = lat2 AND lon = lon2 AS loop, lat, lon, lat2, lon2 FROM sg)
SELECT (SELECT count(*) FROM p) AS records, (SELECT count(*) FROM pt) AS samples, (SELECT count(*) FROM k) AS segments,
  (SELECT count(*) FROM k WHERE loop) AS loops_removed,
  (SELECT count(*) FROM k WHERE NOT loop) - (SELECT count(*) FROM (SELECT DISTINCT lat, lon, lat2, lon2 FROM k WHERE NOT loop)) AS duplicates_merged,
  (SELECT count(*) FROM (SELECT DISTINCT lat, lon FROM pt WHERE lat IS NOT NULL AND lon IS NOT NULL)) AS nodes,
  (SELECT count(*) FROM (SELECT DISTINCT lat, lon, lat2, lon2 FROM k WHERE NOT loop)) AS edges""")
def build_stats(spark, d):
    p = paths(spark, d)
    points = build.route_points(p, ["path_id"])
    n = build.projected(build.coordinate_nodes(points))
    return build.build_stats(p, build.segment_edges(build.segments(points, ["path_id"]), n), n)


@add("projected_nodes")
def projected_nodes(spark, d):
    """Projection of every positioned node beside the table's x_m, y_m."""
    n = nodes(spark, d).where("lat is not null and lon is not null and not (lat = 0 and lon = 0)")
    return with_projection(n, "px", "py", None).select("id", "x_m", "y_m", "px", "py")


@add("graph_violations", """WITH s AS (SELECT id, lat, lon, row_number() OVER (ORDER BY id NULLS FIRST, lat NULLS FIRST, lon NULLS FIRST) - 1 AS k FROM graph),
t AS (SELECT a.lat, a.lon, b.lat AS lat2, b.lon AS lon2 FROM s AS a JOIN s AS b ON b.k = a.k + 1),
e AS (SELECT src, dst, distance_m AS w FROM graph_edges),
v AS (SELECT 'id_gap' AS rule FROM s WHERE id IS DISTINCT FROM k
  UNION ALL SELECT 'bad_coordinate' FROM graph WHERE lat IS NULL OR lon IS NULL OR NOT lat BETWEEN -90 AND 90 OR NOT lon BETWEEN -180 AND 180
  UNION ALL SELECT 'coordinate_order' FROM t WHERE lat2 < lat OR (lat2 = lat AND lon2 <= lon)
  UNION ALL SELECT 'self_loop' FROM e WHERE src = dst
  UNION ALL SELECT 'bad_weight' FROM e WHERE w IS NULL OR w < 0
  UNION ALL SELECT 'unknown_end' FROM (SELECT src AS x FROM e UNION ALL SELECT dst FROM e) WHERE x NOT IN (SELECT id FROM graph)
  UNION ALL SELECT 'duplicate_edge' FROM (SELECT src, dst FROM e GROUP BY src, dst HAVING count(*) > 1))
SELECT rule, count(*) AS n FROM v GROUP BY rule""")
def graph_violations(spark, d):
    """Broken rules of the raw tables, with counts."""
    e = table(spark, d, "graph_edges").select("src", "dst", F.col("distance_m").alias("w"))
    return build.graph_violations(table(spark, d, "graph"), e).groupBy("rule").agg(F.count("*").alias("n"))


_DEG = f"WITH {N}, i AS (SELECT DISTINCT id FROM n), {E}"


@add("out_degree", _DEG + " SELECT i.id, count(e.src) AS degree FROM i LEFT JOIN e ON e.src = i.id GROUP BY i.id")
def out_degree(spark, d):
    return build.out_degree(nodes(spark, d).select("id").distinct(), edges(spark, d))


@add("in_degree", _DEG + " SELECT i.id, count(e.dst) AS degree FROM i LEFT JOIN e ON e.dst = i.id GROUP BY i.id")
def in_degree(spark, d):
    return build.out_degree(nodes(spark, d).select("id").distinct(), build.transposed(edges(spark, d)))


@add("csr_offsets", _DEG + """, g AS (SELECT i.id, count(e.src) AS degree FROM i LEFT JOIN e ON e.src = i.id GROUP BY i.id)
SELECT id, CAST(sum(degree) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) - degree AS BIGINT) AS first, degree FROM g""")
def csr_offsets(spark, d):
    return build.csr_offsets(nodes(spark, d).select("id").distinct(), edges(spark, d))


@add("adjacency_lists", f"WITH {E} SELECT src, string_agg(CAST(dst AS VARCHAR) || ':' || CAST(w AS VARCHAR), ',' ORDER BY dst) AS out FROM e GROUP BY src")
def adjacency_lists(spark, d):
    one = lambda x: F.concat(x["dst"].cast("string"), F.lit(":"), x["w"].cast("string"))
    return build.adjacency(edges(spark, d)).select("src", F.array_join(F.transform("out", one), ",").alias("out"))


@add("transpose_edges", f"WITH {E} SELECT dst AS src, src AS dst, w FROM e")
def transpose_edges(spark, d):
    return build.transposed(edges(spark, d))


@add("coord_bounds", f"WITH {N} SELECT min(x_m) AS min_x, max(x_m) AS max_x, min(y_m) AS min_y, max(y_m) AS max_y FROM n")
def coord_bounds(spark, d):
    return build.bounds(nodes(spark, d))


# --- routing --------------------------------------------------------------------------------------

_SSSP = f"WITH RECURSIVE {E}, {labels(SOURCES)}"


@add("sssp_distances", _SSSP + " SELECT s AS source, node, r.g AS g, r.h AS hops FROM l")
def sssp_distances(spark, d):
    """Every node that a query's source reaches, with its least distance."""
    return relax.single_source(edges(spark, d), queries_of(spark, d).select("source"), paths=False).select("source", "node", "g", "hops")


@add("path_nodes", _SSSP + " SELECT s AS source, node, array_to_string(r.p, ',') AS path FROM l")
def path_nodes(spark, d):
    """The paths: of equal length the one of fewest steps, then the least node sequence."""
    return relax.single_source(edges(spark, d), queries_of(spark, d).select("source")).select("source", "node", text(F.col("path")).alias("path"))


_ANSWERS = f"""WITH RECURSIVE {E}, {N}, {Q}, {labels(SOURCES)},
a AS (SELECT q.query_id, q.source, q.target,
  CASE WHEN q.source IN (SELECT id FROM n) AND coalesce(q.target IN (SELECT id FROM n), FALSE) THEN CASE WHEN l.node IS NULL THEN 'unreachable' ELSE 'found' END ELSE 'invalid_vertex' END AS status,
  l.r AS r FROM q LEFT JOIN l ON l.s = q.source AND l.node = q.target)
"""
_P2P = _ANSWERS + "SELECT query_id, status, CASE WHEN status = 'found' THEN r.g END AS distance FROM a"


@add("point_to_point", _ANSWERS + "SELECT query_id, status, CASE WHEN status = 'found' THEN r.g END AS distance, CASE WHEN status = 'found' THEN r.h END AS hops, CASE WHEN status = 'found' THEN array_to_string(r.p, ',') ELSE '' END AS path FROM a")
def point_to_point(spark, d):
    """Every query with status, distance and path (dijkstra)."""
    a = relax.point_to_point(nodes(spark, d), edges(spark, d), queries_of(spark, d))
    return a.select("query_id", "status", "distance", "hops", text(F.col("path")).alias("path"))


def _scale(spark, d):
    n = nodes(spark, d).select("id", (F.col("x_m") * 1000).alias("x_m"), (F.col("y_m") * 1000).alias("y_m"))
    return n, hierarchy.heuristic_scale(edges(spark, d), n).first().scale * (1 - 1e-12)


@add("astar_distances", _P2P)
def astar_distances(spark, d):
    """The same by goal-directed pruning; the scale keeps the estimate below every edge."""
    n, scale = _scale(spark, d)
    return relax.point_to_point(n, edges(spark, d), queries_of(spark, d), scale or None).select("query_id", "status", "distance")


@add("bidir_distances", _P2P)
def bidir_distances(spark, d):
    """The same from both ends."""
    return relax.bidirectional(nodes(spark, d), edges(spark, d), queries_of(spark, d)).select("query_id", "status", "distance")


def _kernel(spark, d, algorithm):
    n, scale = _scale(spark, d) if algorithm == "astar" else (nodes(spark, d), 0.0)
    net = kernel.collect_network(n, edges(spark, d))
    net.scale = scale
    return kernel.kernel_route(net, queries_of(spark, d), algorithm).select("query_id", "status", F.col("distance").cast("bigint").alias("distance"))


@add("kernel_dijkstra", _P2P)
def kernel_dijkstra(spark, d):
    """The same with one priority queue a query."""
    return _kernel(spark, d, "dijkstra")


@add("kernel_astar", _P2P)
def kernel_astar(spark, d):
    """The same with the scaled straight line in the queue's order; where an end of an edge has no position, the scale is 0."""
    return _kernel(spark, d, "astar")


@add("all_pairs", f"WITH RECURSIVE {E}, {N}, {labels('SELECT DISTINCT id AS s FROM n')} SELECT s AS source, node, r.g AS g FROM l")
def all_pairs(spark, d):
    return relax.all_pairs(edges(spark, d), nodes(spark, d).select("id").distinct())


@add("k_hop_reach", f"""WITH RECURSIVE {E}, h(s, node, k) AS (SELECT s, s, 0 FROM ({SOURCES}) UNION SELECT h.s, e.dst, h.k + 1 FROM h JOIN e ON e.src = h.node WHERE h.k < 3)
SELECT s AS source, count(DISTINCT node) AS reached FROM h GROUP BY s""")
def k_hop_reach(spark, d):
    """Nodes within three steps of each source."""
    r = relax.single_source(edges(spark, d), queries_of(spark, d).select("source"), max_hops=3, paths=False)
    return r.groupBy("source").agg(F.count("*").alias("reached"))


# --- index ----------------------------------------------------------------------------------------

L = 3500
CELLS = f"""b AS (SELECT min(x_m) AS x0, min(y_m) AS y0 FROM n),
c AS (SELECT id, CAST(floor((x_m - x0) / {L}.0) AS BIGINT) AS cx, CAST(floor((y_m - y0) / {L}.0) AS BIGINT) AS cy FROM n, b WHERE x_m IS NOT NULL AND y_m IS NOT NULL),
k AS (SELECT id, cx, cy, dense_rank() OVER (ORDER BY cx, cy) - 1 AS cluster FROM c),
ce AS (SELECT e.src, e.dst, e.w, a.cluster AS c1, z.cluster AS c2 FROM e JOIN k AS a ON a.id = e.src JOIN k AS z ON z.id = e.dst),
g AS (SELECT DISTINCT id, cluster FROM (SELECT src AS id, c1 AS cluster FROM ce WHERE c1 <> c2 UNION ALL SELECT dst, c2 FROM ce WHERE c1 <> c2))"""
_C = f"WITH {N}, {E}, {CELLS} "


def _clusters(spark, d):
    return hierarchy.grid_clusters(nodes(spark, d), float(L))


def _ce(spark, d):
    return written(hierarchy.clustered_edges(edges(spark, d), _clusters(spark, d)), "clustered")


@add("grid_clusters", _C + "SELECT id, cx, cy, cluster FROM k")
def grid_clusters(spark, d):
    return _clusters(spark, d)


@add("cluster_sizes", _C + "SELECT cluster, count(*) AS nodes FROM k GROUP BY cluster")
def cluster_sizes(spark, d):
    return hierarchy.cluster_sizes(_clusters(spark, d))


@add("cross_edges", _C + "SELECT src, dst, w, c1, c2 FROM ce WHERE c1 <> c2")
def cross_edges(spark, d):
    return hierarchy.cross_edges(_ce(spark, d))


@add("portals", _C + "SELECT id, cluster FROM g")
def portals(spark, d):
    return hierarchy.portals(_ce(spark, d))


@add("heuristic_scale", f"""WITH {N}, {E}, j AS (SELECT e.w / 1000.0 AS w, sqrt((a.x_m - z.x_m) * (a.x_m - z.x_m) + (a.y_m - z.y_m) * (a.y_m - z.y_m)) AS line
  FROM e JOIN n AS a ON a.id = e.src JOIN n AS z ON z.id = e.dst)
SELECT CASE WHEN bool_or(line IS NULL) THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, coalesce(min(CASE WHEN line > 0 THEN w / line END), 1.0)) END AS scale FROM j""")
def heuristic_scale(spark, d):
    e = edges(spark, d).select("src", "dst", (F.col("w") / 1000.0).alias("w"))
    return hierarchy.heuristic_scale(e, nodes(spark, d))


_SHORT = f"""WITH RECURSIVE {N}, {E}, {CELLS},
i AS (SELECT src, dst, w FROM ce WHERE c1 = c2), many AS (SELECT cluster FROM g GROUP BY cluster HAVING count(*) > 1),
{labels('SELECT id AS s FROM g WHERE cluster IN (SELECT cluster FROM many)', 'i')},
sc AS (SELECT l.s AS src, l.node AS dst, l.r.g AS w, array_to_string(list_slice(l.r.p, 2, len(l.r.p)), ',') AS path, g.cluster AS c
       FROM l JOIN g ON g.id = l.node WHERE l.node <> l.s)
"""


@add("cluster_shortcuts", _SHORT + "SELECT src, dst, w, path, c FROM sc")
def cluster_shortcuts(spark, d):
    ce = _ce(spark, d)
    s = hierarchy.shortcuts(ce, written(hierarchy.portals(ce), "portals"))
    return s.select("src", "dst", "w", text(F.col("path")).alias("path"), "c")


@add("overlay_edges", _SHORT + """SELECT src, dst, w, 'cross' AS kind, CAST(NULL AS BIGINT) AS c FROM ce WHERE c1 <> c2
UNION ALL SELECT src, dst, w, 'intra', c1 FROM ce WHERE c1 = c2 UNION ALL SELECT src, dst, w, 'shortcut', c FROM sc""")
def overlay_edges(spark, d):
    ce = _ce(spark, d)
    return hierarchy.overlay(ce, hierarchy.shortcuts(ce, written(hierarchy.portals(ce), "portals"))).select("src", "dst", "w", "kind", "c")


def _index(spark, d):
    g = Graph(nodes(spark, d).select("id", "lat", "lon", "x_m", "y_m"), edges(spark, d))
    return g, hierarchy.build_index(g, hierarchy.Options(float(L), 1.05))


@add("index_stats", _SHORT + """SELECT (SELECT count(DISTINCT cluster) FROM k) AS clusters, (SELECT max(m) FROM (SELECT count(*) AS m FROM k GROUP BY cluster)) AS max_cluster_nodes,
(SELECT count(*) FROM g) AS portals, (SELECT count(*) FROM ce WHERE c1 <> c2) AS cross_edges, (SELECT count(*) FROM sc) AS shortcuts,
(SELECT CAST(coalesce(sum(len(string_split(path, ','))), 0) AS BIGINT) FROM sc) AS path_nodes""")
def index_stats(spark, d):
    return hierarchy.index_stats(_index(spark, d)[1])


@add("transpose_overlay", _SHORT + """SELECT dst AS src, src AS dst, w, 'cross' AS kind FROM ce WHERE c1 <> c2
UNION ALL SELECT dst, src, w, 'intra' FROM ce WHERE c1 = c2 UNION ALL SELECT dst, src, w, 'shortcut' FROM sc""")
def transpose_overlay(spark, d):
    return hierarchy.transposed_index(_index(spark, d)[1]).select("src", "dst", "w", "kind")


def _positioned(spark, d):
    """Graph of the positioned nodes: the index needs a cluster for every node."""
    n = nodes(spark, d).where("x_m is not null and y_m is not null")
    known = n.select("id").distinct()
    e = edges(spark, d)
    e = e.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(written(n, "nodes"), written(e.select("src", "dst", "w"), "edges"))


_BOUND = f"""WITH RECURSIVE e0 AS (SELECT src, dst, min(CAST(round(distance_m * 1000) AS BIGINT)) AS w FROM graph_edges
      WHERE distance_m IS NOT NULL AND src <> dst GROUP BY src, dst),
n AS (SELECT DISTINCT id FROM graph WHERE x_m IS NOT NULL AND y_m IS NOT NULL),
e AS (SELECT * FROM e0 WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)), {Q}, {labels(SOURCES)}
SELECT s * 100000000 + node AS query_id, TRUE AS valid, TRUE AS within FROM l WHERE node <> s
"""


def _pairs(spark, d, g):
    """Every pair of a query's source and another node that it reaches, as queries with the least distance."""
    labels = relax.single_source(g.edges, queries_of(spark, d).select("source"), paths=False).where("node <> source")
    number = F.col("source") * 100_000_000 + F.col("node")
    return written(labels.select(number.alias("query_id"), "source", F.col("node").alias("target"), F.lit("found").alias("status"), F.col("g").alias("distance")), "pairs")


def _bound(answers, pairs, g, weight=1.05):
    j = verify.judged(pairs, written(answers, "answers"), pairs.select("query_id", "status", "distance"), g.edges, "any")
    bad = verify.bound_violations(j, weight).select("query_id", F.lit(False).alias("ok"))
    return pairs.select("query_id").join(j, "query_id").join(bad, "query_id", "left").select("query_id", F.col("error").isNull().alias("valid"), F.coalesce("ok", F.lit(True)).alias("within"))


@add("hpa_bound_check", _BOUND)
def hpa_bound_check(spark, d):
    """Weighted search on the overlay (set-based): paths are valid and within the weight."""
    g = _positioned(spark, d)
    index = hierarchy.build_index(g, hierarchy.Options(float(L), 1.05))
    pairs = _pairs(spark, d, g)
    return _bound(hierarchy.overlay_route(g, index, pairs.select("query_id", "source", "target")), pairs, g)


@add("bihpa_bound_check", _BOUND)
def bihpa_bound_check(spark, d):
    """The same from both ends."""
    g = _positioned(spark, d)
    index = hierarchy.build_index(g, hierarchy.Options(float(L), 1.05))
    pairs = _pairs(spark, d, g)
    return _bound(hierarchy.overlay_two_way(g, index, pairs.select("query_id", "source", "target")), pairs, g)


def _kernel_bound(spark, d, algorithm):
    g = _positioned(spark, d)
    index = hierarchy.build_index(g, hierarchy.Options(float(L), 1.05))
    net = kernel.collect_network(g.nodes, g.edges, index)
    pairs = _pairs(spark, d, g)
    return _bound(kernel.kernel_route(net, pairs, algorithm, 1.05), pairs, g)


@add("kernel_hpa_bound", _BOUND)
def kernel_hpa_bound(spark, d):
    return _kernel_bound(spark, d, "hpa")


@add("kernel_bihpa_bound", _BOUND)
def kernel_bihpa_bound(spark, d):
    return _kernel_bound(spark, d, "bihpa")


# --- checks ---------------------------------------------------------------------------------------


def _judged(spark, d, mode="optimal"):
    r = written(relax.point_to_point(nodes(spark, d), edges(spark, d), queries_of(spark, d)), "results")
    a = relax.bidirectional(nodes(spark, d), edges(spark, d), queries_of(spark, d))
    return verify.judged(queries_of(spark, d), r, a, edges(spark, d), mode)


@add("check_gap", _ANSWERS + "SELECT query_id, CAST(NULL AS VARCHAR) AS error, CASE WHEN status = 'found' THEN 0.0::DOUBLE END AS gap_percent, CASE WHEN status = 'found' THEN 0.0::DOUBLE END AS extra, CASE WHEN status = 'found' THEN TRUE END AS optimal FROM a")
def check_gap(spark, d):
    """Answers of one search judged against another's: no error and no gap."""
    return _judged(spark, d)


@add("check_report", _ANSWERS + """SELECT count(*) AS queries, 0 AS errors, count(CASE WHEN status = 'found' THEN 1 END) AS valid, count(CASE WHEN status = 'found' THEN 1 END) AS optimal,
0 AS undefined_gaps, max(CASE WHEN status = 'found' THEN 0.0::DOUBLE END) AS max_gap, max(CASE WHEN status = 'found' THEN 0.0::DOUBLE END) AS mean_gap, 0.0::DOUBLE AS max_extra FROM a""")
def check_report(spark, d):
    return verify.report(_judged(spark, d))


@add("check_path_edges", f"""WITH {POINTS}, {E}, {N}, i AS (SELECT DISTINCT src, dst FROM e)
SELECT q.query_id, 0 AS i, q.source AS src, q.target AS dst FROM (SELECT DISTINCT query_id, source, target FROM queries WHERE target IS NOT NULL) AS q
WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.src = q.source AND i.dst = q.target)""")
def check_path_edges(spark, d):
    """The straight step from source to target taken as a path: steps that are no edge."""
    r = queries_of(spark, d).where("target is not null").select("query_id", F.array("source", "target").alias("path"))
    return verify.missing_edges(r, edges(spark, d))


@add("set_equality", "SELECT coalesce(a.query_id, b.query_id) AS query_id, CASE WHEN b.query_id IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT query_id FROM queries) AS a FULL JOIN (SELECT DISTINCT query_id FROM timings) AS b ON a.query_id = b.query_id WHERE a.query_id IS NULL OR b.query_id IS NULL")
def set_equality(spark, d):
    """Queries that were never timed, and timed ones that are no query."""
    return verify.set_difference(table(spark, d, "queries"), table(spark, d, "timings"), "query_id")


@add("result_fingerprint")
def result_fingerprint(spark, d):
    return verify.fingerprint(point_to_point(spark, d))


# --- workload -------------------------------------------------------------------------------------

_WORK = f"""WITH RECURSIVE {E}, {N}, {labels('SELECT DISTINCT id AS s FROM n')},
t0 AS (SELECT s AS source, node, r.g AS g, row_number() OVER (PARTITION BY s ORDER BY md5('162163|' || s || '|' || node), node) AS k FROM l WHERE node <> s),
t AS (SELECT source, node, g FROM t0 WHERE k <= 10),
po AS (SELECT source, node, g FROM t ORDER BY md5('162163|' || source), source, md5('162163|' || source || '|' || node), node LIMIT 3000),
st AS (SELECT *, ntile(3) OVER (ORDER BY g, source, node) AS tile FROM po),
sn AS (SELECT source, node, g, CASE tile WHEN 1 THEN 'short' WHEN 2 THEN 'medium' ELSE 'long' END AS stratum FROM st)
"""


def _pool(spark, d):
    return workload.reachable_pool(edges(spark, d), nodes(spark, d).select("id").distinct())


@add("workload_targets", _WORK + "SELECT source, node, g FROM t")
def workload_targets(spark, d):
    return workload.sampled_targets(relax.all_pairs(edges(spark, d), nodes(spark, d).select("id").distinct()))


@add("workload_strata", _WORK + "SELECT source, node, g, stratum FROM sn")
def workload_strata(spark, d):
    return workload.strata(_pool(spark, d))


@add("workload_ranges", _WORK + "SELECT stratum, count(*) AS n, min(g) AS min_g, max(g) AS max_g FROM sn GROUP BY stratum")
def workload_ranges(spark, d):
    return workload.stratum_ranges(workload.strata(_pool(spark, d)))


@add("workload_sample", _WORK + """, c AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('162163s|' || source || '|' || node), source, node) AS k FROM sn)
SELECT row_number() OVER (ORDER BY md5('162163q|' || source || '|' || node), source, node) - 1 AS query_id, source, node AS target, g, stratum
FROM c WHERE k <= CASE stratum WHEN 'short' THEN 334 ELSE 333 END""")
def workload_sample(spark, d):
    return workload.stratified(written(workload.strata(_pool(spark, d)), "strata"))


@add("source_disjoint", f"WITH {N} SELECT DISTINCT id AS source FROM n WHERE id NOT IN (SELECT source FROM queries WHERE source IS NOT NULL)")
def source_disjoint(spark, d):
    """Nodes that no query starts from: sources of a second, disjoint workload."""
    return workload.sources(nodes(spark, d), queries_of(spark, d).select("source"))


# --- stream ---------------------------------------------------------------------------------------


@add("stream_route", _P2P)
def stream_route(spark, d):
    """The queries read as a stream, answered batch by batch, and read back."""
    out = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    net = kernel.collect_network(nodes(spark, d), edges(spark, d))
    from pathlib import Path

    # a folder of parts is one file source, a single file is picked by name
    folder = Path(f"{d}/queries.parquet").is_dir()
    stream = query_stream(spark, f"{d}/queries.parquet" if folder else d, "*.parquet" if folder else "queries.parquet", 4)
    route_stream(stream, kernel_answers(net), f"{out}/rows", f"{out}/state").awaitTermination()
    r = spark.read.schema("query_id bigint, status string, distance double, path array<bigint>").parquet(f"{out}/rows/*")
    return r.select("query_id", "status", F.col("distance").cast("bigint").alias("distance")).distinct()


@add("segment_lengths", f"""WITH {N}, {E} SELECT e.src, e.dst, round(sqrt((a.x_m - z.x_m) * (a.x_m - z.x_m) + (a.y_m - z.y_m) * (a.y_m - z.y_m)), 3) AS line
FROM e JOIN n AS a ON a.id = e.src JOIN n AS z ON z.id = e.dst""")
def segment_lengths(spark, d):
    """Straight line under every edge."""
    n = nodes(spark, d)
    a = n.select(F.col("id").alias("src"), F.col("x_m").alias("x1"), F.col("y_m").alias("y1"))
    b = n.select(F.col("id").alias("dst"), F.col("x_m").alias("x2"), F.col("y_m").alias("y2"))
    line = F.round(planar(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), 3)
    return edges(spark, d).join(a, "src").join(b, "dst").select("src", "dst", line.alias("line"))
