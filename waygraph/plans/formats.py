"""Queries of files, options, dispatch and checks: round trips through the shared folder, and altered answers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import bench_stats, build, hierarchy, kernel, relax, verify, workload
from ..operators.route import route
from ..runtime import discard, discard_folder, shared_dir, written
from ..schema import Graph
from ..sources import files, json_formats, text_formats
from .catalog import Catalog, table
from .graphs import _ANSWERS, POINTS, edges, nodes, paths, queries_of, text
from .timing import _RUNS, _runs, readings

CATALOG = Catalog()
add = CATALOG.add

#: stands for the hash of a graph where a format wants one
HASH = "0" * 64


def _new(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- files ------------------------------------------------------------------------------------------


@add("route_lines_read", "SELECT RouteId, RouteVarId, len(lat) AS points, lat[1] AS first_lat, lng[len(lng)] AS last_lng FROM (SELECT DISTINCT path_id, RouteId, RouteVarId, lat, lng FROM paths) WHERE len(lat) > 0 AND RouteId <> '' AND RouteVarId <> ''")
def route_lines_read(spark, d):
    """The paths written as route lines and read strictly."""
    at = _new(spark, "routes")
    p = table(spark, d, "paths").dropDuplicates(["path_id"]).where("size(lat) > 0 and RouteId <> '' and RouteVarId <> ''")
    p.select(F.to_json(F.struct("RouteId", "RouteVarId", "lat", "lng"))).write.text(at)
    return json_formats.read_routes(spark, at).select("RouteId", "RouteVarId", F.size("lat").cast("bigint").alias("points"), F.col("lat")[0].alias("first_lat"), F.element_at("lng", -1).alias("last_lng"))


def _path_graph(spark, d) -> Graph:
    g = build.build_graph(paths(spark, d), ["path_id"])
    return Graph(written(g.nodes, "nodes"), written(g.edges, "edges"))


def _graph_json(spark, d) -> Graph:
    at, g = _new(spark, "graph"), _path_graph(spark, d)
    json_formats.write_graph_json(g, at)
    discard(g.nodes)
    discard(g.edges)
    # the one part of the folder
    out = json_formats.read_graph_json(spark, f"{at}/part-*.json")
    discard_folder(spark, at)
    return out


_IDS = f"WITH {POINTS}, i AS (SELECT row_number() OVER (ORDER BY lat, lon) - 1 AS id, lat, lon FROM (SELECT DISTINCT lat, lon FROM pt WHERE lat IS NOT NULL AND lon IS NOT NULL))"


@add("graph_json_nodes", _IDS + " SELECT id, lat, lon FROM i")
def graph_json_nodes(spark, d):
    """Nodes of the paths' graph after a round trip through the canonical document."""
    return _graph_json(spark, d).nodes.select("id", "lat", "lon")


@add("graph_text_edges", _IDS + " SELECT DISTINCT a.id AS src, b.id AS dst FROM sg JOIN i AS a ON a.lat = sg.lat AND a.lon = sg.lon JOIN i AS b ON b.lat = sg.lat2 AND b.lon = sg.lon2 WHERE a.id <> b.id")
def graph_text_edges(spark, d):
    """Edges of the paths' graph after a round trip through the document and the text file."""
    at = _new(spark, "text")
    text_formats.write_graph_text(_graph_json(spark, d), at)
    out = text_formats.read_graph_text(spark, at).edges.select("src", "dst")
    discard_folder(spark, at)
    return out


_WHOLE = "SELECT DISTINCT query_id, source, target FROM queries WHERE query_id IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL"


@add("queries_text_read", f"SELECT query_id, source, target, row_number() OVER (ORDER BY query_id) - 1 AS input_pos FROM ({_WHOLE})")
def queries_text_read(spark, d):
    """The queries written as a text file and read back."""
    at = _new(spark, "queries")
    text_formats.write_queries_text(queries_of(spark, d).dropna(), HASH, at)
    return text_formats.read_queries_text(spark, at, HASH)


def _answers(spark, d):
    return written(relax.point_to_point(nodes(spark, d), edges(spark, d), queries_of(spark, d)), "answers")


@add("results_text_read", _ANSWERS + "SELECT query_id, status, CASE WHEN status = 'found' THEN CAST(r.g AS DOUBLE) END AS distance, CASE WHEN status = 'found' THEN array_to_string(r.p, ',') ELSE '' END AS path FROM a")
def results_text_read(spark, d):
    """All answers written as a results file and read back."""
    at = _new(spark, "results")
    text_formats.write_results_text(_answers(spark, d), HASH, at)
    return text_formats.read_results_text(spark, at, HASH).select("query_id", "status", "distance", text(F.col("path")).alias("path"))


@add("results_in_order", "SELECT row_number() OVER (ORDER BY md5('order|' || query_id), query_id) - 1 AS line, query_id FROM (SELECT DISTINCT query_id FROM queries WHERE query_id IS NOT NULL)")
def results_in_order(spark, d):
    """Lines of a results file whose queries came in a seeded order."""
    at = _new(spark, "results")
    q = queries_of(spark, d).select("query_id", workload.order_hash("order", "query_id").alias("_h"))
    pos = build.number_rows(q, ["_h", "query_id"], "input_pos").select("query_id", "input_pos")
    text_formats.write_results_text(_answers(spark, d).join(pos, "query_id"), HASH, at)
    lines = text_formats.numbered_lines(spark, at).where("line >= 3")
    return lines.select((F.col("line") - 3).alias("line"), F.split("value", " ")[0].cast("bigint").alias("query_id"))


@add("answers_json_read", _ANSWERS + "SELECT query_id, status, CASE WHEN status = 'found' THEN CAST(r.g AS DOUBLE) END AS distance, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS \"group\" FROM a")
def answers_json_read(spark, d):
    """All answers written as a document of known answers (one object by its format) and read back."""
    at = _new(spark, "known")
    one = F.struct("query_id", "status", F.col("distance").cast("double").alias("distance_m"), F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("group"))
    doc = _answers(spark, d).agg(F.collect_list(one).alias("answers"))
    doc.select(F.lit(1).alias("schema_version"), F.lit(HASH).alias("graph_sha256"), F.lit(HASH).alias("queries_sha256"), "answers").coalesce(1).write.json(at)
    return json_formats.read_answers(spark, f"{at}/part-*.json", HASH)


_TIMES = ("repetition", "query_id", "duration_ns", "status", "wait_ns", "latency_ns")


@add("timings_csv_read", f"SELECT {', '.join(_TIMES)} FROM (SELECT DISTINCT {', '.join(_TIMES)}, worker, recorded_at FROM timings) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _TIMES)}")
def timings_csv_read(spark, d):
    """The complete readings written as timings files and read back."""
    at = _new(spark, "timings")
    files.write_timings_csv(readings(spark, d).dropna(subset=list(_TIMES)), at)
    return files.read_timings_csv(spark, at).select(*_TIMES)


@add("timings_csv_legacy", f"SELECT repetition, query_id, duration_ns, status, CAST(0 AS BIGINT) AS wait_ns, duration_ns AS latency_ns FROM (SELECT DISTINCT {', '.join(_TIMES)}, worker, recorded_at FROM timings) WHERE wait_ns IS NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _TIMES[:4])}")
def timings_csv_legacy(spark, d):
    """Readings without wait and latency, in the older form of the files."""
    at = _new(spark, "timings")
    readings(spark, d).where("wait_ns is null").dropna(subset=list(_TIMES[:4])).select(*_TIMES[:4]).write.csv(at, header=True)
    return files.read_timings_csv(spark, at).select(*_TIMES)


@add("file_hash", "SELECT sha256(string_agg(r_name, chr(10) ORDER BY r_name) || chr(10)) AS sha256 FROM region")
def file_hash(spark, d):
    """Hash of a file with the regions' names, a line each."""
    at = _new(spark, "names")
    table(spark, d, "region").select("r_name").orderBy("r_name").coalesce(1).write.text(at)
    return spark.createDataFrame([(files.sha256(spark, f"{at}/part-*.txt"),)], "sha256 string")


# --- options, dispatch ------------------------------------------------------------------------------


@add("option_validity", "SELECT DISTINCT p_size - 25 AS size, 1 + (p_size % 3 - 1) / 100.0::DOUBLE AS weight, p_size > 25 AND p_size % 3 = 2 AS valid FROM part")
def option_validity(spark, d):
    """Cluster sizes and weights from the parts: positive size and a weight of more than one are valid."""

    def valid(size: float, weight: float) -> bool:
        try:
            hierarchy.Options(size, weight)
        except ValueError:
            return False
        return True

    sizes = [r.p_size for r in table(spark, d, "part").select("p_size").distinct().toLocalIterator()]
    rows = [(s - 25, 1 + (s % 3 - 1) / 100) for s in sizes]
    return spark.createDataFrame([(*r, valid(*r)) for r in rows], "size int, weight double, valid boolean")


@add("index_identity", "SELECT * FROM (VALUES ('same', TRUE), ('other size', FALSE), ('other graph', FALSE)) AS t(what, fits)")
def index_identity(spark, d):
    """An index fits its own graph and cluster size only."""
    g = Graph(nodes(spark, d), edges(spark, d), HASH)
    index = hierarchy.Index(hierarchy.grid_clusters(g.nodes, 3500.0), g.edges, 0.0, hierarchy.Options(3500.0, 1.05), HASH)

    def fits(graph: Graph, options: hierarchy.Options) -> bool:
        try:
            index.check(graph, options)
        except ValueError:
            return False
        return True

    own = hierarchy.Options(3500.0, 1.01)
    rows = [("same", fits(g, own)), ("other size", fits(g, hierarchy.Options(3000.0, 1.05))), ("other graph", fits(Graph(g.nodes, g.edges, "1" * 64), own))]
    return spark.createDataFrame(rows, "what string, fits boolean")


_ROUTES = [("dijkstra", "relational"), ("dijkstra_baseline", "relational"), ("astar", "relational"), ("dijkstra", "kernel"), ("dijkstra_baseline", "kernel"), ("astar", "kernel")]


@add("route_dispatch", _ANSWERS + f"SELECT algorithm, strategy, query_id, status, CASE WHEN status = 'found' THEN r.g END AS distance FROM a, (VALUES {', '.join(map(str, _ROUTES))}) AS t(algorithm, strategy)")
def route_dispatch(spark, d):
    """Every exact algorithm in both ways through the one call."""
    n = nodes(spark, d).select("id", (F.col("x_m") * 1000).alias("x_m"), (F.col("y_m") * 1000).alias("y_m"))
    g = Graph(written(n, "nodes"), written(edges(spark, d), "edges"))
    out = None
    for algorithm, strategy in _ROUTES:
        r = route(g, queries_of(spark, d), algorithm, strategy).select(F.lit(algorithm).alias("algorithm"), F.lit(strategy).alias("strategy"), "query_id", "status", F.col("distance").cast("bigint").alias("distance"))
        out = r if out is None else out.unionByName(r)
    return out


@add("kernel_baseline", _ANSWERS + "SELECT query_id, status, CASE WHEN status = 'found' THEN r.g END AS distance FROM a")
def kernel_baseline(spark, d):
    """One queue a query, nothing kept between queries."""
    net = kernel.collect_network(nodes(spark, d), edges(spark, d))
    return kernel.kernel_route(net, queries_of(spark, d), "dijkstra_baseline").select("query_id", "status", F.col("distance").cast("bigint").alias("distance"))


# --- checks of wrong answers ------------------------------------------------------------------------

# what is changed in the answer of a query, by the remainder of its number: 1 status, 2 direction of the path,
# 3 only its ends are left, 4 distance, 5 to 7 the known answer (more, one less, nothing)
_FAULTY = _ANSWERS.replace("a AS (SELECT", "a0 AS (SELECT", 1) + """, a AS (SELECT * FROM a0 UNION ALL SELECT s * 100000000 + node, s, node, 'found', r FROM l WHERE node <> s),
b AS (SELECT a.query_id, a.status, r.g AS g, r.h AS h, a.query_id % 8 AS k, e.w AS direct, CASE WHEN status = 'found' THEN query_id % 8 END AS f
  FROM a LEFT JOIN e ON e.src = a.source AND e.dst = a.target),
c AS (SELECT *, CASE WHEN h = 0 AND f IN (2, 3) THEN 0 ELSE f END AS x, CASE f WHEN 5 THEN g + 5000 WHEN 6 THEN g - 1 WHEN 7 THEN 0 ELSE g END AS known FROM b),
j AS (SELECT query_id, CASE
    WHEN status <> 'found' THEN CASE WHEN k = 4 THEN 'not_implemented' END
    WHEN x = 1 THEN 'wrong_status' WHEN x = 2 THEN 'wrong_ends'
    WHEN x = 3 THEN CASE WHEN direct IS NULL THEN 'missing_edge' WHEN direct <> g THEN 'wrong_sum' END
    WHEN x = 4 THEN 'wrong_sum' WHEN x = 5 THEN 'shorter_than_answer'
    WHEN x IN (6, 7) AND g <> known THEN 'not_optimal' END AS error, status, g, known FROM c),
v AS (SELECT query_id, error, status = 'found' AND (error IS NULL OR error = 'not_optimal') AS ok, CAST(g AS DOUBLE) AS g, CAST(known AS DOUBLE) AS known FROM j),
z AS (SELECT query_id, error, CASE WHEN ok THEN CASE WHEN known > 0 THEN greatest(0.0::DOUBLE, (g / known - 1) * 100) WHEN g = known THEN 0.0::DOUBLE END END AS gap_percent,
  CASE WHEN ok THEN greatest(0.0::DOUBLE, g - known) END AS extra, CASE WHEN ok THEN g = known END AS optimal FROM v)
"""


def _altered(spark, d):
    # every pair of a source and a node that it reaches is asked as well
    number = (F.col("source") * 100_000_000 + F.col("node")).alias("query_id")
    reached = written(relax.single_source(edges(spark, d), queries_of(spark, d).select("source")).where("node <> source"), "reached")
    a = _answers(spark, d).unionByName(reached.select(number, F.lit("found").alias("status"), F.col("g").alias("distance"), "hops", "path"))
    q = queries_of(spark, d).unionByName(reached.select(number, "source", F.col("node").alias("target")))
    k, found, long = F.col("query_id") % 8, F.col("status") == "found", F.size("path") > 1
    none = F.array().cast("array<bigint>")
    r = a.select(
        "query_id",
        F.when(found & (k == 1), "unreachable").when(~found & (k == 4), "not_implemented").otherwise(F.col("status")).alias("status"),
        F.when(found & (k == 4), F.col("distance") + 1000).when(found & (k == 1), F.lit(None)).otherwise(F.col("distance")).alias("distance"),
        F.when(found & (k == 1), none).when(found & (k == 2), F.reverse("path")).when(found & (k == 3) & long, F.array(F.col("path")[0], F.element_at("path", -1))).otherwise(F.col("path")).alias("path"),
    )
    known = a.select("query_id", "status", F.when(found & (k == 5), F.col("distance") + 5000).when(found & (k == 6), F.col("distance") - 1).when(found & (k == 7), F.lit(0)).otherwise(F.col("distance")).alias("distance"))
    return verify.judged(q, written(r, "altered"), known, edges(spark, d))


@add("check_faults", _FAULTY + "SELECT * FROM z")
def check_faults(spark, d):
    """Answers altered in seven ways: each is judged by the first rule it breaks, with gap and extra length."""
    return _altered(spark, d)


@add("check_faults_report", _FAULTY + """SELECT count(*) AS queries, count(error) AS errors, count(optimal) AS valid, count(CASE WHEN optimal THEN 1 END) AS optimal,
count(CASE WHEN optimal IS NOT NULL AND gap_percent IS NULL THEN 1 END) AS undefined_gaps, round(max(gap_percent), 9) AS max_gap, round(avg(gap_percent), 9) AS mean_gap, coalesce(max(extra), 0.0) AS max_extra FROM z""")
def check_faults_report(spark, d):
    """The report of the altered answers."""
    return verify.report(_altered(spark, d)).withColumn("max_gap", F.round("max_gap", 9)).withColumn("mean_gap", F.round("mean_gap", 9))


@add("bound_faults", _FAULTY + "SELECT query_id FROM z WHERE optimal IS NOT NULL AND (gap_percent IS NULL OR gap_percent > 1e-3 + 1e-6)")
def bound_faults(spark, d):
    """Altered answers beyond a bound of a thousandth of a percent, undefined gaps among them."""
    return verify.bound_violations(_altered(spark, d), 1.00001).select("query_id")


@add("same_rows", "SELECT query_id, source, target, 'left' AS side FROM (SELECT query_id, source, target FROM queries EXCEPT ALL SELECT DISTINCT query_id, source, target FROM queries)")
def same_rows(spark, d):
    """Rows that the raw queries have more often than the distinct ones."""
    q = table(spark, d, "queries").select("query_id", "source", "target")
    return verify.same_rows(q, q.distinct())


# --- tuning -----------------------------------------------------------------------------------------

_FAIL = """, tried AS (SELECT *, build_ms % 3 <> 0 AS ok, CASE WHEN size = 4 AND index_bytes % 2 = 0 THEN 'astar' ELSE 'hpa' END AS algorithm, index_bytes % 5 <> 0 AS pass FROM runs)
SELECT size, CAST(1.01 AS DOUBLE) AS weight, count(*) AS processes, median(mean_ms) AS score_ms, median(p95_ms) AS p95_ms, min(index_bytes) AS index_bytes, median(build_ms) AS build_ms
FROM tried WHERE ok AND algorithm = 'hpa' GROUP BY size HAVING bool_and(pass)"""


@add("tuning_candidates_failing", _RUNS + _FAIL)
def tuning_candidates_failing(spark, d):
    """Settings of which every process ran and passed; some processes failed, some were of another algorithm."""
    r = _runs(spark, d)
    other = (F.col("size") == 4) & (F.col("index_bytes") % 2 == 0)
    r = r.withColumn("ok", F.col("build_ms") % 3 != 0).withColumn("algorithm", F.when(other, "astar").otherwise("hpa")).withColumn("pass", F.col("index_bytes") % 5 != 0)
    return bench_stats.candidates(r)


@add("tuning_top_sizes", _RUNS + """, best AS (SELECT size FROM cand WHERE score_ms <= (SELECT min(score_ms) FROM cand) * 1.03::DOUBLE ORDER BY p95_ms, index_bytes, build_ms, size, weight LIMIT 1),
rest AS (SELECT * FROM cand WHERE size NOT IN (SELECT size FROM best)),
next AS (SELECT size FROM rest WHERE score_ms <= (SELECT min(score_ms) FROM rest) * 1.03::DOUBLE ORDER BY p95_ms, index_bytes, build_ms, size, weight LIMIT 1)
SELECT 1 AS place, size FROM best UNION ALL SELECT 2, size FROM next""")
def tuning_top_sizes(spark, d):
    """The two best sizes, the second without the first."""
    best = bench_stats.top_sizes(written(bench_stats.candidates(_runs(spark, d)), "candidates"))
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(best)], "place int, size bigint")


@add("paired_schedule", "SELECT row_number() OVER (ORDER BY md5('162164|' || i), i) AS place, CASE WHEN i % 2 = 0 THEN 'hpa' ELSE 'bihpa' END AS first FROM range(24) AS t(i)")
def paired_schedule(spark, d):
    """Which of two algorithms runs first in each of 24 pairs: half and half, in a seeded order."""
    return spark.createDataFrame([(i + 1, o[0]) for i, o in enumerate(bench_stats.balanced_schedule(24, "hpa", "bihpa", "162164"))], "place bigint, first string")
