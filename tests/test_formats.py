import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tests.graphs import SIX, frames
from waygraph import cli
from waygraph.schema import Graph
from waygraph.sources import files, json_formats, text_formats

HASH = "7b" * 32
HEAD = f"ANY_GRAPH 1\nGRAPH_SHA256 {HASH}\nCOORDINATE_CRS EPSG:4326\nDISTANCE_CRS EPSG:3405\nWEIGHT_UNIT meter\nDIRECTED 1\n"
NODES = "NODES 3\n0 10 106 1 2\n1 10.01 106 1 3\n2 10.020000000000001 106 1.5e3 4\n"
EDGES = "EDGES 2\n0 1 1\n1 2 0.5\n"


def put(tmp_path, text, name="f.txt"):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_graph_text(spark, tmp_path):
    g = text_formats.read_graph_text(spark, put(tmp_path, HEAD + NODES + EDGES))
    assert g.sha256 == HASH
    assert [tuple(r) for r in g.nodes.orderBy("id").collect()][2] == (2, 10.020000000000001, 106.0, 1500.0, 4.0)
    out = str(tmp_path / "out")
    text_formats.write_graph_text(g, out)
    again = text_formats.read_graph_text(spark, out)
    assert sorted(again.nodes.collect()) == sorted(g.nodes.collect()) and sorted(again.edges.collect()) == sorted(g.edges.collect())
    with pytest.raises(Exception):
        text_formats.write_graph_text(g, out)


@pytest.mark.parametrize(
    "bad",
    [
        "", HEAD.replace("1\n", "2\n", 1) + NODES + EDGES, HEAD.replace("7b", "7B", 1) + NODES + EDGES, HEAD.replace("4326", "4327") + NODES + EDGES,
        HEAD.replace("DIRECTED 1", "DIRECTED 0") + NODES + EDGES, HEAD + NODES.replace("NODES 3", "NODES 4") + EDGES, HEAD + NODES.replace("NODES 3", "NODES 0"),
        HEAD + NODES.replace("\n1 10.01", "\n2 10.01") + EDGES, HEAD + NODES.replace("10.01 ", "9 ") + EDGES, HEAD + NODES.replace("10.01", "nan") + EDGES,
        HEAD + NODES.replace("10.01", "95") + EDGES, HEAD + NODES.replace("106 1 3", "106 1") + EDGES, HEAD + NODES + EDGES + "1 0 3\n",
        HEAD + NODES + EDGES.replace("EDGES 2", "EDGES 3"), HEAD + NODES + EDGES.replace("0 1 1", "0 0 1"), HEAD + NODES + EDGES.replace("0 1 1", "0 7 1"),
        HEAD + NODES + EDGES.replace("0 1 1", "0 1 -1"), HEAD + NODES + EDGES.replace("0 1 1", "2 1 1"), HEAD + NODES + EDGES.replace("1 2 0.5", "0 1 0.5"),
        HEAD + NODES + EDGES.replace("0 1 1", "0 x 1"), HEAD + NODES + EDGES.replace("0 1 1", "0 1 inf"),
    ],
)
def test_malformed_graph_text(spark, tmp_path, bad):
    with pytest.raises(Exception):
        g = text_formats.read_graph_text(spark, put(tmp_path, bad))
        g.nodes.collect(), g.edges.collect()


def test_queries_and_results_text(spark, tmp_path):
    q = f"ANY_QUERIES 1\nGRAPH_SHA256 {HASH}\nQUERIES 2\n7 0 -4\n3 1 2\n"
    rows = text_formats.read_queries_text(spark, put(tmp_path, q), HASH).orderBy("input_pos").collect()
    assert [tuple(r) for r in rows] == [(0, 7, 0, -4), (1, 3, 1, 2)]
    for bad in (q.replace("QUERIES 2", "QUERIES 3"), q.replace("3 1 2", "7 1 2"), q.replace("3 1 2", "3 1"), q.replace("3 1 2", "3 1 9223372036854775808"), q.replace("3 1 2", "-3 1 2"), q + "9 9 9\n"):
        with pytest.raises(Exception):
            text_formats.read_queries_text(spark, put(tmp_path, bad), HASH).collect()
    with pytest.raises(text_formats.FormatError):
        text_formats.read_queries_text(spark, put(tmp_path, q), "00" * 32)
    r = f"ANY_RESULTS 1\nGRAPH_SHA256 {HASH}\nRESULTS 3\n0 found 2.5 3 0 1 2\n1 unreachable - 0\n2 found 0 1 3\n"
    got = text_formats.read_results_text(spark, put(tmp_path, r), HASH)
    assert [tuple(x) for x in got.orderBy("query_id").collect()] == [(0, "found", 2.5, [0, 1, 2]), (1, "unreachable", None, []), (2, "found", 0.0, [3])]
    out = str(tmp_path / "results")
    text_formats.write_results_text(got, HASH, out)
    assert sorted(text_formats.read_results_text(spark, out).collect()) == sorted(got.collect())
    for bad in (r.replace("found 2.5", "lost 2.5"), r.replace("3 0 1 2", "2 0 1 2"), r.replace("unreachable -", "unreachable 4"), r.replace("found 0 1 3", "found - 1 3")):
        with pytest.raises(Exception):
            text_formats.read_results_text(spark, put(tmp_path, bad)).collect()


def document(**x):
    nodes = [{"id": i, "lat": 10 + i / 100, "lon": 106} for i in range(3)]
    edges = [{"source": 0, "target": 1, "distance_m": 1}, {"source": 1, "target": 2, "distance_m": 0.5}]
    return {"schema_version": 1, "directed": True, "coordinate_crs": "EPSG:4326", "distance_crs": "EPSG:3405", "weight_unit": "meter", "nodes": nodes, "edges": edges} | x


def test_graph_json(spark, tmp_path):
    g = json_formats.read_graph_json(spark, put(tmp_path, json.dumps(document()), "g.json"))
    n = g.nodes.orderBy("id").collect()
    assert len(n) == 3 and abs(n[0].x_m - 609404.12468161876) < 1e-3 and abs(n[0].y_m - 1105690.2011947799) < 1e-3
    d = document()
    bads = [document(schema_version=2), document(directed=False), document(nodes=[]), document(edges=[*d["edges"], d["edges"][0]]), document(nodes=[{"id": True, "lat": 10, "lon": 106}], edges=[])]
    bads += [document(nodes=[{"id": 0, "lat": "10", "lon": 106}], edges=[]), document(nodes=[{"id": 1, "lat": 10, "lon": 106}], edges=[]), document(edges=[{"source": 0, "target": 0, "distance_m": 1}]), {k: v for k, v in d.items() if k != "edges"}]
    for i, bad in enumerate(bads):
        with pytest.raises(Exception):
            x = json_formats.read_graph_json(spark, put(tmp_path, json.dumps(bad), f"b{i}.json"))
            x.nodes.collect()
    out = str(tmp_path / "doc")
    json_formats.write_graph_json(g, out)
    assert sorted(json_formats.read_graph_json(spark, out).edges.collect()) == sorted(g.edges.collect())


def test_graph_json_by_many_tasks(spark, tmp_path):
    """No task writes or reads the document as one row."""
    n = 3000
    nodes = spark.range(n).selectExpr("id", "10 + id / 10000d as lat", "106d as lon", "0d as x_m", "0d as y_m")
    edges = spark.range(n - 1).selectExpr("id as src", "id + 1 as dst", "id / 7d as w")
    out = tmp_path / "a b%20c"
    json_formats.write_graph_json(Graph(nodes, edges), str(out))
    (part,) = out.glob("part-*.json")
    text = part.read_text()
    assert max(map(len, text.splitlines())) < 300
    doc = json.loads(text)
    assert [x["id"] for x in doc["nodes"]] == list(range(n)) and [(x["source"], x["distance_m"]) for x in doc["edges"]] == [(i, i / 7) for i in range(n - 1)]
    assert not list(tmp_path.glob("*.parts-*"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        for i, layout in enumerate((text, json.dumps(doc), json.dumps(doc, indent=2))):
            g = json_formats.read_graph_json(spark, put(tmp_path, layout, f"l{i}.json"))
            assert sorted(map(tuple, g.edges.collect())) == [(i, i + 1, i / 7) for i in range(n - 1)] and g.sha256 == hashlib.sha256(layout.encode()).hexdigest()
            assert [tuple(r) for r in g.nodes.select("id", "lat").orderBy("id").collect()] == [(i, 10 + i / 10000) for i in range(n)]
            for t in (g.nodes, g.edges):
                assert t.select(F.spark_partition_id()).distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_graph_json_layouts(spark, tmp_path):
    d = document()
    want = sorted([(0, 1, 1.0), (1, 2, 0.5)])
    odd = {"id": 7, "source": "x", "lat": None}
    metadata = [
        {"statistics": {"node_count": 3, "of": [{"a": 1}, {"b": [{}]}]}}, {"note": "}, {a}, {\"id\": 9}, ]"}, {"other": [odd, odd, odd]}, {"deep": [{"nodes": [odd, odd], "edges": [odd, odd]}]},
        {"nodes": [x | {"name": f"a}}b,{{{x['id']}"} for x in d["nodes"]]}, {"nodes": [x | {"tags": [{"k": 1}, {"k": 2}]} for x in d["nodes"]], "many": [{"x": {}}] * 1500},
    ]
    for i, more in enumerate(metadata):
        doc = dict(reversed((d | more).items())) if i % 2 else d | more
        g = json_formats.read_graph_json(spark, put(tmp_path, json.dumps(doc, indent=i % 3 or None), f"m{i}.json"))
        assert sorted(map(tuple, g.edges.collect())) == want and sorted(r.id for r in g.nodes.collect()) == [0, 1, 2]
    text = json.dumps(d)
    assert text.endswith("]}")
    for i, bad in enumerate((text[:-1], text.replace("}, {", "} {", 1), text.replace("}, {", "},, {", 1), text.replace('}], "edges"', '},], "edges"'), text.replace('"lat": 10.01', '"lat": NaN'), text.replace('"lat": 10.01', '"lat": "10.01"'), text.replace('"id": 1', '"id": 1.0'), text.replace('"id": 1', '"id": null'), text.replace('"target": 2, ', ""), text.replace("0.5", "1e999"), text.replace("0.5", "05"), text.replace("}, {", "}, 3, {", 1), text[:-3], "", "[]")):
        assert bad != text
        with pytest.raises(Exception):
            x = json_formats.read_graph_json(spark, put(tmp_path, bad, f"x{i}.json"))
            x.nodes.collect(), x.edges.collect()


def test_routes_and_answers(spark, tmp_path):
    good = '{"RouteId":"a","RouteVarId":"b","lat":[1],"lng":[2]}'
    p = put(tmp_path, f"{good}\n\n{good}\n")
    assert [r.line_id for r in json_formats.read_routes(spark, p).orderBy("line_id").collect()] == [1, 3]
    p = put(tmp_path, f"{good}\n{{\n", "bad.txt")
    with pytest.raises(text_formats.FormatError, match="line 2"):
        json_formats.read_routes(spark, p)
    assert json_formats.read_routes(spark, p, strict=False).count() == 1
    a = {"schema_version": 1, "graph_sha256": HASH, "queries_sha256": HASH, "answers": [{"query_id": 0, "status": "found", "distance_m": 2.0}, {"query_id": 1, "status": "unreachable", "distance_m": None}]}
    assert json_formats.read_answers(spark, put(tmp_path, json.dumps(a), "a.json"), HASH).count() == 2
    a["answers"][1]["distance_m"] = 1
    with pytest.raises(text_formats.FormatError):
        json_formats.read_answers(spark, put(tmp_path, json.dumps(a), "b.json"), HASH)


def test_timings_csv(spark, tmp_path):
    old = files.read_timings_csv(spark, put(tmp_path, "repetition,query_id,duration_ns,status\n1,5,70,found\n", "old.csv")).collect()
    assert [tuple(r) for r in old] == [(1, 5, 70, "found", 0, 70)]
    new = files.read_timings_csv(spark, put(tmp_path, "repetition,query_id,duration_ns,status,wait_ns,latency_ns\n1,5,70,found,3,73\n", "new.csv"))
    out = str(tmp_path / "csv")
    files.write_timings_csv(new, out)
    assert new.collect()[0].latency_ns == 73
    with pytest.raises(text_formats.FormatError):
        files.read_timings_csv(spark, put(tmp_path, "a,b\n1,2\n", "x.csv"))
    with pytest.raises(FileExistsError):
        files.protect([out])
    with pytest.raises(ValueError):
        files.protect([str(tmp_path / "n"), str(tmp_path / "n")])


def test_cli(spark, tmp_path):
    graph = put(tmp_path, HEAD + NODES + EDGES, "graph.txt")
    queries = put(tmp_path, f"ANY_QUERIES 1\nGRAPH_SHA256 {HASH}\nQUERIES 3\n5 0 2\n4 2 0\n1 1 1\n", "queries.txt")
    out = str(tmp_path / "results")
    assert cli.main(["route", "--graph", graph, "--queries", queries, "--output", out, "--algorithm", "dijkstra"], spark) == 0
    text = "".join(p.read_text() for p in sorted((tmp_path / "results").glob("part*")))
    assert text.splitlines()[3:] == ["5 found 1.5 3 0 1 2", "4 unreachable - 0", "1 found 0 1 1"]
    a = {"schema_version": 1, "graph_sha256": HASH, "answers": [{"query_id": 5, "status": "found", "distance_m": 1.5}, {"query_id": 4, "status": "unreachable", "distance_m": None}, {"query_id": 1, "status": "found", "distance_m": 0.0}]}
    answers = put(tmp_path, json.dumps(a), "answers.json")
    assert cli.main(["check", "--graph", graph, "--queries", queries, "--answers", answers, "--results", out], spark) == 0
    bad = put(tmp_path, f"ANY_QUERIES 1\nGRAPH_SHA256 {HASH}\nQUERIES 1\n5 0 9\n", "bad.txt")
    assert cli.main(["route", "--graph", graph, "--queries", bad, "--output", out + "2", "--algorithm", "dijkstra"], spark) == 1
    assert cli.main(["route", "--graph", graph, "--queries", queries, "--output", out, "--algorithm", "dijkstra"], spark) == 1
    assert cli.main(["route", "--graph", graph, "--queries", queries, "--output", out + "3", "--algorithm", "dijkstra", "--weight", "1.1"], spark) == 1
    assert cli.main(["bench", "--graph", graph, "--queries", queries, "--output", str(tmp_path / "bench"), "--algorithm", "dijkstra", "--repetitions", "2"], spark) == 0
    with pytest.raises(SystemExit):
        cli.main(["route", "--graph", graph, "--graph", graph, "--queries", queries, "--output", out, "--algorithm", "dijkstra"], spark)


def test_graph_text_by_many_tasks(spark, tmp_path, monkeypatch):
    """The lines are sorted by several tasks, not by one, and stand in order in one file."""
    n, widths = 500, []
    nodes = spark.range(n).selectExpr("id", "10 + id / 10000d as lat", "106d as lon", "id + 0.5d as x_m", "0d as y_m").repartition(5)
    edges = spark.range(n - 1).selectExpr("id as src", "id + 1 as dst", "id / 7d as w").repartition(5)
    kept = type(nodes).repartitionByRange
    monkeypatch.setattr(type(nodes), "repartitionByRange", lambda self, k, *c: widths.append(k) or kept(self, k, *c))
    text_formats.write_graph_text(Graph(nodes, edges, HASH), str(tmp_path / "out"))
    assert widths and min(widths) > 1
    (part,) = (tmp_path / "out").glob("part-*")
    lines = part.read_text().splitlines()
    assert lines[6] == f"NODES {n}" and lines[7 + n] == f"EDGES {n - 1}" and len(lines) == 8 + n + n - 1
    assert [int(x.split()[0]) for x in lines[7 : 7 + n]] == list(range(n)) and [tuple(map(float, x.split())) for x in lines[8 + n :]] == [(i, i + 1, i / 7) for i in range(n - 1)]


def test_text_of_six(spark, tmp_path):
    out = str(tmp_path / "six")
    text_formats.write_graph_text(frames(spark, *SIX), out)
    assert text_formats.read_graph_text(spark, out).edges.count() == 6
