"""JSON files: route lines, the canonical graph, known answers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.projection import with_projection
from ..operators.build import require_valid
from ..operators.rejects import parsed_lines
from ..runtime import discard, hadoop_path, write_whole, written
from ..schema import COORDINATE_CRS, DISTANCE_CRS, WEIGHT_UNIT, Graph
from .files import one_file, sha256
from .text_formats import FormatError, numbered_lines

_HEAD = "schema_version bigint, directed boolean, coordinate_crs string, distance_crs string, weight_unit string"
_GRAPH = _HEAD + ", nodes array<struct<id:bigint,lat:double,lon:double>>, edges array<struct<source:bigint,target:bigint,distance_m:double>>"
_ANSWERS = "schema_version bigint, graph_sha256 string, queries_sha256 string, answers array<struct<query_id:bigint,status:string,distance_m:double,`group`:string>>"


def read_routes(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(line_id, RouteId, RouteVarId, lat, lng) of a file of route lines; blank lines are skipped.

    strict: a bad line is an error that names its number; else bad lines are left out.
    """
    lines = numbered_lines(spark, path).select((F.col("line") + 1).alias("line_id"), F.lit(None).cast("string").alias("feed"), F.col("value").alias("body"))
    read = parsed_lines(lines)
    if strict:
        bad = read.where("status = 'bad'").orderBy("line_id").select("line_id", "reason").first()
        if bad:
            raise FormatError(f"line {bad.line_id}: {bad.reason}")
    return read.where("status = 'good'").select("line_id", "RouteId", "RouteVarId", "lat", "lng")


def _strict_numbers(raw: DataFrame, fields: str, array: str, ints: tuple[str, ...], reals: tuple[str, ...]) -> None:
    """Elements whose numbers are missing, of another kind, or not finite are an error."""
    e = raw.select(F.explode(F.col(array)).alias("e"))
    bad = [F.col(f"e.{c}").isNull() | ~F.col(f"e.{c}").rlike(r"^-?(0|[1-9][0-9]*)$") for c in ints]
    bad += [F.col(f"e.{c}").isNull() | ~F.col(f"e.{c}").rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$") for c in reals]
    any_bad = bad[0]
    for b in bad[1:]:
        any_bad = any_bad | b
    if not e.where(any_bad).isEmpty():
        raise FormatError(f"{array}: {fields} must be numbers")


#: pieces of a document that may be no plain elements (head, ends of arrays, further members)
_REST = 1000
_PLAIN = r'^[ \t\r\n]*,[ \t\r\n]*\{[^"{}\[\]]*+("[^"\\{}\[\]]*+"[^"{}\[\]]*+)*+$'
_NODE, _EDGE = "id bigint, lat double, lon double", "source bigint, target bigint, distance_m double"


def _once(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("repeated member")
    return dict(pairs)


def _elements(text: Column) -> list[Column]:
    """The text of an element read as a node and as an edge, each with whether it is JSON of that kind."""
    out = []
    for name, kind in (("node", _NODE), ("edge", _EDGE)):
        out.append(F.from_json(text, kind + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "false"}).alias(name))
    return out


def _graph_in_pieces(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame] | None:
    """Head, nodes and edges of a document that is cut behind every closing brace and read by many tasks.

    A piece is an element if it is a comma and an object without objects, lists and escapes. Those
    are replaced by marks in the rest of the document, which is small; where a mark is found says whose
    elements they are. None: the rest is not small or not JSON, so the document must be read as a whole.
    """
    file = one_file(spark, path)
    at, fs = hadoop_path(spark, file)
    size = fs.getFileStatus(at).getLen()
    if not size or spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(at) is not None:
        return None
    src = fs.open(at)
    try:
        src.seek(size - 1)
        closed = src.read() == ord("}")
    finally:
        src.close()
    # written once, so that all that follows sees the same cuts
    pieces = spark.read.text(path, lineSep="}").select(F.monotonically_increasing_id().alias("pos"), "value", F.col("value").rlike(_PLAIN).alias("plain"))
    element = F.when(F.col("plain"), F.concat(F.regexp_replace("value", r"^[ \t\r\n]*,", ""), F.lit("}")))
    read = written(pieces.select("pos", *_elements(element), F.when(~F.col("plain"), F.col("value")).alias("rest")), "pieces")
    rest = read.where("rest is not null").select("pos", "rest").orderBy("pos").limit(_REST + 1).collect()
    last = read.agg(F.max("pos")).first()[0]
    if not rest or len(rest) > _REST:
        discard(read)
        return None
    ends = [r.pos for r in rest[1:]] + [last + 1]
    mark = f"mark-{uuid.uuid4().hex}"
    texts = []
    for i, (r, end) in enumerate(zip(rest, ends, strict=True)):
        texts.append(r.rest + ("}" if r.pos < last or closed else ""))
        texts.append(f',{{"{mark}":{i}}}' if end > r.pos + 1 else "")
    try:
        doc = json.loads("".join(texts), object_pairs_hook=_once)
    except ValueError:
        doc = None
    # a last piece that is plain but not closed by a brace is no element
    if not isinstance(doc, dict) or (rest[-1].pos < last and not closed):
        discard(read)
        return None

    def rows(name: str, kind: str, member: str) -> DataFrame:
        own = doc.get(member)
        if not isinstance(own, list) or not all(isinstance(x, dict) for x in own):
            raise FormatError(f"{member} must be a list of objects")
        runs = [x[mark] for x in own if mark in x]
        within = F.lit(False)
        for i in runs:
            within = within | ((F.col("pos") > rest[i].pos) & (F.col("pos") < ends[i]))
        own_rows = read.select(name, within.alias("own")).where("own")
        others = spark.createDataFrame([(json.dumps(x),) for x in own if mark not in x], "text string").select(*_elements(F.col("text"))).select(name, F.lit(True).alias("own"))
        fields = [f.split()[0] for f in kind.split(", ")]
        # also says own, for filters that are moved below
        bad = F.when(F.col("own"), F.raise_error(F.lit(f"{member}: {', '.join(fields)} must be numbers")))
        valid = F.col(f"{name}._bad").isNull()
        return own_rows.unionByName(others).select(*[F.coalesce(F.when(valid, F.col(f"{name}.{c}")), bad.cast(t)).alias(c) for c, t in (f.split() for f in kind.split(", "))])

    return doc, rows("node", _NODE, "nodes"), rows("edge", _EDGE, "edges")


def _graph_as_a_whole(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """Head, nodes and edges of a document of unusual form, which one task holds."""
    opts = {"multiLine": True, "allowNonNumericNumbers": False, "mode": "FAILFAST"}
    texts = spark.read.options(**opts, primitivesAsString=True).json(path)
    want = {"nodes", "edges", "schema_version"}
    if not want <= set(texts.columns):
        raise FormatError(f"missing {sorted(want - set(texts.columns))}")
    kinds = dict(texts.dtypes)
    if "struct" in kinds["nodes"]:
        _strict_numbers(texts, "id, lat, lon", "nodes", ("id",), ("lat", "lon"))
    if "struct" in kinds["edges"]:
        _strict_numbers(texts, "source, target, distance_m", "edges", ("source", "target"), ("distance_m",))
    doc = spark.read.schema(_GRAPH).options(**opts).json(path)
    h = doc.select("schema_version", "directed", "coordinate_crs", "distance_crs", "weight_unit").limit(2).collect()
    if len(h) != 1:
        raise FormatError(f"{path} is not one document")
    return h[0].asDict(), doc.select(F.inline("nodes")), doc.select(F.inline("edges"))


def read_graph_json(spark: SparkSession, path: str) -> Graph:
    """Graph from its canonical JSON document, fully checked; x_m, y_m are projected."""
    head, nodes, edges = _graph_in_pieces(spark, path) or _graph_as_a_whole(spark, path)
    fixed = {"schema_version": 1, "directed": True, "coordinate_crs": COORDINATE_CRS, "distance_crs": DISTANCE_CRS, "weight_unit": WEIGHT_UNIT}
    if any(type(head.get(k)) is not type(v) or head[k] != v for k, v in fixed.items()):
        raise FormatError("unsupported version, reference system, unit or direction")
    nodes = with_projection(nodes.select("id", "lat", "lon"))
    edges = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("distance_m").alias("w"))
    require_valid(nodes, edges)
    return Graph(nodes, edges, sha256(spark, path))


def write_graph_json(graph: Graph, path: str) -> None:
    """The canonical document as one JSON object, an element a line; the folder must not exist."""
    head = json.dumps({"schema_version": 1, "directed": True, "coordinate_crs": COORDINATE_CRS, "distance_crs": DISTANCE_CRS, "weight_unit": WEIGHT_UNIT}, separators=(",", ":"))
    # every element begins with a comma; the first one's is left out
    line = lambda *c: F.concat(F.lit(","), F.to_json(F.struct(*c))).alias("value")
    nodes = graph.nodes.select("id", "lat", "lon", line("id", "lat", "lon"))
    edges = graph.edges.select("src", "dst", "w", line(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("w").alias("distance_m")))
    write_whole(graph.nodes.sparkSession, [head[:-1] + ',"nodes":[\n', (nodes, ["id", "lat", "lon"], 1), '],"edges":[\n', (edges, ["src", "dst", "w"], 1), "]}\n"], path, ".json")


def read_answers(spark: SparkSession, path: str, sha: str | None = None) -> DataFrame:
    """(query_id, status, distance, group) of an answers document."""
    doc = spark.read.schema(_ANSWERS).options(multiLine=True, allowNonNumericNumbers=False, mode="FAILFAST").json(path)
    h = doc.select("schema_version", "graph_sha256").collect()
    if len(h) != 1 or h[0][0] != 1 or (sha is not None and h[0][1] != sha):
        raise FormatError("unknown version or answers of another graph")
    a = doc.select(F.inline("answers")).select("query_id", "status", F.col("distance_m").alias("distance"), "group")
    found = F.col("status") == "found"
    bad = F.col("query_id").isNull() | ~F.coalesce(F.col("status").isin("found", "unreachable", "invalid_vertex"), F.lit(False)) | (found != F.col("distance").isNotNull()) | F.coalesce(F.col("distance") < 0, F.lit(False))
    if not a.where(bad).isEmpty() or not a.groupBy("query_id").count().where("count > 1").isEmpty():
        raise FormatError("invalid or repeated answer")
    return a
