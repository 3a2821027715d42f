"""Versioned text files: graph, queries, results. A header of fields, then counted rows.

The first line is a name with the kind and version 1, as in `<NAME>_GRAPH 1`; any name is read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.build import require_valid
from ..runtime import write_whole, written
from ..schema import COORDINATE_CRS, DISTANCE_CRS, WEIGHT_UNIT, Graph

NAME = "WAYGRAPH"
_HASH = re.compile(r"[0-9a-f]{64}")
_WHOLE = r"^-?(0|[1-9][0-9]*)$"


class FormatError(ValueError):
    pass


def whole(c: Column) -> Column:
    """A token as bigint; anything but a whole number in range is an error."""
    v = F.expr("null")
    v = F.when(c.rlike(_WHOLE), c.try_cast("bigint"))
    return F.coalesce(v, F.raise_error(F.concat(F.lit("not a whole number: "), F.coalesce(c, F.lit("null")))).cast("bigint"))


def real(c: Column) -> Column:
    """A token as a finite double; anything else is an error."""
    v = F.when(c.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"), c.try_cast("double"))
    v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return F.coalesce(v, F.raise_error(F.concat(F.lit("not a finite number: "), F.coalesce(c, F.lit("null")))).cast("double"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines numbered from 0; one file, read as blocks."""
    lines = spark.read.text(path)
    rows = lines.select("value", F.monotonically_increasing_id().alias("_id"))
    part = F.shiftright("_id", 33)
    base = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    from pyspark.sql import Window

    off = base.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_off"))  # one row a block
    return rows.withColumn("_p", part).join(F.broadcast(off), "_p").select((F.col("_off") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("line"), "value")


def _header(lines: DataFrame, fields: list[str]) -> dict[str, str]:
    """Values of the first lines, which must have these fields; the first field is a kind with version 1."""
    got = lines.where(F.col("line") < len(fields)).orderBy("line").collect()
    out = {}
    for i, want in enumerate(fields):
        parts = got[i].value.split() if i < len(got) else []
        if len(parts) != 2 or not (parts[0].endswith("_" + want) if i == 0 else parts[0] == want):
            raise FormatError(f"line {i + 1}: expected {want}")
        out[want if i else "version"] = parts[1]
    if out["version"] != "1":
        raise FormatError("unknown version")
    if "GRAPH_SHA256" in out and not _HASH.fullmatch(out["GRAPH_SHA256"]):
        raise FormatError("invalid hash")
    return out


def _count(text: str) -> int:
    if not re.fullmatch(r"0|[1-9][0-9]{0,18}", text):
        raise FormatError(f"invalid count {text!r}")
    return int(text)


def _rows(lines: DataFrame, first: int, n: int, width: int | None) -> DataFrame:
    """(line, t): tokens of n lines from `first`; another number of tokens is an error."""
    t = F.split(F.trim("value"), r"[ \t]+")
    if width is not None:
        t = F.when(F.size(t) == width, t).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields in line "), (F.col("line") + 1).cast("string"))).cast("array<string>"))
    return lines.where((F.col("line") >= first) & (F.col("line") < first + n)).select("line", t.alias("t"))


def _complete(lines: DataFrame, last: int) -> None:
    """Exactly `last` lines, but for blank ones at the end."""
    n = lines.where("trim(value) <> ''").agg(F.max("line")).first()[0]
    if n is None or n + 1 != last:
        raise FormatError(f"{last} lines were announced, the file has {0 if n is None else n + 1}")


def read_graph_text(spark: SparkSession, path: str) -> Graph:
    """Graph from its text file; counts, ids, order, coordinates and edges are checked."""
    lines = numbered_lines(spark, path)
    fixed = ["GRAPH", "GRAPH_SHA256", "COORDINATE_CRS", "DISTANCE_CRS", "WEIGHT_UNIT", "DIRECTED", "NODES"]
    h = _header(lines, fixed)
    if (h["COORDINATE_CRS"], h["DISTANCE_CRS"], h["WEIGHT_UNIT"], h["DIRECTED"]) != (COORDINATE_CRS, DISTANCE_CRS, WEIGHT_UNIT, "1"):
        raise FormatError("unsupported reference system, unit or direction")
    n = _count(h["NODES"])
    if not n:
        raise FormatError("no nodes")
    at = len(fixed) + n
    head = lines.where(F.col("line") == at).collect()
    parts = head[0].value.split() if head else []
    if len(parts) != 2 or parts[0] != "EDGES":
        raise FormatError(f"line {at + 1}: expected EDGES")
    m = _count(parts[1])
    _complete(lines, at + 1 + m)
    t = F.col("t")
    # written once: later filters must not reach lines that are no rows
    numbers = [real(t[i]).alias(c) for i, c in enumerate(("lat", "lon", "x_m", "y_m"), 1)]
    rows = written(_rows(lines, len(fixed), n, 5).select("line", whole(t[0]).alias("id"), *numbers), "nodes")
    nodes = rows.drop("line")
    edges = written(_rows(lines, at + 1, m, 3).select("line", whole(t[0]).alias("src"), whole(t[1]).alias("dst"), real(t[2]).alias("w")), "edges")
    require_valid(nodes, edges.drop("line"))
    nxt = edges.select((F.col("line") - 1).alias("line"), F.col("src").alias("s2"), F.col("dst").alias("d2"))
    if not edges.join(nxt, "line").where("s2 < src or (s2 = src and d2 <= dst)").isEmpty():
        raise FormatError("edges are not in order")
    if not rows.where(F.col("id") != F.col("line") - len(fixed)).isEmpty():
        raise FormatError("nodes are not in order")
    return Graph(nodes, edges.drop("line"), h["GRAPH_SHA256"])


def read_queries_text(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """(input_pos, query_id, source, target); ids are unique and in any order, ends may be negative."""
    lines = numbered_lines(spark, path)
    h = _header(lines, ["QUERIES", "GRAPH_SHA256", "QUERIES"])
    if sha256 is not None and h["GRAPH_SHA256"] != sha256:
        raise FormatError("queries of another graph")
    n = _count(h["QUERIES"])
    _complete(lines, 3 + n)
    t = F.col("t")
    out = written(_rows(lines, 3, n, 3).select((F.col("line") - 3).alias("input_pos"), whole(t[0]).alias("query_id"), whole(t[1]).alias("source"), whole(t[2]).alias("target")), "queries")
    if not out.where("query_id < 0").isEmpty() or not out.groupBy("query_id").count().where("count > 1").isEmpty():
        raise FormatError("negative or repeated query id")
    return out


def read_results_text(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """(query_id, status, distance, path): `id status distance|- n v1 .. vn` rows."""
    lines = numbered_lines(spark, path)
    h = _header(lines, ["RESULTS", "GRAPH_SHA256", "RESULTS"])
    if sha256 is not None and h["GRAPH_SHA256"] != sha256:
        raise FormatError("results of another graph")
    n = _count(h["RESULTS"])
    _complete(lines, 3 + n)
    t = F.col("t")
    bad = lambda what, kind: F.raise_error(F.concat(F.lit(what + " in line "), (F.col("line") + 1).cast("string"))).cast(kind)
    known = t[1].isin("found", "unreachable", "invalid_vertex", "not_implemented")
    status = F.when(known, t[1]).otherwise(bad("unknown status", "string"))
    fits = (F.size(t) >= 4) & (F.size(t) == 4 + F.get(t, 3).try_cast("bigint")) & ((t[1] == "found") == (t[2] != "-")) & ((t[1] == "found") == (F.size(t) > 4))
    path_ = F.when(F.coalesce(fits, F.lit(False)), F.transform(F.slice(t, 5, F.greatest(F.size(t) - 4, F.lit(0))), lambda v: v.try_cast("bigint"))).otherwise(bad("wrong fields", "array<bigint>"))
    rows = _rows(lines, 3, n, None).select(whole(t[0]).alias("query_id"), status.alias("status"), F.when(F.get(t, 2) != "-", real(F.get(t, 2))).alias("distance"), path_.alias("path"))
    return written(rows, "results")


def digits17(x: float) -> str:
    """Seventeen significant digits, trailing zeros dropped: reads back to the same double."""
    return f"{x:.17g}"


@F.pandas_udf(T.StringType())
def _digits(x):
    return x.map(digits17)


def _text_file(df: DataFrame, header: list[str], order: str, path: str) -> None:
    """A header and ordered lines as one text file part; the folder must not exist."""
    spark = df.sparkSession
    head = spark.createDataFrame([(i - len(header), x) for i, x in enumerate(header)], "pos long, value string")
    body = df.select(F.col(order).cast("long").alias("pos"), "value")
    head.unionByName(body).repartitionByRange(1, "pos").sortWithinPartitions("pos").select("value").write.mode("errorifexists").text(path)


def write_graph_text(graph: Graph, path: str, name: str = NAME) -> None:
    """The graph as a text file with 17 significant digits; parquet is the native form."""
    if not graph.sha256 or not _HASH.fullmatch(graph.sha256):
        raise FormatError("the graph has no hash")
    n, m = graph.nodes.count(), graph.edges.count()
    header = [f"{name}_GRAPH 1", f"GRAPH_SHA256 {graph.sha256}", f"COORDINATE_CRS {COORDINATE_CRS}", f"DISTANCE_CRS {DISTANCE_CRS}", f"WEIGHT_UNIT {WEIGHT_UNIT}", "DIRECTED 1", f"NODES {n}"]
    d = lambda c: _digits(F.col(c).cast("double"))
    nodes = graph.nodes.select("id", F.concat_ws(" ", F.col("id").cast("string"), *[d(c) for c in ("lat", "lon", "x_m", "y_m")]).alias("value"))
    edges = graph.edges.select("src", "dst", F.concat_ws(" ", "src", "dst", d("w")).alias("value"))
    write_whole(graph.nodes.sparkSession, ["\n".join([*header, ""]), (nodes, ["id"], 0), f"EDGES {m}\n", (edges, ["src", "dst"], 0)], path, ".txt")


def write_queries_text(queries: DataFrame, sha256: str, path: str, name: str = NAME) -> None:
    header = [f"{name}_QUERIES 1", f"GRAPH_SHA256 {sha256}", f"QUERIES {queries.count()}"]
    pos = "input_pos" if "input_pos" in queries.columns else "query_id"
    _text_file(queries.select(F.col(pos).alias("pos"), F.concat_ws(" ", "query_id", "source", "target").alias("value")), header, "pos", path)


def write_results_text(results: DataFrame, sha256: str, path: str, name: str = NAME) -> None:
    """Results in input order (input_pos, else query_id)."""
    header = [f"{name}_RESULTS 1", f"GRAPH_SHA256 {sha256}", f"RESULTS {results.count()}"]
    pos = "input_pos" if "input_pos" in results.columns else "query_id"
    dist = F.when(F.col("distance").isNull(), "-").otherwise(_digits(F.coalesce(F.col("distance").cast("double"), F.lit(0.0))))
    value = F.concat_ws(" ", F.col("query_id").cast("string"), "status", dist, F.size("path").cast("string"), F.array_join(F.transform("path", lambda v: v.cast("string")), " "))
    _text_file(results.select(F.col(pos).alias("pos"), F.rtrim(value).alias("value")), header, "pos", path)
