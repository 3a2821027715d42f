"""Shortest paths for many queries at once, by set-based relaxation.

Labels (search, node) -> (g, hops, path) are improved in rounds: the labels of the last round are
joined with the edges, reduced to the least (g, hops, path) of each (search, node), and kept where they
are better. That order makes every answer, path included, independent of partitioning. A round is one
job of a few steps that ends in a written table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, written, written_with
from ..schema import FOUND, INVALID, UNREACHABLE

MAX_ROUNDS = 10_000
#: steps of a round that are taken in one job
HOPS = 3


def relax(edges: DataFrame, seeds: DataFrame, key: list[str], keep: Callable[[DataFrame, int], DataFrame] | None = None, max_hops: int | None = None, joins: Column | None = None, paths: bool = True, hops: int = HOPS) -> DataFrame:
    """(key, node, g, hops, path, extra columns of seeds): best labels reached from the seeds.

    seeds: key columns, node, g and columns that stay with the search. edges: src, dst, w and what
    `joins` uses - a condition between the label columns and the edge columns beside node = src. `keep`
    gives the labels of the last round that are to go on. Weights must not be negative. A round takes
    `hops` steps in one job: the labels of its inner steps go on without being compared with older
    ones, which costs rows on dense graphs and saves jobs on sparse ones; answers are the same.
    """
    extra = [c for c in seeds.columns if c not in (*key, "node", "g")]
    g = dict(edges.dtypes)["w"]
    start = F.array(F.col("node")) if paths else F.array().cast("array<bigint>")
    seed = seeds.select(*key, "node", F.struct(F.col("g").cast(g).alias("g"), F.lit(0).cast("long").alias("hops"), start.alias("path"), F.lit(0).alias("round"), *extra).alias("l"))
    # the last step that made any label tells, in the same job, whether there is a front
    best, last = written_with(seed.groupBy(*key, "node").agg(F.min("l").alias("l")), "labels", F.max("l.round"))
    out = written(edges, "edges").withColumnRenamed("src", "_src")  # read in every step
    on = F.col("node") == F.col("_src")
    on = on if joins is None else on & joins
    path = F.concat("l.path", F.array("dst")) if paths else F.col("l.path")

    def step(front: DataFrame) -> DataFrame:
        # no literal of the round: all rounds share their compiled code
        flat = front.select(*key, "node", "l", *[F.col(f"l.{c}").alias(c) for c in extra])
        label = F.struct((F.col("l.g") + F.col("w")).cast(g).alias("g"), (F.col("l.hops") + 1).alias("hops"), path.alias("path"), (F.col("l.round") + 1).alias("round"), *[F.col(f"l.{c}").alias(c) for c in extra])
        return flat.join(out, on).select(*key, F.col("dst").alias("node"), label.alias("l")).groupBy(*key, "node").agg(F.min("l").alias("l"))

    n = 0
    while last == n and (max_hops is None or n < max_hops):
        if n > MAX_ROUNDS:
            raise RuntimeError(f"no end after {MAX_ROUNDS} steps")
        front = best.where(F.col("l.round") == n) if keep is None else keep(best, n)
        every = best
        for _ in range(hops if max_hops is None else min(hops, max_hops - n)):
            n += 1
            front = step(front)
            every = every.unionByName(front)
        # labels of inner steps have gone on already; those of the last step are the next front
        old = best
        best, last = written_with(every.groupBy(*key, "node").agg(F.min("l").alias("l")), "labels", F.max("l.round"))
        discard(old)
    return best.select(*key, "node", "l.g", "l.hops", "l.path", *[f"l.{c}" for c in extra])


def single_source(edges: DataFrame, sources: DataFrame, max_hops: int | None = None, paths: bool = True) -> DataFrame:
    """(source, node, g, hops, path): every node that each source reaches, at its least distance."""
    seeds = sources.where("source is not null").select("source", F.col("source").alias("node"), F.lit(0).alias("g")).distinct()
    return relax(edges, seeds, ["source"], max_hops=max_hops, paths=paths)


def valid_queries(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """queries with `ok`: both ends are nodes. Null or unknown ends are data, not errors. Repeated rows count once."""
    q = queries.where("query_id is not null").select("query_id", "source", "target").distinct()
    ids = nodes.select("id").where("id is not null").distinct()
    s = ids.select(F.col("id").alias("source"), F.lit(True).alias("_s"))
    t = ids.select(F.col("id").alias("target"), F.lit(True).alias("_t"))
    return q.join(s, "source", "left").join(t, "target", "left").select("query_id", "source", "target", F.coalesce(F.col("_s") & F.col("_t"), F.lit(False)).alias("ok"))


def answered(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, status, distance, hops, path): a row for every query of valid_queries.

    An end that is no node makes the query invalid before anything else, self queries too.
    """
    r = queries.join(found, "query_id", "left")
    hit = F.col("ok") & F.col("g").isNotNull()
    status = F.when(~F.col("ok"), INVALID).when(F.col("g").isNull(), UNREACHABLE).otherwise(FOUND)
    none = F.array().cast("array<bigint>")
    return r.select("query_id", status.alias("status"), F.when(hit, F.col("g")).alias("distance"), F.when(hit, F.col("hops")).alias("hops"), F.when(hit, F.col("path")).otherwise(none).alias("path"))


def _target_label(best: DataFrame, key: list[str]) -> DataFrame:
    return best.where(F.col("node") == F.col("l.target")).select(*key, F.col("l.g").alias("_best"))


def point_to_point(nodes: DataFrame, edges: DataFrame, queries: DataFrame, heuristic: float | None = None, weight: float = 1.0, rule: Column | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """(query_id, status, distance, hops, path): one answer a query.

    heuristic: scale of the straight-line distance x_m, y_m (in units of w) that never overestimates;
    None for none. Labels are dropped when weight * (g + h) exceeds the target's label: weight 1 keeps
    answers exact, more bounds them by weight times the optimum. rule: a condition between the query's
    columns (columns: name -> node attribute at source or target) and the edges'.
    """
    q = written(valid_queries(queries, nodes), "queries")
    seeds = q.where("ok").select("query_id", F.col("source").alias("node"), F.lit(0).alias("g"), "target", "source")
    if columns:
        for name, (end, attribute) in columns.items():
            a = nodes.select(F.col("id").alias(end), F.col(attribute).alias(name))
            seeds = seeds.join(a, end)
    if heuristic:
        xy = nodes.groupBy("id").agg(F.max("x_m").alias("_x"), F.max("y_m").alias("_y"))
        seeds = seeds.join(xy.select(F.col("id").alias("target"), F.col("_x").alias("tx"), F.col("_y").alias("ty")), "target")
        edges = edges.join(xy.select(F.col("id").alias("dst"), F.col("_x").alias("dx"), F.col("_y").alias("dy")), "dst")
    seeds = seeds.drop("source")
    key = ["query_id"]

    def keep(best: DataFrame, n: int) -> DataFrame:
        front = best.where(F.col("l.round") == n)
        if heuristic:
            xy = nodes.groupBy("id").agg(F.max("x_m").alias("_x"), F.max("y_m").alias("_y")).withColumnRenamed("id", "node")
            front = front.join(xy, "node")
            dx, dy = F.col("_x") - F.col("l.tx"), F.col("_y") - F.col("l.ty")
            # a null position says nothing: no estimate
            h = F.coalesce(heuristic * F.sqrt(dx * dx + dy * dy), F.lit(0.0))
        else:
            h = F.lit(0.0)
        front = front.join(_target_label(best, key), key, "left")
        f = weight * (F.col("l.g") + h)
        on = (F.col("node") != F.col("l.target")) & (F.col("_best").isNull() | (f <= F.col("_best") if weight == 1 else f < F.col("_best")))
        return front.where(on).select("query_id", "node", "l")

    drop = [c for c in ("dx", "dy") if c in edges.columns]
    labels = relax(edges.drop(*drop), seeds, key, keep=keep, joins=rule)
    return answered(q, labels.where("node = target").select("query_id", "g", "hops", "path"))


def bidirectional(nodes: DataFrame, edges: DataFrame, queries: DataFrame, weight: float = 1.0, rule: Column | None = None, columns: dict[str, str] | None = None, paths: bool = False) -> DataFrame:
    """(query_id, status, distance, hops, path): from both ends at once, within weight times the optimum (1: exact).

    A query rests when weight times the least labels of its two fronts together is no less than the
    best meeting: any shorter path would have to pass both fronts. It never rests at the first meeting
    alone. rule and columns as in point_to_point; path is empty unless paths.
    """
    q = written(valid_queries(queries, nodes), "queries")
    ends = q.where("ok").select("query_id", "source", "target")
    extra = list(columns or ())
    for name, (end, attribute) in (columns or {}).items():
        ends = ends.join(nodes.select(F.col("id").alias(end), F.col(attribute).alias(name)), end)
    side = lambda way, c: ends.select("query_id", F.lit(way).alias("way"), F.col(c).alias("node"), F.lit(0).alias("g"), *extra)
    rest = [c for c in edges.columns if c not in ("src", "dst", "w")]
    both = edges.select("src", "dst", "w", *rest, F.lit(0).alias("_way")).unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", *rest, F.lit(1).alias("_way"))
    )

    def meetings(best: DataFrame) -> DataFrame:
        g = F.col("l.g")
        met = best.groupBy("query_id", "node").agg(F.min(F.when(F.col("way") == 0, g)).alias("a"), F.min(F.when(F.col("way") == 1, g)).alias("b"))
        return met.groupBy("query_id").agg(F.min(F.col("a") + F.col("b")).alias("mu"))

    def keep(best: DataFrame, n: int) -> DataFrame:
        front = best.where(F.col("l.round") == n)
        low = front.groupBy("query_id").agg(
            F.min(F.when(F.col("way") == 0, F.col("l.g"))).alias("f"), F.min(F.when(F.col("way") == 1, F.col("l.g"))).alias("b")
        )
        state = low.join(meetings(best), "query_id", "left")
        # a front that is empty has nothing left to find
        live = state.where(F.col("f").isNotNull() & F.col("b").isNotNull() & (F.col("mu").isNull() | (weight * (F.col("f") + F.col("b")) < F.col("mu")))).select("query_id")
        return front.join(live, "query_id", "left_semi")

    on = F.col("way") == F.col("_way")
    labels = relax(both, side(0, "source").unionByName(side(1, "target")), ["query_id", "way"], keep=keep, joins=on if rule is None else on & rule, paths=paths)
    # at most two labels a node: the best from either end
    one = lambda way: F.max(F.when(F.col("way") == way, F.struct("g", "hops", "path")))
    met = labels.groupBy("query_id", "node").agg(one(0).alias("a"), one(1).alias("b")).where("a is not null and b is not null")
    path = F.concat("a.path", F.slice(F.reverse("b.path"), 2, F.greatest(F.size("b.path") - 1, F.lit(0)))) if paths else F.col("a.path")
    least = met.groupBy("query_id").agg(F.min(F.struct((F.col("a.g") + F.col("b.g")).alias("g"), (F.col("a.hops") + F.col("b.hops")).alias("hops"), path.alias("path"))).alias("x"))
    return answered(q, least.select("query_id", "x.g", "x.hops", "x.path"))


def all_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, node, g): least distances of all reachable pairs."""
    return single_source(edges, nodes.select(F.col("id").alias("source")), paths=False).select("source", "node", "g")
