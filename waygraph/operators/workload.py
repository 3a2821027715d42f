"""Query workloads: reachable pairs in a seeded order, by distance strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import written
from .build import number_rows
from .relax import single_source

# fixed values: targets a source, pairs in the pool, queries of each stratum
PER_SOURCE, POOL, STRATA = 10, 3000, (("short", 334), ("medium", 333), ("long", 333))


def order_hash(seed: str, *cols: str) -> Column:
    """A seeded order that other engines can compute too."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in cols]))


def sources(nodes: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(source): node ids without the excluded ones."""
    s = nodes.select(F.col("id").alias("source")).where("source is not null").distinct()
    return s.join(excluded.select(F.col("source")).distinct(), "source", "left_anti") if excluded is not None else s


def sampled_targets(distances: DataFrame, seed: str = "162163", per_source: int = PER_SOURCE) -> DataFrame:
    """(source, node, g): at most per_source reachable other nodes of each source, in seeded order."""
    w = Window.partitionBy("source").orderBy(order_hash(seed, "source", "node"), "node")
    return distances.where("node <> source").select("source", "node", "g", F.row_number().over(w).alias("k")).where(F.col("k") <= per_source).drop("k")


def pool(targets: DataFrame, seed: str = "162163", size: int = POOL) -> DataFrame:
    """The first `size` pairs with the sources in seeded order; the pool's size is its definition."""
    return targets.orderBy(order_hash(seed, "source"), "source", order_hash(seed, "source", "node"), "node").limit(size)


def reachable_pool(edges: DataFrame, nodes: DataFrame, seed: str = "162163", size: int = POOL, block: int = 1024, least: int = 0) -> DataFrame:
    """The same pool without the distances of all pairs: sources are searched in seeded order, block by block.

    A block's pairs come before those of later blocks, so the search ends when there are `size` pairs;
    each further block is twice as large. Fewer than `least` pairs in all are an error.
    """
    order = nodes.select(F.col("id").alias("source")).where("source is not null").distinct().withColumn("_h", order_hash(seed, "source"))
    order = written(number_rows(order, ["_h", "source"], "_no"), "sources")
    many = order.count()
    pairs, found, first = None, 0, 0
    while found < size and first < many:
        some = order.where((F.col("_no") >= first) & (F.col("_no") < first + block)).select("source")
        more = written(sampled_targets(single_source(edges, some, paths=False), seed), "pairs")
        found += more.count()
        pairs = more if pairs is None else pairs.unionByName(more)
        first, block = first + block, block * 2
    if found < least:
        raise ValueError(f"{found} reachable pairs, {least} are wanted")
    return written(pool(pairs, seed, size), "pool") if pairs is not None else order.select("source", F.col("source").alias("node"), F.lit(0).alias("g")).limit(0)


def strata(pairs: DataFrame, names: tuple[str, ...] = tuple(n for n, _ in STRATA)) -> DataFrame:
    """pairs with `stratum`: equal parts in the order (g, source, node); the first parts take the rest.

    Like ntile, but over sorted partitions instead of in one task.
    """
    n = pairs.count()
    k = len(names)
    base, rest = divmod(n, k)
    edge, out = 0, None
    for i, name in enumerate(names):
        edge += base + (i < rest)
        c = F.col("_no") < edge
        out = F.when(c, name) if out is None else out.when(c, name)
    numbered = number_rows(pairs, ["g", "source", "node"], "_no")
    return numbered.withColumn("stratum", out).drop("_no")


def stratified(parts: DataFrame, seed: str = "162163", wanted: tuple[tuple[str, int], ...] = STRATA) -> DataFrame:
    """`wanted` pairs of each stratum in seeded order, numbered as queries in another seeded order."""
    size = F.create_map(*[x for n, k in wanted for x in (F.lit(n), F.lit(k))])[F.col("stratum")]
    w = Window.partitionBy("stratum").orderBy(order_hash(seed + "s", "source", "node"), "source", "node")
    some = parts.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= size).drop("_k")
    shuffled = some.withColumn("_h", order_hash(seed + "q", "source", "node"))
    return number_rows(shuffled, ["_h", "source", "node"], "query_id").select("query_id", "source", F.col("node").alias("target"), "g", "stratum")


def stratum_ranges(parts: DataFrame) -> DataFrame:
    return parts.groupBy("stratum").agg(F.count("*").alias("n"), F.min("g").alias("min_g"), F.max("g").alias("max_g"))
