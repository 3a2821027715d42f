"""Mixing sources to target shares of tokens.

Texts are classes of exact copies; a class's membership pattern is the set of listed sources that
hold it. Tokens are added up by pattern (at most 2^sources of them), and a minimum-cost flow routes each
pattern's tokens, use by use, to its sources: the r-th use of a text costs r - 1, so costs are
convex and repeats come last. Texts are then taken in a seeded order: every text has a position in
its pattern's running total of tokens, and each flow is a stretch of positions.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import written

TOKENIZER = "byte_bpe_50k.tiktoken"
SEED = 20240229
#: buckets of the seeded order in which running totals are kept, as bits
BITS = 12


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    repeats: int


_ENCODERS: dict[str, object] = {}


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str):
    """The public tokenizer in a file of ranks; loaded once a worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(df: DataFrame, columns: list[str], path: str) -> DataFrame:
    """columns and tokens (bigint): number of tokens of `text`; null and empty texts have 0."""
    schema = df.select(*columns).schema.add("tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(n, pa.int64())], names=[*columns, "tokens"])

    return df.select(*columns, "text").mapInArrow(run, schema)


def text_classes(documents: DataFrame, targets: list[Target], path: str) -> DataFrame:
    """(h1, h2, tokens, pattern, members): one row a text that a listed source holds.

    members has, of each source (its number in targets), the least doc_id with the text; pattern has
    a bit a source.
    """
    number = F.array_position(F.array(*[F.lit(t.source) for t in targets]), F.col("source")) - 1
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("source").isin([t.source for t in targets]) & (F.length("text") > 0))
    docs = docs.select("doc_id", number.cast("int").alias("s"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text", F.lit(2)).alias("h2"), "text")
    counted = token_counts(docs, ["doc_id", "s", "h1", "h2"], path)
    single = counted.groupBy("h1", "h2", "s").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    return single.groupBy("h1", "h2").agg(
        F.max("tokens").alias("tokens"),
        F.bit_or(F.expr("shiftleft(1L, s)")).alias("pattern"),
        F.map_from_entries(F.collect_list(F.struct("s", "doc_id"))).alias("members"),  # one a source
    )


class _Network:
    """Minimum-cost flow by successive shortest paths with potentials, whole capacities."""

    def __init__(self) -> None:
        self.out: dict[object, list[int]] = defaultdict(list)
        self.to: list[object] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: object, b: object, cap: int, cost: int = 0) -> int:
        for u, v, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, source: object, sink: object) -> tuple[int, dict[object, int]]:
        """Flow and, after the last search, the reached nodes (the source's side of a least cut)."""
        potential: dict[object, int] = defaultdict(int)
        flow = 0
        while True:
            dist, back, order, heap = {source: 0}, {}, 0, [(0, 0, source)]
            while heap:
                d, _, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for e in self.out[u]:
                    v = self.to[e]
                    x = d + self.cost[e] + potential[u] - potential[v]
                    if self.cap[e] > 0 and x < dist.get(v, 1 << 62):
                        dist[v], back[v] = x, e
                        order += 1
                        heapq.heappush(heap, (x, order, v))
            if sink not in dist:
                return flow, dist
            # nodes not reached stay unreachable: no augmenting path comes near them
            for v, d in dist.items():
                potential[v] += d
            path, v = [], sink
            while v != source:
                path.append(back[v])
                v = self.to[back[v] ^ 1]
            least = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= least
                self.cap[e ^ 1] += least
            flow += least


def plan(patterns: dict[int, int], targets: list[Target]) -> tuple[int, dict[tuple[int, int, int], int]]:
    """(total, flow): tokens of the mixture and those of each (pattern, use, source).

    The total is the greatest at which every source with tokens reaches its share of it; shares of
    sources without tokens are left out. A source s takes uses 1 .. max_repeats(s) of a text.
    """
    live = [s for s, t in enumerate(targets) if t.share > 0 and t.repeats > 0 and any(p >> s & 1 and n for p, n in patterns.items())]
    if not live:
        return 0, {}
    whole = sum(targets[s].share for s in live)
    share = {s: targets[s].share / whole for s in live}

    def most(group: set[int]) -> int:
        """Tokens that the group's sources can be given together."""
        return sum(n * max([targets[s].repeats for s in group if p >> s & 1], default=0) for p, n in patterns.items())

    total = min(int(most({s}) / share[s]) for s in live)
    while True:
        net, edges = _Network(), {}
        for p, n in patterns.items():
            mine = [s for s in live if p >> s & 1]
            for r in range(1, max([targets[s].repeats for s in mine], default=0) + 1):
                net.edge("from", (p, r), n, r - 1)
                for s in mine:
                    if r <= targets[s].repeats:
                        edges[p, r, s] = net.edge((p, r), s, n)
        quota = {s: int(share[s] * total) for s in live}
        for s in live:
            net.edge(s, "to", quota[s])
        flow, reached = net.run("from", "to")
        if flow >= sum(quota.values()) or total <= 1:
            return flow, {k: net.cap[e ^ 1] for k, e in edges.items() if net.cap[e ^ 1]}
        # the sources that cannot be filled: those beyond the least cut
        short = {s for s in live if s not in reached}
        total = min(total - 1, int(most(short) / sum(share[s] for s in short)))


def mixture(documents: DataFrame, targets: DataFrame, path: str | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, uses): how often each used document is taken, for which source.

    targets: source, target_share, max_repeats; a small list (one bit a source, 60 at most). Copies of
    a text within a source are one text, used through its least doc_id; a text in several sources can
    serve any of them. No document is used more than its source's max_repeats. A source meets its quota
    up to one text a stretch. Null and empty texts, sources that are not listed and null doc_ids take no
    part; null or repeated rows of targets are dropped, and so is a source with a share or repeats of 0.
    Repeated documents count once.
    """
    rows = targets.where("source is not null and target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats")
    rows = rows.groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).orderBy("source").limit(61).collect()
    if len(rows) > 60:
        raise ValueError("more than 60 sources")
    wanted = [Target(*r) for r in rows]
    out = "doc_id long, source string, tokens long, uses int"
    spark = documents.sparkSession
    if not wanted:
        return spark.createDataFrame([], out)
    classes = written(text_classes(documents, wanted, path or tokenizer_file()), "classes")
    patterns = {r.pattern: r.tokens for r in classes.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).collect()}
    _, flow = plan(patterns, wanted)
    stretch: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    at: dict[tuple[int, int], int] = defaultdict(int)
    for (p, r, s), n in sorted(flow.items()):
        stretch[p].append((at[p, r], at[p, r] + n, s))
        at[p, r] += n
    if not stretch:
        return spark.createDataFrame([], out)
    # at most patterns x sources x repeats stretches
    table = spark.createDataFrame(list(stretch.items()), "pattern long, stretch array<struct<a:long,b:long,s:int>>")
    keyed = classes.withColumn("key", F.xxhash64("h1", "h2", F.lit(seed))).withColumn("bucket", F.shiftrightunsigned("key", 64 - BITS))
    sums = keyed.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("t"))
    before = sums.select("pattern", "bucket", (F.sum("t").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("t")).alias("before"))
    inner = Window.partitionBy("pattern", "bucket").orderBy("key", "h1", "h2").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("inside", F.sum("tokens").over(inner) - F.col("tokens")).join(before, ["pattern", "bucket"])
    placed = placed.withColumn("pos", F.col("before") + F.col("inside")).join(F.broadcast(table), "pattern")
    placed = placed.withColumn("hit", F.filter("stretch", lambda x: (x["a"] <= F.col("pos")) & (F.col("pos") < x["b"])))
    used = placed.where(F.size("hit") > 0).select("tokens", "members", "hit", F.explode(F.array_distinct(F.transform("hit", lambda x: x["s"]))).alias("s"))
    names = F.array(*[F.lit(t.source) for t in wanted])
    return used.select(
        F.col("members")[F.col("s")].alias("doc_id"), names[F.col("s")].alias("source"), "tokens", F.size(F.filter("hit", lambda x: x["s"] == F.col("s"))).alias("uses")
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, uses, most_uses, tokens, share): what each source reaches."""
    made = mixed.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens")
    )
    want = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    every = want.join(made, "source", "left").fillna(0, ["documents", "uses", "most_uses", "tokens"])
    return every.withColumn("share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy()), F.lit(0)), F.lit(0.0)))
