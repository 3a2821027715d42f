"""Command line: build, export, queries, route, check and bench on files.

    python -m waygraph.cli build --routes ROUTES.jsonl --output GRAPH_DIR
    python -m waygraph.cli export --graph GRAPH.json --output TEXT_DIR
    python -m waygraph.cli queries --graph GRAPH.json --output DIR [--seed N]
    python -m waygraph.cli route --graph GRAPH.txt --queries QUERIES.txt --output DIR --algorithm NAME
    python -m waygraph.cli check --graph GRAPH.txt --queries QUERIES.txt --answers ANSWERS.json --results RESULTS.txt
    python -m waygraph.cli bench --graph GRAPH.txt --queries QUERIES.txt --output DIR --algorithm NAME

Exit status: 0 done, 1 an invalid query or input, 2 not implemented or wrong use.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import functions as F

from .operators import bench_stats, build, kernel, verify, workload
from .operators.hierarchy import CLUSTER_M, WEIGHT, Options, build_index, heuristic_scale
from .operators.route import STRATEGIES, route
from .runtime import local_session, written
from .schema import INVALID
from .sources import files, json_formats, text_formats


class Once(argparse.Action):
    """An option that may be given once."""

    def __call__(self, parser, space, value, option=None):
        seen = getattr(space, "_seen", set())
        if self.dest in seen:
            parser.error(f"{option} is given twice")
        space._seen = seen | {self.dest}
        setattr(space, self.dest, value)


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, allow_abbrev=False)
        for o in options:
            c.add_argument(f"--{o}", required=True, action=Once)
        return c

    command("build", "routes", "output")
    command("export", "graph", "output")
    c = command("queries", "graph", "output")
    c.add_argument("--seed", default="162163", action=Once)
    c.add_argument("--least", type=int, default=workload.POOL, action=Once)
    c = command("check", "graph", "queries", "answers", "results")
    c.add_argument("--mode", choices=sorted(verify.MODES), default="optimal", action=Once)
    c.add_argument("--report", action=Once)
    for name in ("route", "bench"):
        c = command(name, "graph", "queries", "output", "algorithm")
        c.add_argument("--strategy", choices=STRATEGIES, default="kernel", action=Once)
        c.add_argument("--workers", type=positive, default=4, action=Once)
        c.add_argument("--cluster-size", type=float, action=Once)
        c.add_argument("--weight", type=float, action=Once)
        if name == "bench":
            c.add_argument("--repetitions", type=positive, default=5, action=Once)
            c.add_argument("--warmup", type=int, default=1, action=Once)
    return p


def _graph(spark, path: str):
    return json_formats.read_graph_json(spark, path) if path.endswith(".json") else text_formats.read_graph_text(spark, path)


def _options(a) -> Options | None:
    if a.algorithm not in kernel.ALGORITHMS:
        raise ValueError(f"unknown algorithm {a.algorithm!r}")
    if a.algorithm in ("hpa", "bihpa"):
        return Options(CLUSTER_M if a.cluster_size is None else a.cluster_size, WEIGHT if a.weight is None else a.weight)
    if a.cluster_size is not None or a.weight is not None:
        raise ValueError("cluster size and weight are for hpa and bihpa")
    return None


def run(a, spark) -> int:
    if a.command == "build":
        files.protect([a.output], [a.routes])
        routes = json_formats.read_routes(spark, a.routes)
        g = build.build_graph(routes, ["line_id"])
        json_formats.write_graph_json(g, a.output)
        return 0
    graph = _graph(spark, a.graph)
    if a.command == "export":
        files.protect([a.output], [a.graph])
        text_formats.write_graph_text(graph, a.output)
        return 0
    if a.command == "queries":
        files.protect([a.output], [a.graph])
        pairs = workload.reachable_pool(graph.edges, graph.nodes, a.seed, least=a.least)
        parts = written(workload.strata(pairs), "strata")
        q = written(workload.stratified(parts, a.seed), "sample")
        text_formats.write_queries_text(q, graph.sha256, f"{a.output}/queries")
        q.select("query_id", F.lit("found").alias("status"), F.col("g").alias("distance_m"), F.col("stratum").alias("group")).write.json(f"{a.output}/answers")
        return 0
    queries = text_formats.read_queries_text(spark, a.queries, graph.sha256)
    if a.command == "check":
        results = text_formats.read_results_text(spark, a.results, graph.sha256)
        answers = json_formats.read_answers(spark, a.answers, graph.sha256)
        for other in (results, answers):
            if not verify.set_difference(queries, other, "query_id").isEmpty():
                raise ValueError("missing or extra query ids")
        r = verify.report(verify.judged(queries, results, answers, graph.edges, a.mode))
        if a.report:
            files.write_report(r, a.report)
        row = r.first()
        print(row.asDict())
        return int(row.errors > 0)
    files.protect([a.output], [a.graph, a.queries])
    options = _options(a)
    if a.command == "route":
        index = build_index(graph, options) if options else None
        res = route(graph, queries, a.algorithm, a.strategy, options, index)
        if "path" not in res.columns:
            res = res.withColumn("path", F.array().cast("array<bigint>"))
        res = written(res.join(queries.select("query_id", "input_pos"), "query_id"), "results")
        if "error" in res.columns and (bad := res.where("error is not null").first()):
            raise ValueError(f"query {bad.query_id}: {bad.error}")
        text_formats.write_results_text(res, graph.sha256, a.output)
        return int(not res.where(F.col("status") == INVALID).isEmpty())
    index = build_index(graph, options) if options else None
    net = kernel.collect_network(graph.nodes, graph.edges, index)
    if a.algorithm == "astar":
        net.scale = heuristic_scale(graph.edges, graph.nodes).first().scale * (1 - 1e-12)
    timings, walls = None, []
    for i in range(-a.warmup, a.repetitions):
        began = time.perf_counter()
        got = written(kernel.kernel_route(net, queries, a.algorithm, (options or Options()).weight, a.workers), "run")
        if i >= 0:
            walls.append((i + 1, (time.perf_counter() - began) * 1000))
            t = got.select(F.lit(i + 1).alias("repetition"), "query_id", F.col("service_ns").alias("duration_ns"), "status", F.lit(0).cast("bigint").alias("wait_ns"), F.col("service_ns").alias("latency_ns"))
            timings = t if timings is None else timings.unionByName(t)
    files.write_timings_csv(timings, f"{a.output}/timings")
    stats = bench_stats.nearest_rank(timings, [], "duration_ns")
    speed = bench_stats.throughput(spark.createDataFrame(walls, "repetition int, wall_ms double"), queries.count())
    files.write_report(stats.crossJoin(speed), f"{a.output}/summary.json")  # one row each
    return 0


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    try:
        return run(a, spark or local_session())
    except NotImplementedError as e:
        print(e, file=sys.stderr)
        return 2
    except (ValueError, FileExistsError) as e:
        print(e, file=sys.stderr)
        return 1
    except Exception as e:  # errors raised inside a job
        print(str(e).splitlines()[0], file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
