import pytest

from tests.graphs import SIX, frames
from waygraph.operators import bench_stats as b
from waygraph.operators import verify, workload
from waygraph.streaming.route_stream import kernel_answers, ordered, query_stream, route_stream

Q, R, A = "query_id long, source long, target long", "query_id long, status string, distance double, path array<long>", "query_id long, status string, distance double"


def judge(spark, results, answers, queries, mode="optimal", edges=None):
    g = frames(spark, SIX[0], edges or SIX[1])
    return {r.query_id: r for r in verify.judged(spark.createDataFrame(queries, Q), spark.createDataFrame(results, R), spark.createDataFrame(answers, A), g.edges, mode).collect()}


def test_judge(spark):
    queries = [(0, 0, 4), (1, 4, 0), (2, 3, 3), (3, 0, 4), (4, 0, 4), (5, 0, 4), (6, 0, 4), (7, 0, 4), (8, 3, 3), (9, 0, 4)]
    answers = [(i, "found", 2.0) for i in range(10)]
    answers[1] = (1, "unreachable", None)
    answers[2] = answers[8] = None
    answers = [a for a in answers if a] + [(2, "found", 0.0), (8, "found", 0.0)]
    results = [
        (0, "found", 2.0, [0, 1, 3, 4]), (1, "unreachable", None, []), (2, "found", 0.0, [3]), (3, "found", 5.0, [0, 3, 4]), (4, "not_implemented", None, []),
        (5, "unreachable", None, []), (6, "found", 2.0, [0, 1, 3]), (7, "found", 2.0, [0, 4]), (8, "found", 0.0, [3, 3]), (9, "found", 2.5, [0, 1, 3, 4]),
    ]
    got = judge(spark, results, answers, queries)
    assert {i: r.error for i, r in got.items()} == {0: None, 1: None, 2: None, 3: "not_optimal", 4: "not_implemented", 5: "wrong_status", 6: "wrong_ends", 7: "missing_edge", 8: "self_path", 9: "wrong_sum"}
    assert judge(spark, results, answers, queries, "any")[3].error is None and got[3].gap_percent == pytest.approx(150)
    zero = judge(spark, [(0, "found", 5.0, [0, 3])], [(0, "found", 0.0)], [(0, 0, 3)], "any")[0]
    assert zero.gap_percent is None and zero.extra == 5 and zero.error is None
    with pytest.raises(ValueError):
        judge(spark, results, answers, queries, "other")


def test_report_and_bound(spark):
    rows = [(0, None, 0.0, 0.0, True), (1, None, 1.0, 2.0, False), (2, None, 1.1, 3.0, False), (3, None, None, 5.0, False), (4, "wrong_status", None, None, None)]
    j = spark.createDataFrame(rows, "query_id long, error string, gap_percent double, extra double, optimal boolean")
    r = verify.report(j).first()
    assert (r.queries, r.errors, r.valid, r.optimal, r.undefined_gaps, r.max_gap, r.max_extra) == (5, 1, 4, 1, 1, 1.1, 5.0)
    assert {x.query_id for x in verify.bound_violations(j, 1.01).collect()} == {2, 3}


def test_sets_and_fingerprints(spark):
    a, c = spark.range(5).toDF("k"), spark.range(2, 7).toDF("k")
    assert {(r.k, r.side) for r in verify.set_difference(a, c, "k").collect()} == {(0, "left"), (1, "left"), (5, "right"), (6, "right")}
    assert verify.fingerprint(a).first() == verify.fingerprint(a.repartition(3)).first() != verify.fingerprint(c).first()
    assert verify.same_rows(a, a.repartition(2)).count() == 0 and verify.same_rows(a, c).count() == 4
    assert verify.fingerprint(a.limit(0)).first().rows == 0


def test_nearest_rank_and_quality(spark):
    r = b.nearest_rank(spark.createDataFrame([(4,), (1,), (3,), (2,), (None,)], "v long"), [], "v").first()
    assert (r.n, r.mean, r.p50, r.p95, r["max"], r.total) == (4, 2.5, 2, 4, 4, 10)
    schema = "g int, gap_percent double, extra double, optimal boolean"

    def passes(gaps):
        return b.quality(spark.createDataFrame([(1, x, 0.0, x == 0) for x in gaps], schema), ["g"]).select(b.passes().alias("p")).first().p

    good = [0.0] * 95 + [2.0] * 4 + [5.0]
    assert passes(good) and not passes([*good, None]) and not passes([*good[:-1], 6.0])
    t = b.throughput(spark.createDataFrame([(1, 10.0), (2, 20.0)], "repetition int, wall_ms double"), 100).first()
    assert t.qps == pytest.approx(200 * 1000 / 30)


def test_choice_and_grid(spark):
    rows = spark.createDataFrame([(1000, 1.01, 1.0, 3.0, 5, 1.0), (2000, 1.01, 1.02, 2.0, 5, 1.0), (4000, 1.01, 1.1, 1.0, 5, 1.0)], "size int, weight double, score_ms double, p95_ms double, index_bytes long, build_ms double")
    assert b.choose(rows).first().size == 2000 and b.top_sizes(rows) == [2000, 1000]
    assert b.choose(rows.limit(0)).count() == 0 and b.top_sizes(rows.limit(0)) == []
    assert b.coarse_grid(spark).count() == 44
    sizes = b.fine_sizes(spark.createDataFrame([(250,), (100000,), (10,)], "size int"), (0.5, 1.1)).collect()
    assert {r.size for r in sizes} == {125, 150, 300, 24000}  # 125 and 275 are rounded half up to 150 and 300
    for pairs in (0, 3, 10):
        orders = b.balanced_schedule(pairs)
        assert sorted(orders) == sorted([("a", "b"), ("b", "a")] * (pairs // 2) + [("a", "b")] * (pairs % 2))
    assert b.balanced_schedule(10) == b.balanced_schedule(10) != b.balanced_schedule(10, seed="2")


def test_sample_rules(spark):
    t = "repetition int, query_id long, duration_ns long, status string, wait_ns long, latency_ns long"
    rows = [(1, 1, 5, "found", 2, 7), (1, 1, 6, "found", 0, 6), (2, 1, -1, "found", 0, 0), (3, 1, 5, None, 1, 9), (9, 2, 5, "found", 1, 6)]
    df = spark.createDataFrame(rows, t)
    assert {(r.repetition, r.query_id, r.fault) for r in b.sample_faults(df, 3).collect()} == {(1, 1, "duplicate"), (2, 1, "negative"), (3, 1, "status"), (3, 1, "latency"), (9, 2, "repetition")}
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert {(r.query_id, r.missing) for r in b.missing_samples(df, q, 3).collect()} == {(2, 3)}


def test_workload(spark):
    d = spark.createDataFrame([(s, n, s * 10 + n) for s in range(30) for n in range(20)], "source long, node long, g long")
    t = workload.sampled_targets(d, per_source=4)
    assert t.count() == 120 and t.where("node = source").count() == 0
    p = workload.strata(workload.pool(t, size=100))
    counts = {r.stratum: (r.n, r.min_g, r.max_g) for r in workload.stratum_ranges(p).collect()}
    assert [counts[k][0] for k in ("short", "medium", "long")] == [34, 33, 33]
    assert counts["short"][2] <= counts["medium"][1] <= counts["medium"][2] <= counts["long"][1]
    q = workload.stratified(p, wanted=(("short", 5), ("medium", 5), ("long", 5))).collect()
    assert sorted(r.query_id for r in q) == list(range(15))
    none = spark.createDataFrame([(3,)], "source long")
    assert workload.sources(spark.range(5), none).count() == 4


def test_stream(spark, tmp_path):
    from tests.test_routing import network

    net = network(*SIX)
    inbox = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([(k * 10 + i, i, (i + k) % 6) for i in range(6)], Q).coalesce(1).write.mode("append").parquet(str(inbox))
    out = str(tmp_path / "out")
    route_stream(query_stream(spark, str(inbox), "*.parquet"), kernel_answers(net), out, str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(f"{out}/*")
    assert rows.count() == 18 and rows.where("batch > 0").count() > 0
    spark.createDataFrame([(99, 0, 4)], Q).coalesce(1).write.mode("append").parquet(str(inbox))
    route_stream(query_stream(spark, str(inbox), "*.parquet"), kernel_answers(net), out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(f"{out}/*").count() == 19
    asked = spark.createDataFrame([(1, 7), (0, 8)], "input_pos long, query_id long")
    got = ordered(spark.createDataFrame([(7, "found"), (8, "found")], "query_id long, status string"), asked)
    assert [r.query_id for r in got.collect()] == [8, 7]
