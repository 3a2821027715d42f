import math

import pytest

from tests.graphs import LEAVE, SIX, every_pair, floyd, frames, positions, random_graph
from waygraph.operators import hierarchy, kernel, relax, workload
from waygraph.operators.hierarchy import Options, build_index, heuristic_scale, index_stats, overlay_route, overlay_two_way
from waygraph.operators.route import route
from waygraph.plans import graphs


def network(nodes, edges, cluster=None):
    """A kernel network and, with a cluster size, its index by plain means."""
    pos = [(i, x, y) for i, _, _, x, y in nodes]
    lines = [w / d for a, b, w in edges if (d := math.hypot(nodes[a][3] - nodes[b][3], nodes[a][4] - nodes[b][4])) > 0]
    scale = min([1.0, *lines]) * (1 - 1e-12)
    if cluster is None:
        return kernel.Network(pos, edges, scale=scale)
    x0, y0 = min(p[1] for p in pos), min(p[2] for p in pos)
    cell = {i: (math.floor((x - x0) / cluster), math.floor((y - y0) / cluster)) for i, x, y in pos}
    number = {c: k for k, c in enumerate(sorted(set(cell.values())))}
    gates = {v for a, b, _ in edges if cell[a] != cell[b] for v in (a, b)}
    shorts = []
    for c in number:
        inner = kernel.Network(pos, [e for e in edges if cell[e[0]] == cell[e[1]] == c])
        mine = sorted(g for g in gates if cell[g] == c)
        for a in mine:
            for b in mine:
                if a != b and (g := kernel.best_first(inner, a, b, 0.0, False))[0] is not None:
                    shorts.append((a, b, g[0], g[1][1:]))
    return kernel.Network(pos, edges, [(i, number[c]) for i, c in cell.items()], shorts, scale)


def cost(edges, path):
    w = {(a, b): x for a, b, x in edges}
    return sum(w[p] for p in zip(path, path[1:]))


@pytest.mark.parametrize("seed", range(40))
def test_kernels_on_random_graphs(seed):
    nodes, edges = random_graph(seed, metric=seed % 2 == 1, most=22)
    best = floyd(len(nodes), edges)
    flat = network(nodes, edges)
    tiers = [network(nodes, edges, c) for c in (1, 10, 25, 10000)]
    for s in range(len(nodes)):
        for t in range(len(nodes)):
            for net, names, weight in [(flat, ("dijkstra", "dijkstra_baseline", "astar"), 1.0)] + [(x, ("hpa", "bihpa"), 1.05) for x in tiers]:
                for name in names:
                    status, g, path, _ = kernel.search(net, name, s, t, weight)
                    if math.isinf(best[s][t]):
                        assert status == "unreachable" and not path
                    else:
                        assert status == "found" and path[0] == s and path[-1] == t
                        assert math.isclose(cost(edges, path), g, abs_tol=1e-9)
                        assert best[s][t] - 1e-9 <= g <= weight * best[s][t] + 1e-9


def test_fixed_cases():
    search = kernel.search
    net = network(positions((0, 1, 100)), [(0, 1, 1.0), (1, 2, 99.0), (0, 2, 102.0)], 1000)
    assert search(net, "hpa", 0, 2, 1.05)[1] == 102
    net = network(positions((0, 9, 1, 10)), [(0, 1, 9.1), (0, 2, 1.0), (2, 1, 8.0), (1, 3, 100.0)], 1000)
    assert search(net, "hpa", 0, 3, 1.05)[1::2] == (109.0, 5)
    net = network(positions((0, 0, 0)), [(0, 2, 100.0), (0, 1, 1.0), (1, 2, 1.0)], 1000)
    assert search(net, "bihpa", 0, 2, 1.05)[1] == 2
    net = network(positions((0, 10, 11, 12, 20, 21, 22, 30)), [(i, i + 1, 1.0) for i in range(7)] + [(2, 1, 0.0)], 10)
    assert search(net, "bihpa", 0, 7, 1.05)[1:3] == (7.0, list(range(8)))
    assert search(net, "bihpa", 7, 0, 1.05)[0] == "unreachable"
    assert search(net, "hpa", -1, -1)[0] == search(net, "dijkstra", None, 0)[0] == "invalid_vertex"
    with pytest.raises(ValueError):
        search(net, "other", 0, 1)


@pytest.mark.parametrize("case", [LEAVE, random_graph(101, True, 8)])
def test_set_based_on_whole_graphs(spark, case):
    nodes, edges = case
    n = len(nodes)
    best = floyd(n, edges)
    g = frames(spark, nodes, edges)
    q = every_pair(spark, n)
    scale = heuristic_scale(g.edges, g.nodes).first().scale * (1 - 1e-12)
    exact = {"plain": relax.point_to_point(g.nodes, g.edges, q), "goal": relax.point_to_point(g.nodes, g.edges, q, scale or None), "both": relax.bidirectional(g.nodes, g.edges, q)}
    for name, df in exact.items():
        rows = df.collect()
        assert len(rows) == n * n
        for r in rows:
            d = best[r.query_id // n][r.query_id % n]
            assert (r.status, r.distance) == (("unreachable", None) if math.isinf(d) else ("found", pytest.approx(d))), name
    index = build_index(g, Options(25.0, 1.05))
    for r in overlay_route(g, index, q).collect():
        d = best[r.query_id // n][r.query_id % n]
        assert (r.status == "unreachable") == math.isinf(d)
        if r.status == "found":
            assert (r.path[0], r.path[-1]) == divmod(r.query_id, n)
            assert cost(edges, r.path) == pytest.approx(r.distance) and d - 1e-9 <= r.distance <= 1.05 * d + 1e-9
    for r in overlay_two_way(g, index, q).collect():
        d = best[r.query_id // n][r.query_id % n]
        assert (r.status == "unreachable") == math.isinf(d)
        if r.status == "found":
            assert (r.path[0], r.path[-1]) == divmod(r.query_id, n)
            assert cost(edges, r.path) == pytest.approx(r.distance) and d - 1e-9 <= r.distance <= 1.05 * d + 1e-9
    net = kernel.collect_network(g.nodes, g.edges, index)
    for r in kernel.kernel_route(net, q, "bihpa").collect():
        d = best[r.query_id // n][r.query_id % n]
        assert r.error is None and (r.status == "unreachable" if math.isinf(d) else d - 1e-9 <= r.distance <= 1.05 * d + 1e-9)
    assert index_stats(index).first().clusters >= 1


def test_statuses_ties_and_repeats(spark):
    g = frames(spark, *SIX)
    q = spark.createDataFrame([(0, 0, 4), (1, 4, 0), (2, 3, 3), (3, -1, 2), (4, 2, 4), (5, 5, 0), (6, 0, 3), (6, 0, 3), (7, None, 1), (8, 1, None), (9, -1, -1), (None, 0, 1)], "query_id long, source long, target long")
    want = {0: ("found", 2.0, [0, 1, 3, 4]), 1: ("unreachable", None, []), 2: ("found", 0.0, [3]), 3: ("invalid_vertex", None, []), 4: ("found", 1.0, [2, 3, 4]), 5: ("unreachable", None, []), 6: ("found", 2.0, [0, 1, 3]), 7: ("invalid_vertex", None, []), 8: ("invalid_vertex", None, []), 9: ("invalid_vertex", None, [])}
    for strategy in ("relational", "kernel"):
        for algorithm in ("dijkstra", "astar"):
            rows = route(g, q, algorithm, strategy).collect()
            assert len(rows) == len(want)
            for r in rows:
                assert (r.status, r.distance) == want[r.query_id][:2]
                if strategy == "relational":
                    assert r.path == want[r.query_id][2]
    empty = q.limit(0)
    assert route(g, empty).count() == route(g, empty, strategy="kernel").count() == 0
    no_edges = frames(spark, SIX[0], []) if False else g
    assert relax.single_source(no_edges.edges.limit(0), q.select("source")).where("node <> source").count() == 0


def test_answers_do_not_depend_on_workers(spark):
    nodes, edges = random_graph(7, True, 20)
    net = network(nodes, edges)
    q = every_pair(spark, len(nodes))
    one, four = [sorted(map(tuple, kernel.kernel_route(net, q, "astar", workers=k).select("query_id", "status", "distance", "path").collect())) for k in (1, 4)]
    assert one == four


def test_an_error_stays_with_its_query(spark):
    nodes, edges = SIX
    net = network(nodes, edges)
    net.out[2] = [("broken", None)]
    rows = {r.query_id: r for r in kernel.kernel_route(net, every_pair(spark, 6), "dijkstra").collect()}
    assert rows[2 * 6 + 3].error and rows[2 * 6 + 3].status is None
    assert rows[1 * 6 + 3].error is None and rows[1 * 6 + 3].distance == 1


def test_options_and_identity(spark):
    for bad in (dict(cluster_m=0), dict(cluster_m=math.inf), dict(weight=1.0), dict(weight=math.nan)):
        with pytest.raises(ValueError):
            Options(**bad)
    g = frames(spark, *SIX)
    with pytest.raises(ValueError):
        route(g, every_pair(spark, 6), "dijkstra", options=Options())
    with pytest.raises(ValueError):
        route(g, every_pair(spark, 6), "nothing")
    with pytest.raises(ValueError):
        kernel.collect_network(g.nodes, g.edges, limit=3)


def test_the_registered_astar_aims(spark, tmp_path, monkeypatch):
    side = range(8)
    ids = {(x, y): 10 * x + y for x in side for y in side}
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save([(i, 1.0, 1.0, 100.0 * x, 100.0 * y) for (x, y), i in ids.items()], "id long, lat double, lon double, x_m double, y_m double", "graph")
    steps = [(i, ids[x + a, y + b], 101.5 + (3 * i % 7)) for (x, y), i in ids.items() for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if (x + a, y + b) in ids]
    save(steps, "src long, dst long, distance_m double", "graph_edges")
    save([(k, 33, t) for k, t in enumerate((33, 34, 53, 77, 999))], "query_id long, source long, target long", "queries")
    asked = {}

    def spy(net, queries, algorithm):
        asked[algorithm] = kernel_route(net, queries, algorithm).collect()
        return kernel_route(net, queries, algorithm)

    kernel_route = kernel.kernel_route
    monkeypatch.setattr(kernel, "kernel_route", spy)
    one, two = (sorted(map(tuple, f(spark, str(tmp_path)).collect())) for f in (graphs.kernel_dijkstra, graphs.kernel_astar))
    assert one == two
    blind, aimed = (sum(r.expanded or 0 for r in asked[k]) for k in ("dijkstra", "astar"))
    assert aimed < blind / 2


def test_shortcuts_by_task_and_set_based_are_the_same(spark, monkeypatch):
    nodes, edges = random_graph(12, metric=False, most=22)
    g = frames(spark, nodes, edges)
    index = lambda: sorted((r.src, r.dst, r.w, tuple(r.path)) for r in build_index(g, Options(25.0, 1.05)).overlay.where("kind = 'shortcut'").collect())
    tasks = index()
    monkeypatch.setattr(hierarchy, "TASK_EDGES", 0)
    assert tasks and tasks == index()


def test_one_tree_answers_all_targets_of_a_source():
    for seed in range(20):
        nodes, edges = random_graph(seed, most=22)
        net = network(nodes, edges)
        for s in range(len(nodes)):
            tree = kernel.Tree(net, s)
            for t in [*range(len(nodes)), *range(0, len(nodes), 3)]:
                if s != t:
                    assert tree.reach(t)[:2] == kernel.best_first(net, s, t, 0.0, False)[:2]


def test_pool_of_blocks_is_the_pool_of_all_pairs(spark):
    nodes, edges = random_graph(7, most=22)
    g = frames(spark, nodes, edges)
    every = workload.pool(workload.sampled_targets(relax.all_pairs(g.edges, g.nodes), per_source=10), size=12)
    got = workload.reachable_pool(g.edges, g.nodes, size=12, block=1)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, got.collect()))
    with pytest.raises(ValueError):
        workload.reachable_pool(g.edges, g.nodes, size=10**6, least=10**6)
