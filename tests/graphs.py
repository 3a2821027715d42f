"""Small graphs and plain answers to compare with."""

import math
import random

# fixed cases: adjacency lists with positions
SIX = ([(i, 10 + i / 100, 106.0, 609404.0 - 3.4 * i, 1105690.0 + 1105.8 * i) for i in range(6)], [(0, 1, 1.0), (0, 2, 1.0), (0, 3, 5.0), (1, 3, 1.0), (2, 3, 1.0), (3, 4, 0.0)])
LEAVE = ([(i, 10 + i / 100, 106.0, x, 0.0) for i, x in enumerate((-10.0, -9.0, 0.0, 1.0, 20.0, 21.0, 40.0, 100.0))],
         [(0, 1, 50.0), (0, 2, 1.0), (2, 3, 0.0), (3, 2, 0.0), (3, 1, 1.0), (3, 4, 2.0), (4, 5, 1.0), (5, 6, 1.0), (6, 0, 20.0), (2, 4, 2.0)])


def positions(xs):
    return [(i, 10 + i / 100, 106.0, float(x), 0.0) for i, x in enumerate(xs)]


def random_graph(seed, metric=False, most=12):
    rnd = random.Random(seed)
    n = rnd.randrange(2, most)
    nodes = [(i, 10 + i / 100, 106.0, rnd.uniform(0, 60), rnd.uniform(0, 60)) for i in range(n)]
    edges = []
    for a in range(n):
        for b in range(n):
            if a != b and rnd.random() < 0.25:
                line = math.hypot(nodes[a][3] - nodes[b][3], nodes[a][4] - nodes[b][4])
                edges.append((a, b, line * (1 + rnd.randrange(20) / 10) if metric else float(rnd.randrange(21))))
    return nodes, edges


def floyd(n, edges):
    d = [[0.0 if i == j else math.inf for j in range(n)] for i in range(n)]
    for a, b, w in edges:
        d[a][b] = min(d[a][b], w)
    for k in range(n):
        for i in range(n):
            for j in range(n):
                if d[i][k] + d[k][j] < d[i][j]:
                    d[i][j] = d[i][k] + d[k][j]
    return d


def frames(spark, nodes, edges):
    from waygraph.schema import Graph

    n = spark.createDataFrame(nodes, "id long, lat double, lon double, x_m double, y_m double")
    e = spark.createDataFrame(edges, "src long, dst long, w double")
    return Graph(n, e, "0" * 64)


def every_pair(spark, n):
    return spark.createDataFrame([(i * n + j, i, j) for i in range(n) for j in range(n)], "query_id long, source long, target long")
