"""Queries of the data-quality operators: spikes (3), nearby points (4), rejected lines (5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nearby, regions, rejects, spikes
from .catalog import Catalog, table

CATALOG = Catalog()
add = CATALOG.add

_P3 = """
WITH r AS (SELECT DISTINCT query_id, repetition, duration_ns AS d, wait_ns AS w FROM timings),
l AS (SELECT query_id, repetition, 0 AS f, d AS v FROM r WHERE d BETWEEN 1 AND 86400000000000
      UNION ALL SELECT query_id, repetition, 1, w FROM r WHERE w BETWEEN 0 AND 86400000000000),
m AS (SELECT query_id, f, median(v) AS m FROM l GROUP BY query_id, f),
s AS (SELECT l.query_id, l.f, any_value(m.m) AS m, median(abs(l.v - m.m)) AS s
      FROM l JOIN m ON l.query_id = m.query_id AND l.f = m.f GROUP BY l.query_id, l.f),
z AS (SELECT query_id, repetition, 0 AS f, d AS v FROM r WHERE d IS NOT NULL
      UNION ALL SELECT query_id, repetition, 1, w FROM r WHERE w IS NOT NULL),
z1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, f ORDER BY repetition)
               - row_number() OVER (PARTITION BY query_id, f, v ORDER BY repetition) AS g FROM z),
z2 AS (SELECT query_id, repetition, v, count(*) OVER (PARTITION BY query_id, f, v, g) AS c FROM z1)
SELECT l.query_id, CAST(l.repetition AS BIGINT) AS repetition FROM l JOIN s ON l.query_id = s.query_id AND l.f = s.f
WHERE l.v - s.m > 10 * s.s OR (l.f = 0 AND s.m - l.v > 10 * s.s)
UNION SELECT query_id, CAST(repetition AS BIGINT) FROM z2 WHERE c >= 5 AND v <> 0
UNION SELECT query_id, CAST(repetition AS BIGINT) FROM r
WHERE d <= 0 OR d > 86400000000000 OR w < 0 OR w > 86400000000000
"""


@add("p3_found", _P3)
def p3_found(spark, d):
    """Readings that are impossible, far off or frozen."""
    found = spikes.implausible(table(spark, d, "timings"))
    return found.where("impossible or far or frozen").select("query_id", "repetition")


_TAILS = _P3[: _P3.index("SELECT l.query_id, CAST")].rstrip() + """,
h AS (SELECT DISTINCT l.query_id, l.f, l.repetition, l.v, s.m, s.s, l.v - s.m AS d, coalesce(hour(t.recorded_at), 0) AS hr,
      greatest(least(l.v - s.m, 10 * s.s), -10 * s.s) AS c
      FROM l JOIN s ON l.query_id = s.query_id AND l.f = s.f JOIN timings AS t ON t.query_id = l.query_id AND t.repetition = l.repetition),
lv AS (SELECT query_id, f, hr, avg(c) - (SELECT avg(c) FROM h AS o WHERE o.query_id = h.query_id AND o.f = h.f) AS level FROM h GROUP BY query_id, f, hr),
cp AS (SELECT query_id, f, max(abs(level)) AS shift FROM lv GROUP BY query_id, f),
x AS (SELECT h.*, 10 * h.s - cp.shift AS cap, least(3 * h.s, 10 * h.s - cp.shift) AS u,
      CASE WHEN h.f = 0 THEN abs(h.d - lv.level) ELSE h.d - lv.level END AS size, count(*) OVER (PARTITION BY h.query_id, h.f) AS n
      FROM h JOIN lv ON h.query_id = lv.query_id AND h.f = lv.f AND h.hr = lv.hr JOIN cp ON h.query_id = cp.query_id AND h.f = cp.f),
pk AS (SELECT *, size - u AS e FROM x WHERE size > u),
ab AS (SELECT query_id, f, any_value(n) AS n, count(*) AS k, avg(e) AS mean, max(e) AS most, any_value(u) AS u, any_value(cap) AS cap FROM pk GROUP BY query_id, f),
gr AS (SELECT ab.*, j, CASE WHEN j < 10 THEN -(19 - 2 * j) / 20.0::DOUBLE * mean / most WHEN j = 10 THEN 0.0::DOUBLE ELSE pow(2.0::DOUBLE, (j - 19) / 2.0::DOUBLE) END AS t FROM ab, range(34) AS y(j)),
lg AS (SELECT gr.query_id, gr.f, j, any_value(gr.t) AS t, avg(ln(1 + gr.t / gr.mean * pk.e)) AS xi FROM gr JOIN pk ON gr.query_id = pk.query_id AND gr.f = pk.f GROUP BY gr.query_id, gr.f, j),
sc AS (SELECT lg.*, ab.n, ab.k, ab.mean, ab.u, ab.cap, CASE WHEN t = 0 THEN 1.0::DOUBLE ELSE xi / t END AS scale FROM lg JOIN ab ON lg.query_id = ab.query_id AND lg.f = ab.f),
ft AS (SELECT *, row_number() OVER (PARTITION BY query_id, f ORDER BY -ln(scale) - xi - xi * xi / (2 * 0.3::DOUBLE * 0.3::DOUBLE * k) DESC, j) AS best FROM sc WHERE xi >= -0.5 AND scale > 0),
cu AS (SELECT query_id, f, least(cap, u + greatest(0, CASE WHEN xi = 0 THEN -mean * scale * ln(1e-5::DOUBLE * n / k) ELSE mean * scale / xi * (pow(1e-5::DOUBLE * n / k, -xi) - 1) END)) AS cutoff FROM ft WHERE best = 1),
tl AS (SELECT pk.query_id, pk.f AS field, CAST(pk.repetition AS BIGINT) AS repetition, pk.v AS value,
  CASE WHEN pk.f = 0 THEN abs(pk.d) ELSE pk.d END > 10 * pk.s AS far, CAST(pk.m AS DOUBLE) AS m, CAST(pk.s AS DOUBLE) AS s, round(cutoff, 0) AS cutoff
FROM pk JOIN cu ON pk.query_id = cu.query_id AND pk.f = cu.f WHERE pk.size > cutoff)
"""
_REASONS = _TAILS + """, why AS (SELECT query_id, repetition, FALSE AS impossible, far, FALSE AS frozen, TRUE AS tail FROM tl
UNION ALL SELECT query_id, repetition, FALSE, FALSE, TRUE, FALSE FROM z2 WHERE c >= 5 AND v <> 0
UNION ALL SELECT query_id, repetition, TRUE, FALSE, FALSE, FALSE FROM r WHERE d <= 0 OR d > 86400000000000 OR w < 0 OR w > 86400000000000)
SELECT query_id, CAST(repetition AS BIGINT) AS repetition, bool_or(impossible) AS impossible, bool_or(far) AS far, bool_or(frozen) AS frozen, bool_or(tail) AS tail
FROM why GROUP BY query_id, repetition
"""


@add("p3_reasons", _REASONS)
def p3_reasons(spark, d):
    """Every implausible reading with its reasons, the fitted tail among them."""
    return spikes.implausible(table(spark, d, "timings"))


@add("p3_tails", _TAILS + "SELECT * FROM tl")
def p3_tails(spark, d):
    """Readings beyond their source's tail cutoff, with its centre, spread and cutoff (whole nanoseconds)."""
    return spikes.peaks_over_threshold(table(spark, d, "timings")).withColumn("cutoff", F.round("cutoff"))


_P4 = """
WITH g AS (SELECT DISTINCT id, lat, lon FROM graph WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0)),
c AS (SELECT *, CAST(floor(lat / 0.0002) AS BIGINT) AS a, CAST(floor(lon / 0.0002) AS BIGINT) AS o FROM g),
n AS (SELECT id, lat, lon, a + i AS a, o + j AS o FROM c, range(-1, 2) x(i), range(-1, 2) y(j)),
k AS (SELECT c.id AS id_a, n.id AS id_b,
      2 * 6371008.8 * asin(sqrt(pow(sin(radians(n.lat - c.lat) / 2), 2)
        + cos(radians(c.lat)) * cos(radians(n.lat)) * pow(sin(radians(n.lon - c.lon) / 2), 2))) AS m
      FROM c JOIN n ON c.a = n.a AND c.o = n.o AND c.id < n.id)
"""


@add("p4_found", _P4 + "SELECT DISTINCT id_a, id_b FROM k WHERE m <= 15")
def p4_found(spark, d):
    """Pairs of nodes at most 15 m apart."""
    return nearby.near_pairs(table(spark, d, "graph"), 15.0)


@add("p4_neighbours", _P4 + """, p AS (SELECT DISTINCT id_a, id_b FROM k WHERE m <= 15)
SELECT id, count(*) AS neighbours FROM (SELECT id_a AS id FROM p UNION ALL SELECT id_b FROM p) GROUP BY id""")
def p4_neighbours(spark, d):
    """Of each node that has any, the number of other nodes within 15 m."""
    return nearby.near_counts(table(spark, d, "graph"), 15.0).select("id", "neighbours")


_OCT = """
WITH n AS (SELECT DISTINCT id, lat, lon, x_m, y_m FROM graph WHERE id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0)),
b AS (SELECT min(x_m) AS x0, min(y_m) AS y0 FROM n),
o AS (SELECT CAST(floor((x_m - x0) / 3500.0) AS BIGINT) * 100000 + CAST(floor((y_m - y0) / 3500.0) AS BIGINT) AS region, min(lon) - 0.0001 AS a, max(lon) + 0.0001 AS b, min(lat) - 0.0001 AS c, max(lat) + 0.0001 AS d,
  min(lon + lat) - 0.0001 AS e, max(lon + lat) + 0.0001 AS f, min(lon - lat) - 0.0001 AS g, max(lon - lat) + 0.0001 AS h
  FROM n, b WHERE x_m IS NOT NULL AND y_m IS NOT NULL GROUP BY 1)
SELECT DISTINCT n.id, o.region FROM n JOIN o ON n.lon BETWEEN o.a AND o.b AND n.lat BETWEEN o.c AND o.d AND n.lon + n.lat BETWEEN o.e AND o.f AND n.lon - n.lat BETWEEN o.g AND o.h
"""


@add("p4_regions", _OCT)
def p4_regions(spark, d):
    """Which grid clusters' hulls (octagons around their nodes, a little larger) hold each node; hulls overlap."""
    n = table(spark, d, "graph").where(F.col("id").isNotNull() & nearby.valid_position(F.col("lat"), F.col("lon"))).select("id", "lat", "lon", "x_m", "y_m").distinct()
    low = n.agg(F.min("x_m").alias("x0"), F.min("y_m").alias("y0"))  # one row
    cell = lambda v, o: F.floor((F.col(v) - F.col(o)) / 3500.0)
    m = 0.0001
    plus, minus = F.col("lon") + F.col("lat"), F.col("lon") - F.col("lat")
    hull = n.where("x_m is not null and y_m is not null").crossJoin(F.broadcast(low)).groupBy((cell("x_m", "x0") * 100000 + cell("y_m", "y0")).alias("region")).agg(
        (F.min("lon") - m).alias("a"), (F.max("lon") + m).alias("b"), (F.min("lat") - m).alias("c"), (F.max("lat") + m).alias("d"),
        (F.min(plus) - m).alias("e"), (F.max(plus) + m).alias("f"), (F.min(minus) - m).alias("g"), (F.max(minus) + m).alias("h"),
    )
    corners = ("f - d, d", "b, f - b", "b, b - h", "h + c, c", "e - c, c", "a, e - a", "a, a - g", "g + d, d")
    ring = F.array(*[F.struct(F.expr(x.split(", ")[0]).alias("x"), F.expr(x.split(", ")[1]).alias("y")) for x in corners])
    return regions.regions_holding(n.select("id", F.col("lon").alias("x"), F.col("lat").alias("y")), hull.select("region", F.array(ring).alias("rings")))


# DuckDB reads JSON laxly: bare NaN and Inf and a comma before a closing mark are looked for apart from the strings
_P5 = r"""
WITH t AS (SELECT DISTINCT line_id, feed, trim(body, E' \t\r\n') AS b FROM path_lines WHERE body IS NOT NULL),
b AS (SELECT *, regexp_replace(b, '"(?:[^"\\]|\\.)*"', '""', 'g') AS bare FROM t WHERE NOT regexp_full_match(b, '\s*')),
v AS (SELECT *, json_valid(b) AND NOT regexp_matches(bare, ',\s*[}\]]') AND NOT regexp_matches(bare, '(?i)nan|inf') AND NOT regexp_matches(bare, '/[/*]') AS ok FROM b),
j AS (SELECT line_id, feed, ok, CASE WHEN ok THEN b END AS b FROM v),
k AS (SELECT *, CASE WHEN json_type(b) = 'OBJECT' AND json_type(b, '$.lat') = 'ARRAY' AND json_type(b, '$.lng') = 'ARRAY' THEN b END AS o FROM j),
f AS (SELECT *, json_extract(o, '$.lat[*]') AS la, json_extract(o, '$.lng[*]') AS lo FROM k),
g AS (SELECT line_id, feed, o, la, lo, coalesce(o IS NOT NULL AND json_type(o, '$.RouteId') = 'VARCHAR' AND json_extract_string(o, '$.RouteId') <> ''
  AND json_type(o, '$.RouteVarId') = 'VARCHAR' AND json_extract_string(o, '$.RouteVarId') <> '' AND len(la) > 0 AND len(la) = len(lo)
  AND len(list_filter(la, lambda x: coalesce(json_type(x) IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND TRY_CAST(x AS DOUBLE) BETWEEN -90 AND 90, FALSE))) = len(la)
  AND len(list_filter(lo, lambda x: coalesce(json_type(x) IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND TRY_CAST(x AS DOUBLE) BETWEEN -180 AND 180, FALSE))) = len(lo), FALSE) AS good FROM f)
"""


@add("p5_found", _P5 + "SELECT DISTINCT line_id FROM g WHERE NOT good")
def p5_found(spark, d):
    """Lines that are neither blank nor good."""
    return rejects.bad_lines(table(spark, d, "path_lines")).select("line_id").distinct()


@add("p5_records", _P5 + """SELECT line_id, feed, json_extract_string(o, '$.RouteId') AS route, json_extract_string(o, '$.RouteVarId') AS variant, len(la) AS points,
CAST(la[1] AS DOUBLE) AS first_lat, CAST(lo[len(lo)] AS DOUBLE) AS last_lng FROM g WHERE good""")
def p5_records(spark, d):
    """Of each good line the ids, the number of points, its first latitude and last longitude."""
    r = rejects.good_routes(table(spark, d, "path_lines"))
    return r.select("line_id", "feed", F.col("RouteId").alias("route"), F.col("RouteVarId").alias("variant"), F.size("lat").cast("bigint").alias("points"), F.col("lat")[0].alias("first_lat"), F.element_at("lng", -1).alias("last_lng"))


@add("p5_bad")
def p5_bad(spark, d):
    """Bad lines with the reason."""
    return rejects.bad_lines(table(spark, d, "path_lines"))


@add("p5_good")
def p5_good(spark, d):
    """Route records of the good lines."""
    return rejects.good_routes(table(spark, d, "path_lines"))
