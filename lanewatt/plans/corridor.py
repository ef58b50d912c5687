"""Queries over sources, checks, linear referencing, assembly and map tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import calibrate, linref, quality, scenario, score
from ..sources import ingest, landing
from ..sources.scratch import scratch_folder
from ..streaming.detectors import five_minute_flow, run_available, stream_detector_files
from .registry import query
from .views import HORIZON, with_ts

# Corridors of 400 segments out of the part table, with 300 ramps each out of customers: postmiles from running lengths.
SEG_SQL = """seg0 AS (SELECT 'k' || (p_partkey // 400) AS corridor_id, CAST(p_partkey % 400 AS INT) AS seq, 3 + p_size % 3 AS lanes, 300e0 + p_size * 11 AS length_m FROM part),
seg AS (SELECT corridor_id, seq, lanes, length_m, sum(length_m / 1609.344) OVER (PARTITION BY corridor_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS pm_end, sum(length_m / 1609.344) OVER (PARTITION BY corridor_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - length_m / 1609.344 AS pm_start FROM seg0)"""
JUN_SQL = """jun AS (SELECT 'k' || (c_custkey // 300) AS corridor_id, CAST(c_custkey AS BIGINT) AS junction_id, CASE WHEN c_custkey % 2 = 0 THEN 'on' ELSE 'off' END AS kind, CAST((c_custkey * 7) % 9000 AS DOUBLE) / 101e0 AS postmile, c_name AS name FROM customer)"""
BREAKS = SEG_SQL + ", " + JUN_SQL + """, span AS (SELECT corridor_id, min(pm_start) AS lo, max(pm_end) AS hi FROM seg GROUP BY 1),
breaks AS (SELECT DISTINCT corridor_id, round(pm, 6) AS pm FROM (SELECT corridor_id, lo AS pm FROM span UNION ALL SELECT corridor_id, hi FROM span UNION ALL
SELECT corridor_id, pm_start FROM (SELECT *, lag(lanes) OVER (PARTITION BY corridor_id ORDER BY seq) AS was FROM seg) WHERE lanes <> was UNION ALL SELECT corridor_id, postmile FROM jun) x JOIN span USING (corridor_id) WHERE pm BETWEEN lo - 1e-9 AND hi + 1e-9),
made AS (SELECT * FROM (SELECT corridor_id, row_number() OVER (PARTITION BY corridor_id ORDER BY pm) - 1 AS cell, pm AS pm_start, lead(pm) OVER (PARTITION BY corridor_id ORDER BY pm) AS pm_end FROM breaks) WHERE pm_end IS NOT NULL)"""


def segments(t):
    s = t.part.select(
        F.concat(F.lit("k"), F.floor(F.col("p_partkey") / 400)).alias("corridor_id"), (F.col("p_partkey") % 400).cast("int").alias("seq"), (3 + F.col("p_size") % 3).alias("lanes"), (300.0 + F.col("p_size") * 11).alias("length_m")
    )
    return linref.cumulative_postmile(s)


def junctions(t):
    k = F.col("c_custkey")
    return t.customer.select(
        F.concat(F.lit("k"), F.floor(k / 300)).alias("corridor_id"), k.alias("junction_id"), F.when(k % 2 == 0, "on").otherwise("off").alias("kind"), ((k * 7 % 9000).cast("double") / 101).alias("postmile"), F.col("c_name").alias("name")
    )


@query("e6_cumulative_postmile", f"WITH {SEG_SQL} SELECT corridor_id, seq, round(pm_start, 5) AS pm_start, round(pm_end, 5) AS pm_end FROM seg", 5)
def _(t):
    return segments(t).select("corridor_id", "seq", "pm_start", "pm_end")


@query("e7_lane_changes", f"WITH {SEG_SQL} SELECT corridor_id, round(pm_start, 5) AS pm FROM (SELECT *, lag(lanes) OVER (PARTITION BY corridor_id ORDER BY seq) AS was FROM seg) WHERE lanes <> was", 5)
def _(t):
    return linref.lane_changes(segments(t))


@query("g1_cell_breaks", f"WITH {BREAKS} SELECT corridor_id, round(pm, 6) AS pm FROM breaks", 6)
def _(t):
    return linref.cell_breaks(segments(t), junctions(t))


def made_cells(t):
    return linref.cells_from_breaks(linref.cell_breaks(segments(t), junctions(t)), junctions(t), segments(t))


@query("e8_cells_from_breaks", f"""WITH {BREAKS}, j AS (SELECT corridor_id, kind, round(postmile, 6) AS pm, arg_max(name, junction_id) AS name FROM jun GROUP BY 1, 2, 3)
SELECT m.corridor_id, cell, round(pm_start, 6) AS pm_start, round(pm_end, 6) AS pm_end, a.name AS on_ramp_name, b.name AS off_ramp_name FROM made m
LEFT JOIN j a ON a.kind = 'on' AND a.corridor_id = m.corridor_id AND a.pm = pm_start LEFT JOIN j b ON b.kind = 'off' AND b.corridor_id = m.corridor_id AND b.pm = pm_end""", 6)
def _(t):
    return made_cells(t).select("corridor_id", "cell", "pm_start", "pm_end", "on_ramp_name", "off_ramp_name")


@query("c6_lanes_at", f"""WITH {BREAKS} SELECT m.corridor_id, cell, CAST(arg_min(lanes, seq) AS INT) AS lanes FROM made m JOIN seg s ON s.corridor_id = m.corridor_id
AND (m.pm_start + m.pm_end) / 2 BETWEEN s.pm_start - 1e-9 AND s.pm_end + 1e-9 GROUP BY 1, 2""")
def _(t):
    breaks = linref.cell_breaks(segments(t), junctions(t))
    cells = linref.cells_from_breaks(breaks, junctions(t), segments(t)).drop("lanes")
    return linref.lanes_at(cells, segments(t)).withColumn("lanes", F.col("lanes").cast("int"))


@query("c5_interpolate_postmile", f"""WITH {SEG_SQL}, {JUN_SQL}, e AS (SELECT corridor_id, min(pm_start) AS lo, max(pm_end) AS hi, min(seq) AS a, max(seq) AS b FROM seg GROUP BY 1),
h AS (SELECT j.corridor_id, junction_id, arg_min(s.seq + least(greatest((postmile - pm_start) / (pm_end - pm_start), 0), 1), s.seq) AS pos FROM jun j JOIN seg s ON s.corridor_id = j.corridor_id AND postmile BETWEEN pm_start - 1e-9 AND pm_end + 1e-9 GROUP BY 1, 2)
SELECT j.corridor_id, j.junction_id AS point_id, round(CASE WHEN pos IS NOT NULL THEN pos WHEN postmile < lo THEN a WHEN postmile > hi THEN b + 1 END, 4) AS node_pos FROM jun j JOIN e USING (corridor_id) LEFT JOIN h USING (corridor_id, junction_id)""")
def _(t):
    points = junctions(t).select("corridor_id", F.col("junction_id").alias("point_id"), F.col("postmile").alias("pm"))
    return linref.interpolate_postmile(points, segments(t))


@query("g5_crop_corridor", f"WITH {SEG_SQL}, {JUN_SQL} SELECT 'segment' AS what, corridor_id, count(*) AS n FROM seg WHERE pm_start >= 5.01 AND pm_end <= 40.02 GROUP BY 2 UNION ALL SELECT 'junction', corridor_id, count(*) FROM jun WHERE postmile BETWEEN 5.01 AND 40.02 GROUP BY 2")
def _(t):
    s, j = linref.crop_corridor(segments(t), junctions(t), 5.01, 40.02)
    count = lambda df, what: df.groupBy("corridor_id").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "corridor_id", "n")
    return count(s, "segment").unionByName(count(j, "junction"))


ASSIGN = """pts AS (SELECT corridor_id, station_id, abs_pm AS pm, lanes AS s_lanes FROM stations WHERE type = 'ML'),
cand AS (SELECT c.cell, c.pm_start, c.pm_end, c.lanes, p.* FROM cells c JOIN pts p ON c.corridor_id = p.corridor_id AND ((c.cell % 25 = 0 AND p.pm >= c.pm_start - 1e-9) OR p.pm > c.pm_start + 1e-9) AND p.pm <= c.pm_end + 1e-9),
pick AS (SELECT cell, count(*) AS k, arg_min(station_id, (abs(pm - (pm_start + pm_end) / 2), station_id)) AS vds_id, arg_min(pm, (abs(pm - (pm_start + pm_end) / 2), station_id)) AS vds_pm FROM cand GROUP BY 1)"""


def bare_cells(t):
    return t.cells.select("corridor_id", "cell", "pm_start", "pm_end", "lanes")


def ml_points(t):
    return t.stations.where("type = 'ML'").select("corridor_id", "station_id", F.col("abs_pm").alias("pm"), "lanes")


@query("c7_assign_stations", f"WITH {ASSIGN} SELECT c.cell, vds_id, CASE WHEN k > 1 THEN 'direct_tiebreak' WHEN k = 1 THEN 'direct' ELSE 'missing' END AS vds_source, coalesce(k, 0) AS vds_n_candidates FROM cells c LEFT JOIN (SELECT cell AS cc, k, vds_id AS vds_id, vds_pm FROM pick) p ON cc = c.cell".replace("SELECT c.cell, vds_id,", "SELECT c.cell, p.vds_id,"))
def _(t):
    return linref.assign_stations(bare_cells(t), ml_points(t)).select("cell", "vds_id", "vds_source", "vds_n_candidates")


@query("u2_tiebreak_lowest_id", f"WITH {ASSIGN} SELECT c.cell, p.vds_id FROM cells c LEFT JOIN (SELECT cell AS cc, min(station_id) AS vds_id FROM cand GROUP BY 1) p ON cc = c.cell")
def _(t):
    return linref.assign_stations(bare_cells(t), ml_points(t), "lowest_id").select("cell", "vds_id")


@query("c8_inherit_upstream", f"""WITH {ASSIGN}, a AS (SELECT c.corridor_id, c.cell, p.vds_id, p.vds_pm, (c.pm_start + c.pm_end) / 2 AS mid FROM cells c LEFT JOIN (SELECT cell AS cc, vds_id, vds_pm FROM pick) p ON cc = c.cell),
u AS (SELECT *, last_value(vds_id IGNORE NULLS) OVER (PARTITION BY corridor_id ORDER BY cell) AS id, last_value(vds_pm IGNORE NULLS) OVER (PARTITION BY corridor_id ORDER BY cell) AS pm FROM a)
SELECT cell, id AS vds_id, CASE WHEN vds_id IS NULL AND id IS NOT NULL THEN round(pm - mid, 5) END AS vds_distance_mi FROM u""", 5)
def _(t):
    return linref.inherit_upstream(linref.assign_stations(bare_cells(t), ml_points(t))).select("cell", "vds_id", "vds_distance_mi")


@query("b14_haversine_bearing", """WITH p AS (SELECT station_id, radians(34e0) AS a, radians(latitude) AS b, radians(longitude) - radians(-118e0) AS d FROM stations)
SELECT station_id, round(2 * 6371009e0 * asin(least(1, sqrt(sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin(d / 2) ** 2))), 3) AS metres,
round(CASE WHEN degrees(atan2(sin(d) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(d))) < 0 THEN 360 ELSE 0 END + degrees(atan2(sin(d) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(d))), 3) AS bearing FROM p""", 3)
def _(t):
    a, b = F.lit(34.0), F.lit(-118.0)
    return t.stations.select("station_id", S.haversine_m(a, b, "latitude", "longitude").alias("metres"), S.bearing(a, b, "latitude", "longitude").alias("bearing"))


# A line of three bends, the same for every corridor, along which its stations are projected.
LINE = [(-118.0, 34.0), (-117.96, 34.03), (-117.93, 34.05), (-117.9, 34.1)]


def line_segments(t):
    point = lambda p: F.struct(F.lit(p[0]).alias("lon"), F.lit(p[1]).alias("lat"))
    rows = [F.struct(F.lit(k).alias("seq"), F.array(point(LINE[k]), point(LINE[k + 1])).alias("geometry"), F.lit(3.0 * k).alias("pm_start"), F.lit(3.0 * k + 3).alias("pm_end")) for k in range(3)]
    return t.cells.select("corridor_id").distinct().select("corridor_id", F.explode(F.array(*rows)).alias("r")).select("corridor_id", "r.*", F.lit(3).alias("lanes"))


_EDGES = ", ".join(f"({k}, {LINE[k][0]}e0, {LINE[k][1]}e0, {LINE[k + 1][0]}e0, {LINE[k + 1][1]}e0)" for k in range(3))


@query("c3_project_to_corridor", f"""WITH e AS (SELECT * FROM (VALUES {_EDGES}) v(seq, ax, ay, ex, ey)),
x AS (SELECT station_id, seq, longitude AS lo, latitude AS la, ax, ay, ex - ax AS dx, ey - ay AS dy, least(greatest(((longitude - ax) * (ex - ax) + (latitude - ay) * (ey - ay)) / ((ex - ax) ** 2 + (ey - ay) ** 2), 0), 1) AS t FROM stations CROSS JOIN e),
d AS (SELECT station_id, seq, 3e0 * seq + 3e0 * t AS pm, 2 * 6371009e0 * asin(least(1, sqrt(sin((radians(ay + t * dy) - radians(la)) / 2) ** 2 + cos(radians(la)) * cos(radians(ay + t * dy)) * sin((radians(ax + t * dx) - radians(lo)) / 2) ** 2))) AS m FROM x)
SELECT station_id, round(min(m), 2) AS distance_m, round(arg_min(pm, (m, seq)), 4) AS pm, min(m) <= 2000 AS on_corridor FROM d GROUP BY 1""")
def _(t):
    out = linref.project_to_corridor(t.stations, line_segments(t), 2000.0, keep_off=True)
    return out.select("station_id", F.round("distance_m", 2).alias("distance_m"), "pm", "on_corridor")


@query("c23_cell_lines", f"""WITH e AS (SELECT * FROM (VALUES {_EDGES}) v(seq, ax, ay, ex, ey)),
x AS (SELECT cell, seq, ax, ay, ex, ey, greatest(pm_start, 3e0 * seq) AS lo, least(pm_end, 3e0 * seq + 3) AS hi FROM cells JOIN e ON 3e0 * seq <= pm_end AND 3e0 * seq + 3 >= pm_start),
p AS (SELECT cell, seq, ax + (lo / 3 - seq) * (ex - ax) AS x0, ay + (lo / 3 - seq) * (ey - ay) AS y0, ax + (hi / 3 - seq) * (ex - ax) AS x1, ay + (hi / 3 - seq) * (ey - ay) AS y1 FROM x)
SELECT cell, round(sum(2 * 6371009e0 * asin(least(1, sqrt(sin((radians(y1) - radians(y0)) / 2) ** 2 + cos(radians(y0)) * cos(radians(y1)) * sin((radians(x1) - radians(x0)) / 2) ** 2)))), 1) AS metres,
round(arg_min(x0, seq), 5) AS west, round(arg_max(y1, seq), 5) AS north FROM p GROUP BY 1""", 5)
def _(t):
    lines = linref.cell_lines(t.cells.select("corridor_id", "cell", "pm_start", "pm_end"), line_segments(t))
    return lines.select("cell", F.round(linref.line_length_m("line"), 1).alias("metres"), F.col("line")[0]["lon"].alias("west"), F.element_at("line", -1)["lat"].alias("north"))


@query("c4_annotate_postmiles", """WITH n AS (SELECT c_custkey AS node_id, -118e0 + (c_custkey % 97) / 1e3 AS x, 34e0 + (c_custkey % 89) / 1e3 AS y, 5 + c_custkey % 2 AS route FROM customer),
m AS (SELECT route, abs_pm AS pm, latitude, longitude FROM stations),
b AS (SELECT node_id, x, y, min({'d': (longitude - x) ** 2 + (latitude - y) ** 2, 'pm': pm, 'lat': latitude, 'lon': longitude}) AS b FROM n JOIN m USING (route) GROUP BY 1, 2, 3),
z AS (SELECT node_id, b.pm AS pm, radians(b.lat) AS a1, radians(y) AS a2, radians(x) - radians(b.lon) AS d FROM b),
w AS (SELECT node_id, pm, 2 * 6371009e0 * asin(least(1, sqrt(sin((a2 - a1) / 2) ** 2 + cos(a1) * cos(a2) * sin(d / 2) ** 2))) / 1609.344 AS mi, degrees(atan2(sin(d) * cos(a2), cos(a1) * sin(a2) - sin(a1) * cos(a2) * cos(d))) AS deg FROM z)
SELECT node_id, round(CASE WHEN deg >= 0 AND deg <= 180 THEN pm + mi ELSE pm - mi END, 4) AS pm FROM w""")
def _(t):
    k = F.col("c_custkey")
    nodes = t.customer.select(k.alias("node_id"), (F.lit(-118.0) + k % 97 / 1e3).alias("x"), (F.lit(34.0) + k % 89 / 1e3).alias("y"), (5 + k % 2).alias("route"))
    return linref.annotate_postmiles(nodes, t.stations.select("route", F.col("abs_pm").alias("pm"), "latitude", "longitude"))


@query("c9_assign_ramp_stations", f"""WITH {JUN_SQL}, j AS (SELECT c.corridor_id, junction_id, kind, c.pm_start AS pm0, c.pm_end AS pm1, cell, 34e0 + (junction_id % 100) / 1e3 AS lat, -118e0 + (junction_id % 90) / 1e3 AS lon FROM jun JOIN cells c ON c.cell = junction_id // 60),
r AS (SELECT *, CASE WHEN kind = 'on' THEN pm0 ELSE pm1 END AS postmile FROM j),
d AS (SELECT r.*, s.station_id, radians(lat) AS a, radians(latitude) AS b, radians(longitude) - radians(lon) AS l FROM r JOIN stations s ON s.corridor_id = r.corridor_id AND s.type = CASE WHEN kind = 'on' THEN 'OR' ELSE 'FR' END),
n AS (SELECT *, 2 * 6371009e0 * asin(least(1, sqrt(sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin(l / 2) ** 2))) AS m FROM d),
k AS (SELECT corridor_id, junction_id, kind, round(postmile, 6) AS pm, arg_min(station_id, (m, station_id)) AS station_id FROM n WHERE m <= 2000 GROUP BY 1, 2, 3, 4),
g AS (SELECT corridor_id, kind, pm, arg_max(station_id, junction_id) AS station_id FROM k GROUP BY 1, 2, 3)
SELECT c.cell, g.kind, g.station_id FROM cells c JOIN g ON g.corridor_id = c.corridor_id AND ((g.kind = 'on' AND g.pm = round(c.pm_start, 6)) OR (g.kind = 'off' AND g.pm = round(c.pm_end, 6)))""")
def _(t):
    j = junctions(t).drop("corridor_id").withColumn("cell", F.floor(F.col("junction_id") / 60)).join(t.cells.select("corridor_id", "cell", "pm_start", "pm_end"), "cell")
    j = j.select("corridor_id", "junction_id", "kind", F.when(F.col("kind") == "on", F.col("pm_start")).otherwise(F.col("pm_end")).alias("postmile"), (34.0 + F.col("junction_id") % 100 / 1e3).alias("lat"), (-118.0 + F.col("junction_id") % 90 / 1e3).alias("lon"))
    return linref.assign_ramp_stations(t.cells, j, t.stations, 2000.0).select("cell", "kind", "station_id")


# Map edges out of orders: tags as strings, some of them lists.
EDGE_SQL = """edges AS (SELECT o_orderkey AS edge_id, o_custkey AS u, (o_custkey * 7 + 1) % (SELECT max(c_custkey) FROM customer) + 1 AS v, CASE o_orderkey % 5 WHEN 0 THEN 'motorway_link' WHEN 1 THEN 'primary' ELSE 'motorway' END AS highway,
CASE o_orderkey % 6 WHEN 0 THEN 'I 5; CA 92' WHEN 1 THEN NULL WHEN 2 THEN 'I 880' ELSE 'I 5' END AS ref, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS name,
CASE o_orderkey % 5 WHEN 0 THEN '3;4;4' WHEN 1 THEN '4;3' WHEN 2 THEN 'x' WHEN 3 THEN NULL ELSE '2' END AS lanes, 100e0 + o_orderkey % 37 AS length_m FROM orders),
nodes AS (SELECT c_custkey AS node_id, -118e0 + (c_custkey * 31 % 991) / 1e4 AS x, 34e0 + (c_custkey * 17 % 983) / 1e4 AS y FROM customer)"""


def edges(t):
    k = F.col("o_orderkey")
    pick = lambda m, *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (k % m + 1).cast("int"))
    n = t.customer.agg(F.max("c_custkey")).first()[0]
    return t.orders.select(
        k.alias("edge_id"), F.col("o_custkey").alias("u"), ((F.col("o_custkey") * 7 + 1) % n + 1).alias("v"), pick(5, "motorway_link", "primary", "motorway", "motorway", "motorway").alias("highway"), pick(6, "I 5; CA 92", None, "I 880", "I 5", "I 5", "I 5").alias("ref"),
        F.when(k % 4 > 0, F.col("o_orderpriority")).alias("name"), pick(5, "3;4;4", "4;3", "x", None, "2").alias("lanes"), (100.0 + k % 37).alias("length_m"),
    )


def nodes(t):
    k = F.col("c_custkey")
    return t.customer.select(k.alias("node_id"), (F.lit(-118.0) + k * 31 % 991 / 1e4).alias("x"), (F.lit(34.0) + k * 17 % 983 / 1e4).alias("y"))


@query("b12_b13_parse_tags_lanes", f"WITH {EDGE_SQL} SELECT edge_id, CASE edge_id % 6 WHEN 0 THEN 'I 5|CA 92' WHEN 1 THEN '' WHEN 2 THEN 'I 880' ELSE 'I 5' END AS refs, CASE edge_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 4 THEN 2 ELSE 0 END AS n_lanes, CASE edge_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 4 THEN 2 ELSE 0 END AS commonest FROM edges")
def _(t):
    return edges(t).select("edge_id", F.array_join(S.parse_tags("ref"), "|").alias("refs"), S.parse_lanes("lanes").alias("n_lanes"), S.lanes_of_list(F.split("lanes", ";")).alias("commonest"))


@query("b9_route_number", f"WITH {EDGE_SQL} SELECT edge_id, CASE edge_id % 6 WHEN 0 THEN '5' WHEN 2 THEN '880' WHEN 1 THEN NULL ELSE '5' END AS first_run, CASE edge_id % 6 WHEN 0 THEN '592' WHEN 2 THEN '880' WHEN 1 THEN NULL ELSE '5' END AS joined FROM edges")
def _(t):
    return edges(t).select("edge_id", S.route_number("ref").alias("first_run"), S.route_number("ref", True).alias("joined"))


@query("d20_f2_summarize_refs", f"""WITH {EDGE_SQL}, x AS (SELECT e.*, trim(r) AS rr, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy FROM (SELECT *, unnest(string_split(ref, ';')) AS r FROM edges WHERE highway = 'motorway' AND ref IS NOT NULL) e JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v),
n AS (SELECT rr, name, row_number() OVER (PARTITION BY rr ORDER BY count(*) DESC, name) AS rn FROM x WHERE name IS NOT NULL GROUP BY 1, 2)
SELECT rr AS ref, count(*) AS n_edges, round(sum(length_m) / 1609.344, 3) AS length_mi, (SELECT string_agg(name, ', ' ORDER BY rn) FROM n WHERE n.rr = x.rr AND rn <= 3) AS names,
round(min(least(ux, vx)), 3) AS west, round(min(least(uy, vy)), 3) AS south, round(max(greatest(ux, vx)), 3) AS east, round(max(greatest(uy, vy)), 3) AS north FROM x GROUP BY rr ORDER BY length_mi DESC, ref LIMIT 2""", 3)
def _(t):
    return linref.top_refs(linref.summarize_refs(edges(t), nodes(t)), 2)


@query("c19_mainline_edges", f"""WITH {EDGE_SQL}, x AS (SELECT u, v, radians(a.y) AS p, radians(b.y) AS q, radians(b.x) - radians(a.x) AS d FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v WHERE highway = 'motorway' AND ref LIKE '%I 5%'),
z AS (SELECT u, v, degrees(atan2(sin(d) * cos(q), cos(p) * sin(q) - sin(p) * cos(q) * cos(d))) AS g FROM x) SELECT u, v, round(CASE WHEN g < 0 THEN g + 360 ELSE g END, 3) AS bearing FROM z WHERE abs(g) <= 60""", 3)
def _(t):
    return linref.mainline_edges(edges(t), nodes(t), "I 5", "N").select("u", "v", "bearing")


@query("c18_ramp_junctions", f"""WITH {EDGE_SQL}, m AS (SELECT node_id FROM nodes WHERE node_id % 3 = 0)
SELECT u, v, CASE WHEN v IN (SELECT node_id FROM m) THEN 'on' ELSE 'off' END AS kind, CASE WHEN v IN (SELECT node_id FROM m) THEN v ELSE u END AS node, coalesce(name, trim(string_split(ref, ';')[1])) AS name, 3 AS lanes
FROM edges WHERE highway = 'motorway_link' AND (u IN (SELECT node_id FROM m)) <> (v IN (SELECT node_id FROM m))""")
def _(t):
    return linref.ramp_junctions(edges(t), nodes(t).where("node_id % 3 = 0"))


@query("d32_corridor_summary", f"""WITH {SEG_SQL}, {JUN_SQL}, s AS (SELECT * FROM seg), j AS (SELECT * FROM jun),
w AS (SELECT *, CASE WHEN length < 0.2 THEN 'too_short' WHEN length > 0.8 THEN 'too_long' ELSE 'ok' END AS length_warning FROM cells)
SELECT item, round(CAST(value AS DOUBLE), 3) AS value FROM (SELECT unnest(['n_segments', 'total_mi', 'n_on_ramps', 'n_off_ramps', 'n_cells', 'mean_cell_mi', 'min_cell_mi', 'max_cell_mi', 'n_lane_changes']) AS item,
unnest([(SELECT count(*) FROM s), (SELECT sum(pm_end - pm_start) FROM s), (SELECT count(*) FROM j WHERE kind = 'on'), (SELECT count(*) FROM j WHERE kind = 'off'), (SELECT count(*) FROM cells), (SELECT avg(length) FROM cells), (SELECT min(length) FROM cells), (SELECT max(length) FROM cells),
(SELECT count(*) FROM (SELECT lanes, lag(lanes) OVER (PARTITION BY corridor_id ORDER BY seq) AS was FROM s) WHERE lanes <> was)]) AS value)
UNION ALL SELECT 'lanes=' || lanes, count(*) FROM w GROUP BY 1 UNION ALL SELECT 'length_warning=' || length_warning, count(*) FROM w GROUP BY 1 UNION ALL SELECT 'vds_source=' || vds_source, count(*) FROM w GROUP BY 1""", 3)
def _(t):
    cells = t.cells.withColumn("length_warning", S.length_warning("length", 0.2, 0.8))
    return linref.corridor_summary(segments(t), junctions(t), cells)


# Checks.


@query("b19_length_warning", "SELECT cell, CASE WHEN length < 0.3 THEN 'too_short' WHEN length > 0.7 THEN 'too_long' ELSE 'ok' END AS warning FROM cells")
def _(t):
    return t.cells.select("cell", S.length_warning("length", 0.3, 0.7).alias("warning"))


@query("b15_freeway_violations", """WITH f AS (SELECT *, CASE WHEN cell % 6 = 0 THEN q_max * 1.1 ELSE q_max END AS q, CASE WHEN cell % 5 = 4 THEN CASE WHEN cell % 2 = 0 THEN 900e0 ELSE 0e0 END END AS cap FROM cells)
SELECT cell, unnest(list_filter([CASE WHEN cap <= 0 THEN 'on_capacity_not_positive' END, CASE WHEN cap IS NOT NULL AND NOT on_ramp THEN 'on_capacity_without_ramp' END, CASE WHEN abs(q - v_f * rho_crit) > 1e-3 * q THEN 'free_flow_identity' END,
CASE WHEN abs(q - w * (rho_jam - rho_crit)) > 1e-3 * q THEN 'congestion_identity' END, CASE WHEN v_f * (20 / 3600e0) > length THEN 'stability' END], lambda x: x IS NOT NULL)) AS violation FROM f""")
def _(t):
    f = t.cells.withColumn("q_max", F.when(F.col("cell") % 6 == 0, F.col("q_max") * 1.1).otherwise(F.col("q_max")))
    f = f.withColumn("on_ramp_capacity", F.when(F.col("cell") % 5 == 4, F.when(F.col("cell") % 2 == 0, 900.0).otherwise(0.0))).withColumn("off_ramp_capacity", F.lit(None).cast("double"))
    return quality.freeway_violations(f, 20 / 3600)


def ramped(t):
    """Cells with lists of ramp stations, as text and parsed."""
    raw = F.concat(F.lit("["), F.col("cell") * 3 + 3, F.lit("; "), (F.col("cell") * 3 + 8).cast("string"), F.lit(".0, nan, v7]"))
    ids = F.when(F.col("cell") % 5 != 1, S.parse_ramp_ids(raw)).otherwise(F.array().cast("array<string>"))
    return t.cells.withColumns({"raw_ids": raw, "on_ramp_vds_ids": ids, "off_ramp_vds_ids": ids, "fd_vds_id": F.lit(None).cast("long")})


@query("b10_parse_ramp_ids", "SELECT cell, (cell * 3 + 3) || '|' || (cell * 3 + 8) || '|v7' AS ids, CAST(2 AS INT) AS n_numeric FROM cells")
def _(t):
    ids = S.parse_ramp_ids("raw_ids")
    return ramped(t).select("cell", F.array_join(ids, "|").alias("ids"), F.size(S.numeric_ids(ids)).alias("n_numeric"))


@query("b11_classify_ramp_flow", """SELECT station_id, CASE WHEN type = 'OR' THEN 'on' WHEN type = 'FR' THEN 'off' WHEN regexp_matches(name, '(?i)\\b(off|to)\\b') THEN 'off' WHEN regexp_matches(name, '(?i)\\b(on|from)\\b') THEN 'on' ELSE 'review' END AS flow FROM stations""")
def _(t):
    return t.stations.select("station_id", S.classify_ramp_flow("type", "name").alias("flow"))


@query("b17_presence_without_vds", "SELECT cell FROM cells WHERE on_ramp AND cell % 5 = 1")
def _(t):
    return quality.presence_without_vds(ramped(t), "on").select("cell")


@query("b18_lane_mismatch", "SELECT cell, lanes, vds_lanes FROM cells WHERE vds_source IN ('direct', 'direct_tiebreak') AND lanes <> vds_lanes")
def _(t):
    return quality.lane_mismatch(t.cells).select("cell", "lanes", "vds_lanes")


@query("b25_pad_spec_violations", """WITH s AS (SELECT p_partkey AS spec_id, 3.5e0 AS alpha, (p_size % 4) * 0.25e0 AS lambda_gap, 1.5e0 AS delta FROM part)
SELECT spec_id, 'lambda_gap_not_positive' AS violation FROM s WHERE lambda_gap = 0 UNION ALL SELECT spec_id, 'lambda_gap_off_grid' FROM s WHERE abs(round_even(lambda_gap / 0.5, 0) * 0.5 - lambda_gap) > 1e-6""")
def _(t):
    s = t.part.select(F.col("p_partkey").alias("spec_id"), F.lit(3.5).alias("alpha"), (F.col("p_size") % 4 * 0.25).alias("lambda_gap"), F.lit(1.5).alias("delta"), F.lit(1.5e5).alias("beta"), F.lit(1.5e5).alias("beta_prime"), F.lit(0.5).alias("dx"))
    return quality.pad_spec_violations(s)


# Assembly.

FD_SQL = "fd AS (SELECT station_id, CASE WHEN station_id % 3 = 2 THEN 4 ELSE 0 END AS code, 1700e0 + station_id AS capacity, 60e0 + station_id % 7 AS v FROM stations)"


def fd(t):
    s = F.col("station_id")
    return t.stations.select(s, F.when(s % 3 == 2, 4).otherwise(0).alias("calibration_code"), (1700.0 + s).alias("capacity"), (60.0 + s % 7).alias("free_flow_speed"), F.lit(15.0).alias("congestion_wave_speed"), F.lit(150.0).alias("jam_density"), F.lit(30.0).alias("critical_density"))


def caps(t):
    return t.stations.where("station_id % 4 > 0").select("station_id", (800.0 + F.col("station_id")).alias("ramp_capacity"))


CAP_SQL = """ids AS (SELECT cell, unnest([cell * 3 + 3, cell * 3 + 8, NULL]) AS id FROM cells WHERE {side}_ramp AND cell % 5 <> 1),
cap AS (SELECT cell, sum(CASE WHEN s.station_id % 4 > 0 THEN 800e0 + s.station_id END) AS capacity, count(*) AS n_ids, count(*) FILTER (s.station_id IS NULL OR s.station_id % 4 = 0) AS n_missing FROM ids LEFT JOIN stations s ON s.station_id = id GROUP BY 1)"""


@query("c12_ramp_capacity", f"WITH {CAP_SQL.format(side='on')} SELECT cell, round(capacity, 3) AS capacity, n_ids, n_missing FROM cap", 3)
def _(t):
    return calibrate.ramp_capacity(ramped(t), caps(t), "on").drop("corridor_id")


@query("c10_assemble_freeway", f"""WITH {FD_SQL}, {CAP_SQL.format(side='on')} SELECT c.cell, vds_id AS effective_id, round(f.capacity * lanes, 3) AS q_max, f.v AS v_f, f.capacity IS NULL AS unresolved, round(cap.capacity, 3) AS on_ramp_capacity
FROM cells c LEFT JOIN fd f ON f.station_id = c.vds_id AND code = 0 LEFT JOIN cap ON cap.cell = c.cell""", 3)
def _(t):
    return calibrate.assemble_freeway(ramped(t), fd(t), caps(t)).select("cell", "effective_id", "q_max", "v_f", "unresolved", "on_ramp_capacity")


@query("c11_redirect_failed_fd", f"""WITH {FD_SQL}, x AS (SELECT cell, vds_id, code, last_value(CASE WHEN code = 0 THEN vds_id END IGNORE NULLS) OVER (PARTITION BY corridor_id ORDER BY cell) AS good FROM cells LEFT JOIN fd ON station_id = vds_id)
SELECT cell, coalesce(code <> 0, false) AS redirected, CASE WHEN code <> 0 THEN good END AS fd_vds_id FROM x""")
def _(t):
    return calibrate.redirect_failed_fd(ramped(t), fd(t)).select("cell", "redirected", "fd_vds_id")


@query("d19_cfl_advisory", "SELECT round(min(x), 4) AS bound_s, arg_min(cell, (x, cell)) AS binding_cell, round(avg(x), 4) AS mean_s, round(max(x), 4) AS max_s, floor((min(x) - 1e-9) / 5) * 5e0 AS suggested_s FROM (SELECT cell, length / v_f * 3600 AS x FROM cells)")
def _(t):
    return calibrate.cfl_advisory(t.cells)


STRETCH = """side AS (SELECT route, direction, station_id, abs_pm, CASE WHEN type = 'ML' THEN 'ml' WHEN type = 'OR' THEN 'on' WHEN type = 'FR' THEN 'off' WHEN regexp_matches(name, '(?i)\\b(off|to)\\b') THEN 'off' WHEN regexp_matches(name, '(?i)\\b(on|from)\\b') THEN 'on' ELSE 'review' END AS side FROM stations),
gapped AS (SELECT *, coalesce(count(*) FILTER (side = 'ml') OVER (PARTITION BY route, direction ORDER BY abs_pm, CASE WHEN side = 'ml' THEN 1 ELSE 0 END, station_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM side),
ml AS (SELECT route, direction, station_id, abs_pm, row_number() OVER (PARTITION BY route, direction ORDER BY abs_pm, station_id) AS k FROM side WHERE side = 'ml'),
st AS (SELECT g.route, g.direction, g.gap, any_value(lo.station_id) AS lo_id, any_value(lo.abs_pm) AS lo_pm, any_value(hi.station_id) AS hi_id, any_value(hi.abs_pm) AS hi_pm, count(*) FILTER (side = 'on') AS n_on, count(*) FILTER (side = 'off') AS n_off, count(*) FILTER (side = 'review') AS n_review,
coalesce(string_agg(g.station_id, ',' ORDER BY g.station_id) FILTER (side = 'on'), '') AS on_ids FROM gapped g LEFT JOIN ml lo ON lo.route = g.route AND lo.direction = g.direction AND lo.k = g.gap LEFT JOIN ml hi ON hi.route = g.route AND hi.direction = g.direction AND hi.k = g.gap + 1 GROUP BY 1, 2, 3),
stretch AS (SELECT *, row_number() OVER (PARTITION BY route, direction ORDER BY gap) AS stretch_id, CASE WHEN direction IN ('N', 'E') THEN hi_id ELSE lo_id END AS down_ml_id, CASE WHEN direction IN ('N', 'E') THEN lo_id ELSE hi_id END AS up_ml_id,
CASE WHEN n_on > 0 AND n_off > 0 THEN 'c' WHEN n_on > 0 THEN 'a' WHEN n_off > 0 THEN 'b' ELSE 'mainline' END AS config_type FROM st)"""


@query("c13_build_stretches", f"WITH {STRETCH} SELECT route, direction, stretch_id, up_ml_id, down_ml_id, on_ids, n_on, n_off, config_type FROM stretch")
def _(t):
    return scenario.build_stretches(t.stations).select("route", "direction", "stretch_id", "up_ml_id", "down_ml_id", F.array_join("on_ids", ",").alias("on_ids"), "n_on", "n_off", "config_type")


@query("d22_stretch_summary", f"WITH {STRETCH} SELECT config_type, count(*) AS n, CAST(sum(n_on) AS BIGINT) AS n_on, CAST(sum(n_off) AS BIGINT) AS n_off, count(*) FILTER (n_review > 0 OR lo_id IS NULL OR hi_id IS NULL OR n_on > 1 OR n_off > 1) AS n_notes FROM stretch GROUP BY 1")
def _(t):
    return scenario.stretch_summary(scenario.build_stretches(t.stations))


DOWN = STRETCH + """, ramp_ids AS (SELECT cell, unnest([cell * 3 + 3, cell * 3 + 8]) AS id FROM cells WHERE off_ramp AND cell % 5 <> 1),
own AS (SELECT s.station_id AS id, x.direction, x.down_ml_id, CASE WHEN x.direction IN ('N', 'E') THEN hi_pm ELSE -lo_pm END AS ahead FROM gapped s JOIN stretch x ON x.route = s.route AND x.direction = s.direction AND x.gap = s.gap WHERE s.side IN ('on', 'off') AND down_ml_id IS NOT NULL),
down AS (SELECT cell, arg_max(down_ml_id, (ahead, down_ml_id)) AS down_ml_id FROM ramp_ids JOIN own USING (id) GROUP BY 1)"""


@query("c14_downstream_mainline", f"WITH {DOWN} SELECT cell, down_ml_id FROM down")
def _(t):
    return scenario.downstream_mainline(ramped(t).where("off_ramp"), "off", scenario.build_stretches(t.stations))


# One day of flow for every station of the view, out of lineitem.
FLOW_SQL = "flows AS (SELECT CAST(l_suppkey AS BIGINT) AS station_id, CAST(l_orderkey % 96 AS BIGINT) AS m_5min, sum(l_quantity) AS flow FROM lineitem GROUP BY 1, 2)"


def flows(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("station_id"), (F.col("l_orderkey") % 96).alias("m_5min")).agg(F.sum("l_quantity").alias("flow"))


@query("h9_ramp_demand", f"""WITH {FLOW_SQL}, i AS (SELECT cell, unnest([cell * 3 + 3, cell * 3 + 8]) AS id FROM cells WHERE on_ramp AND cell % 5 <> 1),
m AS (SELECT station_id, avg(flow) AS mean FROM flows GROUP BY 1), g AS (SELECT cell, m_5min, coalesce(flow, mean) AS flow FROM i JOIN m ON id = station_id CROSS JOIN (SELECT unnest(range(12, 84)) AS m_5min) x LEFT JOIN flows USING (station_id, m_5min))
SELECT cell, (m_5min - 12) * 3 + k AS step, round(12 * sum(flow), 3) AS demand FROM g CROSS JOIN (SELECT unnest(range(0, 3)) AS k) GROUP BY 1, 2""", 3)
def _(t):
    return scenario.ramp_demand(ramped(t), flows(t), 12, 84, 100, mean_filled)


def mean_filled(flow):
    """Every station at each of the view's 96 samples, gaps by the station's mean."""
    means = flow.groupBy("station_id").agg(F.avg("flow").alias("mean"))
    grid = means.withColumn("m_5min", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(95).cast("long"))))
    return grid.join(flow, ["station_id", "m_5min"], "left").select("station_id", "m_5min", F.coalesce("flow", "mean").alias("flow"))


@query("h10_split_ratio", f"""WITH {DOWN}, {FLOW_SQL}, s AS (SELECT cell, m_5min, sum(flow) AS s FROM ramp_ids JOIN flows ON id = station_id GROUP BY 1, 2),
f AS (SELECT cell, m_5min, flow AS f FROM down JOIN flows ON down_ml_id = station_id) SELECT cell, m_5min, round(least(coalesce(CASE WHEN f + s > 0 THEN s / (f + s) END, 0), 0.9999999999999999), 6) AS beta FROM s LEFT JOIN f USING (cell, m_5min)""", 6)
def _(t):
    return scenario.split_ratio(ramped(t), flows(t), scenario.build_stretches(t.stations)).select("cell", "m_5min", "beta")


@query("c24_absent_ramp_flow", f"""WITH {STRETCH}, {FLOW_SQL}, fl AS (SELECT f.* FROM flows f JOIN side s USING (station_id) WHERE s.side = 'ml' OR station_id % 4 = 0),
ramps AS (SELECT station_id, side AS kind FROM side WHERE side IN ('on', 'off')), absent AS (SELECT * FROM ramps WHERE station_id NOT IN (SELECT station_id FROM fl)),
own AS (SELECT g.station_id, g.side AS kind, x.route, x.direction, x.gap, x.up_ml_id, x.down_ml_id, x.config_type FROM gapped g JOIN stretch x USING (route, direction, gap) WHERE g.side IN ('on', 'off')),
sib AS (SELECT route, direction, gap, kind, m_5min, sum(flow) AS sib FROM own JOIN fl USING (station_id) GROUP BY ALL)
SELECT o.station_id, o.kind, u.m_5min, round(greatest(CASE WHEN config_type = 'c' THEN 0.1 * u.flow WHEN o.kind = 'on' THEN greatest(d.flow - u.flow, 0) ELSE greatest(u.flow - d.flow, 0) END - coalesce(sib, 0), 0), 4) AS flow
FROM own o JOIN absent a ON a.station_id = o.station_id JOIN fl u ON u.station_id = o.up_ml_id JOIN fl d ON d.station_id = o.down_ml_id AND d.m_5min = u.m_5min
LEFT JOIN sib s ON s.route = o.route AND s.direction = o.direction AND s.gap = o.gap AND s.kind = o.kind AND s.m_5min = u.m_5min""")
def _(t):
    s = t.stations.withColumn("kind", F.when(F.col("type") == "ML", "ml").otherwise(S.classify_ramp_flow("type", "name"))).select("station_id", "kind")
    fl = flows(t).join(s, "station_id").where("kind = 'ml' OR station_id % 4 = 0").select("station_id", "m_5min", "flow")
    st = scenario.build_stretches(t.stations).withColumn("stretch_id", F.concat_ws("/", "route", "direction", "stretch_id"))
    return scenario.absent_ramp_flow(s.where("kind IN ('on', 'off')"), st, fl)


# Sources.

LINE_SQL = "CASE WHEN l_linenumber = 7 THEN 'bad' ELSE '' END"


class Rows:
    """Some of the line items in place of all."""

    def __init__(self, lineitem):
        self.lineitem = lineitem


def feed(t, quantity=None):
    """Lines of the raw feed: two lanes for odd stations, one for even ones; one line in seven has a bad width."""
    stamp = F.date_format(F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(l_orderkey % 288 AS INT) * 5, 0)"), ingest.TIME_FORMAT)
    lane = F.concat_ws(",", F.lit("10"), F.col("l_quantity").cast("string"), F.lit("0.1"), F.lit(""), F.lit("100"))
    head = F.concat_ws(",", stamp, F.col("l_suppkey"), F.lit("4"), F.lit("880"), F.lit("N"), F.lit("ML"), F.lit("0.5"), F.lit("30"), F.lit("100"), (F.col("l_quantity") if quantity is None else quantity).cast("string"), F.lit("0.05"), F.lit("61.5"))
    line = F.concat_ws(",", head, F.when(F.col("l_suppkey") % 2 == 1, F.concat_ws(",", lane, lane)).otherwise(lane), F.when(F.col("l_linenumber") == 7, F.lit("1")))
    return t.lineitem.select(line.alias("value"))


@query("a1_a2_parse_detector_lines", "SELECT l_suppkey AS station_id, l_orderkey % 288 AS m_5min, count(*) AS n, count(*) FILTER (l_linenumber = 7) AS n_bad, CAST(sum(CASE WHEN l_linenumber = 7 THEN 0 WHEN l_suppkey % 2 = 1 THEN 2 ELSE 1 END) AS BIGINT) AS n_lanes, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1, 2", 2)
def _(t):
    rows = ingest.parse_detector_lines(feed(t)).withColumn("m_5min", F.expr("timestampdiff(MINUTE, timestamp_ntz'2024-01-01 00:00:00', ts) div 5"))
    return rows.groupBy("station_id", "m_5min").agg(F.count("*").alias("n"), F.count_if("bad_width").alias("n_bad"), F.sum(F.size("lanes")).alias("n_lanes"), F.sum("total_flow_5min").alias("total"))


@query("a3_explode_lanes", "SELECT l_suppkey AS station_id, lane, count(*) AS n, round(sum(l_quantity), 2) AS flow FROM lineitem CROSS JOIN (SELECT 1 AS lane UNION ALL SELECT 2) WHERE l_linenumber <> 7 AND (lane = 1 OR l_suppkey % 2 = 1) GROUP BY 1, 2", 2)
def _(t):
    lanes = ingest.explode_lanes(ingest.with_lanes(ingest.parse_detector_lines(feed(t))))
    return lanes.groupBy("station_id", "lane").agg(F.count("*").alias("n"), F.sum("flow").alias("flow"))


@query("a4_a5_g4_merge_by_station", "SELECT station_id, count(*) AS n FROM det GROUP BY 1")
def _(t):
    d = t.det
    return ingest.merge_by_station(d.where("m_5min % 3 < 2"), d.where("m_5min % 3 > 0")).groupBy("station_id").agg(F.count("*").alias("n"))


@query("a5_landed_deliveries", "WITH x AS (SELECT DISTINCT station_id, m_5min, avg_speed_mph FROM det) SELECT station_id, count(*) AS n, round(sum(avg_speed_mph), 2) AS speed, count(DISTINCT m_5min) AS n_times FROM x GROUP BY 1", 2)
def _(t):
    """Three deliveries with overlaps, landed one after the other by station and month; the last touches some months only."""
    table = landing.StationMonths(t.spark, scratch_folder(t.spark, "landed"))
    d = with_ts(t.det.select("station_id", "m_5min", "avg_speed_mph"))
    for part in (F.col("m_5min") % 3 < 2, F.col("m_5min") % 3 > 0, F.col("m_5min") < 2000):
        table.land(d.where(part))
    return table.read().groupBy("station_id").agg(F.count("*").alias("n"), F.sum("avg_speed_mph").alias("speed"), F.countDistinct("m_5min").alias("n_times"))


@query("a6_split_by_station", "SELECT m_5min, round(avg_speed_mph, 4) AS avg_speed_mph FROM det WHERE station_id = 3")
def _(t):
    return ingest.split_by_station(t.det, 3).select("m_5min", "avg_speed_mph")


@query("a7_new_files", "SELECT DISTINCT c_name AS file_name FROM customer WHERE c_nationkey % 3 <> 0")
def _(t):
    names = t.customer.select(F.col("c_name").alias("file_name"), "c_nationkey")
    return ingest.new_files(names.select("file_name"), names.where("c_nationkey % 3 = 0")).distinct()


@query("a8_expand_file_requests", "SELECT type, s_suppkey AS district, year, month FROM supplier CROSS JOIN (SELECT unnest(['a', 'b']) AS type) CROSS JOIN (SELECT unnest([2023, 2024]) AS year) CROSS JOIN (SELECT unnest([1, 7]) AS month)")
def _(t):
    return ingest.expand_file_requests(t.supplier.select(F.col("s_suppkey").alias("district")), ["a", "b"], [2023, 2024], [1, 7])


@query("a9_a10_station_metadata", "SELECT station_id, route, direction, lanes, round(abs_pm, 4) AS abs_pm FROM stations WHERE type = 'ML' AND route = 5 AND direction = 'N'")
def _(t):
    raw = t.stations.select(F.col("station_id").cast("string").alias("ID"), F.col("route").cast("string").alias("Fwy"), F.lower("direction").alias("Dir"), F.col("type").alias("Type"), F.col("abs_pm").cast("string").alias("Abs_PM"), F.col("latitude").cast("string").alias("Latitude"), F.col("longitude").cast("string").alias("Longitude"), F.col("lanes").cast("string").alias("Lanes"))
    return ingest.clean_station_metadata(raw, 5, "n").select("station_id", "route", "direction", "lanes", "abs_pm")


@query("a13_freeway_table", "SELECT cell, CASE WHEN cell % 2 = 0 THEN rho_crit ELSE q_max / v_f END AS rho_crit, on_ramp, false AS off_ramp, 1e0 AS gamma FROM cells")
def _(t):
    raw = t.cells.select("cell", "length", "q_max", "v_f", "w", "rho_jam", F.when(F.col("cell") % 2 == 0, F.col("rho_crit")).alias("rho_crit"), F.when(F.col("on_ramp"), " Yes").otherwise("0").alias("on_ramp"))
    return ingest.clean_freeway_table(raw).select("cell", "rho_crit", "on_ramp", "off_ramp", "gamma")


@query("a15_long_to_wide", "SELECT step, cell // 64 AS block, cell % 64 AS k, round(rho_post, 4) AS value FROM traj")
def _(t):
    """All cells, 64 columns a block."""
    wide = ingest.long_to_blocks(t.traj, "step", "rho_post")
    return wide.select("step", "block", F.posexplode("values").alias("k", "value")).where("value IS NOT NULL").withColumn("k", F.col("k").cast("long"))


@query("a14_wide_to_long", "SELECT s.step, c.cell, round(coalesce(rho_post, 0), 4) AS value FROM (SELECT DISTINCT step FROM traj) s CROSS JOIN cells c LEFT JOIN traj t ON t.step = s.step AND t.cell = c.cell")
def _(t):
    return ingest.blocks_to_long(ingest.long_to_blocks(t.traj, "step", "rho_post"), "step", "value", cells=t.cells)


@query("a18_matrix_cells", "SELECT s_suppkey AS id, r AS row, c AS col, CAST(s_suppkey * 10 + r * 3 + c AS DOUBLE) AS value FROM supplier CROSS JOIN (SELECT unnest(range(0, 2)) AS r) CROSS JOIN (SELECT unnest(range(0, 3)) AS c)")
def _(t):
    k = F.col("s_suppkey")
    text = F.concat_ws("\n", *[F.concat_ws(", ", *[(k * 10 + r * 3 + c).cast("string") for c in range(3)]) for r in range(2)])
    return ingest.matrix_cells(t.supplier.select(k.alias("id"), text.alias("value")), "id")


def bundle(t):
    """A fit bundle written and read again."""
    c = t.cells.withColumn("on_ramp_capacity", F.when(F.col("on_ramp"), 900.0)).withColumn("off_ramp_capacity", F.lit(None).cast("double"))
    path = scratch_folder(t.spark, "bundle")
    inflow = scenario.inflow_series(t.det.select("station_id", "m_5min", F.col("total_flow_5min").alias("flow")), 0, 300, 0, HORIZON)
    ingest.write_fit_bundle(path, c, scenario.initial_density(t.cells, t.obs5, 100), inflow, score.observed_grid(t.obs5, t.cells, HORIZON), 5.0, HORIZON)
    return ingest.read_fit_bundle(t.spark, path)


@query("a19_fit_bundle_meta", "SELECT 5e0 AS dt_s, 8640 AS horizon, count(*) AS n_cells, string_agg(cell, ',' ORDER BY cell) FILTER (on_ramp) AS on_ramp_cells, string_agg(cell, ',' ORDER BY cell) FILTER (off_ramp) AS off_ramp_cells, count(*) FILTER (on_ramp) AS n_bounded FROM cells")
def _(t):
    said = lambda n: F.array_join(F.transform(n, lambda x: x.cast("string")), ",").alias(n)
    bounded = F.size(F.filter("capacities", lambda x: x["on_ramp_capacity"] == 900)).cast("long").alias("n_bounded")
    return bundle(t)["meta"].select("dt_s", "horizon", "n_cells", said("on_ramp_cells"), said("off_ramp_cells"), bounded)


@query("a19_fit_bundle_tables", """SELECT 'params' AS name, count(*) AS n, round(sum(q_max), 2) AS total FROM cells UNION ALL SELECT 'initial', count(*), round((SELECT sum(o.density) FROM cells JOIN obs5 o ON o.station_id = vds_id AND o.m_5min = 100), 2) FROM cells
UNION ALL SELECT 'inflow', count(*), round(sum(total_flow_5min * 12), 2) FROM det WHERE station_id = 0
UNION ALL SELECT 'observed', (SELECT count(*) FROM cells WHERE vds_id IS NOT NULL) * 8640, round((SELECT sum(o.density) FROM cells c JOIN obs5 o ON o.station_id = c.vds_id), 2)""", 2)
def _(t):
    b = bundle(t)
    tables = (("params", "q_max"), ("initial", "rho0"), ("inflow", "inflow"), ("observed", "density"))
    return reduce(DataFrame.unionByName, [b[n].agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum(v).alias("total")) for n, v in tables])


METRIC_LABELS = {"rmse": "Flow RMSE", "mape": "Flow MAPE"}


def studies(t):
    k = F.col("c_custkey")
    text = F.concat_ws("\n", F.lit("Report"), F.concat(F.lit(" Flow RMSE: "), (k * 1.5).cast("string"), F.lit(" veh/h")), F.when(k % 5 > 0, F.concat(F.lit("Flow MAPE : "), (k * 0.25).cast("string"))))
    texts = t.customer.select(k.alias("distance_mi"), F.when(k % 2 == 0, "base").otherwise("tuned").alias("strategy"), text.alias("value"))
    return ingest.parse_study_reports(texts, METRIC_LABELS)


@query("a21_d30_study_summaries", "SELECT c_custkey AS distance_mi, CASE WHEN c_custkey % 2 = 0 THEN 'base' ELSE 'tuned' END AS strategy, c_custkey * 1.5 AS rmse, CASE WHEN c_custkey % 5 > 0 THEN c_custkey * 0.25 END AS mape, CASE WHEN c_custkey % 5 = 0 THEN 'mape' ELSE '' END AS missing FROM customer")
def _(t):
    return studies(t).withColumn("missing", F.array_join("missing", ","))


@query("d30_cross_study", """WITH s AS (SELECT c_custkey AS distance_mi, CASE WHEN c_custkey % 2 = 0 THEN 'base' ELSE 'tuned' END AS strategy, c_custkey * 1.5e0 AS rmse, CASE WHEN c_custkey % 5 > 0 THEN c_custkey * 25e-2 END AS mape FROM customer),
x AS (SELECT 'rmse' AS metric, strategy, distance_mi, rmse AS value FROM s UNION ALL SELECT 'mape', strategy, distance_mi, mape FROM s) SELECT metric, strategy, distance_mi, row_number() OVER (PARTITION BY metric, strategy ORDER BY distance_mi) AS rank, value FROM x""")
def _(t):
    return ingest.cross_study(studies(t), ["rmse", "mape"])


@query("g2_station_intersection", "SELECT DISTINCT station_id FROM stations WHERE station_id IN (SELECT station_id FROM det)")
def _(t):
    return t.stations.select("station_id").intersect(t.det.select("station_id"))


@query("g3_missing_stations", "SELECT station_id FROM stations WHERE station_id NOT IN (SELECT station_id FROM det)")
def _(t):
    return ingest.missing_stations(t.stations, t.det)


@query("f3_ordered", "SELECT station_id, m_5min FROM det")
def _(t):
    return with_ts(t.det).sortWithinPartitions("station_id", "ts").select("station_id", "m_5min")


@query("f4_latest_snapshot", "SELECT max(c_name) AS file_name FROM customer")
def _(t):
    return ingest.latest_snapshot(t.customer.select(F.col("c_name").alias("file_name")))


@query("s1_stream_flow", """WITH f AS (SELECT l_suppkey AS station_id, l_orderkey % 288 AS m, l_linenumber <= 4 AS early, (l_suppkey * 7 + l_orderkey % 288 * 3) % 50 + 1 AS q FROM lineitem WHERE l_linenumber <> 7),
wm AS (SELECT max(m) - 3 AS w FROM f WHERE early), counted AS (SELECT DISTINCT station_id, m, q FROM f, wm WHERE early OR m > w),
late AS (SELECT count(*) AS late_rows FROM f, wm WHERE NOT early AND m <= w), again AS (SELECT (SELECT count(*) FROM f, wm WHERE early OR m > w) - (SELECT count(*) FROM counted) AS repeated_rows)
SELECT station_id, m AS m_5min, q * 12e0 AS flow, round(q * 12 / 61.5, 4) AS density, CAST(1 AS BIGINT) AS n, late_rows, repeated_rows FROM counted, wm, late, again WHERE m < w""")
def _(t):
    """The raw feed in two deliveries through files and a stream: what the watermark has closed, copies counted once, and
    how many rows came too late or again."""
    files, sink, state = (scratch_folder(t.spark, n) for n in ("feed", "stream", "stream-state"))
    early, told = F.col("l_linenumber") <= 4, []
    for part in (early, ~early):
        lines = feed(Rows(t.lineitem.where(part)), (F.col("l_suppkey") * 7 + F.col("l_orderkey") % 288 * 3) % 50 + 1)
        lines.write.mode("append").option("compression", "gzip").text(files)
        told.append(run_available(five_minute_flow(stream_detector_files(t.spark, files)), sink, state))
    out = t.spark.read.parquet(sink)
    late, repeated = (F.lit(sum(x[k] for x in told)).cast("long") for k in ("late", "repeated"))
    return out.select("station_id", F.expr("(unix_seconds(start) - 1704067200) div 300").alias("m_5min"), "flow", "density", "n", late.alias("late_rows"), repeated.alias("repeated_rows"))


@query("b7_window_problems", """WITH w AS (SELECT o_orderkey AS id, 1704067200 + o_custkey % 50 * 150 AS a, 1704067200 + o_custkey % 7 * 1800 AS b, CASE o_orderkey % 5 WHEN 0 THEN 100e0 WHEN 1 THEN 900e0 WHEN 2 THEN 7e0 WHEN 3 THEN 3600e0 ELSE 5000e0 END AS dt FROM orders)
SELECT id, CASE WHEN dt > 3600 THEN 'dt_out_of_range' WHEN dt = 7 THEN 'dt_does_not_divide' WHEN b <= a THEN 'empty_window' WHEN a % g <> 0 OR b % g <> 0 THEN 'off_grid' END AS problem FROM (SELECT *, CASE WHEN dt <= 300 THEN 300 ELSE 3600 END AS g FROM w)""")
def _(t):
    k = F.col("o_custkey")
    at = lambda s: F.timestamp_seconds(F.lit(1704067200) + s)
    pick = F.element_at(F.array(*[F.lit(x) for x in (100.0, 900.0, 7.0, 3600.0, 5000.0)]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    w = t.orders.select(F.col("o_orderkey").alias("id"), at(k % 50 * 150).alias("a"), at(k % 7 * 1800).alias("b"), pick.alias("dt"))
    return w.select("id", S.window_problem("a", "b", "dt").alias("problem"))


@query("b28_resolved_starts", """WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 4 END AS given, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 4 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END END AS kept FROM orders)
SELECT id, CASE WHEN given <> kept THEN NULL ELSE coalesce(kept, given) END AS day, CASE WHEN given <> kept THEN 'not_the_stored_one' WHEN given IS NULL AND kept IS NULL THEN 'none' END AS problem FROM s""")
def _(t):
    k, day = F.col("o_orderkey"), F.col("o_custkey") % 4
    start = lambda d: F.timestamp_seconds(F.lit(1704067200) + d * 86400)
    s = t.orders.select(k.alias("id"), F.when(k % 3 > 0, start(day)).alias("given"), F.when(k % 4 > 0, start(day + F.when(k % 7 == 0, 1).otherwise(0))).alias("kept"))
    found = s.select("id", S.start_problem("given", "kept").alias("problem"), S.resolved_start("given", "kept").alias("at"))
    return found.select("id", F.expr("(unix_seconds(at) - 1704067200) div 86400").alias("day"), "problem")


@query("a12_write_read_corridor", f"WITH {JUN_SQL} SELECT kind, count(*) AS n, round(sum(postmile), 3) AS total FROM jun GROUP BY 1", 3)
def _(t):
    path = scratch_folder(t.spark, "corridor")
    nodes = t.customer.select(F.col("c_custkey").alias("node_id"), F.lit(0.0).alias("pm"))
    ingest.write_corridor(line_segments(t), junctions(t), nodes, path)
    return ingest.read_corridor(t.spark, path)[1].groupBy("kind").agg(F.count("*").alias("n"), F.sum("postmile").alias("total"))


@query("a11_marker_ranges", "SELECT route, count(*) AS n, round(sum(abs_pm), 3) AS pm, round(min(longitude), 4) AS west, (SELECT count(*) FROM stations WHERE route <> 5 AND station_id % 7 = 0) AS n_problems FROM stations WHERE route = 5 GROUP BY 1")
def _(t):
    """One file of features, read by ranges of a few kilobytes; features without a postmile are told apart."""
    path = scratch_folder(t.spark, "marker-file")
    pm = F.when((F.col("route") == 5) | (F.col("station_id") % 7 != 0), F.col("abs_pm"))
    point = F.struct(F.lit("Feature").alias("type"), F.struct(F.concat(F.lit("I "), "route").alias("Route"), pm.alias("PM"), F.concat(F.lit('{"properties": {}, "geometry": "'), "name").alias("note")).alias("properties"), F.struct(F.array("longitude", "latitude").alias("coordinates")).alias("geometry"))
    t.stations.select(F.concat(F.to_json(point), F.lit(",")).alias("value")).write.text(path)
    markers, problems = ingest.read_marker_ranges(t.spark, path, [5], 4096)
    n = problems.agg(F.count("*").alias("n_problems"))  # one row
    return markers.groupBy("route").agg(F.count("*").alias("n"), F.round(F.sum("pm"), 3).alias("pm"), F.min("longitude").alias("west")).crossJoin(n)


@query("a11_postmile_markers", "SELECT route, count(*) AS n, round(sum(abs_pm), 3) AS pm, round(min(longitude), 4) AS west FROM stations WHERE route = 5 GROUP BY 1")
def _(t):
    path = scratch_folder(t.spark, "markers")
    point = F.struct(F.struct(F.concat(F.lit("I "), "route").alias("Route"), F.col("abs_pm").alias("PM")).alias("properties"), F.struct(F.array("longitude", "latitude").alias("coordinates")).alias("geometry"))
    t.stations.select(F.to_json(F.struct(F.array(point).alias("features"))).alias("value")).write.text(path)  # a file of features a row
    m = ingest.parse_markers(t.spark.read.text(path), [5])
    return m.groupBy("route").agg(F.count("*").alias("n"), F.round(F.sum("pm"), 3).alias("pm"), F.min("longitude").alias("west"))
