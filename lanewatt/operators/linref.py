"""Linear referencing: stations, ramps and cells along a corridor of ordered segments.

Segments carry ``geometry`` as an array of (lon, lat). Projections are planar in degrees, distances great-circle, as the
corridor is short. Cells and segments are small tables; range joins bucket the postmile, so both sides may be large.
"""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import EARTH_RADIUS_M, METRES_PER_MILE, bearing, bearing_close, haversine_m, parse_lanes, parse_tags
from ..sources.scratch import written

TOLERANCE = 1e-9
METRES_PER_DEGREE = pi * EARTH_RADIUS_M / 180
HALF_EARTH_M = pi * EARTH_RADIUS_M
#: The least side of a square, in degrees: about a kilometre.
LEAST_SQUARE = 0.01
#: A square that more rows reach is cut into four, as long as its side is longer than the margin.
SQUARE_ROWS = 2000
BUCKET_MILES = 1.0


def _buckets(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(F.floor((lo - TOLERANCE) / BUCKET_MILES), F.floor((hi + TOLERANCE) / BUCKET_MILES)))


def segment_edges(segments: DataFrame) -> DataFrame:
    """Each straight piece of each segment's line: ends, planar length before it and of the whole line."""
    x = segments.select("corridor_id", "seq", "pm_start", "pm_end", F.posexplode("geometry").alias("edge", "p"), F.size("geometry").alias("_n"))
    w = Window.partitionBy("corridor_id", "seq").orderBy("edge")
    x = x.withColumn("q", F.lead("p").over(w)).where("q IS NOT NULL")
    planar = F.sqrt(F.pow(F.col("q.lon") - F.col("p.lon"), 2) + F.pow(F.col("q.lat") - F.col("p.lat"), 2))
    x = x.withColumn("len", planar)
    return x.withColumn("before", F.sum("len").over(w) - F.col("len")).withColumn("total", F.sum("len").over(Window.partitionBy("corridor_id", "seq")))


def _squares(x0: Column, x1: Column, y0: Column, y1: Column, size: float) -> Column:
    """One row a square of the grid of ``size`` degrees that the box touches, as ``sq``."""
    side = lambda lo, hi: F.sequence(F.floor(lo / size), F.floor(hi / size))
    return F.explode(F.flatten(F.transform(side(x0, x1), lambda a: F.transform(side(y0, y1), lambda b: F.struct(a.alias("x"), b.alias("y")))))).alias("sq")


def _degrees(metres: float) -> float:
    """Degrees of latitude, a little more than the metres are."""
    return metres / METRES_PER_DEGREE * 1.000001


def _lon_margin(metres: float, lat: Column) -> Column:
    """Degrees of longitude that the metres may make up at a latitude; all round where that is near a pole."""
    far = F.abs(lat) + _degrees(metres)
    return F.when(far < 89, _degrees(metres) / F.cos(F.radians(far))).otherwise(F.lit(360.0))


def _meet(points: DataFrame, x: str, y: str, shapes: DataFrame, box: list[Column], keys: list[str], size: float, least: float) -> DataFrame:
    """``points`` joined with those ``shapes`` whose ``box`` (of the shape's columns) holds the point's square.

    Squares form a quadtree by counts: those of ``size`` degrees that more than ``SQUARE_ROWS`` shapes reach are cut into four,
    and so on down to ``least``, so that a dense place is many keys and an empty land few. A point is in one square, so it
    meets a shape once; only squares that are cut are looked at again.
    """
    met = []
    while True:
        own = points.withColumn("sq", F.struct(F.floor(F.col(x) / size).alias("x"), F.floor(F.col(y) / size).alias("y")))
        reach = shapes.select("*", _squares(*box, size))
        if size / 2 < least:
            break
        full = written(reach.groupBy(*keys, "sq").agg(F.count("*").alias("_reach")).where(F.col("_reach") > SQUARE_ROWS), "full-squares").drop("_reach")
        if full.isEmpty():
            break
        met.append(own.join(full, [*keys, "sq"], "left_anti").join(reach, [*keys, "sq"]))
        points = written(own.join(full, [*keys, "sq"], "left_semi").drop("sq"), "crowded-points")
        if points.isEmpty():
            return reduce(DataFrame.unionByName, met)
        shapes = written(shapes.withColumn("_id", F.monotonically_increasing_id()).select("*", _squares(*box, size)).join(full, [*keys, "sq"], "left_semi").drop("sq").dropDuplicates(["_id"]).drop("_id"), "crowded-shapes")
        size /= 2
    return reduce(DataFrame.unionByName, [*met, own.join(reach, [*keys, "sq"])])


def project_to_corridor(stations: DataFrame, segments: DataFrame, max_m: float = 100.0, keep_off: bool = False) -> DataFrame:
    """Stations with the nearest point of the corridor: (…, seq, distance_m, pm, on_corridor); first segment of equals.

    A station meets only edges in its own square, where edges lie with a margin of ``max_m``; crowded squares are cut up. With
    ``keep_off`` the stations farther away are looked up again with eight times the margin, until all are placed.
    """
    e = written(segment_edges(segments), "edges")
    own = stations.select("corridor_id", "station_id", "longitude", "latitude")
    near, margin, left = [], max_m, own
    while True:
        found = _nearest_feet(left, e, margin)
        if not keep_off:
            near.append(found)
            break
        found = written(found, "feet")
        near.append(found)
        if margin > HALF_EARTH_M:
            break
        left = written(left.join(found, ["corridor_id", "station_id"], "left_anti"), "off")
        if left.isEmpty():
            break
        margin *= 8
    out = stations.join(reduce(DataFrame.unionByName, near).withColumn("on_corridor", F.col("distance_m") <= max_m), ["corridor_id", "station_id"])
    return out if keep_off else out.where("on_corridor")


def _nearest_feet(stations: DataFrame, e: DataFrame, margin: float) -> DataFrame:
    """(corridor_id, station_id, distance_m, seq, pm) of stations with an edge within the margin."""
    size = max(_degrees(margin), LEAST_SQUARE)
    wide = F.greatest(_lon_margin(margin, F.col("p.lat")), _lon_margin(margin, F.col("q.lat")))
    box = [F.least("p.lon", "q.lon") - wide, F.greatest("p.lon", "q.lon") + wide, F.least("p.lat", "q.lat") - _degrees(margin), F.greatest("p.lat", "q.lat") + _degrees(margin)]
    box = [F.greatest(F.least(x, F.lit(top)), F.lit(-top)) for x, top in zip(box, (540.0, 540.0, 90.0, 90.0), strict=True)]
    x = _meet(stations, "longitude", "latitude", e, box, ["corridor_id"], size, 2 * _degrees(margin))
    dx, dy = F.col("q.lon") - F.col("p.lon"), F.col("q.lat") - F.col("p.lat")
    t = F.try_divide((F.col("longitude") - F.col("p.lon")) * dx + (F.col("latitude") - F.col("p.lat")) * dy, dx * dx + dy * dy)
    x = x.withColumn("t", F.least(F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    foot_lon, foot_lat = F.col("p.lon") + F.col("t") * dx, F.col("p.lat") + F.col("t") * dy
    x = x.withColumn("distance_m", haversine_m("latitude", "longitude", foot_lat, foot_lon))
    pm = F.col("pm_start") + F.coalesce(F.try_divide(F.col("before") + F.col("t") * F.col("len"), F.col("total")), F.lit(0.0)) * (F.col("pm_end") - F.col("pm_start"))
    best = F.min(F.struct("distance_m", "seq", "edge", pm.alias("pm"))).alias("b")
    near = x.where(F.lit(margin > HALF_EARTH_M) | (F.col("distance_m") <= margin)).groupBy("corridor_id", "station_id").agg(best)
    return near.select("corridor_id", "station_id", "b.distance_m", "b.seq", "b.pm")


def _most_in_square(markers: DataFrame, size: float) -> int | None:
    square = markers.groupBy("route", F.floor(F.col("longitude") / size), F.floor(F.col("latitude") / size)).agg(F.count("*").alias("n"))
    return square.agg(F.max("n")).first()[0]


def annotate_postmiles(nodes: DataFrame, markers: DataFrame) -> DataFrame:
    """(node_id, pm): the postmile of the nearest marker, plus the distance to it, or less it, by the side it lies on.

    A node east or north of its marker (bearing 0 to 180) counts up. A node meets the markers of its route in the squares
    about its own; those that have none within a square's side are looked up again in squares eight times as wide, until
    all are placed. Where markers crowd, the first squares are as much smaller as leaves ``SQUARE_ROWS`` markers in each.
    Nearest is by degrees, as the roads are short. A place is looked up once, however many nodes share it, and of the
    markers at one place only that of the least postmile is met, as equals are decided by that.
    """
    nodes = nodes.select("node_id", "x", "y", "route")
    markers = written(markers.groupBy("route", "longitude", "latitude").agg(F.min(F.struct("pm"))["pm"].alias("pm")), "markers")
    left, size, found = written(nodes.select("x", "y", "route").distinct(), "places"), LEAST_SQUARE, []
    while size > LEAST_SQUARE / 8**3 and (_most_in_square(markers, size) or 0) > SQUARE_ROWS:
        size /= 8
    while True:
        all_of_it = size >= 720
        around = [F.col("longitude") - size, F.col("longitude") + size, F.col("latitude") - size, F.col("latitude") + size]
        at = left.withColumn("sq", F.struct(F.floor(F.col("x") / size).alias("x"), F.floor(F.col("y") / size).alias("y")))
        d = F.pow(F.col("longitude") - F.col("x"), 2) + F.pow(F.col("latitude") - F.col("y"), 2)
        met = at.join(markers.select("route", "pm", "longitude", "latitude", _squares(*around, size)), ["route", "sq"]).withColumn("d", d)
        best = F.min(F.struct("d", "pm", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))).alias("b")
        found.append(written(met.where(F.lit(all_of_it) | (F.col("d") <= size * size)).groupBy("x", "y", "route").agg(best), "nearest"))
        if all_of_it:
            break
        left = written(left.join(found[-1].drop("b"), ["x", "y", "route"], "left_anti"), "unplaced")
        if left.isEmpty():
            break
        size *= 8
    placed = nodes.join(reduce(DataFrame.unionByName, found), ["x", "y", "route"])
    near = placed.groupBy("node_id", "x", "y").agg(F.min("b").alias("b"))
    miles = haversine_m("b.lat", "b.lon", "y", "x") / METRES_PER_MILE
    ahead = bearing("b.lat", "b.lon", "y", "x") <= 180
    return near.select("node_id", (F.col("b.pm") + F.when(ahead, miles).otherwise(-miles)).alias("pm"))


def _containing(points: DataFrame, key: str, pm: str, segments: DataFrame) -> DataFrame:
    """The first segment whose postmiles contain the point, by an equi-join on mile buckets and a check of the range."""
    s = segments.select("corridor_id", F.col("seq").alias("_seq"), F.struct(*[c for c in segments.columns if c not in ("corridor_id", "geometry")]).alias("_s"), _buckets(F.col("pm_start"), F.col("pm_end")).alias("_b"))
    x = points.select("corridor_id", key, F.col(pm).alias("_pm"), F.floor(F.col(pm) / BUCKET_MILES).alias("_b")).join(s, ["corridor_id", "_b"])
    ok = (F.col("_pm") >= F.col("_s.pm_start") - TOLERANCE) & (F.col("_pm") <= F.col("_s.pm_end") + TOLERANCE)
    return x.where(ok).groupBy("corridor_id", key).agg(F.min_by("_s", "_seq").alias("_s"))


def interpolate_postmile(points: DataFrame, segments: DataFrame) -> DataFrame:
    """(corridor_id, point_id, node_pos): a segment's number plus the part of it before the point; clamped at the ends."""
    ends = segments.groupBy("corridor_id").agg(F.min("pm_start").alias("_lo"), F.max("pm_end").alias("_hi"), F.min("seq").alias("_first"), F.max("seq").alias("_last"))
    hit = _containing(points, "point_id", "pm", segments)
    part = F.try_divide(F.col("pm") - F.col("_s.pm_start"), F.col("_s.pm_end") - F.col("_s.pm_start"))
    inside = F.col("_s.seq") + F.least(F.greatest(F.coalesce(part, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    x = points.join(hit, ["corridor_id", "point_id"], "left").join(ends, "corridor_id")
    pos = F.when(F.col("_s").isNotNull(), inside).when(F.col("pm") < F.col("_lo"), F.col("_first").cast("double")).when(F.col("pm") > F.col("_hi"), F.col("_last") + 1.0)
    return x.select("corridor_id", "point_id", pos.alias("node_pos"))


def lanes_at(cells: DataFrame, segments: DataFrame) -> DataFrame:
    """(corridor_id, cell, lanes): those of the segment at the cell's middle, else of the segment nearest to it."""
    mid = cells.withColumn("_mid", (F.col("pm_start") + F.col("pm_end")) / 2)
    hit = _containing(mid, "cell", "_mid", segments).select("corridor_id", "cell", F.col("_s.lanes").alias("_lanes"))
    ends = segments.groupBy("corridor_id").agg(F.min_by("lanes", "pm_start").alias("_l0"), F.max_by("lanes", "pm_end").alias("_l1"), F.min("pm_start").alias("_lo"))
    x = mid.join(hit, ["corridor_id", "cell"], "left").join(ends, "corridor_id")
    return x.select("corridor_id", "cell", F.coalesce("_lanes", F.when(F.col("_mid") < F.col("_lo"), F.col("_l0")).otherwise(F.col("_l1"))).alias("lanes"))


def tiebreak(name: str, mid: Column) -> list[Column]:
    """Sort keys of a tie-break among a cell's stations; the station id decides what they leave open."""
    keys = {
        "midpoint": [F.abs(F.col("pm") - mid)], "furthest_downstream": [F.desc("pm")],
        "highest_pm_observed": [F.desc("pm_observed")], "lowest_id": [],
    }
    return [*keys[name], F.col("station_id")]


def assign_stations(cells: DataFrame, stations: DataFrame, tie: str = "midpoint", prefer_lanes: bool = False) -> DataFrame:
    """Cells with vds_id, vds_pm, vds_source (direct, direct_tiebreak, missing) and vds_n_candidates.

    A station belongs to the cell with pm in (pm_start, pm_end], the corridor's first cell closed at its start. With
    ``prefer_lanes`` stations of as many lanes as the cell go first, if there are any; candidates are counted before
    that, ties after it.
    """
    first = F.col("cell") == F.min("cell").over(Window.partitionBy("corridor_id"))
    c = cells.withColumn("_closed", first)
    c = c.withColumn("_b", _buckets(F.col("pm_start"), F.col("pm_end")))
    s = stations.select("corridor_id", "station_id", "pm", F.col("lanes").alias("_lanes"), *([F.col("pm_observed")] if "pm_observed" in stations.columns else []), F.floor(F.col("pm") / BUCKET_MILES).alias("_b"))
    low = F.when(F.col("_closed"), F.col("pm") >= F.col("pm_start") - TOLERANCE).otherwise(F.col("pm") > F.col("pm_start") + TOLERANCE)
    x = c.join(s, ["corridor_id", "_b"]).where(low & (F.col("pm") <= F.col("pm_end") + TOLERANCE))
    cell = Window.partitionBy("corridor_id", "cell")
    x = x.withColumn("vds_n_candidates", F.count("*").over(cell))
    if prefer_lanes:
        match = F.col("_lanes") == F.col("lanes")
        x = x.withColumn("_any", F.max(match).over(cell)).where(match | ~F.col("_any"))
    mid = (F.col("pm_start") + F.col("pm_end")) / 2
    x = x.withColumn("_left", F.count("*").over(cell)).withColumn("_rn", F.row_number().over(cell.orderBy(*tiebreak(tie, mid)))).where("_rn = 1")
    got = x.select("corridor_id", "cell", F.col("station_id").alias("vds_id"), F.col("pm").alias("vds_pm"), F.col("_lanes").alias("vds_lanes"), F.when(F.col("_left") > 1, "direct_tiebreak").otherwise("direct").alias("vds_source"), "vds_n_candidates")
    return cells.join(got, ["corridor_id", "cell"], "left").withColumn("vds_source", F.coalesce("vds_source", F.lit("missing"))).withColumn("vds_n_candidates", F.coalesce("vds_n_candidates", F.lit(0)))


def inherit_upstream(cells: DataFrame) -> DataFrame:
    """Cells without a station take the last one upstream; vds_distance_mi is its postmile less the cell's middle."""
    w = Window.partitionBy("corridor_id").orderBy("cell")
    last = F.last(F.when(F.col("vds_id").isNotNull(), F.struct("vds_id", "vds_pm")), ignorenulls=True).over(w)
    x = cells.withColumn("_up", last)
    taken = F.col("vds_id").isNull() & F.col("_up").isNotNull()
    mid = (F.col("pm_start") + F.col("pm_end")) / 2
    return x.withColumn("vds_source", F.when(taken, "upstream").otherwise(F.col("vds_source"))).withColumn("vds_distance_mi", F.when(taken, F.col("_up.vds_pm") - mid)).withColumn("vds_id", F.coalesce("vds_id", "_up.vds_id")).drop("_up")


def assign_ramp_stations(cells: DataFrame, junctions: DataFrame, stations: DataFrame, max_m: float = 200.0) -> DataFrame:
    """(corridor_id, cell, kind, station_id): the ramp station nearest to each ramp, by kind (on: OR, off: FR), matched
    to the cell that begins (on) or ends (off) at the ramp's postmile, to six places; of ramps at one postmile the last.
    A ramp meets the stations of its kind in the squares within ``max_m`` of it; crowded squares are cut up."""
    want = F.when(F.col("kind") == "on", "OR").otherwise("FR")
    s = stations.select("corridor_id", "station_id", F.col("type").alias("_type"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    size, wide = max(_degrees(max_m), LEAST_SQUARE), _lon_margin(max_m, F.col("lat"))
    box = [F.col("lon") - wide, F.col("lon") + wide, F.col("lat") - _degrees(max_m), F.col("lat") + _degrees(max_m)]
    met = _meet(s, "_lon", "_lat", junctions.withColumn("_type", want), box, ["corridor_id", "_type"], size, 2 * _degrees(max_m))
    x = met.withColumn("_d", haversine_m("lat", "lon", "_lat", "_lon")).where(F.col("_d") <= max_m)
    near = x.groupBy("corridor_id", "junction_id", "kind", "postmile").agg(F.min_by("station_id", F.struct("_d", "station_id")).alias("station_id"))
    near = near.groupBy("corridor_id", "kind", F.round("postmile", 6).alias("_pm")).agg(F.max_by("station_id", "junction_id").alias("station_id"))
    at = cells.select("corridor_id", "cell", F.explode(F.array(F.struct(F.lit("on").alias("kind"), F.round("pm_start", 6).alias("_pm")), F.struct(F.lit("off").alias("kind"), F.round("pm_end", 6).alias("_pm")))).alias("k"))
    return at.select("corridor_id", "cell", "k.kind", "k._pm").join(near, ["corridor_id", "kind", "_pm"]).select("corridor_id", "cell", "kind", "station_id")


def mainline_edges(edges: DataFrame, nodes: DataFrame, ref: str, heading: str, tolerance: float = 60.0) -> DataFrame:
    """Motorway edges of a route whose bearing is near the heading."""
    a = nodes.select(F.col("node_id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    own = edges.where(F.array_contains(parse_tags("highway"), "motorway") & F.array_contains(parse_tags("ref"), ref))
    x = own.join(a, "u").join(b, "v").withColumn("bearing", bearing("uy", "ux", "vy", "vx"))
    return x.where(bearing_close("bearing", heading, tolerance)).select(*edges.columns, "bearing")


def ramp_junctions(edges: DataFrame, mainline_nodes: DataFrame) -> DataFrame:
    """(u, v, kind, node, name, lanes): link edges with exactly one end on the main line; an end there is an on-ramp."""
    on = mainline_nodes.select("node_id", F.lit(True).alias("_on"))
    links = edges.where(F.exists(parse_tags("highway"), lambda t: t.endswith("_link")))
    x = links.join(on.select(F.col("node_id").alias("u"), F.col("_on").alias("_u")), "u", "left").join(on.select(F.col("node_id").alias("v"), F.col("_on").alias("_v")), "v", "left")
    u, v = F.coalesce("_u", F.lit(False)), F.coalesce("_v", F.lit(False))
    lanes = parse_lanes("lanes")
    return x.where(u != v).select(
        "u", "v", F.when(v, "on").otherwise("off").alias("kind"), F.when(v, F.col("v")).otherwise(F.col("u")).alias("node"),
        F.coalesce("name", F.try_element_at(parse_tags("ref"), F.lit(1))).alias("name"), F.when(lanes > 0, lanes).otherwise(1).alias("lanes"),
    )


def cell_lines(cells: DataFrame, segments: DataFrame) -> DataFrame:
    """(corridor_id, cell, line): the corridor's points between the cell's postmiles, its cut ends included, in order.

    A cell meets the edges it overlaps by planar part of their segment; a cell of no length has one point.
    """
    e = segment_edges(segments)
    span = F.col("pm_end") - F.col("pm_start")
    e = e.withColumn("e0", F.col("pm_start") + F.try_divide(F.col("before"), F.col("total")) * span).withColumn("e1", F.col("pm_start") + F.try_divide(F.col("before") + F.col("len"), F.col("total")) * span)
    e = e.select("corridor_id", "seq", "edge", "p", "q", "e0", "e1", _buckets(F.col("e0"), F.col("e1")).alias("_b"))
    c = cells.select("corridor_id", "cell", F.col("pm_start").alias("c0"), F.col("pm_end").alias("c1"), _buckets(F.col("pm_start"), F.col("pm_end")).alias("_b"))
    x = c.join(e, ["corridor_id", "_b"]).where((F.col("e0") <= F.col("c1")) & (F.col("e1") >= F.col("c0"))).dropDuplicates(["corridor_id", "cell", "seq", "edge"])

    def at(pm: Column) -> Column:
        f = F.least(F.greatest(F.coalesce(F.try_divide(pm - F.col("e0"), F.col("e1") - F.col("e0")), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return F.struct((F.col("p.lon") + f * (F.col("q.lon") - F.col("p.lon"))).alias("lon"), (F.col("p.lat") + f * (F.col("q.lat") - F.col("p.lat"))).alias("lat"))

    both = F.explode(F.array(F.struct(F.lit(0).alias("k"), at(F.greatest("c0", "e0")).alias("pt")), F.struct(F.lit(1).alias("k"), at(F.least("c1", "e1")).alias("pt"))))
    pts = x.select("corridor_id", "cell", "seq", "edge", both.alias("r")).groupBy("corridor_id", "cell").agg(F.array_sort(F.collect_list(F.struct("seq", "edge", "r.k", "r.pt"))).alias("a"))
    # a cell's points: bounded by its length
    line = F.transform("a", lambda s: s["pt"])
    fresh = F.filter(line, lambda p, i: (i == 0) | (p != F.element_at(line, F.greatest(i, F.lit(1)))))
    return pts.select("corridor_id", "cell", fresh.alias("line"))


def cumulative_postmile(segments: DataFrame) -> DataFrame:
    """pm_start and pm_end of segments by running length (metres) along their order, in miles."""
    w = Window.partitionBy("corridor_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    miles = F.col("length_m") / METRES_PER_MILE
    return segments.withColumn("pm_end", F.sum(miles).over(w)).withColumn("pm_start", F.col("pm_end") - miles)


def line_length_m(geometry: str = "geometry") -> Column:
    """Great-circle length of a line, where no length tag tells it."""
    pairs = F.zip_with(F.slice(geometry, 1, F.size(geometry) - 1), F.slice(geometry, 2, F.size(geometry) - 1), lambda p, q: haversine_m(p["lat"], p["lon"], q["lat"], q["lon"]))
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)


def lane_changes(segments: DataFrame) -> DataFrame:
    w = Window.partitionBy("corridor_id").orderBy("seq")
    return segments.withColumn("_was", F.lag("lanes").over(w)).where("lanes <> _was").select("corridor_id", F.col("pm_start").alias("pm"))


def cell_breaks(segments: DataFrame, junctions: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(corridor_id, pm): ends, ramps, lane changes and extra breaks inside the span, to six places, once each."""
    span = segments.groupBy("corridor_id").agg(F.min("pm_start").alias("lo"), F.max("pm_end").alias("hi"))
    ends = span.select("corridor_id", F.explode(F.array("lo", "hi")).alias("pm"))
    pts = ends.unionByName(lane_changes(segments)).unionByName(junctions.select("corridor_id", F.col("postmile").alias("pm")))
    pts = pts if extra is None else pts.unionByName(extra.select("corridor_id", "pm"))
    inside = F.col("pm").between(F.col("lo") - TOLERANCE, F.col("hi") + TOLERANCE)
    return pts.join(span, "corridor_id").where(inside).select("corridor_id", F.round("pm", 6).alias("pm")).distinct()


def cells_from_breaks(breaks: DataFrame, junctions: DataFrame, segments: DataFrame) -> DataFrame:
    """Cells between consecutive breaks: an on-ramp at the start, an off-ramp at the end, lanes at the middle."""
    w = Window.partitionBy("corridor_id").orderBy("pm")
    c = breaks.withColumn("pm_end", F.lead("pm").over(w)).where("pm_end IS NOT NULL").select("corridor_id", (F.row_number().over(w) - 1).alias("cell"), F.col("pm").alias("pm_start"), "pm_end", (F.col("pm_end") - F.col("pm")).alias("length"))
    at = lambda kind, col: junctions.where(F.col("kind") == kind).groupBy("corridor_id", F.round("postmile", 6).alias(col)).agg(F.max_by("name", "junction_id").alias(f"{kind}_ramp_name"), F.lit(True).alias(f"{kind}_ramp"))
    c = c.join(at("on", "pm_start"), ["corridor_id", "pm_start"], "left").join(at("off", "pm_end"), ["corridor_id", "pm_end"], "left")
    c = c.withColumns({f"{k}_ramp": F.coalesce(f"{k}_ramp", F.lit(False)) for k in ("on", "off")})
    return c.join(lanes_at(c, segments), ["corridor_id", "cell"])


def crop_corridor(segments: DataFrame, junctions: DataFrame, lo: float, hi: float) -> tuple[DataFrame, DataFrame]:
    """Whole segments, and ramps, inside a range of postmiles; postmiles keep their zero."""
    return segments.where((F.col("pm_start") >= lo) & (F.col("pm_end") <= hi)), junctions.where(F.col("postmile").between(lo, hi))


def summarize_refs(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = ("motorway",)) -> DataFrame:
    """(ref, n_edges, length_mi, names, west, south, east, north): longest first by ``length_mi``; names are the three
    commonest, equals by alphabet, joined."""
    keep = F.exists(parse_tags("highway"), lambda t: t.isin(*kinds))
    x = edges.where(keep).withColumn("ref", F.explode(parse_tags("ref")))
    n = nodes.select("node_id", "x", "y")
    x = x.join(n.select(F.col("node_id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy")), "u").join(n.select(F.col("node_id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy")), "v")
    tot = x.groupBy("ref").agg(
        F.count("*").alias("n_edges"), (F.sum("length_m") / METRES_PER_MILE).alias("length_mi"), F.min(F.least("ux", "vx")).alias("west"),
        F.min(F.least("uy", "vy")).alias("south"), F.max(F.greatest("ux", "vx")).alias("east"), F.max(F.greatest("uy", "vy")).alias("north"),
    )
    names = x.where("name IS NOT NULL").groupBy("ref", "name").agg(F.count("*").alias("c"))
    top = names.withColumn("rn", F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("c"), "name"))).where("rn <= 3")
    said = top.groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda s: s["name"]), ", ").alias("names"))
    return tot.join(said, "ref", "left")


def top_refs(refs: DataFrame, n: int) -> DataFrame:
    return refs.orderBy(F.desc("length_mi"), "ref").limit(n)


def corridor_summary(segments: DataFrame, junctions: DataFrame, cells: DataFrame) -> DataFrame:
    """(item, value): counts and lengths of a corridor's segments, ramps and cells, and cells by lanes, warning and source."""
    one = lambda df, *aggs: df.agg(*aggs)
    a = one(segments, F.count("*").alias("n_segments"), F.sum(F.col("pm_end") - F.col("pm_start")).alias("total_mi"))
    b = one(junctions, F.count_if(F.col("kind") == "on").alias("n_on_ramps"), F.count_if(F.col("kind") == "off").alias("n_off_ramps"))
    d = one(cells, F.count("*").alias("n_cells"), F.avg("length").alias("mean_cell_mi"), F.min("length").alias("min_cell_mi"), F.max("length").alias("max_cell_mi"))
    lanes = one(lane_changes(segments), F.count("*").alias("n_lane_changes"))
    row = a.crossJoin(b).crossJoin(d).crossJoin(lanes)  # one row each
    flat = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).cast("double").alias("value")) for n in row.columns])).alias("r")).select("r.*")
    for col in ("lanes", "length_warning", "vds_source"):
        flat = flat.unionByName(cells.groupBy(F.concat(F.lit(f"{col}="), F.col(col).cast("string")).alias("item")).agg(F.count("*").cast("double").alias("value")))
    return flat
