"""Queries of geodesy, spatial joins and polylines (G, P, J3, J15, J16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightgraph.functions import geo
from freightgraph.operators import network, quality, spatial
from freightgraph.plans.tables import ORACLE_VIEWS, Tables, km_sql, query

ORACLE_VIEWS |= {
    "o_segment": """SELECT * FROM (SELECT edge_id, mode, pos, lon, lat, LEAD(lon) OVER w AS lon2, LEAD(lat) OVER w AS lat2, ROW_NUMBER() OVER w - 1 AS seg
FROM f_edge_point WINDOW w AS (PARTITION BY edge_id ORDER BY pos)) WHERE lon2 IS NOT NULL""",
    "o_km": f"SELECT edge_id, SUM({km_sql('lat', 'lon', 'lat2', 'lon2')}) AS km FROM o_segment GROUP BY edge_id",
    "o_cut": f"SELECT *, {km_sql('lat', 'lon', 'lat2', 'lon2')} AS seg_km, ln(tan(pi() / 4 + radians(lat) / 2)) AS y1, ln(tan(pi() / 4 + radians(lat2) / 2)) AS y2 FROM o_segment",
    "o_sample": """SELECT edge_id, mode, seg, s, lon + (lon2 - lon) * f AS lon, degrees(2 * atan(exp(y1 + (y2 - y1) * f)) - pi() / 2) AS lat, seg_km / n AS step_km
FROM (SELECT *, (s + 0.5e0) / n AS f FROM (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS s FROM (SELECT *, greatest(1, ceil(seg_km / 20)) AS n FROM o_cut)))""",
    "o_box": """SELECT zone_id, lat, lon, radius_km, lon - d / greatest(cos(radians(lat)), 0.05) AS min_lon, lat - d AS min_lat, lon + d / greatest(cos(radians(lat)), 0.05) AS max_lon, lat + d AS max_lat
FROM (SELECT *, radius_km / 111.32 AS d FROM f_zone)""",
    "o_side": """SELECT zone_id, lon AS lon1, lat AS lat1, coalesce(LEAD(lon) OVER w, first_value(lon) OVER w) AS lon2, coalesce(LEAD(lat) OVER w, first_value(lat) OVER w) AS lat2
FROM f_zone_vertex WINDOW w AS (PARTITION BY zone_id ORDER BY pos)""",
}
RING_HIT = "((lat1 > p.lat) <> (lat2 > p.lat)) AND p.lon < lon1 + (lon2 - lon1) * (p.lat - lat1) / nullif(lat2 - lat1, 0)"
CELL_HIT = "(max_lon - min_lon > 180 OR floor(p.lon / 10) BETWEEN floor(min_lon / 10) AND floor(max_lon / 10)) AND floor(p.lat / 10) BETWEEN floor(min_lat / 10) AND floor(max_lat / 10)"


def zones_at_sql(points: str, key: str) -> str:
    return f"""SELECT p.{key}, z.zone_id FROM {points} p JOIN o_box z ON {km_sql('p.lat', 'p.lon', 'z.lat', 'z.lon')} <= z.radius_km AND {CELL_HIT}
UNION SELECT p.{key}, zone_id FROM {points} p JOIN o_side s ON {RING_HIT} GROUP BY p.{key}, zone_id HAVING count(*) % 2 = 1"""


PAIR = "f_edge e JOIN f_node a ON a.node_id = e.src JOIN f_node b ON b.node_id = e.dst"


def _pairs(t: Tables) -> DataFrame:
    at = lambda p: t.f_node.select(F.col("node_id").alias(p), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    return t.f_edge.join(at("src"), "src").join(at("dst"), "dst")


@query(f"SELECT edge_id, round({km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS km FROM {PAIR}")
def g1_haversine_km(t: Tables) -> DataFrame:
    return _pairs(t).select("edge_id", F.round(geo.haversine_km("src_lat", "src_lon", "dst_lat", "dst_lon"), 3).alias("km"))


@query("""SELECT node_id, round((lon2 + 180) - 360 * floor((lon2 + 180) / 360) - 180, 3) AS lon, round(degrees(p2), 3) AS lat FROM (SELECT node_id,
  degrees(radians(lon) + atan2(sin(b) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * sin(p2))) AS lon2, p2
  FROM (SELECT *, asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(b)) AS p2 FROM
    (SELECT node_id, lat, lon, radians(node_id * 37 % 360) AS b, (100 + node_id % 900) / 6371.0e0 AS d FROM f_node)))""")
def g2_destination_point(t: Tables) -> DataFrame:
    p = geo.destination_point("lat", "lon", F.col("node_id") * 37 % 360, 100 + F.col("node_id") % 900)
    return t.f_node.select("node_id", p.alias("p")).select("node_id", F.round("p.lon", 3).alias("lon"), F.round("p.lat", 3).alias("lat"))


@query(f"""SELECT edge_id, round(lon1 + (lon2 - lon1) * 0.25, 3) AS lon, round(degrees(2 * atan(exp(y1 + (y2 - y1) * 0.25)) - pi() / 2), 3) AS lat FROM
  (SELECT edge_id, a.lon AS lon1, b.lon AS lon2, ln(tan(pi() / 4 + radians(a.lat) / 2)) AS y1, ln(tan(pi() / 4 + radians(b.lat) / 2)) AS y2 FROM {PAIR})""")
def g3_mercator_point(t: Tables) -> DataFrame:
    p = geo.mercator_point("src_lat", "src_lon", "dst_lat", "dst_lon", 0.25)
    return _pairs(t).select("edge_id", p.alias("p")).select("edge_id", F.round("p.lon", 3).alias("lon"), F.round("p.lat", 3).alias("lat"))


@query(f"""SELECT edge_id, round(degrees(atan2(y, x)), 3) + 0.0e0 AS lon, round(degrees(atan2(z, sqrt(x * x + y * y))), 3) + 0.0e0 AS lat FROM (SELECT edge_id,
  wa * cos(la1) * cos(lo1) + wb * cos(la2) * cos(lo2) AS x, wa * cos(la1) * sin(lo1) + wb * cos(la2) * sin(lo2) AS y, wa * sin(la1) + wb * sin(la2) AS z FROM
  (SELECT *, sin(0.7 * d) / sin(d) AS wa, sin(0.3 * d) / sin(d) AS wb FROM (SELECT edge_id, radians(a.lat) AS la1, radians(a.lon) AS lo1, radians(b.lat) AS la2, radians(b.lon) AS lo2,
    {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 6371.0e0 AS d FROM {PAIR})))""")
def g4_great_circle_point(t: Tables) -> DataFrame:
    p = geo.great_circle_point("src_lat", "src_lon", "dst_lat", "dst_lon", 0.3)
    return _pairs(t).select("edge_id", p.alias("p")).select("edge_id", F.round("p.lon", 3).alias("lon"), F.round("p.lat", 3).alias("lat"))


@query(f"SELECT p.point_id, z.zone_id FROM x_point p JOIN f_zone z ON {km_sql('p.lat', 'p.lon', 'z.lat', 'z.lon')} <= z.radius_km")
def g5_point_in_circle(t: Tables) -> DataFrame:
    return spatial.point_in_circle(t.x_point, t.f_zone)


@query(f"SELECT point_id, zone_id FROM x_point p JOIN o_side s ON {RING_HIT} GROUP BY point_id, zone_id HAVING count(*) % 2 = 1")
def g6_point_in_ring(t: Tables) -> DataFrame:
    return spatial.point_in_ring(t.x_point, t.f_zone_vertex)


@query(f"""WITH s AS (SELECT shape_id, ring_no, lon AS lon1, lat AS lat1, coalesce(LEAD(lon) OVER w, first_value(lon) OVER w) AS lon2, coalesce(LEAD(lat) OVER w, first_value(lat) OVER w) AS lat2
    FROM x_ring WINDOW w AS (PARTITION BY shape_id, ring_no ORDER BY pos)),
  h AS (SELECT point_id, shape_id, ring_no FROM x_point p JOIN s ON {RING_HIT} GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT point_id, shape_id FROM h GROUP BY ALL HAVING max(ring_no) = 0""".replace("WITH s AS", "SELECT * FROM (WITH s AS") + ")")
def g7_point_in_polygon_with_holes(t: Tables) -> DataFrame:
    return spatial.point_in_polygon_with_holes(t.x_point, t.x_ring)


@query("""SELECT zone_id, round(min_lon, 3) AS min_lon, round(min_lat, 3) AS min_lat, round(max_lon, 3) AS max_lon, round(max_lat, 3) AS max_lat FROM o_box
UNION ALL SELECT zone_id, round(min(lon), 3), round(min(lat), 3), round(max(lon), 3), round(max(lat), 3) FROM f_zone_vertex GROUP BY zone_id""")
def g8_zone_bbox(t: Tables) -> DataFrame:
    box = spatial.zone_bbox(t.f_zone, t.f_zone_vertex)
    return box.select("zone_id", *[F.round(c, 3).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


@query("""SELECT zone_id, cx, unnest(range(CAST(floor(min_lat / 10) AS BIGINT), CAST(floor(max_lat / 10) AS BIGINT) + 1)) AS cy FROM (SELECT *, unnest(range(
  CAST(CASE WHEN max_lon - min_lon > 180 THEN -18 ELSE floor(min_lon / 10) END AS BIGINT), CAST(CASE WHEN max_lon - min_lon > 180 THEN 18 ELSE floor(max_lon / 10) END AS BIGINT) + 1)) AS cx FROM o_box)""")
def g9_zone_grid_cells(t: Tables) -> DataFrame:
    return spatial.zone_grid_cells(t.f_zone.select("zone_id", *geo.circle_box("lat", "lon", "radius_km")))


@query("""SELECT point_id, CAST(floor((lon + 180 - 360 * floor((lon + 180) / 360)) / 0.1) % 3600 AS INTEGER) AS x, CAST(least(1799, greatest(0, floor((lat + 90) / 0.1))) AS INTEGER) AS y FROM x_point""")
def g10_raster_cell(t: Tables) -> DataFrame:
    return t.x_point.select("point_id", geo.raster_cell("lon", "lat").alias("c")).select("point_id", "c.x", "c.y")


@query(zones_at_sql("x_point", "point_id"))
def j3_zones_at_points(t: Tables) -> DataFrame:
    return spatial.zones_at_points(t.x_point, t.f_zone, t.f_zone_vertex)


@query("SELECT edge_id, round(km, 3) AS km FROM o_km")
def p1_polyline_km(t: Tables) -> DataFrame:
    return spatial.polyline_km(t.f_edge_point).select("edge_id", F.round("km", 3).alias("km"))


@query("SELECT edge_id, seg, count(*) AS n, round(avg(lon), 3) AS lon, round(avg(lat), 3) AS lat, round(max(step_km), 3) AS step_km FROM o_sample GROUP BY edge_id, seg")
def p2_sample_polyline(t: Tables) -> DataFrame:
    s = spatial.sample_polyline(t.f_edge_point)
    return s.groupBy("edge_id", "seg").agg(F.count("*").alias("n"), *[F.round(f(c), 3).alias(c) for f, c in ((F.avg, "lon"), (F.avg, "lat"), (F.max, "step_km"))])


@query(f"""SELECT h.edge_id, h.zone_id, CAST(floor(sum(step_km) + 0.5) AS BIGINT) AS km FROM
  (SELECT p.edge_id, p.mode, p.step_km, z.zone_id FROM o_sample p JOIN o_box z ON {km_sql('p.lat', 'p.lon', 'z.lat', 'z.lon')} <= z.radius_km AND {CELL_HIT}
   UNION ALL SELECT p.edge_id, p.mode, p.step_km, zone_id FROM o_sample p JOIN o_side ON {RING_HIT} GROUP BY p.edge_id, p.mode, p.seg, p.s, p.step_km, zone_id HAVING count(*) % 2 = 1) h
WHERE h.zone_id NOT IN (SELECT zone_id FROM f_zone_mode) OR EXISTS (SELECT 1 FROM f_zone_mode m WHERE m.zone_id = h.zone_id AND m.mode = h.mode) GROUP BY h.edge_id, h.zone_id""")
def p3_tag_edges(t: Tables) -> DataFrame:
    return spatial.tag_edges(t.f_edge_point, t.f_zone, t.f_zone_vertex, t.f_zone_mode)


ORACLE_VIEWS["o_parts"] = """SELECT * FROM (WITH p AS (SELECT edge_id, CAST(pos AS DOUBLE) AS pos, (lon + 540) - 360 * floor((lon + 540) / 360) - 180 AS lon, lat FROM f_edge_point),
q AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, lag(pos) OVER w AS pos0 FROM p WINDOW w AS (PARTITION BY edge_id ORDER BY pos)),
c AS (SELECT *, coalesce(CAST(abs(lon - lon0) > 180 AS INTEGER), 0) AS cut, CASE WHEN lon0 > 0 THEN 180.0e0 ELSE -180.0e0 END AS side FROM q),
n AS (SELECT *, sum(cut) OVER (PARTITION BY edge_id ORDER BY pos) AS part FROM c),
x AS (SELECT edge_id, part, (pos0 + pos) / 2 AS pos, side, lat0 + (lat - lat0) * (side - lon0) / (lon + 2 * side - lon0) AS lat_at FROM n WHERE cut = 1)
SELECT edge_id, CAST(part AS BIGINT) AS part, pos, lon, lat FROM n UNION ALL SELECT edge_id, CAST(part - 1 AS BIGINT), pos, side, lat_at FROM x
UNION ALL SELECT edge_id, CAST(part AS BIGINT), pos, -side, lat_at FROM x)"""


@query("SELECT edge_id, part, pos, round(lon, 3) AS lon, round(lat, 3) AS lat FROM o_parts")
def p4_split_antimeridian(t: Tables) -> DataFrame:
    return spatial.split_antimeridian(t.f_edge_point).select("edge_id", "part", "pos", F.round("lon", 3).alias("lon"), F.round("lat", 3).alias("lat"))


def medium_samples(t: Tables) -> DataFrame:
    """Samples of legs, bad where outside every land rectangle."""
    s = spatial.sample_polyline(t.f_edge_point, 20).withColumn("point_id", F.struct("edge_id", "seg", "s"))
    land = spatial.point_in_ring(s, t.f_zone_vertex).select("point_id").distinct().withColumn("land", F.lit(True))
    return s.join(land, "point_id", "left").select("edge_id", "seg", "s", "lon", "lat", "step_km", F.col("land").isNull().alias("is_bad"))


RES = 1.0  # of the test rasters


def land(t: Tables) -> DataFrame:
    return network.rasterize(t.f_zone_vertex, RES)


def water(t: Tables) -> DataFrame:
    return network.water_cells(land(t), t.x_river, t.x_lake, RES)


def audited_samples(t: Tables) -> DataFrame:
    """Ends of 5 km steps along legs, and their first points, by their medium: bad off navigable water at sea, off land on rails and roads."""
    s = spatial.sample_polyline(t.f_edge_point, 5, midpoint=False, start=True)
    dry = s.where("mode in ('rail', 'truck')").withColumn("point_id", F.struct("edge_id", "seg", "s"))
    return quality.off_medium(s, spatial.point_in_ring(dry, t.f_zone_vertex).select("point_id.edge_id", "point_id.seg", "point_id.s"), water(t), RES)


def cell_sql(lon: str, lat: str) -> str:
    """x and y of the grid's cell of a point."""
    return f"CAST(floor((({lon}) + 180 - 360 * floor((({lon}) + 180) / 360)) / 1.0e0) % 360 AS INTEGER) AS x, CAST(least(179, greatest(0, floor((({lat}) + 90) / 1.0e0))) AS INTEGER) AS y"


TRACE = "unnest(range(0, CAST(greatest(1, ceil(greatest(abs(lon2 - lon1), abs(lat2 - lat1)) / 0.5e0)) AS BIGINT) + 1)) AS s, greatest(1, ceil(greatest(abs(lon2 - lon1), abs(lat2 - lat1)) / 0.5e0)) AS n"
ORACLE_VIEWS |= {
    "o_cell": "SELECT x, y, x + 0.5e0 - 180 AS lon, y + 0.5e0 - 90 AS lat FROM (SELECT unnest(range(0, 360)) AS x) CROSS JOIN (SELECT unnest(range(0, 180)) AS y)",
    "o_land": f"SELECT DISTINCT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (SELECT x, y, zone_id FROM o_cell p JOIN o_side ON {RING_HIT} GROUP BY ALL HAVING count(*) % 2 = 1)",
    "o_rim": """SELECT zone_id, lon AS lon1, lat AS lat1, coalesce(LEAD(lon) OVER w, first_value(lon) OVER w) AS lon2, coalesce(LEAD(lat) OVER w, first_value(lat) OVER w) AS lat2 FROM x_lake WINDOW w AS (PARTITION BY zone_id ORDER BY pos)""",
    "o_traced": f"""SELECT DISTINCT {cell_sql('lon1 + (lon2 - lon1) * s / n', 'lat1 + (lat2 - lat1) * s / n')} FROM (SELECT *, {TRACE} FROM
  (SELECT lon1, lat1, lon2, lat2 FROM o_rim UNION ALL SELECT * FROM (SELECT lon AS lon1, lat AS lat1, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM x_river WINDOW w AS (PARTITION BY line_id ORDER BY pos)) WHERE lon2 IS NOT NULL))""",
    "o_filled": f"SELECT DISTINCT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (SELECT x, y, zone_id FROM o_cell p JOIN o_rim ON {RING_HIT} GROUP BY ALL HAVING count(*) % 2 = 1)",
    "o_water": """SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (SELECT x, y FROM o_cell EXCEPT SELECT x, y FROM o_land) UNION SELECT (x + dx + 360) % 360, y + dy FROM (SELECT x, y FROM o_traced UNION SELECT x, y FROM o_filled)
  CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) WHERE y + dy BETWEEN 0 AND 179""",
    # the audit's walk: a line's first point, then the ends of steps of at most 5 km, the last of them the segment's own end
    "o_walked": """SELECT edge_id, mode, seg, s, CASE WHEN s = n THEN lon2 ELSE lon + (lon2 - lon) * f END AS lon, CASE WHEN s = n THEN lat2 ELSE degrees(2 * atan(exp(y1 + (y2 - y1) * f)) - pi() / 2) END AS lat, seg_km / n AS step_km
FROM (SELECT *, s / n AS f FROM (SELECT *, unnest(range(1, CAST(n AS BIGINT) + 1)) AS s FROM (SELECT *, greatest(1, ceil(seg_km / 5)) AS n FROM o_cut)))
UNION ALL SELECT edge_id, mode, 0, 0, lon, lat, 0 FROM o_cut WHERE seg = 0""",
    "o_walked_dry": f"SELECT DISTINCT edge_id, seg, s FROM (SELECT p.edge_id, p.seg, p.s, zone_id FROM o_walked p JOIN o_side ON {RING_HIT} WHERE p.mode IN ('rail', 'truck') GROUP BY ALL HAVING count(*) % 2 = 1)",
    "o_audit": f"""SELECT p.*, w.x IS NULL AS is_bad FROM (SELECT *, {cell_sql('lon', 'lat')} FROM o_walked WHERE mode = 'sea') p LEFT JOIN o_water w ON w.x = p.x AND w.y = p.y
UNION ALL SELECT p.*, 0, 0, d.s IS NULL FROM o_walked p LEFT JOIN o_walked_dry d ON d.edge_id = p.edge_id AND d.seg = p.seg AND d.s = p.s WHERE p.mode IN ('rail', 'truck')""",
    "o_audit_island": "SELECT *, sum(CAST(NOT is_bad AS INTEGER)) OVER (PARTITION BY edge_id ORDER BY seg, s) AS island, sum(CAST(NOT is_bad AS INTEGER)) OVER (PARTITION BY edge_id ORDER BY seg DESC, s DESC) AS back, coalesce(lead(step_km) OVER (PARTITION BY edge_id ORDER BY seg, s), 0) AS far_km FROM o_audit",
    "o_audit_longest": "SELECT edge_id, mode, max(km) AS km FROM (SELECT edge_id, mode, island, sum(step_km) AS km FROM o_audit_island WHERE is_bad GROUP BY edge_id, mode, island) GROUP BY edge_id, mode",
    "o_audit_end": """SELECT edge_id, mode, 'head' AS side, sum(step_km) AS km FROM o_audit_island WHERE island = 0 GROUP BY edge_id, mode
UNION ALL SELECT edge_id, mode, 'tail', sum(far_km) FROM o_audit_island WHERE back = 0 GROUP BY edge_id, mode""",
}


ORACLE_VIEWS |= {
    "o_land_hit": f"SELECT p.edge_id, p.seg, p.s FROM o_sample p JOIN o_side ON {RING_HIT} GROUP BY p.edge_id, p.seg, p.s, zone_id HAVING count(*) % 2 = 1",
    "o_medium": "SELECT p.*, NOT EXISTS (SELECT 1 FROM o_land_hit h WHERE h.edge_id = p.edge_id AND h.seg = p.seg AND h.s = p.s) AS is_bad FROM o_sample p",
    "o_island": "SELECT *, sum(CAST(NOT is_bad AS INTEGER)) OVER w AS island, row_number() OVER w AS n FROM o_medium WINDOW w AS (PARTITION BY edge_id ORDER BY seg, s)",
    "o_run": "SELECT edge_id, island, sum(step_km) AS km, arg_min(lon, n) AS from_lon, arg_max(lon, n) AS to_lon, arg_min(lat, n) AS from_lat, arg_max(lat, n) AS to_lat, min(n) AS n FROM o_island WHERE is_bad GROUP BY edge_id, island",
    "o_longest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY round(km, 6) DESC, n) AS r FROM o_run) WHERE r = 1",
}
ENDS = [F"{a}_{b}" for a in ("from", "to") for b in ("lon", "lat")]


@query("SELECT edge_id, round(km, 3) AS km, " + ", ".join(f"round({c}, 3) AS {c}" for c in ENDS) + " FROM o_longest")
def p5_longest_bad_run(t: Tables) -> DataFrame:
    return spatial.longest_bad_run(medium_samples(t)).select("edge_id", *[F.round(c, 3).alias(c) for c in ("km", *ENDS)])


@query("SELECT edge_id, side, round(km, 3) AS km FROM o_audit_end")
def p6_leading_run(t: Tables) -> DataFrame:
    s = audited_samples(t)
    run = lambda back, name: spatial.leading_run(s, back).select("edge_id", F.lit(name).alias("side"), F.round("km", 3).alias("km"))
    return run(False, "head").unionByName(run(True, "tail"))


ORACLE_VIEWS["o_ring_side"] = """SELECT shape_id, ring_no, lon AS lon1, lat AS lat1, coalesce(LEAD(lon) OVER w, first_value(lon) OVER w) AS lon2, coalesce(LEAD(lat) OVER w, first_value(lat) OVER w) AS lat2
FROM x_ring WINDOW w AS (PARTITION BY shape_id, ring_no ORDER BY pos)"""
ORACLE_VIEWS["o_air_sample"] = f"""SELECT src, dst, s, degrees(atan2(y, x)) AS lon, degrees(atan2(z, sqrt(x * x + y * y))) AS lat FROM (SELECT src, dst, s,
  wa * cos(la1) * cos(lo1) + wb * cos(la2) * cos(lo2) AS x, wa * cos(la1) * sin(lo1) + wb * cos(la2) * sin(lo2) AS y, wa * sin(la1) + wb * sin(la2) AS z FROM
  (SELECT *, sin((1 - f) * d) / sin(d) AS wa, sin(f * d) / sin(d) AS wb FROM (SELECT *, (s + 0.5e0) / n AS f FROM (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS s FROM (SELECT *, greatest(1, ceil(d * 6371.0e0 / 50)) AS n FROM
  (SELECT a.node_id AS src, b.node_id AS dst, radians(a.lat) AS la1, radians(a.lon) AS lo1, radians(b.lat) AS la2, radians(b.lon) AS lo2, {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 6371.0e0 AS d
   FROM f_node a JOIN f_node b ON a.node_id < b.node_id WHERE a.kind = 'airport' AND b.kind = 'airport'))))))"""
ORACLE_VIEWS["o_air_tag"] = f"""SELECT DISTINCT src, dst, shape_id FROM (SELECT src, dst, s, shape_id, max(ring_no) AS m FROM
  (SELECT src, dst, s, shape_id, ring_no FROM o_air_sample p JOIN o_ring_side ON {RING_HIT} GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY ALL) WHERE m = 0"""


def hub_pairs(t: Tables) -> DataFrame:
    hub = t.f_node.where("kind = 'airport'")
    a = hub.select(F.col("node_id").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    a = a.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "src")  # each meets all others: not in one task
    return a.join(hub.select(F.col("node_id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), F.col("src") < F.col("dst"))


@query("SELECT src, dst, CAST(bit // 64 AS INTEGER) AS word, bit_or(CAST(1 AS BIGINT) << (bit % 64)) AS mask FROM o_air_tag JOIN x_shape_bit USING (shape_id) GROUP BY src, dst, bit // 64")
def j15_tag_airspace(t: Tables) -> DataFrame:
    return spatial.airspace_mask(spatial.tag_airspace(hub_pairs(t), t.x_ring), t.x_shape_bit)


ASKED = "SELECT origin AS src, destination AS dst, CAST(request_id % 5 * 50 AS INT) AS bit FROM f_request"


@query(f"""SELECT DISTINCT edge_id, shape_id FROM f_edge e JOIN ({ASKED}) m ON (m.src = e.src AND m.dst = e.dst) OR (m.src = e.dst AND m.dst = e.src) JOIN x_shape_bit b ON b.bit = m.bit WHERE e.mode = 'air'""")
def j16_airspace_on_leg(t: Tables) -> DataFrame:
    mask = t.sql(f"SELECT src, dst, CAST(FLOOR(bit / 64) AS INT) AS word, bit_or(shiftleft(1L, bit % 64)) AS mask FROM ({ASKED}) GROUP BY src, dst, CAST(FLOOR(bit / 64) AS INT)")
    return spatial.airspace_on_leg(t.f_edge, mask, t.x_shape_bit)
