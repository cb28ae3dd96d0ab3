"""Queries of feeds, sinks, summaries and clusters (SRC, SNK, A4–A13, K)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightgraph.functions.scratch import shared_dir
from freightgraph.operators import cluster, indices
from freightgraph.plans.tables import ORACLE_VIEWS, Tables, km_sql, query
from freightgraph.sources import feeds, sinks


def now() -> F.Column:
    return F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")


@query("SELECT node_id, name, kind FROM f_node")
def src1_read_nodes(t: Tables) -> DataFrame:
    n = t.f_node.select("node_id", "name", "kind")
    return feeds.union_nodes(n.where("node_id % 2 = 0"), n.where("node_id % 2 = 1"))


@query("SELECT edge_id, src, dst, mode FROM f_edge WHERE src % 7 <> 0 AND dst % 7 <> 0")
def src2_read_edges(t: Tables) -> DataFrame:
    of = lambda m: t.f_edge.where(F.col("mode") == m).drop("mode")
    layers = {None: t.f_edge.where("mode = 'rail'"), "sea": of("sea"), "truck": of("truck"), "air": of("air")}
    return feeds.read_edges(layers, t.f_node.where("node_id % 7 != 0")).select("edge_id", "src", "dst", "mode")


@query("SELECT concat('quake_', event_id) AS zone_id, round(lat, 3) AS lat, round(lon, 3) AS lon, CASE WHEN magnitude < 6 THEN 60.0e0 WHEN magnitude < 7 THEN 120.0e0 WHEN magnitude < 8 THEN 220.0e0 ELSE 350.0e0 END AS radius_km FROM f_detection WHERE magnitude >= 5.5")
def src3_quake_zones(t: Tables) -> DataFrame:
    return feeds.quake_zones(t.f_detection)


@query("""SELECT concat('gdacs_', lower(event_type), '_', event_id) AS zone_id, CASE event_type WHEN 'TC' THEN 'cyclone' WHEN 'FL' THEN 'flood' ELSE 'volcano' END AS hazard_kind,
CASE event_type WHEN 'TC' THEN CASE alert_level WHEN 'Red' THEN 500.0e0 ELSE 300.0e0 END WHEN 'FL' THEN CASE alert_level WHEN 'Red' THEN 150.0e0 ELSE 80.0e0 END ELSE CASE alert_level WHEN 'Red' THEN 100.0e0 ELSE 50.0e0 END END AS radius_km,
CASE event_type WHEN 'TC' THEN 'sea' WHEN 'FL' THEN 'truck,rail' END AS modes, CASE event_type WHEN 'TC' THEN 4.0e0 WHEN 'FL' THEN 3.0e0 ELSE 5.0e0 END AS surcharge, CASE event_type WHEN 'TC' THEN 25 WHEN 'FL' THEN 30 ELSE 20 END AS security, round(lat, 3) AS lat, round(lon, 3) AS lon
FROM x_gdacs WHERE event_type <> 'XX' AND is_current = 'true'""")
def src4_gdacs_zones(t: Tables) -> DataFrame:
    return feeds.gdacs_zones(t.x_gdacs)


@query("""SELECT concat('storm_', event_id, '_', h, 'h') AS zone_id, h > 0 AS forecast, CAST(floor(b + h * 1.6e0 + 0.5) AS BIGINT) AS radius_km, ts + to_hours(h) AS active_from, ts + to_hours(h + 24) AS active_until,
  round(CASE WHEN h = 0 THEN lat ELSE degrees(p2) END, 3) AS lat,
  round(CASE WHEN h = 0 THEN lon ELSE lon2 + 180 - 360 * floor((lon2 + 180) / 360) - 180 END, 3) AS lon, CAST(h AS INTEGER) AS lead_h
FROM (SELECT *, degrees(radians(lon) + atan2(sin(hd) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * sin(p2))) AS lon2 FROM (SELECT *, asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(hd)) AS p2 FROM (SELECT *, speed_kt * 1.852e0 * h / 6371.0e0 AS d, radians(heading) AS hd, CASE WHEN coalesce(intensity_kt, 0) >= 96 THEN 300 WHEN coalesce(intensity_kt, 0) >= 64 THEN 220 ELSE 150 END AS b FROM x_storm CROSS JOIN (SELECT unnest([0, 24, 48, 72]) AS h))))""")
def src5_storm_zones(t: Tables) -> DataFrame:
    return feeds.storm_zones(t.x_storm)


ORACLE_VIEWS |= {
    "o_position": """SELECT doc_id, CASE WHEN upper(ns) = 'S' THEN -1 ELSE 1 END * (CAST(d1 AS DOUBLE) + CAST(m1 AS DOUBLE) / 60) AS lat, CASE WHEN upper(ew) = 'W' THEN -1 ELSE 1 END * (CAST(d2 AS DOUBLE) + CAST(m2 AS DOUBLE) / 60) AS lon FROM
  (SELECT doc_id, unnest(regexp_extract_all(text, p, 1)) AS d1, unnest(regexp_extract_all(text, p, 2)) AS m1, unnest(regexp_extract_all(text, p, 3)) AS ns, unnest(regexp_extract_all(text, p, 4)) AS d2, unnest(regexp_extract_all(text, p, 5)) AS m2, unnest(regexp_extract_all(text, p, 6)) AS ew
   FROM (SELECT *, '(\\d{1,3})-(\\d{1,2}(?:\\.\\d+)?)\\s*([NSns])\\s+(\\d{1,3})-(\\d{1,2}(?:\\.\\d+)?)\\s*([EWew])' AS p FROM f_warning WHERE regexp_matches(text, '(?i)\\b(live fire|missile|rocket|mine|firing|dangerous|prohibited)\\b')))
  WHERE CAST(d1 AS DOUBLE) + CAST(m1 AS DOUBLE) / 60 <= 90 AND CAST(d2 AS DOUBLE) + CAST(m2 AS DOUBLE) / 60 <= 180""",
}


_DTG = r"'^\s*(\d{6})Z\s+([A-Za-z]{3}\s+\d{4})\s*$'"
DTG_SQL = f"try_strptime(regexp_extract(issued, {_DTG}, 1) || ' ' || regexp_extract(issued, {_DTG}, 2), '%d%H%M %b %Y')"


@query(f"""SELECT lower(concat('navwarn_', w.nav_area, '_', w.msg_year, '_', w.msg_number)) AS zone_id, w.doc_id, concat('NAVAREA ', w.nav_area, ' warning — ', substr(trim(regexp_replace(w.text, '\\s+', ' ', 'g')), 1, 90)) AS label,
  35 AS security, 'hazard' AS access, 2.0e0 AS surcharge_usd_per_km, 0.0e0 AS toll_usd, 'navwarning' AS hazard_kind, 'sea' AS modes, coalesce({DTG_SQL}, TIMESTAMP '2024-01-20 00:00:00') AS detected_at, z.n, z.lat, z.lon, z.radius_km FROM f_warning w JOIN
(SELECT p.doc_id, c.n, round(clat, 3) AS lat, round(clon, 3) AS lon, CAST(floor(least(300, greatest(25, round(max({km_sql('lat', 'lon', 'clat', 'clon')}) + 25, 6))) + 0.5) AS BIGINT) AS radius_km
FROM o_position p JOIN (SELECT doc_id, avg(lat) AS clat, avg(lon) AS clon, count(*) AS n FROM o_position GROUP BY doc_id) c ON c.doc_id = p.doc_id GROUP BY p.doc_id, c.n, clat, clon HAVING max({km_sql('lat', 'lon', 'clat', 'clon')}) <= 600) z ON z.doc_id = w.doc_id""")
def src6_navwarning_zones(t: Tables) -> DataFrame:
    return feeds.navwarning_zones(t.f_warning, now())


@query(f"SELECT doc_id, {DTG_SQL} AS at FROM f_warning")
def src7_parse_dtg(t: Tables) -> DataFrame:
    return t.f_warning.select("doc_id", feeds.parse_dtg(F.col("issued")).alias("at"))


@query("SELECT event_id, round(lat, 6) AS lat, round(lon, 6) AS lon, frp FROM f_detection WHERE CASE confidence WHEN 'l' THEN 30 WHEN 'n' THEN 60 WHEN 'h' THEN 90 ELSE coalesce(try_cast(confidence AS DOUBLE), 0) END >= 50")
def src8_hotspot_points(t: Tables) -> DataFrame:
    return feeds.hotspot_points(t.f_detection).select("event_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "frp")


NOW = "TIMESTAMP '2024-01-20 00:00:00'"
CONFLICT_SQL = f"""SELECT event_id, deaths, CASE country WHEN 'Ivory Coast' THEN 'Côte d''Ivoire' WHEN 'Macedonia, FYR' THEN 'North Macedonia' ELSE regexp_replace(country, '\\s*\\([^)]*\\)\\s*$', '') END AS country, where_prec, lat, lon
FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY release_order DESC) AS r FROM x_conflict WHERE ts >= {NOW} - INTERVAL 90 DAY) WHERE r = 1 AND where_prec <= 3"""
ORACLE_VIEWS["o_conflict"] = CONFLICT_SQL


@query("SELECT event_id, lat, lon, deaths, country FROM o_conflict")
def src9_conflict_points(t: Tables) -> DataFrame:
    return feeds.conflict_points(t.x_conflict, now())


ORACLE_VIEWS["o_base"] = """SELECT item, list_sort(list_distinct(list(cls))) AS classes, bool_or(coalesce(runway, FALSE)) AS has_runway, arg_min(name, k) AS name, arg_min(ctry, k) AS country, arg_min(point, k) AS point
FROM (SELECT *, coalesce(country, '') AS ctry, CASE WHEN country IS NULL THEN 1000000000 ELSE 0 END + row_no AS k FROM x_base_row) GROUP BY item"""


@query("SELECT item, array_to_string(classes, ',') AS classes, has_runway, name, nullif(country, '') AS country FROM o_base")
def src10_import_bases(t: Tables) -> DataFrame:
    return feeds.import_bases(t.x_base_row).select("item", F.array_join("classes", ",").alias("classes"), "has_runway", "name", "country")


BAD_NAME = r"(?i)\b(academy|training|school|college|museum|memorial|hospital|barracks|castle|fortress)\b"


@query("""SELECT item, name, CASE country WHEN 'Ivory Coast' THEN 'Côte d''Ivoire' ELSE country END AS country, CAST(split_part(regexp_extract(point, '\\((.*)\\)', 1), ' ', 2) AS DOUBLE) AS lat, CAST(split_part(regexp_extract(point, '\\((.*)\\)', 1), ' ', 1) AS DOUBLE) AS lon FROM o_base
WHERE NOT list_contains(classes, 'Q3') AND (len([c FOR c IN classes IF c <> 'Q5']) > 0 OR has_runway) AND name NOT LIKE '%academy%' AND name <> 'Q77' AND country <> '' AND point LIKE 'Point(%' """)
def src11_filter_transit_sites(t: Tables) -> DataFrame:
    return feeds.filter_transit_sites(feeds.import_bases(t.x_base_row), ["Q3"], ["Q5"], BAD_NAME)


@query(f"SELECT item FROM x_site s WHERE NOT EXISTS (SELECT 1 FROM f_node n WHERE {km_sql('s.lat', 's.lon', 'n.lat', 'n.lon')} <= 3)")
def src12_dedupe_near_curated(t: Tables) -> DataFrame:
    return feeds.dedupe_near(t.x_site, t.f_node).select("item")


@query("""SELECT item, CASE WHEN n = 1 THEN s ELSE concat(s, '_', n) END AS slug FROM (SELECT item, s, row_number() OVER (PARTITION BY s ORDER BY item) + CASE WHEN s IN ('region_5', 'region_8') THEN 1 ELSE 0 END AS n FROM
(SELECT node_id AS item, concat('region_', node_id % 30) AS s FROM f_node))""")
def src13_slug_ids(t: Tables) -> DataFrame:
    rows = t.f_node.select(F.col("node_id").alias("item"), F.concat(F.lit("Région – "), (F.col("node_id") % 30).cast("string")).alias("name"))
    taken = t.spark.createDataFrame([("region_5",), ("region_8",)], "slug string")
    return feeds.assign_slugs(rows, taken).select("item", "slug")


@query("SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, mode, concat('z', z.zone_id) AS zone_id, km FROM f_edge e JOIN x_edge_zone z ON z.edge_id = e.edge_id")
def src14_read_tags(t: Tables) -> DataFrame:
    # ids are made of two places' numbers and may name several legs: their tags are packed once an id, and read once for each of its legs
    legs = t.f_edge.groupBy("edge_id").agg(F.count("*").cast("int").alias("legs"))
    tags = t.spark.sql(t.crossing("x_edge_zone", legs))
    packed = tags.groupBy("edge_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("z"), F.col("zone_id").cast("string")), "km")))).alias("zones"))
    copies = legs.where("legs > 1").select("edge_id", F.explode(F.sequence(F.lit(2), F.col("legs"))).alias("copy"))
    named = t.f_edge.unionByName(t.f_edge.join(copies.select("edge_id"), "edge_id").select(*t.f_edge.columns)).select("edge_id", F.concat_ws("|", F.col("src").cast("string"), F.col("dst").cast("string"), "mode").alias("leg_key"))
    return feeds.read_edge_tags(named.join(packed, "edge_id").select("leg_key", "zones"))


ORACLE_VIEWS["o_hazard_ring"] = """SELECT zone_id, 'circle' AS shape, k AS pos, lon + radius_km / 111.32e0 / greatest(cos(radians(lat)), 0.05e0) * cos(2 * 3.141592653589793e0 * (k % 18) / 18) AS lon, lat + radius_km / 111.32e0 * sin(2 * 3.141592653589793e0 * (k % 18) / 18) AS lat
FROM f_zone CROSS JOIN (SELECT unnest(range(0, 19)) AS k) UNION ALL SELECT zone_id, 'ring', pos, lon, lat FROM f_zone_vertex UNION ALL SELECT zone_id, 'ring', 1048576, lon, lat FROM f_zone_vertex WHERE pos = 0"""
# adding zero takes the sign off a zero
POINT_SQL = "'[' || CAST(round(lon, 4) + 0.0e0 AS VARCHAR) || ',' || CAST(round(lat, 4) + 0.0e0 AS VARCHAR) || ']'"


@query("SELECT node_id, concat('{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":', " + POINT_SQL + ", '},\"properties\":{\"id\":', node_id, ',\"name\":\"', name, '\",\"kind\":\"', kind, '\"}}') AS feature FROM f_node")
def snk2_node_geojson(t: Tables) -> DataFrame:
    return sinks.to_geojson_points(t.f_node)


@query("SELECT zone_id, shape, CAST(count(*) AS INTEGER) AS n_points, round(avg(round(lon, 4)) FILTER (WHERE pos <> last), 3) + 0.0e0 AS lon, round(avg(round(lat, 4)) FILTER (WHERE pos <> last), 3) + 0.0e0 AS lat, concat('{\"type\":\"Feature\",\"geometry\":{\"type\":\"Polygon\",\"coordinates\":[[', string_agg(" + POINT_SQL
    + ", ',' ORDER BY pos), ']]},\"properties\":{\"id\":', zone_id, ',\"shape\":\"', shape, '\"}}') AS feature FROM (SELECT *, max(pos) OVER (PARTITION BY zone_id, shape) AS last FROM o_hazard_ring) GROUP BY zone_id, shape")
def snk3_hazard_geojson(t: Tables) -> DataFrame:
    return sinks.to_geojson_hazards(t.f_zone, t.f_zone_vertex)


@query("SELECT edge_id, CAST(count(*) AS INTEGER) AS parts, concat('{\"type\":\"Feature\",\"geometry\":{\"type\":\"MultiLineString\",\"coordinates\":[', string_agg(line, ',' ORDER BY part), ']},\"properties\":{\"id\":', edge_id, '}}') AS feature FROM (SELECT edge_id, part, '[' || string_agg(" + POINT_SQL
    + ", ',' ORDER BY pos) || ']' AS line FROM o_parts GROUP BY edge_id, part) GROUP BY edge_id")
def snk4_route_geojson(t: Tables) -> DataFrame:
    return sinks.to_geojson_routes(t.f_edge_point)


@query("SELECT zone_id, source_no, radius_km FROM f_zone")
def snk1_write_zones(t: Tables) -> DataFrame:
    """Written to the shared folder in the order of ids, and read again."""
    z = t.f_zone.select("zone_id", "source_no", "radius_km")
    path = f"{shared_dir(t.spark)}/zones/{uuid.uuid4().hex}"
    sinks.write_zones(z, path)
    return t.spark.read.schema(z.schema).json(path)


ORACLE_VIEWS["o_sanctions"] = "SELECT country, CAST(sum(designations) AS BIGINT) AS designations, count(*) AS programs FROM f_program p JOIN o_program_country c ON c.program_id = p.program_id GROUP BY country"


@query("SELECT country, designations, programs FROM o_sanctions")
def a4_sanctions_by_country(t: Tables) -> DataFrame:
    return indices.sanctions_by_country(t.f_program, t.x_token)


MENTIONS = "SELECT country, count(*) AS mentions FROM f_node GROUP BY country"


@query(f"""SELECT * FROM (SELECT c.country, coalesce(programs, 0) AS sanctions_programs, coalesce(designations, 0) AS sanctions_designations, coalesce(mentions, 0) AS conflict_mentions,
  -(CAST(floor(round(least(1, log10(1 + coalesce(designations, 0)) / log10(5001)) * 18, 9) + 0.5) AS BIGINT) + CAST(coalesce(floor(round(mentions / (SELECT max(mentions) FROM ({MENTIONS}))::DOUBLE * 12, 9) + 0.5), 0) AS BIGINT)) AS security_delta,
  -CAST(floor(round(least(1, log10(1 + coalesce(designations, 0)) / log10(5001)) * 12, 9) + 0.5) AS BIGINT) AS econ_delta FROM (SELECT DISTINCT country FROM f_node) c LEFT JOIN o_sanctions s USING (country) LEFT JOIN ({MENTIONS}) m USING (country)) WHERE security_delta <> 0 OR econ_delta <> 0""")
def a5_country_risk(t: Tables) -> DataFrame:
    return indices.country_risk(t.f_node, indices.sanctions_by_country(t.f_program, t.x_token), t.sql(MENTIONS))


@query(f"SELECT event_type AS country, least(count(*), 250) AS mentions FROM f_detection WHERE event_type IN ('click', 'view', 'error') AND ts > {NOW} - INTERVAL 7 DAY AND ts <= {NOW} GROUP BY event_type")
def a6_mentions_by_country(t: Tables) -> DataFrame:
    watch = t.spark.createDataFrame([("click",), ("view",), ("error",)], "country string")
    return indices.mentions_by_country(t.f_detection.withColumnRenamed("event_type", "country"), watch, now())


@query("""SELECT border, m AS median_minutes, n AS open_crossings, coalesce(s, 0) AS shut_24h, floor(m / 60 * 10 + 0.5) / 10 AS delay_hours FROM (SELECT border, delay_minutes AS m, row_number() OVER (PARTITION BY border ORDER BY delay_minutes) AS r, count(*) OVER (PARTITION BY border) AS n FROM f_border_wait WHERE port_status <> 'Closed')
LEFT JOIN (SELECT border, count(*) AS s FROM f_border_wait WHERE port_status = 'Closed' AND hours LIKE '24%' GROUP BY border) USING (border) WHERE r = n // 2 + 1 AND m >= 30""")
def a7_border_waits(t: Tables) -> DataFrame:
    return indices.border_waits(t.f_border_wait)


@query("""SELECT border_id, least(count(*), 10) AS reports, 12.0e0 AS delay_hours, arg_max(concat('Report ', event_type, ' ', event_id % 7), {'t': ts, 'i': event_id}) AS headline FROM (SELECT event_id, event_type, ts, border_id FROM f_detection JOIN (VALUES ('b1', 'click', '3'), ('b2', 'view', '5')) AS w(border_id, a, b) ON event_type = a AND CAST(event_id % 7 AS VARCHAR) = b
WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 21 DAY AND ts <= TIMESTAMP '2024-01-20 00:00:00') GROUP BY border_id HAVING count(*) >= 2""")
def a8_reported_closures(t: Tables) -> DataFrame:
    reports = t.f_detection.select(F.col("event_id").alias("report_id"), "ts", F.concat_ws(" ", F.lit("Report"), "event_type", (F.col("event_id") % 7).cast("string")).alias("title"))
    watch = t.spark.createDataFrame([("b1", "click"), ("b1", "3"), ("b2", "view"), ("b2", "5")], "border_id string, term string")
    return indices.reported_closures(reports, watch, now())


@query("""WITH s AS (SELECT choke_no, n_total, row_number() OVER (PARTITION BY choke_no ORDER BY period DESC) AS r FROM f_transit),
b AS (SELECT choke_no, n_total AS baseline, n FROM (SELECT choke_no, n_total, row_number() OVER (PARTITION BY choke_no ORDER BY n_total) AS k, count(*) OVER (PARTITION BY choke_no) AS n FROM s WHERE r <= 60) WHERE k = n // 2 + 1),
q AS (SELECT choke_no, n_total AS recent FROM (SELECT choke_no, n_total, row_number() OVER (PARTITION BY choke_no ORDER BY n_total) AS k, count(*) OVER (PARTITION BY choke_no) AS n FROM s WHERE r <= 7) WHERE k = n // 2 + 1)
SELECT b.choke_no AS key, recent, baseline, least(2.0e0, round(1 / greatest(recent / baseline, 0.1), 2)) AS delay_factor FROM b JOIN q ON q.choke_no = b.choke_no WHERE n >= 21 AND baseline >= 10 AND recent / baseline < 0.97""".replace("WITH s AS", "SELECT * FROM (WITH s AS", 1) + ")")
def a9_chokepoint_conditions(t: Tables) -> DataFrame:
    series = t.f_transit.select(F.col("choke_no").alias("key"), "period", F.col("n_total").alias("value"))
    return indices.chokepoint_conditions(series, baseline=60, below=0.97)


@query("""SELECT zone_id, arg_max(station, f * 1000000 - place) AS station, max(f) AS delay_factor, count(f) AS low, count(*) AS gauges FROM (SELECT node_id % 12 AS zone_id, node_id AS place, concat('g', node_id) AS station, CASE node_id % 5 WHEN 0 THEN 1.35e0 WHEN 1 THEN 1.8e0 END AS f FROM f_node) GROUP BY zone_id HAVING count(f) > 0""")
def a10_water_conditions(t: Tables) -> DataFrame:
    n = t.f_node.select((F.col("node_id") % 12).alias("zone_id"), F.col("node_id").alias("place"), F.concat(F.lit("g"), F.col("node_id").cast("string")).alias("station"), "node_id")
    reading = n.select("station", F.when(F.col("node_id") % 5 == 0, "low").when(F.col("node_id") % 5 == 1, "very low").otherwise("normal").alias("state"))
    factors = t.spark.createDataFrame([("low", 1.35), ("very low", 1.8)], "state string, delay_factor double")
    return indices.water_conditions(reading, n.drop("node_id"), factors)


@query("SELECT hazard_kind, count(*) AS n FROM f_zone GROUP BY hazard_kind ORDER BY n DESC, hazard_kind LIMIT 5")
def a11_zone_counts(t: Tables) -> DataFrame:
    return indices.zone_counts(t.f_zone, "hazard_kind", 5)


@query("""SELECT release, prec, n, round(n / sum(n) OVER w, 6) AS share, CAST(sum(n) OVER w AS BIGINT) AS total, CAST(datediff('day', min(lo) OVER w, max(hi) OVER w) AS BIGINT) AS span_days, strftime(min(lo) OVER w, '%Y-%m-%d') AS oldest, strftime(max(hi) OVER w, '%Y-%m-%d') AS newest FROM (SELECT release_order AS release, where_prec AS prec, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM x_conflict GROUP BY ALL) WINDOW w AS (PARTITION BY release)""")
def a12_release_profile(t: Tables) -> DataFrame:
    return indices.release_profile(t.x_conflict.withColumnsRenamed({"release_order": "release", "where_prec": "prec"})).withColumns({c: F.col(c).cast("string") for c in ("oldest", "newest")})


@query("SELECT 'rows' AS metric, count(*) AS value FROM f_warning UNION ALL SELECT 'with_position', count(*) FROM f_warning UNION ALL SELECT 'areas', count(DISTINCT nav_area) FROM f_warning UNION ALL SELECT * FROM (SELECT concat('area:', nav_area), count(*) AS n FROM f_warning WHERE nav_area IS NOT NULL GROUP BY nav_area ORDER BY n DESC, nav_area LIMIT 8)")
def a13_feed_profile(t: Tables) -> DataFrame:
    return indices.feed_profile(t.f_warning, feeds.POSITION)


def points(t: Tables) -> DataFrame:
    return t.f_detection.select(F.col("event_id").alias("seq"), "lat", "lon")


@query()
def k1_cluster_points(t: Tables) -> DataFrame:
    return cluster.cluster_points(points(t), 30)


@query()
def k2_cluster_cells(t: Tables) -> DataFrame:
    return cluster.cluster_cells(points(t), 30)


ORACLE_VIEWS["o_spread"] = f"""SELECT m.c AS cluster_id, n, clat AS lat, clon AS lon, max({km_sql('lat', 'lon', 'clat', 'clon')}) AS spread_km FROM (SELECT *, event_id % 40 AS c FROM f_detection) d
JOIN (SELECT event_id % 40 AS c, avg(lat) AS clat, avg(lon) AS clon, count(*) AS n FROM f_detection GROUP BY event_id % 40) m ON m.c = d.c GROUP BY ALL"""


@query("SELECT cluster_id, n, round(lat, 3) AS lat, round(lon, 3) AS lon, round(spread_km, 2) AS spread_km FROM o_spread")
def k3_cluster_spread(t: Tables) -> DataFrame:
    c = t.f_detection.select((F.col("event_id") % 40).alias("cluster_id"), "lat", "lon")
    return cluster.cluster_spread(c).select("cluster_id", "n", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), F.round("spread_km", 2).alias("spread_km"))


@query()
def k4_wildfire_zones(t: Tables) -> DataFrame:
    p = feeds.hotspot_points(t.f_detection).withColumnRenamed("event_id", "seq")
    return cluster.wildfire_zones(p, cluster.cluster_points(p, 30))


@query()
def k5_conflict_zones(t: Tables) -> DataFrame:
    p = feeds.conflict_points(t.x_conflict, now()).withColumnRenamed("event_id", "seq")
    return cluster.conflict_zones(p, cluster.cluster_points(p, 40))
