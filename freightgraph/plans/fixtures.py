"""SQL views over the test tables, with the same text in Spark and DuckDB; in order of dependence."""

from __future__ import annotations

VIEWS = {
    # network nodes, one per supplier
    "f_node": """
SELECT s_suppkey AS node_id, s_name AS name, n_name AS country, s_nationkey AS country_key,
  CASE s_suppkey % 6 WHEN 0 THEN 'capital' WHEN 1 THEN 'city' WHEN 2 THEN 'seaport'
    WHEN 3 THEN 'airport' WHEN 4 THEN 'railhub' ELSE 'military' END AS kind,
  CAST((s_suppkey * 7919) % 1400 AS DOUBLE) / 10.0 - 70.0 AS lat,
  CAST((s_suppkey * 104729) % 3600 AS DOUBLE) / 10.0 - 180.0 AS lon
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""",
    # curated scores, gauge, live adjustment
    "f_country": """
SELECT n_nationkey AS country_key, n_name AS country, (n_nationkey * 37 + 11) % 101 AS econ,
  (n_nationkey * 53 + 29) % 101 AS security, -((n_nationkey * 7) % 19) AS security_delta,
  -((n_nationkey * 5) % 13) AS econ_delta,
  CASE n_nationkey % 4 WHEN 0 THEN 1435 WHEN 1 THEN 1520 WHEN 2 THEN 1524 ELSE 1668 END AS gauge
FROM nation
""",
    # per-mode tariff
    "f_mode": """
SELECT * FROM (VALUES ('sea', 0, 0.028E0, 33.0E0, 1.15E0, 300.0E0, 24.0E0, 100000.0E0),
  ('air', 1, 0.45E0, 800.0E0, 1.05E0, 220.0E0, 5.0E0, 120.0E0),
  ('rail', 2, 0.06E0, 55.0E0, 1.3E0, 110.0E0, 8.0E0, 100000.0E0),
  ('truck', 3, 0.12E0, 65.0E0, 1.3E0, 60.0E0, 1.5E0, 100000.0E0))
  AS m(mode, mode_no, usd_per_km, km_per_hour, detour_factor, hub_usd, hub_hours, max_tonnes)
""",
    # undirected legs: the 4 suppliers most often on the same order
    "f_edge": """
WITH p AS (SELECT a.l_suppkey AS f, b.l_suppkey AS t, COUNT(*) AS c FROM lineitem a
    JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey
    GROUP BY a.l_suppkey, b.l_suppkey),
  r AS (SELECT f, t, c, ROW_NUMBER() OVER (PARTITION BY f ORDER BY c DESC, t) AS rn FROM p)
SELECT f * 100000 + t AS edge_id, f AS src, t AS dst,
  CASE (f * 3 + t * 5) % 4 WHEN 0 THEN 'sea' WHEN 1 THEN 'air' WHEN 2 THEN 'rail' ELSE 'truck' END AS mode
FROM r WHERE rn <= 4
""",
    # leg polylines in long form (sea legs get one via point)
    "f_edge_point": """
SELECT e.edge_id, e.mode, 0 AS pos, n.lon, n.lat FROM f_edge e JOIN f_node n ON n.node_id = e.src
UNION ALL
SELECT e.edge_id, e.mode, 1, (a.lon + b.lon) / 2.0, (a.lat + b.lat) / 2.0 + 1.5
FROM f_edge e JOIN f_node a ON a.node_id = e.src JOIN f_node b ON b.node_id = e.dst WHERE e.mode = 'sea'
UNION ALL
SELECT e.edge_id, e.mode, 2, n.lon, n.lat FROM f_edge e JOIN f_node n ON n.node_id = e.dst
""",
    # circle zones with kind, price and validity window
    "f_zone": """
SELECT p_partkey AS zone_id, CONCAT('zone ', p_name, ' ', CAST(p_partkey AS VARCHAR(20))) AS label,
  (p_partkey * 31) % 101 AS security,
  CASE (p_partkey / 20) % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'hazard' ELSE 'military-only' END AS access,
  CASE p_size % 7 WHEN 0 THEN 'earthquake' WHEN 1 THEN 'wildfire' WHEN 2 THEN 'cyclone' WHEN 3 THEN 'flood'
    WHEN 4 THEN 'volcano' WHEN 5 THEN 'navwarning' ELSE 'conflict' END AS hazard_kind,
  CAST(p_size AS DOUBLE) / 10.0 AS surcharge_usd_per_km,
  CASE WHEN p_partkey % 100 = 0 THEN 45.0E0 ELSE 0.0E0 END AS toll_usd,
  CAST((p_partkey * 3571) % 1400 AS DOUBLE) / 10.0 - 70.0 AS lat,
  CAST((p_partkey * 8821) % 3600 AS DOUBLE) / 10.0 - 180.0 AS lon,
  100.0E0 + CAST(p_size AS DOUBLE) * 8.0 AS radius_km,
  CAST(p_size AS INT) % 5 AS source_no,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '6' HOUR * CAST(p_size AS INT) AS active_from,
  TIMESTAMP '2024-01-03 00:00:00' + INTERVAL '6' HOUR * CAST(p_size AS INT) AS active_until,
  p_size % 12 + 1 AS delay_month, 1.0E0 + CAST(p_size AS DOUBLE) / 100.0 AS delay_factor
FROM part WHERE p_partkey % 20 = 0
""",
    # modes a zone applies to (no row = all modes)
    "f_zone_mode": """
SELECT z.zone_id, m.mode FROM f_zone z CROSS JOIN f_mode m WHERE z.zone_id % 3 <> 0 AND (z.zone_id + m.mode_no) % 3 <> 0
""",
    # ring zones (one rectangle per region), vertices in order
    "f_zone_vertex": """
SELECT r_regionkey AS zone_id, v.i AS pos,
  -150.0E0 + r_regionkey * 60.0E0 + CASE WHEN v.i IN (1, 2) THEN 35.0E0 ELSE 0.0E0 END AS lon,
  -40.0E0 + r_regionkey * 12.0E0 + CASE WHEN v.i IN (2, 3) THEN 30.0E0 ELSE 0.0E0 END AS lat
FROM region CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(i)
""",
    # clumped point detections (hotspots, quakes, incidents)
    "f_detection": """
SELECT event_id, ts, event_type, user_id,
  CASE event_type WHEN 'error' THEN 'h' WHEN 'click' THEN 'n' WHEN 'view' THEN 'l' WHEN 'signup' THEN '55' ELSE 'x' END AS confidence,
  value AS frp, 4.0E0 + value / 60.0E0 AS magnitude, CAST(event_id % 6 AS INT) + 1 AS where_prec,
  CAST((event_id % 40) * 3 AS DOUBLE) - 60.0 + CAST((event_id * 7919) % 100 AS DOUBLE) / 250.0 AS lat,
  CAST((event_id % 23) * 14 AS DOUBLE) - 160.0 + CAST((event_id * 104729) % 100 AS DOUBLE) / 250.0 AS lon
FROM events
""",
    # throughput series per chokepoint and month
    "f_transit": """
SELECT CAST(l_suppkey % 7 AS INT) AS choke_no,
  EXTRACT(YEAR FROM l_shipdate) * 12 + EXTRACT(MONTH FROM l_shipdate) AS period, COUNT(*) AS n_total
FROM lineitem GROUP BY l_suppkey % 7, EXTRACT(YEAR FROM l_shipdate) * 12 + EXTRACT(MONTH FROM l_shipdate)
""",
    # crossing reports
    "f_border_wait": """
SELECT event_id, event_type AS border, user_id AS crossing, CAST(FLOOR(value) AS INT) AS delay_minutes,
  CASE WHEN event_id % 9 = 0 THEN 'Closed' ELSE 'Open' END AS port_status,
  CASE WHEN event_id % 2 = 0 THEN '24 hrs/day' ELSE '8 am-5 pm' END AS hours
FROM events
""",
    # sanctions programme ids with designation counts
    "f_program": """
SELECT CONCAT(c_mktsegment, '-', UPPER(n_name)) AS program_id, COUNT(*) AS designations
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 <> 0 GROUP BY c_mktsegment, n_name
""",
    # broadcast text carrying degree-minute positions
    "f_warning": """
SELECT doc_id, lang AS nav_area, CONCAT(CASE WHEN doc_id % 3 = 0 THEN 'ROUTINE BUOY ' ELSE 'LIVE FIRE IN AREA ' END,
  LPAD(CAST(doc_id % 80 AS VARCHAR(20)), 2, '0'), '-', LPAD(CAST((doc_id * 7) % 60 AS VARCHAR(20)), 2, '0'), '.5',
  CASE WHEN doc_id % 2 = 0 THEN 'N ' ELSE 'S ' END,
  LPAD(CAST((doc_id * 13) % 180 AS VARCHAR(20)), 3, '0'), '-', LPAD(CAST((doc_id * 11) % 60 AS VARCHAR(20)), 2, '0'), '.0',
  CASE WHEN doc_id % 5 < 2 THEN 'W' ELSE 'E' END, ' ', text) AS text,
  2024 - doc_id % 3 AS msg_year, doc_id % 900 AS msg_number,
  CASE WHEN doc_id % 11 <> 0 THEN CONCAT(LPAD(CAST(doc_id % 28 + 1 AS VARCHAR(20)), 2, '0'), LPAD(CAST(doc_id % 24 AS VARCHAR(20)), 2, '0'), LPAD(CAST(doc_id % 60 AS VARCHAR(20)), 2, '0'), 'Z ',
    CASE doc_id % 3 WHEN 0 THEN 'MAY' WHEN 1 THEN 'Jun' ELSE 'DEC' END, ' 2024') END AS issued
FROM documents
""",
    # shipment requests (origin, destination, sizing, month)
    "f_request": """
SELECT o.o_orderkey AS request_id, o.o_custkey % n.c AS origin, (o.o_orderkey * 31 + 7) % n.c AS destination,
  CAST(1 + o.o_orderkey % 150 AS DOUBLE) AS weight_tonnes, CAST((o.o_orderkey * 3) % 90 AS DOUBLE) AS volume_m3,
  EXTRACT(MONTH FROM o.o_orderdate) AS month,
  CASE WHEN o.o_orderkey % 4 = 0 THEN 'military' ELSE 'civilian' END AS cargo_class,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'hazmat' WHEN 1 THEN 'perishable' ELSE 'none' END AS handling
FROM orders o CROSS JOIN (SELECT COUNT(*) AS c FROM supplier) n
WHERE o.o_custkey % n.c <> (o.o_orderkey * 31 + 7) % n.c
""",
    # closed borders (from/to sides in long form)
    "f_border_rule": """
SELECT a.n_nationkey AS rule_id, a.n_name AS left_country, b.n_name AS right_country, m.mode
FROM nation a JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey > a.n_nationkey
CROSS JOIN f_mode m WHERE (a.n_nationkey + b.n_nationkey) % 4 = 0 AND m.mode IN ('rail', 'truck')
""",
}

# Further inputs, derived from those above
VIEWS |= {
    # zones on legs, as a stand-in for tags where the geometry does not matter
    "x_edge_zone": """
SELECT e.edge_id, z.zone_id, CAST((e.edge_id * 7 + z.zone_id) % 200 + 1 AS DOUBLE) AS km
FROM f_edge e JOIN f_zone z ON (e.edge_id + z.zone_id) % 37 = 0
""",
    # the same for later layers of tags
    "x_hazard_edge_zone": """
SELECT e.edge_id, z.zone_id, CAST((e.edge_id * 11 + z.zone_id) % 150 + 2 AS DOUBLE) AS km
FROM f_edge e JOIN f_zone z ON (e.edge_id + z.zone_id) % 74 = 0
""",
    # overrides and bonuses of some places
    "x_override": "SELECT node_id, (node_id * 17) % 101 AS fixed FROM f_node WHERE node_id % 9 = 0",
    "x_bonus": "SELECT node_id, node_id % 23 AS bonus FROM f_node WHERE node_id % 4 = 0",
    "x_score": "SELECT country, econ, security FROM f_country WHERE country_key % 8 <> 7",
    "x_econ": """
SELECT n.node_id, CAST(GREATEST(0, LEAST(100, COALESCE(s.econ, 30) + COALESCE(b.bonus, 0) + COALESCE(r.econ_delta, 0))) AS BIGINT) AS econ
FROM f_node n LEFT JOIN x_score s ON s.country = n.country LEFT JOIN x_bonus b ON b.node_id = n.node_id LEFT JOIN f_country r ON r.country = n.country
""",
    "x_security": """
SELECT n.node_id, CAST(COALESCE(o.fixed, GREATEST(0, LEAST(100, COALESCE(s.security, 50) + COALESCE(r.security_delta, 0)))) AS BIGINT) AS security
FROM f_node n LEFT JOIN x_score s ON s.country = n.country LEFT JOIN x_override o ON o.node_id = n.node_id LEFT JOIN f_country r ON r.country = n.country
""",
    # departures: orders' days brought into the zones' time
    "x_depart": """
SELECT request_id, origin, destination, weight_tonnes, volume_m3, month, cargo_class, handling,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(request_id % 400 AS INT) AS depart
FROM f_request
""",
    # requests to plan: three departures, each with its month; flags in long form, some requests with two
    "x_plan": """
SELECT request_id, origin, destination, weight_tonnes, volume_m3, cargo_class,
  CASE request_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 11 END AS month,
  CASE request_id % 3 WHEN 0 THEN TIMESTAMP '2024-01-03 06:00:00' WHEN 1 THEN TIMESTAMP '2024-01-06 18:00:00' ELSE TIMESTAMP '2024-01-10 12:00:00' END AS depart
FROM f_request
""",
    "x_plan_flag": """
SELECT request_id, handling AS flag FROM f_request WHERE handling <> 'none'
UNION ALL SELECT request_id, 'hvt' FROM f_request WHERE request_id % 7 = 0
UNION ALL SELECT request_id, 'hazmat' FROM f_request WHERE handling = 'perishable' AND request_id % 5 < 2
""",
    "x_closed_month": "SELECT zone_id, 7 AS month FROM f_zone WHERE zone_id % 100 = 20 UNION ALL SELECT zone_id, 1 FROM f_zone WHERE zone_id % 180 = 0",
    # stops: a third of the requests go by a waypoint
    "x_stop": """
SELECT request_id, 0 AS seq, origin AS node_id FROM f_request
UNION ALL SELECT request_id, 1, (origin * 3 + destination) % n.c FROM f_request CROSS JOIN (SELECT COUNT(*) AS c FROM f_node) n WHERE request_id % 3 = 0
UNION ALL SELECT request_id, 2, destination FROM f_request
""",
    "x_condition": "SELECT zone_id, CONCAT('slow at ', CAST(zone_id % 7 AS VARCHAR(20))) AS label, 1.0E0 + CAST(zone_id % 90 AS DOUBLE) / 40.0 AS delay_factor FROM f_zone WHERE zone_id % 60 = 0",
    "x_detour": "SELECT zone_id, CASE WHEN zone_id % 40 = 0 THEN 1.0E0 + CAST(zone_id % 7 AS DOUBLE) / 10.0 END AS detour_factor FROM f_zone",
    "x_ban": "SELECT z.zone_id, c.country FROM f_zone z JOIN f_country c ON (z.zone_id / 20 + c.country_key) % 3 <> 0 WHERE z.zone_id % 80 = 0",
    "x_border_status": """
SELECT rule_id, left_country, right_country, mode, CONCAT('queue at ', left_country) AS label, CAST(rule_id % 30 + 1 AS DOUBLE) AS delay_hours FROM f_border_rule
""",
    # gauges of places and groups that take each other's trains
    "x_node_gauge": "SELECT node_id, 1435 AS gauge FROM f_node WHERE node_id % 10 = 0",
    "x_country_gauge": "SELECT country, gauge FROM f_country WHERE country_key % 6 <> 5",
    "x_compatible": "SELECT * FROM (VALUES (1520, 1524), (1524, 1520)) AS c(a, b)",
    # landed feeds
    "x_gdacs": """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'TC' WHEN 1 THEN 'FL' WHEN 2 THEN 'VO' ELSE 'XX' END AS event_type,
  CASE event_id % 3 WHEN 0 THEN 'Orange' WHEN 1 THEN 'Red' ELSE 'Green' END AS alert_level,
  CASE WHEN event_id % 5 = 0 THEN 'false' ELSE 'true' END AS is_current, lat, lon FROM f_detection
""",
    "x_storm": """
SELECT event_id, ts, lat, lon, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 130 AS DOUBLE) END AS intensity_kt,
  CAST(event_id % 30 AS DOUBLE) AS speed_kt, CAST((event_id * 37) % 360 AS DOUBLE) AS heading FROM f_detection
""",
    "x_conflict": """
SELECT event_id, 1 AS release_order, ts, where_prec, lat, lon, CAST(event_id % 13 AS INT) AS deaths,
  CASE event_id % 4 WHEN 0 THEN 'DR Congo (Zaire)' WHEN 1 THEN 'Ivory Coast' WHEN 2 THEN 'Macedonia, FYR' ELSE 'Myanmar (Burma)' END AS country
FROM f_detection WHERE event_id % 2 = 0
UNION ALL
SELECT event_id, 2, ts, where_prec, lat, lon, CAST(event_id % 17 AS INT), 'Ukraine' FROM f_detection WHERE event_id % 3 = 0
""",
    "x_base_row": """
SELECT p_partkey AS row_no, CONCAT('item', CAST(p_partkey % 300 AS VARCHAR(20))) AS item, CONCAT('Q', CAST(p_partkey % 11 AS VARCHAR(20))) AS cls,
  CASE WHEN p_partkey % 5 = 0 THEN TRUE END AS runway, CASE WHEN p_partkey % 17 = 0 THEN 'Q77' WHEN p_partkey % 19 = 0 THEN CONCAT(p_name, ' academy') ELSE CONCAT(p_name, ' Base') END AS name,
  CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'Ivory Coast' ELSE p_brand END AS country,
  CASE WHEN p_partkey % 23 = 0 THEN 'unknown' ELSE CONCAT('Point(', CAST((p_partkey * 37) % 180 AS VARCHAR(20)), '.25 ', CAST((p_partkey * 13) % 90 AS VARCHAR(20)), '.5)') END AS point
FROM part
""",
    # sites beside known places, some within a few km
    "x_site": """
SELECT node_id AS item, name, lat + CASE WHEN node_id % 3 = 0 THEN 0.01E0 ELSE 0.05E0 END AS lat, lon + CASE WHEN node_id % 2 = 0 THEN 0.01E0 ELSE 0.0E0 END AS lon FROM f_node
""",
    # countries by token of a programme's id
    "x_token": "SELECT UPPER(country) AS token, country FROM f_country WHERE country_key % 2 = 0 UNION ALL SELECT 'BUILDING', 'CHINA'",
    "x_run": "SELECT CAST(FLOOR(EXTRACT(HOUR FROM active_from) / 6) AS INT) AS slot, CAST(active_from AS DATE) AS day, zone_id, hazard_kind FROM f_zone",
    # one outcome for each source of zones
    "x_outcome": """
SELECT s.source, s.source <> 1 AND s.source <> 3 AS ok, CASE WHEN s.source = 1 THEN TIMESTAMP '2024-01-05 12:00:00' END AS last_success
FROM (VALUES (0), (1), (2), (3), (4)) AS s(source)
""",
    "x_fetched": "SELECT source_no AS source, zone_id, CASE WHEN zone_id % 3 = 0 THEN active_until END AS active_until FROM f_zone WHERE zone_id % 40 = 0",
    "x_previous": "SELECT source_no AS source, zone_id, CASE WHEN zone_id % 7 <> 0 THEN active_from END AS detected_at, CASE WHEN zone_id % 5 <> 0 THEN active_until END AS active_until FROM f_zone WHERE zone_id % 40 <> 0",
    # land: the rectangles, on a coarse grid
    "x_lane_point": """
SELECT e.src, e.dst, p.pos, p.lon, CASE WHEN e.edge_id % 5 = 0 AND p.pos = 0 THEN p.lat + 2.0 ELSE p.lat END AS lat
FROM f_edge e JOIN f_edge_point p ON p.edge_id = e.edge_id WHERE e.mode = 'sea'
""",
    "x_ring": """
SELECT zone_id AS shape_id, 0 AS ring_no, pos, lon, lat FROM f_zone_vertex
UNION ALL SELECT zone_id, 1, pos, lon * 0.5 + (-150.0E0 + zone_id * 60.0E0 + 17.5E0) * 0.5, lat * 0.5 + (-40.0E0 + zone_id * 12.0E0 + 15.0E0) * 0.5 FROM f_zone_vertex
""",
    "x_point": "SELECT event_id AS point_id, lat, lon FROM f_detection",
    # inland waters: rivers from railheads, lakes round capitals, and the sea legs that are curated inland
    "x_river": """
SELECT node_id AS line_id, 0 AS pos, lon, lat FROM f_node WHERE kind = 'railhub'
UNION ALL SELECT node_id, 1, lon + 3.3E0, lat + 1.7E0 FROM f_node WHERE kind = 'railhub' UNION ALL SELECT node_id, 2, lon + 5.1E0, lat - 2.2E0 FROM f_node WHERE kind = 'railhub'
""",
    "x_lake": """
SELECT node_id AS zone_id, v.i AS pos, lon * 0.97E0 + CASE v.i WHEN 0 THEN 1.6E0 WHEN 2 THEN -1.6E0 ELSE 0.0E0 END AS lon, lat + CASE v.i WHEN 1 THEN 1.2E0 WHEN 3 THEN -1.2E0 ELSE 0.0E0 END AS lat
FROM f_node CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(i) WHERE kind = 'capital'
""",
    "x_inland": "SELECT e.edge_id FROM f_edge e JOIN f_node n ON n.node_id = e.src WHERE e.mode = 'sea' AND n.kind <> 'seaport'",
    # places as they are now, most of them newer than the generated legs
    "x_grown_node": "SELECT n.node_id + v.i * 1000000000 AS node_id, n.kind FROM f_node n CROSS JOIN (VALUES (0), (1), (2)) AS v(i)",
    # shapes' places in a mask of several words
    "x_shape_bit": "SELECT r_regionkey AS shape_id, CAST(r_regionkey * 50 AS INT) AS bit FROM region",
}
