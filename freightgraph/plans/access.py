"""Queries of access rules, joins and leg prices (F, J, C, A1–A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightgraph.functions.joins import small
from freightgraph.functions.scratch import written
from freightgraph.operators import indices, network, planning, pricing, routes, rules, spatial
from freightgraph.plans.tables import ORACLE_VIEWS, Tables, km_sql, query

TIER_SQL = "(least(d, 500) * 1.9 + greatest(least(d, 1500) - 500, 0) * 1.35 + greatest(least(d, 5000) - 1500, 0) * 1.05 + greatest(d - 5000, 0) * 1.0)"
ORACLE_VIEWS |= {
    "o_cost": f"""SELECT edge_id, src, dst, mode, {TIER_SQL} * usd_per_km AS usd, d / km_per_hour AS hours, d AS km FROM
  (SELECT e.*, m.usd_per_km, m.km_per_hour, k.km * m.detour_factor AS d FROM f_edge e JOIN o_km k ON k.edge_id = e.edge_id JOIN f_mode m ON m.mode = e.mode)""",
    "o_hub": """SELECT n.node_id, n.mode, m.hub_usd * (1.6e0 + (0.9e0 - 1.6e0) * (econ / 100.0e0)) AS usd, m.hub_hours * (2.2e0 + (0.6e0 - 2.2e0) * (econ / 100.0e0)) AS hours
FROM (SELECT src AS node_id, mode FROM f_edge UNION SELECT dst, mode FROM f_edge) n JOIN x_econ x ON x.node_id = n.node_id JOIN f_mode m ON m.mode = n.mode""",
    "o_gauge": "SELECT n.node_id, coalesce(g.gauge, c.gauge, 1435) AS gauge FROM f_node n LEFT JOIN x_node_gauge g ON g.node_id = n.node_id LEFT JOIN x_country_gauge c ON c.country = n.country",
    "o_break": """SELECT e.edge_id, a.gauge AS from_mm, b.gauge AS to_mm, concat(a.gauge, ' → ', b.gauge) AS label FROM f_edge e JOIN o_gauge a ON a.node_id = e.src JOIN o_gauge b ON b.node_id = e.dst
WHERE e.mode = 'rail' AND a.gauge <> b.gauge AND NOT EXISTS (SELECT 1 FROM x_compatible c WHERE c.a = a.gauge AND c.b = b.gauge)""",
    "o_blocked": "SELECT zone_id FROM f_zone WHERE access = 'military-only' OR (access = 'hazard' AND hazard_kind IN ('earthquake', 'volcano'))",
    "o_closed": """SELECT e.edge_id, min(r.rule_id) AS rule_id FROM f_edge e JOIN f_node a ON a.node_id = e.src JOIN f_node b ON b.node_id = e.dst JOIN f_border_rule r ON r.mode = e.mode
  AND ((r.left_country = a.country AND r.right_country = b.country) OR (r.left_country = b.country AND r.right_country = a.country)) WHERE a.country <> b.country GROUP BY e.edge_id""",
    "o_usable": """SELECT edge_id FROM f_edge WHERE mode <> 'air' AND edge_id NOT IN (SELECT edge_id FROM o_closed) AND edge_id NOT IN (SELECT x.edge_id FROM x_edge_zone x JOIN o_blocked b ON b.zone_id = x.zone_id)""",
}


def costs(t: Tables) -> DataFrame:
    """Legs priced without zones: what the search runs on."""
    km = spatial.polyline_km(t.f_edge_point)
    none = t.spark.createDataFrame([], "edge_id long, detour double")
    return pricing.leg_cost(t.f_edge, pricing.leg_distance(t.f_edge, km, t.f_mode, none), t.f_mode)


def hubs(t: Tables) -> DataFrame:
    return pricing.hub_cost(t.f_edge, t.x_econ, t.f_mode)


def requests(t: Tables) -> DataFrame:
    """Requests with arrays of flags and modes."""
    return t.f_request.select("*", F.array("handling").alias("flags"), F.array(*[F.lit(m) for m in ("sea", "air", "rail", "truck")]).alias("allowed_modes")).drop("handling").withColumnRenamed("flags", "handling")


def cargo_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    names = "name string, exclude_modes array<string>, allow_military boolean, always_safest boolean"
    classes = t.spark.createDataFrame([("civilian", [], False, False), ("military", [], True, False)], names)
    return classes, t.spark.createDataFrame([("hazmat", ["air"], False, False), ("perishable", ["sea"], False, False), ("hvt", [], False, True)], names)


def cargo_rules(t: Tables) -> DataFrame:
    return rules.resolve_cargo(requests(t), *cargo_tables(t))


@query("""SELECT request_id, CASE handling WHEN 'hazmat' THEN 'air' WHEN 'perishable' THEN 'sea' ELSE '' END AS exclude_modes, cargo_class = 'military' AS allow_military, FALSE AS always_safest FROM f_request""")
def f1_resolve_cargo(t: Tables) -> DataFrame:
    return cargo_rules(t).withColumn("exclude_modes", F.array_join("exclude_modes", ","))


@query("""SELECT request_id, mode FROM f_request CROSS JOIN f_mode WHERE weight_tonnes <= max_tonnes AND NOT (handling = 'hazmat' AND mode = 'air') AND NOT (handling = 'perishable' AND mode = 'sea')""")
def f2_allowed_modes(t: Tables) -> DataFrame:
    return rules.allowed_modes(requests(t), cargo_rules(t), t.f_mode)


@query("SELECT request_id FROM x_stop s LEFT JOIN f_node n ON n.node_id = s.node_id AND n.kind <> 'military' GROUP BY request_id HAVING count(*) >= 2 AND count(*) = count(DISTINCT s.node_id) AND count(*) = count(n.node_id)")
def f3_valid_stops(t: Tables) -> DataFrame:
    return rules.valid_stops(t.x_stop, t.f_node.where("kind != 'military'"))


@query(f"""SELECT node_id FROM f_node WHERE kind <> 'military' AND node_id NOT IN (SELECT p.node_id FROM f_node p JOIN f_zone z ON {km_sql('p.lat', 'p.lon', 'z.lat', 'z.lon')} <= z.radius_km WHERE z.zone_id IN (SELECT zone_id FROM o_blocked))""")
def f4_eligible_nodes(t: Tables) -> DataFrame:
    at = spatial.point_in_circle(t.f_node.select(F.col("node_id").alias("point_id"), "lat", "lon"), t.f_zone)
    return rules.eligible_nodes(t.f_node, at.withColumnRenamed("point_id", "node_id"), rules.blocked_zones(t.f_zone))


@query("SELECT d.depart, zone_id FROM (SELECT DISTINCT depart FROM x_depart) d JOIN f_zone z ON z.active_from <= d.depart + INTERVAL 2 DAY AND z.active_until >= d.depart")
def f5_zones_in_effect(t: Tables) -> DataFrame:
    return rules.zones_in_effect(t.x_depart, t.f_zone, 2)


@query("SELECT zone_id, TIMESTAMP '2024-01-06 00:00:00' BETWEEN active_from AND active_until AS active FROM f_zone")
def f6_zone_active_at(t: Tables) -> DataFrame:
    return rules.zone_active_at(t.f_zone, F.expr("TIMESTAMP_NTZ '2024-01-06 00:00:00'"))


@query("SELECT 'civilian' AS cargo, zone_id FROM o_blocked")
def f7_blocked_zones(t: Tables) -> DataFrame:
    return rules.blocked_zones(t.f_zone)


@query("SELECT DISTINCT month, zone_id FROM (SELECT CAST(delay_month AS BIGINT) AS month, zone_id FROM f_zone UNION ALL SELECT CAST(delay_month % 12 + 1 AS BIGINT), zone_id FROM f_zone) WHERE month IN (SELECT month FROM f_request)")
def f8_closed_in_month(t: Tables) -> DataFrame:
    months = t.f_zone.select("zone_id", F.array(F.col("delay_month").cast("long"), (F.col("delay_month") % 12 + 1).cast("long")).alias("closed_months"))
    return rules.closed_in_month(months, t.f_request.select(F.col("month").cast("long").alias("month")).distinct())


@query("SELECT rule_id, left_country, right_country, mode FROM f_border_rule WHERE left_country IN (SELECT country FROM x_score) AND right_country IN (SELECT country FROM x_score)")
def f9_drop_unknown_refs(t: Tables) -> DataFrame:
    rows = t.f_border_rule.withColumn("country", F.array("left_country", "right_country"))
    return rules.drop_unknown_refs(rows, t.x_score, "country").drop("country")


@query("SELECT node_id, name, kind FROM f_node WHERE kind <> 'military' OR node_id IN (SELECT origin FROM f_request WHERE request_id % 50 = 0)")
def f10_picker_nodes(t: Tables) -> DataFrame:
    used = t.f_request.where("request_id % 50 = 0").select(F.col("origin").alias("node_id"))
    return rules.picker_nodes(t.f_node, False, used).select("node_id", "name", "kind")


@query("SELECT edge_id FROM f_edge WHERE mode = 'sea' AND edge_id % 3 = 0")
def f11_missing_geometry(t: Tables) -> DataFrame:
    return rules.missing_geometry(t.f_edge, t.f_edge_point.where("pos != 1 or edge_id % 3 != 0"))


@query("SELECT e.edge_id, a.country AS a_country, b.country AS b_country FROM f_edge e JOIN f_node a ON a.node_id = e.src JOIN f_node b ON b.node_id = e.dst")
def j1_edge_endpoints(t: Tables) -> DataFrame:
    return rules.edge_endpoints(t.f_edge, t.f_node).select("edge_id", "a_country", "b_country")


@query("SELECT edge_id, zone_id, coalesce(h.km, s.km) AS km FROM x_edge_zone s FULL JOIN x_hazard_edge_zone h USING (edge_id, zone_id)")
def j2_merge_edge_zones(t: Tables) -> DataFrame:
    return rules.merge_edge_zones(t.x_edge_zone, t.x_hazard_edge_zone)


@query("SELECT edge_id, rule_id FROM o_closed")
def j4_border_closed(t: Tables) -> DataFrame:
    return rules.border_closed(t.f_edge, t.f_node, t.f_border_rule)


@query("SELECT c.edge_id, r.label, r.delay_hours FROM o_closed c JOIN (SELECT DISTINCT rule_id, label, delay_hours FROM x_border_status) r ON r.rule_id = c.rule_id")
def j5_border_delay(t: Tables) -> DataFrame:
    return rules.border_delay(t.f_edge, t.f_node, t.x_border_status)


@query("""SELECT x.edge_id, round(product(d.detour_factor), 6) AS detour FROM x_edge_zone x JOIN x_detour d ON d.zone_id = x.zone_id JOIN f_edge e ON e.edge_id = x.edge_id JOIN f_node a ON a.node_id = e.src JOIN f_node b ON b.node_id = e.dst
WHERE d.detour_factor IS NOT NULL AND (x.zone_id NOT IN (SELECT zone_id FROM x_ban) OR (EXISTS (SELECT 1 FROM x_ban z WHERE z.zone_id = x.zone_id AND z.country = a.country) AND EXISTS (SELECT 1 FROM x_ban z WHERE z.zone_id = x.zone_id AND z.country = b.country))) GROUP BY x.edge_id""")
def j6_overflight_detour(t: Tables) -> DataFrame:
    like, edge_zone = t.alike()
    return rules.overflight_detour(t.f_edge, t.f_node, edge_zone, t.x_detour, t.x_ban, like=like).withColumn("detour", F.round("detour", 6))


@query("SELECT node_id, gauge FROM o_gauge")
def j7_gauge_of(t: Tables) -> DataFrame:
    return rules.gauge_of(t.f_node, t.x_node_gauge, t.x_country_gauge)


def breaks(t: Tables) -> DataFrame:
    return rules.break_of_gauge(t.f_edge, rules.gauge_of(t.f_node, t.x_node_gauge, t.x_country_gauge), t.x_compatible)


@query("SELECT edge_id, from_mm, to_mm, label FROM o_break")
def j8_break_of_gauge(t: Tables) -> DataFrame:
    return breaks(t)


@query("""SELECT p.edge_id, CAST(2 - p.pos AS INTEGER) AS pos, p.lon, p.lat, CASE WHEN b.edge_id IS NULL THEN '' ELSE concat(b.to_mm, ' → ', b.from_mm) END AS gauge FROM f_edge_point p LEFT JOIN o_break b ON b.edge_id = p.edge_id""")
def p7_reverse_leg(t: Tables) -> DataFrame:
    points, gauge = pricing.reverse_leg(t.f_edge_point, breaks(t))
    return points.join(gauge.select("edge_id", F.col("label").alias("gauge")), "edge_id", "left").select("edge_id", "pos", "lon", "lat", F.coalesce("gauge", F.lit("")).alias("gauge"))


@query(f"""SELECT src, dst, round(km, 3) AS km FROM (SELECT a.node_id AS src, b.node_id AS dst, {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km,
  row_number() OVER (PARTITION BY a.node_id ORDER BY round({km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6), b.node_id) AS r FROM f_node a JOIN f_node b ON b.kind = 'airport' WHERE a.kind <> 'airport') WHERE r <= 3""")
def j9_knn_hubs(t: Tables) -> DataFrame:
    return network.knn_hubs(t.f_node.where("kind != 'airport'"), t.f_node.where("kind = 'airport'")).withColumn("km", F.round("km", 3))


@query("SELECT a.node_id AS src, b.node_id AS dst FROM f_node a JOIN f_node b ON a.node_id < b.node_id WHERE a.kind = 'airport' AND b.kind = 'airport'")
def j10_air_mesh(t: Tables) -> DataFrame:
    return network.air_mesh(t.f_node.where("kind = 'airport'"))


@query(f"""SELECT a.node_id AS src, b.node_id AS dst FROM f_node a JOIN f_node b ON a.node_id < b.node_id WHERE a.kind = 'airport' AND b.kind = 'airport' UNION ALL SELECT src, dst FROM (SELECT a.node_id AS src, b.node_id AS dst,
  row_number() OVER (PARTITION BY a.node_id ORDER BY round({km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6), b.node_id) AS r FROM f_node a JOIN f_node b ON b.kind = 'airport' WHERE a.kind <> 'airport') WHERE r <= 3 AND (SELECT count(*) FROM f_node WHERE kind = 'airport') > 1
UNION SELECT a.node_id, b.node_id FROM f_node a JOIN f_node b ON a.node_id < b.node_id WHERE (SELECT count(*) FROM f_node WHERE kind = 'airport') < 2""")
def j10_air_network(t: Tables) -> DataFrame:
    return network.air_network(t.f_node, t.f_node.where("kind = 'airport'"))


@query(f"""SELECT src, dst, round(min(km), 3) AS straight_km FROM (SELECT least(a, b) AS src, greatest(a, b) AS dst, km FROM (SELECT a.node_id AS a, b.node_id AS b, {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km,
  row_number() OVER (PARTITION BY a.node_id ORDER BY round({km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6), b.node_id) AS r FROM f_node a JOIN f_node b ON a.node_id <> b.node_id AND a.country_key % 2 = b.country_key % 2
  WHERE {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 2500) WHERE r <= 4) GROUP BY src, dst""")
def j11_truck_candidates(t: Tables) -> DataFrame:
    return network.truck_candidates(t.f_node.withColumn("landmass", F.col("country_key") % 2), 2500, 4).withColumn("straight_km", F.round("straight_km", 3))


@query(f"""SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT a.node_id AS a, b.node_id AS b, row_number() OVER (PARTITION BY a.node_id ORDER BY round({km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6), b.node_id) AS r
  FROM f_node a JOIN f_node b ON a.node_id <> b.node_id WHERE a.kind = 'seaport' AND b.kind = 'seaport') WHERE r <= 5 EXCEPT SELECT least(src, dst), greatest(src, dst) FROM f_edge""")
def j12_sea_candidates(t: Tables) -> DataFrame:
    return network.sea_candidates(t.f_node.where("kind = 'seaport'"), t.f_edge, 5)


@query(f"""SELECT e.src, e.dst, round(k.km, 3) AS km FROM f_edge e JOIN o_km k ON k.edge_id = e.edge_id JOIN f_node a ON a.node_id = e.src JOIN f_node b ON b.node_id = e.dst
WHERE e.mode = 'sea' AND e.edge_id % 5 <> 0 AND k.km <= 3 * {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}""")
def j13_sea_candidate_filter(t: Tables) -> DataFrame:
    return network.sea_candidate_filter(t.x_lane_point, t.f_node).withColumn("km", F.round("km", 3))


TOKENS = "(SELECT program_id, unnest(regexp_split_to_array(upper(program_id), '[-_ ]+')) AS token, generate_subscripts(regexp_split_to_array(upper(program_id), '[-_ ]+'), 1) AS pos FROM f_program)"
ORACLE_VIEWS["o_program_country"] = f"SELECT program_id, arg_min(country, pos) AS country FROM {TOKENS} p JOIN x_token t ON t.token = p.token GROUP BY program_id"


@query("SELECT program_id, country FROM o_program_country")
def j14_program_country(t: Tables) -> DataFrame:
    return indices.program_country(t.f_program, t.x_token)


@query(f"SELECT edge_id, round({TIER_SQL} * 0.12, 3) AS usd FROM (SELECT edge_id, km AS d FROM o_km)")
def c1_tapered_usd(t: Tables) -> DataFrame:
    return spatial.polyline_km(t.f_edge_point).select("edge_id", F.round(pricing.tapered_usd(F.col("km"), F.lit(0.12)), 3).alias("usd"))


@query("""SELECT e.edge_id, round(k.km * m.detour_factor * coalesce(d.f, 1), 3) AS distance_km FROM f_edge e JOIN o_km k ON k.edge_id = e.edge_id JOIN f_mode m ON m.mode = e.mode
LEFT JOIN (SELECT x.edge_id, product(detour_factor) AS f FROM x_edge_zone x JOIN x_detour d ON d.zone_id = x.zone_id WHERE detour_factor IS NOT NULL GROUP BY x.edge_id) d ON d.edge_id = e.edge_id""")
def c2_leg_distance(t: Tables) -> DataFrame:
    none = t.spark.createDataFrame([], "zone_id long, country string")
    like, edge_zone = t.alike()
    detour = rules.overflight_detour(t.f_edge, t.f_node, edge_zone, t.x_detour, none, like=like)
    return pricing.leg_distance(t.f_edge, spatial.polyline_km(t.f_edge_point), t.f_mode, detour).withColumn("distance_km", F.round("distance_km", 3))


@query("SELECT edge_id, round(sum(km * surcharge_usd_per_km + toll_usd), 3) AS zone_usd FROM x_edge_zone x JOIN f_zone z ON z.zone_id = x.zone_id GROUP BY edge_id")
def c3_zone_charges(t: Tables) -> DataFrame:
    return t.by_alike(lambda x: pricing.zone_charges(x, t.f_zone)).withColumn("zone_usd", F.round("zone_usd", 3))


@query("SELECT edge_id, CAST(delay_month AS BIGINT) AS month, round(product(delay_factor), 6) AS factor FROM x_edge_zone x JOIN f_zone z ON z.zone_id = x.zone_id WHERE delay_month IN (SELECT month FROM f_request) GROUP BY edge_id, delay_month")
def c4_seasonal_delay(t: Tables) -> DataFrame:
    zone = t.f_zone.withColumn("delay_month", F.col("delay_month").cast("long"))
    months = t.f_request.select(F.col("month").cast("long").alias("month")).distinct()
    return t.by_alike(lambda x: pricing.seasonal_delay(x, zone, months)).withColumn("factor", F.round("factor", 6))


@query("SELECT edge_id, round(product(delay_factor), 6) AS factor FROM x_edge_zone x JOIN x_condition c ON c.zone_id = x.zone_id GROUP BY edge_id")
def c5_live_delay(t: Tables) -> DataFrame:
    return t.by_alike(lambda x: pricing.live_delay(x, t.x_condition)).withColumn("factor", F.round("factor", 6))


@query("""SELECT c.edge_id, round(c.usd + coalesce(z.u, 0) + CASE WHEN b.edge_id IS NULL THEN 0 ELSE 220 END, 3) AS usd, round(c.hours * coalesce(l.f, 1) + CASE WHEN b.edge_id IS NULL THEN 0 ELSE 18 END + coalesce(q.delay_hours, 0), 3) AS hours, round(c.km, 3) AS km
FROM o_cost c LEFT JOIN (SELECT x.edge_id, sum(km * surcharge_usd_per_km + toll_usd) AS u FROM x_edge_zone x JOIN f_zone z ON z.zone_id = x.zone_id GROUP BY x.edge_id) z ON z.edge_id = c.edge_id
LEFT JOIN (SELECT edge_id, product(delay_factor) AS f FROM x_edge_zone x JOIN x_condition c ON c.zone_id = x.zone_id GROUP BY edge_id) l ON l.edge_id = c.edge_id
LEFT JOIN o_break b ON b.edge_id = c.edge_id LEFT JOIN (SELECT o.edge_id, r.delay_hours FROM o_closed o JOIN (SELECT DISTINCT rule_id, delay_hours FROM x_border_status) r ON r.rule_id = o.rule_id) q ON q.edge_id = c.edge_id""")
def c6_leg_cost(t: Tables) -> DataFrame:
    none = t.spark.createDataFrame([], "edge_id long, detour double")
    distance = pricing.leg_distance(t.f_edge, spatial.polyline_km(t.f_edge_point), t.f_mode, none)
    out = pricing.leg_cost(
        t.f_edge, distance, t.f_mode, charges=t.by_alike(lambda x: pricing.zone_charges(x, t.f_zone)), live=t.by_alike(lambda x: pricing.live_delay(x, t.x_condition)),
        gauge=breaks(t), border=rules.border_delay(t.f_edge, t.f_node, t.x_border_status))
    return out.select("edge_id", *[F.round(c, 3).alias(c) for c in ("usd", "hours", "km")])


@query("SELECT node_id, mode, round(usd, 3) AS usd, round(hours, 3) AS hours FROM o_hub")
def c7_hub_cost(t: Tables) -> DataFrame:
    return hubs(t).select("node_id", "mode", F.round("usd", 3).alias("usd"), F.round("hours", 3).alias("hours"))


@query("SELECT request_id, round(greatest(1, weight_tonnes / 20, volume_m3 / 33), 6) AS units FROM f_request")
def c8_price_units(t: Tables) -> DataFrame:
    return t.f_request.select("request_id", F.round(pricing.price_units(F.col("weight_tonnes"), F.col("volume_m3")), 6).alias("units"))


ORACLE_VIEWS["o_risk"] = """SELECT e.edge_id, e.to_node, (1 + 8 * pow((100 - s.security) / 100.0e0, 2)) * coalesce(z.f, 1) AS factor FROM (SELECT edge_id, dst AS to_node FROM f_edge UNION ALL SELECT edge_id, src FROM f_edge) e
JOIN x_security s ON s.node_id = e.to_node LEFT JOIN (SELECT edge_id, product(1 + 8 * pow((100 - security) / 100.0e0, 2)) AS f FROM x_edge_zone x JOIN f_zone z ON z.zone_id = x.zone_id GROUP BY edge_id) z ON z.edge_id = e.edge_id"""


@query("SELECT edge_id, to_node, round(factor, 3) AS factor FROM o_risk")
def c9_risk_penalty(t: Tables) -> DataFrame:
    return pricing.risk_penalty(t.f_edge, t.x_security, t.by_alike(lambda x: pricing.zone_risk(x, t.f_zone))).withColumn("factor", F.round("factor", 3))


@query("SELECT edge_id FROM o_usable")
def c10_usable_legs(t: Tables) -> DataFrame:
    modes = t.f_mode.where("mode != 'air'")
    shut = rules.border_closed(t.f_edge, t.f_node, t.f_border_rule)
    blocked = rules.blocked_zones(t.f_zone).select("zone_id")
    crossing = t.by_alike(lambda x: x.join(small(blocked), "zone_id", "left_semi").groupBy("edge_id").agg(F.min("zone_id").alias("zone_id")))  # one closed zone a leg tells enough
    return pricing.usable_legs(t.f_edge, t.f_node, crossing, blocked, shut, modes).select("edge_id")


ORACLE_VIEWS["o_modes"] = "SELECT node_id, string_agg(mode, ',' ORDER BY mode) AS modes, count(*) AS n FROM (SELECT src AS node_id, mode FROM f_edge UNION SELECT dst, mode FROM f_edge) GROUP BY node_id"


@query("SELECT node_id, modes FROM o_modes")
def c11_available_modes(t: Tables) -> DataFrame:
    return pricing.available_modes(t.f_edge, t.f_node).withColumn("modes", F.array_join("modes", ","))


@query("SELECT node_id, econ FROM x_econ")
def a1_economic_index(t: Tables) -> DataFrame:
    return indices.economic_index(t.f_node, t.x_score, t.x_bonus, t.f_country)


@query("SELECT node_id, security FROM x_security")
def a2_security_index(t: Tables) -> DataFrame:
    return indices.security_index(t.f_node, t.x_score, t.x_override, t.f_country)


@query("SELECT node_id, greatest(0, 100 - 15 * (4 - n)) AS transit FROM o_modes")
def a3_transit_index(t: Tables) -> DataFrame:
    return pricing.available_modes(t.f_edge, t.f_node).select("node_id", indices.transit_index(F.col("modes")).alias("transit"))


# Routes: the oracles relax legs until nothing gets better, keeping one row a state, and follow the last legs back


def settle_sql(steps: str, starts: str, by: tuple[str, ...]) -> str:
    """Cheapest arrival of each state (*by, source, node, mode) with its last leg; ``starts`` gives *by and source."""
    k = lambda a: ", ".join(f"{a}.{c}" for c in by)
    same = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in by)
    return f"""SELECT * FROM (WITH RECURSIVE w({', '.join(by)}, source, node, mode, c, hops, edge_id, prev_mode, prev, cost) USING KEY ({', '.join(by)}, source, node, mode) AS (
  SELECT {', '.join(by)}, source, source, 'hub', 0.0e0, 0, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), 0.0e0 FROM ({starts})
  UNION (SELECT {k('n')}, n.source, n.node, n.mode, n.b.c, n.b.hops, n.b.edge_id, n.b.prev_mode, n.b.prev, n.b.cost FROM
    (SELECT {k('w')}, w.source, s.to_node AS node, s.mode, min({{'c': round(w.cost + CASE WHEN s.mode = w.mode THEN 0 ELSE s.load END + s.weight, 6), 'hops': w.hops + 1, 'edge_id': s.edge_id, 'prev_mode': w.mode, 'prev': w.node, 'cost': w.cost + CASE WHEN s.mode = w.mode THEN 0 ELSE s.load END + s.weight}}) AS b
     FROM w JOIN {steps} s ON {same('s', 'w')} AND s.node = w.node AND s.to_node <> w.source GROUP BY {k('w')}, w.source, s.to_node, s.mode) n
    LEFT JOIN recurring.w r ON {same('r', 'n')} AND r.source = n.source AND r.node = n.node AND r.mode = n.mode WHERE r.c IS NULL OR n.b.c < r.c)) SELECT * FROM w)"""


def trace_sql(settled: str, wanted: str, by: tuple[str, ...]) -> str:
    """(*by, source, target, cost, hops, path) of the best arrivals at the places that the condition ``wanted`` names."""
    keys = ", ".join(by)
    same = " AND ".join(f"r.{c} = p.{c}" for c in by)
    return f"""SELECT {keys}, source, target, cost, hops, path FROM (WITH RECURSIVE p AS (
  SELECT {keys}, source, node AS target, b.cost AS cost, b.hops AS hops, node, b.mode AS mode, CAST([] AS BIGINT[]) AS path
  FROM (SELECT {keys}, source, node, min({{'c': c, 'hops': hops, 'edge_id': edge_id, 'cost': cost, 'mode': mode}}) AS b FROM {settled} WHERE edge_id IS NOT NULL AND {wanted} GROUP BY {keys}, source, node)
  UNION ALL SELECT {', '.join('p.' + c for c in by)}, p.source, p.target, p.cost, p.hops, r.prev, r.prev_mode, list_prepend(r.edge_id, p.path)
  FROM p JOIN {settled} r ON {same} AND r.source = p.source AND r.node = p.node AND r.mode = p.mode WHERE r.edge_id IS NOT NULL) SELECT * FROM p WHERE mode = 'hub')"""


ORACLE_VIEWS |= {
    "o_step": """SELECT w.objective, c.a AS node, c.b AS to_node, c.mode, c.edge_id, CASE w.objective WHEN 'cheapest' THEN c.usd WHEN 'fastest' THEN c.hours ELSE c.km END AS weight,
  CASE w.objective WHEN 'cheapest' THEN h.usd WHEN 'fastest' THEN h.hours ELSE 0.0e0 END AS load FROM
  (SELECT edge_id, src AS a, dst AS b, mode, usd, hours, km FROM o_cost UNION ALL SELECT edge_id, dst, src, mode, usd, hours, km FROM o_cost) c
  JOIN o_hub h ON h.node_id = c.a AND h.mode = c.mode CROSS JOIN (VALUES ('cheapest'), ('fastest'), ('most-direct')) AS w(objective)""",
    "o_settled": settle_sql("o_step", "SELECT DISTINCT w.objective, n.node_id AS source FROM f_node n CROSS JOIN (SELECT DISTINCT objective FROM o_step) w", ("objective",)),
    "o_best": trace_sql("o_settled", "TRUE", ("objective",)),
    "o_seg": "SELECT * FROM (SELECT request_id, row_number() OVER w - 1 AS seg_no, node_id AS src, lead(node_id) OVER w AS dst FROM x_stop WINDOW w AS (PARTITION BY request_id ORDER BY seq)) WHERE dst IS NOT NULL",
    "o_opt": """SELECT f.* FROM (SELECT s.request_id, s.seg_no, s.src, s.dst, b.objective, b.path FROM o_seg s JOIN o_best b ON b.source = s.src AND b.target = s.dst) f
  JOIN (SELECT request_id, objective FROM (SELECT s.request_id, b.objective, count(*) AS have FROM o_seg s JOIN o_best b ON b.source = s.src AND b.target = s.dst GROUP BY ALL) JOIN (SELECT request_id, count(*) AS need FROM o_seg GROUP BY request_id) USING (request_id) WHERE have = need) k
  ON k.request_id = f.request_id AND k.objective = f.objective""",
    "o_hop": """SELECT o.request_id, o.objective, o.seg_no, o.pos, o.edge_id, c.mode, c.usd, c.hours, c.km, c.src, c.dst, o.start,
    CASE WHEN pos = 1 THEN start ELSE NULL END AS at0, lag(c.mode) OVER w AS before, lag(c.src) OVER w AS psrc, lag(c.dst) OVER w AS pdst
  FROM (SELECT request_id, objective, seg_no, src AS start, unnest(path) AS edge_id, generate_subscripts(path, 1) AS pos FROM o_opt) o JOIN o_cost c ON c.edge_id = o.edge_id WINDOW w AS (PARTITION BY o.request_id, o.objective, o.seg_no ORDER BY o.pos)""",
    "o_leg": """SELECT request_id, objective, row_number() OVER (PARTITION BY request_id, objective ORDER BY seg_no, pos) - 1 AS leg_no, seg_no, edge_id, from_node, src + dst - from_node AS to_node, mode,
    (usd + loads * hu) * units AS usd, hours + loads * hh AS hours, km FROM
  (SELECT h.*, CASE WHEN before IS DISTINCT FROM h.mode THEN 1 ELSE 0 END AS loads, b.usd AS hu, b.hours AS hh, greatest(1, r.weight_tonnes / 20, r.volume_m3 / 33) AS units FROM
   (SELECT *, CASE WHEN pos = 1 THEN start ELSE CASE WHEN src = psrc OR src = pdst THEN CASE WHEN (dst = psrc OR dst = pdst) THEN NULL ELSE src END ELSE dst END END AS from_node FROM o_hop) h
   JOIN o_hub b ON b.node_id = h.from_node AND b.mode = h.mode JOIN f_request r ON r.request_id = h.request_id)""",
    "o_eta": "SELECT *, CAST(floor(round(sum(hours) OVER (PARTITION BY request_id, objective ORDER BY leg_no), 6) + 0.5) AS BIGINT) AS eta_hours FROM o_leg",
    "o_visit": "SELECT request_id, objective, 0 AS stop_no, from_node AS node_id FROM o_leg WHERE leg_no = 0 UNION ALL SELECT request_id, objective, leg_no + 1, to_node FROM o_leg",
    "o_crossed": "SELECT l.request_id, l.objective, x.zone_id, min(l.leg_no) AS first_leg FROM o_leg l JOIN x_edge_zone x ON x.edge_id = l.edge_id GROUP BY ALL",
    "o_sign": "SELECT request_id, objective, string_agg(concat(from_node, '>', to_node, '>', mode), '|' ORDER BY leg_no) AS signature FROM o_leg GROUP BY request_id, objective",
    "o_kept": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, signature ORDER BY CASE objective WHEN 'cheapest' THEN 0 WHEN 'fastest' THEN 1 ELSE 2 END) AS r FROM o_sign) WHERE r = 1",
    "o_score": """SELECT request_id, objective, CAST(floor(round(0.6 * min(s) + 0.4 * avg(s), 6) + 0.5) AS BIGINT) AS score FROM (SELECT request_id, objective, CAST(security AS DOUBLE) AS s FROM o_visit v JOIN x_security x ON x.node_id = v.node_id
  UNION ALL SELECT request_id, objective, CAST(z.security AS DOUBLE) FROM o_crossed c JOIN f_zone z ON z.zone_id = c.zone_id) GROUP BY ALL""",
}


def graph(t: Tables) -> DataFrame:
    return pricing.state_graph(costs(t), hubs(t))


def legs_of(t: Tables) -> DataFrame:
    segments = written(routes.waypoint_segments(t.x_stop), "segments")
    ends = segments.select(F.col("src").alias("source"), F.col("dst").alias("target")).distinct()
    # the search and the legs of its paths read the same prices: they are made once
    leg, hub = written(costs(t), "costs"), written(hubs(t), "hubs")
    paths = routes.shortest_paths(routes.objectives(pricing.state_graph(leg, hub)), segments.select(F.col("src").alias("node_id")), targets=ends)
    units = t.f_request.select("request_id", pricing.price_units(F.col("weight_tonnes"), F.col("volume_m3")).alias("units"))
    return routes.reconstruct_legs(routes.complete_options(segments, paths), leg, hub, units)


MONEY = ("usd", "hours", "km")


@query("""SELECT from_node, from_mode, to_node, to_mode, round(usd, 3) AS usd, round(hours, 3) AS hours, is_load FROM (SELECT src AS from_node, mode AS from_mode, dst AS to_node, mode AS to_mode, usd, hours, FALSE AS is_load FROM o_cost
UNION ALL SELECT dst, mode, src, mode, usd, hours, FALSE FROM o_cost UNION ALL SELECT node_id, 'hub', node_id, mode, usd, hours, TRUE FROM o_hub UNION ALL SELECT node_id, mode, node_id, 'hub', 0, 0, FALSE FROM o_hub)""")
def r1_state_graph(t: Tables) -> DataFrame:
    return graph(t).select("from_node", "from_mode", "to_node", "to_mode", F.round("usd", 3).alias("usd"), F.round("hours", 3).alias("hours"), "is_load")


@query("SELECT objective, source, target, round(cost, 3) AS cost, hops, array_to_string(path, '>') AS path FROM o_best")
def r2_shortest_paths(t: Tables) -> DataFrame:
    found = routes.shortest_paths(routes.objectives(graph(t)), t.f_node)
    return found.select("objective", "source", "target", F.round("cost", 3).alias("cost"), "hops", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("""SELECT edge_id, to_node, objective, round(weight, 3) AS weight FROM (SELECT c.edge_id, c.to_node, unnest(['cheapest', 'fastest', 'most-direct', 'safest']) AS objective, unnest([usd, hours, km, usd * r.factor]) AS weight FROM
  (SELECT edge_id, dst AS to_node, usd, hours, km FROM o_cost UNION ALL SELECT edge_id, src, usd, hours, km FROM o_cost) c JOIN o_risk r ON r.edge_id = c.edge_id AND r.to_node = c.to_node)""")
def r3_objectives(t: Tables) -> DataFrame:
    risk = pricing.risk_penalty(t.f_edge, t.x_security, t.by_alike(lambda x: pricing.zone_risk(x, t.f_zone)))
    return routes.objectives(graph(t), risk).where("edge_id is not null").select("edge_id", "to_node", "objective", F.round("weight", 3).alias("weight"))


@query("SELECT request_id, seg_no, src, dst FROM o_seg")
def r4_waypoint_segments(t: Tables) -> DataFrame:
    return routes.waypoint_segments(t.x_stop)


@query("SELECT request_id, objective, leg_no, edge_id, from_node, to_node, mode, round(usd, 3) AS usd, round(hours, 3) AS hours, round(km, 3) AS km FROM o_leg")
def r5_reconstruct_legs(t: Tables) -> DataFrame:
    return legs_of(t).select("request_id", "objective", "leg_no", "edge_id", "from_node", "to_node", "mode", *[F.round(c, 3).alias(c) for c in MONEY])


@query("SELECT request_id, objective, leg_no, eta_hours FROM o_eta")
def r6_leg_eta(t: Tables) -> DataFrame:
    return routes.leg_eta(legs_of(t)).select("request_id", "objective", "leg_no", "eta_hours")


@query("""SELECT request_id, objective, round(sum(usd), 3) AS usd, round(sum(hours), 3) AS hours, count(*) AS legs, CAST(sum(change) AS BIGINT) AS transfers FROM (SELECT *, CASE WHEN lag(mode) OVER (PARTITION BY request_id, objective ORDER BY leg_no) <> mode THEN 1 ELSE 0 END AS change FROM o_leg) GROUP BY ALL""")
def r7_route_totals(t: Tables) -> DataFrame:
    return routes.route_totals(legs_of(t)).select("request_id", "objective", F.round("usd", 3).alias("usd"), F.round("hours", 3).alias("hours"), "legs", "transfers")


@query("SELECT request_id, objective, score FROM o_score")
def r8_route_security(t: Tables) -> DataFrame:
    like, edge_zone = t.alike()
    return routes.route_security(legs_of(t), t.x_security, edge_zone, t.f_zone, like=like)


@query("""SELECT k.request_id, k.objective, coalesce(z.l, '') AS zone_labels, coalesce(g.l, '') AS transshipments, coalesce(b.l, '') AS border_delays, coalesce(q.l, '') AS conditions FROM (SELECT DISTINCT request_id, objective FROM o_leg) k
LEFT JOIN (SELECT request_id, objective, string_agg(z.label, '; ' ORDER BY first_leg, c.zone_id) AS l FROM o_crossed c JOIN f_zone z ON z.zone_id = c.zone_id GROUP BY ALL) z USING (request_id, objective)
LEFT JOIN (SELECT request_id, objective, string_agg(concat(n.name, ' · ', b.label), '; ' ORDER BY leg_no) AS l FROM o_leg l JOIN o_break b ON b.edge_id = l.edge_id JOIN f_node n ON n.node_id = l.to_node GROUP BY ALL) g USING (request_id, objective)
LEFT JOIN (SELECT request_id, objective, string_agg(label, '; ' ORDER BY leg, label) AS l FROM (SELECT l.request_id, l.objective, o.label, min(l.leg_no) AS leg FROM o_leg l JOIN o_queue o ON o.edge_id = l.edge_id GROUP BY ALL) GROUP BY ALL) b USING (request_id, objective)
LEFT JOIN (SELECT request_id, objective, string_agg(label, '; ' ORDER BY leg, zone, label) AS l FROM (SELECT c.request_id, c.objective, x.label, min({'a': c.first_leg, 'z': c.zone_id}).a AS leg, min({'a': c.first_leg, 'z': c.zone_id}).z AS zone FROM o_crossed c JOIN x_condition x ON x.zone_id = c.zone_id GROUP BY ALL) GROUP BY ALL) q USING (request_id, objective)""")
def r9_route_notes(t: Tables) -> DataFrame:
    like, edge_zone = t.alike()
    return routes.route_notes(legs_of(t), edge_zone, t.f_zone, breaks(t), t.f_node, rules.border_delay(t.f_edge, t.f_node, t.x_border_status), t.x_condition, like=like)


@query("""SELECT *, CASE WHEN active THEN concat(label, ' — ', CASE hazard_kind WHEN 'earthquake' THEN 'active hazard, military transit only' WHEN 'volcano' THEN 'erupting — site closed to civilian cargo' WHEN 'wildfire' THEN 'active wildfire on this leg, expect disruption'
  WHEN 'cyclone' THEN 'tropical cyclone on this leg, expect port closures and delay' WHEN 'flood' THEN 'flooding on this leg, expect road and rail disruption' WHEN 'navwarning' THEN 'navigational warning in force on this leg' WHEN 'conflict' THEN 'armed conflict on this leg, expect closures and war-risk premiums' END) ELSE label END AS note
FROM (SELECT DISTINCT l.request_id, l.objective, z.zone_id, z.label, z.hazard_kind, d.depart + to_hours(l.eta_hours) BETWEEN z.active_from AND z.active_until AS active FROM o_eta l JOIN x_edge_zone x ON x.edge_id = l.edge_id JOIN f_zone z ON z.zone_id = x.zone_id JOIN x_depart d ON d.request_id = l.request_id WHERE z.access = 'hazard')""".replace("SELECT *, CASE", "SELECT request_id, objective, zone_id, active, CASE", 1))
def r10_hazard_timing(t: Tables) -> DataFrame:
    like, edge_zone = t.alike()
    return routes.hazard_timing(legs_of(t), edge_zone, t.f_zone, t.x_depart, like)


@query("SELECT request_id, objective, signature FROM o_kept")
def r11_dedupe_options(t: Tables) -> DataFrame:
    return routes.dedupe_options(legs_of(t))


# Requests under their own rules: sets of constraints, priced by class, searched together

HORIZON_DAYS = 2
KEYS = "civilian, month, day"
ON = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in ("civilian", "month", "day"))
ORACLE_VIEWS |= {
    "o_variant": "SELECT request_id, 'asked' AS variant FROM x_plan UNION ALL SELECT request_id, 'none' FROM x_plan UNION ALL SELECT DISTINCT request_id, flag FROM x_plan_flag",
    "o_vflag": "SELECT v.request_id, v.variant, f.flag FROM o_variant v JOIN x_plan_flag f ON f.request_id = v.request_id AND (v.variant = 'asked' OR v.variant = f.flag)",
    "o_vset": f"""SELECT *, concat(modes, '|', civilian, '|', month, '|', day) AS set_id FROM (SELECT v.request_id, v.variant, string_agg(m.mode, ',' ORDER BY m.mode) AS modes, r.cargo_class <> 'military' AS civilian, r.month, date_trunc('day', r.depart) AS day
  FROM o_variant v JOIN x_plan r ON r.request_id = v.request_id JOIN f_mode m ON r.weight_tonnes <= m.max_tonnes
  WHERE NOT EXISTS (SELECT 1 FROM o_vflag f WHERE f.request_id = v.request_id AND f.variant = v.variant AND ((f.flag = 'hazmat' AND m.mode = 'air') OR (f.flag = 'perishable' AND m.mode = 'sea'))) GROUP BY v.request_id, v.variant, {KEYS.replace('civilian', 'r.cargo_class').replace('month', 'r.month').replace('day', 'r.depart')})""",
    "o_class": f"SELECT DISTINCT {KEYS} FROM o_vset",
    "o_czone": f"""SELECT c.*, z.zone_id, c.civilian AND z.zone_id IN (SELECT zone_id FROM o_blocked) AS barred, EXISTS (SELECT 1 FROM x_closed_month m WHERE m.zone_id = z.zone_id AND m.month = c.month) AS frozen
  FROM o_class c JOIN f_zone z ON z.active_from <= c.day + INTERVAL {HORIZON_DAYS} DAY AND z.active_until >= c.day""",
    "o_place": f"""SELECT c.*, n.node_id FROM o_class c CROSS JOIN f_node n WHERE NOT c.civilian OR (n.kind <> 'military' AND NOT EXISTS
  (SELECT 1 FROM o_czone z JOIN f_zone f ON f.zone_id = z.zone_id WHERE z.barred AND {ON('z', 'c')} AND {km_sql('n.lat', 'n.lon', 'f.lat', 'f.lon')} <= f.radius_km))""",
    "o_cross": f"SELECT x.edge_id, x.km, z.* FROM x_edge_zone x JOIN o_czone z ON z.zone_id = x.zone_id",
    "o_cleg": f"""SELECT a.civilian, a.month, a.day, e.* FROM f_edge e JOIN o_place a ON a.node_id = e.src JOIN o_place b ON b.node_id = e.dst AND {ON('a', 'b')}
  WHERE NOT EXISTS (SELECT 1 FROM o_cross x WHERE x.edge_id = e.edge_id AND {ON('x', 'a')} AND (x.barred OR x.frozen)) AND NOT (a.civilian AND e.edge_id IN (SELECT edge_id FROM o_closed))""",
    "o_ceffect": f"""SELECT x.edge_id, {', '.join('x.' + k for k in KEYS.split(', '))}, sum(x.km * z.surcharge_usd_per_km + z.toll_usd) AS zone_usd, product(CASE WHEN z.delay_month = x.month THEN z.delay_factor ELSE 1 END) AS season, product(coalesce(q.delay_factor, 1)) AS live,
    product(CASE WHEN x.civilian AND d.detour_factor IS NOT NULL AND (x.zone_id NOT IN (SELECT zone_id FROM x_ban) OR (EXISTS (SELECT 1 FROM x_ban k WHERE k.zone_id = x.zone_id AND k.country = a.country) AND EXISTS (SELECT 1 FROM x_ban k WHERE k.zone_id = x.zone_id AND k.country = b.country))) THEN d.detour_factor ELSE 1 END) AS detour
  FROM o_cross x JOIN f_zone z ON z.zone_id = x.zone_id JOIN f_edge e ON e.edge_id = x.edge_id JOIN f_node a ON a.node_id = e.src JOIN f_node b ON b.node_id = e.dst LEFT JOIN x_condition q ON q.zone_id = x.zone_id LEFT JOIN x_detour d ON d.zone_id = x.zone_id GROUP BY ALL""",
    "o_queue": "SELECT o.edge_id, r.delay_hours, r.label FROM o_closed o JOIN (SELECT DISTINCT rule_id, label, delay_hours FROM x_border_status) r ON r.rule_id = o.rule_id",
    "o_ccost": f"""SELECT {KEYS}, edge_id, src, dst, mode, {TIER_SQL} * usd_per_km + zone_usd + CASE WHEN broken THEN 220 ELSE 0 END AS usd, d / km_per_hour * slow + CASE WHEN broken THEN 18 ELSE 0 END + queue AS hours, d AS km FROM
  (SELECT l.*, m.usd_per_km, m.km_per_hour, k.km * m.detour_factor * coalesce(f.detour, 1) AS d, coalesce(f.zone_usd, 0) AS zone_usd, coalesce(f.season, 1) * coalesce(f.live, 1) AS slow, b.edge_id IS NOT NULL AS broken, CASE WHEN l.civilian THEN coalesce(q.delay_hours, 0) ELSE 0 END AS queue
   FROM o_cleg l JOIN o_km k ON k.edge_id = l.edge_id JOIN f_mode m ON m.mode = l.mode LEFT JOIN o_ceffect f ON f.edge_id = l.edge_id AND {ON('f', 'l')} LEFT JOIN o_break b ON b.edge_id = l.edge_id LEFT JOIN o_queue q ON q.edge_id = l.edge_id)""",
    "o_chub": f"""SELECT DISTINCT {', '.join('l.' + k for k in KEYS.split(', '))}, h.* FROM (SELECT {KEYS}, src AS n, mode FROM o_cleg UNION SELECT {KEYS}, dst, mode FROM o_cleg) l JOIN o_hub h ON h.node_id = l.n AND h.mode = l.mode""",
    "o_crisk": f"""SELECT {', '.join('l.' + k for k in KEYS.split(', '))}, l.edge_id, l.to_node, (1 + 8 * pow((100 - s.security) / 100.0e0, 2)) * coalesce(z.f, 1) AS factor FROM (SELECT {KEYS}, edge_id, dst AS to_node FROM o_cleg UNION ALL SELECT {KEYS}, edge_id, src FROM o_cleg) l
  JOIN x_security s ON s.node_id = l.to_node LEFT JOIN (SELECT x.edge_id, {', '.join('x.' + k for k in KEYS.split(', '))}, product(1 + 8 * pow((100 - z.security) / 100.0e0, 2)) AS f FROM o_cross x JOIN f_zone z ON z.zone_id = x.zone_id GROUP BY ALL) z ON z.edge_id = l.edge_id AND {ON('z', 'l')}""",
    "o_smode": f"SELECT DISTINCT set_id, {KEYS}, unnest(string_split(modes, ',')) AS mode FROM o_vset",
    "o_sstep": f"""SELECT s.set_id, w.objective, c.a AS node, c.b AS to_node, c.mode, c.edge_id, CASE w.objective WHEN 'fastest' THEN c.hours WHEN 'most-direct' THEN c.km WHEN 'safest' THEN c.usd * r.factor ELSE c.usd END AS weight,
    CASE w.objective WHEN 'fastest' THEN h.hours WHEN 'most-direct' THEN 0.0e0 ELSE h.usd END AS load FROM
  (SELECT {KEYS}, edge_id, src AS a, dst AS b, mode, usd, hours, km FROM o_ccost UNION ALL SELECT {KEYS}, edge_id, dst, src, mode, usd, hours, km FROM o_ccost) c JOIN o_smode s ON s.mode = c.mode AND {ON('s', 'c')}
  JOIN o_chub h ON h.node_id = c.a AND h.mode = c.mode AND {ON('h', 'c')} JOIN o_crisk r ON r.edge_id = c.edge_id AND r.to_node = c.b AND {ON('r', 'c')} CROSS JOIN (VALUES ('cheapest'), ('fastest'), ('most-direct'), ('safest')) AS w(objective)""",
    "o_vseg": f"""SELECT v.request_id, v.variant, v.set_id, {', '.join('v.' + k for k in KEYS.split(', '))}, s.seg_no, s.src, s.dst FROM o_vset v JOIN o_seg s ON s.request_id = v.request_id WHERE v.request_id IN
  (SELECT request_id FROM x_stop GROUP BY request_id HAVING count(*) >= 2 AND count(*) = count(DISTINCT node_id)) AND NOT EXISTS (SELECT 1 FROM x_stop t WHERE t.request_id = v.request_id AND NOT EXISTS (SELECT 1 FROM o_place p WHERE p.node_id = t.node_id AND {ON('p', 'v')}))""",
    "o_ssettled": settle_sql("o_sstep", "SELECT DISTINCT v.set_id, w.objective, v.src AS source FROM o_vseg v CROSS JOIN (VALUES ('cheapest'), ('fastest'), ('most-direct'), ('safest')) AS w(objective)", ("set_id", "objective")),
    "o_sbest": trace_sql("o_ssettled", "(set_id, source, node) IN (SELECT (set_id, src, dst) FROM o_vseg)", ("set_id", "objective")),
    "o_vopt": """SELECT *, count(*) OVER (PARTITION BY request_id, variant, objective) AS have FROM (SELECT s.*, b.objective, b.path AS path, n.need FROM o_vseg s JOIN o_sbest b ON b.set_id = s.set_id AND b.source = s.src AND b.target = s.dst
  JOIN (SELECT request_id, count(*) AS need FROM o_seg GROUP BY request_id) n ON n.request_id = s.request_id) QUALIFY have = need""",
    "o_phop": f"""SELECT o.request_id, o.objective, {', '.join('o.' + k for k in KEYS.split(', '))}, o.seg_no, o.pos, o.edge_id, c.mode, c.usd, c.hours, c.km, c.src, c.dst, o.start, lag(c.mode) OVER w AS before, lag(c.src) OVER w AS psrc, lag(c.dst) OVER w AS pdst
  FROM (SELECT request_id, objective, {KEYS}, seg_no, src AS start, unnest(path) AS edge_id, generate_subscripts(path, 1) AS pos FROM o_vopt WHERE variant = 'asked') o JOIN o_ccost c ON c.edge_id = o.edge_id AND {ON('c', 'o')} WINDOW w AS (PARTITION BY o.request_id, o.objective, o.seg_no ORDER BY o.pos)""",
    "o_pleg": f"""SELECT request_id, objective, {KEYS}, leg_no, edge_id, from_node, to_node, mode, usd, CAST(floor(round(sum(hours) OVER (PARTITION BY request_id, objective ORDER BY leg_no), 6) + 0.5) AS BIGINT) AS eta_hours FROM
  (SELECT h.request_id, h.objective, {', '.join('h.' + k for k in KEYS.split(', '))}, row_number() OVER (PARTITION BY h.request_id, h.objective ORDER BY seg_no, pos) - 1 AS leg_no, h.edge_id, h.from_node, h.src + h.dst - h.from_node AS to_node, h.mode,
    (h.usd + CASE WHEN before IS DISTINCT FROM h.mode THEN b.usd ELSE 0 END) * greatest(1, r.weight_tonnes / 20, r.volume_m3 / 33) AS usd, h.hours + CASE WHEN before IS DISTINCT FROM h.mode THEN b.hours ELSE 0 END AS hours FROM
   (SELECT *, CASE WHEN pos = 1 THEN start WHEN src = psrc OR src = pdst THEN CASE WHEN dst = psrc OR dst = pdst THEN NULL ELSE src END ELSE dst END AS from_node FROM o_phop) h
   JOIN o_chub b ON b.node_id = h.from_node AND b.mode = h.mode AND {ON('b', 'h')} JOIN x_plan r ON r.request_id = h.request_id)""",
    "o_psign": "SELECT request_id, objective, string_agg(concat(from_node, '>', to_node, '>', mode), '|' ORDER BY leg_no) AS signature FROM o_pleg GROUP BY request_id, objective",
    "o_pkept": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, signature ORDER BY CASE objective WHEN 'cheapest' THEN 0 WHEN 'fastest' THEN 1 WHEN 'most-direct' THEN 2 ELSE 3 END) AS r FROM o_psign) WHERE r = 1",
    "o_pscore": f"""SELECT request_id, objective, CAST(floor(round(0.6 * min(s) + 0.4 * avg(s), 6) + 0.5) AS BIGINT) AS score FROM (SELECT request_id, objective, CAST(security AS DOUBLE) AS s FROM
    (SELECT request_id, objective, from_node AS node_id FROM o_pleg WHERE leg_no = 0 UNION ALL SELECT request_id, objective, to_node FROM o_pleg) v JOIN x_security x ON x.node_id = v.node_id
  UNION ALL SELECT request_id, objective, CAST(z.security AS DOUBLE) FROM (SELECT DISTINCT l.request_id, l.objective, x.zone_id FROM o_pleg l JOIN o_cross x ON x.edge_id = l.edge_id AND {ON('x', 'l')}) c JOIN f_zone z ON z.zone_id = c.zone_id) GROUP BY ALL""",
}


def planned(t: Tables) -> DataFrame:
    """Requests with their flags in an array."""
    flags = t.x_plan_flag.groupBy("request_id").agg(F.sort_array(F.collect_set("flag")).alias("handling"))
    return t.x_plan.join(flags, "request_id", "left").select(
        "*", F.array(*[F.lit(m) for m in ("sea", "air", "rail", "truck")]).alias("allowed_modes")).withColumn("handling", F.coalesce("handling", F.array().cast("array<string>")))


def network_of(t: Tables) -> planning.Network:
    at = spatial.point_in_circle(t.f_node.select(F.col("node_id").alias("point_id"), "lat", "lon"), t.f_zone)
    classes, handling = cargo_tables(t)
    like, like_zone = t.alike()
    return planning.Network(
        node=t.f_node, edge=t.f_edge, length=spatial.polyline_km(t.f_edge_point), mode=t.f_mode, zone=t.f_zone, edge_zone=t.x_edge_zone, like=like, like_zone=like_zone,
        node_zone=at.withColumnRenamed("point_id", "node_id"), closed=t.x_closed_month.withColumn("month", F.col("month").cast("long")), condition=t.x_condition, detour=t.x_detour, ban=t.x_ban,
        border_rule=t.f_border_rule, border_status=t.x_border_status, gauge_break=breaks(t), econ=t.x_econ, security=t.x_security,
        cargo_class=classes, cargo_handling=handling, horizon_days=HORIZON_DAYS,
    )


@query(f"SELECT strftime(day, '%Y-%m-%d') AS day, civilian, edge_id, round(usd, 3) AS usd, round(hours, 3) AS hours, round(km, 3) AS km FROM o_ccost")
def c6_leg_cost_by_class(t: Tables) -> DataFrame:
    """Legs under each class of constraints: what is open and in effect, season, live delay, detours, queues and gauge changes."""
    net = network_of(t)
    sets = planning.constraint_sets(net, planned(t))
    classes = sets.select("class_id", "civilian", "month", "day").distinct()
    legs = planning.price(net, classes).legs.join(classes, "class_id")
    return legs.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "civilian", "edge_id", *[F.round(c, 3).alias(c) for c in MONEY])


@query("SELECT l.request_id, l.objective, l.leg_no, l.from_node, l.to_node, l.mode, round(l.usd, 3) AS usd, l.eta_hours FROM o_pleg l JOIN o_pkept k ON k.request_id = l.request_id AND k.objective = l.objective WHERE l.objective <> 'safest'")
def r12_compute_routes(t: Tables) -> DataFrame:
    plan = planning.compute_routes(network_of(t), planned(t), t.x_stop)
    return plan.legs.select("request_id", "objective", "leg_no", "from_node", "to_node", "mode", F.round("usd", 3).alias("usd"), "eta_hours")


@query("""SELECT b.request_id, b.best, s.score AS offer FROM (SELECT request_id, greatest(0, max(score)) AS best FROM o_pscore WHERE objective <> 'safest' GROUP BY request_id) b
JOIN o_pscore s ON s.request_id = b.request_id AND s.objective = 'safest' JOIN o_pkept k ON k.request_id = b.request_id AND k.objective = 'safest'
WHERE (b.best < 30 OR b.request_id IN (SELECT request_id FROM x_plan_flag WHERE flag = 'hvt')) AND s.score > b.best""")
def r13_safer_offer(t: Tables) -> DataFrame:
    return planning.safer_offer(network_of(t), planned(t), t.x_stop)


@query("""SELECT l.request_id, CASE WHEN m.request_id IS NOT NULL THEN 'restricted military site' WHEN b.blocking IS NOT NULL THEN 'handling rules' ELSE 'no connection' END AS reason,
  CASE WHEN m.request_id IS NULL THEN coalesce(b.blocking, '') ELSE '' END AS blocking, CASE WHEN m.request_id IS NULL THEN coalesce(b.barred, '') ELSE '' END AS barred
FROM (SELECT request_id FROM x_plan EXCEPT SELECT request_id FROM o_vopt WHERE variant = 'asked') l
LEFT JOIN (SELECT DISTINCT s.request_id FROM x_stop s JOIN f_node n ON n.node_id = s.node_id JOIN x_plan r ON r.request_id = s.request_id WHERE n.kind = 'military' AND r.cargo_class <> 'military') m ON m.request_id = l.request_id
LEFT JOIN (SELECT request_id, string_agg(variant, ',' ORDER BY variant) AS blocking, string_agg(CASE variant WHEN 'hazmat' THEN 'air' WHEN 'perishable' THEN 'sea' END, ',' ORDER BY variant) AS barred FROM o_variant v
  WHERE variant NOT IN ('asked', 'none') AND request_id IN (SELECT request_id FROM o_vopt WHERE variant = 'none') AND NOT EXISTS (SELECT 1 FROM o_vopt o WHERE o.request_id = v.request_id AND o.variant = v.variant) GROUP BY request_id) b ON b.request_id = l.request_id""")
def r14_no_route_reason(t: Tables) -> DataFrame:
    return planning.no_route_reason(network_of(t), planned(t), t.x_stop)


@query("SELECT node_id, coalesce(m.modes, '') AS modes, e.econ, s.security, greatest(0, 100 - 15 * (4 - coalesce(m.n, 0))) AS transit FROM f_node LEFT JOIN o_modes m USING (node_id) JOIN x_econ e USING (node_id) JOIN x_security s USING (node_id)")
def r16_node_info(t: Tables) -> DataFrame:
    return info(t)


def info(t: Tables) -> DataFrame:
    return routes.node_info(t.f_node, pricing.available_modes(t.f_edge, t.f_node), t.x_econ.join(t.x_security, "node_id"))


@query("SELECT request_id, objective, CAST(stop_no AS BIGINT) AS stop_no, node_id, coalesce(m.modes, '') AS modes, security FROM o_visit LEFT JOIN o_modes m USING (node_id) JOIN x_security USING (node_id)")
def r17_route_stops(t: Tables) -> DataFrame:
    return routes.route_stops(legs_of(t), info(t)).select("request_id", "objective", F.col("stop_no").cast("long").alias("stop_no"), "node_id", "modes", "security")
