"""Access rules: cargo, modes, stops, zones in effect, borders, gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightgraph.functions.joins import small

PLANNING_HORIZON_DAYS = 30
DEFAULT_TONNES = 20.0


def resolve_cargo(request: DataFrame, cargo_class: DataFrame, cargo_handling: DataFrame) -> DataFrame:
    """(request_id, exclude_modes, allow_military, always_safest): a class's rule joined with those of the handling flags; unknown names add nothing.

    cargo_class and cargo_handling: name, exclude_modes array, allow_military, always_safest.
    """
    names = request.select("request_id", F.col("cargo_class").alias("name")).join(cargo_class, "name").unionByName(
        request.select("request_id", F.explode("handling").alias("name")).join(cargo_handling, "name"))
    rules = names.groupBy("request_id").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("exclude_modes")))).alias("exclude_modes"),
        F.bool_or("allow_military").alias("allow_military"), F.bool_or("always_safest").alias("always_safest"))
    return request.select("request_id").join(rules, "request_id", "left").select(
        "request_id", F.coalesce("exclude_modes", F.array().cast("array<string>")).alias("exclude_modes"),
        F.coalesce("allow_military", F.lit(False)).alias("allow_military"), F.coalesce("always_safest", F.lit(False)).alias("always_safest"))


def allowed_modes(request: DataFrame, rule: DataFrame, mode_cfg: DataFrame) -> DataFrame:
    """(request_id, mode): asked for, not excluded, and able to carry the weight (20 t unless given)."""
    asked = request.select("request_id", F.coalesce("weight_tonnes", F.lit(DEFAULT_TONNES)).alias("tonnes"), F.explode(F.array_distinct("allowed_modes")).alias("mode"))
    held = asked.join(rule.select("request_id", "exclude_modes"), "request_id").where(~F.array_contains("exclude_modes", F.col("mode")))
    return held.join(mode_cfg.select("mode", "max_tonnes"), "mode").where("max_tonnes is null or tonnes <= max_tonnes").select("request_id", "mode")


def valid_stops(stops: DataFrame, eligible: DataFrame) -> DataFrame:
    """(request_id): two stops or more, none repeated, all eligible. stops: request_id, seq, node_id; eligible: node_id."""
    ok = stops.join(eligible.select("node_id", F.lit(True).alias("ok")).distinct(), "node_id", "left")
    totals = ok.groupBy("request_id").agg(F.count("*").alias("n"), F.count_distinct("node_id").alias("d"), F.count("ok").alias("e"))
    return totals.where("n >= 2 and n = d and n = e").select("request_id")


def eligible_nodes(node: DataFrame, node_zone: DataFrame, blocked: DataFrame) -> DataFrame:
    """(node_id) for civilian cargo: not military and in no blocked zone; the zone's modes do not matter."""
    closed = node_zone.join(blocked.select("zone_id"), "zone_id", "left_semi").select("node_id")
    return node.where("kind != 'military'").select("node_id").join(closed, "node_id", "left_anti")


def active_between(start: Column, end: Column, a: Column, b: Column) -> Column:
    """Whether a window with open ends for nulls meets [a, b], both ends included."""
    return (start.isNull() | (start <= b)) & (end.isNull() | (end >= a))


def zones_in_effect(request: DataFrame, zone: DataFrame, horizon_days: int = PLANNING_HORIZON_DAYS) -> DataFrame:
    """(depart, zone_id): zones that run in the planning window from each departure. One row a distinct departure, not a request.

    Departures meet zones on the days from which a zone is in their window; a zone with an open end
    covers the days that there are departures on. Times without a zone.
    """
    days = request.select("depart").where("depart is not null").distinct()
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    span = days.agg(F.min(day(F.col("depart"))).alias("first"), F.max(day(F.col("depart"))).alias("last"))
    zones = zone.select("zone_id", "active_from", "active_until").join(F.broadcast(span))  # one row
    low = F.greatest("first", F.coalesce(day(F.col("active_from")) - horizon_days, "first"))
    high = F.least("last", F.coalesce(day(F.col("active_until")), "last"))
    spread = zones.select("zone_id", "active_from", "active_until", low.alias("low"), high.alias("high")).where("low <= high").select("zone_id", "active_from", "active_until", F.explode(F.sequence("low", "high")).alias("day"))
    on = active_between(F.col("active_from"), F.col("active_until"), F.col("depart"), F.col("depart") + F.make_dt_interval(F.lit(horizon_days)))
    return days.withColumn("day", day(F.col("depart"))).join(spread, "day").where(on).select("depart", "zone_id")


def zone_active_at(zone: DataFrame, at: Column) -> DataFrame:
    """(zone_id, active)."""
    return zone.select("zone_id", active_between(F.col("active_from"), F.col("active_until"), at, at).alias("active"))


def blocked_zones(zone: DataFrame) -> DataFrame:
    """(cargo, zone_id): closed to civilian cargo: military-only ones, and hazards that close the place itself. None for military cargo."""
    return zone.where("access = 'military-only' or (access = 'hazard' and hazard_kind in ('earthquake', 'volcano'))").select(F.lit("civilian").alias("cargo"), "zone_id")


def closed_in_month(zone_month: DataFrame, month: DataFrame) -> DataFrame:
    """(month, zone_id): zones closed in each month. zone_month: zone_id, closed_months array."""
    return zone_month.select("zone_id", F.explode("closed_months").alias("month")).join(month, "month", "left_semi").select("month", "zone_id").distinct()


def drop_unknown_refs(df: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ref; a row with an array of keys needs all of them."""
    if dict(df.dtypes)[key].startswith("array"):
        known = ref.select(F.col(key).alias("_k")).distinct()
        rows = df.withColumn("_row", F.monotonically_increasing_id())
        missing = rows.select("_row", F.explode(key).alias("_k")).join(known, "_k", "left_anti").select("_row")
        return rows.join(missing, "_row", "left_anti").drop("_row")
    return df.join(ref.select(key).distinct(), key, "left_semi")


def picker_nodes(node: DataFrame, show_military: bool, in_use: DataFrame) -> DataFrame:
    """Nodes on offer, by kind and name: military ones only if shown or already in use."""
    used = in_use.select("node_id", F.lit(True).alias("_used")).distinct()
    keep = F.lit(show_military) | (F.col("kind") != "military") | F.col("_used").isNotNull()
    return node.join(used, "node_id", "left").where(keep).drop("_used").orderBy("kind", "name")


def missing_geometry(edge: DataFrame, edge_point: DataFrame) -> DataFrame:
    """(edge_id): sea legs without a point between their ends."""
    inner = edge_point.groupBy("edge_id").count().where("count > 2").select("edge_id")
    return edge.where("mode = 'sea'").select("edge_id").join(inner, "edge_id", "left_anti")


def edge_endpoints(edge: DataFrame, node: DataFrame) -> DataFrame:
    """Legs with both ends' columns (a_*, b_*); a leg with an unknown end is dropped."""
    side = lambda p: node.select(*[F.col(c).alias(f"{p}_{c}") for c in node.columns])
    return edge.join(side("a"), F.col("src") == F.col("a_node_id")).join(side("b"), F.col("dst") == F.col("b_node_id"))


def merge_edge_zones(*layers: DataFrame) -> DataFrame:
    """(edge_id, zone_id, km): of several tag tables, a later one wins for each leg and zone."""
    out = None
    for i, layer in enumerate(layers):
        part = layer.select("edge_id", "zone_id", "km", F.lit(i).alias("priority"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("edge_id", "zone_id").agg(F.max_by("km", "priority").alias("km"))


def _pair_join(edge: DataFrame, node: DataFrame, rule: DataFrame) -> DataFrame:
    """Legs between two countries that a rule names, in either order: edge_id with the rule's columns."""
    ends = edge_endpoints(edge, node.select("node_id", "country")).where("a_country != b_country")
    legs = ends.select("edge_id", "mode", F.least("a_country", "b_country").alias("low"), F.greatest("a_country", "b_country").alias("high"))
    rules = rule.withColumn("low", F.least("left_country", "right_country")).withColumn("high", F.greatest("left_country", "right_country"))
    return legs.join(rules, ["low", "high", "mode"])


def border_closed(edge: DataFrame, node: DataFrame, border_rule: DataFrame) -> DataFrame:
    """(edge_id, rule_id) of civilian legs over a closed border; the first rule wins. Domestic legs are never closed."""
    return _pair_join(edge, node, border_rule).groupBy("edge_id").agg(F.min("rule_id").alias("rule_id"))


def border_delay(edge: DataFrame, node: DataFrame, border_status: DataFrame) -> DataFrame:
    """(edge_id, label, delay_hours): live queue on a leg's border; the first entry wins."""
    return _pair_join(edge, node, border_status).groupBy("edge_id").agg(F.min_by("label", "rule_id").alias("label"), F.min_by("delay_hours", "rule_id").alias("delay_hours"))


def overflight_detour(edge: DataFrame, node: DataFrame, edge_zone: DataFrame, zone: DataFrame, ban: DataFrame, by: tuple[str, ...] = (), like: DataFrame | None = None) -> DataFrame:
    """(*by, edge_id, detour): product of the factors of crossed zones; a zone with a ban list counts only if both ends are on it.

    zone: zone_id, detour_factor; ban: zone_id, country. With ``like`` (edge_id, like), ``edge_zone`` has the zones of
    legs that are alike once, under the name that they share. Zones with the same list are multiplied before the ends are looked at.
    """
    ends = edge_endpoints(edge, node.select("node_id", "country")).select("edge_id", "a_country", "b_country")
    lists = ban.groupBy("zone_id").agg(F.sort_array(F.collect_set("country")).alias("closed_to"))
    factors = zone.where("detour_factor is not null").select("zone_id", "detour_factor").join(lists, "zone_id", "left")
    lists_met = edge_zone.join(small(factors), "zone_id").groupBy(*by, "edge_id", "closed_to").agg(F.product("detour_factor").alias("detour_factor"))
    if like is not None:
        lists_met = like.join(lists_met.withColumnRenamed("edge_id", "like"), "like")
    crossed = lists_met.join(ends, "edge_id")
    hit = F.col("closed_to").isNull() | (F.array_contains("closed_to", F.col("a_country")) & F.array_contains("closed_to", F.col("b_country")))
    return crossed.where(hit).groupBy(*by, "edge_id").agg(F.product("detour_factor").alias("detour"))


def gauge_of(node: DataFrame, node_gauge: DataFrame, country_gauge: DataFrame, default: int = 1435) -> DataFrame:
    """(node_id, gauge): the node's own, else its country's, else the default."""
    return (
        node.join(node_gauge.select("node_id", F.col("gauge").alias("own")), "node_id", "left")
        .join(country_gauge.select("country", F.col("gauge").alias("usual")), "country", "left")
        .select("node_id", F.coalesce("own", "usual", F.lit(default)).alias("gauge"))
    )


def break_of_gauge(edge: DataFrame, gauge: DataFrame, compatible: DataFrame) -> DataFrame:
    """(edge_id, from_mm, to_mm, label): rail legs between gauges that differ and are not in one group (compatible: a, b, both ways)."""
    legs = (
        edge.where("mode = 'rail'").join(gauge.select(F.col("node_id").alias("src"), F.col("gauge").alias("from_mm")), "src")
        .join(gauge.select(F.col("node_id").alias("dst"), F.col("gauge").alias("to_mm")), "dst").where("from_mm != to_mm")
    )
    open_pairs = compatible.select(F.col("a").alias("from_mm"), F.col("b").alias("to_mm"))
    return legs.join(open_pairs, ["from_mm", "to_mm"], "left_anti").select(
        "edge_id", "from_mm", "to_mm", F.concat_ws(" → ", F.col("from_mm").cast("string"), F.col("to_mm").cast("string")).alias("label"))
