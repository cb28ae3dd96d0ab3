"""Leg prices and times, hub overheads, and the state graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightgraph.functions.joins import small

#: Distance brackets (up to km, share of the rate), hub factors, units and gauge change.
TIERS = ((500.0, 1.9), (1500.0, 1.35), (5000.0, 1.05), (None, 1.0))
MIN_FEE, MAX_FEE = 0.9, 1.6
MIN_DWELL, MAX_DWELL = 0.6, 2.2
TONNES_PER_UNIT, M3_PER_UNIT = 20.0, 33.0
GAUGE_USD, GAUGE_HOURS = 220.0, 18.0


def tapered_usd(km: Column, usd_per_km: Column, tiers=TIERS) -> Column:
    """A tariff whose share of the rate falls by bracket of distance."""
    total, low = F.lit(0.0), 0.0
    for high, share in tiers:
        reach = F.least(km, F.lit(high)) if high is not None else km
        total = total + F.greatest(reach - low, F.lit(0.0)) * share
        low = high or low
    return total * usd_per_km


def leg_distance(edge: DataFrame, polyline: DataFrame, mode_cfg: DataFrame, detour: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, edge_id, distance_km): length times the mode's and the overflight detour.

    Here and below, ``by`` names columns that legs and their zones carry, such as the constraints they are priced under.
    """
    keys = [*by, "edge_id"]
    return (
        edge.join(polyline, "edge_id").join(mode_cfg.select("mode", "detour_factor"), "mode").join(detour, keys, "left")
        .select(*keys, (F.col("km") * F.col("detour_factor") * F.coalesce("detour", F.lit(1.0))).alias("distance_km"))
    )


def zone_charges(edge_zone: DataFrame, zone: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, edge_id, zone_usd): surcharges by length plus each zone's toll once a leg."""
    rates = small(zone.select("zone_id", "surcharge_usd_per_km", "toll_usd"))
    return edge_zone.join(rates, "zone_id").groupBy(*by, "edge_id").agg(F.sum(F.col("km") * F.col("surcharge_usd_per_km") + F.col("toll_usd")).alias("zone_usd"))


def seasonal_delay(edge_zone: DataFrame, zone: DataFrame, months: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, edge_id, month, factor): product of the factors of crossed zones that are slow in the month; legs without any are absent."""
    slow = zone.select("zone_id", F.col("delay_month").alias("month"), "delay_factor").join(months, "month", "left_semi")
    return edge_zone.join(small(slow), "zone_id").groupBy(*by, "edge_id", "month").agg(F.product("delay_factor").alias("factor"))


def live_delay(edge_zone: DataFrame, condition: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, edge_id, factor): product of the measured factors of crossed zones."""
    return edge_zone.join(small(condition.select("zone_id", "delay_factor")), "zone_id").groupBy(*by, "edge_id").agg(F.product("delay_factor").alias("factor"))


def usable_legs(edge: DataFrame, node: DataFrame, edge_zone: DataFrame, closed_zone: DataFrame, closed_border: DataFrame, modes: DataFrame) -> DataFrame:
    """Legs of allowed modes with known ends that cross no closed zone or border."""
    shut = edge_zone.join(small(closed_zone.select("zone_id")), "zone_id", "left_semi").select("edge_id").distinct()
    return (
        edge.join(modes.select("mode"), "mode", "left_semi")
        .join(node.select(F.col("node_id").alias("src")), "src", "left_semi").join(node.select(F.col("node_id").alias("dst")), "dst", "left_semi")
        .join(shut, "edge_id", "left_anti").join(closed_border.select("edge_id"), "edge_id", "left_anti")
    )


def leg_cost(
    edge: DataFrame, distance: DataFrame, mode_cfg: DataFrame, charges=None, seasonal=None, live=None, gauge=None, border=None, by: tuple[str, ...] = (),
) -> DataFrame:
    """(*by, edge_id, src, dst, mode, usd, hours, km): tariff, zones and gauge change; driving time, slowdowns, gauge change and border queue.

    The gauge change holds for a leg under all constraints; the others are joined by ``by``, too.
    """
    keys = [*by, "edge_id"]
    out = edge.join(distance, keys).join(mode_cfg, "mode")
    zero, one = F.lit(0.0), F.lit(1.0)
    zone_usd, slow, gauge_usd, gauge_hours, queue = zero, one, zero, zero, zero
    if charges is not None:
        out, zone_usd = out.join(charges, keys, "left"), F.coalesce("zone_usd", zero)
    if seasonal is not None:
        out, slow = out.join(seasonal.select(*keys, F.col("factor").alias("season")), keys, "left"), slow * F.coalesce("season", one)
    if live is not None:
        out, slow = out.join(live.select(*keys, F.col("factor").alias("live")), keys, "left"), slow * F.coalesce("live", one)
    if gauge is not None:
        out = out.join(gauge.select("edge_id", F.lit(True).alias("broken")), "edge_id", "left")
        gauge_usd, gauge_hours = F.when(F.col("broken"), GAUGE_USD).otherwise(0.0), F.when(F.col("broken"), GAUGE_HOURS).otherwise(0.0)
    if border is not None:
        out, queue = out.join(border.select(*keys, "delay_hours"), keys, "left"), F.coalesce("delay_hours", zero)
    return out.select(
        *keys, "src", "dst", "mode",
        (tapered_usd(F.col("distance_km"), F.col("usd_per_km")) + zone_usd + gauge_usd).alias("usd"),
        (F.col("distance_km") / F.col("km_per_hour") * slow + gauge_hours + queue).alias("hours"), F.col("distance_km").alias("km"),
    )


def hub_cost(legs: DataFrame, econ: DataFrame, mode_cfg: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, node_id, mode, usd, hours): loading at each node and mode that a leg touches; a stronger economy is cheaper and quicker."""
    touched = legs.select(*by, F.col("src").alias("node_id"), "mode").unionByName(legs.select(*by, F.col("dst").alias("node_id"), "mode")).distinct()
    share = F.col("econ") / 100.0
    return touched.join(econ.select("node_id", "econ"), "node_id").join(mode_cfg, "mode").select(
        *by, "node_id", "mode", (F.col("hub_usd") * (MAX_FEE + (MIN_FEE - MAX_FEE) * share)).alias("usd"), (F.col("hub_hours") * (MAX_DWELL + (MIN_DWELL - MAX_DWELL) * share)).alias("hours"))


def price_units(tonnes: Column, m3: Column) -> Column:
    """How many units a shipment is charged as; one at least."""
    return F.greatest(F.lit(1.0), F.coalesce(tonnes, F.lit(20.0)) / TONNES_PER_UNIT, F.coalesce(m3, F.lit(0.0)) / M3_PER_UNIT)


def penalty(score: Column) -> Column:
    """1 for a safe place, up to 9."""
    return 1 + F.pow((100 - score) / 100.0, 2) * 8


def zone_risk(edge_zone: DataFrame, zone: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, edge_id, zone_factor): product of the penalties of crossed zones."""
    return edge_zone.join(small(zone.select("zone_id", penalty(F.col("security")).alias("zone_penalty"))), "zone_id").groupBy(*by, "edge_id").agg(F.product("zone_penalty").alias("zone_factor"))


def risk_penalty(legs: DataFrame, security: DataFrame, zones: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, edge_id, to_node, factor) for both directions: the arriving node's penalty times those of the crossed zones (``zone_risk``)."""
    keys = [*by, "edge_id"]
    both = legs.select(*keys, F.col("dst").alias("to_node")).unionByName(legs.select(*keys, F.col("src").alias("to_node")))
    at = security.select(F.col("node_id").alias("to_node"), F.col("security").alias("node_security"))
    return both.join(at, "to_node", "left").join(zones, keys, "left").select(
        *keys, "to_node", (F.coalesce(penalty(F.col("node_security")), F.lit(1.0)) * F.coalesce("zone_factor", F.lit(1.0))).alias("factor"))


def available_modes(edge: DataFrame, node: DataFrame) -> DataFrame:
    """(node_id, modes): modes of all legs with known ends, sorted."""
    known = edge.join(node.select(F.col("node_id").alias("src")), "src", "left_semi").join(node.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    ends = known.select(F.col("src").alias("node_id"), "mode").unionByName(known.select(F.col("dst").alias("node_id"), "mode"))
    return ends.groupBy("node_id").agg(F.sort_array(F.collect_set("mode")).alias("modes"))


HUB = "hub"


def state_graph(costs: DataFrame, hubs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, from_node, from_mode, to_node, to_mode, usd, hours, km, is_load, edge_id): travel both ways, loading from the hub state, unloading for nothing."""
    null_id = F.lit(None).cast("long")
    travel = lambda a, b: costs.select(
        *by, F.col(a).alias("from_node"), F.col("mode").alias("from_mode"), F.col(b).alias("to_node"), F.col("mode").alias("to_mode"), "usd", "hours", "km", F.lit(False).alias("is_load"), "edge_id")
    load = hubs.select(*by, F.col("node_id").alias("from_node"), F.lit(HUB).alias("from_mode"), F.col("node_id").alias("to_node"), F.col("mode").alias("to_mode"), "usd", "hours", F.lit(0.0).alias("km"), F.lit(True).alias("is_load"), null_id.alias("edge_id"))
    unload = hubs.select(*by, F.col("node_id").alias("from_node"), F.col("mode").alias("from_mode"), F.col("node_id").alias("to_node"), F.lit(HUB).alias("to_mode"), F.lit(0.0).alias("usd"), F.lit(0.0).alias("hours"), F.lit(0.0).alias("km"), F.lit(False).alias("is_load"), null_id.alias("edge_id"))
    return travel("src", "dst").unionByName(travel("dst", "src")).unionByName(load).unionByName(unload)


def reverse_leg(edge_point: DataFrame, gauge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The legs run backwards: their points (edge_id, pos, lon, lat) in reverse order, and their gauge changes with both sides swapped."""
    last = Window.partitionBy("edge_id")
    points = edge_point.select("edge_id", (F.max("pos").over(last) + F.min("pos").over(last) - F.col("pos")).alias("pos"), "lon", "lat")
    label = F.concat_ws(" → ", F.col("to_mm").cast("string"), F.col("from_mm").cast("string"))
    return points, gauge.select("edge_id", F.col("to_mm").alias("from_mm"), F.col("from_mm").alias("to_mm"), label.alias("label"))
