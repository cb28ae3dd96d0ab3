"""Data-quality checks; each returns the violating rows as (check, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightgraph.functions.geo import haversine_km
from freightgraph.functions.joins import small
from freightgraph.operators.network import RES, in_cells
from freightgraph.operators.spatial import _segments, leading_run, longest_bad_run

MODES = ("sea", "air", "rail", "truck")
HAZARD_KINDS = ("earthquake", "wildfire", "cyclone", "flood", "volcano", "navwarning", "conflict")
FEEDS = ("usgs", "gdacs", "nhc", "nga", "firms")


def _rows(df: DataFrame, check: str, key: Column | str, detail: Column | str) -> DataFrame:
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(F.lit(check).alias("check"), col(key).cast("string").alias("key"), col(detail).cast("string").alias("detail"))


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _twice(df: DataFrame, check: str, *keys: str) -> DataFrame:
    many = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return _rows(many, check, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), "_n")


def _unknown(df: DataFrame, key: str, ref: DataFrame, ref_key: str, check: str, detail: str | None = None, many: bool = False) -> DataFrame:
    """Rows whose key is not in ref. ``many``: df is a large table of tags, which stays where it is if ref is small."""
    known = ref.select(F.col(ref_key).alias("_ref")).distinct()
    asked = df.select(detail, key) if detail else df.select(key).distinct()
    gone = asked.join(small(known) if many else known, F.col(key) == F.col("_ref"), "left_anti")
    return _rows(gone.distinct() if detail else gone, check, detail or key, key)


def check_feed_status(status: DataFrame, feeds: tuple[str, ...] = FEEDS) -> DataFrame:
    """Status: source, label, status, last_success, expires, retained."""
    bad = lambda cond, name: _rows(status.where(cond), name, "source", "status")
    expected = status.sparkSession.createDataFrame([(f,) for f in feeds], "feed string")
    return _all(
        bad(~F.col("source").isin(*feeds), "unknown source"), _twice(status, "duplicate source", "source"),
        bad(~F.col("status").isin("ok", "stale", "unavailable"), "bad status"), bad(F.trim("label") == "", "blank label"),
        bad("retained < 0 or retained != floor(retained)", "bad count"), bad("status = 'ok' and (last_success is null or expires is null)", "ok without timestamps"),
        bad("status = 'stale' and retained <= 0", "stale without rows"), _unknown(expected, "feed", status, "source", "missing source"),
    )


def check_nodes(node: DataFrame) -> DataFrame:
    """Duplicate ids, coordinates off the globe."""
    return _all(_twice(node, "duplicate node", "node_id"), _rows(node.where("not (abs(lat) <= 90 and abs(lon) <= 180)"), "coordinates out of range", "node_id", F.concat_ws(",", F.round("lat", 3).cast("string"), F.round("lon", 3).cast("string"))))


def check_edges(edge: DataFrame, node: DataFrame) -> DataFrame:
    """D3: unknown ends and modes, the same pair and mode twice in either direction."""
    pair = edge.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "mode")
    return _all(
        _unknown(edge, "src", node, "node_id", "unknown end", "edge_id"), _unknown(edge, "dst", node, "node_id", "unknown end", "edge_id"),
        _rows(edge.where(~F.col("mode").isin(*MODES)), "unknown mode", "edge_id", "mode"), _twice(pair, "duplicate leg", "a", "b", "mode"))


def check_generated(edge: DataFrame, node: DataFrame) -> DataFrame:
    """Generated legs whose places are gone."""
    return _all(_unknown(edge, "src", node, "node_id", "vanished node", "edge_id"), _unknown(edge, "dst", node, "node_id", "vanished node", "edge_id"))


def check_coverage(node: DataFrame, lanes: DataFrame, roads: DataFrame) -> DataFrame:
    """Generated legs are stale: more than half of the seaports without a lane, or places that are not military and have no road more than half of all places."""
    def off(nodes: DataFrame, legs: DataFrame) -> DataFrame:
        on = legs.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("on", F.lit(1))
        return nodes.join(on, "node_id", "left").where("on is null")

    def share(bare: DataFrame, of: DataFrame, name: str) -> DataFrame:
        n = bare.agg(F.count("*").alias("off")).crossJoin(of.agg(F.count("*").alias("all")))  # one row each
        return _rows(n.where("off * 2 > all"), name, "off", "all")

    ports = node.where("kind = 'seaport'")
    return _all(share(off(ports, lanes), ports, "seaports without a lane"), share(off(node.where("kind != 'military'"), roads), node, "places without a road"))


def check_gauges(edge: DataFrame, node: DataFrame, country_gauge: DataFrame, node_gauge: DataFrame) -> DataFrame:
    """Rail countries without a gauge, gauges of unknown countries and places."""
    ends = edge.where("mode = 'rail'").select(F.explode(F.array("src", "dst")).alias("node_id")).join(node, "node_id").select("country").distinct()
    return _all(_unknown(ends, "country", country_gauge, "country", "no gauge"), _unknown(country_gauge, "country", node, "country", "gauge of unknown country"), _unknown(node_gauge, "node_id", node, "node_id", "gauge of unknown node"))


def check_zones(zone: DataFrame, vertices: DataFrame, zone_mode: DataFrame, closed: DataFrame) -> DataFrame:
    """Duplicate ids, short rings, slow and closed months off the year, slow months without a factor, unknown modes. closed: zone_id, month."""
    short = vertices.groupBy("zone_id").agg(F.count("*").alias("n")).where("n < 3")
    return _all(
        _twice(zone, "duplicate zone", "zone_id"), _rows(short, "ring too short", "zone_id", "n"), _rows(zone.where("delay_month not between 1 and 12"), "bad month", "zone_id", "delay_month"),
        _rows(closed.where("month not between 1 and 12"), "bad closed month", "zone_id", "month"),
        _rows(zone.where("delay_month is not null and delay_factor is null"), "month without factor", "zone_id", "delay_month"), _rows(zone_mode.where(~F.col("mode").isin(*MODES)), "unknown mode", "zone_id", "mode"))


def check_tags(edge_zone: DataFrame, zone: DataFrame, tagged: DataFrame | None = None) -> DataFrame:
    """Legs tagged with unknown zones, zones on no leg. ``tagged`` (zone_id): the zones of ``edge_zone``, where fewer rows tell them."""
    on = edge_zone if tagged is None else tagged
    return _all(_unknown(edge_zone, "zone_id", zone, "zone_id", "unknown zone", "edge_id", many=True), _unknown(zone, "zone_id", on, "zone_id", "zone on no leg"))


def check_airspace(airspace: DataFrame, zone: DataFrame, ban: DataFrame, tags: DataFrame, node: DataFrame) -> DataFrame:
    """Airspace: shape_id, country, surcharge, modes array; ban: shape_id, country; tags: shape_id, src, dst."""
    modes = airspace.select("shape_id", F.explode("modes").alias("mode"))
    same = airspace.join(zone.select(F.col("zone_id").alias("shape_id")), "shape_id", "left_semi")
    return _all(
        _rows(same, "id collision", "shape_id", "country"), _unknown(airspace, "country", node, "country", "unknown country", "shape_id"), _rows(airspace.where("surcharge != 0"), "charge by km", "shape_id", F.round("surcharge", 3)),
        _rows(modes.where(~F.col("mode").isin(*MODES)), "unknown mode", "shape_id", "mode"),
        _unknown(ban, "country", node, "country", "unknown banned country", "shape_id"), _unknown(tags, "shape_id", airspace, "shape_id", "unknown airspace"), _unknown(tags, "src", node, "node_id", "unknown node", "shape_id"), _unknown(tags, "dst", node, "node_id", "unknown node", "shape_id"))


def check_conditions(condition: DataFrame, zone: DataFrame) -> DataFrame:
    """Conditions of unknown zones, factors outside 1 to 3."""
    return _all(_unknown(condition, "zone_id", zone, "zone_id", "unknown zone"), _rows(condition.where("not (delay_factor between 1 and 3)"), "factor out of range", "zone_id", F.round("delay_factor", 3)))


def check_borders(border: DataFrame, node: DataFrame) -> DataFrame:
    """Border: border_id, countries array, modes array, delay_hours."""
    each, modes = border.select("border_id", F.explode("countries").alias("country")), border.select("border_id", F.explode("modes").alias("mode"))
    return _all(
        _twice(border, "duplicate border", "border_id"), _rows(border.where("size(countries) != 2"), "not two countries", "border_id", F.size("countries")), _unknown(each, "country", node, "country", "unknown country", "border_id"),
        _rows(modes.where(~F.col("mode").isin(*MODES)), "unknown mode", "border_id", "mode"), _rows(border.where("delay_hours < 0 or delay_hours > 72"), "delay out of range", "border_id", F.round("delay_hours", 3)))


def check_hazards(hazard: DataFrame, zone_mode: DataFrame, tags: DataFrame, edge: DataFrame) -> DataFrame:
    """Duplicate ids, access, kinds, missing circles and modes of hazard zones; tags of unknown legs or zones."""
    return _all(
        _twice(hazard, "duplicate hazard", "zone_id"), _rows(hazard.where("access != 'hazard'"), "not a hazard", "zone_id", "access"), _rows(hazard.where(~F.col("hazard_kind").isin(*HAZARD_KINDS)), "unknown kind", "zone_id", "hazard_kind"),
        _rows(hazard.where("lat is null or lon is null or radius_km is null"), "no circle", "zone_id", "hazard_kind"), _rows(zone_mode.where(~F.col("mode").isin(*MODES)), "unknown mode", "zone_id", "mode"),
        _unknown(tags, "edge_id", edge, "edge_id", "unknown leg"), _unknown(tags, "zone_id", hazard, "zone_id", "unknown hazard"))


def check_restrictions(rule: DataFrame, node: DataFrame) -> DataFrame:
    """Rules that name unknown countries or modes."""
    sides = rule.select("rule_id", F.explode(F.array("left_country", "right_country")).alias("country"))
    return _all(_unknown(sides, "country", node, "country", "unknown country", "rule_id"), _rows(rule.where(~F.col("mode").isin(*MODES)), "unknown mode", "rule_id", "mode"))


def check_scores(node: DataFrame, scores: DataFrame, override: DataFrame, bonus: DataFrame) -> DataFrame:
    """Countries without scores, overrides of unknown places or off the scale, bonuses of unknown places."""
    return _all(
        _unknown(node.select("country").distinct(), "country", scores, "country", "no score"), _unknown(override, "node_id", node, "node_id", "override of unknown node"),
        _rows(override.where("not (fixed between 0 and 100)"), "override off the scale", "node_id", "fixed"), _unknown(bonus, "node_id", node, "node_id", "bonus of unknown node"))


def off_medium(samples: DataFrame, land: DataFrame, water: DataFrame, res: float = RES) -> DataFrame:
    """Samples of sea, rail and truck legs with ``is_bad``: off navigable water at sea, off land on rails and roads. Flights have none and are left out.

    samples: edge_id, mode, seg, s, lon, lat, …; land: (edge_id, seg, s) of samples on land; water: (x, y) of navigable cells.
    """
    sea = in_cells(samples.where("mode = 'sea'"), water, res, "_on").withColumn("is_bad", ~F.col("_on")).drop("_on")
    on = land.select("edge_id", "seg", "s").distinct().withColumn("_land", F.lit(True))
    dry = samples.where("mode in ('rail', 'truck')").join(on, ["edge_id", "seg", "s"], "left").withColumn("is_bad", F.col("_land").isNull()).drop("_land")
    return sea.unionByName(dry)


def audit_medium(samples: DataFrame, tolerance_km: float = 25.0) -> DataFrame:
    """Legs with a stretch of over 25 km off their medium, the worst first. samples: edge_id, seg, s, lon, lat, step_km, is_bad; lines' first points do not count."""
    run = longest_bad_run(samples.where("s >= 0")).where(F.col("km") > tolerance_km)
    return run.orderBy(F.desc("km"))


def needs_geometry(samples: DataFrame, inland: DataFrame, tolerance_km: float = 25.0) -> DataFrame:
    """(edge_id) of the legs to route anew: rail legs over water, and curated inland legs (edge_id) off navigable water, for over 25 km. samples: as in ``audit_medium``, with mode."""
    asked = samples.where("mode = 'rail'").unionByName(samples.where("mode = 'sea'").join(inland.select("edge_id").distinct(), "edge_id", "left_semi").select(samples.columns))
    return audit_medium(asked, tolerance_km).select("edge_id")


def ports_off_water(node: DataFrame, water: DataFrame, res: float = RES) -> DataFrame:
    """(node_id) of seaports whose cell is not navigable."""
    return in_cells(node.where("kind = 'seaport'").select("node_id", "lon", "lat"), water, res).where("not hit").select("node_id")


def audit_endpoints(samples: DataFrame, edge: DataFrame, off_water: DataFrame, tolerance_km: float = 25.0) -> DataFrame:
    """(check, node_id, km): places from which a sea lane runs off the water for over 25 km, with the longest such stretch, and seaports off the water.

    samples: of sea legs with their first points, as in ``leading_run``; off_water: node_id.
    """
    head = leading_run(samples).join(edge.select("edge_id", F.col("src").alias("node_id")), "edge_id")
    tail = leading_run(samples, from_tail=True).join(edge.select("edge_id", F.col("dst").alias("node_id")), "edge_id")
    dry = head.unionByName(tail).groupBy("node_id").agg(F.max("km").alias("km")).where(F.col("km") > tolerance_km)
    off = off_water.select(F.lit("port off water").alias("check"), "node_id", F.lit(None).cast("double").alias("km"))
    return dry.select(F.lit("lane begins on land").alias("check"), "node_id", "km").unionByName(off)


def audit_gaps(edge_point: DataFrame, max_km: float = 300.0) -> DataFrame:
    """Segments longer than 300 km or across the dateline, and sea legs without points between."""
    seg = _segments(edge_point).withColumn("km", haversine_km("lat", "lon", "lat2", "lon2"))
    bare = edge_point.where("mode = 'sea'").groupBy("edge_id").agg(F.count("*").alias("n")).where("n <= 2")
    return _all(
        _rows(seg.where(F.col("km") > max_km), "gap", "edge_id", F.concat_ws(":", F.col("seg").cast("string"), F.floor(F.round("km", 6)).cast("string"))),
        _rows(seg.where("abs(lon2 - lon) > 180"), "dateline", "edge_id", "seg"), _rows(bare, "no geometry", "edge_id", "n"))
