"""Live feeds and imports as tables of zones, points and sites."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freightgraph.functions.geo import cell_grid, cell_reach, destination_point, haversine_km, js_round

#: Hazards of the disaster feed, by event type.
EVENT_TYPES = {  # type: (kind, modes, radius Orange, radius Red, surcharge, security)
    "TC": ("cyclone", "sea", 300.0, 500.0, 4.0, 25),
    "FL": ("flood", "truck,rail", 80.0, 150.0, 3.0, 30),
    "VO": ("volcano", None, 50.0, 100.0, 5.0, 20),
}
#: What makes a broadcast warning a hazard, and how it writes a position.
HAZARD_TERMS = r"(?i)\b(firing|gunnery|missile|rocket|live fire|ordnance|unexploded|mine|minefield|piracy|pirate|naval exercise|military exercise|dangerous|prohibited|closed area|hazardous operations)\b"
POSITION = r"(\d{1,3})-(\d{1,2}(?:\.\d+)?)\s*([NSns])\s+(\d{1,3})-(\d{1,2}(?:\.\d+)?)\s*([EWew])"
#: Country names spelt otherwise in the conflict feed.
COUNTRY_ALIASES = {
    "Ivory Coast": "Côte d'Ivoire", "United States of America": "United States",
    "Bosnia-Herzegovina": "Bosnia and Herzegovina", "Macedonia, FYR": "North Macedonia",
}


def read_nodes(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Places of several JSON files."""
    out = None
    for path in paths:
        part = spark.read.schema(schema).json(path)
        out = part if out is None else out.unionByName(part)
    return out


def union_nodes(curated: DataFrame, imported: DataFrame | None) -> DataFrame:
    """Curated places, then imported ones if there are any."""
    return curated if imported is None else curated.unionByName(imported, allowMissingColumns=True)


def read_edges(layers: dict[str | None, DataFrame], node: DataFrame) -> DataFrame:
    """Legs of several tables, those of single-mode tables given their mode; legs with an unknown end are dropped."""
    out = None
    for mode, legs in layers.items():
        part = legs if mode is None else legs.withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.join(node.select(F.col("node_id").alias("src")), "src", "left_semi").join(node.select(F.col("node_id").alias("dst")), "dst", "left_semi")


def quake_zones(df: DataFrame) -> DataFrame:
    """(zone_id, lat, lon, radius_km) of quakes of magnitude 5.5 and more with a place."""
    m = F.col("magnitude")
    radius = F.when(m < 6, 60.0).when(m < 7, 120.0).when(m < 8, 220.0).otherwise(350.0)
    return df.where((m >= 5.5) & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        F.concat(F.lit("quake_"), F.col("event_id").cast("string")).alias("zone_id"), F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), radius.alias("radius_km"))


def gdacs_zones(df: DataFrame) -> DataFrame:
    """(zone_id, hazard_kind, modes, radius_km, surcharge, security, lat, lon) of current events; an unknown alert level counts as Orange."""
    spec = df.sparkSession.createDataFrame([(k, *v) for k, v in EVENT_TYPES.items()], "event_type string, hazard_kind string, modes string, orange double, red double, surcharge double, security int")
    return df.where("is_current = 'true' and lat is not null and lon is not null").join(F.broadcast(spec), "event_type").select(
        F.lower(F.concat_ws("_", F.lit("gdacs"), "event_type", F.col("event_id").cast("string"))).alias("zone_id"), "hazard_kind", "modes",
        F.when(F.col("alert_level") == "Red", F.col("red")).otherwise(F.col("orange")).alias("radius_km"), "surcharge", "security", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"))


def storm_zones(df: DataFrame) -> DataFrame:
    """Four rows a storm, now and 24, 48 and 72 hours on: place by dead reckoning, a radius that grows, the window each stands for."""
    kt = F.coalesce("intensity_kt", F.lit(0.0))
    base = F.when(kt >= 96, 300.0).when(kt >= 64, 220.0).otherwise(150.0)
    lead = F.col("lead_h")
    out = df.where("lat is not null and lon is not null").select("*", F.explode(F.array(*[F.lit(h) for h in (0, 24, 48, 72)])).alias("lead_h"))
    km = F.coalesce("speed_kt", F.lit(0.0)) * 1.852 * lead
    there = destination_point("lat", "lon", F.coalesce("heading", F.lit(0.0)), km)
    out = out.withColumn("p", F.when(lead == 0, F.struct(F.col("lon").alias("lon"), F.col("lat").alias("lat"))).otherwise(there))
    hours = lambda h: F.make_dt_interval(F.lit(0), h)
    return out.select(
        F.concat(F.lit("storm_"), F.col("event_id").cast("string"), F.lit("_"), lead.cast("string"), F.lit("h")).alias("zone_id"), lead.alias("lead_h"), (lead > 0).alias("forecast"),
        F.round("p.lat", 3).alias("lat"), F.round("p.lon", 3).alias("lon"), js_round(base + lead * 1.6).cast("long").alias("radius_km"),
        (F.col("ts") + hours(lead)).alias("active_from"), (F.col("ts") + hours(lead + 24)).alias("active_until"))


def warning_positions(df: DataFrame) -> DataFrame:
    """(doc_id, place, lat, lon): degree-minute positions in a text, within the globe."""
    at = df.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(POSITION), F.lit(0))).alias("place", "p"))
    part = lambda i: F.regexp_extract("p", POSITION, i)
    degrees = lambda d, m, h, minus: (part(d).cast("double") + part(m).cast("double") / 60) * F.when(F.upper(part(h)) == minus, -1.0).otherwise(1.0)
    return at.select("doc_id", "place", degrees(1, 2, 3, "S").alias("lat"), degrees(4, 5, 6, "W").alias("lon")).where("abs(lat) <= 90 and abs(lon) <= 180")


def navwarning_zones(df: DataFrame, now: Column) -> DataFrame:
    """(zone_id, doc_id, label, security, access, surcharge_usd_per_km, toll_usd, hazard_kind, modes, detected_at, n, lat, lon, radius_km): one circle round a hazard warning's positions; none if they lie over 600 km from their middle.

    df: doc_id, nav_area, msg_year, msg_number, issued, text. A label quotes the first 90 characters of the
    text with its blanks run together; a warning without a readable time counts as seen ``now``.
    """
    p = warning_positions(df.where(F.col("text").rlike(HAZARD_TERMS)))
    middle = p.groupBy("doc_id").agg(F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"), F.count("*").alias("n"))
    spread = p.join(middle, "doc_id").groupBy("doc_id", "c_lat", "c_lon", "n").agg(F.max(haversine_km("lat", "lon", "c_lat", "c_lon")).alias("spread"))
    radius = js_round(F.least(F.lit(300.0), F.greatest(F.lit(25.0), F.round(F.col("spread") + 25, 6))))
    quote = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 90)
    return spread.where("spread <= 600").join(df, "doc_id").select(
        F.lower(F.concat_ws("_", F.lit("navwarn"), "nav_area", F.col("msg_year").cast("string"), F.col("msg_number").cast("string"))).alias("zone_id"), "doc_id",
        F.concat(F.lit("NAVAREA "), "nav_area", F.lit(" warning — "), quote).alias("label"), F.lit(35).alias("security"), F.lit("hazard").alias("access"), F.lit(2.0).alias("surcharge_usd_per_km"),
        F.lit(0.0).alias("toll_usd"), F.lit("navwarning").alias("hazard_kind"), F.lit("sea").alias("modes"), F.coalesce(parse_dtg(F.col("issued")), now).alias("detected_at"), "n",
        F.round("c_lat", 3).alias("lat"), F.round("c_lon", 3).alias("lon"), radius.cast("long").alias("radius_km"))


def parse_dtg(text: Column) -> Column:
    """`081653Z MAY 2024` as a timestamp; null if it is none."""
    pattern = r"^\s*(\d{2})(\d{2})(\d{2})Z\s+([A-Za-z]{3})\s+(\d{4})\s*$"
    part = lambda i: F.try_to_number(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")), F.lit("9999")).cast("int")
    months = F.array(*[F.lit(m) for m in ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")])
    month = F.nullif(F.array_position(months, F.upper(F.regexp_extract(text, pattern, 4))), F.lit(0)).cast("int")
    return F.try_make_timestamp(part(5), month, part(1), part(2), part(3), F.lit(0))


def hotspot_points(df: DataFrame) -> DataFrame:
    """(event_id, lat, lon, frp) of detections that are sure enough: letters or numbers, half at least. A feed without its columns is an error, not an empty one."""
    missing = [c for c in ("event_id", "lat", "lon", "confidence", "frp") if c not in df.columns]
    if missing:
        raise ValueError(f"detections lack {', '.join(missing)}")
    c = F.trim("confidence")
    score = F.when(c == "l", 30.0).when(c == "n", 60.0).when(c == "h", 90.0).otherwise(F.coalesce(c.try_cast("double"), F.lit(0.0)))
    return df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (score >= 50)).select("event_id", "lat", "lon", F.coalesce("frp", F.lit(0.0)).alias("frp"))


def clean_country(country: Column) -> Column:
    """Without a trailing bracket, and under the usual name."""
    bare = F.trim(F.regexp_replace(F.coalesce(country, F.lit("")), r"\s*\([^)]*\)\s*$", ""))
    aliases = F.create_map(*[F.lit(x) for kv in COUNTRY_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(aliases, bare), bare)


def dedupe_increments(event: DataFrame) -> DataFrame:
    """One row an event id: that of the release read last (release_order)."""
    w = Window.partitionBy("event_id").orderBy(F.desc("release_order"))
    return event.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def conflict_points(event: DataFrame, now: Column, days: int = 90, precision: int = 3) -> DataFrame:
    """(event_id, lat, lon, deaths, country): recent events once each, well enough placed."""
    recent = event.where(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))
    return dedupe_increments(recent).where((F.col("where_prec") <= precision) & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        "event_id", "lat", "lon", F.coalesce("deaths", F.lit(0)).alias("deaths"), clean_country(F.col("country")).alias("country"))


def import_bases(df: DataFrame) -> DataFrame:
    """(item, classes, has_runway, name, country): one row an item; name and country of the first row that has a country, else of the first."""
    first = F.struct(F.col("country").isNull().cast("int").alias("n"), "row_no")
    return df.groupBy("item").agg(
        F.sort_array(F.collect_set("cls")).alias("classes"), F.bool_or(F.coalesce("runway", F.lit(False))).alias("has_runway"), F.min_by("name", first).alias("name"), F.min_by("country", first).alias("country"), F.min_by("point", first).alias("point"))


def filter_transit_sites(df: DataFrame, bad_classes: list[str], airfield_classes: list[str], bad_name: str) -> DataFrame:
    """(item, name, country, lat, lon): sites freight can use: no disqualifying class or name, a runway for pure airfields, a real name, place and country."""
    bad, air = (F.array(*[F.lit(c) for c in x]).cast("array<string>") for x in (bad_classes, airfield_classes))
    wkt = r"^Point\(([-\d.eE]+) ([-\d.eE]+)\)$"
    number = lambda i: F.nullif(F.regexp_extract("point", wkt, i), F.lit("")).try_cast("double")
    good = ~F.arrays_overlap("classes", bad) & ((F.size(F.array_except("classes", air)) > 0) | F.col("has_runway")) & ~F.col("name").rlike(bad_name) & ~F.col("name").rlike(r"^Q\d+$")
    named = F.col("country").isNotNull() & (F.col("country") != "") & ~F.col("country").rlike(r"^Q\d+$")
    return df.where(good & named).select("item", "name", clean_country(F.col("country")).alias("country"), F.round(number(2), 4).alias("lat"), F.round(number(1), 4).alias("lon")).where("abs(lat) <= 90 and abs(lon) <= 180")


def dedupe_near(df: DataFrame, ref: DataFrame, km: float = 3.0, key: str = "item") -> DataFrame:
    """Rows with no place of ``ref`` within km, met through grid cells."""
    deg, span = cell_grid(max(km, 1e-4))
    reach = cell_reach(F.col("lat"), deg, span)
    cell = lambda c: F.floor(F.col(c) / deg)
    near = df.select(key, "lat", "lon", F.explode(F.sequence(-reach, reach)).alias("dx")).select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("dy"))
    near = near.select(key, "lat", "lon", F.pmod(cell("lon") + F.col("dx"), F.lit(span)).alias("cx"), (cell("lat") + F.col("dy")).alias("cy"))
    at = ref.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.pmod(cell("lon"), F.lit(span)).alias("cx"), cell("lat").alias("cy"))
    close = near.join(at, ["cx", "cy"]).where(haversine_km("lat", "lon", "r_lat", "r_lon") <= km).select(key).distinct()
    return df.join(close, key, "left_anti")


@functools.cache
def _fold() -> tuple[str, str]:
    """Characters that decompose into an ASCII one and marks, with that one; then the marks, which go."""
    accented = {}
    for c in map(chr, range(0xC0, 0x2000)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0].isascii() and all("\u0300" <= m <= "\u036f" for m in parts[1:]):
            accented[c] = parts[0]
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(accented) + marks, "".join(accented.values())


def slug(name: Column) -> Column:
    """ASCII letters and digits with underscores between, 48 characters at most; accents are folded by canonical decomposition."""
    plain = F.lower(F.translate(name, *_fold()))
    return F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 48)


def assign_slugs(df: DataFrame, taken: DataFrame, order: str = "item") -> DataFrame:
    """Add ``slug``: unique names, also against those taken (slug).

    The first row of a name keeps it, the others get _2, _3 and so on, past every number that makes a
    taken slug or another row's own name: so no two final names are equal, whatever the order.
    """
    used = taken.select(F.col("slug").alias("_s")).distinct()
    named = df.withColumn("_s", slug(F.col("name"))).where("_s != ''")
    own = named.select("_s").distinct()
    # numbers that are not free: (_s, numbers in order), of slugs that are another name, an underscore and a number
    numbered = own.unionByName(used).distinct().select(F.regexp_extract("_s", r"^(.*)_(\d{1,9})$", 1).alias("_base"), F.regexp_extract("_s", r"^(.*)_(\d{1,9})$", 2).alias("_n"), "_s").where("_base != ''")
    barred = numbered.where("_n = cast(cast(_n as int) as string) and cast(_n as int) >= 2").groupBy(F.col("_base").alias("_s")).agg(F.sort_array(F.collect_set(F.col("_n").cast("int"))).alias("_barred"))
    w = Window.partitionBy("_s").orderBy(order)
    rows = named.join(used.withColumn("_taken", F.lit(1)), "_s", "left").join(barred, "_s", "left")
    rank = F.row_number().over(w) + F.coalesce("_taken", F.lit(0))
    rows = rows.withColumn("_rank", rank)
    free = F.aggregate(F.coalesce("_barred", F.array().cast("array<int>")), F.col("_rank"), lambda n, b: F.when(b <= n, n + 1).otherwise(n))
    out = rows.withColumn("slug", F.when(F.col("_rank") == 1, F.col("_s")).otherwise(F.concat("_s", F.lit("_"), free.cast("string"))))
    return out.select(*df.columns, "slug")


def read_edge_tags(df: DataFrame) -> DataFrame:
    """(src, dst, mode, zone_id, km) from rows of a leg key `from|to|mode` and a JSON map of zones."""
    long = df.select(F.split("leg_key", r"\|").alias("k"), F.explode(F.from_json("zones", "map<string,double>")).alias("zone_id", "km"))
    return long.select(F.col("k")[0].alias("src"), F.col("k")[1].alias("dst"), F.col("k")[2].alias("mode"), "zone_id", "km")


