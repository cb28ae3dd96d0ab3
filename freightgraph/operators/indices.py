"""Scores of places and countries, live adjustments, and summaries of feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightgraph.functions.scratch import written
from freightgraph.functions.geo import js_round

DEFAULT_ECON, DEFAULT_SECURITY = 30, 50
#: Caps of the live adjustment, and the number of designations that reaches them.
SANCTIONS_SECURITY, SANCTIONS_ECON, CONFLICT_SECURITY, FULL_SCALE = 18, 12, 12, 5000


def clamp_score(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x))


def economic_index(node: DataFrame, scores: DataFrame, bonus: DataFrame, risk: DataFrame) -> DataFrame:
    """(node_id, econ): country score, city bonus and live change, within 0 to 100."""
    j = node.join(scores.select("country", "econ"), "country", "left").join(bonus.select("node_id", "bonus"), "node_id", "left").join(risk.select("country", "econ_delta"), "country", "left")
    return j.select("node_id", clamp_score(F.coalesce("econ", F.lit(DEFAULT_ECON)) + F.coalesce("bonus", F.lit(0)) + F.coalesce("econ_delta", F.lit(0))).cast("long").alias("econ"))


def security_index(node: DataFrame, scores: DataFrame, override: DataFrame, risk: DataFrame) -> DataFrame:
    """(node_id, security): the node's own value if it has one, else country score and live change within 0 to 100."""
    j = node.join(scores.select("country", "security"), "country", "left").join(override.select("node_id", "fixed"), "node_id", "left").join(risk.select("country", "security_delta"), "country", "left")
    live = clamp_score(F.coalesce("security", F.lit(DEFAULT_SECURITY)) + F.coalesce("security_delta", F.lit(0)))
    return j.select("node_id", F.coalesce("fixed", live).cast("long").alias("security"))


def transit_index(modes: Column) -> Column:
    """100 with all four modes, 15 less for each that is missing."""
    return F.greatest(F.lit(0), 100 - 15 * (4 - F.size(modes)))


def program_country(program: DataFrame, token_country: DataFrame) -> DataFrame:
    """(program_id, country): the country of an id's first token that names one."""
    tokens = program.select("program_id", F.posexplode(F.split(F.upper("program_id"), "[-_ ]+")).alias("pos", "token"))
    return tokens.join(token_country, "token").groupBy("program_id").agg(F.min_by("country", "pos").alias("country"))


def sanctions_by_country(program: DataFrame, token_country: DataFrame) -> DataFrame:
    """(country, designations, programs)."""
    return program.join(program_country(program, token_country), "program_id").groupBy("country").agg(F.sum("designations").alias("designations"), F.count("*").alias("programs"))


def _sanctions_penalty(cap: int) -> Column:
    scaled = F.log10(1 + F.coalesce("designations", F.lit(0))) / F.log10(F.lit(1.0 + FULL_SCALE))
    return js_round(F.round(F.least(F.lit(1.0), scaled) * cap, 9)).cast("long")


def country_risk(countries: DataFrame, sanctions: DataFrame, mentions: DataFrame) -> DataFrame:
    """(country, sanctions_programs, sanctions_designations, conflict_mentions, security_delta, econ_delta) of countries with nodes and a change."""
    busiest = mentions.agg(F.max("mentions").alias("busiest"))  # one row
    j = countries.select("country").distinct().join(sanctions, "country", "left").join(mentions, "country", "left").crossJoin(busiest)
    conflict = F.coalesce(js_round(F.round(F.try_divide(F.col("mentions"), F.col("busiest")) * CONFLICT_SECURITY, 9)), F.lit(0)).cast("long")
    return j.select(
        "country", F.coalesce("programs", F.lit(0)).alias("sanctions_programs"), F.coalesce("designations", F.lit(0)).alias("sanctions_designations"),
        F.coalesce("mentions", F.lit(0)).alias("conflict_mentions"), (-(_sanctions_penalty(SANCTIONS_SECURITY) + conflict)).alias("security_delta"), (-_sanctions_penalty(SANCTIONS_ECON)).alias("econ_delta"),
    ).where("security_delta != 0 or econ_delta != 0")


def mentions_by_country(article: DataFrame, watchlist: DataFrame, now: Column, days: int = 7, cap: int = 250) -> DataFrame:
    """(country, mentions): articles of watched countries in the last days, capped."""
    recent = article.where((F.col("ts") > now - F.make_dt_interval(F.lit(days))) & (F.col("ts") <= now)).join(watchlist.select("country"), "country", "left_semi")
    return recent.groupBy("country").agg(F.least(F.count("*"), F.lit(cap)).alias("mentions"))


def upper_median(df: DataFrame, by: list[str], value: str, name: str, bins: int = 1024, most: int = 100_000) -> DataFrame:
    """(*by, name, n): of an even number of values, the larger middle one. Nulls do not count.

    Equal values of a key are counted first, partly before the shuffle. A key with more than ``most`` different values is
    narrowed down by histograms: of ``bins`` equal parts of its range the one with the middle rank
    goes on, until few enough are left. So no task sorts more than ``most`` values of a key.
    """
    counted = written(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c")), "counted")
    keys = counted.groupBy(*by).agg(F.sum("_c").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_d"))
    todo = written(keys.select("*", (F.floor(F.col("n") / 2) + 1).alias("_rank"), F.lit(0).cast("long").alias("_below")), "ranges")
    upto = Window.partitionBy(*by)
    within = lambda ranges: counted.join(ranges, by).where("_v between _lo and _hi")
    while not todo.where(F.col("_d") > most).isEmpty():
        part = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
        wide = within(todo.where(F.col("_d") > most)).withColumn("_b", F.least(F.lit(bins - 1), part))
        bars = wide.groupBy(*by, "_b", "n", "_rank", "_below").agg(F.sum("_c").alias("_s"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_d"))
        run = bars.withColumn("_to", F.col("_below") + F.sum("_s").over(upto.orderBy("_b")))  # one row a bar
        found = run.where((F.col("_to") >= F.col("_rank")) & (F.col("_to") - F.col("_s") < F.col("_rank"))).select(*by, "n", "_lo", "_hi", "_d", "_rank", (F.col("_to") - F.col("_s")).alias("_below"))
        todo = written(todo.where(F.col("_d") <= most).unionByName(found), "ranges")
    run = within(todo).withColumn("_to", F.col("_below") + F.sum("_c").over(upto.orderBy("_v")))
    return run.where((F.col("_to") >= F.col("_rank")) & (F.col("_to") - F.col("_c") < F.col("_rank"))).select(*by, F.col("_v").alias(name), "n")


def border_waits(crossing: DataFrame, reportable: int = 30) -> DataFrame:
    """(border, median_minutes, open_crossings, shut_24h, delay_hours): the upper median wait of open crossings, where it is worth a report."""
    c = crossing.withColumn("closed", F.lower(F.coalesce("port_status", F.lit(""))).contains("closed"))
    waits = upper_median(c.where("not closed").withColumn("m", F.coalesce("delay_minutes", F.lit(0))), ["border"], "m", "median_minutes")
    shut = c.where(F.col("closed") & F.col("hours").rlike(r"(?i)24\s*hrs")).groupBy("border").agg(F.count("*").alias("shut_24h"))
    return waits.where(F.col("median_minutes") >= reportable).join(shut, "border", "left").select(
        "border", "median_minutes", F.col("n").alias("open_crossings"), F.coalesce("shut_24h", F.lit(0)).alias("shut_24h"), (js_round(F.col("median_minutes") / 60 * 10) / 10).alias("delay_hours"))


def reported_closures(report: DataFrame, watch: DataFrame, now: Column, days: int = 21, min_reports: int = 2, limit: int = 10) -> DataFrame:
    """(border_id, reports, delay_hours, headline): recent reports that hold all of a border's terms; the newest is the headline. watch: border_id, term."""
    recent = report.where((F.col("ts") >= now - F.make_dt_interval(F.lit(days))) & (F.col("ts") <= now))
    words = recent.select("report_id", "ts", "title", F.explode(F.array_distinct(F.split(F.lower("title"), r"\W+"))).alias("term"))
    need = watch.groupBy("border_id").agg(F.count_distinct("term").alias("need"))
    hits = words.join(watch, "term").groupBy("border_id", "report_id", "ts", "title").agg(F.count_distinct("term").alias("have")).join(need, "border_id").where("have = need")
    top = F.struct("ts", "report_id")
    return hits.groupBy("border_id").agg(F.least(F.count("*"), F.lit(limit)).alias("reports"), F.lit(12.0).alias("delay_hours"), F.max_by("title", top).alias("headline")).where(F.col("reports") >= min_reports)


def chokepoint_conditions(series: DataFrame, recent: int = 7, baseline: int = 180, below: float = 0.8, floor: int = 10, most: float = 2.0) -> DataFrame:
    """(key, recent, baseline, delay_factor) of keys whose newest points fall below their long median. series: key, period, value."""
    w = Window.partitionBy("key").orderBy(F.desc("period"))
    s = series.withColumn("r", F.row_number().over(w)).where(F.col("r") <= baseline)
    long = upper_median(s, ["key"], "value", "baseline").where(F.col("n") >= 3 * recent).where(F.col("baseline") >= floor)
    short = upper_median(s.where(F.col("r") <= recent), ["key"], "value", "recent").drop("n")
    share = F.col("recent") / F.col("baseline")
    return long.join(short, "key").where(share < below).select("key", "recent", "baseline", F.least(F.lit(most), F.round(1 / F.greatest(share, F.lit(0.1)), 2)).alias("delay_factor"))


def water_conditions(reading: DataFrame, reach: DataFrame, state_factor: DataFrame) -> DataFrame:
    """(zone_id, station, delay_factor, low, gauges): the worst gauge of a reach governs, the first of equals. reach: zone_id, station, place; state_factor: state, delay_factor."""
    j = reach.join(reading, "station").join(state_factor, "state", "left")
    worst = F.struct(F.col("delay_factor").alias("f"), (-F.col("place")).alias("p"))
    return j.groupBy("zone_id").agg(
        F.max_by("station", F.when(F.col("delay_factor").isNotNull(), worst)).alias("station"), F.max("delay_factor").alias("delay_factor"), F.count("delay_factor").alias("low"), F.count("*").alias("gauges"),
    ).where("low > 0")


def zone_counts(df: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """(key, n), the most frequent first."""
    out = df.groupBy(key).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), key).limit(top) if top else out


def release_profile(event: DataFrame) -> DataFrame:
    """(release, prec, n, share, total, oldest, newest, span_days): size and span of each release, and its events by precision of place."""
    by = event.groupBy("release", "prec").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    w = Window.partitionBy("release")
    return by.select(
        "release", "prec", "n", F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"), F.sum("n").over(w).alias("total"),
        F.to_date(F.min("lo").over(w)).alias("oldest"), F.to_date(F.max("hi").over(w)).alias("newest"), F.datediff(F.max("hi").over(w), F.min("lo").over(w)).cast("long").alias("span_days"))


def feed_profile(warning: DataFrame, pattern: str, top: int = 8) -> DataFrame:
    """(metric, value): rows, rows with a position, distinct areas, and the busiest areas."""
    one = warning.agg(F.count("*").alias("rows"), F.count_if(F.col("text").rlike(pattern)).alias("with_position"), F.count_distinct("nav_area").alias("areas"))
    flat = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns])).alias("m")).select("m.*")
    busiest = zone_counts(warning.where("nav_area is not null"), "nav_area", top).select(F.concat(F.lit("area:"), "nav_area").alias("metric"), F.col("n").alias("value"))
    return flat.unionByName(busiest)
