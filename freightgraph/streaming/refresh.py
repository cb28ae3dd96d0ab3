"""Feed refresh: retention, status, merging and history, as batch functions and as streams."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from freightgraph.functions.scratch import delete, written

MAX_AGE_HOURS = 24
HISTORY_CAP = 1460


def _day() -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(MAX_AGE_HOURS))


def refresh_source(fetched: DataFrame, outcome: DataFrame, previous: DataFrame, now: Column) -> DataFrame:
    """(source, zone_id, active_until, retained): the zones of each source after a run.

    outcome: source, ok, last_success. A source that answered has its fetched rows, which expire after a
    day unless they say otherwise; one that failed keeps its previous rows until a day after its last
    success (or, unknown, after their detection) and no longer than they say; undated rows go.
    """
    new = fetched.join(outcome.where("ok").select("source"), "source").select("source", "zone_id", F.coalesce("active_until", now + _day()).alias("active_until"), F.lit(False).alias("retained"))
    old = previous.join(outcome.where("not ok").select("source", "last_success"), "source")
    until = F.least(F.coalesce("last_success", "detected_at") + _day(), F.col("active_until"))
    kept = old.where(F.coalesce("last_success", "detected_at").isNotNull()).select("source", "zone_id", until.alias("active_until"), F.lit(True).alias("retained")).where(F.col("active_until") > now)
    return new.unionByName(kept)


def source_status(outcome: DataFrame, zones: DataFrame, now: Column) -> DataFrame:
    """(source, status, last_success, expires, retained): ok, stale with rows retained, or unavailable."""
    held = zones.where("retained").groupBy("source").agg(F.count("*").alias("n"), F.min("active_until").alias("until"))
    n = F.coalesce("n", F.lit(0))
    return outcome.join(held, "source", "left").select(
        "source", F.when(F.col("ok"), "ok").when(n > 0, "stale").otherwise("unavailable").alias("status"), F.when(F.col("ok"), now).otherwise(F.col("last_success")).alias("last_success"),
        F.when(F.col("ok"), now + _day()).otherwise(F.col("until")).alias("expires"), F.when(F.col("ok"), 0).otherwise(n).alias("retained"))


def source_freshness(status: DataFrame, now: Column) -> DataFrame:
    """(source, freshness): as read now; an expired source is unavailable."""
    expired = F.col("expires").isNotNull() & (F.col("expires") <= now)
    return status.select("source", F.when(expired, "unavailable").otherwise(F.col("status")).alias("freshness"))


def freshness_summary(freshness: DataFrame) -> DataFrame:
    """(summary): current, degraded, unavailable, or unverified without sources."""
    f = F.col("freshness")
    n = freshness.agg(F.count("*").alias("n"), F.count_if(f == "ok").alias("ok"), F.count_if(f == "unavailable").alias("gone"))
    return n.select(F.when(F.col("n") == 0, "unverified").when(F.col("ok") == F.col("n"), "current").when(F.col("gone") == F.col("n"), "unavailable").otherwise("degraded").alias("summary"))


def merge_sources(*zones: DataFrame) -> DataFrame:
    """All sources' rows, by id."""
    out = zones[0]
    for z in zones[1:]:
        out = out.unionByName(z, allowMissingColumns=True)
    return out.orderBy("zone_id")


def run_rows(zone: DataFrame, at: Column, notable: int = 40) -> DataFrame:
    """(run, total, kinds, notable): one row for each value of ``at``: its zones in all and by kind, and its first by id that are not wildfires."""
    z = zone.withColumn("run", at)
    w = Window.partitionBy("run").orderBy("zone_id")
    shown = z.where("hazard_kind != 'wildfire'").withColumn("r", F.row_number().over(w)).where(F.col("r") <= notable)
    names = shown.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list("zone_id")), lambda x: x.cast("string")), ",").alias("notable"))
    by_kind = z.groupBy("run", "hazard_kind").agg(F.count("*").alias("n"))
    kinds = by_kind.groupBy("run").agg(F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "hazard_kind", F.col("n").cast("string")))), ",").alias("kinds"))
    return kinds.join(names, "run", "left").withColumn("notable", F.coalesce("notable", F.lit("")))


def run_history(history: DataFrame, zone: DataFrame, now: Column, notable: int = 40, cap: int = HISTORY_CAP) -> DataFrame:
    """The stored runs (run, total, kinds, notable) and the present one, of ``zone``; the last 1,460 of them.

    A run without zones is a row, too. The cap is what the table is for: a year of four runs a day.
    """
    empty = zone.sparkSession.range(1).select(now.alias("run"), F.lit(0).cast("long").alias("total"), F.lit("").alias("kinds"), F.lit("").alias("notable"))
    present = run_rows(zone, now, notable)
    present = present.unionByName(empty.join(present.select(F.lit(1).alias("_some")).limit(1), F.lit(True), "left_anti"))
    return history.select("run", "total", "kinds", "notable").unionByName(present).orderBy(F.desc("run")).limit(cap)


def expire_late(zone: DataFrame, now: Column) -> DataFrame:
    """Zones still running; one without an end always is."""
    return zone.where(F.col("active_until").isNull() | (F.col("active_until") > now))


def keep_last_good(new: DataFrame, stored: DataFrame) -> DataFrame:
    """The new rows, or the stored ones if there are none."""
    some = new.limit(1).agg((F.count("*") > 0).alias("_some"))
    return new.unionByName(stored.crossJoin(F.broadcast(some)).where("not _some").drop("_some"))


def journey_trend(history: DataFrame) -> DataFrame:
    """(hazard_kind, month, runs, share): in how many of a month's runs a kind stands. history: run, hazard_kind."""
    h = history.select(F.date_format("run", "yyyy-MM").alias("month"), "run", "hazard_kind").distinct()
    total = h.groupBy("month").agg(F.count_distinct("run").alias("all_runs"))
    return h.groupBy("hazard_kind", "month").agg(F.count("*").alias("runs")).join(total, "month").select("hazard_kind", "month", "runs", F.round(F.col("runs") / F.col("all_runs"), 6).alias("share"))


# Streams


def stream_dedupe(events: DataFrame, delay: str = "30 days") -> DataFrame:
    """Events once each, the first that arrives, within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def stream_run_counts(events: DataFrame, delay: str = "1 day", hours: int = 6) -> DataFrame:
    """(window, event_type, n) of tumbling six-hour runs."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", f"{hours} hours"), "event_type").agg(F.count("*").alias("n"))


def write_last_good(zones: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch that has rows becomes a version of its own under ``path``; an empty one leaves the table as it was.

    A version counts once it is written whole (``read_last_good``), so a write that fails loses nothing;
    a batch that runs again after a failure replaces its own version only. Older ones are deleted then.
    """

    def store(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        batch.write.mode("overwrite").parquet(f"{path}/version={number:012d}")
        for old in last_good_versions(batch.sparkSession, path)[:-1]:
            delete(batch.sparkSession, old)

    return zones.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_good_versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of the whole versions, oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")) or []
    return sorted(str(f.getPath().getParent()) for f in found)


def read_last_good(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version."""
    return spark.read.parquet(last_good_versions(spark, path)[-1])


def stream_source_status(outcomes: DataFrame, delay: str = "1 day") -> DataFrame:
    """(source, status, last_success) whenever it is judged anew, from outcomes (source, ts, ok): ok, stale within a day of the last success, else unavailable.

    The state of a source is the time of its last success and its newest outcome, so an outcome that
    arrives late changes neither unless it is newer. A source that falls silent becomes unavailable by a timer of event
    time, a day after its last success, once the watermark (``delay`` behind the newest outcome of any source) has passed it.
    """
    day = pd.Timedelta(hours=MAX_AGE_HOURS)

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last, ok = (pd.Timestamp(x) if isinstance(x, datetime) else x for x in state.get) if state.exists else (None, None, False)
        for batch in batches:
            if batch.empty:  # a timer's
                continue
            good = batch.loc[batch["ok"], "ts"].max()
            at = good if pd.notna(good) and (at is None or good > at) else at
            newest = batch.loc[batch["ts"].idxmax()]
            if last is None or newest["ts"] >= last:
                last, ok = newest["ts"], bool(newest["ok"])
        until = None if at is None else int((at + day).timestamp() * 1000)
        expired = state.hasTimedOut or until is None or until <= state.getCurrentWatermarkMs() or last - at > day
        state.update((None if at is None else at.to_pydatetime(), last.to_pydatetime(), ok))
        if not expired:
            state.setTimeoutTimestamp(until)
        status = "unavailable" if expired else "ok" if ok else "stale"
        yield pd.DataFrame({"source": [key[0]], "status": [status], "last_success": [at if at is not None else pd.NaT]})

    timed = outcomes.withWatermark("ts", delay).groupBy("source")
    return timed.applyInPandasWithState(judge, "source string, status string, last_success timestamp", "last_success timestamp, newest timestamp, ok boolean", "update", GroupStateTimeout.EventTimeTimeout)


def stream_expire_late(zones: DataFrame, delay: str = "1 day", now: Column | None = None) -> DataFrame:
    """Zones (source, zone_id, ts of issue, active_until) still running, once each: a forecast that arrives later than the watermark allows is dropped, and so is one that has ended by ``now``, the time of the batch."""
    running = F.col("active_until").isNull() | ((F.col("active_until") > F.col("ts")) & (F.col("active_until") > (F.current_timestamp() if now is None else now)))
    return zones.withWatermark("ts", delay).where(running).dropDuplicatesWithinWatermark(["source", "zone_id"])


def write_refreshed(fetches: DataFrame, path: str, checkpoint: str, now: Column) -> StreamingQuery:
    """Each source's zones replaced by its newest fetch. fetches: source, ts, ok, zone_id, detected_at, active_until; a fetch without zones has one row without zone_id.

    A batch writes one version with the sources it refreshed, by ``refresh_source`` over what the versions
    before it hold, so it may run again and changes nothing then. A version counts once it is whole; one whose
    sources all have newer versions is deleted a batch later (``read_refreshed``).
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        newest = batch.groupBy("source").agg(F.max_by(F.struct("ts", "ok"), "ts").alias("f")).select("source", "f.ts", "f.ok")
        fetched = batch.join(newest.where("ok"), ["source", "ts", "ok"], "left_semi").where("zone_id is not null").select("source", "zone_id", "active_until")
        held = read_refreshed(spark, path, number)
        good = batch.where("ok").groupBy("source").agg(F.max("ts").alias("in_batch"))
        if held is None:
            before, success = fetched.limit(0).withColumn("detected_at", F.col("active_until")), None
        else:
            before, success = held
        outcome = newest.join(good, "source", "left")
        outcome = outcome.join(success, "source", "left") if success is not None else outcome.withColumn("known", F.lit(None).cast("timestamp"))
        outcome = written(outcome.select("source", "ok", F.greatest("in_batch", "known").alias("last_success")), "outcome")
        # what a source fetched earlier in this batch is what it holds if its newest fetch failed
        earlier = batch.where("ok").join(good, (batch["source"] == good["source"]) & (batch["ts"] == good["in_batch"]), "left_semi").where("zone_id is not null").select("source", "zone_id", "detected_at", "active_until")
        previous = before.join(good, "source", "left_anti").select("source", "zone_id", "detected_at", "active_until").unionByName(earlier)
        zones = refresh_source(fetched, outcome.select("source", "ok", "last_success"), previous, now)
        version = f"{path}/version={number:012d}"
        zones.write.mode("overwrite").parquet(f"{version}/zones")
        outcome.select("source", "last_success").write.mode("overwrite").parquet(f"{version}/sources")
        older = _versions(spark, path, number)
        if len(older) > 1:
            current = _newest(spark, older).select("version").distinct()
            kept = {r[0] for r in current.collect()}  # no more than there are versions
            for n, at in older.items():
                if n not in kept:
                    delete(spark, at)

    return fetches.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """Folders of the whole versions by number."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/sources/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    at = [str(f.getPath().getParent().getParent()) for f in found]
    numbered = {int(a.rsplit("version=", 1)[1]): a for a in sorted(at)}
    return {n: a for n, a in numbered.items() if before is None or n < before}


def _newest(spark: SparkSession, versions: dict[int, str]) -> DataFrame:
    """(source, version, last_success)."""
    tables = [spark.read.parquet(f"{a}/sources").withColumn("version", F.lit(n)) for n, a in versions.items()]
    return functools.reduce(DataFrame.unionByName, tables).groupBy("source").agg(F.max_by(F.struct("version", "last_success"), "version").alias("v")).select("source", "v.version", "v.last_success")


def read_refreshed(spark: SparkSession, path: str, before: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """The zones (source, zone_id, active_until, detected_at, retained) of each source's newest version, and (source, known) its last success; None if there is no version yet."""
    versions = _versions(spark, path, before)
    if not versions:
        return None
    newest = _newest(spark, versions)
    tables = [spark.read.parquet(f"{a}/zones").withColumn("version", F.lit(n)) for n, a in versions.items()]
    zones = functools.reduce(DataFrame.unionByName, tables).join(newest.select("source", "version"), ["source", "version"], "left_semi").drop("version")
    # a retained zone ends a day after its source's success, however often it is retained
    return zones.withColumn("detected_at", F.lit(None).cast("timestamp")), newest.select("source", F.col("last_success").alias("known"))


def run_available(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Drive a stream over everything there is, then stop."""
    df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


