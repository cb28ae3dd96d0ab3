"""Point clustering: the order-dependent greedy pass, and an order-free one by cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightgraph.functions.geo import EARTH_KM, KM_PER_DEG, haversine_km, js_round
from freightgraph.operators.components import connected_components

def _cells(points: DataFrame, link_km: float) -> DataFrame:
    deg = link_km / KM_PER_DEG
    return points.select("*", F.floor(F.col("lon") / deg).cast("long").alias("cx"), F.floor(F.col("lat") / deg).cast("long").alias("cy"))


def _cell_groups(cells: DataFrame) -> DataFrame:
    """(cx, cy, group): occupied cells that touch, also at a corner, are one group; named by the least cell."""
    occupied = cells.select("cx", "cy").distinct().withColumn("cell", (F.col("cx") + (1 << 30)) * (1 << 31) + (F.col("cy") + (1 << 30)))
    step = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((1, -1), (1, 0), (1, 1), (0, 1))])
    near = occupied.select("cell", "cx", "cy", F.inline(step)).select("cell", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    links = near.join(occupied.select("cx", "cy", F.col("cell").alias("other")), ["cx", "cy"]).select(F.col("cell").alias("src"), F.col("other").alias("dst"))
    found = connected_components(links)
    return occupied.join(found, F.col("cell") == F.col("node"), "left").select("cx", "cy", F.coalesce("component", "cell").alias("group"))


def cluster_cells(points: DataFrame, link_km: float) -> DataFrame:
    """(seq, cluster_id): points in touching occupied cells are one cluster, named by its least seq. Any order of rows gives the same."""
    cells = _cells(points, link_km)
    grouped = cells.join(_cell_groups(cells), ["cx", "cy"])
    named = grouped.groupBy("group").agg(F.min("seq").alias("cluster_id"))
    return grouped.join(named, "group").select("seq", "cluster_id")


class _Pass:
    """The greedy pass over one group of touching cells, fed in the order of seq; it holds its clusters, not its points."""

    def __init__(self, link_km: float):
        self.link_km = link_km
        self.born: dict[tuple[int, int], list[int]] = {}
        self.centre: list[list[float]] = []  # lat, lon, points, first seq

    def feed(self, part: pd.DataFrame) -> np.ndarray:
        """Each point joins the nearest centroid within reach among clusters begun in the nine cells round it."""
        born, centre = self.born, self.centre
        out = np.empty(len(part), np.int64)
        for i, (lat, lon, cx, cy, seq) in enumerate(zip(part["lat"], part["lon"], part["cx"], part["cy"], part["seq"], strict=True)):
            near = [c for x in (cx - 1, cx, cx + 1) for y in (cy - 1, cy, cy + 1) for c in born.get((x, y), ())]
            pick = -1
            if near:
                at = np.array([centre[c][:2] for c in near])
                h = np.sin(np.radians(at[:, 0] - lat) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(at[:, 0])) * np.sin(np.radians(at[:, 1] - lon) / 2) ** 2
                km = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1)))
                best = int(km.argmin())
                pick = near[best] if km[best] <= self.link_km else -1
            if pick < 0:
                pick = len(centre)
                centre.append([lat, lon, 0, seq])
                born.setdefault((cx, cy), []).append(pick)
            c = centre[pick]
            c[2] += 1
            if c[2] > 1:
                c[0] += (lat - c[0]) / c[2]
                c[1] += (lon - c[1]) / c[2]
            out[i] = c[3]
        return out


def cluster_points(points: DataFrame, link_km: float) -> DataFrame:
    """(seq, cluster_id): the greedy single pass in the order of seq; a cluster is named by its first point.

    Points of groups of cells that do not touch can never share a cluster, so the pass is exact within
    each group and groups run apart. A group of any size is one stream in the order of seq through a
    state of its clusters; the pass depends on that order, so one group is one task.
    """
    cells = _cells(points, link_km)
    grouped = cells.join(_cell_groups(cells), ["cx", "cy"]).select("group", "seq", "lat", "lon", "cx", "cy")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, _Pass(link_km)
        for batch in batches:
            group = batch["group"].to_numpy()
            heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else []
            for a, b in zip(heads, [*heads[1:], len(group)], strict=True):
                if group[a] != at:
                    at, state = group[a], _Pass(link_km)
                part = batch.iloc[a:b]
                yield pd.DataFrame({"seq": part["seq"].to_numpy(), "cluster_id": state.feed(part)})

    return grouped.repartition("group").sortWithinPartitions("group", "seq").mapInPandas(run, "seq long, cluster_id long")


def cluster_spread(clustered: DataFrame) -> DataFrame:
    """(cluster_id, n, lat, lon, spread_km): size, centroid and the farthest member's distance. clustered: cluster_id, lat, lon."""
    middle = clustered.groupBy("cluster_id").agg(F.count("*").alias("n"), F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"))
    far = clustered.join(middle, "cluster_id").groupBy("cluster_id").agg(F.max(haversine_km("lat", "lon", "c_lat", "c_lon")).alias("spread_km"))
    return middle.join(far, "cluster_id").select("cluster_id", "n", F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon"), "spread_km")


def _radius(buffer: float, low: float, high: float):
    return js_round(F.least(F.lit(high), F.greatest(F.lit(low), F.round(F.col("spread_km") + buffer, 6)))).cast("long")


def wildfire_zones(points: DataFrame, clusters: DataFrame, least: int = 8) -> DataFrame:
    """(cluster_id, n, lat, lon, radius_km) of fire clusters of at least eight detections."""
    return cluster_spread(points.join(clusters, "seq")).where(F.col("n") >= least).select("cluster_id", "n", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), _radius(10, 15.0, 75.0).alias("radius_km"))


def conflict_zones(points: DataFrame, clusters: DataFrame, least: int = 3) -> DataFrame:
    """(cluster_id, n, deaths, country, security, lat, lon, radius_km) of conflict clusters of at least three events; the country most named, the first of equals."""
    joined = points.join(clusters, "seq")
    by_country = joined.groupBy("cluster_id", "country").agg(F.count("*").alias("k"), F.min("seq").alias("s"))
    named = by_country.groupBy("cluster_id").agg(F.max_by("country", F.struct("k", (-F.col("s")).alias("s"))).alias("country"))
    deaths = joined.groupBy("cluster_id").agg(F.sum("deaths").alias("deaths"))
    d = F.col("deaths")
    security = F.when(d >= 100, 5).when(d >= 25, 10).when(d >= 5, 15).otherwise(25)
    return cluster_spread(joined).where(F.col("n") >= least).join(named, "cluster_id").join(deaths, "cluster_id").select(
        "cluster_id", "n", "deaths", "country", security.alias("security"), F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), _radius(15, 25.0, 120.0).alias("radius_km"))
