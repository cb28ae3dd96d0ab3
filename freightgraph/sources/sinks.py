"""Results as JSON lines and GeoJSON features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightgraph.functions.geo import KM_PER_DEG
from freightgraph.operators.spatial import split_antimeridian


def write_zones(df: DataFrame, path: str) -> None:
    """Zones in the order of their ids, one JSON record a line."""
    df.orderBy("zone_id").write.mode("overwrite").json(path)


def _feature(geometry: Column, properties: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def to_geojson_points(node: DataFrame) -> DataFrame:
    """(node_id, feature)."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round("lon", 4), F.round("lat", 4)).alias("coordinates"))
    return node.select("node_id", _feature(point, F.struct(F.col("node_id").alias("id"), "name", "kind")).alias("feature"))


def hazard_rings(zone: DataFrame, sides: int = 18) -> DataFrame:
    """(zone_id, pos, lon, lat): a closed ring round each circle, in degrees."""
    turn = 2 * 3.141592653589793 * F.col("pos") / sides
    d_lat = F.col("radius_km") / KM_PER_DEG
    d_lon = d_lat / F.greatest(F.cos(F.radians("lat")), F.lit(0.05))
    ring = zone.select("zone_id", "lat", "lon", "radius_km", F.explode(F.sequence(F.lit(0), F.lit(sides))).alias("k")).withColumn("pos", F.col("k") % sides)
    return ring.select("zone_id", F.col("k").alias("pos"), (F.col("lon") + d_lon * F.cos(turn)).alias("lon"), (F.col("lat") + d_lat * F.sin(turn)).alias("lat"))


def to_geojson_hazards(zone: DataFrame, vertices: DataFrame) -> DataFrame:
    """(zone_id, shape, n_points, lon, lat, feature): a polygon for each zone, circle or ring, with its middle."""
    rings = hazard_rings(zone).withColumn("shape", F.lit("circle"))
    first = vertices.where("pos = 0").select("zone_id", F.lit(1 << 20).alias("pos"), "lon", "lat")
    own = vertices.select("zone_id", "pos", "lon", "lat").unionByName(first).withColumn("shape", F.lit("ring"))
    all_points = rings.unionByName(own)
    closed = all_points.groupBy("shape", "zone_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat")))).alias("p"))
    line = F.transform("p", lambda x: F.array(x["lon"], x["lat"]))
    polygon = F.struct(F.lit("Polygon").alias("type"), F.array(line).alias("coordinates"))
    body = F.slice("p", 1, F.size("p") - 1)
    mean = lambda f: F.round(F.aggregate(body, F.lit(0.0), lambda a, x: a + x[f]) / F.size(body), 3) + 0.0
    return closed.select("zone_id", "shape", F.size("p").alias("n_points"), mean("lon").alias("lon"), mean("lat").alias("lat"), _feature(polygon, F.struct(F.col("zone_id").alias("id"), "shape")).alias("feature"))


def to_geojson_routes(edge_point: DataFrame) -> DataFrame:
    """(edge_id, parts, feature): a line, or several where it crosses the dateline."""
    parts = split_antimeridian(edge_point).groupBy("edge_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat")))).alias("p"))
    lines = parts.groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("part", F.transform("p", lambda x: F.array(x["lon"], x["lat"])).alias("line")))).alias("l"))
    many = F.struct(F.lit("MultiLineString").alias("type"), F.transform("l", lambda x: x["line"]).alias("coordinates"))
    return lines.select("edge_id", F.size("l").alias("parts"), _feature(many, F.struct(F.col("edge_id").alias("id"))).alias("feature"))
