"""Network generation: candidate pairs, ranks, rasters and cheapest overland ways."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightgraph.functions.geo import cell_center, cell_grid, cell_reach, haversine_km, raster_cell
from freightgraph.functions.scratch import Versions, stored, written
from freightgraph.operators.components import connected_components
from freightgraph.operators.spatial import point_in_ring, ring_edges

RES = 0.1
MASS_STEPS = 1_000_000  # steps between cells that one task may hold
BLOCK_CELLS = 4_000_000  # steps times cells to set out from, of a block
MOST_SENT = 256  # how often a step may be sent to a block, on the average


HALF_EARTH_KM = 20_100.0


def nearest(points: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(src, dst, km): the k nearest targets of each point, itself aside; ties by id. Both: node_id, lat, lon.

    Rings of growing width are searched through grid cells. A point is done with the first ring that
    holds k targets, so only what lies in thinly settled parts goes on to wider rings; the first is as
    wide as holds some k of the targets if they were spread evenly.
    """
    n = targets.count()
    if not n:
        return points.sparkSession.createDataFrame([], "src long, dst long, km double")
    radius, left, found = max(25.0, 2 * 6371.0 * (2.0 * k / n) ** 0.5), points, None
    w = Window.partitionBy("src").orderBy(F.round("km", 6), "dst")
    while True:
        last = radius >= HALF_EARTH_KM
        pairs = pairs_within(left, targets, HALF_EARTH_KM if last else radius).where("src != dst")
        ranked = written(pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k), "nearest")
        done = ranked if last else ranked.join(ranked.where(F.col("r") == k).select("src"), "src", "left_semi")
        found = done if found is None else found.unionByName(done)
        if last:
            break
        left = left.join(ranked.where(F.col("r") == k).select(F.col("src").alias("node_id")), "node_id", "left_anti")
        if left.isEmpty():
            break
        radius *= 3
    return found.drop("r")


def knn_hubs(spokes: DataFrame, hubs: DataFrame, k: int = 3) -> DataFrame:
    """(src, dst, km): the k nearest hubs of each spoke."""
    return nearest(spokes, hubs, k)


def air_mesh(hubs: DataFrame) -> DataFrame:
    """(src, dst): every pair of hubs once; that is what the operator is asked for."""
    return hubs.select(F.col("node_id").alias("src")).join(hubs.select(F.col("node_id").alias("dst")), F.col("src") < F.col("dst"))


def air_network(node: DataFrame, hubs: DataFrame, k: int = 3) -> DataFrame:
    """(src, dst): all pairs of hubs, and the k nearest hubs of each other place; with fewer than two hubs all pairs of places. hubs: node_id."""
    if hubs.select("node_id").distinct().limit(2).count() < 2:
        return air_mesh(node)
    at = node.join(hubs.select("node_id").distinct(), "node_id", "left_semi")
    spokes = node.join(hubs.select("node_id").distinct(), "node_id", "left_anti")
    return air_mesh(at).unionByName(knn_hubs(spokes, at, k).select("src", "dst"))


def pairs_within(points: DataFrame, targets: DataFrame, max_km: float, same: str | None = None) -> DataFrame:
    """(src, dst, km) within max_km, through grid cells of that size. Both: node_id, lat, lon, and ``same`` to agree on."""
    deg, span = cell_grid(max_km)
    reach = cell_reach(F.col("lat"), deg, span)
    cell = lambda c: F.floor(F.col(c) / deg)
    on = [same] if same else []
    a = points.select(F.col("node_id").alias("src"), "lat", "lon", *on, F.explode(F.sequence(-reach, reach)).alias("dx")).select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("dy"))
    a = a.select("src", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), *on, F.pmod(cell("lon") + F.col("dx"), F.lit(span)).alias("cx"), (cell("lat") + F.col("dy")).alias("cy")).distinct()
    b = targets.select(F.col("node_id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), *on, F.pmod(cell("lon"), F.lit(span)).alias("cx"), cell("lat").alias("cy"))
    km = haversine_km("lat1", "lon1", "lat2", "lon2")
    return a.join(b, ["cx", "cy", *on]).select("src", "dst", km.alias("km")).where(F.col("km") <= max_km)


def near_pairs(points: DataFrame, max_km: float, same: str | None = None) -> DataFrame:
    """(src, dst, km): ordered pairs of different places within max_km."""
    return pairs_within(points, points, max_km, same).where("src != dst")


def truck_candidates(node: DataFrame, max_km: float = 700, k: int = 12) -> DataFrame:
    """(src, dst, straight_km): undirected pairs on one landmass that are among either end's k nearest within max_km. node has a landmass column."""
    w = Window.partitionBy("src").orderBy(F.round("km", 6), "dst")
    near = near_pairs(node.where("landmass is not null"), max_km, "landmass").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return near.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("km").alias("straight_km")).select(F.col("a").alias("src"), F.col("b").alias("dst"), "straight_km")


def sea_candidates(ports: DataFrame, curated: DataFrame, k: int = 12) -> DataFrame:
    """(src, dst): each port's k nearest ports at any distance, without the pairs already curated."""
    pairs = nearest(ports, ports, k).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    have = curated.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return pairs.join(have, ["src", "dst"], "left_anti")


def sea_candidate_filter(candidate: DataFrame, node: DataFrame, snap_km: float = 75.0, ratio: float = 3.0) -> DataFrame:
    """(src, dst, km): routed lanes that end near their ports and are at most ``ratio`` times the straight way. candidate: src, dst, pos, lon, lat; a lane without points was not routable."""
    w = Window.partitionBy("src", "dst").orderBy("pos")
    seg = candidate.where("lon is not null").select("*", F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2"))
    lane = seg.groupBy("src", "dst").agg(
        F.sum(F.coalesce(haversine_km("lat", "lon", "lat2", "lon2"), F.lit(0.0))).alias("km"), F.min_by(F.struct("lon", "lat"), "pos").alias("a"), F.max_by(F.struct("lon", "lat"), "pos").alias("b"))
    at = lambda p: node.select(F.col("node_id").alias(p), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    j = lane.join(at("src"), "src").join(at("dst"), "dst")
    ends = (haversine_km("src_lat", "src_lon", "a.lat", "a.lon") <= snap_km) & (haversine_km("dst_lat", "dst_lon", "b.lat", "b.lon") <= snap_km)
    return j.where(ends & (F.col("km") <= ratio * haversine_km("src_lat", "src_lon", "dst_lat", "dst_lon"))).select("src", "dst", "km")


def rank_keep(pair: DataFrame, n: int = 6) -> DataFrame:
    """(src, dst, km) of pairs that are among the n shortest of either end."""
    ends = pair.select(F.explode(F.array("src", "dst")).alias("end"), "src", "dst", "km")
    w = Window.partitionBy("end").orderBy(F.round("km", 6), "src", "dst")
    return ends.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("src", "dst", "km").distinct()


def rasterize(ring_vertex: DataFrame, res: float = RES) -> DataFrame:
    """(x, y): grid cells whose middle lies in a ring: sides crossed by each row of middles, sorted and paired. ring_vertex: zone_id, pos, lon, lat."""
    sides = ring_edges(ring_vertex, ["zone_id"]).where("lat1 != lat2")
    row = lambda lat: F.floor((lat + 90.0 - res / 2) / res)
    rows = sides.select("*", F.explode(F.sequence(row(F.least("lat1", "lat2")), row(F.greatest("lat1", "lat2")) + 1)).alias("y")).withColumn("lat", F.col("y") * res - 90.0 + res / 2)
    cut = rows.where((F.col("lat1") > F.col("lat")) != (F.col("lat2") > F.col("lat"))).withColumn("at", F.col("lon1") + F.try_divide((F.col("lat") - F.col("lat1")) * (F.col("lon2") - F.col("lon1")), F.col("lat2") - F.col("lat1")))
    w = Window.partitionBy("zone_id", "y").orderBy("at")
    pairs = cut.select("zone_id", "y", "at", F.lead("at").over(w).alias("to"), F.row_number().over(w).alias("r")).where("r % 2 = 1 and to is not null")
    lo, hi = F.ceil(F.round((F.col("at") + 180.0 - res / 2) / res, 9)), F.floor(F.round((F.col("to") + 180.0 - res / 2) / res, 9))
    cells = pairs.select("y", lo.alias("lo"), hi.alias("hi")).where("hi >= lo").select("y", F.explode(F.sequence("lo", "hi")).alias("x"))
    return cells.select(F.pmod("x", F.lit(round(360 / res))).cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()


def trace_cells(segments: DataFrame, res: float = RES) -> DataFrame:
    """(x, y) of the cells that lines pass, looked at twice a cell. segments: lon1, lat1, lon2, lat2."""
    far = F.greatest(F.abs(F.col("lon2") - F.col("lon1")), F.abs(F.col("lat2") - F.col("lat1")))
    s = segments.withColumn("n", F.greatest(F.lit(1), F.ceil(far / (res / 2))).cast("int"))
    s = s.select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("s"))
    along = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("s") / F.col("n")
    return s.select(raster_cell(along("lon1", "lon2"), along("lat1", "lat2"), res).alias("c")).select("c.x", "c.y").distinct()


def line_segments(lines: DataFrame, by: str) -> DataFrame:
    """(lon1, lat1, lon2, lat2) of open lines (by, pos, lon, lat)."""
    w = Window.partitionBy(by).orderBy("pos")
    ahead = lines.select(F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2"))
    return ahead.where("lon2 is not null")


def water_cells(land: DataFrame, lines: DataFrame, lakes: DataFrame, res: float = RES) -> DataFrame:
    """(x, y): navigable cells: all that are not land, and those within one cell of an inland water.

    land: x, y; lines: line_id, pos, lon, lat of rivers and canals; lakes: zone_id, pos, lon, lat, filled and with
    their rims. The grid has as many cells as its resolution says, however large the tables.
    """
    nx, ny = round(360 / res), round(180 / res)
    area = land.sparkSession.range(nx * ny).select((F.col("id") % nx).cast("int").alias("x"), F.floor(F.col("id") / nx).cast("int").alias("y"))
    rims = ring_edges(lakes, ["zone_id"]).select("lon1", "lat1", "lon2", "lat2")
    inland = trace_cells(line_segments(lines, "line_id").unionByName(rims), res).unionByName(rasterize(lakes, res)).distinct()
    open_water = area.join(land.select("x", "y").distinct(), ["x", "y"], "left_anti")
    near = inland.select("x", "y", F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("d"))
    wide = near.select(F.pmod(F.col("x") + F.col("d.dx"), F.lit(nx)).cast("int").alias("x"), (F.col("y") + F.col("d.dy")).alias("y")).where(F.col("y").between(0, ny - 1))
    return open_water.unionByName(wide).distinct()


def cell_bitmaps(cells: DataFrame) -> DataFrame:
    """(y, word, bits): a grid's cells as a bit each, 64 columns to a word. At 0.1° there are no more than 102,600 rows."""
    return cells.groupBy(F.col("y").cast("int").alias("y"), F.floor(F.col("x") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(x % 64 as int)))").alias("bits"))


def in_cells(points: DataFrame, cells: DataFrame, res: float = RES, name: str = "hit") -> DataFrame:
    """``points`` (lon, lat, …) with ``name``: whether their cell is one of ``cells`` (x, y). The grid's size bounds the bitmaps, so they are broadcast."""
    at = points.withColumn("_c", raster_cell("lon", "lat", res)).withColumn("y", F.col("_c.y")).withColumn("word", F.floor(F.col("_c.x") / 64).cast("int"))
    met = at.join(F.broadcast(cell_bitmaps(cells)), ["y", "word"], "left")
    return met.withColumn(name, F.coalesce(F.expr("(bits & shiftleft(1L, cast(_c.x % 64 as int))) != 0"), F.lit(False))).drop("_c", "y", "word", "bits")


def landmass_labels(land: DataFrame, res: float = RES) -> DataFrame:
    """(x, y, label): 8-connected land, also over the dateline; a landmass is named by its least cell. Runs of cells in a row are the nodes, not cells."""
    nx = round(360 / res)
    w = Window.partitionBy("y").orderBy("x")
    runs = land.withColumn("run", F.col("x") - F.row_number().over(w))
    spans = runs.groupBy("y", "run").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("id", F.col("y").cast("long") * nx + F.col("lo"))
    up = spans.select((F.col("y") - 1).alias("y"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("id").alias("id2"))
    touch = spans.join(up, "y").where("lo <= hi2 + 1 and lo2 <= hi + 1").select(F.col("id").alias("src"), F.col("id2").alias("dst"))
    ends, starts = spans.where(F.col("hi") == nx - 1), spans.where("lo = 0").select(F.col("y").alias("y2"), F.col("id").alias("id2"))
    wrap = ends.join(starts, F.abs(F.col("y") - F.col("y2")) <= 1).select(F.col("id").alias("src"), F.col("id2").alias("dst"))
    found = connected_components(touch.unionByName(wrap))
    named = spans.join(found, F.col("id") == F.col("node"), "left").select("y", "run", F.coalesce("component", "id").alias("label"))
    return runs.join(named, ["y", "run"]).select("x", "y", "label")


def snap_to_land(node_cell: DataFrame, land: DataFrame, max_ring: int = 4, res: float = RES) -> DataFrame:
    """(node_id, x, y, ring): a place's own cell or the nearest land cell of the first ring that has any. node_cell: node_id, lat, lon, x, y."""
    span = F.sequence(F.lit(-max_ring), F.lit(max_ring))
    near = node_cell.select("node_id", "lat", "lon", F.col("x").alias("x0"), F.col("y").alias("y0"), F.explode(span).alias("dx")).select("*", F.explode(span).alias("dy"))
    near = near.select("node_id", "lat", "lon", F.pmod(F.col("x0") + F.col("dx"), F.lit(round(360 / res))).alias("x"), (F.col("y0") + F.col("dy")).alias("y"), F.greatest(F.abs("dx"), F.abs("dy")).alias("ring"))
    hit = near.join(land, ["x", "y"]).withColumn("p", cell_center("x", "y", res)).withColumn("km", F.round(haversine_km("lat", "lon", "p.lat", "p.lon"), 6))
    return hit.groupBy("node_id").agg(F.min(F.struct("ring", "km", "x", "y")).alias("b")).select("node_id", "b.x", "b.y", "b.ring")


def exact_land_test(points: DataFrame, ring_vertex: DataFrame) -> DataFrame:
    """(point_id, is_land)."""
    inside = point_in_ring(points, ring_vertex).select("point_id").distinct().withColumn("hit", F.lit(True))
    return points.select("point_id").join(inside, "point_id", "left").select("point_id", F.coalesce("hit", F.lit(False)).alias("is_land"))


def overland_km(pair: DataFrame, cell_edge: DataFrame, ratio: float = 2.5, max_km: float = 700.0, res: float = RES) -> DataFrame:
    """(src, dst, km): cheapest way over 8-neighbour land cells for each pair, within its budget of min(700, 2.5 × straight).

    pair: src, dst, from_cell, to_cell, straight_km; cell_edge: a, b, km both ways. Pairs that set out from one cell
    share its search, which goes as far as the largest of their budgets; so there is a state for each cell to set out from and each
    cell near it, however many pairs there are. Where landmasses have few steps enough for a task, blocks of
    cells are searched within a task each, else all cells advance together, a step a round.
    """
    budget = F.least(F.lit(max_km), F.greatest(F.lit(1.0), ratio * F.col("straight_km")))
    todo = written(pair.select("src", "dst", "from_cell", "to_cell", budget.alias("budget")), "pairs")
    start = written(todo.groupBy(F.col("from_cell").alias("start")).agg(F.max("budget").alias("most")), "starts")
    steps = written(cell_edge.select("a", "b", "km"), "steps")
    found = _in_landmasses(start, steps)
    found = _in_rounds(start, steps) if found is None else found
    near = found.select(F.col("start").alias("from_cell"), F.col("cell").alias("to_cell"), "km")
    return todo.join(near, ["from_cell", "to_cell"]).where("km <= budget").select("src", "dst", "km")


def _in_landmasses(start: DataFrame, steps: DataFrame) -> DataFrame | None:
    """(start, cell, km) of the cells within ``most`` of each start; None if a landmass has more steps than a task may hold, or too many blocks."""
    mass = written(connected_components(steps, "a", "b").withColumnRenamed("component", "mass"), "masses")
    on_mass = steps.join(mass.withColumnRenamed("node", "a"), "a")
    sizes = on_mass.groupBy("mass").agg(F.count("*").alias("steps"), F.count_distinct("a").alias("cells"))
    largest = sizes.agg(F.max("steps"), F.max("cells")).first()
    if largest[0] is not None and largest[0] > MASS_STEPS:
        return None
    tasks = int(start.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a start that has no step reaches itself alone
    alone = start.join(mass, F.col("start") == F.col("node"), "left_anti").select("start", F.col("start").alias("cell"), F.lit(0.0).alias("km"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("starts") / F.greatest(F.lit(1), F.least(F.lit(256), F.floor(F.lit(BLOCK_CELLS) / F.col("steps"))))))
    who = start.join(mass, F.col("start") == F.col("node")).select("mass", "start", "most")
    of = written(who.groupBy("mass").agg(F.count("*").alias("starts")).join(sizes, "mass").select("mass", "steps", blocks.cast("int").alias("blocks")), "blocks")
    sent = of.agg(F.sum("blocks").alias("blocks"), F.sum("steps").alias("steps"), F.sum(F.col("blocks") * F.col("steps")).alias("all")).first()
    if (sent["all"] or 0) > MOST_SENT * (sent["steps"] or 0):
        return None
    who = written(who.join(of.drop("steps"), "mass").select("mass", F.pmod(F.xxhash64("start"), F.col("blocks")).cast("int").alias("block"), "start", "most"), "who")
    what = on_mass.join(of.drop("steps"), "mass").select("mass", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "a", "b", "km")
    spread = lambda df: df.repartition(max(tasks, sent["blocks"] or 0), "mass", "block").groupBy("mass", "block")
    return spread(who).cogroup(spread(what)).applyInArrow(_cheapest, "start long, cell long, km double").unionByName(alone)


def _cheapest(starts: pa.Table, steps: pa.Table) -> pa.Table:
    """Cheapest ways from a block of cells, step by step until none gets cheaper; none is longer than its start's ``most``."""
    start, most = starts["start"].to_numpy(), starts["most"].to_numpy()
    if not len(start) or not steps.num_rows:
        return pa.table({"start": np.empty(0, np.int64), "cell": np.empty(0, np.int64), "km": np.empty(0)})
    a, b, km = (steps[c].to_numpy() for c in ("a", "b", "km"))
    cells = np.unique(np.concatenate([a, b]))
    order = np.argsort(b, kind="stable")
    a, b, km = np.searchsorted(cells, a[order]), np.searchsorted(cells, b[order]), km[order]
    way = np.full((len(cells), len(start)), np.inf)
    way[np.searchsorted(cells, start), np.arange(len(start))] = 0.0
    fresh = np.zeros(len(cells), bool)
    fresh[np.searchsorted(cells, start)] = True
    while fresh.any():
        use = np.flatnonzero(fresh[a])
        fresh[:] = False
        if not len(use):
            break
        ahead = way[a[use]] + km[use, None]
        first = np.flatnonzero(np.r_[True, b[use][1:] != b[use][:-1]])
        to, ahead = b[use][first], np.minimum.reduceat(ahead, first, axis=0)
        ahead[ahead > most[None, :] + 1e-6] = np.inf
        better = (ahead < way[to]).any(axis=1)
        way[to[better]] = np.minimum(way[to[better]], ahead[better])
        fresh[to[better]] = True
    cell, col = np.nonzero(np.isfinite(way))
    return pa.table({"start": start[col], "cell": cells[cell], "km": way[cell, col]})


def _in_rounds(start: DataFrame, steps: DataFrame) -> DataFrame:
    """(start, cell, km) of the cells within ``most`` of each start; only states that got better are written and go on."""
    state = ["start", "cell"]
    known = Versions(start.sparkSession, lambda df: df.groupBy(*state).agg(F.min("km").alias("km")))
    frontier, path = stored(start.select("start", F.col("start").alias("cell"), F.lit(0.0).alias("km")), "reached")
    known.add(path, frontier.count(), [*state, "km"])
    steps = steps.select(F.col("a").alias("cell"), "b", F.col("km").alias("w"))
    while True:
        so_far = known.read().groupBy(*state).agg(F.min("km").alias("km"))
        ahead = frontier.join(start, "start").join(steps, "cell").withColumn("n", F.col("km") + F.col("w")).where(F.col("n") <= F.col("most") + 1e-6)
        reached = ahead.groupBy("start", F.col("b").alias("cell")).agg(F.min("n").alias("n"))
        better = reached.join(so_far, state, "left").where(F.col("km").isNull() | (F.col("n") < F.col("km") - 1e-9)).select(*state, F.col("n").alias("km"))
        frontier, path = stored(better, "reached")
        n = frontier.count()
        known.add(path, n, [*state, "km"])
        if not n:
            return known.settle()


def land_cell_edges(land: DataFrame, res: float = RES) -> DataFrame:
    """(a, b, km): steps between neighbouring land cells, both ways; a cell's number is y · columns + x."""
    nx = round(360 / res)
    near = land.select("x", "y", F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])).alias("d"))
    near = near.select("x", "y", F.pmod(F.col("x") + F.col("d.dx"), F.lit(nx)).alias("x2"), (F.col("y") + F.col("d.dy")).alias("y2"))
    on = near.join(land.select(F.col("x").alias("x2"), F.col("y").alias("y2")), ["x2", "y2"])
    p, q = cell_center("x", "y", res), cell_center("x2", "y2", res)
    return on.select((F.col("y").cast("long") * nx + F.col("x")).alias("a"), (F.col("y2").cast("long") * nx + F.col("x2")).alias("b"), haversine_km(p["lat"], p["lon"], q["lat"], q["lon"]).alias("km"))
