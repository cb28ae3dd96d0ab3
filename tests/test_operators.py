"""Invariants on small graphs and feeds."""

import datetime as dt
import heapq
import math
import os
import random
from collections import Counter, defaultdict

import pytest
from freightgraph.functions import scratch
from freightgraph.operators import cluster, network, planning, pricing, quality, routes, spatial
from freightgraph.operators.components import connected_components, cut_off
from freightgraph.operators.indices import upper_median
from freightgraph.sources import feeds, sinks
from freightgraph.streaming import refresh
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def micro(spark):
    """a –rail– b –rail– c, a –air– c, and d apart."""
    costs = spark.createDataFrame([(1, 1, 2, "rail", 10.0, 5.0, 100.0), (2, 2, 3, "rail", 10.0, 5.0, 100.0), (3, 1, 3, "air", 100.0, 1.0, 150.0)], "edge_id long, src long, dst long, mode string, usd double, hours double, km double")
    hubs = spark.createDataFrame([(n, m, 3.0, 2.0) for n in (1, 2, 3) for m in ("rail", "air")], "node_id long, mode string, usd double, hours double")
    return costs, hubs


def test_shortest_paths(spark, micro):
    graph = routes.objectives(pricing.state_graph(*micro))
    found = {(r["objective"], r["source"], r["target"]): (r["cost"], r["path"]) for r in routes.shortest_paths(graph, spark.createDataFrame([(1,), (4,)], "node_id long")).collect()}
    assert found[("cheapest", 1, 3)] == (23.0, [1, 2]) and found[("fastest", 1, 3)] == (3.0, [3]) and found[("most-direct", 1, 3)] == (150.0, [3])
    assert not [k for k in found if k[1] == 4]
    capped = routes.shortest_paths(graph, spark.createDataFrame([(1,)], "node_id long"), max_cost=20.0).collect()
    assert not [r for r in capped if r["objective"] == "cheapest" and r["target"] == 3]


def test_doubled_units_double_price_not_time(spark, micro):
    graph = routes.objectives(pricing.state_graph(*micro))
    stops = spark.createDataFrame([(r, s, n) for r in (1, 2) for s, n in ((0, 1), (1, 3))], "request_id long, seq int, node_id long")
    units = spark.createDataFrame([(1, 1.0), (2, 2.0)], "request_id long, units double")
    segments = routes.waypoint_segments(stops)
    paths = routes.shortest_paths(graph, segments.select(F.col("src").alias("node_id")))
    legs = routes.leg_eta(routes.reconstruct_legs(routes.complete_options(segments, paths), *micro, units))
    legs = legs.join(routes.dedupe_options(legs).select("request_id", "objective"), ["request_id", "objective"], "left_semi")
    total = {(r["request_id"], r["objective"]): (r["usd"], r["hours"], r["transfers"]) for r in routes.route_totals(legs).collect()}
    assert total[(2, "cheapest")][0] == 2 * total[(1, "cheapest")][0] and total[(2, "cheapest")][1] == total[(1, "cheapest")][1]
    assert ("most-direct" not in {k[1] for k in total}) and total[(1, "cheapest")][2] == 0


def test_short_hop_is_dearer_by_km(spark):
    r = spark.range(1).select(pricing.tapered_usd(F.lit(100.0), F.lit(1.0)).alias("a"), pricing.tapered_usd(F.lit(8000.0), F.lit(1.0)).alias("b")).first()
    assert r["a"] == pytest.approx(190) and r["b"] == pytest.approx(500 * 1.9 + 1000 * 1.35 + 3500 * 1.05 + 3000)


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_large_group_is_clustered_greedily(spark):
    rng = random.Random(2)
    pts = [(i, 10 + rng.random() * 2, rng.random() * 2) for i in range(600)]  # one group of touching cells
    want = plain_greedy(pts, 30)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = cluster.cluster_points(spark.createDataFrame(pts, "seq long, lat double, lon double"), 30).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert {r["seq"]: r["cluster_id"] for r in got} == want and len(set(want.values())) > 5


def test_parse_dtg(spark):
    rows = spark.createDataFrame([("081653Z MAY 2024",), ("99",), (None,), ("321653Z MAY 2024",)], "s string")
    got = [r[0] for r in rows.select(feeds.parse_dtg(F.col("s")).alias("t")).collect()]
    assert got[0] is not None and (got[0].month, got[0].day, got[0].minute) == (5, 8, 53) and got[1:] == [None, None, None]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0)], "zone_id string, radius_km double")
    sinks.write_zones(df, f"{tmp_path}/z")
    back = feeds.read_nodes(spark, [f"{tmp_path}/z", f"{tmp_path}/z"], "zone_id string, radius_km double")
    assert back.count() == 4


def test_streams(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    events = spark.createDataFrame([(1, at(1), "a"), (1, at(2), "a"), (2, at(7), "b"), (3, at(8), "b")], "event_id long, ts timestamp, event_type string")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    seen = []
    refresh.run_available(refresh.stream_dedupe(stream), f"{tmp_path}/c1", lambda b, _: seen.extend(b.collect()))
    assert sorted(r["event_id"] for r in seen) == [1, 2, 3]
    counts = []
    refresh.run_available(refresh.stream_run_counts(stream), f"{tmp_path}/c2", lambda b, _: counts.extend(b.collect()), "complete")
    assert sorted((r["event_type"], r["n"]) for r in counts) == [("a", 2), ("b", 2)]
    refresh.write_last_good(stream, f"{tmp_path}/out", f"{tmp_path}/c3").awaitTermination()
    assert refresh.read_last_good(spark, f"{tmp_path}/out").count() == 4
    events.limit(1).write.parquet(f"{tmp_path}/out/version=000000000009")  # whole: it counts
    events.limit(2).write.parquet(f"{tmp_path}/out/version=000000000010")
    os.remove(f"{tmp_path}/out/version=000000000010/_SUCCESS")  # a write that failed: it does not
    assert refresh.read_last_good(spark, f"{tmp_path}/out").count() == 1


def append(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_source_status_stream(spark, tmp_path):
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    schema, folder = "source string, ts timestamp, ok boolean", f"{tmp_path}/in"
    append(spark, folder, [("a", at(1, 9), True), ("a", at(1, 10), False), ("b", at(1, 10), False), ("c", at(1, 10), True)], schema)
    seen = []
    status = refresh.stream_source_status(spark.readStream.schema(schema).parquet(folder), "1 hour")
    run = lambda: refresh.run_available(status, f"{tmp_path}/c", lambda b, _: seen.extend(b.collect()), "update")
    last = lambda: {r["source"]: r["status"] for r in seen}
    run()
    assert last() == {"a": "stale", "b": "unavailable", "c": "ok"}
    append(spark, folder, [("c", at(1, 9), False), ("a", at(1, 11), True)], schema)  # a late failure changes nothing
    run()
    assert last() == {"a": "ok", "b": "unavailable", "c": "ok"}
    append(spark, folder, [("b", at(3, 12), True)], schema)  # the others are silent
    run()
    append(spark, folder, [("b", at(3, 13), True)], schema)
    run()
    assert last() == {"a": "unavailable", "b": "ok", "c": "unavailable"}


def test_expire_late_stream(spark, tmp_path):
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    schema, folder = "source string, zone_id long, ts timestamp, active_until timestamp", f"{tmp_path}/in"
    append(spark, folder, [("f", 1, at(5, 0), at(9, 0)), ("f", 2, at(5, 0), at(4, 0)), ("f", 3, at(5, 0), None), ("f", 5, at(5, 1), at(5, 2))], schema)
    seen = []
    zones = refresh.stream_expire_late(spark.readStream.schema(schema).parquet(folder), "6 hours", F.lit(at(5, 3)))
    run = lambda: refresh.run_available(zones, f"{tmp_path}/c", lambda b, _: seen.extend(r["zone_id"] for r in b.collect()))
    run()
    append(spark, folder, [("f", 4, at(4, 12), at(9, 0)), ("f", 6, at(5, 2), at(9, 0)), ("f", 1, at(5, 2), at(9, 0))], schema)  # 4 is later than the watermark allows
    run()
    assert sorted(seen) == [1, 3, 6]


def test_refresh_stream(spark, tmp_path):
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    schema, folder, out = "source string, ts timestamp, ok boolean, zone_id long, detected_at timestamp, active_until timestamp", f"{tmp_path}/in", f"{tmp_path}/out"
    now = F.lit(at(5, 12))
    os.makedirs(folder)
    fetches = spark.readStream.schema(schema).parquet(folder)
    run = lambda checkpoint="c": refresh.write_refreshed(fetches, out, f"{tmp_path}/{checkpoint}", now).awaitTermination()
    held = lambda: {(r["source"], r["zone_id"], r["retained"]) for r in refresh.read_refreshed(spark, out)[0].collect()}
    append(spark, folder, [("a", at(5, 1), True, 1, None, None), ("a", at(5, 1), True, 2, None, at(5, 6)), ("b", at(5, 1), True, 3, None, None), ("d", at(3, 1), True, 9, None, None)], schema)
    run()
    assert held() == {("a", 1, False), ("a", 2, False), ("b", 3, False), ("d", 9, False)}
    # a fails and keeps what has not ended, b answers with nothing, c is new, d failed too long after its success
    append(spark, folder, [("a", at(5, 2), False, None, None, None), ("b", at(5, 2), True, None, None, None), ("c", at(5, 2), True, 4, None, None), ("d", at(5, 2), False, None, None, None)], schema)
    run()
    want = {("a", 1, True), ("c", 4, False)}
    assert held() == want
    spark.read.schema(schema).parquet(folder).where("ts = '2024-01-05 02:00:00'").write.parquet(f"{tmp_path}/again")
    before = refresh._versions(spark, out)
    refresh.write_refreshed(spark.readStream.schema(schema).parquet(f"{tmp_path}/again"), out, f"{tmp_path}/c2", now).awaitTermination()  # that batch once more, as number 0
    assert set(refresh._versions(spark, out)) == set(before) and held() == want


def test_whole_routes_equal_dijkstra(spark):
    from freightgraph.plans import access, registry, tables

    data = "/root/testdata/sf0.001"
    steps, loads = defaultdict(list), {}
    for r in routes.objectives(access.graph(tables.Tables(spark, data))).collect():
        if r["edge_id"] is not None:
            steps[r["objective"], r["from_node"]].append((r["to_node"], r["to_mode"], r["weight"]))
        elif r["is_load"]:
            loads[r["objective"], r["from_node"], r["to_mode"]] = r["weight"]
    want = {}
    for objective, source in list(steps):
        done, heap = set(), [(0.0, source, "")]
        while heap:
            cost, node, mode = heapq.heappop(heap)
            if (node, mode) in done:
                continue
            done.add((node, mode))
            if node != source:
                want.setdefault((objective, source, node), cost)
            for to, by, weight in steps[objective, node]:
                if to != source:
                    heapq.heappush(heap, (cost + weight + (0 if by == mode else loads[objective, node, by]), to, by))
    found = registry.QUERIES["r2_shortest_paths"](spark, data).collect()
    assert {(r["objective"], r["source"], r["target"]): r["cost"] for r in found} == pytest.approx(want, abs=2e-3)
    assert max(r["hops"] for r in found) > 3
    # with targets alone, and with few rows a broadcast may have, so that every round joins by a shuffle
    weighted = routes.objectives(access.graph(tables.Tables(spark, data)))
    asked = [(s, t) for s, t in {(s, t) for _, s, t in want} if (s + t) % 3 == 0]
    targets = spark.createDataFrame(asked, "source long, target long")
    small, routes.SMALL = routes.SMALL, 5
    try:
        some = routes.shortest_paths(weighted, targets.select(F.col("source").alias("node_id")), targets=targets).collect()
    finally:
        routes.SMALL = small
    assert {(r["objective"], r["source"], r["target"]): r["cost"] for r in some} == pytest.approx({k: c for k, c in want.items() if k[1:] in set(asked)}, abs=1e-6)
    paths = {(r["objective"], r["source"], r["target"]): r["path"] for r in found}
    assert all(">".join(map(str, r["path"])) == paths[r["objective"], r["source"], r["target"]] for r in some)


def km(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(3)
    at = {i: (rng.uniform(-85, 85) if i % 3 else rng.uniform(40, 42), rng.uniform(-180, 180) if i % 3 else rng.uniform(-1, 1)) for i in range(150)}
    places = spark.createDataFrame([(i, *p) for i, p in at.items()], "node_id long, lat double, lon double")
    hubs = places.where("node_id % 4 = 0")
    want = set()
    for i in at:
        order = sorted((round(km(at[i], at[j]), 6), j) for j in at if j % 4 == 0 and j != i)
        want |= {(i, j) for _, j in order[:5]}
    assert {(r["src"], r["dst"]) for r in network.nearest(places, hubs, 5).collect()} == want
    assert network.nearest(places, hubs.limit(2), 5).count() == 150 * 2 - 2  # fewer targets than asked for
    assert network.nearest(places, hubs.where("false"), 5).count() == 0


def plain_greedy(points, link_km):
    """One pass in the order of seq: the nearest centroid within reach, of clusters begun in the nine cells round the point."""
    deg, clusters, out = link_km / 111.32, [], {}
    for seq, lat, lon in sorted(points):
        cell = (math.floor(lon / deg), math.floor(lat / deg))
        near = [(km((c["lat"], c["lon"]), (lat, lon)), i) for i, c in enumerate(clusters) if abs(c["cell"][0] - cell[0]) <= 1 and abs(c["cell"][1] - cell[1]) <= 1]
        best = min(near, default=(math.inf, None))
        if best[0] <= link_km:
            c = clusters[best[1]]
            c["lat"], c["lon"], c["n"] = c["lat"] + (lat - c["lat"]) / (c["n"] + 1), c["lon"] + (lon - c["lon"]) / (c["n"] + 1), c["n"] + 1
        else:
            c = {"cell": cell, "lat": lat, "lon": lon, "n": 1, "seq": seq}
            clusters.append(c)
        out[seq] = c["seq"]
    return out


def test_clusters_equal_plain_pass(spark):
    rng = random.Random(8)
    pts = [(i, rng.choice([10, 12, 40]) + rng.random() * 3, rng.choice([0, 3, 50]) + rng.random() * 3) for i in range(500)]
    df = spark.createDataFrame(pts, "seq long, lat double, lon double")
    assert {r["seq"]: r["cluster_id"] for r in cluster.cluster_points(df, 30).collect()} == plain_greedy(pts, 30)
    deg = 30 / 111.32
    cell = {s: (math.floor(x / deg), math.floor(y / deg)) for s, y, x in pts}
    root = {c: c for c in cell.values()}
    find = lambda c: c if root[c] == c else find(root[c])
    for a in root:
        for b in root:
            if a < b and abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1:
                root[find(a)] = find(b)
    least = {}
    for s, c in cell.items():
        least[find(c)] = min(s, least.get(find(c), s))
    assert {r["seq"]: r["cluster_id"] for r in cluster.cluster_cells(df, 30).collect()} == {s: least[find(c)] for s, c in cell.items()}


def test_zones_of_clusters(spark):
    """Each zone's middle, number and weight from its own points."""
    rng = random.Random(4)
    pts = [(i, 10 + rng.random() * 3, 20 + rng.random() * 3, rng.random() * 80) for i in range(300)]
    df = spark.createDataFrame(pts, "seq long, lat double, lon double, frp double")
    groups = defaultdict(list)
    for seq, c in plain_greedy([p[:3] for p in pts], 30).items():
        groups[c].append(pts[seq])
    middle = {c: (sum(p[1] for p in g) / len(g), sum(p[2] for p in g) / len(g)) for c, g in groups.items()}
    spread = {r["cluster_id"]: r for r in cluster.cluster_spread(cluster.cluster_points(df, 30).join(df, "seq")).collect()}
    assert {c: len(g) for c, g in groups.items()} == {c: r["n"] for c, r in spread.items()}
    for c, r in spread.items():
        assert (r["lat"], r["lon"]) == pytest.approx(middle[c]) and r["spread_km"] == pytest.approx(max(km(middle[c], p[1:3]) for p in groups[c]), abs=1e-6)
    zones = cluster.wildfire_zones(df, cluster.cluster_points(df, 30)).collect()
    assert 0 < len(zones) <= len(groups)


def test_conflict_zones_equal_plain_sums(spark):
    """Every column of each zone: size, deaths, the country most named (of equals the first), security, middle and radius."""
    rng = random.Random(12)
    pts = [(i, 10 + rng.random() * 4, 20 + rng.random() * 4, rng.choice(["X", "Y", "Z"]), rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(pts, "seq long, lat double, lon double, country string, deaths int")
    groups = defaultdict(list)
    for seq, c in plain_greedy([p[:3] for p in pts], 30).items():
        groups[c].append(pts[seq])
    want = {}
    for c, g in groups.items():
        if len(g) < 3:
            continue
        middle = sum(p[1] for p in g) / len(g), sum(p[2] for p in g) / len(g)
        named = Counter(p[3] for p in g)
        country = min(named, key=lambda k: (-named[k], min(p[0] for p in g if p[3] == k)))
        deaths = sum(p[4] for p in g)
        security = next(s for least, s in ((100, 5), (25, 10), (5, 15), (0, 25)) if deaths >= least)
        far = round(max(km(middle, p[1:3]) for p in g) + 15, 6)
        want[c] = (len(g), deaths, country, security, pytest.approx(middle[0], abs=6e-4), pytest.approx(middle[1], abs=6e-4), math.floor(min(120, max(25, far)) + 0.5))
    got = {r["cluster_id"]: (r["n"], r["deaths"], r["country"], r["security"], r["lat"], r["lon"], r["radius_km"]) for r in cluster.conflict_zones(df, cluster.cluster_points(df, 30)).collect()}
    assert got == want and len(want) > 5 and len({w[3] for w in want.values()}) > 1


def test_landmasses_equal_flood_fill(spark):
    rng = random.Random(6)
    cells = {(x % 36, y) for _ in range(14) for x0, y0 in [(rng.randrange(36), rng.randrange(18))] for x in range(x0, x0 + rng.randrange(1, 6)) for y in range(y0, min(18, y0 + 2))}
    label = {}
    for start in sorted(cells, key=lambda c: c[1] * 36 + c[0]):
        if start in label:
            continue
        todo = [start]
        while todo:
            x, y = todo.pop()
            if (x, y) in cells and (x, y) not in label:
                label[x, y] = start
                todo += [((x + a) % 36, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    got = {(r["x"], r["y"]): r["label"] for r in network.landmass_labels(spark.createDataFrame(sorted(cells), "x int, y int"), 10.0).collect()}
    pairs = {(label[c], got[c]) for c in cells}
    assert set(got) == cells and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_overland_equals_dijkstra(spark):
    """Land with a bay: ways round it, within each pair's budget."""
    res = 1.0
    land = {(180 + x, 90 + y) for x in range(12) for y in range(8)} - {(180 + x, 90 + y) for x in range(4, 7) for y in range(2, 8)}
    edges = network.land_cell_edges(spark.createDataFrame(sorted(land), "x int, y int"), res)
    steps = defaultdict(list)
    for r in edges.collect():
        steps[r["a"]].append((r["b"], r["km"]))
    code = lambda x, y: (90 + y) * 360 + 180 + x
    pairs = [(1, 2, code(0, 7), code(11, 7), 1200.0), (3, 4, code(0, 0), code(11, 0), 1200.0), (5, 6, code(3, 7), code(7, 7), 100.0), (7, 8, code(1, 1), code(1, 2), 120.0)]
    want = {}
    for src, dst, a, b, straight in pairs:
        done, heap = {}, [(0.0, a)]
        while heap:
            cost, cell = heapq.heappop(heap)
            if cell in done:
                continue
            done[cell] = cost
            for to, w in steps[cell]:
                heapq.heappush(heap, (cost + w, to))
        if b in done and done[b] <= min(2500.0, max(1.0, 2.5 * straight)):
            want[src, dst] = done[b]
    table = spark.createDataFrame(pairs, "src long, dst long, from_cell long, to_cell long, straight_km double")
    got = {(r["src"], r["dst"]): r["km"] for r in network.overland_km(table, edges, max_km=2500.0, res=res).collect()}
    assert got == pytest.approx(want) and len(want) == 3


def test_slugs_are_unique_and_folded(spark):
    names = ["Alpha", "Alpha", "Alpha 2", "Łódź", "Besançon", "Besancon", "Alpha", "Ångström–Ünïversity", "ﬁ", "Alpha 2", "Ｘ", "taken", "taken"]
    rows = spark.createDataFrame(list(enumerate(names)), "item long, name string")
    got = {r["item"]: r["slug"] for r in feeds.assign_slugs(rows, spark.createDataFrame([("taken",), ("taken_2",), ("alpha_4",)], "slug string")).collect()}
    assert len(set(got.values())) == len(got)
    assert [got[i] for i in (0, 1, 2, 6, 9)] == ["alpha", "alpha_3", "alpha_2", "alpha_5", "alpha_2_2"]
    assert got[3] == "odz" and got[4] == "besancon" and got[5] == "besancon_2" and got[7] == "angstrom_university" and {got[11], got[12]} == {"taken_3", "taken_4"}


def test_feed_without_its_columns_is_an_error(spark):
    with pytest.raises(ValueError, match="frp"):
        feeds.hotspot_points(spark.createDataFrame([(1, 1.0, 1.0, "h")], "event_id long, lat double, lon double, confidence string"))


def test_run_history_appends_and_forgets(spark):
    zone = spark.createDataFrame([(1, "flood"), (2, "wildfire"), (3, "flood")], "zone_id long, hazard_kind string")
    old = spark.createDataFrame([(dt.datetime(2024, 1, d), 9, "flood:9", "") for d in range(1, 6)], "run timestamp, total long, kinds string, notable string")
    got = refresh.run_history(old, zone, F.lit(dt.datetime(2024, 2, 1)), cap=3).collect()
    assert [(r["run"].day, r["total"], r["kinds"], r["notable"]) for r in got] == [(1, 3, "flood:2,wildfire:1", "1,3"), (5, 9, "flood:9", ""), (4, 9, "flood:9", "")]
    none = refresh.run_history(old, zone.where("false"), F.lit(dt.datetime(2024, 2, 1))).collect()
    assert len(none) == 6 and none[0]["total"] == 0


def test_planned_routes_equal_dijkstra_under_each_request_s_rules(spark):
    """Routes of any length by a plain search: cargo rules, modes, zones in effect, months, borders, seasons, queues, detours, gauges."""
    from freightgraph.plans import access, tables

    data = "/root/testdata/sf0.001"
    t = tables.Tables(spark, data)
    net = access.network_of(t)
    request = access.planned(t).where("crc32(cast(request_id as string)) % 10 = 1")  # both classes of cargo
    rows = lambda df: [r.asDict() for r in df.collect()]
    node, mode, zone = ({r[k]: r for r in rows(df)} for df, k in ((net.node, "node_id"), (net.mode, "mode"), (net.zone, "zone_id")))
    length, condition, detour = {r["edge_id"]: r["km"] for r in rows(net.length)}, {r["zone_id"]: r["delay_factor"] for r in rows(net.condition)}, {r["zone_id"]: r["detour_factor"] for r in rows(net.detour)}
    inside, ban, crossing = defaultdict(set), defaultdict(set), defaultdict(dict)
    for r in rows(net.node_zone):
        inside[r["node_id"]].add(r["zone_id"])
    for r in rows(net.ban):
        ban[r["zone_id"]].add(r["country"])
    for r in rows(net.edge_zone):
        crossing[r["edge_id"]][r["zone_id"]] = r["km"]
    frozen = {(r["month"], r["zone_id"]) for r in rows(net.closed)}
    shut = {(frozenset((r["left_country"], r["right_country"])), r["mode"]) for r in rows(net.border_rule)}
    broken, econ = {r["edge_id"] for r in rows(net.gauge_break)}, {r["node_id"]: r["econ"] for r in rows(net.econ)}
    edges, stops = rows(net.edge), defaultdict(list)
    for r in sorted(rows(t.x_stop), key=lambda r: (r["request_id"], r["seq"])):
        stops[r["request_id"]].append(r["node_id"])

    def legs_for(r):
        civilian = r["cargo_class"] != "military"
        modes = {m for m, c in mode.items() if r["weight_tonnes"] <= c["max_tonnes"]} - ({"air"} if "hazmat" in r["handling"] else set()) - ({"sea"} if "perishable" in r["handling"] else set())
        day = r["depart"].replace(hour=0)
        on = {z for z, x in zone.items() if x["active_from"] <= day + dt.timedelta(days=net.horizon_days) and x["active_until"] >= day}
        barred = {z for z in on if civilian and (zone[z]["access"] == "military-only" or (zone[z]["access"] == "hazard" and zone[z]["hazard_kind"] in ("earthquake", "volcano")))}
        ok = {n for n, x in node.items() if not civilian or (x["kind"] != "military" and not inside[n] & barred)}
        out, hubs = [], set()
        for e in edges:
            zones = {z: d for z, d in crossing[e["edge_id"]].items() if z in on}
            pair = frozenset((node[e["src"]]["country"], node[e["dst"]]["country"])) if {e["src"], e["dst"]} <= set(node) else None
            if not {e["src"], e["dst"]} <= ok or any(z in barred or (r["month"], z) in frozen for z in zones) or (civilian and len(pair) == 2 and (pair, e["mode"]) in shut):
                continue
            hubs |= {(e["src"], e["mode"]), (e["dst"], e["mode"])}
            if e["mode"] not in modes:
                continue
            c, far, slow = mode[e["mode"]], 1.0, 1.0
            for z in zones:
                if civilian and detour.get(z) and (z not in ban or pair <= ban[z]):
                    far *= detour[z]
                slow *= (zone[z]["delay_factor"] if zone[z]["delay_month"] == r["month"] else 1) * condition.get(z, 1)
            d = length[e["edge_id"]] * c["detour_factor"] * far
            usd, low = 0.0, 0.0
            for high, share in ((500, 1.9), (1500, 1.35), (5000, 1.05), (math.inf, 1.0)):
                usd += max(0.0, min(d, high) - low) * share * c["usd_per_km"]
                low = high
            usd += sum(km_in * zone[z]["surcharge_usd_per_km"] + zone[z]["toll_usd"] for z, km_in in zones.items()) + (220 if e["edge_id"] in broken else 0)
            out.append((e["edge_id"], e["src"], e["dst"], e["mode"], usd, d / c["km_per_hour"] * slow + (18 if e["edge_id"] in broken else 0), d))
        return out, ok

    def load(n, m):
        share = econ[n] / 100
        return mode[m]["hub_usd"] * (1.6 - 0.7 * share), mode[m]["hub_hours"] * (2.2 - 1.6 * share), 0.0

    want = {}
    for r in rows(request):
        way, (legs, ok) = stops[r["request_id"]], legs_for(r)
        if len(set(way)) < len(way) or not set(way) <= ok:
            continue
        steps = defaultdict(list)
        for edge_id, a, b, m, *w in legs:
            steps[a].append((b, m, w))
            steps[b].append((a, m, w))
        for i, objective in enumerate(("cheapest", "fastest", "most-direct")):
            total = 0.0
            for a, b in zip(way, way[1:]):
                done, heap = set(), [(0.0, a, "")]
                while heap:
                    cost, n, m = heapq.heappop(heap)
                    if n == b or not heap and n != b and (n, m) in done:
                        break
                    if (n, m) in done:
                        continue
                    done.add((n, m))
                    for to, by, w in steps[n]:
                        if to != a:
                            heapq.heappush(heap, (cost + w[i] + (0 if by == m else load(n, by)[i]), to, by))
                total += cost if n == b else math.inf
            if total < math.inf:
                want[r["request_id"], objective] = total
    plan = planning.compute_routes(net, request, t.x_stop)
    units = {r["request_id"]: max(1, r["weight_tonnes"] / 20, r["volume_m3"] / 33) for r in rows(request)}
    got, lengths = defaultdict(float), Counter()
    for leg in rows(plan.legs):
        k = leg["request_id"], leg["objective"]
        got[k] += {"cheapest": leg["usd"] / units[leg["request_id"]], "fastest": leg["hours"], "most-direct": leg["km"]}[leg["objective"]]
        lengths[k] += 1
    assert {k[0] for k in got} == {k[0] for k in want} and want
    for k, total in got.items():  # an option equal to an earlier one is left out
        assert total == pytest.approx(want[k], rel=1e-9)
    assert max(lengths.values()) > 3 and {r["cargo_class"] for r in rows(request) if any(k[0] == r["request_id"] for k in got)} == {"civilian", "military"}
    found = {r["request_id"] for r in rows(planning.routable(net, request, t.x_stop))}
    assert found == {k[0] for k in want}
    reasons = {r["request_id"]: r for r in rows(planning.no_route_reason(net, request, t.x_stop))}
    assert set(reasons) == {r["request_id"] for r in rows(request)} - found
    for r in rows(request):
        if r["request_id"] in reasons:
            site = r["cargo_class"] != "military" and any(node[n]["kind"] == "military" for n in stops[r["request_id"]])
            assert (reasons[r["request_id"]]["reason"] == "restricted military site") == site


def test_pairs_over_the_dateline(spark):
    at = [(1, 57.895, -178.29), (2, 57.733, 178.363), (3, 89.9, 10.0), (4, 89.8, -170.0), (5, -89.95, 0.0), (6, -89.9, 179.0)]
    rng = random.Random(5)
    at += [(10 + i, rng.uniform(-89, 89), (180 + rng.uniform(-4, 4)) % 360 - 180) for i in range(400)]
    df = spark.createDataFrame(at, "node_id long, lat double, lon double")
    for reach in (200, 333):
        want = {(a[0], b[0]) for a in at for b in at if a[0] != b[0] and km(a[1:], b[1:]) <= reach}
        assert {(r["src"], r["dst"]) for r in network.near_pairs(df, reach).collect()} == want and (1, 2) in want and (3, 4) in want
    sites = df.select(F.col("node_id").alias("item"), "lat", "lon").where("item = 1")
    assert feeds.dedupe_near(sites, df.where("node_id = 2"), 200).count() == 0 and feeds.dedupe_near(sites, df.where("node_id = 2"), 198).count() == 1


def test_masks_of_many_shapes(spark):
    tags = spark.createDataFrame([(1, 2, s) for s in range(200) if s % 3 != 1] + [(3, 1, 63), (3, 1, 64)], "src long, dst long, shape_id long")
    places = spark.range(200).select(F.col("id").alias("shape_id"), F.col("id").cast("int").alias("bit"))
    edge = spark.createDataFrame([(7, 2, 1, "air"), (8, 3, 1, "air"), (9, 1, 2, "sea")], "edge_id long, src long, dst long, mode string")
    got = {(r["edge_id"], r["shape_id"]) for r in spatial.airspace_on_leg(edge, spatial.airspace_mask(tags, places), places).collect()}
    assert got == {(7, s) for s in range(200) if s % 3 != 1} | {(8, 63), (8, 64)}


def test_air_network_without_hubs(spark):
    node = spark.createDataFrame([(i, 10.0 * i, 5.0) for i in (1, 2, 3)], "node_id long, lat double, lon double")
    pairs = lambda hubs: {(r["src"], r["dst"]) for r in network.air_network(node, node.where(hubs)).collect()}
    assert pairs("false") == pairs("node_id = 2") == {(1, 2), (1, 3), (2, 3)}
    assert pairs("node_id < 3") == {(1, 2), (3, 1), (3, 2)}


def test_coverage_leaves_military_places_out(spark):
    node = spark.createDataFrame([(1, "city"), (2, "military"), (3, "military"), (4, "city")], "node_id long, kind string")
    none = spark.createDataFrame([], "src long, dst long")
    assert quality.check_coverage(node, none, spark.createDataFrame([(1, 1)], "src long, dst long")).count() == 0
    assert quality.check_coverage(node.where("kind = 'city'"), none, none).count() == 1


def test_leading_run_needs_a_bad_first_point(spark):
    rows = [(1, 0, s, 0.0 if s < 0 else 5.0, bad) for s, bad in ((-1, False), (0, True), (1, True), (2, False))]
    rows += [(2, 0, s, 0.0 if s < 0 else 5.0, bad) for s, bad in ((-1, True), (0, True), (1, False), (2, True))]
    samples = spark.createDataFrame(rows, "edge_id long, seg long, s long, step_km double, is_bad boolean")
    run = lambda tail: {r["edge_id"]: r["km"] for r in spatial.leading_run(samples, tail).collect()}
    assert run(False) == {2: 5.0} and run(True) == {2: 0.0}


def test_cut_off_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 21), (30, 31), (31, 32)], "src long, dst long")
    got = {r["node"]: (r["component"], r["size"], r["rank"], r["cut_off"]) for r in cut_off(connected_components(edges)).collect()}
    assert got[2] == (1, 3, 1, False) and got[31] == (30, 3, 2, True) and got[10] == (10, 2, 3, True) == (10, *got[11][1:]) and got[20][2] == 3


def test_bitmaps_hold_every_cell(spark):
    cells = spark.createDataFrame([(0, 0), (63, 0), (64, 0), (359, 179), (127, 90)], "x int, y int")
    points = spark.createDataFrame([(x, y, x - 179.5, y - 89.5) for x in (0, 1, 63, 64, 65, 127, 359) for y in (0, 90, 179)], "x int, y int, lon double, lat double").withColumnRenamed("x", "px").withColumnRenamed("y", "py")
    got = {(r["px"], r["py"]) for r in network.in_cells(points, cells, 1.0).where("hit").collect()}
    assert got == {(0, 0), (63, 0), (64, 0), (359, 179), (127, 90)}


def test_waters_equal_a_plain_trace(spark):
    res, nx, ny = 1.0, 360, 180
    line = [(179.2, 10.3), (181.9, 12.8), (183.0, 12.0)]
    lake = [(20.0, 30.0), (24.5, 31.0), (22.0, 34.5)]
    def trace(a, b):
        n = max(1, math.ceil(max(abs(b[0] - a[0]), abs(b[1] - a[1])) / (res / 2)))
        for s in range(n + 1):
            x, y = a[0] + (b[0] - a[0]) * s / n, a[1] + (b[1] - a[1]) * s / n
            yield int((x + 180) % 360 // res), min(ny - 1, max(0, int((y + 90) // res)))

    inland = {c for a, b in zip(line, line[1:]) for c in trace(a, b)} | {c for a, b in zip(lake, lake[1:] + lake[:1]) for c in trace(a, b)}  # noqa: B905
    for x in range(nx):
        for y in range(ny):
            px, py, odd = x - 179.5, y - 89.5, False
            for a, b in zip(lake, lake[1:] + lake[:1]):  # noqa: B905
                odd ^= (a[1] > py) != (b[1] > py) and px < a[0] + (b[0] - a[0]) * (py - a[1]) / (b[1] - a[1])
            if odd:
                inland.add((x, y))
    want = {((x + dx) % nx, y + dy) for x, y in inland for dx in (-1, 0, 1) for dy in (-1, 0, 1)}
    every = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("x"), F.floor(F.col("id") / nx).cast("int").alias("y"))
    lines = spark.createDataFrame([(1, i, *p) for i, p in enumerate(line)], "line_id long, pos int, lon double, lat double")
    lakes = spark.createDataFrame([(1, i, *p) for i, p in enumerate(lake)], "zone_id long, pos int, lon double, lat double")
    assert {(r["x"], r["y"]) for r in network.water_cells(every, lines, lakes, res).collect()} == want
    assert network.water_cells(every.where("x != 7"), lines.where("false"), lakes.where("false"), res).count() == ny


@pytest.mark.parametrize("most", [100_000, 5])
def test_upper_median_equals_sorting(spark, most):
    rng = random.Random(9)
    rows = [("a", rng.gauss(0, 10)) for _ in range(401)] + [("b", float(rng.randrange(30))) for _ in range(400)] + [("c", 1.5)] * 7 + [("d", None)] + [("e", rng.choice([1e-9, 1.0, 1e12]) * rng.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {k: (sorted(v for c, v in rows if c == k)[sum(c == k for c, _ in rows) // 2], sum(c == k for c, _ in rows)) for k in "abce"}
    assert {r["k"]: (r["m"], r["n"]) for r in upper_median(df, ["k"], "v", "m", 4, most).collect()} == want


def test_rings_equal_plain_ray_cast(spark):
    """Slanted, concave and nested rings and rings on cell borders, with points everywhere, on grid lines too."""
    rng = random.Random(11)
    rings = {(1, 0): [(-150.0, -40.0), (-115.0, -40.0), (-115.0, -10.0), (-150.0, -10.0)], (2, 0): [(0.0, 0.0), (20.0, 3.0), (9.0, 7.5), (19.0, 18.0), (4.0, 12.0)], (2, 1): [(5.0, 4.0), (8.0, 5.0), (7.0, 8.0)], (3, 0): [(30.1, 30.2), (30.4, 30.3), (30.2, 30.9)]}
    rings[4, 0] = [(50 + (8 if i % 2 else 3) * math.cos(i * math.pi / 9), -20 + (8 if i % 2 else 3) * math.sin(i * math.pi / 9)) for i in range(18)]
    at = [(rng.uniform(-160, 70), rng.uniform(-45, 40)) for _ in range(1500)] + [(rng.uniform(-2, 22), rng.uniform(-1, 19)) for _ in range(1500)] + [(rng.uniform(40, 60), rng.uniform(-30, -10)) for _ in range(1000)] + [(rng.uniform(30, 30.5), rng.uniform(30, 31)) for _ in range(300)]
    at += [(2.0 * x, y + 0.31) for x in range(-80, 35) for y in range(-44, 40, 3)] + [(x + 0.37, 2.0 * y) for x in range(-160, 70, 3) for y in range(-22, 20)]

    def inside(ring, x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):  # noqa: B905
            odd ^= (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1)
        return odd

    table = spark.createDataFrame([(s, r, i, *p) for (s, r), ring in rings.items() for i, p in enumerate(ring)], "shape_id long, ring_no long, pos long, lon double, lat double")
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "point_id long, lon double, lat double")
    got = {tuple(r) for r in spatial._in_rings(points, table, ["shape_id", "ring_no"]).collect()}
    assert got == {(i, *k) for i, p in enumerate(at) for k, ring in rings.items() if inside(ring, *p)}
    corners, touched = spatial.ring_cover(table, ["shape_id", "ring_no"])
    assert touched.where("shape_id = 1").count() <= 100 and corners.where("shape_id = 1 and whole").count() > 200


def test_scratch_tables_belong_to_their_block(spark):
    import threading

    df, seen = spark.range(3), {}
    with scratch.discarded(spark):
        inner, path = scratch.stored(df, "t")
        thread = threading.Thread(target=lambda: seen.update(path=scratch.stored(df, "t")[1]))
        thread.start()
        thread.join()
        assert inner.count() == 3
    assert not os.path.exists(path.removeprefix("file:")) and os.path.exists(seen["path"].removeprefix("file:"))
    assert spark.read.parquet(seen["path"]).count() == 3
