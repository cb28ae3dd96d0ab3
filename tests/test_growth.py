"""Plans and figures that must not grow faster than the tables."""

import dataclasses
import datetime as dt
import math
import random

from freightgraph.functions import geo
from freightgraph.operators import planning, routes, spatial
from freightgraph.plans import access
from freightgraph.plans.geometry import hub_pairs
from freightgraph.plans.registry import ORACLES, QUERIES
from freightgraph.plans.tables import ORACLE_VIEWS, Tables
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_legs_and_zones_meet_by_remainder(spark):
    """Made in the tasks of what reads them: an equi join, and no shuffle of the pairs."""
    plan = plan_of(Tables(spark, DATA).x_edge_zone.groupBy("edge_id").count())
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and plan.count("Exchange hashpartitioning") == 1
    for name in ("c5_live_delay", "d8_check_tags", "j2_merge_edge_zones"):
        assert "NestedLoop" not in plan_of(QUERIES[name](spark, DATA))


def test_oracles_write_no_negative_zero():
    """A coordinate that rounds to zero has no sign, in the SQL of g4 and of the features."""
    import duckdb
    from freightgraph.plans.feeds import POINT_SQL

    assert duckdb.sql(f"SELECT {POINT_SQL} FROM (SELECT -0.00001e0 AS lon, -0.00002e0 AS lat)").fetchall() == [("[0.0,0.0]",)]
    con = duckdb.connect()
    con.sql("CREATE TABLE f_edge AS SELECT 1 AS edge_id, 1 AS src, 2 AS dst")
    con.sql("CREATE TABLE f_node AS SELECT * FROM (VALUES (1, -0.0003e0, 0.0e0), (2, -0.0003e0, 50.0e0)) AS n(node_id, lat, lon)")
    sql = ORACLES["g4_great_circle_point"]
    assert str(con.sql(sql[sql.index("SELECT edge_id, round(degrees(") :]).fetchall()[0][2]) == "0.0"


def test_walk_ends_on_the_segments_end(spark):
    """Not an ulp beside it, where a cell's border may lie between."""
    points = spark.createDataFrame([(i, "sea", p, lon, lat) for i in range(300) for p, lon, lat in ((0, 0.0, i / 7 - 20), (2, 9.0, float(i % 70)))], "edge_id long, mode string, pos int, lon double, lat double")
    rows = spatial.sample_polyline(points, 50, midpoint=False).groupBy("edge_id").agg(F.max_by("lat", "s").alias("lat"), F.max_by("lon", "s").alias("lon")).collect()
    assert len(rows) == 300 and all((r["lon"], r["lat"]) == (9.0, float(r["edge_id"] % 70)) for r in rows)


def test_circles_by_finer_cells(spark):
    """The same pairs as by the 10-degree cells of the boxes and the distance alone, also at poles and the dateline."""
    rng = random.Random(3)
    zones = [(i, rng.uniform(-89.5, 89.5), rng.uniform(-180, 180), rng.choice((5.0, 300.0, 900.0, 9000.0, 25000.0))) for i in range(60)] + [(60, 20.0, 179.5, 700.0), (61, 89.9, 0.0, 400.0), (62, 0.0, 0.0, 0.0)]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(3000)] + [(3000, 0.0, 0.0), (3001, float("nan"), 0.0)]
    z = spark.createDataFrame(zones, "zone_id long, lat double, lon double, radius_km double")
    p = spark.createDataFrame(points, "point_id long, lat double, lon double")
    none = spark.createDataFrame([], "zone_id long, pos int, lon double, lat double")
    at = z.select("zone_id", F.col("lat").alias("z_lat"), F.col("lon").alias("z_lon"), "radius_km")
    cells = spatial.zone_grid_cells(z.select("zone_id", *geo.circle_box("lat", "lon", "radius_km"))).join(at, "zone_id")
    near = geo.haversine_km("lat", "lon", "z_lat", "z_lon") <= F.col("radius_km")
    want = p.join(cells, (F.floor(F.col("lon") / 10) == F.col("cx")) & (F.floor(F.col("lat") / 10) == F.col("cy"))).where(near).select("point_id", "zone_id")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spatial.zones_at_points(p, z, none)) == rows(want)
    assert rows(spatial.point_in_circle(p, z)) == rows(p.crossJoin(at).where(near).select("point_id", "zone_id"))


def test_samples_and_hits_stay_in_even_tasks(spark):
    """Polylines are spread by number before they are sampled; pairs of points and circles are not shuffled again."""
    t = Tables(spark, DATA)
    assert "REPARTITION_BY_NUM" in plan_of(spatial.sample_polyline(t.f_edge_point))
    assert "HashAggregate" not in plan_of(spatial.point_in_circle(t.x_point, t.f_zone)).split("BroadcastHashJoin")[0]


def test_hazards_listed_twice_are_counted_twice():
    """5120 is a zone that the query's input lists twice and without a circle, 280 a flood whose kind it renames."""
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE TABLE f_zone AS SELECT * FROM (VALUES (5120, 'hazard', 'volcano'), (280, 'hazard', 'flood')) AS z(zone_id, access, hazard_kind)")
    con.sql("CREATE TABLE x_hazard_edge_zone AS SELECT 1 AS edge_id, 1 AS zone_id WHERE FALSE")
    con.sql("CREATE VIEW o_hazard_row AS " + ORACLE_VIEWS["o_hazard_row"])
    sql = ORACLES["d12_check_hazards"]
    rows = sorted(con.sql(sql[sql.index('SELECT "check", CAST(key') :]).fetchall())
    assert rows == [("duplicate hazard", "5120", "2"), ("no circle", "5120", "volcano"), ("no circle", "5120", "volcano"), ("unknown kind", "280", "flood2")]


def test_legs_that_are_alike_meet_the_zones_once(spark, monkeypatch):
    """What is derived by leg from x_edge_zone comes from the rows of one leg for each kind: none of its queries reads the view itself."""
    t = Tables(spark, DATA)
    like, edge_zone = t.alike()
    legs = like.join(edge_zone.withColumnRenamed("edge_id", "like"), "like").select("edge_id", "zone_id", "km")
    assert sorted(map(tuple, legs.collect())) == sorted(map(tuple, t.x_edge_zone.select("edge_id", "zone_id", "km").collect())) != []
    made, crossing = [], Tables.crossing
    monkeypatch.setattr(Tables, "crossing", lambda self, name, legs=None: (made.append(legs is not None), crossing(self, name, legs))[1])
    for name in ("j6_overflight_detour", "c2_leg_distance", "c3_zone_charges", "c4_seasonal_delay", "c5_live_delay", "c6_leg_cost", "c9_risk_penalty", "c10_usable_legs"):
        QUERIES[name](spark, DATA)
        assert made and all(made), name
        made.clear()


def test_airspace_samples_are_made_once_in_even_tasks(spark):
    """The formula's steps stand in the plan once, not wherever they are used; a pair's samples stay in the task they are made in."""
    plan = plan_of(spatial.tag_airspace(hub_pairs(Tables(spark, DATA)), Tables(spark, DATA).x_ring))
    assert plan.count("ASIN(") <= 4 and plan.count("ATAN2(") == 2
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(src" in plan and "hashpartitioning(point_id" not in plan


def test_prices_are_made_once(spark, monkeypatch):
    """Routes' legs read the prices of the search."""
    made = []
    priced = access.costs
    monkeypatch.setattr(access, "costs", lambda t: (made.append(t), priced(t))[1])
    assert access.legs_of(Tables(spark, DATA)).columns[:3] == ["request_id", "objective", "leg_no"]
    assert len(made) == 1


def test_planning_prices_once(spark, monkeypatch):
    """The second search of safer offers and the tries without flags use the prices of the first."""
    made = []
    price = planning.price
    monkeypatch.setattr(planning, "price", lambda *a: (made.append(a), price(*a))[1])
    for name in ("r13_safer_offer", "r14_no_route_reason"):
        QUERIES[name](spark, DATA)
        assert len(made) == 1, name
        made.clear()


def test_planning_meets_zones_once_for_legs_that_are_alike(spark):
    """No row for each leg and zone: planning prices without them, by the zones of one leg of each kind, which are spread over tasks."""
    net = access.network_of(Tables(spark, DATA))
    assert "REPARTITION_BY_NUM" in plan_of(net.like_zone)
    classes = planning.constraint_sets(net, access.planned(Tables(spark, DATA))).select("class_id", "civilian", "month", "day").distinct()
    alike = planning.price(dataclasses.replace(net, edge_zone=None), classes)
    single = planning.price(dataclasses.replace(net, like=None, like_zone=None), classes)
    rows = lambda df: sorted((r["class_id"], r["edge_id"], r["mode"], *(round(r[c], 6) for c in ("usd", "hours", "km"))) for r in df.collect())
    assert rows(alike.legs) == rows(single.legs) != []


def test_requests_that_ask_alike_are_ruled_once(spark, monkeypatch):
    """Rules and modes grow with the kinds of requests, not with the requests."""
    ruled = []
    resolve = planning.rules.resolve_cargo
    monkeypatch.setattr(planning.rules, "resolve_cargo", lambda request, *a: (ruled.append(request.count()), resolve(request, *a))[1])
    t = Tables(spark, DATA)
    asked = access.planned(t)
    net = access.network_of(t)
    want = sorted(map(tuple, planning.constraint_sets(net, asked).collect()))
    more = asked.unionByName(asked.withColumn("request_id", F.col("request_id") + 10**9))
    got = sorted(map(tuple, planning.constraint_sets(net, more).collect()))
    assert got == sorted(want + [(w[0] + 10**9, *w[1:]) for w in want]) != []
    assert len(ruled) == 2 and ruled[0] == ruled[1]


def test_zones_on_no_leg_are_told_by_legs_that_are_alike(spark, monkeypatch):
    """The pairs of legs and zones are made once, for the answer's own rows, of zones that are unknown alone."""
    made, crossing = [], Tables.crossing
    monkeypatch.setattr(Tables, "crossing", lambda self, name, legs=None: (made.append(legs is not None), crossing(self, name, legs))[1])
    df = QUERIES["d8_check_tags"](spark, DATA)
    assert sorted(made) == [False, True]
    plan = plan_of(df)
    assert plan.index("LeftAnti") > plan.index("pmod(")  # unknown zones are told before they meet the legs
    t = Tables(spark, DATA)
    on = {r["zone_id"] for r in t.x_edge_zone.select("zone_id").distinct().collect()}
    bare = {r["zone_id"] for r in t.f_zone.where("zone_id % 60 != 0").collect()} - on
    assert {int(r["key"]) for r in df.where("check = 'zone on no leg'").collect()} == bare


def _route_tables(spark):
    rng = random.Random(11)
    routes_ = {(r, o): [rng.randrange(12) for _ in range(7)] for r in range(6) for o in ("cheapest", "fastest")}
    legs = [(r, o, i, e, 100 + e, 101 + e, 0.75 * (i + 1) * (r + 1) * 20) for (r, o), es in routes_.items() for i, e in enumerate(es)]
    on = {(e, z) for e in range(10) for z in range(14) if (z + e * (1 + z % 3)) % 3 == 0}  # groups that overlap on legs; legs 10 and 11 cross none
    start = dt.datetime(2024, 1, 1)
    zones = {z: (z, f"z{z}", "hazard" if z % 2 else "open", ("flood", "volcano", "?")[z % 3], 7 * z % 101, None if z == 5 else start + dt.timedelta(hours=20 * z), start + dt.timedelta(hours=20 * z + 90)) for z in range(14)}
    table = spark.createDataFrame(list(zones.values()), "zone_id long, label string, access string, hazard_kind string, security long, active_from timestamp, active_until timestamp")
    legs_ = spark.createDataFrame(legs, "request_id long, objective string, leg_no int, edge_id long, from_node long, to_node long, eta_hours double").withColumn("eta_hours", F.col("eta_hours").cast("long"))
    return routes_, on, zones, legs_, spark.createDataFrame(sorted(on), "edge_id long, zone_id long"), table, start


def test_hazards_of_routes_are_told_by_groups_of_zones(spark):
    """the rows of routes and zones are made last and in place, neither shuffled nor made distinct."""
    of, on, zones, legs, edge_zone, zone, start = _route_tables(spark)
    request = spark.createDataFrame([(r, start + dt.timedelta(hours=r)) for r in range(6)], "request_id long, depart timestamp")
    told = routes.hazard_timing(legs, edge_zone, zone, request)
    plan = plan_of(told)
    assert 0 < plan.index("zone_group") < min(plan.index("Exchange"), plan.index("Aggregate"))
    want = set()
    for (r, o), es in of.items():
        for i, e in enumerate(es):
            at = start + dt.timedelta(hours=r + int(0.75 * (i + 1) * (r + 1) * 20))
            want |= {(r, o, z, (zones[z][5] is None or zones[z][5] <= at) and zones[z][6] >= at) for z in zones if (e, z) in on and zones[z][2] == "hazard"}
    got = told.collect()
    assert len(got) == len(want) and {(x["request_id"], x["objective"], x["zone_id"], x["active"]) for x in got} == want
    assert all(x["note"] == zones[x["zone_id"]][1] if not x["active"] else x["note"].startswith(zones[x["zone_id"]][1] + " — ") for x in got)


def test_score_of_a_route_by_groups_of_zones(spark):
    """zones count once a route, stops as often as they are met; the rows of routes and zones are not made."""
    of, on, zones, legs, edge_zone, zone, _ = _route_tables(spark)
    security = spark.createDataFrame([(n, n % 90) for n in range(100, 113) if n != 104], "node_id long, security long")
    safe = lambda n: 50 if n == 104 else n % 90
    want = {}
    for (r, o), es in of.items():
        s = [safe(100 + es[0]), *[safe(101 + e) for e in es], *[zones[z][4] for z in zones if any((e, z) in on for e in es)]]
        want[r, o] = math.floor(round(0.6 * min(s) + 0.4 * sum(s) / len(s), 6) + 0.5)
    assert {(x["request_id"], x["objective"]): x["score"] for x in routes.route_security(legs, security, edge_zone, zone).collect()} == want
    on_leg, of_group = routes.zone_groups(edge_zone)
    groups = of_group.select("zone_group").distinct().count()
    assert groups < len(zones) and on_leg.select(F.sum(F.size("zone_groups"))).first()[0] < len(on)


def test_notes_of_a_route_by_groups_of_zones(spark, monkeypatch):
    """labels in the order in which a route meets their zones, zones of one leg by id; the texts are looked up, not shuffled, and joined where they are too many."""
    of, on, zones, legs, edge_zone, zone, _ = _route_tables(spark)
    gauge = spark.createDataFrame([(2, "a → b"), (7, "b → a")], "edge_id long, label string")
    node = spark.createDataFrame([(n, f"n{n}") for n in range(100, 113)], "node_id long, name string")
    border = spark.createDataFrame([(1, "q1"), (3, "q2"), (8, "q1")], "edge_id long, label string")
    condition = spark.createDataFrame([(z, f"slow {z % 2}") for z in (0, 3, 4, 9)], "zone_id long, label string")
    want = set()
    for (r, o), es in of.items():
        first = {z: min(i for i, e in enumerate(es) if (e, z) in on) for z in zones if any((e, z) in on for e in es)}
        met = sorted(first, key=lambda z: (first[z], z))
        once = lambda xs: "; ".join(dict.fromkeys(xs))
        want.add((r, o, "; ".join(zones[z][1] for z in met), "; ".join(f"n{101 + e} · " + {2: "a → b", 7: "b → a"}[e] for e in es if e in (2, 7)), once({1: "q1", 3: "q2", 8: "q1"}[e] for e in es if e in (1, 3, 8)), once(f"slow {z % 2}" for z in met if z in (0, 3, 4, 9))))
    notes = lambda: routes.route_notes(legs, edge_zone, zone, gauge, node, border, condition)
    there = notes()
    assert "Exchange" not in plan_of(there) and "Sort" not in plan_of(there)
    assert {tuple(x) for x in there.collect()} == want
    monkeypatch.setattr(routes, "FEW", 0)
    assert {tuple(x) for x in notes().collect()} == want


def test_points_in_zones_of_two_shapes_count_once(spark):
    """a zone with a circle and a ring has a point once, and only rings' rows are shuffled for it."""
    rng = random.Random(8)
    zone = spark.createDataFrame([(z, rng.uniform(-30, 30), rng.uniform(-60, 60), 900.0) for z in range(20)], "zone_id long, lat double, lon double, radius_km double")
    ring = [(-20.0, -20.0), (20.0, -20.0), (20.0, 20.0), (-20.0, 20.0)]
    vertices = spark.createDataFrame([(z, i, lon + z, lat) for z in (3, 4, 99) for i, (lon, lat) in enumerate(ring)], "zone_id long, pos int, lon double, lat double")
    points = spark.createDataFrame([(i, rng.uniform(-40, 40), rng.uniform(-70, 70)) for i in range(4000)], "point_id long, lat double, lon double")
    told = spatial.zones_at_points(points, zone, vertices)
    rows = lambda df: sorted(map(tuple, df.select("point_id", "zone_id").collect()))
    either = spatial.zones_at_points(points, zone, vertices.where("zone_id = 99")).unionByName(spatial.point_in_ring(points, vertices))
    assert rows(told) == rows(either.distinct()) != rows(either)
    plan = plan_of(told)
    assert plan.index("Union") < min(plan.index("Aggregate"), plan.index("Exchange"))  # no distinct over all
    twice = zone.unionByName(zone.where("zone_id = 5"))
    assert rows(spatial.zones_at_points(points, twice, vertices)) == rows(told)


def test_tags_of_legs_that_share_an_id(spark):
    """F16: an id that two legs have packs its zones once, and every leg reads them as often as the SQL does."""
    from freightgraph.plans import feeds as plans

    t = Tables(spark, DATA)
    tagged = t.x_edge_zone.agg(F.min("edge_id")).first()[0]
    other = t.f_edge.where(F.col("edge_id") != tagged).agg(F.max("edge_id")).first()[0]
    t.f_edge.withColumn("edge_id", F.when(F.col("edge_id") == other, tagged).otherwise(F.col("edge_id"))).createOrReplaceTempView("w_shared")
    t = Tables(spark, DATA)
    t.ready["f_edge"] = "SELECT * FROM w_shared"
    got = plans.src14_read_tags(t)
    want = t.sql("SELECT CAST(src AS STRING) AS src, CAST(dst AS STRING) AS dst, mode, concat('z', z.zone_id) AS zone_id, km FROM f_edge e JOIN x_edge_zone z ON z.edge_id = e.edge_id")
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.select("src", "dst", "mode", "zone_id", "km").collect())
    assert rows(got) == rows(want) != [] and got.count() > got.distinct().count()
