"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightgraph.functions.scratch import delete, stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): ``component`` is the smallest node that can be reached.

    Each round links every node's larger neighbours to its smallest one (large star), then its
    smaller neighbours (small star); the number of rounds grows with the logarithm of the longest
    chain. A node with very many neighbours is met by a minimum that is partly aggregated before
    the shuffle and a join that the adaptive planner can split. A round's table is written to the
    shared folder and the one before it deleted. Nulls and self-links are dropped, repeated links
    count once; nodes without links do not appear.
    """
    spark = edges.sparkSession
    e, path = stored(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .distinct(),
        "links",
    )
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(lows, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(lows, "u").select(F.explode(ends).alias("p")).select("p.*").where("u != v").distinct()
        now, at = stored(small, "links")
        # settled when a round gives the links it got: as many, and none that is new
        same = now.count() == e.count() and now.join(e, ["u", "v"], "left_anti").isEmpty()
        delete(spark, path)
        e, path = now, at
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def cut_off(components: DataFrame) -> DataFrame:
    """(node, component, size, rank, cut_off): components by size, the largest first (of equals the smallest name); all nodes but those of the first are cut off.

    Sizes are partly aggregated before the shuffle. Only the largest component can be larger than half of all
    nodes; its nodes do not join.
    """
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    first = sizes.agg(F.max_by(F.struct("component", "size"), F.struct("size", (-F.col("component")).alias("c"))).alias("top"))
    met = components.crossJoin(F.broadcast(first))  # one row
    main = met.where("component = top.component").select("node", "component", F.col("top.size").alias("size"), F.lit(1).alias("rank"), F.lit(False).alias("cut_off"))
    rest = sizes.crossJoin(F.broadcast(first)).where("component != top.component").drop("top")
    # equal sizes rank alike, so ranks come from the distinct sizes, which are few: n components have at most about the root of 2n
    tiers = rest.groupBy("size").agg(F.count("*").alias("n"))
    tiers = tiers.select("size", (F.coalesce(F.sum("n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 2).cast("int").alias("rank"))
    others = met.where("component != top.component").drop("top").join(rest.join(tiers, "size"), "component")
    return main.unionByName(others.select("node", "component", "size", "rank", F.lit(True).alias("cut_off")))
