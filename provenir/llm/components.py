"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import cut
from provenir.storage import BROADCAST_ROWS


#: Parts into which a node's neighbours are dealt, so that a hub's edges never meet in one task.
PARTS = 256


def _star(edges: DataFrame, *, large: bool, few: bool) -> DataFrame:
    """One step over edges (u, v): every neighbour above (large) or not above (small) a node moves to its least neighbour.

    Where the edges are ``few``, each node's least neighbour is broadcast and no edge is moved for it.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    if few:
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(F.broadcast(low), "u")
    else:
        both = both.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))
        parts = both.groupBy("u", "part").agg(F.min("v").alias("m"))
        low = parts.groupBy("u").agg(F.min("m").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(parts.select("u", "part").join(low, "u"), ["u", "part"]).drop("part")
    if large:
        return moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    own = low.filter("u <> m").select("u", F.col("m").alias("v"))
    return moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each node of edges (a, b); root is the smallest id reachable.

    Nulls and self-links are ignored; an empty input gives an empty result. Each pass is written to shared storage,
    so lineage stays short; the number of passes grows with the logarithm of a component's diameter. A node's edges are
    spread over ``PARTS`` tasks, which exchange one least neighbour each, unless the counted edges are few enough for the
    least neighbours to be broadcast.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        few = mark[0] <= BROADCAST_ROWS // 2  # two numbers each; a node at most for each end
        now = cut(_star(cut(_star(now, large=True, few=few), "edges"), large=False, few=few), "edges")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
