"""Reachability, neighbourhoods and rankings over edges (from, to) and nodes (id, server, type)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.storage import cut, maybe_broadcast, shuffled, small

MAX_HOPS = 6
#: Edges of a node that one task joins; more are dealt over several.
HEAVY = 10_000
#: Edges of a node from which its neighbours, as seeds, are numbered one after the other.
HUB = 500
#: Hubs, the largest ones, whose neighbourhoods are told by blocks: a bit of a long each.
HUBS = 62
#: Nodes of a block, and pairs of nodes that one task tells.
BLOCK_BITS, PAIRS = 9, 1 << 26


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("from").alias("id")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("to").alias("id")).agg(F.count("*").alias("n_in"))
    return out.join(into, "id", "full").select("id", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def _dealt(moves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(moves with a ``part``, heavy nodes with their number of parts, edges by node): edges of a node with more than ``HEAVY`` are dealt over parts."""
    counts = cut(moves.groupBy("from").agg(F.count("*").alias("n")), "counts")
    heavy = counts.filter(F.col("n") > HEAVY).select("from", F.ceil(F.col("n") / HEAVY).cast("int").alias("parts"))
    parted = moves.join(maybe_broadcast(heavy), "from", "left")
    part = F.coalesce(F.pmod(F.xxhash64("to"), F.col("parts")), F.lit(0)).cast("int")
    return cut(parted.select("from", part.alias("part"), "to"), "moves"), heavy, counts


def _by_hub(seeds: DataFrame, moves: DataFrame, counts: DataFrame) -> DataFrame:
    """``seeds`` with ``hub``, the neighbour that leads to most, if to more than ``HUB``: seeds of one hub walk together, and then share rows."""
    hubs = counts.filter(F.col("n") > HUB).withColumnRenamed("from", "to")
    if hubs.isEmpty():
        return seeds.withColumn("hub", F.lit(None).cast("string"))
    near = moves.join(maybe_broadcast(hubs), "to").groupBy(F.col("from").alias("id")).agg(F.max_by("to", F.struct("n", "to")).alias("hub"))
    return seeds.join(near, "id", "left")


def _walk(dealt: tuple[DataFrame, DataFrame, DataFrame], seeds: DataFrame, hops: int, servers: DataFrame | None = None, *, told: bool = True) -> DataFrame:
    """(seed, id, hop) by breadth over moves as ``_dealt``, from ``seeds`` (id, home); without ``told``, (seed, id).

    64 seeds of one home share a row of a node: a bit each. A hop joins the frontier with the edges, merges the bits that
    meet in a node within each task before the shuffle, and keeps those that weren't seen. The edges of a node with many
    are dealt over parts, which all get its frontier rows. With ``servers`` (id, server), rows go on from nodes of their
    home only, and none from a node without edges. Each hop but the last is written to shared storage. Where hops aren't
    told, the last one meets the others by blocks of seeds, so that its rows are sent once.
    """
    same = ["id", "block", "home"]
    moves, heavy, counts = dealt
    if servers is not None:
        servers = cut(servers.join(counts.select(F.col("from").alias("id")), "id", "left_semi"), "going")
    home = F.coalesce(F.concat(F.lit("="), F.col("home").cast("string")), F.lit(""))  # null is a home of its own, where nothing goes on
    order = ["home", "hub", "id"]
    numbered = _by_hub(seeds.select("id", home.alias("home")).distinct(), moves, counts).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id())
    numbered = cut(numbered.select("id", "home", F.shiftright("n", 6).alias("block"), F.col("n").bitwiseAND(63).cast("int").alias("bit")), "seeds")
    names = cut(numbered.groupBy("block", "home").agg(F.collect_list(F.struct("bit", "id")).alias("ids")), "names")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    front = cut(numbered.select(*same, F.call_function("shiftleft", one, F.col("bit")).alias("bits"), none.alias("hop"), F.lit(True).alias("grows")), "front")
    fronts = front
    for hop in range(1, hops + 1):
        wide = front.filter("grows").join(maybe_broadcast(heavy), F.col("id") == F.col("from"), "left").drop("from")
        wide = wide.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        step = wide.join(moves.withColumnRenamed("part", "p"), (F.col("id") == F.col("from")) & (F.col("part") == F.col("p"))).select(F.col("to").alias("id"), "block", "home", "bits")
        if hop == hops and not told:
            every = step.unionByName(fronts.select(*same, "bits")).repartition("block", "home")
            fronts = every.groupBy(*same).agg(F.bit_or("bits").alias("bits"))
            break
        both = step.withColumn("seen", none).unionByName(fronts.select(*same, none.alias("bits"), F.col("bits").alias("seen")))
        both = both.groupBy(*same).agg(F.bit_or("bits").alias("bits"), F.bit_or("seen").alias("seen"))
        new = both.withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not("seen"))).filter("bits <> 0")
        if servers is None or hop == hops:
            new = new.withColumn("grows", F.lit(True))
        else:
            new = new.join(servers, "id", "left").withColumn("grows", F.coalesce(F.concat(F.lit("="), F.col("server").cast("string")) == F.col("home"), F.lit(False)))
        new = new.select(*same, "bits", F.lit(hop).cast("long").alias("hop"), "grows")
        front = new if hop == hops else cut(new, "front")
        fronts = fronts.unionByName(front)
        if hop < hops and front.filter("grows").isEmpty():
            break
    held = fronts.join(maybe_broadcast(names), ["block", "home"]).withColumn("e", F.explode("ids"))
    held = held.filter(F.call_function("shiftright", F.col("bits"), F.col("e.bit")).bitwiseAND(1) == 1)
    return held.select(F.col("e.id").alias("seed"), "id", *(["hop"] if told else []))


def reachable(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, *, incoming: bool = False, hops: int = MAX_HOPS) -> DataFrame:
    """(seed, id, hop): least hops up to ``hops``, without the seed. Objects of another server are met but not passed."""
    moves = edges.select(F.col("to").alias("from"), F.col("from").alias("to")) if incoming else edges.select("from", "to")
    servers = cut(nodes.select("id", "server"), "servers")
    known = seeds.select("id").join(servers.withColumnRenamed("server", "home"), "id")
    return _walk(_dealt(moves), known, hops, servers).filter("hop > 0")


def _shared(a: Column, b: Column, radius: int) -> Column:
    """Bits of the hubs by which two nodes lie within ``radius``, of their hubs within 0, 1, .. ``radius`` hops."""
    return reduce(lambda x, y: x.bitwiseOR(y), [F.get(a, F.lit(d)).bitwiseAND(F.get(b, F.lit(radius - d))) for d in range(radius + 1)])


def _blocks(nodes: DataFrame) -> DataFrame:
    """(near, block, ids): nodes (id, near) gathered by equal ``near``, up to 2 ** ``BLOCK_BITS`` in a row, and a row a hub ``k``."""
    order = ["near", "id"]
    numbered = nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
    held = cut(numbered.groupBy("near", "block").agg(F.collect_list("id").alias("ids")), "blocks")
    every = F.element_at("near", -1)
    return held.withColumn("k", F.explode(F.filter(F.sequence(F.lit(0), F.lit(HUBS - 1)), lambda k: F.call_function("shiftright", every, k).bitwiseAND(1) == 1)))


def _told(near: DataFrame, roots: DataFrame, radius: int) -> DataFrame:
    """(seed, id) of nodes (id, near) that a hub brings within ``radius``, each pair by the first such hub.

    Seeds and ids with the same hubs share a row of a block, and blocks meet in their hub. Pairs are made last, in the task that
    returns them: none is shuffled or written before. Tasks have ``PAIRS`` pairs on average: blocks of ids are dealt over them, and those
    of the seeds are sent to all parts of a hub or, where small, to all tasks.
    """
    ids = _blocks(near)
    seeds = _blocks(near.join(shuffled(roots), "id", "left_semi"))
    weigh = lambda df, n: df.groupBy("k").agg(F.sum(F.size("ids")).alias(n))
    parts = cut(weigh(seeds, "s").join(weigh(ids, "i"), "k").select("k", F.ceil(F.col("s") * F.col("i") / PAIRS).cast("int").alias("parts")), "parts")
    tasks = parts.agg(F.coalesce(F.sum("parts"), F.lit(1))).first()[0]
    seeds = seeds.select("k", F.col("near").alias("mine"), F.col("ids").alias("seeds"))
    if small(seeds):
        met = ids.repartition(tasks).join(F.broadcast(seeds), "k")
    else:
        parts = F.broadcast(parts)
        ids = ids.join(parts, "k").withColumn("part", F.pmod(F.xxhash64("near", "block"), "parts").cast("int")).drop("parts")
        seeds = seeds.join(parts, "k").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        met = ids.repartition(tasks, "k", "part").join(shuffled(seeds.repartition(tasks, "k", "part")), ["k", "part"])
    bit, by = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k")), _shared(F.col("mine"), F.col("near"), radius)
    first = met.withColumn("by", by).filter((F.col("by").bitwiseAND(bit) != 0) & (F.col("by").bitwiseAND(bit - 1) == 0))
    # A stage of generated code buffers all rows that a row is made into; as none reaches over a coalesce, that is a block's at most.
    each = first.select("seeds", "ids").coalesce(tasks).select("seeds", F.explode("ids").alias("id")).coalesce(tasks)
    return each.select(F.explode("seeds").alias("seed"), "id")


def neighborhood(edges: DataFrame, roots: DataFrame, radius: int) -> DataFrame:
    """(seed, id) within ``radius`` undirected hops, the root included; ids without a node stay.

    Pairs that a large hub brings together are as many as the square of its edges. They are told by blocks of nodes with the same hubs, see
    ``_told``; walks don't go on from these hubs then, and what they find beside is added.
    """
    both = edges.select("from", "to").unionByName(edges.select(F.col("to").alias("from"), F.col("from").alias("to")))
    if radius == 1:  # the edges themselves
        near = both.join(shuffled(roots.select(F.col("id").alias("from"))), "from", "left_semi").select(F.col("from").alias("seed"), F.col("to").alias("id"))
        return near.unionByName(roots.select(F.col("id").alias("seed"), "id")).distinct()
    roots = roots.select("id", F.lit("").alias("home")).distinct()
    dealt = _dealt(both.distinct())
    counts = dealt[2]
    most = counts.filter(F.col("n") > HUB).orderBy(F.desc("n"), "from").limit(HUBS).agg(F.sort_array(F.collect_list("from")).alias("names"))
    hubs = cut(most.select(F.posexplode("names").alias("k", "from")), "hubs")
    if not radius or hubs.isEmpty():
        return _walk(dealt, roots, radius, told=False)
    hubs = F.broadcast(hubs)
    reach = radius if not roots.join(hubs, F.col("id") == F.col("from"), "left_semi").isEmpty() else radius - 1
    far = _walk(dealt, hubs.select(F.col("from").alias("id"), F.lit("").alias("home")), reach).join(hubs, F.col("seed") == F.col("from"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k"))
    within = [F.coalesce(F.bit_or(F.when(F.col("hop") <= d, bit)), F.lit(0).cast("long")) for d in range(radius + 1)]
    near = cut(far.groupBy("id").agg(F.array(*within).alias("near")), "near")
    beside = _walk(tuple(df.join(hubs, "from", "left_anti") for df in dealt), roots, radius, told=False)
    beside = beside.join(shuffled(near.select(F.col("id").alias("seed"), F.col("near").alias("mine"))), "seed", "left").join(shuffled(near), "id", "left")
    beside = beside.filter(F.coalesce(_shared(F.col("mine"), F.col("near"), radius), F.lit(0)) == 0).select("seed", "id")
    return _told(near, roots.select("id"), radius).unionByName(beside)


def top_referenced(edges: DataFrame, nodes: DataFrame, kind: str = "Tables", keep: int = 10) -> DataFrame:
    """Most used objects of a type: direct users, then users over all hops.

    Only objects with as many direct users as the last place, ties included, are walked from: no other can get a place.
    """
    direct = edges.groupBy(F.col("to").alias("id")).agg(F.count("*").alias("direct"))
    every = cut(nodes.filter(F.col("type") == kind).select("id").join(direct, "id"), "direct")
    least = every.orderBy(F.desc("direct")).limit(keep).agg(F.min("direct")).first()[0]
    some = every.filter(F.col("direct") >= F.lit(least or 0))
    far = reachable(edges, nodes, some.select("id"), incoming=True).groupBy(F.col("seed").alias("id")).agg(F.count("*").alias("indirect"))
    return some.join(far, "id", "left").select("id", "direct", F.coalesce("indirect", F.lit(0)).alias("indirect")).orderBy(F.desc("direct"), F.desc("indirect"), "id").limit(keep)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids``."""
    a, b = ids.select(F.col("id").alias("from")).distinct(), ids.select(F.col("id").alias("to")).distinct()
    return edges.join(a, "from", "left_semi").join(b, "to", "left_semi")


def depends_on(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("to"), "name", "type"), "to").select(F.col("from").alias("id"), F.col("to").alias("other"), "name", "type")


def used_by(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("from"), "name", "type"), "from").select(F.col("to").alias("id"), F.col("from").alias("other"), "name", "type")
