"""Prefix trie of conversations by MSD radix partitioning over turn ids, finished locally by multikey quicksort.

Turns are numbered by a dictionary, and a conversation becomes the sequence of its turns' numbers. Equal sequences are
one row. A round takes every group of sequences that is still too large for one task, jumps to the end of its members'
common prefix, and parts it by the next turn: parts of at most ``LOCAL`` sequences are local buckets, larger ones go into
the next round. A bucket's task sorts it by multikey quicksort, whose recursion is the walk over its nodes. The few nodes
above the buckets get their sums from below, round by round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import cut
from provenir.llm.neardup import SALT_MEMBERS, spread_join

#: Distinct sequences that one task sorts; a group of more is parted by its next turn.
LOCAL = 256
#: Nodes that are sent on at once.
SEND = 20_000
NONE = hashlib.sha256(b"").hexdigest()
_SEQUENCES = "ids array<long>, sizes array<long>, n_convs long, conv_id long, ends_sha256 string"
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean"


def _lookup(rows: DataFrame, known: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Inner join with ``known`` (keys once each, value, copies): keys of many rows through :func:`spread_join`."""
    value = next(c for c in known.columns if c not in keys and c != "copies")
    often = known.filter(F.col("copies") >= SALT_MEMBERS).drop("copies")
    plain = known.filter(F.col("copies") < SALT_MEMBERS).drop("copies")
    if often.isEmpty():
        return rows.join(plain, keys)
    marked = spread_join(rows, often, keys, by)
    return marked.filter(F.col(value).isNotNull()).unionByName(marked.filter(F.col(value).isNull()).drop(value).join(plain, keys).select(marked.columns))


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, ids, sizes``: each conversation's turns in order, as numbers of a dictionary of (role, text), and the texts' UTF-8 bytes.

    Turns go by ``turn``, null first, and by the hash of role and text where several have one number; a null role or text
    is an empty one. Rows without a conv_id belong to no conversation and are left out. A conversation is one row, of 16
    bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"), F.octet_length(text).cast("long").alias("size"))
    turns = cut(turns, "turns")
    dictionary = cut(turns.groupBy("h1", "h2").agg(F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()), "dictionary")
    coded = _lookup(turns, dictionary.select("h1", "h2", "id", "copies"), ["h1", "h2"], "conv_id")
    lists = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "h1", "id", "size"))).alias("t"))
    return lists.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def shared_heads(convs: DataFrame, *, every: int = 5, most: int = 8) -> DataFrame:
    """Conversations that begin alike, from :func:`sequences`: conversation c gets the first h turns of c - c % every, then its own after its first h.

    h is crc32 of the decimal c modulo ``most + 1``; there are fewer turns where the other conversation has fewer or is absent.
    """
    c = F.col("conv_id")
    first = convs.filter(c % every == 0).select(c.alias("base"), F.slice("ids", 1, most).alias("base_ids"), F.slice("sizes", 1, most).alias("base_sizes"))
    own = convs.withColumn("base", c - c % every).withColumn("h", (F.crc32(c.cast("string").cast("binary")) % (most + 1)).cast("int"))

    def mixed(head: str, tail: str) -> Column:
        return F.concat(F.slice(F.coalesce(F.col(head), F.array().cast("array<long>")), 1, F.col("h")), F.slice(tail, F.col("h") + 1, F.greatest(F.size(tail), F.lit(1))))

    return own.join(first, "base", "left").select("conv_id", mixed("base_ids", "ids").alias("ids"), mixed("base_sizes", "sizes").alias("sizes"))


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), at


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["ids", "sizes", "n_convs", "conv_id", "ends"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ordered by conv_id: equal sequences of a batch as one row, with their ids in a text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        (ids, at), (sizes, _) = _lists(batch, "ids"), _lists(batch, "sizes")
        found: dict[bytes, tuple[int, list[int]]] = {}
        for i, conv in enumerate(batch.column(batch.schema.get_field_index("conv_id")).to_pylist()):
            found.setdefault(ids[at[i] : at[i + 1]].tobytes(), (i, []))[1].append(conv)
        yield _rows([(ids[at[i] : at[i + 1]], sizes[at[i] : at[i + 1]], len(convs), convs[0], ",".join(map(str, convs))) for i, convs in found.values()])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of :func:`_combine` ordered by sequence and first id: each sequence once, with the digest of all its ids, read as a stream."""
    key, now = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        (ids, at), (sizes, _) = _lists(batch, "ids"), _lists(batch, "sizes")
        done = []
        for i, (n, conv, ends) in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n_convs", "conv_id", "ends")))):
            mine = ids[at[i] : at[i + 1]].tobytes()
            if mine == key:
                now[2] += n
                now[4].update(b"," + ends.encode())
                continue
            if now is not None:
                done.append((*now[:4], now[4].hexdigest()))
            key, now = mine, [ids[at[i] : at[i + 1]].copy(), sizes[at[i] : at[i + 1]].copy(), n, conv, hashlib.sha256(ends.encode())]
        if done:
            yield _rows(done).rename_columns(["ids", "sizes", "n_convs", "conv_id", "ends_sha256"])
    if now is not None:
        yield _rows([(*now[:4], now[4].hexdigest())]).rename_columns(["ids", "sizes", "n_convs", "conv_id", "ends_sha256"])


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """Each sequence once: ``ids, sizes, n_convs, conv_id`` (the least), ``ends_sha256`` (of all its conv_ids, ascending)."""
    ordered = convs.repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    parts = ordered.mapInArrow(_combine, "ids array<long>, sizes array<long>, n_convs long, conv_id long, ends string")
    return parts.repartition("ids").sortWithinPartitions("ids", "conv_id").mapInArrow(_ends, _SEQUENCES)


def grow(rows: list[tuple], depth: int, parent: int) -> list[list]:
    """The nodes of one bucket: ``rows`` (ids, sizes, n_convs, conv_id, ends) are different and share their first ``depth`` turns.

    Multikey quicksort: rows are parted by one turn into those below, at and above a pivot's; those at it are a child,
    sorted by the turn after. A row that ends comes before all turns. Nodes are lists in the order of ``_NODES`` with the
    place of the parent in front; parents come first.
    """
    nodes: list[list] = []

    def node(some: list[int], depth: int, up: int) -> int:
        n, size = sum(rows[i][2] for i in some), rows[some[0]][1][depth - 1]
        nodes.append([up, min(rows[i][3] for i in some), depth, nodes[up][1] if nodes else parent, n, 0, 0, (n - 1) * size, NONE, not nodes])
        if len(nodes) > 1:
            nodes[up][5] += 1
        return len(nodes) - 1

    every = list(range(len(rows)))
    open_ = [(every, depth, node(every, depth, 0))]
    while open_:
        some, d, at = open_.pop()
        if len(some) == 1:  # one row: a chain to its end
            for d in range(d + 1, len(rows[some[0]][0]) + 1):
                at = node(some, d, at)
            nodes[at][8] = rows[some[0]][4]
            continue
        turn = [rows[i][0][d] if d < len(rows[i][0]) else -1 for i in some]
        pivot = turn[len(turn) // 2]
        for side in ([i for i, t in zip(some, turn) if t < pivot], [i for i, t in zip(some, turn) if t > pivot]):
            if side:
                open_.append((side, d, at))
        same = [i for i, t in zip(some, turn) if t == pivot]
        if pivot < 0:
            nodes[at][8] = rows[same[0]][4]
        else:
            open_.append((same, d + 1, node(same, d + 1, at)))
    for i in range(len(nodes) - 1, -1, -1):
        nodes[i][6] = nodes[i][6] or 1
        if i:
            nodes[nodes[i][0]][6] += nodes[i][6]
            nodes[nodes[i][0]][7] += nodes[i][7]
    return nodes


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ordered by bucket (node, depth, turn): the buckets' nodes."""
    names = [x.split()[0] for x in _NODES.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in _NODES.split(", ")]

    def send(nodes: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*nodes))[1:], kinds)], names=names)

    bucket, rows, out = None, [], []
    for batch in batches:
        table = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("node", "depth", "turn", "ids", "sizes", "n_convs", "conv_id", "ends_sha256")]
        for node, depth, turn, *row in zip(*table):
            if (node, depth, turn) != bucket:
                if rows:
                    out += grow(rows, bucket[1], bucket[0])
                bucket, rows = (node, depth, turn), []
                if len(out) >= SEND:
                    yield send(out)
                    out = []
            rows.append(row)
    if rows:
        out += grow(rows, bucket[1], bucket[0])
    if out:
        yield send(out)


def _common(low: str, high: str) -> Column:
    """Length of the common prefix of two arrays."""
    apart = F.array_position(F.zip_with(low, high, lambda x, y: x == y), False)
    return F.when(apart > 0, apart - 1).otherwise(F.least(F.size(low), F.size(high))).cast("long")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``convs`` holds ``conv_id, ids, sizes`` with each conv_id once, as from :func:`sequences`. A node is a distinct
    sequence of first turns, from the root of none; its members begin with it and ``conv_id`` is the least of them.
    ``n_leaves`` counts childless nodes in its subtree, itself included; ``saved_tokens`` adds up (n_convs - 1) times the
    last turn's bytes over the subtree; ``ends_sha256`` is over the conv_ids that end here, ascending, comma-joined. A
    conversation without turns ends at the root; without conversations there is no node.
    """
    every = cut(distinct_sequences(convs.select("conv_id", "ids", "sizes")), "sequences")
    root = every.agg(F.min("conv_id")).first()[0]
    spark = every.sparkSession
    if root is None:
        return spark.createDataFrame([], _NODES).drop("top")
    open_ = every.select(F.lit(root).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "*")
    chains, local = [], []
    while True:
        groups = open_.groupBy("node", "depth", "parent").agg(F.sum("n_convs").alias("n_convs"), F.min(F.struct("ids", "sizes")).alias("low"), F.max("ids").alias("high"))
        chain = cut(groups.select("node", "depth", "parent", "n_convs", F.col("low.sizes").alias("sizes"), _common("low.ids", "high").alias("end")), "chain")
        rows = spread_join(open_.drop("depth", "parent"), chain.select("node", "end"), ["node"], "conv_id")
        parted = cut(rows.withColumn("turn", F.get("ids", F.col("end").cast("int"))), "parted")
        ended = parted.filter("turn is null").select("node", "ends_sha256")
        parted = parted.filter("turn is not null").withColumn("depth", F.col("end") + 1).drop("end")
        counts = cut(parted.groupBy("node", "turn").agg(F.count("*").alias("rows"), F.min("conv_id").alias("child")), "counts")
        children = counts.groupBy("node").agg(F.count("*").alias("n_children"))
        chains.append(cut(chain.join(children, "node", "left").join(ended, "node", "left"), "chain"))
        large = counts.filter(F.col("rows") > LOCAL).select("node", "turn", "child")
        if large.isEmpty():
            local.append(parted)
            break
        parted = cut(spread_join(parted, large, ["node", "turn"], "conv_id"), "dealt")
        local.append(parted.filter("child is null").drop("child"))
        open_ = parted.filter("child is not null").select(F.col("child").alias("node"), "depth", F.col("node").alias("parent"), *every.columns)
    buckets = local[0]
    for more in local[1:]:
        buckets = buckets.unionByName(more)
    buckets = buckets.repartition("node", "depth", "turn").sortWithinPartitions("node", "depth", "turn")
    grown = cut(buckets.mapInArrow(_grown, _NODES), "nodes")
    below = grown.filter("top").groupBy(F.col("parent_conv_id").alias("node"), (F.col("depth") - 1).alias("end")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
    below = cut(below, "below")
    out, above = grown.drop("top"), None
    for chain in reversed(chains):
        sums = below if above is None else below.unionByName(above).groupBy("node", "end").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        known = chain.join(sums, ["node", "end"], "left").select(chain["*"], F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
        steps = known.withColumn("at", F.explode(F.sequence("depth", "end")))
        tail = F.slice("sizes", F.greatest(F.col("at"), F.lit(1)).cast("int"), (F.col("end") - F.greatest(F.col("at"), F.lit(1)) + 1).cast("int"))
        saved = F.col("saved") + (F.col("n_convs") - 1) * F.aggregate(tail, F.lit(0).cast("long"), lambda a, x: a + x)
        last = F.col("at") == F.col("end")
        steps = steps.select(
            F.col("node").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("parent")).otherwise(F.col("node")).alias("parent_conv_id"), "n_convs",
            F.when(last, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
            F.when(last, F.coalesce("ends_sha256", F.lit(NONE))).otherwise(NONE).alias("ends_sha256"),
            (F.col("at") == F.col("depth")).alias("top"), F.col("depth").alias("first"),
        )
        steps = cut(steps, "steps")
        above = steps.filter("top and parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("node"), (F.col("depth") - 1).alias("end")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        out = out.unionByName(steps.drop("top", "first"))
    return out


def oracle() -> str:
    """SQL of op12 on ``conversations``: every prefix grouped by itself."""
    return """
WITH tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)
), ids AS (
  SELECT conv_id AS c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), tab
), own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
  SELECT own.c, list_concat(coalesce(list_slice(base.turns, 1, h), []), coalesce(list_slice(own.turns, h + 1, len(own.turns)), [])) AS s
  FROM own JOIN ids USING (c) LEFT JOIN own AS base ON base.c = own.c - own.c % 5
), nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = d), '') AS ends
  FROM (SELECT c, s, d, coalesce(list_slice(s, 1, d), []) AS p FROM rebuilt, range(0, 1000) AS r(d) WHERE d <= len(s)) GROUP BY p, d
), child AS (
  SELECT coalesce(list_slice(p, 1, d - 1), []) AS q, d - 1 AS e, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), own_sums AS (
  SELECT n.p, n.d, n.conv_id, n.n, n.ends, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n.n - 1) * strlen(n.p[n.d].t) END AS saved
  FROM nodes n LEFT JOIN child ON q = n.p AND e = n.d
), subtree AS (
  SELECT coalesce(list_slice(p, 1, k), []) AS q, k AS e, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM own_sums, range(0, 1000) AS r(k) WHERE k <= d GROUP BY ALL
)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM own_sums n JOIN subtree ON q = n.p AND e = n.d LEFT JOIN nodes up ON n.d > 0 AND up.d = n.d - 1 AND up.p = coalesce(list_slice(n.p, 1, n.d - 1), [])
"""
