"""SimHash near-duplicates by multi-index hashing of the fingerprints' halves.

Two fingerprints of 64 bits that differ in at most 3 have a half in which they differ in at most 1. So each half is an
index: a fingerprint stands in the table under its half, and looks into the table under every half one bit away. All rows
of one key meet in a task, which checks whole distances. Keys with many rows are indexed once more, by the halves of the
other half, by the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import SPACE, U64, chunks, cut, long, text_buffer
from provenir.llm.components import components
from provenir.llm.neardup import SALT_MEMBERS, spread_join
from provenir.llm.xxh64 import xxh64

#: Bytes of one text handled at once.
SEGMENT = 1 << 20
SEED = 42
#: Rows of one key that a task takes; keys with more are indexed once more. Keys with fewer than DENSE table rows can't
#: bring more than 32 * DENSE rows to a neighbour, and aren't counted there.
HOT = 4096
DENSE = 32
#: Pairs compared at once, and pairs of one key beyond which balls are enumerated inside the key instead.
BLOCK = 1 << 20
PAIRS = 1 << 25
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# -- fingerprints ----------------------------------------------------------------------------------------------------


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, where each row's begin): words lower-cased and joined by one space; a shorter row is one shingle."""
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
    before[1:] = ~inside[:-1] | edge[1 : len(raw)]
    after[:-1] = ~inside[1:] | edge[1 : len(raw)]
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    keep = inside.copy()
    heads = np.zeros(len(starts), bool)
    heads[first[:-1][count > 0]] = True
    keep[starts[~heads] - 1] = True  # one blank before each word but a row's first
    low = _LOWER[raw[keep]]
    low[SPACE[low]] = 0x20
    sizes = ends - starts
    begin = np.cumsum(sizes) - sizes + np.cumsum(~heads)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]
    last = np.minimum(at + width, first[owner + 1]) - 1
    return xxh64(low, begin[at], begin[last] + sizes[last] - begin[at], SEED), np.concatenate([[0], np.cumsum(n)])


def bit_counts(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each row, in how many of its hashes each bit is set: (rows, 64)."""
    out = np.zeros((len(ends) - 1, 64), np.int64)
    if not len(hashes):
        return out
    cuts = np.unique(np.concatenate([np.arange(0, len(hashes), 255), ends[:-1][np.diff(ends) > 0]]))
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    parts = np.add.reduceat(bits, cuts, axis=0, dtype=np.uint8).astype(np.int64)  # 255 at most each
    np.add.at(out, np.searchsorted(ends, cuts, side="right") - 1, parts)
    return out


def _pieces(raw: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """A long text in stretches of about SEGMENT bytes that share ``width - 1`` words, so that each shingle is in one."""
    at = reach = 0
    while True:
        reach = min(reach + SEGMENT, len(raw))
        while reach < len(raw) and not SPACE[raw[reach]]:
            blank = np.flatnonzero(SPACE[raw[reach : reach + SEGMENT]])
            reach = min(reach + (int(blank[0]) if len(blank) else SEGMENT), len(raw))
        part = raw[at:reach]
        if reach == len(raw):
            yield part
            return
        inside = ~SPACE[part]
        starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
        if len(starts) >= width:  # else this stretch goes on
            yield part
            at += int(starts[len(starts) - width + 1]) if width > 1 else len(part)


def fingerprints(column: pa.Array, width: int = 3) -> np.ndarray:
    """The SimHash of every text: a bit is 1 if set in over half of the shingles' hashes, repeats counted; no words: 0."""
    raw, offsets = text_buffer(column)
    if len(column) == 1 and len(raw) > SEGMENT:
        counts, n = np.zeros((1, 64), np.int64), np.zeros(1, np.int64)
        for part in _pieces(raw, width):
            hashes, ends = shingle_hashes(part, np.array([0, len(part)]), width)
            if len(hashes) == 1 and n[0]:  # the rest of fewer words than a shingle has
                if np.count_nonzero(np.diff(SPACE[np.concatenate([[0x20], part])].astype(np.int8)) < 0) < width:
                    continue
            counts += bit_counts(hashes, ends)
            n += len(hashes)
    else:
        hashes, ends = shingle_hashes(raw, offsets, width)
        counts, n = bit_counts(hashes, ends), np.diff(ends)
    bits = 2 * counts > n[:, None]
    return (bits.astype(U64) << np.arange(64, dtype=U64)).sum(axis=1, dtype=U64)


def _kernel(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(long(fingerprints(batch.column(1), width)))], names=["doc_id", "fp"])

    return run


# -- links -----------------------------------------------------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components as (a, b), one for each node but a component's least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        now = label.copy()
        np.minimum.at(now, label[x], least)
        np.minimum.at(now, label[y], least)
        now = now[now]
        if (now == label).all():
            break
        label = now
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _by_pairs(fp: np.ndarray, node: np.ndarray, table: np.ndarray, group: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of rows ordered by group, table rows first in each: every table row against the later rows of its group."""
    ends = np.searchsorted(group, group, side="right")
    rows = np.flatnonzero(table)
    count = ends[rows] - rows - 1
    step = np.cumsum(count) // BLOCK
    for some in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(step)) + 1):
        for lo in range(0, max(int(count[some].max(initial=0)), 1), BLOCK):
            size = np.minimum(np.maximum(count[some] - lo, 0), BLOCK)
            left = np.repeat(rows[some], size)
            right = np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size) + left + 1 + lo
            near = np.bitwise_count(fp[left] ^ fp[right]) <= distance
            yield node[left[near]], node[right[near]]


def _by_balls(fp: np.ndarray, node: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links with the components of all pairs of one group: ever larger balls, enumerated around all but the largest component.

    A link between two components has an end outside the largest one, so nothing is missed.
    """
    fp, first = np.unique(fp, return_index=True)
    node = node[first]
    bits = np.flatnonzero((np.bitwise_or.reduce(fp ^ fp[0]) >> np.arange(64, dtype=U64)) & U64(1)).astype(U64)
    x, y = np.zeros(0, np.int64), np.zeros(0, np.int64)
    label = np.arange(len(fp))
    for size in range(1, distance + 1):
        open_ = np.flatnonzero(label != np.bincount(label).argmax())
        if size == 1 or len(open_):
            probe = np.arange(len(fp)) if size == 1 else open_
            for some in combinations(bits, size):
                want = fp[probe] ^ np.bitwise_or.reduce(U64(1) << np.array(some, U64))
                at = np.minimum(np.searchsorted(fp, want), len(fp) - 1)
                hit = fp[at] == want
                x, y = np.append(x, probe[hit]), np.append(y, at[hit])
                if len(x) > BLOCK:
                    x, y = forest(x, y)
            x, y = forest(x, y)
            label = np.arange(len(fp))
            label[x] = y
    yield node[x], node[y]


def _links(distance: int):
    """From rows (slot, key, table, fp, node) ordered by the first two and table rows first: links (a, b) between nodes."""

    def emit(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        new, table, fp, node = rows
        group = np.cumsum(new)
        n, t = np.bincount(group), np.bincount(group, weights=table).astype(np.int64)
        large = n * t > PAIRS
        found = []
        for g in np.flatnonzero(large):
            found += _by_balls(fp[group == g], node[group == g], distance)
        some = ~large[group] & (n[group] > 1) & (t[group] > 0)
        for a, b in [*found, *_by_pairs(fp[some], node[some], table[some], group[some], distance)] if some.any() else found:
            a, b = forest(a[a != b], b[a != b])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            slot, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            new = np.ones(len(key), bool)
            new[1:] = (slot[1:] != slot[:-1]) | (key[1:] != key[:-1])
            new[0] = (slot[0], key[0]) != last
            last = slot[-1], key[-1]
            mine = new, batch.column(2).to_numpy(zero_copy_only=False).astype(bool), batch.column(3).to_numpy().view(U64), batch.column(4).to_numpy()
            held = mine if held is None else tuple(np.concatenate(x) for x in zip(held, mine))
            cut_at = int(np.flatnonzero(held[0])[-1])  # the last group may go on
            if cut_at:
                yield from emit(tuple(x[:cut_at] for x in held))
                held = tuple(x[cut_at:] for x in held)
        if held is not None:
            yield from emit(held)

    return run


def _indexed(rows: DataFrame, slot: Column, base: Column, part: Column, width: int) -> DataFrame:
    """Rows under their own key (table) and, from even halves, under the keys one bit away: of two keys one bit apart one is even."""
    flips = F.sequence(F.lit(-1), F.when(F.bit_count(part) % 2 == 0, width - 1).otherwise(-1))
    spread = rows.withColumn("slot", slot).withColumn("flip", F.explode(flips))
    own = F.when(F.col("flip") < 0, part).otherwise(part.bitwiseXOR(F.expr("shiftleft(1L, greatest(flip, 0))")))
    return spread.select("slot", F.shiftleft(base, width).bitwiseOR(own).alias("key"), (F.col("flip") < 0).alias("table"), "fp", "node")


def _half(i: int) -> Column:
    return F.shiftrightunsigned("fp", 32 * i).bitwiseAND(F.lit((1 << 32) - 1))


def near_fingerprints(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) between nodes of ``prints`` (fp, node; each fp once): their components are those of all pairs within ``distance`` bits, 3 at most."""
    if not 0 <= distance <= 3:
        raise ValueError("halves that differ in one bit at most are looked up, which is enough for distances 0 to 3")
    prints = prints.select("fp", "node")
    # Counts of table rows by key; a neighbour's rows come too where its half is even.
    counts = None
    for i in (0, 1):
        one = prints.groupBy(F.lit(i).alias("slot"), _half(i).alias("key")).count()
        counts = one if counts is None else counts.unionByName(one)
    dense = cut(counts.filter(F.col("count") >= min(DENSE, HOT)), "dense")
    rows = [_indexed(prints, F.lit(i), F.lit(0).cast("long"), _half(i), 32) for i in (0, 1)]
    rows = rows[0].unionByName(rows[1])
    if not dense.isEmpty():
        near = dense.filter(F.bit_count("key") % 2 == 0).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(31)))).select("slot", F.col("key").bitwiseXOR(F.expr("shiftleft(1L, i)")).alias("key"), "count")
        hot = dense.unionByName(near).groupBy("slot", "key").agg(F.sum("count").alias("count")).filter(F.col("count") > HOT).select("slot", "key", F.lit(True).alias("hot"))
        hot = cut(hot, "hot")
        if not hot.isEmpty():
            marked = cut(spread_join(rows, hot, ["slot", "key"], "fp"), "marked")
            rows = marked.filter("hot is null").drop("hot")
            deep = marked.filter("hot").select(F.col("slot").alias("side"), F.col("key").alias("top"), "fp", "node")
            for j in (0, 1):
                other = F.when(F.col("side") == 0, _half(1)).otherwise(_half(0))
                part = F.shiftrightunsigned(other, 16 * j).bitwiseAND(F.lit(0xFFFF))
                rows = rows.unionByName(_indexed(deep, F.col("side") * 2 + 2 + j, F.col("top"), part, 16))
    rows = rows.repartition("slot", "key").sortWithinPartitions("slot", "key", F.col("table").desc())
    return rows.mapInArrow(_links(distance), "a long, b long")


def simhash_duplicates(docs: DataFrame, *, width: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    The fingerprint is taken over ``width``-word shingles, repeats included (A-Z lower-cased; words are runs of anything
    but ASCII white space; a text with fewer words is one shingle), hashed by XXH64 with seed 42, as 16 hex digits. A null
    or blank text has fingerprint zero, which is linked like any other. Documents are linked if their fingerprints differ
    in at most ``distance`` bits; ``component_id`` is the smallest doc_id reachable. A null doc_id is a component of its
    own (null) and links nothing; rows that repeat a doc_id are one node, whatever their texts, and each gets its row
    back. Further columns are ignored; an empty table gives an empty result. Texts of any length are read in stretches.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = cut(source.mapInArrow(_kernel(width), "doc_id long, fp long"), "fingerprints")
    named = base.filter("doc_id is not null")
    prints = cut(named.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "prints")
    links = cut(near_fingerprints(prints, distance), "links")
    # A doc_id whose rows have different texts joins their nodes.
    again = cut(named.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x <> y").select("doc_id"), "again")
    if not again.isEmpty():
        both = cut(named.join(again, "doc_id", "left_semi").distinct().join(prints, "fp").select("doc_id", "node"), "both")
        links = links.unionByName(both.join(both.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b"))
    comp = components(links)
    known = prints.join(comp, prints["node"] == comp["id"], "left").select("fp", "copies", F.coalesce("root", "node").alias("component_id"))
    known = cut(known, "known")
    # A fingerprint of many documents is looked up by broadcast or salted rows, others by a plain join.
    often = known.filter(F.col("copies") >= SALT_MEMBERS).select("fp", F.col("component_id").alias("often_id"))
    rows = named
    if not often.isEmpty():
        marked = spread_join(named, often, ["fp"], "doc_id")
        done = marked.filter("often_id is not null").withColumnRenamed("often_id", "component_id")
        rows = marked.filter("often_id is null").drop("often_id")
    out = rows.join(known.filter(F.col("copies") < SALT_MEMBERS).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
    if not often.isEmpty():
        out = out.unionByName(done.select(out.columns))
    out = out.unionByName(base.filter("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
