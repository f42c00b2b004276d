"""MinHash near-duplicates by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import U64, chunks, cut, long, maybe_broadcast, mix, small, text_buffer, words_of
from provenir.llm.components import components

BANDS = 64
#: Chance to miss a pair that lies exactly at the threshold.
MISS = 1e-8
#: Members that one task compares with one representative; more are salted over several tasks.
SALT_ROWS = 500
#: Members of a group compared at once, and their shingles on average; larger groups are split into blocks.
BLOCK = 2048
BLOCK_SHINGLES = 2 << 20
#: One class in so many is looked at for buckets with many members, and the members that a salt of such a bucket should
#: hold. This decides which task does the work, never what is found.
LOOK = 64
SALT_MEMBERS = 1024
#: Tasks over which a join spreads a key with many rows.
SPREAD = 64
#: Shingles that this many pairs of a block share are counted by matrix products.
DENSE = 4096


def band_rows(similarity: float) -> int:
    """The most coordinates a band may have for a miss chance of at most ``MISS`` at the threshold."""
    rows = 1
    while (1 - similarity ** (rows + 1)) ** BANDS <= MISS:
        rows += 1
    return rows


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row as (row, hash), ordered by both; shorter rows are one shingle, empty rows none."""
    raw, offsets = text_buffer(column)
    words, _, _, first = words_of(raw, offsets, lower=True)
    counts = np.diff(first)
    full = np.maximum(counts - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), full)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full) + np.repeat(first[:-1], full)
    value = np.zeros(len(owner), U64)
    step = mix(np.arange(1, width + 1, dtype=U64)) | U64(1)
    for j in range(width):
        value += words[start + j] * step[j]
    for row in np.flatnonzero((counts > 0) & (counts < width)):
        owner = np.append(owner, row)
        value = np.append(value, (words[first[row] : first[row + 1]] * step[: counts[row]]).sum(dtype=U64) + U64(counts[row]))
    value = mix(value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[keep], value[keep]


def fast_similarity_sketch(owner: np.ndarray, value: np.ndarray, rows: int, size: int) -> np.ndarray:
    """``size`` coordinates for each row's set; two sets agree on a coordinate with the chance of their similarity.

    Round r throws every element into one hashed bin with a hashed value; a bin still empty before the round takes the
    least value thrown in. After ``size`` rounds, round ``size + j`` throws all elements into bin j, so every
    coordinate of a set that isn't empty gets filled. Empty sets keep the largest value.
    """
    top = U64(0xFFFFFFFFFFFFFFFF)
    cells = np.full(rows * size, top, U64)
    open_ = np.zeros(rows, bool)
    open_[owner] = True
    factors = mix(np.arange(1, 2 * size + 1, dtype=U64)) | U64(1)
    for r in range(2 * size):
        live = open_[owner]
        if not live.all():
            owner, value = owner[live], value[live]
        if not len(owner):
            break
        e = (value ^ factors[r]) * factors[r]
        e ^= e >> U64(29)
        e *= U64(0xBF58476D1CE4E5B9)
        bins = ((e >> U64(32)) * U64(size) >> U64(32)).view(np.int64) if r < size else np.full(len(e), r - size)
        key = owner * size + bins
        empty = cells[key] == top
        if r:
            key, e = key[empty], e[empty]
        np.minimum.at(cells, key, (e & U64(0xFFFFFFFF)) | U64(r) << U64(32))
        open_ &= (cells.reshape(rows, size) == top).any(axis=1)
    return cells.reshape(rows, size)


def _sketch(width: int, per_band: int):
    size = BANDS * per_band

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = mix(np.arange(1, per_band + 1, dtype=U64)) | U64(1)
        for batch in chunks(batches):
            owner, value = shingle_sets(batch.column(1), width)
            n = np.bincount(owner, minlength=batch.num_rows)
            one, two = np.zeros(batch.num_rows, U64), np.zeros(batch.num_rows, U64)
            np.add.at(one, owner, value)
            np.add.at(two, owner, mix(value ^ U64(0xA5A5A5A5A5A5A5A5)))
            cells = fast_similarity_sketch(owner, value, batch.num_rows, size)
            bands = mix((cells.reshape(-1, BANDS, per_band) * weight).sum(axis=2, dtype=U64) + np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(long(one)), pa.array(long(two)), pa.ListArray.from_arrays(ends, pa.array(long(bands).reshape(-1)))], names=["doc_id", "n_shingles", "h1", "h2", "bands"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ordered by (bucket, salt, cid): each member of a bucket and salt with two or more, with the first one."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, salt, cid = (batch.column(i).to_numpy() for i in (0, 1, 2))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        lead, place = cid[head], np.arange(len(key)) - head
        if last is not None and (key[0], salt[0]) == last[0]:
            lead, place = np.where(head == 0, last[1], lead), np.where(head == 0, place + last[2], place)
        last = ((key[-1], salt[-1]), lead[-1], place[-1] + 1)
        both = np.concatenate([np.flatnonzero(place > 0), np.flatnonzero(place == 1)])
        a = np.concatenate([cid[place > 0], lead[place == 1]])
        yield pa.RecordBatch.from_arrays([pa.array(key[both]), pa.array(salt[both]), pa.array(a), pa.array(lead[both])], names=["bucket", "salt", "a", "b"])


def stars_of(classes: DataFrame) -> DataFrame:
    """(bucket, salt, a, b): every member of a bucket with its least cid; in a salted bucket with its salt's least, which is linked in turn."""
    members = classes.select(F.explode("bands").alias("bucket"), "cid")
    seen = members.filter(F.pmod(F.xxhash64("cid"), F.lit(LOOK)) == 0).groupBy("bucket").agg((F.count("*") * LOOK).alias("n"))
    frequent = cut(seen.filter(F.col("n") >= 2 * SALT_MEMBERS).select("bucket", F.ceil(F.col("n") / SALT_MEMBERS).alias("salts")), "frequent")
    none = frequent.isEmpty()
    if none:
        members = members.withColumn("salt", F.lit(-1))
    else:
        members = members.join(maybe_broadcast(frequent), "bucket", "left")
        members = members.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("cid", F.lit(1)), "salts"), F.lit(-1)).cast("int"))
    near = members.select("bucket", "salt", "cid").repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "cid").mapInArrow(_stars, "bucket long, salt int, a long, b long")
    if none:
        return near
    leads = cut(members.filter("salt >= 0").groupBy("bucket", "salt").agg(F.min("cid").alias("a")), "leads")
    top = leads.groupBy("bucket").agg(F.min("a").alias("b"))
    return near.unionByName(leads.join(top, "bucket").select("bucket", F.lit(-1).alias("salt"), "a", "b"))


def _verifier(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sets = None, []
        for batch in chunks(batches):
            owner, value = shingle_sets(batch.column(batch.schema.get_field_index("text")), width)
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            got = []
            for i, (grp, salt, role, doc) in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("grp", "salt", "role", "doc_id")))):
                mine = value[ends[i] : ends[i + 1]]
                if group != (grp, salt):
                    group, sets = (grp, salt), []
                if role == 0:
                    sets.append(mine.copy())
                    continue
                for other in sets:
                    least = min(len(mine), len(other))
                    if 100 * least < percent * max(len(mine), len(other)):
                        continue
                    both = np.count_nonzero(other[np.minimum(np.searchsorted(other, mine), len(other) - 1)] == mine) if least else 0
                    if both and 100 * both >= percent * (len(mine) + len(other) - both):
                        got.append((doc, grp))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in got], pa.int64()) for j in (0, 1)], names=["a", "b"])

    return run


def verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets reach the threshold. A frequent b is salted over several tasks."""
    sizes = cut(pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("s")), "sizes")
    salted = spread_join(pairs, sizes.filter("s > 1"), ["b"], "a")
    member = salted.select(F.col("a").alias("doc_id"), F.col("b").alias("grp"), F.pmod(F.xxhash64("a"), F.coalesce("s", F.lit(1))).cast("int").alias("salt"), F.lit(1).alias("role"))
    lead = sizes.select(F.col("b").alias("doc_id"), F.col("b").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt"), F.lit(0).alias("role"))
    want = cut(member.unionByName(lead), "want")
    rows = docs.select("doc_id", "text").join(maybe_broadcast(want), "doc_id").repartition("grp", "salt").sortWithinPartitions("grp", "salt", "role", "doc_id")
    return cut(rows.mapInArrow(_verifier(width, percent), "a long, b long"), "links").distinct()


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of distinct shingles: frequent shingles by matrix products, rare ones by lists."""
    out = np.zeros((len(left), len(right)), np.int64)
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate([*sets, np.zeros(0, U64)]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    (x, xo), (y, yo) = sides
    both = np.intersect1d(x, y)
    for k, (value, owner) in enumerate(sides):
        at = np.minimum(np.searchsorted(both, value), max(len(both) - 1, 0))
        hit = both[at] == value if len(both) else np.zeros(len(value), bool)
        order = np.argsort(at[hit], kind="stable")
        sides[k] = at[hit][order], owner[hit][order]
    (x, xo), (y, yo) = sides
    nx, ny = np.bincount(x, minlength=len(both)), np.bincount(y, minlength=len(both))
    dense = nx * ny > DENSE
    column = np.cumsum(dense) - 1
    for first in range(0, int(dense.sum()), BLOCK):
        parts = []
        for value, owner, rows in ((x, xo, len(left)), (y, yo, len(right))):
            some = dense[value] & (column[value] >= first) & (column[value] < first + BLOCK)
            part = np.zeros((rows, BLOCK), np.float32)
            part[owner[some], column[value[some]] - first] = 1
            parts.append(part)
        out += (parts[0] @ parts[1].T).astype(np.int64)  # a block's sums are exact in 32 bits
    ends = np.concatenate([[0], np.cumsum(ny)])
    thin = ~dense[x]
    some = np.flatnonzero(thin)
    step = np.cumsum(ny[x[some]]) >> 20
    for chunk in np.split(some, np.flatnonzero(np.diff(step)) + 1):
        count = ny[x[chunk]]
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends[x[chunk]], count)
        np.add.at(out, (np.repeat(xo[chunk], count), yo[place]), 1)
    return out


def _across(width: int, percent: int):
    """Links between components inside one (group, bi, bj), from all exact similarities; a pair of components once."""

    def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        block = np.array([r[0] for r in rows])
        comp = np.array([r[1] for r in rows])
        sides = [np.flatnonzero(block == b) for b in np.unique(block)]
        left, right = sides[0], sides[-1]
        sets = [r[2] for r in rows]
        n = np.array([len(x) for x in sets])
        same = intersections([sets[i] for i in left], [sets[i] for i in right])
        near = (100 * same >= percent * (n[left][:, None] + n[right][None, :] - same)) & (comp[left][:, None] != comp[right][None, :]) & (same > 0)
        i, j = np.nonzero(near)
        pairs = np.unique(np.sort(np.column_stack([comp[left[i]], comp[right[j]]]), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].astype(np.int64)), pa.array(pairs[:, 0].astype(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in chunks(batches):
            owner, value = shingle_sets(batch.column(batch.schema.get_field_index("text")), width)
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            for k, (grp, bi, bj, block, comp) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(5)))):
                if group is not None and (grp, bi, bj) != group:
                    yield from emit(rows)
                    rows = []
                group = grp, bi, bj
                rows.append((block, comp, value[ends[k] : ends[k + 1]].copy()))
        if rows:
            yield from emit(rows)

    return run


def spread_join(rows: DataFrame, few: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Left join with keys that hold many rows each: broadcast after a size check, else over SPREAD salts of ``by``."""
    few = cut(few, "few")
    if small(few):
        return rows.join(F.broadcast(few), keys, "left")
    salted = few.withColumn("spread_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).cast("long"))
    return rows.withColumn("spread_salt", F.pmod(F.xxhash64(by), F.lit(SPREAD))).join(salted, [*keys, "spread_salt"], "left").drop("spread_salt")


def spread_root(rows: DataFrame, comp: DataFrame, often: DataFrame) -> DataFrame:
    """``rows`` (doc_id, n_shingles, cid) with the component of their class; classes of many rows go through :func:`spread_join`."""
    roots = comp.select(F.col("id").alias("cid"), F.col("root").alias("component_id"))
    if often.isEmpty():
        out = rows.join(roots, "cid", "left")
    else:
        heavy = often.join(roots, "cid", "left").select("cid", F.coalesce("component_id", "cid").alias("heavy_id"))
        known = spread_join(rows, heavy, ["cid"], "doc_id")
        out = known.filter("heavy_id is null").drop("heavy_id").join(roots, "cid", "left").unionByName(known.filter("heavy_id is not null").withColumnRenamed("heavy_id", "component_id"))
    return out.withColumn("component_id", F.coalesce("component_id", "cid"))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if the Jaccard similarity of their sets of ``width``-word shingles (A-Z lower-cased; words
    are runs of anything but ASCII white space) is at least ``percent`` hundredths. ``component_id`` is the smallest
    doc_id reachable over links. Documents with equal sets form one class, of which one member is compared.
    A null or blank text has no shingles and is linked with nothing; a null doc_id is a component of its own (null,
    kept); rows that repeat a doc_id are one node and each gets its row back. Further columns are ignored.
    """
    similarity = percent / 100
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = cut(source.mapInArrow(_sketch(width, band_rows(similarity)), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"), "sketches")
    some = base.filter("n_shingles > 0 and doc_id is not null")
    key = ["h1", "h2", "n_shingles"]
    classes = cut(some.groupBy(*key).agg(F.min("doc_id").alias("cid"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "classes")
    stars = cut(stars_of(classes), "stars")
    spokes = cut(stars.filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n")), "spokes")
    # First the spoke on which most bands agree, which settles nearly all.
    best = spokes.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    links = verify(best, source, width, percent)
    comp = cut(components(links), "components")

    def root(frame: DataFrame, col: str, alias: str) -> DataFrame:
        return frame.join(comp.select(F.col("id").alias(col), F.col("root").alias(alias)), col, "left").withColumn(alias, F.coalesce(alias, col))

    # Buckets that still hold several components: their members meet in groups, where all similarities are exact. The
    # first member of a bucket is among its rows, so no join goes by it.
    split = root(stars.select("bucket", "a"), "a", "ra").groupBy("bucket").agg(F.min("ra").alias("x"), F.max("ra").alias("y")).filter("x <> y").select("bucket")
    open_ = stars.select("bucket", "salt").distinct().join(split, "bucket", "left_semi")
    inside = cut(stars.filter("a <> b").join(open_, ["bucket", "salt"], "left_semi").select("a", "b").distinct(), "inside")
    if not inside.isEmpty():
        groups = cut(components(inside).select(F.col("id").alias("cid"), F.col("root").alias("grp")), "groups")
        blocks = groups.join(classes.select("cid", "n_shingles"), "cid").groupBy("grp").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("nb"))
        blocks = cut(blocks, "blocks")
        placed = root(spread_join(groups, blocks.filter("nb > 1"), ["grp"], "cid"), "cid", "comp").withColumn("nb", F.coalesce("nb", F.lit(1)))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        placed = cut(placed.select("grp", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "comp", F.col("cid").alias("doc_id")), "placed")
        rows = source.join(maybe_broadcast(placed), "doc_id").select("grp", "bi", "bj", "block", "comp", "text")
        rows = rows.repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj")
        links = cut(links.unionByName(rows.mapInArrow(_across(width, percent), "a long, b long")), "links")
        comp = cut(components(links), "components")
    # A text with many copies is looked up by salted rows, others by a plain join; texts without words by none.
    often = cut(classes.filter(F.col("copies") >= SALT_MEMBERS).select(*key, "cid"), "often")
    looked = some.select("doc_id", *key)
    if not often.isEmpty():
        known = spread_join(looked, often, key, "doc_id")
        rare = classes.filter(F.col("copies") < SALT_MEMBERS).select(*key, "cid")
        looked = known.filter("cid is not null").unionByName(known.filter("cid is null").drop("cid").join(rare, key).select(known.columns))
    else:
        looked = looked.join(classes.select(*key, "cid"), key)
    looked = cut(looked.select("doc_id", "n_shingles", "cid"), "looked")
    # A doc_id whose rows have different texts joins their classes.
    again = cut(looked.groupBy("doc_id").agg(F.min("cid").alias("b"), F.max("cid").alias("a")).filter("a <> b"), "again")
    if not again.isEmpty():
        pairs = looked.join(again.select("doc_id", "b"), "doc_id").select(F.col("cid").alias("a"), "b")
        comp = cut(components(links.unionByName(pairs)), "components")
    bare = base.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("cid"))
    if again.isEmpty():
        rows = spread_root(looked, comp, often.select("cid")).unionByName(bare.withColumn("component_id", F.col("cid")))
    else:  # such an id may have rows without words
        rows = spread_root(looked.unionByName(bare.join(looked.select("doc_id", F.col("cid").alias("c")).groupBy("doc_id").agg(F.min("c").alias("c")), "doc_id", "left").withColumn("cid", F.coalesce("c", "cid")).drop("c")), comp, often.select("cid"))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
