"""Repeated byte strings by a sparse suffix array that is dealt over range partitions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from provenir.llm.common import U64, text_buffer
from provenir.llm.repeats import BUCKET, MOST, Tokens, remove_repeats, spread, windows


def multikey_quicksort(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of tokens by three-way partitioning around a pivot.

    Rows below, at and above the pivot part; those at it go on with the next token, the others with the same one. All
    open groups are partitioned in one pass; a pivot is the median of a group's first, middle and last token.
    """
    n, depth = keys.shape
    order = np.arange(n)
    start, count, level = np.array([0]), np.array([n]), np.array([0])
    while True:
        live = (count > 1) & (level < depth)
        start, count, level = start[live], count[live], level[live]
        if not len(start):
            return order
        at, group = spread(start, count)
        token = keys[order[at], level[group]]
        base = np.cumsum(count) - count
        a, b, c = token[base], token[base + count // 2], token[base + count - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[group]
        side = 3 * group + (token >= pivot) + (token > pivot)
        order[at] = order[at][np.argsort(side, kind="stable")]
        sizes = np.bincount(side, minlength=3 * len(start)).reshape(-1, 3)
        start = (start[:, None] + np.cumsum(sizes, axis=1) - sizes).reshape(-1)
        level = (level[:, None] + np.array([0, 1, 0])).reshape(-1)
        count = sizes.reshape(-1)


def _sorted(raw: np.ndarray, start: np.ndarray, step: int, have: np.ndarray, depth: int) -> Callable[[int], np.ndarray]:
    """Sort the strings that go from ``start`` by ``step``; for a depth, numbers that neighbours share whose common prefix is as long."""
    n = len(start)
    if not depth:
        return lambda d: np.zeros(n, np.int64)
    at = start[:, None] + step * np.arange(depth)[None, :]
    side = raw[np.clip(at, 0, max(len(raw) - 1, 0))]
    side[np.arange(depth)[None, :] >= have[:, None]] = 0
    wide = np.zeros((n, -(-depth // 8) * 8), np.uint8)
    wide[:, :depth] = side
    order = multikey_quicksort(wide.view(">u8").astype(U64))
    differs = side[order[1:]] != side[order[:-1]]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), depth)

    def classes(d: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[order[1:]] = np.cumsum(common < d)
        return out

    return classes


def resolve(raw: np.ndarray, offsets: np.ndarray, off: np.ndarray, t: Tokens) -> tuple[np.ndarray, ...]:
    """Windows of a bucket's cells: the suffixes at the anchors are sorted, then the reversed prefixes before them."""
    anchor, right = offsets[:-1] + off, np.diff(offsets) - off
    return windows(_sorted(raw, anchor, 1, right, t.length), _sorted(raw, anchor - 1, -1, off, t.length - t.gram), off, right, t)


def _lead(batch: pa.RecordBatch) -> np.ndarray:
    """The leading bytes of each suffix, as one value; all are as long."""
    raw, offsets = text_buffer(batch.column(0).cast(pa.large_binary()))
    return np.ascontiguousarray(raw).view(f"V{offsets[1]}")


def _by_range(contexts: DataFrame) -> DataFrame:
    """Sampled splitters of the leading bytes part the suffixes; a task's suffixes are in their order."""
    n = max(1, int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return contexts.repartitionByRange(n, "lead").sortWithinPartitions("lead", "gram", "cell")


def suffix_array_dedup(docs: DataFrame, *, length: int = 200, bucket: int = BUCKET, most: int = MOST, texts: bool = False) -> DataFrame:
    """Remove bytes covered by a ``length``-byte string that starts elsewhere too; columns and odd inputs as in :func:`remove_repeats`.

    The suffixes that start at anchors form a sparse suffix array. Sampled splitters range-partition them by their leading
    bytes; each task goes through its range in buckets, sorts each by multikey quicksort, and neighbours' common prefixes
    decide which strings repeat. Suffixes with one string in common share their leading bytes, so no match crosses a
    splitter; at the edges of buckets and batches the leading bytes of the two neighbours are compared, and a group that
    goes on stays together, or, beyond ``most`` suffixes, meets again by digests of its strings.
    """
    t = Tokens(length, max(1, min(32, length // 4)), words=False)
    return remove_repeats(docs, t, resolve, _lead, _by_range, bucket=bucket, most=most, texts=texts)
