"""Shared pieces: shared-storage cuts, size-checked joins, and vectorised hashing of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir import storage
from provenir.storage import maybe_broadcast, small  # noqa: F401  for the operators

U64 = np.uint64
#: Text bytes handled at once inside a Python worker.
CHUNK_BYTES = 1 << 19
#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Cap Arrow batches by bytes, unless the session has a lower cap: rows alone don't bound memory where texts are long."""
    now = spark.conf.get(BATCH_SETTING, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back, which ends its lineage."""
    bound_batches(df.sparkSession)
    return storage.cut(df, name)


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id, or without one, apart by their texts: 64 bits; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- hashing ---------------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser, elementwise on uint64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = 0x9E3779B97F4A7C55
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base modulo 2**64, and those of its inverse."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[base] = (both[0], both[1])
    return _powers[base]


class Rolling:
    """Polynomial hashes of any range of a uint64 sequence."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        self.up, self.down = powers(len(values), base)
        self.sums = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# -- Arrow text ------------------------------------------------------------------------------------------------------


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column, where null reads as empty, or of a large binary one without nulls."""
    if not pa.types.is_large_binary(column.type):
        column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text stays under ``limit`` bytes, or one row where that alone is longer."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(raw: np.ndarray, offsets: np.ndarray, *, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row: hashes, first bytes, end bytes, and where each row's words begin.

    Words never cross rows. ``lower`` maps A-Z to a-z before hashing.
    """
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    rolling = Rolling(BYTE_VALUES[_LOWER[raw] if lower else raw])
    return rolling.of(starts, ends), starts, ends, np.searchsorted(starts, offsets)
