"""Best-fit packing of documents into training sequences, without conflicts of source or duplicate cluster in a bin."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import U64, chunks, long, mix, text_buffer, words_of

CAPACITY = 2_048
#: Pieces that one shard packs; shards are independent, their number follows the input.
SHARD_ROWS = 8_192


class Bins:
    """Open bins ordered by what is left in them. Bitmaps tell which sources and clusters a bin holds."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.sizes: list[int] = []  # residuals that have bins, ascending
        self.at: dict[int, list[list[int]]] = {}  # residual -> [number, sources, clusters, pieces]
        self.full: dict[int, list[int]] = {}  # residual -> sources and clusters that all its bins hold

    def put(self, tokens: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, place in it): the successor search goes up from ``tokens`` to the first residual with a compatible bin."""
        i = bisect_left(self.sizes, tokens)
        while i < len(self.sizes):
            left = self.sizes[i]
            sources, clusters = self.full[left]
            if not (sources & source or clusters & cluster):
                for k, b in enumerate(self.at[left]):
                    if not (b[1] & source or b[2] & cluster):
                        self._take(left, i, k)
                        return self._add(b, left - tokens, source, cluster)
            i += 1
        self.made += 1
        return self._add([self.made - 1, 0, 0, 0], self.capacity - tokens, source, cluster)

    def _take(self, left: int, i: int, k: int) -> None:
        bins = self.at[left]
        bins.pop(k)
        if not bins:
            del self.at[left], self.full[left]
            self.sizes.pop(i)
        else:
            both = [-1, -1]
            for b in bins:
                both[0] &= b[1]
                both[1] &= b[2]
            self.full[left] = both

    def _add(self, b: list[int], left: int, source: int, cluster: int) -> tuple[int, int]:
        b[1] |= source
        b[2] |= cluster
        b[3] += 1
        if left:
            if left not in self.at:
                self.at[left], self.full[left] = [], [-1, -1]
                insort(self.sizes, left)
            self.at[left].append(b)
            both = self.full[left]
            both[0] &= b[1]
            both[1] &= b[2]
        return b[0], b[3] - 1


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words of every text, and a hash of its lower-cased words in order."""
    for batch in chunks(batches):
        raw, offsets = text_buffer(pc.utf8_lower(pc.fill_null(batch.column(2), "")))
        words, _, _, first = words_of(raw, offsets)
        count = np.diff(first)
        place = np.arange(len(words)) - np.repeat(first[:-1], count)
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(words + mix(place.astype(U64))), dtype=U64)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count), pa.array(long(mix(total[first[1:]] - total[first[:-1]] + count.astype(U64))))], names=["doc_id", "source", "n", "cluster"])


PACKED = "doc_id long, piece int, n_pieces int, n_tokens long, bin_id long, place int"


def _pack(capacity: int):
    def shard(number: int, rows: list[tuple]) -> pa.RecordBatch:
        often = Counter(r[5] for r in rows) + Counter(("near", r[6]) for r in rows if r[6] is not None)
        sources: dict = {}
        clusters: dict = {}
        bins, out = Bins(capacity), []
        for doc, piece, pieces, tokens, source, cluster, near in sorted(rows, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5], r[1], r[4] is None, r[4] or "")):
            bit = 1 << sources.setdefault(source, len(sources)) if source is not None else 0
            # A cluster that this shard has once can't be in conflict
            mark = 0
            for c in (cluster, ("near", near)):
                if often[c] > 1:
                    mark |= 1 << clusters.setdefault(c, len(clusters))
            b, place = bins.put(tokens, bit, mark)
            out.append((doc, piece, pieces, tokens, number << 32 | b, place))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["doc_id", "piece", "n_pieces", "n_tokens", "bin_id", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows = None, []
        for batch in batches:
            for n, *row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if n != number and rows:
                    yield shard(number, rows)
                    rows = []
                number = n
                rows.append(tuple(row))
        if rows:
            yield shard(number, rows)

    return run


def best_fit_packing(docs: DataFrame, near: DataFrame | None = None, *, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: ``doc_id, piece, n_pieces, n_tokens, bin_id, place``; a token is a word between ASCII white space.

    Documents longer than ``capacity`` are cut into full pieces, each a bin of its own, and a rest. No bin holds two
    pieces of one ``source`` or of one duplicate cluster: equal lower-cased words or, with ``near``, one ``component_id``
    of ``near_duplicates``, found by ``doc_id``. A full piece shares its bin with none. Within a shard pieces go by falling size, then by doc_id
    (null last), cluster, piece and source, into the fullest bin that can take them. Shards hold about ``shard_rows`` documents by a hash, so one source or cluster never gathers in one task. A null or blank text is one
    piece of 0 tokens; a null source conflicts with nothing; rows repeated in full are packed each; other columns are ignored.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    df = df.mapInArrow(_sizes, "doc_id long, source string, n long, cluster long")
    if near is None:
        df = df.withColumn("near", F.lit(None).cast("long"))
    else:
        df = df.join(near.filter("doc_id is not null").select("doc_id", F.col("component_id").alias("near")).distinct(), "doc_id", "left")
    shards = max(1, -(-docs.count() // shard_rows))
    pieces = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int")
    df = df.withColumn("n_pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    tokens = F.least(F.col("n") - F.col("piece") * F.lit(capacity), F.lit(capacity)).cast("long")
    rows = df.select(F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)).alias("shard"), "doc_id", "piece", "n_pieces", tokens.alias("n_tokens"), "source", "cluster", "near")
    width = min(shards, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return rows.repartition(width, "shard").sortWithinPartitions("shard").mapInArrow(_pack(capacity), PACKED)
