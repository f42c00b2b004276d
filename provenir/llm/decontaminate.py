"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of the passages they point at."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.llm.common import U64, chunks, cut, long, maybe_broadcast, mix, text_buffer, text_key, words_of
from provenir.llm.neardup import spread_join

#: Words of a seed; of an item with fewer than SHORT words, two: an edit of every third word leaves no three in a row.
GRAM, SHORT_GRAM, SHORT = 3, 2, 16
#: Of the grams of an item with more than MIDDLE words, the rarest in the corpus that serve as seeds, two of which must be
#: shared. Of shorter items all are seeds, and one is enough.
RAREST, MIDDLE = 0.75, 25
#: Bits of the fixed-size filter that keeps grams of no item out of the shuffle; its misses only cost time.
FILTER_BITS = 22
MATCH, MISMATCH, GAP = 2, -1, -1
_MARKS = np.arange(256, dtype=np.uint8)
_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32


def _words(raw: np.ndarray, offsets: np.ndarray):
    """Lower-cased words; ASCII punctuation parts words."""
    return words_of(_MARKS[raw], offsets, lower=True)


def _grams(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of its first word) of every gram of ``size`` words; a shorter text's only gram is all its words."""
    counts = np.diff(first)
    full = np.maximum(counts - size + 1, 0)
    start = np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full) + np.repeat(first[:-1], full)
    step = mix(np.arange(1, size + 1, dtype=U64)) | U64(1)
    value = np.zeros(len(start), U64)
    for j in range(size):
        value += words[start + j] * step[j]
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        start = np.append(start, first[r])
        value = np.append(value, (words[first[r] : first[r + 1]] * step[: counts[r]]).sum(dtype=U64) + U64(counts[r]))
    return mix(value + U64(size)), start


def _item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        raw, offsets = text_buffer(batch.column(1))
        words, _, _, first = _words(raw, offsets)
        n = np.diff(first)
        for size, some in ((GRAM, n >= SHORT), (SHORT_GRAM, n < SHORT)):
            grams, start = _grams(words, first, size)
            row = np.searchsorted(first, start, side="right") - 1
            mine = some[row]
            grams, row = grams[mine], row[mine]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(long(grams)), pa.array(n[row])], names=["item_id", "gram", "n_words"])


def _slots(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (grams >> U64(64 - FILTER_BITS)).astype(np.int64), (grams & U64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter of one partition, as a bit string."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        for slot in _slots(batch.column(0).to_numpy().view(U64)):
            bits[slot] = True
    if bits.any():
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])


REGIONS = "doc_id long, th long, region int, grams array<long>, passage string"


def _regions(bits: bytes, reach: int, sizes: list[int]):
    """Stretches of a document around grams of the sizes that pass the filter, with ``reach`` more words on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for batch in chunks(batches):
            raw, offsets = text_buffer(batch.column(2))
            words, begin, end, first = _words(raw, offsets)
            grams, start = (np.concatenate(x) for x in zip(*(_grams(words, first, size) for size in sizes)))
            one, two = _slots(grams)
            hit = np.flatnonzero(known[one] & known[two])
            hit = hit[np.argsort(start[hit], kind="stable")]
            grams, start = grams[hit], start[hit]
            row = np.searchsorted(first, start, side="right") - 1
            new = np.ones(len(hit), bool)
            new[1:] = (row[1:] != row[:-1]) | (start[1:] - start[:-1] > reach)
            at = np.append(np.flatnonzero(new), len(hit))
            out = []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                r = row[i]
                a, b = max(first[r], start[i] - reach), min(first[r + 1], start[j - 1] + GRAM + reach)
                out.append((r, i, np.unique(grams[i:j]).view(np.int64), raw[begin[a] : end[b - 1]].tobytes().decode("utf-8", "replace")))
            rows = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.list_(pa.int64())), pa.array([x[3] for x in out], pa.string())], names=["doc_id", "th", "region", "grams", "passage"])

    return run


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> int:
    """Best local alignment score of two word sequences. A row's left moves are a running maximum."""
    slope = GAP * np.arange(len(passage) + 1)
    above, best = np.zeros(len(passage) + 1, np.int64), 0
    for w in item:
        now = np.zeros(len(passage) + 1, np.int64)
        now[1:] = np.maximum(np.maximum(above[:-1] + np.where(passage == w, MATCH, MISMATCH), above[1:] + GAP), 0)
        now = np.maximum.accumulate(now - slope) + slope
        best = max(best, int(now.max()))
        above = now
    return best


def _aligned(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "passage"):
            sides = []
            for c in ("passage", "item_text"):
                raw, offsets = text_buffer(batch.column(batch.schema.get_field_index(c)))
                words, _, _, first = _words(raw, offsets)
                sides.append((words, first))
            (p, pf), (t, tf) = sides
            share = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                item, passage = t[tf[i] : tf[i + 1]], p[pf[i] : pf[i + 1]]
                if len(item) and np.isin(item, passage).sum() >= least * len(item):  # fewer matches can't reach the share
                    share[i] = smith_waterman(item, passage) / (MATCH * len(item))
            ok = pa.array(np.flatnonzero(share >= least))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).take(ok) for c in ("doc_id", "th", "item_id")] + [pa.array(share).take(ok)], names=["doc_id", "th", "item_id", "score"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.5) -> DataFrame:
    """Pairs ``doc_id, item_id, score, th`` of documents that hold a verbatim, edited or paraphrased copy of a test item.

    Seeds are an item's grams of three words, or two in items of fewer than 16; of items with more than 25 words, the
    rarest three quarters by their document counts over the whole corpus. A stretch of a document that shares a seed with
    an item (two, where it has more than 25 words) is aligned with it word by word; ``score`` is the alignment's share of
    a perfect one and reaches ``least``. An item of one word matches texts of that word only. Null and empty texts and items
    match nothing, and items without an id none. Documents without an id, and those that share one, give a pair once each
    text (``th`` is its 64-bit hash); rows repeated in full give it once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("th"), text.alias("text"))
    items = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), text.alias("text"))
    seeds = cut(items.mapInArrow(_item_grams, "item_id long, gram long, n_words long"), "seeds")
    reach, least_words = seeds.agg(F.max("n_words"), F.min("n_words")).first()
    if reach is None:
        return source.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("score"), "th").limit(0)
    sizes = [GRAM] * (reach >= SHORT) + [SHORT_GRAM] * (least_words < SHORT)
    maps = [np.frombuffer(r["bits"], np.uint8) for r in seeds.select("gram").coalesce(8).mapInArrow(_bitmap, "bits binary").collect()]
    regions = cut(source.mapInArrow(_regions(np.bitwise_or.reduce(maps).tobytes(), int(reach), sizes), REGIONS), "regions")
    spread = regions.select("doc_id", F.explode("grams").alias("gram")).distinct().groupBy("gram").agg(F.count("*").alias("df"))
    each = seeds.select("item_id", "gram", "n_words").distinct().join(spread, "gram", "left")
    by_item = Window.partitionBy("item_id")
    ranked = each.select("item_id", "gram", "n_words", F.row_number().over(by_item.orderBy(F.coalesce("df", F.lit(0)), "gram")).alias("k"), F.count("*").over(by_item).alias("n"))
    kept = F.when(F.col("n_words") > MIDDLE, F.ceil(F.col("n") * RAREST)).otherwise(F.col("n"))
    need = F.when(F.col("n_words") > MIDDLE, F.least(kept, F.lit(2))).otherwise(1)
    rare = ranked.filter(F.col("k") <= kept).select("item_id", "gram", need.alias("need"))
    hits = spread_join(regions.select("doc_id", "th", "region", F.explode("grams").alias("gram")), rare, ["gram"], "th").filter("item_id is not null")
    pairs = hits.groupBy("doc_id", "th", "region", "item_id").agg(F.count("*").alias("shared"), F.first("need").alias("need")).filter("shared >= need")
    wanted = pairs.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.col("region").alias("r"), "item_id")
    passages = wanted.join(regions.select("doc_id", "th", "region", "passage"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th")) & (F.col("r") == F.col("region")))
    both = passages.join(maybe_broadcast(items.select("item_id", F.col("text").alias("item_text")), 2_000), "item_id")
    scores = both.select("doc_id", "th", "item_id", "passage", "item_text").mapInArrow(_aligned(least), "doc_id long, th long, item_id long, score double")
    return scores.groupBy("doc_id", "th", "item_id").agg(F.max("score").alias("score")).select("doc_id", "item_id", "score", "th")


def clean_of(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.5) -> DataFrame:
    """``docs`` without the documents that :func:`contaminated` pairs with an item; all columns stay."""
    bad = contaminated(docs, benchmark, least=least).select(F.col("doc_id").alias("__bad_doc"), F.col("th").alias("__bad_th")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__bad_doc")) & (text_key(F.col("text")) == F.col("__bad_th"))
    return docs.join(maybe_broadcast(cut(bad, "contaminated")), same, "left_anti")
