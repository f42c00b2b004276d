"""Quality by random Fourier features over document statistics, ridge regression and isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import chunks, cut, text_key
from provenir.llm.kernel import text_counts
from provenir.llm.stats import COUNTS, ratios
from provenir.llm.toxicity import held_out, known_labels

WAVES = 128
#: Width of the Gaussian kernel, in standard deviations of the statistics.
WIDTH = 2.5
RIDGE = 1e-3
SEED = 20
#: Cells into which out-of-fold scores are counted for calibration.
CELLS = 2_000
LOW, HIGH = -1.0, 2.0


def _waves(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features whose inner products approximate a Gaussian kernel, and a constant one."""
    rng = np.random.default_rng(SEED)
    w, shift = rng.normal(size=(x.shape[1], WAVES)) / WIDTH, rng.uniform(0, 2 * np.pi, WAVES)
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([np.sqrt(2 / WAVES) * np.cos(z @ w + shift), np.ones((len(x), 1))])


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]).reshape(batch.num_rows, len(names))


def _normal_equations(names: list[str], mean: np.ndarray, scale: np.ndarray):
    """Sums of z z' and z y of one partition, by fold, as (fold, i, row of the matrix with the right side last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, WAVES + 1, WAVES + 2))
        for batch in batches:
            z = _waves(_matrix(batch, names), mean, scale)
            y = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
            fold = batch.column(batch.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)
            for f in (0, 1):
                some = z[fold == f]
                total[f, :, :-1] += some.T @ some
                total[f, :, -1] += some.T @ y[fold == f]
        if total.any():
            n = WAVES + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], n).astype(np.int32)), pa.array(np.tile(np.arange(n), 2).astype(np.int32)), pa.array(total.reshape(2 * n, -1).tolist(), pa.list_(pa.float64()))], names=["fold", "i", "sums"])

    return run


def _cells(names: list[str], mean: np.ndarray, scale: np.ndarray, by_fold: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(batch.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)
            raw = (_waves(_matrix(batch, names), mean, scale) * by_fold[1 - fold]).sum(axis=1)
            cell = ((np.clip(raw, LOW, HIGH) - LOW) / (HIGH - LOW) * CELLS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(batch.schema.get_field_index("label")).cast(pa.int64())], names=["cell", "label"])

    return run


def isotonic(n: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Non-decreasing share of ``good`` per cell by pooling adjacent violators; with a little prior, so never 0 or 1."""
    blocks: list[list[float]] = []
    for a, b in zip(n, good):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            x = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], x)]
    return np.concatenate([np.full(int(k), (b + 0.01) / (a + 0.02)) for a, b, k in blocks]) if blocks else np.zeros(0)


def _score(names: list[str], mean: np.ndarray, scale: np.ndarray, beta: np.ndarray, at: np.ndarray, level: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _waves(_matrix(batch, names), mean, scale) @ beta
            cell = (np.clip(raw, LOW, HIGH) - LOW) / (HIGH - LOW) * CELLS
            score = np.clip(np.interp(cell, at, level), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(score)], names=["doc_id", "th", "held_out", "score"])

    return run


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        counts = text_counts(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(counts[c]) for c in COUNTS]], names=["doc_id", "th", *COUNTS])


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, th`` (1 from a score of ``threshold``; th: hash of the text).

    Learns ``labels.quality`` from all rows whose crc32(doc_id) mod 4 isn't 2; only statistics of the text are inputs.
    Null and empty texts have zero statistics and are scored by them; a null doc_id isn't held out; repeated rows are
    scored alike. Without labels of both kinds every score is the share of good labels (0.5 if there are none).
    """
    names = sorted(ratios())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("th"), text.alias("text"))
    stats = source.mapInArrow(_statistics, "doc_id long, th long, " + ", ".join(f"{c} long" for c in COUNTS))
    stats = cut(stats.select("doc_id", "th", held_out(4, 2).alias("held_out"), *[c.alias(n) for n, c in ratios().items()]), "statistics")
    known = known_labels(labels, "quality", 4, 2)
    learn = stats.filter("not held_out").join(known, "doc_id").dropDuplicates(["doc_id"]).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    learn = cut(learn.select(*names, "label", "fold"), "labelled")
    whole = learn.agg(F.count("*").alias("n"), F.coalesce(F.avg("label"), F.lit(0.5)).alias("good"), *[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).first()
    if whole["good"] in (0.0, 1.0) or not whole["n"]:
        scored = stats.select("doc_id", "th", "held_out", F.lit(float(whole["good"])).alias("score"))
    else:
        mean, scale = np.array([whole[f"m_{n}"] for n in names]), np.array([whole[f"s_{n}"] or 1.0 for n in names])
        sums = learn.mapInArrow(_normal_equations(names, mean, scale), "fold int, i int, sums array<double>")
        sums = sums.select("fold", "i", F.posexplode("sums").alias("j", "v")).groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
        total = np.zeros((2, WAVES + 1, WAVES + 2))
        for r in sums.collect():  # as many rows as the model has cells
            total[r["fold"], r["i"], r["j"]] = r["v"]

        def solve(t: np.ndarray) -> np.ndarray:
            return np.linalg.solve(t[:, :-1] + RIDGE * max(t[-1, -2], 1.0) / 10 * np.eye(WAVES + 1), t[:, -1])

        by_fold, beta = np.array([solve(t) for t in total]), solve(total.sum(axis=0))
        cells = learn.mapInArrow(_cells(names, mean, scale, by_fold), "cell long, label long").groupBy("cell").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()
        cells.sort(key=lambda r: r["cell"])
        level = isotonic(np.array([r["n"] for r in cells], float), np.array([r["good"] for r in cells], float))
        scored = stats.select("doc_id", "th", "held_out", *names).mapInArrow(_score(names, mean, scale, beta, np.array([r["cell"] + 0.5 for r in cells]), level), "doc_id long, th long, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "th")
