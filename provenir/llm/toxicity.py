"""Toxicity by a linear classifier that is held to the same score when identity terms in its sentences are swapped."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import BYTE_VALUES, U64, Rolling, chunks, cut, long, mix, text_buffer

#: Labelled documents used for fitting, at most, of either label: those with the least hashes of their ids.
TOXIC_SAMPLE, CLEAN_SAMPLE = 4_000, 8_000
#: Features that the model weighs, besides those of the identity terms.
FEATURES = 8_192
LEAST_DOCUMENTS = 5
L2, SWAP_PENALTY, TERM_PENALTY = 2e-3, 5.0, 0.5
#: Distinct counterfactual changes used for fitting, at most: the most frequent ones.
CHANGES = 20_000
# Groups of identity terms; a term is swapped with every other one of its group.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("immigrants", "refugees", "migrants", "foreigners", "locals"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("femmes", "hommes", "noirs", "blancs", "immigrés"),
    ("muslime", "christen", "juden", "atheisten"),
    ("frauen", "männer", "schwarze", "weiße", "flüchtlinge"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
    ("mujeres", "hombres", "negros", "blancos", "inmigrantes"),
)
GROUP = {term: group for group in IDENTITY for term in group}
MOST = max(len(group) for group in IDENTITY)
_TERMS = re.compile(r"\b(" + "|".join(sorted(GROUP, key=len, reverse=True)) + r")\b")
_SENTENCE = re.compile(r"[^.!?\n]+")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def swapped(text: str, by: int = 1) -> str:
    """The lower-cased text with every identity term replaced by the one ``by`` places on in its group; by 0, left out."""
    other = lambda g, term: g[(g.index(term) + by) % len(g)] if by else ""
    return _TERMS.sub(lambda m: other(GROUP[m[1]], m[1]), text)


def counterfactuals(text: str) -> Iterator[tuple[str, str]]:
    """(sentence, the same with its identity terms swapped) for every sentence with such terms and every swap that changes it."""
    for sentence in _SENTENCE.findall(text):
        if _TERMS.search(sentence):
            for other in {swapped(sentence, by) for by in range(MOST)} - {sentence}:
                yield sentence, other


def word_features(column: pa.Array, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of a string column: whole words, their first 4 to 7 and last 4 to 6 bytes, lower-cased.

    With sorted ``chosen`` features, (row, place in them) of those only, which are looked up before they are sorted.
    """
    if chosen is not None:
        slots = np.zeros(1 << 20, bool)
        slots[(chosen >> U64(44)).astype(np.int64)] = True
    raw, offsets = text_buffer(pc.utf8_lower(pc.fill_null(column, "")))
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, U64 if chosen is None else np.int64)
    inside = _LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    row = np.searchsorted(offsets, a, side="right") - 1
    rolling = Rolling(BYTE_VALUES[raw])
    rows, found = [row], [rolling.of(a, b)]
    # A word once per row, before its parts are taken
    order = np.lexsort((found[0], row))
    first = np.ones(len(order), bool)
    first[1:] = (row[order][1:] != row[order][:-1]) | (found[0][order][1:] != found[0][order][:-1])
    keep = order[first]
    a, b, row = a[keep], b[keep], row[keep]
    rows, found = [row], [found[0][keep]]
    for k, tail in ((4, False), (5, False), (6, False), (7, False), (4, True), (5, True), (6, True)):
        long_enough = b - a > k
        x, y = (b[long_enough] - k, b[long_enough]) if tail else (a[long_enough], a[long_enough] + k)
        rows.append(row[long_enough])
        found.append(mix(rolling.of(x, y) + U64(2 * k + tail)))
    if chosen is not None:
        for i, (r, f) in enumerate(zip(rows, found)):
            may = np.flatnonzero(slots[(f >> U64(44)).astype(np.int64)])
            rows[i], found[i] = _places(r[may], f[may], chosen)
    row, feature = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
    return row[first], feature[first]


def _places(row: np.ndarray, feature: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places in the sorted ``chosen`` of those features that are in it."""
    at = np.minimum(np.searchsorted(chosen, feature), len(chosen) - 1)
    hit = chosen[at] == feature if len(chosen) else np.zeros(len(feature), bool)
    return row[hit], at[hit]


def _changes(batches: Iterator[pa.RecordBatch], chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What swaps change: places of features that go and that come, and how often so."""
    seen: Counter = Counter()
    for batch in chunks(batches):
        pairs = [p for x in batch.column(0).to_pylist() for p in counterfactuals((x or "").lower())]
        if not pairs:
            continue
        sides = []
        for k in (0, 1):
            row, place = word_features(pa.array([p[k] for p in pairs]), chosen)
            ends = np.searchsorted(row, np.arange(len(pairs) + 1))
            sides.append([set(place[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])])
        seen.update((tuple(sorted(x - y)), tuple(sorted(y - x))) for x, y in zip(*sides) if x != y)
    if seen:
        kinds = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kinds], pa.list_(pa.int32())), pa.array([k[1] for k in kinds], pa.list_(pa.int32())), pa.array([seen[k] for k in kinds], pa.int64())], names=["goes", "comes", "n"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        row, feature = word_features(batch.column(0))
        label = batch.column(1).to_numpy(zero_copy_only=False)[row]
        kinds, inverse = np.unique(feature, return_inverse=True)
        toxic = np.bincount(inverse, weights=label, minlength=len(kinds)).astype(np.int64)
        total = np.bincount(inverse, minlength=len(kinds))
        yield pa.RecordBatch.from_arrays([pa.array(long(kinds)), pa.array(toxic), pa.array(total)], names=["feature", "toxic", "total"])


def _examples(chosen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            row, place = word_features(batch.column(0), chosen)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))], names=["label", "own"])

    return run


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], np.int64)


def fit(labels: np.ndarray, own: list[list[int]], changes: list[tuple[list[int], list[int], int]], terms: np.ndarray, size: int, *, steps: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Class-balanced logistic regression by Adam.

    The mean squared change of a sentence's log odds under the swaps (``changes``: features that go, that come, how often)
    is penalised, and so are the squared weights of the identity ``terms`` themselves, which pulls them towards zero.
    """
    weight, bias = np.zeros(size), 0.0
    row, place = _flat(own)
    grow, gplace = _flat([c[0] for c in changes])
    crow, cplace = _flat([c[1] for c in changes])
    often = np.array([c[2] for c in changes], float)
    often /= max(1.0, often.sum())
    ridge = np.full(size, L2)
    ridge[terms] += TERM_PENALTY
    balance = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=weight[place], minlength=len(own)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope = balance * (p - labels)
        grad = np.bincount(place, weights=slope[row], minlength=size) + ridge * weight
        if len(changes):
            gap = np.bincount(grow, weights=weight[gplace], minlength=len(changes)) - np.bincount(crow, weights=weight[cplace], minlength=len(changes))
            pull = 2 * SWAP_PENALTY * often * gap
            grad += np.bincount(gplace, weights=pull[grow], minlength=size) - np.bincount(cplace, weights=pull[crow], minlength=size)
        g = np.append(grad, slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weight -= move[:-1]
        bias -= move[-1]
    return weight, bias


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def known_labels(labels: DataFrame, label: str, modulus: int, remainder: int) -> DataFrame:
    """(doc_id, label) for learning: no held-out ids, no nulls, an id once."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(modulus, remainder))
    return rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature hashes, their weights and the bias."""
    known = known_labels(labels, "toxic", 5, 0)
    least = F.xxhash64("doc_id"), F.col("doc_id")
    some = known.filter("label = 1").orderBy(*least).limit(TOXIC_SAMPLE).unionByName(known.filter("label = 0").orderBy(*least).limit(CLEAN_SAMPLE))
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", F.col("label").cast("long").alias("label"), "doc_id").dropDuplicates(["doc_id"]).select("text", "label"), "toxic-sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return np.zeros(1, U64), np.zeros(1), 0.0 if not sizes else (2.0 if toxic else -2.0)
    counts = sample.mapInArrow(_counts, "feature long, toxic long, total long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("total").alias("n")).filter(F.col("n") >= LEAST_DOCUMENTS)
    odds = F.log((F.col("t") + 0.5) / (toxic - F.col("t") + 0.5)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean - F.col("n") + F.col("t") + 0.5))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") - F.col("t") + 0.5))
    best = counts.select("feature", F.abs(odds / error).alias("z")).orderBy(F.desc("z"), "feature").limit(FEATURES)
    terms = np.unique(word_features(pa.array(sorted(GROUP)))[1])
    chosen = np.unique(np.concatenate([np.array([r["feature"] for r in best.collect()], np.int64).view(U64), terms]))
    rows = sample.mapInArrow(_examples(chosen), "label long, own array<int>").collect()
    rows.sort(key=lambda r: (r["label"], r["own"]))
    changes = sample.mapInArrow(lambda b: _changes(b, chosen), "goes array<int>, comes array<int>, n long").groupBy("goes", "comes").agg(F.sum("n").alias("n"))
    changes = [(r["goes"], r["comes"], r["n"]) for r in changes.orderBy(F.desc("n"), "goes", "comes").limit(CHANGES).collect()]
    weight, bias = fit(np.array([r["label"] for r in rows], float), [r["own"] for r in rows], changes, np.searchsorted(chosen, terms), len(chosen))
    return chosen, weight, bias


def _score(chosen: np.ndarray, weight: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            row, place = word_features(batch.column(2), chosen)
            z = np.bincount(row, weights=weight[place], minlength=batch.num_rows) + bias
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted`` (1 from a score of 0.5).

    Learns ``labels.toxic`` from rows whose crc32(doc_id) mod 5 isn't 0, on a bounded sample; only the text is an input.
    In every labelled sentence that names a group, the name is swapped with each other one of its kind and left out, and
    changes of the score are penalised, so that naming a group tells nothing.
    Null and empty texts get the bias's score; a null doc_id isn't held out; repeated rows are scored alike; if the
    sample lacks a label, every score is that of the other one. Other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(source, labels)
    rows = source.select("doc_id", held_out(5, 0).alias("held_out"), "text")
    return rows.mapInArrow(_score(*model), "doc_id long, held_out boolean, score double, predicted int")
