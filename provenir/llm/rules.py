"""Learned decision lists over text statistics, emitted as ordered Spark conditions. DataFrame operations only."""

from __future__ import annotations

import operator
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.stats import COUNTS, ratios, text_stats

#: Labelled rows the list is learned from: those with the least hashes of their ids.
SAMPLE = 8_000
CUTS = 24
MAX_RULES = 8
MAX_TERMS = 3
#: A rule must reject this share of bad rows among those it covers, on rows held back from growing it.
PRECISION = 0.9
MIN_COVER = 5


@dataclass(frozen=True)
class Term:
    name: str
    above: bool
    at: float

    def column(self) -> Column:
        value = ratios()[self.name]
        return value >= self.at if self.above else value <= self.at

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<='} {self.at:.6g}"


def _covers(rows: list[dict], terms: list[Term]) -> list[dict]:
    for t in terms:
        test = operator.ge if t.above else operator.le
        rows = [r for r in rows if test(r[t.name], t.at)]
    return rows


def _best_term(rows: list[dict], names: list[str]) -> Term | None:
    """The threshold with the best weighted gain in the share of bad rows."""
    bad = sum(r["bad"] for r in rows)
    best, gain = None, 0.0
    for name in names:
        ordered = sorted((r[name], r["bad"]) for r in rows)
        n = len(ordered)
        total = [0]
        for _, b in ordered:
            total.append(total[-1] + b)
        values = [v for v, _ in ordered]
        # Thresholds at quantiles of all rows and of the bad ones, below and above the rows of equal value there
        near = {min(k, n - 1) for c in range(CUTS) for k in (n * c // CUTS, bisect_left(total, bad * c // CUTS))}
        for value in sorted({values[k] for k in near}):
            for place in (bisect_left(values, value), bisect_right(values, value)):
                if not 0 < place < n:
                    continue
                at = (ordered[place - 1][0] + ordered[place][0]) / 2
                for above, k, b in ((True, n - place, bad - total[place]), (False, place, total[place])):
                    if b >= MIN_COVER and (g := b * (b / k - bad / n)) > gain + 1e-12:
                        best, gain = Term(name, above, at), g
    return best


def _worth(rows: list[dict], terms: list[Term]) -> float:
    got = _covers(rows, terms)
    bad = sum(r["bad"] for r in got)
    return (bad + 1) / (len(got) + 2) if got else 0.0


def learn(rows: list[dict]) -> list[list[Term]]:
    """Sequential covering: grow a conjunction on two thirds of the rows, prune its last terms on the rest, drop what it covers."""
    names = sorted(ratios())
    rows = sorted(rows, key=lambda r: r["order"])
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    out: list[list[Term]] = []
    while len(out) < MAX_RULES and sum(r["bad"] for r in grow) >= MIN_COVER:
        terms: list[Term] = []
        inside = grow
        while len(terms) < MAX_TERMS and any(not r["bad"] for r in inside) and (term := _best_term(inside, names)):
            terms.append(term)
            inside = _covers(inside, [term])
        kept = max((terms[:k] for k in range(1, len(terms) + 1)), key=lambda t: (round(_worth(prune, t), 3), len(t) * -1), default=[])
        if not kept or _worth(prune, kept) < PRECISION:
            break
        out.append(kept)
        grow, prune = ([r for r in side if r not in gone] for side, gone in ((grow, _Ids(_covers(grow, kept))), (prune, _Ids(_covers(prune, kept)))))
    return out


class _Ids:
    def __init__(self, rows: list[dict]):
        self.ids = {id(r) for r in rows}

    def __contains__(self, row: dict) -> bool:
        return id(row) in self.ids


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> list[dict]:
    """At most ``sample`` labelled rows as ratios and ``bad`` (label 0); null labels are left out, repeated ids count once."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label_value"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    stats = text_stats(docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id")), "doc_id"))
    rows = stats.join(F.broadcast(some), "doc_id").select("doc_id", *[c.alias(n) for n, c in ratios().items()], (F.col("label_value") == 0).cast("int").alias("bad"), F.xxhash64("doc_id").alias("order"))
    return [r.asDict() for r in rows.dropDuplicates(["doc_id"]).collect()]


def quality_rules(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """One row per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule``.

    ``base_failed``: fewer than 10 words, or more than a fifth of the words in repeated windows. Other documents are
    rejected by the first matching rule of a list learned from labelled statistics (``rule`` counts from 1; 0 is the
    base check, null none). Null and empty texts have zero counts and fail the base check. Without labels, or where no
    rule is good enough, the list is empty. Repeated rows are judged one by one; further columns are ignored.
    """
    rules = learn(labelled(docs, labels, "quality", sample))
    stats = text_stats(docs)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    verdict = F.when(base, 0)
    for number, terms in enumerate(rules, 1):
        both = terms[0].column()
        for t in terms[1:]:
            both = both & t.column()
        verdict = verdict.when(both, number)
    return stats.select("doc_id", *COUNTS[:5], base.alias("base_failed"), verdict.isNull().alias("kept"), verdict.cast("int").alias("rule"))
