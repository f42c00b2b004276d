"""Repeated word runs by seed and extend."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from provenir.llm.repeats import BUCKET, MOST, Tokens, remove_repeats, windows


def extend(words: np.ndarray, start: np.ndarray, step: int, have: np.ndarray, depth: int) -> Callable[[int], np.ndarray]:
    """Extend all seeds word by word; for a depth, numbers that seeds share which agree on so many words.

    Each step parts the seeds that agreed so far by their next word; one that has no next word agrees with none from there on.
    """
    n = len(start)
    agree = [np.zeros(n, np.int64)]
    wide = int(words.max(initial=0)) + n + 2
    for d in range(depth):
        at = np.clip(start + step * d, 0, max(len(words) - 1, 0))
        word = np.where(have > d, words[at] + n, np.arange(n))
        agree.append(np.unique(agree[-1] * wide + word, return_inverse=True)[1])
    return lambda d: agree[d]


def resolve(raw: np.ndarray, offsets: np.ndarray, off: np.ndarray, t: Tokens) -> tuple[np.ndarray, ...]:
    """Windows of a bucket's cells: seeds are extended right from the anchor's first word, then left of it."""
    view, known, words, size = raw.tobytes(), {}, [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        own = view[a:b].split()
        size.append(len(own))
        words += [known.setdefault(w, len(known)) for w in own]
    size = np.array(size, np.int64)
    anchor, right = np.cumsum(size) - size + off, size - off
    number = np.array(words, np.int64)
    return windows(extend(number, anchor, 1, right, t.length), extend(number, anchor - 1, -1, off, t.length - t.gram), off, right, t)


def _gram(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).to_numpy()


def _by_anchor(contexts: DataFrame) -> DataFrame:
    """Occurrences of one anchor meet in one task."""
    return contexts.repartition("gram").sortWithinPartitions("gram", "cell")


def seed_and_extend_dedup(docs: DataFrame, *, length: int = 35, bucket: int = BUCKET, most: int = MOST, texts: bool = False) -> DataFrame:
    """Remove words covered by a run of ``length`` words that starts elsewhere too; columns and odd inputs as in :func:`remove_repeats`.

    Documents are joined on winnowed anchors of a few words. The occurrences of an anchor are extended right and left,
    word by word, all together instead of pair by pair; runs of at least ``length`` words that two of them share are kept
    as maximal repeats.
    """
    t = Tokens(length, max(1, min(8, length // 4)), words=True)
    return remove_repeats(docs, t, resolve, _gram, _by_anchor, bucket=bucket, most=most, texts=texts)


def oracle(length: int) -> str:
    """Windows as lists of words, counted over all documents."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, word, i FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS a FROM d), unnest(a) WITH ORDINALITY AS u(word, i)),
l AS (SELECT r, word, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING) AS g FROM w),
m AS (SELECT r, word, i, len(g) = {length} AND count(*) OVER (PARTITION BY g) > 1 AS again FROM l),
c AS (SELECT r, word, i, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS gone FROM m),
k AS (SELECT r, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""
