"""Decontamination against alignment of all pairs: recall by the length of items and the kind of edits."""

import random

import pytest

from provenir.llm.decontaminate import contaminated

SCHEMA = "doc_id long, text string, item_id long, score double, gram long, th long"


def score(item, text):
    """The best local alignment of words, plainly: 2 a match, -1 a mismatch or a gap."""
    above, best = [0] * (len(text) + 1), 0
    for a in item:
        now = [0]
        for j, b in enumerate(text):
            now.append(max(0, above[j] + (2 if a == b else -1), above[j + 1] - 1, now[j] - 1))
        best, above = max(best, *now), now
    return best


def edited(words, rng, kind, share, vocabulary):
    out = list(words)
    for _ in range(round(len(words) * share)):
        at = rng.randrange(len(out))
        how = rng.choice(["sub", "ins", "del"]) if kind == "mixed" else kind
        if how == "sub":
            out[at] = rng.choice(vocabulary)
        elif how == "ins":
            out.insert(at, rng.choice(vocabulary))
        elif len(out) > 1:
            del out[at]
    return out


def test_recall_by_length_against_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 6))) for _ in range(1500)]
    lengths = (4, 6, 8, 12, 16, 20, 25, 40, 60)
    items, docs = [], []
    for n in lengths:
        for _ in range(12):
            item = [rng.choice(vocabulary) for _ in range(n)]
            items.append((len(items), item))
            for kind in ("sub", "ins", "del", "mixed"):
                for share in (0.1, 0.2, 0.3):
                    around = [[rng.choice(vocabulary) for _ in range(rng.randrange(30))] for _ in range(2)]
                    docs.append((len(docs), len(items) - 1, [*around[0], *edited(item, rng, kind, share, vocabulary), *around[1]]))
    docs += [(len(docs) + i, None, [rng.choice(vocabulary) for _ in range(80)]) for i in range(60)]
    frame = spark.createDataFrame([(d, " ".join(w), 9, 9.0, 9, 9) for d, _, w in docs], SCHEMA)
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(frame, benchmark).collect()}
    by_length = {n: [0, 0] for n in lengths}
    for d, i, w in docs:
        if i is not None and (s := score(items[i][1], w)) >= len(items[i][1]):
            by_length[len(items[i][1])][1] += 1
            if (d, i) in got:
                by_length[len(items[i][1])][0] += 1
                assert got[d, i] == pytest.approx(s / (2 * len(items[i][1])))
    print({n: f"{a} of {b}" for n, (a, b) in by_length.items()})
    assert all(b > 60 and a >= 0.95 * b for a, b in by_length.values()), by_length
    for d, i in got:  # nothing that isn't there
        assert score(items[i][1], docs[d][2]) >= len(items[i][1])


def test_items_of_one_and_two_words(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "x alpha beta y"), (3, "alpha x beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Alpha"), (2, "alpha, BETA"), (3, None), (4, "")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, items).collect()) == [(1, 1), (2, 2)]
