"""SimHash: hashes, fingerprints and components against brute force, split keys and balls included."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from provenir.llm import simhash
from provenir.llm.simhash import fingerprints, forest, near_fingerprints, simhash_duplicates
from provenir.llm.xxh64 import xxh64

SCHEMA = "doc_id long, text string, lang string, fp long, node long, slot int, component_id long"


def plain_fingerprint(text, width=3):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    grams = [w[i : i + width] for i in range(len(w) - width + 1)] if len(w) >= width else [w] if w else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, distance=3):
    up = list(range(len(prints)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance or (ids[i] == ids[j]):
                up[find(i)] = find(j)
    least = {}
    for i in range(len(prints)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(prints))]


def test_xxh64_equals_the_library():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 5000, dtype=np.uint8)
    size = np.concatenate([np.arange(0, 300), rng.integers(0, 1000, 100)])
    start = rng.integers(0, len(raw) - size)
    got = xxh64(raw, start, size, 42)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(raw[a : a + n].tobytes(), 42) for a, n in zip(start, size)]


def texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    out = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 300))) for _ in range(60)]
    for i in range(60):
        w = out[i % 20].split()
        w[rng.randrange(len(w))] = "Changed"
        out.append("\t ".join(w))
    return [*out, "", None, "  \n", "one", "One TWO", "é ü Ä", "x" * 2000 + " y z", out[0].upper(), out[0], "a b c"]


def test_fingerprints_equal_brute_force(monkeypatch):
    every = texts()
    want = [plain_fingerprint(t) for t in every]
    assert fingerprints(pa.array(every)).tolist() == want
    for segment in (7, 64, 1000):  # long texts are read in stretches
        monkeypatch.setattr(simhash, "SEGMENT", segment)
        assert [int(fingerprints(pa.array([t], pa.string()))[0]) for t in every] == want


@pytest.mark.parametrize("limits", [(4096, 32, 1 << 25), (3, 1, 1 << 25), (3, 1, 1)])
def test_links_equal_brute_force(spark, monkeypatch, limits):
    for name, value in zip(("HOT", "DENSE", "PAIRS"), limits):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(5)
    some = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(400):
        x = rng.choice(some)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        some.append(x)
    some += [some[0] ^ x for x in range(0, 512, 3)]  # many in one key
    some = sorted(set(some) | {0, 1, (1 << 64) - 1, (1 << 63) + 7})
    rows = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(some)]
    found = near_fingerprints(spark.createDataFrame(rows, "fp long, node long")).collect()
    assert all((some[r.a] ^ some[r.b]).bit_count() > 0 for r in found)
    up = list(range(len(some)))
    for _ in range(len(some)):
        for r in found:
            up[r.a] = up[r.b] = min(up[r.a], up[r.b])
    assert up == plain_components(some, list(range(len(some))))


def test_documents_equal_brute_force(spark):
    every = texts()
    ids = [*range(100, 100 + len(every))]
    ids[5] = ids[50]  # one doc_id with two texts
    rows = [(i, t, "en", 1, 2, 3, 4) for i, t in zip(ids, every)]
    rows += [(None, every[0], "en", 1, 2, 3, 4), (100, every[0], None, None, None, None, None)]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash_duplicates(spark.createDataFrame(rows, SCHEMA)).collect() if r.doc_id is not None)
    prints = [plain_fingerprint(t) for t in [*every, every[0]]]
    want = plain_components(prints, [*ids, 100])
    assert got == sorted(zip([*ids, 100], (f"{p:016x}" for p in prints), want))
    null = [r for r in simhash_duplicates(spark.createDataFrame(rows, SCHEMA)).collect() if r.doc_id is None]
    assert len(null) == 1 and null[0].component_id is None


def test_many_copies_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SALT_MEMBERS", 3)
    rows = [(i, "same words here again" if i % 2 else f"text number {i} is its own and long enough", None, None, None, None, None) for i in range(20)]
    got = {r.doc_id: r.component_id for r in simhash_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 20 and {got[i] for i in range(1, 20, 2)} == {1}
    assert simhash_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_forest_keeps_components():
    a, b = forest(np.array([5, 9, 7, 1]), np.array([9, 7, 3, 2]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(2, 1), (5, 3), (7, 3), (9, 3)]
