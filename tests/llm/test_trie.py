"""The prefix trie against a plain one, rounds of large groups included."""

import hashlib
import random
import zlib

import pytest

from provenir.llm import trie
from provenir.llm.trie import distinct_sequences, grow, prefix_trie, sequences, shared_heads

SCHEMA = "conv_id long, turn long, role string, text string, id long, depth long, node long"


def plain_trie(convs):
    """convs: {conv_id: [(symbol, bytes)]}; rows as the operator gives them."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def walk(p):
        under = [walk(k) for k in kids.get(p, [])]
        own = (len(members[p]) - 1) * p[-1][1] if p else 0
        leaves, saved = sum(u[0] for u in under) or 1, own + sum(u[1] for u in under)
        ends = sorted(c for c in members[p] if len(convs[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(under), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return leaves, saved

    out = []
    if members:
        walk(())
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("local", [1, 2, 7, 4096])
def test_trie_equals_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(trie, "LOCAL", local)
    rng = random.Random(local)
    convs = {}
    for c in range(120):
        turns = [(rng.randrange(3), 0) for _ in range(rng.randrange(7))]
        if c % 4 == 0:
            turns = [(0, 0), (1, 0), (2, 0), (2, 0), *turns]  # a long common prefix
        convs[c * 3 - 50] = [(s, 5 + s) for s, _ in turns]
    convs[1000] = convs[1001] = [(9, 14)] * 40
    frame = spark.createDataFrame([(c, [s for s, _ in t], [b for _, b in t]) for c, t in convs.items()], "conv_id long, ids array<long>, sizes array<long>")
    assert rows_of(prefix_trie(frame)) == plain_trie(convs)


def test_whole_way_from_turns(spark, monkeypatch):
    monkeypatch.setattr(trie, "SALT_MEMBERS", 4)
    rng = random.Random(4)
    table, rows = {}, []
    for c in range(60):
        turns = [("user", rng.choice(["hi", "hé", ""])), *[(rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", None])) for _ in range(rng.randrange(12))]]
        table[c] = [(r or "", t or "") for r, t in turns]
        numbers = [None, *range(len(turns) - 1)]
        rows += [(c, n, r, t, 7, 7, 7) for n, (r, t) in zip(numbers, turns)]
    rows += [(None, 1, "user", "lost", 1, 1, 1), (997, 5, "user", "a", 1, 1, 1)]  # 997's first conversation is absent
    table[997] = [("user", "a")]
    rng.shuffle(rows)
    rebuilt = {}
    for c, own in table.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = [(x, len(x[1].encode())) for x in table.get(c - c % 5, [])[:h] + own[h:]]
    got = rows_of(prefix_trie(shared_heads(sequences(spark.createDataFrame(rows, SCHEMA)))))
    assert got == plain_trie(rebuilt)


def test_turns_of_one_number_and_repeated_rows_have_one_order(spark):
    rows = [(c, n, "user", t, 0, 0, 0) for c in (1, 2) for n, t in random.Random(c).sample([(1, "a"), (1, "b"), (1, "b"), (2, "c")], 4)]
    got = sequences(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert got[0].ids == got[1].ids and len(got[0].ids) == 4


def test_long_conversation_and_empty_table(spark):
    frame = spark.createDataFrame([(5, list(range(3000)), [1] * 3000), (6, list(range(2999)), [1] * 2999)], "conv_id long, ids array<long>, sizes array<long>")
    got = prefix_trie(frame).collect()
    assert len(got) == 3001 and max(r.saved_tokens for r in got) == 2999
    assert prefix_trie(sequences(spark.createDataFrame([], SCHEMA))).count() == 0
    only = prefix_trie(spark.createDataFrame([(3, [], []), (4, [], [])], frame.schema)).collect()
    assert [tuple(r) for r in only] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,4").hexdigest())]


def test_ends_of_one_sequence_come_from_many_parts(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frame = spark.range(100, -100, -1).selectExpr("id as conv_id", "array(1L, 2L) as ids", "array(3L, 4L) as sizes").repartition(5)
        (one,) = distinct_sequences(frame).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one.n_convs == 200 and one.conv_id == -99 and one.ends_sha256 == hashlib.sha256(",".join(map(str, range(-99, 101))).encode()).hexdigest()


def test_grow_gives_parents_first():
    rows = [([1, 2], [1, 1], 1, 8, "x"), ([1], [1], 2, 3, "y"), ([1, 4, 4], [1, 1, 1], 1, 5, "z")]
    nodes = grow(rows, 1, 0)
    assert [(n[1], n[2], n[3], n[4], n[5], n[6], n[7]) for n in nodes[:1]] == [(3, 1, 0, 4, 2, 2, 3)]
    assert all(n[0] < i for i, n in enumerate(nodes) if i)
