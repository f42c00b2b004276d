"""Walks with shared bits and dealt hubs against plain ones: cycles, hop bounds, foreign and unknown nodes."""

import random

import pytest

from provenir.operators import graph
from provenir.operators.graph import neighborhood, reachable


def plain(out, seed, hops, grows):
    seen, front = {seed: 0}, [seed]
    for hop in range(1, hops + 1):
        front = sorted({b for a in front for b in out.get(a, ()) if b not in seen})
        seen |= dict.fromkeys(front, hop)
        front = [b for b in front if grows(b)]
    return seen


def made(seed):
    """A cyclic graph of two servers with a hub, a long ring, unknown ids, self-loops and repeated edges."""
    rng = random.Random(seed)
    nodes = [(f"n{i}", rng.choice(["a", "a", "b", None]), "Tables") for i in range(150)]
    edges = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(140)]
    edges += [("n0", f"n{i}") for i in range(1, 60)] + [(f"n{i}", "n0") for i in range(40, 100)]
    edges += [(f"n{i}", f"n{(i + 1) % 150}") for i in range(100, 150)]
    edges += [("n5", "ghost"), ("ghost", "n6"), ("n7", "n7"), ("n1", "n2"), ("n1", "n2")]
    return nodes, edges


@pytest.mark.parametrize("heavy", [10_000, 7])
@pytest.mark.parametrize("incoming", [False, True])
def test_reachable_equals_plain_walks(spark, monkeypatch, heavy, incoming):
    monkeypatch.setattr(graph, "HEAVY", heavy)
    nodes, edges = made(heavy)
    server = {n: s for n, s, _ in nodes}
    out = {}
    for a, b in edges:
        a, b = (b, a) if incoming else (a, b)
        out.setdefault(a, set()).add(b)
    frame = spark.createDataFrame(nodes, "id string, server string, type string")
    seeds = spark.createDataFrame([(n,) for n, _, _ in nodes] + [("nobody",), ("n3",)], "id string").repartition(3)
    got = reachable(spark.createDataFrame(edges, "`from` string, `to` string"), frame, seeds, incoming=incoming, hops=4)
    assert got.columns == ["seed", "id", "hop"]
    want = sorted((s, i, h) for s in server for i, h in plain(out, s, 4, lambda b, s=s: server.get(b) is not None and server[b] == server[s]).items() if i != s)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert max(h for _, _, h in want) == 4


@pytest.mark.parametrize("heavy", [10_000, 5])
def test_neighborhood_equals_plain_walks(spark, monkeypatch, heavy):
    monkeypatch.setattr(graph, "HEAVY", heavy)
    nodes, edges = made(3)
    both = {}
    for a, b in edges:
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)
    roots = [n for n, _, _ in nodes[::2]] + ["alone"]
    got = neighborhood(spark.createDataFrame(edges, "`from` string, `to` string"), spark.createDataFrame([(r,) for r in roots], "id string"), 3)
    want = sorted((r, i) for r in roots for i in plain(both, r, 3, lambda b: True))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_no_edges_no_seeds_and_no_hops(spark):
    none = spark.createDataFrame([], "`from` string, `to` string")
    nodes = spark.createDataFrame([("a", "s", "Tables")], "id string, server string, type string")
    assert reachable(none, nodes, nodes.select("id")).count() == 0
    assert reachable(none, nodes, nodes.select("id").limit(0)).count() == 0
    assert [tuple(r) for r in neighborhood(none, nodes.select("id"), 0).collect()] == [("a", "a")]


@pytest.mark.parametrize("hub,hubs,radius,sent", [(7, 62, 2, False), (7, 2, 3, True), (2, 62, 4, False), (20, 62, 2, True)])
def test_neighborhoods_by_blocks_equal_plain_walks(spark, monkeypatch, hub, hubs, radius, sent):
    monkeypatch.setattr(graph, "HUB", hub)
    monkeypatch.setattr(graph, "HUBS", hubs)
    monkeypatch.setattr(graph, "BLOCK_BITS", 2)
    monkeypatch.setattr(graph, "PAIRS", 1 << 13)
    if sent:
        monkeypatch.setattr(graph, "small", lambda df: False)
    nodes, edges = made(hub)
    edges += [(f"n{a}", f"n{b}") for a in (100, 120) for b in range(0, 90, 4)] + [("n50", f"x{i}") for i in range(25)]
    both = {}
    for a, b in edges:
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)
    frame = spark.createDataFrame(edges, "`from` string, `to` string")
    for roots in ([n for n, _, _ in nodes[1::2]] + ["alone", "n1", "n3", "n0"], ["x1", "x2", "alone"]):
        got = neighborhood(frame, spark.createDataFrame([(r,) for r in roots], "id string"), radius)
        want = sorted((r, i) for r in set(roots) for i in plain(both, r, radius, lambda b: True))
        assert sorted(tuple(r) for r in got.collect()) == want


def test_pairs_of_a_hub_are_not_moved(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(graph, "HUB", 100)
    kept = []
    monkeypatch.setattr(graph, "cut", lambda df, name, f=graph.cut: kept.append(f(df, name)) or kept[-1])
    edges = spark.range(3000).selectExpr("concat('c', id) AS `from`", "concat('h', pmod(id, 2)) AS `to`")
    got = neighborhood(edges, edges.selectExpr("`from` AS id"), 3)
    assert got.count() == 3000 + 3000 * 1500
    assert max(df.count() for df in kept) <= 6000  # moves; no frontier holds blocks by nodes
