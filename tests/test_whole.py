"""Whole results of graph, grant, size and snapshot queries against brute force, beside their SQL."""

import os
from collections import defaultdict

import pytest

from provenir.functions import scalar
from provenir.operators.graph import reachable
from provenir.operators.metrics import snapshots
from provenir.plans.all import QUERIES
from provenir.plans.queries import graph_of, home_graph

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def graph(spark):
    nodes, edges = graph_of(lambda name: spark.read.parquet(f"{SF}/{name}.parquet"))
    server = {r["id"]: r["server"] for r in nodes.collect()}
    out = defaultdict(set)
    for r in edges.collect():
        out[r["from"]].add(r["to"])
    return server, out


def walked(out, seed, hops, grows=lambda a, b: True):
    """Least hops from the seed, itself included."""
    seen, front = {seed: 0}, [seed]
    for hop in range(1, hops + 1):
        step = {b: a for a in front for b in out[a] if b not in seen}
        seen |= dict.fromkeys(step, hop)
        front = [b for b in step if grows(seed, b)]
    return seen


def reached(server, out, kind):
    same = lambda a, b: server[a] == server[b]
    return sorted((s, i, hop) for s in server if s[0] == kind for i, hop in walked(out, s, 6, same).items() if i != s)


def test_reachable_out_has_all_suppliers(spark, graph):
    server, out = graph
    assert rows(QUERIES["reachable_out"](spark, SF), "seed", "id", "hop") == reached(server, out, "s")


@pytest.mark.parametrize("radius", [1, 2])
def test_neighborhoods_have_all_customers(spark, radius):
    both = defaultdict(set)
    for r in home_graph(lambda name: spark.read.parquet(f"{SF}/{name}.parquet")).collect():
        both[r["from"]].add(r["to"])
        both[r["to"]].add(r["from"])
    want = sorted((s, i) for s in both if s[0] == "c" for i in walked(both, s, radius))
    assert rows(QUERIES[f"neighborhood_{radius}"](spark, SF), "seed", "id") == want


def test_object_neighborhood_has_all_objects(spark, graph):
    server, out = graph
    both = defaultdict(set)
    for a, ends in out.items():
        for b in ends:
            both[a].add(b)
            both[b].add(a)
    assert rows(QUERIES["object_neighborhood"](spark, SF), "seed", "id") == sorted((s, i) for s in server for i in walked(both, s, 1))


def test_object_grants_has_all_objects(spark):
    got = QUERIES["object_grants"](spark, SF)
    line, part = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("lineitem", "part"))
    column = {(r["p_partkey"], r["p_size"] % 8): r["p_name"] for r in part}
    want = []
    for r in line:
        if r["l_returnflag"] != "R":
            k = r["l_linenumber"] - 1
            state = "DENY" if r["l_linestatus"] == "F" else "GRANT"
            want.append((str(r["l_partkey"]), r["l_returnflag"], state, r["l_linestatus"], (column.get((r["l_partkey"], k)) if k else None) or ""))
    assert rows(got.fillna("", ["column"]), "id", "permission", "state", "grantee", "column") == sorted(want)


def fixed(kb):
    """The reference's formatKB: toFixed(1) takes the larger of two equally close values."""
    if kb is None:
        return "-"
    for unit, name in ((1024 * 1024, "GB"), (1024, "MB")):
        if kb >= unit:
            tenths = (20 * kb + unit) // (2 * unit)
            return f"{tenths // 10}.{tenths % 10} {name}"
    return f"{kb} KB"


def test_format_kb_has_all_parts(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").collect()
    kb = {r["p_partkey"]: r["p_partkey"] * r["p_size"] ** 2 if r["p_size"] % 9 else None for r in part}
    assert rows(QUERIES["format_kb"](spark, SF), "id", "size") == sorted((i, fixed(x)) for i, x in kb.items())


def test_format_kb_ties(spark):
    kb = [0, 1023, 1024, 1048575, 1048576, 2**40, *(1024 * k + q for k in (1, 2, 7, 999) for q in (255, 256, 257, 768)), *(2**20 * k + q for k in (1, 2, 999) for q in (2**18 - 1, 2**18, 2**18 + 1, 3 * 2**18))]
    df = spark.createDataFrame([(x,) for x in kb], "kb long")
    assert rows(df.select("kb", scalar.format_kb(df.kb).alias("size")), "kb", "size") == sorted((x, fixed(x)) for x in kb)


def test_reachable_in_has_all_edges(spark, graph):
    server, out = graph
    into = defaultdict(set)
    for a, ends in out.items():
        for b in ends:
            into[b].add(a)
    assert rows(QUERIES["reachable_in"](spark, SF), "seed", "id", "hop") == reached(server, into, "c")


def test_directions_differ_on_directed_edges(spark):
    nodes = spark.createDataFrame([(i, "S", "Tables") for i in "abcd"], "id string, server string, type string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "b")], "from string, to string")
    seeds = nodes.filter("id = 'b'").select("id")
    assert rows(reachable(edges, nodes, seeds), "id", "hop") == [("c", 1)]
    assert rows(reachable(edges, nodes, seeds, incoming=True), "id", "hop") == [("a", 1), ("d", 1)]


def test_metrics_snapshot_has_all_parts(spark):
    n = defaultdict(int)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_linenumber").collect():
        n[tuple(r)] += 1
    part = spark.read.parquet(f"{SF}/part.parquet").collect()
    got = rows(QUERIES["metrics_snapshot"](spark, SF), "id", "row_count", "n_indexes", "n_statistics")
    assert got == sorted((r["p_partkey"], r["p_size"], n[r["p_partkey"], 1], n[r["p_partkey"], 2]) for r in part)


def test_snapshots_need_a_volume_row(spark):
    volume = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id long, row_count long")
    indexes = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (9, "c", 7)], "id long, name string, seeks long")
    statistics = spark.createDataFrame([(3, "s", None), (9, "t", 1)], "id long, name string, modifications long")
    got = {r["id"]: (r["row_count"], [tuple(x) for x in r["indexes"]], [tuple(x) for x in r["statistics"]]) for r in snapshots(volume, indexes, statistics).collect()}
    assert got == {1: (10, [("a", 5), ("b", 6)], []), 2: (20, [], []), 3: (30, [], [("s", None)])}
