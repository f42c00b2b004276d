"""Walks and histories whose cost follows their rows: seeds of one hub share rows, dead ends end a walk, only fetched versions are parsed."""

from provenir.operators import graph, history, parse
from provenir.operators.graph import neighborhood, reachable
from provenir.plans.all import QUERIES


def test_seeds_of_a_hub_share_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 100)
    cuts = {}
    monkeypatch.setattr(graph, "cut", lambda df, name, f=graph.cut: cuts.setdefault(name, []).append(f(df, name)) or cuts[name][-1])
    edges = spark.range(1280).selectExpr("concat('c', id) AS `from`", "concat('h', pmod(id, 5)) AS `to`")
    roots = edges.selectExpr("`from` AS id").repartition(7)
    got = neighborhood(edges, roots, 2)
    assert got.count() == got.distinct().count() == 1280 + 1280 * 256
    hubs = cuts["front"][1].filter("startswith(id, 'h')")
    assert hubs.count() <= 5 * 6  # 256 seeds a hub are four rows, or six where a block holds two hubs; unordered they were 100


def test_a_walk_ends_at_dead_ends(spark, monkeypatch):
    names = []
    monkeypatch.setattr(graph, "cut", lambda df, name, f=graph.cut: names.append(name) or f(df, name))
    nodes = spark.createDataFrame([(x, "s") for x in "abc"], "id string, server string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "`from` string, `to` string")
    got = reachable(edges, nodes, nodes.filter("id = 'a'").select("id"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "b", 1), ("a", "c", 2)]
    assert names.count("front") == 3  # the seeds and two hops, none that looks for moves from c


def test_only_fetched_versions_are_parsed(spark):
    versions = spark.createDataFrame([(i, r, f"{i}{r}", "d", "m") for i in "ab" for r in (1, 2)], "id string, rank long, sha string, date string, message string")
    blobs = versions.selectExpr("id", "sha", "concat('-- head\n\nv', sha) AS text")
    seen = []
    got = history.object_history(versions, blobs, lambda df, *keep: seen.append(df.count()) or parse.split_sections(df, *keep), 3)
    assert seen == [3]
    assert {r["id"]: [(v["sha"], v["ddl"]) for v in r["history"]] for r in got.collect()} == {"a": [("a1", "va1"), ("a2", "va2")], "b": [("b1", "vb1"), ("b2", None)]}


def test_histories_have_no_cut(spark):
    touched = spark.range(1, 41).selectExpr("concat('s', id) AS sha", "id AS date", "'a' AS id").unionByName(spark.range(1, 1701).selectExpr("'s0' AS sha", "0L AS date", "concat('n', id) AS id"))
    blobs = touched.selectExpr("id", "sha", "concat('-- head\n\nv', sha) AS text")
    rows = history.object_versions(history.ranked(touched), blobs, parse.split_sections)
    assert rows.count() == rows.filter("ddl = concat('v', sha)").count() == 1740
    assert [r["sha"] for r in rows.filter("id = 'a'").orderBy("rank").collect()] == [f"s{i}" for i in range(40, 0, -1)]
    versions = history.version_history(touched, touched.select("sha").distinct().selectExpr("sha", "'m' AS message"), None)
    got = {r["id"]: r["history"] for r in history.object_history(versions, blobs, parse.split_sections).collect()}
    assert len(got) == 1701 and all(v["ddl"] == f"v{v['sha']}" for h in got.values() for v in h)
    assert [v["sha"] for v in got["a"]] == [f"s{i}" for i in range(40, 0, -1)]


def test_object_history_has_all_objects_and_versions(spark):
    sf = "/root/testdata/sf0.001"
    pairs = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_orderkey").distinct()
    got = QUERIES["object_history"](spark, sf)
    assert got.select("id", "sha").distinct().count() == got.count() == pairs.count() > 1500
    assert got.filter("ddl is not null").count() == pairs.filter("l_orderkey % 2 = 0").count()
