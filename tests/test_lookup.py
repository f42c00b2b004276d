"""Aliases by words against aliases by patterns; pruned and salted name joins against plain ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from provenir.operators import lineage, lookup
from provenir.operators.lineage import STOP, _aliases_by_pattern, aliases, bare_edges, qualified_edges
from provenir.operators.lookup import prune, with_name

NODES = "id string, server string, database string, schema string, name string, ddl string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def some_nodes(seed, n=60):
    rng = random.Random(seed)
    names = ["Orders", "CustomerOrders", "o", "AS", "S", "Größe", "x$y", "Order Details", "a-b", "dbo", "Users", "ers", "ORDERS", "big_table"]
    bits = [*names, "[Orders]", "dbo.Orders", "[dbo].[Orders]", "as", "AS", "where", "ON", "[o]", "u", "(", ",", ".", "\n", "\t", "1x", "$", "#t", "]", "["]
    out = []
    for i in range(n):
        ddl = "".join(rng.choice(bits) + rng.choice([" ", " ", "  ", "\n", ""]) for _ in range(rng.randrange(40)))
        out.append((f"n{i}", "s", "d", rng.choice(["dbo", None, "a b"]), names[i % len(names)], ddl if i % 9 else None))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_aliases_by_words_equal_patterns(spark, seed):
    nodes = spark.createDataFrame(some_nodes(seed), NODES)
    found = nodes.select(F.col("id").alias("from")).crossJoin(nodes.select(F.col("id").alias("to"))).filter("`from` <> `to`")
    own = found.join(nodes.select(F.col("id").alias("to"), F.lower("name").alias("alias")), "to").select("from", "to", "alias")
    want = own.unionByName(_aliases_by_pattern(found, nodes).filter(~F.upper("alias").isin(*STOP))).distinct()
    got, want = rows(aliases(found, nodes)), rows(want)
    assert got == want and len(want) > 60 * 59


def test_a_word_without_end_is_read_once(spark):
    ddl = "x" * 300_000 + " Orders o " + "y" * 300_000
    nodes = spark.createDataFrame([("a", "s", "d", None, "a", ddl), ("t", "s", "d", None, "Orders", "")], NODES)
    found = spark.createDataFrame([("a", "t")], "`from` string, `to` string")
    assert rows(aliases(found, nodes)) == [("a", "t", "o"), ("a", "t", "orders")]


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_pruned_rows_hold_all_names(spark, monkeypatch, bits):
    names = spark.range(500).select(F.concat(F.lit("n"), F.col("id")).alias("k"), (F.col("id") % 7).alias("g"))
    wanted = spark.range(3000).select(F.concat(F.lit("n"), F.col("id")).alias("k"), (F.col("id") % 7).alias("g"), "id").unionByName(spark.createDataFrame([(None, 1, 5)], "k string, g long, id long"))
    plain = rows(wanted.join(names, ["k", "g"]).select("id"))
    assert rows(prune(wanted, (names, ["k", "g"])).select("id")) == plain  # broadcast
    monkeypatch.setattr(lookup, "small", lambda df: False)
    monkeypatch.setattr(lookup, "MOST_BITS", bits)
    got = prune(wanted, (names, ["k", "g"]))
    assert set(plain) <= set(rows(got.select("id")))
    assert rows(got.join(names, ["k", "g"]).select("id")) == plain
    assert got.count() < 600 if bits > 64 else got.count() > 2000  # a full filter prunes nothing
    none = prune(wanted, (names.limit(0), ["k", "g"]))
    assert none.count() == 0


def test_rows_of_either_scope_stay(spark, monkeypatch):
    left = spark.range(300).select(F.concat(F.lit("k"), F.col("id")).alias("k"), (F.col("id") % 3).alias("g"))
    one, two = left.filter("g = 1").limit(20), left.filter("g = 2").select("k").limit(20)
    got = {r.k for r in prune(left, (one, ["k", "g"]), (two, ["k"])).collect()}
    assert {r.k for r in one.collect()} | {r.k for r in two.collect()} <= got and len(got) < 80


def test_frequent_names_are_dealt(spark, monkeypatch):
    left = spark.range(400).select(F.when(F.col("id") < 200, "hot").when(F.col("id") < 300, "gone").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    names = spark.createDataFrame([("hot", 1), ("k301", 2), ("other", 3)], "k string, v long")
    want = sorted(map(str, rows(left.join(names, "k", "left"))))
    assert sorted(map(str, rows(with_name(left, names, ["k"], "id")))) == want
    monkeypatch.setattr(lookup, "small", lambda df: False)
    assert sorted(map(str, rows(with_name(left, names, ["k"], "id")))) == want


@pytest.mark.parametrize("few", [True, False])
def test_edges_do_not_depend_on_the_way(spark, monkeypatch, few):
    nodes = spark.createDataFrame(some_nodes(7, 200), NODES).withColumn("name", F.concat("name", F.col("id")))
    texts = nodes.withColumn("ddl", F.concat_ws(" ", "ddl", F.lit("dbo.Ordersn14 [dbo].[usersn10] Größen5 big_tablen13"), "ddl"))
    want = rows(bare_edges(texts)), rows(qualified_edges(texts))
    for module in (lookup, lineage):
        monkeypatch.setattr(module, "small", lambda df: few)
    assert (rows(bare_edges(texts)), rows(qualified_edges(texts))) == want
    assert want[0] and want[1]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("found", [bare_edges, lineage.edges])
def test_edges_are_made_distinct_in_tasks_of_few_rows(spark, monkeypatch, found):
    monkeypatch.setattr(lineage, "EDGE_ROWS", 10, raising=False)
    said = [(f"p{i}", "s", "d", "dbo", f"proc{i}", "dbo.Orders JOIN dbo.Users, Orders, Total") for i in range(50)]
    nodes = spark.createDataFrame([("o", "s", "d", "dbo", "Orders", ""), ("u", "s", "d", "dbo", "Users", ""), ("o", "s", "d", "dbo", "Total", ""), *said], NODES)
    got = found(nodes)
    assert rows(got) == sorted((f"p{i}", to) for i in range(50) for to in "ou")  # o has two names
    n = 250 if found is lineage.edges else 150
    assert f"hashpartitioning(from, to, {n // 10 + 1}), REPARTITION_BY_NUM" in re.sub(r"#\d+", "", plan(got))
    assert "Generate" not in plan(got)  # no task that reads definitions makes edges distinct


def test_many_names_are_joined_in_tasks_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(lookup, "small", lambda df: False)
    monkeypatch.setattr(lookup, "JOIN_ROWS", 100, raising=False)
    left = spark.range(4000).select((F.col("id") % 3000).cast("string").alias("k"), "id")
    names = spark.range(50).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    got = with_name(left, names, ["k"], "id")
    assert "BroadcastHashJoin" not in plan(got)  # Spark would broadcast by the names' size before they are salted
    assert re.sub(r"#\d+L?", "", plan(got)).count("hashpartitioning(k, salt, 41), REPARTITION_BY_NUM") == 2
    assert sorted(map(str, rows(got))) == sorted(map(str, rows(left.join(names, "k", "left").select("k", "id", "v"))))
