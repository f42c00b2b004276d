"""Search by grams against a scan; runs against their points; object and snapshot trees."""

import random

import pytest
from pyspark.sql import functions as F

from provenir.operators import extract, metrics
from provenir.operators.browse import FREE_TEXT, token
from provenir.operators.search import gram_index, search
from provenir.sources.tree import object_tree, publish, snapshot_tree

NODES = "id string, qualifiedName string, server string, database string, schema string, description string"


def some_nodes(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abAB.é_ ") for _ in range(rng.randrange(9)))
    return [(f"n{i}", *(rng.choice([None, word(), "common text"]) for _ in range(5))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_a_scan(spark, seed):
    nodes = spark.createDataFrame(some_nodes(seed), NODES)
    rng = random.Random(seed)
    needles = ["", "a", "ab", "É", ".", "abA", "common", "COMMON TEXT", "nothing here", "mon", "a.b", "%", *("".join(rng.choice("abB.é ") for _ in range(rng.randint(3, 5))) for _ in range(20))]
    frame = spark.createDataFrame([(x,) for x in [*needles, None, "ab"]], "needle string")
    want = sorted((x, r.id) for x in set(needles) for r in nodes.filter(token(None, "contains", [x])).collect())
    assert sorted(map(tuple, search(nodes, frame).collect())) == want
    index = gram_index(nodes)
    assert sorted(map(tuple, search(nodes, frame.filter("length(needle) > 2"), index).collect())) == [w for w in want if len(w[0]) > 2]


def test_search_of_empty_tables_and_fields_across(spark):
    nodes = spark.createDataFrame([("a", "abc", "def", None, None, None)], NODES)
    needle = spark.createDataFrame([("cde",)], "needle string")
    assert search(nodes, needle).count() == 0  # a needle doesn't run over two fields
    assert search(nodes.limit(0), needle).count() == 0 and search(nodes, needle.limit(0)).count() == 0
    assert search(nodes, needle.select(F.lit("EF").alias("needle")), fields=("server",)).count() == 1
    assert set(FREE_TEXT) < set(nodes.columns)


def test_runs_keep_the_line(spark):
    rng = random.Random(3)
    points = [(k, seq, v, v and v + 1) for k in ("a", "b") for seq, v in enumerate(rng.choice([1, 1, 1, 2, None]) for _ in range(60))] + [("c", 5, None, None)]
    found = metrics.runs(spark.createDataFrame(points, "id string, seq long, v long, w long"), "v", "w")
    rows = found.collect()
    back = sorted((r.id, seq, r.v, r.w) for r in rows for seq in range(r.first, r.last + 1))
    assert sorted(map(str, back)) == sorted(map(str, points)) and sum(r.n for r in rows) == len(points) and len(rows) < 100
    kept = metrics.ends(found, "v", "w").collect()
    assert {(r.id, r.seq): r.v for r in kept}.items() <= {(k, s): v for k, s, v, _ in points}.items() and len(kept) < len(points)


def test_trees_of_objects_and_snapshots(spark, tmp_path):
    objects = spark.createDataFrame([("s", "d", "Tables", "dbo", "a:b", "  CREATE\n"), ("s", "d", "Schemas", None, "dbo", None)], "server string, database string, type string, schema string, name string, definition string")
    assert publish(object_tree(objects), str(tmp_path / "t")).added == 2
    assert (tmp_path / "t/s/d/Tables/dbo/a_b.sql").read_text().endswith("-- Object: dbo.a:b\n\nCREATE\n")
    assert (tmp_path / "t/s/d/Schemas/dbo.sql").read_text().endswith("-- Object: dbo\n\n\n")
    shots = objects.select("*", F.lit("2024").alias("capturedAt"), F.when(F.col("schema").isNotNull(), 5).alias("rowCount"))
    assert sorted(map(tuple, snapshot_tree(shots, "capturedAt", "rowCount").collect())) == [("s/d/Schemas/dbo.json", '{"capturedAt":"2024","rowCount":null}'), ("s/d/Tables/dbo/a_b.json", '{"capturedAt":"2024","rowCount":5}')]


def test_catalog_views(spark):
    dbs = spark.createDataFrame([("b", 0), ("a", 0), ("c", 6), ("d", None)], "name string, state int")
    assert [r.name for r in extract.online_databases(dbs).collect()] == ["a", "b"]
    objects = spark.createDataFrame([(1, "P", "x"), (2, "V", "y"), (1, "U", "z"), (9, "P", "lost"), (None, "P", "n")], "schema_id int, code string, object string")
    schemas = spark.createDataFrame([(1, "dbo"), (2, "app")], "schema_id int, schema string")
    assert sorted(map(tuple, extract.module_objects(objects, schemas).select("schema", "object").collect())) == [("app", "y"), ("dbo", "x")]
    rows = spark.createDataFrame([(1, None, 2), (2, None, None), (3, 4, 5)], "id int, a long, b long")
    assert [r.m for r in rows.select("id", metrics.modification_counter(F.col("a"), F.col("b")).alias("m")).orderBy("id").collect()] == [2, None, 9]
