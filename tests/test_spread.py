"""Steps that grow with the input: texts made row by row in tasks of few rows, and nothing broadcast by a guess of its size."""

import pytest
from pyspark.sql import functions as F

from provenir import storage
from provenir.operators import catalog, parse
from provenir.plans.all import QUERIES

SF = "/root/testdata/sf0.001"
TEXT = "-- Server: s\n\nbody\n\n-- === Columns ===\n-- [col] B|int\n-- [col] a|\n-- [col] zz|x\n\n-- === Extended Properties ===\n" + "\n".join(
    ("-- [column: A] Description = 1", "-- [object] Description = ", "-- [column: b] Description = 2", "-- [column: a] Other = no", "-- [column: a] MS_Description = 3", "-- [object] Description = own", "no line of ours")
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def objects(spark):
    rows = [("listed", TEXT), ("told", TEXT.replace("-- [col]", "-- [none]")), ("bare", "body"), ("empty", ""), ("null", None)]
    return parse.split_sections(spark.createDataFrame(rows, "id string, text string"))


def test_descriptions_stay_in_their_row(spark):
    got = parse.properties(objects(spark))
    assert "Exchange" not in plan(got)
    assert sorted(tuple(r) for r in got.filter("id = 'listed'").select("column", "description", "ordinal").collect() if r[0]) == [("A", "3", 0), ("b", "2", 2)]
    assert [tuple(r) for r in got.filter("id = 'listed' and `column` is null").select("description", "ordinal").collect()] == [("own", 1)]
    assert {r["id"] for r in got.collect()} == {"listed", "told"}


def test_merged_columns_stay_in_their_row(spark):
    rows = objects(spark)
    got, want = parse.described_columns(rows), parse.merge_columns(parse.columns(rows), parse.properties(rows))
    assert "Exchange" not in plan(got) and got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sorted((r["name"], r["description"]) for r in got.collect() if r["id"] == "listed") == [("B", "2"), ("a", "3"), ("zz", None)]


@pytest.mark.parametrize("name", ["parse_extended_props", "merge_columns", "section_order", "catalog_nodes"])
def test_texts_are_made_in_tasks_of_few_rows(spark, monkeypatch, name):
    monkeypatch.setattr(storage.spread, "__defaults__", (50,))
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    text = plan(QUERIES[name](spark, SF))
    assert f"RoundRobinPartitioning({n // 50 + 1})" in text
    assert "Broadcast" not in text


def test_catalog_without_its_edges_searches_nothing(spark, monkeypatch):
    monkeypatch.setattr(catalog.lineage, "edges", lambda *a: 1 / 0)
    files = spark.createDataFrame([("S/d/Tables/a.sql", "body")], "path string, text string")
    made = catalog.assemble(files)
    assert made.nodes.count() == 1
    with pytest.raises(ZeroDivisionError):
        made.edges  # noqa: B018


def test_larger_sides_are_never_broadcast(spark):
    long = spark.range(500).select(F.col("id"), F.repeat(F.lit("x"), 9).alias("x"))
    assert "BroadcastHashJoin" not in plan(long.join(storage.maybe_broadcast(long, 10), "id"))
    assert "BroadcastHashJoin" in plan(long.join(storage.maybe_broadcast(long, 1_000), "id"))


def test_changes_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr("provenir.plans.queries.TOUCHED_ROWS", 500)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    text = plan(QUERIES["co_change_pairs"](spark, SF))
    assert f", {n // 500 + 1}), REPARTITION_BY_NUM" in text
