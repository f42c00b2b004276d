"""JDBC scans on an embedded database: in parts, with session settings, in sets that shrink where an object fails."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from provenir.sources import files, jdbc

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def url(spark):
    at = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = spark.range(100).select(F.col("id").alias("n"), F.concat(F.lit("o"), F.lpad("id", 3, "0")).alias("name"), F.when(F.col("id").isin(17, 61), "bad").otherwise(F.col("id").cast("string")).alias("code"))
    rows = rows.unionByName(spark.createDataFrame([(None, "p", "5"), (None, "it's", "6")], "n long, name string, code string"))
    rows.write.jdbc(at, "APP.OBJECTS", properties=DRIVER | {"createTableColumnTypes": "name varchar(20), code varchar(20)"})
    rows.limit(3).write.jdbc(at, "OTHER.OBJECTS", properties=DRIVER | {"createTableColumnTypes": "name varchar(20), code varchar(20)"})
    spark.range(0).write.jdbc(at, "APP.NOTHING", properties=DRIVER)
    return at


def test_round_trip_in_parts(spark, url):
    df = jdbc.read_in_parts(spark, url, 'SELECT "n", "name" FROM APP.OBJECTS WHERE "name" <> :skip', '"n"', {"skip": "o099"}, parts=7, **DRIVER)
    assert df.rdd.getNumPartitions() == 7
    assert sorted((r.n is None, r.n or 0, r.name) for r in df.collect()) == sorted([(False, i, f"o{i:03d}") for i in range(99)] + [(True, 0, "p"), (True, 0, "it's")])
    assert sum(r[1] > 0 for r in df.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()) == 7
    none = jdbc.read_in_parts(spark, url, 'SELECT * FROM APP.NOTHING', '"id"', parts=4, **DRIVER)
    assert none.count() == 0 and none.columns == ["id"]


def test_session_statement_comes_before_each_query(spark, url):
    query = 'SELECT COUNT(*) AS "c" FROM OBJECTS'
    assert jdbc.read(spark, url, query, session="SET SCHEMA APP", **DRIVER).first()[0] == 102
    assert jdbc.read(spark, url, query, {"s": "OTHER"}, session="SET SCHEMA OTHER", **DRIVER).first()[0] == 3


def test_failing_objects_are_noted_and_the_others_read(spark, url):
    failures = []
    query = 'SELECT "name", CAST("code" AS INTEGER) AS "ddl" FROM APP.OBJECTS'
    df = jdbc.read_in_sets(spark, url, query, '"name"', "name string, ddl string", failures, keys='SELECT "name" FROM APP.OBJECTS', **DRIVER)
    assert sorted(n for n, _ in failures) == ["o017", "o061"] and all(reason for _, reason in failures)
    assert {r.name: r.ddl for r in df.collect()} == {f"o{i:03d}": str(i) for i in range(100) if i not in (17, 61)} | {"p": "5", "it's": "6"}
    fine = []
    assert jdbc.read_in_sets(spark, url, query + ' WHERE "n" > 90', '"name"', "name string, ddl long", fine, **DRIVER).count() == 9 and not fine


def test_values_in_queries():
    query = "SELECT ':a' FROM t WHERE a = :a AND b IN :list AND c = :ab AND d::x"
    assert jdbc.bound(query, {"a": "it's", "ab": None, "list": [1, "x"], "x": 5}) == "SELECT ':a' FROM t WHERE a = 'it''s' AND b IN (1, 'x') AND c = NULL AND d::x"
    assert jdbc.literal(datetime.date(2024, 1, 2)) == "DATE '2024-01-02'" and jdbc.literal(True) == "TRUE" and jdbc.literal([]) == "(NULL)"
    assert jdbc.literal(datetime.datetime(2024, 1, 2, 3, 4, 5)) == "TIMESTAMP '2024-01-02 03:04:05.000000'"


def test_ranges_hold_every_number_once():
    for low, high, parts in ((0, 0, 4), (-5, 5, 3), (1, 100, 7), (3, 4, 9)):
        where = jdbc.ranges(low, high, parts, "n")
        for n in range(low - 2, high + 3):
            assert sum(eval(w.replace("AND", "and").replace(" OR n IS NULL", "").replace("1 = 1", "True"), {"n": n}) for w in where) == 1


def test_oracle_definitions_and_links_use_the_session(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(jdbc, "read", lambda *a, **k: seen.append((a, k)))
    monkeypatch.setattr(jdbc, "read_in_sets", lambda *a, **k: seen.append((a, k)))
    files.database_links(spark, "jdbc:oracle:x", user="u")
    files.oracle_definitions(spark, "jdbc:oracle:x", "SCOTT", "PACKAGE BODY", [])
    assert "all_db_links" in seen[0][0][2] and seen[0][1]["session"].startswith("BEGIN DBMS_METADATA")
    assert "GET_DDL" in seen[1][0][2] and seen[1][1]["session"] == files.oracle_session()
