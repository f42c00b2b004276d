"""As-of joins, hierarchy levels, bucketed retention and run outcomes."""

import collections
import datetime
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from provenir.operators.asof import as_of
from provenir.operators.browse import children, tree_counts, tree_levels
from provenir.operators.metrics import retain
from provenir.sources.outcome import extract_all, rejects, write_accepted
from provenir.streaming.metrics import fold, history

# -- as-of -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_as_of_equals_a_plain_search(spark, width):
    rng = random.Random(width)
    versions = [(rng.choice(["a", "b", "hot", None]), rng.choice([None, *range(-30, 60)]), f"s{i}") for i in range(150)]
    versions += versions[:10]
    instants = [(rng.choice(["a", "b", "hot", "none", None]), rng.choice([None, *range(-40, 70)]), i) for i in range(300)]
    got = as_of(spark.createDataFrame(versions, "id string, date long, sha string"), spark.createDataFrame(instants, "id string, at long, n long"), width=width)
    assert got.columns == ["id", "at", "n", "date", "sha"]

    def best(i, at):
        some = [(d, s) for v, d, s in versions if v == i and d is not None and at is not None and d <= at and i is not None]
        return max(some, default=(None, None))

    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, at, n, *best(i, at))) for i, at, n in instants)


def test_as_of_with_timestamps_and_empty_tables(spark):
    t = lambda d, h: datetime.datetime(2024, 1, d, h)
    versions = spark.createDataFrame([("a", t(1, 5), "x"), ("a", t(9, 0), "y")], "id string, date timestamp_ntz, sha string")
    instants = spark.createDataFrame([("a", t(1, 4)), ("a", t(1, 5)), ("a", t(8, 23)), ("a", t(9, 0)), ("a", t(31, 0))], "id string, at timestamp_ntz")
    for width in (3600, 86400, 10**9):
        assert [r.sha for r in as_of(versions, instants, width=width).orderBy("at").collect()] == [None, "x", "x", "y", "y"]
    assert as_of(versions, instants.limit(0)).count() == 0
    assert [r.sha for r in as_of(versions.limit(0), instants).collect()] == [None] * 5


# -- levels ----------------------------------------------------------------------------------------------------------


def test_levels_hold_what_nested_groups_hold(spark):
    rows = [("s", "d", None, "T", 1), ("s", "d", "x/y", "T", 1), ("s", "d", "x!", "V", 1), ("s", "e", None, None, 1), ("t", None, None, "T", 1), ("s", "d", "x/y", "T", 1), ("s", "d=", "", "T", 1)]
    nodes = spark.createDataFrame(rows, "server string, database string, schema string, type string, level long")
    levels = tree_levels(nodes).collect()
    keys = ("server", "database", "schema", "type")
    for depth in range(5):
        want = collections.Counter(r[:depth] + (None,) * (4 - depth) for r in rows)
        assert {tuple(r[k] for k in keys): r.n for r in levels if r.level == depth} == dict(want)
    assert len({r.path for r in levels}) == len(levels)
    assert {tuple(r[k] for k in keys): r.n for r in levels if r.level == 4} == {tuple(r[k] for k in keys): r.n for r in tree_counts(nodes).collect()}
    frame = tree_levels(nodes)
    for node in levels:
        below = {r.path for r in children(frame, node.path).collect()}
        assert below == {r.path for r in levels if r.level == node.level + 1 and r.path.rsplit("/", 1)[0] == node.path}


# -- retention -------------------------------------------------------------------------------------------------------

SNAPSHOT = "id string, seq long, size long"


def test_fold_equals_retention_over_everything(spark, tmp_path):
    rng = random.Random(2)
    run = fold(str(tmp_path), keep=3, buckets=8)
    every = spark.createDataFrame([], SNAPSHOT)
    for number in range(5):
        rows = [(f"o{rng.randrange(12)}", number * 100 + i, rng.randrange(99)) for i in range(rng.randrange(1, 15))]
        batch = spark.createDataFrame([*rows, (None, 1, 1)], SNAPSHOT)
        run(batch, number)
        if number % 2:  # a batch that is repeated changes nothing
            run(batch, number)
        every = spark.createDataFrame([*map(tuple, every.collect()), *rows], SNAPSHOT)
        want = retain(every.limit(0), every, 3)
        got = history(spark, str(tmp_path), every.schema)
        assert sorted(map(tuple, got.select("id", "seq", "size").collect())) == sorted(map(tuple, want.collect()))
    kept = glob.glob(f"{tmp_path}/data/*/bucket=*")
    assert len(glob.glob(f"{tmp_path}/manifests/*.json")) == 2 and len(kept) <= 2 * 8


def test_batch_writes_its_buckets_only_and_a_half_written_one_is_not_seen(spark, tmp_path):
    run = fold(str(tmp_path), buckets=16)
    run(spark.range(100).selectExpr("cast(id as string) as id", "1L as seq", "1L as size"), 0)
    run(spark.createDataFrame([("7", 2, 2)], SNAPSHOT), 1)
    assert len(glob.glob(f"{tmp_path}/data/000000000001/bucket=*")) == 1
    schema = spark.createDataFrame([], SNAPSHOT).schema
    assert history(spark, str(tmp_path), schema).count() == 101
    os.makedirs(f"{tmp_path}/data/000000000002/bucket=3")  # a batch whose manifest was never written
    assert history(spark, str(tmp_path), schema).count() == 101
    run(spark.createDataFrame([("8", 2, 2)], SNAPSHOT), 2)
    assert history(spark, str(tmp_path), schema).count() == 102
    fold(str(tmp_path), stream="second", buckets=99)(spark.createDataFrame([("9", 3, 2)], SNAPSHOT), 0)  # another checkpoint goes on
    assert history(spark, str(tmp_path), schema).count() == 103


def test_fold_as_a_stream(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([("a", i, i), (f"b{i}", i, i)], SNAPSHOT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(fold(f"{tmp_path}/out", keep=2, buckets=4)).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    got = history(spark, f"{tmp_path}/out", spark.createDataFrame([], SNAPSHOT).schema)
    assert got.filter("id = 'a'").count() == 2 and got.count() == 5


# -- outcomes --------------------------------------------------------------------------------------------------------

OBJECTS = "name string, text string, server string"


def test_run_over_servers_counts_and_keeps_what_failed(spark, tmp_path):
    def extract(server):
        if server["name"] == "down":
            raise ConnectionError("no route\nto host")
        df = spark.range(250).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") % 100 == 7, None).otherwise("x").alias("text"))
        if server["name"] == "late":
            df = df.withColumn("text", F.when(F.col("name") == "9", F.raise_error(F.lit("broke off"))).otherwise(F.col("text")))
        return df

    reason = F.when(F.col("text").isNull(), F.concat(F.lit("no definition of "), F.col("name")))
    out = extract_all(spark, [{"name": n} for n in ("one", "down", "late", "two")], extract, str(tmp_path), reason)
    got = {r.server: (r.files, r.rejected, r.failed) for r in out.collect()}
    assert got == {"one": (247, 3, False), "down": (0, 0, True), "late": (0, 0, True), "two": (247, 3, False)}
    assert {r.server: r.reason for r in out.collect() if r.failed}["down"] == "no route"
    bad = rejects(spark, str(tmp_path), "name string").collect()
    assert sorted((r.server, r.name) for r in bad) == [(s, n) for s in ("one", "two") for n in ("107", "207", "7")]
    assert all(r.reason == f"no definition of {r.name}" for r in bad)


def test_empty_output_has_counts_of_zero(spark, tmp_path):
    assert write_accepted(spark.createDataFrame([], OBJECTS).drop("server"), f"{tmp_path}/x", F.lit(None).cast("string")) == {"files": 0, "rejected": 0}
