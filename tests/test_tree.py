"""Publication of object trees: replaced as a whole, untouched by failed tasks, not written without a difference."""

import os

import pytest
from pyspark.sql import functions as F

from provenir.sources.tree import ObjectTree, Published, current_tree, mirrored_path, publish

SCHEMA = "path string, text string, hash string"


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(root) for f in names}


def frame(spark, files):
    return spark.createDataFrame([(p, t, "x") for p, t in files], SCHEMA)


def test_second_run_changes_nothing_and_drops_are_deleted(spark, tmp_path):
    root = str(tmp_path / "tree")
    first = [("s/d/Tables/dbo/a.sql", "one\n"), ("s/d/Tables/dbo/b.sql", "é"), ("s/d/Schemas/dbo.sql", None)]
    assert publish(frame(spark, first), root) == Published(True, 3, 0, 0)
    assert tree(root) == {p: t or "\n" for p, t in first}
    before = os.stat(root).st_ino
    assert publish(frame(spark, first), root) == Published(False, 0, 0, 0)
    assert os.stat(root).st_ino == before  # not even swapped
    assert publish(frame(spark, [("s/d/Tables/dbo/a.sql", "two"), ("s/d/x.sql", "new")]), root) == Published(True, 1, 2, 1)
    assert tree(root) == {"s/d/Tables/dbo/a.sql": "two", "s/d/x.sql": "new"}
    assert os.listdir(tmp_path) == ["tree"]


def test_failed_task_leaves_the_old_tree(spark, tmp_path):
    root = str(tmp_path / "tree")
    publish(frame(spark, [("a.sql", "old")]), root)
    many = spark.range(0, 40, 1, 8).select(F.concat(F.lit("d/"), F.col("id"), F.lit(".sql")).alias("path"), F.lit("new").alias("text"))
    with pytest.raises(Exception, match="killed here"):
        broken = many.withColumn("text", F.when(F.col("path") == "d/7.sql", F.raise_error(F.lit("killed here"))).otherwise(F.col("text")))
        spark.dataSource.register(ObjectTree)
        broken.write.format("object_tree").mode("overwrite").save(root)
    assert tree(root) == {"a.sql": "old"}
    for bad in ("../out.sql", "/etc/x.sql", "a//b.sql", ""):
        with pytest.raises(Exception, match="not a path inside the tree"):
            publish(frame(spark, [("ok.sql", "x"), (bad, "x")]), root)
    assert tree(root) == {"a.sql": "old"}
    assert publish(frame(spark, [("a.sql", "old")]), root).changed is False
    assert os.listdir(tmp_path) == ["tree"]  # the next publication sweeps what late tasks of failed ones left


def test_swap_that_stopped_half_way_is_undone(spark, tmp_path):
    root = str(tmp_path / "tree")
    publish(frame(spark, [("a.sql", "old")]), root)
    os.rename(root, root + ".old")
    assert [tuple(r) for r in current_tree(spark, root).collect()] == [("a.sql", "old")]
    assert publish(frame(spark, [("a.sql", "old")]), root) == Published(False, 0, 0, 0)


def test_colliding_and_repeated_paths_give_one_file(spark, tmp_path):
    root = str(tmp_path / "tree")
    rows = spark.createDataFrame([("s", "d", "Tables", "dbo", "a:b", "1"), ("s", "d", "Tables", "dbo", "a?b", "2"), ("s", "d", "Schemas", " ", "x", "3"), ("s", "d", "Schemas", None, "y", "3")], "server string, database string, type string, schema string, name string, text string")
    path = mirrored_path(*(F.col(c) for c in ("server", "database", "type", "schema", "name")))
    assert publish(rows.withColumn("path", path), root, order=F.col("name")).added == 3
    assert tree(root) == {"s/d/Tables/dbo/a_b.sql": "2", "s/d/Schemas/x.sql": "3", "s/d/Schemas/y.sql": "3"}


def test_empty_table_empties_the_tree(spark, tmp_path):
    root = str(tmp_path / "tree")
    assert publish(frame(spark, []), root) == Published(False, 0, 0, 0)
    publish(frame(spark, [("a.sql", "x")]), root)
    assert publish(frame(spark, []), root) == Published(True, 0, 1, 0)
    assert tree(root) == {} and publish(frame(spark, []), root).changed is False


def test_the_tree_is_listed_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("provenir.sources.tree.FILES_A_TASK", 3)
    root = str(tmp_path / "tree")
    files = [(f"_s{i % 2}/.d/{'x/' * (i % 4)}{i}.sql", f"é{i}\n") for i in range(20)]  # Spark's readers skip such folders
    assert publish(frame(spark, files), root).added == 20
    now = current_tree(spark, root)
    assert not now.inputFiles() or not any(f.endswith(".sql") for f in now.inputFiles())
    assert "MapInArrow" in now._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in now.collect()) == sorted(files)
    assert publish(frame(spark, files), root) == Published(False, 0, 0, 0)
