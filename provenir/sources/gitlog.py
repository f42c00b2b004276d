"""The git log as a splittable source: a record per commit, so that no task needs the lines of another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what a commit's line begins with, as in ``git log --pretty=format:'@@COMMIT@@%H@@%ad@@%s' --name-only``.
MARK = "@@COMMIT@@"


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(sha, date, message, path) of a log file, or of all logs in a folder: a row for each path of a commit.

    A line end before the mark parts records, wherever Spark splits the file: the reader takes a record whole that begins
    in its split. So a log of any length is read by as many tasks as its bytes need, without a sort or a window. Of a
    commit's first line the part after the second ``@@`` is the message, which may hold more of them. Blanks around paths
    go, empty lines too, commits without paths have no rows. Lines before a file's first mark are left out (a record in
    the first split without two ``@@`` in its first line); an empty file has no rows.
    """
    rows = spark.read.text(path, lineSep=f"\n{MARK}", recursiveFileLookup=True).select("value", (F.col("_metadata.file_block_start") == 0).alias("start"))
    rows = rows.withColumn("marked", F.col("start") & F.col("value").startswith(MARK))
    lines = F.split(F.when(F.col("marked"), F.expr(f"substring(value, {len(MARK) + 1})")).otherwise(F.col("value")), "\r?\n")
    rows = rows.select("start", "marked", F.split(F.get(lines, F.lit(0)), "@@", 3).alias("head"), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))).alias("lines"))
    rows = rows.filter("marked or not start or size(head) = 3")
    paths = F.filter(F.transform("lines", lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return rows.select(F.get("head", F.lit(0)).alias("sha"), F.get("head", F.lit(1)).alias("date"), F.get("head", F.lit(2)).alias("message"), F.explode(paths).alias("path"))
