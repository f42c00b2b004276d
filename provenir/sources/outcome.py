"""Extraction over servers: each is written by itself, counted in the job that writes it, and its failures are kept beside."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SUMMARY = "server string, files long, rejected long, failed boolean, reason string"


def write_accepted(df: DataFrame, path: str, reason: Column) -> dict[str, int]:
    """Write rows to ``path/rejected=false``, and those with a ``reason`` to ``path/rejected=true`` with it; returns ``files`` and ``rejected``.

    The counts are observed by the job that writes, so no row is read twice, and no list of rejects passes the driver.
    """
    seen = Observation()
    told = df.withColumn("reason", reason).withColumn("rejected", F.col("reason").isNotNull())
    counts = F.count_if(~F.col("rejected")).alias("files"), F.count_if("rejected").alias("rejected")
    told.observe(seen, *counts).write.mode("overwrite").partitionBy("rejected").parquet(path)
    return dict(seen.get)


def rejects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rejected rows below the folder of a run, with their server and reason; none if there are none."""
    found = spark.read.schema(f"{schema}, reason string, rejected boolean, server string").parquet(path)
    return found.filter("rejected").drop("rejected")


def extract_all(spark: SparkSession, servers: Iterable[dict], extract: Callable[[dict], DataFrame], path: str, reason: Column) -> DataFrame:
    """(server, files, rejected, failed, reason) of a run over the servers of a configuration.

    ``extract`` gives a server's objects; they go to ``path/server=<name>``. A server that fails is noted with the reason,
    and the others are written; objects with a ``reason`` (null: fine) are kept as rejects. The run has failed if any
    server has.
    """
    rows = []
    for server in servers:  # one job each, as each is another database
        try:
            n = write_accepted(extract(server), f"{path}/server={server['name']}", reason)
            rows.append((server["name"], n["files"], n["rejected"], False, None))
        except Exception as problem:  # noqa: BLE001  whatever a server fails with, the run goes on with the others
            rows.append((server["name"], 0, 0, True, next((x for x in str(problem).splitlines() if x.strip()), type(problem).__name__)))
    return spark.createDataFrame(rows, SUMMARY)
