"""Cuts of lineage in storage that all executors share, and broadcasts behind a check of their size."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DatetimeType, NumericType, StringType

#: Rows and bytes of text up to which a side is broadcast; beyond either the join shuffles.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20
#: Rows of a task where each gets a text of its own.
SPREAD_ROWS = 20_000
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode; a cluster needs the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="provenir-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back, which ends its lineage. The folder goes with the process or by :func:`clean`."""
    path = os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    keep(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(spark: SparkSession, path: str) -> None:
    """Note a folder of shared storage that is deleted like a cut."""
    _written.append((spark, path))


def clean() -> None:
    """Delete all cuts of this process; frames that were read from them can't be used afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended; nothing is left to delete with
            return


atexit.register(clean)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True if ``df`` has at most ``rows`` rows and ``size`` bytes in strings, binaries and nested columns, summed by partition."""
    wide = [f.name for f in df.schema if not isinstance(f.dataType, (NumericType, BooleanType, DatetimeType))]
    texts = [F.octet_length(c if isinstance(df.schema[c].dataType, (StringType, BinaryType)) else F.to_json(F.struct(c))) for c in wide]
    n, held = df.agg(F.count("*"), sum((F.coalesce(F.sum(t), F.lit(0)) for t in texts), F.lit(0))).first()
    return n <= rows and held <= size


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast after counting its rows and bytes; larger sides go through a shuffled join."""
    return F.broadcast(df) if small(df, rows) else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """Mark a side as one that no join broadcasts. Spark guesses sizes by those of compressed files, which texts made from them exceed by far."""
    return df.hint("merge")


def spread(df: DataFrame, rows: int = SPREAD_ROWS, *by: str) -> DataFrame:
    """Deal ``df``, by a key or by turns, over tasks of about ``rows`` rows: before texts are made of rows so short that one split of a file has millions."""
    return df.repartition(df.count() // rows + 1, *by)
