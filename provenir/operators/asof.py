"""Definitions as of many instants: versions and instants merged in one order, by stretches of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _stretch(time: Column, kind: str, width: int) -> Column:
    """The number of the stretch that holds a time: of ``width`` seconds of a timestamp or date, else of ``width`` units."""
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.floor(F.date_diff(time.cast("date"), F.lit("1970-01-01").cast("date")) * F.lit(86400) / width + (F.hour(time) * 3600 if kind != "date" else F.lit(0)) / width)
    return F.floor(time / width)


def as_of(versions: DataFrame, instants: DataFrame, *, width: int = 30 * 86400) -> DataFrame:
    """Each row of ``instants`` (id, at, ...) with the version (``date, sha``) of its object that was the latest then; null before the first.

    ``versions`` (id, date, sha) count from their date on, that instant included; of one date the greatest sha counts.
    Time is cut into stretches of ``width`` (seconds, or units of a number), so an object with very many versions or
    instants is spread over its stretches: each is sorted once, and one row a stretch carries its last version to the
    next. Instants without an id or a time keep their row, with nulls; versions without one are left out. Repeated
    versions change nothing; repeated instants each get their row. Definitions are joined by (id, sha) afterwards, so
    that texts aren't sorted.
    """
    kind = versions.schema["date"].dataType.typeName()
    known = versions.filter("id is not null and date is not null").select("id", F.col("date").alias("__time"), F.struct("date", "sha").alias("__version"))
    known = known.withColumn("__at", _stretch(F.col("__time"), kind, width))
    asked = instants.withColumn("__time", F.col("at").cast(versions.schema["date"].dataType)).withColumn("__at", _stretch(F.col("__time"), kind, width))
    lost = asked.filter("id is null or __at is null")
    both = known.unionByName(asked.filter("id is not null and __at is not null").withColumn("__asked", F.lit(True)), allowMissingColumns=True)
    inside = Window.partitionBy("id", "__at").orderBy("__time", F.col("__asked").isNotNull(), "__version")
    ends = known.groupBy("id", "__at").agg(F.max("__version").alias("__last"))
    before = Window.partitionBy("id").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    # Stretches with instants alone need a row too; one row a stretch goes through the window of an object.
    ends = ends.unionByName(asked.filter("id is not null and __at is not null").select("id", "__at").distinct(), allowMissingColumns=True).groupBy("id", "__at").agg(F.max("__last").alias("__last"))
    carried = ends.select("id", "__at", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    found = both.withColumn("__found", F.last("__version", ignorenulls=True).over(inside)).filter("__asked").join(carried, ["id", "__at"])
    found = found.withColumn("__found", F.coalesce("__found", "__carried"))
    lost = lost.withColumn("__found", F.lit(None).cast(known.schema["__version"].dataType))
    columns = [F.col(c) for c in instants.columns]
    pick = [F.col("__found.date").alias("date"), F.col("__found.sha").alias("sha")]
    return found.select(*columns, *pick).unionByName(lost.select(*columns, *pick))
