"""Time series of table volumes, indexes and optimizer statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SNAPSHOTS = 90


def retain(history: DataFrame, new: DataFrame, keep: int = MAX_SNAPSHOTS) -> DataFrame:
    """Append without removing repeats, then keep each object's last ``keep`` snapshots by ``seq``.

    Of equal ``seq`` the appended one counts as the later; rows that are equal there too go by a hash of all they hold.
    """
    both = history.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy("id").orderBy(F.desc("seq"), F.desc("__new"), F.xxhash64(*history.columns))
    return both.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= keep).drop("__k", "__new")


def latest(metrics: DataFrame, *cols: str) -> DataFrame:
    return metrics.groupBy("id").agg(F.max_by(F.struct(*cols), "seq").alias("m")).select("id", "m.*")


def table_volume(partitions: DataFrame) -> DataFrame:
    """Pages of 8 KB by object: rows of heap or clustered index, reserved, data and index size."""
    base = F.col("index_id").isin(0, 1)
    pages = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0)) * 8
    return partitions.groupBy("id").agg(
        F.sum(F.when(base, F.col("rows")).otherwise(0)).alias("row_count"),
        pages("total_pages", F.lit(True)).alias("reserved_kb"),
        pages("used_pages", base).alias("data_kb"),
        pages("used_pages", ~base).alias("index_kb"),
    )


def index_metrics(indexes: DataFrame, physical: DataFrame, usage: DataFrame) -> DataFrame:
    """Fragmentation, pages and use of every index; an index without figures stays, its use counting 0."""
    joined = indexes.join(physical, ["id", "index_id"], "left").join(usage, ["id", "index_id"], "left")
    use = [F.max(F.coalesce(c, F.lit(0))).alias(c) for c in ("seeks", "scans", "lookups", "updates")]
    return joined.groupBy("id", "index_id", "name").agg(F.bround(F.avg(F.col("fragmentation").cast("decimal(18,6)")), 2).alias("fragmentation"), F.sum("pages").alias("pages"), *use)


def partition_volume(partitions: DataFrame, units: DataFrame, *, corrected: bool = False) -> DataFrame:
    """:func:`table_volume` of partitions (id, index_id, partition_id, rows) and their allocation units (partition_id, total_pages, used_pages).

    A partition's rows count once for each of its units, as the catalog views' usual join has it; ``corrected`` counts them once.
    """
    rows = partitions.join(units, "partition_id")
    if corrected:
        first = Window.partitionBy("partition_id").orderBy(F.desc("total_pages"), F.desc("used_pages"))
        rows = rows.withColumn("rows", F.when(F.row_number().over(first) == 1, F.col("rows")).otherwise(0))
    return table_volume(rows)


def oracle_snapshots(tables: DataFrame, changes: DataFrame, indexes: DataFrame) -> DataFrame:
    """Snapshots of a server that keeps one statistic a table: (id, name, num_rows, blocks, sample_size, last_analyzed).

    Size is estimated by blocks of 8 KB; the counter of changes (id, inserts, updates, deletes) counts nulls as 0 and is
    null without a row; indexes have (id, name, rowCount, distinctKeys, leafBlocks, lastAnalyzed).
    """
    count = sum((F.coalesce(c, F.lit(0)) for c in ("inserts", "updates", "deletes")), F.lit(0))
    counter = changes.groupBy("id").agg(F.max(count).alias("counter"))
    stat = F.struct("name", F.col("num_rows").alias("rows"), F.col("sample_size").alias("rowsSampled"), F.lit(None).cast("int").alias("steps"), F.col("counter").alias("modificationCounter"), F.col("last_analyzed").alias("lastUpdated"))
    listed = indexes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in indexes.columns if c != "id"]))).alias("indexes"))
    none = F.lit(None).cast("long")
    out = tables.join(counter, "id", "left").join(listed, "id", "left")
    out = out.select("id", F.col("num_rows").alias("rowCount"), (F.col("blocks") * 8).alias("reservedKB"), none.alias("dataKB"), none.alias("indexKB"), "indexes", F.array(stat).alias("statistics"))
    return out.withColumn("indexes", F.coalesce("indexes", F.array().cast(out.schema["indexes"].dataType)))


def latest_statistics(metrics: DataFrame) -> DataFrame:
    """The statistics of each object's latest snapshot, a row each."""
    return latest(metrics, "seq", "statistics").select("id", "seq", F.inline("statistics"))


def index_variant(metrics: DataFrame, name: str) -> DataFrame:
    """(id, by_use, by_size): whether any snapshot of the index tells its fragmentation, and whether any tells its rows."""
    found = F.get(F.filter("indexes", lambda x: x["name"] == name), 0)
    return metrics.select("id", found.alias("x")).groupBy("id").agg(*[F.coalesce(F.max(F.col("x")[f].isNotNull()), F.lit(False)).alias(a) for f, a in (("fragmentationPct", "by_use"), ("rowCount", "by_size"))])


def snapshots(volume: DataFrame, indexes: DataFrame, statistics: DataFrame) -> DataFrame:
    """One row per volume row; index and statistics lists, with all their columns, are empty, never null, and need a volume row."""
    pack = lambda df, name: df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("name", *[c for c in df.columns if c not in ("id", "name")]))).alias(name))
    out = volume.join(pack(indexes, "indexes"), "id", "left").join(pack(statistics, "statistics"), "id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    return out.withColumns({c: empty(c) for c in ("indexes", "statistics")})


def pending(snapshot: DataFrame) -> DataFrame:
    """Null without statistics, else the sum of counters, null ones as 0."""
    total = F.aggregate("statistics", F.lit(0).cast("long"), lambda a, s: a + F.coalesce(s["modifications"], F.lit(0)))
    return snapshot.withColumn("pending", F.when(F.size("statistics") > 0, total))


def index_series(metrics: DataFrame, name: str) -> DataFrame:
    """One index over time, null where a snapshot lacks it."""
    found = F.get(F.filter("indexes", lambda x: x["name"] == name), 0)
    return metrics.select("id", "seq", found["seeks"].alias("seeks"))


def segments(series: DataFrame, value: str) -> DataFrame:
    """Gap segmentation: a null ends a path, so non-null points between nulls share a segment."""
    w = Window.partitionBy("id").orderBy("seq")
    return series.withColumn("segment", F.sum(F.col(value).isNull().cast("long")).over(w)).filter(F.col(value).isNotNull())


def scale(series: DataFrame, *values: str) -> DataFrame:
    """One range per object for all its series: from 0 or less to the largest value; a range of 0 counts as 1. Without any value there is no row."""
    low = F.least(*[F.min(v) for v in values], F.lit(0))
    high = F.greatest(*[F.max(v) for v in values]) if len(values) > 1 else F.max(values[0])
    r = series.groupBy("id").agg(low.alias("low"), high.alias("high")).filter("high is not null")
    return r.withColumn("span", F.when(F.col("high") == F.col("low"), 1).otherwise(F.col("high") - F.col("low")))


# The chart's width, height and margins.
WIDTH, HEIGHT, PAD_X, PAD_TOP, PAD_BOTTOM = 640, 160, 10, 10, 20


def chart_points(series: DataFrame, value: str, ranges: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(id, seq, x, y) of every point that has a value; a single label stands in the middle. ``ranges`` come from :func:`scale`."""
    w = Window.partitionBy("id").orderBy("seq")
    rows = series.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("id"))}).join(ranges, "id")
    x = F.when(F.col("n") <= 1, F.lit(WIDTH / 2)).otherwise(F.col("i") / (F.col("n") - 1) * (WIDTH - 2 * PAD_X) + PAD_X)
    y = F.lit(height - PAD_BOTTOM) - (F.col(value) - F.col("low")) / F.col("span") * (height - PAD_TOP - PAD_BOTTOM)
    return rows.filter(F.col(value).isNotNull()).select("id", "seq", x.alias("x"), y.alias("y"))


def attach(nodes: DataFrame, histories: DataFrame) -> DataFrame:
    """Nodes with their histories by the same id; a node without one stays."""
    return nodes.join(histories, "id", "left")


def modification_counter(*counters: Column) -> Column:
    """The sum of counters, null ones as 0; null where there is none at all, as for an object without a row."""
    some = F.coalesce(*counters).isNotNull()
    return F.when(some, sum((F.coalesce(c, F.lit(0)) for c in counters[1:]), F.coalesce(counters[0], F.lit(0))))


def block_kb(blocks: Column) -> Column:
    """KB of blocks of 8 KB; null where the number isn't known."""
    return blocks * 8


def index_names(metrics: DataFrame) -> DataFrame:
    """(id, name, first) of every index in any snapshot, with the first ``seq`` that has it."""
    return metrics.select("id", "seq", F.explode("indexes.name").alias("name")).groupBy("id", "name").agg(F.min("seq").alias("first"))


def volume_series(metrics: DataFrame, start: str, *values: str) -> DataFrame:
    """(id, day, values) of snapshots that are numbered by days from ``start``."""
    return metrics.select("id", F.date_add(F.lit(start).cast("date"), F.col("seq").cast("int")).cast("string").alias("day"), *values)


def runs(series: DataFrame, *values: str) -> DataFrame:
    """(id, first, last, n, values): neighbouring snapshots with equal values as one row, nulls being equal.

    A chart of a long history needs a run's two ends only: :func:`ends` gives the points, and a line through them is the
    line through all.
    """
    w = Window.partitionBy("id").orderBy("seq")
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(w))
    fresh = (~same | (F.row_number().over(w) == 1)).cast("long")
    rows = series.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w))
    return rows.groupBy("id", "run", *values).agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n")).select("id", "first", "last", "n", *values)


def ends(found: DataFrame, *values: str) -> DataFrame:
    """(id, seq, values): the first and last point of each run of :func:`runs`; a run of one snapshot is one point."""
    return found.select("id", F.explode(F.array_distinct(F.array("first", "last"))).alias("seq"), *values)
