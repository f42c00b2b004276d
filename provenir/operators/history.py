"""Change history: which commits touched which objects, object versions, and objects that change together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.storage import cut, maybe_broadcast

MAX_COMMITS, MAX_VERSIONS, MAX_FETCHES, MAX_PAIR_SIZE, MAX_PAIRS = 250, 15, 1500, 40, 100
#: Lines of a log that are read together.
SEGMENT = 10_000


def parse_git_log(lines: DataFrame) -> DataFrame:
    """(log, line_no, value) of ``@@COMMIT@@sha@@date@@subject`` logs to (sha, date, message, path); a header opens a group,
    and lines before the first one go.

    A log is read in segments of ``SEGMENT`` lines: each keeps its last header, and one row a segment carries it to the
    lines at the head of the next. No window holds more than a segment's lines, or a log's segments. For files, see
    :func:`provenir.sources.gitlog.git_log`, which needs neither.
    """
    header = F.when(F.col("value").startswith("@@COMMIT@@"), F.split("value", "@@", 5))
    rows = lines.select("log", "line_no", "value", F.floor(F.col("line_no") / SEGMENT).alias("segment"), header.alias("h"))
    inside = Window.partitionBy("log", "segment").orderBy("line_no")
    ends = rows.groupBy("log", "segment").agg(F.max_by("h", F.when(F.col("h").isNotNull(), F.col("line_no"))).alias("last"))
    before = Window.partitionBy("log").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("log", "segment", F.last("last", ignorenulls=True).over(before).alias("carried"))
    rows = rows.withColumn("h", F.last("h", ignorenulls=True).over(inside)).join(carried, ["log", "segment"]).withColumn("h", F.coalesce("h", "carried"))
    rows = rows.withColumn("path", F.regexp_replace("value", r"(?U)^\s+|\s+$", ""))
    rows = rows.filter("h is not null and not startswith(value, '@@COMMIT@@') and path <> ''")
    return rows.select(F.get("h", 2).alias("sha"), F.get("h", 3).alias("date"), F.get("h", 4).alias("message"), "path")


def commit_objects(changes: DataFrame, nodes: DataFrame, prefix: str = "") -> DataFrame:
    """(sha, date, id) of changed ``.sql`` paths (in small letters) under the prefix whose object is still in the catalog, ids without case."""
    path = F.col("path")
    own = changes.filter(path.startswith(prefix) & path.endswith(".sql"))
    low = F.lower(F.expr(f"substring(path, {len(prefix) + 1}, length(path) - {len(prefix) + 4})"))
    return own.withColumn("low", low).join(nodes.select("id", F.lower("id").alias("low")), "low").select("sha", "date", "id").distinct()


def change_counts(touched: DataFrame) -> DataFrame:
    return touched.groupBy("id").agg(F.count("*").alias("change_count"), F.max("date").alias("last_changed_at"))


def ranked(touched: DataFrame, keep: int | None = None) -> DataFrame:
    """(id, rank, sha, date): all versions of each object, or the latest ``keep``, newest first by date and then sha."""
    w = Window.partitionBy("id").orderBy(F.desc("date"), F.desc("sha"))
    rows = touched.withColumn("rank", F.row_number().over(w))
    top = rows if keep is None else rows.filter(F.col("rank") <= keep)
    return top.select("id", F.col("rank").cast("long").alias("rank"), "sha", "date")


def version_history(touched: DataFrame, commits: DataFrame, keep: int | None = MAX_VERSIONS) -> DataFrame:
    """The latest ``keep`` versions of each object, by date and then sha; all without ``keep``."""
    return ranked(touched, keep).join(commits.select("sha", "message"), "sha", "left").select("id", "rank", "sha", "date", "message")


def with_content(versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """Definitions of versions, null where the blob is missing."""
    return versions.join(blobs.select("id", "sha", "ddl"), ["id", "sha"], "left")


def content_budget(versions: DataFrame, budget: int = MAX_FETCHES) -> DataFrame:
    """The first ``budget`` versions by (id, rank) over all objects: a top-k, so no global sort."""
    return versions.orderBy("id", "rank").limit(budget)


def object_versions(versions: DataFrame, blobs: DataFrame, parse) -> DataFrame:
    """``versions``, a row each, with the definition that ``parse`` finds in their blob (id, sha, text)."""
    return with_content(versions, parse(blobs.select("id", "sha", "text"), "sha"))


def object_history(versions: DataFrame, blobs: DataFrame, parse, budget: int | None = None) -> DataFrame:
    """(id, history): versions (sha, date, message, ddl), newest first. ``blobs`` (id, sha, text) are parsed by ``parse``.

    With a ``budget``, definitions are fetched, and their blobs parsed, for the first so many versions by (id, rank); an object all of whose
    versions lie beyond has an empty history, though its changes are counted. An object's history is one row: see :func:`object_versions` for a row each.
    """
    if budget is None:
        rows = object_versions(versions, blobs, parse).withColumn("fetched", F.lit(True))
    else:
        versions = cut(versions, "versions")
        first = cut(content_budget(versions, budget), "fetched")
        blobs = blobs.join(maybe_broadcast(first.select("id", "sha").distinct()), ["id", "sha"], "left_semi")
        fetched = maybe_broadcast(first.select("id", "rank", F.lit(True).alias("fetched")))
        rows = object_versions(versions.join(fetched, ["id", "rank"], "left"), blobs, parse)
    version = F.struct("rank", "sha", "date", "message", F.when(F.col("fetched"), F.col("ddl")).alias("ddl"))
    out = rows.groupBy("id").agg(F.sort_array(F.collect_list(version)).alias("v"), F.max("fetched").alias("any"))
    kept = F.transform("v", lambda x: F.struct(x["sha"].alias("sha"), x["date"].alias("date"), x["message"].alias("message"), x["ddl"].alias("ddl")))
    return out.select("id", F.when(F.col("any"), kept).otherwise(F.slice(kept, 1, 0)).alias("history"))


def recent_changes(touched: DataFrame, commits: DataFrame, last: int = MAX_COMMITS) -> DataFrame:
    """Objects per commit among the last commits; the cut comes first, then commits without objects go."""
    latest = commits.orderBy(F.desc("date"), F.desc("sha")).limit(last)
    counted = touched.groupBy("sha").agg(F.count("*").alias("n_objects"))
    return latest.join(counted, "sha").select("sha", F.left("sha", F.lit(7)).alias("short_sha"), "date", "message", "n_objects")


def co_change(touched: DataFrame, max_size: int = MAX_PAIR_SIZE) -> DataFrame:
    """(a, b, count) for a < b in commits of 2 to ``max_size`` objects.

    One shuffle by commit: larger ones go before their objects are gathered, and pairs are made inside a commit's row.
    """
    sized = touched.select("sha", "id").withColumn("n", F.count("*").over(Window.partitionBy("sha"))).filter(F.col("n").between(2, max_size))
    ids = sized.groupBy("sha").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    after = lambda x, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    pairs = ids.select(F.inline(F.flatten(F.transform("ids", after))))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("count"))


def top_pairs(pairs: DataFrame, keep: int = MAX_PAIRS) -> DataFrame:
    return pairs.orderBy(F.desc("count"), "a", "b").limit(keep)


def display_pairs(pairs: DataFrame, nodes: DataFrame, keep: int = 10) -> DataFrame:
    names = nodes.select("id", "name")
    top = top_pairs(pairs, keep)
    return top.join(names.select(F.col("id").alias("a"), F.col("name").alias("a_name")), "a", "left").join(names.select(F.col("id").alias("b"), F.col("name").alias("b_name")), "b", "left").select("a", "b", "count", "a_name", "b_name")


def most_changed(counts: DataFrame, keep: int = 10) -> DataFrame:
    return counts.filter("change_count > 0").orderBy(F.desc("change_count"), "id").limit(keep)


def recently_changed(counts: DataFrame, keep: int = 10) -> DataFrame:
    return counts.filter("last_changed_at is not null").orderBy(F.desc("last_changed_at"), "id").limit(keep)


def intensity(value: Column, most: Column) -> Column:
    """0 without a maximum, else the share of it between 0.08 and 1."""
    return F.when(most <= 0, 0.0).otherwise(F.greatest(F.lit(0.08), F.least(F.lit(1.0), value / most)))


def point_in_time(versions: DataFrame, at: Column) -> DataFrame:
    """Each object's definition as of ``at``."""
    return versions.filter(F.col("date") <= at).groupBy("id").agg(F.max_by("ddl", F.struct("date", "sha")).alias("ddl"))


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status) of two trees (path, hash): added, removed, modified or unchanged."""
    old, new = before.select("path", F.col("hash").alias("old")), after.select("path", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return old.join(new, "path", "full").select("path", status.alias("status"))
