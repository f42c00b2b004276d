"""The catalog: objects from their files, edges between them, their history and metrics.

Every input but the files is optional. What can't be read is left out and named in ``warnings``; nothing fails for it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions.scalar import normalised
from provenir.operators import history, lineage, parse

SNAPSHOT = """capturedAt string, rowCount long, reservedKB long, dataKB long, indexKB long,
indexes array<struct<name:string,fragmentationPct:double,pageCount:long,seeks:long,scans:long,lookups:long,updates:long,rowCount:long,distinctKeys:long,leafBlocks:long,lastAnalyzed:string>>,
statistics array<struct<name:string,rows:long,rowsSampled:long,steps:int,modificationCounter:long,lastUpdated:string>>"""
VERSION = "array<struct<sha:string,date:string,message:string,ddl:string>>"


@dataclass(frozen=True)
class Catalog:
    nodes: DataFrame
    recent_changes: DataFrame
    co_change_pairs: DataFrame
    #: (kind, name) of what was skipped
    warnings: DataFrame
    #: the objects with what their definitions are searched for
    searched: DataFrame

    @cached_property
    def edges(self) -> DataFrame:
        """Inferred when first asked for, as that runs jobs."""
        return _edges(self.searched)


def _lines(title: str) -> Column:
    return F.coalesce(F.split(parse.section(title), "\n"), F.array().cast("array<string>"))


def _matches(title: str, pattern: str, names: dict[str, int]) -> Column:
    """A struct of groups for every line of the section that matches, row by row."""
    found = F.filter(_lines(title), lambda x: x.rlike(pattern))
    return F.transform(found, lambda x: F.struct(*[F.regexp_extract(x, pattern, i).alias(n) for n, i in names.items()]))


def _objects(files: DataFrame) -> DataFrame:
    """One row per object file with all that the file tells; no shuffle."""
    placed = parse.parse_path(files.withColumn("file", F.regexp_replace("path", r"\\", "/")), "file", "text").withColumnRenamed("file", "path")
    rows = parse.split_sections(placed, "server", "database", "schema", "type", "name", "qualifiedName", "path")
    described = lambda xs: F.filter(xs, lambda p: F.lower(p["property"]).contains("description"))
    rows = rows.withColumns({
        "listed": _matches("Columns", r"(?i)^-- \[col\] ([^|]*)\|(.*)$", {"name": 1, "dataType": 2}),
        "granted": _matches("Grants", r"(?i)^-- \[grant\] ([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$", {"permission": 1, "state": 2, "grantee": 3, "granteeType": 4, "column": 5}),
        "own": described(_matches("Extended Properties", r"(?i)^-- \[object\] (\S+) = (.*)$", {"property": 1, "text": 2})),
        "parts": described(_matches("Extended Properties", r"(?i)^-- \[column: (.+?)\] (\S+) = (.*)$", {"name": 1, "property": 2, "text": 3})),
    })
    description = F.coalesce(F.get(F.filter(F.transform("own", lambda p: p["text"]), lambda x: x != ""), 0), F.when(F.size("own") > 0, ""))
    last = lambda name: F.try_element_at(F.filter("parts", lambda p: F.lower(p["name"]) == F.lower(name)), F.lit(-1))["text"]
    column = lambda name, kind: F.struct(name.alias("name"), last(name).alias("description"), kind.alias("dataType"))
    spelled = lambda low: F.get(F.filter("parts", lambda p: F.lower(p["name"]) == low), 0)["name"]
    from_list = F.transform("listed", lambda c: column(c["name"], c["dataType"]))
    from_text = F.transform(F.array_distinct(F.transform("parts", lambda p: F.lower(p["name"]))), lambda low: column(spelled(low), F.lit(None).cast("string")))
    empty = lambda c: F.nullif(c, F.lit(""))
    grants = F.transform("granted", lambda g: F.struct(g["permission"].alias("permission"), g["state"].alias("state"), g["grantee"].alias("grantee"), empty(g["granteeType"]).alias("granteeType"), empty(g["column"]).alias("column")))
    return rows.select(
        "id", "server", "database", "schema", "type", "name", "qualifiedName", "path", "ddl", description.alias("description"),
        F.when(F.size("listed") > 0, from_list).otherwise(from_text).alias("columns"), grants.alias("grants"),
        F.filter("sections", lambda s: ~F.lower(s["title"]).isin(*parse.STRUCTURED)).alias("sections"),
        F.octet_length("ddl").cast("long").alias("sizeBytes"), parse.section("Foreign Keys").alias("foreign_keys"),
    )


def _edges(nodes: DataFrame) -> DataFrame:
    columns = nodes.select("id", F.explode("columns.name").alias("name"))
    return lineage.column_refs(lineage.edges(nodes), nodes, columns)


def assemble(files: DataFrame, *, metrics: DataFrame | None = None, log: DataFrame | None = None, blobs: DataFrame | None = None, prefix: str = "") -> Catalog:
    """The catalog of object files (path, text).

    ``metrics`` (path, text) are JSON histories beside the objects' paths; ``log`` is the git log of the files below
    ``prefix``, as lines (log, line_no, value) or as rows of :func:`provenir.sources.gitlog.git_log`, and ``blobs`` (id, sha, text) are their earlier versions. Paths of
    fewer than four parts and metrics that are no JSON list are skipped with a warning. Without a log every object has 0
    changes and no history. The log ends before the tree that is being published: a run's own commit is seen by the next
    run. Where the catalog's own export lies below ``prefix``, every run makes a commit of it, which takes one of the last
    commits that count; keep it elsewhere. An empty table gives an empty catalog; further columns are ignored.
    """
    spark = files.sparkSession
    nodes = _objects(files)
    warnings = files.filter(F.size(F.split(F.regexp_replace("path", r"\\", "/"), "/")) < 4).select(F.lit("unexpected path").alias("kind"), F.col("path").alias("name"))
    series = f"array<struct<{SNAPSHOT}>>"
    if metrics is None:
        out = nodes.withColumn("metrics", F.array().cast(series))
    else:
        told = metrics.filter("trim(text) <> ''").select(F.regexp_replace("path", r"(?i)\.json$", "").alias("id"), "path", normalised(F.col("text"), SNAPSHOT).alias("metrics"))
        warnings = warnings.unionByName(told.filter("metrics is null").select(F.lit("unreadable metrics").alias("kind"), F.col("path").alias("name")))
        out = nodes.join(told.filter("metrics is not null").select("id", "metrics"), "id", "left").withColumn("metrics", F.coalesce("metrics", F.array().cast(series)))
    none = F.array().cast(VERSION)
    if log is None:
        out = out.withColumns({"changeCount": F.lit(0).cast("long"), "lastChangedAt": F.lit(None).cast("string"), "history": none})
        changes = spark.createDataFrame([], "sha string, date string, message string, objectIds array<string>")
        pairs = spark.createDataFrame([], "a string, b string, count long")
    else:
        lines = history.parse_git_log(log) if "line_no" in log.columns else log
        commits = lines.select("sha", "date", "message").distinct()
        touched = history.commit_objects(lines, nodes, prefix)
        versions = history.version_history(touched, commits)
        texts = blobs if blobs is not None else spark.createDataFrame([], "id string, sha string, text string")
        past = history.object_history(versions, texts, parse.split_sections)
        counts = history.change_counts(touched).select("id", F.col("change_count").alias("changeCount"), F.col("last_changed_at").alias("lastChangedAt"))
        out = out.join(counts, "id", "left").join(past, "id", "left").withColumns({"changeCount": F.coalesce("changeCount", F.lit(0)), "history": F.coalesce("history", none)})
        changes = touched.groupBy("sha").agg(F.sort_array(F.collect_set("id")).alias("objectIds")).join(commits, "sha").select("sha", "date", "message", "objectIds")
        pairs = history.top_pairs(history.co_change(touched))
    return Catalog(out.drop("foreign_keys"), changes, pairs, warnings, nodes)


def write(catalog: Catalog, path: str) -> None:
    """A folder of JSON lines for nodes, edges, recentChanges, coChangePairs and warnings, each written in parallel."""
    for name, df in parts(catalog).items():
        df.write.mode("overwrite").json(f"{path}/{name}", ignoreNullFields=False)


def parts(catalog: Catalog) -> dict[str, DataFrame]:
    return {"nodes": catalog.nodes, "edges": catalog.edges, "recentChanges": catalog.recent_changes, "coChangePairs": catalog.co_change_pairs, "warnings": catalog.warnings}


def document(catalog: Catalog, generated_at: str, *, most: int = 50_000) -> DataFrame:
    """The whole catalog as one row, for a page that loads one file; more than ``most`` objects or edges are refused: use :func:`write`."""
    for df in (catalog.nodes, catalog.edges):
        if df.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} rows don't fit one document")
    rows = lambda df, *order: df.agg(F.sort_array(F.collect_list(F.struct(*order, F.struct("*").alias("row")))).alias("x")).select(F.transform("x", lambda r: r["row"]).alias("x"))
    counts = catalog.nodes.groupBy("type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("x"))
    servers = catalog.nodes.agg(F.sort_array(F.collect_set("server")).alias("x"))
    fields = {"servers": servers, "typeCounts": counts, "nodes": rows(catalog.nodes, "id"), "edges": rows(catalog.edges, "from", "to"), "recentChanges": rows(catalog.recent_changes, "date", "sha"), "coChangePairs": rows(catalog.co_change_pairs, F.col("count").alias("n"), "a", "b")}
    out = catalog.nodes.sparkSession.range(1).select(F.lit(generated_at).alias("generatedAt"))
    for name, df in fields.items():  # one row each
        out = out.join(F.broadcast(df.withColumnRenamed("x", name)))
    return out
