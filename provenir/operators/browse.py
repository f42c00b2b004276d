"""Catalog browsing: name filters, token predicates, sorting, suggestions and the object tree."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FREE_TEXT = ("qualifiedName", "server", "database", "schema", "description")
SORT_KEYS = ("qualifiedName", "server", "database", "schema", "type", "changeCount", "lastChangedAt")
# What attributes read and are called, and what operators are called.
FIELDS = {"name": "qualifiedName"}
LABELS = {"server": "Server", "database": "Database", "schema": "Schema", "type": "Type", "name": "Name", "description": "Description"}
OPERATORS = {"is": "is", "is-not": "is not", "contains": "contains", "is-in": "is in", "is-not-in": "is not in"}


def _text(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name).cast("string"), F.lit("")))


def name_filter(col: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Unanchored patterns that ignore case: no exclusion matches, and some inclusion does (none given: all)."""
    hit = lambda patterns: reduce(lambda a, b: a | b, [col.rlike(f"(?i){p}") for p in patterns], F.lit(False))
    return ~hit(exclude) & (hit(include) if include else F.lit(True))


def effective(server: dict, defaults: dict) -> dict:
    """A server's own filter replaces the default of the same kind."""
    return {k: server[k] if k in server else defaults.get(k) for k in ("databases", "schemas", "objectNames", "objectTypes")}


def token(attribute: str | None, operator: str, values: Sequence[str]) -> Column:
    """One filter token. A missing field counts as an empty text; a token without values holds for all rows.

    Free text is the first value alone, and an empty one holds for all rows.
    """
    if attribute is None:
        needle = values[0].lower() if values else ""
        return reduce(lambda a, b: a | b, [_text(f).contains(needle) for f in FREE_TEXT]) if needle else F.lit(True)
    low = [v.lower() for v in values if v]
    if not low:
        return F.lit(True)
    field = _text(FIELDS.get(attribute, attribute))
    if operator == "contains":
        return field.contains(low[0])
    if operator == "is":
        return field == low[0]
    if operator == "is-not":
        return field != low[0]
    if operator in ("is-in", "is-not-in"):
        return field.isin(low) if operator == "is-in" else ~field.isin(low)
    raise ValueError(f"unknown operator {operator}")


def apply_tokens(nodes: DataFrame, tokens: Sequence[tuple[str | None, str, Sequence[str]]]) -> DataFrame:
    return nodes.filter(reduce(lambda a, b: a & b, [token(*t) for t in tokens], F.lit(True)))


def describe_token(attribute: str | None, operator: str, values: Sequence[str]) -> str:
    """``Type is not Views``; free text stands as it is."""
    if attribute is None:
        return values[0] if values else ""
    return f"{LABELS.get(attribute, attribute)} {OPERATORS[operator]} {', '.join(values)}"


def explorer(nodes: DataFrame, key: str, descending: bool = False, keep: int = 500) -> DataFrame:
    col = F.col(key) if key == "changeCount" else _text(key)
    return nodes.orderBy(col.desc() if descending else col.asc(), "id").limit(keep)


def suggest(nodes: DataFrame, attribute: str, needle: str, keep: int = 50) -> DataFrame:
    value = F.col(FIELDS.get(attribute, attribute))
    some = nodes.filter(value.isNotNull() & (value != "") & F.lower(value).contains(needle.strip().lower()))
    return some.select(value.alias("value")).distinct().orderBy("value").limit(keep)


def tree_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("server", "database", "schema", "type").agg(F.count("*").alias("n"))


def tree_levels(nodes: DataFrame) -> DataFrame:
    """All levels of the hierarchy in one aggregate: ``level, server, database, schema, type, path, n``.

    Level 0 is the whole catalog, 1 to 4 are servers, databases, schemas and types; deeper columns are null, as a schema
    is that an object doesn't have: the level tells them apart. ``path`` is unique, and the rows below a node are a range
    of paths (:func:`children`).
    """
    keys = ("server", "database", "schema", "type")
    some = nodes.select(*keys)
    sets = [[some[k] for k in keys[:i]] for i in range(len(keys) + 1)]
    rows = some.groupingSets(sets, *[some[k] for k in keys]).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))
    level = F.lit(4) - F.bit_count("gid").cast("int")
    parts = [F.when(F.lit(i) < level, F.coalesce(F.concat(F.lit("="), F.replace(F.replace(F.col(k), F.lit("!"), F.lit("!1")), F.lit("/"), F.lit("!2"))), F.lit("-"))) for i, k in enumerate(keys)]
    return rows.filter((level > 0) | (F.col("n") > 0)).select(level.cast("long").alias("level"), *keys, F.concat_ws("/", F.lit(""), *parts).alias("path"), "n")


def children(levels: DataFrame, path: str) -> DataFrame:
    """The rows one level below the node at ``path`` of :func:`tree_levels`, read as a range of paths."""
    depth = path.count("/")
    return levels.filter((F.col("path") > f"{path}/") & (F.col("path") < f"{path}0") & (F.col("level") == depth + 1))


def tree(nodes: DataFrame) -> DataFrame:
    """(server, databases): databases, schemas, types and objects nested in order. A server's tree is one row, as a page shows it."""
    steps = ("database", "schema", "type")
    out = nodes.groupBy("server", *steps).agg(F.sort_array(F.collect_list(F.struct("name", "id"))).alias("objects"))
    inside = "objects"
    for k in (2, 1, 0):
        out = out.groupBy("server", *steps[:k]).agg(F.sort_array(F.collect_list(F.struct(steps[k], inside))).alias(steps[k] + "s"))
        inside = steps[k] + "s"
    return out


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def totals(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.countDistinct("server").alias("servers"), F.countDistinct("server", "database").alias("databases"), F.count("*").alias("objects"))


def filter_cascade(nodes: DataFrame, databases: tuple, schemas: tuple, names: tuple) -> DataFrame:
    """Database, then schema, then object name; each is (include, exclude). Objects without a schema go. For those of a whole server see :func:`server_objects`."""
    return nodes.filter(name_filter(F.col("database"), *databases) & F.col("schema").isNotNull() & name_filter(F.col("schema"), *schemas) & name_filter(F.col("name"), *names))


def server_objects(objects: DataFrame, names: tuple) -> DataFrame:
    """Linked servers and publications have no schema: their names alone decide."""
    return objects.filter(name_filter(F.col("name"), *names))
