"""Grants: who may do what on which object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grantee_search(grants: DataFrame, needle: str, *, exact: bool = False) -> DataFrame:
    """Grants whose grantee equals or contains the text, case ignored; a blank text finds none."""
    needle = needle.strip().lower()
    low = F.lower("grantee")
    return grants.filter((low == needle if exact else low.contains(needle)) if needle else F.lit(False))


def grantee_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("id").agg(F.count("*").alias("n_grants"))


def suggest_grantees(grants: DataFrame, needle: str, keep: int = 20) -> DataFrame:
    return grants.filter(F.lower("grantee").contains(needle.strip().lower())).select("grantee").distinct().orderBy("grantee").limit(keep)


def tag() -> Column:
    """``PERMISSION(column) [DENY]``."""
    column = F.when(F.col("column").isNotNull(), F.concat(F.lit("("), "column", F.lit(")"))).otherwise("")
    return F.concat("permission", column, F.when(F.upper("state") == "DENY", " [DENY]").otherwise(""))


def union_grants(objects: DataFrame, columns: DataFrame) -> DataFrame:
    """Object grants, then column grants, of a server that knows neither DENY nor kinds of grantees."""
    both = objects.unionByName(columns, allowMissingColumns=True)
    return both.withColumns({"state": F.lit("GRANT"), "granteeType": F.lit(None).cast("string")})


def object_grants(permissions: DataFrame, columns: DataFrame) -> DataFrame:
    """Plain GRANT and DENY rows with the column's name where the grant is on a column."""
    some = permissions.filter(F.col("state").isin("GRANT", "DENY"))
    match = (some["id"] == columns["id"]) & (some["minor_id"] == columns["column_id"]) & (some["minor_id"] != 0)
    return some.join(columns, match, "left").select(some["id"], "permission", "state", "grantee", columns["name"].alias("column"))
