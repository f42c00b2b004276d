"""Object trees, catalog documents and configurations as inputs; catalog documents as output."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provenir.functions.scalar import normalised
from provenir.operators.catalog import SNAPSHOT, VERSION
from provenir.sources import jdbc

CATALOG = f"""generatedAt string, servers array<string>, typeCounts map<string,long>,
nodes array<struct<id:string,server:string,database:string,type:string,schema:string,name:string,qualifiedName:string,path:string,ddl:string,description:string,
columns:array<struct<name:string,description:string,dataType:string>>,grants:array<struct<permission:string,state:string,grantee:string,granteeType:string,column:string>>,
sections:array<struct<title:string,content:string>>,sizeBytes:long,metrics:array<struct<{SNAPSHOT}>>,changeCount:long,lastChangedAt:string,history:{VERSION}>>,
edges array<struct<`from`:string,`to`:string,columns:array<string>>>,
recentChanges array<struct<sha:string,date:string,message:string,objectIds:array<string>>>,
coChangePairs array<struct<a:string,b:string,count:long>>"""


def object_files(spark: SparkSession, root: str, pattern: str = "*.sql") -> DataFrame:
    """(path, text) of every matching file below ``root``, the path relative to it."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return rows.select(F.expr("value").alias("text"), F.col("_metadata.file_path").alias("full")).select(relative("full", root).alias("path"), "text")


def relative(full: str, root: str) -> Column:
    """A file's path below ``root``, which is cut off as it stands, without case."""
    path = F.regexp_replace(full, r"^\w+:/*", "/")
    base = re.sub(r"^\w+:/*", "/", root).replace("\\", "/").rstrip("/") + "/"
    return F.when(F.lower(F.left(path, F.lit(len(base)))) == base.lower(), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def optional(spark: SparkSession, read: Callable[[], DataFrame], schema: str, warnings: list[str], what: str) -> DataFrame:
    """An input that may be missing: what ``read`` gives, or an empty frame of the schema and a warning."""
    try:
        df = read()
        df.isEmpty()  # a source that can't be opened fails here, not later
        return df
    except Exception as problem:  # noqa: BLE001  whatever a source fails with, the run goes on without it
        warnings.append(f"{what}: {str(problem).splitlines()[0] if str(problem) else type(problem).__name__}")
        return spark.createDataFrame([], schema)


def json_rows(spark: SparkSession, root: str, schema: str, warnings: list[str]) -> DataFrame:
    """(path, rows) of every JSON file below ``root`` that holds a list or one object; others are named in ``warnings`` and count as empty."""
    found = object_files(spark, root, "*.json").select("path", normalised(F.col("text"), schema).alias("rows"))
    bad = [r["path"] for r in found.filter("rows is null").select("path").limit(100).collect()]
    warnings += [f"{p}: no JSON list" for p in bad]
    empty = F.array().cast(StructType.fromDDL(f"rows array<struct<{schema}>>")[0].dataType)
    return found.withColumn("rows", F.coalesce("rows", empty))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG).json(path, multiLine=True)


def write_catalog(df: DataFrame, path: str) -> None:
    """One compact JSON document a row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def jdbc_options(url: str, query: str, parameters: dict | None = None, **options: str) -> dict[str, str]:
    """Options of a JDBC scan of one query; ``:name`` in it takes its parameter as a literal."""
    return jdbc.options(url, **options) | {"query": jdbc.bound(query, parameters)}


# Settings of an Oracle session that keep definitions free of storage clauses, and queries of its views.
ORACLE_TRANSFORMS = {"STORAGE": "FALSE", "SEGMENT_ATTRIBUTES": "FALSE", "SQLTERMINATOR": "TRUE", "PRETTY": "TRUE"}
ORACLE_LINKS = "SELECT owner, db_link FROM all_db_links ORDER BY owner, db_link"


def oracle_session() -> str:
    """The block to run as ``sessionInitStatement``."""
    calls = (f"DBMS_METADATA.SET_TRANSFORM_PARAM(DBMS_METADATA.SESSION_TRANSFORM, '{name}', {value});" for name, value in ORACLE_TRANSFORMS.items())
    return "BEGIN " + " ".join(calls) + " END;"


def oracle_ddl(owner: str, object_type: str, ddl_type: str | None = None) -> dict:
    """Query and parameters for the definitions of all objects of an owner and type at once, not one by one."""
    query = (
        "SELECT object_name, DBMS_METADATA.GET_DDL(:ddl_type, object_name, owner) AS ddl FROM all_objects "
        "WHERE owner = :owner AND object_type = :object_type AND generated = 'N' AND temporary = 'N'"
    )
    return {"query": query, "parameters": {"ddl_type": ddl_type or object_type.replace(" ", "_"), "owner": owner, "object_type": object_type}}


def database_links(spark: SparkSession, url: str, **options: str) -> DataFrame:
    return jdbc.read(spark, url, ORACLE_LINKS, session=oracle_session(), **options)


def oracle_definitions(spark: SparkSession, url: str, owner: str, object_type: str, failures: list[tuple[str, str]], **options: str) -> DataFrame:
    """(name, ddl) of an owner's objects of a type, fetched at once; objects that can't be read are noted in ``failures``."""
    asked = oracle_ddl(owner, object_type)
    names = asked["query"].replace(", DBMS_METADATA.GET_DDL(:ddl_type, object_name, owner) AS ddl", "")
    return jdbc.read_in_sets(spark, url, asked["query"], "object_name", "name string, ddl string", failures, asked["parameters"], keys=names, session=oracle_session(), **options)


def load_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return check_config(json.load(f))


def check_config(config: dict) -> dict:
    """At least one server, each with a name, a known type, a host and a credentials prefix."""
    servers = config.get("servers") or []
    if not servers:
        raise ValueError("the configuration names no server")
    for s in servers:
        for key in ("name", "type", "host", "credentialsVariablePrefix"):
            if not s.get(key):
                raise ValueError(f"server {s.get('name', '?')}: {key} is missing")
        if s["type"] not in ("mssql", "oracle"):
            raise ValueError(f"server {s['name']}: unknown type {s['type']}")
        if s["type"] == "oracle" and not s.get("serviceName"):
            raise ValueError(f"server {s['name']}: serviceName is missing")
    return config
