"""Catalog-view queries: relational extraction and reconstruction of definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_agg(value: str, order: str, separator: str = ", ") -> Column:
    """Ordered string aggregation; null for an empty group."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]), separator)


def type_suffix(kind: Column, length: Column, precision: Column, scale: Column) -> Column:
    low = F.lower(kind)
    sized = lambda n: F.when(length == -1, "(MAX)").otherwise(F.concat(F.lit("("), n.cast("string"), F.lit(")")))
    return (
        F.when(low.isin("varchar", "char", "varbinary", "binary"), sized(length))
        .when(low.isin("nvarchar", "nchar"), sized(F.floor(length / 2).cast("int")))
        .when(low.isin("decimal", "numeric"), F.concat(F.lit("("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")")))
        .otherwise("")
    )


def quoted(name: Column) -> Column:
    """A name in brackets, closing ones doubled."""
    return F.concat(F.lit("["), F.replace(name, F.lit("]"), F.lit("]]")), F.lit("]"))


def _listed(column: str, order: str, when: Column) -> Column:
    """The texts of a group's rows that fulfil a condition, in order and parted by commas; empty without any."""
    pairs = F.array_sort(F.collect_list(F.when(when, F.struct(F.col(order).alias("o"), F.col(column).alias("v")))))
    return F.array_join(F.transform(pairs, lambda x: x["v"]), ", ")


def column_definitions(columns: DataFrame, types: DataFrame, identities: DataFrame, defaults: DataFrame) -> DataFrame:
    """(object_id, column_id, line) of every column: name, type with its length, identity, nullability and default."""
    kind = types.select("user_type_id", F.col("name").alias("kind"))
    rows = columns.join(kind, "user_type_id").join(identities, ["object_id", "column_id"], "left").join(defaults, ["object_id", "column_id"], "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(1)).cast("string")
    identity = F.when(F.col("is_identity"), F.concat(F.lit(" IDENTITY("), number("seed_value"), F.lit(","), number("increment_value"), F.lit(")"))).otherwise("")
    null = F.when(F.col("is_nullable"), " NULL").otherwise(" NOT NULL")
    line = F.concat(F.lit("    "), quoted(F.col("name")), F.lit(" "), F.upper("kind"), type_suffix(F.col("kind"), F.col("max_length"), F.col("precision"), F.col("scale")), identity, null, F.coalesce(F.concat(F.lit(" DEFAULT "), "definition"), F.lit("")))
    return rows.select("object_id", "column_id", line.alias("line"))


def table_ddl(tables: DataFrame, columns: DataFrame, types: DataFrame, identities: DataFrame, defaults: DataFrame, keys: DataFrame) -> DataFrame:
    """(schema, table, ddl): CREATE TABLE from catalog views; ``keys`` (object_id, constraint, key_ordinal, column, descending) are primary keys.

    Column lines end in CR LF and the list begins with one, as the view query builds it; a table without columns has none.
    """
    body = column_definitions(columns, types, identities, defaults).groupBy("object_id").agg(list_agg("line", "column_id", ",\r\n").alias("body"))
    key = keys.withColumn("part", F.concat(quoted(F.col("column")), F.when(F.col("descending"), " DESC").otherwise(" ASC")))
    key = key.groupBy("object_id", "constraint").agg(list_agg("part", "key_ordinal").alias("parts"))
    key = key.select("object_id", F.concat(F.lit(",\n  CONSTRAINT "), quoted(F.col("constraint")), F.lit(" PRIMARY KEY ("), "parts", F.lit(")")).alias("key"))
    rows = tables.select("object_id", "schema", F.col("name").alias("table")).join(body, "object_id", "left").join(key, "object_id", "left")
    ddl = F.concat(F.lit("CREATE TABLE ["), "schema", F.lit("].["), "table", F.lit("] (\n"), F.coalesce(F.concat(F.lit("\r\n"), "body"), F.lit("")), F.coalesce("key", F.lit("")), F.lit("\n);"))
    return rows.select("schema", "table", ddl.alias("ddl"))


def _alter(constraint: str) -> Column:
    return F.concat(F.lit("ALTER TABLE "), quoted(F.col("schema")), F.lit("."), quoted(F.col("table")), F.lit(" ADD CONSTRAINT "), quoted(F.col(constraint)))


def fk_ddl(keys: DataFrame) -> DataFrame:
    """(schema, table, constraint, ddl): ALTER TABLE per constraint from its column pairs in order."""
    pairs = keys.withColumns({"a": quoted(F.col("column")), "b": quoted(F.col("target_column"))})
    g = pairs.groupBy("schema", "table", "constraint", "target_schema", "target").agg(list_agg("a", "ordinal").alias("cols"), list_agg("b", "ordinal").alias("refs"))
    text = F.concat(_alter("constraint"), F.lit(" FOREIGN KEY ("), "cols", F.lit(") REFERENCES "), quoted(F.col("target_schema")), F.lit("."), quoted(F.col("target")), F.lit(" ("), "refs", F.lit(");"))
    return g.select("schema", "table", "constraint", text.alias("ddl"))


def check_ddl(checks: DataFrame) -> DataFrame:
    return checks.select("schema", "table", "name", F.concat(_alter("name"), F.lit(" CHECK "), "definition", F.lit(";")).alias("ddl"))


def synonym_ddl(synonyms: DataFrame) -> DataFrame:
    return synonyms.select("schema", "name", F.concat(F.lit("CREATE SYNONYM ["), "schema", F.lit("].["), "name", F.lit("] FOR "), "base", F.lit(";")).alias("ddl"))


def schema_ddl(schemas: DataFrame) -> DataFrame:
    """CREATE SCHEMA; of an Oracle user its own ``user_ddl``, or a comment where that couldn't be read. Without that column: SQL Server."""
    name = F.col("schema")
    if "user_ddl" in schemas.columns:
        return schemas.select("schema", F.coalesce("user_ddl", F.concat(F.lit("-- Oracle schema/user: "), name)).alias("ddl"))
    return schemas.select("schema", F.concat(F.lit("CREATE SCHEMA ["), name, F.lit("];")).alias("ddl"))


def index_ddl(indexes: DataFrame) -> DataFrame:
    """(schema, table, name, ddl) from index columns; keys of constraints and heaps are left out, kinds that can't be run become a comment.

    Key columns go by ``key_ordinal`` with their direction, included ones by ``index_column_id``; INCLUDE only where there are any.
    """
    rows = indexes.filter("not is_primary_key and not is_unique_constraint and index_id > 0 and name is not null")
    part = F.concat(quoted(F.col("column")), F.when(F.col("included"), "").when(F.col("descending"), " DESC").otherwise(" ASC"))
    g = rows.withColumn("part", part).groupBy("schema", "table", "name", "is_unique", "kind").agg(_listed("part", "key_ordinal", ~F.col("included")).alias("keys"), _listed("part", "index_column_id", F.col("included")).alias("extras"))
    text = F.concat(F.lit("CREATE "), F.when(F.col("is_unique"), "UNIQUE ").otherwise(""), "kind", F.lit(" INDEX ["), "name", F.lit("] ON ["), "schema", F.lit("].["), "table", F.lit("] ("), "keys", F.lit(")"), F.when(F.trim("extras") != "", F.concat(F.lit(" INCLUDE ("), "extras", F.lit(")"))).otherwise(""), F.lit(";"))
    other = F.concat(F.lit("-- Index ["), "name", F.lit("] ("), "kind", F.lit(") - see sys.indexes for full definition"))
    return g.select("schema", "table", "name", F.when(F.col("kind").isin("CLUSTERED", "NONCLUSTERED"), text).otherwise(other).alias("ddl"))


# The parameters of a linked server in the order of its script, and the comment before a login.
SERVER_PARAMETERS = (("srvproduct", "product"), ("provider", "provider"), ("datasrc", "data_source"), ("provstr", "provider_string"), ("catalog", "catalog"))
LOGIN_NOTE = "-- Remote login mapping (password not extracted; re-set manually after restore):"


def linked_servers(servers: DataFrame, logins: DataFrame) -> DataFrame:
    """(server, script): one script per linked server, with two lines per login that has a remote name; passwords are a placeholder.

    ``logins`` (server, principal, remote, self): those of principal 0 don't count; they go by remote name.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    some = logins.filter("principal <> 0")
    use = F.when(F.col("self"), "TRUE").otherwise("FALSE")
    line = F.concat(F.lit(LOGIN_NOTE + "\nEXEC sp_addlinkedsrvlogin @rmtsrvname = N'"), "server", F.lit("', @useself = N'"), use, F.lit("', @rmtuser = N'"), "remote", F.lit("', @rmtpassword = N'########';"))
    some = some.filter("trim(remote) <> ''").withColumn("line", line).groupBy("server").agg(list_agg("line", "remote", "\n").alias("lines"))
    head = [F.lit("EXEC sp_addlinkedserver\n    @server = N'"), F.col("server")]
    for parameter, column in SERVER_PARAMETERS:
        head += [F.lit(f"',\n    @{parameter} = N'"), text(column)]
    rows = servers.join(some, "server", "left")
    return rows.select("server", F.concat(*head, F.lit("';\nGO"), F.coalesce(F.concat(F.lit("\n"), "lines"), F.lit(""))).alias("script"))


def replication(publications: DataFrame, articles: DataFrame) -> DataFrame:
    """(publication, script): name, description where there is one, its articles by name or ``(none)``, and what isn't listed."""
    bullets = articles.withColumn("b", F.concat(F.lit("--   - "), "article")).groupBy("publication").agg(list_agg("b", "article", "\n").alias("body"))
    rows = publications.join(bullets, "publication", "left")
    description = F.when(F.trim("description") != "", F.concat(F.lit("-- Description: "), "description"))
    last = F.lit("-- Subscribers are not enumerated - see Replication Monitor for current subscription state.")
    return rows.select("publication", F.concat_ws("\n", F.concat(F.lit("-- Publication: "), "publication"), description, F.lit("-- Articles (replicated objects):"), F.coalesce("body", F.lit("--   (none)")), last).alias("script"))


def run_summary(files: DataFrame, failures: DataFrame) -> DataFrame:
    """(server, files, failed): files written by server, and whether the server failed."""
    n = files.groupBy("server").agg(F.count("*").alias("files"))
    bad = failures.select("server", F.lit(True).alias("failed")).distinct()
    return n.join(bad, "server", "full").select("server", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("failed", F.lit(False)).alias("failed"))


def lateral_stats(statistics: DataFrame, properties: DataFrame) -> DataFrame:
    """CROSS APPLY of a table function, decorrelated to an inner join: (id, stats_id, name, rows, rowsSampled, steps, modificationCounter, lastUpdated).

    Statistics without a name, or for which the function gives no row, go.
    """
    return statistics.filter("name is not null").join(properties, ["id", "stats_id"])


def owner_objects(objects: DataFrame, owner: str, kind: str) -> DataFrame:
    return objects.filter((F.col("owner") == owner) & (F.col("type") == kind) & (F.col("generated") == "N") & (F.col("temporary") == "N"))


def allowed(objects: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Objects of the allowed types, compared without case; none allowed: none."""
    return objects.filter(F.lower("type").isin([k.lower() for k in kinds]) if kinds else F.lit(False))


def online_databases(databases: DataFrame) -> DataFrame:
    """(name) of databases whose state is 0, by name."""
    return databases.filter("state = 0").select("name").orderBy("name")


def schemas_with_owner(schemas: DataFrame, principals: DataFrame) -> DataFrame:
    """(schema, owner) of schemas (name, principal_id) whose principal (principal_id, name) is known."""
    return schemas.select(F.col("name").alias("schema"), "principal_id").join(principals.select("principal_id", F.col("name").alias("owner")), "principal_id").select("schema", "owner")


# Codes of objects with a definition.
MODULES = ("P", "V", "TR", "FN", "IF", "TF")


def module_objects(objects: DataFrame, schemas: DataFrame) -> DataFrame:
    """Objects (schema_id, code, ...) that have a definition, with the columns of their schema (schema_id, ...)."""
    return objects.filter(F.col("code").isin(*MODULES)).join(schemas, "schema_id").drop("schema_id")


def owners(objects: DataFrame) -> DataFrame:
    """(owner) once each, by name."""
    return objects.select("owner").distinct().orderBy("owner")
