"""Queries over parsing, lineage, extraction, metrics and scalar operators; see ``queries`` for the adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenir.functions import scalar
from provenir.operators import catalog, extract, history, lineage, metrics, parse
from provenir.plans.queries import NODES, SERIES, changed, document_nodes, event_series, object_text, parsed, part_nodes, query, sql_columns, sql_nodes, touched
from provenir.storage import shuffled, spread

# -- parsing ---------------------------------------------------------------------------------------------------------

HEAD = "'-- Generated file; edits are overwritten.' || chr(10) || '-- Server: S' || chr(10) || '-- Database: D' || chr(10) || '-- Type: Tables' || chr(10) || '-- Object: ' || p_name || chr(10) || chr(10) || 'CREATE TABLE ' || p_brand || ' (' || chr(10) || '  key bigint' || chr(10) || ');'"
SECTION = "chr(10) || chr(10) || '-- === {} ===' || chr(10) || "


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS id, {HEAD} || chr(10) AS text FROM part")
def render_object_file(t):
    body = F.concat(F.lit("\n CREATE TABLE "), "p_brand", F.lit(" (\n  key bigint\n);  \n\n"))
    return t("part").select(F.col("p_partkey").cast("string").alias("id"), parse.render(F.lit("S"), F.lit("D"), F.lit("Tables"), F.col("p_name"), body).alias("text"))


NL = " || chr(10) || "
FILE = (
    f"SELECT CAST(p_partkey AS VARCHAR) AS id, {HEAD} || CASE WHEN p_size > 25 THEN {SECTION.format('Indexes')} 'CREATE INDEX i' || p_size ELSE '' END || {SECTION.format('Columns')} "
    + NL.join(("'-- [col] Key|bigint'", "'-- [col] ' || p_brand || '|varchar|' || p_size", "'-- [col] a[0]|'", "'-- [col] |int'"))
    + f" || CASE WHEN p_size % 2 = 0 THEN {SECTION.format('Grants')} '-- [grant] SELECT|GRANT|' || p_brand || '||'{NL}'-- [grant] UPDATE|DENY|' || p_type || '|ROLE|key' ELSE '' END || {SECTION.format('Extended Properties')} "
    + NL.join(
        (
            "'-- [object] MS_Description = '", "'-- [object] My Description = no'", "'-- [object] MS_Description = ' || p_name", "'-- [object] MS_Description = second'",
            "'-- [column: key] MS_Description = first'", "'-- [column: KEY] MS_Description = ' || p_type", "'-- [column: a[0]] Description = x = y'", "'-- [object] Owner = x'",
        )
    )
    + " AS text FROM part"
)
# Lines of the file, each with its section and its place in it; i counts from 1
PARSED = f"""WITH f AS ({FILE}),
l AS (SELECT id, line, i, nullif(regexp_extract(line, '^-- === (.+) ===$', 1), '') AS mark FROM (SELECT id, string_split(text, chr(10)) AS a FROM f), unnest(a) WITH ORDINALITY AS u(line, i)),
s AS (SELECT id, line, i, mark, last_value(mark IGNORE NULLS) OVER w AS title, max(CASE WHEN mark IS NOT NULL THEN i END) OVER w AS start, bool_or(NOT starts_with(line, '-- ')) OVER w AS body FROM l WINDOW w AS (PARTITION BY id ORDER BY i)),
c AS (SELECT id, i - start - 1 AS ordinal, regexp_extract(line, '^-- \\[col\\] ([^|]*)\\|(.*)$', 1) AS name, regexp_extract(line, '^-- \\[col\\] ([^|]*)\\|(.*)$', 2) AS "dataType" FROM s WHERE title = 'Columns' AND mark IS NULL AND regexp_matches(line, '^-- \\[col\\] ([^|]*)\\|')),
p AS (SELECT id, i - start - 1 AS ordinal, nullif(regexp_extract(line, '^-- \\[column: (.+?)\\] (\\S+) = (.*)$', 1), '') AS col, regexp_extract(line, '^-- \\[(?:object|column: .+?)\\] (\\S+) = (.*)$', 1) AS property, regexp_extract(line, '^-- \\[(?:object|column: .+?)\\] (\\S+) = (.*)$', 2) AS d FROM s WHERE title = 'Extended Properties' AND mark IS NULL),
d AS (SELECT id, arg_min(col, ordinal) AS "column", CASE WHEN lower(col) IS NULL THEN coalesce(arg_min(d, ordinal) FILTER (WHERE d <> ''), '') ELSE arg_max(d, ordinal) END AS description, min(ordinal) AS ordinal FROM p WHERE contains(lower(property), 'description') GROUP BY id, lower(col))"""


@query(FILE)
def append_sections(t):
    return object_text(t)


@query(PARSED + " SELECT id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE title IS NULL AND body AND line <> '') AS ddl, string_agg(mark, ',' ORDER BY i) AS titles FROM s GROUP BY id")
def section_split(t):
    return parsed(t).select("id", "ddl", F.array_join(F.transform("sections", lambda s: s["title"]), ",").alias("titles"))


@query(PARSED + " SELECT * FROM c")
def parse_columns(t):
    return parse.columns(parsed(t))


GRANT = r"'^-- \[grant\] ([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$'"


@query(PARSED + f" SELECT id, regexp_extract(line, {GRANT}, 1) AS permission, regexp_extract(line, {GRANT}, 2) AS state, regexp_extract(line, {GRANT}, 3) AS grantee, nullif(regexp_extract(line, {GRANT}, 4), '') AS \"granteeType\", nullif(regexp_extract(line, {GRANT}, 5), '') AS \"column\" FROM s WHERE title = 'Grants' AND mark IS NULL AND regexp_matches(line, {GRANT})")
def parse_grants(t):
    return parse.grants(parsed(t))


@query(PARSED + " SELECT * FROM d")
def parse_extended_props(t):
    return parse.properties(parsed(t))


@query(PARSED + ' SELECT c.*, d.description FROM c LEFT JOIN d ON c.id = d.id AND lower(c.name) = lower(d."column") UNION ALL SELECT d.id, d.ordinal, d."column", NULL, d.description FROM d WHERE "column" IS NOT NULL AND id NOT IN (SELECT id FROM c)')
def merge_columns(t):
    return parse.described_columns(parsed(t))


@query(PARSED + " SELECT id, title, string_agg(line, chr(10) ORDER BY i) AS content FROM s WHERE title NOT IN ('Extended Properties', 'Columns', 'Grants') AND mark IS NULL AND line <> '' GROUP BY id, title")
def parse_other_sections(t):
    return parse.other_sections(parsed(t))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, min_by(line, i) AS first_line, max_by(line, i) AS last_line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id")
def first_last_wins(t):
    lines = t("documents").select(F.col("doc_id").cast("string").alias("id"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.groupBy("id").agg(F.min_by("line", "i").alias("first_line"), F.max_by("line", "i").alias("last_line"))


PATHS = "WITH p AS (SELECT regexp_replace(url, '^https?://|[?#].*$', '', 'g') || '.sql' AS path FROM pages), s AS (SELECT path, string_split(path, '/') AS s FROM p)"


@query(PATHS + " SELECT regexp_replace(path, '(?i)\\.sql$', '') AS id, s[1] AS server, s[2] AS database, s[3] AS type, CASE WHEN len(s) = 5 THEN s[4] END AS schema, regexp_replace(s[-1], '\\.[^.]*$', '') AS name, CASE WHEN len(s) = 5 THEN s[4] || '.' ELSE '' END || regexp_replace(s[-1], '\\.[^.]*$', '') AS \"qualifiedName\" FROM s WHERE len(s) >= 4")
def object_path_parse(t):
    path = F.concat(F.regexp_replace("url", r"^https?://|[?#].*$", ""), F.lit(".sql"))
    return parse.parse_path(t("pages").select(path.alias("path")))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, concat_ws('.', nullif(lang, 'en'), source) AS qualified_name, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents")
def node_build(t):
    return t("documents").select(F.col("doc_id").cast("string").alias("id"), F.concat_ws(".", F.nullif(F.col("lang"), F.lit("en")), "source").alias("qualified_name"), scalar.size_bytes(F.col("text")).cast("long").alias("size_bytes"))


# -- lineage ---------------------------------------------------------------------------------------------------------

# Letters, digits and underscores of Unicode, as a class
W = r"\p{L}\p{M}\p{Nd}\p{Pc}"
DOCUMENTS = rf"""WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS server, source AS database, CAST(NULL AS VARCHAR) AS schema, lower(regexp_extract(text, '(?:^|[^{W}])([A-Za-z]{{8,}})(?:$|[^{W}])', 1)) AS name, text AS scan FROM documents)"""
BARE = rf"""r AS (SELECT DISTINCT id, lower(server) AS server, lower(database) AS database, unnest(regexp_extract_all(scan, '[{W}$#]+')) AS run FROM n),
k AS (SELECT DISTINCT id, server, database, lower(regexp_extract(run, '(?:^|[$#])([A-Za-z_][{W}$#]{{2,}}[{W}])', 1)) AS token FROM r),
d AS (SELECT lower(server) AS server, lower(database) AS database, lower(name) AS token, min(id) AS db_id FROM n GROUP BY 1, 2, 3 HAVING count(*) = 1), s AS (SELECT lower(server) AS server, lower(name) AS token, min(id) AS server_id FROM n GROUP BY 1, 2 HAVING count(*) = 1),
bare AS (SELECT DISTINCT id AS "from", coalesce(db_id, server_id) AS "to" FROM k LEFT JOIN d USING (server, database, token) LEFT JOIN s USING (server, token) WHERE token <> '' AND coalesce(db_id, server_id) <> id)"""
NAME = rf"\[?([A-Za-z_][{W}$#]*)\]?\.\[?([A-Za-z_][{W}$#]*)\]?"
QUALIFIED = f"""q AS (SELECT id, lower(server) AS server, lower(database) AS database, lower(unnest(regexp_extract_all(scan, '{NAME}', 1))) AS s, lower(unnest(regexp_extract_all(scan, '{NAME}', 2))) AS nm FROM n),
x AS (SELECT lower(server) AS server, lower(database) AS database, lower(schema) AS s, lower(name) AS nm, max(id) AS "to" FROM n WHERE schema IS NOT NULL GROUP BY 1, 2, 3, 4),
qualified AS (SELECT DISTINCT id AS "from", "to" FROM q JOIN x USING (server, database, s, nm) WHERE id <> "to")"""
PROCEDURES = """WITH pl AS (SELECT n_nationkey AS k, translate(lower(r_name), ' ', '_') AS rs, CASE WHEN n_nationkey = 3 THEN 'Größe' ELSE translate(lower(n_name), ' ', '_') END AS ns FROM nation JOIN region ON n_regionkey = r_regionkey),
n0 AS (SELECT 't' || k AS id, 'S' AS server, 'd' AS database, rs AS schema, ns AS name, 'key bigint' AS ddl, NULL AS fk FROM pl UNION ALL
SELECT 'p' || s_suppkey, 's', 'D', 'dbo', 'sp' || s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'SELECT 1' WHEN 1 THEN 'SELECT db.' || rs || '.' || ns || ', ' || rs || '.' || ns || '.Total FROM ' || ns
ELSE 'SELECT q.Name, q.[Key], q.Nothing, q.[Unit Price], [q].[Total] FROM ' || rs || '.[' || ns || '] AS q WHERE q.name = 1' END, CASE WHEN s_suppkey % 5 = 0 THEN 'REFERENCES [' || rs || '].[' || ns || '] (Key)' END FROM supplier JOIN pl ON k = s_nationkey),
n AS (SELECT *, concat_ws(chr(10), ddl, fk) AS scan FROM n0)"""
EDGES = 'e AS (SELECT "from", "to" FROM qualified UNION SELECT "from", "to" FROM bare)'


@query(f'{DOCUMENTS}, {BARE} SELECT "from", "to" FROM bare')
def lineage_bare(t):
    return lineage.bare_edges(document_nodes(t))


@query(f'{DOCUMENTS}, {BARE}, {QUALIFIED}, {EDGES}, n2 AS (SELECT 1) SELECT "from", "to" FROM e UNION ALL SELECT "from", "to" FROM ({PROCEDURES}, {BARE}, {QUALIFIED}, {EDGES} SELECT "from", "to" FROM e)')
def lineage_edges(t):
    return lineage.edges(document_nodes(t)).unionByName(lineage.edges(sql_nodes(t)))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, concat_ws(chr(10), text, nullif(source, 'src1')) AS text FROM documents")
def lineage_scan_text(t):
    return t("documents").select(F.col("doc_id").cast("string").alias("id"), lineage.scan_text(F.col("text"), F.nullif(F.col("source"), F.lit("src1"))).alias("text"))


@query(f'{PROCEDURES}, {QUALIFIED} SELECT "from", "to" FROM qualified')
def lineage_qualified(t):
    return lineage.qualified_edges(sql_nodes(t))


# Per edge, the pattern of the target's name and what follows it
ALIASES = rf"""{PROCEDURES}, {BARE}, {QUALIFIED}, {EDGES},
a0 AS (SELECT "from", "to", f.ddl, lower(g.name) AS own, list_append(list_transform(regexp_extract_all(f.ddl, '(?i)' || CASE WHEN g.schema IS NULL THEN '' ELSE '(?:\[?' || regexp_escape(g.schema) || '\]?\.)?' END || '\[?' || regexp_escape(g.name) || '\]?\s+(?:AS\s+)?\[?([A-Za-z_][{W}$#]*)\]?', 1), lambda y: lower(y)), lower(g.name)) AS names FROM e JOIN n f ON f.id = "from" JOIN n g ON g.id = "to"),
a AS (SELECT DISTINCT "from", "to", ddl, own, unnest(names) AS alias FROM a0),
aliases AS (SELECT "from", "to", ddl, alias FROM a WHERE alias = own OR upper(alias) NOT IN ({", ".join(f"'{w}'" for w in lineage.STOP)}))"""


@query(ALIASES + ' SELECT "from", "to", alias FROM aliases')
def lineage_aliases(t):
    n = sql_nodes(t)
    return lineage.aliases(lineage.edges(n), n)


@query(
    ALIASES
    + rf""", c AS (SELECT 't' || n_nationkey AS "to", unnest(['name', 'Key', 'Total', 'unit price']) AS col FROM nation),
h AS (SELECT "from", "to", col, max(regexp_extract(ddl, '(?i)(?:^|[^{W}])' || regexp_escape(alias) || '\.\[?(' || regexp_escape(col) || ')(?:\]|$|[^{W}])', 1)) AS spelled FROM aliases JOIN c USING ("to") GROUP BY 1, 2, 3)
SELECT e."from", e."to", coalesce(string_agg(spelled, ',' ORDER BY spelled) FILTER (WHERE spelled <> ''), '') AS columns FROM e LEFT JOIN h USING ("from", "to") GROUP BY 1, 2"""
)
def lineage_columns(t):
    n = sql_nodes(t)
    return lineage.column_refs(lineage.edges(n), n, sql_columns(t)).withColumn("columns", F.array_join("columns", ","))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS id, CASE WHEN count(*) <= 3 THEN string_agg(c, ', ' ORDER BY c) ELSE list_aggregate(list_sort(list(c))[1:3], 'string_agg', ', ') || ', +' || (count(*) - 3) || ' (click)' END AS label FROM (SELECT DISTINCT l_orderkey, CAST(l_partkey AS VARCHAR) AS c FROM lineitem) GROUP BY l_orderkey")
def edge_labels(t):
    lists = t("lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("c")).distinct().groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.sort_array(F.collect_list("c")).alias("cols"))
    return lists.select("id", lineage.edge_label(F.col("cols")).alias("label"))


# -- extraction ------------------------------------------------------------------------------------------------------


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 1 ORDER BY name")
def scan_filter_sorted(t):
    return extract.online_databases(t("nation").select(F.col("n_name").alias("name"), (F.col("n_regionkey") - 1).alias("state")))


@query("SELECT n_name AS schema, r_name AS owner FROM nation JOIN region ON n_regionkey = r_regionkey")
def schemas_with_owner(t):
    owners = t("region").select(F.col("r_regionkey").alias("principal_id"), F.col("r_name").alias("name"))
    return extract.schemas_with_owner(t("nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("principal_id")), F.broadcast(owners))


@query("SELECT r_name AS schema, n_name AS name, s_name AS object, CASE s_suppkey % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'V' ELSE 'FN' END AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 4 <> 3")
def module_objects(t):
    code = F.when(F.col("s_suppkey") % 4 == 0, "P").when(F.col("s_suppkey") % 4 == 1, "V").when(F.col("s_suppkey") % 4 == 2, "FN").otherwise("U")
    places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    schemas = places.select(F.col("n_nationkey").alias("schema_id"), F.col("r_name").alias("schema"), F.col("n_name").alias("name"))
    return extract.module_objects(t("supplier").select(F.col("s_nationkey").alias("schema_id"), F.col("s_name").alias("object"), code.alias("code")), F.broadcast(schemas))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CASE p_size % 5 WHEN 0 THEN 'StoredProcedures' WHEN 1 THEN 'Views' WHEN 2 THEN 'Triggers' WHEN 3 THEN 'Functions' END AS type FROM part WHERE p_size % 5 <> 4")
def type_code_map(t):
    code = F.get(F.array(*[F.lit(x) for x in ("P", "V", "TR", "IF", "XX")]), F.col("p_size") % 5)
    return t("part").select(F.col("p_partkey").cast("string").alias("id"), scalar.lookup(scalar.TYPE_CODES, code).alias("type")).filter("type is not null")


@query("SELECT DISTINCT c_mktsegment AS owner FROM customer ORDER BY owner")
def distinct_owners(t):
    return extract.owners(t("customer").select(F.col("c_mktsegment").alias("owner")))


@query("SELECT c_mktsegment AS owner, CAST(c_nationkey AS VARCHAR) AS type, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3 AND c_acctbal >= 0 AND c_acctbal < 9000")
def owner_objects(t):
    rows = t("customer").select(F.col("c_mktsegment").alias("owner"), F.col("c_nationkey").cast("string").alias("type"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") < 0, "Y").otherwise("N").alias("generated"), F.when(F.col("c_acctbal") >= 9000, "Y").otherwise("N").alias("temporary"))
    return extract.owner_objects(rows, "BUILDING", "3").drop("generated", "temporary")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS type FROM orders WHERE o_orderstatus IN ('F', 'P')")
def allowed_types(t):
    return extract.allowed(t("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("type")), ("f", "P"))


KINDS = ("varchar", "nvarchar", "decimal", "int")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CASE p_size % 4 WHEN 0 THEN CASE WHEN p_size = 8 THEN '(MAX)' ELSE '(' || p_size || ')' END WHEN 1 THEN '(' || (p_size // 2) || ')' WHEN 2 THEN '(' || p_size || ',2)' ELSE '' END AS suffix FROM part")
def type_suffix(t):
    kind = F.get(F.array(*[F.lit(x) for x in KINDS]), F.col("p_size") % 4)
    length = F.when(F.col("p_size") == 8, -1).otherwise(F.col("p_size"))
    return t("part").select(F.col("p_partkey").cast("string").alias("id"), extract.type_suffix(kind, length, F.col("p_size"), F.lit(2)).alias("suffix"))


@query("""WITH c AS (SELECT n_regionkey AS o, n_nationkey AS i, '    [' || replace(n_name || CASE WHEN n_nationkey % 5 = 0 THEN ']' ELSE '' END, ']', ']]') || '] ' || CASE n_nationkey % 3 WHEN 0 THEN 'INT' WHEN 1 THEN 'NVARCHAR(' || (n_nationkey // 2) || ')' ELSE 'DECIMAL(9,2)' END
|| CASE WHEN n_nationkey % 6 = 0 THEN ' IDENTITY(' || CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey ELSE 1 END || ',1)' ELSE '' END || CASE WHEN n_nationkey % 2 = 0 THEN ' NULL' ELSE ' NOT NULL' END || CASE WHEN n_nationkey % 7 = 0 THEN ' DEFAULT ((' || n_nationkey || '))' ELSE '' END AS line FROM nation),
k AS (SELECT n_regionkey AS o, string_agg('[' || n_name || ']' || CASE WHEN n_nationkey % 2 = 0 THEN ' DESC' ELSE ' ASC' END, ', ' ORDER BY n_nationkey DESC) AS parts FROM nation WHERE n_nationkey < 10 AND n_regionkey <> 4 GROUP BY 1)
SELECT r_name AS schema, 'T' || r_regionkey AS "table", 'CREATE TABLE [' || r_name || '].[T' || r_regionkey || '] (' || chr(10) || chr(13) || chr(10) || string_agg(line, ',' || chr(13) || chr(10) ORDER BY i) || coalesce(',' || chr(10) || '  CONSTRAINT [PK_T' || r_regionkey || '] PRIMARY KEY (' || any_value(parts) || ')', '') || chr(10) || ');' AS ddl FROM region JOIN c ON c.o = r_regionkey LEFT JOIN k ON k.o = r_regionkey GROUP BY r_name, r_regionkey""")
def table_ddl(t):
    n, r = F.col("n_nationkey"), t("region")
    tables = r.select(F.col("r_regionkey").alias("object_id"), F.col("r_name").alias("schema"), F.concat(F.lit("T"), F.col("r_regionkey").cast("string")).alias("name"))
    name = F.concat("n_name", F.when(n % 5 == 0, "]").otherwise(""))
    columns = t("nation").select(F.col("n_regionkey").alias("object_id"), n.alias("column_id"), name.alias("name"), (n % 3).alias("user_type_id"), n.alias("max_length"), F.lit(9).alias("precision"), F.lit(2).alias("scale"), (n % 2 == 0).alias("is_nullable"), (n % 6 == 0).alias("is_identity"))
    types = t("region").filter("r_regionkey < 3").select(F.col("r_regionkey").alias("user_type_id"), F.get(F.array(F.lit("int"), F.lit("nvarchar"), F.lit("decimal")), F.col("r_regionkey")).alias("name"))
    own = t("nation").select(F.col("n_regionkey").alias("object_id"), n.alias("column_id"), "n_name")
    identities = own.filter("column_id % 4 = 0").select("object_id", "column_id", F.col("column_id").alias("seed_value"), F.lit(1).alias("increment_value"))
    defaults = own.filter("column_id % 7 = 0").select("object_id", "column_id", F.concat(F.lit("(("), F.col("column_id").cast("string"), F.lit("))")).alias("definition"))
    keys = own.filter("column_id < 10 and object_id <> 4").select("object_id", F.concat(F.lit("PK_T"), F.col("object_id").cast("string")).alias("constraint"), (-F.col("column_id")).alias("key_ordinal"), F.col("n_name").alias("column"), (F.col("column_id") % 2 == 0).alias("descending"))
    return extract.table_ddl(tables, columns, types, identities, defaults, keys)


@query("SELECT 'dbo' AS schema, 'nation' AS \"table\", 'fk_' || r_regionkey AS \"constraint\", 'ALTER TABLE [dbo].[nation] ADD CONSTRAINT [fk_' || r_regionkey || '] FOREIGN KEY (' || string_agg('[' || n_name || ']', ', ' ORDER BY n_nationkey) || ') REFERENCES [' || r_name || '].[r]]' || r_regionkey || '] (' || string_agg('[c' || n_nationkey || ']', ', ' ORDER BY n_nationkey) || ');' AS ddl FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def fk_ddl(t):
    rows = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("r_regionkey").cast("string")
    return extract.fk_ddl(rows.select(F.lit("dbo").alias("schema"), F.lit("nation").alias("table"), F.concat(F.lit("fk_"), key).alias("constraint"), F.col("r_name").alias("target_schema"), F.concat(F.lit("r]"), key).alias("target"), F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("column"), F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("target_column")))


@query("SELECT p_type AS schema, p_brand AS \"table\", 'ck' || p_partkey AS name, 'ALTER TABLE [' || p_type || '].[' || p_brand || '] ADD CONSTRAINT [ck' || p_partkey || '] CHECK (size > ' || p_size || ');' AS ddl FROM part")
def check_ddl(t):
    return extract.check_ddl(t("part").select(F.col("p_type").alias("schema"), F.col("p_brand").alias("table"), F.concat(F.lit("ck"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("(size > "), F.col("p_size").cast("string"), F.lit(")")).alias("definition")))


@query("SELECT 'dbo' AS schema, s_name AS name, 'CREATE SYNONYM [dbo].[' || s_name || '] FOR n' || s_nationkey || ';' AS ddl FROM supplier")
def synonym_ddl(t):
    return extract.synonym_ddl(t("supplier").select(F.lit("dbo").alias("schema"), F.col("s_name").alias("name"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("base")))


@query("SELECT n_name AS schema, 'CREATE SCHEMA [' || n_name || '];' AS ddl FROM nation UNION ALL SELECT r_name, CASE WHEN r_regionkey % 2 = 0 THEN 'CREATE USER ' || r_name ELSE '-- Oracle schema/user: ' || r_name END FROM region")
def schema_ddl(t):
    users = t("region").select(F.col("r_name").alias("schema"), F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("CREATE USER "), "r_name")).alias("user_ddl"))
    return extract.schema_ddl(t("nation").select(F.col("n_name").alias("schema"))).unionByName(extract.schema_ddl(users))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS i, '[c' || l_linenumber || ']' AS c, l_linenumber > 2 AS inc FROM lineitem)
SELECT 'dbo' AS schema, 't' AS "table", 'i' || o AS name, CASE WHEN o % 5 = 0 THEN '-- Index [i' || o || '] (XML) - see sys.indexes for full definition' ELSE 'CREATE ' || CASE WHEN o % 2 = 0 THEN 'UNIQUE ' ELSE '' END || 'NONCLUSTERED INDEX [i' || o || '] ON [dbo].[t] (' || coalesce(string_agg(c || CASE WHEN i = 2 THEN ' DESC' ELSE ' ASC' END, ', ' ORDER BY i DESC) FILTER (WHERE NOT inc), '') || ')' || coalesce(' INCLUDE (' || string_agg(c, ', ' ORDER BY i) FILTER (WHERE inc) || ')', '') || ';' END AS ddl FROM c WHERE o % 7 NOT IN (1, 2) GROUP BY o""")
def index_ddl(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber").distinct()
    o, i = F.col("l_orderkey"), F.col("l_linenumber")
    return extract.index_ddl(rows.select(F.lit("dbo").alias("schema"), F.lit("t").alias("table"), F.concat(F.lit("i"), o.cast("string")).alias("name"), F.lit(2).alias("index_id"), (o % 2 == 0).alias("is_unique"), (o % 7 == 1).alias("is_primary_key"), (o % 7 == 2).alias("is_unique_constraint"), F.when(o % 5 == 0, "XML").otherwise("NONCLUSTERED").alias("kind"), (-i).alias("key_ordinal"), i.alias("index_column_id"), F.concat(F.lit("c"), i.cast("string")).alias("column"), (i == 2).alias("descending"), (i > 2).alias("included")))


@query(f"""WITH l AS (SELECT n_nationkey AS k, string_agg('{extract.LOGIN_NOTE}' || chr(10) || 'EXEC sp_addlinkedsrvlogin @rmtsrvname = N''' || n_name || ''', @useself = N''' || CASE WHEN s_suppkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END || ''', @rmtuser = N''' || s_name || ''', @rmtpassword = N''########'';', chr(10) ORDER BY s_name) AS t FROM nation JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 GROUP BY 1)
SELECT n_name AS server, 'EXEC sp_addlinkedserver' || chr(10) || '    @server = N''' || n_name || ''',' || chr(10) || '    @srvproduct = N''p' || n_regionkey || ''',' || chr(10) || '    @provider = N''SQLNCLI'',' || chr(10) || '    @datasrc = N''' || CASE WHEN n_regionkey = 1 THEN '' ELSE 'host' END || ''',' || chr(10) || '    @provstr = N'''',' || chr(10) || '    @catalog = N'''';' || chr(10) || 'GO' || coalesce(chr(10) || t, '') AS script FROM nation LEFT JOIN l ON k = n_nationkey""")
def linked_server_script(t):
    none = F.lit(None).cast("string")
    servers = t("nation").select(F.col("n_name").alias("server"), F.concat(F.lit("p"), F.col("n_regionkey").cast("string")).alias("product"), F.lit("SQLNCLI").alias("provider"), F.when(F.col("n_regionkey") != 1, "host").alias("data_source"), none.alias("provider_string"), none.alias("catalog"), "n_nationkey")
    logins = t("supplier").join(F.broadcast(servers), F.col("s_nationkey") == F.col("n_nationkey")).select("server", (F.col("s_suppkey") % 3).alias("principal"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name")).otherwise(" ").alias("remote"), (F.col("s_suppkey") % 2 == 0).alias("self"))
    return extract.linked_servers(servers.drop("n_nationkey"), logins)


@query("SELECT r_name AS publication, '-- Publication: ' || r_name || CASE WHEN r_regionkey % 2 = 0 THEN chr(10) || '-- Description: d' || r_regionkey ELSE '' END || chr(10) || '-- Articles (replicated objects):' || chr(10) || coalesce(string_agg('--   - ' || n_name, chr(10) ORDER BY n_name), '--   (none)') || chr(10) || '-- Subscribers are not enumerated - see Replication Monitor for current subscription state.' AS script FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND r_regionkey <> 4 GROUP BY r_name, r_regionkey")
def replication_script(t):
    r = t("region")
    publications = r.select(F.col("r_name").alias("publication"), F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("d"), F.col("r_regionkey").cast("string"))).otherwise(" ").alias("description"))
    articles = t("nation").filter("n_regionkey <> 4").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("publication"), F.col("n_name").alias("article"))
    return extract.replication(publications, articles)


@query("SELECT r_name AS server, count(n_nationkey) AS files, r_regionkey IN (2, 4) AS failed FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND r_regionkey <> 4 GROUP BY r_name, r_regionkey")
def run_summary(t):
    r = t("region")
    files = t("nation").filter("n_regionkey <> 4").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("server"))
    return extract.run_summary(files, r.filter("r_regionkey in (2, 4)").select(F.col("r_name").alias("server")))


@query("SELECT p_type AS schema, CAST(p_partkey AS VARCHAR) AS name, CASE p_size % 3 WHEN 0 THEN 'Tables' WHEN 1 THEN 'Views' ELSE 'Synonyms' END AS type, 'body' || CASE WHEN p_size % 3 = 0 THEN chr(10) || chr(10) || '-- === Indexes ===' || chr(10) || 'b' || chr(10) || 'a' ELSE '' END || CASE WHEN p_size % 3 < 2 THEN chr(10) || chr(10) || '-- === Columns ===' || chr(10) || '-- [col] x|' ELSE '' END || chr(10) || chr(10) || '-- === Grants ===' || chr(10) || '-- [grant] SELECT|GRANT|' || p_brand || '||' AS definition FROM part")
def section_order(t):
    p = spread(t("part"))
    kind = F.get(F.array(F.lit("Tables"), F.lit("Views"), F.lit("Synonyms")), F.col("p_size") % 3)
    name = F.col("p_partkey").cast("string")
    objects = p.select(F.col("p_type").alias("schema"), name.alias("name"), kind.alias("type"), F.lit("body").alias("definition"))
    line = lambda title, n, text: F.struct(F.lit(title).alias("title"), F.lit(n).alias("ordinal"), text.alias("line"))
    none = F.lit(None).cast("string")
    rows = F.array(line("Grants", 1, parse.grant_line(F.lit("SELECT"), F.lit("GRANT"), F.col("p_brand"), none, none)), line("Columns", 1, parse.col_line(F.lit("x"), none)), line("Indexes", 2, F.lit("a")), line("Indexes", 1, F.lit("b")), line("Notes", 1, F.lit("never")))
    return parse.with_sections(objects, p.select(F.lower("p_type").alias("schema"), name.alias("name"), F.inline(rows)))


@query("SELECT l_orderkey AS id, string_agg(c, ', ' ORDER BY n, c) AS parts FROM (SELECT DISTINCT l_orderkey, l_linenumber AS n, CAST(l_partkey AS VARCHAR) AS c FROM lineitem) GROUP BY l_orderkey")
def string_agg_ordered(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").cast("string").alias("c")).distinct()
    return rows.groupBy("id").agg(extract.list_agg("c", "n").alias("parts"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, string_agg('-- [grant] ' || f || '|GRANT|' || s || '||', chr(10) ORDER BY s, f) AS lines FROM (SELECT DISTINCT l_partkey AS p_partkey, l_returnflag AS f, CAST(l_suppkey AS VARCHAR) AS s FROM lineitem) GROUP BY p_partkey")
def section_lines(t):
    rows = t("lineitem").select(F.col("l_partkey").cast("string").alias("id"), F.col("l_returnflag").alias("f"), F.col("l_suppkey").cast("string").alias("s")).distinct()
    line = F.concat(F.lit("-- [grant] "), F.concat_ws("|", "f", F.lit("GRANT"), "s", F.lit(""), F.lit("")))
    return rows.withColumn("line", line).withColumn("o", F.struct("s", "f")).groupBy("id").agg(extract.list_agg("line", "o", "\n").alias("lines"))


# -- metrics ---------------------------------------------------------------------------------------------------------


@query("SELECT l_partkey AS id, sum(CASE WHEN l_linenumber IN (1, 2) THEN CAST(l_quantity AS BIGINT) ELSE 0 END)::BIGINT AS row_count, (sum(CAST(l_quantity AS BIGINT)) * 8)::BIGINT AS reserved_kb, (sum(CASE WHEN l_linenumber IN (1, 2) THEN l_suppkey ELSE 0 END) * 8)::BIGINT AS data_kb, (sum(CASE WHEN l_linenumber NOT IN (1, 2) THEN l_suppkey ELSE 0 END) * 8)::BIGINT AS index_kb FROM lineitem GROUP BY l_partkey")
def table_volume(t):
    q = F.col("l_quantity").cast("long")
    return metrics.table_volume(t("lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_linenumber") - 1).alias("index_id"), q.alias("rows"), q.alias("total_pages"), F.col("l_suppkey").alias("used_pages")))


@query("WITH i AS (SELECT DISTINCT l_partkey AS id, l_linenumber AS index_id FROM lineitem), p AS (SELECT l_partkey AS id, l_linenumber AS index_id, CAST(l_discount * 100 AS DECIMAL(18,6)) AS f, CAST(l_quantity AS BIGINT) AS pages FROM lineitem WHERE l_linenumber <> 3), u AS (SELECT l_partkey AS id, l_linenumber AS index_id, max(l_suppkey) AS seeks, min(l_suppkey) AS scans, count(*) AS lookups, sum(l_suppkey)::BIGINT AS updates FROM lineitem WHERE l_linenumber <> 2 GROUP BY ALL) SELECT id, index_id, 'ix' || index_id AS name, CAST(round_even(CAST(avg(f) AS DECIMAL(22,10)), 2) AS DOUBLE) AS fragmentation, sum(pages)::BIGINT AS pages, max(coalesce(seeks, 0)) AS seeks, max(coalesce(scans, 0)) AS scans, max(coalesce(lookups, 0)) AS lookups, max(coalesce(updates, 0)) AS updates FROM i LEFT JOIN p USING (id, index_id) LEFT JOIN u USING (id, index_id) GROUP BY id, index_id")
def index_metrics(t):
    rows = t("lineitem").select(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("index_id"), (F.col("l_discount") * 100).alias("fragmentation"), F.col("l_quantity").cast("long").alias("pages"), "l_suppkey")
    indexes = rows.select("id", "index_id", F.concat(F.lit("ix"), F.col("index_id").cast("string")).alias("name")).distinct()
    usage = rows.filter("index_id <> 2").groupBy("id", "index_id").agg(F.max("l_suppkey").alias("seeks"), F.min("l_suppkey").alias("scans"), F.count("*").alias("lookups"), F.sum("l_suppkey").alias("updates"))
    out = metrics.index_metrics(indexes, rows.filter("index_id <> 3").drop("l_suppkey"), usage)
    return out.withColumn("fragmentation", F.col("fragmentation").cast("double"))


@query("SELECT o_orderkey AS id, o_custkey AS stats_id, o_orderpriority AS name, l.rows AS rows, l.sampled AS \"rowsSampled\", l.steps AS steps, l.counter AS \"modificationCounter\", l.at AS \"lastUpdated\" FROM orders JOIN LATERAL (SELECT count(*) AS rows, count(*) FILTER (WHERE l_tax > 0.02) AS sampled, max(l_linenumber) AS steps, sum(l_suppkey)::BIGINT AS counter, max(CAST(l_shipdate AS VARCHAR)) AS at FROM lineitem WHERE l_orderkey = o_orderkey HAVING count(*) > 1) l ON TRUE WHERE o_orderstatus <> 'P'")
def lateral_stats(t):
    s = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("stats_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("name"))
    figures = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("rows"), F.count_if(F.col("l_tax") > 0.02).alias("rowsSampled"), F.max("l_linenumber").alias("steps"), F.sum("l_suppkey").alias("modificationCounter"), F.max(F.col("l_shipdate").cast("string")).alias("lastUpdated")).filter("rows > 1")
    ids = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("stats_id"))
    return extract.lateral_stats(s, figures.join(ids, "id"))


@query("WITH p AS (SELECT l_partkey AS id, l_partkey || '-' || l_orderkey || '-' || l_linenumber AS partition_id, l_linenumber % 3 AS index_id, max(CAST(l_quantity AS BIGINT)) AS rows FROM lineitem GROUP BY 1, 2, 3), u AS (SELECT partition_id, unnest([3, 5]) AS total FROM p) SELECT id, sum(CASE WHEN index_id IN (0, 1) THEN rows * 2 ELSE 0 END)::BIGINT AS row_count, (count(*) * 64)::BIGINT AS reserved_kb, (sum(CASE WHEN index_id IN (0, 1) THEN rows ELSE 0 END))::BIGINT AS corrected FROM p GROUP BY id")
def table_volume_units(t):
    part = F.concat_ws("-", "l_partkey", "l_orderkey", "l_linenumber").alias("partition_id")
    p = t("lineitem").groupBy(F.col("l_partkey").alias("id"), part, (F.col("l_linenumber") % 3).alias("index_id")).agg(F.max(F.col("l_quantity").cast("long")).alias("rows"))
    units = p.select("partition_id", F.explode(F.array(F.lit(3), F.lit(5))).alias("total_pages")).withColumn("used_pages", F.col("total_pages"))
    once = metrics.partition_volume(p, units, corrected=True).select("id", F.col("row_count").alias("corrected"))
    return metrics.partition_volume(p, units).select("id", "row_count", "reserved_kb").join(once, "id")


@query("SELECT p_partkey AS id, p_size::BIGINT AS rows, CASE WHEN p_size > 5 THEN p_size * 8 END::BIGINT AS reserved_kb, coalesce(n, 0) AS n_indexes, c AS counter FROM part LEFT JOIN (SELECT l_partkey AS p_partkey, count(*) FILTER (WHERE l_linenumber < 3) AS n, max(CASE WHEN l_linenumber = 4 THEN l_suppkey + l_orderkey END)::BIGINT AS c FROM lineitem GROUP BY 1) USING (p_partkey)")
def oracle_snapshot(t):
    size = F.col("p_size").cast("long")
    tables = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), size.alias("num_rows"), F.when(size > 5, size).alias("blocks"), size.alias("sample_size"), F.lit("2024-01-01").alias("last_analyzed"))
    item = t("lineitem").withColumn("id", F.col("l_partkey"))
    changes = item.filter("l_linenumber = 4").select("id", F.col("l_suppkey").alias("inserts"), F.lit(None).cast("long").alias("updates"), F.col("l_orderkey").alias("deletes"))
    indexes = item.filter("l_linenumber < 3").select("id", F.concat(F.lit("i"), F.col("l_orderkey").cast("string")).alias("name"), F.col("l_suppkey").alias("rowCount"))
    out = metrics.oracle_snapshots(tables, changes, indexes)
    return out.select("id", F.col("rowCount").alias("rows"), F.col("reservedKB").alias("reserved_kb"), F.size("indexes").cast("long").alias("n_indexes"), F.col("statistics")[0]["modificationCounter"].alias("counter"))


@query("SELECT l_partkey AS id, sum(CAST(l_quantity AS BIGINT))::BIGINT AS modifications FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_partkey UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag <> 'R')")
def modification_counter(t):
    rows = t("lineitem").groupBy(F.col("l_partkey").alias("id")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum(F.col("l_quantity").cast("long")))
    return t("part").select(F.col("p_partkey").alias("id")).join(rows, "id", "left").select("id", metrics.modification_counter(F.col("A"), F.col("N")).alias("modifications"))


@query("SELECT p_partkey AS id, CASE WHEN p_size > 5 THEN p_size * 8 END AS reserved_kb, CAST(NULL AS BIGINT) AS data_kb FROM part")
def oracle_volume(t):
    blocks = F.when(F.col("p_size") > 5, F.col("p_size"))
    return t("part").select(F.col("p_partkey").alias("id"), metrics.block_kb(blocks).alias("reserved_kb"), F.lit(None).cast("long").alias("data_kb"))


@query(SERIES + " SELECT id, seq, row_count FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM m) WHERE k <= 7")
def metrics_retention(t):
    m = event_series(t).select("id", "seq", "row_count")
    return metrics.retain(m.filter("seq < 20"), m.filter("seq >= 20"), 7)


@query(SERIES + " SELECT id, max(seq) AS seq, max_by(row_count, seq) AS row_count FROM m GROUP BY id")
def metrics_latest(t):
    return metrics.latest(event_series(t), "seq", "row_count")


@query(SERIES + " SELECT id, CAST(DATE '2024-01-01' + CAST(seq AS INT) AS VARCHAR) AS day, row_count FROM m")
def metrics_series(t):
    return metrics.volume_series(event_series(t), "2024-01-01", "row_count")


@query(SERIES + ", i AS (SELECT * FROM per WHERE event_type = 'click') SELECT m.id, m.seq, i.n AS seeks FROM m LEFT JOIN i ON m.id = i.id AND m.seq = i.seq")
def index_series(t):
    return metrics.index_series(event_series(t), "click")


@query(SERIES + ", s AS (SELECT id, seq, sum(CASE WHEN n = 1 THEN 0 ELSE n END)::BIGINT AS p FROM per WHERE n % 2 = 1 GROUP BY id, seq) SELECT m.id, m.seq, s.p AS pending FROM m LEFT JOIN s ON m.id = s.id AND m.seq = s.seq")
def pending_mods(t):
    return metrics.pending(event_series(t)).select("id", "seq", "pending")


@query(SERIES + ", g AS (SELECT *, CASE WHEN row_count % 3 <> 0 THEN row_count END AS v FROM m) SELECT id, seq, v, segment FROM (SELECT id, seq, v, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY seq)::BIGINT AS segment FROM g) WHERE v IS NOT NULL")
def trend_segments(t):
    m = event_series(t).select("id", "seq", F.when(F.col("row_count") % 3 != 0, F.col("row_count")).alias("v"))
    return metrics.segments(m, "v")


RANGES = SERIES + ", v AS (SELECT id, seq, CAST(row_count - 7 AS BIGINT) AS a, CASE WHEN row_count % 3 <> 0 THEN -row_count END AS b FROM m), r AS (SELECT id, least(min(a), min(b), 0) AS low, greatest(max(a), max(b)) AS high FROM v GROUP BY id), g AS (SELECT *, CASE WHEN high = low THEN 1 ELSE high - low END AS span FROM r)"


def _two_series(t):
    return event_series(t).select("id", "seq", (F.col("row_count") - 7).alias("a"), F.when(F.col("row_count") % 3 != 0, -F.col("row_count")).alias("b"))


@query(RANGES + " SELECT * FROM g")
def trend_scale(t):
    return metrics.scale(_two_series(t), "a", "b")


@query(RANGES + ", i AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM v) SELECT id, seq, round(CASE WHEN n <= 1 THEN 320.0 ELSE i / (n - 1) * 620 + 10 END, 6)::DOUBLE AS x, round(140 - (b - low) / span * 130, 6)::DOUBLE AS y FROM i JOIN g USING (id) WHERE b IS NOT NULL")
def chart_points(t):
    s = _two_series(t)
    points = metrics.chart_points(s, "b", metrics.scale(s, "a", "b"))
    return points.withColumns({c: F.round(c, 6) for c in ("x", "y")})


@query(SERIES + ", z AS (SELECT id, max(seq) AS seq FROM m GROUP BY id) SELECT per.id, per.seq, event_type AS name, nullif(n, 1) AS modifications FROM per JOIN z ON per.id = z.id AND per.seq = z.seq WHERE n % 2 = 1")
def latest_statistics(t):
    return metrics.latest_statistics(event_series(t))


@query("SELECT CAST(user_id AS VARCHAR) AS id, string_agg(event_type, ',' ORDER BY f, event_type) AS names FROM (SELECT user_id, event_type, min(CAST(ts AS DATE)) AS f FROM events GROUP BY ALL) GROUP BY user_id")
def index_names(t):
    seen = metrics.index_names(event_series(t))
    return seen.withColumn("o", F.struct("first", "name")).groupBy("id").agg(extract.list_agg("name", "o", ",").alias("names"))


@query(SERIES + " SELECT m.id, coalesce(bool_or(event_type = 'click' AND n % 2 = 1), FALSE) AS by_use, coalesce(bool_or(event_type = 'click' AND n > 2), FALSE) AS by_size FROM m LEFT JOIN per USING (id, seq) GROUP BY m.id")
def index_variant(t):
    shown = F.transform("indexes", lambda x: F.struct(x["name"].alias("name"), F.when(x["seeks"] % 2 == 1, x["seeks"]).alias("fragmentationPct"), F.when(x["seeks"] > 2, x["seeks"]).alias("rowCount")))
    return metrics.index_variant(event_series(t).withColumn("indexes", shown), "click")


def _snapshots(t):
    v = t("part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("row_count"))
    i = t("lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("id"), F.col("l_shipdate").cast("string").alias("name"), F.col("l_suppkey").alias("seeks"))
    s = t("lineitem").filter("l_linenumber = 2").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("name"), F.nullif(F.col("l_suppkey"), F.lit(1).cast("long")).alias("modifications"))
    return metrics.snapshots(v, i, s)


@query("SELECT p_partkey AS id, p_size::BIGINT AS row_count, coalesce(i, 0) AS n_indexes, coalesce(s, 0) AS n_statistics FROM part LEFT JOIN (SELECT l_partkey AS p_partkey, count(*) FILTER (WHERE l_linenumber = 1) AS i, count(*) FILTER (WHERE l_linenumber = 2) AS s FROM lineitem GROUP BY 1) USING (p_partkey)")
def metrics_snapshot(t):
    return _snapshots(t).select("id", "row_count", F.size("indexes").cast("long").alias("n_indexes"), F.size("statistics").cast("long").alias("n_statistics"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, m.row_count FROM part LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS id, count(*) AS row_count FROM events GROUP BY 1) m ON m.id = CAST(p_partkey AS VARCHAR)")
def node_metrics(t):
    m = t("events").groupBy(F.col("user_id").cast("string").alias("id")).agg(F.count("*").alias("row_count"))
    return metrics.attach(part_nodes(t).select("id", "name"), m)


@query("SELECT p_partkey AS id, '{\"id\":' || p_partkey || ',\"rowCount\":' || p_size || ',\"name\":\"' || p_name || '\"}' AS json FROM part")
def render_metrics_json(t):
    return t("part").select(F.col("p_partkey").alias("id"), F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_size").alias("rowCount"), F.col("p_name").alias("name"))).alias("json"))


# -- scalars ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def json_tolerant(t):
    text = F.when(F.col("event_id") % 10 == 0, F.substring("props", 2, 100)).otherwise(F.col("props"))
    return t("events").select("event_id", scalar.tolerant(text, "k bigint")["k"].alias("k"))


@query("SELECT p_partkey AS id, regexp_replace(p_name || '<' || p_brand || ':*?', '[<>:\"/\\\\|?*]', '_', 'g') AS file FROM part")
def safe_file_name(t):
    return t("part").select(F.col("p_partkey").alias("id"), scalar.safe_file_name(F.concat("p_name", F.lit("<"), "p_brand", F.lit(":*?"))).alias("file"))


@query("WITH k AS (SELECT p_partkey AS id, CASE WHEN p_size % 9 <> 0 THEN CAST(p_partkey * p_size * p_size AS BIGINT) END AS kb FROM part), u AS (SELECT id, kb, CASE WHEN kb >= 1048576 THEN 1048576 WHEN kb >= 1024 THEN 1024 END AS unit FROM k), d AS (SELECT *, (20 * kb + unit) // (2 * unit) AS tenths FROM u) SELECT id, CASE WHEN kb IS NULL THEN '-' WHEN unit IS NULL THEN kb || ' KB' ELSE (tenths // 10) || '.' || (tenths % 10) || CASE WHEN unit = 1024 THEN ' MB' ELSE ' GB' END END AS size FROM d")
def format_kb(t):
    kb = F.when(F.col("p_size") % 9 != 0, F.col("p_partkey") * F.col("p_size") * F.col("p_size"))
    return t("part").select(F.col("p_partkey").alias("id"), scalar.format_kb(kb).alias("size"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '-' ELSE format('{:,}', o_orderkey * 1000) END AS n FROM orders")
def format_count(t):
    return t("orders").select(F.col("o_orderkey").alias("id"), scalar.format_count(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") * 1000)).alias("n"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def iso_timestamps(t):
    return t("events").select("event_id", scalar.iso_utc(F.col("ts")).alias("at"))


@query(NODES + " SELECT id, CASE schema WHEN 'STANDARD' THEN 'blue' WHEN 'SMALL' THEN 'green' ELSE 'default' END AS colour FROM nodes")
def type_colors(t):
    return part_nodes(t).select("id", scalar.lookup({"STANDARD": "blue", "SMALL": "green"}, F.col("schema"), F.lit("default")).alias("colour"))


# -- catalog ---------------------------------------------------------------------------------------------------------

CATALOG = PARSED + """, o AS (SELECT id, max(description) FILTER (WHERE "column" IS NULL) AS description FROM d GROUP BY id), k AS (SELECT c.id, string_agg(c.name || ':' || c."dataType" || ':' || coalesce(d.description, '-'), ';' ORDER BY c.ordinal) AS columns FROM c LEFT JOIN d ON c.id = d.id AND lower(c.name) = lower(d."column") GROUP BY c.id),
b AS (SELECT id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE title IS NULL AND body AND line <> '') AS ddl, count(*) FILTER (WHERE title = 'Grants' AND mark IS NULL AND line <> '') AS n_grants FROM s GROUP BY id)"""


def _files(t):
    place = F.concat_ws("/", F.lit("S"), F.col("p_brand"), F.lit("Tables"), F.when(F.col("p_size") % 2 == 0, "dbo"), F.concat(F.lit("t"), F.col("p_partkey").cast("string"), F.lit(".sql")))
    return object_text(t, place.alias("path")).select("path", "text")


@query(CATALOG + """ SELECT 'S/' || p_brand || '/Tables/' || CASE WHEN p_size % 2 = 0 THEN 'dbo/' ELSE '' END || 't' || p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'dbo.' ELSE '' END || 't' || p_partkey AS "qualifiedName", o.description, k.columns, b.ddl, CAST(strlen(b.ddl) AS BIGINT) AS "sizeBytes", b.n_grants, CASE WHEN p_size > 25 THEN 1 ELSE 0 END::BIGINT AS n_sections FROM part JOIN o ON o.id = CAST(p_partkey AS VARCHAR) JOIN k ON k.id = o.id JOIN b ON b.id = o.id""")
def catalog_nodes(t):
    shown = F.array_join(F.transform("columns", lambda c: F.concat(c["name"], F.lit(":"), c["dataType"], F.lit(":"), F.coalesce(c["description"], F.lit("-")))), ";")
    nodes = catalog.assemble(_files(t)).nodes
    return nodes.select("id", "qualifiedName", "description", shown.alias("columns"), "ddl", "sizeBytes", F.size("grants").cast("long").alias("n_grants"), F.size("sections").cast("long").alias("n_sections"))


@query("SELECT p_partkey AS id, v.sha, v.ddl, v.rank FROM part JOIN (SELECT l_partkey AS p_partkey, CAST(l_orderkey AS VARCHAR) AS sha, CASE WHEN l_orderkey % 2 = 0 THEN 'v' || l_orderkey END AS ddl, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, CAST(l_orderkey AS VARCHAR) DESC) AS rank FROM (SELECT DISTINCT l_partkey, l_orderkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)) v USING (p_partkey)")
def object_history(t):
    blobs = changed(t).filter("cast(sha as long) % 2 = 0").select("id", "sha", F.concat(F.lit("-- head\n\nv"), "sha", F.lit("\n\n-- === Columns ===\n-- [col] a|b")).alias("text"))
    live = t("part").select(F.col("p_partkey").cast("string").alias("id"))
    rows = history.object_versions(history.ranked(touched(t)).join(shuffled(live), "id"), blobs, parse.split_sections)
    return rows.select(F.col("id").cast("long").alias("id"), "sha", "ddl", "rank")
