"""Queries over the driver's tables, each an operator behind a thin adapter, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.operators import access, browse, graph, history, lineage, parse
from provenir.storage import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__ = f.__name__
        QUERIES[f.__name__], ORACLES[f.__name__] = run, sql
        return f

    return add


# -- adapters --------------------------------------------------------------------------------------------------------


#: Rows of a task that dedups changes and makes their pairs.
TOUCHED_ROWS = 200_000


def commits(t):
    return t("orders").select(F.col("o_orderkey").cast("string").alias("sha"), F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("message"))


def changed(t):
    return spread(t("lineitem").select(F.col("l_orderkey").cast("string").alias("sha"), F.col("l_partkey").cast("string").alias("id")), TOUCHED_ROWS, "sha").distinct()


def touched(t):
    return changed(t).join(commits(t).select("sha", "date"), "sha").select("sha", "date", "id")


TOUCHED = "WITH touched AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS sha, o_orderdate AS date, CAST(l_partkey AS VARCHAR) AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey), commits AS (SELECT CAST(o_orderkey AS VARCHAR) AS sha, o_orderdate AS date, o_orderpriority AS message FROM orders)"


def part_nodes(t):
    return t("part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("qualifiedName"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("S"), (F.col("p_size") % 3).cast("string")).alias("server"),
        F.col("p_brand").alias("database"),
        F.when(F.col("p_size") % 7 != 0, F.split("p_type", " ")[0]).alias("schema"),
        F.col("p_type").alias("type"),
        F.when(F.col("p_size") > 10, F.concat("p_brand", F.lit(" / "), "p_type")).alias("description"),
        F.col("p_size").cast("long").alias("changeCount"),
        F.col("p_retailprice").cast("int").cast("string").alias("lastChangedAt"),
    )


NODES = "WITH nodes AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS \"qualifiedName\", p_name AS name, 'S' || CAST(p_size % 3 AS VARCHAR) AS server, p_brand AS database, CASE WHEN p_size % 7 <> 0 THEN split_part(p_type, ' ', 1) END AS schema, p_type AS type, CASE WHEN p_size > 10 THEN p_brand || ' / ' || p_type END AS description, CAST(p_size AS BIGINT) AS \"changeCount\", CAST(CAST(trunc(p_retailprice) AS INT) AS VARCHAR) AS \"lastChangedAt\" FROM part)"


def graph_of(t):
    """Nodes: suppliers, orders and customers, their region the server (an order's is its customer's).

    Edges: every supplier to the orders of its line items, and every order to its customer.
    """
    region = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("string").alias("server"))
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    sup = t("supplier").select(name("s", "s_suppkey").alias("id"), F.col("s_nationkey").alias("k"), F.lit("Views").alias("type"), F.col("s_name").alias("name"))
    cus = t("customer").select(name("c", "c_custkey").alias("id"), F.col("c_nationkey").alias("k"), F.lit("Tables").alias("type"), F.col("c_name").alias("name"))
    place = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k"))
    orders = t("orders").join(place, "o_custkey").select(name("o", "o_orderkey").alias("id"), "k", F.lit("StoredProcedures").alias("type"), name("Order#", "o_orderkey").alias("name"))
    nodes = sup.unionByName(cus).unionByName(orders).join(F.broadcast(region), "k").select("id", "server", "type", "name")
    items = t("lineitem").select(name("s", "l_suppkey").alias("from"), name("o", "l_orderkey").alias("to")).distinct()
    return nodes, items.unionByName(t("orders").select(name("o", "o_orderkey").alias("from"), name("c", "o_custkey").alias("to")))


GRAPH = """WITH RECURSIVE nodes AS (SELECT 's' || s_suppkey AS id, CAST(n_regionkey AS VARCHAR) AS server, 'Views' AS type, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'c' || c_custkey, CAST(n_regionkey AS VARCHAR), 'Tables', c_name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'o' || o_orderkey, CAST(n_regionkey AS VARCHAR), 'StoredProcedures', 'Order#' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
edges AS (SELECT DISTINCT 's' || l_suppkey AS "from", 'o' || l_orderkey AS "to" FROM lineitem UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"""


def of_type(nodes, kind):
    return nodes.filter(F.col("type") == kind).select("id")


def walk_sql(moves: str, kind: str) -> str:
    return f"""{GRAPH}, w AS (SELECT id AS seed, id, 0 AS hop, server AS home, TRUE AS grows FROM nodes WHERE type = '{kind}'
UNION SELECT w.seed, e.dst, w.hop + 1, w.home, n.server = w.home FROM w JOIN ({moves}) AS e ON e.src = w.id JOIN nodes n ON n.id = e.dst WHERE w.grows AND w.hop < 6)
SELECT seed, id, CAST(min(hop) AS BIGINT) AS hop FROM w WHERE id <> seed GROUP BY seed, id"""


def home_graph(t):
    """Undirected walks go over orders, customers and nations: every order to its customer, every customer to its nation."""
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    one = t("orders").select(name("o", "o_orderkey").alias("from"), name("c", "o_custkey").alias("to"))
    return one.unionByName(t("customer").select(name("c", "c_custkey").alias("from"), name("n", "c_nationkey").alias("to")))


HOME = """WITH RECURSIVE one AS (SELECT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
both_ AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one)"""


def lineitem_grants(t):
    rows = t("lineitem").join(t("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("l_partkey").cast("string").alias("id"), F.col("l_returnflag").alias("permission"), F.when(F.col("l_linestatus") == "F", "DENY").otherwise("GRANT").alias("state"), F.col("s_name").alias("grantee"), F.nullif(F.col("l_linenumber").cast("string"), F.lit("1")).alias("column"))


GRANTS = "WITH grants AS (SELECT CAST(l_partkey AS VARCHAR) AS id, l_returnflag AS permission, CASE WHEN l_linestatus = 'F' THEN 'DENY' ELSE 'GRANT' END AS state, s_name AS grantee, nullif(CAST(l_linenumber AS VARCHAR), '1') AS \"column\" FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def event_series(t):
    """Snapshots: users a day; indexes: their event types; statistics: those types with an odd count (null where 1)."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long")
    e = t("events").select(F.col("user_id").cast("string").alias("id"), day.alias("seq"), "event_type")
    per = e.groupBy("id", "seq", "event_type").agg(F.count("*").alias("n"))
    return per.groupBy("id", "seq").agg(
        F.sum("n").alias("row_count"),
        F.array_sort(F.collect_list(F.struct(F.col("event_type").alias("name"), F.col("n").alias("seeks")))).alias("indexes"),
        F.array_sort(F.collect_list(F.when(F.col("n") % 2 == 1, F.struct(F.col("event_type").alias("name"), F.nullif("n", F.lit(1)).alias("modifications"))))).alias("statistics"),
    )


SERIES = "WITH per AS (SELECT CAST(user_id AS VARCHAR) AS id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS seq, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3), m AS (SELECT id, seq, CAST(sum(n) AS BIGINT) AS row_count FROM per GROUP BY id, seq)"


def object_text(t, *keep):
    """An object file for every part, and what to ``keep``: an empty first description, column names in two spellings and with brackets, a column without a name."""
    p = spread(t("part"))
    cols = F.array(F.lit("-- [col] Key|bigint"), F.concat(F.lit("-- [col] "), "p_brand", F.lit("|varchar|"), F.col("p_size").cast("string")), F.lit("-- [col] a[0]|"), F.lit("-- [col] |int"))
    grants = F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("-- [grant] SELECT|GRANT|"), "p_brand", F.lit("||")), F.concat(F.lit("-- [grant] UPDATE|DENY|"), "p_type", F.lit("|ROLE|key"))))
    props = F.array(
        F.lit("-- [object] MS_Description = "), F.lit("-- [object] My Description = no"), F.concat(F.lit("-- [object] MS_Description = "), "p_name"), F.lit("-- [object] MS_Description = second"),
        F.lit("-- [column: key] MS_Description = first"), F.concat(F.lit("-- [column: KEY] MS_Description = "), "p_type"), F.lit("-- [column: a[0]] Description = x = y"), F.lit("-- [object] Owner = x"),
    )
    body = F.concat(F.lit("CREATE TABLE "), "p_brand", F.lit(" (\n  key bigint\n);"))
    text = parse.render(F.lit("S"), F.lit("D"), F.lit("Tables"), F.col("p_name"), body)
    text = F.regexp_replace(text, "\n$", "")
    for title, lines in (("Indexes", F.when(F.col("p_size") > 25, F.array(F.concat(F.lit("CREATE INDEX i"), F.col("p_size").cast("string"))))), ("Columns", cols), ("Grants", grants), ("Extended Properties", props)):
        text = parse.append_section(text, title, lines)
    return p.select(F.col("p_partkey").cast("string").alias("id"), text.alias("text"), *keep)


def parsed(t):
    return parse.split_sections(object_text(t))


def document_nodes(t):
    d = t("documents")
    name = F.lower(F.regexp_extract("text", r"(?U)\b([A-Za-z]{8,})\b", 1))
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("server"), F.col("source").alias("database"), F.lit(None).cast("string").alias("schema"), name.alias("name"), F.col("text").alias("ddl"))


def sql_nodes(t):
    """Tables: nations by region; procedures: suppliers that select from their nation's table by an alias, or by three names.

    Servers and databases differ in case, a nation's name is not ASCII, and a fifth of the suppliers reach their table by a foreign key alone.
    """
    n = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    place = n.select("n_nationkey", F.translate(F.lower("r_name"), " ", "_").alias("rs"), F.when(F.col("n_nationkey") == 3, "Größe").otherwise(F.translate(F.lower("n_name"), " ", "_")).alias("ns"))
    none = F.lit(None).cast("string")
    tables = place.select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("id"), F.col("rs").alias("schema"), F.col("ns").alias("name"), F.lit("key bigint").alias("ddl"), F.lit("S").alias("server"), F.lit("d").alias("database"), none.alias("foreign_keys"))
    sup = t("supplier").join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % 5
    by_alias = F.concat(F.lit("SELECT q.Name, q.[Key], q.Nothing, q.[Unit Price], [q].[Total] FROM "), "rs", F.lit(".["), "ns", F.lit("] AS q WHERE q.name = 1"))
    by_three = F.concat(F.lit("SELECT db."), "rs", F.lit("."), "ns", F.lit(", "), "rs", F.lit("."), "ns", F.lit(".Total FROM "), "ns")
    text = F.when(k == 0, "SELECT 1").when(k == 1, by_three).otherwise(by_alias)
    procs = sup.select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("dbo").alias("schema"), F.concat(F.lit("sp"), F.col("s_suppkey").cast("string")).alias("name"), text.alias("ddl"), F.lit("s").alias("server"), F.lit("D").alias("database"), F.when(k == 0, F.concat(F.lit("REFERENCES ["), "rs", F.lit("].["), "ns", F.lit("] (Key)"))).alias("foreign_keys"))
    return tables.unionByName(procs)


def sql_columns(t):
    return t("nation").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("id"), F.explode(F.array(F.lit("name"), F.lit("Key"), F.lit("Total"), F.lit("unit price"))).alias("name"))


# -- history ---------------------------------------------------------------------------------------------------------


@query(TOUCHED + " SELECT a.id AS a, b.id AS b, count(*) AS count FROM touched a JOIN touched b ON a.sha = b.sha AND a.id < b.id JOIN (SELECT sha FROM touched GROUP BY sha HAVING count(*) BETWEEN 2 AND 40) s ON s.sha = a.sha GROUP BY 1, 2 ORDER BY count DESC, a, b LIMIT 100")
def co_change_pairs(t):
    return history.top_pairs(history.co_change(touched(t)))


@query(TOUCHED + ", p AS (SELECT a.id AS a, b.id AS b, count(*) AS count FROM touched a JOIN touched b ON a.sha = b.sha AND a.id < b.id JOIN (SELECT sha FROM touched GROUP BY sha HAVING count(*) BETWEEN 2 AND 40) s ON s.sha = a.sha GROUP BY 1, 2 ORDER BY count DESC, a, b LIMIT 10) SELECT p.*, x.p_name AS a_name, y.p_name AS b_name FROM p LEFT JOIN part x ON p.a = CAST(x.p_partkey AS VARCHAR) LEFT JOIN part y ON p.b = CAST(y.p_partkey AS VARCHAR)")
def co_change_display(t):
    return history.display_pairs(history.co_change(touched(t)), part_nodes(t))


@query(TOUCHED + " SELECT id, count(*) AS change_count, max(date) AS last_changed_at FROM touched GROUP BY id")
def change_counts(t):
    return history.change_counts(touched(t))


@query(TOUCHED + " SELECT sha, date, id FROM touched WHERE CAST(id AS BIGINT) % 3 = 0 AND id NOT LIKE '%1'")
def commit_objects(t):
    changes = touched(t).select("sha", "date", F.concat(F.lit("db/"), "id", F.when(F.col("id").endswith("1"), ".SQL").otherwise(".sql")).alias("path"))
    live = t("part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("id"))
    return history.commit_objects(changes, live, "db/")


@query(TOUCHED + " SELECT id, rank, sha, date, message FROM (SELECT t.id, t.sha, t.date, c.message, row_number() OVER (PARTITION BY t.id ORDER BY t.date DESC, t.sha DESC) AS rank FROM touched t JOIN commits c USING (sha)) WHERE rank <= 15")
def version_history(t):
    return history.version_history(touched(t), commits(t))


@query(TOUCHED + " SELECT id, rank, sha, date, message FROM (SELECT t.id, t.sha, t.date, c.message, row_number() OVER (PARTITION BY t.id ORDER BY t.date DESC, t.sha DESC) AS rank FROM touched t JOIN commits c USING (sha)) WHERE rank <= 15 ORDER BY id, rank LIMIT 1500")
def content_budget(t):
    return history.content_budget(history.version_history(touched(t), commits(t)))


@query(TOUCHED + " SELECT sha, left(sha, 7) AS short_sha, date, message, n AS n_objects FROM (SELECT * FROM commits ORDER BY date DESC, sha DESC LIMIT 250) JOIN (SELECT sha, count(*) AS n FROM touched GROUP BY sha) USING (sha)")
def recent_changes(t):
    return history.recent_changes(touched(t), commits(t))


@query(TOUCHED + " SELECT id, count(*) AS change_count, max(date) AS last_changed_at FROM touched GROUP BY id ORDER BY change_count DESC, id LIMIT 10")
def most_changed(t):
    return history.most_changed(history.change_counts(touched(t)))


@query(TOUCHED + " SELECT id, count(*) AS change_count, max(date) AS last_changed_at FROM touched GROUP BY id ORDER BY last_changed_at DESC, id LIMIT 10")
def recently_changed(t):
    return history.recently_changed(history.change_counts(touched(t)))


@query(TOUCHED + ", c AS (SELECT id, count(*) AS n FROM touched GROUP BY id) SELECT id, CASE WHEN m <= 0 THEN 0.0::DOUBLE ELSE greatest(0.08::DOUBLE, least(1.0::DOUBLE, n / m)) END AS intensity FROM c, (SELECT max(n) AS m FROM c)")
def heat_intensity(t):
    c = history.change_counts(touched(t))
    top = c.agg(F.max("change_count").alias("m"))
    return c.join(F.broadcast(top)).select("id", history.intensity(F.col("change_count"), F.col("m")).alias("intensity"))


@query("SELECT conv_id, turn AS rank, CASE WHEN turn % 2 = 0 THEN text END AS ddl FROM conversations")
def versions_with_content(t):
    c = t("conversations")
    versions = c.select(F.col("conv_id").alias("id"), F.col("turn").alias("sha"), F.col("turn").alias("rank"))
    blobs = c.filter("turn % 2 = 0").select(F.col("conv_id").alias("id"), F.col("turn").alias("sha"), F.col("text").alias("ddl")).distinct()
    return history.with_content(versions, blobs).select(F.col("id").alias("conv_id"), "rank", "ddl")


@query("SELECT conv_id AS id, arg_max(text, (turn, role)) AS ddl FROM conversations WHERE turn <= 3 GROUP BY conv_id")
def point_in_time(t):
    v = t("conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("date"), F.col("role").alias("sha"), F.col("text").alias("ddl"))
    return history.point_in_time(v, F.lit(3))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS sha, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority || '@@' || o_orderstatus AS message, 'db/' || l_partkey || '.sql' AS path FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey")
def gitlog_parse(t):
    head = t("orders").select("o_orderkey", F.lit(0).cast("long").alias("n"), F.concat_ws("@@", F.lit(""), F.lit("COMMIT"), F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority", "o_orderstatus").alias("value"))
    body = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("n")).distinct().select("o_orderkey", "n", F.concat(F.lit("db/"), F.col("n").cast("string"), F.lit(".sql")).alias("value"))
    noise = t("orders").select("o_orderkey", F.lit(-1).cast("long").alias("n"), F.lit("before any header").alias("value"))
    body = body.withColumn("value", F.when(F.col("n") % 2 == 0, F.concat(F.lit("  "), "value", F.lit("\t"))).otherwise(F.col("value")))
    lines = head.unionByName(body).unionByName(noise).select(F.col("o_orderkey").alias("log"), F.col("n").alias("line_no"), "value")
    return history.parse_git_log(lines)


@query("SELECT path, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' WHEN o = n THEN 'unchanged' ELSE 'modified' END AS status FROM (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderstatus AS o FROM orders WHERE o_orderkey % 5 <> 0) FULL JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS n FROM orders WHERE o_orderkey % 3 <> 0) USING (path)")
def tree_diff(t):
    o = t("orders")
    path = F.col("o_orderkey").cast("string").alias("path")
    old = o.filter("o_orderkey % 5 <> 0").select(path, F.md5("o_orderstatus").alias("hash"))
    new = o.filter("o_orderkey % 3 <> 0").select(path, F.md5(F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("hash"))
    return history.tree_diff(old, new)


# -- graph -----------------------------------------------------------------------------------------------------------


@query(GRAPH + ' SELECT id, coalesce(o, 0) AS n_out, coalesce(i, 0) AS n_in FROM (SELECT "from" AS id, count(*) AS o FROM edges GROUP BY 1) FULL JOIN (SELECT "to" AS id, count(*) AS i FROM edges GROUP BY 1) USING (id)')
def degrees(t):
    return graph.degrees(graph_of(t)[1])


@query(walk_sql('SELECT "from" AS src, "to" AS dst FROM edges', "Views"))
def reachable_out(t):
    nodes, edges = graph_of(t)
    return graph.reachable(edges, nodes, of_type(nodes, "Views"))


@query(walk_sql('SELECT "to" AS src, "from" AS dst FROM edges', "Tables"))
def reachable_in(t):
    nodes, edges = graph_of(t)
    return graph.reachable(edges, nodes, of_type(nodes, "Tables"), incoming=True)


def _neighborhood(radius: int):
    sql = f"""{HOME}, w AS (SELECT 'c' || c_custkey AS seed, 'c' || c_custkey AS id, 0 AS hop FROM customer
UNION SELECT w.seed, e.b, w.hop + 1 FROM w JOIN both_ e ON e.a = w.id WHERE w.hop < {radius}) SELECT DISTINCT seed, id FROM w"""

    def run(t):
        roots = t("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
        return graph.neighborhood(home_graph(t), roots, radius)

    run.__name__ = f"neighborhood_{radius}"
    query(sql)(run)


for _radius in (1, 2, 3):
    _neighborhood(_radius)


@query(GRAPH + """, w AS (SELECT id AS seed, id, 0 AS hop, server AS home, TRUE AS grows FROM nodes WHERE type = 'Tables' AND id IN (SELECT "to" FROM edges)
UNION SELECT w.seed, e."from", w.hop + 1, w.home, n.server = w.home FROM w JOIN edges e ON e."to" = w.id JOIN nodes n ON n.id = e."from" WHERE w.grows AND w.hop < 6)
SELECT d.id, direct, coalesce(i, 0) AS indirect FROM (SELECT "to" AS id, count(*) AS direct FROM edges JOIN nodes ON "to" = nodes.id AND type = 'Tables' GROUP BY 1) d LEFT JOIN (SELECT seed AS id, count(DISTINCT id) AS i FROM w WHERE id <> seed GROUP BY seed) USING (id) ORDER BY direct DESC, indirect DESC, d.id LIMIT 10""")
def top_referenced(t):
    nodes, edges = graph_of(t)
    return graph.top_referenced(edges, nodes)


@query(GRAPH + ' SELECT "from", "to" FROM edges WHERE "from" IN (SELECT id FROM nodes WHERE server IN (\'1\', \'2\')) AND "to" IN (SELECT id FROM nodes WHERE server IN (\'1\', \'2\'))')
def induced_subgraph(t):
    nodes, edges = graph_of(t)
    return graph.induced(edges, nodes.filter(F.col("server").isin("1", "2")))


@query(GRAPH + ' SELECT e."from" AS id, e."to" AS other, name, type FROM edges e JOIN nodes n ON n.id = e."to"')
def depends_on(t):
    nodes, edges = graph_of(t)
    return graph.depends_on(edges, nodes)


@query(GRAPH + ' SELECT e."to" AS id, e."from" AS other, name, type FROM edges e JOIN nodes n ON n.id = e."from"')
def used_by(t):
    nodes, edges = graph_of(t)
    return graph.used_by(edges, nodes)


@query(GRAPH + ' SELECT DISTINCT seed, id FROM (SELECT "from" AS seed, "to" AS id FROM edges UNION ALL SELECT "to", "from" FROM edges UNION ALL SELECT id, id FROM nodes)')
def object_neighborhood(t):
    nodes, edges = graph_of(t)
    return graph.neighborhood(edges, nodes.select("id"), 1)


# -- browse ----------------------------------------------------------------------------------------------------------

TOKENS = {
    "tok_is": ([("database", "is", ["brand#11"])], "lower(database) = 'brand#11'"),
    "tok_is_not": ([("schema", "is-not", ["STANDARD"])], "lower(coalesce(schema, '')) <> 'standard'"),
    "tok_is_in": ([("server", "is-in", ["s0", "S2"])], "lower(server) IN ('s0', 's2')"),
    "tok_is_not_in": ([("schema", "is-not-in", ["promo", "small"])], "lower(coalesce(schema, '')) NOT IN ('promo', 'small')"),
    "tok_contains": ([("name", "contains", ["A"])], "contains(lower(\"qualifiedName\"), 'a')"),
    "tok_free_text": ([(None, "contains", ["13"])], "contains(lower(\"qualifiedName\"), '13') OR contains(lower(server), '13') OR contains(lower(database), '13') OR contains(lower(coalesce(schema, '')), '13') OR contains(lower(coalesce(description, '')), '13')"),
    "tok_free_text_blank": ([(None, "contains", ["", "13"])], "TRUE"),
    "tok_conjunction": ([("server", "is", ["S1"]), ("schema", "is-not", ["x"]), ("type", "is-in", [])], "lower(server) = 's1'"),
}


def _token(name, tokens, where):
    def run(t):
        return browse.apply_tokens(part_nodes(t), tokens).select("id", "server", "database", "schema")

    run.__name__ = name
    query(f"{NODES} SELECT id, server, database, schema FROM nodes WHERE {where}")(run)


for _name, (_tokens, _where) in TOKENS.items():
    _token(_name, _tokens, _where)


def _explorer(name, key, descending):
    col = '"changeCount"' if key == "changeCount" else f"lower(coalesce(\"{key}\", ''))"

    def run(t):
        return browse.explorer(part_nodes(t), key, descending).select("id", key)

    run.__name__ = name
    query(f'{NODES} SELECT id, "{key}" FROM nodes ORDER BY {col} {"DESC" if descending else "ASC"}, id LIMIT 500')(run)


SORTS = {"name": "qualifiedName", "server": "server", "database": "database", "schema": "schema", "type": "type", "changes": "changeCount", "last": "lastChangedAt"}
for _name, _key in SORTS.items():
    _explorer(f"explorer_sort_{_name}", _key, False)
    _explorer(f"explorer_sort_{_name}_desc", _key, True)


@query(NODES + " SELECT DISTINCT database AS value FROM nodes WHERE contains(lower(database), '#1') ORDER BY value LIMIT 50")
def suggest_values(t):
    return browse.suggest(part_nodes(t), "database", " #1 ")


@query(NODES + " SELECT id, type FROM nodes WHERE NOT regexp_matches(type, '(?i)^promo') AND (regexp_matches(type, '(?i)steel$') OR regexp_matches(type, '(?i)an'))")
def name_filter(t):
    return part_nodes(t).filter(browse.name_filter(F.col("type"), ["steel$", "AN"], ["^promo"])).select("id", "type")


@query(NODES + " SELECT id FROM nodes WHERE NOT regexp_matches(database, '(?i)#5') AND schema IS NOT NULL AND regexp_matches(schema, '(?i)^(s|p)') AND regexp_matches(name, '(?i)a')")
def filter_cascade(t):
    return browse.filter_cascade(part_nodes(t), ((), ("#5",)), (("^(s|p)",), ()), (("a",), ())).select("id")


@query(NODES + " SELECT id FROM nodes WHERE regexp_matches(database, '(?i)#1') AND NOT regexp_matches(type, '(?i)^eco')")
def effective_filters(t):
    both = browse.effective({"databases": (["#1"], [])}, {"databases": (["#2"], []), "objectNames": ([], ["^eco"])})
    return part_nodes(t).filter(browse.name_filter(F.col("database"), *both["databases"]) & browse.name_filter(F.col("type"), *both["objectNames"])).select("id")


@query(NODES + " SELECT server, database, schema, type, count(*) AS n FROM nodes GROUP BY ALL")
def tree_counts(t):
    return browse.tree_counts(part_nodes(t))


@query(NODES + " SELECT type, count(*) AS n FROM nodes GROUP BY type")
def type_counts(t):
    return browse.type_counts(part_nodes(t))


@query(NODES + " SELECT count(DISTINCT server) AS servers, count(DISTINCT (server, database)) AS databases, count(*) AS objects FROM nodes")
def overview_totals(t):
    return browse.totals(part_nodes(t))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size > 25 THEN 'Type is not in ' || p_type || ', Views' ELSE p_name END AS label FROM part")
def describe_token(t):
    label = F.when(F.col("p_size") > 25, F.replace(F.lit(browse.describe_token("type", "is-not-in", ["?", "Views"])), F.lit("?"), F.col("p_type"))).otherwise(F.replace(F.lit(browse.describe_token(None, "contains", ["?"])), F.lit("?"), F.col("p_name")))
    return t("part").select(F.col("p_partkey").cast("string").alias("id"), label.alias("label"))


# -- access ----------------------------------------------------------------------------------------------------------


@query(GRANTS + " SELECT * FROM grants WHERE contains(lower(grantee), '00002')")
def grantee_search(t):
    return access.grantee_search(lineitem_grants(t), "00002")


@query(GRANTS + " SELECT * FROM grants WHERE lower(grantee) = 'supplier#000000007'")
def grantee_search_exact(t):
    return access.grantee_search(lineitem_grants(t), "SUPPLIER#000000007", exact=True)


@query(GRANTS + " SELECT id, count(*) AS n_grants FROM grants WHERE contains(lower(grantee), '1') GROUP BY id")
def grantee_summary(t):
    return access.grantee_summary(access.grantee_search(lineitem_grants(t), "1"))


@query(GRANTS + " SELECT DISTINCT grantee FROM grants WHERE contains(lower(grantee), '3') ORDER BY grantee LIMIT 20")
def suggest_grantees(t):
    return access.suggest_grantees(lineitem_grants(t), " 3")


@query(GRANTS + " SELECT id, permission || CASE WHEN \"column\" IS NOT NULL THEN '(' || \"column\" || ')' ELSE '' END || CASE WHEN state = 'DENY' THEN ' [DENY]' ELSE '' END AS tag FROM grants")
def grant_tags(t):
    return lineitem_grants(t).select("id", access.tag().alias("tag"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS permission, NULL AS \"column\", 'GRANT' AS state, CAST(NULL AS VARCHAR) AS \"granteeType\" FROM orders UNION ALL SELECT CAST(l_orderkey AS VARCHAR), l_returnflag, CAST(l_linenumber AS VARCHAR), 'GRANT', NULL FROM lineitem")
def grants_union(t):
    a = t("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("permission"))
    return access.union_grants(a, t("lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.col("l_returnflag").alias("permission"), F.col("l_linenumber").cast("string").alias("column")))


LEFT_JOIN = "SELECT CAST(l_partkey AS VARCHAR) AS id, l_returnflag AS permission, CASE WHEN l_linestatus = 'F' THEN 'DENY' ELSE 'GRANT' END AS state, l_linestatus AS grantee, p_name AS \"column\" FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size % 8 = l_linenumber - 1 AND l_linenumber - 1 <> 0 WHERE l_returnflag <> 'R'"


def _left_join(t):
    state = F.when(F.col("l_returnflag") == "R", "GRANT_WITH_GRANT_OPTION").when(F.col("l_linestatus") == "F", "DENY").otherwise("GRANT")
    p = t("lineitem").select(F.col("l_partkey").cast("string").alias("id"), (F.col("l_linenumber") - 1).alias("minor_id"), F.col("l_returnflag").alias("permission"), state.alias("state"), F.col("l_linestatus").alias("grantee"))
    c = t("part").select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") % 8).alias("column_id"), F.col("p_name").alias("name"))
    return access.object_grants(p, c)


@query(LEFT_JOIN)
def left_join_residual(t):
    return _left_join(t)


@query(LEFT_JOIN.replace("SELECT ", "SELECT CASE WHEN p_name IS NULL THEN 'object' ELSE 'column' END AS level, ", 1))
def object_grants(t):
    return _left_join(t).withColumn("level", F.when(F.col("column").isNull(), "object").otherwise("column"))


@query(GRAPH + ' SELECT "from", "to" FROM edges WHERE "from" IN (SELECT id FROM nodes WHERE name LIKE \'%1%\') AND "to" IN (SELECT id FROM nodes WHERE name LIKE \'%1%\')')
def access_subgraph(t):
    nodes, edges = graph_of(t)
    return graph.induced(edges, access.grantee_search(nodes.withColumn("grantee", F.col("name")), "1"))
