"""Queries over sinks and sources: each writes what it derives from the tables to shared storage and reads it back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from provenir.operators import browse, graph, history, metrics
from provenir.operators.asof import as_of
from provenir.operators.search import search
from provenir.plans.queries import SERIES, event_series, query
from provenir.sources.gitlog import MARK, git_log
from provenir.sources.tree import current_tree, mirrored_path, publish
from provenir.storage import cut, keep, shared_dir, shuffled, spread


def _folder(spark, name: str) -> str:
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    keep(spark, path)
    return path


# -- publication -----------------------------------------------------------------------------------------------------

PUBLISH = """
WITH objects AS (
  SELECT 'S' || (p_size % 3) || '/' || p_brand || '/Tables/' || CASE WHEN p_size % 5 <> 0 THEN split_part(p_type, ' ', 1) || '/' ELSE '' END || p_partkey || '_' || p_name || '.sql' AS path,
         p_size, p_name || chr(10) AS text
  FROM part
), old AS (
  SELECT path, text FROM objects WHERE p_size > 10
), new AS (
  SELECT path, CASE WHEN p_size % 7 = 0 THEN 'changed ' ELSE '' END || text AS text FROM objects WHERE p_size <= 45
)
SELECT path, CASE WHEN old.text IS NULL THEN 'added' WHEN new.text IS NULL THEN 'removed' WHEN old.text = new.text THEN 'unchanged' ELSE 'modified' END AS status,
       sha256(new.text) AS sha256
FROM old FULL JOIN new USING (path)
"""


@query(PUBLISH)
def publish_tree(t):
    """Two publications of the parts' object tree: what the second changed, and the files it left."""
    part = spread(t("part"))
    schema = F.when(F.col("p_size") % 5 != 0, F.split("p_type", " ")[0])
    path = mirrored_path(F.concat(F.lit("S"), F.col("p_size") % 3), F.col("p_brand"), F.lit("Tables"), schema, F.concat_ws(":", "p_partkey", "p_name"))
    objects = part.select(path.alias("path"), F.concat("p_name", F.lit("\n")).alias("text"), "p_size")
    root = _folder(part.sparkSession, "tree")
    publish(objects.filter("p_size > 10").select("path", "text"), root)
    before = cut(current_tree(part.sparkSession, root).select("path", F.sha2("text", 256).alias("hash")), "before")
    publish(objects.filter("p_size <= 45").select("path", F.concat(F.when(F.col("p_size") % 7 == 0, "changed ").otherwise(""), "text").alias("text")), root)
    after = cut(current_tree(part.sparkSession, root).select("path", F.sha2("text", 256).alias("hash")), "after")
    return history.tree_diff(before, after).join(shuffled(after.withColumnRenamed("hash", "sha256")), "path", "left")


# -- the git log -----------------------------------------------------------------------------------------------------

GITLOG = """
SELECT CAST(o_orderkey AS VARCHAR) AS sha, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority || '@@' || o_orderstatus AS message, 'db/' || l_partkey || '.sql' AS path
FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey
"""


@query(GITLOG)
def gitlog_scan(t):
    """Orders as a git log in a few long files, read back by splits."""
    paths = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("db/"), F.col("l_partkey").cast("string"), F.lit(".sql")).alias("path")).distinct()
    bodies = paths.groupBy("o_orderkey").agg(F.array_join(F.collect_list("path"), "\n").alias("body"))
    head = F.concat_ws("@@", F.lit(MARK[:-2]), F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority", "o_orderstatus")
    log = t("orders").join(bodies, "o_orderkey", "left").select(F.concat_ws("\n", head, F.col("body"), F.lit("")).alias("value"))
    folder = _folder(log.sparkSession, "log")
    log.write.text(folder)
    return git_log(log.sparkSession, folder)


# -- walks -----------------------------------------------------------------------------------------------------------

RINGS = """
WITH RECURSIVE edges AS (
  SELECT o_orderkey AS src, coalesce(lead(o_orderkey) OVER w, first_value(o_orderkey) OVER w) AS dst FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
), walk AS (
  SELECT o_orderkey AS seed, o_orderkey AS id, 0 AS hop, o_orderstatus AS home, TRUE AS grows FROM orders
  UNION
  SELECT walk.seed, e.dst, walk.hop + 1, walk.home, o.o_orderstatus = walk.home FROM walk JOIN edges e ON e.src = walk.id JOIN orders o ON o.o_orderkey = e.dst
  WHERE walk.grows AND walk.hop < 6
)
SELECT CAST(seed AS VARCHAR) AS seed, CAST(id AS VARCHAR) AS id, CAST(min(hop) AS BIGINT) AS hop FROM walk WHERE id <> seed GROUP BY seed, id
"""


def order_rings(t):
    """Each customer's orders as a ring, by date; an order's status is its server."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    after = F.coalesce(F.lead("o_orderkey").over(w), F.first("o_orderkey").over(w))
    orders = t("orders")
    nodes = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("server"))
    return nodes, orders.select(F.col("o_orderkey").cast("string").alias("from"), after.cast("string").alias("to"))


@query(RINGS)
def reachable_rings(t):
    """Walks of up to six hops around rings that are longer, from every order; those to another server end there."""
    nodes, edges = order_rings(t)
    return graph.reachable(edges, nodes, nodes.select("id"))


# -- as-of joins and levels ------------------------------------------------------------------------------------------

AS_OF = """
WITH versions AS (
  SELECT client_id AS id, valid_at AS date, max(change_id) AS sha FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL GROUP BY client_id, valid_at
)
SELECT s.sale_id, s.client_id AS id, s.sold_at AS "at", v.date, v.sha
FROM sales s ASOF LEFT JOIN versions v ON s.client_id = v.id AND s.sold_at >= v.date
"""


@query(AS_OF)
def as_of_sales(t):
    """The change of its client that was the latest when each sale was made."""
    versions = t("client_changes").select(F.col("client_id").alias("id"), F.col("valid_at").alias("date"), F.col("change_id").alias("sha"))
    return as_of(versions, t("sales").select("sale_id", F.col("client_id").alias("id"), F.col("sold_at").alias("at")), width=86400)


LEVELS = """
WITH nodes AS (
  SELECT coalesce(source, 'none') AS server, segment AS database, city AS schema, CASE WHEN balance < 0 THEN 'debt' ELSE 'fine' END AS type FROM clients
), sets AS (
  SELECT 4 - (grouping(server) + grouping(database) + grouping(schema) + grouping(type)) AS level, server, database, schema, type, count(*) AS n
  FROM nodes GROUP BY GROUPING SETS ((), (server), (server, database), (server, database, schema), (server, database, schema, type))
)
SELECT CAST(level AS BIGINT) AS level, server, database, schema, type, n,
  CASE WHEN level > 0 THEN '/=' || server ELSE '' END
  || CASE WHEN level > 1 THEN '/' || coalesce('=' || replace(replace(database, '!', '!1'), '/', '!2'), '-') ELSE '' END
  || CASE WHEN level > 2 THEN '/' || coalesce('=' || replace(replace(schema, '!', '!1'), '/', '!2'), '-') ELSE '' END
  || CASE WHEN level > 3 THEN '/=' || type ELSE '' END AS path
FROM sets
"""


@query(LEVELS)
def tree_levels(t):
    """Clients by source, segment, city and balance, on all levels at once."""
    kind = F.when(F.col("balance") < 0, "debt").otherwise("fine")
    return browse.tree_levels(t("clients").select(F.coalesce("source", F.lit("none")).alias("server"), F.col("segment").alias("database"), F.col("city").alias("schema"), kind.alias("type")))


# -- search and runs -------------------------------------------------------------------------------------------------

SEARCH = """
WITH needles AS (SELECT DISTINCT split_part(name, ' ', 2) AS needle FROM vendors WHERE name IS NOT NULL
  UNION SELECT DISTINCT substr(split_part(name, ' ', 2), 1, 6) FROM vendors WHERE name IS NOT NULL)
SELECT needle, client_id AS id FROM needles JOIN (SELECT client_id, min(lower(coalesce(name, ''))) AS a, min(lower(coalesce(email, ''))) AS b FROM clients WHERE client_id IS NOT NULL GROUP BY client_id) c
ON contains(a, lower(needle)) OR contains(b, lower(needle))
"""


@query(SEARCH)
def search_names(t):
    """Clients whose name or address holds the family name of a vendor, or its first six letters."""
    vendors = t("vendors").filter("name is not null").select(F.coalesce(F.get(F.split("name", " "), F.lit(1)), F.lit("")).alias("n"))
    needles = vendors.select(F.col("n").alias("needle")).unionByName(vendors.select(F.substring("n", 1, 6).alias("needle")))
    clients = t("clients").filter("client_id is not null").groupBy(F.col("client_id").alias("id")).agg(F.min(F.lower(F.coalesce("name", F.lit("")))).alias("name"), F.min(F.lower(F.coalesce("email", F.lit("")))).alias("email"))
    return search(clients, needles, fields=("name", "email"))


@query(
    SERIES
    + """, v AS (SELECT id, seq, row_count % 2 AS v FROM m),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY seq) AS run FROM (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY id ORDER BY seq) THEN 0 ELSE 1 END AS fresh FROM v))
SELECT id, min(seq) AS first, max(seq) AS last, count(*) AS n, v FROM r GROUP BY id, run, v"""
)
def metrics_runs(t):
    """Snapshots of the events, compressed to runs of equal values."""
    return metrics.runs(event_series(t).select("id", "seq", (F.col("row_count") % 2).alias("v")), "v")
