"""Lineage inferred from definitions: qualified and bare names, aliases and columns.

Names, servers and databases compare without case. Words and their boundaries are Unicode ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.operators.lookup import prune, tasks_for, with_name
from provenir.storage import cut, small, spread

# The patterns by which names are found, and words that are no alias.
QUALIFIED = r"(?U)\[?([A-Za-z_][\w$#]*)\]?\.\[?([A-Za-z_][\w$#]*)\]?"
BARE = r"(?U)\b([A-Za-z_][\w$#]{3,})\b"
ALIAS = r"\s+(?:AS\s+)?\[?([A-Za-z_][\w$#]*)\]?"
STOP = (
    "WHERE", "ON", "JOIN", "INNER", "LEFT", "RIGHT", "OUTER", "FULL", "CROSS", "GROUP", "ORDER", "HAVING", "UNION", "SET", "VALUES",
    "INTO", "SELECT", "FROM", "AND", "OR", "NOT", "NULL", "IS", "IN", "EXISTS", "BEGIN", "END", "GO", "WITH", "FOR", "BY", "ALL",
    "DISTINCT", "TOP", "AS",
)
#: Rows of a task that makes edges distinct.
EDGE_ROWS = 200_000
#: A word, looked at but not taken with what follows it if that is an alias, and with the first letter after that. The words
#: so found are all that the pattern of an alias can end a name in.
FOLLOWED = r"(?iuU)(?<![\w$#])(?=([\w$#]++\]?" + ALIAS + r"(?:\s+\[?[A-Za-z_])?))[\w$#]"
#: Its parts: the word, ``AS``, the alias, and the letter after it.
PARTS = r"(?iuUs)^([\w$#]++)\]?(\s+(?:AS\s+)?)\[?([A-Za-z_][\w$#]*+)\]?(\s.*)?$"
#: ``name.`` and, looked at but not taken, what follows: a name in brackets or a plain one. Pairs thus overlap.
REFERENCE = r"(?U)\b([\w$#]+)\.(?=\[([^\]]+)\]|([\w$#]+))"


def scan_text(ddl: Column, foreign_keys: Column) -> Column:
    """The definition and, in a line of its own, the foreign keys' section where there is one."""
    return F.concat_ws("\n", ddl, foreign_keys)


def _scope(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"server": F.lower("server"), "database": F.lower("database")})


def _text(nodes: DataFrame, text: str) -> Column:
    return scan_text(F.col(text), F.col("foreign_keys")) if "foreign_keys" in nodes.columns else F.col(text)


def bare_tokens(nodes: DataFrame, text: str = "ddl") -> DataFrame:
    """(id, server, database, token): distinct lower-cased tokens, made distinct inside the row before they multiply."""
    found = F.transform(F.regexp_extract_all(_text(nodes, text), F.lit(BARE), F.lit(1)), lambda x: F.lower(x))
    return _scope(nodes).select("id", "server", "database", F.explode(F.array_distinct(found)).alias("token"))


def _once(*found: DataFrame) -> DataFrame:
    """Distinct edges. They are written first, each part by itself, and then dealt by their number: made distinct in the tasks
    that read the definitions, hardly any would go there, and one task would hold all edges of its share of the input."""
    pairs = [cut(f.filter("`from` <> `to`").select("from", "to"), "edges") for f in found]
    return spread(reduce(DataFrame.unionByName, pairs), EDGE_ROWS, "from", "to").distinct()


def _bare(nodes: DataFrame, text: str) -> DataFrame:
    names = _scope(nodes).select("id", "server", "database", F.lower("name").alias("token"))
    in_db = cut(names.groupBy("server", "database", "token").agg(F.count("*").alias("n"), F.min("id").alias("db_id")).filter("n = 1").drop("n"), "names")
    in_server = cut(names.groupBy("server", "token").agg(F.count("*").alias("n"), F.min("id").alias("server_id")).filter("n = 1").drop("n"), "names")
    hits, tasks = bare_tokens(nodes, text), None
    if not (small(in_db) and small(in_server)):  # else the joins are broadcasts, and nothing is shuffled
        hits = cut(prune(hits, (in_db, ["server", "database", "token"]), (in_server, ["server", "token"])), "tokens")
        tasks = tasks_for(hits, in_db, in_server)
    hits = with_name(with_name(hits, in_db, ["server", "database", "token"], "id", tasks), in_server, ["server", "token"], "id", tasks)
    return hits.select(F.col("id").alias("from"), F.coalesce("db_id", "server_id").alias("to"))


def bare_edges(nodes: DataFrame, text: str = "ddl") -> DataFrame:
    """An edge to the object whose name is unique in the database, else in the server; hits on oneself end the search.

    Tokens that are no unique name of their database or server go before anything is shuffled.
    """
    return _once(_bare(nodes, text))


def _qualified(nodes: DataFrame, text: str) -> DataFrame:
    scoped = _scope(nodes)
    names = scoped.filter("schema is not null").groupBy("server", "database", F.lower("schema").alias("s"), F.lower("name").alias("n")).agg(F.max("id").alias("to"))
    body = _text(nodes, text)
    both = F.arrays_zip(F.regexp_extract_all(body, F.lit(QUALIFIED), F.lit(1)).alias("s"), F.regexp_extract_all(body, F.lit(QUALIFIED), F.lit(2)).alias("n"))
    found = scoped.select(F.col("id").alias("from"), "server", "database", F.inline(F.array_distinct(F.transform(both, lambda x: F.struct(F.lower(x["s"]).alias("s"), F.lower(x["n"]).alias("n"))))))
    keys, names = ["server", "database", "s", "n"], cut(names, "names")
    return with_name(found if small(names) else cut(prune(found, (names, keys)), "tokens"), names, keys, "from").select("from", "to")


def qualified_edges(nodes: DataFrame, text: str = "ddl") -> DataFrame:
    """Edges from ``schema.name`` within a server and database; of equal names the last path wins."""
    return _once(_qualified(nodes, text))


def edges(nodes: DataFrame, text: str = "ddl") -> DataFrame:
    """(from, to) by qualified and bare names in the definition and, if the nodes have that column, in ``foreign_keys``."""
    return _once(_qualified(nodes, text), _bare(nodes, text))


def _literal(c: Column) -> Column:
    return F.regexp_replace(c, "([^A-Za-z0-9_])", r"\\$1")


def _aliases_by_pattern(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from, to, alias) by a pattern of the target's name over the source's definition, edge by edge: for names of any characters."""
    source = nodes.select(F.col("id").alias("from"), "ddl")
    target = nodes.select(F.col("id").alias("to"), "schema", "name")
    schema = F.when(F.col("schema").isNotNull(), F.concat(F.lit(r"(?:\[?"), _literal(F.col("schema")), F.lit(r"\]?\.)?"))).otherwise("")
    pattern = F.concat(F.lit("(?iuU)"), schema, F.lit(r"\[?"), _literal(F.col("name")), F.lit(r"\]?" + ALIAS))
    rows = found.select("from", "to").join(source, "from").join(target, "to").withColumn("p", pattern)
    words = F.transform(F.regexp_extract_all("ddl", F.col("p"), F.lit(1)), lambda x: F.lower(x))
    return rows.select("from", "to", F.explode(F.array_distinct(words)).alias("alias"))


def followed_words(nodes: DataFrame) -> DataFrame:
    """(from, pos, word, alias, until): every word of a definition that an alias may follow, in order, both in small letters.

    ``until`` is the place of the last word that a match here takes: the alias, where it is such a word itself, and an
    ``AS`` before it.
    """
    part = lambda i: F.regexp_extract("phrase", PARTS, i)
    rows = nodes.select(F.col("id").alias("from"), F.posexplode(F.regexp_extract_all("ddl", F.lit(FOLLOWED), F.lit(1))).alias("pos", "phrase"))
    rows = rows.select("from", "pos", F.lower(part(1)).alias("word"), F.lower(part(3)).alias("alias"), (F.trim(F.regexp_replace(part(2), r"(?U)\s+", " ")) != "").cast("int").alias("named"), (part(4) != "").cast("int").alias("more"))
    return rows.select("from", "pos", "word", "alias", (F.col("pos") + F.col("named") + F.col("more")).alias("until"))


def _aliases_by_words(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from, to, alias) for targets whose names are words: each definition is read once, whatever its edges.

    A name matches at the end of any word, as nothing bounds it before. Matches of one edge don't overlap: one that begins
    in another's alias goes, so they are gone through in order.
    """
    target = found.select("from", "to").join(nodes.select(F.col("id").alias("to"), F.lower("name").alias("low")), "to")
    target = target.filter(F.col("low").rlike(r"(?U)^[\w$#]+$"))
    longest = target.agg(F.max(F.length("low"))).first()[0] or 1
    n = F.length("word")
    ends = F.transform(F.sequence(F.greatest(n - longest + 1, F.lit(1)), n), lambda i: F.substring("word", i, n))
    words = followed_words(nodes).select("from", "pos", "alias", "until", F.explode(ends).alias("low"))
    hits = prune(words, (target, ["low"])).join(target, ["from", "low"])
    lists = hits.groupBy("from", "to").agg(F.sort_array(F.collect_list(F.struct("pos", "until", "alias"))).alias("m"))
    step = lambda s, x: F.when(x["pos"] > s["until"], F.struct(x["until"].alias("until"), F.array_append(s["kept"], x["alias"]).alias("kept"))).otherwise(s)
    start = F.struct(F.lit(-1).alias("until"), F.array().cast("array<string>").alias("kept"))
    return lists.select("from", "to", F.explode(F.array_distinct(F.aggregate("m", start, step)["kept"])).alias("alias"))


def aliases(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from, to, alias), lower-cased: the target's own name, and what follows it in the definition but for stop words.

    Targets whose names are words are looked up among the words of each definition, read once; only names with other
    characters need a pattern of their own.
    """
    return _aliases(cut(found.select("from", "to"), "edges"), nodes)


def _aliases(found: DataFrame, nodes: DataFrame) -> DataFrame:
    own = found.select("from", "to").join(nodes.select(F.col("id").alias("to"), F.lower("name").alias("alias")), "to").select("from", "to", "alias")
    odd = nodes.filter(~F.lower("name").rlike(r"(?U)^[\w$#]+$")).select(F.col("id").alias("to"))
    named = _aliases_by_words(found, nodes).unionByName(_aliases_by_pattern(found.join(odd, "to", "left_semi"), nodes))
    return own.unionByName(named.filter(~F.upper("alias").isin(*STOP))).distinct()


def column_refs(found: DataFrame, nodes: DataFrame, columns: DataFrame) -> DataFrame:
    """(from, to, columns): names after an alias of the target that are its columns, in the spelling first seen, sorted.

    ``dbo.Orders.Id`` holds both ``dbo.Orders`` and ``Orders.Id``; a name in brackets may have any characters. A name
    must end in a letter, digit or underscore, and ends at ``$`` or ``#`` too, as a word boundary would have it. Only the
    definition is read, not the foreign keys. Unbracketed names with blanks in them are not found.
    """
    part = lambda i: F.regexp_extract_all("ddl", F.lit(REFERENCE), F.lit(i))
    pairs = nodes.select(F.col("id").alias("from"), F.posexplode(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))).alias("pos", "m"))
    spelled = F.array_distinct(F.array(F.when(F.col("m.b") != "", F.col("m.b")).otherwise(F.col("m.c")), F.regexp_extract("m.c", r"(?U)^(\w+)", 1)))
    called = F.array_distinct(F.array(F.lower("m.a"), F.regexp_extract(F.lower("m.a"), r"(?U)(\w+)$", 1)))
    pairs = pairs.select("from", "pos", F.explode(called).alias("alias"), spelled.alias("spelled")).select("from", "pos", "alias", F.explode("spelled").alias("column"))
    pairs = pairs.filter(F.col("column").rlike(r"(?U)\w$") & (F.col("alias") != ""))
    known = columns.filter("name <> ''").select(F.col("id").alias("to"), F.lower("name").alias("low")).distinct()
    found = cut(found.select("from", "to"), "edges")
    hits = _aliases(found, nodes).join(pairs, ["from", "alias"]).withColumn("low", F.lower("column")).join(known, ["to", "low"], "left_semi")
    first = hits.groupBy("from", "to", "low").agg(F.min_by("column", F.struct("pos", -F.length("column"))).alias("column"))
    lists = first.groupBy("from", "to").agg(F.sort_array(F.collect_list("column")).alias("columns"))
    return found.select("from", "to").join(lists, ["from", "to"], "left").select("from", "to", F.coalesce("columns", F.array().cast("array<string>")).alias("columns"))


def edge_label(columns: Column, shown: int = 3) -> Column:
    """The first names and how many more; null without any."""
    more = F.when(F.size(columns) > shown, F.concat(F.lit(", +"), (F.size(columns) - shown).cast("string"), F.lit(" (click)"))).otherwise("")
    return F.when(F.size(columns) > 0, F.concat(F.array_join(F.slice(columns, 1, shown), ", "), more))


def column_tags(columns: Column, shown: int = 6) -> Column:
    """The first names as a list, the last entry telling how many more."""
    more = F.when(F.size(columns) > shown, F.array(F.concat(F.lit("+"), (F.size(columns) - shown).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.slice(columns, 1, shown), more)


def drawable(node_ids: DataFrame, most: int = 300) -> bool:
    """True if a graph has few enough nodes to be drawn."""
    return node_ids.limit(most + 1).count() <= most
