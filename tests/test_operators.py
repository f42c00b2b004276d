"""Catalog operators on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from provenir.functions import scalar
from provenir.operators import access, browse, catalog, extract, graph, history, lineage, metrics, parse
from provenir.sources import files
from provenir.streaming.metrics import fold
from provenir.streaming.metrics import history as history_of


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_paths(spark):
    df = spark.createDataFrame([("S/D/Tables/dbo/a.b.sql",), ("S/_ServerLevel/LinkedServers/R.SQL",), ("S/D/x.sql",), (r"S\D\T\s\e\f.sql",)], "path string")
    got = {r["id"]: r for r in parse.parse_path(df).collect()}
    assert set(got) == {"S/D/Tables/dbo/a.b", "S/_ServerLevel/LinkedServers/R", "S/D/T/s/e/f"}
    assert got["S/D/Tables/dbo/a.b"]["qualifiedName"] == "dbo.a.b" and got["S/D/T/s/e/f"]["schema"] is None


def test_sections(spark):
    texts = {
        "plain": "SELECT 1\n",
        "header": "-- a\n-- b\n\nSELECT 2\n\n-- === Columns ===\n-- [col] x|int\n-- [col] y|decimal(1|2)\nnoise\n-- === columns ===\n-- [col] z|int\n-- === Notes ===\n free text \n",
        "only": "-- a\n-- b",
        "first": "-- a\n\n-- === Notes ===\nbody",
    }
    p = parse.split_sections(spark.createDataFrame(list(texts.items()), "id string, text string"))
    assert {r["id"]: r["ddl"] for r in p.collect()} == {"plain": "SELECT 1", "header": "SELECT 2", "only": "", "first": ""}
    odd = "-- h\n\nx\n\n-- === Columns ===\n-- [col] Id|int\n-- [col] |\n\n-- === Extended Properties ===\n-- [object] MS_Description = \n-- [object] Some Description = no\n-- [object] X_DESCRIPTION = real\n-- [column: ID] MS_Description = key\n-- [column: a]b] MS_Description = 1\n-- [column: A]B] MS_Description = 2"
    q = parse.split_sections(spark.createDataFrame([("o", odd)], "id string, text string"))
    assert {(r["column"], r["description"]) for r in parse.properties(q).collect()} == {(None, "real"), ("ID", "key"), ("a]b", "2")}
    assert rows(parse.merge_columns(parse.columns(q), parse.properties(q)).fillna("-"), "name", "dataType", "description") == [("", "", "-"), ("Id", "int", "key")]
    assert rows(parse.merge_columns(parse.columns(q).limit(0), parse.properties(q)).fillna("-"), "name", "dataType", "description") == [("ID", "-", "key"), ("a]b", "-", "2")]
    assert rows(parse.columns(p), "id", "ordinal", "name", "dataType") == [("header", 0, "x", "int"), ("header", 1, "y", "decimal(1|2)")]
    assert rows(parse.other_sections(p), "id", "title", "content") == [("first", "Notes", "body"), ("header", "Notes", "free text")]


def demo(spark):
    """A small server: the foreign key of Orders, a procedure, a view and a linked server."""
    n = lambda id, schema, name, ddl, db="App": (id, "S", db, schema, name, ddl)
    return spark.createDataFrame(
        [
            n("orders", "dbo", "Orders", "CREATE TABLE x\nFOREIGN KEY REFERENCES [dbo].[Users] (Id)"),
            n("users", "dbo", "Users", "CREATE TABLE [dbo].[Users] (Id int)"),
            n("proc", "dbo", "usp_Get", "SELECT o.Id, o.[Total], [o].[UserId] FROM dbo.Orders AS o JOIN dbo.Users u ON o.UserId = u.Id WHERE 1 = 1; EXEC REMOTE1"),
            n("view", "dbo", "vw_Active", "SELECT Id FROM Users WHERE abc"),
            n("link", None, "REMOTE1", "-- server", "_ServerLevel"),
            n("dup1", "a", "Twice", "x"),
            n("dup2", "b", "Twice", "Twice Users"),
        ],
        "id string, server string, database string, schema string, name string, ddl string",
    )


def test_lineage(spark):
    nodes = demo(spark)
    found = lineage.edges(nodes)
    assert rows(found, "from", "to") == [("dup2", "users"), ("orders", "users"), ("proc", "link"), ("proc", "orders"), ("proc", "users"), ("view", "users")]
    columns = spark.createDataFrame([("orders", "Id"), ("orders", "Total"), ("orders", "UserId"), ("users", "Id")], "id string, name string")
    refs = {(r["from"], r["to"]): r["columns"] for r in lineage.column_refs(found, nodes, columns).collect()}
    assert refs["proc", "orders"] == ["Id", "Total", "UserId"] and refs["proc", "users"] == ["Id"] and refs["view", "users"] == []
    names = {r["alias"] for r in lineage.aliases(found, nodes).filter("`from` = 'view'").collect()}
    assert names == {"users"}  # WHERE is no alias


def test_lineage_of_odd_names(spark):
    """Three-part names, names in brackets, Unicode, case, foreign keys in a section of their own."""
    n = lambda id, server, db, schema, name, ddl, fk=None: (id, server, db, schema, name, ddl, fk)
    nodes = spark.createDataFrame(
        [
            n("t", "S", "App", "dbo", "Orders", "x"), n("g", "S", "App", "dbo", "Größe", "x"), n("k", "S", "App", "dbo", "Kept", "x"),
            n("p", "s", "APP", "dbo", "p1", "SELECT dbo.Orders.Id, o.[Unit Price], o.Id$x, o.Flag$ FROM dbo.Orders o"),
            n("q", "S", "App", "dbo", "q1", "FROM Größe, größen"), n("r", "S", "App", "dbo", "r1", "x", "REFERENCES [dbo].[Kept] (Id)"),
        ],
        "id string, server string, database string, schema string, name string, ddl string, foreign_keys string",
    )
    found = lineage.edges(nodes)
    assert rows(found, "from", "to") == [("p", "t"), ("q", "g"), ("r", "k")]
    columns = spark.createDataFrame([("t", "ID"), ("t", "unit price"), ("t", "Flag$"), ("k", "Id")], "id string, name string")
    refs = {(r["from"], r["to"]): r["columns"] for r in lineage.column_refs(found, nodes, columns).collect()}
    assert refs["p", "t"] == ["Id", "Unit Price"] and refs["r", "k"] == []


def test_alias_needs_no_boundary(spark):
    nodes = spark.createDataFrame([("t", "s", "d", None, "Orders", ""), ("p", "s", "d", None, "p", "FROM CustomerOrders co")], "id string, server string, database string, schema string, name string, ddl string")
    pair = spark.createDataFrame([("p", "t")], "`from` string, `to` string")
    assert {r["alias"] for r in lineage.aliases(pair, nodes).collect()} == {"orders", "co"}


def test_walks(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "x"), ("x", "y"), ("c", "gone"), ("gone", "a")], "`from` string, `to` string")
    nodes = spark.createDataFrame([(i, "1" if i < "x" else "2", "Tables", i) for i in "abcxy"], "id string, server string, type string, name string")
    seed = spark.createDataFrame([("a",), ("nobody",)], "id string")
    assert rows(graph.reachable(edges, nodes, seed), "id", "hop") == [("b", 1), ("c", 2), ("gone", 3), ("x", 2)]
    assert rows(graph.reachable(edges, nodes, seed, incoming=True), "id", "hop") == [("b", 2), ("c", 1), ("gone", 1)]
    assert graph.reachable(edges, nodes, seed, hops=0).count() == 0
    assert rows(graph.neighborhood(edges, seed.limit(1), 1), "id") == [("a",), ("b",), ("c",), ("gone",)]
    assert rows(graph.top_referenced(edges, nodes, keep=1), "id", "direct") == [("a", 2)]


def test_history(spark):
    touched = spark.createDataFrame([("c1", 1, "a"), ("c1", 1, "b"), ("c2", 2, "a"), ("c2", 2, "b"), ("c3", 3, "a")] + [("big", 4, f"n{i}") for i in range(41)], "sha string, date long, id string")
    assert rows(history.co_change(touched), "a", "b", "count") == [("a", "b", 2)]
    assert history.co_change(touched, 41).count() == 1 + 41 * 40 // 2
    commits = touched.select("sha", F.lit("m").alias("message")).distinct()
    assert rows(history.version_history(touched, commits, 2).filter("id = 'a'"), "rank", "sha") == [(1, "c3"), (2, "c2")]
    log = spark.createDataFrame([(1, 0, "noise"), (1, 1, "@@COMMIT@@s1@@d1@@fix @@ sign"), (1, 2, " x.sql\t"), (1, 3, ""), (1, 4, "@@COMMIT@@s2@@d2@@m"), (1, 5, "y.sql")], "log int, line_no int, value string")
    assert rows(history.parse_git_log(log), "sha", "message", "path") == [("s1", "fix @@ sign", "x.sql"), ("s2", "m", "y.sql")]
    changes = spark.createDataFrame([("c", "d", "db/A/x.sql"), ("c", "d", "db/A/y.SQL"), ("c", "d", "other/A/x.sql")], "sha string, date string, path string")
    live = spark.createDataFrame([("a/X",), ("A/y",)], "id string")
    assert rows(history.commit_objects(changes, live, "db/"), "id") == [("a/X",)]


def test_history_beyond_the_budget(spark):
    versions = spark.createDataFrame([("a", 1, "s1"), ("a", 2, "s2"), ("b", 1, "s1"), ("c", 1, "s1")], "id string, rank long, sha string").withColumns({"date": F.col("sha"), "message": F.lit("m")})
    blobs = spark.createDataFrame([("a", "s1", "-- h\n\nSELECT 1\n\n-- === Columns ===\n"), ("b", "s1", "plain")], "id string, sha string, text string")
    got = {r["id"]: [(v["sha"], v["ddl"]) for v in r["history"]] for r in history.object_history(versions, blobs, parse.split_sections, 3).collect()}
    assert got == {"a": [("s1", "SELECT 1"), ("s2", None)], "b": [("s1", "plain")], "c": []}


@pytest.mark.parametrize("name,include,exclude,want", [("SYS", [], ["^sys$"], False), ("fin_ap", ["^dbo$", "^fin_.*$"], [], True), ("x", [], ["y"], True), ("both", ["both"], ["both"], False), ("mytempdb", ["temp"], [], True)])
def test_name_filter(spark, name, include, exclude, want):
    assert spark.range(1).select(browse.name_filter(F.lit(name), include, exclude)).first()[0] is want


def test_tokens_and_grants(spark):
    nodes = spark.createDataFrame([("1", "A", None), ("2", "b", "x")], "id string, server string, schema string")
    assert rows(browse.apply_tokens(nodes, [("schema", "is-not", ["x"])]), "id") == [("1",)]
    assert browse.apply_tokens(nodes, []).count() == 2 and browse.apply_tokens(nodes, [("server", "is", [""])]).count() == 2
    assert browse.apply_tokens(nodes.withColumns({"qualifiedName": F.lit("Q"), "database": F.lit("d"), "description": F.lit(None)}), [("name", "is", ["q"]), (None, "contains", ["", "zz"])]).count() == 2
    assert browse.describe_token("type", "is-not", ["Views"]) == "Type is not Views" and browse.describe_token(None, "contains", ["a b"]) == "a b"
    tree = browse.tree(nodes.withColumns({"database": F.lit("d"), "type": F.lit("T"), "name": F.col("id")})).orderBy("server").collect()
    assert [r["server"] for r in tree] == ["A", "b"] and tree[1]["databases"][0]["schemas"][0]["types"][0]["objects"][0]["id"] == "2"
    grants = spark.createDataFrame([("1", "app_reader"), ("2", "APP_writer")], "id string, grantee string")
    assert access.grantee_search(grants, "app").count() == 2 and access.grantee_search(grants, "App_Reader", exact=True).count() == 1 and access.grantee_search(grants, " ").count() == 0
    assert access.suggest_grantees(grants, " APP_r ").count() == 1
    union = access.union_grants(grants.withColumn("state", F.lit("DENY")), grants)
    assert {(r["state"], r["granteeType"]) for r in union.collect()} == {("GRANT", None)}


def test_types(spark):
    got = lambda k, n: spark.range(1).select(extract.type_suffix(F.lit(k), F.lit(n), F.lit(9), F.lit(2))).first()[0]
    assert [got(*x) for x in (("varchar", -1), ("VARCHAR", 5), ("nvarchar", 10), ("numeric", 5), ("int", 4))] == ["(MAX)", "(5)", "(5)", "(9,2)", ""]


def test_retention(spark, tmp_path):
    old = spark.range(1, 91).select(F.lit("t").alias("id"), F.col("id").alias("seq"))
    for n in (89, 90, 91):
        got = metrics.retain(old.limit(0), spark.range(1, n + 1).select(F.lit("t").alias("id"), F.col("id").alias("seq")))
        assert got.count() == min(n, 90) and got.agg(F.min("seq")).first()[0] == max(1, n - 89)
    same = spark.createDataFrame([("t", 1, "old")], "id string, seq long, v string")
    assert rows(metrics.retain(same, same.withColumn("v", F.lit("new")), 1), "v") == [("new",)]
    run = fold(str(tmp_path), keep=3)
    for number in range(3):
        run(spark.range(number * 2, number * 2 + 2).select(F.lit("t").alias("id"), F.col("id").alias("seq")), number)
    assert rows(history_of(spark, str(tmp_path), "id string, seq long"), "seq") == [(3,), (4,), (5,)]


def test_scale_and_points(spark):
    s = spark.createDataFrame([("a", 1, -5, None), ("a", 2, -1, -9), ("b", 1, 3, None), ("c", 1, None, None)], "id string, seq long, x long, y long")
    r = metrics.scale(s, "x", "y")
    assert rows(r, "id", "low", "high", "span") == [("a", -9, -1, 8), ("b", 0, 3, 3)]
    assert rows(metrics.chart_points(s, "x", r), "id", "x", "y") == [("a", 10.0, 140 - 4 / 8 * 130), ("a", 630.0, 10.0), ("b", 320.0, 10.0)]


def test_times_are_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert spark.range(1).select(scalar.iso_utc(F.timestamp_seconds(F.lit(0)))).first()[0] == "1970-01-01T00:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_catalog(spark, tmp_path):
    """From object files to the catalog, and back from the written document; unreadable parts are warnings."""
    head = "-- Generated\n-- Server: S\n\n"
    table = head + "CREATE TABLE [dbo].[Orders] (Id int);\n\n-- === Foreign Keys ===\nREFERENCES [dbo].[Users] (Id)\n\n-- === Columns ===\n-- [col] Id|int\n-- [col] Unit Price|money\n\n-- === Grants ===\n-- [grant] SELECT|GRANT|app||\n\n-- === Extended Properties ===\n-- [object] MS_Description = \n-- [object] MS_Description = All orders\n-- [column: ID] MS_Description = key\n"
    tree = {
        "S/App/Tables/dbo/Orders.sql": table,
        "S/App/Tables/dbo/Users.sql": head + "x\n\n-- === Extended Properties ===\n-- [column: Id] MS_Description = user",
        "S/App/Views/dbo/v.sql": head + "SELECT o.Id, o.[Unit Price] FROM dbo.Orders AS o",
        "S/stray.sql": "nothing",
    }
    for path, text in tree.items():
        (tmp_path / "objects" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "objects" / path).write_text(text)
    measured = tmp_path / "metrics/S/App/Tables/dbo"
    measured.mkdir(parents=True)
    (measured / "Orders.json").write_text('[{"capturedAt": "t1", "rowCount": 5, "indexes": [{"name": "i", "seeks": 2}], "statistics": []}]')
    (measured / "Users.json").write_text("no json")
    log = ["@@COMMIT@@s2@@2024-02-02@@more", "db/S/App/Tables/dbo/Orders.sql", "db/S/App/Views/dbo/v.sql", "@@COMMIT@@s1@@2024-01-01@@first", "db/S/App/Tables/dbo/Orders.sql"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(log)], "log int, line_no int, value string")
    blobs = spark.createDataFrame([("S/App/Tables/dbo/Orders", "s1", head + "old")], "id string, sha string, text string")
    objects = files.object_files(spark, f"{tmp_path}/objects")
    made = catalog.assemble(objects, metrics=files.object_files(spark, f"{tmp_path}/metrics", "*.json"), log=lines, blobs=blobs, prefix="db/")
    assert rows(made.warnings, "kind", "name") == [("unexpected path", "S/stray.sql"), ("unreadable metrics", "S/App/Tables/dbo/Users.json")]
    files.write_catalog(catalog.document(made, "now"), f"{tmp_path}/catalog")
    back = files.catalog(spark, f"{tmp_path}/catalog").first()
    nodes = {n["qualifiedName"]: n for n in back["nodes"]}
    orders = nodes["dbo.Orders"]
    assert [tuple(c) for c in orders["columns"]] == [("Id", "key", "int"), ("Unit Price", None, "money")] and orders["description"] == "All orders"
    assert [tuple(g) for g in orders["grants"]] == [("SELECT", "GRANT", "app", None, None)] and [s["title"] for s in orders["sections"]] == ["Foreign Keys"]
    assert orders["ddl"] == "CREATE TABLE [dbo].[Orders] (Id int);" and orders["sizeBytes"] == len(orders["ddl"]) and orders["metrics"][0]["indexes"][0]["seeks"] == 2
    assert orders["changeCount"] == 2 and orders["lastChangedAt"] == "2024-02-02" and [(v["sha"], v["ddl"]) for v in orders["history"]] == [("s2", None), ("s1", "old")]
    assert [tuple(c) for c in nodes["dbo.Users"]["columns"]] == [("Id", "user", None)] and nodes["dbo.Users"]["metrics"] == [] and nodes["dbo.Users"]["changeCount"] == 0
    assert {(e["from"][-6:], e["to"][-6:], tuple(e["columns"])) for e in back["edges"]} == {("Orders", "/Users", ()), ("/dbo/v", "Orders", ("Id", "Unit Price"))}
    assert [(p["a"][-6:], p["count"]) for p in back["coChangePairs"]] == [("Orders", 1)] and [c["sha"] for c in back["recentChanges"]] == ["s1", "s2"]
    assert back["typeCounts"] == {"Tables": 2, "Views": 1} and back["servers"] == ["S"]
    catalog.write(made, f"{tmp_path}/parts")
    assert spark.read.json(f"{tmp_path}/parts/nodes").count() == 3
    empty = catalog.assemble(objects.limit(0))
    assert empty.nodes.count() == empty.edges.count() == empty.co_change_pairs.count() == 0
    with pytest.raises(ValueError):
        catalog.document(made, "now", most=2)


def test_missing_inputs_are_warnings(spark, tmp_path):
    warnings = []
    got = files.optional(spark, lambda: spark.read.json(f"{tmp_path}/nowhere"), "a long", warnings, "metrics")
    assert got.columns == ["a"] and got.count() == 0 and warnings[0].startswith("metrics: ")
    (tmp_path / "good.json").write_text('{"a": 1}')
    (tmp_path / "bad.json").write_text("{")
    found = {r["path"]: [x["a"] for x in r["rows"]] for r in files.json_rows(spark, str(tmp_path), "a long", warnings).collect()}
    assert found == {"good.json": [1], "bad.json": []} and warnings[1:] == ["bad.json: no JSON list"]


def test_jdbc_options():
    got = files.jdbc_options("jdbc:x", "SELECT :owner, ':owner2', x::owner", {"owner": "O'Neil"}, fetchsize="9")
    assert got["query"] == "SELECT 'O''Neil', ':owner2', x::owner" and got["queryTimeout"] == "120" and got["loginTimeout"] == "30" and got["fetchsize"] == "9"
    assert files.oracle_session().count("SET_TRANSFORM_PARAM") == 4
    assert "'SALES'" in files.jdbc_options("u", **files.oracle_ddl("SALES", "PACKAGE BODY"))["query"]


def test_files(spark, tmp_path):
    (tmp_path / "tree/S/D").mkdir(parents=True)
    (tmp_path / "tree/S/D/a.sql").write_text("SELECT\n1")
    (tmp_path / "tree/S/D/b.json").write_text("{}")
    assert rows(files.object_files(spark, f"{tmp_path}/tree"), "path", "text") == [("S/D/a.sql", "SELECT\n1")]
    edges = spark.createDataFrame([("g", [("a", "b", ["x"])])], "generatedAt string, edges array<struct<`from`:string,`to`:string,columns:array<string>>>")
    files.write_catalog(edges, f"{tmp_path}/catalog")
    back = files.catalog(spark, f"{tmp_path}/catalog").select(F.explode("edges").alias("e")).select("e.*")
    assert rows(back, "from", "to") == [("a", "b")]


def test_config():
    good = {"name": "a", "type": "mssql", "host": "h", "credentialsVariablePrefix": "P"}
    assert files.check_config({"servers": [good]})
    for bad in ({"servers": []}, {"servers": [good | {"host": ""}]}, {"servers": [good | {"type": "x"}]}, {"servers": [good | {"type": "oracle"}]}):
        with pytest.raises(ValueError):
            files.check_config(bad)
    assert browse.effective({"schemas": 1}, {"schemas": 2, "databases": 3})["schemas"] == 1
