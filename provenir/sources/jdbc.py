"""Databases over JDBC: scans in parts, session settings, and definitions fetched in sets that shrink where one fails."""

from __future__ import annotations

import datetime
import decimal
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provenir.storage import cut


def literal(value: object) -> str:
    """A value as SQL: null, numbers, truth values, dates and instants (without a zone), texts, and lists of them in brackets."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, decimal.Decimal)):
        return str(value)
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ', timespec='microseconds')}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, (list, tuple, set)):
        return "(" + ", ".join(literal(v) for v in value or [None]) + ")"
    return "'" + str(value).replace("'", "''") + "'"


def bound(query: str, parameters: dict | None = None) -> str:
    """The query with each ``:name`` outside quotes replaced by its value."""
    if not parameters:
        return query
    names = "|".join(sorted(map(re.escape, parameters), key=len, reverse=True))
    found = re.compile(rf"'(?:[^']|'')*'|(?<![:\w]):({names})\b")
    return found.sub(lambda m: literal(parameters[m[1]]) if m[1] else m[0], query)


def options(url: str, parameters: dict | None = None, session: str | None = None, **more: str) -> dict[str, str]:
    """Options of a JDBC scan: 120 s a query and 30 s to connect by default, and a statement that each connection begins with."""
    begin = {"sessionInitStatement": bound(session, parameters)} if session else {}
    return {"url": url, "queryTimeout": "120", "loginTimeout": "30", "connectTimeout": "30000"} | begin | more


def read(spark: SparkSession, url: str, query: str, parameters: dict | None = None, *, session: str | None = None, **more: str) -> DataFrame:
    """Rows of a query, in one part."""
    return spark.read.format("jdbc").options(**options(url, parameters, session, **more)).option("query", bound(query, parameters)).load()


def ranges(low: int, high: int, parts: int, column: str) -> list[str]:
    """Predicates that deal whole numbers from ``low`` to ``high`` over parts; the first also takes rows without one."""
    parts = max(1, min(parts, high - low + 1))
    cuts = [low + (high - low + 1) * i // parts for i in range(1, parts)]
    where = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    if not cuts:
        return ["1 = 1"]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *where, f"{column} >= {cuts[-1]}"]


def read_in_parts(spark: SparkSession, url: str, query: str, column: str, parameters: dict | None = None, *, parts: int = 8, session: str | None = None, **more: str) -> DataFrame:
    """Rows of a query, read by as many connections as there are parts of a whole-number column.

    The bounds are asked of the database first. An empty table is one part; rows without a value come with the first.
    """
    text = bound(query, parameters)
    low, high = read(spark, url, f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM ({text}) q", session=session, **more).first()
    where = ["1 = 1"] if low is None else ranges(int(low), int(high), parts, column)
    properties = {k: v for k, v in options(url, None, session, **more).items() if k != "url"}
    return spark.read.jdbc(url, f"({text}) q", predicates=where, properties=properties)


def read_in_sets(spark: SparkSession, url: str, query: str, key: str, schema: str, failures: list[tuple[str, str]], parameters: dict | None = None, *, keys: str | None = None, session: str | None = None, **more: str) -> DataFrame:
    """Rows of a query all at once; where that fails, of the two halves by ``key``, and so on, down to single keys.

    A key that fails by itself is noted in ``failures`` with the reason and left out, so one object that can't be read
    costs a few queries and not the others. Halves are found by the database: no list of keys is held here. ``keys`` is
    a query of the keys alone, for databases that can't list them without reading what fails. What was read is kept in
    shared storage. Rows with a null key are read with all others, and lost where halves are.
    """
    text, listed = bound(query, parameters), bound(keys or query, parameters)
    done = []

    def part(lo: str | None, hi: str | None) -> str:
        some = [f"{key} >= {literal(lo)}"] * (lo is not None) + [f"{key} < {literal(hi)}"] * (hi is not None)
        return f" WHERE {' AND '.join(some)}" if some else ""

    def attempt(lo: str | None, hi: str | None) -> None:
        try:
            done.append(cut(read(spark, url, f"SELECT * FROM ({text}) q{part(lo, hi)}", session=session, **more), "jdbc"))
            return
        except Exception as problem:  # noqa: BLE001  whatever the database fails with, the other objects are read
            reason = next((x for x in str(problem).splitlines() if x.strip()), type(problem).__name__)
        n, first = read(spark, url, f"SELECT COUNT(DISTINCT {key}) AS n, MIN({key}) AS low FROM ({listed}) q{part(lo, hi)}", session=session, **more).first()
        if n <= 1:
            failures.append((str(first), reason))
            return
        middle = read(spark, url, f"SELECT DISTINCT {key} AS k FROM ({listed}) q{part(lo, hi)} ORDER BY k OFFSET {n // 2} ROWS FETCH NEXT 1 ROWS ONLY", session=session, **more).first()[0]
        attempt(lo, middle)
        attempt(middle, hi)

    attempt(None, None)
    out = spark.createDataFrame([], StructType.fromDDL(schema))
    for rows in done:
        out = out.unionByName(rows.toDF(*out.columns).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in out.schema]))
    return out
