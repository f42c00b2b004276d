"""Joins of many rows with a table of names: pruned before the shuffle, frequent names dealt over tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.storage import cut, shuffled, small

#: Bits a name and bits at most of a filter. A filter of too many names holds nearly everything: it prunes less, but loses nothing.
BITS_A_NAME, MOST_BITS = 12, 1 << 26
HASHES = 4
#: Tasks over which the rows of one name are dealt.
SALTS = 16
#: Rows of a task of a shuffled join, of either side.
JOIN_ROWS = 200_000


def _places(keys: list[str], bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(bits)) for i in range(HASHES)]


def bloom(names: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """One row ``bloom``: a Bloom filter of the keys, as an array of ``bits / 64`` words. Each task merges its words first."""
    at = names.select(F.explode(F.array(*_places(keys, bits))).alias("at"))
    word, one = F.floor(F.col("at") / 64).cast("int"), F.expr("shiftleft(1L, CAST(at % 64 AS INT))")
    words = at.select(word.alias("word"), one.alias("one")).unionByName(names.sparkSession.range(bits // 64).selectExpr("CAST(id AS INT) AS word", "0L AS one"))
    words = words.groupBy("word").agg(F.bit_or("one").alias("set"))
    rows = words.agg(F.sort_array(F.collect_list(F.struct("word", "set"))).alias("x"))  # as many as the filter has words
    return rows.select(F.transform("x", lambda w: w["set"]).alias("bloom"))


def prune(rows: DataFrame, *scopes: tuple[DataFrame, list[str]]) -> DataFrame:
    """``rows`` without most of those that are a name in none of the scopes (names, keys), before anything is shuffled.

    None that is a name is lost. The names of one scope are broadcast where they are few, and then only names are left;
    otherwise a Bloom filter of each scope is, sized by its count. Null keys are no name.
    """
    scopes = [(names.select(*keys).distinct(), keys) for names, keys in scopes]
    if len(scopes) == 1 and small(scopes[0][0]):
        return rows.join(F.broadcast(scopes[0][0]), scopes[0][1], "left_semi")
    filters, held = None, []
    for i, (names, keys) in enumerate(scopes):
        names = cut(names, "names")
        bits = min(MOST_BITS, 64 * (names.count() * BITS_A_NAME // 64 + 1))
        full = cut(bloom(names, keys, bits), "bloom").withColumnRenamed("bloom", f"bloom{i}")
        filters = full if filters is None else filters.crossJoin(F.broadcast(full))  # one row each
        one = lambda at, i=i: F.get(f"bloom{i}", F.floor(at / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))) != 0
        held.append(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys] + [one(at) for at in _places(keys, bits)]))
    return rows.join(F.broadcast(filters), reduce(Column.__or__, held), "left_semi")


def tasks_for(rows: DataFrame, *names: DataFrame) -> int:
    """Tasks of a shuffled join with each of ``names``, which come in ``SALTS`` copies: as many as their rows need, so none grows with the input."""
    return max(rows.count(), *(n.count() * SALTS for n in names)) // JOIN_ROWS + 1


def with_name(rows: DataFrame, names: DataFrame, keys: list[str], by: str, tasks: int | None = None) -> DataFrame:
    """``rows`` left-joined with ``names``, which has each key once: by broadcast where they are few, else with every name
    in ``SALTS`` copies, over which a frequent one's rows are dealt by ``by``, and both over ``tasks`` (:func:`tasks_for`)."""
    if small(names):
        return rows.join(F.broadcast(names), keys, "left")
    tasks, at = tasks or tasks_for(rows, names), [*keys, "salt"]
    salted = names.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS))).repartition(tasks, *at)
    return dealt.join(shuffled(salted.repartition(tasks, *at)), at, "left").drop("salt")
