"""Substring search for many needles at once: an index of three-letter grams, rarest first, then verification."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.operators.browse import FREE_TEXT
from provenir.storage import cut, maybe_broadcast

GRAM = 3


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _grams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= GRAM, F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))


def gram_index(nodes: DataFrame, fields: Sequence[str] = FREE_TEXT) -> DataFrame:
    """(gram, id): each gram of three letters of a node's fields once, in small letters; written to shared storage for many searches."""
    every = F.array_distinct(F.flatten(F.array(*[_grams(_low(f)) for f in fields])))
    return cut(nodes.select("id", F.explode(every).alias("gram")), "grams")


def search(nodes: DataFrame, needles: DataFrame, index: DataFrame | None = None, *, fields: Sequence[str] = FREE_TEXT) -> DataFrame:
    """(needle, id): the nodes that hold a needle in one of the fields, without case; each needle of ``needles`` (needle) counts once.

    A needle is looked up by its rarest gram alone, and what is found is verified in the fields. Needles of fewer than
    three letters have no gram and are compared with all nodes; an empty one is in all of them, a null one in none. A
    missing field counts as an empty one. Ids are unique.
    """
    index = gram_index(nodes, fields) if index is None else index
    texts = nodes.select("id", *[_low(f).alias(f"f{i}") for i, f in enumerate(fields)])
    holds = reduce(Column.__or__, (F.contains(F.col(f"f{i}"), F.col("low")) for i in range(len(fields))))
    asked = needles.filter("needle is not null").select("needle", F.lower("needle").alias("low")).distinct()
    grams = asked.filter(F.length("low") >= GRAM).select("needle", "low", F.explode(F.array_distinct(_grams(F.col("low")))).alias("gram"))
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    known = grams.join(counts, "gram", "left").groupBy("needle", "low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    rarest = cut(known.filter("rarest.n > 0").select("needle", "low", F.col("rarest.gram").alias("gram")), "needles")
    long = index.join(maybe_broadcast(rarest), "gram").select("needle", "low", "id").join(texts, "id").filter(holds).select("needle", "id")
    short = texts.join(F.broadcast(asked.filter(F.length("low") < GRAM)), holds).select("needle", "id")  # strings of two letters are few
    return long.unionByName(short)
