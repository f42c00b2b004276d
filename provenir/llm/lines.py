"""Cross-site boilerplate lines by their spread over distinct sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import cut, maybe_broadcast

#: Estimates this far (relative) from the threshold are trusted; nearer ones are counted exactly. Six standard errors at LG_K.
NEAR = 0.1
LG_K = 12


def line_dedup(docs: DataFrame, *, min_sites: int = 10) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, and ``n_lines``, ``n_removed`` (long) after its own columns.

    A line (blanks trimmed; blank lines never count) is boilerplate if it stands in documents of ``min_sites`` distinct
    ``source`` values. HyperLogLog sketches merge by aggregation; lines whose estimate is near the threshold get exact
    distinct counts. The first occurrence, by doc_id (null last), digest of the text and place, stays, so no content leaves the corpus altogether.
    A null text stays null with 0 lines; a null source is no site; rows repeated in full are treated alike; columns
    beside doc_id, text and source pass through, but for ones named like the two new columns, which these replace.
    """
    # 60 bits of a digest, so that SQL can order the texts of one doc_id alike
    th = F.conv(F.left(F.md5("text"), F.lit(15)), 16, 10).cast("long")
    # Projected before the lines are made: beside the generator the digest of a whole text would be taken once a line
    texts = docs.select("doc_id", th.alias("th"), "source", "text")
    lines = texts.select("doc_id", "th", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(" \t\r"))).filter("line <> ''").select("doc_id", "th", "source", "pos", F.unhex(F.md5("line")).alias("line_key"))
    spread = lines.groupBy("line_key").agg(F.hll_sketch_agg("source", LG_K).alias("sketch"), F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "th", "pos")).alias("first"))
    spread = spread.select("line_key", "first", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= (1 - NEAR) * min_sites)
    spread = cut(spread, "spread")
    near = spread.filter(F.col("sites") <= (1 + NEAR) * min_sites)
    exact = lines.join(maybe_broadcast(near.select("line_key")), "line_key", "left_semi").select("line_key", "source").distinct().groupBy("line_key").agg(F.count("source").alias("exact"))
    known = spread.join(exact, "line_key", "left").filter(F.coalesce("exact", "sites") >= min_sites)
    common = cut(known.select("line_key", F.col("first.doc_id").alias("first_doc"), F.col("first.th").alias("first_th"), F.col("first.pos").alias("first_pos")), "boilerplate")
    gone = lines.join(maybe_broadcast(common), "line_key").filter(~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("th") == F.col("first_th")) & (F.col("pos") == F.col("first_pos"))))
    gone = gone.groupBy(F.col("doc_id").alias("__gone_doc"), F.col("th").alias("__gone_th")).agg(F.collect_set("pos").alias("__gone_pos"))
    out = docs.drop("n_lines", "n_removed").withColumn("__row_th", th)
    out = out.join(gone, F.col("doc_id").eqNullSafe(F.col("__gone_doc")) & (F.col("__row_th") == F.col("__gone_th")), "left")
    size = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    # Both uses of __cut_lines keep it a column of its own, so that a text is split once
    out = out.withColumn("__cut_lines", F.when(F.col("__gone_pos").isNotNull(), F.split("text", "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("__cut_lines") - 1), "__gone_pos")
    rest = F.when(F.col("__gone_pos").isNotNull(), F.array_join(F.transform(left, lambda i: F.get("__cut_lines", i)), "\n"))
    out = out.withColumns({"n_lines": F.when(F.col("text").isNull(), 0).otherwise(size).cast("long"), "n_removed": F.when(F.col("__gone_pos").isNull(), 0).otherwise(F.size("__gone_pos")).cast("long"), "__cut_text": rest})
    return out.withColumn("text", F.coalesce("__cut_text", "text")).drop("__row_th", "__gone_doc", "__gone_th", "__gone_pos", "__cut_lines", "__cut_text")


def oracle(min_sites: int) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),
l AS (SELECT r, doc_id, th, source, line, pos FROM (SELECT r, doc_id, CAST('0x' || left(md5(text), 15) AS BIGINT) AS th, source, string_split(text, chr(10)) AS a FROM d), unnest(a) WITH ORDINALITY AS u(line, pos)),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
b AS (SELECT k, min((doc_id, th, pos)) AS f FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {min_sites}),
m AS (SELECT k.*, b.k IS NOT NULL AND (doc_id, th, pos) <> b.f AS gone FROM k LEFT JOIN b ON k.k = b.k),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS t FROM m GROUP BY r)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CASE WHEN text IS NULL THEN NULL ELSE sha256(coalesce(t, '')) END AS kept_sha256
FROM d LEFT JOIN g USING (r)"""
