"""Licence scans: TF-IDF cosine of header lines and whole texts to templates, and inheritance from licence files of the nearest directory."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import cut, maybe_broadcast, text_key

# Short notices by which licences are named.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Proprietary", "All rights reserved."),
)
# Notices that stand at the head of a source file as a block; the short full texts serve as well.
HEADERS = (
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, see <https://www.gnu.org/licenses/>."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
CUE = "licen[sc]e|spdx|rights reserved|copyright"
#: What marks a whole text or a block: terms of which every template has one.
MARKED = f"{CUE}|warrant|hereby granted|public domain"
#: A line of a comment; a block is the run of such lines at a text's head, blank ones between them included.
COMMENT = r"^\s*(?:$|//|#|/?\*|--|;|%|<!--|\(\*)"
#: Terms that a block needs, fewer being lines; and how similar to a template it is.
BLOCK_TERMS, LEAST_BLOCK = 20, 0.7
#: Words up to which a full text may stand as a block.
SHORT_TEXT = 400
TERM = "[a-z0-9]+"
LEAST = 0.5
#: A document is a licence file if licence lines have this share of its terms.
FILE_SHARE = 0.5
#: Full texts by licence. A document is a licence file, too, if its whole text is this similar to one.
TEXTS = tuple((p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))
LEAST_WHOLE = 0.8
#: Names of files that hold a licence for their directory.
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying)(-[^/]*)?(\.(txt|md|rst))?$"
#: Says which rights are kept, in BSD texts as well: counts only where no other licence is named.
RESERVED = "Proprietary"


def _best(rows: DataFrame, key: str, total: float, templates: DataFrame, least: float) -> DataFrame:
    """(key, licence, score) of the most similar template of at least ``least``, for rows of ``key``, ``terms`` and how often they occur."""
    templates = templates.withColumn("terms", F.regexp_extract_all("line", F.lit(f"({TERM})"), F.lit(1)))
    counts = rows.select("n", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.sum("n").alias("df"))

    def vector(rows: DataFrame, key: str) -> DataFrame:
        tf = rows.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
        weighed = tf.join(counts, "term", "left")
        return weighed.select(key, "term", (F.col("tf") * (F.log((1 + F.lit(total)) / (1 + F.coalesce("df", F.lit(0.0)))) + 1)).alias("x"))

    # The templates' vectors have a fixed size
    theirs = F.broadcast(vector(templates, "template"))
    norms = F.broadcast(vector(templates, "template").groupBy("template").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("ny")))
    mine = vector(rows, key)
    norm = mine.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("nx"))
    dots = mine.join(theirs.withColumnRenamed("x", "y"), "term").groupBy(key, "template").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    near = dots.join(norms, "template").join(norm, key).join(F.broadcast(templates.select("template", "licence")), "template")
    near = near.select(key, "licence", F.round(F.col("dot") / (F.col("nx") * F.col("ny")), 6).alias("score")).filter(F.col("score") >= least)
    order = F.struct((F.col("licence") == RESERVED).alias("reserved"), (-F.col("score")).alias("s"), "licence")
    return near.groupBy(key).agg(F.min(order).alias("b")).select(key, F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def _blocks(files: DataFrame) -> DataFrame:
    """(doc_id, path, th, key, terms): the comment at the head of texts that begin with one and have a term of a template."""
    some = files.filter(F.col("text").rlike(r"^\s*(?://|#|/\*|--|;|%|<!--|\(\*)") & F.lower("text").rlike(MARKED)).select("doc_id", "path", "th", F.lower("text").alias("low"))
    lines = F.split("low", "\n")
    first = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT)), F.lit(False)).cast("int")
    run = F.array_join(F.when(first > 0, F.slice(lines, 1, first - 1)).otherwise(lines), "\n")
    close = F.instr("low", "*/")
    some = some.withColumn("block", F.when(F.col("low").rlike(r"^\s*/\*") & (close > 0), F.substring(F.col("low"), F.lit(1), close)).otherwise(run))
    some = some.withColumn("terms", F.regexp_extract_all("block", F.lit(f"({TERM})"), F.lit(1))).filter(F.size("terms") >= BLOCK_TERMS)
    return cut(some.select("doc_id", "path", "th", F.sha2("block", 256).alias("key"), "terms"), "blocks")


def license_scan(files: DataFrame, *, least: float = LEAST) -> DataFrame:
    """One row per file: ``doc_id, path, licence, score, origin`` for files with ``doc_id, path, text``.

    Lines with a licence cue are weighed by TF-IDF (counts over all such lines) and compared with each template; the
    best one of at least ``least`` names the file's licence (origin ``header``, or ``file`` where licence lines are half
    of its terms or more, or the file's name is that of a licence file), rights reserved only if no line names another.
    Whole texts that have a term of a template (``MARKED``) or the name of a licence file are weighed by counts over such
    texts and compared with full licence texts; the best one of at least ``LEAST_WHOLE`` goes before anything else
    (``file``). The block of comment lines at a text's head (``/*`` up to ``*/``, or lines with a mark) is compared with
    standard headers and short full texts in the same way; the best one of at least ``LEAST_BLOCK`` goes before single
    lines (``header``). A file without a licence takes that of the nearest
    directory above it that has a licence file, the most similar first, then by name (``inherited``); others get null
    and ``none``, scores being null then.
    Null texts have no lines; a null path has no directory; rows repeated in full get a row each; ties go to the
    licence that comes first by name. Other columns are ignored.
    """
    spark = files.sparkSession
    files = files.select(F.col("doc_id").cast("long").alias("doc_id"), "path", "text", text_key(F.col("text")).alias("th"))
    line = F.explode(F.filter(F.split(F.lower("text"), "\n"), lambda x: x.rlike(CUE)))
    marked = files.filter(F.lower("text").rlike(CUE)).select("doc_id", "path", "th", line.alias("line"))
    marked = marked.withColumn("terms", F.regexp_extract_all("line", F.lit(f"({TERM})"), F.lit(1))).filter(F.size("terms") > 0)
    marked = cut(marked.select("doc_id", "path", "th", "line", "terms"), "header-lines")
    kinds = marked.groupBy("line").agg(F.first("terms").alias("terms"), F.count("*").cast("double").alias("n"))
    templates = spark.createDataFrame([(str(i), n, t.lower()) for i, (n, t) in enumerate(TEMPLATES)], "template string, licence string, line string")
    best = _best(kinds, "line", float(marked.count()), templates, least)
    # Whole texts, each once however often it occurs
    cued = files.filter(F.lower("text").rlike(MARKED) | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))).select("doc_id", "path", "th", F.lower("text").alias("low")).withColumn("key", F.sha2("low", 256))
    cued = cued.withColumn("terms", F.regexp_extract_all("low", F.lit(f"({TERM})"), F.lit(1))).filter(F.size("terms") > 0)
    cued = cut(cued.select("doc_id", "path", "th", "key", "terms"), "cued-texts")
    texts = cued.groupBy("key").agg(F.first("terms").alias("terms"), F.count("*").cast("double").alias("n"))
    full = spark.createDataFrame([(str(i), n, t.lower()) for i, (n, t) in enumerate(TEXTS)], "template string, licence string, line string")
    whole = cut(_best(texts, "key", float(cued.count()), full, LEAST_WHOLE), "whole")
    blocks = _blocks(files)
    heads = spark.createDataFrame([(str(i), n, t.lower()) for i, (n, t) in enumerate([*HEADERS, *[(n, t) for n, t in TEXTS if len(t.split()) <= SHORT_TEXT]])], "template string, licence string, line string")
    headed = cut(_best(blocks.groupBy("key").agg(F.first("terms").alias("terms"), F.count("*").cast("double").alias("n")), "key", float(blocks.count()), heads, LEAST_BLOCK), "headed")
    headed = blocks.drop("terms").join(maybe_broadcast(headed), "key").select(F.col("doc_id").alias("d"), F.col("path").alias("p"), F.col("th").alias("h"), F.struct(F.lit(False).alias("reserved"), (-F.col("score")).alias("s"), "licence").alias("b"))
    whole = cued.drop("terms").join(maybe_broadcast(whole), "key").select(F.col("doc_id").alias("d"), F.col("path").alias("p"), F.col("th").alias("h"), F.struct(F.lit(False).alias("reserved"), (-F.col("score")).alias("s"), "licence").alias("b"))
    named = marked.join(maybe_broadcast(cut(best, "lines")), "line")
    own = named.groupBy(F.col("doc_id").alias("d"), F.col("path").alias("p"), F.col("th").alias("h")).agg(F.min(F.struct((F.col("licence") == RESERVED).alias("reserved"), (-F.col("score")).alias("s"), "licence")).alias("b"), F.sum(F.size("terms")).alias("n"))
    # What the whole text says goes first, then the block at its head
    ranked = own.withColumn("rank", F.lit(2))
    for rank, part in enumerate((whole, headed)):
        ranked = ranked.unionByName(part.withColumns({"n": F.lit(0).cast("long"), "rank": F.lit(rank)}))
    own = ranked.groupBy("d", "p", "h").agg(F.min(F.struct("rank", "b")).alias("m"), F.max("n").alias("n"))
    own = cut(own.select("d", "p", "h", F.col("m.b.licence").alias("licence"), (-F.col("m.b.s")).alias("score"), "n", (F.col("m.rank") == 0).alias("w")), "own")
    terms = F.size(F.regexp_extract_all(F.lower("text"), F.lit(f"({TERM})"), F.lit(1)))
    match = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("path").eqNullSafe(F.col("p")) & (F.col("th") == F.col("h"))
    rows = files.withColumn("has_cue", F.lower("text").rlike(CUE)).select("doc_id", "path", "th", F.when(F.col("has_cue"), terms).alias("terms"))
    rows = rows.join(maybe_broadcast(own), match, "left").drop("d", "p", "h")
    rows = rows.withColumn("origin", F.when(F.col("licence").isNull(), "none").when(F.col("w") | (F.col("n") >= FILE_SHARE * F.col("terms")) | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)), "file").otherwise("header"))
    rows = cut(rows.select("doc_id", "path", "licence", "score", "origin"), "named")
    # Nearest ancestor: every directory above a file, joined by path
    up = F.regexp_replace("path", "/?[^/]*$", "")
    homes = rows.filter("origin = 'file' and path is not null").groupBy(up.alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    homes = cut(homes.select("dir", F.col("b.licence").alias("dir_licence"), (-F.col("b.s")).alias("dir_score")), "homes")
    if homes.isEmpty():
        return rows
    steps = F.split("path", "/")
    above = rows.filter("origin = 'none'").select("path").distinct().select("path", F.explode(F.sequence(F.lit(0), F.size(steps) - 1)).alias("depth"), steps.alias("steps"))
    above = above.select("path", "depth", F.array_join(F.slice("steps", 1, F.col("depth")), "/").alias("dir"))
    found = above.join(maybe_broadcast(homes), "dir").groupBy(F.col("path").alias("p")).agg(F.max_by(F.struct("dir_licence", "dir_score"), "depth").alias("from"))
    out = rows.join(found, (F.col("path") == F.col("p")) & (F.col("origin") == "none"), "left")
    given = F.col("from").isNotNull()
    return out.select("doc_id", "path", F.when(given, F.col("from.dir_licence")).otherwise(F.col("licence")).alias("licence"), F.when(given, F.col("from.dir_score")).otherwise(F.col("score")).alias("score"), F.when(given, "inherited").otherwise(F.col("origin")).alias("origin"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files ``source/lang/doc_id``."""
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")


def oracle() -> str:
    values = ", ".join(f"({i}, '{n}', '{t.lower()}')" for i, (n, t) in enumerate(TEMPLATES))
    return rf"""
WITH f AS (SELECT row_number() OVER () AS r, doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, lower(text) AS t FROM documents),
l AS (SELECT r, doc_id, path, t, u.line, regexp_extract_all(u.line, '{TERM}') AS terms FROM (SELECT *, string_split(t, chr(10)) AS a FROM f) AS s, unnest(s.a) AS u(line) WHERE regexp_matches(u.line, '{CUE}')),
k AS (SELECT line, any_value(terms) AS terms, CAST(count(*) AS DOUBLE) AS n FROM l WHERE len(terms) > 0 GROUP BY line),
p AS (SELECT * FROM (VALUES {values}) AS v(template, licence, line)),
n AS (SELECT coalesce(sum(n), 0) AS total FROM k),
df AS (SELECT term, sum(n) AS df FROM (SELECT n, unnest(list_distinct(terms)) AS term FROM k) GROUP BY term),
vk AS (SELECT line, term, count(*) * (ln((1 + max(total)) / (1 + coalesce(max(df), 0))) + 1) AS x FROM (SELECT line, unnest(terms) AS term FROM k) LEFT JOIN df USING (term), n GROUP BY line, term),
vp AS (SELECT template, term, count(*) * (ln((1 + max(total)) / (1 + coalesce(max(df), 0))) + 1) AS x FROM (SELECT template, unnest(regexp_extract_all(line, '{TERM}')) AS term FROM p) LEFT JOIN df USING (term), n GROUP BY template, term),
c AS (SELECT d.line, p.licence, round(d.dot / (a.nx * b.ny), 6) AS score FROM (SELECT vk.line, template, sum(vk.x * vp.x) AS dot FROM vk JOIN vp USING (term) GROUP BY ALL) AS d
  JOIN (SELECT line, sqrt(sum(x * x)) AS nx FROM vk GROUP BY line) AS a ON a.line = d.line JOIN (SELECT template, sqrt(sum(x * x)) AS ny FROM vp GROUP BY template) AS b ON b.template = d.template JOIN p ON p.template = d.template),
b AS (SELECT line, min((-score, licence)) AS b FROM c WHERE score >= {LEAST} GROUP BY line),
o AS (SELECT r, min(b.b) AS b, sum(len(terms)) AS n FROM l JOIN b USING (line) GROUP BY r),
m AS (SELECT f.doc_id, f.path, o.b[2] AS licence, -o.b[1] AS score,
  CASE WHEN o.r IS NULL THEN 'none' WHEN o.n >= {FILE_SHARE} * len(regexp_extract_all(t, '{TERM}')) THEN 'file' ELSE 'header' END AS origin FROM f LEFT JOIN o USING (r)),
h AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, min((-score, licence)) AS b FROM m WHERE origin = 'file' GROUP BY 1),
i AS (SELECT m.path, max_by(h.b, length(h.dir)) AS b FROM (SELECT DISTINCT path FROM m WHERE origin = 'none') AS m JOIN h ON starts_with(m.path, h.dir || '/') GROUP BY m.path)
SELECT m.doc_id, m.path, CASE WHEN i.b IS NULL THEN m.licence ELSE i.b[2] END AS licence, CASE WHEN i.b IS NULL THEN m.score ELSE -i.b[1] END AS score, CASE WHEN i.b IS NULL THEN m.origin ELSE 'inherited' END AS origin
FROM m LEFT JOIN i ON m.path = i.path AND m.origin = 'none'"""
