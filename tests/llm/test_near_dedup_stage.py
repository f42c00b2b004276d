"""The pipeline's near-dedup where rows share a doc_id."""

from pyspark.sql import functions as F

from corpus_pipeline import near_dedup


def text(c, edit=""):
    return " ".join(f"{c}{i}" for i in range(100)) + edit


def test_rows_of_one_id_are_judged_apart(spark):
    rows = [
        (5, text("a")), (5, text("b")), (5, text("b")),  # one id, two texts, one of them twice
        (6, text("a", " x")), (7, text("b", " y")), (8, text("c")),
        (4, text("c", " z")), (4, text("d")), (9, text("c", " v")),
        (10, None), (10, ""), (None, text("a")), (None, text("a")),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    want = [(5, text("a")), (5, text("b")), (4, text("c", " z")), (4, text("d")), (10, None), (10, ""), (None, text("a")), (None, text("a"))]
    assert got == sorted(want, key=str)


def test_copies_that_differ_in_other_columns_leave_the_least(spark):
    for others in ([], [(3, text("e"), "x", "s"), (3, text("f"), "x", "s")]):  # with and without an id of two texts
        rows = [(1, text("a"), "en", "s2"), (1, text("a"), "en", "s1"), (1, text("a"), None, "s3"), (2, text("b"), "en", "s"), (2, text("b"), "en", "s"), *others]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("again", F.lit(1)).repartition(5)
        got = sorted((r.doc_id, r.lang, r.source) for r in near_dedup(spark, docs, "").collect() if r.doc_id < 3)
        assert got == [(1, "en", "s1"), (2, "en", "s")]
