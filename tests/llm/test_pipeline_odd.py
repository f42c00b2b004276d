"""The pipeline's filtering stages on odd rows: nulls, empties, repeats, shared ids, clashing names, empty tables."""

import pytest

import corpus_pipeline
from provenir.llm.quality import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, line string, kept string, cid long"


def text(c, n=60):
    return " ".join(f"{c}{i}" for i in range(n))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Good documents have words, bad ones symbols; one test item."""
    where = str(tmp_path_factory.mktemp("odd"))
    labels = [(i, i % 2, 0) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, text("item", 30)), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def rows(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c", 7) for i, t in pairs], SCHEMA)


def test_quality_judges_rows_by_their_texts(spark, sf):
    good, bad = lambda i: text(f"g{i}"), lambda i: " ".join(f"b{i}#$%|{k}" for k in range(60))
    pairs = [(i, good(i) if i % 2 else bad(i)) for i in range(200)]
    pairs += [(500, good(500)), (500, bad(500)), (None, good(7)), (None, bad(8)), (None, bad(8)), (501, None), (502, "")]
    docs = rows(spark, pairs)
    out = corpus_pipeline.quality_classifier(spark, docs, sf)
    assert out.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(t for i, t in kept if i in (500, None)) == sorted([good(500), good(7)])
    assert [i for i, _ in kept if i is not None and i < 200] == [i for i in range(200) if i % 2]
    scored = {(r["doc_id"]): r["predicted"] for r in quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("doc_id in (501, 502)").collect()}
    assert {i for i, _ in kept if i in (501, 502)} == {i for i in scored if scored[i]}


def test_decontamination_of_odd_rows(spark, sf):
    leak = text("own", 20) + " " + text("item", 30)
    docs = rows(spark, [(1, leak), (1, text("x")), (None, leak), (None, text("y")), (2, None), (3, ""), (4, leak), (4, leak)])
    out = corpus_pipeline.decontamination(spark, docs, sf)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, text("x")), (None, text("y")), (2, None), (3, "")], key=str)


def test_line_dedup_of_odd_rows(spark, sf):
    pairs = [(i, f"own {i}\ncommon") for i in range(12)] + [(20, "common"), (20, "common\nleft"), (None, "common"), (21, None), (22, "")]
    docs = rows(spark, pairs).selectExpr("doc_id", "text", "lang", "cast(coalesce(doc_id, 50) as string) as source", "n_chars", "th", "line", "kept", "cid")
    out = corpus_pipeline.line_dedup_stage(spark, docs, sf)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(0, "own 0\ncommon"), *[(i, f"own {i}") for i in range(1, 12)], (20, "left"), (21, None), (22, "")], key=str)


def test_empty_tables(spark, sf):
    docs = rows(spark, [(1, "x")]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
