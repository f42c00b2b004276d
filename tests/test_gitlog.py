"""The git log, read by splits at arbitrary bytes and by segments of lines, against a plain scan."""

import random

import pytest
from pyspark.sql import functions as F

from provenir.operators import history
from provenir.operators.catalog import assemble
from provenir.sources.gitlog import git_log


def plain(text):
    out, now = [], None
    for line in text.split("\n"):
        line = line.removesuffix("\r")
        if line.startswith("@@COMMIT@@"):
            now = line[10:].split("@@", 2)
        elif now and line.strip():
            out.append((*now, line.strip()))
    return sorted(out)


def log(seed, crlf=False):
    rng = random.Random(seed)
    lines = ["warning: something", "", "db/early.sql"]
    for i in range(60):
        lines.append(f"@@COMMIT@@{i:08x}@@2024-01-{i % 28 + 1:02d}T00:00:00+01:00@@{rng.choice(['fix @@ sign', '@@COMMIT@@ inside', 'ä', ''])}")
        lines += [f"{rng.choice(['', '  '])}db/x{rng.randrange(9)}.sql{rng.choice(['', '\t', ' @@COMMIT@@'])}" for _ in range(rng.randrange(5))]
        lines += [""] * rng.randrange(2)
    return ("\r\n" if crlf else "\n").join(lines)


def rows(df):
    return sorted(tuple(r) for r in df.select("sha", "date", "message", "path").collect())


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("crlf", [False, True])
def test_any_split_gives_the_same_rows(spark, tmp_path, size, crlf):
    text = log(size, crlf)
    (tmp_path / "one.log").write_bytes(text.encode())
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", max(size, 16))
    try:
        got = git_log(spark, str(tmp_path / "one.log"))
        assert rows(got) == plain(text)
        if size < 100:
            assert got.rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_folder_of_logs_that_begin_with_a_header_and_an_empty_one(spark, tmp_path):
    texts = [log(i)[log(i).index("@@COMMIT@@") :] for i in range(3)]
    for i, t in enumerate([*texts, "", "no header\nat all"]):
        (tmp_path / f"{i}.log").write_bytes(t.encode())
    assert rows(git_log(spark, str(tmp_path))) == sorted(x for t in texts for x in plain(t))


@pytest.mark.parametrize("segment", [1, 2, 5, 10_000])
def test_segments_give_the_same_rows(spark, monkeypatch, segment):
    monkeypatch.setattr(history, "SEGMENT", segment)
    texts = [log(1), log(2), "", "only\nnoise"]
    lines = spark.createDataFrame([(k, n, x) for k, t in enumerate(texts) for n, x in enumerate(t.split("\n"))], "log long, line_no long, value string")
    got = history.parse_git_log(lines.orderBy(F.rand(1)))
    assert rows(got) == sorted(x for t in texts for x in plain(t))


def test_catalog_takes_the_log_as_rows(spark, tmp_path):
    (tmp_path / "a.log").write_text("@@COMMIT@@s2@@2024-02-01@@two\np/sv/db/Tables/dbo/a.sql\n\n@@COMMIT@@s1@@2024-01-01@@one\np/sv/db/Tables/dbo/a.sql\np/sv/db/Tables/dbo/b.sql\n")
    files = spark.createDataFrame([("sv/db/Tables/dbo/a.sql", "CREATE TABLE a"), ("sv/db/Tables/dbo/b.sql", "x")], "path string, text string")
    nodes = assemble(files, log=git_log(spark, str(tmp_path)), prefix="p/").nodes
    assert sorted((r.name, r.changeCount, r.lastChangedAt) for r in nodes.collect()) == [("a", 2, "2024-02-01"), ("b", 1, "2024-01-01")]
