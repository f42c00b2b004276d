"""Near copies in packing."""

import collections

from provenir.llm.queries import op9_best_fit_packing


def test_near_copies_share_no_bin(spark, tmp_path):
    word = [f"w{i}" for i in range(100)]
    copies = [" ".join(word[:50] + [f"x{k}"] + word[51:]) for k in range(4)]
    others = [" ".join(f"{c}{i}" for i in range(100)) for c in "abcd"]
    rows = [(i, t, "en", None, len(t)) for i, t in enumerate(copies + others)]
    rows += [(None, copies[0], "en", None, 1), (8, "É b c", "en", None, 1), (9, "é b c", "en", None, 1), (10, "", "en", None, 0), (11, None, "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = op9_best_fit_packing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    bins = collections.defaultdict(set)
    for r in got:
        bins[r["bin_id"]].add(r["doc_id"])
    assert max(len(b & {0, 1, 2, 3}) for b in bins.values()) == 1
    assert not any({8, 9} <= b or {None, 0} <= b or {10, 11} <= b for b in bins.values())
    assert len(bins) == 4
