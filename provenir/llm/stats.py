"""Statistics of whole texts as native Spark expressions; words are runs of anything but ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Base statistics, then others; all long.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_marks", "n_digits", "n_distinct")
WINDOW = 5


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def text_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row and the counts of :data:`COUNTS`; a null text counts as an empty one.

    ``n_repeat_words`` counts the words in windows of five words that occur twice or more in the text. Windows are
    compared by 64-bit hashes of their words, sorted inside the row, so nothing is shuffled.
    """
    text = F.coalesce(F.col("stat_text"), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
    df = docs.select(*keep, F.col("text").cast("string").alias("stat_text"))
    df = df.select(*keep, text.alias("t"))
    df = df.select(*keep, "t", F.btrim("t", F.lit(BLANKS)).alias("s"))
    df = df.select(*keep, "t", F.when(F.col("s") == "", F.array().cast("array<string>")).otherwise(F.split("s", r"[\x20\x09-\x0D]+")).alias("w"), F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"))
    df = df.select(
        *keep,
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        F.length(F.translate("t", BLANKS, "")).alias("word_chars"),
        _count(F.col("t"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.length("t").alias("n_chars"),
        F.size("lines").alias("n_lines"),
        _count(F.col("t"), upper).alias("n_upper"),
        _count(F.col("t"), ".,;:!?").alias("n_marks"),
        _count(F.col("t"), "0123456789").alias("n_digits"),
    )
    rest = ("word_chars", "n_symbols", "n_dup_lines", "n_chars", "n_lines", "n_upper", "n_marks", "n_digits")
    h = F.col("h")
    hashes = F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*keep, *rest, F.size("h").alias("n_words"), F.size(F.array_distinct("h")).alias("n_distinct"), hashes.alias("g"))
    df = df.select(*keep, *rest, "n_words", "n_distinct", "g", F.when(F.size("g") > F.size(F.array_distinct("g")), F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("o"))
    o = F.col("o")
    twice = F.transform(F.filter(o, lambda e, i: F.coalesce(F.get(o, i - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(o, i + 1)["x"] == e["x"], F.lit(False))), lambda e: e["i"])
    df = df.select(*keep, *rest, "n_words", "n_distinct", F.sort_array(twice).alias("p"))
    p = F.col("p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
    df = df.select(*keep, *rest, "n_words", "n_distinct", F.coalesce(covered, F.lit(0)).alias("n_repeat_words"))
    return df.select(*keep, *[F.col(c).cast("long").alias(c) for c in COUNTS])


#: Ratios that learners use, as (name, expression over the counts).
def ratios() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return {
        "size": F.log1p(F.col("n_words").cast("double")),
        "word_length": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "repeat_ratio": F.col("n_repeat_words") / words,
        "upper_ratio": F.col("n_upper") / chars,
        "mark_ratio": F.col("n_marks") / words,
        "digit_ratio": F.col("n_digits") / chars,
        "distinct_ratio": F.col("n_distinct") / words,
        "line_length": F.log1p(words / lines),
    }
