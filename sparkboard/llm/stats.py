"""Statistics of whole texts as column expressions: nothing is exploded, shuffled or sent to Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkboard.llm.shared import SPACE, WORD, column

#: Counts per text.
COUNTS = (
    "n_chars n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_distinct n_upper n_bars n_bangs n_digits n_stops"
).split()
WINDOW = 8


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, COUNTS as longs) per row; a null text counts as empty. Other columns are not read.

    n_repeat_words: words in windows of `window` words (a power of two) which occur twice or more in the
    text. A window's hash is made from those of its halves, so that each word is hashed once.
    """
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    rows = docs.select(column(id_col).alias("id"), text.alias("t"))
    rows = rows.select("*", F.regexp_extract_all("t", F.lit(f"({WORD})")).alias("w"), F.split("t", "\n", -1).alias("l"))
    spoken = F.filter("l", lambda x: x.rlike(f"[^{SPACE}]"))
    rows = rows.withColumn("l", spoken).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    step = 1
    while step < window:
        rows = rows.withColumn("h", F.transform("h", lambda x, i: F.xxhash64(x, F.get("h", i + step))))
        step *= 2
    rows = rows.withColumn("h", F.slice("h", 1, F.greatest(F.size("w") - (window - 1), F.lit(0))))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern))
    found = rows.select(
        "id",
        F.length("t").alias("n_chars"),
        F.size("w").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        F.size("l").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) == F.size("h"), 0).otherwise(_covered(F.col("h"), window)).alias("n_repeat_words"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"\|").alias("n_bars"),
        count("!").alias("n_bangs"),
        count("[0-9]").alias("n_digits"),
        count("[.]").alias("n_stops"),
    )
    return found.select("id", *[F.col(c).cast("long").alias(c) for c in COUNTS])


def _covered(hashes: Column, window: int) -> Column:
    """How many places lie in windows whose hash occurs more than once: by sorting, not by comparing all."""
    places = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
        marked = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    # Starts in order: each covers up to the next start, at most a window.
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    starts = once(places, repeated)
    gaps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
    return F.aggregate(once(starts, gaps), F.lit(0), lambda n, x: n + x)


def _over(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def features() -> dict[str, Column]:
    """What classifiers learn from, on a table of `statistics`: ratios which do not grow with the text."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _over("word_chars", "n_words"),
        "symbols": _over("n_symbols", "n_words"),
        "bars": _over("n_bars", "n_words"),
        "bangs": _over("n_bangs", "n_words"),
        "upper": _over("n_upper", "word_chars"),
        "digits": _over("n_digits", "word_chars"),
        "stops": _over("n_stops", "n_words"),
        # Of a text's logarithm of words: nearly the same for short and long texts of one kind.
        "distinct": F.when(F.col("n_words") > 1, F.log(F.col("n_distinct").cast("double")) / F.log(F.col("n_words").cast("double"))).otherwise(1.0),
        "dup_lines": _over("n_dup_lines", "n_lines"),
        "repeat_words": _over("n_repeat_words", "n_words"),
        "line_words": _over("n_words", "n_lines"),
    }
