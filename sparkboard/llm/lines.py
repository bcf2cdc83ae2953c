"""Line dedup: a suffix array over the sequences of line ids, by distributed prefix doubling.

Each document is a sequence of lines with a word; equal lines have equal ids. The suffixes of all
sequences are ordered by their first line, then by the first 2, 4, 8, ... lines: suffix i is sorted by
(its rank, the rank of suffix i + length). Suffixes of one rank agree in that many lines: they are an
interval of the suffix array whose longest common prefix is at least that long. A suffix alone in its
interval repeats nothing and leaves the array, so each round sorts only what still repeats, and the rounds
end when nothing does. In every interval the first copy in document order stays; the run of lines of every
other copy goes. The runs of a power of two lines cover each maximal repeated run exactly: one from its
first line on, one up to its last.

Only DataFrame functions are used. No window holds a whole interval: ranks are running sums over
distinct keys, in two levels of bounded width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkboard.llm.shared import column, dropped, saved

#: Ranges of ranks have so many bits, ranges of line digests are told by so many leading bits.
RANK_BITS, DIGEST_BITS = 18, 12
LOWEST = -(1 << 63)


def _bare(line: Column) -> Column:
    """A line without white space at its ends; empty if it has no word."""
    return F.trim(F.translate(line, "\t\r\x0b\x0c", "    "))


def _keys(id_col: str, text_col: str) -> list[Column]:
    """A document's place in the order: its id, then a digest of its text. Rows equal in both are one document."""
    return [
        F.coalesce(column(id_col).cast("long"), F.lit(LOWEST)).alias("d"),
        F.xxhash64(column(text_col).cast("string")).alias("h"),
    ]


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, h, i, a, b, chars): the i-th line with a word of each document, its 128-bit digest and its length."""
    lines = F.filter(F.transform(F.split(column(text_col).cast("string"), "\n", -1), _bare), lambda t: t != "")
    rows = docs.select(*_keys(id_col, text_col), F.posexplode(lines).alias("i", "t"))
    return rows.select("d", "h", "i", F.xxhash64("t").alias("a"), F.xxhash64(F.lit(1), "t").alias("b"), F.length("t").alias("chars"))


def _ranked(classes: DataFrame, group: list[str], keys: list[str], coarse: Column) -> DataFrame:
    """Adds `rank`: base + the number of suffixes in the group with a smaller key.

    `classes` has one row per (group, key) with its `size`. Sums run over `coarse` ranges of keys first
    and within each range next, so that no window holds all keys of a hot group.
    """
    classes = classes.withColumn("_range", coarse)
    ranges = classes.groupBy(*group, "_range").agg(F.sum("size").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*group, "_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*group, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    classes = classes.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rank = (F.col("base") + F.col("_before") + F.col("_inside")).alias("rank")
    return classes.join(ranges, [*group, "_range"]).select(*group, *keys, "first", rank)


def suffixes(docs: DataFrame, id_col: str, text_col: str) -> list[tuple[int, DataFrame]]:
    """For each length 1, 2, 4, ...: (d, h, i, rank, first, chars) of the suffixes whose beginning of that
    many lines occurs more than once. Suffixes of equal rank are one interval of the suffix array; `first`
    is the place (d, h, i) of its first copy, `chars` the length of the first line.
    """
    table = saved(line_table(docs, id_col, text_col), "lines")
    place = F.struct("d", "h", "i")
    classes = table.groupBy("a", "b").agg(F.count(F.lit(1)).alias("size"), F.min(place).alias("first")).where("size > 1")
    classes = classes.withColumns({"base": F.lit(0).cast("long"), "_all": F.lit(0)})
    classes = _ranked(classes, ["_all"], ["a", "b"], F.shiftright("a", 64 - DIGEST_BITS)).drop("_all")
    now = table.join(classes, ["a", "b"]).select("d", "h", "i", "rank", "first", "chars")
    # Repeated rows of one document are one: its places appear once.
    now, length = saved(now.dropDuplicates(["d", "h", "i"]), "suffixes"), 1
    dropped(table)
    levels = []
    while not now.isEmpty():
        levels.append((length, now))
        ahead = now.select("d", "h", (F.col("i") - length).alias("i"), F.col("rank").alias("next"))
        pairs = now.join(ahead, ["d", "h", "i"]).select("d", "h", "i", "chars", "rank", "next")
        classes = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("size"), F.min(place).alias("first")).where("size > 1")
        classes = classes.withColumnsRenamed({"rank": "base"})
        classes = _ranked(classes, ["base"], ["next"], F.shiftright("next", RANK_BITS)).withColumnRenamed("rank", "to")
        pairs = pairs.join(classes.withColumnRenamed("base", "rank"), ["rank", "next"])
        now, length = saved(pairs.select("d", "h", "i", F.col("to").alias("rank"), "first", "chars"), "suffixes"), 2 * length
    dropped(now)
    return levels


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_lines: int = 2) -> DataFrame:
    """(d, h, runs): per document the runs (first, last) of its lines which are later copies, merged and in order.

    A repeated run counts if it has at least `min_lines` lines (a power of two) or is a line of at least
    `min_chars` characters. Lines without a word are not numbered.
    """
    levels = suffixes(docs, id_col, text_col)
    later = F.struct("d", "h", "i") > F.col("first")
    found = None
    for length, level in levels:
        counts = later if length >= min_lines else later & (F.col("chars") >= min_chars)
        part = level.where(counts).select("d", "h", "i", (F.col("i") + length - 1).cast("int").alias("end"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "d long, h long, i int, end int")
    found = found.groupBy("d", "h", "i").agg(F.max("end").alias("end"))
    # Runs which touch or overlap are one; a document's lines are one row of the input, so a window of them is bounded.
    lines = Window.partitionBy("d", "h").orderBy("i")
    so_far = lines.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("new", F.coalesce(F.col("i") > F.max("end").over(so_far) + 1, F.lit(True)).cast("int"))
    found = found.withColumn("run", F.sum("new").over(lines)).groupBy("d", "h", "run").agg(F.min("i").alias("first"), F.max("end").alias("last"))
    runs = saved(found.groupBy("d", "h").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs")), "line-runs")
    dropped(*(level for _, level in levels))
    return runs


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_lines: int = 2, counts: str | None = None) -> DataFrame:
    """The documents, later copies of repeated line runs deleted from their texts; other columns as they were.

    Documents are ordered by id, then by a digest of their text. Rows equal in id and text are one
    document and are changed alike; null ids come first, among themselves by digest. Null and empty texts stay.
    With `counts`, a column of that name holds (n_lines, n_removed): lines with a word, and those deleted.
    """
    runs = repeated_runs(docs, id_col, text_col, min_chars, min_lines).select(F.col("d").alias("__d"), F.col("h").alias("__h"), F.col("runs").alias("__runs"))
    d, h = _keys(id_col, text_col)
    joined = docs.withColumns({"__d": d, "__h": h}).join(runs, ["__d", "__h"], "left")
    lines = F.split(column(text_col).cast("string"), "\n", -1)
    joined = joined.withColumn("__lines", lines)
    # The numbers, among all lines, of those with a word.
    spoken = F.filter(F.transform("__lines", lambda t, n: F.when(_bare(t) != "", n)), lambda n: n.isNotNull())
    joined = joined.withColumn("__spoken", spoken)
    cuts = F.transform("__runs", lambda r: F.struct(F.get("__spoken", r["first"]).alias("from"), F.get("__spoken", r["last"]).alias("to")))
    joined = joined.withColumn("__cuts", F.when(F.col("__runs").isNotNull(), cuts))
    end_before = lambda k: F.when(k == 0, 0).otherwise(F.get("__cuts", k - 1)["to"] + 1)
    pieces = F.transform("__cuts", lambda c, k: F.slice("__lines", end_before(k) + 1, c["from"] - end_before(k)))
    tail = F.element_at("__cuts", -1)["to"] + 1
    rest = F.slice("__lines", tail + 1, F.greatest(F.size("__lines") - tail, F.lit(0)))
    kept = F.array_join(F.flatten(F.concat(pieces, F.array(rest))), "\n")
    result = [F.when(F.col("__runs").isNull(), column(c)).otherwise(kept).alias(c) if c == text_col else column(c) for c in docs.columns]
    if counts:
        removed = F.aggregate("__runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
        n_lines = F.coalesce(F.when(column(text_col).isNotNull(), F.size("__spoken")), F.lit(0))
        result.append(F.struct(n_lines.cast("long").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed")).alias(counts))
    return joined.select(*result)
