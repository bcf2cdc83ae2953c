"""Records of CSV files with line breaks inside quotes, found by as many tasks as the lines are read by.

Whether a line begins inside quotes depends on all lines before it. What a line does to that state is one of
four functions (it stays, it flips, it is closed, it is open, whatever it was before), and functions are composed
in two levels: over the lines of a block of a file, and over the blocks, one small row each. Lines between two
states "outside" are records as they are; only the others are grouped, within their block, and what a block
begins with inside quotes goes to the last record begun in an earlier block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Where a row comes from: its file, the block of the file, and its place within the block.
PLACE = ("__file", "__block", "__place")
FILE, BLOCK, NUMBER = PLACE

#: Charsets whose lines can be told apart byte by byte.
CHARSETS = ("UTF-8", "ISO-8859-1")

# Repetitions are possessive: they take no stack, however long a line is.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_CELLS = rf'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+)?+,)*+'
_OPEN_OUTSIDE = rf'\A{_CELLS}"{_QUOTED}\z'
_OPEN_INSIDE = rf'\A{_QUOTED}(?:\z|"[^,]*+,{_CELLS}"{_QUOTED}\z)'


def splittable(spark: SparkSession, paths: list[str], charset: str) -> bool:
    """Whether lines end with a line feed (files of carriage returns alone are one line to Spark) in a known charset."""
    if charset not in CHARSETS:
        return False
    inner = F.regexp_replace("value", r"\r\z", "").contains("\r")
    first = spark.read.option("lineSep", "\n").text(paths).select(inner).head()
    return first is not None and not first[0]


def _composed(df: DataFrame, window, flips: Column, fixed: Column) -> DataFrame:
    """Adds `flips` and `fixed`: the state after a row is fixed, or else the one before the first row, flipped.

    `fixed` (0, 1 or null) is the state a row leaves whatever was before, `flips` (0 or 1) whether it turns it over.
    """
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({"__flip": flips, "__fix": fixed})
    df = df.withColumn("flips", (F.sum("__flip").over(upto) % 2).cast("int"))
    df = df.withColumn("fixed", F.last(F.col("__fix").bitwiseXOR(F.col("flips")), ignorenulls=True).over(upto))
    return df.drop("__flip", "__fix")


def _lines(spark: SparkSession, paths: list[str], charset: str) -> DataFrame:
    """(file, block, k, line, blank, returns, and what the lines of the block up to here and before it do)."""
    value = F.col("value")
    line = F.make_valid_utf8(value) if charset == "UTF-8" else F.decode(value.cast("binary"), charset)
    raw = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias("at"), line.alias("line"),
    )
    # A byte order mark is no part of the first cell.
    bare = F.when(F.col(BLOCK) == 0, F.regexp_replace("line", r"\A\x{FEFF}", "")).otherwise(F.col("line"))
    raw = raw.withColumns({
        "outside": bare.rlike(_OPEN_OUTSIDE).cast("int"), "inside": bare.rlike(_OPEN_INSIDE).cast("int"),
        "blank": F.col("line").isin("", "\r"), "returns": F.endswith("line", F.lit("\r")),
    })
    block = Window.partitionBy(FILE, BLOCK).orderBy("at")
    same = F.col("outside") == F.col("inside")
    lines = _composed(raw, block, ((F.col("outside") == 1) & ~same).cast("int"), F.when(same, F.col("outside")))
    lines = lines.withColumns({
        "k": F.row_number().over(block),
        "flips_before": F.lag("flips", 1, 0).over(block), "fixed_before": F.lag("fixed").over(block),
    })
    upto = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = lambda entry: (~F.col("blank") & (_state(F.lit(entry), "_before") == 0)).cast("long")
    return lines.withColumns({f"begun_{entry}": F.sum(begins(entry)).over(upto) for entry in (0, 1)})


def _state(entry: Column, which: str = "") -> Column:
    return F.coalesce(F.col(f"fixed{which}"), entry).bitwiseXOR(F.col(f"flips{which}"))


def _blocks(lines: DataFrame) -> DataFrame:
    """(file, block, entry, begun, owner, unclosed, crlf): one row per block.

    `entry` is the state it begins in, `begun` how many records begin in it, `owner` the last block before in which
    one does, `unclosed` whether the file ends inside quotes, `crlf` whether its first line ends with both signs.
    """
    sums = lines.groupBy(FILE, BLOCK).agg(
        F.max_by(F.struct("fixed", "flips"), "k").alias("end"),
        F.max("begun_0").alias("begun_0"), F.max("begun_1").alias("begun_1"),
        F.min_by("returns", "k").alias("returns"),
    )
    file = Window.partitionBy(FILE).orderBy(BLOCK)
    whole = file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fixed, flips = F.col("end.fixed"), F.col("end.flips")
    sums = _composed(sums, file, F.when(fixed.isNull(), flips).otherwise(0), fixed.bitwiseXOR(flips))
    sums = sums.withColumn("exit", _state(F.lit(0)))
    sums = sums.withColumns({
        "entry": F.lag("exit", 1, 0).over(file), "unclosed": F.last("exit").over(whole) == 1,
        "crlf": F.first("returns").over(whole),
    })
    sums = sums.withColumn("begun", F.when(F.col("entry") == 0, F.col("begun_0")).otherwise(F.col("begun_1")))
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("begun") > 0, F.col(BLOCK)), ignorenulls=True).over(before)
    return sums.withColumn("owner", owner).select(FILE, BLOCK, "entry", "begun", "owner", "unclosed", "crlf")


def _in_order(by: str, text: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, text))), lambda x: x[text]), "\n")


def records(spark: SparkSession, paths: list[str], charset: str) -> DataFrame:
    """(file, block, number, record) of every record but the files' first ones, the headers.

    The block is the one the record begins in, and records are numbered in it. Empty lines outside quotes are
    passed over. In files whose first line ends with carriage return and line feed, both together are
    a line feed, inside quotes too. A file which ends inside quotes fails: its last record would
    hold all lines behind a quote that was never meant to open.
    """
    lines = _lines(spark, paths, charset)
    lines = lines.join(_blocks(lines), [FILE, BLOCK])
    message = F.concat(F.lit("a quote is never closed in "), F.col(FILE))
    lines = lines.where(F.when(F.col("unclosed"), F.raise_error(message).cast("boolean")).otherwise(True))
    line = F.when(F.col("crlf"), F.regexp_replace("line", r"\r\z", "")).otherwise(F.col("line"))
    number = F.when(F.col("entry") == 0, F.col("begun_0")).otherwise(F.col("begun_1"))
    lines = lines.select(
        FILE, BLOCK, number.alias(NUMBER), "k", line.alias("line"), "blank", "begun", "owner",
        _state(F.col("entry"), "_before").alias("before"), _state(F.col("entry")).alias("after"),
    )
    alone = (F.col("before") == 0) & (F.col("after") == 0)
    keys = [FILE, BLOCK, NUMBER, "begun", "owner"]
    single = lines.where(alone & ~F.col("blank")).select(*keys, F.col("line").alias("record"))
    parts = lines.where(~alone).groupBy(*keys).agg(_in_order("k", "line").alias("part"))
    # What blocks begin with inside quotes, by the block which holds the beginning.
    tails = parts.where((F.col(NUMBER) == 0) & F.col("owner").isNotNull()).groupBy(FILE, F.col("owner").alias("of"))
    tails = tails.agg(_in_order(BLOCK, "part").alias("tail")).withColumnRenamed(FILE, "in_file")
    begun = parts.where(F.col(NUMBER) > 0)
    whole = begun.join(tails, (F.col(FILE) == F.col("in_file")) & (F.col(BLOCK) == F.col("of")), "left")
    goes_on = F.col("tail").isNotNull() & (F.col(NUMBER) == F.col("begun"))
    whole = whole.select(*keys, F.when(goes_on, F.concat_ws("\n", "part", "tail")).otherwise(F.col("part")).alias("record"))
    header = F.col("owner").isNull() & (F.col(NUMBER) == 1)
    return single.unionByName(whole).where(~header).select(*PLACE, "record")
