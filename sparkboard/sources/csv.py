"""CSV files to a table of text columns with clean names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from sparkboard.functions.naming import snake_case_columns
from sparkboard.functions.values import missing_to_null, quoted
from sparkboard.sources.records import PLACE, records, splittable
from sparkboard.sources.scratch import materialize

ROW_NUMBER = "row_number"
_RECORD = "__record"


def read_csv(
    spark: SparkSession,
    path: str,
    encoding: str = "auto",
    multiline: bool | str = "auto",
    row_number: bool = False,
) -> DataFrame:
    """Read comma-separated files with a header row; every column is text, missing values null.

    With "auto", one pass over the raw lines finds the files which are not UTF-8 (they are read as
    Latin-1) and those with line breaks inside quotes, whose lines are joined to records first. Both kinds
    are split into many tasks; only files of other charsets, or of lines that end with carriage returns alone,
    are not if their quotes hold line breaks. Naming both arguments skips that pass for a single file. A file
    which ends inside quotes fails. Several files may have their columns in different orders, but must
    have the same ones. With row numbers, the files are parsed
    once into a table, and a column of the file which would be called like the number gets another name.
    """
    if row_number:
        return read_csv_once(spark, path, encoding, multiline)
    return _read(spark, path, encoding, multiline, in_order=True).drop(*PLACE)


def read_csv_once(
    spark: SparkSession, path: str, encoding: str = "auto", multiline: bool | str = "auto"
) -> DataFrame:
    """As `read_csv` with row numbers, for a table which is looked at several times.

    The files are parsed once, into a columnar table in the shared folder.
    """
    rows = _read(spark, path, encoding, multiline, reserved=(ROW_NUMBER,))
    return number_rows(materialize(rows, "csv-text"))


def _read(
    spark: SparkSession, path: str, encoding: str, multiline: bool | str, reserved: tuple[str, ...] = (),
    in_order: bool = False,
) -> DataFrame:
    parts, names = [], None
    for charset, broken, paths in _reading_groups(spark, path, encoding, multiline):
        raw = _reader(spark, charset, broken).csv(paths).head(1)
        if not raw:
            raise ValueError(f"no header row in {path}")
        own = _kept_free(snake_case_columns(spark, list(raw[0])), reserved)
        if names is not None and set(own) != set(names):
            raise ValueError(f"files with different columns in {path}: {sorted(set(own) ^ set(names))}")
        names = names or own
        parts.append(_read_group(spark, own, charset, broken, paths, in_order))
    return reduce(DataFrame.unionByName, parts)


def _kept_free(names: list[str], reserved: tuple[str, ...]) -> list[str]:
    """The names, those in `reserved` with the first free number behind them."""
    taken, result = {*names, *reserved}, []
    for name in names:
        if name in reserved:
            name = next(f"{name}_{k}" for k in range(1, len(taken) + 2) if f"{name}_{k}" not in taken)
            taken.add(name)
        result.append(name)
    return result


def _reading_groups(
    spark: SparkSession, path: str, encoding: str, multiline: bool | str
) -> list[tuple[str, bool, list[str]]]:
    """Files which are read alike: (charset, line breaks in quotes, paths). They have one header line."""
    lines = spark.read.text(path)
    if encoding != "auto" and multiline != "auto" and len(lines.inputFiles()) == 1:
        return [(encoding, bool(multiline), [path])]
    # The first line of a file: the first row of its first block.
    place = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    flags = (
        lines.select("value", F.col("_metadata.file_path").alias("file"), place.alias("place")).groupBy("file")
        .agg(
            F.bool_or(~F.is_valid_utf8(F.col("value"))).alias("not_utf8"),
            F.bool_or(_odd_quotes(F.col("value"))).alias("open_quote"),
            F.min_by(F.hex("value"), "place").alias("header"),
        )
        .collect()
    )
    if not flags:
        raise ValueError(f"no lines in {path}")
    groups: dict[tuple[str, bool, str], list[str]] = {}
    for row in flags:
        charset = ("ISO-8859-1" if row["not_utf8"] else "UTF-8") if encoding == "auto" else encoding
        broken = row["open_quote"] if multiline == "auto" else bool(multiline)
        groups.setdefault((charset, broken, row["header"]), []).append(row["file"])
    if len(groups) == 1:
        ((charset, broken, _),) = groups
        return [(charset, broken, [path])]
    return [(charset, broken, sorted(files)) for (charset, broken, _), files in sorted(groups.items())]


def _odd_quotes(line: Column) -> Column:
    # A record on one line holds an even number of quotes, because a quote inside quotes is doubled.
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1


def _reader(spark: SparkSession, charset: str, multiline: bool):
    return spark.read.options(
        encoding=charset, multiLine=multiline, quote='"', escape='"', mode="PERMISSIVE"
    )


def _read_group(
    spark: SparkSession, names: list[str], charset: str, multiline: bool, paths: list[str], in_order: bool
) -> DataFrame:
    """The files' rows with their places, on demand sorted by them if joining lines has lost their order."""
    if multiline and splittable(spark, paths, charset):
        fields = ", ".join(f"c{k} STRING" for k in range(len(names)))
        options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RECORD}
        cells = F.from_csv("record", f"{fields}, {_RECORD} STRING", options).alias("cells")
        found = records(spark, paths, charset)
        rows = (found.orderBy(*PLACE) if in_order else found).select(*PLACE, cells)
        given = [F.col(f"cells.c{k}").alias(n) for k, n in enumerate(names)]
        rows = rows.select(*given, F.col(f"cells.{_RECORD}").alias(_RECORD), *PLACE)
        return _checked(rows, names).select(*map(_cell, names), *PLACE)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _RECORD]])
    rows = (
        _reader(spark, charset, multiline)
        .options(header=True, columnNameOfCorruptRecord=_RECORD)
        .schema(schema)
        .csv(paths)
    )
    return place_rows(_checked(rows, names).select(*map(_cell, names), *_file_and_block()))


def _cell(name: str) -> Column:
    return missing_to_null(quoted(name)).alias(name)


def _checked(rows: DataFrame, names: list[str]) -> DataFrame:
    """Short rows are filled with nulls. A row with more cells than the header is an error: reading it
    would lose the cells at its end."""
    outside_quotes = F.regexp_replace(quoted(_RECORD), r'"[^"]*+(?:""[^"]*+)*+"', "")
    cells = F.length(outside_quotes) - F.length(F.replace(outside_quotes, F.lit(","), F.lit(""))) + 1
    too_long = quoted(_RECORD).isNotNull() & (cells > len(names))
    # The message names the first cell: Spark does not read the raw record without a column.
    first = F.coalesce(quoted(names[0]), F.lit(""))
    message = F.concat(F.lit(f"more than {len(names)} cells, row '"), first, F.lit("': "), quoted(_RECORD))
    return rows.filter(F.when(too_long, F.raise_error(message).cast("boolean")).otherwise(True))


def _file_and_block() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias(PLACE[0]),
        F.col("_metadata.file_block_start").alias(PLACE[1]),
    ]


def with_row_number(scan: DataFrame, name: str = ROW_NUMBER) -> DataFrame:
    """Number the rows of a scan of Parquet files from 1, file by file.

    A row knows its place in its file, however the file is split into tasks; a table with one row per
    file says how many rows come before. Both are read in one plan, so that they cannot disagree. Part
    files follow their numbers, others their names.
    """
    if name in scan.columns:
        raise ValueError(f"the scan has a column {name!r}; give the row number another name")
    file, place = "__file", "__place"
    rows = scan.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    files = rows.groupBy(file).agg((F.max(place) + 1).alias("__rows"))
    part = F.regexp_extract(file, r"part-([0-9]+)", 1).try_cast("bigint")
    order = Window.orderBy(F.regexp_replace(file, r"part-[0-9]+[^/]*$", ""), part.asc_nulls_first(), file)
    before = F.coalesce(F.sum("__rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select(file, before.alias("__before"))
    return rows.join(starts, file).withColumn(name, F.col(place) + 1 + F.col("__before")).drop(file, place, "__before")


def place_rows(df: DataFrame) -> DataFrame:
    """Give each row its place: file, block of the file, and a number growing within the block."""
    return df.withColumn(PLACE[2], F.monotonically_increasing_id())


def number_rows(placed: DataFrame) -> DataFrame:
    """Row numbers from places, for a table which is written: its places are what they were.

    A small table (one row per block) holds how many rows of its file come before each block, another
    one how many come before each file.
    """
    file, block, place = PLACE
    blocks = placed.groupBy(file, block).agg(F.count(F.lit(1)).alias("__rows"), F.min(place).alias("__first"))
    earlier = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__in_file", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    files = blocks.groupBy(file).agg(F.sum("__rows").alias("__size"))
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(file, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    starts = blocks.join(files, file).select(
        file, block, (F.col("__in_file") + F.col("__before") + 1 - F.col("__first")).alias("__shift")
    )
    return (
        placed.join(starts, [file, block])
        .withColumn(ROW_NUMBER, F.col(place) + F.col("__shift"))
        .drop(*PLACE, "__shift")
    )
