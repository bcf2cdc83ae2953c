"""Column profile: one of four logical types per column, and the counts behind it."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkboard.functions.values import (
    DATE_SPELLING_NAMES,
    is_boolean,
    is_number,
    or_raise,
    parse_date,
    quoted,
)
from sparkboard.sources.scratch import local_table

# Fixed value: a text column is categorical while fewer than half of its values are distinct.
CATEGORICAL_BELOW = 0.5
# Values longer than this are compared by digest, so that long texts do not travel whole.
DIGEST_ABOVE = 64
# Rows which tell what a column cannot be.
FIRST_LOOK = 1000
# What a text value can be, one bit each: a number, one without exponent, one without a point, a
# boolean, a date of each spelling.
KINDS = {
    name: 1 << i
    for i, name in enumerate(("number", "plain", "integer", "boolean", *DATE_SPELLING_NAMES))
}
BLANK_OR_SIGN = " \t\n\r+-"
# How the texts begin which can be dates: 2024-, 2024/, 1/, 1-, 1 Jan, Jan 1.
DATE_BEGINNING = r"^\s*(\d{4}[-/]|\d{1,2}[-/]|\d{1,2} [A-Z]|[A-Z][a-z]{2,} \d)"

PROFILE_SCHEMA = T.StructType([
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("target", T.StringType(), False),
    T.StructField("spelling", T.StringType()),
    T.StructField("row_count", T.LongType(), False),
    T.StructField("non_null", T.LongType()),
    T.StructField("distinct_count", T.LongType()),
    T.StructField("distinct_ratio", T.DoubleType()),
])


def profile(
    df: DataFrame,
    all_null: str = "text",
    approximate: bool = False,
    sample_rows: int | None = None,
    order_by: str | None = None,
) -> DataFrame:
    """One row per column: logical type, storage type, row count and, for text, distinct values.

    Typed columns are decided by the schema and are not read. Text columns take one pass which tells
    numbers and dates apart and shuffles one row per column and task; only the columns left
    undecided are counted for distinct values. Counts, not values, come back to the driver.
    `sample_rows` with `order_by` tests numbers and dates on the first non-null values of each
    column alone.
    """
    fields = df.schema.fields
    texts = [f.name for f in fields if isinstance(f.dataType, (T.StringType, T.VarcharType))]
    counts = _scalar_counts(df, texts)
    rows = counts[texts[0]]["rows"] if texts else df.count()
    if sample_rows is not None:
        if order_by is None:
            raise ValueError("sample_rows needs order_by, the column with the row order")
        for name in texts:
            first = df.filter(quoted(name).isNotNull()).orderBy(quoted(order_by)).limit(sample_rows)
            head = _scalar_counts(first.select(quoted(name)), [name])[name]
            counts[name] = {**head, "tested": head["non_null"], "non_null": counts[name]["non_null"]}
    found = {name: _decide(counts[name], all_null) for name in texts}
    undecided = [name for name, (logical, _, _) in found.items() if logical is None]
    distinct = _distinct_counts(df, undecided, approximate)

    result = []
    for ordinal, field in enumerate(fields):
        logical, target, spelling = found.get(field.name) or _type_from_schema(field.dataType)
        non_null = counts[field.name]["non_null"] if field.name in found else None
        unique = distinct.get(field.name)
        ratio = None if unique is None else unique / non_null
        if logical is None:
            logical = "categorical" if ratio < CATEGORICAL_BELOW else "text"
        result.append((ordinal, field.name, logical, target, spelling, rows, non_null, unique, ratio))
    return local_table(df.sparkSession, result, PROFILE_SCHEMA)


def _type_from_schema(kind: T.DataType) -> tuple[str, str, None]:
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return "numeric", kind.simpleString(), None
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime", kind.simpleString(), None
    return "text", kind.simpleString(), None


def _long(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """The given columns below each other: (i, value), where i counts the columns from 0."""
    texts = df.select(*[v.alias(str(i)) for i, v in enumerate(values.values())])
    return texts.unpivot([], texts.columns, "i", "value")


def _scalar_counts(df: DataFrame, names: list[str]) -> dict[str, dict[str, int]]:
    """Per text column: rows, values, the kinds all of its values are of, and their digits.

    Each value gets a number with one bit per kind; the bits left after AND are those of the column. A few
    rows tell which kinds a column cannot be of; all rows are then tested for the others alone, which
    gives the same bits.
    """
    if not names:
        return {}
    few = _count_kinds(df.select(*[quoted(n) for n in names]).limit(FIRST_LOOK), dict.fromkeys(names, set(KINDS)))
    left = {
        n: {k for k, bit in KINDS.items() if few[n]["kinds"] & bit} if few[n]["non_null"] else set(KINDS) for n in names
    }
    return _count_kinds(df, left)


def _count_kinds(df: DataFrame, possible: dict[str, set[str]]) -> dict[str, dict[str, int]]:
    texts = _long(df, {n: quoted(n) for n in possible})
    counted = _tested(texts, list(possible.values())).groupBy("i").agg(F.count(F.lit(1)).alias("rows"), *_test_counts()).collect()
    found = {r["i"]: r for r in counted}
    names = ("rows", "non_null", "kinds", "whole", "places")
    return {n: {k: found[i][k] or 0 if i in found else 0 for k in names} for i, n in enumerate(possible)}


def _tested(texts: DataFrame, possible: list[set[str]]) -> DataFrame:
    """Adds to the rows of `_long` `t`, (kinds, whole, places) of a text: column i is tested for possible[i] alone.

    One copy of the tests serves all columns. Each step is used more than once by the next one, so that they
    stay steps: a text meets each pattern once, and the generated methods stay as short as the JVM compiles
    them (8,000 bytes), however many columns there are.
    """
    own = [sum(KINDS[k] for k in kinds) for kinds in possible]
    some = set().union(*possible)
    may = lambda bits: F.col("may").bitwiseAND(F.lit(bits)) != 0
    nothing, value = F.lit(None), F.col("value")
    rows = texts.withColumn("i", F.col("i").cast("int"))
    rows = rows.withColumn("may", F.get(F.array(*map(F.lit, own)), F.col("i")))
    number = F.when(may(KINDS["number"]) & is_number(value), F.btrim(value, F.lit(BLANK_OR_SIGN)))
    rows = rows.withColumn("number", number if "number" in some else nothing.cast("string"))
    # A number is no date, and most other texts are told apart from dates by how they begin.
    spellings = [s for s in DATE_SPELLING_NAMES if s in some]
    dates = [F.when(may(KINDS[s]) & parse_date(value, s).isNotNull(), KINDS[s]).otherwise(0) for s in spellings]
    can_be = F.col("number").isNull() & may(sum(KINDS[s] for s in spellings)) & value.rlike(DATE_BEGINNING)
    rows = rows.withColumn("dates", F.when(can_be, reduce(add, dates)) if spellings else nothing.cast("int"))
    rows = rows.withColumn("plain", F.when(~(F.col("number").contains("e") | F.col("number").contains("E")), F.col("number")))
    rows = rows.withColumn("point", F.instr("plain", "."))
    boolean = F.when(may(KINDS["boolean"]) & is_boolean(value), KINDS["boolean"]).otherwise(0)
    kinds = F.when(
        F.col("number").isNotNull(), F.when(F.col("point") == 0, KINDS["number"] | KINDS["plain"] | KINDS["integer"])
        .when(F.col("point") > 0, KINDS["number"] | KINDS["plain"]).otherwise(KINDS["number"])
    ).when(F.col("dates").isNotNull(), F.col("dates")).otherwise(boolean)
    whole = F.when(F.col("point") > 0, F.col("point") - 1).otherwise(F.length("plain"))
    places = F.when(F.col("point") > 0, F.length("plain") - F.col("point")).otherwise(0)
    found = F.struct(kinds.alias("kinds"), whole.alias("whole"), places.alias("places"))
    return rows.select(*texts.columns, F.when(value.isNotNull(), found).alias("t"))


def _test_counts() -> list[Column]:
    """What the rows of `_tested` add up to, per column."""
    return [
        F.count("value").alias("non_null"), F.bit_and("t.kinds").alias("kinds"), F.max("t.whole").alias("whole"), F.max("t.places").alias("places"),
    ]


def _decide(own: dict[str, int], all_null: str) -> tuple[str | None, str, str | None]:
    """Logical type (None: categorical or text), storage type and date spelling of a text column.

    Numbers are tested before dates: a column of years is a number here.
    """
    if own.get("tested", own["non_null"]) == 0:
        return all_null, "double" if all_null == "numeric" else "string", None
    kinds = {name for name, bit in KINDS.items() if own["kinds"] & bit}
    if "boolean" in kinds:
        return "numeric", "boolean", None
    if "number" in kinds:
        if "plain" not in kinds:
            return "numeric", "double", None
        if "integer" in kinds and own["whole"] <= 18:
            return "numeric", "bigint", None
        if own["whole"] + own["places"] <= 38:
            digits = max(own["whole"] + own["places"], 1)
            return "numeric", f"decimal({digits},{own['places']})", None
        return "numeric", "double", None
    for spelling in DATE_SPELLING_NAMES:
        if spelling in kinds:
            return "datetime", "timestamp_ntz", spelling
    return None, "string", None


def _distinct_counts(df: DataFrame, names: list[str], approximate: bool) -> dict[str, int]:
    """Distinct values of several columns in one job: the first shuffle is on (name, value)."""
    if not names:
        return {}
    if approximate:
        row = df.agg(*[F.approx_count_distinct(quoted(n)).alias(str(i)) for i, n in enumerate(names)])
        return dict(zip(names, row.head(), strict=True))
    keys = _long(df, {n: _distinct_key(quoted(n)) for n in names})
    counted = keys.groupBy("i").agg(F.count_distinct("value").alias("n")).collect()
    unique = {int(r["i"]): r["n"] for r in counted}
    return {n: unique.get(i, 0) for i, n in enumerate(names)}


def _distinct_key(text: Column) -> Column:
    # The mark keeps a digest apart from a short value which reads the same.
    return F.when(F.length(text) > DIGEST_ABOVE, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(
        F.concat(F.lit("="), text)
    )


def distinct_ratio(df: DataFrame, name: str, approximate: bool = False) -> DataFrame:
    """Distinct over non-null values of one column."""
    value = quoted(name)
    unique = F.approx_count_distinct(value) if approximate else F.count_distinct(value)
    return df.agg(unique.alias("distinct_count"), F.count(value).alias("non_null")).withColumn(
        "distinct_ratio", F.col("distinct_count") / F.nullif(F.col("non_null"), F.lit(0))
    )


def cast_by_profile(df: DataFrame, columns: DataFrame, on_error: str = "raise") -> DataFrame:
    """Give every text column the storage type its profile found; tag it with its logical type.

    A value which does not fit, because the profile has not seen it, fails the query, or is null on request.
    """
    if on_error not in ("raise", "null"):
        raise ValueError(f"on_error is 'raise' or 'null', not {on_error!r}")
    strict = on_error == "raise"
    wanted = {r["name"]: r for r in columns.collect()}
    result = []
    for field in df.schema:
        value = quoted(field.name)
        row = wanted.get(field.name)
        if row is None:
            result.append(value)
            continue
        if isinstance(field.dataType, T.StringType):
            if row["spelling"]:
                parsed = parse_date(value, row["spelling"])
                value = or_raise(parsed, value, "date of its column") if strict else parsed
            elif row["target"] != "string":
                value = F.btrim(value).cast(row["target"]) if strict else F.btrim(value).try_cast(row["target"])
        result.append(value.alias(field.name, metadata={"logical_type": row["type"]}))
    return df.select(*result)


def type_lookup(names: DataFrame, columns: DataFrame, name: str = "name") -> DataFrame:
    """Add the logical type of each named column; a name the schema lacks is `unknown`."""
    types = columns.select(F.col("name").alias(name), F.col("type"))
    return names.join(types, name, "left").withColumn("type", F.coalesce("type", F.lit("unknown")))


# A sketch of 2 ** 14 buckets tells distinct values to within 2.5 % (three standard errors), few of them exactly.
DISTINCT_BUCKETS = 14
DISTINCT_ERROR = 0.025


def profile_parts(df: DataFrame) -> DataFrame:
    """What a profile is made of, one row per column, so that parts merge: (ordinal, name, kind, rows, non_null, kinds, whole, places, distinct).

    One aggregation over all rows; `distinct` is a sketch of a text column's values, a few kilobytes. A table
    without rows gives its columns with counts of 0.
    """
    fields = df.schema.fields
    texts = [isinstance(f.dataType, (T.StringType, T.VarcharType)) for f in fields]
    unread = F.lit(None).cast("string")
    long = _long(df, {f.name: quoted(f.name) if is_text else unread for f, is_text in zip(fields, texts, strict=True)})
    # A row more per column, which counts as none: a table without rows has its columns, too.
    long = long.withColumn("row", F.lit(1)).unionAll(df.sparkSession.range(len(fields)).select(F.col("id").cast("string"), unread, F.lit(0)))
    tested = _tested(long, [set(KINDS) if is_text else set() for is_text in texts])
    counted = tested.groupBy("i").agg(
        F.sum("row").alias("rows"), *_test_counts(), F.hll_sketch_agg(_distinct_key(F.col("value")), F.lit(DISTINCT_BUCKETS)).alias("distinct")
    )
    about = lambda values: F.get(F.array(*map(F.lit, values)), F.col("i"))
    is_text = about(texts)
    return counted.select(
        F.col("i").alias("ordinal"), about([f.name for f in fields]).alias("name"), about([f.dataType.simpleString() for f in fields]).alias("kind"), "rows",
        *[F.when(is_text, F.col(c)).alias(c) for c in ("non_null", "kinds", "whole", "places", "distinct")],
    )


def merged_parts(parts: DataFrame) -> DataFrame:
    """The parts of a whole table from those of its pieces, whose rows are not read again.

    A column which some pieces lack has its own rows alone; one whose storage type differs between pieces fails.
    """
    same = F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise(F.raise_error(F.lit("a column with more than one storage type")))
    return parts.groupBy("name").agg(
        F.min("ordinal").alias("ordinal"), same.alias("kind"), F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"),
        F.bit_and("kinds").alias("kinds"), F.max("whole").alias("whole"), F.max("places").alias("places"),
        F.hll_union_agg("distinct", F.lit(True)).alias("distinct"),
    ).select("ordinal", "name", "kind", "rows", "non_null", "kinds", "whole", "places", "distinct")


def profile_of_parts(parts: DataFrame, all_null: str = "text") -> DataFrame:
    """The profile made of `merged_parts`, as `profile` gives it but for the distinct count of text columns.

    That is an estimate, at most `DISTINCT_ERROR` away; a column whose ratio lies that near to one half may
    be categorical here and text there, or the other way round.
    """
    estimate = F.when(F.col("non_null") > 0, F.least(F.hll_sketch_estimate("distinct"), F.col("non_null")))
    listed = parts.withColumn("unique", estimate).drop("distinct").orderBy("ordinal", "name").collect()  # a row per column
    result = []
    for ordinal, r in enumerate(listed):
        if r["non_null"] is None:
            logical, target, spelling = _type_from_schema(T._parse_datatype_string(r["kind"]))
            unique = ratio = None
        else:
            logical, target, spelling = _decide({k: r[k] or 0 for k in ("non_null", "kinds", "whole", "places")}, all_null)
            unique = r["unique"] if logical is None else None
            ratio = None if unique is None else unique / r["non_null"]
            if logical is None:
                logical = "categorical" if ratio < CATEGORICAL_BELOW else "text"
        result.append((ordinal, r["name"], logical, target, spelling, r["rows"], r["non_null"], unique, ratio))
    return local_table(parts.sparkSession, result, PROFILE_SCHEMA)
