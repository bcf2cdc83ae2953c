"""Reading typed values out of text, and the casts measures go through."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Texts a CSV reader takes for a missing value.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Possessive throughout: a value which fails does so at its first odd character.
NUMBER_PATTERN = r"^\s*+[+-]?+(?:\d++(?:\.\d*+)?+|\.\d++)(?:[eE][+-]?+\d++)?+\s*+$"

# Date spellings: a text every such value holds, a pattern, and how its parts make an ISO date; None
# where the value is one already, a format where a month is spelled out. Listed by preference:
# 01/02/2024 is January 2nd unless a value of the column rules that out. Days and months are kept to
# their ranges here, because a date which does not exist costs an exception in the parser.
CLOCK = r"(\s+\d{1,2}:\d{2}(?::\d{2})?)?\s*$"
DAY, MONTH, YEAR = r"(0?[1-9]|[12]\d|3[01])", r"(0?[1-9]|1[0-2])", r"(\d{4})"
DATE_SPELLINGS = (
    ("iso", "-", rf"^\s*{YEAR}-{MONTH}-{DAY}([T ].*)?$", None),
    ("m/d/y", "/", rf"^\s*{MONTH}/{DAY}/{YEAR}{CLOCK}", "$3-$1-$2$4"),
    ("d/m/y", "/", rf"^\s*{DAY}/{MONTH}/{YEAR}{CLOCK}", "$3-$2-$1$4"),
    ("m-d-y", "-", rf"^\s*{MONTH}-{DAY}-{YEAR}{CLOCK}", "$3-$1-$2$4"),
    ("d-m-y", "-", rf"^\s*{DAY}-{MONTH}-{YEAR}{CLOCK}", "$3-$2-$1$4"),
    ("y/m/d", "/", rf"^\s*{YEAR}/{MONTH}/{DAY}{CLOCK}", "$1-$2-$3$4"),
    ("d mon y", " ", rf"^\s*{DAY} [A-Z][a-z]{{2}} {YEAR}{CLOCK}", "d MMM yyyy[ H:mm[:ss]]"),
    ("mon d, y", ",", rf"^\s*[A-Z][a-z]{{2}} {DAY}, {YEAR}{CLOCK}", "MMM d, yyyy[ H:mm[:ss]]"),
    ("d month y", " ", rf"^\s*{DAY} [A-Z][a-z]{{3,}} {YEAR}{CLOCK}", "d MMMM yyyy[ H:mm[:ss]]"),
    ("month d, y", ",", rf"^\s*[A-Z][a-z]{{3,}} {DAY}, {YEAR}{CLOCK}", "MMMM d, yyyy[ H:mm[:ss]]"),
)
# A time of day with its offset from UTC.
OFFSET = r":\d{2}(?:\.\d*)?\s*(?:Z|UTC|GMT|[+-]\d{1,2}(?::?\d{2})?)\s*$"
DATE_SPELLING_NAMES = tuple(name for name, *_ in DATE_SPELLINGS)


def is_number(text: Column) -> Column:
    return text.rlike(NUMBER_PATTERN)


def is_boolean(text: Column) -> Column:
    return text.isin("True", "TRUE", "true", "False", "FALSE", "false")


def parse_number(text: Column) -> Column:
    """Text to double, null where it is no plain number (`1d` and `0x1p3` are none)."""
    return F.when(is_number(text), text.try_cast("double"))


def parse_date(text: Column, spelling: str) -> Column:
    """Text to timestamp in one of `DATE_SPELLING_NAMES`, null where it does not parse.

    Numeric spellings are rewritten to ISO, whose cast is cheap also where it fails. A time with an
    offset becomes the time in UTC, whatever the zone of the session.
    """
    _, mark, pattern, parts = DATE_SPELLINGS[DATE_SPELLING_NAMES.index(spelling)]
    if parts is None:
        parsed = F.when(text.rlike(OFFSET), _in_utc(text)).otherwise(text.try_cast("timestamp_ntz"))
    elif parts.startswith("$"):
        parsed = F.regexp_replace(text, pattern, parts).try_cast("timestamp_ntz")
    else:
        parsed = F.try_to_timestamp(F.btrim(text), F.lit(parts)).cast("timestamp_ntz")
    return F.when(text.contains(mark) & text.rlike(pattern), parsed)


def _in_utc(text: Column) -> Column:
    seconds = F.unix_micros(text.try_cast("timestamp")).cast("decimal(20,0)") / F.lit(Decimal(10**6))
    nothing = F.lit(0)
    span = F.make_dt_interval(nothing, nothing, nothing, seconds.cast("decimal(18,6)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + span


def missing_to_null(text: Column) -> Column:
    return F.when(~text.isin(*MISSING_TEXTS), text)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in the float columns; other columns are left alone."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns(
        {c: F.when(~F.isnan(quoted(c)), quoted(c)) for c in floats}
    ) if floats else df


def typed(text: Column, target: str, on_error: str = "raise") -> Column:
    """Text to `numeric` (a double: all magnitudes) or `datetime`; a bad value fails the query, or is null on request."""
    if target not in ("numeric", "datetime"):
        raise ValueError(f"target is 'numeric' or 'datetime', not {target!r}")
    if on_error not in ("raise", "null"):
        raise ValueError(f"on_error is 'raise' or 'null', not {on_error!r}")
    if target == "datetime":
        return text.try_cast("date") if on_error == "null" else text.cast("date")
    return parse_number(text) if on_error == "null" else or_raise(parse_number(text), text, "number")


def or_raise(parsed: Column, text: Column, what: str) -> Column:
    """The parsed value; a text which did not parse fails the query."""
    message = F.concat(F.lit(f"not a {what}: '"), text, F.lit("'"))
    return F.when(parsed.isNull() & text.isNotNull(), F.raise_error(message)).otherwise(parsed)


def quoted(name: str) -> Column:
    """A column by its exact name, also when it holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def measure(df: DataFrame, name: str, scale: int | None = None) -> Column:
    """The column as a number to aggregate.

    Text is read as doubles and booleans count as 0/1. `scale` makes it a decimal of that many places
    (text directly, not through a double); NaN and infinities, which are no amounts, are then null.
    """
    kind = df.schema[name].dataType
    value = quoted(name)
    if isinstance(kind, T.StringType):
        value = F.btrim(value).cast(_amount(scale)) if scale is not None else typed(value, "numeric")
    elif scale is not None and isinstance(kind, (T.DoubleType, T.FloatType)):
        value = _finite(value)
    elif isinstance(kind, T.BooleanType):
        value = value.cast("int")
    elif not isinstance(kind, T.NumericType):
        raise TypeError(f"{name} is {kind.simpleString()}, not a number")
    return value if scale is None else value.cast(_amount(scale))


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def _amount(scale: int) -> T.DecimalType:
    return T.DecimalType(18, scale)


def total_of(df: DataFrame, name: str, scale: int | None = None) -> Column:
    """The sum of a column. With `scale`, doubles are summed as decimals of that many places, so that
    a sum over any number of partitions has one result.

    Doubles are summed as whole units (cents, for two places) in three integers of 21 bits each,
    which is several times faster than decimals and exact for 10^12 rows of any amount. NaN and
    infinities are left out, as nulls are.
    """
    if scale is None or not isinstance(df.schema[name].dataType, T.FractionalType) or isinstance(
        df.schema[name].dataType, T.DecimalType
    ):
        return F.sum(measure(df, name, scale))
    units = _units(_finite(quoted(name).cast("double")), scale)
    low = F.lit(2**21 - 1)
    upper = F.sum(F.shiftright(units, 42)).cast("decimal(20,0)")
    middle = F.sum(F.shiftright(units, 21).bitwiseAND(low)).cast("decimal(20,0)")
    lower = F.sum(units.bitwiseAND(low)).cast("decimal(20,0)")
    whole = upper * F.lit(Decimal(2**42)) + middle * F.lit(Decimal(2**21)) + lower
    return (whole * F.lit(Decimal(1).scaleb(-scale))).cast(T.DecimalType(38, scale))


def _units(value: Column, scale: int) -> Column:
    """A double as a whole number of units of 10^-scale, rounded as its decimal text is.

    Where the product is close to a whole number, that is the answer; the rest goes through decimals.
    """
    scaled = value * F.lit(float(10**scale))
    nearest = F.rint(scaled)
    clear = (F.abs(scaled - nearest) < 0.4) & (F.abs(scaled) < 1e14)
    careful = (value.cast(_amount(scale)) * F.lit(Decimal(10**scale))).cast("bigint")
    return F.when(clear, nearest.cast("bigint")).otherwise(careful)


def average_of(df: DataFrame, name: str, scale: int | None = None) -> Column:
    """The average of a column; with `scale`, of exact decimals, to four more places."""
    if scale is None:
        return F.avg(measure(df, name))
    count = F.nullif(F.count(measure(df, name, scale)), F.lit(0))
    return (total_of(df, name, scale) / count).cast(T.DecimalType(22, scale + 4))


def smallest_of(df: DataFrame, name: str, scale: int | None = None) -> Column:
    return F.min(measure(df, name, scale))


def largest_of(df: DataFrame, name: str, scale: int | None = None) -> Column:
    return F.max(measure(df, name, scale))


def count_of(df: DataFrame, name: str, scale: int | None = None) -> Column:
    return F.count(measure(df, name))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """True where the text holds one of the words as a substring."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def json_field(document: Column, name: str) -> Column:
    """One top-level field of a JSON document as text, null where it is missing."""
    return F.get_json_object(document, f"$['{name}']")
