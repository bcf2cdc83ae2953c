"""Many fields of JSON documents: each document is parsed once, into a variant, and may be stored so."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from sparkboard.functions.values import quoted


def document(text: Column) -> Column:
    """A JSON text as a variant; null where it is null, no JSON, too large for one, or names a field twice."""
    return F.try_parse_json(text)


def unread(text: Column, parsed: Column) -> Column:
    """True where there was a text and no document came of it, so that a write can count what it loses."""
    return text.isNotNull() & parsed.isNull()


def field(parsed: Column, name: str, kind: str = "string") -> Column:
    """A top-level field, whatever signs its name holds, as a value of the type `kind`.

    Null where the field is missing, JSON's null, or no value of that type; a text that spells one counts as one. As
    text, numbers are in their shortest form, and objects and arrays are JSON.
    """
    return F.try_variant_get(parsed, _path(name), kind)


def _path(name: str) -> str:
    if "?" not in name:
        for quote in ("'", '"'):
            if quote not in name:
                return f"$[{quote}{name}{quote}]"
    raise ValueError(f"a variant has no path to a field called {name!r}")


def fields(df: DataFrame, source: str, wanted: Mapping[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of `keep`, and a column per wanted field with its type, from documents in the column `source`.

    The column holds JSON texts or variants; texts are parsed once, however many fields are wanted. Fields are read
    by top-level name; a field called like a column of `keep` raises an error.
    """
    clash = {k.lower() for k in keep} & {w.lower() for w in wanted}
    if clash:
        raise ValueError(f"fields called like kept columns: {sorted(clash)}")
    kind = df.schema[source].dataType.typeName()
    parsed = quoted(source) if kind == "variant" else document(quoted(source).cast("string"))
    # A projection of its own: the planner does not merge an expensive value into many uses.
    rows = df.select(*map(quoted, keep), parsed.alias("__document"))
    return rows.select(*map(quoted, keep), *[field(F.col("__document"), name, kind).alias(name) for name, kind in wanted.items()])
