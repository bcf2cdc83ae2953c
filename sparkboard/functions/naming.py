"""Column names: snake_case, unique, and the dataset name taken from a file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The rename steps, in the order they apply. `\p{L}\p{N}_` are the characters that
# count as part of a word in any script.
SNAKE_CASE_STEPS = (
    (r"(?U)I[Dd]\b", "Id"),
    (r"(?U)[^\p{L}\p{N}_\s]", ""),
    (r" ", "_"),
    (r"(?<!^)([A-Z])", "_$1"),
)


def snake_case(name: Column) -> Column:
    """`CustomerID` -> `customer_id`, `Total ($)` -> `total`, `SKU` -> `s_k_u`."""
    for pattern, replacement in SNAKE_CASE_STEPS:
        name = F.regexp_replace(name, pattern, replacement)
    name = F.regexp_replace(F.lower(name), "_+", "_")
    return F.btrim(name, F.lit("_"))


def dataset_name(file_name: Column) -> Column:
    """File name without its last extension, spaces to `_`, lower case."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    return F.lower(F.replace(stem, F.lit(" "), F.lit("_")))


def normalize_names(names: DataFrame, name: str = "name") -> DataFrame:
    """Add the column `normalized` to a table of raw column names."""
    return names.withColumn("normalized", snake_case(F.col(name)))


def header_names(raw: list[str | None]) -> list[str]:
    """Give each header cell a name: blank cells by position, repeats as `x`, `x.1`, `x.2`."""
    taken: set[str] = set()
    names = []
    for position, cell in enumerate(raw):
        base = cell if cell else f"Unnamed: {position}"
        names.append(_first_free(base, ".", taken))
        taken.add(names[-1])
    return names


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get `_1`, `_2`, ... and never meet a name which is already there."""
    taken: set[str] = set()
    result = []
    for name in names:
        result.append(_first_free(name, "_", taken))
        taken.add(result[-1])
    return result


def _first_free(base: str, joiner: str, taken: set[str]) -> str:
    candidate, suffix = base, 0
    while candidate in taken:
        suffix += 1
        candidate = f"{base}{joiner}{suffix}"
    return candidate


def snake_case_columns(spark: SparkSession, raw: list[str | None]) -> list[str]:
    """The final column names for one header row (as many names as the table has columns)."""
    rows = [(i, n) for i, n in enumerate(header_names(raw))]
    table = spark.createDataFrame(rows, "ordinal int, name string")
    normalized = normalize_names(table).collect()
    return unique_names([r["normalized"] for r in sorted(normalized, key=lambda r: r["ordinal"])])


def rename_columns(df: DataFrame) -> DataFrame:
    """The same table with snake_case, unique column names."""
    return df.toDF(*snake_case_columns(df.sparkSession, df.columns))
