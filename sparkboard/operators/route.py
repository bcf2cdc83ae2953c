"""From the words of a question to one of the question templates and its columns.

A question meets the columns of its own dataset: `columns` is an array of (name, type) in schema
order, one field of the row. Routing is therefore a projection: no row moves and questions do not
meet each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, functions as F

from sparkboard.functions.values import any_of
from sparkboard.operators import ask
from sparkboard.operators.shape import counted, shape_by

# The words which lead to a template.
LIST_WORDS = ("list", "show", "display")
ROW_WORDS = (" row",)
ASK_WORDS = ("which", "what", "tell")
HIGH_WORDS = ("highest", "max", "maximum")
LOW_WORDS = ("lowest", "min", "minimum")
TIME_WORDS = ("date", "day", "month", "year", "time")
TOTAL_WORDS = ("total", "sum of")
COUNT_WORDS = ("how many", "count", "number of")
AVERAGE_WORDS = ("average", "avg", "mean")
SUM_WORDS = ("total", "sum")
TOP_WORDS = ("top", "best", "highest")
ALL_WORDS = ("list all", "all regions", "all products")
TREND_WORDS = ("over time", "trend", "by date", "by month")
# Name parts which make a numeric column the likely metric, best first.
METRIC_NAME_PARTS = ("revenue", "sales", "amount", "total", "profit")

# What a number beyond a long asks for: all rows.
ALL_ROWS = 2**63 - 1


def schema_array(columns: DataFrame) -> Column:
    """The columns of one profile as an array literal, for questions which all ask one dataset."""
    listed = columns.orderBy("ordinal").select("name", "type").collect()
    return F.array(*[
        F.struct(F.lit(r["name"]).alias("name"), F.lit(r["type"]).alias("type")) for r in listed
    ])


def mentions(question: Column, name: Column) -> Column:
    """A column is named when its name, `_` read as a blank, is a substring of the question."""
    return question.contains(F.replace(name, F.lit("_"), F.lit(" ")))


def first_number(question: Column) -> Column:
    """The first run of digits as a long, null without one; what no long holds means all rows."""
    digits = F.regexp_extract(question, r"([0-9]+)", 1)
    return F.when(digits != "", F.coalesce(digits.try_cast("bigint"), F.lit(ALL_ROWS)))


def _as_word(pattern: str) -> str:
    # Only Latin letters without accents, digits and `_` make words here.
    return rf"(?<![A-Za-z0-9_])({pattern})(?![A-Za-z0-9_])"


def wants_raw_rows(question: Column) -> Column:
    """The stricter, word-wise test for a listing of rows."""
    q = F.lower(question)
    return q.rlike(_as_word("list|show|display")) & q.rlike(_as_word("rows?"))


def _first(columns: Column, keep) -> Column:
    return F.get(F.filter(columns, keep), 0)["name"]


def _holds(part: str):
    return lambda c: c["name"].contains(part)


def _of_type(columns: Column, kind: str) -> Column:
    return F.filter(columns, lambda c: c["type"] == kind)


def _asked(questions: DataFrame, question: str) -> DataFrame:
    q = F.lower(F.regexp_replace(F.col(question), r"(?U)^\s+|\s+$", ""))
    return questions.withColumn("__q", q).withColumn("__number", first_number(F.col("__q")))


def route(questions: DataFrame, question: str = "question", columns: str = "columns") -> DataFrame:
    """Add `template` and its roles (`dimension`, `metric`, `aggregate`, `highest`, `n`).

    The first template which fits wins; `template` is null where none does. The tests are for
    substrings, so "country" holds "count".
    """
    working = _asked(questions, question).withColumns({
        "__numeric": _of_type(F.col(columns), "numeric"),
        "__datetime": _of_type(F.col(columns), "datetime"),
        "__named": F.filter(F.col(columns), lambda c: mentions(F.col("__q"), c["name"])),
    })
    working = working.withColumns({
        "__any_named": F.get("__named", 0)["name"],
        "__numeric_named": F.get(_of_type(F.col("__named"), "numeric"), 0)["name"],
        "__categorical_named": F.get(_of_type(F.col("__named"), "categorical"), 0)["name"],
        "__first_datetime": F.get("__datetime", 0)["name"],
        "__date_named": _first(
            F.col("__datetime"),
            lambda c: F.array_contains("__named", c) | c["name"].contains("date"),
        ),
        "__likely_metric": F.coalesce(
            *[_first(F.col("__numeric"), _holds(part)) for part in METRIC_NAME_PARTS],
            F.get("__numeric", 0)["name"],
        ),
        "__has_numeric": F.size("__numeric") > 0,
        "__has_datetime": F.size("__datetime") > 0,
    })
    return _planned(questions, working, F.col(columns).isNotNull())


def route_to(questions: DataFrame, columns: DataFrame, question: str = "question") -> DataFrame:
    """As `route`, for questions which all ask one dataset, whose profile is `columns`.

    The schema is known while the plan is made: what it says is constants, and each mention one test.
    """
    schema = [(r["name"], r["type"]) for r in columns.orderBy("ordinal").select("name", "type").collect()]
    of = lambda kind: [n for n, t in schema if t == kind]
    nobody = F.lit(None).cast("string")
    first = lambda names: F.lit(names[0]) if names else nobody

    def named(names: list[str]) -> Column:
        tests = [F.when(F.col("__q").contains(n.replace("_", " ")), F.lit(n)) for n in names]
        return F.coalesce(*tests, nobody)

    numeric, dates = of("numeric"), of("datetime")
    date = [F.lit(n) if "date" in n else named([n]) for n in dates]
    likely = [n for part in METRIC_NAME_PARTS for n in numeric if part in n]
    working = _asked(questions, question).withColumns({
        "__any_named": named([n for n, _ in schema]),
        "__numeric_named": named(numeric),
        "__categorical_named": named(of("categorical")),
        "__first_datetime": first(dates),
        "__date_named": F.coalesce(*date, nobody),
        "__likely_metric": first(likely or numeric),
        "__has_numeric": F.lit(bool(numeric)),
        "__has_datetime": F.lit(bool(dates)),
    })
    return _planned(questions, working, F.lit(True))


def _planned(questions: DataFrame, working: DataFrame, known: Column) -> DataFrame:
    """The rules, over the roles the columns can take."""
    q = F.col("__q")
    metric, category = F.col("__numeric_named"), F.col("__categorical_named")
    has_numeric, has_datetime = F.col("__has_numeric"), F.col("__has_datetime")
    high = any_of(q, HIGH_WORDS)
    grouped_by = any_of(q, SUM_WORDS)
    none = F.lit(None).cast("string")
    no_flag, no_number = F.lit(None).cast("boolean"), F.lit(None).cast("bigint")

    def plan(template, dimension=none, value=none, aggregate=none, highest=no_flag, n=no_number):
        return F.struct(
            F.lit(template).alias("template"),
            dimension.alias("dimension"),
            value.alias("metric"),
            aggregate.alias("aggregate"),
            highest.alias("highest"),
            n.cast("bigint").alias("n"),
        )

    shown = F.least(
        F.greatest(F.coalesce("__number", F.lit(ask.FIRST_ROWS_DEFAULT)), F.lit(1)),
        F.lit(ask.FIRST_ROWS_MAX),
    )
    by_aggregate = (
        F.when(grouped_by, "sum")
        .when(any_of(q, AVERAGE_WORDS), "avg")
        .when(q.contains("count"), "count")
        .otherwise("sum")
    )
    chosen = (
        F.when(
            any_of(q, LIST_WORDS) & any_of(F.concat(F.lit(" "), q), ROW_WORDS),
            plan("first_rows", n=shown),
        )
        .when(
            has_datetime & has_numeric & any_of(q, ASK_WORDS)
            & (high | any_of(q, LOW_WORDS)) & any_of(q, TIME_WORDS),
            plan(
                "extreme_date",
                F.coalesce("__date_named", "__first_datetime"),
                F.coalesce(metric, F.col("__likely_metric")),
                F.lit("sum"),
                high,
                F.lit(1),
            ),
        )
        .when(
            any_of(q, TOTAL_WORDS) & metric.isNotNull(),
            plan("total", value=metric, aggregate=F.lit("sum")),
        )
        .when(
            any_of(q, COUNT_WORDS),
            F.when(F.col("__any_named").isNotNull(), plan(
                "distinct_count", F.col("__any_named"), aggregate=F.lit("count_distinct")
            )).otherwise(plan("row_count", aggregate=F.lit("count"))),
        )
        .when(
            any_of(q, AVERAGE_WORDS) & metric.isNotNull(),
            plan("average", value=metric, aggregate=F.lit("avg")),
        )
        .when(
            q.contains(" by ") & metric.isNotNull() & category.isNotNull(),
            plan("grouped", category, metric, by_aggregate),
        )
        .when(
            any_of(q, TOP_WORDS) & metric.isNotNull(),
            plan(
                "top_rows", F.col("__any_named"), metric,
                n=F.coalesce("__number", F.lit(ask.TOP_ROWS_DEFAULT)),
            ),
        )
        .when(
            any_of(q, ALL_WORDS) & metric.isNotNull() & category.isNotNull(),
            plan("groups_with_total", category, metric, F.lit("sum")),
        )
        .when(
            has_datetime & any_of(q, TREND_WORDS) & metric.isNotNull(),
            plan("time_series", F.col("__first_datetime"), metric, F.lit("sum")),
        )
    )
    routed = working.withColumn("__plan", F.when(known, chosen))
    return routed.select(*questions.columns, "__plan.*")


def route_by_dataset(questions: DataFrame, datasets: DataFrame, question: str = "question") -> DataFrame:
    """Route questions on many datasets, each by the columns in its catalog record.

    A question on a dataset without a record fits no template.
    """
    known = datasets.select("dataset_id", "columns")
    return route(questions.join(known, "dataset_id", "left"), question).drop("columns")


def answer(df: DataFrame, columns: DataFrame, question: str, order_by: str) -> DataFrame | None:
    """Answer one question on one dataset; None where no template fits.

    `order_by` is the row number or key which says what the first rows are.
    """
    return _by_template(df, _routed(columns, question), order_by)


@dataclass(frozen=True)
class Answer:
    """What became of a question: `answered` (with a result, its shape and size), `unknown` or `failed` (with a reason)."""

    question: str
    template: str | None
    status: str
    shape: str | None = None
    result: DataFrame | None = None
    reason: str | None = None
    n_rows: int | None = None


def ask_dataset(df: DataFrame, columns: DataFrame, question: str, order_by: str) -> Answer:
    """From a question to its answer: template, result, shape; a failure is told, not raised.

    The dataset is read once: the result is written to the shared folder and counted meanwhile.
    """
    routed = _routed(columns, question)
    template = routed["template"]
    if template is None:
        return Answer(question, None, "unknown")
    try:
        result, n = counted(_by_template(df, routed, order_by))
        return Answer(question, template, "answered", shape_by(n, len(result.columns)), result, n_rows=n)
    except (PySparkException, ValueError, TypeError) as error:
        return Answer(question, template, "failed", reason=str(error).strip().splitlines()[0])


def _routed(columns: DataFrame, question: str) -> Row:
    return route_to(columns.limit(1).select(F.lit(question).alias("question")), columns).head()


def _by_template(df: DataFrame, r: Row, order_by: str) -> DataFrame | None:
    templates = {
        "first_rows": lambda: ask.first_rows(df, order_by, r["n"]),
        "extreme_date": lambda: ask.extreme_date(df, r["dimension"], r["metric"], r["highest"]),
        "total": lambda: ask.total(df, r["metric"]),
        "distinct_count": lambda: ask.distinct_count(df, r["dimension"]),
        "row_count": lambda: ask.row_count(df),
        "average": lambda: ask.average(df, r["metric"]),
        "grouped": lambda: ask.grouped(df, r["dimension"], r["metric"], r["aggregate"]),
        "top_rows": lambda: ask.top_rows(df, r["dimension"], r["metric"], r["n"], [order_by]),
        "groups_with_total": lambda: ask.groups_with_total(df, r["dimension"], r["metric"]),
        "time_series": lambda: ask.time_series(df, r["dimension"], r["metric"]),
    }
    return templates[r["template"]]() if r["template"] else None
