"""How filters act together: what each one removes behind any others, and what is lost by it.

Every filter has a relation of the rows that fail it. Left-semi joins with the relations of some filters and
left-anti joins with those of all others give the rows which fail just these: disjoint regions, 2^n for n
filters, the survivors of all filters one of them. What any prefix of any order leaves, removes, finds removed
before and loses of labelled rows is made of whole regions, so that n! orders need no further look at rows.
Relations are bucketed by the row's key, so that none of these joins moves a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkboard.llm.shared import WORD, column, dropped, saved
from sparkboard.sources.scratch import new_path

#: Rows of a bucket aimed at.
BUCKET_ROWS = 250_000
#: Copies from which on a text is looked up in a table of its own.
MANY = 10_000

KEY = "__key"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on a text which is not null, by filter."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n_words < 200,
        "B": 100 * n_distinct < 50 * n_words,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def labelled_rows(docs: DataFrame, labels: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, part, good, toxic, digest, a failure flag per text filter) per row, written.

    The key tells rows of one id apart. A document is good or toxic if any of its labels says so. A null
    part is the empty string, a null text the empty one.
    """
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    rows = docs.select(column(id_col).cast("long").alias("id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("id", "part", F.sha2(F.col("t").cast("binary"), 256).alias("digest"), *[c.alias(f) for f, c in text_filters(F.col("t")).items()])
    # Written before the keys are read again: a key stays what it is.
    rows = saved(rows.withColumn(KEY, F.monotonically_increasing_id()), "audit-rows")
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.where("id is not null").groupBy("id").agg(F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic"))
    marked = rows.join(marks, "id", "left")
    return marked.withColumns({m: F.coalesce(F.col(m), F.lit(False)) for m in ("good", "toxic")})


def later_copies(rows: DataFrame, many: int = MANY) -> DataFrame:
    """The rows (id, digest, ...) whose digest a smaller id has as well. A null id is no smaller and has no smaller one.

    Texts with many copies are few: they are looked up in a table of their own, which the planner broadcasts
    by its size, so that the copies of one text do not meet in one task.
    """
    heads = saved(rows.groupBy("digest").agg(F.min("id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1"), "audit-copies")
    often = rows.join(heads.where(F.col("__n") > many), "digest")
    hot = heads.where(F.col("__n") > many).select("digest")
    seldom = rows.join(hot, "digest", "left_anti").join(heads.where(F.col("__n") <= many), "digest")
    return often.unionByName(seldom).where("id > __first").drop("__first", "__n")


class Relations:
    """Tables bucketed by the key: joins between them need no shuffle. Files lie in the shared folder."""

    def __init__(self, spark: SparkSession, n_rows: int) -> None:
        self.spark, self.buckets, self.stored = spark, max(1, -(-n_rows // BUCKET_ROWS)), {}

    def store(self, rows: DataFrame, name: str) -> str:
        """The name the table has in SQL."""
        name = f"sparkboard_{name}_{uuid.uuid4().hex}"
        path = new_path(self.spark, name)
        # One task per bucket, so that a bucket is one file.
        rows.repartition(self.buckets, KEY).write.bucketBy(self.buckets, KEY).option("path", path).saveAsTable(name)
        self.stored[name] = self.spark.table(name)
        self.stored[name].written_at = path
        return name

    def drop(self) -> None:
        for name in self.stored:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        dropped(*self.stored.values())


def audited(rows: DataFrame, failing: Mapping[str, DataFrame]) -> DataFrame:
    """(part, mask, rows, good, toxic): the rows of each part by the filters they fail.

    `rows` holds (key, part, good, toxic), `failing` a relation of the same columns per filter. `mask` has a
    bit per filter, in the order of `failing`; masks without a row are left out.
    """
    spark, columns = rows.sparkSession, [KEY, "part", "good", "toxic"]
    relations = Relations(spark, rows.count())
    everything = relations.store(rows.select(*columns), "rows")
    fails = [relations.store(failing[f].select(*columns), f"fails_{k}") for k, f in enumerate(failing)]

    def region(mask: int) -> str:
        """The rows in the relations of these filters and in no other."""
        inside = [f for k, f in enumerate(fails) if mask >> k & 1]
        start, *others = inside or [everything]
        joins = [f"LEFT SEMI JOIN {f} USING ({KEY})" for f in others]
        joins += [f"LEFT ANTI JOIN {f} USING ({KEY})" for k, f in enumerate(fails) if not mask >> k & 1]
        return f"SELECT part, good, toxic, {mask} AS mask FROM {start} {' '.join(joins)}"

    def counted(masks: range) -> DataFrame:
        # All joins of some regions are one stage: they are laid below each other before they are counted.
        return saved(spark.sql(f"""
            SELECT part, mask, count(*) AS rows, count_if(good) AS good, count_if(toxic) AS toxic
            FROM ({" UNION ALL ".join(map(region, masks))}) GROUP BY part, mask"""), "audit-counts")

    n, at_once = 1 << len(fails), 8
    found = reduce(DataFrame.unionByName, [counted(range(at, min(at + at_once, n))) for at in range(0, n, at_once)])
    relations.drop()
    return found


def orders(audit: DataFrame, names: list[str]) -> DataFrame:
    """A row per part, order of the filters and step, from the audit of these filters.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): the
    rows left after the step, those its filter removes (of them the good and the toxic ones), those which fail
    it and were removed before, those which fail it only, and what it removes summed over all orders.
    """
    n = len(names)
    # One row per part, with at most 2^n counts.
    parts = audit.groupBy("part").agg(F.collect_list(F.struct("mask", "rows", "good", "toxic")).alias("regions"))
    steps = F.array(*[
        F.struct(
            F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"),
            F.lit(sum(1 << names.index(f) for f in order[:k])).alias("before"), F.lit(1 << names.index(order[k])).alias("own"),
        )
        for order in permutations(names) for k in range(n)
    ])
    rows = parts.select("*", F.explode(steps).alias("s")).select("part", "regions", "s.*")

    def total(what: str, which: Callable[[Column], Column]) -> Column:
        return F.aggregate("regions", F.lit(0).cast("long"), lambda a, r: a + F.when(which(r["mask"]), r[what]).otherwise(0))

    own, before = F.col("own"), F.col("before")
    here = lambda m: ((m.bitwiseAND(before)) == 0) & (m.bitwiseAND(own) != 0)

    def shapley() -> Column:
        # Of the filters a row fails, the first one removes it: each of f filters in n! / f orders.
        orders_of = lambda m: (F.lit(factorial(n)) / F.bit_count(m)).cast("long")
        fails = lambda m: m.bitwiseAND(own) != 0
        return F.aggregate("regions", F.lit(0).cast("long"), lambda a, r: a + F.when(fails(r["mask"]), r["rows"] * orders_of(r["mask"])).otherwise(0))

    return rows.select(
        "part", "filter_order", "step",
        total("rows", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total("rows", here).alias("removed"),
        total("rows", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(own) != 0)).alias("redundant"),
        total("rows", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        shapley().alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The audit of the five text filters A to E (`text_filters` and copies of a smaller id's text) in all orders.

    A null text counts as empty (fails A; a copy of other empty ones), a null part as the empty string.
    Repeated rows of one id are rows of their own and no copies of each other. Labels without a document
    and those of a null id say nothing. Empty documents give no rows. Columns beside those named are not read.
    """
    rows = saved(labelled_rows(docs, labels, part, id_col, text_col), "audit-rows")
    failing = {f: rows.where(F.col(f)) for f in "ABCD"}
    failing["E"] = later_copies(rows)
    return orders(audited(rows, failing), list(failing))


def interactions_sql() -> str:
    """The same for DuckDB, from one mask per document."""
    return r"""
    WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    first AS (SELECT t, min(doc_id) AS low FROM w GROUP BY t),
    marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    d AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
            CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
            + CASE WHEN 100 * (length(w.t) - length(regexp_replace(w.t, '[A-Z]', '', 'g'))) > 3 * length(w.t) THEN 4 ELSE 0 END
            + CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > low THEN 16 ELSE 0 END AS mask
          FROM w JOIN first ON w.t = first.t LEFT JOIN marks ON w.doc_id = marks.doc_id),
    c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY 1, 2),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    p AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e
          WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    s AS (SELECT filter_order, k AS step, 1 << (ascii(filter_order[k]) - 65) AS own,
            coalesce(list_sum([1 << (ascii(filter_order[j]) - 65) for j in range(1, k)]), 0)::BIGINT AS before
          FROM p, (SELECT unnest(range(1, 6)) AS k)),
    r AS (SELECT part, filter_order, step, own,
            sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
            sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
            sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
            sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
          FROM s, c GROUP BY ALL)
    SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
        unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
        (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
    FROM r
    """
