"""Profiles merged from parts against profiles of all rows."""

import re

import pytest
from pyspark.sql import functions as F

from sparkboard.operators.profile import DISTINCT_ERROR, merged_parts, profile, profile_of_parts, profile_parts
from sparkboard.sources.store import catalog_of


def table(spark, low, high):
    i = F.col("id")
    return spark.range(low, high).select(
        i.cast("string").alias("n"), (i / 4).cast("decimal(12,2)").cast("string").alias("money"),
        F.when(i < 900, (i % 50).cast("string")).otherwise(F.concat(F.lit("x"), i % 50)).alias("mixed"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 300).cast("int")).cast("string").alias("day"),
        F.concat(F.lit("name "), i % 600).alias("cat.egory"), F.concat(F.lit("t"), i).alias("text"),
        F.when(i % 9 == 0, (i % 2 == 0).cast("string")).alias("flag"), F.lit(None).cast("string").alias("none"),
        i.alias("id"), F.array(i).alias("list"), F.current_date().alias("today"),
    )


def listed(columns):
    return {r["name"]: r.asDict() for r in columns.collect()}


def test_parts_merge_to_the_profile_of_all_rows(spark):
    a, b, c = table(spark, 0, 900), table(spark, 900, 4000), table(spark, 0, 0)
    parts = [profile_parts(x) for x in (a, b, c)]
    once = merged_parts(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    again = merged_parts(merged_parts(parts[0].unionByName(parts[1])).unionByName(parts[2]))
    want = listed(profile(a.unionByName(b), all_null="numeric"))
    for merged in (once, again):
        got = listed(profile_of_parts(merged, all_null="numeric"))
        assert list(got) == list(want)
        for name, row in want.items():
            mine = got[name]
            assert {k: v for k, v in mine.items() if not k.startswith("distinct")} == {k: v for k, v in row.items() if not k.startswith("distinct")}
            if row["distinct_count"] is not None:
                assert mine["distinct_count"] == pytest.approx(row["distinct_count"], rel=DISTINCT_ERROR)
    assert want["mixed"]["type"] == "categorical" and listed(profile_of_parts(parts[0]))["mixed"]["type"] == "numeric"


def test_empty_and_differing_pieces(spark):
    none = listed(profile_of_parts(merged_parts(profile_parts(table(spark, 0, 0)))))
    assert {r["row_count"] for r in none.values()} == {0} and none["n"]["type"] == "text" and none["id"]["type"] == "numeric"
    wider = profile_parts(spark.createDataFrame([("1", "y")], "n string, extra string"))
    got = listed(profile_of_parts(merged_parts(profile_parts(table(spark, 0, 10)).unionByName(wider))))
    assert got["n"]["row_count"] == 11 and got["extra"]["row_count"] == 1
    other = profile_parts(spark.createDataFrame([(1,)], "n long"))
    with pytest.raises(Exception, match="more than one storage type"):
        merged_parts(profile_parts(table(spark, 0, 10)).unionByName(other)).collect()


def test_a_catalog_keeps_the_parts_of_appended_rows(spark, tmp_path):
    catalog = catalog_of(spark, str(tmp_path))
    for upload, (low, high) in {"u1": (0, 500), "u2": (500, 1200)}.items():
        for _ in range(2):  # a retried append counts once
            catalog.add_profile("d", table(spark, low, high).select("n", "mixed", "id"), upload)
    catalog.add_profile("other", table(spark, 0, 3).select("n"), "u3")
    got = listed(catalog.profile("d"))
    want = listed(profile(table(spark, 0, 1200).select("n", "mixed", "id")))
    assert {n: (r["type"], r["target"], r["row_count"]) for n, r in got.items()} == {n: (r["type"], r["target"], r["row_count"]) for n, r in want.items()}
    assert catalog.profile("missing").collect() == []


def test_the_tests_of_many_columns_are_compiled(spark, capsys):
    """The JVM compiles no method beyond 8,000 bytes, and Spark none beyond 64 KB: either would be interpreted, a hundred times slower."""
    wide = spark.range(10).select(*[F.col("id").cast("string").alias(f"c{k}") for k in range(12)])
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        profile_parts(wide).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(-?\d+)", capsys.readouterr().out)]
    assert sizes and all(0 < n <= 8000 for n in sizes)


def test_counts_of_all_kinds_and_of_no_rows(spark):
    values = ["1", "-2.50", "1e5", "true", "2024-01-05", "13/04/2024", "x", "", None, " 7 "]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v string, k int")
    parts = {r["name"]: r for r in profile_parts(df).collect()}
    v, k = parts["v"], parts["k"]
    assert (v["ordinal"], v["kind"], v["rows"], v["non_null"], v["kinds"], v["whole"], v["places"]) == (0, "string", 10, 9, 0, 1, 2)
    assert (k["ordinal"], k["kind"], k["rows"], k["non_null"], k["distinct"]) == (1, "int", 10, None, None)
    none = {r["name"]: r for r in profile_parts(df.limit(0)).collect()}
    assert (none["v"]["rows"], none["v"]["non_null"], none["v"]["kinds"], none["k"]["rows"]) == (0, 0, None, 0)
    assert none["v"]["distinct"] is not None
    empty = {r["name"]: (r["row_count"], r["non_null"]) for r in profile(df.limit(0)).collect()}
    assert empty == {"v": (0, 0), "k": (0, None)}
