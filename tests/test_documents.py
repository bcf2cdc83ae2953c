import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkboard.functions import documents
from sparkboard.sources.scratch import materialize

TEXTS = [
    (1, '{"n": 5, "x": 1.50, "s": "a", "b": true, "d": "2024-02-03", "o": {"p": [1, "q"]}, "it\'s": 1, "a.b c": 2, "big": 12345678901234567890}'),
    (2, '{"n": "7", "x": "abc", "s": null, "b": "no", "d": "soon", "o": 3}'),
    (3, "{}"), (4, "null"), (5, '[{"n": 1}]'), (6, '{"n": 1'), (7, ""), (8, None), (9, '{"n": 1, "n": 2}'),
]
WANTED = {"n": "bigint", "x": "decimal(10,2)", "s": "string", "b": "boolean", "d": "date", "o": "string", "it's": "int", "a.b c": "int", "big": "decimal(38,0)", "none": "double"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "id int, data string")


def by_id(df):
    return {r["id"]: tuple(r)[1:] for r in df.collect()}


def test_missing_null_and_mistyped_fields(docs):
    found = by_id(documents.fields(docs, "data", WANTED, keep=("id",)))
    assert found[1] == (5, Decimal("1.50"), "a", True, dt.date(2024, 2, 3), '{"p":[1,"q"]}', 1, 2, Decimal("12345678901234567890"), None)
    assert found[2] == (7, None, None, False, None, "3", None, None, None, None)
    assert all(found[k] == (None,) * 10 for k in range(3, 10))


def test_what_is_no_document_can_be_counted(docs):
    parsed = docs.withColumn("v", documents.document(F.col("data")))
    lost = parsed.where(documents.unread(F.col("data"), F.col("v"))).select("id").collect()
    assert sorted(r["id"] for r in lost) == [6, 7, 9]  # JSON's null is a document


def test_ten_fields_parse_each_document_once(docs):
    rows = documents.fields(docs, "data", WANTED, keep=("id",))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_stored_documents_are_not_parsed_again(docs):
    stored = materialize(docs.withColumn("data", documents.document(F.col("data"))), "documents")
    rows = documents.fields(stored, "data", WANTED, keep=("id",))
    assert "parseJson" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert by_id(rows) == by_id(documents.fields(docs, "data", WANTED, keep=("id",)))


def test_names_that_clash_or_have_no_path(docs):
    with pytest.raises(ValueError, match="kept"):
        documents.fields(docs, "data", {"ID": "int"}, keep=("id",))
    for name in ("what?", "\"it's\""):
        with pytest.raises(ValueError, match="no path"):
            documents.fields(docs, "data", {name: "int"})
    assert documents.fields(docs.where("false"), "data", WANTED).count() == 0
