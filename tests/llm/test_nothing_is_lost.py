"""Repeated ids with other texts, copies while learning, bytes which are not UTF-8, and columns with the operators' names."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkboard.llm import bpe, html, langid, mixing, simhash
from sparkboard.llm.queries import MIX_POWERS, QUERIES, SQL, margins, tokenizer_file
from sparkboard.llm.shared import shipped

ONE = "the quick brown fox jumps over the lazy dog and runs away from it all day long"
TWO = "a wholly different text about numbers signs and letters which nobody has written before"


def test_texts_under_one_id_are_kept_unless_they_are_equal(spark):
    rows = [(1, ONE), (1, TWO), (1, ONE), (2, ONE), (3, None), (3, ""), (4, ONE.upper()), (None, ONE), (None, ONE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__digest", F.lit("own")).withColumn("__kept_id", F.lit(0))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    found = sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=repr)
    empty = [r for r in found if r[0] == 3]
    assert len(empty) == 1  # null and empty are one group
    assert sorted(set(found) - set(empty), key=repr) == sorted([(1, ONE), (1, TWO), (None, ONE)], key=repr)
    assert len(found) == 5


def test_copies_do_not_end_learning(spark):
    texts = [(f"ein Text mit der Nummer {k} und mehr", "de") for k in range(300)]
    copied = texts + [("immer derselbe Text", "de")] * 450
    schema = "text string, lang string"
    train = lambda rows, bound: langid.train(spark.createDataFrame(rows, schema), per_language=bound)
    once = train(texts + copied[-1:], 400)
    assert (train(copied, 400).weights == once.weights).all()
    # Within a bound the same texts are picked, whatever is copied.
    assert (train(copied, 100).weights == train(texts + copied[-1:], 100).weights).all()


@pytest.fixture(scope="module")
def broken(spark):
    shipped(spark)
    docs = spark.createDataFrame([(1, "good text", "en"), (2, "bad text", "en")], "doc_id long, text string, lang string")
    raw = F.when(F.col("doc_id") == 2, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF20C3")))).otherwise(F.col("text").cast("binary"))
    return docs.withColumn("text", raw.cast("string")).withColumn("source", F.lit("s"))


def test_bytes_which_are_not_utf8_are_replaced(spark, broken):
    clean = broken.withColumn("text", F.make_valid_utf8("text"))
    assert clean.where("doc_id = 2").head()["text"] == "bad text� �"
    path = tokenizer_file()
    both = lambda f: [sorted(map(tuple, f(d).collect())) for d in (broken, clean)]
    for f in (
        lambda d: bpe.encoded_digests(d, path),
        lambda d: bpe.encoded(d, path).select("id", "n_tokens", "decoded_sha256"),
        lambda d: langid.identified(d, langid.train(d)),
        lambda d: langid.accepted(d, langid.train(d)).select("doc_id"),
        lambda d: html.extracted(d, "doc_id", "text", keep=()),
    ):
        found, wanted = both(f)
        assert found == wanted and len(found) == 2


def test_columns_with_the_names_of_the_mix(spark):
    docs = spark.createDataFrame([(k, f"text number {k} of some", "en", "s", "mine") for k in range(40)], "doc_id long, text string, lang string, source string, mix string")
    docs = docs.withColumn("__mix_own", F.lit(1)).withColumn("__p", F.lit(2)).withColumn("kept", F.lit(False))
    kept = corpus_pipeline.mix(spark, docs, "")
    assert kept.columns == docs.columns and {r["mix"] for r in kept.collect()} == {"mine"}
    alone = mixing.mixed(docs, margins(), MIX_POWERS)
    assert alone.columns.count("mix") == 1 and alone.where("mix.probability = 1").count() == 40


def test_one_rare_row_costs_the_mix_nothing(spark, sf001, tmp_path):
    """The registered query and its SQL over documents with a null source, a null language and a new source."""
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    rows = [(-1, "three words here", "en", None), (-2, "three words here", None, "src0"), (-3, "word " * 300, "en", "new")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("int"))
    plain = QUERIES["op5_mixing"](spark, sf001).where("kept").count()
    docs.select(*odd.columns).unionByName(odd).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op5_mixing"](spark, str(tmp_path)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert plain > 500 and found["kept"].sum() > 0.9 * plain
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.execute(SQL["op5_mixing"]).df().sort_values("doc_id").reset_index(drop=True)
    assert list(found.columns) == list(wanted.columns) and len(found) == len(wanted)
    assert (found["kept"] == wanted["kept"]).all() and (abs(found["probability"] - wanted["probability"]) < 1e-7).all()
