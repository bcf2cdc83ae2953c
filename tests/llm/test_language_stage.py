"""The pipeline's language stage: foreign prose and letter noise go, everything else stays."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sparkboard.llm import langid

FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью.",
    "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
]


def test_foreign_prose_goes_and_the_documents_stay(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    signs = random.Random(1)
    noise = "".join(signs.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(400))
    odd = [(10**9 + i, t, None, "odd", 0) for i, t in enumerate([*FOREIGN, noise, "12 34", "", None])]
    clean = [(2 * 10**9, "the", None, "odd", 3)]
    more = spark.createDataFrame(odd + clean, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language(spark, docs.unionByName(more), sf001)
    assert kept.columns == docs.columns
    ids = {r[0] for r in kept.select("doc_id").collect()}
    letters = {r[0] for r in docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    assert letters <= ids
    assert not ids & {r[0] for r in odd} and 2 * 10**9 in ids


def test_few_texts_reject_nothing_and_an_empty_table_is_one(spark):
    few = spark.createDataFrame([(1, "some words of a text", "en")] * 3, "doc_id long, text string, lang string")
    model = langid.train(few)
    usual = langid.usual_fits(few, model)
    assert usual.of == {} and langid.accepted(few, model, usual=usual).count() == 3
    none = langid.train(few.limit(0))
    assert langid.accepted(few.limit(0), none, usual=langid.usual_fits(few.limit(0), none)).count() == 0


def test_the_model_of_the_stage_comes_from_all_learning_texts(spark, monkeypatch):
    texts = [f"word{'abcdefghij'[k % 10]} {'klmnopqrst'[k // 10 % 10]}x {'uvwxyzabcd'[k // 100 % 10]}y {'efghijklmn'[k // 1000]}z" for k in range(6000)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    met = {}
    monkeypatch.setattr(langid, "accepted", lambda docs, model, **rest: met.update(rest, model=model) or docs)
    corpus_pipeline.language(spark, docs, "")
    learning = {t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 4 != 2}
    assert len(learning) > 4000
    counts = sum(langid.buckets(t) for t in learning)
    wanted = np.log((counts + 0.5) / (counts.sum() + 0.5 * len(counts)))
    assert met["model"].languages == ("en",) and np.allclose(met["model"].weights[:, 0], wanted, rtol=0, atol=1e-12)
