"""Importance resampling, the filter audit and language-model scoring against plain versions."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from sparkboard.llm import interactions, maxent, resample
from sparkboard.llm.queries import QUERIES, SQL
from sparkboard.llm.shared import shipped

SCHEMA = "doc_id long, text string, lang string"


def documents(spark, rows):
    # Columns whose names the operators use themselves.
    extra = ("id", "word", "n", "weight", "score", "rank", "part", "good", "toxic", "digest", "before", "token", "key", "round", "__key", "A")
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in extra})


def plain_weights(docs, target, n_buckets=10_000):
    def buckets(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
        runs = words + [a + b" " + b for a, b in zip(words, words[1:])]
        return len(words), [zlib.crc32(r) % n_buckets for r in runs]

    found = [buckets(t) for t in docs]
    s, t = Counter(b for _, x in found for b in x), Counter(b for x in target for b in buckets(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + n_buckets) / ((s[b] + 1) * (t.total() + n_buckets)))) for b in range(n_buckets)]
    return [(n, len(x), sum(gain[b] for b in x) // len(x) if x else 0) for n, x in found]


def plain_draw(rows, weights, percent=25, least=20):
    out = {}
    for k, ((id_, *_), (n, features, weight)) in enumerate(zip(rows, weights)):
        h = int(hashlib.sha256(f"7:{id_}".encode()).hexdigest()[:8], 16)
        out[k] = (id_, features, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n)
    able = sorted((k for k in out if out[k][4] >= least), key=lambda k: (-out[k][3], out[k][0]))
    rank = {k: r + 1 for r, k in enumerate(able[: percent * len(able) // 100])}
    return sorted((*out[k][:4], rank.get(k)) for k in out)


def test_resampling_equals_its_plain_version(spark):
    shipped(spark)
    rng = np.random.default_rng(1)
    lexicon = ["the", "Of", "é", "zwölf", "x9", "tail", "中文", "a", "B" * 90] + [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(lexicon, rng.integers(1, 60))) for _ in range(300)]
    texts += ["", None, "--- !!", "One-two,three\tfour\n" * 40, texts[0], "long " * 300_000, "y" * 3_000_000]
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    target = documents(spark, [(1, "the tail of w1 w2 w3", None), (2, None, None), (3, "", None)])
    wanted = plain_draw(rows, plain_weights(texts, ["the tail of w1 w2 w3"]))
    for head in (0, 5, 1 << 16):
        got = resample.resampled(documents(spark, rows).repartition(5), target, head=head)
        assert sorted(tuple(r) for r in got.select("id", "n_features", "weight", "score", "rank").collect()) == wanted
    nobody = documents(spark, [])
    assert resample.resampled(nobody, target).count() == 0
    assert {r["weight"] for r in resample.resampled(documents(spark, [(1, "", None), (1, None, None)]), nobody).collect()} == {0}
    # A null id, ids given twice, equal texts: rows of their own, the null id last among equal scores.
    odd = documents(spark, [(None, "a b " * 20, None), (4, "a b " * 20, None), (4, "a b " * 20, None)])
    assert sorted(r["rank"] for r in resample.resampled(odd, target, percent=100).collect()) == [1, 2, 3]


def test_resampling_reads_bytes_that_are_no_text(spark):
    raw = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61FF62') AS STRING) AS text")
    assert resample.resampled(raw, raw).select("n_words", "n_features").first() == (1, 1)


def test_resampling_query_equals_its_plain_version(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()
    target = [r["text"] for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op11_resampling"](spark, sf001).collect())
    assert got == plain_draw(docs, plain_weights([r["text"] for r in docs], target))


def plain_audit(rows, labels):
    def mask(id_, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        return (
            (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
            + 8 * bool(re.search(r"[#$%&*|]", text)) + 16 * any(id_ is not None and i is not None and i < id_ and (t or "") == text for i, t, _ in rows)
        )

    facts = [(lang or "", mask(i, t or ""), any(d == i and q == 1 for d, q, _ in labels if d is not None), any(d == i and x == 1 for d, _, x in labels if d is not None)) for i, t, lang in rows]
    out = {}
    for part in {f[0] for f in facts}:
        mine, shapley = [f for f in facts if f[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            before = 0
            for step, f in enumerate(order):
                bit = 1 << "ABCDE".index(f)
                here = [x for x in mine if x[1] & bit and not x[1] & before]
                gone = sum(1 for x in mine if x[1] & bit and x[1] & before)
                before |= bit
                shapley[f] += len(here)
                out[part, "".join(order), step + 1] = [
                    sum(1 for x in mine if not x[1] & before), len(here), gone, sum(1 for x in mine if x[1] == bit),
                    sum(x[2] for x in here), sum(x[3] for x in here), f,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]]
    return out


def test_filter_audit_equals_its_plain_version(spark, monkeypatch):
    monkeypatch.setattr(interactions, "BUCKET_ROWS", 20)
    lexicon = [f"w{k}" for k in range(300)] + ["Cap", "R&D", "SHOUT", "#"]
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(lexicon[: rng.integers(20, 304)], rng.integers(1, 400))) for _ in range(60)]
    rows = [(k, t, ["en", "de", None][k % 3]) for k, t in enumerate(texts)]
    rows += [(100 + k, texts[k % 3], "en") for k in range(30)]  # copies
    rows += [(200, None, "en"), (201, "", ""), (201, "", "de"), (None, texts[0], "de"), (None, None, None), (5, texts[9], "en"), (202, "X" * 500_000, "fr")]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 120, 2)] + [(4, None, 1), (4, 1, 0), (None, 1, 1), (999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    wanted = plain_audit(rows, labels)
    for many in (5, 10_000):
        monkeypatch.setattr(interactions.later_copies, "__defaults__", (many,))
        found = interactions.interactions(documents(spark, rows), marks, F.col("lang")).collect()
        assert {tuple(r)[:3]: list(r)[3:] for r in found} == wanted
    assert len(wanted) == 600 * 4
    assert interactions.interactions(documents(spark, []), marks, F.col("lang")).count() == 0


def test_filter_audit_query_equals_its_sql(spark, sf001):
    assert differences(QUERIES["op12_filters"](spark, sf001), duck(sf001), SQL["op12_filters"]) == []


def test_relations_are_joined_without_a_shuffle(spark):
    rows = spark.range(1000).select(F.col("id").alias(interactions.KEY), F.lit("p").alias("part"))
    relations = interactions.Relations(spark, 1000)
    relations.buckets = 4
    a, b = relations.store(rows, "a"), relations.store(rows.where("__key % 3 = 0"), "b")
    joined = spark.sql(f"SELECT /*+ MERGE({b}) */ * FROM {a} LEFT ANTI JOIN {b} USING (__key)")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 666
    relations.drop()


def train(spark, texts, shape=maxent.Shape(4, 4, 64, 64), **settings):
    docs = documents(spark, [(k, t, None) for k, t in enumerate(texts)])
    counts = maxent.token_counts(docs)
    return docs, counts, maxent.trained(docs, maxent.untrained(counts, shape), **settings)


def test_more_equal_counts_than_the_head_holds_are_all_known(spark):
    """No token is in the head then: their counts come from the join alone."""
    docs = documents(spark, [(1, "a b c d", None), (2, "a x", None)])
    counts = maxent.token_counts(docs.where("doc_id = 1"))
    model = maxent.untrained(counts, maxent.Shape(4, 4, 64, 64), head=3)
    assert len(model.counts) == 0
    found = {r["id"]: r for r in maxent.scored(docs, model, counts).collect()}
    base = math.log10(5 + 0.5 * 6)
    assert (found[1]["n_known"], found[2]["n_known"]) == (5, 2)
    assert found[1]["base_score"] == pytest.approx(5 * (math.log10(1.5) - base), abs=1e-12)
    assert found[2]["base_score"] == pytest.approx(2 * math.log10(1.5) + math.log10(0.5) - 3 * base, abs=1e-12)


def test_probabilities_of_all_tokens_add_up_to_one(spark):
    shipped(spark)
    texts = ["a b c a b d e f g", "b c a a a", "h i j k l m n o p q r s t u v w x y z", None, ""] * 4
    _, _, model = train(spark, texts)
    shape, n = model.shape, len(model.counts)
    other_tokens, other_types = model.other_tokens
    for context in ([], [0], [3, 1], [2, 2, 5], [n, 1]):
        total = 0.0
        for token in range(n + 1):  # the last one: any token not seen
            ids = np.array([*context, token])
            p = math.exp(maxent.predict(model, ids, np.arange(len(ids)) == 0)[-1])
            if token >= shape.vocabulary:
                c = int(model.counts[token]) if token < n else 0
                p *= (c + 0.5) / (other_tokens + 0.5 * (other_types + 1))
            total += p
        assert total == pytest.approx(1, abs=1e-4)


def test_unseen_tokens_of_a_small_vocabulary(spark):
    docs, counts, model = train(spark, ["a b", "a"], maxent.Shape(4, 4, 64, 64))
    found = maxent.scored(documents(spark, [(1, "never", None)]), model, counts).first()
    # One end is known; the unseen word takes the half count of the last class.
    assert found["n_known"] == 1 and -6 < found["score"] < -0.5


def test_scores_do_not_depend_on_batches_and_base_is_exact(spark, monkeypatch):
    texts = ["The cat sat on the mat", "the dog sat on a log " * 30, None, "", "Zz " + "q" * 100 + " new", "the cat " * 40_000, "x" * 200_000]
    docs, counts, model = train(spark, texts[:4] * 3)
    everything = documents(spark, [(k, t, None) for k, t in enumerate(texts)] + [(0, texts[1], None), (None, texts[0], None)])
    whole = {tuple(r) for r in maxent.scored(everything, model, counts).collect()}
    token = Counter(w for t in texts[:4] * 3 for w in [*(t or "").lower().split(), ""])
    n, v = token.total(), len(token)
    for id_, n_tokens, n_known, train_tokens, base, _ in whole - {x for x in whole if x[0] in (None, 0)}:
        words = [*(texts[id_] or "").lower().split(), ""]
        assert (n_tokens, n_known, train_tokens) == (len(words), sum(w in token for w in words), n)
        assert base == pytest.approx(sum(math.log10((token[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
    monkeypatch.setattr(maxent, "PIECE", 50)
    again = {r["id"]: r["score"] for r in maxent.scored(everything.where("id = 'x' and doc_id > 0").repartition(3), model, counts).collect()}
    assert again == pytest.approx({r[0]: r[5] for r in whole if r[0]})
    # Tokens beyond a small head meet their counts in a join.
    small = maxent.untrained(counts, maxent.Shape(2, 2, 8, 8), head=3)
    few = {(r["id"], r["n_known"]): r["base_score"] for r in maxent.scored(everything, small, counts).collect() if r["id"]}
    assert few == pytest.approx({(r[0], r[2]): r[4] for r in whole if r[0]})


def test_nothing_to_learn_from(spark):
    docs, counts, model = train(spark, [])
    found = maxent.scored(documents(spark, [(1, "a b", None)]), model, counts).first()
    assert (found["n_tokens"], found["n_known"], found["train_tokens"]) == (3, 0, 0)
    assert found["score"] == pytest.approx(0, abs=1e-6) and found["base_score"] == pytest.approx(0)
    assert maxent.scored(docs, model, counts).count() == 0


def test_bytes_that_are_no_text_are_scored(spark):
    raw = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61FF20FF62') AS STRING) AS text")
    counts = maxent.token_counts(raw)
    assert maxent.scored(raw, maxent.untrained(counts), counts).first()["n_known"] == 3


def test_training_beats_frequencies_on_texts_kept_apart(spark, sf001):
    found = QUERIES["op13_maxent"](spark, sf001).groupBy("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).collect()
    per_token = {r[0]: (r[1] / r[3], r[2] / r[3]) for r in found}
    assert all(score > base + 0.02 for score, base in per_token.values())
