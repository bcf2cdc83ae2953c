"""BPE, SimHash, line dedup, language, quality and rules, licences: against plain versions and odd rows."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkboard.llm import bpe, langid, licences, lines, quality, rules, simhash, stats
from sparkboard.llm.queries import labelled_part, language_model, remainder, tokenizer_file
from sparkboard.llm.shared import shipped

LONG = " ".join(f"w{k % 700} v{k % 11}" for k in range(30_000))
ODD = [
    (1, "The first line is long enough to count here.\nAnd a second one.\n\nend"),
    (2, "Something else.\nThe first line is long enough to count here.\nAnd a second one."),
    (3, None), (4, ""), (5, " \t\n "), (6, LONG), (7, LONG + " x"),
    (8, "The first line is long enough to count here.\nAnd a second one.\n\nend"),
    (8, "The first line is long enough to count here.\nAnd a second one.\n\nend"),
    (9, "a b c d e f g h " * 9 + "\nÉté Σίσυφος <|endoftext|> 中文 ☃ 12"), (None, "no id, but words"), (10, "123 456 !!"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named as the operators name theirs."""
    shipped(spark)
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for name in ("id", "t", "w", "h", "d", "i", "a", "fp", "component", "rank", "__runs2", "n_chars"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark, sf001):
    shipped(spark)
    return spark.read.parquet(f"{sf001}/documents.parquet")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def test_bpe_equals_the_library(docs, odd, none, reference):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + ODD
    want = []
    for i, text in rows:
        ids = reference.encode(text or "", add_special_tokens=False).ids
        shown = reference.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), brute.sha(brute.ids_bytes(ids)), brute.sha(shown.encode())))
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = [tuple(r) for r in bpe.encoded_digests(both, tokenizer_file()).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.encoded_digests(none, tokenizer_file()).count() == 0


def test_bpe_emits_long_words_in_windows(reference):
    t, rng = bpe.load(tokenizer_file()), random.Random(4)
    parts = [s for s in t.vocab if s.isascii() and s.isalpha()]
    for _ in range(60):
        word = rng.choice("abeinrt") * rng.randint(0, 900) + "".join(rng.choice(parts) for _ in range(rng.randint(1, 900)))
        ids = np.frombuffer(b"".join(t.encode(word)), "<u4").tolist()
        assert ids == reference.encode(word, add_special_tokens=False).ids


def test_lookahead_is_sufficient_for_small_merge_lists():
    rng = random.Random(1)
    for _ in range(200):
        signs, merges = list("abc"), []
        while len(merges) < 8:
            pair = rng.choice(signs), rng.choice(signs)
            if pair not in merges and "".join(pair) not in signs:
                merges.append(pair)
                signs.append("".join(pair))
        vocab = {s: k for k, s in enumerate(signs)}
        m = bpe.Merges(vocab, merges, "abc")
        for _ in range(20):
            word = [vocab[rng.choice("abc")] for _ in range(rng.randint(1, 6 * m.full))]
            assert list(m.stream(word)) == m.tokens(word[:])


def test_decoder_gives_readable_text_piece_by_piece(reference):
    t = bpe.load(tokenizer_file())
    ids = reference.encode("hello wörld ☃ x", add_special_tokens=False).ids
    d = bpe.Decoder(t)
    assert "".join(d.readable([i]) for i in ids) + d.readable([], last=True) == "hello wörld ☃ x "


def test_simhash_equals_all_pairs(docs, odd, none):
    both = docs.select("doc_id", "text").where("doc_id >= 100").unionByName(odd.select("doc_id", "text"))
    rows = [tuple(r) for r in both.collect()]
    prints = [brute.fingerprint(t) for _, t in rows]
    bits = np.array(prints, np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4
    low = brute.smallest_of_class([i if i is not None else 10**9 for i, _ in rows], lambda a, b: near[a, b])
    got = simhash.near_duplicates(both).withColumn("x", simhash.hexadecimal()).collect()
    want = [(i, f"{p:016x}", None if c == 10**9 else c) for (i, _), p, c in zip(rows, prints, low)]
    assert sorted(((r["id"], r["x"], r["component"]) for r in got), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(none).count() == 0


def test_vantage_point_trees_lose_no_pair(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    fps = [base, rng.integers(0, 2**64, 3000, dtype=np.uint64)]
    for _ in range(6):  # near copies of a few, and a dense group
        flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3, 300), dtype=np.uint64), axis=0)
        fps.append(np.where(np.arange(300) % 3 == 0, base[0], base) ^ flips)
    fps = np.unique(np.concatenate(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    signed = fps.view(np.int64)
    shipped(spark)
    table = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    got = {r["fp"]: r["component"] for r in simhash.near_classes(table, leaf=64).collect()}
    label = np.arange(len(fps))
    from sparkboard.llm.links import Forest

    forest = Forest(len(fps))
    forest.join(*np.nonzero(near))
    label = forest.label
    groups = {}
    for k, x in enumerate(signed.tolist()):
        groups.setdefault(label[k], set()).add(got[x])
    assert all(len(g) == 1 for g in groups.values()) and len(set(got.values())) == len(groups)


def test_one_of_each_group_stays(odd):
    kept = sorted((r["doc_id"] for r in simhash.one_of_each(odd).collect()), key=repr)
    # 3, 4 and 5 have no words; 7 is nearly 6; 8 equals 1.
    assert kept == sorted([1, 2, 3, 6, 9, 10, None], key=repr)
    assert simhash.one_of_each(odd).columns == odd.columns


def test_lines_equal_all_blocks(docs):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    want, _ = brute.deduped(rows)
    assert {r["doc_id"]: r["text"] for r in lines.without_repeats(docs).collect()} == want


def test_lines_of_odd_rows(odd, none):
    got = lines.without_repeats(odd, counts="n")
    assert got.columns == [*odd.columns, "n"]
    found = {}
    for r in got.collect():
        found.setdefault(r["doc_id"], []).append((r["text"], r["n"]["n_lines"], r["n"]["n_removed"]))
    assert found[1] == [(ODD[0][1], 3, 0)]
    assert found[2] == [("Something else.", 3, 2)]
    assert found[3] == [(None, 0, 0)] and found[4] == [("", 0, 0)] and found[5] == [(" \t\n ", 0, 0)]
    assert found[8] == [("", 3, 3), ("", 3, 3)]  # one document, a copy of 1
    assert found[6][0][0] == LONG
    assert lines.without_repeats(none).count() == 0


def test_language_on_held_out_documents(docs, odd, none):
    model = language_model(docs)
    got = langid.identified(docs, model).withColumnRenamed("id", "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    wrong, n = got.where(remainder(4) == 2).agg(F.sum((F.col("lang_pred") != F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 200 and wrong <= 0.02 * n
    found = {r["id"]: (r["lang_pred"], r["score"]) for r in langid.identified(odd, model).collect()}
    assert all(found[i] == ("und", 0.0) for i in (3, 4, 5, 10)) and found[6][0] != "und"
    assert langid.identified(none, model).count() == 0
    assert langid.accepted(odd, model).columns == odd.columns


def test_language_stage_rejects_letterless_texts_only(spark, docs):
    texts = [(1, "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. " * 3), (2, "xqzv kjwq pfhg zzxk " * 20), (3, "12 345 -- !!"), (4, "")]
    got = langid.accepted(spark.createDataFrame(texts, "doc_id long, text string"), language_model(docs))
    assert {r["doc_id"] for r in got.collect()} == {1, 2}  # as the docstring says


def test_language_model_of_nothing(none):
    model = langid.train(none.withColumn("lang", F.lit("en")))
    assert model.predict(langid.buckets("words")) == ("und", 0.0)


def test_ngrams_do_not_depend_on_blocks(monkeypatch):
    text = "Eins zwei, drei! " * 50 + "über 12 x"
    whole = langid.buckets(text)
    for size in (7, 64, 100):
        monkeypatch.setattr(langid, "AT_ONCE", size)
        assert (langid.buckets(text) == whole).all()


def test_statistics_equal_counting(docs, odd):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = sorted(((r["id"], *(r[n] for n in names)) for r in stats.statistics(both).collect()), key=repr)
    assert got == sorted(((r["doc_id"], *brute.statistics(r["text"])) for r in both.collect()), key=repr)
    assert stats.statistics(odd).count() == len(ODD)


@pytest.fixture(scope="module")
def known(spark, sf001):
    shipped(spark)
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    labels = spark.read.parquet(f"{sf001}/labels.parquet")
    return stats.statistics(docs).cache(), labels


def test_quality_on_held_out_documents(known):
    counts, labels = known
    x, y = rules.labelled(counts, labelled_part(labels), "quality")
    model = quality.trained(x, y)
    scored = counts.select("id", model.column().alias("score"))
    held = labels.where(remainder(5) == 0).withColumnRenamed("doc_id", "id").join(scored, "id").collect()
    right = [(r["score"] >= 0.3) == (r["quality"] == 1) for r in held]
    assert len(held) > 30 and np.mean(right) >= 0.95
    # The expression and the model agree.
    sample = sorted(counts.select("id", model.column().alias("s"), *[c.alias(n) for n, c in stats.features().items()]).collect())[:200]
    again = model.score({n: np.array([r[n] for r in sample]) for n in stats.features()})
    assert np.allclose([r["s"] for r in sample], again)


def test_rules_keep_good_and_drop_bad_documents(known):
    counts, labels = known
    learned = rules.learned(*rules.labelled(counts, labelled_part(labels), "quality"))
    held = rules.judged(counts, learned).join(labels.withColumnRenamed("doc_id", "id"), "id").where("not base_failed")
    right, n = held.agg(F.sum((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert learned and right >= 0.97 * n


def test_models_of_one_label_or_none(odd):
    counts = stats.statistics(odd)
    empty = rules.labelled(counts, odd.where("false").select(F.col("doc_id").alias("id"), F.lit(1).alias("quality")), "quality")
    assert rules.learned(*empty) == [] and quality.trained(*empty).rules == ()
    ones = {n: np.arange(5.0) for n in stats.features()}, np.ones(5, int)
    assert rules.learned(*ones) == [] and quality.trained(*ones).bias > 0
    judged = rules.judged(counts, []).collect()
    assert all(r["kept"] != r["base_failed"] for r in judged) and len(judged) == len(ODD)


def test_licences_are_found_and_talk_is_not(spark, docs, odd, none):
    scanner = licences.trained(docs, rows=300)
    texts = [
        (1, "Intro\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "Distributed and licensed under the MIT License, see below"),
        (3, "he renewed his driving license at the public office"), (4, None), (5, "SPDX-License-Identifier: GPL-3.0-only"),
        (6, "This work is licensed under the GNU General Public License, version 3."), (7, "Licensed under CC BY-NC 4.0."),
    ]
    got = licences.scanned(spark.createDataFrame(texts, "doc_id long, text string"), scanner).where("family <> 'unknown'").collect()
    assert {(r["id"], r["line"], r["family"]) for r in got} == {
        (1, 1, "apache-2.0"), (2, 0, "mit"), (5, 0, "gpl-3.0"), (6, 0, "gpl-3.0"), (7, 0, "cc-by-nc")
    }
    for r in got:  # the plan and the model agree
        assert abs(scanner.probabilities(licences.tokens(r["notice"]))[:-1].max() - r["probability"]) < 1e-6
    assert licences.scanned(odd, scanner).count() == 0 and licences.scanned(none, scanner).count() == 0


def test_reserved_rights_are_a_family(spark, docs):
    scanner = licences.trained(docs, rows=300)
    planted = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line").rlike(r"^All rights reserved\.?$")).distinct().count()
    assert planted > 0
    got = licences.scanned(docs, scanner).where("family = 'proprietary'").select("id").distinct().count()
    assert got >= planted
    texts = [(1, "Copyright 2021 Example Ltd. All rights reserved."), (2, "CONFIDENTIAL AND PROPRIETARY"), (3, "Released under the MIT License. All rights reserved."), (4, "all seats were taken, tables reserved")]
    got = licences.scanned(spark.createDataFrame(texts, "doc_id long, text string"), scanner).collect()
    assert {(r["id"], r["family"]) for r in got} == {(1, "proprietary"), (2, "proprietary"), (3, "mit")}


def test_wrapped_notices_are_found(spark, docs):
    scanner = licences.trained(docs, rows=300)
    headers = {
        "bsd": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:",
        "gpl-3.0": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
        "gpl-2.0": "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.",
        "isc": "// Permission to use, copy, modify, and/or distribute this software\n// for any purpose with or without fee\n// is hereby granted, provided that the above notice appears in all copies.",
        "mit": "Permission is hereby granted, free of charge,\nto any person obtaining a copy\nof this software and associated\ndocumentation files (the Software), to deal",
    }
    texts = [(k, f"/*\n *\n{h}\n *\n */\nint main") for k, h in enumerate(headers.values())]
    texts.append((9, "\n".join("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files".split())))
    got = [r for r in licences.scanned(spark.createDataFrame(texts, "doc_id long, text string"), scanner).collect() if r["family"] != "unknown"]
    assert [(r["id"], r["family"]) for r in sorted(got)] == [*enumerate(headers), (9, "mit")]
    for r in got:
        lines = dict(texts)[r["id"]].split("\n")
        assert r["notice"] == "\n".join(lines[r["line"]:r["last_line"] + 1]) and r["last_line"] > r["line"]


def test_anchors_lose_no_notice():
    words = set(licences.anchors(0.6, set()))
    for notice in (n for f in licences.NOTICES.values() for n in f):
        grams = licences.ngrams(licences.tokens(notice))
        assert sum(not words & set(g.split()) for g in grams) < 0.6 * len(grams)
