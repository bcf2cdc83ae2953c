"""Embeddings, mixing, pages, the pipeline and the registered queries."""

import brute
import numpy as np
import pandas as pd
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from sparkboard.llm import html, mixing, vectors
from sparkboard.llm.queries import MIX_POWERS, QUERIES, SQL, margins
from sparkboard.llm.shared import shipped


def linked(rows, cosine=0.9):
    """(links, smallest id reachable) by all pairs, for rows with an id."""
    def unit(v):
        a = np.array([np.nan if x is None else x for x in v or []], float)
        n = np.linalg.norm(a)
        return a / n if len(a) and np.isfinite(a).all() and n > 0 else None

    units = [unit(v) for _, v in rows]

    def near(a, b):
        u, w = units[a], units[b]
        if u is None or w is None:
            return False
        k = min(len(u), len(w))
        return float(u[:k] @ w[:k]) >= cosine

    n = len(rows)
    links = [sum(near(a, b) for b in range(n) if a != b) for a in range(n)]
    return links, brute.smallest_of_class([i for i, _ in rows], near)


def test_vectors_equal_all_pairs(spark, monkeypatch):
    shipped(spark)
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 6))
    rows = [(k, (base[k % 40] + 0.25 * rng.standard_normal(6)).astype(np.float32).tolist()) for k in range(700)]
    rows += [(700 + k, rows[3][1]) for k in range(30)]  # one very common vector
    rows += [(730, [2 * x for x in rows[5][1]]), (731, None), (732, []), (733, [0.0] * 6), (734, [1.0, None] + [0.0] * 4)]
    rows += [(735, [float("nan")] * 6), (736, [float("inf")] + [1.0] * 5), (737, rows[8][1][:4]), (738, rows[9][1])]
    links, low = linked(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("item", F.lit("x")).withColumn("shard", F.lit(1))
    for cell, tile, cells in ((4096, 8192, None), (32, 50, True), (32, 100, False)):
        monkeypatch.setattr(vectors, "TILE", tile)
        got = {r["id"]: (r["n_links"], r["component"]) for r in vectors.near_duplicates(table, cell=cell, cells=cells).collect()}
        assert got == {i: (n, c) for (i, _), n, c in zip(rows, links, low)}
    assert vectors.near_duplicates(table.where("false")).count() == 0
    lost = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in vectors.near_duplicates(lost).collect()} == {(None, 0, None), (1, 0, 1)}


def test_rows_which_repeat_an_id_with_other_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for cells in (True, False):
        got = sorted(tuple(r) for r in vectors.near_duplicates(table, cell=1, cells=cells).collect())
        assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_cells_are_used_where_they_pay():
    rng = np.random.default_rng(3)
    spread = rng.standard_normal((2000, 64)).astype(np.float32)
    corners = np.where(rng.random((8, 64)) < 0.5, -1, 1)
    gathered = (corners[rng.integers(8, size=2000)] + 0.01 * rng.standard_normal((2000, 64))).astype(np.float32)
    assert not vectors.Blocks(64, 0.9, 4, 6, spread).pays(spread, 16)
    assert vectors.Blocks(64, 0.9, 4, 2, gathered).pays(gathered, 16)


def test_mixing_reaches_its_targets(spark):
    cells = spark.createDataFrame(
        [("a", "x", 900), ("a", "y", 50), ("b", "x", 30), ("b", "y", 20), ("c", "x", 7), ("d", "y", 0)], "s string, l string, tokens long"
    )
    targets = {
        "s": spark.createDataFrame([("a", 1.0), ("b", 1.0), ("none here", 5.0)], "s string, target double"),
        "l": spark.createDataFrame([("x", 3.0), ("y", 1.0)], "l string, target double"),
    }
    got = mixing.raked(cells, targets, rounds=25).toPandas()
    got["t"] = got.weight * got.tokens
    by = lambda m: got.groupby(m).t.sum() / got.t.sum()
    assert np.allclose(by("s")[["a", "b", "c", "d"]], [0.5, 0.5, 0, 0], atol=1e-6)
    assert np.allclose(by("l")[["x", "y"]], [0.75, 0.25], atol=1e-6)


def test_mixing_of_odd_rows(spark):
    rows = [(1, "one two", "en", "s"), (2, None, "en", "s"), (3, "", None, None), (None, "three words here", "de", None), (5, "x " * 50_000, "de", "s")]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, source string").withColumn("weight", F.lit("w")).withColumn("tokens", F.lit(1))
    got = mixing.mixed(docs, margins(), MIX_POWERS)
    assert got.columns == [*docs.columns, "mix"]
    found = got.collect()
    assert len(found) == 6 and {r["doc_id"]: r["mix"]["n_tokens"] for r in found} == {1: 2, 2: 0, 3: 0, None: 3, 5: 50_000}
    assert all(r["mix"]["probability"] == 0 and not r["mix"]["kept"] for r in found if r["mix"]["n_tokens"] == 0)
    assert max(r["mix"]["probability"] for r in found) == 1.0
    assert mixing.mixed(docs.where("false"), margins(), MIX_POWERS).count() == 0


def test_rare_categories_do_not_drop_the_corpus(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [(-1, "three words here", "en", None), (-2, "three words here", None, "src0"), (-3, "word " * 300, "en", "new"), (-4, "drei Worte hier", "xx", "src0")]
    odd = spark.createDataFrame(rows, docs.schema)
    plain = mixing.mixed(docs, margins(), MIX_POWERS).where("mix.kept").count()
    assert plain > 500 and corpus_pipeline.mix(spark, docs.unionByName(odd), sf001).count() > 0.9 * plain
    # The others' shares are still the targets, the rare ones' their own.
    cells = spark.createDataFrame([("a", 90_000), ("b", 10_000), ("c", 10), (mixing.MISSING, 50_000)], "s string, tokens long")
    got = {r["s"]: r["target"] for r in mixing.lenient(cells, "s", 0.5, 0.01).collect()}
    assert np.isclose(got["a"] / got["b"], 3) and np.isclose(got["c"] / sum(got.values()), 10 / 150_010) and np.isclose(got[mixing.MISSING] / sum(got.values()), 50_000 / 150_010)
    assert mixing.lenient(cells.where(F.col("s") == mixing.MISSING), "s", 0.5, 0.01).count() == 1


ARTICLE = "".join(f"<p>Paragraph {k}, which is of some length, with commas, and goes on.</p>" for k in range(4))
TEXT = " ".join(f"Paragraph {k}, which is of some length, with commas, and goes on." for k in range(4))


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<html></html>", ""), ("a &lt; b\n &amp; c", "a < b & c"),
        (f"<body><nav><a href=x>Home</a></nav><article><h1>T</h1>{ARTICLE}</article><footer>f</footer></body>", "T " + TEXT),
        (f"<div class='topbar'>menu</div><div id=content><h2>T</h2>{ARTICLE}</div><div class=sidebar><p>Long, long, long, long text, aside</p></div>", "T " + TEXT),
        (f"<main><div>{ARTICLE}</div><section class='comments'><p>I, a reader, have much, very much, to say, here, too</p></section></main>", TEXT),
        (f"<form><div class='post'>{ARTICLE}</div></form>", TEXT),
        (f"<article>{ARTICLE}<aside>ad</aside><script>if (a < b) '</p>'</script><!-- <p>no</p> --></article><article class='comment'><p>reply, reply</p></article>", TEXT),
        ("<article><p><b>Bold<br><p>One<i>two</i> three&nbsp;\n four<ul><li>a<li>b</ul></article>", "Bold Onetwo three four a b"),
        ("<article><p>short</p></article><div class=ad>a much longer advertisement, with commas, and more, and more</div>", "short"),
        ("<table><tr><td>x<td>y<tr><td>z</table>", "x y z"), ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"), ("<<<p>x</", "<< x</"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_long_and_deep_pages_are_read_whole():
    body = "".join(f"<p>word{k}</p>" for k in range(50_000))
    assert html.main_text(f"<article>{body}</article>").split() == [f"word{k}" for k in range(50_000)]
    assert html.main_text("<div>" * 5000 + "deep") == "deep"


def test_pages_keep_their_columns(spark):
    shipped(spark)
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (2, None, None, "y"), (1, "u", "<p>a</p>", "x")], "page_id long, url string, html string, text string")
    got = html.extracted(pages)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", "a", 1), (2, None, "", 0), (1, "u", "a", 1)], key=repr)
    assert html.extracted(pages.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf001, name):
    assert differences(QUERIES[name](spark, sf001), duck(sf001), SQL[name]) == []


def test_queries_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 11)}


def test_pipeline_equals_its_plain_version(spark, sf001):
    import duckdb
    from tokenizers import Tokenizer

    from sparkboard.llm.queries import tokenizer_file

    table = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{sf001}/documents.parquet'").fetchall()
    docs = {i: (t, lang, s) for i, t, lang, s in table if t and any(c.isalpha() for c in t)}
    texts, empty = brute.deduped({i: d[0] for i, d in docs.items()})
    ids = sorted(i for i in docs if i not in empty)
    bits = np.array([brute.fingerprint(texts[i]) for i in ids], np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4
    low = brute.smallest_of_class(ids, lambda a, b: near[a, b])
    left = pd.DataFrame([(i, texts[i], *docs[i][1:]) for i, c in zip(ids, low) if i == c], columns=["doc_id", "text", "lang", "source"])
    con = duckdb.connect()
    con.register("documents", left)
    sql = mixing.mixed_sql({"source": "source", "lang": "lang", "topic": mixing.TOPIC_SQL}, MIX_POWERS)
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({sql}) WHERE kept").fetchall()}
    reference = Tokenizer.from_file(tokenizer_file())
    want = {i: reference.encode(texts[i], add_special_tokens=False).ids for i in kept}
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, sf001).collect()}
    assert got == want


def test_raking_ends_when_the_margins_hold(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 300), ("b", "x", 50), ("b", "y", 20), ("c", "x", 0)], "s string, l string, tokens long")
    targets = {"s": spark.createDataFrame([("a", 1.0), ("b", 1.0)], "s string, target double"), "l": spark.createDataFrame([("x", 3.0), ("y", 1.0)], "l string, target double")}
    short, long = (mixing.raked(cells, targets, rounds=n).toPandas().set_index(["s", "l"]).sort_index() for n in (1, 200))
    # One round fits the last margin alone; enough of them fit all, and more would change nothing.
    assert short["departure"].nunique() == 1 and short["departure"].iloc[0] > 1e-3 and long["departure"].iloc[0] <= 1e-12
    has = long["weight"] * long["tokens"]
    assert np.allclose(has.groupby("s").sum()[["a", "b"]], has.sum() / 2) and np.allclose(has.groupby("l").sum()[["x", "y"]], has.sum() * np.array([0.75, 0.25]))
    # Targets no weights can meet: "b" has tokens in x alone, and x shall have less than "b".
    against = {"s": spark.createDataFrame([("a", 1.0), ("b", 9.0)], "s string, target double"), "l": spark.createDataFrame([("x", 1.0), ("y", 9.0)], "l string, target double")}
    assert mixing.raked(cells.where("s <> 'b' or l = 'x'"), against, rounds=5).first()["departure"] > 0.1
    assert mixing.raked(cells.where("false"), targets).count() == 0
