"""The registered queries of this subpackage: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkboard.llm import bpe, html, interactions, langid, licences, lines, maxent, mixing, quality, resample, rules, simhash, stats, vectors
from sparkboard.llm.shared import saved, shipped


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file() -> str:
    """The public tokenizer's file where its package is installed, on every machine; never a copy."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, folder, "documents"), tokenizer_file(), readable=True).withColumnRenamed("id", "doc_id")


def op2_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    found = vectors.near_duplicates(table(spark, folder, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    )


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hexadecimal().alias("fingerprint"), F.col("component").alias("component_id"))


def op4_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.without_repeats(table(spark, folder, "documents"), counts="counts")
    return found.select("doc_id", "counts.n_lines", "counts.n_removed", "text")


#: The token shares of each margin are raised to these powers: large sources and languages give way.
MIX_POWERS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
#: Categories with less than this share of the largest one's tokens, and nulls, keep the share they have.
MIX_LEAST = 0.05


def margins() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic(F.col("text"))}


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mixed(table(spark, folder, "documents"), margins(), MIX_POWERS, least=MIX_LEAST)
    return found.select(
        "doc_id", "mix.source", "mix.lang", "mix.topic", "mix.n_tokens", F.round("mix.probability", 8).alias("probability"), "mix.kept"
    )


def remainder(n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


#: Texts of a language that op7 learns from, at most; the pipeline's model has no bound.
LEARNED_TEXTS = 4000


def language_model(docs: DataFrame, per_language: int | None = LEARNED_TEXTS) -> langid.Model:
    """Learned from the rows that are not held out; a null id's row is held out."""
    return langid.train(docs.where(remainder(4) != 2), per_language=per_language)


def language_fits(docs: DataFrame, model: langid.Model, per_language: int | None = LEARNED_TEXTS) -> langid.Usual:
    """How the documents the model is learned from fit their languages."""
    return langid.usual_fits(docs.where(remainder(4) != 2), model, per_language=per_language)


def labelled_part(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: of rows which are not held out."""
    return labels.where(remainder(5) != 0).withColumnRenamed("doc_id", "id")


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    counts = saved(stats.statistics(table(spark, folder, "documents")), "text-statistics")
    model = quality.trained(*rules.labelled(counts, labelled_part(table(spark, folder, "labels")), "quality"))
    scored = counts.select(F.col("id").alias("doc_id"), model.column().alias("score"))
    held_out = F.coalesce(remainder(5) == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.identified(docs, language_model(docs)).withColumnRenamed("id", "doc_id")
    held_out = F.coalesce(remainder(4) == 2, F.lit(True))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_rules(spark: SparkSession, folder: str) -> DataFrame:
    counts = saved(stats.statistics(table(spark, folder, "documents")), "text-statistics")
    learned = rules.learned(*rules.labelled(counts, labelled_part(table(spark, folder, "labels")), "quality"))
    return rules.judged(counts.withColumnRenamed("id", "doc_id"), learned).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_licences(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return licences.scanned(docs, licences.trained(docs)).withColumnRenamed("id", "doc_id")


def op10_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extracted(table(spark, folder, "pages"))


def op11_resampling(spark: SparkSession, folder: str) -> DataFrame:
    found = resample.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_filters(spark: SparkSession, folder: str) -> DataFrame:
    return interactions.interactions(table(spark, folder, "documents"), table(spark, folder, "labels"), F.col("lang"))


def op13_maxent(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(remainder(5) == 1, F.lit(True))
    learning = docs.where(~held_out)
    counts = maxent.token_counts(learning)
    found = maxent.scored(docs, maxent.trained(learning, maxent.untrained(counts)), counts).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe, op2_embeddings, op3_simhash, op4_lines, op5_mixing, op6_quality, op7_langid, op8_rules, op9_licences, op10_html,
        op11_resampling, op12_filters, op13_maxent,
    )
}
#: Every block of 1, 2, 4, ... lines by its text, instead of by ranks.
LINES_SQL = r"""
    WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
    s AS (SELECT *, [{'n': n, 't': trim(ls[n], ' ' || chr(9) || chr(11) || chr(12) || chr(13))}
                     for n in range(1, len(ls) + 1)
                     if trim(ls[n], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''] AS spoken
          FROM d WHERE text IS NOT NULL),
    b AS (SELECT doc_id, spoken, w, unnest(range(1, len(spoken) - w + 2)) AS i
          FROM s JOIN (SELECT CAST(pow(2, k) AS BIGINT) AS w FROM range(0, 24) AS r(k)) AS widths ON w <= len(spoken)),
    keyed AS (SELECT doc_id, w, i, spoken[i].n AS a, spoken[i + w - 1].n AS z, length(spoken[i].t) AS chars,
                  md5(array_to_string([x.t for x in spoken[i:i + w - 1]], chr(10))) AS key FROM b),
    later AS (SELECT *, row_number() OVER (PARTITION BY w, key ORDER BY doc_id, i) > 1 AS copy FROM keyed),
    gone AS (SELECT doc_id, list(DISTINCT n) AS ns
             FROM (SELECT doc_id, unnest(range(a, z + 1)) AS n FROM later WHERE copy AND (w > 1 OR chars >= 20)) AS u GROUP BY 1)
    SELECT d.doc_id, coalesce(len(spoken), 0) AS n_lines,
        coalesce(len([x for x in spoken if list_contains(ns, x.n)]), 0) AS n_removed,
        CASE WHEN ns IS NULL THEN d.text
             ELSE coalesce(array_to_string([s.ls[n] for n in range(1, len(s.ls) + 1) if NOT list_contains(ns, n)], chr(10)), '')
        END AS text
    FROM d LEFT JOIN s USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

#: All pairs, for small tables.
VECTORS_SQL = """
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    good AS (SELECT * FROM v WHERE len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0),
    links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good AS a JOIN good AS b
              ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
    reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach AS r JOIN links AS l ON r.y = l.x),
    classes AS (SELECT x AS vec_id, MIN(y) AS component_id FROM reach GROUP BY 1),
    counts AS (SELECT x AS vec_id, COUNT(*) AS n FROM links GROUP BY 1)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM classes LEFT JOIN counts USING (vec_id)
"""

SQL: dict[str, str] = {
    "op2_embeddings": VECTORS_SQL,
    "op4_lines": LINES_SQL,
    "op12_filters": interactions.interactions_sql(),
    "op5_mixing": mixing.mixed_sql({"source": "source", "lang": "lang", "topic": mixing.TOPIC_SQL}, MIX_POWERS, least=MIX_LEAST),
}
