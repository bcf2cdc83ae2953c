"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is a word boundary, and the n-grams inside and at the edges of
words are hashed into a fixed number of buckets. Training counts buckets per language with one Spark
aggregation; the model, a matrix of log-probabilities (languages x buckets), is broadcast; batches of
texts are scored as sparse counts times that matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkboard.llm.shared import column, dropped, saved, valid_text

UNKNOWN = "und"
BUCKETS = 1 << 14
SIZES = (1, 2, 3)
#: Characters handled at a time.
AT_ONCE = 1 << 18


class Letters:
    """For each code point, its lower-case letter or a space. Built once per worker."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, text: str) -> np.ndarray:
        if cls.table is None:
            table = np.full(0x110000, 32, np.uint32)
            for c in range(0x110000):
                sign = chr(c)
                if sign.isalpha():
                    low = sign.lower()
                    table[c] = ord(low) if len(low) == 1 else c
            cls.table = table
        return cls.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def buckets(text: str, n_buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES) -> np.ndarray | None:
    """How often each bucket is hit by the text's n-grams; None if it has no letter.

    An n-gram holds a letter and no boundary but at its ends, so white space and signs add nothing.
    """
    counts = None
    for at in range(0, len(text), AT_ONCE):
        # The characters before the block come again, for n-grams which end in it.
        back = min(at, max(sizes) - 1)
        signs = Letters.of(text[at - back:at + AT_ONCE])
        if at == 0:
            signs, back = np.concatenate([[32], signs]), 1
        if at + AT_ONCE >= len(text):
            signs = np.concatenate([signs, [32]])
        signs = signs.astype(np.uint64)
        letter = signs != 32
        if counts is None:
            if not letter.any():
                continue
            counts = np.zeros(n_buckets, np.int64)
        for size in sizes:
            first = max(0, back - size + 1)  # the first n-gram which ends in this block
            n = len(signs) - size + 1
            if n <= first:
                continue
            inner = range(1, size - 1) if size > 2 else range(size)
            good = np.logical_and.reduce([letter[k:k + n] for k in inner]) if size != 2 else letter[:n] | letter[1:1 + n]
            h = np.full(n, 1469598103934665603 + size, np.uint64)
            for k in range(size):
                h = (h ^ signs[k:k + n]) * np.uint64(1099511628211)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
            picked = h[first:][good[first:]] % np.uint64(n_buckets)
            counts += np.bincount(picked.astype(np.int64), minlength=n_buckets)
    return counts


@dataclass(frozen=True)
class Model:
    """Log-probabilities of buckets by language, `weights[bucket, language]`, and the smoothing they have."""

    languages: tuple[str, ...]
    weights: np.ndarray
    n_buckets: int
    sizes: tuple[int, ...]

    def predict(self, counts: np.ndarray | None) -> tuple[str, float]:
        """The likeliest language and its probability, every language as likely beforehand; of equal ones the first by name."""
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        hit = np.flatnonzero(counts)
        logs = counts[hit].astype(np.float64) @ self.weights[hit]
        best = int(np.argmax(logs))
        return self.languages[best], float(1.0 / np.exp(logs - logs[best]).sum())

    def fit(self, counts: np.ndarray | None) -> tuple[str, int, float, float] | None:
        """The likeliest language, the number of n-grams, and mean and variance of their log-probabilities in it."""
        if counts is None or not self.languages:
            return None
        hit = np.flatnonzero(counts)
        logs = counts[hit].astype(np.float64) @ self.weights[hit]
        best, n = int(np.argmax(logs)), int(counts[hit].sum())
        mean = logs[best] / n
        return self.languages[best], n, float(mean), float((counts[hit] * (self.weights[hit, best] - mean) ** 2).sum() / n)


@dataclass(frozen=True)
class Usual:
    """How well a language's own texts fit it: (mean, spread between texts, spread within a text, limit)."""

    of: dict[str, tuple[float, float, float, float]]

    def foreign(self, fit: tuple[str, int, float, float]) -> bool:
        """Whether a text fits its likeliest language worse than any text of that language should."""
        lang, n, mean, _ = fit
        if lang not in self.of:
            return False
        usual, between, within, limit = self.of[lang]
        return (usual - mean) / (between**2 + within**2 / n) ** 0.5 > limit


def train(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int | None = 4000,
    n_buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES, smoothing: float = 0.5,
) -> Model:
    """Learn from at most `per_language` texts of each language, those with the smallest hashes; from all with None.

    The bound is this parameter; rows with a null text or language are passed over. Copies of a text count
    once, for the bound and for the model. Bytes which are not UTF-8 are U+FFFD. Counts are added up per task before they meet, one
    row per task and language, each a vector of `n_buckets`.
    """
    picked = _learning_texts(docs, text_col, lang_col, per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                found = buckets(text.as_py(), n_buckets, sizes)
                if found is not None:
                    totals[lang.as_py()] = totals.get(lang.as_py(), 0) + found
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array([v.tobytes() for v in totals.values()], pa.binary())], ["lang", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for x in batch.column(1):
                total += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], ["lang", "counts"])

    summed = picked.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary")
    # One row per language.
    found = sorted((r["lang"], np.frombuffer(bytes(r["counts"]), np.int64)) for r in summed.collect())
    weights = np.zeros((n_buckets, len(found)))
    for k, (_, counts) in enumerate(found):
        weights[:, k] = np.log((counts + smoothing) / (counts.sum() + smoothing * n_buckets))
    return Model(tuple(lang for lang, _ in found), weights, n_buckets, sizes)


def _learning_texts(docs: DataFrame, text_col: str, lang_col: str, per_language: int | None) -> DataFrame:
    """(text, lang): the distinct texts which a model learns from."""
    rows = docs.select(valid_text(text_col).alias("text"), valid_text(lang_col).alias("lang")).dropna()
    if per_language is None:
        return rows.distinct()
    # The bound by a threshold on the hash, found per language from counts of hash ranges: no sort, no hot language.
    rows = rows.withColumn("whole", F.xxhash64("text", F.lit(5)))
    rows = rows.withColumn("h", F.pmod("whole", F.lit(1 << 16)).cast("int"))
    texts = rows.select("lang", "h", "whole").distinct()
    sizes_by = texts.groupBy("lang", "h").count().groupBy("lang").agg(F.sum("count").alias("n"), F.collect_list(F.struct("h", "count")).alias("by"))
    # Written, so that the planner knows its size: one row per language.
    reach = saved(sizes_by.select("lang", _threshold("by", per_language).alias("top")), "language-reach")
    return rows.join(reach, "lang").where("h <= top").select("text", "lang").distinct()


#: Languages with fewer texts of at least so many n-grams reject nothing.
FEWEST, LONG_ENOUGH = 30, 100
#: The spread between texts, in nats per n-gram, is taken to be this at least; the limit, in spreads, as well.
LEAST_SPREAD, LEAST_LIMIT = 0.1, 20.0


def usual_fits(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", per_language: int | None = 4000) -> Usual:
    """How the texts that the model was learned from fit their languages: a length-normalised measure.

    A text's departure is the mean log-probability of its n-grams below the language's mean, in spreads: that
    between texts, and that within a text over the root of its length, so that short texts have more room. The
    limit is twice the furthest departure of the language's own learned texts, `LEAST_LIMIT` at least: no
    learned text is rejected. One row per language comes to the driver.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            fits = [m.fit(buckets(t.as_py(), m.n_buckets, m.sizes)) for t in batch.column(0)]
            rows = [f[1:] for f, lang in zip(fits, batch.column(1)) if f is not None and f[0] == lang.as_py()]
            langs = [f[0] for f, lang in zip(fits, batch.column(1)) if f is not None and f[0] == lang.as_py()]
            n, mean, variance = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(n, pa.int64()), pa.array(mean, pa.float64()), pa.array(variance, pa.float64())],
                ["lang", "n", "mean", "variance"],
            )

    texts = _learning_texts(docs, text_col, lang_col, per_language)
    fits = saved(texts.mapInArrow(run, "lang string, n long, mean double, variance double"), "language-fits")
    long = F.col("n") >= LONG_ENOUGH
    spreads = fits.where(long).groupBy("lang").agg(
        F.count(F.lit(1)).alias("texts"), F.avg("mean").alias("usual"), F.greatest(F.stddev_pop("mean"), F.lit(LEAST_SPREAD)).alias("between"),
        F.sqrt(F.avg("variance")).alias("within"),
    ).where(F.col("texts") >= FEWEST)
    spreads = saved(spreads, "language-spreads")
    departure = (F.col("usual") - F.col("mean")) / F.sqrt(F.col("between") ** 2 + F.col("within") ** 2 / F.col("n"))
    furthest = fits.join(spreads, "lang").groupBy("lang", "usual", "between", "within").agg(F.max(departure).alias("furthest"))
    found = furthest.collect()
    dropped(fits, spreads)
    return Usual({r["lang"]: (r["usual"], r["between"], r["within"], max(2 * r["furthest"], LEAST_LIMIT)) for r in found})


def _threshold(by: str, rows: int):
    """The largest hash up to which a language has at most `rows` texts (at least its first range)."""
    ordered = F.array_sort(F.col(by))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("top"))
    return F.aggregate(
        ordered, start,
        lambda a, x: F.when(
            (a["n"] + x["count"] <= rows) | (a["top"] < 0), F.struct((a["n"] + x["count"]).alias("n"), x["h"].alias("top"))
        ).otherwise(F.struct(F.lit(1 << 60).cast("long").alias("n"), a["top"].alias("top"))),
        lambda a: a["top"],
    )


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row. A null text, or one without a letter, is `und` with score 0.

    Whole texts are scored. Other columns are not read; repeated rows each give a row.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            found = [m.predict(buckets(t.as_py() or "", m.n_buckets, m.sizes)) for t in batch.column(1)]
            lang, score = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(column(id_col).cast("long").alias("id"), valid_text(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", at_least: float = 0.5, usual: Usual | None = None) -> DataFrame:
    """The rows which are in a learned language, all columns as they were.

    Rejected are texts without a letter, those whose likeliest language has a probability below `at_least`
    (among the learned ones only, so that it goes to 1 with a text's length) and, with `usual`, those which fit
    that language far worse than its own texts: foreign prose and letter noise.
    """
    known = docs.sparkSession.sparkContext.broadcast((model, usual))

    @F.arrow_udf("boolean")
    def sure(texts: pa.Array) -> pa.Array:
        m, limits = known.value
        kept = []
        for t in texts:
            counts = buckets(t.as_py() or "", m.n_buckets, m.sizes)
            lang, score = m.predict(counts)
            kept.append(lang != UNKNOWN and score >= at_least and not (limits is not None and limits.foreign(m.fit(counts))))
        return pa.array(kept, pa.bool_())

    return docs.where(sure(valid_text(text_col)))
