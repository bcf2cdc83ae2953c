"""Importance resampling towards a target distribution, over hashed word and word-pair features.

A feature is a run of one or two consecutive words; its bucket is its CRC-32 modulo the number of buckets.
The vocabulary has a head and a tail. The head, the most frequent words of the corpus, is broadcast: each
word's bucket, the CRC state behind the word and a space (from which a pair's CRC goes on with the second
word), and the buckets of all pairs of its most frequent words. Features the head does not hold take the
CRC directly. Both ways give the same bucket, so the totals are exact and what is in the head decides
nothing but the speed. Rows get a random number by their id (Gumbel's distribution), so that the highest
scores are a sample by weight without replacement.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkboard.llm.shared import column, dropped, most_frequent, saved
from sparkboard.sources.csv import with_row_number

N_BUCKETS = 10_000
#: Words of the head (at most), and those of them whose pairs have their buckets in a table.
HEAD, PAIRED = 1 << 16, 1 << 10
#: Bytes of a word of the head at most, so that the broadcast is bounded; longer ones belong to the tail.
HEAD_BYTES = 64
#: Bytes of a text split at a time, and words a task counts before it passes them on.
PIECE, HELD = 1 << 20, 1 << 18

#: A-Z as a-z; what is neither a digit, a letter nor beyond ASCII as a space.
SIGNS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in lists from about `size` bytes each. Bytes which are not UTF-8 count as they are."""
    at = 0
    while at < len(text):
        # Cut after the first sign between words from here on.
        end = at + size
        while end < len(text) and SIGNS[text[end - 1]] != 0x20:
            end += 1
        yield text[at:end].translate(SIGNS).split()
        at = end


class Buckets:
    """The buckets of features, from the tables of the head where it has them."""

    def __init__(self, head: list[bytes], n_buckets: int = N_BUCKETS, paired: int = PAIRED) -> None:
        self.n = n_buckets
        self.place = {word: k for k, word in enumerate(head)}
        self.single = np.array([crc32(word) % n_buckets for word in head], np.int64)
        self.state = [crc32(b" ", crc32(word)) for word in head]
        top = head[:paired]
        self.paired = len(top)
        self.pair = np.array([[crc32(second, state) % n_buckets for second in top] for state in self.state[:paired]], np.int64)

    def of(self, words: list[bytes], before: bytes | None = None) -> np.ndarray:
        """The buckets of the words and of the pairs which end in one of them; `before` is the word before."""
        n, state = self.n, self.state
        if before is not None:
            words = [before, *words]
        ids = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        if len(self.single):
            single = self.single[ids]
        else:
            single = np.zeros(len(ids), np.int64)
        for k in np.flatnonzero(ids < 0).tolist():
            single[k] = crc32(words[k]) % n
        first, second = ids[:-1], ids[1:]
        known = (first >= 0) & (second >= 0) & (first < self.paired) & (second < self.paired)
        pair = np.zeros(len(first), np.int64)
        pair[known] = self.pair[first[known], second[known]] if self.paired else 0
        rest = np.flatnonzero(~known)
        pair[rest] = [
            crc32(words[k + 1], state[a]) % n if a >= 0 else crc32(words[k] + b" " + words[k + 1]) % n
            for k, a in zip(rest.tolist(), first[rest].tolist())
        ]
        return np.concatenate([single[before is not None:], pair])

    def of_text(self, text: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """(words, buckets) of each piece of a text."""
        before = None
        for words in pieces(text):
            if words:
                yield len(words), self.of(words, before)
                before = words[-1]


def _texts(docs: DataFrame, text_col: str, *others: Column) -> DataFrame:
    return docs.select(*others, column(text_col).cast("string").cast("binary").alias("text"))


def head_words(docs: DataFrame, text_col: str = "text", size: int = HEAD) -> list[bytes]:
    """The most frequent words of all texts, the most frequent first: at most `size` of at most 64 bytes each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            kept = [w for w in held if len(w) <= HEAD_BYTES]
            batch = pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), pa.array([held[w] for w in kept], pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for text in batch.column("text"):
                for words in pieces(text.as_py() or b""):
                    held.update(words)
                    if len(held) > HELD:
                        yield out()
        yield out()

    counted = _texts(docs, text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    written = saved(counted, "word-counts")
    words = [bytes(r["word"]) for r in most_frequent(written, "word", size)]
    dropped(written)
    return words


def bucket_totals(docs: DataFrame, head: list[bytes], text_col: str = "text", n_buckets: int = N_BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; one row per bucket that has any."""
    known = docs.sparkSession.sparkContext.broadcast(Buckets(head, n_buckets))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                for _, buckets in known.value.of_text(text.as_py() or b""):
                    total += np.bincount(buckets, minlength=n_buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], ["bucket", "n"])

    return _texts(docs, text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from the totals of the corpus and of the target texts.

    gain = floor(1000 ln((t + 1)(S + n) / ((s + 1)(T + n))): S and T features in all, s and t in the bucket.
    """
    every = raw.sparkSession.range(n_buckets).withColumnRenamed("id", "bucket")
    of = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double")
    both = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    sums = both.agg(F.struct(F.sum(of("s")).alias("s"), F.sum(of("t")).alias("t")).alias("x")).scalar()
    both = both.withColumn("x", sums)
    ratio = (of("t") + 1) * (F.col("x.s") + n_buckets) / ((of("s") + 1) * (F.col("x.t") + n_buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighed(docs: DataFrame, head: list[bytes], gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) per row: weight is the floored mean of its features' gains, 0 without any."""
    known = docs.sparkSession.sparkContext.broadcast((Buckets(head, len(gain)), gain))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, worth = known.value
        for batch in batches:
            rows = np.zeros((batch.num_rows, 3), np.int64)
            for k, text in enumerate(batch.column("text")):
                n_words = n_features = total = 0
                for words, found in buckets.of_text(text.as_py() or b""):
                    n_words, n_features, total = n_words + words, n_features + len(found), total + int(worth[found].sum())
                rows[k] = n_words, n_features, total // n_features if n_features else 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(rows[:, j]) for j in range(3)]], ["id", "n_words", "n_features", "weight"])

    rows = _texts(docs, text_col, column(id_col).cast("long").alias("id"))
    return rows.mapInArrow(weigh, "id long, n_words long, n_features long, weight long")


def luck(id_: Column, seed: int = 7) -> Column:
    """Gumbel noise in thousandths, which depends on the id alone: floor(-1000 ln(-ln(u)))."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    head: int = HEAD, n_buckets: int = N_BUCKETS,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) per row; rank is null for rows which are not drawn.

    Of the N rows with at least `least_words` words the floor(percent * N / 100) highest scores are drawn;
    of equal scores the smaller id is first, a null id last. A null text has no words, weight 0 and is never
    drawn (nor is an empty one); all of whole texts count, whatever their length. Repeated rows are rows of
    their own, with one score. With an empty target all its counts are 0, and without rows there is no rank.
    Other columns are not read, so their names cannot clash.
    """
    words = head_words(docs, text_col, head)
    raw = bucket_totals(docs, words, text_col, n_buckets)
    wanted = bucket_totals(target, words, target_text_col, n_buckets)
    gain = np.zeros(n_buckets, np.int64)
    for r in gains(raw, wanted, n_buckets).collect():  # one row per bucket
        gain[r["bucket"]] = r["gain"]
    score = F.col("weight") + luck(F.col("id"), seed)
    rows = saved(weighed(docs, words, gain, id_col, text_col).withColumn("score", score), "resampling")
    long_enough = rows.where(F.col("n_words") >= least_words)
    drawn = percent * long_enough.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.col("n_features"), F.col("weight"), F.col("n_words")]
    # Sorted by ranges and numbered by their places in the files: no window over all rows.
    in_order = saved(long_enough.repartitionByRange(*order).sortWithinPartitions(*order), "resampling-order")
    numbered = with_row_number(in_order, "order_no")
    rank = F.when(F.col("order_no") <= drawn, F.col("order_no")).cast("long")
    others = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return numbered.withColumn("rank", rank).drop("order_no").unionByName(others)
