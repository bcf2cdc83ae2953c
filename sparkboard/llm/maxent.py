"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

The probability of a token, given the tokens before it in its text, is that of its class times that of the
token within the class. Both are softmaxes over sums of weight rows; each feature of the context (the token
before, the two before, and a skip: the token two before alone) picks a row by its hash, for
classes from one table, for the tokens of a class, with the class in the hash, from another one. Frequencies
are the prior: fixed biases, to which the features add. Tokens beyond the model's vocabulary are the last
class, in which a token's probability is its smoothed share of that class's tokens; so every token has a
probability, and those of all tokens add up to one.

Training goes over all texts in rounds. Each round takes other texts; every task descends along the
gradient from the same broadcast weights, in mini-batches of sparse row updates, and the tasks' weights are
averaged row by row, each by how often it used the row. Counts of tokens are exact and cover all training
texts; the head of the counts is broadcast, tokens of the tail meet their counts in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sparkboard.llm.shared import column, most_frequent, saved

#: The token behind a text's last word: no word is empty.
END = b""
#: Words beyond so many bytes are known by a digest, which no word can be spelled like: it begins with a space.
LONG = 48
#: Tokens whose exact counts are broadcast, at most.
HEAD = 1 << 16
#: Counted tokens a task holds, words scored at a time, tokens of a mini-batch.
HELD, AT_ONCE, MINI = 1 << 18, 1 << 15, 1 << 10
#: Bytes of text split at a time.
PIECE = 1 << 20
#: Tokens of training text per task at least, so that weights do not outweigh texts.
TASK_TOKENS = 1 << 23
SHARDS = 8
SUMS = ["shard", "group", "used", "weighed"]


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in pieces. Bytes which are not UTF-8 count as they are."""
    at = 0
    while at < len(text):
        end = at + PIECE
        # Cut behind the first white space from here on.
        while end < len(text) and text[end - 1:end].strip():
            end += 1
        found = text[at:end].lower().split()
        yield [w if len(w) <= LONG else _digest(w) for w in found] if max(map(len, found), default=0) > LONG else found
        at = end


def _digest(word: bytes) -> bytes:
    return b" " + sha256(word).digest()


@dataclass(frozen=True)
class Shape:
    """Sizes of the model: classes (the last one for all other tokens), tokens per class, rows of the tables."""

    classes: int = 32
    members: int = 64
    class_rows: int = 1 << 12
    word_rows: int = 1 << 14

    @property
    def vocabulary(self) -> int:
        return (self.classes - 1) * self.members


@dataclass
class Model:
    """Token counts of the head, and the weights. `place` holds a token's number; those below
    `shape.vocabulary` are in the vocabulary, the others of the head only have counts."""

    shape: Shape
    place: dict[bytes, int]
    counts: np.ndarray
    n_tokens: int
    n_types: int
    class_bias: np.ndarray
    word_bias: np.ndarray
    class_rows: np.ndarray
    word_rows: np.ndarray

    @property
    def other_tokens(self) -> tuple[int, int]:
        """Training tokens and types beyond the vocabulary."""
        inside = self.counts[: self.shape.vocabulary]
        return self.n_tokens - int(inside.sum()), self.n_types - len(inside)


#: Odd multipliers, one per feature, and the one of a class (fixed values of the hash).
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: Features of a context, and how many tokens back it reaches.
N_FEATURES, REACH = 3, 2


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hashed features [N_FEATURES, tokens] of each token's context; `first` marks the first token of a text.

    A place before the text is a token of its own; a hash of 0 does not occur.
    """
    n = len(ids)
    own = ids.astype(np.uint64) + np.uint64(2)
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    depth = np.arange(n) - starts

    def back(k: int) -> np.ndarray:
        moved = np.ones(n, np.uint64)
        if n > k:
            moved[k:] = own[:-k]
        return np.where(depth >= k, moved, np.uint64(1))

    one, two = back(1), back(2)
    mixed = [one * MULTIPLIERS[0], (one * MULTIPLIERS[1]) ^ (two * MULTIPLIERS[2]), two * MULTIPLIERS[3]]
    found = np.stack([m * np.uint64(2 * k + 1) + np.uint64(k) for k, m in enumerate(mixed)])
    return (found ^ (found >> np.uint64(31))) * MULTIPLIERS[4]


def rows_of(hashed: np.ndarray, n_rows: int, classes: np.ndarray | None = None) -> np.ndarray:
    if classes is not None:
        hashed = (hashed ^ (classes.astype(np.uint64) * MULTIPLIERS[0])) * MULTIPLIERS[1]
    high = hashed >> np.uint64(40)
    # The same for powers of two, without a division.
    return (high & np.uint64(n_rows - 1) if n_rows & (n_rows - 1) == 0 else high % np.uint64(n_rows)).astype(np.int64)


def _softmax(table: np.ndarray, rows: np.ndarray, bias: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log P of each line's own entry; the probabilities of all entries times a factor per line, and that factor."""
    logits = table.take(rows[0], axis=0)
    for row in rows[1:]:
        logits += table.take(row, axis=0)
    logits += bias
    logits -= logits.max(axis=1, keepdims=True)
    found = logits[np.arange(len(own)), own]
    total = np.exp(logits, out=logits).sum(axis=1)
    return found - np.log(total), logits, total


class Descent:
    """One table's sparse gradient steps: each row's step shrinks with the gradients it has seen."""

    def __init__(self, table: np.ndarray, rate: float) -> None:
        self.table, self.rate = table.copy(), rate
        self.used, self.seen = np.zeros(len(table), np.float32), np.zeros(len(table), np.float32)

    def step(self, rows: np.ndarray, gradient: np.ndarray) -> None:
        flat = rows.ravel()
        if len(self.table) <= 1 << 16:  # short numbers are sorted by their digits
            flat = flat.astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        ordered, source = flat[order], order % rows.shape[1]
        begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        hit, times = ordered[begins].astype(np.intp), np.diff(begins, append=len(ordered))
        sums, left, k = gradient.take(source[begins], axis=0), np.flatnonzero(times > 1), 1
        while len(left) and k < 4:  # the second of each run of equal rows, the third, ...
            sums[left] += gradient.take(source[begins[left] + k], axis=0)
            k += 1
            left = left[times[left] > k]
        if len(left):  # few rows, long runs
            rest = times[left] - k
            starts = np.cumsum(rest) - rest
            at = np.repeat(begins[left] + k - starts, rest) + np.arange(rest.sum())
            sums[left] += np.add.reduceat(gradient.take(source[at], axis=0), starts, axis=0)
        self.used[hit] += times
        seen = self.seen[hit] + np.einsum("ij,ij->i", sums, sums)
        self.seen[hit] = seen
        sums *= (self.rate / np.sqrt(seen + np.float32(1e-3)))[:, None]
        self.table[hit] -= sums


def predict(model: Model, ids: np.ndarray, first: np.ndarray, descents: tuple[Descent, Descent] | None = None) -> np.ndarray:
    """log P of each token (of its class alone, for tokens beyond the vocabulary), with a gradient step if asked."""
    shape = model.shape
    inside = ids < shape.vocabulary
    classes = np.where(inside, ids // shape.members, shape.classes - 1)
    hashed = contexts(np.minimum(ids, shape.vocabulary), first)
    class_table, word_table = (d.table for d in descents) if descents else (model.class_rows, model.word_rows)
    rows = rows_of(hashed, shape.class_rows)
    found, likely, total = _softmax(class_table, rows, model.class_bias, classes)
    found, every = found.astype(np.float64), np.arange(len(ids))
    at = np.flatnonzero(inside)
    if len(at):
        own, member = classes[at], ids[at] % shape.members
        own_rows = rows_of(hashed.take(at, axis=1), shape.word_rows, own)
        own_found, own_likely, own_total = _softmax(word_table, own_rows, model.word_bias.take(own, axis=0), member)
        found[at] += own_found
    if descents:
        likely /= total[:, None]
        likely[every, classes] -= 1
        descents[0].step(rows, likely)
        if len(at):
            own_likely /= own_total[:, None]
            own_likely[every[: len(at)], member] -= 1
            descents[1].step(own_rows, own_likely)
    return found


def _texts(docs: DataFrame, text_col: str, *others: Column) -> DataFrame:
    return docs.select(*others, column(text_col).cast("string").cast("binary").alias("text"))


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, n) over all texts, written; a null text is the empty one, which has an end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                held[END] += 1
                for found in words(text.as_py() or b""):
                    held.update(found)
                    if len(held) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["token", "n"])
                        held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["token", "n"])

    return saved(_texts(docs, text_col).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")), "token-counts")


def untrained(counts: DataFrame, shape: Shape = Shape(), head: int = HEAD) -> Model:
    """The model of frequencies alone. The driver gets at most `head` tokens of bounded length."""
    n_tokens, n_types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = most_frequent(counts, "token", head)
    n = np.array([r["n"] for r in top], np.int64)
    inside = np.zeros(shape.vocabulary)
    inside[: min(len(n), shape.vocabulary)] = n[: shape.vocabulary]
    per_class = np.append(inside.reshape(-1, shape.members).sum(axis=1), n_tokens - inside.sum())
    # An unseen token is one more type of the last class.
    per_class[-1] += 0.5
    with np.errstate(divide="ignore"):
        class_bias = np.log(per_class / per_class.sum())
        word_bias = np.log(inside.reshape(-1, shape.members)) - np.log(np.maximum(per_class[:-1], 1))[:, None]
    # Classes and members that no token has: as good as impossible.
    floor = lambda x: np.maximum(x, -1e4).astype(np.float32)
    return Model(
        shape, {bytes(r["token"]): k for k, r in enumerate(top)}, n, int(n_tokens), int(n_types), floor(class_bias), floor(word_bias),
        np.zeros((shape.class_rows, shape.classes), np.float32), np.zeros((shape.word_rows, shape.members), np.float32),
    )


def encoded(batch: pa.Array, model: Model) -> Iterator[tuple[int, np.ndarray, list[bytes], bool, bool]]:
    """(row, numbers, tokens, begins, ends) per piece of each text; tokens beyond the head have the number behind all others."""
    other = max(len(model.counts), model.shape.vocabulary)
    for row, text in enumerate(batch):
        begins = True
        for found in chain(words(text.as_py() or b""), [None]):
            tokens = [END] if found is None else found
            if tokens:
                numbers = np.fromiter(map(model.place.get, tokens, repeat(other)), np.int64, len(tokens))
                yield row, numbers, tokens, begins, found is None
                begins = False


def trained(docs: DataFrame, model: Model, text_col: str = "text", rounds: int = 3, rate: float = 0.5) -> Model:
    """The model after one pass over all texts, in `rounds` parts.

    Texts belong to a round by their hash. Which texts share a task follows from the scan, so that weights
    differ a little between clusters; a lost task is computed again alone.
    """
    shape, spark = model.shape, docs.sparkSession
    rows = _texts(docs, text_col).withColumn("round", F.pmod(F.xxhash64("text", F.lit(13)), F.lit(rounds)).cast("int"))
    tasks = max(spark.sparkContext.defaultParallelism, model.n_tokens // rounds // TASK_TOKENS)
    groups = int(np.ceil(np.sqrt(tasks)))

    def descend(known) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = known.value
            descents = Descent(m.class_rows, rate), Descent(m.word_rows, rate)
            ids, first, size = [], [], 0

            def learn() -> None:
                joined, marks = np.concatenate(ids), np.concatenate(first)
                marks[0] = True
                for at in range(0, len(joined), MINI):
                    part = marks[at:at + MINI].copy()
                    part[0] = True
                    predict(m, joined[at:at + MINI], part, descents)

            for batch in batches:
                for _, numbers, _, begins, _ in encoded(batch.column("text"), m):
                    mark = np.zeros(len(numbers), bool)
                    mark[0] = begins
                    ids.append(numbers)
                    first.append(mark)
                    size += len(numbers)
                    if size >= AT_ONCE:
                        learn()
                        ids, first, size = [], [], 0
            if size:
                learn()
            for table, d in enumerate(descents):
                if not d.used.any():
                    continue
                group = TaskContext.get().partitionId() % groups
                for shard in range(SHARDS):
                    part = slice(shard * len(d.table) // SHARDS, (shard + 1) * len(d.table) // SHARDS)
                    weighed = d.table[part] * d.used[part, None]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([table * SHARDS + shard], pa.int32()), pa.array([group], pa.int32()),
                         pa.array([d.used[part].astype(np.float64).tobytes()], pa.binary()), pa.array([weighed.astype(np.float64).tobytes()], pa.binary())],
                        SUMS,
                    )
        return run

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = weighed = 0.0
        for batch in batches:
            for u, w in zip(batch.column("used"), batch.column("weighed")):
                used = used + np.frombuffer(u.as_py())
                weighed = weighed + np.frombuffer(w.as_py())
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([used.tobytes()], pa.binary()), pa.array([weighed.tobytes()], pa.binary())], SUMS
        )

    schema = "shard int, group int, used binary, weighed binary"
    for k in range(rounds):
        known = spark.sparkContext.broadcast(model)
        part = rows.where(F.col("round") == k).select("text").coalesce(tasks)
        # In two steps, so that no task reads the weights of all others.
        sums = part.mapInArrow(descend(known), schema).groupBy("shard", "group").applyInArrow(add, schema)
        sums = sums.groupBy("shard").applyInArrow(add, schema)
        tables = [model.class_rows.copy(), model.word_rows.copy()]
        for r in sums.collect():  # two tables of fixed size
            table, shard = tables[r["shard"] // SHARDS], r["shard"] % SHARDS
            at = slice(shard * len(table) // SHARDS, (shard + 1) * len(table) // SHARDS)
            used = np.frombuffer(bytes(r["used"]))
            weighed = np.frombuffer(bytes(r["weighed"])).reshape(len(used), -1)
            table[at][used > 0] = (weighed[used > 0] / used[used > 0, None]).astype(np.float32)
        known.unpersist()
        model = Model(**{**model.__dict__, "class_rows": tables[0], "word_rows": tables[1]})
    return model


def scored(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) per row; scores are log10 probabilities of the text.

    `counts` is the table the model was made from. base_score smooths counts: (c + 0.5) / (N + 0.5 (V + 1)).
    A null text counts as empty: one token, the end. Whole texts are scored, repeated rows each. Without
    training texts every token's probability is 1, as nothing but an unseen token is known.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    schema = "id long, n_tokens long, n_known long, n_other long, seen double, inside double, rare array<binary>, times array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        size, vocabulary = len(m.counts), m.shape.vocabulary
        logs = np.log10(np.append(m.counts, 0) + 0.5)
        for batch in batches:
            n = batch.num_rows
            n_tokens, n_known, n_other = (np.zeros(n, np.int64) for _ in range(3))
            seen, inside = np.zeros(n), np.zeros(n)
            rare: list[Counter[bytes]] = [Counter() for _ in range(n)]
            # Row, numbers, marks, and how many tokens are only there as context: the end of the piece before.
            held: list[tuple[int, np.ndarray, np.ndarray, int]] = []

            def flush() -> None:
                ids, first = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
                row = np.concatenate([np.repeat([n, h[0]], [h[3], len(h[1]) - h[3]]) for h in held])
                for at in range(0, len(ids), MINI):
                    # The context of the first ones comes again.
                    back = min(at, REACH)
                    found = predict(m, ids[at - back:at + MINI], first[at - back:at + MINI])[back:]
                    inside[:] += np.bincount(row[at:at + MINI], found, n + 1)[:n] / np.log(10)
                held.clear()

            waiting, before = 0, np.zeros(0, np.int64)
            for k, numbers, tokens, begins, _ in encoded(batch.column("text"), m):
                n_tokens[k] += len(numbers)
                in_head = numbers < size
                n_known[k] += int(in_head.sum())
                beyond = numbers >= vocabulary
                n_other[k] += int(beyond.sum())
                seen[k] += logs[numbers[in_head]].sum()
                inside[k] += logs[numbers[in_head & beyond]].sum()
                rare[k].update([tokens[j] for j in np.flatnonzero(~in_head).tolist()])
                n_before = 0 if begins else len(before)
                joined = numbers if begins else np.concatenate([before, numbers])
                mark = np.zeros(len(joined), bool)
                mark[0] = True
                held.append((k, joined, mark, n_before))
                before = joined[-REACH:]
                waiting += len(numbers)
                if waiting >= AT_ONCE:
                    flush()
                    waiting = 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(x) for x in (n_tokens, n_known, n_other, seen, inside)],
                 pa.array([list(c.keys()) for c in rare], pa.list_(pa.binary())), pa.array([list(c.values()) for c in rare], pa.list_(pa.int64()))],
                ["id", "n_tokens", "n_known", "n_other", "seen", "inside", "rare", "times"],
            )

    rows = _texts(docs, text_col, column(id_col).cast("long").alias("id"))
    # Written with its keys, which tell rows of one id apart.
    found = saved(rows.mapInArrow(run, schema).withColumn("key", F.monotonically_increasing_id()), "lm-rows")
    # Tokens beyond the head are rare each, so no task of this join is large.
    tail = found.select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("key", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    # Without a head (more tokens of about the largest count than it holds) they are all there are.
    known_tail = (counts.where(F.col("n") <= int(model.counts[-1])) if len(model.counts) else counts).select("token", "n")
    met = tail.join(known_tail, "token", "left").groupBy("key").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("logs"),
    )
    other_tokens, other_types = model.other_tokens
    base = float(np.log10(model.n_tokens + 0.5 * (model.n_types + 1)))
    other = float(np.log10(other_tokens + 0.5 * (other_types + 1)))
    logs = F.coalesce("logs", F.lit(0.0))
    return found.join(met, "key", "left").select(
        "id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("seen") + logs - F.col("n_tokens") * base).alias("base_score"),
        (F.col("inside") + logs - F.col("n_other") * other).alias("score"),
    )
