"""BPE as a streaming transducer with bounded lookahead, and its inverse.

A merge list decides tokens by rank, so text far to the right can change a token only through a chain
of merges, each stopped or made by the one before. `sufficient_lookahead` bounds how far such a chain
reaches. The encoder therefore keeps a window of symbols: a token which ends at least that far before
the window's end is the same whatever follows, and is emitted; what precedes it never matters again.
Memory is constant however long a word or text is. The decoder is a state machine fed with one id
after the other: it holds no more than the bytes of one unfinished character.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import itertools
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from sparkboard.llm.shared import column, valid_text

#: Words whose tokens a Python worker remembers; more only cost time.
REMEMBERED = 150_000
#: Characters of text handled at a time.
AT_ONCE = 1 << 20
LOW = (1 << 20) - 1
#: Above every rank.
NO_RULE = 1 << 60
#: Words up to so many bytes are merged many at a time, in tables of these widths.
WIDTHS = (8, 16, 32)


def byte_signs() -> dict[int, str]:
    """The printable sign which stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Merges:
    """A merge list over symbols; the tokens of symbol sequences."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], base: Iterable[str]) -> None:
        self.length = {vocab[s]: 1 for s in base}
        if max(vocab.values(), default=0) > LOW:
            raise ValueError("more than a million tokens")
        self.rule: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if x not in self.length or y not in self.length:
                raise ValueError(f"the parts of merge {rank} are not made by earlier merges")
            self.length[z] = self.length[x] + self.length[y]
            self.rule.setdefault(x << 20 | y, rank << 20 | z)
        self.longest = max(self.length.values(), default=1)
        self.lookahead = sufficient_lookahead(merges, self.length, vocab)
        self.full = 2 * (self.lookahead + self.longest)
        self.pairs = np.array(sorted(self.rule), np.int64)
        self.made = np.array([self.rule[p] for p in self.pairs.tolist()] + [NO_RULE], np.int64)

    def tokens(self, symbols: list[int]) -> list[int]:
        """All merges one by one, the lowest rank first, from the left among equals."""
        rule, parts = self.rule.get, symbols
        # For each neighbouring pair its rank and what it becomes, in one number.
        pairs = [rule(a << 20 | b, NO_RULE) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == NO_RULE:
                break
            i = pairs.index(best)
            made = best & LOW
            parts[i:i + 2] = [made]
            del pairs[i]
            if i:
                pairs[i - 1] = rule(parts[i - 1] << 20 | made, NO_RULE)
            if i < len(pairs):
                pairs[i] = rule(made << 20 | parts[i + 1], NO_RULE)
        return parts

    def _rules(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 20 | right
        found = np.searchsorted(self.pairs, wanted)
        if len(self.pairs):
            found[self.pairs[np.minimum(found, len(self.pairs) - 1)] != wanted] = len(self.pairs)
        return self.made[found]

    def many(self, symbols: np.ndarray) -> np.ndarray:
        """The tokens of many symbol sequences, one per line, -1 behind their ends: in each round every line makes one merge."""
        done, live, now = symbols.copy(), np.arange(len(symbols)), symbols
        column = np.arange(symbols.shape[1])
        pairs = self._rules(now[:, :-1], now[:, 1:])
        while len(live):
            at = pairs.argmin(axis=1)
            best = pairs[np.arange(len(live)), at]
            goes_on = best < NO_RULE
            done[live[~goes_on]] = now[~goes_on]
            live, now, pairs, at, best = (x[goes_on] for x in (live, now, pairs, at, best))
            line, made = np.arange(len(live)), best & LOW
            behind = column > at[:, None]
            # What stands behind the merged pair moves up by one.
            now = np.where(behind, np.pad(now[:, 1:], ((0, 0), (0, 1)), constant_values=-1), now)
            pairs = np.where(behind[:, :-1], np.pad(pairs[:, 1:], ((0, 0), (0, 1)), constant_values=NO_RULE), pairs)
            now[line, at] = made
            inner = at + 1 < now.shape[1]
            pairs[line[inner], at[inner]] = self._rules(made[inner], now[line[inner], at[inner] + 1])
            later = at > 0
            pairs[line[later], at[later] - 1] = self._rules(now[line[later], at[later] - 1], made[later])
        return done

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """The tokens of a symbol stream, each as soon as nothing to its right can change it."""
        window: list[int] = []
        full = self.full
        for s in symbols:
            window.append(s)
            if len(window) == full:
                end, stable = 0, full - self.lookahead
                for t in self.tokens(window[:]):
                    if end + self.length[t] > stable:
                        break
                    end += self.length[t]
                    yield t
                window = window[end:]
        yield from self.tokens(window)


def sufficient_lookahead(merges: list[tuple[str, str]], length: dict[int, int], vocab: dict[str, int]) -> int:
    """How many symbols before the end of a window its tokens may still depend on what follows.

    Compare the merges with and without more text. They differ only right of a frontier, at first the
    window's end. It moves left when a merge (u, v) is made in one of the two runs alone: v starts at
    the frontier and differs there, because an earlier merge (x, y) put the frontier where x starts, so
    that x is how v begins. Ranks rise along such a chain, and each step moves the frontier by the
    length of u, the first by at most one symbol less than the whole merge. The longest chain bounds
    the way; it is found in one pass by rank over the beginnings of v.
    """
    reach: dict[str, int] = {}
    most = 0
    for a, b in merges:
        la, lb = length[vocab[a]], length[vocab[b]]
        before = max((reach.get(b[:k], 0) for k in range(1, len(b) + 1)), default=0)
        way = max(la + lb - 1, before + la)
        most = max(most, way)
        if way > reach.get(a, 0):
            reach[a] = way
    return most


class WordTokenizer:
    """A word-level BPE tokenizer file: normalise, split into words, merge inside each word."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        signs = byte_signs()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        base = [s for b in signs.values() for s in {b, b + end} if s in self.vocab]
        self.merges = Merges(self.vocab, merges, base)
        self.inside = [self.vocab.get(signs[b]) for b in range(256)]
        self.final = [self.vocab.get(signs[b] + end) for b in range(256)]
        pieces = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        # The file's expression, read by a library with the same classes of characters.
        self.words = regex.compile(pieces[0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.text = {i: s for s, i in (self.vocab | self.special).items()}
        self.end, self.sign_bytes = end, {c: b for b, c in signs.items()}
        self.known = _Known(self)

    def word(self, word: str) -> bytes:
        """The ids of one word, as little-endian unsigned 32-bit integers."""
        raw = word.encode("utf-8")
        symbols = list(map(self.inside.__getitem__, raw))
        symbols[-1] = self.final[raw[-1]]
        # Shorter than a window, a word is all tail.
        ids = self.merges.tokens(symbols) if len(symbols) < self.merges.full else list(self.merges.stream(symbols))
        return _packed(len(ids)).pack(*ids)

    def words_of(self, words: list[str]) -> dict[str, bytes]:
        """The ids of those of the words which are short, made many at a time."""
        raw = [w.encode("utf-8") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        every = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)
        symbols = np.array(self.inside, np.int64)[every]
        symbols[ends - 1] = np.array(self.final, np.int64)[every[ends - 1]]
        found, least = {}, 0
        for width in WIDTHS:
            own = np.flatnonzero((size > least) & (size <= width))
            least, places = width, np.arange(width)
            if not len(own):
                continue
            inside = places < size[own, None]
            table = np.full(inside.shape, -1, np.int64)
            table[inside] = symbols[((ends - size)[own, None] + places)[inside]]
            tokens = self.merges.many(table)
            ids, cuts = tokens[tokens >= 0].astype("<u4").tobytes(), (4 * np.cumsum((tokens >= 0).sum(axis=1))).tolist()
            found.update((words[k], ids[a:z]) for k, a, z in zip(own.tolist(), [0, *cuts], cuts))
        return found

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text, block by block. Special tokens are recognised in the text as given."""
        for _, block in self.encode_all([text]):
            yield block

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes]]:
        """(number of the text, ids of a block) for many texts, each with a block at least."""
        held: list[tuple[int, list[str] | bytes]] = []
        size = 0
        for k, text in enumerate(texts):
            at = 0
            for special in itertools.chain(self.specials.finditer(text), [None]):
                for piece in _pieces(text[at:special.start() if special else len(text)]):
                    held.append((k, self.words.findall(_lower(unicodedata.normalize("NFC", piece)))))
                    size += len(piece)
                    if size >= AT_ONCE:
                        yield from self._blocks(held)
                        held, size = [], 0
                if special:
                    held.append((k, np.array([self.special[special[0]]], "<u4").tobytes()))
                    at = special.end()
        yield from self._blocks(held)

    def _blocks(self, held: list[tuple[int, list[str] | bytes]]) -> Iterator[tuple[int, bytes]]:
        known = self.known
        known.learn([x for _, x in held if isinstance(x, list)])
        for k, x in held:
            yield k, x if isinstance(x, bytes) else b"".join(map(known.__getitem__, x))


@functools.lru_cache(4096)
def _packed(n: int) -> struct.Struct:
    return struct.Struct(f"<{n}I")


class _Known(dict):
    """Tokens of words met before: at most REMEMBERED of them, or those of one block of text."""

    def __init__(self, tokenizer: WordTokenizer) -> None:
        self.tokenizer = tokenizer

    def learn(self, texts: list[list[str]]) -> None:
        new = set().union(*texts).difference(self)
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = set().union(*texts)
        new = [w for w in new if len(w) <= WIDTHS[-1]]
        if new:
            self.update(self.tokenizer.words_of(new))

    def __missing__(self, word: str) -> bytes:
        found = self.tokenizer.word(word)
        if len(word) < 100 and len(self) < REMEMBERED:
            self[word] = found
        return found


def _lower(text: str) -> str:
    """Lower case character by character: a final sigma is an ordinary one."""
    return text.lower() if text.isascii() else text.replace("Σ", "σ").lower()


def _pieces(text: str) -> Iterator[str]:
    """A long text cut before ASCII white space, where no word, composition or case rule reaches across."""
    at = 0
    while len(text) - at > AT_ONCE:
        cut = _CUT.search(text, at + AT_ONCE)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


_CUT = regex.compile(r"[ \n\t\r]")


class Decoder:
    """Ids to text, a block of ids at a time.

    `shown` gives the vocabulary's texts joined by one space, as a file without a decoder asks for;
    `readable` turns signs back into bytes and word ends into spaces, and bytes into characters as soon
    as one is complete (a byte sequence which is none becomes U+FFFD).
    """

    def __init__(self, tokenizer: WordTokenizer) -> None:
        self.tokenizer, self.first = tokenizer, True
        self.chars = codecs.getincrementaldecoder("utf-8")("replace")
        self.shown_bytes = _shown_bytes(tokenizer)

    def shown(self, ids: list[int]) -> bytes:
        if not ids:
            return b""
        joined = b" ".join(map(self.shown_bytes.__getitem__, ids))
        joined, self.first = (joined if self.first else b" " + joined), False
        return joined

    def readable(self, ids: Iterable[int], last: bool = False) -> str:
        table = _raw_bytes(self.tokenizer)
        return self.chars.decode(b"".join(map(table.__getitem__, ids)), last)


def _raw_bytes(tokenizer: WordTokenizer) -> list[bytes]:
    """What each id stands for: the bytes of its signs and a space where a word ends; special ids as they are spelled."""
    if not hasattr(tokenizer, "_raw"):
        special, end = set(tokenizer.special.values()), tokenizer.end
        spelled, table = str.maketrans({c: chr(b) for c, b in tokenizer.sign_bytes.items()}), [b""] * len(_shown_bytes(tokenizer))
        for i, sign in tokenizer.text.items():
            if i in special:
                table[i] = sign.encode() + b" "
            elif end and sign.endswith(end):
                table[i] = sign[: -len(end)].translate(spelled).encode("latin-1") + b" "
            else:
                table[i] = sign.translate(spelled).encode("latin-1")
        tokenizer._raw = table
    return tokenizer._raw


def _shown_bytes(tokenizer: WordTokenizer) -> list[bytes]:
    if not hasattr(tokenizer, "_shown"):
        tokenizer._shown = [tokenizer.text.get(i, "").encode("utf-8") for i in range(max(tokenizer.text) + 1)]
    return tokenizer._shown


_LOADED: dict[str, WordTokenizer] = {}


def load(path: str) -> WordTokenizer:
    """One tokenizer per file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def digests(text: str | None, tokenizer: WordTokenizer, readable: bool = False) -> tuple:
    """(number of ids, SHA-256 of the ids, of the decoded text and, if asked for, of the readable text) in constant memory."""
    return next(all_digests([text], tokenizer, readable))


def all_digests(texts: Iterable[str | None], tokenizer: WordTokenizer, readable: bool = False) -> Iterator[tuple]:
    """The `digests` of each text."""
    for _, blocks in itertools.groupby(tokenizer.encode_all(t or "" for t in texts), key=lambda b: b[0]):
        ids_hash, text_hash, readable_hash = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        n, decoder = 0, Decoder(tokenizer)
        for _, block in blocks:
            ids_hash.update(block)
            ids = np.frombuffer(block, "<u4").tolist()
            n += len(ids)
            text_hash.update(decoder.shown(ids))
            if readable:
                readable_hash.update(decoder.readable(ids).encode("utf-8"))
        readable_hash.update(decoder.readable([], last=True).encode("utf-8"))
        found = n, ids_hash.hexdigest(), text_hash.hexdigest()
        yield (*found, readable_hash.hexdigest()) if readable else found


def encoded_digests(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", readable: bool = False
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row, with `readable` also readable_sha256.

    The decoded text is the vocabulary's texts joined by spaces, the readable one that of the byte-to-text machine.
    A null text is an empty one, bytes which are not UTF-8 are U+FFFD; other columns are not read.
    """

    names = ["ids_sha256", "decoded_sha256", *(["readable_sha256"] if readable else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(tokenizer_path)
        for batch in batches:
            rows = list(all_digests((t.as_py() for t in batch.column(1)), tokenizer, readable))
            n, *found = zip(*rows) if rows else [()] * (1 + len(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *[pa.array(x, pa.string()) for x in found]],
                ["id", "n_tokens", *names],
            )

    rows = docs.select(column(id_col).cast("long").alias("id"), valid_text(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long" + "".join(f", {x} string" for x in names))


def encoded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns of `keep`, n_tokens, ids array<int>, decoded_sha256) per row: the tokens themselves,
    and the digest of what they decode to. A null text has no tokens, bytes which are not UTF-8 are U+FFFD.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(tokenizer_path)
        for batch in batches:
            ids, shown = [], []
            texts = (t.as_py() or "" for t in batch.column(0))
            for _, found in itertools.groupby(tokenizer.encode_all(texts), key=lambda b: b[0]):
                blocks, decoder, digest = [], Decoder(tokenizer), hashlib.sha256()
                for _, block in found:
                    blocks.append(block)
                    digest.update(decoder.shown(np.frombuffer(block, "<u4").tolist()))
                ids.append(np.frombuffer(b"".join(blocks), "<u4").astype(np.int32))
                shown.append(digest.hexdigest())
            made = [pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(shown, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*batch.schema.names[1:], "n_tokens", "ids", "decoded_sha256"])

    rows = docs.select(valid_text(text_col).alias("__text"), column(id_col).cast("long").alias("id"), *[column(c) for c in keep])
    schema = T.StructType(rows.schema.fields[1:]).add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType())).add("decoded_sha256", "string")
    return rows.mapInArrow(run, schema)


def decoded(tokens: DataFrame, tokenizer_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) per row: readable text of token ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(tokenizer_path)
        for batch in batches:
            texts = [Decoder(tokenizer).readable(x.as_py() or [], last=True) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = tokens.select(column(id_col).alias("id"), column(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")
