"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\r\x0b\x0c"


def fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k:k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


def smallest_of_class(ids, linked):
    """For each id the smallest reachable over linked(i, j)."""
    label = list(range(len(ids)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j) and root(i) != root(j):
                label[root(i)] = root(j)
    low = {}
    for k in range(len(ids)):
        low[root(k)] = min(low.get(root(k), ids[k]), ids[k])
    return [low[root(k)] for k in range(len(ids))]


def deduped(docs, min_chars=20):
    """{id: text} without later copies: blocks of 1, 2, 4, ... lines met before, in order of ids."""
    lines = [(i, [(n, x.strip(BLANK)) for n, x in enumerate(docs[i].split("\n")) if x.strip(BLANK)]) for i in sorted(docs)]
    gone, length = {i: set() for i in docs}, 1
    while any(len(l) >= length for _, l in lines):
        seen = set()
        for i, l in lines:
            for s in range(len(l) - length + 1):
                key = tuple(x for _, x in l[s:s + length])
                if key in seen and (length > 1 or len(key[0]) >= min_chars):
                    gone[i].update(range(l[s][0], l[s + length - 1][0] + 1))
                seen.add(key)
        length *= 2
    kept = {i: "\n".join(x for n, x in enumerate(docs[i].split("\n")) if n not in gone[i]) for i in docs}
    empty = {i for i, l in lines if gone[i] and all(n in gone[i] for n, _ in l)}
    return kept, empty


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    repeated = {j for k in range(len(words) - 7) if windows[tuple(words[k:k + 8])] > 1 for j in range(k, k + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def ids_bytes(ids):
    return np.array(ids, "<u4").tobytes()
