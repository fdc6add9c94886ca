"""Plain single-process versions that the operators are held against."""

import collections
import hashlib
import math
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def simhash(text, k=3):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def components(prints, radius):
    """prints: {id: fingerprint}; {id: smallest id reachable}."""
    ids = sorted(prints)
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def substring_dedup(docs, n=13):
    """docs: (id, text); {id: (words, removed, kept)} where ids are unique."""
    first = {}
    for i, text in docs:
        w = words(text)
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, text in docs:
        w = words(text)
        gone = {p for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for p in range(k, k + n)}
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def edited(docs):
    """docs: (id, text), unique ids; {id: SHA-256 of the edited text}."""
    rows = sorted(docs, reverse=True)
    out = {}
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 3
        out[i] = hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest()
    return out


def unigram(docs):
    """{id: (tokens, known, base log10)}, and the number of training tokens."""
    tokens = {i: [*words((t or "").translate(LOWER)), ""] for i, t in docs}
    count = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    total, kinds = sum(count.values()), len(count)
    return {i: (len(ws), sum(w in count for w in ws), sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)) for i, ws in tokens.items()}, total
