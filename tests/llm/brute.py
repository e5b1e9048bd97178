"""Plain versions of the operators, over Python rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def crc(ids):
    return zlib.crc32(packed(ids))


def word_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def kept_documents(rows, limit=20, least=0.2):
    """Whether each of (host, text) is kept: base rules, then lines in more distinct texts of the host than the limit."""

    def even(line):
        return re.sub("[0-9]", "0", " ".join(WORD.findall(line.lower())))

    texts = {}
    for host, text in rows:
        for line in (text or "").split("\n"):
            if WORD.search(line):
                texts.setdefault((host or "", even(line)), set()).add(text)
    out = []
    for host, text in rows:
        n, *_, failed = word_counts(text or "")
        lost = sum(len(WORD.findall(x)) for x in (text or "").split("\n") if len(texts.get((host or "", even(x)), ())) > limit)
        out.append(not failed and not (lost and n - lost < least * n))
    return out


def base_secrets(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans)]


def simhash(text, k=3):
    words = text.encode().lower().split()
    k = min(k, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys, linked):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def shingles(text, k=5):
    words = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similar(a, b, p=4, q=5):
    """Whether the Jaccard similarity of two sets is p/q or more."""
    return q * len(a & b) >= p * len(a | b)


def simhash_components(fps):
    keys = sorted(fps)
    return components(keys, [(a, b) for i, a in enumerate(keys) for b in keys[:i] if (fps[a] ^ fps[b]).bit_count() <= 3])


def check_packing(rows, capacity):
    """rows: (length, sequence, offset); no gap, no overlap; returns the number of sequences."""
    by = {}
    for length, sequence, offset in rows:
        by.setdefault(sequence, []).append((offset, length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)
