"""Plain-Python versions of the operators' definitions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, width):
    w = lowered(text)
    if not w:
        return set()
    return set(zip(*[w[k:] for k in range(width)])) if len(w) >= width else {tuple(w)}


def components(docs, width=2, percent=80):
    """{id: (set size, smallest reachable id)}; every pair of documents is compared."""
    sets = {k: shingles(t, width) for k, t in docs}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {k: (len(s), root(k)) for k, s in sets.items()}


def repeated(docs, length=400):
    """{id: (bytes, removed, spans, digest of what stays)} and the covered marks."""
    raw = {k: (t or "").encode() for k, t in docs}
    seen = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    out, marks = {}, {}
    for k, b in raw.items():
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out[k] = (len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest())
        marks[k] = mark
    return out, marks


def base_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    w, seen, again = words(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def piece_rows(docs, tokenizer, capacity=2048):
    import numpy as np

    out = []
    for key, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            out.append((key, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def conversations(rows):
    """{conv: (turns, digest of turns, loss characters, digest of loss text)} of (conv, turn, role, text) in order."""
    by = defaultdict(list)
    for conv, _, role, text in rows:
        by[conv].append((role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {
        c: (len(v), digest("".join(f"{r}\n{t}\n" for r, t in v)), sum(len(t) for r, t in v if r == "assistant"), digest("".join(t for r, t in v if r == "assistant")))
        for c, v in by.items()
    }
