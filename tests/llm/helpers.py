"""Plain versions of the operators, for small inputs."""

import hashlib
import re


import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(text, n):
    w = WORD.findall(_lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard_components(docs, n, percent):
    """{doc: (size, component)} by comparing all pairs."""
    sets = {d: shingles(t, n) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def byte_dedup(docs, length):
    """{doc: (bytes, removed, spans, digest)} from all strings of ``length`` bytes."""
    first = {}
    for d, t in docs:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < d:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[d] = (len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def nearest_part(item, text):
    """The least edit distance of any part of ``text`` to ``item``."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def line_chunks(text, hash_of, window, divisor, base, modulus):
    lines = (text or "").split("\n")
    h = [hash_of(x) for x in lines]
    out, now = [], []
    for i, line in enumerate(lines):
        now.append(line)
        rolled = sum(h[i - j] * pow(base, j, modulus) % modulus for j in range(window) if i >= j) % modulus
        if rolled % divisor == 0 or i == len(lines) - 1:
            out.append(now)
            now = []
    return out


def line_dedup(docs, hash_of, window, divisor, base, modulus):
    """{doc: text that stays}."""
    chunks = {d: line_chunks(t, hash_of, window, divisor, base, modulus) for d, t in docs}
    seen, out = set(), {}
    for d in sorted(chunks):
        kept = []
        for c in chunks[d]:
            body = "\n".join(c)
            if len(c) > 1 and body.replace("\n", ""):
                if body in seen:
                    continue
                seen.add(body)
            kept += c
        out[d] = "\n".join(kept)
    return out


