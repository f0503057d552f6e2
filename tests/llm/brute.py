"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quality(text):
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    again = {j for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for j in range(i, i + 3)}
    return {
        "n_words": len(ws),
        "word_chars": sum(map(len, ws)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(again),
        "base_failed": len(ws) < 50 or 100 * len(again) > 50 * len(ws),
    }


def windows(text, n=13):
    ws = words(lower(text), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return ws, ({tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set())


def contamination(docs, items, n=13):
    """docs, items: lists of (id, text)."""
    spots: dict[tuple, set] = {}
    for item, text in items:
        if item is not None:
            for w in windows(text, n)[1]:
                spots.setdefault(w, set()).add(str(item))
    out = []
    for doc, text in docs:
        ws = windows(text, n)[0]
        hit, found = set(), set()
        for w, names in spots.items():
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found |= names
        ids = sorted(found)
        out.append((doc, len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return out


def jaccard_components(docs, k=4, percent=85):
    """doc -> (n_shingles, component)."""
    sets = {}
    for doc, text in docs:
        ws = words(lower(text))
        sets[doc] = {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def removed(texts, size=400):
    """For each text the set of byte places covered by a ``size``-byte string that starts elsewhere too."""
    raw = [(t or "").encode() for t in texts]
    starts = Counter(r[i : i + size] for r in raw for i in range(len(r) - size + 1))
    out = []
    for r in raw:
        gone = set()
        for i in range(len(r) - size + 1):
            if starts[r[i : i + size]] > 1:
                gone |= set(range(i, i + size))
        out.append(gone)
    return out


ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def base_secrets(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]
