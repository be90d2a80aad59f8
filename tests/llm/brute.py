"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import statistics
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASSES = (r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?'\"()\-]", None, r"[^\x00-\x7f]")


def words(text):
    return WORD.findall(text or "")


def base(text):
    w, text = words(text), text or ""
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = set()
    for i in range(len(w) - 2):
        if windows[w[i], w[i + 1], w[i + 2]] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def _distance(counts, shares):
    n = sum(counts)
    if not n:
        return 0.0
    out = 0.0
    for c, q in zip(counts, shares):
        p = c / n
        m = (p + q) / 2
        out += (p * math.log2(p / m) if p else 0) + (q * math.log2(q / m) if q else 0)
    return math.sqrt(max(0, out / 2))


def _classes(text):
    n = [len(re.findall(p, text)) if p else 0 for p in CLASSES]
    n[5] = len(text) - sum(n)
    return n


def quality(rows):
    """rows: (doc_id, text, lang) -> (doc_id, the base columns, kept)."""
    languages = {x for x, n in Counter(r[2] for r in rows).items() if x is not None and n >= len(rows) / 1000}
    groups = defaultdict(list)
    for r in rows:
        groups[r[2] if r[2] in languages else None].append(r)
    out = []
    for members in groups.values():
        count = Counter(w for _, t, _ in members for w in words(t))
        total = sum(count.values())
        common = [w for w, n in count.items() if n >= total / 1000]
        shares = [count[w] / total for w in common] + [(total - sum(count[w] for w in common)) / total] if total else []
        held = [[1000 * x // sum(c) for x in c] for _, t, _ in members if words(t) for c in [_classes(t)]]
        median = [statistics.median_low(x) for x in zip(*held)] if held else [0] * 7
        median = [x / max(sum(median), 1) for x in median]
        for d, t, _ in members:
            b = base(t)
            kept = not b[5]
            if kept and b[1] >= 200 and _distance(_classes(t), median) > 0.19:
                kept = False
            if kept:
                c = Counter(words(t))
                mine = [c[w] for w in common]
                kept = _distance([*mine, b[0] - sum(mine)], shares) <= 0.2 + 2.6 / math.sqrt(b[0])
            out.append((d, *b, kept))
    return out


def shingles(text, k=5):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def jaccard_join(rows):
    """rows: (doc_id, text) -> (doc_id, n_shingles, component_id, n_links)."""
    sets = [shingles(t) for _, t in rows]
    ids = [d for d, _ in rows]
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and ids[i] is not None and ids[j] is not None and min(len(a), len(b)) * 4 >= max(len(a), len(b)) * 3:
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    links[i].add(j)
                    links[j].add(i)
    component = {}
    for i in range(len(rows)):
        if i not in component:
            group, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()] - group:
                    group.add(j)
                    todo.append(j)
            least = min((ids[j] for j in group if ids[j] is not None), default=None)
            component |= dict.fromkeys(group, least)
    return [(ids[i], len(sets[i]), component[i], len(links[i])) for i in range(len(rows))]


def kept_words(rows, width=50):
    """rows: (doc_id, text) -> the words left of each."""
    first = {}
    split = [words(t) for _, t in rows]
    for (d, _), w in zip(rows, split):
        for i in range(len(w) - width + 1) if d is not None else ():
            key = tuple(w[i:i + width])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1) if d is not None else ():
            if first[tuple(w[i:i + width])] < d:
                gone[i:i + width] = [True] * width
        out.append((d, len(w), [x for x, g in zip(w, gone) if not g]))
    return out


def substring_dedup(rows):
    return [(d, n, n - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for d, n, k in kept_words(rows)]


def token_ids(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def nearest(rows, k, dim):
    """rows: (vec_id, embedding) -> {query: [(distance, vec_id), ...]}."""
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(tuple(v), set()).add(i)
    flat = sorted((i, v) for v, ids in good.items() for i in ids)
    ids, vectors = np.array([i for i, _ in flat]), np.array([v for _, v in flat], dtype=np.float64)
    out = {}
    for q, v in flat:
        if q % 100 == 0:
            d = np.sqrt(((vectors - np.array(v)) ** 2).sum(axis=1))
            out.setdefault(q, []).extend((float(x), int(i)) for x, i in zip(d, ids) if i != q)
    return {q: sorted(set(x))[:k] for q, x in out.items()}
