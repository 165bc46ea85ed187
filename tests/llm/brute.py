"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


def low(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def op1(docs, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def op6(docs, n=3, num=90):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= num * max(len(a), len(b)):
                k = len(a & b)
                if 100 * k >= num * (len(a) + len(b) - k):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None and (least.get(r) is None or d < least[r]):
            least[r] = d
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)]


def op10(docs, items, size=13):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))

    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - size + 1)):
            if w:
                windows.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for d, text in docs:
        w, hit, found = split(text), set(), set()
        for s in sizes:
            for i in range(len(w) - s + 1):
                its = windows.get(tuple(w[i:i + s]))
                if its:
                    hit.update(range(i, i + s))
                    found |= its
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


def op9(pages):
    import base64

    def digest(h):
        return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()

    head = {}
    for p, h in pages:
        head[h or ""] = max(p, head.get(h or "", p))
    return [(p, len((h or "").encode()), digest(h), "response" if head[h or ""] == p else "revisit",
             None if head[h or ""] == p else head[h or ""]) for p, h in pages]


def op2_base(text):
    out = []
    for m in re.finditer(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(out)


def op8(rows, threshold=0.93):
    import numpy as np

    good = [i for i, (_, e, lab) in enumerate(rows) if lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    groups = {}
    for i in good:
        groups.setdefault((rows[i][2], len(rows[i][1])), []).append(i)
    for members in groups.values():
        x = np.array([rows[i][1] for i in members], dtype=np.float64)
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        for p, q in zip(a, b):
            i, j = members[p], members[q]
            n[i] += 1
            n[j] += 1
            root[find(i)] = find(j)
    least = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            r = find(i)
            least[r] = min(v, least.get(r, v))
    return [(v, n[i], least.get(find(i)), v is not None and least[find(i)] == v) for i, (v, _, _) in enumerate(rows)]
