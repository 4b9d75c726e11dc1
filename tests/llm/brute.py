"""Plain Python versions of the text operators."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def backoff(docs, order, alpha=0.4, least=2):
    words = {d: SPACED.findall(t or "") for d, t in docs}
    counts = Counter(tuple(w[i : i + n]) for w in words.values() for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words.values()))

    def score(history, word):
        if not history:
            return math.log(counts[(word,)] / total)
        if counts[(*history, word)] >= least:
            return math.log(counts[(*history, word)] / counts[history])
        return math.log(alpha) + score(history[1:], word)

    return {d: (len(w), sum(score(tuple(w[max(0, i - order + 1) : i]), w[i]) for i in range(len(w)))) for d, w in words.items()}


def contaminated(docs, items, size=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - size, 0) + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(i)
    sizes, out = {len(x) for x in windows}, {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def components(docs, n, percent):
    sets = {}
    for d, t in docs:
        w = SPACED.findall(lower(t))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def repeats(docs, length):
    data = {d: (t or "").encode() for d, t in docs}
    counts = Counter(b[i : i + length] for b in data.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    out = []
    for k, (kind, pattern) in enumerate(FORMATS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fails = {
                "email": False,
                "ip": kind == "ip" and any(int(p) > 255 for p in m.group().split(".")),
                "card": not 12 <= len(digits) <= 19 or not luhn(digits),
                "phone": not 9 <= len(digits) <= 15,
            }[kind]
            if not fails:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{list(FORMATS)[k]}:{a}:{b}" for a, k, b in sorted(out))


def quality(text):
    text = text or ""
    w = SPACED.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    counts, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if counts[x] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed
