"""Plain versions of the contracts, a row at a time, for small fixtures."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text, n):
    w = words(text)
    return frozenset(zip(*[w[i:] for i in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked(docs, percent, n):
    """doc_id -> (size of the set, component)."""
    sets = {i: shingles(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in where[s])
        for j, both in shared.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            where[s].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def personal(text):
    """(n_email, n_ip, n_card, n_phone, base_sha256)."""
    spans = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if ok(m[0])] for k, p, ok in KINDS]
    return (*map(len, spans), hashlib.sha256(",".join(sum(spans, [])).encode()).hexdigest())


def fold(doc_id, divisor=5):
    return zlib.crc32(str(doc_id).encode()) % divisor


def base_scores(docs):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    tokens = {i: words(t) + [None] for i, t in docs}
    counts = Counter(x for i, ts in tokens.items() if fold(i) != 1 for x in ts)
    n, v = sum(counts.values()), len(counts)
    return {
        i: (fold(i) == 1, len(ts), sum(counts[x] > 0 for x in ts), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts))
        for i, ts in tokens.items()
    }


def smith_waterman(a, b, match=2, mismatch=-1, gap=-1):
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (match if x == y else mismatch), above[j + 1] + gap, row[j] + gap))
        best, above = max(best, *row), row
    return best
