"""The contracts written out in plain Python, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    w = words(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def ngram_join(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(k)
    shared = Counter()
    for k in holders.values():
        for i in range(len(k)):
            for j in range(i):
                shared[k[j], k[i]] += 1
    for (i, j), n in shared.items():
        if 100 * n >= 75 * (len(sets[i][1]) + len(sets[j][1]) - n):
            a, b = sorted((root(sets[i][0]), root(sets[j][0])))
            parent[b] = a
    return {(d, len(s), root(d)) for d, s in sets}


def substring_dedup(rows, window=20):
    first = {}
    lists = [(d, words(t)) for d, t in rows]
    for d, w in lists:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = set()
    for d, w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (d, i):
                gone[i : i + window] = [True] * window
        out.add((d, len(w), sum(gone), digest(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def pii_spans(text):
    text = text or ""
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def secret_spans(text):
    text = text or ""
    out = []
    pattern = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    out += [("assign", m.start(), m.end()) for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return out


def shown(spans, kinds):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]))))


def rules(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(grams)
    covered = set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def perplexities(texts):
    """Negative log probability per byte under interpolated modified Kneser-Ney over pairs of words."""
    lists = [["", *words(t or "")] for t in texts]
    count = Counter(x for w in lists for x in zip(w, w[1:]))
    after = Counter(w for _, w in count)
    context, followers = Counter(), {}
    for (v, _), n in count.items():
        context[v] += n
        followers.setdefault(v, []).append(n)

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in range(1, 5)]
        y = n[0] / max(n[0] + 2 * n[1], 1)
        d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.5 for k in range(3)]
        return [0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))]

    two, one = discounts(count.values()), discounts(after.values())
    left = sum(one[min(n, 3)] for n in after.values()) / max(len(after), 1)
    out = []
    for t, w in zip(texts, lists):
        total = 0.0
        for v, x in zip(w, w[1:]):
            lower = (after[x] - one[min(after[x], 3)] + left) / len(count)
            weight = sum(two[min(n, 3)] for n in followers[v])
            total -= math.log((count[v, x] - two[min(count[v, x], 3)] + weight * lower) / context[v])
        out.append(total / max(len((t or "").encode()), 1))
    return out


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked(documents, items, k=10):
    """(item_id, rank, doc_id, score) of texts (doc_id, text) for items (item_id, text)."""
    held = [(d, Counter(TERM.findall(lower(t or "")))) for d, t in documents]
    held = [(d, c) for d, c in held if c]
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 100 - 75 + 75 * sum(c.values()) * len(held) // total
            score = 0
            for t in TERM.findall(lower(text or "")):
                if t in c:
                    w = math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1)))
                    score += w * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d))
        for rank, (score, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.append((item, rank, d, -score))
    return out


def hard_negatives(rows):
    """(anchor_id, positive_id, rank, negative_id, scores) of rows (vec_id, embedding, label)."""
    whole = [
        (i, [math.floor(256 * x) for x in v], label)
        for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for k, (anchor, v, label) in enumerate(whole):
        if anchor is None or anchor % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), i, own) for j, (i, w, own) in enumerate(whole) if j != k]
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        for p, positive, _ in [x for x in scored if x[2] == label][:5]:
            found = [(s, i) for s, i, own in scored if own != label and 50 * p <= 100 * s <= 95 * p][:3]
            out += [(anchor, positive, rank, i, p, s) for rank, (s, i) in enumerate(found, 1)]
    return out


def suffix_dedup(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of texts (doc_id, text)."""
    low = -(2**63)
    texts = [(low if d is None else d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, t in texts:
        for i in range(len(t) - length + 1):
            key = t[i : i + length]
            least[key] = min(least.get(key, d), d)
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < d:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((None if d == low else d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
