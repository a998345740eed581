"""Plain Python versions of the operators, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


WORD10 = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def contamination(docs, items, window=10):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}; words found by comparing every window."""
    words = lambda t: WORD10.findall((t or "").translate(LOWER))
    known = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            known.setdefault(tuple(w[i:i + window]), set()).add(str(item))
    sizes = sorted({len(k) for k in known})
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i:i + n])) in known:
                    hit.update(range(i, i + n))
                    found |= known[key]
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


WORD5 = re.compile("[^\x20\x09-\x0D]+")


def quality_base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = WORD5.findall(text)
    lines = [x for x in text.split("\n") if WORD5.search(x)]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def llr_scores(texts, trusted, bucket, smoothing=20.0):
    """Mean log ratio per n-gram; ``bucket`` maps a tuple of words to its bucket."""
    grams = [[bucket(tuple(w[i:i + n])) for n in (1, 2) for i in range(len(w) - n + 1)] for w in (WORD5.findall(t or "") for t in texts)]
    raw, target = Counter(), Counter()
    for g, good in zip(grams, trusted):
        raw.update(g)
        if good:
            target.update(g)
    part = sum(target.values()) / sum(raw.values())
    ratio = lambda b: math.log((target[b] + smoothing * part) / part) - math.log(raw[b] + smoothing)
    return [sum(map(ratio, g)) / len(g) if g else None for g in grams]


def shingle_weights(text, size=5):
    w = WORD10.findall((text or "").translate(LOWER))
    return Counter(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def probability_jaccard(a, b):
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def near_classes(docs, similarity=0.8):
    """{id: class} by comparing all pairs that share a shingle; also the least similarity of any pair at or above the threshold."""
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def link(a, b):
        a, b = sorted((root(a), root(b)))
        parent[b] = a

    first, grams, by_gram = {}, {}, {}
    for d, t in sorted(docs):
        if (t or "") in first:
            link(first[t or ""], d)
            continue
        first[t or ""] = d
        grams[d] = shingle_weights(t)
        for g in grams[d]:
            by_gram.setdefault(g, set()).add(d)
    pairs, edges = set(), {}
    for ds in by_gram.values():
        pairs.update((a, b) for a in ds for b in ds if a < b)
    for a, b in pairs:
        A, B = grams[a], grams[b]
        if sum((A & B).values()) >= 0.5 * max(sum(A.values()), sum(B.values())) and (s := probability_jaccard(A, B)) >= similarity:
            edges[a, b] = s
            link(a, b)
    return {d: root(d) for d, _ in docs}, edges


def removed_repeats(docs, length=50):
    """{id: (n_bytes, n_removed, n_spans, kept_sha256)} from a table of every window's smallest document."""
    bodies = [(d, (t or "").encode()) for d, t in docs]
    least = {}
    for d, b in bodies:
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if least.get(w, d) >= d:
                least[w] = d
    out = {}
    for d, b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i:i + length]] < d:
                gone[i:i + length] = b"\x01" * length
        spans = bytes(gone).split(b"\x00")
        out[d] = (len(b), sum(gone), sum(bool(s) for s in spans), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


PII = (("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
       ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
       ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
       ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")))


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal_data(text):
    """(n_email, n_ip, n_card, n_phone, base_sha256, spans as text) of the base patterns."""
    found = []
    for k, (kind, pattern) in enumerate(PII):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                  "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), k, m.end()))
    found.sort()
    joined = ",".join(f"{PII[k][0]}:{a}:{b}" for a, k, b in found)
    return (*[sum(f[1] == k for f in found) for k in range(4)], sha(joined), joined)
