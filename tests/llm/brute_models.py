"""Plain Python versions of spelling variants, importance resampling and the hidden Markov model."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

LOWER = {i: i + 32 for i in range(65, 91)}
ALNUM_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED_WORD = re.compile("[^\x20\x09-\x0D]+")


def id_text(doc):
    return "null" if doc is None else str(doc)


def variants(docs, least=7, min_count=2, factor=10, slip=31):
    """{word: (form, root, n, n_near, form_n)}, neighbours by deleting each code point."""
    seen = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{id_text(doc)}:{run}".encode())
            if h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    n = {w: c for w, c in seen.items() if len(w) >= least and c >= min_count}
    near, holes = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            holes[w[:k], w[k + 1:]].add(w)
            if (shorter := w[:k] + w[k + 1:]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= factor * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def importance(docs, target, percent=25, min_words=20, seed=7, buckets=10_000):
    """Sorted rows (doc_id, n_features, weight, score, rank)."""
    def features(text):
        w = ALNUM_WORD.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    raw, aim = Counter(), Counter()
    for _, text in docs:
        raw.update(features(text)[1])
    for text in target:
        aim.update(features(text)[1])
    S, T = sum(raw.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (S + buckets) / ((raw[b] + 1) * (T + buckets))))
    rows = []
    for doc, text in docs:
        n_words, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{id_text(doc)}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    draw = len(able) * percent // 100
    out = [(*r[:4], k + 1 if k < draw else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if r[4] < min_words]
    return sorted(out, key=repr)


def word_frequency_scores(docs):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    held = lambda d: zlib.crc32(id_text(d).encode()) % 10 == 0
    tokens = lambda t: SPACED_WORD.findall((t or "").translate(LOWER)) + [" end"]
    c = Counter()
    for d, t in docs:
        if not held(d):
            c.update(tokens(t))
    N, V = sum(c.values()), len(c)
    return {d: (held(d), len(w := tokens(t)), sum(c[x] > 0 for x in w), N, sum(math.log10((c[x] + 0.1) / (N + 0.1 * (V + 1))) for x in w))
            for d, t in docs}


def forward_backward(start, move, emit, seq):
    """(log likelihood, expected starts, transitions, emissions) of one sequence, step by step."""
    n, k = len(seq), len(start)
    alpha, beta, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for t, x in enumerate(seq):
        a = (start if t == 0 else alpha[t - 1] @ move) * emit[x]
        scale[t] = a.sum()
        alpha[t] = a / scale[t]
    for t in range(n - 2, -1, -1):
        beta[t] = move @ (emit[seq[t + 1]] * beta[t + 1]) / scale[t + 1]
    state = alpha * beta
    moves, emitted = np.zeros((k, k)), np.zeros_like(emit)
    for t in range(n - 1):
        moves += alpha[t][:, None] * move * (emit[seq[t + 1]] * beta[t + 1])[None, :] / scale[t + 1]
    for t, x in enumerate(seq):
        emitted[x] += state[t]
    return np.log(scale).sum(), state[0], moves, emitted
