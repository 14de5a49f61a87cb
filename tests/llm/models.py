"""The trained operators told once more in plain loops and dense matrices."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from llm.cases import WORD, lower
from numberboard.llm import language, quality
from numberboard.llm.rules import STOP_WORDS

_MASK = 0xFFFFFFFF
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def _share(doc_id, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


def _buckets(text: str) -> Counter:
    points, found = [ord(c) for c in lower(text)], Counter()
    for start in range(len(points)):
        code = 0
        for size in (1, 2, 3):
            if start + size > len(points):
                break
            code = (code * 0x01000193 + points[start + size - 1] * _FACTORS[size - 1] + size) & _MASK
            found[(((code ^ code >> 15) * 0x2C1B3C6D) & _MASK) >> 19] += 1
    return found


def _softmax(logits: list[float]) -> list[float]:
    e = [math.exp(x - max(logits)) for x in logits]
    return [x / sum(e) for x in e]


def plain_language(rows, hashed, size):
    """(doc_id, language, score) of rows (doc_id, text, lang), one coordinate at a time."""
    training = [r for r in rows if r[2] is not None and r[0] is not None and _share(r[0], 4) != language.HELD_OUT]
    held = Counter(b for _, text, _ in training for b in _buckets(text or ""))
    idf = [math.log((1 + len(training)) / (1 + held[b])) + 1 for b in range(language.BUCKETS)]

    def weights(text):
        value = {b: (1 + math.log(n)) * idf[b] for b, n in sorted(_buckets(text or "").items())}
        norm = max(math.sqrt(sum(x * x for x in value.values())), 1e-12)
        return {b: x / norm for b, x in value.items()}

    smallest = {}
    for doc_id, text, lang in training:
        known = [t for t in (smallest.get((lang, doc_id)), text) if t is not None]
        smallest[lang, doc_id] = min(known) if known else None
    names = sorted({lang for lang, _ in smallest})
    chosen = []
    for lang in names:
        ids = sorted((hashed[i], i) for one, i in smallest if one == lang)
        chosen += [(h, lang, smallest[lang, i]) for h, i in ids[: max(1, size // len(names))]]
    chosen.sort(key=lambda r: r[:2])
    texts = [{**{b: float(np.float32(x)) for b, x in weights(t).items()}, language.BUCKETS: 1.0} for _, _, t in chosen]
    target = [names.index(lang) for _, lang, _ in chosen]
    z, n = defaultdict(float), defaultdict(float)

    def weight(b, k):
        pull = z[b, k]
        if abs(pull) <= language.L1:
            return 0.0
        return -math.copysign(abs(pull) - language.L1, pull) / ((language.BETA + math.sqrt(n[b, k])) / language.ALPHA + language.L2)

    order = np.random.Generator(np.random.PCG64(1))
    for _ in range(language.EPOCHS):
        for i in order.permutation([i for i in range(len(chosen)) if i % 5 != 4]):
            w = {(b, k): weight(b, k) for b in texts[i] for k in range(len(names))}
            p = _softmax([sum(x * w[b, k] for b, x in texts[i].items()) for k in range(len(names))])
            for b, x in texts[i].items():
                for k in range(len(names)):
                    g = x * (p[k] - (k == target[i]))
                    z[b, k] += g - (math.sqrt(n[b, k] + g * g) - math.sqrt(n[b, k])) / language.ALPHA * w[b, k]
                    n[b, k] += g * g
    final = [[weight(b, k) for k in range(len(names))] for b in range(language.BUCKETS + 1)]

    def logits(value):
        return [sum(x * final[b][k] for b, x in value.items()) for k in range(len(names))]

    back = [(logits(texts[i]), target[i]) for i in range(len(chosen)) if i % 5 == 4]

    def loss(t):
        return -sum(math.log(_softmax([x / t for x in found])[k] + 1e-12) for found, k in back)

    t = min((float(t) for t in np.geomspace(0.05, 5, 60)), key=loss) if back else 1.0
    for doc_id, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            yield doc_id, language.UNKNOWN, 0.0
            continue
        p = _softmax([x / t for x in logits({**weights(text), language.BUCKETS: 1.0})])
        yield doc_id, names[p.index(max(p))], round(max(p), 6)


def _statistics(text: str) -> list[float]:
    data, words = text.encode(), [w.encode() for w in WORD.findall(text)]
    low, n = [w.lower() for w in words], len(words)
    some, evidence = n + quality.EVIDENCE, quality.EVIDENCE
    threes = {tuple(low[k : k + 3]) for k in range(n - 2)}

    def dense(inside):
        return math.sqrt((sum(map(inside, data)) + 0.02 * evidence) / (len(data) + 6.0 * evidence))

    found = {
        "words": math.log1p(n),
        "word_length": math.log1p((sum(map(len, words)) + 5.0 * evidence) / some),
        "symbols": dense(lambda c: c in b"#*$%&<>"),
        "upper": dense(lambda c: 65 <= c <= 90),
        "digits": dense(lambda c: 48 <= c <= 57),
        "marks": dense(lambda c: c in b"!?"),
        "bars": dense(lambda c: c == 124),
        "stop_words": math.sqrt((sum(w.decode() in STOP_WORDS for w in low) + 0.3 * evidence) / some),
        "points": math.sqrt((sum(c in b".,;:" for c in data) + 0.12 * evidence) / some),
        "lines": math.sqrt((data.count(b"\n") + 0.02 * evidence) / some),
        "distinct_words": math.log1p(len(set(low))) - math.log1p(n),
        "distinct_windows": (len(threes) + evidence) / (max(n - 2, 0) + evidence),
        "beyond_ascii": dense(lambda c: c >= 128),
        "long_words": math.sqrt(sum(len(w) > 20 for w in words) / some),
    }
    return [found[name] for name in quality.STATISTICS]


def plain_quality(rows, labels):
    """(doc_id, score) of rows (doc_id, text), by covariances, determinants and inverses of dense matrices."""
    measured = [(doc_id, _statistics(text or "")) for doc_id, text in rows]
    by_id = defaultdict(list)
    for doc_id, x in measured:
        if doc_id is not None and _share(doc_id, 5):
            by_id[doc_id].append(x)
    classes = [np.array([x for doc_id, q in labels if q == k for x in by_id[doc_id]]) for k in (0, 1)]
    spread = [np.cov(x, rowvar=False, bias=True) for x in classes]
    rows_in_all = sum(map(len, classes))
    pooled = sum(len(x) * s for x, s in zip(classes, spread)) / rows_in_all
    shrunk = []
    for s in spread:
        s = (1 - quality.POOLING) * s + quality.POOLING * pooled
        shrunk.append((1 - quality.DIAGONAL) * s + np.diag(quality.DIAGONAL * np.diag(s) + quality.FLOOR))
    for doc_id, x in measured:
        density = []
        for group, s in zip(classes, shrunk):
            off = np.array(x) - group.mean(axis=0)
            density.append(math.log(len(group) / rows_in_all) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * off @ np.linalg.inv(s) @ off)
        odds = min(max((density[0] - density[1]) / quality.TEMPERATURE, -500), 500)
        yield doc_id, round(1 / (1 + math.exp(odds)), 6)
