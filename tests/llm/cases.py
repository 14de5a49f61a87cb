"""Awkward tables and plain re-tellings of the operators, one row at a time."""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections import Counter, defaultdict

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Columns with names that the operators use inside.
EXTRA = "mark int, n long, part int, component string, score double, words string, h long, row string, left string"
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
_NONE = (1, 2, 3, "c", 0.5, "w", 7, "r", "l")


def prose(n: int, seed: int) -> str:
    """``n`` words that hardly repeat."""
    out, x = [], seed
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append("".join(chr(97 + (x >> k) % 26) for k in (12, 22, 32, 42, 52)))
    return " ".join(out)


def edge_rows() -> list[tuple]:
    long_text = prose(30_000, 5)
    shared = prose(90, 6)
    texts = [
        (1, None, "en"), (2, "", "en"), (3, " \t\n\x0b\x0c\r ", None), (4, "one", "de"), (5, "One TWO three", "de"),
        (6, prose(60, 1), "en"), (7, prose(60, 1), "en"), (7, prose(60, 1), "en"), (8, prose(59, 1) + " end", "fr"),
        (9, long_text, "en"), (10, prose(40, 7) + " " + shared + " " + prose(40, 8), None),
        (11, prose(40, 9) + "\n" + shared + "\r\n" + prose(40, 10), "fr"), (12, "é" * 700, "fr"), (13, "日本語 텍스트 \U0001f600 " * 30, "de"),
        (None, "no name " * 20, "en"), (None, None, None), (14, "same line\nsame line\nsame line\n" * 10, "en"),
        (15, prose(60, 11), "en"), (15, prose(60, 12), "en"), (16, "a\x00b " + prose(80, 13), "en"), (17, "don't we'll 'tis  x\u00a0y 12,5", "en"),
    ]
    return [(i, t, lang, "s", len(t or ""), *_NONE) for i, t, lang in texts]


def edge_documents(spark):
    return spark.createDataFrame(edge_rows(), DOCUMENTS)


def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def texts_of(df) -> list[tuple[int, str]]:
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingle_set(text: str) -> frozenset:
    words = WORD.findall(lower(text))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def near_duplicates(rows: list[tuple[int, str]]) -> list[tuple]:
    """(doc_id, n_shingles, component_id) by comparing all pairs that share a shingle."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for k, (i, x) in enumerate(sets):
        if i is None:
            continue
        met = Counter(j for s in x for j in holders[s])
        for s in x:
            holders[s].append(k)
        for j, both in met.items():
            other = sets[j]
            if 100 * both >= 75 * (len(x) + len(other[1]) - both):
                a, b = find(i), find(other[0])
                root[max(a, b)] = min(a, b)
    return [(i, len(x), None if i is None else find(i)) for i, x in sets]


def repeats(rows: list[tuple[int, str]], length: int = 400) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by counting every string."""
    data = [(i, t.encode()) for i, t in rows]
    met = Counter(b[s : s + length] for _, b in data for s in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if met[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def backoff_scores(rows: list[tuple[int, str]]) -> list[tuple]:
    """(doc_id, n_words, log_score) with all counts in one dictionary."""
    words = [(i, WORD.findall(t)) for i, t in rows]
    count = Counter(tuple(w[k : k + m]) for _, w in words for m in (1, 2, 3) for k in range(len(w) - m + 1))
    total = sum(len(w) for _, w in words)

    def score(w):
        out = 0.0
        for k in range(len(w)):
            for tries, m in enumerate(range(min(3, k + 1), 0, -1)):
                gram = tuple(w[k - m + 1 : k + 1])
                if m == 1 or count[gram] >= 2:
                    out += tries * math.log(0.4) + math.log(count[gram] / (total if m == 1 else count[gram[:-1]]))
                    break
        return out

    return [(i, len(w), score(w)) for i, w in words]


def ordered(rows) -> list:
    return sorted(map(tuple, rows), key=repr)
