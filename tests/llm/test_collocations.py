"""Toivonen mining against counts in one dictionary."""

import re
from collections import Counter

import pytest

from llm.cases import DOCUMENTS, edge_documents, edge_rows, lower, no_documents
from numberboard.llm import collocations as C
from numberboard.llm.frames import WINDOW_MEMORY, WORKER_MEMORY, importable, worker_memory


def plain(rows, least, longest=4):
    """Frequent phrases {(lang, phrase): f} and words by language, by counting every phrase."""
    met, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            met.update((lang, " ".join(words[k : k + m])) for m in range(1, longest + 1) for k in range(len(words) - m + 1))
    return {k: f for k, f in met.items() if f >= least}, total


def ranked(rows, least, top):
    met, total = plain(rows, least)
    found = {}
    for (lang, phrase), a in met.items():
        words = phrase.split(" ")
        if len(words) > 1:
            cuts = [(met[lang, " ".join(words[:k])], met[lang, " ".join(words[k:])]) for k in range(1, len(words))]
            score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
            found[lang, phrase] = (a, l, r, score)
    out = []
    for lang in total:
        own = {p: x for (g, p), x in found.items() if g == lang}
        kept = [p for p in own if not any(f" {p} " in f" {q} " and q != p and 100 * own[q][0] >= 80 * own[p][0] for q in own)]
        kept.sort(key=lambda p: (-own[p][3], -own[p][0], p.encode()))
        out += [(lang, k, p, *own[p][:3], total[lang], own[p][3]) for k, p in enumerate(kept[:top], 1)]
    return out


def made(n):
    words = "the of Cat, dog. a b c d e ü 日本 x\ty new\nyork city hall".split(" ")
    out, x = [], 77
    for i in range(n):
        text = []
        for _ in range(30):
            x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
            text.append(words[(x >> 40) % len(words)])
        out.append((i, " ".join(text), ("en", None, "de", "")[i % 4] if i % 3 else "en", "s", 1, 1, 2, 3, "c", 0.5, "w", 7, "r", "l"))
    return out


@pytest.mark.parametrize("share", [1, 5, 1 << 40])
def test_counts_equal_a_dictionary(spark, share):
    """With the whole table as sample, a part, and none: then every pass has failures."""
    rows = made(300) + edge_rows()
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    met, total = plain([(r[2], r[1]) for r in rows], 4)
    found = C.frequent_phrases(df, C.Mining(least=4, share=share)).collect()
    assert sorted((r["lang"], r["phrase"], r["f"]) for r in found if r["size"]) == sorted((g, p, f) for (g, p), f in met.items())
    assert {r["lang"]: r["f"] for r in found if not r["size"] and r["f"]} == {k: v for k, v in total.items() if v}


def test_ranks_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(C, "WINDOW_BYTES", 1 << 12)
    rows = made(200)
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    found = C.collocations(df, C.Mining(least=3, share=4), top=25).collect()
    assert sorted(map(tuple, found)) == sorted(ranked([(r[2], r[1]) for r in rows], 3, 25))


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "FILTER_BITS", (1 << 6, 1 << 6))
    rows = made(120)
    df = spark.createDataFrame(rows, DOCUMENTS)
    found = C.collocations(df, C.Mining(least=3, share=3), top=40).collect()
    assert sorted(map(tuple, found)) == sorted(ranked([(r[2], r[1]) for r in rows], 3, 40))


def test_awkward_and_empty_tables(spark):
    expected = ranked([(r[2], r[1]) for r in edge_rows()], 2, 2000)
    found = C.collocations(edge_documents(spark), C.Mining(least=2, share=2)).collect()
    assert sorted(map(tuple, found)) == sorted(expected)
    empty = C.collocations(no_documents(spark))
    assert empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and empty.count() == 0


def test_large_counts_stay_exact(spark):
    big = 1 << 62
    rows = [("en", 1, "a", big + 1), ("en", 1, "b", big + 3), ("en", 2, "a b", big)]
    found = C.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, f long")).collect()
    assert [(r["l"], r["r"], r["score"]) for r in found] == [(big + 1, big + 3, 2_000_000 * big // (2 * big + 4))]


def test_workers_keep_the_arrays_of_a_window(spark, monkeypatch):
    """What workers of the counting passes are started with; afterwards, and where the user has set it, nothing changes."""
    importable(spark)
    known, seen = spark.sparkContext.environment, []
    before = dict(known)
    assert {known[name] for name in WORKER_MEMORY} == set(WORKER_MEMORY.values())
    counted = C.counted
    monkeypatch.setattr(C, "counted", lambda *a: (seen.append({name: known[name] for name in WORKER_MEMORY}), counted(*a))[1])
    C.frequent_phrases(spark.createDataFrame(made(20), DOCUMENTS), C.Mining(least=3, share=1))
    assert seen and all(x == WINDOW_MEMORY for x in seen) and known == before
    monkeypatch.setitem(known, "MALLOC_TRIM_THRESHOLD_", "5")
    with worker_memory(spark, WINDOW_MEMORY):
        assert known["MALLOC_TRIM_THRESHOLD_"] == "5" and known["MALLOC_MMAP_THRESHOLD_"] == WINDOW_MEMORY["MALLOC_MMAP_THRESHOLD_"]
