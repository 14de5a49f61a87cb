"""Near duplicates, repeated passages, leaks and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from llm.cases import SF_DIR, WORD, documents, edge_documents, near_duplicates, no_documents, ordered, prose, repeats, texts_of
from numberboard.llm import components, decontaminate, jaccard, suffix
from numberboard.llm.registry import QUERIES
from numberboard.llm.textnum import Words


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 102), (5, 5), (None, 3), (7, 8), (200, 150)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    want = {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 102: 100, 200: 150, 150: 150}
    assert {r["id"]: r["component"] for r in found.collect()} == want


def test_components_of_long_mixed_chains_and_hubs(spark, monkeypatch):
    """A chain of 10,000 vertices named in any order, a hub, a ring and many pairs; rounds stay few."""
    rng = random.Random(9)
    names = list(range(10_000))
    rng.shuffle(names)
    edges = [(names[k], names[k + 1]) for k in range(len(names) - 1)]
    edges += [(50_000, 20_000 + k) for k in range(3_000)] + [(60_000 + k, 60_000 + (k + 1) % 700) for k in range(700)]
    edges += [(80_000 + 2 * k, 80_001 + 2 * k) for k in range(500)]
    rng.shuffle(edges)
    rounds, write = [], components.written
    monkeypatch.setattr(components, "written", lambda *a: rounds.append(1) or write(*a))
    found = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(10_000)} | {k: 20_000 for k in (50_000, *range(20_000, 23_000))} | {60_000 + k: 60_000 for k in range(700)}
    want |= {80_000 + k: 80_000 + k - k % 2 for k in range(1_000)}
    assert found == want and len(rounds) <= 16


def test_components_of_texts(spark):
    names = [f"n{(k * 7919) % 301:03}" for k in range(301)]
    found = components.components(spark.createDataFrame(list(zip(names, names[1:])), "a string, b string")).collect()
    assert {r["id"]: r["component"] for r in found} == dict.fromkeys(names, "n000")


@pytest.mark.parametrize("which", ["edge", "generated"])
def test_near_duplicates(spark, which):
    docs = edge_documents(spark) if which == "edge" else documents(spark)
    assert ordered(jaccard.near_duplicates(docs).collect()) == ordered(near_duplicates(texts_of(docs)))


def test_near_duplicates_of_one_family(spark):
    """Copies with changed words, so that many pairs lie on either side of the bound."""
    rng = random.Random(4)
    rows = []
    for i in range(120):
        words = prose(80, i % 3).split()
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = prose(1, rng.randrange(10**6))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(jaccard.near_duplicates(docs).collect()) == ordered(near_duplicates(rows))


def test_frequent_shingles_are_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    docs = documents(spark)
    assert ordered(jaccard.near_duplicates(docs).collect()) == ordered(near_duplicates(texts_of(docs)))


def test_remaining_pairs_by_bands_and_slices(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SLICE", 7)
    rng = random.Random(5)
    sizes = [(i, i % 3, n, rng.randrange(jaccard.prefix_size(n))) for i in range(90) for n in [rng.choice((1, 2, 3, 4, 30, 40, 41, 54, 72, 100))]]
    rows = [(s, 100 * s + i, 100 * s + c, n, p) for s in range(2) for i, c, n, p in sizes] + [(9, 500 + k, 500 + k, 100, 20) for k in range(60)]
    postings = spark.createDataFrame(rows, "shingle long, doc_id long, component long, n int, place int")

    def fits(a, b):
        least = jaccard.LINK_PERCENT * (a[3] + b[3])
        near = 100 * min(a[3], b[3]) >= jaccard.LINK_PERCENT * max(a[3], b[3])
        return near and (100 + jaccard.LINK_PERCENT) * min(a[3] - a[4], b[3] - b[4]) >= least

    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] != b[2] and fits(a, b)}
    assert {tuple(r) for r in jaccard._remaining(postings).collect()} == want
    assert postings.where(jaccard._open(postings.n, postings.place) & (postings.shingle == 9)).count() == 0


def test_one_id_with_overlapping_texts(spark):
    """Id 7 has a text and the same with an end that is in many others; only the short one is like id 9."""
    start, end = prose(104, 21).split(), prose(50, 22)
    rows = [(7, " ".join(start)), (7, " ".join(start) + " " + end), (9, " ".join(start[:84]))]
    rows += [(20 + k, prose(150, 300 + k) + " " + end) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ordered(jaccard.near_duplicates(docs).collect())
    assert got == ordered(near_duplicates(rows)) and [r[2] for r in got if r[0] == 9] == [7]


def test_no_documents_to_compare(spark):
    assert jaccard.near_duplicates(no_documents(spark)).count() == 0
    assert suffix.cut_repeats(no_documents(spark)).count() == 0


@pytest.mark.parametrize("which", ["edge", "generated"])
def test_repeats(spark, which):
    docs = edge_documents(spark) if which == "edge" else documents(spark)
    assert ordered(suffix.cut_repeats(docs).collect()) == ordered(repeats(texts_of(docs)))


@pytest.mark.parametrize("large", [1 << 14, 4])
def test_passages_between_different_neighbours(spark, monkeypatch, large):
    """One passage in many texts, cut at many places; with ``large`` 4 every set is counted over all tasks."""
    monkeypatch.setattr(suffix, "LARGE_SET", large)
    rng = random.Random(9)
    passage, rows = prose(150, 77), []
    for i in range(60):
        a, b = sorted((rng.randrange(400), rng.randrange(450, len(passage))))
        rows.append((i, f"{prose(30, 1000 + i)} {passage[a:b]} {prose(30, 2000 + i)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert ordered(suffix.cut_repeats(docs).collect()) == ordered(repeats(rows))


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(2)
    items = [("".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))).encode(), b"x", 0, 1, 2, rng.randrange(9), 3) for _ in range(300)]
    runs = [sorted(items[k::7]) for k in range(7)]
    merged = list(suffix.LoserTree([suffix.decode_run(suffix.encode_run(r)) for r in runs]))
    got = [m[0][0] for m in merged]
    assert got == sorted(i[0] for i in items)
    for (_, shared), x, y in zip(merged[1:], got[:-1], got[1:]):
        assert shared == suffix.mismatch(x, y, 0)


def test_text_without_repeats_keeps_its_columns(spark):
    docs = edge_documents(spark)
    left = suffix.without_repeats(docs)
    assert left.schema.names == docs.schema.names and left.count() == docs.count()
    by = {r["doc_id"]: r for r in left.where("doc_id IS NOT NULL").collect()}
    assert by[12]["text"] == "" and by[12]["n_chars"] == 0 and by[4]["text"] == "one"


def passages(rows, size=50):
    """The texts without words in runs of ``size`` words that also start anywhere else, in plain loops."""
    words = [[(m.start(), m.end()) for m in WORD.finditer(t)] for _, t in rows]
    run = [[tuple(t[a:b] for a, b in w[k : k + size]) for k in range(len(w) - size + 1)] for (_, t), w in zip(rows, words)]
    met = Counter(x for r in run for x in r)
    out = []
    for (i, t), w, r in zip(rows, words, run):
        gone = {c for k, x in enumerate(r) if met[x] > 1 for c in range(w[k][0], w[k + size - 1][1])}
        out.append((i, "".join(c for k, c in enumerate(t) if k not in gone)))
    return out


def test_passages_of_short_words_are_cut(spark):
    """Runs of 50 words and more with fewer than 400 bytes, also where the white space differs; 49 words stay."""
    rng, rows = random.Random(3), []
    short = [" ".join(w[: 2 + len(w) % 4] for w in prose(n, 600 + n).split()) for n in (49, 50, 55, 64)]
    for k in range(80):
        middle = short[k % 4] if k % 8 < 4 else short[k % 4].replace(" ", rng.choice(["\n", "  ", "\t "]))
        rows.append((k, f"{prose(k, 3000 + k)} {middle} {prose(30, 4000 + k)}"))
    rows += [(90, "é ü " * 26), (91, None), (92, ""), (93, rows[2][1]), (93, rows[2][1]), (93, rows[2][1].replace(" ", "\n")), (None, short[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = passages([(i, t or "") for i, t in rows])
    got = [(r["doc_id"], r["text"] or "") for r in suffix.without_passages(docs).collect()]
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert stages.index("passages") < stages.index("packing")
    assert all(n == 0 for _, _, n, _, _ in repeats([(i, t or "") for i, t in rows if i != 93])) and ordered(got) == ordered(want)


def byte_runs(text, left_out):
    """Bytes of the characters at these places and the maximal runs of them."""
    return sum(len(text[k].encode()) for k in left_out), sum(k - 1 not in left_out for k in left_out)


def passage_counts(rows, size=50):
    """(doc_id, bytes, runs) of the words in runs of ``size`` words that also start anywhere else, in plain loops."""
    words = [[(m.start(), m.end()) for m in WORD.finditer(t)] for _, t in rows]
    run = [[tuple(t[a:b] for a, b in w[k : k + size]) for k in range(len(w) - size + 1)] for (_, t), w in zip(rows, words)]
    met = Counter(x for r in run for x in r)
    gone = [{c for k, x in enumerate(r) if met[x] > 1 for c in range(w[k][0], w[k + size - 1][1])} for r, w in zip(run, words)]
    return [(i, *byte_runs(t, g)) for (i, t), g in zip(rows, gone)]


def repeated_rows():
    """Passages of 49 to 64 short words, strings of 400 bytes and more in few words, and both in one text."""
    short = [" ".join(w[: 2 + len(w) % 4] for w in prose(n, 600 + n).split()) for n in (49, 50, 55, 64)]
    long = ["".join(prose(n, 800 + n).split()) for n in (79, 80, 120)]
    rows = [(k, f"{prose(20 + k, 3000 + k)} {short[k % 4]}\n{prose(30, 4000 + k)} {long[k % 3]} {prose(9, 5000 + k)}") for k in range(24)]
    return rows + [(30, f"{short[1]} é {prose(30, 1)} {short[2]}"), (31, "é ü " * 26), (32, None), (33, ""), (None, short[3]), (34, rows[2][1]), (34, rows[3][1])]


def test_registered_repeats_report_passages_by_words_too(spark, tmp_path):
    rows = [(i, t or "") for i, t in repeated_rows()]
    spark.createDataFrame(repeated_rows(), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op6_merged_suffixes"][0](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "n_passages"]
    want = [(*a, *b[1:]) for a, b in zip(repeats(rows), passage_counts(rows), strict=True)]
    assert ordered(got.collect()) == ordered(want)
    assert any(a[2] == 0 < a[5] for a in want) and any(a[2] > 0 == a[5] for a in want) and max(a[6] for a in want) > 1


def test_pipeline_cuts_passages_and_repeats_in_its_third_stage(spark, tmp_path):
    """Third runs of 50 words go, then strings of 400 bytes; fourth documents with a benchmark item."""
    (_, passages_stage), (_, fourth) = corpus_pipeline.STAGES[2:4]
    items = [(k, f"What is {prose(25, 500 + k)}? {prose(6, 900 + k)}", 0) for k in range(4)]
    spark.createDataFrame(items, BENCHMARK).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [r for r in repeated_rows() if r[0] != 31] + [(40 + k, f"{prose(60, 70 + k)} {t} {prose(60, 80 + k)}") for k, t, _ in items]
    docs = corpus_pipeline.written(passages_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)), "test")
    by_words = passages([(i, t or "") for i, t in rows])
    want = [(i, kept) for i, *_, kept in repeats(by_words)]
    assert ordered((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts_of(docs)) == ordered(want)
    assert any(n for _, _, n, _, _ in repeats(by_words))
    assert {r["doc_id"] for r in fourth(spark, docs, str(tmp_path)).collect()} == {i for i, _ in rows} - set(range(40, 44))


def test_pipeline_cuts_generated_documents_by_words_and_bytes(spark):
    """On the tables that the stages are run on: exactly the strings of 400 bytes go from what the words left."""
    _, passages_stage = corpus_pipeline.STAGES[2]
    docs = documents(spark)
    found = repeats(passages(texts_of(docs)))
    left = {i: n - gone for i, n, gone, _, _ in found}
    after = {i: len(t.encode()) for i, t in texts_of(passages_stage(spark, docs, SF_DIR))}
    assert after.keys() == left.keys() and all(left[i] - 4 <= n <= left[i] for i, n in after.items())
    assert corpus_pipeline.STAGES[2][0] == "passages" and passages_stage(spark, docs, SF_DIR).columns == docs.columns


def test_copies_in_a_task_are_one_row_each(spark):
    """Starts known to repeat come as one range for each document, however many anchors stand for them."""
    for n in (50, 100):
        docs = suffix._named(spark.createDataFrame([(k, prose(300, 5)) for k in range(n)], "doc_id long, text string").coalesce(1))
        found = suffix.shared_anchors(suffix.deal_anchors(docs, 2), 2)
        assert found.where("doc_id > 0").count() < 2 * n and found.where("NOT certain").count() == 0


def test_ranges_without_a_whole_word():
    none = [{"first": 3, "last": 5}]
    assert suffix._cut(b"a b", suffix._word_spans("a b", none)) == (b"a b", 0, 0)


BENCHMARK = "item_id long, text string, doc_id long"


def test_leaks(spark):
    items = [(k, f"What is {prose(25, 500 + k)}? {prose(6, 900 + k)}", 0) for k in range(20)]
    items += [(20, items[0][1], 0), (21, None, 0), (22, "the of", 0), (None, prose(30, 3), 0)]
    words = items[3][1].split()
    changed = [w if k % 5 else "changed" for k, w in enumerate(words)]
    answered = prose(14, 503).split() + prose(12, 4).split() + items[3][1].split("? ")[1].split()
    docs = [
        (1, f"{prose(200, 1)} {items[0][1]} {prose(200, 2)}"),
        (2, prose(300, 3) + " " + " ".join(changed)),
        (3, prose(500, 8)),
        (4, " ".join(words[:8]) + " " + prose(100, 9)),
        (5, None),
        (6, ""),
        (7, items[5][1].upper()),
        (8, "what is " + " ".join(answered) + " " + prose(60, 10)),
        (8, prose(60, 11)),
    ]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, BENCHMARK)).collect()
    got = ordered((r["doc_id"], r["contaminated"], r["item_ids"]) for r in found)
    assert got == ordered(
        [(1, True, [0, 20]), (2, True, [3]), (3, False, []), (4, False, []), (5, False, []), (6, False, []), (7, True, [5]), (8, True, [3]), (8, False, [])]
    )
    few = spark.createDataFrame(docs, "doc_id long, text string")
    assert decontaminate.find_leaks(few, spark.createDataFrame([], BENCHMARK)).where("contaminated").count() == 0
    assert decontaminate.find_leaks(no_documents(spark), spark.createDataFrame(items, BENCHMARK)).count() == 0


def test_leaks_in_blocks_of_items(spark, monkeypatch):
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    whole = ordered((r["doc_id"], r["item_ids"]) for r in decontaminate.find_leaks(documents(spark), benchmark).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert ordered((r["doc_id"], r["item_ids"]) for r in decontaminate.find_leaks(documents(spark), benchmark).collect()) == whole


@pytest.mark.parametrize("rank", [256, 20])
def test_leaks_of_more_passages_than_the_rank(spark, monkeypatch, rank):
    """300 passages, 72 % of the words of some stand in documents."""
    monkeypatch.setattr(decontaminate, "RANK", rank)
    items = [(k, prose(25, 5000 + k), 0) for k in range(298)] + [(298, prose(120, 5298), 0)]
    docs = [(k, " ".join([prose(40, 9000 + k), *(w if j % 25 < 18 else "changed" for j, w in enumerate(t.split())), prose(40, 9500 + k)])) for k, t, _ in items[4::7]]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, BENCHMARK)).collect()
    assert ordered((r["doc_id"], r["item_ids"]) for r in found) == ordered((k, [k]) for k, _ in docs)


@pytest.mark.parametrize("group", [1, 5, 1000])
def test_bound_of_passage_groups_loses_no_candidate(spark, monkeypatch, group):
    """Candidates are the windows whose TF-IDF cosine with a passage is high enough, computed one pair at a time."""
    monkeypatch.setattr(decontaminate, "GROUP", group)
    rng = random.Random(6)
    items = [(k, prose(40, 100 + k % 9), 0) for k in range(30)]
    rows = [(k, " ".join(rng.sample(" ".join(t for _, t, _ in rng.sample(items, 1 + k % 4)).split(), 30) + prose(k, k).split())) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = decontaminate.build_index(docs, spark.createDataFrame(items, BENCHMARK).collect())
    assert index.groups.shape[1] == -(-30 // group)
    words = [decontaminate.item_words(t) for _, t in rows]
    first = np.cumsum([0, *map(len, words)])
    got = set(index.candidates(np.concatenate(words), first))
    want = set()
    for text, own in enumerate(words):
        for a in range(0, max(1, len(own) - decontaminate.WINDOW + decontaminate.STEP), decontaminate.STEP):
            known = [w for w in own[a : a + decontaminate.WINDOW] if w in index.vocabulary.words]
            window = np.zeros(len(index.idf))
            place, value = decontaminate.weighted(np.array(known, np.uint64), index.vocabulary, index.idf)
            window[place] = value
            for k, item in enumerate(index.items):
                place, value = decontaminate.weighted(item.words, index.vocabulary, index.idf)
                if value @ window[place] >= decontaminate.COSINE:
                    want.add((text, int(first[text]) + a, k))
    assert got == want and 0 < len(want) < len(rows) * len(items)


def test_fingerprints_of_long_words():
    texts = ["a" * 5000 + " b", "", "x\ty", "b " + "a" * 5000, "a" * 4999 + "c"]
    one = [decontaminate.item_words(t) for t in texts]
    together = Words.of(pa.array(texts))
    assert np.array_equal(together.hashes(lower=True), np.concatenate(one)) and one[0][0] == one[3][1] != one[4][0]


@pytest.mark.parametrize("size", [1, 2, 3])
def test_paraphrase_with_a_short_answer(spark, size):
    items, docs, want = [], [], []
    for k in range(12):
        question, answer = prose(25, 700 + k).split(), prose(size, 800 + k)
        items.append((k, f"{' '.join(question)}? {answer}", 0))
        question[-1] += "?"
        said = " ".join(w if j % 2 else "changed" for j, w in enumerate(["", *question]))
        near = {0: f"{said} {prose(4, k)} {answer}", 1: f"{answer} {said}", 2: f"{said} {prose(4, k)}", 3: f"{said} {prose(200, k)} {answer}"}
        docs.append((k, f"{prose(100, 60 + k)} {near[k % 4]} {prose(100, 90 + k)}"))
        want.append((k, [k] if k % 4 < 2 else []))
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, BENCHMARK)).collect()
    assert ordered((r["doc_id"], r["item_ids"]) for r in found) == ordered(want)


@pytest.mark.parametrize("long", [0, 3])
def test_items_too_short_for_retrieval(spark, long):
    items = [(k, prose(n, 40 + k), 0) for k, n in enumerate([1, 2, 5, 7, 7])]
    items += [(5, items[2][1].upper(), 0), (6, "", 0), (7, items[3][1][:-1], 0), (None, items[4][1], 0)]
    items += [(10 + k, prose(20, 400 + k), 0) for k in range(long)]
    docs = [(k, f"{prose(30, 70 + k)} {t} {prose(30, 80 + k)}") for k, t, _ in items[:5]]
    docs += [(5, items[3][1]), (6, items[3][1].rsplit(" ", 1)[0]), (7, items[1][1].split()[0]), (8, items[1][1].split()[1]), (9, " ".join(items[2][1].split()[::-1]))]
    docs += [(9 + k, f"{prose(9, 9)} {t}") for k, t, _ in items[9:]]
    want = [(0, [0]), (1, [1]), (2, [2, 5]), (3, [3]), (4, [4]), (5, [3]), (6, []), (7, []), (8, []), (9, [])] + [(19 + k, [10 + k]) for k in range(long)]
    docs, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, BENCHMARK)
    assert ordered((r["doc_id"], r["item_ids"]) for r in decontaminate.find_leaks(docs, benchmark).collect()) == ordered(want)
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs, benchmark).collect()} == {6, 7, 8, 9}


def test_candidate_recall_against_all_pairs(spark):
    """Every document that has an item's words in order, found by comparing all of them."""
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    items = decontaminate.items_of(benchmark)
    want = set()
    for doc_id, text in texts_of(documents(spark)):
        words = decontaminate.item_words(text)
        known = set(words.tolist())
        for item in items:
            if np.mean([w in known for w in item.words.tolist()]) < decontaminate.LEAK:
                continue
            m = len(item.words)
            ends = range(0, max(1, len(words)), m // 2)
            if max(decontaminate.common_words(item.words, words[a : a + 2 * m].tolist()) for a in ends) >= decontaminate.LEAK * m:
                want.add(doc_id)
    found = decontaminate.find_leaks(documents(spark), spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).where("contaminated")
    assert want == {r["doc_id"] for r in found.collect()}


def test_pipeline_stages(spark):
    docs = documents(spark)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = texts_of(docs) if k < 4 else None
        docs = corpus_pipeline.written(stage(spark, docs, SF_DIR), name)
        if k < 4:
            assert docs.columns == columns
        if name == "near_duplicates":
            assert {i for i, _ in texts_of(docs)} == {c for _, _, c in near_duplicates(before)}
        if name == "repeats":
            left = {i: n - gone for i, n, gone, _, _ in repeats(before)}
            assert {i: len(t.encode()) for i, t in texts_of(docs)}.keys() == left.keys()
            assert all(left[i] - 4 <= len(t.encode()) <= left[i] for i, t in texts_of(docs))
    assert docs.count() > 0
