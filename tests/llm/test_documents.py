"""Rules, language, quality, packing and scores on awkward and on generated documents."""

import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from llm.cases import SF_DIR, WORD, backoff_scores, documents, edge_documents, edge_rows, no_documents, ordered, prose, texts_of
from llm.models import plain_language, plain_quality
from numberboard.llm import backoff_tables, language, packing, quality, rules, stupid_backoff, textnum
from numberboard.llm.registry import QUERIES, tokenizer
from numberboard.llm.textnum import chunks


def test_words_and_fingerprints():
    texts = [None, "", "a  b\ta", "\na", "b", "x" * 9000 + " " + "x" * 9001, "A"]
    words = textnum.Words.of(pa.array(texts))
    assert np.diff(words.first).tolist() == [len(WORD.findall(t or "")) for t in texts]
    h = words.hashes()
    assert h[0] == h[2] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 5
    assert words.hashes(lower=True)[-1] == h[0]
    parts = list(textnum.chunks(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), limit=10))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts


def test_rules_on_awkward_texts(spark):
    got = {(r["doc_id"], r["n_words"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in rules.apply_rules(edge_documents(spark)).collect()}

    def repeated(words):
        met = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        return len({k + j for k in range(len(words) - 2) if met[tuple(words[k : k + 3])] > 1 for j in range(3)})

    want = set()
    for doc_id, text, *_ in edge_rows():
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        again, failed = repeated(words), len(words) < 50
        failed |= 100 * again > 50 * len(words)
        want.add((doc_id, len(words), len(lines) - len(set(lines)), again, failed))
    assert {g[:5] for g in got} == want and not any(g[4] and g[5] for g in got)
    assert rules.apply_rules(no_documents(spark)).count() == 0


def test_language(spark):
    found = language.identify(edge_documents(spark)).collect()
    assert len(found) == len(edge_rows())
    by = {(r["doc_id"], r["lang_pred"], r["score"]) for r in found}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= by
    assert {r["lang_pred"] for r in found} <= {"und", "en", "de", "fr"} and all(0 <= r["score"] <= 1 for r in found)
    assert language.identify(no_documents(spark)).count() == 0
    nothing = language.identify(edge_documents(spark).withColumn("lang", pytest.importorskip("pyspark.sql.functions").lit(None))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}


def test_language_held_out_accuracy(spark):
    rows = language.identify(documents(spark)).join(documents(spark).select("doc_id", "lang"), "doc_id").collect()
    for row in rows:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
    back = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert sum(back) >= 0.95 * len(back)


@pytest.mark.parametrize("size", [language.SAMPLE, 24])
def test_language_like_a_loop(spark, size):
    both = documents(spark).select("doc_id", "text", "lang").unionByName(edge_documents(spark).select("doc_id", "text", "lang"))
    hashed = {r["doc_id"]: r["h"] for r in both.selectExpr("doc_id", "xxhash64(CAST(doc_id AS LONG)) AS h").distinct().collect()}
    rows = [tuple(r) for r in both.collect()]
    want = Counter(plain_language(rows, hashed, size))
    got = Counter((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in language.identify(both, size).collect())
    assert got == want


def test_language_sample(spark):
    rows = [(i % 50, "one text", "en") for i in range(4000)] + [(100 + i, f"text {i}", "de") for i in range(900)] + [(7, "ein Text", "fr")]
    training = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = Counter(r["lang"] for r in language.sample(training, 300).collect())
    assert found == {"en": 50, "de": 100, "fr": 1}
    hashed = training.where("lang = 'de'").selectExpr("xxhash64(doc_id) AS h", "doc_id").distinct().orderBy("h").limit(100)
    assert {r["doc_id"] for r in hashed.collect()} == {r["doc_id"] for r in language.sample(training, 300).where("lang = 'de'").collect()}
    assert Counter(r["lang"] for r in language.sample(training, 2).collect()) == {"en": 1, "de": 1}
    assert language.train(training.where("lang = 'none'"), 300) is None


def test_language_counts_of_short_texts():
    texts = ["Ab", "", None, "x" * 5000, "日本 a"] * 300
    one = [language.Counts.of(pa.array([t], pa.string())) for t in texts]
    all_ = language.Counts.of(pa.array(texts))
    assert all_.text.tolist() == [i for i, c in enumerate(one) for _ in c.text]
    assert all_.bucket.tolist() == [b for c in one for b in c.bucket.tolist()]
    assert all_.count.tolist() == [n for c in one for n in c.count.tolist()]
    assert all_.lettered.tolist() == [bool(c.lettered[0]) for c in one]


def test_quality_like_plain_densities(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality")
    both = documents(spark).select("doc_id", "text").unionByName(edge_documents(spark).select("doc_id", "text"))
    want = Counter(plain_quality([tuple(r) for r in both.collect()], [tuple(r) for r in labels.collect()]))
    got = Counter((r["doc_id"], round(r["score"], 6)) for r in quality.score_documents(both, labels).collect())
    assert got == want


def test_quality_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scored = quality.score_documents(documents(spark), labels)
    rows = scored.join(labels, "doc_id").collect()
    for row in rows:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
        assert row["predicted"] == (row["score"] >= 0.3)
    right = [r["predicted"] == r["quality"] for r in rows]
    assert sum(right) >= 0.95 * len(right)
    assert quality.keep_good(documents(spark), labels).count() == scored.where("predicted = 1").count()


def test_quality_edges(spark):
    labels = spark.createDataFrame([(6, 1, 0), (14, 0, 0), (7, None, 0), (99, 1, 1), (10, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.score_documents(edge_documents(spark), labels).collect()
    assert len(found) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in found)
    none = quality.score_documents(edge_documents(spark), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score_documents(no_documents(spark), labels).count() == 0
    kept = quality.keep_good(edge_documents(spark), labels)
    assert kept.columns == edge_documents(spark).columns


@pytest.mark.parametrize("which", ["edge", "generated"])
def test_packing(spark, which):
    from tokenizers import Tokenizer

    docs = edge_documents(spark).repartition(3) if which == "edge" else documents(spark)
    rows = packing.pack_documents(docs, tokenizer(), with_ids=True).collect()
    model = Tokenizer.from_file(tokenizer())
    model.encode_special_tokens = True
    want = Counter()
    for doc_id, text in texts_of(docs):
        want[doc_id, tuple(model.encode(text, add_special_tokens=False).ids + [1])] += 1
    sequences: dict = {}
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert sum(n for _, n in sum(sequences.values(), [])) == sum(len(ids) * k for (_, ids), k in want.items())
    least = -(-sum(n for p in sequences.values() for _, n in p) // packing.WINDOW)
    assert len(sequences) <= least + 1
    unique = {d: i for d, i in want if sum(k[0] == d for k in want) == 1 and want[d, i] == 1}
    for doc_id, ids in unique.items():
        mine = sorted((r["start"], r["ids"], r["doc_tokens"]) for r in rows if r["doc_id"] == doc_id)
        assert tuple(x for _, part, _ in mine for x in part) == ids and {n for _, _, n in mine} == {len(ids)}
    assert packing.pack_documents(no_documents(spark), tokenizer()).count() == 0


def test_pieces_like_the_tokenizer():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer())
    model.encode_special_tokens = True
    rng = np.random.default_rng(3)
    letters = list(" \n\t'’stremdlvREéß12.,!\u00a0\x1c\x85½²ªºµ_-\"") + ["'s", "'re", " 'll", "  ", "<|endoftext|>", "日", "\u2003"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(4000)]
    got = [x.tolist() for x in packing.encoder(tokenizer()).encode(pa.array(texts))]
    assert got == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("which", ["edge", "generated"])
def test_backoff(spark, which, tmp_path):
    docs = edge_documents(spark) if which == "edge" else documents(spark)
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    want = ordered(backoff_scores(texts_of(docs)))
    for form in (stupid_backoff, backoff_tables):
        got = ordered(form.score_documents(docs).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(abs(g[2] - w[2]) < 2e-4 for g, w in zip(got, want))
        assert form.score_documents(no_documents(spark)).count() == 0


def test_packed_numbers():
    for numbers in ([0], [1, 1, 1], [2**63, 5, 2**64 - 1], [300]):
        x = np.array(numbers, np.uint64)
        assert np.array_equal(stupid_backoff.unpack(stupid_backoff.pack(x), len(x)), x)


def test_queries_read_whole_tables(spark):
    n = documents(spark).count()
    assert QUERIES["op4_threshold_rules"][0](spark, SF_DIR).count() == n


def test_a_chunk_of_texts_is_encoded_in_little_memory():
    """The arrays beside a chunk's bytes stay small, so that they needn't be mapped afresh from the system by the dozen MB."""
    column = pa.array([prose(200, k) for k in range(packing.CHUNK_BYTES // 1200)])
    rows = pa.RecordBatch.from_arrays([column], ["text"])
    encoder = packing.Encoder(tokenizer())
    tracemalloc.start()
    for part in chunks(rows, limit=packing.CHUNK_BYTES):
        for _ in encoder.encode(part.column("text")):
            pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
