"""Benchmark decontamination by latent semantic retrieval, with subsequence and answer checks.

The benchmark is taken in blocks of ``BLOCK_ITEMS`` items and ``RANK`` passages at most (one item with
more passages is a block of its own). For each block:

1. The vocabulary are the words of its items (lower-cased, 64-bit fingerprints). Document frequencies
   of these words come from all documents.
2. TF-IDF vectors of the items' passages are reduced by a randomised SVD: tasks multiply their passages
   with a random matrix and back and send their sums, which are as large as vocabulary x rank; after
   orthogonalising, a second round gives the right singular vectors. The rank is that of the block's
   passages, so no direction of a passage is dropped and the cosines of step 3 are exact.
3. Every document is cut into overlapping windows of words. A window whose words can't hold enough of
   any passage's weight to reach the cosine is passed over, and so is one that reaches it with no group
   of ``GROUP`` passages, each word taken at the greatest weight it has in the group (bounds, so no
   candidate is lost by them); the others are projected, and those near to a passage become candidates.
4. A candidate's surroundings are compared with the item word by word. The item leaked if the longest
   common subsequence has ``LEAK`` of its words, or ``PARAPHRASE`` of them and the item's answer stands
   there word for word. The answer is what follows the last question mark or the word "answer", or
   else the last sentence. An answer of fewer than ``ANSWER_WORDS`` words stands in many texts by chance;
   for it, the words of the item in front of the answer must make up that share, together with it, in
   the stretch of the item's length before or behind the place where it stands.

Items with fewer than ``MIN_WORDS`` words are too short for retrieval. They leaked where all their words
stand in a row: hashed runs of their lengths are looked up and the words compared.

Defined cases: null texts are empty, and without words nothing leaks. Equal items are all named. Repeated rows each
give a row. Without items every document is clean. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from numberboard.llm.frames import texts
from numberboard.llm.textnum import Words, chunks, grams

BLOCK_ITEMS = 512
RANK = 256
GROUP = 16
WINDOW = 96
STEP = 48
COSINE = 0.35
LEAK = 0.7
PARAPHRASE = 0.45
ANSWER_WORDS = 4
MIN_WORDS = 8
#: Rows of a task's matrix that reach the driver at once.
SUM_ROWS = 1024
RESULT_SCHEMA = "doc_id long, contaminated boolean, item_ids array<long>, best_share double"


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    answer: np.ndarray


def item_words(text: str) -> np.ndarray:
    return Words.of(pa.array([text])).hashes(lower=True)


def answer_of(text: str) -> str:
    """What the item gives away: the words behind its question, or its last sentence."""
    parts = [p for p in re.split(r"\?|(?i:\banswer\b\s*:?)", text) if p.strip()]
    if len(parts) < 2:
        parts = [p for p in re.split(r"(?<=[.!])\s+|\n", text) if p.strip()]
    return parts[-1] if parts else ""


def items_of(rows: list) -> list[Item]:
    found = [Item(r["item_id"], item_words(r["text"] or ""), item_words(answer_of(r["text"] or ""))) for r in rows]
    return [i for i in found if len(i.words) >= MIN_WORDS]


def short_items_of(rows: list) -> list[Item]:
    """Items with words, but too few for retrieval."""
    found = [Item(r["item_id"], item_words(r["text"] or ""), item_words("")) for r in rows]
    return [i for i in found if 0 < len(i.words) < MIN_WORDS]


def passages_of(items: list[Item]) -> list[tuple[int, np.ndarray]]:
    """(place of the item, words) of every passage: whole items, long ones in windows."""
    return [
        (k, i.words[a : a + WINDOW]) for k, i in enumerate(items) for a in range(0, max(1, len(i.words) - STEP), STEP)
    ]


class Vocabulary:
    """Words of a block of items; ``find`` gives each word's place or -1."""

    BITS = 20

    def __init__(self, items: list[Item]):
        self.words = np.unique(np.concatenate([i.words for i in items]))
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(self.words & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> np.ndarray:
        place = np.full(len(words), -1, np.int64)
        near = np.flatnonzero(self.maybe[(words & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, words[near]), len(self.words) - 1)
        hit = self.words[at] == words[near]
        place[near[hit]] = at[hit]
        return place


def document_frequencies(whole: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """How many documents hold each word of the vocabulary, and how many there are."""
    shared = whole.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        size = len(known.words)
        held, rows = np.zeros(size, np.int64), 0
        for batch in batches:
            for part in chunks(batch):
                words = Words.of(part.column("text"))
                place = known.find(words.hashes(lower=True))
                hit = place >= 0
                held += np.bincount(np.unique(words.text_of()[hit] * size + place[hit]) % size, minlength=size)
                rows += part.num_rows
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(held[some], rows))], ["word", "n"]
        )

    found = whole.select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    held = np.zeros(len(vocabulary.words))
    for row in found:  # a row for each word of the block's vocabulary
        if row["word"] >= 0:
            held[row["word"]] = row["n"]
    shared.destroy()
    return held, sum(r["n"] for r in found if r["word"] < 0)


def weighted(words: np.ndarray, vocabulary: Vocabulary, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse TF-IDF vector of a passage: places and weights, of length one."""
    place, n = np.unique(vocabulary.find(words), return_counts=True)
    value = (1 + np.log(n)) * idf[place]
    return place, value / np.sqrt((value * value).sum())


def singular_vectors(passages: DataFrame, vocabulary: Vocabulary, idf: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors (words x rank) of the passages' TF-IDF matrix by randomised range finding."""
    shared = passages.sparkSession.sparkContext.broadcast((vocabulary, idf))
    size = len(vocabulary.words)

    def times(matrix: np.ndarray) -> np.ndarray:
        """A'A x ``matrix``, summed over the tasks."""
        given = passages.sparkSession.sparkContext.broadcast(matrix)

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, weights = shared.value
            total = np.zeros((size, matrix_columns))
            for batch in batches:
                for words in batch.column("words"):
                    place, value = weighted(words.values.to_numpy().view(np.uint64), known, weights)
                    total[place] += np.outer(value, value @ given.value[place])
            for at in range(0, size, SUM_ROWS):
                part = pa.array([total[at : at + SUM_ROWS].tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([at]), part], ["at", "sums"])

        matrix_columns = matrix.shape[1]
        out = np.zeros((size, matrix_columns))
        for row in passages.mapInArrow(multiply, "at long, sums binary").toLocalIterator():  # one task's sums at a time
            part = np.frombuffer(row["sums"]).reshape(-1, matrix_columns)
            out[row["at"] : row["at"] + len(part)] += part
        given.destroy()
        return out

    start = np.random.Generator(np.random.PCG64(7)).normal(size=(size, min(rank + 16, size)))
    basis = np.linalg.qr(times(start))[0]
    inner = basis.T @ times(basis)
    shared.destroy()
    _, vectors = np.linalg.eigh((inner + inner.T) / 2)
    return (basis @ vectors[:, ::-1][:, :rank]).astype(np.float32)


def common_words(item: np.ndarray, text: list[int]) -> int:
    """Length of the longest common subsequence, one bit for each word of the item."""
    where: dict[int, int] = {}
    for k, word in enumerate(item.tolist()):
        where[word] = where.get(word, 0) | (1 << k)
    full = (1 << len(item)) - 1
    row = full
    for word in text:
        hit = row & where.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def places(text: np.ndarray, run: np.ndarray) -> Iterator[int]:
    """Where ``run`` stands in ``text`` word for word."""
    at = np.flatnonzero(text[: len(text) - len(run) + 1] == run[0]) if len(text) >= len(run) > 0 else []
    return (int(a) for a in at if np.array_equal(text[a : a + len(run)], run))


def holds(text: np.ndarray, run: np.ndarray) -> bool:
    """Whether ``run`` stands in ``text`` word for word."""
    return next(places(text, run), None) is not None


def answered(text: np.ndarray, item: Item) -> bool:
    """Whether the item's answer stands in ``text``, a short one next to the words of its question."""
    m, k = len(item.words), len(item.answer)
    if k >= ANSWER_WORDS or k == 0:
        return holds(text, item.answer)
    question = item.words[: m - k]
    stretches = [s for a in places(text, item.answer) for s in (text[max(0, a - m) : a], text[a + k : a + k + m])]
    return any(common_words(question, s.tolist()) + k >= PARAPHRASE * m for s in stretches)


@dataclass
class Index:
    """What a pass over the documents needs of one block."""

    items: list[Item]
    short: list[Item]
    owner: np.ndarray
    vocabulary: Vocabulary | None
    idf: np.ndarray
    vectors: np.ndarray
    latent: np.ndarray
    weight: np.ndarray
    least: float
    groups: np.ndarray

    def runs(self, codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, place of the item) of texts in which a short item stands word for word."""
        for n in sorted({len(i.words) for i in self.short}):
            alike: dict[int, list[int]] = {}
            for k, item in enumerate(self.short, len(self.items)):
                if len(item.words) == n:
                    alike.setdefault(int(grams(item.words, n)[0]), []).append(k)
            every = grams(codes, n)
            for a in np.flatnonzero(np.isin(every, np.array(list(alike), np.uint64))).tolist():
                text = int(np.searchsorted(first, a, side="right")) - 1
                for k in alike[int(every[a])] if a + n <= first[text + 1] else []:
                    if np.array_equal(codes[a : a + n], self.short[k - len(self.items)].words):
                        yield text, k

    def candidates(self, codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, first word of the window, place of the item) of windows near to a passage."""
        place = self.vocabulary.find(codes)
        mass = np.concatenate(([0.0], np.cumsum(np.where(place >= 0, self.weight[place], 0.0))))
        size = np.diff(first)
        windows = np.where(size > WINDOW, -(-(size - WINDOW) // STEP) + 1, np.minimum(size, 1))
        text = np.repeat(np.arange(len(size)), windows)
        start = first[text] + STEP * (np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows))
        end = np.minimum(start + WINDOW, first[text + 1])
        near = np.flatnonzero(mass[end] - mass[start] >= self.least)
        for a in range(0, len(near), 1024):
            some = near[a : a + 1024]
            reach = end[some] - start[some]
            at = np.arange(int(reach.sum())) + np.repeat(start[some] - (np.cumsum(reach) - reach), reach)
            window, words = np.repeat(np.arange(len(some)), reach), place[at]
            window, words = window[words >= 0], words[words >= 0]
            cell, n = np.unique(window * len(self.idf) + words, return_counts=True)
            window, words = cell // len(self.idf), cell % len(self.idf)
            value = ((1 + np.log(n)) * self.idf[words]).astype(np.float32)
            norm = np.sqrt(np.bincount(window, value * value, minlength=len(some)))
            begins = np.searchsorted(window, np.arange(len(some)))
            most = np.add.reduceat(value[:, None] * self.groups[words], begins, axis=0).max(axis=1)
            open_ = most >= 0.999 * COSINE * norm  # room for rounding
            if not open_.any():
                continue
            some, norm, kept = some[open_], norm[open_], open_[window]
            window, words, value = (np.cumsum(open_) - 1)[window[kept]], words[kept], value[kept]
            begins = np.searchsorted(window, np.arange(len(some)))
            latent = np.add.reduceat(value[:, None] * self.vectors[words], begins, axis=0)
            near_to = (latent @ self.latent.T) >= COSINE * np.maximum(norm, 1e-9)[:, None]
            for w, p in zip(*np.nonzero(near_to)):
                yield int(text[some[w]]), int(start[some[w]]), int(self.owner[p])

    def leaks(self, codes: np.ndarray, first: np.ndarray) -> dict[int, dict[int, float]]:
        """For each text the items that leaked into it and the share of their words found."""
        found: dict[int, dict[int, float]] = {}
        for text, k in self.runs(codes, first):
            found.setdefault(text, {})[k] = 1.0
        for text, start, k in self.candidates(codes, first) if self.items else ():
            item, known = self.items[k], found.setdefault(text, {})
            if known.get(k, 0) == 1:
                continue
            m = len(item.words)
            around = codes[max(first[text], start - m) : min(first[text + 1], start + WINDOW + m)]
            share = common_words(item.words, around.tolist()) / m
            if share >= LEAK or (share >= PARAPHRASE and answered(around, item)):
                known[k] = max(known.get(k, 0), share)
        return {t: k for t, k in found.items() if k}


def build_index(whole: DataFrame, rows: list) -> Index | None:
    """Index of one block of benchmark rows; None if none of them has words."""
    spark, items, short = whole.sparkSession, items_of(rows), short_items_of(rows)
    if not items:
        none = np.zeros(0)
        return Index([], short, none, None, none, none, none, none, np.inf, none) if short else None
    vocabulary = Vocabulary(items)
    held, documents = document_frequencies(whole, vocabulary)
    idf = np.log((1 + documents) / (1 + held)) + 0.1
    passages = passages_of(items)
    schema = T._parse_datatype_string("words array<long>")
    table = spark.createDataFrame([(p.view(np.int64).tolist(),) for _, p in passages], schema).repartition(4)
    vectors = singular_vectors(table, vocabulary, idf, len(passages))
    latent, weight, least = [], np.zeros(len(idf)), np.inf
    groups = np.zeros((len(idf), -(-len(passages) // GROUP)), np.float32)
    for k, (_, words) in enumerate(passages):
        place, value = weighted(words, vocabulary, idf)
        groups[place, k // GROUP] = np.maximum(groups[place, k // GROUP], value)
        point = value @ vectors[place]
        latent.append(point / max(np.linalg.norm(point), 1e-9))
        # A window reaches the cosine only if its words hold that share of the passage's squared length.
        weight[place] = np.maximum(weight[place], value * value)
        least = COSINE**2 / 2
    return Index(items, short, np.array([k for k, _ in passages]), vocabulary, idf, vectors, np.array(latent, np.float32), weight, least, groups)


def blocks(benchmark: DataFrame) -> Iterator[list]:
    """The benchmark's rows, as many at a time as ``BLOCK_ITEMS`` and the ``RANK`` of a block's passages allow."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text")
    held, passages = [], 0
    for row in rows.toLocalIterator():
        more = len(passages_of(items_of([row])))
        if held and (len(held) == BLOCK_ITEMS or passages + more > RANK):
            yield held
            held, passages = [], 0
        held.append(row)
        passages += more
    if held:
        yield held


def _judged(index: Index, column: pa.Array) -> list[tuple[bool, list[int], float]]:
    words, known = Words.of(column), index.items + index.short
    found = index.leaks(words.hashes(lower=True), words.first)
    rows = []
    for text in range(len(column)):
        items = found.get(text, {})
        rows.append((bool(items), sorted({known[k].item_id for k in items if known[k].item_id is not None}), max(items.values(), default=0.0)))
    return rows


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids, best_share of every document."""
    whole = texts(documents)
    indices = [i for i in (build_index(whole, rows) for rows in blocks(benchmark)) if i is not None]
    if not indices:
        return whole.select("doc_id", F.lit(False).alias("contaminated"), F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("best_share"))
    shared = [documents.sparkSession.sparkContext.broadcast(i) for i in indices]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                by_block = [_judged(i.value, part.column("text")) for i in shared]
                rows = [(any(x[0] for x in r), sorted({k for x in r for k in x[1]}), max(x[2] for x in r)) for r in zip(*by_block)]
                columns = list(zip(*rows)) or [()] * 3
                kinds = [pa.bool_(), pa.list_(pa.int64()), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    ["doc_id", "contaminated", "item_ids", "best_share"],
                )

    return whole.mapInArrow(judge, RESULT_SCHEMA)


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no item leaked, with all their columns, without moving a text."""
    indices = [i for i in (build_index(texts(documents), rows) for rows in blocks(benchmark)) if i is not None]
    shared = [documents.sparkSession.sparkContext.broadcast(i) for i in indices]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                for index in shared:
                    clean = [not leaked for leaked, _, _ in _judged(index.value, part.column("text"))]
                    part = part.filter(pa.array(clean, pa.bool_()))
                yield part

    return documents.mapInArrow(judge, documents.schema)
