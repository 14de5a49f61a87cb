"""Language-model scores by stupid backoff, the counts taken from all documents.

S(w | context) = c(context w) / c(context) if the n-gram was counted at least ``CUTOFF`` times, else
``BACKOFF`` x S(w | shorter context), and c(w) / N for a word alone. A document's score is the sum of
the logarithms over its words.

Each chunk of documents explodes its n-grams into distinct ones with their number, as sorted packed
lists. The lists are dealt by n-gram hash; a part adds up the counts of all chunks, which is the count
table of that hash range, and joins each chunk's n-grams with it: the chunk gets the total of each of
its n-grams in the order in which it had listed them. There they meet the chunk's texts again, whose
n-grams are summed for each document. A hot n-gram is one row for each chunk.

An n-gram is known by 64 bits. Chunks are formed alike in both passes, which must therefore read the
same written table; a chunk whose lists don't fit its texts stops the job.

Defined cases: a null, empty or white text has no words and score 0. Words are told apart by case.
Repeated rows count and each give a row. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numberboard.llm.frames import spread, texts
from numberboard.llm.textnum import Words, chunks, grams

ORDER = 3
BACKOFF = 0.4
CUTOFF = 2
CHUNK_BYTES = 16 << 20
LISTS_SCHEMA = "part int, chunk long, n int, data binary"
TEXTS_SCHEMA = "chunk long, part int, n int, data binary"


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes, without planes of zeros at the end."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = max((k + 1 for k in range(8) if planes[k].any()), default=1)
    return zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(-1, n)
    whole = np.zeros((n, 8), np.uint8)
    whole[:, : len(planes)] = planes.T
    return whole.reshape(-1).view("<u8").astype(np.uint64)


def document_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The task's documents in chunks of about ``CHUNK_BYTES``, each with its name."""
    task, name, held, size = TaskContext.get().partitionId() << 24, 0, [], 0
    for batch in batches:
        for part in chunks(batch):
            held.append(part)
            size += part.column("text").nbytes
            if size >= CHUNK_BYTES:
                yield task + name, _one(held)
                name, held, size = name + 1, [], 0
    if held:
        yield task + name, _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


class Grams:
    """Words of a chunk; its n-grams are worked out one order at a time."""

    def __init__(self, batch: pa.RecordBatch):
        pieces = [Words.of(p.column("text")) for p in chunks(batch)]
        size = np.concatenate([np.diff(p.first) for p in pieces])
        self.first = np.concatenate(([0], np.cumsum(size)))
        self.hashes = np.concatenate([p.hashes() for p in pieces])
        self.place = (np.arange(len(self.hashes)) - np.repeat(self.first[:-1], size)).astype(np.int32)

    def ends(self, m: int) -> np.ndarray:
        """Which words end an n-gram of ``m`` words within their text."""
        return self.place >= m - 1

    def keys(self, m: int) -> np.ndarray:
        return grams(self.hashes, m)[self.ends(m)[m - 1 :]]


def _bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of sorted keys begins, and the end."""
    step = -(-(1 << 64) // parts)
    return np.append(np.searchsorted(keys, np.array([k * step for k in range(parts)], np.uint64)), len(keys))


def listed_grams(documents: DataFrame, order: int, parts: int) -> DataFrame:
    """Distinct n-grams of each chunk with their number, dealt by hash: part = (order - 1) x parts + range of the hash."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch in document_chunks(batches):
            found = Grams(batch)
            for m in range(1, order + 1):
                keys, counts = np.unique(found.keys(m), return_counts=True)
                bounds = _bounds(keys, parts)
                for k in range(parts):
                    a, b = bounds[k], bounds[k + 1]
                    if b > a:
                        steps = np.diff(keys[a:b], prepend=np.uint64(0))
                        first, rest = int(steps[0]).to_bytes(8, "little"), steps[1:]
                        packed = pack(rest)
                        data = first + len(packed).to_bytes(4, "little") + packed + pack(counts[a:b])
                        yield _row(LISTS_SCHEMA, (m - 1) * parts + k, chunk, b - a, data)

    return documents.mapInArrow(explode, LISTS_SCHEMA)


def _row(schema: str, *values) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields)], [n for n, _ in fields])


def joined_counts(lists: DataFrame, parts: int, order: int) -> DataFrame:
    """The total of each listed n-gram over all chunks, for each chunk in its own order (less than ``CUTOFF``: 0 above words)."""

    def join(part: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for _, n, data in held:
            size = int.from_bytes(data[8:12], "little")
            steps = np.concatenate((np.frombuffer(data[:8], "<u8"), unpack(data[12 : 12 + size], n - 1) if n > 1 else np.zeros(0, np.uint64)))
            keys.append(np.cumsum(steps, dtype=np.uint64))
            counts.append(unpack(data[12 + size :], n))
        every = np.concatenate(keys)
        by = np.argsort(every, kind="stable")
        new = np.append(True, every[by][1:] != every[by][:-1])
        total = np.add.reduceat(np.concatenate(counts)[by], np.flatnonzero(new))
        if part >= parts:
            total[total < CUTOFF] = 0
        back = np.empty(len(every), np.uint64)
        back[by] = total[np.cumsum(new) - 1]
        at = 0
        for chunk, n, _ in held:
            yield _row(TEXTS_SCHEMA, chunk, part, n, pack(back[at : at + n]))
            at += n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "chunk", "n", "data")]
            for part, *item in zip(*columns):
                if held and part != now:
                    yield from join(now, held)
                    held = []
                now = part
                held.append(item)
        if held:
            yield from join(now, held)

    dealt = lists.repartition(parts * order, "part").sortWithinPartitions("part", "chunk")
    return dealt.mapInArrow(work, TEXTS_SCHEMA)


def packed_texts(documents: DataFrame) -> DataFrame:
    """Each chunk's documents in one compressed row, ``part`` -1 so that they come before the counts."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch in document_chunks(batches):
            out = io.BytesIO()
            with pa.ipc.new_stream(out, batch.schema) as stream:
                stream.write_batch(batch)
            yield _row(TEXTS_SCHEMA, chunk, -1, batch.num_rows, zstandard.ZstdCompressor(level=3).compress(out.getbuffer()))

    return documents.mapInArrow(save, TEXTS_SCHEMA)


def _logs(found: Grams, totals: dict[int, list[tuple[int, bytes]]], words: int, order: int) -> np.ndarray:
    """Logarithm of S of every word; ``totals``: the packed totals of each order, in the order of its n-grams."""

    def counts(m: int) -> np.ndarray:
        keys, which = np.unique(found.keys(m), return_inverse=True)
        total = np.concatenate([np.zeros(0, np.uint64), *(unpack(data, n) for n, data in totals[m])])
        if len(keys) != len(total):
            raise RuntimeError("a chunk's n-grams have changed between two readings: read the documents from a written table")
        every = np.zeros(len(found.hashes), np.uint64)
        every[found.ends(m)] = total[which]
        return every

    logs, open_ = np.zeros(len(found.hashes)), np.ones(len(found.hashes), bool)
    tries, count = np.zeros(len(logs), np.int8), counts(order)
    for m in range(order, 1, -1):
        context = counts(m - 1)
        at = np.flatnonzero(open_ & (count > 0))
        logs[at] = np.log(count[at] / context[at - 1]) + tries[at] * np.log(BACKOFF)
        open_[at] = False
        tries += open_ & found.ends(m)
        count = context
    at = np.flatnonzero(open_)
    logs[at] = np.log(count[at] / words) + tries[at] * np.log(BACKOFF)
    return logs


def score_documents(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words and log_score (four decimals) of every document."""
    whole, parts = texts(documents), 2 * spread(documents)
    lists = listed_grams(whole, order, parts)
    counts = joined_counts(lists, parts, order)
    words = whole.select(F.sum(F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))).first()[0] or 0

    def score(chunk: int, held: list[tuple]) -> pa.RecordBatch:
        (_, _, data), *rest = held
        batch = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_next_batch()
        totals: dict[int, list[tuple[int, bytes]]] = {m: [] for m in range(1, order + 1)}
        for part, n, numbers in rest:
            totals[part // parts + 1].append((n, numbers))
        found = Grams(batch)
        logs = _logs(found, totals, words, order)
        scores = [round(float(logs[a:b].sum()), 4) for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist())]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(found.first)), pa.array(scores, pa.float64())], ["doc_id", "n_words", "log_score"]
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("chunk", "part", "n", "data")]
            for chunk, *item in zip(*columns):
                if held and chunk != now:
                    yield score(now, held)
                    held = []
                now = chunk
                held.append(item)
        if held:
            yield score(now, held)

    both = packed_texts(whole).union(counts).repartition(parts, "chunk").sortWithinPartitions("chunk", "part")
    return both.mapInArrow(work, "doc_id long, n_words long, log_score double")
