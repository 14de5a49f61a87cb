"""Packing of tokenised documents into sequences: bounded-space online best fit.

Each task walks through its documents with a fixed number of open windows. A document first fills
whole windows of its own; what is left goes into the open window that it fits best. When it fits none
and no window may be opened, the fullest one is topped up with the head of the document and emitted.
At the end a task moves its open windows' pieces together, so that one window at most stays open, and
those leftovers of all tasks are merged whole, best fit first, in groups of tasks.

Token ids are those of the tokenizer file. Texts of Latin letters are cut into pieces by the file's
own rules on whole arrays, and only pieces not met before go through the tokenizer's model; any other
text goes through the tokenizer itself. A piece is known by a 64-bit fingerprint of its bytes.

Defined cases: a null text is an empty one, whose only token is the separator. A text of any length
is cut freely. Repeated rows are packed each. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numberboard.llm.frames import texts, written
from numberboard.llm.textnum import _BYTE, _REACH, _STEP, chunks, mix, raw

WINDOW = 2048
OPEN_WINDOWS = 64
SEPARATOR = 1
CHUNK_BYTES = 1 << 17
CACHED_PIECES = 1 << 18
MERGED_TASKS = 1024
PIECES_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, leftover boolean"
)
LEFTOVER = 1 << 62

# Fixed values of the byte-level tokenizer: white space, and the endings it cuts off after an apostrophe.
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, SPACE = range(4)
LATIN_END = 0x250
PUNCTUATION = (0x2000, 0x2070)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of each code point below the end of general punctuation."""
    kinds = np.full(PUNCTUATION[1], OTHER, np.uint8)
    for c in (*range(LATIN_END), *range(*PUNCTUATION)):
        kinds[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
    kinds[[c for c in SPACES if c < len(kinds)]] = SPACE
    return kinds


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def piece_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the tokenizer's pieces begin, in code points; ``begins``: start of each text and the end."""
    size = len(points)
    kind = _kinds()[points]
    edge = np.zeros(size + 1, bool)
    edge[begins] = True
    run = edge[:size].copy()
    run[1:] |= kind[1:] != kind[:-1]
    cut = run.copy()
    last = np.ones(size, bool)  # last code point of its run, with a text going on behind it
    last[:-1] = run[1:] & ~edge[1:-1]
    last[-1:] = False
    before = np.flatnonzero(last & (kind == SPACE))  # white space right before another piece
    cut[before] = True
    joined = before[points[before] == 0x20]
    cut[joined + 1] = False
    # An apostrophe alone between other pieces takes an ending with it.
    mark = np.flatnonzero(run & (points == 0x27) & cut)
    mark = mark[mark + 1 < size]
    mark = mark[run[mark + 1] & (kind[mark + 1] == LETTER) & ~edge[mark + 1]]
    for ending in ENDINGS:
        at, hit = mark, np.ones(len(mark), bool)
        for k, letter in enumerate(ending, 1):
            where = np.minimum(at + k, size - 1)
            hit &= (at + k < size) & (points[where] == ord(letter))
            if k > 1:
                hit &= ~run[where]
        at = at[hit]
        cut[at + 1] = False
        after = at + 1 + len(ending)
        after = after[after < size]
        cut[after] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of whole batches of texts; keeps the ids of pieces it has met, up to a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.begin = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _learn(self, key: int, piece: bytes) -> int:
        word = piece.decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenizer.model.tokenize(word)]
        k, end = len(self.slot), self.used + len(ids)
        if k + 2 > len(self.begin):
            self.begin = np.resize(self.begin, 2 * len(self.begin))
        while end > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : end] = ids
        self.begin[k], self.begin[k + 1], self.used = self.used, end, end
        self.slot[key] = k
        return k

    def _latin(self, data: np.ndarray, offsets: np.ndarray, points: np.ndarray, begins: np.ndarray):
        cuts = piece_starts(points, begins)
        at = np.flatnonzero((data & 0xC0) != 0x80)[cuts]
        ends = np.append(at[1:], len(data))
        size = ends - at
        place = np.arange(len(data), dtype=np.int32)
        place -= np.repeat(at.astype(np.int32), size)
        place %= _REACH
        value = _BYTE[data]
        value *= _STEP[place]
        keys = mix(np.add.reduceat(value, at) + size.astype(np.uint64))
        del place, value
        keys, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.slot) + len(keys) > CACHED_PIECES:
            self.forget()
        get, whole = self.slot.get, data.tobytes()
        slots = [get(k, -1) for k in keys.tolist()]
        for i in [i for i, s in enumerate(slots) if s < 0]:
            slots[i] = self._learn(int(keys[i]), whole[at[first[i]] : ends[first[i]]])
        slots = np.array(slots)[which]
        begin = self.begin[slots]
        n = self.begin[slots + 1] - begin
        total = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], n)]
        return ids, total[np.searchsorted(at, offsets)]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, without the separator."""
        data, offsets = raw(column)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        plain = (points < LATIN_END) | ((points >= PUNCTUATION[0]) & (points < PUNCTUATION[1]))
        other = np.concatenate(([0], np.cumsum(~plain)))[begins]
        latin = other[1:] == other[:-1]
        if latin.all():
            ids, bounds = self._latin(data, offsets, points, begins) if len(data) else (data.astype(np.uint32), offsets)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                yield ids[a:b]
            return
        simple = self.encode(column.filter(pa.array(latin)))
        for k, fits in enumerate(latin.tolist()):
            if fits:
                yield next(simple)
            else:
                text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Open windows of one task. A piece is (row, start, ids); ``emit`` gets its place."""

    def __init__(self, window: int, open_windows: int, emit):
        self.window, self.most, self.emit, self.closed = window, open_windows, emit, 0
        self.free: list[tuple[int, int]] = []  # (room, name) of open windows, sorted
        self.held: dict[int, list] = {}
        self.names = 0

    def close(self, pieces: list, leftover: bool = False) -> None:
        offset = 0
        for row, start, ids in pieces:
            self.emit(row, start, ids, -1 if leftover else self.closed, offset)
            offset += len(ids)
        self.closed += not leftover

    def add(self, row, start: int, ids: np.ndarray) -> None:
        while len(ids) >= self.window:
            self.close([(row, start, ids[: self.window])])
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            k = bisect.bisect_left(self.free, (len(ids), -1))
            if k < len(self.free):
                room, name = self.free.pop(k)
                self.held[name].append((row, start, ids))
                if room == len(ids):
                    self.close(self.held.pop(name))
                else:
                    bisect.insort(self.free, (room - len(ids), name))
                return
            if len(self.free) < self.most:
                self.names += 1
                self.held[self.names] = [(row, start, ids)]
                bisect.insort(self.free, (self.window - len(ids), self.names))
                return
            room, name = self.free.pop(0)
            self.close([*self.held.pop(name), (row, start, ids[:room])])
            start, ids = start + room, ids[room:]

    def finish(self) -> None:
        """Move what is open together; the last window is left over."""
        pieces, room = [], self.window
        for _, name in self.free:
            for row, start, ids in self.held[name]:
                while len(ids) >= room:
                    self.close([*pieces, (row, start, ids[:room])])
                    start, ids, pieces, room = start + room, ids[room:], [], self.window
                if len(ids):
                    pieces.append((row, start, ids))
                    room -= len(ids)
        if pieces:
            self.close(pieces, leftover=True)


def pack_pieces(documents: DataFrame, tokenizer: str, window: int, open_windows: int, with_ids: bool) -> DataFrame:
    """Pieces as each task places them; those of the task's last open window are marked as left over."""
    schema = PIECES_SCHEMA + (", ids array<int>" if with_ids else "")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        rows: list = []

        def emit(row, start, ids, sequence, offset) -> None:
            name = (task << 32) + (sequence if sequence >= 0 else 0)
            rows.append((row[0], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row[1], name, offset, sequence < 0, ids))

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 9
            kinds = [pa.int64()] * 7 + [pa.bool_()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            if with_ids:
                arrays.append(pa.array([x.tolist() for x in columns[8]], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])

        packer = Packer(window, open_windows, emit)
        for batch in batches:
            for part in chunks(batch, limit=CHUNK_BYTES):
                names = part.column("doc_id").to_pylist()
                for name, ids in zip(names, encoder(tokenizer).encode(part.column("text"))):
                    ids = np.append(ids, np.uint32(SEPARATOR))
                    packer.add((name, len(ids)), 0, ids)
                yield out()
        packer.finish()
        yield out()
        encoder(tokenizer).forget()  # the worker goes on with other tasks, which need the memory
        pa.default_memory_pool().release_unused()

    return texts(documents).mapInArrow(pack, schema)


def merge_leftovers(fills: pd.DataFrame, window: int) -> pd.DataFrame:
    """Best fit, largest first: which windows (sequence_id, fill) share a sequence, and from which offset on."""
    free: list[tuple[int, int]] = []
    merged, shift = [], []
    fills = fills.sort_values(["fill", "sequence_id"], ascending=[False, True])
    for n, fill in enumerate(fills["fill"].tolist()):
        k = bisect.bisect_left(free, (fill, -1))
        room, name = free.pop(k) if k < len(free) else (window, n)
        merged.append(name)
        shift.append(window - room)
        bisect.insort(free, (room - fill, name))
    base = LEFTOVER + (int(fills["sequence_id"].iloc[0]) >> 32) // MERGED_TASKS * (1 << 32)
    return pd.DataFrame({"sequence_id": fills["sequence_id"], "merged": [base + m for m in merged], "shift": shift})


def pack_documents(
    documents: DataFrame, tokenizer: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, with_ids: bool = False
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and its ids)."""
    pieces = written(pack_pieces(documents, tokenizer, window, open_windows, with_ids), "packing")
    fills = pieces.where("leftover").groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    group = F.floor(F.shiftright("sequence_id", 32) / MERGED_TASKS).alias("tasks")
    merged = fills.groupBy(group).applyInPandas(
        lambda pdf: merge_leftovers(pdf, window), "sequence_id long, merged long, shift long"
    )
    merged = merged.withColumn("leftover", F.lit(True))
    placed = pieces.join(merged, ["sequence_id", "leftover"], "left")
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset", "leftover")]
    return placed.select(
        *kept,
        F.coalesce("merged", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
