"""Exact repeated passages: suffixes sorted by a common-prefix-aware distributed merge.

Removes every byte that lies in a string of ``LENGTH`` bytes which also starts anywhere else. A string
may be judged at one place alone: its anchor, the place among its first ``REACH`` whose eight bytes
have the least hash (the first of equals). Equal strings have equal anchors, and each anchor stands
for one run of string starts before it.

1. Anchors are dealt by a fingerprint of the ``SHARED`` bytes that any of their strings has behind them.
   Where no second one exists no string repeats. A task that holds several equal ones says so once.
2. For the others each task sorts its suffixes and writes them as runs, front-coded: shared prefix and
   remaining bytes. Runs are exchanged by range; the splitters hold the bytes before the anchor
   too (backwards), so that a passage which a third of all documents share spreads over many tasks.
3. A loser tree merges the runs of a range. Each loser keeps the length of the prefix it shares with
   the winner, so a byte known to be equal is never compared again. The order comes with the prefix
   lengths of neighbours.
4. In each set of neighbours that share ``SHARED`` bytes, strings with equal bytes before and behind
   their anchors repeat. What sets cut by the border of a range, or too large, leave open is counted
   over all tasks by 128-bit digests, each distinct string of a set once.
5. The repeated starts come back to their documents as ranges, and the covered bytes are cut.

``without_passages`` cuts by words instead: every word that lies in a run of ``PASSAGE`` words which also starts
anywhere else, whatever white space is between them (short words leave many such runs under ``LENGTH``
bytes). Each word is written as ``CODE`` characters (48 bits of its fingerprint), so that such a run is a
string of ``LENGTH`` bytes, which steps 1 to 4 find. ``find_repeats`` reports both rules, each judged on the input.

Defined cases: a null text is empty. A text shorter than ``LENGTH`` loses nothing. Strings may overlap
themselves and count as met twice then. Rows with the same id are joined by id and text digest, so each
is judged on its own, and equal rows are copies of each other. A null id is an id like any other. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numberboard.llm.frames import discard, spread, texts, written
from numberboard.llm.textnum import _BYTE, Words, chunks, mix, raw

LENGTH = 400
CODE = 8
PASSAGE = LENGTH // CODE
REACH = 192
GRAM = 8
SHARED = 208
FLUSH = 1 << 19
RUN = 1 << 16
LARGE_SET = 1 << 14
SAMPLE = 50_000
MASK_BITS = 23
#: Bytes of text that are dealt at once: arrays of eight bytes for each stay below what WORKER_MEMORY maps afresh.
CHUNK_BYTES = 30 << 10
_DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_PAIRS = _DIGITS[np.arange(4096) & 63] + _DIGITS[np.arange(4096) >> 6].astype("<u2") * np.uint16(256)
_KEY = np.uint64(0x9E3779B97F4A7C15)
_STEP_BY = np.uint64(0xD1342543DE82EF95)
ENTRY = np.dtype(
    [("behind", "<u8"), ("around", "<u8"), ("doc_id", "<i8"), ("mark", "<i4"), ("at", "<u4")]
    + [(name, "u1") for name in ("back", "ahead", "many", "witness", "nameless")]
)
BLOCKS_SCHEMA = "part int, block binary"
ANCHORS_SCHEMA = "doc_id long, mark int, at int, back int, ahead int, certain boolean, sorts boolean"
RANGES_SCHEMA = "doc_id long, mark int, first int, last int, part int, block binary"
STRING = np.dtype(
    [("digest", "<u8", 2), ("doc_id", "<i8"), ("mark", "<i4"), ("start", "<u4"), ("many", "u1"), ("nameless", "u1")]
)
NAMED_SCHEMA = "doc_id long, mark int, text string"
LEFT_SCHEMA = "doc_id long, mark int, left string"
CUT_SCHEMA = "doc_id long, mark int, kept binary, n_removed long, n_spans long"


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (a view)."""
    return np.ndarray((max(len(data) - GRAM + 1, 0),), "<u8", data, 0, (1,))


def anchors(data: np.ndarray, offsets: np.ndarray, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor of each run of string starts: its place, the first and the last start, in bytes of the batch.

    Strings and anchors start every ``step`` bytes, of which all texts must be multiples.
    """
    starts, reach = np.zeros(len(data) // step, bool), REACH // step
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        starts[a // step : max(a, b - LENGTH + step) // step] = True
    if not starts.any():
        return (np.zeros(0, np.int64),) * 3
    key = words_at(data)[::step] * _KEY
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    key = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64)
    size = 1
    while 2 * size <= reach:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < reach:
        key = np.minimum(key[: size - reach], key[reach - size :])
    begin = np.flatnonzero(starts)
    least = (key[begin] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(begin), bool)
    new[1:] = (least[1:] != least[:-1]) | (begin[1:] != begin[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1
    return least[first] * step, begin[first] * step, begin[last] * step


def behind(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Fingerprint of the ``SHARED`` bytes from each place on."""
    words, found = words_at(data), np.zeros(len(places), np.uint64)
    for k in range(0, SHARED, GRAM):
        found = (found ^ words[places + k]) * _KEY
        found ^= found >> np.uint64(29)
    return found


def around(data: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Fingerprint of all bytes of an anchor's strings, and of where the anchor lies in them."""
    words, end = words_at(data), last + LENGTH - GRAM
    found = ((anchor - first) * 256 + (anchor - last)).astype(np.uint64)
    for k in range(0, LENGTH + REACH, GRAM):
        found = (found ^ words[np.minimum(first + k, end)]) * _KEY
        found ^= found >> np.uint64(31)
    return found


def _rows(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _key(doc_id, text) -> list:
    """doc_id and mark, which tells rows of one id apart by their text."""
    mark = F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).bitwiseAND(0x7FFFFFFF).cast("int")
    return [doc_id.cast("long").alias("doc_id"), mark.alias("mark")]


def _named(documents: DataFrame) -> DataFrame:
    whole = texts(documents)
    return whole.select(*_key(F.col("doc_id"), F.col("text")), F.coalesce("text", F.lit("")).alias("text"))


def coded(part: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (doc_id, mark, text) with ``CODE`` characters for each word and nothing between them as texts."""
    words = Words.of(part.column("text"))
    prints = words.hashes()
    data = np.empty((len(prints), CODE // 2), "<u2")
    for k in range(CODE // 2):
        data[:, k] = _PAIRS[(prints >> np.uint64(12 * k)) & np.uint64(4095)]
    first = (words.first * CODE).astype(np.int32)
    text = pa.StringArray.from_buffers(part.num_rows, pa.py_buffer(first), pa.py_buffer(data))
    return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), text], ["doc_id", "mark", "text"])


def _combined(entries: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """One entry for each distinct surrounding, and the part it goes to; the others are known to repeat."""
    entries = entries[np.lexsort((entries["around"], entries["behind"]))]
    new_behind = np.append(True, entries["behind"][1:] != entries["behind"][:-1])
    new = new_behind | np.append(True, entries["around"][1:] != entries["around"][:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(entries)))
    group = np.cumsum(new_behind) - 1
    kinds = np.bincount(group[first])  # surroundings of each group
    entries["many"][first] = size > 1
    several = kinds[group] > 1
    part = np.where(several, entries["around"], entries["behind"]) % np.uint64(parts)
    part = part.astype(np.int64) + np.where(several, parts, 0)
    known = ~new
    part[known] = 2 * parts + entries["doc_id"][known] % parts
    witness = entries[new_behind & several].copy()
    witness["doc_id"], witness["around"], witness["witness"] = 0, 0, 1
    return np.concatenate((entries, witness)), np.concatenate((part, (witness["behind"] % np.uint64(parts)).astype(np.int64)))


def deal_anchors(named: DataFrame, parts: int, by_words: bool = False) -> DataFrame:
    """Anchors as packed ENTRY blocks: dealt by what follows, by their surroundings, or (known to repeat) by document.

    ``by_words``: those of the coded texts, at words only.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            entries, part = _combined(np.concatenate(kept) if kept else np.zeros(0, ENTRY), parts)
            kept.clear()
            by = np.argsort(part, kind="stable")
            entries, part = entries[by], part[by]
            names, at = np.unique(part, return_index=True)
            ends = np.append(at[1:], len(part))
            return _rows(BLOCKS_SCHEMA, names.astype(np.int32), [entries[a:b].tobytes() for a, b in zip(at, ends)])

        for batch in batches:
            for part in chunks(batch, limit=CHUNK_BYTES):
                data, offsets = raw((coded(part) if by_words else part).column("text"))
                anchor, first, last = anchors(data, offsets, CODE if by_words else 1)
                owner = np.searchsorted(offsets, anchor, "right") - 1
                entries = np.zeros(len(anchor), ENTRY)
                if len(anchor):
                    entries["behind"], entries["around"] = behind(data, anchor), around(data, first, last, anchor)
                    ids = part.column("doc_id")
                    entries["doc_id"] = ids.fill_null(0).to_numpy()[owner]
                    entries["nameless"] = ids.is_null().to_numpy(zero_copy_only=False)[owner]
                    entries["mark"] = part.column("mark").to_numpy()[owner]
                    entries["at"], entries["back"], entries["ahead"] = anchor - offsets[owner], anchor - first, anchor - last
                    kept.append(entries)
                if sum(map(len, kept)) >= FLUSH:
                    yield flush()
        if kept:
            yield flush()

    return named.mapInArrow(deal, BLOCKS_SCHEMA)


def shared_anchors(blocks: DataFrame, parts: int, step: int = 1) -> DataFrame:
    """Anchors with company: ``certain`` if all their strings repeat, ``sorts`` if they stand for their surroundings.

    Those known to repeat come as one row for each unbroken run of a document's starts, of which one is every ``step`` bytes.
    """

    def rows(entries: np.ndarray, certain: np.ndarray, sorts: np.ndarray) -> pa.RecordBatch:
        ids = pa.array(entries["doc_id"], mask=entries["nameless"].astype(bool))
        small = [entries[c].astype(np.int32) for c in ("mark", "at", "back", "ahead")]
        return _rows(ANCHORS_SCHEMA, ids, *small, certain, sorts)

    def unbroken(entries: np.ndarray) -> pa.RecordBatch:
        start, end = (entries["at"].astype(np.int64) - entries[c] for c in ("back", "ahead"))
        by = np.lexsort((start, entries["mark"], entries["doc_id"], entries["nameless"]))
        entries, start, end = entries[by], start[by], end[by]
        new = np.append(True, start[1:] > end[:-1] + step)
        for c in ("nameless", "doc_id", "mark"):
            new[1:] |= entries[c][1:] != entries[c][:-1]
        first = np.flatnonzero(new)
        last = np.maximum.reduceat(end, first)
        ids = pa.array(entries["doc_id"][first], mask=entries["nameless"][first].astype(bool))
        small = [c.astype(np.int32) for c in (entries["mark"][first], last, last - start[first], 0 * last)]
        return _rows(ANCHORS_SCHEMA, ids, *small, np.ones(len(first), bool), np.zeros(len(first), bool))

    def meet(part: int, held: list[bytes]) -> pa.RecordBatch:
        entries = np.concatenate([np.frombuffer(b, ENTRY) for b in held])
        if part >= 2 * parts:
            return unbroken(entries)
        entries = entries[np.lexsort((entries["around"], entries["behind"]))]
        new_behind = np.append(True, entries["behind"][1:] != entries["behind"][:-1])
        new = new_behind | np.append(True, entries["around"][1:] != entries["around"][:-1])
        one, group = np.cumsum(new) - 1, np.cumsum(new_behind) - 1
        certain = np.bincount(one, 1 + entries["many"])[one] > 1
        several = (np.bincount(group[new])[group] > 1) | (part >= parts)
        kept = (certain | several) & (entries["witness"] == 0)
        return rows(entries[kept], certain[kept], (several & new)[kept])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist()):
                if held and part != now:
                    yield meet(now, held)
                    held = []
                now = part
                held.append(block)
        if held:
            yield meet(now, held)

    dealt = blocks.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(merge, ANCHORS_SCHEMA)


def _with_texts(named: DataFrame, listed: DataFrame, by_words: bool = False) -> DataFrame:
    """``listed`` (doc_id, mark, ...) with the texts, or their coded form; only texts that may be listed move."""
    key = ["doc_id", "mark"]
    hashed = F.xxhash64(*key).bitwiseAND((1 << MASK_BITS) - 1)
    words = listed.select(F.shiftright(hashed, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), hashed.bitwiseAND(63).cast("int")).alias("v"))
    mask = np.zeros(1 << (MASK_BITS - 6), np.int64)
    for row in words.groupBy("w").agg(F.bit_or("v").alias("v")).collect():  # 131,072 rows at most
        mask[row["w"]] = row["v"]
    shared = named.sparkSession.sparkContext.broadcast(mask)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            h = batch.column("h").to_numpy()
            near = batch.select([*key, "text"]).filter(pa.array((bits[h >> 6] >> (h & 63)) & 1 == 1))
            if by_words:
                yield from map(coded, chunks(near, limit=CHUNK_BYTES))
            else:
                yield near

    near = named.withColumn("h", hashed).mapInArrow(pick, NAMED_SCHEMA).dropDuplicates(key)
    near = near.select(F.col("doc_id").alias("i"), F.col("mark").alias("m"), "text")
    return listed.join(near, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m"))).drop("i", "m")


def _suffixes(data: bytes, places: list) -> list[tuple]:
    """(bytes behind, bytes before backwards, at, back, ahead) of the anchors of one text."""
    turned = data[::-1]
    return [
        (data[p["at"] : p["at"] + LENGTH], turned[len(data) - p["at"] : len(data) - p["at"] + p["back"]], p["at"], p["back"], p["ahead"])
        for p in places
    ]


def _splitters(held: DataFrame, ranges: int) -> list[tuple[bytes, bytes]]:
    """Borders of the ranges, from a bounded sample of suffixes; they settle where work is done, not what is found."""
    total = held.select(F.sum(F.size("places"))).first()[0] or 0
    share = max(1, total // min(SAMPLE, 32 * ranges))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                chosen = [p for p in places if zlib.crc32(b"%d %d" % (p["at"], p["mark"])) % share == 0]
                found += [s[:2] for s in _suffixes(text.encode(), chosen)]
            yield _rows("r binary, l binary", [s[0] for s in found], [s[1] for s in found])

    sample = sorted((bytes(x["r"]), bytes(x["l"])) for x in held.mapInArrow(some, "r binary, l binary").collect())
    return sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []


def sorted_runs(held: DataFrame, splitters: list[tuple[bytes, bytes]]) -> DataFrame:
    """Each task's suffixes in order, front-coded, as one block for each range."""
    shared = held.sparkSession.sparkContext.broadcast(splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []

        def flush() -> pa.RecordBatch:
            kept.sort(key=itemgetter(0, 1))
            names, blocks, start = [], [], 0
            for name, border in enumerate([*shared.value, None]):
                end = len(kept) if border is None else bisect.bisect_left(kept, border, key=itemgetter(0, 1))
                if end > start:
                    names.append(name)
                    blocks.append(encode_run(kept[start:end]))
                start = end
            kept.clear()
            return _rows(BLOCKS_SCHEMA, names, blocks)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "mark", "text", "places")]
            for doc_id, mark, text, places in zip(*columns):
                kept += [(*s, doc_id, mark) for s in _suffixes(text.encode(), places)]
                if len(kept) >= RUN:
                    yield flush()
        if kept:
            yield flush()

    return held.mapInArrow(run, BLOCKS_SCHEMA)


def mismatch(x: bytes, y: bytes, at: int) -> int:
    """Length of the common prefix, ``at`` bytes of which are known."""
    end = min(len(x), len(y))
    for step in (64, 8, 1):
        while at + step <= end and x[at : at + step] == y[at : at + step]:
            at += step
    return at


def encode_run(run: list[tuple]) -> bytes:
    """Front-coded run: for each suffix the prefix it shares with the one before, and the rest."""
    shared, before = [], b""
    for item in run:
        shared.append(mismatch(before, item[0], 0))
        before = item[0]
    numbers = np.array([(s, len(i[0]), len(i[1]), i[2], i[3], i[4], i[5] or 0, i[5] is None, i[6]) for s, i in zip(shared, run)], np.int64)
    rest = b"".join(i[0][s:] for s, i in zip(shared, run)) + b"".join(i[1] for i in run)
    return zlib.compress(np.int64(len(run)).tobytes() + numbers.tobytes() + rest, 1)


def decode_run(block: bytes) -> Iterator[tuple]:
    """(suffix, bytes before, shared with the last one, at, back, ahead, doc_id, mark) in order."""
    block = zlib.decompress(block)
    n = int(np.frombuffer(block, np.int64, 1)[0])
    numbers = np.frombuffer(block, np.int64, 9 * n, 8).reshape(n, 9)
    at, before = 8 + 72 * n, b""
    left = at + int((numbers[:, 1] - numbers[:, 0]).sum())
    for shared, size, back, *place, name, nameless, mark in numbers.tolist():
        before = before[:shared] + block[at : at + size - shared]
        at += size - shared
        yield (before, block[left : left + back], shared, *place, None if nameless else name, mark)
        left += back


class LoserTree:
    """Merges sorted runs; a head's ``shared`` is the prefix known to equal the last item given out."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.shared = [0] * len(runs)
        self.losers = [0] * len(runs)
        self.winner = self._build(1) if len(runs) > 1 else 0

    def _build(self, node: int) -> int:
        if node >= len(self.runs):
            return node - len(self.runs)
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared prefix becomes that with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.shared[a] != self.shared[b]:
            return (a, b) if self.shared[a] > self.shared[b] else (b, a)
        at = mismatch(x[0], y[0], self.shared[a])
        less = (x[0][at:], x[1]) <= (y[0][at:], y[1])
        winner, loser = (a, b) if less else (b, a)
        self.shared[loser] = at
        return winner, loser

    def __iter__(self) -> Iterator[tuple[tuple, int]]:
        """Items in order, each with the prefix it shares with the one before."""
        while self.heads and self.heads[self.winner] is not None:
            now = self.winner
            yield self.heads[now], self.shared[now]
            self.heads[now] = head = next(self.runs[now], None)
            self.shared[now] = head[2] if head else 0
            node = (now + len(self.runs)) // 2
            while node:
                now, self.losers[node] = self._play(now, self.losers[node])
                node //= 2
            self.winner = now


def _string_keys(items: list[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each distance before the anchor: it, which items have that string, and the strings' fingerprints."""
    n = len(items)
    ahead, back = np.array([i[5] for i in items]), np.array([i[4] for i in items])
    right = np.frombuffer(b"".join(i[0].ljust(LENGTH, b"\0") for i in items), np.uint8).reshape(n, LENGTH)
    left = np.frombuffer(b"".join(i[1].ljust(REACH, b"\0") for i in items), np.uint8).reshape(n, REACH)
    behind_, total = np.zeros((LENGTH + 1, n), np.uint64), np.zeros(n, np.uint64)
    for k in range(LENGTH):
        total = total * _STEP_BY + _BYTE[right[:, k]]
        behind_[k + 1] = total
    before = np.zeros(n, np.uint64)
    for o in range(REACH):
        has = (ahead <= o) & (o <= back)
        yield o, has, mix(mix(before) + behind_[LENGTH - o])
        before = before * _STEP_BY + _BYTE[left[:, o]]


def _ranges(names: list, marks: list, at: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    """Rows for the runs of ``found`` (distance before the anchor x item)."""
    edge = np.diff(found.astype(np.int8), axis=0, prepend=0, append=0)
    who, low = np.nonzero((edge == 1).T)
    high = np.nonzero((edge == -1).T)[1] - 1
    none = [None] * len(who)
    return _rows(RANGES_SCHEMA, [names[k] for k in who], [marks[k] for k in who], at[who] - high, at[who] - low, none, none)


def _repeats(items: list[tuple]) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Ranges of starts whose strings are met twice or more among ``items``.

    And, as matrices of distance x item, one item of each distinct string, and whether it has company.
    """
    found, one = np.zeros((REACH, len(items)), bool), np.zeros((REACH, len(items)), bool)
    for o, has, keys in _string_keys(items):
        which = np.flatnonzero(has)
        which = which[np.argsort(keys[which], kind="stable")]
        same = keys[which][1:] == keys[which][:-1]
        found[o, which[1:][same]] = True
        found[o, which[:-1][same]] = True
        one[o, which[:1]] = True
        one[o, which[1:][~same]] = True
    at = np.array([i[3] for i in items])
    return _ranges([i[6] for i in items], [i[7] for i in items], at, found), one, found & one


def _strings(items: list[tuple], one: np.ndarray, company: np.ndarray) -> np.ndarray:
    """The distinct strings of ``items`` by their digests, to be counted over all tasks."""
    who, before = np.nonzero(one.T)
    found = np.zeros(len(who), STRING)
    digests = bytearray()
    for k, o in zip(who.tolist(), before.tolist()):
        right, left = items[k][:2]
        digests += hashlib.blake2b(left[:o][::-1] + right[: LENGTH - o], digest_size=16).digest()
    found["digest"] = np.frombuffer(bytes(digests), "<u8").reshape(-1, 2)
    found["doc_id"] = np.array([i[6] or 0 for i in items], np.int64)[who]
    found["nameless"] = np.array([i[6] is None for i in items])[who]
    found["mark"] = np.array([i[7] for i in items])[who]
    found["start"] = np.array([i[3] for i in items])[who] - before
    found["many"] = company.T[who, before]
    return found


def _dealt(found: np.ndarray, parts: int) -> pa.RecordBatch:
    """Strings as packed blocks by digest."""
    part = (found["digest"][:, 0] % np.uint64(parts)).astype(np.int32)
    by = np.argsort(part, kind="stable")
    found, part = found[by], part[by]
    names, at = np.unique(part, return_index=True)
    ends, none = np.append(at[1:], len(part)), [None] * len(names)
    return _rows(RANGES_SCHEMA, none, none, none, none, names, [found[a:b].tobytes() for a, b in zip(at, ends)])


def counted_strings(dealt: DataFrame, parts: int) -> DataFrame:
    """Ranges of starts of the strings that several tasks have met."""

    def count(held: list[bytes]) -> pa.RecordBatch:
        found = np.concatenate([np.frombuffer(b, STRING) for b in held])
        found = found[np.lexsort((found["digest"][:, 1], found["digest"][:, 0]))]
        new = np.append(True, (found["digest"][1:] != found["digest"][:-1]).any(axis=1))
        one = np.cumsum(new) - 1
        found = found[(np.bincount(one, 1 + found["many"])[one] > 1) & (found["many"] == 0)]
        found = found[np.lexsort((found["start"], found["mark"], found["doc_id"], found["nameless"]))]
        same = np.ones(max(len(found) - 1, 0), bool)
        for c in ("nameless", "doc_id", "mark"):
            same &= found[c][1:] == found[c][:-1]
        first = np.flatnonzero(np.append(np.ones(min(len(found), 1), bool), ~(same & (np.diff(found["start"].astype(np.int64)) <= 1))))
        last = np.append(first[1:], len(found)) - 1 if len(first) else first
        ids = pa.array(found["doc_id"][first], mask=found["nameless"][first].astype(bool))
        none = [None] * len(first)
        starts = [found["start"][x].astype(np.int32) for x in (first, last)]
        return _rows(RANGES_SCHEMA, ids, found["mark"][first], *starts, none, none)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist()):
                if held and part != now:
                    yield count(held)
                    held = []
                now = part
                held.append(block)
        if held:
            yield count(held)

    return dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(work, RANGES_SCHEMA)


def merged_repeats(runs: DataFrame, splitters: list[tuple[bytes, bytes]], ranges: int) -> DataFrame:
    """Ranges (doc_id, mark, first, last) of repeated starts; or blocks of strings that must be counted over all tasks."""
    shared = runs.sparkSession.sparkContext.broadcast(splitters)

    def sets(blocks: list[bytes]) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for item, prefix in LoserTree([decode_run(b) for b in blocks]):
            if held and prefix < SHARED:
                yield held
                held = []
            held.append(item)
        if held:
            yield held

    def merge(name: int, blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        borders = {s[0][:SHARED] for s in shared.value[max(0, name - 1) : name + 1]}
        small: list[tuple] = []
        open_: list[np.ndarray] = []
        for found in sets(blocks):
            if found[0][0][:SHARED] in borders or len(found) > LARGE_SET:
                for a in range(0, len(found), LARGE_SET):
                    some = found[a : a + LARGE_SET]
                    here, one, company = _repeats(some)
                    yield here
                    open_.append(_strings(some, one, company))
                    if sum(map(len, open_)) >= FLUSH:
                        yield _dealt(np.concatenate(open_), ranges)
                        open_ = []
            elif len(found) > 1:
                small += found
                if len(small) >= LARGE_SET:
                    yield _repeats(small)[0]
                    small = []
        if small:
            yield _repeats(small)[0]
        if open_:
            yield _dealt(np.concatenate(open_), ranges)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist()):
                if held and part != now:
                    yield from merge(now, held)
                    held = []
                now = part
                held.append(block)
        if held:
            yield from merge(now, held)

    dealt = runs.repartition(ranges, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(work, RANGES_SCHEMA)


def repeated_starts(named: DataFrame, parts: int, by_words: bool = False) -> DataFrame:
    """Ranges (doc_id, mark, first, last) of byte places at which a repeated string starts, as a table; ``by_words`` in the coded texts."""
    found = written(shared_anchors(deal_anchors(named, parts, by_words), parts, CODE if by_words else 1), "suffix-anchors")
    certain = found.where("certain").select("doc_id", "mark", (F.col("at") - F.col("back")).alias("first"), (F.col("at") - F.col("ahead")).alias("last"))
    places = F.collect_list(F.struct("at", "back", "ahead", "mark")).alias("places")
    held = written(_with_texts(named, found.where("sorts").groupBy("doc_id", "mark").agg(places), by_words), "suffix-held")
    splitters = _splitters(held, parts)
    merged = written(merged_repeats(sorted_runs(held, splitters), splitters, parts), "suffix-merged")
    discard(held)
    ranges = ["doc_id", "mark", "first", "last"]
    counted = counted_strings(merged.where("part IS NOT NULL").select("part", "block"), parts).select(ranges)
    starts = written(certain.union(merged.where("part IS NULL").select(ranges)).union(counted), "suffix-starts")
    discard(found)
    discard(merged)
    return starts


def _byte_spans(text: str, ranges: list) -> list[tuple[int, int]]:
    """The bytes (begin, end) that ranges of starts cover."""
    return [(r["first"], r["last"] + LENGTH) for r in ranges]


def _word_spans(text: str, ranges: list) -> list[tuple[int, int]]:
    """The bytes (begin, end) of the words that ranges of the text's coded form cover."""
    words = Words.of(pa.array([text]))
    runs = [(-(-r["first"] // CODE), r["last"] // CODE) for r in ranges]
    return [(int(words.starts[a]), int(words.ends[b + PASSAGE - 1])) for a, b in runs if a <= b]


def _cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the maximal runs of them."""
    edge = np.zeros(len(data) + 1, np.int64)
    begin, end = np.array(spans, np.int64).reshape(-1, 2).T
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _cut_texts(documents: DataFrame, by_words: bool = False) -> DataFrame:
    """Texts with repeated bytes, or passages ``by_words``: doc_id, mark, kept (bytes), n_removed, n_spans."""
    named, parts = _named(documents), spread(documents)
    starts = repeated_starts(named, parts, by_words)
    ranges = written(starts.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "suffix-ranges")
    spans = _word_spans if by_words else _byte_spans

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_cut(t.encode(), spans(t, r)) for t, r in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist())]
            columns = list(zip(*found)) or [()] * 3
            yield _rows(CUT_SCHEMA, batch.column("doc_id"), batch.column("mark"), *columns)

    return _with_texts(named, ranges).mapInArrow(cut, CUT_SCHEMA)


def _joined(whole: DataFrame, cut: DataFrame) -> DataFrame:
    cut = cut.withColumnsRenamed({"doc_id": "i", "mark": "m"})
    return whole.join(cut, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")


def _counted(documents: DataFrame) -> DataFrame:
    """doc_id, mark, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    cut = _cut_texts(documents).select("doc_id", "mark", F.sha2("kept", 256).alias("kept"), "n_removed", "n_spans")
    whole = _named(documents).select("doc_id", "mark", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("all"))
    return _joined(whole, written(cut, "suffix-cut")).select(
        "doc_id",
        "mark",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept", "all").alias("kept_sha256"),
    )


def cut_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return _counted(documents).drop("mark")


def find_repeats(documents: DataFrame) -> DataFrame:
    """The columns of ``cut_repeats``, then n_passage_bytes and n_passages of every document.

    These are the bytes that ``without_passages`` would cut from the whole text, and the maximal runs of them;
    ``kept_sha256`` is of the text without repeated bytes alone.
    """
    counts = [F.col("n_removed").alias("n_passage_bytes"), F.col("n_spans").alias("n_passages")]
    counted, passages = _counted(documents), _cut_texts(documents, by_words=True).select("doc_id", "mark", *counts)
    both = _joined(counted, written(passages, "suffix-passages"))
    return both.select(*(c for c in counted.columns if c != "mark"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_passage_bytes", "n_passages")))


def _without(documents: DataFrame, cut: DataFrame) -> DataFrame:
    """The documents with what ``cut`` kept of their texts; n_chars follows the text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [b.decode("utf-8", "ignore") for b in batch.column("kept").to_pylist()]
            yield _rows(LEFT_SCHEMA, batch.column("doc_id"), batch.column("mark"), left)

    left = written(cut.mapInArrow(decode, LEFT_SCHEMA), "suffix-left")
    rows = documents.select(F.struct("*").alias("row"), *_key(F.col("doc_id"), F.col("text")))
    text = F.coalesce("left", "row.text")
    columns = {c: F.col("row")[c] for c in documents.columns} | {"text": text}
    if "n_chars" in columns:
        kind = documents.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("left").isNull(), F.col("row.n_chars")).otherwise(F.length("left").cast(kind))
    return _joined(rows, left).select(*(x.alias(c) for c, x in columns.items()))


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents without their repeated bytes, with all their columns; n_chars follows the text.

    A character of which only a part is cut goes whole. A document may lose all of its text and stays.
    """
    return _without(documents, _cut_texts(documents))


def without_passages(documents: DataFrame) -> DataFrame:
    """The documents without the words of repeated passages, with all their columns; n_chars follows the text.

    The white space between a passage's words goes with them, that around it stays.
    """
    return _without(documents, _cut_texts(documents, by_words=True))
