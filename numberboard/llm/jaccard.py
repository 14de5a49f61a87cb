"""Near-duplicate documents: similarity join on word shingles with rare-first prefix filtering.

A document's set are its distinct runs of five lower-cased words. Two sets link when
100 * intersection >= 75 * union. Every link's two sets share one of the rarest quarter of their
shingles (their prefixes), so only prefix shingles are exchanged:

1. Equal sets become one: the document with the least id stands for them.
2. Shingles are ordered by how many documents hold them, rarest first. The counts come from all
   documents, added up in a table of fixed size; shingles that share a cell only share a place in the
   order, and any order that is the same for all documents gives all links.
3. Prefix shingles go out in packed blocks by hash; a shingle without a second holder of fitting size
   ends there. Very frequent shingles are dealt by document instead, past that step.
4. Two rounds link each document with one candidate of another component, the one that shares most
   prefix shingles. This joins groups of near copies without pairs inside them.
5. All pairs that share a prefix shingle but not yet a component, and pass the length and positional
   filters, are checked. Before sets move, the suffix filter bounds the intersection by the counts of
   64 classes of shingles. Each pair is verified once on its whole sets.

Only which component a document is in can be asked of the result, and pairs left out in step 5 are
inside one component already, so no link between different sets is lost.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing. A text
with fewer than five words has its whole sequence as its one shingle. Rows with the same id are one
vertex: links of any of its texts count, and each row gives a row. A null id is kept with a null
component. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numberboard.llm.components import components
from numberboard.llm.frames import spread, texts, written
from numberboard.llm.textnum import Words, chunks, shingles
from numberboard.operators.skew import spread_lookup

SHINGLE = 5
LINK_PERCENT = 75
ROUNDS = 2
CELL_BITS = 22
BLOCK_CELLS = 1 << 12
#: Steps of the order for each doubling of a count.
STEPS = 8
#: From this many holders on a shingle is dealt by document.
FREQUENT = 1 << 16
#: Sizes of a pair differ by less than this factor, so they are in one band or in neighbouring ones.
BAND = 1.5
#: Holders of a shingle in one slice.
SLICE = 4096
CLASSES = 64
#: A class that has so many shingles or more.
MANY = 255
MASK_BITS = 23
FLUSH = 1 << 20
SETS_SCHEMA = "doc_id long, n long, mark binary, classes binary, task int, block int, counts binary"
BLOCKS_SCHEMA = "part int, block binary"
ENTRY = np.dtype([("shingle", "<u8"), ("doc_id", "<i8"), ("place", "<u4"), ("n", "<u4")])


def least_shared(na: int, nb: int) -> int:
    """Shingles that two sets of these sizes must share to link."""
    return -(-LINK_PERCENT * (na + nb) // (100 + LINK_PERCENT))


def prefix_size(n):
    return n - (LINK_PERCENT * n + 99) // 100 + 1


def sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted shingle fingerprints of each text."""
    words = Words.of(column)
    return shingles(words.hashes(lower=True), words.first, SHINGLE)


def _cell(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _class_counts(x: np.ndarray) -> bytes:
    return np.minimum(np.bincount((x & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES), MANY).astype("u1").tobytes()


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def describe(documents: DataFrame) -> DataFrame:
    """Written table: a row for each document (size, digest, class counts of its set), and each task's counts of cells."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells, size = np.zeros(1 << CELL_BITS, np.uint32), [], 0
        for batch in batches:
            for part in chunks(batch):
                n, mark, classes, every = [], [], [], []
                for x in sets(part.column("text")):
                    n.append(len(x))
                    mark.append(hashlib.blake2b(x, digest_size=16).digest())
                    classes.append(_class_counts(x))
                    every.append(x)
                cells.append(_cell(np.concatenate(every)))
                size += len(cells[-1])
                if size >= FLUSH:
                    held += np.bincount(np.concatenate(cells), minlength=len(held)).astype(np.uint32)
                    cells, size = [], 0
                none = [None] * len(n)
                yield _batch(SETS_SCHEMA, part.column("doc_id"), n, mark, classes, none, none, none)
        if cells:
            held += np.bincount(np.concatenate(cells), minlength=len(held)).astype(np.uint32)
        task, blocks = TaskContext.get().partitionId(), held.reshape(-1, BLOCK_CELLS)
        some = [k for k in range(len(blocks)) if blocks[k].any()]
        none = [None] * len(some)
        packed = [zlib.compress(blocks[k].tobytes(), 1) for k in some]
        yield _batch(SETS_SCHEMA, none, none, none, none, [task] * len(some), some, packed)

    return written(texts(documents).mapInArrow(measure, SETS_SCHEMA), "jaccard-sets")


def rarity(described: DataFrame) -> np.ndarray:
    """Place of each cell in the order, one byte each: the logarithm of how many shingles it counts."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK_CELLS, np.uint64)
        for counts in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(counts), "<u4")
        low = np.minimum(total, 2**32 - 1).astype("<u4").tobytes()
        return pd.DataFrame({"task": [0], "block": [pdf["block"].iloc[0]], "counts": [zlib.compress(low, 1)]})

    schema = "task int, block int, counts binary"
    blocks = described.where("block IS NOT NULL").select("task", "block", "counts")
    for step in (256, 1 << 30):  # of so many tasks at a time
        blocks = blocks.groupBy("block", F.floor(F.col("task") / step)).applyInPandas(add, schema)
    order = np.zeros(1 << CELL_BITS, np.uint8)
    for row in blocks.collect():  # a row for each block of cells: 16 KB x 1024
        counts = np.frombuffer(zlib.decompress(row["counts"]), "<u4")
        order[row["block"] * BLOCK_CELLS :][:BLOCK_CELLS] = np.minimum(STEPS * np.log2(np.maximum(counts, 1)), 255)
    return order


def prefix_blocks(documents: DataFrame, order: np.ndarray, parts: int) -> DataFrame:
    """Prefix shingles as packed ENTRY blocks; parts from ``parts`` on hold the very frequent ones."""
    shared = documents.sparkSession.sparkContext.broadcast(order)
    frequent = STEPS * math.log2(FREQUENT)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen, kept, size = shared.value, set(), [], 0

        def flush() -> pa.RecordBatch:
            entries = np.concatenate(kept) if kept else np.zeros(0, ENTRY)
            part = (entries["shingle"] % np.uint64(parts)).astype(np.int32)
            hot = order[_cell(entries["shingle"])] >= frequent
            part[hot] = parts + entries["doc_id"][hot] % parts
            by = np.lexsort((entries["shingle"], part))
            entries, part = entries[by], part[by]
            names, at = np.unique(part, return_index=True)
            ends = np.append(at[1:], len(part))
            kept.clear()
            return _batch(BLOCKS_SCHEMA, names, [entries[a:b].tobytes() for a, b in zip(at, ends)])

        for batch in batches:
            for part in chunks(batch):
                for doc_id, x in zip(part.column("doc_id").to_pylist(), sets(part.column("text"))):
                    n = len(x)
                    if not n or doc_id is None:
                        continue
                    mark = hashlib.blake2b(x, digest_size=16).digest()
                    if mark in seen:
                        continue
                    seen.add(mark)
                    p = prefix_size(n)
                    rank = (order[_cell(x)].astype(np.uint64) << np.uint64(56)) | (x >> np.uint64(8))
                    first = x[np.argsort(rank, kind="stable")[:p]]
                    entries = np.empty(p, ENTRY)
                    entries["shingle"], entries["doc_id"], entries["place"], entries["n"] = first, doc_id, np.arange(p), n
                    kept.append(entries)
                    size += p
                if size >= FLUSH:
                    size = 0
                    yield flush()
        yield flush()

    return texts(documents).mapInArrow(deal, BLOCKS_SCHEMA)


def shared_postings(blocks: DataFrame, parts: int) -> DataFrame:
    """Rows (shingle, doc_id, place, n) of prefix shingles with a second holder of fitting size."""
    schema = "shingle long, doc_id long, place int, n int"

    def rows(entries: np.ndarray) -> pa.RecordBatch:
        return _batch(
            schema, entries["shingle"].view(np.int64), entries["doc_id"], entries["place"].astype(np.int32), entries["n"].astype(np.int32)
        )

    def shared(held: list[bytes]) -> pa.RecordBatch:
        entries = np.concatenate([np.frombuffer(b, ENTRY) for b in held])
        entries = entries[np.lexsort((entries["n"], entries["shingle"]))]
        n = entries["n"].astype(np.int64)
        fits = (entries["shingle"][1:] == entries["shingle"][:-1]) & (100 * n[:-1] >= LINK_PERCENT * n[1:])
        pair = np.zeros(len(entries), bool)
        pair[1:] |= fits
        pair[:-1] |= fits
        return rows(entries[pair])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist()):
                if part >= parts:
                    yield rows(np.frombuffer(block, ENTRY))
                    continue
                if part != now and held:
                    yield shared(held)
                    held = []
                now = part
                held.append(block)
        if held:
            yield shared(held)

    dealt = blocks.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(meet, schema)


def _mask(ids: DataFrame) -> np.ndarray:
    """Bits of hashed ids, 1 MB: what isn't set is not among them."""
    bit = F.xxhash64("doc_id").bitwiseAND((1 << MASK_BITS) - 1)
    words = ids.select(F.shiftright(bit, 6).alias("w"), F.expr("shiftleft(1L, cast({b} & 63 as int))".format(b=f"(xxhash64(doc_id) & {(1 << MASK_BITS) - 1})")).alias("v"))
    mask = np.zeros(1 << (MASK_BITS - 6), np.int64)
    for row in words.groupBy("w").agg(F.bit_or("v").alias("v")).collect():
        mask[row["w"]] = row["v"]
    return mask


def _sets_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Packed sets of the documents among ``ids`` (and few others)."""
    mask = documents.sparkSession.sparkContext.broadcast(_mask(ids))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = mask.value
        for batch in batches:
            h = batch.column("h").to_numpy()
            hit = (bits[h >> 6] >> (h & 63)) & 1 == 1
            batch = batch.filter(pa.array(hit))
            for part in chunks(batch):
                yield _batch("doc_id long, shingles binary", part.column("doc_id"), [x.tobytes() for x in sets(part.column("text"))])

    h = F.xxhash64("doc_id").bitwiseAND((1 << MASK_BITS) - 1).alias("h")
    named = texts(documents, h).where("doc_id IS NOT NULL")
    return named.mapInArrow(pick, "doc_id long, shingles binary")


def _suffix_filter(pairs: DataFrame, described: DataFrame) -> DataFrame:
    """Pairs whose class counts allow enough shared shingles."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "u1").reshape(-1, CLASSES) for c in ("ca", "cb"))
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            a, b = (np.where(x == MANY, 1 << 40, x.astype(np.int64)) for x in (a, b))
            fits = (100 + LINK_PERCENT) * np.minimum(a, b).sum(axis=1) >= LINK_PERCENT * (na + nb)
            yield batch.select(["a", "b"]).filter(pa.array(fits))

    marks = described.where("block IS NULL").select("doc_id", "n", "classes")
    side = [marks.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("classes").alias(f"c{x}")) for x in ("a", "b")]
    whole = pairs.join(side[0], "a").join(side[1], "b").select("a", "b", "na", "nb", "ca", "cb")
    return whole.mapInArrow(bound, "a long, b long").distinct()


def verified(pairs: DataFrame, described: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, from their whole sets."""
    pairs = written(_suffix_filter(pairs, described), "jaccard-pairs")
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    held = written(_sets_of(documents, ids), "jaccard-held")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                linked.append(int((both[1:] == both[:-1]).sum()) >= least_shared(len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    side = [held.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}")) for x in ("a", "b")]
    whole = pairs.join(side[0], "a").join(side[1], "b").select("a", "b", "sa", "sb")
    return written(whole.mapInArrow(check, "a long, b long").distinct(), "jaccard-links")


def _fits(na, nb, pa_, pb):
    """Length and positional filter of two holders of a shingle."""
    length = (100 * na >= LINK_PERCENT * nb) & (100 * nb >= LINK_PERCENT * na)
    return length & ((100 + LINK_PERCENT) * (1 + F.least(na - pa_ - 1, nb - pb - 1)) >= LINK_PERCENT * (na + nb))


def _open(n, place):
    """Whether the positional filter lets a holder meet one of its own size or a larger one.

    The smaller holder of every pair is such a one, so a shingle without any (the tail of a passage that
    most of its holders' sets consist of) makes no pairs.
    """
    return (100 + LINK_PERCENT) * (n - place) >= 2 * LINK_PERCENT * n


def _candidates(postings: DataFrame) -> DataFrame:
    """For each document one of another component: that with which it shares most prefix shingles."""
    end = F.struct("component", "doc_id", "n", "place")
    ends = postings.groupBy("shingle").agg(F.min(end).alias("lo"), F.max(end).alias("hi"))
    ends = ends.where("lo.component <> hi.component")
    met = postings.join(ends, "shingle").withColumn("o", F.when(F.col("lo.component") != F.col("component"), F.col("lo")).otherwise(F.col("hi")))
    met = met.where(_fits(F.col("n"), F.col("o.n"), F.col("place"), F.col("o.place")))
    counted = met.groupBy("doc_id", F.col("o.doc_id").alias("b")).agg(F.count("*").alias("c"))
    best = counted.groupBy(F.col("doc_id").alias("a")).agg(F.max(F.struct("c", "b")).alias("best"))
    return best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct()


def _remaining(postings: DataFrame) -> DataFrame:
    """All pairs that share a prefix shingle, pass the filters and are not in one component.

    The smaller holder, an open one, looks for the larger one in its own band of sizes and the next; a
    frequent shingle's holders are cut into slices.
    """
    open_ = _open(F.col("n"), F.col("place"))
    mixed = postings.groupBy("shingle").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("held"), F.max(open_).alias("open")
    )
    mixed = mixed.where("lo <> hi AND open").select("shingle", F.ceil(F.col("held") / SLICE).cast("int").alias("slices"))
    held = postings.join(mixed, "shingle").withColumn("band", F.floor(F.log("n") / math.log(BAND)).cast("int"))
    x = held.withColumn("slice", F.pmod(F.xxhash64("doc_id"), "slices").cast("int")).alias("x")
    y = held.where(open_).withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    y = y.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).alias("y")
    key = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("shingle", "band", "slice")]
    apart = (F.col("x.n") >= F.col("y.n")) & (F.col("x.component") != F.col("y.component"))
    fits = _fits(F.col("x.n"), F.col("y.n"), F.col("x.place"), F.col("y.place"))
    met = x.join(y, key[0] & key[1] & key[2] & apart & fits)
    return met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def _placed(rows: DataFrame, groups: DataFrame, name: str = "doc_id") -> DataFrame:
    """``rows`` with the component of the document ``name``, its own id if it has no link."""
    known = groups.withColumnRenamed("id", name)
    return rows.join(known, name, "left").withColumn("component", F.coalesce("component", name))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (least linked doc_id) of every document."""
    described = describe(documents)
    rows = described.where("block IS NULL")
    full = rows.where("n > 0 AND doc_id IS NOT NULL")
    parts = spread(documents)
    same = full.groupBy("mark").agg(F.min("doc_id").alias("stand"), F.count("*").alias("_rows"))
    # Copies of one text may be a third of all rows.
    stands = spread_lookup(full.select("doc_id", "mark"), same.drop("_rows"), ["mark"], "doc_id", same.select("mark", "_rows"), "inner")
    stands = written(stands.select("doc_id", "stand").distinct(), "jaccard-stands")

    blocks = prefix_blocks(documents, rarity(described), parts)
    postings = shared_postings(blocks, parts).join(stands, "doc_id")
    # Sets of one document stay apart by their size, which the filters compare; of equal ones the least place is the safe one.
    postings = postings.groupBy("shingle", F.col("stand").alias("doc_id"), "n").agg(F.min("place").alias("place"))
    postings = written(postings, "jaccard-postings")

    # A document with several texts has several stands, which are linked through it.
    several = stands.groupBy("doc_id").agg(F.min("stand").alias("a"), F.max("stand").alias("z")).where("a <> z")
    found = stands.join(several, "doc_id").select("a", F.col("stand").alias("b")).where("a <> b")
    for k in range(ROUNDS + 1):
        placed = _placed(postings, components(found, "jaccard-components"))
        pairs = _candidates(placed) if k < ROUNDS else _remaining(placed)
        found = found.union(verified(pairs, described, documents))
    whole = _placed(stands, components(found, "jaccard-components"), "stand")
    whole = whole.groupBy("doc_id").agg(F.min("component").alias("component"))
    return rows.join(whole, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents without those that have a near duplicate of smaller id, with all their columns."""
    component = near_duplicates(documents).where("component_id < doc_id").select("doc_id").distinct()
    return documents.join(component, "doc_id", "left_anti").select(documents.columns)
