"""Phrase collocations of each language, by Toivonen's sampling.

Phrases are runs of up to four words inside a piece of text (pieces end at punctuation and line ends).
A phrase that is met often enough has only parts that are, so candidates grow from frequent parts:

1. A sample of the documents (by hash, a fixed share of them) proposes the phrases that it holds twice.
2. One full pass counts, exactly and over all documents, the proposed phrases together with their negative
   border: the phrases that were not proposed, though both parts that lack one end word were. Every word
   is on the border of the empty phrase, so all words are counted.
3. A frequent phrase that was not proposed is a failure of the border: longer ones may hang on it.
   Then a further pass counts what the frequent phrases known by now propose and no pass has counted yet,
   until every frequent phrase was proposed. Phrases have four words, so that is three further passes at most.

Tasks count in windows of text with numpy, by 64-bit fingerprints, and hand out each phrase of a window once,
with its text, in packed blocks by language and hash; the counts of all windows meet in a shuffle and are added up by
the text itself. A phrase that a third of all words belong to is one entry for each window. What a pass counts is told to the tasks by a Bloom filter of the proposed
phrases that grows with them up to 16 MB; whatever passes it by chance, or when there are too many phrases
for it, is counted besides and does no harm, so nothing depends on its size but the work.

Scores are computed by joins on the frequent phrases, in decimals: no product is rounded.

Defined cases: a null text is an empty one, a null language is ``und``. Rows are counted as they stand,
repeated ones each, whatever their id. A text of any length is read whole. Ties in the order are broken
by the phrase. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from numberboard.llm.frames import WINDOW_MEMORY, spread, worker_memory, written
from numberboard.llm.textnum import _LOWER, chunks, grams, mix, raw

LONGEST = 4
LEAST = 30
TOP = 2000
SCALE = 2_000_000
#: A longer candidate with this percentage of a phrase's occurrences stands for it.
COVERED_PERCENT = 80
#: One of so many documents is in the sample.
SAMPLE_SHARE = 16
#: Bytes of text that a task counts at once.
WINDOW_BYTES = 8 << 20
ROWS = 1 << 16
FILTER_BITS_EACH = 16
FILTER_BITS = (1 << 16, 1 << 27)
#: Slices in which each language's best are found first.
SLICES = 64
#: Phrases of a part that are added up at once.
FOLDED = 1 << 20
COUNTS_SCHEMA = "lang string, size int, phrase string, f long"
BLOCKS_SCHEMA = "part int, lang string, phrases binary, n binary"

#: Fixed values of the words: what ends a piece, what separates words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
_END = np.zeros(256, bool)
_END[list(PIECE_ENDS)] = True
_GAP = _END.copy()
_GAP[list(BLANKS)] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
NEXT = ord("\n")  # words hold none
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


@lru_cache(maxsize=1 << 16)
def _language_mark(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


@dataclass
class Tokens:
    """Words of a window: fingerprints (of word and language), byte ranges, whether the next word goes on with the
    piece, and the language's number."""

    data: list[np.ndarray] = field(default_factory=list)
    hashes: list[np.ndarray] = field(default_factory=list)
    starts: list[np.ndarray] = field(default_factory=list)
    ends: list[np.ndarray] = field(default_factory=list)
    glued: list[np.ndarray] = field(default_factory=list)
    langs: list[np.ndarray] = field(default_factory=list)
    names: dict[str, int] = field(default_factory=dict)
    bytes: int = 0

    def read(self, texts: pa.Array, langs: pa.Array) -> None:
        data, offsets = raw(texts)
        solid = ~_GAP[data]
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        begins[edges] = solid[edges]
        stops[edges - 1] = solid[edges - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        if not len(starts):
            return
        first = np.searchsorted(starts, offsets)
        # A word's fingerprint is a difference of running sums, moved back to the word's own start.
        bits = max(20, int(len(data)).bit_length())
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LOWER[data] * _powers(_STEP, bits)[: len(data)])))
        hashes = mix((sums[ends] - sums[starts]) * _powers(_BACK, bits)[starts] + (ends - starts).astype(np.uint64))
        broken = np.concatenate(([0], np.cumsum(_END[data])))
        glued = np.zeros(len(starts), bool)
        glued[:-1] = broken[starts[1:]] == broken[ends[:-1]]
        last = first[1:] - 1
        glued[last[last >= 0]] = False
        names = langs.to_pylist()
        marks = np.array([_language_mark(x) for x in names], np.uint64)
        numbers = np.array([self.names.setdefault(x, len(self.names)) for x in names], np.int32)
        count = np.diff(first)
        self.hashes.append(mix(hashes ^ np.repeat(marks, count)))
        self.starts.append((starts + self.bytes).astype(np.int32))
        self.ends.append((ends + self.bytes).astype(np.int32))
        self.glued.append(glued)
        self.langs.append(np.repeat(numbers, count))
        self.data.append(_LOW[data])
        self.bytes += len(data)


def read_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    tokens = Tokens()
    for batch in batches:
        for part in chunks(batch):
            tokens.read(part.column("text"), part.column("lang"))
            if tokens.bytes >= WINDOW_BYTES:
                yield tokens
                tokens = Tokens()
    if tokens.bytes:
        yield tokens


def runs(hashes: np.ndarray, glued: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, fingerprints and validity of the phrases that begin at each word."""
    whole = np.ones(len(hashes), bool)
    for size in range(1, longest + 1):
        if size > 1:
            whole = whole[: len(hashes) - size + 1] & glued[size - 2 : len(hashes) - 1]
        if len(hashes) < size:
            return
        yield size, grams(hashes, size), whole


def held(bloom: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether the filter knows each fingerprint."""
    last = np.uint64(8 * len(bloom) - 1)
    out = np.ones(len(prints), bool)
    for shift in (np.uint64(0), np.uint64(32)):
        bit = (prints >> shift) & last
        out &= (bloom[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def bloom_filter(prints: DataFrame, count: int) -> np.ndarray:
    """Filter of the column ``print``: bits follow the count, at most 2**27 of them."""
    low, high = FILTER_BITS
    bits = min(max(low, 1 << math.ceil(math.log2(max(1, FILTER_BITS_EACH * count)))), high)
    both = F.array(F.col("print").bitwiseAND(bits - 1), F.shiftrightunsigned("print", 32).bitwiseAND(bits - 1))
    places = prints.select(F.explode(both).alias("bit"))
    words = places.select(F.shiftright("bit", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("v"))
    found = words.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()  # 16 MB at most
    out = np.zeros(bits >> 6, np.int64)
    out[found["w"].to_numpy()] = found["v"].to_numpy()
    return out.view(np.uint8)


def phrase_lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words from each place on, joined by blanks, a line each, and where the lines begin.

    ``data`` has one byte more than the text.
    """
    which = (at[:, None] + np.arange(size)).ravel()
    lengths = ends[which] - starts[which] + 1
    offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    text = data[np.arange(offsets[-1]) + np.repeat(starts[which] - offsets[:-1], lengths)]
    text[offsets[1:] - 1] = ord(" ")
    text[offsets[size::size] - 1] = NEXT
    return text, offsets[::size]


def lines_of(text: np.ndarray) -> pa.Array:
    """The lines as strings."""
    stops = np.flatnonzero(text == NEXT)
    sizes = np.diff(stops, prepend=-1) - 1
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(text[text != NEXT].tobytes()))


def tallied(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct fingerprint a place where it stands, and how often it does."""
    order = np.argsort(prints)
    ranked = prints[order]
    at = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
    return order[at], np.diff(np.append(at, len(ranked)))


@dataclass(frozen=True)
class Mining:
    """Phrases of up to ``longest`` words that are met ``least`` times; one of ``share`` documents is sampled."""

    longest: int = LONGEST
    least: int = LEAST
    share: int = SAMPLE_SHARE


def sampled_prints(texts: DataFrame, mining: Mining) -> DataFrame:
    """Written table of the sample's proposals: fingerprints of the phrases that it holds twice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in read_windows(batches):
            if not tokens.hashes:
                continue
            hashes, glued = np.concatenate(tokens.hashes), np.concatenate(tokens.glued)
            for size, prints, whole in runs(hashes, glued, mining.longest - 1):
                at, n = tallied(prints[whole])
                values = prints[whole][at].view(np.int64)
                for k in range(0, len(values), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(values[k : k + ROWS]), pa.array(n[k : k + ROWS])], ["print", "n"])

    sample = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(mining.share)) == 0).select("text", "lang")
    rows = sample.mapInArrow(count, "print long, n long").groupBy("print").agg(F.sum("n").alias("n"))
    return written(rows.where("n >= 2").select("print"), "phrases-sample")


class Blocks:
    """Phrases of a window, held by language and part until they are packed."""

    def __init__(self, names: list[str], parts: int):
        self.names, self.parts = names, parts
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def put(self, data, starts, ends, langs, at, size, n, prints) -> None:
        """``at``: where a phrase of each of the fingerprints stands, ``n``: how often it does."""
        part = ((prints >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int64)
        key = langs[at].astype(np.int64) * self.parts + part
        order = np.argsort(key, kind="stable")
        at, n, key = at[order], n[order], key[order]
        for k in range(0, len(at), ROWS):
            count, keys = n[k : k + ROWS].astype("<u4"), key[k : k + ROWS]
            text, offsets = phrase_lines(data, starts, ends, at[k : k + ROWS], size)
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            for i, j in zip(first.tolist(), np.append(first[1:], len(keys)).tolist()):
                self.held.setdefault(int(keys[i]), []).append((text[offsets[i] : offsets[j]], count[i:j]))

    def packed(self) -> Iterator[pa.RecordBatch]:
        codec, keys = pa.Codec("zstd", 1), sorted(self.held)
        for k in range(0, len(keys), 64):
            few = keys[k : k + 64]
            columns = [pa.array([x % self.parts for x in few], pa.int32()), pa.array([self.names[x // self.parts] for x in few])]
            for side in (0, 1):
                columns.append(pa.array([_packed(codec, np.concatenate([y[side] for y in self.held[x]])) for x in few], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["part", "lang", "phrases", "n"])


def _packed(codec: pa.Codec, x: np.ndarray) -> bytes:
    data = x.tobytes()
    return len(data).to_bytes(4, "little") + codec.compress(data, asbytes=True)


def _unpacked(codec: pa.Codec, data: bytes) -> np.ndarray:
    return np.frombuffer(codec.decompress(data[4:], int.from_bytes(data[:4], "little")), np.uint8)


def _added(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("phrase").aggregate([("f", "sum")]).rename_columns(["phrase", "f"])


def counted(texts: DataFrame, blooms: list[np.ndarray], mining: Mining, parts: int) -> DataFrame:
    """Written table of one full pass: frequent phrases among those that the last filter proposes or has on its border,
    and that no earlier filter did; in the first pass all words, and their number as size 0."""
    shared = texts.sparkSession.sparkContext.broadcast(blooms)
    first = len(blooms) == 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blooms = shared.value
        for tokens in read_windows(batches):
            if not tokens.hashes:
                continue
            hashes, glued, langs = (np.concatenate(x) for x in (tokens.hashes, tokens.glued, tokens.langs))
            starts, ends = np.concatenate(tokens.starts), np.concatenate(tokens.ends)
            data = np.concatenate([*tokens.data, np.array([NEXT], np.uint8)])
            for read in (tokens.data, tokens.hashes, tokens.glued, tokens.langs, tokens.starts, tokens.ends):
                read.clear()
            blocks = Blocks(list(tokens.names), parts)
            if first:  # the number of words, as that of the empty phrase
                for k, total in enumerate(np.bincount(langs, minlength=len(tokens.names)).astype("<u4")):
                    blocks.held[k * parts] = [(np.array([NEXT], np.uint8), np.array([total]))]
            known = [np.zeros(0, bool)] * len(blooms)  # whether each filter knows the phrase and all its parts
            for size, prints, whole in runs(hashes, glued, mining.longest):
                if size == 1:
                    wanted = whole if first else np.zeros(len(whole), bool)
                    both = [whole] * len(blooms)
                else:
                    both = [k[:-1] & k[1:] & whole for k in known]
                    wanted = both[-1].copy()
                    for earlier in both[:-1]:
                        wanted &= ~earlier
                where = np.flatnonzero(wanted)
                at, n = tallied(prints[where])
                blocks.put(data, starts, ends, langs, where[at], size, n, prints[where[at]])
                if size < mining.longest:
                    known = []
                    for bloom, may in zip(blooms, both):
                        some = np.flatnonzero(may)
                        hit = np.zeros(len(may), bool)
                        hit[some[held(bloom, prints[some])]] = True
                        known.append(hit)
            yield from blocks.packed()

    def frequent(lang: str, sums: pa.Table) -> pa.RecordBatch:
        size = pa.compute.count_substring(sums["phrase"], " ").combine_chunks().to_numpy() + 1
        size[pa.compute.equal(sums["phrase"], "").combine_chunks().to_numpy(zero_copy_only=False)] = 0
        kept = np.flatnonzero((size == 0) | (sums["f"].to_numpy() >= mining.least))
        few = sums.take(kept).combine_chunks()
        columns = [pa.array([lang] * len(kept), pa.string()), pa.array(size[kept].astype(np.int32)), *(few[c].combine_chunks() for c in ("phrase", "f"))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "f"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now = pa.Codec("zstd", 1), None
        tables: list[pa.Table] = []
        for batch in batches:
            for part, lang, phrases, n in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "phrases", "n"))):
                if (part, lang) != now and tables:
                    yield frequent(now[1], _added(tables))
                    tables = []
                now = (part, lang)
                tables.append(pa.table({"phrase": lines_of(_unpacked(codec, phrases)), "f": _unpacked(codec, n).view("<u4").astype(np.int64)}))
                if sum(map(len, tables[1:])) >= max(FOLDED, len(tables[0])):
                    tables = [_added(tables)]
        if tables:
            yield frequent(now[1], _added(tables))

    dealt = texts.select("text", "lang").mapInArrow(count, BLOCKS_SCHEMA).repartition(parts, "part").sortWithinPartitions("part", "lang")
    return written(dealt.mapInArrow(add, COUNTS_SCHEMA), "phrases-counted")


def phrase_prints(phrases: DataFrame) -> DataFrame:
    """The fingerprint, as tasks compute it, of each phrase (lang, size, phrase)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                tokens = Tokens()
                tokens.read(part.column("phrase"), part.column("lang"))
                hashes = np.concatenate(tokens.hashes)
                yield pa.RecordBatch.from_arrays([pa.array(grams(hashes, size)[::size].view(np.int64))], ["print"])

    return phrases.select("lang", "size", "phrase").mapInArrow(of, "print long")


def frequent_phrases(documents: DataFrame, mining: Mining | None = None) -> DataFrame:
    """(lang, size, phrase, f) of every phrase met often enough, and (lang, 0, '', number of words)."""
    with worker_memory(documents.sparkSession, WINDOW_MEMORY):
        return _frequent_phrases(documents, mining or Mining())


def _frequent_phrases(documents: DataFrame, mining: Mining) -> DataFrame:
    spark, parts = documents.sparkSession, spread(documents)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"), lang)
    proposed = sampled_prints(texts, mining)
    blooms = [bloom_filter(proposed, proposed.count())]
    found = counted(texts, blooms, mining, parts)
    for _ in range(mining.longest - 1):
        prints = written(phrase_prints(found.where(F.col("size").between(1, mining.longest - 1))), "phrases-prints")
        latest = spark.sparkContext.broadcast(blooms[-1])

        def failures(batches: Iterator[pa.RecordBatch], latest=latest) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(~held(latest.value, batch.column("print").to_numpy().view(np.uint64))))

        if prints.mapInArrow(failures, "print long").isEmpty():
            break
        blooms.append(bloom_filter(prints, prints.count()))
        found = found.union(counted(texts, blooms, mining, parts))
    return found


def _words(a: int | Column, n: int | Column) -> Column:
    """``n`` words of the phrase from the ``a``th on."""
    return F.array_join(F.slice(F.split("phrase", " "), a, n), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, size, a) with their lowest-scoring cut (l, r, score)."""
    counts = frequent.where("size > 0").select("lang", "phrase", "f")
    longer = frequent.where("size > 1").withColumnRenamed("f", "a")
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", _words(1, F.col("k")).alias("head"), _words(F.col("k") + 1, F.col("size")).alias("rest"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    met = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    wide = "decimal(20,0)"
    whole = (F.lit(SCALE).cast("decimal(7,0)") * F.col("a").cast(wide), F.col("l").cast(wide) + F.col("r").cast(wide))
    met = met.withColumn("_up", whole[0]).withColumn("_down", whole[1]).withColumn("score", F.expr("_up div _down"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return met.groupBy("lang", "phrase", "size", "a").agg(lowest).select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def uncovered(candidates: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Candidates without those that a longer one, by its occurrences, stands for."""
    parts = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda a: _words(a, n)),
        )
    )
    inner = candidates.where("size > 2").select("lang", F.col("a").alias("f"), F.explode(F.array_distinct(parts)).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = candidates.join(most, ["lang", "phrase"], "left")
    return kept.where(F.coalesce(F.col("f") * 100 < F.col("a") * COVERED_PERCENT, F.lit(True))).drop("f")


def collocations(documents: DataFrame, mining: Mining | None = None, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    frequent = frequent_phrases(documents, mining)
    best = uncovered(scored(frequent))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's best of each slice first, so that its last task gets a bounded number of rows.
    slice_of = F.pmod(F.xxhash64("phrase"), F.lit(SLICES))
    best = best.withColumn("slice", slice_of)
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    best = best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    words = frequent.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
