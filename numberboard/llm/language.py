"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Runs of one to three characters (A-Z lower-cased) fall into hashed buckets. A text's weights are
(1 + log count) x idf, scaled to length one; idf counts all training documents. The regression is
trained with follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties) on a bounded
sample: of each language the ``SAMPLE / languages`` training documents with the smallest hashed
identifiers (with more languages than ``SAMPLE``, of the most frequent ones). One sampled document in
five is kept back, and a temperature fitted on those calibrates the probabilities. Prediction reads
every whole text.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every text if
there are no training rows. Training rows with null lang are left out. Equal scores: the first
language by name. Repeated rows each give a row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from numberboard.llm.frames import crc_share, texts
from numberboard.llm.textnum import chunks, raw

BUCKETS = 1 << 13
SIZES = (1, 2, 3)
SAMPLE = 3000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
HELD_OUT = 2
PARTS = 4
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, A-Z lower-cased, and where each text begins."""
    data, offsets = raw(column)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    return np.where((points >= 65) & (points <= 90), points + np.uint32(32), points), begins


def tally(slots: list[np.ndarray], cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells that occur, upwards, and how often; memory follows the entries, not the cells."""
    if cells > 4 * sum(map(len, slots)):
        return np.unique(np.concatenate([np.zeros(0, np.int64), *slots]), return_counts=True)
    table = np.zeros(cells, np.int64)
    for some in slots:
        table += np.bincount(some, minlength=cells)
    hit = np.flatnonzero(table)
    return hit, table[hit]


@dataclass
class Counts:
    """Non-zero n-gram counts: text, bucket, count; whether each text has a letter."""

    text: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    lettered: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Counts:
        points, begins = characters(column)
        n = len(begins) - 1
        owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(begins))
        slots = []
        code = np.zeros(len(points), np.uint32)
        for size in SIZES:
            left = len(points) - size + 1
            if left <= 0:
                break
            code = code[:left] * np.uint32(0x01000193) + points[size - 1 :] * _FACTORS[size - 1] + np.uint32(size)
            inside = owner[:left] == owner[size - 1 :]
            slot = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(19)
            slots.append((owner[:left] * BUCKETS + slot)[inside])
        hit, count = tally(slots, n * BUCKETS)
        letters = np.concatenate(([0], np.cumsum(_letters()[points])))
        return cls(hit // BUCKETS, hit % BUCKETS, count, letters[begins[1:]] > letters[begins[:-1]])

    def weights(self, idf: np.ndarray) -> np.ndarray:
        value = (1 + np.log(self.count)) * idf[self.bucket]
        norm = np.sqrt(np.bincount(self.text, value * value, minlength=len(self.lettered)))
        return value / np.maximum(norm, 1e-12)[self.text]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float

    def probabilities(self, counts: Counts) -> np.ndarray:
        n, value = len(counts.lettered), counts.weights(self.idf)
        logits = np.stack(
            [np.bincount(counts.text, value * self.weights[counts.bucket, k], minlength=n) for k in range(len(self.languages))], 1
        )
        return softmax((logits + self.bias) / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(training: DataFrame) -> tuple[np.ndarray, int]:
    """Number of training documents that hold each bucket, and of all; one row a bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in chunks(batch):
                held += np.bincount(Counts.of(part.column("text")).bucket, minlength=BUCKETS)
                rows += part.num_rows
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(held[some], rows))], ["bucket", "n"]
        )

    found = training.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    held = np.zeros(BUCKETS)
    for row in found:
        if row["bucket"] >= 0:
            held[row["bucket"]] = row["n"]
    return held, sum(row["n"] for row in found if row["bucket"] < 0)


def sample(training: DataFrame, size: int) -> DataFrame:
    """lang, doc_id of at most ``size`` training documents, equally many of each language where there are enough.

    A first pass states how many documents each language has, to some per cent; a threshold on the hashed
    identifiers then leaves about twice as many as wanted, and only those are ranked.
    """
    keys = training.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    known = keys.groupBy("lang").agg(F.approx_count_distinct("h").alias("documents"))
    languages = known.orderBy(F.desc("documents"), "lang").limit(size).collect()
    wanted = max(1, size // max(len(languages), 1))
    bounds = [(row["lang"], _bound((2 * wanted + 100) / max(row["documents"], 1))) for row in languages]
    # At most ``size`` rows, one for each language.
    bounds = F.broadcast(training.sparkSession.createDataFrame(bounds, "lang string, bound long"))
    near = keys.join(bounds, "lang").where(F.col("h") <= F.col("bound")).select("lang", "doc_id", "h").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return near.withColumn("place", place).where(F.col("place") <= wanted).select("lang", "doc_id")


def _bound(share: float) -> int:
    """The signed 64-bit number that this share of all such numbers doesn't exceed."""
    return min(int(share * (1 << 64)), (1 << 64) - 1) - (1 << 63)


def train(training: DataFrame, size: int = SAMPLE) -> Model | None:
    """Model of ``training`` (doc_id, text, lang, none of them null in lang); None without rows."""
    held, rows = document_frequencies(training)
    if not rows:
        return None
    idf = np.log((1 + rows) / (1 + held)) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                c = Counts.of(part.column("text"))
                at = np.searchsorted(c.text, np.arange(part.num_rows + 1)).astype(np.int32)
                columns = [c.bucket.astype(np.int32), c.weights(idf).astype(np.float32)]
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in columns]
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), *lists], ["lang", "h", "bucket", "value"])

    # At most ``size`` identifiers: 100 KB for 3000. Rows that repeat one of them end in a single row.
    few = F.broadcast(sample(training, size))
    chosen = training.join(few, ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    chosen = chosen.select("text", "lang", F.xxhash64("doc_id").alias("h"))
    rows = chosen.mapInArrow(count, "lang string, h long, bucket array<int>, value array<float>").toArrow()
    rows = rows.sort_by([("h", "ascending"), ("lang", "ascending")]).combine_chunks()
    names = rows.column("lang").to_pylist()
    languages = sorted(set(names))
    target = np.array([languages.index(x) for x in names])
    buckets = [x.values.to_numpy() for x in rows.column("bucket")]
    values = [x.values.to_numpy().astype(float) for x in rows.column("value")]
    kept_back = np.arange(len(names)) % 5 == 4
    z = np.zeros((BUCKETS + 1, len(languages)))
    n = np.zeros_like(z)

    def leader(where: np.ndarray) -> np.ndarray:
        pull = z[where]
        return -np.sign(pull) * np.maximum(np.abs(pull) - L1, 0) / ((BETA + np.sqrt(n[where])) / ALPHA + L2)

    order = np.random.Generator(np.random.PCG64(1))
    for _ in range(EPOCHS):
        for i in order.permutation(np.flatnonzero(~kept_back)):
            where, x = np.append(buckets[i], BUCKETS), np.append(values[i], 1.0)
            w = leader(where)
            gradient = softmax(x @ w)
            gradient[target[i]] -= 1
            g = x[:, None] * gradient
            step = (np.sqrt(n[where] + g * g) - np.sqrt(n[where])) / ALPHA
            z[where] += g - step * w
            n[where] += g * g
    w = leader(np.arange(BUCKETS + 1))
    back = np.flatnonzero(kept_back)
    logits = np.array([values[i] @ w[buckets[i]] + w[-1] for i in back]).reshape(len(back), len(languages))
    temperatures = np.geomspace(0.05, 5, 60)
    loss = [-np.log(softmax(logits / t)[np.arange(len(back)), target[back]] + 1e-12).sum() for t in temperatures]
    best = float(temperatures[int(np.argmin(loss))]) if len(back) else 1.0
    return Model(languages, idf, w[:-1], w[-1], best)


def identify(documents: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    share = crc_share("doc_id", PARTS)
    training = texts(documents, F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & (share != HELD_OUT))
    model = train(training, size)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                counts = Counts.of(part.column("text"))
                known = counts.lettered & (model is not None)
                names = np.full(part.num_rows, UNKNOWN, dtype=object)
                score = np.zeros(part.num_rows)
                if model is not None:
                    p = model.probabilities(counts)
                    names[known] = np.array(model.languages, dtype=object)[p.argmax(axis=1)][known]
                    score[known] = p.max(axis=1)[known]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    held_out = F.coalesce(share == HELD_OUT, F.lit(False)).alias("held_out")
    schema = T._parse_datatype_string("doc_id long, held_out boolean, lang_pred string, score double")
    return texts(documents, held_out).mapInArrow(predict, schema)
