"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled covariance and then towards its
diagonal. A document's score is the logistic of the difference of the class log densities plus log
priors, worked out from Mahalanobis distances with the classes' Cholesky factors, which are computed
once and shipped with the model. The statistics come from the whole text alone.

Means and covariances are sums over all labelled training rows, added up by Spark: the driver gets
one row for each class.

Defined cases: a null text counts as empty; empty texts get a score like any other. Labels that are
null or belong to no document are left out, a repeated label counts each time. With labels of one
class only every score is that class; without labels it is 0.5. Repeated rows each give a row. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numberboard.llm.frames import crc_share, texts, written
from numberboard.llm.rules import STOP_WORDS
from numberboard.llm.textnum import Words, chunks, grams

THRESHOLD = 0.3
HOLD_OUT_PARTS = 5
POOLING = 0.1
DIAGONAL = 0.1
FLOOR = 2e-4
#: Every ratio counts so many words of ordinary prose besides the document's own, so that a short text isn't odd by chance.
EVIDENCE = 20.0
#: Log densities of strongly non-normal statistics differ by hundreds; divides them before the logistic.
TEMPERATURE = 8.0

STATISTICS = (
    "words", "word_length", "symbols", "upper", "digits", "marks", "bars", "stop_words", "points",
    "lines", "distinct_words", "distinct_windows", "beyond_ascii", "long_words",
)
FEATURES_SCHEMA = "doc_id long, features array<double>"

_KINDS = {
    "symbols": b"#*$%&<>",
    "upper": bytes(range(65, 91)),
    "digits": b"0123456789",
    "marks": b"!?",
    "bars": b"|",
    "points": b".,;:",
    "lines": b"\n",
    "beyond_ascii": bytes(range(128, 256)),
}
_TABLE = {name: np.isin(np.arange(256), list(kind)) for name, kind in _KINDS.items()}
_STOPS = np.sort(Words.of(pa.array([" ".join(STOP_WORDS)])).hashes(lower=True))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    words = Words.of(column)
    codes = words.hashes(lower=True)
    size = np.diff(words.offsets).astype(float)
    n = np.diff(words.first).astype(float)
    some = n + EVIDENCE
    count = {name: _sums(table[words.bytes], words.offsets) for name, table in _TABLE.items()}
    stop = _STOPS[np.minimum(np.searchsorted(_STOPS, codes), len(_STOPS) - 1)] == codes
    length = words.ends - words.starts
    windows, bounds = grams(codes, 3), words.first.tolist()
    distinct = np.array([len(np.unique(codes[a:b])) for a, b in zip(bounds[:-1], bounds[1:])], float)
    unlike = np.array([len(np.unique(windows[a : max(a, b - 2)])) for a, b in zip(bounds[:-1], bounds[1:])], float)
    found = {
        "words": np.log1p(n),
        "word_length": np.log1p((_sums(length, words.first) + 5.0 * EVIDENCE) / some),
        "stop_words": np.sqrt((_sums(stop, words.first) + 0.3 * EVIDENCE) / some),
        "points": np.sqrt((count["points"] + 0.12 * EVIDENCE) / some),
        "lines": np.sqrt((count["lines"] + 0.02 * EVIDENCE) / some),
        "distinct_words": np.log1p(distinct) - np.log1p(n),
        "distinct_windows": (unlike + EVIDENCE) / (np.maximum(n - 2, 0) + EVIDENCE),
        "long_words": np.sqrt(_sums(length > 20, words.first) / some),
    }
    for name in ("symbols", "upper", "digits", "marks", "bars", "beyond_ascii"):
        found[name] = np.sqrt((count[name] + 0.02 * EVIDENCE) / (size + 6.0 * EVIDENCE))
    return np.stack([found[name] for name in STATISTICS], axis=1)


def features(documents: DataFrame) -> DataFrame:
    """Statistics of every document: doc_id, features."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                rows = statistics(part.column("text"))
                at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(rows.ravel()))], ["doc_id", "features"]
                )

    return texts(documents).mapInArrow(measure, FEATURES_SCHEMA)


@dataclass
class Discriminant:
    """``log_prior`` by class; ``centres`` and inverse Cholesky factors, with log determinants, by class."""

    log_prior: np.ndarray
    centres: np.ndarray
    factors: np.ndarray
    log_det: np.ndarray
    constant: float | None = None

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Share of class 1 for each row of statistics."""
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        density = []
        for k in (0, 1):
            white = (rows - self.centres[k]) @ self.factors[k].T
            density.append(self.log_prior[k] - self.log_det[k] - 0.5 * np.einsum("ij,ij->i", white, white))
        return 1 / (1 + np.exp(np.clip((density[0] - density[1]) / TEMPERATURE, -500, 500)))


def fit(measured: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on all rows of ``measured`` (doc_id, features) that ``labels`` (doc_id, quality 0 or 1) marks."""
    known = labels.where("quality IN (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )
    d = len(STATISTICS)
    x = [F.col("features")[i] for i in range(d)]
    sums = [F.count("*").alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(d))]
    sums += [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(d) for j in range(i + 1)]
    rows = {row["quality"]: row for row in measured.join(known, "doc_id").groupBy("quality").agg(*sums).collect()}
    if len(rows) < 2:
        only = float(next(iter(rows))) if rows else 0.5
        return Discriminant(*(np.zeros(0) for _ in range(4)), constant=only)
    n = np.array([rows[k]["n"] for k in (0, 1)], float)
    centres = np.array([[rows[k][f"s{i}"] for i in range(d)] for k in (0, 1)]) / n[:, None]
    spread = np.zeros((2, d, d))
    for k in (0, 1):
        for i in range(d):
            for j in range(i + 1):
                spread[k, i, j] = spread[k, j, i] = rows[k][f"s{i}_{j}"] / n[k] - centres[k, i] * centres[k, j]
    pooled = np.tensordot(n / n.sum(), spread, axes=1)
    factors, log_det = [], []
    for k in (0, 1):
        s = (1 - POOLING) * spread[k] + POOLING * pooled
        s = (1 - DIAGONAL) * s + np.diag(DIAGONAL * np.diag(s) + FLOOR)
        lower = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(lower))
        log_det.append(np.log(np.diag(lower)).sum())
    return Discriminant(np.log(n / n.sum()), centres, np.array(factors), np.array(log_det))


def in_training():
    return crc_share("doc_id", HOLD_OUT_PARTS) != 0


def trained(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, Discriminant]:
    """The written statistics of all documents, and the model of the training rows."""
    measured = written(features(documents), "quality-statistics")
    return measured, fit(measured.where(in_training()), labels)


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    measured, model = trained(documents, labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("features").flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(model.score(rows))], ["doc_id", "held_out", "score"]
            )

    held_out = F.coalesce(~in_training(), F.lit(False)).alias("held_out")
    scored = measured.select("doc_id", held_out, "features").mapInArrow(judge, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be good, with all their columns, without moving a text."""
    model = fit(written(features(documents), "quality-statistics").where(in_training()), labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield part.filter(pa.array(model.score(statistics(part.column("text"))) >= THRESHOLD))

    return documents.mapInArrow(judge, documents.schema)
