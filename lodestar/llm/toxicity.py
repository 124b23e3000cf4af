"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters (ASCII letters, lower-cased, and all non-ASCII bytes). Features of a text are the distinct hashes of
its words, their stems (the first STEM bytes, so that inflected forms share a weight), word pairs and pairs with one word between
them. The fit reads a bounded, documented sample of labelled
rows (sample_rows, both classes alike where there are enough) in one task; L1 leaves few weights, which go to the executors with
the scoring function (at most 2**BITS of them, whatever the input). Scoring reads every row and whole texts.

Null and empty texts have no features and get the score of the bias alone. Rows are scored one by one: repeated rows give
repeated results. Several labels of one doc_id count as the largest; null labels and labels without a document aren't used. With
no labelled rows the model is the bias 0 with score 0.1; an empty table gives no rows. Of labelled rows whose hashed ids tie, those of the least
doc_id are taken. Texts of any length are read whole, their features in one array of 2**BITS places at most. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import held_out, mix, tuned, utf8
from lodestar.llm.ftrl import Ftrl, sigmoid
from lodestar.llm.words import NOT_LETTER, Words

BITS = 18
STEM = 5
PAIR, SKIP, STEM_MARK = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xC13FA9A902A6328F)
PRIOR = 0.1


class Grams:
    """Hashed coordinates of a text, with repeats; coordinate 0 is the bias and not among them."""

    def __init__(self) -> None:
        self.words, self.stems = Words(NOT_LETTER), Words(NOT_LETTER, STEM)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        h, s = self.words.row(data), self.stems.row(data)
        parts = [h, mix(s + STEM_MARK), mix(h[:-1] * PAIR + h[1:]), mix(h[:-2] * SKIP + h[2:])]
        return np.maximum(np.concatenate(parts) >> np.uint64(64 - BITS), np.uint64(1)).astype(np.int64)


def features(at: np.ndarray) -> np.ndarray:
    """The distinct coordinates, and the bias."""
    seen = np.zeros(1 << BITS, bool)
    seen[at] = True
    seen[0] = True
    return np.flatnonzero(seen)


def logit(at: np.ndarray, weights: np.ndarray) -> float:
    """The sum of the weights of the distinct coordinates and the bias; only those with weight need to be told apart."""
    return float(weights[0] + weights[np.unique(at[weights[at] != 0])].sum())


def fit_rows(rows: list[tuple[np.ndarray, int]], epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    model = Ftrl(1 << BITS, 1, alpha, beta, l1, l2)
    for _ in range(epochs):
        for at, y in rows:
            w = model.weights(at)
            model.update(at, w, np.full_like(w, sigmoid(float(w.sum())) - y))
    return model.weights()[:, 0]


def once(found: list[tuple[int, np.ndarray, int]]) -> list[tuple[np.ndarray, int]]:
    """Features and label of the sample's rows (o, features, label), by o and features; of equal features the first. No features are copied
    but those of rows of one o."""
    rows, seen = [], set()
    for _, same in itertools.groupby(sorted(found, key=lambda x: x[0]), key=lambda x: x[0]):
        same = list(same)
        for _, at, y in sorted(same, key=lambda x: x[1].tobytes()) if len(same) > 1 else same:
            if (key := hashlib.blake2b(np.ascontiguousarray(at), digest_size=16).digest()) not in seen:
                seen.add(key)
                rows.append((at, y))
    return rows


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = 8000, epochs: int = 12, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights other than 0. The sample is the sample_rows / 2 labelled rows of each class whose hashed doc_id is least;
    texts that repeat count once."""
    tuned(documents.sparkSession)
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("o", F.xxhash64("doc_id"))
    picked = [known.where(F.col("y") == y).orderBy("o", "doc_id").limit(sample_rows // 2) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # sample_rows rows at most
    rows = documents.select("doc_id", "text").join(sample, "doc_id").select("o", "y", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            data, bounds = utf8(batch.column(2))
            for k in range(0, len(batch), 100):
                at = [features(grams(data[a:b])).astype(np.int32) for a, b in zip(bounds[k : min(k + 100, len(batch))], bounds[k + 1 : k + 101], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 100), batch.column(1).slice(k, 100), pa.array(at, pa.list_(pa.int32()))], names=["o", "y", "at"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for i, (o, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                found.append((o, batch.column(2)[i].values.to_numpy(zero_copy_only=False), int(y > 0)))
        w = fit_rows(once(found), epochs, alpha, beta, l1, l2)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([w[at].tolist()], pa.list_(pa.float64()))], names=["at", "w"])

    got = rows.mapInArrow(read, "o long, y int, at array<int>").repartition(1).mapInArrow(train, "at array<int>, w array<double>").collect()  # one row of at most 2**BITS weights
    at, w = (got[0][0], got[0][1]) if got else ([], [])
    return np.array(at, np.int32), np.array(w, np.float64)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = 0.3) -> DataFrame:
    """One row for each row of documents."""
    tuned(documents.sparkSession)
    at, w = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, dense = Grams(), np.zeros(1 << BITS)
        dense[at] = w
        bias = float(np.log(PRIOR / (1 - PRIOR))) if not len(at) else 0.0
        for batch in batches:
            data, bounds = utf8(batch.column(2))
            p = [float(sigmoid(bias + logit(grams(data[a:b]), dense))) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            p = pa.array(p, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), p, pa.array([int(x.as_py() >= threshold) for x in p], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return documents.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)


def reject(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = 0.3) -> DataFrame:
    """The rows of documents that score below threshold, with all their columns."""
    tuned(documents.sparkSession)
    at, w = model
    column = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, dense = Grams(), np.zeros(1 << BITS)
        dense[at] = w
        bias = float(np.log(PRIOR / (1 - PRIOR))) if not len(at) else 0.0
        for batch in batches:
            data, bounds = utf8(batch.column(column))
            yield batch.filter(pa.array([bool(sigmoid(bias + logit(grams(data[a:b]), dense)) < threshold) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **parameters: float) -> DataFrame:
    return score(documents, fit(documents, labels, **parameters), threshold)
