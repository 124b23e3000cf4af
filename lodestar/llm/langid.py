"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text's n-grams are the hashed runs of 1 to 3 characters of its lower-cased letters, with all else folded into single blanks;
features are L2-normalised counts times inverse document frequency. Document frequencies come from every row to learn from;
weights are fitted by follow-the-regularised-leader with L1 and L2 penalties on a bounded, documented sample (at most sample_rows for
each language, ties by doc_id) in one task, which gets the sample's features, not its texts. A fifth of the sample is kept back, and a temperature is fitted to it. Every row is scored,
whole texts, a bounded block at a time.

Null texts and texts without a letter are und with score 0. Rows are scored one by one: repeated rows give repeated results.
With nothing to learn from, all are und; an empty table gives no rows. Of equally likely languages the first by name is taken. Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import held_out, stored, texts, tuned
from lodestar.llm.ftrl import Ftrl, softmax

BITS = 15
SIZE = 1 << BITS
BLOCK = 1 << 18
#: Rows of a language that are ranked together; Spark drops those that rank lower before it shuffles, up to this many.
PART = 1000
OTHER = re.compile(r"[\W\d_]+")
K = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))


def folded(text: str) -> Iterator[str]:
    """The lower-cased letters with all else as single blanks, and a blank at both ends, a block at a time; the same whatever the blocks."""
    yield " "
    blank = False
    for at in range(0, len(text), BLOCK):
        part = OTHER.sub(" ", text[at : at + BLOCK].lower().replace("ς", "σ"))  # which of both it is depends on what stands around
        yield part[1:] if blank and part[0] == " " else part
        blank = part[-1] == " "
    yield " "


def counts(text: str) -> np.ndarray | None:
    """Counts of hashed n-grams; None if there is no letter."""
    total, letters, a = np.zeros(SIZE), False, np.zeros(0, np.uint32)
    for part in folded(text):
        letters = letters or bool(part.strip(" "))
        held = len(a)
        a = np.concatenate([a, np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)])
        # n-grams whose last character is new
        x = [a * K[0], a[:-1] * K[0] + a[1:] * K[1], a[:-2] * K[0] + a[1:-1] * K[1] + a[2:] * K[2]]
        h = np.concatenate([v[max(0, held - n) :] + np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF) for n, v in enumerate(x)])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        total += np.bincount((h >> np.uint32(32 - BITS)).astype(np.int64), minlength=SIZE)
        a = a[-2:]
    return total if letters else None


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Texts with a letter, and for each hashed n-gram how many of them hold it; each task sends one row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(SIZE, np.int64)
        for batch in batches:
            for text in texts(batch.column(0)):
                if (c := counts(text)) is not None:
                    n += 1
                    df += c > 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[n, df[at]], pa.int64())], names=["at", "n"])

    got = rows.select("text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # SIZE + 1 rows at most
    found = {r["at"]: r["n"] for r in got}
    out = np.zeros(SIZE)
    for k, v in found.items():
        if k >= 0:
            out[k] = v
    return found.get(-1, 0), out


def features(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(c) * idf  # damped counts: a long text doesn't hang on a few frequent n-grams
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean())

    low, high, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(documents: DataFrame, sample_rows: int = 1500, epochs: int = 4, alpha: float = 1.0, beta: float = 0.1, l1: float = 0.02, l2: float = 0.02) -> dict | None:
    """The model. The sample is, of each language, the sample_rows rows whose hashed doc_id is least."""
    tuned(documents.sparkSession)
    learn = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    n, df = document_frequencies(learn)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)) + 1
    # a language's rows are dealt to parts by hash, so that each part's least rows are found where they are read
    parts = -(-sample_rows // PART)
    ids = learn.select("doc_id", "lang").withColumn("o", F.xxhash64("doc_id"))
    least = Window.partitionBy("lang", F.pmod("o", F.lit(parts))).orderBy("o", "doc_id")
    picked = stored(ids.withColumn("k", F.row_number().over(least)).where(F.col("k") <= sample_rows // parts).select("doc_id", "lang", "o"), "language-sample")
    langs = sorted(r[0] for r in picked.select("lang").distinct().collect())  # as many as the model has outputs
    place = {lang: i for i, lang in enumerate(langs)}
    rows = learn.join(F.broadcast(picked.select("doc_id", "o").distinct()), "doc_id").select("o", F.xxhash64("text").alias("tie"), "lang", "text")  # sample_rows a language at most
    sparse = "o long, tie long, y int, at array<int>, x array<float>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 100):
                piece, found = batch.slice(k, 100), []
                for o, tie, lang, text in zip(*(piece.column(i).to_pylist() for i in range(3)), texts(piece.column(3)), strict=True):
                    if (c := counts(text)) is not None:
                        x = features(c, idf)
                        at = np.flatnonzero(x)
                        found.append((o, tie, place[lang], at.astype(np.int32), x[at].astype(np.float32)))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)], names=["o", "tie", "y", "at", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            o, tie, y = (batch.column(i).to_pylist() for i in range(3))
            for i in range(len(batch)):
                at, x = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (3, 4))
                found.append((o[i], tie[i], y[i], at, x))
        found.sort(key=lambda r: r[:3])
        keep = [r[2:] for r in found[::5]] if len(found) >= 50 else [r[2:] for r in found]
        use = [r[2:] for i, r in enumerate(found) if i % 5] if len(found) >= 50 else keep
        model = Ftrl(SIZE, len(langs), alpha, beta, l1, l2)
        for _ in range(epochs):
            for y, at, x in use:
                w = model.weights(at)
                error = softmax(x @ w)
                error[y] -= 1
                model.update(at, w, x[:, None] * error[None, :])
        w = model.weights()
        if keep:
            t = temperature(np.array([x @ w[at] for _, at, x in keep]), np.array([y for y, _, _ in keep]))
        else:
            t = 1.0
        at = np.flatnonzero(np.abs(w).sum(axis=1))
        cols = [pa.array([v], k) for v, k in ((at.tolist(), pa.list_(pa.int32())), (w[at].ravel().tolist(), pa.list_(pa.float64())), (t, pa.float64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["at", "w", "t"])

    got = rows.mapInArrow(read, sparse).repartition(1).mapInArrow(train, "at array<int>, w array<double>, t double").collect()  # one row
    if not got:
        return None
    at = np.array(got[0]["at"], np.int64)
    return {"langs": langs, "idf": idf, "at": at, "w": np.array(got[0]["w"]).reshape(len(at), len(langs)), "t": got[0]["t"]}


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(documents: DataFrame, model: dict | None) -> DataFrame:
    """One row for each row of documents."""
    tuned(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is not None:
            w = np.zeros((SIZE, len(model["langs"])))
            w[model["at"]] = model["w"]
        for batch in batches:
            out = []
            for text in texts(batch.column(2)):
                c = counts(text) if model is not None else None
                if c is None:
                    out.append(("und", 0.0))
                else:
                    p = softmax(features(c, model["idf"]) @ w / model["t"])
                    out.append((model["langs"][int(p.argmax())], float(p.max())))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return documents.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)


def identify(documents: DataFrame, **parameters: float) -> DataFrame:
    return predict(documents, fit(documents, **parameters))
