"""Line dedup over levelled sorted runs of line hashes.

A run is a table (h1, h2, n, top, fresh) of lines by the 128-bit hash of their keys, in buckets by the hash and sorted in each: the documents
that hold the line, the largest doc_id among them, and if no earlier run had it. Each batch of documents is merge-anti-joined with the runs,
which tells its new lines from known ones, and adds a run of its own at level 0, in which known lines only carry what they add. As soon as a
level has two runs, a merge join folds them into one of the next level, and they go. So a batch never rewrites the whole store, and the runs to
look into stay few. As all runs share their buckets, only a batch's own lines are shuffled, after they were counted where they were read; runs
are neither shuffled nor sorted again.

A line's key is the line without white space (x20, x09 to x0D) at both ends, with A-Z lower-cased. Keys of at least min_chars code points
that at least min_docs documents hold lose all their lines but those in the largest doc_id.

Null and empty texts are one empty line. Documents count by doc_id: rows that repeat one count once, and all rows of the largest doc_id keep
the line. A null doc_id is a value, smaller than any other. Texts of any length are split whole. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import SENT, drop_scratch, scratch, stored, text_key, texts, tuned

MIN_CHARS, MIN_DOCS = 40, 5
BLANKS = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HASH = ["h1", "h2"]


def line_hash(line: str, min_chars: int) -> bytes | None:
    """16 bytes for a key of at least min_chars code points."""
    key = line.strip(BLANKS)
    return hashlib.blake2b(key.translate(LOWER).encode(), digest_size=16).digest() if len(key) >= min_chars else None


def line_hashes(documents: DataFrame, min_chars: int = MIN_CHARS, batches: int = 1) -> DataFrame:
    """(h1, h2, doc_id, _tk, batch): each distinct long line of each row; the rows of a doc_id are in one batch."""
    tuned(documents.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, len(part), 200):
                piece = part.slice(at, 200)
                found, rows = [], []
                for i, text in enumerate(texts(piece.column(2))):
                    own = {line_hash(x, min_chars) for x in text.split("\n")} - {None}
                    found += own
                    rows += [i] * len(own)
                h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), *(piece.column(c).take(rows) for c in (0, 1, 3))], names=["h1", "h2", "doc_id", "_tk", "batch"])

    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    return documents.select(*text_key(), "text", batch).mapInArrow(run, "h1 long, h2 long, doc_id long, _tk long, batch int")


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """While it lasts, scans of bucketed tables tell that the one file of each bucket is sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """The store of runs: bucketed tables in the shared folder, until close()."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.buckets = spark, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, rows: DataFrame) -> str:
        name = f"lodestar_lines_{uuid.uuid4().hex}"
        self.paths[name] = scratch(self.spark, "line-run")
        rows = rows.select("h1", "h2", "n", "top", "fresh")
        with sorted_scans(self.spark):
            rows.write.format("parquet").option("path", self.paths[name]).bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_scratch(self.paths.pop(name))

    def close(self) -> None:
        for name in list(self.paths):
            self._drop(name)
        self.levels = [[]]

    def marked(self, rows: DataFrame) -> DataFrame:
        """rows (with h1, h2) with fresh: if no run holds the line. Merge joins by bucket."""
        fresh = F.lit(True)
        for i, run in enumerate(self.runs()):
            rows = rows.join(run.where("fresh").select(*HASH, F.lit(True).alias(f"in_{i}")).hint("merge"), HASH, "left")
            fresh = fresh & F.col(f"in_{i}").isNull()
        return rows.withColumn("fresh", fresh).drop(*(f"in_{i}" for i in range(len(self.runs()))))

    def merged(self, one: str, two: str) -> str:
        """A run of what both hold."""
        a, b = (self.spark.table(name).select(*HASH, *(F.col(c).alias(f"{c}{i}") for c in ("n", "top", "fresh"))) for i, name in enumerate((one, two)))
        no = F.lit(False)
        both = a.join(b.hint("merge"), HASH, "full_outer")
        n = F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))
        name = self._write(both.select(*HASH, n.alias("n"), F.greatest("top0", "top1").alias("top"), (F.coalesce("fresh0", no) | F.coalesce("fresh1", no)).alias("fresh")))
        self._drop(one)
        self._drop(two)
        return name

    def add(self, lines: DataFrame) -> None:
        """Adds a batch's (h1, h2, doc_id) as a run, and compacts the levels that have two."""
        own = lines.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        name, level = self._write(self.marked(own)), 0
        while self.levels[level]:
            name = self.merged(self.levels[level].pop(), name)
            level += 1
            if level == len(self.levels):
                self.levels.append([])
        self.levels[level].append(name)

    def whole(self) -> DataFrame:
        """All lines (h1, h2, n, top), in one run."""
        names = [name for level in self.levels for name in level]
        while len(names) > 1:
            names.append(self.merged(names.pop(), names.pop()))
        self.levels = [[] for _ in self.levels[1:]] + [names]
        if not names:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long, top long")
        return self.spark.table(names[0]).select("h1", "h2", "n", "top")


def once_a_document(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """lines (h1, h2, doc_id, ...) with one row for each line and doc_id, where rows of documents repeat a doc_id."""
    again = stored(documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("d")), "repeated-ids")
    n = again.count()
    if not n:
        return lines
    again = F.broadcast(again) if n <= SENT else again
    same, cols = F.col("doc_id").eqNullSafe(F.col("d")), [c for c in ("h1", "h2", "doc_id", "batch") if c in lines.columns]
    return lines.join(again, same, "left_anti").select(*cols).unionByName(lines.join(again, same, "left_semi").select(*cols).distinct())


def dedup_batch(store: LineRuns, documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Incremental use: (doc_id, _tk, h1, h2) of the batch's lines that earlier batches don't hold; the batch is then added."""
    lines = stored(line_hashes(documents, min_chars).drop("batch"), "batch-lines")
    with sorted_scans(store.spark):
        new = stored(store.marked(lines).where("fresh").select("doc_id", "_tk", *HASH), "new-lines")
    store.add(once_a_document(lines, documents))
    return new


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 4, keep: list[str] | None = None) -> DataFrame:
    """One row for each row of documents: doc_id, n_lines, n_dropped, kept_sha256, and kept (the text left) with the columns keep."""
    spark = tuned(documents.sparkSession)
    path = scratch(spark, "lines")
    line_hashes(documents, min_chars, batches).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("h1 long, h2 long, doc_id long, _tk long, batch int").parquet(path)
    store = LineRuns(spark)
    once = once_a_document(lines, documents)
    for b in range(batches):
        store.add(once.where(F.col("batch") == b))
    common = store.whole().where(F.col("n") >= min_docs).select("h1", "h2", "top")
    common = stored(common, "common-lines")  # on its own, so that a join with a hot line can be split
    store.close()
    drop = lines.join(common, HASH).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    drop = drop.groupBy(F.col("doc_id").alias("d"), F.col("_tk").alias("t")).agg(F.collect_set(F.struct(*HASH)).alias("s"))
    drop = drop.select("d", "t", F.transform("s", lambda x: x["h1"]).alias("s1"), F.transform("s", lambda x: x["h2"]).alias("s2"))
    keep = keep or []
    rows = documents.select(*text_key(), "text", *[F.col(c).alias(f"keep_{c}") for c in keep])
    rows = rows.join(drop, rows.doc_id.eqNullSafe(drop.d) & (rows._tk == drop.t), "left").select("doc_id", "text", "s1", "s2", *[f"keep_{c}" for c in keep])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for text, s1, s2 in zip(texts(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                split = text.split("\n")
                left = split
                if s1:
                    gone = _keys(s1, s2)
                    left = [x for x in split if line_hash(x, min_chars) not in gone]
                kept = "\n".join(left)
                out.append((len(split), len(split) - len(left), hashlib.sha256(kept.encode()).hexdigest(), kept))
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept", *[f"keep_{c}" for c in keep]]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols, *(part.column(4 + i) for i in range(len(keep)))], names=names)

    extra = "".join(f", keep_{c} {documents.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string{extra}")


def _keys(s1: list[int], s2: list[int]) -> set[bytes]:
    raw = np.stack([np.array(s1, np.int64), np.array(s2, np.int64)], axis=1).tobytes()
    return {raw[i : i + 16] for i in range(0, len(raw), 16)}


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.i, k.line, c.key IS NOT NULL AND k.doc_id <> c.top AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
