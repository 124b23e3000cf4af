"""Exact removal of repeated strings by bucket-pointer refinement over a sparse set of suffixes.

Bytes covered by a string of LENGTH bytes that also starts anywhere else (in any document, the same one included) are removed; strings are
judged on the input, and overlaps count.

1. Each place has a bucket by its first GRAM bytes, named by a 64-bit hash. Buckets are refined by the identifiers of later offsets:
   depth 2 GRAM is (bucket at p, bucket at p + GRAM), depth LENGTH is (depth 2 GRAM at p, the same at p + LENGTH - 2 GRAM); each
   update is made from the one before.
2. Of the grams inside a LENGTH-byte window, the one with the least name (leftmost at ties) is the window's anchor: equal windows have equal
   anchors at equal offsets. Only anchors (about 1.5 % of all places) are sorted into buckets; the windows of an anchor are a run.
   A bucket with one anchor holds no repeat, and is done.
3. An anchor's whole run is named by the identifiers of its first and last window. Runs with equal names are repeats as a whole.
   One representative of each name goes on, where its bucket still holds a name of one member.
4. Representatives are cut into cells of STEP windows, whose buckets are named by the bytes that a cell's windows share, and treated
   alike; then into single windows.

A place is compared within its anchor's bucket alone, so names of 128 bits decide. All tables are dealt by hash, counts are combined before
they are shuffled, and joins by bucket can be split where one is hot; per document only its own runs are gathered.

Null and empty texts have no bytes. Texts are taken in blocks of BLOCK windows, whole. Rows that repeat a doc_id and text are
different places, so their texts are repeats of each other; rows of one doc_id with other texts are kept apart. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Rolling, drop_stored, mix, stored, tuned, utf8

LENGTH, GRAM = 200, 64
BLOCK = 1 << 19
#: Windows of a cell, between whole runs and single windows.
STEP = 10
#: Low bits of a gram's sort key that hold its place in the block, for leftmost ties.
PLACE = np.uint64(20)
A, B, C = np.uint64(0xB5AD4ECEDA1CE2A9), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1B54A32D192ED03)
#: At most so many document keys are sent to each executor to tell documents with repeats from others; beyond, all are shuffled.
SENT = 500_000


class Buckets:
    """Names of a block's places."""

    def __init__(self, length: int) -> None:
        self.length, self.gram, self.rolling = length, min(GRAM, (length + 1) // 2), Rolling(5)

    def names(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By place: the name of its gram, and of its window."""
        prefix, q = self.rolling.prefix(data), self.gram
        g = mix((prefix[q:] - prefix[:-q]) * self.rolling.down[: len(prefix) - q])
        wide, depth = g, q
        while depth < self.length:  # the depth doubles, then reaches length
            step = min(depth, self.length - depth)
            wide = mix(wide[:-step] * A + wide[step:] * B + np.uint64(depth))
            depth += step
        return g, wide

    def runs(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """By anchor: bucket, name of its run, first and last window of the run, anchor; a block of windows at a time."""
        w = self.length - self.gram + 1
        for at in range(0, len(data) - self.length + 1, BLOCK):
            g, wide = self.names(data[at : at + BLOCK + self.length - 1])
            key = (g >> PLACE << PLACE) | np.arange(len(g), dtype=np.uint64)
            padded = np.full(-(-len(key) // w) * w, np.uint64(2**64 - 1))
            padded[: len(key)] = key
            square = padded.reshape(-1, w)
            ahead = np.minimum.accumulate(square, axis=1).ravel()
            behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
            least = np.minimum(behind[: len(wide)], ahead[w - 1 : w - 1 + len(wide)])
            anchor = (least & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
            first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            last = np.r_[first[1:], len(anchor)] - 1
            a = anchor[first]
            name = mix(wide[first] * A + wide[last] * B + (last - first).astype(np.uint64) * C + (a - first).astype(np.uint64))
            yield g[a], name, first + at, last + at, a + at


def _keyed(documents: DataFrame) -> DataFrame:
    """documents with _tk, which tells rows of equal doc_id apart; 0 where doc_id does."""
    ids = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) if ids else F.lit(0).cast("long")
    return documents.select("doc_id", key.alias("_tk"), "text")


def _batch(cols: list[np.ndarray], row: np.ndarray, batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    take = pa.array(row)
    return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x) for x in cols)], names=["doc_id", "_tk", *names])


def anchors(documents: DataFrame, length: int) -> DataFrame:
    """(doc_id, _tk, h, name, first, last, anchor) of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(length)
        for batch in batches:
            data, bounds = utf8(batch.column(2))
            held, rows, size = [], [], 0
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                for found in buckets.runs(data[a:b]):
                    held.append(found)
                    rows.append(np.full(len(found[0]), i))
                    size += len(found[0])
                    if size > 100_000:
                        yield out(held, rows, batch)
                        held, rows, size = [], [], 0
            if held:
                yield out(held, rows, batch)

    def out(held: list, rows: list, batch: pa.RecordBatch) -> pa.RecordBatch:
        h, name, first, last, anchor = (np.concatenate([x[i] for x in held]) for i in range(5))
        cols = [h.view(np.int64), name.view(np.int64), first, (anchor - first).astype(np.int16), (last - first).astype(np.int16)]
        return _batch(cols, np.concatenate(rows), batch, ["h", "name", "first", "pre", "more"])

    return documents.mapInArrow(run, "doc_id long, _tk long, h long, name long, first long, pre short, more short")


def cells(documents: DataFrame, reps: DataFrame, length: int, step: int) -> DataFrame:
    """(doc_id, _tk, h, b, name, first, pre, more, weight): the runs of representatives in cells of step windows, by their place to the anchor.

    b names the bytes that all windows of a cell share (so cells that hold equal windows have equal b), name the whole cell."""
    per_doc = reps.groupBy(F.col("doc_id").alias("d"), F.col("_tk").alias("t")).agg(F.collect_list(F.struct("h", "first", "pre", "more", "weight")).alias("r"))
    per_doc = per_doc.select("d", "t", *(F.col(f"r.{c}").alias(c) for c in ("h", "first", "pre", "more", "weight")))
    rows = _with(documents, per_doc.select("d", "t")).join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_tk") == F.col("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(length)
        for batch in batches:
            data, bounds = utf8(batch.column(2))
            for i in range(len(batch)):
                text = data[bounds[i] : bounds[i + 1]]
                h, first, pre, more, weight = (np.array(batch.column(3 + c)[i].as_py(), np.int64) for c in range(5))
                order = np.argsort(first, kind="stable")
                h, first, pre, more, weight = (x[order] for x in (h, first, pre, more, weight))
                at = 0
                while at < len(first):
                    low, end = int(first[at]), int(np.searchsorted(first, first[at] + BLOCK, "left"))
                    part = text[low : low + 2 * BLOCK + length - 1]
                    _, wide = buckets.names(part)
                    prefix = buckets.rolling.prefix(part)
                    # cells of a run: places pre, pre - 1, ... pre - more to the anchor, cut at multiples of step
                    top, bottom = pre[at:end] // step, (pre[at:end] - more[at:end]) // step
                    count = top - bottom + 1
                    own = np.repeat(np.arange(at, end), count)
                    c = np.repeat(top, count) - (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
                    most, least = np.minimum(c * step + step - 1, pre[own]), np.maximum(c * step, pre[own] - more[own])
                    anchor = first[own] + pre[own] - low
                    f, last = anchor - most, anchor - least
                    core = anchor - c * step
                    b = mix(buckets.rolling.spans(prefix, core, core + length - step + 1) + c.astype(np.uint64) * C)
                    name = mix(wide[f] * A + wide[last] * B + most.astype(np.uint64) * C + (last - f).astype(np.uint64))
                    cols = [h[own], b.view(np.int64), name.view(np.int64), f + low, most.astype(np.int16), (last - f).astype(np.int16), weight[own].astype(np.int16)]
                    yield _batch(cols, np.full(len(f), i), batch, ["h", "b", "name", "first", "pre", "more", "weight"])
                    at = end

    return rows.select("doc_id", "_tk", "text", "h", "first", "pre", "more", "weight").mapInArrow(run, "doc_id long, _tk long, h long, b long, name long, first long, pre short, more short, weight short")


def _with(documents: DataFrame, keys: DataFrame, without: bool = False) -> DataFrame | None:
    """The documents whose key is among keys (d, t), or those others; not filtered if the keys are too many to be sent."""
    if keys.count() > SENT:
        return None if without else documents
    same = documents.doc_id.eqNullSafe(F.col("d")) & (documents._tk == F.col("t"))
    return documents.join(F.broadcast(keys), same, "left_anti" if without else "left_semi")


def refined(rows: DataFrame, bucket: list[str], length: int, last: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """A level: rows (doc_id, _tk, *bucket, name, first, pre, more, weight) to the byte runs of names that occur twice, and representatives
    of the names in buckets that hold a name of one member beside others. weight 2 stands for members that are done."""
    name = [*bucket, "name"]
    one = F.min(F.struct("doc_id", "_tk", "first", "pre", "more")).alias("one")
    classes = stored(rows.groupBy(*name).agg(F.sum("weight").alias("n"), one), "names")
    twice = classes.where("n > 1").select(*name)
    whole = rows.where("weight = 1").join(twice, name).select("doc_id", "_tk", F.col("first").alias("a"), (F.col("first") + F.col("more") + length).alias("b"))
    if last:
        return whole, None
    open_ = classes.groupBy(*bucket).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("names")).where("least = 1 and names > 1").select(*bucket)
    open_ = stored(open_, "open-buckets")
    reps = classes.join(open_, bucket).select("h", "one.doc_id", "one._tk", "one.first", "one.pre", "one.more", F.least("n", F.lit(2)).cast("short").alias("weight"))
    return whole, stored(reps, "representatives")


def repeats(documents: DataFrame, length: int) -> DataFrame:
    """(doc_id, _tk, a, b): runs of bytes that are covered by repeated strings; they may overlap. documents: keyed."""
    rows = stored(anchors(documents, length), "all-anchors")
    many = stored(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "buckets")  # on their own, so that the join can be split
    kept = stored(rows.join(many, "h").withColumn("weight", F.lit(1).cast("short")), "anchors")
    drop_stored(rows)
    found, reps = refined(kept, ["h"], length)
    for step in (STEP, 1):
        parts = stored(cells(documents, reps, length, min(step, length)), "cells")
        more, reps = refined(parts, ["h", "b"], length, last=step == 1)
        found = found.unionByName(more)
    return found


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>"


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each row of documents: the contract's digests, and removed: the bounds of maximal removed runs in turn."""
    tuned(documents.sparkSession)
    documents = _keyed(documents.select("doc_id", "text"))
    found = repeats(documents, length)
    spans = stored(found.groupBy(F.col("doc_id").alias("d"), F.col("_tk").alias("t")).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column(1))
            rows = []
            for i in range(len(batch)):
                text = data[bounds[i] : bounds[i + 1]]
                a, b = (np.array(batch.column(c)[i].as_py() or [], np.int64) for c in (2, 3))
                merged = merge(a, b)
                keep = np.ones(len(text), bool)
                for x, y in merged:
                    keep[x:y] = False
                kept = text[keep].tobytes() if len(merged) else text.tobytes()
                rows.append((len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), merged.ravel().tolist()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    keys = spans.select("d", "t")
    hit = _with(documents, keys)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_tk") == F.col("t"))
    out = hit.join(spans, same, "left").select("doc_id", "text", "a", "b")
    rest = _with(documents, keys, without=True)
    none = F.lit(None).cast("array<long>")
    if rest is not None:
        out = out.unionByName(rest.select("doc_id", "text", none.alias("a"), none.alias("b")))
    return out.mapInArrow(run, SCHEMA)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Maximal runs (n, 2) of the union of [a, b); runs that touch are one."""
    if not len(a):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
    return np.stack([a[new], b[np.r_[new[1:], len(a)] - 1]], axis=1)
