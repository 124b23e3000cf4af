"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds its distinct hashed word shingles; its sketch the K least of them. Documents of equal sets are one class, and
only classes are compared.

Candidates. The sketches of two sets with the Jaccard similarity sought share at least C values: of the K least values of their union
each is in both with that probability, so fewer are shared with a probability below 1e-8 (and never, where sets fit into their sketches).
C follows from K and the similarity: at K = 64 it is 36 for 0.85 and 31 for 0.80; K grows where C would be too small. So values that no other class holds drop out, and with them classes of fewer than C shared values. Of the others,
in order from rare to common, any two that share C meet in the lists of their first (shared - C + 1) values.
- Lists of at most LIST classes give pairs.
- Longer lists never do. A pivot is taken from each, the class with the most and the most common shared values, and each member's
  difference d to the pivot's set is computed. If two members are
  similar, either both are similar to the pivot, so that the links to the pivot join them already, or their differences share an element:
  were the differences disjoint, |x ^ y| = |dx| + |dy|, and |dx| <= t (|x| + |y|) - |dy| <= t (|x| + |pivot|) as |y| <= |pivot| + |dy| and
  t < 1 (t = (1 - s) / (1 + s); similarity s means |x ^ y| <= t (|x| + |y|)). So differences are indexed in turn, rarest elements first and by
  prefixes that their sizes allow, and only pairs of which one isn't linked to the pivot are looked for. No pair is lost. That
  holds for any pivot.
- Lists of this index that are too long in turn get pivots of their own from among their members, and so on. A list holds fewer classes than
  the group that it comes from, which has its pivot besides, and where lists are joined, the pivot comes before all members in
  rank, so this ends; each of two clusters that look alike gets its pivot. Before that they are cut by the sizes of differences (in_cells),
  as differences that share a common element at the end of their prefixes are mostly too large, or too far apart in size, for each other.

Union sketches (the K least values of both sketches) drop pairs of fewer than C values in both. What is left is verified on full sets.
Links make components, by stars, in tables.

Null and empty texts have no shingles, are linked with nothing and are their own component. Rows that repeat doc_id and text get equal
results (both kept, if any). A null doc_id is never a component's id unless all of its rows have none. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import drop_stored, mix, stored, text_key, tuned, utf8
from lodestar.llm.components import components
from lodestar.llm.shingles import Shingler, signature

K = 64
#: The share of similar pairs that may fail to meet.
LOSS = 1e-8
LIST = 64
#: At most so many keys are sent to each executor to pick documents by (some tens of MB); beyond, both sides are shuffled.
SENT = 500_000
#: The sets of pivots are sent to each executor up to so many bytes.
SENT_BYTES = 8_000_000


@cache
def shared(similarity: int, k: int = K) -> int:
    """C: the most values that sketches of k of two similar sets share, but for a share of LOSS of such pairs.

    At most k s^2, so that where less than C is asked of a set, its union with any similar set fits into the sketches."""
    c, fewer = 0, 0
    while c < k * similarity**2 // 10_000:
        fewer += math.comb(k, c) * similarity**c * (100 - similarity) ** (k - c)
        if fewer * round(1 / LOSS) >= 100**k:
            break
        c += 1
    return c


C = shared(85)
#: Sketches grow until similar sets share so many values.
LEAST = 8


@cache
def fitted(similarity: int) -> tuple[int, int]:
    """Size of the sketches, and C."""
    if not 1 <= similarity <= 100:
        raise ValueError(f"similarity must be from 1 to 100 percent, not {similarity}")
    k = K
    while shared(similarity, k) < LEAST:
        k *= 2
    return k, shared(similarity, k)


def _rows(batch: pa.RecordBatch, column: int, width: int) -> Iterator[np.ndarray]:
    data, bounds = utf8(batch.column(column))
    shingler = Shingler(width)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield shingler.row(data[a:b])


def _longs(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Rows of a column of longs, as unsigned."""
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def sketches(documents: DataFrame, width: int, k: int = K) -> DataFrame:
    """(doc_id, _tk, node binary, n, sketch array<long>); node is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_rows(batch, 2, width))
            node = pa.array([signature(x) if len(x) else None for x in sets], pa.binary())
            n = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, n, _longs([x[:k] for x in sets])], names=["doc_id", "_tk", "node", "n", "sketch"])

    return documents.select(*text_key(), "text").mapInArrow(run, "doc_id long, _tk long, node binary, n long, sketch array<long>")


def full_sets(documents: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rid, full array<long>) of the classes wanted (rid, d, t): d and t tell a row of each."""
    small = wanted.count() <= SENT
    wanted = wanted.select("rid", "d", "t")
    rows = documents.select(*text_key(), "text")
    rows = rows.join(F.broadcast(wanted) if small else wanted, rows.doc_id.eqNullSafe(F.col("d")) & (rows._tk == F.col("t"))).select("rid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _longs(list(_rows(batch, 1, width)))], names=["rid", "full"])

    return rows.mapInArrow(run, "rid long, full array<long>").dropDuplicates(["rid"])


def needed(n: Column, similarity: int) -> Column:
    """Least number of shared sketch values with any similar set."""
    return F.greatest(F.least(F.ceil(n * similarity / 100 - 1e-9), F.lit(fitted(similarity)[1])), F.lit(1))


def prefixes(reps: DataFrame, similarity: int) -> DataFrame:
    """(v, rid, n, rank): the rarest shared values of each class that can have a similar one. The less the rank, the better a pivot: it
    puts classes with many shared values first, then those with common ones."""
    post = reps.select("rid", "n", F.explode("sketch").alias("v"))
    common = post.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = post.join(common, "v").groupBy("rid", "n").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("s"))  # at most K values
    s, c = F.size("s"), needed(F.col("n"), similarity)
    weight = F.aggregate("s", F.lit(0).cast("long"), lambda total, x: total + x["f"])
    rank = (c - s).cast("long") * F.lit(1 << 40) - F.least(weight, F.lit((1 << 40) - 1))
    able = shared.where(s >= c)
    return able.select("rid", "n", rank.alias("rank"), F.explode(F.slice("s", 1, (s - c + 1).cast("int"))).alias("x")).select(F.col("x.v").alias("v"), "rid", "n", "rank")


def _sizes_fit(a: Column, b: Column, similarity: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * similarity


def members(*columns: str) -> list[Column]:
    """Two hashes that tell the members of lists apart."""
    return [F.bit_xor(F.xxhash64(*columns, F.lit(k))).alias(f"m{k}") for k in (1, 2)]


def value_lists(entries: DataFrame) -> DataFrame:
    """(v, f, p, prank): lists with their length, pivot and its rank; of lists with the same members, which give the same pairs, one."""
    lists = entries.groupBy("v").agg(F.count(F.lit(1)).alias("f"), F.min(F.struct("rank", "rid")).alias("p"), *members("rid")).where("f > 1")
    return lists.groupBy("f", "m1", "m2").agg(F.min(F.struct("v", "p.rid", "p.rank")).alias("one")).select("one.v", "f", F.col("one.rid").alias("p"), F.col("one.rank").alias("prank"))


def list_pairs(entries: DataFrame, lists: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of lists of at most LIST classes, and stars (p, prank, x, side, rank) of longer lists: the members x of the group of a pivot p."""
    short = entries.join(lists.where(F.col("f") <= LIST).select("v"), "v")
    a, b = short.select("v", F.col("rid").alias("a"), F.col("n").alias("na")), short.select("v", F.col("rid").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, "v").where((F.col("a") < F.col("b")) & _sizes_fit(F.col("na"), F.col("nb"), similarity)).select("a", "b").distinct()
    stars = entries.join(lists.where(F.col("f") > LIST).select("v", "p", "prank"), "v").where("rid <> p")
    return pairs, stars.select("p", "prank", F.col("rid").alias("x"), F.lit(0).alias("side"), "rank").distinct()


def gathered(stars: DataFrame) -> DataFrame:
    """(g, p, x, side, rank) of stars (p, prank, x, rank) of lists all of whose pairs are looked for. Any class does as a pivot: so where a pivot
    is itself in the groups of others, its members and it go to the first of these in rank, as groups that overlap mostly hold the same
    members. Lists of one pivot make one group. A pivot still comes before all of its members in rank."""
    other = stars.select(F.col("p").alias("q"), F.col("prank").alias("qrank"), F.col("x").alias("p"))
    first = other.join(stars.select("p").distinct(), "p").groupBy("p").agg(F.min(F.struct("qrank", "q")).alias("to"))
    rows = stars.join(first, "p", "left")
    moved = rows.where("to is not null").select(F.col("to.q").alias("p"), F.col("p").alias("x"), F.col("prank").alias("rank"))
    rows = rows.select(F.coalesce("to.q", "p").alias("p"), "x", "rank").unionByName(moved).distinct()
    return rows.select(F.xxhash64("p").alias("g"), "p", "x", F.lit(0).alias("side"), "rank")


def estimated(pairs: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose union sketches allow for the similarity."""
    sk = reps.select("rid", "n", "sketch")
    a = sk.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = sk.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    met = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb")
    k, least = fitted(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            keep = []
            for x, y, n, m in zip(_lists(batch.column(4)), _lists(batch.column(5)), na, nb, strict=True):
                both = np.sort(np.concatenate([x, y]))
                twin = both[1:] == both[:-1]
                if n <= k and m <= k:
                    hits = int(twin.sum())
                    keep.append(100 * hits >= similarity * (len(both) - hits))
                else:
                    first = np.r_[True, ~twin]  # one for each value of the union
                    last = int(np.searchsorted(np.cumsum(first), k, "right"))
                    keep.append(int(twin[: max(0, last - 1)].sum()) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    both = np.sort(np.concatenate([x, y]))
    hits = int((both[1:] == both[:-1]).sum())
    return 100 * hits >= similarity * (len(both) - hits)


def _with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    one = sets.select(F.col("rid").alias(a), F.col("full").alias("fa"))
    two = sets.select(F.col("rid").alias(b), F.col("full").alias("fb"))
    return pairs.join(one, a).join(two, b).select(a, b, "fa", "fb")


def verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(x, y, similarity) for x, y in zip(_lists(batch.column(2)), _lists(batch.column(3)), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_sets(pairs, sets, "a", "b").mapInArrow(run, "a long, b long")


#: Pairs meet sets, and sketches, in runs that send so many times what there is of either at most, so that disk doesn't grow with the number of pairs.
SENT_TIMES = 2
#: Up to so many longs that are sent need no second run (some tens of MB).
SENT_LONGS = 8_000_000


def runs(sent: float, there: float) -> int:
    return max(1, math.ceil(sent / max(1, SENT_LONGS, SENT_TIMES * there)))


def in_runs(pairs: DataFrame, n: int) -> list[DataFrame]:
    """The pairs (a, b) in n parts."""
    return [pairs.where(F.pmod(F.xxhash64("a"), F.lit(n)) == i) for i in range(n)] if n > 1 else [pairs]


def pairs_to_verify(pairs: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    """estimated() of pairs, in runs."""
    pairs, k = stored(pairs, "met"), fitted(similarity)[0]
    parts = [stored(estimated(part, reps, similarity), "pairs") for part in in_runs(pairs, runs(pairs.count() * k, reps.count() * k))]
    drop_stored(pairs)
    return union(parts)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs whose classes the links don't join, be it through others."""
    found = components(links)
    for side in "ab":
        pairs = pairs.join(found.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
    return pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def all_links(pairs: DataFrame, near: DataFrame | None, sets: DataFrame, sizes: DataFrame, similarity: int) -> list[DataFrame]:
    """Links of pairs (a, b) and near ones that make the same components as all similar pairs; sizes (rid, n) are those of the sets.

    Where pairs would send sets too often, each class is verified with one other first; pairs that are joined then need no set."""
    there = sets.select("rid").join(sizes, "rid").agg(F.sum("n")).first()[0] or 0
    sent = lambda df: df.join(sizes.withColumnRenamed("rid", "a"), "a").agg(F.sum("n")).first()[0] or 0
    links = [near] if near is not None else []
    if runs(sent(pairs), there) > 1:
        one = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        links.append(stored(verified(one, sets, similarity), "first-links"))
        pairs = stored(apart(pairs, union(links)), "pairs-apart")
    return links + [stored(verified(part, sets, similarity), "links") for part in in_runs(pairs, runs(sent(pairs), there))]


#: Kinds of entries of the index of differences: those of unlinked members, for pairs of two such; those of unlinked members, and of
#: linked ones, for pairs of both.
OPEN, OPEN_TO_LINKED, LINKED = range(3)


def difference(p: np.ndarray, x: np.ndarray, similarity: int) -> tuple[bool, np.ndarray, dict[int, int]]:
    """If x is similar to the pivot p, the keys of its difference, and how many of them stand in the index, by kind, from the first in
    any order that is the same for all members."""
    d = np.concatenate([x[~np.isin(x, p, assume_unique=True)], mix(p[~np.isin(p, x, assume_unique=True)] + np.uint64(1))])
    t, most = (100 - similarity) / (100 + similarity), 100 / similarity
    linked = len(d) * (100 + similarity) <= (100 - similarity) * (len(x) + len(p))

    def first(overlap: float) -> int:
        return max(0, len(d) - max(1, int(overlap)) + 1)

    half = math.floor((len(d) + t * (len(p) - len(x))) / 2 - 1e-9) + 1
    if linked:
        return True, d, {LINKED: first(half)}
    least = math.ceil(len(d) - t * len(x) * (1 + most) - 1e-9)  # of d, no more than |x ^ y| can be missing from the other difference
    out = {OPEN: first(max(half, least))}
    if least <= t * (len(x) * most + len(p)) + 1e-9:  # else no linked member's difference is large enough
        out[OPEN_TO_LINKED] = first(least)
    return False, d, out


#: Bits of a parity map, in longs.
WORDS = 8


def parities(x: np.ndarray) -> np.ndarray:
    """For each bit, if an odd number of elements of the set fall on it. The maps of two sets differ in no more bits than the sets in elements."""
    odd = np.bincount((x & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def differences(stars: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(g, p, x, side, rank, linked, n, d, first array<int>, bits array<long>): each member's difference, its entries in the index by kind, and
    the parity map of its set."""
    one = sets.select(F.col("rid").alias("x"), F.col("full").alias("fx"))
    two = sets.join(stars.select(F.col("p").alias("rid")).distinct(), "rid", "left_semi").select(F.col("rid").alias("p"), F.col("full").alias("fp"))
    size = two.agg(F.sum(F.size("fp"))).first()[0] or 0
    if size * 8 <= SENT_BYTES:  # so that members' sets don't meet their pivot's by a shuffle
        two = F.broadcast(two)
    rows = stars.join(one, "x").join(two, "p").select("g", "p", "x", "side", "rank", "fx", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = _lists(batch.column(5))
            got = [difference(p, x, similarity) for x, p in zip(xs, _lists(batch.column(6)), strict=True)]
            n = pa.array(np.diff(batch.column(5).offsets.to_numpy()), pa.int32())
            first = pa.array([[g[2].get(k, 0) for k in (OPEN, OPEN_TO_LINKED, LINKED)] for g in got], pa.list_(pa.int32()))
            cols = [*(batch.column(i) for i in range(5)), pa.array([g[0] for g in got], pa.bool_()), n, _longs([g[1] for g in got]), first, _longs([parities(x) for x in xs])]
            yield pa.RecordBatch.from_arrays(cols, names=["g", "p", "x", "side", "rank", "linked", "n", "d", "first", "bits"])

    return rows.mapInArrow(run, "g long, p long, x long, side int, rank long, linked boolean, n int, d array<long>, first array<int>, bits array<long>")


#: A list of the index: elements of a group's differences, by the pairs that are looked for.
LIST_ID = ["g", "key", "use"]


def difference_counts(found: DataFrame) -> DataFrame:
    """(g, key, f): how many members of a group have an element in their difference; counted by batches before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _lists(batch.column(1))
            if not rows:
                continue
            key = np.concatenate(rows).view(np.int64)
            g = np.repeat(batch.column(0).to_numpy(), [len(x) for x in rows])
            order = np.lexsort((key, g))
            g, key = g[order], key[order]
            first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.zeros(0, np.int64)
            f = np.diff(np.r_[first, len(key)])
            yield pa.RecordBatch.from_arrays([pa.array(g[first]), pa.array(key[first]), pa.array(f, pa.int64())], names=["g", "key", "f"])

    return found.select("g", "d").mapInArrow(run, "g long, key long, f long").groupBy("g", "key").agg(F.sum("f").alias("f"))


#: Elements of a group that are gathered in one array.
PART = 4096


def with_open(found: DataFrame) -> DataFrame:
    """The rows of groups that have members that aren't linked; others need no index."""
    return found.join(found.where("not linked").select("g").distinct(), "g", "left_semi")


def difference_parts(found: DataFrame, often: DataFrame) -> DataFrame:
    """(g, parts, members): in how many arrays the shared elements of each group are gathered, and how many members it has."""
    sizes = found.groupBy("g").agg(F.count(F.lit(1)).alias("members"))
    return often.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")).join(sizes, "g")


def in_parts(found: DataFrame, parts: DataFrame) -> DataFrame:
    """(g, x, part, own): the elements of each member's difference by part. Each element is in its part and in the last, whatever the number
    of parts."""
    last = F.col("parts")
    ids = F.concat(F.array_distinct(F.transform("d", lambda k: F.pmod(k, last))), F.array(last))
    own = lambda q: F.when(q == last, F.col("d")).otherwise(F.filter("d", lambda k: F.pmod(k, last) == q))
    cut = F.explode(F.transform(ids, lambda q: F.struct(q.alias("part"), own(q).alias("own")))).alias("e")
    return found.join(parts, "g").select("g", "x", cut).select("g", "x", "e.part", "e.own")


def difference_index(found: DataFrame, often: DataFrame, parts: DataFrame) -> DataFrame:
    """(g, key, use, role, x, rank, n, size, bits, at): the entries of found, from the rarest keys of the group.

    In a list, any two of role 0 are looked for, and any of role 1 with any of role 2. In a group of side 0 all pairs are looked for, in one of
    sides 1 and 2 those of both sides: so entries of OPEN have their side for a role; OPEN_TO_LINKED has role 1 and LINKED role 2, in
    a list for members of side 2 (use 2) or others (use 1), by the side of the unlinked one.

    Elements that no other member has come first, and make no pairs. The others (often) are kept by group with their counts, in arrays of some
    thousand, which members meet by parts: only what a prefix reaches becomes rows."""
    # what most members have is a part of its own, the last; it has at most twice as many elements as a member has on average
    part = F.when(F.col("f") * 2 > F.col("members"), F.col("parts")).otherwise(F.pmod("key", "parts"))
    arrays = often.join(parts, "g").groupBy("g", part.alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "key"))), lambda e: e["key"]).alias("shared"))
    met = in_parts(found, parts).join(arrays, ["g", "part"])
    met = met.select("g", "x", "part", F.array_intersect("shared", "own").alias("both"))  # in the order of shared
    ranked = met.groupBy("g", "x").agg(F.array_sort(F.collect_list(F.struct("part", "both"))).alias("s"))  # of a member's own difference
    ranked = ranked.select("g", "x", F.flatten(F.transform("s", lambda e: e["both"])).alias("keys"))
    rows = found.withColumn("size", F.size("d")).drop("d", "p").join(ranked, ["g", "x"])
    alone = F.col("size") - F.size("keys")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), (F.col("first")[k] - alone).alias("m")) for k in (OPEN, OPEN_TO_LINKED, LINKED)))
    rows = rows.withColumn("alone", alone).withColumn("k", F.explode(kinds)).where("k.m > 0")
    rows = rows.select("g", "x", "side", "rank", "n", "size", "bits", "alone", "k.kind", F.posexplode(F.slice("keys", F.lit(1), F.col("k.m"))).alias("at", "key"))
    side, kind = F.col("side"), F.col("kind")
    use = F.when(kind == OPEN, 0).when(kind == OPEN_TO_LINKED, F.when(side == 2, 2).otherwise(1)).otherwise(F.when(side == 1, 2).otherwise(1))
    role = F.when(kind == OPEN, side).when(kind == OPEN_TO_LINKED, 1).otherwise(2)
    return rows.select("g", "key", use.alias("use"), role.alias("role"), "x", "rank", "n", "size", "bits", (F.col("at") + F.col("alone")).alias("at"))


#: At most so many times as many pairs as members come from a list of two roles; lists of differences, which few pairs pass, may be so
#: many times as long as those of sketch values, as each further level costs a round over tables.
TIMES, DEEP = 8, 4


def difference_lists(index: DataFrame) -> DataFrame:
    """(g, key, use, p, prank, long): lists that pairs are looked for in, the pivot of each and its rank, and if it needs one.

    Of lists with the same members and roles, the first in the order of the group's keys: pairs of the others are in it, with no less behind
    their entries."""
    of = lambda k: F.count_if(F.col("role") == k)
    best = F.min(F.when(F.col("role") < 2, F.struct("rank", "x")))
    lists = index.groupBy(*LIST_ID).agg(of(0).alias("n0"), of(1).alias("n1"), of(2).alias("n2"), best.alias("p"), F.min(F.struct("x", "at")).alias("least"), *members("x", "role"))
    lists = lists.where("n0 > 1 or n1 > 0 and n2 > 0").groupBy("g", "use", "n0", "n1", "n2", "m1", "m2").agg(F.min(F.struct("least.at", "key", "p.x", "p.rank")).alias("one"))
    lists = lists.select("g", "one.key", "use", "n0", "n1", "n2", F.col("one.x").alias("p"), F.col("one.rank").alias("prank"))
    most = DEEP * LIST
    long = (F.col("n0") > most) | ((F.col("n1") * F.col("n2") > most * most) & (F.least("n1", "n2") > TIMES))
    return lists.select(*LIST_ID, "p", "prank", long.alias("long"))


#: The greatest place in a cell is so many times the least, whatever the sizes, so an entry reaches some tens of cells at most.
CELL = 1.125
#: The use of a cell's list of role 0, by which its members meet those of lower cells.
LOWER = 3


def in_cells(entries: DataFrame, similarity: int) -> DataFrame:
    """Entries of long lists (with LIST_ID, role, x, rank, n, size, bits, at), whose lists are cut by the sizes of differences.

    Two differences of d elements, at an entry in front of which lie a of them, can belong to similar sets only if d - t n of each (its
    place) is no more than d + t n - 2 a of the other (its reach): that is what difference_pairs() asks, and what keeps members that share
    a common element at the end of their prefixes from meeting all others. So places are cut into cells. In a list of two roles, those of
    role 1 are in the cell of their place, and those of role 2 in all that they reach. In one of role 0 all meet in their own cells, and
    those of each cell meet those of lower ones that reach it. Each pair that can be similar is in one cell's list."""
    c, t = F.col, (100 - similarity) / (100 + similarity)
    entries = entries.select(*LIST_ID, "role", "x", "rank", "n", "size", "bits", "at").withColumn("place", c("size") - t * c("n")).withColumn("reach", c("size") + t * c("n") - 2 * c("at") + 1e-5)
    of = lambda f, k: f(F.when(c("role") == k, c("place")))
    spans = entries.groupBy(*LIST_ID).agg(
        F.coalesce(of(F.min, 0), of(F.min, 1)).alias("low"), F.coalesce(of(F.max, 0), of(F.max, 1)).alias("high"),
        F.coalesce(of(F.min, 0), of(F.min, 2)).alias("others"),
    )
    rows = entries.join(spans, LIST_ID)
    cell = lambda x: F.floor(F.log(F.greatest(x, F.lit(1e-3))) / math.log(CELL))  # noqa: E731  places of role 0 and 1 are positive
    own, last = cell(c("place")), cell(F.least("reach", "high"))
    # a partner's reach is at most its place and 2 t times its size, and its size at most that of x by the similarity
    back = F.greatest(c("low"), c("place") - 2 * t * c("n") * (100 / similarity) - 1e-5)
    steps = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    to = lambda role, use, cells: F.transform(cells, lambda q: F.struct(use.alias("to_use"), F.lit(role).alias("to_role"), q.alias("cell")))
    use, lower = c("use"), F.lit(LOWER)
    home = F.when(c("reach") >= c("others"), F.array(own)).otherwise(F.array().cast("array<bigint>"))
    places = F.when(c("role") == 0, F.concat(to(0, use, home), to(1, lower, home), to(2, lower, steps(own + 1, last)))).when(c("role") == 1, to(1, use, home)).otherwise(to(2, use, steps(cell(back), last)))
    rows = rows.withColumn("e", F.explode(places))
    return rows.select("g", F.xxhash64("key", "e.cell").alias("key"), c("e.to_use").alias("use"), c("e.to_role").alias("role"), "x", "rank", "n", "size", "bits", "at", "e.cell")


def difference_pairs(short: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of short lists, given as entries, whose differences can share as much as they have to.

    At the first entry that two differences share, no more of either than what follows is shared; pairs for which that isn't enough,
    whose sizes are too far apart, or whose parity maps differ in more bits than similar sets in elements, drop out in the join."""
    a, b = (short.select(*LIST_ID, *(F.col(c).alias(f"{c}_{side}") for c in ("role", "x", "n", "size", "bits", "at"))) for side in "ab")
    c = F.col
    room = F.lit((100 - similarity) / (100 + similarity)) * (c("n_a") + c("n_b")) + 1e-6
    left = F.least(c("size_a") - c("at_a"), c("size_b") - c("at_b"))
    able = (left * 2 + room >= c("size_a") + c("size_b")) & (F.abs(c("size_a") - c("size_b")) <= room) & _sizes_fit(c("n_a"), c("n_b"), similarity)
    able &= sum(F.bit_count(c("bits_a")[i].bitwiseXOR(c("bits_b")[i])) for i in range(WORDS)) <= room
    wanted = ((c("role_a") == 0) & (c("role_b") == 0) & (c("x_a") < c("x_b"))) | ((c("role_a") == 1) & (c("role_b") == 2))
    return a.join(b, LIST_ID).where(wanted & able).select(F.least("x_a", "x_b").alias("a"), F.greatest("x_a", "x_b").alias("b")).distinct()


def by_pivots(stars: DataFrame, sets: DataFrame, similarity: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(a, b) of members that are similar to a pivot, and pairs (a, b) to verify; each level's long lists make the next level's groups."""
    links = pairs = None
    while not stars.isEmpty():
        found = stored(differences(stars, sets, similarity), "differences")
        linked = stored(found.where("linked").select(F.col("p").alias("a"), F.col("x").alias("b")), "linked")
        wanted = with_open(found)
        often = stored(difference_counts(wanted).where("f > 1"), "difference-counts")
        parts = stored(difference_parts(wanted, often), "difference-parts")
        index = stored(difference_index(wanted, often, parts), "difference-index")
        drop_stored(found, often, parts)
        lists = stored(difference_lists(index), "difference-lists")
        listed = stored(index.join(lists, LIST_ID), "listed")
        drop_stored(index, lists)
        cells = stored(in_cells(listed.where("long"), similarity), "cells")
        lists = stored(difference_lists(cells), "cell-lists")
        cut = stored(cells.join(lists, LIST_ID), "listed")
        drop_stored(cells, lists)
        entries = [*LIST_ID, "role", "x", "n", "size", "bits", "at"]
        met = stored(difference_pairs(listed.where("not long").select(entries).unionByName(cut.where("not long").select(entries)), similarity), "met")
        links, pairs = (linked, met) if links is None else (links.unionByName(linked), pairs.unionByName(met))
        long = cut.where("long and x <> p")
        whole = stored(long.where("role = 0").select("p", "prank", "x", "rank").distinct(), "long-lists")
        sided = long.where("role <> 0").select(F.xxhash64("g", "p", "use", "cell").alias("g"), "p", "x", F.col("role").alias("side"), "rank").distinct()
        stars = stored(gathered(whole).unionByName(sided), "stars")
        drop_stored(listed, cut)
    return links, pairs


def near_duplicates(documents: DataFrame, similarity: int = 85, width: int = 5) -> DataFrame:
    """One row for each row of documents: doc_id, _tk (hash of the text), n_shingles, component_id, kept.

    similarity: percent (1 to 100) of the union that the intersection has at least; width: words of a shingle.
    """
    tuned(documents.sparkSession)
    documents = documents.select("doc_id", "text")
    rows = stored(sketches(documents, width, fitted(similarity)[0]), "sketches")
    picked = F.min(F.struct("doc_id", "_tk")).alias("one")
    reps = rows.where("node is not null").groupBy("node").agg(picked, F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = stored(reps.select(F.monotonically_increasing_id().alias("rid"), "node", F.col("one.doc_id").alias("d"), F.col("one._tk").alias("t"), "low", "n", "sketch"), "classes")
    nodes = stored(rows.select("doc_id", "_tk", "n", "node"), "nodes")
    drop_stored(rows)
    entries = stored(prefixes(reps, similarity), "entries")
    lists = stored(value_lists(entries), "lists")
    pairs, stars = list_pairs(entries, lists, similarity)
    pairs, stars = pairs_to_verify(pairs, reps, similarity), stored(stars, "long-lists")
    stars = stored(gathered(stars), "stars")
    drop_stored(entries, lists)
    used = pairs.select(F.explode(F.array("a", "b")).alias("rid")).unionByName(stars.select(F.explode(F.array("p", "x")).alias("rid"))).distinct()
    sets = stored(full_sets(documents, reps.select("rid", "d", "t").join(used, "rid"), width), "sets")
    near, more = by_pivots(stars, sets, similarity)
    if more is not None:
        pairs = stored(pairs.unionByName(more).distinct(), "all-pairs")
    links = union(all_links(pairs, near, sets, reps.select("rid", "n"), similarity))
    drop_stored(sets)
    found = components(links)
    named = reps.select("rid", "node", "low").join(found.withColumnRenamed("node", "rid"), "rid", "left")
    named = named.withColumn("root", F.coalesce("root", "rid"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_node = stored(named.join(least, "root").select("node", "component_id"), "components")
    drop_stored(reps)
    out = nodes.join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "_tk", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
