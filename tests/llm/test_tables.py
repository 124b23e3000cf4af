"""Operators that relate rows: decontamination, line dedup, repeated strings, near duplicates, and the pipeline."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import common, components, decontam, line_dedup, neardup, suffix_dedup
from lodestar.llm.shingles import Shingler, signature

DATA = "/root/testdata/sf0.001"


def rows_of(df) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(got: list[tuple], want: list[tuple]) -> None:
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def ascii_lower(t: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


# --- decontamination ---


def brute_decontaminate(docs: list[tuple], items: list[tuple], width: int = 13) -> list[tuple]:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1)):
            if w:
                wins[tuple(w[k : k + width])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[k : k + n]))) is not None:
                    found |= own
                    hit.update(range(k, k + n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark, edges, empty):
    texts = [t for _, t in rows_of(edges) if t]
    items = [(1, " ".join(texts[0].split()[5:30])), (2, "one two three"), (3, "of more than forty code points, stands in"), (None, "largest"), (4, None), (5, ""), (6, "ab " * 20), (2, "ONE TWO"), (7, "größe ﬁn ünïcode")]
    items.append((8, texts[-1][:60]))
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, term string")
    got = decontam.decontaminate(edges, bench).drop("_tk", "whole").collect()
    same([tuple(r) for r in got], brute_decontaminate(rows_of(edges), items))
    assert decontam.decontaminate(empty, bench).count() == 0
    assert {r["n_hit"] for r in decontam.decontaminate(edges, bench.limit(0)).collect()} == {0}


def test_decontamination_in_blocks_of_terms(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ROWS", 200)
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    got = decontam.decontaminate(docs, bench).drop("_tk", "whole").collect()
    same([tuple(r) for r in got], brute_decontaminate(rows_of(docs), [tuple(r) for r in bench.select("item_id", "text").collect()]))


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "a zebra b quick c brown d fox e"), (2, "zebra only")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "quick zebra brown fox")], "item_id long, text string")
    got = decontam.matches(docs, bench, width=8, near=True).collect()
    assert {(r["doc_id"], r["kind"]) for r in got} == {(1, "near")}


# --- line dedup ---


def brute_lines(docs: list[tuple], min_chars: int = 40, min_docs: int = 5) -> list[tuple]:
    key = lambda x: ascii_lower(x.strip(" \t\n\x0b\f\r"))
    held = collections.defaultdict(list)
    for d, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(d)
    gone = {k: max((d for d in ds if d is not None), default=None) for k, ds in held.items() if len(k) >= min_chars and len(set(ds)) >= min_docs}
    out = []
    for d, t in docs:
        split = (t or "").split("\n")
        left = [x for x in split if key(x) not in gone or gone[key(x)] == d]
        out.append((d, len(split), len(split) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


def test_line_dedup(edges, empty):
    got = line_dedup.dedup_lines(edges, keep=["lang", "kept"]).collect()
    same([(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got], brute_lines(rows_of(edges)))
    assert sum(r["n_dropped"] for r in got) >= 5 and {r["keep_kept"] for r in got} == {"kept"}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_repeated_ids_count_once(spark):
    line = "one very long line that has by far more than forty code points in it"
    few = [(1, line)] * 4 + [(2, line)]
    many = [(1, line), (1, line + "\nand more"), (None, line), (None, line), (2, line), (3, line), (4, line.upper())]
    for docs in (few, many):
        got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        same([(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got], brute_lines(docs))
        assert sum(r["n_dropped"] for r in got) == (0 if docs is few else 6)


def test_levels_are_compacted_and_batches_meet_the_runs(spark):
    store = line_dedup.LineRuns(spark)
    lines = [f"line number {i} that is long enough to count, by far, as it has over forty" for i in range(6)]
    fresh = []
    for b in range(5):
        docs = spark.createDataFrame([(10 * b + i, "\n".join(lines[i : i + 2])) for i in range(b, b + 1)] + [(10 * b + 9, "short")], "doc_id long, text string")
        fresh.append(line_dedup.dedup_batch(store, docs).count())
    assert fresh == [2, 1, 1, 1, 1]
    assert [len(x) for x in store.levels] == [1, 0, 1]
    assert sum(run.where("fresh").count() for run in store.runs()) == 6
    totals = [(r["top"], r["n"]) for r in store.whole().collect()]
    assert sum(n for _, n in totals) == 10 and max(totals)[0] == 44
    assert [len(x) for x in store.levels] == [0, 0, 1] and store.whole().where("n > 1").count() == 4
    store.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lodestar_lines")]


def test_runs_are_merged_without_a_shuffle(spark):
    store = line_dedup.LineRuns(spark)
    for b in range(2):
        rows = spark.createDataFrame([(k, -k, 100 * b + k) for k in range(b, 50)], "h1 long, h2 long, doc_id long")
        store.levels.append([store._write(store.marked(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))))])
    with line_dedup.sorted_scans(spark):
        one, two = store.runs()
        plan = one.join(two.hint("merge"), ["h1", "h2"], "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    store.close()


# --- repeated strings ---


def brute_repeats(docs: list[tuple], length: int) -> list[tuple]:
    raw = [(d, (t or "").encode()) for d, t in docs]
    count = collections.Counter(b[p : p + length] for _, b in raw for p in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        keep = np.ones(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                keep[p : p + length] = False
        edge = np.diff(np.r_[False, ~keep, False].astype(int))
        out.append((d, len(b), int((~keep).sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[keep].tobytes()).hexdigest()))
    return out


def repeats_of(df, length: int) -> list[tuple]:
    return [tuple(r)[:5] for r in suffix_dedup.remove_repeats(df, length).collect()]


def test_repeats(spark, edges, empty):
    same(repeats_of(edges, 200), brute_repeats(rows_of(edges), 200))
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("length", [6, 13, 40])
def test_repeats_of_other_lengths(spark, length):
    rng = random.Random(length)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["a" * 100, "ab" * 80, "b" * 37, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    same(repeats_of(df, length), brute_repeats(list(enumerate(texts)), length))


def test_repeats_across_blocks(spark, monkeypatch):
    rng = random.Random(1)
    part = "".join(rng.choice("abcdef ") for _ in range(700))
    texts = [part + "".join(rng.choice("xyz") for _ in range(300)) + part[100:], part[50:400]]
    buckets = suffix_dedup.Buckets(50)
    data = np.frombuffer(texts[0].encode(), np.uint8)
    whole = [np.concatenate(x) for x in zip(*buckets.runs(data), strict=True)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 128)
    cut = [np.concatenate(x) for x in zip(*buckets.runs(data), strict=True)]
    assert set(whole[4]) == set(cut[4]) and int((cut[3] - cut[2] + 1).sum()) == len(data) - 49
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same(repeats_of(df, 50), brute_repeats(list(enumerate(texts)), 50))


def test_merge():
    got = suffix_dedup.merge(np.array([5, 0, 3, 20]), np.array([9, 3, 4, 25]))
    assert got.tolist() == [[0, 4], [5, 9], [20, 25]] and suffix_dedup.merge(np.zeros(0, int), np.zeros(0, int)).shape == (0, 2)


# --- near duplicates ---


def brute_near(docs: list[tuple], percent: int = 85) -> list[tuple]:
    sets = []
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or ""))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            n = len(a & b)
            if a and b and 100 * n >= percent * (len(a) + len(b) - n):
                up[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(sets):
        ids[find(i)].append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(d, len(s), least[find(i)], d == least[find(i)]) for i, (d, s) in enumerate(sets)]


def near_of(df, **parameters) -> list[tuple]:
    return [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, **parameters).collect()]


def test_near_duplicates(edges, empty):
    same(near_of(edges), brute_near(rows_of(edges)))
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet")
    same(near_of(docs), brute_near(rows_of(docs)))


@pytest.mark.parametrize("size", [40, 146])
def test_large_group_goes_by_pivots(spark, monkeypatch, size):
    """Copies with growing numbers of changes, some of them shared, in lists that are far longer than allowed."""
    monkeypatch.setattr(neardup, "LIST", 4)
    rng = random.Random(size)
    base = [f"w{i}" for i in range(size)]
    pool = [(rng.randrange(size), f"s{k}") for k in range(6)]
    docs = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(5)):
            at, w = rng.choice(pool) if rng.random() < 0.5 else (rng.randrange(size), f"u{rng.random()}")
            words[at] = w
        docs.append((i, " ".join(words[: size - rng.randrange(4)])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute_near(docs)
    assert 3 < len({w[2] for w in want}) < 100
    same(near_of(df), want)


def test_sketches_estimate_and_verify():
    rng = random.Random(0)
    a = [f"w{i}" for i in range(800)]
    b = list(a)
    for i in rng.sample(range(800), 10):
        b[i] = f"x{i}"
    x, y = (Shingler().row(np.frombuffer(" ".join(t).encode(), np.uint8)) for t in (a, b))
    hits = len(np.intersect1d(x, y))
    assert neardup.similar(x, y, 85) == (100 * hits >= 85 * (len(x) + len(y) - hits))
    assert len(np.intersect1d(x[: neardup.K], y[: neardup.K])) >= neardup.C and signature(x) != signature(y)
    lost = sum(math.comb(neardup.K, i) * 0.85**i * 0.15 ** (neardup.K - i) for i in range(neardup.C))
    assert lost < 1e-8


def changed(rng: random.Random, words: list[str], n: int) -> str:
    """The words with n of them, far from each other, replaced."""
    out = list(words)
    for i in range(n):
        out[(i * 2 + 1) * len(words) // (2 * n)] = f"u{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize("roles", [(0,), (1, 2)])
def test_cells_of_long_lists_lose_no_pair_and_hold_fewer(spark, roles):
    """A list of members whose differences vary in size, by cells: the same pairs, of far fewer that meet."""
    rng, rows = random.Random(len(roles)), []
    for x in range(400):
        size = rng.randrange(66, 260)
        rows.append((1, 1, len(roles) - 1, rng.choice(roles), x, x, rng.randrange(360, 400), size, [0] * neardup.WORDS, rng.randrange(min(size // 2, 60))))
    rows.append((1, 1, len(roles) - 1, roles[0], 400, 400, 20_000, 3_000, [0] * neardup.WORDS, 0))
    entries = spark.createDataFrame(rows, "g long, key long, use int, role int, x long, rank long, n int, size int, bits array<long>, at int")
    cells = neardup.in_cells(entries, 85).cache()
    found = lambda df: sorted(tuple(r) for r in neardup.difference_pairs(df, 85).collect())
    want = found(entries)
    assert want and found(cells) == want
    met = lambda df: sum(r["z"] * (r["z"] - 1) / 2 + r["a"] * r["b"] for r in df.groupBy(*neardup.LIST_ID).agg(*(F.count_if(F.col("role") == k).alias(c) for k, c in enumerate("zab"))).collect())
    assert met(cells) * 2 < met(entries) and cells.count() < 12 * len(rows)


def test_near_dedup_stage_takes_similarities_from_80(spark, sf_dir):
    import corpus_pipeline

    rng, docs = random.Random(3), []
    for g, (size, n) in enumerate([(104, 2), (104, 3), (404, 8), (404, 9), (404, 4), (30, 0)] * 3):
        words = [f"g{len(docs)}w{i}" for i in range(size)]
        docs += [(10 * g, " ".join(words)), (10 * g + 1, changed(rng, words, n) if n else " ".join(words))]
    kept = [d for d, _, _, k in brute_near(docs, 80) if k]
    assert len(kept) < sum(k for *_, k in brute_near(docs, 85))
    df = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, sf_dir).collect()) == kept


def test_sketches_fit_the_similarity():
    for s in (5, 20, 30, 50, 60, 70, 80, 85, 95, 100):
        k, c = neardup.fitted(s)
        assert neardup.LEAST <= c <= k * s * s / 10_000
        assert sum(math.comb(k, i) * s**i * (100 - s) ** (k - i) for i in range(c)) * 10**8 < 100**k
    assert neardup.fitted(85) == (64, 36) == (neardup.K, neardup.C)
    with pytest.raises(ValueError):
        neardup.fitted(0)


@pytest.mark.parametrize("percent", [30, 50])
def test_low_similarities_lose_no_pair(spark, percent):
    rng, docs = random.Random(percent), []
    for g in range(25):
        words = [f"g{g}w{i}" for i in range(304)]
        docs += [(2 * g, " ".join(words)), (2 * g + 1, changed(rng, words, {30: 30, 50: 19}[percent]))]
    want = brute_near(docs, percent)
    assert sum(k for *_, k in want) == 25
    same(near_of(spark.createDataFrame(docs, "doc_id long, text string"), similarity=percent), want)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(4, 40), st.integers(50, 95))
def test_pivot_entries_lose_no_link(seed, size, percent):
    """Members that are similar, but not both to the pivot, share an entry of their kinds."""
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(1, 2**62, 3 * size).astype(np.uint64))
    core = pool[:size]

    def member() -> np.ndarray:
        drop = rng.random(len(core)) < rng.random() * 0.3
        return np.unique(np.concatenate([core[~drop], rng.choice(pool[size:], rng.integers(0, max(2, size // 4)))]))

    p, x, y = member(), member(), member()
    if not (len(p) and len(x) and len(y)) or not neardup.similar(x, y, percent):
        return
    (lx, dx, nx), (ly, dy, ny) = (neardup.difference(p, s, percent) for s in (x, y))
    assert len(dx) == len(np.setxor1d(p, x)) and len(dy) == len(np.setxor1d(p, y))
    assert lx == neardup.similar(p, x, percent)
    if lx and ly:
        return
    entries = lambda d, n, kind: d[np.lexsort((d, d % np.uint64(7)))][: n.get(kind, 0)]  # noqa: E731  any order
    if not lx and not ly:
        met = np.intersect1d(entries(dx, nx, neardup.OPEN), entries(dy, ny, neardup.OPEN))
    else:
        (d, n), (e, m) = ((dx, nx), (dy, ny)) if ly else ((dy, ny), (dx, nx))
        met = np.intersect1d(entries(d, n, neardup.OPEN_TO_LINKED), entries(e, m, neardup.LINKED))
    assert len(met)


def test_members_far_from_their_pivot_have_few_entries():
    rng = np.random.default_rng(5)
    core = np.unique(rng.integers(1, 2**62, 146).astype(np.uint64))
    p, x = (np.unique(np.concatenate([rng.permutation(core)[40:], rng.integers(1, 2**62, 40).astype(np.uint64)])) for _ in range(2))
    linked, d, n = neardup.difference(p, x, 80)
    # a similar set has no more of x missing or in addition than this
    apart = 20 / 180 * len(x) * (1 + 100 / 80)
    assert not linked and len(d) > 2 * apart and n[neardup.OPEN] <= apart + 1


def test_pairs_whose_parity_maps_are_too_far_apart_drop_out(spark):
    rng = np.random.default_rng(6)
    x = np.unique(rng.integers(1, 2**62, 146).astype(np.uint64))
    y, z = (np.concatenate([x[k:], rng.integers(1, 2**62, k).astype(np.uint64)]) for k in (5, 70))
    bits = [neardup.parities(s).view(np.int64).tolist() for s in (x, y, z)]
    for one, two in ((x, y), (x, z), (y, z)):
        apart, bound = (int(np.bitwise_count(neardup.parities(one) ^ neardup.parities(two)).sum()), len(np.setxor1d(one, two)))
        assert apart <= bound and apart % 2 == bound % 2
    rows = [(1, 1, 0, 0, k, 0, 146, 80, b, 0) for k, b in enumerate(bits)]
    short = spark.createDataFrame(rows, "g long, key long, use int, role int, x long, rank long, n int, size int, bits array<long>, at int")
    assert sorted(tuple(r) for r in neardup.difference_pairs(short, 80).collect()) == [(0, 1)]


def clusters(size: int, of: int, rng: random.Random) -> list[tuple]:
    """Two clusters of near copies, whose cores share 0.7 of their shingles."""
    base = [f"w{i}" for i in range(400)]
    cores = [base, changed(rng, base, 14).split(" ")]
    return [(of * c + i, changed(rng, core, 1 + i % 3)) for c, core in enumerate(cores) for i in range(size)]


def test_pairs_of_two_clusters_grow_in_proportion(spark, monkeypatch):
    seen, by_pivots = [], neardup.by_pivots

    def counted(stars, sets, similarity):
        links, pairs = by_pivots(stars, sets, similarity)
        seen.append((links.count(), pairs.count()))
        return links, pairs

    monkeypatch.setattr(neardup, "by_pivots", counted)
    monkeypatch.setattr(neardup, "LIST", 8)
    for size in (60, 120, 240):
        docs = clusters(size, 1000, random.Random(size))
        got = near_of(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
        assert {(d // 1000, c) for d, _, c, _ in got} == {(0, 0), (1, 1000)}
    (l1, p1), _, (l3, p3) = seen
    assert l3 <= 6 * l1 and p3 <= 6 * max(p1, 60)


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_stored_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    df = common.stored(spark.range(5000).withColumn("k", F.xxhash64("id")).repartition(5, "k"), "shuffled")
    for _ in range(100):  # they go behind the query's back
        if (left := shuffle_files(spark)) <= before:
            break
        time.sleep(0.1)
    assert left <= before and df.count() == 5000 and spark.conf.get(common.CLEANUP) == "false"


def test_near_duplicates_keep_no_large_table(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LIST", 8)
    first = len(common._made)
    docs = clusters(40, 1000, random.Random(1))
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    left = {re.sub("-[0-9a-f]+$", "", path.rsplit("/", 1)[1]) for _, path in common._made[first:]}
    assert left and not left & {"sketches", "classes", "entries", "sets", "differences", "difference-counts", "difference-index"}
    assert {r["component_id"] for r in got.collect()} == {0, 1000}


def test_pairs_that_others_join_meet_no_sets(spark, monkeypatch):
    """One class with each other first, then those that this leaves apart, in runs."""
    seen, verified = [], neardup.verified

    def counted(pairs, sets, similarity):
        seen.append(pairs.count())
        return verified(pairs, sets, similarity)

    monkeypatch.setattr(neardup, "verified", counted)
    monkeypatch.setattr(neardup, "SENT_LONGS", 0, raising=False)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    docs = [(i, changed(rng, base, 1 + i % 3)) for i in range(40)]
    same(near_of(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)), brute_near(docs))
    assert sum(seen) < 40 * 39 / 4


def test_op9_leaves_results_only(spark):
    from lodestar.llm import queries

    first = len(common._made)
    out = queries.queries()["op9_minhash_near_dedup"](spark, DATA)
    made = {re.sub("-[0-9a-f]+$", "", path.rsplit("/", 1)[1]) for _, path in common._made[first:]}
    assert "components" in made and not made & {"sketches", "classes", "sets"}
    assert out.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_difference_isnt_repeated_for_each_part(spark):
    rng = np.random.default_rng(2)
    ds = [rng.integers(-(2**62), 2**62, 300).tolist() for _ in range(3)]
    found = spark.createDataFrame([(1, x, d) for x, d in enumerate(ds)], "g long, x long, d array<long>")
    parts = spark.createDataFrame([(1, 16, 3)], "g long, parts long, members long")
    rows = neardup.in_parts(found, parts).collect()
    assert sum(len(r["own"]) for r in rows) == 2 * sum(map(len, ds))
    for x, d in enumerate(ds):
        own = {r["part"]: r["own"] for r in rows if r["x"] == x}
        assert own.pop(16) == d and sorted(k for v in own.values() for k in v) == sorted(d)
        assert all(k % 16 == part for part, v in own.items() for k in v)


def test_lists_of_the_same_members_give_their_pairs_once(spark):
    # keys 1 and 3 have the same members; 2 has others
    rows = [(1, key, 0, 0, x, 0, 50, 20, at) for key, xs, at in ((3, (5, 6, 7), 4), (1, (5, 6, 7), 2), (2, (5, 6), 3)) for x in xs]
    index = spark.createDataFrame(rows, "g long, key long, use int, role int, x long, rank long, n int, size int, at int")
    assert sorted(tuple(r) for r in neardup.difference_lists(index).collect()) == [(1, 1, 0, 5, 0, False), (1, 2, 0, 5, 0, False)]
    entries = spark.createDataFrame([(v, x, 50, x) for v, xs in ((11, (1, 2)), (12, (1, 2)), (13, (1, 2, 3))) for x in xs], "v long, rid long, n long, rank long")
    assert sorted(tuple(r) for r in neardup.value_lists(entries).collect()) == [(11, 2, 1, 1), (13, 3, 1, 1)]


def test_groups_that_overlap_have_one_pivot(spark):
    # lists {1, 2, 3, 4}, {2, 3, 4, 5} and {7, 8}, by ranks as their numbers
    stars = spark.createDataFrame([(p, p, x, 0, x) for p, xs in ((1, (2, 3, 4)), (2, (3, 4, 5)), (7, (8,))) for x in xs], "p long, prank long, x long, side int, rank long")
    rows = neardup.gathered(stars).collect()
    assert sorted((r["p"], r["x"]) for r in rows) == [(1, 2), (1, 3), (1, 4), (1, 5), (7, 8)]
    assert len({r["g"] for r in rows}) == 2 and all(r["rank"] == r["x"] and r["side"] == 0 for r in rows)


def test_words_that_collide_modulo_a_power_of_two(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64, whatever the odd base."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    docs = [(1, one), (2, two), (3, f"x y {one} z w v"), (4, f"x y {two} z w v")]
    assert {(d, c) for d, _, c, _ in near_of(spark.createDataFrame(docs, "doc_id long, text string"))} == {(i, i) for i in range(1, 5)}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(40)] + [(0, 1)] * 3
    up = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- pipeline ---


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline
    from lodestar.llm import toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    rows = [(d, t) for d, t in rows_of(docs) if d not in toxic]
    key = lambda x: ascii_lower(x.strip(" \t\n\x0b\f\r"))
    held = collections.defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in t.split("\n")}:
            held[k].append(d)
    gone = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    rows = [(d, "\n".join(x for x in t.split("\n") if gone.get(key(x), d) == d)) for d, t in rows]
    rows = [r for r, n in zip(rows, brute_near(rows, 80), strict=True) if n[3]]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    windows = lambda t: {tuple(w[k : k + 13]) for w in [words(t)] for k in range(len(w) - 12)}
    known = set().union(*(windows(t) for _, t in bench))
    rows = [r for r, n in zip(rows, brute_decontaminate(rows, bench), strict=True) if not n[5] and not windows(r[1]) & known]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {d: lib.encode(t) for d, t in rows}


def test_stages_take_edge_cases(spark, edges, sf_dir):
    import corpus_pipeline

    for docs in (edges, edges.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == corpus_pipeline.COLUMNS, name
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert corpus_pipeline.tokens(spark, docs, sf_dir).count() == docs.count()
    kept = corpus_pipeline.near_dedup(spark, edges, sf_dir)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} >= {1, 4, 5, 6, 7, 9, 10, 12, 13}
    assert kept.where(F.col("doc_id").isin(2, 3, 8, 11)).count() == 0
