"""Operators that take rows one by one: secrets, toxicity, language, tokens, media, records."""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import flac, langid, secrets, toxicity, warc
from lodestar.llm import sentencepiece_codec as sp

DATA = "/root/testdata/sf0.001"


# --- secrets ---


def plain_base(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(a, b, secrets.KINDS[k]) for a, k, b in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "SECRET", "api_key", "apikey", "=", ":", " ", "'", '"', "abc", "0123456789abcdef", "AKIA", "ABCDEFGH", "Z9", "\n", "é", "ſecret", "toKen", ".", "+"]), max_size=25))
def test_base_spans(parts):
    text = "".join(parts)
    assert [x for x in secrets.find_secrets(text) if x[2] != "guess"] == plain_base(text)


def brute_segment(value: str) -> float:
    """Least cost over all cuts into parts, each as cheap as any of its kinds makes it."""
    n, low = len(value), value.lower()
    mixed = value != low and value != value.upper() and any(c.isascii() and c.islower() for c in value) and any(c.isascii() and c.isupper() for c in value)
    one = [secrets._class_bits(c, mixed) for c in value]
    place = {c: (y, x) for y, row in enumerate(["1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]) for x, c in enumerate(row)}

    def beside(a: str, b: str) -> bool:
        return a != b and a in place and b in place and all(abs(u - v) <= 1 for u, v in zip(place[a], place[b], strict=True))

    def costs(i: int, j: int):
        part = value[i:j]
        yield sum(one[i:j])
        if 2 <= len(part) <= secrets.LONGEST and (w := secrets._word_bits(part)) is not None:
            yield w
        if any(d.fullmatch(part) for d in secrets.DATES):
            yield np.log2(130) + (np.log2(366) + 1 if j - i > 4 else 0)
        if j - i >= 3 and all(beside(low[k - 1], low[k]) for k in range(i + 1, j)):
            yield np.log2(45) + 1.5 * (j - i - 1)
        for unit in (1, 2, 3, 4):
            if j - i >= max(3, 2 * unit) and all(value[k] == value[k - unit] for k in range(i + unit, j)):
                yield sum(one[i : i + unit]) + 0.25 * (j - i - unit)

    best = [0.0] + [float("inf")] * n
    for j in range(1, n + 1):
        best[j] = min(best[i] + (1 if i else 0) + min(costs(i, j)) for i in range(j))
    return best[n]


FOUND_DEARER = ["lovertyu", "masterfghjkl", "testtttttt", "startyuiop#9Xk"]


@pytest.mark.parametrize("value", ["password1x", "admin2024!", "zQ8#dragon", "19991231", "P@ssw0rdzz", "1201201201", "qwqwqwasdfzzz", "20012002", *FOUND_DEARER])
def test_segmentation_is_the_cheapest(value):
    bits, parts = secrets.segment(value)
    assert bits == pytest.approx(brute_segment(value), abs=1e-9)
    assert "".join(value[a:b] for _, a, b in parts) == value


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["love", "test", "Dragon", "qwert", "asdf", "poi", "t", "T", "1", "20", "2019", "12", "ab", "abab", "zz", "#", "é", "31", "-"]), max_size=8))
def test_segmentation_of_any_value_is_the_cheapest(parts):
    value = "".join(parts)
    assert secrets.segment(value)[0] == pytest.approx(brute_segment(value), abs=1e-9)


def test_long_values_take_time_in_proportion():
    assert secrets.segment("a" * 50_000 + "qw" * 20_000)[0] < 30_000


def test_keys_of_compound_names():
    found = lambda t: [t[a:b] for a, b, k in secrets.find_secrets(t) if k == "guess"]
    assert found("dbPassword=hT7$kQ9x, clientSecret: 'v9#Lq2!xZ'") == ["hT7$kQ9x", "v9#Lq2!xZ"]
    assert found("the compass: north-western, password: reminder") == []


def test_guess_costs_order():
    assert secrets.guess_bits("password123") < 20 < 60 < secrets.guess_bits("f33e61083db5dbdf4bd2369d2f80176e")
    assert secrets.guess_bits("aaaaaaaaaaaaaaaa") < 15
    assert secrets.guess_bits("qwertyuiop") < 25
    kinds = {k for _, _, k in secrets.find_secrets("db_password: 'Zx9$kQ2!vTr8mW'")}
    assert kinds == {"guess"}
    assert secrets.find_secrets("password: password123") == []
    assert secrets.segment("")[0] == 0


def test_secret_rows(edges, empty):
    got = secrets.scan_secrets(edges).collect()
    assert len(got) == edges.count() and secrets.scan_secrets(empty).count() == 0
    one = next(r for r in got if r["doc_id"] == 13)
    assert (one["n_assign"], one["n_access"], one["n_hex"]) == (1, 1, 1) and "guess:" in one["spans"]
    for r in got:
        if r["doc_id"] in (4, 5):
            assert r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == ""


# --- toxicity and language ---


def test_toxicity_holds_out_and_learns(spark, edges, empty):
    docs, labels = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet"), spark.read.parquet(f"{DATA}/../sf0.01/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").toPandas()
    for doc_id, held in zip(got["doc_id"], got["held_out"], strict=True):
        assert held == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
    seen, unseen = got[~got["held_out"]], got[got["held_out"]]
    assert ((seen["predicted"] == 1) == (seen["toxic"] == 1)).mean() > 0.97
    assert unseen[unseen["toxic"] == 0]["predicted"].mean() < 0.1
    assert unseen[unseen["toxic"] == 1]["score"].mean() > 2 * unseen[unseen["toxic"] == 0]["score"].mean()
    model = toxicity.fit(docs, labels)
    assert len(model[0]) < 5000  # L1 leaves few weights
    rows = toxicity.score(edges, model).collect()
    assert len(rows) == edges.count() and all(0 <= r["score"] <= 1 for r in rows) and toxicity.score(empty, model).count() == 0
    assert toxicity.reject(edges, model).columns == edges.columns
    none = toxicity.fit(edges, labels.limit(0))
    assert {round(r["score"], 6) for r in toxicity.score(edges, none).collect()} == {0.1}


def test_toxicity_labels_of_held_out_rows_do_not_count(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_language(spark, edges, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs)
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() >= 0.95
    rows = langid.predict(edges, model).collect()
    assert len(rows) == edges.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["lang_pred"] == by[5]["lang_pred"] == by[6]["lang_pred"] == "und" and by[7]["lang_pred"] in model["langs"]
    assert langid.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(empty.unionByName(edges.where("lang is null"))).collect()} == {"und"}


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_counts_take_long_texts_in_blocks(monkeypatch, block):
    for text in ("The quick,  brown fox jumps. " * 20, "  ΟΔΟΣ ΑΣ 12 Straße ", "a", "x" * 300, "-- 1 a", "İstanbul"):
        monkeypatch.setattr(langid, "BLOCK", 1 << 18)
        whole = langid.counts(text)
        monkeypatch.setattr(langid, "BLOCK", block)
        assert np.array_equal(langid.counts(text), whole)
    assert langid.counts("123 !") is None


def test_ftrl_equals_a_plain_one():
    """Weights held one by one in dicts, from the published update."""
    rng = random.Random(5)
    rows = [(sorted(rng.sample(range(1, 40), 6)), rng.random() < 0.5) for _ in range(120)]
    alpha, beta, l1, l2 = 0.7, 1.0, 0.5, 0.3
    z, n = {}, {}

    def weight(i: int) -> float:
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return (sign * l1 - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(3):
        for at, y in rows:
            own = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(own.values()))) - y
            for i in at:
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - before**0.5) / alpha * own[i]
    got = toxicity.fit_rows([(np.array(at), int(y)) for at, y in rows], 3, alpha, beta, l1, l2)
    assert np.allclose(got[:40], [weight(i) for i in range(40)]) and not got[40:].any()


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 500)
    logits = rng.normal(size=(500, 3)) * 8 + np.eye(3)[y] * 6
    t = langid.temperature(logits, y)
    loss = lambda x: -np.log(langid.softmax(x)[np.arange(500), y] + 1e-300).mean()
    assert t > 1 and loss(logits / t) < loss(logits)


def test_rows_to_learn_from_are_not_copied():
    rng = np.random.default_rng(2)
    found = [(i // 2 if i < 20 else i, rng.integers(0, 99, 50_000).astype(np.int32), i % 2) for i in range(200)]
    found += [(500, found[7][1].copy(), 0), (3, found[150][1].copy(), 1)]
    seen, want = set(), []
    for _, at, y in sorted(found, key=lambda x: (x[0], x[1].tobytes())):
        if at.tobytes() not in seen:
            seen.add(at.tobytes())
            want.append((at, y))
    del seen
    tracemalloc.start()
    got = toxicity.once(found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [y for _, y in got] == [y for _, y in want] and all(a is b for (a, _), (b, _) in zip(got, want, strict=True))
    assert peak < 2_000_000  # of 40 MB


# --- tokens ---


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers

    return sp.Codec(public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab cdeé  ▁\n\t😀日本x'1.-\x00ﬁÉther"), max_size=120))
def test_tokens_equal_the_library(codec, text):
    assert codec.covered
    ids = codec.library.encode(text)
    assert codec.encode_batch([text]) == [(",".join(map(str, ids)), codec.library.decode(ids))]


def test_agenda_equals_lockstep(codec):
    rng = random.Random(3)
    keys = ["".join(rng.choice("theringandouß日x") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    fast = [codec.finish(x) for x in codec.lockstep([sp.BLANK + k for k in keys])]
    slow = [codec.finish([codec._symbol(c) for c in codec.agenda(sp.BLANK + k)]) for k in keys]
    assert fast == slow and codec.repaired == 0


def test_cache_stays_bounded(codec, monkeypatch):
    monkeypatch.setattr(sp, "CACHE", 50)
    monkeypatch.setattr(sp, "AT_ONCE", 20)
    codec.cache.clear()
    text = " ".join(f"w{i}" for i in itertools.chain(range(200), range(200)))
    ids = codec.library.encode(text)
    assert codec.encode_batch([text])[0][0] == ",".join(map(str, ids)) and len(codec.cache) <= 70


def test_cache_is_bounded_by_characters_too(codec, monkeypatch):
    """Chunks of texts without blanks are long: their number says nothing of the memory that they take."""
    monkeypatch.setattr(sp, "CHARS", 20_000, raising=False)
    codec.cache.clear()
    rng = random.Random(5)
    rows = ["".join(rng.choice("theringandouß日x") for _ in range(5000)) for _ in range(20)]
    for row in rows + rows:
        ids = codec.library.encode(row)
        assert codec.encode_batch([row]) == [(",".join(map(str, ids)), codec.library.decode(ids))]
    assert sum(map(len, codec.cache)) < 40_000 and sum(map(len, codec.older)) < 40_000


def test_frequent_chunks_stay_in_the_cache(codec, monkeypatch):
    """What every text holds is learnt once, however many other chunks pass through; results are those of the library."""
    monkeypatch.setattr(sp, "CACHE", 100)
    codec.cache.clear()
    learnt = []
    monkeypatch.setattr(codec, "learn", lambda keys, f=codec.learn: learnt.extend(keys) or f(keys))
    rows = ["often seen  two blanks \x00 " + " ".join(f"rare{10 * i + k}" for k in range(10)) + (" " if i % 2 else "") for i in range(60)]
    for row in rows:
        ids = codec.library.encode(row)
        assert codec.encode_batch([row]) == [(",".join(map(str, ids)), codec.library.decode(ids))]
    assert learnt.count("often") <= 1 and learnt.count("rare599") == 1


def test_token_rows(spark, edges, empty, codec):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    got = sp.encode_documents(edges, model, with_ids=True).collect()
    want = sorted((r["doc_id"] or -1, codec.library.encode(r["text"] or "")) for r in edges.select("doc_id", "text").collect())
    assert sorted((r["doc_id"] or -1, list(r["ids"])) for r in got) == want
    for r in got:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(codec.library.decode(list(r["ids"])).encode()).hexdigest()
    assert sp.encode_documents(empty, model).count() == 0


# --- media ---


def test_flac_round_trip():
    rng = np.random.default_rng(0)
    cases = [bytes(64), b"x" * 4096, bytes(rng.integers(0, 256, 10048, dtype=np.uint8)), bytes([0, 255] * 3008), b"hello world, " * 960, bytes(range(256)) * 33 + bytes(64)]
    streams = flac.encode(cases)
    assert flac.decode(streams) == cases
    assert all(s[:4] == b"fLaC" for s in streams) and len(streams[1]) < 1000


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000))
def test_flac_any_bytes(raw):
    p = flac.payload(raw)
    assert len(p) % 64 == 0 and p.startswith(raw) and flac.decode(flac.encode([p])) == [p]


@pytest.mark.parametrize("at", [-1, -40, 60, 100])
def test_flac_damage_is_found(at):
    stream = bytearray(flac.encode([b"some text that is long enough " * 64])[0])
    stream[at] ^= 0x10
    with pytest.raises((flac.FlacError, IndexError)):
        flac.decode([bytes(stream)])


def test_flac_without_seek_table():
    data = b"plain text of several frames. " * 640
    stream = flac.encode([data])[0]
    size = int.from_bytes(stream[43:46], "big")
    bare = stream[:4] + bytes([0x80]) + stream[5:42] + stream[46 + size :]
    assert flac.decode([bare]) == [data]


def test_flac_escaped_partition_and_wide_parameters():
    """A frame written by hand: order 0, 5-bit parameters, one escaped partition of 8-bit residuals."""
    data = bytes(range(100, 116)) + bytes(16)
    bits = [(0b001000 << 1, 8), (1, 2), (1, 4), (31, 5), (8, 5), *((b - 128 & 0xFF, 8) for b in data[:16]), (3, 5)]
    for b in data[16:]:
        r = b - 128
        u = 2 * r if r >= 0 else -2 * r - 1
        bits += [(1, (u >> 3) + 1), (u & 7, 3)]
    value, n = flac._bits(bits)
    pad = -n % 8
    head = bytes([0xFF, 0xF8, 0x70, 0x02, 0]) + (31).to_bytes(2, "big")
    frame = head + bytes([flac.crc8(head)]) + (value << pad).to_bytes((n + pad) // 8, "big")
    arr = np.frombuffer(frame, np.uint8)
    frame += int(flac.crc16(arr, np.array([0]), np.array([len(arr)]))[0]).to_bytes(2, "big")
    md5 = hashlib.md5((np.frombuffer(data, np.uint8) ^ 0x80).tobytes()).digest()
    info = (4096).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 32).to_bytes(8, "big") + md5
    assert flac.decode([b"fLaC" + bytes([0x80]) + (34).to_bytes(3, "big") + info + frame]) == [data]


def test_blocks_are_found_by_sample():
    data = bytes(np.random.default_rng(1).integers(0, 256, 5 * 4096 + 64, dtype=np.uint8))
    stream = flac.encode([data])[0]
    for sample in (0, 1, 4095, 4096, 13_000, len(data) - 1):
        first = sample // 4096 * 4096
        assert flac.decode_at(stream, sample) == (first, data[first : first + 4096])
    size = int.from_bytes(stream[43:46], "big")
    bare = stream[:4] + bytes([0x80]) + stream[5:42] + stream[46 + size :]
    assert flac.decode_at(bare, 13_000) == flac.decode_at(stream, 13_000)
    last = len(stream) - 10
    damaged = stream[:last] + bytes([stream[last] ^ 4]) + stream[last + 1 :]
    assert flac.decode_at(damaged, 100) == (0, data[:4096])  # other frames aren't read
    for bad in (-1, len(data)):
        with pytest.raises(flac.FlacError):
            flac.decode_at(stream, bad)


def plain_feature(pcm: bytes) -> str:
    x = [b - 128 for b in pcm]
    turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
    return f"{-(-len(x) // 4096)}:{max(map(abs, x))}:{sum(map(abs, x)) * 1000 // len(x)}:{turns}"


def test_media_rows(edges, empty):
    media = flac.store_media(edges)
    rows = flac.media_features(edges).collect()
    same = lambda a, b: sorted(map(str, a)) == sorted(map(str, b))
    assert same(rows, flac.read_media(media).collect())
    texts = {}
    for r in edges.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append((r["text"] or "").encode())
    streams = {hashlib.sha256(r["media"]).hexdigest(): len(r["media"]) for r in media.collect()}
    for r in rows:
        raw = next(x for x in texts[r["doc_id"]] if len(x) == r["n_bytes"])
        p = flac.payload(raw)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert streams[r["media_sha256"]] == r["media_bytes"] and r["feature"] == plain_feature(p)
    assert len(rows) == edges.count() and flac.media_features(empty).count() == 0
    blocks = flac.pcm_blocks(media.where("doc_id = 10")).orderBy("block").collect()
    assert b"".join(bytes(b["pcm"]) for b in blocks).startswith(texts[10][0]) and [b["sample_offset"] for b in blocks] == [i * flac.BLOCK for i in range(len(blocks))]


# --- archives ---


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, "http://a/3\r\nX: y", None), (4, None, ""), (5, "u", "é" * 400_000), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "u", "<p>same</p>"), (None, "u", "alone"), (1, "http://a/1", "<p>same</p>")]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, first string").repartition(3)


def test_archives(pages):
    chunks = warc.write_archives(pages)
    got = {}
    for r in warc.read_archives(chunks).collect():
        got.setdefault(r["page_id"], []).append(tuple(r)[1:])
    sha = lambda x: warc.base32(hashlib.sha1(x.encode()).digest())
    same = (11, sha("<p>same</p>"))
    assert got[1] == [(*same, "response", None)] * 2 and got[2] == [(*same, "revisit", 1)]
    assert got[3] == [(0, sha(""), "response", None)] and got[4] == [(0, sha(""), "revisit", 3)]
    assert got[5] == [(800_000, sha("é" * 400_000), "response", None)] and got[6][0][2] == "response"
    assert sorted(got[None]) == sorted([(*same, "revisit", 1), (5, sha("alone"), "response", None)])
    assert chunks.agg(F.max(F.length("data"))).first()[0] <= warc.CHUNK + 4
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_archive_files(pages, compress):
    rows = [tuple(r) for r in warc.write_archives(pages).orderBy("archive", "record", "chunk").collect()]
    out = io.BytesIO()
    for _, part in itertools.groupby(rows, key=lambda r: r[0]):
        warc.export(part, out, compress)
    raw = gzip.decompress(out.getvalue()) if compress else out.getvalue()
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    got = list(warc.read_file(io.BufferedReader(io.BytesIO(out.getvalue())), size=1000))
    assert len(got) == 9 and sum(r[3] == "revisit" for r in got) == 3


def test_a_lost_chunk_is_found(pages):
    rows = [tuple(r) for r in warc.write_archives(pages.where("page_id = 5")).orderBy("chunk").collect()]
    reader = warc.RecordReader()
    reader.feed(rows[0][3], rows[0][4])
    with pytest.raises(ValueError):
        reader.feed(rows[2][3], rows[2][4])
    with pytest.raises(ValueError):
        reader.result()
