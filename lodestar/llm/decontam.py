"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

1. Test windows: every `width` consecutive words of an item (a shorter item is one window). Equal windows are one, whoever has them.
2. One pass over the documents stores the index: a posting (document, place, term) for each occurrence of a test term, and a row with
   the number of words for each document. Documents are split into words this once; all that follows reads the index.
3. Counts of the postings order each window's terms from the rarest.
4. The list of a window's rarest term, moved by the term's offset, gives candidates (document, window, start). They are intersected with
   the list of the second rarest term at its offset, and what is left with the lists of all other terms. What remains are exact phrase
   matches; with near=True, windows all of whose terms stand within width - 1 words of an occurrence of the rarest are returned as well.
5. Matches are merged into covered words by a window over each document's matches.

Documents are never shuffled. Terms and windows go to the executors in blocks of at most BLOCK_ROWS (some tens of MB), whatever the size
of the benchmark, so that no term is a key of a shuffle: lists meet by document and place, which spreads the list of a term that stands
everywhere. Lists are read for the terms, and at last for the documents, that still have candidates. No window, list or posting is capped.

Null texts have no words. Rows of documents with equal doc_id and text are judged alike, with an equal doc_id and other text
each on its own; a null doc_id is a value. A null item_id counts as the item ''. Repeated items count once. An empty benchmark hits nothing,
and an empty table of documents gives no rows. Texts of any length are split whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import SENT, stored, text_key

WIDTH = 13
BLOCK_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands behind each document's words, where no word can be: its posting tells how many there are.
END = "\n"
PLACE = ["doc_id", "_tk", "tid", "pos"]


def words(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased: runs of digits, a-z and non-ASCII characters."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, win array<string>), distinct."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1))))
    return items.select("item_id", "w", at.alias("at")).select("item_id", F.slice("w", F.col("at"), width).alias("win")).distinct()


def _in_blocks(rows: DataFrame, key: str, use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The union of use(block of rows) over blocks by key that are small enough to be sent to each executor."""
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    out = None
    for k in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == k)
        part = use(F.broadcast(block))
        out = part if out is None else out.unionByName(part)
    return out


def index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, _tk, tid, pos) of each occurrence of terms (term, tid), and (doc_id, _tk, -1, number of words) of each document."""
    tokens = documents.select(*text_key(), F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(END)))).alias("pos", "term"))
    ends = terms.sparkSession.range(1).select(F.lit(END).alias("term"), F.lit(-1).cast("long").alias("tid"))
    return _in_blocks(terms.unionByName(ends), "term", lambda block: tokens.join(block, "term").select(*PLACE))


def by_rarity(wins: DataFrame, terms: DataFrame, counts: DataFrame) -> DataFrame:
    """(wid, size, by): the terms (n, tid, off) of each window from the rarest; only windows all of whose terms occur."""
    parts = wins.select("wid", F.size("win").alias("size"), F.posexplode("win").alias("off", "term")).join(terms, "term").join(counts, "tid")
    by = F.array_sort(F.collect_list(F.struct("n", "tid", "off")))  # at most width of them
    return parts.groupBy("wid", "size").agg(by.alias("by")).where(F.size("by") == F.col("size"))


def candidates(postings: DataFrame, ranked: DataFrame) -> DataFrame:
    """(doc_id, _tk, wid, by, start): the places at which each window would start by its rarest term's list."""
    leads = ranked.select("wid", "by", F.col("by")[0]["tid"].alias("tid"), F.col("by")[0]["off"].alias("off"))
    met = _in_blocks(leads, "tid", lambda block: postings.join(block, "tid"))
    return met.select("doc_id", "_tk", "wid", "by", (F.col("pos") - F.col("off")).alias("start"))


def _met(wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """wanted (with doc_id, _tk, tid, pos) where a posting stands at its place."""
    p = postings.select(*(F.col(c).alias(f"p_{c}") for c in PLACE))
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) if c == "doc_id" else F.col(c) == F.col(f"p_{c}") for c in PLACE]
    return wanted.join(p, same[0] & same[1] & same[2] & same[3]).select(*wanted.columns)


def _of_documents(postings: DataFrame, rows: DataFrame) -> DataFrame:
    """The postings of the documents of rows; of all, if those are too many to be sent."""
    docs = stored(rows.select(F.col("doc_id").alias("d"), F.col("_tk").alias("t")).distinct(), "candidate-documents")
    if docs.count() > SENT:
        return postings
    return postings.join(F.broadcast(docs), postings["doc_id"].eqNullSafe(F.col("d")) & (postings["_tk"] == F.col("t")), "left_semi")


def phrases(postings: DataFrame, ranked: DataFrame) -> DataFrame:
    """(doc_id, _tk, wid, start): exact matches, by intersecting the lists of each window's terms from the rarest."""
    key = ["doc_id", "_tk", "wid", "start"]
    found = candidates(postings, ranked).where("start >= 0")
    done = found.where(F.size("by") == 1).select(*key)
    second = F.col("by")[1]
    tids = stored(ranked.where(F.size("by") > 1).select(second["tid"].alias("tid")).distinct(), "second-terms")
    lists = _in_blocks(tids, "tid", lambda block: postings.join(block, "tid", "left_semi"))
    two = found.where(F.size("by") > 1).select(*key, "by", second["tid"].alias("tid"), (F.col("start") + second["off"]).alias("pos"))
    two = stored(_met(two, lists).select(*key, "by").distinct(), "candidates")
    done = done.unionByName(two.where(F.size("by") == 2).select(*key))
    more = two.where(F.size("by") > 2)
    rest = more.select(*key, F.size("by").alias("size"), F.explode(F.slice("by", F.lit(3), F.size("by"))).alias("x"))
    rest = rest.select(*key, "size", F.col("x.tid").alias("tid"), (F.col("start") + F.col("x.off")).alias("pos"))
    whole = _met(rest, _of_documents(postings, more)).distinct().groupBy(*key, "size").agg(F.count(F.lit(1)).alias("n")).where("n = size - 2").select(*key)
    return done.unionByName(whole).distinct()




def proximities(postings: DataFrame, ranked: DataFrame, width: int) -> DataFrame:
    """(doc_id, _tk, wid, start, stop): stretches around an occurrence of a window's rarest term in which all its terms stand at most
    width - 1 words from it; from the first to the last of their nearest occurrences."""
    near = candidates(postings, ranked).withColumn("at", F.col("start") + F.col("by")[0]["off"]).select("doc_id", "_tk", "wid", "at", "by").distinct()
    tids = F.array_distinct(F.transform("by", lambda x: x["tid"]))
    # places are cut into blocks of width words: what is near stands in the same block or one beside it
    wanted = near.select("doc_id", "_tk", "wid", "at", F.size(tids).alias("size"), F.explode(tids).alias("tid"))
    wanted = wanted.select("*", F.explode(F.array(*(F.floor(F.col("at") / width) + k for k in (-1, 0, 1)))).alias("block"))
    p = _of_documents(postings, near).select(F.col("doc_id").alias("d"), F.col("_tk").alias("t"), F.col("tid").alias("i"), "pos", F.floor(F.col("pos") / width).alias("b"))
    met = wanted.join(p, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_tk") == F.col("t")) & (F.col("tid") == F.col("i")) & (F.col("block") == F.col("b")))
    gap = F.abs(F.col("pos") - F.col("at"))
    key = ["doc_id", "_tk", "wid", "at"]
    best = met.where(gap < width).groupBy(*key, "size", "tid").agg(F.min_by("pos", F.struct(gap, "pos")).alias("pos"))
    held = best.groupBy(*key, "size").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop")).where("n = size")
    return held.select("doc_id", "_tk", "wid", "start", "stop").distinct()


def _matches(documents: DataFrame, benchmark: DataFrame, width: int, near: bool) -> tuple[DataFrame, DataFrame]:
    """The index, and (doc_id, _tk, item_id, start, stop, kind, words): matches of each item's windows, of so many words."""
    of_items = stored(windows(benchmark, width), "windows")
    wins = stored(of_items.select("win").distinct().select(F.monotonically_increasing_id().alias("wid"), "win"), "distinct-windows")
    terms = stored(wins.select(F.explode("win").alias("term")).distinct().select("term", F.monotonically_increasing_id().alias("tid")), "terms")
    postings = stored(index(documents, terms), "index")
    counts = postings.where("tid >= 0").groupBy("tid").agg(F.count(F.lit(1)).alias("n"))
    ranked = stored(by_rarity(wins, terms, counts), "ranked-windows")
    named = of_items.join(wins, "win").select("wid", "item_id", F.size("win").alias("words"))
    found = phrases(postings, ranked)
    out = found.join(named, "wid").select("doc_id", "_tk", "item_id", "start", (F.col("start") + F.col("words")).alias("stop"), F.lit("phrase").alias("kind"), "words")
    if near:
        there = stored(found, "phrases").withColumnsRenamed({"doc_id": "d", "_tk": "t", "wid": "i", "start": "s"})
        other = proximities(postings, ranked, width)
        is_phrase = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_tk") == F.col("t")) & (F.col("wid") == F.col("i")) & (F.col("start") == F.col("s"))
        other = other.join(there, is_phrase, "left_anti")
        out = out.unionByName(other.join(named, "wid").select("doc_id", "_tk", "item_id", "start", "stop", F.lit("near").alias("kind"), "words"))
    return postings, out.distinct()


def matches(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, near: bool = False) -> DataFrame:
    """(doc_id, _tk, item_id, start, stop, kind): phrase matches in word places, and with near=True also near matches."""
    return _matches(documents, benchmark, width, near)[1].drop("words")


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = 20) -> DataFrame:
    """One row for each row of documents, with _tk (hash of the text); contaminated if at least one in share words is hit, whole if a
    window of width words is."""
    postings, found = _matches(documents.select("doc_id", "text"), benchmark.select("item_id", "text"), width, near=False)
    found = stored(found, "matches")
    key = ["doc_id", "_tk"]
    order = Window.partitionBy(*key).orderBy("start", "stop")
    reach = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = found.select(*key, "start", "stop").distinct().withColumn("reach", reach)
    new = F.greatest(F.col("stop") - F.greatest("start", "reach"), F.lit(0))
    hits = spans.groupBy(*key).agg(F.sum(new).alias("n_hit"))
    items = found.groupBy(*key).agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("words").alias("longest"))
    by_doc = hits.join(items, [hits[c].eqNullSafe(items[c]) for c in key]).select(*(hits[c].alias(f"h{c}") for c in key), "n_hit", "items", "longest")
    rows = postings.where("tid = -1").select("doc_id", "_tk", F.col("pos").cast("long").alias("n_words"))
    out = rows.join(by_doc, rows.doc_id.eqNullSafe(by_doc.hdoc_id) & (rows._tk == by_doc.h_tk), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "_tk",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        F.coalesce(F.col("longest") >= width, F.lit(False)).alias("whole"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM bp),
lens AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n),
dg AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM dp),
m AS (SELECT DISTINCT doc_id, i, n, item_id FROM dg JOIN win USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
