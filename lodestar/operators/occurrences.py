"""Phone occurrences: text, PDF pages and HTML pages to rows with context and provenance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions import phone
from lodestar.functions.text import either, page_window, window_context
from lodestar.functions.url import Scope
from lodestar.sources import html as H

#: What any candidate has; rows without it needn't go to Python. Digits and white space are those of Python: Java may know fewer
#: digits (so unassigned code points pass), and doesn't count x1C to x1F as white space.
HAS_DIGITS = r"(?U)[\p{Nd}\p{Cn}]{3}[\s\x1c-\x1f.\-]*[\p{Nd}\p{Cn}]{4}|\+[^\p{L}]{0,4}[2-9]"

CANDIDATES = "array<struct<raw:string,start:int,end:int,validation_status:string,extension:string,e164:string,national:string,normalized:string,country_code:int,notes:string>>"


def scan_phones(text: Column) -> Column:
    """Candidates of a text, with code point offsets."""
    keys = ("raw", "start", "end", "status", "extension", "e164", "national", "normalized", "country_code", "notes")

    @F.pandas_udf(CANDIDATES)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [tuple(getattr(n, k) for k in keys) for n in phone.scan(t)] if t else [])

    return run(text)


def text_candidates(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with one candidate each, as columns of c; only rows with digits go to Python."""
    return rows.where(F.col(text).rlike(HAS_DIGITS)).withColumn("c", F.explode(scan_phones(F.col(text))))


def occurrence(
    source_url: Column, final_url: Column, source_type: str | Column, method: str | Column, c: Column, context: Column, *, title: Column | None = None, heading1: Column | None = None, heading: Column | None = None,
    container: Column | None = None, page_number: Column | None = None, filename: Column | None = None, referrer: Column | None = None, at: Column | None = None, http_status: Column | None = None, seq: Column | None = None,
) -> list[Column]:
    """The columns of an occurrence; its id is a digest of where it stands."""
    none = lambda kind: F.lit(None).cast(kind)
    place = [source_url, F.lit(method), c["raw"], F.coalesce(seq.cast("string") if seq is not None else c["start"].cast("string"), F.lit("-")), F.coalesce(page_number.cast("string"), F.lit("-")) if page_number is not None else F.lit("-")]
    cols = {
        "occurrence_id": F.sha2(F.concat_ws("\n", *place), 256),
        "raw_phone": c["raw"],
        "normalized_phone": c["normalized"],
        "e164_phone": c["e164"],
        "national_format": c["national"],
        "extension": c["extension"],
        "country_code": c["country_code"],
        "validation_status": c["validation_status"],
        "source_url": source_url,
        "final_url": final_url,
        "source_type": F.lit(source_type),
        "page_title": title if title is not None else none("string"),
        "page_h1": heading1 if heading1 is not None else none("string"),
        "context": context,
        "nearest_heading": heading if heading is not None else none("string"),
        "nearest_container": container if container is not None else none("string"),
        "pdf_page_number": page_number.cast("int") if page_number is not None else none("int"),
        "pdf_filename": filename if filename is not None else none("string"),
        "referring_url": referrer if referrer is not None else none("string"),
        "crawl_timestamp": at if at is not None else none("timestamp"),
        "http_status": http_status.cast("int") if http_status is not None else none("int"),
        "extraction_method": F.lit(method),
        "js_confirmed": F.lit(False),
        "notes": c["notes"],
    }
    return [v.alias(k) for k, v in cols.items()]


def pdf_occurrences(pages: DataFrame) -> DataFrame:
    """(url, filename, page_number, text) to occurrences, none dropped, with the text around them."""
    found = text_candidates(pages)
    c = F.col("c")
    return found.select(*occurrence(F.col("url"), F.col("url"), "PDF", "PDF_TEXT", c, page_window(F.col("text"), c["start"], c["end"]), title=F.col("filename"), page_number=F.col("page_number"), filename=F.col("filename")))


def document_occurrences(documents: DataFrame) -> DataFrame:
    """Documents as one-page texts: (doc_id, text) to occurrences, with seq."""
    found = text_candidates(documents.select("doc_id", "text"))
    c, url = F.col("c"), F.concat(F.lit("doc:"), F.col("doc_id"))
    cols = occurrence(url, url, "HTML", "TEXT", c, window_context(F.col("text"), c["start"], c["end"]))
    return found.select(*cols, F.struct(F.col("doc_id").alias("a"), F.lit(2).alias("b"), c["start"].alias("c")).alias("seq"))


EXTRACTED = """url string, title string, h1 string, headings array<string>, canonical_url string, text string, header_text string, footer_text string, nav_text string,
hrefs array<string>, tel_links array<struct<href:string,text:string,raw_number:string>>, schema_phones array<string>,
numbers array<struct<branch:int,pos:int,raw:string,start:int,validation_status:string,extension:string,e164:string,national:string,normalized:string,country_code:int,notes:string,context:string,heading:string,container:string,kind:string>>, parse_error string"""


def _page(url: str, html: str) -> tuple:
    root = H.tree(html, hidden=True)
    marked = H.schema_phones(root)
    H.prune(root)
    places = H.Places(root)
    text = " ".join(root.text().split())
    header, footer, nav = (H.regions(root, t, r) for t, r in (("header", "banner"), ("footer", "contentinfo"), ("nav", "navigation")))
    title = next((n.raw().strip() for n in root.nodes("title")), None)
    h1 = next((n.text() for n in root.nodes("h1")), None)
    headings = [t for n in root.nodes(*H.HEADINGS) if (t := n.text())]
    numbers: list[tuple] = []

    def add(branch: int, n: phone.Number, raw: str, otherwise: str, heading: str | None = None, keep: bool = False) -> None:
        node = places.element(raw)
        around = places.container(node)
        context = around or otherwise
        numbers.append((branch, len(numbers), n.raw, n.start, n.status, n.extension, n.e164, n.national, n.normalized, n.country_code, n.notes, context, places.heading(node) or heading, context if keep else None, "semantic_dom" if around else "text_window"))

    tel = H.tel_links(root)
    for _, shown, raw in tel:
        number, _, tail = raw.replace("%20", " ").partition(";") if ";" in raw else raw.replace("%20", " ").partition(",")
        m = H.re.search(r"(?i)ext(?:ension)?=(\d{1,6})", tail) or H.re.search(r"(\d{1,6})", tail)
        add(0, phone.parse_number(number, m[1] if m else None), raw, H.shorten(shown or text, 400), keep=True)
    for raw in marked:
        add(1, phone.parse_number(raw), raw, H.shorten(text, 300))
    whole = " ".join(x for x in (text, header, footer, nav) if x)
    for got in phone.scan(whole):
        low, high = max(0, got.start - 150), got.end + 150
        window = ("…" if low else "") + whole[low:high] + ("…" if high < len(whole) else "")
        add(2, got, got.raw, " ".join(window.split()), headings[0] if headings else None)
    links = [a.attrs["href"].strip() for a in root.nodes("a") if "href" in a.attrs]
    return (url, title or None, h1, headings, H.canonical(root), text, header, footer, nav, links, tel, marked, numbers, None)


def _read(url: str, html: str) -> tuple:
    """The fields of a page; one that can't be read has its error and nothing else, and the others go on."""
    try:
        return _page(url, html)
    except Exception as e:  # noqa: BLE001  any fault in a page's markup
        return (url, None, None, [], None, "", "", "", "", [], [], [], [], f"{type(e).__name__}: {e}"[:500])


def dealt(pages: DataFrame) -> DataFrame:
    """pages over as many tasks as a shuffle has: a file of one row group, of which a task reads all, may hold very many, and a page costs far more
    to read than to send."""
    return pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(url, html) to fields and numbers of each page, by its tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in H.re.sub(r"<[^()]*?>(?=,|$)", "", EXTRACTED.replace("\n", " ")).split(", ")]
        for batch in batches:
            yield pd.DataFrame([_read(u, h or "") for u, h in zip(batch["url"], batch["html"], strict=True)], columns=names)

    return dealt(pages.select("url", "html")).mapInPandas(run, EXTRACTED)


def html_occurrences(pages: DataFrame, rendered: bool = False) -> DataFrame:
    """(url, final_url, http_status, referring_url, at, html, depth) to occurrences with seq; on a page each number, extension
    and method once, the first in the order of links, markup and text."""
    got = extract_pages(pages).withColumn("n", F.explode("numbers")).drop("numbers")
    meta = pages.select(F.col("url").alias("u"), "final_url", "http_status", "referring_url", "at", "depth").dropDuplicates(["u"])
    rows = got.join(meta.hint("merge"), F.col("url") == F.col("u"))  # a row for each page, so never broadcast
    n = F.col("n")
    by_branch = lambda link, markup, text: F.when(n["branch"] == 0, link).when(n["branch"] == 1, markup).otherwise(text)
    cols = occurrence(
        F.col("url"), F.col("final_url"), by_branch("HTML_TEL_LINK", "HTML_SCHEMA", "HTML"), by_branch("TEL_LINK", "SCHEMA", "TEXT"), n, n["context"], title=F.col("title"), heading1=F.col("h1"), heading=n["heading"],
        container=n["container"], referrer=F.col("referring_url"), at=F.col("at"), http_status=F.col("http_status"), seq=n["pos"],
    )
    found = rows.select(*cols, F.struct(F.col("depth").alias("a"), F.col("url").alias("u"), n["branch"].alias("b"), n["pos"].alias("c")).alias("seq"))
    number = F.coalesce(F.col("e164_phone"), F.col("normalized_phone"), F.col("raw_phone"))
    once = Window.partitionBy("source_url", number, F.coalesce("extension", F.lit("")), "extraction_method").orderBy("seq")
    return found.withColumn("k", F.row_number().over(once)).where("k = 1").drop("k")


def reconcile(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """Occurrences of the same pages (source_url) before and after rendering: numbers in both are confirmed and take the longer context;
    those of the rendered page alone are marked; a number stands once on a page."""
    key = phone.dedupe_key(F.col("e164_phone"), F.col("normalized_phone"), F.col("extension"), F.col("raw_phone"))
    cols = [c for c in static.columns if c != "seq"]

    def first(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("source_url", "key").orderBy("seq")
        return df.withColumn("key", key).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")

    s, r = first(static).alias("s"), first(rendered)
    best = Window.partitionBy("source_url", "key").orderBy(F.desc(F.char_length(F.coalesce("context", F.lit("")))), "seq")
    longest = rendered.withColumn("key", key).withColumn("k", F.row_number().over(best)).where("k = 1").select("source_url", "key", F.struct("context", "nearest_heading", "nearest_container").alias("longest"))
    r = r.join(longest, ["source_url", "key"]).alias("r")
    both = s.join(r, (F.col("s.source_url") == F.col("r.source_url")) & (F.col("s.key") == F.col("r.key")), "full_outer")
    there, here = F.col("r.key").isNotNull(), F.col("s.key").isNotNull()
    size = lambda c: F.char_length(F.coalesce(c, F.lit("")))
    # a context that is longer than the one on hand replaces it
    longer = there & (size(F.col("r.longest.context")) > size(F.when(here, F.col("s.context")).otherwise(F.col("r.context"))))
    confirmed = F.col("r.occurrence_id").isNotNull()
    out = []
    for c in cols:
        base = F.when(here, F.col(f"s.{c}")).otherwise(F.col(f"r.{c}"))
        if c == "context":
            base = F.when(longer, F.col("r.longest.context")).otherwise(base)
        elif c in ("nearest_heading", "nearest_container"):
            base = F.when(longer, F.coalesce(F.nullif(F.col(f"r.longest.{c}"), F.lit("")), base)).otherwise(base)
        elif c == "js_confirmed":
            base = F.when(here, confirmed | F.col("s.js_confirmed")).otherwise(F.col("r.js_confirmed"))
        elif c == "source_type":
            base = F.when(here, base).otherwise(F.lit("JAVASCRIPT_RENDERED"))
        elif c == "extraction_method":
            base = F.when(here, base).otherwise(F.lit("JS_TEXT"))
        out.append(base.alias(c))
    order = F.struct((~here).alias("late"), F.coalesce(F.col("s.seq"), F.col("r.seq")).alias("seq"))
    return both.select(*out, order.alias("seq"))


def first_seen_labels(occurrences: DataFrame) -> DataFrame:
    """(source_url, label, page_title, seq): on each page each number once, where it stands first, by the form that it is announced in."""
    label = either(F.col("e164_phone"), F.col("normalized_phone"), F.col("raw_phone"))
    rows = occurrences.withColumn("label", label).where("label <> ''")
    return rows.groupBy("source_url", "label").agg(F.min_by("page_title", "seq").alias("page_title"), F.min("seq").alias("seq"))


def without_overlaps(spans: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """spans (key, start, end, ...) that overlap none of others (key, start, end) of the same text: an anti join by text and interval.

    The others of a text meet its spans in one row, so texts with many of both don't multiply."""
    taken = others.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_taken"))
    free = ~F.exists(F.coalesce("_taken", F.array().cast("array<struct<start:int,end:int>>")), lambda o: (o["start"] < F.col("end")) & (o["end"] > F.col("start")))
    return spans.join(taken, F.col(key) == F.col("_key"), "left").where(free).drop("_key", "_taken")


def page_links(pages: DataFrame, scope: Scope | None = None) -> DataFrame:
    """(url, html) to distinct links of each page in order: url, pos, link, kind (HTML or PDF); native."""
    from lodestar.functions.url import host, looks_like_pdf, normalize_url, resolve

    raw = pages.select("url", F.posexplode(H.hrefs(F.col("html"))).alias("pos", "href"))
    raw = raw.where((F.col("href") != "") & ~F.col("href").rlike(r"^(?:#|mailto:|javascript:|data:|tel:)"))
    full = raw.withColumn("full", resolve(F.col("url"), F.col("href"))).where(F.col("full").rlike("(?i)^https?://"))
    named = full.withColumn("link", normalize_url(F.col("full"))).where("link is not null")
    if scope is not None:
        named = named.where(scope.internal(F.col("link")))
    first = named.groupBy("url", "link").agg(F.min_by("full", "pos").alias("full"), F.min("pos").alias("pos"))
    return first.select("url", "pos", "link", F.when(looks_like_pdf(F.col("full")), "PDF").otherwise("HTML").alias("kind"), host(F.col("link")).alias("host"))


