"""Page fields as native columns (regular expressions over the markup), and by a tolerant tree for what needs structure."""

from __future__ import annotations

import html
import html.entities
import json
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from functools import cache
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import collapse_ws, strip

# Content that isn't text, roots and frameworks of client-side pages, JSON-LD keys of numbers, blocks and names of containers.
HIDDEN = ("script", "style", "template", "noscript")
FRAMEWORKS = ("react", "vue", "angular", "next/static", "nuxt", "ember", "svelte")
PHONE_KEYS = ("telephone", "faxnumber", "phone")
BLOCKS = ("div", "article", "section", "li", "tr", "td", "figure", "aside", "p", "header", "footer")
CONTAINERS = ("li", "tr", "article", "figure")
CONTAINER_NAMES = re.compile(r"(card|profile|staff|person|people|employee|contact|directory|member|bio|vcard|listing)", re.I)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


ENTITY = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


#: References that occur most, which needn't be looked up.
USUAL = {"&amp;": "&", "&nbsp;": "\xa0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'"}


@cache
def _references() -> str:
    """As JSON: the named references that end in a semicolon, and the numbers that stand for other characters than their own."""
    named = {f"&{name}": chars for name, chars in html.entities.html5.items() if name.endswith(";")}
    return json.dumps(named | {str(n): html.unescape(f"&#{n};") for n in (0, 13, *range(0x80, 0xA0))})


def _decoded(entity: Column) -> Column:
    """The character of one reference; an unknown name stays."""
    digits = F.regexp_extract(entity, "^&#[xX]?([0-9a-fA-F]+);$", 1)
    number = F.when(entity.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
    known = F.from_json(F.lit(_references()), "map<string,string>")  # a constant
    odd = (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    out = F.when(entity == "&amp;", "&")
    for reference, char in USUAL.items():
        out = out.when(entity == reference, char)
    return out.when(entity.startswith("&#"), F.coalesce(F.try_element_at(known, number.cast("string")), F.when(odd, "\ufffd").otherwise(plain))).otherwise(F.coalesce(F.try_element_at(known, entity), entity))


def decode_entities(c: Column) -> Column:
    """c with its character references, numeric and named, as characters. Native; texts without any are left alone."""

    def decode(text: Column) -> Column:
        between = F.split(text, ENTITY, -1)
        found = F.transform(F.regexp_extract_all(text, F.lit(f"({ENTITY})"), F.lit(1)), _decoded)
        return F.when(text.contains("&"), F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(text)

    return F.transform(F.array(c), decode)[0]  # c is computed once


def without_hidden(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->", " ")


def to_text(markup: Column) -> Column:
    return collapse_ws(decode_entities(F.regexp_replace(markup, r"(?s)<[^>]*>", " ")))


def visible_text(html: Column) -> Column:
    return to_text(without_hidden(html))


def _first(html: Column, tag: str) -> Column:
    return F.regexp_extract(without_hidden(html), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)


def title(html: Column) -> Column:
    return F.nullif(strip(decode_entities(_first(html, "title"))), F.lit(""))


def h1(html: Column) -> Column:
    return F.nullif(to_text(_first(html, "h1")), F.lit(""))


def headings(html: Column) -> Column:
    found = F.regexp_extract_all(without_hidden(html), F.lit(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>"), F.lit(1))
    return F.filter(F.transform(found, to_text), lambda x: x != "")


def region(html: Column, tag: str) -> Column:
    found = F.regexp_extract_all(without_hidden(html), F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))
    return collapse_ws(F.array_join(F.filter(F.transform(found, to_text), lambda x: x != ""), " "))


def hrefs(html: Column) -> Column:
    """array<string>: targets of anchors, in order."""
    found = F.regexp_extract_all(without_hidden(html), F.lit(r"""(?is)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""), F.lit(1))
    return F.transform(found, lambda x: F.trim(decode_entities(F.regexp_replace(x, r"""^["']|["']$""", ""))))


def spa_signals(html: Column) -> Column:
    """array<string>: signs that a page is rendered by scripts."""
    text = visible_text(html)
    root = html.rlike(r"""(?i)<[a-z][^>]*\s(?:id\s*=\s*["']?(?:root|app|__next|__nuxt)["'\s>/]|data-reactroot|ng-version)""")
    sources = F.lower(F.array_join(F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*?\ssrc\s*=\s*["']?([^"'\s>]*)"""), F.lit(1)), " "))
    body = F.regexp_extract(without_hidden(html), r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)
    signs = (
        F.when(root, "spa_root"),
        F.when(sources.rlike("|".join(re.escape(x) for x in FRAMEWORKS)), "js_framework"),
        F.when((F.char_length(text) > 0) & (F.char_length(text) < 250), "thin_content"),
        F.when(html.rlike(r"(?i)<body\b") & (F.char_length(to_text(body)) < 120), "empty_body"),
    )
    return F.array_compact(F.array(*signs))


def render_reason(signals: Column, text_length: Column, mode: str = "auto") -> Column:
    """Why a page is to be rendered; null if it isn't."""
    if mode == "off":
        return F.lit(None).cast("string")
    if mode == "always":
        return F.lit("always")
    has = lambda x: F.array_contains(signals, x)
    return (
        F.when(has("thin_content") | has("empty_body"), "thin_content")
        .when(has("spa_root") & (text_length < 1500), "spa_root")
        .when(has("js_framework") & (text_length < 800), "js_framework")
    )


# --- a tree, for structure ---


@dataclass(eq=False)
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)
    at: int = 0

    def walk(self):
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                yield child
                if isinstance(child, Node):
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def nodes(self, *names: str):
        return (x for x in self.walk() if isinstance(x, Node) and (not names or x.name in names))

    def text(self) -> str:
        return " ".join(s for x in self.walk() if isinstance(x, str) and (s := x.strip()))

    def raw(self) -> str:
        return "".join(x for x in self.walk() if isinstance(x, str))


class _Builder(HTMLParser):
    """Start tags open nodes; an end tag closes the nearest open node of its name, and those within it; others are passed over."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("")
        self.count = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.count += 1
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.open, at=self.count)
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open = self.open.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.open
        while node.parent is not None and node.name != tag:
            node = node.parent
        if node.parent is not None:
            self.open = node.parent

    def handle_data(self, data: str) -> None:
        self.open.children.append(data)


def tree(html: str, hidden: bool = False) -> Node:
    """The tree of a page; without content that isn't text unless hidden."""
    b = _Builder()
    b.feed(html)
    b.close()
    if not hidden:
        prune(b.root)
    return b.root


def prune(root: Node) -> None:
    """Takes content that isn't text out of a tree."""
    for node in [root, *root.nodes()]:
        node.children = [c for c in node.children if isinstance(c, str) or c.name not in HIDDEN]


def json_phones(value: object) -> list[str]:
    """Values of phone keys, in document order and at any depth; a phone key's object isn't descended into."""
    out: list[str] = []
    due = [("", value)]
    while due:
        key, here = due.pop()
        if key.lower() in PHONE_KEYS:
            out += [here] if isinstance(here, str) else map(str, here) if isinstance(here, list) else []
        elif isinstance(here, list):
            due += [("", x) for x in reversed(here)]
        elif isinstance(here, dict):
            due += [(str(k), x) for k, x in reversed(here.items())]
    return out


def schema_phones(page: str | Node) -> list[str]:
    """Numbers of JSON-LD and microdata, of a page or of its tree with hidden content; markup that can't be read, or that is nested
    more deeply than the parser goes, has none."""
    root, out = page if isinstance(page, Node) else tree(page, hidden=True), []
    for node in root.nodes("script"):
        if "ld+json" in node.attrs.get("type", "").lower():
            try:
                out += json_phones(json.loads(node.raw()))
            except (ValueError, RecursionError):
                continue
    for node in root.nodes():
        if node.attrs.get("itemprop", "").lower() in ("telephone", "faxnumber") and (value := node.attrs.get("content") or node.text()):
            out.append(value.strip())
    return list(dict.fromkeys(out))


def tel_links(root: Node) -> list[tuple[str, str, str]]:
    """(href, text, number) of each tel: anchor."""
    found = ((a.attrs["href"].strip(), a) for a in root.nodes("a") if "href" in a.attrs)
    return [(h, a.text(), h.partition(":")[2].strip()) for h, a in found if h.lower().startswith("tel:")]


def canonical(root: Node) -> str | None:
    for node in root.nodes("link"):
        if "canonical" in node.attrs.get("rel", "").lower().split():
            return node.attrs.get("href", "").strip() or None
    return None


def regions(root: Node, tag: str, role: str) -> str:
    chunks = [n.text() for n in root.nodes(tag)] + [n.text() for n in root.nodes() if n.attrs.get("role") == role]
    return " ".join(" ".join(x for x in chunks if x).split())


def shorten(text: str, limit: int) -> str:
    flat = " ".join(text.split())
    return flat if len(flat) <= limit else flat[: limit - 1].rstrip() + "…"


class Places:
    """Where numbers stand on a page, and what stands around them: the tree is walked once, and each number is looked up."""

    def __init__(self, root: Node) -> None:
        self.links: list[tuple[str, Node]] = []
        self.headings: list[Node] = []
        self.owners: list[Node] = []
        self.starts: list[int] = []
        self.texts: dict[Node, str] = {}
        chunks, size = [], 0
        for node in (root, *root.nodes()):
            if node.name == "a" and node.attrs.get("href", "").lower().startswith("tel:"):
                self.links.append((re.sub(r"\D", "", node.attrs["href"]), node))
            if node.name in HEADINGS:
                self.headings.append(node)
            for child in node.children:
                if isinstance(child, str):
                    self.owners.append(node)
                    self.starts.append(size)
                    chunks.append(child)
                    size += len(child) + 1
        self.whole = "\0".join(chunks)
        self.order = [h.at for h in self.headings]

    def text(self, node: Node) -> str:
        if node not in self.texts:
            self.texts[node] = node.text()
        return self.texts[node]

    def element(self, raw: str) -> Node | None:
        """A tel: link with the number's digits, else the node that holds its text or the first of its usual spellings."""
        digits = re.sub(r"\D", "", raw)
        if digits and (link := next((n for d, n in self.links if d.endswith(digits[-10:])), None)) is not None:
            return link
        spellings = [raw.strip()]
        if len(digits) > 9:
            parts = digits[-10:-7], digits[-7:-4], digits[-4:]
            spellings += [form.format(*parts) for form in ("{}-{}-{}", "({}) {}-{}", "{}.{}.{}")]
        for form in spellings:
            if form and (at := self.whole.find(form)) >= 0:
                return self.owners[bisect_right(self.starts, at) - 1]
        return None

    def heading(self, node: Node | None) -> str | None:
        """The nearest heading in front of a node; where it has no text, the nearest in front of the node's parent, and so on."""
        while node is not None:
            if (k := bisect_left(self.order, node.at)) and (text := self.text(self.headings[k - 1])):
                return text
            node = node.parent
        return None

    def container(self, node: Node | None) -> str | None:
        """Text of the innermost card, row or item around a node, or else of the innermost block of a moderate length."""
        block = None
        while node is not None and node.name:
            if node.name in CONTAINERS or CONTAINER_NAMES.search(" ".join((node.name, node.attrs.get("class", ""), node.attrs.get("id", "")))):
                return shorten(self.text(node), 600)
            if block is None and node.name in BLOCKS and 20 < len(self.text(node)) < 800:
                block = node
            node = node.parent
        return None if block is None else shorten(self.text(block), 600)
