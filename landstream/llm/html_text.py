"""HTML extraction: a template of each host deduced from equivalence classes of tokens, and the text in its remaining slots.

A page's tokens are its tags, told apart by where they stand (the names and classes of the open elements), and its blocks of
text. Of each token and host a few sums describe its occurrence vector, the counts over all pages of the host, by a fingerprint:
tokens that agree in it form an equivalence class. Classes on enough pages are checked page by page: a class is valid where its
tokens come in one order and its spans lie within one another without crossing. Valid classes, each in the slot of the class
around it, are the host's template. A page's template text is taken off; what is left are slots, of which those stay that the
article holds and none of menus, headers, footers, sidebars, notices, adverts, forms or reader comments.

Sums are combined before they are shuffled, by (host, token), so a host may have any share of all pages. A host's template is
bounded by its pages' length: each of its tokens is on half of the pages at least. It meets the pages by a join on the host.

Text belongs to the template only if it stands on TEXT_SHARE of at least TEXT_PAGES pages that otherwise differ in text
(TEXT_MIXED buckets of the rest of their text, of 63), so that copies of an article, or passages that many pages share, stay.

The article: all `article` elements; without any, `main`; without it, the innermost element that holds most of the text outside
of links. Menus and the like are told by their element (nav, header, footer, aside, form, ...) or by a word of their class, id or role.
A header within an article keeps its headings. Tags are read as browsers do where that decides about blocks: implied ends,
unknown ends, raw text, comments, quoted attributes. A `br` is white space.

Cases: a null html is an empty page, whose text is empty. A null url, or one without host, has no template; its page is read by
itself. Repeated rows are pages each for itself. Very long pages take about 30 bytes of memory a byte in their task. Other columns
don't matter.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, table, written
from .url_rules import url_parts

#: A class is on this many pages of its host at least, and on this share of them.
PAGES, SHARE = 3, 0.5
TEXT_PAGES, TEXT_SHARE, TEXT_MIXED = 10, 0.9, 8
#: A class stays if it is out of order, or crosses others, on at most this share of its pages.
ODD = 0.05
#: The share of the text outside of links that the main element holds, on pages without article and main.
MOST = 0.6

_ATTRIBUTES = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))
    |<(?P<raw>script|style|textarea|title|iframe|xmp|noembed|noframes)(?=[\s/>])(?:{_ATTRIBUTES}>|[^>]*+>).*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)
    |<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?:(?P<attributes>{_ATTRIBUTES})(?:>|\Z)|(?P<loose>[^>]*+)(?:>|\Z))
    |<[!?/][^>]*+(?:>|\Z)""",
    re.S | re.I | re.X,
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements whose text isn't the article's.
_ASIDE = frozenset("nav header footer aside form menu search dialog noscript svg math template select object canvas video audio button datalist head".split())
#: An element that begins ends an open one of these, up to one of those.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select", "datalist")),
}
_SCOPE = frozenset("table td th caption button object html".split())
_PLAIN_WORDS = (
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer sidebar ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored "
    "promo promotion notice notices cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login search searchbox comment comments discussion disqus reply replies "
    "respond responses share sharing social related recommended recommendations pagination pager complementary contentinfo alert header toolbar copyright disclaimer"
)
_OUT_WORDS = frozenset(_PLAIN_WORDS.split())
#: With one of these, a word of the others only describes the layout.
_IN_WORDS = frozenset("content article main body wrapper layout container page post entry with has no story text".split())
#: What an article inside doesn't open again.
_STRICT = frozenset("aside footer comment comments discussion disqus reply replies related recommended recommendations sidebar".split())


#: Hashes of tags by (place, name, class), and what attributes say; both are cleared when they have this many entries.
_KNOWN = 100_000
_places: dict[tuple[int, str, str], int] = {}
_said: dict[str, tuple[str, frozenset[str], bool]] = {}


def _place(above: int, name: str, kind: str) -> int:
    """An even hash of where a tag stands: the element above, its name and class."""
    key = above, name, kind
    found = _places.get(key)
    if found is None:
        if len(_places) >= _KNOWN:
            _places.clear()
        found = _places[key] = xxhash.xxh64_intdigest(f"{above} {name} {kind}".encode("utf-8", "surrogatepass")) >> 1 & ~1
    return found


def _attributes(text: str) -> tuple[str, frozenset[str], bool]:
    """(class without digits, words of class, id and role, whether the element is hidden)."""
    found = _said.get(text)
    if found is None:
        kind, words, hidden = "", set(), False
        for m in _NAMED.finditer(text):
            what, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            hidden |= what == "hidden" or what == "aria-hidden" and value.lower() == "true" or what == "style" and bool(re.search(r"display\s*:\s*none", value, re.I))
            if what == "class":
                kind = kind or re.sub(r"\d+", "", value)
            if what in ("class", "id", "role"):
                words |= {w.lower() for w in _WORDS.findall(value)}
        if len(_said) >= _KNOWN:
            _said.clear()
        found = kind, frozenset(words), hidden
        if len(text) < 1000:
            _said[text] = found
    return found


@dataclass
class Block:
    """A block of text: its token, whether an article or main holds it, its element, and how many characters are in links."""

    text: str
    token: int
    article: bool
    main: bool
    node: int
    linked: int


@dataclass
class Page:
    tokens: list[int] = field(default_factory=list)  # even: tags, odd: texts
    blocks: list[Block] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [-1])  # of each element, by number; 0 is the page


@dataclass(slots=True)
class _Open:
    name: str
    place: int
    node: int
    out: str  # why text here isn't the article's
    article: bool
    main: bool
    link: bool


def _why_out(name: str, words: frozenset[str], hidden: bool, top: _Open) -> str:
    """The element or word for which the text of an element isn't the article's; empty if it is."""
    if hidden:
        return "hidden"
    said = min(words & _OUT_WORDS, default="") if words and not words & _IN_WORDS else ""
    if name in ("html", "body", "main"):
        said = ""
    elif name == "article":
        said = said if said in _STRICT else ""
    elif name in _ASIDE:
        said = said or name
    if not top.out:
        return said
    if name in _HEADINGS and top.out == "header" and top.article:
        return said
    if name in ("article", "main") and top.out not in _STRICT and top.out != "hidden":
        return said
    return top.out


def parse(text: str, tokens: bool = True) -> Page:
    """The page's blocks outside of menus and the like, and its tokens; without `tokens`, neither is told apart."""
    page, pieces, linked = Page(), [], 0
    stack, names = [_Open("", 0, 0, "", False, False, False)], Counter()

    def flush() -> None:
        nonlocal linked
        said = " ".join(entities.unescape("".join(pieces)).split())
        pieces.clear()
        if said:
            top, token = stack[-1], 1
            if tokens:
                token = xxhash.xxh64_intdigest(said.encode("utf-8", "surrogatepass"), top.place) >> 1 | 1
                page.tokens.append(token)
            page.blocks.append(Block(said, token, top.article, top.main, top.node, min(linked, len(said))))
        linked = 0

    def close(at: int) -> None:
        for gone in stack[at:]:
            names[gone.name] -= 1
        del stack[at:]

    def last(wanted: tuple[str, ...], until: frozenset | tuple) -> int:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].name in wanted:
                return at
            if stack[at].name in until:
                break
        return 0

    at = 0
    for m in _TOKEN.finditer(text):
        if at < m.start() and not stack[-1].out:
            pieces.append(text[at : m.start()])
            if stack[-1].link:
                linked += m.start() - at
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        block = name in _BLOCKS
        if block and pieces:
            flush()
        if m["end"]:
            if name == "br":
                pieces.append(" ")
            elif names.get(name):
                found = len(stack) - 1 if stack[-1].name == name else last((name,), (_SCOPE if name == "p" else ()) if block else _BLOCKS)
                if found:
                    if tokens:
                        page.tokens.append(_place(stack[found].place, "/", ""))
                    close(found)
            continue
        if block and names["p"] and (found := last(("p",), _SCOPE)):
            close(found)
        if name in _IMPLIED and (found := last(*_IMPLIED[name])):
            close(found)
        attributes = m["attributes"] or m["loose"]
        kind, words, hidden = _attributes(attributes) if attributes else ("", frozenset(), False)
        top = stack[-1]
        place = 0
        if tokens:
            place = _place(top.place, name, kind)
            page.tokens.append(place)
        if name in _VOID:
            if name == "br" and not top.out:
                pieces.append(" ")
            continue
        if attributes and attributes.endswith("/") and name in ("svg", "math"):
            continue
        out = _why_out(name, words, hidden, top)
        page.parents.append(top.node)
        stack.append(_Open(name, place, len(page.parents) - 1, out, top.article or name == "article" and not out, top.main or name == "main" and not out, top.link or name == "a"))
        names[name] += 1
    if at < len(text) and not stack[-1].out:
        pieces.append(text[at:])
        linked += len(text) - at if stack[-1].link else 0
    if pieces:
        flush()
    return page


def main_text(page: Page, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The article's blocks that aren't the template's, in page order, a line each."""
    if any(b.article for b in page.blocks):
        held = [b for b in page.blocks if b.article]
    elif any(b.main for b in page.blocks):
        held = [b for b in page.blocks if b.main]
    else:
        held = _densest([b for b in page.blocks if b.token not in template], page.parents)
    return "\n".join(b.text for b in held if b.token not in template)


def _densest(blocks: list[Block], parents: list[int]) -> list[Block]:
    """Blocks of the innermost element that holds MOST of the text outside of links; blocks of links alone go."""
    weights = [0] * len(parents)
    for b in blocks:
        weights[b.node] += len(b.text) - b.linked
    for node in range(len(parents) - 1, 0, -1):
        weights[parents[node]] += weights[node]
    best = 0
    for node in range(1, len(parents)):  # children come after their parents
        if parents[node] == best and weights[node] >= MOST * weights[0] > 0:
            best = node
    inside = [False] * len(parents)
    inside[best] = True
    for node in range(best + 1, len(parents)):
        inside[node] = inside[parents[node]]
    return [b for b in blocks if inside[b.node] and b.linked < 0.8 * len(b.text)]


def with_host(pages: DataFrame, url: str) -> DataFrame:
    """pages with `__host`, a hash of the url's host; null without one."""
    host, _ = url_parts(F.col(url))
    return pages.withColumn("__host", F.when(host != "", F.xxhash64(host)))


def page_tokens(pages: DataFrame, html: str) -> DataFrame:
    """(__host, page, tokens): a page's tokens in order; page is a hash that tells pages of a host apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [parse(t or "").tokens for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.list_(pa.int64()))], ["__host", "page", "tokens"])

    one = F.xxhash64(F.monotonically_increasing_id(), html)
    return pages.where("__host IS NOT NULL").select("__host", one.alias("page"), html).mapInArrow(run, "__host long, page long, tokens array<long>")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of whole numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def occurrence_sums(tokens: DataFrame) -> DataFrame:
    """(__host, token, pages, f1, f2, at, mixed): a fingerprint of each token's counts over its host's pages, the sum of its first
    places, and in which buckets of the rest of their text its pages are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for host, page, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                seq = seq.values.to_numpy(zero_copy_only=False)
                if not len(seq):
                    continue
                found, first, n = np.unique(seq, return_index=True, return_counts=True)
                with np.errstate(over="ignore"):
                    prints = _mixed(np.uint64(page & (1 << 64) - 1) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64))
                said = found & 1 == 1
                rest = np.bitwise_xor.reduce(found[said]) if said.any() else 0
                bucket = np.where(said, np.int64(1) << (_mixed((found ^ rest).astype(np.uint64)) % np.uint64(63)).astype(np.int64), 0)
                made.append((np.full(len(found), host), found, (prints >> np.uint64(33)).astype(np.int64), (prints & np.uint64((1 << 31) - 1)).astype(np.int64), first.astype(np.int64), bucket))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], ["__host", "token", "f1", "f2", "at", "bucket"])

    rows = tokens.mapInArrow(run, "__host long, token long, f1 long, f2 long, at long, bucket long")
    return rows.groupBy("__host", "token").agg(F.count("*").alias("pages"), F.sum("f1").alias("f1"), F.sum("f2").alias("f2"), F.sum("at").alias("at"), F.expr("bit_or(bucket)").alias("mixed"))


def equivalence_classes(tokens: DataFrame) -> DataFrame:
    """(__host, classes): the host's classes of tokens with one occurrence vector, each in the order of its tokens."""
    hosts = tokens.groupBy("__host").agg(F.count("*").alias("n"))
    sums = occurrence_sums(tokens).where(F.col("pages") >= PAGES).join(hosts, "__host")
    is_text = F.col("token").bitwiseAND(1) == 1
    frequent = (F.col("pages") >= TEXT_PAGES) & (F.col("pages") >= F.col("n") * TEXT_SHARE) & (F.bit_count("mixed") >= TEXT_MIXED)
    sums = sums.where((F.col("pages") >= F.col("n") * SHARE) & (~is_text | frequent))
    grouped = sums.groupBy("__host", "pages", "f1", "f2").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("c"))
    return grouped.groupBy("__host").agg(F.array_sort(F.collect_list(F.transform("c", lambda c: c["token"]))).alias("classes"))


def sweep(seq: list[int], of: dict[int, tuple[int, int]], sizes: list[int]) -> tuple[dict[int, tuple[int, int]], set[int]]:
    """Of one page: (class -> (class around it, its slot) where it begins first, classes that are out of order or cross others).

    of: token -> (class, place in it). A class begins with its first token and ends with its last; what begins between must end there.
    """
    around: dict[int, tuple[int, int]] = {}
    bad: set[int] = set()
    open_: list[list[int]] = []  # [class, next place]
    for token in seq:
        if token not in of:
            continue
        c, place = of[token]
        if place == 0:
            if any(o[0] == c for o in open_):
                bad.add(c)
                continue
            around.setdefault(c, (open_[-1][0], open_[-1][1]) if open_ else (-1, 0))
            if sizes[c] > 1:
                open_.append([c, 1])
            continue
        at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == c), None)
        if at is None or open_[at][1] != place:
            bad.add(c)
            continue
        bad.update(o[0] for o in open_[at + 1 :])
        del open_[at + 1 :]
        open_[at][1] += 1
        if open_[at][1] == sizes[c]:
            open_.pop()
    bad.update(o[0] for o in open_)
    return around, bad


def templates(tokens: DataFrame) -> DataFrame:
    """(__host, nodes): valid classes (class, around, slot, tokens), each in a slot of a valid one around it, or in none (-1)."""
    classes = written(equivalence_classes(tokens), "classes")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple[int, int, int, int], list[int]] = {}
            known: dict[int, tuple[dict, list]] = {}
            for host, seq, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if host not in known:
                    listed = found.as_py()
                    known[host] = {t: (c, p) for c, ts in enumerate(listed) for p, t in enumerate(ts)}, [len(ts) for ts in listed]
                around, bad = sweep(seq, *known[host])
                for c, (other, slot) in around.items():
                    n = rows.setdefault((host, c, other, slot), [0, 0])
                    n[0] += 1
                    n[1] += c in bad
            out = [(*k, *n) for k, n in rows.items()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["__host", "class", "around", "slot", "n", "bad"])

    met = tokens.join(classes, "__host").select("__host", "tokens", "classes").mapInArrow(check, "__host long, class long, around long, slot long, n long, bad long")
    places = met.groupBy("__host", "class", "around", "slot").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    usual = F.max_by(F.struct("around", "slot"), F.struct("n", -F.col("around"), -F.col("slot"))).alias("at")
    valid = places.groupBy("__host", "class").agg(usual, F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("bad") <= F.col("n") * ODD)
    listed = valid.groupBy("__host").agg(F.array_sort(F.collect_list(F.struct(F.col("class"), "at.around", "at.slot"))).alias("valid")).join(classes, "__host")

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, valid, listed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                around = {v["class"]: v["around"] for v in valid}
                held = []
                for v in valid:
                    c, seen = v["class"], set()
                    while c != -1 and c in around and c not in seen:
                        seen.add(c)
                        c = around[c]
                    if c == -1:
                        held.append({**v, "tokens": listed[v["class"]]})
                out.append({"__host": host, "nodes": held})
            yield pa.RecordBatch.from_pylist(out, batch_schema)

    batch_schema = pa.schema([("__host", pa.int64()), ("nodes", pa.list_(pa.struct([("class", pa.int64()), ("around", pa.int64()), ("slot", pa.int64()), ("tokens", pa.list_(pa.int64()))])))])
    return listed.select("__host", "valid", "classes").mapInArrow(nest, "__host long, nodes array<struct<class: long, around: long, slot: long, tokens: array<long>>>")


def extract_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with `text` and `n_chars` in place of html; input columns of these names are replaced."""
    bound_batches(pages.sparkSession)
    hosted = with_host(pages, url)
    tokens = written(page_tokens(hosted, html), "tokens")
    texts = F.filter(F.flatten("nodes.tokens"), lambda t: t.bitwiseAND(1) == 1)
    found = written(templates(tokens).select("__host", texts.alias("__template")).where(F.size("__template") > 0), "templates")
    met = hosted.join(found, "__host", "left")
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(len(kept) + 1).to_pylist()
            said = [main_text(parse(t or "", bool(found)), set(found or ())) for t, found in zip(batch.column(len(kept)).to_pylist(), held, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(said, pa.string())], [*kept, "text"])

    return met.select(*kept, html, "__template").mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
