"""HTML main-text extraction with inferred wrappers (union-free regular expressions).

A page is a stream of structural tags and text. The pages of a host come from few templates, so
their streams are aligned into one wrapper: tags under equal ancestors match; a tag that stands
beside another of its shape becomes a repeated group; one that only some pages have, an optional
one; texts that differ become slots, texts that recur stay part of the template. A tag's place is its
path of shapes (element and class names without their digits), so aligning two streams is a union
of places, mismatches resolve themselves, and the order in which pages are aligned cannot matter:
what the wrapper knows of a place is a sum over pages (``infer``).

A page's main text is what its host's wrapper holds in slots. A place whose text is always the
same, beside at least ``ENOUGH`` different main contents, is no slot but template: copies of a page
are one content, so they never erase it, and a text that few pages hold stays. A heading that
never changes is kept where content follows it. Where a page marks its article and the mark holds slots, only the article
counts (cards of a repeated group beside a longer text mark none). Elements whose kind or name says
menu, header, footer, sidebar, notice, advert, form or comment are left out besides.

A page is parsed in one pass without recursion, places and texts go by 64-bit digests, and only
digests are grouped, by place. Then every page meets its host's wrapper (``wrappers``), is parsed
again, which costs less than writing and moving all text, and matched against it (``Wrapper.match``).
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm.common import HOT_SHARE, join_counted, written

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: What the elements of HTML are.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q "
                   "rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure "
                     "footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section "
                     "table ul".split())
CLOSES_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
              "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements, roles and names that never hold main text.
ASIDE_TAGS = frozenset("nav footer aside form script style noscript template button select "
                       "option input textarea label fieldset legend iframe object embed svg math "
                       "canvas audio video map menu dialog head title datalist output".split())
ASIDE_ROLES = frozenset("navigation contentinfo complementary search form alert alertdialog "
                        "dialog menu menubar toolbar banner status".split())
ASIDE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor "
                        "sponsored promo promotion banner nav navbar navigation menu breadcrumb "
                        "breadcrumbs footer sidebar aside widget widgets related recommended "
                        "share sharing social cookie cookies consent gdpr notice notices notification "
                        "alert popup modal overlay newsletter subscribe subscription signup "
                        "login comment comments discussion respond replies reply disqus "
                        "pagination pager copyright form".split())
#: Names that only count outside an article (an article may have a head of its own).
ASIDE_OUTSIDE = frozenset("header masthead topbar toolbar tags".split())
#: First parts of names that describe a state, not the element's own part.
STATE_WORDS = frozenset("has with no without is show hide".split())
#: Distinct main contents beside which a text must recur to count as template.
ENOUGH = 3
_LISTS = frozenset(("ul", "ol", "dl", "table"))
_DIGITS = re.compile("[0-9]+")


@dataclass
class Block:
    """A stretch of text: ``place`` is its element's, ``key`` the digest of the element's whole
    direct text, ``article`` the number of its outermost marked article (0: none), ``heading`` its
    level."""
    text: str
    article: int
    heading: int
    place: int
    key: int = 0


@dataclass
class Place:
    """What one page has at a path: how often, in which order first, and which texts."""
    parent: int
    shape: str
    order: int
    count: int = 0
    texts: set = field(default_factory=set)


@dataclass
class Page:
    blocks: list[Block]
    places: dict[int, Place]
    articles: list[int]  # the place of each outermost article; number k is articles[k - 1]

    def content(self) -> int:
        """What the page is about: the digest of its longest block. Copies of a page that differ in
        a date or a counter have the same."""
        longest = max((b.text for b in self.blocks), key=lambda t: (len(t), t), default="")
        return _digest(longest, 0)


class _Open:
    """An element whose end has not come yet."""

    __slots__ = ("tag", "place", "aside", "article", "heading", "own", "inside")

    def __init__(self, tag, place, aside, article, heading, inside):
        self.tag, self.place, self.aside = tag, place, aside
        self.article, self.heading, self.inside = article, heading, inside
        self.own: list[Block] = []


def _digest(text: str, seed: int) -> int:
    got = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed & (1 << 64) - 1)
    return got - (1 << 64) if got >> 63 else got


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "")
            for m in _ATTRIBUTE.finditer(raw)}


def _kind(tag: str, raw: str, inside: bool) -> tuple[str, bool, bool]:
    """An element's shape, whether it never holds main text, and whether it marks an article."""
    a = _attributes(raw) if raw.strip(" /") else {}
    named = [_NAME.findall(v) for v in f"{a.get('class', '')} {a.get('id', '')}".split()]
    # ``has-sidebar`` says something about the page, not about this element
    names = {n.lower() for parts in named if parts and parts[0].lower() not in STATE_WORDS
             for n in parts}
    role = a.get("role", "").lower()
    aside = (tag in ASIDE_TAGS or role in ASIDE_ROLES or bool(names & ASIDE_NAMES)
             or "hidden" in a or "display:none" in a.get("style", "").replace(" ", "").lower()
             or a.get("aria-hidden", "").lower() == "true"
             or not inside and (tag == "header" or bool(names & ASIDE_OUTSIDE)))
    if tag in ("html", "body", "article", "main"):  # never dropped for their names
        aside = tag in ("article", "main") and bool(names & {"comment", "comments", "reply"})
    shape = f"{tag}.{'.'.join(sorted(_DIGITS.sub('', a.get('class', '')).split()))}"
    return shape, aside, tag in ("article", "main") or role in ("main", "article")


def parse(page: str, host: str = "") -> Page:
    """The page's blocks outside what never holds main text, and its places; broken markup is
    closed where HTML closes it. Open elements stand on a list, so depth costs nothing."""
    root = _Open("", _digest(host, 1), False, 0, 0, False)
    stack, open_tags, at = [root], Counter(), 0
    out = Page([], {root.place: Place(0, "", 0, 1)}, [])
    text: list[str] = []

    def flush():
        if text:
            words = html.unescape("".join(text)).split()
            text.clear()
            top = stack[-1]
            if words and not top.aside:
                block = Block(" ".join(words), top.article, top.heading, top.place)
                top.own.append(block)
                out.blocks.append(block)

    def close_one():
        flush()
        node = stack.pop()
        open_tags[node.tag] -= 1
        if node.own:
            key = _digest("\n".join(b.text for b in node.own), 0)
            out.places[node.place].texts.add(key)
            for b in node.own:
                b.key = key

    def close(tag: str):
        while stack[-1].tag != tag:
            close_one()
        close_one()

    def blocked(tag: str) -> bool:
        """Whether a list or table began inside the innermost open ``tag``."""
        k = len(stack) - 1
        while stack[k].tag != tag:
            if stack[k].tag in _LISTS:
                return True
            k -= 1
        return False

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag, closing, raw = m[2].lower(), bool(m[1]), m[3]
        if tag in INLINE and not _is_aside_inline(tag, raw, closing):
            if closing and open_tags[tag] > 0:  # an inline element that was taken for structure
                close(tag)
            continue
        if closing:
            if open_tags[tag] > 0:
                close(tag)
            elif tag in ("p", "br"):
                flush()
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag in CLOSES_P and open_tags["p"] > 0:
            close("p")
        for own in CLOSES_OWN.get(tag, ()):
            if open_tags[own] > 0 and not blocked(own):
                close(own)
        flush()
        above = stack[-1]
        shape, aside, marks = _kind(tag, raw, above.inside)
        aside = aside or above.aside
        place = _digest(shape, above.place)
        known = out.places.get(place)
        if known is None and not aside:
            known = out.places[place] = Place(above.place, shape, len(out.places))
        if known is not None:
            known.count += 1
        article = above.article
        if marks and not aside and not article:
            out.articles.append(place)
            article = len(out.articles)
        if tag in RAW:  # its content is no markup
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
            at = re.compile(r"[^>]*>?").match(page, at).end()
            continue
        if not raw.rstrip().endswith("/") or tag not in ("svg", "math"):
            level = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and "0" < tag[1] < "7" else \
                above.heading
            stack.append(_Open(tag, place, aside, article, level, above.inside or marks))
            open_tags[tag] += 1
    while stack:
        close_one()
    return out


def _is_aside_inline(tag: str, raw: str, closing: bool) -> bool:
    """An inline element that is named as an advert, notice, ... is kept as structure."""
    return not closing and ("class" in raw or "id" in raw or "hidden" in raw or "style" in raw) \
        and _kind(tag, raw, True)[1]


# -- extraction ------------------------------------------------------------------------------------


def main_text(blocks: list[Block], articles: list[int], template: set[int] | frozenset = frozenset()
              ) -> str:
    """Main text of a page's blocks; ``template``: places whose text is its wrapper's own."""
    fixed = [b.place in template for b in blocks]
    shown = [k for k, f in enumerate(fixed) if not f]
    first = shown[0] if shown else len(blocks)
    after = len(blocks)  # the next block that is no heading
    kept = []
    for k in range(len(blocks) - 1, -1, -1):
        b = blocks[k]
        if not fixed[k]:
            kept.append(k)
        elif b.heading and after < len(blocks) and not fixed[after] \
                and blocks[after].article == b.article and (b.article or first < k):
            kept.append(k)  # a recurring heading over content; outside articles not the page's head
        if not b.heading:
            after = k
    kept.reverse()
    inside = [k for k in kept if blocks[k].article]
    if inside:
        # several cards of a repeated group do not mark the main text if it lies beside them
        often = Counter(articles)
        numbers = {blocks[k].article for k in inside}
        longest = [max((len(blocks[k].text) for k in kept if bool(blocks[k].article) == side),
                       default=0) for side in (False, True)]
        cards = len(numbers) > 1 and all(often[articles[n - 1]] > 1 for n in numbers)
        if not (cards and longest[0] > longest[1]):
            kept = inside
    return "\n".join(blocks[k].text for k in kept)


def host_of(url) -> F.Column:
    """Lower-case host of a URL; the empty string where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?"
                                               r"([^/:?#]*)", 1)), F.lit(""))


#: Numbers of the wrappers that are joined by broadcast (eight bytes each).
MAX_BROADCAST = 4_000_000
#: What a wrapper says of a place, as bits.
OPTIONAL, REPEATED, TEMPLATE = 1, 2, 4


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, n, nodes)``: every host's number of pages and its wrapper (:func:`infer`) for
    matching: ``place, parent, bits`` of each place, one after the other. Places that fewer than
    ``ENOUGH`` pages have are left out: they are optional, their text lies in slots."""
    found = infer(pages, url_col, html_col)
    bits = sum((F.when(F.col(c), bit).otherwise(0) for c, bit in
                (("repeated", REPEATED), ("template", TEMPLATE))),
               F.when(F.col("optional"), OPTIONAL).otherwise(0))
    node = F.when(F.col("pages") >= ENOUGH, F.array("place", "parent", bits.cast("bigint")))
    return found.groupBy("host").agg(
        F.max(F.when(F.col("parent") == 0, F.col("pages"))).alias("n"),
        F.flatten(F.collect_list(node)).alias("nodes"))


class Wrapper:
    """A host's wrapper from its ``nodes`` (see :func:`wrappers`)."""

    def __init__(self, nodes: list[int]):
        self.known = {p: (above, bits) for p, above, bits in zip(*[iter(nodes)] * 3)}
        self.needed: dict[int, list[int]] = {}
        for p, (above, bits) in self.known.items():
            if not bits & OPTIONAL:
                self.needed.setdefault(above, []).append(p)

    def match(self, page: Page) -> frozenset | None:
        """The page's places whose text the wrapper holds itself; its other texts are what lies
        in slots. None where the page does not match: it has a place twice that the wrapper
        has once, or lacks one that is not optional. What the wrapper does not know is an optional
        group of slots."""
        own = []
        for place, got in page.places.items():
            above, bits = self.known.get(place, (got.parent, REPEATED))
            if above != got.parent or got.count > 1 and not bits & REPEATED:
                return None
            if any(p not in page.places for p in self.needed.get(place, ())):
                return None
            if bits & TEMPLATE:
                own.append(place)
        return frozenset(own)


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", out: str = "text"
            ) -> DataFrame:
    """``pages`` without ``html_col``, plus ``out``: the main text of every whole page, blocks in
    page order joined by one newline, white space inside a block as one space, character
    references decoded; empty if there is none (null and empty pages too). Every page is matched
    against its host's wrapper, and its text is what lies in the wrapper's slots. Pages without a host
    share one wrapper; repeated pages stay, and count as one content; other columns pass through, one
    named like the result is replaced; no rows give no rows. Ties cannot arise: a text is template
    or not by a count, whatever the order of rows and partitions."""
    names = [c for c in pages.columns if c not in (html_col, out)]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names])
    sent = pages.select(row.alias("row"), host_of(F.col(f"`{url_col}`")).alias("host"),
                        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    known = written(wrappers(pages, url_col, html_col), "wrappers")
    total = known.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > total
    few, cold = known.agg(F.sum(F.when(hot, F.size("nodes"))), F.count(F.when(~hot, 1))).first()
    if (few or 0) > MAX_BROADCAST:  # too much to broadcast: the adaptive join splits hot hosts
        joined = sent.join(known, "host")
    elif cold:
        joined = join_counted(sent, known, "host", "n", total)
    else:
        joined = sent.join(F.broadcast(known), "host")
    joined = joined.select("row", "host", "html", "nodes")
    schema = T.StructType([joined.schema["row"], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, made = [], {}
            for host, html_, nodes in zip(b.column(1).to_pylist(), b.column(2), b.column(3)):
                if host not in made:
                    made[host] = Wrapper(nodes.as_py())
                page = parse(html_.as_py(), host)
                got.append(main_text(page.blocks, page.articles,
                                     made[host].match(page) or frozenset()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())],
                                             names=["row", out])

    return joined.mapInArrow(run, schema) \
        .select(*[F.col("row").getField(c).alias(c) for c in names], out)


# -- wrappers as such ------------------------------------------------------------------------------


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The wrappers, a row for every place of a host: ``host, place, parent, shape, seen`` (latest
    order on a page), ``pages`` that have it, ``optional`` (some page of the host that has the parent
    lacks it), ``repeated`` (some page has it twice or more), ``slot`` (its texts differ), ``text``
    (it has text), ``template`` (its text is always the same, beside at least ``ENOUGH`` main
    contents). A batch's places are summed up where they are parsed, then by (place, content),
    then by place: sums and extremes, so no order of pages matters."""
    sent = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"),
                        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    schema = ("host string, place bigint, content bigint, parent bigint, shape string, seen bigint, "
              "most bigint, low bigint, high bigint, pages bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.string() if c in ("host", "shape") else pa.int64() for c in names]
        for b in batches:
            found: dict = {}
            for host, html_ in zip(b.column(0).to_pylist(), b.column(1)):
                page = parse(html_.as_py(), host)
                content = page.content()
                for k, p in page.places.items():
                    low, high = (min(p.texts), max(p.texts)) if p.texts else (None, None)
                    # contents are counted where there is text
                    own = found.setdefault((host, k, content if p.texts else None),
                                           [p.parent, p.shape, p.order, p.count, low, high, 0])
                    own[1], own[2] = min(own[1], p.shape), max(own[2], p.order)
                    own[3], own[6] = max(own[3], p.count), own[6] + 1
                    if low is not None:
                        own[4], own[5] = min(own[4], low), max(own[5], high)
            rows = [(*k, *v) for k, v in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t)
                                              for k, t in enumerate(kinds)], names=names)

    ends = [F.min("parent").alias("parent"), F.min("shape").alias("shape"),
            F.max("seen").alias("seen"), F.max("most").alias("most"), F.min("low").alias("low"),
            F.max("high").alias("high"), F.sum("pages").alias("pages")]
    found = written(sent.mapInArrow(run, schema).groupBy("host", "place", "content").agg(*ends)
                    .groupBy("host", "place").agg(*ends, F.count("content").alias("contents")),
                    "places")
    above = found.select(F.col("place").alias("parent"), F.col("pages").alias("above"))
    return found.join(above, "parent", "left").select(
        "host", "place", "parent", "shape", "seen", "pages",
        (F.col("pages") < F.coalesce("above", "pages")).alias("optional"),
        (F.col("most") > 1).alias("repeated"), (F.col("low") != F.col("high")).alias("slot"),
        F.col("low").isNotNull().alias("text"),
        F.coalesce((F.col("low") == F.col("high")) & (F.col("contents") >= ENOUGH), F.lit(False))
         .alias("template"))


def expression(rows: list) -> str:
    """A host's wrapper (its rows of :func:`infer`) as a regular expression over tags, ``#`` for a
    slot; for reading, and for tests."""
    below: dict = {}
    for r in sorted(rows, key=lambda r: (r["seen"], r["shape"])):
        below.setdefault(r["parent"], []).append(r)
    out, todo = [], [r for r in reversed(below.get(0, []))]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            out.append(r)
            continue
        group = r["optional"] or r["repeated"] and r["shape"]
        end = f"</{r['shape'].split('.')[0]}>" if r["shape"] else ""
        if group:
            end += f"){'+' if r['repeated'] else ''}{'?' if r['optional'] else ''}"
        out.append(("(" if group else "") + (f"<{r['shape']}>" if r["shape"] else "")
                   + ("#" if r["slot"] else "text" if r["text"] else ""))
        todo += [end, *reversed(below.get(r["place"], []))]
    return "".join(out)
