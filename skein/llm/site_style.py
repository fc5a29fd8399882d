"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of styles: a style node is a path of elements with their
classes, and below it hang its content nodes, the texts of its blocks. Every block of every page is counted.
A style node's importance mixes two entropies over the host's pages: how much its children's layout varies
(presentation), and how far the texts below it come back from page to page (content). What is known of an
element beforehand multiplies it: by CERTAIN if it calls itself (tag, class, id, role) a menu, header, footer,
sidebar, notice, advert, form or comment, or lies outside the article of a page that has one, whose texts differ
from page to page by nature; by LIKELY for other names, as of related links, which stay where their texts vary
as an article's do. A content node's importance is the entropy of its own text alone. Style nodes below LOW, and
content nodes below LOW on most pages, leave every page; nothing else does. Where a style node is on fewer than
PAGES pages, or its host has no more, nothing is known but the factor, and any factor is too low.

A page that would lose more than 1 - SOLID of its article so is no page with a template but a copy of other
pages: it loses repeated texts only, and if that is too much as well, only what its elements give away.

Node counts are combined in the task and again before the shuffle, so a host may hold any share of
the pages; the nodes to drop are few per host and reach the pages by host.

Defined results: a null or empty html has the empty text; a null url is a host of its own; broken
markup is read as browsers do (unclosed elements end with their parent); equal rows give equal texts;
an empty table gives no rows; columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import long_rows, lookup, scope, written

#: Nodes below LOW go if at least so many pages show them; a page keeps at least SOLID of its article's characters.
LOW, SOLID, PAGES = 0.3, 0.3, 5
#: Factors of what is known beforehand, by level; the last is below LOW, so it decides at any entropy.
LIKELY, CERTAIN = 0.45, 0.25
FACTORS = (1.0, LIKELY, CERTAIN)
GAMMA = 0.9
#: Elements nested deeper share the node of their ancestor at this depth.
DEPTH = 16

# Elements by role. Those without a text of the page, and those that aren't an article's.
HIDDEN = set("script style noscript template iframe svg canvas object embed audio video head title math".split())
DROPPED = set("nav footer aside form button select option textarea menu dialog".split())
RAW = set("script style textarea title noscript iframe".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MAIN = {"article", "main"}
KEPT = {"html", "body", "article", "main"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
AROUND_P = {"html", "body", "article", "main", "div", "section", "td", "li", "blockquote"}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Words in classes, ids and roles of what isn't the article.
#: Those that an article may hold as a part of it where their texts differ from page to page.
PERHAPS = set("promo promotion promotions popup modal overlay share sharing social related recommended widget widgets toolbar pagination pager search skip alert".split())
NOISE = PERHAPS | set("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors menu menubar nav navbar navigation breadcrumb breadcrumbs sidebar sidebars footer colophon contentinfo complementary masthead cookie cookies consent notice notices gdpr newsletter subscribe subscription comment comments reply replies respond discussion disqus login signin".split())
ABOVE = set("header topbar".split())  # only outside an article
CONTENT = set("content article post entry body main story text".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?:^|[\s/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


def _hash(*parts) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode()) - (1 << 63)


def host(url: Column) -> Column:
    """The host of a url in lower case, without user and port; empty for a null."""
    name = F.regexp_extract(F.substring_index(F.coalesce(url, F.lit("")), "://", -1), r"^[^/?#]*", 0)
    return F.lower(F.regexp_replace(F.substring_index(name, "@", -1), r":\d+$", ""))


class _Element:
    __slots__ = ("tag", "node", "depth", "nodes", "named", "hidden", "level", "main", "children", "block")

    def __init__(self, tag, node, depth, nodes, named, hidden, level, main, block):
        self.tag, self.node, self.depth, self.nodes, self.named, self.hidden, self.level, self.main, self.children = tag, node, depth, nodes, named, hidden, level, main, []
        self.block = block or self


def _says(tag: str, attributes: str, inside: bool) -> tuple[int, str]:
    """What an element says of itself (0: it may be of an article, 1: hardly, 2: it isn't), and its style."""
    level = 2 * (tag in DROPPED or tag == "header" and not inside)
    if "=" not in attributes:
        return level, tag
    found = {m[0].lower(): (m[1] or m[2] or m[3]).lower() for m in _ATTR.findall(attributes)}
    words = set(_WORDS.findall(" ".join(found.values())))
    if not level and tag not in KEPT and not words & CONTENT and (noise := words & NOISE | (set() if inside else words & ABOVE)):
        level = 1 if noise <= PERHAPS else 2
    return level, f"{tag}.{'.'.join(sorted(found.get('class', '').split()))}"


class Block(NamedTuple):
    """A block of text: its style nodes from the outermost in, those of them that are named, and whether it is in
    an article."""

    text: str
    nodes: tuple[int, ...]
    named: tuple[int, ...]
    main: bool

    @property
    def content(self) -> int:
        return _hash(self.nodes[-1] if self.nodes else 0, self.text)


class Node(NamedTuple):
    """A style node of a page: its ancestors and itself, the highest level around it, hash of its children's
    layout."""

    nodes: tuple[int, ...]
    level: int
    kept: bool
    main: bool
    layout: int


class _Tags:
    """The tags of a page from front to back. A quote that nothing closes, or no > follows, is a plain sign; what
    has been found missing once isn't looked for again."""

    def __init__(self, html: str):
        self.html, self.last, self.missing = html, html.rfind(">"), set()

    def _find(self, sign: str, at: int) -> int:
        found = -1 if sign in self.missing else self.html.find(sign, at)
        if found < 0:
            self.missing.add(sign)
        return found

    def _end(self, at: int) -> int:
        """The > that ends a tag, -1 if none does."""
        if at > self.last:
            return -1
        first, place = self.html.find(">", at), at
        while (m := _QUOTE.search(self.html, place)) and m[0] != ">":
            close = self._find(m[0], m.end())
            if close < 0 or close > self.last:
                return first
            place = close + 1
        return m.start() if m else first

    def next(self, at: int):
        """start, end, whether it ends an element, name (empty: a comment or the like) and attributes of the next tag."""
        while (start := self._find("<", at)) >= 0:
            if self.html.startswith("<!--", start):
                stop = self._find("-->", start + 4)
                return start, len(self.html) if stop < 0 else stop + 3, False, "", ""
            m = _NAME.match(self.html, start + 1)
            if m and (stop := self._end(m.end())) >= 0:
                return start, stop + 1, bool(m[1]), m[2].lower(), self.html[m.end() : stop]
            if not m and self.html[start + 1 : start + 2] in ("!", "?") and (stop := self._find(">", start)) >= 0:
                return start, stop + 1, False, "", ""
            at = start + 1
        return None


def parse(html: str) -> tuple[list[Block], list[Node]]:
    """Blocks and style nodes of a page, in time linear in its length whatever its markup is like."""
    root = _Element("", 0, 0, (), (), False, 0, False, None)
    stack, opened, blocks, nodes, held = [root], {}, [], [], []

    def flush():
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            top = stack[-1].block
            if text:
                blocks.append(Block(text, top.nodes, top.named, top.main))

    def hold(text):
        """Keeps text for the block; an inline element that says it isn't an article's leaves its own out."""
        top = stack[-1]
        if not top.hidden and not (top.level > top.block.level):
            held.append(text)

    def pop():
        e = stack.pop()
        opened[e.tag].pop()
        if e.tag not in INLINE and e.depth < DEPTH and not e.hidden:
            nodes.append(Node(e.nodes, e.level, e.tag in KEPT, e.main, _hash(*e.children)))

    def place(tags):
        """Where in the stack the nearest of tags is, 0 if none is open."""
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def close(tags, least):
        """Closes the nearest of tags, if it is above a place in the stack."""
        at = place(tags)
        if at > least:
            while len(stack) > at:
                pop()

    tags, at, lower = _Tags(html), 0, None
    while (found := tags.next(at)) is not None:
        start, end, ends, tag, attributes = found
        if start > at:
            hold(html[at:start])
        at = end
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            held.append(" ")
            continue
        if ends:
            if tag in INLINE:
                block = stack[-1].block
                close({tag}, opened[block.tag][-1] if block is not root else 0)
            elif opened.get(tag):
                close({tag}, 0)
            continue
        if tag not in INLINE:
            if tag in CLOSES:
                close(CLOSES[tag], place(STOPS[tag]))
            elif opened.get("p"):
                close({"p"}, place(AROUND_P))
        parent = stack[-1]
        if tag in VOID:
            continue
        level, style = _says(tag, attributes, parent.main)
        above, hidden = max(parent.level, level), parent.hidden or tag in HIDDEN
        if tag in INLINE:
            named = (*parent.named, _hash(parent.node, style)) if level else parent.named  # no style node, so none stays
            element = _Element(tag, parent.node, parent.depth, parent.nodes, named, hidden, above, parent.main, parent.block)
        else:
            deep = parent.depth >= DEPTH
            node = parent.node if deep else _hash(parent.node, style)
            named = (*parent.named, node) if level and node not in parent.named else parent.named
            element = _Element(tag, node, parent.depth + (not deep), parent.nodes if deep else (*parent.nodes, node), named, hidden, above, parent.main or tag in MAIN, None)
            if not parent.children or parent.children[-1] != style:
                parent.children.append(style)
        opened.setdefault(tag, []).append(len(stack))
        stack.append(element)
        if tag in RAW and not attributes.rstrip().endswith("/"):
            lower = html.lower() if lower is None else lower
            if len(lower) != len(html):  # some letters change length
                lower = re.sub("[A-Z]", lambda x: x[0].lower(), html)
            stop = lower.find(f"</{tag}", at)
            at = len(html) if stop < 0 else stop
    hold(html[at:])
    flush()
    while len(stack) > 1:
        pop()
    return blocks, nodes


class Tree(NamedTuple):
    """What a host's tree says: style nodes and content nodes of low importance, and the named style nodes that stay.
    Of a host with too few pages there is nothing."""

    low: frozenset = frozenset()
    repeated: frozenset = frozenset()
    stay: frozenset = frozenset()


def main_text(html: str | None, tree: Tree = Tree()) -> str:
    """The blocks of a page without those in style nodes of low importance and content nodes that come back."""
    blocks = parse(html or "")[0]
    inside = any(b.main for b in blocks)
    plain = [b for b in blocks if not b.named and (b.main or not inside)]
    least = SOLID * sum(len(b.text) for b in plain)

    def low(b: Block) -> bool:
        # Named nodes that don't stay are low or on too few pages; outside an article all are (CERTAIN).
        return inside and not b.main or not tree.low.isdisjoint(b.nodes) or not tree.stay.issuperset(b.named)

    fresh = [b for b in blocks if not low(b) and b.content not in tree.repeated]
    for kept in (fresh, [b for b in plain if b.content not in tree.repeated]):
        if sum(len(b.text) for b in kept) >= least:
            return "\n\n".join(b.text for b in kept)
    return "\n\n".join(b.text for b in plain)


#: What is counted for a host's nodes: on how many pages a text is, and a layout; the node's ancestors; the pages; and
#: by level (feature) how often a page knows something of it beforehand.
CONTENT_OF, LAYOUT_OF, ABOVE_OF, PAGE, LEVEL_OF = range(5)


def _counted(pages: DataFrame) -> DataFrame:
    """host, node, kind, feature and c."""

    def run(batches):
        import pyarrow as pa

        from skein.llm.tokens import slices

        kinds = [("host", pa.string()), ("node", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64()), ("c", pa.int64())]

        def out():
            counts.update({(host, nodes[-1], ABOVE_OF, up): 1 for host, nodes in paths for up in nodes})
            rows = list(zip(*counts, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip([*rows, list(counts.values())], kinds, strict=True)], names=[n for n, _ in kinds])

        counts, paths = Counter(), set()
        for batch in slices(batches, column="html"):
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                blocks, nodes = parse(html or "")
                found = {(host, b.nodes[-1], CONTENT_OF, b.content) for b in blocks if b.nodes}
                found.update((host, n.nodes[-1], LAYOUT_OF, n.layout) for n in nodes if n.nodes)
                found.add((host, 0, PAGE, 0))
                inside = any(b.main for b in blocks)
                mine = [n for n in nodes if n.nodes and not n.kept]
                found.update((host, n.nodes[-1], LEVEL_OF, 2 if inside and not n.main else n.level) for n in mine)
                counts.update(found)
                paths.update((host, n.nodes) for n in mine)
                if len(counts) > 200_000:
                    yield out()
                    counts, paths = Counter(), set()
        yield out()

    counted = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, node long, kind int, feature long, c long")
    return counted.groupBy("host", "node", "kind", "feature").agg(F.sum("c").alias("c"))


def importance(counts: DataFrame) -> DataFrame:
    """host, node, pages and importance of the style nodes of all hosts of at least PAGES pages; articles and
    what is around them aside."""
    hosts = counts.where((F.col("kind") == PAGE) & (F.col("c") >= PAGES)).select("host", F.ln(F.col("c").cast("double")).alias("lm"))
    log = F.ln(F.col("c").cast("double"))
    above = counts.where(F.col("kind") == ABOVE_OF).select("host", "node", F.col("feature").alias("up"))
    # The level that most pages give a node; of equals the higher.
    levels = counts.where(F.col("kind") == LEVEL_OF).groupBy("host", "node").agg(F.max_by("feature", F.struct("c", "feature")).alias("level"))
    texts = counts.where(F.col("kind") == CONTENT_OF).groupBy("host", "node").agg(F.sum(log).alias("same"), F.count("*").alias("texts"))
    below = above.join(texts, ["host", "node"]).groupBy("host", F.col("up").alias("node")).agg(F.sum("same").alias("same"), F.sum("texts").alias("texts"))
    layouts = counts.where(F.col("kind") == LAYOUT_OF).groupBy("host", "node").agg(F.sum(F.col("c") * log).alias("clogc"), F.sum("c").alias("pages"), F.count("*").alias("layouts"))
    nodes = levels.join(layouts, ["host", "node"]).join(below, ["host", "node"]).join(hosts, "host")
    content = 1 - F.col("same") / F.col("texts") / F.col("lm")
    layout = (F.ln(F.col("pages").cast("double")) - F.col("clogc") / F.col("pages")) / F.col("lm")
    share = F.pow(F.lit(GAMMA), F.col("layouts").cast("double"))
    factor = F.array(*[F.lit(x) for x in FACTORS])[F.col("level").cast("int")]
    return nodes.select("host", "node", "pages", "level", (factor * ((1 - share) * layout + share * content)).alias("importance"))


def low_nodes(pages: DataFrame) -> DataFrame:
    """host, low, repeated and stay (see Tree) of the hosts of at least PAGES pages that have any."""
    counts = written(_counted(pages), "styles")
    hosts = counts.where((F.col("kind") == PAGE) & (F.col("c") >= PAGES)).select("host", F.col("c").alias("m"))
    texts = counts.where((F.col("kind") == CONTENT_OF) & (F.col("c") >= PAGES)).join(hosts, "host")
    entropy = F.ln(F.col("c").cast("double")) / F.ln(F.col("m").cast("double"))
    texts = texts.where((1 - entropy < LOW) & (2 * F.col("c") >= F.col("m"))).select("host", F.lit("repeated").alias("what"), F.col("feature").alias("x"))
    nodes = importance(counts).where(F.col("pages") >= PAGES)
    low = nodes.where(F.col("importance") < LOW).select("host", F.lit("low").alias("what"), F.col("node").alias("x"))
    stay = nodes.where((F.col("importance") >= LOW) & (F.col("level") > 0)).select("host", F.lit("stay").alias("what"), F.col("node").alias("x"))
    # A host has few styles, and few texts that are on half of its pages.
    sets = [F.collect_set(F.when(F.col("what") == w, F.col("x"))).alias(w) for w in ("low", "repeated", "stay")]
    return low.unionByName(texts).unionByName(stay).groupBy("host").agg(*sets)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        import pyarrow as pa

        from skein.llm.tokens import slices

        trees: dict[bytes, Tree] = {}  # of the last hosts

        def known(*found):
            key = b"|".join(np.array(x or (), np.int64).tobytes() for x in found)
            if key not in trees:
                if len(trees) > 1000:
                    trees.clear()
                trees[key] = Tree(*(frozenset(x or ()) for x in found))
            return trees[key]

        for batch in slices(batches, column="html"):
            texts = [main_text(h, known(*x)) for h, *x in zip(*(batch.column(c).to_pylist() for c in ("html", "low", "repeated", "stay")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    long_rows(pages.sparkSession)
    with scope(pages.sparkSession) as keep:
        low = keep(written(low_nodes(pages), "low"))
    keyed = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    rows = lookup(keyed, low, "host", F.col("page_id"), "left").select("page_id", "url", "html", "low", "repeated", "stay")
    return rows.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
