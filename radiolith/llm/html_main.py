"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree whose nodes are element paths (tag, classes and id from the body down).  Of every
node the tree knows two entropies over the pages that have it.  Presentation: the entropy of the runs of child elements below
the node, and of being there at all.  Content: a text on c of m pages has the novelty 1 - log c / log (m + ``UNSEEN``), so what most
pages repeat has little; a node's content is the novel words that a page can expect below it.  The composite importance of a
branch joins its content, against the greatest of the branches beside it, with its presentation: a branch is low where it has few
novel words and looks alike on all pages, whether its words vary or not.  Low branches go, and so do texts of low novelty.

What elements say of themselves is a prior on their importance: an article weighs more; menus, headers, footers, sidebars,
notices, adverts, forms and reader comments (by tag, ARIA role, class or id, or a list of links outside an article) weigh so much less
that they go wherever they stand, unless they hold the article.  Scripts, styles and controls are no part of the tree.  A page whose host
has no other is judged by the same rule on what it has itself.

Pages are parsed where they are read, once for the tree's counts and once to extract; only 64-bit keys and counts are
shuffled.  What pages need from the tree of the nodes that many pages of a host have, a short list for each host, is broadcast if its
measured size allows; otherwise hosts with many pages are salted and joined.  Nodes that few pages have go to those pages only, in a list for each
page.  A node on one page says no more than the page itself does, so every page is judged by all that the tree knows of its nodes.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap
from collections.abc import Iterator, Mapping
from functools import partial
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, heavy_keys, materialize, spread_join

#: A branch is low when its composite importance is below the bound, a text when its novelty is.
LOW = 0.2
#: Pages with other styles and texts that a node is taken to have beside those seen, so that few pages settle little.
UNSEEN = 2.0
#: What an article weighs and what an element of another role weighs, as factors.
ARTICLE, ROLE = 4.0, 0.1
#: Share of its words in links from which on a container outside an article is a menu.
MENU_SHARE = 0.6
#: Words from which on a text counts for telling pages apart.
LONG = 12
#: Bytes of the hosts' lists up to which they are broadcast, and pages in one salt of a host beyond it.
BROADCAST_BYTES = 24 << 20
SALT_PAGES = 20_000

# Element names by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head button select option optgroup datalist label input textarea iframe object canvas audio video map template noscript svg math title script style xmp noembed noframes meter progress".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
SCOPES = frozenset("article aside blockquote body caption div dl fieldset figure footer form header html main nav ol section table td th ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tbody", "thead"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that can be branches beside the text; all others belong to the text they stand in.
CONTAINERS = frozenset("address aside center dialog dir div dl fieldset footer form header menu nav ol search section table ul".split())
ROLE_TAGS = frozenset("nav aside footer form fieldset dialog menu dir search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of classes and ids that mark something other than an article, and words that may stand beside them in one name.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs footer sidebar aside rail "
    "cookie cookies consent gdpr notice notices alert alerts banner banners popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations widget widgets comment comments commentlist reply replies respond disqus pagination pager toolbar masthead skip search".split()
)
BESIDE = frozenset(
    "area bar block body bottom box boxes btn button buttons column container content desktop fixed form global group header icon icons inner item items left link links list lists main mobile "
    "outer page panel post posts article articles primary right row secondary section sections site slot sticky top unit wrap wrapper".split()
)
_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
_REST = re.compile(r"""((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d{3,}")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_MASK = 0x7FFFFFFFFFFFFFFF


class Element:
    """An open element.  ``node`` is its block element's node in the tree; ``dropped``, ``link`` and ``article`` hold for all in it."""

    __slots__ = ("tag", "node", "dropped", "link", "article", "block", "kids")

    def __init__(self, tag, node, dropped, link, article, block):
        self.tag, self.node, self.dropped, self.link, self.article = tag, node, dropped, link, article
        self.block = block or self
        self.kids: list[str] = []


class Node:
    """A node of a page's tree: its parent's key, prior weight, and whether it can be a branch, is a heading, is an article or in one."""

    __slots__ = ("parent", "weight", "container", "top", "part", "article", "styles", "words", "fresh", "linked")

    def __init__(self, parent, weight, container, top, part, article):
        self.parent, self.weight, self.container, self.top, self.part, self.article = parent, weight, container, top, part, article
        self.styles: list[Element] = []  # its elements, for the runs of their children
        self.words = self.fresh = self.linked = 0  # fresh: words of its distinct texts, which is how the tree counts


class Block:
    """A run of text in one block element: its node, its text with single spaces, how many words, and the name of the element."""

    __slots__ = ("node", "text", "words", "tag")

    def __init__(self, node, text, words, tag):
        self.node, self.text, self.words, self.tag = node, text, words, tag


def _key(parent: int, signature: str) -> int:
    return xxhash.xxh64_intdigest(signature, parent) & _MASK


def text_key(node: int, text: str) -> int:
    """A text at a node."""
    return xxhash.xxh64_intdigest(text, node) & _MASK


def is_marked(name: str) -> bool:
    """Whether a class or an id, such as ``cookie-banner``, names a part other than the article; all of its words must fit."""
    words = _WORDS.findall(name)
    return any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE for w in words)


_ROOT = 0


def parse(html: str | None) -> tuple[dict[int, Node], list[Block]]:
    """The tree of a page, parents first, and its blocks in order.

    Elements left open are closed as browsers do (a paragraph by the next block, an item by the next item, anything by the
    end of what holds it); a tag, comment or script cut off by the end of the page ends it.
    """
    html = html or ""
    root = Element("html", _ROOT, False, False, False, None)
    nodes = {_ROOT: Node(None, 1.0, False, False, False, False)}
    nodes[_ROOT].styles.append(root)
    stack, out = [root], []
    opened: dict[str, int] = {}  # how many of each name are open
    parts: list[str] = []
    linked = total = 0
    said: set[tuple[int, str]] = set()

    def flush():
        nonlocal linked, total
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                top = stack[-1].block
                words = text.count(" ") + 1
                node = nodes[top.node]
                node.words += words
                if (top.node, text) not in said:
                    said.add((top.node, text))
                    node.fresh += words
                node.linked += words * linked / total if total else 0
                out.append(Block(top.node, text, words, top.tag))
                if not top.kids or top.kids[-1] != "#":
                    top.kids.append("#")
            parts.clear()
        linked = total = 0

    at, n = 0, len(html)
    while at < n:
        m = _OPEN.search(html, at)
        upto = m.start() if m else n
        if upto > at:
            top = stack[-1]
            if not top.dropped:
                chunk = html[at:upto]
                parts.append(chunk)
                if not chunk.isspace():
                    total += len(chunk)
                    if top.link:
                        linked += len(chunk)
        if not m:
            break
        if m[3]:
            end = html.find("-->", upto + 2)
            if end < 0:
                break
            at = end + 3
            continue
        name = m[2]
        if name is None:
            end = html.find(">", m.end())
            if end < 0:
                break
            at = end + 1
            continue
        rest = _REST.match(html, m.end())
        if rest is None:
            break
        at = rest.end()
        tag = name.lower()
        if m[1]:
            if not opened.get(tag):
                if tag in BLOCKS:
                    flush()
                continue
            if tag in BLOCKS:
                flush()
            elif not _is_open(stack, tag):
                continue  # the end of an inline element doesn't reach beyond the block it is in
            while len(stack) > 1:
                gone = stack.pop().tag
                opened[gone] -= 1
                if gone == tag:
                    break
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in RAW:
            end = _END[tag].search(html, at)
            if end is None:
                break
            close = html.find(">", end.end())
            if close < 0:
                break
            at = close + 1
            continue
        block = tag in BLOCKS
        if block:
            flush()
            closing = CLOSES.get(tag, set()) | {"p"}
            found = next((i for i in range(_scope(stack, tag), len(stack)) if stack[i].tag in closing), None)
            if found is not None:
                for e in stack[found:]:
                    opened[e.tag] -= 1
                del stack[found:]
        top = stack[-1]
        signature, dropped, marked, part = tag, tag in DROPPED, False, tag in ("article", "main")
        if rest[1] and not rest[1].isspace():
            for a in _ATTRIBUTE.finditer(rest[1]):
                kind = a[1].lower()
                if kind not in ("class", "id", "role", "hidden", "style"):
                    continue
                value = (a[2] or a[3] or a[4] or "").lower()
                if kind == "role":
                    marked |= value in ROLES
                    part |= value in ("main", "article")
                    signature += f"@{value}"
                elif kind == "hidden":
                    dropped |= value in ("", "hidden")
                elif kind == "style":
                    dropped |= "display:none" in value.replace(" ", "")
                else:
                    tokens = sorted(set(value.split()))
                    signature += "".join(f"{'.' if kind == 'class' else '#'}{_DIGITS.sub('0', t)}" for t in tokens)
                    if tag not in ("body", "html") and (kind == "class" or tag in CONTAINERS):
                        marked |= any(map(is_marked, tokens))
        article = top.article or part
        opened[tag] = opened.get(tag, 0) + 1
        if not block:
            stack.append(Element(tag, top.node, top.dropped or dropped or (marked and not part), top.link or tag == "a", article, top.block))
            continue
        if dropped or top.dropped:
            stack.append(Element(tag, top.node, True, top.link, article, None))
            continue
        node = _key(top.node, signature)
        if not top.block.kids or top.block.kids[-1] != signature:
            top.block.kids.append(signature)
        element = Element(tag, node, False, top.link, article, None)
        if node not in nodes:
            role = not part and (marked or tag in ROLE_TAGS or (tag == "header" and not top.article))
            nodes[node] = Node(top.node, ARTICLE if part else ROLE if role else 1.0, (tag in CONTAINERS or role) and not part, tag == "h1", part, article)
        nodes[node].styles.append(element)
        stack.append(element)
    flush()
    return nodes, out


def _is_open(stack: list[Element], tag: str) -> bool:
    for e in reversed(stack):
        if e.tag == tag:
            return True
        if e.tag in SCOPES:
            break
    return False


def _scope(stack: list[Element], tag: str = "") -> int:
    """The first place above the innermost element that bounds the reach of implied ends (lists bound items, tables cells)."""
    for i in range(len(stack) - 1, 0, -1):
        held = stack[i].tag
        if held in SCOPES and not (held in ("td", "th") and tag in ("td", "th", "tr", "tbody", "tfoot", "thead")):
            return i + 1
    return 1


def style_of(node: Node) -> int:
    """The runs of children of a node's elements on a page, as a number."""
    runs: list[str] = []
    for e in node.styles:
        if (own := "\0".join(e.kids)) not in runs[-1:]:
            runs.append(own)
    return xxhash.xxh64_intdigest("\1".join(runs)) & _MASK


def page_print(blocks: list[Block]) -> int:
    """A number for what a page says: its long texts, or all of them where none is long."""
    texts = [b.text for b in blocks if b.words >= LONG] or [b.text for b in blocks]
    return xxhash.xxh64_intdigest("\n".join(texts)) & _MASK


def presentation(style_entropy: float, pages: float, parent_pages: float) -> float:
    """Bits of a node's styles and of its presence below its parent, one at most, beside unseen pages with other styles."""
    p = min(1.0, pages / max(parent_pages, 1.0))
    presence = -(p * math.log2(p) + (1 - p) * math.log2(1 - p)) if 0 < p < 1 else 0.0
    return (min(1.0, style_entropy + presence) * pages + UNSEEN) / (pages + UNSEEN)


class SiteTree:
    """What a page needs from the tree: pages, novel words and style entropy of nodes on several pages, and texts of low novelty."""

    __slots__ = ("nodes", "low_texts")

    def __init__(self, nodes: Mapping[int, tuple[float, float, float]] | None = None, low_texts: frozenset[int] = frozenset()):
        self.nodes, self.low_texts = {} if nodes is None else nodes, low_texts

    def with_more(self, nodes: dict[int, tuple[float, float, float]], low_texts: frozenset[int]) -> SiteTree:
        return SiteTree(ChainMap(nodes, self.nodes), self.low_texts | low_texts)  # type: ignore[arg-type]


_NO_SITE = SiteTree()


def importances(nodes: dict[int, Node], site: SiteTree = _NO_SITE, priors: bool = True) -> dict[int, float]:
    """Composite importance of every branch of a page by node, and, under the inverted bits of a node that holds an article, of its own text."""
    keys = list(nodes)
    weight = {k: x.weight for k, x in nodes.items()}
    if priors:
        branch_words, branch_linked = {k: x.words for k, x in nodes.items()}, {k: x.linked for k, x in nodes.items()}
        for k in reversed(keys[1:]):
            branch_words[nodes[k].parent] += branch_words[k]
            branch_linked[nodes[k].parent] += branch_linked[k]
        for k, x in nodes.items():
            if x.container and not x.article and branch_words[k] and branch_linked[k] >= MENU_SHARE * branch_words[k]:
                weight[k] = ROLE
    else:
        weight = {k: max(1.0, w) for k, w in weight.items()}
    novel = {k: site.nodes[k][1] if k in site.nodes else float(x.fresh) for k, x in nodes.items()}
    holds, heads = set(), set()
    for k in reversed(keys[1:]):
        x = nodes[k]
        novel[x.parent] += novel[k]
        if x.part or k in holds:
            holds.add(x.parent)
        if x.top or k in heads:
            heads.add(x.parent)
    # Of each node: its own text with what belongs to it, and the greatest of its branches.
    own, best = dict(novel), {}
    for k in keys[1:]:
        x = nodes[k]
        if x.container or x.part:
            own[x.parent] -= novel[k]
            # An element that calls itself something else is no measure for those beside it.
            best[x.parent] = max(best.get(x.parent, 0.0), novel[k] * (1.0 if k in holds else weight[k]))
    out = {}
    for k in keys[1:]:
        x = nodes[k]
        if not x.container or k in holds:
            continue
        if k in heads and weight[k] >= 1.0:
            continue
        most = max(own[x.parent], best[x.parent])
        content = min(1.0, novel[k] / most) if most > 0 else 1.0
        pages, _, entropy = site.nodes.get(k, (1.0, 0.0, 0.0))
        parent_pages = site.nodes[x.parent][0] if x.parent in site.nodes else pages
        out[k] = weight[k] * (content + (1 - content) * presentation(entropy, pages, max(parent_pages, pages)))
    for k in {nodes[c].parent for c in keys[1:] if nodes[c].part} - {nodes[c].parent for c in keys[1:] if nodes[c].top}:
        if own[k] > 0:
            out[~k] = own[k] / max(own[k], best[k])
    return out


def main_text(html: str | None, site: SiteTree = _NO_SITE, low: float = LOW, priors: bool = True) -> str:
    """A page's main text, a line for each block, less its low branches and texts."""
    nodes, blocks = parse(html)
    gone: set[int] = set()
    stray: set[int] = set()
    for k, value in importances(nodes, site, priors).items():
        if value < low:
            (gone if k >= 0 else stray).add(k if k >= 0 else ~k)
    removed: dict[int, bool] = {}
    for k, x in nodes.items():  # parents first
        removed[k] = k in gone or (x.parent is not None and (removed[x.parent] or (x.parent in stray and not x.container and not x.part)))
    kept = []
    for b in blocks:
        if removed[b.node] or b.node in stray:
            continue
        if text_key(b.node, b.text) in site.low_texts and not (b.tag in HEADINGS and nodes[b.node].article):
            continue
        kept.append(b.text)
    return "\n".join(kept)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))


# --- the tree over all pages ---------------------------------------------------------------------------------------

_COUNTS = "host long, node long, feature long, is_text boolean, pages long, words long, first long, last long, parent long"


def _count(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Of the pages of a task: how many have each style of a node and each text at a node, and the span of their prints."""
    seen: dict[tuple, list[int]] = {}

    def rows():
        keys, values = list(seen), list(seen.values())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        arrays = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
        arrays += [pa.array([v[i] for v in values], pa.int64()) for i in range(5)]
        seen.clear()
        return pa.RecordBatch.from_arrays(arrays, ["host", "node", "feature", "is_text", "pages", "words", "first", "last", "parent"])

    for batch in batches:
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            nodes, blocks = parse(html.as_py())
            own = page_print(blocks)
            found = {(host, k, style_of(x), False): (0, x.parent if x.parent is not None else -1) for k, x in nodes.items()}
            for b in blocks:
                found[host, b.node, text_key(b.node, b.text), True] = (b.words, -1)
            for key, (words, parent) in found.items():
                if (old := seen.get(key)) is None:
                    seen[key] = [1, words, own, own, parent]
                else:
                    old[0] += 1
                    old[2], old[3] = min(old[2], own), max(old[3], own)
        if len(seen) > most:
            yield rows()
    if seen:
        yield rows()


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged trees of all hosts, as two written tables: nodes (host, node, parent, pages, novel words that a page with the node can
    expect at it, style entropy in bits) and repeated texts (host, node, text, pages of the node, novelty).

    A text that only pages with one and the same main content have counts as on one page, so mirrored articles stay novel.
    """
    counts = pages.select(F.xxhash64(host_of(F.col("url"))).alias("host"), "html").mapInArrow(_count, _COUNTS)
    features = counts.groupBy("host", "node", "feature", "is_text").agg(F.sum("pages").alias("c"), F.max("words").alias("words"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("parent").alias("parent"))
    features = materialize(features.withColumn("distinct", F.when(F.col("first") == F.col("last"), 1).otherwise(F.col("c"))), "features")
    c, seen = F.col("c").cast("double"), F.col("distinct").cast("double")
    styles, texts = ~F.col("is_text"), F.col("is_text")
    sums = features.groupBy("host", "node").agg(
        F.sum(F.when(styles, c)).alias("pages"),
        F.sum(F.when(styles, c * F.log2(c))).alias("style_log"),
        F.sum(F.when(texts, c * F.col("words"))).alias("words"),
        F.sum(F.when(texts, c * F.col("words") * F.log(seen))).alias("word_log"),
        F.max(F.when(styles, F.col("parent"))).alias("parent"),
    )
    m = F.col("pages")
    nodes = sums.select(
        "host",
        "node",
        "parent",
        "pages",
        F.coalesce((F.col("words") - F.col("word_log") / F.log(m + UNSEEN)) / m, F.lit(0.0)).alias("novel"),
        F.greatest(F.lit(0.0), F.log2(m) - F.col("style_log") / m).alias("style_entropy"),
    )
    nodes = materialize(nodes, "nodes")
    again = features.where("is_text and distinct > 1").select("host", "node", F.col("feature").alias("text"), "distinct").join(nodes.select("host", "node", "pages"), ["host", "node"])
    repeated = materialize(again.select("host", "node", "text", "pages", (1 - F.log("distinct") / F.log(m + UNSEEN)).alias("novelty")), "texts")
    discard(features)
    return nodes, repeated


def site_lists(nodes: DataFrame, texts: DataFrame, low: float = LOW) -> tuple[DataFrame, DataFrame]:
    """Of each host with more than one page: its common nodes and their texts of low novelty as lists, with how many rare nodes it has; and, written,
    all nodes on more than one page (host, node, pages, novel, style_entropy, texts of low novelty, common), whose rare ones ``page_lists`` takes to their pages.

    A node is common when at least the square root of the host's pages have it, so a list has at most (nodes of a page) times that
    many; a text of low novelty is on almost all pages of its node, so there are hardly more of them than texts on a page.  All other nodes
    on more than one page are rare: fewer pages than that root have each.
    """
    hosts = nodes.where(F.col("node") == _ROOT).select("host", F.col("pages").alias("all")).where("all > 1")
    large = heavy_keys(nodes.groupBy("host").agg(F.count("*").alias("n")), "n", nodes.count())
    placed = spread_join(nodes.where("pages > 1"), hosts, ["host"], large, F.col("node"), "inner").withColumn("common", F.col("pages") * F.col("pages") >= F.col("all"))
    said = texts.where(F.col("novelty") < low).groupBy("host", "node").agg(F.collect_list("text").alias("texts"))
    placed = materialize(placed.join(said, ["host", "node"], "left"), "placed-nodes")
    common = placed.where("common").groupBy("host").agg(F.max("all").alias("all"), F.collect_list(F.struct("node", "pages", "novel", "style_entropy")).alias("nodes"), F.flatten(F.collect_list("texts")).alias("texts"))
    return common.join(placed.where("not common").groupBy("host").agg(F.count("*").alias("rare")), "host", "left"), placed


def _beside_lists(rows: DataFrame, lists: DataFrame, use, schema: str, heavy: DataFrame | None, small: bool) -> DataFrame:
    """``rows`` (``_rl_own``, the host, first) through ``use(batches, lists_of)``, where ``lists_of(host)`` has the host's common nodes and texts, or None.

    A ``small`` table of lists is sent to the workers once.  Otherwise rows are dealt by host, large hosts over salts, and each part's list comes once, before its rows.
    """
    if small:
        held = {r["_rl_host"]: (r["nodes"], r["texts"]) for r in lists.select("_rl_host", "nodes", "texts").collect()}
        held = {host: ([(x["node"], x["pages"], x["novel"], x["style_entropy"]) for x in nodes], texts or []) for host, (nodes, texts) in held.items()}
        shared = rows.sparkSession.sparkContext.broadcast(held)  # its size is checked by the caller
        return rows.mapInArrow(lambda batches: use(batches, lambda host: shared.value.get(host)), schema)
    names = rows.columns
    salt = F.lit(0) if heavy is None else F.coalesce(F.pmod(F.xxhash64(*names[1:3]), F.col("_rl_salts")), F.lit(0)).cast("int")
    salted = rows if heavy is None else rows.join(F.broadcast(heavy), "_rl_own", "left")  # at most 65,536 hosts
    dealt = salted.select(salt.alias("_rl_salt"), F.lit(1).alias("_rl_side"), *names, F.lit(None).cast("array<struct<node:bigint,pages:double,novel:double,style_entropy:double>>").alias("_rl_nodes"), F.lit(None).cast("array<bigint>").alias("_rl_texts"))
    named = lists.withColumnRenamed("_rl_host", "_rl_own")
    copies = named.withColumn("_rl_salt", F.lit(0)) if heavy is None else named.join(F.broadcast(heavy), "_rl_own", "left").withColumn("_rl_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_rl_salts", F.lit(1)) - 1)))
    first = copies.select("_rl_salt", F.lit(0).alias("_rl_side"), *(F.col("_rl_own") if n == "_rl_own" else F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in names), F.col("nodes").alias("_rl_nodes"), F.col("texts").alias("_rl_texts"))
    keyed = first.unionByName(dealt).repartition("_rl_own", "_rl_salt").sortWithinPartitions("_rl_own", "_rl_salt", "_rl_side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: dict[int, tuple] = {}

        def pages() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                side = batch.column(1).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(side[1:] != side[:-1]) + 1).tolist(), len(side)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    some = batch.slice(a, b - a)
                    if side[a] == 1:
                        yield some.select(names)
                        continue
                    here.clear()
                    for host, nodes, texts in zip(some.column("_rl_own").to_pylist(), some.column("_rl_nodes").to_pylist(), some.column("_rl_texts").to_pylist()):
                        here[host] = ([(x["node"], x["pages"], x["novel"], x["style_entropy"]) for x in nodes or ()], texts or [])

        yield from use(pages(), here.get)

    return keyed.mapInArrow(run, schema)


def _rare_of(batches: Iterator[pa.RecordBatch], lists_of) -> Iterator[pa.RecordBatch]:
    """The nodes of pages (host, page, html) that aren't among the common ones of their host."""
    last, known = None, frozenset()
    for batch in batches:
        found = set()
        for host, page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if host != last:
                last, known = host, frozenset(x[0] for x in (lists_of(host) or ((), ()))[0])
            found.update((host, page, k) for k in parse(html.as_py())[0] if k not in known)
        columns = list(zip(*found)) if found else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["host", "page", "node"])


def page_lists(pages: DataFrame, placed: DataFrame, lists: DataFrame, heavy: DataFrame | None = None, small: bool = True) -> DataFrame:
    """``_rl_own``, ``_rl_page`` (hash of the html) and the list ``more`` of the rare nodes of every page that has some.

    ``pages`` (_rl_own, _rl_page, html) are those of hosts with rare nodes.  Pages of a host with the same hash share a list; were their html
    different it would hold nodes of both, which changes neither.
    """
    has = _beside_lists(pages.select("_rl_own", "_rl_page", "html"), lists, _rare_of, "host long, page long, node long", heavy, small).distinct()
    met = has.join(placed.where("not common"), ["host", "node"]).groupBy(F.col("host").alias("_rl_own"), F.col("page").alias("_rl_page"))
    return met.agg(F.collect_list(F.struct("node", "pages", "novel", "style_entropy", "texts")).alias("more"))


def _extract(batches: Iterator[pa.RecordBatch], lists_of, low: float, priors: bool) -> Iterator[pa.RecordBatch]:
    """Rows (host, page_id, url, html, more)."""
    known: dict[int, SiteTree] = {}
    for batch in batches:
        texts = []
        for key, html, more in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4)):
            if key not in known:
                if len(known) > 256:
                    known.clear()
                nodes, low_texts = lists_of(key) or ((), ())
                known[key] = SiteTree({x[0]: x[1:] for x in nodes}, frozenset(low_texts))
            site = known[key]
            if rare := more.as_py():
                site = site.with_more({x["node"]: (x["pages"], x["novel"], x["style_entropy"]) for x in rare}, frozenset(t for x in rare for t in x["texts"] or ()))
            texts.append(main_text(html.as_py(), site, low, priors))
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_pages(pages: DataFrame, low: float = LOW, priors: bool = True, broadcast_bytes: int = BROADCAST_BYTES, salt_pages: int = SALT_PAGES) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every row of ``pages`` (page_id, url, html).

    A null html is the empty page and gives an empty text; pages without a host share one tree; rows that repeat are
    extracted each; other columns are not read.  An empty table gives an empty result.  Without ``priors`` the tree judges by entropies alone,
    blind to what tags, roles, classes and ids mean (but for articles and headings).
    """
    bound_batches(pages.sparkSession)
    nodes, texts = style_tree(pages)
    lists, placed = site_lists(nodes, texts, low)
    lists = materialize(lists.withColumnRenamed("host", "_rl_host"), "site-lists")
    discard(nodes)
    discard(texts)
    size, n_rare = lists.agg(F.sum(64 + 32 * F.size("nodes") + 8 * F.size("texts")), F.sum("rare")).collect()[0]
    own = pages.select(F.xxhash64(host_of(F.col("url"))).alias("_rl_own"), F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64("html").alias("_rl_page"))
    small = (size or 0) <= broadcast_bytes
    heavy = None if small else heavy_keys(lists.select(F.col("_rl_host").alias("_rl_own"), F.col("all").cast("long").alias("n")), "n", pages.count(), salt_pages)
    if n_rare:
        mixed = own.join(lists.where("rare > 0").select(F.col("_rl_host").alias("_rl_own")), "_rl_own", "left_semi")
        more = materialize(page_lists(mixed, placed, lists, heavy, small), "page-lists")
        size = more.agg(F.sum(64 + F.aggregate("more", F.lit(0).cast("long"), lambda n, x: n + 48 + 8 * F.coalesce(F.size(x["texts"]), F.lit(0))))).collect()[0][0] or 0
        page = ["_rl_own", "_rl_page"]
        if size <= broadcast_bytes:
            joined = own.join(F.broadcast(more), page, "left")
        else:
            copies = own.groupBy(*page).agg(F.count("*").alias("n"))
            joined = spread_join(own, more, page, heavy_keys(copies, "n", pages.count(), salt_pages), F.xxhash64("page_id", "url"))
    else:
        joined = own.withColumn("more", F.lit(None).cast("array<struct<node:long,pages:double,novel:double,style_entropy:double,texts:array<long>>>"))
    discard(placed)
    rows = joined.select("_rl_own", "page_id", "url", "html", "more")
    return _beside_lists(rows, lists, partial(_extract, low=low, priors=priors), "page_id long, url string, text string", heavy, small)


__all__ = ["extract_pages", "importances", "main_text", "page_lists", "parse", "site_lists", "style_tree"]
