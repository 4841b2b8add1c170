"""Main text of web pages by a site style tree.

The element trees of a host's pages are merged: a node of the site's tree is the path of tags and classes from the root,
with the presentation styles (sequences of child elements) and the features that its pages have there: the words of a
short text, a longer text as a whole. A feature seen on n of the m pages that have the node has entropy log n / log m
(m taken as BASE at least, so a few pages prove little). A node's importance is

    (1 - GAMMA^l) * entropy of its l presentation styles + GAMMA^l * importance of what is below,

where the nodes below count by their own importance (presentation and features) and length; words in links count LINK.
A node's worth is that importance of what is below times its length, summed over the host's pages.

Two rules cut branches. From the root down, a box (div, list, section ...) with less than SIDE of the worth of its
worthiest sibling is cut, if that one has DOMINANT of the worth of all; this ends at a node of whose worth HOLDER or
more is text and paragraphs, not boxes: the main content. And a branch is cut if it and all below it are less important
than LOW. Not cut by that are html, body, the worthiest of siblings above the main content, an article or main and what
holds one, in an article elements without a class, and in it and the main content branches of which VARIED of the text or
more is on one page only (else a host's many copies speak for its unique pages); nor any in an article that would lose over half of its
text, or on a page that would lose all.

Only the tree decides on the pages of a host that has more than one. A page that is its host's only one (or of no host) has
nothing to be compared with; there, and everywhere with names=True, elements whose tag or class names what they are (NOISE) have no importance. Names
never cut html or body. An article or main and what holds one is not cut by a word about a state (has-sidebar,
comments-open), nor as a form or header, and outside an article by no word at all if the page has no other article; no
number cuts what holds an article.

What remains is the text of the article elements (by names), or of the body if there are none: character references are decoded,
white space inside a block becomes one space, blocks are joined by a line's end.

Nulls: a null html gives an empty text; a page without a url belongs to no host and is cut by names alone. Repeated rows
count and are returned each. An empty table gives an empty result. Other columns are ignored unless kept.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, with_fields, written

GAMMA, LOW, BASE, VARIED = 0.9, 0.3, 8, 0.02
SIDE, DOMINANT, HOLDER = 0.2, 0.5, 0.5
#: Words of a text that is told apart by its words, and the weight of words in links (a quarter, so weights are whole numbers).
SHORT, LINK = 24, 4
#: Hosts whose paths a task remembers at once.
HOSTS = 256
#: Elements without visible text, and those that are boxes of a page's layout (fixed values).
UNSEEN = frozenset("script style noscript template head title svg canvas iframe object embed audio video".split())
BOXES = frozenset("html body div section nav footer aside header form main article ul ol dl table center fieldset dialog menu".split())
#: Elements that are never the article's text, and words that say so in a class, id or role (fixed values).
NOISE_TAGS = frozenset("nav footer aside form script style noscript iframe button select option input textarea label svg canvas template dialog object embed audio video head title menu".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs footer sidebar side-bar widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay comment comments reply replies discussion disqus respond related recommended share sharing social newsletter subscribe subscription login signup search pagination pager toolbar masthead topbar skip hidden".split()
)
MAIN = frozenset(("article", "main"))
#: Beside a noise word these tell a state of the element, not what it is; the tags may stand round a whole page.
STATES = frozenset("has have with no not without open opened closed enabled disabled on off".split())
ROUND = frozenset(("form", "header"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A new one of these ends an open paragraph; list items, cells and the like end one of their own kind.
ENDS_P = BLOCKS - frozenset(("html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"))
OWN_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|textarea|title|noscript|template)\b[^>]*>.*?(?:</\1\s*>|$)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "sig", "path", "noise", "named", "parts", "main", "inner", "holds", "link")

    def __init__(self, tag: str, sig: str, path: int, noise: bool, named: bool, main: bool, inner: bool, link: bool):
        # link: is or is in one; noise by the tag or a word, named by a word that tells no state; main: is or is in one; inner: is below an article; holds: is or has an article or main below
        self.tag, self.sig, self.path, self.noise, self.named, self.main, self.inner = tag, sig, path, noise, named, main, inner
        self.holds, self.link = main and tag in MAIN, link
        self.parts: list[Node | str] = []


def parse(page: str, names: bool = True) -> Node:
    """The element tree; unknown ends are ignored, and what is left open ends with its parent. Without names no tag or word tells noise or an article."""
    root = Node("", "", 0, False, False, False, False, False)
    stack, at = [root], 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = m[4]
        if m[2]:
            stack[-1].parts.append(m[2].replace("&", "&amp;"))
        if not tag:
            continue
        tag = tag.lower()
        if m[3]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in MAIN or (tag not in BLOCKS and stack[k].tag in BLOCKS):
                    break
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCKS:
                    break
        if ends := OWN_KIND.get(tag):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        sig, words, up = tag, (), stack[-1]
        if m[5] and (named := NAMES.findall(m[5])):
            words = [w for _, v in named for w in re.split(r"[\s\"']+", v.lower()) if w]
            sig = tag + "." + ".".join(sorted(re.sub(r"\d+", "0", w) for w in words))
        said = [w for w in words if names and (w in NOISE_WORDS or any(x in NOISE_WORDS for x in re.split(r"[-_:]", w)))]
        noise = tag in UNSEEN or (names and (tag in NOISE_TAGS or (tag == "header" and not up.main))) or bool(said)
        named = any(STATES.isdisjoint(re.split(r"[-_:]", w)) for w in said)
        node = Node(tag, sig, xxhash.xxh64_intdigest(f"{up.path}/{sig}") >> 1, noise, named, names and (up.main or tag in MAIN), names and (up.inner or up.tag == "article"), up.link or tag == "a")
        for x in reversed(stack) if node.holds else ():
            if x.holds:
                break
            x.holds = True
        up.parts.append(node)
        if tag not in VOID and not m[5].endswith("/"):
            stack.append(node)
    if at < len(page):
        stack[-1].parts.append(page[at:])
    return root


def plain(text: str) -> str:
    return SPACE.sub(" ", entities.unescape(text)).strip()


def feature(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def tree_rows(page: str, names: bool = True) -> tuple[set, Counter, set]:
    """Of one page: (path, style, parent, box) of its elements, weight by (path, feature), and (path, path above or same).

    Left out is what has no visible text or is noise by name. A weight is LINK a character, one in links.
    """
    styles, texts, above = set(), Counter(), set()
    stack = [(parse(page, names), ())]
    while stack:
        node, up = stack.pop()
        own = [x for x in node.parts if isinstance(x, str)]
        inner = [x for x in node.parts if not isinstance(x, str) and (x.holds or not x.noise)]
        here = (*up, node.path) if node.tag else up
        if node.tag:
            sigs = [x.sig for k, x in enumerate(inner) if not k or inner[k - 1].sig != x.sig]
            styles.add((node.path, feature(" ".join(sigs)), up[-1] if up else 0, node.tag in BOXES))
            above.update((node.path, x) for x in here)
            if own and (text := plain(" ".join(own))):
                words, weight = text.split(" "), 1 if node.link else LINK
                for x in words if len(words) <= SHORT else (text,):
                    texts[node.path, feature(x)] += weight * len(x)
        stack += [(x, here) for x in inner]
    return styles, texts, above


def noisy(root: Node, low: frozenset[int], side: frozenset[int]) -> set[int]:
    """Identities of the elements that numbers cut: those in side, and those that are in low with all below; ~path stands for a varied one, low outside articles only."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.parts if not isinstance(x, str)]
    out: set[int] = set()
    for node in reversed(order):
        if node.holds:
            continue
        if node.path in side and not node.main:
            out.add(id(node))
        elif (node.path in low or (not node.main and ~node.path in low)) and all(isinstance(x, str) or x.noise or id(x) in out for x in node.parts):
            out.add(id(node))
    return out


def main_text(page: str | None, low: frozenset[int] = frozenset(), side: frozenset[int] = frozenset(), names: bool = True) -> str:
    """The blocks of the page's article; low and side: paths of the branches to cut."""
    if not page:
        return ""
    root = parse(page, names)
    numbers = noisy(root, low, side) if low or side else frozenset()

    def by_name(node: Node, any_word: bool) -> bool:
        if node.tag in ("html", "body"):
            return False
        if not node.holds:
            return node.noise
        if node.tag in UNSEEN | NOISE_TAGS and node.tag not in ROUND:
            return True
        return node.named and (node.inner or not any_word)

    def articles(any_word: bool) -> list[Node]:
        found, stack = [], [root]
        while stack:
            n = stack.pop()
            for x in reversed(n.parts):
                if not isinstance(x, str) and x.holds and not by_name(x, any_word):
                    stack.append(x)
            if n.tag in MAIN:
                found.append(n)
        return found

    tops, any_word = articles(False), False
    if not tops and root.holds:
        tops, any_word = articles(True), True
    if any(n.tag == "article" for n in tops):
        tops = [n for n in tops if n.tag == "article"]

    def text_of(tops: list[Node], numbers) -> tuple[str, bool]:
        seen, blocks, line, hit = set(), [], [], False

        def end():
            if text := plain("".join(line)):
                blocks.append(text)
            line.clear()

        for top in tops:
            if id(top) in seen:  # stands inside one that is done
                continue
            end()
            stack: list = [top]
            while stack:
                x = stack.pop()
                if x is None:
                    end()
                elif isinstance(x, str):
                    line.append(x)
                else:
                    seen.add(id(x))
                    if x.tag == "br":
                        line.append(" ")
                    block = x.tag in BLOCKS
                    if block:
                        end()
                        stack.append(None)
                    for y in reversed(x.parts):
                        if isinstance(y, str):
                            stack.append(y)
                        elif by_name(y, any_word):
                            continue
                        elif id(y) in numbers and y.tag not in ("html", "body") and not (x.main and y.sig == y.tag):
                            hit = True
                        else:
                            stack.append(y)
        end()
        return "\n".join(blocks), hit

    text, hit = text_of(tops or [root], numbers)
    if hit:
        whole = text_of(tops or [root], frozenset())[0]
        if not text or (tops and 2 * len(text) < len(whole)):
            return whole
    return text


def host_of(url: str = "url"):
    host = F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))
    return F.when(host != "", host)


def style_tree(pages: DataFrame, names: bool = True) -> DataFrame:
    """host, path, pages, importance, own (share of the text that is on one page only), side and lead of the nodes of the hosts' merged trees; pages (url, html).

    side: a box that falls behind its worthiest sibling above the main content; lead: that sibling, and what is varied in it.
    """
    chosen = pages.select(host_of().alias("host"), "html").where("host is not null and html is not null")

    def run(batches):
        for batch in batches:  # summed for a batch before it is dealt out
            counts: Counter = Counter()
            for host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                styles, texts, above = tree_rows(page, names)
                counts.update((host, 0, path, x, int(box), up) for path, x, up, box in styles)
                for (path, x), weight in texts.items():
                    counts[host, 1, path, x, weight, 0] += 1
                counts.update((host, 2, path, x, 0, 0) for path, x in above)
            cells = list(zip(*counts, strict=True)) if counts else [[]] * 6
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cells, types)), pa.array(list(counts.values()), pa.int64())], names=["host", "kind", "path", "x", "weight", "up", "n"])

    rows = chosen.mapInArrow(run, "host string, kind int, path long, x long, weight long, up long, n long")
    # a node, and a feature of a node, is a partial sum however many pages of the host have it
    rows = written(rows.groupBy("host", "kind", "path", "x").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("weight")).alias("weight"), F.max("weight").alias("box"), F.max("up").alias("up")), "style-rows")
    here, clip = ["host", "path"], lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    styles = rows.where("kind = 0").groupBy(*here).agg(F.sum("n").alias("pages"), F.count("*").alias("l"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.max("up").alias("up"), (F.max("box") > 0).alias("box"))
    log_m = F.log(F.greatest("pages", F.lit(BASE)))
    nodes = styles.select(*here, "pages", "up", "box", F.pow(F.lit(GAMMA), F.col("l")).alias("gamma"), clip((F.log("pages") - F.col("nlogn") / F.col("pages")) / log_m).alias("presentation"))
    nodes = written(nodes, "style-nodes")  # one row a node of a site, not a page
    texts = rows.where("kind = 1").join(nodes.select(*here, "pages", "gamma", "presentation"), here)
    news = clip(1 - F.log("n") / log_m)
    leaves = texts.groupBy(*here).agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * news).alias("news"), F.sum(F.when(F.col("n") == 1, F.col("weight")).otherwise(0)).alias("own"), F.any_value("gamma").alias("gamma"), F.any_value("presentation").alias("presentation"))
    worth = (1 - F.col("gamma")) * F.col("presentation") * F.col("weight") + F.col("gamma") * F.col("news")
    leaves = leaves.select(*here, "weight", "own", worth.alias("worth"))
    above = rows.where("kind = 2").select(*here, F.col("x").alias("node"))
    below = leaves.join(above, here).groupBy("host", F.col("node").alias("path")).agg(*(F.sum(c).alias(c) for c in ("weight", "own", "worth")))
    tree = nodes.join(below, here, "left").join(leaves.select(*here, F.col("worth").alias("text")), here, "left").fillna(0, ["weight", "own", "worth", "text"])
    tree = written(tree, "style-tree")
    family = tree.groupBy("host", "up").agg(F.max("worth").alias("top"), F.sum("worth").alias("all"), F.sum(F.when(F.col("box"), 0.0).otherwise(F.col("worth"))).alias("plain"))
    held = tree.join(family.select("host", F.col("up").alias("path"), "plain"), here, "left")
    holders = held.where(F.col("text") + F.coalesce("plain", F.lit(0.0)) >= HOLDER * F.col("worth")).select("host", F.col("path").alias("node"))
    inside = above.where("path <> node").join(holders, ["host", "node"]).select(*here).distinct().withColumn("inside", F.lit(True))
    judged = tree.join(family, ["host", "up"]).join(inside, here, "left").withColumn("outside", F.col("inside").isNull() & (F.col("top") >= DOMINANT * F.col("all")) & (F.col("top") > 0))
    importance = (1 - F.col("gamma")) * F.col("presentation") + F.col("gamma") * F.when(F.col("weight") > 0, F.col("worth") / F.col("weight")).otherwise(0.0)
    own = F.when(F.col("weight") > 0, F.col("own") / F.col("weight")).otherwise(0.0)
    return judged.select(*here, "pages", importance.alias("importance"), own.alias("own"), (F.col("outside") & F.col("box") & (F.col("worth") < SIDE * F.col("top"))).alias("side"), ((F.col("outside") & (F.col("worth") == F.col("top"))) | (F.col("inside").isNotNull() & (own >= VARIED))).alias("lead"))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), names: bool | None = None) -> DataFrame:
    """keep and `text`, the main text, of each row of pages (url, html); a kept column named text gives way.

    names: whether names decide beside the tree; None: the tree alone decides, and names only for a page that is the only one of its host.
    """
    path = F.when(F.col("own") < VARIED, F.col("path")).otherwise(F.bitwise_not("path"))
    low = (F.col("importance") < LOW) & ~F.col("lead")
    cut = style_tree(pages, bool(names)).where(low | F.col("side")).groupBy("host").agg(F.collect_list(F.when(low & ~F.col("side"), path)).alias("__low"), F.collect_list(F.when(F.col("side"), F.col("path"))).alias("__side"))
    hosts = pages.select(host_of().alias("host")).where("host is not null").groupBy("host").count().where("count > 1").select("host")
    cut = written(hosts.join(cut, "host", "left" if names is None else "full_outer").withColumnRenamed("host", "__host"), "style-cuts")
    chosen = pages.select(*(c for c in keep if c != "text"), host_of().alias("__of"), F.col("html").alias("__html"))
    joined = chosen.join(sized(cut, ("__low", "__side")), F.col("__of") == F.col("__host"), "left").drop("__of")  # else AQE splits a hot host
    joined = joined.select(*joined.columns[:-3], "__low", "__side", "__host")
    fields = with_fields(joined.schema.fields[:-4], "text string")

    def run(batches):
        sets: dict = {}  # paths of the task's hosts
        for batch in batches:
            html, lows, sides, hosts = (batch.column(batch.num_columns - k) for k in (4, 3, 2, 1))
            out = []
            for k, host in enumerate(hosts.to_pylist()):
                if host not in sets:
                    if len(sets) >= HOSTS:
                        sets.clear()
                    sets[host] = tuple(frozenset(x[k].as_py() or ()) for x in (lows, sides))
                out.append(main_text(html[k].as_py(), *sets[host], host is None if names is None else names))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], pa.array(out, pa.string())], names=[*batch.schema.names[:-4], "text"])

    return joined.mapInArrow(run, fields)
