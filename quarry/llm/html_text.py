"""Main text of web pages by wrapper induction.

1. Each page is parsed into blocks of text, each at a node of the page's *outline*: its
   DOM tree of block elements in which siblings with the same tag, class and id are one
   node (a list of any length is one repeated node).
2. Pages of one host are aligned. The most frequent outline of the host is its reference;
   every other outline is matched with it by simple tree matching (Yang 1991). Matched
   nodes are one *slot* of the wrapper, unmatched ones are slots of their own. Outlines
   are few, so this is done once per distinct outline, not per page.
3. Over all pages of the host, a block whose text is the same in its slot on at least half
   of the distinct pages that have the slot (and on ``MIN_PAGES``) is template, whatever its
   tags and names. What varies is content.
4. A page's text is its content blocks; if the page has an ``article`` or ``main`` element,
   those inside it, otherwise those that are not mostly links. Boilerplate that varies, or
   stands on too few pages (adverts, notices, comments of readers, menus of a small host), is
   left out by the fixed lists of tags, roles and names below. The result says how many
   blocks of a page were template (``n_template``) and how many others the lists left out
   (``n_listed``); ``lists=False`` leaves it to the wrapper alone.
5. A name is a whole class or id. It never counts around the main text: not on ``main``, not
   around the only ``article`` text of a page, and not on an element that holds
   ``AROUND_SHARE`` of the varying text of its host. The tags ``form`` and ``noscript`` are
   judged like such a name, as some sites put the whole page into one.

Counts are aggregations over (host, slot, text), so a host with a third of all pages is
spread over all tasks. Pages with the same blocks outside the lists count once, so that a text
copied over many pages of a host is not taken for template.

Edge cases: a null or empty page has no text; a null url is a host of its own; repeated
rows give equal rows; a null page id is kept; an empty table gives an empty result; extra
columns are ignored, whatever their names; broken and cut-off markup is read as far as it
goes, nested to any depth, and a quote mark opens a value directly after ``=`` only; pages of
any length are read whole; of outlines that are equally frequent on a host the greatest is its
reference.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.frames import col, map_arrow
from quarry.plans.broadcast import small_side
from quarry.session import materialize, scratch_path

MIN_PAGES, CONSTANT_SHARE, LINK_SHARE, AROUND_SHARE = 5, 0.5, 0.5, 0.9

# Element kinds of HTML, and names that mark boilerplate.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option
p pre search section select summary table tbody td tfoot th thead tr ul""".split())
RAW = set("script style textarea title template svg iframe noembed noframes xmp canvas object video audio math".split())
DROP_TAGS = set("head nav footer aside button select option menu dialog fieldset search".split())
WRAP_TAGS = set("form noscript".split())
DROP_NAMES = set("""nav navbar navigation menu breadcrumb breadcrumbs sidebar footer ad ads adv advert adverts
advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert
popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment
comments reply replies respond disqus discussion pagination pager widget toolbar copyright skip
main-nav main-menu main-navigation site-nav site-navigation nav-bar nav-menu nav-links navigation-menu top-nav side-nav
side-bar site-footer page-footer footer-links footer-nav ad-banner ad-container ad-slot cookie-notice cookie-banner
cookie-consent cookie-bar cookie-popup gdpr-banner consent-banner site-notice newsletter-signup newsletter-form signup-form
subscribe-form login-form share-buttons share-bar share-links social-links social-share social-media social-icons
related-posts related-articles related-links recommended-posts comment-list comment-form comments-area comments-section
comment-section post-comments disqus-thread skip-link skip-links""".split())
HEAD_NAMES = set("header masthead topbar site-header page-header top-bar".split())
READER_NAMES = set("""comment comments reply replies respond disqus discussion comment-list comment-form comments-area
comments-section comment-section post-comments disqus-thread""".split())
DROP_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())

# a start tag of one of these closes an open element of the set
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
SCOPES = set("ul ol dl table select".split())
CLOSES_P = BLOCK - set("td th tr tbody thead tfoot li dt dd option body html head caption summary legend figcaption button".split())

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
_MARKUP = re.compile(rf"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+)*+)>"""
                     r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""", re.DOTALL)
_ATTR = re.compile(rf"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE}))?+""")
_NAME = re.compile(r"[a-z]+")


class _Node:
    __slots__ = ("label", "depth", "number", "children")

    def __init__(self, label: str, depth: int, number: int):
        self.label, self.depth, self.number, self.children = label, depth, number, {}


class Page:
    """One page as read, with the fixed lists or without (``lists``).

    ``outline``: (depth, label) of each node in preorder of first appearance;
    ``blocks``: (node, text, characters in links, is boilerplate, is in the main part);
    ``around``: for each block that only a name makes boilerplate and that may yet be main
    text on its host, the outermost node with the name, otherwise -1."""

    def __init__(self, source: str, lists: bool = True):
        self._lists = lists
        self.nodes: list[_Node] = []
        self.blocks: list[tuple[int, str, int, bool, bool]] = []
        root = self._node(None, "#root")
        self.around: list[int] = []
        self._reader: set[int] = set()
        self._wrap: set[int] = set()
        # open elements: (tag, node, boilerplate, in the main part, outermost node with a name of boilerplate)
        self._stack: list[tuple[str, _Node, bool, bool, int]] = [("#root", root, False, False, -1)]
        self._text: list[str] = []
        self._links = self._in_link = 0
        self._read(source)
        self._order()

    def _node(self, parent: _Node | None, label: str) -> _Node:
        if parent is not None and label in parent.children:
            return parent.children[label]
        node = _Node(label, parent.depth + 1 if parent else 0, len(self.nodes))
        self.nodes.append(node)
        if parent is not None:
            parent.children[label] = node
        return node

    def _order(self) -> None:
        """Number the nodes in preorder."""
        order, todo = [], [self.nodes[0]]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += reversed(node.children.values())
        place = {node.number: i for i, node in enumerate(order)} | {-1: -1}
        self._judge()
        self.blocks = [(place[b[0]], *b[1:]) for b in self.blocks]
        self.around = [place[a] for a in self.around]
        self.outline = [(node.depth, node.label) for node in order]

    def _judge(self) -> None:
        """Boilerplate by name: not the only article text of the page, if that is longer than
        what stands outside such names (an article of a reader's comment is never that). A
        page without an article leaves it to its host."""
        inside = [(a, main and not drop, len(text) - links) for (_, text, links, drop, main), a in zip(self.blocks, self.around, strict=True)]
        has_main = any(main and a < 0 for a, main, _ in inside)
        rest = sum(n for (a, _, n), b in zip(inside, self.blocks, strict=True) if a < 0 and not b[3])
        lifted = [main and a in self._wrap for a, main, _ in inside]
        if not any(lifted):
            lifted = [main and a not in self._reader for a, main, _ in inside]
        lift = not has_main and sum(n for (_, _, n), x in zip(inside, lifted, strict=True) if x) > rest
        for i, (node, text, links, drop, main) in enumerate(self.blocks):
            a = self.around[i]
            if a >= 0 and not drop:
                if lift and lifted[i]:
                    self.around[i] = -1
                elif has_main or lift or main:
                    self.blocks[i] = (node, text, links, True, main)
            if self.blocks[i][3]:
                self.around[i] = -1

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                _, node, drop, main, around = self._stack[-1]
                self.blocks.append((node.number, text, min(self._links, len(text)), drop, main))
                self.around.append(around)
            self._text, self._links = [], 0

    def _say(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            self._text.append(text)
            if self._in_link:
                self._links += len(" ".join(text.split()))

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = _MARKUP.search(source, at)
            if m is None:
                self._say(source[at:])
                break
            self._say(source[at:m.start()])
            at = m.end()
            close, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if name is None:
                continue
            tag = name.lower()
            if close:
                self._close(tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
                at = end.end() if end else n
            else:
                self._open(tag, attrs)
        self._flush()

    def _open(self, tag: str, attrs: str) -> None:
        if tag not in BLOCK:
            if tag == "br":
                self._text.append(" ")
            elif tag == "a":
                self._in_link = 1
            return
        self._flush()
        if tag == "hr":
            return
        self._in_link = 0
        if tag in CLOSES_P:
            self._pop_open({"p"}, BLOCK - {"p"})
        if tag in CLOSES:
            self._pop_open(CLOSES[tag], SCOPES)
        _, parent, drop, main, around = self._stack[-1]
        names, label, role = set(), tag, ""
        if attrs and "=" in attrs or "hidden" in attrs:
            found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attrs)}
            own = f"{found.get('class', '')} {found.get('id', '')}".lower()
            names = set(own.replace("_", "-").split())
            runs = _NAME.findall(own)
            label = f"{tag}.{'.'.join(dict.fromkeys(runs))}" if runs else tag
            role = found.get("role", "").lower()
            drop = drop or self._lists and (role in DROP_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or bool(
                re.search(r"display\s*:\s*none", found.get("style", ""), re.IGNORECASE)))
            main = main or role == "main"
        if tag in ("article", "main") and not drop:
            main = True
        node = self._node(parent, label)
        if self._lists and tag not in ("html", "body"):
            drop = drop or tag in DROP_TAGS or not main and tag == "header"
            named = names & DROP_NAMES or not main and names & HEAD_NAMES
            # a name inside a form or noscript counts for itself
            if (named and (around < 0 or around in self._wrap) or tag in WRAP_TAGS and around < 0) and tag != "main" and role != "main":
                around = node.number
                if not named:
                    self._wrap.add(around)
                if names & READER_NAMES:
                    self._reader.add(around)
        self._stack.append((tag, node, drop, main, around))

    def _pop_open(self, tags: set, scope: set) -> None:
        """Close the innermost open element of ``tags``, unless one of ``scope`` is inside."""
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in tags:
                del self._stack[i:]
                self._pop_open(tags, scope)
                return
            if self._stack[i][0] in scope:
                return

    def _close(self, tag: str) -> None:
        if tag not in BLOCK:
            if tag == "a":
                self._in_link = 0
            return
        self._flush()
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == tag:
                del self._stack[i:]
                break


# -- alignment -----------------------------------------------------------------

def _tree(outline: list[tuple[int, str]]) -> list[list[int]]:
    """Children of each node."""
    children, path = [[] for _ in outline], []
    for i, (depth, _) in enumerate(outline):
        del path[depth:]
        if path:
            children[path[-1]].append(i)
        path.append(i)
    return children


def match_trees(a: list[tuple[int, str]], b: list[tuple[int, str]]) -> dict[int, int]:
    """Simple tree matching: the largest mapping of nodes of ``a`` to nodes of ``b`` that
    keeps labels, parents and the order of siblings."""
    ca, cb = _tree(a), _tree(b)
    weight: dict[tuple[int, int], int] = {}

    def table(i: int, j: int) -> list[list[int]]:
        x, y = ca[i], cb[j]
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p in range(1, len(x) + 1):
            for q in range(1, len(y) + 1):
                m[p][q] = max(m[p - 1][q], m[p][q - 1], m[p - 1][q - 1] + weight.get((x[p - 1], y[q - 1]), 0))
        return m

    # pairs of equal depth and label below pairs of such, parents first; filled from the bottom
    pairs = [(0, 0)] if a and b and a[0][1] == b[0][1] else []
    for i, j in pairs:
        pairs += [(x, y) for x in ca[i] for y in cb[j] if a[x][1] == b[y][1]]
    for i, j in reversed(pairs):
        weight[i, j] = 1 + table(i, j)[-1][-1]

    found, todo = {}, pairs[:1]
    while todo:
        i, j = todo.pop()
        found[i] = j
        x, y, m = ca[i], cb[j], table(i, j)
        p, q = len(x), len(y)
        while p and q:
            if m[p][q] == m[p - 1][q]:
                p -= 1
            elif m[p][q] == m[p][q - 1]:
                q -= 1
            else:
                p, q = p - 1, q - 1
                todo.append((x[p], y[q]))
    return found


def dump(outline: list[tuple[int, str]]) -> str:
    return "\n".join(f"{depth} {label}" for depth, label in outline)


def load(text: str) -> list[tuple[int, str]]:
    return [(int(d), label) for d, _, label in (line.partition(" ") for line in text.split("\n"))]


def slots(outline: list[tuple[int, str]], reference: list[tuple[int, str]]) -> list[str]:
    """The slot of every node: the number of its match in the reference, or a digest of its
    path (of fixed length, however deep the node is)."""
    found = match_trees(outline, reference)
    path, out = [], []
    for i, (depth, label) in enumerate(outline):
        del path[depth:]
        path.append(hashlib.blake2b((path[-1] if path else b"") + label.encode("utf-8", "surrogatepass"), digest_size=12).digest())
        out.append(str(found[i]) if i in found else path[-1].hex())
    return out


# -- jobs ----------------------------------------------------------------------

_PARSED = ("page_id long, url string, host string, outline string, "
           "blocks array<struct<node:int,text:string,hash:long,links:int,main:boolean,around:int>>")
_BLOCK = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string()), ("hash", pa.int64()), ("links", pa.int32()), ("main", pa.bool_()),
                            ("around", pa.int32())]))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def parse(pages: DataFrame, id_col: str, url_col: str, html_col: str, lists: bool = True) -> DataFrame:
    """Each page's outline and its blocks, written once (the markup is not read again). A block
    that the lists leave out has a hash only, its text is null."""
    def make() -> Callable:
        def fn(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                hosts, outlines, blocks = [], [], []
                for url, source in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    page = Page(source or "", lists)
                    hosts.append(host_of(url))
                    outlines.append(dump(page.outline))
                    blocks.append([{"node": n, "text": None if dropped else t, "hash": _hash(t), "links": k, "main": m, "around": a}
                                   for (n, t, k, dropped, m), a in zip(page.blocks, page.around, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(hosts), pa.array(outlines), pa.array(blocks, _BLOCK)],
                    names=["page_id", "url", "host", "outline", "blocks"])
        return fn
    spark, path = pages.sparkSession, scratch_path(pages.sparkSession, "pages-parsed")
    map_arrow(pages.select(col(id_col).cast("bigint").alias("page_id"), col(url_col).alias("url"), col(html_col).alias("html")),
              make, _PARSED).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def align(parsed: DataFrame) -> DataFrame:
    """(host, outline, slots): every distinct outline matched with its host's reference."""
    seen = parsed.groupBy("host", "outline").agg(F.count(F.lit(1)).alias("n"))
    reference = seen.groupBy("host").agg(F.max_by("outline", F.struct("n", "outline")).alias("reference"))

    def make() -> Callable:
        def fn(batch: pa.RecordBatch):
            host, outline, reference = (batch.column(i) for i in range(3))
            found = [slots(load(o), load(r)) for o, r in zip(outline.to_pylist(), reference.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([host, outline, pa.array(found, pa.list_(pa.string()))], names=["host", "outline", "slots"])
        return fn
    return map_arrow(seen.join(reference, "host").select("host", "outline", "reference"), make,
                     "host string, outline string, slots array<string>")


def _key(slot, hash) -> Column:
    return F.xxhash64(slot, hash)


def templates(placed: DataFrame) -> DataFrame:
    """(host, constant, around): keys of (slot, hash) of template blocks, and the slots of
    elements whose name does not count, as they hold the main text of the host."""
    listed_not = F.filter("blocks", lambda b: b["text"].isNotNull())
    placed = placed.select("host", "blocks", F.xxhash64(F.transform(listed_not, lambda b: b["hash"])).alias("page"))
    blocks = placed.select("host", "page", F.explode("blocks").alias("b")).select(
        "host", "page", F.col("b.slot").alias("slot"), F.col("b.hash").alias("hash"), F.col("b.around").alias("around"),
        F.when(F.col("b.links") <= LINK_SHARE * F.length("b.text"), F.length("b.text")).otherwise(0).alias("chars"))
    per_text = (blocks.groupBy("host", "slot", "hash", "page").agg(F.lit(1).alias("one")).groupBy("host", "slot", "hash")
                      .agg(F.count(F.lit(1)).alias("n")))
    # a host may have several layouts: the share is of the pages that have the slot
    n_pages = blocks.groupBy("host", "slot", "page").agg(F.lit(1).alias("one")).groupBy("host", "slot").agg(F.count(F.lit(1)).alias("pages"))
    keys = per_text.where(f"n >= {MIN_PAGES}").join(n_pages, ["host", "slot"]).where(F.col("n") >= CONSTANT_SHARE * F.col("pages"))
    constant = keys.groupBy("host").agg(F.collect_list(_key("slot", "hash")).alias("constant"))
    # only hosts with named elements whose pages have no article
    named = blocks.where("around IS NOT NULL").select("host").distinct()
    varying = (blocks.where("chars > 0").join(named, "host", "left_semi").groupBy("host", "around", "slot", "hash").agg(F.sum("chars").alias("chars"))
                     .join(keys.select("host", "slot", "hash"), ["host", "slot", "hash"], "left_anti")
                     .groupBy("host", "around").agg(F.sum("chars").alias("chars")))
    around = (varying.groupBy("host").agg(F.max_by("around", F.struct("chars", "around")).alias("around"), F.max("chars").alias("most"), F.sum("chars").alias("chars"))
                     .where(F.col("around").isNotNull() & (F.col("most") > 0) & (F.col("most") >= AROUND_SHARE * F.col("chars")))
                     .select("host", "around"))
    return constant.join(around, "host", "full")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", lists: bool = True) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars``, ``n_template`` (its blocks
    that are template of the host) and ``n_listed`` (others that the fixed lists left out)."""
    parsed = parse(pages, id_col, url_col, html_col, lists)
    outlines = small_side(materialize(align(parsed), "outlines"), "outlines")
    placed = parsed.join(outlines, ["host", "outline"]).select(
        "page_id", "url", "host",
        F.transform("blocks", lambda b: b.withField("slot", F.xxhash64(F.element_at("slots", b["node"] + 1)))
                    .withField("around", F.when(b["around"] >= 0, F.get("slots", b["around"])))).alias("blocks"))
    template = small_side(materialize(templates(placed), "templates"), "templates")
    constant = F.coalesce("constant", F.array().cast("array<bigint>"))

    def judged(b):
        named = b["around"].isNotNull() & ~F.coalesce(b["around"] == F.col("kept_around"), F.lit(False))
        return F.struct(b["text"].alias("text"), b["main"].alias("main"), (b["links"] > LINK_SHARE * F.length(b["text"])).alias("linked"),
                        F.array_contains(constant, _key(b["slot"], b["hash"])).alias("template"), (b["text"].isNull() | named).alias("listed"))

    blocks = placed.join(template.withColumnRenamed("around", "kept_around"), "host", "left").select(
        "page_id", "url", F.transform("blocks", judged).alias("blocks"))
    has_main = F.exists("blocks", lambda b: b["main"] & b["text"].isNotNull())
    content = blocks.withColumn("has_main", has_main).withColumn("content", F.filter(
        "blocks", lambda b: ~b["template"] & ~b["listed"] & F.when(F.col("has_main"), b["main"]).otherwise(b["main"] | ~b["linked"])))
    text = F.array_join(F.transform("content", lambda b: b["text"]), "\n")
    counts = [F.size(F.filter("blocks", lambda b: b["template"])).cast("bigint").alias("n_template"),
              F.size(F.filter("blocks", lambda b: ~b["template"] & b["listed"])).cast("bigint").alias("n_listed")]
    return content.select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"), *counts)
