"""Main text of web pages by wrapper induction.

Pages of one host come from one template.  A few pages of each host are parsed into trees, runs of like
siblings folded into one node, and the trees aligned pairwise by simple tree matching.  Nodes whose own text
is the same on all aligned pages are template, the others are slots; the wrapper of the host is the path to
the deepest node that holds all slots and, inside an article or main part, all paragraphs and headings, and
the constant texts beside it.  Every page of the
host is then read through its wrapper: blocks below that node, in page order, without what the template says
and without parts that name themselves as something else (menus, sidebars, adverts, comments, forms).  A name
gives way where the pages show that the part holds their articles (``misnamed``).

Null and empty pages have an empty text.  A page where the wrapper's node is missing, or whose host has no
other page, is read from its own article, main part or body.  Pages without a host share one.  Rows that
share an id are read one by one.  The wrapper is learned from a bounded number of pages a host; every page
is read whole.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Collection, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardweave.llm.shared import pieces, stored

#: Pages aligned per host.
ALIGNED = 8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|noscript|svg|iframe|textarea|select|object|canvas|title)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[a-z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
#: Blocks that carry running text; their text is content wherever the wrapper leads, repeated or not.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt figcaption tr".split())
#: Paragraphs and headings; lists and tables may be menus.
SPEECH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
#: What articles are made of, whatever their headings.
PARAGRAPHS = frozenset("p blockquote pre".split())
#: A part is content against its name if it holds this many times the paragraphs of all other content.
OVERRULED = 4
#: Longest pattern of siblings whose repetitions are one when trees are aligned.
PERIOD = 8
#: Siblings of a node that are aligned in their order; the work for two nodes grows with its square.
WIDE = 256
#: An opening tag ends an open element of these names in the same container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
APART_TAGS = frozenset("nav aside footer form dialog button head menu search input label".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
APART_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup share sharing social related recommended comment comments reply replies disqus respond pagination pager widget toolbar login".split()
)
COMMENT_NAMES = frozenset("comment comments reply replies".split())


class Node:
    __slots__ = ("tag", "names", "apart", "named", "children")

    def __init__(self, tag: str, names: str = "", apart: bool = False, named: bool = False):
        # apart: not content; named: by its class or id alone, which the pages of the host may overrule
        self.tag, self.names, self.apart, self.named, self.children = tag, names, apart or named, named and not apart, []

    @property
    def sign(self) -> str:
        return f"{self.tag}.{self.names}" if self.names else self.tag


def _opened(tag: str, raw: str, inside: bool, within: str) -> Node:
    """``inside``: an article or main part is open, whose header is its own; ``within``: the tag around this one."""
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw else {}
    words = _NAME.findall(f"{values.get('class', '')} {values.get('id', '')}".lower())
    names = " ".join(w for w in words if not w.isdigit())
    apart = (tag in APART_TAGS and not (tag == "label" and within in SPEECH)) or (tag == "header" and not inside)
    apart |= values.get("role", "").lower() in APART_ROLES
    named = False
    if tag not in ("html", "body", "main"):
        apart |= bool(COMMENT_NAMES.intersection(words))
        named = tag != "article" and bool(APART_NAMES.intersection(words))
        named |= "header" in words and not inside and tag in ("div", "section")
    apart |= values.get("aria-hidden", "").lower() == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
    apart |= bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", re.sub(_ATTRIBUTE, "", raw).lower())) if "hidden" in raw.lower() else False
    return Node(tag, names, apart, named)


def parse(page: str) -> Node:
    """A tree of elements and texts; scripts, styles and comments are gone, unclosed elements end with their parent."""
    root = Node("#")
    stack, within = [root], [False]  # beside each open element: is it, or is it in, an article or main part
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                # an inline end tag does not close the block around it
                if stack[k].tag in BLOCKS and tag not in BLOCKS:
                    break
            continue
        if tag in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCKS:
                    break
        if tag in ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ENDS[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        del within[len(stack) :]
        node = _opened(tag, m[4], within[-1], stack[-1].tag)
        stack[-1].children.append(node)
        if tag not in VOID and not m[4].endswith("/"):
            stack.append(node)
            within.append(within[-1] or tag in ("article", "main"))
    if at < len(page):
        stack[-1].children.append(html.unescape(page[at:]))
    _reopened(root)
    return root


def _reopened(root: Node) -> None:
    """A part set apart that holds the article was not closed in time: the article stays."""
    order, parents = [root], {id(root): None}
    for node in order:
        for c in node.children:
            if isinstance(c, Node):
                parents[id(c)] = node
                order.append(c)
    for node in order:
        if node.tag in ("article", "main") and not node.apart:
            up = parents[id(node)]
            while up is not None:
                if up.tag != "article":
                    up.apart = False
                up = parents[id(up)]


def _prose(nodes: list[Node], named: bool) -> int:
    """Length of the paragraphs below nodes; parts set apart do not count, those set apart by name only if ``named``."""
    total, todo = 0, [(n, False) for n in nodes]
    while todo:
        node, speaks = todo.pop()
        for c in node.children:
            if isinstance(c, str):
                total += len(c.strip()) if speaks else 0
            elif not c.apart or (named and c.named):
                todo.append((c, speaks or c.tag in PARAGRAPHS))
    return total


def _set_apart(root: Node) -> list[Node]:
    """The topmost parts that are apart by name alone."""
    found, todo = [], [root]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Node):
                if c.named and c.apart:
                    found.append(c)
                elif not c.apart:
                    todo.append(c)
    return found


def _reopen(root: Node, signs: Collection[str]) -> None:
    todo = [root]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Node):
                if c.named and c.sign in signs:
                    c.apart = False
                todo.append(c)


def misnamed(roots: list[Node]) -> list[str]:
    """Signs of parts whose names set them apart although they hold the host's articles; they are reopened in ``roots``.

    A name gives way where the part holds ``OVERRULED`` times the paragraphs that all other content of these pages
    has, and differs from page to page.  Parts of readers' comments stay apart.
    """
    signs: list[str] = []
    while True:
        rest = sum(_prose([r], False) for r in roots)
        held: dict[str, int] = {}
        texts: dict[str, set[str]] = {}
        for root in roots:
            for node in _set_apart(root):
                held[node.sign] = held.get(node.sign, 0) + _prose([node], True)
                texts.setdefault(node.sign, set()).add("\n".join(_said(node)))
        best = max(sorted(held), key=lambda s: held[s], default=None)
        if best is None or held[best] <= OVERRULED * rest or (len(roots) > 1 and len(texts[best]) < 2):
            return signs
        signs.append(best)
        for root in roots:
            _reopen(root, (best,))


def _said(node: Node) -> list[str]:
    out, todo = [], [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, str):
                out.append(c)
            else:
                todo.append(c)
    return out


class Shape:
    """A folded tree: runs of like siblings are one node with all their texts."""

    __slots__ = ("sign", "tag", "text", "mass", "children", "pages", "constant")

    def __init__(self, sign: str, tag: str, text: str, children: list[Shape]):
        self.sign, self.tag, self.text, self.children = sign, tag, text, children
        self.mass = len(text) + sum(c.mass for c in children)
        self.pages, self.constant = 1, True


def _repeated(runs: list[list[Node]]) -> None:
    """Joins the last siblings to those before if both show the same pattern of signs."""
    for period in range(1, min(PERIOD, len(runs) // 2) + 1):
        if all(runs[-k][0].sign == runs[-k - period][0].sign for k in range(1, period + 1)):
            for k in range(1, period + 1):
                runs[-k - period] += runs[-k]
            del runs[-period:]
            return


def fold(nodes: list[Node]) -> Shape:
    """A pattern of siblings that is repeated at once is one; of more than ``WIDE`` that remain, those of a sign are."""
    top = Shape(nodes[0].sign, nodes[0].tag, "", [])
    order = [(top, nodes)]
    for shape, alike in order:
        own, runs = [], []
        for node in alike:
            for c in node.children:
                if isinstance(c, str):
                    own.append(c)
                elif not c.apart:
                    runs.append([c])
                    _repeated(runs)
        if len(runs) > WIDE:
            kinds: dict[str, list[Node]] = {}
            for run in runs:
                kinds.setdefault(run[0].sign, []).extend(run)
            runs = list(kinds.values())
        shape.text = " ".join(" ".join(own).split())
        shape.children = [Shape(r[0].sign, r[0].tag, "", []) for r in runs]
        order += zip(shape.children, runs)
    for shape, _ in reversed(order):
        shape.mass = len(shape.text) + sum(c.mass for c in shape.children)
    return top


def _all(top: Shape) -> list[Shape]:
    """Every node, parents before their children."""
    order = [top]
    for s in order:
        order += s.children
    return order


def _matched(a: Shape, b: Shape):
    """Matches two nodes of equal sign; yields the pairs of children it needs matched, returns the number of pairs and their tree."""
    n, m = len(a.children), len(b.children)
    score = [[0] * (m + 1) for _ in range(n + 1)]
    pairs: dict[tuple[int, int], tuple[int, list]] = {}
    for i, c in enumerate(a.children):
        for j, d in enumerate(b.children):
            own = 0
            if c.sign == d.sign:
                pairs[i, j] = yield c, d
                own = pairs[i, j][0]
            score[i + 1][j + 1] = max(score[i][j + 1], score[i + 1][j], score[i][j] + own)
    found, i, j = [(a, b)], n, m
    while i and j:
        if score[i][j] == score[i - 1][j]:
            i -= 1
        elif score[i][j] == score[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append(pairs[i, j][1])
    return score[n][m] + 1, found


def tree_matching(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Simple tree matching: the largest number of node pairs of equal sign that keep order and ancestry."""
    if a.sign != b.sign:
        return 0, []
    stack, value = [_matched(a, b)], None
    while stack:
        try:
            stack.append(_matched(*stack[-1].send(value)))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    score, tree = value
    todo, found = [tree], []
    while todo:
        pair, *below = todo.pop()
        found.append(pair)
        todo += below
    return score, found


def _below(where: str, sign: str) -> str:
    """The place of a child: a digest, so that places deep in a tree are no longer than others."""
    return hashlib.blake2b(f"{where}/{sign}".encode(), digest_size=12).hexdigest()


def _speech(top: Shape) -> dict[int, int]:
    """Length of the paragraphs and headings in every node."""
    said: dict[int, int] = {}
    for s in reversed(_all(top)):
        said[id(s)] = s.mass if s.tag in SPEECH else sum(said[id(c)] for c in s.children)
    return said


def induce(pages: list[str]) -> dict:
    """The wrapper of a host: the path to the content and the texts that are the same on all pages."""
    roots = [parse(p) for p in pages]
    opened = misnamed(roots)
    if len(roots) < 2:
        return {"path": [], "constant": [], "opened": opened}
    shapes = [fold([r]) for r in roots]
    template = max(shapes, key=lambda s: s.mass)
    varying: dict[int, int] = {}
    for other in shapes:
        if other is template:
            continue
        pairs = tree_matching(template, other)[1]
        known, said = {id(b) for _, b in pairs}, _speech(other)
        for a, b in pairs:
            a.pages += 1
            if a.text != b.text:
                a.constant = False
                varying[id(a)] = varying.get(id(a), 0) + len(b.text) + len(a.text)
            # what the template page lacks is a slot of the node around it
            more = sum(said[id(c)] for c in b.children if id(c) not in known)
            if more:
                varying[id(a)] = varying.get(id(a), 0) + more

    order = _all(template)
    mass: dict[int, int] = {}
    for s in reversed(order):
        own = varying.get(id(s), 0) or (len(s.text) if s.pages < len(shapes) else 0)
        mass[id(s)] = own + sum(mass[id(c)] for c in s.children)

    said = _speech(template)
    path, here, inside = [], template, False
    while True:
        inside |= here.tag in ("article", "main")
        total = mass[id(here)]
        down = max((c for c in here.children if c.tag not in PROSE and c.tag in BLOCKS), key=lambda c: mass[id(c)], default=None)
        if down is None or not total or mass[id(down)] < total:
            break
        # paragraphs and headings that repeat are content beside a slot, unless the site says them around its articles
        if said[id(down)] < said[id(here)] * (1 if inside else 0.5):
            break
        path.append(down.sign)
        here = down
    constant: list[str] = []

    place = {id(template): _below("", template.sign)}
    for s in order:
        for c in s.children:
            place[id(c)] = _below(place[id(s)], c.sign)
        if s.constant and s.pages == len(shapes) and s.text and s.tag in BLOCKS and s.tag not in PROSE:
            constant.append(f"{place[id(s)]}\t{s.text}")
    return {"path": path, "constant": constant, "opened": opened}


def _at(root: Node, path: list[str]) -> list[Node]:
    nodes = [root]
    for sign in path:
        nodes = [c for n in nodes for c in n.children if isinstance(c, Node) and c.sign == sign and not c.apart]
    return nodes


def _first(root: Node) -> list[Node]:
    """The articles of a page, or its main part, or its body, or all of it."""
    for tag in ("article", "main", "body"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.tag == tag and not node.apart:
                found.append(node)
            else:
                todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.apart]
        if found:
            return found
    return [root]


def blocks(nodes: list[Node], where: str, constant: frozenset[str]) -> list[str]:
    """Texts of the blocks below ``nodes``, white space made one space."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    def enter(node: Node, where: str) -> tuple[Iterator, str, bool, bool]:
        skip = False
        if constant:
            where = _below(where, node.sign)
            if node.tag in BLOCKS and node.tag not in PROSE:
                own = " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())
                skip = bool(own) and f"{where}\t{own}" in constant
        block = node.tag in BLOCKS
        if block:
            end()
        return iter(node.children), where, skip, block

    def walk(node: Node, where: str) -> None:
        todo = [enter(node, where)]
        while todo:
            children, at, skip, block = todo[-1]
            for c in children:
                if isinstance(c, str):
                    if not skip:
                        line.append(c)
                elif not c.apart:
                    if c.tag == "br" or c.tag in ("td", "th"):
                        line.append(" ")
                    todo.append(enter(c, at))
                    break
            else:
                todo.pop()
                if block:
                    end()

    for node in nodes:
        walk(node, where)
        end()
    return out


def read(page: str, wrapper: dict) -> str:
    """Main text of a page through its host's wrapper."""
    root = parse(page)
    if "opened" in wrapper:
        _reopen(root, wrapper["opened"])
    else:
        misnamed([root])
    path = wrapper["path"]
    nodes = _at(root, path) if path else []
    if nodes:
        where = ""
        for sign in ["#", *path[:-1]]:
            where = _below(where, sign)
        return "\n".join(blocks(nodes, where, frozenset(wrapper["constant"])))
    return "\n".join(blocks(_first(root), "", frozenset()))


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) learned from at most about ``ALIGNED`` pages of a host."""

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        few = group.sort_values(["draw", "html"]).drop_duplicates("html").head(ALIGNED)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(induce(list(few["html"])))]})

    rows = pages.where("length(html) > 0").select(host_of().alias("host"), "html", F.xxhash64("html").alias("page"))
    rows = rows.withColumn("draw", F.pmod("page", F.lit(1 << 30)))
    # copies of a page count once, or a host of few pages in many copies would send none
    sizes = rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("n"))
    # four times as many as needed pass by hash, so a host of any size sends a few pages
    some = rows.join(stored(sizes, "hosts"), "host").where(F.col("draw") < F.lit(float(1 << 30)) * 4 * ALIGNED / F.col("n"))
    some = some.dropDuplicates(["host", "page"])
    return stored(some.select("host", "html", "draw").groupBy("host").applyInPandas(learn, "host string, wrapper string"), "wrappers")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict] = {None: {"path": [], "constant": []}}
        for batch in pieces(batches, column="html"):
            texts = []
            for page, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if wrapper not in known:
                    if len(known) > 1000:
                        known = {None: known[None]}
                    known[wrapper] = json.loads(wrapper)
                texts.append(read(page, known[wrapper]) if page else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html", host_of().alias("host")).join(wrappers(pages), "host", "left")
    return rows.select("page_id", "url", "html", "wrapper").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
