"""HTML extraction by wrapper induction.

Every page is parsed once. Pages of one site, which is a host and the tags that lead
to the article, are reduced to trees of their block elements, repeated neighbours
folded into one node, and aligned by simple tree matching: the largest set of node
pairs that keeps labels, order and parents. Aligned trees merge into one template per
site. Equal trees are counted before anything is merged, tasks merge what they read,
and their templates merge in rounds of bounded fan-in, so a host with a third of all
pages is spread like any other.

Aligned against its template, every block of a page lies in a slot. Texts that most
pages of a site have in the same slot belong to the template, where near copies of
one article count as one page; what varies is content. The lists of names below only
find the element that holds the article and break ties: inside it a part that may or
may not belong, such as one named for sharing or a notice, stays where the template
sees its text vary, and follows the lists where too few pages tell.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from metricweave.llm.arrow import pieces
from metricweave.llm.columns import quoted
from metricweave.llm.dom import BLOCK, Node, blocks, parse
from metricweave.llm.urls import host_of
from metricweave.session import drop_scratch, store

#: Templates merged by one task at once.
FAN_IN = 32
#: A text is constant in a slot of a site if more than 2 of 3 pages have it, of this many at least.
CONSTANT, OF, PAGES = 2, 3, 5
#: Texts on more than one in SHARE pages of a slot tell copies; a page's vote is counted in parts.
SHARE, VOTE = 16, 720_720 << 16
#: Templates and alignments a worker remembers.
REMEMBERED = 10_000

#: Elements and roles that hold no article text.
APART = frozenset("nav aside footer form button select option menu dialog search fieldset".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Words in class and id that name such parts.
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner sidebar "
    "aside widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar toolbar comment "
    "comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login search social share sharing related recommended "
    "recommendations pagination pager skip copyright disclaimer paywall feedback poll form".split()
)
#: Those of them that also name parts of an article; there they are doubtful.
DOUBTFUL_WORDS = frozenset(
    "widget widgets menu nav toolbar masthead discussion notice notices alert popup modal overlay social share sharing related "
    "recommended recommendations skip copyright disclaimer feedback poll form banner foot search topbar".split()
)
#: Doubtful words which, as the whole name of a part, decide while too few pages tell.
TIE_WORDS = DOUBTFUL_WORDS - frozenset("alert form skip discussion search foot".split())
#: Words that name a short notice of another article.
TEASER_WORDS = frozenset("teaser card".split())
HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
#: Marks of a block: a heading; doubtful, and staying or going where no template tells; no part of the article.
HEADING, MAY_STAY, MAY_GO, GOES = 1, 2, 4, 8
HEAD_WORDS = frozenset("header head".split())
ARTICLE_WORDS = frozenset("article entry post story content main body text".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")

Tree = list  # [label, pages, children]


def names(node: Node) -> set[str]:
    own = node.attributes
    found = f"{own.get('class', '')} {own.get('id', '')}"
    return {w.lower() for w in _WORDS.findall(found)} if found != " " else set()


def label(node: Node) -> str:
    """What two nodes must share to be aligned: element, class and id, without numbers."""
    own = node.attributes
    if not own:
        return node.tag
    return _DIGITS.sub("#", f"{node.tag}.{own.get('class', '')}#{own.get('id', '')}")


def skeleton(root: Node) -> Tree:
    """Block elements only; equal neighbours become one node with the children of all.

    Every element of the page remembers the number of its node, in pre-order.
    """
    tree: Tree = ["#root", 1, []]
    members: dict[int, list[Node]] = {}
    stack = [(tree, [root])]
    while stack:
        into, nodes = stack.pop()
        members[id(into)] = nodes
        groups: list[tuple[Tree, list[Node]]] = []
        for node in nodes:
            for child in _block_children(node):
                name = label(child)
                if groups and groups[-1][0][0] == name:
                    groups[-1][1].append(child)
                else:
                    groups.append(([name, 1, []], [child]))
        # the same kind again after others, from a neighbour that was folded in
        folded: dict[str, int] = {}
        if len(nodes) > 1:
            kept: list[tuple[Tree, list[Node]]] = []
            for own, inside in groups:
                if own[0] in folded:
                    kept[folded[own[0]]][1].extend(inside)
                else:
                    folded[own[0]] = len(kept)
                    kept.append((own, inside))
            groups = kept
        into[2].extend(own for own, _ in groups)
        stack.extend(groups)
    for number, node in enumerate(_preorder(tree)):
        for member in members[id(node)]:
            member.place = number
    return tree


def _block_children(node: Node) -> Iterator[Node]:
    """The nearest block elements below, through inline ones."""
    stack = list(reversed(list(node.children())))
    while stack:
        child = stack.pop()
        if child.tag in BLOCK:
            yield child
        else:
            stack.extend(reversed(list(child.children())))


def _preorder(tree: Tree) -> Iterator[Tree]:
    stack = [tree]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(node[2]))


def match(a: Tree, b: Tree, known: dict | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the number of pairs, and the aligned children of both roots.

    ``known`` gets the answer for every pair of nodes that was compared.
    """
    known = {} if known is None else known
    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        key = (id(x), id(y))
        if key not in known:
            if x[0] != y[0]:
                known[key] = 0, []
            else:
                alike = [(i, j) for i, p in enumerate(x[2]) for j, q in enumerate(y[2]) if p[0] == q[0]]
                open_ = [(x[2][i], y[2][j]) for i, j in alike if (id(x[2][i]), id(y[2][j])) not in known]
                if open_:
                    stack.extend(open_)
                    continue
                weights = {(i, j): known[id(x[2][i]), id(y[2][j])][0] for i, j in alike}
                known[key] = _aligned(len(x[2]), len(y[2]), weights)
        stack.pop()
    return known[id(a), id(b)]


def _aligned(rows: int, columns: int, weights: dict[tuple[int, int], int]) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest set of pairs in order, and its weight plus the parents' own pair."""
    best = [[0] * (columns + 1) for _ in range(rows + 1)]
    for i in range(rows):
        for j in range(columns):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weights.get((i, j), 0))
    pairs, i, j = [], rows, columns
    while i and j:
        if (i - 1, j - 1) in weights and best[i][j] == best[i - 1][j - 1] + weights[i - 1, j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[rows][columns] + 1, pairs[::-1]


def merge(a: Tree, b: Tree) -> Tree:
    """Both trees in one: aligned nodes add their pages, the others stand beside them."""
    known: dict = {}
    match(a, b, known)
    root: Tree = [a[0], a[1] + b[1], []]
    stack = [(a, b, root)]
    while stack:
        x, y, into = stack.pop()
        own = at = 0
        for i, j in known[id(x), id(y)][1]:
            both = [x[2][i][0], x[2][i][1] + y[2][j][1], []]
            into[2] += x[2][own:i] + y[2][at:j] + [both]
            stack.append((x[2][i], y[2][j], both))
            own, at = i + 1, j + 1
        into[2] += x[2][own:] + y[2][at:]
    return root


def write_tree(tree: Tree) -> str:
    """A tree as flat text: label, pages and number of children of each node, in pre-order."""
    return json.dumps([[node[0], node[1], len(node[2])] for node in _preorder(tree)])


def read_tree(text: str) -> Tree:
    root: Tree = ["", 0, []]
    stack = [(root, 1)]
    for label_, pages, count in json.loads(text):
        while stack[-1][1] == len(stack[-1][0][2]):
            stack.pop()
        node: Tree = [label_, pages, []]
        stack[-1][0][2].append(node)
        stack.append((node, count))
    return root[2][0]


def align(template: Tree, page: Tree) -> dict[int, int]:
    """Number of a page's node to the number of the template's node, both in pre-order."""
    numbers = {id(node): k for k, node in enumerate(_preorder(template))}
    own = {id(node): k for k, node in enumerate(_preorder(page))}
    known: dict = {}
    found, stack = {}, [(template, page)]
    while stack:
        x, y = stack.pop()
        found[own[id(y)]] = numbers[id(x)]
        stack.extend((x[2][i], y[2][j]) for i, j in match(x, y, known)[1])
    return found


def _plainly_apart(node: Node) -> bool:
    """Whether element, role or style put a part beside any article."""
    if node.tag in APART:
        return True
    own = node.attributes
    if not own:
        return False
    return (
        own.get("role", "").lower() in APART_ROLES
        or "hidden" in own
        or own.get("aria-hidden", "").lower() == "true"
        or "display:none" in own.get("style", "").replace(" ", "").lower()
    )


class _Page:
    """The blocks of a page, and what its elements hold."""

    def __init__(self, root: Node):
        self.blocks = list(blocks(root))
        self.text: Counter = Counter()
        self.linked: Counter = Counter()
        #: elements that hold the page's title or its main part, and those that hold an ``article``
        self.titled: set[int] = set()
        self.holding: set[int] = set()
        self.doubts: dict[int, int] = {}
        self.named = True
        for node, text, linked in self.blocks:
            self.text[id(node)] += len(text)
            self.linked[id(node)] += linked
        for node in reversed(list(root.walk())):
            outer = node.parent
            if outer is None:
                break
            self.text[id(outer)] += self.text[id(node)]
            self.linked[id(outer)] += self.linked[id(node)]
            if node.tag in ("h1", "main") or id(node) in self.titled:
                self.titled.add(id(outer))
            if node.tag == "article" or id(node) in self.holding:
                self.holding.add(id(outer))
        self.all = self.text[id(root)]

    def wraps(self, node: Node) -> bool:
        """Whether an element named like a part beside the article holds the page itself."""
        if self.titled:
            return id(node) in self.titled
        return id(node) in self.holding and 2 * self.text[id(node)] > self.all

    def beside(self, node: Node, in_home: bool) -> bool:
        """Whether an element is a part beside the article, by its names too."""
        if _plainly_apart(node):
            return True
        if node.tag in ("html", "body", "main") or not self.named:
            return False
        words = names(node) if node.attributes else set()
        if words & APART_WORDS:
            return not self.wraps(node)
        return (node.tag == "header" or bool(words & HEAD_WORDS)) and not in_home and not words & ARTICLE_WORDS

    def doubt(self, node: Node) -> int:
        """Whether an element inside the article may be no part of it: 0, or a mark."""
        words = names(node) & DOUBTFUL_WORDS if node.attributes else set()
        if not words or self.wraps(node):
            return 0
        if 2 * self.linked[id(node)] > self.text[id(node)]:
            return GOES
        own = f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".lower().split()
        return MAY_GO if any(name in TIE_WORDS for name in own) else MAY_STAY

    def mark(self, node: Node, home: Node | None) -> int:
        """A block's own mark, and the doubts of the elements around it up to its home."""
        own = HEADING if node.tag in HEADINGS else 0
        chain = []
        while node is not None and node is not home and id(node) not in self.doubts:
            chain.append(node)
            node = node.parent
        found = self.doubts.get(id(node), 0) if node is not None and node is not home else 0
        for inner in reversed(chain):
            found |= self.doubt(inner) if home is not None else 0
            self.doubts[id(inner)] = found
        return own | found

    def teaser(self, node: Node) -> bool:
        """Whether an ``article`` is a short notice of another one: its heading is a link, or its name says so."""
        if names(node) & (TEASER_WORDS | APART_WORDS):
            return True
        links = [a for a in node.walk() if a.tag == "a" and "".join(x for y in a.walk() for x in y.items if isinstance(x, str)).strip()]
        heads = {id(h) for h in node.walk() if h.tag in HEADINGS or h.tag == "h1"}
        for link in links:
            while link is not node:
                if id(link) in heads:
                    return True
                link = link.parent
        return False


def article_blocks(root: Node) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """``element, text, mark`` of every block of the article, and the elements that hold it.

    A home is an outermost ``article``; without one an outermost ``main``, or an
    outermost element named for content; homes in a part beside the article are none.
    The article is the home with most text, with all homes of its kind that stand
    beside it or bear its label, and the ``h1`` of a content element around it. Where a
    ``main`` has more text of its own than its ``article`` elements have, it is the
    home, without those that announce other articles, and without all of them if they
    have less than half its text. Without any home it is the whole page,
    where blocks that are nearly all links, and paragraphs of nothing else, go too.

    Inside the article only elements, roles and names that never belong to one put a
    block aside; other such names give it a mark, and the template decides. Where
    names leave nothing of a page that has an ``article`` or ``main``, they do not count.
    """
    page = _Page(root)
    found = _by_homes(page)
    if not found[0] and page.blocks and any(n.tag in ("article", "main") for n in root.walk()):
        page.named = False
        found = _by_homes(page)
    return found


def _by_homes(page: _Page) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    rank = {"article": 2, "main": 1}
    seen: dict[int, tuple[bool, Node | None, Node | None]] = {}

    def judge(node: Node | None) -> tuple[bool, Node | None, Node | None]:
        """Whether the node is beside the article, its home, and the content element around that."""
        chain = []
        while node is not None and id(node) not in seen:
            chain.append(node)
            node = node.parent
        beside, home, around = seen[id(node)] if node is not None else (False, None, None)
        for own in reversed(chain):
            if not beside:
                likely = own.tag in rank or own.tag in ("div", "section", "td") and bool(names(own) & ARTICLE_WORDS)
                beside = page.beside(own, home is not None)
                if beside and home is not None:
                    # inside an article a doubtful name does not decide, unless for a part that holds other articles
                    beside = own.tag == "article" or likely and home.tag != "article" or id(own) in page.holding or _never(own)
                if likely and not beside and (home is None or rank.get(own.tag, 0) > rank.get(home.tag, 0)):
                    home, around = own, around or home or own
            seen[id(own)] = beside, home, around
        return beside, home, around

    def _never(own: Node) -> bool:
        if _plainly_apart(own):
            return True
        return bool(names(own) & (APART_WORDS - DOUBTFUL_WORDS)) and not page.wraps(own)

    kept, size, told = [], Counter(), Counter()
    homes: dict[int, Node] = {}
    for node, text, linked in page.blocks:
        beside, home, _ = judge(node)
        if beside:
            continue
        kept.append((node, text, linked, home))
        if home is not None:
            homes[id(home)] = home
            size[id(home)] += len(text)
            told[id(home)] += len(text) if node.tag not in HEADINGS and node.tag != "h1" else 0
    if not homes:
        return [(n, t, page.mark(n, None)) for n, t, k, _ in kept if k * 5 < len(t) * 4 or n.tag == "p" and k < len(t)], []
    best = max(homes.values(), key=lambda h: (rank.get(h.tag, 0), size[id(h)]))
    # a main whose own text outweighs the articles in it
    inside: dict[int, list[Node]] = {}
    for home in homes.values():
        outer = home.parent
        while outer is not None and outer.tag != "main":
            outer = outer.parent
        if home.tag == "article" and outer is not None and id(outer) in homes:
            inside.setdefault(id(outer), []).append(home)
    wide = [homes[m] for m, parts in inside.items() if told[m] > sum(size[id(p)] for p in parts)]
    alike = lambda h: rank.get(h.tag, 0) == rank.get(best.tag, 0) and (h.parent is best.parent or label(h) == label(best))
    if wide and best.tag == "article" and any(best in inside[id(m)] for m in wide):
        main = next(m for m in wide if best in inside[id(m)])
        parts = inside[id(main)]
        small = 2 * sum(size[id(p)] for p in parts) <= told[id(main)]
        chosen = {id(main)} | {id(p) for p in parts if not small and not page.teaser(p)}
        best = main
    else:
        chosen = {id(h) for h in homes.values() if alike(h)}
    around = judge(best)[2]

    def heads(node: Node) -> bool:
        return node.tag == "h1" and judge(node)[2] is around

    found = [(n, t, page.mark(n, home)) for n, t, k, home in kept if home is not None and (id(home) in chosen or heads(n))]
    return found, [best]


def site_path(homes: list[Node]) -> str:
    """The tags that lead to the article; pages of one layout share them."""
    tags, node = [], homes[0] if homes else None
    while node is not None:
        tags.append(node.tag)
        node = node.parent
    return "/".join(reversed(tags))


def text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


class _Wrappers:
    """Templates read from their text form, and alignments by the shape of a page."""

    def __init__(self):
        self.trees: dict[str, Tree] = {}
        self.places: dict[tuple[str, str], dict[int, int]] = {}

    def slots(self, template: str | None, shape: str) -> dict[int, int]:
        if template is None:
            return {}
        key = template, shape
        if key not in self.places:
            if len(self.places) >= REMEMBERED:
                self.places.clear()
                self.trees.clear()
            if template not in self.trees:
                self.trees[template] = read_tree(template)
            self.places[key] = align(self.trees[template], read_tree(shape))
        return self.places[key]


def _text(value: bytes) -> str:
    return value.decode("utf-8", "replace")


#: What a page is read into: its site, its tree, and per block of the article place, text key, mark and text.
READ = "__site string, __shape string, __places array<int>, __keys array<bigint>, __marks array<int>, __texts array<string>"


def read_pages(df: DataFrame, html: str, url: str, kept: list[str]) -> DataFrame:
    """The kept columns and READ, parsed once."""
    page = F.coalesce(quoted(html).cast("string"), F.lit("")).cast("binary").alias("__html")
    wanted = df.select(*map(quoted, kept), host_of(quoted(url)).alias("__host"), page)
    read = StructType.fromDDL(READ)
    out = StructType([wanted.schema[c] for c in kept] + list(read))
    several = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for w in batches for piece in pieces(w, "__html")):
            made: list[list] = [[] for _ in read]
            for host, page in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist()):
                root = parse(_text(page))
                shape = skeleton(root)
                found, homes = article_blocks(root)
                row = (
                    f"{host}\n{site_path(homes)}", write_tree(shape), [n.place for n, _, _ in found],
                    [text_key(t) for _, t, _ in found], [m for _, _, m in found], [t for _, t, _ in found],
                )
                for column, value in zip(made, row):
                    column.append(value)
            columns = [pa.array(v, kind) for v, kind in zip(made, [pa.string(), pa.string(), *several])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[f.name for f in out])

    return wanted.mapInArrow(run, out)


def induce_templates(shapes: DataFrame) -> DataFrame:
    """``site, template`` from ``site, shape, pages``: one template per site."""

    def merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(3)))]
        found: dict[str, Tree] = {}
        for site, shape, pages in sorted(rows):
            tree = read_tree(shape)
            for node in _preorder(tree):
                node[1] *= pages
            found[site] = merge(found[site], tree) if site in found else tree
        sites = sorted(found)
        columns = [pa.array(sites, pa.string()), pa.array([write_tree(found[h]) for h in sites], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["site", "template"])

    # dealt by site and shape, so the shapes of a large site lie in many tasks
    made = shapes.mapInArrow(merged_rows, "site string, template string")
    made = store(made.withColumn("part", F.spark_partition_id()), "templates")
    while (made.groupBy("site").count().agg(F.max("count")).first()[0] or 0) > 1:
        group = F.call_function("div", "part", F.lit(FAN_IN)).cast("int")
        dealt = made.select("site", "template", group.alias("group"))
        merged = dealt.groupBy("site", "group").applyInArrow(_merge_group, "site string, template string, part int")
        before, made = made, store(merged, "templates")
        drop_scratch(before)
    return made.select("site", "template")


def _merge_group(key, table):
    site, group = (k.as_py() for k in key)
    merged = None
    for text in sorted(table.column("template").to_pylist()):
        tree = read_tree(text)
        merged = tree if merged is None else merge(merged, tree)
    return pa.table({"site": [site], "template": [write_tree(merged)], "part": pa.array([group], pa.int32())})


def place_texts(pages: DataFrame) -> DataFrame:
    """``site, slots, keys, doubtful`` of every page from ``site, shape, places, keys, marks, template``.

    Each pair of slot and text key once; ``doubtful`` holds the slots of blocks with a doubt.
    """

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers = _Wrappers()
        for batch in batches:
            made: list[list] = [[], [], [], []]
            for site, shape, places, keys, marks, template in zip(*(batch.column(k).to_pylist() for k in range(6))):
                slots = wrappers.slots(template, shape)
                own = sorted({(slots[p], k) for p, k in zip(places, keys) if p in slots})
                doubtful = sorted({slots[p] for p, m in zip(places, marks) if m > HEADING and p in slots})
                for column, value in zip(made, (site, [s for s, _ in own], [k for _, k in own], doubtful)):
                    column.append(value)
            several = pa.list_(pa.int64())
            columns = [pa.array(v, kind) for v, kind in zip(made, [pa.string(), several, several, several])]
            yield pa.RecordBatch.from_arrays(columns, names=["site", "slots", "keys", "doubtful"])

    return pages.mapInArrow(placed, "site string, slots array<bigint>, keys array<bigint>, doubtful array<bigint>")


def constant_texts(texts: DataFrame) -> DataFrame:
    """``site, constants`` (text keys per slot) from :func:`place_texts`.

    A text is constant if most pages have it in its slot, and still so when near
    copies of one article have one vote together. A page's share of a vote is
    one by the median page count of its texts: where more than half of them stand
    on ``m`` pages each, the page is one of about ``m`` copies.
    """
    # per slot one entry with no key: the pages that have the slot
    entries = "explode(concat(arrays_zip(slots, keys), transform(array_distinct(slots), s -> struct(s AS slots, CAST(NULL AS BIGINT) AS keys)))) AS e"

    def with_pages(counted: DataFrame, kinds: str) -> DataFrame:
        of_slot = counted.where("key IS NULL").drop("key").withColumnRenamed("n", "pages")
        return counted.where("key IS NOT NULL").where(kinds).join(of_slot, ["site", "slot"])

    counted = texts.selectExpr("site", entries).groupBy("site", "e.slots", "e.keys").agg(F.count("*").alias("n"))
    counted = store(counted.toDF("site", "slot", "key", "n"), "counts")
    common = with_pages(counted, "n > 1").where(f"{SHARE} * n > pages")
    frequent = F.col("pages") >= PAGES, F.col("n") * OF > F.col("pages") * CONSTANT
    # fewer than SHARE entries per block of a page; sites without a frequent text need no second count
    common = common.withColumn("frequent", frequent[0] & frequent[1]).groupBy("site").agg(
        F.max("frequent").alias("any"),
        F.map_from_entries(F.collect_list(F.struct(F.struct("slot", "key"), "n"))).alias("common"),
        F.collect_list(F.when(F.col("frequent"), F.struct("slot", "key"))).alias("frequent"),
    )
    common = store(common.where("any").drop("any"), "common")
    counts = "array_sort(transform(arrays_zip(slots, keys), x -> coalesce(common[struct(x.slots AS slot, x.keys AS key)], 1L)))"
    votes = texts.join(common.select("site", "common"), "site").where("size(keys) > 0").selectExpr("site", "slots", "keys", f"{counts} AS c")
    votes = votes.selectExpr("site", entries, f"({VOTE} - 1) div c[(size(c) - 1) div 2] + 1 AS vote")
    # a bigint holds the votes of some 195 million pages only
    votes = votes.groupBy("site", "e.slots", "e.keys").agg(F.sum(F.col("vote").cast("decimal(18,0)"))).toDF("site", "slot", "key", "n")
    most = f"pages >= {PAGES * VOTE}BD AND n * {OF}BD > pages * {CONSTANT}BD"
    constant = with_pages(store(votes, "votes"), "n > 0").where(most)
    constant = constant.groupBy("site").agg(F.collect_list(F.struct("slot", "key")).alias("voted"))
    both = F.array_intersect("frequent", "voted")
    return constant.join(common.select("site", "frequent"), "site").select("site", both.alias("constants"))


def settled_slots(texts: DataFrame) -> DataFrame:
    """``site, settled``: the slots of doubtful blocks that enough pages have, where the template decides."""
    slots = texts.select("site", F.explode("doubtful").alias("slot")).groupBy("site", "slot").agg(F.count(F.lit(1)).alias("n"))
    return slots.where(F.col("n") >= PAGES).groupBy("site").agg(F.collect_list("slot").alias("settled"))


def extract_articles(df: DataFrame, html: str = "html", url: str = "url", keep_html: bool = True) -> DataFrame:
    """Append ``text``, the main text of every page.

    Blocks stand in page order, joined by a line break; white space inside a
    block is one space. A null or empty page, or one without article text, gives
    an empty text; elements may be nested to any depth. Pages without a host form one
    group. Constant texts are dropped only while something varies on the page, and a
    constant heading stays where varying text follows it; near copies of an article
    do not make its text constant. Rows are neither dropped
    nor merged, an empty table gives an empty table, an input column named
    ``text`` is replaced. Without ``keep_html`` the page itself is left out.

    Jobs run while the query is being defined: pages are read into a stored table, and
    templates and counts are formed from that.
    """
    kept = [c for c in df.columns if c.lower() != "text" and (keep_html or c != html)]
    pages = store(read_pages(df, html, url, kept), "pages")
    renamed = {f"__{c}": c for c in ("site", "shape", "places", "keys", "marks")}
    plain = pages.select(*renamed).withColumnsRenamed(renamed)
    templates = induce_templates(plain.groupBy("site", "shape").agg(F.count(F.lit(1)).alias("pages")))
    placed = plain.join(templates, "site", "left").select("site", "shape", "places", "keys", "marks", "template")
    texts = store(place_texts(placed), "texts")
    known = templates.join(constant_texts(texts), "site", "left").join(settled_slots(texts), "site", "left")
    # where nothing is constant and nothing in doubt is settled, a page needs no template
    known = known.where("constants IS NOT NULL OR settled IS NOT NULL")
    wrappers = store(known.toDF("__site", "__template", "__constants", "__settled"), "wrappers")
    # templates, texts and counts have served
    drop_scratch(known)
    wanted = pages.join(wrappers, "__site", "left").select(
        *map(quoted, kept), "__shape", "__places", "__keys", "__marks", "__texts", "__template", "__constants", "__settled"
    )
    out = StructType([wanted.schema[c] for c in kept]).add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers = _Wrappers()
        for batch in batches:
            given = (batch.column(len(kept) + k).to_pylist() for k in range(8))
            texts = [_article(wrappers, *row) for row in zip(*given)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[f.name for f in out])

    return wanted.mapInArrow(run, out)


def _article(
    wrappers: _Wrappers, shape: str, places: list[int], keys: list[int], marks: list[int], texts: list[str],
    template: str | None, constants: list[dict] | None, settled: list[int] | None,
) -> str:
    slots = wrappers.slots(template, shape) if constants or settled else {}
    told, fixed = set(settled or ()), {(c["slot"], c["key"]) for c in constants or ()}
    kept = [
        k for k, (p, m) in enumerate(zip(places, marks)) if not m & GOES and (not m & MAY_GO or slots.get(p) in told)
    ]
    # a page all in doubt is shown rather than lost
    kept = kept or list(range(len(texts)))
    varies = {k for k in kept if (slots.get(places[k]), keys[k]) not in fixed}
    follows = {}
    for at, k in enumerate(kept):
        nearest = kept[at + 1] if at + 1 < len(kept) else None
        follows[k] = nearest is not None and nearest in varies and not marks[nearest] & HEADING
    shown = [k for k in kept if k in varies or marks[k] & HEADING and follows[k]] if varies else kept
    return "\n".join(texts[k] for k in shown)
