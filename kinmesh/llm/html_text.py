"""Main text of web pages by wrapper induction.

A page is parsed once into a tree of its block elements; neighbouring siblings of one kind become one node, as lists
do in wrappers.  Pages of one host meet in blocks of at most ``block`` pages (a large host's pages are dealt out by a
hash, so no host is one task's work).  In a block, simple tree matching aligns each page's tree with that of a
representative page of its layout: aligned nodes whose text is the same in most pages are the template, also inside
article and main, and so are single headings and paragraphs that most pages have in one node; the others are slots.
A group of copies has one vote.  The slot
that holds the text, voted by the block's pages, is the wrapper's content; a page of a host without others has only
what its tags tell.  Elements for menus, adverts, forms and the like never are content; class words tell such ones
too, unless they would hide the article, main or almost all text of most pages that have the element.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

# Elements by what they do to text.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul head".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math object select button canvas audio video xmp noembed noframes".split())
CLOSES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": set()}
BOILER_TAGS = set("nav aside footer form head dialog menu search fieldset".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
BOILER_NAMES = set(
    "nav navbar navigation menu menus submenu topbar toolbar breadcrumb breadcrumbs pagination pager masthead footer sidebar "
    "sidebars ad ads advert adverts advertisement adsense promo promos sponsor sponsored cookie cookies consent gdpr newsletter "
    "subscribe signup login share sharing comment comments disqus respond replies".split()
)
#: Words that an article's own parts are called by as well; alone, and only where no paragraph of text stands below.
WEAK_NAMES = set(
    "aside widget widgets advertising banner banners promotion notice notices notification alert popup modal overlay social "
    "related recommended recommendations reply discussion search searchbox skip".split()
)

#: Parts of a class word that say something about a listed part of it, as in no-sidebar and comments-open.
MODIFIERS = set("with without no not non has have is free open closed enabled disabled on off".split())

#: Elements nest so deep at most, as in browsers; deeper ones are part of the deepest.
DEPTH = 256
#: A tag is read with its quotes within so many characters; a longer one, or one whose quotes do not pair, ends at the first >.
TAG, ATTRIBUTES = 4096, 1 << 14
#: Elements whose content is no markup, up to the end of the page if they are not closed.
PLAIN = set("script style textarea title iframe xmp noembed noframes".split())

_START = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
_TAG = re.compile(r"""<[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""(?<![^\s/"'])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?(?=[\s/]|$)""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[a-z]+")
#: Pairs of children up to which lists of siblings are aligned at best.
MOST = 250_000
_SINGLE = re.compile(r"(?:p|h[1-6])(?![a-z0-9])")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(text)} if text else {}


def _boiler_name(names: str) -> int:
    """Whether a class or id, of lowered names, tells boilerplate: 1 if one of them has a listed part and no modifier,
    2 if all of them have, and some a weak one only."""
    kinds = [set(_NAME.findall(x)) for x in names.split()]
    kinds = [k for k in kinds if k]
    if any(k & BOILER_NAMES and not k & MODIFIERS for k in kinds):
        return 1
    return 2 if kinds and all(k & WEAK_NAMES and not k & MODIFIERS for k in kinds) else 0


class Page:
    """A page's block elements.  parent, label and boiler of each node; texts: (node, block of text), in page order.

    boiler has tags, roles and hidden elements and what is below; called has nodes whose class or id is of boilerplate,
    as _boiler_name() says.  Parsing takes time in proportion to the page, whatever is broken in it.
    """

    def __init__(self, source: str):
        self.parent, self.label, self.boiler, self.called, self.link = [-1], ["#"], [False], [0], [0]
        self.texts: list[tuple[int, str]] = []
        self._last: dict[int, int] = {}  # a node's last child
        self._stack: list[tuple[str, int]] = [("#", 0)]
        self._buffer: list[str] = []
        self._anchor = 0
        self._beyond = 0  # open elements below the depth
        self._open_tags: Counter = Counter()
        self._parse(source)

    def _cut(self, k: int) -> None:
        """Close the elements from place k of the stack on."""
        for tag, _ in self._stack[k:]:
            self._open_tags[tag] -= 1
        del self._stack[k:]

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join(entities.unescape("".join(self._buffer)).split())
            self._buffer.clear()
            if text:
                node = self._stack[-1][1]
                self.texts.append((node, text))

    def _open(self, tag: str, attributes: str) -> None:
        self._flush()
        stack, open_tags = self._stack, self._open_tags
        if tag in CLOSES and (open_tags[tag] or tag in ("dt", "dd", "td", "th")):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES[tag]:
                    break
                if stack[k][0] == tag or (tag in ("dt", "dd", "td", "th") and stack[k][0] in ("dt", "dd", "td", "th")):
                    self._cut(k)
                    break
        if open_tags["p"]:
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k][0] == "p":
                    self._cut(k)
                    break
                if stack[k][0] in ("td", "th", "table", "button"):
                    break
        a, above = _attributes(attributes[:ATTRIBUTES]), stack[-1][1]
        names = " ".join((a.get("class", ""), a.get("id", ""))).lower()
        kinds = set(_NAME.findall(names))
        boiler = (
            self.boiler[above] or tag in BOILER_TAGS or a.get("role", "").lower() in BOILER_ROLES or "hidden" in a
            or a.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(a.get("style", "")))
            or (tag == "header" and not any(t in ("article", "main") for t, _ in stack))
        )
        called = 0 if tag in ("html", "body", "article", "main") or not names.strip() else _boiler_name(names)
        label = f"{tag}.{'.'.join(sorted(kinds))}" if kinds else tag
        if a.get("role", "").lower() == "main" or a.get("itemprop", "").lower() == "articlebody":
            label += "!"
        last = self._last.get(above)
        if last is not None and self.label[last] == label and self.boiler[last] == boiler and self.called[last] == called:
            node = last  # one more of a list
        else:
            node = len(self.label)
            self.parent.append(above)
            self.label.append(label)
            self.boiler.append(boiler)
            self.called.append(called)
            self.link.append(0)
            self._last[above] = node
        if tag in VOID:
            return
        if len(stack) > DEPTH:
            self._beyond += 1
        else:
            stack.append((tag, node))
            open_tags[tag] += 1

    def _close(self, tag: str) -> None:
        if self._beyond:
            self._flush()
            self._beyond -= 1
        elif self._open_tags[tag]:
            for k in range(len(self._stack) - 1, 0, -1):
                if self._stack[k][0] == tag:
                    self._flush()
                    self._cut(k)
                    break

    def _parse(self, source: str) -> None:
        at, end_of, stack, buffer = 0, len(source), self._stack, self._buffer
        unclosed: set[str] = set()  # elements of which no end is left

        def after(mark: str, start: int) -> int:
            k = source.find(mark, start)
            return end_of if k < 0 else k + len(mark)

        while m := _START.search(source, at):
            start = m.start()
            if start > at:
                text = source[at:start]
                buffer.append(text)
                if self._anchor:
                    self.link[stack[-1][1]] += len(text)
            kind = m[0]
            if kind == "<!--":
                at = after("-->", start + 2)
            elif kind == "<![CDATA[":
                at = after("]]>", start)
            elif kind in ("<!", "<?"):
                at = after(">", start)
            else:
                tag = _TAG_NAME.match(source, start)[1].lower()
                if kind[1] == "/":
                    at = after(">", start)
                    if tag == "a":
                        self._anchor = 0
                    elif tag in BLOCK:
                        self._close(tag)
                    continue
                whole = _TAG.match(source, start, min(end_of, start + TAG))
                at = whole.end() if whole else after(">", start)
                if at == end_of and source[-1] != ">":
                    break  # the page ends within a tag
                attributes = source[start + 1 + len(tag) : at - 1]
                if tag in RAW and not attributes.endswith("/"):
                    end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*(?:>|$|[\s/][^>]*>)", re.I).search(source, at)
                    if end:
                        at = end.end()
                    elif tag in PLAIN:
                        at = end_of
                    else:
                        unclosed.add(tag)
                elif tag in BLOCK:
                    self._open(tag, attributes)
                elif tag == "a":
                    self._anchor = 1
                elif tag == "br":
                    buffer.append("\n")
        else:
            if at < end_of:
                buffer.append(source[at:])
        self._flush()

    def pack(self) -> bytes:
        return zlib.compress(json.dumps([self.parent, self.label, self.boiler, self.called, self.link, self.texts], ensure_ascii=False).encode("utf-8", "surrogatepass"), 1)


class Tree:
    """What pack() kept, with children, paths and a hash of each node's own text."""

    def __init__(self, packed: bytes):
        self.parent, self.label, self.boiler, self.called, self.link, self.texts = json.loads(zlib.decompress(packed).decode("utf-8", "surrogatepass"))
        n = len(self.label)
        self.children: list[list[int]] = [[] for _ in range(n)]
        self.path = [0] * n  # a hash of the labels from the root
        self.own: list[int] = [0] * n
        self.size = [0] * n
        self.single = [_SINGLE.match(x) is not None for x in self.label]
        for i in range(1, n):
            self.children[self.parent[i]].append(i)
            name = zlib.crc32(self.label[i].encode("utf-8", "surrogatepass"))
            self.path[i] = (self.path[self.parent[i]] * 0x100000001B3 ^ name) % (1 << 64) + 1
        for node, text in self.texts:
            self.own[node] = zlib.crc32(text.encode("utf-8", "surrogatepass"), self.own[node])
            self.size[node] += len(text)
        # a weak name counts where no paragraph of text stands below, or most of the text is links
        size, link, told = self.size[:], self.link[:], [s and x for s, x in zip(self.size, self.single)]
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            size[up], link[up], told[up] = size[up] + size[i], link[up] + link[i], told[up] or told[i]
        self.called = [c == 1 or (c == 2 and (not told[i] or 2 * link[i] >= size[i])) for i, c in enumerate(self.called)]
        self.hard = self.boiler
        self.mark(set())

    def mark(self, spared: set[int]) -> None:
        """Set boiler: what tags tell, and what is in an element called so by its class, but for the spared nodes."""
        self.boiler = self.hard[:]
        for i in range(1, len(self.label)):
            below = self.boiler[self.parent[i]] and not (self.parent[i] in spared and i in spared)
            self.boiler[i] = self.hard[i] or below or (self.called[i] and i not in spared)

    def slot(self) -> tuple[set[int], bool]:
        """The nodes from the root to the page's article, main or most text by tags alone, and whether class words hide it."""
        named = [i for i in range(len(self.label)) if not self.hard[i] and (self.label[i].endswith("!") or self.label[i].split(".")[0] in ("article", "main"))]
        boiler, self.boiler = self.boiler, self.hard
        left, most = (sum(x for x, b in zip(self.size, dropped) if not b) for dropped in (boiler, self.hard))
        if named:
            total = _masses(self)
            at = max(named, key=lambda i: (total[i], -i))
            hidden = all(boiler[i] for i in named) and left <= 0.5 * most
        else:
            at = _heaviest(self, set())
            hidden = left <= 0.2 * most
        self.boiler = boiler
        way = {at}
        while (at := self.parent[at]) >= 0:
            way.add(at)
        return way, hidden and any(self.called[i] for i in way)


def match(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: b's node -> a's node of a largest top-down alignment that keeps the order of siblings.

    Without recursion, so that depth is no matter.  Children that have the same labels at both ends of the lists are
    paired there; of what is left, lists with more than MOST pairs are aligned from the left.
    """
    known: dict[tuple[int, int], tuple[int, list]] = {}
    ends: dict[tuple[int, int], tuple[list, list, list]] = {}

    def parts(x: int, y: int):
        """The pairs at both ends of the lists of children, and what is left of the lists."""
        p, q = a.children[x], b.children[y]
        most = min(len(p), len(q))
        k = 0
        while k < most and a.label[p[k]] == b.label[q[k]]:
            k += 1
        n = 0
        while n < most - k and a.label[p[-1 - n]] == b.label[q[-1 - n]]:
            n += 1
        pairs = list(zip(p[:k], q[:k])) + (list(zip(p[-n:], q[-n:])) if n else [])
        p, q = p[k : len(p) - n], q[k : len(q) - n]
        if len(p) * len(q) > MOST:
            places: dict[str, list[int]] = {}
            for place in range(len(q) - 1, -1, -1):
                places.setdefault(b.label[q[place]], []).append(place)
            at = 0
            for i in p:
                left = places.get(a.label[i], [])
                while left and left[-1] < at:
                    left.pop()
                if left:
                    at = left.pop() + 1
                    pairs.append((i, q[at - 1]))
            p = q = []
        return pairs, p, q

    todo = [(0, 0)]
    while todo:
        x, y = todo[-1]
        if (x, y) in known:
            todo.pop()
            continue
        if (x, y) not in ends:
            ends[x, y] = parts(x, y)
            pairs, p, q = ends[x, y]
            more = [*pairs, *((i, j) for i in p for j in q if a.label[i] == b.label[j])]
            todo += [z for z in more if z not in known]
            continue
        todo.pop()
        pairs, p, q = ends.pop((x, y))
        best = [[0] * (len(q) + 1)]
        for i in p:
            above, row = best[-1], [0]
            for k, j in enumerate(q):
                row.append(max(above[k + 1], row[-1], above[k] + known[i, j][0] if a.label[i] == b.label[j] else 0))
            best.append(row)
        total, i, j = 1 + best[-1][-1] + sum(known[z][0] for z in pairs), len(p), len(q)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((p[i], q[j]))
        known[x, y] = total, pairs

    out: dict[int, int] = {}
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        out[y] = x
        todo += known[x, y][1]
    return out


def content_path(tree: Tree, constant: set[int]) -> int:
    """The path of the node that holds the page's text, as far as it is neither boilerplate nor template."""
    n = len(tree.label)
    for wanted in ("!", "article", "main"):
        found = [i for i in range(n) if not tree.boiler[i] and (tree.label[i].endswith("!") if wanted == "!" else tree.label[i].split(".")[0].rstrip("!") == wanted)]
        if found:
            total = _masses(tree)
            return tree.path[max(found, key=lambda i: (total[i], -i))]
    return tree.path[_heaviest(tree, constant)]


def _heaviest(tree: Tree, constant: set[int]) -> int:
    """The deepest node that holds four fifths of the text, as far as it is neither boilerplate nor template."""
    n = len(tree.label)
    mass = [0 if tree.boiler[i] or i in constant else max(0, tree.size[i] - 2 * tree.link[i]) for i in range(n)]
    total = mass[:]
    for i in range(n - 1, 0, -1):
        total[tree.parent[i]] += total[i]
    at = 0
    while total[0] and (below := [c for c in tree.children[at] if total[c] >= 0.8 * total[0]]):
        if tree.label[below[0]].split(".")[0] in ("p", "li", "ul", "ol", "table", "blockquote", "pre", "dl"):
            break
        at = below[0]
    return at


def _masses(tree: Tree) -> list[int]:
    """The text in and below each node that is no boilerplate."""
    total = [0 if dropped else n for n, dropped in zip(tree.size, tree.boiler)]
    for i in range(len(total) - 1, 0, -1):
        total[tree.parent[i]] += total[i]
    return total


def distinct(trees: list[Tree]) -> list[int]:
    """The first page of each group of copies: pages that share more than half of the longer text, by whole blocks."""
    out: list[tuple[int, set[str], int]] = []
    for k, t in enumerate(trees):
        texts = {text for i, text in t.texts if not t.hard[i]}
        size = sum(map(len, texts))
        if not any(2 * sum(map(len, texts & other)) > max(size, n) or size == n == 0 for _, other, n in out):
            out.append((k, texts, size))
    return [k for k, _, _ in out]


def layouts(trees: list[Tree], voters: list[int]) -> list[list[int]]:
    """Pages by layout, the reference of each first: the page whose paths most of the pages left have."""
    paths, left, votes = [set(t.path) for t in trees], list(range(len(trees))), set(voters)
    out = []
    while left:
        ask = [k for k in left if k in votes] or left
        count = Counter(x for k in ask for x in paths[k])
        best = max(ask, key=lambda k: (sum(2 * count[x] - len(ask) for x in paths[k]), -k))
        near = [k for k in left if k != best and 5 * len(paths[k] & paths[best]) >= 2 * len(paths[k] | paths[best])]
        out.append([best, *near])
        gone = set(out[-1])
        left = [k for k in left if k not in gone]
    return out


def template(trees: list[Tree], group: list[int], voters: list[int]):
    """(page, its nodes of template, its texts of template by number) of pages of one layout; each distinct page has one vote."""
    votes = set(voters) & set(group)
    n = len(votes)
    if n < 3:
        return
    maps = {k: match(trees[group[0]], trees[k]) for k in group}
    met, same, shared = Counter(), Counter(), Counter()
    for k in votes:
        t, m = trees[k], maps[k]
        met.update(m.values())
        same.update((x, t.own[y]) for y, x in m.items() if t.own[y])
        # a list of headings or paragraphs is one node, so each text of it is judged by itself
        shared.update({(m[y], text) for y, text in t.texts if y in m and t.single[y]})
    fixed = {x for x, k in same.items() if met[x[0]] >= 0.6 * n and k >= 0.8 * met[x[0]]}
    common = {x for x, k in shared.items() if met[x[0]] >= 0.6 * n and k >= 0.8 * met[x[0]]}
    for k in group:
        t, m = trees[k], maps[k]
        yield k, {y for y, x in m.items() if (x, t.own[y]) in fixed}, {j for j, (y, text) in enumerate(t.texts) if (m.get(y), text) in common}


def extract(trees: list[Tree]) -> list[str]:
    """The main texts of pages of one host."""
    # class words that would hide the text of most pages with the same element are not believed
    slots = [t.slot() for t in trees]
    hidden, seen = Counter(), Counter()
    for t, (way, hides) in zip(trees, slots):
        for i in way:
            hidden[t.path[i]] += hides and t.called[i]
        seen.update({t.path[i] for i in range(len(t.label)) if t.called[i] and not t.hard[i]})
    for t, (way, hides) in zip(trees, slots):
        if hides and all(2 * hidden[t.path[i]] > seen[t.path[i]] for i in way if t.called[i]):
            t.mark(way)
    voters = distinct(trees)
    constant: list[set[int]] = [set()] * len(trees)
    common: list[set[int]] = [set()] * len(trees)  # the texts, by number, that are template
    for group in layouts(trees, voters):
        for k, nodes, places in template(trees, group, voters):
            constant[k], common[k] = nodes, places
    own = [content_path(t, c) for t, c in zip(trees, constant)]
    wrapper = max(Counter(own[k] for k in voters).items(), key=lambda x: (x[1], x[0]))[0]
    out = []
    for t, fixed, texts, path in zip(trees, constant, common, own):
        top = wrapper if wrapper in t.path else path
        inside = [False] * len(t.label)
        for i in range(len(t.label)):
            inside[i] = t.path[i] == top or (i > 0 and inside[t.parent[i]])
        kept = [text for k, (i, text) in enumerate(t.texts) if inside[i] and not t.boiler[i] and i not in fixed and k not in texts]
        out.append("\n".join(kept))
    return out


def main_text(pages: DataFrame, *, block: int = 64) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    Null and empty html has the empty text.  A url without a host is of host ''.  Repeated rows come out once each.
    """

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            packed = [Page(x or "").pack() for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(packed, pa.binary())],
                ["page_id", "url", "host", "tree"],
            )

    def induce(batches):
        import pyarrow as pa

        def emit(rows):
            texts = extract([Tree(r[4]) for r in rows])
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(texts, pa.string())],
                ["page_id", "url", "text"],
            )

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "host", "part", "tree"))):
                if held and (row[2:4] != held[0][2:4] or len(held) >= 2 * block):
                    yield emit(held)
                    held = []
                held.append(row)
        if held:
            yield emit(held)

    url = F.col("url").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    large = stash(rows.groupBy("host").count().where(F.col("count") > block), "large-hosts")
    n_large = large.count()
    trees = rows.mapInArrow(parse, "page_id long, url string, host string, tree binary")
    if n_large:
        trees = trees.join(F.broadcast(large) if n_large <= 100_000 else large, "host", "left")
        parts = F.coalesce(F.ceil(F.col("count") / block), F.lit(1))
        trees = trees.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), parts).cast("int")).drop("count")
    else:
        trees = trees.withColumn("part", F.lit(0))
    placed = trees.select("page_id", "url", "host", "part", "tree").repartition("host", "part")
    placed = placed.sortWithinPartitions("host", "part", "page_id", "url")
    out = placed.mapInArrow(induce, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))
