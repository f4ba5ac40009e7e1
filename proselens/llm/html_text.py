"""Main text of web pages by wrapper induction.

1. Every page is parsed into a tree.  A node's kind is its tag with its class and id, in which runs of digits count as
   equal; siblings of one kind are one repeated node, in the order of their first ones.
2. The trees of one host are aligned by simple tree matching: equal roots, and between the children the order-keeping
   alignment that matches most nodes.  The alignment is merged into the host's template: each node with the number of
   pages that have it, how often it is repeated, how much text it has, how much of that is links, and its own text while
   that is the same on all of them.  Pages of a host with the same text count as one page, so that copies of an article
   do not make it a wrapper.  Pages of a shape that the template has met are added without a new alignment.  Templates
   merge with each other in the same way, so each partition makes its own and only these meet: first in many parts per
   host, then per host.  Nodes that ``RARE`` of the pages of a template of many pages have are taken out of it.
3. The content slot of a host of ``MIN_PAGES`` pages or more is found from the template's root down: a step goes into
   the child that holds most of the varying text, as long as it stands once on a page and what stands beside it is
   wrapper: constant text, or a structure that never varies (a menu, an advert, a footer, whatever its words), or little
   text.  The walk ends in an article element (or all of them), and where text is repeated or stands in parts.  Headings
   beside the way are part of the content.
4. In the slot, blocks are wrapper where their text is constant over ``MIN_PAGES`` pages or more and at least half of the
   host's, and so are parts of fixed structure that consist of links.
5. The text of a page is what is left of its slots.  Menus, forms, scripts, adverts, reader comments and the like within
   them go by tag, role or name (a class or id; ordinary words only where they stand alone).  Only pages without a slot
   (few pages on their host, or another layout) take their article elements, or else main, or content containers, or
   else the body, less what these lists name.

Character references are decoded, white space in a block becomes one space, blocks are trimmed and joined by a line
feed.  Nothing is dropped or capped but what is named here.

Defined cases: null html counts as empty and gives an empty text; a null or odd url belongs to the host ''; markup that
never ends, or ends what was never begun, is read as browsers do, roughly, in one pass of linear time; trees deeper
than ``DEEPEST`` are compared down to there only and extracted whole; repeated rows are extracted each; should all of a
page's slot be constant, it is kept; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordscan
from .common import cut, drop, table

MIN_PAGES = 3
DEEPEST = 40
RARE, MANY_PAGES = 0.02, 100
HOSTS_HELD = 2_000
BROADCAST_BYTES = 32 << 20

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
REST = re.compile(r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption html legend option optgroup summary tbody td tfoot th thead tr li dd dt".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "p": ({"p"}, {"table", "td", "th", "button", "caption", "object"})}
NEVER = frozenset("nav footer aside form script style noscript template iframe head title button select textarea option svg math canvas object dialog menu audio video input label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Names that say alone what an element is, and ordinary words that do so only where they are its whole class or id.
NAMES = frozenset("nav navbar navigation sidebar masthead ad ads advert adverts advertisement advertising cookie cookies gdpr newsletter subscribe signup login comments commentlist disqus breadcrumb breadcrumbs pagination pager popup modal widget widgets toolbar outbrain taboola".split())
WORDS = frozenset("menu aside footer header banner promo promotion sponsor sponsored consent notice notices subscription comment reply replies respond share sharing social related recommended overlay skip".split())
CONTENT = frozenset("article content post entry story main body text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TEXTUAL = HEADINGS | frozenset("p li ul ol dl dt dd table tbody tr td th blockquote pre figure figcaption address".split())


def tags(source: str) -> Iterator[tuple[str, int, int, str]]:
    """The pieces of a page in one pass: ("text", from, to, ""), ("raw", from, to, "") or (name, end of tag, -1, attributes).

    A name with a slash before it is an end tag.  What begins like markup and has no end is text.
    """
    at, n = 0, len(source)
    last, no_cdata = source.rfind(">"), False
    while at < n:
        begin = source.find("<", at)
        if begin < 0 or begin > last:
            yield "text", at, n, ""
            return
        if begin > at:
            yield "text", at, begin, ""
        if source.startswith("<!--", begin):
            end = source.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        if source.startswith("<![CDATA[", begin) and not no_cdata:
            end = source.find("]]>", begin)
            if end >= 0:
                yield "raw", begin + 9, end, ""
                at = end + 3
                continue
            no_cdata = True
        if source.startswith(("<!", "<?"), begin):
            at = source.find(">", begin) + 1
            continue
        name = NAME.match(source, begin + 1)
        rest = REST.match(source, name.end()) if name else None
        if name and not rest:
            last = begin  # no tag ends after this place
        if not rest:
            yield "text", begin, begin + 1, ""
            at = begin + 1
            continue
        at = rest.end()
        raw = name[0].lower()
        yield raw, at, -1, source[name.end() : at - 1]
        if raw in RAW and source[at - 2] != "/":
            found = re.compile(f"</{raw}", re.IGNORECASE).search(source, at)
            end = found.start() if found else n
            yield "text", at, end, ""
            at = end


class Page:
    """The nodes of a page in the order of their start tags, and its pieces of text in the order of the page."""

    def __init__(self, source: str):
        self.tag, self.kind, self.parent, self.no = ["#"], ["#"], [-1], [False]
        self.pieces: list[tuple[int, str]] = []
        stack = [0]
        held: dict[str, list[int]] = defaultdict(list)  # where in the stack the elements of each name are

        def close(k: int) -> None:
            for node in reversed(stack[k:]):
                held[self.tag[node]].pop()
            del stack[k:]

        def nearest(names) -> int:
            return max((held[x][-1] for x in names if held[x]), default=0)

        for name, begin, end, words in tags(source):
            if end >= 0:
                piece = source[begin:end]
                self.pieces.append((stack[-1], html.unescape(piece) if "&" in piece and name == "text" else piece))
                continue
            if name[0] == "/":
                name = name[1:]
                if held[name]:
                    if name in BLOCKS:
                        self.pieces.append((stack[held[name][-1]], "\n\0"))
                    close(held[name][-1])
                continue
            for group in (name, "p" if name in CLOSES_P else ""):
                if group in CLOSES and (k := nearest(CLOSES[group][0])) > nearest(CLOSES[group][1]):
                    close(k)
            node = len(self.tag)
            attributes = {a.lower(): x or y or z or "" for a, x, y, z in ATTRIBUTE.findall(words)} if words else {}
            own = [attributes.get(a, "").lower().split() for a in ("class", "id")]
            self.tag.append(name)
            self.kind.append(name if name in ("html", "body") or not (own[0] or own[1]) else f"{name}.{DIGITS.sub('0', '.'.join(own[0] + own[1]))}")
            self.parent.append(stack[-1])
            named = any(not NAMES.isdisjoint(x) or (len(x) == 1 and x[0] in WORDS) for x in own)
            self.no.append(name in NEVER or attributes.get("role", "").lower() in ROLES or "hidden" in attributes or named)
            if name in BLOCKS:
                self.pieces.append((node, "\n\0"))
            elif name in ("br", "td", "th"):
                self.pieces.append((node, " "))
            if name not in VOID:
                held[name].append(len(stack))
                stack.append(node)
        n = len(self.tag)
        self.block, self.link = [0] * n, [False] * n  # text in inline elements is part of the block they stand in
        for node in range(1, n):
            self.block[node] = node if self.tag[node] in BLOCKS else self.block[self.parent[node]]
            self.link[node] = self.tag[node] == "a" or self.link[self.parent[node]]
        self.own: list[list[str]] = [[] for _ in self.tag]
        self.linked = [0] * n
        for node, piece in self.pieces:
            if piece != "\n\0":
                self.own[self.block[node]].append(piece)
                if self.link[node]:
                    self.linked[self.block[node]] += len(piece.strip())

    def words(self, node: int) -> str:
        """The own text of a block; inline elements have none."""
        return " ".join("".join(self.own[node]).split())

    def children(self) -> list[list[int]]:
        found: list[list[int]] = [[] for _ in self.tag]
        for node in range(1, len(self.tag)):
            found[self.parent[node]].append(node)
        return found

    def articles(self) -> list[int]:
        """The outermost nodes whose insides are the article, by tags and names."""
        shut, size = self.shut(), [0] * len(self.tag)
        for node, piece in self.pieces:
            if piece != "\n\0" and not shut[node]:
                size[node] += len(piece.strip())
        for node in range(len(self.tag) - 1, 0, -1):
            size[self.parent[node]] += size[node]
        for wanted in (lambda i: self.tag[i] == "article", lambda i: self.tag[i] == "main", lambda i: "." in self.kind[i] and not CONTENT.isdisjoint(re.split(r"[._\-]+", self.kind[i])[1:])):
            found = self.outermost({i for i in range(1, len(self.tag)) if not shut[i] and size[i] and wanted(i)})
            if found:
                return found
        return [next((i for i in range(1, len(self.tag)) if self.tag[i] == "body"), 0)]

    def outermost(self, nodes: set[int]) -> list[int]:
        inside = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            inside[i] = inside[self.parent[i]] or self.parent[i] in nodes
        return sorted(i for i in nodes if not inside[i])

    def shut(self) -> list[bool]:
        """Which nodes are, or stand in, what is no article; not what holds the articles with most of the page's text."""
        out = self.marked(frozenset())
        roots = {i for i in range(1, len(self.tag)) if self.tag[i] in ("article", "main") and not self.no[i]}
        if not roots or not all(out[i] for i in roots):
            return out
        within = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            within[i] = i in roots or within[self.parent[i]]
        held = left = 0
        for node, piece in self.pieces:
            if piece != "\n\0":
                held += len(piece.strip()) if within[node] else 0
                left += len(piece.strip()) if not out[node] else 0
        if held <= left:
            return out
        return self.marked(self.above(roots, lambda i: self.tag[i] == "form" or self.tag[i] not in NEVER))

    def above(self, nodes, wanted=lambda i: True) -> frozenset[int]:
        """The nodes and all that they stand in, as far as wanted."""
        spared: set[int] = set()
        for i in nodes:
            while i > 0 and i not in spared:
                spared.add(i)
                i = self.parent[i]
        return frozenset(i for i in spared if wanted(i))

    def marked(self, spared: frozenset[int]) -> list[bool]:
        """Nodes that are, or stand in, what is no article by tag, role or name, but for those spared."""
        out = [False] * len(self.tag)
        inside = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            up = self.parent[i]
            inside[i] = inside[up] or self.tag[i] in ("article", "main")
            named = self.no[i] and i not in spared and self.tag[i] not in ("html", "body", "article", "main") and not (self.tag[i] == "header" and inside[i])
            out[i] = out[up] or named or (self.tag[i] == "header" and not inside[i] and i not in spared) or (self.no[i] and self.tag[i] == "article" and inside[up])
        return out

    def paths(self) -> list[str]:
        out = ["#"] * len(self.tag)
        depth = [0] * len(self.tag)
        for i in range(1, len(self.tag)):
            up = self.parent[i]
            depth[i] = depth[up] + 1
            out[i] = f"{out[up]}/{self.kind[i]}" if depth[i] <= DEEPEST else out[up]
        return out

    def text(self, wrapper: dict | None = None, lists: bool = True) -> str:
        """The main text; ``wrapper``: what ``wrapper_of`` has found for the host; ``lists``: also go by tag, role and name."""
        paths = self.paths() if wrapper else []
        slots = set(wrapper["slot"]) if wrapper else set()
        heads = set(wrapper["heads"]) if wrapper else set()
        roots = {i for i, p in enumerate(paths) if p in slots}
        if roots:
            spared = self.above(roots)
            shut = self.marked(spared) if lists else [self.tag[i] in RAW and i not in spared for i in range(len(self.tag))]
            roots |= {i for i, p in enumerate(paths) if p in heads}
        else:
            shut, roots = (self.shut(), set(self.articles())) if lists else ([False] * len(self.tag), {0})
        within = [i in roots for i in range(len(self.tag))]
        for i in range(1, len(self.tag)):
            within[i] = within[i] or within[self.parent[i]]
        gone = list(shut)
        if wrapper:
            constant, fixed = set(wrapper["constant"]), set(wrapper["fixed"])
            for i in range(1, len(self.tag)):
                gone[i] = gone[i] or paths[i] in fixed or (gone[self.parent[i]] and not shut[self.parent[i]] and i not in roots)
            skip = {i for i in range(len(self.tag)) if within[i] and not gone[i] and constant and (w := self.words(i)) and f"{paths[i]} {mark_of(w)}" in constant}
            found = self.blocks(within, gone, skip, roots)
            if found:
                return found
        return self.blocks(within, shut, set(), roots)

    def blocks(self, within: list[bool], shut: list[bool], skip: set[int], roots: set[int]) -> str:
        blocks, now = [], []
        for node, piece in self.pieces:
            if piece == "\n\0" or not within[node] or (shut[node] and node not in roots):
                if piece == "\n\0" and now:
                    blocks.append("".join(now))
                    now = []
            elif self.block[node] not in skip:
                now.append(piece)
        blocks.append("".join(now))
        return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def mark_of(words: str) -> int:
    """A number for the own text of a block, 0 for none."""
    return zlib.crc32(words.encode("utf-8", "replace")) or 1 if words else 0


# A template node: its kind, pages that have it, text mark (0: none, -1: varying), pages with that text, characters of
# its own blocks, those of them in links, fewest and most repetitions on a page, children.
KIND, PAGES, MARK, WITH_TEXT, CHARS, LINKS, FEWEST, MOST, BELOW = range(9)


def tree(page: Page) -> list:
    """A page as a template of one page: siblings of one kind are one repeated node."""
    children = page.children()

    def made(nodes: list[int], depth: int) -> list:
        words = [page.words(i) for i in nodes]
        mark = mark_of(words[0]) if len(words) == 1 else zlib.crc32("\n".join(words).encode("utf-8", "replace")) or 1 if any(words) else 0
        groups: dict[str, list[list[int]]] = {}
        if depth < DEEPEST:
            for i in nodes:
                own: dict[str, list[int]] = {}
                for c in children[i]:
                    own.setdefault(page.kind[c], []).append(c)
                for kind, found in own.items():
                    groups.setdefault(kind, []).append(found)
        below = []
        for found in groups.values():
            node = made([c for run in found for c in run], depth + 1)
            node[FEWEST] = min(len(run) for run in found) if len(found) == len(nodes) else 0
            node[MOST] = max(len(run) for run in found)
            below.append(node)
        return [page.kind[nodes[0]], 1, mark, 1 if mark else 0, sum(map(len, words)), sum(page.linked[i] for i in nodes), 1, 1, below]

    return made([0], 0)


def matching(a: list, b: list) -> int:
    """Simple tree matching: the most nodes of two trees that an order-keeping alignment matches."""
    return 0 if a[KIND] != b[KIND] else 1 + sum(gain for _, _, gain in chain(a[BELOW], b[BELOW]))


def chain(x: list[list], y: list[list]) -> list[tuple[int, int, int]]:
    """The order-keeping pairs of children (number in x, number in y, matched nodes) that match most nodes in all.

    Only children of one kind can match, so the pairs are few; the best increasing run of pairs is found with a list of
    best sums by place in y.
    """
    at: dict[str, list[int]] = defaultdict(list)
    for j, q in enumerate(y):
        at[q[KIND]].append(j)
    places, sums = [-1], [0]  # best sum of a chain that ends at or before each place: both lists grow together
    last: list[tuple | None] = [None]
    for i, p in enumerate(x):
        found = []
        for j in at.get(p[KIND], ()):
            gain = matching(p, y[j])
            k = bisect_right(places, j - 1) - 1
            found.append((sums[k] + gain, j, (i, j, gain, last[k])))
        for total, j, link in found:
            k = bisect_right(places, j)
            if sums[k - 1] >= total:
                continue
            if places[k - 1] == j:
                sums[k - 1], last[k - 1] = total, link
            else:
                places.insert(k, j)
                sums.insert(k, total)
                last.insert(k, link)
                k += 1
            while k < len(places) and sums[k] <= total:
                del places[k], sums[k], last[k]
    out, link = [], last[-1]
    while link:
        out.append(link[:3])
        link = link[3]
    return out[::-1]


def aligned(x: list[list], y: list[list]) -> list[list]:
    """The children of two aligned nodes merged, in an order that keeps both."""
    out, i, j = [], 0, 0
    for a, b, _ in chain(x, y):
        out += x[i:a] + y[j:b] + [merged(x[a], y[b])]
        i, j = a + 1, b + 1
    return out + x[i:] + y[j:]


def merged(a: list, b: list) -> list:
    """Two templates of the same root kind as one."""
    mark = a[MARK] or b[MARK] if not (a[MARK] and b[MARK]) or a[MARK] == b[MARK] else -1
    return [a[KIND], a[PAGES] + b[PAGES], mark, a[WITH_TEXT] + b[WITH_TEXT], a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], min(a[FEWEST], b[FEWEST]), max(a[MOST], b[MOST]), aligned(a[BELOW], b[BELOW])]


def thinned(node: list, pages: int | None = None) -> list:
    """A template of many pages without the nodes that very few of them have."""
    pages = pages or node[PAGES]
    if pages >= MANY_PAGES:
        node[BELOW] = [thinned(c, pages) for c in node[BELOW] if c[PAGES] >= RARE * pages]
    return node


def wrapper_of(template: list) -> dict | None:
    """The wrapper of a host: paths of content slots and headings, constant blocks, and fixed parts of links; None for few pages."""
    pages = template[PAGES]
    if pages < MIN_PAGES:
        return None
    facts: dict[int, tuple[int, int, bool, int]] = {}

    def look(node: list, up: int) -> tuple[int, int, bool, int]:
        """Varying characters outside of links, characters in links, whether the structure varies, all characters."""
        varies = node[MARK] == -1 or 0 < node[WITH_TEXT] < MIN_PAGES
        mass, links, shape, chars = (node[CHARS] - node[LINKS] if varies else 0), node[LINKS], node[FEWEST] != node[MOST], node[CHARS]
        for c in node[BELOW]:
            m, k, s, n = look(c, node[PAGES])
            mass, links, shape, chars = mass + m, links + k, shape or s or c[PAGES] < node[PAGES], chars + n
        facts[id(node)] = mass, links, shape, chars
        return facts[id(node)]

    look(template, pages)

    def tag_of(node: list) -> str:
        return node[KIND].partition(".")[0]

    def wrapping(node: list, total: int) -> bool:
        mass, _, shape, _ = facts[id(node)]
        if not mass or tag_of(node) in HEADINGS | RAW | {"head"}:
            return True
        return tag_of(node) not in TEXTUAL and (not shape or 10 * mass <= total)

    node, path, heads = template, "#", []
    while facts[id(node)][0] and tag_of(node) != "article":
        total, own = facts[id(node)][0], node[CHARS] - node[LINKS] if node[MARK] == -1 else 0
        best = max(node[BELOW], key=lambda c: facts[id(c)][0], default=None)
        if best is None or 10 * own > total or 2 * facts[id(best)][0] < total or tag_of(best) in TEXTUAL:
            break
        if tag_of(best) != "article" and (best[MOST] > 1 or tag_of(node) == "main"):
            break
        beside = [c for c in node[BELOW] if c is not best]
        if not all(wrapping(c, total) for c in beside):
            break
        if tag_of(node) != "#" and tag_of(node) != "html":
            heads += [f"{path}/{c[KIND]}" for c in beside if tag_of(c) in HEADINGS or (tag_of(c) == "header" and tag_of(node) == "main")]
        node, path = best, f"{path}/{best[KIND]}"
    slot = [path] if facts[id(node)][0] and path.count("/") >= 2 else []
    constant, fixed, todo = [], [], [(template, "#")]
    while todo:
        now, at = todo.pop()
        if now[MARK] > 0 and now[WITH_TEXT] >= MIN_PAGES and 2 * now[WITH_TEXT] >= pages:
            constant.append(f"{at} {now[MARK]}")
        mass, links, shape, chars = facts[id(now)]
        if at not in ("#", path) and not path.startswith(f"{at}/") and 2 * now[PAGES] >= pages and not shape and tag_of(now) in BLOCKS - TEXTUAL | {"ul", "ol"} and 2 * links > chars:
            fixed.append(at)
        todo += [(c, f"{at}/{c[KIND]}") for c in now[BELOW]]
    return {"slot": slot, "heads": sorted(set(heads)), "constant": sorted(constant), "fixed": sorted(set(fixed))}


class Wrapper:
    """The template of one host while pages are added."""

    def __init__(self):
        self.tree: list | None = None
        self.shapes: dict[str, list[list]] = {}

    def add(self, new: list) -> None:
        nodes = flat(new)
        shape = "\n".join(f"{depth} {node[KIND]}" for node, depth in nodes)
        known = self.shapes.get(shape)
        if known is None:
            self.tree = new if self.tree is None else thinned(merged(self.tree, new))
            self.shapes.clear()  # merging makes new nodes
            place = located(self.tree, new)
            if place:
                self.shapes[shape] = place
            return
        for to, (node, _) in zip(known, nodes, strict=True):
            for k in (PAGES, CHARS, LINKS):
                to[k] += node[k]
            to[FEWEST], to[MOST] = min(to[FEWEST], node[FEWEST]), max(to[MOST], node[MOST])
            if node[MARK]:
                to[MARK] = node[MARK] if to[MARK] in (0, node[MARK]) else -1
                to[WITH_TEXT] += node[WITH_TEXT]


def flat(node: list) -> list[tuple[list, int]]:
    out, todo = [], [(node, 0)]
    while todo:
        now, depth = todo.pop()
        out.append((now, depth))
        todo += [(c, depth + 1) for c in reversed(now[BELOW])]
    return out


def located(whole: list, part: list) -> list[list] | None:
    """The nodes of a template that a page's nodes stand at, if each has one by order of kinds alone."""
    out: list[list] = []

    def walk(a: list, b: list) -> bool:
        out.append(a)
        at = 0
        for child in b[BELOW]:
            while at < len(a[BELOW]) and a[BELOW][at][KIND] != child[KIND]:
                at += 1
            if at == len(a[BELOW]) or not walk(a[BELOW][at], child):
                return False
            at += 1
        return True

    return out if walk(whole, part) else None


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper: JSON of ``wrapper_of``) of the hosts with enough pages; ``pages``: host, html."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordscan.slices(batch, "html"):
                rows = []
                for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    page = Page(source or "")
                    rows.append((host, hashlib.md5(page.text().encode("utf-8", "replace")).digest(), json.dumps(tree(page), separators=(",", ":"))))
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], ["host", "article", "tree"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}

        def out() -> pa.RecordBatch:
            rows = [(h, json.dumps(w.tree, separators=(",", ":"))) for h, w in held.items()]
            held.clear()
            return pa.record_batch([pa.array([h for h, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], ["host", "tree"])

        for batch in batches:
            for part in wordscan.slices(batch, "tree"):
                for host, text in zip(part.column("host").to_pylist(), part.column("tree").to_pylist(), strict=True):
                    held.setdefault(host, Wrapper()).add(json.loads(text))
                if len(held) > HOSTS_HELD:
                    yield out()
        if held:
            yield out()

    def joined(t: pa.Table) -> dict[str, list]:
        trees: dict[str, list] = {}
        for host, text in sorted(zip(t["host"].to_pylist(), t["tree"].to_pylist(), strict=True)):
            new = json.loads(text)
            trees[host] = thinned(merged(trees[host], new)) if host in trees else new
        return trees

    def once(t: pa.Table) -> pa.Table:
        trees = joined(t)
        return pa.table({"host": pa.array(trees, pa.string()), "tree": pa.array([json.dumps(x, separators=(",", ":")) for x in trees.values()], pa.string())})

    def last(t: pa.Table) -> pa.Table:
        found = {h: json.dumps(w) for h, x in joined(t).items() if (w := wrapper_of(x))}
        return pa.table({"host": pa.array(found, pa.string()), "wrapper": pa.array(list(found.values()), pa.string())})

    single = pages.mapInArrow(read, "host string, article binary, tree string").groupBy("host", "article").agg(F.min("tree").alias("tree")).select("host", "tree")
    first = cut(single.mapInArrow(partial, "host string, tree string").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))), "trees")
    cells = max(1, -(-first.count() // 500))
    some = first.withColumn("cell", F.pmod(F.xxhash64("host", "salt"), F.lit(cells))).groupBy("cell").applyInArrow(once, "host string, tree string")
    return some.withColumn("cell", F.pmod(F.xxhash64("host"), F.lit(cells))).groupBy("cell").applyInArrow(last, "host string, wrapper string")


def host_of(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def extracted(pages: DataFrame, wrapped: bool = True, lists: bool = True) -> DataFrame:
    """Every row of ``pages`` (page_id, url, html) as page_id, url, text, n_chars.

    ``wrapped`` and ``lists`` leave out the wrappers or the lists of tags and names, to see what each of them does.
    """
    pages = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    found = cut(wrappers(pages.select("host", "html")), "wrappers")
    held = found.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("wrapper")), F.lit(0))).first()[0]
    kind = pages.schema["page_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            for part in wordscan.slices(batch, "html"):
                texts = []
                for wrapper, source in zip(part.column("wrapper").to_pylist(), part.column("html").to_pylist(), strict=True):
                    if wrapper and wrapper not in known:
                        if len(known) > HOSTS_HELD:
                            known.clear()
                        known[wrapper] = json.loads(wrapper)
                    texts.append(Page(source or "").text(known[wrapper] if wrapper and wrapped else None, lists))
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    side = F.broadcast(found) if held <= BROADCAST_BYTES else found
    return pages.join(side, "host", "left").mapInArrow(work, f"page_id {kind}, url string, text string, n_chars bigint")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
