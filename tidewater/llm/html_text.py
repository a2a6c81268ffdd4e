"""Main text of web pages by union-free wrappers of their hosts.

1. A page becomes a well-nested stream of block tags and texts, and this a tree: runs of headings, paragraphs and lists
   are one flow, a repeated group of optional parts (h2? p? ul?)+; containers keep their order. Its tags are the page's
   shape; texts are counted by host, shape, place and hash.
2. The shapes of a host are aligned one after the other into its wrapper. Lists of children are aligned by label and
   likeness; what both have is merged, texts that differ become slots, a child that occurs on one side only becomes
   optional, or joins a neighbour of its kind as a repeated group. Hosts with many shapes are merged in rounds.
3. Each place of a shape has a slot of the wrapper. A text that several and most pages of the host show in one slot counts
   as fixed. The container of the wrapper with most of the other text is the region of the articles.
4. A page's text is that of its blocks in slots of the region, without elements that by their name are no text, without what
   the slots show to be boilerplate (a container within the region, or a block with a name of its own that is no heading, of
   whose text nine tenths are fixed; a paragraph among the article's own is none, however often it is repeated, and nothing is
   where all the region is fixed, as in copies of one page), and without containers whose class says so.

Names of the template (navigation, adverts, reader comments) tell by themselves, unless the container holds the title or main
part. Names that articles use too (discussion, response, related, search, notice, promotion) tell where the container doesn't
read like a section: a heading and paragraphs of its own, not links, with half of its text. Both hold for every number of pages.

A page without its host's region has a region of its own by the same rule over its tree, weighted by its slots.

Wrappers stay small: lists of over 64 children, and wrappers of over 4,000 nodes, fold by label, then by depth. Texts of
what is folded belong to the element that holds it. Elements deeper than 100 levels count as their ancestor there.

Defined results: null html has the text ''; pages of null or odd URLs share the host ''; rows are never dropped or merged.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import as_texts, bound_batches, join_checked, slices, stored
from tidewater.llm.url_filter import host_and_path

# Element names of HTML.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br img picture source".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe svg title xmp noembed noframes".split())
_NOT_TEXT = frozenset("nav footer aside form menu dialog head button select option object canvas audio video map".split())
_CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]),
}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
#: Parts of class and role names of containers that say that they aren't the article; and those that say so unless the container reads like a section.
_HINTS = frozenset("nav navbar navigation menubar masthead topbar footer contentinfo sidebar aside ad ads adv advert adverts advertisement adsense cookie gdpr newsletter subscribe signup login comment comments commentlist disqus breadcrumb breadcrumbs pagination pager popup modal overlay toolbar widget".split())
_DOUBTS = frozenset(
    "menu complementary banner promo promotion sponsor sponsored cookies consent notice notices notification alert subscription discussion respond response responses reply replies feedback share sharing social related recommended dialog search skip hidden".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAIN = frozenset(["article", "main"])
#: Parts of a flow.
_FLOW = frozenset("# p li h1 h2 h3 h4 h5 h6 pre blockquote td th dd dt dl ul ol table thead tbody tfoot tr caption figure figcaption hr address details summary".split())
#: A text is fixed if so many pages of the host, and more than half of them, show it at the same place.
_SEVERAL = 2
#: A slot or container is boilerplate if this share of its text is fixed.
_FIXED = 0.9

_TAG = re.compile(r"<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")
_SVG = re.compile(r"<(/?)svg\b((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.I)
#: Elements whose names aren't read.
_TEXT_TAGS = frozenset("html body article main p h1 h2 h3 h4 h5 h6 li pre blockquote td th dd dt".split())


_DEPTH, _WIDE, _LABELS, _NODES = 100, 64, 256, 4000
#: Two elements of one label are of a kind if their descendants' labels overlap so much.
_OF_A_KIND = 0.75


def _label(tag: str, attributes: str) -> tuple[str, bool, int]:
    """The tag with its class and id (without digits); whether it is no text; whether its class says that it isn't the article (2), or may (1)."""
    names, skipped, named = [], tag in _NOT_TEXT, 0
    if attributes:
        for m in _ATTR.finditer(attributes):
            kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if "hidden" in kind or kind == "style":
                skipped |= kind == "hidden" or value.strip().lower() == "true" or re.search(r"display\s*:\s*none", value, re.I) is not None
                continue
            if kind != "id" and tag not in _TEXT_TAGS:
                parts = {w.lower() for w in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", value) if w}
                named = max(named, 2 if parts & _HINTS else int(bool(parts & _DOUBTS)))
            words = _NAME.findall(value)
            if words and kind != "role":
                names.append(".".join(w.lower() for w in words[:4]))
    return (tag + "." + ".".join(names) if names else tag), skipped, named


def _svg_end(html: str, at: int) -> int | None:
    """Where the svg that was opened before `at` ends."""
    depth = 1
    for m in _SVG.finditer(html, at):
        if m[1]:
            depth -= 1
        elif not m[2].rstrip().endswith("/"):
            depth += 1
        if not depth:
            return m.end()
    return None


def _sections(events: list[tuple]) -> list[tuple]:
    """Events without the doubts about containers that hold the page's title or main part, and those (1) about containers that read like a section of an article."""
    open_: list[list] = []  # [place, tag, of flow, chars, chars of paragraphs' own words, heading, main part]
    kept: set[int] = set()
    for i, e in enumerate(events):
        if e[0] == "<":
            tag = e[1].partition(".")[0]
            open_.append([i, tag, tag in _FLOW, 0, 0, False, tag in ("h1", "main") or tag == "article" and not e[3]])
        elif e[0] == ">":
            at, _, flow, chars, own, headed, main = open_.pop()
            if main or events[at][3] == 1 and headed and own and 2 * own >= chars:
                kept.add(at)
            if open_:
                open_[-1][3] += chars
                open_[-1][6] |= main
                if flow:
                    open_[-1][4] += own
                    open_[-1][5] |= headed
        elif open_:
            top = open_[-1]
            top[3] += len(e[1])
            if any(x[1] in _HEADINGS for x in open_[-2:]):
                top[5] = True
            elif top[2] and top[1] not in ("li", "td", "th"):
                top[4] += max(0, len(e[1]) - e[2])
    return [(*e[:3], bool(e[3]) and i not in kept) if e[0] == "<" else e for i, e in enumerate(events)]


def stream(html: str) -> list[tuple]:
    """Well-nested events: ('<', label, skipped, named), ('>',), ('#', text, characters within links). Text is decoded, with single spaces.

    Scripts and styles that aren't closed hold the rest of the page; other elements whose content is no text, and svg, hold nothing then.
    """
    events: list[tuple] = []
    endless: set[str] = set()
    linked = [False, 0]  # whether a link is open, and the characters within links since the last text
    open_: list[str] = []  # tags of block elements
    inside: Counter = Counter()
    words: list[str] = []

    def flush() -> None:
        if words:
            text = _SPACE.sub(" ", unescape("".join(words))).strip()
            words.clear()
            if text:
                events.append(("#", text, min(len(text), linked[1])))
        linked[:] = [False, 0]

    def close(down_to: int) -> None:
        while len(open_) > down_to:
            inside[open_.pop()] -= 1
            events.append((">",))

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            words.append(html[at:])
            break
        if m.start() > at:
            words.append(html[at : m.start()])
            linked[1] += (m.start() - at) * linked[0]
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in _RAW and not m[1]:
            if tag == "svg" and m[3].rstrip().endswith("/"):
                continue
            end = None
            if tag not in endless:
                end = _svg_end(html, at) if tag == "svg" else next((x.end() for x in re.compile(rf"</{re.escape(tag)}\s*>?", re.I).finditer(html, at)), None)
            if end is None and tag not in ("script", "style"):
                endless.add(tag)  # whatever ends such an element, nothing does from here on
                continue
            at = n if end is None else end
            if tag != "svg":
                flush()
            continue
        if tag in _INLINE:
            if tag == "a":
                linked[0] = not m[1]
            if tag in ("br", "img", "wbr"):
                words.append(" " if tag != "wbr" else "")
            continue
        flush()
        if m[1]:
            if inside[tag]:
                close(len(open_) - 1 - open_[::-1].index(tag))
            continue
        closing = _CLOSES.get(tag, frozenset())
        if tag in _ENDS_P:
            closing |= {"p"}
        while open_ and open_[-1] in closing:
            close(len(open_) - 1)
        if tag in _VOID or m[3].endswith("/"):
            continue
        label, skipped, named = _label(tag, m[3])
        events.append(("<", label, skipped or tag == "header" and not (inside["article"] or inside["main"]), named))
        open_.append(tag)
        inside[tag] += 1
    flush()
    close(0)
    return _sections(events)


# --- trees and wrappers: nodes are [label, loose, kids, pages]. Labels begin with '!' for no text and '?' for a name that isn't an article's.
# The flow '~', its parts and other loose nodes have each label once, in any order and number.


def _tag(label: str) -> str:
    return label.lstrip("!?").partition(".")[0]


def page_tree(events: list[tuple]) -> tuple[list, list[tuple[list, str]]]:
    """The page's tree, and its texts with the nodes that hold them (none of those that are no text)."""
    root: list = ["", 0, [], 1]
    path, deeper, hidden = [root], 0, 0
    texts: list[tuple[list, str]] = []

    def kid(label: str, flow: bool) -> list:
        parent = path[-1]
        if flow and not parent[1]:
            if not (parent[2] and parent[2][-1][0] == "~"):
                parent[2].append(["~", 1, [], 1])
            parent = parent[2][-1]
        if parent[1] or len(parent[2]) >= _WIDE:
            for x in parent[2]:
                if x[0] == label:
                    x[1] = 1
                    return x
        node = [label, int(flow), [], 1]
        parent[2].append(node)
        return node

    for e in events:
        if e[0] == "<":
            if hidden or len(path) > _DEPTH:
                hidden += bool(hidden) or e[2]
                deeper += not hidden
                continue
            node = kid(("!" if e[2] else "?" if e[3] else "") + e[1], e[1].partition(".")[0] in _FLOW)
            if e[2]:
                hidden = 1
            else:
                path.append(node)
        elif e[0] == ">":
            if hidden:
                hidden -= 1
            elif deeper:
                deeper -= 1
            else:
                path.pop()
        elif not hidden:
            texts.append((path[-1] if _tag(path[-1][0]) in _FLOW else kid("#", True), e[1]))
    return root, texts


def numbered(root: list) -> list[list]:
    """Nodes in order: a node before what it holds."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node[2]))
    return out


def kinds(node: list, depth: int = 3) -> dict[str, float]:
    """Labels below a node (flows count as what they hold), by how often they occur where the node does."""
    out: dict[str, float] = {}
    for x in node[2]:
        share = min(1.0, x[3] / node[3])
        own = "" if x[0] == "~" else x[0]
        if own:
            out[own] = max(out.get(own, 0.0), share)
        for k, v in (kinds(x, depth - 1) if depth else {}).items():
            k = f"{own}>{k}" if own else k
            out[k] = max(out.get(k, 0.0), share * v)
    return out


def likeness(x: dict[str, float], y: dict[str, float]) -> float:
    """Weighted Jaccard similarity of what two nodes hold, given as kinds."""
    both = sum(min(v, y[k]) for k, v in x.items() if k in y)
    either = sum(x.values()) + sum(y.values()) - both
    return both / either if either else 1.0


def align(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """Pairs of places of two lists of children that stand for each other, in order: the alignment with most likeness."""
    la, lb = [x[0] for x in a], [x[0] for x in b]
    if la == lb:
        return [(i, i) for i in range(len(a))]
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    held_a, held_b = [kinds(x) for x in a], [kinds(x) for x in b]
    like: dict[tuple[int, int], float] = {}
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1])
            if la[i] == lb[j]:
                like[i, j] = 0.2 + likeness(held_a[i], held_b[j])
                best[i][j] = max(best[i][j], best[i + 1][j + 1] + like[i, j])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if (i, j) in like and best[i][j] == best[i + 1][j + 1] + like[i, j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def merge(a: list, b: list, same_page: bool = False) -> list:
    """One node for what two nodes of one label describe."""
    loose = a[1] or b[1]
    out = [a[0], loose, _merged(a[2], b[2], bool(loose), same_page), max(a[3], b[3]) if same_page else a[3] + b[3]]
    if not loose and len(out[2]) > _WIDE:
        out[1], out[2] = 1, _merged(out[2], [], True, False)
    return out


def _merged(a: list[list], b: list[list], loose: bool, same_page: bool) -> list[list]:
    if loose:
        out: dict[str, list] = {}
        for side in (a, b):
            mine: set[str] = set()
            for x in side:
                out[x[0]] = merge(out[x[0]], x, same_page or x[0] in mine) if x[0] in out else x
                mine.add(x[0])
        return list(out.values())
    pairs, rows = align(a, b), []
    i = j = 0
    for p, q in [*pairs, (len(a), len(b))]:
        rows += [(x, 1) for x in a[i:p]] + [(x, 2) for x in b[j:q]]
        if p < len(a):
            rows.append((merge(a[p], b[q], same_page), 3))
        i, j = p + 1, q + 1
    done: list[tuple[list, int]] = []
    for x, sides in rows:
        last = done[-1] if done else None
        # What one side has more of joins its neighbour as a repeated group.
        if last and last[0][0] == x[0] and 3 in (sides, last[1]) and sides != last[1] and likeness(kinds(last[0]), kinds(x)) >= _OF_A_KIND:
            done[-1] = (merge(last[0], x, True), 3)
        else:
            done.append((x, sides))
    return [x for x, _ in done]


def squeeze(root: list) -> list:
    """A wrapper of at most _NODES nodes: lists fold by label, then parts are left to the elements that hold them."""

    def loosened(node: list) -> list:
        kids = _merged([loosened(x) for x in node[2]], [], True, False)
        return [node[0], 1, kids if len(kids) <= _LABELS else [], node[3]]

    def cut(node: list, depth: int) -> list:
        return [node[0], node[1], [cut(x, depth - 1) for x in node[2]] if depth else [], node[3]]

    if len(numbered(root)) > _NODES:
        root = loosened(root)
    depth = _DEPTH
    while len(numbered(root)) > _NODES:
        depth //= 2
        root = cut(root, depth)
    return root


def slots(page: list, wrapper: list) -> list[int]:
    """For each node of a page's tree, in order, its number in the wrapper: its own, or that of the element that holds it."""
    number = {id(x): i for i, x in enumerate(numbered(wrapper))}
    found: dict[int, int] = {}

    def rest(node: list, at: int) -> None:
        for x in numbered(node):
            found[id(x)] = at

    def walk(node: list, w: list) -> None:
        found[id(node)] = number[id(w)]
        kids, there = node[2], w[2]
        place: dict[int, list] = {}
        if w[1]:
            by_label = {x[0]: x for x in there}
            place = {i: by_label[x[0]] for i, x in enumerate(kids) if x[0] in by_label}
        elif kids:
            place = {i: there[j] for i, j in align(kids, there)}
            for order in (range(1, len(kids)), range(len(kids) - 2, -1, -1)):
                for i in order:
                    by = place.get(i - 1 if order.step > 0 else i + 1)
                    if i not in place and by is not None and by[0] == kids[i][0] and likeness(kinds(kids[i]), kinds(by)) >= _OF_A_KIND:
                        place[i] = by
        for i, x in enumerate(kids):
            if i in place:
                walk(x, place[i])
            else:
                rest(x, number[id(w)])

    walk(page, wrapper)
    return [found[id(x)] for x in numbered(page)]


def region(root: list, mass: list[float], no_article: set[int]) -> int:
    """The number of the container with most of the mass (given for each node's own texts), without that in no_article."""
    nodes = numbered(root)
    number = {id(x): i for i, x in enumerate(nodes)}
    total = [0.0 if i in no_article else m for i, m in enumerate(mass)]
    titles = [t if _tag(x[0]) == "h1" else 0.0 for x, t in zip(nodes, total, strict=True)]
    up: dict[int, int] = {}
    for i in range(len(nodes) - 1, -1, -1):
        for x in nodes[i][2]:
            k = number[id(x)]
            up[k] = i
            total[i] += total[k]
            titles[i] += titles[k]
    most = total[0]
    if most <= 0:
        return 0
    box = [x[0] == "" or x[0] != "~" and _tag(x[0]) not in _FLOW for x in nodes]
    in_flow = [False] * len(nodes)
    for i in range(1, len(nodes)):
        in_flow[i] = nodes[up[i]][0] == "~" or in_flow[up[i]]
    best = 0
    # Down to the innermost container that holds four fifths, and up again where its neighbours are titles, or headings and paragraphs in no container.
    down = True
    while down:
        down = False
        for x in nodes[best][2]:
            k = number[id(x)]
            if box[k] and not in_flow[k] and total[k] >= 0.8 * most:
                best, down = k, True
    while best in up:
        beside = [(x[0], number[id(x)]) for x in nodes[up[best]][2] if number[id(x)] != best]
        extra = total[up[best]] - total[best]
        if extra <= 0 or sum(total[k] if label == "~" else titles[k] for label, k in beside) < 0.9 * extra:
            break
        best = up[best]
    named = [i for i in range(len(nodes)) if _tag(nodes[i][0]) in _MAIN and total[i] >= 0.5 * total[best]]
    return max(named, key=lambda i: (_tag(nodes[i][0]) == "article", total[i], i)) if named else best


def template_parts(root: list) -> set[int]:
    """Nodes at or under one that is no text, or whose name isn't an article's."""
    out: set[int] = set()
    number = {id(x): i for i, x in enumerate(numbered(root))}
    todo = [(root, False)]
    while todo:
        node, drop = todo.pop()
        drop = drop or node[0][:1] in ("!", "?")
        if drop:
            out.add(number[id(node)])
        todo += [(x, drop) for x in node[2]]
    return out


def boilerplate(root: list, where: int, chars: list[int], fixed: list[float]) -> set[int]:
    """Slots within the region that are boilerplate, given the text of each and how much of it is fixed."""
    nodes = numbered(root)
    number = {id(x): i for i, x in enumerate(nodes)}
    all_chars, all_fixed = list(chars), list(fixed)
    for i in range(len(nodes) - 1, -1, -1):
        for x in nodes[i][2]:
            all_chars[i] += all_chars[number[id(x)]]
            all_fixed[i] += all_fixed[number[id(x)]]
    if all_fixed[where] >= _FIXED * all_chars[where]:
        return set()
    out: set[int] = set()
    todo = [(x, False) for x in nodes[where][2]]
    while todo:
        node, drop = todo.pop()
        i, tag = number[id(node)], _tag(node[0])
        if tag in _FLOW or node[0] == "~":
            here = "." in node[0] and tag not in _HEADINGS and chars[i] > 0 and fixed[i] >= _FIXED * chars[i]
        else:
            drop = drop or all_chars[i] > 0 and all_fixed[i] >= _FIXED * all_chars[i]
            here = False
        if drop or here:
            out.add(i)
        todo += [(x, drop) for x in node[2]]
    return out


def end_of(nodes: list[list], at: int) -> int:
    """The number after the last node that the one at `at` holds."""
    return at + len(numbered(nodes[at]))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) >> 1


def _shape(root: list) -> str:
    return json.dumps(root, ensure_ascii=False, separators=(",", ":"))


_COUNTED = "host string, shape long, tree string, leaf int, text long, chars long, pages long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to counts by host, shape, place and text; a row of null place has the shape's tree and counts pages."""
    trees: dict[tuple, list] = {}
    known: dict[tuple, list[int]] = {}

    def out() -> pa.RecordBatch:
        rows = [(h, s, tree, None, None, 0, n) for (h, s), (tree, n) in trees.items()] + [(*k[:2], None, *k[2:], *v) for k, v in known.items()]
        trees.clear()
        known.clear()
        types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in _COUNTED.split(", ")])

    for batch in slices(batches):
        for host, html in zip(batch.column(0).to_pylist(), as_texts(batch.column(1)), strict=True):
            root, texts = page_tree(stream(html))
            number = {id(x): i for i, x in enumerate(numbered(root))}
            tree = _shape(root)
            shape = _hash(tree)
            trees.setdefault((host, shape), [tree, 0])[1] += 1
            mine: dict[tuple, int] = {}
            for node, text in texts:
                k = (host, shape, number[id(node)], _hash(text))
                mine[k] = mine.get(k, 0) + len(text)
            for k, chars in mine.items():
                sums = known.setdefault(k, [0, 0])
                sums[0] += chars
                sums[1] += 1
        if len(known) > 50_000:
            yield out()
    yield out()


def _weighted(tree: str, pages: int) -> list:
    root = json.loads(tree)
    for x in numbered(root):
        x[3] = pages
    return root


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, salt, tree, pages, whole), sorted by host and salt, to one wrapper for each. `whole` trees are wrappers already."""
    now, wrapper, first = None, None, 0

    def out() -> pa.RecordBatch:
        rows = [] if now is None else [(now[0], first, _shape(squeeze(wrapper)), wrapper[3], True)]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["host", "shape", "tree", "pages", "whole"])

    for batch in slices(batches, 100):
        for host, salt, shape, tree, pages, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            root = json.loads(tree) if whole else _weighted(tree, pages)
            if now == (host, salt):
                wrapper = squeeze(merge(wrapper, root))
            else:
                yield out()
                now, wrapper, first = (host, salt), root, shape
    yield out()


def host_wrappers(shapes: DataFrame, together: int = 64) -> DataFrame:
    """host, tree, pages: one wrapper for each host. In a round, a task aligns about `together` trees of a host at a time."""
    left = stored(shapes.select("host", "shape", "tree", "pages", F.lit(False).alias("whole")), "wrappers")
    while True:
        salts = F.ceil(F.col("c") / together).cast("long")
        salted = left.join(left.groupBy("host").agg(F.count(F.lit(1)).alias("c")), "host").withColumn("salt", F.pmod("shape", salts))
        ordered = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", F.desc("pages"), "shape")
        left = stored(ordered.select("host", "salt", "shape", "tree", "pages", "whole").mapInArrow(_unite, "host string, shape long, tree string, pages long, whole boolean"), "wrappers")
        if not left.groupBy("host").count().filter("count > 1").limit(1).count():
            return left.select("host", "tree", "pages")


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, shape, tree, wrapper) to (host, shape, leaf, slot): the places of a shape in its host's wrapper."""
    for batch in slices(batches, 100):
        rows = []
        for host, shape, tree, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [(host, shape, i, s) for i, s in enumerate(slots(json.loads(tree), json.loads(wrapper)))]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["host", "shape", "leaf", "slot"])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, tree, slots of (slot, mass, chars)) to (host, tree, region, share, fixed): share is that of varying text in each slot, in thousandths; fixed are the slots of boilerplate."""
    for batch in slices(batches, 100):
        regions, shares, dropped = [], [], []
        for tree, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            root = json.loads(tree)
            n = len(numbered(root))
            mass, share, chars, same = [0.0] * n, [1000] * n, [0] * n, [0.0] * n
            for s in found or ():
                i = s["slot"]
                mass[i], share[i] = s["mass"], max(0, 100 * s["mass"] // max(1, s["chars"]))
                chars[i], same[i] = s["chars"], (10 * s["chars"] - s["mass"]) / 8
            regions.append(region(root, mass, template_parts(root)))
            shares.append(share)
            dropped.append(sorted(boilerplate(root, regions[-1], chars, same)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(regions, pa.int32()), *(pa.array(x, pa.list_(pa.int32())) for x in (shares, dropped))], names=["host", "tree", "region", "share", "fixed"])


def host_plans(pages: DataFrame, most_broadcast: int = 50_000) -> DataFrame:
    """host, tree (the wrapper), region (a node's number), share, fixed (its slots of boilerplate)."""
    host, _ = host_and_path(F.col("url"))
    counted = stored(pages.select(host.alias("host"), "html").mapInArrow(_count, _COUNTED), "counts")
    shapes = stored(counted.filter("leaf is null").groupBy("host", "shape").agg(F.max("tree").alias("tree"), F.sum("pages").alias("pages")), "shapes")
    wrappers = host_wrappers(shapes)
    places = stored(join_checked(shapes.select("host", "shape", "tree"), wrappers.select("host", F.col("tree").alias("wrapper")), ["host"], most_broadcast // 50, "inner").mapInArrow(_place, "host string, shape long, leaf int, slot int"), "places")
    texts = counted.filter("leaf is not null").groupBy("host", "shape", "leaf", "text").agg(F.sum("chars").alias("chars"), F.sum("pages").alias("pages"))
    texts = join_checked(texts, places, ["host", "shape", "leaf"], most_broadcast, "inner").groupBy("host", "slot", "text").agg(F.sum("chars").alias("chars"), F.sum("pages").alias("pages"))
    texts = join_checked(texts, wrappers.select("host", F.col("pages").alias("of")), ["host"], most_broadcast, "inner").withColumn("fixed", (F.col("pages") >= _SEVERAL) & (2 * F.col("pages") > F.col("of")))
    # Weights of 10 and 2, so that sums are whole numbers.
    mass = texts.groupBy("host", "slot").agg(F.sum(F.col("chars") * F.when(F.col("fixed"), 2).otherwise(10)).alias("mass"), F.sum("chars").alias("chars"))
    mass = mass.groupBy("host").agg(F.collect_list(F.struct("slot", "mass", "chars")).alias("slots"))  # as many as nodes of a wrapper
    return wrappers.join(mass, "host", "left").select("host", "tree", "slots").mapInArrow(_choose, "host string, tree string, region int, share array<int>, fixed array<int>")


class Host:
    """What a host's pages are read by."""

    def __init__(self, tree: str, where: int, share: list[int], fixed: list[int]):
        self.wrapper = json.loads(tree)
        self.nodes = numbered(self.wrapper)
        self.inside = range(where, end_of(self.nodes, where))
        self.share = share
        self.named = template_parts(self.wrapper)
        self.dropped = self.named | set(fixed)
        self.known: dict[int, list[int]] = {}

    def read(self, html: str) -> str:
        root, texts = page_tree(stream(html))
        if not texts:
            return ""
        nodes = numbered(root)
        number = {id(x): i for i, x in enumerate(nodes)}
        shape = _hash(_shape(root))
        if shape not in self.known:
            if len(self.known) > 1000:
                self.known.clear()
            self.known[shape] = slots(root, self.wrapper)
        slot = self.known[shape]
        if self.inside.start in slot:
            keep = [slot[number[id(node)]] in self.inside for node, _ in texts]
        else:
            mass = [0.0] * len(nodes)
            out = {i for i, s in enumerate(slot) if s in self.named}
            for node, text in texts:
                i = number[id(node)]
                mass[i] += len(text) * self.share[slot[i]] / 1000
            where = region(root, mass, out)
            mine = range(where, end_of(nodes, where))
            keep = [number[id(node)] in mine for node, _ in texts]
        blocks = []
        for (node, text), ours in zip(texts, keep, strict=True):
            if ours and slot[number[id(node)]] not in self.dropped:
                blocks.append(text)
        return "\n".join(blocks)


_READ = "page_id long, url string, text string, n_chars long"


def _out(ids: pa.Array, urls: pa.Array, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _read(plans):
    """(page_id, url, html, host), or with broadcast plans missing, also the plan's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Host] = {}
        for batch in slices(batches):
            texts = []
            hosts = batch.column(3).to_pylist()
            for i, (host, html) in enumerate(zip(hosts, as_texts(batch.column(2)), strict=True)):
                if host not in known:
                    if len(known) > 200:
                        known.clear()
                    known[host] = Host(*(plans.value[host] if plans else (batch.column(c)[i].as_py() for c in range(4, 8))))
                texts.append(known[host].read(html))
            yield _out(batch.column(0), batch.column(1), texts)

    return run


def main_text(pages: DataFrame, most_broadcast: int = 50_000, most_bytes: int = 50_000_000) -> DataFrame:
    """page_id, url, text, n_chars, one row for each page. Plans of up to most_bytes in all are broadcast; beyond, pages are joined with them."""
    bound_batches(pages.sparkSession)
    plans = stored(host_plans(pages, most_broadcast), "plans")
    host, _ = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    bulk = plans.agg(F.coalesce(F.sum(F.octet_length("tree") + 4 * F.size("share") + 4 * F.size("fixed")), F.lit(0))).first()[0]
    if bulk <= most_bytes:
        known = {r["host"]: (r["tree"], r["region"], r["share"], r["fixed"]) for r in plans.collect()}
        return rows.mapInArrow(_read(pages.sparkSession.sparkContext.broadcast(known)), _READ)
    return rows.join(plans.hint("merge"), "host").select("page_id", "url", "html", "host", "tree", "region", "share", "fixed").mapInArrow(_read(None), _READ)
