"""Main text of web pages by wrapper induction over the pages of a host.

The pages of a host are laid over each other by simple tree matching: two nodes match if their
labels (tag, class and id without digits) are equal, and the children of matched nodes are
aligned, in order, so that most nodes match.  The result, a wrapper, is the union of the pages'
trees.  Plain runs of text-level siblings (paragraphs, headings, lists, tables) are one slot,
whatever their number.  Of every slot it holds how many pages have it, how much text and how
much of that is links, and what of it is the same on all pages: the whole, or first or last
blocks.  That constant part is template; what varies is content, unless its element
says that it is none (menus, adverts, comments, ...) or it consists of links.

Two passes over the pages: each task folds its pages into one wrapper a host, whatever the
number of pages, and the few partial wrappers are folded again, streaming, after a shuffle;
then each page is aligned with its host's wrapper, which travels with the rows by a broadcast
join if all wrappers together are small (they are measured), else by a salted join.

A wrapper that grows too large sheds its rare parts and is marked.  It then only says which
parts of the host's pages belong together: all their slots are counted anew as rows, by host and
place in the wrapper, those it lacks by their labels and order between its parts, and each page
takes the counts of its own places.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import (
    BROADCAST_ROWS,
    Columns,
    batchwise,
    materialized,
    text_or_empty,
)

# A part is template if at least so many pages have it and all agree.
AGREEING = 8
# First and last blocks of a slot that are followed.
EDGE_BLOCKS = 32
# Deeper elements count as part of the one at this depth.
DEPTH = 200
# Above this many pairs of siblings, children are matched in order by label alone.
PAIRS = 250_000
# A wrapper with more nodes sheds those on fewer than an eighth of its pages, and its host's slots
# are counted as rows.
NODES = 4_000
# Nodes of all hosts that a task holds before it hands its wrappers on.
HELD_NODES = 200_000
# Bytes of all wrappers up to which they are broadcast, and salts of the join beyond.
BROADCAST_BYTES = 32 << 20
SALTS = 16

# Elements by what HTML says about them, and words of classes and ids.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt "
    "ruby s samp small span strike strong sub sup time tt u var".split()
)
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
FLOW = frozenset(
    "address blockquote caption center dd details dir dl dt figcaption figure h1 h2 h3 h4 h5 h6 "
    "hgroup hr li ol p pre summary table tbody td tfoot th thead tr ul".split()
)
NO_TEXT = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head map menu nav noscript "
    "object optgroup option output progress select svg template video".split()
)
NO_TEXT_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
    "search searchbox toolbar tooltip".split()
)
# Never text of the article, wherever they stand.
NO_TEXT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors comment "
    "comments commentlist disqus replies cookie cookies consent gdpr newsletter popup modal share "
    "sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager "
    "notice notices".split()
)
# Parts of a page's frame, unless they hold the article or its headline.
FRAME_WORDS = frozenset(
    "header masthead topbar footer sidebar menu menus nav navbar navigation banner promo promos "
    "widget widgets search toolbar login signup subscribe copyright alert".split()
)
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_DIGITS = re.compile(r"\d+")


class Block:
    """Text between block boundaries, white space made single."""

    __slots__ = ("headline", "links", "text")

    def __init__(self, text: str, links: int, headline: bool):
        self.text, self.links, self.headline = text, links, headline


class Element:
    """A block element: its label, what it is, and children (elements and blocks)."""

    __slots__ = ("children", "frame", "label", "main", "plain", "shut", "tag")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.children = tag, []
        self.shut = tag in NO_TEXT
        self.frame = False
        self.main = tag if tag in ("article", "main") else None
        self.plain = tag in FLOW
        self.label = tag
        if attributes and not attributes.isspace():
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        values = {}
        for name, value in _ATTRIBUTE.findall(attributes):
            values.setdefault(name.lower(), html.unescape(value.strip("\"'")))
        role = values.get("role", "").strip().lower()
        if role in ("article", "main"):
            self.main = role
        names = f"{values.get('class', '')} {values.get('id', '')}"
        if not names.isspace():
            self.plain = False
            self.label += "." + " ".join(sorted(_DIGITS.sub("", names.lower()).split()))
        if self.main or self.tag in ("html", "body"):
            words = set(names.lower().split())
        else:
            words = {w.lower() for w in _WORD.findall(names)}
            self.frame = bool(words & FRAME_WORDS)
        self.shut = (
            self.shut
            or role in NO_TEXT_ROLES
            or bool(words & NO_TEXT_WORDS)
            or "hidden" in values
            or values.get("aria-hidden", "").lower() == "true"
            or bool(_HIDDEN.search(values.get("style", "")))
        )


def parse(page: str) -> Element:
    """The tree of a page's block elements; markup that ends nowhere ends with the page."""
    root = Element("html", "")
    stack = [root]
    pieces: list[str] = []
    links = 0
    in_link = False

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                stack[-1].children.append(Block(text, min(links, len(text)), stack[-1].tag == "h1"))
            pieces.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if in_link:
            links += len(text)

    def close(names: set[str], within: set[str]) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in names:
                del stack[at:]
                return
            if stack[at].tag in within:
                return

    at = 0
    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        name = token[2] or token[5]
        if name is None:
            continue
        name = name.lower()
        ends = bool(token[1] or token[4])
        if name in INLINE:
            if name == "a":
                in_link = not ends
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in RAW and not ends:
            end = re.compile(f"</{name}(?![a-zA-Z0-9])[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID and name != "hr":
            continue
        flush()
        if name == "html" or name == "hr":
            continue
        if stack[-1].tag == "p":
            stack.pop()
        if ends:
            if name not in ("p", "body"):
                close({name}, {"html"})
            continue
        if name in CLOSED_BY:
            close(*CLOSED_BY[name])
        element = Element(name, token[3] or token[6] or "")
        if len(stack) < DEPTH:
            stack[-1].children.append(element)
            stack.append(element)
    flush()
    return root


class Slot:
    """Blocks of a run of text-level siblings."""

    __slots__ = ("blocks",)
    label = "#"

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks


class Tree:
    """An element with its children as trees and slots, ready to be aligned."""

    __slots__ = ("children", "element", "holds_main", "label")

    def __init__(self, element: Element, children: list):
        self.element, self.label, self.children = element, element.label, children
        self.holds_main = bool(element.main) or any(
            c.holds_main if isinstance(c, Tree) else any(b.headline for b in c.blocks)
            for c in children
        )


def _blocks(item: Element | Block) -> list[Block] | None:
    """The blocks of a text-level subtree, None for any other."""
    if isinstance(item, Block):
        return [item]
    if not item.plain or item.shut or item.main:
        return None
    found: list[Block] = []
    for child in item.children:
        inner = _blocks(child)
        if inner is None:
            return None
        found += inner
    return found


def tree(element: Element) -> Tree:
    children: list[Tree | Slot] = []
    for item in element.children:
        blocks = _blocks(item)
        if blocks is None:
            children.append(tree(item))
        elif blocks:
            if children and isinstance(children[-1], Slot):
                children[-1].blocks += blocks
            else:
                children.append(Slot(blocks))
    return Tree(element, children)


# A wrapper node is a dict, as it travels: l label, n pages, k children; a slot has no k but
# c characters, a of links, h hash of the whole text (None where pages differ), and first and
# last blocks that pages agree on as (hash, characters).


def _hash(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=8).hexdigest()


def _edge(blocks: list[Block]) -> list[list]:
    # A headline belongs to the article even if it is always the same.
    return [[None if b.headline else _hash(b.text), len(b.text)] for b in blocks]


def wrap(item: Tree | Slot) -> dict:
    """The wrapper of a single page."""
    if isinstance(item, Slot):
        blocks = item.blocks
        first = _edge(blocks[:EDGE_BLOCKS])
        return {
            "l": "#",
            "n": 1,
            "c": sum(len(b.text) for b in blocks),
            "a": sum(b.links for b in blocks),
            "h": None
            if any(b.headline for b in blocks)
            else _hash("\n".join(b.text for b in blocks)),
            "first": first,
            "last": first[::-1]
            if len(blocks) <= EDGE_BLOCKS
            else _edge(blocks[: -EDGE_BLOCKS - 1 : -1]),
        }
    return {"l": item.label, "n": 1, "k": [wrap(c) for c in item.children]}


def _label(node) -> str:
    return node["l"] if isinstance(node, dict) else node.label


def _children(node) -> list:
    return node.get("k", ()) if isinstance(node, dict) else getattr(node, "children", ())


def matching(one, other) -> int:
    """Simple tree matching: the most pairs of nodes matched in order, from the roots down."""
    if _label(one) != _label(other):
        return 0
    a, b = _children(one), _children(other)
    if len(a) * len(b) > PAIRS:
        return 1 + len(aligned(one, other))
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(max(before[j + 1], row[j], before[j] + matching(x, y)))
    return 1 + row[-1]


def aligned(one, other) -> list[tuple[int, int]]:
    """Places of the children of two matched nodes that belong together, in order."""
    a, b = _children(one), _children(other)
    if [_label(x) for x in a] == [_label(y) for y in b]:
        return [(i, i) for i in range(len(a))]
    if len(a) * len(b) > PAIRS:
        places: dict[str, list[int]] = {}
        for k, y in enumerate(b):
            places.setdefault(_label(y), []).append(k)
        pairs, after = [], 0
        for i, x in enumerate(a):
            same = places.get(_label(x), [])
            at = bisect_left(same, after)
            if at < len(same):
                pairs.append((i, same[at]))
                after = same[at] + 1
        return pairs
    scores = [[matching(x, y) for y in b] for x in a]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + scores[i][j])
    pairs = []
    i = j = 0
    while i < len(a) and j < len(b):
        if scores[i][j] and best[i][j] == best[i + 1][j + 1] + scores[i][j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return pairs


def _agreeing(one: list, other: list) -> list:
    same = 0
    while same < min(len(one), len(other)) and one[same] == other[same] and one[same][0]:
        same += 1
    return one[:same]


def merged(one: dict, other: dict) -> dict:
    """The wrapper of the pages of both; unmatched children keep their order."""
    if "k" not in one:
        return {
            "l": "#",
            "n": one["n"] + other["n"],
            "c": one["c"] + other["c"],
            "a": one["a"] + other["a"],
            "h": one["h"] if one["h"] == other["h"] else None,
            "first": _agreeing(one["first"], other["first"]),
            "last": _agreeing(one["last"], other["last"]),
        }
    children, i, j = [], 0, 0
    a, b = one["k"], other["k"]
    for x, y in [*aligned(one, other), (len(a), len(b))]:
        children += a[i:x] + b[j:y]
        if x < len(a) and y < len(b):
            children.append(merged(a[x], b[y]))
        i, j = x + 1, y + 1
    return {"l": one["l"], "n": one["n"] + other["n"], "k": children}


def _size(node: dict) -> int:
    return 1 + sum(map(_size, node.get("k", ())))


def _without_rare(node: dict, least: int) -> dict:
    if "k" not in node:
        return node
    return node | {"k": [_without_rare(c, least) for c in node["k"] if c["n"] >= least]}


def folded(one: dict | None, other: dict) -> dict:
    """``merged``, kept to a size: a wrapper that shed rare parts is marked as ``shed``."""
    if one is None:
        return other
    both = merged(one, other)
    if "shed" in one or "shed" in other:
        both["shed"] = 1
    if both["n"] >= 8 * AGREEING and _size(both) > NODES:
        return _without_rare(both, both["n"] // 8) | {"shed": 1}
    return both


def _constant(slot: dict) -> int:
    """Characters of a slot that are the same on all its pages."""
    if slot["n"] < AGREEING:
        return 0
    if slot["h"]:
        return slot["c"] // slot["n"]
    return sum(n for _, n in slot["first"]) + sum(n for _, n in slot["last"])


def _amounts(node: dict) -> tuple[int, int]:
    """Characters of a wrapper's subtree: constant ones and all, added up over the pages."""
    if "m" in node:
        return tuple(node["m"])
    if "k" not in node:
        return _constant(node) * node["n"], node["c"]
    amounts = [_amounts(c) for c in node["k"]]
    return sum(a for a, _ in amounts), sum(b for _, b in amounts)


def _varying(slot: Slot, model: dict | None, in_article: bool) -> list[Block]:
    """The blocks of a slot that are neither template nor a menu."""
    if model is None or model["n"] < AGREEING:
        if in_article:
            return slot.blocks
        text = sum(len(b.text) for b in slot.blocks)
        return slot.blocks if 2 * sum(b.links for b in slot.blocks) <= text else []
    if not in_article and 2 * model["a"] > model["c"]:
        return []
    blocks = slot.blocks
    if model["h"] is not None and model["h"] == _hash("\n".join(b.text for b in blocks)):
        return []
    start, stop = 0, len(blocks)
    for known, _ in model["first"]:
        if start == stop or _hash(blocks[start].text) != known:
            break
        start += 1
    for known, _ in model["last"]:
        if start == stop or _hash(blocks[stop - 1].text) != known:
            break
        stop -= 1
    return blocks[start:stop]


def _shut(item: Tree, in_main: bool) -> bool:
    """Whether an element is no text of the article by its kind or name."""
    element = item.element
    if element.shut:
        return True
    frame = element.frame or (element.tag == "header" and not in_main)
    return frame and not item.holds_main


def _mains(item: Tree, kind: str, model: dict | None) -> list[tuple[Tree, dict | None]]:
    """Outermost article or main elements with what the wrapper has for them."""
    if _shut(item, False):
        return []
    if item.element.main == kind:
        return [(item, model)]
    return [
        found
        for child, known in _with_models(item, model)
        if isinstance(child, Tree)
        for found in _mains(child, kind, known)
    ]


def _with_models(item: Tree, model: dict | None) -> list[tuple]:
    known = [None] * len(item.children)
    if model is not None:
        for i, j in aligned(model, item):
            known[j] = model["k"][i]
    return list(zip(item.children, known))


def _content(item: Tree, model: dict | None, in_article: bool) -> Iterator[str]:
    for child, known in _with_models(item, model):
        if isinstance(child, Slot):
            yield from (b.text for b in _varying(child, known, in_article))
        elif not _shut(child, in_article):
            yield from _content(child, known, in_article)


def main_text(page: str, wrapper: dict | None) -> str:
    """The varying text of a page's article, else of its main element, else of all of it.

    Where half and more of an article is the same on all pages, the pages are copies of each
    other rather than filled from a template, and the whole counts.
    """
    return _main_text(tree(parse(page)), wrapper)


def _main_text(root: Tree, wrapper: dict | None) -> str:
    for kind in ("article", "main", None):
        found = _mains(root, kind, wrapper) if kind else [(root, wrapper)]
        lines = []
        for item, model in found:
            if kind and model is not None:
                constant, total = _amounts(model)
                if 2 * constant >= total:
                    model = None
            lines += _content(item, model, kind is not None)
        if found:
            break
    if not lines and wrapper is not None:
        return _main_text(root, None)
    return "\n".join(lines)


# A place is the way from the root to a node of a page: numbers of wrapper nodes, and below a part
# that the wrapper lacks the gap it stands in, its rank among equal ones there and its label.
_STEP, _LACKING = "\x1f", ":"
# The slot of a place that is not looked up: too few pages have it.
_UNKNOWN = {"l": "#", "n": 0, "c": 0, "a": 0, "h": None, "first": [], "last": []}


def _placed(item: Tree, model: dict | None, place: str) -> list[tuple]:
    """Children of a page's node with what the wrapper has for them and their places."""
    pairs = {j: i for i, j in aligned(model, item)} if model is not None else {}
    ranks: dict[tuple[int, str], int] = {}
    found, gap = [], 0
    for j, child in enumerate(item.children):
        if j in pairs:
            gap = pairs[j] + 1
            found.append((child, model["k"][pairs[j]], f"{place}{_STEP}{pairs[j]}"))
            continue
        rank = ranks[gap, child.label] = ranks.get((gap, child.label), -1) + 1
        step = f"{gap}{_LACKING}{rank}{_LACKING}{_hash(child.label)}"
        found.append((child, None, f"{place}{_STEP}{step}"))
    return found


def _places(item: Tree, model: dict | None, place: str = "") -> Iterator[tuple[str, Slot | None]]:
    """Places of a page's slots, and, without a slot, of its article and main elements."""
    if item.element.main:
        yield place, None
    for child, known, at in _placed(item, model, place):
        if isinstance(child, Slot):
            yield at, child
        else:
            yield from _places(child, known, at)


def _counted(item: Tree, model: dict | None, counts: dict, place: str = "") -> dict:
    """A wrapper of just the parts of a page, with the counts of their places on all pages."""
    children = [
        counts.get(at, _UNKNOWN) if isinstance(child, Slot) else _counted(child, known, counts, at)
        for child, known, at in _placed(item, model, place)
    ]
    node = {"l": item.label, "n": 1, "k": children}
    return node | {"m": counts[place]} if place in counts else node


def _fold_pages(batches: Iterator[Columns]) -> Iterator[Columns]:
    """One wrapper a host of a task's pages, or several where hosts are very many."""
    known: dict[str, dict] = {}
    nodes = 0

    def out() -> Columns:
        return {"host": list(known), "wrapper": [json.dumps(w) for w in known.values()]}

    for columns in batches:
        for host, page in zip(columns["host"], columns["html"]):
            before = known.get(host)
            known[host] = folded(before, wrap(tree(parse(page))))
            nodes += _size(known[host]) - (_size(before) if before else 0)
            if nodes > HELD_NODES:
                yield out()
                known.clear()
                nodes = 0
    if known:
        yield out()


def _fold_wrappers(batches: Iterator[Columns]) -> Iterator[Columns]:
    """Rows come sorted by host; one wrapper is held at a time."""
    current, wrapper = None, None
    for columns in batches:
        done: Columns = {"host": [], "wrapper": []}
        for host, text in zip(columns["host"], columns["wrapper"]):
            if host != current and wrapper is not None:
                done["host"].append(current)
                done["wrapper"].append(json.dumps(wrapper))
                wrapper = None
            current, wrapper = host, folded(wrapper, json.loads(text))
        if done["host"]:
            yield done
    if wrapper is not None:
        yield {"host": [current], "wrapper": [json.dumps(wrapper)]}


def _texts(batches: Iterator[Columns]) -> Iterator[Columns]:
    known: dict[str, dict] = {}
    for columns in batches:
        texts = []
        for host, wrapper, page in zip(columns["host"], columns["wrapper"], columns["html"]):
            texts.append(main_text(page, _loaded(known, host, wrapper)))
        yield {"page_id": columns["page_id"], "url": columns["url"], "text": texts}


def _place_rows(batches: Iterator[Columns]) -> Iterator[Columns]:
    """Slots of a task's pages, those of equal places merged; no slot for article and main elements."""
    wrappers: dict[str, dict] = {}
    known: dict[tuple[str, str], dict | None] = {}

    def out() -> Columns:
        return {
            "host": [host for host, _ in known],
            "place": [place for _, place in known],
            "slot": [s and json.dumps(s) for s in known.values()],
        }

    for columns in batches:
        for host, wrapper, page in zip(columns["host"], columns["wrapper"], columns["html"]):
            for place, slot in _places(tree(parse(page)), _loaded(wrappers, host, wrapper)):
                before = known.get((host, place))
                made = slot and wrap(slot)
                known[host, place] = merged(before, made) if before else made
            if len(known) > HELD_NODES:
                yield out()
                known.clear()
    if known:
        yield out()


def _fold_places(batches: Iterator[Columns]) -> Iterator[Columns]:
    """Rows come sorted by host and place; one slot is held at a time."""
    current, slot = None, None

    def out(done: Columns) -> None:
        values = (*current, slot and json.dumps(slot), slot and slot["n"])
        amounts = (_constant(slot) * slot["n"], slot["c"]) if slot else (None, None)
        for name, value in zip(done, (*values, *amounts)):
            done[name].append(value)

    for columns in batches:
        done: Columns = {c: [] for c in ("host", "place", "value", "n", "constant", "total")}
        for host, place, text in zip(columns["host"], columns["place"], columns["slot"]):
            if (host, place) != current:
                if current is not None:
                    out(done)
                current, slot = (host, place), None
            if text is not None:
                made = json.loads(text)
                slot = merged(slot, made) if slot else made
        if done["host"]:
            yield done
    if current is not None:
        done = {c: [] for c in ("host", "place", "value", "n", "constant", "total")}
        out(done)
        yield done


def _lacking_places(batches: Iterator[Columns]) -> Iterator[Columns]:
    """Places of each page that its host's wrapper lacks."""
    wrappers: dict[str, dict] = {}
    for columns in batches:
        found: Columns = {"host": [], "page": [], "place": []}
        for host, wrapper, key, page in zip(*(columns[c] for c in ("host", "wrapper", "page", "html"))):
            for place, _ in _places(tree(parse(page)), _loaded(wrappers, host, wrapper)):
                if _LACKING in place:
                    found["host"].append(host)
                    found["page"].append(key)
                    found["place"].append(place)
        yield found


def _counted_texts(batches: Iterator[Columns]) -> Iterator[Columns]:
    wrappers: dict[str, dict] = {}
    counts: dict[str, dict] = {}
    for columns in batches:
        texts = []
        names = ("host", "wrapper", "html", "usual", "own")
        for host, wrapper, page, usual, own in zip(*(columns[c] for c in names)):
            model = _loaded(wrappers, host, wrapper)
            if host not in counts:
                if len(counts) >= 256:
                    counts.clear()
                counts[host] = {p["place"]: json.loads(p["value"]) for p in usual or ()}
            there = counts[host] | {p["place"]: json.loads(p["value"]) for p in own or ()}
            root = tree(parse(page))
            texts.append(_main_text(root, _counted(root, model, there)))
        yield {"page_id": columns["page_id"], "url": columns["url"], "text": texts}


def _loaded(known: dict[str, dict], host: str, wrapper: str) -> dict:
    if host not in known:
        if len(known) >= 256:
            known.clear()
        known[host] = json.loads(wrapper)
    return known[host]


def _place_counts(rows: DataFrame) -> DataFrame:
    """Columns host, place and value (JSON) of the places that can be template.

    A slot on fewer pages than could agree is left out, as it counts like one that is not known.
    The value of an article or main element is its characters: constant ones and all.
    """
    counted = materialized(
        rows.select("host", "wrapper", "html")
        .transform(batchwise(_place_rows, "host string, place string, slot string"))
        .repartition("host", "place")
        .sortWithinPartitions("host", "place")
        .transform(
            batchwise(
                _fold_places,
                "host string, place string, value string, n long, constant long, total long",
            )
        )
    )
    steps = F.split("place", _STEP)
    above = F.transform(
        F.sequence(F.lit(1), F.size(steps) - 1),
        lambda k: F.array_join(F.slice(steps, F.lit(1), k), _STEP),
    )
    mains = counted.where("value IS NULL").select("host", "place")
    amounts = (
        counted.where("value IS NOT NULL")
        .select("host", F.explode(above).alias("place"), "constant", "total")
        .groupBy("host", "place")
        .agg(F.sum("constant").alias("constant"), F.sum("total").alias("total"))
        .join(mains, ["host", "place"])
        .select("host", "place", F.to_json(F.array("constant", "total")).alias("value"))
    )
    return materialized(
        counted.where(F.col("n") >= AGREEING).select("host", "place", "value").unionByName(amounts)
    )


def _shed_texts(rows: DataFrame, ddl: str) -> DataFrame:
    """Texts of pages whose host's wrapper shed parts."""
    counts = _place_counts(rows)
    entry = F.collect_list(F.struct("place", "value"))
    lacking = F.col("place").contains(_LACKING)
    # At most as many places as a wrapper has nodes.
    usual = counts.where(~lacking).groupBy("host").agg(entry.alias("usual"))
    rows = rows.withColumn("page", F.md5("html"))
    own = (
        rows.select("host", "wrapper", "page", "html")
        .transform(batchwise(_lacking_places, "host string, page string, place string"))
        .distinct()
        .join(counts.where(lacking), ["host", "place"])
        .groupBy("host", "page")
        .agg(entry.alias("own"))
    )
    return (
        rows.join(usual, "host", "left")
        .join(own, ["host", "page"], "left")
        .select("page_id", "url", "host", "wrapper", "html", "usual", "own")
        .transform(batchwise(_counted_texts, ddl))
    )


def host_wrappers(pages: DataFrame) -> DataFrame:
    """Columns host and wrapper (JSON), one row a host, from all pages."""
    hosts = "host string, wrapper string"
    partial = _with_host(pages).select("host", "html").transform(batchwise(_fold_pages, hosts))
    return (
        partial.repartition("host")
        # The order of equal hosts decides ties, so it must not depend on the shuffle.
        .sortWithinPartitions("host", "wrapper")
        .transform(batchwise(_fold_wrappers, hosts))
    )


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(
        text_or_empty("url"), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1
    )
    return pages.select(
        "page_id", "url", F.lower(host).alias("host"), text_or_empty("html").alias("html")
    )


def page_texts(pages: DataFrame) -> DataFrame:
    """Columns page_id, url, text and n_chars, one row a page.

    Blocks of text stand on lines of their own, white space inside made single.  A NULL or empty
    page has an empty text.  Pages without a URL, or one without a host, count as one host.
    Repeated pages are rows of their own; other columns are ignored.
    """
    shed = F.get_json_object("wrapper", "$.shed").isNotNull()
    wrappers = materialized(host_wrappers(pages).withColumn("shed", shed))
    size = wrappers.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum(F.octet_length("wrapper")).alias("bytes"),
        F.count_if("shed").alias("shed"),
    ).first()
    rows = _with_host(pages)
    if size.hosts <= BROADCAST_ROWS and (size.bytes or 0) <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(wrappers), "host")
    else:
        salted = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(
            salted, ["host", "salt"]
        )
    kind = dict(pages.dtypes)["page_id"]
    ddl = f"page_id {kind}, url string, text string"
    texts = (
        rows.where("NOT shed")
        .select("page_id", "url", "host", "wrapper", "html")
        .transform(batchwise(_texts, ddl))
    )
    if size.shed:
        texts = texts.unionByName(_shed_texts(rows.where("shed"), ddl))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
