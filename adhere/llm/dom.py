"""HTML as trees of blocks, folded to slots, and simple tree matching between them.

A tree holds block elements only; inline marks are read through. Text between
the borders of blocks is one leaf. A slot stands for an element or for all siblings that
repeat it: paragraphs, items and cells under one parent share a slot, and so do
neighbours of one class. The shape of a slot tree is a string, equal for pages built alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

# Element names of the HTML standard by their role here.
BLOCKS = frozenset("""
address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p
pre search section summary table tbody td tfoot th thead tr ul caption
""".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre blockquote figure figcaption hr #".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is no text of the page; without an end tag, those marked True reach to the page's end.
SKIPPED = {name: True for name in "script style textarea title xmp noframes".split()} | {
    name: False for name in "noscript iframe object svg canvas select button template audio video math".split()}
#: What an opening tag ends: itself or its like, up to the nearest of the list's containers.
ENDS = {"li": ("li", "ul ol menu dir"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"),
        "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
        "thead": ("thead tbody tfoot", "table"), "tbody": ("thead tbody tfoot", "table"),
        "tfoot": ("thead tbody tfoot", "table"), "option": ("option", "select")}
ENDS = {k: tuple(frozenset(x.split()) for x in v) for k, v in ENDS.items()}
SCOPE = frozenset("table td th caption html".split())
# End of the fixed values.

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|"
    r"<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?",
                       re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
NOT_WORD = re.compile(r"[^a-z0-9]+")
DIGITS = re.compile(r"\d+")
#: Elements nested deeper hang on the deepest one allowed; their text stays where it is.
DEPTH = 150


class Node:
    __slots__ = ("label", "kids", "text", "linked")

    def __init__(self, label: str, text: str = "", linked: int = 0) -> None:
        self.label, self.kids, self.text, self.linked = label, [], text, linked


@lru_cache(maxsize=4096)
def label(name: str, rest: str) -> str:
    """An element's name and the words of its attributes that tell its part in the page."""
    words = set()
    for key, *values in ATTRIBUTE.findall(rest) if rest and rest.strip() else ():
        key, value = key.lower(), unescape(next((v for v in values if v), ""))
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" \
                or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            words.add("hidden")
        elif key == "role":
            words.update("role=" + w for w in NOT_WORD.split(value.lower()) if w)
        elif key == "itemprop":
            words.update("prop=" + w for w in NOT_WORD.split(value.lower()) if w)
        elif key in ("class", "id"):
            for one in value.split():
                one = DIGITS.sub("0", "-".join(CAMEL.split(one)).lower())
                words.add(("id=" if key == "id" else "") + "-".join(filter(None, NOT_WORD.split(one))))
    words -= {"", "id="}
    return name + "".join(" " + w for w in sorted(words)) if name not in ("html", "body") else name


def tag(of: str) -> str:
    return of.partition(" ")[0]


def tree(html: str) -> Node:
    """The page's blocks; text in head, scripts and the like is left out, never anything after it."""
    root = Node("page")
    stack, tags = [root], ["page"]
    pieces: list[str] = []
    linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                stack[-1].kids.append(Node("#", text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def close(down_to: int) -> None:
        flush()
        del stack[down_to:], tags[down_to:]

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        raw = html[at:m.start() if m else size]
        if raw:
            text = unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked += len(" ".join(text.split()))
        if not m:
            break
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        ending = m["end"] or m["end2"]
        if name in SKIPPED and not ending:
            last = re.compile(f"</{name}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(html, at)
            if last:
                at = last.end()
            elif SKIPPED[name]:
                at = size
            continue
        if name == "a":
            in_link = not ending
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name not in BLOCKS:
            continue
        if ending:
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] == name or name in HEADINGS and tags[k] in HEADINGS:
                    close(k)
                    break
                if tags[k] in SCOPE or name == "li" and tags[k] in ("ul", "ol"):
                    flush()
                    break
            else:
                flush()
            continue
        flush()
        if tags[-1] == "p" or name in HEADINGS and tags[-1] in HEADINGS:
            close(len(tags) - 1)
        if name in ENDS:
            like, holders = ENDS[name]
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] in like:
                    close(k)
                    break
                if tags[k] in holders:
                    break
        if name == "hr" or len(stack) >= DEPTH or name in ("html", "body") and name in tags:
            continue
        node = Node(label(name, m["rest"] or m["rest2"] or ""))
        stack[-1].kids.append(node)
        stack.append(node)
        tags.append(name)
    flush()
    return root


class Slot:
    """An element of a wrapper, or all siblings that repeat it."""

    __slots__ = ("label", "kids", "leaves", "shape")

    def __init__(self, of: str) -> None:
        self.label, self.kids, self.leaves, self.shape = of, [], [], of

    def reshape(self) -> None:
        self.shape = self.label + "(" + ",".join([k.shape for k in self.kids]) + ")" if self.kids \
            else self.label

    def walk(self) -> Iterator[Slot]:
        """All slots, parents before children, in order."""
        todo = [self]
        while todo:
            slot = todo.pop()
            yield slot
            todo.extend(reversed(slot.kids))


def folded(node: Node, leaves: list[Node] | None = None) -> Slot:
    """The slots of a tree; a slot's ``leaves`` are its texts by their number in the page."""
    if leaves is None:
        leaves = []
    slot = Slot(node.label)
    if node.label == "#":
        slot.leaves.append(len(leaves))
        leaves.append(node)
        return slot
    repeats: dict[str, Slot] = {}
    for kid in node.kids:
        own = folded(kid, leaves)
        name = kid.label
        twin = repeats.get(name) if tag(name) in FLOW else (
            slot.kids[-1] if slot.kids and " " in name and slot.kids[-1].label == name else None)
        if twin is not None:
            merge(twin, own)
        else:
            repeats[name] = own
            slot.kids.append(own)
    slot.reshape()
    return slot


def page(html: str) -> tuple[Slot, list[Node]]:
    """(slots, texts in page order) of a page."""
    leaves: list[Node] = []
    return folded(tree(html), leaves), leaves


def matching(a: Slot, b: Slot, known: dict | None = None) -> int:
    """Simple tree matching: how many slots a largest match of two trees pairs, order and parents kept."""
    if a.label != b.label:
        return 0
    if a.shape == b.shape:
        return _size(a)
    known = {} if known is None else known
    key = id(a), id(b)
    if key not in known:
        head, tail = _equal_ends(a.kids, b.kids)
        ends = a.kids[:head] + a.kids[len(a.kids) - tail:]
        known[key] = 1 + sum(map(_size, ends)) + _table(
            a.kids[head:len(a.kids) - tail], b.kids[head:len(b.kids) - tail], known)[-1][-1]
    return known[key]


def _size(slot: Slot) -> int:
    return slot.shape.count("(") + slot.shape.count(",") + 1


def _equal_ends(left: list[Slot], right: list[Slot]) -> tuple[int, int]:
    """How many children are equal from the start and from the end; some largest match pairs them."""
    n = min(len(left), len(right))
    head = next((k for k in range(n) if left[k].shape != right[k].shape), n)
    tail = next((k for k in range(n - head) if left[-1 - k].shape != right[-1 - k].shape), n - head)
    return head, tail


def _table(left: list[Slot], right: list[Slot], known: dict) -> list[list[int]]:
    rows = [[0] * (len(right) + 1)]
    for a in left:
        above, row = rows[-1], [0]
        for j, b in enumerate(right):
            both = above[j] + matching(a, b, known) if a.label == b.label else 0
            row.append(max(above[j + 1], row[j], both))
        rows.append(row)
    return rows


def aligned(left: list[Slot], right: list[Slot], known: dict | None = None) -> list[tuple[int, int]]:
    """Places of the children that a largest match pairs, in order."""
    known = {} if known is None else known
    head, tail = _equal_ends(left, right)
    end_a, end_b = len(left) - tail, len(right) - tail
    mid_a, mid_b = left[head:end_a], right[head:end_b]
    pairs = []
    if mid_a and mid_b:
        rows = _table(mid_a, mid_b, known)
        i, j = len(mid_a), len(mid_b)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((head + i, head + j))
    return [(k, k) for k in range(head)] + pairs[::-1] + list(
        zip(range(end_a, len(left)), range(end_b, len(right))))


def merge(into: Slot, other: Slot) -> None:
    """Brings ``other`` into a tree of the same label: pairs become one slot, the rest is put in order."""
    into.leaves += other.leaves
    if into.shape == other.shape:
        for a, b in zip(into.kids, other.kids):
            merge(a, b)
        return
    pairs = aligned(into.kids, other.kids)
    kids, i, j = [], 0, 0
    for a, b in [*pairs, (len(into.kids), len(other.kids))]:
        kids += into.kids[i:a] + other.kids[j:b]
        if a < len(into.kids):
            merge(into.kids[a], other.kids[b])
            kids.append(into.kids[a])
        i, j = a + 1, b + 1
    into.kids = kids
    into.reshape()


def places(wrapper: Slot, own: Slot) -> list[int | None]:
    """For each slot of ``own`` in walking order, the number of the wrapper's slot it is aligned with."""
    number = {id(s): k for k, s in enumerate(wrapper.walk())}
    found: dict[int, int] = {}
    todo = [(wrapper, own)] if wrapper.label == own.label else []
    while todo:
        a, b = todo.pop()
        found[id(b)] = number[id(a)]
        todo += [(a.kids[i], b.kids[j]) for i, j in aligned(a.kids, b.kids)]
    return [found.get(id(s)) for s in own.walk()]


MARK = re.compile(r"[(),]|[^(),]+")


def from_shape(shape: str) -> Slot:
    """The slots a shape describes."""
    holder = Slot("")
    stack = [holder]
    for mark in MARK.findall(shape):
        if mark == "(":
            stack.append(stack[-1].kids[-1])
        elif mark == ")":
            stack.pop().reshape()
        elif mark != ",":
            stack[-1].kids.append(Slot(mark))
    return holder.kids[0]
