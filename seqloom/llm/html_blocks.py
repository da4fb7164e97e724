"""HTML to its sequence of leaf blocks: one pass with a regular expression, a stack of open elements, no tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache
from html import unescape

#: Fixed values. Elements that do not end a block; all others do. br is white space inside a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Fixed values. Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed values. Elements whose content is not markup; of these, the ones with no text for readers.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNREAD = frozenset("script style iframe noembed noframes".split())
#: Fixed values. An opening tag of the first ends an open element of the second.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
#: Fixed values. Elements that an open p does not hold.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Fixed values. Elements beyond which an end tag of p or li does not reach.
SCOPE = frozenset("html table td th caption button".split())
#: Fixed values. Elements beyond which the elements of CLOSES are not ended.
LISTS = frozenset("ul ol dl table select menu".split())

_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|(?<==)"[^"]*"|(?<==)'[^']*'|(?<==[ \t\n])"[^"]*"|(?<==[ \t\n])'[^']*'|["'])*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+|\d+")
_SPACE = re.compile(r"\s+")


@cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I)


@dataclass(slots=True)
class Block:
    text: str
    node: int  # the innermost open element that ends blocks, -1 if none
    linked: int  # characters of text inside links


@dataclass(slots=True)
class Page:
    """blocks, and the elements that end blocks in order of their start: parent (-1: none), entry (name and the words of class, id and
    role) and fresh, the words of the entry that no open element around it has, the name as <name."""

    blocks: list[Block] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    entry: list[tuple[str, ...]] = field(default_factory=list)
    fresh: list[list[str]] = field(default_factory=list)

    def path(self, b: Block) -> tuple[str, ...]:
        """The entries of a block's elements as text, from the outermost."""
        out, node = [], b.node
        while node >= 0:
            out.append(" ".join(self.entry[node]))
            node = self.parent[node]
        return tuple(out[::-1])


def _names(attrs: str) -> tuple[str, ...]:
    """The words of class, id and role."""
    found = []
    for m in _NAMES.finditer(attrs):
        found += _WORD.findall((m[1] or m[2] or m[3] or "").lower())
    return tuple(found)


def blocks(html: str) -> Page:
    """The non-empty blocks of a page in order: the text between two tags that end a block, character references decoded, white
    space made single spaces. Comments, scripts and styles have no text; an unfinished tag at the end is markup. The work
    is in proportion to the page, however deep its elements lie in each other."""
    page = Page()
    stack: list[tuple[str, int]] = []  # (element, its node)
    open_names: dict[str, list[int]] = {}  # depths of the open elements of each name
    around: dict[str, int] = {}  # words of the open elements' entries
    parts: list[str] = []
    linked, link_at = 0, -1
    at, size = 0, len(html)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                page.blocks.append(Block(text, stack[-1][1] if stack else -1, linked))
            parts, linked = [], 0

    def push(name: str, words: tuple[str, ...]) -> None:
        entry = (name, *words)
        fresh = []
        for t in (f"<{name}", *words):
            if not around.get(t):
                fresh.append(t)
            around[t] = around.get(t, 0) + 1
        open_names.setdefault(name, []).append(len(stack))
        page.parent.append(stack[-1][1] if stack else -1)
        page.entry.append(entry)
        page.fresh.append(fresh)
        stack.append((name, len(page.entry) - 1))

    def pop(to: int) -> None:
        nonlocal link_at
        while len(stack) > to:
            name, node = stack.pop()
            open_names[name].pop()
            around[f"<{name}"] -= 1
            for t in page.entry[node][1:]:
                around[t] -= 1
        if link_at > to:
            link_at = -1

    def innermost(names) -> int:
        """The depth of the innermost open element of one of some names, -1 if there is none."""
        return max((open_names[x][-1] for x in names if open_names.get(x)), default=-1)

    def add(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if link_at >= 0:
            linked += len(text)

    while at < size:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                link_at = -1 if m[1] else len(stack)
            continue
        flush()
        if m[1]:
            i = innermost((name,))
            if i >= 0 and not (name in ("p", "li") and innermost(SCOPE) > i):
                pop(i)
            continue
        if name in ENDS_P:
            i = innermost(("p",))
            if i >= 0 and innermost(SCOPE) < i:
                pop(i)
        if name in CLOSES:
            i = innermost(CLOSES[name])
            if i >= 0 and innermost(LISTS) < i:
                pop(i)
        if name in VOID:
            continue
        push(name, _names(m[3]))
        if name in RAW:
            end = _end_of(name).search(html, at)
            if name not in UNREAD:
                add(html[at : end.start() if end else size])
                flush()
            at = end.end() if end else size
            pop(len(stack) - 1)
    flush()
    return page
