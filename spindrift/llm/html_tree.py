"""A forgiving HTML reader: block elements and their runs of text as one tree in page order."""

from __future__ import annotations

import html
import re
from collections import defaultdict

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no rendered text.
HIDDEN = frozenset("head script style template noscript iframe object svg canvas audio video map datalist".split())
RAW = frozenset("script style textarea title xmp iframe noframes noembed".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td textarea tfoot th thead tr ul button caption label".split()
)
#: A start tag closes these open elements, up to the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
_KEEPS_P = frozenset("button option optgroup select textarea label".split())
_ENDS_P = BLOCK - _KEEPS_P - {"html", "body", "li", "dd", "dt", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "legend"}
_LIMITS = frozenset("table td th caption button template html".split())
_REMARK = r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?"
_TOKEN = re.compile(rf"{_REMARK}|<(/?)([A-Za-z][^\s/>]*)", re.S)
#: What can still be a token where no ">" follows.
_LAST = re.compile(_REMARK, re.S)
_SPECIAL = re.compile("[>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label|data-[\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def names_of(attributes: str) -> list[str]:
    """Lower-cased parts of the names that class, id and role give."""
    if "=" not in attributes:
        return []
    return [p.lower() for m in _NAMES.finditer(attributes) for p in _PARTS.findall(m[1] or m[2] or m[3] or "")]


class _Tags:
    """Finds where tags end, quoted values of any length included, in time linear in the page."""

    def __init__(self, source: str):
        self.source = source
        #: by what is looked for: (from where, found at), which also answers later starts up to what was found
        self._known: dict[str, tuple[int, int]] = {}
        #: quotes from which on no ">" ends a tag
        self._open: set[int] = set()

    def _next(self, what: str, at: int) -> int:
        start, found = self._known.get(what, (len(self.source) + 1, -1))
        if not (start <= at and (found < 0 or found >= at)):
            if what == "special":
                match = _SPECIAL.search(self.source, at)
                found = match.start() if match else -1
            else:
                found = self.source.find(what, at)
            self._known[what] = at, found
        return found

    def end(self, at: int) -> int:
        """Where the ">" of a tag stands whose attributes start at ``at``: outside quoted values, else the first; -1 if there is none."""
        passed, here = [], at
        while (mark := self._next("special", here)) >= 0 and mark not in self._open:
            if self.source[mark] == ">":
                return mark
            passed.append(mark)
            close = self._next(self.source[mark], mark + 1)
            if close < 0:
                break
            here = close + 1
        self._open.update(passed)
        return self._next(">", at)


class Tree:
    """Nodes in page order, parents first. Elements have a tag, runs of text have the tag "#text".

    ``parent`` holds indices (-1 at the root), ``names`` the parts of class and id, ``text`` the run with
    references decoded and white space collapsed, ``linked`` the characters of it inside links.
    """

    def __init__(self, source: str):
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.names: list[list[str]] = [[]]
        self.text: list[str] = [""]
        self.linked: list[int] = [0]
        self._pieces: list[str] = []
        self._linked = 0
        #: open elements as (tag, node); inline ones have the node of their block
        self._open: list[tuple[str, int]] = [("#root", 0)]
        #: depths of the open elements by tag, of blocks other than p, and how many are hidden or links
        self._depths: defaultdict[str, list[int]] = defaultdict(list)
        self._blocks: list[int] = []
        self._counts = [0, 0]
        self._read(source)

    def _read(self, source: str) -> None:
        at, hidden, links = 0, 0, 0
        match, stack, tags = _TOKEN.search, self._open, _Tags(source)
        while True:
            found = match(source, at)
            if found is None:
                self._take(source[at:], hidden, links)
                break
            name = found[2] if found.re is _TOKEN else None
            end = tags.end(found.end()) if name else 0
            if end < 0:
                match = _LAST.search
                continue
            if found.start() > at:
                self._take(source[at : found.start()], hidden, links)
            at = end + 1 if name else found.end()
            if not name:
                continue
            tag = name.lower()
            if found[1]:
                if tag == "br":
                    self._take(" ", hidden, links)
                elif self._end(tag):
                    hidden, links = self._state()
                continue
            attributes = source[found.end() : end]
            if tag == "br":
                self._take(" ", hidden, links)
                continue
            if tag in _CLOSES:
                self._close(*_CLOSES[tag])
                hidden, links = self._state()
            elif tag in _ENDS_P:
                self._close({"p"}, _LIMITS)
                if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    self._pop(len(stack) - 1)
                hidden, links = self._state()
            if tag in VOID:
                if tag in BLOCK:
                    self._flush()
                continue
            if tag == "a" and links:
                self._end("a")
                hidden, links = self._state()
            node = stack[-1][1]
            if tag in BLOCK and not hidden:
                self._flush()
                node = self._add(tag, node, names_of(attributes))
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                end = close.start() if close else len(source)
                if tag == "textarea" and not hidden:
                    self._take(source[at:end], hidden, links, node)
                    self._flush(node)
                at = source.find(">", end) + 1 or len(source) if close else end
                continue
            self._depths[tag].append(len(stack))
            if tag in BLOCK and tag != "p":
                self._blocks.append(len(stack))
            stack.append((tag, node))
            self._counts[0] += tag in HIDDEN
            self._counts[1] += tag == "a"
            hidden, links = self._state()
        self._flush()

    def _state(self) -> tuple[int, int]:
        return self._counts[0], self._counts[1]

    def _add(self, tag: str, parent: int, names: list[str], text: str = "", linked: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1

    def _take(self, raw: str, hidden: int, links: int, node: int | None = None) -> None:
        if hidden:
            return
        self._pieces.append(raw)
        if links:
            self._linked += len(raw.strip())

    def _flush(self, node: int | None = None) -> None:
        """What was taken since the last block boundary becomes a run of the innermost block."""
        if self._pieces:
            # a reference is decoded within its own piece: tags between pieces end it
            text = " ".join("".join(html.unescape(p) if "&" in p else p for p in self._pieces).split())
            if text:
                self._add("#text", self._open[-1][1] if node is None else node, [], text, min(self._linked, len(text)))
            self._pieces = []
        self._linked = 0

    def _pop(self, depth: int) -> None:
        """Close open elements down to ``depth``; a block among them ends the run of text."""
        if any(t in BLOCK for t, _ in self._open[depth:]):
            self._flush()
        for tag, _ in reversed(self._open[depth:]):
            self._depths[tag].pop()
            if tag in BLOCK and tag != "p":
                self._blocks.pop()
            self._counts[0] -= tag in HIDDEN
            self._counts[1] -= tag == "a"
        del self._open[depth:]

    def _innermost(self, tags) -> int:
        """Depth of the innermost open element with one of ``tags``; 0 if there is none."""
        return max((self._depths[t][-1] for t in tags if self._depths.get(t)), default=0)

    def _close(self, tags: set, limits) -> None:
        depth = self._innermost(tags)
        if depth and depth >= self._innermost(limits):
            self._pop(depth)

    def _end(self, tag: str) -> bool:
        """An end tag closes the nearest open element of its name; others are ignored."""
        depth = self._innermost((tag,))
        if not depth or (tag not in BLOCK and tag not in HIDDEN and self._blocks and self._blocks[-1] > depth):
            return False
        self._pop(depth)
        return True
