"""A small document tree over the standard library's HTML parser, for the page operators.

Elements end where their end tag stands, or where the one around them ends; void elements never hold anything. Comments and
declarations are left out, and scripts, styles and templates have no text.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

#: Elements that hold nothing, and elements whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """All elements inside, in page order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def all(self, *tags: str, where: Callable[[Node], bool] | None = None) -> list[Node]:
        return [n for n in self.walk() if (not tags or n.tag in tags) and (where is None or where(n))]

    def first(self, *tags: str, where: Callable[[Node], bool] | None = None) -> Node | None:
        return next((n for n in self.walk() if (not tags or n.tag in tags) and (where is None or where(n))), None)

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            elif n is self or n.tag not in SILENT:
                stack += reversed(n.children)

    def text(self, between: str = "") -> str:
        """The strings inside, each without white space around it, empty ones left out."""
        return between.join(s for x in self.strings() if (s := x.strip()))

    def raw(self) -> str:
        return "".join(self.strings())

    def lengths(self) -> dict[int, int]:
        """The length of ``text()`` of each element inside, and of this one, by ``id``; one walk for all."""
        every = [self, *self.walk()]
        out = {id(n): sum(len(c.strip()) for c in n.children if isinstance(c, str)) for n in every}
        for n in reversed(every[1:]):
            if n.tag not in SILENT:
                out[id(n.parent)] += out[id(n)]
        return out

    def copy(self) -> Node:
        """The same tree once more, to be changed."""
        top = Node(self.tag, dict(self.attrs), None)
        stack = [(self, top)]
        while stack:
            n, new = stack.pop()
            for c in n.children:
                if isinstance(c, str):
                    new.children.append(c)
                else:
                    child = Node(c.tag, dict(c.attrs), new)
                    new.children.append(child)
                    stack.append((c, child))
        return top

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def take_apart(self) -> None:
        """The tree's end: without its circles it is freed at once."""
        for n in [self, *self.walk()]:
            n.parent = None
            n.children = []

    def attached(self, root: Node) -> bool:
        n = self
        while n is not None and n is not root:
            n = n.parent
        return n is root

    def html(self) -> str:
        out: list[str] = []
        stack: list[tuple[Node | str, bool]] = [(self, False)]
        while stack:
            n, done = stack.pop()
            if isinstance(n, str):
                out.append(n if done else _html.escape(n, False))
            elif done:
                out.append(f"</{n.tag}>")
            else:
                if n.tag != "#root":
                    out.append(f"<{n.tag}" + "".join(f' {k}="{_html.escape(v)}"' for k, v in n.attrs.items()) + ("/>" if n.tag in VOID else ">"))
                    if n.tag not in VOID:
                        stack.append((n, True))
                stack += [(c, n.tag in SILENT) for c in reversed(n.children)]
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {}, self.at)
        for k, v in attrs:
            n.attrs.setdefault(k, v or "")
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.open.get(tag):
            while True:
                was, self.at = self.at.tag, self.at.parent
                self.open[was] -= 1
                if was == tag:
                    return

    def handle_data(self, data):
        self.at.children.append(data)


#: Scripts and styles, where nothing is a reference, and references that no semicolon ends.
_OPEN_REFERENCE = re.compile(r"(<(script|style)\b.*?</\2\s*>)|&(?=#?\w+(?![\w;]))", re.I | re.S)


def parse(page: str | None, closed: bool = False) -> Node:
    """``closed``: a character reference without a semicolon is text, not a character as browsers read some of them."""
    b = _Builder()
    b.feed(_OPEN_REFERENCE.sub(lambda m: m[1] or "&amp;", page or "") if closed else page or "")
    b.close()
    return b.root


def named(pattern: str | re.Pattern, keys: tuple[str, ...] = ("class", "id")) -> Callable[[Node], bool]:
    """Whether the class (a word of it, or all of it) or the id of an element holds the pattern, in any case."""
    p = re.compile(pattern, re.I) if isinstance(pattern, str) else pattern

    def test(n: Node) -> bool:
        return any(k in n.attrs and p.search(n.attrs[k]) is not None for k in keys)

    return test


def has_class(*names: str) -> Callable[[Node], bool]:
    return lambda n: any(x in n.classes for x in names)


def inside(n: Node, *tags: str, where: Callable[[Node], bool] | None = None) -> bool:
    """Whether an element around ``n`` is one of these."""
    while (n := n.parent) is not None:
        if (not tags or n.tag in tags) and (where is None or where(n)):
            return True
    return False
