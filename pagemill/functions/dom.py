"""A small document tree: building it from markup, selecting elements, changing and writing it. No Spark in here."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends an open element of the values, looked for up to the nearest scope element.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select body html div section article main".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SILENT = frozenset("script style noscript template".split())
#: Levels of nesting beyond which elements stand side by side, so that no page, however deep, exhausts the stack.
DEPTH = 200


class Node:
    """An element. Children are nodes and strings; attributes are lower-cased names with their values."""

    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs or {}, [], None

    def append(self, kid: Node | str) -> None:
        if isinstance(kid, Node):
            kid.parent = self
        self.kids.append(kid)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.kids = [k for k in self.parent.kids if k is not self]
            self.parent = None

    def children(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]

    def walk(self) -> Iterator[Node]:
        """The element and all below, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if node.kids:
                stack.extend([k for k in reversed(node.kids) if isinstance(k, Node)])

    def text(self, silent: bool = False) -> str:
        """All text below, in order; that of scripts and the like only if asked for."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            elif silent or item.tag not in SILENT:
                stack.extend(reversed(item.kids))
        return "".join(out)

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def names(self) -> str:
        """Class and id in one string."""
        return f"{self.get('class')} {self.get('id')}".lower()

    def select(self, selector: str) -> list[Node]:
        """Elements below this one that the selector matches, in document order."""
        rules, tags, plain, every = _parsed(selector)
        return [n for n in self.walk() if (n.tag in tags or (plain and n.attrs) or every) and n is not self and any(_matches(n, r) for r in rules)]

    def first(self, selector: str) -> Node | None:
        rules, tags, plain, every = _parsed(selector)
        return next((n for n in self.walk() if (n.tag in tags or (plain and n.attrs) or every) and n is not self and any(_matches(n, r) for r in rules)), None)

    def matches(self, selector: str) -> bool:
        return any(_matches(self, r) for r in _parsed(selector)[0])

    def closest(self, selector: str) -> Node | None:
        node: Node | None = self
        while node is not None and not node.matches(selector):
            node = node.parent
        return node

    def copy(self) -> Node:
        out = Node(self.tag, dict(self.attrs))
        for kid in self.kids:
            out.append(kid if isinstance(kid, str) else kid.copy())
        return out

    def html(self) -> str:
        inner = "".join(escape(k, quote=False) if isinstance(k, str) and self.tag not in SILENT else k if isinstance(k, str) else k.html() for k in self.kids)
        if self.tag == "#document":
            return inner
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" if self.tag in VOID else f"<{self.tag}{attrs}>{inner}</{self.tag}>"


# A compound selector is (tag, id, classes, attribute tests, empty); a rule is a row of them from outer to inner.
_PART = re.compile(r"""(?P<tag>^[a-zA-Z*][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w:-]+)(?:(?P<op>[*^$~|]?=)["']?(?P<value>[^"'\]]*)["']?)?(?:\s+i)?\]|:(?P<pseudo>empty)""")


@lru_cache(maxsize=1024)
def _parsed(selector: str) -> tuple:
    """The rules of a selector, and what an element needs to be looked at: one of some tags, any attribute, or nothing."""
    rules = []
    for part in selector.split(","):
        steps = re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", part.strip())
        rules.append(tuple(_compound(s) for s in steps if s != ">"))
    last = [r[-1] for r in rules]
    named = [c for c in last if not c[0]]
    return tuple(rules), frozenset(c[0] for c in last if c[0]), bool(named), any(not (c[1] or c[2] or c[3]) for c in named)


def _compound(text: str) -> tuple:
    tag = ident = None
    classes, tests, empty = [], [], False
    for m in _PART.finditer(text):
        if m["tag"]:
            tag = None if m["tag"] == "*" else m["tag"].lower()
        elif m["id"]:
            ident = m["id"]
        elif m["cls"]:
            classes.append(m["cls"])
        elif m["attr"]:
            tests.append((m["attr"].lower(), m["op"], m["value"]))
        else:
            empty = True
    return tag, ident, tuple(classes), tuple(tests), empty


def _fits(node: Node, compound: tuple) -> bool:
    tag, ident, classes, tests, empty = compound
    if (tag and node.tag != tag) or (ident and node.get("id") != ident):
        return False
    if classes and not set(classes) <= set(node.get("class").split()):
        return False
    for name, op, value in tests:
        have = node.attrs.get(name)
        if have is None:
            return False
        if op == "=" and have != value or op == "*=" and value not in have or op == "^=" and not have.startswith(value) or op == "$=" and not have.endswith(value) or op == "~=" and value not in have.split():
            return False
    return not empty or not (node.children() or node.text(True))


def _matches(node: Node, rule: tuple) -> bool:
    if not _fits(node, rule[-1]):
        return False
    at, outer = node.parent, len(rule) - 2
    while outer >= 0 and at is not None:
        if _fits(at, rule[outer]):
            outer -= 1
        at = at.parent
    return outer < 0


def remove_all(nodes: list[Node]) -> None:
    """Removes elements in time in proportion to them and their siblings, however many share a parent."""
    gone = {id(n) for n in nodes}
    for parent in {id(n.parent): n.parent for n in nodes if n.parent is not None}.values():
        parent.kids = [k for k in parent.kids if isinstance(k, str) or id(k) not in gone]
    for node in nodes:
        node.parent = None


class _Builder(HTMLParser):
    """Elements below the level DEPTH hang, with what they hold, on the element of that level, in their order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]
        self.names: Counter[str] = Counter()

    def _top(self) -> Node:
        return self.open[min(len(self.open) - 1, DEPTH)]

    def _cut(self, depth: int) -> None:
        self.names.subtract(n.tag for n in self.open[depth:])
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES)
        elif tag in BLOCKS:
            self._close({"p"}, BLOCKS | SCOPES - {"p"})
        node = Node(tag, {k: v if v is not None else "" for k, v in attrs})
        self._top().append(node)
        if tag not in VOID:
            self.open.append(node)
            self.names[tag] += 1

    def _close(self, tags: set, stops) -> None:
        if not any(self.names[t] > 0 for t in tags):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth].tag
            if tag in tags:
                self._cut(depth)
                return
            if tag in stops:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if self.names[tag] > 0:
            self._cut(next(depth for depth in range(len(self.open) - 1, 0, -1) if self.open[depth].tag == tag))

    def handle_data(self, data: str) -> None:
        kids = self._top().kids
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page. Comments are left out; unclosed and stray tags are borne as browsers bear them, roughly."""
    builder = _Builder()
    try:
        builder.feed(html or "")
        builder.close()
    except (AssertionError, ValueError):
        pass  # what was read before the broken declaration stands
    return builder.root


def body_of(root: Node) -> Node:
    return root.first("body") or root


def flat(text: str) -> str:
    return " ".join(text.split())


def rows(root: Node) -> list[tuple]:
    """The elements as a table: id, parent, pre-order, post-order, depth, tag, attributes, own text. An element lies below
    another if its pre-order is greater and its post-order less."""
    out, post = [], [0]

    def visit(node: Node, parent: int, depth: int) -> None:
        me = len(out)
        out.append([me, parent, me, 0, depth, node.tag, dict(node.attrs), flat("".join(k for k in node.kids if isinstance(k, str)))])
        for kid in node.children():
            visit(kid, me, depth + 1)
        out[me][3] = post[0]
        post[0] += 1

    for top in root.children():
        visit(top, -1, 0)
    return [tuple(r) for r in out]
