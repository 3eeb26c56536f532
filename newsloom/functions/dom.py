"""A light DOM over the standard library's tokenizer, and the CSS subset the extraction tiers use.

Supported selectors: type, `*`, `.class`, `#id`, `[a]`, `[a=v]`, `[a*=v]`, `[a^=v]`, `[a$=v]`, `:last-child`,
`:first-child`, descendant and child combinators, and comma lists, whose matches come in document order. Void elements,
unclosed paragraphs and list items, and stray end tags are tolerated.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code del dfn em font i ins kbd mark q s small span strong sub sup u var".split())
# Elements whose text is not read.
SILENT = frozenset(("script", "style", "template"))
# Elements whose start ends an open element of the listed kind.
CLOSES = {
    "p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}),
    **{t: frozenset({"p"}) for t in "div ul ol table section article aside main nav header footer h1 h2 h3 h4 h5 h6 blockquote form pre".split()},
}


class Node:
    """An element. Its page lists all elements in document order; those below it stand from `order` + 1 to `end`."""

    __slots__ = ("tag", "attrs", "children", "parent", "order", "end", "page")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None", order: int, page: "Page"):
        self.tag, self.attrs, self.parent, self.order, self.end, self.page = tag, attrs, parent, order, order, page
        self.children: list[Node | str] = []

    def walk(self) -> "list[Node]":
        """All elements below, in document order."""
        return self.page.nodes[self.order + 1 : self.end + 1]

    def strings(self) -> list[str]:
        """The texts below in document order, without those of scripts, styles and templates."""
        out, stack = [], [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, str):
                    out.append(c)
                elif c.tag not in SILENT:
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()
        return out

    def text(self, joiner: str = " ") -> str:
        """The stripped texts below, joined; scripts and styles left out."""
        return joiner.join(t for t in (s.strip() for s in self.strings()) if t)

    def raw(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))


class Page:
    """What the elements of one document share: their list, an index by tag, and results kept for the document."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.by_tag: dict[str, list[int]] = {}
        self.memo: dict = {}


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.root = Node("", {}, None, 0, self.page)
        self.page.nodes.append(self.root)
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag)
        while ends:
            k = len(self.open) - 1
            while k and self.open[k].tag in INLINE:  # an unclosed one ends with what holds it
                k -= 1
            if not k or self.open[k].tag not in ends:
                break
            del self.open[k:]
        nodes = self.page.nodes
        node = Node(tag, {k: v if v is not None else "" for k, v in reversed(attrs)}, self.open[-1], len(nodes), self.page)
        nodes.append(node)
        self.page.by_tag.setdefault(tag, []).append(node.order)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    """The document's root. Any depth of nesting is taken; nothing recurses."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    for n in reversed(b.page.nodes):
        if n.parent is not None and n.parent.end < n.end:
            n.parent.end = n.end
    return b.root


_SIMPLE = re.compile(
    r"""(?P<type>\*|[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~]?=)\s*(?:"(?P<v1>[^"]*)"|'(?P<v2>[^']*)'|(?P<v3>[^\]\s]*))\s*)?\]|:(?P<pseudo>last-child|first-child)"""
)
_SPLIT = re.compile(r""",(?![^\[]*\])""")


@lru_cache(maxsize=1024)
def compile_selector(css: str):
    """Alternatives, each a list of (combinator, tests) from the subject upwards."""
    out = []
    for part in _SPLIT.split(css):
        part = re.sub(r"\s*>\s*", " > ", part.strip())
        steps, combinator = [], " "
        for token in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", part):
            if token == ">":
                combinator = ">"
                continue
            at, tests = 0, []
            while at < len(token):
                m = _SIMPLE.match(token, at)
                if not m:
                    raise ValueError(f"selector not supported: {css!r}")
                tests.append(m.groupdict())
                at = m.end()
            steps.append((combinator, tests))
            combinator = " "
        out.append(steps[::-1])
    return out


def _passes(node: Node, tests) -> bool:
    for t in tests:
        if t["type"]:
            if t["type"] != "*" and node.tag != t["type"].lower():
                return False
        elif t["cls"]:
            if t["cls"] not in node.attrs.get("class", "").split():
                return False
        elif t["id"]:
            if node.attrs.get("id") != t["id"]:
                return False
        elif t["attr"]:
            v = node.attrs.get(t["attr"].lower())
            if v is None:
                return False
            want = next((x for x in (t["v1"], t["v2"], t["v3"]) if x is not None), "")
            ok = {None: True, "=": v == want, "*=": want in v, "^=": v.startswith(want), "$=": v.endswith(want), "~=": want in v.split()}[t["op"]]
            if not ok:
                return False
        else:
            peers = [c for c in node.parent.children if isinstance(c, Node)] if node.parent else [node]
            if (peers[-1] if t["pseudo"] == "last-child" else peers[0]) is not node:
                return False
    return True


def _matches(node: Node, steps, k: int = 0) -> bool:
    if not _passes(node, steps[k][1]):
        return False
    if k + 1 == len(steps):
        return True
    up = node.parent
    if steps[k][0] == ">":
        return up is not None and up.tag != "" and _matches(up, steps, k + 1)
    while up is not None and up.tag != "":
        if _matches(up, steps, k + 1):
            return True
        up = up.parent
    return False


def select(root: Node, css: str) -> list[Node]:
    """All matches below `root`, in document order. Results for a whole document are kept with it."""
    page, whole = root.page, root.parent is None
    if whole and css in page.memo:
        return page.memo[css]
    alternatives = compile_selector(css)
    kinds = {next((t["type"].lower() for t in steps[0][1] if t["type"] and t["type"] != "*"), None) for steps in alternatives}
    if None in kinds:
        some = root.walk()
    else:
        at = sorted(k for tag in kinds for k in page.by_tag.get(tag, ()) if root.order < k <= root.end)
        some = [page.nodes[k] for k in at]
    out = [n for n in some if any(_matches(n, steps) for steps in alternatives)]
    if whole:
        page.memo[css] = out
    return out
