"""A tolerant HTML reader that keeps what main-text extraction needs: block elements and their runs of text."""

from __future__ import annotations

import re
from html import unescape

#: Elements by the way they are read (HTML living standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements whose contents are left out if they are closed; these can hold elements of their own kind.
LEFT_OUT = frozenset("svg template noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("li dt dd address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Elements of formulas are read in line; those of drawings hold nothing where their drawing is not closed.
INLINE |= frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr mlabeledtr munder munderover none semantics annotation annotation-xml".split())
INLINE |= frozenset("circle clippath defs ellipse g line lineargradient path polygon polyline radialgradient rect stop symbol tspan use".split())
#: These end a drawing that they start in, unless they are in one of the elements of it that hold text.
BREAKS_OUT = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 head hr img li menu nobr ol p pre table ul".split())
HOLDS_TEXT = frozenset("foreignobject desc".split())
#: An element that starts ends these open ones, up to one of the elements that hold them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: A <p> is closed only within these.
P_SCOPE = frozenset("td th table caption button body html".split())
#: A quote counts only after an equals sign. The groups are atomic, so damaged input takes linear time.
_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"'=]|=\s*(?:"[^"]*"|'[^']*')?|["'])*+)>""", re.S)
_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I | re.A) for t in RAW}
_MAY_LEAVE_OUT = re.compile("<(?:" + "|".join(sorted(LEFT_OUT)) + ")", re.I | re.A)
_ATTR = re.compile(r"""([^\s=/"'<>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    """A block element, or a run of text in one (``tag`` is ``#text`` then)."""

    __slots__ = ("attrs", "children", "link", "parent", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children: list[Node] = []
        self.text = ""
        self.link = 0  # characters of the run inside links

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(self.attrs)} if self.attrs else {}


def _after_raw(html: str, tag: str, at: int, unclosed: set[str]) -> int:
    """Where to read on after the start of a raw element that ends at ``at``. Tags found unclosed go into ``unclosed``."""
    close = None if tag in unclosed else _END[tag].search(html, at)
    if close is None:
        unclosed.add(tag)
        return at if tag in ("textarea", "iframe") else len(html)
    gt = html.find(">", close.end())
    return len(html) if gt < 0 else gt + 1


def _left_out(html: str) -> dict[int, int]:
    """Where each closed element of ``LEFT_OUT`` starts and ends. One pass; empty and unclosed ones are not in it."""
    found: dict[int, int] = {}
    opened: dict[str, list[int]] = {t: [] for t in LEFT_OUT if t != "svg"}
    drawing: list[tuple[str, int]] = []  # open svg elements, and in them those that hold text
    many: dict[str, int] = {}
    unclosed: set[str] = set()
    at, last = 0, html.rfind(">")
    while at <= last:
        m = _TOKEN.search(html, at)
        if m is None:
            break
        at = m.end()
        if m[3] is None:
            continue
        tag, ends, empty = m[3].lower(), bool(m[2]), m[4].endswith("/")
        if tag in opened:
            if not ends:
                opened[tag].append(m.start())
            elif opened[tag]:
                found[opened[tag].pop()] = at
        elif tag == "svg" or tag in HOLDS_TEXT and drawing:
            if not ends:
                if not empty:
                    drawing.append((tag, m.start()))
                    many[tag] = many.get(tag, 0) + 1
                continue
            while many.get(tag):
                name, start = drawing.pop()
                many[name] -= 1
                if name == tag:
                    if tag == "svg":
                        found[start] = at
                    break
        elif ends:
            continue
        elif tag in RAW:
            if not (empty and drawing):
                at = _after_raw(html, tag, at, unclosed)
        elif tag in BREAKS_OUT:
            while drawing and drawing[-1][0] == "svg":
                many[drawing.pop()[0]] -= 1
    return found


def parse(html: str | None) -> Node:
    """The tree of block elements. Text runs have character references decoded and white space collapsed.

    Null, empty or damaged input gives the tree that can be made of it. An inline element does not end a run,
    a <br> counts as white space, and the contents of scripts, styles and the like are left out. So are closed
    drawings, templates and <noscript>; if they are empty or not closed, what follows is read.
    """
    root = now = Node("#root", None)
    opened: dict[str, int] = {}  # how many of each element are open
    runs: list[str] = []
    linked: list[str] = []
    inline: list[str] = []
    links = formulas = 0

    def flush() -> None:
        nonlocal runs, linked
        if runs:
            text = " ".join(unescape("".join(runs)).split())
            if text:
                run = Node("#text", now)
                run.text = text
                run.link = len(" ".join(unescape("".join(linked)).split())) if linked else 0
                now.children.append(run)
            runs, linked = [], []

    def leave(node: Node) -> None:
        nonlocal now
        while now is not node.parent:
            opened[now.tag] -= 1
            now = now.parent

    html = html or ""
    at, end = 0, len(html)
    left_out = _left_out(html) if _MAY_LEAVE_OUT.search(html) else {}
    unclosed: set[str] = set()
    last = html.rfind(">")
    match = _TOKEN.search
    while at < end:
        m = match(html, at) if at <= last or html.find("<!", at) >= 0 else None
        if m is None:
            runs.append(html[at:])
            break
        if m.start() > at:
            piece = html[at : m.start()]
            runs.append(piece)
            if links:
                linked.append(piece)
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] is not None and formulas:
                runs.append(m[1].replace("&", "&amp;"))
            elif m[1] is not None:  # elsewhere it is a comment that ends with its first >
                gt = html.find(">", m.start())
                at = end if gt < 0 else gt + 1
            continue
        tag = tag.lower()
        if m[2]:
            if tag in INLINE:
                if tag == "a" and links:
                    links -= 1
                elif tag == "math" and formulas:
                    formulas -= 1
                continue
            if tag == "br":
                runs.append(" ")
                continue
            if not opened.get(tag):
                continue
            node = now
            while node.parent is not None and node.tag != tag:
                if tag == "p" and node.tag in P_SCOPE:
                    node = root
                    break
                node = node.parent
            if node.parent is None:
                continue
            flush()
            leave(node)
            links = 0
            continue
        if tag in INLINE:
            if tag == "a":
                links = 1  # links do not nest
            elif tag == "math" and not m[4].endswith("/"):
                formulas += 1
            continue
        if tag in RAW:
            at = _after_raw(html, tag, at, unclosed)
            continue
        if tag in LEFT_OUT:
            at = left_out.get(m.start(), at)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                runs.append(" " if tag in ("br", "wbr", "img", "input") and tag != "wbr" else "")
            continue
        flush()
        links = 0
        if tag in CLOSES_P and opened.get("p"):
            node = now
            while node.parent is not None and node.tag not in P_SCOPE:
                if node.tag == "p":
                    leave(node)
                    break
                node = node.parent
        if tag in ENDS:
            ends, stops = ENDS[tag]
            if any(opened.get(t) for t in ends):
                node, found = now, None
                while node.parent is not None and node.tag not in stops:
                    found = node if node.tag in ends else found
                    node = node.parent
                if found is not None:
                    leave(found)
        if tag in ("html", "body", "head") and opened.get(tag):
            continue
        child = Node(tag, now, m[4])
        now.children.append(child)
        now = child
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return root

