"""Tolerant reading of HTML into a tree of blocks and texts.

Elements that HTML sets as blocks are nodes; text between two block borders is
a leaf (or several, where an inline element carries a class, id or role that
says what it is).  Unclosed and misnested tags are closed the way browsers do
it, as far as the text is concerned.  One pass, linear in the page.
"""

from __future__ import annotations

import re
from html import unescape

#: Comments, tags with their attributes, declarations.  A quote that is not
#: closed runs to the end of the page, as in browsers.
_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)
      | <(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|=|[^>=]++)*+)(?:>|\Z)
      | <[!?/][^>]*+(?:>|\Z)""", re.S | re.X)
_ATTR = re.compile(r"""([^\s=/"'>]++)\s*+(?:=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]++)))?+""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Elements whose text is not set on the page, or not as text: skipped to their end tag.
RAW = frozenset("script style title textarea xmp iframe noembed noframes template svg math canvas object audio video select datalist".split())
_RAW_END = {name: re.compile("</" + name, re.I) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q ruby rb rp rt s samp small span "
                   "strike strong sub sup time tt u var".split())
TRANSPARENT = frozenset(("html", "body", "head"))
BLOCK_TAGS = ("address article aside blockquote button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
              "header hgroup legend li main menu nav noscript ol p pre search section summary table tbody td tfoot th thead tr ul").split()
#: Start tags that leave an open <p> as it is.
_INSIDE_P = frozenset(("button", "noscript"))
#: An open element that such a start tag closes, and where the search for it stops.
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
           "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
           "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
           "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",))}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: What words in class, id and role say about an element.
_GROUPS = {
    "nav": "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toc skip toolbar tabs sitemap",
    "header": "header masthead topbar branding logo tagline hero banner",
    "footer": "footer foot colophon copyright legal contentinfo credits imprint",
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular more complementary rail teaser",
    "ad": "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion commercial dfp",
    "notice": "cookie cookies consent gdpr notice notification alert warning popup modal overlay dialog paywall toast disclaimer announcement",
    "comment": "comment comments commentlist discussion disqus replies reply respond responses reviews feedback",
    "form": "form search login signup signin subscribe subscription newsletter register contact searchbox",
    "social": "social share sharing follow tweet facebook twitter likes sharebar",
    "hidden": "hidden invisible sr screenreader offscreen",
    "text": "article content post entry story text body main paragraph prose copy",
}
GROUPS = tuple(_GROUPS)
WORDS = {w: GROUPS.index(g) for g, words in _GROUPS.items() for w in words.split()}
HIDDEN = GROUPS.index("hidden")
TEXT = GROUPS.index("text")


class Page:
    """A page's nodes, parents before children.  ``tags`` holds an element's tag
    name, "inline" for a marked inline element and "" for a leaf."""

    __slots__ = ("parents", "tags", "groups", "blocks", "texts", "links")

    def __init__(self):
        self.parents, self.tags, self.groups = [-1], ["root"], [0]
        #: Of a leaf: its block's number, its text (entities decoded) and how many of its characters are links.
        self.blocks, self.texts, self.links = [-1], [None], [0]

    def add(self, parent: int, tag: str, groups: int, block: int = -1, text: str | None = None, link: int = 0) -> int:
        self.parents.append(parent)
        self.tags.append(tag)
        self.groups.append(groups)
        self.blocks.append(block)
        self.texts.append(text)
        self.links.append(link)
        return len(self.parents) - 1


_flags: dict[str, int] = {}


def _groups_of(attrs: str) -> int:
    """Bits of :data:`GROUPS` that an element's attributes name."""
    known = _flags.get(attrs)
    if known is not None:
        return known
    bits = 0
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name in ("class", "id", "role"):
            for word in _WORD.findall(unescape(value)):
                group = WORDS.get(word.lower())
                if group is not None:
                    bits |= 1 << group
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            bits |= 1 << HIDDEN
    if len(_flags) < 10_000:
        _flags[attrs] = bits
    return bits


def parse(html: str) -> Page:
    page = Page()
    stack = [("root", 0)]  # open elements: blocks and marked inline ones
    opened: dict[str, int] = {}  # how many of each are open
    block, pending, linked = 0, [], 0
    link_at = 0  # size of the stack where a link was opened, 0: no link
    at = 0

    def flush():
        nonlocal pending, linked
        text = "".join(pending)
        if text and not text.isspace():
            page.add(stack[-1][1], "", 0, block, text, linked)
        pending, linked = [], 0

    def pop():
        name, _ = stack.pop()
        opened[name] -= 1
        return name

    def push(name, groups):
        stack.append((name, page.add(stack[-1][1], "inline" if name in INLINE else name, groups)))
        opened[name] = opened.get(name, 0) + 1

    def text_to(end):
        nonlocal linked
        if at < end:
            raw = html[at:end]
            piece = unescape(raw) if "&" in raw else raw
            pending.append(piece)
            if link_at:
                linked += len(piece)

    size = len(html)
    while at < size:
        token = _TOKEN.search(html, at)
        if token is None:
            text_to(size)
            break
        text_to(token.start())
        at = token.end()
        name = token["name"]
        if name is None:
            continue
        name, close, attrs = name.lower(), token["close"], token["attrs"]
        if name in VOID:
            if name in ("br", "hr", "img", "input"):
                pending.append(" " if not pending or not pending[-1].endswith(" ") else "")
            if name == "hr":
                flush()
                block += 1
            continue
        if name in RAW:
            if not close:
                end = _RAW_END[name].search(html, at)
                at = end.start() if end else size
            continue
        if name in TRANSPARENT:
            continue
        if name in INLINE:
            if name == "a":
                link_at = 0 if close else len(stack)
            if close:
                if opened.get(name) and stack[-1][0] == name:
                    flush()
                    pop()
            elif attrs and (groups := _groups_of(attrs)):
                flush()
                push(name, groups)
            continue
        flush()
        block += 1
        if close:
            if opened.get(name) or name in _HEADINGS:
                wanted = _HEADINGS if name in _HEADINGS else (name,)
                if any(opened.get(w) for w in wanted):
                    while pop() not in wanted:
                        pass
        else:
            if opened.get("p") and name not in _INSIDE_P:
                depth = len(stack) - 1
                while depth and stack[depth][0] != "p" and (stack[depth][0] in INLINE or stack[depth][0] == "button"):
                    depth -= 1
                if stack[depth][0] == "p":
                    while len(stack) > depth:
                        pop()
            if name in _CLOSES:
                closed, stop = _CLOSES[name]
                if any(opened.get(c) for c in closed):
                    depth, found = len(stack) - 1, 0
                    while depth and stack[depth][0] not in stop:
                        found = depth if stack[depth][0] in closed else found
                        depth -= 1
                    while found and len(stack) > found:
                        pop()
            push(name, _groups_of(attrs) if attrs else 0)
        if link_at > len(stack):
            link_at = 0
    flush()
    return page
