"""A small tag-soup reader: block texts of a page and the elements around them.

Comments, doctypes, scripts, styles and other raw elements give no text. Elements whose end tags may be left out (p, li, dt, dd, tr, td, th,
option) are closed by what follows them; an end tag without its start tag is ignored. Inline elements do not part a block;
``br`` is white space inside it. A page cut off in the middle of a tag loses that tag only.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
#: Ends within a quoted value: the sign that closed the tag was part of it.
QUOTED = re.compile(r"=\s*(?:\"[^\"]*|'[^']*)\Z")
ATTR = re.compile(r"([a-zA-Z_:@][^\s=/>\"']*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
SPACES = re.compile(r"[\x20\x09-\x0D\xa0]+")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Fixed values of HTML: elements by their kind.
RAW = frozenset("script style textarea title noembed noframes iframe xmp".split())
HIDDEN = frozenset("head script style title template noscript textarea noembed noframes iframe xmp object svg math canvas select datalist button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body head address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
                  "hr legend li main menu nav ol p pre search section summary table caption thead tbody tfoot tr td th ul template noscript option select".split())
#: What an opening tag closes: the open elements it ends and the elements that stop the search.
LISTS, TABLE = frozenset(("ul", "ol", "menu", "dir")), frozenset(("table",))
CLOSES = {"li": (("li",), LISTS), "dd": (("dd", "dt"), frozenset(("dl",))), "dt": (("dd", "dt"), frozenset(("dl",))), "tr": (("tr", "td", "th"), TABLE),
          "td": (("td", "th"), TABLE), "th": (("td", "th"), TABLE), "tbody": (("tr", "td", "th", "tbody", "thead", "tfoot"), TABLE), "tfoot": (("tr", "td", "th", "tbody", "thead"), TABLE), "option": (("option",), frozenset(("select",)))}


@dataclass
class Element:
    """An open or closed element: the tag, its attributes' names, the element around it and its children's tags."""

    tag: str
    parent: int
    names: frozenset
    role: str = ""
    style: str = ""
    children: list = field(default_factory=list)


@dataclass
class Block:
    """Text of one block, the element that holds it, and how many of its characters are links."""

    element: int
    text: str
    linked: int


def _attributes(raw: str) -> tuple[frozenset, str, str]:
    """Words of class and id, role, and both as written."""
    if "=" not in raw:
        return frozenset(), "", ""
    names, role, style = "", "", ""
    for m in ATTR.finditer(raw):
        key = m[1].lower()
        if key in ("class", "id"):
            value = html.unescape(m[2] or m[3] or m[4] or "")
            names += " " + value
            style += f".{value}" if key == "class" else ""
        elif key in ("role", "itemprop"):
            role = (m[2] or m[3] or m[4] or "").lower()
    return frozenset(x.lower() for x in NAME.findall(names)), role, style


def read(page: str) -> tuple[list[Element], list[Block], str]:
    """Elements in page order (the first stands for the document), blocks in page order, and the title."""
    elements = [Element("", -1, frozenset())]
    stack, blocks, title = [0], [], ""
    hidden = links = 0  # open elements of that kind
    opens: dict[str, int] = {}
    unquoted: set[str] = set()  # quotes that do not occur any more
    held: list[str] = []
    held_links = 0

    def flush():
        nonlocal held, held_links
        if held:
            text = SPACES.sub(" ", "".join(held)).strip(" ")
            if text:
                blocks.append(Block(stack[-1], text, min(held_links, len(text))))
        held, held_links = [], 0

    def close(depth):
        nonlocal hidden
        flush()
        while len(stack) > depth:
            name = elements[stack.pop()].tag
            opens[name] -= 1
            hidden -= name in HIDDEN

    def attributes_end(start, stop):
        """End of a tag's attributes from ``start`` and of the tag; ``stop`` is just behind its first closing sign."""
        while (m := QUOTED.search(page, start, stop - 1)) and page[stop - 1: stop] == ">":
            quote = m[0].lstrip("= \t\r\n\f\v")[0]
            shut = -1 if quote in unquoted else page.find(quote, stop)
            if shut < 0:
                unquoted.add(quote)
                break
            start = shut + 1
            stop = page.find(">", start) + 1 or len(page)
        return stop

    def say(raw):
        nonlocal held_links
        if raw and not hidden:
            text = html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if links:
                held_links += len(SPACES.sub(" ", text).strip(" "))

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at: m.start()])
        at = m.end()
        opened, closed = m[2], m[1]
        if opened:
            tag = opened.lower()
            raw = m[3]
            if "=" in raw:
                at = attributes_end(m.start(3), at)
                raw = page[m.start(3): at].removesuffix(">")
            if tag in RAW and not raw.rstrip().endswith("/"):
                stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                if tag == "title" and not title:
                    title = SPACES.sub(" ", html.unescape(page[at: stop.start() if stop else end])).strip(" ")
                at = stop.end() if stop else end
                continue
            if tag == "a":
                links = 1  # links do not nest
            elif tag == "br":
                held.append(" ")
            elif tag in BLOCK or tag in HIDDEN:
                if tag != "html" and tag != "head" and hidden and elements[stack[-1]].tag == "head" and tag in BLOCK and tag not in HIDDEN:
                    close(len(stack) - 1)  # the head ends where the body begins
                if tag in CLOSES:
                    ends, stops = CLOSES[tag]
                    for k in range(len(stack) - 1, 0, -1) if any(opens.get(x) for x in ends) else ():
                        name = elements[stack[k]].tag
                        if name in stops:
                            break
                        if name in ends:
                            close(k)
                if tag in BLOCK and elements[stack[-1]].tag == "p":
                    close(len(stack) - 1)
                flush()
                names, role, style = _attributes(raw)
                elements[stack[-1]].children.append(tag + style)
                if tag in VOID or raw.rstrip().endswith("/") and tag in ("svg", "math", "object"):
                    continue
                elements.append(Element(tag, stack[-1], names, role, style))
                stack.append(len(elements) - 1)
                opens[tag] = opens.get(tag, 0) + 1
                hidden += tag in HIDDEN
                links = 0
        elif closed:
            tag = closed.lower()
            if tag == "a":
                links = 0
            elif opens.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if elements[stack[k]].tag == tag:
                        close(k)
                        break
                    if tag == "p" and elements[stack[k]].tag in ("article", "td", "main"):
                        break
    flush()
    return elements, blocks, title
