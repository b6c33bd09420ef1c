"""Block trees of web pages: a tolerant tokenizer that keeps, per block
element, what a content model needs. Inline elements count towards the block
they stand in; elements that show no page text are skipped."""

from __future__ import annotations

import html
import re

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([A-Za-z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAMES = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike "
    "strong sub sup time tt u var ruby rt rp picture".split())
# Their contents are no page text; those of RAW hold no markup either.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
HIDDEN = frozenset("head template svg math object select button noscript audio video canvas map datalist".split()) | RAW
IN_HEAD = frozenset("head title meta link script style base noscript template".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
         "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
P_SCOPE = frozenset("html table td th caption button object template body".split())


class Node:
    __slots__ = ("tag", "parent", "depth", "names", "mark", "start", "text", "links", "order")

    def __init__(self, tag, parent, names, mark, start):
        self.tag, self.parent, self.names, self.mark, self.start = tag, parent, names, mark, start
        self.depth = 0
        self.text = self.links = 0


def _attributes(raw: str) -> tuple[list[str], str | None]:
    names, mark = [], None
    for m in _ATTR.finditer(raw):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "data-y":
            mark = value
        else:
            names += _NAMES.findall(value.lower())
    return names, mark


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes (the first is the root; ``parent`` is an index) and the text
    blocks in page order as (node, text), references decoded, white space
    folded, none empty."""
    nodes = [Node("#root", -1, [], None, 0)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # (tag, node it belongs to)
    blocks: list[tuple[int, str]] = []
    pieces: list[str] = []
    link_chars = 0
    open_links = hidden = 0
    pos, size = 0, len(page)

    def flush():
        nonlocal link_chars
        if pieces:
            text = "".join(pieces)
            pieces.clear()
            if "&" in text:
                text = text.replace("&amp;", "&") if text.count("&") == text.count("&amp;") else html.unescape(text)
            text = " ".join(text.split())
            if text:
                at = stack[-1][1]
                blocks.append((at, text))
                nodes[at].text += len(text)
                nodes[at].links += min(link_chars, len(text))
        link_chars = 0

    def pop_to(k):
        nonlocal open_links, hidden
        while len(stack) > k:
            tag, _ = stack[-1]
            if tag not in INLINE:
                flush()
            stack.pop()
            open_links -= tag == "a"
            hidden -= tag in HIDDEN

    def say(text):
        nonlocal link_chars
        if text and not hidden:
            pieces.append(text)
            if open_links:
                link_chars += len(text)

    while pos < size:
        lt = page.find("<", pos)
        if lt < 0:
            say(page[pos:])
            break
        m = _TAG.match(page, lt)
        if m is None:  # a plain "<"
            say(page[pos:lt + 1])
            pos = lt + 1
            continue
        say(page[pos:lt])
        pos = m.end()
        closing, tag = m[1], m[2] or m[4]
        if tag:
            tag = tag.lower()
            raw = m[3] if m[2] else m[5]
            if hidden and stack[-1][0] == "head" and tag not in IN_HEAD:
                pop_to(len(stack) - 1)
            if tag == "br":
                say(" ")
                continue
            if tag in ("html", "body"):
                continue
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    t = stack[k][0]
                    if t == "p":
                        pop_to(k)
                        break
                    if t in P_SCOPE or (t in CLOSES_P and t != "p"):
                        break
            if tag in SAME:
                for k in range(len(stack) - 1, 0, -1):
                    t = stack[k][0]
                    if t in SAME[tag]:
                        pop_to(k)
                        break
                    if t in STOPS[tag]:
                        break
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in RAW:
                if tag not in ("script", "style"):
                    flush()
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
                pos = end.end() if end else size
                continue
            if raw.endswith("/") and tag in HIDDEN:
                continue
            if tag in INLINE or tag in HIDDEN:
                stack.append((tag, stack[-1][1]))
                open_links += tag == "a"
                hidden += tag in HIDDEN
                continue
            flush()
            if hidden:
                stack.append((tag, stack[-1][1]))
                continue
            parent = stack[-1][1]
            names, mark = _attributes(raw) if raw else ([], None)
            node = Node(tag, parent, names, mark, lt)
            node.depth = nodes[parent].depth + 1
            nodes.append(node)
            stack.append((tag, len(nodes) - 1))
        elif closing:
            closing = closing.lower()
            if closing == "br":
                say(" ")
                continue
            if closing in ("html", "body"):
                continue
            block = closing not in INLINE
            for k in range(len(stack) - 1, 0, -1):
                t = stack[k][0]
                if t == closing:
                    pop_to(k)
                    break
                if not block and t not in INLINE:
                    break
            else:
                if closing == "p":
                    flush()
    pop_to(1)
    flush()
    return nodes, blocks
