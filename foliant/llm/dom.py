"""A forgiving HTML reader: block elements as a tree, text as blocks in page order.

Inline elements do not make nodes; their text belongs to the innermost open block element. Scripts, styles and other
elements whose content is never shown are left out, as are comments. Unclosed elements end where HTML ends them, or
with the page; stray end tags are ignored.
"""

from __future__ import annotations

import html
import re

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark picture q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr br math semantics mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup mover munder munderover mtable mtr mtd mspace mstyle mpadded mphantom menclose".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never shown, or (object, canvas, audio, video) only where a browser lacks the element.
HIDDEN = frozenset("script style noscript template svg annotation annotation-xml iframe object canvas head title audio video map".split())
#: What may stand in a head; any other start tag, and text, ends it.
IN_HEAD = frozenset("title meta link base style script noscript template basefont bgsound".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
#: A start tag ends these open elements, up to the nearest of the stops.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
ITEMS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
STOPS = frozenset("table td th button caption html template".split())

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.S)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "depth", "tokens", "own", "links", "inline", "controls", "index", "truth")

    def __init__(self, tag: str, parent: int, depth: int, index: int):
        self.tag, self.parent, self.depth, self.index = tag, parent, depth, index
        self.tokens: list[str] = []
        self.own = self.links = self.inline = self.controls = 0
        self.truth = False


def attribute_tokens(attributes: str) -> tuple[list[str], bool]:
    """The parts of the values of class, id, role and itemprop, lower-cased; and whether the tag is marked for training."""
    tokens, truth = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name in ("class", "id", "role", "itemprop"):
            tokens += [t.lower() for t in _PARTS.findall(m[2])]
        elif name == "data-truth":
            truth = True
    return tokens, truth


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in page order (each after its parent; the first is the root), and (node, text) of each block with text."""
    nodes = [Node("#root", -1, 0, 0)]
    stack = [0]
    children = [0]
    blocks: list[tuple[int, str]] = []
    text: list[str] = []
    hidden = link = 0
    at, n = 0, len(page)
    skip_to = ""

    def flush() -> None:
        if text:
            s = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if s:
                nodes[stack[-1]].own += len(s)
                blocks.append((stack[-1], s))

    def close(names: set | frozenset, stops: set | frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in names:
                flush()
                del stack[k:]
                return
            if tag in stops:
                return

    hide: list[str] = []
    while at < n:
        if skip_to:
            # raw text goes to its own end tag, whatever stands in it
            m = re.compile(f"</{re.escape(skip_to)}(?=[\\s/>])[^>]*>|\\Z", re.I).search(page, at)
            if not hide:
                text.append(page[at : m.start()])
            at = m.start()
            skip_to = ""
        m = _TOKEN.search(page, at)
        upto = m.start() if m else n
        if hide == ["head"] and page[at:upto].strip():
            hide.clear()
        if upto > at and not hide:
            piece = page[at:upto]
            text.append(piece)
            if link:
                nodes[stack[-1]].links += len(piece)
        if m is None:
            break
        at = max(m.end(), m.start() + 1)
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if hide:
                if tag in hide:
                    del hide[len(hide) - 1 - hide[::-1].index(tag) :]
                elif tag in ("html", "body") or (hide == ["head"] and tag not in HIDDEN and tag not in INLINE):
                    hide.clear()
                continue
            if tag == "a":
                link = max(0, link - 1)
            elif tag == "br":
                text.append(" ")
            elif tag not in INLINE:
                close({tag}, STOPS - {tag} if tag not in ("p", "li") else STOPS | {"ul", "ol"} - {tag})
            continue
        if hide:
            if hide == ["head"] and tag not in IN_HEAD:
                hide.clear()
            elif tag in HIDDEN and tag not in VOID and not m[3].endswith("/"):
                hide.append(tag)
                if tag in RAW:
                    skip_to = tag
                continue
            else:
                continue
        if tag in HIDDEN:
            if tag not in INLINE and tag != "script":
                flush()
            if not (m[3].endswith("/") and tag == "svg"):
                hide.append(tag)
                if tag in RAW:
                    skip_to = tag
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            else:
                nodes[stack[-1]].inline += 1
                if tag == "a":
                    link = 1
            continue
        flush()
        link = 0
        if tag in ENDS_P:
            close({"p"}, STOPS)
            if tag[0] == "h" and tag[1:].isdigit() and nodes[stack[-1]].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                stack.pop()
        elif tag in ITEMS:
            close(*ITEMS[tag])
        if tag in ("html", "body") and any(nodes[k].tag == tag for k in stack):
            continue
        parent = stack[-1]
        node = Node(tag, parent, nodes[parent].depth + 1, children[parent])
        if m[3]:
            node.tokens, node.truth = attribute_tokens(m[3])
        children[parent] += 1
        nodes.append(node)
        children.append(0)
        if tag in ("input", "button", "select", "textarea", "option", "label", "fieldset"):
            node.controls = 1
        if tag not in VOID:
            stack.append(len(nodes) - 1)
            if tag in RAW:
                skip_to = tag
    flush()
    return nodes, blocks
