"""The leaf blocks of an HTML page: runs of text between block-level tags, with the elements they are in.

The reader goes once through the page. Comments, declarations and elements whose content isn't text of the page (scripts,
styles, titles, ...) are left out, ends that HTML implies (of paragraphs, items and cells) are made, stray end tags are ignored,
and what is open at the end is closed. An unterminated tag, comment or script reaches to the end, as in browsers. Inline elements
and unknown ones belong to their block. Time and memory are in proportion to the page, whatever its nesting.
"""

from __future__ import annotations

import html
import re
from collections import Counter

#: Elements that begin and end blocks. Others are inline.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that say what they hold.
TELLING = frozenset("article aside body dialog footer form header main menu nav section".split())
#: Elements whose content isn't text of the page.
DROPPED = frozenset("audio canvas datalist iframe math noembed noframes noscript object option script select style svg template textarea title video".split())
#: Elements without content that end a block, or stand for white space.
RULE, BREAK = frozenset(["hr"]), frozenset(["br", "wbr"])
#: What an opening tag closes, if it is the innermost open block.
_ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"td", "th", "tr", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tbody": {"td", "th", "tr", "tbody", "thead", "p"}}
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|aria-label)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words of an element's names that count.
NAMES = 24
#: Words that names of an element have for parts of a page that go with every page.
NAMES_OF = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toolbar tabs pagination pager topnav links",
    "header": "header masthead banner branding topbar logo site top",
    "footer": "footer bottom colophon copyright legal imprint foot",
    "sidebar": "sidebar side aside widget related recommended popular trending more tags rail column",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe message warning disclaimer privacy notification",
    "advert": "ad ads advert advertisement advertising sponsor sponsored promo promotion adsbygoogle commercial",
    "form": "form search login signup contact register subscription feedback",
    "comments": "comments comment replies reply respond responses discussion thread disqus feedback reviews reader",
    "share": "share sharing social follow buttons tools",
}
_KIND = {w: f"kind {kind}" for kind, words in NAMES_OF.items() for w in words.split() if w not in ("top", "more", "column", "site", "links", "tags", "side", "message")}


class Element:
    """An open block-level element: its own features, the element that it is in, and the features of the nearest one that has a
    name or says what it holds. `total` is for whoever scores it."""

    __slots__ = ("features", "near", "tag", "total", "up")

    def __init__(self, tag: str, up: Element | None, features: list[str]):
        self.tag, self.up, self.features, self.total = tag, up, features, None
        telling = len(features) > 1 or tag in TELLING and not (tag in ("article", "section") and any(f.startswith("near kind") for f in up.near))
        self.near = [f"near {f}" for f in features] if telling or up is None else up.near


def _features(tag: str, attrs: str) -> list[str]:
    out = [f"in {tag}"]
    if attrs:
        for name, *values in _ATTRIBUTE.findall(attrs):
            value = "".join(values)
            if name.lower() in ("hidden", "aria-hidden"):
                out += ["hidden"] * (value.lower() != "false")
            else:
                words = [w.lower() for w in _WORD.findall(value)[:NAMES]]
                out += [f"name {w}" for w in words] + sorted({_KIND[w] for w in words if w in _KIND})
    return out


def blocks(page: str | None) -> list[tuple[str, int, Element]]:
    """The page's blocks in order: text with single blanks, signs of it inside links, innermost element."""
    page = page or ""
    top = Element("page", None, ["in page"])
    stack, opened, out = [top], Counter(), []
    words, linked, link = [], 0, False
    at = 0

    def flush():
        nonlocal words, linked
        if words:
            text = " ".join("".join(words).split())
            if text:
                out.append((text, min(linked, len(text)), stack[-1]))
            words, linked = [], 0

    def pop():
        opened[stack.pop().tag] -= 1

    def read(end):
        nonlocal linked
        if end > at:
            piece = page[at:end]
            words.append(html.unescape(piece) if "&" in piece else piece)
            if link:
                linked += len(piece)

    while m := _TAG.search(page, at):
        read(m.start())
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag == "a":
                link = False
            elif tag in BLOCK:
                flush()
                if opened[tag]:
                    while stack[-1].tag != tag:
                        pop()
                    pop()
        elif tag in DROPPED:
            if not m["attrs"].endswith("/"):
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                at = close.end() if close else len(page)
        elif tag in BREAK:
            words.append(" ")
        elif tag in BLOCK or tag in RULE:
            flush()
            while stack[-1].tag in _ENDS.get(tag, ("p",)):
                done = stack[-1].tag == tag
                pop()
                if done:
                    break
            if tag in BLOCK:
                stack.append(Element(tag, stack[-1], _features(tag, m["attrs"])))
                opened[tag] += 1
        elif tag == "a":
            link = True
    read(len(page))
    flush()
    return out
