"""The text blocks of a page, and what its markup says of them.

``blocks(html)`` reads the page once, tag by tag. Text of elements that are never main text (scripts, styles, menus, headers and
footers of the page, sidebars, forms), of elements whose class, id or role names such a part, and of hidden elements is
left out; so are comments of the markup. The rest is cut into blocks at block elements; character references are decoded and white
space within a block becomes one space. A block is "article" or "main" inside such an element, else "other".

Pages may be cut anywhere and elements left open: an end tag closes what was opened within its element, a paragraph ends where
the next block element begins, end tags without a start are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

# fixed values: elements whose content is never main text
DROPPED = frozenset("script style noscript template head title svg math canvas iframe object embed audio video map nav footer aside form button select textarea datalist dialog menu".split())
#: Of those, the ones whose content is not markup.
RAW = re.compile(r"<(script|style|textarea|title)\b[^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*>.*?(?:</\1\b[^>]*>|\Z)|<!--.*?(?:-->|\Z)", re.I | re.S)
# fixed values: elements that begin and end a block
BLOCK = frozenset(
    "html body div section article main header footer nav aside p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption thead tbody tfoot tr blockquote pre figure figcaption form fieldset legend details summary address center hr search dialog menu".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open one of the first kind, unless it is outside the second.
ENDS = {"body": ("head",), "li": ("li", "ul", "ol"), "dt": ("dt", "dd", "dl"), "dd": ("dt", "dd", "dl")}
LISTS = ("ul", "ol", "dl")
#: Inline elements and cells that separate words.
SPACED = frozenset("br td th option".split())
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*)>|<[!?][^>]*>")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Parts of a class or id that name something beside the main text, and those that say the element only has or lacks it.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promotion promotions banner cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay lightbox "
    "newsletter subscribe subscription signup paywall sidebar sidebars aside rail menu menus nav navbar navigation navigations breadcrumb breadcrumbs footer foot masthead topbar toolbar comment comments commentlist respond discussion disqus "
    "share sharing shares social related recommended recommendations widget widgets login search pagination pager skip skiplink disclaimer copyright legal hidden".split()
)
COMMENT = frozenset("comment comments commentlist respond discussion disqus".split())
ONLY_SAYS = frozenset("has with no without is not".split())
# fixed values: roles that are not main text
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert status menu menubar toolbar tablist".split())
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): references.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(text)}


def beside(tag: str, text: str) -> bool:
    """Whether an element's attributes say that it is no main text."""
    if "=" not in text and "hidden" not in text:
        return False
    a = attributes(text)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if tag in ("html", "body", "main"):
        return False
    if a.get("role", "").lower() in ROLES:
        return True
    wanted = COMMENT if tag == "article" else PARTS
    for name in [*a.get("class", "").split(), a.get("id", "")]:
        parts = [p.lower() for p in WORD.findall(name)]
        if parts and parts[0] not in ONLY_SAYS and not wanted.isdisjoint(parts):
            return True
    return False


def blocks(html: str) -> list[tuple[str, str]]:
    """(where, text) of the blocks of a page in order; where is "article", "main" or "other"."""
    page = RAW.sub(" ", html)
    out: list[tuple[str, str]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, str]] = []  # open elements: name, whether left out, where
    many: Counter[str] = Counter()  # open elements by name
    left_out, where, at = 0, "other", 0

    def end_block() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append((where, text))

    def close(depth: int) -> None:
        nonlocal left_out, where
        while len(stack) > depth:
            name, gone, _ = stack.pop()
            left_out -= gone
            many[name] -= 1
        where = stack[-1][2] if stack else "other"

    for m in TAG.finditer(page):
        if not left_out and m.start() > at:
            text = page[at : m.start()]
            held.append(references.unescape(text) if "&" in text else text)
        at = m.end()
        slash, tag, told = m.groups()
        if not tag:
            continue
        tag, ends = tag.lower(), bool(slash)
        if tag in SPACED:
            held.append(" ")
        if tag in BLOCK:
            end_block()
        if tag in VOID:
            continue
        if ends:
            if many[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in BLOCK and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in ENDS and any(many[name] for name in ENDS[tag]):
            # the end tags of these may be missing
            depth = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ENDS[tag])
            if stack[depth][0] not in LISTS:
                close(depth)
        if tag == "main" and left_out:
            close(next(k for k, s in enumerate(stack) if s[1]))  # the page's main part is in none of those: it was left open
        gone = bool(tag in DROPPED or (tag == "header" and where == "other") or (told and beside(tag, told)))
        if gone or left_out or tag in BLOCK:
            left_out += gone
            where = "article" if tag == "article" else "main" if where == "other" and (tag == "main" or 'role="main"' in told) else where
            stack.append((tag, gone, where))
            many[tag] += 1
    if not left_out and at < len(page):
        held.append(references.unescape(page[at:]))
    end_block()
    return out


def chosen(found: list[tuple[str, str]]) -> str:
    """Where the main text of a page is: in its articles, else in its main part, else anywhere."""
    places = {w for w, _ in found}
    return next(w for w in ("article", "main", "other") if w in places or w == "other")
