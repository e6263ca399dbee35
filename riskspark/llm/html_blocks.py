"""Leaf blocks of web pages: the text between block-level tags, with the open tags around it."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Elements that do not break a block of text (fixed value: phrasing content).
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Parts of formulas; they do not break a block either, but their texts stand apart (fixed value).
MATH = frozenset(
    "annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts "
    "mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
# Elements whose content is no text of the page. Browsers read those in RAW as characters up to the end tag, or to the
# end of the page without one; those in HIDDEN hold elements (fixed values).
RAW = frozenset("script style noscript textarea iframe title".split())
HIDDEN = frozenset("template svg canvas object audio video select".split())
# Elements that end an open one of the same kind (fixed value: optional end tags).
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NOT_IN_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*|/)?)>|<[a-zA-Z/][^>]*(?:>|\Z)|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAMES = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Block:
    """A leaf block: its text, the open elements around it (outermost first) and how many characters are linked."""

    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int


def _names(attributes: str) -> tuple[str, ...]:
    """Words of the class, id, role and similar attributes."""
    if "=" not in attributes:
        return ()
    found = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label", "data-component"):
            found += [w.lower() for w in _NAMES.findall("".join(values))]
        elif name.lower() in ("hidden", "aria-hidden"):
            found.append("hidden")
    return tuple(found)


def leaf_blocks(page: str | None) -> list[Block]:
    """The non-empty leaf blocks of a page in page order, character references decoded, white space collapsed.

    Never fails: broken markup is read as browsers do in the common cases (unclosed tags, comments and quotes). The
    content of a ``HIDDEN`` element is left out where its end tag comes before its parent's; without that tag the element
    counts as empty, so that no text behind it is lost. Only an unclosed ``RAW`` element or comment drops the rest.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    before: list[int] = []  # blocks found before each element of the stack
    texts: list[str] = []
    linked = 0
    in_link = 0
    skip = ""
    page = page or ""

    def flush() -> None:
        nonlocal linked
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                out.append(Block(text, tuple(e for e in stack if e[0] not in INLINE and e[0] not in HIDDEN), linked))
            texts.clear()
        linked = 0

    at = 0
    while at < len(page):
        match = _TOKEN.match(page, at)
        at = match.end()
        close, tag, attributes = match.group(1), match.group(2), match.group(3)
        if tag is None:
            piece = match.group()
            if piece[0] != "<" or piece == "<":
                texts.append(piece)
                if in_link:
                    linked += len(piece)
            continue
        tag = tag.lower()
        if not close and tag in RAW and not attributes.endswith("/"):
            skip = f"</{tag}"
            end = re.compile(re.escape(skip) + r"\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            if tag not in INLINE:
                flush()
            continue
        if tag == "a":
            in_link = 0 if close else 1
        if tag in INLINE or tag in MATH or tag == "math":
            if tag == "br" or tag in MATH and not close:
                texts.append(" ")
            elif tag == "label" and not close:
                texts.append(" ")
            continue
        flush()
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in HIDDEN:
                        del out[before[i] :]
                    del stack[i:], before[i:]
                    in_link = 0
                    break
            continue
        ends = _CLOSES.get(tag, frozenset()) | ({"p"} if tag in _NOT_IN_P else set())
        while stack and stack[-1][0] in ends:
            stack.pop()
            before.pop()
        if tag not in VOID and not attributes.endswith("/"):
            stack.append((tag, _names(attributes)))
            before.append(len(out))
    flush()
    return out
