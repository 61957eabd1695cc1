"""Pages as trees of labelled nodes and pieces of text, read leniently from HTML.

Tags open and close as in browsers where it matters for text: void elements, elements whose end is implied
(p, li, td, ..), ends without a start, raw text, comments, quotes in attributes. Only elements of the
block kind, or with a class, id or role, are nodes; other inline elements pass their text to the node
around them. What is never text (head, script, style, form controls, ..) leaves no pieces.

A node's label is its tag, classes, id and role, digits written as 0. Its key is a 64-bit hash of the
site, the labels from the root down to it, and, for containers, which of the equally labelled siblings
it is; so equal places of the pages of a site share a key.
"""

from __future__ import annotations

import re
from html import unescape

import xxhash

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noframes noembed xmp".split())
NEVER = set("head script style noscript template textarea title iframe noframes noembed xmp svg math canvas audio video object select button datalist map".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr caption ul".split()
)
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title head html".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "body", "html"}
SAME = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
        "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
BARRIER = {"table", "td", "th", "caption", "html", "body"}
TABLE = set("table tbody thead tfoot tr td th caption body html".split())

#: Repeatable flow elements are one node however many stand side by side.
FLOW = set("p li dd dt tr td th h1 h2 h3 h4 h5 h6 blockquote pre br hr figcaption option".split())

#: Words of classes, ids and roles that name what is not the article.
NOISE = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion promoted nav navbar navigation menu submenu breadcrumb "
    "breadcrumbs header masthead topbar banner footer contentinfo copyright sidebar aside complementary rail widget widgets related recommended recommendations "
    "share sharing social subscribe subscription newsletter signup login search cookie cookies consent gdpr notice alert alertdialog dialog popup modal overlay "
    "comment comments commentlist disqus reply replies respond discussion pager pagination toolbar skip disclaimer paywall form".split()
)
#: With one of these beside them, the words of HEADER do not name a page's own header.
OWN = set("article post entry story content title headline body main".split())
HEADER = set("header masthead topbar banner".split())
NOISE_TAGS = set("nav aside footer header form dialog menu fieldset search".split())
ROOT_TAGS = {"article": 2, "main": 1}

TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?/])")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ATTRIBUTES = {"class", "id", "role", "hidden", "style", "aria-hidden", "itemprop"}


def host_of(url: str | None) -> str | None:
    found = HOST.match(url) if url else None
    return found[1].lower() if found and found[1] else None


def hash64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_named: dict[tuple, tuple[str, bool, bool]] = {}


def name_of(tag: str, attrs: dict) -> tuple[str, bool, bool]:
    """(label, named as noise, named as a page's header); kept for the names met most."""
    key = (tag, attrs.get("class", ""), attrs.get("id", ""), attrs.get("role", ""), "hidden" in attrs, attrs.get("aria-hidden"), attrs.get("style"))
    found = _named.get(key)
    if found is None:
        classes = [c for c in key[1].split() if not re.match(r"(?:has|no|with|is|js)-", c)]
        label = DIGITS.sub("0", f"{tag}.{'.'.join(sorted(key[1].split()))}#{key[2]}@{key[3]}")
        words = {w.lower() for name in (*classes, key[2], key[3]) for w in WORD.findall(name)} if tag not in ("html", "body") else set()
        headed = bool(words & HEADER) or tag == "header"
        noisy = words & NOISE - HEADER or (headed and not words & OWN) or tag in NOISE_TAGS - {"header"}
        noisy = noisy or key[4] or key[5] == "true" or bool(key[6] and HIDING.search(key[6]))
        found = (label, bool(noisy), headed and not words & (NOISE - HEADER))
        if len(_named) > 100_000:
            _named.clear()
        _named[key] = found
    return found


class Page:
    """parent, tag, label, noise, header of each node (parents first), and pieces (block, node, link, text)."""

    def __init__(self, html: str | None):
        self.parent, self.tag, self.label, self.noise, self.header, self.prop = [-1], ["#"], ["#"], [False], [False], [""]
        self.pieces: list[tuple[int, int, bool, str]] = []
        if html:
            self._read(html)

    def _read(self, html: str) -> None:
        # open elements: (tag, node, never text, inside a link)
        stack: list[tuple[str, int, bool, bool]] = [("#", 0, False, False)]
        block, at, end, lower = 0, 0, len(html), None
        pieces = self.pieces
        while at < end:
            found = TAG.search(html, at)
            stop = found.start() if found else end
            if stop > at and not stack[-1][2]:
                text = html[at:stop]
                pieces.append((block, stack[-1][1], stack[-1][3], unescape(text) if "&" in text else text))
            if not found:
                break
            at = found.end()
            closing, tag = found[1], found[2]
            if tag is None:  # a comment or a declaration
                mark = "-->" if found[0] == "<!--" else ">"
                stop = html.find(mark, at)
                at = end if stop < 0 else stop + len(mark)
                continue
            tag = tag.lower()
            attrs: dict[str, str] = {}
            while at < end and html[at] != ">":
                a = ATTRIBUTE.match(html, at)
                if a is None or a.end() == at:
                    at += 1
                    continue
                at = a.end()
                name = a[1].lower()
                if name in ATTRIBUTES and name not in attrs:
                    attrs[name] = a[2] or a[3] or a[4] or ""
            at += 1
            if tag == "br" or tag == "wbr":
                if tag == "br" and not stack[-1][2]:
                    pieces.append((block, stack[-1][1], stack[-1][3], " "))
                continue
            if tag in BLOCK:
                block += 1
            if closing:
                self._close(stack, tag)
                continue
            if stack[-1][0] == "head" and tag not in IN_HEAD:
                stack.pop()
            if tag in CLOSES_P:
                self._imply(stack, {"p"}, BARRIER | {"button"})
            if tag in SAME:
                self._imply(stack, *SAME[tag])
            elif tag[0] == "h" and len(tag) == 2 and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                stack.pop()
            if tag in VOID:
                continue
            _, node, never, link = stack[-1]
            if tag in RAW:
                lower = html.lower() if lower is None else lower
                if len(lower) != end:  # lower-casing changed lengths: look in the text itself
                    close = re.compile(f"</{tag}", re.I).search(html, at)
                    stop = close.start() if close else -1
                else:
                    stop = lower.find(f"</{tag}", at)
                if stop < 0:
                    break
                stop = html.find(">", stop)
                at = end if stop < 0 else stop + 1
                continue
            never = never or tag in NEVER
            if not never and (tag in BLOCK or attrs):
                if not (tag in ("html", "body") and any(t == tag for t, *_ in stack)):
                    label, noisy, header = name_of(tag, attrs)
                    self.parent.append(node)
                    self.tag.append(tag)
                    self.label.append(label)
                    self.noise.append(noisy)
                    self.header.append(header)
                    self.prop.append(attrs.get("itemprop", "") or ("main" if attrs.get("role") == "main" else ""))
                    node = len(self.parent) - 1
            stack.append((tag, node, never, link or tag == "a"))

    @staticmethod
    def _imply(stack: list, closed: set, until: set) -> None:
        """Closes the outermost open element of `closed` above an element of `until`."""
        cut = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in closed:
                cut = k
            elif stack[k][0] in until:
                break
            elif cut is None and stack[k][0] in BLOCK and closed == {"p"}:
                break
        if cut is not None:
            del stack[cut:]

    @staticmethod
    def _close(stack: list, tag: str) -> None:
        if tag in ("html", "body"):
            return  # what follows is still text of the body
        inline = tag not in BLOCK and tag not in NEVER
        for k in range(len(stack) - 1, 0, -1):
            here = stack[k][0]
            if here == tag:
                del stack[k:]
                return
            if (inline and here in BLOCK) or (here in BARRIER and tag not in TABLE):
                return

    def keys(self, site: str) -> list[int]:
        """The key of each node."""
        own, turns = [hash64(site)], {}
        for k in range(1, len(self.parent)):
            label, up = self.label[k], own[self.parent[k]]
            turn = 0
            if self.tag[k] not in FLOW:
                at = (self.parent[k], label)
                turn = turns[at] = turns.get(at, -1) + 1
            own.append(hash64(f"{up}>{label}>{turn}"))
        return own

    def styles(self) -> list[str]:
        """The labels of each node's children in order, equal neighbours once."""
        found: list[list[str]] = [[] for _ in self.parent]
        for k in range(1, len(self.parent)):
            of = found[self.parent[k]]
            if not of or of[-1] != self.label[k]:
                of.append(self.label[k])
        return [" ".join(x) for x in found]

    def blocks(self) -> list[tuple[int, list[int], str]]:
        """(node that holds it, its pieces, text) of each block with text."""
        found, x = [], 0
        while x < len(self.pieces):
            y, b = x, self.pieces[x][0]
            while y < len(self.pieces) and self.pieces[y][0] == b:
                y += 1
            text = squeeze("".join(p[3] for p in self.pieces[x:y]))
            if text:
                found.append((self.pieces[x][1], list(range(x, y)), text))
            x = y
        return found


def squeeze(text: str) -> str:
    return " ".join(text.split())
