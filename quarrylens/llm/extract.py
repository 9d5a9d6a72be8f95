"""The main text of web pages by tag-path ratios.

A page is read once into elements and blocks (the text of one block-level
element between its block-level children). Blocks under elements that say what
they are (menus, footers, forms, adverts, notices, comments, what is hidden) are
set aside. Of the others, those with the same root-to-leaf path of block-level
tags and classes are one group: its text length and punctuation per block, the
two smoothed along the page by a Gaussian and fused, make the path's ratio, less
its share of link text. Paths whose ratio reaches a part of the page's mean
(weighted by text) are content. The content's region, an article or main element
where there is one, also gives the blocks that its paths miss: headings, short
lists, tables, captions; groups that are mostly links stay out.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from quarrylens.llm.common import map_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; it ends at their own end tag only.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav noscript ol optgroup option p pre search section summary table caption tbody thead tfoot tr ul head select template title svg math object video audio canvas".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What a start tag closes, and where the search for it stops.
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), frozenset(("table", "tbody", "thead", "tfoot"))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tbody": (frozenset(("tbody", "thead", "tfoot")), frozenset(("table",))),
    "tfoot": (frozenset(("tbody", "thead", "tfoot")), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select",))),
    "body": (frozenset(("head",)), frozenset(("html",))),
}
PARAGRAPH = frozenset(("p",))
NO_P = frozenset("button td th caption table".split())
#: Never the article.
NEVER = frozenset("head script style title template noscript nav footer aside menu dialog button select option optgroup textarea datalist iframe object embed svg math canvas video audio noembed noframes xmp search".split())
#: Words of classes and ids that name other things than the article; those of reader comments hold whatever is inside.
COMMENTS = frozenset("comment comments commentlist commentary disqus reply replies respond responses discussion".split())
OTHER = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored promo promos promotion promoted "
    "nav navbar navigation menu menus breadcrumb breadcrumbs topbar masthead header footer sidebar sidebars aside rail "
    "cookie cookies consent gdpr notice notices alert alerts banner popup modal overlay paywall newsletter subscribe subscription signup login signin "
    "social share sharing shares sharebar follow related recommended recommendations teaser teasers popular trending widget widgets pagination pager toolbar search searchbox "
    "copyright disclaimer skip hidden form".split()
)
ARTICLE_WORDS = frozenset("article entry post story content body".split())
#: Where no element is an article, the smallest one with such a word that holds this share of the plain text is the region.
REGION_WORDS, REGION_SHARE = ARTICLE_WORDS | {"main"}, 0.6
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/>]|\Z))""", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_QUOTED = re.compile(r"""=\s*(["'])""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_COMMENT_HEAD = re.compile(r"(?:\d+\s+)?(?:reader(?:s'|'s)?\s+|user\s+)?(?:comments?|responses|replies|discussion|kommentare?|commentaires?|comentarios?|leave a (?:comment|reply))(?:\s*\(\d+\))?:?", re.I)
#: Open elements at once; those that lie deeper count as parts of the last.
DEEPEST = 512
ARTICLE, MAIN = 1, 2


class Page:
    """Elements (parent, tag, kind of main element, whether set aside) and blocks (element, text, characters of links) of a page, in page order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.words, self.role, self.aside = [-1], ["#"], [()], [0], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._open = [0], Counter()
        self._parts: list[str] = []
        self._links, self._link_depth, self._muted = 0, 0, 0
        self._home = [0]  # innermost block-level element for each open element
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append((self._home[-1], text, self._links))
            self._parts, self._links = [], 0

    def _text(self, raw: str) -> None:
        if self._muted:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self._parts.append(text)
        if self._link_depth:
            self._links += len("".join(text.split()))

    def _pop(self) -> None:
        e = self._stack.pop()
        tag = self.tag[e]
        if tag in BLOCK:
            self._flush()
        elif self.aside[e]:
            self._muted -= 1
        self._home.pop()
        self._open[tag] -= 1
        if self._link_depth > len(self._stack):
            self._link_depth = 0

    def _close(self, tags: frozenset, stop: frozenset) -> None:
        """Pops up to the nearest open element of ``tags``, unless one of ``stop`` is nearer."""
        if not any(self._open[t] for t in tags):
            return
        for at in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[at]]
            if tag in tags:
                while len(self._stack) > at:
                    self._pop()
                return
            if tag in stop:
                return

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._close(PARAGRAPH, NO_P)
            self._flush()
        elif tag in ("br", "td", "th"):
            self._parts.append(" ")
        if tag == "a":
            self._link_depth = 0
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in VOID or len(self._stack) > DEEPEST:
            return
        words, role, aside = (), 0, tag in NEVER
        if attributes:
            got: dict[str, str] = {}
            for k, v in _ATTRIBUTE.findall(attributes):
                got.setdefault(k.lower(), v.strip("\"'"))
            if got:
                words = tuple(w.lower() for k in ("class", "id") if k in got for w in _TOKENS.findall(got[k]))
                if got.get("role") in ("main", "article") or got.get("itemprop", "").lower() == "articlebody":
                    role = ARTICLE
                hides = got.get("style", "").replace(" ", "").lower()
                aside |= "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in hides or "visibility:hidden" in hides
                aside |= got.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu")
        if tag in ("article", "main"):
            role = ARTICLE if tag == "article" else MAIN
        e = len(self.tag)
        inline = tag not in BLOCK and tag not in ("td", "th")
        self.parent.append(self._stack[-1])
        self.tag.append(tag)
        self.words.append(words)
        self.role.append(role)
        self.aside.append(aside or (inline and not OTHER.isdisjoint(words)))
        self._stack.append(e)
        self._open[tag] += 1
        self._home.append(e if tag in BLOCK else self._home[-1])
        if tag not in BLOCK and self.aside[e]:
            self._muted += 1
        if tag == "a" and not self._link_depth:
            self._link_depth = len(self._stack)

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._parts.append(" ")
        if not self._open[tag]:
            if tag in BLOCK:
                self._flush()
            return
        at = next(i for i in range(len(self._stack) - 1, 0, -1) if self.tag[self._stack[i]] == tag)
        if tag in BLOCK or tag in ("td", "th") or all(self.tag[e] not in BLOCK for e in self._stack[at:]):
            while len(self._stack) > at:
                self._pop()
        else:  # a misplaced end tag of an inline element closes no block
            e = self._stack.pop(at)
            self._home.pop(at)
            self._open[tag] -= 1
            self._muted -= self.aside[e]
            if self._link_depth > at:
                self._link_depth = 0 if self._link_depth == at + 1 else self._link_depth - 1

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                self._text(s[at:])
                return
            if lt > at:
                self._text(s[at:lt])
            nxt = s[lt + 1 : lt + 2]
            if nxt == "!" and s.startswith("<!--", lt):
                end = lt + 4 if s.startswith(("<!-->", "<!--->"), lt) else s.find("-->", lt + 4)
                at = n if end < 0 else s.find(">", end) + 1
            elif nxt in ("!", "?") or (nxt == "/" and not s[lt + 2 : lt + 3].isalpha()):
                end = s.find(">", lt)
                at = n if end < 0 else end + 1
            elif nxt == "/" or (nxt.isascii() and nxt.isalpha()):
                name = _NAME.match(s, lt + 1 + (nxt == "/"))
                if not name:
                    self._text("<")
                    at = lt + 1
                    continue
                tag = name[0].lower()
                end = self._tag_end(s, name.end())
                if end < 0:
                    return  # a tag that the page's end cuts off
                at = end + 1
                if nxt == "/":
                    self._end(tag)
                    continue
                self._start(tag, s[name.end() : end])
                if tag in RAW:
                    stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(s, at)
                    if not stop:
                        return
                    at = stop.start()
            else:
                self._text("<")
                at = lt + 1

    def _tag_end(self, s: str, at: int) -> int:
        """Where the tag ends: the first > outside of quoted values; a quote that nothing closes is a letter like any other."""
        end = s.find(">", at)
        if end < 0:
            return -1
        part = s[at:end]
        if not part.count('"') % 2 and not part.count("'") % 2:
            return end
        pos = at
        while True:
            m = _QUOTED.search(s, pos, end)
            if not m:
                return end
            close = s.find(m[1], m.end())
            if close < 0:
                return end
            pos = close + 1
            if pos > end:
                end = s.find(">", pos)
                if end < 0:
                    return -1


def _inside(parent: list[int], of: list[bool]) -> list[bool]:
    """Whether an element or one of those around it is marked; parents come before their children."""
    out = of[:]
    for e in range(1, len(out)):
        out[e] = out[e] or out[parent[e]]
    return out


def _totals(parent: list[int], own: list[int]) -> list[int]:
    out = own[:]
    for e in range(len(out) - 1, 0, -1):
        out[parent[e]] += out[e]
    return out


def _set_aside(page: Page) -> list[bool]:
    """Elements that are no part of an article by their tag, class or id, or lie in such."""
    n = len(page.tag)
    own = [0] * n
    for e, text, _ in page.blocks:
        own[e] += len(text)
    size = _totals(page.parent, own)
    articles = _below(page.parent, [r > 0 for r in page.role])
    holds = [x or y for x, y in zip(articles, _below(page.parent, [t == "h1" for t in page.tag]))]
    in_article = _inside(page.parent, [r > 0 for r in page.role])
    aside = page.aside[:]
    for e in range(1, n):
        tag, words = page.tag[e], page.words[e]
        if aside[e] or tag in ("html", "body"):
            continue
        whole = holds[e] or 10 * size[e] > 6 * size[0]
        if tag == "header":
            aside[e] = not in_article[page.parent[e]] and not articles[e]
        elif tag == "form":
            aside[e] = not whole
        elif tag in HEADINGS or OTHER.isdisjoint(words):
            continue
        elif not COMMENTS.isdisjoint(words):
            aside[e] = page.role[e] != MAIN and not (holds[e] and 10 * size[e] > 9 * size[0])
        else:
            aside[e] = not whole and not ("header" in words and not ARTICLE_WORDS.isdisjoint(words))
    return _inside(page.parent, aside)


def _below(parent: list[int], of: list[bool]) -> list[bool]:
    """Whether an element holds a marked one."""
    return [t > m for t, m in zip(_totals(parent, [int(x) for x in of]), of)]


def path_ratios(path: np.ndarray, length: np.ndarray, links: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The ratio of each path: length and punctuation per block, smoothed along the page and fused, less the share of link text."""
    n = path.max() + 1
    count = np.bincount(path, minlength=n)
    plain = np.maximum(length - links, 0)
    kernel = np.exp(-np.arange(-2, 3) ** 2 / 0.72)

    def smooth(x: np.ndarray) -> np.ndarray:
        wide = np.convolve(x, kernel)[2:-2] if len(x) else x
        return wide / np.convolve(np.ones(len(x)), kernel)[2:-2]

    text = smooth((np.bincount(path, plain, n) / count)[path])
    points = smooth((np.bincount(path, marks, n) / count)[path])
    fused = np.bincount(path, text * (1 + points), n) / count
    return fused * (1 - np.bincount(path, np.minimum(links, length), n) / np.bincount(path, length, n))


def main_blocks(source: str | None) -> list[str]:
    """The blocks of the page's article, in page order."""
    if not source:
        return []
    page = Page(source)
    aside = _set_aside(page)
    late: dict[int, int] = {}  # from which block on an element holds reader comments
    blocks = []
    for i, (e, text, links) in enumerate(page.blocks):
        if page.tag[e] in HEADINGS and len(text) <= 60 and _COMMENT_HEAD.fullmatch(text):
            late.setdefault(page.parent[e], i)
        if not aside[e]:
            blocks.append((i, e, text, links))
    if late:
        ancestors: dict[int, int] = {0: late.get(0, len(page.blocks))}
        for e in range(1, len(page.tag)):
            ancestors[e] = min(ancestors[page.parent[e]], late.get(e, len(page.blocks)))
        blocks = [b for b in blocks if b[0] < ancestors[b[1]]]
    if not blocks:
        return []
    ids: dict[tuple, int] = {}
    trail = [0] * len(page.tag)
    for e in range(1, len(page.tag)):
        up = trail[page.parent[e]]
        trail[e] = ids.setdefault((up, page.tag[e], page.words[e]), len(ids) + 1) if page.tag[e] in BLOCK else up
    used: dict[int, int] = {}
    path = np.array([used.setdefault(trail[e], len(used)) for _, e, _, _ in blocks])
    length = np.array([len(t) for _, _, t, _ in blocks], float)
    links = np.array([k for *_, k in blocks], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for _, _, t, _ in blocks], float)
    element = [e for _, e, _, _ in blocks]
    region = _article(page, element, np.maximum(length - links, 0))
    inside = np.ones(len(blocks), bool)
    if region:
        mine = _inside(page.parent, [e == region for e in range(len(page.tag))])
        inside = np.array([mine[e] for e in element])
        first = int(np.argmax(inside))
        while first > 0 and page.tag[element[first - 1]] in HEADINGS:
            first -= 1
            inside[first] = True
    ratio = path_ratios(path, length, links, marks)
    weight = np.where(inside, length, 0)
    mean = float((ratio[path] * weight).sum() / max(weight.sum(), 1))
    content = inside & (ratio[path] >= 0.35 * mean)
    n = path.max() + 1
    count = np.bincount(path, minlength=n)
    linked = (np.bincount(path, np.minimum(links, length), n) / np.bincount(path, length, n) > 0.6) & (count >= 2)
    if region:
        keep = inside & ~(linked[path] & ~content)
    else:
        keep = content.copy()
        at = np.flatnonzero(content)
        if len(at):
            lo = int(at[0])
            while lo > 0 and page.tag[element[lo - 1]] in HEADINGS:
                lo -= 1
            keep[lo : at[-1] + 1] = ~linked[path][lo : at[-1] + 1] | content[lo : at[-1] + 1]
    heads = [page.tag[e] in HEADINGS for e in element]
    for i in range(len(blocks) - 1, -1, -1):  # a heading of which nothing is left but what was dropped goes too
        if keep[i] and heads[i] and i + 1 < len(blocks) and not keep[i + 1] and not heads[i + 1] and inside[i + 1]:
            rest = next((j for j in range(i + 1, len(blocks)) if keep[j] or heads[j]), len(blocks))
            keep[i] = rest < len(blocks) and keep[rest] and not heads[rest]
    return [t for (_, _, t, _), k in zip(blocks, keep) if k]


def _article(page: Page, element: list[int], plain: np.ndarray) -> int:
    """The article or main element with the article; else an element whose class or id names it; 0 if there is none.

    Of main elements, or articles in each other, the outermost, if it holds a fifth
    of the plain text; in it a single article with half of its text.
    """
    own = [0.0] * len(page.tag)
    for e, k in zip(element, plain):
        own[e] += float(k)
    size = _totals(page.parent, own)
    roles = [e for e in range(1, len(page.tag)) if page.role[e] and size[e] > 0]
    if not roles:
        named = [e for e in range(1, len(page.tag)) if page.tag[e] not in ("html", "body") and size[e] >= REGION_SHARE * size[0] > 0 and not REGION_WORDS.isdisjoint(page.words[e])]
        return min(named, key=lambda e: (size[e], -e), default=0)
    inner = _inside(page.parent, [r > 0 for r in page.role])
    outer = [e for e in roles if not inner[page.parent[e]]]
    best = max(outer, key=lambda e: (size[e], -e))
    if 5 * size[best] < size[0]:
        return 0
    if sum(size[e] for e in outer) - size[best] > 0.5 * size[best] and all(page.role[e] == ARTICLE for e in outer):
        return 0  # a list of articles: the whole page is the region
    for e in sorted((e for e in roles if e > best), key=lambda e: -size[e]):
        if _within(page.parent, e, best):
            return e if 2 * size[e] >= size[best] else best
    return best


def _within(parent: list[int], e: int, top: int) -> bool:
    while e > top:
        e = parent[e]
    return e == top


def extract(pages: DataFrame, *keep: str, source: str = "html") -> DataFrame:
    """The columns ``keep`` with text, the article's blocks joined by two line feeds, and n_chars, its code points.

    In a block character references are decoded and white space is one space. A
    null or empty page, or one without an article, has an empty text. Whole
    pages are read, however long, in time that grows with their length; a page
    may end anywhere and tags may be missing. Repeated rows stay.
    """

    def rows(x: dict) -> dict:
        text = ["\n\n".join(main_blocks(s)) for s in x[source]]
        return {**{c: x[c] for c in keep}, "text": text, "n_chars": [len(t) for t in text]}

    types = dict(pages.dtypes)
    cols = list(dict.fromkeys([*keep, source]))
    return map_batches(pages.select(*cols), rows, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "`text` string, `n_chars` bigint"]))


def op11_extract(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url")
