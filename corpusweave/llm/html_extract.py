"""Main text of web pages by composite text density.

Each page is read into a tree of elements. Every element has the characters and tags of its subtree, and those
of links in it; its composite density is characters per tag, lowered by a logarithm that grows with the links.
The element whose children have the largest sum of densities is the core of the article; where it is a line of text or
a part of one, its container is. Text outside
it belongs to the article as the path from the body to it tells (:func:`_taken`).
Elements that by their name or role are no article (menus, headers, footers, forms, scripts), and hidden ones, are
left out before densities are computed. Words of a class or an id (sidebars, notices, adverts, comments of readers)
only mark a candidate: it is left out if links hold half of its text or more, or if it is short or less dense than
the article's text, or stands outside of an article that holds none of them, and never if it holds the core or most of the page's text.

Pages are independent, so Spark deals them out and nothing is shuffled; the parser below sees one page at a time.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"(?P<skip><!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|select)\b"
    r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
# Every attribute with its value, so that a name within another name or a value is none.
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")

# Elements without content, with no article text, and those that start a new block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("nav footer aside form button dialog menu head object audio video canvas label fieldset annotation annotation-xml".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice"
    " notification alert popup modal overlay paywall nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside"
    " widget comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe subscription"
    " signup login toolbar pagination pager skip discussion thread".split()
)
# Of these, what readers say: no part of an article, however long. Of the others in TOLD, a paragraph in an article is its prose.
TALK_WORDS = frozenset("comment comments disqus respond reply replies discussion thread".split())
TOLD_WORDS = frozenset("notice alert header masthead related aside share recommended".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li"
    " main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Blocks of running text: inline elements inside one are judged by it.
_LINES = HEADINGS | frozenset("p li dt dd td th caption figcaption pre summary".split())
#: An element that is named as noise is taken as prose only from so many characters outside links on.
SHORT = 80
# An element that ends an open one of the same row, where it starts.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_LISTS = frozenset("ul ol dl table".split())


def _is_noise(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in NOISE_TAGS or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in NOISE_ROLES


def _mark(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """Of the names in the class and the id: 3 if one is of talk alone, 2 if one consists of noise words, 4 if those are words
    that an article's own paragraphs bear as well, 1 if one holds a noise word, else 0."""
    if tag in ("html", "body", "article", "main") or tag in HEADINGS:
        return 0
    mark = 0
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        noise = [w in NOISE_WORDS and not (in_article and w in ("header", "masthead")) for w in words]
        if words and all(noise):
            if all(w in TALK_WORDS for w in words):
                return 3
            mark = 4 if mark in (0, 1, 4) and all(w in TOLD_WORDS for w in words) else 2
        elif any(noise):
            mark = max(mark, 1)
    return mark


def _attributes(source: str) -> dict[str, str]:
    """Of a name given twice the first counts."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(source):
        found.setdefault(name.lower(), (a or b or c).lower())
    return found


class _Page:
    """Elements of a page in page order; ``pieces`` holds (element, text, starts a block)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.link = ["#page"], [0], [False]
        self.noisy, self.quiet = [False], [False]
        self.mark, self.in_article = [0], [False]
        self.pieces: list[tuple[int, str, bool]] = []
        stack, noise, articles, fresh = [0], 0, 0, True
        for m in _TOKEN.finditer(source):
            text = m["text"]
            if text is not None:
                if not noise:
                    self.pieces.append((stack[-1], text, fresh))
                    fresh = False
                continue
            if m["skip"] is not None:
                continue
            tag = (m["tag"] or m["tag2"]).lower()
            if m["end"] or m["end2"]:
                fresh = fresh or tag in BLOCKS
                at = next((k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == tag), 0)
                gone = stack[at:] if at else []
            else:
                fresh = fresh or tag in BLOCKS
                at = 0
                if tag in _ENDS:
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] in _LISTS:
                            break
                        if self.tag[stack[k]] in _ENDS[tag]:
                            at = k
                elif tag in BLOCKS:  # a block ends an open paragraph
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == "p":
                            at = k
                        if self.tag[stack[k]] in BLOCKS:
                            break
                gone = stack[at:] if at else []
            if gone:
                noise -= sum(1 for n in gone if self.noisy[n])
                articles -= sum(1 for n in gone if self.tag[n] in ("article", "main"))
                del stack[at:]
            if m["end"] or m["end2"]:
                continue
            if tag in VOID:
                if tag in ("br", "hr") and not noise:
                    self.pieces.append((stack[-1], " ", fresh))
                if not noise:
                    self._add(tag, stack[-1], False)
                continue
            attrs = _attributes(m["attrs"]) if m["attrs"] else {}
            bad = _is_noise(tag, attrs, articles > 0)
            if noise and not bad:
                # Inside of noise only the nesting matters.
                stack.append(self._add(tag, stack[-1], False, quiet=True))
            else:
                stack.append(self._add(tag, stack[-1], bad, quiet=noise > 0))
                if not bad and attrs:
                    self.mark[-1] = _mark(tag, attrs, articles > 0)
            self.in_article[-1] = articles > 0
            noise += bad
            articles += tag in ("article", "main")

    def _add(self, tag: str, parent: int, bad: bool, quiet: bool = False) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.link.append(tag == "a" or self.link[parent])
        self.noisy.append(bad)
        self.quiet.append(quiet or bad)
        self.mark.append(0)
        self.in_article.append(False)
        return len(self.tag) - 1

    def leave_out(self, roots: set[int], quiet: list[bool]) -> list[bool]:
        """``quiet`` with the elements of these subtrees."""
        under = [False] * len(quiet)
        for k in range(1, len(quiet)):
            under[k] = k in roots or under[self.parent[k]]
        return [q or u for q, u in zip(quiet, under)]

    def measure(self, quiet: list[bool]) -> tuple[list[float], list[float], int, list[int], list[int]]:
        """Composite densities, sums over children, the body, characters and those of links; without ``quiet``."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text, _ in self.pieces:
            if quiet[node]:
                continue
            size = len(_SPACE.sub("", text))
            chars[node] += size
            if self.link[node]:
                link_chars[node] += size
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            chars[p] += chars[k]
            link_chars[p] += link_chars[k]
            tags[p] += tags[k] + (not quiet[k])
            link_tags[p] += link_tags[k] + (self.tag[k] == "a" and not quiet[k])
        body = next((k for k in range(n) if self.tag[k] == "body"), 0)
        density = [0.0] * n
        for k in range(n):
            if chars[k] and not quiet[k]:
                c, lc = chars[k], max(1, link_chars[k])
                t, lt = max(1, tags[k]), max(1, link_tags[k])
                base = math.log(c / max(1, c - link_chars[k]) * lc + link_chars[body] / max(1, chars[body]) * c + math.e)
                density[k] = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt), base))
        total = [0.0] * n
        for k in range(1, n):
            total[self.parent[k]] += density[k]
        return density, total, body, chars, link_chars

    def core(self, density: list[float], total: list[float], body: int) -> list[int]:
        """The path from the element whose children have the largest sum of densities up to the body."""
        n = len(self.tag)
        inside = [False] * n  # of the body
        for k in range(n):
            inside[k] = k == body or k > 0 and inside[self.parent[k]]
        path = [max((k for k in range(n) if inside[k]), key=lambda k: (total[k], density[k], -k))]
        while path[-1] != body:
            path.append(self.parent[path[-1]])
        return path

    def without_noise(self) -> tuple[list[bool], list[int] | None]:
        """``quiet`` with the marked elements that their text confirms as no part of an article; the path of the core
        where candidates don't bear on it."""
        n = len(self.tag)
        marked = [k for k in range(n) if self.mark[k] and not self.quiet[k]]
        if not marked:
            return self.quiet, None
        density, total, body, chars, link_chars = self.measure(self.quiet)
        prose = [c - lc for c, lc in zip(chars, link_chars)]
        path = self.core(density, total, body)
        most = {k for k in marked if 2 * prose[k] > prose[body]}
        # Where an article stands outside of the named candidates, its text is the measure, not that of long comments.
        # A candidate that holds most of the text and the title or the main element is none of them.
        titled = [self.tag[k] in ("h1", "main") and not self.quiet[k] for k in range(n)]
        for k in range(n - 1, 0, -1):
            titled[self.parent[k]] |= titled[k]
        named = {k for k in marked if self.mark[k] >= 2 and not (k in most and titled[k])}
        trial = self.leave_out(named, self.quiet)
        outside = any(self.tag[k] in ("article", "main") and prose[k] and not trial[k] for k in range(n))
        if outside:
            density_, total_, *_ = self.measure(trial)
            path = self.core(density_, total_, body)
            most -= named
        core, spared = path[0], set(path)
        lines = [density[k] for k in range(1, n) if self.parent[k] == core and density[k] > 0]
        usual, least = sum(lines) / max(1, len(lines)), min(density[k] for k in path)
        within, line, gone = [False] * n, [0] * n, set()
        for k in range(1, n):
            within[k] = k == core or within[self.parent[k]]
            line[k] = k if self.tag[k] in _LINES else 0 if self.tag[k] in BLOCKS else line[self.parent[k]]
        for k in marked:
            of = line[k] or k  # the length of a piece of a line says nothing, only what share of the line is links
            if k in spared or k in most or self.tag[of] in HEADINGS:
                continue
            if 2 * link_chars[of] >= chars[of] or self.mark[k] == 3 and of == k:
                gone.add(k)
            elif self.mark[k] >= 2:
                told = self.mark[k] == 4 and self.tag[k] in _LINES and self.in_article[k] and prose[k] >= SHORT
                if not told and of == k and (outside and not self.in_article[k] or prose[k] < SHORT or 2 * density[k] < usual):
                    gone.add(k)
            elif of == k and not self.in_article[k] and not within[k] and density[k] < least:
                gone.add(k)
        return self.leave_out(gone, self.quiet), path if outside else None


def _taken(page: _Page, quiet: list[bool], path: list[int], body: int, chars: list[int], link_chars: list[int]) -> list[bool]:
    """Elements whose text belongs to the article around the core, the first of ``path``, which leads up to the body.

    The article is the outermost ``article`` or ``main`` on the path, else what can be reached from the core: there, text
    outside the core belongs to it if it has half as many characters outside links per tag as the element of the path that it
    stands beside, or if it stands in a container with the core to which links add little. That measure doesn't depend on an
    element's size, so titles, leads and short sections aren't judged by the length of the longest one. Blocks of links
    alone are menus anywhere. A heading goes with the block behind it.
    """
    n = len(page.tag)
    children: list[list[int]] = [[] for _ in range(n)]
    tags = [0] * n
    for k in range(1, n):
        children[page.parent[k]].append(k)
    for k in range(n - 1, 0, -1):
        tags[page.parent[k]] += tags[k] + (not quiet[k])
    prose = [c - x for c, x in zip(chars, link_chars)]
    plain = [x / max(1, t) for x, t in zip(prose, tags)]
    on_path = set(path)
    root = next((k for k in reversed(path) if page.tag[k] in ("article", "main")), None)
    inside = [False] * n  # of the article
    for k in range(n):
        inside[k] = k == path[0] or k == root or k > 0 and inside[page.parent[k]]
    titled = [0] * n  # characters in titles
    for k in range(n - 1, 0, -1):
        titled[k] = chars[k] if page.tag[k] == "h1" and not quiet[k] and 2 * link_chars[k] < chars[k] else titled[k]
        titled[page.parent[k]] += titled[k]
    title = any(titled[k] for k in range(n) if inside[k])

    def links_only(k: int) -> bool:
        return page.tag[k] in BLOCKS and page.tag[k] not in _LINES and chars[k] > 0 and 10 * link_chars[k] >= 9 * chars[k]

    def belongs(k: int, friendly: bool) -> bool:
        if quiet[k]:
            return False
        if page.tag[k] not in BLOCKS and friendly:
            return True
        if links_only(k):
            return False
        if inside[k]:
            return True
        if 2 * link_chars[k] >= chars[k]:
            return False
        rows = root is None and page.tag[k] in beside and any(page.tag[c] in HEADINGS for c in children[k])
        return friendly or rows or 2 * plain[k] >= plain[inner or at]

    taken = [False] * n
    taken[body] = True
    todo = [body]
    while todo:
        at = todo.pop()
        own = children[at]
        beside = {page.tag[c] for c in own if c in on_path}
        inner = next((c for c in own if c in on_path), None)
        added = chars[at] - (chars[inner] if inner else 0)
        added_links = link_chars[at] - (link_chars[inner] if inner else 0)
        friendly = inside[at] or at != body and root is None and 2 * added_links < added
        follows: bool | None = None  # whether the block behind is taken
        for c in reversed(own):
            heading = page.tag[c] in HEADINGS and c not in on_path
            if c in on_path or not title and titled[c] and titled[c] == chars[c]:  # the title stands beside the article
                ok = True
            elif heading and not quiet[c]:
                ok = (inside[at] or root is None) and (inside[at] or friendly if follows is None else follows)
            else:
                ok = belongs(c, friendly)
            if not quiet[c] and page.tag[c] in BLOCKS and chars[c] and not heading:
                follows = ok
            if ok:
                taken[c] = True
                todo.append(c)
    return taken


def main_text(source: str) -> str:
    """The main text of one page; empty if there is none."""
    page = _Page(source)
    if not page.pieces:
        return ""
    quiet, path = page.without_noise()
    density, total, body, chars, link_chars = page.measure(quiet)
    path = path or page.core(density, total, body)
    # A single line of text, or a part of one, is no article: its container is.
    while path[0] != body and (page.tag[path[0]] in _LINES or page.tag[path[0]] not in BLOCKS):
        path = path[1:]
    taken = _taken(page, quiet, path, body, chars, link_chars)
    blocks: list[list[str]] = []
    for node, text, fresh in page.pieces:
        if fresh or not blocks:
            blocks.append([])
        if taken[node] and not quiet[node]:
            blocks[-1].append(text)
    clean = (_SPACE.sub(" ", html.unescape("".join(b))).strip() for b in blocks)
    return " ".join(x for x in clean if x)


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` and ``text`` for every page; whole pages.

    Null and empty pages, and pages without an article, have an empty text. Broken markup is read as far as it
    goes. Repeated pages each get their row; an empty table gives an empty result; other columns are ignored. Of a kept
    column called ``text`` the extracted text takes the place. Of elements with equal densities the first one counts.
    """
    keep = tuple(c for c in keep if c != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [main_text(x.as_py() or "") for x in part.column("__html")]
                yield part.drop_columns(["__html"]).append_column("text", pa.array(found, pa.string()))

    rows = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema)
