"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its path of tags (and class words) from the root. For every path, text length,
punctuation and the share of text in links are summed over its blocks. Block values are smoothed along the page; the ratios
are fused with the number of blocks of the path and with a weight of the path's names; the paths at or above a threshold
are the content paths, and their blocks are content.

Content seldom has headings and one-word paragraphs on paths of high ratio, so blocks beside content are returned too: those
of an <article> or <main> that holds content, and of the elements in which content blocks lie. Beside content, a part
without any content path goes if most of it is links or its own name says that it is no part of the text. Names alone never
remove a part that has content paths: they only weigh less in the comparison of paths.
Parts that the HTML standard sets apart (nav, header, footer, aside, scripts and the like, and their roles) are never text.
Time and memory are linear in the page.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm.common import col, table

# Tags and roles of the HTML standard.
RAW_TAGS = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split())
APART_TAGS = frozenset("head nav footer aside script style noscript template iframe button select option textarea svg canvas object dialog menu search title".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
ENDS_P = BLOCK_TAGS - frozenset("body html head option tbody td tfoot th thead tr caption legend".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
ROOTS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3".split())
#: Elements that group others; paragraphs, headings and list items are parts of a text whatever they are called.
GROUPS = frozenset("div section ul ol dl table fieldset form center details figure dir article span".split())

# Choices of this module.
#: Class and id words of groups that are rarely a part of the text; such a path weighs NAME_WEIGHT as much.
OTHER_NAMES = frozenset(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal "
    "newsletter subscribe subscription signup login sidebar sidenav widget menu nav navbar navigation breadcrumb breadcrumbs masthead topbar footer "
    "comment comments comentarios kommentare commentaires reply replies respond disqus share sharing social related recommended toolbar pagination pager copyright".split())
NAME_WEIGHT = 0.3
#: An <article> or <main> weighs more; an <article> in another is a comment by the standard, and weighs as little as the names do.
ROOT_WEIGHT = 5.0
SMOOTH = (0.25, 0.5, 0.25)
THRESHOLD = 0.6
#: A part without content paths goes if over this share of its text is in links, and there are two links or more.
LINK_SHARE = 0.7
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？¿¡…]")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"""|<([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_NAME = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


def _names(attributes: str) -> tuple[str, set[str], str]:
    """Class and id as they stand, their words, and the role."""
    label, words, role = [], set(), ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() == "role":
            role = value.strip().lower()
            continue
        label.append(value)
        words.update(_NAME.split(_CAMEL.sub(r"\1-\2", value).lower()))
    return ".".join(label), words, role


class Page:
    """Elements of a page in page order, as parallel lists, and its blocks of text."""

    def __init__(self, page: str):
        #: Of each element: tag, parent, path, nearest block element or itself, whether set apart, in a link, in an article, ill named; and its weight.
        self.tag, self.parent, self.path, self.block = [""], [-1], [0], [0]
        self.apart, self.link, self.rooted, self.other, self.weight = [False], [False], [False], [False], [1.0]
        #: Of each block: element, text, code points in links, links.
        self.at, self.text, self.linked, self.links = [], [], [], []
        self.paths: dict[tuple[int, str], int] = {}
        self._read(page)

    def _read(self, page: str) -> None:
        stack, opened = [0], {}  # opened: places in the stack of the open elements of each tag
        parts: list[tuple[int, str]] = []

        def flush():
            if parts:
                text = _SPACE.sub(" ", "".join(t for _, t in parts)).strip(" ")
                if text:
                    e = max(parts, key=lambda p: len(p[1]))[0]
                    inside = [(e, t) for e, t in parts if self.link[e]]
                    self.at.append(self.block[e])
                    self.text.append(text)
                    self.linked.append(min(len(text), sum(len(_SPACE.sub(" ", t).strip(" ")) for _, t in inside)))
                    self.links.append(len({e for e, _ in inside}))
                parts.clear()

        def close(place: int):
            """Ends the open elements from a place in the stack on."""
            while len(stack) > place:
                tag = self.tag[stack.pop()]
                opened[tag].pop()
                if tag in BLOCK_TAGS:
                    flush()

        at, end = 0, len(page)
        while at < end:
            m = _TOKEN.search(page, at)
            stop = m.start() if m else end
            here = stack[-1]
            if stop > at and not self.apart[here]:
                parts.append((here, html.unescape(page[at:stop])))
            if not m:
                break
            at = m.end()
            if m[1]:
                tag = m[1].lower()
                if opened.get(tag):
                    close(opened[tag][-1])
                elif tag in BLOCK_TAGS:
                    flush()
                elif tag == "br" and not self.apart[here]:
                    parts.append((here, " "))
                continue
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag in BLOCK_TAGS:
                flush()
            if tag in ENDS_P and opened.get("p"):
                close(opened["p"][-1])
            if tag in IMPLIED:
                last = max((opened[t][-1] for t in IMPLIED[tag] if opened.get(t)), default=-1)
                if last > max((opened[t][-1] for t in SCOPES[tag] if opened.get(t)), default=-1):
                    close(last)
            here = stack[-1]
            if tag in VOID_TAGS:
                if tag in ("br", "hr", "wbr") and not self.apart[here]:
                    parts.append((here, "" if tag == "wbr" else " "))
                continue
            e = self._open(tag, here, m[3])
            opened.setdefault(tag, []).append(len(stack))
            stack.append(e)
            if tag in RAW_TAGS:
                ends = _RAW_ENDS[tag].search(page, at)
                stop = ends.start() if ends else end
                if not self.apart[e]:
                    parts.append((e, page[at:stop]))
                at = stop
        flush()

    def _open(self, tag: str, parent: int, attributes: str) -> int:
        label, words, role = _names(attributes) if "=" in attributes else ("", (), "")
        whole = tag in ("html", "body")
        root = tag in ROOTS or role in ROOTS
        apart = self.apart[parent] or tag in APART_TAGS or (not whole and role in APART_ROLES) or (tag == "header" and not self.rooted[parent])
        other = not whole and tag in GROUPS and (tag == "form" or role == "form" or not OTHER_NAMES.isdisjoint(words))
        nested = tag == "article" and self._in_article(parent)
        weight = self.weight[parent] * (NAME_WEIGHT if other or nested else ROOT_WEIGHT if root and not self.rooted[parent] else 1.0)
        e = len(self.tag)
        for values, value in ((self.tag, tag), (self.parent, parent), (self.apart, apart), (self.link, self.link[parent] or tag == "a"), (self.rooted, self.rooted[parent] or root),
                              (self.other, other or nested), (self.weight, weight)):
            values.append(value)
        block = tag in BLOCK_TAGS
        self.block.append(e if block else self.block[parent])
        self.path.append(self.paths.setdefault((self.path[parent], f"{tag}.{label}"), len(self.paths) + 1) if block else self.path[parent])
        return e

    def _in_article(self, e: int) -> bool:
        return self.rooted[e] and (self.tag[e] == "article" or self._article_above(e))

    def _article_above(self, e: int) -> bool:
        memo, line = self.__dict__.setdefault("_above", {}), []
        while e > 0 and e not in memo and self.tag[e] != "article" and self.rooted[e]:
            line.append(e)
            e = self.parent[e]
        found = memo.get(e, e > 0 and self.tag[e] == "article")
        memo.update(dict.fromkeys(line, found))
        return found


_RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW_TAGS}


def path_ratios(page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(paths, which path each block has, fused ratio of each path).

    Fused: log of the mean smoothed length, times log of the mean punctuation, times the square of the share outside of
    links, times one plus the log of the number of blocks, times the path's weight.
    """
    length = np.array([len(t) for t in page.text], float)
    marks = np.array([len(PUNCTUATION.findall(t)) for t in page.text], float)
    linked = np.array(page.linked, float)
    wide = np.pad(length, 1, mode="edge")
    smooth = np.minimum(SMOOTH[0] * wide[:-2] + SMOOTH[1] * wide[1:-1] + SMOOTH[2] * wide[2:], length)  # a short block beside a long one stays short
    paths, which = np.unique(np.array([page.path[e] for e in page.at]), return_inverse=True)
    weight = np.zeros(len(paths))
    weight[which] = [page.weight[e] for e in page.at]
    n, total = np.bincount(which), np.bincount(which, length)
    text, punct, link = np.bincount(which, smooth) / n, np.bincount(which, marks) / n, np.bincount(which, linked) / total
    return paths, which, np.log1p(text) * np.log1p(1 + punct) * (1 - link) ** 2 * (1 + np.log(n)) * weight


def content_blocks(page: Page) -> np.ndarray:
    """Which blocks are on content paths: those whose fused ratio reaches the threshold."""
    _, which, fused = path_ratios(page)
    length = np.array([len(t) for t in page.text], float)
    least = THRESHOLD * np.average(fused, weights=np.bincount(which, length))
    return ((fused >= least) & (fused > 0))[which]


def main_text(page: str | None) -> str:
    """The article's blocks, joined by blank lines; empty for a page without text."""
    p = Page(page) if page else None
    if p is None or not p.text:
        return ""
    chosen = content_blocks(p)
    if not chosen.any():
        return ""
    n = len(p.tag)
    # Of each element and all below it: content blocks, text, text in links, links.
    content, size, linked, links = [0] * n, [0] * n, [0] * n, [0] * n
    for e, c, t, a, k in zip(p.at, chosen.tolist(), p.text, p.linked, p.links):
        content[e] += c
        size[e] += len(t)
        linked[e] += a
        links[e] += k
    for e in range(n - 1, 0, -1):
        up = p.parent[e]
        content[up] += content[e]
        size[up] += size[e]
        linked[up] += linked[e]
        links[up] += links[e]
    whole = [not e or p.tag[e] in ("html", "body") for e in range(n)]
    # Where blocks beside content are returned: the outermost article or main with content, the group that each other content
    # block lies in, and the lowest element that holds all of these where that is not the page itself.
    holder = [False] * n
    group = [0] * n  # the nearest group of an element, itself included
    root = [-1] * n  # the outermost article or main
    for e in range(1, n):
        up = p.parent[e]
        group[e] = e if whole[e] or p.tag[e] in ("div", "section", "center", "td", "details", "article", "main", "fieldset", "form") else group[up]
        root[e] = root[up] if root[up] >= 0 else e if p.rooted[e] else -1
    loose = 0
    for e, c in zip(p.at, chosen.tolist()):
        if c:
            loose += root[e] < 0
            holder[root[e] if root[e] >= 0 else group[e] if group[e] != e or p.tag[e] in ("div", "section", "td") else e] = True
    total = content[0]
    if loose == total:
        lowest = max(e for e in range(n) if content[e] == total)  # in page order, the last that has all is the lowest
        lowest = group[lowest]
        if not whole[lowest]:
            holder[lowest] = True
    first, last = (int(x) for x in np.flatnonzero(chosen)[[0, -1]])
    inside, gone, edge = [False] * n, [False] * n, [False] * n
    for e in range(n):
        up = p.parent[e]
        inside[e] = holder[e] or (e > 0 and inside[up])
        if e:
            bare = content[e] == 0 and p.tag[e] in GROUPS
            # A part without content at the page's own edge, which no other element holds together with content.
            edge[e] = edge[up] or (bare and whole[up] and p.tag[e] in ("div", "section", "table", "center", "span", "form"))
            gone[e] = gone[up] or (bare and (p.other[e] or (links[e] > 1 and linked[e] > LINK_SHARE * size[e])))
    kept = [c or (inside[e] and not gone[e] and not (edge[e] and not first < i < last)) for i, (e, c) in enumerate(zip(p.at, chosen.tolist()))]
    # The heading over the text, where it stands before the element that holds the text.
    start = kept.index(True)
    for i in range(start - 1, max(-1, start - 4), -1):
        e = p.at[i]
        if p.tag[start_e := p.at[start]] not in HEADINGS and p.tag[e] in HEADINGS and not gone[e] and p.weight[e] >= p.weight[start_e] / ROOT_WEIGHT:
            kept[i] = True
            break
    return "\n\n".join(t for t, k in zip(p.text, kept) if k)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row; row by row, without a shuffle.

    Null and empty pages, and pages of links alone, have the empty text. Null ids and urls stay null; repeated rows give
    repeated rows; other columns are not read, so their names do not matter. No rows in, none out. Pages of any length and
    depth take time and memory in proportion. Markup that is not closed is closed where its parent ends.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"), col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_main_text(spark, sf_dir) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
