"""Main-text extraction by tag-path ratios.

A page is cut into text blocks, each with its root-to-leaf path of block elements (with their class and id). Text length without links
and punctuation are aggregated per path; the logarithms of both, per block of the path, are smoothed over the blocks in page
order and fused with the shares of the page's text and blocks that the element has which holds the path: one score per path. Paths
with a share of the best path's score are content. Short text elements (headings, list items, one-word paragraphs) are
read with the element that holds them: they are content if the paths below that element are.

What elements say about themselves only weights a score: article and main by three, class words of furniture (menus, adverts, comments and
the like) by a third. As the threshold is lower than a third, a class word by itself rejects nothing.

Elements that are never part of an article by their name (nav, footer, form, script and the like) are not read at all.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, record_batches

#: Elements by role.
MATHS = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split())
INLINE = MATHS | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("head nav footer aside form button select option dialog menu iframe object canvas audio video map".split())
CONTENT = frozenset("article main".split())
#: Text elements, and the structure between them and the element that holds them.
TEXT = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th caption figcaption pre blockquote address summary xmp".split())
STRUCTURE = frozenset("ul ol dl table thead tbody tfoot tr td th li dd blockquote figure details hgroup header picture".split()) | TEXT
#: Words of a class, id or role that mark furniture wherever it stands, and those that do so outside an article.
FURNITURE_WORDS = frozenset(
    "ad ads adbox advert advertisement advertising adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr popup modal overlay "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar skip sidebar widget widgets "
    "masthead footer share sharing social related recommended recommendations trending popular "
    "comment comments commentlist disqus respond reply replies discussion newsletter subscribe subscription signup login search form paywall hidden "
    "complementary contentinfo taglist".split()
)
OUTER_WORDS = frozenset("notice notices alert side aside rail header foot copyright legal disclaimer follow more tags".split())
#: Beginnings of such words, for names without separators (sidebarLeft, commentBox); words that say the opposite.
FURNITURE_STEMS = ("sidebar", "comment", "advert", "sponsor", "breadcrumb", "newsletter", "cookie", "navbar", "navigation", "footer", "disqus", "popup", "masthead", "sharing", "pagination")
NEGATIONS = frozenset("has with no without not".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: What an article or main element, and a class word of furniture, multiply a path's score by, whatever their number; the share of the best path's score that content has.
ARTICLE, MARKED, SHARE = 3.0, 1 / 3, 0.3
#: Powers of the shares of the page's text and blocks that a path's holder has, in the path's ratio.
TEXT_POWER, BLOCK_POWER = 0.5, 3
#: Elements that end an open element of the same kind.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("table ul ol dl div section article main body blockquote td th li".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|annotation|annotation-xml|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|"
    r"<(/?)([a-zA-Z][^\s/<>]*)((?:\"[^\"<>]*\"|'[^'<>]*'|[^<>\"'])*+(?:>|[^<>]*+>))((?<=<xmp>).*?(?=</xmp\s*>|\Z))?",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_MARKS = re.compile(r"[.,;:!?…。，、；：！？]")
_DIGITS, _SEPARATORS = re.compile(r"[0-9]+"), re.compile(r"[-_:]+")


class Block:
    """A text with its path, the elements around it, the element that holds it, and what those say about it."""

    __slots__ = ("path", "ancestors", "holder", "text", "linked", "marks", "prior", "inside")

    def __init__(self, path: str, ancestors: tuple[int, ...], holder: int, text: str, linked: int, prior: float, inside: bool):
        self.path, self.ancestors, self.holder, self.text, self.linked = path, ancestors, holder, text, min(linked, len(text))
        self.prior, self.inside = prior, inside
        self.marks = len(_MARKS.findall(text))


class Element:
    """An open element: `unread` if its text is never part of an article, `marked` if its classes or those around it say furniture, `inside` an article."""

    __slots__ = ("name", "path", "number", "unread", "marked", "inside")

    def __init__(self, name: str, path: str, number: int, unread: bool, marked: bool, inside: bool):
        self.name, self.path, self.number, self.unread, self.marked, self.inside = name, path, number, unread, marked, inside

    @property
    def prior(self) -> float:
        """What scores are multiplied by, however many such elements there are."""
        return (ARTICLE if self.inside else 1.0) * (MARKED if self.marked else 1.0)


_PAGE = Element("", "", 0, False, False, False)


def _role(name: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether an element is never read, whether its classes mark furniture, and its path component."""
    label, marked = name, False
    if attributes and name not in ("body", "html"):
        for m in _ATTRIBUTE.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "hidden":
                return True, marked, label
            for token in value.split():
                label += f".{_DIGITS.sub('0', token)}"
                words = _SEPARATORS.split(token)
                if name in CONTENT and not COMMENT_WORDS & set(words) or words[0] in NEGATIONS:
                    continue
                known = FURNITURE_WORDS if inside else FURNITURE_WORDS | OUTER_WORDS
                marked = marked or any(w in known or w.startswith(FURNITURE_STEMS) for w in (token, *words))
    return name in FURNITURE or name == "header" and not inside, marked, label


def _holder(stack: list[Element]) -> int:
    """The element that a block is read with: the article around it, or for a text element the one outside lists and tables."""
    for e in reversed(stack):
        if e.name in CONTENT:
            return e.number
    if not stack or stack[-1].name not in TEXT:
        return stack[-1].number if stack else 0
    return next((e.number for e in reversed(stack) if e.name not in STRUCTURE), 0)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    stack: list[Element] = []
    parts: list[str] = []
    linked = link_depth = 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                top = stack[-1] if stack else _PAGE
                out.append(Block(top.path, tuple(e.number for e in stack), _holder(stack), text, linked, top.prior, top.inside))
            parts.clear()
        linked = 0

    def pop_to(index: int) -> None:
        end_block()
        del stack[index:]

    last, number = 0, 0
    for m in _TOKEN.finditer(page):
        if m.start() > last and not (stack and stack[-1].unread):
            piece = page[last : m.start()]
            parts.append(piece)
            if link_depth:
                linked += len(piece.strip())
        last = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if name in INLINE or name == "br":
            if name == "a":
                link_depth = 0 if m[2] else 1
            elif name == "br":
                parts.append(" ")
            continue
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    pop_to(i)
                    break
            else:
                end_block()
            link_depth = 0
            continue
        end_block()
        link_depth = link_depth if name in ("div", "h1", "h2", "h3", "h4", "h5", "h6", "p") else 0
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in _CLOSES.get(name, ()):
                pop_to(i)
                break
            if stack[i].name in _SCOPE:
                break
        if name != "p" and stack and stack[-1].name == "p":
            pop_to(len(stack) - 1)
        if name in VOID:
            continue
        under = stack[-1] if stack else _PAGE
        unread, marked, label = _role(name, m[4][:-1], under.inside)
        number += 1
        stack.append(Element(name, f"{under.path}/{label}", number, under.unread or unread, under.marked or marked, under.inside or name in CONTENT))
        if m[5] and not stack[-1].unread:  # what an xmp element shows is no markup
            parts.append(html.escape(m[5]))
    if last < len(page) and not (stack and stack[-1].unread):
        tail = page[last:]
        cut = tail.rfind("<")
        parts.append(tail[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z]", tail[cut:]) else tail)
    end_block()
    return out


def path_ratios(found: list[Block], radius: int = 1) -> dict[str, float]:
    """Per path: characters outside links and punctuation per block, in logarithms, smoothed over the blocks in page order, and fused with what
    the element that holds the path has of the page's text and blocks, as an article is more than one text seen once."""
    length: dict[str, int] = {}
    marks: dict[str, int] = {}
    seen: dict[str, int] = {}
    held: dict[int, list[int]] = {}
    for b in found:
        free = len(b.text) - b.linked
        length[b.path] = length.get(b.path, 0) + free
        marks[b.path] = marks.get(b.path, 0) + b.marks
        seen[b.path] = seen.get(b.path, 0) + 1
        x = held.setdefault(b.holder, [0, 0])
        x[0] += free
        x[1] += free > 0
    kernel = [math.exp(-(k * k) / 0.5) for k in range(-radius, radius + 1)]

    def smooth(values: list[float]) -> list[float]:
        out = []
        for i in range(len(values)):
            near = [(kernel[k + radius], values[i + k]) for k in range(-radius, radius + 1) if 0 <= i + k < len(values)]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    text_ratio = smooth([math.log1p(length[b.path] / seen[b.path]) for b in found])
    mark_ratio = smooth([math.log1p(marks[b.path] / seen[b.path]) for b in found])
    chars, count = (max(1, sum(x[i] for x in held.values())) for i in (0, 1))
    fused: dict[str, list[float]] = {}
    for b, t, p in zip(found, text_ratio, mark_ratio, strict=True):
        of_chars, of_count = held[b.holder][0] / chars, held[b.holder][1] / count
        fused.setdefault(b.path, []).append(t * (1 + p) * of_chars**TEXT_POWER * of_count**BLOCK_POWER)
    return {path: sum(v) / len(v) for path, v in fused.items()}


def path_scores(found: list[Block]) -> dict[str, float]:
    """Each path's ratio, weighted by what its elements say about themselves."""
    prior = {b.path: b.prior for b in found}
    return {path: ratio * prior[path] for path, ratio in path_ratios(found).items()}


def main_text(page: str) -> str:
    """The article's blocks in page order, joined by line breaks; empty if there are none."""
    found = blocks(page)
    if not found:
        return ""
    scores = path_scores(found)
    threshold = SHARE * max(scores.values())
    # each element's mean score over all text in it, and the greatest prior there
    mass: dict[int, list[float]] = {}
    for b in found:
        for number in (0, *b.ancestors):
            x = mass.setdefault(number, [0.0, 0.0, 0.0])
            x[0] += scores[b.path] * len(b.text)
            x[1] += len(b.text)
            x[2] = max(x[2], b.prior)

    def is_content(b: Block) -> bool:
        if scores[b.path] >= threshold:
            return True
        of_holder, size, prior = mass[b.holder]
        # what its own classes mark, and plain links outside an article, are not carried by what holds them
        return of_holder >= threshold * size and b.prior >= prior and (b.inside or b.linked * 2 <= len(b.text))

    return "\n".join(b.text for b in found if is_content(b))


_TEXT = pa.schema([("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            texts = [main_text(p or "") for p in part.column("html").to_pylist()]
            schema = pa.schema([part.schema.field("page_id"), part.schema.field("url"), *_TEXT])
            columns = {"page_id": part.column("page_id"), "url": part.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}
            yield from record_batches(schema, columns)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    A null page is empty and has an empty text, as has one without text outside furniture. Ids and URLs are kept as they
    are, nulls and repeats too; equal scores are equal decisions. Pages are worked on one at a time: memory follows the longest page.
    An empty table gives no rows; names of other columns don't matter.
    """
    rows = pages.select(F.col(quoted(id_col)).cast("long").alias("page_id"), F.col(quoted(url_col)).cast("string").alias("url"), F.col(quoted(html_col)).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op5(pages: DataFrame) -> DataFrame:
    return extract_text(pages)


#: The article of the driver's pages, which mark it: what its own element holds, without looking at scores.
OP5_SQL = r"""
WITH a AS (
  SELECT page_id, url, replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|\z)', 1), '</?b>', '', 'g'), '<br>', ' ') AS part FROM pages
), b AS (
  SELECT page_id, url, unnest(regexp_split_to_array(part, '</?(?:p|h1)>')) AS block, unnest(range(len(regexp_split_to_array(part, '</?(?:p|h1)>')))) AS i FROM a
), u AS (
  SELECT page_id, i, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(block, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&amp;?', '&', 'g'), '[\s\x{A0}]+', ' ', 'g')) AS block FROM b
), t AS (
  SELECT page_id, string_agg(block, chr(10) ORDER BY i) AS text FROM u WHERE block <> '' GROUP BY page_id
)
SELECT pages.page_id, pages.url, coalesce(t.text, '') AS text, CAST(length(coalesce(t.text, '')) AS BIGINT) AS n_chars FROM pages LEFT JOIN t ON t.page_id = pages.page_id
"""
