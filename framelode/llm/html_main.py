"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative, and one linear scan finds the contiguous
region of the highest sum: long runs of words with few tags between them. The weights come from labelled pages, which
are those whose author marked the content with ``<article>`` or ``<main>``: a token's weight is the log of its share
inside the mark over its share outside. On a page that marks most of its words itself the mark is one more feature: words
outside it score negative. Containers that are not content by their element, role or name (menus, adverts, forms, comments
of readers and the like) count as a little markup wherever they stand: an advert between two paragraphs does not part
them, and its text is never in the result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tag names whose weights are kept, most frequent first; share of a page's words from which its marks are believed.
TAGS = 500
MARKED = 0.25
_LEAST, _MOST = -1.5, -0.05
# an attribute's quotes mean something right after its "=" only; nothing here gives back what it took
_ATTRIBUTES = r"""(?>[^<>=]|=\s*+(?>"[^"]*+"|'[^']*+'|[^\s<>"'][^\s<>]*+)?+)*+"""
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_ATTRIBUTES})>|<[!?/][^<>]*+>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements that end a block, elements without an end, elements whose inside is no text, containers that
#: are not content, roles of such, words of class and id names that say so, and words that may stand beside them.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea select title object canvas audio video".split())
OUTSIDE = frozenset("head nav footer aside form button menu dialog".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice notices popup modal newsletter subscribe share sharing social related recommended comment comments disqus replies search".split())
BESIDE = frozenset("a area articles bar block bottom box buttons container content form header icons inner item items left links list main media message module outer page panel posts primary reader readers right secondary section site slot top unit user widget wrap wrapper".split())
_FOREIGN = frozenset(("svg", "math"))
_MARKS = frozenset(("article", "main"))
_INLINE_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}


def _names_aside(value: str) -> bool:
    """Whether a class or id has a name that is made of words for what is not content, and neutral ones beside them."""
    for name in value.split():
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]
        if any(w in NAMES for w in words) and all(w in NAMES or w in BESIDE for w in words):
            return True
    return False


def _aside(name: str, attributes: str, in_mark: bool) -> bool:
    if name in OUTSIDE or (name == "header" and not in_mark):
        return True
    if not attributes or name in ("html", "body", "main", "article"):
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "role" and value.lower() in ROLES):
            return True
        if key in ("class", "id") and _names_aside(value):
            return True
    return False


def tokens(page: str) -> list[tuple[str, str, bool, bool]]:
    """(tag name or '', text, inside a mark, inside a container that is not content), in page order.

    A container that is never closed ends where the element around it does, or where the content is marked. One around
    the only marks of a page is a container of content.
    """
    kinds: list[tuple[str, str]] = []
    opens: list[tuple[str, int, bool, bool]] = []
    spans: list[list[int]] = []
    marks: list[list[int]] = []
    depth, at = 0, 0

    def close(k: int) -> None:
        nonlocal depth
        name, start, aside, _ = opens.pop()
        if aside:
            spans.append([start, k])
        if name in _MARKS:
            marks.append([start, k])
            depth -= 1

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            kinds.append(("", page[at : m.start()]))
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        closing, attributes = m.group(1) == "/", m.group(3)
        alone = attributes.endswith("/") and name in _FOREIGN
        kinds.append((name, ""))
        if closing:
            if any(o[0] == name for o in opens):
                while opens[-1][0] != name:
                    close(len(kinds) - 1)
                close(len(kinds))
        elif name in RAW:
            if not alone:
                end = _INLINE_END[name].search(page, at)
                at = end.end() if end else len(page)
        elif name not in VOID:
            if name == "body" or (name in _MARKS and any(o[0] == "head" for o in opens)):
                while any(o[0] == "head" for o in opens):
                    close(len(kinds) - 1)
            opens.append((name, len(kinds) - 1, _aside(name, attributes, depth > 0), False))
            depth += name in _MARKS
    if at < len(page):
        kinds.append(("", page[at:]))
    unclosed = {o[1] for o in opens}
    while opens:
        close(len(kinds))
    away = [False] * len(kinds)
    starts = sorted(a for a, _ in marks)
    for span in spans:
        if span[0] in unclosed and span[1] == len(kinds):
            span[1] = next((a for a in starts if a > span[0]), span[1])
    free = [a for a in starts if not any(x <= a < y for x, y in spans)]
    for x, y in spans:
        if free or not any(x < a < y for a in starts):
            away[x:y] = [True] * (y - x)
    inside = [False] * len(kinds)
    for x, y in marks:
        if not away[x]:
            inside[x:y] = [True] * (y - x)
    return [(name, text, i, a) for (name, text), i, a in zip(kinds, inside, away, strict=True)]


def counts(page: str) -> tuple[Counter, Counter]:
    """Words (under '') and tags inside and outside the marks of a page; nothing of a page that does not mark content."""
    inside, outside = Counter(), Counter()
    found = tokens(page)
    if any(t[2] for t in found):
        for name, text, marked, away in found:
            (inside if marked and not away else outside)[name] += 1 if name else len(text.split())
    return inside, outside


def weights_of(inside: dict[str, int], outside: dict[str, int]) -> dict[str, float]:
    """Weights from counts: '' for a word, positive; tag names, negative; '*' and '#' for tags never seen, inline and
    block."""
    n, m = sum(inside.values()) + 1, sum(outside.values()) + 1
    odds = {k: math.log((inside.get(k, 0) + 0.5) / n) - math.log((outside.get(k, 0) + 0.5) / m) for k in {*inside, *outside}}
    weights = {k: min(_MOST, max(_LEAST, v)) for k, v in odds.items() if k}
    return weights | {"": min(2.0, max(0.5, odds.get("", 0.5))), "*": -0.5, "#": -1.0}


def fit(pages: DataFrame, html_col: str = "html", tags: int = TAGS) -> dict[str, float]:
    """Weights from all pages that mark their content, by a distributed sum; the ``tags`` most frequent names are kept.
    Without such pages all are the defaults."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for b in batches:
            for p in b.column(0).to_pylist():
                x, y = counts(p or "")
                inside.update(x)
                outside.update(y)
            if len(inside) + len(outside) > 10 * TAGS:
                yield rows(inside, outside)
                inside, outside = Counter(), Counter()
        yield rows(inside, outside)

    def rows(inside: Counter, outside: Counter) -> pa.RecordBatch:
        names = sorted({*inside, *outside})
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[k] for k in names], pa.int64()), pa.array([outside[k] for k in names], pa.int64())], names=["name", "inside", "outside"])

    text = F.col(html_col).cast("string")
    marked = pages.where(text.rlike("(?i)<(article|main)[\\s>]")).select(text.alias("html"))
    sums = marked.mapInArrow(run, "name string, inside long, outside long").groupBy("name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    got = sums.orderBy(F.desc(F.col("inside") + F.col("outside")), "name").limit(tags).collect()
    return weights_of({r["name"]: r["inside"] for r in got}, {r["name"]: r["outside"] for r in got})


def region(found: list[tuple[str, str, bool, bool]], weights: dict[str, float]) -> tuple[int, int]:
    """[start, stop) of the tokens with the highest sum; the first and shortest of equals; empty if none is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    word = weights[""]
    sizes = [0 if t[0] or t[3] else len(t[1].split()) for t in found]
    marked = sum(n for n, t in zip(sizes, found, strict=True) if t[2])
    believed = marked > 0 and marked >= MARKED * sum(sizes)
    for i, (name, _, inside, away) in enumerate(found):
        if away or (believed and inside and name):
            score = _MOST
        elif name:
            score = weights.get(name, weights["#" if name in BLOCKS else "*"])
        else:
            score = sizes[i] * (word if inside or not believed else -word)
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, at = total, (start, i + 1)
    return at


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best region, one to a line; '' for a null or empty page or one without words."""
    if not page:
        return ""
    found = tokens(page)
    start, stop = region(found, weights)
    blocks, block = [], []
    for name, text, _, away in found[start:stop]:
        if name:
            if name in BLOCKS:
                blocks.append("".join(block))
                block = []
            elif name == "br":
                block.append(" ")
        elif not away:
            block.append(entities.unescape(text))
    blocks.append("".join(block))
    return "\n".join(t for b in blocks if (t := " ".join(b.split())))


def extract(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text string, n_chars long), a row for each row of ``pages``.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by a line
    feed. A null page counts as empty and gives ''. Repeated rows are kept, other columns ignored; an empty table
    gives no rows (and default weights). ``weights`` are fitted on ``pages`` unless given.
    """
    w = weights or fit(pages, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, w) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    t = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {c: t.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return t.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
