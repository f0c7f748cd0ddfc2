"""Main-text extraction by the maximum-scoring subsequence of a page's tokens.

A page is a sequence of words and tags. All scores are learned from labelled pages, that is pages
whose content is marked by exactly one <article> or <main>, as log-odds of standing inside against
outside the content:

* a word scores by its place, the innermost block element and whether it is part of a link, and by its
  marks, which are the classes, ids and roles of the elements around it and a few element names; the worst mark counts;
* a tag scores by its name and never above zero.

One linear scan finds the contiguous region of the largest sum; what is marked in one stretch within an
<article> or <main> counts as one word there, so it doesn't cut the article off. Inside the region, words under a mark that
scores below OUT (an advert or a comment within the article) are not content; an element that holds
an <article>, a <main>, the article's <h1> or more than half of the page's words never counts as marked.
Reader comments without a known name are found by their structure: an element most of whose words stand in
THREAD or more blocks of one kind, each with a byline or a button and none with a heading, counts as marked, unless it
holds more than half of the page's words; so does a button that no text stands beside. Copyright lines that end the region are cut off.
Marks in the lists below start from a belief that they stand outside, worth BELIEF words, which counts
of labelled pages add to or outweigh; a name that was neither listed nor seen says nothing. Only
elements that hold no text of a page (scripts, styles, templates ...) are left out by rule.

Blocks of the region are decoded, white space inside them becomes one space, and they are joined
by a line break in page order.

The scores are counted on about `fit_pages` pages, of marks the MOST_NAMES most frequent ones; all pages are extracted whole.

Cases: null or empty html and pages without a positive region give an empty text; broken or
truncated markup is read as far as it goes; repeated page ids give a row each; of two regions with
equal sums the first wins; without labelled pages the beliefs hold; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

#: About so many labelled pages are read to count the scores; names of elements that are learned.
FIT_PAGES, MOST_NAMES = 2000, 20_000
#: Blocks of one kind that make a thread of comments.
THREAD = 3
#: Words that a listed mark is believed to have been seen outside; the score below which words are left out; the largest score.
BELIEF, OUT, MOST = 30, -1.5, 4.0

# Fixed values of HTML: elements that start a block, elements without text of the page, void elements.
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
INLINE = set("a abbr b big br cite code dfn em i img kbd mark q s samp small span strong sub sup time tt u var wbr".split())
DROPPED = set("script style noscript template svg iframe select textarea input head title canvas audio video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg")
#: Elements, and class, id and role names, that are believed to stand outside the main text.
LISTED = {f"<{x}" for x in "nav aside footer header form menu".split()} | set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side menu navbar nav navigation breadcrumb breadcrumbs header footer masthead toolbar comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login pagination pager widget skip".split()
)
HOLDERS = ("article", "main")
#: Elements that are comments where they repeat with bylines; elements and names that are bylines; headings.
ITEMS = set("article blockquote dd div li section".split())
BYLINES, BYLINE_NAMES = {"time", "cite", "address", "button"}, set("author avatar byline commenter date datetime timestamp user username".split())
HEADINGS = {f"h{i}" for i in range(1, 7)}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>]|\Z)(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_COPYRIGHT = re.compile(r"(?:copyright\b\W*|\(c\)\s*|©\s*)+[^.!?]{0,40}?\b(?:19|20)\d\d\b", re.I)
_NAMES = re.compile(r"(?<![^\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Token(NamedTuple):
    """kind is empty for white space and line breaks; text is empty for tags."""

    kind: str
    text: str
    block: int
    inside: bool
    mark: float


class _Open(NamedTuple):
    name: str
    place: str
    links: int
    holders: int
    dropped: bool
    mark: float
    names: tuple


class NameCounts:
    """(name, inside) -> words under the outermost element of that name, added as it ends: one step a name and element.

    Words under a listed mark are explained by it: outside, they count for listed names only, and
    within the content for none.
    """

    def __init__(self):
        self.out: Counter = Counter()
        self.open: dict[str, tuple[int, tuple]] = {}  # how often, and what was seen before
        self.seen = (0, 0, 0)  # words inside, outside, and outside under a mark

    def words(self, inside: bool, mark: float, n: int) -> None:
        a, b, c = self.seen
        if mark < OUT:
            self.seen = (a, b, c + n * (not inside))
        else:
            self.seen = (a + n * inside, b + n * (not inside), c)

    def opens(self, names: tuple) -> None:
        for x in names:
            n, before = self.open.get(x, (0, self.seen))
            self.open[x] = (n + 1, before)

    def closes(self, names: tuple) -> None:
        for x in names:
            n, before = self.open.pop(x)
            if n > 1:
                self.open[x] = (n - 1, before)
                continue
            a, b, c = (now - then for now, then in zip(self.seen, before, strict=True))
            for inside, words in ((True, a), (False, b + c * (x in LISTED))):
                if words:
                    self.out[x, inside] += words


def marks_of(name: str, attrs: str) -> list[str]:
    """The element's class, id and role names, and `<name` if it is a listed element."""
    out = [f"<{name}"] if f"<{name}" in LISTED else []
    for m in _NAMES.finditer(attrs):
        out += (m[1] or m[2] or m[3] or "").lower().split()
    return out


def belief(name: str) -> float:
    return -math.log(1 + BELIEF) if name in LISTED else 0.0


def ended(name: str, open_: list) -> int | None:
    """The place among open elements of the one that the start of `name` ends: one of its own kind."""
    if name not in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
        return None
    k = next((i for i in range(len(open_) - 1, -1, -1) if open_[i].name == name or open_[i].name in ("ul", "ol", "table", "dl", "article", "main", "section", "div")), None)
    return k if k is not None and open_[k].name == name else None


class _Node:
    """An open element: where it began, and what it holds so far."""

    __slots__ = ("name", "at", "before", "byline", "heading", "items")

    def __init__(self, name: str, at: int, before: int, byline: bool):
        self.name, self.at, self.before, self.byline, self.heading = name, at, before, byline, name in HEADINGS
        self.items: dict[str, list[int]] | None = None  # by element, how many blocks with a byline and how many words in them


def structure(matches: list[re.Match]) -> tuple[set[int], set[int]]:
    """Places in `matches` of elements that never count as marked, and of those that are threads of comments.

    The former hold an article or main, the first h1 (of these, if there are any), or most of the page's words.
    """
    stack: list[_Node] = []
    words, kept, spans, threads, open_names = 0, set(), [], [], Counter()
    content = any((m["tag"] or "").lower() in HOLDERS for m in matches)
    titled = False

    def close(k: int) -> None:
        while len(stack) > k:
            x = stack.pop()
            n = words - x.before
            spans.append((x.at, n))
            open_names[x.name] -= 1
            if x.items and any(i >= THREAD and 3 * w >= 2 * n for i, w in x.items.values()):
                threads.append((x.at, n))
            if not stack:
                continue
            up = stack[-1]
            if x.byline and not x.heading and x.name in ITEMS and n:
                up.items = up.items or {}
                item = up.items.setdefault(x.name, [0, 0])
                item[0] += 1
                item[1] += n
            up.byline |= x.byline
            up.heading |= x.heading

    for at, m in enumerate(matches):
        if m["text"] is not None:
            words += n_words(m["text"])
            continue
        name = (m["tag"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if open_names[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name))
            continue
        k = ended(name, stack)
        if k is not None:
            close(k)
        title = name == "h1" and not titled and (not content or any(open_names[x] for x in HOLDERS))
        if name in HOLDERS or title:
            titled |= title
            for x in reversed(stack):
                if x.at in kept:  # so are those around it
                    break
                kept.add(x.at)
        if name not in VOID and not m["attrs"].rstrip().endswith("/"):
            byline = name in BYLINES or not BYLINE_NAMES.isdisjoint(y for x in marks_of(name, m["attrs"]) for y in re.split(r"[-_]+", x))
            stack.append(_Node(name, at, words, byline))
            open_names[name] += 1
    close(0)
    return kept | {at for at, n in spans if 2 * n > words}, {at for at, n in threads if 2 * n <= words}


def beside(matches: list[re.Match], at: int) -> bool:
    """Whether words stand just before an element, or just after it if it holds a text only."""
    return any(0 <= i < len(matches) and (matches[i]["text"] or "").strip() for i in (at - 1, at + 3))


def tokens(page: str, marks: dict[str, float] | None = None, counts: NameCounts | None = None) -> Iterator[Token]:
    """The page's tokens in order; marks: scores of names, where they differ from the beliefs; counts: what is to be told of the words."""
    marks = marks or {}
    stack: list[_Open] = [_Open("", "none", 0, 0, False, 0.0, ())]
    open_names: Counter = Counter()
    block = 0

    def close(k: int) -> None:
        for x in stack[k:]:
            open_names[x.name] -= 1
            if counts:
                counts.closes(x.names)
        del stack[k:]

    matches = list(_TOKEN.finditer(page))
    kept, threads = structure(matches)
    for at, m in enumerate(matches):
        top = stack[-1]
        if (text := m["text"]) is not None:
            if not top.dropped:
                kind = "" if text.isspace() else f"w:{top.place}{':a' * bool(top.links)}"
                if counts and kind:
                    counts.words(top.holders > 0, top.mark, n_words(text))
                yield Token(kind, text if kind else "", block, top.holders > 0, top.mark)
            continue
        name = (m["raw"] or m["tag"] or "").lower()
        if not name:
            continue
        block += name in BLOCKS
        known = name if name in BLOCKS or name in DROPPED or name in INLINE else "other"
        if m["raw"]:
            if not top.dropped:
                yield Token(f"t:{name}", "", block, top.holders > 0, top.mark)
            continue
        if m["end"]:
            if open_names[name]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            if not stack[-1].dropped:
                yield Token(f"t:/{known}", "", block, stack[-1].holders > 0, stack[-1].mark)
            continue
        k = ended(name, stack)
        if k is not None:
            close(k)
        top = stack[-1]
        if not top.dropped:
            if name == "br":
                yield Token("", " ", block, top.holders > 0, top.mark)
            yield Token(f"t:{known}", "", block, top.holders > 0, top.mark)
        if name not in VOID and not m["attrs"].rstrip().endswith("/"):
            names = marks_of(name, m["attrs"])
            own = min((marks.get(x, belief(x)) for x in names), default=0.0)
            if at in kept:
                own = 0.0
            if at in threads or (name == "button" and not beside(matches, at)):
                own = min(own, belief("comments"))
            place = name if name in BLOCKS else top.place
            stack.append(_Open(name, place, top.links + (name == "a"), top.holders + (name in HOLDERS), top.dropped or name in DROPPED, min(top.mark, own), tuple(dict.fromkeys(names)) if counts else ()))
            open_names[name] += 1
            if counts:
                counts.opens(stack[-1].names)
    close(1)


def n_words(text: str) -> int:
    return len(text.split())


def labelled(page: str) -> bool:
    return len(re.findall(r"<(?:article|main)(?=[\s/>])", page, re.I)) == 1


def odds(inside: int, outside: int) -> float:
    return max(-MOST, min(MOST, math.log((inside + 1) / (outside + 1))))


def mark_score(name: str, inside: int, outside: int) -> float:
    return min(0.0, odds(inside, outside + (BELIEF if name in LISTED else 0)))


def count_marks(page: str) -> Counter:
    """(name, inside) -> words of a labelled page, as NameCounts has them."""
    counts = NameCounts()
    for _ in tokens(page, counts=counts):
        pass
    return counts.out


def count_places(page: str, marks: dict[str, float]) -> Counter:
    """(kind, inside) -> tokens of a labelled page that no mark leaves out."""
    out: Counter = Counter()
    for t in tokens(page, marks):
        if t.kind and t.mark >= OUT:
            out[t.kind, t.inside] += n_words(t.text) if t.text else 1
    return out


def _counted(sample: DataFrame, count) -> DataFrame:
    """(name, i, o): sums of what `count` finds inside and outside on labelled pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for (pages_,) in rows_of(batches, "html"):
            for p in pages_:
                if p and labelled(p):
                    total.update(count(p))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], ["name", "inside", "n"])

    rows = sample.select("html").mapInArrow(run, "name string, inside boolean, n long")
    return rows.groupBy("name").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("o"))


def learn(pages: DataFrame, fit_pages: int = FIT_PAGES) -> tuple[dict[str, float], dict[str, float]]:
    """Scores of marks, and of places and tags."""
    every = max(1, pages.count() // fit_pages)
    sample = pages.where(F.pmod(F.crc32(F.col("page_id").cast("string").cast("binary")), F.lit(every)) == 0)
    names = _counted(sample, count_marks).orderBy(F.desc(F.col("i") + F.col("o")), "name").limit(MOST_NAMES).collect()
    marks = {r["name"]: mark_score(r["name"], r["i"], r["o"]) for r in names}
    kinds = _counted(sample, lambda p: count_places(p, marks)).collect()  # kinds come from fixed lists
    return marks, {r["name"]: odds(r["i"], r["o"]) if r["name"][0] == "w" else min(odds(r["i"], r["o"]), 0.0) - 0.1 for r in kinds}


def default(kind: str) -> float:
    """The score of a place or tag that no labelled page has."""
    if kind[0] == "w":
        return 0.2 if kind.endswith(":a") else 1.0
    return -0.2 if kind.lstrip("t:/") in INLINE else -0.5


def token_score(t: Token, scores: dict[str, float]) -> float:
    return min(scores.get(t.kind, default(t.kind)), t.mark if t.mark < 0 else math.inf) * (n_words(t.text) if t.text else 1)


def extract(page: str, scores: dict[str, float], marks: dict[str, float] | None = None) -> str:
    """The region with the largest sum, as text, without what its marks leave out."""
    all_tokens = list(tokens(page, marks))
    best, total, start, region, within = 0.0, 0.0, 0, (0, 0), False
    for i, t in enumerate(all_tokens):
        if not t.kind:
            continue
        before, within = within, t.inside and t.mark < OUT
        total += 0.0 if before and within else t.mark if within else token_score(t, scores)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, region = total, (start, i + 1)
    blocks: list[list[str]] = []
    last = None
    for t in all_tokens[region[0] : region[1]]:
        text = t.text if t.kind or t.text else " "
        if t.mark < OUT or (t.kind and not t.text):
            continue
        if t.block != last:
            blocks.append([])
            last = t.block
        blocks[-1].append(text)
    joined = [x for b in blocks if (x := " ".join(html.unescape("".join(b)).split()))]
    while joined and _COPYRIGHT.match(joined[-1]):
        joined.pop()
    return "\n".join(joined)


def extract_pages(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every page; one pass over the pages, without a shuffle."""
    marks, scores = learn(pages, fit_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, pages_ in rows_of(batches, "page_id", "url", "html"):
            texts = [extract(p or "", scores, marks) for p in pages_]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
