"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of tokens: words score positive, tags negative, with weights learnt from labelled pages (log odds of
a token lying inside the article, by tag name and by whether a word stands in a link, outside the marked article or in
plain flow). A linear scan finds the contiguous region with the best sum; words of boilerplate elements inside it
(menus, forms, scripts, notices, adverts, reader comments and the like) are left out. Which elements these are follows
from their names and from evidence of the words in class, id and role: log odds learnt from the labelled pages, with a
prior for words that usually mark boilerplate. An element that holds the articles, or most words, is never boilerplate.

Null or empty html gives an empty text. Character references are decoded, white space within a block becomes one
space, blocks are joined by one newline. Every page is read whole and comes back once, repeated rows as often; end tags
may be missing. Other columns than the three that are read do not matter; an empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, small_batches

#: Labelled pages that training collects at most; a page is labelled if it marks its article itself.
TRAINING_PAGES = 400
SCHEMA = "page_id long, url string, text string, n_chars long"

#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video select option textarea title head".split())
#: Elements that are not part of an article.
BOILERPLATE = frozenset("nav header footer aside form button dialog menu fieldset".split())
#: Words of class, id and role that mark boilerplate, in whatever value they stand.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sidebar nav navbar navigation breadcrumb breadcrumbs cookie cookies newsletter subscribe "
    "disqus comment comments pagination pager".split()
)
#: Words that mark it where they are a whole value, or all words of one do.
MARKS = STRONG | frozenset(
    "promo promotion banner side rail menu header footer consent notice notices alert popup modal overlay signup login search share sharing social related "
    "recommended discussion replies reply responses respond widget toolbar tags".split()
)
#: Those of reader comments.
COMMENTS = frozenset("comment comments reply replies discussion responses respond disqus".split())
#: Elements that hold parts of a page.
CONTAINERS = frozenset("div section main article td center".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open paragraph-like element ends where one of these begins.
CLOSES = {"p": BLOCKS - {"br", "button"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

#: Elements of a page's head; any other one, and words, end it.
HEAD = frozenset("html head title meta link script style noscript template base".split())
#: Elements that are boilerplate whatever they hold.
NO_FRAME = frozenset("nav aside footer menu button dialog".split())
#: What a known mark adds to the learnt evidence (log odds of -3 to 3), what one word of a value with other words does, what
#: a part of links (in words) does, and the evidence below which an element is left out.
PRIOR, PARTLY, LINKED, AGAINST = -4.0, -1.0, -2.0, -2.0
#: The part of an element's words that must be links to count against it.
LINKS = 0.5
#: Words in elements with a class value that learning needs.
LEAST_WORDS = 20
#: The part of all words that stands for an article that is not marked, blocks that it has at least, and the part of its
#: words up to which a container beside it is left out.
MAIN, MAIN_BLOCKS, BESIDE = 0.6, 3, 0.25

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_ARTICLE = re.compile(r"<(?:article|main)[\s>]", re.I)
_WORD = re.compile(r"[^\s]+")
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass
class Element:
    """An element with the values of its class, id and role, their words, and the tokens from its begin to its end."""

    name: str
    parent: int
    marks: frozenset[str] = frozenset()
    values: frozenset[str] = frozenset()
    hidden: bool = False
    begin: int = 0
    end: int = 0


@dataclass
class Token:
    """A tag (by name) or a run of text within an element; ``kind`` is what weights are learnt for."""

    name: str
    element: int
    words: int = 0
    text: str = ""
    block: int = 0
    kind: str = ""
    flow: bool = False
    inside: bool = False


@dataclass
class Weights:
    """Score of a word or a tag by its kind, where unseen tags cost ``tag``; and evidence of class values for an article."""

    of: dict[str, float] = field(default_factory=lambda: {"word:outside": -2.0, "word:link": -1.0})
    word: float = 1.0
    tag: float = -0.2
    evidence: dict[str, float] = field(default_factory=dict)

    def score(self, token: Token) -> float:
        if token.kind == "boilerplate":  # neither scores nor is taken, so that it does not cut an article in two
            return 0.0
        if token.text:
            return token.words * self.of.get(token.kind, self.word)
        return self.of.get(token.kind, self.tag)

    def speaks(self, value: str) -> float:
        """Evidence of one class value: what was learnt, and a prior for known marks."""
        words = [w for w in _SPLIT.split(value) if w]
        if STRONG.intersection(words) or words and MARKS.issuperset(words):
            return self.evidence.get(value, 0.0) + PRIOR
        return self.evidence.get(value, PARTLY if MARKS.intersection(words) else 0.0)

    def against(self, values: frozenset[str], linked: bool) -> bool:
        """Whether the values of an element's class speak against it, and how much of it is links."""
        return min(map(self.speaks, values), default=0.0) + (LINKED if linked else 0.0) < AGAINST


def parse(page: str) -> tuple[list[Token], list[Element]]:
    """Tokens and elements in page order; end tags that may be left out are implied, element 0 is the page."""
    out: list[Token] = []
    elements = [Element("", -1)]
    open_ = [0]
    block, at, n = 0, 0, len(page)

    def shut(place: int) -> None:
        while len(open_) > place:
            elements[open_.pop()].end = len(out)

    def leave_head() -> None:
        if "head" in (names := [elements[e].name for e in open_]):
            shut(names.index("head"))

    def put(text: str) -> None:
        if text:
            decoded = entities.unescape(text)
            count = len(_WORD.findall(decoded))
            if count and elements[open_[-1]].name == "head":
                leave_head()
            out.append(Token("", open_[-1], count, decoded, block))

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            place = next((i for i in range(len(open_) - 1, 0, -1) if elements[open_[i]].name == name), 0)
            # an inline end tag does not reach through an open block
            if place and not (name not in BLOCKS and any(elements[e].name in BLOCKS for e in open_[place + 1 :])):
                shut(place)
        else:
            if name not in HEAD:
                leave_head()
            while name in CLOSES.get(elements[open_[-1]].name, ()):
                shut(len(open_) - 1)
            if name in BLOCKS:
                # a new block also ends a paragraph that has open inline elements
                for i in range(len(open_) - 1, 0, -1):
                    above = elements[open_[i]].name
                    if above == "p" and name in CLOSES["p"]:
                        shut(i)
                        break
                    if above in BLOCKS:
                        break
        if name in BLOCKS:
            block += 1
        out.append(Token(f"/{name}" if m[1] else name, open_[-1], block=block))
        if m[1] or name in VOID or m[3].endswith("/") and any(elements[e].name in ("svg", "math") for e in open_):
            continue
        found = [(k.lower(), "".join(v).lower()) for k, *v in _ATTR.findall(m[3])]
        marks = frozenset(w for k, v in found if k != "hidden" for w in _SPLIT.split(v) if w)
        values = frozenset(w for k, v in found if k != "hidden" for w in v.split())
        elements.append(Element(name, open_[-1], marks, values, any(k == "hidden" for k, _ in found), len(out) - 1, n))
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else n
        open_.append(len(elements) - 1)
    shut(0)
    return out, elements


def _is_article(e: Element) -> bool:
    return e.name == "main" or e.name == "article" and not e.marks & COMMENTS


def tokens(page: str, weights: Weights | None = None) -> tuple[list[Token], list[Element], list[bool], list[int]]:
    """Judged tokens, elements, whether each element holds all articles of its page, and running counts of plain words.

    An element is boilerplate by its name or because the evidence speaks against it, unless it is a frame: it holds all
    articles of the page or, where no article is marked, more than half of the words outside of links.
    """
    weights = weights or Weights()
    out, elements = parse(page)
    n = len(elements)
    hidden, link, holds = [False] * n, [False] * n, [0] * n
    articles = headline = 0
    for i, e in enumerate(elements[1:], 1):
        hidden[i] = hidden[e.parent] or e.hidden or e.name in HIDDEN
        link[i] = link[e.parent] or e.name == "a"
        if not hidden[i] and _is_article(e):
            articles += 1
            up = i
            while up >= 0:
                holds[up] += 1
                up = elements[up].parent
        headline = headline or (e.begin if e.name == "h1" else 0)
    plain, every = [0], [0]
    for t in out:
        every.append(every[-1] + (0 if hidden[t.element] else t.words))
        plain.append(plain[-1] + (t.words if not (hidden[t.element] or link[t.element]) else 0))
    span = lambda sums, e: sums[min(e.end, len(out))] - sums[e.begin]
    bad, inside = [False] * n, [False] * n
    for i, e in enumerate(elements[1:], 1):
        if hidden[i]:
            boiler = True
        elif e.name in ("html", "body", "main"):
            boiler = False
        elif e.name == "article":
            boiler = bool(e.marks & COMMENTS)
        else:
            boiler = e.name in BOILERPLATE and not (e.name == "header" and inside[e.parent]) or weights.against(e.values, e.name in CONTAINERS and span(every, e) - span(plain, e) > LINKS * span(every, e))
            if boiler and e.name not in NO_FRAME:
                large = 2 * span(plain, e) > plain[-1] and (not e.marks & COMMENTS or e.begin <= headline < e.end)
                boiler = not (holds[i] == articles if articles else large)
        bad[i] = bad[e.parent] or boiler
        inside[i] = inside[e.parent] or not bad[i] and _is_article(e)
    marked = any(inside)
    if not marked:
        _leave_out_beside(out, elements, bad, link, headline)
    for i, e in enumerate(elements):
        if bad[i]:  # its own tags, too
            out[e.begin].kind = "boilerplate"
            if e.end < len(out) and out[e.end].name == f"/{e.name}":
                out[e.end].kind = "boilerplate"
    for t in out:
        k = t.element
        t.inside = inside[k]
        if bad[k] or t.kind:
            t.kind = "boilerplate"
        elif t.name:
            t.kind = "tag:inside" if t.inside else t.name
        else:
            t.kind = "word" if t.inside else "word:outside" if marked else "word:link" if link[k] else "word"
            t.flow = t.kind != "word:outside"
    return out, elements, [articles > 0 and h == articles for h in holds], plain


def _leave_out_beside(out: list[Token], elements: list[Element], bad: list[bool], link: list[bool], headline: int) -> None:
    """Where no article is marked: follows the container with most words inwards and leaves out small ones beside it."""
    plain, every, blocks, seen = [0], [0], [0], -1
    for t in out:
        good = t.words if not bad[t.element] else 0
        every.append(every[-1] + good)
        plain.append(plain[-1] + (0 if link[t.element] else good))
        blocks.append(blocks[-1] + (good > 0 and t.block != seen))
        seen = t.block if good else seen
    span = lambda sums, e: sums[min(e.end, len(out))] - sums[e.begin]
    below: dict[int, list[int]] = {}
    for i, e in enumerate(elements[1:], 1):
        below.setdefault(e.parent, []).append(i)
    at, lost = 0, set()
    while True:
        inner = [i for i in below.get(at, ()) if not bad[i] and elements[i].name in CONTAINERS | {"html", "body"}]
        main = next((i for i in inner if span(plain, elements[i]) >= MAIN * plain[-1] and span(blocks, elements[i]) >= MAIN_BLOCKS), None)
        if main is None:
            break
        for i in inner:
            e, m = elements[i], elements[main]
            few = i != main and span(plain, e) < BESIDE * span(plain, m) and not (e.values and e.values == m.values)
            away = e.begin > m.begin or e.end <= headline or span(every, e) - span(plain, e) > LINKS * span(every, e)
            if few and away and not e.begin <= headline < e.end:
                lost.add(i)
        at = main
    for i, e in enumerate(elements[1:], 1):
        bad[i] = bad[i] or i in lost or e.parent in lost
        if bad[i] and e.parent in lost:
            lost.add(i)


def train(pages: list[str]) -> Weights:
    """Log odds of lying inside the marked article: of words by their surroundings, of tags by name, of class values.

    A value counts every element that has it. A known mark inside an article stays boilerplate; only one that holds
    articles speaks for it.
    """
    weights = Weights()
    within, without = Counter(), Counter()
    for page in pages:
        out, elements, frame, plain = tokens(page)
        own = [0]
        for t in out:
            own.append(own[-1] + (t.words if t.inside else 0))
        for e, holds in zip(elements, frame, strict=True):
            end = min(e.end, len(out))
            article, every = own[end] - own[e.begin], plain[end] - plain[e.begin]
            for m in e.values:
                if holds or weights.speaks(m) > PRIOR:
                    within[m] += article
                without[m] += 0 if holds else max(every - article, 0)
    weights.evidence = {m: min(max(math.log((within[m] + 0.5) / (without[m] + 0.5)), -3.0), 3.0) for m in within.keys() | without.keys() if within[m] + without[m] >= LEAST_WORDS}
    inside, outside = Counter(), Counter()
    for page in pages:
        for t in tokens(page, weights)[0]:
            (inside if t.inside else outside)[t.kind] += t.words if t.text else 1
    for kind in inside.keys() | outside.keys():
        odds = math.log((inside[kind] + 0.5) / (outside[kind] + 0.5))
        if kind == "word":
            weights.word = min(max(odds, 0.5), 3.0)
        elif kind == "word:outside":
            weights.of[kind] = min(max(odds, -3.0), -0.5)
        elif kind != "boilerplate":  # tags are negative: those that occur in articles cost little
            weights.of[kind] = min(-0.05, max(odds - 1.0, -3.0))
    # inside articles tags bear one kind; by name they are known there, too
    known = Counter(t.name for page in pages for t in tokens(page, weights)[0] if t.inside and t.name)
    for kind, count in known.items():
        odds = math.log((count + 0.5) / (outside[kind] + 0.5))
        weights.of[kind] = min(-0.05, max(odds - 1.0, -3.0))
    return weights


def region(scores: list[float]) -> tuple[int, int]:
    """The first contiguous region with the largest sum, by one linear scan; empty if no score is positive."""
    best, start, end, total, begin = 0.0, 0, 0, 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += x
        if total > best:
            best, start, end = total, begin, i + 1
    return start, end


def extract(page: str, weights: Weights) -> str:
    """The main text of a page."""
    seen = tokens(page, weights)[0]
    start, end = region([weights.score(t) for t in seen])
    if end > start:
        # a block that is cut at the edge is taken whole, with the links and words that scored low in it
        first = next(t.block for t in seen[start:end] if t.words)
        last = seen[end - 1].block
        while start and seen[start - 1].block == first and seen[start - 1].flow:
            start -= 1
        while end < len(seen) and seen[end].block == last and (seen[end].flow or seen[end].name.lstrip("/") not in BLOCKS):
            end += 1
    blocks: list[list[str]] = []
    current = None
    for t in seen[start:end]:
        if t.flow:
            if t.block != current:
                blocks.append([])
                current = t.block
            blocks[-1].append(t.text)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def _apply(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x, weights) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(x) for x in texts], dtype=np.int64))],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", labelled: DataFrame | None = None, training_pages: int = TRAINING_PAGES) -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` for every row of ``pages``.

    ``labelled`` has pages that mark their article with ``<article>`` or ``<main>``; by default those of ``pages``.
    At most ``training_pages`` of them, those with the smallest hashes, are collected to fit the weights.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    known = (rows if labelled is None else labelled.select(F.col(html).alias("html"))).where(F.col("html").rlike("(?i)<(article|main)[ >]"))
    # equal pages count once; what each task sends is a share of the sample, however many tasks there are
    ids = bounded(known.select(F.xxhash64("html").alias("hash")).distinct(), "hash", training_pages)
    chosen = known.select("html", F.xxhash64("html").alias("hash")).join(F.broadcast(ids), "hash")
    sample = chosen.groupBy("hash").agg(F.any_value("html").alias("html")).collect()
    weights = train(sorted(r["html"] for r in sample))
    return rows.mapInArrow(_apply(weights), SCHEMA).withColumnRenamed("page_id", key).withColumnRenamed("url", url)


def query(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
