"""Main text of HTML pages by maximum-scoring subsequence.

Method: a page is a sequence of words and tags. Words score positive and tags negative,
with weights learned from labelled pages, and one linear scan finds the contiguous region
with the greatest sum. Labelled pages are those that mark their content themselves with
exactly one ``article`` element; the sample is bounded by ``LABELLED`` (a documented bound
of the fit; extraction covers every page).

Features of an element are its name with each of its class and id words and its role (as
``div.ad``, ``div#menu``, ``div@search``, and ``.ad`` for any name), and its name alone where it
has none of these or is a side element by its meaning (``nav``). What lies outside the article counts for the outermost element that
holds it but not the article, so ``li`` is not blamed for ``nav``; what lies inside counts
for every element around it, the article too. The weight of a feature is the log of its words inside to
those outside. One more feature, ``BESIDE``, is that of words outside the only ``article`` of a page.

A word scores the least negative weight of its features, the element nearest the bottom of the scale deciding; where none is negative,
the general gain of words and the greatest weight around it. A tag costs what its name tells: the log of its share of all tokens outside to
that inside, so links and lists are dear where articles hold few of them; in the scan for the region, side elements cost and give nothing. Within the best region the scan is repeated for
the words alone, for the stretch of least sum, and what it finds (an advert in the middle of an article) is cut out, until nothing is below zero.

What an element means is set aside where it encloses the main text by its structure: it holds the
``article`` or ``main`` of the page, or, where there is none, the ``h1`` and a paragraph behind it, or every word
of the page (for a ``form`` that nothing else speaks against: every word that is in no other side element). How much of a page an element holds otherwise makes no difference: comments may be longer than the article.

Labelled pages cannot show every kind of side element, so the counts start from those of
``PRIOR`` and ``PRIOR_TAGS``: a few words outside for elements and names that are side elements by their
meaning, and a few tags of links, lists and controls. What is learned outweighs it. Scripts, styles, titles and other raw text are no
words at all, up to the end of the page where they are not closed.

Text of the region is split into blocks at block tags; character references are decoded,
white space in a block becomes one space, blocks are joined by one line feed.

Defined cases: null html is empty; a page without words gives an empty text; equal sums
go to the longer region that starts first; an element that is not closed gives no context,
and a ``<`` that starts no tag is text. Rows keep their multiplicity (repeated page ids
too); extra columns are ignored. All steps are linear in the page but for a sort of its
side elements.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED = 400
WORD_LEAST, TAG_LEAST, TAG_MOST = 0.2, 0.1, 2.0
BESIDE = "beside the article"
STRONG, WEAK = 50, 10  # words outside that the prior stands for

# Elements whose content is raw text, no words of the page
RAW = ("script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes")
# Elements that by their meaning hold no main text
SIDE = "nav footer header aside form menu dialog head noscript template svg math object select button canvas audio video".split()
# Class, id and role words that tell the same
SIDE_WORDS = "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer login masthead menu modal nav navbar navigation newsletter notice paywall popup promo promotion related search share sharing sidebar signup site-header skip social sponsor sponsored subscribe tags toolbar widget contentinfo complementary hidden".split()
# Elements that start and end a block
BLOCK = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Words that count as seen outside the article before any page is read, by feature.
PRIOR = {name: STRONG for name in SIDE} | {f"{mark}{w}": WEAK for mark in ".#@" for w in SIDE_WORDS}

# Tags of links, lists and controls
PRIOR_TAGS = {name: STRONG for name in "a li ul ol input option select label".split()}

_SIDE = frozenset(SIDE)
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTR = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}


def _features(name: str, attrs: str) -> list[str]:
    """What is learned about an element: its name with each class, id and role word; its name alone where it has none, or tells by itself."""
    found: list[str] = []
    for m in _ATTR.finditer(attrs) if attrs.strip() else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        mark = {"class": ".", "id": "#", "role": "@"}.get(key)
        if mark:
            found += [f for w in value.split() for f in (mark + w, name + mark + w)]
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            found.append(".hidden")
    return [*found, name] if name in _SIDE or not found else found


def tokens(page: str) -> list[tuple[str, str, str]]:
    """The page as ("text", raw text, "") and ("tag", name or /name, attributes), without comments, declarations and raw text."""
    parts: list[tuple[str, str, str]] = []
    at, begun, size, last = 0, 0, len(page), page.rfind(">")

    def text(upto: int) -> None:
        if upto > begun:
            parts.append(("text", page[begun:upto], ""))

    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            text(at)
            end = page.find("-->", at + 2)
            at = begun = end + 3 if end >= 0 else size
            continue
        if at > last:  # no tag ends from here on
            break
        if page.startswith(("<!", "<?"), at):
            text(at)
            end = page.find("]]>", at) + 3 if page.startswith("<![CDATA[", at) else 0
            at = begun = end if end > 2 else page.find(">", at) + 1
            continue
        m = _TAG.match(page, at)
        if not m:
            at += 1
            continue
        text(at)
        at = begun = m.end()
        name, closing = m[1].lower(), page[m.start() + 1] == "/"
        parts.append(("tag", "/" + name if closing else name, m[2]))
        if not closing and name in _RAW_END and not m[2].rstrip().endswith("/"):
            end_tag = _RAW_END[name].search(page, at)
            at = begun = end_tag.end() if end_tag else size
            parts.append(("tag", "/" + name, ""))
    text(size)
    return parts


class _Page:
    """Tokens with their word counts, and the closed elements as (first, last, features, whether the element encloses the main text)."""

    def __init__(self, page: str):
        self.parts = tokens(page)
        self.words = [len(v.split()) if k == "text" else 0 for k, v, _ in self.parts]
        self.upto = [0, *accumulate(self.words)]
        ends: dict[int, int] = {}
        open_: dict[str, list[int]] = {}
        for i, (kind, name, _) in enumerate(self.parts):
            if kind == "tag" and name[0] == "/":
                if open_.get(name[1:]):
                    ends[open_[name[1:]].pop()] = i
            elif kind == "tag" and name not in VOID:
                open_.setdefault(name, []).append(i)
        starts = sorted(ends)
        marks = [i for i in starts if self.parts[i][1] in ("article", "main")]
        heads = [] if marks else [i for i in starts if self.parts[i][1] == "h1"]
        paragraphs = [i for i, (kind, name, _) in enumerate(self.parts) if kind == "tag" and name == "p"]
        self.articles = [(i, ends[i]) for i in marks if self.parts[i][1] == "article"]
        self.elements, reach, aside, side = [], -1, -1, set()
        for i in starts:
            name, end = self.parts[i][1], ends[i]
            features = _features(name, self.parts[i][2])
            if name == "header" and i < reach:  # that of the article, not of the page
                features[-1] = "header in article"
            if name in ("article", "main"):
                reach = max(reach, end)
                if i < aside:
                    side.add(i)
            if name in _SIDE:
                aside = max(aside, end)
            encloses = _first(marks, i) <= end
            if heads and (head := _first(heads, i)) <= end and name not in _SIDE:
                encloses = _first(paragraphs, head) <= end
            self.elements.append((i, end, features, encloses or self.count(i, end) == self.upto[-1]))
        only = [a for a in self.articles if a[0] not in side]
        self.article = only[0] if len(only) == 1 and len(self.articles) == 1 else None

    def count(self, first: int, end: int) -> int:
        return self.upto[end] - self.upto[first]


def _first(places: list[int], at: int) -> float:
    """The first of some rising places from ``at`` on."""
    k = bisect_left(places, at)
    return places[k] if k < len(places) else math.inf


class Weights:
    """The gain of a word, the weight of each feature and the cost of each tag."""

    def __init__(self, inside: Counter, outside: Counter, tag_in: Counter, tag_out: Counter, prior: dict[str, int] = PRIOR, prior_tags: dict[str, int] = PRIOR_TAGS):
        self.context = {f: math.log((inside[f] + 1) / (outside[f] + prior.get(f, 0) + 1)) for f in {*inside, *outside, *prior, BESIDE} if f}
        tag_out = tag_out + Counter(prior_tags)
        n_in, n_out = inside[""] + tag_in.total() + 1, outside[""] + tag_out.total() + 1
        share = math.log((inside[""] + 1) / n_in / ((outside[""] + 1) / n_out))
        self.word = max(WORD_LEAST, share)
        self.tag = {t: -min(TAG_MOST, max(TAG_LEAST, math.log((tag_out[t] + 1) / n_out / ((tag_in[t] + 1) / n_in)))) for t in {*tag_in, *tag_out}}
        self.unknown = -TAG_LEAST  # nothing is known against it

    @classmethod
    def learned(cls, pages: list[str], prior: dict[str, int] = PRIOR, prior_tags: dict[str, int] = PRIOR_TAGS) -> Weights:
        inside, outside, tag_in, tag_out = Counter(), Counter(), Counter(), Counter()
        for html in pages:
            page = _Page(html)
            if len(page.articles) != 1:
                continue
            (a, b), done = page.articles[0], -1
            n = page.count(a, b)
            inside[""] += n
            outside[""] += page.upto[-1] - n
            outside[BESIDE] += page.upto[-1] - n
            for i, (kind, name, _) in enumerate(page.parts):
                if kind == "tag":
                    (tag_in if a <= i <= b else tag_out)[name.lstrip("/")] += 1
            for i, end, features, _ in page.elements:
                if a <= i and end <= b:
                    for f in features:
                        inside[f] += page.count(i, end)
                elif i < a and end > b:
                    for f in features:
                        inside[f] += n
                elif i > done:  # the outermost element beside the article
                    done = end
                    for f in features:
                        outside[f] += page.count(i, end)
        return cls(inside, outside, tag_in, tag_out, prior, prior_tags)

    def scores(self, page: _Page) -> tuple[list[float], list[float]]:
        """The score of every token of a page; the same for the scan for the best region, which passes over side elements at no cost."""
        found = [self.word * n if k == "text" else self.tag.get(v.lstrip("/"), self.unknown) for (k, v, _), n in zip(page.parts, page.words, strict=True)]
        against, gains, forms = [], [0.0] * (len(found) + 1), set()
        for i, end, features, encloses in page.elements:
            weights = [self.context.get(f, 0.0) for f in features]
            if not encloses and (w := min(weights)) < 0:
                against.append((w, i, end))
                if page.parts[i][1] == "form" and min((w for f, w in zip(features, weights, strict=True) if f != "form"), default=0.0) >= 0:
                    forms.add(against[-1])
        if page.article:
            against += [(self.context[BESIDE], 0, page.article[0]), (self.context[BESIDE], page.article[1], len(found))]
            if (w := self.context.get("article", 0.0)) > 0:
                gains[page.article[0] : page.article[1]] = [w] * (page.article[1] - page.article[0])
        found = [x + g * n for x, g, n in zip(found, gains, page.words, strict=False)]
        if forms and not _uncovered(page.words, against):  # a form around all that is in no other side element
            against = [x for x in against if x not in forms]
        passed = list(found)
        # the least weight first; each token is set once, later ones skip over it
        free = list(range(len(found) + 1))
        for w, i, end in sorted(against):
            at = i
            while w < 0:
                root = at
                while free[root] != root:
                    root = free[root]
                while free[at] != root:
                    free[at], at = root, free[at]
                if root >= end:
                    break
                passed[root] = 0.0
                if page.words[root]:
                    found[root] = w * page.words[root]
                free[root] = at = root + 1
        return found, passed


def _uncovered(words: list[int], spans: list[tuple[float, int, int]]) -> bool:
    """Whether a word lies in none of some spans (weight, first, end)."""
    upto = -1
    for _, first, end in sorted(spans, key=lambda x: x[1]):
        if any(words[max(upto, 0) : first]):
            return True
        upto = max(upto, end)
    return any(words[max(upto, 0) :])


def best_region(scores: list[float]) -> tuple[int, int]:
    """(first, end) of the contiguous region of greatest sum; empty where nothing is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best and best > 0 and i + 1 - start > found[1] - found[0]:
            best, found = total, (start, i + 1)
    return found


def stretches(scores: list[float]) -> list[tuple[int, int]]:
    """The contiguous stretch of least sum, and again those of what is left on both sides of it, until no sum is below zero; (first, end) in order.

    One scan: the stretches so far lie on a stack, and a new one takes in those back to the last that began higher, if it ends lower. Each knows that one, so nothing is passed twice.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, end, sum before it, sum after it, the last one that began higher
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s >= 0:
            continue
        new = (i, i + 1, before, total)
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] <= new[2]:
                k = found[k][4]
            if k < 0 or found[k][3] <= new[3]:
                found.append((*new, k))
                break
            new = (found[k][0], new[1], found[k][2], new[3])
            del found[k:]
    return [f[:2] for f in found]


def main_text(html: str | None, weights: Weights) -> str:
    page = _Page(html or "")
    scores, passed = weights.scores(page)
    first, end = best_region(passed)
    parts = page.parts[first:end]
    said = [k for k, (kind, _, _) in enumerate(parts) if kind == "text" and page.words[first + k]]
    cut = {k for a, b in stretches([scores[first + k] for k in said]) for k in said[a:b]}
    blocks, held = [], []
    for k, (kind, value, _) in enumerate([*parts, ("tag", "p", "")]):
        if kind == "text":
            if k not in cut:
                held.append(value)
        elif value.lstrip("/") in BLOCK:
            if text := " ".join(entities.unescape("".join(held)).split()):
                blocks.append(text)
            held = []
    return "\n".join(blocks)


def fit(pages: DataFrame, labelled: int = LABELLED, prior: dict[str, int] = PRIOR) -> Weights:
    """Weights from at most ``labelled`` pages that mark their content themselves: those of least hash.

    Only pages under a hash threshold are looked at. It starts where some ``4 * labelled`` of
    all pages lie below and widens eightfold while too few of them are marked, so what is
    sent to the driver is bounded by the sample and not by the number of partitions.
    """
    drawn, share = F.xxhash64("html"), 4 * labelled / max(1, pages.count())
    while True:
        below = pages if share >= 1 else pages.where(drawn < F.lit(int(share * 2**64) - 2**63))
        marked = below.where(F.regexp_count("html", F.lit(r"(?i)<article[\s>]")) == 1).select("html").orderBy(drawn).limit(labelled).collect()
        if len(marked) == labelled or share >= 1:
            return Weights.learned(sorted(r["html"] for r in marked), prior)
        share *= 8


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
