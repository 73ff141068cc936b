"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags.  First pass: link density, stop-word density and length make a block good, bad or
ambiguous (short, or of low density without links); where the page's language has no stop words here, link density and length
do.  What a block is part of is a prior that outweighs these: elements that are no text of an article (menus, forms, footers, ...), by
tag, role and words of class and id, and everything outside an article or main element that has text.  Such words on an
element that holds an article don't count, nor on the one that holds most of the good text where nothing else is left of the
page.  Second pass: ambiguous blocks inherit from the nearest decided neighbour on either side, in an article from those
inside it; leaving an element makes a neighbour farther, a heading looks ahead first, and a tie between good and bad, or no
neighbour, goes to good inside an article, to bad elsewhere.

Elements without text of their own (scripts, buttons, ...) that are never closed end at the next block.

Defined results: null and empty pages have an empty text; a tag that the page's end cuts off is dropped; pages of
any length are read whole; rows may repeat; other columns stay, and added ones get an underscore if they would clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# HTML's elements, by their part in a page.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = set("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
SILENT = set("audio button canvas datalist iframe label map math noframes noscript object script select style svg template textarea title video".split())
NEVER = set("aside dialog footer form menu nav".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role that mark what isn't the article.
MARKS = set("ad ads adv advert adverts advertisement advertising advertorial alert banner breadcrumb breadcrumbs byline comment commentlist comments consent contentinfo complementary cookie cookies copyright dialog disqus feedback footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popular popup promo promoted promotion recommend recommendations recommended related replies reply respond search share sharebar sharing sidebar signup social sponsor sponsored subscribe subscription taboola teaser toolbar topbar trending warning widget".split())
# Function words of English, German, French and Spanish.
STOP = set(
    "the of and to in is it for was on are with as at be this have from or by but not what all were when your can there an which their if will that he she they we you i a "
    "der die das und ist von mit den ein eine einen im zu auf für nicht sich dem des als auch es an werden aus er hat dass sie nach bei um noch wie über so zum war haben nur oder aber vor "
    "le la les de du un une et est que qui dans pour pas sur plus par ne se ce sont avec au aux il elle nous vous ou mais son sa ses cette être "
    "el los las y en por con para del al lo como más su sus una pero este ya o fue ha muy sin sobre también me hasta hay donde".split()
)
SHORT, LONG = 50, 140  #: characters; one of a script without spaces counts twice
DENSE, SPARSE = 0.25, 0.06  #: share of stop words
LINKED = 0.4  #: share of linked characters that a good block stays below
GOOD, BAD, OPEN = 1, 0, None
_WORD = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_WIDE = re.compile(r"[\u2E80-\uD7FF\uF900-\uFAFF]")
_TAGS = re.compile(rf"<!--|<(/?)({'|'.join(sorted(SILENT))})(?![a-zA-Z0-9])", re.I)
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")


def _marked(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for word in value.split():
                parts = [p.lower() for p in _PARTS.findall(word)]
                if parts and parts[0] not in ("has", "no", "with", "without") and not MARKS.isdisjoint(parts):
                    return True
        elif name in ("hidden", "aria-hidden") and value != "false":
            return True
    return False


def _closed(html: str) -> list[bool]:
    """For each start tag of an element in SILENT, in order, whether an end tag of its own follows; comments and scripts hold no tags."""
    found: list[bool] = []
    open_: dict[str, list[int]] = {}
    at, low, ends = 0, html.lower(), {}  # ends: of a tag the place of its next end tag, as far as it was looked for
    while m := _TAGS.search(html, at):
        at, tag = m.end(), (m.group(2) or "").lower()
        if not tag:
            end = html.find("-->", at)
            at = end + 3 if end >= 0 else at
        elif m.group(1):
            if open_.get(tag):
                found[open_[tag].pop()] = True
        else:
            if tag in ("button", "label", "select"):  # can't hold one of their own
                open_[tag] = []
            open_.setdefault(tag, []).append(len(found))
            found.append(False)
            if tag in ("script", "style"):
                if 0 <= ends.get(tag, 0) < at:
                    ends[tag] = low.find("</" + tag, at)
                elif tag not in ends:
                    ends[tag] = low.find("</" + tag, at)
                at = ends[tag] if ends[tag] >= 0 else at
    return found


class _Blocks(HTMLParser):
    """rows: text, linked characters, heading, innermost marked container, inside an article, innermost container (0: none).

    above, depth: of each container the one around it and how deep it lies; marked: by container, whether its tag or its words say so;
    mark_above: of a marked container the next marked one around it; holds: containers that hold an article.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.rows, self.open, self.silent, self.links, self.count = [], [], [], 0, 0
        self.marked, self.holds, self.articles = {}, set(), 0
        self.above, self.depth, self.mark_above, self.marks, self.tags = [0], [0], {}, [0], Counter()
        self.closed = iter(_closed(html))
        self._begin()

    def _begin(self) -> None:
        self.text, self.linked, self.heading = [], 0, False

    def _end_block(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.rows.append((text, self.linked, self.heading, self.marks[-1], self.articles > 0, self.open[-1][1] if self.open else 0))
        self._begin()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and tag not in SILENT:
            while self.silent and not self.silent[-1][1]:
                self.silent.pop()
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            elif tag in BLOCKS:
                self._end_block()
            return
        if tag in SILENT:
            self.silent.append((tag, next(self.closed, True)))
            return
        if self.silent:
            return
        if tag == "a":
            self.links += 1
        if tag in BLOCKS:
            self._end_block()
            self.links = 0
            self.heading = tag in HEADINGS
        marked = tag not in ("html", "body", "main") and _marked(attrs)
        if tag in CONTAINERS or (marked and tag not in ("a", "b", "i", "em", "strong")):
            if tag in NEVER or (tag == "header" and not self.articles):
                self.marked[self.count + 1] = "tag"
            elif marked:
                self.marked[self.count + 1] = "article" if tag == "article" else "words"
            if tag in ("article", "main"):
                self.articles += 1
                for _, i in reversed(self.open):
                    if i in self.holds:
                        break
                    self.holds.add(i)
            self.count += 1
            self.above.append(self.open[-1][1] if self.open else 0)
            self.depth.append(len(self.open) + 1)
            if self.count in self.marked:
                self.mark_above[self.count] = self.marks[-1]
            self.marks.append(self.count if self.count in self.marked else self.marks[-1])
            self.open.append((tag, self.count))
            self.tags[tag] += 1

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCKS and tag not in SILENT:
            while self.silent and not self.silent[-1][1]:
                self.silent.pop()
        if tag in SILENT:
            if any(t == tag for t, _ in self.silent):
                while self.silent.pop()[0] != tag:
                    pass
            return
        if self.silent:
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in BLOCKS:
            self._end_block()
            self.links = 0
        if self.tags[tag]:
            at = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag)
            if tag not in BLOCKS:
                self._end_block()
            self.articles -= sum(t in ("article", "main") for t, _ in self.open[at:])
            self.tags.subtract(t for t, _ in self.open[at:])
            del self.open[at:], self.marks[at + 1 :]

    def handle_data(self, data):
        if self.silent:
            return
        self.text.append(data)
        if self.links:
            self.linked += len("".join(data.split()))


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text) + len(_WIDE.findall(text))


def _stop_words(text: str) -> tuple[int, int]:
    """Stop words and all words."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP for w in words), len(words)


def first_label(text: str, linked: int, density: float, known: bool = True) -> int | None:
    """Stop-word density, length and link density of one block; without ``known`` stop words the other two."""
    letters = max(1, len(text) - text.count(" "))
    if linked / letters > LINKED:
        return BAD
    size, density = _size(text), density if known else 0.0
    if size < SHORT:
        return BAD if linked and density < SPARSE else OPEN
    if not known or density >= DENSE or (density >= SPARSE and size >= LONG):
        return GOOD
    return OPEN


def _shared(page: _Blocks) -> list[int]:
    """Of each block how many containers it shares with the next one; over a whole page each container is left and entered once."""
    out = []
    for a, b in zip(page.rows, page.rows[1:]):
        x, y = a[5], b[5]
        while x != y:
            if page.depth[x] >= page.depth[y]:
                x = page.above[x]
            else:
                y = page.above[y]
        out.append(page.depth[x])
    return out


def prior(page: _Blocks, content: list[int | None]) -> list[bool]:
    """Whether what a block is part of makes it bad, whatever its text is."""
    rows, marked = page.rows, page.marked
    free = {i for i, kind in marked.items() if kind == "words" and i in page.holds}

    def judged() -> list[bool]:
        bad = {0: False}
        for i, above in page.mark_above.items():  # those around come first
            bad[i] = i not in free or bad[above]
        return [bad[r[3]] for r in rows]

    bad = judged()
    if any(x is GOOD and not b for x, b in zip(content, bad)):
        return bad
    # nothing is left: of the elements with such words the one with most good text, unless that is no more than a notice
    inner, words = {0: 0}, {0: True}
    for i, above in page.mark_above.items():
        inner[i] = inner[above] if i in free else i
        words[i] = words[above] and (i in free or marked[i] != "tag")
    held: dict[int, list[int]] = {}
    for r, x in zip(rows, content):
        if x is GOOD and inner[r[3]] and words[r[3]]:
            held.setdefault(inner[r[3]], []).append(_size(r[0]))
    most = max(held, key=lambda i: (sum(held[i]), -i), default=None)
    if most is not None and (marked[most] == "article" or len(held[most]) > 1 or sum(held[most]) >= 2 * LONG):
        while most:
            free.add(most)
            most = page.mark_above[most]
    return judged()


def labels(page: _Blocks) -> list[int]:
    """Both passes."""
    rows = page.rows
    counts = [_stop_words(r[0]) for r in rows]
    known = sum(stop for stop, _ in counts) >= SPARSE / 2 * sum(n for _, n in counts)
    content = [first_label(r[0], r[1], stop / max(n, 1), known) for r, (stop, n) in zip(rows, counts)]
    first = [BAD if bad else x for x, bad in zip(content, prior(page, content))]
    if sum(len(r[0]) for r, x in zip(rows, first) if r[4] and x != BAD) >= SHORT:
        first = [x if r[4] else BAD for r, x in zip(rows, first)]
    n, shared = len(rows), _shared(page)
    # the nearest decided blocks, and how many containers all blocks up to there share
    before, after = [None] * n, [None] * n
    for out, order, step in ((before, range(n), -1), (after, reversed(range(n)), 0)):
        last, low = None, 0
        for i in order:
            if last is not None:
                low = min(low, shared[i + step])
                out[i] = (last, low)
            if first[i] is not OPEN:
                last, low = i, page.depth[rows[i][5]]
    out = list(first)
    undecided = all(x is OPEN for x in first)  # a page of short blocks alone: these are its text
    for i, (_, _, heading, _, inside, own) in enumerate(rows):
        if first[i] is not OPEN:
            continue
        # inside an article what lies outside it says nothing
        near_by = [s for s in (before[i], after[i]) if s is not None and (rows[s[0]][4] or not inside)]
        sides = [(2 * (page.depth[own] + page.depth[rows[j][5]] - 2 * low) + abs(i - j) - (heading and j > i), first[j]) for j, low in near_by]
        if not sides:
            out[i] = GOOD if inside or undecided else BAD
            continue
        near = min(d for d, _ in sides)
        found = {x for d, x in sides if d == near}
        out[i] = found.pop() if len(found) == 1 else (GOOD if inside else BAD)
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    html = _CUT_TAG.sub("", html)
    parser = _Blocks(html)
    parser.feed(html)
    parser.close()
    parser._end_block()
    return "\n\n".join(r[0] for r, x in zip(parser.rows, labels(parser)) if x == GOOD)


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """Add the main text of every page."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(main_text, na_action=None)

    return pages.withColumn(common.fresh(pages, into)[0], run(F.coalesce(F.col(html), F.lit(""))))
