"""Main text of HTML pages by a maximum-scoring run of tokens.

A page is a sequence of words and tags. Words score positive and tags negative, with weights from
labelled pages; one linear scan finds the contiguous run of the greatest sum, and the text is that
of all blocks the run touches. Scores are whole hundredths, so sums are exact; of equal runs the one
that ends first counts, and of those with that end the one that begins last.

Labelled pages are those that mark their article with <article> or <main>: at least half of their
words apart from links, in what isn't boilerplate, lie in such elements. ``LABELLED`` of them are
taken (the least ids; of rows that repeat an id one). A weight is the clipped logarithm of how much
more often a token of that kind lies inside the marked part than outside. Kinds are tags by name,
words by their innermost link, heading, list item or cell, and words by the class and id names of
their innermost named element, where two labelled pages or more show them; names count before contexts.

Boilerplate is left out wherever it stands: menus, page headers and footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments. An element is told by its tag or role, by a
class or id name of the fixed words below (a compound needs every part to be one of them, so
``cookie-notice`` is one and ``social-science``, ``no-sidebar`` and ``ad-free`` are none). Words that
sections of a text bear as well (``MILD``) tell it only where links make most of its words, or it takes input or
holds three parts of one name. A name that labelled pages have outside of their articles only tells elements of
an eighth of the page's words at most; in longer ones it lowers the score of a word. The evidence is the element's own: one
that holds most of a page's words is a container and never left out (reader comments are, beside
a text of ``BESIDE`` words).

A page that marks its article keeps what is marked, all of several marked parts but those that are
mostly links, and a heading <h1> right before it if it has none; nothing else. On other pages the scan decides.

Block elements cut the text into blocks, <br> is white space. Character references are decoded,
white space in a block becomes one space, blocks are joined by one newline. Reading a page takes time
in proportion to its length, also where tags or quotes are never closed.

Defined cases: null or empty html, or a page without main text, gives an empty text; unclosed
comments and scripts reach to the end of the page; an unclosed menu ends at the next <article>
or <main>; a tag without an end is text; repeated rows and null ids are kept; an empty table gives
an empty one; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled pages the weights are fitted on.
LABELLED = 500
#: Elements and roles.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea select".split())
ALWAYS = frozenset("head title nav footer aside button dialog menu object canvas audio video datalist".split())
MAYBE = frozenset("form fieldset".split())
CLOSED_BY_MARK = ALWAYS | {"header"}
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class and id names that tell boilerplate, those that tell reader comments, and those that say nothing.
TELLING = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie cookies footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related recommended search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond responses discussion".split())
#: Those of them that sections of a text bear as well; alone they need more than the name.
MILD = frozenset("promotion promoted related recommended discussion replies reply respond response responses".split())
#: Elements that hold one teaser or one reader's comment each, and those that take input.
UNITS = frozenset("article div li section dd tr".split())
INPUTS = frozenset("t:form t:input t:textarea t:select".split())
NEUTRAL = frozenset("site main page global top bottom left right side upper lower primary secondary list lists box block area section container wrapper wrap inner outer bar links link posts articles stories items item form buttons button icons media overlay thread 1 2 3".split())
#: What ends when an element begins: an unclosed paragraph, item, cell or row.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
ATTRIBUTE = re.compile(r"""([a-zA-Z:_-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|/|$|=)")
NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
IN_TAG = re.compile(r"[\"'>]")
CLOSE = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}
#: Hundredths: words of which labelled pages say nothing, links, tags, an element left out.
WORD, LINK, TAG, DROP = 100, -50, -5, -20
#: The same for words that only a learnt name speaks against.
LOW = 10
#: Bounds of fitted weights of words and tags.
WORDS, TAGS = (-100, 100), (-100, TAG)
#: Logarithm below which a name is boilerplate by the labelled pages.
OUTSIDE = -2.0
#: The part of a page's words that an element may hold and be left out for a name that labelled pages alone tell: one in so many.
LEARNT = 8
#: Words beside which reader comments are left out however long they are.
BESIDE = 20


def boilerplate_name(name: str) -> str:
    """``comments``, ``other``, ``mild`` or nothing, by the parts of a class or id name."""
    parts = [p for p in re.split(r"[_-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if p]
    if not parts or not all(p in TELLING or p in COMMENTS or p in NEUTRAL for p in parts):
        return ""
    if len(parts) == 1 and parts[0] in MILD:
        return "mild"
    if any(p in COMMENTS for p in parts):
        return "comments"
    return "other" if any(p in TELLING for p in parts) else ""


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """(what, text or name, attributes) of a page in order; what is text, start, end or raw (an element of no text, its content left out)."""
    at, n, quotes = 0, len(page), True
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", page[at:lt], ""
        if lt == n:
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        name = NAME.match(page, lt + 1)
        if name is None and page[lt + 1 : lt + 2] not in ("!", "?", "/"):
            yield "text", "<", ""
            at = lt + 1
            continue
        gt = inside = name.end() if name else lt + 1
        while quotes:
            m = IN_TAG.search(page, gt)
            if m is None:
                gt = -1
            elif m[0] == ">" or name is None:
                gt = m.start() if m[0] == ">" else page.find(">", gt)
            else:
                # to the closing quote; without one the quote is a character like others
                gt = page.find(m[0], m.end()) + 1
                if gt:
                    continue
                gt = -1
            break
        if not quotes or gt < 0:
            # a quote that never closes says that quotes of this page can't be trusted from here on
            quotes, gt = False, page.find(">", inside)
        if gt < 0:
            yield "text", page[lt:].replace("<", " < "), ""
            return
        at = gt + 1
        if name is None:
            continue
        tag, attrs = name[0].lower(), page[inside:gt]
        if tag[0] == "/":
            yield "end", tag[1:], ""
        elif tag in RAW:
            close = CLOSE[tag].search(page, at)
            at = n if close is None else close.start()
            if close is not None:
                end = page.find(">", at)
                at = n if end < 0 else end + 1
            yield "raw", tag, attrs
        else:
            yield "start", tag, attrs


class Page:
    """A page as tokens in order.

    Per token: ``kind`` (``w:`` and a context, ``t:`` and a tag's name), ``text`` and ``words`` (none for
    tags), ``block``, ``element`` (the innermost) and ``marked`` (the number of the outermost <article> or <main>
    around it, 0 for none). Per element: its name, class and id names, those of the innermost named element
    at or above it (``near``), its first token and the one after its last.
    """

    def __init__(self, page: str):
        self.kind, self.text, self.words, self.block, self.element, self.marked = [], [], [], [], [], []
        self.name, self.names, self.first, self.last, self.told = ["#"], [()], [0], [0], [""]
        self.near: list[tuple[str, ...]] = [()]
        self.blocks = 0
        stack, open_ = [0], Counter()
        context: list[str] = ["p"]
        marks, depth = 0, 0

        def put(kind: str, text: str = "") -> None:
            self.kind.append(kind)
            self.text.append(text)
            self.words.append(len(text.split()))
            self.block.append(self.blocks)
            self.element.append(stack[-1])
            self.marked.append(marks if depth else 0)

        def close() -> None:
            nonlocal depth
            e = stack.pop()
            context.pop()
            open_[self.name[e]] -= 1
            depth -= self.name[e] in ("article", "main")
            self.last[e] = len(self.kind)

        for what, x, attrs in markup(page):
            if what == "text":
                put("w:" + context[-1], x)
            elif what == "raw":
                put("t:" + x)
            elif x == "br" or x in VOID:
                if x in BLOCKS:
                    self.blocks += 1
                if x == "br":
                    put("w:p", " ")
                put("t:" + x)
            elif what == "end":
                if x in BLOCKS:
                    self.blocks += 1
                if open_[x]:
                    while self.name[stack[-1]] != x:
                        close()
                    close()
                put("t:" + x)
            else:
                if x in BLOCKS:
                    self.blocks += 1
                    if self.name[stack[-1]] == "p":
                        close()
                ends = ENDS.get(x, ())
                for _ in range(3):
                    if self.name[stack[-1]] in ends:
                        close()
                if x in ("article", "main") and not depth and any(open_[y] for y in CLOSED_BY_MARK):
                    # menus and the like that were never closed end here
                    below = next(k for k, e in enumerate(stack) if self.name[e] in CLOSED_BY_MARK)
                    while len(stack) > below:
                        close()
                if x == "body" and open_["head"]:
                    while open_["head"]:
                        close()
                if x in ("article", "main"):
                    marks += not depth
                    depth += 1
                put("t:" + x)
                if not attrs.endswith("/") or x in BLOCKS or x == "a":
                    self._open(x, attrs, stack[-1], depth > 0)
                    stack.append(len(self.name) - 1)
                    open_[x] += 1
                    context.append("h" if x[0] == "h" and x[1:] in "123456" else x if x in ("a", "li", "td") else "p" if x in BLOCKS else context[-1])
        while len(stack) > 1:
            close()
        self.last[0] = len(self.kind)
        plain = [n if k != "w:a" else 0 for n, k in zip(self.words, self.kind)]
        self.plain_sum = [0, *accumulate(plain)]
        self.word_sum = [0, *accumulate(self.words)]
        self.marked_sum = [0, *accumulate(n if m else 0 for n, m in zip(plain, self.marked))]

    def _open(self, name: str, attrs: str, parent: int, in_article: bool) -> None:
        a = {k.lower(): x or y or z for k, x, y, z in ATTRIBUTE.findall(attrs)} if "=" in attrs else {}
        names = (*a.get("class", "").split(), *a.get("id", "").split())
        told = ""
        if name in ALWAYS:
            told = "always"
        elif name in ("html", "body", "article", "main"):
            names = ()
        elif name in MAYBE or (name == "header" and not in_article) or a.get("role", "").lower() in ROLES or a.get("aria-hidden", "").lower() == "true" or (attrs and HIDDEN.search(attrs)):
            told = "other"
        if not told or told == "other":
            by_name = {boilerplate_name(x) for x in names}
            told = "comments" if "comments" in by_name else "other" if "other" in by_name else told or ("mild" if "mild" in by_name else "")
        for held, x in ((self.name, name), (self.names, names), (self.near, names or self.near[parent]), (self.first, len(self.kind)), (self.last, 0), (self.told, told)):
            held.append(x)

    def _sum(self, sums: list[int], e: int) -> int:
        return sums[self.last[e]] - sums[self.first[e]]

    def _collected(self, e: int) -> bool:
        """Whether an element takes input or holds three parts or more of one name, as lists of teasers and comments do."""
        if not INPUTS.isdisjoint(self.kind[self.first[e] : self.last[e]]):
            return True
        units: Counter = Counter()
        for x in range(e + 1, len(self.name)):
            if self.first[x] >= self.last[e]:
                break
            if self.name[x] in UNITS and self.names[x]:
                units[self.name[x], self.names[x]] += 1
        return any(n >= 3 for n in units.values())

    def title(self, out: list[bool], marks: set[int]) -> tuple[int, int]:
        """The tokens of a heading <h1> right before the marked text, if that has none of its own: no link, nothing between them but what is left out."""
        begin = next((k for k, m in enumerate(self.marked) if m in marks), 0)
        heads = [e for e, x in enumerate(self.name) if x == "h1"]
        if any(self.marked[self.first[e] : self.first[e] + 1] and self.marked[self.first[e]] in marks for e in heads):
            return 0, 0
        e = next((e for e in reversed(heads) if self.last[e] <= begin), None)
        if e is None or self._sum(self.word_sum, e) > self._sum(self.plain_sum, e):
            return 0, 0
        first, last = self.first[e], self.last[e]
        held = any(out[first:last]) or any(n and not gone for n, gone in zip(self.words[last:begin], out[last:begin]))
        return (0, 0) if held else (first, last)

    def left_out(self, weights: dict[str, float]) -> list[bool]:
        """For each token whether it lies in boilerplate."""
        told = [t or ("learnt" if any(weights.get("o:" + x) for x in names) else "") for t, names in zip(self.told, self.names)]
        # unnested elements that are left out for certain, to tell how many words count
        total, covered = self.plain_sum[-1], 0
        for e, t in enumerate(told):
            if t == "always" and self.first[e] >= covered:
                total -= self._sum(self.plain_sum, e)
                covered = self.last[e]
        all_marked = self.marked_sum[-1]
        out = [False] * len(self.kind)
        covered = bare = 0
        for e, t in enumerate(told):
            if not t or self.first[e] < covered:
                continue
            own, marked = self._sum(self.plain_sum, e), self._sum(self.marked_sum, e)
            if t == "comments":
                keep = 2 * own > total and total - own < BESIDE
            elif t == "other":
                around = 2 * marked > all_marked > 0 and not (self.first[e] < len(self.marked) and self.marked[self.first[e]])
                keep = around or (2 * own > total and (marked > 0 or all_marked < BESIDE))
            elif t == "learnt":
                keep = LEARNT * own > total
            elif t == "mild":
                linked = self._sum(self.word_sum, e) > 2 * own
                keep = not linked and (self.first[e] < bare or not self._collected(e))
                bare = max(bare, self.last[e]) if keep else bare
            else:
                keep = False
            if not keep:
                covered = self.last[e]
                out[self.first[e] : covered] = [True] * (covered - self.first[e])
        return out

    def kept_marks(self, out: list[bool]) -> set[int]:
        """The marked parts of a page that marks its article: all that aren't mostly links; none if the page doesn't mark it."""
        inside, links, rest = Counter(), Counter(), 0
        for k, n, m, gone in zip(self.kind, self.words, self.marked, out):
            if n and not gone:
                if not m:
                    rest += n if k != "w:a" else 0
                elif k == "w:a":
                    links[m] += n
                else:
                    inside[m] += n
        if not inside or sum(inside.values()) < rest:
            return set()
        return {m for m, n in inside.items() if n >= links[m]}


def best_run(scores: Sequence[int]) -> tuple[int, int] | None:
    """[first, last] of the contiguous run with the greatest sum above 0; of equal ones the first to end, then the last to begin."""
    best = run = start = 0
    found = None
    for k, x in enumerate(scores):
        if run <= 0:
            run, start = 0, k
        run += x
        if run > best:
            best, found = run, (start, k)
    return found


def scores(p: Page, out: list[bool], marks: set[int], weights: dict[str, float]) -> list[int]:
    """Hundredths for each token."""
    found: dict[int, int | None] = {}

    def by_name(e: int) -> int | None:
        if e not in found:
            known = [weights["c:" + x] for x in p.near[e] if "c:" + x in weights]
            found[e] = min(known) if known else None
            learnt = [x for x in p.near[e] if "o:" + x in weights]
            if learnt and not any(map(boilerplate_name, learnt)):
                found[e] = LOW  # too long to be left out
        return found[e]

    result = []
    for kind, n, gone, e, m in zip(p.kind, p.words, out, p.element, p.marked):
        if marks:
            # what is marked counts as it is, and nothing else
            result.append((WORD * n if kind[0] == "w" else TAG) if m in marks and not gone else 0)
        elif gone:
            result.append(0)
        elif kind[0] == "t":
            result.append(weights.get(kind, TAG))
        elif not n:
            result.append(0)
        else:
            own = by_name(e)
            result.append(n * (own if own is not None and kind != "w:a" else weights.get(kind, LINK if kind == "w:a" else WORD)))
    if not marks:
        # an element left out costs what a tag does
        for k in range(1, len(out)):
            if out[k] and not out[k - 1]:
                result[k] = DROP
    return result


def extract(page: str | None, weights: dict[str, float]) -> str:
    """Main text of a page."""
    if not page:
        return ""
    p = Page(page)
    out = p.left_out(weights)
    marks = p.kept_marks(out)
    run = best_run(scores(p, out, marks, weights))
    if run is None:
        return ""
    blocks: dict[int, list[str]] = {}
    first, last = p.block[run[0]], p.block[run[1]]
    if marks:
        begin, end = p.title(out, marks)
        for b, text in zip(p.block[begin:end], p.text[begin:end]):
            if text:
                blocks.setdefault(b, []).append(text)
    for b, text, gone, m in zip(p.block, p.text, out, p.marked):
        if first <= b <= last and text and not gone and (not marks or m in marks):
            blocks.setdefault(b, []).append(text)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


def evidence(page: str | None) -> dict[str, tuple[int, int]] | None:
    """(inside, outside) of every kind on a labelled page; None for a page that isn't one."""
    if not page:
        return None
    p = Page(page)
    out = p.left_out({})
    marks = p.kept_marks(out)
    if not marks:
        return None
    n: Counter = Counter()
    head = [False] * len(p.kind)
    for e, name in enumerate(p.name):
        if name in ("head", "title"):
            head[p.first[e] : p.last[e]] = [True] * (p.last[e] - p.first[e])
    for kind, words, m, e, h in zip(p.kind, p.words, p.marked, p.element, head):
        if h or (kind[0] == "w" and not words):
            continue
        n[kind, m in marks] += words or 1
        if kind[0] == "w":
            for x in set(p.near[e]):
                n["c:" + x, m in marks] += words
    return {k: (n[k, True], n[k, False]) for k, _ in n}


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", most: int = LABELLED) -> dict[str, float]:
    """Weights in hundredths from labelled pages: words, tags, names (``c:``) and names found outside only (``o:``, 1)."""
    text = F.col(html_col).cast("string")
    likely = pages.where(text.rlike("(?i)<(article|main)[\\s>]")).select(F.col(id_col).alias("id"), text.alias("html"))

    def marking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([evidence(x) is not None for x in batch.column(1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep)], names=["id"])

    # ids alone are sorted; the pages are then read by a bound on them, in rounds of twice as many until
    # enough mark their article
    after, last, have, size = None, None, 0, most
    kind = likely.schema["id"].dataType.simpleString()
    while have < most:
        rest = likely.where("id is not null") if after is None else likely.where(F.col("id") > F.lit(after))
        edge = rest.select("id").distinct().orderBy("id").limit(size).agg(F.max("id")).first()[0]
        if edge is None:
            break
        good = rest.where(F.col("id") <= F.lit(edge)).select("id", "html").mapInArrow(marking, f"id {kind}")
        good = good.distinct().orderBy("id").limit(most - have).agg(F.max("id"), F.count("*")).first()
        after, last, have, size = edge, last if good[0] is None else good[0], have + good[1], 2 * size
    # one row an id: the least of its texts
    labelled = likely.where(F.col("id") <= F.lit(last)).groupBy("id").agg(F.min("html").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, a, b) for page in batch.column(0).to_pylist() for k, (a, b) in (evidence(page) or {}).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["kind", "a", "b"])

    counts = labelled.select("html").mapInArrow(run, "kind string, a long, b long").groupBy("kind").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("pages"))
    out = {}
    # as many rows as the labelled pages share kinds
    for r in counts.where("pages > 1 or kind not like 'c:%'").collect():
        odds = math.log((r.a + 1) / (r.b + 1))
        low, high = TAGS if r.kind[0] == "t" else WORDS
        out[r.kind] = min(high, max(low, round(100 * odds)))
        if r.kind[0] == "c" and not r.a and odds <= OUTSIDE:
            out["o:" + r.kind[2:]] = 1
    return out


def main_text(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page; weights are fitted on the pages themselves unless given."""
    weights = fit(pages, html_col, id_col) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [extract(x, weights) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    cols = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = cols.schema["page_id"].dataType.simpleString()
    return cols.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
