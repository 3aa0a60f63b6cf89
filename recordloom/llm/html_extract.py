"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of words and tags.  Words score positive and tags negative, both by weights that
are fitted on labelled pages: pages of the table whose markup names its content by exactly one <article> or <main>
are the labels, and the weights are learned for what else is known of a token - the innermost container around
it (its tag and the words of class and id) - so they hold for pages without such an element.  Lists, tables and
figures without a name have no weight of their own, so those of an article stay where most lists are menus.  One linear scan
over all pieces finds the contiguous region of the largest sum (the first of equal ones).  An <article> or <main> is one
more learned weight: it lightens what tags and insets cost inside of it, and a region pays for going on from its words to
words outside, or back.  So the scan ends at the element unless more text than that stands outside.  In the region, containers of negative weight (menus, asides, adverts, comments,
forms) are left out, and the rest is written block by block.  A class word or id tells something only as a whole (`sidebar`, not
`has-sidebar`), and nothing of the element that the page is about - the <article> or <main> with the most words - or what
holds it; a heading that names comments or links to other pages speaks for its section.

Fitting reads at most about `max_pages` pages, chosen by a hash of the id; its result is a few hundred numbers.

Defined cases: null or empty html gives ""; very long pages are read whole; end tags that HTML implies (of paragraphs, items,
rows and cells) count as written; other broken or unclosed markup is read as far as it goes; null ids are kept; a page whose
best region has no positive sum gives ""; repeated rows give repeated results; an empty table gives no rows;
other columns of the input are kept, but those with the names of the results.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import bound_batches

MAX_PAGES = 2_000
#: The most that a run of words in containers of negative weight takes from a region around it.
INSET_COST = 8.0
#: The weight of a landmark at most, and the words that a region pays for each unit of it at a landmark's edge.
LANDMARK_MOST, EDGE_WORDS = 4.0, 12.5
#: Fixed values of HTML: elements without an end tag, elements whose content is no text, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea iframe svg math object select title head".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Fixed values of HTML: elements that an opening tag ends, and those that bound the search for them.
_CELLS, _ROWS = frozenset(["td", "th"]), frozenset(["tr"])
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (_CELLS, _ROWS | {"table"}),
    "th": (_CELLS, _ROWS | {"table"}),
    "tr": (_ROWS, frozenset(["table"])),
    **dict.fromkeys(["tbody", "thead", "tfoot"], (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"]))),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    **dict.fromkeys(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split(),
        (frozenset(["p"]), BLOCK - {"p"}),
    ),
}
#: Elements that may carry a container's meaning; others pass on that of their parent.
CONTAINER = frozenset("article aside body dialog div footer form header main menu nav ol section table ul figure details fieldset span p".split())
#: Prior scores a word: what the element or the words of class, id and role say before any page is seen.
PRIOR_TAG = {"nav": -4.0, "footer": -4.0, "aside": -4.0, "form": -4.0, "menu": -4.0, "dialog": -4.0, "button": -4.0, "header": -4.0, "fieldset": -4.0}
#: Words that say what an element is for, and words that may stand beside them in a compound; a class word or id tells something if it is made of both kinds only.
TELLING = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promotion recommended recommendation recommendations related replies reply respond share sharing sidebar signup social sponsor sponsored sponsors subscribe toolbar widget widgets".split()
)
BESIDE = frozenset(
    "area article articles bar block body bottom box btn button buttons card cards col column container content entry fixed form global group icon icons inner item items left link links list main mobile outer page panel policy post posts primary right row section secondary site slot small sticky stories story top unit wrap wrapper".split()
)
#: What an element within an <article> or <main> may be called without being the page's.
OF_ARTICLE = frozenset(["header", "masthead", "banner"])
#: Headings of sections that are no part of an article, whatever their markup says.
SECTIONS = re.compile(
    r"(?:\d+ )?(?:reader |user |your |les |los )?(?:comments?|commentaires?|comentarios?|kommentare?)(?: \(\d+\)| \d+)?:?|leave (?:a|your) (?:reply|comment)|join the (?:discussion|conversation)|laisser un commentaire|deja un comentario|(?:related|recommended|more|other) (?:articles|posts|stories|news|reading)|you (?:may|might) also like|read (?:next|also|more)|share this(?: article| post| story)?|advertisements?|sponsored(?: content)?|newsletter|subscribe(?: now)?|follow us",
    re.I,
)
LANDMARK = frozenset(["article", "main"])
#: Elements that hold content and menus alike: without a name they say nothing of their own.
NEUTRAL = frozenset("ul ol table figure details".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|([^<]+|<)", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$|/)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[-_:.\d]+")


@dataclass
class Piece:
    """A run of text, or a tag (text is None); context: number of the innermost container around it."""

    text: str | None
    tag: str
    context: int
    inside: int
    block: int


@dataclass
class Page:
    """pieces; landmarks: number of outermost ones; parents, keys: the containers by number, the first of which is none; free: those whose names do not count."""

    pieces: list[Piece] = field(default_factory=list)
    landmarks: int = 0
    parents: list[int] = field(default_factory=lambda: [0])
    keys: list[str | None] = field(default_factory=lambda: [None])
    free: set[int] = field(default_factory=set)

    def around(self, context: int, most: int) -> set[str]:
        """Keys of the innermost containers, `most` at most."""
        out: set[str] = set()
        while context and len(out) < most:
            if self.keys[context]:
                out.add(self.keys[context])
            context = self.parents[context]
        return out


HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Containers around a word that the fit reads.
FIT_CONTEXTS = 64


def parse(source: str) -> Page:
    """Pieces with the containers around them.  Open elements are found by name, so any number of them costs a page no more than their tags."""
    page, stack = Page(), []
    context = landmark = block = at = 0
    places: dict[str, list[int]] = {}
    opened_in: list[int] = [0]
    #: By depth: where a section under a telling heading began, and that heading's level.
    sections: dict[int, tuple[int, str]] = {}
    heading: tuple[int, int] | None = None

    def enter(key: str | None) -> int:
        page.parents.append(context)
        page.keys.append(key)
        return len(page.keys) - 1

    def close(k: int) -> None:
        nonlocal context, landmark, heading
        depth = heading[0] if heading else -1
        level = end_heading() if depth >= k else None
        context, landmark = stack[k][1], stack[k][2]
        while len(stack) > k:
            sections.pop(len(stack), None)
            places[stack.pop()[0]].pop()
        if level and depth == k:
            sections[k] = (context, level)
            context = enter("section.comments")

    def end_heading() -> str | None:
        """The level of a heading that tells what its section is; its own words are part of that."""
        nonlocal heading
        depth, first = heading
        heading = None
        said = _SPACE.sub(" ", "".join(p.text for p in page.pieces[first:] if p.text)).strip()
        if SECTIONS.fullmatch(said):
            own = enter("section.comments")
            for p in page.pieces[first:]:
                p.context = own
            return stack[depth][0]
        return None

    def end_implied(name: str) -> None:
        """Close what an opening tag ends: a paragraph before a block, an item before the next one."""
        over, bound = ENDS.get(name, ((), ()))
        last = max((places[x][-1] for x in over if places.get(x)), default=-1)
        if last >= 0 and last > max((places[x][-1] for x in bound if places.get(x)), default=-1):
            close(last)

    while m := _TOKEN.match(source, at):
        at = m.end()
        name = m[2]
        if name is None:
            if m[4] is not None:
                page.pieces.append(Piece(html.unescape(m[4]), "", context, landmark, block))
            elif m[0].startswith("<![CDATA["):
                page.pieces.append(Piece(m[0][9:].removesuffix("]]>"), "", context, landmark, block))
            continue
        name = name.lower()
        block += name in BLOCK
        if m[1]:
            if places.get(name):
                close(places[name][-1])
            page.pieces.append(Piece(None, name, context, landmark, block))
            continue
        if name in RAW:
            if name == "head":
                continue
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            at = end.end() if end else (len(source) if name in ("script", "style", "template", "textarea") else at)
            page.pieces.append(Piece(None, name, context, landmark, block))
            continue
        end_implied(name)
        if name in HEADING and len(stack) in sections and name <= sections[len(stack)][1]:
            context = sections.pop(len(stack))[0]
        page.pieces.append(Piece(None, name, context, landmark, block))
        if name in VOID or m[3].endswith("/"):
            continue
        places.setdefault(name, []).append(len(stack))
        stack.append((name, context, landmark))
        key = context_key(name, m[3], bool(landmark))
        if key:
            context = enter(key)
        if name in LANDMARK:
            if not landmark:
                page.landmarks += 1
                opened_in.append(context)
            landmark = page.landmarks
        if name in HEADING:
            heading = (len(stack) - 1, len(page.pieces))
    free_main(page, opened_in)
    return page


def free_main(page: Page, opened_in: list[int]) -> None:
    """The landmark with the most words is what the page is about, so nothing that holds it whole is told by its name, nor by being a form or a header."""
    if page.landmarks:
        words = [0] * (page.landmarks + 1)
        for p in page.pieces:
            if p.text and p.inside:
                words[p.inside] += len(p.text.split())
        context = opened_in[words.index(max(words[1:]), 1)]
        while context:
            page.free.add(context)
            context = page.parents[context]


def context_key(name: str, attributes: str, in_landmark: bool = False) -> str | None:
    """What is known of a container: its tag, and its words of class, id and role.  <html> and <body> are none; a heading's id is an anchor, and an article's own header is no page's."""
    if name in ("html", "body"):
        return None
    words = {w.strip("\"'").lower() for k in _NAMES.finditer(attributes) if not (name in HEADING and k[1].lower() == "id") for w in _SPACE.split(k[2].strip("\"'")) if w} if attributes else set()
    if in_landmark:
        name = "div" if name == "header" else name
        words = {w for w in words if not OF_ARTICLE & set(_PART.split(w))}
    names = " ".join(sorted(words))
    if attributes and _HIDDEN.search(attributes):
        names += " hidden"
    if name in LANDMARK or name not in CONTAINER and name not in PRIOR_TAG:
        return f"*.{names}" if names else None
    return f"{name}.{names}" if names else (None if name in ("div", "span", "p", "section") else name)


def tells(word: str) -> bool:
    """Whether a class word or id says that its element is no content: all of its parts are known, and one of them is telling."""
    parts = [x for x in _PART.split(word) if x]
    return any(x in TELLING for x in parts) and all(x in TELLING or x in BESIDE for x in parts)


def prior(key: str) -> float:
    """Score a word in a container before any page is seen."""
    tag, _, names = key.partition(".")
    if any(w == "hidden" or tells(w) for w in names.split()):
        return -4.0
    return PRIOR_TAG.get(tag, 0.0)


@dataclass
class Weights:
    """word and tag: base scores; landmark: what an <article> or <main> says; context: what the containers that were seen add to a word; tags: the tags that were seen."""

    word: float = 1.0
    tag: float = -1.0
    landmark: float = LANDMARK_MOST
    context: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def of(self, key: str) -> float:
        return self.context[key] if key in self.context else prior(key)

    def scores(self, page: Page) -> list[float]:
        """Score of a word by the number of its container: the base, or the lowest of all around it, each of which is looked up once."""
        worst, known = [0.0] * len(page.keys), {}
        for i in range(1, len(page.keys)):
            key = page.keys[i]
            if key not in known:
                known[key] = self.of(key) if key else 0.0
            own = known[key]
            if i in page.free:
                own = min(0.0, PRIOR_TAG[tag]) if key and (tag := key.partition(".")[0]) in ("nav", "aside", "footer") else 0.0
            worst[i] = min(worst[page.parents[i]], own)
        return [self.word if w >= 0 else w for w in worst]


def count(source: str) -> Counter | None:
    """Words and tags inside and outside of the content of a labelled page, by container; None if it has no label."""
    page = parse(source)
    if page.landmarks != 1:
        return None
    c: Counter = Counter()
    for p in page.pieces:
        n = 1 if p.text is None else len(p.text.split())
        c["tag" if p.text is None else "word", bool(p.inside)] += n
        if p.text is None:
            c["<" + p.tag, bool(p.inside)] += 1
        if p.text is not None and n:
            # Words in a container that speaks for itself are explained by it, and say nothing of the others around them.
            keys = page.around(p.context, FIT_CONTEXTS)
            spoken = {k for k in keys if prior(k) < 0}
            if not spoken:
                c["plain", bool(p.inside)] += n
            for k in spoken or keys:
                c[k, bool(p.inside)] += n
    return c


def fit(counts: dict[tuple[str, bool], int]) -> Weights:
    """Log odds of being content, a word or a tag; of a container, if the pages say more than the prior does."""
    words = counts.get(("word", True), 0) + 1, counts.get(("word", False), 0) + 1
    tags = counts.get(("tag", True), 0) + 1, counts.get(("tag", False), 0) + 1
    share = math.log(words[0] / sum(words)) - math.log(tags[0] / sum(tags))
    w = Weights(tag=-max(0.5, min(3.0, 1.0 + share)))
    # Log odds of a word that no container speaks of, from LANDMARK_MOST before any page is seen.
    w.landmark = max(0.0, min(LANDMARK_MOST, math.log((counts.get(("plain", True), 0) + math.exp(LANDMARK_MOST)) / (counts.get(("plain", False), 0) + 1))))
    for key in {k for k, _ in counts if k not in ("word", "tag", "plain")}:
        inside, outside = counts.get((key, True), 0), counts.get((key, False), 0)
        if key[0] == "<":
            w.tags[key[1:]] = max(-3.0, min(0.0, math.log((inside + 0.5) / (outside + 0.5))))
            continue
        if key in NEUTRAL:
            w.context[key] = 0.0
            continue
        odds = math.log((inside + 0.5) / (outside + 0.5)) - math.log(words[0] / words[1])
        # What the markup says of itself stands against its place: an advert inside of an article is one still.
        w.context[key] = min(prior(key), max(-4.0, min(0.0, odds)) if inside < outside else 0.0)
    return w


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run of the largest sum, the first of equal ones; (0, 0) if none is positive."""
    best, span, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, span = total, (begin, i + 1)
    return span


def worths(page: Page, scores: list[float], weights: Weights) -> list[float]:
    """What each piece adds to a region."""
    pieces, worth, spent = page.pieces, [], 0.0
    edge, side = 0, None
    for i, p in enumerate(pieces):
        word = scores[p.context]
        if word < 0:
            # A whole run of such words costs INSET_COST at most, so that an inset does not cut the content in two.
            cost = min(0.0, word + weights.landmark) if p.inside else word
            s = 0.0 if p.text is None else max(cost * len(p.text.split()), spent - INSET_COST)
            spent -= s
            spent = min(spent, INSET_COST)
        elif p.text is None:
            s = weights.tags.get(p.tag, weights.tag)
            if p.inside or side:  # also between neighbouring landmarks
                s = min(0.0, s + weights.landmark)
        else:
            s = word * len(p.text.split())
            spent = 0.0 if s else spent
        worth.append(s)
        # The landmark's own tag, which is outside of it, bears the cost of going on from words on one side to words on the other.
        if i and bool(p.inside) != bool(pieces[i - 1].inside):
            edge = i - 1 if p.inside else i
        if s > 0 and side != bool(p.inside):
            if side is not None:
                worth[edge] -= weights.landmark * EDGE_WORDS
            side = bool(p.inside)
    return worth


def written(pieces: list[Piece], scores: list[float]) -> str:
    """Blocks of a region, without what stands in containers of negative weight."""
    blocks: list[str] = []
    last = None
    for p in pieces:
        if p.text is None or scores[p.context] < 0:
            continue
        if p.block != last:
            blocks.append("")
            last = p.block
        blocks[-1] += p.text
    clean = (_SPACE.sub(" ", b).strip() for b in blocks)
    return "\n".join(b for b in clean if b)


def extract(source: str | None, weights: Weights) -> str:
    if not source:
        return ""
    page = parse(source)
    scores = weights.scores(page)
    begin, end = best_region(worths(page, scores, weights))
    return written(page.pieces[begin:end], scores)


def fit_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = MAX_PAGES) -> Weights:
    n = pages.count()
    some = pages.select(F.col(id_col).alias("i"), F.col(html_col).alias("h")).filter(F.col("h").isNotNull())
    if n > max_pages:
        some = some.filter(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < int((1 << 20) * max_pages / n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for h in b.h:
                total.update(count(h) or {})
        yield pd.DataFrame([(k, i, v) for (k, i), v in total.items()], columns=["k", "inside", "v"]).astype({"k": str, "inside": bool, "v": "int64"})

    # Containers that occur in the sample; the thousand most frequent decide.
    rows = some.select("h").mapInPandas(run, "k string, inside boolean, v bigint").groupBy("k", "inside").agg(F.sum("v").alias("v")).orderBy(F.desc("v"), "k", "inside").limit(2000).collect()
    return fit({(r.k, r.inside): r.v for r in rows})


def extract_pages(pages: DataFrame, weights: Weights, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([extract(h, weights) for h in b], dtype=object)

    bound_batches(pages.sparkSession)
    out = pages.withColumn("text", F.pandas_udf(run, "string")(F.coalesce(F.col(html_col), F.lit(""))))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
