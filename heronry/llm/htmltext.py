"""Operator 4: main text of web pages by two passes of block rules.

Markup is read into blocks: stretches of text between block-level tags, each with its length, the share of its
characters in links, the share of stop words, and the containers it is in. Blocks that aren't made of links and
follow one another are a run, whatever their lengths. Pass one decides what the rules can: blocks made of links are
bad, blocks with enough stop words are good if their run is long with enough stop words, or the page's longest that
has them, so a page of short paragraphs, or a short page, has its text too. On a page of a language whose stop words
aren't known, length and links decide. Pass two gives the rest, short or in doubt, the label of the nearest decided
neighbours.

Containers set the ends of that search. Menus, footers, asides and the like are bad by element, or by a name: a
class, id or role whose parts all say so. A name doesn't hold where the container has most of the page's text, but
for comments; theirs do, unless nothing else is there. An article element's edges count as good neighbours and what is
outside of it is bad, unless more good text stands outside than the article has in all (a teaser); without one the
page's edges are bad neighbours.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names. The text of the first is never read; those of the second are left out of a block.
RAW = frozenset("script style noscript title textarea iframe noembed noframes xmp".split())
LEFT_OUT = frozenset("svg template object canvas select datalist button audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_CONTAINERS = frozenset("nav footer aside menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a block's text themselves: for these only a whole class or role counts as a name.
TEXT_BLOCKS = HEADINGS | frozenset("p li pre blockquote td th dd dt figcaption caption summary".split())
#: Closed by the start of a block, as their end tags may be left out.
IMPLIED = {"li": ("li", "p"), "p": ("p",), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "option": ("option",)}
# Words in class, id and role of what isn't the article.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar sidebars widget widgets footer masthead topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "signup login comment comments commentlist respond disqus replies share sharing social related recommended pagination pager copyright complementary "
    "contentinfo".split()
)
# Those that say what readers wrote; parts of a name that say nothing by themselves.
READERS = frozenset("comment comments commentlist respond disqus replies".split())
NEUTRAL = frozenset(
    "top bottom left right side main page site post article blog user reader global primary secondary first last new "
    "list lists item items box boxes area block wrap wrapper container section panel group row col column inner outer holder bar strip slot unit "
    "header head title body text content message form button buttons link links icon icons image js".split()
)
# Frequent function words of some languages.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous "
    "aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur "
    "oder sich sie sind so über um und von vor war was wie wir zu zum zur "
    "al como con cuando del el ella en entre era es esta este ha hay la las lo los más me mi muy no nos o para pero por que se si sin sobre su sus también un una y ya "
    "alla anche che ci come da dal della delle di e gli ho il nel non più questo sono una "
    "ao com da das do dos e em foi mais mas na não os pela uma "
    "aan dat een het hij ik maar met niet ook te van voor wat zijn".split()
)
LINKS, STOPS_HIGH, STOPS_LOW, SHORT, LONG = 0.33, 0.30, 0.15, 70, 200
#: Named containers in one another that are told apart; those further in go with the last of them.
MOST_NAMED = 16

RAW_END = {name: re.compile(f"</{name}(?![a-z0-9])", re.I) for name in RAW}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTED = re.compile(r"=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPLIT = re.compile(r"[\s_]+|-")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")
WIDE = re.compile("[⺀-\U0010ffff]")


@dataclass
class Block:
    text: str
    linked: int
    bad: bool
    article: int
    heading: bool
    form: int
    #: Named containers around it, the outermost first; whether a name says that readers wrote it.
    named: tuple[int, ...]
    readers: bool

    def measured(self) -> None:
        """Length, an ideograph as three characters, the share of links, and the number of words and of stop words."""
        wide = 0 if self.text.isascii() else len(WIDE.findall(self.text))
        self.size = len(self.text) + 2 * wide
        self.links = self.linked / len(self.text)
        words = [w.lower() for w in WORD.findall(self.text)]
        self.words, self.stopped = len(words), sum(w in STOP_WORDS for w in words)
        self.stops = self.stopped / self.words if self.words else 0.0


@dataclass
class Run:
    """Blocks that follow one another, but for those that are bad by their container."""

    size: int = 0
    words: int = 0
    stopped: int = 0
    decided: bool = False

    def add(self, b: Block) -> None:
        self.size, self.words, self.stopped = self.size + b.size, self.words + b.words, self.stopped + b.stopped

    @property
    def stops(self) -> float:
        return self.stopped / self.words if self.words else 0.0


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('', text, ''), ('<', name, attributes) and ('/', name, ''). A quote ends a value only after an equals sign; one
    that is never closed is none. What is cut off at the page's end is a tag, not text. Elements of LEFT_OUT that
    aren't closed any more are marked as empty."""
    at, n, last_close = 0, len(page), {}
    none_from = {'"': n, "'": n}

    def tag_end(pos: int) -> int:
        while True:
            end = page.find(">", pos)
            if end < 0:
                return n
            m = QUOTED.search(page, pos, end)
            if not m:
                return end
            close = page.find(m[1], m.end()) if m.end() < none_from[m[1]] else -1
            if close < 0:
                none_from[m[1]] = min(none_from[m[1]], m.end())
                return end
            pos = close + 1

    while at < n:
        lt = page.find("<", at)
        if lt != at:
            yield "", page[at : lt if lt >= 0 else n], ""
        if lt < 0:
            return
        m = NAME.match(page, lt + 1)
        if m:
            name, end = m[0].lower(), tag_end(m.end())
            at = end + 1
            rest = page[m.end() : end]
            if name in LEFT_OUT and name not in last_close:
                last_close[name] = page.lower().rfind("</" + name)
            yield "<", name, "/" if at > last_close.get(name, n) else rest
            if name in RAW:
                if name not in last_close:
                    last_close[name] = page.lower().rfind("</" + name)
                close = RAW_END[name].search(page, at) if at <= last_close[name] else None
                if close:
                    at = close.start()
                elif name in ("script", "style"):
                    return
        elif page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = n if end < 0 else end + 3
        elif page.startswith("</", lt) and NAME.match(page, lt + 2):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            yield "/", NAME.match(page, lt + 2)[0].lower(), ""
        elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        else:
            yield "", "<", ""
            at = lt + 1


def is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(HIDDEN_STYLE.search(attributes.get("style", "")))


def names_of(name: str, attributes: dict[str, str]) -> set[str]:
    """The words of BAD_NAMES in an element's class, id and role that stand alone, or beside others of BAD_NAMES, NEUTRAL or
    numbers only: `cookie-notice`, `ad-2`, but neither `related-work` nor `with-sidebar`."""
    if name in ("article", "main", "body", "html"):
        return set()
    said = (attributes.get("class", "") + " " + attributes.get("role", "")).lower().split()
    if name in TEXT_BLOCKS:
        return BAD_NAMES.intersection(said)
    found: set[str] = set()
    for word in said + attributes.get("id", "").lower().split():
        parts = [p for p in SPLIT.split(word) if p]
        if all(p in BAD_NAMES or p in NEUTRAL or p.isdigit() for p in parts):
            found |= BAD_NAMES.intersection(parts)
    return found


def blocks(page: str) -> list[Block]:
    """Blocks of a page in its order. Tags may be unclosed, crossed or cut off."""
    out: list[Block] = []
    # name, bad, article, form, whether its text is left out, named containers, whether readers wrote it
    stack: list[tuple[str, bool, int, int, bool, tuple[int, ...], bool]] = []
    outside = ("", False, 0, 0, False, (), False)
    open_names: dict[str, int] = {}
    parts: list[str] = []
    linked, links, articles, forms, names = 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
        if text:
            _, bad, article, form, _, named, readers = stack[-1] if stack else outside
            out.append(Block(text, min(linked, len(text)), bad, article, any(s[0] in HEADINGS for s in stack[-3:]), form, named, readers))
        parts.clear()
        linked = 0

    def pop(name: str) -> None:
        while True:
            last = stack.pop()[0]
            open_names[last] -= 1
            if last == name:
                return

    for kind, name, rest in tokens(page):
        silent = bool(stack) and stack[-1][4]
        if not kind:
            if not silent:
                parts.append(name)
                if links:
                    linked += len(name.strip())
        elif name == "br" or name in RAW:
            parts.append(" ")
        elif name == "a":
            links = int(kind == "<")
        elif name in BLOCKS or name in LEFT_OUT:
            if name in LEFT_OUT:
                parts.append(" ")
            elif not silent or (kind == "/" and open_names.get(name)):
                flush()
                links = 0
            if kind == "/":
                if open_names.get(name):
                    pop(name)
            elif name not in VOID and not (name in LEFT_OUT and rest.endswith("/")):
                ends = IMPLIED.get(name, ("p",) if name in BLOCKS else ())
                while stack and stack[-1][0] in ends:
                    pop(stack[-1][0])
                _, bad, article, form, _, named, readers = stack[-1] if stack else outside
                attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)} if rest.strip() else {}
                bad = bad or name in BAD_CONTAINERS or (name == "header" and not article) or is_hidden(attributes)
                said = names_of(name, attributes) if attributes and not bad else set()
                if said and len(named) < MOST_NAMED:
                    names += 1
                    named, readers = (*named, names), readers or bool(said & READERS)
                if name in ("article", "main") and not article and not bad:
                    articles += 1
                    article = articles
                if name in ("form", "fieldset") and not form:
                    forms += 1
                    form = forms
                stack.append((name, bad, article, form, silent or name in LEFT_OUT, named, readers))
                open_names[name] = open_names.get(name, 0) + 1
    flush()
    return out


def contained(found: list[Block]) -> None:
    """Which blocks are bad by their named containers and forms: those that don't hold most of the text that readers
    didn't write, and readers' words beside other text."""
    free = [b for b in found if not b.bad and b.links <= LINKS]
    total, readers = sum(len(b.text) for b in free), sum(len(b.text) for b in free if b.readers)
    held: dict[int, int] = {}
    for b in free:
        for name in b.named if not b.readers else ():
            held[name] = held.get(name, 0) + len(b.text)
    least = max((total - readers) // 2 + 1, max(held.values(), default=0))
    for b in found:
        b.bad = b.bad or (readers < total if b.readers else any(held.get(name, 0) < least for name in b.named))
    total, forms = sum(len(b.text) for b in found if not b.bad), {}
    for b in found:
        if b.form and not b.bad:
            forms[b.form] = forms.get(b.form, 0) + len(b.text)
    for b in found:  # a form is none of the article's, unless the page is in it
        b.bad = b.bad or (b.form > 0 and 2 * forms.get(b.form, 0) <= total)


def runs_of(found: list[Block]) -> list[Run | None]:
    """The run that each block is in; none for bad blocks and blocks of links. An article's edge ends one, too."""
    out: list[Run | None] = []
    run, article = Run(), 0
    for b in found:
        linked = b.links > LINKS and not b.heading
        if not b.bad and (linked or b.article != article):
            run, article = Run(), b.article
        if b.bad or linked:
            out.append(None)
            continue
        run.add(b)
        out.append(run)
    return out


def labelled(found: list[Block]) -> list[str]:
    """Pass one: good, bad, near (in doubt) or short, for each block."""
    for b in found:
        b.measured()
    contained(found)
    run_of = runs_of(found)
    runs = list({id(r): r for r in run_of if r}.values())
    known = [r.stops >= STOPS_LOW for r in runs if r.size >= LONG] or [r.stops >= STOPS_LOW for r in runs]
    foreign = bool(known) and not any(known)
    dense = [r for r in runs if foreign or r.stops >= STOPS_LOW]
    longest = max((r.size for r in dense), default=0)
    for r in dense:
        r.decided = r.size >= min(LONG, longest)
    inside = sum(b.size for b in found if b.article and not b.bad and b.links <= LINKS)
    outside = sum(b.size for b in found if not b.article and not b.bad and b.links <= LINKS and b.size >= LONG and (foreign or b.stops >= STOPS_HIGH))
    articles = inside and inside >= outside
    out = []
    for b, run in zip(found, run_of, strict=True):
        if not articles:
            b.article = 0
        if b.bad or (articles and not b.article) or (b.links > LINKS and not (b.heading and (b.article or run.decided))) or ("\xa9" in b.text[:8] and not b.article):
            out.append("bad")
        elif b.size < SHORT or b.heading:
            out.append("near" if run.decided and not b.heading and b.stops >= STOPS_LOW else "short")
        elif foreign or b.stops >= (STOPS_LOW if run.decided else STOPS_HIGH):
            out.append("good" if run.decided or b.article else "near")
        else:
            out.append("near" if b.stops >= STOPS_LOW or run.decided or b.article else "bad")
    # A decided run of short blocks only has none that could speak for it.
    spoken = {id(r) for r, x in zip(run_of, out, strict=True) if r and x == "good"}
    return ["good" if x in ("short", "near") and not b.heading and r and r.decided and id(r) not in spoken else x for b, r, x in zip(found, run_of, out, strict=True)]


def classified(found: list[Block]) -> list[bool]:
    """Pass two: whether each block belongs to the main text. What is bad by its container inside an article isn't
    the neighbour of the article's blocks. One sweep from the left and one from the right."""
    labels = labelled(found)

    def swept(order: range) -> list[str]:
        out, scope, last = [""] * len(found), -1, "bad"
        for i in order:
            b = found[i]
            if b.article != scope:
                scope, last = b.article, "good" if b.article else "bad"
            out[i] = last
            if labels[i] in ("good", "bad") and not (b.bad and b.article):
                last = labels[i]
        return out

    left, right = swept(range(len(found))), swept(range(len(found) - 1, -1, -1))
    out = []
    for i, x in enumerate(labels):
        if x in ("good", "bad"):
            out.append(x == "good")
        elif left[i] == right[i]:
            out.append(left[i] == "good")
        else:  # between a good and a bad one: a heading goes with what follows, else only doubtful blocks stay
            out.append(right[i] == "good" if found[i].heading else x == "near")
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by two newlines; empty if there is none."""
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(found, classified(found), strict=True) if keep)


def extracted(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> (page_id, url, text, n_chars), a row for each row. A null html
    gives an empty text; ids and urls go through as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
