"""Main text of web pages by wrappers inferred from all pages of the same host.

A page is a stream of tags and text slots. The streams of a host's pages, all of them, are
folded into one union-free regular expression: pages of one shape are merged place by place,
and the shapes are aligned with each other, in rounds of small groups until one wrapper is
left; text that differs becomes a slot, stretches that only one side has become optional
groups, and stretches that repeat what stands before them become repeated groups. A slot
carries the text that may be in most pages, by a vote that adds up in any order.

A second pass over all pages counts which of these texts they hold at the same place, and how
much text every container holds. So the wrapper says which container of the host's template
holds the changing text, and which texts in it are template: nearly every page has them at
the same place, and three that are no copies of each other do. A page is read through it:
the blocks of the container are kept, those that the wrapper holds for template are not (a
heading only goes with what it heads). What tags and names mark as menu, header, footer,
notice, advert, form or comments goes too; a name is not believed of an element that holds
the page's article, nor if nothing else would be left.

A page that lacks its host's container is read by the container that it has itself.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher
from functools import partial
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutory.llm.common import materialize, same_rows, slices
from statutory.llm.lines import patience_pairs

#: Stretches of more symbols than this by this are aligned between anchors, texts and tags that both have once.
ALIGNED_SYMBOLS = 500
#: In longer wrappers, stretches that less than half the pages have are written as one optional group of anything.
WRAPPER_SYMBOLS = 1500
#: Shapes of a host that are folded at once; more are folded in rounds.
FOLD_SHAPES = 64
#: Share of a host's pages that must have a text at the same place for it to be template (over half, as slots carry the text of most pages).
TEMPLATE_SHARE = 0.9
#: Different pages that must have these texts.
TEMPLATE_PAGES = 3
#: A task adds up what it has found in so many entries before it hands them on.
HELD_ENTRIES = 50_000
#: The same of wrappers of shapes, and of characters of pages.
HELD_SHAPES = 2_000
HELD_CHARS = 16_000_000
#: Wrappers are broadcast up to this many characters, and joined by a shuffle beyond it.
BROADCAST_CHARS = 8_000_000

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe textarea title select button".split())
ASIDE = frozenset("nav header footer aside form dialog menu head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = frozenset(
    "address article blockquote body br center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
INLINE_FORMAT = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
MAIN_NAMES = frozenset("article main".split())
#: Share of the changing text from which an element of that name holds the main text, and one of another name.
NAMED, LARGE = (("article", 0.2), ("main", 0.2)), 0.8
CONTAINERS = frozenset("div section td body table".split())
# Words of classes, ids and roles. These name what is no main text wherever it stands.
STRONG = frozenset(
    "nav navbar navigation breadcrumb breadcrumbs sidebar comment comments commentlist replies respond ad ads advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal overlay subscribe newsletter signup login pagination pager toolbar widget sharing".split()
)
#: These may also name a part of the main text: inside an article they count for a list of links only.
WEAK = frozenset("menu header masthead banner footer aside related recommend recommended recommendations share social discussion copyright complementary contentinfo".split())
#: These say nothing by themselves.
NEUTRAL = frozenset("bar block bottom box buttons container content entry form group inner item items left link links list module outer page panel post posts articles stories reader readers right row section site stack thread top unit user users wrap wrapper".split())
#: Elements that a name alone never hides.
TEXTUAL = HEADINGS | frozenset("p table caption thead tbody tfoot tr td th blockquote pre figure figcaption li dl dt dd details summary article main".split())
#: Share of an element's text in links from which it is a list of links.
LINK_LIST = 0.5
#: Pages that share so much of their text are one page in copies, and prove nothing about the template.
COPIES = 0.8
_SKIPPED = re.compile(rf"<!--.*?(?:-->|$)|<({'|'.join(sorted(RAW))})\b[^>]*>.*?</\1\b[^>]*>|<(?:script|style|textarea|title)\b.*$|<[!?][^>]*>", re.S | re.I)
_TOKEN = re.compile(r"<(?:/?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|/?[a-zA-Z][^>]*(?:>|$))|[^<]+|<")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)(.*)$", re.S)
#: Tags whose reading a worker remembers.
CACHE_TAGS = 20_000
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


class Tag:
    """What a tag says: its name, whether it closes, its signature and its part in the page."""

    __slots__ = ("name", "closes", "signature", "aside", "marked", "weak", "breaks", "void")
    _known: dict[str, Tag] = {}

    def __init__(self, raw: str) -> None:
        slash, name, rest = _TAG.match(raw).groups()
        self.name = name.lower()
        self.closes = bool(slash)
        attributes = "" if slash else " ".join(f"{k.lower()}={v.strip(chr(34) + chr(39)).lower()}" for k, v in _ATTRIBUTE.findall(rest))
        self.signature = signature(self.name, attributes)
        self.aside = not slash and self.name in ASIDE
        self.marked, self.weak = (False, False) if slash else marks(self.name, attributes)
        self.breaks = self.name in BLOCK or self.name in ASIDE
        self.void = self.name in VOID or (rest.rstrip(">").endswith("/") and self.name not in BLOCK and self.name not in INLINE_FORMAT)

    @classmethod
    def of(cls, raw: str) -> Tag:
        found = cls._known.get(raw)
        if found is None:
            if len(cls._known) > CACHE_TAGS:
                cls._known.clear()
            found = cls._known[raw] = cls(raw)
        return found


def tokens(page: str) -> Iterator[str | Tag]:
    """Tags and texts in page order, without comments and elements whose content is no text."""
    for raw in _TOKEN.findall(_SKIPPED.sub("", page)):
        yield Tag.of(raw) if raw[0] == "<" and len(raw) > 1 else raw


def marks(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element's attributes say that it is no main text, and whether they only hint at it.

    A class or id counts if all its words are of the lists: comment-list does, social-policy doesn't.
    """
    if not attributes or name in ("html", "body"):
        return False, False
    if re.search(r"hidden=(?!false)|style=[^=]*display:\s*none", attributes.replace("aria-hidden=false", "")):
        return True, False
    if name in TEXTUAL:
        return False, False
    strong = weak = False
    for value in re.findall(r"\b(?:class|id|role)=(.*?)(?= \w[\w-]*=|$)", attributes):
        for token in value.split():
            words = [w for w in re.split(r"[^a-z]+", token) if w]
            if words and all(w in STRONG or w in WEAK or w in NEUTRAL for w in words):
                strong = strong or any(w in STRONG for w in words)
                weak = weak or any(w in WEAK for w in words)
    return strong, weak and not strong


def signature(name: str, attributes: str) -> str:
    """What names a container in the template: its tag and classes, digits folded."""
    return re.sub(r"\d+", "0", f"{name} {attributes}".strip())


class Slot(NamedTuple):
    """A text (None: a block break) and the open elements about it, with numbers that tell them apart."""

    text: str | None
    tags: tuple[Tag, ...]
    ids: tuple[int, ...]


def walk(page: str) -> Iterator[Slot]:
    """Texts and block breaks in page order.

    End tags close the nearest open element of their name; without one they are passed over.
    """
    path: list[Tag] = []
    numbers: list[int] = []
    count = 0
    tags: tuple[Tag, ...] = ()
    ids: tuple[int, ...] = ()
    for token in tokens(page):
        if isinstance(token, str):
            yield Slot(token, tags, ids)
            continue
        if token.breaks:
            yield Slot(None, tags, ids)
        name = token.name
        if not token.closes:
            if name in ("p", "li"):  # these end an open one of their kind without a tag
                for i in range(len(path) - 1, -1, -1):
                    if path[i].name == name:
                        del path[i:], numbers[i:]
                        break
                    if path[i].name not in INLINE_FORMAT and path[i].name != "p":
                        break
            if token.void:
                continue
            count += 1
            path.append(token)
            numbers.append(count)
        else:
            for i in range(len(path) - 1, -1, -1):
                if path[i].name == name:
                    del path[i:], numbers[i:]
                    break
                if path[i].name in MAIN_NAMES and name not in MAIN_NAMES and name not in ("body", "html"):
                    break  # a stray end tag does not leave the main text
            else:
                continue
        tags, ids = tuple(path), tuple(numbers)


def _tagged_aside(tags: tuple[Tag, ...]) -> bool:
    """Whether a tag about a text says that it is no main text; a header inside an article holds its title, a footer inside a quote its source."""
    main = quote = False
    for tag in tags:
        if tag.aside and not (main and tag.name == "header") and not (quote and tag.name == "footer"):
            return True
        main = main or tag.name in MAIN_NAMES
        quote = quote or tag.name in ("blockquote", "figure")
    return False


def visible(page: str) -> list[Slot]:
    """The slots of a page that nothing marks as no main text."""
    slots = list(walk(page))
    tagged: dict[tuple[int, ...], bool] = {}
    sizes: Counter[tuple[int, ...]] = Counter()  # by the path to an outermost article or main
    for text, tags, ids in slots:
        if ids not in tagged:
            tagged[ids] = _tagged_aside(tags)
        if text and not tagged[ids]:
            at = next((i for i, t in enumerate(tags) if t.name in MAIN_NAMES), None)
            if at is not None:
                sizes[ids[: at + 1]] += len(text.strip())
    spared = set(max(sizes, key=lambda x: (sizes[x], x))) if sizes else set()  # what holds the main text is never hidden
    kept = [x for x in slots if not tagged[x.ids]]
    hinted: Counter[int] = Counter()  # text of the elements that a name hints at, and what of it is in links
    linked: Counter[int] = Counter()
    for text, tags, ids in kept:
        if text and any(t.weak for t in tags):
            size, link = len("".join(text.split())), any(t.name == "a" for t in tags)
            for t, i in zip(tags, ids, strict=True):
                if t.weak:
                    hinted[i] += size
                    linked[i] += size * link

    def hides(at: int, tags: tuple[Tag, ...], ids: tuple[int, ...]) -> bool:
        if ids[at] in spared:
            return False
        if tags[at].marked or not tags[at].weak:
            return tags[at].marked
        main = any(t.name in MAIN_NAMES for t in tags[:at])
        return not main or (hinted[ids[at]] > 0 and linked[ids[at]] >= LINK_LIST * hinted[ids[at]])

    marked: dict[tuple[int, ...], bool] = {}
    for _, tags, ids in kept:
        if ids not in marked:
            marked[ids] = any(hides(at, tags, ids) for at in range(len(tags)))
    clear = [x for x in kept if not marked[x.ids]]
    return clear if any(x.text and x.text.strip() for x in clear) else kept


def stream(page: str) -> list[str]:
    """A page as the symbols that are aligned: tags by their signature, and text slots."""
    out: list[str] = []
    for token in tokens(page):
        if isinstance(token, str):
            if token.strip():
                out.append(f"#{' '.join(token.split())}")
        elif token.name not in INLINE_FORMAT:
            out.append(f"<{'/' if token.closes else ''}{token.signature}>")
    return out


def whole(symbols: list[str]) -> bool:
    """Whether symbols open all elements that they close, and begin with one."""
    open_ = 0
    for s in symbols:
        open_ += -1 if s.startswith("</") else s.startswith("<")
        if open_ < 0:
            return False
    return symbols[0].startswith("<")


def shape_of(symbols: list[str]) -> list[str]:
    return ["#" if s.startswith("#") else s for s in symbols]


MARKS = ("", "+", "?")
Stretch = tuple[bool, int, int, int, int]


def _matched(a: list[str], b: list[str]) -> Iterator[Stretch]:
    for op, *ends in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        yield op == "equal", *ends


def aligned(a: list[str], b: list[str]) -> Iterator[Stretch]:
    """Stretches of two streams: whether they are alike but for the texts, and their ends on both sides."""
    mine, theirs = shape_of(a), shape_of(b)
    if len(a) * len(b) <= ALIGNED_SYMBOLS**2:
        yield from _matched(mine, theirs)
        return
    i = j = 0
    for x, y in [*patience_pairs(a, b), (len(a), len(b))]:
        if x > i or y > j:
            if (x - i) * (y - j) <= ALIGNED_SYMBOLS**2:
                for same, p, q, r, s in _matched(mine[i:x], theirs[j:y]):
                    yield same, i + p, i + q, j + r, j + s
            else:
                yield False, i, x, j, y
        if x < len(a):
            yield True, x, x + 1, y, y + 1
        i, j = x + 1, y + 1


def elected(one: str, votes: int, other: str, others: int) -> tuple[str, int]:
    """The text that may be in more than half of the pages of both sides, and by how many votes; a text that is in more stays in any order."""
    if one == other:
        return one, votes + others
    if votes == others:
        return "#", 0
    return (one, votes - others) if votes > others else (other, others - votes)


class Wrapper:
    """A union-free expression: symbols with marks (plain, optional "?" or repeated "+"); "#" is a text slot.

    Of every symbol it tells how many of its pages have it, and of a text by how many votes it leads. "*" is anything.
    """

    def __init__(self, symbols: list[str], marks: list[str] | None = None, counts: list[int] | None = None, votes: list[int] | None = None, pages: int = 1) -> None:
        self.symbols = symbols
        self.marks = [""] * len(symbols) if marks is None else marks
        self.counts = [pages] * len(symbols) if counts is None else counts
        self.votes = [pages * (len(s) > 1 and s.startswith("#")) for s in symbols] if votes is None else votes
        self.pages = pages

    def merge(self, other: Wrapper) -> None:
        """Take in a wrapper of the same shape."""
        for i, symbol in enumerate(other.symbols):
            self.symbols[i], self.votes[i] = elected(self.symbols[i], self.votes[i], symbol, other.votes[i])
            self.marks[i] = max(self.marks[i], other.marks[i], key=MARKS.index)
            self.counts[i] += other.counts[i]
        self.pages += other.pages

    def fold(self, other: Wrapper) -> Wrapper:
        """Align with a further one and generalise where they differ."""
        out = Wrapper([], pages=self.pages + other.pages)
        for same, a, b, c, d in aligned(self.symbols, other.symbols):
            if same:
                for i, j in zip(range(a, b), range(c, d), strict=True):
                    symbol, votes = elected(self.symbols[i], self.votes[i], other.symbols[j], other.votes[j])
                    out.symbols.append(symbol)
                    out.votes.append(votes)
                    out.marks.append(max(self.marks[i], other.marks[j], key=MARKS.index))
                    out.counts.append(self.counts[i] + other.counts[j])
                continue
            for side, start, end in ((self, a, b), (other, c, d)):
                size = end - start
                if not size:
                    continue
                if size > 1 and shape_of(out.symbols[-size:]) == shape_of(side.symbols[start:end]):  # once more what stands before: a repeated group
                    out.marks[-size:] = ["+"] * size
                else:
                    out.symbols += side.symbols[start:end]
                    out.marks += ["?"] * size
                    out.counts += side.counts[start:end]
                    out.votes += side.votes[start:end]
        return out.narrowed()

    def narrowed(self) -> Wrapper:
        """A long one without what less than half of the pages have; so it is at most twice as long as its pages are in the mean.

        A text that most pages of the host have is in most pages of one of the sides of every fold, and so is never lost.
        """
        if len(self.symbols) <= WRAPPER_SYMBOLS:
            return self
        out = Wrapper([], pages=self.pages)
        for symbol, mark, count, votes in zip(self.symbols, self.marks, self.counts, self.votes, strict=True):
            if symbol == "*" or 2 * count < self.pages:
                if out.symbols[-1:] == ["*"]:
                    continue
                symbol, mark, count, votes = "*", "?", 0, 0
            out.symbols.append(symbol)
            out.marks.append(mark)
            out.counts.append(count)
            out.votes.append(votes)
        return out

    def squeezed(self) -> Wrapper:
        """Neighbouring equal stretches of up to four symbols, whole elements, become one repeated group."""
        symbols = self.symbols
        out = Wrapper([], pages=self.pages)
        i = 0
        while i < len(symbols):
            for size in (2, 3, 4):
                shape = shape_of(symbols[i : i + size])
                if len(shape) == size and whole(shape) and shape == shape_of(out.symbols[-size:]):
                    out.symbols[-size:], out.marks[-size:], out.votes[-size:] = shape, ["+"] * size, [0] * size
                    i += size
                    break
            else:
                out.symbols.append(symbols[i])
                out.marks.append(self.marks[i])
                out.counts.append(self.counts[i])
                out.votes.append(self.votes[i])
                i += 1
        return out

    def template_texts(self) -> list[str]:
        """Texts that all pages share."""
        return [s[1:] for s, votes in zip(self.symbols, self.votes, strict=True) if len(s) > 1 and s.startswith("#") and votes == self.pages]

    def candidates(self) -> list[str]:
        """Texts that may be in most pages; every one that the alignment puts at one place of most pages is among them."""
        return sorted({s[1:] for s in self.symbols if len(s) > 1 and s.startswith("#")})

    def __str__(self) -> str:
        return " ".join(f"{'#text' if s.startswith('#') else s}{m}" for s, m in zip(self.symbols, self.marks, strict=True))


def slot_key(tags: Iterable[Tag], text: str) -> str:
    """A text and its place: the open elements about it."""
    return "\t".join([*(t.signature for t in tags if t.name not in INLINE_FORMAT), text])


def page_wrapper(page: str) -> Wrapper:
    return Wrapper(stream(page)).squeezed()


def fold_all(found: Iterable[Wrapper]) -> Wrapper:
    """One wrapper of many: those of one shape are merged, then the shapes folded in, shortest first."""
    by_shape: dict[tuple[str, ...], Wrapper] = {}
    for one in found:
        shape = tuple(shape_of(one.symbols))
        if shape in by_shape:
            by_shape[shape].merge(one)
        else:
            by_shape[shape] = one
    wrapper = None
    for _, one in sorted(by_shape.items(), key=lambda x: (len(x[0]), x[0])):
        wrapper = one if wrapper is None else wrapper.fold(one)
    return Wrapper([]) if wrapper is None else wrapper.squeezed()


def infer(pages: list[str]) -> Wrapper:
    """The wrapper of pages of one host."""
    return fold_all(map(page_wrapper, pages))


def main_container(pages: list[str], shared: set[str]) -> str | None:
    """The template's container of main text: article or main where the template has one, else the deepest that holds most of the changing text."""
    inside: Counter[str] = Counter()
    depth: dict[str, int] = {}
    total = 0
    for page in pages:
        for text, tags, _ in visible(page):
            text = " ".join((text or "").split())
            if not text or text in shared:
                continue
            total += len(text)
            for s, at in {t.signature: i for i, t in enumerate(tags)}.items():
                inside[s] += len(text)
                depth[s] = max(at, depth.get(s, 0))
    return chosen_container(inside, depth, total)


def chosen_container(inside: Counter[str], depth: dict[str, int], total: int) -> str | None:
    if not total:
        return None
    for name, share in NAMED:
        named = [s for s in inside if s.split(" ")[0] == name and inside[s] >= share * total]
        if named:
            return max(named, key=lambda s: (inside[s], s))
    large = [s for s in inside if inside[s] >= LARGE * total and s.split(" ")[0] in CONTAINERS]
    return min(large, key=lambda s: (inside[s], -depth[s], s)) if large else None  # the deepest holds least


def without_template(blocks: list[tuple[str, bool, bool]]) -> list[str]:
    """Texts of blocks (text, whether it is template, whether it is a heading) without the template ones.

    A template heading stays if a block that stays follows it.
    """
    kept: list[str] = []
    follows = False
    for text, template, heading in reversed(blocks):
        if not template or (heading and follows):
            kept.append(text)
        follows = not template or (heading and follows)
    return kept[::-1]


def main_text(page: str, container: str | None, template: frozenset[str] = frozenset()) -> str:
    """The blocks of the container, or of the whole page if it has none of that name, without template ones."""
    slots = visible(page)
    if container is not None and not any(x.text and x.text.strip() and any(t.signature == container for t in x.tags) for x in slots):
        container = main_container([page], set())
    blocks: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    known: list[bool] = []
    headings: list[bool] = []

    def close() -> None:
        text = " ".join(references.unescape("".join(held)).split())
        if text:
            blocks.append((text, bool(known) and all(known), bool(headings) and all(headings)))
        held.clear()
        known.clear()
        headings.clear()

    for text, tags, _ in slots:
        if text is None:
            close()
        elif container is None or any(t.signature == container for t in tags):
            held.append(text)
            if template and text.strip():
                known.append(slot_key(tags, " ".join(text.split())) in template)
                headings.append(any(t.name in HEADINGS for t in tags))
    close()
    return "\n".join(without_template(blocks))


def host_of(url: str | Column) -> Column:
    column = F.col(url) if isinstance(url, str) else url
    return F.lower(F.coalesce(F.regexp_extract(column, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


class Tally:
    """What pages hold, by host: how many they are, characters inside every kind of element, and the pages and places of candidate texts."""

    def __init__(self) -> None:
        self.found: dict[tuple[str, str, str], list[int]] = {}

    def _add(self, host: str, kind: str, name: str, n: int, places: int = 0, depth: int = 0) -> None:
        entry = self.found.setdefault((host, kind, name), [0, 0, 0])
        entry[0] += n
        entry[1] += places
        entry[2] = max(entry[2], depth)

    def add(self, host: str, page: str, candidates: frozenset[str]) -> None:
        total = 0
        inside: Counter[str] = Counter()
        depth: dict[str, int] = {}
        held: Counter[str] = Counter()
        for text, tags, _ in visible(page):
            text = " ".join((text or "").split())
            if not text:
                continue
            total += len(text)
            for s, at in {t.signature: i for i, t in enumerate(tags) if t.name in CONTAINERS or t.name in MAIN_NAMES}.items():
                inside[s] += len(text)
                depth[s] = max(at, depth.get(s, 0))
            if text in candidates:
                held[slot_key(tags, text)] += 1
        self._add(host, "pages", "", 1)
        self._add(host, "total", "", total)
        for s, n in inside.items():
            self._add(host, "inside", s, n, depth=depth[s])
        for key, n in held.items():
            self._add(host, "text", key, 1, n)

    def rows(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist([{"host": h, "kind": k, "name": x, "n": n, "places": p, "depth": d} for (h, k, x), (n, p, d) in self.found.items()], schema=TALLY)
        self.found.clear()
        return out


TALLY = pa.schema([("host", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("n", pa.int64()), ("places", pa.int64()), ("depth", pa.int64())])


def decided(tally: Iterable[tuple[str, str, int, int, int]]) -> tuple[str | None, list[str]]:
    """A host's container by its tally (kind, name, n, places, depth), and the texts in it that TEMPLATE_SHARE of the pages have at the same place.

    The container is the one of the changing text, or of all text where nothing changes.
    """
    rows = list(tally)
    pages = sum(n for kind, _, n, _, _ in rows if kind == "pages")
    total = sum(n for kind, _, n, _, _ in rows if kind == "total")
    inside = Counter({name: n for kind, name, n, _, _ in rows if kind == "inside"})
    depth = {name: d for kind, name, _, _, d in rows if kind == "inside"}
    shared = {name: places for kind, name, n, places, _ in rows if kind == "text" and pages > 1 and n >= TEMPLATE_SHARE * pages}
    sizes = {key: places * len(key.rsplit("\t", 1)[-1]) for key, places in shared.items()}
    if sum(sizes.values()) < total:
        total -= sum(sizes.values())
        for key, size in sizes.items():
            for s in set(key.split("\t")[:-1]) & inside.keys():
                inside[s] -= size
    container = chosen_container(inside, depth, total)
    return container, sorted(x for x in shared if container is None or container in x.split("\t")[:-1])


def pieces(page: str) -> tuple[Counter[str], set[str]]:
    """Characters of every visible text of a page, and all texts with their places."""
    sizes: Counter[str] = Counter()
    keys: set[str] = set()
    for text, tags, _ in visible(page):
        if text and text.strip():
            joined = " ".join(text.split())
            sizes[joined] += len(text)
            keys.add(slot_key(tags, joined))
    return sizes, keys


def apart(own: Counter[str], others: Iterable[Counter[str]]) -> bool:
    """Whether a page is no copy of any of the others: it shares less than COPIES of its text or theirs."""
    total = sum(own.values())
    return all(sum((own & other).values()) < COPIES * max(total, sum(other.values()), 1) for other in others)


def order(page: str) -> str:
    """The order in which pages are asked whether they are copies of those before."""
    return hashlib.md5(page.encode("utf-8", "surrogatepass")).hexdigest()


def proven(pages: Iterable[str], template: list[str]) -> list[str]:
    """The template, if TEMPLATE_PAGES pages that have all of it are no copies of each other; else nothing."""
    leaders: list[Counter[str]] = []
    for page in sorted(pages, key=order) if template else ():
        own, keys = pieces(page)
        if keys.issuperset(template) and apart(own, leaders):
            leaders.append(own)
            if len(leaders) == TEMPLATE_PAGES:
                return template
    return []


def _infer_host(frame: pd.DataFrame) -> pd.DataFrame:
    """The rule of one host whose pages are all in memory; wrappers() gives the same for any number of pages."""
    host, pages = frame["host"].iloc[0], list(frame["html"])
    wrapper = infer(pages)
    tally = Tally()
    for page in pages:
        tally.add(host, page, frozenset(wrapper.candidates()))
    container, template = decided((kind, name, *counts) for (_, kind, name), counts in tally.found.items())
    return pd.DataFrame({"host": [host], "wrapper": [str(wrapper)], "container": [container], "template": [proven(pages, template)]})


SHAPE = pa.schema(
    [("host", pa.string()), ("shape", pa.string()), ("symbols", pa.list_(pa.string())), ("marks", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("votes", pa.list_(pa.int64())), ("pages", pa.int64())]
)
SHAPE_SQL = "host string, shape string, symbols array<string>, marks array<string>, counts array<bigint>, votes array<bigint>, pages bigint"


def _shape_rows(found: Iterable[tuple[str, Wrapper]]) -> pa.RecordBatch:
    rows = [
        {"host": host, "shape": order("\n".join(shape_of(w.symbols))), "symbols": w.symbols, "marks": w.marks, "counts": w.counts, "votes": w.votes, "pages": w.pages}
        for host, w in found
    ]
    return pa.RecordBatch.from_pylist(rows, schema=SHAPE)


def _page_shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrappers of all pages, those of one host and shape merged."""
    held: dict[tuple[str, tuple[str, ...]], Wrapper] = {}
    chars = 0
    for batch in slices(batches, "html"):
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            one = page_wrapper(page)
            key = host, tuple(shape_of(one.symbols))
            if key in held:
                held[key].merge(one)
                continue
            held[key] = one
            chars += len(page)
            if len(held) >= HELD_SHAPES or chars > HELD_CHARS:
                yield _shape_rows((host, w) for (host, _), w in held.items())
                held.clear()
                chars = 0
    yield _shape_rows((host, w) for (host, _), w in held.items())


def _fold_group(group: pa.Table) -> pa.Table:
    found = [Wrapper(r["symbols"], r["marks"], r["counts"], r["votes"], r["pages"]) for r in group.to_pylist()]
    return pa.Table.from_batches([_shape_rows([(group.column("host")[0].as_py(), fold_all(found))])])


def _host_wrappers(rows: DataFrame) -> DataFrame:
    """One folded wrapper of every host: pages of one shape are merged, then the shapes of a host folded in rounds, FOLD_SHAPES at once."""
    found = materialize(rows.mapInArrow(_page_shapes, SHAPE_SQL).groupBy("host", "shape").applyInArrow(_fold_group, SHAPE_SQL))
    while True:
        sizes = found.groupBy("host").agg(F.count("*").alias("_shapes"))
        if (sizes.agg(F.max("_shapes")).first()[0] or 0) <= 1:
            return found
        group = F.pmod(F.xxhash64("shape"), F.ceil(F.col("_shapes") / FOLD_SHAPES)).alias("_group")
        found = materialize(found.join(sizes, "host").select(*SHAPE.names, group).groupBy("host", "_group").applyInArrow(_fold_rows, SHAPE_SQL))


def _fold_rows(group: pa.Table) -> pa.Table:
    return _fold_group(group.select(SHAPE.names))


Ruled = Iterator[tuple[pa.RecordBatch, Iterable[tuple | None]]]


def _joined(names: list[str], prepare: Callable[..., tuple], work: Callable[[Ruled], Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def ruled() -> Ruled:
        for batch in slices(batches, "html"):
            rules = zip(*(batch.column(f"_{n}").to_pylist() for n in names), strict=True)
            yield batch, [prepare(*rule) if known else None for known, rule in zip(batch.column("_known").to_pylist(), rules, strict=True)]

    return work(ruled())


def _held(held: Broadcast[dict[str, tuple]], work: Callable[[Ruled], Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return work((batch, map(held.value.get, batch.column("host").to_pylist())) for batch in slices(batches, "html"))


def _beside_rules(rows: DataFrame, rules: DataFrame, names: list[str], prepare: Callable[..., tuple], work: Callable[[Ruled], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work over the rows and what rules has for their hosts: held by every worker once where it is of a bounded size, else joined to the rows."""
    size = rules.agg(F.sum(F.length(F.to_json(F.struct("host", *names))))).first()[0] or 0
    if size > BROADCAST_CHARS:
        known = rules.select("host", *(F.col(n).alias(f"_{n}") for n in names), F.lit(True).alias("_known"))
        return rows.join(known, "host", "left").mapInArrow(partial(_joined, names, prepare, work), schema)
    held = {r.host: prepare(*(r[n] for n in names)) for r in rules.select("host", *names).collect()}  # BROADCAST_CHARS at most
    return rows.mapInArrow(partial(_held, rows.sparkSession.sparkContext.broadcast(held), work), schema)


def _texts_of(symbols: list[str]) -> tuple[frozenset[str]]:
    return (frozenset(Wrapper(symbols).candidates()),)


def _tallies(ruled: Ruled) -> Iterator[pa.RecordBatch]:
    tally = Tally()
    for batch, rules in ruled:
        for host, page, rule in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), rules, strict=True):
            tally.add(host, page, rule[0])
            if len(tally.found) >= HELD_ENTRIES:
                yield tally.rows()
    yield tally.rows()


def _decide(group: pa.Table) -> pa.Table:
    columns = (group.column(c).to_pylist() for c in ("kind", "name", "n", "places", "depth"))
    container, template = decided(zip(*columns, strict=True))
    return pa.table({"host": group.column("host").slice(0, 1), "container": pa.array([container], pa.string()), "template": pa.array([template], pa.list_(pa.string()))})


def _decisions(rows: DataFrame, folded: DataFrame) -> DataFrame:
    """host, container and template, not yet proven, by counts over all pages."""
    tallies = _beside_rules(rows, folded, ["symbols"], _texts_of, _tallies, "host string, kind string, name string, n bigint, places bigint, depth bigint")
    sums = materialize(tallies.groupBy("host", "kind", "name").agg(F.sum("n").alias("n"), F.sum("places").alias("places"), F.max("depth").alias("depth")))
    pages = sums.where("kind = 'pages'").select("host", F.col("n").alias("_pages"))
    texts = sums.where("kind = 'text'").join(pages, "host").where(F.col("n") >= TEMPLATE_SHARE * F.col("_pages")).drop("_pages")
    gone = texts.groupBy("host").agg(F.sum(F.col("places") * F.length(F.substring_index("name", "\t", -1))).alias("_gone"))
    totals = sums.where("kind = 'total'").select("host", F.col("n").alias("_total")).join(gone, "host", "left")
    changing = F.when(F.col("_gone") < F.col("_total"), F.col("_total") - F.col("_gone")).otherwise(F.col("_total"))
    least = min(share for _, share in NAMED)  # what holds less of the changing text is no container
    inside = sums.where("kind = 'inside'").join(totals.select("host", changing.alias("_changing")), "host").where(F.col("n") >= least * F.col("_changing")).drop("_changing")
    few = sums.where("kind in ('pages', 'total')").unionByName(texts).unionByName(inside)
    return few.groupBy("host").applyInArrow(_decide, "host string, container string, template array<string>")


def _claims(template: list[str], leaders: list[str]) -> tuple[frozenset[str], list[Counter[str]]]:
    return frozenset(template), [pieces(page)[0] for page in leaders]


def _next_leaders(ruled: Ruled) -> Iterator[pa.RecordBatch]:
    """Of every host the first page that has all its template and is no copy of its leaders."""
    best: dict[str, tuple[str, str]] = {}
    chars = 0

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist([{"host": h, "first": {"place": place, "html": page}} for h, (place, page) in best.items()], schema=LEADER)
        best.clear()
        return out

    for batch, rules in ruled:
        for host, page, rule in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), rules, strict=True):
            if rule is None:
                continue
            place = order(page)
            if host in best and best[host][0] <= place:
                continue
            own, keys = pieces(page)
            if keys >= rule[0] and apart(own, rule[1]):
                best[host] = place, page
                chars += len(page)
                if chars > HELD_CHARS:
                    yield rows()
                    chars = 0
    yield rows()


LEADER = pa.schema([("host", pa.string()), ("first", pa.struct([("place", pa.string()), ("html", pa.string())]))])


def _proven_hosts(rows: DataFrame, decisions: DataFrame) -> DataFrame | None:
    """Hosts of which TEMPLATE_PAGES pages that have all of the template are no copies of each other; None if there are none."""
    left = decisions.where(F.size("template") > 0).select("host", "template", F.array().cast("array<string>").alias("leaders"))
    for _ in range(TEMPLATE_PAGES):
        if left.isEmpty():
            return None
        found = _beside_rules(rows, left, ["template", "leaders"], _claims, _next_leaders, "host string, first struct<place: string, html: string>")
        found = found.groupBy("host").agg(F.min("first")["html"].alias("_next"))
        left = materialize(left.join(found, "host").select("host", "template", F.array_append("leaders", F.col("_next")).alias("leaders")))
    return left.select("host", F.lit(True).alias("_proven"))


def _printed(symbols: Column, marks: Column) -> Column:
    return F.array_join(F.zip_with(symbols, marks, lambda s, m: F.concat(F.when(s.startswith("#"), "#text").otherwise(s), m)), " ")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper, container and template (texts in the container, with their places) of every host, from all its pages and their whole texts."""
    rows = pages.select(host_of("url").alias("host"), "html").where("html <> ''")
    folded = _host_wrappers(rows)
    decisions = materialize(_decisions(rows, folded))
    hosts = _proven_hosts(rows, decisions)
    proof = decisions.withColumn("_proven", F.lit(False)) if hosts is None else decisions.join(hosts, "host", "left")
    template = F.when(F.col("_proven"), F.col("template")).otherwise(F.array().cast("array<string>"))
    printed = folded.select("host", _printed(F.col("symbols"), F.col("marks")).alias("wrapper"))
    return printed.join(proof.select("host", "container", template.alias("template")), "host")


def _rule(container: str | None, template: list[str]) -> tuple[str | None, frozenset[str]]:
    return container, frozenset(template)


def _extract(ruled: Ruled) -> Iterator[pa.RecordBatch]:
    """The main text of every page by its host's rule."""
    for batch, rules in ruled:
        texts = [main_text(page, *rule) if page else "" for page, rule in zip(batch.column("html").to_pylist(), rules, strict=True)]
        yield same_rows(batch, ["page_id", "url"], {"text": pa.array(texts, pa.string())})


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page.

    Null and empty pages have an empty text; a page without main text too. Null urls are a
    host of their own; repeated rows are repeated; other columns are ignored; no rows give
    no rows. The hosts' rules go to every worker once where they are of a bounded size, and
    to the rows by a shuffle beyond it.
    """
    rules = materialize(wrappers(pages))
    rows = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"
    return _beside_rules(rows, rules, ["container", "template"], _rule, _extract, schema)


def page_report(pages: DataFrame) -> DataFrame:
    return extract_pages(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
