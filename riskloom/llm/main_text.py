"""Main text of web pages by two passes of rules over blocks."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# Frequent function words of four languages (fixed values).
STOP_WORDS = frozenset(
    # English
    "a an and are as at be by for from has have in is it its not of on or that the this to was were will with you "
    # German
    "als am auch auf aus bei das dem den der des die ein eine er es für im ist mit nicht sich sie sind und von wie zu zum zur "
    # French
    "au aux avec ce ces dans de des du elle en est et il la le les leur ne par pas pour qui que se sur un une "
    # Spanish
    "al como con de del el ella en es la las lo los más no o para pero por que se sin su sus un una y".split()
)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
#: Elements that never hold main text.
OUT = frozenset("head script style textarea title noscript iframe template nav footer aside form button select option svg canvas object dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in a class or id that tell menus, notices, adverts, comments and the like.
NAMES = re.compile(
    r"^(ads?|adverts?|advertise\w*|adsense|banner|breadcrumbs?|comments?|commentlist|respond|reply|replies|cookies?|consent|gdpr|disclaimer|footer|header|masthead|menu|"
    r"modal|nav|navbar|navigation|newsletter|notices?|notification|pagination|pager|popup|promo|promoted|related|recommended|share|sharing|sidebar|sidenav|social|sponsor|sponsored|subscribe|teaser|toolbar|widget)$"
)
#: Of these, the names of what readers write. All other names also stand in class names of the layout ("no-sidebar", "sticky-header"),
#: so an element that has one and holds most of the page's text keeps it.
READERS = re.compile(r"^(comments?|commentlist|respond|reply|replies)$")
#: A class that begins with one of these tells a state of the page, not what the element is.
STATES = frozenset("has is no not with without".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


@dataclass(frozen=True)
class BlockRules:
    #: Blocks shorter than this are decided by their neighbours only.
    short: int = 70
    #: Blocks longer than this, with enough stop words, are main text.
    long: int = 200
    #: Shares of stop words among the words.
    stops_low: float = 0.15
    stops_high: float = 0.30
    #: Share of the characters that stand in links; above it a block is a menu.
    links: float = 0.5
    #: An element with a layout name that holds this share of the page's stop words is the page's wrapper and keeps its text.
    wrapper: float = 0.75


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    out: bool = False
    main: bool = False
    #: Numbers of the open elements that are out by a class or id only.
    named: tuple[int, ...] = ()
    listed: bool = False
    text: str = ""
    label: str = ""
    prose: bool = False


@lru_cache(4096)
def _outside(tag: str, attributes: str, in_main: bool) -> bool:
    """Whether an element holds menus, notices and the like by what it is, its role, or because it is hidden."""
    if tag in OUT or tag == "header" and not in_main:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
    return False


@lru_cache(4096)
def _named(tag: str, attributes: str, in_main: bool) -> str:
    """``readers`` or ``layout`` where a class or id names a part that is no main text, else nothing."""
    if not attributes or tag in ("html", "body", "main"):
        return ""
    values = [m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id")]
    split = [[w.lower() for w in _WORDS.findall(one)] for value in values for one in value.split()]
    words = [w for one in split if one and one[0] not in STATES for w in one if NAMES.match(w) and not (in_main and w == "header")]
    return "" if not words else "readers" if any(READERS.match(w) for w in words) else "layout"


@dataclass
class Part:
    """An element that a class or id names; ``holds`` if an article or a main heading begins in it."""

    kind: str
    holds: bool


def blocks_of(page: str) -> tuple[list[Block], list[Part]]:
    """Blocks of text in page order, and the named elements they stand in; an open element at the end of a page that was cut off counts as closed there."""
    done: list[Block] = []
    parts: list[Part] = []
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # tag, out, main, named
    links = 0
    now = Block()
    breaks = 0

    def close() -> None:
        nonlocal now
        text = " ".join(html.unescape("".join(now.parts)).split())
        if text:
            now.text = text
            done.append(now)
        out, main, named = stack[-1][1:] if stack else (False, False, ())
        now = Block(out=out, main=main, named=named, listed=any(t == "li" for t, *_ in stack))

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if not m and (cut := re.search(r"<[/a-zA-Z!?][^>]*\Z", piece)):
            piece = piece[: cut.start()]
        if piece:
            now.parts.append(piece)
            if links:
                now.linked += len(piece)
            if not piece.isspace():
                breaks = 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    inline = all(t in INLINE for t, *_ in stack[depth:])
                    links -= sum(t == "a" for t, *_ in stack[depth:])
                    shut = not inline or stack[depth][1] != (depth > 0 and stack[depth - 1][1])
                    del stack[depth:]
                    if shut:
                        close()
                    break
            continue
        if tag == "br":
            now.parts.append("\n")
            breaks += 1
            if breaks == 2:
                close()
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            continue
        out, main, named = stack[-1][1:] if stack else (False, False, ())
        if tag in RAW:
            # Its content is skipped whole; other inline text goes on around it.
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        inline = tag in INLINE
        if not inline and stack:
            # A block ends an open paragraph, with what is open in it.
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    links -= sum(t == "a" for t, *_ in stack[depth:])
                    del stack[depth:]
                    break
                if stack[depth][0] not in INLINE:
                    break
            out, main, named = stack[-1][1:] if stack else (False, False, ())
        if inline:
            # Text of an inline element that is out belongs to no block.
            if not out and (_outside(tag, m[3], main) or _named(tag, m[3], main)):
                close()
                stack.append((tag, True, main, named))
                links += tag == "a"
                now.out = True
                continue
        else:
            out = out or _outside(tag, m[3], main)
            if kind := "" if out else _named(tag, m[3], main):
                named = *named, len(parts)
                parts.append(Part(kind, False))
            if tag in ("article", "main", "h1"):
                for i in named:
                    parts[i].holds = True
            main = main or tag in ("article", "main") or 'role="main"' in m[3]
        stack.append((tag, out, main, named))
        links += tag == "a"
        if not inline:
            close()
    close()
    return done, parts


def _stops(text: str) -> tuple[int, int]:
    """Stop words and words."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words), len(words)


def settle_names(blocks: list[Block], parts: list[Part], rules: BlockRules) -> None:
    """Blocks in a named element are out, unless the name is one of layout and the element wraps the page.

    It does if it holds most stop words of all blocks that are not out by themselves nor written by readers, and
    an article, a main heading or three blocks of prose.
    """
    if not parts:
        return
    mass, prose, total = [0] * len(parts), [0] * len(parts), 0
    for b in blocks:
        if b.out or any(parts[i].kind == "readers" for i in b.named):
            continue
        stops, words = _stops(b.text)
        total += stops
        for i in b.named:
            mass[i] += stops
            prose[i] += len(b.text) >= rules.short and stops >= rules.stops_high * words
    wraps = [p.kind == "layout" and m > rules.wrapper * total and (p.holds or n >= 3) for p, m, n in zip(parts, mass, prose, strict=True)]
    for b in blocks:
        b.out = b.out or not all(wraps[i] for i in b.named)


def classify(blocks: list[Block], rules: BlockRules) -> None:
    """Labels ``good`` or ``bad``. Blocks of the page's article are judged against the article, others by the rules alone."""
    has_main = any(b.main and not b.out for b in blocks)
    for b in blocks:
        size, (n, words) = len(b.text), _stops(b.text)
        stops = n / max(1, words)
        density = b.linked / max(size, 1)
        if b.out or has_main and not b.main:
            b.label = "bad"
        elif density > rules.links and (b.listed or not b.main):
            b.label = "bad"
        elif size < rules.short:
            b.label = "bad" if b.linked and not b.main else "ambiguous"
        elif stops >= rules.stops_high:
            b.label = "good" if size > rules.long or b.main else "near"
        elif stops >= rules.stops_low:
            b.label = "near"
        else:
            b.label = "ambiguous" if b.main else "bad"
        b.prose = b.label == "near" and stops >= rules.stops_high
    if not any(b.label == "good" for b in blocks):
        # A page of short paragraphs: these decide in place of long ones.
        for b in blocks:
            b.label = "good" if b.prose else b.label
    # Second pass. What is left takes the label of the nearest decided block; within an article the bounds are its own, so
    # an article of short blocks is kept whole.
    decided = [b.label if b.label in ("good", "bad") else "" for b in blocks]
    before: list[tuple[str, int]] = []
    last = ("", -1)
    for i, (b, d) in enumerate(zip(blocks, decided, strict=True)):
        before.append(last)
        if d and (not has_main or b.main and not b.out):
            last = (d, i)
    after = [("", len(blocks))] * len(blocks)
    last = ("", len(blocks))
    for i in range(len(blocks) - 1, -1, -1):
        after[i] = last
        if decided[i] and (not has_main or blocks[i].main and not blocks[i].out):
            last = (decided[i], i)
    for i, b in enumerate(blocks):
        if b.label in ("good", "bad"):
            continue
        (left, x), (right, y) = before[i], after[i]
        if left == right and left:
            near = left
        elif left and right:
            # Between a good and a bad one: a block with stop words goes with the good one, else the nearer decides.
            near = "good" if b.label == "near" or b.main else (left if i - x < y - i else right if y - i < i - x else "bad")
        elif b.main:
            near = left or right or "good"
        else:
            # The end of the page counts as a bad neighbour, but a block with stop words beside a good one goes with it.
            near = "good" if b.label == "near" and "good" in (left, right) else "bad"
        b.label = near


def main_text(page: str | None, rules: BlockRules | None = None) -> str:
    """The main text of one page; null, empty and cut pages, and pages without main text, give what can be read of them, or an empty text."""
    rules = rules or BlockRules()
    blocks, parts = blocks_of(page or "")
    settle_names(blocks, parts, rules)
    classify(blocks, rules)
    return "\n\n".join(b.text for b in blocks if b.label == "good")


def extract(page: Column, rules: BlockRules | None = None) -> Column:
    rules = rules or BlockRules()

    @arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py(), rules) for x in batch], pa.string())

    return run(page)


def extract_pages(pages: DataFrame, rules: BlockRules | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages``, repeated rows included.

    A null or empty page, and one without main text, gives an empty text; null ids and addresses stay null. Each page is
    read whole in the task that has it, so nothing is shuffled.
    """
    return pages.select("page_id", "url", extract(F.col("html"), rules).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
