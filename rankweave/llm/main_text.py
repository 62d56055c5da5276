"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one for each block element. Tags set what a line weighs; the distribution of the
weights, summed over a sliding window of lines, decides what is kept. A window at or over the threshold is heavy:
where one begins the sums surge, where the last ends they dive, and the lines between are a block of text. Short
lines between two surges are no dive unless a whole window of lines weighs nothing.

Weights: nothing for lines inside navigation, headers, footers, sidebars, scripts, adverts, notices and comment
sections (by tag, role, class or id); nothing for lines of mostly link text outside containers, and inside
them for runs of short ones, as in menus; nothing for lines outside where the page names
its container (``article``, ``main``) and that holds at least as much prose; else a line's length. Classes that name things articles are
made of as well (search, tags, related, ...) only count where the element's lines are short or links.
Threshold: ``surge`` characters, or the heaviest window where no window has that.

A class that is a word of noise as a whole makes an element noise; where the word is only a part of a class or id
(``layout-sidebar-right``), and for forms and fieldsets, the element is noise unless it holds over half of the main
prose: of the containers' where there are any, else of the page's; a class inside a container three quarters. Parts behind a word such as ``no`` or ``has`` say nothing.
An element is hidden by an attribute of its own, whatever its other values say.

A block begins and ends at a line of some length; a short line next to it (a heading, a last word) belongs to it if it is a
paragraph or shares its parent element, the body aside. Short lines inside a block stay. In a container that has a block, all
stays but the dives, where a whole window weighs nothing: menus go, a link or two between paragraphs don't.

Tags are read in one pass that never goes back, so time is linear in the page's length whatever is unclosed.
Character references are decoded, white space inside a block becomes one space, blocks are joined by one
space, nothing else is dropped or capped. Defined cases: null and empty pages give an empty text; unclosed
tags end with their parent; an unclosed script, style or comment goes to the end of the page, other unclosed
raw elements are as if not there; text without any tag is one line a line; repeated rows are extracted each; the
result has one row for each row; columns other than page_id, url and html don't matter.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankweave.llm.columns import pick
from rankweave.runtime import small_batches

#: Lines of one window, and characters that one must reach.
WINDOW = 3
SURGE = 80
#: A shorter line doesn't begin or end a block by itself.
SHORT = 20
#: Mean characters of a line from which an element of a doubtful class is text.
PROSE = 40

#: HTML element names and words of class, id and role attributes.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style template noscript iframe object svg canvas textarea title head xmp noembed noframes".split())
TO_THE_END = frozenset(("script", "style"))
DROPPED = frozenset("nav aside footer menu select button dialog input".split()) | RAW
WRAPPERS = frozenset(("form", "fieldset"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
CONTAINERS = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
_NOISE = r"ads?|advert\w*|adsense|sponsor\w*|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|subscription|signup|login|paywall|sidebar|side-bar|aside|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|foot|masthead|site-header|page-header|topbar|outbrain|taboola"
_COMMENTS = r"comments?|commentlist|disqus|respond|replies"
_PART = r"(?i)(?:^|[_-])(?:{})(?:$|[_-])"
NOISE = re.compile(rf"(?i)(?:{_NOISE}|{_COMMENTS})")
NOISE_PART, COMMENTS_PART = re.compile(_PART.format(_NOISE)), re.compile(_PART.format(_COMMENTS))
SAYS_NOTHING = re.compile(r"(?i)(?:no|not|non|has|have|with|without|is|hide|show)[_-]")
DOUBTFUL = re.compile(r"(?i)(?:^|[\s_-])(?:banner|promo\w*|alert|widget|toolbar|discussion|share|sharing|social|related|recommend\w*|trending|tags|tagcloud|search|skip|hidden)(?:$|[\s_-])")
COMMENT = re.compile(r"(?i)(?:^|\s)(?:comment|comment-(?:body|item|content)|reply)(?:\s|$)")
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile(r"=\s*+[\"']|>")
_ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_BARE_HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?:\s|/|$)")
_NO_DISPLAY = re.compile(r"(?i)display\s*+:\s*+none")


def _hides(key: str, value: str) -> bool:
    return key == "hidden" and value.lower() != "false" or key == "aria-hidden" and value.lower() == "true" or key == "style" and bool(_NO_DISPLAY.search(value))


def _kind(name: str, attributes: str, contained: bool) -> str:
    """What an element is: "noise", "wrapper" or "comments" (noise unless it holds the main text), "doubtful" or ""."""
    if name in DROPPED or name == "header" and not contained:
        return "noise"
    found = "wrapper" if name in WRAPPERS else ""
    if not attributes or name in ("html", "body"):
        return found
    if "idden" in attributes and _BARE_HIDDEN.search(_ATTRIBUTE.sub(" ", attributes)):
        return "noise"
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if _hides(key, value):
            return "noise"
        if name in CONTAINERS:
            if key == "class" and COMMENT.search(value):
                return "noise"
        elif key == "role" and value.lower() in ROLES:
            return "noise"
        elif key in ("class", "id"):
            for word in value.split():
                if NOISE.fullmatch(word):
                    return "noise"
                if SAYS_NOTHING.match(word):
                    continue
                if COMMENTS_PART.search(word):
                    found = "comments"
                elif NOISE_PART.search(word) and found != "comments":
                    found = "wrapper"
            if not found and DOUBTFUL.search(value):
                found = "doubtful"
    return found


@dataclass(slots=True)
class Line:
    text: str
    inside: bool  # a container
    links: int  # characters of link text
    tag: str  # of its block, and the number of that block's parent
    parent: int
    doubtful: int  # number of the outermost element of a doubtful class, 0 for none
    wrapped: tuple[tuple[int, str], ...] = ()  # elements that are noise unless they hold the main text: number, and "comments", "inner" (in a container) or ""

    @property
    def prose(self) -> int:
        return max(0, len(self.text) - self.links)


def _tag_end(page: str, at: int, absent: set[str]) -> int:
    """Where the tag's ``>`` stands, outside quoted values; -1 if nowhere. ``absent``: what isn't in the rest of the page."""
    while found := _STOP.search(page, at):
        quote = found[0][-1]
        if quote == ">":
            return found.start()
        at = found.end()
        if quote not in absent:
            if (close := page.find(quote, at)) < 0:
                absent.add(quote)
            else:
                at = close + 1
    absent.add(">")
    return -1


def lines_of(page: str) -> list[Line]:
    """The lines of the page that aren't inside what is noise whatever it holds."""
    lines: list[Line] = []
    buffer: list[str] = []
    stack: list[tuple[str, str, bool]] = []  # name, kind, opens a container
    open_names: Counter[str] = Counter()
    blocks: list[tuple[str, int]] = [("body", 0)]  # name and number of the open block elements
    doubts: list[int] = []
    wraps: tuple[tuple[int, str], ...] = ()
    noise = inside = links = link_chars = number = 0
    place = blocks[-1][0], 0
    absent: set[str] = set()
    at = 0

    def add(text: str) -> None:
        nonlocal link_chars, place
        if not buffer:
            place = blocks[-1][0], blocks[-2][1] if len(blocks) > 1 else 0
        buffer.append(text)
        if links:
            link_chars += len(text)

    def end_line() -> None:
        nonlocal link_chars
        if buffer:
            if text := " ".join(entities.unescape("".join(buffer)).split()):
                lines.append(Line(text, inside > 0, link_chars, *place, doubts[0] if doubts else 0, wraps))
            buffer.clear()
        link_chars = 0

    def leave() -> str:
        nonlocal noise, inside, links, wraps
        name, kind, container = stack.pop()
        open_names[name] -= 1
        if name in BLOCKS:
            end_line()
            blocks.pop()
        elif kind in ("wrapper", "comments"):
            end_line()  # its text ends with it, though it is no block
        if kind == "doubtful":
            doubts.pop()
        if kind in ("wrapper", "comments"):
            wraps = wraps[:-1]
        noise -= kind == "noise"
        inside -= container
        links -= name == "a"
        return name

    while (start := page.find("<", at)) >= 0:
        if not noise and start > at:
            add(page[at:start])
        if page.startswith(("<!--", "<![CDATA["), start):
            mark = "-->" if page[start + 2] == "-" else "]]>"
            close = page.find(mark, start + 4)
            if mark == "]]>" and not noise:
                add(entities.escape(page[start + 9 : close if close >= 0 else len(page)]))
            at = close + 3 if close >= 0 else len(page)
            continue
        found = _TAG.match(page, start + 1)
        if ">" in absent or not found and page[start + 1 : start + 2] not in ("!", "?"):
            if not noise:
                add("<")
            at = start + 1
            continue
        if not found:
            close = page.find(">", start)
            at = close + 1 if close >= 0 else len(page)
            continue
        if (close := _tag_end(page, found.end(), absent)) < 0:
            at = start
            continue
        attributes, name, at = page[found.end() : close], found[2].lower(), close + 1
        if found[1]:
            if open_names[name]:
                while leave() != name:
                    pass
            elif name in BLOCKS:
                end_line()
            continue
        if name in BLOCKS and name != "br" and stack and stack[-1][0] == "p":
            leave()
        if name in ("li", "td", "th", "tr", "dd", "dt", "option") and stack and stack[-1][0] == name:
            leave()
        if name in BLOCKS:
            end_line()
        if name in VOID or attributes.rstrip().endswith("/") and not attributes.rstrip().endswith("=/"):
            continue
        if name in RAW:
            end = None if name in absent else re.compile(rf"(?i)</{re.escape(name)}\s*+>").search(page, at)
            if end:
                at = end.end()
            else:
                absent.add(name)
                at = len(page) if name in TO_THE_END else at
            continue
        kind = _kind(name, attributes, inside > 0)
        container = name in CONTAINERS and kind != "noise"
        number += 1
        stack.append((name, kind, container))
        open_names[name] += 1
        if name in BLOCKS:
            blocks.append((name, 0 if name in ("html", "body") else number))
        if kind == "doubtful":
            doubts.append(number)
        if kind in ("wrapper", "comments"):
            end_line()
            wraps = (*wraps, (number, kind if kind == "comments" else "inner" if inside and name not in WRAPPERS else ""))
        noise += kind == "noise"
        inside += container
        links += name == "a"
    if not noise:
        add(page[at:])
    end_line()
    return lines


def unwrapped(lines: list[Line]) -> list[Line]:
    """Without the lines of wrappers that don't hold over half of the main prose (three quarters for classes inside a container, where
    adverts stand); a comment section only holds it by a container."""
    if not any(x.wrapped for x in lines):
        return lines
    contained = any(x.inside for x in lines)
    main = [x for x in lines if x.inside or not contained]
    held: Counter[tuple[int, str]] = Counter()
    for x in main:
        for wrap in x.wrapped:
            held[wrap] += x.prose
    total = sum(x.prose for x in main)
    stays = {(n, kind) for (n, kind), chars in held.items() if chars > total * (0.75 if kind == "inner" else 0.5) and (contained or kind != "comments")}
    return [x for x in lines if stays.issuperset(x.wrapped)]


def _runs(flags: np.ndarray) -> np.ndarray:
    """(first, behind the last) of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges.reshape(-1, 2)


def _decides(lines: list[Line], length: np.ndarray, linked: np.ndarray, inside: np.ndarray, surge: int) -> bool:
    """Whether the page's containers hold its main text: not where more prose stands outside, as beside a teaser."""
    return bool(inside.any()) and bool(length[inside].sum() >= length[~inside & ~linked & (length >= surge)].sum())


def _dives(weights: np.ndarray, window: int) -> np.ndarray:
    """Lines that a window without any weight covers."""
    padded = np.concatenate([np.ones(window - 1, np.int64), weights, np.ones(window - 1, np.int64)])
    empty = np.convolve(padded, np.ones(window, np.int64), "valid") == 0
    return np.convolve(empty, np.ones(window, np.int64), "full")[window - 1 : window - 1 + weights.size] > 0


def weights_of(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> np.ndarray:
    """What each line weighs, by its length and its tags."""
    length = np.array([len(x.text) for x in lines])
    linked = np.array([2 * x.links >= len(x.text) for x in lines])
    inside = np.array([x.inside for x in lines])
    if _decides(lines, length, linked, inside, surge):
        out = np.where(inside, length, 0)
        for low, high in _runs(linked & inside):
            if length[low:high].mean() < SHORT and high - low < np.count_nonzero(inside):
                out[low:high] = 0
    else:
        out = np.where(linked, 0, length)
    whose = np.array([x.doubtful for x in lines])
    for number in np.unique(whose[whose > 0]).tolist():
        own = whose == number
        if length[own].mean() < PROSE or 2 * length[own & linked].sum() >= length[own].sum():
            out[own] = 0
    return out


def text_blocks(weights: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(first, behind the last) line of each block: between a surge of the windows' sums and the dive after it, from and to a line of some length.

    Short lines between two surges are no dive, however many, unless whole windows of lines weigh nothing.
    """
    if not weights.any():
        return []
    sums = np.convolve(weights, np.ones(window, dtype=np.int64))  # of each window, the first and last ones reaching over the edge
    least = min(surge, int(sums.max()))
    heavy = np.convolve(sums >= least, np.ones(window, dtype=np.int64))[window - 1 : window - 1 + weights.size] > 0
    strong = np.flatnonzero(weights >= min(SHORT, int(weights.max())))
    out = []
    for low, high in _runs(heavy).tolist():
        own = strong[np.searchsorted(strong, low) : np.searchsorted(strong, high)]
        if not own.size:
            continue
        first, behind = int(own[0]), int(own[-1]) + 1
        if out and not any(b - a >= window for a, b in _runs(weights[out[-1][1] : first] == 0).tolist()):
            first = out.pop()[0]
        out.append((first, behind))
    return out


def _belongs(line: Line, edge: Line) -> bool:
    return line.tag in PARAGRAPHS or line.parent == edge.parent and line.parent > 0


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The page's main text by the distribution of its lines' weights."""
    if not page:
        return ""
    lines = unwrapped(lines_of(page)) if "<" in page else [Line(" ".join(entities.unescape(x).split()), False, 0, "p", 0, 0) for x in page.splitlines() if x.strip()]
    if not lines:
        return ""
    weights = weights_of(lines, window, surge)
    keep = np.zeros(len(lines), dtype=bool)
    # Inside a container that has a block, all but the dives is text: also its short lines, and a few links between paragraphs.
    marked = np.array([x.inside and not x.doubtful for x in lines]) & ~_dives(weights, window)
    for low, high in text_blocks(weights, window, surge):
        first, last = lines[low], lines[high - 1]
        while low and weights[low - 1] and _belongs(lines[low - 1], first):
            low -= 1
        while high < len(lines) and weights[high] and _belongs(lines[high], last):
            high += 1
        keep[low:high] = weights[low:high] > 0
        if first.inside:
            keep |= marked
    return " ".join(x.text for x, kept in zip(lines, keep, strict=True) if kept)


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x, window, surge) for x in batch.column(2).to_pylist()]
            yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(found, pa.string()), "n_chars": pa.array(map(len, found), pa.int64())})

    return pick(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, text string, n_chars long")
