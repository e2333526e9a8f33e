"""Pages as arrays of nodes: a forgiving HTML reader and the features of its nodes."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

# Fixed values of HTML: elements without content, with raw text, that are never shown as text, and
# that flow inside a line; what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
UNSEEN = frozenset("script style noscript template svg iframe object math canvas audio video head title textarea select option button xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
CLOSE_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)

GROUPS = (
    frozenset("p pre blockquote figcaption".split()), frozenset("h1 h2 h3 h4 h5 h6 hgroup".split()), frozenset("ul ol li dl dt dd menu".split()),
    frozenset("table tr td th tbody thead tfoot caption".split()), frozenset("form input label fieldset legend datalist output".split()),
    frozenset(("nav",)), frozenset(("header",)), frozenset(("footer",)), frozenset(("aside",)), frozenset(("article", "main")),
    frozenset(("section", "div", "body")), INLINE,
)
GOOD = frozenset("article articlebody body content entry main post story text".split())
BAD = frozenset(
    "ad ads advert advertisement adverts author banner bar breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus dialog feedback footer foot form header "
    "hidden links login masthead menu modal nav navbar navigation navi newsletter notice pager pagination popup promo promoted recommended related reply replies respond search share "
    "sharing sidebar side signup social sponsor sponsored subscribe tags toolbar topbar widget alert complementary contentinfo".split()
)

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
MAX_DEPTH = 512
"""Nodes nested deeper are children of the ancestor at this depth, as in browsers."""
_MARKS = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_PIECES = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Page:
    """Nodes in page order, each after its parent; text nodes have tag ``#``."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    good: list[int] = field(default_factory=list)
    bad: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)


def attribute_marks(attributes: str) -> tuple[int, int]:
    """Telling tokens in class, id, role and itemprop: (of articles, of what surrounds them)."""
    good = bad = 0
    if attributes:
        for m in _MARKS.finditer(attributes):
            for token in _PIECES.findall(_CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower()):
                good += token in GOOD
                bad += token in BAD
        bad += bool(_HIDDEN.search(attributes))
    return good, bad


class Tags:
    """Finds the tags of a source from left to right, in time linear in its length.

    A tag ends at the first ``>`` outside quotes. Where there is none, or a quote stays open, the ``<``
    is text, and reading goes on behind it. The stops (quotes and ends) that such a vain reading met are
    kept: a later one that meets any of them ends there too, so no stretch is read in vain twice.
    """

    def __init__(self, source: str):
        self.source, self.vain = source, set()
        self.last_end = source.rfind(">")
        self.span = (0, -1, -1)  # the last stretch without a stop: where it was read from, its stop

    def end(self, start: int) -> int:
        """Index behind the tag whose attributes begin at ``start``, -1 if it does not end."""
        source, met, at = self.source, [], start
        first, stop = self.span[:2]
        while at <= self.last_end:
            if first <= at <= stop:
                found = stop
            else:
                m = _STOP.search(source, at)
                found = m.start() if m else -1
                if at == start and m:
                    self.span = (at, found, -1)
            if found < 0 or found in self.vain:
                break
            if source[found] == ">":
                return found + 1
            met.append(found)
            close = source.find(source[found], found + 1)
            if close < 0:
                break
            at = close + 1
        self.vain.update(met)
        return -1

    def __iter__(self):
        """(where raw text before it begins and ends, name or None, is an end tag, attributes, behind)."""
        source, at, end = self.source, 0, len(self.source)
        raw = 0
        while True:
            i = source.find("<", at)
            if i < 0:
                return
            after = source[i + 1 : i + 2]
            if source.startswith("<!--", i):
                close = source.find("-->", i + 4)
                behind = end if close < 0 else close + 3
                told = (raw, i, None, False, "", behind)
            elif after in ("!", "?"):
                close = source.find(">", i) if i < self.last_end else -1
                if close < 0:
                    at = i + 1
                    continue
                behind = close + 1
                told = (raw, i, None, False, "", behind)
            else:
                m = _NAME.match(source, i) if i < self.last_end else None
                behind = self.end(m.end()) if m else -1
                if behind < 0:
                    at = i + 1
                    continue
                told = (raw, i, m[1].lower(), after == "/", source[m.end() : behind - 1], behind)
            skipped = yield told
            raw = at = behind if skipped is None else skipped
            if skipped is not None:
                yield None  # the answer to send()


def parse(source: str) -> Page:
    """The nodes of a page, in time linear in its length. Anything is accepted: unknown, unclosed and
    misnested tags, tags cut off at the end (kept as text), raw text that contains tags."""
    page = Page([""], [-1], [0], [0], [""], [0])
    tags, parents, good, bad, texts, blocks = page.tags, page.parents, page.good, page.bad, page.texts, page.blocks
    stack, unseen, block, last_text = [0], 0, 0, 0
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    outer = [0]  # places of open elements that do not flow inside a line

    def text(raw: str) -> None:
        nonlocal last_text
        last_text = len(tags)
        tags.append("#")
        parents.append(stack[min(len(stack), MAX_DEPTH) - 1])
        good.append(0)
        bad.append(0)
        texts.append(html.unescape(raw) if "&" in raw else raw)
        blocks.append(block)

    def space() -> None:
        """White space after the last text of the block (only tags inside the line follow it)."""
        if last_text and blocks[last_text] == block and not texts[last_text].endswith(" "):
            texts[last_text] += " "

    def pop() -> None:
        nonlocal unseen
        tag = tags[stack.pop()]
        places[tag].pop()
        if outer[-1] == len(stack):
            outer.pop()
        unseen -= tag in UNSEEN

    def innermost(names: Iterable[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def content(raw: str) -> None:
        if raw and not unseen and not raw.isspace():
            text(raw)
        elif raw and not unseen:
            space()

    behind, found = 0, iter(Tags(source))
    for start, stop, tag, closing, attributes, behind in found:
        content(source[start:stop])
        if tag is None:
            continue
        if tag not in INLINE:
            block += 1
        elif tag == "br":
            space()
        if closing:
            if places.get(tag):
                while tags[stack[-1]] != tag:
                    pop()
                pop()
            continue
        if tag in CLOSES:
            ends, within = CLOSES[tag]
            k = innermost(ends)
            if k > 0 and k > innermost(within):
                while len(stack) > k:
                    pop()
        elif tag in CLOSE_P:
            while tags[stack[outer[-1]]] == "p":
                k = outer[-1]
                while len(stack) > k:
                    pop()
        tags.append(tag)
        parents.append(stack[min(len(stack), MAX_DEPTH) - 1])
        g, b = attribute_marks(attributes)
        good.append(g)
        bad.append(b)
        texts.append("")
        blocks.append(block)
        if tag in VOID or attributes.endswith("/") and tag not in CLOSE_P:
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            outer.append(len(stack))
        stack.append(len(tags) - 1)
        unseen += tag in UNSEEN
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}[\\s/>]", re.IGNORECASE).search(source, behind)
            behind = close.start() if close else len(source)
            found.send(behind)
    content(source[behind:])
    return page


FEATURES = 37


@dataclass
class Nodes:
    """Pages laid end to end as arrays."""

    parent: np.ndarray
    depth: np.ndarray
    is_text: np.ndarray
    features: np.ndarray
    first: np.ndarray

    def levels(self) -> list[np.ndarray]:
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.cumsum(np.bincount(self.depth))[:-1])


def node_features(pages: list[Page]) -> Nodes:
    """Features of all nodes: kind, attribute tokens of the node and of the nearest marked
    ancestor, depth, subtree density of text, links, elements and punctuation, place among siblings
    and in the page."""
    sizes = np.array([len(p.tags) for p in pages], np.int64)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(pages)), sizes)
    n = int(sizes.sum())
    join = lambda name: [x for p in pages for x in getattr(p, name)]
    tags, texts = join("tags"), join("texts")
    parent = np.array(join("parents"), np.int64)
    roots = parent < 0
    parent = np.where(roots, np.arange(n), parent + first[owner])
    good, bad = np.array(join("good"), float), np.array(join("bad"), float)
    group_of = {t: 1 << g for g in range(len(GROUPS)) for t in GROUPS[g]}
    groups = np.array([group_of.get(t, 0) for t in tags], np.int64)
    kind = ((groups[:, None] >> np.arange(len(GROUPS))) & 1).astype(bool)
    is_text = np.array([t == "#" for t in tags])
    is_link = np.array([t == "a" for t in tags])
    depth = np.zeros(n, np.int64)
    parents = parent.tolist()
    depths = depth.tolist()
    for i, p in enumerate(parents):
        if p != i:
            depths[i] = depths[p] + 1
    depth = np.array(depths, np.int64)
    nodes = Nodes(parent, depth, is_text, np.zeros((n, 0)), first)
    levels = nodes.levels()

    chars = np.array([len(t) for t in texts], float)
    stops = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") if t else 0 for t in texts], float)
    sums = np.column_stack([chars, np.zeros(n), (~is_text).astype(float), stops, kind[:, 0].astype(float), is_text.astype(float)])
    for level in reversed(levels[1:]):
        sums[level, 1] = np.where(is_link[level], sums[level, 0], sums[level, 1])
        np.add.at(sums, parent[level], sums[level])
    marked_bad = (kind[:, 4:9].sum(axis=1) > 0) | (bad > 0)
    marked_good = ((kind[:, 9] > 0) | (good > 0)) & ~marked_bad
    own = np.where(marked_bad, -1.0, np.where(marked_good, 1.0, 0.0))
    nearest, any_bad, any_good, inside = own.copy(), marked_bad.astype(float), marked_good.astype(float), kind.copy()
    for level in levels[1:]:
        up = parent[level]
        nearest[level] = np.where(own[level] != 0, own[level], nearest[up])
        any_bad[level] = np.maximum(any_bad[level], any_bad[up])
        any_good[level] = np.maximum(any_good[level], any_good[up])
        inside[level] = np.maximum(inside[level], inside[up])
    siblings = np.bincount(parent, minlength=n).astype(float) - np.where(roots, 1, 0)
    order = np.lexsort((np.arange(n), parent))
    run = np.r_[True, parent[order][1:] != parent[order][:-1]]
    place = np.zeros(n)
    place[order] = np.arange(n) - np.maximum.accumulate(np.where(run, np.arange(n), 0))
    total = np.maximum(sums[first[owner], 0], 1.0)
    before = np.cumsum(chars) - chars
    before -= before[first[owner]]
    text, up = np.maximum(sums[:, 0], 1.0), parent
    columns = (  # one at a time: a page may have millions of nodes
        lambda: is_text, lambda: depth, lambda: np.log1p(sums[:, 0]), lambda: sums[:, 0] / total, lambda: sums[:, 1] / text, lambda: sums[:, 2] / text * 100, lambda: sums[:, 3] / text * 100,
        lambda: np.log1p(siblings), lambda: place / np.maximum(siblings[up], 1), lambda: np.log1p(siblings[up]), lambda: np.log1p(sums[up, 0]), lambda: sums[:, 0] / np.maximum(sums[up, 0], 1.0),
        lambda: sums[up, 1] / np.maximum(sums[up, 0], 1.0), lambda: sums[up, 4], lambda: sums[:, 4], lambda: sums[:, 0] / np.maximum(sums[:, 5], 1.0), lambda: before / total,
        lambda: good, lambda: bad, lambda: nearest, lambda: any_bad, lambda: any_good, lambda: sums[up, 3] / np.maximum(sums[up, 0], 1.0) * 100,
    )
    features = np.empty((n, FEATURES), np.float32)
    for k, column in enumerate(columns):
        features[:, k] = column()
    features[:, FEATURES - len(GROUPS) - 2 : FEATURES - 2] = kind
    features[:, FEATURES - 2], features[:, FEATURES - 1] = inside[:, 4], inside[:, 11]
    nodes.features = features
    return nodes


def main_text(page: Page, kept: np.ndarray) -> str:
    """Kept text nodes: blocks in page order, white space folded, joined by one line feed."""
    out: list[list[str]] = []
    last = -1
    for k in np.flatnonzero(kept).tolist():
        if page.tags[k] == "#":
            if page.blocks[k] != last or not out:
                out.append([])
                last = page.blocks[k]
            out[-1].append(page.texts[k])
    lines = (" ".join("".join(parts).split()) for parts in out)
    return "\n".join(line for line in lines if line)
