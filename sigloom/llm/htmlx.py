"""Main-text extraction with wrappers inferred per host.

Wrapper inference. A page is a stream of tags and text slots. Repeats inside a page are folded into groups first
(`fold`), then the stream is aligned with its host's wrapper so far: where both agree, items stay; what only one side
has becomes optional; a unit that one side repeats becomes a repeated group; text that differs becomes a slot, text that
all pages share stays constant (for a repeated group, the texts of the whole group). The result is a regular expression
without unions. Pages with the same stream are first compared slot by slot, then aligned as one. Alignment (`pairs_of`) goes by
units that both sides have once, in the longest common order, and again between those. An item that less than SUPPORT of the pages have is no
part of the template and is left out, which bounds a wrapper; what a page has there counts as what the wrapper lacks.

Each slot of the wrapper knows how much text its pages have in it, and in which containers. Two decisions come from the slots:
the main container is the one that holds the varying text (an `article` or `main` around it, if there is one; else the
deepest with 70 percent), and a slot with the same text on all pages is template. Text is constant only if at
least MIN_PAGES different pages of the host share it. Each page is matched with its host's wrapper and cut at the main container;
constant slots are left out, unless the container is an `article` or `main` element (a fixed heading in an article belongs to
its text) or nothing else is left.

Wrappers are partial results: each task infers those of its own pages; the parts of a host are merged by the same
alignment, at most FAN_IN in one place and level by level, so a host that holds a third of all pages is never gathered in one task.

Elements are left out by name and role, and outside the main container by class or id. Inside it only boxes of comments and adverts
go by class, never a paragraph, heading or list item.

Defined cases: a null, empty or tagless html and a null URL are fine: without a container the whole visible text of the
body counts. Broken markup (unclosed elements, a page cut inside a tag, an attribute or a reference) ends what is open: a quote
that never closes ends at the next `>`. Repeated
rows are each returned. An empty table gives an empty result. Other columns pass through `extract`; columns
named like the added ones are replaced.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import urlfilter
from .stage import staged

FAN_IN = 16
MAX_HOSTS = 20_000  # hosts in the memory of a task before it hands on its wrappers
MIN_PAGES = 5
MAX_STREAMS = 500  # streams in the memory of a wrapper before they are aligned
SUPPORT = 0.02

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|math|object|textarea|select|title|canvas|video|audio)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|\"[^\">]*(?=>|\Z)|'[^'>]*(?=>|\Z))*)(?:>|\Z)"
    r"|([^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOXES = frozenset("html body article main section div table tbody thead tfoot tr td th ul ol dl nav header footer aside form fieldset menu dialog details figure center".split())
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote address figcaption summary caption legend option label button hr br".split())
_OUT_TAGS = frozenset("nav footer aside form fieldset menu dialog head button label legend option".split())
_WHOLE = frozenset("html body article main".split())  # never left out by class
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices comment comments reply replies disqus "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer footnotebar masthead share sharing social related recommended newsletter subscribe subscription "
    "popup modal overlay login signup search toolbar widget widgets pagination pager copyright alert skip".split()
)
# Inside the main container: what marks reader comments and adverts, and only on boxes.
_INNER_WORDS = frozenset("ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion comment comments reply replies disqus share sharing newsletter subscribe cookie consent popup modal".split())
# What a class may add to such a word and still name the same: share-buttons is one, share-price is not.
_SHAPES = frozenset("area bar block body box button buttons container content count form frame group header icons inner item items label link links list main panel row section slot thread title top unit wrap wrapper".split())
_NUMBER = re.compile(r"[0-9]")
_SPACE = re.compile(r"\s+")


def _marked(token: str) -> bool:
    """Whether a class or id is made of words for comments and adverts, and of shapes, only."""
    found = {x.lower() for x in _PART.findall(token)}
    return not _INNER_WORDS.isdisjoint(found) and found <= _INNER_WORDS | _SHAPES


def _signature(name: str, attributes: str) -> tuple[str, bool, bool]:
    """Name with class or id, and whether the element is left out: outside, and inside the main container."""
    out, label, inner = name in _OUT_TAGS, "", name in _OUT_TAGS
    if attributes:
        for key, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if hidden or (key == "aria-hidden" and value == "true"):
                out = inner = True
            elif key == "role":
                out |= value.lower() in _OUT_ROLES
                inner |= value.lower() in _OUT_ROLES
                label += "@" + value.lower()
            elif key in ("class", "id"):
                if name not in _WHOLE:
                    found = {x.lower() for x in _PART.findall(value)}
                    out |= not _OUT_WORDS.isdisjoint(found)
                    inner |= name in _BOXES and any(_marked(x) for x in value.split())
                # A number names one page or place, not a kind of element.
                kinds = [x for x in value.split() if not _NUMBER.search(x)]
                if kinds:
                    label += ("." if key == "class" else "#") + " ".join(kinds)
            elif key == "style":
                unseen = "display:none" in value.replace(" ", "").lower()
                out, inner = out or unseen, inner or unseen
    return name + label, out, inner


Block = tuple[str, str, int, bool, bool]


class Page:
    """tokens: the stream of tags and `#`; blocks: (container path, text, characters in links, left out, left out inside the main container)."""

    def __init__(self, source: str):
        self.tokens: list[str] = []
        self.blocks: list[Block] = []
        self.digest = _digest(source)
        stack: list[tuple[str, bool, bool, str, bool]] = []  # name, left out, left out inside the main container, path, in an article or main element
        parts: list[str] = []
        link_chars, link = 0, 0

        def flush() -> None:
            nonlocal link_chars
            if parts:
                text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
                if text:
                    self.tokens.append("#")
                    self.blocks.append((stack[-1][3], text, link_chars, stack[-1][1], stack[-1][2]) if stack else ("", text, link_chars, False, False))
                parts.clear()
            link_chars = 0

        for found in _TOKEN.finditer(source):
            raw, name, attributes, text = found.groups()
            if text is not None:
                parts.append(text)
                if link:
                    link_chars += len(text)
                continue
            if raw is not None or name is None:
                continue
            name = name.lower()
            closing = found.group().startswith("</")
            if name == "a":
                link = 0 if closing else 1
            if name not in _BOXES and name not in _LEAVES and name != "head":
                continue
            flush()
            if name in _VOID:
                self.tokens.append(name)
                continue
            if closing:
                self.tokens.append("/" + name)
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                continue
            if name in _BOXES or name in _LEAVES:
                while stack and (stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or (stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "option"))):
                    stack.pop()
                if name == "body":
                    stack[:] = [x for x in stack if x[0] == "html"]
            signature, out, inner = _signature(name, attributes)
            above = stack[-1] if stack else ("", False, False, "", False)
            if above[4]:
                out = inner
            elif name == "header":
                out = True
            path = above[3] + "/" + signature if name in _BOXES else above[3]
            self.tokens.append(signature)
            stack.append((name, above[1] or out, above[2] or inner, path, above[4] or name in ("article", "main")))
        flush()


Unit = tuple[str, ...]


def _folded(units: list[Unit], longest: int = 8) -> list[tuple[Unit, bool, int]]:
    """As `fold`, with the number of units that each item covers."""
    items = [(u, False, 1) for u in units]
    for size in range(1, longest + 1):
        done: list[tuple[Unit, bool, int]] = []
        i = 0
        while i < len(items):
            unit = [x[0] for x in items[i : i + size]]
            j = i + size
            while [x[0] for x in items[j : j + size]] == unit:
                j += size
            if j > i + size:
                rest = 0
                while rest < size - 1 and j + rest < len(items) and items[j + rest][0] == unit[rest]:
                    rest += 1
                done.append((tuple(t for u in unit for t in u), True, sum(x[2] for x in items[i : j + rest])))
                i = j + rest
            else:
                done.append(items[i])
                i += 1
        items = done
    return items


def fold(units: list[Unit], longest: int = 8) -> list[tuple[Unit, bool]]:
    """Adjacent repeats of up to `longest` units become one repeated unit; shorter units first.

    A repeated group may end in a part of itself, which makes the rest of the group optional.
    """
    return [(u, r) for u, r, _ in _folded(units, longest)]


def pairs_of(a: list[Unit], b: list[Unit]) -> list[tuple[int, int]]:
    """Positions of equal units, rising on both sides: equal ends, then units that both sides have once, and so on between them."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {u: n for n, u in enumerate(b[k:m], k) if in_b[u] == 1 and in_a[u] == 1}
        met = [(n, place[u]) for n, u in enumerate(a[i:j], i) if u in place]
        # Longest rising run of places in b.
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for n, (_, y) in enumerate(met):
            at = bisect_left(tails, y)
            tails[at : at + 1] = [y]
            ends[at : at + 1] = [n]
            back.append(ends[at - 1] if at else -1)
        n, chain = ends[-1] if ends else -1, []
        while n >= 0:
            chain.append(met[n])
            n = back[n]
        if not chain:
            continue
        chain.reverse()
        out.extend(chain)
        for (x, y), (u, v) in zip([(i - 1, k - 1), *chain], [*chain, (j, m)], strict=True):
            if x + 1 < u and y + 1 < v:
                todo.append((x + 1, u, y + 1, v))
    return sorted(out)


@dataclass
class Shape:
    """A folded stream. items: (unit, repeated); slots: for each item, the blocks of each of its slots (a repeated group is one slot)."""

    items: list[tuple[Unit, bool]]
    slots: list[list[list[int]]]

    @staticmethod
    def of(tokens: list[str]) -> Shape:
        items, slots, at, block = [], [], 0, 0
        for unit, repeated, n in _folded([(t,) for t in tokens]):
            texts = tokens[at : at + n].count("#")
            own = list(range(block, block + texts))
            items.append((unit, repeated))
            slots.append(([own] if own else []) if repeated else [[x] for x in own])
            at, block = at + n, block + texts
        return Shape(items, slots)

    def texts(self, page: Page) -> list[list]:
        """For each slot of each item its text: digest, characters by container."""
        told = []
        for slots in self.slots:
            own = []
            for blocks in slots:
                sizes: dict[str, int] = {}
                for path, text, links, out, _ in (page.blocks[x] for x in blocks):
                    if not out and 2 * links <= len(text):
                        sizes[path] = sizes.get(path, 0) + len(text)
                own.append([_digest("\n".join(page.blocks[x][1] for x in blocks)), sizes])
            told.append(own)
        return told


def _summed(a: dict[str, int], b: dict[str, int]) -> dict[str, int]:
    out = dict(a)
    for path, n in b.items():
        out[path] = out.get(path, 0) + n
    return out


def _one(slots: list) -> list:
    """All slots of an item as one that varies."""
    sizes: dict[str, int] = {}
    for _, own in slots:
        sizes = _summed(sizes, own)
    return [[None, sizes]] if slots else []


def _common(a: list, b: list) -> list:
    """Slots of an item from both sides: the text that they share or None, and the characters of both."""
    if len(a) != len(b):
        return _one(a + b)
    return [[x[0] if x[0] == y[0] else None, _summed(x[1], y[1])] for x, y in zip(a, b, strict=True)]


class Wrapper:
    """items: [unit, repeated, pages that have it, slots]; a slot is [digest of its text or None where it varies, characters by container]."""

    def __init__(self) -> None:
        self.items: list[list] = []
        self.pages = 0
        self.distinct: set[str] = set()  # the least MIN_PAGES digests of pages
        self.streams: dict[tuple[str, ...], tuple[Shape, list[list], list[int]]] = {}  # not yet aligned

    def add(self, page: Page) -> None:
        self.distinct = _least({*self.distinct, page.digest})
        stream = tuple(page.tokens)
        met = self.streams.get(stream)
        if met:
            texts = met[0].texts(page)
            met[1][:] = [_common(x, y) for x, y in zip(met[1], texts, strict=True)]
            met[2][0] += 1
        else:
            shape = Shape.of(page.tokens)
            self.streams[stream] = (shape, shape.texts(page), [1])
            if len(self.streams) >= MAX_STREAMS:
                self.align()

    def align(self) -> None:
        """The streams met so far go into the items."""
        for shape, texts, (n,) in self.streams.values():
            self._join([[u, r, n, t] for (u, r), t in zip(shape.items, texts, strict=True)], n)
        self.streams.clear()

    def merge(self, other: Wrapper) -> None:
        self.align()
        other.align()
        self._join(other.items, other.pages)
        self.distinct = _least(self.distinct | other.distinct)

    def _join(self, items: list[list], pages: int) -> None:
        both = _align(self.items, items) if self.pages and pages else self.items + items
        self.pages += pages
        self.items = [x for x in both if x[2] >= SUPPORT * self.pages]

    def constant(self) -> set[tuple[int, int]]:
        """Item and slot of each slot that has the same text on all pages, of which at least MIN_PAGES must differ."""
        self.align()
        if len(self.distinct) < MIN_PAGES:
            return set()
        return {(i, j) for i, (_, _, n, slots) in enumerate(self.items) if n == self.pages for j, (text, _) in enumerate(slots) if text}

    def varying(self) -> dict[str, int]:
        """Characters of the slots that vary by container; of all slots if none varies."""
        held, every, left = self.constant(), {}, {}
        for i, (_, _, _, slots) in enumerate(self.items):
            for j, (_, sizes) in enumerate(slots):
                every = _summed(every, sizes)
                if (i, j) not in held:
                    left = _summed(left, sizes)
        return left if any(left.values()) else every

    def fixed(self) -> str:
        """What matching needs, as json: items with the digest of each constant slot; empty without any."""
        held = self.constant()
        if not held:
            return ""
        return json.dumps([[u, r, [t[0] if (i, j) in held else None for j, t in enumerate(slots)]] for i, (u, r, _, slots) in enumerate(self.items)])

    def expression(self) -> str:
        """The wrapper as text: units in brackets, + repeated, ? optional, # a text slot."""
        self.align()
        return " ".join(("(" + " ".join(u) + ")" if len(u) > 1 or r or n < self.pages else u[0]) + "+" * r + "?" * (n < self.pages) for u, r, n, _ in self.items)

    def dump(self) -> str:
        self.align()
        return json.dumps([self.items, self.pages, sorted(self.distinct)])

    @staticmethod
    def load(data: str) -> Wrapper:
        out = Wrapper()
        items, out.pages, distinct = json.loads(data)
        out.distinct = set(distinct)
        out.items = [[tuple(u), r, n, t] for u, r, n, t in items]
        return out


class Matcher:
    """Pages of a host against its wrapper (`Wrapper.fixed`)."""

    def __init__(self, fixed: str):
        self.items = [(tuple(u), r, t) for u, r, t in json.loads(fixed)] if fixed else []
        self.met: dict[tuple[str, ...], list[tuple[list[int], str]]] = {}

    def constant(self, page: Page) -> set[int]:
        """Blocks of the page that stand in a constant slot of the wrapper and hold its text."""
        if not self.items:
            return set()
        stream = tuple(page.tokens)
        known = self.met.get(stream)
        if known is None:
            known = []
            shape = Shape.of(page.tokens)
            for i, k in pairs_of([x[0] for x in self.items], [x[0] for x in shape.items]):
                (_, repeated, texts), slots = self.items[i], shape.slots[k]
                if repeated == shape.items[k][1] and len(texts) == len(slots):
                    known.extend((blocks, text) for blocks, text in zip(slots, texts, strict=True) if text)
            if len(self.met) >= MAX_STREAMS:
                self.met.clear()
            self.met[stream] = known
        return {x for blocks, text in known if _digest("\n".join(page.blocks[x][1] for x in blocks)) == text for x in blocks}


def _digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def _least(digests: set[str]) -> set[str]:
    return set(sorted(digests)[:MIN_PAGES]) if len(digests) > MIN_PAGES else digests


def _align(a: list[list], b: list[list]) -> list[list]:
    """Items of both sides in one order; those of one side only are had by its pages only."""
    out: list[list] = []

    def lone(items: list[list]) -> None:
        for unit, repeated, n, slots in items:
            if out and out[-1][0] == unit:
                # The same unit again: a repeated group, whose texts are one slot.
                out[-1][1:] = [True, max(out[-1][2], n), _one(out[-1][3] + slots)]
            else:
                out.append([unit, repeated, n, slots])

    i = k = 0
    for x, y in [*pairs_of([u[0] for u in a], [u[0] for u in b]), (len(a), len(b))]:
        lone(a[i:x])
        lone(b[k:y])
        if x < len(a):
            (unit, r, n, p), (_, s, m, q) = a[x], b[y]
            out.append([unit, r or s, n + m, _common(p, q) if r == s else _one(p + q)])
        i, k = x + 1, y + 1
    return out


def main_path(paths: dict[str, int]) -> str:
    """The container of the varying text: article or main if they hold some, else the deepest with 70 percent."""
    total = sum(paths.values())
    if not total:
        return ""
    sums: dict[str, int] = {}
    for path, n in paths.items():
        steps = path.split("/")
        for i in range(2, len(steps) + 1):
            at = "/".join(steps[:i])
            sums[at] = sums.get(at, 0) + n
    for wanted in ("article", "main"):
        named = [p for p in sums if re.match(wanted + r"\b", p.rpartition("/")[2]) or "@" + wanted in p.rpartition("/")[2]]
        if named:
            return max(named, key=lambda p: (sums[p], -len(p), p))
    deep = [p for p, n in sums.items() if n >= 0.7 * total]
    return max(deep, key=lambda p: (p.count("/"), p)) if deep else ""


def _inside(path: str, main: str) -> bool:
    return path == main or path.startswith(main + "/")


def cut(page: Page, main: str, matcher: Matcher | None = None) -> str:
    if not main or not any(_inside(p, main) for p, _, _, _, inner in page.blocks if not inner):
        own: dict[str, int] = {}
        for path, text, links, out, _ in page.blocks:
            if not out and 2 * links <= len(text):
                own[path] = own.get(path, 0) + len(text)
        main, matcher = main_path(own), None
    if main:
        inside = [(i, t) for i, (p, t, _, _, inner) in enumerate(page.blocks) if not inner and _inside(p, main)]
    else:
        inside = [(i, t) for i, (_, t, _, out, _) in enumerate(page.blocks) if not out]
    constant = matcher.constant(page) if matcher else set()
    # Without any varying text, the constant one is the page's text.
    return "\n".join([t for i, t in inside if i not in constant] or [t for _, t in inside])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host among the rows (host, html) so far; many hosts are handed on in between."""
    found: dict[str, Wrapper] = {}

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array([w.dump() for w in found.values()], pa.string())], names=["host", "wrapper"])

    for batch in batches:
        for host, source in zip(batch.column(0), batch.column(1), strict=True):
            page = Page(source.as_py() or "")
            if page.blocks:
                found.setdefault(host.as_py(), Wrapper()).add(page)
        if len(found) > MAX_HOSTS:
            yield told()
            found.clear()
    if found:
        yield told()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for parts in batch.column(1):
            one, *rest = sorted(parts.as_py())
            total = Wrapper.load(one)
            for part in rest:
                total.merge(Wrapper.load(part))
            out.append(total.dump())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["host", "wrapper"])


def _final(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [Wrapper.load(x.as_py()) for x in batch.column(1)]
        mains = [main_path(w.varying()) for w in rows]
        # An article or main element is taken as it is; elsewhere pages are matched.
        fixed = ["" if re.search(r"/(article|main)\b[^/]*$", m) else w.fixed() for w, m in zip(rows, mains, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mains, pa.string()), pa.array(fixed, pa.string()), pa.array([w.expression() for w in rows], pa.string()), pa.array([w.pages for w in rows], pa.int64())], names=["host", "main", "fixed", "wrapper", "pages"])


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, main (container path), fixed (json, for matching), wrapper (expression) and pages of each host."""
    fed = pages.select(urlfilter.host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    parts = staged(fed.mapInArrow(_partial, "host string, wrapper string"), "wrappers")
    while True:
        most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return parts.mapInArrow(_final, "host string, main string, fixed string, wrapper string, pages long")
        salt = F.pmod(F.xxhash64("wrapper"), F.lit(-(-most // FAN_IN)))
        gathered = parts.groupBy("host", salt.alias("salt")).agg(F.collect_list("wrapper").alias("parts"))
        parts = staged(gathered.select("host", "parts").mapInArrow(_merged, "host string, wrapper string"), "wrappers")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages with `text` in place of the html column, and n_chars."""
    wrappers = staged(infer_wrappers(pages, url_col, html_col).select("host", "main", "fixed"), "wrappers")
    pages = pages.drop("text", "n_chars") if html_col != "text" else pages.drop("n_chars")
    rest = [c for c in pages.columns if c != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Matcher] = {}
        for batch in batches:
            texts = []
            for source, main, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                fixed = data.as_py() or ""
                if fixed not in seen:
                    if len(seen) > 100:
                        seen.clear()
                    seen[fixed] = Matcher(fixed)
                texts.append(cut(Page(source.as_py() or ""), main.as_py() or "", seen[fixed]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(3)], names=["text", "rest"])

    # The other columns travel as one, so none of their names can meet one used here.
    own = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.struct(F.lit(0).alias("none"))
    keyed = pages.select(urlfilter.host(F.col(url_col)).alias("host"), F.col(f"`{html_col}`").alias("html"), own.alias("rest"))
    # Spark broadcasts wrappers that are few; else it divides a host with most pages, as each page meets one row.
    fed = keyed.join(wrappers, "host", "left").select("html", "main", "fixed", "rest")
    done = fed.mapInArrow(run, f"text string, rest {keyed.schema['rest'].dataType.simpleString()}")
    return done.select(*(F.col(f"rest.`{c}`") for c in rest), "text", F.char_length("text").cast("long").alias("n_chars"))
