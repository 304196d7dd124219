"""Main text of web pages through wrappers inferred per host.

A page's token stream is balanced (missing end tags are supplied) and read as
items: `["#", mark, chars]` a text, `["e", label, items]` an element, `["+",
items]` a repeated group, `["?", items]` an optional group; that is a union-free
regular expression. Repeats inside a page become groups first. A host's wrapper
starts as one page and is aligned with the next: equal labels are merged
recursively, a text that differs becomes a slot (its mark goes, its characters
add up), a mismatch becomes an optional group or joins a repeated one. Alignment
of wrappers with each other is the same operation, so every task folds its own
pages and the tasks' wrappers are merged in two steps; no task holds a host, and
every page takes part.

The wrapper decides. `plan` marks each place of the expression: places in
navigation, headers, footers, asides and forms go; so do places whose class or
role names them an advert, notice, comment or the like, unless that would leave
less than a tenth of the characters of what is around them; if a place of the
host is an article (or main) element with text, only what is inside stays; else
texts that are on every page and never vary are template, and slots stay. A page
is then matched against the expression, item by item, and each of its texts is
kept or not as the place that it matches.
"""

from __future__ import annotations

import hashlib
import html as entity
import json
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

# Element names of HTML and words of class, id and role names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What a page shows, if at all, by other means than text: raw to the end tag, or with elements inside.
_RAW = frozenset("script style textarea title template svg iframe noscript".split())
_HIDDEN = frozenset("head math object select datalist audio video canvas".split())
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
_AROUND = frozenset("nav footer aside form menu dialog button fieldset header label legend".split())
_WORDS = frozenset(
    "ad ads adsbygoogle adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright disclaimer disqus footer form "
    "header login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related "
    "replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets complementary contentinfo".split()
)
#: Ends of names that do not change what is meant (`ad-slot`), and starts of names that say what is absent or only present in the layout.
_PARTS = frozenset("area articles bar block box button buttons col column container content icons inner item items left links list outer panel posts right row section slot slots stories thread unit wrap wrapper".split())
_ABOUT = frozenset("has have hide hidden no not with without".split())
_CLOSED_BY = {"p": frozenset(), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)")
#: The rest of a tag: to a > outside of quotes, or else to the next > or <.
_QUOTED = re.compile(r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_PLAIN = re.compile(r"[^<>]*+")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in _RAW}
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_UNSEEN = re.compile(r"(?<![\w-])(?:hidden(?:\s*=\s*(?:\"(?:hidden)?\"|'(?:hidden)?'|hidden(?![\w-])))?(?=[\s/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"'>]{0,200}?display\s*:\s*none)", re.IGNORECASE)
_VALUES = re.compile(r"=\s*(?:\"[^\"]*+\"|'[^']*+')")
#: Levels of elements that a page's items have; what is deeper belongs to the last of them.
DEPTH = 200
# Levels of expressions and plans are walked by functions that call themselves, a few calls a level.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 40 * DEPTH))
#: Elements of text: an id on one is the anchor of a link, not the name of a part.
_TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figure figcaption section article main body".split())
#: On a section these ids name a part all the same.
_SECTIONS = frozenset("commentlist comments disqus footer menu nav navbar navigation related replies respond sidebar".split())
#: A text is template if it never varies over so many different pages.
PAGES = 3


class _Open:
    """label: None for an element whose items are those of the one around it, or
    are not kept."""

    __slots__ = ("name", "label", "items")

    def __init__(self, name: str, label: str | None, items: list):
        self.name, self.label, self.items = name, label, items


def _label(name: str, attributes: str) -> str:
    if not attributes or "=" not in attributes:
        return name
    names = set()
    for m in _ATTRIBUTE.finditer(attributes):
        mine = {"-".join(re.findall(r"[a-z]+", w)) for w in (m[2] or m[3] or m[4] or "").lower().split()}
        if m[1].lower() == "id" and name in _TEXTS:
            mine = {w for w in mine if name == "section" and _named(w) in _SECTIONS}
        names |= mine
    return ".".join([name, *sorted(names - {""})])


def _unseen(attributes: str) -> bool:
    """Whether an element's attributes hide it."""
    if "adsbygoogle" in attributes:  # whatever the element is
        return True
    if "idden" not in attributes and "none" not in attributes:
        return False
    m = _UNSEEN.search(attributes)
    if m is None or not m.group().lower().startswith("hidden"):
        return m is not None
    return bool(re.search(r"(?<![\w-])hidden(?![\w-])", _VALUES.sub("=x", attributes), re.IGNORECASE))  # and no other attribute's value


@lru_cache(100_000)
def _named(name: str) -> str:
    """The word of `_WORDS` that a class, id or role name ends with (`sidebar`,
    `site-header`, `ad-slot`), or "": names that only begin with one
    (`comments-open`) or tell of one (`has-sidebar`) are of something else."""
    words = name.split("-")
    while len(words) > 1 and words[-1] in _PARTS:
        words.pop()
    return words[-1] if words[-1] in _WORDS and not _ABOUT.intersection(words) else ""


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it is an end tag, name, attributes) of every tag;
    comments and raw elements have no name. Every sign is read a bounded number
    of times: once scans for closing quotes have failed over four times the page,
    tags end at the next > or <."""
    at, failed, limit = page.find("<"), 0, 4 * len(page) + 10_000
    while at >= 0:
        m, end = _TAG.match(page, at), at + 1
        if m:
            name = m[2].lower()
            rest = _QUOTED.match(page, m.end()) if failed < limit else None
            if rest is None or page[rest.end() : rest.end() + 1] != ">":
                if rest is not None:
                    failed += rest.end() - at + (len(page) - rest.end()) * (page[rest.end() : rest.end() + 1] in ('"', "'"))
                rest = _PLAIN.match(page, m.end())
            attributes, end = rest[0], rest.end() + (page[rest.end() : rest.end() + 1] == ">")
            if not m[1] and name in _RAW and not attributes.endswith("/"):
                close = _ENDS[name].search(page, end)
                end = close.end() if close else len(page)
                yield at, end, False, "", ""
            else:
                yield at, end, bool(m[1]), name, attributes
        elif page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            end = close + 3 if close >= 0 else len(page)
            yield at, end, False, "", ""
        elif page.startswith(("<!", "<?"), at):
            close = page.find(">", at)
            end = close + 1 if close >= 0 else len(page)
            yield at, end, False, "", ""
        at = page.find("<", end)


def parse(page: str) -> list:
    """Balanced items of a page: ["#", text] and ["e", label, items]. Inline
    elements are part of the text around them; hidden ones are left out. Elements
    in more than `DEPTH` others are no items: their texts are those of the last,
    but what goes by its tag or name goes there too."""
    root = _Open("", "", [])
    stack, text, at = [root], [], 0
    opened: Counter[str] = Counter()
    hidden, within = "", Counter()  # the element that hides, and those open in it

    def flush() -> None:
        if not text:
            return
        whole = "".join(text)
        text.clear()
        whole = " ".join((entity.unescape(whole) if "&" in whole else whole).split())
        if whole:
            stack[-1].items.append(["#", whole])

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            done = stack.pop()
            opened[done.name] -= 1
            if done.label is not None:
                stack[-1].items.append(["e", done.label, done.items])

    for start, end, ends, name, attributes in _tags(page):
        if start > at and not hidden:
            text.append(page[at:start])
        at = end
        if not name:
            continue
        if hidden:
            if hidden == "head" and not ends and name not in _IN_HEAD and name != "head":
                hidden = ""  # the body begins, with its tag or without
            elif not ends:
                within[name] += name not in _VOID and not attributes.endswith("/")
                continue
            elif within[name]:
                within[name] -= 1
                continue
            elif name == hidden:
                hidden = ""
                continue
            elif opened[name]:
                hidden = ""  # the element around it ends
            else:
                continue
        if not ends and name not in _VOID and not attributes.endswith("/") and (name in _HIDDEN or (attributes and name not in ("html", "body") and _unseen(attributes))):
            if name not in _INLINE:
                flush()
            hidden = name
            within.clear()
            continue
        if name in _INLINE:
            if name == "br":
                text.append(" ")
            continue
        if ends:
            if opened[name]:
                close(max(d for d in range(len(stack) - 1, 0, -1) if stack[d].name == name) if stack[-1].name != name else len(stack) - 1)
            else:
                flush()
            continue
        if stack[-1].name == "p":
            close(len(stack) - 1)
        elif name in _CLOSED_BY and stack[-1].name in _CLOSED_BY[name]:
            close(len(stack) - 1)
        else:
            flush()
        if name not in _VOID and not attributes.endswith("/"):
            label, items = _label(name, attributes), []
            if len(stack) > DEPTH:
                goes = name in _AROUND or any(map(_named, label.split(".")[1:]))
                label, items = None, [] if goes else stack[-1].items
            stack.append(_Open(name, label, items))
            opened[name] += 1
    if at < len(page) and not hidden:
        text.append(page[at:])
    close(1)
    return root.items


def _core(item: list) -> str:
    """What two items must share to be merged."""
    if item[0] == "#":
        return "#"
    if item[0] == "e":
        return item[1]
    return " ".join(map(_core, item[1]))


def _joined(a: list, b: list) -> list:
    """One item for two of the same core."""
    repeated, optional = a[0] == "+" or b[0] == "+", a[0] == "?" or b[0] == "?"
    body_a, body_b = (x[1] if x[0] in "+?" else [x] for x in (a, b))
    repeated = repeated or any(x[0] == "?" and len(x[1]) == 1 and x[1][0][0] == "+" for x in (a, b))
    body_a, body_b = (x[0][1] if len(x) == 1 and x[0][0] == "+" else x for x in (body_a, body_b))
    body = []
    for x, y in zip(body_a, body_b):
        if x == y:
            body.append(x)
        elif x[0] == "#" and y[0] == "#":
            body.append(["#", x[1] if x[1] == y[1] else None, x[2] + y[2]])
        elif x[0] == "e" and y[0] == "e":
            body.append(["e", x[1], align(x[2], y[2])])
        else:
            body.append(_joined(x, y))
    if repeated:
        body = [["+", body]]
    return ["?", body] if optional else body[0] if len(body) == 1 else ["+", body]


def _optional(item: list) -> list:
    return item if item[0] == "?" else ["?", [item]]


def _lengths(p: list, q: list) -> list[int]:
    """The longest common subsequence's length of p and each start of q, by rows
    of bits."""
    places: dict[str, list[int]] = {}
    for j, core in enumerate(q):
        places.setdefault(core, []).append(j)
    held: dict[str, int] = {}
    every = row = (1 << len(q)) - 1
    for core in p:
        if core not in places:
            continue
        mask = held.get(core)
        if mask is None:
            bits = bytearray(len(q) // 8 + 1)
            for j in places[core]:
                bits[j >> 3] |= 1 << (j & 7)
            mask = int.from_bytes(bits, "little")
            if len(places[core]) > 64:
                held[core] = mask
        both = row & mask
        row = ((row + both) | (row - both)) & every
    out = [0]
    for bit in reversed(f"{row:0{len(q)}b}"):
        out.append(out[-1] + (bit == "0"))
    return out


def _matches(p: list, q: list) -> list[tuple[int, int]]:
    """The places of a longest common subsequence, in linear space (Hirschberg)."""
    if not p or not q:
        return []
    if len(p) == 1:
        return [(0, q.index(p[0]))] if p[0] in q else []
    half = len(p) // 2
    left, right = _lengths(p[:half], q), _lengths(p[half:][::-1], q[::-1])
    cut = max(range(len(q) + 1), key=lambda j: left[j] + right[len(q) - j])
    return _matches(p[:half], q[:cut]) + [(half + i, cut + j) for i, j in _matches(p[half:], q[cut:])]


def align(a: list, b: list) -> list:
    """The most specific expression here for two item sequences."""
    if a == b:
        return a
    p, q = [_core(x) for x in a], [_core(x) for x in b]
    low, end = 0, 0
    while low < min(len(p), len(q)) and p[low] == q[low]:
        low += 1
    while end < min(len(p), len(q)) - low and p[-1 - end] == q[-1 - end]:
        end += 1
    pairs = [(low + i, low + j) for i, j in _matches(p[low : len(p) - end], q[low : len(q) - end])]
    out, i, j = [], 0, 0
    tail = [(len(p) - end + k, len(q) - end + k) for k in range(end)]
    for x, y in [*((k, k) for k in range(low)), *pairs, *tail, (len(p), len(q))]:
        out += [_optional(item) for item in (*a[i:x], *b[j:y])]
        if x < len(p):
            out.append(_joined(a[x], b[y]))
        i, j = x + 1, y + 1
    return _grouped(out)


def _below(items: list) -> set[str]:
    """The cores of an element's own items, groups opened."""
    out: set[str] = set()
    for x in items:
        out |= _below(x[1]) if x[0] in "+?" else {_core(x)}
    return out


def _alike(a: list, b: list) -> bool:
    """Whether two items of one core can repeat each other: elements that share
    more than half of what they hold."""
    if a[0] != "e" or b[0] != "e":
        return True
    p, q = _below(a[2]), _below(b[2])
    return p == q or 2 * len(p & q) > max(len(p), len(q))


def _grouped(items: list) -> list:
    """Neighbours that repeat, alone or in twos and threes, as repeated groups."""
    for period in (1, 2, 3):
        names = [_core(x) for x in items]
        if len(set(names)) == len(names):
            return items
        out, at = [], 0
        while at < len(items):
            cores, end, body = names[at : at + period], at + period, items[at : at + period]
            if len(cores) == period and (period == 1 or len(set(cores)) > 1) and cores != ["#"]:
                while names[end : end + period] == cores and all(map(_alike, body, items[end : end + period])):
                    body = [_joined(x, y) for x, y in zip(body, items[end : end + period])]
                    end += period
            if end > at + period:
                body = body[0][1] if period == 1 and body[0][0] == "+" else body
                out.append(["+", body])
                at = end
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def expression(items: list) -> list:
    """The expression of one page: texts as short marks, repeats as groups."""
    return _grouped([["#", zlib.crc32(x[1].encode("utf-8", "surrogatepass")), len(x[1])] if x[0] == "#" else ["e", x[1], expression(x[2])] for x in items])


class Plan:
    """What the places of one level of a wrapper mean. cores: what an item must
    share to match; loops: for each place the repeated groups around it, as
    ranges; acts: for a text (whether it varies), for an element its plan, or
    None if it goes; inside: whether the level is in an article."""

    __slots__ = ("cores", "loops", "acts", "inside")

    def __init__(self, inside: bool):
        self.cores, self.loops, self.acts, self.inside = [], [], [], inside

    def place(self, core: str, after: int) -> int:
        """The place of the next item when the last one was at `after`: further
        on in its groups, or at their start again, or anywhere; -1 if none."""
        for low, high in self.loops[after] if after >= 0 else ():
            for at in chain(range(after + 1, high), range(low, after + 1)):
                if self.cores[at] == core:
                    return at
        for at in chain(range(after + 1, len(self.cores)), range(after + 1)):
            if self.cores[at] == core:
                return at
        return -1


def _mass(items: list) -> int:
    """Characters of the texts, without what its tag takes out."""
    total, waiting = 0, [items]
    while waiting:
        for x in waiting.pop():
            if x[0] == "#":
                total += x[2]
            elif x[0] != "e":
                waiting.append(x[1])
            elif x[1].partition(".")[0] not in _AROUND:
                waiting.append(x[2])
    return total


def _holds(items: list) -> bool:
    """Whether an article is among the items or below."""
    waiting = [items]
    while waiting:
        for x in waiting.pop():
            if x[0] == "e":
                if x[1].partition(".")[0] in ("article", "main", "body"):
                    return True
                waiting.append(x[2])
            elif x[0] != "#":
                waiting.append(x[1])
    return False


def _titled(items: list) -> bool:
    """Whether a heading of the first level is among the items or below."""
    waiting = [items]
    while waiting:
        for x in waiting.pop():
            if x[0] == "e" and x[1].partition(".")[0] == "h1":
                return True
            waiting.append(x[2] if x[0] == "e" else x[1] if x[0] in "+?" else [])
    return False


def _goes(label: str, items: list, inside: bool, around: int) -> bool:
    """Whether a place is none of the main text. An article's own header is part
    of it, and an article in an article may be a comment. `around`: the
    characters of the level that the place is on."""
    name, *names = label.split(".")
    if name in _AROUND:
        return name != "header" or not inside
    found = {w for w in map(_named, names) if w and not (w == "header" and inside)}
    if name in ("body", "main") or not found:
        return False
    if found == {"header"} and "site" not in "-".join(names).split("-") and _titled(items):
        return False
    if not inside and (name == "article" or _holds(items)):
        return False
    return 10 * (around - _mass(items)) >= around


def plan(wrapper: list, pages: int) -> tuple[Plan, bool]:
    """The plan of a host's wrapper, and whether it has an article."""
    article, varies = False, False

    def level(items: list, inside: bool, always: bool) -> Plan:
        out, around = Plan(inside), _mass(items)

        def walk(items: list, loops: tuple, always: bool) -> None:
            nonlocal article, varies
            for x in items:
                if x[0] in "+?":
                    low = len(out.cores)
                    walk(x[1], loops, always and x[0] == "+")
                    if x[0] == "+":
                        for at in range(low, len(out.cores)):
                            out.loops[at] = (*out.loops[at], (low, len(out.cores)))
                    continue
                act = None
                if x[0] == "#":
                    act = x[1] is None or not always or pages < PAGES
                    varies = varies or act
                elif not _goes(x[1], x[2], inside, around):
                    own = x[1].partition(".")[0] in ("article", "main")
                    article = article or (own and _mass(x[2]) > 0)
                    act = level(x[2], inside or own, always)
                out.cores.append(_core(x))
                out.loops.append(())
                out.acts.append(act)

        walk(items, (), always)
        return out

    return level(wrapper, False, True), article


def main_text(page: str | None, rules: tuple[Plan, bool]) -> str:
    """The page's texts at the places that the plan keeps. A page without its
    host's article, or of template texts only, gives all texts of its places."""
    items, (whole, article) = parse(page or ""), rules

    def read(only_inside: bool, only_slots: bool) -> list[str]:
        out: list[str] = []

        def walk(items: list, level: Plan) -> None:
            after = -1
            for x in items:
                core = "#" if x[0] == "#" else x[1]
                at = level.place(core, after)
                act = level.acts[at] if at >= 0 else True if x[0] == "#" else None
                after = at if at >= 0 else after
                if x[0] == "#":
                    if level.inside or (not only_inside and (act or not only_slots)):
                        out.append(x[1])
                elif act is not None:
                    walk(x[2], act)
                elif at < 0:
                    walk([x], plan(expression([x]), 1)[0])

        walk(items, whole)
        return out

    return "\n".join(read(article, True) or read(False, True) or read(False, False))


_WRAPPER = "host string, wrapper string, seen array<bigint>"


def _digest(items: list) -> int:
    """Equal for copies of a page."""
    return int.from_bytes(hashlib.blake2b(repr(items).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _fold(rows: Iterator[tuple[str, list, list[int]]], most: int) -> Iterator[pd.DataFrame]:
    """Aligns the wrappers of each host as they come, `most` hosts at a time.
    Digests of different pages are kept up to `PAGES`."""
    held: dict[str, tuple[list, list[int]]] = {}

    def out() -> pd.DataFrame:
        done = [(host, json.dumps(w, separators=(",", ":"), ensure_ascii=False), seen) for host, (w, seen) in held.items()]
        held.clear()
        return pd.DataFrame(done, columns=["host", "wrapper", "seen"])

    for host, wrapper, seen in rows:
        if host in held:
            wrapper, seen = align(held[host][0], wrapper), list(dict.fromkeys([*held[host][1], *seen]))[:PAGES]
        elif len(held) >= most:
            yield out()
        held[host] = (wrapper, seen)
    yield out()


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages) from (host, html): one wrapper a host, and how many
    different pages it is of, `PAGES` at most. Copies count once."""

    def of_pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed = ((h, parse(t or "")) for f in frames for h, t in zip(f["host"], f["html"]))
        yield from _fold(((h, expression(x), [_digest(x)]) for h, x in parsed), 2000)

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _fold(((h, json.loads(w), [int(x) for x in seen]) for f in frames for h, w, seen in zip(f["host"], f["wrapper"], f["seen"])), 1)

    def merged(parts: DataFrame, *keys: str) -> DataFrame:
        same = parts.groupBy("host", "wrapper", *keys).agg(F.slice(F.array_distinct(F.flatten(F.collect_set("seen"))), 1, PAGES).alias("seen"))
        return same.repartition("host", *keys).sortWithinPartitions("host", *keys, "wrapper").select("host", "wrapper", "seen").mapInPandas(merge, _WRAPPER)

    parts = pages.select("host", "html").mapInPandas(of_pages, _WRAPPER)
    salted = merged(parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(64))), "salt")
    return merged(salted).select("host", "wrapper", F.size("seen").alias("pages"))


#: Characters of wrappers that are sent to every executor at most.
BROADCAST_CHARS = 8_000_000
#: Characters of wrappers whose plans a Python worker keeps.
KEPT_CHARS = 4_000_000


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page of (page_id, url, html).

    Null and empty html gives an empty text; null urls share one host. Other
    columns are ignored; repeated rows stay repeated. Wrappers go to all
    executors if they are few characters together, else the pages meet them in
    a shuffle join.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^\w+://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))
    hosted = pages.select(F.col("page_id"), "url", "html", host.alias("host"))
    wrappers = settle(infer(hosted))
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    joined = hosted.join(F.broadcast(wrappers) if size <= BROADCAST_CHARS else wrappers, "host", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[Plan, bool]] = {}
        size = 0
        for frame in frames:
            texts = []
            for host, page, wrapper, n in zip(frame["host"], frame["html"], frame["wrapper"], frame["pages"]):
                if host not in known:
                    if size > KEPT_CHARS:
                        known.clear()
                        size = 0
                    known[host] = plan(json.loads(wrapper), n)
                    size += len(wrapper)
                texts.append(main_text(page, known[host]))
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = pages.schema["page_id"].dataType
    rows = joined.select(F.col("page_id").cast("string"), "url", "html", "host", "wrapper", "pages")
    out = rows.mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(kind))
