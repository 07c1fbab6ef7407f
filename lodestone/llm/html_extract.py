"""Main text of HTML pages by nearest-URL page differencing, with markup as a prior.

1. A page is cut into lines, one a block, by a tokenizer that follows HTML's rules for attributes, comments and raw
   text. Elements that are no article text by their meaning (navigation, forms, scripts, ..) give none, nor do those
   named so: names made of words such as sidebar, comments or ad-slot alone, on containers; a text element in an
   article is never dropped for its name. A form or a named container doesn't switch off the page's article, main or
   h1 if it holds it. What is left gets a zone: TEXT (paragraphs, headings, lists, tables and bare text of an article),
   LOOSE (other blocks of an article, what stands in it under a name with a word of noise, all of main, all of pages
   without either), OUT (beside an article or main).
2. Pages are ordered by (host, path, page_id), and each is paired with the nearest page before and the nearest page
   after it on its host whose lines aren't all the same: its nearest URLs. Ordering is a range-partitioned sort of line
   hashes, without texts. Runs of pages with equal lines are compared once. Runs at the edges of parts are settled in
   one small task over at most four runs a part, so a host of any size is many tasks, and pairs don't depend on how the
   rows were dealt.
3. Two pages' lines are aligned by their longest common subsequence. A short LOOSE or OUT line that either neighbour
   shares is the site's and is deleted. A long one (PROSE words) needs both neighbours, neither of which shares COPY
   percent of the page's words: neighbours that do are versions of the same article and tell nothing about its prose.
   TEXT lines stay: a passage that articles share is still text.
4. Lines that differencing left decide what the article is: OUT lines go if an article or main has text, unless long
   lines outside hold OUTWEIGH times its words, which makes it a teaser.
5. Pages with deletions are joined back to their html; that table is broadcast only if it is counted to be small.

Defined results: null html is empty; an empty page, or one with nothing left, has the empty text; null URLs and those
without a host pair with no page; repeated rows have equal lines, pair with the pages around them and get equal texts;
rows that share a page_id are pages of their own; an unclosed comment, raw element or tag at the end of a page is
dropped, a quote that never closes ends with its tag; an empty table gives an empty result; extra columns are never
read. Time is near linear in a page's size but for the alignment of lines that both pages have, which takes
lines * lines / 64 steps of machine words."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_ids, discard, map_arrow, written
from .url_filter import host_of, path_of

COPY, PROSE, OUTWEIGH = 80, 25, 3
BROADCAST_ROWS = 100_000
OUT, LOOSE, TEXT = range(3)

# Element and attribute names of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody tfoot thead tr ul".split()
)
SPACES = {"br", "td", "th", "img", "input", "wbr"}
CLOSES_P = BLOCKS - {"button", "caption", "legend", "li", "option", "summary", "tbody", "tfoot", "thead", "tr"}
INLINE = {"a", "b", "i", "em", "strong", "span", "u", "small", "font", "code", "sub", "sup", "mark", "q", "cite"}
#: Elements whose text in an article is the article's own.
OWN = set("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
DROPPED = set("aside button canvas datalist dialog footer head iframe menu nav noscript object script search select style svg template textarea title".split())
NOISE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside header footer masthead comment comments respond reply replies disqus share sharing social related recommended "
    "newsletter subscribe subscription signup login search form pagination pager widget toolbar skip".split()
)
TALK = {"comment", "comments", "respond", "reply", "replies", "disqus"}
#: Words that may stand beside those of NOISE in a name that means nothing else.
BESIDE = set(
    "area bar block bottom box button buttons card center column container content desktop fixed global group holder icon icons inner item items left link links list "
    "main mobile module outer page panel primary right row secondary section site slot sticky text thread title top unit wrap wrapper zone".split()
)
OTHERS = TALK | {"related", "recommended"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar"}

#: Kinds of elements. Wrappers give no text unless they hold the page's article, main or h1: FORM are forms, NAMED those
#: called by words of NOISE, OTHER those that usually hold articles of their own. DOUBT are no wrappers.
KEPT, DOUBT, FORM, NAMED, OTHER, HIDDEN = range(6)
MARKS = {"article": 1, "main": 2, "h1": 4}
#: What an open element makes of text in it: outside an article; in one, bare, in another block, in its header, in an
#: element of text, and under a name that is noise or not.
ELSEWHERE, BARE, BLOCK, HEADER, SPOKEN, DOUBTED = range(6)

# A value is quoted, or runs to white space or the tag's end; quotes elsewhere are part of names.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>""")
_SHORT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""([^\s=/][^\s=/]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@lru_cache(64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I)


@lru_cache(4096)
def _named(token: str) -> int:
    """What a class or id means: KEPT without words of NOISE, NAMED or OTHER if made of them and of BESIDE alone, else DOUBT."""
    words = {w.lower() for w in _WORD.findall(token) if not w.isdigit()}
    found = words & NOISE
    if not found:
        return KEPT
    if not words <= NOISE | BESIDE:
        return DOUBT
    return OTHER if found & OTHERS else NAMED


@lru_cache(4096)
def _part(name: str, raw: str) -> int:
    """What an element's attributes make of it: KEPT, DOUBT, a wrapper (FORM, NAMED, OTHER) or HIDDEN."""
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}
    if not found:
        return KEPT
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return HIDDEN
    if name in ("html", "body", "main"):
        return KEPT
    role = found.get("role", "").lower()
    if name != "article" and role in ROLES:
        return FORM if role == "form" else HIDDEN
    kinds = [_named(token) for token in f"{found.get('class', '')} {found.get('id', '')}".split()]
    if name == "article":
        kinds = [k for k in kinds if k == OTHER]
    return max(kinds, default=KEPT)


def _state(name: str, around: int, doubt: bool) -> int:
    """What an element in an element of state ``around`` makes of its text."""
    if name == "article":
        return BARE
    if around in (ELSEWHERE, DOUBTED):
        return around
    if doubt:
        return DOUBTED
    if name in OWN or around == SPOKEN:
        return SPOKEN
    if name == "header" or around == HEADER:
        return HEADER
    return around if name == "section" or name not in BLOCKS else BLOCK


class _Reader:
    """The blocks of a page as they are read."""

    def __init__(self) -> None:
        self.blocks: list[tuple[list[tuple[str, int]], int, bool, bool]] = []  # pieces with their wrapper, state, in an article, in main
        self.piece: list[tuple[str, int]] = []
        self.stack: list[tuple[str, bool, bool, int]] = []  # open elements: whether they are off, whether wrappers, state
        self.open: dict[str, int] = {}
        self.kinds: list[int] = []  # of wrappers, with the one around each, and which of MARKS it holds
        self.around: list[int] = []
        self.holds: list[int] = []
        self.within, self.off, self.state = -1, 0, ELSEWHERE
        self.marked: list[tuple[str, int]] = []

    def flush(self) -> None:
        if self.piece:
            self.blocks.append((self.piece, self.state, self.open.get("article", 0) > 0, self.open.get("main", 0) > 0))
            self.piece = []

    def say(self, raw: str) -> None:
        if raw and not self.off and self.state != HEADER:
            self.piece.append((entities.unescape(raw) if "&" in raw else raw, self.within))

    def pop(self) -> None:
        name, off, wraps, _ = self.stack.pop()
        self.off -= off
        if wraps:
            self.within = self.around[self.within]
        self.open[name] -= 1
        self.state = self.stack[-1][3] if self.stack else ELSEWHERE

    def start(self, name: str, raw: str) -> None:
        if name in CLOSES_P and self.open.get("p"):
            while self.stack[-1][0] == "p" or self.stack[-1][0] in INLINE:
                done = self.stack[-1][0] == "p"
                self.pop()
                if done:
                    break
        if name == "li" and self.stack and self.stack[-1][0] == "li":
            self.pop()
        told = self.open.get("article", 0) > 0
        kind = _part(name, raw) if raw.strip(" /") else KEPT
        if name == "form" and kind == KEPT:
            kind = FORM
        if told and kind in (FORM, NAMED, OTHER) and (name in OWN or name not in BLOCKS):
            kind = DOUBT
        off = name in DROPPED or kind == HIDDEN or (name == "header" and not told)
        wraps = kind in (FORM, NAMED, OTHER) and not off and not self.off
        self.state = _state(name, self.state, kind == DOUBT)
        self.stack.append((name, off, wraps, self.state))
        self.open[name] = self.open.get(name, 0) + 1
        self.off += off
        if wraps:
            self.kinds.append(kind)
            self.around.append(self.within)
            self.holds.append(0)
            self.within = len(self.kinds) - 1
        if name in MARKS and not self.off:
            self.marked.append((name, self.within))
            if self.within >= 0:
                self.holds[self.within] |= MARKS[name]

    def end(self, name: str) -> None:
        if self.open.get(name):
            while True:
                done = self.stack[-1][0] == name
                self.pop()
                if done:
                    return


def _read(page: str) -> _Reader:
    r, at, until, pattern = _Reader(), 0, len(page), _TAG
    while at < until:
        begin = page.find("<", at)
        if begin < 0:
            r.say(page[at:])
            break
        follows = page[begin + 1 : begin + 2]
        if not (follows.isascii() and follows.isalpha()) and follows not in ("/", "!", "?"):  # a sign, no markup
            r.say(page[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            r.say(page[at:begin])
        tag = pattern.match(page, begin)
        if not tag:
            if follows == "!" and page.startswith("<!--", begin):
                end = begin + 4 if page.startswith(">", begin + 4) else begin + 5 if page.startswith("->", begin + 4) else page.find("-->", begin + 4)
                at = until if end < 0 else page.find(">", end) + 1
                continue
            end = page.find(">", begin)
            if end < 0:
                break
            named = follows.isalpha() or (follows == "/" and page[begin + 2 : begin + 3].isalpha())
            if named and pattern is _TAG:  # the rest of the page is one quoted value: values end with their tags from here on
                pattern = _SHORT
                at = begin
            else:
                at = end + 1
            continue
        at = tag.end()
        name = tag[2].lower()
        if name in BLOCKS:
            r.flush()
        elif name in SPACES:
            r.say(" ")
        if tag[1]:
            r.end(name)
        elif name in RAW:
            end = _end_of(name).search(page, at)
            at = end.end() if end else until
        elif name not in VOID and not tag[3].endswith("/"):
            r.start(name, tag[3])
    r.flush()
    return r


def lines(page: str) -> list[tuple[str, int]]:
    """(text, zone) of each block, in page order."""
    r = _read(page)
    for i in range(len(r.kinds) - 1, -1, -1):
        if r.around[i] >= 0:
            r.holds[r.around[i]] |= r.holds[i]
    bare = 0
    for name, around in r.marked:
        bare |= MARKS[name] if around < 0 else 0

    def cleared(lifted: list[bool]) -> list[bool]:
        """Whether a wrapper and all around it are lifted; the last is that of no wrapper."""
        clear: list[bool] = []
        for i, up in enumerate(lifted):
            clear.append(up and (r.around[i] < 0 or clear[r.around[i]]))
        return [*clear, True]

    def left(clear: list[bool]) -> list[tuple[str, int, bool, bool]]:
        found = ((" ".join("".join(t for t, around in pieces if clear[around]).split()), *where) for pieces, *where in r.blocks)
        return [x for x in found if x[0]]

    lifted = [(kind == FORM and held & 3 > 0) or (kind != OTHER and held & ~bare > 0) for kind, held in zip(r.kinds, r.holds, strict=True)]
    clear = cleared(lifted)
    kept = left(clear)
    if not kept and r.marked:  # nothing else is on the page
        clear = cleared([held > 0 for held in r.holds])
        kept = left(clear)
    # An article that only stands in wrappers with names of other parts adds to the rest and doesn't replace it.
    forms = cleared([up and kind == FORM for up, kind in zip(lifted, r.kinds, strict=True)])
    if any(name == "article" and forms[around] for name, around in r.marked) and any(x[2] for x in kept):
        return [(x[0], OUT if not x[2] else TEXT if x[1] in (SPOKEN, BARE) else LOOSE) for x in kept]
    if any(x[3] for x in kept):
        return [(x[0], LOOSE if x[2] or x[3] else OUT) for x in kept]
    return [(x[0], LOOSE) for x in kept]


def n_words(text: str) -> int:
    return text.count(" ") + 1


def article(cut: list[tuple[str, int]], gone: Iterable[int] = ()) -> str:
    """The text of lines without those that differencing deletes."""
    gone = set(gone)
    rest = [x for i, x in enumerate(cut) if i not in gone]
    own = sum(n_words(t) for t, zone in rest if zone != OUT)
    beside = sum(n for n in (n_words(t) for t, zone in rest if zone == OUT) if n >= PROSE)
    if beside < max(1, OUTWEIGH * own):
        rest = [x for x in rest if x[1] != OUT]
    return "\n\n".join(t for t, _ in rest)


class Outline(NamedTuple):
    """A page's lines without their texts."""

    hashes: list[int]
    words: list[int]
    zones: list[int]


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def outline(cut: list[tuple[str, int]]) -> Outline:
    return Outline([_hash(t) for t, _ in cut], [n_words(t) for t, _ in cut], [z for _, z in cut])


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence with b.

    Common ends and lines that only one side has go first. The rest is aligned with a row of bits for each line of a:
    a zero marks a place of b at which the length grows. Every STRIDE-th row is kept, others are made again."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ours, theirs = set(a[head : len(a) - tail]), set(b[head : len(b) - tail])
    places = [i for i in range(head, len(a) - tail) if a[i] in theirs]
    x, y = [a[i] for i in places], [v for v in b[head : len(b) - tail] if v in ours]
    return [*range(head), *(places[i] for i in _aligned(x, y)), *range(len(a) - tail, len(a))]


def _aligned(x: list[int], y: list[int]) -> list[int]:
    if not x or not y:
        return []
    at: dict[int, list[int]] = {}
    for j, v in enumerate(y):
        at.setdefault(v, []).append(j)
    full = (1 << len(y)) - 1

    @lru_cache(1024)
    def mask(v: int) -> int:
        bits = bytearray(len(y) // 8 + 1)
        for j in at[v]:
            bits[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(bits, "little")

    def after(row: int, v: int) -> int:
        met = row & mask(v)
        return ((row + met) | (row - met)) & full

    stride = int(len(x) ** 0.5) + 1
    kept, row = [full], full
    for i, v in enumerate(x, 1):
        row = after(row, v)
        if i % stride == 0:
            kept.append(row)
    found: list[int] = []
    i, j, rows, first = len(x), len(y), [], len(x) + 1
    while i and j:
        if i < first or not rows:
            block = (i - 1) // stride
            first, rows, row = block * stride + 1, [], kept[block]
            for k in range(first, min(first + stride, len(x) + 1)):
                row = after(row, x[k - 1])
                rows.append(row)
        grown = ~rows[i - first] & ((1 << j) - 1)  # places up to j at which the length grows
        j = grown.bit_length()
        if not j:
            break
        if x[i - 1] == y[j - 1]:
            found.append(i - 1)
            j -= 1
        i -= 1
    return found[::-1]


def deletions(own: Outline, before: Outline | None, after: Outline | None) -> list[int]:
    """Places of the lines that belong to the site."""
    near = [set(common_lines(own.hashes, other.hashes)) for other in (before, after) if other is not None]
    if not near:
        return []
    every = sum(own.words)
    copies = any(100 * sum(own.words[i] for i in shared) >= COPY * every for shared in near)
    gone = []
    for i, (words, zone) in enumerate(zip(own.words, own.zones, strict=True)):
        if zone == TEXT:
            continue
        if any(i in shared for shared in near) if words < PROSE else len(near) == 2 and not copies and all(i in shared for shared in near):
            gone.append(i)
    return gone


class Run(NamedTuple):
    """Pages in a row with equal lines on one host. number: its place in its part; None: not to be judged here."""

    number: tuple[int, int] | None
    host: str
    lines: Outline


def judged(runs: Iterable[Run | None]) -> Iterator[tuple[Run, list[int]] | None]:
    """Each run with its deletions, by the nearest different runs of its host. Equal runs in a row are one. None passes
    through, so that a caller can put away what piles up during a long run."""

    def told(held: list[Run], before: Run | None, after: Run | None) -> Iterator[tuple[Run, list[int]]]:
        if any(r.number is not None for r in held):
            own = held[0]
            near = [x.lines if x is not None and x.host == own.host else None for x in (before, after)]
            gone = deletions(own.lines, *near)
            yield from ((r, gone) for r in held if r.number is not None)

    before, held = None, []
    for run in runs:
        if run is None:
            yield None
            continue
        if held and (run.host, run.lines.hashes) != (held[0].host, held[0].lines.hashes):
            yield from told(held, before, run)
            before, held = held[0], []
        held.append(run)
    if held:
        yield from told(held, before, None)


def row_key(page_id, url, html) -> list:
    """128 bits that name a row by its content; repeated rows share them."""
    parts = [x for c in (page_id.cast("string"), url, html) for x in (c, c.isNull())]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def outlines(pages: DataFrame) -> DataFrame:
    """(k1, k2, page_id, host, path, hashes, words, zones)"""
    url, html = F.col("url"), F.col("html")
    page_id = F.col("page_id").cast("bigint")
    k1, k2 = row_key(page_id, url, html)
    keyed = pages.select(k1.alias("k1"), k2.alias("k2"), page_id.alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), html.alias("html")).filter("host <> ''")
    names = ["k1", "k2", "page_id", "host", "path"]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            cut = [outline(lines(x.as_py()) if x.is_valid else []) for x in batch.column("html")]
            made = [pa.array([o[j] for o in cut], pa.list_(kind)) for j, kind in enumerate((pa.int64(), pa.int32(), pa.int8()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, "hashes", "words", "zones"])

    return map_arrow(keyed, batches, "k1 bigint, k2 bigint, page_id bigint, host string, path string, hashes array<bigint>, words array<int>, zones array<tinyint>")


_RUNS = "kind int, k1 bigint, k2 bigint, part int, run bigint, judged boolean, host string, hashes array<bigint>, words array<int>, zones array<tinyint>, gone array<int>"
_RUN_FIELDS = pa.schema([
    ("kind", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("part", pa.int32()), ("run", pa.int64()), ("judged", pa.bool_()), ("host", pa.string()),
    ("hashes", pa.list_(pa.int64())), ("words", pa.list_(pa.int32())), ("zones", pa.list_(pa.int8())), ("gone", pa.list_(pa.int32())),
])
_PAGE, _GONE, _EDGE = range(3)


def _local(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of a part by run, deletions of the runs inside it, and the two runs at either end for the edges."""
    part = TaskContext.get().partitionId()
    out: list[dict] = []
    ends: list[Run] = []  # the first two runs and the last two
    state = {"run": -1, "last": None}

    def runs() -> Iterator[Run | None]:
        for batch in stream:
            yield None
            for row in batch.select(["k1", "k2", "host", "hashes", "words", "zones"]).to_pylist():
                mark = (row["host"], row["hashes"])
                if mark != state["last"]:
                    state["run"], state["last"] = state["run"] + 1, mark
                    run = Run((part, state["run"]), row["host"], Outline(row["hashes"], row["words"], row["zones"]))
                    ends[:] = [*ends, run] if len(ends) < 4 else [*ends[:2], ends[3], run]
                    yield run
                out.append({"kind": _PAGE, "k1": row["k1"], "k2": row["k2"], "part": part, "run": state["run"]})

    # judged() is one run behind, and the last of a part comes when all rows are read
    for found in judged(runs()):
        if found is not None and found[1] and 0 < found[0].number[1] < state["run"]:
            out.append({"kind": _GONE, "part": part, "run": found[0].number[1], "gone": found[1]})
        if len(out) >= 4096 or found is None:
            yield pa.RecordBatch.from_pylist(out, schema=_RUN_FIELDS)
            out.clear()
    for run in ends:
        edge = run.number[1] in (0, state["run"])
        out.append({"kind": _EDGE, "part": part, "run": run.number[1], "judged": edge, "host": run.host, **run.lines._asdict()})
    yield pa.RecordBatch.from_pylist(out, schema=_RUN_FIELDS)


def _edges(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deletions of the runs at the ends of parts, from the runs of all parts' ends in order."""

    def runs() -> Iterator[Run]:
        for batch in stream:
            for row in batch.to_pylist():
                yield Run((row["part"], row["run"]) if row["judged"] else None, row["host"], Outline(row["hashes"], row["words"], row["zones"]))

    schema = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("gone", pa.list_(pa.int32()))])
    for run, gone in judged(runs()):
        if gone:
            yield pa.RecordBatch.from_pylist([{"part": run.number[0], "run": run.number[1], "gone": gone}], schema=schema)


def site_lines(pages: DataFrame) -> DataFrame:
    """(id struct<k1, k2>, gone array<int>), a written table: places of the lines to delete, for pages that have any."""
    cut = written(outlines(pages), "outlines")  # the sort samples it
    order = ["host", "path", "page_id", "k1", "k2"]
    local = written(map_arrow(cut.repartitionByRange(*order).sortWithinPartitions(*order), _local, _RUNS), "runs")
    ends = local.filter(F.col("kind") == _EDGE).select("part", "run", "judged", "host", "hashes", "words", "zones")
    # at most four runs a part
    settled = map_arrow(ends.coalesce(1).sortWithinPartitions("part", "run"), _edges, "part int, run bigint, gone array<int>")
    found = written(local.filter(F.col("kind") == _GONE).select("part", "run", "gone").unionByName(settled).withColumnRenamed("run", "id"), "run-lines")
    keyed = local.filter(F.col("kind") == _PAGE).select("k1", "k2", F.struct("part", "run").alias("at"))
    runs = written(found.select(F.struct("part", F.col("id").alias("run")).alias("id"), "gone"), "gone-runs")
    gone = written(by_ids(keyed, "at", runs, "inner", BROADCAST_ROWS).groupBy(F.struct("k1", "k2").alias("id")).agg(F.first("gone").alias("gone")), "site-lines")
    discard(cut, local, found, runs)
    return gone


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages (page_id, url, html)."""
    k1, k2 = row_key(F.col("page_id").cast("bigint"), F.col("url"), F.col("html"))
    keyed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.struct(k1.alias("k1"), k2.alias("k2")).alias("key"))
    joined = by_ids(keyed, "key", site_lines(pages), "left", BROADCAST_ROWS).select("page_id", "url", "html", "gone")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [article(lines(page.as_py()), off.as_py() or ()) if page.is_valid else "" for page, off in zip(batch.column("html"), batch.column("gone"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(joined, batches, "page_id bigint, url string, text string, n_chars bigint")
