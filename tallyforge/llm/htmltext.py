"""Main text of web pages, with a suffix array over the pages of each host.

A page is cut into blocks of text. Markup is one kind of evidence: blocks inside of
menus, headers, footers, sidebars, notices, adverts, forms and comments go, and
if the page marks its article (``article``, else ``main``), only what is inside
can be main text. The host is the other: the token streams of its pages, all blocks
in page order, are concatenated, their suffix array is built, and runs of at least
DEPTH tokens that repeat on enough distinct pages are found. Blocks covered by such
runs from mark to mark are boilerplate, in pages that mark an article and in pages
that don't; all others, the unique runs, are kept whole. Inside of an article a run
has to repeat on more pages than elsewhere, and a page that would lose most of its
article that way is a copy with boilerplate nowhere, so it keeps all.

Pages with equal main text count once, and so do those with hardly a word of their
own that share a long block, so that copies and near copies don't remove each other. Pages are
counted over their whole host, however large. A host of more than 2 * SECTION characters
is dealt over parts by a hash of the pages' main text; each part has its own array, and
parts tell each other by hashes which runs of DEPTH tokens and which blocks they hold:
first by a few bits of each hash, then by whole hashes of what another part may hold too,
then, for what more than one page holds, on how many pages that are no near copies. So a host with a third of all pages is spread over all tasks, no task holds
more than a part, and what is decided doesn't depend on how a host is dealt.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, written

#: Least tokens of a repeated run, marks between blocks included.
DEPTH = 6
#: Least number and share of a host's distinct pages that hold a repeated run, outside of marked articles and inside.
PAGES, SHARE = 3, 0.2
INSIDE_PAGES, INSIDE_SHARE = 5, 0.5
#: Pages with a lesser share of words of their own are near copies, if the longest block they share has so many words.
NEAR, BODY = 0.2, 20
#: Half of the characters from which a host is dealt over parts, of about so many characters each or one page.
SECTION = 2_000_000

# What a tag holds is matched without a way back, as it can be read in one way only.
_TOKENS = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^'\">]++)*+)>|<[!?][^>]*>|[^<]+|<", re.S)
_MARKS = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup or not shown.
_RAW = frozenset("script style template noscript textarea title iframe svg object canvas audio video xmp noframes".split())
_DROPPED = frozenset("nav footer aside button select menu dialog fieldset datalist".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tooltip".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations "
    "comment comments disqus replies respond toolbar widget login search skip pagination pager hidden copyright disclaimer alert".split()
)
#: Further parts of the names above, as in site-footer or cookie-box. A class or id with any other part says nothing.
_PARTS = frozenset(
    "site main top page global primary secondary left right bottom container wrapper wrap box bar block section list area inner outer module unit slot group panel "
    "item items link links button buttons icon icons input posts articles stories news header head".split()
)
#: An open one ends where the other begins.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table div section article main body td th".split())
#: How surely a wrapper is no main text: a form (which can wrap a whole page), a name, an element made for it.
FORM, NAMED, MADE = 1, 2, 3


def _named(value: str) -> bool:
    """Whether one of the classes or ids, as a whole, names something beside the main text."""
    for name in value.split():
        parts = re.split("[-_]+", name)
        if not _NAMES.isdisjoint(parts) and all(p in _NAMES or p in _PARTS for p in parts):
            return True
    return False


def _unwanted(tag: str, attributes: str, inside: bool) -> int:
    """How surely an element's name or attributes mark what isn't main text; 0 if they don't."""
    if tag in _DROPPED or tag == "header" and not inside:
        return MADE
    found = FORM if tag == "form" else 0
    if not attributes or tag in ("html", "body", "main"):
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true":
            return MADE
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return MADE
        if name == "role" and value in _ROLES:
            found = max(found, FORM if value == "form" else NAMED)
        elif name in ("class", "id") and (tag != "article" or inside) and _named(value):
            found = NAMED
    return found


class _Ends:
    """Whether a tag that begins at a place is ever closed: by a > outside of quotes, told for all places from the page's end."""

    def __init__(self, page: str):
        self.places = [m.start() for m in _MARKS.finditer(page)]
        n = len(self.places)
        closed = [False] * (n + 1)
        later = {'"': n, "'": n}
        for k in range(n - 1, -1, -1):
            mark = page[self.places[k]]
            if mark == ">":
                closed[k] = True
            else:
                pair = later[mark]
                closed[k] = pair < n and closed[pair + 1]
                later[mark] = k
        self.closed = closed

    def __call__(self, at: int) -> bool:
        return self.closed[bisect_left(self.places, at)]


class _Stack(list):
    """Open elements (tag, state), and for each tag where its open ones are."""

    def __init__(self):
        super().__init__()
        self.where: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, tag: str, state: tuple[str, int, int]) -> None:
        self.where.setdefault(tag, []).append(len(self))
        if tag in _SCOPE:
            self.scopes.append(len(self))
        self.append((tag, state))

    def last(self, tag: str) -> int:
        own = self.where.get(tag)
        return own[-1] if own else -1

    def cut(self, k: int) -> list:
        """Take the elements from k on away."""
        gone = self[k:]
        del self[k:]
        for tag, _ in gone:
            self.where[tag].pop()
            if tag in _SCOPE:
                self.scopes.pop()
        return gone


def blocks(page: str) -> list[tuple[str, int, int, str]]:
    """(place, around, inside, text) of each block in order.

    The place is article, main or other; ``around`` and ``inside`` tell how surely
    wrappers around the place, and those inside of it, are no main text.
    """
    out: list[tuple[str, int, int, str]] = []
    stack = _Stack()
    held: list[str] = []
    state = ("other", 0, 0)
    at, size, lower, ends, last = 0, len(page), None, None, page.rfind(">")

    def flush():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((*state, text))

    while at < size:
        if page[at] == "<" and not page.startswith("<!--", at) and (at > last or ends is not None and page[at + 1 : at + 2] not in ("!", "?") and not ends(at)):
            held.append("<")  # no tag: nothing closes it
            at += 1
            continue
        m = _TOKENS.match(page, at)
        at = m.end()
        tag = m[2]
        if m[0] == "<" and ends is None:
            ends = _Ends(page)
        if tag is None:
            token = m[0]
            if token[:2] not in ("<!", "<?"):
                held.append(token)
            continue
        tag = tag.lower()
        if m[1]:
            k = stack.last(tag)
            if k >= 0:
                after = stack[k - 1][1] if k else ("other", 0, 0)
                if any(x[0] in _BLOCK for x in stack.cut(k)) or state != after:
                    flush()
                state = after
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _RAW:
            if not m[3].endswith("/"):
                lower = page.lower() if lower is None else lower
                end = lower.find(f"</{tag}", at)
                at = size if end < 0 else max(end, at)
                stop = page.find(">", at)
                at = size if end < 0 or stop < 0 else stop + 1
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img", "input"):
                held.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            # What ends without an end tag: a paragraph at any block, list items and cells at their like.
            k = max(map(stack.last, ("p", *_CLOSES.get(tag, ()))))
            if k >= 0 and k >= (stack.scopes[-1] if stack.scopes else -1):
                stack.cut(k)
            state = stack[-1][1] if stack else ("other", 0, 0)
        place, around, inside = state
        bad = _unwanted(tag, m[3], place == "article")
        if tag == "article" and place != "article":
            new = ("article", max(around, inside, bad), 0)
        elif place == "other" and (tag == "main" or 'role="main"' in m[3] or "articleBody" in m[3]):
            new = ("main", max(around, inside, bad), 0)
        else:
            new = (place, around, max(inside, bad))
        if new != state:
            flush()
        state = new
        if not m[3].endswith("/") or tag in _BLOCK:
            stack.push(tag, state)
    flush()
    return out


def split_page(page: str) -> tuple[bool, list[str], list[bool]]:
    """Whether markup tells the main text, all blocks in order, and which of them can be main text.

    Of marked places those with the least doubtful wrappers count, so a wrapper is
    never a reason to drop the only article. Without any, forms that hold most of
    the text are wrappers too.
    """
    found = blocks(page)
    texts = [t for *_, t in found]
    for place in ("article", "main"):
        around = [a for p, a, i, _ in found if p == place and not i]
        if around:
            least = min(around)
            return True, texts, [p == place and not i and a == least for p, a, i, _ in found]
    form, plain = (sum(len(t) for p, _, i, t in found if p == "other" and i == level) for level in (FORM, 0))
    return False, texts, [p == "other" and i <= (FORM if form > plain else 0) for p, _, i, _ in found]


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and for k = 0, 1, ... their ranks by the first 2**k tokens (equal beginnings, equal ranks).

    Prefix doubling: a rank is the number of smaller suffixes; in each round only
    those that still share a rank are sorted, by the ranks of what follows.
    """
    n = len(ids)
    order = np.argsort(ids)
    first = np.append(True, ids[order][1:] != ids[order][:-1]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else 0
    levels, step = [rank], 1
    shared = np.flatnonzero((np.bincount(rank, minlength=n) > 1)[rank])
    while len(shared):
        ahead = np.where(shared + step < n, rank[np.minimum(shared + step, n - 1)] + 1, 0)
        key = rank[shared].astype(np.int64) * (n + 1) + ahead
        order = np.argsort(key)
        key, shared = key[order], shared[order]
        own, place = rank[shared], np.arange(len(key))
        new = np.append(True, key[1:] != key[:-1])
        group = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), place, 0))
        start = np.maximum.accumulate(np.where(new, place, 0))
        rank = rank.copy()
        rank[shared] = own + (start - group).astype(np.int32)
        levels.append(rank)
        shared = shared[~(new & np.append(new[1:], True))]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the longest common beginning of each suffix, in order, with the one before it (0 for the first)."""
    n = len(order)
    length = np.zeros(n, np.int64)
    a, b, most = order[:-1], order[1:], np.full(max(0, n - 1), -1)
    equal = np.arange(len(most))
    for k, rank in enumerate(levels):  # ranks of equal beginnings are equal at the level of their length
        equal = equal[rank[a[equal]] == rank[b[equal]]]
        most[equal] = k
    for k in range(len(levels) - 1, -1, -1):
        asked = np.flatnonzero(most >= k)
        i, j = (x[asked] + length[1:][asked] for x in (a, b))
        inside = (i < n) & (j < n)
        same = inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        length[1 + asked[same]] += 1 << k
    return length


class Runs:
    """Repeated runs of at least ``depth`` tokens in streams, from the suffix array of all of them.

    Each run of suffixes whose neighbours have at least ``depth`` tokens in common is
    one repeated beginning; longer repeated runs are the unions of what these cover.
    """

    def __init__(self, streams: list[np.ndarray], depth: int = DEPTH):
        self.sizes, self.depth = np.array([len(s) for s in streams], np.int64), depth
        flat = np.concatenate(streams) if streams else np.zeros(0, np.int64)
        # An end of its own after each stream, so that no run goes on in the next.
        ends = np.cumsum(self.sizes)
        ids = np.insert(flat, ends, int(flat.max(initial=0)) + 1 + np.arange(len(streams)))
        self.order, levels = suffix_array(ids)
        self.interval = np.cumsum(common_prefixes(self.order, levels) < depth) - 1
        self.real = np.delete(np.arange(len(ids)), ends + np.arange(len(streams)))

    def pairs(self, owners: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (interval, owner) of the asked intervals."""
        owner, width = np.repeat(owners, self.sizes + 1), int(owners.max(initial=0)) + 1
        at = asked[self.interval]
        key = np.sort(self.interval[at] * width + owner[self.order[at]])
        key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
        return key // width, key % width

    def cover(self, chosen: np.ndarray) -> np.ndarray:
        """Which tokens lie in a run of a chosen interval."""
        n = len(self.order)
        begin = self.order[chosen[self.interval]]
        gone = np.bincount(begin, minlength=n + self.depth) - np.bincount(begin + self.depth, minlength=n + self.depth)
        return (np.cumsum(gone)[:n] > 0)[self.real]

    def covered(self, owners: np.ndarray, least: int) -> np.ndarray:
        """Which tokens lie in a run that occurs in streams of at least ``least`` owners."""
        if not len(self.order):
            return np.zeros(0, bool)
        shared = np.bincount(self.interval) > 1
        return self.cover(shared & (np.bincount(self.pairs(owners, shared)[0], minlength=len(shared)) >= least))

    def hashes(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals whose run ends within its stream, and a hash of each one's run, made of hashes of the streams' tokens."""
        first = self.order[np.flatnonzero(np.append(True, self.interval[1:] != self.interval[:-1])[: len(self.order)])]
        whole, mixed = _windows(self.sizes, self.real, tokens, self.depth)
        inside = np.flatnonzero(whole[first])
        return inside, mixed[first[inside]]


def _new(ordered: np.ndarray) -> np.ndarray:
    """Which values aren't the one before them."""
    return np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]


def _places(sizes: np.ndarray) -> np.ndarray:
    """The tokens' places, an end after each stream."""
    return np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)


def _windows(sizes: np.ndarray, real: np.ndarray, tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the streams, an end after each one, whether ``depth`` tokens of its stream begin there, and a hash of these."""
    n = len(tokens) + len(sizes)
    end, x = np.ones(n, np.int64), np.zeros(n + depth, np.uint64)
    end[real], x[real] = 0, tokens
    ends = np.append(0, np.cumsum(end))
    until = np.arange(n) + depth
    whole = (until <= n) & (ends[np.minimum(until, n)] == ends[:n])
    mixed = x[:n]
    for k in range(1, depth):
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + x[k : n + k]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return whole, mixed ^ (mixed >> np.uint64(31))


class Counted(Runs):
    """The same intervals in another order, by hashes alone: what parts of a host tell each other needs no array."""

    def __init__(self, sizes: np.ndarray, tokens: np.ndarray, depth: int = DEPTH):
        self.sizes, self.depth = sizes, depth
        self.real = _places(sizes)
        whole, mixed = _windows(self.sizes, self.real, tokens, depth)
        at = np.flatnonzero(whole)
        self.order = at[np.argsort(mixed[at])]
        self.mixed = mixed[self.order]
        self.interval = np.cumsum(np.append(True, self.mixed[1:] != self.mixed[:-1])[: len(self.order)]) - 1

    def hashes(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = np.flatnonzero(np.append(True, self.interval[1:] != self.interval[:-1])[: len(self.order)])
        return np.arange(len(begins)), self.mixed[begins]

    def cover(self, chosen: np.ndarray) -> np.ndarray:
        begin, n = self.order[chosen[self.interval]], len(self.real) + len(self.sizes)
        gone = np.bincount(begin, minlength=n + self.depth) - np.bincount(begin + self.depth, minlength=n + self.depth)
        return (np.cumsum(gone)[:n] > 0)[self.real]


def _sums(flags: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags))
    end = np.cumsum(sizes)
    return total[end] - total[end - sizes]


def _hash(text: str, seed: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


#: For hashes of words: a number for each byte, and a base of powers with its inverse.
_BYTES = np.random.default_rng(9).integers(1, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _word_hashes(words: pa.Array, limit: int = 1 << 20) -> np.ndarray:
    """A hash of each word's bytes, a polynomial, by differences of running sums over about ``limit`` bytes at once."""
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1]
    data, out, lo = np.frombuffer(data, np.uint8), np.empty(len(words), np.uint64), 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        begin = ends[lo : hi + 1] - ends[lo]
        n = int(begin[-1])
        sums = np.append(np.uint64(0), np.cumsum(_BYTES[data[ends[lo] : ends[hi]]] * _powers(_BASE, n)[:n], dtype=np.uint64))
        out[lo:hi] = (sums[begin[1:]] - sums[begin[:-1]]) * _powers(_INVERSE, n)[begin[:-1]]
        lo = hi
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n of a base."""
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(n, base, np.uint64)))


class Section:
    """Pages of a host, all or a part, as ``split_page`` gives them: their array, and what is decided by it."""

    def __init__(self, pages: list[tuple[bool, list[str], list[bool]]], array: bool = True):
        self.pages, self.array = pages, array
        # A mark is a token before each block and behind the last one; the first token of all is one.
        listed = pc.split_pattern(pa.array(["\n".join(["", *(f" {t} " for t in texts), ""] if texts else ["\n"]).encode("utf-8", "surrogatepass") for _, texts, _ in pages], pa.large_binary()), " ")
        self.sizes = np.diff(listed.offsets.to_numpy())
        tokens = listed.flatten().dictionary_encode()
        self.index, flat = tokens.dictionary, tokens.indices.to_numpy().astype(np.int64)
        self.streams = np.split(flat, np.cumsum(self.sizes)[:-1]) if pages else []
        marks = flat == 0
        block = np.cumsum(marks) - 1 - np.repeat(np.arange(len(pages)), self.sizes)
        self.words = ~marks & np.append(np.array([m for *_, main in pages for m in main], bool), False)[block]
        self.owners = np.arange(len(pages))
        self.main = [{t for t, m in zip(texts, main, strict=True) if m} for _, texts, main in pages]
        self.seen = Counter(t for blocks in self.main for t in blocks)

    @cached_property
    def runs(self) -> Runs:
        return Runs(self.streams) if self.array else Counted(self.sizes, self.spelled)

    def keys(self, shared: np.ndarray, repeated: set[str]) -> dict[int, str]:
        """The pages that are near copies, with the block that tells of what: those with little outside of the shared tokens, if the longest repeated block is long."""
        alone = _sums(self.words & ~shared, self.runs.sizes)
        few = alone < NEAR * _sums(self.words, self.runs.sizes)
        found = {i: max(self.main[i] & repeated, key=lambda t: (len(t), t), default="") for i in np.flatnonzero(few).tolist()}
        return {i: key for i, key in found.items() if key.count(" ") + 1 >= BODY}

    def kept(self, outside: np.ndarray, inside: np.ndarray) -> list[list[str] | None]:
        """For each page its main blocks without those that the covered tokens fill, or None if none goes."""
        out: list[list[str] | None] = []
        begin = 0
        for (marked, texts, main), s in zip(self.pages, self.streams, strict=True):
            covered = (inside if marked else outside)[begin : begin + len(s)]
            begin += len(s)
            if not covered.any():
                out.append(None)
                continue
            marks = np.flatnonzero(s == 0)
            stay = np.append(0, np.cumsum(~covered))
            gone = stay[marks[1:] + 1] == stay[marks[:-1]]
            every = [t for t, m in zip(texts, main, strict=True) if m]
            kept = [t for t, m, g in zip(texts, main, gone.tolist(), strict=True) if m and not g]
            total, left = (sum(t.count(" ") + 1 for t in x) for x in (every, kept))
            whole = left == total or not left or marked and 2 * left < total
            out.append(None if whole else kept)
        return out

    @cached_property
    def spelled(self) -> np.ndarray:
        """A hash of each token, marks have one too."""
        return _word_hashes(self.index)[np.concatenate(self.streams)]

    def held(self) -> np.ndarray:
        """The distinct runs and main blocks by hash, as ``items`` has them, without an order of the runs."""
        whole, mixed = _windows(self.sizes, _places(self.sizes), self.spelled, DEPTH)
        found = np.sort(np.append(mixed[whole], np.array([_hash(t, 2) for t in self.seen], np.uint64)))
        return found[_new(found)]

    def items(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, pages, place): the distinct runs and main blocks by hash, with their pages here, 2 at most; the places of those of ``inside`` and of ``blocks``."""
        self.inside, runs = self.runs.hashes(self.spelled)
        every = np.zeros(int(self.runs.interval.max(initial=-1)) + 1, bool)
        every[self.inside] = True
        pages = np.bincount(self.runs.pairs(self.owners, every)[0], minlength=len(every))[self.inside]
        self.blocks = list(self.seen)
        hashes, place = np.unique(np.append(runs, np.array([_hash(t, 2) for t in self.blocks], np.uint64)), return_inverse=True)
        counts = np.zeros(len(hashes), np.int64)
        np.add.at(counts, place, np.append(pages, [self.seen[t] for t in self.blocks]))
        return hashes, np.minimum(counts, 2), place

    def told(self, shared: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, alone, row, copied): of the runs that several pages of the host hold, and of 0 for all pages, the number of pages that are no near copies, and rows of it with what the near copies are copies of."""
        chosen = np.zeros(int(self.runs.interval.max(initial=-1)) + 1, bool)
        chosen[self.inside] = shared[place[: len(self.inside)]]
        repeated = {t for t, k in zip(self.blocks, place[len(self.inside) :].tolist(), strict=True) if shared[k]}
        keys = self.keys(self.runs.cover(chosen), repeated)
        n, kinds = len(self.pages), sorted(set(keys.values()))
        codes = {key: n + k for k, key in enumerate(kinds)}
        owners = np.array([codes[keys[i]] if i in keys else i for i in range(n)], np.int64)
        interval, owner = self.runs.pairs(owners, chosen)
        ids = np.full(len(chosen), -1)
        ids[self.inside] = place[: len(self.inside)]
        self.wanted = np.unique(ids[chosen])
        row = np.append(np.searchsorted(self.wanted, ids[interval]) + 1, np.zeros(len(np.unique(owners)), np.int64))
        owner = np.append(owner, np.unique(owners))
        alone = np.bincount(row[owner < n], minlength=len(self.wanted) + 1)
        copied = np.array([_hash(key, 3) for key in kinds], np.uint64)[owner[owner >= n] - n] if kinds else np.zeros(0, np.uint64)
        return self.wanted, alone, row[owner >= n], copied


def _least(n: int) -> tuple[int, int]:
    return max(PAGES, math.ceil(SHARE * n)), max(INSIDE_PAGES, math.ceil(INSIDE_SHARE * n))


def decide(pages: list[tuple[bool, list[str], list[bool]]]) -> list[list[str] | None]:
    """For each of a host's pages, as ``split_page`` gives them, its main blocks, or None where the array removes none."""
    if not pages:
        return []
    section = Section(pages)
    runs, owners = section.runs, section.owners
    # Pages with little of their own are near copies of each other if they have the longest shared block in common.
    first: dict[str, int] = {}
    for i, key in section.keys(runs.covered(owners, 2), {t for t, k in section.seen.items() if k > 1}).items():
        owners[i] = first.setdefault(key, i)
    outside, inside = _least(len(np.unique(owners)))
    return section.kept(runs.covered(owners, outside), runs.covered(owners, inside))


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns byte by byte, compressed; the first one is sorted, its distances are kept."""
    import zstandard

    kept = [np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in kept))


def _restored(body: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw, out, end = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8), [], 0
    for k, kind in enumerate(kinds):
        width = np.dtype(kind).itemsize
        column = np.ascontiguousarray(raw[end : end + width * n].reshape(width, n).T).view(kind).ravel()
        out.append(np.cumsum(column, dtype=kind) if k == 0 else column)
        end += width * n
    return out


def _pages_of(table: pa.Table, array: bool = False) -> tuple[list[dict], Section]:
    """Of pages with equal main text the one with the least text around it, in the order of their digests."""
    rows, before = [], None
    for row in table.sort_by([("digest", "ascending"), ("size", "ascending"), ("tie", "ascending")]).to_pylist():
        if row["digest"] != before:
            rows.append(row)
        before = row["digest"]
    return rows, Section([(r["marked"], unpack(r["packed"], r["places"]), [c == "m" for c in r["places"]]) for r in rows], array)


_MESSAGE = "host string, task int, part int, n int, body binary, m int, copies binary"
_MESSAGE_KINDS = {"host": pa.string(), "task": pa.int32(), "part": pa.int32(), "n": pa.int32(), "body": pa.binary(), "m": pa.int32(), "copies": pa.binary()}


def _messages(rows: list[tuple]) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(_MESSAGE_KINDS.items())})


def _cuts(hashes: np.ndarray, parts: int) -> np.ndarray:
    return np.searchsorted((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))


def _answers(hashes: np.ndarray, parts: int, told: pa.Table) -> np.ndarray:
    """What the parts of the hashes' range answered, in the order of the hashes."""
    cuts, out = _cuts(hashes, parts), np.zeros(len(hashes), np.int64)
    for part, n, body in zip(*(told.column(c).to_pylist() for c in ("part", "n", "body")), strict=True):
        out[cuts[part] : cuts[part + 1]] = _restored(body, n, "u4")[0].view("i4")
    return out


#: Bits of a hash beyond those that number a host's parts, about 32 times as many values as a part has runs. More of them are right too, with more to send.
SHORT = 24


def _listed(values: np.ndarray) -> bytes:
    """Values in order with two bits each beyond those of their mean distance: low bits as they are, the rest by distances in ones and zeros."""
    rest = values - values[0]
    low = max(0, (int(rest[-1]) // len(rest)).bit_length() - 1)
    high = (rest >> np.uint64(low)).astype(np.int64) + np.arange(len(rest))
    ones = np.zeros(int(high[-1]) + 1, np.uint8)
    ones[high] = 1
    bits = (rest[:, None] >> np.arange(low, dtype=np.uint64)).astype(np.uint8) & 1
    return values[:1].tobytes() + bytes([low]) + np.packbits(bits).tobytes() + np.packbits(ones).tobytes()


def _unlisted(body: bytes, n: int) -> np.ndarray:
    low, end = body[8], 9 + (body[8] * n + 7) // 8
    bits = np.unpackbits(np.frombuffer(body[9:end], np.uint8), count=low * n).reshape(n, low)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(body[end:], np.uint8)))[:n] - np.arange(n)
    out = np.frombuffer(body[:8], np.uint64) + (high.astype(np.uint64) << np.uint64(low))
    for k in range(low):
        out += bits[:, k].astype(np.uint64) << np.uint64(k)
    return out


def _elsewhere(hashes: np.ndarray, parts: int, told: pa.Table) -> np.ndarray:
    """Which of the hashes another part holds, as the parts of their range answered in the first round or, if it came to that, in the second one."""
    import zstandard

    out = np.ones(len(hashes), bool)
    for step in (1, 2):
        asked, answers = np.flatnonzero(out), told.filter(pc.equal(told.column("step"), step))
        if step == 1 or len(answers):
            cuts = _cuts(hashes[asked], parts)
            for part, n, body in zip(*(answers.column(c).to_pylist() for c in ("part", "n", "body")), strict=True):
                out[asked[cuts[part] : cuts[part + 1]]] = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8), count=n)
    return out


def _say_items(pages: pa.Table) -> pa.Table:
    """One part of a host: the first bits of what it holds, runs and blocks, for the parts of the hashes' range."""
    host, task, parts = (pages.column(c)[0].as_py() for c in ("host", "task", "tasks"))
    hashes = _pages_of(pages)[1].held()
    cuts, short = _cuts(hashes, parts), hashes >> np.uint64(64 - SHORT - (parts - 1).bit_length())
    return _messages([(host, task, k, int(cuts[k + 1] - cuts[k]), _listed(short[cuts[k] : cuts[k + 1]]), 0, b"") for k in np.flatnonzero(np.diff(cuts)).tolist()])


def _say_whole(pages: pa.Table, told: pa.Table) -> pa.Table:
    """One part of a host, and of what other parts may hold too: the whole hashes of that."""
    host, task, parts = (pages.column(c)[0].as_py() for c in ("host", "task", "tasks"))
    hashes = _pages_of(pages)[1].held()
    hashes = hashes[_elsewhere(hashes, parts, told)]
    cuts = _cuts(hashes, parts)
    return _messages([(host, task, k, int(cuts[k + 1] - cuts[k]), _squeezed(hashes[cuts[k] : cuts[k + 1]]), 1, b"") for k in np.flatnonzero(np.diff(cuts)).tolist()])


def _meet(table: pa.Table) -> pa.Table:
    """One part of the range of a host's hashes: a bit for each one, whether several parts have said it."""
    import zstandard

    rows = table.to_pylist()
    found = [_restored(r["body"], r["n"], "u8")[0] if r["m"] else _unlisted(r["body"], r["n"]) for r in rows]
    every = np.sort(np.concatenate([f[_new(f)] for f in found]))
    several = np.append(every[1:][every[1:] == every[:-1]], np.uint64(0))
    out = []
    for r, f in zip(rows, found, strict=True):
        bits = several[np.searchsorted(several[:-1], f)] == f if len(several) > 1 else np.zeros(len(f), bool)
        out.append((r["host"], r["task"], r["part"], r["n"], zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes()), 0, b""))
    return _messages(out)


def _say_copies(pages: pa.Table, told: pa.Table) -> pa.Table:
    """One part of a host, and what of it other parts hold: its shared runs with the pages that are no near copies, and those that are."""
    host, task, parts = (pages.column(c)[0].as_py() for c in ("host", "task", "tasks"))
    _, section = _pages_of(pages)
    hashes, counts, place = section.items()
    wanted, alone, row, copied = section.told((counts > 1) | _elsewhere(hashes, parts, told), place)
    hashes, out = np.append(np.uint64(0), hashes[wanted]), []
    order = np.argsort(row, kind="stable")
    row, copied, cuts = row[order].astype(np.int64), copied[order], _cuts(hashes, parts)
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        lo, hi = cuts[k], cuts[k + 1]
        mine = slice(*np.searchsorted(row, [lo, hi]))
        out.append((host, task, k, int(hi - lo), _squeezed(hashes[lo:hi], alone[lo:hi].astype("u4")), len(row[mine]), _squeezed((row[mine] - lo).astype("u4"), copied[mine])))
    return _messages(out)


def _add(table: pa.Table) -> pa.Table:
    """One part of the range of a host's hashes: the sum of each one's pages, near copies of one another counted once."""
    rows = table.to_pylist()
    found = [_restored(r["body"], r["n"], "u8", "u4") for r in rows]
    sizes = np.array([r["n"] for r in rows])
    place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)[1]
    counts = np.bincount(place, np.concatenate([f[1] for f in found])).astype(np.int64)
    ends, copies = np.cumsum(sizes).tolist(), []
    for r, end in zip(rows, ends, strict=True):
        if r["m"]:
            row, copied = _restored(r["copies"], r["m"], "u4", "u8")
            copies.append(np.stack([place[end - r["n"] + row.astype(np.int64)].astype(np.uint64), copied]))
    if copies:
        counts += np.bincount(np.unique(np.concatenate(copies, axis=1), axis=1)[0].astype(np.int64), minlength=len(counts))
    return _messages([(r["host"], r["task"], r["part"], r["n"], _squeezed(counts[place[end - r["n"] : end]].astype("u4")), 0, b"") for r, end in zip(rows, ends, strict=True)])


def _say_kept(pages: pa.Table, told: pa.Table) -> pa.Table:
    """One part of a host, and all answers: rows (host, digest, kept)."""
    parts = pages.column("tasks")[0].as_py()
    rows, section = _pages_of(pages, True)
    hashes, local, place = section.items()
    wanted = section.told((local > 1) | _elsewhere(hashes, parts, told), place)[0]
    counts = _answers(np.append(np.uint64(0), hashes[wanted]), parts, told.filter(pc.equal(told.column("step"), 3)))
    every = np.zeros(len(hashes), np.int64)
    every[wanted] = counts[1:]
    held = np.zeros(int(section.runs.interval.max(initial=-1)) + 1, np.int64)
    held[section.inside] = every[place[: len(section.inside)]]
    kept = section.kept(*(section.runs.cover(held >= least) for least in _least(int(counts[0]))))
    out = [(r["host"], r["digest"], "\n".join(k)) for r, k in zip(rows, kept, strict=True) if k is not None]
    return pa.table({name: pa.array([x[i] for x in out], pa.string()) for i, name in enumerate(("host", "digest", "kept"))})


def _of_large_hosts(pages: DataFrame, tasks: int) -> DataFrame:
    """(host, digest, kept) where the array removes blocks, of hosts that are dealt over ``tasks`` parts in all; pages are sent once, what they hold packed."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    dealt = pages.repartition(max(cores, tasks), "host", "task")
    at = lambda d: d.groupBy("host", "task")
    answered = lambda d, add, step: d.groupBy("host", "part").applyInArrow(add, _MESSAGE).withColumn("step", F.lit(step))
    first = answered(at(dealt).applyInArrow(_say_items, _MESSAGE), _meet, 1)
    whole = first.unionByName(answered(at(dealt).cogroup(at(first)).applyInArrow(_say_whole, _MESSAGE), _meet, 2))
    every = whole.unionByName(answered(at(dealt).cogroup(at(whole)).applyInArrow(_say_copies, _MESSAGE), _add, 3))
    return at(dealt).cogroup(at(every)).applyInArrow(_say_kept, "host string, digest string, kept string")


#: Main texts whose digests a task remembers, so that it sends copies but once; what it sends again is left out later.
REMEMBERED = 1_000_000
#: The host of an address; empty if it has none.
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"


def pack(texts: list[str]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress("\n".join(texts).encode("utf-8", "surrogatepass"))


def unpack(packed: bytes, places: str) -> list[str]:
    """The blocks; one letter of ``places`` stands for each."""
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass").split("\n") if places else []


def _digest(texts: list[str], main: list[bool], marked: bool) -> tuple[str, str]:
    import xxhash

    own = "\n".join(t for t, m in zip(texts, main, strict=True) if m)
    return own, xxhash.xxh128_hexdigest(own.encode("utf-8", "surrogatepass")) + ("m" if marked else "o")


def _pages(batches):
    """Rows (host, html) to (host, digest, size, marked, places, packed), copies of a main text left out; one letter of places a block."""
    known: set = set()
    kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.binary())
    for batch in batches:
        for lo in range(0, batch.num_rows, 100):
            part, rows = batch.slice(lo, 100), []
            for host, page in zip(*[c.to_pylist() for c in part.columns], strict=True):
                marked, texts, main = split_page(page or "")
                _, digest = _digest(texts, main, marked)
                if (host, digest) in known:
                    continue
                known.add((host, digest))
                if len(known) > REMEMBERED:
                    known.clear()
                rows.append((host, digest, sum(map(len, texts)), marked, "".join("m" if m else "x" for m in main), pack(texts)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=list(_PAGE))


def _main(batches):
    """Rows (_id, _url, host, html) to (_id, _url, host, digest, marked, main)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 100):
            part, rows = batch.slice(lo, 100), []
            for page in part.column(3).to_pylist():
                marked, texts, main = split_page(page or "")
                own, digest = _digest(texts, main, marked)
                rows.append((digest, marked, own))
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *made], names=["_id", "_url", "host", "digest", "marked", "main"])


def _sections(rows, least: int = SECTION):
    """Runs of rows of one host and task (their first and last fields), in their order, with at least ``least`` characters each where the host has so many, and less than twice that unless a page is longer."""
    held, size, key = [], 0, None
    for row in rows:
        if (row[0], row[-1]) != key:
            if held:
                yield held
            held, size, key = [], 0, (row[0], row[-1])
        held.append(row)
        size += row[2]
        if size >= 2 * least and len(held) > 1:
            cut, part = 0, 0
            while part < least and cut < len(held) - 1:
                part += held[cut][2]
                cut += 1
            yield held[:cut]
            held, size = held[cut:], size - part
    if held:
        yield held


def _decided(batches):
    """Rows (host, digest, size, marked, places, packed, task) of whole hosts in order of host and digest to (host, digest, kept) where the array removes blocks."""

    def rows():
        before = None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:2] != before:  # copies of a main text follow each other
                    yield row
                before = row[:2]

    for section in _sections(rows(), math.inf):
        pages = [(marked, unpack(packed, places), [c == "m" for c in places]) for _, _, _, marked, places, packed, _ in section]
        kept = decide(pages)
        out = [(r[0], r[1], "\n".join(k)) for r, k in zip(section, kept, strict=True) if k is not None]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(3)], names=["host", "digest", "kept"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (its blocks joined by line ends; empty if none), n_chars.

    Null pages count as empty, null addresses as one host without a name. Copies of
    a page get equal texts and count as one page of their host. An empty table gives
    no rows; other columns are ignored. Nothing is cut off, whatever the page's length.
    """
    found = decisions(pages, id_col, url_col, html_col)
    return found.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))


def decisions(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: _id, _url, marked (markup tells its article), by_array (the array removed blocks), text."""
    bounded_batches(pages.sparkSession)
    url = F.col(url_col).cast("string")
    source = pages.select(F.col(id_col).alias("_id"), url.alias("_url"), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)).alias("host"), F.col(html_col).cast("string").alias("_html"))
    sizes = source.groupBy("host").agg(F.sum(F.length("_html").cast("bigint")).alias("chars"))
    # Not many hosts have that many characters, so they fit into a broadcast; asked for once, as this reads all pages.
    found = sizes.where(F.col("chars") >= 2 * SECTION).select("host", F.ceil(F.col("chars") / (2 * SECTION)).cast("int").alias("tasks")).collect()
    hot, tasks = pages.sparkSession.createDataFrame(found, "host string, tasks int"), sum(r.tasks for r in found)
    sent = lambda d: d.select("host", "_html").mapInArrow(_pages, "host string, digest string, size bigint, marked boolean, places string, packed binary")
    usual = sent(source.join(F.broadcast(hot), "host", "left_anti") if tasks else source)
    # Of pages with equal main text one counts, the one with the least text around it.
    order = ["host", "digest", "size", F.xxhash64("packed")]
    kept = usual.repartition("host").sortWithinPartitions(*order).select(*_PAGE, F.lit(0).alias("task")).mapInArrow(_decided, "host string, digest string, kept string")
    if tasks:
        large = sent(source.join(F.broadcast(hot), "host", "left_semi")).join(F.broadcast(hot), "host")
        kept = kept.unionByName(_of_large_hosts(large.select(*_PAGE, F.xxhash64("packed").alias("tie"), "tasks", F.pmod(F.xxhash64("digest"), "tasks").cast("int").alias("task")), tasks))
    kind = pages.schema[id_col].dataType.simpleString()
    every = source.select("_id", "_url", "host", "_html").mapInArrow(_main, f"_id {kind}, _url string, host string, digest string, marked boolean, main string")
    # Written first, so that its size is known when the join is planned.
    both = every.join(written(kept, "kept"), ["host", "digest"], "left")
    return both.select("_id", "_url", "marked", F.col("kept").isNotNull().alias("by_array"), F.coalesce("kept", "main").alias("text"))


_PAGE = ("host", "digest", "size", "marked", "places", "packed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
