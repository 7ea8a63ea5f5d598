"""Personal data: candidate spans judged by gradient-boosted trees.

High-recall generators propose spans, which may overlap. Boosted trees look at a
candidate's format (length, digits, groups, checksum, ...) and context (characters
and cue words around it). A threshold calibrated on held-back training candidates
selects the redactions. Spans of the base formats always stay; the trees add
what the loose generators find beyond them.

Training candidates stand in the text of real documents: personal data that the
base formats find there are respelled in their place (an address with "at" and
"dot", a number without its country), data of each kind are made up, and so are
look-alikes (dates, versions, order numbers, prices, hashes, ...), all with cue
words, misleading ones and none. What the generators propose in the same documents
beside the base spans has no label, as it may be real data: trees of the made
candidates alone judge it, and what they take for data is left out, the rest
counts as ordinary. Whole documents are held back to calibrate the threshold.

All searches take time in proportion to the text: base formats begin only where a
run of their characters does, and marks like "@" are looked for first.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

# The formats of the contract.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# End of the fixed values.
#: The generators. Their numbers of digits and groups are those of the formats; names and domains have any length.
LOOSE = {
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9A-Za-z.,+-])\(?[0-9]{2,4}\)?(?:[\x20./-][0-9]{2,4}){1,4}(?![0-9A-Za-z-]|[.,][0-9])",
    "id": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}(?:\x20?[0-9A-Z]{1,3})?)(?![0-9A-Za-z-])",
}
AT, NAME = r"\s?(?:@|\(at\)|\[at\]|\sat\s)\s?", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = r"[A-Za-z0-9-]++(?:\s?(?:\.|\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z0-9-]{2,}+)++"
#: A text without any of these has no candidate.
TRIGGER = re.compile(r"[0-9@]|(?:\(|\[|\s)at(?:\)|\]|\s)|[0-9A-Fa-f]:[0-9A-Fa-f]")
KINDS = ("email", "ip", "card", "phone", "id")
CUES = ("mail", "contact", "phone", "tel", "call", "fax", "mobile", "ssn", "social", "iban", "account", "ip", "host", "address", "write", "version", "order", "invoice", "date", "page", "isbn", "total", "price", "released", "figure", "chapter", "at")
WINDOW = 24
EXAMPLES, ROUNDS, DEPTH, RATE, BINS = 12_000, 60, 3, 0.2, 32
#: The label of candidates that nobody made.
UNKNOWN = -1
#: Documents, chosen by a hash of their id, whose texts the training candidates stand in.
SAMPLE = 1000
#: Share of the selected training candidates that has to be right.
PRECISION = 0.98

# The base formats as they are searched: no match of an address or a card begins inside of a run of digits.
_SEARCHED = {"ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"), "phone": re.compile(BASE["phone"])}
_BASE_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOOSE = {k: re.compile(v) for k, v in LOOSE.items()}
_AT, _DOMAIN = re.compile(AT), re.compile(DOMAIN)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _holds(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in text.split("."))
    digits = re.sub("[^0-9]", "", text)
    return kind == "email" or (12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15)


def addresses(text: str, marks, domain: re.Pattern) -> list[tuple[int, int]]:
    """A name, one of ``marks`` (begin, end, in order) and a domain: leftmost, not overlapping.

    Names hold no mark, so each is looked for back to the mark before only.
    """
    found, low = [], 0
    for begin, end in marks:
        if begin < low:
            continue
        before = text[low:begin]
        start = low + len(before.rstrip(NAME))
        low = end
        if start < begin and (m := domain.match(text, end)):
            found.append((start, m.end()))
            low = m.end()
    return found


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank, end, kind) of the base formats: leftmost, not overlapping within a kind, without retries."""
    found = []
    if "@" in text:
        found += [(a, 0, b, "email") for a, b in addresses(text, ((m.start(), m.end()) for m in re.finditer("@", text)), _BASE_DOMAIN)]
    for rank, kind in enumerate(BASE):
        if kind != "email" and (kind != "phone" or "+" in text):
            found += [(m.start(), rank, m.end(), kind) for m in _SEARCHED[kind].finditer(text) if _holds(kind, m[0])]
    return sorted(found)


def loose_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Proposals of the generators; they may overlap."""
    found = [(a, 0, b, "email") for a, b in addresses(text, (m.span() for m in _AT.finditer(text)), _DOMAIN)]
    return found + [(m.start(), KINDS.index(kind), m.end(), kind) for kind, pattern in _LOOSE.items() for m in pattern.finditer(text)]


class Taken:
    """Whether a span overlaps one of some spans, which may overlap each other."""

    def __init__(self, spans):
        self.starts, self.ends = [s[0] for s in spans], []
        for s in spans:
            self.ends.append(max(s[2], self.ends[-1] if self.ends else 0))

    def __contains__(self, span) -> bool:
        k = bisect_left(self.starts, span[1])
        return k > 0 and self.ends[k - 1] > span[0]

    def add(self, start: int, end: int) -> None:
        """One that overlaps none."""
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def beside(text: str, own) -> list[tuple[int, int, int, str]]:
    """What the generators propose that overlaps none of the spans ``own``."""
    taken = Taken(own)
    return [s for s in loose_spans(text) if (s[0], s[2]) not in taken]


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a candidate."""
    s = text[start:end]
    left, right = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    groups = re.findall("[0-9]+", s)
    digits = "".join(groups)
    words = re.findall("[a-z]+", left.lower())
    after = re.findall("[a-z]+", right.lower())
    return [
        KINDS.index(kind),
        len(s),
        len(digits),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len(groups[0]) if groups else 0,
        len(groups[-1]) if groups else 0,
        int(groups[0][:4]) if groups else -1,
        int(groups[1][:4]) if len(groups) > 1 else -1,
        s.count("-"),
        s.count("."),
        s.count("/"),
        s.count(" "),
        s.count(":"),
        s.count("@") + 2 * (("(at)" in s) + ("[at]" in s)),
        s.count("(") - s.count(")"),
        s.startswith("("),
        sum(c.isupper() for c in s),
        sum(c.islower() for c in s),
        luhn(digits) if digits else 0,
        len(set(digits)),
        left[-1:].isalnum(),
        left.rstrip()[-1:] == ":",
        right[:1].isalnum(),
        right[:1] in ("%", "$", "€"),
        left.rstrip()[-1:] in ("$", "€", "#", "v", "V"),
        *[any(w.startswith(c) for w in words[-3:]) for c in CUES],
        any(w in ("euro", "dollars", "pages", "percent") for w in after[:1]),
    ]


def respelled(kind: str, core: str, r: random.Random) -> str | None:
    """A base span as the base formats don't find it; None where there is no such spelling."""
    if kind == "email":
        name, domain = core.split("@", 1)
        dot = r.choice([".", " dot ", "[dot]", "(dot)", "."])
        return name + r.choice([" at ", "(at)", "[at]", " (at) "]) + dot.join(domain.split("."))
    if kind == "phone":
        groups = re.findall("[0-9]+", core)[1:]
        if 1 < len(groups) < 6 and all(2 <= len(g) <= 4 for g in groups):
            return r.choice([f"({groups[0]}) " + "-".join(groups[1:]), "-".join(groups), " ".join(groups), ".".join(groups)])
    return None


def examples(texts: list[str], n: int = EXAMPLES, seed: int = 7) -> tuple[list[list[float]], list[int], list[int]]:
    """Features, labels and groups (what is held back together) of candidates in the ``texts``: all that are there (UNKNOWN), then at least ``n`` made ones."""
    r = random.Random(seed)
    x, y, group, places = [], [], [], []
    words = sorted({w for t in texts for w in re.findall(r"[^\W\d_]+", t)})
    for i, t in enumerate(texts):
        if TRIGGER.search(t):
            own = base_spans(t)
            places += [(i, t[max(0, a - 40) : a], kind, t[a:b], t[b : b + 40]) for a, _, b, kind in own]
            for a, _, b, kind in beside(t, own):
                x.append(features(t, a, b, kind))
                y.append(UNKNOWN)
                group.append(i)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
    word = (lambda: r.choice(words)) if words else name
    true = {
        "email": lambda: f"{name()}{r.choice(['', '.', '_'])}{d(r.randint(0, 3))}{r.choice(['@', ' at ', '(at)', '[at]', ' (at) '])}{name()}{r.choice(['.', ' dot ', '[dot]', '(dot)'])}{r.choice(['com', 'org', 'net', 'de', 'example'])}",
        "ip": lambda: ":".join(f"{r.randrange(65536):x}" for _ in range(8)),
        "phone": lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(3)} {d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(3)}/{d(3)}.{d(3)}".replace(".", " ")]),
        "id": lambda: r.choice([f"{r.randint(1, 899):03}-{r.randint(1, 99):02}-{r.randint(1, 9999):04}", f"{r.choice(['DE', 'FR', 'GB', 'ES'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}"]),
    }
    cues = {"email": ["mail", "contact", "write to", "email:"], "ip": ["host", "ip", "address", "from"], "phone": ["phone", "call", "tel:", "mobile", "fax"], "id": ["ssn", "social security", "iban", "account"]}
    false = [
        lambda: f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
        lambda: f"{r.randint(1, 28):02}/{r.randint(1, 12):02}/{r.randint(1900, 2099)}",
        lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2099)}",
        lambda: f"{r.randint(1, 40)}-{r.randint(41, 99)}",
        lambda: f"{d(3)}-{d(10)}",
        lambda: f"{r.randint(1, 999)} {d(3)} {d(3)}",
        lambda: f"{r.randint(1900, 2099)}-{r.randint(1900, 2099)}",
        lambda: f"{d(2)}:{d(2)}:{d(2)}",
        lambda: f"{name()} at {name()}. {name().title()}",
        lambda: f"{r.randint(10, 99)}/{r.randint(10, 99)}",
        lambda: f"{name()} at {name()}.{name()}",
        lambda: " ".join(d(2) for _ in range(r.randint(2, 5))),
        lambda: f"{d(4)}/{d(4)}",
        lambda: f"{name().upper()[:2]}{d(2)} {d(4)}",
    ]
    odd = ["version", "order", "invoice", "date", "page", "isbn", "total", "released", "figure", "chapter", "$", "#"]
    n += len(y)
    while len(y) < n:
        label = r.random() < 0.5
        # Half of them stand where a real document has personal data, if one has any.
        where, left, found, own, right = r.choice(places) if places and r.random() < 0.5 else (len(y) % 997, " ".join(word() for _ in range(r.randint(0, 3))) + " ", "", "", f" {word()} {word()}")
        if label:
            kind = r.choice(list(true))
            core = respelled(found, own, r) if found and r.random() < 0.5 else None
            kind, core = (found, core) if core else (kind, true[kind]())
            cue = r.choice(cues[kind]) + " " if r.random() < 0.5 else ""
        else:
            core = r.choice(false)()
            cue = (r.choice(odd) if r.random() < 0.6 else r.choice(sum(cues.values(), [])) if r.random() < 0.05 else "") + " "
        before = left + cue
        text = before + core + r.choice(["", ".", ",", " "]) + right
        lo, hi = len(before), len(before) + len(core)
        for a, _, b, kind in loose_spans(text):
            if a < hi and lo < b:
                x.append(features(text, a, b, kind))
                y.append(int(label and a <= lo + 1 and b >= hi - 1))
                group.append(where)
    return x, y, group


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> dict:
    """Boosted trees on logistic loss over binned features (complete trees of DEPTH levels)."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    width = BINS
    margin = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    trees, start = [], float(margin[0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = [], []
        for level in range(DEPTH):
            n = 1 << level
            flat = (node[:, None] * x.shape[1] + np.arange(x.shape[1])) * width + binned
            size = n * x.shape[1] * width
            gs = np.bincount(flat.ravel(), np.repeat(g, x.shape[1]), size).reshape(n, x.shape[1], width).cumsum(2)
            hs = np.bincount(flat.ravel(), np.repeat(h, x.shape[1]), size).reshape(n, x.shape[1], width).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
            best = gain.reshape(n, -1).argmax(1)
            f, c = best // width, best % width
            feature.append(f)
            cut.append(c)
            node = node * 2 + (binned[np.arange(len(y)), f[node]] > c[node])
        leaf = -np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 1) * RATE
        trees.append((feature, cut, leaf))
        margin = margin + leaf[node]
    return {"edges": edges, "trees": trees, "start": start}


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(model["edges"], x.T, strict=True)], 1)
    out, rows = np.full(len(x), model["start"]), np.arange(len(x))
    for feature, cut, leaf in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for f, c in zip(feature, cut, strict=True):
            node = node * 2 + (binned[rows, f[node]] > c[node])
        out += leaf[node]
    return out


def train(docs: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> dict:
    """The trees, the threshold, and what the held-back candidates say of them.

    The candidates stand in the texts of ``sample`` documents at most, chosen by a
    hash of the id (null texts and rows without an id aside; equal ids count once).
    An empty table leaves made contexts. ``held_back`` tells how many candidates
    were held back (how many of them real ones), how many real ones had no label, and
    the precision and recall of those selected.
    """
    texts: list[str] = []
    if docs is not None:
        ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
        rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(ids), "_id").where("_t is not null").collect()
        texts = [r[1] for r in sorted(rows, key=lambda r: (str(r[0]), r[1]))]
    return fit(texts)


def judged(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels, and which rows have one: the UNKNOWN are ordinary if trees of the made rows take them for it, else they have none."""
    made = y != UNKNOWN
    ordinary = made.copy()
    if not made.all():
        ordinary[~made] = margins(boost(x[made], y[made]), x[~made]) < 0
    return np.where(made, y, 0.0), ordinary


def fit(texts: list[str]) -> dict:
    """The model of ``train`` for texts at hand."""
    x, y, group = map(np.array, examples(texts))
    x, y = x.astype(float), y.astype(float)
    real = int((y == UNKNOWN).sum())
    y, known = judged(x, y)
    unlabelled = int((~known).sum())
    x, y, group = x[known], y[known], group[known]
    fold = np.array([hashlib.md5(str(i).encode()).digest()[0] % 4 == 0 for i in group.tolist()])
    m = margins(boost(x[~fold], y[~fold]), x[fold])
    order = np.argsort(-m, kind="stable")
    hits = np.cumsum(y[fold][order])
    right = hits / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= PRECISION)
    model = boost(x, y)
    model["threshold"] = float(max(0.0, m[order][good[-1]])) if len(good) else float("inf")
    chosen = int((m >= model["threshold"]).sum())
    found = float(y[fold][m >= model["threshold"]].sum())
    held_real = int(fold[: real - unlabelled].sum())  # real candidates come first
    model["held_back"] = {"candidates": len(m), "real": held_real, "unlabelled": unlabelled, "precision": found / max(1, chosen), "recall": found / max(1.0, float(y[fold].sum()))}
    return model


def finder(model: dict):
    """Texts to their (base, all) spans."""

    def fn(texts):
        base, asked, rows = [], [], []
        for i, text in enumerate(texts):
            own = base_spans(text) if TRIGGER.search(text) else []
            base.append(own)
            if TRIGGER.search(text):
                for a, rank, b, kind in beside(text, own):
                    asked.append((i, a, rank, b, kind))
                    rows.append(features(text, a, b, kind))
        found = [list(b) for b in base]
        if rows:
            m = margins(model, np.array(rows, float))
            taken: dict[int, Taken] = {}
            # The surest of overlapping candidates wins; none overlaps a base span.
            for k in sorted(np.flatnonzero(m >= model["threshold"]).tolist(), key=lambda k: (-m[k], asked[k][:2])):
                i, a, rank, b, kind = asked[k]
                chosen = taken.setdefault(i, Taken([]))
                if (a, b) not in chosen:
                    chosen.add(a, b)
                    found[i].append((a, rank, b, kind))
        return base, [sorted(f) for f in found]

    return fn


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


SCHEMA = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, redacted string"


def find(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", redact: bool = True) -> DataFrame:
    """Per row: id, counts and digest of the base spans, all spans and, if ``redact``, the text without them.

    Positions count code points, ends are exclusive. Null texts count as empty and
    have no spans; equal texts give equal results; an empty table gives no rows;
    other columns are ignored. Very long texts are searched whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        fn = finder(model)

        def rows(ids, texts):
            base, every = fn(texts)
            counts = [[sum(s[3] == k for s in b) for b in base] for k in BASE]
            out = [ids, *counts, [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], [joined(e) for e in every]]
            return [*out, [blank(t, e) for t, e in zip(texts, every, strict=True)]] if redact else out

        return rows

    schema = SCHEMA if redact else SCHEMA.rsplit(",", 1)[0]
    return map_texts(docs, id_col, text_col, make, f"{id_col} {kind}, {schema}")


def blank(text: str, spans) -> str:
    """The text with each run of overlapping spans replaced by the first one's kind."""
    out, at = [], 0
    for a, _, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs), redact=False)
