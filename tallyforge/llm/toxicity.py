"""Toxicity by weak supervision.

Many voters look at a text. Lexicon voters: lists of abuse in four languages written
down here, and families of words, one for each root, that occur far more often
in abusive training documents than in others, whatever their language. Pattern
voters: number, density, kinds and spread of such words, and, without any
lexicon, shouting, exclamations, marks, address and repetition; some vote for a clean text.
A voter that doesn't fire abstains, so that a text in one language isn't held clean
because the lexicons of the others are silent. A generative model takes each voter
as a noisy view of the hidden class: EM, which starts from the majority of the
votes and not from the labels, estimates its rates of firing in both classes, and the
correlations of voters within a class, by which voters that repeat each other are
weighed down. A logistic regression over the words' counts and the patterns is then
trained on the model's posteriors, and scores every text.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_sample, map_texts, table
from .quality import Memo

#: Labelled training rows used at most.
SAMPLE = 8000
#: Words and word starts kept as features; families of these that vote, those with the most support; letters of a family's root.
TERMS, FAMILIES, ROOT = 400, 64, 4
#: Lengths of word starts; None is the whole word.
STARTS = (None, 4, 5, 6)
#: A term occurs in so many abusive training documents at least, as a number and as a share,
#: and so many times as often as in others.
LEAST_DOCS, LEAST_SHARE, LEAST_RATIO = 5, 0.015, 8.0
THRESHOLD = 0.3
#: Abuse by language, as starts of words.
LEXICONS = {
    "english": ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "dumbass", "bastard", "vermin"),
    "spanish": ("idiota", "imbécil", "estúpid", "basura", "asqueros", "inútil", "payas", "cabrón"),
    "french": ("idiot", "imbécile", "stupide", "ordure", "dégoûtant", "minable", "connard", "salaud"),
    "german": ("idiot", "dummkopf", "blöd", "abschaum", "widerlich", "wertlos", "arschloch", "trottel"),
}
ADDRESS = frozenset("you your yourself du dich dein deine ihr euch tú ti tus eres vosotros tu toi ton vous votre".split())
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text leaves 2 by 4; a row without id counts as training, but has no label."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def terms_of(word: str) -> tuple[str, ...]:
    low = word.strip(_STRIP).lower()
    return ("=" + low, *(f"{n}{low[:n]}" for n in STARTS[1:] if len(low) >= n)) if low else ()


def choose_terms(texts: list[str], toxic: list[int]) -> list[str]:
    """The terms that tell most: by document frequency among abusive texts times the log of its ratio to that among others.

    Terms are counted where they occur at all, and where they occur twice: the root of a
    language's abuse can stand in ordinary words too, but seldom more than once. The
    latter need the former to half of its ratio, so that words of any long text don't count.
    """
    memo = Memo(terms_of)
    n = [max(1, toxic.count(0)), max(1, len(toxic) - toxic.count(0))]
    told: dict[str, float] = {}
    seen = [(Counter(), Counter()), (Counter(), Counter())]
    for text, y in zip(texts, toxic, strict=True):
        words = Counter(f for w, c in Counter(text.split()).items() for f in memo[w] for _ in range(min(c, 2)))
        seen[0][bool(y)].update(words.keys())
        seen[1][bool(y)].update(f for f, c in words.items() if c > 1)
    # One occurrence is added to the clean side, so that rare terms need more evidence.
    ratios = [{f: (c / n[1]) / ((clean[f] + 1) / n[0]) for f, c in bad.items() if c >= max(LEAST_DOCS, LEAST_SHARE * n[1])} for clean, bad in seen]
    for ratio, (_, bad) in zip(ratios, seen, strict=True):
        for f, r in ratio.items():
            if r >= LEAST_RATIO and ratios[0][f] >= LEAST_RATIO / 2:
                told[f] = max(told.get(f, 0.0), bad[f] * math.log(r))
    return sorted(told, key=lambda f: (-told[f], f))[:TERMS]


def family(term: str) -> str:
    return term[1 : 1 + ROOT]


def families_of(terms: list[str]) -> list[str]:
    """The families that vote; terms are in the order of what they tell."""
    return list(dict.fromkeys(map(family, terms)))[:FAMILIES]


#: Patterns of the hits, then those of the text alone, then votes for a clean text.
HIT_PATTERNS, TEXT_PATTERNS, CLEAN_PATTERNS = 8, 5, 3
PATTERNS = HIT_PATTERNS + TEXT_PATTERNS


def view(words: list[str], hits: Memo, size: int) -> tuple[dict[int, float], list[str | int], list[int]]:
    """Features of a text, the lexicons and patterns that vote for abuse, and the patterns that vote against."""
    found, places, voters, marked, shouted, spoken = [], [], set(), 0, 0, 0
    # Most words say nothing and are passed over.
    for i, (own, lexicons, shout, mark, address) in [(i, h) for i, h in enumerate(map(hits.__getitem__, words)) if h]:
        if own:
            found += own
            places.append(i)
        if lexicons:
            voters.update(lexicons)
        shouted += shout
        marked += mark
        spoken += address
    n, count = max(1, len(words)), Counter(found)
    total, kinds = len(places), len(count)
    share = total / n
    close = any(b - a <= 12 for a, b in zip(places, places[1:], strict=False))
    wide = total > 1 and places[0] < n // 2 <= places[-1]
    most = max(Counter(words).values(), default=0) / n
    patterns = (total >= 2, total >= 4, kinds >= 2, total >= 2 and share >= 0.005, total >= 2 and share >= 0.015, total >= 2 and share >= 0.04, close, wide, shouted >= 0.3 * n, marked >= 0.2 * n, spoken >= 0.03 * n, most >= 0.2, total >= 1 and shouted >= 0.3 * n)
    x = {f: math.log1p(c) for f, c in count.items()} | {size + i: 1.0 for i, p in enumerate(patterns) if p}
    clean = (not total, total <= 1 and n >= 40, share < 0.002)
    return x, [*sorted(voters), *(i for i, p in enumerate(patterns) if p)], [i for i, p in enumerate(clean) if p]


def label_model(votes: np.ndarray, against: np.ndarray, lexicons: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, dict]:
    """Posteriors of the hidden class for votes (documents x voters, 1 where a voter fires), and the rates.

    ``against`` tells the voters for the other class. Of ``lexicons`` only those that
    fire count, as another language's are silent; of the others silence counts too.
    EM starts from the majority of the votes, as if they were independent, and estimates
    the rates. Its classes give the voters' correlations within a class: in the posteriors
    a voter weighs 1 over 1 plus the sum of its absolute correlations with the others,
    so that those that repeat each other don't make them too sure. (EM with these
    weights loses its classes: what fires seldom has no say, and the rest looks alike.)
    """
    score = votes[:, ~against].sum(1) - votes[:, against].sum(1)
    q, weight = np.where(score > 0, 0.9, 0.02), np.ones(votes.shape[1])

    def rates_of(q):
        return np.stack([((w[:, None] * votes).sum(0) + 0.5) / (w.sum() + 1.0) for w in (1 - q, q)])

    def posterior(rates, prior):
        llr = votes @ (weight * np.log(rates[1] / rates[0]))
        llr += (1 - votes[:, ~lexicons]) @ (weight * np.log((1 - rates[1]) / (1 - rates[0])))[~lexicons]
        return 1 / (1 + np.exp(-np.clip(llr + math.log(prior / (1 - prior)), -30, 30)))

    for _ in range(rounds):
        new = posterior(rates_of(q), np.clip(q.mean(), 1e-3, 1 - 1e-3))
        done = np.abs(new - q).max() < 1e-5
        q = new
        if done:
            break
    rates, prior = rates_of(q), float(np.clip(q.mean(), 1e-3, 1 - 1e-3))
    cov = sum((w[:, None] * (votes - r)).T @ (votes - r) for w, r in ((1 - q, rates[0]), (q, rates[1]))) / len(q)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    weight = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(0))
    return posterior(rates, prior), {"prior": prior, "rates": rates, "correlation": corr, "weight": weight}


def one_of_each(texts: list[str], sketch: int = 4, alike: float = 0.8) -> list[int]:
    """Indices of texts, one of each group of near copies: those with so large a share of word pairs in common.

    Words that a large group of copies has in common would else look like terms. Texts
    that have one of their least hashes of word pairs in common are compared; only
    what the whole sets of pairs confirm is left out.
    """
    kept, near, pairs_of = [], defaultdict(list), {}
    for i, text in enumerate(texts):
        words = text.lower().split()
        own = map(" ".join, zip(words, words[1:], strict=False)) if len(words) > 1 else words
        pairs = np.unique(np.array([crc32(x.encode("utf-8", "surrogatepass")) for x in own], np.uint32))
        least = pairs[:sketch].tolist()
        others = {j for h in least for j in near[h] if alike <= len(pairs_of[j]) / len(pairs) <= 1 / alike}
        common = [(len(np.intersect1d(pairs_of[j], pairs, assume_unique=True)), len(pairs_of[j])) for j in others]
        if any(c >= alike * (n + len(pairs) - c) for c, n in common):
            continue
        kept.append(i)
        pairs_of[i] = pairs
        for h in least:
            near[h].append(i)
    return kept


def fit(texts: list[str], toxic: list[int]) -> dict:
    """Terms, label model and classifier. The labels choose the terms only. Without abusive examples every score is low."""
    own = one_of_each(texts)
    texts, toxic = [texts[i] for i in own], [toxic[i] for i in own]
    terms = choose_terms(texts, toxic)
    index = {f: i for i, f in enumerate(terms)}
    model = {"index": index, "w": np.zeros(len(terms) + PATTERNS), "b": -4.0}
    if not terms:
        return model
    hits, names = hit_memo(index), [*LEXICONS, *families_of(terms)]
    place = {v: i for i, v in enumerate(names)} | {i: len(names) + i for i in range(PATTERNS)}
    against = np.zeros(len(place) + CLEAN_PATTERNS, bool)
    against[len(place) :] = True
    votes, x = np.zeros((len(texts), len(against))), np.zeros((len(texts), len(terms) + PATTERNS))
    for i, text in enumerate(texts):
        features, for_, clean = view(text.split(), hits, len(terms))
        votes[i, [place[v] for v in for_ if v in place]] = 1
        votes[i, [len(place) + c for c in clean]] = 1
        for f, v in features.items():
            x[i, f] = v
    q, rates = label_model(votes, against, np.arange(len(against)) < len(names))
    p, m, v = np.zeros(x.shape[1] + 1), 0.0, 0.0
    p[-1] = -3.0
    for i in range(1, 301):
        e = (1 / (1 + np.exp(-np.clip(x @ p[:-1] + p[-1], -30, 30))) - q) / len(q)
        g = np.append(x.T @ e + 1e-4 * p[:-1], e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return model | {"w": p[:-1], "b": float(p[-1]), "label_model": rates, "voters": names}


def hit_memo(index: dict[str, int]) -> Memo:
    """Word to the feature that it holds (the whole word, else its longest start), its voters, and whether it shouts, marks and addresses; empty if none of it."""
    starts = [(w, name) for name, words in LEXICONS.items() for w in words]
    roots = set(families_of(list(index)))

    def hit(word):
        own = next((f for f in terms_of(word)[:1] + terms_of(word)[:0:-1] if f in index), None)
        low = word.strip(_STRIP).lower()
        voters = {name for w, name in starts if low.startswith(w)}
        if own is not None and family(own) in roots:
            voters.add(family(own))
        letters = sum(c.isalpha() for c in word)
        said = ((index[own],) if own is not None else ()), tuple(sorted(voters)), letters > 1 and word.isupper(), letters * 2 < len(word) or word[-2:] in ("!!", "??"), low in ADDRESS
        return said if any(said) else ()

    return Memo(hit)


def score_all(texts, model, hits) -> np.ndarray:
    w, size = model["w"], len(model["index"])
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        x, *_ = view(text.split(), hits, size)
        out[i] = model["b"] + sum(w[f] * v for f, v in x.items())
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE) -> dict:
    """The model, from at most ``limit`` labelled rows that are not held out; empty tables leave one that finds nothing."""
    rows = labelled_sample(docs, labels, id_col, text_col, limit, keep=lambda c: ~held_out(c))
    return fit([r[1] for r in rows], [int(r["toxic"]) for r in rows])


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score, predicted. Only the text is an input of the score.

    Null and empty texts get the score of a text without any term; equal texts get
    equal scores; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        hits = hit_memo(model["index"])

        def rows(ids, texts):
            s = score_all(texts, model, hits)
            return ids, s, (s >= threshold).astype(np.int32)

        return rows

    scored = map_texts(docs, id_col, text_col, make, f"{id_col} {kind}, score double, predicted int")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
