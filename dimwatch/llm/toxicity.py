"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, takes compatibility forms apart, drops marks and invisible characters, joins white space and maps look-alike
letters, digits and signs of other scripts to one Latin skeleton, so "1d10t", "ídiot" and "idiot" fold alike, whatever else a text holds. The lexicon is
learnt from labelled documents: words whose log odds of a toxic document are high and which toxic documents use in
several different contexts. Phrases around a lexicon word that only clean documents use are exceptions; matches inside
them don't count. A logistic curve over the matched weight and its density by length gives the score.

Null and empty texts match nothing and get the curve's value at no match, below 0.5; whole texts are matched, however
long; repeated rows score alike; other columns are never read.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, hashed, least_hashes, texts_of, written

#: Labelled documents of each class that the lexicon and curve are fitted on, at most.
SAMPLE = 3000
#: Distinct (word before, word after) pairs in toxic documents that a lexicon word needs, its least log odds, and the
#: lexicon's largest size.
LEAST_CONTEXTS, LEAST_WEIGHT, MOST_WORDS = 4, 3.0, 20_000
#: Clean documents that must use a phrase for an exception.
LEAST_CLEAN = 2

# Look-alikes of Latin letters. i, l and 1 share one skeleton, as each stands for the others.
CYRILLIC = dict(zip("авеокмнрстухіјѕԁԛԝ", "abeokmhpctyxljsdqw", strict=True))
GREEK = dict(zip("αβγεηικνορτυχω", "abyenlkvoptuxw", strict=True))
DIGITS = dict(zip("013456789", "oleasgtbg", strict=True))
SIGNS = {"@": "a", "$": "s", "€": "e", "ı": "l", "ɩ": "l", "ο": "o", "℮": "e"}
INVISIBLE = "­​‌‍⁠﻿"
#: Marks that stand on other characters.
MARKS = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
TABLE = str.maketrans(CYRILLIC | GREEK | DIGITS | SIGNS | {"i": "l"} | dict.fromkeys([*INVISIBLE, *MARKS]))
_WORD = re.compile(r"\w+")


def folded(text: str) -> str:
    """The skeleton that is matched."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return " ".join(text.lower().translate(TABLE).split())


def _curve_inputs(weight: float, n_words: int) -> tuple[float, float, float]:
    return 1.0, math.log1p(weight), math.log1p(1000 * weight / (n_words + 20))


@dataclass
class Lexicon:
    """Weighted folded words, exception phrases, and the curve's three coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """The lexicon's automaton."""

    def __init__(self, lexicon: Lexicon) -> None:
        import ahocorasick

        self.curve, self.automaton = lexicon.curve, ahocorasick.Automaton()
        for phrase in lexicon.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        for word, weight in lexicon.weights.items():
            self.automaton.add_word(word, (len(word), weight))
        if len(self.automaton):
            self.automaton.make_automaton()

    def weight(self, text: str) -> float:
        """Sum of the weights of the lexicon words in a folded text, outside exception phrases."""
        if not len(self.automaton):
            return 0.0
        hits: list[tuple[int, int, float]] = []
        spared: list[tuple[int, int]] = []
        for end, (n, weight) in self.automaton.iter(text):
            start = end - n + 1
            if (start == 0 or not text[start - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
                if weight is None:
                    spared.append((start, end))
                else:
                    hits.append((start, end, weight))
        spared.sort()
        starts, reach = [x for x, _ in spared], list(accumulate((y for _, y in spared), max))
        return sum(w for a, b, w in hits if not (k := bisect_right(starts, a)) or reach[k - 1] < b)

    def score(self, text: str | None) -> float:
        f = folded(text or "")
        x = sum(map(float.__mul__, self.curve, _curve_inputs(self.weight(f), f.count(" ") + 1 if f else 0)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def fit(texts: list[str], toxic: list[int], share: float) -> Lexicon:
    """A lexicon from labelled texts; share: of toxic documents in the population, which the sample need not keep."""
    unique = dict(zip(texts, toxic, strict=True))  # copies count once
    if not 0 < sum(unique.values()) < len(unique):
        return Lexicon()
    skeletons = [(folded(t), y) for t, y in unique.items()]
    docs: tuple[Counter, Counter] = (Counter(), Counter())
    contexts: dict[str, set[tuple[str, str]]] = defaultdict(set)
    for text, y in skeletons:
        words = _WORD.findall(text)
        docs[y].update(set(words))
        if y:
            for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                if len(contexts[word]) < LEAST_CONTEXTS:
                    contexts[word].add((before, after))
    totals = [sum(y == k for _, y in skeletons) for k in (0, 1)]
    odds = {w: math.log((n + 0.5) / (totals[1] + 1)) - math.log((docs[0][w] + 0.5) / (totals[0] + 1)) for w, n in docs[1].items() if len(contexts[w]) >= LEAST_CONTEXTS}
    weights = dict(sorted(((w, x) for w, x in odds.items() if x >= LEAST_WEIGHT), key=lambda p: (-p[1], p[0]))[:MOST_WORDS])
    phrases: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in skeletons:
        words = _WORD.findall(text)
        phrases[y].update({f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a in weights or b in weights})
    exceptions = sorted(p for p, n in phrases[0].items() if n >= LEAST_CLEAN and not phrases[1][p])
    matcher = Lexicon(weights, exceptions).matcher()
    x = np.array([_curve_inputs(matcher.weight(t), t.count(" ") + 1 if t else 0) for t, _ in skeletons])
    y = np.array([y for _, y in skeletons], float)
    w = np.where(y == 1, share / totals[1], (1 - share) / totals[0]) * len(y)
    beta = np.zeros(3)
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(3)
        beta += np.linalg.solve(hessian, x.T @ (w * (y - p)) - 1e-1 * beta)
    return Lexicon(weights, exceptions, tuple(map(float, beta)))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """A lexicon from at most `sample` labelled texts of each class, chosen by their hashes. A document with several
    labels is toxic if one of them says so."""
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("g"))
    own = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), hashed(F.col(text)).alias("h"))
    rows = written(own.join(marked, "k").select("g", "h"))  # without ids and texts
    counts = {r["g"]: r["count"] for r in rows.groupBy("g").count().collect()}
    chosen = least_hashes(rows, sample)
    texts = texts_of(docs, text, hashed(F.col(text)), chosen)
    share = sum(n for y, n in counts.items() if y) / max(1, sum(counts.values()))
    return fit([texts[r["h"]] for r in chosen], [int(r["g"] > 0) for r in chosen], share)


def score(lexicon: Lexicon, text: Column) -> Column:
    """The score of a text, 0 to 1."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        matcher = _matcher(lexicon)
        return pd.Series([matcher.score(t) for t in texts], dtype=float)

    return scored(text)


_last: list = []


def _matcher(lexicon: Lexicon) -> Matcher:
    """The lexicon's matcher, built once in each Python worker."""
    if not _last or _last[0] != lexicon:
        _last[:] = [lexicon, lexicon.matcher()]
    return _last[1]


def scored_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted of every document; labels of the fold CRC-32 mod 5 = 0 are never seen."""
    lexicon = learn(docs, labels.where(fold(key, 5) != 0), key, text)
    out = docs.select(F.col(key), (fold(key, 5) == 0).alias("held_out"), score(lexicon, F.col(text)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
