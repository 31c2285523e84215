"""Language by rank order of character n-grams (Cavnar and Trenkle).

A profile is a text's most frequent n-grams of 1 to 4 characters in order of frequency, ties in order of their code.
Letters are lower-cased, everything else becomes one space, which also starts and ends the text. The distance of a
document to a language is the sum over the document's profile of how far each n-gram is out of place, the profile's
length for one that the language lacks; the nearest language wins, ties go to the first by name.

Null texts and texts without a letter are `und`, score 0; whole texts count, however long; repeated rows are alike;
only text is an input. Code points are taken modulo 65,536 within n-grams.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, hashed, least_hashes, texts_of

#: n-grams in a profile, and the largest n.
LENGTH, MOST_N = 300, 4
#: Training texts of each language, at most, chosen by their hashes.
SAMPLE = 600
#: Of the softmax over mean distances (0 to 1) that gives the score.
TEMPERATURE = 0.03

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """The text's n-grams, packed 16 bits a character; none if it has no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[code]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    code = np.concatenate([[32], np.where(is_letter, code, 32), [32]]).astype(np.uint64) & np.uint64(0xFFFF)
    space = code == 32
    code = code[~(space & np.concatenate([[False], space[:-1]]))]
    out, key = [code], code
    for n in range(2, MOST_N + 1):
        key = (key[:-1] << np.uint64(16)) | code[n - 1 :]
        out.append(key)
        if len(key) < 2:
            break
    return np.concatenate(out)


def top(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The LENGTH most frequent keys in order."""
    if len(keys) > LENGTH:
        least = np.partition(counts, len(counts) - LENGTH)[len(counts) - LENGTH]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:LENGTH]


def profile(text: str) -> np.ndarray:
    return top(*np.unique(grams(text), return_counts=True))


@dataclass
class Profiles:
    """Languages; all their n-grams in order; each language's rank of each, -1 if it lacks it."""

    names: list[str]
    keys: np.ndarray
    ranks: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile(text) if text else np.zeros(0, np.uint64)
        if not len(own) or not self.names:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        ranks = self.ranks[:, at]
        away = np.where((ranks < 0) | (self.keys[at] != own), LENGTH, np.abs(ranks - np.arange(len(own))))
        distance = away.sum(axis=1) / (LENGTH * len(own))
        best = int(distance.argmin())
        return self.names[best], float(1 / np.exp((distance[best] - distance) / TEMPERATURE).sum())


def fit(texts: list[str], langs: list[str]) -> Profiles:
    """Profiles of the languages of labelled texts."""
    made = {}
    for name in sorted(set(langs)):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        own = [t for t, x in zip(texts, langs, strict=True) if x == name]
        for i in range(0, len(own), 50):  # n-grams of so many texts at a time
            k, c = np.unique(np.concatenate([grams(t) for t in own[i : i + 50]]), return_counts=True)
            merged, where = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, c]), len(merged)).astype(np.int64)
            keys = merged
        if len(keys):
            made[name] = top(keys, counts)
    every = np.unique(np.concatenate([*made.values(), np.zeros(0, np.uint64)]))
    ranks = np.full((len(made), len(every)), -1, np.int64)
    for i, own in enumerate(made.values()):
        ranks[i, np.searchsorted(every, own)] = np.arange(len(own))
    return Profiles(list(made), every, ranks)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Profiles:
    """Profiles from at most `sample` distinct texts of each language."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    chosen = least_hashes(known.select(F.col(lang).cast("string").alias("g"), hashed(F.col(text)).alias("h")), sample)
    texts = texts_of(known, text, hashed(F.col(text)), chosen)
    return fit([texts[r["h"]] for r in chosen], [r["g"] for r in chosen])


def predict(profiles: Profiles, text: Column) -> Column:
    """struct(lang_pred, score) of a text."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predicted(text)


def identified_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred and score of every document; rows of the fold CRC-32 mod 4 = 2 are never learnt from."""
    profiles = learn(docs.where(fold(key, 4) != 2), text, lang)
    out = docs.select(F.col(key), (fold(key, 4) == 2).alias("held_out"), predict(profiles, F.col(text)).alias("found"))
    return out.select(key, "held_out", "found.lang_pred", "found.score")
