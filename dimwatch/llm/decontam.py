"""Benchmark decontamination: BM25 over test items with block-max WAND, queried with every passage of every document.

Test items are the indexed side. Terms are pairs of neighbouring words: single words of everyday language add up to any
bound. BM25 weights are divided by the item's weight against itself, so a score is the share of an item that a passage
holds and one threshold fits all items. A document is read as overlapping
passages. A passage whose terms' upper bounds don't reach the threshold has no WAND pivot and is passed over at once,
for all passages of a document together; the others walk the postings by block-max WAND and retrieve every item at or
above the threshold. An item counts if the document around the passage also holds enough of the word triples of its
question and of its answer.

Passages are as long as the items need that they are held against: items are indexed by layers of lengths, 64 words,
128 and so on, and each layer reads a document in passages of its own length, so what an item matches does not depend
on the other items.

The index goes to every task, so it is made for blocks of bounded numbers of items and bytes, each block against all
documents; document frequencies and mean length are those of all items, whatever the blocks. Null and empty texts
match nothing, nor do items of fewer than two words, which have no pair; repeated items and rows are reported each;
long texts are read whole, one passage list at a time; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Usual BM25 constants; postings in a block.
K1, B, BLOCK = 1.2, 0.75, 8
#: Share of an item's weight that a passage must hold; share of the question's and answer's triples that must be there.
THRESHOLD, OVERLAP = 0.5, 0.5
#: Words in the shortest passages; longer items have passages of twice, four times and so on as many.
PASSAGE = 64
#: Items and bytes of text in a block of the index, about.
MOST_ITEMS, MOST_BYTES = 20_000, 16_000_000
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def pairs(own: list[str]) -> list[tuple[str, str]]:
    return list(zip(own, own[1:], strict=False))


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words up to its first question mark and after; its halves if there is none or nothing after."""
    head, mark, tail = text.partition("?")
    q, a = words(head), words(tail)
    if mark and q and a:
        return q, a
    every = words(text)
    return every[: (len(every) + 1) // 2], every[(len(every) + 1) // 2 :]


def overlap(part: list[str], around: list[str]) -> float:
    """Share of the part's distinct word triples (shorter parts: the part itself) in the words around; 1 for no words."""
    n = min(3, len(part))
    if not n:
        return 1.0
    own = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
    there = {tuple(around[i : i + n]) for i in range(len(around) - n + 1)}
    return len(own & there) / len(own)


def passage_length(n_words: int) -> int:
    """Words in the passages that an item of so many words is held against."""
    length = PASSAGE
    while length < n_words:
        length *= 2
    return length


@dataclass
class Layer:
    """Postings of items of like length: for each term its item numbers, weights, and the largest weight of each BLOCK."""

    ids: list
    parts: list[tuple[list[str], list[str]]]
    vocabulary: dict[str, int]
    terms: np.ndarray
    items: list[list[int]]
    weights: list[list[float]]
    block_max: list[list[float]]
    bounds: np.ndarray
    passage: int

    @classmethod
    def of(cls, ids: list, texts: list[str], frequency: dict[tuple[str, str], int], n_items: int, mean_length: float, passage: int) -> Layer:
        """frequency: items that hold each pair, of n_items items with mean_length pairs."""
        split = [pairs(words(t)) for t in texts]
        postings: dict[tuple[str, str], list[tuple[int, float]]] = {}
        for i, own in enumerate(split):
            raw = {}
            for term, tf in Counter(own).items():
                idf = math.log(1 + (n_items - frequency[term] + 0.5) / (frequency[term] + 0.5))
                raw[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / mean_length))
            whole = sum(raw.values())
            for term, weight in raw.items():
                postings.setdefault(term, []).append((i, weight / whole))
        vocabulary = {w: k for k, w in enumerate(sorted({w for t in postings for w in t}))}
        keys = {vocabulary[a] * len(vocabulary) + vocabulary[b]: postings[a, b] for a, b in postings}
        terms = np.array(sorted(keys), np.int64)
        lists = [keys[t] for t in terms.tolist()]
        weights = [[w for _, w in x] for x in lists]
        maxima = [[max(w[j : j + BLOCK]) for j in range(0, len(w), BLOCK)] for w in weights]
        return cls(ids, [question_and_answer(t) for t in texts], vocabulary, terms, [[i for i, _ in x] for x in lists], weights, maxima, np.array([*map(max, weights), 0.0]), passage)

    def retrieve(self, query: set[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """Items whose summed weight of the query's terms reaches the threshold, by block-max WAND."""
        items, weights, maxima, bounds = self.items, self.weights, self.block_max, self.bounds
        least = threshold - 1e-9
        cursors = [[items[t][0], t, 0] for t in query]
        found = []

        def move(cursor: list, to: int) -> None:
            at = bisect_left(items[cursor[1]], to, cursor[2])
            cursor[2], cursor[0] = at, items[cursor[1]][at] if at < len(items[cursor[1]]) else len(self.ids)

        while True:
            cursors = [c for c in cursors if c[0] < len(self.ids)]
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for c in cursors:
                total += bounds[c[1]]
                if total >= least:
                    pivot = c[0]
                    break
            if pivot < 0:
                return found
            upto = [c for c in cursors if c[0] <= pivot]
            total, skip_to = 0.0, next((c[0] for c in cursors if c[0] > pivot), len(self.ids))
            for c in upto:
                at = bisect_left(items[c[1]], pivot, c[2])
                if at < len(items[c[1]]):
                    total += maxima[c[1]][at // BLOCK]
                    skip_to = min(skip_to, items[c[1]][min(at // BLOCK * BLOCK + BLOCK, len(items[c[1]])) - 1] + 1)
            if total < least:  # nothing before the next block boundary, or the next list's item, can reach it
                for c in upto:
                    move(c, skip_to)
            elif upto[0][0] == pivot:
                score = math.fsum(weights[c[1]][c[2]] for c in upto)
                if score >= least:
                    found.append((pivot, score))
                for c in upto:
                    move(c, pivot + 1)
            else:
                for c in upto:
                    if c[0] < pivot:
                        move(c, pivot)

    def matches(self, own: list[str], threshold: float = THRESHOLD, least: float = OVERLAP) -> dict[int, tuple[float, float, float]]:
        """For each item that a text of these words holds: the best passage's score, and the shares of question and
        answer found."""
        ids = np.fromiter(map(self.vocabulary.get, own, repeat(-1)), np.int64, len(own))
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        keys = ids[at] * len(self.vocabulary) + ids[at + 1]
        place = np.minimum(np.searchsorted(self.terms, keys), len(self.terms) - 1)
        there = self.terms[place] == keys
        terms = np.full(len(own), -1)  # of the pair that starts at each word
        terms[at[there]] = place[there]
        half = self.passage // 2
        ahead = np.concatenate([[0.0], np.cumsum(self.bounds[terms])])  # term -1 has bound 0
        starts = np.arange(0, max(1, len(own) - half), half)
        ends = np.minimum(starts + self.passage, len(own))
        found: dict[int, tuple[float, float, float]] = {}
        for k in np.flatnonzero(ahead[ends] - ahead[starts] >= threshold - 1e-9):
            a, b = int(starts[k]), int(ends[k])
            query = set(terms[a : b - 1].tolist()) - {-1}
            if self.bounds[list(query)].sum() < threshold - 1e-9:
                continue
            for item, score in self.retrieve(query, threshold):
                if item in found and found[item][0] >= score:
                    continue
                around = own[max(0, a - half) : b + half]
                q, r = (overlap(part, around) for part in self.parts[item])
                if q >= least and r >= least:
                    found[item] = (score, q, r)
        return found


@dataclass
class Index:
    """A block of items in layers by length."""

    layers: list[Layer]

    def matches(self, text: str | None) -> list[tuple]:
        """Of each item that the text holds: id, the best passage's score, and the shares of question and answer."""
        if not text:
            return []
        own = words(text)
        return [(layer.ids[k], *v) for layer in self.layers for k, v in layer.matches(own).items()]


def indexes(items: DataFrame, key: str = "item_id", text: str = "text", most_items: int = MOST_ITEMS, most_bytes: int = MOST_BYTES) -> Iterator[Index]:
    """The index of all items with a pair of words, block by block."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [" ".join(x) for x in pairs(words(t))])

    rows = items.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    rows = rows.groupBy("k", "t").agg(F.count("*").alias("n")).withColumn("pairs", split("t")).where(F.size("pairs") > 0)
    rows = written(rows.select("k", "t", "n", "pairs"))
    n_items, n_pairs, size = rows.agg(F.sum("n"), F.sum(F.col("n") * F.size("pairs")), F.sum(F.col("n") * F.octet_length("t"))).first()
    if not n_items:
        return
    blocks = max(1, -(-n_items // most_items), -(-size // most_bytes))
    terms = rows.select("k", "t", "n", F.explode(F.array_distinct("pairs")).alias("pair"))
    held = terms.groupBy("pair").agg(F.sum("n").alias("items"))
    own = terms.join(held, "pair").groupBy("k", "t", "n").agg(F.collect_list(F.struct("pair", "items")).alias("held"))
    own = written(own.withColumn("block", F.pmod(F.xxhash64("k", "t"), F.lit(blocks))))
    for i in range(blocks):
        by_length: dict[int, list] = {}
        frequency = {}
        for r in own.where(F.col("block") == i).orderBy("k", "t").collect():
            by_length.setdefault(passage_length(len(words(r["t"]))), []).extend([r] * r["n"])
            frequency.update((tuple(x["pair"].split(" ")), x["items"]) for x in r["held"])
        if by_length:
            yield Index([Layer.of([r["k"] for r in rs], [r["t"] for r in rs], frequency, n_items, n_pairs / n_items, length) for length, rs in sorted(by_length.items())])


def contaminated(index: Index, text: Column) -> Column:
    """Whether a text holds an item of the index."""

    @F.pandas_udf("boolean")
    def held(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(index.matches(t)) for t in texts], dtype=bool)

    return held(text)


def contaminations(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", most_items: int = MOST_ITEMS) -> DataFrame:
    """A row for each document and item that it holds: key, item_key, score, question_overlap, answer_overlap."""
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(items, item_key, item_text, most_items):

        def search(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(i, *match) for i, t in enumerate(b.column(1)) for match in index.matches(t.as_py())]
                if rows:
                    at, ids, *scores = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(ids), *(pa.array(x, pa.float64()) for x in scores)], names=[key, item_key, "score", "question_overlap", "answer_overlap"])

        out = out.unionByName(docs.select(key, text).mapInArrow(search, schema))
    return out
