"""LM scoring: a causal self-attention model on ids of words and subwords, trained and run in numpy.

Words are white-space separated, A-Z lower-cased. As many of the most frequent ones as 16 bits leave room for are ids of
their own; any other word is encoded on its own by a public sentencepiece vocabulary, and stands in the line of ids by its
first piece. An end closes the text. The model reads windows of CONTEXT + STRIDE ids: the first CONTEXT are context from the window
before, the last STRIDE each predict their next id, so every id is scored once, in batches of masked attention. The
output layer is factored by superclasses and classes of ids: attention gives both, and counts over all training
documents the id within its class, smoothed so that every text has a probability. A word that is spelled has a share of those
that begin with its first piece: by its own count over all training documents, smoothed (Witten and Bell's way) by the
probability of its further pieces and end, each of which follows from the piece before by counts.
Classes come from neighbour counts over all training documents. Every window of every training document takes part in one step of training: documents are
dealt out to shards of about SHARD_IDS ids by a hash of id and text, in ROUNDS rounds; each shard of a round trains from
where the round starts, and their changes are averaged. The shards are the same however the input is split, each is trained
in order of the hash, and sums go over shards in their order, so the model doesn't depend on partitions or tasks.

The base score is an add-0.1 unigram over words. Word counts are gathered from all training documents by a shuffle and
stay a table. A bounded head of the most frequent short words goes to every task; the other words of a document are joined to
the table by word, so nothing that grows with the corpus is broadcast or collected.

Null and empty texts are one end token. Rows with null or repeated ids are scored each on its own; very long texts are
windows like any other; other columns are ignored; without training rows the counts are 0 and the model is uniform
over its smoothed classes.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, fold, free_name, scratch_dir, written

CONTEXT, STRIDE = 8, 16
WIDTH, KEY_WIDTH = 32, 16
#: Most frequent ids that are a class of their own, and classes of the other ids.
SINGLE, GROUPS = 96, 160
#: Superclasses, and classes of each.
SUPER = 16
#: Ids of a shard, about; rounds of shards, with windows a step and learning rate of each round.
SHARD_IDS = 1_000_000
ROUNDS = ((96, 4e-3), (384, 2e-3), (384, 1e-3))
#: Shards of the first rounds, as shares of all; the last round has the rest.
SHARES = (0.05, 0.25)
#: Sparse rows that tasks send to be summed: 32-bit places, and 32-bit values of each, which are summed in 64 bits.
PIECE = "part long, name string, at binary, value binary"
#: Words in the head that goes to every task, and the bytes of the longest ones.
HEAD, LONGEST = 65_536, 64
#: Pieces that are summed at once.
FAN_IN = 16
#: Windows scored together, and windows of a step that are worked through together: few enough for their arrays to stay in the
#: cache and in memory that the process keeps, so no parameter of the model depends on them but by single precision.
TOGETHER, BLOCK = 256, 128
#: Distinct words whose ids a task keeps.
MOST_KEPT = 400_000
UNKNOWN, BEGIN, END = 0, 1, 2
#: The base score's addition to each count; the same within classes.
ADD = 0.1
#: How many counts a piece's share over all words weighs against its share after the piece before.
BACK = 10
LN10 = math.log(10)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of words of each."""
    if texts.offset:  # ascii_lower misreads slices of large strings
        texts = texts.take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # before leading and after trailing white space
        owner = np.repeat(np.arange(len(n)), n)
        n = n - np.bincount(owner[empty], minlength=len(n))
        flat = flat.filter(pa.array(~empty))
    return flat, n


class Subwords:
    """A sentencepiece model."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.model.get_piece_size()

    def pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words on one line, at least one a word, and the number of each word's."""
        coded = [x or [UNKNOWN] for x in self.model.encode(words, num_threads=1)]
        n = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.int32, n.sum()), n


def followers(line: np.ndarray, n: np.ndarray, end: int) -> np.ndarray:
    """What follows each piece of words on one line; end after a word's last."""
    after = np.append(line[1:], end)
    after[np.cumsum(n) - 1] = end
    return after


@dataclass
class Spelled:
    """Counts of words that are spelled. row: each piece's row in logs, log probabilities of what follows (pieces and, in the last
    column, the word's end); words: how many begin with each piece; kinds: how many different ones, 1 at least."""

    row: np.ndarray
    logs: np.ndarray
    words: np.ndarray
    kinds: np.ndarray


class Spelling:
    """Of words: their first pieces, and what adds to their counts (log10) and divides these for their shares of the words that
    begin with the same piece. Words that were met stay while there is room."""

    def __init__(self, model: bytes, counts: Spelled) -> None:
        self.subwords, self.counts = Subwords(model), counts
        self.clear()

    def clear(self) -> None:
        self.kept: dict[str, int] = {}
        self.first, self.prior = np.zeros(0, np.int32), np.zeros(0, np.float32)

    def of(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.kept) > MOST_KEPT:
            self.clear()
        c = self.counts
        at = np.fromiter(map(self.kept.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(unmet := np.flatnonzero(at < 0)):
            new = [distinct[i] for i in unmet.tolist()]
            at[unmet] = np.arange(len(self.kept), len(self.kept) + len(new))
            self.kept.update(zip(new, at[unmet].tolist(), strict=True))
            line, n = self.subwords.pieces(new)
            starts = np.cumsum(n) - n
            share = np.add.reduceat(c.logs[c.row[line], followers(line, n, self.subwords.size)], starts, dtype=np.float64) / LN10
            self.first = np.concatenate([self.first, line[starts]])
            self.prior = np.concatenate([self.prior, (np.log10(c.kinds[line[starts]]) + share).astype(np.float32)])
        first = self.first[at]
        return first, self.prior[at], c.words[first] + c.kinds[first]


def sequences(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts of n ids, each after a begin and before an end, on one line; and the number of ids of each text."""
    per_text = n + 2
    line, last = np.empty(per_text.sum(), np.int32), np.cumsum(per_text)
    inner = np.ones(len(line), bool)
    inner[last - 1] = inner[last - per_text] = False
    line[inner], line[last - per_text], line[last - 1] = ids, BEGIN, END
    return line, per_text


def id_type(size: int) -> type:
    """Of stored ids of a vocabulary."""
    return np.uint16 if size <= 2**16 else np.int32


def stored(line: np.ndarray, per_text: np.ndarray, size: int) -> pa.Array:
    """Sequences as bytes, one for each text."""
    kind = id_type(size)
    ends = np.concatenate([[0], np.cumsum(per_text)]) * np.dtype(kind).itemsize
    data = pa.py_buffer(line.astype(kind).tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(per_text), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), data]).cast(pa.binary())


def read_back(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequences that were stored, on one line, and the number of ids of each text."""
    kind = id_type(size)
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int32), lengths // np.dtype(kind).itemsize


def windows(per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts on one line: the place of each window's first predicting id, and its text's first and last place."""
    last = np.cumsum(per_text)
    count = -(-(per_text - 1) // STRIDE)
    text = np.repeat(np.arange(len(per_text)), count)
    turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = (last - per_text)[text]
    return first + turn * STRIDE, first, last[text] - 1


def window_ids(line: np.ndarray, start: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of windows and whether they are of the text; next ids of the predicting ones and whether there is one."""
    at = start[:, None] + np.arange(-CONTEXT, STRIDE)
    there = (at >= first[:, None]) & (at < last[:, None])
    ahead = start[:, None] + np.arange(1, STRIDE + 1)
    to_score = ahead <= last[:, None]
    at *= there
    ahead *= to_score
    return np.take(line, at), there, np.take(line, ahead), to_score


#: Distance from each predicting id to each id of its window, and where it would look ahead.
GAP = (CONTEXT + np.arange(STRIDE))[:, None] - np.arange(CONTEXT + STRIDE)
AHEAD = np.where(GAP < 0, np.float32(-np.inf), np.float32(0))
#: By matrix product, sums over the ids of a window take a third of the time.
ONES = np.ones(CONTEXT + STRIDE, np.float32)


def class_inputs(h: np.ndarray, p: dict[str, np.ndarray], cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log shares, but for sums, of the superclasses, and of the classes within each row's own superclass; a column for each row
    of h, which come in order of their superclasses and are cut by them. The largest of a column is 0."""
    one, two = p["o1"].T @ h.T, np.empty((SUPER, len(h)), np.float32)
    one += p["b1"][:, None]
    for g in np.flatnonzero(np.diff(cuts)):
        part = slice(cuts[g], cuts[g + 1])
        np.matmul(p["o2"][g].T, h[part].T, out=two[:, part])
    two += np.repeat(p["b2"].T, np.diff(cuts), axis=1)
    for z in (one, two):
        z -= z.max(axis=0)
    return one, two


def class_shares(h: np.ndarray, p: dict[str, np.ndarray], cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares by class_inputs."""
    one, two = class_inputs(h, p, cuts)
    for z in (one, two):
        np.exp(z, out=z)
        z /= z.sum(axis=0)
    return one, two


def by_superclass(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows by superclass; superclass and place within it in that order; where each superclass starts."""
    order = np.argsort((classes // SUPER).astype(np.int8), kind="stable")
    sup, sub = np.divmod(classes[order], SUPER)
    return order, sup, sub, np.searchsorted(sup, np.arange(SUPER + 1))


@dataclass
class Model:
    """Tables of queries, keys, values and inputs, each id's row in them (ids too rare for a vector of their own share
    their class's), biases by distance, the output layer, and ids' classes."""

    tables: np.ndarray
    rows: np.ndarray
    by_gap: np.ndarray
    out: dict[str, np.ndarray]
    classes: np.ndarray
    within: np.ndarray

    def score(self, line: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        totals = np.zeros(len(per_text))
        start, first, last = windows(per_text)
        text = np.searchsorted(np.cumsum(per_text), first, side="right")
        gap_bias = (self.by_gap[np.maximum(GAP, 0)] + AHEAD).astype(np.float32)
        k = KEY_WIDTH
        past, own = np.ascontiguousarray(self.tables[:, k : 2 * k + WIDTH]), np.ascontiguousarray(np.hstack([self.tables[:, :k], self.tables[:, 2 * k + WIDTH :]]))
        for a in range(0, len(start), TOGETHER):
            s = slice(a, a + TOGETHER)
            ids, there, after, to_score = window_ids(line, start[s], first[s], last[s])
            ids = self.rows[ids]
            seen, x = np.take(past, ids, axis=0, mode="clip"), np.take(own, ids[:, CONTEXT:], axis=0, mode="clip")
            weight = x[:, :, :k] @ seen[:, :, :k].transpose(0, 2, 1)
            weight += gap_bias
            np.exp(np.minimum(weight, 30, out=weight), out=weight)
            weight *= there[:, None, :]
            weight /= (weight @ ONES + np.float32(1e-20))[:, :, None]
            attended = weight @ seen[:, :, k:]
            attended += x[:, :, k:]
            rows = np.flatnonzero(to_score)
            target = after.ravel()[rows]
            order, sup, sub, cuts = by_superclass(self.classes[target])
            value, at = self.within[target[order]], np.arange(len(rows))
            for z, own_class in zip(class_inputs(np.take(attended.reshape(-1, WIDTH), rows[order], axis=0, mode="clip"), self.out, cuts), (sup, sub), strict=True):
                value += z[own_class, at]
                value -= np.log(np.exp(z, out=z).sum(axis=0))
            totals += np.bincount(np.repeat(text[s], STRIDE)[rows[order]], value, len(per_text))
        return totals / LN10


def neighbour_columns(counts: np.ndarray) -> np.ndarray:
    """Each id's column in neighbour counts: the most frequent ids have one each, the others share the last."""
    column = np.full(len(counts), 127)
    column[np.lexsort((np.arange(len(counts)), -counts))[:127]] = np.arange(127)
    return column


def neighbours(line: np.ndarray, per_text: np.ndarray, column: np.ndarray, near: np.ndarray) -> None:
    """Adds, for each id of the texts, what stands before it (columns 0 to 127) and after it (128 to 255)."""
    inside = np.ones(len(line), bool)
    inside[np.cumsum(per_text) - per_text] = False  # no pair goes from a text to the next
    at = np.flatnonzero(inside)
    before, after = line[at - 1].astype(np.int64), line[at].astype(np.int64)
    places = np.concatenate([after * 256 + column[before], before * 256 + 128 + column[after]])
    places = np.sort(places.astype(np.int32) if near.size < 2**31 else places)  # adding once at each place is faster than pair by pair
    starts = np.flatnonzero(np.diff(places, prepend=-1))
    near.reshape(-1)[places[starts]] += np.diff(starts, append=len(places)).astype(near.dtype)


def profiles(near: np.ndarray) -> np.ndarray:
    """Square roots of neighbour shares, in place of counts of 32 bits."""
    v = near.astype(np.float32, copy=False)
    v[:, :128] /= v[:, :128].sum(axis=1, keepdims=True) + 2
    v[:, 128:] /= v[:, 128:].sum(axis=1, keepdims=True) + 2
    return np.sqrt(v, out=v)


def classify(near: np.ndarray, counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A class for each id: the most frequent alone, the others by what stands next to them (k-means on profiles), ids
    that no training document has in one class. Classes are numbered so that SUPER like ones follow each other."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    classes = np.full(len(counts), SINGLE + GROUPS - 1)
    classes[order[:SINGLE]] = np.arange(SINGLE)
    rest = order[SINGLE:][counts[order[SINGLE:]] > 0]
    if len(rest) <= GROUPS:
        classes[rest] = SINGLE + np.arange(len(rest)) % GROUPS
    else:
        v = profiles(near[rest])
        centres = v[rng.choice(min(len(rest), 4 * GROUPS), GROUPS - 1, replace=False)]
        for _ in range(10):
            nearest = (v @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
            for g in range(GROUPS - 1):
                own = v[nearest == g]
                if len(own):
                    centres[g] = own.mean(axis=0)
        classes[rest] = SINGLE + nearest
    by_class = np.zeros((SINGLE + GROUPS, 256))
    np.add.at(by_class, classes, near)
    v, parts = profiles(by_class), [np.arange(SINGLE + GROUPS)]
    while len(parts) < SUPER:  # halves along the direction in which a part's classes differ most
        halves = []
        for part in parts:
            own = v[part] - v[part].mean(axis=0)
            along = own @ np.linalg.eigh(own.T @ own)[1][:, -1]
            ordered = part[np.lexsort((part, along))]
            halves += [ordered[: len(part) // 2], ordered[len(part) // 2 :]]
        parts = halves
    place = np.empty(SINGLE + GROUPS, np.int64)
    place[np.concatenate(parts)] = np.arange(SINGLE + GROUPS)
    return place[classes]


def ordered(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of places, where each distinct one starts in it, and how often it stands there."""
    order = np.argsort(at.astype(np.uint16) if at.max(initial=0) < 2**16 else at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return order, starts, np.diff(starts, append=len(at))


def summed(values: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of rows of values from each start to the next. Values are summed two by two, as complex numbers: numpy's sums of
    parts of rows cost by the number of rows."""
    return np.add.reduceat(np.take(values, rows, axis=0, mode="clip").view(np.complex64), starts, axis=0).view(np.float32)


def summed_by(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places and the sum of the rows of values at each."""
    order, starts, _ = ordered(at)
    return at[order[starts]], summed(values, order, starts)


class Learner:
    """Parameters of the model in training, and one step of Adam at a time."""

    def __init__(self, classes: np.ndarray, counts: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        smooth = counts + ADD
        total = np.bincount(classes, smooth, SUPER * SUPER)
        self.classes, self.within = classes, np.log(smooth / total[classes]).astype(np.float32)
        common = np.flatnonzero(counts >= 8)
        self.own_row = np.zeros(len(counts), np.int64)  # row 0 stays 0: for ids that are too rare in the corpus to have a vector
        self.own_row[common] = 1 + np.arange(len(common))
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        total = total.reshape(SUPER, SUPER) / total.sum()
        self.p = {
            "c": normal(SUPER * SUPER, WIDTH, scale=0.3), "e": np.zeros((len(common) + 1, WIDTH), np.float32), "q": normal(WIDTH, KEY_WIDTH, scale=0.2), "k": normal(WIDTH, KEY_WIDTH, scale=0.2),
            "v": normal(WIDTH, WIDTH, scale=0.2), "g": np.zeros(CONTEXT + STRIDE, np.float32), "o1": normal(WIDTH, SUPER, scale=0.2), "b1": np.log(total.sum(axis=1) + 1e-9).astype(np.float32),
            "o2": normal(SUPER, WIDTH, SUPER, scale=0.2), "b2": np.log((total + 1e-9) / (total.sum(axis=1, keepdims=True) + 1e-9)).astype(np.float32),
        }
        self.restart()

    def restart(self) -> None:
        self.moments, self.steps = {n: (np.zeros_like(x), np.zeros_like(x)) for n, x in self.p.items()}, 0
        self.seen = np.zeros(len(self.p["e"]), np.int64)

    def step(self, ids: np.ndarray, there: np.ndarray, after: np.ndarray, to_score: np.ndarray, rate: float) -> None:
        p, share = self.p, np.float32(1 / np.count_nonzero(to_score))
        g: dict[str, np.ndarray] = {}
        at, dx = [], []
        for a in range(0, len(ids), BLOCK):
            s = slice(a, a + BLOCK)
            own, *by_id = self.slopes(ids[s], there[s], after[s], to_score[s], share)
            for name, grad in own.items():
                g[name] = g[name] + grad if a else grad
            at.append(by_id[0])
            dx.append(by_id[1])
        distinct, dx = summed_by(np.concatenate(at), np.concatenate(dx))
        touched = {"c": summed_by(self.classes[distinct], dx), "e": (self.own_row[distinct][has := self.own_row[distinct] > 0], dx[has])}
        self.steps += 1
        rate, fresh = np.float32(rate / (1 - 0.9**self.steps)), np.float32(1 / math.sqrt(1 - 0.99**self.steps))
        for name, x in p.items():
            which, grad = touched.get(name, (None, g.get(name)))
            m, v2 = ((t if which is None else np.take(t, which, axis=0, mode="clip")) for t in self.moments[name])
            m *= np.float32(0.9)
            m += np.float32(0.1) * grad
            v2 *= np.float32(0.99)
            grad = grad * grad
            grad *= np.float32(0.01)
            v2 += grad
            change = np.sqrt(v2)
            change *= fresh
            change += np.float32(1e-7)
            np.divide(m, change, out=change)
            change *= rate
            if which is None:
                x -= change
            else:
                self.moments[name][0][which], self.moments[name][1][which] = m, v2
                x[which] -= change

    def slopes(self, ids: np.ndarray, there: np.ndarray, after: np.ndarray, to_score: np.ndarray, share: np.float32) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Slopes of some windows' share of a step's loss: by parameter; and distinct ids and those by their inputs. What depends on an
        id alone is worked out once for each distinct one, forth and back."""
        p, root, n_windows, kv = self.p, np.float32(1 / math.sqrt(KEY_WIDTH)), len(ids), KEY_WIDTH + WIDTH
        used = np.flatnonzero(there)
        order, starts, n = ordered(np.take(ids, used))
        used = used[order]
        distinct, owner = np.take(ids, used[starts]), np.repeat(np.arange(len(n)), n)
        at = np.zeros(ids.shape, np.int64)
        np.put(at, used, owner)
        x = np.take(p["c"], self.classes[distinct], axis=0, mode="clip")
        x += np.take(p["e"], self.own_row[distinct], axis=0, mode="clip")
        to_all = np.hstack([p["k"], p["v"], p["q"] * root])
        by_id = x @ to_all
        past, own = np.take(by_id[:, :kv], at, axis=0, mode="clip"), np.take(np.hstack([by_id[:, kv:], x]), at[:, CONTEXT:], axis=0, mode="clip")
        q, k, v = own[:, :, :KEY_WIDTH], past[:, :, :KEY_WIDTH], past[:, :, KEY_WIDTH:]
        w = q @ k.transpose(0, 2, 1)
        w += p["g"][np.maximum(GAP, 0)] + AHEAD
        np.exp(np.minimum(w, 30, out=w), out=w)
        w *= there[:, None, :]
        w /= (w @ ONES + np.float32(1e-20))[:, :, None]
        h = w @ v
        h += own[:, :, KEY_WIDTH:]
        rows = np.flatnonzero(to_score)
        order, sup, sub, cuts = by_superclass(self.classes[np.take(after, rows)])
        rows = rows[order]
        hr = np.take(h.reshape(-1, WIDTH), rows, axis=0, mode="clip")
        z1, z2 = class_shares(hr, p, cuts)
        places = np.arange(len(rows))
        z1[sup, places] -= 1
        z2[sub, places] -= 1
        z1 *= share
        z2 *= share
        g = {"o1": (z1 @ hr).T, "b1": z1.sum(axis=1), "o2": np.zeros_like(p["o2"]), "b2": np.zeros_like(p["b2"])}
        back = z1.T @ p["o1"].T
        met = np.flatnonzero(np.diff(cuts))
        g["b2"][met] = np.add.reduceat(z2, cuts[met], axis=1).T
        for i in met:
            part = slice(cuts[i], cuts[i + 1])
            g["o2"][i] = (z2[:, part] @ hr[part]).T
            back[part] += z2[:, part].T @ p["o2"][i].T
        d_past, dh = np.empty_like(past), np.zeros((n_windows * STRIDE, WIDTH), np.float32)
        dh[rows] = back
        dh = dh.reshape(h.shape)
        np.matmul(w.transpose(0, 2, 1), dh, out=d_past[:, :, KEY_WIDTH:])
        ds = dh @ v.transpose(0, 2, 1)
        ds -= ((ds * w) @ ONES)[:, :, None]
        ds *= w
        g["g"] = np.bincount(np.maximum(GAP, 0).ravel(), ds.reshape(n_windows, -1).sum(axis=0), CONTEXT + STRIDE).astype(np.float32)
        dq = (ds @ k).reshape(-1, KEY_WIDTH)
        np.matmul(ds.transpose(0, 2, 1), q, out=d_past[:, :, :KEY_WIDTH])
        d_past = d_past.reshape(-1, kv)
        flat, own_x = np.take(x, at.ravel(), axis=0, mode="clip"), own[:, :, KEY_WIDTH:].reshape(-1, WIDTH)
        d_to_past = flat.T @ d_past
        g["k"], g["v"], g["q"] = d_to_past[:, :KEY_WIDTH], d_to_past[:, KEY_WIDTH:], own_x.T @ dq * root
        dx = d_past @ to_all[:, :kv].T
        dh += (dq @ to_all[:, kv:].T).reshape(dh.shape)
        dx.reshape(n_windows, -1, WIDTH)[:, CONTEXT:] += dh
        np.add.at(self.seen, self.own_row[distinct], n)
        return g, distinct, summed(dx, used, starts)

    def model(self) -> Model:
        p, root = self.p, np.float32(1 / math.sqrt(KEY_WIDTH))
        distinct, rows = np.unique(np.stack([self.classes, self.own_row], axis=1), axis=0, return_inverse=True)
        every = p["c"][distinct[:, 0]] + p["e"][distinct[:, 1]]
        tables = np.hstack([every @ p["q"] * root, every @ p["k"], every @ p["v"], every]).astype(np.float32)
        return Model(tables, rows.ravel().astype(np.int32), p["g"], {n: p[n] for n in ("o1", "b1", "o2", "b2")}, self.classes, self.within)


def beginning(counts: np.ndarray, near: np.ndarray, seed: int = 7) -> Learner:
    """Where training starts. counts and near: of every id over all training documents."""
    return Learner(classify(near, counts, np.random.default_rng(seed)), counts, seed)


def trained(own: Learner, texts: Iterator[tuple[np.ndarray, np.ndarray]], seed: int, many: int, rate: float) -> int:
    """Steps a learner once through every window of the texts, some texts on a line at a time; returns the windows."""
    own.restart()
    rng, n = np.random.default_rng(seed), 0
    for line, per_text in texts:
        start, first, last = windows(per_text)
        mixed = rng.permutation(len(start))
        for a in range(0, len(mixed), many):
            chosen = mixed[a : a + many]
            own.step(*window_ids(line, start[chosen], first[chosen], last[chosen]), rate * min(1, (own.steps + 1) / 50) * len(chosen) / many)
        n += len(start)
    return n


def added(pieces: DataFrame, parts: int) -> DataFrame:
    """Pieces of sparse rows (part, name, at, value) summed by name and place; parts: there are fewer than so many. FAN_IN parts
    that follow each other are summed at a time, so no sum holds more than these, however many there are."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")  # sums don't depend on the order of arrival
        at, n = np.concatenate([np.frombuffer(x, np.int32) for x in group["at"]]), [len(x) // 4 for x in group["at"]]
        value = np.concatenate([np.frombuffer(x, np.float32).reshape(k, -1) for x, k in zip(group["value"], n, strict=True)])
        order = np.argsort(at, kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        total = np.add.reduceat(value[order], starts, axis=0, dtype=np.float64).astype(np.float32)
        return pd.DataFrame({"part": [group["part"].iloc[0] // FAN_IN], "name": [group["name"].iloc[0]], "at": [at[starts].tobytes()], "value": [total.tobytes()]})

    while True:
        pieces = pieces.groupBy("name", F.floor(F.col("part") / FAN_IN).alias("some")).applyInPandas(add, PIECE)
        if parts <= FAN_IN:
            return pieces
        parts = -(-parts // FAN_IN)


def neighbour_counts(ids: DataFrame, counts: np.ndarray) -> np.ndarray:
    """What stands next to each id, over all sequences (a column `ids`)."""
    column = neighbour_columns(counts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, part = np.zeros((len(column), 256), np.int32), TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                neighbours(*read_back(whole.column(0).slice(at, 512), len(column)), column, near)
        for a in range(0, len(near), 1000):
            own = near[a : a + 1000].reshape(-1)
            there = np.flatnonzero(own)
            if len(there):
                yield piece(part, str(a), there + a * 256, own[there])

    near = np.zeros(len(counts) * 256, np.float32)
    for r in added(ids.select("ids").mapInArrow(count, PIECE), ids.rdd.getNumPartitions()).toLocalIterator():
        near[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["value"], np.float32)
    return near.reshape(-1, 256)


def piece(part: int, name: str, at: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([value.astype(np.float32).tobytes()], pa.binary())], names=["part", "name", "at", "value"])


def changes(own: Learner, begun: dict[str, np.ndarray], shard: int, n: int) -> Iterator[pa.RecordBatch]:
    """What a shard's n windows changed, times its weight, as pieces: vectors of ids weigh by how often the shard had the id, the rest
    by windows."""
    for name, x in own.p.items():
        change = (x - begun[name]).astype(np.float64)
        if name != "e":
            yield piece(shard, name, np.arange(1), np.concatenate([[n], n * change.ravel()]))
            continue
        there = np.flatnonzero(own.seen[1:]) + 1
        for block in np.unique(there // 1000):
            mine = there[there // 1000 == block]
            yield piece(shard, f"e{block}", mine, np.hstack([own.seen[mine, None], own.seen[mine, None] * change[mine]]))


def apply(p: dict[str, np.ndarray], name: str, at: np.ndarray, value: np.ndarray) -> None:
    """Adds mean changes, from sums of weights and weighted changes."""
    mean = (value[:, 1:] / value[:, :1]).astype(np.float32)
    if name[0] == "e":
        p["e"][at] += mean
    else:
        p[name] += mean.reshape(p[name].shape)


def rounds(n_ids: float, shard_ids: int) -> list[tuple[int, int]]:
    """First shard of each round and the one after its last; at least one shard a round."""
    n = max(len(ROUNDS), math.ceil(n_ids / shard_ids))
    cuts = [0]
    for i, share in enumerate(SHARES):
        cuts.append(min(max(cuts[-1] + 1, round(share * n)), n - len(ROUNDS) + 1 + i))
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def learnt_from_all(learner: Learner, ids: DataFrame, n_ids: float, shard_ids: int = SHARD_IDS) -> Learner:
    """The learner after every window of every training document (columns ids and h, by which documents are dealt out)."""
    cuts = rounds(n_ids, shard_ids)
    n_shards, size = cuts[-1][1], len(learner.classes)
    # hashes choose the shard by their remainder and the place in it by the whole
    dealt = ids.select("ids", "h", F.pmod("h", F.lit(n_shards)).alias("shard"))

    def learn_from(seed: int, many: int, rate: float, begun: Learner):
        def texts(lists: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for part in lists:
                yield read_back(part, size)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, now = [], None
            for whole in chain(batches, [None]):
                shards = np.zeros(0) if whole is None else whole.column(2).to_numpy()
                cut = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)] if len(shards) else []
                for a, b in zip(cut, cut[1:], strict=False):
                    if shards[a] != now and held:
                        yield from learnt(now, held)
                        held = []
                    now = int(shards[a])
                    held.append(whole.column(0).slice(a, b - a))
            if held:
                yield from learnt(now, held)

        def learnt(shard: int, held: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            own, column = pickle.loads(pickle.dumps(begun)), pa.chunked_array(held)
            pieces = [pa.concat_arrays(column.slice(at, 512).chunks) for at in range(0, len(column), 512)]
            if n := trained(own, texts(pieces), seed + shard, many, rate):
                yield from changes(own, begun.p, shard, n)

        return learn

    for i, ((first, after), (many, rate)) in enumerate(zip(cuts, ROUNDS, strict=True)):
        mine = dealt.where((F.col("shard") >= first) & (F.col("shard") < after))
        sorted_shards = mine.repartition(max(1, min(after - first, 4096)), "shard").sortWithinPartitions("shard", "h", "ids")
        path = scratch_dir(ids.sparkSession)
        sorted_shards.mapInArrow(learn_from(1000 * i, many, rate, learner), PIECE).write.parquet(path)
        pieces = ids.sparkSession.read.schema(PIECE).parquet(path)
        for r in added(pieces.withColumn("part", F.col("part") - first), after - first).toLocalIterator():
            at = np.frombuffer(r["at"], np.int32)
            apply(learner.p, r["name"], at, np.frombuffer(r["value"], np.float32).reshape(len(at), -1))
        dropped(ids.sparkSession, path)
    return learner


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word and n, over all words of the texts: counted by batch, then by shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = split_words(b.column(0))[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], names=["word", "n"])

    return docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def id_counts(ids: DataFrame, size: int) -> np.ndarray:
    """How often each id stands in the sequences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(size, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                totals += np.bincount(read_back(whole.column(0).slice(at, 512), size)[0], minlength=size)
        there = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(totals[there])], names=["id", "n"])

    totals = np.zeros(size)
    for r in ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        totals[r["id"]] = r["n"]
    totals[BEGIN] = 0  # nothing predicts it
    return totals


def whole_counts(spelled_counts: Spelled, head_counts: np.ndarray, n_docs: int) -> np.ndarray:
    """How often each id stands in the sequences, as id_counts gives it, from counts of words: whole ones, and those that begin with a piece."""
    counts = np.concatenate([spelled_counts.words, head_counts]).astype(float)
    counts[END] += n_docs
    counts[BEGIN] = 0
    return counts


def spelled(words: DataFrame, whole: pa.Array, model: bytes) -> Spelled:
    """By all words (columns word and n) that aren't whole ids. The most frequent pieces have a row each, the others share one."""
    size = Subwords(model).size
    ends, begins, kinds = size, size + 1, size + 2  # what stands in the column `after` apart from pieces

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(model)
        for b in batches:
            b = b.filter(pc.invert(pc.is_in(b.column(0), value_set=whole)))
            if b.num_rows:
                line, n = subwords.pieces(b.column(0).to_numpy(zero_copy_only=False).tolist())
                first, times = line[np.cumsum(n) - n], b.column(1).to_numpy()
                piece = np.concatenate([line, first, first]).astype(np.int64)
                after = np.concatenate([followers(line, n, ends), np.full(len(n), begins), np.full(len(n), kinds)])
                pair, at = np.unique(piece * (size + 3) + after, return_inverse=True)
                n = np.bincount(at, np.concatenate([np.repeat(times, n), times, np.ones(len(n))])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair // (size + 3)), pa.array(pair % (size + 3)), pa.array(n)], names=["piece", "after", "n"])

    pairs = written(words.mapInArrow(count, "piece long, after long, n long").groupBy("piece", "after").agg(F.sum("n").alias("n")))
    by_piece = np.zeros((3, size))
    what = F.when(F.col("after") <= ends, 0).otherwise(F.col("after") - ends)
    for r in pairs.groupBy("piece", what.alias("what")).agg(F.sum("n").alias("n")).collect():
        by_piece[r["what"], r["piece"]] = r["n"]
    row, table = neighbour_columns(by_piece[0]), np.zeros((128, size + 1))
    alone = F.when(F.col("piece").isin([int(i) for i in np.flatnonzero(row < 127)]), F.col("piece"))
    for r in pairs.where(F.col("after") <= ends).groupBy(alone.alias("piece"), "after").agg(F.sum("n").alias("n")).toLocalIterator():
        table[127 if r["piece"] is None else row[r["piece"]], r["after"]] = r["n"]
    share = table.sum(axis=0) + ADD
    table += BACK * share / share.sum()
    table /= table.sum(axis=1, keepdims=True)
    return Spelled(row, np.log(table, out=table).astype(np.float32), by_piece[1], np.maximum(by_piece[2], 1))


def lm_scores(docs: DataFrame, model_path: str, held_out: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; rows whose column `held_out`
    is true are not learnt from."""
    proto = Path(model_path).read_bytes()
    training = docs.where(~F.col(held_out))
    words = written(word_counts(training, text))
    n_docs = training.count()
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    train_tokens, v = n_words + n_docs, distinct + (n_docs > 0)
    head = {r["word"]: r["n"] for r in words.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(HEAD).collect()}
    log_all = math.log10(train_tokens + ADD * (v + 1))
    log_end = math.log10(n_docs + ADD)
    head_words, head_counts = pa.array(head, pa.large_string()), np.array([*head.values(), 0])
    head_logs = np.log10(head_counts + ADD)
    del head
    pieces = Subwords(proto).size
    n_whole = min(len(head_words), max(0, 2**16 - pieces))
    size = pieces + n_whole
    spelled_counts = spelled(words, head_words.slice(0, n_whole).cast(pa.string()), proto)
    head_spelled = Spelling(proto, spelled_counts).of(head_words.slice(n_whole).to_pylist())
    kind = docs.schema[key].dataType.simpleString()
    names = ["row", key, "held_out", "n_tokens", "n_head", "head_sum", "spelled", "h", "tail", "ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, row = Spelling(proto, spelled_counts), TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                flat, n = split_words(b.column(1))
                place = pc.fill_null(pc.index_in(flat, value_set=head_words), -1).to_numpy(zero_copy_only=False)
                owner, there = np.repeat(np.arange(len(n)), n), place >= 0
                known = np.bincount(owner[there], minlength=len(n))
                sums = np.bincount(owner[there], head_logs[place[there]], len(n)).astype(float)  # of nothing it gives whole numbers
                parts = np.flatnonzero(~there | (place >= n_whole))
                beyond = place[parts] < 0
                coded = flat.take(pa.array(parts[beyond])).dictionary_encode()
                in_head, met = place[parts] - n_whole, spelling.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
                first, prior, among = (np.empty(len(parts), x.dtype) for x in met)
                for x, of_head, of_met in zip((first, prior, among), head_spelled, met, strict=True):
                    x[beyond], x[~beyond] = of_met[coded.indices.to_numpy()], of_head[in_head[~beyond]]
                line = place + pieces
                line[parts] = first
                value = -np.log10(among)  # of words beyond the head, the join to their counts adds the rest
                value[~beyond] += np.log10(head_counts[place[parts[~beyond]]] + 10.0 ** prior[~beyond])
                spelt = np.bincount(owner[parts], value, len(n)).astype(float)
                ends = np.concatenate([[0], np.cumsum(n - known)])
                words_beyond = pa.StructArray.from_arrays([flat.take(pa.array(parts[beyond])).cast(pa.string()), pa.array(prior[beyond])], names=["word", "prior"])
                tail = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words_beyond)
                ids = stored(*sequences(line, n), size)
                cols = [pa.array(row + np.arange(len(n))), b.column(0), b.column(2), pa.array(n + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(sums), pa.array(spelt), b.column(3), tail, ids]
                row += len(n)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    counted = f"row long, `{key}` {kind}, held_out boolean, n_tokens long, n_head long, head_sum double, spelled double"
    texts = docs.select(key, text, F.col(held_out), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).alias("h"))
    coded = written(texts.mapInArrow(read, f"{counted}, h long, tail array<struct<word: string, prior: float>>, ids binary"))
    known = coded.where("not held_out")
    counts = whole_counts(spelled_counts, head_counts[:n_whole], n_docs)
    learner = beginning(counts, neighbour_counts(known, counts))
    model = learnt_from_all(learner, known, counts.sum()).model()
    del learner

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                scores = model.score(*read_back(b.column(b.num_columns - 1), size)) + b.column(6).to_numpy()
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores)], names=[*names[:7], "score"])

    scored = coded.select(*names[:7], "ids").mapInArrow(score, f"{counted}, score double")
    rest = coded.select("row", F.inline("tail")).join(words, "word", "left")
    rest = rest.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("tail_sum"), F.count("n").alias("n_tail"), F.sum(F.when(F.col("n").isNull(), F.col("prior")).otherwise(F.log10(F.col("n") + F.pow(F.lit(10.0), F.col("prior"))))).alias("tail_spelled"))
    whole = scored.join(rest, "row", "left")
    base = F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) + F.lit(log_end) - F.col("n_tokens") * F.lit(log_all)
    n_known = F.col("n_head") + F.coalesce("n_tail", F.lit(0)) + F.lit(int(n_docs > 0))
    return whole.select(key, "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("tail_spelled", F.lit(0.0))).alias("score"))


def scored_documents(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """lm_scores with the fold CRC-32 mod 10 = 0 held out."""
    held_out = free_name(docs, "_held_out")
    return lm_scores(docs.withColumn(held_out, fold(key, 10) == 0), model_path, held_out, key, text)
