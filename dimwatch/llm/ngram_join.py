"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Words are runs of letters and digits of the lower-cased text; a document's set holds its runs of five words (all its
words, if fewer). Documents with the same set are one text from then on. A text's signature has TREES labels of DEPTH
minima, a byte each: the paths of the text in as many prefix tries. Texts whose labels share a prefix meet in a node of
the trie. Prefixes are first matched at the whole length of the labels. From the similarities of what meets there, the
links that this depth misses are estimated (each link found stands for 1 / its chance to be found; bins of similarity
without a link count as three, the upper bound of a count that was seen as none), and the prefixes are shortened until
the estimate is within the target recall; at the shortest depth it holds for any similarity.

Within a node, members come sorted and are cut into blocks, and pairs of blocks are compared by set lengths and whole
signatures, far below the threshold by five standard deviations. Only pairs that pass tie their texts, by a spanning
forest, so chance meetings tie nothing and no pairs are listed. Tied texts are cut into blocks by number and length,
every pair of blocks is a task's group, and within it every pair of texts is verified on whole sets; only counts and a
spanning forest leave the group. Hot groups thus become many small tasks.

Null texts and texts without a word have no set: no links, a class of their own. Very short and very long texts are
taken whole. Repeated rows and equal texts are links of each other and share a class. Null ids are kept; a class whose
ids are all null has a null class id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, written
from .components import components

#: Words of a shingle; least Jaccard similarity of a link, as a ratio of integers.
WORDS, SIMILAR = 5, (4, 5)
TREES, DEPTH, RECALL = 32, 8, 0.9999
#: Equal minima that a pair must have to be verified: those expected at the threshold less five standard deviations.
LEAST_EQUAL = int(TREES * DEPTH * 0.8 - 5 * (TREES * DEPTH * 0.8 * 0.2) ** 0.5)
#: Bins of similarity between the threshold and 1, by which missed links are estimated.
BINS = 20
#: Members of a node's block; texts and shingles of a block of tied texts, about.
NODE_BLOCK, BLOCK, BLOCK_SHINGLES = 2048, 256, 250_000
#: Bytes of ids that may go to every task; more are joined by shuffle.
MOST_BROADCAST = 32_000_000
MOST_WORDS_KEPT = 150_000
_WORD = re.compile(r"\w+")


def chance(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """That a pair of this similarity shares a node of some trie at this depth."""
    return 1 - (1 - similarity**depth) ** TREES


def shortened(found: np.ndarray, depth: int) -> int:
    """The longest prefix, up to depth, that misses few enough links by what was found at depth in each bin of
    similarity; at the least that at which any pair at the threshold is found with the target recall."""
    low = SIMILAR[0] / SIMILAR[1]
    least = next((d for d in range(depth, 0, -1) if chance(low, d) >= RECALL), 1)
    middles = low + (np.arange(BINS) + 0.5) * (1 - low) / BINS
    expected = np.maximum(found / chance(middles, depth), 3)
    return next((d for d in range(depth, least, -1) if (expected * (1 - chance(middles, d))).sum() <= (1 - RECALL) * found.sum()), least)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= MOST_WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The sorted 64-bit shingle hashes of a text."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mixed(h + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def set_id(own: np.ndarray) -> bytes:
    """96 bits that stand for a set."""
    return hashlib.blake2b(own.tobytes(), digest_size=12).digest()


class Signer:
    """Signatures of sets: TREES labels of DEPTH minima."""

    def __init__(self) -> None:
        seeds = _mixed(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64))
        self.a = (seeds[::2] | np.uint64(1)).astype(np.uint32)
        self.b = seeds[1::2].astype(np.uint32)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of bytes for each of the non-empty sets."""
        lengths = np.array([len(x) for x in sets])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.concatenate(sets).astype(np.uint32)
        out = np.empty((len(sets), TREES * DEPTH), np.uint8)
        scratch = np.empty_like(flat)
        for k, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            np.multiply(flat, a, out=scratch)
            np.add(scratch, b, out=scratch)
            out[:, k] = _mixed(np.minimum.reduceat(scratch, starts).astype(np.uint64))
        return out


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, tid (the set's id, null without one), size and sig of every document."""
    kind = docs.schema[key].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, signer = WordHashes(), Signer()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingles(t.as_py(), hashes) for t in part.column(1)]
                full = [i for i, x in enumerate(sets) if len(x)]
                rows = dict(zip(full, map(bytes, signer.signatures([sets[i] for i in full])), strict=True)) if full else {}
                tids = pa.array([set_id(x) if len(x) else None for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), tids, pa.array([*map(len, sets)], pa.int32()), pa.array([rows.get(i) for i in range(len(sets))], pa.binary())], names=[key, "tid", "size", "sig"])

    return docs.select(key, text).mapInArrow(sign, f"`{key}` {kind}, tid binary, size int, sig binary")


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def compared(depth: int, tree: int, sig: np.ndarray, size: np.ndarray, first: int, found: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs of a node that pass. The first `first` rows are one block and the others
    another; with none in the first, all rows are of one. Adds to `found`, by bin, the pairs at the threshold that meet
    in no earlier trie."""
    parent, edges = list(range(len(sig))), []
    for i in range(first or len(sig) - 1):
        later = max(first, i + 1)
        same = sig[later:] == sig[i]
        equal = np.count_nonzero(same, axis=1)
        small, large = np.minimum(size[later:], size[i]), np.maximum(size[later:], size[i])
        passed = np.flatnonzero((equal >= LEAST_EQUAL) & (SIMILAR[1] * small >= SIMILAR[0] * large))
        if not len(passed):
            continue
        estimate = (equal[passed] - sig.shape[1] / 256) / (sig.shape[1] * (1 - 1 / 256))
        earliest = same[passed].reshape(len(passed), TREES, DEPTH)[:, :, :depth].all(axis=2).argmax(axis=1) == tree
        low = SIMILAR[0] / SIMILAR[1]
        np.add.at(found, np.minimum((estimate[earliest & (estimate >= low)] - low) / (1 - low) * BINS, BINS - 1).astype(int), 1)
        for j in (passed + later).tolist():
            a, b = _root(parent, i), _root(parent, j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((i, j))
    return edges


def _ties(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From sorted rows of nodes' pairs of blocks: u and v of each tie, and rows of a bin and the links found in it."""

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rest = np.zeros(BINS, np.int64), None

        def tied(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
            sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(-1, TREES * DEPTH)
            size, tree, i, block, tids = (rows[c].to_numpy() for c in ("size", "tree", "i", "block", "tid"))
            same_block = rows["j"].to_numpy() == i
            edges = []
            for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
                first = 0 if same_block[a] else int(np.count_nonzero(block[a:b] == i[a]))
                if b - a > max(1, first) and (first or same_block[a]):
                    edges += [(tids[a + x], tids[a + y]) for x, y in compared(depth, int(tree[a]), sig[a:b], size[a:b], first, found)]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in edges], pa.binary()) for k in (0, 1)] + [pa.nulls(len(edges), t) for t in (pa.int32(), pa.int64())], names=["u", "v", "bin", "n"])

        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = pa.concat_tables([rest, rows]) if rest else rows
            keys = [rows[c].to_numpy() for c in ("node", "i", "j")]
            ends = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in keys])) + 1
            whole = int(ends[-1]) if len(ends) else 0
            rest = rows.slice(whole)
            if whole:
                yield tied(rows.slice(0, whole).combine_chunks(), ends)
        if rest:
            yield tied(rest.combine_chunks(), np.array([len(rest)]))
        if len(bins := np.flatnonzero(found)):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(bins), pa.binary()), pa.nulls(len(bins), pa.binary()), pa.array(bins, pa.int32()), pa.array(found[bins])], names=["u", "v", "bin", "n"])

    return tie


def met(texts: DataFrame, depth: int) -> DataFrame:
    """Ties, and links found by bin, of texts (tid, size, sig) that share prefixes of this depth."""
    placed = texts.select("tid", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    placed = placed.select("tid", "tree", F.xxhash64("tree", F.expr(f"substring(sig, tree * {DEPTH} + 1, {depth})")).alias("node"))
    shared = placed.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    members = placed.join(shared, "node").withColumn("blocks", F.ceil(F.col("n") / NODE_BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("node", "tree", "tid", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = members.join(texts.select("tid", "size", "sig"), "tid").repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "block", "sig")
    return written(dealt.mapInArrow(_ties(depth), "u binary, v binary, bin int, n long"))


def forest_ties(texts: DataFrame) -> DataFrame:
    """u and v of texts that may be links, from prefixes as short as the target recall needs."""
    depth = DEPTH
    while True:
        ties = met(texts, depth)
        found = np.zeros(BINS)
        for r in ties.where("u is null").groupBy("bin").agg(F.sum("n").alias("n")).collect():
            found[r["bin"]] = r["n"]
        if (wanted := shortened(found, depth)) == depth:
            return ties.where("u is not null").select("u", "v")
        depth = wanted


def text_sets(docs: DataFrame, text: str) -> DataFrame:
    """tid and shingles of documents that have a set."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                sets = [x for t in b.column(0).slice(at, 256) if len(x := shingles(t.as_py(), hashes))]
                yield pa.RecordBatch.from_arrays([pa.array(map(set_id, sets), pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["tid", "shingles"])

    return docs.select(text).mapInArrow(cut, "tid binary, shingles array<long>")


def linked(sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, the later sets that reach the similarity with it, by exact intersection sizes."""
    lengths = np.array([len(x) for x in sets])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mask = np.zeros(len(ids) + 1, np.int32)
    p, q = similar
    for i in range(len(sets) - 1):
        own = ids[starts[i] : ends[i]]
        mask[own] = 1
        common = np.add.reduceat(mask[ids[ends[i] :]], starts[i + 1 :] - ends[i])
        mask[own] = 0
        hit = np.flatnonzero(q * common >= p * (lengths[i] + lengths[i + 1 :] - common))
        if len(hit):
            yield i, hit + i + 1


def verified(group: pd.DataFrame) -> pd.DataFrame:
    """Links between the texts of a pair of blocks, or within one: for each text its linked documents, and its root in
    a spanning forest of the links."""
    group = group.drop_duplicates("tid").sort_values("tid").reset_index(drop=True)
    sets = [np.asarray(x) for x in group["shingles"]]
    copies, block = group["copies"].to_numpy(), group["block"].to_numpy()
    one = (group["i"] == group["j"]).iloc[0]
    links, parent = np.zeros(len(sets), np.int64), list(range(len(sets)))
    for i, others in linked(sets):
        others = others if one else others[block[others] != block[i]]
        links[i] += copies[others].sum()
        links[others] += copies[i]
        for j in others.tolist():
            a, b = _root(parent, i), _root(parent, j)
            parent[max(a, b)] = min(a, b)
    tid = group["tid"]
    keep = links > 0
    return pd.DataFrame({"tid": tid[keep], "links": links[keep], "root": [tid[_root(parent, i)] for i in np.flatnonzero(keep)]})


def small(ids: DataFrame) -> bool:
    """Whether a table of ids is small enough to go to every task."""
    size = ids.select(F.sum(F.octet_length(ids[ids.columns[0]].cast("string")) + 16)).first()[0]
    return (size or 0) <= MOST_BROADCAST


def _joined(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """key and tid of every row; and tid, root (the least tid of its class), class_id and n_links of every set."""
    signed = written(signatures(docs, key, text))
    n_rows = signed.count()
    texts = written(signed.where(F.col("tid").isNotNull()).groupBy("tid").agg(F.min(key).alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig")), n_rows)
    ties = forest_ties(texts)
    tied = components(ties, "u", "v").withColumnRenamed("node", "tid").join(texts.select("tid", "rep", "copies", "size"), "tid")
    sizes = tied.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = written(tied.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int")), ties.count())
    rep = free_name(docs, "_rep")
    reps = members.select(F.col("rep").alias(rep)).distinct()
    reps = F.broadcast(reps) if small(reps) else reps
    sets = text_sets(docs.join(reps, F.col(key).eqNullSafe(F.col(rep)), "left_semi"), text)
    dealt = sets.join(members.select("tid", "root", "copies", "blocks", "block"), "tid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "tid", "copies", "shingles")
    found = written(dealt.groupBy("root", "i", "j").applyInPandas(verified, "tid binary, links long, root binary"))
    links = found.groupBy("tid").agg(F.sum("links").alias("links"))
    classes = components(found, "tid", "root").withColumnRenamed("node", "tid")
    least = classes.join(texts.select("tid", "rep"), "tid").groupBy("root").agg(F.min("rep").alias("class_id"))
    per_text = texts.select("tid", "rep", "copies").join(links, "tid", "left").join(classes.join(least, "root").select("tid", "root", "class_id"), "tid", "left")
    per_text = per_text.select("tid", F.coalesce("root", "tid").alias("root"), F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select(key, "tid"), written(per_text, n_rows)


def _of_rows(rows: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """Rows without a set meet in no join."""
    of_sets = rows.where(F.col("tid").isNotNull()).join(sets, "tid").select(key, "class_id", F.col("n_links").cast("long").alias("n_links"))
    return of_sets.unionByName(rows.where(F.col("tid").isNull()).select(key, F.col(key).alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id (the least id of its class) and n_links (documents of at least the similarity) of every row."""
    return _of_rows(*_joined(docs, key, text), key)


def _set_ids(texts: pd.Series) -> pd.Series:
    hashes = WordHashes()
    return pd.Series([set_id(own) if len(own := shingles(t, hashes)) else None for t in texts], dtype=object)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents whose class has a smaller id, and one of rows that repeat id and text. Rows with a
    null id stay where they have no set; of a class whose ids are all null, one row stays."""
    rows, sets = _joined(docs, key, text)
    own_id, own_tid = free_name(docs, "_id"), free_name(docs, "_tid")
    by_id = F.col(key) == F.col(own_id)
    n_rows = rows.count()
    rows = _of_rows(rows.where(F.col(key).isNotNull()), sets, key)
    per_id = written(rows.groupBy(F.col(key).alias(own_id)).agg(F.max(F.col("class_id") == F.col(key)).alias("stays"), F.count("*").alias("n")), n_rows)
    lost, repeated = per_id.where("not stays").select(own_id), per_id.where("stays and n > 1").select(own_id)
    kept = docs.where(F.col(key).isNotNull()).join(F.broadcast(lost) if small(lost) else lost, by_id, "left_anti")
    if not repeated.isEmpty():
        repeated = F.broadcast(repeated) if small(repeated) else repeated
        again = kept.join(repeated, by_id, "left_semi").dropDuplicates([key, text])
        kept = kept.join(repeated, by_id, "left_anti").unionByName(again)
    nulls = docs.where(F.col(key).isNull())
    if nulls.isEmpty():
        return kept
    least = sets.where(F.col("class_id").isNull() & (F.col("tid") == F.col("root"))).select(F.col("tid").alias(free_name(docs, "_least")))
    of_text = F.pandas_udf(_set_ids, "binary")(F.col(text))
    own = nulls.withColumn(own_tid, of_text).join(least, F.col(own_tid) == F.col(least.columns[0]), "left_semi").dropDuplicates([own_tid])
    return kept.unionByName(nulls.where(of_text.isNull())).unionByName(own.select(docs.columns))
