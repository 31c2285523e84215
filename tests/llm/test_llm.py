"""The operators of the subpackage against brute force and SQL, and on rows that are empty, null, repeated or long."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dimwatch.llm import decontam, lm_scoring, mixing, ngram_join, pii, registry, secrets, toxicity
from tests.compare import difference

ODD = "doc_id long, text string, lang string, source string, n_chars long, size string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash with results."""
    long = "the quick brown fox jumps over the lazy dog again " * 3000
    texts = [None, "", " \t\n", "a", long, long, "mail jo@x.org or +49 30 1234 5678", "é中\U0001f600", "1.2.3.4 4111 1111 1111 1111"]
    rows = [(i, t, "en", "web", 0, "s", "t") for i, t in enumerate(texts)] + [(3, "a", None, None, None, None, None), (None, "a b c d e f", None, None, None, None, None)]
    return spark.createDataFrame(rows, ODD)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_mixing_matches_sql(spark, sf_dir, duck):
    assert not difference(registry.op6_mixing(spark, sf_dir).toPandas(), duck.execute(mixing.SQL).df())


def test_mixing_meets_its_targets(spark, sf_dir):
    sums = mixing.mix_documents(documents(spark, sf_dir)).groupBy("source_size", "target").agg(F.sum("taken").alias("n"))
    assert all(abs(r["n"] - r["target"]) <= 1 for r in sums.collect())


def test_tokens_match_the_library(spark, sf_dir):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer_path())
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark, sf_dir).collect()}
    found = {r["doc_id"]: r["n_tokens"] for r in registry.op4_token_counts(spark, sf_dir).collect()}
    assert found == {k: len(model.encode(t)) for k, t in texts.items()}


def _shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_join_matches_brute_force(spark, sf_dir):
    sets = {r["doc_id"]: _shingles(r["text"]) for r in documents(spark, sf_dir).collect()}
    links = dict.fromkeys(sets, 0)
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
    assert {r["doc_id"]: r["n_links"] for r in registry.op3_ngram_jaccard_join(spark, sf_dir).collect()} == links


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and _luhn(digits(s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m[0]))


def test_base_spans_match_the_patterns(spark, sf_dir, odd):
    for docs in (documents(spark, sf_dir), odd):
        expected = sorted((r["doc_id"] or -1, hashlib.sha256(_base(r["text"]).encode()).hexdigest()) for r in docs.collect())
        assert sorted((r["doc_id"] or -1, r["base_sha256"]) for r in pii.found_documents(docs).collect()) == expected


def test_secrets_are_found_and_hashes_left(spark):
    docs = spark.createDataFrame([(1, "password=9f8a7Kq2LmZx81TrWq04BvC6dE and more"), (2, "see commit 9fceb02d0ae598e95dc970b74767f19372d61af8"), (3, None), (4, "")], "doc_id long, text string")
    assert {r["doc_id"] for r in secrets.secrets(docs).collect()} == {1}


def test_media_round_trip(spark, sf_dir):
    payload = {r["doc_id"]: (r["text"] or "").encode() for r in documents(spark, sf_dir).collect()}
    padded = {k: b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b)) for k, b in payload.items()}
    found = {r["doc_id"]: r["payload_sha256"] for r in registry.op9_media_columns(spark, sf_dir).collect()}
    assert found == {k: hashlib.sha256(b).hexdigest() for k, b in padded.items()}


def test_planted_items_are_found(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    planted = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("some words before it "), "text", F.lit(" and some after it")).alias("text"))
    held = {(r["doc_id"], r["item_id"]) for r in decontam.contaminations(planted, items).collect()}
    assert all((r["item_id"], r["item_id"]) in held for r in items.collect())


def test_classifiers_on_held_out_rows(spark, sf_dir):
    lang = registry.op2_language_id(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    assert lang.where("lang = lang_pred").count() >= 0.9 * lang.count()
    toxic = registry.op7_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out and toxic is not null")
    assert toxic.where("predicted = toxic").count() >= 0.9 * toxic.count()


@pytest.mark.parametrize("name", ["op2_language_id", "op3_ngram_jaccard_join", "op4_token_counts", "op6_mixing", "op7_toxicity", "op9_media_columns", "op1_lm_scoring"])
def test_odd_rows(spark, sf_dir, odd, tmp_path, name):
    """Every row gets a result, with or without rows in the table."""
    for docs, where in ((odd, "odd"), (odd.limit(0), "empty")):
        docs.write.parquet(f"{tmp_path}/{where}/documents.parquet")
        spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/{where}/labels.parquet")
        assert registry.QUERIES[name](spark, f"{tmp_path}/{where}").count() == docs.count()


def test_ngram_join_keeps_one_of_each(spark, odd):
    kept = [r["doc_id"] for r in ngram_join.one_of_each(odd).collect()]
    assert kept.count(4) == 1 and 5 not in kept and kept.count(3) == 1 and None in kept


def test_scores_learn_from_every_training_document(spark, sf_dir):
    """Word order in any one training document matters to the scores of others, whatever the partitions."""
    rows = documents(spark, sf_dir).select("doc_id", "text").where("length(text) > 400").orderBy("doc_id").limit(20).withColumn("held", F.col("doc_id") % 5 == 0).cache()
    other = [r["doc_id"] for r in rows.orderBy("doc_id").collect() if not r["held"]][7]
    turned = rows.withColumn("text", F.when(F.col("doc_id") == other, F.array_join(F.reverse(F.split("text", " ")), " ")).otherwise(F.col("text")))
    scores = lambda docs: {r["doc_id"]: (r["base_score"], r["score"]) for r in lm_scoring.lm_scores(docs, registry.tokenizer_path(), "held").where("held_out").collect()}
    a, b = scores(rows.repartition(3)), scores(turned.repartition(3))
    assert a and all(a[k][0] == pytest.approx(b[k][0]) and abs(a[k][1] - b[k][1]) > 1e-6 for k in a)
    assert scores(rows.repartition(11)) == {k: (pytest.approx(x), pytest.approx(y, rel=1e-6)) for k, (x, y) in a.items()}


@pytest.mark.parametrize("parts", [1, 5])
def test_training_equals_a_loop_over_shards(spark, monkeypatch, parts):
    import copy

    import numpy as np

    rng = np.random.default_rng(2)
    counts = np.r_[0, 0, 0, rng.integers(1, 50, 297)].astype(float)
    texts = [(int(rng.integers(-(2**62), 2**62)), np.r_[lm_scoring.BEGIN, rng.integers(3, 300, rng.integers(0, 120)), lm_scoring.END]) for _ in range(60)]
    ids = spark.createDataFrame([(h, t.astype(np.uint16).tobytes()) for h, t in texts], "h long, ids binary").repartition(parts)
    monkeypatch.setattr(lm_scoring, "ROUNDS", ((4, 0.4), (4, 0.2), (6, 0.1)))  # few windows make many steps
    begin = lm_scoring.Learner(np.arange(300) % 256, counts, 1)
    n_ids = sum(len(t) for _, t in texts)
    found = lm_scoring.learnt_from_all(copy.deepcopy(begin), ids, n_ids, shard_ids=n_ids / 20)
    expected, cuts = copy.deepcopy(begin), lm_scoring.rounds(n_ids, n_ids / 20)
    assert cuts == [(0, 1), (1, 5), (5, 20)]
    for i, ((first, after), (many, rate)) in enumerate(zip(cuts, lm_scoring.ROUNDS, strict=True)):
        sums: dict = {}
        for shard in range(first, after):
            mine = sorted(((h, t) for h, t in texts if h % cuts[-1][1] == shard), key=lambda x: x[0])
            if not mine:
                continue
            own = copy.deepcopy(expected)
            n = lm_scoring.trained(own, iter([(np.concatenate([t for _, t in mine]), np.array([len(t) for _, t in mine]))]), 1000 * i + shard, many, rate)
            for name, x in own.p.items():
                weight = own.seen[:, None].astype(float) if name == "e" else np.full([1] * x.ndim, float(n))
                total = sums.setdefault(name, [np.zeros_like(weight), np.zeros(x.shape)])
                total[0] = total[0] + weight
                total[1] = total[1] + weight * (x.astype(float) - expected.p[name])
        for name, (weight, change) in sums.items():
            expected.p[name] += np.where(weight > 0, change / np.maximum(weight, 1e-9), 0).astype(np.float32)
    for name, x in expected.p.items():
        assert np.allclose(x, found.p[name], atol=1e-5), name
        assert np.abs(x - begin.p[name]).max() > 1e-3


def test_neighbours_are_counted_over_all_documents(spark, sf_dir):
    from pathlib import Path

    import numpy as np

    docs, proto = documents(spark, sf_dir), Path(registry.tokenizer_path()).read_bytes()
    subwords = lm_scoring.Subwords(proto)
    texts = [[lm_scoring.BEGIN, *(i for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) for i in subwords.model.encode(w)), lm_scoring.END] for r in docs.collect()]
    counts = np.bincount([i for t in texts for i in t[1:]], minlength=subwords.size).astype(float)
    column, expected = lm_scoring.neighbour_columns(counts), np.zeros((subwords.size, 256))
    for t in texts:
        for i, j in zip(t, t[1:]):
            expected[j, column[i]] += 1
            expected[i, 128 + column[j]] += 1
    ids = spark.createDataFrame([(lm_scoring.np.array(t, lm_scoring.id_type(subwords.size)).tobytes(),) for t in texts], "ids binary")
    assert (lm_scoring.neighbour_counts(ids.repartition(5), counts) == expected).all()
    found = lm_scoring.id_counts(ids.repartition(3), subwords.size)
    assert (found == counts).all()


def test_named_secrets_without_digits_short_or_broken(spark):
    texts = ["login with password=correct-horse-battery today", "set pwd=S3cr3t9 and go", 'the token: "aB3x!kQ9z#" was', "password: required for all", "the secret: none was", "key: https://example.org/reset here", "a key = 9f8a7Kq2LmZx81TrWq04BvC6dE. Then"]
    found = {(r["doc_id"], r["secret_sha256"]) for r in secrets.secrets(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).collect()}
    assert found == {(i, hashlib.sha256(s.encode()).hexdigest()) for i, s in ((0, "correct-horse-battery"), (1, "S3cr3t9"), (2, "aB3x!kQ9z#"), (6, "9f8a7Kq2LmZx81TrWq04BvC6dE"))}


def test_ngram_join_keeps_one_of_each_without_ids(spark):
    long = " ".join(f"word{i}" for i in range(60))
    near, other = long + " end", " ".join(f"other{i}" for i in range(60))
    rows = [(None, long), (None, long), (None, near), (7, other), (None, other), (None, other + " end"), (None, None), (None, ""), (None, "alone here")]
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(t in (long, near) for _, t in kept) == 1 and [k for k, t in kept if t and t.startswith("other")] == [7]
    assert len(kept) == 5 and {t for _, t in kept} >= {None, "", "alone here"}


def _one_of_each(rows):
    """Ids kept of (id, text): the least of each class of the links' closure; rows without a word stay."""
    sets, least = {k: _shingles(t) for k, t in rows}, {k: k for k, _ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and least[a] != least[b]:
                low, high = sorted((least[a], least[b]))
                least = {k: low if v == high else v for k, v in least.items()}
    return {k for k, v in least.items() if k == v}


def _held(items, text):
    """decontam's rule in plain Python, from the items' texts: every passage against every item by full sums of BM25
    weights, no bounds and no postings. Items that the text holds, with their best scores."""
    words = lambda t: re.findall(r"\w+", t.lower())
    items = [(k, t, words(t)) for k, t in items if len(words(t)) > 1]
    df = Counter(p for _, _, w in items for p in set(zip(w, w[1:])))
    mean = sum(len(w) - 1 for *_, w in items) / len(items)
    own, found = words(text or ""), {}
    own_pairs = set(zip(own, own[1:]))
    for k, t, w in items:
        ps = Counter(zip(w, w[1:]))
        weight = {p: math.log(1 + (len(items) - df[p] + 0.5) / (df[p] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * (len(w) - 1) / mean)) for p, n in ps.items()}
        if sum(x for p, x in weight.items() if p in own_pairs) < 0.49 * sum(weight.values()):
            continue
        length = 64 * 2 ** max(0, math.ceil(math.log2(len(w) / 64)))
        for a in range(0, max(1, len(own) - length // 2), length // 2):
            passage, around = own[a : a + length], own[max(0, a - length // 2) : a + length + length // 2]
            there = set(zip(passage, passage[1:]))
            score = sum(x for p, x in weight.items() if p in there) / sum(weight.values())
            if score >= 0.5 - 1e-9 and score > found.get(k, 0) and all(decontam.overlap(part, around) >= 0.5 for part in decontam.question_and_answer(t)):
                found[k] = score
    return found


def _redacted(text, spans):
    out, at = "", 0
    for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        out += text[at:start] + f"[{kind.upper()}]" if start >= at else ""
        at = max(at, end)
    return out + text[at:]


def test_pipeline_stages_match_brute_force(spark, sf_dir, tmp_path):
    import duckdb

    import corpus_pipeline

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = documents(spark, sf_dir)
    for name, stage in corpus_pipeline.STAGES:
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        path = f"{tmp_path}/{name}.parquet"
        if name == "mixing":
            docs.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
            con = duckdb.connect()
            con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
            assert not difference(stage(spark, docs, sf_dir).toPandas(), con.execute(mixing.SQL).df())
            break
        if name == "toxicity":
            matcher = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).matcher()
            expected = {k: t for k, t in rows.items() if matcher.score(t) < 0.5}
        elif name == "ngram_jaccard_join":
            expected = {k: rows[k] for k in _one_of_each(rows.items())}
        elif name == "benchmark_decontamination":
            expected = {k: t for k, t in rows.items() if not _held(items, t)}
        else:
            spans = {r["doc_id"]: r["spans"] for r in pii.found_documents(docs).collect()}
            expected = {k: t if t is None else _redacted(t, spans[k]) for k, t in rows.items()}
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == expected, name
        assert docs.count() == len(expected) and (expected != rows), name


def test_score_is_the_models_own_probability():
    """A text's score against plain attention and exact shares, an id at a time in double precision."""
    import numpy as np

    rng = np.random.default_rng(3)
    learner = lm_scoring.Learner(np.arange(600) % 256, rng.integers(0, 50, 600).astype(float), 1)
    p = learner.p = {n: (x + rng.normal(0, 0.2, x.shape)).astype(np.float32) for n, x in learner.p.items()}
    line, x = rng.integers(0, 600, 400), lambda i: p["c"][learner.classes[i]].astype(float) + p["e"][learner.own_row[i]]
    expected = 0.0
    for i in range(1, len(line)):
        start = (i - 1) // lm_scoring.STRIDE * lm_scoring.STRIDE
        seen = np.arange(max(0, start - lm_scoring.CONTEXT), i)
        own, past = x(line[i - 1]), x(line[seen])
        w = np.exp(past @ p["k"] @ (own @ p["q"]) / 4 + p["g"][i - 1 - seen])
        h = own + w @ (past @ p["v"]) / w.sum()
        sup, sub = divmod(int(learner.classes[line[i]]), lm_scoring.SUPER)
        for z, k in ((h @ p["o1"] + p["b1"], sup), (h @ p["o2"][sup] + p["b2"][sup], sub)):
            expected += z[k] - np.log(np.exp(z).sum())
        expected += learner.within[line[i]]
    found = learner.model().score(line, np.array([len(line)]))[0]
    assert found == pytest.approx(expected / np.log(10), abs=1e-5 * len(line))


def test_prefixes_are_shortened_by_what_is_found():
    import numpy as np

    found = np.zeros(ngram_join.BINS)
    assert ngram_join.shortened(found, 8) == 6 and ngram_join.chance(0.8, 6) >= ngram_join.RECALL
    found[-1] = 1e6  # near copies only: what a depth of 8 misses of them is nothing
    assert ngram_join.shortened(found, 8) == 8
    found[0] = 1e5
    assert ngram_join.shortened(found, 8) < 8


def test_join_is_the_same_in_small_blocks(spark, sf_dir, monkeypatch):
    own = lambda: {(r["doc_id"], r["class_id"], r["n_links"]) for r in registry.op3_ngram_jaccard_join(spark, sf_dir).collect()}
    whole = own()
    monkeypatch.setattr(ngram_join, "NODE_BLOCK", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    monkeypatch.setattr(ngram_join, "MOST_BROADCAST", -1)
    assert own() == whole


def test_recall_at_the_threshold():
    """Pairs of sets at 0.8 meet in a node of some trie, and pass by their signatures, as often as the target says."""
    import numpy as np

    rng, signer, met = np.random.default_rng(5), ngram_join.Signer(), 0
    for _ in range(1000):
        shared = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = (signer.signatures([np.unique(np.concatenate([shared, rng.integers(0, 2**63, 50).astype(np.uint64)]))])[0] for _ in range(2))
        same = a == b
        met += same.reshape(ngram_join.TREES, ngram_join.DEPTH)[:, :6].all(axis=1).any() and same.sum() >= ngram_join.LEAST_EQUAL
    assert met >= 999


def test_join_classes_match_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).collect()]
    found = {r["doc_id"]: r["class_id"] for r in registry.op3_ngram_jaccard_join(spark, sf_dir).collect()}
    assert {k for k, v in found.items() if k == v} == _one_of_each(rows)


def test_one_of_each_keeps_clashing_columns(spark):
    rows = [(1, "a b c d e f", "x", "y", "z"), (2, "a b c d e f", "p", "q", "r"), (None, "a b c d e f", "s", "t", "u"), (None, "k l m", "v", "w", "x")]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _id string, _Rep string, _tid string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3]], key=str)


def test_decontamination_matches_brute_force_in_any_blocks(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(60)
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    texts = [r["text"] for r in documents(spark, sf_dir).orderBy("doc_id").collect()]
    halves = [" ".join([*t.split()[: len(t.split()) // 2], *(f"w{i}" for i in range(60)), *t.split()[len(t.split()) // 2 :]]) for _, t in rows]
    longer = [(1000 + i, " ".join(t.split()[:400])) for i, t in enumerate(sorted(texts, key=len)[-3:])]
    docs = spark.createDataFrame(enumerate([*texts, *halves, *(f"so {t} and" for _, t in rows[:20]), None, ""]), "doc_id long, text string")
    items = spark.createDataFrame(rows + longer, "item_id long, text string")
    expected = {(r["doc_id"], k): v for r in docs.collect() for k, v in _held(rows + longer, r["text"]).items()}
    for most in (1_000_000, 7):
        found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminations(docs, items, most_items=most).collect()}
        assert found.keys() == expected.keys() and all(found[k] == pytest.approx(expected[k]) for k in found), most


def test_decontamination_on_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (1, "the quick brown fox jumps over the lazy dog"), (2, "a"), (3, None), (None, "mail jo@x.org or 49 30 1234 5678"), (4, "")], "item_id long, text string")
    found = Counter((r["doc_id"], r["item_id"]) for r in decontam.contaminations(odd, items).collect())
    assert found == {(4, 1): 2, (5, 1): 2, (6, None): 1}
    assert decontam.contaminations(odd.limit(0), items).count() == decontam.contaminations(odd, items.limit(0)).count() == 0


def test_pipeline_stages_keep_odd_rows_and_clashing_columns(spark, sf_dir, odd):
    import corpus_pipeline

    extra = ["_email", "_PHONE", "_proposed", "_more", "_id", "_tid", "_rep", "k", "h", "g", "t"]
    docs = odd.drop("size", "score").withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in extra})
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = stage(spark, docs, sf_dir), stage(spark, empty, sf_dir)
        assert docs.columns == empty.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra], name
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert set(kept) == {0, 1, 2, 3, 4, 6, 7, 8, None} and docs.count() == 9
    assert kept[0]["text"] is None and kept[1]["text"] == "" and kept[7]["text"] == "é中\U0001f600" and kept[6]["text"] == "mail [EMAIL] or [PHONE]" and kept[8]["text"] == "[IP] 4111 1111 1111 1111"  # the card pattern starts at the last digit of the address
    assert all(r[c] == f"{c}{'-' if k is None else k}" for k, r in kept.items() for c in extra)
    assert not empty.collect() and not corpus_pipeline.STAGES[-1][1](spark, empty, sf_dir).collect()
    taken = {r["doc_id"]: r["size"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()}
    assert taken == {0: 0, 1: 0, 2: 0, 3: 1, 4: 30000, 6: 4, 7: 1, 8: 5, None: 6}


def test_secret_scores_do_not_depend_on_the_cores():
    """The trees of two sessions of different size judge alike."""
    import subprocess
    import sys

    own = """
import sys
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master(sys.argv[1]).config(map={"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}).getOrCreate()
from dimwatch.llm import secrets, pii
from dimwatch.llm.trees import forest
rows = secrets.labelled_findings(spark, 600)
share = forest(rows, secrets.N_FEATURES, "few findings", trees=4)
print("sum", rows.select(F.sum(share(F.col("features")))).first()[0], rows.rdd.getNumPartitions(), pii.labelled_candidates(spark, 60).rdd.getNumPartitions())
"""
    out = [subprocess.run([sys.executable, "-c", own, f"local[{n}]"], capture_output=True, text=True, timeout=300, check=True).stdout.split("sum ")[-1] for n in (1, 3)]
    assert out[0] == out[1] != ""


def test_base_scores_match_sql(spark, sf_dir, duck, monkeypatch):
    """Tokens, known tokens, training tokens and the base score by SQL, with every word in the head and with none."""
    import zlib

    import pandas as pd

    folds = pd.DataFrame([(k, zlib.crc32(str(k).encode()) % 10 == 0) for (k,) in duck.execute("select doc_id from documents").fetchall()], columns=["doc_id", "held"])
    duck.register("folds", folds)
    expected = duck.execute(r"""
      with d as (select doc_id, held, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents join folds using (doc_id)),
      t as (select doc_id, held, unnest(list_append(w, '')) as token from d),
      c as (select token, count(*) as c from t where not held group by token),
      a as (select sum(c) as n, count(*) as v from c)
      select doc_id, any_value(held) as held_out, count(*) as n_tokens, count(c) as n_known, any_value(n)::bigint as train_tokens, sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))) as base_score
      from t left join c using (token) cross join a group by doc_id""").df()
    for head in (0, 65_536):
        monkeypatch.setattr(lm_scoring, "HEAD", head)
        assert not difference(registry.op1_lm_scoring(spark, sf_dir).drop("score").toPandas(), expected), head


def test_shares_of_a_small_vocabulary_sum_to_one():
    """The model's probabilities of every next id after a line add up to 1."""
    import numpy as np

    rng = np.random.default_rng(1)
    learner = lm_scoring.Learner(np.arange(300) % 256, rng.integers(0, 50, 300).astype(float), 1)
    learner.p = {n: (x + rng.normal(0, 0.3, x.shape)).astype(np.float32) for n, x in learner.p.items()}
    model, line = learner.model(), rng.integers(0, 300, 30)
    whole = [model.score(np.append(line, i), np.array([31]))[0] for i in range(300)]
    assert sum(10.0 ** (x - model.score(line, np.array([30]))[0]) for x in whole) == pytest.approx(1, abs=1e-4)


def test_spelled_words_share_what_begins_alike(spark):
    """Shares of words by counts and a loop over pieces; a word is one id, however many pieces it has, and whole words have none."""
    from pathlib import Path

    import numpy as np
    import pyarrow as pa

    proto = Path(registry.tokenizer_path()).read_bytes()
    words = {"whole": 9, "thhaoronnd": 3, "thhaor": 2, "leéonbeungkeit": 5, "zzz%%%": 1}
    counts = lm_scoring.spelled(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3), pa.array(["whole"]), proto)
    model = lm_scoring.Subwords(proto).model
    pieces, pairs, begins = {w: model.encode(w) for w in [*words, "thlenew"]}, {}, {}
    for w in list(words)[1:]:
        for a, b in zip(pieces[w], [*pieces[w][1:], len(counts.row)], strict=True):
            pairs[a, b] = pairs.get((a, b), 0) + words[w]
        begins.setdefault(pieces[w][0], []).append(words[w])
    after = np.full(len(counts.row) + 1, lm_scoring.ADD)
    for (_, b), n in pairs.items():
        after[b] += n
    after *= lm_scoring.BACK / after.sum()
    first, prior, among = lm_scoring.Spelling(proto, counts).of(list(pieces))
    assert np.allclose(np.exp(counts.logs.astype(float)).sum(axis=1), 1, atol=1e-4)
    for i, w in enumerate(pieces):
        share, own = 1.0, begins.get(pieces[w][0], [])
        for a, b in zip(pieces[w], [*pieces[w][1:], len(counts.row)], strict=True):
            row = sum(n for (x, _), n in pairs.items() if x == a)
            share *= (pairs.get((a, b), 0) + after[b]) / (row + lm_scoring.BACK)
        assert first[i] == pieces[w][0] and among[i] == sum(own) + max(1, len(own))
        assert prior[i] == pytest.approx(np.log10(max(1, len(own)) * share), abs=1e-4), w


def test_a_step_is_the_same_in_blocks(monkeypatch):
    """A step's windows are worked through in blocks, whose slopes add up to the whole step's."""
    import numpy as np

    found = []
    for block in (10**6, 128, 7):
        monkeypatch.setattr(lm_scoring, "BLOCK", block)
        rng = np.random.default_rng(5)
        learner = lm_scoring.Learner(np.arange(600) % 256, rng.integers(0, 50, 600).astype(float), 1)
        begun = {n: x.copy() for n, x in learner.p.items()}
        lines = [np.r_[lm_scoring.BEGIN, rng.integers(3, 600, rng.integers(0, 200)), lm_scoring.END] for _ in range(40)]
        lm_scoring.trained(learner, iter([(np.concatenate(lines), np.array([len(x) for x in lines]))]), 1, 150, 0.01)
        found.append(learner)
    for other in found[1:]:
        assert (other.seen == found[0].seen).all()
        for name, x in other.p.items():
            assert np.allclose(x, found[0].p[name], atol=1e-5) and np.abs(x - begun[name]).max() > 1e-4, name


def test_counts_of_ids_follow_from_counts_of_words(spark, odd, monkeypatch):
    """Without another pass over the texts, ids' counts are those of the stored sequences; words are whole, in the head, or neither."""

    class Seen(Exception):
        pass

    def neighbour_counts(ids, counts):
        assert counts.sum() > 0 and (lm_scoring.id_counts(ids, len(counts)) == counts).all()
        raise Seen

    def id_counts(ids, size, count=lm_scoring.id_counts):
        calls.append(size)
        return count(ids, size)

    monkeypatch.setattr(lm_scoring, "neighbour_counts", neighbour_counts)
    for head in (65_536, 5):
        calls: list = []
        monkeypatch.setattr(lm_scoring, "HEAD", head)
        monkeypatch.setattr(lm_scoring, "id_counts", id_counts)
        with pytest.raises(Seen):
            lm_scoring.lm_scores(odd.withColumn("held", F.col("doc_id") == 6), registry.tokenizer_path(), "held")
        assert len(calls) == 1  # the test's own
