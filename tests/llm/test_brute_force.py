"""Operators that SQL can't express, against plain Python; and defined results of odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dimwatch.llm import langid, lm_scoring, media, mixing, ngram_join, pii, registry, secrets, token_counts, toxicity
from dimwatch.llm.common import fold, least_hashes

LONG = "the quick brown fox jumps over the lazy dog again " * 3000
#: Ids and texts of rows that are null, empty, long, repeated, without id.
ROWS = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (4, LONG), (5, LONG), (6, "mail jo@x.org or +49 30 1234 5678"), (7, "é中\U0001f600"), (8, "1.2.3.4 4111 1111 1111 1111"), (3, "a"), (None, "a b c d e f")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, None if i % 2 else "en", "web", "s", "t", "u") for i, (k, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size string, score string, n_tokens string")


def crc(k, parts):
    return zlib.crc32(b"" if k is None else str(k).encode()) % parts


def rank_order(text):
    """A text's most frequent n-grams in order, by counting strings."""
    plain = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    if not plain:
        return Counter()
    padded = f" {plain} "
    return Counter(padded[i : i + n] for n in range(1, 5) for i in range(len(padded) - n + 1))


def ordered(counts):
    packed = lambda g: sum((ord(c) & 0xFFFF) << (16 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], packed(g)))[:300]


def test_languages_match_out_of_place_distances(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    own: dict[str, Counter] = {}
    for lang, text in {(r["lang"], r["text"]) for r in docs if r["lang"] and r["text"] and crc(r["doc_id"], 4) != 2}:
        own.setdefault(lang, Counter()).update(rank_order(text))
    ranks = {lang: {g: i for i, g in enumerate(ordered(c))} for lang, c in sorted(own.items())}
    found = {r["doc_id"]: r for r in registry.op2_language_id(spark, sf_dir).collect()}
    assert len(found) == len(docs)
    for r in docs:
        profile = ordered(rank_order(r["text"] or ""))
        assert found[r["doc_id"]]["held_out"] == (crc(r["doc_id"], 4) == 2)
        if not profile:
            assert (found[r["doc_id"]]["lang_pred"], found[r["doc_id"]]["score"]) == ("und", 0)
            continue
        away = {lang: sum(abs(at[g] - i) if g in at else 300 for i, g in enumerate(profile)) / (300 * len(profile)) for lang, at in ranks.items()}
        best = min(away, key=lambda x: (away[x], x))
        assert found[r["doc_id"]]["lang_pred"] == best
        assert found[r["doc_id"]]["score"] == pytest.approx(1 / sum(math.exp((away[best] - x) / langid.TEMPERATURE) for x in away.values()))


def test_toxicity_matches_a_scan_of_every_phrase(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn(docs, labels.where(fold("doc_id", 5) != 0))
    lexicon.exceptions = [*lexicon.exceptions, *(f"{w} the" for w in list(lexicon.weights)[:5])]
    matcher, words = lexicon.matcher(), "|".join(map(re.escape, lexicon.weights))
    assert lexicon.weights
    for r in docs.limit(60).collect() + [{"text": f"x {w} the {w} {w}the {w}!"} for w in list(lexicon.weights)[:8]]:
        f = toxicity.folded(r["text"] or "")
        spared = [m.span() for e in lexicon.exceptions for m in re.finditer(rf"(?<![^\W_])(?={re.escape(e)}(?![^\W_]))", f) for m in [re.compile(re.escape(e)).match(f, m.start())]]
        hits = [(m.start(), m.start() + len(w), x) for w, x in lexicon.weights.items() for m in re.finditer(rf"(?<![^\W_])(?={re.escape(w)}(?![^\W_]))", f)]
        assert matcher.weight(f) == pytest.approx(sum(x for a, b, x in hits if not any(c <= a and b <= d for c, d in spared)))
    assert words


def test_folding_does_not_depend_on_the_rest_of_a_text():
    for disguised in ("ìdíöt", "i\u0300di\u0301o\u0308t", "ìdiot\u0301", "\u2170diot", "ªé", "a\u0301e\u0301"):
        plain = toxicity.folded(disguised)
        assert toxicity.folded(disguised + " \u2603") == f"{plain} \u2603" and plain in ("ldlot", "ae")


def test_a_lexicon_with_other_exceptions_is_another():
    words = {"bad": 4.0}
    one, two = (toxicity.Lexicon(words, e, (-3.0, 1.0, 1.0)) for e in ([], ["bad luck"]))
    assert toxicity._matcher(one).score("bad luck") > toxicity._matcher(two).score("bad luck")


def test_folding_sees_through_disguise():
    assert toxicity.folded("1D10T") == toxicity.folded("idiot") == toxicity.folded("іdі​оt") == toxicity.folded("ｉｄｉｏｔ")


def test_planted_secrets_are_found_and_clean_text_left(spark, sf_dir):
    made = lambda i, n: hashlib.sha256(str(i).encode()).hexdigest()[:n]
    upper = lambda i: "AKIA" + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[b % 32] for b in hashlib.sha256(str(i).encode()).digest()[:16])
    plants = [f"config api_key={made(i, 32)} end" for i in range(40)] + [f"use token = \"{made(i, 40)}\" here" for i in range(40, 80)] + [f"the key {upper(i)} leaked" for i in range(80, 120)]
    clean = [f"commit {made(i, 40)} fixes it" for i in range(40)] + [f"order no. {i}12345678{i} shipped" for i in range(40)] + ["plain words without any secret at all"] * 5
    found = {r["doc_id"] for r in secrets.secrets(spark.createDataFrame(enumerate(plants + clean), "doc_id long, text string")).collect()}
    assert len(found & set(range(120))) >= 0.95 * 120 and len(found - set(range(120))) <= 0.05 * len(clean)


def test_generated_spans_are_found_in_context(spark):
    texts = ["call (415) 555-0132 now", "ssn 219-09-9999 on file", "account DE89370400440532013000 please", "contact ann [at] mail [dot] org today", "order 4155550132 shipped", "mac: aa:bb:cc:dd:ee:0f here"]
    found = {r["doc_id"]: {s.split(":")[0]: texts[r["doc_id"]][int(s.split(":")[1]) : int(s.split(":")[2])] for s in r["spans"].split(",") if s} for r in pii.found_documents(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).collect()}
    assert found[0] == {"tel": "(415) 555-0132"} and found[1] == {"ssn": "219-09-9999"} and found[2]["iban"] == "DE89370400440532013000" and found[3] == {"mail": "ann [at] mail [dot] org"} and found[4] == {}


def _vint(data, at, marker):
    n = next(i for i in range(1, 9) if data[at] & (0x100 >> i))
    value = int.from_bytes(data[at : at + n], "big")
    return (value if marker else value & ~(1 << (7 * n))), at + n


def _elements(data, at, end):
    while at < end:
        ident, at = _vint(data, at, True)
        size, at = _vint(data, at, False)
        yield ident, at, at + size
        at += size
    assert at == end


def test_media_files_walk_to_their_ends_and_cues_point_to_clusters(spark, odd):
    payload = {k: (t or "").encode() for k, t in ROWS}
    for r in media.round_trip(odd, "doc_id", "text").collect():
        data = payload[r["doc_id"]]
        padded = data.ljust(max(192, -(-len(data) // 192) * 192))
        stored = media.build(padded)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        (head, *_), (segment, a, b) = _elements(stored, 0, len(stored))
        assert (head, segment) == (media.EBML, media.SEGMENT)
        inside = list(_elements(stored, a, b))
        starts, clusters = [], 0
        at = a
        for ident, c, d in inside:
            if ident == media.CLUSTER:
                starts.append(at - a)
                clusters += 1
            at = d
        places = [int.from_bytes(stored[e:f], "big") for i, c, d in inside if i == media.CUES for j, x, y in _elements(stored, c, d) if j == media.CUE for k, p, q in _elements(stored, x, y) if k == media.CUE_PLACES for m, e, f in _elements(stored, p, q) if m == media.CUE_CLUSTER]
        assert clusters and places and set(places) <= set(starts)


@pytest.mark.parametrize("lacing", media.LACINGS)
def test_lacings_unknown_sizes_and_block_groups(spark, lacing):
    """A file made by hand: a segment and a cluster of unknown size, a block in a group, one block after."""
    parts = [b"a" * 300, b"b" * 300, b"c" * 300] if lacing == "fixed" else [b"x" * 7, b"y" * 400, b"z" * 3] if lacing != "none" else [b"q" * 50]
    own = media.block(1, 0, lacing, parts)
    group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, own))
    unknown = b"\x01\xff\xff\xff\xff\xff\xff\xff"
    cluster = media.CLUSTER.to_bytes(4, "big") + unknown + media.number(media.CLUSTER_TIME, 0) + group + media.element(media.SIMPLE_BLOCK, media.block(1, 9, "none", [b"last"]))
    data = media.HEAD + media.SEGMENT.to_bytes(4, "big") + unknown + media.element(media.INFO, media.number(media.SCALE, 1_000_000)) + media.TRACK_LIST + cluster
    found = media.packets(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(data[:-2])), (3, bytearray(b"")), (4, None)], "id long, content binary"), "id", "content").collect()
    whole = sorted((r for r in found if r["id"] == 1), key=lambda r: r["first_byte"])
    assert [data[r["first_byte"] : r["first_byte"] + r["n_bytes"]] for r in whole] == [*parts, b"last"] and {r["lacing"] for r in whole} == {lacing, "none"}
    assert all(r["error"] for r in found if r["id"] in (2, 3)) and not [r for r in found if r["id"] == 4]


def test_odd_rows_have_defined_values(spark, odd):
    def rows(df, *names):
        return sorted(((r["doc_id"], *(r[n] for n in names)) for r in df.collect()), key=str)

    words = {k: len((t or "").split()) for k, t in ROWS}
    assert rows(mixing.mix_documents(odd), "size") == sorted(((k, words[k]) for k, _ in ROWS), key=str)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer_path())
    tokens = {k: len(model.encode(t or "")) for k, t in ROWS}
    assert rows(token_counts.token_counts(odd, registry.tokenizer_path()), "n_bytes", "n_tokens", "over_limit") == sorted(((k, len((t or "").encode()), tokens[k], tokens[k] > 4096) for k, t in ROWS), key=str)
    links = {4: (4, 1), 5: (4, 1), 3: (3, 1)}
    assert rows(ngram_join.ngram_join(odd), "class_id", "n_links") == sorted(((k, *links.get(k, (k, 0))) for k, _ in ROWS), key=str)
    assert {r["doc_id"] for r in langid.identified_documents(odd).where("lang_pred = 'und'").collect()} >= {0, 1, 2, 8}
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    scored = toxicity.scored_documents(odd, labels)
    assert scored.count() == len(ROWS) and scored.where("score between 0 and 1 and predicted = cast(score >= 0.5 as int)").count() == len(ROWS)
    assert scored.where("doc_id in (0, 1, 2) and score >= 0.5").count() == 0
    lm = lm_scoring.scored_documents(odd, registry.tokenizer_path()).collect()
    assert sorted((r["n_tokens"] for r in lm)) == sorted(words[k] + 1 for k, _ in ROWS)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 and r["held_out"] == (crc(r["doc_id"], 10) == 0) for r in lm)
    assert all(r["base_score"] == pytest.approx(lm[0]["base_score"]) and r["score"] == pytest.approx(lm[0]["score"], abs=1e-5) for r in lm if lm[0]["doc_id"] in (0, 1, 2) and r["doc_id"] in (0, 1, 2))
    assert len({r["base_score"] for r in lm if r["doc_id"] in (0, 1, 2)}) == 1
    assert secrets.secrets(odd.limit(0)).count() == 0 and secrets.secrets(odd).count() == 0


def test_least_hashes_are_the_least_and_know_no_order(spark):
    rows = spark.range(3000).select((F.col("id") % 3 > 0).cast("int").alias("g"), F.xxhash64(F.col("id") % 900).alias("h"))
    expected = {g: sorted({r["h"] for r in rows.where(F.col("g") == g).collect()})[:20] for g in (0, 1)}
    for df in (rows, rows.repartition(7).orderBy(F.rand())):
        found = least_hashes(df, 20)
        assert {g: [r["h"] for r in found if r["g"] == g] for g in (0, 1)} == expected
    assert least_hashes(rows.limit(0), 5) == []
