"""Spans, their overlaps and replacements against loops, with very many matches in one text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from dimwatch.llm import pii, spans


def one(spark, value):
    return spark.range(1).select(value.alias("x")).first()["x"]


def array(spans_of):
    return F.array(*(F.struct(F.lit(k).alias("kind"), F.lit("s").alias("s"), F.lit(a).alias("start"), F.lit(b).alias("end")) for k, a, b in spans_of)).cast(spans.SPAN)


@pytest.mark.parametrize("n", [0, 1, 16, 17, 300])
def test_places_of_matches(spark, n):
    text = "".join(f"é{'x' * (i % 5)}\U0001f600{i} " for i in range(n))
    found = one(spark, spans.find_spans(F.lit(text), "n", "[0-9]+", F.lit(True)))
    assert [(r["s"], r["start"], r["end"]) for r in found] == [(m[0], m.start(), m.end()) for m in re.finditer("[0-9]+", text)]


def test_overlaps_and_replacements_match_loops(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ab é\U0001f600\n") for _ in range(5000))
    for n in (0, 3, 40):
        made = lambda kind: [(kind, a, a + rng.randrange(1, 60)) for a in sorted(rng.randrange(0, 4900) for _ in range(n))]
        own, others = made("tel"), made("email")
        clear = one(spark, spans.clear_of(array(own), array(others)))
        assert sorted((r["start"], r["end"]) for r in clear) == sorted((a, b) for _, a, b in own if not any(a < d and c < b for _, c, d in others))
        assert [r["start"] for r in clear] == sorted(r["start"] for r in clear)
        expected, at = "", 0
        for a, b, k in sorted((a, b, k) for k, a, b in own + others):
            if a >= at:
                expected += text[at:a] + f"[{k.upper()}]"
            at = max(at, b)
        assert one(spark, spans.replaced(F.lit(text), array(own + others))) == expected + text[at:]


def test_parts_of_long_texts(spark):
    text = "".join(chr(97 + i % 26) if i % 7 else "\U0001f600" for i in range(5000))
    for a, b in ((0, 0), (0, 3), (1023, 1025), (1024, 1024), (1024, 3072), (2047, 2048), (4990, 5000), (4990, 6000), (5000, 5008)):
        assert one(spark, spans.between(spans.chunks(F.lit(text)), F.lit(a), F.lit(b))) == text[a:b]


def test_generated_spans_are_as_long_as_stated():
    longest = {"tel": "(212) 555-1234", "ssn": "123-45-6789", "iban": "DE12" + " ABCD" * 7 + " ABC", "mac": "00:11:22:33:44:55", "mail": "x" * 64 + " [at] " + "y" * 63 + " [dot] abcdefghijklmnopqrstuvwx" * 3}
    for kind, text in longest.items():
        assert re.fullmatch(pii.GENERATORS[kind][0], text) and len(text) <= pii.LENGTHS[kind][0]


def test_many_matches_in_one_text_take_linear_time(spark):
    detector = lambda n: pii.found_documents(spark.createDataFrame([(1, " ".join(f"a{i}@mail.org" for i in range(n)))], "doc_id long, text string"))
    detector(10).collect()
    seconds = []
    for n in (15_000, 60_000):
        began = time.perf_counter()
        assert detector(n).first()["n_email"] == n
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 8 * max(seconds[0], 2.0)
