"""Spans of regular expressions as Column expressions. Places are code points, from 0, the end not included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_TYPE = "struct<kind:string,s:string,start:int,end:int>"
SPAN = f"array<{SPAN_TYPE}>"


#: Code points of a text's chunks.
CHUNK = 1024


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def scanned(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What step gives for each item in order, from (state, item) to (next state, result of a type): a running aggregate.

    Arrays grow by copies, so results are gathered in blocks of about the root of their number: time grows as the number
    to the power of 1.5 in copied references alone, and 100,000 items take about 15 million."""

    def within(acc: Column, block: Column) -> Column:
        def one(own: Column, x: Column) -> Column:
            after, result = step(own["state"], x)
            return F.struct(after.alias("state"), F.concat(own["out"], F.array(result)).alias("out"))

        begin = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(block, begin, one, lambda own: F.struct(own["state"].alias("state"), F.concat(acc["out"], F.array(own["out"])).alias("out")))

    def blocks(all: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(all)))).cast("int")
        return F.when(F.size(all) > 0, F.transform(F.sequence(F.lit(1), F.size(all), size), lambda at: F.slice(all, at, size))).otherwise(F.array())

    begin = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.flatten(F.aggregate(bound(items, blocks), begin, within, lambda acc: acc["out"]))


def chunks(text: Column) -> Column:
    """The text in pieces of CHUNK code points, for between()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of the text that the chunks make up, without walking through the text before."""
    first = F.floor(start / CHUNK).cast("int")
    n = F.floor((F.greatest(end, start + 1) - 1) / CHUNK).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(pieces, first + 1, n), ""), (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))


def find_spans(text: Column, kind: str, pattern: str, likely: Column) -> Column:
    """The leftmost non-overlapping matches of a pattern, which never matches an empty string; only looked for where
    `likely` is true. The pieces between matches give the places."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, s: F.struct(F.char_length(gap).alias("gap"), s.alias("s")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        end = start + F.coalesce(F.char_length(x["s"]), F.lit(0))
        return end, F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), start.alias("start"), end.alias("end"))

    found = F.filter(scanned(pieces, F.lit(0), step, SPAN_TYPE), lambda x: x["s"].isNotNull())
    return F.when(likely, found).otherwise(F.array().cast(SPAN))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    places = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    doubled = F.transform(places, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def written_out(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def clear_of(spans: Column, others: Column) -> Column:
    """The spans, in order of start, that overlap none of the others: one pass to the right with the farthest end of the
    others so far, and one back with the nearest start of those to come."""
    mark = "struct<start:int,fixed:int,end:int,kind:string,s:string,hit:boolean>"
    marked = lambda xs, fixed: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), F.lit(fixed).alias("fixed"), x["end"].alias("end"), x["kind"].alias("kind"), x["s"].alias("s"), F.lit(False).alias("hit")))
    with_hit = lambda x, hit: F.struct(*(x[c].alias(c) for c in ("start", "fixed", "end", "kind", "s")), hit.alias("hit"))

    def right(reach: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["fixed"] == 0, F.greatest(reach, x["end"])).otherwise(reach), with_hit(x, x["start"] < reach)

    def left(next: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["fixed"] == 0, x["start"]).otherwise(next), with_hit(x, x["hit"] | (x["end"] > next))

    ordered = F.array_sort(F.concat(marked(others, 0), marked(spans, 1)))
    told = scanned(F.reverse(scanned(ordered, F.lit(0), right, mark)), F.lit(2**31 - 1), left, mark)
    free = F.reverse(F.filter(told, lambda x: (x["fixed"] == 1) & ~x["hit"]))
    return F.transform(free, lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "s", "start", "end")))).cast(SPAN)


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span, in order of start, replaced by its kind in brackets; what overlaps becomes one."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    # what is left of the text comes last, as a span without a kind
    rest = F.struct(F.char_length(text).alias("start"), F.char_length(text).alias("end"), F.lit(None).cast("string").alias("kind"))

    def pieces(chunked: Column) -> Column:
        def step(at: Column, x: Column) -> tuple[Column, Column]:
            name = F.when(x["kind"].isNull(), "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
            return F.greatest(at, x["end"]), F.when(x["start"] >= at, F.concat(between(chunked, at, x["start"]), name)).otherwise("")

        return scanned(F.concat(ordered, F.array(rest)), F.lit(0), step, "string")

    return F.when(F.size(spans) > 0, F.array_join(bound(chunks(text), pieces), "")).otherwise(text)
