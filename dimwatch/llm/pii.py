"""Personal data by candidate gradient boosting, in DataFrame operations only.

Four base kinds are patterns with a check and always stay. High-recall generators propose further spans, which may
overlap: telephone numbers without a plus, social security numbers, bank accounts, device addresses, spelled-out
e-mail addresses. Features of their format and of the text around go to gradient-boosted trees, fitted on labelled
candidates, and each kind's threshold is calibrated on held-out ones to a target precision. Of accepted spans that
overlap, a base span wins, then the likelier, then the first.

Null and empty texts have no spans; whole texts are searched with patterns whose time is linear in the text; nothing is
shuffled, so repeated rows, null ids and hot sources cost what other rows do; other columns are kept by `redacted` and
ignored by `found_documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name
from .spans import SPAN, between, bound, chunks, clear_of, digits, find_spans, luhn, overlaps, replaced, written_out
from .trees import LABELLED_PARTS, boosted

# The contract's patterns, each in a form that a backtracking engine runs in linear time. A look behind
# keeps a match from being tried inside a run whose start has failed; \G lets one start where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

#: Patterns of the generators, and what a text must match for a search.
GENERATORS = {
    "tel": (r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])", r"[0-9]{3}[-. ][0-9]{4}"),
    "ssn": (r"(?<![0-9])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9])", r"[0-9][- ][0-9]{2}[- ][0-9]"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    "mac": (r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])", r"[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]"),
    "mail": (r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z]{2,24}){1,3}", r"[\[(](?:at|AT)[\])]"),
}
KINDS = (*BASE, *GENERATORS)
#: The longest and the shortest span of each generator, by its pattern; and how many proposed spans can start where one that overlaps
#: a given span does: in a stretch as long as the longest one, each generator's own spans don't overlap.
LENGTHS = {"tel": (14, 12), "ssn": (11, 11), "iban": (44, 16), "mac": (17, 17), "mail": (240, 8)}
NEAR = sum(max(longest for longest, _ in LENGTHS.values()) // least + 1 for _, least in LENGTHS.values())
CUES = r"(?i)(?:tel|phone|call|fax|mobile|cell|ssn|social|security|iban|account|bank|mail|contact|write|reach|mac|device|adapter)\W*$"
OTHER_CUES = r"(?i)(?:order|invoice|version|sku|part|page|isbn|ref|total|build|model|serial|code|no|nr|item|ticket|lot)\W*$"
#: Precision that a kind's threshold must reach on held-out labelled candidates; rows of that table; features.
PRECISION, LABELLED, N_FEATURES = 0.97, 6000, 12


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base kinds."""
    found = {
        "email": find_spans(text, "email", EMAIL, F.contains(text, F.lit("@"))),
        "ip": find_spans(text, "ip", IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
        "card": find_spans(text, "card", CARD, text.rlike(CARD)),
        "phone": find_spans(text, "phone", PHONE, text.rlike(r"\+[0-9]")),
    }
    def part(p: Column) -> Column:
        own = F.ltrim(p, F.lit("0"))
        return (F.char_length(own) <= 3) & (F.coalesce(own.try_cast("int"), F.lit(0)) <= 255)

    checks: dict[str, Callable[[Column], Column]] = {
        "ip": lambda x: F.forall(F.split(x["s"], r"\."), part),
        "card": lambda x: F.char_length(digits(x["s"])).between(13, 19) & luhn(digits(x["s"])),
        "phone": lambda x: F.char_length(digits(x["s"])).between(9, 15),
    }
    return {k: F.filter(v, checks[k]) if k in checks else v for k, v in found.items()}


def _mod97(s: Column) -> Column:
    """The remainder of an account number's check, letters as two digits."""
    moved = F.concat(F.substring(s, 5, 99), F.substring(s, 1, 4))
    values = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v < 10, a * 10 + v).otherwise(a * 100 + v) % 97)


def features(kind: Column, s: Column, before: Column, after: Column) -> Column:
    """Format and context of a candidate as an array of doubles."""
    d, compact = digits(s), F.regexp_replace(s, "[^A-Za-z0-9]", "")
    first_three = F.substring(d, 1, 3)
    values = [
        F.array_position(F.array(*map(F.lit, GENERATORS)), kind), F.char_length(s), F.char_length(d), F.char_length(F.regexp_replace(s, "[^A-Za-z]", "")),
        F.char_length(s) - F.char_length(compact), F.size(F.array_distinct(F.split(d, ""))), before.rlike(CUES).cast("int"), before.rlike(OTHER_CUES).cast("int"),
        before.rlike(r"[A-Za-z0-9#/_.-]$").cast("int"), after.rlike(r"^[A-Za-z0-9/_-]").cast("int"),
        F.when(kind == "iban", (_mod97(compact) == 1).cast("int")).otherwise(1), (first_three.isin("000", "666") | first_three.startswith("9") | F.substring(d, 4, 2).isin("00")).cast("int"),
    ]
    return F.array(*(F.coalesce(v.cast("double"), F.lit(0.0)) for v in values))


def labelled_candidates(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """Candidates made by rule with what they are: kind, features, label and a fold. Every other one is personal data:
    well-formed, mostly with a fitting word before; the others are numbers and codes of the same shapes with other
    words before, glued to other text, or failing their kind's checks."""
    rows = spark.range(0, n, 1, LABELLED_PARTS).withColumn("label", (F.col("id") % 2).cast("int")).withColumn("h", F.xxhash64("id", F.lit(5)))
    pick = lambda k, m: F.pmod(F.xxhash64("h", F.lit(k)), F.lit(m))
    number = lambda k, w: F.lpad(pick(k, 10**w).cast("string"), w, "0")
    choose = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), (pick(k, len(xs)) + 1).cast("int"))
    hex_pair = lambda k: F.lower(F.lpad(F.hex(pick(k, 256)), 2, "0"))
    good = F.col("label") == 1
    area = F.when(good, (200 + pick(1, 400)).cast("string")).otherwise(F.lpad(pick(1, 200).cast("string"), 3, "0"))
    body = F.concat(F.lit("DE"), F.lit("00"), number(9, 9), number(10, 9))
    check = F.lpad((F.lit(98) - _mod97(body)).cast("string"), 2, "0")
    iban = F.concat(F.lit("DE"), F.when(good, check).otherwise(number(8, 2)), number(9, 9), number(10, 9))
    made = {
        "tel": F.concat(F.when(pick(2, 2) == 0, F.concat(F.lit("("), area, F.lit(") "))).otherwise(F.concat(area, F.lit("-"))), number(3, 3), F.lit("-"), number(4, 4)),
        "ssn": F.concat(F.when(good, F.lpad((1 + pick(5, 665)).cast("string"), 3, "0")).otherwise(choose(5, ["000", "666", "912", "977", "123"])), F.lit("-"), F.when(good, F.lpad((1 + pick(6, 99)).cast("string"), 2, "0")).otherwise(number(6, 2)), F.lit("-"), number(7, 4)),
        "iban": iban,
        "mac": F.concat_ws(":", *(hex_pair(20 + i) for i in range(6))),
        "mail": F.concat(choose(30, ["ann", "jo.b", "kim7", "lee_x"]), F.lit(" [at] "), choose(31, ["mail", "post", "inbox"]), F.lit(" [dot] "), choose(32, ["org", "com", "net"])),
    }
    kind = F.element_at(F.array(*map(F.lit, made)), (pick(0, len(made)) + 1).cast("int"))
    value = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in made.items()))
    filler = choose(41, ["the ", "and ", "then, ", "of "])
    before = F.when(good, F.when(pick(40, 4) > 0, choose(42, ["phone: ", "call ", "tel. ", "ssn ", "account ", "contact ", "bank: ", "mail: "])).otherwise(filler)).otherwise(
        F.when(pick(40, 4) > 0, choose(43, ["order ", "invoice no. ", "part ", "ref-", "sku ", "version ", "item/", "x"])).otherwise(filler))
    after = F.when(good, choose(44, [" ", ". ", ", ", ""])).otherwise(choose(45, ["-7", "/b", " ", "x", " "]))
    out = rows.withColumn("kind", kind).withColumn("s", value).withColumn("before", before).withColumn("after", after)
    return out.select("kind", "label", (pick(50, 4) == 0).alias("held_out"), features(F.col("kind"), F.col("s"), F.col("before"), F.col("after")).alias("features"))


class Detector:
    """Boosted trees with a threshold for each generated kind."""

    #: Thresholds by precision: like the trees, they are found once by a driver.
    calibrations: dict[float, dict[str, float]] = {}

    def __init__(self, spark: SparkSession, precision: float = PRECISION) -> None:
        rows = labelled_candidates(spark)
        self.probability = boosted(rows.where("not held_out"), N_FEATURES, f"candidates {LABELLED}")
        if precision not in self.calibrations:
            self.calibrations[precision] = self._calibrated(rows, precision)
        self.thresholds = self.calibrations[precision]

    def _calibrated(self, rows: DataFrame, precision: float) -> dict[str, float]:
        scored = rows.where("held_out").select("kind", "label", F.round(self.probability(F.col("features")), 3).alias("p"))
        counts = {(r["kind"], r["p"]): (r["n"], r["good"]) for r in scored.groupBy("kind", "p").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()}
        return {k: calibrated([(p, *v) for (kind, p), v in counts.items() if kind == k], precision) for k in GENERATORS}

    def detected(self, docs: DataFrame, text: str) -> tuple[DataFrame, dict[str, Column]]:
        """docs with columns of spans, and these columns: by base kind, and `more` for the accepted others."""
        at = {n: free_name(docs, f"_{n}") for n in (*BASE, "proposed", "described", "scored", "accepted", "more")}
        col = {n: F.col(x) for n, x in at.items()}
        whole = F.coalesce(F.col(text), F.lit(""))
        proposed = F.concat(*(find_spans(whole, k, p, whole.rlike(likely)) for k, (p, likely) in GENERATORS.items()))
        out = docs.withColumns({at[k]: v for k, v in base_spans(whole).items()} | {at["proposed"]: proposed})
        spans = {n: col[n] for n in (*BASE, "more")}
        if not any(x < 2 for x in self.thresholds.values()):
            return out.withColumn(at["more"], F.array().cast(SPAN)).drop(at["proposed"]), spans
        least = F.create_map(*(F.lit(x) for kv in self.thresholds.items() for x in kv))
        of_base = F.concat(*(col[k] for k in BASE))
        free = clear_of(col["proposed"], of_base)
        around = lambda c, x: features(x["kind"], x["s"], between(c, F.greatest(x["start"] - 20, F.lit(0)), x["start"]), between(c, x["end"], x["end"] + 8))
        described = bound(chunks(whole), lambda c: F.transform(free, lambda x: F.struct(*(x[n].alias(n) for n in ("kind", "s", "start", "end")), around(c, x).alias("f"))))
        scored = F.transform(col["described"], lambda x: F.struct(*(x[n].alias(n) for n in ("kind", "s", "start", "end")), self.probability(x["f"]).alias("p")))
        accepted = F.filter(col["scored"], lambda x: x["p"] >= F.element_at(least, x["kind"]))
        beats = lambda y, x: overlaps(x, y) & ((y["p"] > x["p"]) | ((y["p"] == x["p"]) & ((y["start"] < x["start"]) | ((y["start"] == x["start"]) & (y["kind"] < x["kind"])))))
        # spans are in order of start, so one that overlaps is NEAR places away at most
        best = F.filter(col["accepted"], lambda x, i: ~F.exists(F.slice(col["accepted"], F.greatest(i - NEAR, F.lit(0)) + 1, 2 * NEAR + 1), lambda y: beats(y, x)))
        plain = F.transform(best, lambda x: F.struct(*(x[n].alias(n) for n in ("kind", "s", "start", "end")))).cast(SPAN)
        none = F.size(col["proposed"]) == 0
        out = out.withColumn(at["described"], F.when(none, F.lit(None)).otherwise(described)).withColumn(at["scored"], scored).withColumn(at["accepted"], accepted)
        return out.withColumn(at["more"], F.coalesce(plain, F.array().cast(SPAN))).drop(*(at[n] for n in ("proposed", "described", "scored", "accepted"))), spans


def calibrated(scores: list[tuple[float, int, int]], precision: float) -> float:
    """The least probability from which on at least that share is right; 2, which none reaches, if there is none."""
    least, n, good = 2.0, 0, 0
    for p, k, g in sorted(scores, reverse=True):
        n, good = n + k, good + g
        if good >= precision * n:
            least = p
    return least


def found_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts of the base kinds, their digest, and all spans, of every row."""
    found, spans = Detector(docs.sparkSession).detected(docs.select(key, text), text)
    base = F.concat(*(spans[k] for k in BASE))
    of_kind = lambda kind: F.filter(spans["more"], lambda x: x["kind"] == kind)
    by_kind = F.concat(*map(of_kind, GENERATORS))
    counts = [F.size(spans[k]).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(key, *counts, F.sha2(written_out(base).cast("binary"), 256).alias("base_sha256"), written_out(F.concat(base, by_kind)).alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; the other columns as they are."""
    found, spans = Detector(docs.sparkSession).detected(docs, text)
    return found.withColumn(text, replaced(F.col(text), F.concat(*spans.values()))).select(docs.columns)
