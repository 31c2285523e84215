"""Secret scanning with a random forest that removes false positives, in DataFrame operations only.

Candidates are runs of 10 or more token characters with a digit, cloud key ids, and whatever follows a naming word and
a separator. A forest fitted on labelled findings
judges each by its length and alphabet, its character transitions, how much of it is dictionary words, whether it is
part of a path or file name, and the words next to it. Findings that half of the trees or more call secrets are kept.

Null and empty texts have no findings; whole texts are searched by a pattern that is linear in the text; nothing is
shuffled; repeated rows and null ids are scanned each on its own; other columns are ignored. The secret itself is not
returned, only where it is and its digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .spans import between, bound, chunks, find_spans
from .trees import LABELLED_PARTS, forest

TOKEN = "A-Za-z0-9_+/-"
#: What follows a naming word and a separator: any length, no digit needed, up to white space, quotes or brackets.
NAMED = r"(?<=[=:>\"'\x20])(?<=(?i:password|passwd|passphrase|pwd|pass|token|secret|key|auth|bearer|credentials?|private)[\"']?\x20{0,2}[=:]{1,2}>?\x20{0,2}[\"']?)(?![=:>])(?:[^\s\"'`<>,;&(){}\[\]]|&(?!\w+=))+(?<![.?:])"
CANDIDATE = rf"{NAMED}|(?<![{TOKEN}])(?:AKIA[A-Z0-9]{{16}}(?![{TOKEN}])|(?=[A-Za-z_+/-]*+[0-9])[{TOKEN}]{{10,}}+)={{0,2}}"
#: Words that name secrets or tell of something else, parts of names that are no secrets, and frequent letter pairs.
CUES = r"(?i)(?:password|passwd|pwd|pass|token|secret|api[ _-]?key|apikey|access[ _-]?key|key|auth|bearer|credentials?|private)[\"']?\s*(?:[=:]+|is)?\s*[\"']?$"
OTHER_CUES = r"(?i)(?:commit|sha|sha1|md5|sha256|hash|checksum|digest|id|uuid|build|version|order|invoice|card|part|sku|isbn|file|image|img|page|ticket|tracking|phone|serial)[\"']?\s*(?:[=:#]+|no\.|is)?\s*[\"']?$"
DICTIONARY = r"(?i)(?:example|sample|test|dummy|placeholder|your|change|insert|secret|password|token|version|image|file|page|index|part|chapter|section|report|draft|final|name|user|home|data|item|photo|video|backup|release|build|model|series|x{4,}|0{5,}|1234)"
PAIRS = r"(?i)(?:th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|nt|to|ou|le|ha|ng|se|ch|qu|ei|ie)"
N_FEATURES, LABELLED, LEAST = 14, 6000, 0.5


def candidates(text: Column) -> Column:
    """Spans that may be secrets, with what stands before and after."""
    whole = F.coalesce(text, F.lit(""))
    found = find_spans(whole, "secret", CANDIDATE, whole.rlike(CANDIDATE))
    around = lambda c, x: F.struct(x["s"].alias("s"), x["start"].alias("start"), x["end"].alias("end"), between(c, F.greatest(x["start"] - 24, F.lit(0)), x["start"]).alias("before"), between(c, x["end"], x["end"] + 8).alias("after"))
    return bound(found, lambda spans: F.when(F.size(spans) > 0, bound(chunks(whole), lambda c: F.transform(spans, lambda x: around(c, x)))).otherwise(F.array()))


def features(s: Column, before: Column, after: Column) -> Column:
    """A candidate's features as an array of doubles."""
    n = F.char_length(s)
    share = lambda pattern: (n - F.char_length(F.regexp_replace(s, pattern, ""))) / n
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"), "[^0aA]", "-")
    transitions = F.char_length(F.regexp_replace(marked, r"(.)\1+", "$1")) - 1
    letters = F.regexp_replace(s, "[^A-Za-z]", "")
    values = [
        n, share("[0-9]"), share("[a-z]"), share("[A-Z]"), share("[^A-Za-z0-9]"), transitions / n, F.size(F.array_distinct(F.split(s, ""))) / n,
        (s.rlike("^[0-9a-f]+$") & s.rlike("[a-f]")).cast("int"), share(DICTIONARY),
        (F.char_length(letters) - F.char_length(F.regexp_replace(letters, PAIRS, ""))) / F.greatest(F.char_length(letters), F.lit(1)),
        (before.rlike(r"[/\\.]$") | after.rlike(r"^[/\\.][A-Za-z0-9]") | s.rlike("/.*/")).cast("int"), before.rlike(CUES).cast("int"), before.rlike(OTHER_CUES).cast("int"),
        s.rlike(r"^(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{16,})$").cast("int"),
    ]
    return F.array(*(F.coalesce(v.cast("double"), F.lit(0.0)) for v in values))


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """Findings made by rule, half of them secrets: key ids, hex and base-64 keys and passwords with and without a word
    that names them; and card numbers, commit and content hashes, uuids, file names, placeholders, words with digits."""
    rows = spark.range(0, n, 1, LABELLED_PARTS).withColumn("label", (F.col("id") % 2).cast("int")).withColumn("h", F.xxhash64("id", F.lit(9)))
    pick = lambda k, m: F.pmod(F.xxhash64("h", F.lit(k)), F.lit(m))
    choose = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), (pick(k, len(xs)) + 1).cast("int"))
    hexed = lambda k, w: F.substring(F.sha2(F.concat(F.col("h").cast("string"), F.lit(str(k))).cast("binary"), 256), 1, w)
    mixed = lambda k, w: F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat(F.col("h").cast("string"), F.lit(str(k))).cast("binary"), 512))), "+/=", "x7Q"), 1, w)
    upper = lambda k, w: F.translate(F.upper(mixed(k, w)), "01890", "ZKQWX")
    number = lambda k, w: F.lpad(pick(k, 10**w).cast("string"), w, "0")
    word = lambda k: choose(k, ["theration", "enheit", "report", "ciones", "version", "chapter", "elleur", "model", "photo", "order", "thand", "ingtion"])
    phrase = lambda k: choose(k, ["correct", "horse", "battery", "staple", "river", "purple", "window", "tiger", "garden", "silver", "monkey", "orange"])
    plainly = ["required", "the", "none", "null", "true", "false", "here", "optional", "see", "changeme", "****", "your_password", "your-token-here", "${PASSWORD}", "$TOKEN", "https://example.org/reset", "os.environ", "to", "a", "values", "hidden", "not-set", "value", "string"]
    name = choose(3, ["password=", "token = \"", "secret: ", "api_key=", "key: ", "auth token ", "Bearer "])
    plain = choose(4, ["the ", "of ", "and ", "in ", ", ", "was "])
    good = [
        (F.concat(F.lit("AKIA"), upper(1, 16)), F.when(pick(5, 3) == 0, name).otherwise(plain)), (hexed(2, 40), name), (F.concat(hexed(3, 18)), name), (hexed(4, 32), name), (mixed(5, 40), name), (mixed(6, 24), name),
        (F.concat(F.lit("ghp_"), mixed(7, 36)), F.when(pick(6, 2) == 0, name).otherwise(plain)), (F.concat(F.lit("sk_live_"), mixed(8, 24)), F.when(pick(7, 2) == 0, name).otherwise(plain)), (mixed(9, 14), name), (mixed(10, 40), plain),
        (F.concat_ws("-", phrase(41), phrase(42), phrase(43)), name), (F.concat(mixed(11, 1), number(44, 1), mixed(12, 5)), name), (F.concat(mixed(13, 4), choose(45, [*"!#.$%@"]), mixed(14, 4), choose(46, ["", "!", "#", "9"])), name),
        (F.concat(phrase(47), choose(48, [*"!#.$%@"]), phrase(49), number(50, 2)), name), (F.concat(phrase(51), number(52, 3)), name),
    ]
    other = choose(8, ["commit ", "sha256: ", "id=", "build ", "file ", "card ", "order no. ", "hash "])
    bad = [
        (F.concat(F.lit("4"), number(20, 15)), F.when(pick(9, 3) == 0, other).otherwise(plain)), (hexed(21, 40), other), (hexed(22, 32), other), (hexed(23, 64), other),
        (F.concat_ws("-", hexed(24, 8), hexed(25, 4), hexed(26, 4), hexed(27, 4), hexed(28, 12)), F.when(pick(10, 2) == 0, other).otherwise(plain)),
        (F.concat(word(29), F.lit("_"), number(30, 8)), F.when(pick(11, 2) == 0, other).otherwise(plain)), (F.concat(F.lit("your-api-key-"), number(31, 3)), name), (F.concat(F.lit("EXAMPLE"), F.lit("xxxxxxxx"), number(32, 4)), name),
        (F.concat(word(33), word(34), number(35, 2)), plain), (F.concat(word(36), F.lit("/"), word(37), F.lit("/"), number(38, 4)), plain), (number(39, 12), F.when(pick(12, 2) == 0, other).otherwise(plain)), (F.concat(word(40), F.lit("-"), word(41), F.lit("-"), number(42, 4)), plain),
        (choose(53, plainly), name), (choose(54, plainly), name), (phrase(55), name),
    ]
    made = lambda k, xs, i: F.coalesce(*(F.when(pick(k, len(xs)) == j, x[i]) for j, x in enumerate(xs)))
    out = rows.select("label", *(F.when(F.col("label") == 1, made(1, good, i)).otherwise(made(2, bad, i)).alias(c) for i, c in enumerate(("s", "before"))), choose(13, [" ", ". ", "\n", ", ", "\" "]).alias("after"))
    return out.select("label", features(F.col("s"), F.col("before"), F.col("after")).alias("features"))


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """A row for each secret found: key, start_pos, end_pos (code points), sha256 of the secret, and score."""
    share = forest(labelled_findings(docs.sparkSession), N_FEATURES, f"findings {LABELLED}")
    found = written(docs.select(F.col(key), F.explode(candidates(F.col(text))).alias("_c")))  # few and short, without the texts
    described = F.array(features(F.col("_c.s"), F.col("_c.before"), F.col("_c.after")))
    judged = written(found.select(key, "_c", F.transform(described, share)[0].alias("score")))  # else the filter would repeat the trees
    return judged.where(F.col("score") >= least).select(key, F.col("_c.start").alias("start_pos"), F.col("_c.end").alias("end_pos"), F.sha2(F.col("_c.s").cast("binary"), 256).alias("secret_sha256"), "score")
