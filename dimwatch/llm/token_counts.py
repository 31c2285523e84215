"""Token counts without token ids.

A BPE piece of the vocabulary never crosses the start of a run of word marks, nor a line feed (checked when the model
is loaded), so a text's count is the sum of the counts of its pre-tokens. The pre-tokens of a group of documents are
coded by the group's dictionary; pieces are counted once for each distinct pre-token, in a table that stays with the
task; each document's pre-token frequencies are joined to that table by code, and count times frequency is summed by
document. Neither ids nor (document, pre-token) rows leave a task, as those rows would outweigh the input.

Nulls and empty texts have 0 tokens; a null id stays null; repeated rows are counted one by one; extra columns are
ignored. Memory per task: one Arrow batch and a table of at most MAX_TABLE pre-tokens, which is emptied when full.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MAX_TABLE = 700_000
#: A longer pre-token is counted each time, not kept, which bounds the table's bytes.
MAX_KEPT_CHARS = 64
_RUNS = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")


def pre_tokens(text: str) -> list[str]:
    """The text's pre-tokens. Those that follow a single space or start the text come without their mark; others keep
    their leading marks or line feed."""
    if not text:
        return []
    if "  " in text or text[0] == " " or MARK in text:
        return [x[1:] if len(x) > 1 and x[0] == MARK and x[1] not in (MARK, "\n") else x for x in _RUNS.findall(MARK + text.replace(" ", MARK))]
    first, *lines = text.split("\n")
    found = [x or MARK for x in first.split(" ")]
    for line in lines:
        head, *rest = line.split(" ")
        found.append("\n" + head)
        found += [x or MARK for x in rest]
    return found


class PieceCounter:
    """Pieces of pre-tokens by a sentencepiece model, each distinct one counted once while it is in the table."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces) or self.model.encode("  a", out_type=str)[0][0] != MARK:
            raise ValueError("pieces of this model cross pre-tokens")
        self.table: dict[str, int] = {}

    def pieces(self, distinct: list[str]) -> np.ndarray:
        """Number of pieces of each of distinct pre-tokens; all but the long ones stay in the table."""
        new = [x for x in distinct if x not in self.table]
        if len(self.table) + len(new) > MAX_TABLE:
            self.table.clear()
            new = distinct
        # Leading marks: the model adds one itself. A line feed: the mark that it adds before is a piece of its own.
        asked = [x[1:] if x[0] == MARK else x for x in new]
        counts = map(len, self.model.encode(asked, num_threads=1))
        self.table.update((x, 1 if x == MARK else n - (x[0] == "\n")) for x, n in zip(new, counts, strict=True))
        found = np.fromiter(map(self.table.__getitem__, distinct), np.int64, len(distinct))
        for x in new:
            if len(x) > MAX_KEPT_CHARS:
                del self.table[x]
        return found

    def counts(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        start = 0
        while start < len(texts):  # groups of about a million characters
            end, chars = start, 0
            while end < len(texts) and chars < 1_000_000:
                chars += len(texts[end] or "")
                end += 1
            out += self.joined([pre_tokens(x or "") for x in texts[start:end]]).tolist()
            start = end
        return out

    def joined(self, split: list[list[str]]) -> np.ndarray:
        """Tokens of each document from its frequencies of distinct pre-tokens and the pieces of each."""
        codes: dict[str, int] = {}
        own = [Counter(x) for x in split]
        for x in own:
            for token in x:
                codes.setdefault(token, len(codes))
        n_distinct = np.fromiter(map(len, own), np.int64, len(own))
        code = np.fromiter(map(codes.__getitem__, chain.from_iterable(own)), np.int64, n_distinct.sum())
        frequency = np.fromiter(chain.from_iterable(x.values() for x in own), np.int64, n_distinct.sum())
        pieces = self.pieces([*codes]) if codes else np.zeros(0, np.int64)
        return np.bincount(np.repeat(np.arange(len(own)), n_distinct), frequency * pieces[code], len(own)).astype(np.int64)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row of docs."""
    model = Path(model_path).read_bytes()
    sized = docs.select(F.col(key), F.col(text), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model)
        for b in batches:
            n = pa.array(counter.counts(b.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], names=[key, "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    counted = sized.mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
