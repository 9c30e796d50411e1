"""Problem 7: texts packed into containers of a fixed capacity by sum-of-squares online packing.

Every shard keeps a level array: how many open containers are filled to each level. A text goes to the level at which the
sum of the squared counts becomes least. What is still open when a shard ends is packed once more, with the open
containers as items, over groups of shards, so that the number of half-empty containers does not grow with the shards.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.files import last_delivered
from sievework.shared import materialise, spread, table

CAPACITY = 2048
VOCABULARY = os.environ.get("SIEVEWORK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# The pattern that splits text before the merges of this vocabulary. A fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARDS_PER_GROUP = 64

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a vocabulary file, loaded once per process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


_BORDER = re.compile(r"\S(?=\s)")
_PART = 50_000


def parts(text: str) -> list[str]:
    """A text in parts of at least ``_PART`` characters that end where white space follows a character that is none. No token
    of the pattern reaches over such a place, so that the parts have the tokens of the whole."""
    out, low = [], 0
    while len(text) - low > _PART and (m := _BORDER.search(text, low + _PART)):
        out.append(text[low : m.end()])
        low = m.end()
    return [*out, text[low:]]


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    """Tokens of a whole text. A long one is encoded in parts, see :func:`parts`."""
    code = encoding(path)
    return sum(len(code.encode_ordinary(part)) for part in parts(text))


class Levels:
    """Open containers by fill level, and the choice of the level for the next item."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = 0

    def place(self, size: int) -> int:
        """Puts an item of 1 to ``capacity`` into a container and returns its number.

        The sum of the squares changes by 2 (N(h+s) - N(h)) + 2 if a container moves from level h to h + s, by
        1 - 2 N(h) if that fills it, and by 2 N(s) + 1 for a new container, none if the item fills it at once. Of equal
        choices the fullest container is taken.
        """
        top = self.capacity - size
        counts = self.counts
        if not top:
            self.opened += 1
            return self.opened - 1
        change = 2 * (counts[size : self.capacity + 1] - counts[: top + 1]) + 2
        change[top] = 1 - 2 * counts[top]
        change[1:][counts[1 : top + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * counts[size] + 1
        level = top - int(np.argmin(change[::-1]))
        if level:
            number = self.open[level].pop()
            counts[level] -= 1
        else:
            number = self.opened
            self.opened += 1
        level += size
        if level < self.capacity:
            self.open[level].append(number)
            counts[level] += 1
        return number

    def still_open(self) -> list[tuple[int, int]]:
        return [(number, level) for level, numbers in enumerate(self.open) for number in numbers]


def sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of the last delivery of each text; only the counts are shuffled. A null text has 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [count_tokens(text, vocabulary) if text else 0 for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, type=pa.int64())], names=["doc_id", "ingested_at", "n_tokens"])

    slim = spread(documents.select(F.col("doc_id").cast("long"), F.col("ingested_at").cast("timestamp"), "text"), "doc_id")
    return last_delivered(slim.mapInArrow(run, "doc_id long, ingested_at timestamp, n_tokens long"), "doc_id")


def packed(counted: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece_no, first_token, n_tokens, container) for sized texts.

    Only a text longer than the capacity is cut: into full pieces, each a container by itself, and a rest that is
    packed like any other item. A text without tokens gets no row, input without rows gives none. Containers are
    numbered without gaps being promised; the numbers are unique over all shards.
    """
    schema = "doc_id long, piece_no int, first_token long, n_tokens long, shard long, bin long, still_open boolean"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, shard = Levels(capacity), TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            for doc, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = [(i, i * capacity, capacity) for i in range(n // capacity)]
                if n % capacity:
                    pieces.append((len(pieces), n - n % capacity, n % capacity))
                out += [(doc, i, first, size, shard, levels.place(size), False) for i, first, size in pieces]
            yield _batch(out)
        yield _batch([(None, None, None, level, shard, number, True) for number, level in levels.still_open()])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=names)

    rows = materialise(counted.select("doc_id", "n_tokens").where(F.col("n_tokens") > 0).mapInArrow(run, schema), "packed-pieces")

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["fill", "shard", "bin"], ascending=[False, True, True], kind="stable")
        levels = Levels(capacity)
        part["merged"] = [levels.place(int(s)) for s in part["fill"]]
        part["merged"] += (part["family"] + (1 << 30)) * (1 << 32)
        return part[["shard", "bin", "merged"]]

    # a group holds what some shards left open, at most one container per level and shard
    left = rows.where("still_open").select((F.floor(F.col("shard") / SHARDS_PER_GROUP)).cast("long").alias("family"), "shard", "bin", F.col("n_tokens").alias("fill"))
    merged = left.groupBy("family").applyInPandas(merge, "shard long, bin long, merged long")
    pieces = rows.where(~F.col("still_open")).join(merged, ["shard", "bin"], "left")
    container = F.coalesce("merged", F.shiftleft("shard", 32) + F.col("bin")).alias("container")
    return pieces.select("doc_id", "piece_no", "first_token", "n_tokens", container)


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Each text, or piece of a text longer than a container, with its container."""
    return packed(sizes(table(spark, folder, "documents")))


def p7_usage(spark: SparkSession, folder: str) -> DataFrame:
    """How many containers are used, and how full they are."""
    fills = p7_containers(spark, folder).groupBy("container").agg(F.sum("n_tokens").alias("fill"))
    return fills.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("fill").alias("n_tokens"), F.max("fill").alias("fullest"), (F.sum("fill") / (F.count(F.lit(1)) * CAPACITY)).alias("used_share"))


QUERIES = {"p7_containers": p7_containers, "p7_usage": p7_usage}
SQL: dict[str, str] = {}
