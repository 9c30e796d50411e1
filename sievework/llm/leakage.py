"""Problem 8: evaluation texts that leak into training text, by a distributed positional inverted index.

The index is stored: a table of segments, each of some documents, with the postings of the items' terms in order of the term
and their positions, which run through the segment's documents. The counts of all segments together say which terms are rare
in the whole corpus. Of every window of an item the rarest terms are anchors, one more than edits can hit. In each segment
the postings of an anchor, shifted by its offset in the item, are intersected with the shifted lists of the window's other
terms, where edits allow for some that do not meet and for shifts by as many words. Where enough lists meet, the passage is
verified by edit distance. So no text and no posting is shuffled or collected: segments stay where they are written.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.shared import materialise, spread, table

PASSAGE = 20
EDIT_SHARE = 8
# Lengths of windows that suffice, with one edit in eight each. A passage of 8e words or more with e edits has a part of 8e
# words with no more; from e = 5 on it splits in two parts of at least 20 words, of which one is within its own share.
WINDOWS = (PASSAGE, 24, 32)
# The items are broadcast; more words than this are refused instead of swamping the executors.
MOST_ITEM_WORDS = 20_000_000

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|&(?:[a-z]+|#\d+);")
_PREFIX = re.compile(
    r"(?m)^[ \t]*(?:(?:[>|*#+\-]+|//+|--+|\d{1,4}[.):|]|\[[^\]\n]{1,40}\]|\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d)?(?:[.,]\d+)?(?:Z|[+\-]\d\d:?\d\d)?(?:[ \t]+\[?(?:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|FATAL)\]?)?(?:[ \t]+[\w.]+-\d+)?|(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b:?)(?=[ \t]|$)[ \t]*)+"
)
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)")


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case; line prefixes, markup and punctuation do not matter."""
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(_PREFIX.sub("", text).lower())


@dataclass(frozen=True)
class Item:
    item_id: int
    words: tuple[int, ...]


def prepared(rows: list[tuple[int, str | None]]) -> tuple[list[Item], dict[str, int]]:
    """Items as term numbers, without a first sentence that several items share; items without words are left out."""
    firsts: Counter[tuple[str, ...]] = Counter()
    cut: list[tuple[int, str, str]] = []
    for item_id, text in rows:
        if item_id is None or not text:
            continue
        m = _SENTENCE.search(text)
        end = m.end() if m else len(text)
        line = text.find("\n")
        if 0 <= line < end:
            end = line
        cut.append((item_id, text[:end], text[end:]))
        firsts[tuple(words(text[:end]))] += 1
    vocabulary: dict[str, int] = {}
    items = []
    for item_id, first, rest in cut:
        own = words(rest) if firsts[tuple(words(first))] > 1 else words(first + rest)
        # an item that is nothing but the shared sentence has no passage
        if own:
            items.append(Item(item_id, tuple(vocabulary.setdefault(w, len(vocabulary)) for w in own)))
    return items, vocabulary


def edits_within(window: tuple[int, ...], text: list[int], most: int) -> bool:
    """Whether the window occurs in the text with at most ``most`` words replaced, dropped or added."""
    before = [0] * (len(text) + 1)
    for i, w in enumerate(window, 1):
        now = [i]
        low = i
        for j, t in enumerate(text, 1):
            v = before[j - 1] + (w != t)
            if before[j] + 1 < v:
                v = before[j] + 1
            if now[j - 1] + 1 < v:
                v = now[j - 1] + 1
            now.append(v)
            if v < low:
                low = v
        if low > most:
            return False
        before = now
    return min(before) <= most


def anchors(item: tuple[int, ...], length: int, most: int, counts: np.ndarray) -> list[int]:
    """Positions of which every window holds ``most + 1``: its rarest terms. Edits spare one of them at least."""
    chosen: set[int] = set()
    for start in range(len(item) - length + 1):
        window = range(start, start + length)
        have = sum(p in chosen for p in window)
        if have <= most:
            rest = sorted((p for p in window if p not in chosen), key=lambda p: (counts[item[p]], -p))
            chosen.update(rest[: most + 1 - have])
    return sorted(chosen)


@dataclass(frozen=True)
class Plan:
    """How an item is looked for: the lengths of its windows with the edits each may have, and its anchors over all lengths.
    An anchor has positions beside it, of which every passage around it holds one, and the words that edits can move it by."""

    item: Item
    lengths: tuple[tuple[int, int], ...]
    anchors: tuple[tuple[int, tuple[int, ...], int], ...]


def plans_of(items: list[Item], counts: np.ndarray) -> list[Plan]:
    """A plan for each item, with anchors by the counts of the whole corpus."""
    out = []
    for item in items:
        n = len(item.words)
        lengths = tuple((length, length // EDIT_SHARE) for length in ([w for w in WINDOWS if w <= n] or [n]))
        found: dict[int, tuple[set[int] | None, int]] = {}
        for length, most in lengths:
            for p in anchors(item.words, length, most, counts):
                beside = _beside(item.words, p, length, most, counts)
                known, widest = found.get(p, (set(), 0))
                found[p] = (None if known is None or not beside else known | set(beside), max(most, widest))
        out.append(Plan(item, lengths, tuple((p, tuple(sorted(beside or ())), most) for p, (beside, most) in sorted(found.items()))))
    return out


def _beside(item: tuple[int, ...], p: int, length: int, most: int, counts: np.ndarray) -> tuple[int, ...]:
    """The ``most + 1`` rarest positions in each half window next to an anchor. A window around the anchor holds one of the
    halves whole, and edits spare one of its positions at least. None if the halves are too short to tell."""
    half = (length - 1) // 2
    if half <= most:
        return ()
    sides = (range(max(0, p - half), p), range(p + 1, min(len(item), p + half + 1)))
    return tuple(sorted({q for side in sides for q in sorted(side, key=lambda q: (counts[item[q]], q))[: most + 1]}))


_SEGMENT = "docs array<long>, bounds array<int>, starts array<int>, postings array<int>"


class Segment:
    """The postings of some documents: positions in order of the term, where each term's list starts, and where documents
    begin among the positions."""

    def __init__(self, docs: np.ndarray, bounds: np.ndarray, starts: np.ndarray, postings: np.ndarray):
        self.docs, self.bounds, self.starts, self.postings = docs, bounds, starts, postings
        self._terms: np.ndarray | None = None

    @classmethod
    def of(cls, keys: list[int], texts: list[str | None], vocabulary: dict[str, int]) -> "Segment":
        get, ids, bounds = vocabulary.get, [], [0]
        gap = [-1] * (max(WINDOWS) + 4)  # no passage runs over the end of a document
        for text in texts:
            if text:
                ids += [get(w, -1) for w in words(text)]
            ids += gap
            bounds.append(len(ids))
        terms = np.array(ids, dtype=np.int32)
        known = np.flatnonzero(terms >= 0)
        postings = known[np.argsort(terms[known], kind="stable")].astype(np.int32)
        starts = np.searchsorted(terms[postings], np.arange(len(vocabulary) + 1)).astype(np.int32)
        return cls(np.array(keys, dtype=np.int64), np.array(bounds, dtype=np.int32), starts, postings)

    def list_of(self, term: int) -> np.ndarray:
        return self.postings[self.starts[term] : self.starts[term + 1]]

    @property
    def terms(self) -> np.ndarray:
        """The term of each position, -1 for words that no item has: what verification reads."""
        if self._terms is None:
            self._terms = np.full(int(self.bounds[-1]), -1, np.int32)
            self._terms[self.postings] = np.repeat(np.arange(len(self.starts) - 1, dtype=np.int32), np.diff(self.starts))
        return self._terms

    def search(self, plans: list[Plan]) -> list[tuple[int, int]]:
        """(document, item) of all passages in the segment."""
        return [(int(self.docs[doc]), plan.item.item_id) for plan in plans for doc in sorted(self._search(plan))]

    def _off(self, term: int, offset: int, diagonals: np.ndarray) -> np.ndarray:
        """How far off each diagonal a term's list, shifted by its offset, has its nearest entry."""
        shifted = self.list_of(term)
        if not len(shifted):
            return np.full(len(diagonals), np.iinfo(np.int32).max, dtype=np.int64)
        wanted = diagonals + offset
        at = np.searchsorted(shifted, wanted)
        return np.minimum(np.abs(shifted[np.minimum(at, len(shifted) - 1)] - wanted), np.abs(shifted[np.maximum(at - 1, 0)] - wanted))

    def _search(self, plan: Plan) -> set[int]:
        """Places of the documents that hold a passage of the item."""
        item = plan.item.words
        parts = []
        for p, beside, most in plan.anchors:
            diagonals = self.list_of(item[p]).astype(np.int64) - p
            if len(diagonals) and beside:
                diagonals = diagonals[np.any([self._off(item[q], q, diagonals) <= most for q in beside], axis=0)]
            parts.append(diagonals)
        diagonals = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        found: set[int] = set()
        if not len(diagonals):
            return found
        off = np.stack([self._off(term, i, diagonals) for i, term in enumerate(item)])
        for length, most in plan.lengths:
            counts = np.cumsum(np.pad(off <= most, ((1, 0), (0, 0))), axis=0, dtype=np.int32)
            inside = counts[length:] - counts[:-length] >= length - most
            for k in np.flatnonzero(inside.any(axis=0)).tolist():
                starts = np.flatnonzero(inside[:, k])
                # the document of a passage is that of its window's middle
                docs = np.searchsorted(self.bounds, diagonals[k] + starts + length // 2, side="right") - 1
                for doc in set(docs.tolist()) - found:
                    if self._verified(item, starts[docs == doc].tolist(), length, most, int(diagonals[k])):
                        found.add(doc)
        return found

    def _verified(self, item: tuple[int, ...], starts: list[int], length: int, most: int, diagonal: int) -> bool:
        """Whether one of the item's windows occurs near the diagonal within the allowed edits."""
        for start in starts:
            at = diagonal + start - most
            near = self.terms[max(0, at) : max(0, at + length + 3 * most)].tolist()
            if edits_within(item[start : start + length], near, most):
                return True
        return False


def stored_index(documents: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """The index of all documents as a written table of segments, one per batch of documents."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)  # of the items, bounded in leaked()
    names = [f.split()[0] for f in _SEGMENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            s = Segment.of(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shared.value)
            columns = [(s.docs, pa.int64()), (s.bounds, pa.int32()), (s.starts, pa.int32()), (s.postings, pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(values)], type=pa.int32()), pa.array(values, type=kind)) for values, kind in columns], names=names)

    return materialise(spread(documents.select(F.col("doc_id").cast("long"), "text"), "doc_id").mapInArrow(run, _SEGMENT), "postings")


def leaked(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id) for documents with at least 20 consecutive words of an item (or all of a shorter item), where
    one word in eight may be replaced, dropped or added.

    Texts are read whole where they are stored. Null and empty texts, keys and items give no rows; equal texts under
    different keys each give theirs; a text delivered twice gives its rows once. Extra columns are ignored.
    """
    rows = [(r[0], r[1]) for r in benchmark.select("item_id", "text").collect()]  # a fixed table, bounded below
    items, vocabulary = prepared(rows)
    if sum(len(i.words) for i in items) > MOST_ITEM_WORDS:
        raise ValueError("too many test items to send to every segment; search them in parts")
    index = stored_index(documents, vocabulary)
    # occurrences of each term in the whole corpus: as many numbers as the items have terms
    lists = F.transform(F.sequence(F.lit(1), F.size("starts") - 1), lambda i: F.get("starts", i) - F.get("starts", i - 1))
    counted = index.where(F.size("starts") > 1).select(F.posexplode(lists).alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    for term, n in counted:
        counts[term] = n
    shared = documents.sparkSession.sparkContext.broadcast(plans_of(items, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(*(batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in range(4)))
                pairs = segment.search(shared.value)
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], type=pa.int64()) for i in (0, 1)], names=["doc_id", "item_id"])

    return index.mapInArrow(run, "doc_id long, item_id long").distinct()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per item that leaked: in how many documents."""
    benchmark = table(spark, folder, "benchmark")
    counted = p8_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return counted.join(F.broadcast(benchmark.select("item_id", "suite")), "item_id")


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
SQL: dict[str, str] = {}
