"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A document holds a test item if the local alignment of their words (match +2,
mismatch -1, gap -1) reaches ``THRESHOLD`` of the item's best possible score, so
edited and paraphrased copies are found.  With a threshold of one half:

*Seeds.*  Such an alignment matches at least half of the item's n words, and
spans at most 2n words of the document.  Of any n/2 + j word places of the item
at least j are then matched.  The seeds are the n/2 + j rarest places (unigrams:
edits can break every longer n-gram), rare by the number of documents that hold
the word, counted over the whole corpus, times the number of items that do.  A
passage opens where j seeds lie within 2n words, so no alignment above the
threshold can be missed; common words never open one.

*Confirmation.*  Within an opened passage, words of the item of any kind are
counted: n/2 must lie within 2n words, and the longest common subsequence must
have n/2.

*Alignment.*  What is left is aligned word by word, and the share of the item's
best possible score is the document's score for it.

The test items are a query set: they are taken in slices of at most
``SLICE_SEEDS`` seeds, so what each task holds is bounded however large the
benchmark is, and every document meets every slice.

Defined cases: null texts are empty and match nothing; items without words match nothing; repeated items and
documents match each on their own; null ids are kept; no rows on either side
give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseloom.llm import kernels as K
from caseloom.llm.frames import only, without

SLICE_SEEDS = 1 << 20
#: Of an item of n words, n / EXTRA seeds must lie together to open a passage.
EXTRA = 6
#: Hits of seeds that a task holds at a time.
HITS = 1 << 21
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the item's best possible score from which a document counts as contaminated.
THRESHOLD = 0.5


def _words(column: pa.Array):
    data, offsets = K.text_buffers(column)
    start, end, counts = K.word_spans(data, offsets)
    return K.word_hashes(data, start, end, lower=True), counts


def least_matches(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many words of an item of n an alignment at the threshold matches at least: each scores MATCH, nothing else adds."""
    return np.ceil(threshold * n - 1e-9).astype(np.int64)


class Items:
    """A slice of the test items: their words, the distinct ones in order, and the items that hold each."""

    def __init__(self, ids: list, texts: list[str]):
        words, counts = _words(pa.array(texts, pa.large_string()))
        ends = np.cumsum(counts)
        self.ids, self.counts = ids, counts
        self.words = [words[e - c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
        self.all = words
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.distinct, self.slot = np.unique(words, return_inverse=True)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.distinct & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def known(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, slot of the word) of the words that some item holds."""
        at = np.flatnonzero(self.maybe[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(self.distinct):
            return at[:0], at[:0]
        slot = np.minimum(np.searchsorted(self.distinct, words[at]), len(self.distinct) - 1)
        real = self.distinct[slot] == words[at]
        return at[real], slot[real]

    def seed(self, docs_with: np.ndarray, threshold: float) -> None:
        """Choose the seeds: the rarest places of every item."""
        per_item = np.unique(self.owner * max(1, len(self.distinct)) + self.slot)
        items_with = np.bincount(per_item % max(1, len(self.distinct)), minlength=len(self.distinct))
        cost = (docs_with + 1.0) * items_with
        self.least = least_matches(self.counts, threshold)
        self.span = np.ceil(self.counts * (3 - 2 * threshold)).astype(np.int64)  # words of a document that such an alignment can span
        self.open = np.maximum(1, np.minimum(self.counts // EXTRA, self.least))
        order = np.lexsort((self.slot, cost[self.slot], self.owner))
        place = np.arange(len(order)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        rare = order[place < np.repeat(self.counts - self.least + self.open, self.counts)]
        pairs = np.unique(self.slot[rare] * len(self.counts) + self.owner[rare])
        slots, self.item_of = pairs // max(1, len(self.counts)), pairs % max(1, len(self.counts))
        self.first = np.searchsorted(slots, np.arange(len(self.distinct) + 1))


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, first and last-plus-one word of the document's part), anti-diagonal free.

    A row is one document word.  Within a row the gap along the item is a running
    maximum, so each row is a few array operations.
    """
    n = len(item)
    step = np.arange(n + 1) * -GAP
    score, begin = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    best = (0, 0, 0)
    for r, word in enumerate(doc):
        up, diagonal = score + GAP, np.full(n + 1, -1 << 30)
        diagonal[1:] = score[:-1] + np.where(item == word, MATCH, MISMATCH)
        here = np.maximum(np.maximum(up, diagonal), 0)
        start = np.where(here == 0, r + 1, np.where(diagonal >= up, np.concatenate([[r], np.where(score[:-1] == 0, r, begin[:-1])]), begin))
        lifted = np.maximum.accumulate(here + step)
        source = np.maximum.accumulate(np.where(here + step == lifted, np.arange(n + 1), 0))
        score, begin = lifted - step, start[source]
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(begin[top]), r + 1)
    return best


def _counter(items: Items):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that hold each word of the items."""
        total = np.zeros(len(items.distinct), np.int64)
        for batch in K.parts(batches, 0):
            words, counts = _words(batch.column(0))
            at, slot = items.known(words)
            owner = np.searchsorted(np.cumsum(counts), at, "right")
            pairs = np.unique(owner * max(1, len(total)) + slot)
            total += np.bincount(pairs % max(1, len(total)), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["word", "n"])

    return count


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])


def _openings(items: Items, at: np.ndarray, slot: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, item, first and last word) of places where enough seeds of an item lie together.

    ``at`` are ascending places of known words.  They are taken in stretches of at most ``HITS`` hits, which overlap by what a passage spans.
    """
    times = items.first[slot + 1] - items.first[slot]
    some = times > 0
    at, slot, doc, times = at[some], slot[some], doc[some], times[some]
    upto = np.cumsum(times)
    reach = int(items.span.max(initial=0))
    low = 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + HITS, "right")))
        back = int(np.searchsorted(at, at[low] - reach)) if low else 0
        mine = slice(back, high)
        n = times[mine]
        item = items.item_of[np.repeat(items.first[slot[mine]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        d, where = np.repeat(doc[mine], n), np.repeat(at[mine], n)
        order = np.lexsort((where, item, d))
        item, d, where = item[order], d[order], where[order]
        need, span = items.open[item], items.span[item]
        last = np.arange(len(item)) + need - 1
        inside = np.flatnonzero(last < len(item))
        end = last[inside]
        good = inside[(item[end] == item[inside]) & (d[end] == d[inside]) & (where[end] - where[inside] < span[inside])]
        yield d[good], item[good], where[good], where[last[good]]
        low = high


def _finder(items: Items, threshold: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.parts(batches, 1):
            words, counts = _words(batch.column(1))
            ids, ends = batch.column(0).to_pylist(), np.cumsum(counts)
            at, slot = items.known(words)
            best: dict[tuple[int, int], tuple] = {}
            for d, i, low, high in _openings(items, at, slot, np.searchsorted(ends, at, "right")):
                for doc, item, a, b in _passages_of(d, i, low, high, items.span, ends, counts):
                    base = int(ends[doc] - counts[doc])
                    for score, x, y in _aligned(words[a:b], items.words[item], int(items.least[item]), int(items.span[item])):
                        share = score / (MATCH * int(items.counts[item]))
                        if share >= threshold and share > best.get((doc, item), (0,))[0]:
                            best[doc, item] = (share, a - base + x, a - base + y)
            rows = [(ids[d], items.ids[i], s, a, b) for (d, i), (s, a, b) in sorted(best.items())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, _OUT.types, strict=True)], schema=_OUT)

    return find


def _passages_of(doc: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, spans: np.ndarray, ends: np.ndarray, counts: np.ndarray):
    """Openings of one document and item that reach into each other, as (document, item, first word, end) with room on both sides."""
    if not len(doc):
        return
    room = spans[item]
    begin, end = np.maximum(low - room, (ends - counts)[doc]), np.minimum(high + room + 1, ends[doc])
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > end[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    yield from zip(doc[first].tolist(), item[first].tolist(), begin[first].tolist(), end[last].tolist(), strict=True)


def common_subsequence(doc: list[int], item: list[int]) -> int:
    """Length of the longest common subsequence, which an alignment's matches cannot exceed: a bit a word of the item."""
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    whole = free = (1 << len(item)) - 1
    for w in doc:
        met = free & places.get(w, 0)
        free = ((free + met) | (free - met)) & whole
    return len(item) - free.bit_count()


def _aligned(doc: np.ndarray, item: np.ndarray, least: int, span: int):
    """Alignments of the parts of a passage where enough words of the item lie together."""
    held = np.flatnonzero(np.isin(doc, item))
    if len(held) < least:
        return
    near = np.flatnonzero(held[least - 1 :] - held[: len(held) - least + 1] < span)
    low = 0
    while low < len(near):  # each run of such places with room for an alignment around them
        high = low
        while high + 1 < len(near) and held[near[high + 1]] - held[near[high] + least - 1] <= span:
            high += 1
        a, b = max(0, int(held[near[low]]) - span), int(held[near[high] + least - 1]) + span + 1
        inside = held[np.searchsorted(held, a) : np.searchsorted(held, b)]
        if common_subsequence(doc[inside].tolist(), item.tolist()) >= least:
            for score, x, y in _passages(doc[a:b], item, span):
                yield score, a + x, a + y
        low = high + 1


def _passages(doc: np.ndarray, item: np.ndarray, reach: int):
    """The alignment of a passage; pieces of a very long one overlap by what an alignment can span."""
    step = max(2048, 8 * len(item))
    for at in range(0, max(1, len(doc) - reach), step):
        score, a, b = align(doc[at : at + step + reach], item)
        if score:
            yield score, at + a, at + b


def _finders(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, threshold: float) -> Iterator:
    """The finder of each slice of the items, its seeds chosen by all of ``docs``."""
    texts_of = only(docs, text=text_col).select(F.col("text").cast("string"))
    tests = only(benchmark, item_id=item_col, text="text").select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for ids, texts in _slices(tests):
        items = Items(ids, texts)
        seen = texts_of.mapInArrow(_counter(items), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        docs_with = np.zeros(len(items.distinct))
        for r in seen.collect():  # at most SLICE_SEEDS numbers
            docs_with[r["word"]] = r["n"]
        items.seed(docs_with, threshold)
        yield _finder(items, threshold)


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score and the passage (words, end exclusive) of every document and item that align."""
    base = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for find in _finders(docs, benchmark, text_col, item_col, threshold):
        part = base.mapInArrow(find, "doc_id long, item_id long, score double, start long, end long")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else base.filter("false").mapInArrow(lambda b: iter(()), "doc_id long, item_id long, score double, start long, end long")


def _slices(tests: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """The items in slices of a bounded number of seeds, read one at a time and never all together."""
    ids: list = []
    texts: list[str] = []
    seeds = 0
    for row in tests.orderBy("item_id", "text").toLocalIterator():
        n = len(row["text"].split()) + 1
        if ids and seeds + n > SLICE_SEEDS:
            yield ids, texts
            ids, texts, seeds = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        seeds += n
    if ids:
        yield ids, texts


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item, each by its own text."""
    kept = docs
    for find in _finders(docs, benchmark, text_col, item_col, threshold):
        kept = without(kept, text_col, lambda batches, find=find: (out.column(0).to_numpy() for out in find(batches)))
    return kept
