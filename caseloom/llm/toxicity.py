"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a logistic score over
hashed words and word beginnings; a document is toxic if any sentence is
(noisy-or): P = 1 - prod(1 - p_s).  Only document labels are known; gradient
descent on the bag likelihood finds which sentences must be to blame, so the
fitted model also locates the offending sentences.  Only terms that the labels
prove have a weight: with one for every term, descent fits the few toxic
documents by chance words and the words that tell lose theirs.

Fitting reads at most ``FIT_ROWS`` labelled documents of each class, the first
ones in the order of a hash of their ids, up to ``FIT_BYTES`` of text in all
(texts above a sixteenth of that come last, and a class with labels gives one
text at least); scoring covers every document.

Defined cases: a null or empty text has no sentence and the score 0; null ids
are scored; labels that are null are not learnt from, of several labels of one
id the greatest counts; without labels of both classes every score is 0; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.llm import kernels as K
from caseloom.llm.frames import only, without

BITS = 18
#: Besides itself, a word has the features of its beginnings of these lengths in bytes.
HEADS = (4, 5)
FIT_ROWS = 1000
#: Bytes of the texts of one class that the driver fits on (or one text).
FIT_BYTES = 16 << 20
ROUNDS, RATE, SHRINK, BIAS = 60, 0.1, 1e-4, -6.0
THRESHOLD = 0.3

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_TRIM = np.zeros(256, bool)
_TRIM[list(b".,;:!?\"'()[]")] = True


def held_out(id_col: str | Column, parts: int, part: int) -> Column:
    """Whether the id's CRC-32, as text, falls into the part that labels are never learnt from."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(c.cast("string")), F.lit(parts)) == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, rows: int, size: int = FIT_BYTES) -> list[tuple[int, str, int, float]]:
    """At most ``rows`` training documents of each class and ``size`` bytes of their texts: (id, text, label, weight of its class).

    The weight is how many training labels of the class each sampled one stands for.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label")).filter(~held_out("doc_id", parts, part))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("label in (0, 1)").collect()}
    picked = None
    place = F.xxhash64(F.lit(7), "doc_id")
    for value in (0, 1):
        some = known.filter(F.col("label") == value).orderBy(place, "doc_id").limit(rows)
        picked = some if picked is None else picked.unionByName(some)
    met = docs.join(F.broadcast(picked.select(F.col("doc_id").alias("__id"), "label")), F.col("doc_id") == F.col("__id"))  # at most 2 * rows ids
    texts = met.groupBy("doc_id").agg(F.first("text").alias("text"), F.first("label").alias("label")).withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    large = F.col("bytes") > size // 16
    order = W.partitionBy("label").orderBy(large, F.when(large, F.col("bytes")), place, "doc_id")
    got = texts.withColumn("total", F.sum("bytes").over(order)).withColumn("at", F.row_number().over(order)).filter((F.col("total") <= size) | (F.col("at") == 1)).collect()
    weight = {v: counts.get(v, 0) / max(1, sum(r["label"] == v for r in got)) for v in (0, 1)}
    return sorted((r["doc_id"], r["text"] or "", r["label"], weight[r["label"]]) for r in got)


def instances(texts: pa.Array):
    """Sentences of a column of texts: (features of each word; first word and document of each sentence; number of documents; byte spans)."""
    data, offsets = K.text_buffers(texts)
    start, end, counts = K.word_spans(data, offsets)
    n = len(start)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros((0, 1 + len(HEADS)), np.int32), z, z, len(counts), z, z, data, offsets
    owner = np.repeat(np.arange(len(counts)), counts)
    padded = np.append(data, np.uint8(32))
    closes = _ENDS[data[end - 1]] | (padded[end] == 10)
    opens = np.ones(n, bool)
    opens[1:] = closes[:-1] | (owner[1:] != owner[:-1])
    first = np.flatnonzero(opens)
    s = start + (_TRIM[data[start]] & (end - start > 1))
    e = np.maximum(end - _TRIM[data[end - 1]], s + 1)
    mask = np.uint64((1 << BITS) - 1)
    whole = K.word_hashes(data, s, e, lower=True)
    columns = [whole & mask]
    for size in HEADS:
        head = K.word_hashes(data, s, np.minimum(e, s + size), lower=True)
        columns.append((head ^ np.uint64(0x5BD1E995 * size)) & mask)
    features = np.stack(columns, axis=1).astype(np.int32)
    last = np.append(first[1:], n) - 1
    return features, first, owner[first], len(counts), start[first], end[last], data, offsets


def proven_terms(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Which terms are more frequent in toxic documents than chance gives among so many terms.

    The log-likelihood ratio of a term's documents against the share of the whole
    sample must reach the logarithm of the number of terms: less than one passes by chance.
    """
    total = good + bad
    share = bad.sum() / max(1, total.sum())
    part = bad / np.maximum(total, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(bad > 0, bad * np.log(part / share), 0) + np.where(good > 0, good * np.log((1 - part) / (1 - share)), 0)
    return (part > share) & (gain >= np.log(max(2, (total > 0).sum())))


def blamed(value: np.ndarray, bias: float) -> np.ndarray:
    """Scores of sentences; without a proven term one has none, so length alone makes no document toxic."""
    return np.where(value > 0, value + bias, -np.inf)


def fit(sample: list[tuple[int, str, int, float]]) -> dict:
    """Bag likelihood by Adam over the weights of the proven terms; {} when a class is missing."""
    y = np.array([r[2] for r in sample], float)
    if not len(y) or y.min() == y.max():
        return {}
    weight = np.array([r[3] for r in sample])
    weight /= weight.mean()
    features, first, owner, n, *_ = instances(pa.array([r[1] for r in sample], pa.large_string()))
    size = 1 << BITS
    lengths = np.diff(np.append(first, len(features)))
    bag = np.repeat(owner, lengths)
    width = features.shape[1]
    pairs = np.unique(np.repeat(bag, width) * size + features.ravel())
    of, term = pairs // size, pairs % size
    good, bad = np.bincount(term[y[of] == 0], minlength=size), np.bincount(term[y[of] == 1], minlength=size)
    del pairs, of, term, bag
    proven = proven_terms(good, bad)
    # Start from the shrunk log odds of each term's documents; descent then moves the blame to sentences.
    odds = np.log((bad + 1) / (y.sum() + 2)) - np.log((good + 1) / (len(y) - y.sum() + 2))
    slot = np.full(size, -1, np.int32)
    slot[proven] = np.arange(proven.sum())
    flat = slot[features.ravel()]
    keep = flat >= 0
    flat, sentence = flat[keep], np.repeat(np.arange(len(first), dtype=np.int32), lengths * width)[keep]
    del features, keep
    w, b = np.maximum(odds[proven], 0), BIAS
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, ROUNDS + 1):
        z = blamed(np.bincount(sentence, weights=w[flat], minlength=len(first)), b)
        p = np.exp(-np.logaddexp(0, -z))
        stay = np.bincount(owner, weights=np.logaddexp(0, z), minlength=n)  # -log prod(1 - p)
        blame = np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(stay, 60)), 1e-9), 1.0) * weight
        g = p * blame[owner] / n
        grad = np.bincount(flat, weights=g[sentence], minlength=len(w)) + SHRINK * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = RATE * (1 - step / (ROUNDS + 1))
        w = np.maximum(w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6), 0)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-6)
    weights = np.zeros(size, np.float32)
    weights[proven] = w
    return {"weights": weights, "bias": float(b)}


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("sentences", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])
OUT = "doc_id long, score double, sentences array<struct<start: int, end: int, score: double>>"


def scorer(model: dict, threshold: float = THRESHOLD):
    """Arrow batches (doc_id, text) -> doc_id, score and the offending sentences in code points."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.parts(batches, 1):
            features, first, owner, n, start, end, data, offsets = instances(batch.column(1))
            total, found = np.zeros(n), [[] for _ in range(n)]
            if model and len(first):
                value = model["weights"][features].sum(1)
                z = blamed(np.add.reduceat(value, first), model["bias"])
                p = np.exp(-np.logaddexp(0, -z))
                total = 1 - np.exp(-np.bincount(owner, weights=np.logaddexp(0, z), minlength=n))
                hot = np.flatnonzero(p >= threshold)
                for doc in np.unique(owner[hot]).tolist():
                    mine = hot[owner[hot] == doc] if len(hot) < 1000 else hot[np.searchsorted(owner[hot], doc) : np.searchsorted(owner[hot], doc, "right")]
                    points = np.cumsum((data[offsets[doc] : offsets[doc + 1]] & 0xC0) != 0x80)
                    found[doc] = [{"start": int(points[start[i] - offsets[doc]] - 1), "end": int(points[end[i] - offsets[doc] - 1]), "score": float(p[i])} for i in mine]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(found, _OUT.field("sentences").type)], schema=_OUT)

    return score


def toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", parts: int = 4, part: int = 2, rows: int = FIT_ROWS, threshold: float = THRESHOLD, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of every document."""
    base = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = fit(labelled_sample(base, labels, "toxic", parts, part, rows, fit_bytes))
    scored = base.mapInArrow(scorer(model, threshold), OUT)
    return scored.select("doc_id", held_out("doc_id", parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences")


def clean_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", parts: int = 4, part: int = 2, rows: int = FIT_ROWS, threshold: float = THRESHOLD, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic, each by its own text."""
    base = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    score = scorer(fit(labelled_sample(base, labels, "toxic", parts, part, rows, fit_bytes)), threshold)

    def toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for out in score(batches):
            yield out.column(0).to_numpy()[out.column(1).to_numpy() >= threshold]

    return without(docs, text_col, toxic)
