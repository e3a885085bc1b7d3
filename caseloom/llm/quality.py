"""Quality by nearest-neighbour voting over latent-semantic vectors.

A document becomes a hashed term vector: words, and for each word its shape
(first and last byte class, capitals, length, whether it repeats an earlier
word).  Weighted by log term frequency and inverse document frequency, the
vectors of at most ``FIT_ROWS`` labelled documents (and ``FIT_BYTES`` of their
texts, see toxicity) of each class give a truncated singular value decomposition.  The labelled latent vectors (their
number is bounded, so a broadcast is) meet every document in exact blocked
cosine products; the ``NEIGHBOURS`` nearest vote with their similarity, each
class weighted back to its share of the labels.

Defined cases: a null or empty text has a zero vector and the share of good
labels as its score; null ids are scored; labels that are null are not learnt
from; without any labels the score is 0; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseloom.llm import kernels as K
from caseloom.llm.frames import only
from caseloom.llm.toxicity import FIT_BYTES, held_out, labelled_sample

WORDS, SHAPES = 1024, 512
RANK, NEIGHBOURS, FIT_ROWS, BLOCK = 48, 20, 1500, 256
SHARPNESS = 4
THRESHOLD = 0.3

_CLASS = np.full(256, 4, np.int64)  # other signs
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[128:] = 3
_CLASS[list(b".,;:")] = 5
_CLASS[list(b"!?")] = 6


def term_counts(texts: pa.Array) -> np.ndarray:
    """Term counts, one row a text."""
    data, offsets = K.text_buffers(texts)
    start, end, counts = K.word_spans(data, offsets)
    width, n = WORDS + SHAPES, len(counts)
    if not len(start):
        return np.zeros((n, width), np.float32)
    owner = np.repeat(np.arange(n), counts)
    h = K.word_hashes(data, start, end, lower=True)
    repeats = np.zeros(len(h), np.int64)
    repeats[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((h, owner))
    seen = np.zeros(len(h), np.int64)
    seen[order[1:]] = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    capitals = np.minimum(upper[end] - upper[start], 2)
    before_last = np.maximum(end - 2, start)
    shape = (((_CLASS[data[start]] * 7 + _CLASS[data[end - 1]]) * 7 + _CLASS[data[before_last]]) * 3 + capitals) * 4 + repeats * 2 + seen
    length = np.minimum(np.log2(end - start).astype(np.int64), 6)
    slot = WORDS + (K.mix((shape * 7 + length).astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)
    word = (h % np.uint64(WORDS)).astype(np.int64)
    flat = np.bincount(np.concatenate([owner * width + word, owner * width + slot]), minlength=n * width)
    return flat.reshape(n, width).astype(np.float32)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    x = np.log1p(counts * (1000 / total)) * idf  # the share of each term, so that length does not matter
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(sample: list[tuple[int, str, int, float]]) -> dict:
    """Projection, labelled latent vectors, their labels and class weights; {} without labels."""
    if not sample:
        return {}
    texts = [r[1] for r in sample]
    counts = np.concatenate([term_counts(pa.array(texts[i : i + BLOCK], pa.large_string())) for i in range(0, len(texts), BLOCK)])
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + np.float32(0.2)
    x = _weighted(counts, idf)
    _, vectors = np.linalg.eigh(x.T @ x)
    basis = np.ascontiguousarray(vectors[:, ::-1][:, :RANK]).astype(np.float32)
    latent = x @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    y, w = np.array([r[2] for r in sample], np.float32), np.array([r[3] for r in sample], np.float32)
    return {"idf": idf, "basis": basis, "vectors": latent.astype(np.float32), "y": y, "w": w, "prior": float((y * w).sum() / w.sum())}


def latent_vectors(model: dict, texts: pa.Array) -> np.ndarray:
    z = _weighted(term_counts(texts), model["idf"]) @ model["basis"]
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)


def vote(model: dict, texts: pa.Array) -> np.ndarray:
    z = latent_vectors(model, texts)
    near = z @ model["vectors"].T
    k = min(NEIGHBOURS, near.shape[1])
    top = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
    pull = np.maximum(np.take_along_axis(near, top, 1), 0) ** SHARPNESS * model["w"][top]
    total = pull.sum(1)
    return np.where(total > 0, (pull * model["y"][top]).sum(1) / np.maximum(total, 1e-12), model["prior"])


def scorer(model: dict):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.parts(batches, 1):
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                got = vote(model, part.column(1)) if model else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got.astype(float))], names=["doc_id", "score"])

    return score


def quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", parts: int = 5, part: int = 0, rows: int = FIT_ROWS, threshold: float = THRESHOLD, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    base = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = fit(labelled_sample(base, labels, "quality", parts, part, rows, fit_bytes))
    scored = base.mapInArrow(scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
