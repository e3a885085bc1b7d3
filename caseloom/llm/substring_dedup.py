"""Substring deduplication: repeated fixed-length token windows become removal spans.

Rabin-Karp hashes of every window of ``window`` words are counted over the whole
corpus.  Windows that start more than once are repeated; their words merge into
maximal spans.  Counting goes in two rounds over blocks of documents:

1. Documents are dealt to blocks by a hash of their id.  Each block sends its
   *distinct* window hashes, sorted and as byte planes, to ranges of the hash
   space, so a window that a third of all documents hold is sent once a block.
2. Each range marks the hashes that a block repeats or several blocks hold, and
   returns one bit a hash.  The block, which Spark still has in the same
   exchange, turns its bits into spans.

Windows are identified by a Rabin-Karp value modulo the prime 2**61 - 1; with n
windows about n*n/2**62 pairs of different windows would be taken for equal.

Defined cases: a null text is an empty one; texts shorter than a window keep
every word; repeated rows repeat their windows; null ids take part; no rows
give no rows; other columns are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseloom.llm import kernels as K
from caseloom.llm.frames import blocks_for, only, spread

WINDOW = 35

_SENT = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary()), ("flags", pa.binary())])


def _windows(table: pa.Table, window: int):
    data, offsets = K.text_buffers(table.column("text"))
    start, end, counts = K.word_spans(data, offsets)
    at = K.window_starts(counts, window)
    hashes = K.rolling(K.word_hashes(data, start, end), window)[at] if len(at) else np.zeros(0, np.uint64)
    return data, offsets, start, end, counts, at, hashes


def _sender(window: int, buckets: int):
    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hashes = _windows(table, window)[-1]
        distinct, times = np.unique(hashes, return_counts=True)
        bounds = K.bucket_bounds(distinct, buckets)
        block, rows = key[0].as_py(), []
        for bucket, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if b > a:
                rows.append((block, bucket, K.pack_sorted(distinct[a:b]), np.packbits(times[a:b] > 1).tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _SENT, strict=True)], schema=_SENT)

    return send


def _count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of one range: a bit for every hash of every block that sent some."""
    keys = [K.unpack_sorted(b) for b in table.column("data").to_pylist()]
    own = [np.unpackbits(np.frombuffer(f, np.uint8), count=len(k)).astype(bool) for f, k in zip(table.column("flags").to_pylist(), keys, strict=True)]
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    twin = np.zeros(len(flat), bool)
    same = ranked[1:] == ranked[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    repeated = np.empty(len(flat), bool)
    repeated[order] = twin
    repeated |= np.concatenate(own)
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    marks = [np.packbits(x).tobytes() for x in np.split(repeated, cuts)]
    sizes = pa.array([len(k).to_bytes(8, "little") for k in keys], pa.binary())
    return pa.table([table.column("block").cast(pa.int32()), table.column("bucket").cast(pa.int32()), pa.array(marks, pa.binary()), sizes], schema=_SENT)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept_text", pa.string())])


def _cleaner(window: int):
    def clean(key: tuple[pa.Scalar, ...], docs: pa.Table, marks: pa.Table) -> pa.Table:
        data, offsets, _, _, counts, at, hashes = _windows(docs, window)
        gone = np.zeros(int(counts.sum()), bool)
        if len(hashes):
            sent = sorted(zip(marks.column("bucket").to_pylist(), marks.column("data").to_pylist(), marks.column("flags").to_pylist(), strict=True))
            bits = np.concatenate([np.unpackbits(np.frombuffer(d, np.uint8), count=int.from_bytes(n, "little")) for _, d, n in sent]).astype(bool)
            distinct, place = np.unique(hashes, return_inverse=True)
            if len(bits) != len(distinct):
                raise ValueError("a block's marks do not fit its windows")
            first = at[bits[place]]
            cover = np.bincount(first, minlength=len(gone) + window + 1)[: len(gone) + window + 1] - np.bincount(first + window, minlength=len(gone) + window + 1)[: len(gone) + window + 1]
            gone = np.cumsum(cover)[: len(gone)] > 0
        ends = np.cumsum(counts)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.concatenate([[0], ends])])
        spans, kept, view = [], [], memoryview(data)
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            words = bytes(view[a:b]).split()
            if removed[i]:
                mine = gone[ends[i] - counts[i] : ends[i]]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                runs = edge.reshape(-1, 2).tolist()
                spans.append([{"start": s, "end": e} for s, e in runs])
                left, last = [], 0
                for s, e in runs:
                    left += words[last:s]
                    last = e
                words = left + words[last:]
            else:
                spans.append([])
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        return pa.table([docs.column("doc_id").cast(pa.int64()), pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(spans, _OUT.field("spans").type), pa.array(kept, pa.string())], schema=_OUT)

    return clean


def remove_repeated_windows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, spans (of word indices, end exclusive) and kept_text of every row."""
    base = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = blocks_for(base, block_bytes)
    dealt = base.select(spread("doc_id", "text", n).alias("block"), "doc_id", "text")
    sent = dealt.groupBy("block").applyInArrow(_sender(window, n), "block int, bucket int, data binary, flags binary")
    marks = sent.groupBy("bucket").applyInArrow(_count, "block int, bucket int, data binary, flags binary")
    return dealt.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_cleaner(window), "doc_id long, n_words long, n_removed long, spans array<struct<start: int, end: int>>, kept_text string")
