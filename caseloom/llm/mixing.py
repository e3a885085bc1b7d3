"""Mixing sources to target weights by weighted sampling without replacement.

A source's target is a number of words.  Whole epochs of the source come first;
what is left of the target is drawn from one more epoch by Efraimidis-Spirakis
sampling: each document has the key ``-ln(u) / quality``, u a hash of its id,
and documents are taken in ascending order of the key until the words reach the
rest.  The document that crosses the border is taken if that comes closer.

No sort of a whole source happens.  Keys are mapped monotonically to slices of
the logarithm of the key, ``SLICES`` for a doubling, so that no slice holds more
than about 0.37 * ln(2) / SLICES of the documents of one quality, however low it
is.  Words are summed for each slice (on the map side first), and only the one
slice of a source where the border falls is put in order.  The plan of a source
then is a number of epochs and the greatest key taken: each row is decided by
its own key, and no row is looked up by its id.

Defined cases: a null text has size 0; documents of size 0 take 0 words; a null
source is a source of its own, the last one; null ids take part, told apart by
their texts; rows that repeat an id, source and text have one key and are drawn
together; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.llm import kernels as K
from caseloom.llm.frames import broadcast_if_few, checkpoint, cores, only

SLICES = 1024
WEIGHTS, SHARE, LIMIT = (5.0, 2.0, 1.0), 1.5, 2.0


def _measured(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Size and quality of each text.

    Quality is the share of letters among the bytes that are not white space,
    times the share of distinct words (both at least a tenth).
    """
    data, offsets = K.text_buffers(texts)
    start, end, counts = K.word_spans(data, offsets)
    h = K.word_hashes(data, start, end)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, owner))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=len(counts))
    letters = np.zeros(len(counts), np.int64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        letters[some] = np.add.reduceat(_LETTER[data], offsets[:-1][some], dtype=np.int64)
    size = np.bincount(owner, weights=(end - start).astype(float), minlength=len(counts))
    quality = np.maximum(letters / np.maximum(size, 1), 0.1) * np.maximum(distinct / np.maximum(counts, 1), 0.1)
    return counts.astype(np.int64), quality


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _measurer(text: int, names: list[str]):
    """Batches with their first columns under ``names`` and the size and quality of the text in column ``text`` as the last two."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.parts(batches, text):
            size, quality = _measured(batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 2], pa.array(size), pa.array(quality)], names=names)

    return measure


def _key(seed: int, doc_id: Column, source: Column, text_hash: Column, quality: Column) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, source, text_hash), 11) + 0.5) / F.lit(float(1 << 53))
    return -F.log(unit) / quality


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size) -> with target; one row a source.

    Sources by code point, null last, weigh ``weights`` in turn.  Resharing the
    excess by weight until no target is above its limit has one fixed point:
    target = min(limit * size, level * weight).  Sorted by limit * size /
    weight, the level follows from the first source that is not at its limit.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights))) + 1)
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * limit).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = W.orderBy("ratio", "source").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("ratio", "source").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(every) * share).withColumn("below", F.coalesce(F.sum("cap").over(up), F.lit(0.0))).withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
    s = s.withColumn("here", (F.col("total") - F.col("below")) / F.col("open"))
    s = s.withColumn("level", F.min(F.when(F.col("here") <= F.col("ratio"), F.struct("ratio", "source", "here"))).over(every)["here"])
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def keyed(docs: DataFrame, text_col: str, id_col: str, source_col: str, seed: int) -> DataFrame:
    """doc_id, source, size, quality, key of every row."""
    base = only(docs, doc_id=id_col, source=source_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string"))
    sized = base.mapInArrow(_measurer(3, ["doc_id", "source", "h", "size", "quality"]), "doc_id long, source string, h long, size long, quality double")
    return sized.select("doc_id", "source", "size", "quality", _key(seed, F.col("doc_id"), F.col("source"), F.col("h"), F.col("quality")).alias("key"))


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Of the keyed ``rows``, one row a source: source, source_size, target, epochs and cut, the greatest key of the last epoch's draw."""
    sliced = rows.withColumn("slice", F.floor(F.log2("key") * SLICES).cast("int"))
    slices = checkpoint(sliced.groupBy("source", "slice").agg(F.sum("size").alias("words")), cores(rows))
    aims = targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, limit)
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    aims = checkpoint(aims, cores(rows))
    running = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = slices.withColumn("upto", F.sum("words").over(running)).withColumn("before", F.col("upto") - F.col("words"))
    same = F.col("source").eqNullSafe(F.col("s"))
    rest = aims.select(F.col("source").alias("s"), "rest")
    edge = upto.join(rest, same).filter("upto >= rest").groupBy("source").agg(F.min(F.struct("slice", "before", "rest")).alias("edge")).select(F.col("source").alias("s"), "edge.*")
    border = sliced.join(broadcast_if_few(edge.withColumnRenamed("slice", "edge")), same & (F.col("slice") == F.col("edge")))
    # Rows of one key are drawn together, so they are summed before they are put in order.
    border = border.groupBy("source", "key", "before", "rest").agg(F.sum("size").alias("size"))
    up = W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow)
    over = F.col("upto") - F.col("rest")
    border = border.withColumn("upto", F.sum("size").over(up) + F.col("before")).filter((over <= 0) | ((F.col("size") - over > 0) & (over <= F.col("size") - over)))
    cut = border.groupBy("source").agg(F.max("key").alias("last")).select(F.col("source").alias("c"), "last")
    met = aims.join(edge.select("s", "slice"), same, "left").drop("s").join(cut, F.col("source").eqNullSafe(F.col("c")), "left").drop("c")
    # Without a border everything is drawn; a border slice that takes nothing ends at its lower edge.
    before_slice = F.pow(F.lit(2.0), F.col("slice") / F.lit(float(SLICES))) * F.lit(1 - 1e-12)
    last = F.when(F.col("slice").isNull(), F.lit(float("inf"))).otherwise(F.coalesce("last", before_slice))
    return checkpoint(met.select("source", "source_size", "target", "epochs", F.when(F.col("rest") > 0, last).otherwise(F.lit(-1.0)).alias("cut")), cores(rows))


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 17, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), quality, key."""
    rows = checkpoint(keyed(docs, text_col, id_col, source_col, seed))
    of = broadcast_if_few(plan(rows, weights, share, limit).withColumnRenamed("source", "s"))
    met = rows.join(of, F.col("source").eqNullSafe(F.col("s")), "left")
    taken = F.col("size") * (F.col("epochs") + (F.col("key") <= F.col("cut")).cast("int"))
    return met.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "quality", "key")


def mixed_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 17, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it; rows not taken are gone.

    Documents without words have nothing to take and stay once.  Each row is
    measured once more where it lies, so that texts are neither moved nor looked up.
    """
    rows = checkpoint(keyed(docs, text_col, id_col, source_col, seed))
    of = broadcast_if_few(plan(rows, weights, share, limit).select(F.col("source").alias("__of"), "epochs", "cut"))
    names = [f"__{i}" for i in range(len(docs.columns))]
    doc, source, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, source_col, text_col))
    plain = docs.toDF(*names)
    schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes) + ", __size long, __quality double"
    sized = plain.mapInArrow(_measurer(docs.columns.index(text_col), [*names, "__size", "__quality"]), schema)
    key = _key(seed, doc.cast("long"), source.cast("string"), F.xxhash64(text.cast("string")), F.col("__quality"))
    met = sized.withColumn("__key", key).join(of, source.cast("string").eqNullSafe(F.col("__of")), "left")
    times = F.when(F.col("__size") == 0, 1).otherwise((F.col("epochs") + (F.col("__key") <= F.col("cut")).cast("int")).cast("int"))
    copies = met.withColumn("__times", times).filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return copies.select(*names).toDF(*docs.columns)
