"""DataFrame helpers of the operators: column guards, sizes, checkpoints, rows as such."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caseloom.operators.checkpoints import checkpoint

#: Of the block exchange: bytes of input that a row of it stands for, and the least block.
ROW_BYTES, LEAST_BLOCK = 1 << 10, 4 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    checkpoint(spark.range(0))  # makes sure that there is one
    return posixpath.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"{name}-{uuid.uuid4().hex}")


def numbered(docs: DataFrame, column: str) -> DataFrame:
    """The rows with a number each, written, so that every later read finds the same numbers."""
    folder = shared_folder(docs.sparkSession, "rows")
    docs.withColumn(column, F.monotonically_increasing_id()).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def without(docs: DataFrame, text_col: str, gone: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> DataFrame:
    """The rows of ``docs``, all columns, but those that ``gone`` names by their places in batches (place, text).

    Each row is judged by its own text and needs no id.
    """
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = np.ones(batch.num_rows, bool)
            for places in gone(iter([pa.record_batch([pa.array(np.arange(batch.num_rows)), batch.column(at).cast(pa.large_string())], names=["doc_id", "text"])])):
                stays[places] = False
            yield batch.filter(pa.array(stays))

    return docs.mapInArrow(keep, docs.schema)


def cores(df: DataFrame) -> int:
    """One task each for the cores: enough files for a table that is much smaller than the texts."""
    return df.sparkSession.sparkContext.defaultParallelism


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate: file sizes for a scan, so nothing is read for it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def blocks_for(df: DataFrame, block_bytes: int | None = None, text_col: str = "text") -> int:
    """How many blocks keep each near ``block_bytes``; at least two for each shuffle partition.

    Operators that exchange a row for each pair of a block and a range leave it
    open: blocks then grow with the square root of the input, so that a row holds
    about ``ROW_BYTES`` of it however large it is (100 TB: 3 * 10**5 blocks of 300 MB).
    """
    size = estimated_bytes(df)
    if size >= 1 << 55:  # no estimate: the texts are measured
        size = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")) + 16)).first()[0] or 0
    block_bytes = block_bytes or max(LEAST_BLOCK, int((size * ROW_BYTES) ** 0.5))
    return int(max(2 * shuffle_partitions(df.sparkSession), -(-size // block_bytes)))


def spread(id_col: str, text_col: str, blocks: int) -> Column:
    """The block of a row by its id, or by its text if it has none, so that rows without id do not all share one."""
    return F.pmod(F.xxhash64(id_col, F.when(F.col(id_col).isNull(), F.xxhash64(text_col))), F.lit(blocks)).cast("int")


def broadcast_if_few(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """The rows, written, and marked for broadcast if their count is at most ``most``; else they are joined like any others."""
    rows = checkpoint(rows, cores(rows))
    return F.broadcast(rows) if rows.count() <= most else rows


def join_evenly(rows: DataFrame, table: DataFrame, keys: list[str], value: str, times: str, salt: str, hot: int) -> DataFrame:
    """``rows`` with the ``value`` that ``table`` (keys, value, times) has for their keys, null where it has none.

    Keys that more than ``hot`` rows have (``times``) come from a broadcast: there
    are at most as many as rows divided by ``hot``.  Their rows, and those with a
    null key, then go through the join of the others under a number of their own
    (``salt``), which spreads them and meets nothing.
    """
    few = F.broadcast(table.filter(F.col(times) > hot).select(*[F.col(k).alias(f"__hot_{k}") for k in keys], F.col(value).alias("__hot_value")))
    met = rows.join(few, [F.col(k) == F.col(f"__hot_{k}") for k in keys], "left").drop(*[f"__hot_{k}" for k in keys])
    known = F.col("__hot_value").isNotNull()
    for k in keys:
        known = known | F.col(k).isNull()
    met = met.withColumn("__known", known).withColumn("__at", F.when(known, F.xxhash64(salt)).otherwise(F.xxhash64(*keys)))
    cold = table.filter(F.col(times) <= hot).select(*[F.col(k).alias(f"__cold_{k}") for k in keys], F.col(value).alias("__cold_value"), F.lit(False).alias("__cold_known"), F.xxhash64(*keys).alias("__cold_at"))
    same = [F.col("__at") == F.col("__cold_at"), F.col("__known") == F.col("__cold_known"), *[F.col(k) == F.col(f"__cold_{k}") for k in keys]]
    out = met.join(cold, same, "left")
    return out.withColumn(value, F.coalesce("__hot_value", "__cold_value")).select(*rows.columns, value)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under new names; other columns, whatever they are called, are not carried."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])
