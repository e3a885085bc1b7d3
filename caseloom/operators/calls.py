"""Calls to a service for each row: answers that are there already are not asked for again, failures become rows."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from caseloom.functions.reports import content_key
from caseloom.functions.text import text

#: Tries of a call, seconds before the second one, the factor from try to try, and the longest wait.
TRIES, FIRST_WAIT, FACTOR, LONGEST_WAIT = 4, 1.0, 2.0, 60.0
ANSWER = "hash string, answer string, error string, tries int"


class GiveUp(Exception):
    """Raised by a call that another try cannot mend."""


def attempt(call: Callable[[str], str], request: str, tries: int, first_wait: float, factor: float, longest: float, sleep: Callable[[float], None], seed: str = "") -> tuple[str | None, str | None, int]:
    """(answer, error, tries): the call, again after growing, jittered waits while it raises."""
    jitter = random.Random(seed)
    for n in range(1, tries + 1):
        try:
            return call(request), None, n
        except GiveUp as e:
            return None, str(e) or type(e).__name__, n
        except Exception as e:  # noqa: BLE001 - any failure of the service is one of the row
            error = str(e) or type(e).__name__
        if n < tries:
            sleep(min(longest, first_wait * factor ** (n - 1)) * (0.5 + jitter.random() / 2))
    return None, error, tries


def answers(requests: DataFrame, call: Callable[[str], str], tries: int = TRIES, first_wait: float = FIRST_WAIT, factor: float = FACTOR, longest: float = LONGEST_WAIT, parallel: int | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(hash, answer, error, tries) of requests (hash, request), one call a row.

    ``parallel`` bounds how many tasks call at once.  Without rows nothing is called.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(h, *attempt(call, r, tries, first_wait, factor, longest, sleep, h)) for h, r in zip(pdf["hash"], pdf["request"], strict=True)], columns=["hash", "answer", "error", "tries"])

    rows = requests.select("hash", text("request").alias("request"))
    return (rows.repartition(parallel) if parallel else rows).mapInPandas(ask, ANSWER)


def enriched(rows: DataFrame, request: str, cache: DataFrame | None, call: Callable[[str], str], parts: list[str] | None = None, force: bool = False, limit: int | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(rows with answer, error and cached; the new answers, for the cache).

    Rows are known by the hash of ``parts`` (else of the request).  A row whose
    hash the cache (hash, answer) answers takes that, unless forced; equal
    requests are asked once; ``limit`` bounds how many are asked, in order of
    their hashes, and the others stay without answer or error.
    """
    keyed = rows.withColumn("__hash", content_key(*(parts or [request])))
    have = None if cache is None or force else cache.filter(F.col("answer").isNotNull()).groupBy("hash").agg(F.max("answer").alias("__known"))
    open_ = keyed.select(F.col("__hash").alias("hash"), F.col(request).alias("request")).groupBy("hash").agg(F.min("request").alias("request"))
    if have is not None:
        open_ = open_.join(have.select("hash"), "hash", "left_anti")
    if limit is not None:
        open_ = open_.orderBy("hash").limit(limit)
    from caseloom.operators.checkpoints import checkpoint

    new = checkpoint(answers(open_, call, **options))  # the calls are made once, whatever reads them
    out = keyed.join(new.select(F.col("hash").alias("__hash"), "answer", "error"), "__hash", "left")
    if have is not None:
        out = out.join(have.withColumnRenamed("hash", "__hash"), "__hash", "left").withColumn("cached", F.col("__known").isNotNull()).withColumn("answer", F.coalesce("answer", "__known")).drop("__known")
    else:
        out = out.withColumn("cached", F.lit(False))
    return out.drop("__hash").select(*rows.columns, "answer", "error", "cached"), new
