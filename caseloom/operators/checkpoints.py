"""Cutting lineage on shared storage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def checkpoint(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Write ``df`` where every executor can read it and go on from the files, ``parts`` at most.

    A small table need not become a file for each shuffle partition.

    The folder is the one the session names in ``spark.checkpoint.dir``; only a
    session without that setting (local tests) gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="caseloom-checkpoint-"))
    return (df.coalesce(parts) if parts else df).checkpoint(eager=True)
