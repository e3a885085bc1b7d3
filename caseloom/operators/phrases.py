"""Many names in many texts in one pass: an index of the names by their first words goes to the texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from caseloom.functions.text import fold
from caseloom.operators.checkpoints import checkpoint

#: Names of one pass; a larger catalogue takes several, each with a part of it.
SLICE = 1 << 17
_WORD = re.compile(r"[a-z0-9_]+")


def _index(names: list[str]) -> dict[str, list[str]]:
    """Names by their first word; the longest first."""
    out: dict[str, list[str]] = {}
    for name in sorted(names, key=len, reverse=True):
        first = _WORD.search(name)
        if first and first.start() == 0:
            out.setdefault(first.group(), []).append(name)
    return out


def _ends(text: str, at: int) -> bool:
    """Whether no word goes on across a place, as ``\\b`` has it for a name that ends in a word."""
    return at >= len(text) or not (_WORD.match(text, at) and _WORD.match(text, at - 1))


def found_names(text: str, index: dict[str, list[str]]) -> dict[str, int]:
    """The names that stand in a folded text as whole words, with their first places."""
    out: dict[str, int] = {}
    for word in _WORD.finditer(text):
        for name in index.get(word.group(), ()):
            at = word.start()
            if name not in out and text.startswith(name, at) and _ends(text, at + len(name)):
                out[name] = at
    return out


def phrase_hits(rows: DataFrame, key: str, body: str, names: DataFrame, name: str = "name", slice_size: int = SLICE) -> DataFrame:
    """(key, name, at): the names that stand in each row's folded text as whole words, with the first place (from 0).

    Names are folded as well; those that do not begin with a letter or digit of
    the folded alphabet are in no text.  The catalogue is dealt into slices of at
    most ``slice_size`` names by rank, and each slice is an index that goes to all
    tasks: its size is bounded, and the texts are read once for each.
    """
    spark = rows.sparkSession
    folded = names.select(fold(name).alias("folded")).filter("folded rlike '^[a-z0-9_]'").distinct()
    # Ranks by partition and offset: no task puts all names in order.
    ranked = checkpoint(folded.withColumn("id", F.monotonically_increasing_id()))
    counts = {r["p"]: r["n"] for r in ranked.groupBy(F.shiftright("id", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, {}
    for p in sorted(counts):
        starts[p] = before
        before += counts[p]
    offset = F.lit(0).cast("long")
    for p, start in starts.items():
        offset = F.when(F.shiftright("id", 33) == p, F.lit(start)).otherwise(offset)
    placed = ranked.withColumn("rank", offset + F.col("id").bitwiseAND(F.lit((1 << 33) - 1)))
    texts = rows.select(F.col(key).alias("key"), fold(body).alias("text"))
    kind = dict(texts.dtypes)["key"]
    out = spark.createDataFrame([], f"key {kind}, name string, at int")
    for first in range(0, before, slice_size):
        index = _index([r["folded"] for r in placed.filter((F.col("rank") >= first) & (F.col("rank") < first + slice_size)).select("folded").collect()])  # at most slice_size names

        def search(batches: Iterator[pd.DataFrame], index: dict[str, list[str]] = index) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = [(k, n, at) for k, t in zip(pdf["key"], pdf["text"], strict=True) for n, at in found_names(t, index).items()]
                yield pd.DataFrame(found, columns=["key", "name", "at"])

        out = out.unionByName(texts.mapInPandas(search, f"key {kind}, name string, at int"))
    return out.withColumnRenamed("key", key)


def longest_hit(hits: DataFrame, key: str) -> DataFrame:
    """Of each row's names the longest, of equally long ones the first in order."""
    return hits.groupBy(key).agg(F.min(F.struct((-F.length("name")).alias("less"), "name"))["name"].alias("name"))


def owner_hits(rows: DataFrame, key: str, owner: str, body: str, names: DataFrame, most: int = 6, place: str | None = None, place_limit: int = 220) -> DataFrame:
    """Adds ``places``: up to ``most`` names of the row's owner that its text holds, by the catalogue's order, joined by '; '.

    ``names`` has (owner, name, rank).  Without any the row's own ``place``, cut
    to ``place_limit`` characters, stands in.
    """
    known = names.select(F.col(owner).alias("__owner"), F.col("name").alias("__said"), fold("name").alias("__name"), F.col("rank").alias("__rank"))
    hits = phrase_hits(rows, key, body, names).join(rows.select(F.col(key), F.col(owner).alias("__owner")), key)
    met = hits.join(known, (F.col("name") == F.col("__name")) & (hits["__owner"] == known["__owner"])).groupBy(key, "__said").agg(F.min("__rank").alias("__rank"))
    kept = met.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy("__rank", "__said"))).filter(F.col("__r") <= most)
    lists = kept.groupBy(F.col(key).alias("__key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__said"))), lambda x: x["__said"]), "; ").alias("places"))
    own = F.left(F.trim(F.regexp_replace(F.coalesce(F.col(place), F.lit("")), r"(?U)\s+", " ")), F.lit(place_limit)) if place else F.lit("")
    return rows.join(lists, F.col(key) == F.col("__key"), "left").drop("__key").withColumn("places", F.coalesce("places", own))
