"""Joins and set operations of the inventories and the panel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.functions.text import text
from caseloom.operators.checkpoints import checkpoint
from caseloom.operators.graph import connected_components


def enrich(rows: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Left join that replaces columns a former run left behind."""
    stale = [c for c in extra.columns if c != key and c in rows.columns]
    return rows.drop(*stale).join(extra, key, "left")


def pending(rows: DataFrame, cache: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Rows that the cache does not answer; all of them when forced."""
    return rows if force else rows.join(cache.select(key).distinct(), key, "left_anti")


def crosswalk(left: DataFrame, right: DataFrame, key: str, name: str, order: str, labels: tuple[str, str, str] = ("match", "solo_drive", "solo_nuevo")) -> DataFrame:
    """Full outer join of two listings on a number, each side's first name; labels: both, left only, right only."""
    first = lambda df, as_: df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(name, order).alias(as_))
    met = first(left, "left_name").join(first(right, "right_name"), key, "full_outer")
    state = F.when(F.col("left_name").isNotNull() & F.col("right_name").isNotNull(), labels[0]).when(F.col("left_name").isNotNull(), labels[1]).otherwise(labels[2])
    return met.select(key, F.col("left_name").isNotNull().alias("in_left"), F.col("right_name").isNotNull().alias("in_right"), state.alias("state"), "left_name", "right_name")


def calendar_coverage(grid: DataFrame, reports: DataFrame) -> DataFrame:
    """Each month of the grid with the sources (old, new) that have it and their numbers: ambos, solo_drive, solo_nuevo or falta."""
    seen = reports.groupBy("anio", "mes").agg(F.bool_or(F.col("origen") == "old").alias("old"), F.bool_or(F.col("origen") == "new").alias("new"), F.array_join(F.transform(F.array_sort(F.collect_set("numero")), lambda x: x.cast("string")), " ").alias("numeros"))
    met = grid.join(seen, ["anio", "mes"], "left")
    old, new = F.coalesce("old", F.lit(False)), F.coalesce("new", F.lit(False))
    state = F.when(old & new, "ambos").when(old, "solo_drive").when(new, "solo_nuevo").otherwise("falta")
    return met.select("anio", "mes", old.alias("old"), new.alias("new"), F.coalesce("numeros", F.lit("")).alias("numeros"), state.alias("estado"))


#: Candidates of one component that a task walks through; larger components go by rounds.
LOCAL_ROWS = 1 << 18


def uncovered(candidates: DataFrame, base: DataFrame, keys: list[str], order: str, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Candidates that share no key with the base, nor with a candidate kept before them.

    A candidate goes only if a kept one took one of its keys, so the outcome of a
    row depends on the rows before it that hang together with it by keys.  Such
    components are walked through in order, each in one task; those of more than
    ``local_rows`` rows go by rounds that each keep the rows which come first for
    all their keys.  Rows whose keys are all blank stay.  ``order`` is a whole
    number that tells rows apart.
    """
    filled = lambda k: text(k) != ""
    left = candidates
    for k in keys:
        left = left.join(base.filter(filled(k)).select(k).distinct(), k, "left_anti")
    left = checkpoint(left.select(F.col(order).cast("long").alias("__row"), *[text(k).alias(f"__k{i}") for i, k in enumerate(keys)]))
    names = [f"__k{i}" for i in range(len(keys))]
    edges = None
    for n in names:
        some = left.filter(F.col(n) != "")
        first = some.groupBy(n).agg(F.min("__row").alias("dst"))
        mine = some.join(first, n).select(F.col("__row").alias("src"), "dst")
        edges = mine if edges is None else edges.unionByName(mine)
    placed = left.join(connected_components(edges).withColumnRenamed("node", "__row"), "__row", "left").withColumn("component", F.coalesce("component", "__row"))
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("__n"))
    placed = checkpoint(placed.join(sizes, "component"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[tuple[str, str]] = set()
        kept = []
        for row in pdf.sort_values("__row").itertuples(index=False, name=None):
            own = {(n, v) for n, v in zip(("row", *names), row, strict=True) if n != "row" and v}
            if not own & taken:
                taken |= own
                kept.append(row[0])
        return pd.DataFrame({"__row": kept})

    kept = placed.filter(F.col("__n") <= local_rows).select("component", "__row", *names).groupBy("component").applyInPandas(lambda pdf: walk(pdf[["__row", *names]]), "__row long")
    large = checkpoint(placed.filter(F.col("__n") > local_rows).select("__row", *names))
    while not large.isEmpty():
        ranked = large
        for n in names:
            first = large.filter(F.col(n) != "").groupBy(F.col(n).alias("__k")).agg(F.min("__row").alias(f"__first{n}"))
            ranked = ranked.join(first, F.col(n) == F.col("__k"), "left").drop("__k")
        leads = F.lit(True)
        for n in names:
            leads = leads & ((F.col(n) == "") | (F.col("__row") == F.col(f"__first{n}")))
        won = checkpoint(ranked.filter(leads).select("__row", *names))
        kept = kept.unionByName(won.select("__row"))
        large = large.join(won.select("__row"), "__row", "left_anti")
        for n in names:
            large = large.join(won.filter(F.col(n) != "").select(n).distinct(), n, "left_anti")
        large = checkpoint(large.select("__row", *names))
    return candidates.join(kept, F.col(order).cast("long") == F.col("__row"), "left_semi")


def by_priority(rows: DataFrame, key: str, url: str, priority: Column, order: str) -> DataFrame:
    """One row a key by (priority, order); rows without a key once per address, if no kept row has it."""
    keyed, bare = rows.filter(text(key) != ""), rows.filter(text(key) == "")
    best = keyed.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(priority, order))).filter("__r = 1").drop("__r")
    rest = bare.join(best.select(url).distinct(), url, "left_anti").select(*rows.columns)
    rest = rest.withColumn("__r", F.row_number().over(W.partitionBy(url).orderBy(order))).filter("__r = 1").drop("__r")
    return best.unionByName(rest)


def village_hits(rows: DataFrame, body: str, names: DataFrame, owner: str, name: str, per_owner: int = 120, most: int = 6) -> DataFrame:
    """Adds ``villages``: per row, up to ``most`` names of its owner that its folded text holds, the longest first.

    The catalogue keeps at most ``per_owner`` names of six or more characters of
    each owner, so one array a row carries it.
    """
    rank = F.row_number().over(W.partitionBy(owner).orderBy(F.desc(F.length(name)), name))
    kept = names.select(owner, name).distinct().filter(F.length(name) >= 6).withColumn("__r", rank).filter(F.col("__r") <= per_owner)
    lists = kept.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", name))), lambda x: x[name]).alias("__names"))
    met = rows.join(lists, owner, "left")
    hits = F.slice(F.filter(F.coalesce("__names", F.array().cast("array<string>")), lambda n: F.contains(F.col(body), n)), 1, most)
    return met.withColumn("villages", hits).drop("__names")


def set_status(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of two tables with the side they are on: both, left, right."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    tag = lambda df, s: df.withColumn("side", F.lit(s))
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "left")).unionByName(tag(b.subtract(a), "right"))
