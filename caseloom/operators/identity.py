"""Linking panel rows into cases: by key and by vectors; bridges between blocks; guards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.functions.text import text
from caseloom.operators.checkpoints import checkpoint
from caseloom.operators.graph import connected_components
from caseloom.operators.similarity import cosine_links


#: Similarities that are looked at in one product.
CELLS = 1 << 22


def merge_tree(vectors: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(i, j, distance) of the merges of unit vectors by mean cosine distance, in order, while it is strictly below 1 - threshold.

    Cluster j goes into i < j.  The mean similarity of two clusters is the product
    of their mean vectors, so memory grows with the vectors, not with their pairs.
    Each round merges all clusters that are nearest to each other: a union is
    never nearer to a third one than its parts were, so the order of such merges
    does not matter, only clusters that lost their nearest one look for it anew,
    and those with none within the threshold are done.  Mean distances never fall
    from a cluster's parts to it, so the tree cut at a higher threshold is the
    tree of that threshold.  Copies of a vector, at no distance, are one cluster
    from the start: by rounds, each would merge one of them.
    """
    n = len(vectors)
    means, near, least = np.array(vectors, float), np.full(n, -1), np.full(n, np.inf)
    first = _first_copies(means) if threshold < 1 else np.arange(n)
    size = np.bincount(first, minlength=n).astype(float)
    alive, copies = np.flatnonzero(size), np.flatnonzero(first != np.arange(n))
    stale, merges = alive, [(i, j, 0.0) for i, j in zip(first[copies].tolist(), copies.tolist(), strict=True)]
    while len(alive) > 1:
        there = means[alive]
        for at in range(0, len(stale), max(1, CELLS // len(alive))):
            some = stale[at : at + max(1, CELLS // len(alive))]
            # Rounded: ties go to the first cluster, from both sides alike.
            like = np.round(means[some] @ there.T, 12)
            like[np.arange(len(some)), np.searchsorted(alive, some)] = -np.inf
            near[some] = alive[like.argmax(1)]
        least[stale] = 1 - (means[stale] * means[near[stale]]).sum(1)
        alive = alive[least[alive] < 1 - threshold]
        if not len(alive):
            break
        i = alive[(near[near[alive]] == alive) & (alive < near[alive])]
        if not len(i):
            first = alive[least[alive].argmin()]
            i = np.array([min(first, near[first])])
            near[i] = max(first, near[first])
            least[i] = least[first]
        j = near[i]
        merges += zip(i.tolist(), j.tolist(), least[i].tolist(), strict=True)
        weight = (size[j] / (size[i] + size[j]))[:, None]
        means[i] += weight * (means[j] - means[i])
        size[i] += size[j]
        gone, changed = np.zeros(n, bool), np.zeros(n, bool)
        gone[j] = changed[i] = changed[j] = True
        alive = np.union1d(alive, i)
        alive = alive[~gone[alive]]
        stale = alive[changed[alive] | changed[near[alive]]]
    return sorted(merges, key=lambda m: m[2])


def _first_copies(units: np.ndarray) -> np.ndarray:
    """The first row with the same vector, for each row; vectors without a direction are no copies."""
    first = np.arange(len(units))
    some = np.flatnonzero((units * units).sum(1) > 0.5)
    if len(some):
        rows = np.ascontiguousarray(units[some]).view(f"V{units.shape[1] * units.itemsize}").ravel()
        _, at, of = np.unique(rows, return_index=True, return_inverse=True)
        first[some] = some[at[of]]
    return first


def cut(n: int, merges: list[tuple[int, int, float]], threshold: float) -> np.ndarray:
    """The least member of each row's cluster when the tree is cut at a threshold."""
    label = np.arange(n)
    for i, j, far in merges:
        if far < 1 - threshold:
            label[j] = i
    while (label[label] != label).any():
        label = label[label]
    return label


def average_linkage(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of agglomerative clustering of unit vectors: mean cosine distance, merging strictly below 1 - threshold."""
    return np.unique(cut(len(vectors), merge_tree(vectors, threshold), threshold), return_inverse=True)[1]


def cluster_sweep(rows: DataFrame, block: str | None, key: str, vector: str, thresholds: list[float], split: bool = True) -> DataFrame:
    """(threshold, block, key, cluster): average linkage within each block at each threshold; a cluster is named by its least key.

    A group's mean similarity cannot reach a threshold unless some pair does, so
    clusters never cross a component of pairs at the lowest threshold.  With
    ``split`` blocks are cut into those components first, and only a component
    has to fit a task.  It makes one merge tree, which is cut at each threshold.
    """
    work = rows.select((F.col(block) if block else F.lit("")).alias("block"), F.col(key).alias("key"), F.col(vector).alias("vector"))
    group, lowest = ["block"], min(thresholds)
    if split:
        parts = connected_components(cosine_links(work, "block" if block else None, "key", "vector", lowest), "a", "b")
        work = work.join(parts.select(F.col("node").alias("key"), F.col("component")), "key", "left").withColumn("component", F.coalesce("component", "key"))
        group = ["block", "component"]
    kinds = dict(work.dtypes)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        v = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        merges = merge_tree(v, lowest)
        keys = pdf["key"].to_numpy()
        return pd.concat([pd.DataFrame({"threshold": t, "block": pdf["block"], "key": keys, "cluster": keys[cut(len(v), merges, t)]}) for t in thresholds])

    return work.groupBy(*group).applyInPandas(cluster, f"threshold double, block {kinds['block']}, key {kinds['key']}, cluster {kinds['key']}")


def vector_clusters(rows: DataFrame, block: str | None, key: str, vector: str, threshold: float = 0.9, split: bool = True) -> DataFrame:
    """(block, key, cluster): average linkage within each block (without one: over all rows) at one threshold."""
    return cluster_sweep(rows, block, key, vector, [threshold], split).drop("threshold")


def sweep_report(clusters: DataFrame, old: str | None = None) -> DataFrame:
    """For each threshold: ids, single ones, largest, and the ids that join several old ones (else several keys)."""
    sizes = clusters.groupBy("threshold", "cluster").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(old or "key").alias("olds"))
    return sizes.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("n") == 1).alias("n_single"), F.max("n").alias("largest"), F.count_if(F.col("olds") > 1).alias("n_merges"))


def representatives(rows: DataFrame, by: list[str], body: str, order: str) -> DataFrame:
    """The longest text of each group, the first of equally long ones."""
    longest = F.struct(F.length(text(body)), -F.col(order))
    return rows.groupBy(*by).agg(F.max_by(body, longest).alias(body), F.max_by(order, longest).alias(order), F.min(order).alias("first"))


def merge_by_key(ids: DataFrame, id_col: str, key: str) -> DataFrame:
    """(id, component): ids that share a key that is not empty become one; least id names it.  The graph is ids and least ids of keys."""
    real = ids.filter(text(key) != "").select(F.col(id_col).alias("id"), F.col(key).alias("key")).distinct()
    least = real.groupBy("key").agg(F.min("id").alias("least"))
    return connected_components(real.join(least, "key").select(F.col("id").alias("src"), F.col("least").alias("dst"))).select(F.col("node").alias("id"), "component")


def dense_ids(rows: DataFrame, root: str, name: str = "caso_id") -> DataFrame:
    """Adds 1..N in the order of the distinct roots.

    Roots are numbered by range partition and offset, so no single task sees all of them.
    """
    roots = rows.select(root).distinct().repartitionByRange(root).sortWithinPartitions(root).select(root, F.spark_partition_id().alias("__p"))
    roots = checkpoint(roots.withColumn("__i", F.row_number().over(W.partitionBy("__p").orderBy(root))))
    sizes = roots.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    numbered = roots.join(F.broadcast(offsets), "__p").select(F.col(root).alias("__number_of"), (F.col("__before") + F.col("__i")).alias(name))
    return rows.join(numbered, F.col(root).eqNullSafe(F.col("__number_of"))).drop("__number_of")


def forbidden(rows: DataFrame, id_col: str, body: str, first: tuple[str, ...], second: tuple[str, ...]) -> Column:
    """Whether some id holds texts of both kinds, which must not be linked."""
    from caseloom.functions.text import fold

    t = fold(body)
    has = lambda words: F.max(F.forall(F.array(*[t.contains(w) for w in words]), lambda x: x).cast("int"))
    return rows.groupBy(id_col).agg((has(first) + has(second)).alias("n")).agg(F.coalesce(F.max("n") == 2, F.lit(False)))


def link(rows: DataFrame, threshold: float = 0.9, block: str = "departamento", key: str = "clave", body: str = "texto_crudo", vector: str = "embedding", order: str = "pos", guard: tuple[tuple[str, ...], tuple[str, ...]] | None = None) -> DataFrame:
    """Adds ``caso_id``: clusters within blocks, joined by equal keys, then by a bridge over all; the bridge goes back if the guard fails."""
    real = rows.filter(text(key) != "")
    reps = representatives(real, [block, key], body, order).join(real.select(F.col(order).alias("__o"), vector), F.col(order) == F.col("__o")).drop("__o")
    inside = vector_clusters(reps, block, order, vector, threshold).select(F.col("key").alias(order), F.col("cluster").alias("local"))
    local = checkpoint(reps.join(inside, order))
    same = merge_by_key(local, "local", key).select(F.col("id").alias("local"), F.col("component").alias("merged"))
    local = checkpoint(local.join(same, "local"))
    heads = representatives(local, ["merged"], body, order).join(local.select(F.col(order).alias("__o"), vector), F.col(order) == F.col("__o")).drop("__o")
    bridge = vector_clusters(heads, None, "merged", vector, threshold).select(F.col("key").alias("merged"), F.col("cluster").alias("bridged"))
    local = checkpoint(local.join(bridge, "merged"))
    root = "bridged"
    if guard and forbidden(local, "bridged", body, *guard).first()[0]:
        root = "merged"
    names = local.select(F.col(block).alias("__b"), F.col(key).alias("__k"), F.col(root).alias("__root"))
    met = rows.join(names, (F.col(block) == F.col("__b")) & (F.col(key) == F.col("__k")), "left").withColumn("__root", F.coalesce("__root", F.col(order)))
    return dense_ids(met, "__root").drop("__b", "__k", "__root")
