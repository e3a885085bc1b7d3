"""Exact similarity joins without a task that sees a whole block: cosine by tiles, fuzzy text by rare parts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.operators.checkpoints import checkpoint

#: Vectors of a tile's side, pivots that deal vectors to cells, and rows that the pivots are picked from.
TILE, PIVOTS, SAMPLE = 4096, 32, 2048
#: Slack of the angles and of the first, blocked products.
SLACK = 1e-9


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, key, vector -> block, key, width and the unit vector as bytes; vectors without a direction are left out."""
    for batch in batches:
        column = batch.column(2)
        lengths = np.asarray(pa.compute.list_value_length(column).fill_null(0))
        for width in np.unique(lengths[lengths > 0]).tolist():
            part = batch.filter(pa.array(lengths == width))
            values = np.asarray(part.column(2).flatten().fill_null(np.nan), float).reshape(-1, width)
            with np.errstate(invalid="ignore", over="ignore"):
                norm = np.linalg.norm(values, axis=1)
            some = np.flatnonzero(np.isfinite(norm) & (norm > 0))
            take = pa.array(some)
            units = values[some] / norm[some, None]
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(np.full(len(some), width), pa.int32()), pa.array([u.tobytes() for u in units], pa.binary())], names=["block", "key", "width", "unit"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, width)


def spread_pivots(units: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those picked."""
    picked = [0]
    near = units @ units[0]
    while len(picked) < min(count, len(units)):
        far = int(near.argmin())
        if near[far] >= 1 - SLACK:
            break
        picked.append(far)
        near = np.maximum(near, units @ units[far])
    return units[picked]


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _dealt(pivots: dict[int, np.ndarray]):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the nearest pivot of each unit vector and the angle to it."""
        for batch in batches:
            for width in sorted(set(batch.column(2).to_pylist())):
                part = batch.filter(pa.array(np.asarray(batch.column(2)) == width))
                near = _matrix(part.column(3), width) @ pivots[width].T
                at = near.argmax(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at.astype(np.int32)), pa.array(_angle(near[np.arange(len(at)), at]))], names=[*part.schema.names, "pivot", "angle"])

    return deal


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One cell as a row: how far its vectors lie from its pivot, their keys and units."""
    keys = table.column("key").to_numpy()
    order = np.argsort(keys, kind="stable")
    units = table.column("unit").combine_chunks().take(pa.array(order))
    return pa.table([table.column("block").slice(0, 1), table.column("width").slice(0, 1), table.column("pivot").slice(0, 1), pa.array([max(table.column("angle").to_pylist())]), pa.array([keys[order].tobytes()], pa.binary()), pa.array([b"".join(units.to_pylist())], pa.binary())], names=["block", "width", "pivot", "radius", "keys", "units"])


def _compared(threshold: float):
    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The pairs of one tile that reach the threshold, by blocked products and then each by itself."""
        row = table.slice(0, 1).to_pylist()[0]
        a, b = (np.frombuffer(row[k], np.int64) for k in ("keys", "other_keys"))
        u, v = (np.frombuffer(row[k], float).reshape(-1, row["width"]) for k in ("units", "other_units"))
        out = []
        for at in range(0, len(a), 512):
            i, j = np.nonzero(u[at : at + 512] @ v.T >= threshold - SLACK)
            i += at
            if row["cell"] == row["other"]:
                i, j = i[i < j], j[i < j]
            exact = (u[i] * v[j]).sum(1)
            good = (exact >= threshold) & (a[i] != b[j])
            out.append((np.minimum(a[i], b[j])[good], np.maximum(a[i], b[j])[good], exact[good]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b", "similarity"])

    return compare


def forest(good: np.ndarray) -> np.ndarray:
    """The links of a spanning forest of a graph between rows and columns."""
    tree = np.zeros_like(good)
    free, open_ = good.any(1), np.ones(good.shape[1], bool)
    for start in np.flatnonzero(free).tolist():
        front = np.array([start]) if free[start] else np.array([], int)
        free[start] = False
        while len(front):
            hit = good[front] & open_
            columns = np.flatnonzero(hit.any(0))
            tree[front[hit[:, columns].argmax(0)], columns] = True
            open_[columns] = False
            rest = np.flatnonzero(free)
            back = good[np.ix_(rest, columns)]
            met = back.any(1)
            front = rest[met]
            tree[front, columns[back[met].argmax(1)] if len(front) else []] = True
            free[front] = False
    return tree


def _linked(threshold: float):
    def link(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Forests of the pairs of one tile that may reach the threshold, one for 512 rows."""
        row = table.slice(0, 1).to_pylist()[0]
        a, b = (np.frombuffer(row[k], np.int64) for k in ("keys", "other_keys"))
        u, v = (np.frombuffer(row[k], float).reshape(-1, row["width"]) for k in ("units", "other_units"))
        out = []
        for at in range(0, len(a), 512):
            i, j = np.nonzero(forest((u[at : at + 512] @ v.T >= threshold - SLACK) & (a[at : at + 512, None] != b)))
            out.append((a[i + at], b[j]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b"])

    return link


def cosine_links(rows: DataFrame, block: str | None, key: str, vector: str, threshold: float, tile: int = TILE) -> DataFrame:
    """(a, b): pairs that hang together the same rows as ``cosine_pairs`` do, a forest a tile in place of all pairs."""
    return _tiles(rows, block, key, vector, threshold, tile).applyInArrow(_linked(threshold), "a long, b long")


def cosine_pairs(rows: DataFrame, block: str | None, key: str, vector: str, threshold: float, tile: int = TILE) -> DataFrame:
    """(a, b, similarity) of all pairs a < b within a block whose cosine reaches the threshold; without a block, of all rows.

    Vectors are dealt to cells by their nearest pivot, a cell with more than
    ``tile`` of them is split by hash, and cells meet in tiles, so a block of any
    size is compared by many tasks of one size.  Two cells meet only if the angle
    between their pivots, less the cells' radii, is within the threshold's; no
    pair can be lost by that.  Null keys and blocks, and vectors that are null,
    zero, or hold null or non-finite components, are in no pair; vectors of
    another length are not compared.
    """
    return _tiles(rows, block, key, vector, threshold, tile).applyInArrow(_compared(threshold), "a long, b long, similarity double")


def _tiles(rows: DataFrame, block: str | None, key: str, vector: str, threshold: float, tile: int):
    """Two cells that may hold a pair, by cell and other: keys and unit vectors of both."""
    base = rows.select((F.col(block).cast("string") if block else F.lit("")).alias("block"), F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")).filter("block is not null and key is not null")
    units = checkpoint(base.mapInArrow(_units, "block string, key long, width int, unit binary"))
    counts = {r["width"]: r["n"] for r in units.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a vector length
    pivots = {}
    for width, n in counts.items():
        some = [r["unit"] for r in units.filter(F.col("width") == width).select("unit").orderBy(F.xxhash64("unit"), "unit").limit(SAMPLE).collect()]
        pivots[width] = spread_pivots(np.frombuffer(b"".join(some), float).reshape(-1, width), min(PIVOTS, -(-n // tile)))
    dealt = checkpoint(units.mapInArrow(_dealt(pivots), "block string, key long, width int, unit binary, pivot int, angle double"))
    cell = ["block", "width", "pivot"]
    sizes = dealt.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"))
    parted = dealt.join(sizes, cell).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    cells = parted.groupBy(*cell, "part").applyInArrow(_pack, "block string, width int, pivot int, radius double, keys binary, units binary")
    cells = checkpoint(cells.withColumn("cell", F.monotonically_increasing_id()))
    heads = cells.select("cell", *cell, "radius")
    # At most PIVOTS pivots: a small table of angles, of a bounded size for each length.
    apart = rows.sparkSession.createDataFrame([(w, i, j, float(_angle(p[i] @ p[j]))) for w, p in pivots.items() for i in range(len(p)) for j in range(len(p))], "width int, pivot int, other_pivot int, apart double")
    others = heads.select("block", "width", F.col("pivot").alias("other_pivot"), F.col("cell").alias("other"), F.col("radius").alias("other_radius"))
    tiles = heads.join(apart, ["width", "pivot"]).join(others, ["block", "width", "other_pivot"]).filter((F.col("cell") <= F.col("other")) & (F.col("apart") - F.col("radius") - F.col("other_radius") <= math.acos(max(-1.0, min(1.0, threshold))) + 1e-6)).select("cell", "other")
    right = cells.select(F.col("cell").alias("other"), F.col("keys").alias("other_keys"), F.col("units").alias("other_units"))
    met = tiles.join(cells.select("cell", "width", "keys", "units"), "cell").join(right, "other")
    return met.groupBy("cell", "other")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel: one integer operation chain for each character of b."""
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for c in b:
        hit = state & place.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def common_lengths(a: list[str], b: list[str], wanted: np.ndarray) -> np.ndarray:
    """``common_length`` of all pairs of two lists; texts of up to 64 letters at once, of two longer ones only the wanted pairs."""
    out = np.zeros((len(a), len(b)), np.int64)
    wide, broad = (np.array([len(t) > 64 for t in texts], bool) for texts in (a, b))
    narrow, slim = np.flatnonzero(~wide), np.flatnonzero(~broad)
    if len(narrow):
        out[narrow] = _lengths([a[i] for i in narrow], b)
    if wide.any() and len(slim):
        out[np.ix_(wide, slim)] = _lengths([b[j] for j in slim], [a[i] for i in np.flatnonzero(wide)]).T
    for i, j in zip(*np.nonzero(wanted & wide[:, None] & broad), strict=True):
        out[i, j] = common_length(a[i], b[j])
    return out


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Texts a have up to 64 letters: a machine word holds the state of a pair."""
    place = {c: i for i, c in enumerate(sorted(set("".join(b))))}
    masks = np.zeros((len(place) + 1, len(a)), np.uint64)
    for i, t in enumerate(a):
        for at, c in enumerate(t):
            if c in place:
                masks[place[c], i] |= np.uint64(1 << at)
    codes = np.full((len(b), max(map(len, b), default=0)), len(place))
    for j, t in enumerate(b):
        codes[j, : len(t)] = [place[c] for c in t]
    sizes = np.array([len(t) for t in a], np.int64)
    full = np.array([(1 << n) - 1 for n in sizes.tolist()], np.uint64)
    state = np.repeat(full[None], len(b), 0)
    for at in range(codes.shape[1]):
        hit = state & masks[codes[:, at]]
        state = (state + hit) | (state - hit)
    return (sizes - np.bitwise_count(state & full).astype(np.int64)).T


def sorted_ratio(a: str, b: str) -> float:
    """Similarity 0 to 100 of two texts whose words are put in order first: 200 * common / total length."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 200 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def sorted_words(c: str) -> Column:
    """The words of a text in order, with one blank between them; null as the empty text."""
    return F.array_join(F.array_sort(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda w: w != "")), " ")


def ratio(a: str | Column, b: str | Column, least: float = 0.0) -> Column:
    """``sorted_ratio`` of two text columns, in Arrow batches; pairs that lengths and letters keep below ``least`` are 0."""

    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        for i, (p, q) in enumerate(zip(x, y, strict=True)):
            p, q = (" ".join(sorted((t or "").split())) for t in (p, q))
            total = len(p) + len(q)
            if not total:
                out[i] = 100.0
            elif 200 * min(len(p), len(q)) >= least * total:
                out[i] = 200 * common_length(p, q) / total
        return pd.Series(out)

    return F.pandas_udf(each, "double")(a, b)


#: Texts up to this length are told by letters, longer ones by runs of GRAM letters.
SHORT, GRAM = 12, 3


def _parts(text: Column, size: int) -> Column:
    """The runs of ``size`` letters of a text, each with how often it came before."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))
    sorted_runs = F.array_sort(runs)
    return F.transform(sorted_runs, lambda r, i: F.concat(r, F.lit("#"), (i - F.array_position(sorted_runs, r) + 1).cast("string")))


def fuzzy_pairs(rows: DataFrame, block: str, key: str, text: str, threshold: float) -> DataFrame:
    """(a, b, ratio) of all pairs a < b within a block whose ``sorted_ratio`` reaches the threshold.  Keys are unique.

    A ratio of t allows D = (1 - t) * (la + lb) letters to be left out of either
    text.  Each takes at most GRAM runs of letters away (GRAM - 1 where it is put
    in), so of the runs of a text all but a share must be common.  Every text
    sends its rarest runs, one more than may be missing, of which a near text has
    one; pairs that meet there and have near lengths are compared exactly.  Texts
    up to ``SHORT`` letters, and those that can be near them, send letters.
    """
    t = threshold / 100
    shrink = t / (2 - t)  # the least length of a near text, for each letter
    # Runs help only where some must be common; at low thresholds all texts send letters.
    gone = max(GRAM - GRAM * t / 2 * (1 + x) + (GRAM - 1) * (x - t / 2 * (1 + x)) for x in (shrink, 1 / shrink))
    short = SHORT if gone * (SHORT + 1) <= SHORT + 1 - GRAM else 1 << 30
    base = rows.select(F.col(block).alias("block"), F.col(key).cast("long").alias("id"), sorted_words(text).alias("k")).filter("block is not null and id is not null and k != ''").withColumn("n", F.length("k"))
    base = checkpoint(base)
    letters = base.filter(F.col("n") <= math.ceil(short / shrink)).select("block", "id", "n", F.explode(_parts(F.col("k"), 1)).alias("part"), F.lit(1).alias("size"))
    runs = base.filter(F.col("n") > short).select("block", "id", "n", F.explode(_parts(F.col("k"), GRAM)).alias("part"), F.lit(GRAM).alias("size"))
    sent = letters.unionByName(runs)
    rarity = sent.groupBy("block", "size", "part").agg(F.count(F.lit(1)).alias("times"))
    place = F.row_number().over(W.partitionBy("block", "id", "size").orderBy("times", "part"))
    # Letters left out of the text itself, and put in, where the other is as short as it may be or as long.
    common = lambda other: t / 2 * (F.col("n") + other)
    lost = lambda other: F.when(F.col("size") == 1, F.col("n") - common(other)).otherwise(GRAM * (F.col("n") - common(other)) + (GRAM - 1) * (other - common(other)))
    most = F.greatest(lost(shrink * F.col("n")), lost(F.col("n")), lost(F.col("n") / shrink))
    kept = sent.join(rarity, ["block", "size", "part"]).withColumn("place", place).filter((F.col("place") <= F.floor(most + 1e-9) + 1) & (F.col("times") > 1))
    kept = checkpoint(kept.select("block", "size", "part", "id", "n"))
    left, right = kept.select("block", "size", "part", F.col("id").alias("a"), F.col("n").alias("na")), kept.select("block", "size", "part", F.col("id").alias("b"), F.col("n").alias("nb"))
    near = 2 * F.least("na", "nb") >= (t - 1e-9) * (F.col("na") + F.col("nb"))
    met = left.join(right, ["block", "size", "part"]).filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    texts = base.select("id", "k")
    both = met.join(texts.withColumnRenamed("id", "a").withColumnRenamed("k", "ka"), "a").join(texts.withColumnRenamed("id", "b").withColumnRenamed("k", "kb"), "b")
    return both.select("a", "b", ratio("ka", "kb", threshold).alias("ratio")).filter(F.col("ratio") >= threshold)
