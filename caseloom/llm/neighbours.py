"""Approximate nearest neighbours by inner product: a navigable small-world graph for each shard.

*Classes.*  Equal vectors are one node; a node keeps the smallest ids of its
rows, as many as an answer can need, so copies neither crowd a graph nor a task.

*Shards.*  Pivots fitted on a bounded sample deal the nodes out; a pivot with
more than ``SHARD`` nodes has several shards, by hash.  A query goes to the
shards of its first pivots.  How many it needs is measured on the sample: as
many as hold ``COVER`` of the exact neighbours there.

*Graph.*  Vectors get one more component, so that all have one length and the
greatest inner product is the nearest.  Nodes draw their level from a hash and
are put in by descending level, so a layer is the first rows of the shard and
its graph one flat array of row numbers (a row of links for each node).  Rows go
in by batches of growing size: a beam search from the layers above finds
candidates, which with the rest of the batch give the links (a candidate nearer
to a chosen one than to the row is passed over, then the best fill up), and rows
that are linked choose again among their old and new links.  Rows that no path
reaches get a link from one that is.

*Search.*  Greedy through the upper layers, then a beam of ``BEAM`` rows in the
lowest; its rows are scored exactly, in double precision, on the original
vectors.  The shards' answers are merged by score and id.

Graphs are written once, as rows of a table, and meet the queries of a shard in
chunks of at most ``CHUNK`` of them.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows without id, nor vectors of another length
than the most frequent one (ties: the longest); rows that repeat an id are rows
of their own, and a query leaves out only its own row; with fewer candidates an
answer is shorter; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from caseloom.llm import kernels as K
from caseloom.llm.frames import broadcast_if_few, checkpoint, only, shared_folder
from caseloom.llm.vector_codes import dense

EVERY, NEAREST = 20, 20
#: Nodes of a shard, of the sample that pivots are fitted on, and the most pivots; queries of a task.
SHARD, FIT_ROWS, PIVOTS, CHUNK = 4096, 16_384, 1024, 4096
COVER = 0.98
#: Links of a node (twice as many in the lowest layer), beams of building and searching, rows expanded at a time.
LINKS, BUILD_BEAM, BEAM, STEP = 16, 64, 128, 4
FIRST_BATCH, LAST_BATCH = 128, 1024

_NONE = np.float32(-np.inf)


def levels(nodes: np.ndarray) -> np.ndarray:
    """The top layer of each node, from a hash of its number: each layer has about one in LINKS of the one below."""
    u = ((K.mix(nodes.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) + 1) / (1 << 53)
    return (-np.log(u) / np.log(LINKS)).astype(int)


def widened(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors over the greatest length, with one component more that makes all of length one."""
    x = vectors / longest
    return np.column_stack([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))]).astype(np.float32)


def beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, similarities), best first, of the best ``size`` that a search from the entries finds; -1 fills up."""
    n = len(queries)
    rows, near = np.full((n, size), -1, np.int32), np.full((n, size), _NONE)
    rows[:, 0], near[:, 0] = entry, np.einsum("bd,bd->b", queries, x[entry])
    done = np.zeros((n, size), bool)
    seen = np.zeros((n, len(links)), bool)
    seen[np.arange(n), entry] = True
    left = np.arange(n)
    while len(left):
        waits = np.where(done[left], _NONE, near[left])
        step = min(STEP, size)
        some = np.argpartition(-waits, step - 1, axis=1)[:, :step]
        valid = np.take_along_axis(waits, some, 1) > _NONE
        busy = valid.any(1)
        left, some, valid = left[busy], some[busy], valid[busy]
        if not len(left):
            break
        done[left[:, None], some] |= valid
        next_ = links[np.where(valid, rows[left[:, None], some], 0)]
        next_[~valid] = -1
        next_ = next_.reshape(len(left), -1)
        of, at = np.nonzero(next_ >= 0)
        to = next_[of, at]
        fresh = ~seen[left[of], to]
        of, to = of[fresh], to[fresh]
        if not len(of):
            continue
        flat = np.unique(of * np.int64(len(links)) + to)
        of, to = flat // len(links), (flat % len(links)).astype(np.int32)
        seen[left[of], to] = True
        close = np.einsum("td,td->t", queries[left[of]], x[to])
        good = close > near[left].min(1)[of]
        of, to, close = of[good], to[good], close[good]
        count = np.bincount(of, minlength=len(left))
        if not len(of):
            continue
        place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        wide = int(count.max())
        new_rows, new_near = np.full((len(left), wide), -1, np.int32), np.full((len(left), wide), _NONE)
        new_rows[of, place], new_near[of, place] = to, close
        all_rows, all_near = np.concatenate([rows[left], new_rows], 1), np.concatenate([near[left], new_near], 1)
        all_done = np.concatenate([done[left], np.zeros((len(left), wide), bool)], 1)
        best = np.argpartition(-all_near, size - 1, axis=1)[:, :size]
        rows[left], near[left], done[left] = (np.take_along_axis(a, best, 1) for a in (all_rows, all_near, all_done))
    order = np.lexsort((rows, -near), axis=1)
    return np.take_along_axis(rows, order, 1), np.take_along_axis(near, order, 1)


def chosen(x: np.ndarray, rows: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """The links among candidates (rows, similarities; -1 for none): first those not nearer to a chosen one, then the best others."""
    order = np.lexsort((rows, -near), axis=1)
    rows, near = np.take_along_axis(rows, order, 1), np.take_along_axis(near, order, 1)
    valid = rows >= 0
    valid[:, 1:] &= rows[:, 1:] != rows[:, :-1]  # repeated candidates are next to each other
    found = x[np.maximum(rows, 0)]
    between = np.matmul(found, found.transpose(0, 2, 1))
    closest = np.full(rows.shape, _NONE)
    taken, count = np.zeros(rows.shape, bool), np.zeros(len(rows), int)
    for c in range(rows.shape[1]):
        ok = valid[:, c] & (near[:, c] > closest[:, c]) & (count < most)
        taken[:, c] = ok
        count += ok
        closest[ok] = np.maximum(closest[ok], between[ok, c])
    rank = np.where(taken, 0, np.where(valid, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(rows, order, 1), -1).astype(np.int32)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _link_back(x: np.ndarray, links: np.ndarray, start: int, end: int) -> None:
    """The rows that rows start to end link to choose among their links and those rows."""
    most = links.shape[1]
    to, of = links[start:end].ravel(), np.repeat(np.arange(start, end, dtype=np.int32), most)
    some = to >= 0
    to, of = to[some], of[some]
    near = np.einsum("td,td->t", x[to], x[of])
    order = np.lexsort((-near, to))
    to, of = to[order], of[order]
    first = np.flatnonzero(np.diff(to, prepend=-1))
    count = np.diff(np.append(first, len(to)))
    place = np.arange(len(to)) - np.repeat(first, count)
    keep = place < most  # the best of them
    come = np.full((len(first), min(most, int(count.max(initial=0)))), -1, np.int32)
    come[np.repeat(np.arange(len(first)), count)[keep], place[keep]] = of[keep]
    target = to[first]
    for at in range(0, len(target), LAST_BATCH):
        rows = target[at : at + LAST_BATCH]
        cands = np.concatenate([links[rows], come[at : at + LAST_BATCH]], 1)
        sims = np.where(cands >= 0, np.einsum("bd,bkd->bk", x[rows], x[np.maximum(cands, 0)]), _NONE)
        links[rows] = chosen(x, cands, sims, most)


def _layer(x: np.ndarray, size: int, upper: list[np.ndarray], width: int) -> np.ndarray:
    """The links of a layer of the first ``size`` rows; ``upper``: the layers above, the highest first."""
    links = np.full((size, width), -1, np.int32)
    above = len(upper[-1]) if upper else 0
    start, batch = 0, FIRST_BATCH
    while start < size:
        end = min(size, start + batch)
        if start < above < end:
            end = above  # rows of the layers above come first: theirs is no entry yet
        mine = x[start:end]
        inner = mine @ mine.T
        np.fill_diagonal(inner, _NONE)
        k = min(LINKS, end - start - 1)
        near_rows = np.argpartition(-inner, max(k - 1, 0), axis=1)[:, :k] if k else np.zeros((end - start, 0), int)
        rows, near = (near_rows + start).astype(np.int32), np.take_along_axis(inner, near_rows, 1)
        if start:
            entry = descend(x, upper, mine) if start >= above and upper else np.zeros(end - start, np.int32)
            got = beam(x, links[:start], mine, entry, BUILD_BEAM)
            rows, near = np.concatenate([rows, got[0]], 1), np.concatenate([near, got[1]], 1)
        links[start:end, : min(LINKS, width)] = chosen(x, rows, near, min(LINKS, width))
        _link_back(x, links, start, end)
        start, batch = end, min(2 * batch, LAST_BATCH)
    return links


def descend(x: np.ndarray, layers: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """The row that each query enters the next layer by."""
    entry = np.zeros(len(queries), np.int32)
    for links in layers:
        entry = beam(x, links, queries, entry, STEP)[0][:, 0]
    return entry


def reachable(links: np.ndarray) -> np.ndarray:
    """Links, with columns more, so that a path leads from row 0 to every row."""
    reached = np.zeros(len(links), bool)
    front = np.zeros(1, np.int64)
    while True:
        while len(front):
            reached[front] = True
            front = np.unique(links[front])
            front = front[front >= 0]
            front = front[~reached[front]]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return links
        back = links[lost]
        known = (back >= 0) & reached[np.maximum(back, 0)]
        where = known.argmax(1)
        from_, to = back[np.arange(len(lost)), where][known.any(1)], lost[known.any(1)]
        if not len(to):
            from_, to = np.zeros(1, np.int64), lost[:1]
        from_, first = np.unique(from_, return_index=True)
        column = np.full((len(links), 1), -1, np.int32)
        column[from_, 0] = to[first]
        links = np.concatenate([links, column], 1)
        front = to[first].astype(np.int64)


def small_world(x: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
    """The layers, highest first, of rows that stand by descending level."""
    layers: list[np.ndarray] = []
    for at in range(int(level[0]), -1, -1):
        layers.append(reachable(_layer(x, int((level >= at).sum()), layers, LINKS if at else 2 * LINKS)))
    return layers


def search(x: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, size: int) -> np.ndarray:
    """The rows of each query's beam in the lowest layer."""
    return beam(x, layers[-1], queries, descend(x, layers[:-1], queries), size)[0]


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, vector -> vec_id, the vector's components as bytes and their number, its length."""
    for batch in batches:
        lengths = np.asarray(pa.compute.list_value_length(batch.column(1)).fill_null(0))
        for width in np.unique(lengths[lengths > 0]).tolist():
            part = batch.filter(pa.array(lengths == width))
            keep, values = dense(part.column(1))
            ids = part.column(0).take(pa.array(keep))
            some = np.flatnonzero((values != 0).any(1) & ~np.asarray(ids.is_null()))
            values = values[some] + 0.0  # a zero has no sign
            with np.errstate(over="ignore"):
                norm = np.sqrt((values * values).sum(1))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array([v.tobytes() for v in values], pa.binary()), pa.array(np.full(len(some), width), pa.int32()), pa.array(norm)], names=["vec_id", "key", "width", "norm"])


def _stacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, width)


def fitted_pivots(sample: np.ndarray, count: int, nearest: int = NEAREST, cover: float = COVER) -> tuple[np.ndarray, int]:
    """(pivots, how many of them a query must visit to meet ``cover`` of its nearest rows of the sample)."""
    pivots = sample[:: max(1, len(sample) // count)][:count].copy()
    for _ in range(6):
        of = (sample @ pivots.T).argmax(1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, of, sample)
        long = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(long > 0, sums / np.maximum(long, 1e-12), pivots).astype(np.float32)
    of = (sample @ pivots.T).argmax(1)
    asks = np.arange(0, len(sample), max(1, len(sample) // 512))
    near = sample[asks, :-1] @ sample[:, :-1].T
    near[np.arange(len(asks)), asks] = _NONE
    best = np.argsort(-near, axis=1)[:, : min(nearest, len(sample) - 1)]
    order = np.argsort(np.argsort(-visits(sample[asks], pivots), axis=1), axis=1)
    rank = np.sort(np.take_along_axis(order, of[best], 1).ravel())
    return pivots, int(rank[min(len(rank) - 1, int(np.ceil(cover * len(rank))) - 1)]) + 1 if len(rank) else len(pivots)


def visits(queries: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """How near a query comes to what a pivot stands for: the inner product without the added component."""
    return queries[:, :-1] @ pivots[:, :-1].T


def _placed(pivots: np.ndarray, probes: int, width: int, longest: float):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """node, key -> node, its pivot and the pivots that it would visit as a query."""
        for batch in batches:
            if batch.num_rows:
                x = widened(_stacked(batch.column(1), width), longest)
                to = np.argpartition(-visits(x, pivots), probes - 1, axis=1)[:, :probes] if probes < len(pivots) else np.broadcast_to(np.arange(len(pivots)), (len(x), len(pivots)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((x @ pivots.T).argmax(1).astype(np.int32)), pa.array(to.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["node", "pivot", "visits"])

    return place


GRAPHS = "shard long, nodes binary, first binary, vectors binary, layers array<binary>"
_GRAPHS = pa.schema([("shard", pa.int64()), ("nodes", pa.binary()), ("first", pa.binary()), ("vectors", pa.binary()), ("layers", pa.list_(pa.binary()))])


def _builder(width: int, longest: float):
    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The graph of a shard: its nodes by descending level, their vectors and the links of each layer."""
        nodes = table.column("node").to_numpy()
        level = levels(nodes)
        order = np.lexsort((nodes, -level))
        values = _stacked(table.column("key").combine_chunks(), width)[order]
        layers = small_world(widened(values, longest), level[order])
        first = table.column("first").to_numpy()[order]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in (nodes[order], first, values)), pa.array([[a.tobytes() for a in layers]], pa.list_(pa.binary()))], schema=_GRAPHS)

    return build


HITS = "asks long, node long, first long, score double"
_HITS = pa.schema([("asks", pa.int64()), ("node", pa.int64()), ("first", pa.int64()), ("score", pa.float64())])


def _searcher(width: int, longest: float, nearest: int, size: int):
    def find(key: tuple[pa.Scalar, ...], graphs: pa.Table, asked: pa.Table) -> pa.Table:
        """The best nodes of a shard for each of its queries, one more than an answer has."""
        if not graphs.num_rows or not asked.num_rows:
            return _HITS.empty_table()
        row = graphs.slice(0, 1).to_pylist()[0]
        nodes, first = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["first"], np.int64)
        values = np.frombuffer(row["vectors"], float).reshape(-1, width)
        x, level = widened(values, longest), levels(nodes)
        layers = [np.frombuffer(b, np.int32).reshape(int((level >= at).sum()), -1) for at, b in zip(range(int(level[0]), -1, -1), row["layers"], strict=True)]
        ids, wanted = asked.column("node").to_numpy(), _stacked(asked.column("key").combine_chunks(), width)
        out = []
        for at in range(0, len(ids), 512):
            exact = wanted[at : at + 512]
            got = search(x, layers, np.column_stack([exact / longest, np.zeros(len(exact))]).astype(np.float32), min(size, len(nodes)))
            of, place = np.nonzero(got >= 0)
            hit = got[of, place]
            score = (exact[of] * values[hit]).sum(1)
            order = np.lexsort((first[hit], -score, of))
            of, hit, score = of[order], hit[order], score[order]
            count = np.bincount(of, minlength=len(exact))
            keep = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) < nearest + 1
            out.append((ids[at + of[keep]], nodes[hit[keep]], first[hit[keep]], score[keep]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_HITS)

    return find


def nearest_rows(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", every: int = EVERY, nearest: int = NEAREST, shard: int = SHARD, size: int = BEAM, cover: float = COVER) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose id ``every`` divides, the ``nearest`` other rows found, by inner product."""
    base = only(vectors, vec_id=id_col, vector=vector_col).select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>"))
    spark = base.sparkSession
    valid = checkpoint(base.mapInArrow(_valid, "vec_id long, key binary, width int, norm double"))
    common = valid.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm")).orderBy(F.desc("n"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, longest = common["width"], float(common["norm"])
    rows = valid.filter(F.col("width") == width).select("vec_id", "key")
    queries = rows.filter(F.col("vec_id") % every == 0)
    # Of equal vectors the smallest ids; Spark prunes them before the shuffle.
    firsts = rows.withColumn("at", F.row_number().over(W.partitionBy("key").orderBy("vec_id"))).filter(F.col("at") <= nearest + 1).groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    asked = queries.select("key").distinct().withColumn("asked", F.lit(True))
    nodes = checkpoint(firsts.join(asked, "key", "left").select(F.monotonically_increasing_id().alias("node"), "key", "members", F.coalesce("asked", F.lit(False)).alias("asked")))
    count = nodes.count()
    sample = [r["key"] for r in nodes.select("key").orderBy(F.xxhash64("key"), "key").limit(FIT_ROWS).collect()]  # the bounded fit
    pivots, probes = fitted_pivots(widened(np.frombuffer(b"".join(sample), float).reshape(-1, width), longest), min(PIVOTS, len(sample), -(-count // shard)), nearest, cover)
    placed = checkpoint(nodes.select("node", "key").mapInArrow(_placed(pivots, probes, width, longest), "node long, pivot int, visits array<int>"))
    held = {r["pivot"]: r["n"] for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a pivot
    parts = [-(-held.get(p, 0) // shard) for p in range(len(pivots))]
    of_pivot = F.array(*[F.lit(n) for n in parts])
    shard_of = lambda pivot, part: (pivot.cast("long") * (1 << 32) + part).alias("shard")
    full = nodes.join(placed, "node")
    dealt = full.select(shard_of(F.col("pivot"), F.pmod(F.xxhash64("node"), F.element_at(of_pivot, F.col("pivot") + 1))), "node", "key", F.col("members")[0].alias("first"))
    folder = shared_folder(spark, "graphs")
    dealt.groupBy("shard").applyInArrow(_builder(width, longest), GRAPHS).write.parquet(folder)
    graphs = spark.read.parquet(folder)
    to = full.filter("asked").select("node", "key", F.explode("visits").alias("pivot")).withColumn("parts", F.element_at(of_pivot, F.col("pivot") + 1)).filter("parts > 0")
    visiting = to.select("node", "key", "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(shard_of(F.col("pivot"), F.col("part")), "node", "key")
    chunks = broadcast_if_few(visiting.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")))
    asks = visiting.join(chunks, "shard").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    copies = graphs.join(chunks, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    hits = copies.groupBy("shard", "chunk").cogroup(asks.groupBy("shard", "chunk")).applyInArrow(_searcher(width, longest, nearest, size), HITS)
    best = hits.withColumn("at", F.row_number().over(W.partitionBy("asks").orderBy(F.desc("score"), "first"))).filter(F.col("at") <= nearest + 1).select("asks", "node", "score")
    each = best.join(nodes.select("node", "members"), "node").select("asks", "score", "node", F.explode("members").alias("vec_id"))
    order = W.partitionBy("asks").orderBy(F.desc("score"), "vec_id")
    lists = each.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= nearest + 1).groupBy("asks").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "node", "score"))).alias("found"))
    answers = lists.join(nodes.select(F.col("node").alias("asks"), "key"), "asks")
    own = F.array_position(F.transform("found", lambda f: (f["vec_id"] == F.col("query_id")) & (f["node"] == F.col("asks"))), True).cast("int")
    met = queries.withColumnRenamed("vec_id", "query_id").join(answers, "key").withColumn("own", own)
    others = F.when(F.col("own") > 0, F.concat(F.slice("found", F.lit(1), F.col("own") - 1), F.slice("found", F.col("own") + 1, F.lit(nearest)))).otherwise(F.slice("found", 1, nearest))
    return met.select("query_id", F.posexplode(others).alias("at", "f")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
