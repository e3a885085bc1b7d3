"""Vector codes and nearest neighbours against plain versions, on the odd rows each must take."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import neighbours, registry, vector_codes

SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    """(vec_id, embedding, label) with columns too many, whose names clash with what the operators use inside."""
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("block", F.lit("b")).withColumn("key", F.lit(1)).withColumn("node", F.lit(2)).repartition(3)


def plain_codes(rows, rounds=vector_codes.ROUNDS):
    """Lloyd's rounds as stated, part by part, in Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    width = max([len(r[1]) for r in kept], default=0)
    width = 8 * -(-max(width, 1) // 8)
    ints = [[int(np.floor(4096 * x)) for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, ints[i]))
    w = width // 8
    parts = [[ints[i][p * w : (p + 1) * w] for i in range(len(kept))] for p in range(8)]
    books = [[parts[p][i] for i in order[:16]] for p in range(8)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda x, book: min(range(len(book)), key=lambda e: (dist(x, book[e]), e))
    for _ in range(rounds):
        for p in range(8):
            mine = [best(x, books[p]) for x in parts[p]]
            books[p] = [[sum(c) // len(c) for c in zip(*(x for x, m in zip(parts[p], mine) if m == e))] if e in mine else entry for e, entry in enumerate(books[p])]
    codes = [[best(parts[p][i], books[p]) for p in range(8)] for i in range(len(kept))]
    errors = [sum(dist(parts[p][i], books[p][codes[i][p]]) for p in range(8)) for i in range(len(kept))]
    labels = {}
    for r, e in zip(kept, errors):
        labels[r[2]] = labels.get(r[2], 0) + e
    name = vector_codes.digest(np.array(books, dtype=object)) if kept else None
    return sorted(((r[0], "".join(f"{e:02x}" for e in c), x, labels[r[2]], name) for r, c, x in zip(kept, codes, errors)), key=repr)


def vectors(seed, n, width, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    rows = [(i, (centres[i % 5] + 0.4 * rng.normal(size=width)).tolist(), int(rng.integers(3)) if i % 4 else None) for i in range(n)]
    return rows + [(n + i, rows[0][1], 1) for i in range(copies)]


@pytest.mark.parametrize("rows", [
    vectors(1, 300, 16),
    vectors(2, 10, 16),
    vectors(3, 60, 12, copies=40),
    [(None, [1.0] * 8, 1), (3, None, 1), (4, [None] * 8, 1), (5, [float("nan")] + [0.0] * 7, 1), (6, [float("inf")] * 8, 1), (1, [0.5, -0.25], None), (1, [0.5, -0.25], None), (1, [0.1] * 9, 7), (2, [], 7)] + vectors(4, 30, 8),
    [(i, [float(i % 2)] * 8, 0) for i in range(40)],
    [(1, None, 1)],
    [],
], ids=["clusters", "few", "copies", "odd", "ties", "none kept", "empty"])
def test_codes_against_plain_rounds(spark, rows):
    got = vector_codes.compressed(frame(spark, rows))
    assert sorted((tuple(r) for r in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr) == plain_codes(rows)


def test_heaps_pop_less_than_all_and_lose_nothing():
    """Clustered parts: later rounds compare few of them, and the assignment is the nearest entry all the same."""
    rng = np.random.default_rng(5)
    x = (rng.integers(0, 4000, (16, 6))[rng.integers(0, 16, 5000)] + rng.integers(-150, 150, (5000, 6))).astype(np.int64)
    books, drift, heaps, sums, popped = x[:16][None].copy(), np.zeros((1, 16)), None, np.zeros((16, 7), np.int64), []
    for _ in range(8):
        heaps, n = vector_codes.assign(x, books[0], drift[0], heaps, sums)
        popped.append(n)
        want = ((x[:, None] - books[0][None]) ** 2).sum(2).argmin(1)
        for e, (rows, keys) in enumerate(heaps):
            assert sorted(rows.tolist()) == np.flatnonzero(want == e).tolist() and (np.diff(keys) >= 0).all()
            assert sums[e, -1] == len(rows) and (sums[e, :-1] == x[rows].sum(0)).all()
        books, drift = vector_codes.moved(books, sums[None], drift)
    assert popped[0] == 5000 and popped[-1] < 2500 and sum(popped) < 0.8 * 8 * 5000


def test_rounds_do_not_shuffle_vectors(spark):
    popped = []
    codes, books = vector_codes.heap_lloyd(frame(spark, vectors(6, 200, 16)), popped=popped)
    plan = codes._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and popped[0] == 1600 and max(popped) == 1600
    got = {r.vec_id: np.array(r.decoded) for r in vector_codes.decoded(codes, books).collect()}
    want = {i: np.array(v) for i, v, _ in vectors(6, 200, 16)}
    assert np.mean([np.linalg.norm(got[i] - want[i]) for i in want]) < 0.8 * np.mean([np.linalg.norm(want[i]) for i in want])


def test_large_components_are_clamped(spark):
    rows = [(i, [1e30 * (-1) ** i] * 8, 1) for i in range(4)]
    assert {r.error for r in vector_codes.compressed(frame(spark, rows)).collect()} == {0}


def brute(rows, every=20, nearest=20):
    """Every answer, as (query row, [(vec_id, score)])."""
    part = [(i, v) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    lengths = [len(v) for _, v in part]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    part = [(i, np.array(v)) for i, v in part if len(v) == width]
    out = []
    for at, (i, v) in enumerate(part):
        if i % every == 0:
            near = sorted(((-(v * u).sum(), j) for k, (j, u) in enumerate(part) if k != at))[:nearest]
            out.append((i, [(j, -s) for s, j in near]))
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.mark.parametrize("rows", [
    vectors(7, 12, 8),
    vectors(8, 90, 8, copies=70),
    [(0, None, 1), (20, [0.0] * 8, 1), (40, [None] * 8, 1), (60, [float("nan")] * 8, 1), (None, [1.0] * 8, 1), (80, [2.0, 3.0], 1), (100, [-0.0] * 7 + [1.0], 1)] + vectors(9, 25, 8)[1:20],
    [(i, [1.0] * 8, 1) for i in range(100)],
    [(0, [1.0, 2.0], 1)],
    [],
], ids=["few", "copies", "odd", "one vector", "alone", "empty"])
def test_small_shards_are_exact(spark, rows):
    """With no more rows than a beam holds the answers are those of brute force, ties and copies included."""
    got = answers(neighbours.nearest_rows(frame(spark, rows)))
    want = {i: near for i, near in brute(rows) if near}
    assert set(got) == set(want)
    for i, near in want.items():
        assert [r for r, _, _ in got[i]] == list(range(1, len(near) + 1)) and [j for _, j, _ in got[i]] == [j for j, _ in near]
        assert np.allclose([s for *_, s in got[i]], [s for _, s in near], rtol=1e-12)


def test_repeated_ids_leave_out_only_their_own_row(spark):
    rows = [(20, [1.0, 0.5], 1), (20, [1.0, 0.5], 1), (20, [0.5, 1.0], 1), (3, [0.1, 0.2], 1)]
    got = sorted((r["rank"], r.vec_id, round(r.score, 9)) for r in neighbours.nearest_rows(frame(spark, rows)).collect())
    assert got == sorted([(1, 20, 1.25), (2, 20, 1.0), (3, 3, 0.2)] * 2 + [(1, 20, 1.0), (2, 20, 1.0), (3, 3, 0.25)])


@pytest.mark.parametrize("shard,scale", [(neighbours.SHARD, 0), (300, 0), (700, 1.0)], ids=["one shard", "many shards", "lengths differ"])
def test_recall(spark, shard, scale):
    """Against brute force on a given table; also over several shards, and for inner products of vectors of other lengths."""
    table = registry.table(spark, "/root/testdata/sf0.1", "embeddings")
    if scale:
        table = table.withColumn("embedding", F.transform("embedding", lambda x: x * (1 + F.col("vec_id") % 7)))
    rows = [(r.vec_id, [float(x) for x in r.embedding], 0) for r in table.collect()]
    got, want = answers(neighbours.nearest_rows(table, shard=shard)), dict(brute(rows))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({j for _, j, _ in got[i]} & {j for j, _ in want[i]}) / 20 for i in want]) >= 0.95


def test_islands_are_reached():
    """Tight groups far from each other, copies but for noise: every row stays within reach of a search."""
    rng = np.random.default_rng(10)
    x = np.concatenate([c + 1e-4 * rng.normal(size=(150, 16)) for c in rng.normal(size=(6, 16))])
    x = neighbours.widened(x, np.linalg.norm(x, axis=1).max())
    level = neighbours.levels(np.arange(len(x)))
    order = np.argsort(-level, kind="stable")
    x, layers = x[order], neighbours.small_world(x[order], level[order])
    reached, front = {0}, [0]
    while front:
        front = [int(j) for i in front for j in layers[-1][i] if j >= 0 and j not in reached and not reached.add(int(j))]
    assert len(reached) == len(x)
    got = neighbours.search(x, layers, np.column_stack([x[:, :-1], np.zeros(len(x))]).astype(np.float32), 64)
    near = np.sort(x[:, :-1] @ x[:, :-1].T, axis=1)[:, ::-1]
    mine = np.einsum("bkd,bd->bk", x[got][:, :, :-1], x[:, :-1])
    assert (mine[:, :10].min(1) >= near[:, 30] - 1e-3).mean() > 0.98


def test_graphs_choose_shards_by_the_sample():
    """Clusters apart: a query needs few pivots; noise: nearly all of them."""
    rng = np.random.default_rng(11)
    clusters = neighbours.widened(np.repeat(rng.normal(size=(16, 24)), 60, 0) + 0.05 * rng.normal(size=(960, 24)), 12.0)
    noise = neighbours.widened(rng.normal(size=(960, 24)), 12.0)
    assert neighbours.fitted_pivots(rng.permutation(clusters), 16)[1] <= 6
    assert neighbours.fitted_pivots(noise, 16)[1] >= 8


def test_queries_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(vector_codes.SQL)
    columns = [d[0] for d in want.description]
    got = registry.op11_vector_codes(spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.fetchall())
