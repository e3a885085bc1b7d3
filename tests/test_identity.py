"""Similarity joins, leaders, clusters and matches against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import graph, identity, matching, similarity


@pytest.mark.parametrize("tile", [8, 2048])
@pytest.mark.parametrize("threshold", [0.0, 0.6, 0.95])
def test_cosine_pairs_lose_none(spark, tile, threshold):
    """Every pair of a block, over cells of few rows, tight groups and copies; odd vectors are in none."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 5))
    rows = [(i, "ab"[i % 3 == 0], (centres[i % 6] + 0.2 * rng.normal(size=5)).tolist()) for i in range(150)]
    rows += [(200 + i, "a", rows[1][2]) for i in range(20)] + [(300, "a", None), (301, "a", [0.0] * 5), (302, "a", [float("nan")] * 5), (303, "a", [None] * 5), (304, "a", [1.0, 2.0]), (305, "a", [1.0, 2.1]), (306, None, [1.0] * 5), (None, "a", [1.0] * 5), (307, "a", [])]
    df = spark.createDataFrame(rows, "id long, b string, v array<double>").repartition(3)

    def plain(by_block):
        out = set()
        for i, b, v in rows:
            for j, c, w in rows:
                if i is not None and j is not None and i < j and v and w and len(v) == len(w) and (not by_block or (b is not None and b == c)):
                    if any(x is None for x in v + w):
                        continue
                    n = np.linalg.norm(v) * np.linalg.norm(w)
                    if n > 0 and np.dot(v, w) / n >= threshold:
                        out.add((i, j))
        return out

    found = similarity.cosine_pairs(df, "b", "id", "v", threshold, tile=tile).collect()
    assert len(found) == len({(r.a, r.b) for r in found}) and {(r.a, r.b) for r in found} == plain(True)
    assert {(r.a, r.b) for r in similarity.cosine_pairs(df, None, "id", "v", threshold, tile=tile).collect()} == plain(False)


def test_far_cells_do_not_meet(spark):
    """Tight groups far apart: of all pairs of cells only those within reach are compared."""
    rng = np.random.default_rng(2)
    rows = [(i, (np.eye(8)[i % 8] + 0.01 * rng.normal(size=8)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    tiles = similarity.cosine_pairs(df, None, "id", "v", 0.9, tile=16)
    assert tiles.count() == 8 * 50 * 49 // 2
    pivots = similarity.spread_pivots(np.array([v / np.linalg.norm(v) for _, v in rows]), 8)
    assert np.abs(pivots @ pivots.T - np.eye(8)).max() < 0.1


def texts(seed, n=120):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = [rng.choice(["mina", "rio", "el", "comunidad", "a", "xy", "oro", "protesta"]) + rng.choice(["", "s", "1"]) for _ in range(rng.choice([1, 1, 2, 3, 5, 8]))]
        for _ in range(rng.randrange(1, 4)):
            t = list(" ".join(base))
            for _ in range(rng.randrange(0, 1 + len(t) // 6)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randrange(2)] = rng.choice(["", "q", "a", " "])
            out.append("".join(t))
    return out


@pytest.mark.parametrize("threshold", [40.0, 75.0, 88.0, 100.0])
def test_fuzzy_pairs_lose_none(spark, threshold):
    rows = [(i, "xy"[i % 2], t) for i, t in enumerate(texts(3) + [None, "", "  ", "b a", "a b"])] + [(500, None, "a b")]
    df = spark.createDataFrame(rows, "id long, b string, t string")
    got = {(r.a, r.b): r.ratio for r in similarity.fuzzy_pairs(df, "b", "id", "t", threshold).collect()}
    want = {(i, j): similarity.sorted_ratio(s, t) for i, b, s in rows for j, c, t in rows if i < j and b is not None and b == c and s and t and s.split() and t.split() and similarity.sorted_ratio(s, t) >= threshold}
    assert got == pytest.approx(want)


def leaders(n, pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(b, []).append(a)
    lead = {}
    for i in range(n):
        lead[i] = min((a for a in near.get(i, []) if lead[a] == a), default=i)
    return lead


@pytest.mark.parametrize("local", [matching.LOCAL_PAIRS, 0, 5])
@pytest.mark.parametrize("kind", ["random", "chain", "clique"])
def test_leaders_equal_the_loop(spark, kind, local):
    rng = random.Random(4)
    n = 14 if kind == "chain" else 40
    pairs = {"random": {tuple(sorted(rng.sample(range(n), 2))) for _ in range(60)}, "chain": {(i, i + 1) for i in range(n - 1)}, "clique": {(i, j) for j in range(12) for i in range(j)}}[kind]
    got = dict(matching.first_leaders(spark.createDataFrame(sorted(pairs), "a long, b long"), local).collect())
    want = leaders(n, pairs)
    assert got == {i: want[i] for p in pairs for i in p}


def test_fuzzy_leaders_equal_the_loop(spark):
    rows = [(i, None if i % 17 == 0 else "xy"[i % 3 == 0], t) for i, t in enumerate(texts(5) * 2 + [None, "", ""])]
    want, heads = {}, {}
    for i, b, t in rows:
        key = " ".join(sorted((t or "").split()))
        mine = heads.setdefault(b or "", [])
        hit = next((j for k, j in mine if similarity.sorted_ratio(k, key) >= 88), None) if key else None
        if key and hit is None:
            mine.append((key, i))
        want[i] = i if hit is None else hit
    df = spark.createDataFrame(rows, "pos long, b string, t string").repartition(3)
    assert {r.pos: r.leader for r in matching.fuzzy_leaders(df, "b", "t", "pos").collect()} == want


def greedy(pairs, accept=70.0):
    taken, out = set(), []
    for left in sorted({p[0] for p in pairs}):
        best = None
        for _, r, s, _, stop in sorted((p for p in pairs if p[0] == left and p[2] >= accept), key=lambda p: (p[3], p[1])):
            if r in taken:
                continue
            if best is None or s > best[1]:
                best = (r, s)
            if stop:
                break
        if best:
            taken.add(best[0])
            out.append((left, *best))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matches_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, b, float(rng.choice([60, 70, 80, 90, 90])), rng.choice([0, 1]) * 100 + b, rng.random() < 0.2) for a in range(25) for b in range(25) if rng.random() < 0.12]
    df = spark.createDataFrame(pairs, "l long, r long, score double, rank long, stop boolean").repartition(4)
    assert sorted(tuple(r) for r in matching.greedy_matches(df).collect()) == greedy(pairs)
    assert sorted(tuple(r) for r in matching.greedy_matches(df.drop("rank", "stop")).collect()) == greedy([(a, b, s, b, False) for a, b, s, *_ in pairs])


def test_scored_matches_equal_the_search(spark):
    """The search as a loop over all rows, free ones in order, the same department first, ended by a sure text."""
    rng = random.Random(6)
    make = lambda n, words: [(i, t if rng.random() < 0.9 else None, rng.choice(["AN", "PU", "", None]), rng.sample(["m1", "m2", "m3", "m4"], rng.randrange(3))) for i, t in enumerate(rng.choices(words, k=n))]
    words = [" ".join(sorted(set(t.split()))) for t in texts(7, 30)]
    left, right = make(30, words), make(40, words)
    used, want = set(), []
    for i, t, d, m in left:
        same = [r for r in right if (r[2] or "") == (d or "") and d]
        best = None
        for j, u, e, k in same + [r for r in right if r not in same]:
            if j in used:
                continue
            text = similarity.sorted_ratio(t, u) if t and u else 0
            dept = 100.0 if d and d == e else 0.0
            mine = 100.0 if set(m) & set(k) else (40.0 if m and k else 0.0)
            score = 0.62 * text + 0.20 * dept + 0.18 * mine
            if best is None or score > best[0]:
                best = (score, j)
            if text >= 96 and dept == 100:
                break
        if best and best[0] >= 70:
            used.add(best[1])
            want.append((i, best[1], round(best[0], 6)))
    schema = "id long, clave string, dept string, minas array<string>"
    got = matching.greedy_matches(matching.scored_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)))
    assert sorted((r.l, r.r, round(r.score, 6)) for r in got.collect()) == want and len(want) > 5
    with pytest.raises(ValueError):
        matching.scored_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), accept=60)


def test_matches_by_kinds_equal_those_by_pairs(spark):
    """Copies, blanks, several mines, long texts and tiles of few kinds give the pairs' matches."""
    rng = random.Random(8)
    words = [*(" ".join(t.split()) for t in texts(9, 14)), "", " ", "".join(rng.choice("abc") for _ in range(70)), "".join(rng.choice("abc") for _ in range(80))]
    make = lambda n: [(i, rng.choice(words) if rng.random() < 0.95 else None, rng.choice(["AN", "PU", "", None]), rng.choice([[], ["m1"], ["m1", "m2"], ["m2", "m3", "m4"], ["m4", None], [None]])) for i in rng.sample(range(1000), n)]
    schema = "id long, clave string, dept string, minas array<string>"
    left, right = (spark.createDataFrame(make(n), schema).repartition(3) for n in (150, 170))
    want = sorted(tuple(r) for r in matching.greedy_matches(matching.scored_pairs(left, right)).collect())
    assert sorted(tuple(r) for r in matching.matches(left, right).collect()) == want and len(want) > 60
    few = matching.SIDE
    try:
        matching.SIDE = 3
        assert sorted(tuple(r) for r in matching.matches(left, right).collect()) == want
    finally:
        matching.SIDE = few


def test_many_copies_are_matched_by_their_kinds(spark):
    """3,000 rows of one kind a side: nine million pairs of rows, but one of kinds."""
    rows = spark.range(3000).selectExpr("id", "'rio oro' AS clave", "'AN' AS dept", "array('m') AS minas")
    assert matching._keyed(matching._kinds(rows)[1]).count() == 2
    assert sorted(tuple(r) for r in matching.matches(rows, rows).collect()) == [(i, i, 100.0) for i in range(3000)]


def test_report_of_no_match(spark):
    side = spark.createDataFrame([(1, "A", "t", ["m"], ["c"], "2010-01-31")], "id long, dept string, tipo string, minas array<string>, companias array<string>, fecha string")
    none = spark.createDataFrame([], "l long, r long, score double")
    r = matching.match_report(matching.compared_matches(none, side, side), side, side).first()
    assert (r.n_left, r.n_right, r.n_matched, r.recall, r.precision, r.overall) == (1, 1, 0, 0, 0, 0)
    one = spark.createDataFrame([(1, 1, 80.0)], "l long, r long, score double")
    r = matching.match_report(matching.compared_matches(one, side, side), side, side).first()
    assert (r.recall, r.precision, r.agreement, r.overall, r.score_mean) == pytest.approx((100, 100, 100, 100, 80))


def plain_linkage(v, threshold):
    groups = [[i] for i in range(len(v))]
    while len(groups) > 1:
        far, a, b = min((np.mean([1 - v[i] @ v[j] for i in g for j in h]), x, y) for x, g in enumerate(groups) for y, h in enumerate(groups) if x < y)
        if not far < 1 - threshold:
            break
        groups[a] += groups.pop(b)
    return {i: min(g) for g in groups for i in g}


def test_one_tree_gives_the_clusters_of_every_threshold():
    for seed in range(5):
        v = np.random.default_rng(seed).normal(size=(30, 4))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        merges = identity.merge_tree(v, 0.1)
        assert [m[2] for m in merges] == sorted(m[2] for m in merges)
        for t in (0.1, 0.4, 0.8, 0.95):
            assert dict(enumerate(identity.cut(30, merges, t).tolist())) == plain_linkage(v, t)


def test_tree_of_copies_and_ties():
    """Copies, mirrored and equally far vectors; more rounds than one."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(12, 3))
    v = np.concatenate([v, v[:6], v[:3], np.eye(3), -np.eye(3)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    merges = identity.merge_tree(v, 0.05)
    for t in (0.05, 0.5, 0.9):
        assert dict(enumerate(identity.cut(len(v), merges, t).tolist())) == plain_linkage(v, t)


def test_tree_needs_no_matrix():
    """Memory grows with the vectors: 6,000 of them would need a matrix of 288 MB."""
    import tracemalloc

    v = np.random.default_rng(4).normal(size=(6000, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tracemalloc.start()
    merges = identity.merge_tree(v, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(merges) > 5000 and peak < 150e6


def test_copies_are_one_cluster_from_the_start(monkeypatch):
    """Forty copies of a vector took forty rounds over all rows; zero vectors stay apart."""
    v = np.random.default_rng(6).normal(size=(50, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    many = np.concatenate([np.tile(v, (40, 1)), np.zeros((3, 8))])
    seen, rounded = [], np.round
    monkeypatch.setattr(identity.np, "round", lambda x, d: seen.append(x.size) or rounded(x, d))
    merges = identity.merge_tree(many, 0.3)
    assert sum(seen) < len(many) ** 2
    assert [m[2] for m in merges] == sorted(m[2] for m in merges)
    few = np.concatenate([np.tile(v[:20], (3, 1)), np.zeros((3, 8))])
    for t in (0.3, 0.6, 0.95):
        assert dict(enumerate(identity.cut(63, identity.merge_tree(few, 0.3), t).tolist())) == plain_linkage(few, t)
    assert not identity.merge_tree(v[:1].repeat(5, 0), 1.0)


def test_links_hang_together_as_the_pairs(spark):
    """A forest a tile, far fewer rows than pairs, the same components."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(1, 6)) + 0.2 * rng.normal(size=(60, 6)) for _ in range(4)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    parts = lambda pairs: {(r.node, r.component) for r in graph.connected_components(pairs, "a", "b").collect()}
    for tile in (50, 4096):
        pairs, links = similarity.cosine_pairs(df, None, "id", "v", 0.8, tile), similarity.cosine_links(df, None, "id", "v", 0.8, tile)
        assert parts(links) == parts(pairs) and links.count() < pairs.count() / 4


def test_all_pairs_take_few_tiles(spark):
    """The query's tiles hold thousands of rows: those of 128 were sent across by the hundred thousand."""
    import inspect

    from caseloom.plans import identity_catalog

    assert "tile" not in inspect.getsource(identity_catalog.cosine_pairs_all) and similarity.TILE >= 2048


def test_sweep(spark):
    v = np.random.default_rng(9).normal(size=(60, 3))
    rows = [(i, "ab"[i % 2], x.tolist(), i % 4) for i, x in enumerate(v / np.linalg.norm(v, axis=1, keepdims=True))]
    df = spark.createDataFrame(rows, "id long, b string, v array<double>, viejo int")
    cuts = identity.cluster_sweep(df, "b", "id", "v", [0.5, 0.9])
    got = {(r.threshold, r.key): r.cluster for r in cuts.collect()}
    for t in (0.5, 0.9):
        for b in "ab":
            mine = [r for r in rows if r[1] == b]
            want = plain_linkage(np.array([r[2] for r in mine]), t)
            assert {r[0]: got[(t, r[0])] for r in mine} == {mine[i][0]: mine[j][0] for i, j in want.items()}
    report = {r.threshold: r for r in identity.sweep_report(cuts.withColumn("old", F.col("key") % 4), "old").collect()}
    for t, r in report.items():
        of = {}
        for (s, k), c in got.items():
            if s == t:
                of.setdefault(c, set()).add(k)
        assert (r.n_ids, r.n_single, r.largest, r.n_merges) == (len(of), sum(len(x) == 1 for x in of.values()), max(map(len, of.values())), sum(len({k % 4 for k in x}) > 1 for x in of.values()))


def test_link_has_no_single_key(spark):
    """No step of linking deals the vectors by a constant: the plan groups by cells and components."""
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(i, "AB"[i % 2], f"k{i}", f"t{i}", rng.normal(size=4).tolist()) for i in range(40)], "pos long, departamento string, clave string, texto_crudo string, embedding array<double>")
    assert identity.link(df, 0.5).count() == 40 and "__one" not in open(identity.__file__).read()
