"""Rollups, joins, identity, sources, sinks and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import graph, identity, joins, matching, rollups, similarity
from caseloom.sources import readers, sinks, versions
from caseloom.streaming import incremental


def test_components_against_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3)], "src long, dst long")
    assert dict(graph.connected_components(df).collect()) == {x: find(x) for x in list(root)}
    assert graph.connected_components(df.filter("false")).count() == 0


def test_ratio_and_leaders(spark):
    assert similarity.sorted_ratio("b a", "a b") == 100 and similarity.sorted_ratio("", "") == 100 and similarity.sorted_ratio("a", "") == 0
    rows = [(1, "x", "mina la caida"), (2, "x", "la caida mina"), (3, "x", "otra cosa"), (4, "y", "mina la caida"), (5, "x", ""), (6, "x", "")]
    df = spark.createDataFrame(rows, "pos long, dept string, clave string")
    for order in (df, df.orderBy(F.desc("pos"))):
        assert {r.pos: r.leader for r in matching.fuzzy_leaders(order, "dept", "clave", "pos").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_average_linkage_differs_from_single():
    angle = lambda *d: np.stack([np.cos(np.deg2rad(d)), np.sin(np.deg2rad(d))], 1)
    chain = angle(0, 20, 40, 60)
    labels = identity.average_linkage(chain, np.cos(np.deg2rad(25)))
    assert labels[0] == labels[1] and labels[2] == labels[3] and labels[0] != labels[2]
    assert list(identity.average_linkage(angle(0), 0.9)) == [0]


def test_link_guard_rolls_the_bridge_back(spark):
    rows = [(1, "A", "k1", "cenepa uno", [1.0, 0.0]), (2, "A", "k1", "cenepa uno", [1.0, 0.0]), (3, "B", "k2", "dorato dos", [0.999, 0.04]), (4, "B", "", "x", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "pos long, departamento string, clave string, texto_crudo string, embedding array<double>")
    ids = lambda d: {r.pos: r.caso_id for r in d.collect()}
    free, kept = ids(identity.link(df)), ids(identity.link(df, guard=(("cenepa",), ("dorato",))))
    assert free[1] == free[2] == free[3] != free[4]
    assert kept[1] == kept[2] != kept[3] and len(set(kept.values())) == 3


def test_rollups_take_the_first_of_equals(spark):
    rows = [(1, 1, "aa", 2020, 1), (1, 2, "bb", 2020, 1), (1, 3, "c", None, None), (2, 4, "nan", 2020, 2)]
    df = spark.createDataFrame(rows, "caso_id int, pos int, caso string, anio int, mes int").withColumns({"f": F.lit(0), "g": F.lit(1)})
    cases = rollups.unique_cases(df, firsts=("caso",), flags=("f", "g"))
    assert {(r.caso_id, r.caso, r.n_apariciones, r.n_meses) for r in cases.collect()} == {(1, "aa", 3, 1), (2, "nan", 1, 1)}
    assert dict(df.groupBy("caso_id").agg(rollups.longest_by("caso", "pos")).collect()) == {1: "aa", 2: ""}
    assert dict(rollups.first_seen_mode(df, "caso_id", "caso", "pos").collect()) == {1: "aa", 2: "nan"}


def test_joins(spark):
    left = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "numero int, name string, pos int")
    right = spark.createDataFrame([(2, "d", 1), (3, "e", 2)], "numero int, name string, pos int")
    got = {r.numero: (r.state, r.left_name, r.right_name) for r in joins.crosswalk(left, right, "numero", "name", "pos").collect()}
    assert got == {1: ("solo_drive", "a", None), 2: ("match", "c", "d"), 3: ("solo_nuevo", None, "e")}
    a = spark.createDataFrame([(1, 0), (2, 0)], "k int, extra int")
    assert sorted(joins.enrich(a, spark.createDataFrame([(1, 9)], "k int, extra int"), "k").collect()) == [(1, 9), (2, None)]


def test_quotas_and_samples(spark):
    df = spark.range(100).select(F.col("id"), F.when(F.col("id") < 90, "big").otherwise("small").alias("s"))
    assert {r.s: r.quota for r in rollups.quotas(df, "s", 20, 5).collect()} == {"big": 18, "small": 5}
    sample = rollups.stratified_sample(df, "s", "id", 20, 5, seed=2)
    assert sorted(sample.collect()) == sorted(rollups.stratified_sample(df.repartition(7), "s", "id", 20, 5, seed=2).collect())


def test_greedy(spark):
    pairs = spark.createDataFrame([(1, 1, 90.0), (1, 2, 95.0), (2, 2, 99.0), (2, 3, 50.0), (3, 1, 80.0)], "l long, r long, score double")
    assert sorted(matching.greedy_matches(pairs).collect()) == [(1, 2, 95.0), (3, 1, 80.0)]


def test_files(spark, tmp_path):
    (tmp_path / "panel_caso_mes.csv").write_text('﻿caso_id,caso\n1,"dos\nlíneas ""x"""\n2,\n', encoding="utf-8")
    assert sorted(readers.panel(spark, str(tmp_path), "caso_id int, caso string").collect()) == [(1, 'dos\nlíneas "x"'), (2, "")]
    (tmp_path / "l.tsv").write_text("a/N° 101.pdf\t12\tm\tid\n\nb.pdf\n", encoding="utf-8")
    assert [(r.archivo, r["size"], r.numero) for r in readers.listing(spark, str(tmp_path / "l.tsv")).orderBy("pos").collect()] == [("N° 101.pdf", 12, 101), ("b.pdf", 0, None)]
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "k string, v int, ts int")
    sinks.upsert(spark, path, rows(("a", 1, 1), ("b", 1, 1)), "k", "ts")
    sinks.upsert(spark, path, rows(("a", 2, 2)), "k", "ts")
    assert sorted(versions.read_table(spark, path).collect()) == [("a", 2, 2), ("b", 1, 1)]
    sinks.append_absent(spark, path, rows(("a", 5, 5), ("c", 1, 1)), "k")
    assert sorted(r.k for r in versions.read_table(spark, path).collect()) == ["a", "b", "c"]
    sinks.append_absent(spark, f"{path}-plain", rows(("a", 5, 5)), "k")
    sinks.append_absent(spark, f"{path}-plain", rows(("a", 6, 6), ("", 1, 1), ("c", 1, 1)), "k")
    assert sorted(spark.read.parquet(f"{path}-plain").collect()) == [("a", 5, 5), ("c", 1, 1)]
    sinks.write_panel(rows(("a", 1, 1)), str(tmp_path / "out"), ("k", "other"))
    assert spark.read.parquet(str(tmp_path / "out/panel_caso_mes.parquet")).columns == ["k", "other"]


def test_damaged_documents_are_failures(spark):
    def decode(raw):
        if raw == b"bad":
            raise ValueError("broken")
        yield 1, 800.0, raw.decode(), []

    docs = spark.createDataFrame([("a", b"text"), ("b", b"bad")], "archivo string, content binary")
    pages, failures = readers.decoded_pages(docs, decode)
    assert [r.text for r in pages.collect()] == ["text"] and [tuple(r) for r in failures.collect()] == [("b", "broken")]


def test_search_results(spark):
    answer = '{"data": {"attributes": {"results": [{"name": "x", "url": "u", "publication": "p", "collections": [{"id": 1356}]}, {"name": "y", "url": "v", "collections": []}]}}}'
    df = spark.createDataFrame([(answer,)], "json string")
    assert [r.name for r in readers.search_results(df, collection=1356).collect()] == ["x"] and readers.search_results(df).count() == 2


def test_cached_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "cache")
    work = lambda d: d.select("hash", F.upper("q").alias("answer"), F.lit(1).alias("ts"))
    for i, q in enumerate(["a", "b", "a"]):
        spark.createDataFrame([(q,)], "q string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("q string").parquet(source)
        incremental.cached(stream, out, str(tmp_path / "cp"), work, ["q"]).awaitTermination(60)
    assert sorted(r.answer for r in versions.read_table(spark, out).collect()) == ["A", "B"]


@pytest.mark.parametrize("fields,want", [(["q"], [("q", 2, 1, 50.0)])])
def test_precision_ignores_what_is_no_number(spark, fields, want):
    df = spark.createDataFrame([("1",), ("0",), ("x",), (None,)], "q string")
    assert [tuple(r) for r in rollups.precision(df, fields).collect()] == want


@pytest.mark.parametrize("local", [joins.LOCAL_ROWS, 3])
def test_uncovered_files_follow_the_order(spark, local):
    """A row goes only if a row that is kept took one of its keys; against the plain loop."""
    rng = np.random.default_rng(3)
    rows = [(0, "c1", "n1"), (1, "c2", "n1"), (2, "c2", "n2"), (3, "", ""), (4, "", "")]
    rows += [(i, f"c{a}" if a else "", f"n{b}" if b else "") for i, a, b in zip(range(5, 300), rng.integers(0, 90, 295).tolist(), rng.integers(0, 90, 295).tolist())]
    base = {("c5", ""), ("", "n7")}
    taken, want = {k for row in base for k in row if k}, []
    for i, *keys in rows:
        if not any(k in taken for k in keys if k):
            want.append(i)
            taken |= {k for k in keys if k}
    df = spark.createDataFrame(rows, "pos long, clave string, numero string").repartition(3)
    got = joins.uncovered(df, spark.createDataFrame(list(base), "clave string, numero string"), ["clave", "numero"], "pos", local)
    assert sorted(r.pos for r in got.collect()) == want and 2 in want and {3, 4} <= set(want)
    assert joins.uncovered(df.filter("false"), df, ["clave", "numero"], "pos").count() == 0


def test_hubs_of_a_graph(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST_DEGREE", 10)
    monkeypatch.setattr(graph, "HUBS", 40)
    edges = [(i, 5000) for i in range(300)] + [(i, 6000) for i in range(290, 600)] + [(i, i + 1) for i in range(7000, 7040)]
    got = dict(graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {n: 0 if n < 7000 else 7000 for e in edges for n in e}


def test_a_write_that_stops_loses_nothing(spark, tmp_path, monkeypatch):
    """Whatever step fails, readers find the last whole version, and the next write goes on from it."""
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "k string, v int, ts int")
    seen = lambda: sorted(tuple(r) for r in versions.read_table(spark, path).collect())
    assert versions.read_table(spark, path) is None
    sinks.upsert(spark, path, rows(("a", 1, 1)), "k", "ts")
    for step in ("_mark", "_forget"):
        with monkeypatch.context() as m:
            m.setattr(versions, step, lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                sinks.upsert(spark, path, rows(("a", 2, 2)), "k", "ts")
        assert seen() == ([("a", 1, 1)] if step == "_mark" else [("a", 2, 2)])
    reader = versions.read_table(spark, path)
    sinks.upsert(spark, path, rows(("b", 3, 3)), "k", "ts")
    assert seen() == [("a", 2, 2), ("b", 3, 3)] and sorted(tuple(r) for r in reader.collect()) == [("a", 2, 2)]
    for i in range(3):
        sinks.upsert(spark, path, rows(("b", i, 10 + i)), "k", "ts")
    have = versions.versions(spark, path)
    assert len(have) == versions.KEPT and seen() == [("a", 2, 2), ("b", 2, 12)]
    with pytest.raises(versions.Conflict):
        versions.write_table(spark, path, rows(("z", 1, 1)), have[-2])
    assert seen() == [("a", 2, 2), ("b", 2, 12)] and versions.read_table(spark, path, have[-2]).count() == 2
