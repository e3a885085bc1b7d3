"""Names in texts against one pattern a name; calls that fail, wait and are cached."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from caseloom.operators import calls, phrases


def fold(t):
    return "".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c)).lower()


@pytest.mark.parametrize("size", [phrases.SLICE, 3])
def test_phrases_equal_patterns(spark, size):
    rng = random.Random(1)
    words = ["río", "RIO", "la", "cima", "s.a", "gold-fields", "x", "mina2", "mina", "ñ"]
    names = [" ".join(rng.sample(words, rng.randrange(1, 4))) for _ in range(30)] + ["Río", "rio", "mina", "s.a", ".x", ""]
    texts = [None, "", "minas", "la mina.", "mina2 mina", "la-cima"] + [rng.choice([" ", "  ", ", "]).join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    got = phrases.phrase_hits(spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3), "id", "t", spark.createDataFrame([(n,) for n in names], "name string"), slice_size=size)
    want = set()
    for i, t in enumerate(texts):
        for n in {fold(n) for n in names if re.match("[a-z0-9_]", fold(n))}:
            m = re.search(rf"\b{re.escape(n)}(?![a-z0-9_])" if re.search("[a-z0-9_]$", n) else rf"\b{re.escape(n)}", fold(t), re.ASCII)
            if m:
                want.add((i, n, m.start()))
    assert {tuple(r) for r in got.collect()} == want


def test_many_names_in_one_pass(spark):
    names = spark.range(100_000).select(F.concat(F.lit("pueblo "), F.col("id").cast("string")).alias("name"))
    rows = spark.range(2000).select("id", F.concat(F.lit("Cerca de PUEBLO "), (F.col("id") * 37).cast("string"), F.lit(" y pueblo 5, no pueblo 5x")).alias("t"))
    got = phrases.phrase_hits(rows, "id", "t", names).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == 2000 and all(r.n == (2 if r.id * 37 < 100_000 else 1) for r in got)


def test_owner_hits_fall_back_to_the_place(spark):
    names = spark.createDataFrame([("A", "San Juan", 2), ("A", "Río Seco", 1), ("A", "Lima", 3), ("B", "Lima", 1)], "mina string, name string, rank int")
    rows = spark.createDataFrame([(1, "A", "cerca de lima, san juan y rio seco", "x"), (2, "B", "san juan", " calle   dos "), (3, "C", "lima", None)], "id long, mina string, t string, lugar string")
    got = {r.id: r.places for r in phrases.owner_hits(rows, "id", "mina", "t", names, most=2, place="lugar").collect()}
    assert got == {1: "Río Seco; San Juan", 2: "calle dos", 3: ""}
    hits = phrases.phrase_hits(rows, "id", "t", names)
    assert {r.id: r.name for r in phrases.longest_hit(hits, "id").collect()} == {1: "rio seco", 2: "san juan", 3: "lima"}


def flaky(fails):
    """A service that fails so often before it answers."""
    state = {}

    def call(request):
        state[request] = state.get(request, 0) + 1
        if request == "never":
            raise calls.GiveUp("refused")
        if request == "down" or state[request] <= fails:
            raise TimeoutError("busy")
        return request.upper()

    return call


def test_waits_grow_and_end():
    waits = []
    assert calls.attempt(flaky(2), "a", 4, 1.0, 2.0, 60.0, waits.append) == ("A", None, 3)
    assert len(waits) == 2 and 0.5 <= waits[0] <= 1 <= waits[1] <= 2
    assert calls.attempt(flaky(9), "a", 3, 1.0, 10.0, 5.0, waits.append) == (None, "busy", 3) and max(waits) <= 5
    assert calls.attempt(flaky(0), "never", 3, 1.0, 2.0, 60.0, waits.append) == (None, "refused", 1)


def test_answers_cache_and_error_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "down"), (4, "never"), (5, "known"), (6, None)], "id long, q string")
    _, first = calls.enriched(rows.filter("q = 'known'"), "q", None, lambda r: "old", sleep=lambda s: None)
    out, new = calls.enriched(rows, "q", first, flaky(1), sleep=lambda s: None, parallel=1)
    got = {r.id: (r.answer, r.error, r.cached) for r in out.collect()}
    assert got == {1: ("A", None, False), 2: ("A", None, False), 3: (None, "busy", False), 4: (None, "refused", False), 5: ("old", None, True), 6: ("", None, False)}
    assert sorted((r.answer or "", r.error or "") for r in new.collect()) == [("", ""), ("", "busy"), ("", "refused"), ("A", "")]
    forced, _ = calls.enriched(rows.filter("id = 5"), "q", first, flaky(0), force=True, sleep=lambda s: None)
    assert [r.answer for r in forced.collect()] == ["KNOWN"]
    some, new = calls.enriched(rows, "q", None, flaky(0), limit=2, sleep=lambda s: None)
    assert new.count() == 2 and some.count() == 6
