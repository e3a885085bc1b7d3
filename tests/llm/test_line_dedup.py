"""Lines that cannot be similar seldom meet, and the table of ranks stays out of the rows."""

import random

from caseloom.llm import line_dedup


def test_few_sets_meet(spark, monkeypatch):
    """Rare words come first however rare they are, and lines of other sizes have other keys for common ones."""
    rng = random.Random(4)
    words = [f"w{i:05d}" for i in range(60_000)]
    weights = [1 / (i + 5) for i in range(len(words))]
    lines = [" ".join(rng.choices(words, weights, k=rng.randrange(8, 120))) for _ in range(4_000)]
    lines += [x + " extra" for x in lines[:40]]
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    met, described, plans, pairs = line_dedup._met, line_dedup.described, [], []

    def seen_met(one, two, *more):
        if not pairs:
            counts = [side.groupBy("key").count().withColumnRenamed("count", f"n{i}") for i, side in enumerate((one, two))]
            pairs.append(counts[0].join(counts[1], "key").selectExpr("sum(n0 * n1)").first()[0])
        return met(one, two, *more)

    def seen_described(*given):
        plans.append(described(*given))
        return plans[-1]

    monkeypatch.setattr(line_dedup, "_met", seen_met)
    monkeypatch.setattr(line_dedup, "described", seen_described)
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(frame).collect()}
    assert [i for i, n in got.items() if n] and all(got[4_000 + i] for i in range(40))
    assert " AS ranks" not in plans[0]._jdf.queryExecution().executedPlan().toString()
    assert pairs[0] < 110_000, pairs
