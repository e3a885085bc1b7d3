"""Spelling variants against brute force and SQL."""

import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from caseloom.llm import registry, spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(count, factor=10):
    """Every row of the result for words with counts."""
    near = {w: [u for u in count if one_edit(w, u)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda u: (-count[u], u), default=None)
        form[w] = best if best is not None and count[best] >= factor * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return {tuple(r) for r in df.select(*COLUMNS).collect()}


def variants(seed, n=60, alphabet="abcé×"):
    rng = random.Random(seed)
    count = {}
    for _ in range(n):
        word = "".join(rng.choice(alphabet) for _ in range(rng.choice([7, 7, 8, 9, 12])))
        size = rng.choice([2, 30, 500, 20_000])
        count[word] = max(count.get(word, 2), size)
        for _ in range(rng.randrange(6)):
            at, c = rng.randrange(len(word)), rng.choice(alphabet)
            other = rng.choice([word[:at] + word[at + 1 :], word[:at] + c + word[at:], word[:at] + c + word[at + 1 :], word[: at + 1] + word[at:]])
            if len(other) >= 7:
                count.setdefault(other, max(2, size // rng.choice([1, 9, 10, 11, 40])))
                word = rng.choice([word, other])
    return count


@pytest.mark.parametrize("shard", [spelling.SHARD, 25, 1])
@pytest.mark.parametrize("seed,alphabet", [(1, "abcé×"), (2, "ab")])
def test_forms_against_all_pairs(spark, seed, alphabet, shard):
    """Also where every beginning has more words than a task takes and Spark merges node by node."""
    count = variants(seed, alphabet=alphabet)
    frame = spark.createDataFrame(list(count.items()), "word string, n long")
    assert rows_of(spelling.forms(frame, shard=shard)) == plain(count)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("ab", min_size=2, max_size=6), max_size=40), st.integers(0, 2))
def test_terminals_coincide_once_for_each_pair(words, depth):
    """Every pair one edit apart that shares the beginning, and no other, comes exactly once."""
    got = []
    for alike, shorter in spelling.merged(sorted(words), depth):
        got += [tuple(sorted((a, b))) for i, a in enumerate(alike) for b in (shorter or alike[i + 1 :])]
    want = sorted((a, b) for a in words for b in words if a < b and one_edit(a, b) and a[:depth] == b[:depth] and len(a[:depth]) == len(b[:depth]) == depth)
    assert sorted(got) == want


def test_texts(spark):
    """Runs of whole texts, A-Z lower-cased only, slips by id, counts over repeated rows, odd and very long texts."""
    rng = random.Random(3)
    base = ["Abrigado", "abrigada", "ÀBRIGADO", "señorial", "senorial", "kurzwort", "straße×÷", "x" * 5000, "x" * 4999, "short"]
    texts = [None, "", " \n", "123 456"] + [" ".join(rng.choice(base) + rng.choice(["", "1", ",", "\n"]) for _ in range(rng.randrange(1, 300))) for _ in range(60)] * 2 + [" ".join(["abrigado"] * 50_000)]
    rows = [(None if i % 11 == 0 else i % 50, t, 1) for i, t in enumerate(texts)]
    count = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] = count.get(run, 0) + 1
    frame = spark.createDataFrame(rows, "doc_id long, text string, word int").withColumn("n", F.lit(1)).withColumn("head", F.lit("h")).repartition(3)
    assert rows_of(spelling.spelling_variants(frame, changed=spelling.slip)) == plain({w: n for w, n in count.items() if n >= 2})


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(empty, changed=spelling.slip).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == []


def test_chains_of_forms(spark):
    """A root is the last of a chain as long as counts allow."""
    words = ["aaaaaaaa" + "b" * i for i in range(8)]
    frame = spark.createDataFrame([(w, 2 * 10**i) for i, w in enumerate(words)], "word string, n long")
    got = {r.word: (r.form, r.root) for r in spelling.forms(frame).collect()}
    assert got == {w: (words[i + 1] if i < 7 else None, words[7]) for i, w in enumerate(words)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    got = registry.op12_spelling_variants(spark, f"/root/testdata/{sf}")
    want = con.execute(spelling.SQL)
    assert sorted(got.columns) == sorted(d[0] for d in want.description) == sorted(COLUMNS)
    names = [d[0] for d in want.description]
    assert {tuple(r) for r in got.select(*names).collect()} == set(want.fetchall())
