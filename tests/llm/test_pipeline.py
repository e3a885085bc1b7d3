"""The pipeline's stages take effect, each on what its predecessor kept."""

import random
import zlib

import corpus_pipeline
import numpy as np

from caseloom.llm import mixing, registry

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = registry.table(spark, SF, "documents")
    columns, kept = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = registry.shared_folder(spark, name)
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and ids <= kept and ids, name
        kept = ids
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect())
    assert len(rows) == docs.count() and {r[1] for r in rows} == kept
    at = 0
    for (start, doc, n), before in zip(rows, [(0, -1, 0), *rows]):
        assert start == at and doc >= before[1]
        at += n


def planted(spark, folder):
    """Rows with null and repeated ids, and what each stage must leave of them, by the column ``n``."""
    rng = random.Random(13)
    text = lambda n=40: " ".join(f"w{rng.randrange(500)}" for _ in range(n)) + "."
    item, twin, shared = text(30), text(), text()
    rows = [(i, text() + (" awful. " if i % 4 == 0 else " ") + text()) for i in range(200)]
    toxic, copies, leaks = set(range(0, 200, 4)), set(), set()
    for group, id_, t in (
        (toxic, None, text() + " awful."), (None, None, text()), (None, None, twin), (copies, None, twin),
        (toxic, 500, text() + " awful."), (None, 500, text()), (None, 501, shared), (copies, 501, shared), (copies, 502, shared), (copies, None, shared),
        (leaks, None, text() + " " + item), (None, None, text()), (leaks, 503, text() + " " + item), (None, 503, text()), (None, None, None), (None, None, ""),
    ):
        if group is not None:
            group.add(len(rows))
        rows.append((id_, t))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, n long")
    return docs, toxic, copies, leaks


def test_null_and_repeated_ids(spark, tmp_path):
    docs, toxic, copies, leaks = planted(spark, tmp_path)
    assert len(copies) == 4 and len(leaks) == 2
    everything = set(range(docs.count()))
    for (name, stage), gone in zip(corpus_pipeline.STAGES, (toxic, copies, leaks)):
        out = stage(spark, docs.repartition(3), str(tmp_path)).select("n").collect()
        left = everything - {r.n for r in out}
        assert len(out) == len({r.n for r in out}) == len(everything) - len(gone), name
        if name == "ngram_jaccard":  # of rows that repeat an id and a text, either one stays
            twins, shared = {202, 203}, {206, 207, 208, 209}
            assert left <= twins | shared and len(left & twins) == 1 and len(left & shared) == 3 and {208, 209} <= left
        else:
            assert left == gone, name


def test_null_ids_are_their_own_component(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    from caseloom.llm import jaccard_join

    assert sorted(r.component_id or 0 for r in jaccard_join.near_duplicates(docs).collect()) == [0, 1]


def test_run_against_a_plain_version(spark, tmp_path):
    """All stages in a row: the documents that must stay, as often as plain sampling takes them, as the library encodes them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(21)
    words = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    item = words(25)
    texts = {i: words(30) + (". awful. " if i % 4 == 0 else ". ") + words(30) for i in range(160)}
    clean = [i for i in texts if i % 4]
    near = texts[1].split()
    near[7] = "edited"
    texts |= {200: texts[2], 201: " ".join(near), 202: texts[2].upper()}  # copies: whole, edited, in capitals
    texts |= {210: words(20) + " " + item, 211: words(5) + " " + " ".join(w for k, w in enumerate(item.split()) if k % 6)}  # leaks: whole, with words left out
    texts |= {220: words(3), 221: "", 222: None}
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stay = sorted([*clean, 220, 221, 222])
    keys = {r.doc_id: r for r in mixing.mix(spark.createDataFrame([r for r in rows if r[0] in stay], "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    times = {i: 1 for i in stay if not (texts[i] or "").split()}
    for source in {r.source for r in keys.values()}:
        mine = sorted((r for r in keys.values() if r.source == source), key=lambda r: r.key)
        size, target, upto = sum(r["size"] for r in mine), mine[0].target, 0
        epochs = int(target // size)
        rest = target - epochs * size
        for r in mine:
            if r["size"]:
                times[r.doc_id] = epochs + (rest > 0 and (upto + r["size"] <= rest or (upto < rest and upto + r["size"] - rest <= rest - upto)))
            upto += r["size"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for i in stay:
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        for _ in range(times[i]):
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len(want) > len(stay)


def test_empty_tables(spark, tmp_path):
    """Every stage takes tables without rows, and documents with columns of clashing names."""
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, __row long, block string, label int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.drop("__row").unionByName(spark.createDataFrame([(1, "a b", "en", "s", 3, "b", 1)], docs.drop("__row").schema))):
            out = stage(spark, rows, str(tmp_path))
            assert out.distinct().count() == rows.count(), name  # the mix takes the one document twice

