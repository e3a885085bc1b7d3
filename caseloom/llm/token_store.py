"""Token-ID output as a content-addressed store.

Every document is encoded and closed with an end id.  A rolling hash over the
last ids cuts the id stream into chunks; a chunk is named by the SHA-256 of its
bytes and stored once, however many documents hold it.  Recipes list, in
ascending document order, the chunks of every document.  A Merkle manifest
covers the store.  Reading goes only through those files, verifies every chunk
against its name and the chunks against the manifest.

Layout of a store folder (all Parquet, written and read by Spark):

* ``chunks/``   digest, ids (little-endian, 2 bytes an id if all fit, else 4), wide
* ``recipes/``  part, ordinal, doc_id, n_tokens, digests: ascending by (part, ordinal)
* ``manifest/`` shard, n_chunks, root: Merkle root of the sorted chunk names of each
  shard (the first two hex digits), and shard ``root`` over those

Defined cases: a null text is an empty one and gives just the end id; repeated
rows each keep a recipe; null ids come first; no rows give empty tables; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from caseloom.llm import kernels as K
from caseloom.llm.frames import checkpoint, only

END_ID = 1
#: Chunk borders: a window of ids, a mean length (a power of two) and hard limits.
WINDOW, MEAN_IDS, LEAST_IDS, MOST_IDS = 16, 2048, 256, 16384
#: Slots of a worker's encoding cache (22 bytes each, 46 MB), the words kept in it, and the bytes of their ids and of the
#: dictionary; beyond them the cache starts anew.
CACHE_SLOTS, CACHE_BYTES = 1 << 21, 64 << 20
CACHE_WORDS = CACHE_SLOTS * 3 // 4
#: Words that go to the library in one text, with a special token between them.
JOINED = 200
#: Words up to this many bytes are found by their own bytes in arrays, longer ones in a dictionary (what an entry takes
#: there besides its bytes), and words of unspaced text, longer still, are encoded wherever they come.
ARRAY_WORD, DICTIONARY_WORD, ENTRY_BYTES = 16, 64, 240
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 8 << 20


class WordEncoder:
    """The library's ids of whole texts, each distinct word encoded once.

    The vocabulary's normaliser and splitter never look across white space, so a
    text's ids are the ids of its white-space separated words in turn.  Words
    are found in an open-addressed table of arrays that holds their very bytes
    (``ARRAY_WORD`` of them; longer words are keys of a dictionary, very long
    ones are not kept), a slice of a batch at a time; the library sees only
    those that are not there yet.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        plain = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.border = max(plain, default=None)
        self.clear()

    def clear(self) -> None:
        """Forget all words and give the tables back."""
        self.low = self.high = np.zeros(0, np.uint64)
        self.size, self.first, self.length = np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.pool, self.used, self.words = np.zeros(0, np.uint32), 0, 0
        self.long: dict[bytes, tuple[int, int]] = {}
        self.long_bytes = 0

    def held(self) -> int:
        """Bytes of the ids and of the dictionary."""
        return self.long_bytes + 4 * self.used

    def _open(self) -> None:
        slots = CACHE_SLOTS
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.size, self.first, self.length = np.zeros(slots, np.uint8), np.zeros(slots, np.int32), np.zeros(slots, np.uint8)
        self.pool = np.zeros(1 << 16, np.uint32)

    def _find(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The slot of each word: where it is, or the free one where it would be."""
        mask = len(self.low) - 1
        slot = (K.mix(low ^ K.mix(high + n.astype(np.uint64))) & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(low))
        while len(left):
            at = slot[left]
            there = self.size[at]
            left = left[(there != 0) & ((there != n[left]) | (self.low[at] != low[left]) | (self.high[at] != high[left]))]
            slot[left] = (slot[left] + 1) & mask
        return slot

    def _pooled(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids begin in the pool, and their number."""
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        first = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        self.words += len(lengths)
        return first, lengths

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _library(self, told: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of the words.

        A special token ends what stands before it, so words with one between
        them are encoded as if alone, in fewer calls.  Where the border does not
        come out as often as it went in, a word held it, and each goes alone.
        """
        step = JOINED if self.border else 1
        groups = [told[at : at + step] for at in range(0, len(told), step)]
        flat, lengths = [], []
        joined = self._ids([(self.border[1] if self.border else "").join(g) for g in groups])
        for group, ids in zip(groups, joined, strict=True):
            ids = np.array(ids, np.uint32)
            cuts = np.flatnonzero(ids == self.border[0]) if self.border else np.zeros(0, np.int64)
            if len(cuts) == len(group) - 1:
                edges = np.concatenate([[-1], cuts, [len(ids)]])
                flat.append(np.delete(ids, cuts))
                lengths.append(np.diff(edges) - 1)
            else:
                alone = self._ids(group)
                flat += [np.array(x, np.uint32) for x in alone]
                lengths.append(np.array([len(x) for x in alone], np.int64))
        return self._pooled(np.concatenate(flat), np.concatenate(lengths))

    def _short(self, view: memoryview, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self._find(low, high, n)
        new = np.flatnonzero(self.size[slot] == 0)
        if len(new):
            order = new[np.lexsort((n[new], high[new], low[new]))]
            other = np.ones(len(order), bool)
            other[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]) | (n[order][1:] != n[order][:-1])
            fresh = order[other]
            if self.words + len(fresh) > CACHE_WORDS and self.words:
                self.clear()
                self._open()
                return self._short(view, start, end, low, high, n)
            for at in range(0, len(fresh), 20_000):
                left = fresh[at : at + 20_000]
                first, length = self._library([str(view[a:b], "utf-8", "replace") for a, b in zip(start[left].tolist(), end[left].tolist(), strict=True)])
                while len(left):  # several may want one free slot: the first gets it
                    slot_of = self._find(low[left], high[left], n[left])
                    slots, got = np.unique(slot_of, return_index=True)
                    who = left[got]
                    self.low[slots], self.high[slots], self.size[slots] = low[who], high[who], n[who]
                    self.first[slots], self.length[slots] = first[got], length[got]
                    rest = np.ones(len(left), bool)
                    rest[got] = False
                    left, first, length = left[rest], first[rest], length[rest]
            slot = self._find(low, high, n)
        return self.first[slot], self.length[slot].astype(np.int64)

    def _slice(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in turn, number of ids of each word)."""
        if self.words > CACHE_WORDS or self.held() > CACHE_BYTES:
            self.clear()
        if not len(self.low):
            self._open()
        view = memoryview(data)
        low, high, n = K.word_names(data, start, end)
        short = np.flatnonzero(n <= ARRAY_WORD)
        first, length = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        first[short], length[short] = self._short(view, start[short], end[short], low[short], high[short], n[short])
        for i, found in self._long(view, start, end, np.flatnonzero((n > ARRAY_WORD) & (n <= DICTIONARY_WORD)).tolist()):
            first[i], length[i] = found
        used, words = self.used, self.words
        for i, found in self._alone(view, start, end, np.flatnonzero(n > DICTIONARY_WORD).tolist()):
            first[i], length[i] = found
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(first - (ends - length), length) + np.arange(total)]
        self.used, self.words = used, words  # what is not kept leaves the pool
        return ids, length

    def _long(self, view: memoryview, start: np.ndarray, end: np.ndarray, far: list[int]) -> Iterator[tuple[int, tuple[int, int]]]:
        """Of words in the dictionary: (word, (where its ids begin, their number))."""
        words = [bytes(view[start[i] : end[i]]) for i in far]
        fresh = [w for w in dict.fromkeys(words) if w not in self.long]
        if fresh:
            self.long.update(zip(fresh, self._told(fresh), strict=True))
            self.long_bytes += sum(map(len, fresh)) + ENTRY_BYTES * len(fresh)
        return zip(far, (self.long[w] for w in words), strict=True)

    def _alone(self, view: memoryview, start: np.ndarray, end: np.ndarray, far: list[int]) -> Iterator[tuple[int, tuple[int, int]]]:
        """Of words that are not kept, the same; equal ones of the slice once."""
        words = [bytes(view[start[i] : end[i]]) for i in far]
        fresh = list(dict.fromkeys(words))
        return zip(far, map(dict(zip(fresh, self._told(fresh), strict=True)).__getitem__, words), strict=True)

    def _told(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        return zip(*(x.tolist() for x in self._library([w.decode("utf-8", "replace") for w in words])), strict=True) if words else iter(())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, where each text's ids begin, with the end)."""
        data, offsets = K.text_buffers(texts)
        start, end, counts = K.word_spans(data, offsets)
        cuts = np.flatnonzero(np.diff(end // SLICE_BYTES + np.arange(len(end)) // max(1, CACHE_WORDS // 2), prepend=-1)).tolist()
        done = [self._slice(data, start[a:b], end[a:b]) for a, b in zip(cuts, [*cuts[1:], len(start)], strict=True)]
        if not done:
            return np.zeros(0, np.uint32), np.zeros(len(counts) + 1, np.int64)
        ends = np.cumsum(np.concatenate([d[1] for d in done]))
        return np.concatenate([d[0] for d in done]), np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]


_TOKENIZERS: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """One encoder a worker process, so that later tasks find the words of earlier ones."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordEncoder(path)
    return _TOKENIZERS[path]


def borders(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the last WINDOW ids allows a chunk to end, in a whole batch of streams."""
    hashes = K.rolling(K.mix(ids.astype(np.uint64) + np.uint64(1)), WINDOW)
    return np.flatnonzero((hashes & np.uint64(MEAN_IDS - 1)) == 0) + WINDOW


def cut_points(start: int, end: int, ends: np.ndarray) -> list[int]:
    """Ends of the content-defined chunks of the stream from start to end; its chunks depend on nothing outside it."""
    inside = ends[np.searchsorted(ends, start + WINDOW) : np.searchsorted(ends, end)].tolist() if end - start > LEAST_IDS else []
    out, last = [], start
    for e in [*inside, end]:
        while e - last > MOST_IDS:
            last += MOST_IDS
            out.append(last)
        if e - last >= LEAST_IDS or (e == end and e > last):
            out.append(e)
            last = e
    return out


CHUNK_ROWS = "doc_id long, seq long, pos int, n int, n_tokens long, digest binary, ids binary, wide boolean"


def _chunks(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = encoder_for(path)
    seq = 0
    schema = pa.schema([("doc_id", pa.int64()), ("seq", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("n_tokens", pa.int64()), ("digest", pa.binary()), ("ids", pa.binary()), ("wide", pa.bool_())])
    seen: set[bytes] = set()
    for batch in K.parts(batches, 1):
        rows: list[tuple] = []
        size = 0
        every, bounds = encoder.encode(batch.column(1))
        closed = np.insert(every, bounds[1:], end_id).astype("<u4", copy=False)
        ends = borders(closed)
        bounds = bounds + np.arange(len(bounds))  # an end id more for every document before
        for doc, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            last = a
            for pos, stop in enumerate(cut_points(a, b, ends)):
                part = closed[last:stop]
                wide = bool(part.max() > 0xFFFF)
                raw = part.tobytes() if wide else part.astype("<u2").tobytes()
                digest = hashlib.sha256(part.tobytes()).digest()
                if digest in seen:  # already sent by this task
                    raw = None
                elif len(seen) < 200_000:
                    seen.add(digest)
                rows.append((doc, seq, pos, len(part), b - a, digest, raw, wide))
                size += len(raw or b"")
                last = stop
            seq += 1
            if size > 2 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)
    seen.clear()
    K.give_back()


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id", end_id: int = END_ID) -> str:
    """Encode ``docs`` into a store at ``folder``; returns the folder."""
    spark = docs.sparkSession
    base = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    made = base.mapInArrow(lambda b: _chunks(b, tokenizer_path, end_id), CHUNK_ROWS).withColumn("task", F.spark_partition_id())
    made.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/staged")
    staged = spark.read.parquet(f"{folder}/staged")
    # One task's copies are already one; of the rest, the one with the least (task, seq, pos) is stored.
    rank = F.struct("task", "seq", "pos")
    owned = staged.filter("ids is not null")
    owners = owned.groupBy("digest").agg(F.min(rank).alias("owner"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    twins = owners.select(F.col("digest").alias("d"), "owner")
    kept = owned.join(twins, F.col("digest") == F.col("d"), "left").filter("owner is null or owner = struct(task, seq, pos)")
    kept.select("digest", "ids", "wide").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/chunks")
    docs_of = staged.groupBy("task", "seq").agg(F.first("doc_id", ignorenulls=False).alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"]).alias("digests"))
    ordered = docs_of.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("task"), F.col("seq")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "task", "seq")
    ordered.select(F.spark_partition_id().alias("part"), (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("ordinal"), "doc_id", "n_tokens", "digests").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/recipes")
    _manifest(spark, folder).write.mode("overwrite").parquet(f"{folder}/manifest")
    _drop(spark, f"{folder}/staged")
    return folder


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Merkle roots: leaves are chunk names in order, 256 x 256 shards below 256 shards below one root."""
    names = spark.read.parquet(f"{folder}/chunks").select(F.hex("digest").alias("name"))
    leaves = names.groupBy(F.substring("name", 1, 6).alias("leaf")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("name")), ""), 256).alias("root"), F.count(F.lit(1)).alias("n_chunks"))
    for digits in (4, 2):
        leaves = leaves.groupBy(F.substring("leaf", 1, digits).alias("up")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "root"))), lambda x: x["root"]), ""), 256).alias("root"), F.sum("n_chunks").alias("n_chunks")).withColumnRenamed("up", "leaf")
    shards = leaves.select(F.col("leaf").alias("shard"), "n_chunks", "root")
    top = shards.agg(F.sum("n_chunks").alias("n_chunks"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shard", "root"))), lambda x: x["root"]), ""), 256).alias("root"))
    return shards.unionByName(top.select(F.lit("root").alias("shard"), "n_chunks", "root"))


def verify_store(spark: SparkSession, folder: str) -> bool:
    """Whether the manifest in the store is the one that its chunks give."""
    told, found = spark.read.parquet(f"{folder}/manifest"), _manifest(spark, folder)
    return told.exceptAll(found).isEmpty() and found.exceptAll(told).isEmpty()


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stored chunk, after comparing it with its name: length and CRC-32 over 4-byte ids."""
    for batch in batches:
        names, ns, crcs = [], [], []
        for digest, raw, wide in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = np.frombuffer(raw, "<u4") if wide else np.frombuffer(raw, "<u2").astype("<u4")
            if hashlib.sha256(ids.tobytes()).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} does not match its name")
            names.append(digest)
            ns.append(len(ids))
            crcs.append(zlib.crc32(ids.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])


def _times(m: list[int], v: int) -> int:
    out = i = 0
    while v:
        if v & 1:
            out ^= m[i]
        v >>= 1
        i += 1
    return out


class CrcJoin:
    """CRC-32 of joined byte strings from the parts' CRCs: appending n zero bytes is a linear map over bits."""

    def __init__(self):
        one_bit = [0xEDB88320] + [1 << i for i in range(31)]
        self.squares = [one_bit]
        for _ in range(3):
            self._square()
        self.squares = self.squares[3:]  # the first is now for one byte
        self.known: dict[int, list[int]] = {}

    def _square(self) -> None:
        m = self.squares[-1]
        self.squares.append([_times(m, x) for x in m])

    def _zeros(self, n: int) -> list[int]:
        if n not in self.known:
            m, i, left = [1 << b for b in range(32)], 0, n
            while left:
                while len(self.squares) <= i:
                    self._square()
                if left & 1:
                    m = [_times(self.squares[i], x) for x in m]
                left >>= 1
                i += 1
            if len(self.known) < 20_000:
                self.known[n] = m
            return m
        return self.known[n]

    def __call__(self, a: int, b: int, n_b: int) -> int:
        return _times(self._zeros(n_b), a) ^ b


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    join = CrcJoin()
    for batch in batches:
        part, ordinal, doc, told, facts = (batch.column(i) for i in range(5))
        ns, crcs = [], []
        for parts in facts.to_pylist():
            crc = n = 0
            for p in parts:
                crc = join(crc, p["crc"], 4 * p["n"]) if n else p["crc"]
                n += p["n"]
            ns.append(n)
            crcs.append(crc)
        if ns != told.to_pylist():
            raise ValueError("a recipe's chunks do not have the length it tells")
        yield pa.RecordBatch.from_arrays([part, ordinal, doc, pa.array(ns, pa.int64()), pa.array(crcs, pa.int64())], names=["part", "ordinal", "doc_id", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 of every recipe.

    Each stored chunk is read once, where it lies, and checked; only its length
    and CRC travel.  Offsets add up a total for each recipe file part and a
    running sum within the part.
    """
    facts = spark.read.parquet(f"{folder}/chunks").mapInArrow(_facts, "digest binary, n long, crc long")
    recipes = spark.read.parquet(f"{folder}/recipes")
    wanted = recipes.select("part", "ordinal", "doc_id", "n_tokens", F.posexplode("digests").alias("pos", "digest"))
    met = wanted.join(facts, "digest", "left").groupBy("part", "ordinal").agg(F.first("doc_id", ignorenulls=False).alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "n", "crc"))), lambda x: F.struct(x["n"].alias("n"), x["crc"].alias("crc"))).alias("facts"))
    docs = met.mapInArrow(_joined, "part int, ordinal long, doc_id long, n_tokens long, ids_crc32 long")
    docs = checkpoint(docs)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = docs.groupBy("part").agg(F.sum("n_tokens").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("part").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    return docs.join(parts, "part").select("doc_id", (F.col("offset") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and the whole id list of every recipe, rebuilt from the chunks."""
    chunks = spark.read.parquet(f"{folder}/chunks")
    recipes = spark.read.parquet(f"{folder}/recipes").select("part", "ordinal", "doc_id", F.posexplode("digests").alias("pos", "digest"))

    def rebuilt(batches):
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                out.append([i for p in parts for i in np.frombuffer(p["ids"], "<u4" if p["wide"] else "<u2").tolist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    met = recipes.join(chunks, "digest").groupBy("part", "ordinal").agg(F.first("doc_id", ignorenulls=False).alias("doc_id"), F.array_sort(F.collect_list(F.struct("pos", "ids", "wide"))).alias("parts"))
    return met.select("doc_id", "parts").mapInArrow(rebuilt, "doc_id long, ids array<long>")
