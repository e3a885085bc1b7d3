"""Vector code compression: product codes trained by Lloyd's rounds over heaps.

Vectors become integers, cut into ``PARTS`` equal parts; every part position has
a codebook of ``ENTRIES`` entries.  A round assigns each part to its nearest
entry and moves each entry to the floored mean of its parts.

*Heaps.*  In its block of vectors, a part waits in the heap of its entry.  Its
key is the slack: the distance of the second nearest entry less that of its own,
plus the drift that the entry's heap had gathered when it went in.  An entry's
drift grows in each round by its own movement and the greatest of the others'.
While a key is above the heap's drift, no other entry can be nearer or as near,
so only parts at the top of a heap, with keys that the drift has reached, are
popped, compared with all entries in integers, and pushed again.  A heap is an
ascending array, which is one whose top parts are a prefix.  Keys are rounded
down and compared with a margin, so rounding only causes needless rescans.

*On Spark.*  Vectors are packed into blocks once, in a table bucketed by block.
The heaps of a round are another table with the same buckets, so a round joins
the two in place, without a shuffle, and writes the next heaps; a lost task
reads both again.  Only the sums of each entry, a table of a fixed size for
each task, go on, and only their totals reach the driver.

Defined cases: vectors that are null or hold a null or non-finite component are
dropped; shorter vectors are filled with zeros up to the longest, and all to a
multiple of ``PARTS`` components; integers are clamped to 2**26 either way, so
that all sums fit; null ids are kept and come last in the order of ids, repeated
ids are rows of their own (the smaller vector first); with fewer rows than
``ENTRIES`` there are as many entries as rows; no rows give no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from caseloom.llm.frames import broadcast_if_few, checkpoint, estimated_bytes, only, shared_folder, shuffle_partitions

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of one block, bytes of a bucket of blocks, and the greatest component.
BLOCK_ROWS, BUCKET_BYTES, CLAMP = 1 << 15, 64 << 20, 1 << 26
#: Keys this near to the drift count as reached.
MARGIN = 1e-3

_BLOCKS = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("ints", pa.binary())])
BLOCKS = "block long, dim int, ids array<long>, labels array<string>, ints binary"
_HEAPS = pa.schema([("block", pa.int64()), ("rows", pa.binary()), ("keys", pa.binary()), ("heads", pa.binary()), ("sums", pa.binary()), ("popped", pa.int64())])
HEAPS = "block long, rows binary, keys binary, heads binary, sums binary, popped long"


def dense(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows without null and non-finite components, their values padded with zeros to the longest)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    parent = np.asarray(pa.compute.list_parent_indices(column), np.int64)
    flat = column.flatten()
    values = np.asarray(flat.fill_null(np.nan), float)
    bad = np.bincount(parent, weights=~np.isfinite(values), minlength=len(column)) > 0
    keep = np.flatnonzero(~bad & ~np.asarray(column.is_null()))
    lengths = np.bincount(parent, minlength=len(column))
    width = int(lengths[keep].max()) if len(keep) else 0
    if (lengths[keep] == width).all() and len(keep) == len(column):
        return keep, values.reshape(len(keep), width)
    place = np.arange(len(parent)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    slot = np.full(len(column), -1)
    slot[keep] = np.arange(len(keep))
    some = slot[parent] >= 0
    out = np.zeros((len(keep), width))
    out[slot[parent[some]], place[some]] = values[some]
    return keep, out


def floors(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * values), -CLAMP, CLAMP).astype(np.int32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, vector, label -> packed blocks of the kept vectors."""
    block, wait, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            keep, values = dense(part.column(1))
            if len(keep):
                wait.append((part.column(0).take(pa.array(keep)), part.column(2).take(pa.array(keep)), floors(values)))
                size += len(keep)
            if size >= BLOCK_ROWS:
                yield _block(block, wait)
                block, wait, size = block + 1, [], 0
    if wait:
        yield _block(block, wait)


def _block(block: int, wait: list[tuple]) -> pa.RecordBatch:
    dim = max(w[2].shape[1] for w in wait)
    ints = np.concatenate([np.pad(w[2], ((0, 0), (0, dim - w[2].shape[1]))) for w in wait])
    if not ints.size or np.abs(ints).max() < 1 << 15:
        ints = ints.astype(np.int16)
    ids, labels = (pa.concat_arrays([w[k].combine_chunks() if isinstance(w[k], pa.ChunkedArray) else w[k] for w in wait]).to_pylist() for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())), pa.array([ints.tobytes()], pa.binary())], schema=_BLOCKS)


def _unpacked(n: int, dim: int, ints: bytes, width: int) -> np.ndarray:
    """(vector, part, component), as 64-bit integers."""
    kind = np.int16 if len(ints) == 2 * n * dim else np.int32
    flat = np.frombuffer(ints, kind).reshape(n, dim)
    out = np.zeros((n, width), np.int64)
    out[:, :dim] = flat
    return out.reshape(n, PARTS, width // PARTS)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of the smallest ids of each block."""
    for batch in batches:
        for row in batch.to_pylist():
            flat = _unpacked(len(row["ids"]), row["dim"], row["ints"], PARTS * -(-max(row["dim"], 1) // PARTS)).reshape(len(row["ids"]), -1)
            first = sorted(range(len(flat)), key=lambda i: (row["ids"][i] is None, row["ids"][i] or 0, flat[i].tolist()))[:ENTRIES]
            yield pa.RecordBatch.from_arrays([pa.array([row["ids"][i] for i in first], pa.int64()), pa.array([flat[i].tolist() for i in first], pa.list_(pa.int64()))], names=["vec_id", "ints"])


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, squared distance, squared distance of the next nearest or inf) of each part; ties go to the lower entry."""
    far = np.empty((len(x), len(book)), np.int64)
    for e, entry in enumerate(book):
        apart = x - entry
        far[:, e] = np.einsum("ij,ij->i", apart, apart)
    entry = far.argmin(1)
    least = far[np.arange(len(x)), entry]
    if len(book) == 1:
        return entry, least, np.full(len(x), np.inf)
    far[np.arange(len(x)), entry] = np.iinfo(np.int64).max
    return entry, least, far.min(1).astype(float)


def slack(least: np.ndarray, second: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """Heap keys, rounded down to 32 bits."""
    key = np.sqrt(second) - np.sqrt(least.astype(float)) + drift
    low = key.astype(np.float32)
    return np.where(low > key, np.nextafter(low, np.float32(-np.inf)), low)


def assign(x: np.ndarray, book: np.ndarray, drift: np.ndarray, heaps: list[tuple[np.ndarray, np.ndarray]] | None, sums: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """One part position of a block: (the heaps (rows, keys) of each entry after the round, how many parts were popped).

    ``heaps`` is None before the first round; ``sums`` (entry; components and the number of parts) follows the moves.
    """
    n = len(book)
    empty = (np.zeros(0, np.int32), np.zeros(0, np.float32))
    if heaps is None:
        rest, who, was = [empty] * n, np.arange(len(x), dtype=np.int32), None
    else:
        cut = [int(np.searchsorted(keys, drift[e] + MARGIN, "right")) for e, (_, keys) in enumerate(heaps)]
        rest = [(rows[c:], keys[c:]) for c, (rows, keys) in zip(cut, heaps, strict=True)]
        who, was = np.concatenate([rows[:c] for c, (rows, _) in zip(cut, heaps, strict=True)]), np.repeat(np.arange(n), cut)
    entry, least, second = nearest(x[who], book)
    key = slack(least, second, drift[entry])
    moved = np.flatnonzero(entry != was) if was is not None else np.arange(len(who))
    ones = np.column_stack([x[who[moved]], np.ones(len(moved), np.int64)])
    np.add.at(sums, entry[moved], ones)
    if was is not None:
        np.subtract.at(sums, was[moved], ones)
    out = []
    for e, (rows, keys) in enumerate(rest):
        mine = np.flatnonzero(entry == e)
        mine = mine[np.argsort(key[mine], kind="stable")]
        place = np.searchsorted(keys, key[mine])
        out.append((np.insert(rows, place, who[mine]), np.insert(keys, place, key[mine])))
    return out, len(who)


def _loaded(row: dict, entries: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    rows, keys = np.frombuffer(row["rows"], np.int32).reshape(PARTS, -1), np.frombuffer(row["keys"], np.float32).reshape(PARTS, -1)
    heads = np.frombuffer(row["heads"], np.int32).reshape(PARTS, entries + 1).tolist()
    return [[(rows[p, a:b], keys[p, a:b]) for a, b in zip(heads[p][:-1], heads[p][1:], strict=True)] for p in range(PARTS)]


def _advance(row: dict, books: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, list, np.ndarray, int]:
    entries, width = books.shape[1:]
    x = _unpacked(len(row["ids"]), row["dim"], row["ints"], PARTS * width)
    old = _loaded(row, entries) if row.get("rows") is not None else [None] * PARTS
    sums = np.frombuffer(row["sums"], np.int64).reshape(PARTS, entries, width + 1).copy() if row.get("sums") is not None else np.zeros((PARTS, entries, width + 1), np.int64)
    heaps, popped = [], 0
    for p in range(PARTS):
        new, n = assign(x[:, p], books[p], drift[p], old[p], sums[p])
        heaps.append(new)
        popped += n
    return x, heaps, sums, popped


def _round(books: np.ndarray, drift: np.ndarray):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with their heaps -> the heaps after the round."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                _, heaps, sums, popped = _advance(row, books, drift)
                rows, keys = (np.concatenate([h[k] for part in heaps for h in part]) for k in (0, 1))
                heads = np.array([np.cumsum([0, *(len(h[0]) for h in part)]) for part in heaps], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in (rows, keys, heads, sums)), pa.array([popped], pa.int64())], schema=_HEAPS)

    return step


def _coded(books: np.ndarray, drift: np.ndarray):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with their heaps -> vec_id, label, code, error of every vector."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                x, heaps, _, _ = _advance(row, books, drift)
                code = np.empty((len(x), PARTS), np.uint8)
                for p, part in enumerate(heaps):
                    for e, (rows, _) in enumerate(part):
                        code[rows, p] = e
                apart = x - books[np.arange(PARTS), code]
                error = np.einsum("npk,npk->n", apart, apart)
                text = code.tobytes().hex()
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array([text[at : at + 2 * PARTS] for at in range(0, len(text), 2 * PARTS)], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return step


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task's blocks, a row for each number."""
    total = None
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            mine = np.frombuffer(blob, np.int64)
            total = mine.copy() if total is None else total + mine
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["slot", "value"])


def _bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """The rows as a table in the shared folder, bucketed by block; its name is needed only to write it."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", shared_folder(spark, name)).bucketBy(buckets, "block").saveAsTable(table)
    rows = spark.table(table)
    rows.schema  # found before the name goes; the files stay
    spark.sql(f"DROP TABLE {table}")
    return rows


def heap_lloyd(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label", rounds: int = ROUNDS, popped: list[int] | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label as text, code, error of every kept vector; the codebooks: part, entry, component).

    ``popped`` takes the number of parts that each round compares with all entries.
    """
    base = only(vectors, vec_id=id_col, vector=vector_col, label=label_col).select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>"), F.col("label").cast("string"))
    spark = base.sparkSession
    buckets = min(100_000, max(shuffle_partitions(spark), estimated_bytes(base) // BUCKET_BYTES if estimated_bytes(base) < 1 << 55 else 0))
    blocks = _bucketed(base.mapInArrow(_blocks, BLOCKS).repartition(buckets, "block"), "blocks", buckets)
    dim = blocks.agg(F.max("dim")).first()[0]
    seeds = [r["ints"] for r in blocks.mapInArrow(_seeds, "vec_id long, ints array<long>").orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(ENTRIES).collect()]
    width = -(-max(dim or 1, 1) // PARTS)
    books = np.zeros((len(seeds), PARTS * width), np.int64)
    for e, ints in enumerate(seeds):
        books[e, : len(ints)] = ints
    books = np.ascontiguousarray(books.reshape(len(seeds), PARTS, width).transpose(1, 0, 2))
    drift = np.zeros(books.shape[:2])
    if not seeds:
        return spark.createDataFrame([], "vec_id long, label string, code string, error long"), books
    heaps = None
    for _ in range(rounds):
        met = blocks if heaps is None else blocks.join(heaps.hint("merge"), "block")
        heaps = _bucketed(met.mapInArrow(_round(books, drift), HEAPS), "heaps", buckets)
        if popped is not None:
            popped.append(heaps.agg(F.sum("popped")).first()[0])
        found = heaps.select("sums").mapInArrow(_totals, "slot int, value long").groupBy("slot").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("total")).collect()  # one row for each number of the codebooks
        total = np.zeros(PARTS * len(seeds) * (width + 1), object)
        for r in found:
            total[r["slot"]] = int(r["total"])
        books, drift = moved(books, total.reshape(PARTS, len(seeds), width + 1), drift)
    met = blocks if heaps is None else blocks.join(heaps.hint("merge"), "block")
    return met.mapInArrow(_coded(books, drift), "vec_id long, label string, code string, error long"), books


def moved(books: np.ndarray, total: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codebooks after an update, drift of each entry's heap); unused entries stay."""
    new = books.copy()
    for p, e in zip(*np.nonzero(total[:, :, -1]), strict=True):
        new[p, e] = [int(s) // int(total[p, e, -1]) for s in total[p, e, :-1]]
    step = np.sqrt(((new - books).astype(float) ** 2).sum(2))
    other = np.zeros_like(step)
    for e in range(step.shape[1]):
        other[:, e] = np.delete(step, e, 1).max(1, initial=0)
    return new, drift + step + other


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def compressed(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    codes, books = heap_lloyd(vectors, vector_col, id_col, label_col, rounds)
    codes = checkpoint(codes)
    of_label = broadcast_if_few(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    met = codes.join(of_label, F.col("label").eqNullSafe(F.col("of")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """The codes' rows with the vectors that they stand for, a component in the middle of its step."""
    flat = ((books + 0.5) / SCALE).tolist()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("code")).to_pylist()
            vectors = [[x for p, e in enumerate(bytes.fromhex(t)) for x in flat[p][e]] for t in text]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*batch.schema.names, "decoded"])

    return codes.mapInArrow(decode, ", ".join(f"`{n}` {t}" for n, t in codes.dtypes) + ", decoded array<double>")


def _sql() -> str:
    """Plain Lloyd rounds, unrolled."""
    far = "list_sum([z[1] * z[1] FOR z IN [[x[i] - c[i]] FOR i IN range(1, len(x) + 1)]])"
    out = [
        f"v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rn, vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        f"p AS MATERIALIZED (SELECT rn, k, list_slice(q, k * (len(q) // {PARTS}) + 1, (k + 1) * (len(q) // {PARTS})) AS x FROM v, range({PARTS}) t(k))",
        f"c0 AS MATERIALIZED (SELECT k, rn - 1 AS e, x AS c FROM p WHERE rn <= {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT rn, k, any_value(x) AS x, min({{'d': {far}, 'e': e}}) AS best FROM p JOIN c{r} USING (k) GROUP BY rn, k)")
        if r < ROUNDS:
            out.append(f"m{r} AS (SELECT k, e, list(y ORDER BY i) AS c FROM (SELECT k, best.e AS e, i, floor(sum(x[i]) / count(*))::BIGINT AS y FROM a{r}, range(1, 1 + (SELECT max(len(x)) FROM p)) t(i) GROUP BY ALL) GROUP BY k, e)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT k, e, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k, e))")
    out.append(f"coded AS (SELECT rn, string_agg(printf('%02x', best.e), '' ORDER BY k) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rn)")
    out.append(f"named AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM c{ROUNDS})")
    return "WITH " + ",\n".join(out) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN coded USING (rn), named"


SQL = _sql()
