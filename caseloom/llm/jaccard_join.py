"""N-gram Jaccard join: near-duplicate classes of word-shingle sets, exactly.

Sets are reduced to classes of equal sets first; only a class's least document
goes on.  Candidates come from parity sketches:

*Sketch.*  A set in size band b is hashed into ``parts(b)`` segments of a bit
sketch: a shingle goes to one segment and toggles one of its 2**64 bits, so the
Hamming distance of two sketches, and the number of segments that differ, is at
most the symmetric difference.  A segment is sent as the XOR of its shingles'
hashes.

*Pigeonhole.*  Sets of sizes a <= b with Jaccard >= 0.8 differ in at most
(a + b) / 9 shingles.  In band b (sizes up to r) that is t = 2r/9; at least
parts - t segments agree.  Each set works in its own band and, if a set there
can still be near enough, in the next one.  Empty segments say nothing: a set
whose empty segments alone could be the agreeing ones uses them too, any other
set leaves them out.  Sets of up to ``SMALL`` shingles have too few segments for
that: there each shingle is a segment of its own, and at least 80 % of them agree.

*Rarity prefix.*  If a set has K segments in use and g = parts - t - (empty and
unused ones) must agree, then any K - g + 1 of them contain an agreeing one; all
sets take the rarest by one global order (count, hash).  The counts come from a
first round over blocks of documents, like those of the substring operator.
Segments seen once anywhere find no partner, so most sets send nothing more.

*Distance.*  A segment is sent with the set's size and a 256-bit parity sketch.
Two sets that share a segment are candidates only if those allow 0.8; within
groups of one segment above ``CROWD`` small sets are compared with those that
agree in a piece of the sketch (one of the pieces must), larger ones all stay
candidates.

*Verification.*  Candidates form loose clusters (union-find in each hash range,
then star contraction).  A cluster is compared inside tasks of bounded size.  A
large one is first compared, chunk by chunk, with one chunk of it; only what that
leaves outside its greatest component meets all others, in tiles of two chunks.
Dense parity sketches bound the distance from below, what they leave is
intersected exactly, and each task returns a spanning forest of its links only.
Components of those forests are the components of all links.

Shingles are identified by 64-bit hashes of which 61 bits are independent,
classes by two of them and the size.

Defined cases: a null, empty or blank text has an empty set and links with
nothing; a text of fewer words than a shingle is one shingle; repeated rows are
members of one class; null ids take part in no class and are their own
component (null); texts that share an id are nodes of one name, so what one of
them links with, all do; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.llm import kernels as K
from caseloom.llm.frames import blocks_for, broadcast_if_few, checkpoint, cores, numbered, only, shuffle_partitions, spread
from caseloom.operators.graph import connected_components

SHINGLE, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Size bands grow by this factor; a band of sizes up to r has about r / SEGMENT segments.
GROWTH, SEGMENT = 1.25, 3.5
#: Sets of up to so many shingles have their shingles for segments (band SHINGLES).
SMALL, SHINGLES = 128, -1
#: Members and bytes of one comparison chunk; a task compares two chunks at most.
CHUNK, CHUNK_BYTES = 1500, 8 << 20
#: 64-bit words of the sketch that decides links and of the one that travels.
SKETCH_WORDS, SENT_WORDS = 32, 4
#: Sets with one segment in common are compared pair by pair up to this number.
CROWD = 4096
#: Groups up to this size are compared all at once, step by step.
FEW = 128

_U = np.uint64


def _bands() -> np.ndarray:
    tops, top = [], 1
    while top < 1 << 40:
        tops.append(top)
        top = max(top + 1, int(top * GROWTH))
    return np.array(tops, np.int64)


TOPS = _bands()


def linked(both: np.ndarray | int, union: np.ndarray | int):
    return DENOMINATOR * both >= NUMERATOR * union


def most_apart(total):
    """The greatest symmetric difference of two linked sets whose sizes add up to ``total``."""
    return (DENOMINATOR - NUMERATOR) * total // (DENOMINATOR + NUMERATOR)


def sketch_shape(band: int) -> tuple[int, int]:
    """(segments, greatest distance) of a size band."""
    top = int(TOPS[band])
    apart = int(most_apart(2 * top))
    return max(apart + 1, int(top / SEGMENT) + 1), apart


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingle hashes of each text, ascending."""
    data, offsets = K.text_buffers(column)
    start, end, counts = K.word_spans(data, offsets)
    words = K.word_hashes(data, start, end, lower=True)
    n = len(counts)
    owner = np.repeat(np.arange(n), np.maximum(counts - SHINGLE + 1, 0))
    at = K.window_starts(counts, SHINGLE)
    hashes = K.rolling(words, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64)
    first = np.cumsum(counts) - counts
    for length in range(1, SHINGLE):  # short texts: the whole sequence
        docs = np.flatnonzero(counts == length)
        if len(docs):
            value = K.rolling(words, length)[first[docs]]
            hashes = np.concatenate([hashes, K.mix(value ^ _U(length * 0x9E3779B97F4A7C15 & (2**64 - 1)))])
            owner = np.concatenate([owner, docs])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(n + 1))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, set size and two 64-bit names of the set."""
    for batch in K.parts(batches, 1):
        hashes, bounds = shingle_sets(batch.column(1))
        sums = np.concatenate([[_U(0)], np.cumsum(K.mix(hashes ^ _U(0xA0761D6478BD642F)), dtype=np.uint64)])
        more = np.concatenate([[_U(0)], np.cumsum(K.mix(hashes + _U(0xE7037ED1A0B428DB)), dtype=np.uint64)])
        a = (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)
        b = (more[bounds[1:]] - more[bounds[:-1]]).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(a), pa.array(b)], names=["doc_id", "n", "a", "b"])


def segments(shingles: np.ndarray, band: int) -> tuple[np.ndarray, int]:
    """(signatures of the segments in use, how many of them must agree with a linked set's)."""
    if band == SHINGLES:
        return K.mix(shingles ^ _U(0x8EBC6AF09C88C6E3)), -(-NUMERATOR * len(shingles) // DENOMINATOR)
    parts, apart = sketch_shape(band)
    place = ((shingles >> _U(32)) * _U(parts)) >> _U(32)
    order = np.argsort(place, kind="stable")
    place = place[order].astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    value = np.bitwise_xor.reduceat(K.mix(shingles[order]), first)
    used = place[first]
    must = parts - apart
    empty = parts - len(used)
    if empty >= must:  # the agreeing segments could all be empty ones
        all_used = np.zeros(parts, np.uint64)
        all_used[used] = value
        used, value, must = np.arange(parts), all_used, 1  # a partner may have left its empty ones out
    else:
        must -= empty
    salt = _U((band + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    return K.mix(value ^ K.mix(used.astype(np.uint64) + salt)), must


def works_in(n: int) -> list[int]:
    """Bands of a set of n shingles: its own, and others where a linked set can be."""
    if n <= SMALL:
        return [SHINGLES]
    own = int(np.searchsorted(TOPS, n))
    bands = [own, own + 1] if DENOMINATOR * n >= NUMERATOR * (int(TOPS[own]) + 1) else [own]
    return [SHINGLES, *bands] if DENOMINATOR * SMALL >= NUMERATOR * n else bands


def _signatures(table: pa.Table, chosen: set[int]):
    """Of the chosen documents of a block: rows, and for each the signatures of each band with how many must agree."""
    ids = table.column("doc_id").to_pylist()
    texts = table.column("text")
    seen: set[tuple] = set()
    for at in range(0, len(ids), 256):
        hashes, bounds = shingle_sets(texts.slice(at, 256))
        for i, doc in enumerate(ids[at : at + 256]):
            own = hashes[bounds[i] : bounds[i + 1]]
            if doc in chosen and len(own) and (name := (doc, len(own), int(own.sum(dtype=np.uint64)))) not in seen:
                seen.add(name)
                yield at + i, doc, own, [segments(own, band) for band in works_in(len(own))]


_ROWS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary()), ("extra", pa.binary())])
ROWS = "block int, bucket int, data binary, extra binary"


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _ROWS, strict=True)], schema=_ROWS)


def _chosen(marks: pa.Table) -> set[int]:
    out: set[int] = set()
    for bucket, data in zip(marks.column("bucket").to_pylist(), marks.column("data").to_pylist(), strict=True):
        if bucket < 0:
            out.add(int.from_bytes(data, "big", signed=True))
    return out


def _sender(buckets: int):
    def send(key: tuple[pa.Scalar, ...], docs: pa.Table, marks: pa.Table) -> pa.Table:
        """The block's signatures, distinct and counted, by range."""
        found = [s for *_, bands in _signatures(docs, _chosen(marks)) for s, _ in bands]
        flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
        distinct, times = np.unique(flat, return_counts=True)
        bounds = K.bucket_bounds(distinct, buckets).tolist()
        block = key[0].as_py()
        times = np.minimum(times, 0xFFFF).astype("<u2")
        return _rows([(block, b, K.pack_sorted(distinct[x:y]), times[x:y].tobytes()) for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if y > x])

    return send


def _count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of one range: for every signature of every block the rank of its count, 0 for once."""
    keys = [K.unpack_sorted(b) for b in table.column("data").to_pylist()]
    times = np.concatenate([np.frombuffer(t, "<u2") for t in table.column("extra").to_pylist()]).astype(np.int64)
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=times)[place]
    rank = np.minimum(np.ceil(4 * np.log2(total)), 255).astype(np.uint8)
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return pa.table([table.column("block").cast(pa.int32()), table.column("bucket").cast(pa.int32()), pa.array([r.tobytes() for r in np.split(rank, cuts)], pa.binary()), pa.nulls(len(keys), pa.binary())], schema=_ROWS)


def _proposer(buckets: int):
    def propose(key: tuple[pa.Scalar, ...], docs: pa.Table, marks: pa.Table) -> pa.Table:
        """Rare-prefix signatures with their documents, by range, and the documents that sent some (bucket -1)."""
        sent = sorted((b, d) for b, d in zip(marks.column("bucket").to_pylist(), marks.column("data").to_pylist(), strict=True) if b >= 0)
        ranks = np.concatenate([np.frombuffer(d, np.uint8) for _, d in sent]) if sent else np.zeros(0, np.uint8)
        found = list(_signatures(docs, _chosen(marks)))
        flat = [s for *_, bands in found for s, _ in bands]
        distinct = np.unique(np.concatenate(flat)) if flat else np.zeros(0, np.uint64)
        if len(distinct) != len(ranks):
            raise ValueError("a block's counts do not fit its signatures")
        block, rows, keys, nodes = key[0].as_py(), [], [], []
        texts = docs.column("text")
        sketch, size = np.zeros((len(found), SENT_WORDS), np.uint64), np.zeros(len(found), np.int32)
        for i, (row, doc, own, bands) in enumerate(found):
            sends = False
            for s, must in bands:
                rank = ranks[np.searchsorted(distinct, s)]
                prefix = np.lexsort((s, rank))[: len(s) - must + 1]
                mine = s[prefix][rank[prefix] > 0]
                if len(mine):
                    keys.append(mine)
                    nodes.append(np.full(len(mine), i))
                    sends = True
            if sends:
                sketch[i], size[i] = parity(own, SENT_WORDS), len(own)
                rows.append((block, -1, int(doc).to_bytes(8, "big", signed=True), (texts[row].as_py() or "").encode()))
        if keys:
            flat, owners = np.concatenate(keys), np.concatenate(nodes)
            order = np.argsort(flat, kind="stable")
            flat, owners = flat[order], owners[order]
            bounds = K.bucket_bounds(flat, buckets).tolist()
            ids = np.array([doc for _, doc, *_ in found], np.int64)
            rows += [(block, b, K.pack_sorted(flat[x:y]), b"".join(part[owners[x:y]].tobytes() for part in (ids, size, sketch))) for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if y > x]
        return _rows(rows)

    return propose


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component) of edges u - v, by pointer jumping over arrays."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while True:
            jump = root[root]
            if (jump == root).all():
                break
            root = jump


def parity(shingles: np.ndarray, words: int) -> np.ndarray:
    """Parity sketch of a set: each shingle toggles one of ``words`` * 64 bits."""
    odd = np.bincount((K.mix(shingles) % _U(words * 64)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _allowed(u: np.ndarray, v: np.ndarray, size: np.ndarray, sketch: np.ndarray, left: np.ndarray | None) -> np.ndarray:
    """Whether sizes, sketches and, if given, the numbers of elements left from the common one on allow a link."""
    total = size[u] + size[v]
    apart = most_apart(total)
    good = np.abs(size[u] - size[v]) <= apart
    if left is not None:  # neither set has what stands before the common element in the other
        good &= (total - left[u] - left[v] <= apart) & ((DENOMINATOR + NUMERATOR) * np.minimum(left[u], left[v]) >= NUMERATOR * total)
    some = np.flatnonzero(good)
    good[some] = np.bitwise_count(sketch[u[some]] ^ sketch[v[some]]).sum(1) <= apart[some]
    return good


def _star(members: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member to the first one with the same key; none without members."""
    if not len(members):
        return members, members
    order = np.lexsort((members, keys))
    members, keys = members[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return members, np.repeat(members[first], np.diff(np.append(first, len(keys))))


def candidates(sigs: np.ndarray, size: np.ndarray, sketch: np.ndarray, left: np.ndarray | None = None, crowded: bool = False):
    """Edges (u, v) between rows that join every two rows of one signature which sizes, sketches and positions allow to be linked.

    ``left`` tells how many elements of a row's set are left from the signature's
    on; ``crowded``, that the signatures already are pieces of sketches.
    """
    order = np.argsort(sigs, kind="stable")
    first = np.flatnonzero(np.diff(sigs[order], prepend=~sigs[order[:1]]))
    count = np.diff(np.append(first, len(sigs)))
    few = np.flatnonzero((count > 1) & (count <= FEW))
    for step in range(1, FEW):  # pairs of members that are ``step`` places apart
        some = few[count[few] > step]
        if not len(some):
            break
        times = count[some] - step
        at = np.repeat(first[some], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        u, v = order[at], order[at + step]
        good = _allowed(u, v, size, sketch, left)
        yield u[good], v[good]
    for g in np.flatnonzero(count > FEW).tolist():
        members = order[first[g] : first[g] + count[g]]
        if len(members) <= CROWD:
            for at in range(0, len(members), 128):
                u, v = (x.ravel() for x in np.meshgrid(members[at : at + 128], members[at:], indexing="ij"))
                good = _allowed(u, v, size, sketch, left)
                who, root = roots(u[good], v[good])
                yield who, root
        elif crowded:  # no more pieces tell them apart
            yield _star(members, np.zeros(len(members)))
        else:
            pieces = sketch.view(np.uint32).reshape(len(sketch), -1)
            small = most_apart(2 * size[members] + size[members] // 4 + 1) < pieces.shape[1]  # one of the pieces agrees with a linked set's
            some, rest = members[small], members[~small]
            for j in range(pieces.shape[1] if len(some) else 0):
                for u, v in candidates(pieces[some, j].astype(np.uint64), size[some], sketch[some], None if left is None else left[some], crowded=True):
                    yield some[u], some[v]
            yield _star(rest, np.zeros(len(rest)))
            yield from _edges_between(some, rest, size)


def _edges_between(small: np.ndarray, large: np.ndarray, size: np.ndarray):
    """Sets of the one kind that can be linked with one of the other kind join it."""
    if len(large):
        near = small[size[small] >= NUMERATOR * size[large].min() // DENOMINATOR]
        yield near, np.full(len(near), large.min())


def forest(edges) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, root of each other node) of batches of edges, joined whenever some have gathered."""
    who, root, wait, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for edge in itertools.chain(edges, [None]):
        if edge is not None and len(edge[0]):
            wait.append(edge)
            size += len(edge[0])
        if wait and (edge is None or size > 1 << 20):
            who, root = roots(np.concatenate([who, *(w[0] for w in wait)]), np.concatenate([root, *(w[1] for w in wait)]))
            who, root, wait, size = who[who != root], root[who != root], [], 0
    return who, root


def _looser(spread: int):
    def loosen(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Of one range: a forest that joins the documents of each signature that may be linked, packed by a range of nodes."""
        sigs, ids, size, sketch = [], [], [], []
        for data, extra in zip(table.column("data").to_pylist(), table.column("extra").to_pylist(), strict=True):
            sigs.append(K.unpack_sorted(data))
            n = len(sigs[-1])
            ids.append(np.frombuffer(extra, np.int64, n))
            size.append(np.frombuffer(extra, np.int32, n, 8 * n).astype(np.int64))
            sketch.append(np.frombuffer(extra, np.uint64, n * SENT_WORDS, 12 * n).reshape(n, SENT_WORDS))
        nodes = np.concatenate(ids)
        who, root = forest((nodes[u], nodes[v]) for u, v in candidates(np.concatenate(sigs), np.concatenate(size), np.concatenate(sketch)))
        place = (K.mix(who.view(np.uint64)) % _U(spread)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(spread + 1)).tolist()
        rows = []
        for p, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if y > x:
                rows.append((0, p, who[order[x:y]].tobytes(), root[order[x:y]].tobytes()))
        return _rows(rows)

    return loosen


_EDGES = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def _forest(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Distinct edges of one range of nodes."""
    pairs = np.stack([np.concatenate([np.frombuffer(b, np.int64) for b in table.column(c).to_pylist()]) for c in ("data", "extra")], 1)
    pairs = np.unique(pairs, axis=0)
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_EDGES)


def tile_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within a tile (only those across, where both sides are there)."""
    n = len(ids)
    size = np.array([len(s) for s in sets])
    sketch = np.array([parity(s, SKETCH_WORDS) for s in sets])
    label = np.arange(n)
    u, v = [], []
    cross = side.min() != side.max()
    for i in range(n):
        others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1  # what already hangs together needs no look
        if cross:
            others = others[side[others] != side[i]]
        near = most_apart(size[i] + size[others])
        others = others[np.abs(size[others] - size[i]) <= near]
        if not len(others):
            continue
        far = np.bitwise_count(sketch[others] ^ sketch[i]).sum(1)
        others = others[far <= most_apart(size[i] + size[others])]
        for j in others.tolist():
            if label[i] == label[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if linked(both, size[i] + size[j] - both):
                label[label == label[j]] = label[i]
                u.append(max(ids[i], ids[j]))
                v.append(min(ids[i], ids[j]))
    return np.array(u, np.int64), np.array(v, np.int64)


def _verify(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A task's clusters or tile: links among documents of the same cluster."""
    ids = table.column("doc_id").to_numpy()
    cluster = table.column("cluster").to_numpy()
    side = table.column("side").to_numpy()
    hashes, bounds = shingle_sets(table.column("text"))
    u, v = [], []
    order = np.lexsort((ids, cluster))
    for rows in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
        a, b = tile_links(ids[rows], [hashes[bounds[r] : bounds[r + 1]] for r in rows.tolist()], side[rows])
        u.append(a)
        v.append(b)
    return pa.table([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], schema=_EDGES)


def _compared(placed: DataFrame, tiles: Column, texts: DataFrame) -> DataFrame:
    """Links found in the tiles (task, i, j, side) that each node goes to."""
    tiled = placed.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), F.explode(tiles).alias("t")).select("doc_id", "cluster", "t.*")
    return tiled.join(texts, "doc_id").groupBy("task", "i", "j").applyInArrow(_verify, "src long, dst long")


def tile(task: Column, i: Column, j: Column, side: Column | int) -> Column:
    return F.struct(task.cast("long").alias("task"), i.cast("int").alias("i"), j.cast("int").alias("j"), (F.lit(side) if isinstance(side, int) else side).alias("side"))


def _links(clusters: DataFrame, texts: DataFrame, tasks: int) -> DataFrame:
    """Edges whose components are those of all links within the loose clusters (node, component)."""
    sized = checkpoint(clusters.join(texts.select(F.col("doc_id").alias("node"), F.octet_length("text").alias("bytes")), "node"), 2 * cores(clusters))
    chunks = lambda n, size: F.ceil(F.greatest(n / CHUNK, size / CHUNK_BYTES)).cast("int")
    large = sized.groupBy("component").agg(chunks(F.count(F.lit(1)), F.sum("bytes")).alias("chunks")).filter("chunks > 1")
    placed = sized.join(broadcast_if_few(large), "component", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    # Small clusters share tasks; all chunks of a large one meet its first chunk.
    alone = F.array(tile(F.pmod(F.xxhash64("component"), F.lit(tasks)), F.lit(0), F.lit(0), 0))
    pivots = each(F.col("chunks"), lambda c: tile(F.col("component"), F.lit(1), c + 1, 0))
    others = F.array(tile(F.col("component"), F.lit(1), F.col("chunk") + 1, 1))
    found = checkpoint(_compared(placed, F.when(F.col("chunks") == 1, alone).when(F.col("chunk") == 0, pivots).otherwise(others), texts))
    crowds = placed.filter("chunks > 1")
    if crowds.isEmpty():
        return found
    # What is not in the greatest component of its cluster yet is compared with all the rest.
    known = connected_components(found).select("node", F.col("component").alias("label"))
    crowds = checkpoint(crowds.join(known, "node", "left").withColumn("label", F.coalesce("label", "node")), 2 * cores(clusters))
    main = crowds.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max(F.struct("n", "label"))["label"].alias("main"))
    rest = checkpoint(crowds.join(broadcast_if_few(main), "component").withColumn("out", F.col("label") != F.col("main")), 2 * cores(clusters))
    open_ = rest.filter("out").groupBy("component").agg(chunks(F.count(F.lit(1)), F.sum("bytes")).alias("parts"))
    rest = rest.join(broadcast_if_few(open_), "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    inner = each(F.col("chunks"), lambda c: tile(F.col("component"), F.col("part") + 1, -1 - c, 0))
    outer = each(F.col("parts"), lambda o: tile(F.col("component"), F.least(o, F.col("part")) + 1, F.greatest(o, F.col("part")) + 1, F.when(o < F.col("part"), 1).otherwise(0)))
    mine = each(F.col("parts"), lambda o: tile(F.col("component"), o + 1, -1 - F.col("chunk"), 1))
    return found.unionByName(_compared(rest, F.when(F.col("out"), F.concat(inner, outer)).otherwise(mine), texts))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    base = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = blocks_for(base, block_bytes)
    block = spread("doc_id", "text", n).alias("block")
    keys = checkpoint(base.mapInArrow(_keys, "doc_id long, n long, a long, b long"))
    classes = keys.filter("n > 0 and doc_id is not null").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"))
    chosen = classes.select(F.col("rep").alias("doc_id"), F.lit(None).cast("string").alias("text")).select(block, F.lit(-1).alias("bucket"), F.expr("unhex(lpad(hex(doc_id), 16, '0'))").alias("data"), F.lit(None).cast("binary").alias("extra"))
    dealt = base.select(block, "doc_id", "text").groupBy("block")
    sent = dealt.cogroup(chosen.groupBy("block")).applyInArrow(_sender(n), ROWS)
    counts = sent.groupBy("bucket").applyInArrow(_count, ROWS)
    proposed = checkpoint(dealt.cogroup(counts.unionByName(chosen).groupBy("block")).applyInArrow(_proposer(n), ROWS))
    texts = proposed.filter("bucket = -1").select(F.expr("cast(conv(hex(data), 16, -10) as long)").alias("doc_id"), F.col("extra").cast("string").alias("text"))
    ranges = max(4, shuffle_partitions(docs.sparkSession) // 4)
    loose = proposed.filter("bucket >= 0").groupBy("bucket").applyInArrow(_looser(ranges), ROWS).groupBy("bucket").applyInArrow(_forest, "src long, dst long")
    links = connected_components(_links(connected_components(loose), texts, 32 * ranges))
    named = classes.join(links, classes["rep"] == links["node"], "left").select(F.col("n").alias("cn"), F.col("a").alias("ca"), F.col("b").alias("cb"), F.coalesce("component", "rep").alias("component"))
    met = keys.join(named, (F.col("n") == F.col("cn")) & (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")), "left")
    return met.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, one for each component: that of the least id, nulls last.

    Rows are told apart by written numbers, so ids may repeat or be null.  Rows of
    empty sets link with nothing and all stay.
    """
    rows = numbered(docs, "__row")
    ids = rows.select(F.col("__row").alias("doc_id"), F.col(f"`{id_col}`").cast("long").alias("id"))
    met = near_duplicates(rows, id_col="__row", **options).join(ids, "doc_id")
    kept = met.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("least")).select(F.col("least.doc_id").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
