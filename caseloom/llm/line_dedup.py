"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words.  Lines are in the order (document, row, place);
a line is removed if an earlier line has Jaccard similarity 0.8 or more with it,
equal sets included (an earlier line counts whether or not it is itself
removed, so the result does not depend on the order of work).

1. Ranks: words are counted over all lines in cells of a hash; a word's rank is the half
   doublings of its cell's count from the mean.  (rank, hash) is one global order of words,
   those of rare cells first.  The result does not depend on the order, only the number
   of candidates does.
2. Lines: of every line its place, the 64-bit name of its set, its size, a parity
   sketch and a prefix of its words in that order are written.  A set's first line is
   the only one that can stay; sets are numbered in the order of these lines.
3. Crowds: of sets with the same keys that many send, each is compared with the first
   one; those that it beats meet others only as the earlier set.
4. Prefix join: similar sets have a word in common among the n - ceil(0.8 n) + 1
   first ones of the larger and the n / 9 + 1 first ones of the smaller.  Common words
   are told apart by octaves of sizes.  Two sets that meet are candidates if sizes
   (length filter), the words from that position on (positional filter) and the sketches
   allow 0.8.  Of a key that very many sets send these sets send, in its place,
   the XOR hashes of segments of their words, of which a similar set has one.
5. Verification: each set is first compared, word by word, with the earlier candidate
   of the nearest sketch; only sets that this one does not beat meet all the others.
   The words come from another read of the texts, for the lines that a bit table of
   fixed size lets pass.

Words are identified by 57-bit hashes, sets by 64-bit hashes.

Defined cases: a null, empty or blank text has no line and removes nothing, and
its row stays with 0 lines; blank lines are kept and match nothing; null ids come
first in the order; repeated rows repeat their lines, the one that Spark reads
first staying; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.text import bound, computed
from caseloom.llm.frames import broadcast_if_few, checkpoint, cores, estimated_bytes, numbered, only, shuffle_partitions
from caseloom.llm.jaccard_join import DENOMINATOR, NUMERATOR, TOPS

#: Sets that may have one word in their prefix before it gives way to segments, so that no word's sets all meet.
HEAVY = 4096
#: Bits of the greatest bit table (of wanted lines, of keys); tables only spare work.
BITS = 1 << 25
#: Lines for each partition of the keys: a line has some ten keys, and a key not more than HEAVY sets.
PART_LINES = 1 << 15
#: A word's number has its rank, at most 63, above so many bits of its hash.
HASH_BITS = 57
#: Cells of the table of ranks (by the hash's last bits): the least and most, and bytes of input for one.  It is put together from blocks.
LEAST_CELLS, MOST_CELLS, CELL_BYTES, BLOCK = 1 << 15, 1 << 18, 1 << 10, 1 << 10
#: Words of cells that count more than that are told apart by octaves of sizes; sets below this size have the halves of their sketch in one.
OFTEN, SMALL = 128, 72
#: A candidate's distance stands above so many bits of its number.
ID_BITS = 55

LINE = ("row", "place")
#: What a set sends with each of its keys.
SENT = ("id", "open", "n", "sketch", "other", "key", "at")


def _split(rows: DataFrame) -> DataFrame:
    """row, doc_id, place, line of every line, and one without line of every null text; white space in a line is blanks."""
    white = "\t\x0b\x0c\r"
    some = F.col("text").contains(white[0])
    for c in white[1:]:
        some |= F.col("text").contains(c)
    text = F.when(some, F.translate("text", white, " " * len(white))).otherwise(F.col("text"))
    return rows.select("row", "doc_id", F.posexplode_outer(F.split(text, "\n")).alias("place", "line"))


def _hash(w: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(w), 64 - HASH_BITS)


def _words(line: Column) -> Column:
    """The distinct words of a line as their hashes."""
    return F.array_distinct(F.array_remove(F.transform(F.split(line, " "), _hash), _hash(F.lit(""))))


def _cells(rows: DataFrame) -> int:
    """Cells of the table of ranks: they grow with the input, up to a bound."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (estimated_bytes(rows) // CELL_BYTES).bit_length()))


def _rank(times: Column, mean: float) -> Column:
    """Half doublings from the mean cell's count, which has 32; 0 is for empty cells."""
    return F.least(F.lit(63), F.greatest(F.lit(1), 32 + F.round(2 * F.log2(times / F.lit(mean))))).cast("byte")


def rarity(rows: DataFrame, size: int) -> DataFrame:
    """One row: the ranks of ``size`` cells of words, a byte each, and the rank of a cell that counts ``OFTEN``."""
    cell = _hash(F.col("w")).bitwiseAND(F.lit(size - 1).cast("long")).cast("int")
    counts = _split(rows).select(F.explode(F.split("line", " ")).alias("w")).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("times"))
    counts = checkpoint(counts, cores(rows))  # at most ``size`` rows
    mean = (counts.agg(F.sum("times")).first()[0] or 0) / size or 1.0
    every = counts.select("cell", _rank(F.col("times"), mean).alias("rank")).unionByName(rows.sparkSession.range(size).select(F.col("id").cast("int").alias("cell"), F.lit(0).cast("byte").alias("rank")))
    of_block = F.transform(F.sort_array(F.collect_list(F.struct("cell", "rank"))), lambda c: c["rank"])
    blocks = every.groupBy("cell").agg(F.max("rank").alias("rank")).groupBy(F.floor(F.col("cell") / BLOCK).alias("block")).agg(of_block.alias("ranks"))
    return checkpoint(blocks.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "ranks"))), lambda b: b["ranks"])).alias("ranks"), F.max(_rank(F.lit(float(OFTEN)), mean)).alias("often")))


def _most_apart(total: Column) -> Column:
    """The greatest symmetric difference of two similar sets whose sizes add up to ``total``."""
    return F.floor((DENOMINATOR - NUMERATOR) * total / (DENOMINATOR + NUMERATOR)).cast("int")


def _bit(value: Column) -> Column:
    """A long with the bit that the last six bits of ``value`` tell."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), value.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def _sketch(words: Column, half: int | None = None) -> Column:
    """A parity sketch of all words or one half of them: a bit for each of 64 classes, set if the line has an odd number of them."""
    mine = words if half is None else F.filter(words, lambda w: w.bitwiseAND(F.lit(64).cast("long")) == F.lit(64 * half).cast("long"))
    return F.aggregate(mine, F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(_bit(w)))


def described(rows: DataFrame, ranks: DataFrame, size: int) -> DataFrame:
    """row, doc_id, place of every line with its set's size, name, sketch and prefix; lines without words have size 0.

    The sketch of a set of ``SMALL`` words or more has two columns, that of a smaller one their sum.
    """
    # Out of a generator the words are worked out once, not for each use.
    once = lambda words: F.explode(F.array(F.coalesce(words, F.array().cast("array<long>")))).alias("words")
    lines = _split(rows).select("row", "doc_id", "place", once(_words(F.col("line"))))
    # A column of its own reaches the words, as a subquery may not stand in a lambda.  The two projections become one: a column that is made would be copied into every row.
    rank = lambda t, w: F.coalesce(F.get(t, w.bitwiseAND(F.lit(size - 1).cast("long")).cast("int")), F.lit(0).cast("byte"))
    ranked = bound(F.col("ranks"), lambda t: F.transform("words", lambda w: w.bitwiseOR(F.shiftleft(rank(t, w).cast("long"), HASH_BITS))))
    lines = lines.select("row", "doc_id", "place", "words", ranks.select("ranks").scalar().alias("ranks")).select("row", "doc_id", "place", F.sort_array(ranked).alias("words"))
    lines = lines.select("row", "doc_id", "place", once(F.col("words")))
    n = F.size("words")
    length = F.floor(n - F.ceil(n * NUMERATOR / DENOMINATOR) + 1).cast("int")
    return lines.select("row", "doc_id", "place", n.alias("n"), F.xxhash64("words").alias("name"), F.when(n < SMALL, _sketch(F.col("words"))).otherwise(_sketch(F.col("words"), 0)).alias("sketch"), F.when(n < SMALL, F.lit(0).cast("long")).otherwise(_sketch(F.col("words"), 1)).alias("other"), F.slice("words", 1, length).alias("prefix"))


def _keys(lines: DataFrame, often: int) -> DataFrame:
    """The ``lines`` with a row for each word of their prefix, and octave of sizes if its rank is above ``often``: key, at.

    Similar sets meet in the smaller one's octave, so a set just above one also sends to that below.
    """
    octave = F.floor(F.log2("n")).cast("int")
    below = F.floor(F.log2(F.ceil(F.col("n") * NUMERATOR / DENOMINATOR))).cast("int")
    rare = F.shiftright("word", HASH_BITS) <= often
    each = lines.select("*", F.posexplode("prefix").alias("at", "word"))
    each = each.select("*", F.explode(F.when(rare, F.array(F.lit(-1))).when(below < octave, F.array(octave, below)).otherwise(F.array(octave))).alias("octave"))
    return each.withColumn("key", F.xxhash64("word", "octave"))


def _sent(sets: DataFrame, often: int, hot: DataFrame | None, segments: DataFrame | None) -> DataFrame:
    """The keys of the ``sets``: those of the prefix, or segments in place of the hot ones."""
    each = _keys(sets, often).select(*SENT)
    if hot is None:
        return each
    return each.join(hot, "key", "left_anti").select(*SENT).unionByName(segments.join(sets.select("id"), "id", "left_semi").select(*SENT))


def _sent_of(lines: DataFrame, often: int, firsts: DataFrame, hot: DataFrame | None, segments: DataFrame | None, may: Callable[[Column], Column]) -> DataFrame:
    """The same of all sets, the first of the ``lines``, but only keys that ``may`` lets pass; only their rows go on."""
    each = _keys(lines, often).filter(may(F.col("key")))
    if hot is not None:
        each = each.join(hot, "key", "left_anti")
    each = each.select(*LINE, *SENT[2:]).join(firsts.hint("merge"), [*LINE]).select(*SENT)
    return each if hot is None else each.unionByName(segments.filter(may(F.col("key"))))


def _bit_table(hashes: DataFrame):
    """A test that lets pass the hashes of a column ``hash``, and some others: a bit table, one row, of at most ``BITS`` bits."""
    bits = min(BITS, max(1 << 10, 1 << (16 * hashes.count()).bit_length()))
    bit = lambda h: h.bitwiseAND(F.lit(bits - 1).cast("long"))
    none = hashes.sparkSession.range(bits >> 6).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("set"))
    cells = hashes.select(F.shiftright(bit(F.col("hash")), 6).alias("cell"), _bit(F.col("hash")).alias("set")).unionByName(none).groupBy("cell").agg(F.bit_or("set").alias("set"))
    table = checkpoint(cells.agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "set"))), lambda c: c["set"]).alias("table")))
    return lambda h: F.get(table.scalar(), F.shiftright(bit(h), 6).cast("int")).bitwiseAND(_bit(h)) != 0


def words_of(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """id, words of the ``lines`` (id, row, place), from a read of the texts of which only those lines go on."""
    may = _bit_table(lines.select(F.explode(F.array(F.xxhash64("row"), F.xxhash64(*LINE))).alias("hash")))
    some = _split(rows.filter(may(F.xxhash64("row")))).filter(may(F.xxhash64(*LINE)))
    return some.select(*LINE, "line").join(lines.hint("merge"), [*LINE]).select("id", _words(F.col("line")).alias("words"))


def _hot(lines: DataFrame, often: int, heavy: int, count: int) -> DataFrame:
    """key, count of those that more than ``heavy`` sets send.  Keys are counted by cells first, then those of full cells by sets."""
    keys = _keys(lines, often).select("name", "key")
    cell = F.col("key").bitwiseAND(F.lit((1 << max(10, (count >> 5).bit_length())) - 1).cast("long"))
    full = broadcast_if_few(keys.groupBy(cell.alias("cell")).count().filter(F.col("count") > heavy).select("cell"))
    if full.isEmpty():
        return full.select(F.col("cell").alias("key"), F.lit(0).cast("long").alias("count"))
    sets = keys.withColumn("cell", cell).join(full, "cell", "left_semi").select("key", "name").distinct()
    return checkpoint(sets.groupBy("key").count().filter(F.col("count") > heavy), cores(lines))


def _segments(rows: DataFrame, lines: DataFrame, often: int, hot: DataFrame) -> DataFrame:
    """The keys that sets with hot keys send in place of those: the XOR of each of a set's segments.

    In the size band of the larger set of a similar pair the words fall into one
    segment more than can differ, so the sets agree in one of them.  A segment
    without words tells little; its key has each hot key of the set instead.
    """
    known = ("id", *LINE, *SENT[1:-2])
    mine = checkpoint(_keys(lines, often).select(*known, "key").join(hot, "key").groupBy(*known).agg(F.collect_set("key").alias("hot")))
    tops = F.lit([int(t) for t in TOPS])
    own = F.element_at(F.filter(tops, lambda t: t >= F.col("n")), 1)
    after = F.filter(tops, lambda t: (t > own) & (F.col("n") * DENOMINATOR >= (own + 1) * NUMERATOR))
    banded = mine.select("id", F.explode(F.concat(F.array(own), F.slice(after, 1, 1))).alias("top")).withColumn("parts", _most_apart(2 * F.col("top")) + 1)
    met = banded.join(words_of(rows, checkpoint(mine.select("id", *LINE))), "id").select("id", "top", "parts", F.explode("words").alias("word"))
    values = met.groupBy("id", "top", "parts", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part")).agg(F.bit_xor(F.xxhash64("word", F.lit(1))).alias("value"))
    sets = values.groupBy("id", "top", "parts").agg(F.collect_list(F.struct("part", "value")).alias("full")).join(mine, "id")
    bare = F.array_except(F.sequence(F.lit(0), F.col("parts") - 1), F.col("full.part"))
    full = F.transform("full", lambda p: F.xxhash64(F.lit("full"), "top", p["part"], p["value"]))
    empty = F.flatten(F.transform(bare, lambda p: F.transform("hot", lambda h: F.xxhash64(F.lit("bare"), "top", p, h))))
    return sets.select(*SENT[:-2], F.explode(F.concat(full, empty)).alias("key"), F.lit(0).alias("at")).select(*SENT)


def _distance(small: str, large: str) -> Column:
    """Bits in which the sketches of a set and one that is not smaller differ."""
    apart, rest = (F.col(f"{small}_{c}").bitwiseXOR(F.col(f"{large}_{c}")) for c in ("sketch", "other"))
    return F.when(F.col(f"{small}_n") < SMALL, F.bit_count(apart.bitwiseXOR(rest))).otherwise(F.bit_count(apart) + F.bit_count(rest))


def _near(distance: Column, one: str, two: str) -> Column:
    return distance * (DENOMINATOR + NUMERATOR) <= (F.col(f"{one}_n") + F.col(f"{two}_n")) * (DENOMINATOR - NUMERATOR)


def _crowded(rows: DataFrame, sets: DataFrame, firsts: DataFrame, often: int, keys: DataFrame) -> DataFrame:
    """id of sets that are similar to the first with the same of the ``keys`` that many sets send: one comparison each, so a crowd need not meet as a whole."""
    of_set = ("id", "n", "sketch", "other")
    mine = _keys(sets, often).select(*of_set, "key").join(keys.select("key"), "key", "left_semi").groupBy(*of_set).agg(F.xxhash64(F.sort_array(F.collect_set("key"))).alias("crowd"))
    mine = checkpoint(mine, 2 * cores(rows))
    lead = mine.groupBy("crowd").agg(F.min(F.struct(*of_set)).alias("lead")).select("crowd", *[F.col(f"lead.{c}").alias(f"a_{c}") for c in of_set])
    met = mine.select("crowd", *[F.col(c).alias(f"b_{c}") for c in of_set]).join(lead, "crowd").filter("a_id < b_id")
    distance = F.when(F.col("a_n") <= F.col("b_n"), _distance("a", "b")).otherwise(_distance("b", "a"))
    fits = (F.col("a_n") * DENOMINATOR >= F.col("b_n") * NUMERATOR) & (F.col("b_n") * DENOMINATOR >= F.col("a_n") * NUMERATOR) & _near(distance, "a", "b")
    return _beaten(rows, firsts, checkpoint(met.filter(fits).select(F.col("b_id").alias("later"), F.col("a_id").alias("earlier")), cores(rows)))


def _met(smaller: DataFrame, larger: DataFrame, built: int = 0) -> DataFrame:
    """a, b, distance of sets with a common key that size, position and sketch allow to be similar; a is the smaller, or the earlier of one size.

    Of the smaller set only the first n / 9 + 1 words count: no more are needed in its prefix.  The side ``built`` is kept in memory, by parts.
    """
    # Made by a generator, so that the filter stays behind the exchange and both sides can be one table, dealt out once.
    first = computed(smaller, first=F.col("at") * (DENOMINATOR + NUMERATOR) <= F.col("n") * (DENOMINATOR - NUMERATOR)).filter("first")
    sides = [side.select(*[F.col(c).alias(f"{x}_{c}") for c in SENT]) for side, x in ((first, "a"), (larger, "b"))]
    sides[built] = sides[built].hint("shuffle_hash")
    larger = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_id") < F.col("b_id")))
    place = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) * (NUMERATOR + DENOMINATOR) >= (F.col("a_n") + F.col("b_n")) * NUMERATOR
    distance = _distance("a", "b")
    fits = larger & (F.col("a_n") * DENOMINATOR >= F.col("b_n") * NUMERATOR) & place & _near(distance, "a", "b") & F.when(F.col("a_id") < F.col("b_id"), F.col("b_open")).otherwise(F.col("a_open"))
    return sides[0].join(sides[1], (F.col("a_key") == F.col("b_key")) & fits).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), distance.cast("long").alias("distance"))


def _beaten(rows: DataFrame, firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """id of the later sets of the ``pairs`` that are similar to the earlier one; compared by their words."""
    ids = pairs.select(F.col("later").alias("id")).unionByName(pairs.select(F.col("earlier").alias("id"))).distinct()
    words = checkpoint(words_of(rows, checkpoint(firsts.join(ids, "id", "left_semi"), cores(rows))), 2 * cores(rows))
    a, b = (words.select(F.col("id").alias(c), F.col("words").alias(f"{c}_words")) for c in ("earlier", "later"))
    both = F.size(F.array_intersect("earlier_words", "later_words"))
    met = pairs.join(b, "later").join(a, "earlier")
    similar = met.filter(both * (NUMERATOR + DENOMINATOR) >= (F.size("earlier_words") + F.size("later_words")) * NUMERATOR)
    return checkpoint(similar.select(F.col("later").alias("id")).distinct(), cores(rows))


def removed_lines(rows: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """row, doc_id, places of all lines with words and places of the removed ones, of every (row, doc_id, text)."""
    size = _cells(rows)
    ranks = rarity(rows, size)
    often = ranks.select("often").first()[0]
    every = checkpoint(described(rows, ranks, size))
    lines = every.filter("n > 0")
    count = lines.count()
    firsts = checkpoint(lines.groupBy("name").agg(F.min(F.struct("doc_id", "row", "place")).alias("first")).select("first"))
    # Numbers in the order of the lines: partitions of a sort are ranges.
    firsts = checkpoint(firsts.sort("first").select(F.monotonically_increasing_id().alias("id"), "first.row", "first.place"))
    hot = _hot(lines, often, max(1, heavy // 4), count)
    firsts, crowded = firsts.withColumn("open", F.lit(True)), None
    if not hot.isEmpty():
        crowded = _crowded(rows, lines.join(firsts.hint("merge"), [*LINE]), firsts, often, broadcast_if_few(hot))
        # A set that is beaten only meets others as the earlier one.
        firsts = checkpoint(firsts.drop("open").join(crowded.withColumn("open", F.lit(False)), "id", "left").select("id", *LINE, F.coalesce("open", F.lit(True)).alias("open")), 2 * cores(rows))
        hot = hot.filter(F.col("count") > heavy).select("key")
    sets = lines.join(firsts.hint("merge"), [*LINE])
    hot, segments = (None, None) if hot.isEmpty() else (broadcast_if_few(hot), checkpoint(_segments(rows, sets, often, hot)))
    parts = max(shuffle_partitions(rows.sparkSession), count // PART_LINES)
    sent = _sent(sets, often, hot, segments).repartition(parts, "key")
    met = _met(sent, sent).select(F.greatest("a", "b").alias("later"), F.least("a", "b").alias("earlier"), "distance")
    low = (1 << ID_BITS) - 1
    nearest = met.groupBy("later").agg(F.min(F.shiftleft("distance", ID_BITS).bitwiseOR(F.col("earlier"))).alias("nearest"), F.min("earlier").alias("least"), F.max("earlier").alias("most"))
    nearest = checkpoint(nearest.select("later", F.col("nearest").bitwiseAND(F.lit(low)).alias("earlier"), (F.col("least") < F.col("most")).alias("several")), cores(rows))
    beaten = _beaten(rows, firsts, nearest.select("later", "earlier"))
    rest = nearest.filter("several").select(F.col("later").alias("id")).join(beaten, "id", "left_anti")
    rest = broadcast_if_few(rest)
    if not rest.isEmpty():
        theirs = checkpoint(firsts.join(rest, "id", "left_semi"), cores(rows))
        of_them = _bit_table(theirs.select(F.xxhash64(*LINE).alias("hash")))
        few = checkpoint(_sent(lines.filter(of_them(F.xxhash64(*LINE))).join(theirs.hint("merge"), [*LINE]), often, hot, segments), 2 * cores(rows))
        table = _bit_table(few.select(F.xxhash64("key").alias("hash")))
        all_sent = _sent_of(lines, often, firsts, hot, segments, lambda key: table(F.xxhash64(key))).repartition(parts, "key")
        few = few.repartition(parts, "key")
        others = _met(all_sent, few, 1).filter("b > a").select(F.col("b").alias("later"), F.col("a").alias("earlier"))
        others = others.unionByName(_met(few, all_sent, 0).filter("a > b").select(F.col("a").alias("later"), F.col("b").alias("earlier")))
        others = checkpoint(others.distinct(), cores(rows))
        beaten = beaten.unionByName(_beaten(rows, firsts, others))
    beaten = beaten if crowded is None else beaten.unionByName(crowded)
    stays = firsts.join(beaten, "id", "left_anti").select(*LINE, F.lit(True).alias("stays"))
    judged = every.select("row", "doc_id", "place", "n").join(stays, [*LINE], "left")
    places = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("place"))))
    return judged.groupBy("row").agg(F.first("doc_id").alias("doc_id"), places(F.col("n") > 0).alias("places"), places((F.col("n") > 0) & F.col("stays").isNull()).alias("removed"))


def line_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_lines, n_removed and the places of the removed lines, of every row.  ``heavy`` changes the way, not the result."""
    base = only(docs, doc_id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return removed_lines(base, heavy).select("doc_id", F.size("places").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_sort("removed").alias("removed_lines"))


def clean_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, with the removed lines cut from the text."""
    base = numbered(docs, "__row")
    gone = removed_lines(only(base, row="__row", doc_id=id_col, text=text_col).select("row", F.col("doc_id").cast("long"), F.col("text").cast("string"))).filter("size(removed) > 0").select(F.col("row").alias("__of"), F.col("removed").alias("__gone"))
    kept = F.array_join(F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    met = base.join(gone, F.col("__row") == F.col("__of"), "left")
    return met.select(*[F.when(F.col("__gone").isNull(), F.col(f"`{c}`")).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(len(ls))) AS place, unnest(ls) AS line FROM d),
w AS (SELECT doc_id, place, list_sort(list_distinct(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) AS s FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
c AS (SELECT s, min((doc_id * 1000000 + place)) AS f, len(s) AS n, row_number() OVER () AS id FROM w GROUP BY s),
t AS (SELECT id, n, f, unnest(s) AS word FROM c),
df AS (SELECT word, count(*) AS k FROM t GROUP BY word),
r AS (SELECT t.id, n, f, t.word, row_number() OVER (PARTITION BY t.id ORDER BY k, t.word) AS i FROM t JOIN df USING (word)),
p AS (SELECT * FROM r WHERE i <= n - ceil(n * 0.8) + 1),
pairs AS (SELECT DISTINCT x.id AS x, y.id AS y FROM p x JOIN p y USING (word) WHERE y.f < x.f AND x.n * 5 >= y.n * 4 AND y.n * 5 >= x.n * 4),
lost AS (SELECT DISTINCT x FROM pairs JOIN c cx ON cx.id = x JOIN c cy ON cy.id = y WHERE 9 * len(list_intersect(cx.s, cy.s)) >= 4 * (cx.n + cy.n)),
j AS (SELECT doc_id, place, NOT (doc_id * 1000000 + place = f AND lost.x IS NULL) AS removed FROM w JOIN c USING (s) LEFT JOIN lost ON lost.x = c.id)
SELECT documents.doc_id, count(place) AS n_lines, count(*) FILTER (removed) AS n_removed,
       coalesce(string_agg(place::VARCHAR, ',' ORDER BY place) FILTER (removed), '') AS removed_lines
FROM documents LEFT JOIN j USING (doc_id) GROUP BY documents.doc_id
"""
