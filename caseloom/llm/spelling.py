"""Spelling variant grouping: one-edit pairs of words by merging the subtrees of an errata trie.

*Words.*  Every maximal run of letters of every whole text is counted, in tasks
first and then by word; runs of fewer than ``LEAST`` code points or seen once
are no words.  (The query's rule for deleting code points is the ``slip``.)

*Merging.*  Two words one edit apart part at one trie node v, after their common
beginning p: they are p·a·s and p·b·s, or p·a·s and p·s.  At v every light
child's subtree (all but the one with most words, which the heavy path goes on
with) is merged into the rest: each of its words goes in with its character
after p skipped, replaced by the heavy child's, and with the heavy child's
inserted before it.  Where terminals coincide, the words are one edit apart.
A word is light at most log2(n) times, and each pair meets at one node only.
Words that are equal but for one place form a class; a class counts for each
member as (its size less one, its best other member), so no pairs are emitted.

*On Spark.*  Words that share their first ``HEAD`` code points are merged in one
task, in sorted order, which is the trie.  The pairs that differ earlier share
their last ``HEAD`` code points: a second round over reversed words gives those.
A beginning with more than ``SHARD`` words is not given to a task: its own node
is merged by Spark, grouping words by what is left without the character after
the beginning (at most one row for each letter of the alphabet), and its
children go on as beginnings one longer.

*Forms.*  A word's form is its near word of greatest count (ties: the smallest),
if that is ``FACTOR`` times its own.  Counts grow tenfold along a chain of
forms, so chains are short and roots are found by doubling.

Defined cases: a null or empty text has no words; a null id counts as an empty
one for the slip; repeated rows count as often as they are there; very long runs
are words like any others; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseloom.llm import kernels as K
from caseloom.llm.frames import broadcast_if_few, checkpoint, only, shuffle_partitions

LEAST, SEEN, FACTOR, SLIPS = 7, 2, 10, 31
#: Code points that words of one task share; two words one edit apart share so many at one end.
HEAD = 3
#: Words of one beginning, and about as many of one task.
SHARD = 20_000
#: Words and code points that a counting task holds before it hands them on.
HELD_WORDS, HELD_POINTS = 200_000, 8 << 20

_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
NEAR = "word string, n_near long, best_n long, best string"


def runs_of(least: int) -> re.Pattern:
    return re.compile(f"[a-zÀ-ÿ]{{{least},}}")


def slip(doc_id: int | None, run: str) -> str:
    """The run, without one code point if its hash with the id says so."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    return run if h % SLIPS else run[: h % len(run)] + run[h % len(run) + 1 :]


def _counter(least: int, changed: Callable[[int | None, str], str] | None):
    pattern = runs_of(least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text -> words with counts; a word may come several times."""
        held: Counter[str] = Counter()
        points = 0
        for batch in K.parts(batches, 1):
            for doc, text in zip(batch.column(0).to_pylist(), K.doc_texts(batch.column(1)), strict=True):
                for run, n in Counter(pattern.findall(text.translate(K.LOWER_ASCII.tobytes()).decode("utf-8", "replace"))).items():
                    word = changed(doc, run) if changed else run
                    if len(word) >= least:
                        points += 0 if word in held else len(word)
                        held[word] += n
            if len(held) > HELD_WORDS or points > HELD_POINTS:
                yield pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
                held, points = Counter(), 0
        yield pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    return count


def vocabulary(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = LEAST, seen: int = SEEN, changed: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """word, n of all words; ``changed`` may alter each run of a document before it is counted."""
    base = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return base.mapInArrow(_counter(least, changed), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= seen)


def shared(a: str, b: str) -> int:
    """The length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def merged(words: list[str], depth: int) -> Iterator[tuple[list[str], list[str]]]:
    """Coinciding terminals of the trie of ascending, distinct words, at nodes from ``depth`` on.

    Gives (words that differ in one place, []) or ([longer], [shorter]); every
    pair of words one edit apart that share ``depth`` code points comes once.
    """
    known = set(words)
    open_, at = [], 0
    while at < len(words):
        head = words[at][:depth]
        end = at + 1
        while end < len(words) and words[end].startswith(head):
            end += 1
        if len(head) == depth:
            open_.append((at, end))
        at = end
    while open_:
        low, high = open_.pop()
        if high - low < 2:
            continue
        d = shared(words[low], words[high - 1])
        head = words[low][:d]
        ends_here = len(words[low]) == d  # sorts first
        children, at = [], low + ends_here
        while at < high:
            end = bisect.bisect_left(words, head + chr(ord(words[at][d]) + 1), at, high)
            children.append((at, end))
            at = end
        open_ += children
        heavy = max(children, key=lambda c: c[1] - c[0])
        main = words[heavy[0]][d]
        if ends_here and head + main in known:
            yield [head + main], [head]
        skipped: dict[str, list[str]] = defaultdict(list)
        for child in children:
            for word in words[child[0] : child[1]] if child != heavy else ():
                rest = word[d + 1 :]
                skipped[rest].append(word)
                if rest[:1] != word[d] and head + rest in known:
                    yield [word], [head + rest]
                if head + main + word[d:] in known:
                    yield [head + main + word[d:]], [word]
        for rest, alike in skipped.items():
            if head + main + rest in known:
                alike.append(head + main + rest)
            if len(alike) > 1:
                yield alike, []


class Near:
    """For each word: how many near ones, and the best of them (greatest count, then the smallest word)."""

    def __init__(self, count: dict[str, int], back: bool):
        self.count, self.back, self.found = count, back, {}

    def _name(self, word: str) -> str:
        return word[::-1] if self.back else word

    def _meets(self, word: str, n: int, best: str) -> None:
        had = self.found.get(word)
        if had and (self.count[had[1]], self._reverse(had[1])) >= (self.count[best], self._reverse(best)):
            best = had[1]
        self.found[word] = ((had[0] if had else 0) + n, best)

    def _reverse(self, word: str) -> tuple:
        """Greater for smaller words."""
        return (*(-ord(c) for c in self._name(word)), 1)

    def add(self, alike: list[str], shorter: list[str]) -> None:
        if shorter:
            self._meets(alike[0], 1, shorter[0])
            self._meets(shorter[0], 1, alike[0])
            return
        first, second = sorted(alike, key=lambda w: (-self.count[w], self._name(w)))[:2]
        for word in alike:
            self._meets(word, len(alike) - 1, second if word == first else first)

    def rows(self) -> pa.Table:
        words = list(self.found)
        best = [self.found[w][1] for w in words]
        return pa.table([pa.array([self._name(w) for w in words], pa.string()), pa.array([self.found[w][0] for w in words], pa.int64()), pa.array([self.count[w] for w in best], pa.int64()), pa.array([self._name(w) for w in best], pa.string())], schema=_NEAR)


def _differ_early(alike: list[str], shorter: list[str], head: int) -> bool:
    """Of reversed words: whether the words themselves differ within their first ``head`` code points."""
    return alike[0][-head:] != (shorter or alike[1:])[0][-head:]


def _merger(depth: int, head: int, back: bool):
    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The near words among those of one task."""
        count = dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))
        near = Near(count, back)
        for alike, shorter in merged(sorted(count), depth):
            if not back or _differ_early(alike, shorter, head):
                near.add(alike, shorter)
        return near.rows()

    return merge


def _met(depth: int, head: int, back: bool):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of words with one rest -> the near words at the node of a long beginning."""
        for batch in batches:
            for rest, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                near = Near({m["word"]: m["n"] for m in members}, back)
                alike = sorted(m["word"] for m in members if m["word"] != rest)
                here = [rest] if len(alike) < len(members) else []
                pairs = [([w], here) for w in alike if here and rest[depth : depth + 1] != w[depth]]
                for got in [*pairs, *([(alike, [])] if len(alike) > 1 else [])]:
                    if not back or _differ_early(*got, head):
                        near.add(*got)
                if near.found:
                    yield from near.rows().to_batches()

    return meet


def near_words(words: DataFrame, head: int = HEAD, shard: int = SHARD) -> DataFrame:
    """word, n_near, best_n, best of every word (word, n) that has words one edit away; words of at least 2 * ``head`` code points."""
    size, found = words.count(), []
    tasks = max(shuffle_partitions(words.sparkSession), size // shard)
    for back in (False, True):
        open_, depth = words.select((F.reverse("word") if back else F.col("word")).alias("word"), "n"), head
        while open_ is not None:
            open_ = open_.withColumn("head", F.substring("word", 1, depth))
            heavy = checkpoint(open_.groupBy("head").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > shard).select("head"), shuffle_partitions(words.sparkSession))
            some = not heavy.isEmpty()
            light = open_.join(broadcast_if_few(heavy), "head", "left_anti") if some else open_
            task = F.pmod(F.xxhash64("head"), F.lit(tasks)).alias("task")
            found.append(light.select("word", "n", task).groupBy("task").applyInArrow(_merger(depth, head, back), NEAR))
            if some:
                open_ = checkpoint(open_.join(broadcast_if_few(heavy), "head", "left_semi").select("word", "n"))
                without = F.concat(F.substring("word", 1, depth), F.expr(f"substring(word, {depth + 2})"))
                met = open_.select(F.explode(F.when(F.length("word") > depth, F.array("word", without)).otherwise(F.array("word"))).alias("rest"), F.struct("word", "n").alias("of"))
                groups = met.groupBy("rest").agg(F.collect_list("of").alias("members")).filter("size(members) > 1")  # at most one a letter
                found.append(groups.mapInArrow(_met(depth, head, back), NEAR))
            else:
                open_ = None
            depth += 1
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("first")).select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def forms(words: DataFrame, factor: int = FACTOR, head: int = HEAD, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (word, n)."""
    words = checkpoint(words)
    near = near_words(words, head, shard).withColumnRenamed("word", "w")
    good = F.col("best_n") >= factor * F.col("n")
    named = checkpoint(words.join(near, F.col("word") == F.col("w"), "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")))
    most = named.agg(F.max("n")).first()[0] or 1
    steps = max(1, int(math.log(most, factor)) + 1)  # longest chain of forms
    hops = named.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        further = hops.select(F.col("word").alias("mid"), F.col("root").alias("end"))
        hops = checkpoint(hops.join(further, F.col("root") == F.col("mid"), "left").select("word", F.coalesce("end", "root").alias("root")))
    roots = hops.withColumnRenamed("word", "w")
    return named.join(roots, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", changed: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all texts."""
    return forms(vocabulary(docs, text_col, id_col, changed=changed))


SQL = f"""
WITH RECURSIVE crc AS (SELECT [list_reduce(list_prepend(i, [1, 2, 3, 4, 5, 6, 7, 8]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) FOR i IN range(256)] AS steps),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST} GROUP BY id, run),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, 128 + unicode(c)::BIGINT % 64] END FOR c IN string_split(id || ':' || run, '')])),
           lambda c, b: xor(c // 256, steps[xor(c % 256, b) + 1]))) AS h FROM each, crc),
slipped AS (SELECT CASE WHEN h % {SLIPS} = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= {SEEN}),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i::INTEGER) || substr(word, i::INTEGER + 2) AS rest FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)),
near AS (SELECT x.word, y.word AS other FROM cut x JOIN cut y USING (rest, i) WHERE x.word <> y.word
         UNION SELECT cut.word, rest FROM cut JOIN words ON words.word = rest UNION SELECT rest, cut.word FROM cut JOIN words ON words.word = rest),
best AS (SELECT near.word, count(*) AS n_near, min({{'less': -words.n, 'other': other}}) AS first FROM near JOIN words ON words.word = other GROUP BY near.word),
formed AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -first.less >= {FACTOR} * n THEN first.other END AS form, CASE WHEN -first.less >= {FACTOR} * n THEN -first.less END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM formed UNION ALL SELECT walk.word, form FROM walk JOIN formed ON formed.word = walk.at WHERE form IS NOT NULL)
SELECT formed.word AS word, formed.form AS form, walk.at AS root, formed.n AS n, formed.n_near::BIGINT AS n_near, formed.form_n::BIGINT AS form_n
FROM formed JOIN walk USING (word) JOIN formed AS last ON last.word = walk.at WHERE last.form IS NULL
"""
