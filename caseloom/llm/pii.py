"""Personal data by weak supervision, in DataFrame operations only.

Base spans are exact: regular expressions with checks (octets, digit counts,
Luhn).  The method adds spans of looser candidate kinds.  Four labelers vote on
every candidate, base or not: its format, a cue among the characters before it,
gazetteers (top-level domains, card issuers, calling codes; reserved networks,
example hosts, void numbers), and its company in the document.  Each vote is yes, no or abstain.

Expectation-maximisation over the table of vote patterns (bounded: 3**4 patterns
for each kind and feature cell, whatever the corpus) estimates how reliable each
labeler is; its posteriors, as soft labels, train the final span classifier, a
naive Bayes over kind, length, variety and votes' features.  Added candidates
with a probability of at least one half become spans; base spans always stay.

Positions come from marks: matches are wrapped in U+0001 and U+0002 and the text
split there.  Those two characters, should a text hold them, are first replaced
by U+0003, which no pattern matches either.

Defined cases: a null text is an empty one and has no span; a row that repeats
another is another row; null ids are kept; no rows give no rows; other columns
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.llm.frames import checkpoint, only

BASE = ("email", "ip", "card", "phone")
#: The base patterns.  The look-behinds only keep a failed match from being tried again inside the same run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A card candidate is a maximal run of digits with single blanks or hyphens: where one of 14 or more starts, where any ends.
CARD_START, CARD_END = r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9](?:[\x20-]?[0-9]){13})", r"(?<=[0-9])(?![\x20-]?[0-9])"
#: Looser candidates of the method.
ADDED = {
    "secret": r"(?<![A-Za-z0-9])[0-9a-f]{24,128}(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = (*BASE, *ADDED)
CUES = r"(?iu)\b(?:token|secret|key|password|passwd|api|mail|e-mail|contact|phone|tel|call|fax|card|visa|account|iban|ip|host|server|ssn|social)\b[^\n]{0,12}$"
#: Gazetteers.  What is nobody's: reserved networks, example hosts, test numbers, digests of the empty text.
RESERVED_NETWORKS = ("0.0.", "127.", "192.0.2.", "198.51.100.", "203.0.113.", "255.")
EXAMPLE_HOSTS = ("example.com", "example.org", "example.net", "localhost")
EMPTY_DIGESTS = ("d41d8cd98f00b204e9800998ecf8427e", "da39a3ee5e6b4b0d3255bfef95601890afd80709", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")
VOID_AREAS = ("000", "666")
#: Gazetteers.  What somebody has: top-level domains, issuer prefixes of cards, country calling codes.
DOMAINS = (
    "com", "org", "net", "edu", "gov", "info", "io", "eu", "at", "au", "be", "br", "ca", "ch", "cl", "cn", "co", "cz", "de", "dk", "es", "fi", "fr",
    "gr", "ie", "in", "it", "jp", "kr", "mx", "nl", "no", "pe", "pl", "pt", "ru", "se", "tr", "uk", "us",
)
ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
CALLING_CODES = (
    "1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56",
    "57", "58", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)


def _either(words) -> str:
    return "(?:" + "|".join(w.replace(".", r"\.") for w in words) + ")"


#: Of each kind, what its gazetteer knows as somebody's and as nobody's.  One sign repeated is nobody's whatever the kind.
SOMEBODY = {
    "email": rf"(?i)\.{_either(DOMAINS)}$",
    "card": rf"^{_either(ISSUERS)}",
    "phone": rf"^\+{_either(CALLING_CODES)}",
    "local_phone": r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]",
    "id_number": rf"^(?!{_either(VOID_AREAS)}|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)",
}
NOBODY = {
    "email": rf"(?i)@(?:[a-z0-9-]+\.)*{_either(EXAMPLE_HOSTS)}$",
    "ip": rf"^{_either(RESERVED_NETWORKS)}",
    "local_phone": r"555[\x20.-]01[0-9]{2}$",
    "id_number": rf"^(?:{_either(VOID_AREAS)}|9)|-00-|-0000$",
    "secret": rf"^{_either(EMPTY_DIGESTS)}$",
}
UNIFORM = r"^(.)\1+$"
ROUNDS = 60
#: Spans that gather before they join those found so far.
STRETCH = 512

MARK, STOP, SPARE = "\u0001", "\u0002", "\u0003"
_SPAN = "array<struct<start:int,end:int,text:string>>"


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _cut(marked: Column) -> Column:
    """Spans of a text with marks: start, end (code points, end exclusive), text.

    Stops without a mark before them count for nothing.  Arrays grow by copying,
    so spans gather in stretches first: a text of n spans costs n**1.5 and not n**2.
    """
    none = F.array().cast(_SPAN)
    bare = lambda piece: F.length(F.translate(piece, STOP, ""))

    def add(so_far: Column, piece: Column) -> Column:
        hit = F.substring_index(piece, STOP, 1)
        span = F.struct(so_far["at"].alias("start"), (so_far["at"] + F.length(hit)).alias("end"), hit.alias("text"))
        return F.struct((so_far["at"] + bare(piece)).alias("at"), F.concat(so_far["found"], F.array(span)).alias("found"))

    def spans(pieces: Column) -> Column:
        def stretch(so_far: Column, at: Column) -> Column:
            more = F.aggregate(F.slice(pieces, at, F.lit(STRETCH)), F.struct(so_far["at"].alias("at"), none.alias("found")), add)
            return _once(more, lambda m: F.struct(m["at"].alias("at"), F.concat(so_far["found"], m["found"]).alias("found")))

        start = F.struct(bare(F.element_at(pieces, 1)).alias("at"), none.alias("found"))
        return F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(pieces), F.lit(2)), F.lit(STRETCH)), start, stretch, lambda s: s["found"])

    return _once(F.split(marked, MARK), spans)


def _matches(text: Column, pattern: str) -> Column:
    return _cut(F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(f"{MARK}$1{STOP}")))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    """Whether 14 to 19 digits have a Luhn sum that ends in 0."""
    digits = F.reverse(_digits(text))
    each = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    total = F.aggregate(each, F.lit(0), lambda a, b: a + b)
    return F.length(digits).between(14, 19) & (total % 10 == 0)


def _octets(text: Column) -> Column:
    """Whether no dotted part is above 255, leading zeros aside."""
    bare = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(text, r"\."), lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= "255")))


def _tagged(kind: str, spans: Column, text: Column, valid=None) -> Column:
    kept = F.filter(spans, lambda s: valid(s["text"])) if valid else spans
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), s["text"].alias("text"), F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))).alias("before")))


def candidates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, base and added candidate spans of every row, in one pass over the texts and without a shuffle."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), MARK + STOP, SPARE + SPARE)
    rows = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text.alias("text"))
    rows = rows.withColumn("digits", F.col("text").rlike("[0-9]"))
    t = F.col("text")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,text:string,before:string>>")
    card = F.regexp_replace(F.regexp_replace(t, CARD_END, STOP), CARD_START, MARK)
    found = {
        "email": F.when(F.instr(t, "@") > 0, _tagged("email", _matches(t, EMAIL), t)),
        "ip": F.when(F.col("digits") & (F.instr(t, ".") > 0), _tagged("ip", _matches(t, IP), t, _octets)),
        "card": F.when(t.rlike(r"[0-9]{2}|[0-9][\x20-][0-9]"), _tagged("card", _cut(card), t, _luhn)),
        "phone": F.when(F.instr(t, "+") > 0, _tagged("phone", _matches(t, PHONE), t, lambda x: F.length(_digits(x)).between(10, 15))),
    }
    for kind, pattern in ADDED.items():
        sign = F.col("digits") if kind != "secret" else t.rlike("[0-9a-f]{24}")
        found[kind] = F.when(sign, _tagged(kind, _matches(t, pattern), t))
    rows = rows.select("doc_id", *[F.coalesce(c, none).alias(k) for k, c in found.items()])
    base = F.array_sort(F.concat(*[F.col(k) for k in BASE]))
    rows = rows.select("doc_id", base.alias("base"), F.concat(*[F.col(k) for k in ADDED]).alias("more"))
    clear = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return rows.select("doc_id", "base", F.array_sort(F.when(F.size("more") > 0, clear).otherwise(F.col("more"))).alias("more"))


def _judged(spans: Column, base: Column) -> Column:
    """Each span with its votes (1 yes, 0 no, 2 abstain) and its feature cell."""

    def judge(s: Column) -> Column:
        text, rank = s["text"], s["rank"]
        length = F.length(text)
        variety = F.size(F.array_distinct(F.split(text, "")))
        shape = F.when(rank == KINDS.index("secret"), F.when(length.isin(32, 40, 48, 64, 96, 128), 1).otherwise(0)).when(rank >= len(BASE), F.lit(2)).otherwise(F.lit(1))
        cue = F.when(s["before"].rlike(CUES), 1).otherwise(2)
        known = lambda table: F.coalesce(*[F.when(rank == KINDS.index(k), text.rlike(p)) for k, p in table.items()], F.lit(False))
        listed = F.when(known(NOBODY) | text.rlike(UNIFORM), 0).when(known(SOMEBODY), 1).otherwise(2)
        company = F.when(F.size(base) > F.when(rank < len(BASE), 1).otherwise(0), 1).otherwise(2)
        votes = ((shape * 3 + cue) * 3 + listed) * 3 + company
        cell = (F.least((length / 8).cast("int"), F.lit(7)) * 3 + F.least((variety / 6).cast("int"), F.lit(2))) * 2 + (cue == 1).cast("int")
        return F.struct(*[s[c].alias(c) for c in ("start", "rank", "end")], votes.cast("int").alias("votes"), cell.cast("int").alias("cell"))

    return F.transform(spans, judge)


def _votes(code: int) -> list[int]:
    return [code // 27 % 3, code // 9 % 3, code // 3 % 3, code % 3]


def reliabilities(table: list[tuple[int, int, int, int]]) -> tuple[float, list[tuple[float, float]], dict[int, float]]:
    """EM over (kind, votes, cell, count): prior, each labeler's chance of yes given yes and given no, posterior of each pattern."""
    counts: dict[int, float] = {}
    for _, votes, _, n in table:
        counts[votes] = counts.get(votes, 0) + n
    prior, chance = 0.6, [(0.8, 0.3)] * 4
    post: dict[int, float] = {}
    for _ in range(ROUNDS):
        for code in counts:
            yes, no = math.log(prior), math.log(1 - prior)
            for v, (a, b) in zip(_votes(code), chance, strict=True):
                if v < 2:
                    yes += math.log(a if v else 1 - a)
                    no += math.log(b if v else 1 - b)
            post[code] = 1 / (1 + math.exp(min(50, no - yes)))
        total = sum(counts.values())
        prior = min(0.99, max(0.01, (sum(n * post[c] for c, n in counts.items()) + 1) / (total + 2)))
        fresh = []
        for j in range(4):
            sums = [[1.0, 2.0], [1.0, 2.0]]
            for code, n in counts.items():
                v = _votes(code)[j]
                if v < 2:
                    for side, p in ((0, post[code]), (1, 1 - post[code])):
                        sums[side][0] += n * p * v
                        sums[side][1] += n * p
            fresh.append((min(0.99, max(0.01, sums[0][0] / sums[0][1] if sums[0][1] > 2 else 0.8)), min(0.99, max(0.01, sums[1][0] / sums[1][1]))))
        chance = fresh
    return prior, chance, post


def classifier(table: list[tuple[int, int, int, int]]) -> dict[int, bool]:
    """Naive Bayes over kind and feature cell and votes, trained on the posteriors: key rank * 10000 + cell * 100 + votes -> accept."""
    if not table:
        return {}
    prior, chance, post = reliabilities(table)
    sums: dict[tuple, list[float]] = {}
    whole = [1.0, 1.0]
    for rank, votes, cell, n in table:
        for side, p in ((0, post[votes]), (1, 1 - post[votes])):
            whole[side] += n * p
            for key in (("kind", rank), ("cell", cell)):
                sums.setdefault(key, [1.0, 1.0])[side] += n * p
    out = {}
    for rank, votes, cell, _ in table:
        z = math.log(post[votes] + 1e-9) - math.log(1 - post[votes] + 1e-9)
        for key in (("kind", rank), ("cell", cell)):
            yes, no = sums[key]
            z += 0.5 * (math.log(yes / whole[0]) - math.log(no / whole[1]))
        out[rank * 10000 + cell * 100 + votes] = z >= 0
    return out


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, base and all spans (start, rank, end) of every row, each in the order of (start, kind)."""
    rows = candidates(docs, text_col, id_col)
    rows = checkpoint(rows.select("doc_id", _judged(F.col("base"), F.col("base")).alias("base"), _judged(F.col("more"), F.col("base")).alias("more")))
    seen = rows.filter("size(base) + size(more) > 0").select(F.explode(F.concat("base", "more")).alias("s")).groupBy("s.rank", "s.votes", "s.cell").agg(F.count(F.lit(1)).alias("n"))
    table = sorted((r["rank"], r["votes"], r["cell"], r["n"]) for r in seen.collect())  # at most kinds x 81 x 48 rows
    good = [key for key, accept in classifier(table).items() if accept and key // 10000 >= len(BASE)]
    key = lambda s: s["rank"] * 10000 + s["cell"] * 100 + s["votes"]
    added = F.filter("more", lambda s: key(s).isin(good)) if good else F.slice("more", 1, 0)
    bare = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return rows.select("doc_id", bare(F.col("base")).alias("base"), F.array_sort(F.concat(bare(F.col("base")), bare(added))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the spans of ``find``."""
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
