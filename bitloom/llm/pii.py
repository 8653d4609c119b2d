"""Personal data: regular expressions propose, checksums confirm, context words adjust, in DataFrame functions only.

Kinds of the base, always kept when they pass their check: email, ip (parts up to
255), card (16 to 19 digits passing Luhn), phone (8 to 15 digits).  The method adds
kinds with a score: iban (mod-97), secret (a long token after a word such as "token"
or "password"), national_id (three groups of digits near a word that says so).  A
proposal starts with its kind's prior; a passed checksum and a context word within
``CONTEXT`` characters before or after it, as far as the next proposal of its kind, raise
the score, and ``LEAST_SCORE`` decides.

Expressions are matched over whole texts, leftmost first and without overlaps.
Quantifiers are possessive where giving back could never help, and runs are entered at
their first character only, so a very long run costs linear time and no deep stack.
Offsets are running totals found by blocks of matches, and texts are cut from blocks of
characters, so a text with very many matches costs linear time, too.

Edge cases: a null text is an empty one and has no span; equal rows get equal spans;
offsets are code points with the end exclusive; an empty table gives an empty result;
in :func:`redact` a row's other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Characters before and after a proposal in which context words count.
CONTEXT = 40
LEAST_SCORE = 0.5

# The lookbehinds stand where a proposal that fails at a run's first character fails at the
# others too; \G lets a match follow the one before directly.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Digits of the letters A to Z in mod-97 sums: 10 to 35.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

CONTEXT_WORDS = {
    "email": r"(?i)mail|contact|write",
    "ip": r"(?i)\bip\b|address|host|server|login",
    "card": r"(?i)card|visa|master|credit|payment|cvv",
    "phone": r"(?i)phone|tel|call|mobile|fax",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
    "secret": r"(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|hash)[\s\"':=|]*$",  # right before it
    "national_id": r"(?i)ssn|social security|tax id|national id",
}
#: Score of a proposal that matches its expression and passes its check, before context.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "secret": 0.1, "national_id": 0.3}
CONTEXT_RAISE = 0.5
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id", "secret")
MATCH = "array<struct<start:int,value:string,before:string,after:string>>"
#: Array entries in a block of running totals, and characters in a block of a text that is cut.
BLOCK, BLOCK_CHARS = 256, 2048
_LAST = (1 << 31) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and deep in loops it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, zero: int, join: Callable[[Column, Column], Column]) -> Column:
    """For each entry of an int array what the entries before it come to under ``join``, an associative function.

    Arrays grow by one only within blocks of BLOCK and from block to block, so long ones cost linear time.
    """

    def scan(entries: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(entries, first, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    start = F.lit(zero)
    blocks = let(values, lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(v, i + 1, F.lit(BLOCK))))
    return let(blocks, lambda bs: F.flatten(F.zip_with(bs, scan(F.transform(bs, lambda b: F.aggregate(b, start, lambda x, y: join(x, y))), start), scan)))


def matches(text: Column, pattern: str, possible: Column) -> Column:
    """Start, value and surroundings of each match.  Between the matches lie the pieces of a split, whose lengths give the starts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(pieces: Column, values: Column) -> Column:
        lengths = F.zip_with(F.slice(pieces, 1, F.size(values)), values, lambda p, m: F.length(p) + F.length(m))
        around = F.zip_with(F.slice(pieces, 1, F.size(values)), F.slice(pieces, 2, F.size(values)), lambda p, q: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(CONTEXT)).alias("before"), F.left(q, F.lit(CONTEXT)).alias("after")))
        with_value = F.zip_with(around, values, lambda x, m: F.struct(x["gap"].alias("gap"), x["before"].alias("before"), x["after"].alias("after"), m.alias("value")))
        return F.zip_with(with_value, running(lengths, 0, lambda x, y: x + y), lambda x, at: F.struct((at + x["gap"]).alias("start"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after")))

    some = let(F.struct(F.split(text, pattern, -1).alias("pieces"), found.alias("values")), lambda x: F.when(F.size(x["values"]) > 0, placed(x["pieces"], x["values"])))
    return F.coalesce(F.when(possible, some), F.array()).cast(MATCH)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass Luhn: from the right, each second one is doubled and its digits are added."""
    reverse = F.reverse(F.split(digits(value), ""))
    weighed = F.transform(reverse, lambda d, i: F.when(i % 2 == 1, F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number's check digits leave 1 modulo 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    letter = lambda c: F.instr(F.lit(LETTERS), c) + 9
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + letter(c)) % 97)) == 1


def _length_between(value: Column, least: int, most: int) -> Column:
    return F.length(digits(value)).between(least, most)


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"),
    "card": lambda v: F.when(_length_between(v, 16, 19), luhn(v)).otherwise(False),
    "phone": lambda v: _length_between(v, 8, 15),
    "iban": lambda v: F.when(F.length(F.replace(v, F.lit(" "), F.lit(""))).between(15, 34), mod97(v)).otherwise(False),
    "secret": lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"),
    "national_id": lambda v: ~v.rlike("^(?:000|666|9)") & ~v.rlike("-00-|-0000$"),
}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "secret": SECRET, "national_id": NATIONAL_ID}


def _possible(text: Column, kind: str) -> Column:
    """A cheap necessary condition, so that most texts skip the kind's expression."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike({"ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "secret": r"[A-Za-z0-9_/+=-]{20}", "national_id": r"-[0-9]{2}-[0-9]{4}"}[kind])


def spans_of(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind; those of a base kind don't need the score."""
    proposed = F.filter(matches(text, PATTERNS[kind], _possible(text, kind)), lambda m: CHECKS[kind](m["value"]))

    def scored(m):
        near = m["before"].rlike(CONTEXT_WORDS[kind])
        if kind != "secret":
            near = near | m["after"].rlike(CONTEXT_WORDS[kind])
        score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near, F.lit(CONTEXT_RAISE)).otherwise(F.lit(0.0)))
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), score.alias("score"))

    found = F.transform(proposed, scored)
    return found if kind in BASE else F.filter(found, lambda s: s["score"] >= LEAST_SCORE)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one array column per kind, ``pii_<kind>``, of struct(kind, start, end, score).

    One pass without a shuffle.  Added kinds give way where they overlap a base span.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({f"pii_{k}": spans_of(text, k) for k in (*BASE, *ADDED)})


def _clear_of(spans: Column, base: Column) -> Column:
    """The spans that overlap none of ``base``: among all by start, no base span before ends later and none behind starts earlier."""

    def kept(every: Column) -> Column:
        end_before = running(F.transform(every, lambda s: F.when(s["added"], -1).otherwise(s["end"])), -1, F.greatest)
        start_behind = F.reverse(running(F.reverse(F.transform(every, lambda s: F.when(s["added"], _LAST).otherwise(s["start"]))), _LAST, F.least))
        near = F.zip_with(end_before, start_behind, lambda e, s: F.struct(e.alias("e"), s.alias("s")))
        marked = F.zip_with(every, near, lambda x, n: F.when(x["added"] & (n["e"] <= x["start"]) & (n["s"] >= x["end"]), x["span"]))
        return F.filter(marked, lambda x: x.isNotNull())

    def marked(array: Column, added: bool) -> Column:
        return F.transform(array, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(added).alias("added"), s.alias("span")))

    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(let(F.array_sort(F.concat(marked(base, False), marked(spans, True))), kept))


def all_spans() -> Column:
    """Every span of :func:`find_spans`, by kind as listed, then by start."""
    base = F.concat(*[F.col(f"pii_{k}") for k in BASE])
    return F.concat(base, *[_clear_of(F.col(f"pii_{k}"), base) for k in ADDED])


def _cut_out(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to before ``end`` of a text that is given in blocks of BLOCK_CHARS."""
    first, last = F.floor(start / BLOCK_CHARS).cast("int"), F.floor(end / BLOCK_CHARS).cast("int")
    within = F.substr(F.get(blocks, first), start - first * BLOCK_CHARS + 1, end - start)
    head = F.substr(F.get(blocks, first), start - first * BLOCK_CHARS + 1)
    middle = F.array_join(F.slice(blocks, first + 2, last - first - 1), "")
    tail = F.coalesce(F.substr(F.get(blocks, last), F.lit(1), end - last * BLOCK_CHARS), F.lit(""))
    return F.when(end <= start, F.lit("")).when(first == last, within).otherwise(F.concat(head, middle, tail))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    rows = find_spans(docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), "_text")
    ordered = F.array_sort(F.transform(all_spans(), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = rows.select("_row", "_text", ordered.alias("_spans"))

    def replaced(x: Column) -> Column:
        upto = running(F.transform(x["spans"], lambda s: s["end"]), 0, F.greatest)
        pieces = F.zip_with(x["spans"], upto, lambda s, at: F.when(s["start"] >= at, F.concat(_cut_out(x["blocks"], at, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit("")))
        end = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), _cut_out(x["blocks"], end, x["n"]))

    parts = F.struct(F.col("_spans").alias("spans"), F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0)).alias("blocks"), F.length("_text").alias("n"))
    redacted = F.when(F.size("_spans") > 0, let(parts, replaced)).otherwise(F.col("_row")[text_col])
    return rows.select(*[(redacted if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the joined base spans, and all spans joined."""
    found = find_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    base = _joined(F.concat(*[F.col(f"pii_{k}") for k in BASE]))
    counts = [F.size(f"pii_{k}").cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), _joined(all_spans()).alias("spans"))
