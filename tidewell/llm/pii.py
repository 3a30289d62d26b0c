"""Personal data: patterns propose spans, checksums confirm them, context words weigh them. SQL functions only.

A kind has a pattern; its matches are leftmost and do not overlap. `split` at the pattern gives the text between
the matches, whose lengths place them: positions are code points, the end is exclusive. A match counts if its
check holds (number of digits, Luhn, mod 97, ranges); a failing match is dropped without a retry.

A match has a score: `CHECKED` if its kind is one of the base kinds (email, ip, card, phone) or has a checksum (iban: mod 97), else
`BARE`; a context word among the `NEAR` characters before it, back to the match before, adds `CONTEXT`. A match counts from `LEAST` on, so base kinds
always count and an id number needs its context word.

The patterns use possessive quantifiers, where giving back could not lead to a match, and look behind a match's
start, so a run of word characters is read once: time is linear in a text's length and no match recurses.

Defined results: a null text is empty; an empty text has no spans; repeated rows stay; columns besides the id and the text are
not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Characters before a match that context words are sought in, and weights.
NEAR, LEAST = 40, 0.7
CHECKED, BARE, CONTEXT = 0.7, 0.3, 0.4


class Kind(NamedTuple):
    name: str
    pattern: str
    needs: str  # a text without this character has no match
    base: bool
    check: str | None  # "digits a b", "luhn a b", "mod97" or "parts"
    context: str | None


LOCAL = "[A-Za-z0-9._%+-]"
KINDS = [
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, None, r"(?i)\b(?:e-?mail|contact|mailto)\b"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", True, "parts", r"(?i)\b(?:ip|host|server|addr(?:ess)?)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", True, "luhn 16 19", r"(?i)\b(?:card|visa|credit|debit|karte|carte|tarjeta)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True, "digits 8 15", r"(?i)\b(?:phone|tel|call|mobile|fax)\b"),
    Kind(
        "iban", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[0-9]{1,3})?)\b", "", False, "mod97",
        r"(?i)\b(?:iban|account|konto|compte|cuenta)\b",
    ),
    Kind("id_number", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "-", False, None, r"(?i)\b(?:ssn|social|id|passport|ausweis|dni)\b"),
]


def luhn(match: Column) -> Column:
    """Whether the digits of a match pass Luhn: every second digit from the right is doubled, its digits added."""
    at = F.filter(F.split(F.reverse(digits_of(match)), ""), lambda c: c != "")
    doubled = F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    terms = F.transform(at, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(doubled, c.cast("int") + 1)))
    return F.aggregate(terms, F.lit(0), lambda s, x: s + x) % 10 == 0


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def mod97(match: Column) -> Column:
    """Whether an account number passes ISO 7064 mod 97-10: first four to the end, A=10 ... Z=35, remainder 1."""
    packed = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(packed, F.lit(5)), F.substring(packed, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (F.when(value < 10, rest * 10).otherwise(rest * 100) + value) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def part_fits(part: Column) -> Column:
    """Whether a run of digits is at most 255, leading zeros aside."""
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) <= 3) & (F.coalesce(F.right(bare, F.lit(3)).try_cast("int"), F.lit(0)) <= 255)


def confirmed(match: Column, check: str | None) -> Column:
    if check is None:
        return F.lit(True)
    if check == "mod97":
        return mod97(match)
    if check == "parts":
        return F.forall(F.split(match, r"\."), part_fits)
    rule, least, most = check.split()
    fits = F.length(digits_of(match)).between(int(least), int(most))
    return F.when(fits, luhn(match)).otherwise(False) if rule == "luhn" else fits


def score(before: Column, kind: Kind) -> Column:
    """A match's weight: by kind and check, more if a context word stands among the characters before it."""
    checked = kind.base or kind.check is not None
    near = F.when(F.right(before, F.lit(NEAR)).rlike(kind.context), CONTEXT).otherwise(0.0)
    return F.least(F.round(F.lit(CHECKED if checked else BARE) + near, 2), F.lit(1.0))


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _matched(rows: DataFrame, text: str, kinds: list[Kind]) -> DataFrame:
    """For each kind, `name`: its confirmed and other matches with the text before each; `name__rest`: the text after the last."""
    have = {k.name: F.when(F.contains(text, F.lit(k.needs)), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))) for k in kinds}
    rows = rows.withColumns({f"{n}__m": c for n, c in have.items()})
    rows = rows.withColumns({f"{k.name}__b": F.when(F.size(f"{k.name}__m") > 0, F.split(text, k.pattern, -1)) for k in kinds})

    def weighed(kind: Kind) -> Column:
        pairs = F.arrays_zip(F.col(f"{kind.name}__m").alias("m"), F.slice(f"{kind.name}__b", 1, F.size(f"{kind.name}__m")).alias("b"))

        def weigh(x: Column) -> Column:
            return F.struct(x["m"].alias("m"), x["b"].alias("b"), confirmed(x["m"], kind.check).alias("good"), score(x["b"], kind).alias("score"))

        return F.when(F.size(f"{kind.name}__m") > 0, F.transform(pairs, weigh))

    rows = rows.withColumns({k.name: weighed(k) for k in kinds} | {f"{k.name}__rest": F.element_at(f"{k.name}__b", -1) for k in kinds})
    return rows.drop(*[f"{k.name}__{x}" for k in kinds for x in "mb"])


def _spans(kind: Kind) -> Column:
    """Place the matches: each lies after all texts between and all matches before it."""

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["b"])
        end = begin + F.length(x["m"])
        span = F.array(F.struct(F.lit(kind.name).alias("kind"), begin.alias("start"), end.alias("end"), x["score"].alias("score")))
        good = x["good"] & (x["score"] >= LEAST)
        return F.struct(end.alias("at"), F.when(good, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    empty = F.array().cast(SPAN)
    placed = F.aggregate(kind.name, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])
    return F.coalesce(placed, empty)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id` and, for each kind, an array of its spans `{kind, start, end, score}` in order of start."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _matched(rows, "text", KINDS).select("id", *[_spans(k).alias(k.name) for k in KINDS])


def listed(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a hash of their spans, and all spans, for each row."""
    found = find(docs, id_col, text_col)
    base = F.concat(*[F.col(k.name) for k in KINDS if k.base])
    every = F.concat(*[F.col(k.name) for k in KINDS])
    counts = [F.size(k.name).cast("long").alias(f"n_{k.name}") for k in KINDS if k.base]
    return found.select("id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(every).alias("spans"))


def merged(spans: Column) -> Column:
    """Overlapping spans as their union, in order of start; a union has the kind of its first span, of the longest that start there."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def state(out: Column, kind: Column, start: Column, end: Column) -> Column:
        return F.struct(out.alias("out"), kind.alias("kind"), start.alias("start"), end.alias("end"))

    def closed(s: Column) -> Column:
        last = F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(s["kind"].isNull(), s["out"]).otherwise(F.concat(s["out"], last))

    def step(s: Column, x: Column) -> Column:
        wider = state(s["out"], s["kind"], s["start"], F.greatest(s["end"], -x["back"]))
        return F.when(x["start"] < s["end"], wider).otherwise(state(closed(s), x["kind"], x["start"], -x["back"]))

    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return F.aggregate(ordered, state(empty, F.lit(None).cast("string"), F.lit(0), F.lit(0)), step, closed)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with every counted match of the text as it was replaced by its kind in brackets; matches that overlap are one."""
    at, spans = fresh("text", "spans")
    own = [k._replace(name=name) for k, name in zip(KINDS, fresh(*[k.name for k in KINDS]))]
    label = F.create_map(*[F.lit(x) for k, mine in zip(KINDS, own) for x in (mine.name, f"[{k.name.upper()}]")])
    rows = _matched(docs.withColumnRenamed(text_col, at), at, own)
    rows = rows.withColumn(spans, F.concat(*[_spans(k) for k in own])).withColumn(spans, merged(F.col(spans)))

    def piece(s: Column, i: Column) -> Column:
        end = F.coalesce(F.get(F.col(spans), i - 1)["end"], F.lit(0))
        return F.concat(F.substr(at, end + 1, s["start"] - end), F.element_at(label, s["kind"]))

    rest = F.substr(at, F.element_at(spans, -1)["end"] + 1)
    masked = F.concat(F.array_join(F.transform(spans, piece), ""), rest)
    rows = rows.withColumn(at, F.when(F.size(spans) > 0, masked).otherwise(F.col(at)))
    return rows.withColumnRenamed(at, text_col).select(docs.columns)
