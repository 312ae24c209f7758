"""Personal data in texts, by DataFrame functions only.

Regular expressions propose spans, validators confirm them (octet range, Luhn, digit counts, ISO 7064 mod 97), and
words nearby move the score.  A proposal's place is found by marking every match with U+0001, splitting there and adding
up the lengths, all in one pass over the text.  Repetitions are possessive wherever that cannot change the match, so
matching takes linear time and no stack on very long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: kinds in the order that breaks ties, with patterns (Java), base score and context words
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn")
KINDS = BASE + EXTRA
CONTEXT = {
    "email": (0.9, r"(?i)\b(e-?mail|mail|contact|write|reply)\b"),
    "ip": (0.6, r"(?i)\b(ip|address|host|server|client|login)\b"),
    "card": (0.8, r"(?i)\b(card|visa|mastercard|amex|credit|debit|cvv|payment)\b"),
    "phone": (0.7, r"(?i)\b(phone|tel|telephone|call|mobile|fax|whatsapp)\b"),
    "iban": (0.9, r"(?i)\b(iban|bank|account|konto|transfer|sepa)\b"),
    "ssn": (0.4, r"(?i)\b(ssn|social|security|taxpayer)\b"),
}
#: Code points before and after a span where context words count, and what they add.
NEAR, GAIN = 40, 0.3
#: A span that is not of a base kind needs this score.
LEAST = 0.5

#: Parts of a split text that are gone through together; an even number, so that matches stay at odd places.
PARTS = 128

MARK, STAND_IN = "\x01", "\x02"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    d = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    doubled = lambda x: F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, doubled(d(i))).otherwise(d(i)))
    return total % 10 == 0


def mod97_valid(code: Column) -> Column:
    """Whether an international account number (spaces allowed) leaves 1 when divided by 97."""
    c = F.replace(code, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, F.lit(1), F.lit(4)))

    def step(a: Column, i: Column) -> Column:
        x = F.substring(turned, i, F.lit(1))
        v = F.when(x.between("0", "9"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
        return F.when(v < 10, (a * 10 + v) % 97).otherwise((a * 100 + v) % 97)

    return F.length(c).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), F.lit(0), step) == 1)


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.regexp_like(m, F.lit(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")),
    "card": lambda m: F.when(F.length(_digits(m)).between(14, 19), luhn_valid(_digits(m))).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
    "iban": mod97_valid,
    "ssn": lambda m: ~F.regexp_like(m, F.lit(r"^(000|666|9..)|-00-|-0000$")),
}
PATTERN = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, IBAN, SSN), strict=True))
#: What a text must hold for a kind to be looked for: spares most texts the matching.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}


def _spans_of(text: Column, kind: str) -> Column:
    """array<struct<kind, rank, start, end, score>> of a kind's confirmed spans; start and end in code points."""
    rank = KINDS.index(kind)
    parts = F.split(F.regexp_replace(F.translate(text, MARK, STAND_IN), F.lit(f"({PATTERN[kind]})"), F.lit(f"{MARK}$1{MARK}")), MARK, -1)
    score, words = CONTEXT[kind]

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(p)
        found = F.when(a["odd"] & VALID[kind](p), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), end.alias("end"))))).otherwise(a["out"])
        return F.struct(end.alias("at"), (~a["odd"]).alias("odd"), found.alias("out"))

    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>")
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), empty.alias("out"))

    def bound(value: Column, f) -> Column:
        """f(value), with value evaluated once however often f uses it."""
        return F.element_at(F.transform(F.array(value), f), 1)

    def placed(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + b["at"])))
        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda b, o: F.transform(b["out"], lambda s: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end")))))

    # spans are gathered by blocks of parts: an array that grows by one is copied each time
    of = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / PARTS).cast("int")), lambda b: F.aggregate(F.slice(p, b * PARTS + 1, F.lit(PARTS)), zero, step, lambda a: a))
    spans = bound(parts, lambda p: bound(of(p), placed))

    def scored(s: Column) -> Column:
        low = F.greatest(s["start"] - NEAR, F.lit(0))
        near = F.concat(F.substring(text, low + 1, s["start"] - low), F.lit(" "), F.substring(text, s["end"] + 1, F.lit(NEAR)))
        bonus = F.when(F.regexp_like(near, F.lit(words)), F.lit(GAIN)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.least(F.lit(1.0), F.lit(score) + bonus).alias("score"))

    all_ = F.transform(spans, scored)
    if kind in EXTRA:
        all_ = F.filter(all_, lambda s: s["score"] >= LEAST)
    none = F.from_json(F.lit("[]"), "array<struct<kind:string,rank:int,start:int,end:int,score:double>>")
    gate = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.regexp_like(text, F.lit(r"[0-9][\x20-]?[0-9]" if kind == "card" else r"[A-Z]{2}[0-9]{2}"))
    return F.when(gate, all_).otherwise(none)


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """docs with out_col: array of (kind, rank, start, end, score) by start, then kind as listed.

    Null or empty text: an empty array.  Very long texts are searched whole, in time that grows with their length; a
    text's confirmed spans are gathered in one array.  Spans that begin together stand in the order of their kinds.  Rows
    are kept as they are, repeated ones too; an empty table gives no rows; other columns stay (one named out_col is replaced).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score"))
    found = F.concat(*(_spans_of(text, k) for k in kinds))
    return docs.withColumn(out_col, F.transform(F.array_sort(F.transform(found, key)), lambda s: F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores_text(spans: Column) -> Column:
    """The spans' scores in hundredths, in their order."""
    return F.array_join(F.transform(spans, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of text_col replaced by its kind in angle brackets (overlapping spans: by the first's)."""
    cols = docs.columns
    held = docs.select(F.struct(*cols).alias("row"), F.col(text_col).alias("text"))
    found = find_pii(held, "text", "pii")
    text = F.col("text")

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        piece = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(a["out"]).alias("out"))

    done = F.aggregate("pii", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return found.select("row", F.when(F.size("pii") > 0, done).otherwise(text).alias("text")).select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in cols))
