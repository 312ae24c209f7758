"""Text functions.  Built-in expressions wherever Spark has them; Arrow UDFs only for HTML entities and NFKC."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

SPACE = r"(?U)\s+"
# fixed values: entities that the JVM form of clean_text knows, a subset of HTML's
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
# fixed values: spellings made one
PROTOCOLS = {"wi-fi": "wifi", "wi fi": "wifi", "z-wave": "zwave", "z wave": "zwave"}
FAILURE_TYPES = ("N0", "F1", "F2", "F3", "F4", "F5", "F6", "F7", "F8")
# fixed values: what the scan for personal data looks for
PII_PATTERNS = {
    "email": r"(?i)(?<![\w.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![\w.-])",
    "us_phone": r"(?<!\d)(?:\+?1[\s.\-]?)?(?:\(?\d{3}\)?[\s.\-])\d{3}[\s.\-]\d{4}(?!\d)",
    "order_id": r"(?<!\d)\d{3}-\d{7}-\d{7}(?!\d)",
    "windows_path": r"(?i)\b[A-Z]:\\(?:[^\\\s]+\\)*[^\\\s]*",
    "chat_marker": r"(?i)wxid_|xwechat_files|wechat|微信",
}


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def nfkc(c: Column, fold: bool = False) -> Column:
    """NFKC, case-folded if fold.  Python sees only the texts that hold characters outside ASCII; null gives ""."""

    def run(s: pd.Series) -> pd.Series:
        import unicodedata

        def one(x: str | None) -> str | None:
            if x is None:
                return None
            x = unicodedata.normalize("NFKC", x)
            return x.casefold() if fold else x

        return s.map(one)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    odd = F.when(F.length(c) != F.octet_length(c), c)
    return F.coalesce(F.pandas_udf(run, StringType())(odd), F.lower(c) if fold else c, F.lit(""))


def clean_text(c: Column) -> Column:
    """struct(text, changed, html, unicode, whitespace): unescaped, without tags, NFKC, spaces collapsed; null gives ""."""

    def run(s: pd.Series) -> pd.DataFrame:
        import html
        import re
        import unicodedata

        tag = re.compile(r"</?[A-Za-z][^>]*>")
        out = []
        for x in s:
            x = x or ""
            plain = tag.sub(" ", html.unescape(x))
            norm = unicodedata.normalize("NFKC", plain)
            done = re.sub(r"\s+", " ", norm).strip()
            out.append((done, done != x, plain != x, norm != plain, done != norm))
        return pd.DataFrame(out, columns=["text", "changed", "html", "unicode", "whitespace"])

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    flags = [StructField(n, BooleanType()) for n in ("changed", "html", "unicode", "whitespace")]
    return F.pandas_udf(run, StructType([StructField("text", StringType()), *flags]))(c)


def clean_text_simple(c: Column) -> Column:
    """clean_text without NFKC, for the entities above; stays in the JVM."""
    c = F.coalesce(c, F.lit(""))
    for k, v in ENTITIES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return collapse(F.regexp_replace(c, r"</?[A-Za-z][^>]*>", " "))


def normalize_for_dedup(c: Column) -> Column:
    """NFKC, collapsed and case-folded."""
    return collapse(nfkc(c, fold=True))


def normalize_simple(c: Column) -> Column:
    """NFKC, lower case, spaces collapsed."""
    return collapse(F.lower(nfkc(c)))


def normalize_rule(c: Column) -> Column:
    """NFKC, case-folded, & as "and", every run of characters that are neither letters nor numbers one space."""
    return F.trim(F.regexp_replace(F.replace(nfkc(c, fold=True), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " "))


def normalize_protocol(c: Column) -> Column:
    """NFKC, case-folded ASCII words with the spellings of wifi and zwave made one."""
    c = nfkc(c, fold=True)
    for a, b in PROTOCOLS.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def normalized_term(term: str) -> str:
    """normalize_protocol for one term, on the driver."""
    import re
    import unicodedata

    t = unicodedata.normalize("NFKC", term).casefold()
    for a, b in PROTOCOLS.items():
        t = t.replace(a, b)
    return re.sub("[^a-z0-9]+", " ", t).strip()


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once however often f uses it; it may hold a Python function, which lambdas may not."""
    return F.element_at(F.transform(F.array(value), f), 1)


def has_term(text: Column, term: str) -> Column:
    """Whether a normalised text holds a normalised term as whole words."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {term} "))


def matching_terms(text: Column, terms: Sequence[str]) -> Column:
    """The terms that a normalised text holds, sorted; the text is padded once, the terms are one constant array."""
    if not terms:
        return F.array().cast("array<string>")
    padded, known = F.concat(F.lit(" "), text, F.lit(" ")), F.array(*map(F.lit, sorted(set(terms))))
    return _bound(padded, lambda p: F.filter(known, lambda t: F.contains(p, F.concat(F.lit(" "), t, F.lit(" ")))))


def word_boundary_terms(text: Column, terms: Sequence[str]) -> Column:
    """The terms that stand in a text between characters that are no ASCII letters or digits, sorted; one pattern a term."""
    found = [F.when(F.regexp_like(text, F.lit(rf"(?<![a-z0-9])\Q{n}\E(?![a-z0-9])")), F.lit(t)) for t in sorted(set(terms)) if (n := normalized_term(t))]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def within_tokens(text: Column, left: Sequence[str], right: Sequence[str], distance: int) -> Column:
    """Whether a word of left stands at most distance words from one of right."""
    at = lambda words, ws: F.filter(F.transform(words, lambda w, i: F.when(w.isin(*ws), i)), lambda x: x.isNotNull())
    near = lambda words: _bound(at(words, right), lambda b: F.exists(at(words, left), lambda x: F.exists(b, lambda y: F.abs(x - y) <= distance)))
    return _bound(F.split(text, " "), near)


def truncate(c: Column, limit: int = 420) -> Column:
    c = collapse(F.coalesce(c, F.lit("")))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 1), F.lit("…")))


def snippet(c: Column, terms: Sequence[str], limit: int = 420) -> Column:
    """Text around the first of the terms (third of the limit before it), with ellipses where it is cut."""
    text, known = collapse(F.coalesce(c, F.lit(""))), F.array(*(F.lit(normalized_term(t)) for t in terms))
    return _bound(F.struct(text.alias("text"), normalize_protocol(text).alias("low")), lambda s: snippet_at(s["text"], s["low"], known, limit))


def snippet_at(text: Column, low: Column, terms: Column, limit: int = 420) -> Column:
    """snippet of a collapsed text, whose terms (an array of normalised ones) are looked for in low, its normalised form."""
    found = F.array_min(F.filter(F.transform(F.filter(terms, lambda t: t != ""), lambda t: F.position(t, low)), lambda p: p > 0))
    start = F.greatest(F.lit(0), found - 1 - limit // 3)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, F.lit(limit)), F.when(start + limit < F.length(text), "…").otherwise(""))
    return F.when(text == "", "").when(found.isNull(), truncate(text, limit)).otherwise(cut)


def flatten_json(c: Column) -> Column:
    """The strings and numbers in a JSON document, in order, space-joined (keys left out).  An Arrow UDF: it recurses."""

    def run(s: pd.Series) -> pd.Series:
        import json

        def walk(x):
            if isinstance(x, dict):
                for v in x.values():
                    yield from walk(v)
            elif isinstance(x, list):
                for v in x:
                    yield from walk(v)
            elif x is not None:
                yield str(x)

        def one(x):
            try:
                return " ".join(walk(json.loads(x))) if x else ""
            except ValueError:
                return x

        return s.map(one)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, StringType())(c)


def keyword_codes(text: Column, categories: Mapping[str, Sequence[str]], context: Sequence[str] = (), general: Sequence[str] = (), harmless: Sequence[str] = (), fallback: str = "F1") -> Column:
    """Codes of the categories any of whose patterns is found, in rule order; else fallback if a context and a general
    pattern are found and no harmless one; an empty array otherwise.  text is normalised already."""
    none = F.array().cast("array<string>")

    def found(t: Column) -> Column:
        hit = lambda ps: F.regexp_like(t, F.lit("(?i)" + "|".join(f"(?:{p})" for p in ps))) if ps else F.lit(False)
        codes = F.array_compact(F.array(*(F.when(hit(ps), F.lit(code)) for code, ps in categories.items())))
        loose = hit(context) & hit(general) & ~hit(harmless)
        return _bound(codes, lambda c: F.when(F.size(c) > 0, c).when(loose, F.array(F.lit(fallback))).otherwise(none))

    return _bound(text, lambda t: F.when(t == "", none).otherwise(found(t)))


def strip_star_header(c: Column) -> Column:
    """Without a first line that only says how many stars."""
    return F.regexp_replace(c, r"(?i)^\s*(?:one|two|three|four|five)\s+stars?\s*(?:[.!:;\-–—]+\s*)?(?:(?:\r?\n)+|$)", "")


def join_nonempty(*cs: Column, separator: str = "\n\n") -> Column:
    return F.concat_ws(separator, *(F.nullif(F.trim(c), F.lit("")) for c in cs))


def language_gate(text: Column, detected: Column, confidence: Column, letters: int = 10, chars: int = 12, least: float = 0.70) -> Column:
    """Status of a text from a detector's answer; short texts are not judged."""
    alpha = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when((F.length(text) < chars) | (alpha < letters), "undetermined_short").when(detected.isNull(), "undetermined_other").when((detected == "en") & (confidence >= least), "English").otherwise("non-English")


def rating_stratum(rating: Column) -> Column:
    return F.when(rating <= 2, "low_1_2").when(rating == 3, "middle_3").otherwise("high_4_5")


def time_stratum(ts: Column) -> Column:
    y = F.year(ts)
    return F.when(y <= 2017, "early_2011_2017").when(y <= 2020, "middle_2018_2020").otherwise("recent_2021_2023")


def normalize_binary(c: Column) -> Column:
    """"0", "1", "uncertain", "" for blank; null marks an illegal value."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    t = F.regexp_replace(t, r"^([01])\.0+$", "$1")
    return F.when(t.isin("0", "1", "uncertain", ""), t)


def normalize_codes(c: Column, legal: Sequence[str] = FAILURE_TYPES) -> Column:
    """Codes split at ; , | / and spaces, upper-cased, each once, in canonical order, joined by ;.  Illegal ones: null."""
    have = F.filter(F.split(F.upper(F.trim(F.coalesce(c, F.lit("")))), r"[;,|/\s]+"), lambda x: x != "")
    known = F.array(*map(F.lit, legal))
    return F.when(F.size(F.array_except(have, known)) == 0, F.array_join(F.array_intersect(known, have), ";"))


def label_violation(binary: Column, codes: Column, severity: Column, persistence: Column) -> Column:
    """What is wrong with a label row (null: nothing).  codes as from normalize_codes."""
    ok0 = (codes == "N0") & severity.eqNullSafe(F.lit(0)) & persistence.eqNullSafe(F.lit(0))
    ok1 = (codes != "") & ~F.contains(codes, F.lit("N0"))
    full = F.coalesce(severity.between(1, 3) & persistence.between(0, 2), F.lit(False))
    bad = F.when(F.coalesce(~binary.isin("0", "1", "uncertain"), F.lit(True)), "illegal_binary").when(codes.isNull(), "illegal_code")
    bad = bad.when((binary == "0") & ~ok0, "non_failure_must_be_blank").when((binary == "1") & ~ok1, "failure_needs_codes").when((binary == "1") & ~full, "failure_incomplete")
    return bad.when((binary == "uncertain") & ((codes != "") | severity.isNotNull() | persistence.isNotNull()), "uncertain_must_be_blank")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")
