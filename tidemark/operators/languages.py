"""Language detection by profiles of letter trigrams, learnt from texts whose language is known.

A profile is how often a language's texts have each trigram; a text's language is the one under which its trigrams are
likeliest, and its confidence the posterior with equal priors.  Profiles are counted over all texts given and scored in
the JVM: a table of at most MOST trigrams a language, which is bounded and so broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

#: Trigrams that a language's profile keeps.
MOST = 3000
#: Trigrams that a text is judged by at most weigh as so many, so that long texts are not absurdly sure.
WEIGHT = 50


def trigrams(word: Column) -> Column:
    """The trigrams of a word between two spaces; words are short, so cutting each from the start is cheap."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(padded, i, F.lit(3)))


def _counts(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, gram, n): letter trigrams of the lower-cased words; words are counted first, since they repeat."""
    letters = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+", " ")
    words = docs.select(*keys, F.explode(F.split(letters, " ")).alias("word")).where("word <> ''").groupBy(*keys, "word").agg(F.count("*").alias("n"))
    return words.select(*keys, "n", F.explode(trigrams(F.col("word"))).alias("gram")).groupBy(*keys, "gram").agg(F.sum("n").alias("n"))


def fit_profiles(docs: DataFrame, text: str, lang: str, most: int = MOST) -> DataFrame:
    """(gram, weights): for each trigram of some profile, the logarithm of its share in every language."""
    c = cut(_counts(docs.where(F.col(lang).isNotNull()), [lang], text).withColumnRenamed(lang, "lang"))
    total = c.groupBy("lang").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = c.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    grid = kept.select("gram").distinct().crossJoin(F.broadcast(total))
    share = F.log((F.coalesce("n", F.lit(0)) + 0.5) / (F.col("total") + 0.5 * most))
    return grid.join(c, ["lang", "gram"], "left").groupBy("gram").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", F.round(share, 9).alias("w"))))).alias("weights"))


def detect(docs: DataFrame, key: str, text: str, profiles: DataFrame, target: str = "en") -> DataFrame:
    """docs with detected (null where no trigram is known or two languages are as likely) and confidence (of target)."""
    hits = _counts(docs.dropDuplicates([key]), [key], text).join(F.broadcast(profiles), "gram")
    one = hits.select(key, "n", F.explode("weights").alias("lang", "w")).groupBy(key, "lang").agg(F.sum(F.col("n") * F.col("w")).alias("s"), F.sum("n").alias("m"))
    one = one.select(key, "lang", F.round(F.col("s") / F.greatest(F.col("m") / WEIGHT, F.lit(1.0)), 6).alias("s"))
    by = one.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("s", "lang")), asc=False).alias("l"))  # one entry a language
    odds = F.aggregate(F.transform("l", lambda x: F.exp(x["s"] - F.col("l")[0]["s"])), F.lit(0.0), lambda a, x: a + x)
    mine = F.aggregate(F.transform(F.filter("l", lambda x: x["lang"] == target), lambda x: F.exp(x["s"] - F.col("l")[0]["s"])), F.lit(0.0), lambda a, x: a + x)
    tie = (F.size("l") > 1) & (F.try_element_at("l", F.lit(2))["s"] == F.col("l")[0]["s"])
    found = by.select(F.col(key).alias("__key"), F.when(~tie, F.col("l")[0]["lang"]).alias("detected"), (mine / odds).alias("confidence"))
    return docs.join(found, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
