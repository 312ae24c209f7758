"""Mixing sources to target weights by Pareto order sampling, by DataFrame functions only.

A source's target is shared out by weight and stops at a multiple of its size.  Inside a source a document of n words is
expected c * sqrt(n) times, so that long texts are taken more often than fragments, but at most that multiple; c is such
that the expected words are the target.  The whole part of a document's expected copies is certain.  The fraction left
is its inclusion probability, which differs by document, in a sample of fixed size: documents are ranked by random odds
over inclusion odds (Pareto order sampling), and the ranking is cut where the running total of words is nearest to what
the sample is to hold.

The sample is drawn by classes of length, from long to short.  A class is asked for its expected words and for what the
classes before it left open, so the words of a source come near its target although single texts may be long.  A
ranking is cut at one of CELLS bounds: sums by class and cell are all that a source is gathered to, and what a cell is
too coarse for goes on to the next class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (5, 2, 1)
MOST = 3
#: Bounds at which the ranking of a class may be cut, and classes of length (powers of two; the last has all above).
CELLS, CLASSES = 2048, 24
SEED = "mix-1"
#: Inclusion probabilities are whole multiples of 1 / UNIT, so their sums are exact in any order.
UNIT = 1 << 30


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A join key of a source that is not null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target: sizes in all shared by weight, none above most times its size.

    The excess of sources above their stop goes to the others by weight until none is above.  Sources in order of stop
    over weight: the first k are stopped, the others share the rest by weight, for the least k that lets all of them
    stay below their stop.  Weights repeat over the sources by code point, null last.  The table has a row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("stop", (F.col("source_size") * most).cast("double"))
    by = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(Window.partitionBy()).cast("double") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("free", F.col("level") * F.col("weight") <= F.col("stop"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("stop") / F.col("weight"), "level"))).over(Window.partitionBy())["level"]
    return s.withColumn("final", level).select("source", "source_size", "weight", F.least(F.col("stop"), F.coalesce(F.col("final") * F.col("weight"), F.col("stop"))).alias("target"))


def _measure(size: Column) -> Column:
    """What a document's expected copies are in proportion to: the square root of its words, as a whole number."""
    return F.floor(F.sqrt(size) * 64).cast("long")


def _class(size: Column) -> Column:
    return F.least(F.length(F.bin(size)), F.lit(CLASSES))


def _expected(size: Column, measure: Column, most: int) -> Column:
    """Expected copies, by the source's theta (null: each row most times)."""
    return F.when(size == 0, 0.0).when(F.col("theta").isNull(), float(most)).otherwise(F.least(F.lit(float(most)), F.col("theta") * measure))


def _share(expected: Column) -> Column:
    return F.floor((expected - F.floor(expected)) * UNIT).cast("long")


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(k, source, size) -> (k, source_size, target, theta) and (k, class, expected words of the sample).

    A row of measure x is expected min(most, theta * x) times.  Among a source's distinct measures, a few thousand however
    large the source, theta is taken for the largest one that it leaves at most or below.
    """
    by_x = cut(sizes.groupBy("k", "source", _measure(F.col("size")).alias("x"), _class(F.col("size")).alias("class")).agg(F.sum("size").alias("words")))
    totals = water_fill(by_x.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    totals = cut(totals.select(_key(F.col("source")).alias("k"), "source_size", "target"))
    down = Window.partitionBy("k").orderBy(F.col("x").desc())
    above, rest = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = by_x.where("x > 0").groupBy("k", "x").agg(F.sum("words").alias("words")).join(totals.where(F.col("target") < F.col("source_size") * most), "k")
    theta = (F.col("target") - most * F.coalesce(F.sum("words").over(above), F.lit(0)).cast("double")) / F.sum(F.col("x") * F.col("words")).over(rest).cast("double")
    best = t.withColumn("theta", theta).where(F.col("theta") * F.col("x") <= most).groupBy("k").agg(F.max(F.struct("x", "theta"))["theta"].alias("theta"))
    totals = cut(totals.join(best, "k", "left"))
    units = _share(_expected(F.col("x"), F.col("x"), most)).cast("decimal(12,0)") * F.col("words").cast("decimal(20,0)")
    need = by_x.where("x > 0").join(totals, "k").groupBy("k", "class").agg((F.sum(units).cast("double") / UNIT).alias("expected"))
    return totals, need


def _ranked(sizes: DataFrame, totals: DataFrame, most: int, seed: str) -> DataFrame:
    """sizes with source_size, target, whole (certain copies), class and cell (null where nothing is left to sample)."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "uid")), 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48
    d = sizes.join(totals, "k").withColumn("lam", _expected(F.col("size"), _measure(F.col("size")), most)).withColumn("p", _share(F.col("lam")) / F.lit(float(UNIT))).withColumn("u", u)
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    d = d.withColumn("odds", F.when(F.col("p") > 0, odds))
    cell = F.least(F.floor(F.col("odds") / (1 + F.col("odds")) * CELLS), F.lit(CELLS - 1)).cast("int")
    return d.withColumns({"whole": F.floor("lam").cast("int"), "class": _class(F.col("size")), "cell": cell}).drop("lam", "p", "u", "odds", "theta")


def _cuts(ranked: DataFrame, need: DataFrame) -> DataFrame:
    """(k, class, last): the last cell of each class that the sample takes, -1 for none."""
    cells = ranked.where("cell IS NOT NULL").groupBy("k", "class", "cell").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("k", "class").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = cells.select("k", "class", F.struct("cell", upto.alias("upto")).alias("c")).groupBy("k", "class").agg(F.collect_list("c").alias("cells"))
    by_source = rows.join(need, ["k", "class"]).groupBy("k").agg(F.sort_array(F.collect_list(F.struct((-F.col("class")).alias("turn"), "class", "expected", "cells"))).alias("classes"))

    def bound(value: Column, f) -> Column:
        """f(value) with value evaluated once, also inside the lambdas that f makes."""
        return F.element_at(F.transform(F.array(value), f), 1)

    def step(state: Column, c: Column) -> Column:
        def cut_at(x: Column) -> Column:  # x: upto, and the words wanted
            low = F.coalesce(F.array_max(F.filter(x["upto"], lambda u: u <= x["wanted"])), F.lit(0).cast("long"))
            return F.struct(x["wanted"].alias("wanted"), low.alias("low"), F.array_min(F.filter(x["upto"], lambda u: u > x["wanted"])).alias("high"))

        def taken(x: Column) -> Column:
            return F.struct(x["wanted"].alias("wanted"), F.when(x["high"] - x["wanted"] < x["wanted"] - x["low"], x["high"]).otherwise(x["low"]).alias("take"))

        def after(x: Column) -> Column:
            last = F.coalesce(F.array_max(F.transform(F.filter(c["cells"], lambda e: e["upto"] <= x["take"]), lambda e: e["cell"])), F.lit(-1))
            return F.struct((x["wanted"] - x["take"]).alias("carry"), F.concat(state["cuts"], F.array(F.struct(c["class"].alias("class"), last.alias("last")))).alias("cuts"))

        wanted = F.struct(F.transform(c["cells"], lambda e: e["upto"]).alias("upto"), (c["expected"] + state["carry"]).alias("wanted"))
        return bound(wanted, lambda x: bound(cut_at(x), lambda y: bound(taken(y), after)))

    start = F.struct(F.lit(0.0).alias("carry"), F.expr("cast(array() as array<struct<class:int,last:int>>)").alias("cuts"))
    return by_source.select("k", F.explode(F.aggregate("classes", start, step, lambda s: s["cuts"])).alias("c")).select("k", "c.class", "c.last")


def allocate(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, table: DataFrame | None = None) -> DataFrame:
    """sizes (doc_id, uid, source, size long, ...) -> with source_size, target, copies int: how often the mix takes the row.

    uid tells rows apart where their doc_id does not; rows alike in both and in source are taken together.  Reruns
    agree.  table: the same rows as sizes without its further columns, for the sums; sizes is then read once.
    """
    with_key = lambda d: d.withColumn("k", _key(F.col("source")))
    small = with_key(table if table is not None else sizes)
    totals, need = plan(small, weights, most)
    cuts = cut(_cuts(_ranked(small, totals, most, seed), need))
    d = _ranked(with_key(sizes), totals, most, seed).join(cuts, ["k", "class"], "left")
    copies = F.col("whole") + (F.coalesce(F.col("cell") <= F.col("last"), F.lit(False))).cast("int")
    return d.select(*sizes.columns, "source_size", "target", copies.alias("copies"))


def _uid(text: Column) -> Column:
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _uid(F.col("text")).alias("uid"), "source", word_count(F.col("text")).alias("size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies): a row per row of docs.

    Null or empty text, or one of white space: size 0, never taken.  Null source: a source of its own, last in order.
    Null ids are alike to the draw; repeated rows are taken together or not.  Very long texts are one row of their class
    of length.  Empty table: no rows.  Other columns are ignored.
    """
    d = allocate(cut(sized(docs)), weights, most, seed)
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs with every row as often as the mix takes it; rows keep all their columns, and texts are never shuffled."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", _uid(F.col("text")).alias("uid"), "source", word_count(F.col("text")).alias("size"))
    a = allocate(whole, weights, most, seed, cut(sized(docs))).where("copies > 0")
    return a.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
