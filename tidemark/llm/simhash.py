"""SimHash near-duplicates: 64-bit fingerprints compared exactly, tile by tile.

Distinct fingerprints fall into tiles by the population counts of their four 16-bit words.  The Hamming distance of two
fingerprints is at least the sum of the differences of those counts, so tile pairs whose counts differ by more than the
radius in total are skipped; every other pair of tiles meets, where numpy compares them by exclusive-or and bit counts,
block by block.  A tile and all that it meets are dealt by hash into squares of MOST by MOST fingerprints at most, each a
group of its own, so no group grows with the corpus.  A group yields a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import connected_components, cut

WORDS = 3
SEED = 42
RADIUS = 2
#: Fingerprints in one side of a block that numpy compares at once.
BLOCK = 1024
#: Fingerprints in one side of a group, about.
MOST = 8192


def fingerprint(text: str | None, width: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words (or null)."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < width else map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False))
    n = max(1, len(w) - width + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):  # bounds the memory that a very long text takes
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_series(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in text], np.uint64).view(np.int64))


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a signed long."""
    return F.pandas_udf(_fingerprint_series, LongType())(text)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long): a row per row of docs."""
    return docs.select(F.col(id_col), fingerprint_column(F.col(text_col)).alias("fp"))


def neighbour_tiles(radius: int, words: int = 4) -> list[tuple[int, ...]]:
    """Differences of tiles to compare: nought and the lexicographically positive ones of size radius at most."""
    return [d for d in product(range(-radius, radius + 1), repeat=words) if sum(map(abs, d)) <= radius and d >= (0,) * words]


def _forest(base: np.ndarray, more: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between base and more (which may hold base as well)."""
    nodes, of = np.unique(np.concatenate([base, more]), return_inverse=True)
    left, right = of[: len(base)], of[len(base) :]
    root = np.arange(len(nodes))

    def find(x: np.ndarray) -> np.ndarray:
        while True:
            y = root[x]
            if (y == x).all():
                return x
            x = y

    for i in range(0, len(base), BLOCK):
        for j in range(0, len(more), BLOCK):
            near = np.bitwise_count(base[i : i + BLOCK, None] ^ more[None, j : j + BLOCK]) <= radius
            a, b = np.nonzero(near)
            a, b = left[a + i], right[b + j]
            while len(a):
                ra, rb = find(a), find(b)
                if not (open_ := ra != rb).any():
                    break
                a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
                np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        root = find(root)
    top = find(np.arange(len(nodes)))
    linked = np.nonzero(top != np.arange(len(nodes)))[0]
    return list(zip(nodes[linked].view(np.int64).tolist(), nodes[top[linked]].view(np.int64).tolist(), strict=True))


def _tile_links(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int]] = []
        key, held = None, []

        def close() -> None:
            rows = np.concatenate(held)
            own = rows[:, 1] == 1
            fp = rows[:, 0].view(np.uint64) if rows[:, 0].flags.c_contiguous else np.ascontiguousarray(rows[:, 0]).view(np.uint64)
            if own.any() and len(fp) > 1:
                out.extend(_forest(fp[own], fp[~own], radius))

        for pdf in batches:
            t, rows = pdf["tile"].to_numpy(), pdf[["fp", "own"]].to_numpy(np.int64)
            at = [0, *(np.nonzero(t[1:] != t[:-1])[0] + 1).tolist(), len(t)]
            for i, j in zip(at, at[1:], strict=False):
                if i < j:
                    if t[i] != key and held:
                        close()
                        held = []
                    key = t[i]
                    held.append(rows[i:j])
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        if held:
            close()
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return run


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """distinct (fp long, each once) -> (a, b): links of distance radius at most that join all that such links join.

    Tiles are 17 ** 4 at most, so the table of how many parts each is dealt into is small enough to broadcast.
    """
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("int") for i in range(4)]
    tile = sum(((c + 8) * 64**i for i, c in enumerate(counts)), F.lit(0)).cast("long")
    shifts = [sum(x * 64**i for i, x in enumerate(d)) for d in neighbour_tiles(radius)]
    own = distinct.select("fp", tile.alias("tile"))
    to = F.explode(F.array(*(F.struct(F.lit(x).cast("long").alias("shift"), F.lit(int(not x)).cast("long").alias("own")) for x in shifts)))
    sizes = own.groupBy("tile").count()
    parts = sizes.select("tile", "count", to.alias("c")).groupBy((F.col("tile") - F.col("c.shift")).alias("tile"))
    parts = parts.agg(F.ceil(F.sum(F.col("count") * F.col("c.own")) / most).alias("rows"), F.ceil(F.sum("count") / most).alias("cols")).where("rows > 0")
    spread = own.select("fp", "tile", to.alias("c")).select("fp", (F.col("tile") - F.col("c.shift")).alias("tile"), "c.own")
    spread = spread.join(F.broadcast(parts), "tile")
    h = F.xxhash64("fp")
    row, col = F.pmod(h, "rows"), F.pmod(F.shiftright(h, 8), "cols")

    def all_of(n: str) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)

    squares = F.transform(all_of("rows"), lambda i: F.struct(i.alias("i"), col.alias("j"), F.lit(0).cast("long").alias("own")))
    as_base = F.transform(all_of("cols"), lambda j: F.struct(row.alias("i"), j.alias("j"), F.lit(1).cast("long").alias("own")))
    spread = spread.select("fp", "tile", F.explode(F.when(F.col("own") == 1, F.concat(squares, as_base)).otherwise(squares)).alias("s"))
    spread = spread.select(F.xxhash64("tile", "s.i", "s.j").alias("tile"), "s.own", "fp")
    n = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.repartition(n, "tile").sortWithinPartitions("tile").mapInPandas(_tile_links(radius), "a long, b long")


def _classes(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct (fp, ...) -> with c, the least fingerprint (as a signed long) that links reach."""
    comp = connected_components(fingerprint_links(distinct.select("fp"), radius))
    return cut(distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(*distinct.columns, F.coalesce("component", "fp").alias("c")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id_col, fp, component_id): a row per row of docs; component_id is the smallest id reachable by links.

    Null text: as an empty one, fingerprint 0, linked like any other.  Null id: the row stays, its id never names a
    component unless all ids there are null (then null).  Repeated rows and equal texts share a fingerprint, hence a
    component.  Very long texts are counted in blocks of shingles.  Empty table: no rows.  Other columns are not looked at.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    named = _classes(cut(fps.groupBy("fp").agg(F.min(id_col).alias("low"))), radius)
    least = named.groupBy("c").agg(F.min("low").alias("component_id"))
    by_fp = named.join(least, "c").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id (of several, the first written).

    Every text is fingerprinted once; rows carry a number by which those kept are found again.  Nulls, repeated rows and
    very long texts as in near_duplicates; a null doc_id is kept only where its group has no other.
    """
    rows = cut(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", fingerprint_column(F.col("text")).alias("fp"), F.monotonically_increasing_id().alias("rid")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    named = _classes(cut(rows.groupBy("fp").agg(first.alias("low"))), radius)
    kept = named.groupBy("c").agg(F.min("low")["rid"].alias("rid")).select("rid")
    return rows.join(kept, "rid", "left_semi").select("row.*")
