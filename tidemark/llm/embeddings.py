"""Near-duplicate embeddings by cross-polytope hashing.

A vector is scaled to length 1, padded to a power of two and turned by three rounds of random signs and a fast Hadamard
transform; its hash is the axis it is nearest to, with sign.  A table's bucket is the label with three such hashes;
each vector also probes the buckets of the next nearest axes.  Vectors that share a bucket are candidates and are verified by
their cosine in double precision.  Equal vectors of one label are collapsed first and counted by weight.

A bucket is cut into tiles of bounded size, and every pair of tiles is a group of its own, so no task gathers a bucket.
A pair that shares several buckets counts only in the first of them, so links are counted once; groups return counts
and a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import connected_components, cut

THRESHOLD = 0.93
TABLES = 10
#: Buckets that a vector enters in a table: its own, and those with one hash replaced by the next nearest axis.
PROBES = 4
HASHES = 3
SEED = 7
#: Vectors in a tile.
TILE = 1024


@lru_cache(maxsize=8)
def _signs(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2, (count, 3, dim)).astype(np.float64) * 2 - 1


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def codes(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(n, tables * probes) bucket codes of unit vectors; a table's codes are distinct and never those of another."""
    n, dim = x.shape
    size = 1 << max(1, (dim - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - dim)))
    out = np.empty((n, tables, probes), np.int64)
    signs = _signs(size, tables * HASHES, seed)
    for t in range(tables):
        best, then, lost = (np.empty((n, HASHES), k) for k in (np.int64, np.int64, np.float64))
        for k in range(HASHES):
            y = x
            for s in signs[t * HASHES + k]:
                y = hadamard(y * s)
            mag = np.abs(y)
            order = np.argpartition(-mag, 1, axis=1)[:, :2]
            top = np.take_along_axis(mag, order, 1)
            swap = top[:, 1] > top[:, 0]
            order[swap], top[swap] = order[swap][:, ::-1], top[swap][:, ::-1]
            axis = order * 2 + (np.take_along_axis(y, order, 1) < 0)
            best[:, k], then[:, k], lost[:, k] = axis[:, 0], axis[:, 1], top[:, 0] - top[:, 1]
        cheap = np.argsort(lost, axis=1, kind="stable")  # hashes whose second axis is nearly as near go first
        for p in range(probes):
            axes = best.copy()
            if p:
                k = cheap[:, p - 1 : p]
                np.put_along_axis(axes, k, np.take_along_axis(then, k, 1), 1)
            number = np.full(n, t, np.int64)
            for k in range(HASHES):
                number = number * (2 * size) + axes[:, k]
            out[:, t, p] = number
    return out.reshape(n, -1)


def _codes_column(tables: int, probes: int, seed: int):
    def run(vec: pd.Series) -> pd.Series:
        out: list = [None] * len(vec)
        sizes = np.array([len(v) for v in vec])
        for d in np.unique(sizes):
            at = np.nonzero(sizes == d)[0]
            got = codes(unit(np.stack([np.asarray(vec.iloc[i], np.float64) for i in at])), tables, probes, seed)
            for i, c in zip(at, got, strict=True):
                out[i] = c
        return pd.Series(out)

    return run


def usable(vec: Column) -> Column:
    """Whether a vector can link: not null, not empty, not zero, all components finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


#: Rows that a task verifies at once (more if a pair of tiles has more), rows under which a group is compared pair by
#: pair with other such groups, and pairs whose cosines are computed at once.
ROWS, FEW, PAIRS = 4096, 24, 20_000


def _near_pairs(grp: np.ndarray, side: np.ndarray, x: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group that may link, PAIRS at most or those of one block."""
    starts = np.concatenate([[0], np.nonzero(grp[1:] != grp[:-1])[0] + 1])
    size = np.diff(np.concatenate([starts, [len(grp)]]))
    few = np.repeat(size < FEW, size)
    for d in range(1, FEW):
        at = np.nonzero(few[:-d] & (grp[:-d] == grp[d:]))[0]
        if not len(at):
            break
        for i in range(0, len(at), PAIRS):
            yield at[i : i + PAIRS], at[i : i + PAIRS] + d
    for start, n in zip(starts[size >= FEW].tolist(), size[size >= FEW].tolist(), strict=True):
        s = side[start : start + n]
        a, b = start + np.nonzero(s <= 1)[0], start + np.nonzero(s >= 1)[0]  # 1: a tile against itself
        for i in range(0, len(a), 256):
            p, q = np.nonzero(x[a[i : i + 256]] @ x[b].T >= threshold - 1e-9)
            p, q = a[i + p], b[q]
            ok = (side[p] != 1) | (p < q)
            p, q = p[ok], q[ok]
            for j in range(0, len(p), PAIRS):
                yield p[j : j + PAIRS], q[j : j + PAIRS]


def _verify(threshold: float, tables: int):
    """Sorted by group: counts of each vector's links in the group, and a spanning forest of them."""

    def links(grp: np.ndarray, side: np.ndarray, ids: np.ndarray, weight: np.ndarray, code: np.ndarray, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        x, n, root, last = unit(x), np.zeros(len(ids), np.int64), np.arange(len(ids)), np.iinfo(np.int64).max
        for p, q in _near_pairs(grp, side, x, threshold):
            ok = (ids[p] != ids[q]) & ((side[p] == 1) | (side[p] != side[q]))
            p, q = p[ok], q[ok]
            ok = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
            p, q = p[ok], q[ok]
            mine, other = (c[i].reshape(len(i), tables, c.shape[1] // tables) for i in (p, q))  # tables have no code in common
            shared = np.zeros(mine.shape, bool)
            for j in range(other.shape[2]):
                shared |= mine == other[:, :, j : j + 1]
            ok = np.where(shared, mine, last).min((1, 2), initial=last) == code[p]  # alike from both ends
            p, q = p[ok], q[ok]
            np.add.at(n, p, weight[q])
            np.add.at(n, q, weight[p])
            while len(p):  # joins the ends of each link
                rp, rq = find(root, p), find(root, q)
                if not (open_ := rp != rq).any():
                    break
                p, q, rp, rq = p[open_], q[open_], rp[open_], rq[open_]
                np.minimum.at(root, np.maximum(rp, rq), np.minimum(rp, rq))
        hit = np.nonzero(n)[0]
        return ids[hit], n[hit], ids[find(root, hit)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            vec = t.column("vec").combine_chunks()
            dims = vec.value_lengths().to_numpy()
            for d in np.unique(dims):  # vectors of a group are of one length
                at = np.nonzero(dims == d)[0]
                part = t if len(at) == t.num_rows else t.take(pa.array(at))
                x, c = (part.column(k).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1) for k in ("vec", "codes"))
                found = links(*(part.column(k).to_numpy() for k in ("grp", "side", "rep", "weight", "code")), x.astype(np.float64), c)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()) for y in found], names=["rep", "n", "other"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) < 2 * ROWS:
                continue
            t = pa.Table.from_batches(held)
            grp = t.column("grp").to_numpy()
            cuts = np.concatenate([np.nonzero(grp[1:] != grp[:-1])[0] + 1])  # the last group may go on
            at = 0
            while len(cuts) and cuts[-1] - at > ROWS:
                end = int(cuts[max(np.searchsorted(cuts, at + ROWS, "right") - 1, np.searchsorted(cuts, at, "right"))])
                yield from done(t.slice(at, end - at))
                at = end
            held = t.slice(at).to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    return run


def find(root: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        y = root[x]
        if (y == x).all():
            return x
        x = y


def link(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept): a row per row of vectors.

    Two vectors link if their labels are equal and not null, they have as many components and their cosine is threshold
    or more.  Vectors that are null, empty, zero or hold a null or non-finite component link with nothing: n_links 0,
    component_id their own id.  Repeated rows are vectors of their own, linked by cosine 1; they share an id, so they
    count as links.  Null id: the row stays and counts as a link, but never names a component.  Empty table: no rows.
    A vector is cast to doubles where it is compared; it travels as it came.  Other columns are not looked at.
    """
    spark = vectors.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("lab"), F.col(vec_col).alias("vec"))
    v = v.withColumn("ok", usable(F.col("vec")) & F.col("lab").isNotNull())
    # 128 bits of label and vector name a group of equal ones
    same = F.struct(F.xxhash64("lab", "vec").alias("a"), F.xxhash64(F.lit("second"), "vec", "lab").alias("b"))
    v = cut(v.withColumn("same", F.when(F.col("ok"), same)))
    # equal vectors of a label: one stands for all, with their number as weight
    groups = v.where("ok").groupBy("same").agg(F.min("id").alias("low"), F.count("*").alias("weight"), F.first("vec").alias("vec"), F.first("lab").alias("lab"))
    column = F.pandas_udf(_codes_column(tables, probes, seed), ArrayType(LongType()))
    kind = F.concat_ws("/", F.col("lab").cast("string"), F.size("vec"))
    groups = cut(groups.select("same", F.xxhash64("same").alias("rep"), "low", "weight", "vec", kind.alias("kind"), column(F.col("vec")).alias("codes")))
    coded = groups.select("rep", "weight", "vec", "kind", "codes")
    # buckets are counted and cut on ids and codes alone; vectors are fetched once for those that meet another
    entries = coded.select("rep", "kind", F.explode("codes").alias("code"))
    sizes = entries.groupBy("kind", "code").agg(F.count("*").alias("size")).where("size > 1").withColumn("tiles", F.ceil(F.col("size") / TILE))
    met = entries.join(sizes, ["kind", "code"]).groupBy("rep").agg(F.collect_list(F.struct("code", "tiles")).alias("met"))
    # every vector of a bucket with t tiles goes to the t pairs of tiles that hold its own
    spread = coded.join(met, "rep").select("rep", "weight", "vec", "kind", "codes", F.explode("met").alias("m")).select("*", "m.code", "m.tiles").drop("m")
    mine = F.pmod(F.col("rep"), F.col("tiles"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("a"), F.greatest(o, F.col("mine")).alias("b"), F.when(o == F.col("mine"), 1).when(F.col("mine") < o, 0).otherwise(2).cast("int").alias("side")))
    spread = spread.withColumn("mine", mine).withColumn("pair", F.explode(pairs))
    spread = spread.select(F.xxhash64("kind", "code", "pair.a", "pair.b").alias("grp"), F.col("pair.side").alias("side"), "rep", "weight", "code", "vec", "codes")
    links = cut(spread.repartition(n, "grp").sortWithinPartitions("grp").mapInArrow(_verify(threshold, tables), "rep long, n long, other long"))
    comp = connected_components(links.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counted = links.groupBy("rep").agg(F.sum("n").alias("n"))
    g = groups.select("same", "rep", "low", "weight").join(counted, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    g = cut(g.select("same", "low", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c")))
    least = g.groupBy("c").agg(F.min("low").alias("component_id"))
    done = v.select("id", "same").join(g.join(least, "c").drop("c", "low"), "same", "left")
    own = F.coalesce(F.col("component_id"), F.col("id"))
    return done.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))


def keep_one(vectors: DataFrame, id_col: str = "vec_id", **how) -> DataFrame:
    """vectors without those that another of their component stands for; rows of a null id always stay."""
    kept = link(vectors, id_col=id_col, **how).where("kept").select(F.col(id_col).alias("kept_id")).distinct()
    held = vectors.select(F.struct(*vectors.columns).alias("row"), F.col(id_col).cast("long").alias("id"))
    return held.where("id IS NULL").select("row.*").unionByName(held.join(kept, held["id"] == kept["kept_id"], "left_semi").select("row.*"))
