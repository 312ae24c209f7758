"""What the operators of this subpackage share: table access, lineage cuts, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, drop_cut, drop_cuts_of, shared_folder  # noqa: F401

#: Characters of texts that are worked on at once where work keeps several arrays a character.
TEXT_BLOCK = 1_000_000
#: A node with more than this share of the edges, and more than HUB_LEAST of them, is a hub.
HUB_SHARE, HUB_LEAST = 1 / 20_000, 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_blocks(texts: Iterable[str | None], most: int = TEXT_BLOCK) -> Iterator[slice]:
    """Slices of texts that hold most characters or a single text."""
    start = end = held = 0
    for t in texts:
        n = len(t or "")
        if end > start and held + n > most:
            yield slice(start, end)
            start, held = end, 0
        end, held = end + 1, held + n
    if end > start:
        yield slice(start, end)


def _with_low(edges: DataFrame, low: DataFrame, hubs_over: int) -> DataFrame:
    """edges (a, b) and each one's m from low (a, m, n: a's edges), without dealing a hub's edges to one task.

    A node with more than hubs_over edges is a hub.  The caller's bound keeps hubs few, so they are broadcast; all other
    edges are joined by a.
    """
    hubs = F.broadcast(low.where(F.col("n") > hubs_over).select("a", "m"))
    rest = low.where(F.col("n") <= hubs_over).select("a", "m")
    return edges.join(hubs, "a").unionByName(edges.join(hubs.select("a"), "a", "left_anti").join(rest, "a"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, component): the smallest node reachable, for every node on an edge.

    Alternates large-star and small-star steps (MapReduce connected components): each step replaces the edges by at
    most as many and needs one grouped minimum, which Spark combines before the shuffle.  The minimum is brought back to
    the edges by a join on their node; nodes that hold more than a fixed share of the edges are split off it and served
    by a broadcast, which holds 2 / HUB_SHARE nodes at most.  Every step is written to the shared folder.  Null nodes
    and loops are ignored.
    """
    e = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state, n_edges = None, e.count()
    while n_edges:
        over = max(HUB_LEAST, int(n_edges * HUB_SHARE))
        # large star: a node's larger neighbours are tied to the smallest of the node and its neighbours
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = cut(_with_low(both, low, over).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: a node and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_low(large, low, over).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        n = cut(small)
        s = n.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        drop_cut(e)
        drop_cut(large)
        e, was, state, n_edges = n, state, (s["n"], s["h"]), s["n"]
        if state == was:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
