"""Document quality by co-training.

One classifier sees what a text says (the shapes and beginnings of its words, shares of kinds of characters), the other
the page's metadata (language, source, stated length) and layout (lines and their lengths, repeated lines), never a word.
Both are logistic classifiers.  In each round a view labels every unlabelled document that it is sure of, and the other
is trained anew on the labelled rows and on these.  Those documents stay where they are, however many: Spark sums their
gradient and curvature by feature, weighted by class so that together they count as a part of the labelled rows, and the
fit moves along that sum.  Both views are calibrated on labelled rows that no round trained on, and the sum of their
calibrated log-odds, less what both owe to the share of good rows, scores every document.

The fit uses at most LABELLED labelled rows, chosen by a hash of their ids; features are found once for each document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut
from .toxicity import _platt

#: Documented bound of the fit: labelled rows.
LABELLED = 12_000
ROUNDS = 3
#: How right a view must be, on labelled rows that it has not seen, about those it is as sure of, to teach a document.
SURE = 0.99
#: What the documents that a view is taught of a class weigh together, in labelled rows of the class.
TAUGHT = 0.25
L2, STEPS = 2.0, 150
#: Gradients are summed as whole multiples of 1 / UNIT, so that sums do not depend on their order.
UNIT = 1 << 20
BUCKETS = 1 << 13
VIEWS = ("a", "b")

_RUN = re.compile(r"[a-zà-ÿ]+|[A-ZÀ-Þ]+|[0-9]+")


def _bucket(name: str) -> int:
    return crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


def shape(word: str) -> str:
    """A word with its runs of small letters, capitals and digits written as a, A and 0."""
    return _RUN.sub(lambda m: "a" if m[0][0].islower() else "0" if m[0][0].isdigit() else "A", word)[:12]


def text_view(text: str | None) -> list[int]:
    t = text or ""
    w = t.split()
    n, chars = max(1, len(w)), max(1, len(t))
    shapes = Counter(map(shape, w))
    out = {f"s:{s}:{min(3, int(4 * k / n))}" for s, k in shapes.items() if k > 1 or n < 20}
    out |= {f"b:{x[:3].lower()}" for x in set(w)}
    caps, marks, digits = sum(map(str.isupper, t)), sum(not (c.isalnum() or c.isspace()) for c in t), sum(map(str.isdigit, t))
    out |= {f"distinct:{int(10 * len(set(w)) / n)}", f"caps:{min(10, int(20 * caps / chars))}", f"marks:{min(12, int(40 * marks / chars))}", f"digits:{min(10, int(20 * digits / chars))}"}
    return sorted({_bucket(x) for x in out})


def page_view(text: str | None, lang: str | None, source: str | None, n_chars: int | float | None) -> list[int]:
    lines = (text or "").split("\n")
    size = 0 if n_chars is None or n_chars != n_chars else n_chars
    long = max(map(len, lines))
    mean = sum(map(len, lines)) / len(lines)
    out = [f"lang:{lang}", f"source:{source}", f"chars:{int(2 * math.log2(max(1, size)))}", f"lines:{int(2 * math.log2(len(lines)))}", f"line:{int(2 * math.log2(max(1, mean)))}"]
    out += [f"longest:{int(2 * math.log2(max(1, long)))}", f"again:{int(8 * (1 - len(set(lines)) / len(lines)))}", f"even:{int(4 * mean / max(1, long))}"]
    return sorted({_bucket(x) for x in out})


def logits(values: np.ndarray, sizes: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of weights (bias last) over rows of sizes[i] features each, one after the other in values.

    Summed in whole numbers, so that equal rows have equal sums wherever they stand.
    """
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.rint(w * (1 << 30)).astype(np.int64)[values])])
    ends = np.cumsum(sizes)
    return (total[ends] - total[ends - sizes]) / (1 << 30) + w[-1]


def train(feats: tuple[np.ndarray, np.ndarray], y: np.ndarray, start: np.ndarray | None = None, pull: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Weights (bias last) of a logistic classifier on values and sizes of rows; pull: gradient and curvature of others at start."""
    values, sizes = feats
    rows, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
    w = np.zeros(BUCKETS + 1) if start is None else start.copy()
    if start is None:
        w[-1] = math.log(np.clip(y.mean(), 1e-3, 1 - 1e-3) / (1 - np.clip(y.mean(), 1e-3, 1 - 1e-3)))
    l2 = np.append(np.full(BUCKETS, L2), 0.0)
    scale = np.append(np.bincount(values, minlength=BUCKETS) * 0.25, n * 0.25) + l2
    g0, h0 = pull or (np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1))
    at, speed = w.copy(), np.zeros(BUCKETS + 1)
    for _ in range(STEPS):  # gradient steps scaled by a bound of the curvature, with momentum
        g = 1 / (1 + np.exp(-np.clip(logits(values, sizes, w), -30, 30))) - y
        d = np.append(np.bincount(values, g[rows], BUCKETS), g.sum()) + l2 * w + g0 + 10 * h0 * (w - at)  # 10: features of a row go together
        speed = 0.8 * speed - 0.1 * d / (scale + 10 * h0)
        w = w + speed
    return w


@dataclass
class Model:
    """By view weights and calibration curve; prior: log-odds of a good row; by view the log-odds from which it teaches."""

    views: list[np.ndarray]
    curves: list[tuple[float, float]]
    prior: float = 0.0
    edges: list[tuple[float, float]] | None = None

    def sure(self, feats: list[tuple[np.ndarray, np.ndarray]], view: int) -> np.ndarray:
        """Calibrated log-odds; feats: values and sizes by view."""
        a, b = self.curves[view]
        return np.clip(a * logits(*feats[view], self.views[view]) + b, -30, 30)


def _lists(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(batch.column(v).flatten().to_numpy(zero_copy_only=False).astype(np.int64), batch.column(v).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) for v in VIEWS]


def _of(feats: list[tuple[np.ndarray, np.ndarray]], keep: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(v[np.repeat(keep, n)], n[keep]) for v, n in feats]


def edge(x: np.ndarray, right: np.ndarray, least: float = SURE) -> float:
    """The least x (0 at least) from which the share of rows that are right, less a doubt for few, is least or more."""
    order = np.argsort(-x, kind="stable")
    good = (np.cumsum(right[order]) + 1) / (np.arange(len(x)) + 2) >= least
    at = np.nonzero(good & (x[order] > 0))[0]
    return float(x[order][at[-1]]) if len(at) else math.inf


def taught(table: DataFrame, model: Model) -> list[list[tuple[np.ndarray, np.ndarray, float]]]:
    """By view and class: gradient and curvature at the view's weights, and number, of the rows the other view is sure of."""
    wide = BUCKETS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2, 2, wide))
        for batch in batches:
            feats = _lists(batch)
            for v in (0, 1):
                x = model.sure(feats, 1 - v)
                for label in (0, 1):
                    values, sizes = _of(feats, x >= model.edges[1 - v][1] if label else -x >= model.edges[1 - v][0])[v]
                    p = 1 / (1 + np.exp(-np.clip(logits(values, sizes, model.views[v]), -30, 30)))
                    for k, y in enumerate((p - label, np.full(len(p), 0.25))):
                        sums[v, label, k] += np.append(np.bincount(values, np.repeat(y, sizes), BUCKETS), y.sum())
        flat = np.rint(sums.ravel() * UNIT).astype(np.int64)
        at = np.nonzero(flat)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at])], names=["at", "n"])

    got = table.where("quality < 0").select(*VIEWS).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # bounded by the buckets
    flat = np.zeros(8 * wide)
    flat[got["at"]] = got["n"] / UNIT
    return [[(g, h, h[-1] / 0.25) for g, h in of] for of in flat.reshape(2, 2, 2, wide)]


def co_train(feats: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, teach, rounds: int = ROUNDS) -> Model:
    """feats: values and sizes of the labelled rows by view; y: their labels; teach(model): taught() of the others."""
    n = len(y)
    if not n or y.min() == y.max():  # nothing to tell apart
        p = float(y[0]) * 0.98 + 0.01 if n else 0.5
        flat = np.append(np.zeros(BUCKETS), math.log(p / (1 - p)))
        return Model([flat, flat], [(1.0, 0.0)] * 2, float(flat[-1]))
    held = np.arange(n) % 4 == 3 if n >= 40 else np.zeros(n, bool)
    check = held if held.any() else ~held
    own, base = _of(feats, ~held), y[~held]
    share = float(np.clip(y.mean(), 0.01, 0.99))
    views = [train(x, base) for x in own]
    for k in range(rounds + 1):
        seen = _of(feats, check)
        model = Model(views, [_platt(logits(*x, w), y[check]) for x, w in zip(seen, views, strict=True)], math.log(share / (1 - share)))
        model.edges = [(edge(-x, y[check] == 0), edge(x, y[check] == 1)) for x in (model.sure(seen, v) for v in (0, 1))]
        if k == rounds:
            return model
        pulls = []
        for of in teach(model):  # each class by its labelled rows, whatever was taught
            even = [TAUGHT * (base == label).sum() / rows if rows else 0.0 for label, (_, _, rows) in enumerate(of)]
            pulls.append(tuple(sum(e * of[label][i] for label, e in enumerate(even)) for i in (0, 1)))
        views = [train(x, base, w, pull) for x, w, pull in zip(own, views, pulls, strict=True)]


def _features(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"a": [text_view(t) for t in text], "b": [page_view(*x) for x in zip(text, lang, source, n_chars, strict=True)]})


def feature_columns(text: Column, lang: Column, source: Column, n_chars: Column) -> Column:
    return F.pandas_udf(_features, "a array<short>, b array<short>")(text, lang, source, n_chars)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """A Model, and a table of every document's features: doc_id, quality (-1 where no label was used), a, b."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sample = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    d = docs.select("doc_id", feature_columns(F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars").cast("long")).alias("f"))
    table = cut(d.join(F.broadcast(sample), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), "f.a", "f.b"))  # bounded: two numbers a row
    got = table.where("quality >= 0").toPandas()
    got = got.assign(order=[crc32(str(i).encode()) for i in got["doc_id"]]).sort_values(["order", "doc_id", "quality"], kind="stable")
    feats = [(np.concatenate([np.zeros(0, np.int64), *got[v]]).astype(np.int64), np.array([len(x) for x in got[v]], np.int64)) for v in VIEWS]
    model = co_train(feats, got["quality"].to_numpy(np.float64), lambda m: taught(table, m), rounds)
    drop_cut(sample)
    return model, table


def score(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_score, page_score, score, keep): a row per row of docs; keep where score is 0.5 or more.

    Null text counts as empty, null metadata as a value of its own.  Null ids are scored and taught, their labels never
    used.  Repeated rows get equal scores and teach as often as they stand; where a document has several labels, 0 wins.
    Very long texts are read whole.  Without labels of both kinds every score is the share of good labels (0.5 without
    any).  Empty docs: no rows.  Other columns are not looked at.
    """
    model, table = fit(docs, labels, labelled, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feats = _lists(batch)
            a, b = model.sure(feats, 0), model.sure(feats, 1)
            p = [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (a, b, a + b - model.prior)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, p), pa.array(p[2] >= 0.5)], names=["doc_id", "text_score", "page_score", "score", "keep"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.select("doc_id", *VIEWS).mapInArrow(run, f"doc_id {kind}, text_score double, page_score double, score double, keep boolean")
