"""Toxicity by weak supervision.

Voters look for words of a fixed lexicon, for patterns of writing, and for words and word beginnings that labelled
training rows show to be precise.  A generative label model over the votes of all documents, labelled or not, is fitted by
expectation maximisation: how often each voter fires on toxic and on clean texts, and which voters stay correlated given
the class and so share one vote between them.  Labels only give it prior counts, worth PRIOR rows; they are no voter.  Its
posterior labels of the sampled rows train a linear classifier on the features found, whose scores are then calibrated on
the training labels.

There are 16 voters, so what all documents vote is a table of 65,536 patterns at most.  The classifier is fitted on at most
LABELLED rows, chosen by a hash of their ids; votes, label model and scores cover all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import cut, drop_cut

#: Labelled rows that the fit may use, at most (a documented bound; where there are more, a hash of the id chooses).
LABELLED = 20_000
#: Mined features, at most, and the likelihood ratio (twice its logarithm) that one needs.
FEATURES, RATIO = 3000, 20.0
#: Rows that the firing rates on labelled rows are worth beside the votes of all documents.
PRIOR = 500.0
#: Share of toxic rows among those that hold a mined feature, at least.
PRECISE = 0.75
#: The same for a feature that votes, and the ratio that it needs; a long text holds many of the others by chance.
VOTES, VOTES_RATIO = 0.85, 20.0
THRESHOLD = 0.3

# fixed values: lexicon voters, by the kind of abuse
LEXICON = {
    "insult": ["idiot", "moron", "imbecile", "fool", "dumb", "dumbass", "stupid", "cretin", "dimwit", "clown", "loser", "jerk", "bastard", "asshole", "bitch", "retard"],
    "contempt": ["pathetic", "worthless", "useless", "disgusting", "scum", "trash", "filth", "vermin", "garbage", "vile", "parasite", "subhuman", "degenerate", "repulsive"],
    "profanity": ["fuck", "fucking", "shit", "bullshit", "crap", "damn", "cunt", "slut", "whore", "piss", "dick"],
    "threat": ["kill", "murder", "die", "hang", "rape", "burn", "exterminate", "destroy"],
}
PATTERNS = {
    "addressed": re.compile(r"\b(?:you|your|you're|youre|ur)\b[^.!?\n]{0,40}\b(?:idiot|moron|fool|stupid|dumb|loser|pathetic|worthless|disgusting|trash|scum|clown)", re.I),
    "shut_up": re.compile(r"\b(?:shut up|go away|get lost|go to hell|hate you|nobody likes)\b", re.I),
    "shouting": re.compile(r"(?:\b[A-Z]{3,}\b[\s!]+){4,}"),
    "marks": re.compile(r"[!?]{3,}|[@#$%&*]{4,}"),
}
_WORD = re.compile(r"\w+")
_YOU = {"you", "your", "youre", "ur", "shut", "away", "lost", "hell", "hate", "nobody"}
_FIXED = {w: k for k, ws in LEXICON.items() for w in ws}


def grams(text: str | None) -> set[str]:
    """Features of a text: its words (=word) and the beginnings of four to six letters of longer ones (^begin)."""
    words = set(_WORD.findall((text or "").lower()))
    out = {"=" + w for w in words}
    for n in (4, 5, 6):
        out.update(["^" + w[:n] for w in words if len(w) > n])
    return out


#: Voters: bits 0 to 3 the kinds of the lexicon, 4 to 7 the patterns, 8 to 15 the mined features in groups.
FIXED = (*(f"lexicon:{k}" for k in LEXICON), *(f"pattern:{k}" for k in PATTERNS))
VOTERS = 16
_BIT = {f: 1 << i for i, f in enumerate(FIXED)}


def _group(gram: str) -> int:
    """The voter of a mined feature: words and beginnings apart, each dealt over four by hash."""
    return 1 << 8 + 4 * (gram[0] == "^") + crc32(gram.encode("utf-8", "surrogatepass")) % 4


class Finder:
    """A text's features among those of vocab, and the voters that fire as bits; the first voting features vote."""

    def __init__(self, vocab: list[str], voting: int):
        self.whole = {g[1:]: i for i, g in enumerate(vocab) if g[0] == "="}
        self.begins = {n: {g[1:]: i for i, g in enumerate(vocab) if g[0] == "^" and len(g) == n + 1} for n in (4, 5, 6)}
        self.group = [_group(g) if i < voting else 0 for i, g in enumerate(vocab)]

    def __call__(self, text: str | None) -> tuple[list[int], int]:
        text = text or ""
        words = set(_WORD.findall(text.lower()))
        hits = [self.whole[w] for w in self.whole.keys() & words]
        for n, known in self.begins.items():
            if known:
                hits += [known[b] for b in known.keys() & {w[:n] for w in words if len(w) > n}]
        voted = 0
        for i in hits:
            voted |= self.group[i]
        for w in _FIXED.keys() & words:
            voted |= _BIT["lexicon:" + _FIXED[w]]
        for k in ("addressed", "shut_up") if words & _YOU else ():
            voted |= _BIT["pattern:" + k] * bool(PATTERNS[k].search(text))
        for k in ("shouting", "marks"):
            voted |= _BIT["pattern:" + k] * bool(PATTERNS[k].search(text))
        return sorted(hits), voted


def votes_of(masks: np.ndarray) -> np.ndarray:
    return (np.asarray(masks, np.int64)[:, None] >> np.arange(VOTERS) & 1).astype(np.float64)


def rates(votes: np.ndarray, q: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Sums of votes on clean and on toxic rows by their posterior q, and how many rows of either there are."""
    return votes.T @ (count * (1 - q)), votes.T @ (count * q), float(count @ (1 - q)), float(count @ q)


def label_model(votes: np.ndarray, start: np.ndarray, count: np.ndarray | None = None, prior_rates: tuple | None = None, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Firing rates on clean and toxic texts, share of toxic ones, weights of voters.

    votes (patterns, voters) of 0 and 1 with how many rows have each; start: the first guess of the posterior.
    prior_rates: what rates() gives for rows whose labels are known, added as counts worth PRIOR rows.
    """
    n, m = votes.shape
    count = np.ones(n) if count is None else count
    known = (np.zeros(m), np.zeros(m), 0.0, 0.0) if prior_rates is None else tuple(x * PRIOR / max(1.0, prior_rates[2] + prior_rates[3]) for x in prior_rates)
    weight = np.ones(m)
    for _ in range(2):  # once as if independent, once with what is left of correlations
        q = start
        for _ in range(rounds):
            clean, toxic, n_clean, n_toxic = (a + b for a, b in zip(rates(votes, q, count), known, strict=True))
            prior = float(np.clip(n_toxic / max(n_clean + n_toxic, 1e-9), 1e-4, 0.5))
            on, off = (toxic + 0.2) / (n_toxic + 1.0), (clean + 0.02) / (n_clean + 1.0)
            on, off = np.clip(np.maximum(on, off), 1e-6, 1 - 1e-6), np.clip(off, 1e-6, 1 - 1e-6)  # voters speak for toxicity, never against it
            q = posterior(votes, off, on, prior, weight)
        left = np.zeros((m, m))
        for y in (q * count, (1 - q) * count):
            mean = votes.T @ y / max(y.sum(), 1e-9)
            d = (votes - mean) * np.sqrt(y)[:, None]
            left += d.T @ d
        sd = np.sqrt(np.maximum(np.diag(left), 1e-9))
        weight = 1 / np.maximum(1.0, np.clip(left / sd[:, None] / sd[None], 0, 1).sum(1))
    return off, on, prior, weight


def posterior(votes: np.ndarray, off: np.ndarray, on: np.ndarray, prior: float, weight: np.ndarray) -> np.ndarray:
    gain = votes @ (weight * np.log(on / off)) + (1 - votes) @ (weight * np.log((1 - on) / (1 - off)))
    return 1 / (1 + np.exp(-np.clip(gain + math.log(prior / (1 - prior)), -30, 30)))


def logistic(rows: np.ndarray, cols: np.ndarray, n: int, m: int, y: np.ndarray, l2: float = 1.0, steps: int = 300) -> np.ndarray:
    """Weights (m, and a bias) of a linear classifier on 0/1 features given as (row, column) pairs; y may be soft."""
    w = np.zeros(m + 1)
    if not n:
        return w
    p0 = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w[m] = math.log(p0 / (1 - p0))
    speed, scale = np.zeros(m + 1), np.concatenate([np.bincount(cols, minlength=m)[:m] * 0.25 + l2, [n * 0.25]])
    for _ in range(steps):  # gradient steps scaled by a bound of the curvature, with momentum
        g = 1 / (1 + np.exp(-np.clip(w[m] + np.bincount(rows, w[cols], n), -30, 30))) - y
        d = np.concatenate([np.bincount(cols, g[rows], m)[:m] + l2 * w[:m], [g.sum()]]) / scale
        speed = 0.8 * speed - 0.1 * d
        w = w + speed
    return w


@dataclass
class Model:
    """What scores need: mined features with their weights, weights of the fixed voters by bit, bias and calibration."""

    vocab: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    fixed: np.ndarray = field(default_factory=lambda: np.array([4.0 * (f in ("lexicon:insult", "lexicon:contempt")) for f in FIXED]))
    bias: float = -3.0
    scale: float = 1.0
    shift: float = 0.0

    def score(self, hits: list[int], voted: int) -> float:
        x = self.bias + float(self.weights[hits].sum()) + sum(float(w) for i, w in enumerate(self.fixed) if voted >> i & 1)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.scale * x + self.shift))))


def trainable(id_col: Column) -> Column:
    """Whether labels may be learnt from a row: crc32 of its id as text leaves other than 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def _mine(train: DataFrame) -> tuple[list[str], int]:
    """Features that tell toxic training rows, those that vote first, and how many do; copies of a text count once."""
    train = train.dropDuplicates(["text", "toxic"])

    def counts(keep: set[str] | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c: Counter = Counter()
            for pdf in batches:
                for t in pdf["text"]:
                    g = grams(t)
                    c.update(g if keep is None else g & keep)
            yield pd.DataFrame(c.items(), columns=["g", "n"])

        return run

    n = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return [], 0
    least = max(3, math.ceil(RATIO / 2 / math.log((pos + neg) / pos)))  # with fewer rows no ratio is enough
    hot = train.where("toxic = 1").select("text").mapInPandas(counts(None), "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    on = {r["g"]: r["n"] for r in hot.collect()}
    cold = train.where("toxic = 0").select("text").mapInPandas(counts(set(on)), "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    off = {r["g"]: r["n"] for r in cold.collect()}
    return select(on, off, pos, neg)


def select(on: dict[str, int], off: dict[str, int], pos: int, neg: int) -> tuple[list[str], int]:
    """Features in on toxic and off clean rows (of pos and neg) that are significant and precise, voting ones first, best first."""

    def part(k: float, e: float) -> float:
        return k * math.log(k / e) if k else 0.0

    found = []
    for g, a in on.items():
        b = off.get(g, 0)
        both = a + b
        if a / (both + 1) >= PRECISE:
            r = 2 * (part(a, both * pos / (pos + neg)) + part(b, both * neg / (pos + neg)))
            if r >= RATIO:
                found.append((not (a / (both + 1) >= VOTES and r >= VOTES_RATIO), -r, g))
    found = sorted(found)[:FEATURES]
    return [g for _, _, g in found], sum(not weak for weak, _, _ in found)


def _sample(labels: DataFrame, bound: int) -> DataFrame:
    """(doc_id, toxic) of at most bound documents whose labels may be learnt from, chosen by a hash; 1 wins over 0."""
    l = labels.where(F.col("toxic").isin(0, 1) & trainable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))  # noqa: E741
    return cut(l.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED, keep: list[str] | None = None) -> tuple[Model, DataFrame]:
    """A Model, and docs as the columns in keep (all, as a struct row, if None) with found: what its scores are made of."""
    sample = _sample(labels, bound)
    train = cut(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))  # bounded: two numbers a row
    vocab, voting = _mine(train)
    drop_cut(train)

    def found(text: pd.Series) -> pd.DataFrame:
        find = Finder(vocab, voting)
        got = [find(t) for t in text]
        return pd.DataFrame({"hits": [a for a, _ in got], "voted": [b for _, b in got]})

    found.__annotations__ = {"text": pd.Series, "return": pd.DataFrame}
    rows = [F.struct(*docs.columns).alias("row"), "doc_id"] if keep is None else keep
    seen = cut(docs.select(*rows, F.pandas_udf(found, "hits array<int>, voted int")("text").alias("found")))
    known = seen.select("doc_id", "found").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "found.hits", "found.voted").toPandas()
    known = known.sort_values(["doc_id", "toxic"], kind="stable")
    n, m = len(known), len(vocab)
    if not n or not known["toxic"].any() or known["toxic"].all():
        return Model(vocab, np.zeros(m)), seen
    y, mine = known["toxic"].to_numpy(np.float64), votes_of(known["voted"])
    patterns = seen.groupBy("found.voted").agg(F.count("*").alias("n")).toPandas().sort_values("voted")
    votes, count = votes_of(patterns["voted"]), patterns["n"].to_numpy(np.float64)
    told = rates(mine, y, np.ones(n))
    off, on = (np.clip((x + 0.2) / (k + 1.0), 1e-4, 1 - 1e-4) for x, k in ((told[0], told[2]), (told[1], told[3])))
    start = posterior(votes, off, np.maximum(on, off), float(np.clip(y.mean(), 1e-4, 0.5)), np.ones(VOTERS))
    q = posterior(mine, *label_model(votes, start, count, told))
    fixed = len(FIXED)
    ri, ci = np.nonzero(mine[:, :fixed])
    ri = np.concatenate([np.repeat(np.arange(n), [len(h) for h in known["hits"]]), ri])
    ci = np.concatenate([*(np.asarray(h, np.int64) for h in known["hits"]), m + ci])
    w = logistic(ri, ci, n, m + fixed, q)
    a, b = _platt(w[-1] + np.bincount(ri, w[ci], n), y)
    return Model(vocab, w[:m], w[m:-1], float(w[-1]), a, b), seen


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale (positive) and shift of a logistic curve through (x, y), by damped Newton steps."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        s = p * (1 - p) + 1e-9
        h = np.array([[s @ (x * x) + 1e-3, s @ x], [s @ x, s.sum() + 1e-3]])
        d = np.linalg.solve(h, np.array([(p - t) @ x, (p - t).sum()]))
        a, b = a - float(np.clip(d[0], -1, 1)), b - float(np.clip(d[1], -1, 1))
    return max(a, 0.05), b


def score_column(found: Column, model: Model) -> Column:
    def run(hits: pd.Series, voted: pd.Series) -> pd.Series:
        return pd.Series([model.score(list(h), int(v)) for h, v in zip(hits, voted, strict=True)], dtype="float64")

    run.__annotations__ = {"hits": pd.Series, "voted": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, DoubleType())(found["hits"], found["voted"])


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted): a row per row of docs.

    Null or empty text: the score of a text without features.  Null id: held_out false, its label never used.  Repeated
    rows get equal scores and each votes in the label model.  Labels that are null or not 0 or 1 are left out; where a
    document has several, 1 wins; without labels of both kinds the fixed lexicon alone scores.  Of features that tie
    the first by name are mined.  Very long texts are searched whole.  Empty docs: no rows.  Other columns are not looked at.
    """
    model, seen = fit(docs, labels, bound, ["doc_id"])
    s = seen.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"), score_column(F.col("found"), model).alias("score"))
    return s.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = LABELLED) -> DataFrame:
    """docs without the rows that score threshold or more."""
    model, seen = fit(docs, labels, bound)
    return seen.select("row", score_column(F.col("found"), model).alias("score")).where(F.col("score") < threshold).select("row.*")
