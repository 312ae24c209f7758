"""Rule-based sentiment: a valence lexicon with rules for emphasis, negation, contrast and punctuation.

The rules are those of the published model of Hutto and Gilbert (2014).  They look a few words back, so a text is read
as a sequence, in Arrow batches; the lexicon (word -> valence, about -4 to 4) is the caller's.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the constants of the published model
BOOST, CAPS, NEGATED, ALPHA = 0.293, 0.733, -0.74, 15.0
EXCLAIM, QUESTION, QUESTIONS = 0.292, 0.18, 0.96
# fixed values: words that strengthen or weaken what follows, and words that negate it
STRONGER = "absolutely amazingly awfully completely considerably decidedly deeply enormously entirely especially exceptionally extremely fabulously fully greatly hella highly hugely incredibly intensely majorly more most particularly purely quite really remarkably so substantially thoroughly totally tremendously uber unbelievably unusually utterly very".split()
WEAKER = "almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat sorta".split()
NEGATIONS = "aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neither neednt never none nope nor not nothing nowhere oughtnt rarely seldom shant shouldnt uhuh wasnt werent without wont wouldnt despite".split()
_BOOSTERS = dict.fromkeys(STRONGER, BOOST) | dict.fromkeys(WEAKER, -BOOST)
_NEGATIONS = set(NEGATIONS) | {w[:-2] + "n't" for w in NEGATIONS if w.endswith("nt")}
#: How much an emphasis or a negation counts one, two and three words before.
_FADE = (1.0, 0.95, 0.9)
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def _words(text: str) -> list[str]:
    out = []
    for w in text.split():
        bare = _EDGE.sub("", w)
        out.append(w if len(bare) <= 2 else bare)  # short tokens may be emoticons
    return out


def _valence(words: list[str], i: int, lexicon: Mapping[str, float], mixed: bool) -> float:
    low = words[i].lower()
    if low not in lexicon or low in _BOOSTERS:
        return 0.0
    v = float(lexicon[low])
    if mixed and words[i].isupper():
        v += math.copysign(CAPS, v)
    for k in range(3):
        if i <= k or words[i - k - 1].lower() in lexicon:
            continue
        before = words[i - k - 1]
        boost = _BOOSTERS.get(before.lower(), 0.0)
        if boost:
            boost = boost if v > 0 else -boost
            if mixed and before.isupper():
                boost += CAPS if v > 0 else -CAPS
            v += boost * _FADE[k]
        near = [w.lower() for w in words[max(0, i - k - 1) : i]]
        if near[0] == "never" and k and any(w in ("so", "this") for w in near[1:3]):
            v *= 1.25 if k == 2 else 1.5
        elif near[0] in _NEGATIONS:
            v *= NEGATED
    if i and words[i - 1].lower() == "least" and words[i - 1].lower() not in lexicon and not (i > 1 and words[i - 2].lower() in ("at", "very")):
        v *= NEGATED
    return v


def polarity(text: str | None, lexicon: Mapping[str, float]) -> tuple[float, float, float, float]:
    """compound (-1 to 1) and the shares positive, neutral and negative of a text; zeros for one without words."""
    text = text or ""
    words = _words(text)
    if not words:
        return 0.0, 0.0, 0.0, 0.0
    capital = sum(w.isupper() for w in words)
    mixed = 0 < capital < len(words)
    vs = [0.0 if w.lower() == "kind" and words[i + 1 : i + 2] and words[i + 1].lower() == "of" else _valence(words, i, lexicon, mixed) for i, w in enumerate(words)]
    low = [w.lower() for w in words]
    if "but" in low:
        at = low.index("but")
        vs = [v * (0.5 if i < at else 1.5 if i > at else 1.0) for i, v in enumerate(vs)]
    questions = text.count("?")
    marks = min(text.count("!"), 4) * EXCLAIM + (0.0 if questions < 2 else questions * QUESTION if questions <= 3 else QUESTIONS)
    total = sum(vs)
    emphasised = total + math.copysign(marks, total) if total else total
    compound = emphasised / math.sqrt(emphasised * emphasised + ALPHA)
    pos, neg, neu = sum(v + 1 for v in vs if v > 0), sum(v - 1 for v in vs if v < 0), sum(v == 0 for v in vs)
    if pos > abs(neg):
        pos += marks
    elif pos < abs(neg):
        neg -= marks
    whole = pos + abs(neg) + neu
    return round(max(-1.0, min(1.0, compound)), 4), round(pos / whole, 3), round(neu / whole, 3), round(abs(neg) / whole, 3)


def sentiment(text: Column, lexicon: Mapping[str, float]) -> Column:
    """struct(compound, positive, neutral, negative)."""
    names = ["compound", "positive", "neutral", "negative"]

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([polarity(t, lexicon) for t in s], columns=names)

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, ", ".join(f"{n} double" for n in names))(text)
