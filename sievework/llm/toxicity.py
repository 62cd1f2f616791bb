"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posterior labels.

Voters look at a text and fire or don't: a stated word list, lexicons of words and of word beginnings that labelled
rows tie closely or less closely to toxicity (each with a voter for a first hit and one for several), and patterns of
shouting, masking and shortness. The label model is a latent class with a tree of dependences between voters: every
voter has its firing rate per class, given the voter it depends on; rates, dependences and the posterior of every vote
pattern are estimated by expectation maximisation over the pattern counts of all documents, which weigh as much as the
labelled sample, whose patterns are anchors. A logistic regression on word features is then trained on the posterior
labels of the sample: a row's own label bears on the anchors only, never on what the classifier is told of the row.

The classifier and the lexicons are fitted on a bounded sample of labelled rows (``most_labelled``, those with the
smallest hashes); pattern counts cover all documents. Only 2 to the number of voters patterns can reach the driver.
Null and empty texts have no features and get the base score. Repeated label rows of a document count once, the
highest, and labels above 0 count as 1; null labels don't count. Of different texts with one id the sample takes the
first in order. Without toxic rows in the sample the stated list alone carries the model.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.samples import sampled

#: Plain English words of insult.
INSULTS = [
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "loser", "losers", "scum", "trash", "garbage",
    "pathetic", "disgusting", "worthless", "clown", "clowns", "fool", "fools", "filth", "vermin", "retard", "creep",
    "bastard", "jerk", "pig", "ugly", "hateful", "crap", "damn", "hell", "sucks",
]
STRIP = ".,;:!?\"'()[]{}*#$%&|<>-_«»¡¿…"
PREFIXES = (4, 5, 7)
#: Lexicons: the stated list, words and beginnings tied closely or less closely to toxicity. Hits from which the second voter of each fires:
SEVERAL = {"stated": 2, "close words": 2, "words": 2, "close beginnings": 3, "beginnings": 3}
CLOSE = 0.85
MASKED = re.compile(r"[A-Za-z][*#$%&@]{1,}[A-Za-z]")
SHOUT = re.compile(r"!{2,}")
LEAST_Z, LEAST_SHARE, LEAST_ROWS = 4.5, 0.5, 3
N_LEXICAL = 2 * len(SEVERAL)
N_VOTERS = N_LEXICAL + 4


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case words without signs at their ends."""
    out = {w.strip(STRIP) for w in set((text or "").lower().split())}
    out.discard("")
    return out


def features(words: set[str]) -> set[str]:
    """Words, and the beginnings of longer words."""
    return words.union(*({w[:n] + "~" for w in words if len(w) > n} for n in PREFIXES))


@dataclass
class Lexicons:
    """Feature to the numbers of its lexicons."""

    lexicons_of: dict[str, tuple[int, ...]]

    def votes(self, text: str | None) -> int:
        """Bits of the voters that fire."""
        text = text or ""
        words = tokens(text)
        hits = [0] * len(SEVERAL)
        for f in features(words).intersection(self.lexicons_of):
            for k in self.lexicons_of[f]:
                hits[k] += 1
        bits = 0
        for k, several in enumerate(SEVERAL.values()):
            bits |= (hits[k] > 0) << 2 * k | (hits[k] >= several) << 2 * k + 1
        at = N_LEXICAL
        spaced = text.split() if words else []
        upper = sum(map(str.isupper, spaced))
        bits |= (upper > 20 and 10 * upper > len(spaced)) << at  # of all words of the text
        bits |= bool(SHOUT.search(text)) << (at + 1)
        bits |= bool(MASKED.search(text)) << (at + 2)
        bits |= (len(words) < 6) << (at + 3)
        return bits


def lexicons(associated: Mapping[str, bool], insults: list[str] = INSULTS) -> Lexicons:
    """Lexicons of the stated list and of the words and beginnings found in the sample, and whether each is tied closely."""
    names = list(SEVERAL)
    lexicons_of = {w: (0,) for w in insults}
    for f, close in associated.items():
        found = names.index(("close " if close else "") + ("beginnings" if f.endswith("~") else "words"))
        lexicons_of[f] = (*lexicons_of.get(f, ()), found)
    return Lexicons(lexicons_of)


@dataclass
class LabelModel:
    """Latent class with a tree of dependences: ``rates[y, j, value of the parent]``."""

    prior: float
    parents: list[int] = field(default_factory=list)
    rates: np.ndarray | None = None
    dependence: np.ndarray | None = None

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of class 1 for vote patterns."""
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(patterns), 1))
        for j, parent in enumerate(self.parents):
            value = patterns >> j & 1
            given = patterns >> parent & 1 if parent >= 0 else np.zeros(len(patterns), int)
            for y in (0, 1):
                rate = self.rates[y, j][given]
                log[:, y] += np.log(np.where(value == 1, rate, 1 - rate))
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(axis=1)


def _dependences(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mutual information of each pair of voters within the classes; weights are (patterns, classes)."""
    n = values.shape[1]
    out = np.zeros((n, n))
    total = weights.sum() + 1e-9
    for y in (0, 1):
        w = weights[:, y]
        s = w.sum() + 1.0
        ones = (values * w[:, None]).sum(axis=0) + 0.5
        both = values.T @ (values * w[:, None]) + 0.25
        for a, pa_ in ((1, ones / s), (0, 1 - ones / s)):
            for b, pb in ((1, ones / s), (0, 1 - ones / s)):
                joint = {(1, 1): both, (1, 0): ones[:, None] - both, (0, 1): ones[None, :] - both, (0, 0): s - ones[:, None] - ones[None, :] + both}[a, b] / s
                joint = np.maximum(joint, 1e-12)
                out += s / total * joint * np.log(joint / np.maximum(np.outer(pa_, pb), 1e-12))
    np.fill_diagonal(out, 0)
    return out


def _tree(dependence: np.ndarray, least: float) -> list[int]:
    """Parent of each voter in a maximum spanning forest of dependences above ``least``; parents come first in it."""
    n = len(dependence)
    parents, inside = [-1] * n, []
    while len(inside) < n:
        open_ = [j for j in range(n) if j not in inside]
        best = max(((dependence[i, j], i, j) for i in inside for j in open_), default=(0, -1, open_[0]))
        value, i, j = best
        if value < least:
            i, j = -1, open_[0]
        parents[j] = i
        inside.append(j)
    return parents


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, anchors: np.ndarray, prior: float, rounds: int = 40, least: float = 1e-3) -> LabelModel:
    """Expectation maximisation over pattern counts; ``anchors`` are counts of labelled rows per pattern and class."""
    values = (patterns[:, None] >> np.arange(N_VOTERS) & 1).astype(float)
    lexical = values[:, :N_LEXICAL].sum(axis=1)
    toxic = np.where(lexical > 0, 0.9, prior / 10)
    model = LabelModel(prior)
    for _ in range(rounds):
        weights = np.stack([counts * (1 - toxic), counts * toxic], axis=1) + anchors
        model.dependence = _dependences(values, weights)
        model.parents = _tree(model.dependence, least)
        rates = np.full((2, N_VOTERS, 2), 0.5)
        for j, parent in enumerate(model.parents):
            given = values[:, parent] if parent >= 0 else np.zeros(len(patterns))
            for y in (0, 1):
                for g in (0, 1):
                    w = weights[given == g, y]
                    rates[y, j, g] = ((w * values[given == g, j]).sum() + 0.5 * (0.1 if y else 0.01)) / (w.sum() + 0.5)
        model.rates = np.clip(rates, 1e-6, 1 - 1e-6)
        toxic = model.posterior(patterns)
    return model


@dataclass
class Classifier:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        weights = self.weights
        z = self.bias + sum([weights[f] for f in features(tokens(text)) if f in weights])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_classifier(rows: list[list[int]], soft: np.ndarray, names: list[str], rounds: int = 300, variance: float = 8.0) -> Classifier:
    """Logistic regression of soft labels on sparse 0/1 features, weights normal with this variance beforehand.

    A feature of few rows can't gain much weight."""
    if not len(soft):
        return Classifier({}, -4.0)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.array([f for r in rows for f in r], int)
    w, bias = np.zeros(len(names)), float(np.log((soft.mean() + 1e-3) / (1 - soft.mean() + 1e-3)))
    step_w, step_b = np.zeros(len(names)), 0.0
    curvature = 0.25 * np.bincount(column, minlength=len(names)) + 1 / variance
    for _ in range(rounds):
        z = bias + np.bincount(row, weights=w[column], minlength=len(rows))
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft
        gradient = np.bincount(column, weights=miss[row], minlength=len(names)) + w / variance
        step_w = 0.8 * step_w - 0.05 * gradient / curvature
        step_b = 0.8 * step_b - 0.2 * miss.mean()
        w, bias = w + step_w, bias + step_b
    return Classifier({n: float(x) for n, x in zip(names, w) if x}, min(float(bias), -2.0))


@dataclass
class ToxicityModel:
    lexicons: Lexicons
    label_model: LabelModel
    classifier: Classifier


def _lists(run: Callable[[str | None], list], texts: pa.Array, kind: pa.DataType) -> pa.Array:
    """A list for each text; those of a few texts at a time are Python objects."""
    chunks = [pa.array([run(t.as_py()) for t in texts[k : k + 64]], pa.list_(kind)) for k in range(0, len(texts), 64)]
    return pa.concat_arrays(chunks) if chunks else pa.array([], pa.list_(kind))


def held_out(id_column: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", most_labelled: int = 12_000) -> ToxicityModel:
    base = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sample = sampled(known, most_labelled, "id")

    @F.arrow_udf("array<string>")
    def seen(texts: pa.Array) -> pa.Array:
        return _lists(lambda text: list(features(tokens(text))), texts, pa.string())

    # The sample has at most ``most_labelled`` rows of two numbers.
    chosen = base.join(F.broadcast(sample), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    by_feature = chosen.select("toxic", F.explode(seen("text")).alias("feature")).groupBy("feature")
    totals = chosen.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    prior = min(0.5, max(0.01, (totals.t + 1) / (totals.n + 2)))
    n, t = F.col("n"), F.col("t")
    tied = by_feature.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).filter(
        (t >= LEAST_ROWS) & (t >= LEAST_SHARE * n) & (t - n * prior >= LEAST_Z * F.sqrt(n * prior * (1 - prior)))
    )
    # no more than the sample has features
    associated = {r.feature: r.close for r in tied.select("feature", (t >= CLOSE * (n + 1)).alias("close")).collect()}
    lex = lexicons(associated)
    names = sorted(lex.lexicons_of)
    number = {f: i for i, f in enumerate(names)}

    @F.arrow_udf("int")
    def votes(texts: pa.Array) -> pa.Array:
        return pa.array([lex.votes(t.as_py()) for t in texts], pa.int32())

    @F.arrow_udf("array<int>")
    def numbered(texts: pa.Array) -> pa.Array:
        return _lists(lambda text: [number[f] for f in features(tokens(text)).intersection(number)], texts, pa.int32())

    counted = base.select(votes("text").alias("pattern")).groupBy("pattern").count().collect()  # at most 2 ** N_VOTERS
    labelled = chosen.select("id", "toxic", votes("text").alias("pattern"), numbered("text").alias("features")).orderBy("id").collect()
    patterns = np.array([r.pattern for r in counted] or [0])
    counts = np.array([r["count"] for r in counted] or [0], float)
    at = {p: k for k, p in enumerate(patterns)}
    anchors = np.zeros((len(patterns), 2))
    for r in labelled:
        anchors[at[r.pattern], r.toxic] += 1
    if labelled:
        counts *= len(labelled) / counts.sum()
    model = fit_label_model(patterns, counts, anchors, prior)
    mine = np.array([r.pattern for r in labelled], int)
    soft = model.posterior(mine) if len(mine) else np.zeros(0)
    return ToxicityModel(lex, model, fit_classifier([r.features for r in labelled], soft, names))


def score(text: Column, model: ToxicityModel) -> Column:
    """Probability that a text is toxic."""
    classifier = model.classifier

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([classifier.score(t.as_py()) for t in texts], pa.float64())

    return scored(text)
