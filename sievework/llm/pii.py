"""Personal data by candidate gradient boosting.

Base rules find plain emails, addresses, card and phone numbers. High-recall generators propose further spans, which
may overlap: spelled-out emails, defanged addresses, card numbers with other separators, phone numbers without a
country code, and bare numbers. Boosted trees judge a candidate by its format and its context; thresholds per kind are
calibrated on held-out candidates to a stated precision. Selected spans are added to the base spans, which always stay.

The trees learn from the corpus itself: base matches, and the same rewritten in the generators' forms, are positive;
matches that a base rule dropped and bare numbers that no generator proposes are negative. Every candidate counts: equal feature vectors of a label
are one row with their number as its weight. Up to ``most_candidates`` distinct ones are learnt from on the driver; more stay
where they are, and only sums per node, feature and bin come back from the tasks (``boosted``). Finding and judging cover
every candidate of every whole text. Null and empty texts have no spans. Where nothing can be learnt, nothing is added. All scans are linear in the text. Spans count code points, ends
are exclusive. Repeated rows are treated alike, further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import materialise, release

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
PROPOSALS = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|(?<= )at(?= )) ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9-]{1,63}){1,8}"), ("(at)", "[at]", " at ")),
    ("ip", re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])"), ("[.]", "(.)")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9])"), None),
    ("phone", re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"), None),
]
#: Ways to write a base match that only a generator finds; e-mail: what stands for the sign and for dots.
FORMS = {
    "email": [(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", "."), ("(at)", "(dot)")],
    "ip": ["[.]", "(.)"],
    "card": ["/", ".", "_"],
    "phone": ["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}"],
}
BARE = re.compile(r"[0-9][0-9.,:/-]{5,30}[0-9]")
CUES = [
    re.compile(p)
    for p in (r"tel|phone|call|fax|mobile|sms", r"mail|contact|write|reply", r"card|visa|pay|credit|iban", r"\bip\b|host|server|address|login", r"version|licen[cs]e|\bv\.?$|no\.$|page|§")
]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            free = found.end()
            yield start, free, True
        at = text.find("@", max(at + 1, free))


def _addresses(text: str) -> Iterator[tuple[int, int, bool]]:
    for run in DOTTED.finditer(text):
        parts, at = run[0].split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            yield at, end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four)
            at = end + 1


def base_matches(text: str) -> list[tuple[int, int, str, bool]]:
    """``start, end, kind, passed`` of every match of the base rules, dropped ones included."""
    out = [(a, b, "email", ok) for a, b, ok in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(a, b, "ip", ok) for a, b, ok in _addresses(text)]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            out.append((m.start(), m.end(), "card", 14 <= len(digits) <= 19 and luhn(digits)))
        for m in PHONE.finditer(text):
            out.append((m.start(), m.end(), "phone", 10 <= sum(c.isdigit() for c in m[0]) <= 15))
    return out


def proposals(text: str) -> list[tuple[int, int, str]]:
    """Spans of the high-recall generators."""
    digits = DIGIT.search(text)
    out = []
    for kind, pattern, needs in PROPOSALS:
        if (digits if needs is None else any(n in text for n in needs)) and (kind == "email" or digits):
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    return out


def bare_numbers(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "card" if sum(c.isdigit() for c in m[0]) > 12 else "phone") for m in BARE.finditer(text)] if DIGIT.search(text) else []


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of a span and what stands before and after it."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = re.findall(r"[0-9]+", span)
    before, after = text[max(0, start - 24) : start].lower(), text[end : end + 1]

    def side(c: str) -> float:
        return 0.0 if not c or c.isspace() else 1.0 if c.isalnum() else 2.0

    return [
        *[float(kind == k) for k in KINDS],
        float(len(span)), float(len(digits)), float(sum(c.isalpha() for c in span)), float(len(groups)),
        float(min(map(len, groups), default=0)), float(max(map(len, groups), default=0)),
        float(len(digits) >= 12 and luhn(digits)), float(bool(groups) and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float("@" in span or "at" in span.lower()), float(span.count(".") + span.lower().count("dot")),
        float("(" in span or "[" in span), side(before[-1:]), side(after), float(len(set(digits))),
        *[float(bool(c.search(before))) for c in CUES],
    ]


def rewritten(text: str, start: int, end: int, kind: str, choice: int) -> tuple[str, int, int]:
    """A base match in one of the forms that only a generator finds, within its context."""
    span = text[start:end]
    form = FORMS[kind][choice % len(FORMS[kind])]
    if kind == "email":
        local, domain = span.rsplit("@", 1)
        span = local + form[0] + domain.replace(".", form[1])
    elif kind == "ip":
        span = span.replace(".", form)
    elif kind == "card":
        digits = span.replace(" ", "").replace("-", "")
        span = form.join((digits[:4], digits[4:8], digits[8:12], digits[12:]))
    else:
        digits = re.sub("[^0-9]", "", span)[-10:]
        span = form.format(digits[:3], digits[3:6], digits[6:])
    left, right = text[max(0, start - 24) : start], text[end : end + 8]
    return left + span + right, len(left), len(left) + len(span)


def _edges(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between all values, or of more than ``bins`` between their weighted quantiles."""
    distinct, at = np.unique(values, return_inverse=True)
    if len(distinct) <= bins:
        return distinct[:-1]
    up_to = np.cumsum(np.bincount(at, weights=weights))
    return distinct[np.unique(np.searchsorted(up_to, np.linspace(0, 1, bins + 1)[1:-1] * up_to[-1]))]


class Boosted:
    """Gradient-boosted trees of depth 3 for the logistic loss, on binned features."""

    def __init__(self, rounds: int = 40, rate: float = 0.3, depth: int = 3, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.rate, self.depth, self.bins, self.ridge = rounds, rate, depth, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> Boosted:
        w = np.ones(len(y)) if weights is None else weights
        edges = [_edges(x[:, j], w, self.bins) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
        share = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.base)
        n_nodes = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = w * (y - p), w * p * (1 - p)
            feature, cut = np.zeros(n_nodes, int), np.full(n_nodes, np.inf)
            node = np.zeros(len(y), int)
            for k in range(n_nodes):
                inside = node == k
                if not inside.any():
                    continue
                best = 1e-6
                g_all, h_all = g[inside].sum(), h[inside].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(binned[inside, j], weights=g[inside], minlength=len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[inside, j], weights=h[inside], minlength=len(e) + 1))[:-1]
                    gain = gl**2 / (hl + self.ridge) + (g_all - gl) ** 2 / (h_all - hl + self.ridge) - g_all**2 / (h_all + self.ridge)
                    if gain.max() > best:
                        best, feature[k], cut[k] = gain.max(), j, e[gain.argmax()]
                node[inside] = 2 * k + 1 + (x[inside, feature[k]] > cut[k])
            leaf = node - n_nodes
            sums, masses = np.bincount(leaf, weights=g, minlength=n_nodes + 1), np.bincount(leaf, weights=h, minlength=n_nodes + 1)
            values = self.rate * sums / (masses + self.ridge)
            self.trees.append((feature, cut, values))
            z += values[leaf]
        return self

    def fit_sums(self, edges: list[np.ndarray], share: float, sums: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> Boosted:
        """``fit`` from sums alone: ``sums(feature, cut, level)`` gives those of g and h by node of a level of the growing tree,
        feature and bin, as an array of 2 x nodes x features x bins."""
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        n_nodes = 2**self.depth - 1
        for _ in range(self.rounds):
            feature, cut = np.zeros(n_nodes, int), np.full(n_nodes, np.inf)
            for level in range(self.depth):
                totals = sums(feature, cut, level)
                leaves = np.zeros((2, 2 ** (level + 1)))
                for at in range(2**level):
                    g, h = totals[:, at]
                    g_all, h_all = g[0].sum(), h[0].sum()
                    leaves[:, 2 * at] = g_all, h_all
                    best, k = 1e-6, 2**level - 1 + at
                    for j, e in enumerate(edges):
                        gl, hl = np.cumsum(g[j])[: len(e)], np.cumsum(h[j])[: len(e)]
                        gain = gl**2 / (hl + self.ridge) + (g_all - gl) ** 2 / (h_all - hl + self.ridge) - g_all**2 / (h_all + self.ridge)
                        if len(e) and gain.max() > best:
                            b = gain.argmax()
                            best, feature[k], cut[k] = gain[b], j, e[b]
                            leaves[:, 2 * at : 2 * at + 2] = [[gl[b], g_all - gl[b]], [hl[b], h_all - hl[b]]]
            self.trees.append((feature, cut, self.rate * leaves[0] / (leaves[1] + self.ridge)))
        return self

    def nodes(self, x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
        node = np.zeros(len(x), int)
        for _ in range(depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for feature, cut, values in self.trees:
            z += values[self.nodes(x, feature, cut, self.depth) - len(cut)]
        return 1 / (1 + np.exp(-z))


@dataclass
class Judge:
    trees: Boosted
    thresholds: dict[str, float]


def calibrated(trees: Boosted, x: np.ndarray, y: np.ndarray, precision: float, weights: np.ndarray | None = None) -> dict[str, float]:
    """Score per kind from which held-out candidates are right with this precision: midway between the lowest of these and the
    next one below, or 0.5; none where there is none."""
    out = {}
    scores = trees.predict(x) if len(x) else np.zeros(0)
    w = np.ones(len(y)) if weights is None else weights
    for k, kind in enumerate(KINDS):
        of = x[:, k] > 0 if len(x) else np.zeros(0, bool)
        s, at = np.unique(-scores[of], return_inverse=True)  # equal scores pass a threshold together
        right, n = np.bincount(at, weights=(w * y)[of], minlength=len(s)), np.bincount(at, weights=w[of], minlength=len(s))
        out[kind] = _threshold(-s, right, n, precision)
    return out


def weighted(counted: DataFrame, most: int) -> DataFrame:
    """A bounded sample of ``x, label, kind, n, held``, which ``fit`` has no need of, with ``scale``, what a vector kept stands for.

    Of more than ``most``, a kind and label keeps a vector with a chance of its number over a bound, and surely from the
    bound on, so that sums of weights are as expected and about ``most`` are kept however the numbers are spread."""
    strata = counted.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("n")).collect()
    bounds, room = [], max(1.0, most - 5 * math.sqrt(most))
    if sum(r.distinct for r in strata) <= most:
        return counted.withColumn("scale", F.lit(1.0))
    for k, r in enumerate(sorted(strata, key=lambda r: (r.distinct, r.kind, r.label))):
        share = room / (len(strata) - k)  # what small strata leave goes to larger ones
        room -= min(share, r.distinct)
        bounds += [F.lit(f"{r.kind}:{r.label}"), F.lit(1.0 if r.distinct <= share else max(1.0, r.n / share))]
    bound = F.try_element_at(F.create_map(*bounds), F.concat_ws(":", "kind", F.col("label").cast("string")))
    place = F.shiftrightunsigned(F.xxhash64("x", "label"), 2) / float(2**62)
    kept = counted.withColumn("bound", bound).filter(place * F.col("bound") < F.col("n"))
    return kept.withColumn("scale", F.greatest(F.lit(1.0), F.col("bound") / F.col("n"))).drop("bound")


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``x, label, kind``: distinct vectors with their number ``n`` and how many of these are held out."""

    def examples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])

            def add(x: list[float], label: int, held: bool) -> None:
                counts = met[tuple(x), label]
                counts[0] += 1
                counts[1] += held

            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py() or ""
                taken = set()

                def apart(a: int, b: int, kind: str) -> bool:
                    return zlib.crc32(f"{i}:{a}:{b}:{kind}".encode()) % 4 == 0

                for a, b, kind, passed in base_matches(text):
                    if not passed and b - a < 4:
                        continue
                    taken.add((a, b))
                    held = apart(a, b, kind)
                    add(features(text, a, b, kind), int(passed), held)
                    if passed:
                        add(features(*rewritten(text, a, b, kind, zlib.crc32(f"{a}:{i}".encode())), kind), 1, held)
                for a, b, kind in bare_numbers(text):
                    if (a, b) not in taken and not any(p.fullmatch(text, a, b) for _, p, _ in PROPOSALS):
                        add(features(text, a, b, kind), 0, apart(a, b, kind))
            columns = [
                pa.array([list(x) for x, _ in met], pa.list_(pa.float64())), pa.array([y for _, y in met], pa.int32()),
                pa.array([c[0] for c in met.values()], pa.int64()), pa.array([c[1] for c in met.values()], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["x", "label", "n", "held"])

    found = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"))
    counted = found.mapInArrow(examples, "x array<double>, label int, n long, held long").groupBy("x", "label")
    kind = F.array_position(F.slice("x", 1, len(KINDS)), F.lit(1.0))
    return counted.agg(F.sum("n").alias("n"), F.sum("held").alias("held")).withColumn("kind", kind.cast("int"))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    x = np.array(batch.column("x").to_pylist(), float)
    return x, *(batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("label", "n", "held"))


def boosted(counted: DataFrame, most: float) -> Boosted:
    """``Boosted.fit`` on all of ``counted(x, label, kind, n, held)`` that is not held out, a kind weighing ``most`` / 4 at most.

    A pass for each level of a tree returns sums of g and h per node, feature and bin. They are sums of whole multiples
    of 2^-36, so that their order doesn't matter; weights add up to ``most``, so they are exact."""
    kinds = {r.kind: r for r in counted.groupBy("kind").agg(F.sum(F.col("n") - F.col("held")).alias("w"), F.sum((F.col("n") - F.col("held")) * F.col("label")).alias("y")).collect()}
    scale = np.zeros(len(KINDS) + 1)
    for kind, r in kinds.items():
        scale[kind] = min(1.0, most / len(KINDS) / max(r.w, 1.0))
    total = sum(scale[k] * r.w for k, r in kinds.items())
    trees = Boosted()
    if not total:
        return trees
    by_kind = F.try_element_at(F.lit(scale.tolist()), F.col("kind") + 1)
    values = counted.select(F.posexplode("x").alias("j", "v"), F.round((F.col("n") - F.col("held")) * by_kind * 2**36).cast("long").alias("w"))
    met: dict[int, list] = defaultdict(list)
    for r in values.filter("w > 0").groupBy("j", "v").agg(F.sum("w").alias("w")).collect():
        met[r.j].append((r.v, float(r.w)))
    edges = [_edges(*np.array(met[j]).T, trees.bins) for j in sorted(met)]
    width = max(len(e) for e in edges) + 1

    def sums(feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        shape = (2, 2**level, len(edges), width)

        def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y, n, held = _columns(batch)
                w = (n - held) * scale[x[:, : len(KINDS)].argmax(axis=1) + 1]
                p = trees.predict(x)
                g, h = np.round(w * (y - p) * 2**36), np.round(w * p * (1 - p) * 2**36)
                node = trees.nodes(x, feature, cut, level) - (2**level - 1)
                for j, e in enumerate(edges):
                    cell = node * width + np.searchsorted(e, x[:, j], "left")
                    for k, values in enumerate((g, h)):
                        out[k, :, j] += np.bincount(cell, weights=values, minlength=2**level * width).reshape(-1, width)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out.ravel()[at].astype(np.int64))], ["at", "value"])

        out = np.zeros(shape).ravel()
        for r in counted.select("x", "label", "n", "held").mapInArrow(summed, "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).collect():
            out[r["at"]] = r["value"] / 2**36
        return out.reshape(shape)

    return trees.fit_sums(edges, sum(scale[k] * r.y for k, r in kinds.items()) / total, sums)


def held_scores(counted: DataFrame, trees: Boosted) -> list:
    """``kind, score, right, n`` of everything held out, scores to four decimals: at most 10,001 of a kind."""

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y, _, held = _columns(batch)
                score = np.round(trees.predict(x) * 10_000).astype(np.int64)
                columns = [x[:, : len(KINDS)].argmax(axis=1), score, (y * held).astype(np.int64), held.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "score", "right", "n"])

    found = counted.select("x", "label", "n", "held").filter("held > 0").mapInArrow(scored, "kind long, score long, right long, n long")
    return found.groupBy("kind", "score").agg(F.sum("right").alias("right"), F.sum("n").alias("n")).collect()


def _threshold(s: np.ndarray, right: np.ndarray, n: np.ndarray, precision: float) -> float:
    """Of falling scores ``s``."""
    good = np.flatnonzero(np.cumsum(right) >= precision * np.cumsum(n))
    if not (len(good) and right.any()):
        return 2.0
    below = s[good[-1] + 1] if good[-1] + 1 < len(s) else 0.5
    return max(0.5, float(below + s[good[-1]]) / 2)


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_candidates: int = 12_000, precision: float = 0.99) -> Judge:
    """Trees and thresholds from the base matches of the corpus."""
    counted = materialise(candidates(docs, id_column, text_column), "candidates")
    if counted.count() > most_candidates:
        trees, thresholds = boosted(counted, most_candidates), {}
        rows = sorted(held_scores(counted, trees), key=lambda r: -r.score)
        release(counted)
        for k, kind in enumerate(KINDS):
            of = [r for r in rows if r.kind == k]
            s, right, n = (np.array([r[c] for r in of], float) for c in ("score", "right", "n"))
            thresholds[kind] = _threshold(s / 10_000, right, n, precision)
        return Judge(trees, thresholds)
    rows = counted.collect()
    release(counted)
    rows.sort(key=lambda r: (r.x, r.label))
    if not rows:
        return Judge(Boosted(), {k: 2.0 for k in KINDS})
    x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows], float)
    held, rest = np.array([float(r.held) for r in rows]), np.array([float(r.n - r.held) for r in rows])
    for k in range(len(KINDS)):  # no kind crowds out another: what is likely within a kind stays the same
        of = x[:, k] > 0
        rest[of] *= min(1.0, most_candidates / len(KINDS) / max(rest[of].sum(), 1.0))
    trees = Boosted().fit(x[rest > 0], y[rest > 0], rest[rest > 0]) if rest.any() else Boosted()
    return Judge(trees, calibrated(trees, x[held > 0], y[held > 0], precision, held[held > 0]))


def find(text: str | None, judge: Judge) -> list[tuple[str, int, int, bool, float]]:
    """``kind, start, end, base, score`` of all spans of a text, by start and kind."""
    text = text or ""
    spans = [(kind, a, b, True, 1.0) for a, b, kind, passed in base_matches(text) if passed]
    proposed = proposals(text)
    if proposed:
        scores = judge.trees.predict(np.array([features(text, *p) for p in proposed]))
        starts, ends = [], []  # of stretches that are taken, apart from each other
        for _, a, b, _, _ in sorted(spans, key=lambda s: s[1]):
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        for s, (a, b, kind) in sorted(zip(scores.tolist(), proposed), key=lambda c: (-c[0], c[1])):
            at = bisect_right(ends, a)
            if s >= judge.thresholds[kind] and (at == len(starts) or b <= starts[at]):
                spans.append((kind, a, b, False, s))
                starts.insert(at, a)
                ends.insert(at, b)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"
SPANS_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])
)


def spans(text: Column, judge: Judge) -> Column:
    """Spans of a text column."""
    names = ("kind", "start", "end", "base", "score")

    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(names, s)) for s in find(t.as_py(), judge)] for t in texts], SPANS_ARROW)

    return found(text)


def redacted(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are merged into the first."""

    @F.arrow_udf("string")
    def replaced(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text, items in zip(texts.to_pylist(), lists.to_pylist()):
            if text is None:
                out.append(None)
                continue
            parts, at = [], 0
            for s in items or []:
                if s["start"] >= at:
                    parts += [text[at : s["start"]], f"[{s['kind']}]"]
                at = max(at, s["end"])
            out.append("".join([*parts, text[at:]]))
        return pa.array(out, pa.string())

    return replaced(text, found)
