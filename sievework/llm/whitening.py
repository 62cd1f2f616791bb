"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become integers, every distinct vector counts once, and ``A = n * sum(x x') - S S'`` is gathered exactly. The
polynomial ``det(t I - A)`` is found modulo many primes (one Hessenberg reduction each, spread over tasks) and put together
by Chinese remaindering. All its roots are real, so the sign changes of a shifted polynomial count the roots beyond a
point exactly; bisection isolates each root and refines it far beyond doubles. A component is the null vector of
``A - root``, by inverse iteration in decimals of ``DIGITS`` digits; equal roots share an orthonormal basis.

Cases: vectors that are null, empty or hold null or non-finite entries have no result, nor have vectors whose length is not the
commonest one (the longer one of ties); entries beyond 2^46 count as 2^46; a table without rows, or whose vectors are all
equal, gives no components and no rows. Components with root 0 are left out. A deviation beyond 64 bits is null.
Repeated ids and rows each get their rows, extra columns don't matter. What reaches the driver depends on the length of the
vectors alone (about d^2 / 2 sums, and d + 1 residues for each of some (d * bits of A) / 31 primes).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import materialise

SCALE, SHIFT, WIDEST = 64.0, 1_000_000, float(2**52)
#: Bits of the trace after scaling: roots are known to 2^-ROOT_BITS of it.
ROOT_BITS = 220
DIGITS = 150
LOW = 60


def integers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry; null where the vector can't be used."""
    usable = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    entry = lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(WIDEST)), F.lit(-WIDEST))) + SHIFT
    return F.when(usable & (F.size(vector) > 0), F.transform(vector, entry))


def _rows(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    """The vectors of a batch less ``SHIFT``, as int64."""
    listed = batch.column(column)
    return listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d) - SHIFT


def _product(y: np.ndarray) -> np.ndarray:
    """y'y, exactly: in doubles where no sum can pass 2^53, else in Python's integers."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 2**53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if len(y) > 64 and most < 2**23:
        return sum(_product(y[k : k + 64]) for k in range(0, len(y), 64))
    o = y.astype(object)
    return o.T.dot(o)


def _moments(d: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            y = _rows(batch, "x", d)
            n += len(y)
            first += y.astype(object).sum(axis=0) if len(y) else 0
            second += _product(y)
        i, j = np.triu_indices(d)
        values = [n, *first, *second[i, j]]
        yield pa.RecordBatch.from_pydict(
            {
                "i": pa.array([-2] + [-1] * d + i.tolist(), pa.int32()),
                "j": pa.array([0, *range(d)] + j.tolist(), pa.int32()),
                "high": pa.array([str(int(v) >> LOW) for v in values]),
                "low": pa.array([int(v) & (1 << LOW) - 1 for v in values], pa.int64()),
            }
        )

    return sums


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that are enough below 2^32."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2^31, from the largest down, whose product is above ``bound``."""
    found, product, n = [], 1, 2**31 - 1
    while product <= bound:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_mod(a: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(t I - a) modulo a prime below 2^31, the constant one first."""
    h = np.array([[v % p for v in row] for row in a], np.int64)
    d = len(h)
    for k in range(1, d - 1):
        filled = np.nonzero(h[k:, k - 1])[0]
        if not len(filled):
            continue
        at = k + int(filled[0])
        if at != k:
            h[[k, at]] = h[[at, k]]
            h[:, [k, at]] = h[:, [at, k]]
        times = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - times[:, None] * h[k]) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * times % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        weights, below = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            weights[i] = int(h[i, k]) * below % p
        new = np.roll(polys[k], 1) - polys[k] * h[k, k] % p
        polys[k + 1] = (new - (polys[:k] * weights[:, None] % p).sum(axis=0)) % p
    return polys[d].tolist()


def polynomial(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """Coefficients of det(t I - a) of a positive semidefinite integer matrix, the constant one first."""
    d, trace = len(a), sum(a[k][k] for k in range(len(a)))
    mean = -(-trace // d)
    primes = primes_beyond(2 * max(comb(d, k) * mean**k for k in range(d + 1)) + 1)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column("prime").to_pylist()
            yield pa.RecordBatch.from_pydict({"prime": pa.array(mine, pa.int64()), "c": pa.array([polynomial_mod(a, p) for p in mine], pa.list_(pa.int64()))})

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    asked = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(tasks)
    found, product = [0] * (d + 1), 1
    for row in sorted(asked.mapInArrow(residues, "prime long, c array<long>").collect(), key=lambda r: -r.prime):
        inverse = pow(product, -1, row.prime)
        found = [v + product * ((c - v) * inverse % row.prime) for v, c in zip(found, row.c, strict=True)]
        product *= row.prime
    return [v - product if 2 * v > product else v for v in found]


def beyond(poly: list[int], at: int) -> int:
    """How many roots of a polynomial with real roots only are above ``at``: sign changes of its shift (Descartes' rule is
    exact for these)."""
    c = list(poly)
    for k in range(len(c) - 1):
        for i in range(len(c) - 2, k - 1, -1):
            c[i] += at * c[i + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(poly: list[int], at: int) -> int:
    total = 0
    for c in reversed(poly):
        total = total * at + c
    return total


def root(poly: list[int], k: int, top: int) -> tuple[int, int, int]:
    """The ``k``-th largest root (from 1) of a polynomial with real roots below ``top``: a lower end, less than 1 below it,
    which of the roots that can't be told from it is the ``k``-th (from 0), and how many these are."""
    low, high = -1, top
    over_low, over_high = len(poly) - 1, 0
    while high - low > 1:
        if over_low - over_high == 1 and (sign := _value(poly, low)) != 0 and (other := _value(poly, high)) != 0:
            while high - low > 1:  # a single root inside: signs are enough
                middle = (low + high) // 2
                here = _value(poly, middle)
                if here == 0:
                    return middle, 0, 1
                low, high = (middle, high) if (here > 0) == (sign > 0) else (low, middle)
            return low, k - 1 - over_high, 1
        middle = (low + high) // 2
        over = beyond(poly, middle)
        if over >= k:
            low, over_low = middle, over
        else:
            high, over_high = middle, over
    # roots lie above low and up to high: the upper end is the root where it is an exact one
    return (high if _value(poly, high) == 0 else low), k - 1 - over_high, over_low - over_high


def null_vectors(a: list[list[int]], value: int, bits: int, count: int) -> list[list[Decimal]]:
    """Orthonormal vectors with ``a v = (value / 2^bits) v`` by inverse iteration."""
    d = len(a)
    with localcontext() as own:
        own.prec = DIGITS
        m = [[Decimal((v << bits) - (value if i == j else 0)) for j, v in enumerate(row)] for i, row in enumerate(a)]
        tiny = max(max(abs(v) for v in row) for row in m) * Decimal(10) ** -(DIGITS - 10) or Decimal(1)
        order = list(range(d))
        for k in range(d):
            at = max(range(k, d), key=lambda i: abs(m[i][k]))
            m[k], m[at], order[k], order[at] = m[at], m[k], order[at], order[k]
            if abs(m[k][k]) < tiny:
                m[k][k] = tiny
            pivot = m[k]
            for i in range(k + 1, d):
                row = m[i]
                if row[k]:
                    times = row[k] = row[k] / pivot[k]
                    for j in range(k + 1, d):
                        row[j] -= times * pivot[j]

        def solved(b: list[Decimal]) -> list[Decimal]:
            x = [b[i] for i in order]
            for i in range(d):
                x[i] -= sum((m[i][j] * x[j] for j in range(i)), Decimal(0))
            for i in range(d - 1, -1, -1):
                x[i] = (x[i] - sum((m[i][j] * x[j] for j in range(i + 1, d)), Decimal(0))) / m[i][i]
            return x

        found: list[list[Decimal]] = []
        for k in range(count):
            v = [Decimal((i * 7919 + k * 104729 + 12345) * (i + 31) % 1009 - 504) for i in range(d)]
            for _ in range(3):
                v = solved(v)
                for _ in range(2):
                    for u in found:
                        share = sum((x * y for x, y in zip(u, v, strict=True)), Decimal(0))
                        v = [y - share * x for x, y in zip(u, v, strict=True)]
                    size = sum((x * x for x in v), Decimal(0)).sqrt()
                    v = [x / size for x in v]
            lead = max(range(d), key=lambda i: abs(v[i]))
            found.append([-x for x in v] if v[lead] < 0 else v)
        return found


def _component(a: list[list[int]], poly: list[int], bits: int, k: int) -> tuple[list[float], str]:
    """The ``k``-th component and its root times 2^bits."""
    d = len(a)
    scaled = [c << bits * (d - i) for i, c in enumerate(poly)]
    top = (sum(a[i][i] for i in range(d)) << bits) + 1
    value, which, count = root(scaled, k, top)
    return [float(x) for x in null_vectors(a, value, bits, count)[which]], str(value)


@dataclass
class Whitening:
    """``shift``: sums of x - SHIFT; ``components``: unit rows; ``roots``: eigenvalues of the covariance; ``explained``: their
    shares of its trace."""

    n: int
    shift: list[int]
    components: np.ndarray
    roots: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def length(self) -> int:
        return len(self.shift)

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: int64 where it fits, else Python's integers."""
        most = int(np.abs(y).max(initial=0)) * self.n + max((abs(v) for v in self.shift), default=0)
        kind = np.int64 if most < 2**62 else object
        return y.astype(kind) * self.n - np.array(self.shift, kind)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.components.T / np.sqrt(self.roots)


def usable(vectors: DataFrame, vector: str, keep: list[str]) -> tuple[DataFrame, int]:
    """``keep`` and the integers ``x`` of the vectors that count, and their length."""
    all_of_them = vectors.select(*keep, integers(F.col(vector)).alias("x")).filter("x is not null")
    common = all_of_them.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    return all_of_them.filter(F.size("x") == d), d


def fit(rows: DataFrame, d: int, most: int = 16) -> Whitening:
    """The whitening of the distinct ``x`` of ``rows``, vectors of length ``d``, by at most ``most`` components."""
    spark = rows.sparkSession
    none = Whitening(0, [0] * d, np.zeros((0, d)), np.zeros(0), np.zeros(0))
    if d == 0:
        return none
    listed = materialise(rows.select("x").distinct(), "fit-list")
    sums = listed.mapInArrow(_moments(d), "i int, j int, high string, low long")
    totals = sums.groupBy("i", "j").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    at = {(r.i, r.j): (int(r.high) << LOW) + int(r.low) for r in totals.collect()}
    n, shift = at[-2, 0], [at[-1, j] for j in range(d)]
    a = [[n * at[min(i, j), max(i, j)] - shift[i] * shift[j] for j in range(d)] for i in range(d)]
    trace = sum(a[k][k] for k in range(d))
    if trace == 0:
        none.n, none.shift = n, shift
        return none
    poly = polynomial(spark, a)
    rank = d - next(k for k, c in enumerate(poly) if c)
    bits = max(0, ROOT_BITS - trace.bit_length())

    def components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                vector, value = _component(a, poly, bits, k + 1)
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "v": pa.array([vector], pa.list_(pa.float64())), "value": [value]})

    count = min(most, rank)
    found = sorted(spark.range(0, count, 1, count).mapInArrow(components, "k long, v array<double>, value string").collect(), key=lambda r: r.k)
    exact = [(Decimal(r.value), Decimal(n) * n * (1 << bits)) for r in found]
    model = Whitening(
        n, shift, np.array([r.v for r in found]), np.array([float(v / by) for v, by in exact]),
        np.array([float(v / (Decimal(trace) * (1 << bits))) for v, _ in exact]),
    )
    model.identity_error = identity_error(listed, model)
    return model


def identity_error(listed: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    d, m = model.length, len(model.roots)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(m), np.zeros((m, m))
        for batch in batches:
            w = model.whitened(model.centred(_rows(batch, "x", d)))
            first, second = first + w.sum(axis=0), second + w.T @ w
        i, j = np.indices((m, m))
        yield pa.RecordBatch.from_pydict(
            {
                "i": pa.array([-1] * m + i.ravel().tolist(), pa.int32()),
                "j": pa.array([*range(m)] + j.ravel().tolist(), pa.int32()),
                "part": pa.array(np.concatenate([first, second.ravel()])),
            }
        )

    at = {(r.i, r.j): r.total / model.n for r in listed.mapInArrow(sums, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("total")).collect()}
    return max(abs(at[i, j] - at[-1, i] * at[-1, j] - (i == j)) for i in range(m) for j in range(m))


def whiten(rows: DataFrame, key: str, model: Whitening) -> DataFrame:
    """(``key``, component, n, deviation, whitened, explained, identity_error) of every row of ``rows(key, x)``."""
    d, m = model.length, len(model.roots)
    schema = rows.select(key).schema.add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    if m == 0:
        return rows.sparkSession.createDataFrame([], schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                away = model.centred(_rows(batch, "x", d))
                most = int(np.abs(away).max(initial=0))
                far = (away * away).sum(axis=1) if most * most * d < 2**63 else [sum(int(v) ** 2 for v in row) for row in away]
                far = np.array([v if v < 2**63 else None for v in map(int, far)], object)
                size = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key).take(pa.array(np.repeat(np.arange(size), m))),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), size)),
                        pa.array(np.full(size * m, model.n)),
                        pa.array(np.repeat(far, m).tolist(), pa.int64()),
                        pa.array(model.whitened(away).ravel()),
                        pa.array(np.tile(model.explained, size)),
                        pa.array(np.full(size * m, model.identity_error)),
                    ],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(apply, schema)
