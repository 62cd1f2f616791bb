"""Quality rules: base statistics of a text, and multivariate outliers by minimum covariance determinant.

Statistics are counted whole; then, per language and source, they are transformed to about normal variables and a
minimum-covariance-determinant estimate of their centre and scatter is made: from two robust starts, the three
quarters of rows nearest to the last estimate make the next one, the start with the smaller determinant wins, and one
step over all rows within the 97.5 % ellipsoid follows. Documents beyond ``cutoff`` in Mahalanobis distance are rejected.
Everything is DataFrame expressions: a step is one aggregation into distance classes per group, summed before the
shuffle, whose running totals give centre and scatter of the nearest rows.

Groups of fewer than ``least_rows`` rows share the estimate of their language's small groups, or where these are too
few as well, of all such rows. Null languages and sources are values of their own. A null text counts as empty; rows
without words fail the base rules. Repeated rows are judged alike. Further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import materialise, release

SYMBOLS = "#*$%&|<>"
BLANK_CHARS = " \t\n\x0b\f\r"
WINDOW = 8
NEAR = 0.75
STEPS = 4
FEATURES = ["x0", "x1", "x2", "x3", "x4"]
#: Least standard deviation of each transformed statistic: most texts have no symbols or repeats at all. Each statistic can
#: exceed the cutoff alone: where a group has none, from 9 symbols to 100 words, 23 % repeated lines, 15 % repeated words on.
FLOORS = [1.0, 0.5, 0.3, 0.7, 0.6]
DIMENSIONS = len(FEATURES)


def chi2_below(x: float, k: int) -> float:
    """Distribution function of the chi-squared distribution, by the series of the incomplete gamma function."""
    a, half = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= half / (a + n)
        total += term
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 1e-9, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_below(middle, k) < p else (low, middle)
    return (low + high) / 2


#: What the scatter of the nearest three quarters of a normal sample falls short of.
CONSISTENCY = NEAR / chi2_below(chi2_quantile(NEAR, DIMENSIONS), DIMENSIONS + 2)
CONSISTENCY_97 = 0.975 / chi2_below(chi2_quantile(0.975, DIMENSIONS), DIMENSIONS + 2)
CUTOFF = chi2_quantile(0.999, DIMENSIONS)


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """Counts of every text: words, their characters, symbols, lines, repeated lines, words in repeated windows."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(lang_column).alias("lang"), F.col(source_column).alias("source"), text.alias("text"))
    solid = F.translate("text", BLANK_CHARS, "")
    counted = base.withColumns(
        {
            "words": F.array_remove(F.split(F.translate("text", BLANK_CHARS, " " * len(BLANK_CHARS)), " ", -1), ""),
            "lines": F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != ""),
            "word_chars": F.char_length(solid),
            "n_symbols": F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, "")),
        }
    )
    counted = counted.withColumns(
        {
            "hashes": F.transform("words", lambda w: F.xxhash64(w)),
            "n_lines": F.size("lines"),
            "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
            "n_words": F.size("words"),
        }
    ).drop("text", "words", "lines")
    windows = F.expr(f"transform(sequence(1, n_words - {WINDOW - 1}), i -> xxhash64(slice(hashes, i, {WINDOW})))")
    counted = counted.withColumn("windows", F.when(F.col("n_words") >= WINDOW, windows)).drop("hashes")
    again = F.size("windows") > F.size(F.array_distinct("windows"))
    counted = counted.withColumn("placed", F.when(again, F.expr("sort_array(transform(windows, (h, i) -> struct(h, i)))"))).drop("windows")
    met = F.expr("filter(placed, (x, k) -> x.h <=> get(placed, k - 1).h or x.h <=> get(placed, k + 1).h)")
    counted = counted.withColumn("at", F.sort_array(F.transform(met, lambda x: x["i"]))).drop("placed")
    covered = F.expr(f"aggregate(transform(at, (p, k) -> least({WINDOW}, coalesce(get(at, k + 1) - p, {WINDOW}))), 0, (a, b) -> a + b)")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    return counted.select(
        "doc_id", "lang", "source", *[F.col(n).cast("long") for n in names], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _grouped(stats: DataFrame, least_rows: int) -> DataFrame:
    """``stats`` with ``grp``, the group whose estimate a row is held against."""
    counts = stats.groupBy("lang", "source").agg(F.count(F.when(~F.col("failed"), 1)).alias("n"))
    small = F.when(F.col("n") < least_rows, F.col("n")).otherwise(0)
    counts = counts.withColumn("of_lang", F.sum(small).over(Window.partitionBy("lang")))
    group = (
        F.when(F.col("n") >= least_rows, F.to_json(F.struct(F.lit(0).alias("level"), "lang", "source")))
        .when(F.col("of_lang") >= least_rows, F.to_json(F.struct(F.lit(1).alias("level"), "lang")))
        .otherwise(F.lit('{"level":2}'))
    )
    named = counts.select(F.col("lang").alias("l"), F.col("source").alias("s"), group.alias("grp"))
    joined = stats.join(named, stats.lang.eqNullSafe(F.col("l")) & stats.source.eqNullSafe(F.col("s")), "left")
    return joined.drop("l", "s")


def _middle(values: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Median of ``v`` per key to within ``width``: the middle class of a histogram."""
    classes = values.groupBy(*keys, F.floor(F.col("v") / width).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(*keys).orderBy("class"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    found = classes.withColumns({"up_to": up_to, "total": total}).filter("2 * up_to >= total").groupBy(*keys)
    return found.agg(((F.min("class") + 0.5) * width).alias("middle"))


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]


def _distance(rows: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Squared Mahalanobis distance ``d2`` to each row's estimate: forward substitution with its Cholesky factor."""
    rows = rows.join(estimates, keys)
    for i in range(DIMENSIONS):
        y = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"y{j}")
        rows = rows.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, DIMENSIONS)), F.col("y0") * F.col("y0")))


def _estimate(sums: DataFrame, keys: list[str], consistency: float) -> DataFrame:
    """Centre, Cholesky factor of the scatter and its determinant from sums ``n, s*, q**``."""
    n = F.col("n")
    centred = sums.withColumns({f"m{i}": F.col(f"s{i}") / n for i in range(DIMENSIONS)})
    scatter = {}
    for i, j in _pairs():
        value = (F.col(f"q{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")) * consistency
        scatter[f"c{i}{j}"] = F.greatest(value, F.lit(0.0)) + FLOORS[i] ** 2 if i == j else value
    factored = centred.withColumns(scatter)
    for i, j in _pairs():
        value = F.col(f"c{i}{j}")
        for k in range(j):
            value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        factored = factored.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l{j}{j}"))
    det = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, DIMENSIONS)), F.log(F.col("l00")))
    return factored.select(*keys, *[f"m{i}" for i in range(DIMENSIONS)], *[f"l{i}{j}" for i, j in _pairs()], det.alias("log_det"))


def _moments() -> list[Column]:
    return (
        [F.count(F.lit(1)).alias("n")]
        + [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMENSIONS)]
        + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _pairs()]
    )


def _nearest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over the nearest ``NEAR`` of each group's rows: running totals over classes of distance."""
    classes = rows.withColumn("class", F.floor(F.log(F.col("d2") + 1e-6) * 16)).groupBy(*keys, "class").agg(*_moments())
    running = Window.partitionBy(*keys).orderBy("class")
    names = ["n"] + [f"s{i}" for i in range(DIMENSIONS)] + [f"q{i}{j}" for i, j in _pairs()]
    totals = classes.withColumn("all_rows", F.sum("n").over(Window.partitionBy(*keys))).select(
        *keys, "class", "all_rows", *[F.sum(c).over(running).alias(c) for c in names]
    )
    enough = totals.filter(F.col("n") >= NEAR * F.col("all_rows"))
    return enough.groupBy(*keys).agg(*[F.min_by(c, "class").alias(c) for c in names])


def outliers(docs: DataFrame, least_rows: int = 100, cutoff: float = CUTOFF, **columns: str) -> DataFrame:
    """Statistics of each document with ``base_failed``, its group, ``d2`` and ``kept``."""
    stats = materialise(statistics(docs, **columns).withColumn("failed", base_failed()), "statistics")
    grouped = _grouped(stats, least_rows)
    sound = grouped.filter("not failed")
    middle_length = _middle(sound.select("grp", (F.col("word_chars") / F.col("n_words")).alias("v")), ["grp"], 1 / 64)
    n = F.greatest(F.col("n_words"), F.lit(1))
    features = [
        (F.col("word_chars") - F.col("middle") * n) / F.sqrt(n),  # steady in variance whatever the length
        F.log1p(100 * F.col("n_symbols") / n),
        F.log(n),
        F.log1p(100 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.log1p(100 * F.col("n_repeat_words") / n),
    ]
    judged = materialise(
        grouped.join(middle_length, "grp", "left").select(*stats.columns, "grp", *[x.alias(name) for x, name in zip(features, FEATURES)]), "features"
    )
    release(stats)
    rows = judged.filter("not failed").select("grp", *FEATURES)

    single = rows.select("grp", F.posexplode(F.array(*FEATURES)).alias("dim", "v"))
    medians = _middle(single, ["grp", "dim"], 1 / 32)
    apart = single.join(medians, ["grp", "dim"]).select("grp", "dim", F.abs(F.col("v") - F.col("middle")).alias("v"))
    spread = _middle(apart, ["grp", "dim"], 1 / 64).withColumnRenamed("middle", "spread")
    wide = medians.join(spread, ["grp", "dim"]).groupBy("grp")
    starts = wide.agg(
        *[F.max(F.when(F.col("dim") == i, F.col("middle"))).alias(f"m{i}") for i in range(DIMENSIONS)],
        *[F.max(F.when(F.col("dim") == i, F.greatest(1.4826 * F.col("spread"), F.lit(FLOORS[i])))).alias(f"w{i}") for i in range(DIMENSIONS)],
    )
    z = [F.pow((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"w{i}"), 2) for i in range(DIMENSIONS)]
    both = F.array(sum(z[1:], z[0]), F.greatest(*z))  # by sum of squares, and by the largest
    begun = rows.join(starts, "grp").select("grp", *FEATURES, F.posexplode(both).alias("start", "d2"))

    keys = ["grp", "start"]
    estimates = materialise(_estimate(_nearest(begun, keys), keys, CONSISTENCY), "estimates")
    for _ in range(STEPS):
        twice = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
        following = materialise(_estimate(_nearest(_distance(twice, estimates, keys), keys), keys, CONSISTENCY), "estimates")
        release(estimates)
        estimates = following
    best = estimates.groupBy("grp").agg(*[F.min_by(c, F.struct("log_det", "start")).alias(c) for c in estimates.columns if c not in keys])
    inside = _distance(rows, best, ["grp"]).filter(F.col("d2") <= chi2_quantile(0.975, DIMENSIONS)).groupBy("grp").agg(*_moments())
    final = materialise(_estimate(inside, ["grp"], CONSISTENCY_97), "estimates")
    passed = _distance(judged.filter("not failed"), final, ["grp"]).select(*stats.columns, "grp", "d2", (F.col("d2") <= cutoff).alias("kept"))
    failed = judged.filter("failed").select(*stats.columns, "grp", F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"))
    return passed.unionByName(failed).withColumnRenamed("failed", "base_failed")
