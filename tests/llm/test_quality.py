import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from sievework.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(text):
    text = text or ""
    ws = WORD.findall(text)
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    found = Counter(windows)
    covered = {j for i, w in enumerate(windows) if found[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(lines), len(covered)


def middle(values, width):
    classes = sorted(Counter(math.floor(v / width) for v in values).items())
    up_to, half = 0, len(values)
    for c, n in classes:
        up_to += n
        if 2 * up_to >= half:
            return (c + 0.5) * width


def estimate(x, consistency):
    centre = x.mean(axis=0)
    scatter = ((x[:, :, None] * x[:, None, :]).mean(axis=0) - np.outer(centre, centre)) * consistency
    scatter[np.diag_indices(5)] = np.maximum(np.diag(scatter), 0) + np.square(quality.FLOORS)
    return centre, scatter


def distance(x, centre, scatter):
    return np.einsum("ni,ij,nj->n", x - centre, np.linalg.inv(scatter), x - centre)


def nearest(x, d2):
    classes = np.floor(np.log(d2 + 1e-6) * 16)
    for c in np.unique(classes):
        if (classes <= c).sum() >= quality.NEAR * len(x):
            return x[classes <= c]


def brute_verdicts(rows, least_rows, cutoff):
    """The same estimate by numpy, group by group."""
    stats = {i: brute_statistics(t) for i, t, _, _ in rows}
    sound = {i for i, s in stats.items() if s[0] >= 20 and 100 * s[5] <= 30 * s[0]}
    count = Counter((lang, source) for i, _, lang, source in rows if i in sound)
    of_lang = Counter()
    for (lang, _), n in count.items():
        of_lang[lang] += n if n < least_rows else 0
    groups = defaultdict(list)
    for i, _, lang, source in rows:
        if i in sound:
            groups[(0, lang, source) if count[lang, source] >= least_rows else (1, lang) if of_lang[lang] >= least_rows else 2].append(i)
    kept = dict.fromkeys(stats, False)
    for ids in groups.values():
        length = middle([stats[i][1] / stats[i][0] for i in ids], 1 / 64)
        x = np.array([[(c - length * n) / math.sqrt(n), math.log1p(100 * s / n), math.log(n), math.log1p(100 * d / max(k, 1)), math.log1p(100 * r / n)] for n, c, s, d, k, r in (stats[i] for i in ids)])
        m = np.array([middle(x[:, j], 1 / 32) for j in range(5)])
        w = np.array([max(1.4826 * middle(np.abs(x[:, j] - m[j]), 1 / 64), quality.FLOORS[j]) for j in range(5)])
        z = ((x - m) / w) ** 2
        best = None
        for d2 in (z.sum(axis=1), z.max(axis=1)):
            e = estimate(nearest(x, d2), quality.CONSISTENCY)
            for _ in range(quality.STEPS):
                e = estimate(nearest(x, distance(x, *e)), quality.CONSISTENCY)
            det = np.linalg.slogdet(e[1])[1]
            if best is None or det < best[0] - 1e-12:
                best = (det, e)
        inside = x[distance(x, *best[1]) <= quality.chi2_quantile(0.975, 5)]
        d2 = distance(x, *estimate(inside, quality.CONSISTENCY_97))
        kept |= {i: bool(d <= cutoff) for i, d in zip(ids, d2)}
    return stats, kept


def test_verdicts_equal_brute_force(spark, words):
    rng = random.Random(8)
    rows = []
    for k in range(700):
        text = words(int(rng.lognormvariate(4.5, 0.8)) + 3, k)
        if k % 23 == 0:
            text = " ".join(w + rng.choice(["***", "$$$"]) for w in text.split())
        elif k % 29 == 0:
            text = text.upper().replace(" ", "!! ")
        elif k % 31 == 0:
            text = "\n".join([text[:80]] * 9)
        rows.append((k, text, ("en", "de", None)[k % 3], "hot" if k % 2 else ("s1", None, "s2")[k % 3]))
    rows += [(900, None, "en", "hot"), (901, "", None, None), (902, " \n ", "xx", "yy"), (903, "a " * 30_000, "en", "hot"), (904, rows[1][1], "en", "hot"), (904, rows[1][1], "en", "hot")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as d2", "2 as grp")
    stats, kept = brute_verdicts([r for r in rows if r[0] != 904] + rows[-1:] * 2, 60, quality.CUTOFF)
    got = quality.outliers(frame, least_rows=60).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_lines, r.n_repeat_words) == stats[r.doc_id]
        assert r.kept == kept[r.doc_id], (r, kept[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    spoilt = [r for r in got if r.doc_id < 700 and r.doc_id % 23 == 0 and not r.base_failed]
    assert spoilt and not any(r.kept for r in spoilt)
    clean = [r for r in got if r.doc_id < 700 and r.doc_id % 23 and r.doc_id % 29 and r.doc_id % 31 and not r.base_failed]
    assert all(r.kept for r in clean)


def test_repeats_alone_are_rejected(docs, words):
    """Documents at the centre of their group but for repeated lines, repeated words or symbols."""

    def lined(text):
        ws = text.split()
        return "\n".join(" ".join(ws[i : i + 6]) for i in range(0, len(ws), 6))

    clean = [lined(words(90 + k % 21, k)) for k in range(400)]
    half = "\n".join(x for k in range(15) for x in (words(4, 3_000 + k), words(3, 4_000)))
    passage = words(12, 5_000)
    again = lined(f"{words(30, 5_001)} {passage} {words(20, 5_002)} {passage} {words(26, 5_003)}")
    signs = lined(" ".join(w + "#" * (k % 6 == 0) for k, w in enumerate(words(100, 6_000).split())))
    got = {r.doc_id: r for r in quality.outliers(docs(clean + [half, again, signs]), least_rows=1_000).collect()}
    planted = [got[k] for k in range(400, 403)]
    assert not any(r.base_failed for r in planted) and not any(r.kept for r in planted)
    assert sum(not got[k].kept for k in range(400)) <= 8


def test_chi_squared():
    assert abs(quality.chi2_quantile(0.975, 5) - 12.8325) < 1e-3
    assert abs(quality.chi2_below(6.6257, 5) - 0.75) < 1e-4


def test_empty_table(docs):
    assert quality.outliers(docs([])).collect() == []
