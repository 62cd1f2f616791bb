import re
from collections import Counter, defaultdict

from sievework.llm import exact, lines


def brute_exact(rows):
    key = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = defaultdict(list)
    for i, t in rows:
        groups[key[i]].append(i)
    return {i: (min(groups[key[i]]), len(groups[key[i]])) for i, _ in rows}


TEXTS = ["a b", "a  b", "a\tb", None, "", " ", "c", "a b ", "C", "x" * 100_000, "x" * 100_000] + [f"only {k}" for k in range(40)] + ["hot line"] * 60


def test_exact_equals_brute_force(docs):
    frame = docs(TEXTS)
    for words in (1, 1 << 20):  # a filter of one word lets everything through, the result is the same
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_duplicates(frame, filter_words=words).collect()}
        assert got == brute_exact(list(enumerate(TEXTS)))


def test_exact_repeated_rows_and_null_ids(docs):
    got = exact.exact_duplicates(docs(["a", "a", "a", "b"], [1, 1, None, 2]).withColumnRenamed("lang", "keep_id")).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.keep_id, r.group_size, r.kept) for r in got if r.doc_id) == [(False, 1, 1, 3, True), (False, 2, 2, 1, True)]
    assert [(r.keep_id, r.kept) for r in got if r.doc_id is None] == [(1, False)]


def test_exact_empty_table(docs):
    assert exact.exact_duplicates(docs([])).collect() == []


def brute_lines(rows, min_docs, min_chars, keep_first):
    keys = {i: [line.strip(" \t\n\x0b\f\r").translate(str.maketrans(lines.UPPER, lines.LOWER)) for line in (t or "").split("\n")] for i, t in rows}
    found = Counter(k for i in keys for k in set(keys[i]))
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        stays = []
        for line, k in zip((t or "").split("\n"), keys[i]):
            gone = len(k) >= min_chars and found[k] >= min_docs and not (keep_first and k not in seen)
            seen.add(k)
            if not gone:
                stays.append(line)
        out[i] = "\n".join(stays)
    return out


LINES = [None, "", "\n", "A b\n c ", " a B\nx\n\n", "a b", "a b\na b\na b", "q\nÄ", "q\nä", "\x0bA B\f"] + [f"own {k}\na b\n\nsecond" for k in range(70)] + ["\n".join(f"l{k % 90}" for k in range(300))] * 3


def test_lines_equal_brute_force(docs):
    frame = docs(LINES).withColumnRenamed("n_chars", "pos").withColumnRenamed("source", "id")
    rows = list(enumerate(LINES))
    for min_docs, min_chars, keep_first in ((3, 1, False), (3, 0, True), (2, 4, True), (1, 1, False)):
        bitmaps = lines.dropped_bitmaps(frame, min_docs=min_docs, min_chars=min_chars, keep_first=keep_first)
        kept = lines.without_lines(frame, bitmaps, counts=True).collect()
        assert {r.doc_id: r.text or "" for r in kept} == brute_lines(rows, min_docs, min_chars, keep_first)
        assert all(r.n_lines == len((LINES[r.doc_id] or "").split("\n")) for r in kept)
        assert len(kept) == len(LINES)


def test_lines_repeated_rows_count_once(docs):
    frame = docs(["a\nb"] * 5 + ["a"], [1] * 5 + [2])
    kept = lines.without_lines(frame, lines.dropped_bitmaps(frame, min_docs=3)).collect()
    assert sorted(r.text for r in kept) == ["a"] + ["a\nb"] * 5
    kept = lines.without_lines(frame, lines.dropped_bitmaps(frame, min_docs=2)).collect()
    assert sorted(r.text for r in kept) == [""] + ["b"] * 5


def test_lines_empty_table(docs):
    frame = docs([])
    assert lines.without_lines(frame, lines.dropped_bitmaps(frame)).collect() == []
