"""Rule tables as column expressions.

Rules are literal, driver-side lists, so they compile to ``when`` ladders: no join, no shuffle, and
"first match wins" follows the list order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_all, contains_any

# \b as a border of [A-Za-z0-9_], whatever the regex engine thinks of accented letters
BORDER = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_borders(pattern: str) -> str:
    return pattern.replace(r"\b", BORDER)


def matches(col: Column, pattern: str) -> Column:
    return col.rlike(ascii_borders(pattern))


def word_pattern(phrase: str) -> str:
    """Pattern of a literal phrase between ASCII word borders."""
    quoted = "".join("\\" + c if c in r".*+?^${}()|[]\/-" else c for c in phrase)
    return f"{BORDER}{quoted}{BORDER}"


def has_word(col: Column, phrase: str) -> Column:
    return col.rlike(word_pattern(phrase))


@dataclass(frozen=True)
class Rule:
    """A label with substring and pattern conditions over one text, and flags of the row."""

    label: str
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    regex: str | None = None
    flags: tuple[str, ...] = field(default_factory=tuple)

    def condition(self, text: Column) -> Column:
        parts = [contains_all(text, list(self.all_of)), ~contains_any(text, list(self.none_of))]
        if self.any_of:
            parts.append(contains_any(text, list(self.any_of)))
        if self.regex:
            parts.append(matches(text, self.regex))
        parts.extend(F.col(f) for f in self.flags)
        return reduce(lambda a, b: a & b, parts)


def first_label(text: Column, rules: list[Rule], default: str | None = None) -> Column:
    ladder = F.when(F.lit(False), F.lit(None).cast("string"))
    for r in rules:
        ladder = ladder.when(r.condition(text), F.lit(r.label))
    return ladder.otherwise(F.lit(default).cast("string"))


def all_labels(text: Column, rules: list[Rule]) -> Column:
    return F.array_compact(F.array(*[F.when(r.condition(text), F.lit(r.label)) for r in rules]))


def pattern_count(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [matches(text, p).cast("int") for p in patterns])


def best_class(text: Column, classes: list[tuple[str, list[str]]], default: str) -> Column:
    """Class with the most matching patterns; the earlier class wins a tie."""
    scored = [(name, pattern_count(text, patterns)) for name, patterns in classes]
    top = F.greatest(*[c for _, c in scored]) if len(scored) > 1 else scored[0][1]
    ladder = F.when(top == 0, F.lit(default))
    for name, c in scored:
        ladder = ladder.when(c == top, F.lit(name))
    return ladder


def context_map(text: Column, contexts: list[tuple[str, list[tuple[str, str]]]]) -> Column:
    """category -> first matching value; categories without a match are absent."""
    entries = []
    for category, values in contexts:
        value = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, pattern in values:
            value = value.when(matches(text, pattern), F.lit(name))
        entries.append(F.struct(F.lit(category).alias("key"), value.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def first_alias(col: Column, table: list[tuple[str, str]], default: Column | None = None) -> Column:
    """Literal look-up of a key; unknown keys stay as they are or take ``default``."""
    ladder = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, value in table:
        ladder = ladder.when(col == key, F.lit(value))
    return ladder.otherwise(col if default is None else default)
