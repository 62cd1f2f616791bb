"""Text column expressions. Each takes and returns a ``Column`` and stays inside codegen."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as a browser's \s understands it; the class works in Java and in RE2.
SPACE = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

#: Characters that normalised texts hold as blanks: those of ``SPACE``, and hyphen, underscore, slash.
_BLANKS = "-_/\t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def _accent_table() -> tuple[str, str]:
    """Accented letter -> base letter for every code point whose NFD form is base + marks."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        decomposed = unicodedata.normalize("NFD", chr(code))
        base = "".join(c for c in decomposed if not 0x300 <= ord(c) <= 0x36F)
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    # letters without a partner are dropped by translate(): bare combining marks
    source.extend(chr(c) for c in range(0x300, 0x370))
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(col: Column) -> Column:
    """NFD + removal of combining marks; the table is only consulted for non-ASCII text."""
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.translate(col, _ACCENTED, _PLAIN)).otherwise(col)


def norm(col: Column) -> Column:
    """Lower case, no diacritics, hyphen/underscore/slash as space, single spaces, trimmed."""
    plain = F.translate(strip_accents(F.lower(F.coalesce(col, F.lit("")))), _BLANKS, " " * len(_BLANKS))
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def words(col: Column, min_len: int = 1) -> Column:
    """Space-separated words of an already normalised text."""
    return F.filter(F.split(col, " "), lambda w: F.length(w) >= min_len)


def contains_any(col: Column, needles: list[str]) -> Column:
    """True when any of a literal, driver-side list occurs as a raw substring."""
    if not needles:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(n)) for n in needles])


def contains_all(col: Column, needles: list[str]) -> Column:
    if not needles:
        return F.lit(True)
    return reduce(lambda a, b: a & b, [F.contains(col, F.lit(n)) for n in needles])


def word_bounded_at_first(hay: Column, needle: Column) -> Column:
    """Needle occurs in hay and its *first* occurrence sits between spaces or text ends."""
    at = F.instr(hay, needle)
    after = at + F.length(needle)
    left = (at == 1) | (hay.substr(at - 1, F.lit(1)) == " ")
    right = (after == F.length(hay) + 1) | (hay.substr(after, F.lit(1)) == " ")
    return (at > 0) & left & right


def replace_chain(col: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered regular-expression rewrites from a literal rule list."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, col)


def js_round(col: Column) -> Column:
    return F.floor(col + F.lit(0.5)).cast("long")


def truncate(col: Column, limit: int) -> Column:
    """Text cut to ``limit`` characters including a closing ellipsis; null becomes ''."""
    text = F.coalesce(col, F.lit(""))
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    )


def slugify(col: Column) -> Column:
    s = F.lower(col)
    for old, new in [("w/o", "wo"), ("w/", "w"), ("/", ""), ("&", "and")]:
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.regexp_replace(s, "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(F.translate(s, " ", "-"), "-+", "-"), F.lit("-"))


# Title-cased acronym -> written form.
ACRONYMS = [
    ("Mri", "MRI"), ("Mr", "MR"), ("Ct", "CT"), ("Mrcp", "MRCP"), ("Mra", "MRA"), ("Pet", "PET"),
    ("Stir", "STIR"), ("Flair", "FLAIR"), ("Dwi", "DWI"), ("Swi", "SWI"), ("Dce", "DCE"), ("Dti", "DTI"),
]


def title_case(col: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others."""
    runs = F.regexp_extract_all(F.lower(col), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30))), ""
    )


def display_name(col: Column, acronyms: list[tuple[str, str]] = ACRONYMS) -> Column:
    """Expand W/WO, W/O and W/, title-case, then restore acronyms."""
    s = replace_chain(
        col,
        [(r"(?i)\bW/WO\b", "With and Without"), (r"(?i)\bW/O\b", "Without"), (r"(?i)\bW/(?!O)", "With")],
    )
    return replace_chain(title_case(s), [(rf"\b{a}\b", b) for a, b in acronyms])


def display_with_short(name: Column, short: Column) -> Column:
    """Display name, with the short name in parentheses when the long one lacks it."""
    missing = ~F.contains(F.lower(name), F.lower(short))
    base = display_name(name)
    return F.when(missing, F.concat(base, F.lit(" ("), display_name(short), F.lit(")"))).otherwise(base)


def word_title(col: Column) -> Column:
    """First letter of each whitespace-separated word upper, the rest lower, single spaces."""
    return F.array_join(
        F.transform(
            F.split(col, SPACE + "+"),
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))),
        ),
        " ",
    )


def strip_tags(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), "<[^>]+>", ""))


def escape_html(col: Column) -> Column:
    s = F.coalesce(col, F.lit(""))
    for old, new in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def highlight(col: Column, term: Column, open_tag: str = "<mark>", close_tag: str = "</mark>") -> Column:
    """Wrap every case-insensitive occurrence of ``term`` (taken literally) in tags."""
    quoted = F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    pattern = F.concat(F.lit("(?i)("), quoted, F.lit(")"))
    marked = F.regexp_replace(col, pattern, F.lit(f"{open_tag}$1{close_tag}"))
    return F.when(F.length(term) == 0, col).otherwise(marked)


def cache_key(col: Column) -> Column:
    return F.substring(F.md5(col), 1, 16)


def minutes_text(seconds: Column) -> Column:
    mins = js_round(seconds / F.lit(60.0))
    return (
        F.when(seconds == 0, F.lit("0 min"))
        .when(mins < 1, F.lit("<1 min"))
        .otherwise(F.concat(mins.cast("string"), F.lit(" min")))
    )


def range_text(low: Column, high: Column) -> Column:
    return F.concat(
        js_round(low / F.lit(60.0)).cast("string"),
        F.lit("-"),
        js_round(high / F.lit(60.0)).cast("string"),
        F.lit(" min"),
    )


# Words the key-term extraction drops.
STOP_WORDS = [
    "the", "a", "an", "for", "with", "without", "of", "in", "on", "to", "and", "or", "is", "are", "was", "were",
    "concern", "possible", "suspected", "rule", "out", "evaluate",
]


def key_terms(col: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Stop-word-free words longer than two characters; a hyphen compound wins when present.

    Characters that stay are skipped in runs, the words are listed once, and only texts with a hyphen are searched for a compound."""
    cleaned = F.regexp_replace(F.lower(col), r"\G([\w\s\-]*+)[^\w\s\-]+", "$1")
    kept = F.filter(
        F.split(cleaned, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(stop_words)
    )
    # a match begins where a run of word characters does
    compound = F.when(F.contains(col, F.lit("-")), F.regexp_extract(col, r"(?<!\w)(\w+-\w+)", 1)).otherwise("")
    return F.nullif(F.when(compound != "", F.when(F.size(kept) > 0, compound)).otherwise(F.array_join(kept, " ")), F.lit(""))


def list_items(col: Column, limit: int = 3) -> Column:
    """Leading items of a numbered list, else of a bullet list; items of 3 to 99 characters."""

    def items(pattern: str, lead: str) -> Column:
        found = F.slice(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)), 1, limit)
        cleaned = F.transform(
            found, lambda m: F.trim(F.regexp_replace(F.regexp_replace(m, lead, ""), r"\*?\*?$", ""))
        )
        return F.filter(cleaned, lambda m: (F.length(m) > 2) & (F.length(m) < 100))

    numbered = items(r"[0-9]+\.\s*\*?\*?([^:\n]+)", r"^[0-9]+\.\s*\*?\*?")
    bullets = items(r"[-*]\s*\*?\*?([^:\n]+)", r"^[-*]\s*\*?\*?")
    return F.when(F.size(numbered) > 0, numbered).otherwise(bullets)


def lead_sentences(col: Column, sentences: int = 2, limit: int = 250) -> Column:
    """Markdown-free opening sentences, cut with an ellipsis."""
    plain = replace_chain(col, [(r"#{1,6}\s*", ""), (r"\*\*", ""), (r"\*", ""), (r"\n+", " ")])
    plain = F.trim(plain)
    found = F.regexp_extract_all(plain, F.lit(r"([^.!?]+[.!?]+)"), F.lit(1))
    lead = F.when(F.size(found) > 0, F.trim(F.array_join(F.slice(found, 1, sentences), " "))).otherwise(plain)
    return truncate(lead, limit)


def embedded_json(col: Column) -> Column:
    """Widest {...} span of a reply, '' when there is none."""
    return F.regexp_extract(col, r"(?s)(\{.*\})", 1)


def canonical_name(col: Column, wordings: list[tuple[str, str]], parts: list[tuple[str, str]]) -> Column:
    """Registry form of a name: lower case, contrast ``wordings`` as marks, body ``parts`` by whole words, single blanks.

    Pairs apply in their order, each to what the ones before it left."""
    low = replace_chain(F.lower(F.trim(col)), wordings)
    return F.regexp_replace(replace_chain(low, [(rf"\b{name}\b", mark) for name, mark in parts]), r"\s+", " ")
