"""Regular expressions with Unicode words, spaces and digits, for Java's engine.

Patterns in this package are written with \\b, \\w, \\s and \\d in their Unicode sense, where a word
character is a letter, number or underscore but not a combining mark (so a Devanagari word that ends in
a vowel sign has no word boundary before a space). java() spells that out for Spark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
#: A token: word characters and anything Devanagari.
TOKEN = r"[\x{0900}-\x{097F}\p{L}\p{N}_]+"
DEVANAGARI = r"[\x{0900}-\x{097F}]"


def java(pattern: str, ignore_case: bool = False) -> str:
    """A pattern with Unicode escapes as Java's engine wants it."""
    for short, long in ((r"\b", EDGE), (r"\w", WORD), (r"\s", SPACE), (r"\d", r"\p{Nd}")):
        pattern = pattern.replace(short, long)
    return ("(?iu)" if ignore_case else "") + pattern


def words_of(text: str) -> list[str]:
    """The entries of a list written as text: separated by spaces, or by | where entries hold spaces."""
    parts = text.split("|") if "|" in text else text.split()
    return [p.strip() for p in parts if p.strip()]


def one_of(words: list[str] | str, gap: str = r"\s+") -> str:
    """An alternation; a space in an entry stands for ``gap``."""
    entries = words_of(words) if isinstance(words, str) else words
    return "(?:" + "|".join(w.replace(".", r"\.").replace(" ", gap) for w in entries) + ")"


def whole(words: list[str] | str, gap: str = r"\s+") -> str:
    """Any of the entries as whole words; plain look-arounds where every entry starts and ends in ASCII."""
    entries = words_of(words) if isinstance(words, str) else words
    if all(w[0].isascii() and w[-1].isascii() and w[0].isalnum() and w[-1].isalnum() for w in entries):
        return rf"(?<!\w){one_of(entries, gap)}(?!\w)"
    return rf"\b{one_of(entries, gap)}\b"


def has(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.rlike(text, F.lit(java(pattern, ignore_case)))


def count(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.regexp_count(text, F.lit(java(pattern, ignore_case)))


def first(text: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    """The first match's group, null without a match or with an empty group."""
    return F.nullif(F.regexp_extract(text, java(pattern, ignore_case), group), F.lit(""))


def every(text: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern, ignore_case)), F.lit(group))


def replace(text: Column, pattern: str, by: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(text, java(pattern, ignore_case), by)


def strip(text: Column) -> Column:
    return replace(text, r"^\s+|\s+$", "")


def split_words(text: Column) -> Column:
    """The parts between white space."""
    return F.filter(F.split(text, java(r"\s+")), lambda w: w != "")


def tokens(text: Column) -> Column:
    """All tokens, in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def is_devanagari(word: Column) -> Column:
    return F.rlike(word, F.lit(DEVANAGARI))


def is_upper(word: Column) -> Column:
    return (F.upper(word) == word) & (F.lower(word) != word)


def starts_upper(word: Column) -> Column:
    return is_upper(F.substring(word, 1, 1))


def is_alpha(word: Column) -> Column:
    return F.rlike(word, F.lit(r"^\p{L}+$"))


def member(word: Column, words: list[str]) -> Column:
    return F.array_contains(F.array(*[F.lit(w) for w in words]), word)


def literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once, whatever loops and repeats the body has."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(text: Column, parts: list[str]) -> Column:
    """Whether any of the parts stands somewhere in the text."""
    return let(text, lambda t: F.exists(literal(parts), lambda p: F.contains(t, p)))


def strings(column: Column) -> Column:
    return column.cast("array<string>")
