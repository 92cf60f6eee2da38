"""Scalar text functions: cleaning, sentences, viability, priority, predicates, tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions import lexicon as lx
from attestor.functions.dialect import (
    count, every, first, has, is_alpha, is_devanagari, java, let, literal, member, one_of, replace, split_words, starts_upper, strings, strip, tokens, whole,
)

#: Bounds of a claim.
LEAST_CHARS, LEAST_WORDS = 20, 4

NUMERIC = r"(?<!\w)\d+(?:\.\d+)?%?\b"
#: For texts in lower case. Years are numbers already, so they need no alternative of their own.
_FACT_WORDS = lx.MONTHS + lx.MONEY_WORDS + lx.REPORT_VERBS + lx.INSTITUTIONS
FACTUAL = rf"(?<!\w)(?:\d+(?:\.\d+)?%?\b|{one_of(_FACT_WORDS)}(?!\w))|[{lx.CURRENCY}]|{one_of(lx.HINDI_FACTS)}"


def clean(text: Column) -> Column:
    """White space and invisible characters normalised; paragraphs kept."""
    out = F.translate(F.coalesce(text, F.lit("")), " ​﻿‎‏", " ")
    for pattern, by in ((r"[ \t]*\n[ \t]*", "\n"), (r"[ \t]+", " "), (r"\s+([,.;:!?])", "$1"), (r"\n{3,}", "\n\n")):
        out = replace(out, pattern, by)
    return strip(out)


#: The end of a sentence: white space after its last mark, unless that is an abbreviation's point; or a new line.
_END = rf"(?<=[.!?।॥])(?<!(?<!\w){one_of(lx.ABBREVIATIONS + lx.DOTTED_ABBREVIATIONS)}\.)\s+|\n+"


def sentences(text: Column) -> Column:
    """The sentences of a text; points of abbreviations do not end one, nor do those of decimals, which no space follows."""
    parts = F.split(strip(F.coalesce(text, F.lit(""))), java(_END, True))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def after_first(words: Column) -> Column:
    """All entries but the first."""
    return F.slice(words, 2, F.size(words))


def is_long_enough(sentence: Column) -> Column:
    return (F.length(sentence) >= LEAST_CHARS) & (F.size(split_words(sentence)) >= LEAST_WORDS)


def facts(sentence: Column) -> Column:
    """How many numbers, months, amounts, reporting verbs, institutions and currency signs a sentence has."""
    return count(F.lower(sentence), FACTUAL)


def is_checkable(sentence: Column, n_facts: Column) -> Column:
    """No question, and no exclamation or opinion without facts."""
    return (
        ~F.contains(sentence, F.lit("?"))
        & ~F.endswith(sentence, F.lit("؟"))
        & ((n_facts > 0) | (~F.endswith(sentence, F.lit("!")) & ~has(sentence, whole(lx.OPINIONS), True)))
    )


def is_viable(sentence: Column) -> Column:
    """Whether a sentence can be checked."""
    return is_long_enough(sentence) & is_checkable(sentence, facts(sentence))


def priority(sentence: Column, n_facts: Column | None = None) -> Column:
    """Factual density of a sentence."""
    later = after_first(split_words(sentence))
    names = F.size(F.filter(later, lambda w: F.rlike(w, F.lit(r"^\p{Lu}\p{L}*$"))))
    hindi = F.when(
        is_devanagari(sentence),
        F.size(F.filter(later, lambda w: is_devanagari(w) & (F.length(w) >= 3) & ~member(w, lx.HINDI_STOPWORDS))),
    ).otherwise(0)
    n = facts(sentence) if n_facts is None else n_facts
    return 2 * n + F.when((n > 0) & has(sentence, NUMERIC), 3).otherwise(0) + names + F.least(hindi, F.lit(3))


def predicates(sentence: Column) -> Column:
    """The sentence, or its first two coordinated clauses where both have a verb of action."""
    verbs = whole(lx.PREDICATE_VERBS)
    parts = F.transform(F.split(strip(sentence), java(r"\s+(?:and|while|as well as)\s+", True)), strip)
    one, two = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    subject = F.array_join(F.slice(split_words(one), 1, 2), " ")
    bare = has(F.lower(F.get(split_words(two), F.lit(0))), "^" + verbs, True)
    both = (F.size(parts) >= 2) & has(one, verbs, True) & has(two, verbs, True)
    return F.when(strip(sentence) == "", F.array().cast("array<string>")).when(
        both, F.array(one, F.when(bare, F.concat_ws(" ", subject, two)).otherwise(two))
    ).otherwise(F.array(strip(sentence)))


def stem(word: Column) -> Column:
    """A light plural stemmer for words that are not Devanagari."""
    return (
        F.when(is_devanagari(word), word)
        .when(F.endswith(word, F.lit("ies")) & (F.length(word) > 4), F.concat(F.left(word, F.length(word) - 3), F.lit("y")))
        .when(F.endswith(word, F.lit("sses")), F.left(word, F.length(word) - 2))
        .when(F.endswith(word, F.lit("is")) | F.endswith(word, F.lit("us")) | F.endswith(word, F.lit("ss")), word)
        .when(F.endswith(word, F.lit("s")) & (F.length(word) > 3), F.left(word, F.length(word) - 1))
        .otherwise(word)
    )


def substantive(text: Column) -> Column:
    """The distinct tokens that carry meaning, and their stems. Stop words go by array_except, which hashes them."""


    def both(found: Column) -> Column:
        hindi = F.array_except(F.filter(found, lambda w: is_devanagari(w) & (F.length(w) >= 2)), literal(lx.HINDI_STOPWORDS))
        other = F.array_except(F.filter(found, lambda w: ~is_devanagari(w) & (F.length(w) >= 3)), literal(lx.RELEVANCE_STOPWORDS))
        return let(other, lambda o: F.array_distinct(F.concat(hindi, o, stems(o))))

    def stems(words: Column) -> Column:
        return F.array_except(F.filter(F.transform(words, stem), lambda w: F.length(w) >= 3), literal(lx.RELEVANCE_STOPWORDS))

    return let(distinct_words(text), both)


def distinct_words(text: Column) -> Column:
    """The distinct tokens in lower case, in order."""
    return F.array_distinct(tokens(F.lower(text)))


def domain_of(url: Column) -> Column:
    """The host of a URL without port and leading www., empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return replace(F.get(F.split(F.lower(host), ":"), F.lit(0)), r"^www\.", "")


def numbers(text: Column) -> Column:
    """Distinct quantities as array<struct<val, raw>>: the last spelling of a value, at its first place; bare years left out."""
    raws = every(text, lx.NUMBER)
    value = lambda r: F.btrim(r, F.lit("%,$€£₹ ")).cast("double")
    year = lambda r: F.rlike(r, F.lit(r"^\p{Nd}{4}$")) & value(r).between(1900, 2100)
    usable = F.filter(raws, lambda r: value(r).isNotNull() & ~year(r))
    pairs = F.transform(usable, lambda r: F.struct(value(r).alias("val"), r.alias("raw")))
    last = lambda found, v: F.element_at(F.filter(found, lambda p: p["val"] == v), -1)["raw"]
    return let(pairs, lambda found: F.transform(F.array_distinct(found["val"]), lambda v: F.struct(v.alias("val"), last(found, v).alias("raw"))))


def dates(text: Column) -> Column:
    """Years and names of months, sorted."""
    years = every(text, r"\b(?:19\d\d|20\d\d)\b")
    months = F.transform(every(text, whole(lx.MONTHS), 0, True), F.lower)
    return F.array_sort(F.array_distinct(F.concat(years, months)))


def is_negated(text: Column) -> Column:
    return has(text, whole(lx.NEGATIONS, " "), True) | has(text, whole(lx.HINDI_NEGATIONS))


ATTRIBUTION = r"\b(?:according to|alleged|claimed|stated|said|reported by|spokesperson said|official said|police said|leaders alleged|minister stated|sources said|cited as saying)\b"


def attribution(text: Column) -> Column:
    """The first phrase that marks a statement as somebody's, in lower case."""
    return F.lower(first(text, ATTRIBUTION, 0, True))


def directions(text: Column) -> Column:
    """The directions of change or action that a text's words stand for, sorted."""
    return let(distinct_words(text), _directions)


def _directions(found: Column) -> Column:
    kinds = [F.when(F.arrays_overlap(found, literal(words)), F.lit(kind)) for kind, words in sorted(lx.DIRECTIONS.items())]
    return F.filter(F.array(*kinds), lambda d: d.isNotNull())


ACTION_WORDS = sorted({w for words in lx.DIRECTIONS.values() for w in words})


def actions(text: Column) -> Column:
    """Action words of a text: known verbs, words in -ed and -ing, Hindi actions anywhere; sorted."""
    return let(distinct_words(text), lambda words: _actions(words, text))


def hindi_actions(text: Column) -> Column:
    """Hindi actions that stand anywhere in a text."""
    return let(F.lower(text), lambda low: F.filter(literal(lx.HINDI_ACTIONS), lambda h: F.contains(low, h)))


def _actions(words: Column, text: Column) -> Column:
    known = F.array_intersect(words, literal(ACTION_WORDS))
    formed = F.array_except(F.filter(words, lambda w: (F.length(w) >= 4) & F.rlike(w, F.lit("(?:ed|ing)$"))), literal(lx.QUERY_STOPWORDS))
    return F.array_sort(F.array_distinct(F.concat(known, formed, hindi_actions(text))))


_HINDI = re.compile("[\u0900-\u097f]")
_SUBJECT_STOPS = [w for w in {*lx.QUERY_STOPWORDS, *ACTION_WORDS} if not _HINDI.search(w)]


def subjects(text: Column) -> Column:
    """Words of a text that can name what it is about, sorted."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([\x{0900}-\x{097F}\p{L}\p{N}_\-]{2,})"), F.lit(1)), F.lower)
    named = F.filter(F.array_distinct(found), lambda w: ~F.rlike(w, F.lit(r"^\p{N}+$")) & (is_devanagari(w) | (F.length(w) >= 3)))
    # stop words and verbs of either script leave words of the other alone; Hindi verbs stand in both lists
    return F.array_sort(F.array_except(named, literal(sorted({*lx.HINDI_STOPWORDS, *lx.HINDI_ACTIONS, *_SUBJECT_STOPS}))))


def representation(text: Column) -> Column:
    """What stance compares: a struct of directions, actions, subjects, numbers, dates, negated, attribution."""
    return let(distinct_words(text), lambda words: F.struct(
        _directions(words).alias("directions"), _actions(words, text).alias("actions"), subjects(text).alias("subjects"), numbers(text).alias("numbers"),
        dates(text).alias("dates"), is_negated(text).alias("negated"), attribution(text).alias("attribution"),
    ))


def importance(text: Column) -> Column:
    """HIGH, MEDIUM or LOW by factual density."""
    metrics = has(text, r"\b\d+(?:\.\d+)?%\b") | has(text, f"[{lx.CURRENCY}]")
    figures = has(text, r"\b\d{2,}\b")
    official, general = has(text, whole(lx.OFFICIAL_ACTIONS), True), has(text, whole(lx.GENERAL_ACTIONS), True)
    dated = has(text, rf"\b(?:19\d\d|20\d\d|{one_of(lx.MONTHS)})\b", True)
    names = F.size(F.filter(after_first(split_words(text)), lambda w: starts_upper(w) & is_alpha(w)))
    measured = metrics | figures
    return (
        F.when(measured & official, "HIGH")
        .when(official | (measured & general) | dated | (names >= 2), "MEDIUM")
        .otherwise("LOW")
    )
