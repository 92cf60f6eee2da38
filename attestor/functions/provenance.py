"""What kind of source a result is: registries, opinion, wire copy, clickbait, quotes, figures, quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions import lexicon as lx
from attestor.functions.dialect import count, every, has, literal, split_words, strip, whole


def suffixes(domain: Column) -> Column:
    """A domain and all its parents, so that a suffix test is an equality."""
    parts = F.split(F.lower(strip(domain)), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _under(domain: Column, registry: list[str]) -> Column:
    return F.arrays_overlap(suffixes(domain), literal(registry))


def tier(domain: Column) -> Column:
    """The priority of a publisher for news."""
    return (
        F.when(_under(domain, lx.GOVERNMENT), "Government / Official")
        .when(_under(domain, lx.INSTITUTIONAL), "Institutional / Regulatory")
        .when(_under(domain, lx.NEWS), "Reputable News")
        .otherwise("General")
    )


def category(domain: Column) -> Column:
    """Where a source comes from, by its domain alone."""
    return (
        F.when(_under(domain, lx.GOVERNMENT + lx.INSTITUTIONAL), "PRIMARY_OFFICIAL")
        .when(_under(domain, lx.ACADEMIC), "ACADEMIC_RESEARCH")
        .when(_under(domain, lx.NEWS), "FACTUAL_REPORTING")
        .otherwise("GENERAL_WEB")
    )


def opinion_reason(title: Column, url: Column, snippet: Column) -> Column:
    """URL, TITLE or SNIPPET where one of them marks an opinion, else null."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return (
        F.when(has(path, lx.OPINION_PATH, True), "URL").when(has(title, lx.OPINION_TITLE, True), "TITLE").when(has(snippet, lx.OPINION_TITLE, True), "SNIPPET")
    )


def wire_agency(title: Column, snippet: Column) -> Column:
    """The first news agency that the text names as its source."""
    both = F.concat_ws(" ", title, snippet)
    return F.coalesce(*[F.when(has(both, pattern, True), agency) for agency, pattern in lx.WIRES])


def is_wire(title: Column, snippet: Column, domain: Column) -> Column:
    """Whether a text is an agency's, published elsewhere."""
    return wire_agency(title, snippet).isNotNull() & ~F.lower(strip(domain)).isin(*lx.AGENCY_SITES)


def is_clickbait(title: Column) -> Column:
    shouts = count(title, whole(lx.SHOUTS, " "))
    return has(title, r"[!?]{2,}") | (shouts >= 2) | ((shouts == 1) & (F.size(split_words(title)) <= 6)) | has(title, lx.BAIT, True)


def named_sources(title: Column, snippet: Column) -> Column:
    """People and offices quoted, in order of the patterns."""
    both = F.concat(title, F.lit(". "), snippet)
    found = F.concat(*[every(both, pattern, group, fold) for pattern, group, fold in lx.NAMED_SOURCES])
    return F.array_distinct(F.filter(F.transform(found, strip), lambda s: s != ""))


def has_quotes(text: Column) -> Column:
    return has(text, lx.QUOTE) | F.contains(F.lower(text), F.lit("according to"))


def has_metrics(text: Column) -> Column:
    return has(text, lx.NUMBER) | has(text, lx.CLOCK, True) | has(text, lx.LEGAL, True)


def year_gap(published: Column, claim: Column) -> Column:
    """Years between a publication date and the first year that a claim names; null where either has none."""
    year = lambda c: F.nullif(F.regexp_extract(c, r"(?<![\p{L}\p{N}_])(19\d\d|20\d\d)(?![\p{L}\p{N}_])", 1), F.lit("")).cast("int")
    return F.abs(year(published) - year(claim))


def quality(kind: Column, dated: Column, quotes: Column, clickbait: Column, duplicate: Column, named: Column, metrics: Column) -> Column:
    """A source's quality from 5 to 100."""
    base = F.create_map(*[F.lit(x) for kv in lx.QUALITY.items() for x in kv])[kind]
    serious = ~kind.isin("OPINION_EDITORIAL", "SENSATIONAL_CLICKBAIT")
    points = lambda when, n: F.when(when, n).otherwise(0)
    score = (
        base + F.when(dated, 5).otherwise(-5) + points(quotes & serious, 5) + points(named & serious, 5) + points(metrics, 3)
        - points(clickbait, 25) - points(duplicate, 20)
    )
    return F.greatest(F.lit(5), F.least(F.lit(100), score))


def strength(score: Column, independent: Column, opinion: Column, clickbait: Column, primary: Column, level: Column) -> Column:
    """How much a source can prove."""
    return (
        F.when(level == "IRRELEVANT", "INSUFFICIENT")
        .when((level == "WEAK") | opinion | clickbait | (score < 40), "WEAK")
        .when(~independent, F.when(score >= 60, "MODERATE").otherwise("WEAK"))
        .when((level == "DIRECT") & (primary | (score >= 70)), "STRONG")
        .when(score >= 50, "MODERATE")
        .otherwise("WEAK")
    )
