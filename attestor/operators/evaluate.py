"""Source evaluation: relevance, provenance, independence, quality and strength of every piece of evidence.

Evidence rows carry the keys of their claim; independence is decided by windows over all rows of a claim,
irrelevant ones too, in the order ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import provenance as pv
from attestor.functions.dialect import strip
from attestor.functions.relevance import assess, claim_side

KEYS = ["doc_id", "claim_id"]


def independence(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``df`` (title, snippet or _facts, domain, evidence_id, pos) with is_wire, agency, duplicate_wire, duplicate_domain, first_of.

    The first wire row of an agency and the first row of a publisher count; later ones repeat them.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = df.withColumns({
        "agency": F.col("_facts.agency") if "_facts" in df.columns else pv.wire_agency(text("title"), text("snippet")),
        "_site": F.lower(strip(text("domain"))),
    }).withColumn("is_wire", F.col("agency").isNotNull() & ~F.col("_site").isin(*pv.lx.AGENCY_SITES))
    by_agency = Window.partitionBy(*keys, "_feed").orderBy("pos")
    by_site = Window.partitionBy(*keys, "_site").orderBy("pos")
    rows = rows.withColumn("_feed", F.when(F.col("is_wire"), F.col("agency")))
    rows = rows.withColumns({
        "duplicate_wire": F.col("is_wire") & (F.row_number().over(by_agency) > 1), "_first_feed": F.first("evidence_id").over(by_agency),
        "_nth": F.row_number().over(by_site), "_first_site": F.first("evidence_id").over(by_site),
    })
    rows = rows.withColumn("duplicate_domain", (F.col("_site") != "") & (F.col("_nth") > 1) & ~F.col("duplicate_wire"))
    first_of = F.when(F.col("duplicate_wire"), F.col("_first_feed")).when(F.col("duplicate_domain"), F.col("_first_site"))
    return rows.withColumn("first_of", first_of).select(*df.columns, "agency", "is_wire", "duplicate_wire", "duplicate_domain", "first_of")


def _reasons(primary: Column, kind: Column, level: Column) -> Column:
    """Why a source ranks as it does, as short sentences."""
    say = lambda when, text: F.when(when, F.lit(text))
    c = F.col
    reasons = F.array(
        F.when(primary, "Primary source.").when(kind == "FACTUAL_REPORTING", "Established news reporting.")
        .when(kind == "OPINION_EDITORIAL", "Opinion: little weight for facts.").when(kind == "SENSATIONAL_CLICKBAIT", "Sensational framing."),
        say(c("has_quotes"), "Quotes directly."), say(c("has_named"), "Names its sources."), say(c("has_metrics"), "Gives figures, times or statutes."),
        F.when(c("has_date"), "Dated.").otherwise("Undated."),
        F.when(c("duplicate_wire"), F.concat(F.lit("Repeats the feed of "), c("agency"), F.lit("."))).when(c("duplicate_domain"), "Same publisher as another source.")
        .otherwise("Independent."),
        F.when(level == "DIRECT", "Addresses the claim directly.").when(level == "PARTIAL", "Touches the claim in part.").otherwise("Touches the claim barely or not."),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


def facts(df: DataFrame) -> dict[str, Column]:
    """What evaluation needs of a source's texts (title, url, snippet), by name."""
    if "_facts" in df.columns:
        return {name: F.col(f"_facts.{name}") for name in ("opinion_reason", "is_clickbait", "has_quotes", "named_sources", "has_metrics")}
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    title, snippet, both = text("title"), text("snippet"), F.concat_ws(" ", text("title"), text("snippet"))
    return {
        "opinion_reason": pv.opinion_reason(title, text("url"), snippet), "is_clickbait": pv.is_clickbait(title), "has_quotes": pv.has_quotes(both),
        "named_sources": pv.named_sources(title, snippet), "has_metrics": pv.has_metrics(both),
    }


def evaluate(evidence: DataFrame, keys: list[str] = KEYS, relevance: bool = True) -> DataFrame:
    """``evidence`` (keys, claim_text, parts, evidence_id, pos, title, url, domain, snippet, publication_date) evaluated.

    With ``relevance`` False the rows bring a struct ``relevance`` (level, reason) of their own, and may have a struct ``_facts`` for their texts.
    """
    rows = evidence if "_claim" in evidence.columns or not relevance else claim_side(evidence)
    rows = assess(rows) if relevance else rows
    rows = independence(rows, keys)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = rows.withColumns({
        "provenance": pv.category(text("domain")), "has_date": text("publication_date") != "", **facts(rows),
        "year_gap": pv.year_gap(F.col("publication_date"), F.col("claim_text")),
    })
    opinion, bait = F.col("opinion_reason").isNotNull(), F.col("is_clickbait")
    kind = (
        F.when(bait, "SENSATIONAL_CLICKBAIT").when(opinion, "OPINION_EDITORIAL").when(F.col("is_wire"), "SYNDICATED_WIRE").otherwise(F.col("provenance"))
    )
    rows = rows.withColumns({
        "is_opinion": opinion, "category": kind, "has_named": F.size("named_sources") > 0, "level": F.col("relevance.level"),
        "_primary": F.col("provenance").isin("PRIMARY_OFFICIAL", "ACADEMIC_RESEARCH"),
        "_independent": ~F.col("duplicate_wire") & ~F.col("duplicate_domain"),
    })
    rows = rows.withColumn("_quality", pv.quality(F.col("category"), F.col("has_date"), F.col("has_quotes"), bait, F.col("duplicate_wire"), F.col("has_named"), F.col("has_metrics")))
    rows = rows.withColumns({
        "_strength": pv.strength(F.col("_quality"), F.col("_independent"), F.col("is_opinion"), bait, F.col("_primary"), F.col("level")),
        "is_relevant": F.col("level") != "IRRELEVANT",
    })
    relevant = F.col("is_relevant")
    demoted = (
        F.when(~relevant, F.concat(F.lit("IRRELEVANT: "), F.col("relevance.reason"))).when(F.col("is_opinion"), "OPINION").when(bait, "CLICKBAIT")
        .when(F.col("duplicate_wire"), "DUPLICATE_WIRE").when(F.col("duplicate_domain"), "DUPLICATE_PUBLISHER")
    )
    status = F.when(F.col("duplicate_wire"), "DUPLICATE_WIRE").when(F.col("is_wire"), "SYNDICATED").when(F.col("_independent"), "INDEPENDENT").otherwise("UNKNOWN")
    rows = rows.withColumns({
        "ranking_reasons": _reasons(F.col("_primary"), F.col("category"), F.col("level")),
        "quality_score": F.when(relevant, F.col("_quality")).otherwise(F.greatest(F.lit(5), F.least(F.col("_quality"), F.lit(20)))),
        "is_primary": relevant & F.col("_primary"), "is_independent": relevant & F.col("_independent"), "independence_status": status,
        "evidence_strength": F.when(relevant, F.col("_strength")).otherwise("INSUFFICIENT"), "demotion_reason": demoted,
    })
    return rows.drop("_quality", "_strength", "_primary", "_independent", "_claim", "_facts")


def summarise(evaluated: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per claim: counts over relevant rows, distinct domains over all, and whether the evidence suffices."""
    on = lambda cond: F.count_if(F.col("is_relevant") & cond)
    out = evaluated.groupBy(*keys).agg(
        on(F.lit(True)).alias("relevant_count"), on(F.col("is_primary")).alias("primary_count"),
        on(F.col("is_independent") & ~F.col("is_opinion")).alias("independent_count"), on(F.col("is_opinion")).alias("opinion_count"),
        on(~F.col("is_independent")).alias("duplicate_wire_count"), on(F.col("is_wire")).alias("syndicated_count"),
        F.count_if(~F.col("is_relevant")).alias("filtered_count"),
        F.array_sort(F.collect_set(F.nullif(F.col("domain"), F.lit("")))).alias("unique_domains"),
    )
    enough = (F.col("primary_count") >= 1) | (F.col("independent_count") >= 2)
    note = F.when(enough, "SUFFICIENT").when(F.col("relevant_count") > 0, "INSUFFICIENT").when(F.col("filtered_count") > 0, "ALL_FILTERED").otherwise("NO_EVIDENCE")
    return out.withColumns({"unique_domain_count": F.size("unique_domains"), "has_sufficient": enough, "assessment": note})
