"""Stance of evidence towards a claim, verdicts of claims, and article reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import lexicon as lx
from attestor.functions import text as tx
from attestor.functions.dialect import contains_any, literal, strip

KEYS = ["doc_id", "claim_id"]


def _years(dates: Column) -> Column:
    return F.filter(dates, lambda d: F.rlike(d, F.lit(r"^\p{Nd}+$")))


def claim_representation(claims: DataFrame, text_col: str = "claim_text") -> DataFrame:
    """``claims`` with the representation that stance compares, computed once per claim."""
    return claims.withColumn("_c", tx.representation(F.col(text_col)))


def source_text() -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("snippet", F.lit("")))


def is_refuted(text: Column) -> Column:
    return contains_any(F.lower(text), lx.REFUTATIONS)


#: All words of the groups.
GROUPED = sorted({w for g in lx.STANCE_GROUPS for w in g})


def compare(rows: DataFrame) -> DataFrame:
    """``rows`` (_c and _e, the representations of claim and source; _subjects and _actions, which both have; _refuted) with how they agree: column _compared.

    Of the source's own actions only those in GROUPED count here, of its subjects none.
    """
    rows = rows.withColumn("_dirs", F.array_sort(F.array_intersect("_c.directions", "_e.directions")))
    c, e = F.col("_c"), F.col("_e")
    synonyms = F.lit(False)
    for group in lx.STANCE_GROUPS:
        synonyms = synonyms | (F.arrays_overlap(c["actions"], literal(group)) & F.arrays_overlap(e["actions"], literal(group)))
    same_act, same_dir, subjects = F.size("_actions") > 0, F.size("_dirs") > 0, F.size("_subjects")
    polarity = (c["negated"] != e["negated"]) & (same_act | same_dir | synonyms | (subjects >= 2))
    against = F.create_map(*[x for k, v in lx.OPPOSITES.items() for x in (F.lit(k), literal(v))])
    none = F.array().cast("array<string>")
    opposite = F.filter(c["directions"], lambda d: F.arrays_overlap(F.coalesce(against[d], none), e["directions"]))
    context = same_act | same_dir | (subjects >= 2) | F.arrays_overlap(F.col("_subjects"), literal(lx.METRIC_TOPICS))
    per_cent = lambda raw: F.contains(raw, F.lit("%"))
    equal = lambda n: F.exists(e["numbers"], lambda m: m["val"] == n["val"])

    def rivals(n: Column) -> Column:
        far = lambda m: F.abs(m["val"] - n["val"])
        other = F.filter(e["numbers"], lambda m: F.when(per_cent(n["raw"]), per_cent(m["raw"]) & (far(m) > 0.001)).otherwise(~per_cent(m["raw"]) & (far(m) >= 1.0)))
        return F.transform(other, lambda m: m["raw"])

    clashes = F.filter(c["numbers"], lambda n: ~equal(n) & context & (F.size(rivals(n)) > 0))
    agreed = F.filter(c["numbers"], equal)
    years_c, years_e = _years(c["dates"]), _years(e["dates"])
    other_year = (F.size(years_c) > 0) & (F.size(years_e) > 0) & ~F.arrays_overlap(years_c, years_e)
    rows = rows.withColumns({"_polarity": polarity, "_opposite": opposite, "_clashes": clashes, "_agreed": agreed, "_other_year": other_year})
    rows = rows.withColumn("_conflicts", F.filter(F.array(
        F.when(F.col("_refuted"), "REFUTATION"), F.when(F.col("_polarity"), "POLARITY"),
        F.when(F.size("_opposite") > 0, F.concat(F.lit("DIRECTION:"), F.get("_opposite", F.lit(0)))),
        F.when(F.size("_clashes") > 0, F.concat(F.lit("NUMBER:"), F.array_join(F.transform("_clashes", lambda n: n["raw"]), ","))),
    ), lambda x: x.isNotNull()))
    rows = rows.withColumn("_agreements", F.filter(F.array(
        F.when(same_dir, F.concat(F.lit("DIRECTION:"), F.array_join("_dirs", ","))),
        F.when(F.size("_agreed") > 0, F.concat(F.lit("NUMBER:"), F.array_join(F.transform("_agreed", lambda n: n["raw"]), ","))),
    ), lambda x: x.isNotNull()))
    satisfied = (F.size(c["numbers"]) == 0) | (F.size("_agreed") > 0)
    predicate = same_act | same_dir
    supports = (F.size("_agreed") > 0) | (same_dir & satisfied & (predicate | (F.size(c["actions"]) == 0)))
    kind = (
        F.when(F.col("_other_year"), "OTHER_YEAR").when(F.size("_conflicts") > 0, "CONFLICT").when(supports, "AGREEMENT")
        .when(same_act & (subjects >= 2) & satisfied, "CORROBORATION").when(~predicate & (F.size(c["actions"]) > 0), "OTHER_ACTION").otherwise("TOPICAL")
    )
    rows = rows.withColumn("_compared", F.struct(
        kind.alias("reason"), F.when(e["attribution"].isNotNull() & c["attribution"].isNull(), e["attribution"]).alias("attributed_to"),
        F.col("_agreements").alias("matched"), F.col("_conflicts").alias("conflicting"),
    ))
    gone = ["_e", "_c", "_subjects", "_actions", "_dirs", "_refuted", "_polarity", "_opposite", "_clashes", "_agreed", "_other_year", "_conflicts", "_agreements"]
    return rows.drop(*gone)


def stance(evaluated: DataFrame) -> DataFrame:
    """``evaluated`` (title and snippet, or _compared for them) with stance, weight, stance_reason, matched_points and conflicting_points.

    Irrelevant and weak sources are neutral with weight 0. A source of another year is neutral; any conflict
    (refutation, polarity, opposite direction, figures) contradicts; agreement on figures or predicate supports.
    """
    open_ = F.col("level").isin("DIRECT", "PARTIAL")
    rows = evaluated
    if "_compared" not in rows.columns:
        rows = rows if "_c" in rows.columns else claim_representation(rows)
        rows = rows.withColumn("_text", source_text()).withColumn("_e", F.when(open_, tx.representation(F.col("_text"))))
        shared = {f"_{name}": F.array_intersect(f"_c.{name}", f"_e.{name}") for name in ("subjects", "actions")}
        rows = compare(rows.withColumns(shared | {"_refuted": is_refuted(F.col("_text"))})).drop("_text")
    none, v = F.array().cast("array<string>"), F.col("_compared")
    reason = F.when(F.col("level") == "IRRELEVANT", "FILTERED").when(F.col("level") == "WEAK", "WEAK").otherwise(v["reason"])
    weight = F.col("quality_score") / F.lit(100.0) * F.when(F.col("is_opinion"), 0.25).otherwise(1.0) * F.when(F.col("is_independent"), 1.0).otherwise(0.5)
    rows = rows.withColumn("stance_reason", reason).withColumns({
        "stance": F.when(F.col("stance_reason") == "CONFLICT", "CONTRADICTS").when(F.col("stance_reason").isin("AGREEMENT", "CORROBORATION"), "SUPPORTS").otherwise("NEUTRAL_IRRELEVANT"),
        "weight": F.when(open_, weight).otherwise(0.0),
        "attributed_to": F.when(open_, v["attributed_to"]),
        "matched_points": F.when(open_, v["matched"]).otherwise(none), "conflicting_points": F.when(open_, v["conflicting"]).otherwise(none),
    })
    return rows.drop("_compared")


def _stream_total(rows: Column) -> tuple[Column, Column]:
    """Streams of independent rows, and the sum over them of the greatest weight, in the order of evidence."""
    own = F.filter(rows, lambda r: r["independent"])
    streams = F.array_distinct(F.transform(own, lambda r: r["stream"]))
    best = lambda s: F.array_max(F.transform(F.filter(own, lambda r: r["stream"] == s), lambda r: r["weight"]))
    return F.size(streams), F.aggregate(streams, F.lit(0.0), lambda a, s: a + best(s))


def verdicts(claims: DataFrame, judged: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per claim (keys, claim_text), with evidence or without: the verdict and the counts behind it.

    ``judged``: rows of stance(); they are taken by quality, the best first, then by ``pos``.
    """
    row = F.struct(
        (-F.col("quality_score")).alias("order"), F.col("pos").alias("pos"), F.col("evidence_id").alias("id"), F.col("stance").alias("stance"), F.col("weight").alias("weight"),
        F.col("level").alias("level"), F.col("evidence_strength").alias("strength"), F.col("is_independent").alias("independent"), F.col("is_primary").alias("primary"),
        F.col("is_opinion").alias("opinion"), F.col("is_wire").alias("wire"), F.coalesce("domain", F.lit("")).alias("domain"),
        F.coalesce(F.nullif(F.lower(strip(F.coalesce("domain", F.lit("")))), F.lit("")), F.col("evidence_id")).alias("stream"),
        F.col("is_relevant").alias("relevant"), F.coalesce("demotion_reason", F.concat(F.lit("RELEVANT: "), F.col("level"))).alias("note"),
    )
    grouped = judged.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    rows = claims.join(grouped, keys, "left")
    rows = rows.withColumns({"_rel": F.filter("_all", lambda r: r["relevant"]), "_gone": F.filter("_all", lambda r: ~r["relevant"])})
    sound = lambda r: r["strength"].isin("STRONG", "MODERATE")
    usable = lambda r: r["level"].isin("DIRECT", "PARTIAL")
    rows = rows.withColumns({
        "_s": F.filter("_rel", lambda r: (r["stance"] == "SUPPORTS") & usable(r)),
        "_x": F.filter("_rel", lambda r: (r["stance"] == "CONTRADICTS") & usable(r) & sound(r)),
    })
    n = lambda arr, cond: F.greatest(F.coalesce(F.size(F.filter(arr, cond)), F.lit(0)), F.lit(0))
    is_strong = lambda r: r["independent"] & (r["level"] == "DIRECT") & (r["strength"] == "STRONG")
    s_streams, s_score = _stream_total(F.col("_s"))
    x_streams, x_score = _stream_total(F.col("_x"))
    rows = rows.withColumns({
        "_ns": F.coalesce(F.greatest(F.size("_s"), F.lit(0)), F.lit(0)), "_nx": F.coalesce(F.greatest(F.size("_x"), F.lit(0)), F.lit(0)),
        "independent_supporting_streams": F.coalesce(F.greatest(s_streams, F.lit(0)), F.lit(0)), "support_score": F.coalesce(s_score, F.lit(0.0)),
        "independent_contradicting_streams": F.coalesce(F.greatest(x_streams, F.lit(0)), F.lit(0)), "contradict_score": F.coalesce(x_score, F.lit(0.0)),
        "_sp": n("_s", lambda r: r["primary"]) > 0, "_xp": n("_x", lambda r: r["primary"]) > 0,
        "_strong_s": n("_rel", lambda r: (r["stance"] == "SUPPORTS") & is_strong(r)), "_strong_x": n("_rel", lambda r: (r["stance"] == "CONTRADICTS") & is_strong(r)),
        "_solid": n("_rel", lambda r: (r["stance"] == "SUPPORTS") & r["independent"] & (r["level"] == "DIRECT") & sound(r) & (r["weight"] >= 0.5)) > 0,
        "_any_strong_s": n("_rel", lambda r: (r["stance"] == "SUPPORTS") & (r["strength"] == "STRONG")) > 0,
        "_any_strong_x": n("_rel", lambda r: (r["stance"] == "CONTRADICTS") & (r["strength"] == "STRONG")) > 0,
        "_leaning": n("_rel", lambda r: r["stance"] != "NEUTRAL_IRRELEVANT") > 0,
    })
    c = F.col
    both, only_s, only_x = (c("_ns") > 0) & (c("_nx") > 0), (c("_ns") > 0) & (c("_nx") == 0), (c("_nx") > 0) & (c("_ns") == 0)
    case = (
        F.when(c("_all").isNull() | (F.size("_all") == 0), "NO_EVIDENCE")
        .when(both & c("_sp") & ~c("_xp") & (c("support_score") > c("contradict_score") * 1.5), "PRIMARY_SUPPORT")
        .when(both & c("_xp") & ~c("_sp") & (c("contradict_score") > c("support_score") * 1.5), "PRIMARY_CONTRADICTION")
        .when(both, "DISPUTED")
        .when(only_s & (c("_sp") | (c("_strong_s") >= 1) | c("_solid") | (c("independent_supporting_streams") >= 2)), "SUPPORT")
        .when(only_s, "WEAK_SUPPORT")
        .when(only_x & (c("_xp") | (c("_strong_x") >= 1) | (c("contradict_score") >= 0.7)), "CONTRADICTION")
        .when(only_x, "WEAK_CONTRADICTION")
        .when((F.size("_rel") == 0) & (F.size("_gone") > 0), "ALL_FILTERED")
        .otherwise("NEUTRAL_ONLY")
    )
    rows = rows.withColumn("basis", case)
    final = F.when(c("basis").isin("PRIMARY_SUPPORT", "SUPPORT"), "SUPPORTED").when(c("basis").isin("PRIMARY_CONTRADICTION", "CONTRADICTION"), "CONTRADICTED").otherwise("UNCERTAIN")
    rows = rows.withColumn("final_stance", final)
    strength = (
        F.when(c("final_stance") == "SUPPORTED", F.when(c("_sp") | c("_any_strong_s"), "STRONG").when(c("support_score") >= 0.6, "MODERATE").otherwise("WEAK"))
        .when(c("final_stance") == "CONTRADICTED", F.when(c("_xp") | c("_any_strong_x"), "STRONG").otherwise("MODERATE"))
        .otherwise(F.when(both, "MODERATE").when(c("_leaning"), "WEAK").otherwise("INSUFFICIENT"))
    )
    ids = lambda arr: F.coalesce(F.transform(arr, lambda r: r["id"]), F.array().cast("array<string>"))
    used = F.concat(ids("_s"), ids("_x"))
    limits = F.filter(F.array(
        F.when(c("basis") == "NO_EVIDENCE", "NO_RESULTS").otherwise("SNIPPETS_ONLY"),
        F.when(c("basis") == "DISPUTED", "CONFLICTING_REPORTS").when(c("basis") == "WEAK_SUPPORT", "LOW_WEIGHT_SUPPORT").when(c("basis") == "WEAK_CONTRADICTION", "LOW_WEIGHT_CONTRADICTION")
        .when(c("basis") == "ALL_FILTERED", "ALL_FILTERED").when(c("basis") == "NEUTRAL_ONLY", "NEUTRAL_SOURCES"),
    ), lambda x: x.isNotNull())
    rows = rows.withColumns({
        "importance": tx.importance(c("claim_text")), "evidence_strength": strength,
        "supporting_evidence_ids": ids("_s"), "contradicting_evidence_ids": ids("_x"), "neutral_evidence_ids": F.array_except(ids("_rel"), used),
        "filtered_evidence_ids": ids("_gone"), "limitations": limits,
        "unique_domains": F.array_sort(F.array_distinct(F.filter(F.coalesce(F.transform("_rel", lambda r: r["domain"]), F.array().cast("array<string>")), lambda d: d != ""))),
        "primary_count": n("_rel", lambda r: r["primary"]), "independent_count": n("_rel", lambda r: r["independent"] & ~r["opinion"]),
        "syndicated_count": n("_rel", lambda r: r["wire"]), "opinion_count": n("_rel", lambda r: r["opinion"]), "relevant_count": n("_rel", lambda r: F.lit(True)),
        "filtered_count": n("_gone", lambda r: F.lit(True)), "weak_count": n("_rel", lambda r: r["strength"] == "WEAK"), "duplicate_count": n("_rel", lambda r: ~r["independent"]),
        "direct_supporting_count": n("_s", lambda r: r["level"] == "DIRECT"), "partial_supporting_count": n("_s", lambda r: r["level"] == "PARTIAL"),
        "direct_contradicting_count": n("_x", lambda r: r["level"] == "DIRECT"),
        "audit_notes": F.map_from_entries(F.transform(F.concat("_rel", "_gone"), lambda r: F.struct(r["id"], r["note"]))),
    })
    disputed = F.concat(F.lit("Supported by "), F.array_join("supporting_evidence_ids", ", "), F.lit(", contradicted by "), F.array_join("contradicting_evidence_ids", ", "), F.lit("."))
    rows = rows.withColumn("disputed_summary", F.when(c("basis") == "DISPUTED", disputed))
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    yes, no = F.array_join("supporting_evidence_ids", ", "), F.array_join("contradicting_evidence_ids", ", ")
    explained = (
        F.when(c("basis") == "NO_EVIDENCE", "No evidence was found, so the claim is open.")
        .when(c("basis") == "PRIMARY_SUPPORT", say("Primary evidence supports the claim (", yes, ") against other reports (", no, ")."))
        .when(c("basis") == "PRIMARY_CONTRADICTION", say("Primary evidence refutes the claim (", no, ") against other reports (", yes, ")."))
        .when(c("basis") == "DISPUTED", say("Credible sources disagree: ", yes, " for, ", no, " against."))
        .when(c("basis") == "SUPPORT", say("Reliable evidence supports the claim (", yes, ")."))
        .when(c("basis") == "WEAK_SUPPORT", say("What supports the claim is too weak (", yes, ")."))
        .when(c("basis") == "CONTRADICTION", say("Reliable evidence refutes the claim (", no, ")."))
        .when(c("basis") == "WEAK_CONTRADICTION", say("What speaks against the claim is too weak (", no, ")."))
        .when(c("basis") == "ALL_FILTERED", say("None of the ", c("filtered_count").cast("string"), " results is about the claim."))
        .otherwise("The sources neither confirm nor refute the claim.")
    )
    rows = rows.withColumn("explanation", explained)
    return rows.drop(*[x for x in rows.columns if x.startswith("_")])


def reports(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: the assessment and the totals over its claims."""
    c = F.col
    is_ = lambda s: c("final_stance") == s
    high = c("importance") == "HIGH"
    ordered = lambda col: F.transform(F.array_sort(F.collect_list(F.struct("claim_id", F.col(col).alias("v")))), lambda r: r["v"])
    out = results.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_claims"), F.count_if(is_("SUPPORTED")).alias("supported_claims"), F.count_if(is_("CONTRADICTED")).alias("contradicted_claims"),
        F.count_if(is_("UNCERTAIN")).alias("uncertain_claims"), F.count_if(high).alias("high_importance_claims"),
        F.count_if(high & is_("SUPPORTED")).alias("high_supported"), F.count_if(high & is_("CONTRADICTED")).alias("high_contradicted"),
        F.array_distinct(F.flatten(ordered("limitations"))).alias("key_limitations"),
        F.size(F.array_distinct(F.flatten(F.collect_list("unique_domains")))).alias("total_unique_domains"),
        *[F.sum(f"{x}_count").alias(f"total_{x}") for x in ("independent", "primary", "syndicated", "opinion", "filtered")],
        F.array_sort(F.collect_list(F.when(is_("CONTRADICTED"), c("claim_id")))).alias("contradicted_ids"),
    )
    assessment = (
        F.when(c("high_contradicted") > 0, F.when(c("high_supported") > 0, "MIXED").otherwise("LIKELY_CONTRADICTED"))
        .when(c("contradicted_claims") > 0, F.when(c("supported_claims") > 0, "MIXED").otherwise("LIKELY_CONTRADICTED"))
        .when(
            (c("supported_claims") > 0)
            & (((c("high_importance_claims") > 0) & (c("high_supported") * 2 >= c("high_importance_claims"))) | (c("supported_claims") * 2 >= c("total_claims"))),
            "LIKELY_SUPPORTED",
        )
        .otherwise("INSUFFICIENT_EVIDENCE")
    )
    out = out.withColumn("overall_assessment", assessment)
    count = lambda name: F.col(name).cast("string")
    summary = F.concat(
        count("supported_claims"), F.lit(" of "), count("total_claims"), F.lit(" claims supported, "), count("contradicted_claims"), F.lit(" contradicted"),
        F.when(F.size("contradicted_ids") > 0, F.concat(F.lit(" ("), F.array_join("contradicted_ids", ", "), F.lit(")"))).otherwise(""), F.lit(", "),
        count("uncertain_claims"), F.lit(" open."),
    )
    return out.withColumn("summary", summary)


def report_all(documents: DataFrame, results: DataFrame, key: str = "doc_id") -> DataFrame:
    """reports() for every document, also for those without a claim."""
    out = documents.select(key).join(reports(results, key), key, "left")
    numbers = [f.name for f in out.schema if f.dataType.simpleString() in ("bigint", "int") and f.name != key]
    return out.fillna(0, numbers).fillna({"overall_assessment": "INSUFFICIENT_EVIDENCE", "summary": "No claims."})
