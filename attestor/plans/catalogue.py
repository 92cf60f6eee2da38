"""All queries of the verification engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions import provenance as pv
from attestor.functions import text as tx
from attestor.functions.decompose import decompose, search_query
from attestor.functions.dialect import split_words
from attestor.operators import claims as cl
from attestor.operators import evaluate as ev
from attestor.operators import retrieve as rt
from attestor.operators import validate as va
from attestor.operators import verdict as vd
from attestor.plans import fixtures as fx
from attestor.plans.oracle import ORACLE_SQL  # noqa: F401
from attestor.plans.verify import verify
from attestor.runtime import materialise, read
from attestor.sources import fetch as fe
from attestor.sources import search as se


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with fixture sentences beside them since the documents' words are invented."""
    more = spark.sql(fx.values("doc_id, text", [(-1 - i, t) for i, t in enumerate(fx.SENTENCES)]))
    return read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(more.select(F.col("doc_id").cast("long"), "text"))


def _urls(spark, sf_dir):
    more = spark.sql(fx.values("page_id, url", [(-1 - i, u) for i, u in enumerate(fx.URLS)]))
    return read(spark, sf_dir, "pages").select("page_id", "url").unionByName(more.select(F.col("page_id").cast("long"), "url"))


def _sentences(spark, sf_dir):
    return cl.sentence_rows(_texts(spark, sf_dir))


def _per_sentence(name, column):
    def query(spark, sf_dir):
        return _sentences(spark, sf_dir).select("doc_id", "idx", column(F.col("sentence")).alias(name))

    return query


def validate_text(spark, sf_dir):
    checked = _texts(spark, sf_dir).select("doc_id", va.check_text(F.col("text")).alias("v"))
    return checked.select("doc_id", "v.error_code", "v.character_count", "v.word_count")


def validate_url(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", va.check_url(F.col("url")).alias("v")).select("page_id", "v.error_code", "v.domain")


def url_domain(spark, sf_dir):
    rows = _urls(spark, sf_dir).select("page_id", tx.domain_of(F.col("url")).alias("domain"))
    return rows.withColumns({"tier": pv.tier(F.col("domain")), "category": pv.category(F.col("domain"))})


def clean_text(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


def viable_claims(spark, sf_dir):
    return _sentences(spark, sf_dir).where(tx.is_viable(F.col("sentence"))).select("doc_id", "idx")


def top_claims(spark, sf_dir):
    return cl.claims(_texts(spark, sf_dir)).select("doc_id", "claim_id", "text", "source_sentence_index", "priority_score")


def atomic_predicates(spark, sf_dir):
    return cl.claims(_texts(spark, sf_dir), compound=True)


def claim_parts(spark, sf_dir):
    return decompose(cl.claims(_texts(spark, sf_dir)), "text").select("doc_id", "claim_id", "parts.*")


def search_queries(spark, sf_dir):
    found = search_query(decompose(cl.claims(_texts(spark, sf_dir)), "text"), "text")
    return found.select("doc_id", "claim_id", "query_text", F.array_join("preserved_keywords", "|").alias("keywords"), F.array_join("additional_queries", "|").alias("others"))


def numbers(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", "idx", F.explode(tx.numbers(F.col("sentence"))).alias("n")).select("doc_id", "idx", "n.val", "n.raw")


def paragraph_dedup(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.where((F.length("line") >= fe.PARAGRAPH_CHARS) & (F.size(split_words(F.col("line"))) >= fe.PARAGRAPH_WORDS))
    norm = F.array_join(split_words(F.lower("line")), " ")
    first = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("_norm"), "_norm").orderBy("pos"))
    return rows.withColumn("_norm", norm).withColumn("_n", first).where("_n = 1").select("doc_id", "pos", "line")


def _article_rows(spark, sf_dir):
    return fe.articles(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "article.*")


def articles(spark, sf_dir):
    return _article_rows(spark, sf_dir).select("page_id", "status", "title", "text", "domain", "canonical_url", "character_count", "word_count")


def fetch_status(spark, sf_dir):
    rows = _urls(spark, sf_dir).withColumns({
        "http_status": F.element_at(F.array(*[F.lit(x) for x in (200, 401, 403, 404, 410, 429, 500, 503)]), (F.pmod("page_id", F.lit(8)) + 1).cast("int")),
        "failure": F.when(F.pmod("page_id", F.lit(11)) == 0, "TIMEOUT").when(F.pmod("page_id", F.lit(13)) == 0, "SSL"),
        "content_type": F.when(F.pmod("page_id", F.lit(3)) == 0, "application/pdf").otherwise("text/html; charset=utf-8"),
    })
    status = fe.fetch_status(F.col("url"), F.col("http_status"), F.col("content_type"), F.col("failure"))
    return rows.select("page_id", F.coalesce(status, F.lit("HTML")).alias("status"))


def _evidence(spark):
    rows = spark.sql(fx.values(fx.EVIDENCE_COLUMNS, fx.EVIDENCE))
    relevance = F.struct(F.col("level").alias("level"), F.lit("GIVEN").alias("reason")).alias("relevance")
    return rows.select(*[c for c in rows.columns if c != "level"], relevance, F.lit("a claim of 2024").alias("claim_text"))


def _evaluated(spark):
    return ev.evaluate(_evidence(spark), relevance=False)


def _source_flags(rows):
    return rows.select(
        "doc_id", "claim_id", "evidence_id", "provenance", "opinion_reason", "is_clickbait", "agency", "is_wire", "has_quotes", "has_metrics", "has_named"
    )


def _independence(rows):
    return rows.select("doc_id", "claim_id", "evidence_id", "duplicate_wire", "duplicate_domain")


def _quality(rows):
    return rows.select("doc_id", "claim_id", "evidence_id", "category", "quality_score", "is_primary", "is_independent", "evidence_strength")


def _claim_eval_summary(rows):
    out = ev.summarise(rows).withColumn("domains", F.array_join("unique_domains", ","))
    return out.drop("unique_domains", "unique_domain_count", "has_sufficient")


def diversity_cap(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("doc_id"), F.col("page_id").alias("rank"), F.lower("url").alias("url"), F.lit("").alias("domain"))
    return rt.diversify(pages, ["doc_id"]).select("doc_id", "rank", "domain", "evidence_id")


def registry_search(spark, sf_dir):
    keys = [(1, "the of"), (2, "enbe"), (3, "que des"), (4, "a")]
    one = F.array(F.struct(F.col("key").alias("title")))
    registry = spark.sql(fx.values("seq, key", keys)).withColumn("results", one)
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_key"), F.col("text").alias("query_text"))
    return se.registry_search(queries, registry).select("query_key", F.col("title").alias("key"))


def _provider(spark, sf_dir):
    pages = _article_rows(spark, sf_dir).where("status = 'SUCCESS'").select("page_id", "title", "text", "url")
    return se.corpus_provider(materialise(pages, "articles"))  # read three times: index, frequencies, results


def corpus_retrieve(spark, sf_dir):
    claims = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("C001").alias("claim_id"), F.col("text").alias("query_text"))
    return rt.retrieve(claims, _provider(spark, sf_dir)).select("doc_id", "claim_id", "evidence_id", "rank", "url", "domain", "priority_tier")


def _verified(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return verify(items, _provider(spark, sf_dir))


def relevance_levels(spark, sf_dir):
    rows = _verified(spark, sf_dir)["judged"]
    return rows.select("doc_id", "claim_id", "evidence_id", "level", "relevance.reason", "stance", "stance_reason", F.round("weight", 6).alias("weight"))


def verified_reports(spark, sf_dir):
    return _verified(spark, sf_dir)["reports"].select("doc_id", "total_claims", "supported_claims", "contradicted_claims", "uncertain_claims", "overall_assessment")


def verified_documents(spark, sf_dir):
    """The whole plan over all documents, with the pages as the corpus that is searched."""
    out = verify(read(spark, sf_dir, "documents").select("doc_id", "text"), _provider(spark, sf_dir))
    return out["verdicts"].select("doc_id", "claim_id", "importance", "final_stance", "basis", "evidence_strength", "relevant_count", "filtered_count")


def _judged(spark):
    return spark.sql(fx.values(fx.JUDGED_COLUMNS, fx.JUDGED)).withColumn("weight", F.col("weight").cast("double"))


def _verdicts(spark):
    return vd.verdicts(spark.sql(fx.values("doc_id, claim_id, claim_text", fx.JUDGED_CLAIMS)), _judged(spark))


def _stream_consensus(verdicts):
    rows = verdicts.select("doc_id", "claim_id", F.explode(F.array(
        F.struct(F.lit("s").alias("side"), F.col("independent_supporting_streams").alias("streams"), F.col("support_score").alias("score")),
        F.struct(F.lit("x").alias("side"), F.col("independent_contradicting_streams").alias("streams"), F.col("contradict_score").alias("score")),
    )).alias("r"))
    return rows.select("doc_id", "claim_id", "r.side", F.col("r.streams").cast("long").alias("streams"), F.round("r.score", 6).alias("score")).where("streams > 0")


def _claim_verdict(verdicts):
    return verdicts.select(
        "doc_id", "claim_id", "importance", "basis", "final_stance", "evidence_strength", F.array_join("supporting_evidence_ids", ",").alias("supporting"),
        F.array_join("contradicting_evidence_ids", ",").alias("contradicting"), F.round("support_score", 6).alias("support_score"),
        F.round("contradict_score", 6).alias("contradict_score"), F.col("independent_supporting_streams").alias("support_streams"),
        F.col("independent_contradicting_streams").alias("contradict_streams"),
    )


def _article_report(verdicts):
    return vd.reports(verdicts).select(
        "doc_id", "total_claims", "supported_claims", "contradicted_claims", "uncertain_claims", "high_importance_claims",
        F.col("total_primary").cast("long"), F.col("total_independent").cast("long"), "total_unique_domains", "overall_assessment",
    )


def _verdict_rollup(verdicts):
    return verdicts.cube("doc_id", "final_stance").agg(F.count(F.lit(1)).alias("n"))


#: Operators on evaluated evidence and on verdicts: each is a query of its name over the fixture rows that its SQL states, and
#: one with ``verified_`` before its name over what the whole plan finds for all benchmark items.
ON_EVIDENCE = {"source_flags": _source_flags, "independence": _independence, "quality": _quality, "claim_eval_summary": _claim_eval_summary}
ON_VERDICTS = {"stream_consensus": _stream_consensus, "claim_verdict": _claim_verdict, "article_report": _article_report, "verdict_rollup": _verdict_rollup}


def _over_fixtures(operator, rows):
    return lambda spark, sf_dir: operator(rows(spark))


def _over_tables(operator, part):
    return lambda spark, sf_dir: operator(_verified(spark, sf_dir)[part])


QUERIES = {
    f.__name__: f
    for f in (
        top_claims, validate_text, validate_url, url_domain, clean_text, viable_claims, atomic_predicates, claim_parts, search_queries, numbers, paragraph_dedup, articles,
        fetch_status, diversity_cap, registry_search, corpus_retrieve, relevance_levels, verified_reports, verified_documents,
    )
} | {
    **{name: _over_fixtures(f, _evaluated) for name, f in ON_EVIDENCE.items()},
    **{name: _over_fixtures(f, _verdicts) for name, f in ON_VERDICTS.items()},
    **{f"verified_{name}": _over_tables(f, "judged") for name, f in ON_EVIDENCE.items()},
    **{f"verified_{name}": _over_tables(f, "verdicts") for name, f in ON_VERDICTS.items()},
    "sentences": _sentences,
    "claim_priority": _per_sentence("priority_score", tx.priority),
    "importance": _per_sentence("importance", tx.importance),
    "negation": _per_sentence("is_negated", tx.is_negated),
    "attribution": _per_sentence("attribution", tx.attribution),
    "dates": _per_sentence("dates", lambda s: F.array_join(tx.dates(s), ",")),
    "action_directions": _per_sentence("directions", lambda s: F.array_join(tx.directions(s), ",")),
    "predicate_counts": _per_sentence("n_predicates", lambda s: F.size(tx.predicates(s))),
}
