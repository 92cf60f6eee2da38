"""Golden rows of the verification rules."""

import pytest
from pyspark.sql import functions as F

from attestor.functions import provenance as pv
from attestor.functions import text as tx
from attestor.functions.decompose import decompose, search_query
from attestor.operators import claims as cl
from attestor.operators import evaluate as ev
from attestor.operators import retrieve as rt
from attestor.operators import validate as va
from attestor.operators import verdict as vd
from attestor.sources import fetch as fe
from attestor.sources import search as se


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "url", "code"),
    [
        (None, None, "NO_INPUT"), ("  ", " ", "NO_INPUT"), ("some text here", "https://a.com", "TWO_INPUTS"), ("Breaking news!", None, "TOO_SHORT"),
        ("a" * 43, None, "TOO_FEW_WORDS"), ("a b c " * 10_000, None, "TOO_LONG"), ("  A statement with quite enough words in it  ", None, None),
        (None, "www.example.com/a", "BAD_PROTOCOL"), (None, "ftp://a.com", "BAD_PROTOCOL"), (None, "https://example .com/news", "SPACES"),
        (None, "https://invalid_host/a", "BAD_DOMAIN"), (None, "https://www.thehindu.com/a", None), (None, "http://localhost:80/", None),
    ],
)
def test_validation(spark, text, url, code):
    row = va.validate(spark.createDataFrame([(text, url)], "news_text string, article_url string")).first()
    assert (row.error_code, row.is_valid) == (code, code is None)


def test_sentences(spark):
    text = "Dr. Smith met the U.S. envoy in Jan. 2024. The repo rate was 6.5% there. यह सही है। और यह भी॥ Done"
    assert len(one(spark, tx.sentences, text)) == 5
    assert one(spark, tx.sentences, None) == [] == one(spark, tx.sentences, " \n ")


@pytest.mark.parametrize(
    ("sentence", "viable"),
    [
        ("Is the economy growing this year?", False), ("Too short.", False), ("I think the movie is a masterpiece of art.", False),
        ("The central bank kept the rate at 6.5% today.", True), ("The government announced a $20 billion budget.", True), ("What a lovely day we had today!", False),
        ("I believe the rate was 6.5% in March.", True),
    ],
)
def test_viable(spark, sentence, viable):
    assert one(spark, tx.is_viable, sentence) is viable


def test_claims_are_numbered_in_text_order_and_bounded(spark):
    text = "The bank raised the rate to 6.5% in 2024. What is this? I feel this is bad for all of us. Police arrested 40 people in Delhi. The court banned the film in 2023."
    rows = cl.claims(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "It is what it is, he was not sure. Why so?")], "doc_id long, text string"), most=3).collect()
    assert [(r.doc_id, r.claim_id) for r in sorted(rows)] == [(1, "C001"), (1, "C002"), (1, "C003"), (4, "C001")]
    assert [r.source_sentence_index for r in sorted(rows) if r.doc_id == 1] == [0, 3, 4]


def test_predicates(spark):
    assert one(spark, tx.predicates, "Police detained 40 students and used tear gas.") == ["Police detained 40 students", "Police detained used tear gas."]
    assert one(spark, tx.predicates, "They met and talked.") == ["They met and talked."]


def parts(spark, text):
    return decompose(spark.createDataFrame([(text,)], "t string"), "t").first()["parts"]


def test_decomposition(spark):
    p = parts(spark, "A spokesperson for Reuters said that the RBI did not increase the repo rate to 6.5% in Mumbai in 2024.")
    assert p.attribution == "A spokesperson for Reuters said that" and p.is_negated and p.quantity == "6.5, 2024"
    assert p.location == "Mumbai" and p.time == "in 2024" and p.named_entities == ["Reuters", "RBI", "Mumbai"]
    q = parts(spark, "Delhi Metro carried 40 lakh people on Monday")
    assert q.named_entities[0] == "Delhi Metro" and q.time == "on Monday" and q.quantity == "40 lakh"
    hindi = parts(spark, "भारत ने चंद्रयान मिशन शुरू किया और चंद्रमा पर उतरा")
    assert hindi.action == "शुरू" and len(hindi.core_concepts) >= 3


def test_search_query(spark):
    rows = decompose(spark.createDataFrame([("The Reserve Bank of India kept the repo rate unchanged at 6.5%.",)], "t string"), "t")
    q = search_query(rows, "t").first()
    assert "6.5%" in q.query_text and "repo" in q.query_text and len(q.preserved_keywords) <= 9 and q.query_text not in q.additional_queries


@pytest.mark.parametrize(("url", "domain"), [("https://www.Example.com:80/a", "example.com"), ("http://a.b.co.uk/?q", "a.b.co.uk"), ("not-a-url", ""), (None, "")])
def test_domain(spark, url, domain):
    assert one(spark, tx.domain_of, url) == domain


@pytest.mark.parametrize(
    ("domain", "tier"),
    [("pib.gov.in", "Government / Official"), ("rbi.org.in", "Institutional / Regulatory"), ("reuters.com", "Reputable News"), ("randomblog.xyz", "General"), ("notreuters.com", "General")],
)
def test_tier(spark, domain, tier):
    assert one(spark, pv.tier, domain) == tier


def test_numbers_and_directions(spark):
    assert [(n.val, n.raw) for n in one(spark, tx.numbers, "From 6.5 to 6.5% in 2026, or $20")] == [(6.5, "6.5%"), (20.0, "$20")]
    assert one(spark, tx.directions, "They defeated the team and released a record") == ["FREE", "ISSUE", "LOSE", "WIN"]
    assert one(spark, tx.is_negated, "He did not go") and not one(spark, tx.is_negated, "He went")


COLUMNS = "doc_id int, claim_id string, claim_text string, evidence_id string, pos int, title string, url string, domain string, snippet string, publication_date string"


def judge(spark, claim, sources):
    rows = [(1, "C001", claim, f"E{i:03d}", i, t, u, d, s, p) for i, (t, u, d, s, p) in enumerate(sources, 1)]
    df = spark.createDataFrame(rows, COLUMNS)
    judged = vd.stance(ev.evaluate(decompose(df, "claim_text")))
    claims = spark.createDataFrame([(1, "C001", claim)], "doc_id int, claim_id string, claim_text string")
    return {r.evidence_id: r for r in judged.collect()}, vd.verdicts(claims, judged).first()


def src(title, snippet, domain="reuters.com", date="2026-01-05"):
    return (title, f"https://{domain}/a/{abs(hash(title)) % 99}", domain, snippet, date)


CASES = [
    ("The Reserve Bank kept the repo rate unchanged at 6.5% in 2026.", src("Reserve Bank keeps repo rate unchanged at 6.5%", "The Reserve Bank kept the repo rate unchanged at 6.5%.", "rbi.org.in"), "SUPPORTS", "SUPPORTED"),
    ("The Reserve Bank kept the repo rate unchanged at 6.5% in 2026.", src("Reserve Bank cuts repo rate to 6.25%", "The Reserve Bank cut the repo rate to 6.25%.", "rbi.org.in"), "CONTRADICTS", "CONTRADICTED"),
    ("Falcons United won the championship final.", src("Falcons United lost the championship final", "Falcons United lost the championship final to rivals.", "bbc.com"), "CONTRADICTS", "CONTRADICTED"),
    ("Police arrested Mayor Smith on corruption charges.", src("Police did not arrest Mayor Smith", "Police did not arrest Mayor Smith on corruption charges.", "bbc.com"), "CONTRADICTS", "CONTRADICTED"),
    ("An earthquake struck Chile in 2026.", src("Earthquake struck Chile in 2011", "A strong earthquake struck Chile in 2011.", "bbc.com"), "NEUTRAL_IRRELEVANT", "UNCERTAIN"),
    ("The RBI raised the policy rate by 25 basis points.", src("ECB raises rates by 25 basis points", "The European Central Bank raised rates by 25 basis points.", "bbc.com"), "NEUTRAL_IRRELEVANT", "UNCERTAIN"),
    ("WHO declared an Ebola outbreak over in Uganda.", src("Diabetes", "WHO page about diabetes and its treatment.", "who.int"), "NEUTRAL_IRRELEVANT", "UNCERTAIN"),
]


@pytest.mark.parametrize(("claim", "source", "stance", "final"), CASES)
def test_stance_and_verdict(spark, claim, source, stance, final):
    judged, verdict = judge(spark, claim, [source])
    assert (judged["E001"].stance, verdict.final_stance) == (stance, final)


def test_relevance_gate(spark):
    judged, verdict = judge(spark, "Protesters gathered near the ministry in Delhi.", [
        src("R - Wiktionary", "the letter", "en.wiktionary.org"), ("Mercury (disambiguation)", "https://w.org/x", "w.org", "X may refer to:", None),
        ("Find a lawyer", "https://d.com/directory/", "d.com", "list", None),
    ])
    assert {r.relevance.reason for r in judged.values()} == {"DICTIONARY_DOMAIN", "DISAMBIGUATION", "DIRECTORY"}
    assert verdict.basis == "ALL_FILTERED" and verdict.filtered_count == 3 and not verdict.supporting_evidence_ids


def test_no_evidence_is_uncertain(spark):
    claims = spark.createDataFrame([(1, "C001", "The bank raised the rate to 6.5%.")], "doc_id int, claim_id string, claim_text string")
    nothing = judge_nothing(spark)
    verdict = vd.verdicts(claims, nothing).first()
    assert (verdict.final_stance, verdict.evidence_strength, verdict.basis) == ("UNCERTAIN", "INSUFFICIENT", "NO_EVIDENCE")
    report = vd.report_all(spark.createDataFrame([(1,), (2,)], "doc_id int"), vd.verdicts(claims, nothing)).collect()
    assert {r.doc_id: (r.total_claims, r.overall_assessment) for r in report} == {1: (1, "INSUFFICIENT_EVIDENCE"), 2: (0, "INSUFFICIENT_EVIDENCE")}


def judge_nothing(spark):
    return vd.stance(ev.evaluate(decompose(spark.createDataFrame([], COLUMNS), "claim_text")))


def test_quality_is_85_for_dated_reporting_with_quotes(spark):
    q = pv.quality(F.lit("FACTUAL_REPORTING"), F.lit(True), F.lit(True), F.lit(False), F.lit(False), F.lit(False), F.lit(False))
    assert spark.range(1).select(q.alias("q")).first().q == 85


def test_diversity(spark):
    rows = [(1, i, u, d) for i, (u, d) in enumerate([("r/1", "reuters.com"), ("r/1", "reuters.com"), ("r/2", "reuters.com"), ("r/3", "reuters.com"), ("b/1", "bbc.com")], 1)]
    kept = rt.diversify(spark.createDataFrame(rows, "doc_id int, rank int, url string, domain string"), ["doc_id"]).orderBy("pos").collect()
    assert [(r.evidence_id, r.url) for r in kept] == [("E001", "r/1"), ("E002", "r/2"), ("E003", "b/1")]


def test_registry(spark):
    registry = spark.createDataFrame([(1, "repo rate", [("a",), ("b",)]), (2, "*", [("c",)])], "seq int, key string, results array<struct<title:string>>")
    queries = spark.createDataFrame([(1, "RBI repo rate today"), (2, "rate repo"), (3, "weather")], "query_key int, query_text string")
    got = {(r.query_key, r.rank): r.title for r in se.registry_search(queries, registry, 1).collect()}
    assert got == {(1, 1): "a", (2, 1): "a", (3, 1): "c"}


def test_topics_and_keys_are_bounded(spark, monkeypatch):
    queries = spark.createDataFrame([(1, "Wheat and interest rate"), (2, "GRAIN harvest"), (3, "weather"), (4, None)], "query_key int, query_text string")
    got = {(r.query_key, r["rank"], r.domain) for r in se.default_provider(spark)(queries, 2).collect()}
    assert got == {(1, 1, "rbi.org.in"), (1, 2, "thehindu.com"), (2, 1, "fao.org")}
    monkeypatch.setattr(se, "KEYS", 1)
    registry = spark.createDataFrame([(1, "a", [("x",)]), (2, "b", [("y",)])], "seq int, key string, results array<struct<title:string>>")
    with pytest.raises(ValueError, match="registered keys"):
        se.registry_search(queries, registry)


def test_whole_plan_with_topics(spark):
    from attestor.plans.verify import report_lines, verify

    docs = spark.createDataFrame([(1, "The RBI kept the repo rate unchanged at 6.5%. The weather was nice in the hills today."), (2, "")], "doc_id long, text string")
    out = verify(docs, se.demonstration(spark))
    claims = {(r.doc_id, r.claim_id): r for r in out["claims"].collect()}
    assert claims[1, "C001"].status == "SUCCESS" and claims[1, "C001"].source_count == 3
    verdict = {r.claim_id: r for r in out["verdicts"].collect()}["C001"]
    assert verdict.final_stance == "SUPPORTED" and verdict.primary_count == 1 and "E001" in verdict.explanation
    reports = {r.doc_id: r for r in out["reports"].collect()}
    assert reports[2].total_claims == 0 and reports[2].summary == "No claims." and reports[1].total_claims == 2
    assert {r.doc_id for r in out["summaries"].collect()} == {1}
    lines = {(r.doc_id, r.line_no): r.line for r in report_lines(out).collect()}
    assert lines[2, 0] == "INSUFFICIENT_EVIDENCE: No claims." and lines[1, 1].startswith("C001 SUPPORTED (STRONG") and len(lines) == 4


def test_evidence_at_the_end_of_a_long_page(spark):
    """A page is judged by all of its text, not by how it begins."""
    from attestor.plans.verify import verify

    claim = "The Reserve Bank of India kept the repo rate unchanged at 6.5% on 8 February 2024."
    text = "Gardens need water in summer. " * 2000 + claim
    pages = spark.createDataFrame([(1, "Morning notes", text, "https://www.thehindu.com/a")], "page_id long, title string, text string, url string")
    out = verify(spark.createDataFrame([(1, claim)], "doc_id int, text string"), se.corpus_provider(pages), store=False)
    assert [(r.level, r.stance, r.snippet) for r in out["judged"].collect()] == [("DIRECT", "SUPPORTS", text)]


def test_corpus_search_against_brute_force(spark, monkeypatch):
    """The overlap counts all words of a query, in however many ranges and chunks."""
    import random

    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    draw = lambda n: [words[min(int(r.expovariate(0.08)), 59)] for _ in range(n)]
    pages = {i: draw(r.randint(5, 60)) for i in range(80)} | {80: words[:15], 81: words[40:]}
    queries = {i: draw(r.randint(1, 40)) for i in range(30)} | {30: words[:15] + words[55:], 31: ["absent"]}
    monkeypatch.setattr(se, "RANGE", 30)
    monkeypatch.setattr(se, "CHUNK", 12)
    table = spark.createDataFrame([(i, "", " ".join(p), f"https://a.com/{i}") for i, p in pages.items()], "page_id long, title string, text string, url string")
    asked = spark.createDataFrame([(i, " ".join(q)) for i, q in queries.items()], "query_key long, query_text string")
    got = sorted((x.query_key, x["rank"], int(x.url[14:])) for x in se.corpus_provider(table)(asked, 6).collect())
    want = []
    for k, q in queries.items():
        best = sorted((-len(set(q) & set(p)), i) for i, p in pages.items() if set(q) & set(p))[:6]
        want += [(k, n, i) for n, (_, i) in enumerate(best, 1)]
    assert got == want


def test_rest_answers(spark):
    rows = [
        (1, 200, '{"results":[{"title":"a","url":"https://www.x.com/1","content":"c","published_date":"2024-01-01T00:00"},5,{"url":"u"}]}', None),
        (2, 200, "[1]", None), (3, 200, '{"results":[]}', None), (4, 200, "no json", None), (5, 429, None, None), (6, None, None, "TIMEOUT"),
        (7, 200, '{"results":{}}', None), (8, 401, None, None), (9, None, None, "UNCONFIGURED"),
    ]
    out = {r.query_key: r for r in se.decode_answer(spark.createDataFrame(rows, "query_key int, http_status int, body string, failure string")).collect()}
    want = ["SUCCESS", "INVALID_RESPONSE", "NO_RESULTS", "INVALID_RESPONSE", "RATE_LIMITED", "NETWORK_FAILURE", "INVALID_RESPONSE", "API_FAILURE", "PROVIDER_UNCONFIGURED"]
    assert [out[i].status for i in range(1, 10)] == want
    assert [(r["rank"], r.title, r.domain, r.publication_date) for r in out[1].results] == [(1, "a", "x.com", "2024-01-01"), (3, "Untitled Source", "", None)]


def test_rest_requests_and_statuses(spark):
    import json

    queries = spark.createDataFrame([(1, " rates "), (2, "  "), (3, None)], "query_key long, query_text string")
    rows = {r.query_key: r for r in se.rest_requests(queries, 99).collect()}
    assert json.loads(rows[1].body) == {"query": "rates", "search_depth": "basic", "max_results": 10, "include_answer": False}
    assert [rows[k].status for k in (1, 2, 3)] == [None, "NO_RESULTS", "NO_RESULTS"]
    claims = spark.createDataFrame([(1, "C001", "a"), (1, "C002", "b"), (1, "C003", "c")], "doc_id int, claim_id string, query_text string")
    keyed = claims.withColumn("query_key", F.xxhash64("query_text"))
    body = '{"results":[{"title":"t","url":"https://x.com/1","content":"c"}]}'
    answers = keyed.select("query_key", F.when(F.col("claim_id") == "C003", 429).otherwise(200).alias("http_status"),
                           F.when(F.col("claim_id") == "C001", body).otherwise('{"results":[]}').alias("body"), F.lit(None).cast("string").alias("failure"))
    evidence = rt.retrieve(claims, se.answers_provider(answers))
    out = rt.with_status(claims, evidence, statuses=se.decode_answer(answers).select("query_key", "status"))
    assert {r.claim_id: (r.status, r.source_count) for r in out.collect()} == {"C001": ("SUCCESS", 1), "C002": ("NO_RESULTS", 0), "C003": ("RATE_LIMITED", 0)}


PAGE = """<html><head><title>Site title of the page - Name</title><meta property="og:title" content="The title"><link rel="canonical" href="https://e.com/c"></head><body>
<header>menu</header><article><p>{0}</p><p>{0}</p><p>Also Read: something that is quite another story altogether</p><figcaption>Photo: Getty Images of the event here today</figcaption>
<div class="newsletter"><p>Sign up for our letters and get all of the news every day</p></div><p>{1}</p></article><footer>foot</footer></body></html>"""


def test_articles():
    long_ = "The council met on Monday and decided on the budget of the next year after a long debate in the hall."
    other = "Members of <b>both</b><i>parties</i> spoke for hours, and the vote was close in the end as many had expected it to be."
    got = fe.article(PAGE.format(long_, other), "https://www.e.com/a")
    assert got["status"] == "SUCCESS" and got["title"] == "The title" and got["canonical_url"] == "https://e.com/c" and got["domain"] == "www.e.com"
    assert got["text"].count("council") == 1 and "both parties" in got["text"] and "Also Read" not in got["text"] and "letters" not in got["text"]
    assert fe.article("", "u")["status"] == "EMPTY_PAGE" == fe.article(None, None)["status"]
    assert fe.article("<header>x</header><footer>y</footer>", "u")["status"] == "NO_ARTICLE_CONTENT"
    assert fe.article("<article><p>Just a few words that make one</p></article>", "u")["status"] == "CONTENT_TOO_SHORT"


def test_stream_of_claims(spark, tmp_path):
    from attestor.streaming.live import claim_stream, document_stream

    docs = spark.createDataFrame([(1, "The bank raised the rate to 6.5% in 2024.", "en", "s", 41)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "in"))
    query = claim_stream(document_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("live_claims").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.claim_id for r in spark.sql("select * from live_claims").collect()] == ["C001"]


def test_verdict_invariants_on_random_evidence(spark):
    """What holds whatever the evidence: ids come from it once each, irrelevant rows decide nothing, copies add no stream."""
    import random

    r = random.Random(11)
    rows, claims = [], []
    for i in range(150):
        claims.append((i, "C001", "The court banned 40 firms in 2024."))
        for j in range(r.randint(0, 6)):
            level = r.choice(["DIRECT", "PARTIAL", "WEAK", "IRRELEVANT"])
            gone = level == "IRRELEVANT"
            stance = "NEUTRAL_IRRELEVANT" if level in ("WEAK", "IRRELEVANT") else r.choice(["SUPPORTS", "CONTRADICTS", "NEUTRAL_IRRELEVANT"])
            strength = "INSUFFICIENT" if gone else "WEAK" if level == "WEAK" else r.choice(["STRONG", "MODERATE", "WEAK"])
            quality = 5 * r.randint(1, 20)
            rows.append((i, "C001", f"E{j:03d}", j, r.choice(["a.com", "b.com", "", "A.com"]), level, quality, not gone and r.random() < 0.2, not gone and r.random() < 0.6,
                         False, False, not gone, strength, stance, quality / 100 if level in ("DIRECT", "PARTIAL") else 0.0, "IRRELEVANT" if gone else None))
    columns = "doc_id int, claim_id string, evidence_id string, pos int, domain string, level string, quality_score int, is_primary boolean, is_independent boolean, is_opinion boolean, is_wire boolean, is_relevant boolean, evidence_strength string, stance string, weight double, demotion_reason string"
    judged = spark.createDataFrame(rows, columns)
    out = vd.verdicts(spark.createDataFrame(claims, "doc_id int, claim_id string, claim_text string"), judged).collect()
    assert len(out) == 150
    for v in out:
        mine = [x for x in rows if x[0] == v.doc_id]
        ids = v.supporting_evidence_ids + v.contradicting_evidence_ids + v.neutral_evidence_ids + v.filtered_evidence_ids
        assert sorted(ids) == sorted(x[2] for x in mine)
        assert sorted(v.filtered_evidence_ids) == sorted(x[2] for x in mine if x[5] == "IRRELEVANT")
        assert set(v.audit_notes or {}) == {x[2] for x in mine}
        support = [x for x in mine if x[2] in v.supporting_evidence_ids and x[8]]
        streams = {}
        for x in support:
            key = x[4].lower() or x[2]
            streams[key] = max(streams.get(key, 0), x[14])
        assert v.independent_supporting_streams == len(streams) and abs(v.support_score - sum(streams.values())) < 1e-9
        if not mine:
            assert v.basis == "NO_EVIDENCE" and v.final_stance == "UNCERTAIN"
        if v.final_stance == "CONTRADICTED":
            assert v.contradicting_evidence_ids and (v.basis == "PRIMARY_CONTRADICTION" or not v.supporting_evidence_ids)
        if v.final_stance == "SUPPORTED":
            assert v.supporting_evidence_ids and (v.basis == "PRIMARY_SUPPORT" or not v.contradicting_evidence_ids)
    reports = vd.reports(spark.createDataFrame(out)).collect()
    assert all(x.supported_claims + x.contradicted_claims + x.uncertain_claims == x.total_claims for x in reports)


def test_operators_on_evidence_and_verdicts_read_the_tables(spark, monkeypatch):
    """Their queries named verified_ follow the whole plan's rows, here of one claim and one page, and not the fixtures."""
    from attestor.plans import catalogue
    from attestor.plans.verify import verify

    claim = "The Reserve Bank of India kept the repo rate unchanged at 6.5% on 8 February 2024."
    pages = spark.createDataFrame([(1, "Notes", claim, "https://www.thehindu.com/a")], "page_id long, title string, text string, url string")
    out = verify(spark.createDataFrame([(7, claim)], "doc_id long, text string"), se.corpus_provider(pages), store=False)
    monkeypatch.setattr(catalogue, "_verified", lambda spark, sf_dir: out)
    names = [f"verified_{n}" for n in (*catalogue.ON_EVIDENCE, *catalogue.ON_VERDICTS)]
    for name in names:
        assert {r.doc_id for r in catalogue.QUERIES[name](spark, "").select("doc_id").collect()} - {None} == {7}, name


NOTES = [
    (1, "Bank notes", "The Reserve Bank of India kept the repo rate unchanged at 6.5% on 8 February 2024. According to PTI, officials said so in Mumbai.", "https://www.thehindu.com/a"),
    (2, "Rate cut - news", "Reports that the Reserve Bank cut the repo rate to 6.25% in Delhi are not true.\n\nNo one said that the rate fell.", "https://x.example.org/b"),
    (3, "", "Delhi  Metro carried 40 lakh people on Monday. Police arrested Mayor Smith on corruption charges in 2023.", "https://bbc.com/c"),
    (4, "Overview of the WHO", "WHO guide and overview: the history of the organization and how it operates.", "https://who.int/d"),
    (5, "शुरू", "भारत ने चंद्रयान मिशन शुरू किया और चंद्रमा पर उतरा, 3 नहीं 4 बार।", "https://y.example.org/tag/e"),
]
CLAIMS = [
    (1, NOTES[0][2]), (2, "The Reserve Bank of India cut the repo rate to 6.25% in 2024. WHO declared an Ebola outbreak over in Uganda."),
    (3, "Delhi Metro carried 40 lakh people on Monday. Police did not arrest Mayor Smith in Mumbai."), (4, NOTES[4][2]), (5, ""), (6, "Metro carried few. It was a long day for all of the people there."),
]


def test_pages_read_once_judge_as_texts_in_every_row(spark, monkeypatch):
    """Rows that are stored carry no texts, groups of one row and of all give the same, and so does the way by rows."""
    from attestor import runtime
    from attestor.operators import match as ma
    from attestor.plans.verify import verify

    provider = se.corpus_provider(spark.createDataFrame(NOTES, "page_id long, title string, text string, url string"))
    docs = spark.createDataFrame(CLAIMS, "doc_id long, text string")
    shown = lambda df, columns: sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    want = verify(docs, provider, store=False)
    columns = sorted(want["judged"].columns)
    rows = shown(want["judged"], columns)
    assert {"DIRECT", "IRRELEVANT"} < {r.level for r in want["judged"].collect()} and len(rows) > 10
    for size in (ma.ROWS, 1):
        monkeypatch.setattr(ma, "ROWS", size)
        before = len(runtime._written)
        got = verify(docs, provider)
        stored = [df.columns for df in (spark.read.parquet(path) for _, path in runtime._written[before:])]
        assert stored and not [c for c in stored if "snippet" in c]
        assert sorted(got["judged"].columns) == columns and shown(got["judged"], columns) == rows
        for part in ("verdicts", "claims", "summaries", "evidence"):
            assert sorted(got[part].columns) == sorted(want[part].columns)
        assert shown(got["evidence"], ["doc_id", "claim_id", "evidence_id", "url", "snippet"]) == shown(want["evidence"], ["doc_id", "claim_id", "evidence_id", "url", "snippet"])
        assert shown(got["reports"], ["doc_id", "summary"]) == shown(want["reports"], ["doc_id", "summary"])


def test_search_copies_neither_queries_nor_postings(spark, monkeypatch):
    """In many blocks, over several rounds, a query has one row, its ties go to smaller ids, and only the last table is left. Repeated ids are one page."""
    from attestor import runtime

    monkeypatch.setattr(se, "RANGE", 7)
    monkeypatch.setattr(se, "ROUND", 30)
    pages = [(i, "", f"alpha w{i % 5} w{i % 3} x{i}", f"https://a.com/{i}") for i in range(60)] + [(70, "", "alpha one", "https://a.com/70"), (70, "", "two beta", "https://a.com/70")]
    table = spark.createDataFrame(pages, "page_id long, title string, text string, url string")
    queries = {i: f"Alpha w{i % 5}" for i in range(40)} | {40: "beta one two", 41: "absent", 42: None}
    before = len(runtime._written)
    found = se.corpus_provider(table).ranked(spark.createDataFrame(list(queries.items()), "query_key long, query_text string"), 6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Window" not in plan
    (_, path), = runtime._written[before:]
    assert spark.read.parquet(path).count() == len(queries)
    got = {(r.query_key, r["rank"]): (r["_page"]) for r in found.collect()}
    words = {}
    for i, _, text, _ in pages:
        words.setdefault(i, set()).update(text.split())
    for k, text in queries.items():
        asked = set((text or "").lower().split())
        want = sorted((-len(asked & w), i) for i, w in words.items() if asked & w)[:6]
        assert [got.get((k, n)) for n in range(1, 7)] == [i for _, i in want] + [None] * (6 - len(want))


def test_judged_in_parts_as_at_once(spark, monkeypatch):
    """Parts change nothing, and at the end neither rows with claims' words nor described pages are stored."""
    from attestor import runtime
    from attestor.plans import verify as plan

    provider = se.corpus_provider(spark.createDataFrame(NOTES, "page_id long, title string, text string, url string"))
    docs = spark.createDataFrame(CLAIMS, "doc_id long, text string")
    shown = lambda out: [sorted(map(str, out[part].collect())) for part in ("verdicts", "summaries", "evidence")]
    want = shown(plan.verify(docs, provider))
    monkeypatch.setattr(plan, "PART", 2)
    before = len(runtime._written)
    assert shown(plan.verify(docs, provider)) == want
    stored = [spark.read.parquet(path).columns for _, path in runtime._written[before:]]
    assert sum("stance" in c for c in stored) > 1 and not [c for c in stored if {"_c", "_low", "codes"} & set(c)]


def test_finder():
    from attestor.operators.match import finder

    found = finder("Delhi metro  rail\nline of the city ")
    assert all(map(found, ("", "elh", "rail\nli", "metro  ra", "o", "city ", " "))) and not any(map(found, ("metrorail", "metro rail", "cityD", "x")))
