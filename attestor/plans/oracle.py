"""The queries' results in DuckDB's SQL, built from the same vocabularies.

RE2 knows only ASCII words, so texts are first brought to ASCII with the same word boundaries: letters and
numbers beyond ASCII become x, other characters beyond ASCII become spaces.
"""

from __future__ import annotations

from attestor.functions import lexicon as lx
from attestor.functions.dialect import one_of
from attestor.functions import text as tx
from attestor.plans import fixtures as fx

W = r"[\p{L}\p{N}_]"
S = r"[\s\p{Z}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def plain(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[^[:ascii:]\p{{L}}\p{{N}}]', ' ', 'g'), '[^[:ascii:]]', 'x', 'g')"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{S}+'), lambda w: w <> '')"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[ऀ-ॿ\p{{L}}\p{{N}}_]+')"


def whole(entries, gap: str = r"\s+") -> str:
    return rf"\b{one_of(entries, gap)}\b"


def matches(x: str, pattern: str, fold: bool = False) -> str:
    return f"regexp_matches({plain(x)}, {quoted(pattern)}{', ' + quoted('i') if fold else ''})"


#: Stands for a point that does not end a sentence.
DOT = "@@DOT@@"
NUMERIC = r"\b\d+(?:\.\d+)?%?\b"
KEYWORDS = lx.MONTHS + lx.MONEY_WORDS + lx.REPORT_VERBS + lx.INSTITUTIONS


def facts(x: str) -> str:
    words_ = rf"len(list_filter(regexp_extract_all(lower({x}), '{W}+'), lambda w: list_contains({listed(KEYWORDS)}, w)))"
    signs = f"len(regexp_extract_all({x}, '[{lx.CURRENCY}]'))"
    hindi = f"len(regexp_extract_all({x}, {quoted('|'.join(lx.HINDI_FACTS))}))"
    return f"({words_} + len(regexp_extract_all({plain(x)}, {quoted(NUMERIC)})) + {signs} + {hindi})"


def sentence_list(x: str) -> str:
    out = trimmed(f"coalesce({x}, '')")
    for pattern, by in (
        (rf"(^|[^\p{{L}}\p{{N}}_])(e)\.(g)\.|(^|[^\p{{L}}\p{{N}}_])(i)\.(e)\.", rf"\1\4\2\5{DOT}\3\6{DOT}"),
        (rf"(^|[^\p{{L}}\p{{N}}_])(u)\.([skn])\.", rf"\1\2{DOT}\3{DOT}"),
        (rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(lx.ABBREVIATIONS)})\.", rf"\1\2{DOT}"),
    ):
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(by)}, 'gi')"
    out = rf"regexp_replace({out}, '(\d+)\.(\d+)', '\1{DOT}\2', 'g')"
    out = rf"string_split(regexp_replace({out}, '([.!?।॥]){S}+|\n+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({out}, lambda s: {trimmed(f'replace(s, {quoted(DOT)}, {quoted('.')})')}), lambda s: s <> '')"


TEXTS = f"SELECT doc_id, text FROM documents UNION ALL {fx.values('doc_id, text', [(-1 - i, t) for i, t in enumerate(fx.SENTENCES)])}"
SENTENCES = f"""texts AS ({TEXTS}),
    parts AS (SELECT doc_id, {sentence_list('text')} AS l FROM texts),
    s AS (SELECT doc_id, unnest(range(len(l))) AS idx, unnest(l) AS sentence FROM parts)"""


def viable(x: str) -> str:
    opinion = matches(x, whole(lx.OPINIONS), True)
    return (
        f"(length({x}) >= 20 AND len({words(x)}) >= 4 AND NOT contains({x}, '?') AND NOT ends_with({x}, '؟') "
        f"AND ({facts(x)} > 0 OR (NOT ends_with({x}, '!') AND NOT {opinion})))"
    )


def priority(x: str) -> str:
    later = f"({words(x)})[2:]"
    names = rf"len(list_filter({later}, lambda w: regexp_full_match(w, '\p{{Lu}}\p{{L}}*')))"
    hindi = f"least(3, len(list_filter({later}, lambda w: regexp_matches(w, '[ऀ-ॿ]') AND length(w) >= 3 AND NOT list_contains({listed(lx.HINDI_STOPWORDS)}, w))))"
    bonus = f"CASE WHEN {matches(x, NUMERIC)} THEN 3 ELSE 0 END"
    return f"(2 * {facts(x)} + {bonus} + {names} + {hindi})"


def suffix_of(domain: str, registry) -> str:
    return f"len(list_filter({listed(registry)}, lambda r: lower({domain}) = r OR ends_with(lower({domain}), '.' || r))) > 0"


def tier(domain: str) -> str:
    return (
        f"CASE WHEN {suffix_of(domain, lx.GOVERNMENT)} THEN 'Government / Official' WHEN {suffix_of(domain, lx.INSTITUTIONAL)} THEN 'Institutional / Regulatory' "
        f"WHEN {suffix_of(domain, lx.NEWS)} THEN 'Reputable News' ELSE 'General' END"
    )


def category(domain: str) -> str:
    return (
        f"CASE WHEN {suffix_of(domain, lx.GOVERNMENT + lx.INSTITUTIONAL)} THEN 'PRIMARY_OFFICIAL' WHEN {suffix_of(domain, lx.ACADEMIC)} THEN 'ACADEMIC_RESEARCH' "
        f"WHEN {suffix_of(domain, lx.NEWS)} THEN 'FACTUAL_REPORTING' ELSE 'GENERAL_WEB' END"
    )


def domain_of(url: str) -> str:
    host = rf"regexp_extract(coalesce({url}, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"
    return rf"regexp_replace(string_split(lower({host}), ':')[1], '^www\.', '')"


URLS = f"SELECT page_id, url FROM pages UNION ALL {fx.values('page_id, url', [(-1 - i, u) for i, u in enumerate(fx.URLS)])}"
EVIDENCE = fx.values(fx.EVIDENCE_COLUMNS, fx.EVIDENCE)
JUDGED = fx.values(fx.JUDGED_COLUMNS, fx.JUDGED)
CLAIMS = fx.values("doc_id, claim_id, claim_text", fx.JUDGED_CLAIMS)

_BOTH = "concat_ws(' ', title, snippet)"
AGENCY = "CASE " + " ".join(f"WHEN {matches(_BOTH, p, True)} THEN {quoted(a)}" for a, p in lx.WIRES) + " END"
OPINION = (
    f"CASE WHEN regexp_matches(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), {quoted(lx.OPINION_PATH)}, 'i') THEN 'URL' "
    f"WHEN regexp_matches(title, {quoted(lx.OPINION_TITLE)}, 'i') THEN 'TITLE' WHEN regexp_matches(snippet, {quoted(lx.OPINION_TITLE)}, 'i') THEN 'SNIPPET' END"
)
_SHOUTS = f"len(regexp_extract_all({plain('title')}, {quoted(whole(lx.SHOUTS, " "))}))"
CLICKBAIT = f"(regexp_matches(title, '[!?]{{2,}}') OR {_SHOUTS} >= 2 OR ({_SHOUTS} = 1 AND len({words('title')}) <= 6) OR {matches('title', lx.BAIT, True)})"
QUOTES = f"(regexp_matches({_BOTH}, {quoted(lx.QUOTE)}) OR contains(lower({_BOTH}), 'according to'))"
METRICS = f"(regexp_matches({_BOTH}, '[0-9]') AND {matches(_BOTH, r'\b\d')} OR {matches(_BOTH, lx.LEGAL, True)})"
_NAMED = "title || '. ' || snippet"
NAMED = "(" + " OR ".join(matches(_NAMED, p, fold) for p, _, fold in lx.NAMED_SOURCES) + ")"

FLAGS = f"""f0 AS (
        SELECT *, {AGENCY} AS agency, {OPINION} AS opinion_reason, {CLICKBAIT} AS is_clickbait, {QUOTES} AS has_quotes, {METRICS} AS has_metrics,
               {NAMED} AS has_named, coalesce(publication_date, '') <> '' AS has_date, {category('domain')} AS provenance
        FROM ({EVIDENCE})),
    f1 AS (SELECT *, agency IS NOT NULL AND NOT list_contains({listed(lx.AGENCY_SITES)}, lower(trim(domain))) AS is_wire FROM f0),
    f2 AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id, claim_id, CASE WHEN is_wire THEN agency END ORDER BY pos) AS nth_feed,
               row_number() OVER (PARTITION BY doc_id, claim_id, lower(trim(domain)) ORDER BY pos) AS nth_site FROM f1),
    f3 AS (SELECT *, is_wire AND nth_feed > 1 AS duplicate_wire FROM f2),
    f4 AS (SELECT *, trim(domain) <> '' AND nth_site > 1 AND NOT duplicate_wire AS duplicate_domain FROM f3),
    f5 AS (
        SELECT *, CASE WHEN is_clickbait THEN 'SENSATIONAL_CLICKBAIT' WHEN opinion_reason IS NOT NULL THEN 'OPINION_EDITORIAL' WHEN is_wire THEN 'SYNDICATED_WIRE'
               ELSE provenance END AS category, opinion_reason IS NOT NULL AS is_opinion, level <> 'IRRELEVANT' AS is_relevant,
               provenance IN ('PRIMARY_OFFICIAL', 'ACADEMIC_RESEARCH') AS primary_, NOT duplicate_wire AND NOT duplicate_domain AS own FROM f4),
    f6 AS (
        SELECT *, greatest(5, least(100, CASE category {' '.join(f"WHEN '{k}' THEN {v}" for k, v in lx.QUALITY.items())} END
               + CASE WHEN has_date THEN 5 ELSE -5 END + CASE WHEN has_metrics THEN 3 ELSE 0 END
               + CASE WHEN has_quotes AND category NOT IN ('OPINION_EDITORIAL', 'SENSATIONAL_CLICKBAIT') THEN 5 ELSE 0 END
               + CASE WHEN has_named AND category NOT IN ('OPINION_EDITORIAL', 'SENSATIONAL_CLICKBAIT') THEN 5 ELSE 0 END
               - CASE WHEN is_clickbait THEN 25 ELSE 0 END - CASE WHEN duplicate_wire THEN 20 ELSE 0 END)) AS q FROM f5),
    f7 AS (
        SELECT *, CASE WHEN level = 'IRRELEVANT' THEN 'INSUFFICIENT' WHEN level = 'WEAK' OR is_opinion OR is_clickbait OR q < 40 THEN 'WEAK'
               WHEN NOT own THEN CASE WHEN q >= 60 THEN 'MODERATE' ELSE 'WEAK' END WHEN level = 'DIRECT' AND (primary_ OR q >= 70) THEN 'STRONG'
               WHEN q >= 50 THEN 'MODERATE' ELSE 'WEAK' END AS evidence_strength,
               CASE WHEN is_relevant THEN q ELSE greatest(5, least(q, 20)) END AS quality_score, is_relevant AND primary_ AS is_primary, is_relevant AND own AS is_independent
        FROM f6)"""

STREAMS = f"""j AS (SELECT * REPLACE (CAST(weight AS DOUBLE) AS weight) FROM ({JUDGED})),
    k AS (SELECT *, coalesce(nullif(lower(trim(domain)), ''), evidence_id) AS stream,
          CASE WHEN stance = 'SUPPORTS' AND level IN ('DIRECT', 'PARTIAL') AND is_relevant THEN 's'
               WHEN stance = 'CONTRADICTS' AND level IN ('DIRECT', 'PARTIAL') AND is_relevant AND evidence_strength IN ('STRONG', 'MODERATE') THEN 'x' END AS side FROM j),
    m AS (SELECT doc_id, claim_id, side, stream, max(weight) AS w FROM k WHERE side IS NOT NULL AND is_independent GROUP BY ALL),
    t AS (SELECT doc_id, claim_id, sum(CASE WHEN side = 's' THEN w ELSE 0 END) AS ss, sum(CASE WHEN side = 'x' THEN w ELSE 0 END) AS xs,
          count(CASE WHEN side = 's' THEN 1 END) AS sn, count(CASE WHEN side = 'x' THEN 1 END) AS xn FROM m GROUP BY ALL)"""
VERDICT = f"""{STREAMS},
    a AS (
        SELECT doc_id, claim_id, count(*) AS n, count_if(is_relevant) AS relevant_count, count_if(side = 's') AS ns, count_if(side = 'x') AS nx,
               count_if(side = 's' AND is_primary) > 0 AS sp, count_if(side = 'x' AND is_primary) > 0 AS xp,
               count_if(stance = 'SUPPORTS' AND is_relevant AND is_independent AND level = 'DIRECT' AND evidence_strength = 'STRONG') AS strong_s,
               count_if(stance = 'CONTRADICTS' AND is_relevant AND is_independent AND level = 'DIRECT' AND evidence_strength = 'STRONG') AS strong_x,
               count_if(stance = 'SUPPORTS' AND is_relevant AND is_independent AND level = 'DIRECT' AND evidence_strength IN ('STRONG', 'MODERATE') AND weight >= 0.5) > 0 AS solid,
               count_if(stance = 'SUPPORTS' AND is_relevant AND evidence_strength = 'STRONG') > 0 AS any_s,
               count_if(stance = 'CONTRADICTS' AND is_relevant AND evidence_strength = 'STRONG') > 0 AS any_x,
               count_if(stance <> 'NEUTRAL_IRRELEVANT' AND is_relevant) > 0 AS leaning,
               count_if(is_primary AND is_relevant) AS primary_count, count_if(is_independent AND NOT is_opinion AND is_relevant) AS independent_count,
               list_sort(list_distinct(list(CASE WHEN is_relevant AND domain <> '' THEN domain END))) AS domains,
               array_to_string(list(evidence_id ORDER BY quality_score DESC, pos) FILTER (side = 's'), ',') AS supporting,
               array_to_string(list(evidence_id ORDER BY quality_score DESC, pos) FILTER (side = 'x'), ',') AS contradicting
        FROM k GROUP BY ALL),
    b AS (
        SELECT c.doc_id, c.claim_id, c.claim_text, coalesce(n, 0) AS n, coalesce(relevant_count, 0) AS relevant_count, coalesce(ns, 0) AS ns, coalesce(nx, 0) AS nx,
               coalesce(sp, false) AS sp, coalesce(xp, false) AS xp, coalesce(ss, 0) AS ss, coalesce(xs, 0) AS xs, coalesce(sn, 0) AS sn, coalesce(xn, 0) AS xn,
               strong_s, strong_x, solid, any_s, any_x, coalesce(leaning, false) AS leaning, coalesce(primary_count, 0) AS primary_count,
               coalesce(independent_count, 0) AS independent_count, coalesce(domains, []) AS domains, coalesce(supporting, '') AS supporting, coalesce(contradicting, '') AS contradicting
        FROM ({CLAIMS}) c LEFT JOIN a USING (doc_id, claim_id) LEFT JOIN t USING (doc_id, claim_id)),
    v AS (
        SELECT *, CASE WHEN n = 0 THEN 'NO_EVIDENCE' WHEN ns > 0 AND nx > 0 AND sp AND NOT xp AND ss > xs * 1.5 THEN 'PRIMARY_SUPPORT'
               WHEN ns > 0 AND nx > 0 AND xp AND NOT sp AND xs > ss * 1.5 THEN 'PRIMARY_CONTRADICTION' WHEN ns > 0 AND nx > 0 THEN 'DISPUTED'
               WHEN ns > 0 AND (sp OR strong_s >= 1 OR solid OR sn >= 2) THEN 'SUPPORT' WHEN ns > 0 THEN 'WEAK_SUPPORT'
               WHEN nx > 0 AND (xp OR strong_x >= 1 OR xs >= 0.7) THEN 'CONTRADICTION' WHEN nx > 0 THEN 'WEAK_CONTRADICTION'
               WHEN relevant_count = 0 THEN 'ALL_FILTERED' ELSE 'NEUTRAL_ONLY' END AS basis FROM b),
    w AS (
        SELECT *, CASE WHEN basis IN ('PRIMARY_SUPPORT', 'SUPPORT') THEN 'SUPPORTED' WHEN basis IN ('PRIMARY_CONTRADICTION', 'CONTRADICTION') THEN 'CONTRADICTED'
               ELSE 'UNCERTAIN' END AS final_stance FROM v),
    x AS (
        SELECT *, CASE WHEN final_stance = 'SUPPORTED' THEN CASE WHEN sp OR any_s THEN 'STRONG' WHEN ss >= 0.6 THEN 'MODERATE' ELSE 'WEAK' END
               WHEN final_stance = 'CONTRADICTED' THEN CASE WHEN xp OR any_x THEN 'STRONG' ELSE 'MODERATE' END
               WHEN ns > 0 AND nx > 0 THEN 'MODERATE' WHEN leaning THEN 'WEAK' ELSE 'INSUFFICIENT' END AS strength FROM w)"""


def importance(x: str) -> str:
    metrics = rf"({matches(x, r'\b\d+(?:\.\d+)?%\b')} OR regexp_matches({x}, '[{lx.CURRENCY}]'))"
    measured = rf"({metrics} OR {matches(x, r'\b\d{2,}\b')})"
    official, general = matches(x, whole(lx.OFFICIAL_ACTIONS), True), matches(x, whole(lx.GENERAL_ACTIONS), True)
    dated = matches(x, rf"\b(?:19\d\d|20\d\d|{'|'.join(lx.MONTHS)})\b", True)
    names = rf"len(list_filter(({words(x)})[2:], lambda w: regexp_full_match(w, '\p{{Lu}}\p{{L}}*'))) >= 2"
    return f"CASE WHEN {measured} AND {official} THEN 'HIGH' WHEN {official} OR ({measured} AND {general}) OR {dated} OR {names} THEN 'MEDIUM' ELSE 'LOW' END"


def directions(x: str) -> str:
    found = ", ".join(f"CASE WHEN list_has_any({tokens(x)}, {listed(v)}) THEN '{k}' END" for k, v in sorted(lx.DIRECTIONS.items()))
    return f"array_to_string(list_filter([{found}], lambda d: d IS NOT NULL), ',')"


ORACLE_SQL = {
    "validate_text": f"""SELECT doc_id, CASE WHEN t = '' THEN 'EMPTY_TEXT' WHEN length(t) < 20 THEN 'TOO_SHORT' WHEN length(t) > 50000 THEN 'TOO_LONG'
        WHEN len({words('t')}) < 3 THEN 'TOO_FEW_WORDS' END AS error_code, CAST(length(t) AS INTEGER) AS character_count, CAST(len({words('t')}) AS INTEGER) AS word_count
        FROM (SELECT doc_id, {trimmed("coalesce(text, '')")} AS t FROM ({TEXTS}))""",
    "validate_url": rf"""SELECT page_id, CASE WHEN u = '' THEN 'EMPTY_URL' WHEN contains(u, ' ') THEN 'SPACES' WHEN sch NOT IN ('http', 'https') THEN 'BAD_PROTOCOL'
        WHEN NOT regexp_matches(host, '^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\.)+[a-zA-Z]{{2,}}$|^localhost$') THEN 'BAD_DOMAIN' END AS error_code, host AS domain
        FROM (SELECT page_id, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS sch,
              string_split(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), ':')[1] AS host
              FROM (SELECT page_id, {trimmed("coalesce(url, '')")} AS u FROM ({URLS})))""",
    "url_domain": f"SELECT page_id, domain, {tier('domain')} AS tier, {category('domain')} AS category FROM (SELECT page_id, {domain_of('url')} AS domain FROM ({URLS}))",
    "clean_text": rf"""SELECT doc_id, {trimmed(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, chr(160) || chr(8203) || chr(65279) || chr(8206) || chr(8207), ' '), '[ \t]*\n[ \t]*', chr(10), 'g'), '[ \t]+', ' ', 'g'), '[\s\p{Z}]+([,.;:!?])', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS cleaned FROM ({TEXTS})""",
    "sentences": f"WITH {SENTENCES} SELECT doc_id, CAST(idx AS INTEGER) AS idx, sentence FROM s",
    "viable_claims": f"WITH {SENTENCES} SELECT doc_id, CAST(idx AS INTEGER) AS idx FROM s WHERE {viable('sentence')}",
    "claim_priority": f"WITH {SENTENCES} SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST({priority('sentence')} AS INTEGER) AS priority_score FROM s",
    "top_claims": f"""WITH {SENTENCES},
        v AS (SELECT *, {viable('sentence')} AS ok FROM s),
        p AS (SELECT doc_id, idx, sentence, {priority('sentence')} AS score FROM v WHERE ok),
        f AS (SELECT doc_id, min(idx) AS idx FROM s WHERE length(sentence) >= 20 AND NOT ends_with(sentence, '?') AND doc_id NOT IN (SELECT doc_id FROM p) GROUP BY doc_id),
        c AS (SELECT * FROM p UNION ALL SELECT s.doc_id, s.idx, s.sentence, 1 FROM s JOIN f USING (doc_id, idx)),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS k FROM c)
        SELECT doc_id, 'C' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS VARCHAR), 3, '0') AS claim_id, sentence AS text,
               CAST(idx AS INTEGER) AS source_sentence_index, CAST(score AS INTEGER) AS priority_score
        FROM r WHERE k <= 5""",
    "importance": f"WITH {SENTENCES} SELECT doc_id, CAST(idx AS INTEGER) AS idx, {importance('sentence')} AS importance FROM s",
    "negation": f"""WITH {SENTENCES} SELECT doc_id, CAST(idx AS INTEGER) AS idx, {matches('sentence', whole(lx.NEGATIONS, " "), True)}
        OR regexp_matches(sentence, '(^|[^\\p{{L}}\\p{{N}}_])(इनकार|खारिज|गलत|झूठ)([^\\p{{L}}\\p{{N}}_]|$)') AS is_negated FROM s""",
    "attribution": f"""WITH {SENTENCES} SELECT doc_id, CAST(idx AS INTEGER) AS idx, nullif(lower(regexp_extract({plain('sentence')}, {quoted(tx.ATTRIBUTION)}, 0, 'i')), '') AS attribution FROM s""",
    "dates": f"""WITH {SENTENCES} SELECT doc_id, CAST(idx AS INTEGER) AS idx, array_to_string(list_sort(list_distinct(list_concat(
        regexp_extract_all({plain('sentence')}, '\\b(?:19\\d\\d|20\\d\\d)\\b'), list_transform(regexp_extract_all({plain('sentence')}, {quoted(whole(lx.MONTHS))}, 0, 'i'), lambda m: lower(m))))), ',') AS dates FROM s""",
    "numbers": f"""WITH {SENTENCES}, r AS (SELECT doc_id, idx, regexp_extract_all({plain('sentence')}, '\\$?\\b\\d+(?:\\.\\d+)?%?') AS l FROM s),
        n AS (SELECT doc_id, idx, unnest(range(len(l))) AS pos, unnest(l) AS raw FROM r),
        v AS (SELECT *, CAST(trim(raw, '%,$ ') AS DOUBLE) AS val FROM n)
        SELECT doc_id, CAST(idx AS INTEGER) AS idx, val, max_by(raw, pos) AS raw FROM v
        WHERE NOT (regexp_full_match(raw, '\\d{{4}}') AND val BETWEEN 1900 AND 2100) GROUP BY doc_id, idx, val""",
    "fetch_status": f"""WITH u AS ({URLS}), f AS (
            SELECT page_id, url, [200, 401, 403, 404, 410, 429, 500, 503][((page_id % 8) + 8) % 8 + 1] AS http,
                   CASE WHEN page_id % 11 = 0 THEN 'TIMEOUT' WHEN page_id % 13 = 0 THEN 'SSL' END AS failure, page_id % 3 = 0 AS pdf FROM u)
        SELECT page_id, CASE WHEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) NOT IN ('http', 'https') THEN 'INVALID_URL' WHEN failure = 'TIMEOUT' THEN 'TIMEOUT'
               WHEN failure = 'SSL' THEN 'NETWORK_ERROR' WHEN http IN (401, 403) THEN 'ACCESS_DENIED' WHEN http = 429 THEN 'RATE_LIMITED' WHEN http = 404 THEN 'NOT_FOUND'
               WHEN http BETWEEN 400 AND 499 THEN 'CLIENT_ERROR' WHEN http >= 500 THEN 'SERVER_ERROR' WHEN pdf THEN 'NON_HTML' ELSE 'HTML' END AS status FROM f""",
    "action_directions": f"WITH {SENTENCES} SELECT doc_id, CAST(idx AS INTEGER) AS idx, {directions('sentence')} AS directions FROM s",
    "predicate_counts": f"""WITH {SENTENCES}, p AS (SELECT doc_id, idx, list_transform(regexp_split_to_array(sentence, '(?i){S}+(?:and|while|as well as){S}+'), lambda x: {trimmed('x')}) AS l FROM s)
        SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(CASE WHEN len(l) >= 2 AND {matches('l[1]', whole(lx.PREDICATE_VERBS), True)} AND {matches('l[2]', whole(lx.PREDICATE_VERBS), True)} THEN 2 ELSE 1 END AS INTEGER) AS n_predicates FROM p""",
    "paragraph_dedup": f"""WITH p AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM ({TEXTS}))),
        n AS (SELECT *, array_to_string({words('lower(line)')}, ' ') AS norm FROM p WHERE length(line) >= 20 AND len({words('line')}) >= 4),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY pos) AS k FROM n)
        SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM r WHERE k = 1""",
    "source_flags": f"""WITH {FLAGS} SELECT doc_id, claim_id, evidence_id, provenance, opinion_reason, is_clickbait, agency, is_wire, has_quotes, has_metrics, has_named FROM f7""",
    "independence": f"WITH {FLAGS} SELECT doc_id, claim_id, evidence_id, duplicate_wire, duplicate_domain FROM f7",
    "quality": f"WITH {FLAGS} SELECT doc_id, claim_id, evidence_id, category, CAST(quality_score AS INTEGER) AS quality_score, is_primary, is_independent, evidence_strength FROM f7",
    "claim_eval_summary": f"""WITH {FLAGS} SELECT doc_id, claim_id, count_if(is_relevant) AS relevant_count, count_if(is_relevant AND is_primary) AS primary_count,
        count_if(is_relevant AND is_independent AND NOT is_opinion) AS independent_count, count_if(is_relevant AND is_opinion) AS opinion_count,
        count_if(is_relevant AND NOT is_independent) AS duplicate_wire_count, count_if(is_relevant AND is_wire) AS syndicated_count, count_if(NOT is_relevant) AS filtered_count,
        coalesce(array_to_string(list_sort(list_distinct(list(nullif(domain, '')))), ','), '') AS domains,
        CASE WHEN count_if(is_relevant AND is_primary) >= 1 OR count_if(is_relevant AND is_independent AND NOT is_opinion) >= 2 THEN 'SUFFICIENT'
             WHEN count_if(is_relevant) > 0 THEN 'INSUFFICIENT' WHEN count_if(NOT is_relevant) > 0 THEN 'ALL_FILTERED' ELSE 'NO_EVIDENCE' END AS assessment
        FROM f7 GROUP BY doc_id, claim_id""",
    "diversity_cap": f"""WITH r AS (SELECT page_id % 20 AS doc_id, page_id AS rank, lower(url) AS url, {domain_of('url')} AS domain FROM pages),
        a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, url ORDER BY rank) AS n1 FROM r),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, domain ORDER BY rank) AS n2 FROM a WHERE n1 = 1),
        c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS pos FROM b WHERE n2 <= 2)
        SELECT doc_id, rank, domain, 'E' || lpad(CAST(pos AS VARCHAR), 3, '0') AS evidence_id FROM c WHERE pos <= 3""",
    "registry_search": f"""WITH reg AS ({fx.values('seq, key', [(1, 'the of'), (2, 'enbe'), (3, 'que des'), (4, 'a')])}),
        q AS (SELECT item_id AS query_key, lower({trimmed('text')}) AS q FROM benchmark),
        t AS (SELECT *, list_distinct(regexp_extract_all(q, '{W}+')) AS qt FROM q),
        k AS (SELECT seq, key, list_distinct(regexp_extract_all(key, '{W}+')) AS kt FROM reg)
        SELECT query_key, min_by(key, seq) AS key FROM t JOIN k ON contains(q, key) OR contains(key, q) OR list_has_all(qt, kt) OR list_has_all(kt, qt) GROUP BY query_key""",
    "stream_consensus": f"WITH {STREAMS} SELECT doc_id, claim_id, side, count(*) AS streams, round(sum(w), 6) AS score FROM m GROUP BY ALL",
    "claim_verdict": f"""WITH {VERDICT} SELECT doc_id, claim_id, {importance('claim_text')} AS importance, basis, final_stance, strength AS evidence_strength, supporting, contradicting,
        round(ss, 6) AS support_score, round(xs, 6) AS contradict_score, CAST(sn AS INTEGER) AS support_streams, CAST(xn AS INTEGER) AS contradict_streams FROM x""",
    "article_report": f"""WITH {VERDICT}, y AS (SELECT *, {importance('claim_text')} AS imp FROM x),
        z AS (SELECT doc_id, count(*) AS total_claims, count_if(final_stance = 'SUPPORTED') AS s, count_if(final_stance = 'CONTRADICTED') AS c, count_if(final_stance = 'UNCERTAIN') AS u,
              count_if(imp = 'HIGH') AS h, count_if(imp = 'HIGH' AND final_stance = 'SUPPORTED') AS hs, count_if(imp = 'HIGH' AND final_stance = 'CONTRADICTED') AS hc,
              sum(primary_count) AS total_primary, sum(independent_count) AS total_independent, len(list_distinct(flatten(list(domains)))) AS nd FROM y GROUP BY doc_id)
        SELECT doc_id, total_claims, s AS supported_claims, c AS contradicted_claims, u AS uncertain_claims, h AS high_importance_claims,
               CAST(total_primary AS BIGINT) AS total_primary, CAST(total_independent AS BIGINT) AS total_independent, CAST(nd AS INTEGER) AS total_unique_domains,
               CASE WHEN hc > 0 THEN CASE WHEN hs > 0 THEN 'MIXED' ELSE 'LIKELY_CONTRADICTED' END WHEN c > 0 THEN CASE WHEN s > 0 THEN 'MIXED' ELSE 'LIKELY_CONTRADICTED' END
                    WHEN s > 0 AND ((h > 0 AND hs * 2 >= h) OR s * 2 >= total_claims) THEN 'LIKELY_SUPPORTED' ELSE 'INSUFFICIENT_EVIDENCE' END AS overall_assessment FROM z""",
    "verdict_rollup": f"WITH {VERDICT} SELECT doc_id, final_stance, count(*) AS n FROM x GROUP BY CUBE (doc_id, final_stance)",
}
