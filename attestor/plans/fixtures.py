"""Small inline tables that queries and their SQL share, as VALUES that both dialects read."""

from __future__ import annotations


def values(columns: str, rows: list[tuple]) -> str:
    """A SELECT over VALUES; text is quoted, None is NULL."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


SENTENCES = [
    "Dr. Smith met the U.S. envoy in Jan. 2024. The repo rate was 6.5% last year.",
    "Is this a question that nobody can check? In my opinion the film should be better.",
    "The government announced a $20 billion budget in March 2024 and the court approved it.",
    "Police detained 40 students at 5 PM and used tear gas near the station.",
    "The minister said the bank did not increase the rate to 6.25% in 2025!",
    "Prices rose 12,000 to 13.5 after e.g. wheat fell; approx. 3 in 10 agree.",
    "भारत सरकार ने नई योजना की घोषणा की। अदालत ने फैसला खारिज किया।",
    "NASA and ISRO launched the NISAR satellite on Monday. No comment was made by anyone.",
    "According to officials, the company won the award while its rival lost the case.",
    "What a wonderful day it is today!",
    "Übergrößenträger haben 5x gewählt, sagte er im Mai 2019.\nNew line here with five words.",
    "",
]
URLS = [
    "https://www.rbi.org.in/press", "http://pib.gov.in:8080/a?b=c", "https://blog.example.co.uk/opinion/x", "ftp://files.example.com/a", "https://invalid_host/x",
    "https://example .com/news", "", "not-a-url", "https://localhost/x", "HTTPS://News.BBC.co.uk/Path/", "https://cs.stanford.edu/y",
    "https://sub.reuters.com/z", "https://arxiv.org/abs/1", "https://notreuters.com/",
]
EVIDENCE_COLUMNS = "doc_id, claim_id, evidence_id, pos, title, url, domain, snippet, publication_date, level"
EVIDENCE = [
    (1, "C001", "E001", 1, "RBI keeps rate at 6.5%", "https://rbi.org.in/a", "rbi.org.in", "The bank said \"rates stay unchanged for now\".", "2024-02-08", "DIRECT"),
    (1, "C001", "E002", 2, "Rate unchanged: PTI", "https://one.example/a", "one.example", "Press Trust of India reports no change.", "2024-02-08", "DIRECT"),
    (1, "C001", "E003", 3, "Rate stays", "https://two.example/a", "two.example", "PTI said that the rate stays.", None, "PARTIAL"),
    (1, "C001", "E004", 4, "More on the rate", "https://one.example/b", "one.example", "Nothing new.", None, "DIRECT"),
    (1, "C002", "E001", 1, "Opinion: why rates must fall", "https://x.example/opinion/a", "x.example", "We think so.", None, "PARTIAL"),
    (1, "C002", "E002", 2, "SHOCKING BOMBSHELL over rates???", "https://y.example/a", "y.example", "You will not believe it.", None, "DIRECT"),
    (1, "C002", "E003", 3, "Weather", "https://z.example/a", "z.example", "Rain is coming.", "2024-01-01", "IRRELEVANT"),
    (2, "C001", "E001", 1, "Reuters: chip launched", "https://reuters.com/a", "reuters.com", "Reuters news service. Spokesperson said 40 units were sold.", "2025-05-05", "DIRECT"),
    (2, "C001", "E002", 2, "Chip launched", "https://www.bbc.com/a", "bbc.com", "According to John Smith the chip is out.", "2025-05-06", "DIRECT"),
    (2, "C001", "E003", 3, "Chip", "", "", "ANI copy.", None, "WEAK"),
    (2, "C001", "E004", 4, "Chip again", "", "", "ANI copy.", None, "DIRECT"),
    (3, "C001", "E001", 1, "Study", "https://arxiv.org/a", "arxiv.org", "We observe 5 effects under section 4.", "2023", "PARTIAL"),
]
JUDGED_COLUMNS = (
    "doc_id, claim_id, evidence_id, pos, domain, level, quality_score, is_primary, is_independent, is_opinion, is_wire, is_relevant, evidence_strength, stance, weight, demotion_reason"
)


def _judged() -> list[tuple]:
    """Claims that meet every rule of the verdict; weights are exact in binary where a threshold is met."""
    s, x, n = "SUPPORTS", "CONTRADICTS", "NEUTRAL_IRRELEVANT"
    cases = [
        [(s, "DIRECT", 90, True, True, "STRONG", 0.9, "gov.in")],
        [(s, "DIRECT", 75, False, True, "STRONG", 0.75, "a.com"), (s, "PARTIAL", 60, False, True, "MODERATE", 0.6, "b.com")],
        [(s, "PARTIAL", 50, False, True, "MODERATE", 0.5, "a.com")],
        [(s, "PARTIAL", 50, False, True, "WEAK", 0.25, "a.com"), (s, "PARTIAL", 50, False, True, "WEAK", 0.25, "b.com")],
        [(s, "DIRECT", 75, False, True, "STRONG", 0.75, "a.com"), (s, "DIRECT", 75, False, False, "MODERATE", 0.375, "a.com")],
        [(x, "DIRECT", 75, False, True, "STRONG", 0.75, "a.com")],
        [(x, "PARTIAL", 55, False, True, "MODERATE", 0.5, "a.com")],
        [(x, "PARTIAL", 55, False, True, "MODERATE", 0.35, "a.com"), (x, "PARTIAL", 55, False, True, "MODERATE", 0.35, "b.com")],
        [(x, "DIRECT", 35, False, True, "WEAK", 0.1, "a.com")],
        [(s, "DIRECT", 80, False, True, "STRONG", 0.8, "a.com"), (x, "DIRECT", 80, False, True, "STRONG", 0.8, "b.com")],
        [(s, "DIRECT", 95, True, True, "STRONG", 0.95, "gov.in"), (x, "DIRECT", 50, False, True, "MODERATE", 0.5, "b.com")],
        [(x, "DIRECT", 95, True, True, "STRONG", 0.95, "gov.in"), (s, "DIRECT", 50, False, True, "MODERATE", 0.5, "b.com")],
        [(n, "WEAK", 50, False, True, "WEAK", 0.0, "a.com")],
        [(n, "IRRELEVANT", 20, False, False, "INSUFFICIENT", 0.0, "a.com")],
        [(n, "DIRECT", 70, False, True, "STRONG", 0.7, ""), (s, "DIRECT", 60, False, True, "MODERATE", 0.6, "")],
        [],
    ]
    rows = []
    for i, case in enumerate(cases):
        for j, (stance, level, quality, primary, own, strength, weight, domain) in enumerate(case, 1):
            gone = level == "IRRELEVANT"
            rows.append((i // 4, f"C{i % 4 + 1:03d}", f"E{j:03d}", j, domain, level, quality, primary, own, False, False, not gone, strength, stance, weight, "IRRELEVANT" if gone else None))
    return rows


JUDGED = _judged()
JUDGED_CLAIMS = [
    (i // 4, f"C{i % 4 + 1:03d}", "The court banned 40 firms in 2024." if i % 3 == 0 else "The court announced 40 cases." if i % 3 == 1 else "Things happen slowly here.")
    for i in range(16)
]
