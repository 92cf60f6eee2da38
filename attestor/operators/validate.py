"""Input validation: texts, URLs, and the choice between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.dialect import split_words, strip

#: Bounds of a text.
LEAST_CHARS, LEAST_WORDS, MOST_CHARS = 20, 3, 50_000
_HOST = r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$|^localhost$"
_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)"


def check_text(text: Column) -> Column:
    """A struct: error_code (null if valid), cleaned, character_count, word_count."""
    clean = strip(F.coalesce(text, F.lit("")))
    n, words = F.length(clean), F.size(split_words(clean))
    code = F.when(n == 0, "EMPTY_TEXT").when(n < LEAST_CHARS, "TOO_SHORT").when(n > MOST_CHARS, "TOO_LONG").when(words < LEAST_WORDS, "TOO_FEW_WORDS")
    return F.struct(code.alias("error_code"), clean.alias("cleaned"), n.alias("character_count"), words.alias("word_count"))


def check_url(url: Column) -> Column:
    """A struct: error_code (null if valid), cleaned, scheme, domain, path."""
    clean = strip(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(clean, _URL, 1))
    host = F.get(F.split(F.lower(F.regexp_extract(clean, _URL, 2)), ":"), F.lit(0))
    code = (
        F.when(clean == "", "EMPTY_URL")
        .when(F.contains(clean, F.lit(" ")), "SPACES")
        .when(~scheme.isin("http", "https"), "BAD_PROTOCOL")
        .when(~F.rlike(host, F.lit(_HOST)), "BAD_DOMAIN")
    )
    return F.struct(code.alias("error_code"), clean.alias("cleaned"), scheme.alias("scheme"), host.alias("domain"), F.regexp_extract(clean, _URL, 3).alias("path"))


_MESSAGES = {
    "NO_INPUT": "Provide either a news text or an article URL.",
    "TWO_INPUTS": "Provide a news text or an article URL, not both.",
    "EMPTY_TEXT": "The text is empty.",
    "TOO_SHORT": f"The text needs at least {LEAST_CHARS} characters.",
    "TOO_LONG": f"The text may have at most {MOST_CHARS} characters.",
    "TOO_FEW_WORDS": f"The text needs at least {LEAST_WORDS} words.",
    "EMPTY_URL": "The URL is empty.",
    "SPACES": "The URL contains spaces.",
    "BAD_PROTOCOL": "Only the protocols http and https are supported.",
    "BAD_DOMAIN": "The URL has no valid domain.",
}


def validate(df: DataFrame, text_col: str = "news_text", url_col: str = "article_url") -> DataFrame:
    """``df`` with input_type, is_valid, error_code, error_message, cleaned and metadata; exactly one of the inputs must be there."""
    given = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) != ""
    kind = F.when(given(text_col) & given(url_col), "both").when(given(text_col), "text").when(given(url_col), "url").otherwise("none")
    out = df.withColumns({"_kind": kind, "_text": check_text(F.col(text_col)), "_url": check_url(F.col(url_col))})
    is_text = F.col("_kind") == "text"
    code = F.when(F.col("_kind") == "none", "NO_INPUT").when(F.col("_kind") == "both", "TWO_INPUTS").when(is_text, F.col("_text.error_code")).otherwise(F.col("_url.error_code"))
    messages = F.create_map(*[F.lit(x) for kv in _MESSAGES.items() for x in kv])
    meta = F.struct(
        F.when(is_text, F.col("_text.character_count")).alias("character_count"), F.when(is_text, F.col("_text.word_count")).alias("word_count"),
        F.when(~is_text, F.col("_url.scheme")).alias("scheme"), F.when(~is_text, F.col("_url.domain")).alias("domain"), F.when(~is_text, F.col("_url.path")).alias("path"),
    )
    out = out.withColumn("error_code", code).withColumns({
        "input_type": F.when(F.col("_kind").isin("text", "url"), F.col("_kind")),
        "is_valid": F.col("error_code").isNull(),
        "error_message": messages[F.col("error_code")],
        "cleaned": F.when(F.col("error_code").isNull(), F.when(is_text, F.col("_text.cleaned")).otherwise(F.col("_url.cleaned"))),
        "metadata": F.when(F.col("error_code").isNull(), meta),
    })
    return out.drop("_kind", "_text", "_url")
