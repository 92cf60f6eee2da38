"""The queries of this subpackage: one per operator, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from attestor.llm import bpe, chat, exact_dedup, extract_html, near_dedup, packing, quality, substring_dedup, topk, toxicity
from attestor.runtime import read


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.find_copies(read(spark, sf_dir, "documents"))


def op2_top_k(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op3_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_minhash_near_dedup(spark, sf_dir):
    return near_dedup.find_near_copies(read(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.classify(docs, read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op6_html_extraction(spark, sf_dir):
    found = extract_html.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op7_substring_dedup(spark, sf_dir):
    """The texts without passages that stand earlier in the table; changed: whether anything was cut out."""
    found = substring_dedup.drop_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "n_removed", (F.col("n_removed") > 0).alias("changed"), "removed")


def op8_chat_formatting(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    fixed = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = rows.unionByName(spark.createDataFrame(fixed, "conv_id long, turn long, role string, text string"))
    vocab = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return chat.digests(chat.encoded(rows, vocab), vocab)


def op9_byte_bpe(spark, sf_dir):
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_packing(spark, sf_dir):
    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_top_k, op3_quality, op4_minhash_near_dedup, op5_toxicity, op6_html_extraction, op7_substring_dedup, op8_chat_formatting, op9_byte_bpe, op10_packing)}

ORACLE_SQL = {
    "op2_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5""",
    "op6_html_extraction": """
        WITH a AS (
            SELECT page_id, url, coalesce(string_agg(x, chr(1)), '') AS body
            FROM (SELECT page_id, url, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS x
                  FROM (SELECT page_id, url, regexp_extract_all(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS l FROM pages))
            GROUP BY page_id, url),
        b AS (
            SELECT page_id, url, list_filter(list_transform(
                string_split(regexp_replace(regexp_replace(body, '</?(p|h[1-6]|div|li|ul|section)\\b[^>]*>', chr(1), 'g'), '<br[^>]*>', ' ', 'g'), chr(1)),
                lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '</?[a-z][^>]*>', '', 'g'),
                    '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#39;', chr(39)), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '') AS l
            FROM a)
        SELECT page_id, url, array_to_string(l, chr(10)) AS text, CAST(length(array_to_string(l, chr(10))) AS BIGINT) AS n_chars FROM b""",
    "op8_chat_formatting": """
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        m AS (
            SELECT *, regexp_extract_all(role || chr(0) || text,
                '[<\\[]\\\\*(\\|\\w+\\|>|/?s>|/?INST\\]|</?SYS>>|/?(bos|eos|start_of_turn|end_of_turn)>)') AS marks
            FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               CAST(sum(length(role) + length(text) + len(marks) + 32) AS BIGINT) AS formatted_chars
        FROM m GROUP BY conv_id""",
    "op1_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
            FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, h AS text_sha256
        FROM d""",
}
