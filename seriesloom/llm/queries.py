"""The queries of this package: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesloom.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).drop("row_no")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesloom.llm.chat import digest, format_conversations

    said = "\\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return digest(format_conversations(rows.unionByName(more)))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesloom.llm.lm import lm_scores

    return lm_scores(_table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors' pictures, searched for cropped and edited copies of those whose id is divisible by 50."""
    from seriesloom.llm.media import find_copies
    from seriesloom.llm.pictures import drawn

    vectors = _table(spark, sf_dir, "embeddings")
    found = find_copies(drawn(vectors), drawn(vectors.where("vec_id % 50 = 0"), copy=True))
    return found.withColumnRenamed("id", "vec_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesloom.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesloom.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents")).drop("row_no")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files, and a replica in which every 997th page has another first byte; both read back and audited."""
    from pyspark.sql import functions as F

    from seriesloom.llm.warc import audit, read_warc, write_warc
    from seriesloom.runtime import cut, shared_path

    pages = _table(spark, sf_dir, "pages")
    damaged = pages.withColumn("html", F.when((F.col("page_id") % 997 == 5) & (F.octet_length(F.left("html", F.lit(1))) == 1), F.concat(F.lit("~"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html")))
    replicas = []
    for table in (pages, damaged):
        path = shared_path(spark, "warc")
        write_warc(table, path)
        replicas.append(cut(read_warc(spark, path, blocks=False).drop("block", "uri")))
    first, second = replicas
    bad = audit(first, second).select("volume", "offset", F.lit(False).alias("intact"))
    page_id = F.nullif(F.regexp_extract("record_id", "^<urn:page:(.*)>$", 1), F.lit("")).cast("long")
    return first.join(bad, ["volume", "offset"], "left").select(page_id.alias("page_id"), F.col("length").alias("record_bytes"), F.col("digest").alias("record_sha256"), F.coalesce("intact", F.lit(True)).alias("intact"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesloom.llm.substrings import digest, remove_repeats

    return digest(remove_repeats(_table(spark, sf_dir, "documents")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seriesloom.llm.quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing, op2_packing, op3_chat, op4_lm_scores, op5_media, op6_simhash, op7_exact_dedup, op8_warc, op9_substrings, op10_quality)}

ORACLE_SQL: dict[str, str] = {
    # An escape adds one character for each control string; around a turn's role and text stand 10, 1 and 8 characters.
    "op3_chat": r"""
        WITH r AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(10 + length(role) + len(regexp_extract_all(role, '\\|<turn>|</turn>|### |\n')) + 1
                        + length(text) + len(regexp_extract_all(text, '\\|<turn>|</turn>|### ')) + 8) AS BIGINT) AS formatted_chars
        FROM r GROUP BY conv_id
    """,
    "op7_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
        )
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM d
    """,
    "op8_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body,
                   'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                   || 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') || chr(13) || chr(10)
                   || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10)
                   || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
                   || 'Content-Type: text/html' || chr(13) || chr(10)
                   || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS record
            FROM pages
        )
        SELECT page_id, CAST(strlen(record) + 4 AS BIGINT) AS record_bytes, sha256(record) AS record_sha256,
               NOT (page_id % 997 = 5 AND strlen(body[1]) = 1 AND body[1] <> '~') AS intact
        FROM p
    """,
    "op9_substrings": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ),
        win AS (SELECT doc_id, i, ws[i:i + 12] AS k FROM w, unnest(generate_series(1, len(ws) - 12)) AS t(i)),
        least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
        bad AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN least USING (k), range(13) AS r(j) WHERE m < doc_id),
        tok AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(generate_series(1, len(ws))) AS t(p)),
        kept AS (
            SELECT tok.doc_id, count(*) - count(bad.p) AS n, string_agg(word, ' ' ORDER BY tok.p) FILTER (bad.p IS NULL) AS rest
            FROM tok LEFT JOIN bad ON tok.doc_id = bad.doc_id AND tok.p = bad.p GROUP BY tok.doc_id
        )
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
    """,
}
