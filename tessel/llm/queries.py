"""The thin queries over the operators of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import byte_bpe, exact_dedup, gif, html_extract, katz, language_id, ngram_jaccard, packing, toxicity, url_filter
from tessel.llm.common import remainder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort(_read(spark, sf_dir, "documents"), keep="largest")


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = gif.text_media(_read(spark, sf_dir, "documents"))
    read = gif.decoded_frames(media)
    total = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), 3 * gif.BINS), lambda a, f: F.zip_with(a, f["own"], lambda x, y: x + y))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(",", F.slice(total, 1, gif.BINS).cast("array<string>")).alias("feature"),
        F.size("frames").alias("n_frames"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_bpe.encode(_read(spark, sf_dir, "documents"), decoded=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, _read(spark, sf_dir, "labels"), train=remainder("doc_id", 3) != 1)
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.LIMIT).cast("int").alias("predicted"), "hits")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.join(_read(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(_read(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_extract.extract(_read(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language_id.learn(docs, train=remainder("doc_id", 4) != 2)
    found = language_id.identify(docs, model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_gif": op3_gif,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_url_filter": op6_url_filter,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_html_extraction": op9_html_extraction,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
        FROM (
            SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id,
                   CAST(count(*) OVER (PARTITION BY body) AS BIGINT) AS group_size
            FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
        )
    """,
    "op7_ngram_jaccard_join": r"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), shingled AS (
            SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s
            FROM worded, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2)))) AS t(k)
            WHERE len(w) > 0
        ), sized AS (
            SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
        ), met AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
            FROM shingled x JOIN shingled y ON x.s = y.s AND x.doc_id <> y.doc_id
            GROUP BY ALL
        ), links AS (
            SELECT a, b FROM met JOIN sized p ON p.doc_id = a JOIN sized q ON q.doc_id = b
            WHERE 100 * shared >= 75 * (p.n + q.n - shared)
        ), reached(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.other
        )
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
        FROM (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) LEFT JOIN sized USING (doc_id)
    """,
}
