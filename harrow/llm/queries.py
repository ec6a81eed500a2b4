"""The subpackage's queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import langid, warc
from harrow.llm.ann import nearest
from harrow.llm.bpe import encode_decode
from harrow.llm.common import crc_bucket, shared_dir
from harrow.llm.dedup import exact_duplicates
from harrow.llm.divergence import source_divergence
from harrow.llm.html_text import extract
from harrow.llm.lm import lm_scores
from harrow.llm.packing import pack
from harrow.llm.simhash import near_duplicates
from harrow.llm.token_counts import token_counts
from harrow.llm.url_filter import judge_urls
from harrow.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


#: Rules of the url query: (host, path) -> verdict.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents")).drop("row_id")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc.register(spark)
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.page_records(_table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(folder)
    read = spark.read.format("warc").load(folder).where(F.col("record_type").isin("response", "revisit"))
    response = F.col("record_type") == "response"
    return read.select(
        warc.page_of("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.substring("payload_digest", 6, 40)).alias("payload_digest"),
        "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(langid.training_rows(docs, crc_bucket("doc_id", 3), 1))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "language.lang_pred", "language.score"
    )


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


QUERIES = {
    "op1_pack": op1_pack,
    "op2_url_filter": op2_url_filter,
    "op3_lm_score": op3_lm_score,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_nearest": op5_nearest,
    "op6_bpe": op6_bpe,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_language": op9_language,
    "op10_html_text": op10_html_text,
    "op11_whiten": op11_whiten,
    "op12_divergence": op12_divergence,
    "op13_token_counts": op13_token_counts,
}

ORACLE_SQL = {
    "op12_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        w AS (SELECT row_id, lang, source, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row_id) >= 3),
        types AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        found AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        cell AS (
            SELECT g.lang, g.source, k.term, coalesce(f.c, 0) AS c, types.v,
                   sum(coalesce(f.c, 0)) OVER (PARTITION BY g.lang, g.source) AS n,
                   sum(coalesce(f.c, 0)) OVER (PARTITION BY g.lang, k.term) AS lc,
                   sum(coalesce(f.c, 0)) OVER (PARTITION BY g.lang) AS ln
            FROM g JOIN kept k USING (lang) JOIN types USING (lang) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
        p AS (
            SELECT lang, source, term, c, (1 + (1000000000::HUGEINT * (c + 1)) // (n + v))::BIGINT AS p,
                   (1 + (1000000000::HUGEINT * (lc + 1)) // (ln + v))::BIGINT AS q
            FROM cell),
        pair AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        item AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM item)
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
    "op8_warc": """
        WITH t AS (
            SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS keeper FROM t)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN keeper <> page_id THEN keeper END AS refers_to
        FROM m
    """,
    "op4_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER w = 1 AS kept,
               h AS text_sha256
        FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
    """,
}
