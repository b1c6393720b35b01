"""One registered query per operator of this package, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineguard.llm import (
    bitsliced,
    compression,
    fingerprints,
    language,
    mixing,
    packing,
    simhash,
    token_counts,
    toxicity,
    url_filter,
    vectors,
    warc,
    whitening,
)
from lineguard.llm.common import load, remainder

Query = Callable[[SparkSession, str], DataFrame]


def op1_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likenesses."""
    return fingerprints.fingerprint_edits(load(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from the labelled documents that are not held out."""
    docs = load(spark, sf_dir, "documents")
    net = toxicity.learn(docs, load(spark, sf_dir, "labels"), remainder(F.col("id"), 5) != 0)
    scored = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), toxicity.score(net, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document its topic, tokens, calibrated probability, whether it is drawn, and how far shares are off target."""
    mixed = mixing.mix(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "topic", "tokens", F.round("probability", 6).alias("probability"), "kept", F.round("off_target", 9).alias("off_target"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of every document and how much of it fits the limit."""
    answer = token_counts.truncation(F.col("text"), public_tokenizers.path("word_bpe_49k.json"), 2048)
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), answer.alias("answer")
    )
    return docs.select("doc_id", "n_bytes", "answer.n_tokens", "answer.over_limit", "answer.fitting_chars")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-duplicate vectors within a label."""
    return vectors.near_duplicates(load(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and its component of near-duplicates."""
    found = simhash.near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint_bits")).alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, normalised and read back."""
    return warc.round_trip(load(spark, sf_dir, "pages"))


_WARC_SQL = """
WITH p AS (
    SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), k AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM p
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN keeper > page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN keeper > page_id THEN keeper END AS refers_to
FROM k
"""


def listed_changes(pages: DataFrame) -> DataFrame:
    """Dated list changes for hosts and domains of *pages*, drawn from a hash of each name: most are not listed, others
    are added, taken off again, and some added anew."""
    names = pages.select(F.explode(url_filter.rules_of(url_filter.host(F.col("url")))).alias("rule")).distinct()
    digest = F.md5("rule")
    byte = lambda k: F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("int")
    off = byte(2) + 1 + F.pmod(byte(3), F.lit(120))
    named = names.where("rule LIKE '%.%.%'").select("rule", F.element_at(F.array(*map(F.lit, ("ads", "malware", "adult"))), F.pmod(byte(0), F.lit(3)) + 1).alias("list"), F.explode(
        F.when(byte(1) < 100, F.array_compact(F.array(
            F.struct(byte(2).alias("at"), F.lit(True).alias("added")),
            F.struct(off.alias("at"), F.lit(False).alias("added")),
            F.when(byte(5) < 128, F.struct((off + 1 + byte(4)).alias("at"), F.lit(True).alias("added"))),
        )))
    ).alias("c"))
    return named.select("list", "rule", F.lit("host").alias("category"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("c.at")).alias("day"), "c.added")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every page the list entries in force on the day it was fetched."""
    pages = load(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int"))
    captures = pages.select("page_id", "url", fetched.alias("fetched"))
    found = url_filter.active_entries(captures, url_filter.intervals(listed_changes(pages)))
    return found.select("page_id", "host", "hits", F.array_join("lists", ",").alias("lists"), "blocked")


_URL_SQL = r"""
WITH captures AS (
    SELECT page_id, rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:@]+)', 2)), '.') AS host,
        DATE '2024-01-01' + (page_id % 365)::INT AS fetched
    FROM pages
), suffixes AS (
    SELECT DISTINCT host, array_to_string(string_split(host, '.')[-k:], '.') AS rule
    FROM captures, unnest(range(1, len(string_split(host, '.')) + 1)) AS u(k) WHERE host <> ''
), b AS (
    SELECT DISTINCT rule, [('0x' || substr(md5(rule), 2 * i + 1, 2))::INT FOR i IN range(6)] AS d FROM suffixes WHERE rule LIKE '%.%.%'
), c AS (
    SELECT rule, (['ads', 'malware', 'adult'])[d[1] % 3 + 1] AS list, d, d[3] + 1 + d[4] % 120 AS off FROM b WHERE d[2] < 100
), changes AS (
    SELECT list, rule, d[3] AS since, true AS added FROM c
    UNION ALL SELECT list, rule, off, false FROM c
    UNION ALL SELECT list, rule, off + 1 + d[5], true FROM c WHERE d[6] < 128
), spans AS (
    SELECT list, rule, DATE '2024-01-01' + since::INT AS valid_from, added,
        lead(DATE '2024-01-01' + since::INT) OVER (PARTITION BY list, rule ORDER BY since) AS valid_to FROM changes
), hits AS (
    SELECT page_id, count(*) AS hits, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
    FROM captures JOIN suffixes USING (host) JOIN spans USING (rule)
    WHERE added AND fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to) GROUP BY page_id
)
SELECT page_id, host, coalesce(hits, 0)::BIGINT AS hits, coalesce(lists, '') AS lists, hits IS NOT NULL AS blocked
FROM captures LEFT JOIN hits USING (page_id)
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 2048 tokens."""
    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those that are not held out."""
    docs = load(spark, sf_dir, "documents")
    model = language.learn(docs, remainder(F.col("doc_id"), 4) != 2)
    scored = docs.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), language.predict(model, F.col("text")).alias("p"))
    return scored.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of all embeddings on the eight leading components."""
    found = whitening.whiten(load(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, compression ratios and the verdict for every document."""
    judged = load(spark, sf_dir, "documents").select("doc_id", compression.judge(F.col("text")).alias("j"))
    return judged.select("doc_id", "j.*")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return bitsliced.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("candidates")


def queries() -> dict[str, Query]:
    own = (
        op1_weighted_fingerprints,
        op2_toxicity,
        op3_mixing,
        op4_token_counts,
        op5_embeddings,
        op6_simhash,
        op7_warc,
        op8_url_filter,
        op9_packing,
        op10_language,
        op11_whitening,
        op12_compression,
        op13_ranked_search,
    )
    return {q.__name__: q for q in own} | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    return {
        "op3_mixing": mixing.sql(columns="doc_id, topic, tokens, round(probability, 6) AS probability, kept, round(off_target, 9) AS off_target"),
        "op7_warc": _WARC_SQL,
        "op8_url_filter": _URL_SQL,
        "op13_ranked_search": bitsliced.sql(),
    }
