"""The queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xmlframe.llm import embed_dedup, html_text, media, mixing, packing, quality, sharding, simhash, url_rules, warc
from xmlframe.llm.common import written

#: What ``OP7`` and older tests hold; on net/de/ and example.net/de/8 its words are not the contract's.
RULES = (
    url_rules.Rule("block", "com", "/en/"),
    url_rules.Rule("allow", "example.com", "/en/7"),
    url_rules.Rule("block", "net", "/de/"),
    url_rules.Rule("allow", "example.net", "/de/8"),
    url_rules.Rule("block", "org", "/es/"),
)
#: The contract's list, which the query judges by.
CONTRACT_RULES = (
    url_rules.Rule("block", "com", "/en/"),
    url_rules.Rule("allow", "example.com", "/en/7"),
    url_rules.Rule("allow", "net", "/de/"),
    url_rules.Rule("block", "example.net", "/de/8"),
    url_rules.Rule("block", "org", "/es/"),
)
SHARDS = 24


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> str:
    """The vocabulary file on this machine; a cluster has it at the same path everywhere."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = written(media.to_media(_read(spark, sf_dir, "documents")), "media", compression="zstd")
    return media.from_media(files, tensor=False)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_read(spark, sf_dir, "documents"), vocabulary())
    return pieces.select(F.col("row_id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = written(warc.write_archives(_read(spark, sf_dir, "pages")), "warc", **{"compression": "none", "parquet.block.size": str(16 << 20)})
    records = warc.read_archives(archives, with_payload=False)
    return records.select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_position")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, CONTRACT_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = sharding.stratified_shards(docs, SHARDS, ties=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, quality.graded(_read(spark, sf_dir, "labels")))
    return quality.score(docs, model).select("doc_id", "expected_grade", "p_good", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media, op2_packing, op3_warc, op4_html_text, op5_embed_dedup, op6_mixing, op7_url_rules, op8_sharding, op9_simhash, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3, "op7_url_rules": OP7}


OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM r
"""

_HOST = "CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = "CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
OP7 = f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {', '.join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)}),
u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
j AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN j USING (page_id)
"""
