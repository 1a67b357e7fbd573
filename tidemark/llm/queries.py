"""One query for each operator, over its whole table with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, caps, extraction, lines, minhash, packing, quality, suffixes, urltree, warc
from .common import Workspace, read


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.passage_report(read(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), ws.path("bundles"), ws.path("index"), ws)
    return warc.read_back(spark, ws.path("bundles")).drop("payload")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trees = quality.learn(docs.select(F.col("doc_id").alias("id"), "text"), quality.labelled(read(spark, sf_dir, "labels")))
    return quality.judge(docs, trees)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(read(spark, sf_dir, "pages"), urltree.RULES)


def op6_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(read(spark, sf_dir, "pages"))


def op7_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(bytebpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), k=4, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (op1_packing, op2_suffixes, op3_warc, op4_quality, op5_urls, op6_extraction, op7_caps, op8_bytebpe, op9_lines, op10_minhash)
}

#: The others need trained models, tokenizers, a linear program or an iteration; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        with p as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n from pages),
             m as (select h, max(page_id) as top from p where n >= 1000 group by h)
        select p.page_id, cast(n as bigint) as payload_bytes, sha1(p.h) as payload_digest,
               case when top is null or top = p.page_id then 'response' else 'revisit' end as record_type,
               case when top <> p.page_id then top end as refers_to
        from p left join m on p.h = m.h and p.n >= 1000""",
}
