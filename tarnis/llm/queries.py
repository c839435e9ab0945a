"""The registered queries of the text operators. Each applies its operator, with the parameters meant for use, to its
whole table and derives the digest columns from what the operator returns."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnis.llm import sql as texts
from tarnis.llm import bpe, centroids, decontaminate, lexical, licenses, pseudonyms, quality, repeats, simhash, token_counts, toxicity, vector_search, warc
from tarnis.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {
    "op2_license_scan": texts.LICENSES,
    "op6_quality_ledger": texts.QUALITY,
    "op11_norm_buckets": texts.LEXICAL,
    "op12_centroid_cells": texts.CENTROIDS,
    "op13_vector_search": texts.VECTORS,
}

#: The key of pseudonyms is a setting of the session, of a name that Spark leaves out of its logs. Where it is unset a random
#: one is drawn for the session: pseudonyms then can't be undone, nor linked with those of other sessions.
KEY_CONF = "spark.tarnis.pseudonym.secret"
TOKENIZER = "word_bpe_49k.json"
#: The table of pages doesn't tell when they were fetched.
FETCHED = "2024-01-01T00:00:00Z"


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pseudonym_key(spark: SparkSession) -> bytes:
    key = spark.conf.get(KEY_CONF, "")
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_CONF, key)
    return key.encode()


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, ids and their text, with the digests of both."""
    path = public_tokenizers.path(TOKENIZER)
    rows = bpe.decode(bpe.encode(docs, path), path)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op1_warc_derivatives(spark: SparkSession, d: str) -> DataFrame:
    return warc.derivatives(warc.as_responses(table(spark, d, "pages"), FETCHED), key="page_id")


@query
def op2_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(table(spark, d, "documents"))


@query
def op3_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


@query
def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op5_template_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op6_quality_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(table(spark, d, "documents").select("doc_id", "text")))
    failed = F.col("failures").bitwiseAND(F.lit(quality.POLICIES["base"])) != 0
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rest = [m for m in quality.MEASURES if m not in base]
    return rows.select("doc_id", *base, failed.alias("base_failed"), "kept", "failures", *rest)


@query
def op7_repeated_strings(spark: SparkSession, d: str) -> DataFrame:
    rows = repeats.repeats(table(spark, d, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "spans")


@query
def op8_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = pseudonyms.pseudonymise(docs, pseudonym_key(spark))
    kinds = F.array_join(F.sort_array(F.array_distinct(F.transform("spans", lambda s: s["kind"]))), ",")
    return rows.select("doc_id", "text", F.size("spans").cast("long").alias("n_replaced"), kinds.alias("kinds"), "spans")


@query
def op9_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, d, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op10_bpe(spark: SparkSession, d: str) -> DataFrame:
    return encoded(table(spark, d, "documents"))


@query
def op11_norm_buckets(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op12_centroid_cells(spark: SparkSession, d: str) -> DataFrame:
    rows, ends, _ = centroids.cluster(table(spark, d, "embeddings"))
    rows = settle(rows, "clusters")
    sums = {r.cluster: r.total for r in rows.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in ends.tolist()]
    of = [F.struct(F.lit(sums.get(i, 0)).cast("long").alias("inertia"), F.lit(mark).alias("mark")) for i, mark in enumerate(marks)]
    own = F.element_at(F.array(*of), F.col("cluster") + 1) if of else F.lit(None).cast("struct<inertia: long, mark: string>")
    return rows.select(
        "vec_id", "cluster", "distance",
        own["inertia"].alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), own["mark"].alias("centroid_sha256"),
    )


@query
def op13_vector_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return vector_search.top_k(rows, rows.where("vec_id % 50 = 0"))
