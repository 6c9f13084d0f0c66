"""The registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafin.llm import backoff_lm, bpe_codec, common, decontaminate, doc_fingerprints, language_svm, license_scan, quality_fm, secret_scan, simhash_dedup, spelling_groups, token_files, url_filter, whitening


TOKENIZER = "byte_bpe_50k.json"


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(common.documents(spark, sf_dir), width=3, radius=2)
    return found.select("doc_id", simhash_dedup.hex_fingerprint().alias("fingerprint"), "component_id")


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    scored = quality_fm.score(docs, quality_fm.train(docs, common.labels(spark, sf_dir)))
    return scored.select("doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "score", quality_fm.predicted().alias("predicted"))


def op4_language_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = language_svm.predict(docs, language_svm.train(docs))
    return found.select("doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(common.documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["ord"] < 3)
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return found.select(
        "doc_id",
        *[secret_scan.count_of(i).alias(f"n_{k}") for i, k in enumerate(secret_scan.KINDS[:3])],
        F.sha2(secret_scan.listing(base), 256).alias("base_sha256"),
        secret_scan.listing(F.col("spans")).alias("spans"),
        live.alias("n_live"),
        (F.size("spans") - live).cast("long").alias("n_example"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(common.documents(spark, sf_dir), common.benchmark(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest_match",
        "longest_item",
        "longest_at",
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.index(token_files.write(common.documents(spark, sf_dir), public_tokenizers.path(TOKENIZER)))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codec.encode(common.documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", *bpe_digests())


def bpe_digests() -> list:
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]


def op7_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_lm.score(common.documents(spark, sf_dir), common.fold("doc_id", 5) != 1)
    return scored.withColumn("held_out", common.fold("doc_id", 5) == 1)


def op8_doc_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_fingerprints.fingerprinted(common.documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: 16 neighbours by id share a directory, 16 directories a package of
    their source, and the first document of each stands for its licence file."""
    package, directory = F.floor(F.col("doc_id") / 256), F.floor(F.col("doc_id") / 16)
    path = F.when(F.col("doc_id") % 256 == 0, F.concat_ws("/", "source", package, F.lit("LICENSE")))
    path = path.when(F.col("doc_id") % 16 == 0, F.concat_ws("/", "source", package, directory, F.lit("LICENSE")))
    path = path.otherwise(F.concat_ws("/", "source", package, directory, F.concat("doc_id", F.lit(".txt"))))
    return license_scan.scan(common.documents(spark, sf_dir).withColumn("path", path))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judge(pages, url_filter.mine(url_filter.labelled(pages, common.labels(spark, sf_dir))))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.spelling_groups(common.documents(spark, sf_dir))


_PATH_SQL = """case when doc_id % 256 = 0 then concat_ws('/', source, doc_id // 256, 'LICENSE')
  when doc_id % 16 = 0 then concat_ws('/', source, doc_id // 256, doc_id // 16, 'LICENSE')
  else concat_ws('/', source, doc_id // 256, doc_id // 16, doc_id || '.txt') end"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_quality_fm": op2_quality_fm,
    "op3_token_files": op3_token_files,
    "op4_language_svm": op4_language_svm,
    "op5_secret_scan": op5_secret_scan,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_backoff_lm": op7_backoff_lm,
    "op8_doc_fingerprints": op8_doc_fingerprints,
    "op9_license_scan": op9_license_scan,
    "op10_decontaminate": op10_decontaminate,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_url_filter": op12_url_filter,
    "op13_spelling_groups": op13_spelling_groups,
}
ORACLES: dict[str, str] = {
    "op5_secret_scan": secret_scan.ORACLE,
    "op9_license_scan": license_scan.ORACLE.replace("{path}", _PATH_SQL),
    "op10_decontaminate": decontaminate.ORACLE,
    "op12_url_filter": url_filter.ORACLE,
    "op13_spelling_groups": spelling_groups.ORACLE,
}
