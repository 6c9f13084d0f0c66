"""A training-corpus pipeline: five stages, each written as Parquet and reread by the next.

1. quality: a factorisation machine scores every document; those it rejects go.
2. near duplicates: SimHash groups of five-word shingles at similarity 0.8; one of each group stays.
3. decontamination: documents with a ten-word window of a benchmark item go.
4. secrets: spans of credentials are replaced, live and widely copied ones by different marks.
5. tokens: every text as token ids, and the text decoded from them as a digest.

All stages but the last return the columns of ``documents``.  Rows without id or text pass through
like any others: their texts count as empty, and of several empty texts one stays.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratafin.llm import bpe_codec, common, decontaminate, quality_fm, secret_scan, simhash_groups
from stratafin.llm.queries import TOKENIZER, bpe_digests
from stratafin.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_fm.train(docs, common.labels(spark, sf_dir))
    scored = quality_fm.score(docs, model, keep=tuple(docs.columns), out="__score")
    return scored.where(quality_fm.predicted(score="__score") == 1).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_groups.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, common.benchmark(spark, sf_dir))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe_codec.encode(docs, public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", *bpe_digests(), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: The learnt and hashed stages have no SQL form; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
