"""A training corpus from raw documents, stage by stage.

Each stage reads what the one before it wrote and returns the table's columns;
the last one writes token files and returns an index of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gradeframe.llm import decontam, langid, mixing, near_dedup, tokens
from gradeframe.llm.common import remove, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach. Null texts and texts without letters go; null ids and repeated rows are rows like others."""
    return langid.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of near copies, null texts counting as empty. Of repeated rows one stays; classes with null ids only stay whole."""
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items. Null and wordless texts are clean."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, a row per copy, in training order. Null and empty texts have no words and aren't taken; a null source is a source."""
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files in ascending doc_id order, null first, and reads them back: doc_id, start, n_tokens, ids_crc32, file. Null texts have the end id only."""
    path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    return tokens.read_tokens(tokens.write_tokens(docs, path, tokens.default_tokenizer()), path)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token_files", token_files),
]

#: SQL can express neither a learnt classifier nor the tokenizer; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table's documents, each written and read again. An empty table goes through all of them and gives no rows."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            remove(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(path)
    return docs
