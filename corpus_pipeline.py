"""From raw documents to packed training sequences, stage by stage.

Every stage works on what the one before kept. All but the last return the
columns of ``documents``:

1. language: texts without a language go; of rows with one id the smallest
   counts, rows without an id go.
2. near copies: one document stays of each component of near-equal texts
   (five-word shingles, similarity 0.8 or more), the one with the smallest id.
3. decontamination: documents that hold a benchmark item go.
4. secrets: documents stay; secrets in their texts are masked.
5. packing: pieces of token ids in sequences of 2048.

Empty tables give empty tables. Other columns are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsnap.llm import language, packing, registry, secrets, templates, token_groups
from perfsnap.llm.common import distinct_rows
from perfsnap.session import written

NEAR_WORDS, NEAR_PERCENT = 5, 80
GROUP_DOCS = 1024


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = distinct_rows(docs, "doc_id")
    return language.accepted(docs, language.fit(docs.where(~language.held_out())))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = token_groups.near_components(docs, NEAR_WORDS, NEAR_PERCENT)
    copies = found.where("component_id <> doc_id").select("doc_id")
    return docs.join(written(copies, "copies"), "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = templates.find_leaks(docs, registry.table(spark, sf_dir, "benchmark"))
    return docs.join(written(leaks.select("doc_id").distinct(), "leaks"), "doc_id", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    findings = secrets.scan(docs, secrets.train(secrets.labelled_findings(spark)))
    clean = secrets.redact(docs, findings)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(docs, registry.tokenizer_path())
    return packing.pack(pieces, packing.group_count(docs, GROUP_DOCS))


STAGES = [
    ("language", keep_languages),
    ("near copies", keep_one_of_near),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

# Languages, secrets and token ids are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
