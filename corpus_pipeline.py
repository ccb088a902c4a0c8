"""Corpus pipeline: stages that each work on all that the one before has kept.

Every stage's table is written as Parquet and read again as the next one's documents. All but the last return
the columns of ``documents``, and further columns of their input as they are, whatever their names.

In every stage repeated rows are treated alike, texts are read whole however long they are, and an empty table gives an
empty one. Documents whose text is null, empty or without a letter go in the first stage; rows without a doc_id or a
lang stay, but teach no language model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marram.llm import _shared, decontaminate, langid, neardup, packing, secret_scan, tokens


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with the language predicted as their ``lang``; those that the models reject go."""
    return langid.keep_identified(docs, langid.fit(docs.select("doc_id", "text", "lang")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words a shingle, similarity 0.8), that of the smallest doc_id."""
    return neardup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, _shared.read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secret_scan.redact(docs, secret_scan.learn(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its place in a training sequence."""
    return packing.pack(docs, tokens.public_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Models and tokenizers are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of ``documents``."""
    docs = _shared.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _shared.store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
