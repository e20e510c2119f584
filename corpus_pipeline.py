"""A corpus pipeline: stages over documents, each an operator of the llm subpackage.

Each stage takes all rows that its predecessor kept.  All but the last return the columns of documents; the last gives,
for each document left, its token count and the digests of its ids and of the bytes they decode to.

Defined cases, in every stage: an empty table stays empty; other columns are kept, or, by the last stage, not read; texts
are read whole, whatever their length; equal rows are treated alike.  Null and empty texts go in the first stage, as they
have too few words; given to a later one, they are kept as they are, and the last counts 0 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.llm import bpe, fertility, partenum, runtime, secrets, winnow


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands keep; equal rows stay or go together."""
    return fertility.kept_rows(docs, fertility.default_config())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: of its smallest doc_id, or of any if all ids are null.

    Of fully repeated rows, and of like texts under one id, one stays.  Blank texts are no one's copies: all stay.
    """
    return partenum.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a whole window of a benchmark item; a shorter item must make up its share (winnow.decontaminated).

    Without benchmark items, or with wordless ones alone, all stay; repeated rows stay or go together.
    """
    return winnow.decontaminated(docs, runtime.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars counts the new text. Null texts stay null."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests by byte-level BPE, a row for each row; a null text has the digests of an empty one."""
    return bpe.round_trip(docs, bpe.default_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("encoding", encoding),
]

#: The fertility bands, the inferred formats and the merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's table goes once the next one's is written."""
    docs = runtime.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, runtime.written(stage(spark, docs, sf_dir), f"stage-{name}")
        runtime.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
