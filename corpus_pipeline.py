"""A corpus pipeline of five stages, each an operator of ``plurigrade.llm`` over all that its predecessor kept.

Documents with null or empty text have no words, so the quality rules reject them.  Of rows that repeat, one stays, as of any
group of near-duplicates: the one with the smallest id, a row without id only if none of its group has one.  Very long texts
are taken whole by every stage.  An empty table passes through empty, and without benchmark items nothing is cut.  All
columns of the documents are carried along up to the last stage, whatever their names; ``n_chars``, if there is one, follows
the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurigrade.llm import bpe, decontamination, pii, quality_rules, simhash
from plurigrade.llm.common import drop_stored, stored
from plurigrade.llm.queries import table, tokenizer_path


def _counted(docs: DataFrame) -> DataFrame:
    """The documents with ``n_chars`` of their present texts."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays: the one with the smallest id."""
    return simhash.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two benchmark items or more go; single items' passages are cut out."""
    return _counted(decontamination.clean(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return _counted(pii.masked(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the ids of its text, and the digests of the ids and of the text decoded from them."""
    coded = bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"))
    return bpe.digest(coded, extra=("ids",))


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark_passages), ("PII", personal_data), ("BPE encoding and decoding", token_ids)]

#: The field's loopy messages and the library's encoding have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each on the stored rows of the one before; a stage's rows go once the next are stored."""
    docs, held = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        if held is not None:
            drop_stored(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
