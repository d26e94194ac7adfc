"""From raw documents to packed training sequences, in stages that are written down one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strongbox.llm.jaccard import one_of_each
from strongbox.llm.line_dedup import line_dedup
from strongbox.llm.packing import pack_documents
from strongbox.llm.quality_rules import keep_good
from strongbox.llm.queries import tokenizer_path
from strongbox.llm.tables import table, written
from strongbox.llm.toxicity import keep_clean

#: SQL can express neither the models nor the tokenizer.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; n_chars follows the text."""
    changed = line_dedup(docs, to_end=True).drop("n_lines", "n_deleted")
    return changed.selectExpr(*("cast(char_length(text) as bigint) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id. Documents without a word,
    which line dedup has left empty because earlier ones hold all of their lines, go as well."""
    return one_of_each(docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their place in a sequence."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. Each is written to the session's shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
