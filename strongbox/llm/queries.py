"""The queries of this folder: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strongbox.llm.chat import CHAT_SQL, conversations_to_messages, format_chat, read_chat
from strongbox.llm.jaccard import JACCARD_SQL, jaccard_join
from strongbox.llm.lexical import RANKED_SQL, ranked
from strongbox.llm.line_dedup import LINE_DEDUP_SQL, line_dedup
from strongbox.llm.neighbours import nearest_neighbours
from strongbox.llm.packing import pack_documents
from strongbox.llm.pieces import encode_pieces
from strongbox.llm.quality_rules import quality_rules
from strongbox.llm.simhash import simhash_join
from strongbox.llm.site_quality import site_quality
from strongbox.llm.spelling import SPELLING_SQL, spelling_variants
from strongbox.llm.tables import table
from strongbox.llm.toxicity import toxicity
from strongbox.llm.warc import WARC_SQL, read_warc, write_warc
from strongbox.workspace import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    said = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema)
    return read_chat(format_chat(conversations_to_messages(given.unionAll(added))))


SQL["op1_chat_formatting"] = CHAT_SQL


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_deleted")


SQL["op2_line_dedup"] = LINE_DEDUP_SQL


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), digests=True)


@query
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), size=4, percent=85)


SQL["op4_ngram_jaccard"] = JACCARD_SQL


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path)


SQL["op6_warc"] = WARC_SQL


@query
def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return site_quality(docs, table(spark, sf_dir, "labels"), docs["source"], F.concat_ws("/", docs["source"], docs["lang"]))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join(table(spark, sf_dir, "documents"), size=3, bits=3)


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=10)


SQL["op12_ranked_search"] = RANKED_SQL


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), shortest=7, least=2, times=10, every=31)


SQL["op13_spelling_variants"] = SPELLING_SQL
