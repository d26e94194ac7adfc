"""Quality by hierarchical empirical Bayes: what a document's text says, and what its path and host say.

A document's evidence is a naive Bayes sum over binned measures of its text; the counts of bins by
label are one grouped aggregation over the labelled rows, and the sum is calibrated by another. Hosts
and paths add up labels where they are known and the documents' calibrated probabilities elsewhere. A
host is shrunk towards the global rate, a path towards its host, each with a strength estimated from
the spread between hosts and between the paths of hosts. A document's own part is taken out of the
rates it is judged by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strongbox.llm.quality_rules import rates_of, read_text
from strongbox.llm.tables import Rows, arrow_schema, held_out, rows_of, texts, written
from strongbox.llm.words import word_hashes

BINS = 16
#: What a document without a label counts beside one with a label.
SOFT = 0.25
#: Bounds of the strength of a prior, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
THRESHOLD = 0.5
#: Where the measures are cut: shares of symbols, repeated words, repeated lines, capitals, different
#: words, and word length; the number of words by its logarithm.
MEASURES = ("symbols", "repeated_words", "repeated_lines", "capitals", "different_words", "word_length", "words")
CUTS = {
    "symbols": [0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4],
    "repeated_words": [0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9],
    "repeated_lines": [0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1],
    "capitals": [0.0, 0.02, 0.04, 0.07, 0.1, 0.2, 0.4, 0.7],
    "different_words": [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97],
    "word_length": [0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2, 0.4],
    "words": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12],
}


def bins_of(text: str, memo) -> list[int]:
    counts, h, raw = read_text(text, memo)
    values = [*rates_of(counts, h, raw).tolist(), math.log2(counts.n_words + 1)]
    return [sum(v > c for c in CUTS[m]) for m, v in zip(MEASURES, values, strict=True)]


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _evidence(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path and the bins of every document."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        out = Rows(arrow_schema(doc_id=pa.int64(), host=pa.string(), path=pa.string(), bins=pa.list_(pa.int32())))
        for doc_id, text, h, p in rows_of(batches, "doc_id", "text", "host", "path"):
            out.add(doc_id, h, p, bins_of(text, memo))
            if out.full():
                yield from out.take()
        yield from out.take()

    named = texts(docs.withColumns({"__host": F.coalesce(host.cast("string"), F.lit("")), "__path": F.coalesce(path.cast("string"), F.lit(""))}), "__host", "__path")
    named = named.withColumnsRenamed({"__host": "host", "__path": "path"})
    return named.mapInArrow(measure, "doc_id long, host string, path string, bins array<int>")


def _strength(mean: float | None, spread: float | None, size: float | None) -> float:
    """How many documents a prior counts for, from the spread of rates around it beyond chance."""
    if not mean or not 0 < mean < 1 or spread is None or not size:
        return MOST_STRENGTH
    beyond = spread - mean * (1 - mean) / size
    strength = mean * (1 - mean) / beyond - 1 if beyond > 0 else MOST_STRENGTH
    return min(max(strength, LEAST_STRENGTH), MOST_STRENGTH)


def site_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Judges the whole text of every document together with its host and path.

    ``host`` and ``path`` name a document's site and its part of the site; a path belongs to one host.
    Returns doc_id, held_out, document_score, host_rate, path_rate, score (probability of good
    quality) and kept (whether it reaches the threshold). Labels (doc_id, quality) of held-out
    documents are never read; null or other labels count as none. Null hosts and paths are one host
    and path each, null texts are empty. Without labels every score comes from a rate of one half. A
    row in is a row out; other columns are left out.
    """
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = written(_evidence(docs, host, path).join(known, "doc_id", "left"), "evidence")
    learnt = rows.where("label is not null")

    # One count per measure, bin and label: a table of fixed size.
    counted = learnt.select("label", F.posexplode("bins").alias("measure", "bin")).groupBy("measure", "bin")
    table = {(r["measure"], r["bin"]): (r["good"], r["n"]) for r in counted.agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()}
    total = learnt.agg(F.sum("label"), F.count("*")).first()
    good, n = (total[0] or 0.0), total[1]
    rate = (good + 1) / (n + 2)
    odds = []
    for m in range(len(MEASURES)):
        logs = []
        for b in range(BINS):
            g, all_ = table.get((m, b), (0.0, 0))
            logs.append(math.log((g + 0.5) / (good + 0.5 * BINS)) - math.log((all_ - g + 0.5) / (n - good + 0.5 * BINS)) if all_ else 0.0)
        odds.append(F.array(*map(F.lit, logs)))
    spoken = sum((F.get(odds[m], F.col("bins")[m]) for m in range(len(MEASURES))), F.lit(0.0))
    rows = rows.withColumn("spoken", spoken)

    # Measures are not independent: the sum is calibrated by the labels of documents with a sum like it.
    near = F.least(F.greatest(F.round("spoken"), F.lit(-12.0)), F.lit(12.0)).cast("int")
    at = {r["near"]: (r["good"], r["n"]) for r in rows.where("label is not null").groupBy(near.alias("near")).agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()}
    calibrated = []
    for i in range(-12, 13):
        prior = 1 / (1 + math.exp(-max(min(i + math.log(rate / (1 - rate)), 30), -30)))
        g, all_ = at.get(i, (0.0, 0))
        calibrated.append(F.lit((g + 4 * prior) / (all_ + 4)))
    rows = rows.withColumn("document_score", F.get(F.array(*calibrated), near + 12))
    rows = rows.withColumns({"w": F.when(F.col("label").isNotNull(), 1.0).otherwise(SOFT), "y": F.coalesce("label", "document_score")})

    paths = rows.groupBy("host", "path").agg(F.sum(F.col("w") * F.col("y")).alias("path_good"), F.sum("w").alias("path_n"))
    paths = written(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("path_good").alias("host_good"), F.sum("path_n").alias("host_n"))
    all_hosts = hosts.agg(
        (F.sum("host_good") / F.sum("host_n")).alias("mean"), F.var_samp(F.col("host_good") / F.col("host_n")).alias("spread"), (F.count("*") / F.sum(1 / F.col("host_n"))).alias("size")
    ).first()
    mean = min(max(all_hosts["mean"] if all_hosts["mean"] is not None else 0.5, 1e-3), 1 - 1e-3)
    of_host = _strength(mean, all_hosts["spread"], all_hosts["size"])
    within = paths.join(hosts, "host").agg(
        F.avg((F.col("path_good") / F.col("path_n") - F.col("host_good") / F.col("host_n")) ** 2).alias("spread"), (F.count("*") / F.sum(1 / F.col("path_n"))).alias("size")
    ).first()
    of_path = _strength(mean, within["spread"], within["size"])

    judged = rows.join(paths.join(hosts, "host"), ["host", "path"])
    own = F.col("w") * F.col("y")
    host_rate = (mean * of_host + F.col("host_good") - own) / (of_host + F.col("host_n") - F.col("w"))
    path_rate = (F.col("host_rate") * of_path + F.col("path_good") - own) / (of_path + F.col("path_n") - F.col("w"))
    judged = judged.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    score = 1 / (1 + F.exp(-(_logit(F.col("document_score")) + _logit(F.col("path_rate")) - _logit(F.lit(mean)))))
    return judged.withColumn("score", score).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "document_score", "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("kept")
    )
