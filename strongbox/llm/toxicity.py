"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and the runs of four and five characters of words, marked at their ends; those whose
occurrence speaks most for toxicity (chi square over the labelled sample) make the vocabulary.
Inverse document frequencies are counted over all documents. The examples' index holds, for each term,
its examples in blocks and the largest weight of each block: blocks are visited in the order of the
score they can reach, until no other block can hold one of the nearest examples.

Votes are weighted with the squared similarity and turned into calibrated scores. The examples are a
bounded sample: ``SAMPLE`` rows of each class to look up, ``CALIBRATION`` of each to calibrate.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strongbox.llm.quality_rules import platt
from strongbox.llm.tables import Rows, arrow_schema, held_out, is_held_out, one_text, rows_of, texts, written
from strongbox.llm.words import Memo

SAMPLE, CALIBRATION = 2000, 500
TERMS, LEAST_EXAMPLES = 4096, 5
#: Least chi square of a term, and least share of it in the number of examples: copies of a toxic text
#: must not make terms of all its words.
LEAST_CHI, LEAST_SHARE = 10.0, 0.02
NEIGHBOURS, BLOCK = 15, 512
#: Added to the weight of all votes: distant examples alone don't decide.
DOUBT = 0.1


BETWEEN_WORDS = re.compile(r"[\W_]+")


def marked(text: str) -> str:
    """A text's words without case, each between ^ and $."""
    return "^" + BETWEEN_WORDS.sub("$^", text.lower()) + "$"


def terms_of(word: str) -> set[str]:
    """The terms of a marked word."""
    return {word, *(word[i : i + n] for n in (4, 5) for i in range(len(word) - n + 1))}


class TermCounts:
    """How often the terms of a vocabulary occur in a text."""

    def __init__(self, vocabulary: list[str]):
        self.found = ahocorasick.Automaton()
        for i, term in enumerate(vocabulary):
            self.found.add_word(term, i)
        self.found.make_automaton()

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms and counts, in the order of terms."""
        counts = Counter(i for _, i in self.found.iter(marked(text)))
        terms = np.array(sorted(counts), np.int64)
        return terms, np.array([counts[t] for t in terms.tolist()], np.float64)


def tfidf(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of a text's terms, of length one."""
    w = (1 + np.log(counts)) * idf[terms]
    norm = np.sqrt((w * w).sum())
    return w / norm if norm else w


class Index:
    """A block-max inverted index of vectors: exact nearest by the dot product, ties to the smaller number."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], width: int, block: int = BLOCK):
        self.block, self.blocks = block, -(-len(vectors) // block)
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors]).astype(np.int64)
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.empty(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.empty(0)
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        # Where the postings of a term and block start.
        place = term[order] * self.blocks + self.example // block
        self.starts = np.searchsorted(place, np.arange(width * self.blocks + 1))
        self.most = np.zeros(width * self.blocks)
        np.maximum.at(self.most, place, self.weight)
        self.most = self.most.reshape(width, self.blocks)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """Similarity and number of the nearest examples that share a term."""
        if not len(terms) or not self.blocks:
            return []
        bounds = weights @ self.most[terms] * (1 + 1e-9)
        near, scored = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or len(near) == k and bounds[b] < scored[-1]:
                break
            scores = self._scores(terms * self.blocks + b, weights, int(b))
            found = np.flatnonzero(scores)
            if len(found) > k:  # all that reach the k-th, ties too
                found = found[scores[found] >= np.partition(scores[found], -k)[-k]]
            near, scored = np.append(near, found + b * self.block), np.append(scored, scores[found])
            order = np.lexsort((near, -scored))[:k]
            near, scored = near[order], scored[order]
        return list(zip(scored.tolist(), near.tolist(), strict=True))

    def _scores(self, places: np.ndarray, weights: np.ndarray, block: int) -> np.ndarray:
        """The dot products with a block's examples: the postings of all places, gathered in one step."""
        starts = self.starts[places]
        sizes = self.starts[places + 1] - starts
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        return np.bincount(self.example[at] - block * self.block, np.repeat(weights, sizes) * self.weight[at], minlength=self.block)


@dataclass
class Model:
    vocabulary: list[str]
    idf: np.ndarray
    vectors: list[tuple[np.ndarray, np.ndarray]]
    labels: np.ndarray
    ids: list[int]
    slope: float = 1.0
    shift: float = 0.0

    def vote(self, near: list[tuple[float, int]]) -> float:
        weights = np.array([s * s for s, _ in near])
        votes = self.labels[[i for _, i in near]] if near else weights
        return float((weights * votes).sum() / (weights.sum() + DOUBT))

    def score(self, near: list[tuple[float, int]]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.vote(near) + self.shift, -30, 30))))


def examples_of(docs: DataFrame, labels: DataFrame, sample: int, calibration: int) -> tuple[DataFrame, float]:
    """A bounded sample of labelled documents outside the held-out fold (doc_id, text, label, learn), by
    the hash of their ids, and the share of toxic ones among all such labels."""
    known = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = known.agg(F.avg("label")).first()[0] or 0.0
    known = known.withColumn("at", F.xxhash64("doc_id"))
    chosen = [
        known.where(F.col("label") == y).orderBy("at", "doc_id").limit(sample + calibration) for y in (0, 1)
    ]
    both = chosen[0].unionAll(chosen[1])
    # At most 2 * (sample + calibration) rows of a few bytes.
    found = one_text(docs, both)
    learn = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(sample + calibration)) < sample
    return written(found.select("doc_id", "text", "label", learn.alias("learn")), "examples"), share


def vocabulary_of(examples: DataFrame, terms: int) -> list[str]:
    """The terms whose occurrence in an example speaks most for toxicity."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, found = Memo(terms_of), {0: Counter(), 1: Counter()}
        out = Rows(arrow_schema(term=pa.string(), bad=pa.int64(), good=pa.int64()), most=65536)
        for text, label in rows_of(batches, "text", "label"):
            own = set()
            for some in map(memo.__getitem__, set(marked(text).replace("$^", "$ ^").split(" "))):
                own.update(some)
            found[label].update(own)
        for t in found[0].keys() | found[1].keys():
            out.add(t, found[1][t], found[0][t])
            if out.full():
                yield from out.take()
        yield from out.take()

    of = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(of) < 2:
        return []
    bad, good, n = F.col("bad"), F.col("good"), float(of[0] + of[1])
    a, b, c, d = bad, good, F.lit(float(of[1])) - bad, F.lit(float(of[0])) - good
    chi = n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * of[0] * of[1])
    counted = examples.select("text", "label").mapInArrow(count, "term string, bad long, good long")
    counted = counted.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    chosen = counted.where((a + b >= LEAST_EXAMPLES) & (c + d > 0) & (a * d > b * c)).withColumn("chi", chi).where(F.col("chi") >= max(LEAST_CHI, LEAST_SHARE * n))
    return sorted(r["term"] for r in chosen.orderBy(F.desc("chi"), "term").limit(terms).select("term").collect())


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many there are."""
    size = len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, df = TermCounts(vocabulary), 0, np.zeros(size + 1, np.int64)
        for batch in batches:
            for (text,) in rows_of(iter([batch]), "text"):
                df[counts.of(text)[0]] += 1
                n += 1
        df[size] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(df)], names=["term", "n"])

    rows = texts(docs).select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(size + 1)
    for r in rows:
        df[r["term"]] = r["n"]
    return df[:size], int(df[size])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, calibration: int = CALIBRATION, terms: int = TERMS) -> tuple[Model | None, float]:
    """The model, none without examples of both classes, and the share of toxic labels."""
    examples, share = examples_of(docs, labels, sample, calibration)
    vocabulary = vocabulary_of(examples.where("learn"), terms)
    if not vocabulary:
        return None, share
    df, n = document_frequencies(docs, vocabulary)
    idf = np.log((1 + n) / (1 + df)) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = TermCounts(vocabulary)
        out = Rows(arrow_schema(doc_id=pa.int64(), label=pa.int32(), learn=pa.bool_(), terms=pa.binary(), weights=pa.binary()), most=512)
        for doc_id, text, label, learn in rows_of(batches, "doc_id", "text", "label", "learn"):
            found, times = counts.of(text)
            out.add(doc_id, label, learn, found.tobytes(), tfidf(found, times, idf).tobytes())
            if out.full():
                yield from out.take()
        yield from out.take()

    rows = examples.mapInArrow(vectors, "doc_id long, label int, learn boolean, terms binary, weights binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["terms"])))
    of = [(np.frombuffer(r["terms"], np.int64), np.frombuffer(r["weights"])) for r in rows]
    learn = [i for i, r in enumerate(rows) if r["learn"]]
    model = Model(vocabulary, idf, [of[i] for i in learn], np.array([rows[i]["label"] for i in learn], float), [rows[i]["doc_id"] for i in learn])
    index = Index(model.vectors, len(vocabulary))
    check = [i for i, r in enumerate(rows) if not r["learn"]]
    y = np.array([rows[i]["label"] for i in check], float)
    if 0 < y.sum() < len(y):
        votes = np.array([model.vote(index.nearest(*of[i], NEIGHBOURS)) for i in check])
        model.slope, model.shift = platt(votes, y)
        # The sample has as many toxic as other texts; all labels have not.
        model.shift += float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    else:
        model.slope, model.shift = 8.0, -4.0
    return model, share


SCORED = arrow_schema(
    doc_id=pa.int64(), held_out=pa.bool_(), score=pa.float64(), predicted=pa.int32(), neighbours=pa.list_(pa.int64()),
    similarities=pa.list_(pa.float64()),
)
SCORED_DDL = "doc_id long, held_out boolean, score double, predicted int, neighbours array<long>, similarities array<double>"


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, calibration: int = CALIBRATION, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Scores the whole text of every document by its nearest labelled examples.

    Returns doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on), neighbours (ids of the nearest
    examples, nearest first) and similarities. Labels of held-out documents are never read. A text
    without a known term, as an empty or null one, has no neighbours and the score of a vote of none.
    Without examples of both classes every score is the share of toxic labels, 0 without any. A row in
    is a row out, rows without doc_id too; other columns are left out.
    """
    model, share = train(docs, labels, sample, calibration)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(SCORED)  # the model comes with this function: it is bounded by the sample
        counts, index = (TermCounts(model.vocabulary), Index(model.vectors, len(model.vocabulary))) if model else (None, None)
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            near, p = [], share
            if model:
                found, times = counts.of(text)
                near = index.nearest(found, tfidf(found, times, model.idf), neighbours)
                p = model.score(near)
            out.add(doc_id, is_held_out(doc_id), p, int(p >= 0.5), [model.ids[i] for _, i in near], [s for s, _ in near])
            if out.full():
                yield from out.take()
        yield from out.take()

    return texts(docs).mapInArrow(score, SCORED_DDL)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns; all rows where
    no model could be fitted."""
    model, _ = train(docs, labels)
    if model is None:
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, index = TermCounts(model.vocabulary), Index(model.vectors, len(model.vocabulary))
        for batch in batches:
            kept = []
            for (text,) in rows_of(iter([batch]), "text"):
                found = counts.of(text or "")
                kept.append(model.score(index.nearest(found[0], tfidf(*found, model.idf), NEIGHBOURS)) < threshold)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
