"""Ranked lexical search by no-random-access (NRA) reads of an impact-sorted index.

A posting's impact is what its term adds to the score of its document. Postings are kept by levels of
impact, a folder each, and read from the highest level down, for all lists at once. What has been read
gives every document an interval: its lower score is the sum of the impacts read, its upper score adds,
for each term of the item not seen in the document, the largest impact which that list still has. An item
is settled once a document that was not seen at all can't enter: once the sum of what all its lists still
have is below the lower score of the k-th best. Documents whose upper score reaches that are candidates;
the levels below are read on for them only, until their scores are whole, and ties are settled by id.

Each round reads about three times as much as all before, so reading again what was read before costs
half as much as the last round. All state is in tables; the driver sees one number a round, the counts of levels
and the items' vocabulary, a bounded block of items at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strongbox.llm.tables import Rows, arrow_schema, rows_of, written
from strongbox.llm.words import LOWER
from strongbox.workspace import new_folder

#: What stands in no term becomes a blank, A-Z become lower case; all else stays, so do the bytes of
#: other characters.
TERMS = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Terms of items handled together, about: their vocabulary goes to every task.
BLOCK = 100_000
#: Each round reads so many times what was read before it.
MORE = 3
#: Levels of impact an octave; lower scores are counted in so many bins an octave.
LEVELS, BINS = 2, 32


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TERMS).split()


def item_terms(items: DataFrame) -> DataFrame:
    """The distinct terms of each item: item_id, term."""
    schema = arrow_schema(item_id=pa.int64(), term=pa.string())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for item_id, text in rows_of(batches, "item_id", "text"):
            for term in set(terms_of(text)):
                out.add(item_id, term.decode(), size=len(term))
            if out.full():
                yield from out.take()
        yield from out.take()

    given = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    return given.mapInArrow(split, "item_id long, term string").distinct()


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row per document: row (a number of its own), doc_id, n (all its terms), and of the vocabulary's
    terms that it holds the numbers and frequencies."""
    schema = arrow_schema(doc_id=pa.int64(), n=pa.int64(), terms=pa.list_(pa.int32()), tfs=pa.list_(pa.int32()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            found = terms_of(text)
            held = [(vocabulary[t], tf) for t, tf in Counter(found).items() if t in vocabulary]
            out.add(doc_id, len(found), [t for t, _ in held], [tf for _, tf in held], size=8 * len(held))
            if out.full():
                yield from out.take()
        yield from out.take()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = given.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "forward")  # fixed once it is written


def postings(index: DataFrame) -> DataFrame:
    """A row per document and term that it holds: term, tf, n, row."""
    each = index.select("row", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("of"))
    return each.select(F.col("of.terms").alias("term"), F.col("of.tfs").cast("long").alias("tf"), "n", "row")


def ranked(items: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` highest-scoring documents of each item, with score above 0: item_id, rank, doc_id, score.

    Terms are runs of digits, letters A-Z (lower-cased) and characters beyond U+007F. N counts the
    documents with a term, L all their terms, n those of one document, df the documents that hold a term,
    tf its occurrences in one. A term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), a document has
    m = 10 + (90 n N) div L, and scores the sum of w ((10^9 tf) div (1000 tf + 8 m)) over the item's
    distinct terms; equal scores come by ascending doc_id.

    Null and empty texts hold no terms and are never found; such items find nothing. Rows of ``docs`` that
    share a doc_id are documents of their own, those without one come last among equals. Rows of ``items``
    that share an item_id are one item; those without one are left out. Other columns are not used.
    """
    every = written(item_terms(items), "items")
    blocks = -(-every.count() // BLOCK) or 1
    own = [every.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) for b in range(blocks)]
    return reduce(DataFrame.unionByName, [_ranked(terms, docs, k) for terms in own])


def _ranked(every: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The same for one block of items, given as their terms."""
    vocabulary = {r["term"].encode(): i for i, r in enumerate(every.select("term").distinct().orderBy("term").collect())}
    numbered = every.sparkSession.createDataFrame([(t.decode(), i) for t, i in vocabulary.items()], "word string, term int")
    every = written(every.join(F.broadcast(numbered), F.col("word") == every["term"]).select("item_id", numbered["term"]), "items")
    index = forward(docs, vocabulary)
    size, length = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    # The index: postings with their impact, in a folder for each level.
    held = postings(index).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * size + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")
    asked = every.groupBy("term").agg(F.count("*").alias("items"))
    weights = written(held.select("term", weight).join(asked, "term"), "weights")
    m = F.expr(f"10 + (90 * n * {size}L) div {max(length, 1)}L")
    impacts = postings(index).join(F.broadcast(weights), "term").withColumn("m", m).withColumn(
        "impact", F.expr("w * ((1000000000L * tf) div (1000 * tf + 8 * m))")
    )
    level = F.floor(F.log2("impact") * LEVELS).cast("int").alias("level")
    path = new_folder(docs.sparkSession, "postings")
    impacts.where("impact > 0").select("term", "impact", "row", level).write.partitionBy("level").parquet(path)
    read = docs.sparkSession.read.schema("term int, impact long, row long, level int").parquet(path)
    lists = written(read.groupBy("term", "level").agg(F.max("impact").alias("most"), F.count("*").alias("n")), "lists")

    # How far down each round reads, by the counts of levels.
    counts = lists.join(F.broadcast(asked), "term").groupBy("level").agg(F.sum(F.col("n") * F.col("items")).alias("n"))
    reaches = _reaches({r["level"]: r["n"] for r in counts.collect()}, k * every.select("item_id").distinct().count())

    pending, scores = every, []
    for reach in reaches:
        state, floors = _round(read, lists, pending, reach, k)
        settled = floors.where("ahead < least")
        candidates = written(state.join(F.broadcast(settled), "item_id").where("lower + ahead - passed >= least").select("item_id", "row", "lower"), "candidates")
        scores.append(_finished(read, pending, candidates, reach))
        pending = written(pending.join(F.broadcast(settled), "item_id", "left_anti"), "pending")
        if pending.isEmpty():
            break
    none = every.sparkSession.createDataFrame([], "item_id long, row long, score long")
    total = reduce(DataFrame.unionByName, scores, none)
    order = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    named = written(total, "scores").join(index.select("row", "doc_id"), "row")
    return named.withColumn("rank", order).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _reaches(counts: dict[int, int], first: int) -> list[int]:
    """The lowest level that each round reads: the first reads ``first`` postings or more, each other one
    ``MORE`` times as many as before, the last one all."""
    out, read, target = [], 0, first
    for level in sorted(counts, reverse=True):
        read += counts[level]
        if read >= target:
            out.append(level)
            target = MORE * read
    lowest = min(counts, default=0)
    return out if not counts or lowest in out else [*out, lowest]


def _round(read: DataFrame, lists: DataFrame, pending: DataFrame, reach: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Reads the levels down to ``reach`` for the items in ``pending``. The first table has their documents:
    item_id, row, lower, and passed (what the lists that saw the document still have). The second has a row
    an item: ahead (what all its lists still have) and least, which k documents reach, or 1."""
    below = lists.where(F.col("level") < reach).groupBy("term").agg(F.max("most").alias("ahead"))
    terms = pending.join(F.broadcast(below), "term", "left").withColumn("ahead", F.coalesce("ahead", F.lit(0)))
    seen = read.where(F.col("level") >= reach).join(F.broadcast(terms), "term")
    state = written(seen.groupBy("item_id", "row").agg(F.sum("impact").alias("lower"), F.sum("ahead").alias("passed")), "state")
    binned = state.groupBy("item_id", F.floor(F.log2("lower") * BINS).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    # An item has no more bins than scores have octaves, times BINS.
    reached = F.sum("n").over(Window.partitionBy("item_id").orderBy(F.desc("bin")))
    edge = F.floor(F.pow(F.lit(2.0), F.col("bin") / BINS) * (1 - 1e-9)).cast("long")
    least = binned.withColumn("reached", reached).where(F.col("reached") >= k).groupBy("item_id").agg(F.max(F.greatest(edge, F.lit(1))).alias("least"))
    ahead = terms.groupBy("item_id").agg(F.sum("ahead").alias("ahead"))
    return state, written(ahead.join(least, "item_id", "left").select("item_id", "ahead", F.coalesce("least", F.lit(1)).alias("least")), "floors")


def _finished(read: DataFrame, pending: DataFrame, candidates: DataFrame, reach: int) -> DataFrame:
    """The whole scores of candidates: what the levels below ``reach`` add."""
    rest = read.where(F.col("level") < reach).join(candidates.select("item_id", "row"), "row")
    rest = rest.join(F.broadcast(pending), ["item_id", "term"]).select("item_id", "row", F.col("impact").alias("score"))
    both = rest.unionByName(candidates.select("item_id", "row", F.col("lower").alias("score")))
    return both.groupBy("item_id", "row").agg(F.sum("score").alias("score"))


#: The same in SQL: every document that holds a term of the item is scored.
RANKED_SQL = r"""
with split as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where text is not null),
sizes as (
  select cast(count(*) filter (len(terms) > 0) as bigint) as size, cast(sum(len(terms)) as bigint) as length from split),
counted as (
  select doc_id, n, term, count(*) as tf from (select doc_id, cast(len(terms) as bigint) as n, unnest(terms) as term from split) group by all),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
weights as (
  select term, cast(floor(1000 * ln((2 * size + 2) / (2 * count(*) + 1))) as bigint) as w
  from counted, sizes where term in (select term from asked) group by term, size),
impacts as (
  select term, doc_id, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * size) // length))) as impact
  from counted join weights using (term), sizes),
scored as (
  select item_id, doc_id, cast(sum(impact) as bigint) as score from asked join impacts using (term) group by all having sum(impact) > 0)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from scored qualify rank <= 10
"""
