"""SimHash near-dedup by an inverted index on the bytes of fingerprints and their positions.

A fingerprint of 64 bits is eight bytes, each in its position. Two that differ in at most three bits
share at least five positional bytes, and three of these lie in one half of the positions: so a list of
the index is kept for every three positions of a half, eight lists a fingerprint. Where the members of a
list meet, the positional bytes that each two share are tallied, pairs below the guaranteed minimum are
left out, and the bits of the rest are compared. (A list for one position alone would hold one
fingerprint in 256, and its tallies grow with the square of the table.)

A list passes on what it found as a spanning forest, not as pairs, so what leaves it grows with its
members only. Lists that are too long to compare are not compared: their fingerprints are indexed again
by every five positions, which all their links share. Such a list has three free bytes, so it holds
2**24 fingerprints at most, and there the partners of a fingerprint are looked up by flipping bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strongbox.llm.components import components
from strongbox.llm.tables import arrow_schema, partitions, rows_of, texts, with_hot, written
from strongbox.llm.words import words_of

SEED = 42
POSITIONS = 8
#: The most differing bits for which three positions of a half suffice.
MOST_BITS = 3
FIRST = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
SECOND = list(combinations(range(POSITIONS), POSITIONS - MOST_BITS))
#: Members of a list beyond which it is indexed again, and beyond which bits are flipped.
LIST, FLIPPED = 4096, 1024
#: Lists are counted in so many buckets.
BUCKETS = 1 << 20


def fingerprint(words: list[bytes], size: int) -> int:
    """A bit is set if it is set in more than half of the hashes of the shingles, repeats included."""
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    last = ends[min(size, len(words)) - 1 :]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        places = zip(starts[at : at + 65536].tolist(), last[at : min(n, at + 65536)].tolist())
        h = np.array([digest(joined[a:b], SEED) for a, b in places], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and fingerprint (as a signed number) of every row."""
    schema = arrow_schema(doc_id=pa.int64(), f=pa.int64())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(d, fingerprint(words_of(t, lower=True), size)) for d, t in rows_of([batch], "doc_id", "text")]
            if found:
                ids, f = zip(*found, strict=True)
                signed = pa.array(np.array(f, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), signed], schema=schema)

    return texts(docs).mapInArrow(make, "doc_id long, f long")


def mask(positions: tuple[int, ...]) -> int:
    """The bits of these bytes."""
    return sum(0xFF << 8 * p for p in positions)


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def indexed(fingers: DataFrame, lists: list[tuple[int, ...]]) -> DataFrame:
    """A row per fingerprint and list: part (which positions), bytes (what stands there), f, node."""
    keys = [F.struct(F.lit(i).alias("part"), F.col("f").bitwiseAND(F.lit(signed(mask(p)))).alias("bytes")) for i, p in enumerate(lists)]
    return fingers.select("f", "node", F.explode(F.array(*keys)).alias("key")).select("key.part", "key.bytes", "f", "node")


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member that each one reaches, once links (a, b) are added to what ``label`` says of it."""
    while True:
        apart = label[a] != label[b]
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while not np.array_equal(up := label[label], label):
            label = up


def compared(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether fingerprints link: by the tally of positional bytes that they share, then by their bits."""
    apart = a ^ b
    tally = (apart[..., None].view(np.uint8).reshape(*apart.shape, POSITIONS) == 0).sum(-1, dtype=np.int8)
    link = tally >= POSITIONS - bits
    link[link] = np.bitwise_count(apart[link]) <= bits
    return link


def among(f: np.ndarray, bits: int) -> np.ndarray:
    """The forest of a list's links, each member compared with all others, some rows at a time. Links are
    added to the forest as they are found, so that many of them need no room."""
    label, step = np.arange(len(f)), max(1, (1 << 18) // len(f))
    for at in range(0, len(f), step):
        i, j = np.nonzero(compared(f[at : at + step, None], f[None, at:], bits))
        label = forest(label, i[i < j] + at, j[i < j] + at)
    return label


def by_flips(f: np.ndarray, positions: tuple[int, ...], bits: int) -> np.ndarray:
    """The same where all bytes but three are shared: partners are what is reached by flipping bits."""
    free = [p for p in range(POSITIONS) if p not in positions]
    value = sum(((f >> np.uint64(8 * p)) & np.uint64(0xFF)) << np.uint64(8 * i) for i, p in enumerate(free)).astype(np.int64)
    at = np.full(1 << 8 * len(free), -1, np.int32)
    at[value] = np.arange(len(f))
    flips = [sum(1 << b for b in chosen) for k in range(1, bits + 1) for chosen in combinations(range(8 * len(free)), k)]
    label = np.arange(len(f))
    while True:
        before = label.copy()
        for flip in flips:
            other = at[value ^ flip]
            held = np.flatnonzero(other >= 0)
            if len(held):
                label[held] = np.minimum(label[held], label[other[held]])
        label = label[label]
        if np.array_equal(label, before):
            return label


FOUND = arrow_schema(again=pa.bool_(), a=pa.int64(), b=pa.int64())


def met(postings: DataFrame, lists: list[tuple[int, ...]], bits: int, longest: int | None) -> DataFrame:
    """What the lists of an index found: rows (again, a, b). A link that joins the nodes a and b, or,
    ``again``, the fingerprint a and its node b from a list of more than ``longest`` members."""

    def rows(again: bool, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), 65536):
            part = [pa.array(x[at : at + 65536].astype(np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), again)), *part], schema=FOUND)

    def close(part: np.ndarray, key: np.ndarray, f: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole lists, one behind another."""
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        sizes = np.diff(np.append(starts, len(key)))
        short = np.repeat(sizes, sizes) <= 32
        label = np.arange(len(f))
        for d in range(1, min(32, int(sizes.max()))):  # in short lists, each member with that d places on
            i = np.flatnonzero(short[:-d] & (key[d:] == key[:-d]) & (part[d:] == part[:-d]))
            i = i[compared(f[i], f[i + d], bits)]
            label = forest(label, i, i + d)
        own = np.flatnonzero(label != np.arange(len(f)))
        yield from rows(False, node[own], node[label[own]])
        for at, n in zip(starts[sizes > 32], sizes[sizes > 32], strict=True):
            one, its = f[at : at + n], node[at : at + n]
            label = by_flips(one, lists[part[at]], bits) if longest is None and n > FLIPPED else among(one, bits)
            own = np.flatnonzero(label != np.arange(n))
            yield from rows(False, its[own], its[label[own]])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, t) for t in (np.int32, np.int64, np.uint64, np.int64)]
        for batch in batches:
            more = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("part", "bytes", "f", "node")]
            more[2] = more[2].view(np.uint64)
            held = [np.concatenate(x) for x in zip(held, more, strict=True)]
            if len(held[0]) < 200_000:
                continue
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            cut = len(last) - int(last.sum())  # the last list may go on
            yield from split([x[:cut] for x in held])
            held = [x[cut:] for x in held]
            if longest is not None and len(held[0]) > longest:
                yield from rows(True, held[2][longest + 1 :].view(np.int64), held[3][longest + 1 :])
                held = [x[: longest + 1] for x in held]  # enough to tell that it is too long
        yield from split(held)

    def split(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        part, key, f, node = held
        if not len(key):
            return
        if longest is not None:
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            sizes = np.diff(np.append(starts, len(key)))
            over = np.repeat(sizes > longest, sizes)
            yield from rows(True, f[over].view(np.int64), node[over])
            part, key, f, node = (x[~over] for x in held)
        if len(key) > 1:
            yield from close(part, key, f, node)

    dealt = postings.repartition(partitions(postings.sparkSession), "part", "bytes").sortWithinPartitions("part", "bytes")
    return dealt.select("part", "bytes", "f", "node").mapInArrow(meet, "again boolean, a long, b long")


def linked(fingers: DataFrame, bits: int = MOST_BITS, longest: int = LIST) -> DataFrame:
    """Links (a, b) that connect the nodes of all fingerprints that differ in at most ``bits`` bits, not
    each pair of them. ``fingers`` has rows (f, node), each fingerprint once."""
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"fingerprints link at up to {MOST_BITS} differing bits")
    postings = indexed(fingers, FIRST)
    bucket = F.pmod(F.xxhash64("part", "bytes"), F.lit(BUCKETS)).alias("bucket")
    counted = written(postings.groupBy(bucket).count(), "buckets")
    total = counted.agg(F.sum("count")).first()[0] or 0
    # Lists that hold more than a share of all postings are at most so many; they are not even shuffled.
    hot = F.broadcast(counted.where(F.col("count") > max(longest, total // 10_000)).select("bucket"))
    rest = postings.withColumn("bucket", bucket).join(hot, "bucket", "left_anti")
    found = written(met(rest, FIRST, bits, longest), "links")
    hot_ones = postings.withColumn("bucket", bucket).join(hot, "bucket", "left_semi").select("f", "node")
    again = written(hot_ones.unionByName(found.where("again").select(F.col("a").alias("f"), F.col("b").alias("node"))).distinct(), "again")
    links = found.where("not again").select("a", "b")
    if again.isEmpty():
        return links
    return links.unionByName(written(met(indexed(again, SECOND), SECOND, bits, None), "links").select("a", "b"))


def simhash_join(docs: DataFrame, size: int = 3, bits: int = MOST_BITS) -> DataFrame:
    """Groups of documents linked by fingerprints that differ in at most ``bits`` bits.

    Words are lower-cased in A-Z and set apart by white space. A document's shingles are its
    ``size``-word runs, repeats included, joined by a blank, with fewer words the whole sequence; a
    bit of the fingerprint is 1 if it is set in over half of the shingles' XXH64. Returns doc_id,
    fingerprint (16 lowercase hex digits) and component_id (the smallest doc_id reached by links, its
    own included), a row per row. Null and empty texts, and those without words, have fingerprint zero
    and link like any other. Rows without doc_id keep their fingerprint, link with nothing and have no
    component_id. Rows that share a doc_id are one document: the links of any count. Other columns are
    left out.
    """
    made = written(fingerprints(docs, size), "fingerprints")
    known = made.where("doc_id is not null")
    # One node stands for all documents with its fingerprint: the smallest id.
    fingers = written(known.groupBy("f").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "fingers")
    # A doc_id with several fingerprints links these.
    several = known.groupBy("doc_id").agg(F.min("f").alias("f"), F.max("f").alias("g")).where("f <> g").select("doc_id")
    shared = known.join(several, "doc_id", "left_semi").distinct().join(fingers, "f").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = linked(fingers.select("f", "node")).unionByName(shared)
    found = components(links)
    of = fingers.join(found, "node", "left").select("f", "n", F.coalesce("component", "node").alias("component"))
    of = written(of, "of")
    return with_hot(made, of, "f", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )
