"""N-gram Jaccard join: size-banded tiles, bitmaps that bound the overlap, exact intersections.

Two sets of sizes a, b with Jaccard similarity of t percent differ in at most (a + b)(100 - t)/(100 + t)
elements. Sizes are cut into bands; for each band that bounds the number k of differing elements, the
space of hashes is cut into more than k parts, so two similar sets agree wholly in one of them. A tile
is the sets of a band that agree in a part. Sets with so many empty parts that they may agree in empty
ones only also join tiles of the first elements of their sorted hashes, one of which similar sets share.

Tiles of thousands of near copies are not turned into pairs. Their sets are first compared with one
pivot each, reduced within the tasks that read the texts; what is linked becomes a component. Only
where a tile holds sets of several components are these compared with each other, in blocks: equal
bits of their bitmaps bound the overlap from above, and what passes is intersected exactly.

Sets are held as sorted 64-bit hashes of their shingles.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strongbox.llm.components import components
from strongbox.llm.tables import Rows, arrow_schema, partitions, rows_of, texts, written
from strongbox.llm.words import MIX2, Memo, mixed, shingles, word_hashes, words_of

#: Parts beyond the number of differing elements: so many may be empty before first elements are used.
SLACK = 2
#: Sets compared with each other at once.
BLOCK = 1024
#: So many pairs of them are looked at together.
PAIRS = 1 << 15
#: So many of its tiles a node carries along there.
LEAST_TILES = 8
#: Slots of a bitmap for each element of a set: with few, differences fall together and cancel.
SLOTS = 2
#: Words of a bitmap that are compared first.
COARSE = 8
#: Signatures that a task holds before it gives them out, and words whose hashes it remembers.
HELD, REMEMBERED = 1_000_000, 150_000
#: A filter of so many 64-bit words tells which documents are needed again; it is broadcast.
FILTER_WORDS = 1 << 17


class Bands:
    """Bands of set sizes for a similarity of at least ``percent``."""

    def __init__(self, percent: int):
        self.percent = percent
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, self.starts[-1] * 3 // 2))

    def of(self, n: int) -> list[int]:
        """The bands in which a set of n elements may be the larger or the smaller of a pair."""
        own = bisect_right(self.starts, n) - 1
        out, band = [own], own + 1
        while self.starts[band] * self.percent <= 100 * n:
            out.append(band)
            band += 1
        return out

    def differing(self, band: int) -> int:
        """The most elements by which two similar sets differ, the larger being of the band."""
        return 2 * (self.starts[band + 1] - 1) * (100 - self.percent) // (100 + self.percent)

    def parts(self, band: int) -> int:
        k = self.differing(band)
        return k + 1 + SLACK if k else 1

    def prefix(self, n: int) -> int:
        """So many smallest hashes of two similar sets have one in common."""
        return n - -(-self.percent * n // 100) + 1


def signatures(h: np.ndarray, bands: Bands) -> np.ndarray:
    """The tiles of a set, as hashes."""
    if not len(h):
        return h
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h))])
    out = []
    for band in bands.of(len(h)):
        parts = bands.parts(band)
        bounds = np.array([-(-(p << 64) // parts) for p in range(1, parts)], np.uint64)
        at = np.concatenate([[0], np.searchsorted(h, bounds), [len(h)]])
        filled = at[1:] > at[:-1]
        name = np.uint64(band << 40) + np.arange(parts, dtype=np.uint64) * np.uint64(2)
        out.append(mixed((sums[at[1:]] - sums[at[:-1]]) * MIX2 + name)[filled])
        if parts - filled.sum() >= parts - bands.differing(band) and parts > 1:
            first = h[: bands.prefix(len(h))]
            out.append(mixed(mixed(first) * MIX2 + np.uint64((band << 40) + 1)))
    return np.concatenate(out)


def bitmap(h: np.ndarray) -> np.ndarray:
    """Parities of the set's elements in ``SLOTS`` times as many slots, a power of two from 64 on."""
    bits = 64
    while bits < SLOTS * len(h):
        bits *= 2
    slot = (mixed(h ^ MIX2) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=bits) & 1).astype(np.uint8), bitorder="little").view("<u8")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap as one of fewer slots: slots that fall together add up their parities."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def similar(overlap, a, b, percent: int):
    """Whether an overlap of sets of a and b elements reaches the similarity."""
    return 100 * overlap >= percent * (a + b - overlap)


MADE = arrow_schema(kind=pa.int32(), bucket=pa.int32(), data=pa.binary())


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of equal sorted keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def _starred(sigs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of members (tile, node): tiles and their smallest nodes; and of tiles with several, members and pivots."""
    order = np.lexsort((nodes, sigs))
    sigs, nodes = sigs[order], nodes[order]
    starts, sizes = _runs(sigs)
    pivots = nodes[starts]
    many = np.repeat(sizes > 1, sizes)
    return sigs[starts], pivots, sigs[many], nodes[many], np.repeat(pivots, sizes)[many]


def members(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """What the texts' tiles hold: rows (kind, a, b, c). Kind 1: tile, member and pivot, of tiles with
    several members. Kind 2: doc_id, size of the set, and a document known to have the same set."""
    spark = docs.sparkSession
    buckets = partitions(spark) * 8

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bands = word_hashes(most=REMEMBERED), Bands(percent)
        sigs, nodes, info, known, held = [], [], [], {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            out = Rows(MADE, most=256)
            if sigs:
                tiles, pivots, *stars = _starred(np.concatenate(sigs), np.concatenate(nodes))
                for a in range(0, len(stars[0]), 65536):
                    own = [x[a : a + 65536] for x in stars]
                    out.add(1, int(own[0][0] % np.uint64(buckets)), b"".join(x.tobytes() for x in own))
                bucket = (tiles % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                starts, sizes = _runs(bucket[order])
                for a, n in zip(starts, sizes, strict=True):
                    part = order[a : a + n]
                    out.add(0, int(bucket[part[0]]), tiles[part].tobytes() + pivots[part].tobytes())
            if info:
                at = xxhash.xxh32_intdigest(str(info[0]).encode()) % buckets
                table = pa.table({c: pa.array(v, pa.int64()) for c, v in zip("abc", zip(*info, strict=True), strict=True)})
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as stream:
                    stream.write_table(table)
                out.add(2, at, sink.getvalue().to_pybytes())
            yield from out.take()

        for doc_id, text in rows_of(batches, "doc_id", "text"):
            h = shingles(words_of(text, lower=True), size, memo)
            same = doc_id
            if doc_id is not None and len(h):
                same = known.setdefault(xxhash.xxh3_128_digest(h.tobytes()), doc_id)
                if same == doc_id:
                    own = signatures(h, bands)
                    sigs.append(own)
                    nodes.append(np.full(len(own), doc_id, np.int64))
                    held += len(own)
            info.append((doc_id, len(h), same))
            if held >= HELD or len(info) >= 100_000:
                yield from flush()
                sigs, nodes, info, known, held = [], [], [], {}, 0
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(kind=pa.int32(), a=pa.int64(), b=pa.int64(), c=pa.int64())

        def rows(kind: int, *columns: np.ndarray | pa.Array) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(columns[0]), 65536):
                own = [pa.array(x[at : at + 65536].view(np.int64)) if isinstance(x, np.ndarray) else x[at : at + 65536] for x in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[0]), kind, np.int32)), *own], schema=schema)

        def close(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
            if blocks:
                both = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in blocks]
                _, _, *stars = _starred(np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both]).view(np.int64))
                yield from rows(1, *stars)

        now, blocks = None, []
        for kind, bucket, data in rows_of(batches, "kind", "bucket", "data"):
            if bucket != now:
                yield from close(blocks)
                now, blocks = bucket, []
            if kind == 0:
                blocks.append(data)
            elif kind == 1:
                yield from rows(1, *np.frombuffer(data, np.int64).reshape(3, -1))
            else:
                table = pa.ipc.open_stream(data).read_all().combine_chunks()
                yield from rows(2, *(table.column(c).combine_chunks() for c in "abc"))
        yield from close(blocks)

    made = texts(docs).mapInArrow(make, "kind int, bucket int, data binary")
    dealt = made.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    return written(dealt.mapInArrow(meet, "kind int, a long, b long, c long"), "tiles")


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of the documents among ``nodes``. A filter of fixed size, one bit for a document,
    keeps most others out before texts are shuffled; the join keeps out the rest."""
    h = F.xxhash64("node")
    at, shift = F.pmod(h, F.lit(FILTER_WORDS)), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int")
    bits = nodes.select(at.alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), shift).alias("bit"))
    bits = F.broadcast(bits.groupBy("at").agg(F.expr("bit_or(bit)").alias("bits")))  # at most FILTER_WORDS rows
    given = texts(docs).withColumnRenamed("doc_id", "node").where("node is not null")
    likely = given.withColumns({"at": at, "shift": shift}).join(bits, "at")
    likely = likely.where(F.call_function("shiftrightunsigned", F.col("bits"), F.col("shift")).bitwiseAND(F.lit(1)) == 1)
    return written(likely.select("node", "text").join(nodes, "node", "left_semi"), "texts")


def _set(text: str, size: int, memo: Memo) -> np.ndarray:
    return shingles(words_of(text, lower=True), size, memo)


SIGNED = arrow_schema(node=pa.int64(), n=pa.int64(), bits=pa.binary())


def signed(known: DataFrame, size: int) -> DataFrame:
    """Size and bitmap of documents' sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, out = word_hashes(most=REMEMBERED), Rows(SIGNED)
        for node, text in rows_of(batches, "node", "text"):
            h = _set(text, size, memo)
            if len(h):
                out.add(node, len(h), bitmap(h).tobytes())
                if out.full():
                    yield from out.take()
        yield from out.take()

    return known.select("node", "text").mapInArrow(sign, "node long, n long, bits binary")


def bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps allow the similarity."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(a=pa.int64(), b=pa.int64()))
        for a, b, na, nb, bits_a, bits_b in rows_of(batches, "a", "b", "na", "nb", "bits_a", "bits_b"):
            x, y = np.frombuffer(bits_a, "<u8"), np.frombuffer(bits_b, "<u8")
            words = min(len(x), len(y))
            apart = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
            if 100 * min(na, nb) >= percent * max(na, nb) and similar((na + nb - apart) // 2, na, nb, percent):
                out.add(a, b)
                if out.full():
                    yield from out.take()
        yield from out.take()

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b")), "b")
    return both.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(bound, "a long, b long")


def verified(pairs: DataFrame, known: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b), which passed the bound, whose sets are similar.

    ``known`` has their texts: these are half as large as the sorted arrays, which are made where the
    pairs meet."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, memo, recent = Rows(arrow_schema(a=pa.int64(), b=pa.int64())), word_hashes(most=REMEMBERED), {}

        def of(node: int, text: str) -> np.ndarray:
            if (node, text) not in recent:
                if len(recent) >= 64:
                    recent.clear()
                recent[node, text] = _set(text, size, memo)
            return recent[node, text]

        for a, b, text_a, text_b in rows_of(batches, "a", "b", "text_a", "text_b"):
            x, y = of(a, text_a), of(b, text_b)
            if len(x) and len(y) and similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                out.add(a, b)
                if out.full():
                    yield from out.take()
        yield from out.take()

    # Written down, few pairs are known to be few, and the texts needn't be shuffled.
    pairs = written(pairs, "pairs")
    both = pairs.join(known.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(known.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return written(both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"), "links")


def different(tiles: DataFrame) -> DataFrame:
    """One tile for each set of members: documents that share a passage share many tiles, and comparing
    them in one of these does. Sets are told apart by their size and two hashes of 64 bits."""
    members = tiles.groupBy("tile").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")
    )
    return members.groupBy("n", "x", "y").agg(F.min("tile").alias("tile")).select("tile")


def compared(key: tuple, rows: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """The pairs of a place (tile, two of its blocks) that :func:`across` gives out; ``rows`` hold block,
    node, component, size, bitmap and smallest tiles."""
    own, node, component, n = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[:4])
    none, bits = np.iinfo(np.int64).max, None
    # Strips of rows are compared with all that follow.
    strip = max(1, PAIRS // len(rows))
    for top in range(0, len(rows), strip):
        i, rest = slice(top, top + strip), slice(top, None)
        small, large = np.minimum(n[i, None], n[rest]), np.maximum(n[i, None], n[rest])
        fits = (100 * small >= percent * large) & (component[i, None] != component[rest])
        if key[1] != key[2]:
            fits &= own[i, None] != own[rest]
        x, y = np.nonzero(fits)
        x, y = x[y > x] + top, y[y > x] + top
        if not len(x):
            continue
        if bits is None:
            maps = [np.frombuffer(r[4], "<u8") for r in rows]
            words = min(map(len, maps))
            bits = np.stack([folded(x, words) for x in maps])
            coarse = folded(bits, min(words, COARSE))
            least = np.array([r[5] + [none] * (LEAST_TILES - len(r[5])) for r in rows], np.int64)
            earlier = least < key[0]
        for level in (coarse, bits):
            some = max(1, PAIRS * COARSE // level.shape[1])
            apart = [np.bitwise_count(level[x[a : a + some]] ^ level[y[a : a + some]]).sum(1, dtype=np.int64) for a in range(0, len(x), some)]
            apart = np.concatenate([np.empty(0, np.int64), *apart])
            near = similar((n[x] + n[y] - apart) // 2, n[x], n[y], percent)
            x, y = x[near], y[near]
        shared = (least[x][:, :, None] == least[y][:, None, :]) & earlier[x][:, :, None]
        new = ~shared.any((1, 2))
        for a, b in zip(node[x[new]].tolist(), node[y[new]].tolist(), strict=True):
            yield min(a, b), max(a, b)


def across(tiles: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of different components in a tile whose bitmaps allow the similarity.

    ``tiles`` has rows (tile, node, component). Large tiles are compared in blocks, each pair of blocks
    in a place of its own. A pair that shares several tiles is given out in the smallest of them: each
    node carries its smallest tiles along. (Where these don't tell, it is given out again.)"""
    sizes = tiles.groupBy("tile").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = tiles.join(sizes, "tile").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A node has no more tiles than its text has words.
    least = tiles.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("tile")), 1, LEAST_TILES).alias("least"))
    dealt = dealt.join(sets.select("node", "n", "bits").join(least, "node"), "node").select(
        F.col("tile"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "n", "bits", "least"
    )
    columns = ("tile", "i", "j", "own", "node", "component", "n", "bits", "least")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(arrow_schema(a=pa.int64(), b=pa.int64()))

        key, rows = None, []
        for *now, own, node, component, n, bits, least in rows_of(batches, *columns):
            if now != key:
                if len(rows) > 1:
                    for pair in compared(key, rows, percent):
                        out.add(*pair)
                    if out.full():
                        yield from out.take()
                key, rows = now, []
            rows.append((own, node, component, n, bits, least))
        if len(rows) > 1:
            for pair in compared(key, rows, percent):
                out.add(*pair)
        yield from out.take()

    ordered = dealt.repartition(partitions(tiles.sparkSession), "tile", "i", "j").sortWithinPartitions("tile", "i", "j")
    return ordered.select(*columns).mapInArrow(compare, "a long, b long").distinct()


def jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by similar sets of shingles.

    A document's set: the distinct ``size``-word shingles of its whole text, words lower-cased in A-Z
    and set apart by white space; with fewer words the whole sequence. Documents link when 100 times
    the intersection is at least ``percent`` times the union. Returns doc_id, n_shingles and
    component_id (the smallest doc_id reached by links, its own included), a row per row. Empty and
    null texts have no shingles and no links. Rows without doc_id keep n_shingles, link with nothing
    and have no component_id. Rows that share a doc_id are one document: the links of any count.
    """
    made = members(docs, size, percent)
    info = made.where("kind = 2").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("same"))
    tiles = made.where("kind = 1").select(F.col("a").alias("tile"), F.col("b").alias("node"), F.col("c").alias("pivot"))
    known = texts_of(docs, tiles.select("node").distinct())
    sets = written(signed(known, size), "sets")
    offered = written(tiles.where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("n")), "offered")

    # First every document with the pivot that it shares most tiles with.
    best = offered.groupBy("node").agg(F.max(F.struct("n", (-F.col("pivot")).alias("pivot"))).alias("best"))
    links = verified(bounded(best.select(F.col("node").alias("a"), (-F.col("best.pivot")).alias("b")), sets, percent), known, size, percent)
    equal = info.where("doc_id <> same").select(F.col("doc_id").alias("a"), F.col("same").alias("b"))
    found = components(links.unionByName(equal))

    def current(rows: DataFrame, node: str, found: DataFrame) -> DataFrame:
        of = found.select(F.col("node").alias(node), F.col("component").alias(f"of_{node}"))
        return rows.join(of, node, "left").withColumn(f"of_{node}", F.coalesce(f"of_{node}", node))

    def apart(found: DataFrame) -> DataFrame:
        """Offered pairs of a document and a pivot that are not in one component."""
        return current(current(offered, "node", found), "pivot", found).where("of_node <> of_pivot")

    def joined(found: DataFrame, links: DataFrame) -> DataFrame:
        if links.isEmpty():
            return found
        return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))

    # Then, for each other component that has pivots of its, the one that it shares most tiles with.
    rest = apart(found).groupBy("node", "of_pivot").agg(F.max(F.struct("n", (-F.col("pivot")).alias("pivot"))).alias("best"))
    links = verified(bounded(rest.select(F.col("node").alias("a"), (-F.col("best.pivot")).alias("b")), sets, percent), known, size, percent)
    found = joined(found, links)

    # Then whatever else shares a tile across components. Such a tile has a pivot of another component.
    refused = written(apart(found).select("node", "pivot"), "refused")
    if not refused.isEmpty():
        open_ = tiles.join(refused, ["node", "pivot"], "left_semi").select("tile").distinct()
        held = written(tiles.join(open_, "tile", "left_semi").select("tile", "node").distinct(), "held")
        held = current(held.join(different(held), "tile", "left_semi"), "node", found)
        held = written(held.withColumnRenamed("of_node", "component"), "held")
        found = joined(found, verified(across(held, sets, percent), known, size, percent))
    return info.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those linked to a document with a smaller id. Rows without doc_id stay."""
    more = jaccard_join(docs, size, percent).where("component_id < doc_id").select(F.col("doc_id").alias("__doc_id")).distinct()
    return docs.join(more, docs["doc_id"] == F.col("__doc_id"), "left_anti")


#: The links of ``size`` 4 and ``percent`` 85 in SQL: every two documents that share a shingle are compared.
JACCARD_SQL = r"""
with recursive split as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents),
shingles as (
  select distinct doc_id, array_to_string(words[i : i + 3], ' ') as shingle
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) as i from split where len(words) > 0)),
sizes as (
  select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
links as (
  select s.a, s.b from shared s join sizes x on x.doc_id = s.a join sizes y on y.doc_id = s.b where 100 * s.n >= 85 * (x.n + y.n - s.n)),
reached as (
  select doc_id as a, doc_id as b from documents union select r.a, l.b from reached r join links l on l.a = r.b)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id
from (select a as doc_id, min(b) as component_id from reached group by a) d left join sizes using (doc_id)
"""
