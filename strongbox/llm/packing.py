"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Pieces are ranked within their length by tasks. The sweep runs on the driver, over the counts of
lengths, in place of distributed sweeps. A superstep matches all pieces of one length, the
longest length first: gaps are kept sorted by what is left in them, a sweep finds the smallest gap
that holds the length, pieces and gaps that compete for each other are settled by rank, the gaps that
took pieces move to their new size, and the next length follows. What is not placed opens sequences.

Lengths are whole numbers up to the capacity, so pieces and gaps are handled as runs: a length with
an interval of ranks, a size with an interval of sequences. The runs are bounded by the capacity, not
by the data; the pieces themselves stay with the tasks, which look their place up by length and rank.
The result is that of best-fit decreasing.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strongbox.llm.tables import Rows, arrow_schema, per_worker, texts, written
from strongbox.llm.words import Known

CAPACITY, END_ID = 1024, 2
#: Pieces of one length are ranked in so many parts, as one length may hold a third of all pieces.
PARTS = 64

#: White space other than a blank; blanks only ever start a chunk.
ODD_SPACE = re.compile(r"[^\S ]")
#: A point or comma behind anything but a letter or digit belongs to what is in front of it.
JOINED_SIGNS = re.compile(r"[.,](?<=[\W_][.,])")
#: Stands for the ids of a chunk that doesn't tell how its text is cut.
ODD = b"odd"
#: A blank or none and Latin letters: byte-level tokenizers never cut there.
WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on.
PRINTED = {b for a, z in ((33, 126), (161, 172), (174, 255)) for b in range(a, z + 1)}
BYTE_CHARS = {b: b for b in PRINTED} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in PRINTED)}


class TextIds:
    """Token ids of texts, by a tokenizer whose pre-tokens never hold a blank behind another character.

    A text is cut where the tokenizer cuts as well: in front of blanks and around line ends that have
    no white space beside them, and in front of points and commas behind letters and digits. Each
    distinct chunk is encoded once and remembered, up to a number of chunks; then those that were not
    met since the last time this happened are forgotten. Other texts are encoded whole.

    New chunks that are one word go to the tokenizer's model at once, if its pre-tokenizer cuts as
    byte-level ones do; others are encoded together, with line ends between them.
    """

    def __init__(self, path: str, most: int = 300_000, longest: int = 64):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        cuts = self.tokenizer.pre_tokenizer
        self.by_model = self.tokenizer.normalizer is None and isinstance(cuts, ByteLevel) and cuts.use_regex and not cuts.add_prefix_space
        # Nothing between two cuts: white space beside white space.
        self.fixed = {"": ODD, "\n": self._encoded(["\n"])[0]}
        self.forget()
        self.most, self.longest = most, longest

    def forget(self) -> None:
        """Gives back the memory of what was remembered."""
        self.known = Known(self.fixed)
        self.odd = False

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of chunks that are one word."""
        tokenize = self.tokenizer.model.tokenize
        printed = "\n".join(words).encode().decode("latin-1").translate(BYTE_CHARS).split(chr(BYTE_CHARS[10]))
        return [array("I", [t.id for t in tokenize(chars)]).tobytes() for chars in printed] if words else []

    def _others(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks without white space behind their first character."""
        out, end = [], np.frombuffer(self.fixed["\n"], "<u4")
        for a in range(0, len(chunks), 512):
            part = chunks[a : a + 512]
            raw = self._encoded(["\n".join(part)])[0]
            ends = np.flatnonzero(np.frombuffer(raw, "<u4") == end[0]) * 4
            if len(end) == 1 and len(ends) == len(part) - 1:
                out += [raw[at:until] for at, until in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(raw)], strict=True)]
            else:  # a line end is more than one token, or a token of other chunks as well
                out += self._encoded(part)
        return out

    def _cut(self, text: str) -> list[str] | None:
        if "\0" in text or any(s in text for s in self.special):
            return None
        if not JOINED_SIGNS.search(text):
            text = text.replace(".", "\0.").replace(",", "\0,")
        chunks = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        if not chunks[0]:
            del chunks[0]
        if chunks and not chunks[-1]:
            del chunks[-1]
        return chunks

    def _learn(self, new: list[str]) -> None:
        """Encodes the chunks that are new."""
        known = self.known
        if " " in new or ODD_SPACE.search("".join(new)):
            odd = {c for c in new if c == " " or ODD_SPACE.search(c)}
            self.odd = True
            for c in odd:
                known.values[known[c]] = ODD
            new = [c for c in new if c not in odd]
        words = [c for c in new if WORD.fullmatch(c)] if self.by_model else []
        others = list(set(new).difference(words)) if len(words) < len(new) else []
        for chunks, found in ((words, self._words(words)), (others, self._others(others))):
            for chunk, ids in zip(chunks, found, strict=True):
                known.values[known[chunk]] = ids

    def of(self, many: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        known = self.known
        if len(known) > self.most:
            known.turn()
        cut = [self._cut(text) for text in many]
        places = [None if c is None else list(map(known.__getitem__, c)) for c in cut]
        new, known.new = known.new, []
        self._learn(new)
        value = known.values.__getitem__
        out = []
        for text, at in zip(many, places, strict=True):
            ids = None if at is None else list(map(value, at))
            if ids is None or (self.odd or 0 in at) and ODD in ids:
                out.extend(self._encoded([text]))
            else:
                out.append(b"".join(ids))
        for chunk in [c for c in new if len(c) > self.longest]:
            known.values[known.pop(chunk)] = None
        return out


PIECES = arrow_schema(doc_id=pa.int64(), piece=pa.int32(), start=pa.int64(), length=pa.int32(), ids_crc32=pa.int64())
PIECES_DDL = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut_pieces(size: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces. Only the first may be shorter than the capacity."""
    first = size if size <= capacity else size % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, size, capacity))]


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every document's ids with the end id, cut into pieces of at most the capacity."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = per_worker(("ids", tokenizer), lambda: TextIds(tokenizer))
        out, end = Rows(PIECES), np.array([end_id], "<u4").tobytes()
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256).to_pydict()
                    for doc_id, ids in zip(part["doc_id"], ids_of.of(part["text"]), strict=True):
                        ids += end
                        for n, (at, length) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                            out.add(doc_id, n, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]))
                    if out.full():
                        yield from out.take()
            yield from out.take()
        finally:
            ids_of.forget()  # the tokenizer stays with the worker, what it has read does not

    return texts(docs).mapInArrow(make, PIECES_DDL)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places runs of equal pieces: (length, first rank, pieces per sequence, first sequence, offset),
    each valid up to the next first rank of its length. ``counts`` are the pieces of each length."""
    gaps: dict[int, deque[tuple[int, int]]] = {}
    sizes: list[int] = []  # of gaps, sorted
    placed, opened = [], 0

    def leave(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                gaps[size] = deque()
                insort(sizes, size)
            gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):  # nothing holds it: as many new sequences as the rest of this length needs
                size, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                size = sizes[at]
                first, n = gaps[size].popleft()
                if not gaps[size]:
                    del gaps[size], sizes[at]
            each = size // length
            full = min(n, left // each)
            if full:
                placed.append((length, rank, each, first, capacity - size))
                leave(size - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            elif left:
                placed.append((length, rank, each, first, capacity - size))
                leave(size - left * length, first, 1)
                full, left = 1, 0
            leave(size, first + full, n - full)
    return placed


PACKED = PIECES.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))


def pack(pieces: DataFrame, capacity: int = CAPACITY, parts: int = PARTS) -> DataFrame:
    """Packs pieces (PIECES_DDL, length from 1 to the capacity): adds sequence_id and offset. Sequences
    are gapless from 0 and never longer than the capacity. ``pieces`` is read twice: write it down first."""
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int")
    dealt = pieces.withColumn("part", part)
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    # At most capacity * parts rows.
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = sorted(best_fit(total, capacity))
    keys = np.array([(length << 44) + rank for length, rank, *_ in placed], np.int64)
    runs = np.array(placed, np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            _, start, each, first, offset = runs[np.searchsorted(keys, (length << 44) + rank, "right") - 1].T
            own = [batch.column(batch.schema.get_field_index(c)) for c in PIECES.names]
            at = [first + (rank - start) // each, offset + (rank - start) % each * length]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, at)], schema=PACKED)

    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("row", F.row_number().over(order)).join(F.broadcast(before), ["length", "part"])
    ranked = ranked.select(*PIECES.names, (F.col("before") + F.col("row") - 1).alias("rank"))
    return ranked.mapInArrow(place, PIECES_DDL + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenizes whole texts, ends each with ``end_id``, cuts and packs them.

    Returns doc_id, piece, start, length, ids_crc32 (unsigned, of the ids as little-endian unsigned
    32-bit numbers), sequence_id and offset. Null texts are empty: the end id alone. Repeated rows are
    packed as often as they occur; rows without doc_id too. No documents give no rows. Other columns
    are left out. ``tokenizer`` is the file's path on the executors.
    """
    return pack(written(tokenized_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
