"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is a row of symbols, one for each character. An agenda holds the neighbouring pairs that are a
piece of the vocabulary, best score first, leftmost among equals; the best is merged and its new
neighbours join the agenda, until it is empty. Symbols that are no piece become byte pieces.

No piece has a blank behind another character, so no merge crosses from a word into the blank before
the next one, nor into a line end or from a letter into a point or comma. A text is cut there, and
each distinct chunk goes through the agenda when it is new to a task. The agendas of many chunks are
worked off together: chunks of one length are the rows of a matrix of symbols, beside one of their pairs;
in each round every row merges the best of its pairs, and rows without any are done. Long chunks, and
those with characters that are no piece, have an agenda of their own. New chunks are compared with the
sentencepiece library, a batch at a time; a difference is an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strongbox.llm.tables import Rows, arrow_schema, per_worker, texts
from strongbox.llm.words import Known

BLANK, CUT = "▁", "\0"
#: Longer chunks have an agenda of their own.
LONGEST = 32
RUNS = re.compile(BLANK + "+")


class Pieces:
    """The vocabulary of a model file, and its encoder."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        every = [self.library.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i)}
        of_byte = {i for i in range(n) if self.library.is_byte(i)}
        self.bytes = {int(every[i][3:-1], 16): i for i in of_byte}
        self.ids = {p: i for i, p in enumerate(every) if i not in special | of_byte}
        self.scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        if len(self.bytes) != 256 or any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.ids):
            raise ValueError("only vocabularies with byte pieces and without blanks or line ends inside pieces are handled")
        after = {p[i - 1 : i + 1] for p in self.ids for i in range(1, len(p)) if p[i] in ".," and p[i - 1].isalnum()}
        self.joined = re.compile("[.,](?<=" + "|".join([r"[^\w][.,]", r"_[.,]", *map(re.escape, sorted(after))]) + ")")
        # Symbols are numbered; a pair is known by the numbers of its two.
        pieces = sorted(self.ids, key=lambda p: -self.scores[p])
        number = {p: i for i, p in enumerate(pieces)}
        chars = {c for p in pieces for c in p}.difference(number)
        number |= {c: len(pieces) + i for i, c in enumerate(sorted(chars))}
        self.count = len(number)
        pairs = {number[a] * self.count + number[b]: number[p] for p in pieces for i in range(1, len(p)) if (a := p[:i]) in number and (b := p[i:]) in number}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_merged = np.array([pairs[k] for k in self.pairs.tolist()], np.int32)
        self.of_char = np.full(0x110000, -1, np.int32)
        for c in {c for p in pieces for c in p if c in self.ids}:
            self.of_char[ord(c)] = number[c]
        self.id_of = np.array([self.ids[p] for p in pieces], "<u4")
        # Equal scores have equal ranks: the leftmost pair goes first. No pair: the last.
        self.rank = np.append(np.unique([-self.scores[p] for p in pieces], return_inverse=True)[1], self.count).astype(np.int32)
        if self.library.normalize("a  b") != f"{BLANK}a{BLANK}{BLANK}b":
            raise ValueError("only models that keep white space and add one blank in front are handled")

    def merged(self, chunk: str) -> list[str]:
        """The pieces of a chunk, by the agenda."""
        symbols: list[str | None] = list(chunk)
        size = len(symbols)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        agenda: list[tuple[float, int, str]] = []
        scores = self.scores

        def consider(left: int) -> None:
            pair = symbols[left] + symbols[after[left]]
            if (score := scores.get(pair)) is not None:
                heapq.heappush(agenda, (-score, left, pair))

        for i in range(size - 1):
            consider(i)
        while agenda:
            _, left, pair = heapq.heappop(agenda)
            if symbols[left] is None or (right := after[left]) >= size or symbols[left] + symbols[right] != pair:
                continue  # one of the two has been merged otherwise
            symbols[left], symbols[right] = pair, None
            after[left] = after[right]
            if after[right] < size:
                before[after[right]] = left
                consider(left)
            if before[left] >= 0:
                consider(before[left])
        return [s for s in symbols if s is not None]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What neighbouring symbols merge into; the number of pieces if into none."""
        key = left.astype(np.int64) * self.count + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_merged[at], np.int32(len(self.id_of)))

    def many_ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of every chunk as little-endian unsigned 32-bit numbers, all agendas together."""
        out: list[bytes] = [b""] * len(chunks)
        length = np.array([len(c) for c in chunks], np.int64)
        symbols = self.of_char[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")]
        start = np.cumsum(length) - length
        strange = np.concatenate([[0], np.cumsum(symbols < 0)])
        alone = (length > LONGEST) | (strange[start + length] > strange[start])
        for at in np.flatnonzero(alone | (length == 0)).tolist():
            out[at] = array("I", self.chunk_ids(chunks[at])).tobytes()
        none = len(self.id_of)
        rows, held, pairs = np.empty(0, np.int64), np.empty((0, LONGEST), np.int32), np.empty((0, LONGEST - 1), np.int32)
        for width in range(LONGEST, 0, -1):
            new = np.flatnonzero((length == width) & ~alone)
            more = symbols[start[new][:, None] + np.arange(width)]
            rows, held = np.concatenate([rows, new]), np.concatenate([held, more])
            pairs = np.concatenate([pairs, self._pairs(more[:, :-1], more[:, 1:])])
            if width > 1 and len(rows):
                at = self.rank[pairs].argmin(1)
                best = pairs[np.arange(len(rows)), at]
                done = best == none
            else:
                done = np.ones(len(rows), bool)
            raw, size = self.id_of[held[done]].tobytes(), 4 * width
            for i, row in enumerate(rows[done].tolist()):
                out[row] = raw[i * size : (i + 1) * size]
            if width == 1:
                break
            if not len(rows) or done.all():
                rows, held, pairs = rows[:0], np.empty((0, width - 1), np.int32), np.empty((0, width - 2), np.int32)
                continue
            going = ~done
            rows, held, pairs, at, best = rows[going], held[going], pairs[going], at[going], best[going]
            row = np.arange(len(rows))
            held[row, at] = best
            stays = np.ones(held.shape, bool)
            stays[row, at + 1] = False
            held = held[stays].reshape(len(rows), width - 1)
            stays = np.ones(pairs.shape, bool)
            stays[row, at] = False
            pairs = pairs[stays].reshape(len(rows), width - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            pairs[before, at[before] - 1] = self._pairs(held[before, at[before] - 1], best[before])
            pairs[after, at[after]] = self._pairs(best[after], held[after, at[after] + 1])
        return out

    def chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for piece in self.merged(chunk):
            known = self.ids.get(piece)
            out.extend([known] if known is not None else [self.bytes[b] for b in piece.encode("utf-8")])
        return out


def chunks_of(text: str, joined: re.Pattern) -> list[str]:
    """A text with its blank in front, cut where no piece reaches across: in front of blanks that follow
    another character, around line ends, and in front of points and commas unless ``joined`` finds
    one that may belong to what is in front of it."""
    if not text:
        return []
    text = BLANK + text.replace(" ", BLANK)
    if CUT in text:
        return [text]
    if not joined.search(text):
        text = text.replace(".", CUT + ".").replace(",", CUT + ",")
    text = RUNS.sub(CUT + r"\g<0>", text) if BLANK * 2 in text else text.replace(BLANK, CUT + BLANK)
    return text.replace("\n", CUT + "\n" + CUT).split(CUT)


class Encoder:
    """Encodes texts, remembering chunks and comparing new ones with the library. Of more chunks than
    ``most`` those are forgotten that were not met since the last time this happened."""

    def __init__(self, path: str, most: int = 300_000, longest: int = 64):
        self.pieces = per_worker(("pieces", path), lambda: Pieces(path))
        self.known, self.most, self.longest = Known({"": b""}), most, longest
        self.new: tuple[list[str], list[bytes]] = [], []

    def check(self) -> None:
        """Compares the ids of the chunks that are new since the last check with the library's, many
        chunks in one text."""
        (chunks, ours), self.new = self.new, ([], [])
        # The library puts a blank in front of each text; behind a line end it stands alone. Blanks at
        # the end of a chunk would run into those of the next one.
        line_end = array("I", [self.pieces.bytes[10]]).tobytes()
        front = array("I", [self.pieces.ids[BLANK]]).tobytes()
        led = [i for i, c in enumerate(chunks) if c[0] == BLANK and c[-1] != BLANK]
        ending = [i for i, c in enumerate(chunks) if c[0] == BLANK and c[-1] == BLANK and c != BLANK]
        others = [i for i, c in enumerate(chunks) if c[0] != BLANK]
        parts = [(led[a : a + 64], "", b"", b"") for a in range(0, len(led), 64)]
        parts += [(others[a : a + 64], "\n", front, line_end) for a in range(0, len(others), 64)]
        parts += [([i], "", b"", b"") for i in ending]
        given = ["".join(sep + chunks[i] for i in part)[0 if sep else 1 :] for part, sep, _, _ in parts]
        for (part, _, first, each), theirs in zip(parts, self.pieces.library.encode(given, num_threads=1) if given else [], strict=True):
            if first + b"".join(each + ours[i] for i in part) != array("I", theirs).tobytes():
                raise ValueError(f"the agenda and the sentencepiece library differ on one of {[chunks[i][:80] for i in part]!r}")

    def of(self, many: list[str]) -> list[np.ndarray]:
        """All ids of each text, without begin and end, as little-endian unsigned 32-bit numbers."""
        known = self.known
        if len(known) > self.most:
            known.turn()
        places = [list(map(known.__getitem__, chunks_of(text, self.pieces.joined))) for text in many]
        new, known.new = known.new, []
        found = self.pieces.many_ids(new)
        self.new = new, found
        self.check()
        for chunk, ids in zip(new, found, strict=True):
            known.values[known[chunk]] = ids
        out = [np.frombuffer(b"".join(map(known.values.__getitem__, at)), "<u4") for at in places]
        for chunk in [c for c in new if len(c) > self.longest]:
            known.values[known.pop(chunk)] = None
        return out

    def ids(self, text: str) -> np.ndarray:
        return self.of([text])[0]


ENCODED = arrow_schema(doc_id=pa.int64(), n_tokens=pa.int64(), ids=pa.list_(pa.int32()), decoded=pa.string())
DIGESTS = arrow_schema(doc_id=pa.int64(), n_tokens=pa.int64(), ids_sha256=pa.string(), decoded_sha256=pa.string())


def encode_pieces(docs: DataFrame, model: str, digests: bool = False) -> DataFrame:
    """Encodes the whole text of every document, begin and end ids around it, and decodes it again.

    Returns doc_id, n_tokens (all ids) and either ids and decoded, or with ``digests`` their SHA-256 as
    ids_sha256 (ids as little-endian unsigned 32-bit numbers) and decoded_sha256 (UTF-8). Null texts
    are empty: begin and end only. A row in is a row out, whatever its id; other columns are left out.
    ``model`` is the vocabulary file's path on the executors.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        library = encoder.pieces.library
        ends = [np.array([i], "<u4") for i in (library.bos_id(), library.eos_id())]
        out = Rows(DIGESTS if digests else ENCODED)
        slices = (batch.slice(a, 256).to_pydict() for batch in batches for a in range(0, batch.num_rows, 256))
        for part in slices:
            for doc_id, text, own in zip(part["doc_id"], part["text"], encoder.of(part["text"]), strict=True):
                ids = np.concatenate([ends[0], own, ends[1]])
                decoded = library.decode(ids.tolist())
                if digests:
                    out.add(doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    out.add(doc_id, len(ids), ids.astype(np.int32), decoded, size=len(text) * 6)
                if out.full():
                    yield from out.take()
        yield from out.take()

    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return texts(docs).mapInArrow(encode, f"doc_id long, n_tokens long, {rest}")
