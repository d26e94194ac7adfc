"""Quality rules: counts with fixed limits, and a logistic regression on hashed word and character
n-grams, trained on labelled rows, calibrated on others, and scored against a fixed threshold.

A text's features are the shares of its n-grams in hashed slots, so a score is a mean of weights and
needs one pass over the text. The model is fitted on a bounded sample of labelled rows: ``SAMPLE``
rows of each class to learn from, ``CALIBRATION`` of each class of the held-out fold to calibrate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strongbox.llm.tables import Rows, arrow_schema, held_out, one_text, rows_of, texts
from strongbox.llm.words import MIX, Memo, hashed, ngram_hashes, word_hashes, words_of

SAMPLE, CALIBRATION = 1000, 500
WORD_SLOTS, CHAR_SLOTS, RATES = 1 << 14, 1 << 14, 6
SLOTS = WORD_SLOTS + CHAR_SLOTS + RATES
#: Fixed limits: a text fails with fewer words, or a larger share of repeated words in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
THRESHOLD = 0.5

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that start a character.
STARTS = (np.arange(256) & 0xC0) != 0x80


@dataclass
class Counts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    def failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def repeated_words(h: np.ndarray, size: int = 3) -> int:
    """Words that lie in a window of ``size`` words which the text holds twice or more."""
    windows = ngram_hashes(h, size)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows)
    equal = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    covered = np.zeros(len(h), bool)
    for k in range(size):
        covered[k : k + len(windows)] |= twice
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.encode().split(b"\n"):
        if line.split(None, 1):
            n += line in seen
            seen.add(line)
    return n


def read_text(text: str, memo: Memo) -> tuple[Counts, np.ndarray, np.ndarray]:
    """A text's counts, its word hashes and its bytes."""
    h = hashed(words_of(text), memo)
    raw = np.frombuffer(text.encode(), np.uint8)
    of = np.bincount(raw, minlength=256)
    counts = Counts(len(h), int(of[STARTS].sum() - of[SPACES].sum()), int(of[SYMBOLS].sum()), repeated_lines(text), repeated_words(h))
    return counts, h, raw


def slots_of(h: np.ndarray, raw: np.ndarray) -> list[np.ndarray]:
    """The slots of a text's words and word pairs, and of its runs of three and four bytes."""
    words = np.concatenate([h, ngram_hashes(h, 2)])
    out = [(words >> np.uint64(64 - 14)).astype(np.int64)]
    wide = raw.astype(np.uint32)
    three = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16) if len(raw) > 2 else wide[:0]
    four = three[:-1] | wide[3:] << np.uint32(24) if len(raw) > 3 else wide[:0]
    for n, runs in ((3, three), (4, four)):
        key = (runs + np.uint32(n)) * np.uint32(MIX & np.uint64(0xFFFFFFFF))
        out.append((key >> np.uint32(32 - 14)).astype(np.int64) + WORD_SLOTS)
    return out


def rates_of(c: Counts, h: np.ndarray, raw: np.ndarray) -> np.ndarray:
    words, chars = max(c.n_words, 1), max(c.word_chars, 1)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    different = len(np.unique(h)) if len(h) else 0
    return np.array([
        c.n_symbols / chars, c.n_repeat_words / words, c.n_dup_lines / words, upper / chars, different / words, min(chars / words, 50) / 50
    ])


#: How much the shares of n-grams and the rates weigh beside each other.
SCALE, RATE_SCALE = 30.0, 2.0


def features(c: Counts, h: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values, for learning."""
    x = np.zeros(SLOTS, np.float64)
    for slots in slots_of(h, raw):
        if len(slots):
            x += np.bincount(slots, minlength=SLOTS) * (SCALE / len(slots))
    x[-RATES:] = rates_of(c, h, raw) * RATE_SCALE
    used = np.flatnonzero(x)
    return used, x[used]


@dataclass
class Model:
    """Weights, and the line that turns a score into a calibrated log-odds."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, c: Counts, h: np.ndarray, raw: np.ndarray) -> float:
        score = self.bias + float(rates_of(c, h, raw) @ self.weights[-RATES:]) * RATE_SCALE
        for slots in slots_of(h, raw):
            if len(slots):
                score += float(self.weights[slots].mean()) * SCALE
        return float(1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -30, 30))))


#: Entries of the matrix that the driver takes at once.
AT_ONCE = 1 << 18


def logistic(rows: np.ndarray, slots: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, l2: float = 1e-3, steps: int = 150):
    """Weights and bias by accelerated gradient descent; rows, slots, values are a sparse matrix."""
    n, w, b = len(y), np.zeros(width), 0.0
    ahead_w, ahead_b, t = w, b, 1.0
    norm = np.bincount(rows, np.square(values), n).max() if n else 1.0
    rate = 1.0 / (0.25 * (norm + 1) + l2)
    weigh = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    rate = min(rate * 4, 1 / (0.25 * norm * 0.25 + l2))
    parts = [slice(at, at + AT_ONCE) for at in range(0, len(slots), AT_ONCE)]
    for _ in range(steps):
        score, slope = np.zeros(n), np.zeros(width)
        for part in parts:
            score += np.bincount(rows[part], values[part] * ahead_w[slots[part]], n)
        p = 1 / (1 + np.exp(-np.clip(score + ahead_b, -30, 30)))
        g = (p - y) * weigh
        for part in parts:
            slope += np.bincount(slots[part], values[part] * g[rows[part]], width)
        new_w = ahead_w - rate * (slope + l2 * ahead_w)
        new_b = ahead_b - rate * g.sum()
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead_w, ahead_b = new_w + (before - 1) / t * (new_w - w), new_b + (before - 1) / t * (new_b - b)
        w, b = new_w, new_b
    return w, float(b)


def platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log-odds, with the usual smoothed targets, by Newton steps."""
    good, bad = y.sum(), len(y) - y.sum()
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x, beta = np.stack([scores, np.ones(len(scores))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        beta -= np.linalg.solve(hess, x.T @ (p - target) + 1e-4 * beta)
    return float(beta[0]), float(beta[1])


EXAMPLES = arrow_schema(slots=pa.binary(), parts=pa.binary(), label=pa.int32(), learn=pa.bool_())


def sampled(docs: DataFrame, labels: DataFrame, label: str, learn: int, check: int) -> DataFrame:
    """A bounded sample of labelled documents (text, label, learn): at most ``learn`` of each class
    outside the held-out fold and ``check`` of each class inside it, by the hash of their ids."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where("doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.withColumns({"learn": ~held_out(F.col("doc_id")), "at": F.xxhash64("doc_id")})
    parts = [
        known.where((F.col("label") == y) & (F.col("learn") == F.lit(fold))).orderBy("at", "doc_id").limit(n)
        for y in (0, 1) for fold, n in ((True, learn), (False, check))
    ]
    chosen = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    # At most 2 * (learn + check) rows of a few bytes.
    return one_text(docs, chosen).select("text", "label", "learn", "at")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, calibration: int = CALIBRATION) -> Model | None:
    """Fits the model; none without examples of both classes."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, out = word_hashes(), Rows(EXAMPLES, most=256)
        for text, label, learn in rows_of(batches, "text", "label", "learn"):
            slots, values = features(*read_text(text, memo))
            out.add(slots.astype("<u2").tobytes(), values.astype("<f4").tobytes(), label, learn, size=6 * len(slots))
            if out.full():
                yield from out.take()
        yield from out.take()

    got = sampled(docs, labels, "quality", sample, calibration).mapInArrow(extract, "slots binary, parts binary, label int, learn boolean").collect()
    got.sort(key=lambda r: (r["learn"], r["label"], bytes(r["slots"])))
    y, learn = np.array([r["label"] for r in got], float), np.array([r["learn"] for r in got], bool)
    if not 0 < y[learn].sum() < learn.sum():
        return None
    # One array each, as narrow as they come: this is the driver. Rows to learn from come last.
    sizes = np.array([len(r["slots"]) // 2 for r in got])
    slots = np.concatenate([np.frombuffer(r["slots"], "<u2") for r in got]).astype(np.int32)
    values = np.concatenate([np.frombuffer(r["parts"], "<f4") for r in got])
    del got
    rows, held = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), int((~learn).sum())
    first = int(sizes[:held].sum())
    weights, bias = logistic(rows[first:] - np.int32(held), slots[first:], values[first:], y[learn], SLOTS)
    ends = np.cumsum(sizes)
    scores = np.array([values[e - n : e] @ weights[slots[e - n : e]] for e, n in zip(ends, sizes, strict=True)]) + bias
    check = ~learn if 0 < y[~learn].sum() < (~learn).sum() else learn
    return Model(weights, bias, *platt(scores[check], y[check]))


SCORED = arrow_schema(
    doc_id=pa.int64(), n_words=pa.int64(), word_chars=pa.int64(), n_symbols=pa.int64(), n_dup_lines=pa.int64(),
    n_repeat_words=pa.int64(), base_failed=pa.bool_(), kept=pa.bool_(), probability=pa.float64(),
)
SCORED_DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, probability double"
)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, calibration: int = CALIBRATION) -> DataFrame:
    """Counts and verdict for the whole text of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    probability (of good quality). ``kept`` is false if the counts fail, else whether the probability
    reaches the threshold. Null texts are empty and fail. Without labels of both classes the counts
    alone decide, and probability is null. A row in is a row out; other columns are left out.
    """
    model = train(docs, labels, sample, calibration)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, out = word_hashes(), Rows(SCORED)
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            counts, h, raw = read_text(text, memo)
            p = model.probability(counts, h, raw) if model else None
            failed = counts.failed()
            out.add(doc_id, *vars(counts).values(), failed, not failed and (p is None or p >= threshold), p)
            if out.full():
                yield from out.take()
        yield from out.take()

    return texts(docs).mapInArrow(score, SCORED_DDL)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the quality rules keep, with all their columns."""
    model = train(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        for batch in batches:
            kept = []
            for (text,) in rows_of(iter([batch]), "text"):
                counts, h, raw = read_text(text or "", memo)
                kept.append(not counts.failed() and (model is None or model.probability(counts, h, raw) >= threshold))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
