"""Line dedup against SQL, the Jaccard join against brute force."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import docs, rows, words
from strongbox.llm.components import components
from strongbox.llm import jaccard
from strongbox.llm.jaccard import Bands, bitmap, compared, jaccard_join, one_of_each, signatures
from strongbox.llm.line_dedup import LINE_DEDUP_SQL, line_dedup, repeated_runs
from strongbox.llm.queries import QUERIES
from strongbox.llm.words import shingles, word_hashes, words_of

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def by_sql(pairs):
    with duckdb.connect() as db:
        documents = pa.table({"doc_id": pa.array([p[0] for p in pairs], pa.int64()), "text": pa.array([p[1] for p in pairs], pa.string())})
        db.register("documents", documents)
        return sorted(db.execute(LINE_DEDUP_SQL).fetchall())


def test_lines_as_sql_says(spark, sf):
    given = rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    got = sorted(rows(QUERIES["op2_line_dedup"](spark, sf), "doc_id", "text", "n_lines", "n_deleted"))
    assert got == by_sql(given)


def test_runs_extend_both_ways_and_short_ones_stay(spark):
    run = [words(0, 20), words(100, 20), words(200, 20), words(300, 20)]
    given = [
        (1, "\n".join(["own one", *run, "own two"])), (2, "\n".join(["other", *run[:3], "", "end"])),
        (3, "\n".join(["x", *run[1:], "y"])), (4, "\n".join(run[:2])), (5, ""), (6, "\n".join([words(0, 60)] * 3)),
        (7, "\n".join([words(500, 20)] * 9)), (8, "\n\n" + words(0, 60) + "\n\nz"),
    ]
    got = sorted(rows(line_dedup(docs(spark, *given)), "doc_id", "text", "n_lines", "n_deleted"))
    assert got == by_sql(given)
    of = {r[0]: r[1] for r in got}
    assert of[2] == "other\n\nend" and of[3] == "x\ny" and of[4] == given[3][1] and of[6] == words(0, 60) and of[8] == "\n\n\nz"
    assert sorted(rows(repeated_runs(docs(spark, *given)).where("doc_id < 4"), "doc_id", "first", "last")) == [(2, 1, 3), (3, 1, 3)]


def test_lines_of_odd_rows(spark):
    text = words(0, 60) + "\nown"
    frame = docs(spark, (None, text, "a", "b", 1, "clash"), (2, text, "a", "b", 1, "c"), (2, text, "a", "b", 1, "c"), (3, None, None, None, None, None), more=", n_lines string")
    got = sorted(rows(line_dedup(frame), "doc_id", "text", "n_lines", "n_deleted"), key=str)
    assert got == sorted([(None, text, 2, 0), (2, "own", 2, 1), (2, "own", 2, 1), (3, None, 1, 0)], key=str)
    assert line_dedup(docs(spark)).collect() == []


def whole_matches(given, least=50):
    """What is left of texts without blank lines when every line of a repeated run of lines goes, by brute force."""
    texts = sorted((d, t.split("\n")) for d, t in given)
    places = [(d, i) for d, lines in texts for i in range(len(lines))]
    of, out = dict(texts), []
    for d, lines in texts:
        gone = set()
        for i in range(len(lines)):
            for e, a in places:
                if (e, a) >= (d, i):
                    break
                n = 0
                while i + n < len(lines) and a + n < (len(of[e]) if e != d else i) and lines[i + n] == of[e][a + n]:
                    n += 1
                if sum(len(x.split()) for x in lines[i : i + n]) >= least:
                    gone.update(range(i, i + n))
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return out


def test_matches_go_to_their_end(spark):
    passage = words(0, 60) + "\n" + words(100, 8)
    given = [(1, passage + "\nown one"), (2, "x\n" + passage + "\ny"), (3, passage + "\nown one"), (4, words(100, 8) + "\n" + words(0, 60))]
    got = dict(rows(line_dedup(docs(spark, *given), to_end=True), "doc_id", "text"))
    assert got == {1: given[0][1], 2: "x\ny", 3: "", 4: words(100, 8)}
    assert dict(rows(corpus_pipeline.lines(spark, docs(spark, *given), ""), "doc_id", "text")) == got
    draw = random.Random(5)
    lines = [words(1000 * i, draw.choice([1, 3, 8, 20, 49, 50, 70])) for i in range(9)]
    given = [(i, "\n".join(lines[(a + k) % 9] if draw.random() < 0.9 else f"own{i}" for k in range(draw.randrange(1, 14)))) for i in range(40) for a in [draw.randrange(9)]]
    got = sorted(rows(line_dedup(docs(spark, *given), to_end=True), "doc_id", "text", "n_lines", "n_deleted"))
    assert got == whole_matches(given)


def sets_of(given, size):
    out = {}
    for doc_id, text in given:
        w = (text or "").encode().translate(LOWER).split()
        out[doc_id] = frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()
    return out


def groups(given, size, percent):
    sets, holders = sets_of(given, size), defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        for e, both in Counter(e for x in s for e in holders[x] if e > d).items():
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return sorted((d, len(s), find(d)) for d, s in sets.items())


def test_groups_of_whole_table(spark, sf):
    given = rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    assert sorted(rows(QUERIES["op4_ngram_jaccard"](spark, sf), "doc_id", "n_shingles", "component_id")) == groups(given, 4, 85)


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_similar_sets_share_a_tile(percent):
    bands, memo = Bands(percent), word_hashes()
    for n in (1, 3, 6, 7, 9, 13, 20, 27, 50, 111, 300, 700):
        text = words_of(words(n * 1000, n))
        for cut in range(0, n // 4 + 1):
            for other in (text[cut:], text[: n - cut // 2] + words_of(words(9 * 10**6, cut // 2))):
                a, b = (shingles(t, 1, memo) for t in (text, other))
                both = len(set(a.tolist()) & set(b.tolist()))
                if both and 100 * both >= percent * (len(a) + len(b) - both):
                    assert set(signatures(a, bands).tolist()) & set(signatures(b, bands).tolist())


def test_chains_near_copies_and_thresholds(spark):
    base = words(0, 200).split()
    given = [(1000 + i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(0, 200, 5)]  # near copies of each other
    given += [(10 + i, words(5000 + 12 * i, 200)) for i in range(12)]  # each similar to the next only
    given += [(1, words(0, 3)), (2, "W0 w1\tw2"), (3, "w0 w1"), (4, ""), (5, None), (6, "w2 w1 w0")]
    given += [(7, words(9000, 104)), (8, words(9000, 88) + " " + words(9900, 0)), (9, words(9000, 89))]
    got = sorted(rows(jaccard_join(docs(spark, *given), 4, 85), "doc_id", "n_shingles", "component_id"))
    assert got == groups(given, 4, 85)
    assert len({c for d, _, c in got if 10 <= d < 22}) == 1 and len({c for d, _, c in got if d >= 1000}) == 1


def test_join_of_odd_rows(spark):
    text = words(0, 30)
    frame = docs(spark, (5, text, "", "", 1, "clash"), (5, text, "", "", 1, "c"), (3, text, "", "", 1, "c"), (None, text, "", "", 1, "c"), (9, None, None, None, None, None), more=", component_id string")
    got = sorted(rows(jaccard_join(frame), "doc_id", "n_shingles", "component_id"), key=str)
    assert got == sorted([(5, 26, 3), (5, 26, 3), (3, 26, 3), (None, 26, None), (9, 0, 9)], key=str)
    assert sorted(rows(one_of_each(frame), "doc_id", "component_id"), key=str) == sorted([(3, "c"), (None, "c"), (9, None)], key=str)
    assert jaccard_join(docs(spark)).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.range(300).selectExpr("(id * 7919) % 301 as a", "((id + 1) * 7919) % 301 as b")
    assert {r["component"] for r in components(links).collect()} == {0} and components(links).count() == 300


def test_a_tile_is_compared_in_strips(monkeypatch):
    draw, base = np.random.default_rng(7), np.arange(1, 121, dtype=np.uint64) << np.uint64(40)
    sets = [np.unique(np.append(draw.permutation(base)[: 120 - i % 30], draw.integers(1, 1 << 60, i % 13).astype(np.uint64))) for i in range(90)]
    rows = [(i % 2, 1000 - i, i % 40, len(h), bitmap(h).tobytes(), sorted({3, 4 + i % 5, 9})) for i, h in enumerate(sets)]
    counted, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: counted.append(len(x)) or count(x))

    def plain(key):
        for i, (own, a, of_a, n, _, least) in enumerate(rows):
            for j, (other, b, of_b, m, _, more) in enumerate(rows[:i]):
                apart = (int.from_bytes(rows[i][4], "little") ^ int.from_bytes(rows[j][4], "little")).bit_count()
                if of_a != of_b and (key[1] == key[2] or own != other) and 100 * min(n, m) >= 85 * max(n, m) and 100 * ((n + m - apart) // 2) >= 85 * (n + m - (n + m - apart) // 2):
                    if not {t for t in least if t < key[0]} & set(more):
                        yield min(a, b), max(a, b)

    for key in ((3, 0, 0), (3, 0, 1), (9, 0, 0), (2, 0, 0)):
        want = sorted(plain(key))
        for pairs in (1 << 15, 500):
            monkeypatch.setattr(jaccard, "PAIRS", pairs)
            counted.clear()
            assert sorted(compared(key, rows, 85)) == want
            assert max(counted) <= max(pairs, 90)
            assert pairs == 500 or len(counted) <= 4
        assert want or key[0] == 9
