"""Ranked lexical search against SQL and brute force."""

import math
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from helpers import docs, rows, words
from strongbox.llm import lexical
from strongbox.llm.lexical import RANKED_SQL, _reaches, ranked, terms_of
from strongbox.llm.queries import QUERIES

COLUMNS = ("item_id", "rank", "doc_id", "score")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(items, given, k=10):
    """Every document scored for every item."""
    split = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in given]
    size, length = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = Counter(t for _, terms in split for t in set(terms))
    out = []
    for item, text in items:
        scored = []
        for d, terms in split:
            tf, n = Counter(terms), len(terms)
            score = sum(
                math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * (10 + 90 * n * size // length)))
                for t in set(TERM.findall((text or "").translate(LOWER))) if tf[t]
            )
            if score > 0:
                scored.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def of_items(spark, items, more=""):
    return spark.createDataFrame(items, "item_id long, text string" + more)


def test_whole_table_as_sql_says(spark, sf):
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
        expected = sorted(db.execute(f"select item_id, rank, doc_id, score from ({RANKED_SQL})").fetchall())
    assert sorted(rows(QUERIES["op12_ranked_search"](spark, sf), *COLUMNS)) == expected
    given = rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    assert plain(rows(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id", "text"), given) == expected


@pytest.mark.parametrize("k", [1, 3, 10])
def test_rounds_end_early_and_are_exact(spark, monkeypatch, k):
    draw = random.Random(k)
    vocabulary = [f"t{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    given = [(i, " ".join(draw.choices(vocabulary, weights, k=draw.randrange(1, 60)))) for i in range(400)]
    given += [(1000 + i, given[7][1]) for i in range(25)]  # ties that reach over the k-th place
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randrange(1, 12)))) for i in range(30)] + [(90, given[7][1]), (91, "nowhere"), (92, "")]
    rounds, real = [], lexical._round

    def watched(read, lists, pending, reach, k):
        rounds.append(pending.select("item_id").distinct().count())
        return real(read, lists, pending, reach, k)

    monkeypatch.setattr(lexical, "_round", watched)
    assert sorted(rows(ranked(of_items(spark, items), docs(spark, *given), k), *COLUMNS)) == plain(items, given, k)
    assert len(rounds) > 2 and rounds[-1] < rounds[0]


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 8)
    given = [(i, words(i, 12)) for i in range(40)]
    items = [(i, words(3 * i, 4)) for i in range(12)]
    assert sorted(rows(ranked(of_items(spark, items), docs(spark, *given)), *COLUMNS)) == plain(items, given)


def test_odd_rows(spark):
    given = [(4, "A-b, C_d\té"), (2, None), (3, ""), (9, "?!"), (1, "a b"), (7, "a b " + words(0, 20_000))]
    items = [(1, "A é"), (2, None), (3, "..."), (4, "b D\0b")]
    frame = docs(spark, *[(d, t, "", "", 1, "clash") for d, t in given], more=", score string")
    asked = of_items(spark, [(*i, 5) for i in items] + [(None, "a", 5)], ", rank int")
    assert sorted(rows(ranked(asked, frame), *COLUMNS)) == plain(items, given)
    assert ranked(of_items(spark, items), docs(spark)).collect() == []
    assert ranked(of_items(spark, []), docs(spark, *given)).collect() == []
    twice = ranked(of_items(spark, [(1, "a"), (1, "b")]), docs(spark, (5, "a b"), (5, "a b"), (None, "a b"), (6, "x")))
    got = sorted(rows(twice, *COLUMNS))
    assert [r[:3] for r in got] == [(1, 1, 5), (1, 2, 5), (1, 3, None)] and len({r[3] for r in got}) == 1


def test_terms_and_reaches():
    for text in ("Ab1-cé中`x{y}z~\x7f\u0080ÿ", "\x00a\x2fb:c@D[E^f", ""):
        assert [t.decode() for t in terms_of(text)] == TERM.findall(text.translate(LOWER))
    assert _reaches({}, 5) == [] and _reaches({3: 1}, 5) == [3]
    assert _reaches({9: 4, 8: 4, 7: 10, 6: 10, 2: 100, 1: 1}, 5) == [8, 6, 2, 1]
