"""SimHash near-dedup against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from helpers import docs, rows, words
from strongbox.llm.components import components
from strongbox.llm.queries import QUERIES
from strongbox.llm.simhash import FIRST, SECOND, among, by_flips, linked, simhash_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, size=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))] if found else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fingers, bits=3):
    """The smallest position that each one reaches, all compared with all."""
    f, root = np.array(fingers, np.uint64), list(range(len(fingers)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= bits) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(f))]


def test_whole_table(spark, sf):
    given = sorted(rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text"))
    fingers = [plain_fingerprint(t) for _, t in given]
    expected = [(d, f"{f:016x}", given[g][0]) for (d, _), f, g in zip(given, fingers, groups(fingers), strict=True)]
    assert sorted(rows(QUERIES["op11_simhash"](spark, sf), "doc_id", "fingerprint", "component_id")) == expected
    assert len({e[2] for e in expected}) < len(expected)


def near(draw, centre, bits):
    return centre ^ sum(1 << b for b in draw.sample(range(64), bits))


@pytest.mark.parametrize("longest", [4096, 40, 3])
@pytest.mark.parametrize("bits", [3, 1])
def test_links_of_dense_groups(spark, longest, bits):
    draw = random.Random(longest)
    centres = [draw.getrandbits(64) for _ in range(6)]
    fingers = {near(draw, c, draw.randrange(0, 7)) for c in centres for _ in range(150)} | {draw.getrandbits(64) for _ in range(300)}
    fingers |= {0, 1, 7, 15, (1 << 64) - 1}
    fingers = sorted(fingers, key=lambda f: draw.random())
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fingers)], "f long, node long")
    found = dict(rows(components(linked(frame, bits, longest)), "node", "component"))
    assert [found.get(i, i) for i in range(len(fingers))] == groups(fingers, bits)


def test_positions_cover_every_link():
    """Whatever three bytes differ, some list of either index holds both fingerprints."""
    for lists in (FIRST, SECOND):
        for a in range(8):
            for b in range(8):
                for c in range(8):
                    assert any(not {a, b, c} & set(p) for p in lists)


def test_flipping_is_comparing():
    draw = np.random.default_rng(3)
    f = np.unique(draw.integers(0, 1 << 13, 700, np.uint64) << np.uint64(14) | np.uint64(0xAB << 56))
    for bits in (1, 2, 3):
        assert np.array_equal(by_flips(f, (0, 4, 5, 6, 7), bits), among(f, bits))


def test_odd_rows(spark):
    text = words(0, 30)
    frame = docs(
        spark, (5, text, "", "", 1, "clash"), (5, text, "", "", 1, "c"), (3, text.upper(), "", "", 1, "c"), (None, text, "", "", 1, "c"),
        (9, None, None, None, None, None), (8, " \n", "", "", 0, ""), (7, "", "", "", 0, ""), (6, words(50, 40), "", "", 0, ""), (2, "One two", "", "", 0, ""),
        more=", component_id string",
    )
    got = sorted(rows(simhash_join(frame), "doc_id", "fingerprint", "component_id"), key=str)
    own, zero = f"{plain_fingerprint(text):016x}", "0" * 16
    expected = [(5, own, 3), (5, own, 3), (3, own, 3), (None, own, None), (9, zero, 7), (8, zero, 7), (7, zero, 7)]
    expected += [(6, f"{plain_fingerprint(words(50, 40)):016x}", 6), (2, f"{xxhash.xxh64_intdigest(b'one two', 42):016x}", 2)]
    assert got == sorted(expected, key=str)
    assert simhash_join(docs(spark)).collect() == []


def test_an_id_with_two_texts_links_both(spark):
    frame = docs(spark, (4, words(0, 30)), (4, words(100, 30)), (2, words(100, 30)), (3, words(0, 30)))
    assert sorted(rows(simhash_join(frame), "doc_id", "component_id")) == [(2, 2), (3, 2), (4, 2), (4, 2)]


def test_a_very_long_text(spark):
    text = " ".join(f"v{i % 999}" for i in range(150_000))
    assert rows(simhash_join(docs(spark, (1, text))), "fingerprint") == [(f"{plain_fingerprint(text):016x}",)]
