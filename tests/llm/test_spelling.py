"""Spelling variants against SQL and brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from helpers import docs, rows
from strongbox.llm import spelling
from strongbox.llm.queries import QUERIES
from strongbox.llm.spelling import SPELLING_SQL, near_words, spelling_variants

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(given):
    words = Counter()
    for doc_id, text in given:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                words[run] += 1
    return {w: n for w, n in words.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, times=10):
    """All words compared with all."""
    near, out = defaultdict(list), []
    for a in words:
        for b in words:
            if a < b and abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: b for w, b in best.items() if words[b] >= times * words[w]}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=str)


def by_sql(given):
    with duckdb.connect() as db:
        db.register("documents", pa.table({"doc_id": pa.array([g[0] for g in given], pa.int64()), "text": pa.array([g[1] for g in given], pa.string())}))
        return sorted(db.execute(f"select {', '.join(COLUMNS)} from ({SPELLING_SQL})").fetchall(), key=str)


def test_whole_table(spark, sf):
    given = rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    got = sorted(rows(QUERIES["op13_spelling_variants"](spark, sf), *COLUMNS), key=str)
    assert got == by_sql(given) and len(got) > 100
    assert got == plain(counted(given))


def misspelt(draw, word):
    letters = "abcdefghijklmnopqrstuvwxyzéñÿ"
    at = draw.randrange(len(word))
    return draw.choice([word[:at] + word[at + 1 :], word[:at] + draw.choice(letters) + word[at:], word[:at] + draw.choice(letters) + word[at + 1 :]])


@pytest.mark.parametrize("branch, leaves, sought, few", [(20_000, 20_000, 20_000, 4096), (1, 3, 7, 1), (7, 5, 20_000, 64), (100, 20_000, 4, 64)])
def test_branches_of_any_size(spark, monkeypatch, branch, leaves, sought, few):
    for name, value in {"BRANCH": branch, "LEAVES": leaves, "SOUGHT": sought, "FEW": few}.items():
        monkeypatch.setattr(spelling, name, value)
    draw = random.Random(branch)
    words = {"".join(draw.choices("abcdefé", k=draw.randrange(7, 11))) for _ in range(300)}
    words |= {misspelt(draw, w) for w in draw.choices(sorted(words), k=300)} | {misspelt(draw, "consonant") for _ in range(200)}
    words = {w: draw.randrange(1, 500) for w in sorted(words)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted(rows(near_words(frame), "word", "near", "n"))
    assert got == sorted((a, b, words[b]) for a in words for b in words if a != b and one_edit(a, b))


def test_chains_and_ties(spark):
    counts = {"colours": 2, "colouur": 2, "colourx": 30, "colourxx": 400, "bathing": 2, "cathing": 20, "dathing": 20, "fathing": 19, "evening": 3, "evenings": 29}
    counts |= {"étoiles": 2, "ètoiles": 40, "a" * 3000: 2, "a" * 2999: 20}
    given = [(d, " ".join([w] * n)) for d, (w, n) in enumerate(counts.items())]
    given = [(next(i for i in range(d, 10**6, 100) if zlib.crc32(f"{i}:{t.split()[0]}".encode()) % 31), t) for d, t in given]
    got = sorted(rows(spelling_variants(docs(spark, *given)), *COLUMNS), key=str)
    assert got == plain(counts) == by_sql(given)
    of = {r[0]: r for r in got}
    assert of["bathing"][1] == "cathing" and of["colours"][1:3] == ("colourx", "colourxx") and of["evening"][1] is None


def test_odd_rows(spark):
    text = "Letters LETTERS, lettersx7lettersy Étoiles étoiles short"
    given = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "×÷" * 4), (4, "×÷" * 4), (5, "words " * 50_000 + "farther further further")]
    frame = docs(spark, *[(d, t, "", "", 1, 3) for d, t in given], more=", n long")
    assert sorted(rows(spelling_variants(frame), *COLUMNS), key=str) == plain(counted(given))
    assert spelling_variants(docs(spark)).collect() == [] and spelling_variants(docs(spark, (1, "no"))).collect() == []
