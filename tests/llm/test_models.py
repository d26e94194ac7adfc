"""Quality rules, toxicity and site quality: counts by brute force, models on held-out rows."""

import random
import zlib

import numpy as np
from helpers import docs, rows, words
from pyspark.sql import functions as F
from strongbox.llm.quality_rules import keep_good, quality_rules, sampled
from strongbox.llm.queries import QUERIES
from strongbox.llm.site_quality import site_quality
from strongbox.llm.toxicity import Index, examples_of, keep_clean, toxicity

LABELS = "doc_id long, quality int, toxic int"


def counts(text):
    w = [x for x in (text or "").encode().split()]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 3000 else {x for x, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + k for i, x in enumerate(windows) if x in twice for k in range(3)}
    n, r = len(w), len(covered)
    return n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dup, r, n < 50 or 100 * r > 50 * n


def test_counts_of_whole_table(spark, sf):
    given = dict(rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text"))
    got = QUERIES["op8_quality_rules"](spark, sf).collect()
    assert len(got) == len(given)
    for r in got:
        want = counts(given[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["base_failed"] and r["kept"])


def test_counts_of_odd_texts(spark):
    given = [(1, None), (2, ""), (3, "a b c a b c"), (4, "x\n x\nx\n\n\n#|<é😀"), (5, "a a a a"), (6, words(0, 49)), (7, words(0, 50)), (8, "\u00a0 \u2003x \x0b\x0c y"), (7, words(0, 50)), (None, "z")]
    got = quality_rules(docs(spark, *given), spark.createDataFrame([], LABELS))
    want = sorted(((i, *counts(t)) for i, t in given), key=str)
    assert sorted(rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), key=str) == want
    assert all(r["kept"] == (not r["base_failed"]) and r["probability"] is None for r in got.collect())
    assert quality_rules(docs(spark), spark.createDataFrame([], LABELS)).collect() == []


def corpus(n=400):
    """Clean prose, junk and toxic texts of their own words."""
    draw = random.Random(1)
    out, labels = [], []
    for i in range(n):
        w = [draw.choice("abcdefghij") + draw.choice("aeiou") + str(draw.randrange(50)) for _ in range(120)]
        junk, toxic = i % 5 == 0, i % 5 == 1
        if junk:
            w = [x + draw.choice(["$$$", "###", "!!|"]) for x in w]
        if toxic:
            for _ in range(4):
                w[draw.randrange(120)] = draw.choice(["vilewordx", "nastytermy", "hatefulz"])
        out.append((i, " ".join(w), "en", f"host{i % 7}", None))
        labels.append((i, int(not junk), int(toxic)))
    return out, labels


def test_models_on_held_out_rows(spark):
    out, labels = corpus()
    table, known = docs(spark, *out), spark.createDataFrame(labels, LABELS)
    of = {i: (q, t) for i, q, t in labels}
    good = quality_rules(table, known).collect()
    assert sum(r["kept"] == bool(of[r["doc_id"]][0]) for r in good) >= 395
    found = toxicity(table, known).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in found)
    assert all(r["predicted"] == of[r["doc_id"]][1] for r in found if r["held_out"])
    assert not {i for r in found for i in r["neighbours"]} & {r["doc_id"] for r in found if r["held_out"]}
    judged = site_quality(table, known, table["source"], F.concat_ws("/", table["source"], table["lang"])).collect()
    assert sum(r["kept"] == bool(of[r["doc_id"]][0]) for r in judged if r["held_out"]) >= 0.97 * sum(r["held_out"] for r in judged)
    assert {r["doc_id"] for r in keep_good(table, known).collect()} == {r["doc_id"] for r in good if r["kept"]}
    assert {r["doc_id"] for r in keep_clean(table, known).collect()} == {r["doc_id"] for r in found if not r["predicted"]}


def test_labels_of_held_out_rows_do_not_count(spark):
    out, labels = corpus(100)
    turned = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in labels]
    table = docs(spark, *out)
    one, two = (sorted(rows(toxicity(table, spark.createDataFrame(x, LABELS)), "doc_id", "score")) for x in (labels, turned))
    assert one == two


def test_an_id_is_one_example(spark):
    given = [*[(1, f"text {i} of one") for i in range(50)], (2, "two"), (3, None), (4, "four")]
    known = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 5)], LABELS)
    assert sorted(rows(sampled(docs(spark, *given), known, "quality", 100, 100), "text", "label")) == [("", 1), ("four", 0), ("text 0 of one", 1), ("two", 0)]
    out, _ = examples_of(docs(spark, *given), known, 100, 100)
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and dict(rows(out, "doc_id", "text")).get(1, "text 0 of one") == "text 0 of one"


def test_without_a_model_all_documents_stay(spark):
    out, _ = corpus(20)
    toxic = spark.createDataFrame([(i, 1, 1) for i in range(20)], LABELS)
    assert keep_clean(docs(spark, *out), toxic).count() == 20


def test_models_of_odd_rows(spark):
    out, labels = corpus(60)
    odd = [*out, (None, "vilewordx " * 60, None, None, None), (7, None, None, None, None), (7, out[7][1], "en", "host0", 1)]
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (999, 1, 1), (4, 7, 9)], LABELS)
    table = docs(spark, *[(*r, "clash") for r in odd], more=", score string")
    for got in (toxicity(table, known), quality_rules(table, known), site_quality(table, known, table["source"], table["lang"])):
        assert got.count() == len(odd)
    assert keep_clean(table, known).columns == table.columns and keep_good(table, known).columns == table.columns
    none, empty = spark.createDataFrame([], LABELS), docs(spark)
    assert {r["score"] for r in toxicity(table, none).collect()} == {0.0}
    assert site_quality(table, none, table["source"], table["lang"]).count() == len(odd)
    for got in (toxicity(empty, none), quality_rules(empty, none), site_quality(empty, none, empty["source"], empty["lang"])):
        assert got.collect() == []


def test_index_finds_what_a_full_scan_finds():
    draw = np.random.default_rng(0)
    vectors = []
    for _ in range(1500):
        terms = np.sort(draw.choice(40, draw.integers(0, 6), replace=False))
        w = draw.random(len(terms))
        vectors.append((terms, w / np.sqrt((w * w).sum()) if len(w) else w))
    full = np.zeros((1500, 40))
    for i, (t, w) in enumerate(vectors):
        full[i, t] = w
    index = Index(vectors, 40, 64)
    for t, w in vectors[:200]:
        q = np.zeros(40)
        q[t] = w
        scores = full @ q
        order = [i for i in np.lexsort((np.arange(1500), -np.round(scores, 9))) if scores[i] > 0][:10]
        near = index.nearest(t, w, 10)
        assert [round(s, 9) for s, _ in near] == [round(scores[i], 9) for i in order]
