"""Archives as a round trip, neighbours against brute force, the pipeline against its stages."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import docs, rows, words
from pyspark.sql import functions as F
from strongbox.llm.neighbours import nearest_neighbours
from strongbox.llm.queries import QUERIES
from strongbox.llm.warc import Unchunked, chunked, cuts, read_records, read_warc, reassemble, write_warc
from strongbox.workspace import new_folder

PAGES = "page_id long, url string, html string, digest string, row long"


def expected(pages, least=1000):
    last = {}
    for p, html in pages:
        last[html or ""] = max(last.get(html or "", p), p)
    out = []
    for p, html in pages:
        data = (html or "").encode()
        to = last[html or ""] if len(data) >= least and last[html or ""] > p else None
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_whole_table(spark, sf):
    given = rows(spark.read.parquet(f"{sf}/pages.parquet"), "page_id", "html")
    assert sorted(rows(QUERIES["op6_warc"](spark, sf), *COLUMNS), key=str) == expected(given)


def test_segments_and_odd_payloads(spark):
    big = "é€😀\r\n\r\nWARC/1.1\r\n\r\n" * 400
    given = [(1, big), (2, big), (-3, big + "x"), (4, None), (5, ""), (6, "\r\n\r\n"), (7, "a" * 999), (8, "a" * 999), (9, "b" * 1000), (10, "b" * 1000), (11, "\r\n" * 900)]
    path = new_folder(spark, "warc")
    frame = spark.createDataFrame([(p, "http://x/\r\nevil: 1", h, "clash", 1) for p, h in given] + [(None, None, "z", None, None)], PAGES)
    write_warc(frame, path, segment=512)
    assert sorted(rows(read_warc(spark, path), *COLUMNS), key=str) == expected(given)
    segments = read_records(spark, path).where("block is not null")
    assert segments.where("type = 'continuation'").count() > 20
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in reassemble(segments, payloads=True).collect()}[2] == big
    with pytest.raises(Exception, match="missing"):
        reassemble(segments.where("segment <> 2")).collect()
    with pytest.raises(Exception, match="missing"):
        reassemble(segments.where("total is null")).collect()


def test_repeated_and_no_pages(spark):
    path, html = new_folder(spark, "warc"), "c" * 3000
    write_warc(spark.createDataFrame([(1, None, html, None, None)] * 2, PAGES), path, segment=1024)
    assert rows(read_warc(spark, path), *COLUMNS) == expected([(1, html), (1, html)])
    path = new_folder(spark, "warc")
    write_warc(spark.createDataFrame([], PAGES), path)
    assert read_warc(spark, path).collect() == []


def test_chunked_framing_cut_anywhere():
    data = ("é" * 5000).encode()
    framed = chunked(data, 777)
    for step in (1, 2, 3, 5, 1000, len(framed)):
        frame = Unchunked(keep=True)
        for a in range(0, len(framed), step):
            frame.feed(framed[a : a + step])
        assert frame.done()[0] == len(data) and b"".join(frame.kept) == data
    assert cuts(b"", 4) == [] and cuts("éé".encode(), 3) == [2]


VECTORS = "vec_id long, embedding array<double>, score string"


def brute(vectors, k, every):
    good = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, list(v)), list(v))
    out = []
    for q, v in good.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good.items() if i != q)[:k]
            out += [(q, r, i, round(-s, 9)) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def found(df):
    return sorted((q, r, v, round(s, 9)) for q, r, v, s in rows(df, "query_id", "rank", "vec_id", "score"))


def test_neighbours_of_whole_table(spark, sf):
    given = rows(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding")
    got, want = found(QUERIES["op10_nearest_neighbours"](spark, sf)), brute(given, 20, 20)
    pairs = {(q, v) for q, _, v, _ in want}
    assert len(got) == len(want) and len(pairs & {(q, v) for q, _, v, _ in got}) >= 0.9 * len(pairs)


def test_neighbours_of_few_odd_and_equal_vectors(spark):
    draw = np.random.default_rng(3)
    given = [(i, draw.standard_normal(6).round(3).tolist()) for i in range(15)] + [(100 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(30)]
    given += [(200, None), (201, [0.0] * 6), (202, [1.0, None] + [0.0] * 4), (203, [float("nan")] + [0.0] * 5), (204, [float("inf")] + [0.0] * 5), (205, []), (None, [1.0] * 6)]
    given += [(3, given[3][1]), (220, [2.0, 1.0])]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in given], VECTORS)
    assert found(nearest_neighbours(frame, F.col("vec_id") % 5 == 0, 20)) == brute(given, 20, 5)
    two = frame.where("vec_id in (0, 1)")
    assert found(nearest_neighbours(two, F.col("vec_id") == 0, 20)) == brute([g for g in given if g[0] in (0, 1)], 20, 5)
    assert nearest_neighbours(frame.where("vec_id = 0"), F.col("vec_id") == 0).collect() == []
    assert nearest_neighbours(spark.createDataFrame([], VECTORS), F.col("vec_id") == 0).collect() == []


def test_descent_and_search_find_what_no_leaf_holds(spark):
    draw = np.random.default_rng(7)
    given = [(i, (v / np.sqrt(v @ v)).tolist()) for i, v in enumerate(draw.standard_normal((3000, 12)))]
    frame = spark.createDataFrame([(i, v, "") for i, v in given], VECTORS)
    want = {(q, v) for q, _, v, _ in brute(given, 20, 20)}
    # Two tables of leaves of 64 nodes: the first lists hold few of the nearest.
    got = {(q, v) for q, _, v, _ in found(nearest_neighbours(frame, F.col("vec_id") % 20 == 0, 20, tables=2, leaf=64))}
    assert len(got & want) >= 0.98 * len(want)


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    given, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    frame = given
    for name, stage in p.STAGES[:-1]:
        frame = stage(spark, frame, sf).cache()
        assert frame.columns == given.columns
        seen[name] = {r["doc_id"] for r in frame.collect()}
    texts = dict(rows(frame, "doc_id", "text"))
    assert seen["quality rules"] >= seen["toxicity"] == seen["line dedup"] >= seen["n-gram Jaccard join"]
    packed = p.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == set(texts)
    held = defaultdict(int)
    for r in packed:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= 1024


def test_pipeline_stages_do_their_work(spark, sf, tmp_path):
    import corpus_pipeline as p

    clean = [(i, "\n".join(f"{words(1000 * i + 100 * j, 20)}" for j in range(5)), "en", "a", 1) for i in range(1, 40)]
    copy = (50, clean[0][1].replace(" w1005 ", " changed "), "en", "b", 1)
    passage = (51, words(70000, 60) + "\n" + clean[1][1].split("\n")[0] + "\n" + words(80000, 70), "en", "b", 1)
    again = (52, words(90000, 60) + "\n" + words(80000, 70), "en", "b", 1)
    frame = docs(spark, *clean, copy, passage, again)
    after = dict(rows(p.lines(spark, frame, sf), "doc_id", "text"))
    assert after[52] == words(90000, 60) and after[51] == passage[1]
    kept = {r["doc_id"] for r in p.near_duplicates(spark, frame, sf).collect()}
    assert kept == {*range(1, 40), 51, 52}
