"""What the stages of the pipeline do with documents that have nothing left."""

import corpus_pipeline
from helpers import docs, rows, words


def test_emptied_documents_are_not_packed(spark):
    passage = words(0, 60) + "\n" + words(100, 8)
    given = docs(spark, (1, passage + "\nown one"), (2, passage), (3, "x\n" + passage), (4, words(500, 70)), (5, " \n\t"), (6, None), (7, ""))
    left = corpus_pipeline.lines(spark, given, "")
    assert dict(rows(left, "doc_id", "text"))[2] == ""
    kept = corpus_pipeline.near_duplicates(spark, left, "")
    assert kept.columns == given.columns and sorted(rows(kept, "doc_id")) == [(1,), (3,), (4,)]
    packed = corpus_pipeline.packing(spark, kept, "")
    assert {r["doc_id"] for r in packed.collect()} == {1, 3, 4}
    assert corpus_pipeline.near_duplicates(spark, docs(spark), "").collect() == []


def test_repeated_rows_and_clashing_columns_pass_through(spark):
    text = words(0, 80)
    given = docs(spark, (1, text, "en", "a", 1, "x"), (1, text, "en", "a", 1, "y"), (None, words(200, 60), None, None, None, "z"), more=", component_id string")
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.lines(spark, given, ""), "")
    assert sorted(rows(kept, "doc_id", "component_id"), key=str) == sorted([(1, "x"), (1, "y"), (None, "z")], key=str)
