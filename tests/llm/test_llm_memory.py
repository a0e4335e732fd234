"""Blocks of a group of near copies are bounded by texts as well as by shingles."""

import tracemalloc

import numpy as np
import pyarrow as pa

from wardline.llm import jaccard


def test_a_block_of_short_texts_is_small(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat(array_join(transform(sequence(1, 40), x -> concat('w', x)), ' '), ' ', id % 2500) AS text")
    got = jaccard.near_duplicates(docs)
    assert got.where("n_links <> 2999 OR class_id <> 0").count() == 0 and got.count() == 3000


def test_a_full_block_of_pairs():
    """All pairs of a full block, every one of them similar, within 300 MB."""
    values = np.zeros((jaccard.BLOCK_TEXTS, jaccard.VALUES), np.uint16)
    tracemalloc.start()
    pairs = jaccard.survivors(values, values, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) == jaccard.BLOCK_TEXTS**2 and peak < 300 << 20


def test_string_ids(spark):
    rows = [("a", "one two three four five six"), ("b", "one two three four five six"), (None, "x y z"), ("c", None), ("", "x y z")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {"a": ("a", 1), "b": ("a", 1), None: ("", 1), "c": ("c", 0), "": ("", 1)}
    assert sorted(r.doc_id for r in jaccard.keep_first(docs).collect()) == ["", "a", "c"]
    assert isinstance(pa.array([r.doc_id for r in docs.collect()]), pa.StringArray)
