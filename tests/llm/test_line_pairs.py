"""Pairs of lines that the deduplication makes."""

from fixtures import documents
from pyspark.sql import functions as F
from webfacts.llm import line_dedup


def test_no_pair_is_made_whose_later_line_is_settled(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(20) if j != i)) for i in range(8)]
    docs = documents(spark, rows)
    distinct = line_dedup.stored(line_dedup.distinct_lines(line_dedup._lines(docs, "doc_id", "text"), [0] * 2**line_dedup.CLASS_BITS))
    flagged = distinct.withColumn("settled", F.col("doc").isin(1, 2, 5))
    pairs = [(r.a_doc, r.b_doc) for r in line_dedup._candidates(line_dedup._postings(flagged)).collect()]
    assert sorted(pairs) == [(a, b) for a in range(8) for b in (3, 4, 6, 7) if a < b]


def test_lines_are_read_at_their_places_only(spark):
    docs = documents(spark, [(1, "a b\n\n \t\nc d"), (1, "a b\n\nx"), (None, "e f\ng h"), (2, None)])
    places = [r for r in line_dedup._lines(docs, "doc_id", "text").collect() if r.doc != 2]
    none = next(r for r in places if r.body == "g h")
    pairs = spark.createDataFrame([(1, 0, 1, 2), (none.doc, none.spot, 1, 3), (7, 0, none.doc, 1)], "a_doc long, a_spot long, b_doc long, b_spot long")
    for most in (100, 0):  # broadcast, and joined by shuffle
        found = line_dedup._bodies(pairs, docs, "doc_id", "text", most)
        assert sorted((r.doc, r.spot, r.body) for r in found.collect()) == sorted([(1, 0, "a b"), (1, 0, "a b"), (1, 2, "x"), (1, 3, "c d"), (none.doc, none.spot, "g h")])
