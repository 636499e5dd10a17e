"""Mixing: repeated rows, documents taken for certain, and the sums that a target asks for."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_pipeline import plain_mix
from veldspar.llm import mixing

DOCS = "doc_id long, text string, source string"


def taken(found):
    out = Counter()
    for r in found:
        out[r.source] += r.taken
    return out


@pytest.mark.parametrize("keep", [None, ["doc_id", "source"]])
def test_equal_rows_come_near_their_target(spark, keep):
    rows = [(1, "one two three four five six seven eight nine ten", "x")] * 2000 + [(k, f"a{k} b c d e f g h i j", "y") for k in range(2000)] + [(k, f"w{k} " * (k % 50), None) for k in range(60)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    found = mixing.mix(docs, keep=keep).collect()
    assert len(found) == len(rows)
    for source, n in taken(found).items():
        target = next(r.target for r in found if r.source == source)
        assert abs(n - target) <= 25, (source, n, target)
    x = Counter(r.copies for r in found if r.source == "x")
    assert set(x) == {1, 2} and sum(x.values()) == 2000
    again = mixing.mix(docs.coalesce(2), keep=keep)
    assert sorted(map(str, again.collect())) == sorted(map(str, found))


def test_a_table_of_one_repeated_row(spark):
    docs = spark.range(9000).select(F.lit(7).alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    both = docs.unionByName(spark.range(3000).select("id", F.lit("d e f").alias("text"), F.lit("t").alias("source")).withColumnRenamed("id", "doc_id"))
    found = mixing.mix(both).collect()
    assert len(found) == 12000
    for source, n in taken(found).items():
        target = next(r.target for r in found if r.source == source)
        assert abs(n - target) <= 2


def test_rows_that_differ_in_another_column_are_drawn_apart(spark):
    docs = spark.range(4000).select(F.lit(1).alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("source"), "id", F.create_map(F.lit("k"), "id").alias("m"))
    found = mixing.mix(docs).collect()
    assert sorted(r.id for r in found) == list(range(4000))
    assert all(abs(n - next(r.target for r in found if r.source == s)) <= 4 for s, n in taken(found).items())


def test_large_documents_are_taken_for_certain(spark):
    rows = [(k, "long " * 2000, "a") for k in range(3)] + [(k, f"s{k} " * (1 + k % 7), "a") for k in range(3, 3000)] + [(k, f"t{k} " * 9, "b") for k in range(5000, 8000)]
    docs = spark.createDataFrame(rows, DOCS)
    found = mixing.mix(docs).collect()
    want = plain_mix(docs.collect())
    assert {r.doc_id: r.copies for r in found} == want
    for source, n in taken(found).items():
        assert abs(n - next(r.target for r in found if r.source == source)) <= 10


def test_expected_words_are_those_missing():
    """Of plain_mix's inclusion probabilities: certain words and level * squares add up to what is missing."""
    sizes, missing = [5000, 900, 900] + [7] * 300 + [1] * 100, 6000.0
    ranked, words = sorted(sizes, reverse=True), 0
    while (missing - words) / sum(s * s for s in ranked) * ranked[0] >= 1:
        words += ranked.pop(0)
    level = (missing - words) / sum(s * s for s in ranked)
    assert words + sum(level * s * s for s in ranked) == pytest.approx(missing) and all(level * s < 1 for s in ranked)
