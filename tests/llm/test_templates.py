"""Contamination by questions whose values or names were changed."""

import pytest

pytest.importorskip("public_tokenizers")


def found(spark, item, texts):
    from cityloom.llm import decontaminate as D

    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: (r["coverage"], r["run"]) for r in D.marked(d, bench).collect() if r["contaminated"]}


def test_windows_dense_with_slots_count_between_others(spark):
    item = "A train travels 60 km in 2 hours. How far does it travel in 5 hours?"
    got = found(spark, item, [item.replace("60", "80").replace("2", "3").replace("5", "7"), item, item.replace("60", "80").replace("2", "3").replace("5", "3"), "He ran 5 km in 2 hours and 3 minutes.", item.replace("60 km in 2 hours", "all day long")])
    assert got == {0: (1.0, 16), 1: (1.0, 16)}


def test_names_that_begin_sentences(spark):
    item = "Tom has 12 apples. Tom gives 5 apples to Ann. How many apples does Tom have left?"
    other = "Sam has 40 apples. Sam gives 9 apples to Eva. How many apples does Sam have left?"
    mixed = "Sam has 40 apples. Max gives 9 apples to Eva. How many apples does Leo have left?"
    got = found(spark, item, [other, 'He asked:\n"' + other + '"', "The task is this. " + other, mixed, "Sam has 40 pears."])
    assert set(got) == {0, 1, 2} and set(got.values()) == {(1.0, 17)}


def test_first_words_are_no_names(spark):
    from pyspark.sql import functions as F

    from cityloom.llm import decontaminate as D

    text = "How far? Tom's dog. The end\nAnn (Eva) said: \"Where is Thea?\" It. McDonald"
    got = spark.createDataFrame([(text,)], "t string").select(D.marked_names(F.col("t"))).first()[0]
    want = text
    for name in ("Tom", "Ann", "Eva", "Thea", "McDonald"):
        want = want.replace(name, D.MARK + name)
    assert got == want
