from pyspark.sql import functions as F

from corvane.operators import dedup
from corvane.plans import catalog


def test_words_are_unicode_runs(spark):
    docs = spark.createDataFrame([(1, "\"The cell, (the) wall; größer_2 – DIES!\""), (2, "cell, cell"), (3, "the cell the wall größer_2 dies")], "doc_id long, text string")
    got = {r.doc_id: sorted(r.s) for r in docs.select("doc_id", dedup.word_shingles(F.col("text")).alias("s")).collect()}
    assert got[1] == got[3] == sorted(["the cell the", "cell the wall", "the wall größer_2", "wall größer_2 dies"]) and got[2] == ["cell"]
    bank = docs.where("doc_id = 3").select(F.lit(9).alias("item_id"), "text")
    found = {r.doc_id: (r.duplicate, r.similarity) for r in dedup.duplicate_of_bank(docs, bank).collect()}
    assert found[1] == (True, 1.0) and found[2] == (False, 0.0)


def test_word_statements_take_words(spark):
    for name in ("d2_word_shingles", "d4_word_duplicate_of_bank"):
        assert "regexp_split" not in catalog.SQL[name] and "p{L}" in catalog.SQL[name]
