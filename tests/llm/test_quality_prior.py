import random

import numpy as np
import pytest
import zstandard as zstd
from pyspark.sql import functions as F

from corvane.llm import quality


def test_prior_is_that_of_all_labels(spark):
    rng = random.Random(5)
    # a class gives many of its own words and some of the other's, so the prior matters
    words = [["$$$", "BUY!!", "###", "xx%%"], ["good", "words", "read", "well"]]
    texts = [" ".join(rng.choices(words[y], k=3) + rng.choices(words[0] + words[1], k=9)) for y in [0] * 200 + [1] * 1800]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") >= 200).cast("int").alias("quality"))
    for sample in (150, 5000):
        mean = quality.score(docs, quality.fit(docs, labels, sample_rows=sample)).agg(F.avg("score")).first()[0]
        assert abs(mean - 0.9) < 0.05


def _plain_features(text, good, bad):
    """Sizes of the pieces of a whole text, each compressed alone under either dictionary."""
    if not text:
        return [0.0, 0.0, 0.0]
    pieces = [text[at : at + quality.PIECE_BYTES] for at in range(0, len(text), quality.PIECE_BYTES)]
    g, b = (sum(len(zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(p)) for p in pieces) for d in (good, bad))
    return [(b - g) / max(g, b), min(g, b) / len(text), abs(b - g) / len(text)]


def test_score_is_that_of_plain_sizes_and_weights(spark):
    rng = random.Random(7)
    words = [["$$$", "BUY!!", "###", "xx%%"], ["good", "words", "read", "well", "über"]]
    texts = [" ".join(rng.choices(words[k % 2], k=rng.choice([3, 40, 4000]))) for k in range(240)] + ["", None]
    docs = spark.createDataFrame([(k, t, "en", 0.5) for k, t in enumerate(texts)], "doc_id long, text string, lang string, score double")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.fit(docs, labels)
    assert model.good and model.bad
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    *w, bias = model.weights
    for k, text in enumerate(texts):
        x = _plain_features((text or "").encode(), model.good, model.bad)
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(np.dot(x, w) + bias))))
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == {k for k, s in got.items() if s >= 0.3}


def test_dictionaries_hold_whole_texts_within_the_bound(spark):
    # what tells the classes stands at the end of long texts only
    tail = ["cheap pills casino bonus jackpot spin", "careful measured argument with a source"]
    rng = random.Random(8)
    filler = lambda: " ".join(str(rng.random()) for _ in range(500))
    docs = spark.createDataFrame([(k, f"{filler()} {' '.join(rng.choices(tail[k % 2].split(), k=60))}") for k in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.fit(docs, labels)
    assert b"jackpot" in model.bad and b"measured" in model.good
    small = quality.fit(docs, labels, build_bytes=200_000)
    assert small.good != model.good and len(small.good) <= 65536
    # every text is longer than an eighth of the bound, or all labels are of one class: the labels' rate throughout
    for flat, rate in ((quality.fit(docs, labels, build_bytes=8000), 151 / 302), (quality.fit(docs, labels.where("quality = 1")), 151 / 152)):
        assert {round(r.score, 9) for r in quality.score(docs, flat).collect()} == {round(rate, 9)}
