import itertools
import random
import time

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from corvane.llm import sentencepiece_nbest as nbest

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def enumerated(own, unit):
    """Scores of all segmentations of a short unit, best first."""
    into, paths = own.edges(unit), {0: [0.0]}
    for end in range(1, len(unit) + 1):
        paths[end] = [s + score for start, _, score in into[end] for s in paths[start]]
    return sorted(paths[len(unit)], reverse=True)


def units():
    rng = random.Random(1)
    fixed = ["▁hello", "▁naïve", "abc", "▁", "--------", "漢字▁", "x" * 12, "▁▁▁ab", "🙂a", " "]
    return fixed + ["".join(rng.choices("abcde▁éß-漢", k=rng.randrange(1, 11))) for _ in range(200)]


def test_both_searches_equal_enumeration():
    own = nbest.lattice(MODEL)
    for n in (1, 3, 6):
        scores, ids, bounds = own.nbest_many(units(), n)
        for k, unit in enumerate(units()):
            want = enumerated(own, unit)[:n]
            assert np.allclose(scores[k][scores[k] > -np.inf], want) and np.allclose([s for s, _ in own.nbest(unit, n)], want)
            found = [tuple(ids[bounds[k * n + r] : bounds[k * n + r + 1]].tolist()) for r in range(len(want))]
            assert len(set(found)) == len(want) and all(own.processor.decode(list(f)).lstrip() == unit.replace("▁", " ").lstrip() for f in found)


def test_ties_and_long_units_end_soon():
    own = nbest.lattice(MODEL)
    began = time.time()
    for unit in ("-" * 327, "=" * 250, "-" * 5000, "ab" * 400):
        got = own.nbest(unit, 3)
        assert len({tuple(ids) for _, ids in got}) == 3 and sorted((s for s, _ in got), reverse=True) == [s for s, _ in got]
    assert time.time() - began < 5
    # a long unit takes the heap, its parts the arrays: the same best score either way
    assert own.nbest("-" * 32, 3)[0][0] == own.nbest_many(["-" * 32], 3)[0][0, 0]


def test_texts_equal_the_product_of_their_units(spark):
    own = nbest.lattice(MODEL)
    texts = ["Hello  world\nß 漢字", "a b c", " lead", "x", "the the", "Élan vital -- ----"]
    rows = [(k, t, "x", 7) for k, t in enumerate(texts)] + [(90, None, "x", 7), (91, "", "x", 7), (0, texts[0], "y", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string, ids long")
    got = nbest.encode_nbest(docs, MODEL, 4, decoded=True)
    back = nbest.decode(got.drop("decoded").withColumn("kept", F.lit(1)), MODEL).collect()
    assert {r.kept for r in back} == {1} and sorted((r.doc_id, r.rank, r.decoded) for r in back) == sorted((r.doc_id, r.rank, r.decoded) for r in got.collect())
    for k, text in enumerate(texts):
        want = [0.0]
        for unit in own.units(own.processor.normalize(text)):
            want = sorted((a + b for a, b in itertools.product(want, enumerated(own, unit)[:4])), reverse=True)[:4]
        mine = [r for r in back if r.doc_id == k]
        assert np.allclose(sorted({r.rank: r.score for r in mine}.values(), reverse=True), want) and {r.decoded for r in mine} == {text}
        assert len({bytes(r.ids) for r in mine}) == len(want) and len(mine) == len(want) * (2 if k == 0 else 1)
    assert sorted((r.doc_id, r.rank, r.n_pieces, r.decoded) for r in back if r.doc_id >= 90) == [(90, 1, 0, ""), (91, 1, 0, "")]
    assert nbest.encode_nbest(docs.where("false"), MODEL).count() == 0
    nothing = spark.createDataFrame([(1, None)], "i long, ids binary")
    assert [r.decoded for r in nbest.decode(nothing, MODEL).collect()] == [None]


def test_decoding_equals_the_library():
    own, rng = nbest.lattice(MODEL), np.random.default_rng(3)
    for _ in range(300):
        ids = rng.integers(0, len(own.processor), rng.integers(1, 9)).astype("<i4")
        if not any(own.processor.is_byte(int(k)) for k in ids):  # loose bytes: how many U+FFFD a broken run gives is the library's own
            assert own.text(ids) == own.processor.decode(ids.tolist())
    for text in ("Hello  world\nß 漢字🙂", " x", "", "a\tb"):
        ids = np.array(own.processor.encode(text), "<i4")
        assert own.text(ids) == own.processor.decode(ids.tolist()) == text


def test_cache_starts_anew(spark, monkeypatch):
    texts = [" ".join(f"w{k}x{j}" for j in range(20)) for k in range(30)]
    whole = [[(s, i.tolist()) for s, i in found] for found in nbest.encode_texts(MODEL, texts, 3)]
    monkeypatch.setattr(nbest, "CACHE_BYTES", 0)
    monkeypatch.setattr(nbest, "SLICE_CHARS", 100)
    nbest._units.cache_clear()
    assert [[(s, i.tolist()) for s, i in found] for found in nbest.encode_texts(MODEL, texts, 3)] == whole
