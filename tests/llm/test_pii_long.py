"""op9: very many matches in one text, boosting, threshold and overlaps against plain loops."""

import itertools
import math
import random
import re
import time

from pyspark.sql import functions as F

from corvane.llm import pii


def test_very_many_matches_in_one_text(spark):
    text = " ".join(f"u{k}@x{k % 7}.org" for k in range(60_000)) + " call +49 (30) 1234567"
    frame = spark.createDataFrame([(1, text), (2, "a@b.co")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_personal_data(frame).collect()}
    assert time.time() - began < 120
    assert [s[1:] for s in got[1] if s[0] == "email"] == [m.span() for m in re.finditer(r"[a-z0-9]+@[a-z0-9.]+", text)] and [s[0] for s in got[1]].count("phone") == 1
    assert got[2] == [("email", 0, 6)]


def test_overlaps_equal_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(pii, "RUN", 4)
    rng = random.Random(1)
    rows = []
    for k in range(200):
        spans = [sorted((rng.choice("abc"), *sorted(rng.sample(range(120), 2)), rng.choice([0.5, 0.7])) for _ in range(rng.randint(0, 14))) for _ in range(2)]
        rows.append((k, *spans))
    span = "array<struct<kind:string,start:int,end:int,score:double>>"
    frame = spark.createDataFrame(rows, f"k int, one {span}, two {span}")

    def better(o, m):
        return (o["score"] > m["score"]) | ((o["score"] == m["score"]) & (o["start"] < m["start"]))

    out = frame.select("k", pii._free(F.col("one"), F.col("two"), lambda o, m: F.lit(True)).alias("x"), pii._free(F.col("one"), F.col("one"), better).alias("y")).collect()
    over = lambda a, b: a[1] < b[2] and b[1] < a[2]
    for r in out:
        _, one, two = rows[r.k]
        assert [tuple(s) for s in r.x] == [m for m in one if not any(over(o, m) for o in two)]
        assert [tuple(s) for s in r.y] == [m for m in one if not any(over(o, m) and (o[3] > m[3] or (o[3] == m[3] and o[1] < m[1])) for o in one)]


def test_threshold_is_the_least_score_that_reaches_the_precision():
    rng = random.Random(2)
    names = list(pii.BINS)
    cells = [(tuple(rng.randint(0, len(pii.BINS[f])) for f in names), float(n := rng.randint(1, 9)), float(rng.randint(0, n))) for _ in range(60)]
    bias, trees = pii.boost(cells, rounds=6)
    scores = [pii._predict(bias, trees, c[0]) for c in cells]
    for precision in (0.3, 0.55, 0.9, 1.0):
        fits = [t for t in sorted(set(scores)) if sum(c[2] for c, s in zip(cells, scores, strict=True) if s >= t) >= precision * sum(c[1] for c, s in zip(cells, scores, strict=True) if s >= t)]
        assert pii.threshold(cells, bias, trees, precision) == (min(fits) if fits else 2.0)


def test_first_tree_has_the_best_split_of_all():
    rng = random.Random(3)
    names = list(pii.BINS)
    cells = [(tuple(rng.randint(0, len(pii.BINS[f])) for f in names), 1.0, float(rng.random() < 0.5)) for _ in range(40)]
    bias, trees = pii.boost(cells, rounds=1)
    p = 1 / (1 + math.exp(-bias))

    def gain(one, two):
        g, h = [0.0] * 4, [1.0] * 4
        for bins, n, good in cells:
            leaf = 2 * (bins[names.index(one[0])] > one[1]) + (bins[names.index(two[0])] > two[1])
            g[leaf] += good - n * p
            h[leaf] += n * p * (1 - p)
        return sum(a * a / b for a, b in zip(g, h, strict=True))

    splits = [(f, c) for f in names for c in range(len(pii.BINS[f]))]
    most = max(gain(a, b) for a, b in itertools.combinations(splits, 2))
    f, a, g, b, _ = trees[0]
    assert abs(gain((f, a), (g, b)) - most) < 1e-9
