"""Lookups, ranks, keys and group samples against plain loops."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import ranks
from corvane.operators import lookup, reports


@pytest.mark.parametrize("block", [200_000, 300])
def test_large_taxonomy(spark, monkeypatch, block):
    monkeypatch.setattr(lookup, "PHRASES", block)
    rng = random.Random(block)
    syllables = ["ka", "lo", "mi", "ré", "tu", " ", "so"]
    keywords = [(f"t{k % 40}", k % 40, "".join(rng.choices(syllables, k=rng.randint(2, 4))), rng.randint(1, 3)) for k in range(2000)] + [("t3", 3, "KA LO", 5), ("t9", 9, None, 9)]
    texts = [(k, "".join(rng.choices([*syllables, "KA"], k=rng.randint(0, 40)))) for k in range(200)] + [(-1, None), (-2, ""), (-3, "zzz")]
    frame = spark.createDataFrame(texts, "id long, body string").withColumns({"topic_ord": F.lit(1), "phrase": F.lit("x")})
    got = {r.id: r.topic for r in lookup.classify_by_table(frame, "body", spark.createDataFrame(keywords, "topic string, topic_ord int, phrase string, weight int")).collect()}
    for k, text in texts:
        score = {}
        for topic, order, phrase, weight in keywords:
            if phrase is not None and phrase.lower() in (text or "").lower():
                score[order] = score.get(order, 0) + weight
        want = "Other / General" if not score else f"t{min(score, key=lambda o: (-score[o], o))}"
        assert got[k] == want, (k, text)


def test_price_table(spark):
    rng = random.Random(1)
    prices = [("".join(rng.choices("ab", k=rng.randint(0 if k == 9999 else 1, 14))), k, float(k)) for k in range(10_000)]
    models = ["".join(rng.choices("abc", k=rng.randint(0, 20))) for _ in range(300)] + [None, "zz"]
    usage = spark.createDataFrame([(k, m) for k, m in enumerate(models)], "id long, model string")
    out = lookup.price_by_table(usage, "model", spark.createDataFrame(prices, "prefix string, ord int, cost double"), {"cost": -1.0})
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.cost for r in out.collect()}
    assert got == {k: next((c for p, _, c in prices if m is not None and m.startswith(p)), -1.0) for k, m in enumerate(models)}


def test_pages_with_needles(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "délta", "e", "\n", "😀", "long-word-of-many-letters"]
    pages = [(d, p, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for d in range(8) for p in range(1, 6)] + [(0, 9, None)]
    items = []
    for at in range(200):
        d, _, text = rng.choice(pages[:-1])
        begin = rng.randrange(len(text) + 1)
        items.append((d, at, text[begin : begin + rng.choice([3, 10, 25, 25, 25])] if at % 5 else " ".join(rng.choices(words, k=8))[:25]))
    items = [x for x in items if x[2]]
    got = {(r.doc, r.at, r.page) for r in lookup.pages_with(spark.createDataFrame(items, "doc int, at int, needle string"), spark.createDataFrame(pages, "doc int, page int, text string")).collect()}
    assert got == {(d, at, p) for d, at, n in items for e, p, t in pages if d == e and t and n in t} and len(got) > 150


def test_ranks_and_totals(spark):
    rows = [(rng_k % 3, rng_k * 7 % 1009, rng_k) for rng_k in range(1000)] + [(5, k, 1) for k in range(800)]
    frame = spark.createDataFrame(rows, "k int, v int, n int")
    order = {k: sorted((v, n) for j, v, n in rows if j == k) for k in (0, 1, 2, 5)}
    assert all(order[r.k][r.rank - 1] == (r.v, r.n) for r in ranks.ranked(frame, ["k"], ["v", "n"]).collect())
    whole = sorted((v, n, k) for k, v, n in rows)
    before = {}
    total = 0
    for v, n, k in whole:
        before[(v, n, k)] = total
        total += n
    assert {(r.v, r.n, r.k): r.before for r in ranks.running_total(frame, ["v", "n", "k"], "n").collect()} == before


def test_keys_equal_a_loop(spark):
    rng = random.Random(3)
    names = [rng.choice(["Ann B", "ann-b", "Bo", "7up", "", None, "x" * 40]) for _ in range(600)] + ["Max"] * 3000
    existing = ["bo", "bo2", "bo5", "student3", "annb3", "annb4", "max7", "max1000", "max1001", "max00", "x" * 32, *[f"max{k}" for k in range(20, 60)]]
    frame = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {r.id: r.username for r in reports.unique_keys(frame, "name", "id", spark.createDataFrame([(e,) for e in existing], "username string"), "username").collect()}
    bases = []
    for n in names:
        s = re.sub("[^a-z0-9]", "", (n or "").lower()) or "student"
        bases.append(("s" + s if s[0].isdigit() else s)[:32])
    taken, plain, want = set(existing), set(bases), {}
    for k, b in enumerate(bases):
        if b not in taken:
            want[k] = b
            taken.add(b)
            continue
        stem, n = b[:27] if len(b) > 27 else b, 2
        while f"{stem}{n}" in taken or f"{stem}{n}" in plain:
            n += 1
        want[k] = f"{stem}{n}"
        taken.add(want[k])
    assert got == want and len(set(got.values())) == len(names)


def test_keys_stay_unique_where_plain_names_end_in_digits(spark):
    rng = random.Random(5)
    names = [rng.choice(["Bo", "Bo 1", "Bo 11", "bo12", "bo2", "b"]) for _ in range(900)]
    frame = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    out = reports.unique_keys(frame, "name", "id", spark.createDataFrame([("bo3",), ("bo13",)], "username string"), "username").collect()
    got = {r.username for r in out}
    assert len(out) == len(names) == len(got) and not got & {"bo3", "bo13"} and all(re.fullmatch(re.sub("[^a-z0-9]", "", r.name.lower()) + r"\d*", r.username) for r in out)


@pytest.mark.parametrize("n", [1, 5, 40, 10_000])
def test_group_sample_equals_a_loop(spark, n):
    rng = random.Random(4)
    full = [(rng.choice([None, *range(12)]), k, rng.random() < 0.5, rng.random() < 0.4) for k in range(150)]
    frame = spark.createDataFrame(full, "g int, k int, answered boolean, pooled boolean")
    got = [(r.g, r.k) for r in reports.sample_groups(frame.where("pooled"), frame, "g", "k", n, 7, F.col("answered")).collect()]
    groups = {}
    for g, k, _, pooled in full:
        if pooled:
            groups.setdefault(f"s{k}" if g is None else f"g{g}", []).append((g, k))
    for g, k, answered, pooled in full:
        if g is not None and answered and not pooled and f"g{g}" in groups:
            groups[f"g{g}"].append((g, k))
    want = []
    for name in sorted(groups, key=lambda x: (hashlib.md5(f"7:{x}".encode()).hexdigest(), x)):
        if len(want) >= n:
            break
        want += groups[name]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(got) >= min(n, sum(map(len, groups.values())))
