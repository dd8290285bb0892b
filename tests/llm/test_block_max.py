"""op12 against a plain loop over odd rows; packed integers; blocks that are never unpacked."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import block_max

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(docs, items, k=10):
    found = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    counts = [Counter(t) for _, t in found]
    df = Counter(term for c in counts for term in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, t), tf in zip(found, counts, strict=True):
            score = 0
            for term, q in Counter(TERM.findall((text or "").translate(LOWER))).items():
                if tf[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += q * w * ((1_000_000_000 * tf[term]) // (1000 * tf[term] + 8 * (25 + (75 * len(t) * n_docs) // n_terms)))
            if score:
                scores.append((-score, doc is None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def got(spark, docs, items, partitions=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"shard": F.lit(1), "term": F.lit("x"), "n": F.lit(0)}).repartition(partitions)
    return sorted((tuple(r) for r in block_max.rank_documents(d, spark.createDataFrame(items, "item_id long, text string")).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def rows(seed, n):
    rng = random.Random(seed)
    words = [*[f"w{k}" for k in range(300)], "The", "the", "ÉTÉ", "été", "naïve", "日本", "x1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, rng.choice(" .-\u0000\n").join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 30, 80])))) for k in range(n)]
    docs += [(n, None), (n + 1, ""), (None, "w0 w1 the"), (3, docs[3][1]), (3, docs[3][1]), (n + 2, "w5 " * 400_000), (n + 3, "long" * 100_000)]
    items = [(k, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 20])))) for k in range(15)] + [(99, None), (98, "!!"), (97, "absent"), (5, "w5 w5 w5"), (None, "w7")]
    return docs, items


def test_equals_plain_loop(spark, monkeypatch):
    docs, items = rows(1, 400)
    want = plain(docs, items)
    assert got(spark, docs, items) == want
    monkeypatch.setattr(block_max, "QUERY_PAIRS", 20)
    assert got(spark, docs, items, 1) == want
    assert got(spark, [], items) == [] == got(spark, docs, [])
    assert got(spark, [(1, None), (2, "?")], items) == []


def test_ties_and_equal_documents(spark):
    docs = [(k, "same words here") for k in range(30)] + [(None, "same words here")] + [(k, "other") for k in range(30, 90)]
    items = [(1, "same words")]
    assert got(spark, docs, items, 4) == plain(docs, items) and sorted(r[1:3] for r in plain(docs, items)) == [(k + 1, k) for k in range(10)]


def test_packed_integers_come_back():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2**31, 2**40, 5] * 50)
    data, size = block_max.pack(values)
    assert block_max.unpack(data).tolist() == values.tolist() and size.sum() == len(data)
    assert len(block_max.unpack(block_max.pack(np.empty(0, np.int64))[0])) == 0


def shard(docs):
    s = block_max._Shard()
    import pyarrow as pa

    for first, n, keys, row in block_max.terms(pa.array([t for _, t in docs])):
        s.open_docs([i for i, _ in docs[first : first + n]])
        s.add(keys, row)
    return s.rows(0)


def test_blocks_below_the_floor_stay_packed():
    rng = random.Random(2)
    docs = [(k, " ".join(["common"] * rng.randint(1, 3) + ["filler"] * rng.randint(5, 60) + (["rare"] * 4 if k % 400 == 7 else []))) for k in range(16_000)]
    batch = shard(docs)
    rare, common = (int(np.concatenate([k for _, _, k, _ in block_max.terms(__import__("pyarrow").array([t]))]).view(np.int64)[0]) for t in ("rare", "common"))
    queries = block_max._Queries({}, 16_000, int(batch.column("tokens")[0].as_py()), 10)
    docs_ = block_max._Documents(batch.column("payload")[0].as_buffer(), queries)
    lists = {}
    for r in range(1, batch.num_rows):
        v = [batch.column(c)[r] for c in ("firsts", "max_tf", "min_len", "ends", "payload", "n", "term")]
        lists[v[6].as_py()] = block_max._List(*(x.values.to_numpy() for x in v[:4]), v[4].as_buffer(), v[5].as_py(), docs_, queries)
    bounds = [(int(6000 * lists[rare].most.max()), rare, 6000), (int(5 * lists[common].most.max()), common, 5)]
    rest = np.array([bounds[0][0] + bounds[1][0], bounds[1][0], 0])
    queries.items[0] = ([rare, common], [6000, 5], rest)
    heaps = block_max.Heaps(10)
    block_max._search(docs_, lists, queries, heaps)
    got = [tuple(x) for x in heaps.best[0].tolist()]
    every = {}
    for t, w in ((rare, 6000), (common, 5)):
        for r, i in zip(*lists[t].all(), strict=True) if t == rare else []:
            every[int(r)] = every.get(int(r), 0) + w * int(i)
    opened = int(lists[common].known.sum())
    assert opened < len(lists[common].known) / 2  # the common term's list is not essential, most of its blocks are never unpacked
    for r, i in zip(*lists[common].all(), strict=True):
        every[int(r)] = every.get(int(r), 0) + 5 * int(i)
    assert got == [(s, 0, r) for s, r in sorted(((s, r) for r, s in every.items()), key=lambda x: (-x[0], x[1]))[:10]]
