"""op13: the plan against the optimum of small cases, the query's contract against a plain loop over odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from corvane.llm import bin_completion, queries
from corvane.llm.common import shared_dir

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def optimum(items, room):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        tried = set()
        for j, free in enumerate(bins):
            if free >= items[i] and free not in tried:
                tried.add(free)
                bins[j] -= items[i]
                place(i + 1, bins)
                bins[j] += items[i]
        place(i + 1, [*bins, room - items[i]])

    place(0, [])
    return best[0]


def test_plan_is_least_where_that_is_known():
    rng, better = random.Random(3), 0
    for _ in range(400):
        room = rng.choice([10, 20, 50, 100])
        counts = Counter(rng.randint(max(1, room // 6), room) for _ in range(rng.randint(1, 12)))
        for packed in (bin_completion.best_fit_decreasing(counts, room), got := bin_completion.plan(counts, room)):
            held = Counter()
            for filling, times in packed:
                assert sum(x * c for x, c in filling) <= room
                for x, c in filling:
                    held[x] += c * times
            assert held == counts
        number = sum(t for _, t in got)
        assert bin_completion.least_sequences(counts, room) <= number == optimum(list(counts.elements()), room)
        better += number < sum(t for _, t in bin_completion.best_fit_decreasing(counts, room))
    assert better > 0
    assert bin_completion.plan({}, 10) == [] and bin_completion.least_sequences({}, 10) == 0


def test_plan_improves_on_best_fit_and_repeats_fillings():
    counts = {12: 2000, 3: 1000, 13: 1000, 8: 2000, 4: 1000, 7: 1000}
    packed = bin_completion.plan(counts, 20)
    assert sum(t for _, t in packed) == 3350 == bin_completion.least_sequences(counts, 20) < sum(t for _, t in bin_completion.best_fit_decreasing(counts, 20)) and len(packed) < 10


def test_query(spark):
    base = shared_dir(spark, "op13")
    odd = [(10_000, None), (10_001, ""), (None, "no id"), (10_003, "word " * 9_000), (10_003, "word " * 9_000), (10_004, "a <|endoftext|> b")]
    more = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"lang": F.lit("x"), "source": F.lit("x"), "n_chars": F.lit(1).cast("long")})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(more).withColumns({"length": F.lit(7), "part": F.lit("p"), "slots": F.lit(0), "k": F.lit(1)})
    docs.repartition(5).write.parquet(f"{base}/documents.parquet")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.collect():
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 0]
        at = 0
        for piece in range(-(-len(ids) // 2048)):
            end = at + ((len(ids) % 2048 or 2048) if not piece else 2048)
            want[(r.doc_id, piece, at, end - at, zlib.crc32(np.array(ids[at:end], "<u4").tobytes()))] += 1
            at = end
    rows = queries.op13_bin_completion(spark, base).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = Counter(r.length for r in rows)
    assert bin_completion.least_sequences(lengths, 2048) == len(held) == -(-sum(k * n for k, n in lengths.items()) // 2048)


def test_sequences_hold_the_ids_and_empty_tables_none(spark):
    docs = spark.createDataFrame([(k, "lorem ipsum " * (50 * k)) for k in range(20)], "doc_id long, text string")
    pieces = bin_completion.pack_few(docs, RANKS, max_tokens=256)
    whole = {r.sequence_id: r.ids for r in bin_completion.sequences(pieces).collect()}
    for r in pieces.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) and zlib.crc32(bytes(r.ids)) == r.ids_crc32
    assert max(map(len, whole.values())) <= 1024
    assert bin_completion.pack_few(docs.where("false"), RANKS).count() == 0
