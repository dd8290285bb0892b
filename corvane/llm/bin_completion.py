"""Packing by bin completion: fillings around the largest piece, branch and bound by waste, best-fit solutions as incumbents."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import by_bytes, shared_dir
from corvane.llm.packing import encoder

_PIECES = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, part int, at long"
#: A filling: ((length, copies), ...), longest first.
Filling = tuple[tuple[int, int], ...]


# --- the plan: how many sequences of which lengths ----------------------------------------------


def least_sequences(counts: dict[int, int], room: int) -> int:
    """No packing needs fewer (Martello and Toth's second bound): for every k, pieces longer than room - k can share with none of at least k."""
    n = np.zeros(room + 1, dtype=object)
    for length, c in counts.items():
        n[length] = c
    mass = n * np.arange(room + 1)
    best = -(-sum(mass) // room)
    ends_n, ends_m = np.cumsum(n), np.cumsum(mass)
    half = room // 2
    for k in range(1, half + 1):
        alone = ends_n[room] - ends_n[room - k]
        large, large_mass = ends_n[room - k] - ends_n[half], ends_m[room - k] - ends_m[half]
        small_mass = ends_m[half] - ends_m[k - 1]
        best = max(best, alone + large + max(0, -(-(small_mass - (large * room - large_mass)) // room)))
    return int(best)


def best_fit_decreasing(counts: dict[int, int], room: int) -> list[tuple[Filling, int]]:
    """Best fit, longest first, over equal sequences at once: (filling, times)."""
    open_: dict[int, list[list]] = defaultdict(list)  # free tokens -> [filling, times]
    free = 0  # bit r is set where open_[r] has sequences
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = free >> length
            if fits:
                r = length + (fits & -fits).bit_length() - 1
                filling, times = open_[r].pop()
                if not open_[r]:
                    free &= ~(1 << r)
            else:
                r, filling, times = room, (), -(-left // (room // length))
            copies = r // length
            full = min(times, left // copies)
            parts = [(copies, full)] + ([(left - full * copies, 1)] if full < times and left > full * copies else [])
            for k, m in parts:
                if m:
                    open_[r - k * length].append([(*filling, (length, k)), m])
                    free |= 1 << (r - k * length)
                    left -= k * m
                    times -= m
            if times and filling:
                open_[r].append([filling, times])
                free |= 1 << r
    return [(tuple(filling), times) for groups in open_.values() for filling, times in groups]


def _dominated(filling: list[int], slack: int, sizes: list[int], counts: dict[int, int]) -> bool:
    """Whether some longer piece that is left could stand for a part of the filling and still fit."""
    sums = {0: Counter()}
    for x in filling[:6]:  # sums of a few members find nearly all; the rest is only searched once more
        for total, used in list(sums.items()):
            if total + x not in sums:
                sums[total + x] = used + Counter([x])
    own = Counter(filling)
    for total, used in sums.items():
        if not total:
            continue
        least = total + 1 if sum(used.values()) == 1 else total
        for x in range(least, total + slack + 1):
            if counts.get(x, 0) > own[x] - used[x] and x != total or (x == total and sum(used.values()) > 1 and counts.get(x, 0) > own[x]):
                return True
    return False


def completions(room: int, sizes: list[int], counts: dict[int, int], width: int, steps: int) -> tuple[list[tuple[int, list[int]]], int]:
    """Up to width undominated fillings of room tokens, least waste first, as (waste, lengths), and the steps taken.

    Only fillings that nothing more fits into are met, longest pieces first; dominated ones go. steps bounds the search, not what is packed: a room whose fillings
    are too many gets the best of those met.
    """
    found: list[tuple[int, list[int]]] = []
    perfect, used = 0, 0
    def search(left: int, upto: int, chosen: list[int]) -> None:
        nonlocal perfect, used
        used += 1
        k = bisect.bisect_right(sizes, min(left, upto)) - 1
        fits = False
        while k >= 0 and perfect < width and used < steps:
            x = sizes[k]
            if counts[x] > (chosen.count(x) if chosen and chosen[-1] == x else 0):
                fits = True
                chosen.append(x)
                search(left - x, x, chosen)
                chosen.pop()
            k -= 1
        # a filling into which some piece fits, longer than the last or not, is dominated
        if not fits and (left == 0 or not any(counts[y] > chosen.count(y) for y in sizes[: bisect.bisect_right(sizes, left)])):
            found.append((left, list(chosen)))
            perfect += left == 0

    search(room, room, [])
    found.sort(key=lambda f: (f[0], len(f[1])))
    kept = []
    for waste, filling in found:
        if len(kept) == width:
            break
        if not filling or not _dominated(filling, waste, sizes, counts):
            kept.append((waste, filling))
    return kept or found[:1] or [(room, [])], used


def plan(counts: dict[int, int], room: int, width: int = 4, steps: int = 600, effort: int = 400_000) -> list[tuple[Filling, int]]:
    """(filling, times): a packing of counts[length] pieces of each length into sequences of room tokens, few of them.

    The best-fit packing is the first incumbent. Bin completion then takes the longest piece left and, of its undominated fillings, the least wasteful
    first, as often as the pieces last; a branch ends when it wastes more tokens than a packing better than the incumbent may, and the search when the lower bound
    is met. effort bounds its steps, so the plan is the same on every machine; beyond it the incumbent stands. Its size follows from room, not from the
    number of pieces.
    """
    counts = {k: int(v) for k, v in counts.items() if v}
    best = best_fit_decreasing(counts, room)
    mass = sum(k * v for k, v in counts.items())
    number = lambda fillings: sum(times for _, times in fillings)
    least, taken = least_sequences(counts, room), 0
    now, waste, trail = dict(counts), 0, []  # trail: [filling, times, waste, alternatives]

    def alternatives() -> list:
        nonlocal taken
        longest = max(now)
        now[longest] -= 1
        rest = {k: v for k, v in now.items() if v}
        options, used = completions(room - longest, sorted(rest), rest, width, steps)
        now[longest] += 1
        taken += used + 1
        return [(w, Counter([longest, *f])) for w, f in reversed(options)]

    def take(option) -> None:
        nonlocal waste
        w, pieces = option
        times = min(now[k] // c for k, c in pieces.items())
        for k, c in pieces.items():
            now[k] -= c * times
            if not now[k]:
                del now[k]
        waste += w * times
        trail[-1][:3] = [tuple(sorted(pieces.items(), reverse=True)), times, w]

    def undo() -> None:
        nonlocal waste
        filling, times, w = trail[-1][:3]
        for k, c in filling or ():
            now[k] = now.get(k, 0) + c * times
        waste -= w * times
        trail[-1][:3] = [None, 0, 0]

    may = lambda: (number(best) - 1) * room - mass
    while number(best) > least and taken < effort:
        if not now:
            if number(trail_ := [(f, t) for f, t, _, _ in trail]) < number(best):
                best = trail_
            dead = True
        else:
            dead = waste > may()
            if not dead:
                trail.append([None, 0, 0, alternatives()])
        if dead:
            undo()
        while trail and not trail[-1][3]:
            trail.pop()
            if trail:
                undo()
        if not trail:
            break
        take(trail[-1][3].pop())
    return best


# --- the pieces ---------------------------------------------------------------------------------


def _pieces(ranks_file: str, end_id: int, room: int, out_bytes: int = 8 << 20):
    end = np.array([end_id], dtype="<u4").tobytes()
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(ranks_file), TaskContext.get().partitionId()
        seen = np.zeros(room + 1, dtype=np.int64)
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            rows.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in _PIECES.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = (encode(text.as_py()).astype("<u4").tobytes() if text.is_valid else b"") + end
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    length = (n % room or room) if at == 0 else room
                    own = ids[4 * at : 4 * (at + length)]
                    rows.append((doc_id, piece, at, length, own, zlib.crc32(own), part, int(seen[length])))
                    seen[length] += 1
                    at, piece = at + length, piece + 1
                size += len(ids)
                if size >= out_bytes:
                    yield flush()
                    size = 0
        yield flush()

    return run


def pack_few(docs: DataFrame, ranks_file: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids (unsigned 32-bit, little-endian), ids_crc32, sequence_id, offset.

    A document's ids are those of its text and then end_id. Only a longer document is cut, into pieces of max_tokens, of which the first may be
    shorter. Which lengths share a sequence is planned on the counts of the lengths alone, of which there are max_tokens at most, whatever the
    number of documents; a piece then finds its place by its length and its rank among pieces of that length. Ranks come from counts by task: no sort,
    and no task sees more than its own pieces. A null or empty text is its end_id alone; repeated rows are packed each; null ids stay null; other columns are ignored; an
    empty table has no pieces. Runs jobs when called: the pieces are a table in the shared folder, which the result reads.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    path = shared_dir(spark, "pieces")
    by_bytes(rows).mapInArrow(_pieces(ranks_file, end_id, max_tokens), _PIECES).write.option("compression", "zstd").parquet(path)
    pieces = spark.read.schema(_PIECES).parquet(path)
    held = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    slots: dict[int, list[tuple]] = defaultdict(list)
    taken: Counter = Counter()
    sequence = 0
    for filling, times in plan(counts, max_tokens):
        offset = 0
        for length, copies in filling:
            slots[length].append((taken[length], sequence, copies, offset))
            taken[length] += copies * times
            offset += copies * length
        sequence += times
    places = spark.createDataFrame(list(slots.items()), "length long, slots array<struct<since: long, sequence: long, copies: long, offset: long>>")

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # a row of before has the pieces of one length in one task
    ranked = pieces.join(before, ["part", "length"]).join(F.broadcast(places), "length").withColumn("rank", F.col("at") + F.col("before"))
    slot = F.element_at(F.filter("slots", lambda s: s["since"] <= F.col("rank")), -1)
    ranked = ranked.withColumn("slot", slot).withColumn("k", F.col("rank") - F.col("slot.since"))
    return ranked.select(
        F.col("doc_id").alias(id_col), "piece", "start", "length", "ids", "ids_crc32", (F.col("slot.sequence") + F.floor(F.col("k") / F.col("slot.copies"))).alias("sequence_id"),
        (F.col("slot.offset") + F.col("k") % F.col("slot.copies") * F.col("length")).alias("offset"),
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids: the whole sequences for training, max_tokens at most each."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(held.alias("held")).select("sequence_id", F.aggregate("held", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
