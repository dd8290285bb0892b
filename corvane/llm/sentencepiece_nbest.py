"""N-best segmentation: forward Viterbi scores are exact heuristics of a backward A* search over the piece lattice."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import by_bytes

SPACE = "▁"
#: Bytes that a worker keeps of segmented units; beyond them it starts anew.
CACHE_BYTES = 160 << 20
#: Units of at most so many characters are searched side by side in arrays, longer ones alone with a heap.
SIDE_BY_SIDE = 32
#: Text, in characters, that is segmented at once.
SLICE_CHARS = 1 << 19
_CHAR = 21  # bits of a code point
_BYTES = -2  # the edge of a character without a piece of its own
_SLOT_BITS = 20


def _cells(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, end to end."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


class Lattice:
    """The pieces of a model file as a trie in arrays. A character that no piece covers becomes its byte pieces."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal = [k for k in range(len(sp)) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
        self.bytes = {int(sp.id_to_piece(k)[1:-1], 16): k for k in range(len(sp)) if sp.is_byte(k)}
        self.unknown = sp.unk_id()
        pieces = {sp.id_to_piece(k): (k, sp.get_score(k)) for k in normal}
        #: Pieces never run from a word into the next space, so spaces after other characters are cuts of the lattice.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.longest = max(map(len, pieces), default=1)
        self.least = min((s for _, s in pieces.values()), default=0.0) - 10
        self.steps: dict[int, int] = {}
        ids, scores = [-1], [0.0]
        for piece, (k, score) in pieces.items():
            node = 0
            for c in piece:
                key = node << _CHAR | ord(c)
                if (after := self.steps.get(key)) is None:
                    after = self.steps[key] = len(ids)
                    ids.append(-1)
                    scores.append(0.0)
                node = after
            ids[node], scores[node] = k, score
        self.ids, self.scores = np.array(ids, np.int32), np.array(scores)
        self.keys = np.array(sorted(self.steps), np.int64)
        self.after = np.array([self.steps[k] for k in self.keys.tolist()], np.int32)
        # where a step's key is found: its own slot, or in a slot that several keys share among all keys
        slots = self._slot(self.keys)
        self.slot_at = np.zeros(1 << _SLOT_BITS, np.int32)
        self.slot_at[slots] = np.arange(len(slots))
        self.shared = np.bincount(slots, minlength=1 << _SLOT_BITS) > 1
        # what a piece stands for in a text, all pieces end to end
        spoken = [self._spoken(k) for k in range(len(sp))]
        self.spoken = np.frombuffer(b"".join(spoken), np.uint8)
        self.spoken_bounds = np.concatenate(([0], np.cumsum([len(x) for x in spoken])))
        self.dummy_prefix = sp.encode("a", out_type=str)[0].startswith(SPACE)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _steps_many(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among self.keys, -1 where it is none."""
        slots = self._slot(keys)
        at = self.slot_at[slots]
        off = np.flatnonzero(self.shared[slots])
        if len(off):
            at[off] = np.minimum(np.searchsorted(self.keys, keys[off]), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def _spoken(self, k: int) -> bytes:
        sp = self.processor
        if sp.is_byte(k):
            return bytes([int(sp.id_to_piece(k)[1:-1], 16)])
        if sp.is_unknown(k):
            return " ⁇ ".encode()
        return b"" if sp.is_control(k) else sp.id_to_piece(k).replace(SPACE, " ").encode()

    def text(self, ids: np.ndarray) -> str:
        """The text of ids: their pieces end to end without the space that encoding puts in front; bytes that are no UTF-8 become U+FFFD."""
        begin = self.spoken_bounds[ids]
        length = self.spoken_bounds[ids + 1] - begin
        data = self.spoken[_cells(begin, length)].tobytes()
        return (data[1:] if self.dummy_prefix and data.startswith(b" ") else data).decode("utf-8", "replace")

    def units(self, text: str) -> list[str]:
        """The parts of a normalised text between cuts, in order."""
        if not self.cuts:
            return [text] if text else []
        first, *words = text.split(SPACE)
        if all(words):
            return ([first] if first else []) + [SPACE + w for w in words]
        out, spaces = [first] if first else [], ""
        for w in words:
            spaces += SPACE
            if w:
                out.append(spaces + w)
                spaces = ""
        return [*out, spaces] if spaces else out

    def spelled(self, char: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def edges(self, unit: str) -> list[list[tuple[int, int, float]]]:
        """For each end, the (start, id, score) of the pieces that end there; the id _BYTES stands for a character's bytes."""
        into: list[list] = [[] for _ in range(len(unit) + 1)]
        for start in range(len(unit)):
            node, own = 0, False
            for end in range(start + 1, len(unit) + 1):
                if (node := self.steps.get(node << _CHAR | ord(unit[end - 1]), -1)) < 0:
                    break
                if self.ids[node] >= 0:
                    into[end].append((start, int(self.ids[node]), float(self.scores[node])))
                    own = own or end == start + 1
            if not own:
                into[start + 1].append((start, _BYTES, self.least))
        return into

    def nbest(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of one unit, best first.

        No place of the lattice is expanded more than n times, as only the n best ways from it to the end can count;
        among equal totals the place nearest the start goes first, so ties are not searched breadth first.
        """
        into = self.edges(unit)
        forward = [0.0] + [-np.inf] * len(unit)
        for end in range(1, len(unit) + 1):
            forward[end] = max((forward[start] + score for start, _, score in into[end]), default=-np.inf)
        # (-(score behind + best score ahead), place, order, score behind, pieces behind as linked cells)
        heap: list = [(-forward[-1], len(unit), 0, 0.0, None)]
        order, out, seen = 1, [], [0] * (len(unit) + 1)
        while heap and len(out) < n:
            _, at, _, behind, cell = heapq.heappop(heap)
            seen[at] += 1
            if seen[at] > n:
                continue
            if at == 0:
                ids: list[int] = []
                place = 0
                while cell is not None:
                    piece, width, cell = cell
                    ids.extend(self.spelled(unit[place]) if piece == _BYTES else (piece,))
                    place += width
                out.append((behind, ids))
                continue
            for start, piece, score in into[at]:
                heapq.heappush(heap, (-(behind + score + forward[start]), start, order, behind + score, (piece, at - start, cell)))
                order += 1
        return out

    def nbest_many(self, units: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores [unit, n] with -inf where fewer exist, ids of segmentation unit * n + rank end to end, their bounds)."""
        size = len(units)
        length = np.fromiter(map(len, units), np.int64, size)
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begins = np.cumsum(length) - length
        scores = np.full((size, n), -np.inf)
        owner, rank, flat = [], [], []
        order = np.argsort(length, kind="stable")
        short = order[length[order] <= SIDE_BY_SIDE]
        for at in range(0, len(short), 8192):
            rows = short[at : at + 8192]
            width = int(length[rows[-1]])
            cells = begins[rows][:, None] + np.arange(width)
            inside = np.arange(width) < length[rows][:, None]
            text = np.where(inside, chars[np.minimum(cells, len(chars) - 1)], 0)
            got, who, nth, ids = self._search(text, length[rows], n)
            scores[rows] = got
            owner.append(rows[who])
            rank.append(nth)
            flat.append(ids)
        for row in order[length[order] > SIDE_BY_SIDE].tolist():
            for k, (score, ids) in enumerate(self.nbest(units[row], n)):
                scores[row, k] = score
                owner.append(np.full(len(ids), row))
                rank.append(np.full(len(ids), k))
                flat.append(np.array(ids, np.int32))
        segment = np.concatenate([np.zeros(0, np.int64), *(o * n + r for o, r in zip(owner, rank, strict=True))])
        ids = np.concatenate([np.zeros(0, np.int32), *flat])
        ids = ids[np.argsort(segment, kind="stable")]
        return scores, ids, np.concatenate(([0], np.cumsum(np.bincount(segment, minlength=size * n))))

    def _edges_many(self, text: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """(bounds, units, starts, ids, scores) of all edges, in order of end and unit: those of an end and unit are at bounds[end * units + unit].

        The trie is walked from all starts of all units at once.
        """
        units, width = text.shape
        begin_row, begin = np.nonzero(np.arange(width) < length[:, None])
        bare = np.ones((units, width), dtype=bool)
        row, start, node = begin_row, begin, np.zeros(len(begin_row), np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        for k in range(min(self.longest, width)):
            if k:
                on = start + k < length[row]
                row, start, node = row[on], start[on], node[on]
            key = node << _CHAR | text[row, start + k]
            at = self._steps_many(key)
            on = at >= 0
            row, start, node = row[on], start[on], self.after[at[on]].astype(np.int64)
            done = self.ids[node] >= 0
            found.append((row[done], start[done], start[done] + k + 1, self.ids[node[done]], self.scores[node[done]]))
            if not k:
                bare[row[done], start[done]] = False
            if not len(row):
                break
        alone = bare[begin_row, begin]
        row, start = begin_row[alone], begin[alone]
        found.append((row, start, start + 1, np.full(len(row), _BYTES, np.int32), np.full(len(row), self.least)))
        row, start, end, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        key = end * units + row
        order = np.argsort(key, kind="stable")
        bounds = np.concatenate(([0], np.cumsum(np.bincount(key, minlength=(width + 1) * units))))
        return bounds, row[order], start[order], ids[order], scores[order]

    def _search(self, text: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """nbest for many short units side by side: (scores, and unit, rank and id of every piece in order)."""
        units, width = text.shape
        bounds, row_of, start_of, id_of, score_of = self._edges_many(text, length)
        forward = np.full((units, width + 1), -np.inf)
        forward[:, 0] = 0
        for end in range(1, width + 1):
            a, b = bounds[end * units], bounds[(end + 1) * units]
            if a < b:
                rows = row_of[a:b]
                firsts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                forward[rows[firsts], end] = np.maximum.reduceat(forward[rows, start_of[a:b]] + score_of[a:b], firsts)
        every = np.arange(units)
        room = 32
        total = np.full((units, room), -np.inf)  # of an entry that is still open: its score behind and the best ahead
        place = np.zeros((units, room), np.int16)
        via, before = (np.zeros((units, room), np.int32) for _ in range(2))
        behind = np.zeros((units, room))
        total[:, 0], place[:, 0], before[:, 0] = forward[every, length], length, -1
        used = np.ones(units, np.int64)
        seen = np.zeros((units, width + 1), np.int16)
        scores, ends, found = np.full((units, n), -np.inf), np.full((units, n), -1), np.zeros(units, np.int64)
        scores[length == 0, 0] = 0.0
        live = every[length > 0]
        while len(live):
            high = int(used[live].max())
            open_ = total[live, :high]
            best = open_.max(axis=1)
            if best.min() == -np.inf:
                live, open_, best = (x[best > -np.inf] for x in (live, open_, best))
            # the nearest to the start among equal totals, then the earliest entry
            pick = np.where(open_ == best[:, None], place[live, :high], np.int16(width + 1)).argmin(axis=1) if len(live) else live
            total[live, pick] = -np.inf
            at = place[live, pick].astype(np.int64)
            seen[live, at] += 1
            fresh = seen[live, at] <= n
            done = fresh & (at == 0)
            if done.any():
                rows, entry = live[done], pick[done]
                scores[rows, found[rows]], ends[rows, found[rows]] = behind[rows, entry], entry
                found[rows] += 1
            on = fresh & (at > 0)
            rows, entry, at = live[on], pick[on], at[on]
            key = at * units + rows
            begin, degree = bounds[key], bounds[key + 1] - bounds[key]
            if len(rows) and int((used[rows] + degree).max()) > room:
                total = np.hstack([total, np.full((units, room), -np.inf)])
                behind = np.hstack([behind, np.zeros((units, room))])
                via, place, before = (np.hstack([x, np.zeros((units, room), x.dtype)]) for x in (via, place, before))
                room *= 2
            # what each open end leads to; one flat number tells an entry's cell in all arrays
            first = np.cumsum(degree) - degree
            nth = np.arange(int(degree.sum())) - np.repeat(first, degree)
            edge = np.repeat(begin, degree) + nth
            cell = np.repeat(rows * room + used[rows], degree) + nth
            s = start_of.take(edge)
            own = np.repeat(behind.ravel().take(rows * room + entry), degree) + score_of.take(edge)
            behind.ravel()[cell] = own
            total.ravel()[cell] = own + forward.ravel().take(np.repeat(rows * (width + 1), degree) + s)
            place.ravel()[cell] = s
            via.ravel()[cell] = edge
            before.ravel()[cell] = np.repeat(entry, degree)
            used[rows] += degree
            live = live[found[live] < n] if done.any() else live
        # from the start to the end along the entries; every entry knows the edge that follows its place
        who, nth = np.nonzero(ends >= 0)
        entry = ends[who, nth]
        owner, rank, ids = [], [], []
        while len(who):
            follows = before[who, entry]
            on = follows >= 0
            who, nth, edge, entry = who[on], nth[on], via[who[on], entry[on]], follows[on].astype(np.int64)
            owner.append(who)
            rank.append(nth)
            found_ids = id_of[edge].astype(np.int64)
            bare = found_ids == _BYTES
            found_ids[bare] = -2 - text[who[bare], start_of[edge[bare]]]
            ids.append(found_ids)
        if not owner:
            return scores, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        who, nth, flat = (np.concatenate(x) for x in (owner, rank, ids))
        # steps of a segmentation come in order already
        order = np.argsort(who * n + nth, kind="stable")
        who, nth, flat = who[order], nth[order], flat[order]
        bare = np.flatnonzero(flat < 0)
        if len(bare):
            spelled = {c: self.spelled(chr(-2 - c)) for c in set(flat[bare].tolist())}
            times = np.ones(len(flat), np.int64)
            times[bare] = [len(spelled[c]) for c in flat[bare].tolist()]
            goes = np.cumsum(times) - times
            who, nth, full = np.repeat(who, times), np.repeat(nth, times), np.repeat(flat, times)
            for k in bare.tolist():
                full[goes[k] : goes[k] + times[k]] = spelled[int(flat[k])]
            flat = full
        return scores, who, nth, flat.astype(np.int32)


class Units:
    """Segmented units of one worker, in arrays: their scores, and the ids of all their segmentations end to end."""

    def __init__(self, own: Lattice, n: int):
        self.own, self.n = own, n
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.scores, self.ids, self.bounds = np.zeros((0, self.n)), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.held = 0

    def add(self, units: list[str]) -> np.ndarray:
        """The numbers of units; those not known are segmented. What a worker holds stays within CACHE_BYTES and this call's units."""
        if self.held > CACHE_BYTES:
            self.clear()
        numbers = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(numbers < 0).tolist()
        if missing:
            new = list(dict.fromkeys(units[k] for k in missing))
            scores, ids, bounds = self.own.nbest_many(new, self.n)
            at = len(self.scores)
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
            self.bounds = np.concatenate((self.bounds, bounds[1:] + len(self.ids)))
            self.ids, self.scores = np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
            self.held += ids.nbytes + scores.nbytes + bounds.nbytes + sum(map(len, new)) + 150 * len(new)
            numbers[missing] = [self.known[units[k]] for k in missing]
        return numbers

    def of_text(self, at: np.ndarray) -> list[tuple[float, np.ndarray]]:
        """The n best (score, ids) of a text whose units are numbered at, from those of its units.

        Only the n - 1 units with the cheapest second choice can differ from their best within the n best of the text.
        """
        n = self.n
        choices = self.scores[at]
        best = float(choices[:, 0].sum())
        plans: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        if n > 1 and len(at):
            cost = choices[:, 0] - choices[:, 1]
            worst = np.partition(cost, n - 2)[n - 2] if len(cost) >= n else np.inf
            near = np.concatenate((np.flatnonzero(cost < worst), np.flatnonzero(cost == worst)))[: n - 1]
            for k in sorted(near.tolist()):
                costs = [float(choices[k, 0] - s) for s in choices[k] if s > -np.inf]
                plans = heapq.nsmallest(n, ((c + own, (*p, (k, j)) if j else p) for c, p in plans for j, own in enumerate(costs)))
        segment = at * n
        begin = self.bounds[segment]
        length = self.bounds[segment + 1] - begin
        first = self.ids[_cells(begin, length)].astype("<i4")
        ends = np.cumsum(length)
        out = []
        for cost, plan in plans:
            # another plan is the first one with a few units' pieces exchanged
            parts, upto = [], 0
            for k, j in sorted(plan):
                other = segment[k] + j
                parts += [first[upto : ends[k] - length[k]], self.ids[self.bounds[other] : self.bounds[other + 1]].astype("<i4")]
                upto = ends[k]
            out.append((best - cost, np.concatenate([*parts, first[upto:]]) if parts else first))
        return out


@cache
def lattice(model_file: str) -> Lattice:
    return Lattice(model_file)


@cache
def _units(model_file: str, n: int) -> Units:
    return Units(lattice(model_file), n)


def encode_texts(model_file: str, texts: list[str], n: int) -> Iterator[list[tuple[float, np.ndarray]]]:
    """For each text the n best (score, ids); texts are taken together up to SLICE_CHARS characters."""
    cache_, first = _units(model_file, n), 0
    own = cache_.own
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= SLICE_CHARS):
            size += len(texts[last])
            last += 1
        parts = [own.units(own.processor.normalize(t)) for t in texts[first:last]]
        every = [u for p in parts for u in p]
        numbers = cache_.add(every)
        at = 0
        for p in parts:
            yield cache_.of_text(numbers[at : at + len(p)])
            at += len(p)
        first = last


def encode_nbest(docs: DataFrame, model_file: str, n: int = 3, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id_col, rank (1 is best), score, n_pieces, ids (binary, little-endian 32-bit) of the n best segmentations of every whole text;
    with decoded also the text that these ids give back.

    Fewer rows come where fewer segmentations exist; null and empty texts have one, without pieces. An empty table gives no rows.
    Repeated rows are encoded each; other columns are ignored; nothing is shuffled. A segmentation's score is the sum of its
    pieces' scores in the model file; characters without a piece become byte pieces at a score below every piece's. Which of several
    segmentations of equal score come within the n best follows from the text alone.
    """
    kinds = [("i", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()), ("n_pieces", pa.int64()), ("ids", pa.binary())]
    kinds += [("decoded", pa.string())] if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = lattice(model_file)

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], names=[k for k, _ in kinds])

        cols: list[list] = [[] for _ in kinds]
        size = 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for i, found in zip(part.column(0).to_pylist(), encode_texts(model_file, texts, n), strict=True):
                    for rank, (score, ids) in enumerate(found, 1):
                        row = (i, rank, score, len(ids), ids.tobytes(), *([back.text(ids)] if decoded else []))
                        for col, value in zip(cols, row, strict=True):
                            col.append(value)
                        size += 2 * ids.nbytes
                    if size > 4 << 20:
                        yield flush()
                        cols, size = [[] for _ in kinds], 0
        yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    schema = "i long, rank int, score double, n_pieces long, ids binary" + (", decoded string" if decoded else "")
    return by_bytes(rows).mapInArrow(run, schema).withColumnRenamed("i", id_col)


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded: the text of ids_col. Null ids decode to null, no ids to the empty text.

    Other columns pass through, a column named decoded is replaced; an empty table stays empty.
    """
    encoded = encoded.drop("decoded")
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model_file)
        for batch in batches:
            texts = [own.text(np.frombuffer(x.as_buffer(), dtype="<i4")) if x.is_valid else None for x in batch.column(at)]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return by_bytes(encoded).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded string")
