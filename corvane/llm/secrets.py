"""Secret scans over a trigram inverted index: Boolean trigram queries pick candidates, the regex verifies them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from re import _constants as op  # the standard library's own regex parser
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import _LOWER, by_bytes, text_slices

#: Fixed values: (kind, pattern, group whose length counts, its least length). Base kinds come first.
BASE_RULES = (
    ("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: Published formats of credentials.
MORE_RULES = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0),
)
RULES = BASE_RULES + MORE_RULES
MOST_EXACT = 24

Query = tuple  # ("any",) | ("gram", bytes) | ("and", *queries) | ("or", *queries)
ANY: Query = ("any",)


def _all(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p != ANY))
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _either(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return ANY if ANY in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> Query:
    """What a text has that holds one of the strings."""
    alternatives = []
    for s in sorted(strings):
        raw = s.encode().translate(_LOWER)
        alternatives.append(_all([("gram", raw[i : i + 3]) for i in range(len(raw) - 2)]))
    return _either(alternatives)


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """(all strings that match, if few; what must hold of any text that matches)."""
    exact: set[str] | None = {""}
    open_run: set[str] = {""}
    musts: list[Query] = []

    def close() -> None:
        nonlocal open_run
        musts.append(_of_strings(open_run))
        open_run = {""}

    for kind, value in nodes:
        strings, query = _node(kind, value)
        exact = {a + b for a in exact for b in strings} if exact is not None and strings is not None and len(exact) * len(strings) <= MOST_EXACT else None
        if strings is not None:
            if len(open_run) * len(strings) > MOST_EXACT:
                close()
            open_run = {a + b for a in open_run for b in strings}
        else:
            close()
            musts.append(query)
    close()
    return exact, _all(musts)


def _node(kind, value) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        return {chr(value)}, ANY
    if kind is op.IN:
        if all(k is op.LITERAL for k, _ in value) and len(value) <= 6:
            return {chr(v) for _, v in value}, ANY
        return None, ANY
    if kind is op.SUBPATTERN:
        # beyond ASCII, letters have cases that the index does not fold, such as the long s
        return (None, ANY) if _folds_beyond_ascii(value[1]) else _walk(value[3])
    if kind is op.BRANCH:
        found = [_walk(x) for x in value[1]]
        if all(s is not None for s, _ in found) and len(union := set().union(*(s for s, _ in found))) <= MOST_EXACT:
            return union, ANY
        return None, _either([q for _, q in found])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        strings, query = _walk(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ANY
        if low == high == 1:
            return strings, query
        if low >= 1:
            return None, _all([query, _of_strings(strings)] if strings is not None else [query])
        return None, ANY
    if kind is op.AT:
        return {""}, ANY
    return None, ANY


def _folds_beyond_ascii(flags: int) -> bool:
    return bool(flags & re.IGNORECASE) and not flags & re.ASCII


def trigram_query(pattern: str) -> Query:
    """A Boolean query over lower-cased UTF-8 trigrams that holds of every text in which the pattern matches."""
    parsed = parser.parse(pattern)
    return ANY if _folds_beyond_ascii(parsed.state.flags) else _walk(parsed)[1]


def grams_of(query: Query) -> set[bytes]:
    return {query[1]} if query[0] == "gram" else set().union(*(grams_of(q) for q in query[1:])) if query[0] in ("and", "or") else set()


class Index:
    """Postings, as bit rows over a shard's documents, of the trigrams that the rules ask for."""

    def __init__(self, rules: tuple = RULES):
        self.rules = [(kind, re.compile(pattern), group, least, trigram_query(pattern)) for kind, pattern, group, least in rules]
        self.grams = {g: k + 1 for k, g in enumerate(sorted(set().union(*(grams_of(r[4]) for r in self.rules))))}
        self.lookup = np.zeros(1 << 24, dtype=np.uint8 if len(self.grams) < 256 else np.uint16)
        for g, k in self.grams.items():
            self.lookup[int.from_bytes(g, "big")] = k

    def postings(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        rows = np.zeros((len(self.grams) + 1, len(offsets) - 1), dtype=bool)
        raw = np.frombuffer(data.translate(_LOWER), dtype=np.uint8)
        if len(raw) < 3:
            return rows
        code = raw[:-2].astype(np.uint32) << 8
        code |= raw[1:-1]
        code <<= 8
        code |= raw[2:]
        gram = self.lookup[code]
        at = np.flatnonzero(gram)
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 2 < offsets[doc + 1]
        rows[gram[at[inside]], doc[inside]] = True
        return rows

    def candidates(self, query: Query, rows: np.ndarray) -> np.ndarray:
        if query[0] == "gram":
            return rows[self.grams[query[1]]]
        if query[0] == "any":
            return np.ones(rows.shape[1], dtype=bool)
        parts = [self.candidates(q, rows) for q in query[1:]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)

    def scan(self, data: bytes, offsets: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
        rows = self.postings(data, offsets)
        found: dict[int, list[tuple[int, int, int]]] = {}
        text: dict[int, str] = {}
        for k, (_, pattern, group, least, query) in enumerate(self.rules):
            for d in np.flatnonzero(self.candidates(query, rows)):
                d = int(d)
                if d not in text:
                    text[d] = data[offsets[d] : offsets[d + 1]].decode("utf-8", "replace")
                for m in pattern.finditer(text[d]):
                    if m.end(group) - m.start(group) >= least:
                        found.setdefault(d, []).append((m.start(), k, m.end()))
        return {d: [(self.rules[k][0], a, b) for a, k, b in sorted(spans)] for d, spans in found.items()}


@cache
def _index(rules: tuple) -> Index:
    return Index(rules)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(rules: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(rules)
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(1)):
                n = len(offsets) - 1
                found = index.scan(data, offsets)
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in found.get(d, ())] for d in range(n)]
                yield pa.record_batch([batch.column(0).slice(first, n), pa.array(spans, _SPANS)], names=["doc_id", "spans"])

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """id_col and spans: an array of (kind, start, end) by start, then the rules' order; code points, end exclusive.

    The index is built by shards of about a megabyte of whole texts inside the tasks, so nothing is shuffled and a
    lost executor costs its shards only. A rule whose regex has no mandatory trigram, such as a bare run of hex digits,
    reads every document. Null and empty texts have no spans, repeated rows are scanned each, other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = by_bytes(rows).mapInArrow(_scan(rules), "doc_id long, spans array<struct<kind:string,start:int,end:int>>")
    return out.withColumnRenamed("doc_id", id_col)


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """docs with each secret in text_col replaced by [kind]; overlapping spans become one. Other columns stay as they are."""
    kinds = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(rules)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for first, data, offsets in text_slices(batch.column(at)):
                for d, spans in index.scan(data, offsets).items():
                    texts[first + d] = masked(texts[first + d], spans)
            yield pa.record_batch([pa.array(texts, batch.schema.field(k).type) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return by_bytes(docs).mapInArrow(run, kinds)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])
