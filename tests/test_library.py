from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.operators import assessment, dedup, grading, items, text
from corvane.plans import assessment as assessment_queries
from corvane.plans import catalog, exam, feeds, overlay, reports, schedule, shape, sources

SF = "/root/testdata/sf0.001"
PLANS = (catalog, assessment_queries, overlay, exam, schedule, shape, reports, sources, feeds)
QUERIES = {name: query for plan in PLANS for name, query in plan.QUERIES.items()}
SQL = {name: sql for plan in PLANS for name, sql in plan.SQL.items()}


def shown(v):
    """A value with its type: null is not an empty text, a whole number not a fraction; fractions to six digits."""
    if isinstance(v, (list, tuple)):
        return [shown(x) for x in (v.asDict().values() if hasattr(v, "asDict") else v)]
    if isinstance(v, dict):
        return [shown(x) for x in v.values()]
    if isinstance(v, (float, Decimal)):
        return f"fraction {float(v):.6g}"
    return f"{type(v).__name__} {v}"


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(repr([shown(r[k]) for k in order]) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("lineitem", "orders", "part", "customer", "supplier", "nation", "region", "events", "documents", "benchmark", "labels", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())


def test_every_query_has_a_name_of_its_own():
    assert len(QUERIES) == sum(len(plan.QUERIES) for plan in PLANS) and set(QUERIES) - set(SQL) == {"c17_chunks"}


def test_suffixes(spark):
    got = spark.createDataFrame([(n,) for n in (1, 2, 9, 25, 26, 27, 52, 53)], "n int").select(text.repeat_suffix(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == ["", "b", "i", "y", "z", "aa", "az", "ba"]


def test_small_cases(spark):
    frame = spark.createDataFrame([(None, " b "), ("a b", "B. x"), ("", None)], "t string, k string")
    got = frame.select(F.size(dedup.word_shingles(F.col("t"))).alias("n"), grading.choice_points(F.lit("b"), F.col("k")).alias("p")).collect()
    assert [(r.n, r.p) for r in got] == [(0, 1), (2, 1), (0, 0)]


def test_chunks_equal_a_plain_loop(spark):
    def plain(text, most):
        out, cur = [], None
        for p in filter(None, (text or "").split("\n")):
            if cur is not None and len(cur) + 1 + len(p) <= most:
                cur += "\n" + p
            else:
                out, cur = (out if cur is None else [*out, cur]), p
        return out if cur is None else [*out, cur]

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a\n\nb\n" + "c" * 900)], "doc_id long, text string"))
    got = {}
    for r in items.greedy_chunks(docs, "doc_id", "text", "\n", 500).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {r.doc_id: c for r in docs.collect() if (c := plain(r.text, 500))}


def test_overlay_and_window_keep_nulls(spark):
    base, none = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([], "k int, v string")
    out = assessment.overlay_rows(base, "k", base.where("k = 1"), spark.createDataFrame([(2, "x"), (1, "y")], "k int, v string"))
    assert sorted(map(tuple, out.collect())) == [(1, "y"), (2, "b")]
    assert assessment.overlay_rows(none, "k", none, none).count() == 0
    credit = spark.sql("SELECT map('1', 'A', '2', 'B', '3', 'C') AS k, map('1', 'A', '2', 'C') AS p").select(assessment.matching_credit(F.col("k"), F.col("p"), 3.0)).first()[0]
    assert credit == 1.0
