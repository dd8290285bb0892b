from pyspark.sql import functions as F

from corvane.operators import text


def section_suffix(n):
    out = ""
    while n > 0:
        n -= 1
        out = chr(97 + n % 26) + out
        n //= 26
    return out


def test_suffixes_of_any_length(spark):
    ns = [1, 2, 26, 27, 702, 703, 7358, 18278, 18279, 20_000, 2**31 - 1]
    got = spark.createDataFrame([(n,) for n in ns], "n int").select("n", text.repeat_suffix(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == {n: "" if n == 1 else section_suffix(n) for n in ns}
    assert {r.n: r.s for r in got}[703] == "aaa"
    many = spark.range(2, 20_001).select(text.repeat_suffix(F.col("id")).alias("s"))
    assert many.distinct().count() == 19_999 and many.where("s is null or not s rlike '^[a-z]+$'").count() == 0
