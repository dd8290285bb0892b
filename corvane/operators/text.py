"""Text operators: keyword classification, noise lines, repeat suffixes, token estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The topic of what no phrase claims, and a bare option marker.
OTHER = "Other / General"
MARKER = r"^[A-Ea-e][.)]$"


def classify(text: Column, taxonomy: list[tuple[str, list[tuple[str, int]]]]) -> Column:
    """The topic whose contained phrases weigh most; the first declared wins ties, no phrase at all gives OTHER.

    One expression over the row, without a join: a taxonomy is a few topics. A null text is OTHER.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    scored = []
    for order, (topic, phrases) in enumerate(taxonomy):
        score = F.lit(0)
        for phrase, weight in phrases:
            score = score + F.when(low.contains(phrase.lower()), weight).otherwise(0)
        scored.append(F.struct(score.alias("score"), F.lit(-order).alias("order"), F.lit(topic).alias("topic")))
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] > 0, best["topic"]).otherwise(OTHER)


def content_lines(docs: DataFrame, id_col: str, text_col: str, boilerplate: list[str], marker: str = MARKER) -> DataFrame:
    """(id, line_no, line): trimmed lines of three characters or more that no boilerplate prefix opens; option markers stay."""
    lines = docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    noise = F.length("line") < 3
    for prefix in boilerplate:
        noise = noise | F.lower("line").startswith(prefix.lower())
    return lines.where(F.col("line").rlike(marker) | ~noise)


def repeat_suffix(n: Column) -> Column:
    """'' for the first occurrence, then b, c, ..., z, aa, ab, ..., zz, aaa, ... for the second and later ones."""

    def digit(state: Column, _: Column) -> Column:
        m = state["m"] - 1
        more = F.struct(F.floor(m / 26).cast("long").alias("m"), F.concat(F.chr(97 + m % 26), state["out"]).alias("out"))
        return F.when(state["m"] > 0, more).otherwise(state)

    # bijective base 26; 26^14 is above the largest long
    start = F.struct(n.cast("long").alias("m"), F.lit("").alias("out"))
    letters = F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, digit, lambda s: s["out"])
    return F.when(n <= 1, "").when(n > 1, letters)


def token_estimate(text: Column, assumed_output: int) -> Column:
    """A quarter of the characters, one at least, and the assumed output."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long") + assumed_output
