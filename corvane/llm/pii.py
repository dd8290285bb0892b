"""Personal data by candidate gradient boosting, in SQL functions: generators propose, boosted trees and thresholds select."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import materialize

BASE_KINDS = ("email", "ip", "card", "phone")
#: Fixed values. Possessive runs and the look-behinds only keep long runs linear: no match begins or ends elsewhere.
BASE_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])(?=(?:[0-9][ -]?){12}[0-9])[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Wide generators of further spans, whose proposals the boosted trees accept or refuse.
MORE_PATTERNS = {
    "email_spelled": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "phone_local": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
}
PATTERNS = BASE_PATTERNS | MORE_PATTERNS
#: What any match of a pattern holds and a plain search finds: texts without it are not scanned further.
GATES = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike("[0-9]\\.[0-9]"),
    "card": lambda t: t.rlike("[0-9]"),
    "phone": lambda t: t.rlike("\\+[0-9]"),
    "email_spelled": lambda t: t.contains("at]") | t.contains("at)"),
    "phone_local": lambda t: t.rlike("[0-9]{3}"),
    "national_id": lambda t: t.rlike("[0-9]-[0-9]"),
    "iban": lambda t: t.rlike("[A-Z][0-9][0-9]"),
}
#: Words that go before personal data.
CUES = r"(?i)(?:mail|tel|phone|call|fax|mobile|card|visa|iban|account|ssn|contact|reach|address|host|server|login)[^0-9A-Za-z]{0,3}(?:[a-z]{1,8}[^0-9A-Za-z]{1,3}){0,2}$"
#: Words that go before numbers that are no personal data.
ANTI_CUES = r"(?i)(?:order|part|serial|version|page|lot|build|item|invoice|score|total|batch|section|figure|table|no|nr|id)[^0-9A-Za-z]{0,3}(?:[a-z]{1,8}[^0-9A-Za-z]{0,2}){0,1}$"
#: Upper ends of the bins of each feature; a value above all of them is in the last bin.
BINS = {"digits": (0, 8, 12, 15, 19), "letters": (0, 3, 12), "marks": (0, 2, 5), "distinct": (1, 3, 6), "before": (0, 1), "cue": (0,), "anti": (0,)}
#: What planted examples are made of. {1} to {4} are digits from a hash, a, b, c stand for words.
PLANTED = {
    "email_spelled": ("abc [at] cab [dot] com", "b.a (at) abc (dot) org", "cab [at] b.net"),
    "phone_local": ("({1}) {2}-{4}", "{1}-{2}-{4}", "{1}.{2}.{4}"),
    "national_id": ("{1}-{3}-{4}",),
    "iban": ("DE{3} {4} {4} {4} {4} {3}", "FR{3}{4}{4}{4}{4}{4}"),
}
#: What goes before planted personal data, and before look-alikes of the same forms.
PLANTED_CUES = ("call me at ", "phone: ", "my mobile ", "contact ", "mail me: ", "reach us at ", "ssn ", "IBAN: ", "account ", "tel. ", "fax ")
PLANTED_ANTI = ("order no. ", "part ", "serial ", "version ", "see page ", "lot ", "build ", "invoice ", "score ", "total ", "item ", "the ", "and ", "of ")
#: Planted examples, a bound of the training sample; every fifth is held out for the threshold.
PLANTED_ROWS = 6000


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def _valid(kind: Column) -> str:
    """Whether a candidate of a base kind passes that kind's check."""
    d = "s.d"
    luhn = (
        f"aggregate(sequence(1, length({d})), 0, (t, i) -> t + "
        f"(cast(substring({d}, i, 1) as int) * if((length({d}) - i) % 2 = 1, 2, 1)) - if((length({d}) - i) % 2 = 1 and cast(substring({d}, i, 1) as int) > 4, 9, 0)) % 10 = 0"
    )
    return (
        "case s.kind when 'email' then true "
        "when 'ip' then forall(split(s.text, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255) "
        f"when 'card' then if(length({d}) between 13 and 19, {luhn}, false) "
        f"when 'phone' then length({d}) between 9 and 15 else null end"
    )


#: Matches of a run: a text's matches are placed run by run, so that a text of very many costs in proportion to their number.
RUN = 256
#: Characters before a match that its features read.
CONTEXT = 32


def _let(value: Column, body) -> Column:
    """body of value, which is made once."""
    return F.transform(F.array(value), body)[0]


def _runs(items: Column) -> Column:
    """items in arrays of RUN."""
    last = F.ceil(F.size(items) / RUN).cast("int") - 1
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(items, k * RUN + 1, RUN))
    return F.when(F.size(items) > 0, runs).otherwise(F.slice(runs, 1, 0))


def _matches(kind: str, text: Column) -> Column:
    """All (kind, start, end, text, before) of a kind; places come from the lengths of what lies between matches."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,text:string,before:string>>")
    gaps = F.split(text, PATTERNS[kind], -1)
    pairs = _let(found, lambda f: F.zip_with(f, F.slice(gaps, 1, F.size(f)), lambda m, g: F.struct(m.alias("m"), F.length(m).alias("n"), F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT)).alias("before"))))

    def placed(run: Column, begin: Column) -> Column:
        """The spans of one run, of which the first gap begins at begin."""

        def step(acc: Column, p: Column) -> Column:
            start = acc["at"] + p["gap"]
            end = start + p["n"]
            span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), p["m"].alias("text"), p["before"].alias("before"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(run, F.struct(begin.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def whole(runs: Column) -> Column:
        sizes = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda n, p: n + p["gap"] + p["n"]))
        return _let(sizes, lambda s: F.flatten(F.transform(runs, lambda r, k: placed(r, F.aggregate(F.slice(s, 1, k), F.lit(0), lambda n, x: n + x)))))

    spans = _let(_let(pairs, _runs), whole)
    return F.when(GATES[kind](text) & text.rlike(PATTERNS[kind]), spans).otherwise(none)


def _stretches(spans: Column) -> Column:
    """spans in runs with the places they reach over; spans of a kind are in order and do not overlap, so few runs reach over any one place."""
    return F.transform(_let(spans, _runs), lambda r: F.struct(F.array_min(F.transform(r, lambda x: x["start"])).alias("low"), F.array_max(F.transform(r, lambda x: x["end"])).alias("high"), r.alias("items")))


def _free(spans: Column, others: Column, beats) -> Column:
    """The spans that no other one overlaps which beats(other, span)."""

    def clear(m: Column, runs: Column) -> Column:
        near = F.filter(runs, lambda r: (r["low"] < m["end"]) & (m["start"] < r["high"]))
        return ~F.exists(near, lambda r: F.exists(r["items"], lambda o: (o["start"] < m["end"]) & (m["start"] < o["end"]) & beats(o, m)))

    return F.when(F.size(spans) > 0, _let(_stretches(others), lambda runs: F.filter(spans, lambda m: clear(m, runs)))).otherwise(spans)


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row's id, spans) where spans holds every generator's proposals with their features, overlapping ones included."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a space first gives every match a gap before it, so that split and extraction always pair up; places lose it again
    rows = docs.select(F.col(id_col).alias("i"), F.concat(F.lit("\n"), text).alias("t"))
    rows = rows.select("i", F.concat(*[_matches(k, F.col("t")) for k in PATTERNS]).alias("spans"))
    rows = rows.withColumn("spans", F.expr(f"transform(spans, s -> struct(s.kind, s.start - 1 as start, s.end - 1 as end, s.text, s.before, {_digits('s.text')} as d))"))
    features = (
        "length(s.d) as digits, length(regexp_replace(s.text, '[^A-Za-z]', '')) as letters, length(regexp_replace(s.text, '[A-Za-z0-9]', '')) as marks, "
        "size(array_distinct(split(s.d, ''))) as distinct, case when s.before rlike '[A-Za-z0-9]$' then 2 when s.before rlike '[^ \\n]$' then 1 else 0 end as before, "
        f"if(s.before rlike '{CUES}', 1, 0) as cue, if(s.before rlike '{ANTI_CUES}', 1, 0) as anti"
    )
    return rows.withColumn("spans", F.expr(f"transform(spans, s -> struct(s.kind, s.start, s.end, {_valid(F.col('spans'))} as valid, {features}))"))


def _bin(feature: str, at: str) -> str:
    whens = " ".join(f"when {at}.{feature} <= {top} then {k}" for k, top in enumerate(BINS[feature]))
    return f"case {whens} else {len(BINS[feature])} end"


Tree = tuple[str, int, str, int, tuple[float, float, float, float]]


def boost(cells: list[tuple[tuple[int, ...], float, float]], rounds: int = 24, rate: float = 0.4) -> tuple[float, list[Tree]]:
    """(bias, trees): Newton boosting of logistic loss with trees of two splits over binned features.

    cells: (bins, candidates, valid ones). There are at most as many as combinations of bins, however large the
    corpus is, and they are the sufficient statistics of all candidates.
    """
    names = list(BINS)
    total, good = sum(c[1] for c in cells), sum(c[2] for c in cells)
    bias = math.log((good + 1) / (total - good + 1))
    trees: list[Tree] = []
    raw = [bias] * len(cells)
    splits = [(f, cut) for f in names for cut in range(len(BINS[f]))]
    side = {s: [int(c[0][names.index(s[0])] > s[1]) for c in cells] for s in splits}
    for _ in range(rounds if cells else 0):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, r)))) for r in raw]
        slope = [c[2] - c[1] * q for c, q in zip(cells, p, strict=True)]
        curve = [c[1] * q * (1 - q) for c, q in zip(cells, p, strict=True)]
        best = None
        for one, two in product(splits, splits):
            if one >= two:
                continue
            g, h = [0.0] * 4, [1.0] * 4
            for k, (x, y) in enumerate(zip(side[one], side[two], strict=True)):
                g[2 * x + y] += slope[k]
                h[2 * x + y] += curve[k]
            gain = sum(a * a / b for a, b in zip(g, h, strict=True))
            if best is None or gain > best[0]:
                best = (gain, one, two, tuple(max(-4.0, min(4.0, rate * a / b)) for a, b in zip(g, h, strict=True)))
        _, one, two, leaves = best
        trees.append((*one, *two, leaves))
        raw = [r + leaves[2 * x + y] for r, x, y in zip(raw, side[one], side[two], strict=True)]
    return bias, trees


def _score(bias: float, trees: list[Tree], at: str) -> str:
    terms = [f"element_at(array({','.join(f'{v!r}D' for v in leaves)}), 1 + 2 * if({_bin(f, at)} > {a}, 1, 0) + if({_bin(g, at)} > {b}, 1, 0))" for f, a, g, b, leaves in trees]
    return "1 / (1 + exp(-(" + " + ".join([f"{bias!r}D", *terms]) + ")))"


def _predict(bias: float, trees: list[Tree], bins: tuple[int, ...]) -> float:
    own = dict(zip(BINS, bins, strict=True))
    raw = bias + sum(leaves[2 * (own[f] > a) + (own[g] > b)] for f, a, g, b, leaves in trees)
    return 1 / (1 + math.exp(-raw))


def threshold(cells: list, bias: float, trees: list[Tree], precision: float) -> float:
    """The least score above which the candidates of all cells reach the precision; above 1 where none do."""
    ranked = sorted(((_predict(bias, trees, c[0]), c[1], c[2]) for c in cells), reverse=True)
    best, n, good = 2.0, 0.0, 0.0
    for k, (score, count, valid) in enumerate(ranked):
        n, good = n + count, good + valid
        if (k + 1 == len(ranked) or ranked[k + 1][0] < score) and good >= precision * n:
            best = score
    return best


def planted(spark: SparkSession, rows: int = PLANTED_ROWS) -> DataFrame:
    """(i, held, good, t): texts with one example each, personal data behind a cue or a look-alike of the same form behind another word.

    Forms, cues and digits follow from the number of the row, so the sample is the same on every run.
    """
    forms = [form for kind in PLANTED.values() for form in kind]
    h = lambda salt, n: F.pmod(F.xxhash64("i", F.lit(salt)), F.lit(n)).cast("int")
    text = F.element_at(F.array(*[F.lit(f) for f in forms]), h(1, len(forms)) + 1)
    for length, digits in (("{1}", 3), ("{2}", 3), ("{3}", 2), ("{4}", 4)):
        # look-alikes repeat their digits more often than personal data does
        number = F.when((F.col("good") == 0) & (h(7, 3) == 0), F.repeat(h(2, 10).cast("string"), digits)).otherwise(F.lpad(h(int(length[1]) + 2, 10**digits).cast("string"), digits, "7"))
        text = F.replace(text, F.lit(length), number)
    pick = lambda words, salt: F.element_at(F.array(*[F.lit(w) for w in words]), h(salt, len(words)) + 1)
    # a tenth of the cues mislead, as they do in texts
    cue = F.when((F.col("good") == 1) == (h(8, 10) > 0), pick(PLANTED_CUES, 9)).otherwise(pick(PLANTED_ANTI, 10))
    base = spark.range(rows).select(F.col("id").alias("i")).withColumn("good", h(0, 2))
    return base.select("i", (F.col("i") % 5 == 0).alias("held"), "good", F.concat(F.lit("so "), cue, text, F.lit(" then")).alias("t"))


def _cells(rows: DataFrame) -> list[tuple[tuple[int, ...], float, float]]:
    """(bins, candidates, valid ones) of rows (s, n, good): one row per combination of bins, of which there are a few thousand at most."""
    found = rows.groupBy(*[F.expr(_bin(f, "s")).alias(f) for f in BINS]).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good")).collect()
    return sorted((tuple(int(c[f]) for f in BINS), float(c["n"]), float(c["good"])) for c in found)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.85) -> DataFrame:
    """id_col and spans: an array of (kind, start, end) in the order of PATTERNS, then by start; code points, end exclusive.

    Base kinds that pass their check are always spans. The trees learn on format and context: from planted examples and look-alikes of the further
    kinds, and from the base candidates of all documents, valid ones against failing ones, which weigh as much together as the planted ones. The
    threshold is the least score at which planted examples that were held out reach the precision. A proposal of a further generator becomes a span
    where its score reaches the threshold, no base span overlaps it and no better proposal does (the earlier, then the longer of equals). Null and empty texts
    have no spans, an empty table no rows; repeated rows are scanned each; other columns are ignored. Runs jobs when called.
    """
    spark = docs.sparkSession
    rows = materialize(candidates(docs, id_col, text_col), "candidates")
    seen = rows.select(F.explode("spans").alias("s")).where("s.valid is not null").select("s", F.lit(1).alias("n"), F.col("s.valid").cast("int").alias("good"))
    base_cells = _cells(seen)
    made = planted(spark)
    examples = candidates(made, "i", "t").join(made.select("i", "held", "good"), "i").select("held", "good", F.explode("spans").alias("s"))
    examples = examples.where(F.col("s.kind").isin(*MORE_PATTERNS)).withColumn("n", F.lit(1))
    learn, held = _cells(examples.where("not held")), _cells(examples.where("held"))
    share = sum(c[1] for c in learn) / max(1.0, sum(c[1] for c in base_cells))
    bias, trees = boost(learn + [(b, n * min(1.0, share), g * min(1.0, share)) for b, n, g in base_cells])
    least = threshold(held, bias, trees, precision)
    base = F.expr("filter(spans, s -> coalesce(s.valid, false))")
    scored = F.expr(f"transform(filter(spans, s -> s.valid is null), s -> struct(s.kind, s.start, s.end, {_score(bias, trees, 's')} as score))")
    rows = rows.select("i", base.alias("base"), scored.alias("more"))
    rows = rows.withColumn("more", F.expr(f"filter(more, m -> m.score >= {least!r}D)"))
    rows = rows.withColumn("more", _free(F.col("more"), F.col("base"), lambda o, m: F.lit(True)))

    def better(o: Column, m: Column) -> Column:
        first = (o["start"] < m["start"]) | ((o["start"] == m["start"]) & ((o["end"] > m["end"]) | ((o["end"] == m["end"]) & (o["kind"] < m["kind"]))))
        return (o["score"] > m["score"]) | ((o["score"] == m["score"]) & first)

    rows = rows.withColumn("more", _free(F.col("more"), F.col("more"), better))
    return rows.select(F.col("i").alias(id_col), F.expr("concat(transform(base, s -> struct(s.kind, s.start, s.end)), transform(more, s -> struct(s.kind, s.start, s.end)))").alias("spans"))
