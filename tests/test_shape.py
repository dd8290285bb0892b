import pytest
from pyspark.sql import functions as F

from corvane.operators import layout, shape

COVER = ("score:", "names:")
NOISE = ("©", "page ", "name:")


def one(spark, expression, *values):
    names = [f"c{k}" for k in range(len(values))]
    return spark.createDataFrame([tuple(values)], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in zip(names, values, strict=True))).select(expression(*map(F.col, names)).alias("x")).first().x


def options(found):
    return found.stem, [(c.letter, c.text) for c in found.choices]


@pytest.mark.parametrize(("text", "want"), [
    ("(2 points) Find R", "Find R"), ("[3pts] each", "each"), ("a b​c  d", "a bc d"), ("２ ﬁn (3.5 pts each)", "2 fin"), ("(½ pt)", "(1⁄2 pt)"), (None, ""), ("plain", "plain"),
])
def test_normalize(spark, text, want):
    assert one(spark, shape.normalize_text, text) == want


def test_inline_options(spark):
    cut = lambda t: options(one(spark, shape.explode_options, t))
    assert cut("What is V here? a. 1 V b. 2 V c. 3 V d. 4 V") == ("What is V here?", [("A", "1 V"), ("B", "2 V"), ("C", "3 V"), ("D", "4 V")])
    assert cut("The net charge has 5 C of it. a. yes b. no") == ("The net charge has 5 C of it.", [("A", "yes"), ("B", "no")])
    plain = "Compute the resistance of the circuit. Show your work."
    assert cut(plain) == (plain, []) and cut(None) == ("", [])
    # the missing A is what follows the question mark; a missing C is not made up
    assert cut("Which unit is it? ohm b. volt c. watt") == ("Which unit is it?", [("A", "ohm"), ("B", "volt"), ("C", "watt")])
    assert cut("Which unit is it? ohm b. volt d. watt")[1] == []
    assert cut("Find the potential ____ high b) low c) none") == ("Find the potential ____", [("A", "high"), ("B", "low"), ("C", "none")])
    assert cut("Short a. x b. y")[1] == [] and cut("A long enough stem a. " + "x" * 400 + " b. y")[1] == []
    assert cut("A long enough stem b. x a. y")[1] == [] and cut("A long enough stem (A) x (C) y")[1] == [("A", "x"), ("C", "y")]


def test_option_lines(spark):
    cut = lambda t: options(one(spark, shape.explode_option_lines, t))
    assert cut("Pick one\na. choice one\nb. choice two\nwrapped\nC) choice three\n(d) choice four") == ("Pick one", [("A", "choice one"), ("B", "choice two wrapped"), ("C", "choice three"), ("D", "choice four")])
    assert cut("alpha\nbeta\ngamma\ndelta") == ("", [("A", "alpha"), ("B", "beta"), ("C", "gamma"), ("D", "delta")])
    assert cut("single") == ("single", []) and cut(None) == ("", []) and cut("b. x\nc. y") == ("b. x\nc. y", [])


def test_matching(spark):
    ten = "Match each term in Column A with one in Column B. " + " ".join(f"{k}. t{k}" for k in range(1, 6)) + " " + " ".join(f"{c}. d{c}" for c in "abcde")
    assert one(spark, shape.is_matching, ten) and not one(spark, shape.is_matching, "Explain why 1. it is") and not one(spark, shape.is_matching, "What is it? a. x b. y")


def test_rows(spark):
    merged = lambda rows: one(spark, shape.merge_continuations, rows)
    labelled = lambda rows, numeric: [(r.label, r.text) for r in one(spark, lambda c: shape.label_rows(c, numeric), rows)]
    assert merged(["1. a", "2. b", "3. c"]) == ["1. a", "2. b", "3. c"] and merged(["x", "y", "z"]) == ["x", "y", "z"]
    assert merged(["f.", "continues here", "more text"]) == ["f. continues here more text"]
    assert merged(["f.", "Cipher catches", "hospital.", "j.", "A mosquito"]) == ["f. Cipher catches hospital.", "j. A mosquito"]
    assert merged(["___ Eradication", "___ Vector", "___ Isolation"]) == ["Eradication", "Vector", "Isolation"] and merged([]) == [] and merged(["lead", "1) a", "", "b"]) == ["lead", "1) a b"]
    assert labelled(["1. Resistor", "2. Capacitor"], True) == [("1", "Resistor"), ("2", "Capacitor")]
    assert labelled(["x", "y", "c) z"], True) == [("1", "x"), ("2", "y"), ("C", "z")] and labelled(["x", " ", "y"], False) == [("A", "x"), ("B", "y")]


def test_keys(spark):
    pairs = lambda a, left: one(spark, shape.key_pairs, a, left)
    assert pairs("A,C,B", ["1", "2", "3"]) == {"1": "A", "2": "C", "3": "B"} and pairs("A,C", ["1", "2", "3"]) == {} and pairs("see diagram", ["1", "2"]) == {} and pairs(None, ["1"]) == {}
    page = "\n".join(["1. B", "2) 42 ohm", "3. Which one?", "4. (2 pts) text", "5. 1. nested", "6. " + "x" * 151, "7. last", "7. really last", "8."])
    docs = spark.createDataFrame([("d", [page, "no key here"]), ("e", None), ("f", [""])], "doc string, pages array<string>")
    assert sorted(map(tuple, shape.extract_answers(docs, "doc", "pages").collect())) == [("d", "1", "B"), ("d", "2", "42 ohm"), ("d", "7", "really last")]


def test_pages(spark):
    cover = lambda t: one(spark, lambda c: shape.is_cover(c, COVER), t)
    real = "\n".join(f"{k}. A question of over twenty characters" for k in range(1, 4))
    assert cover("Names: ____\nScore: ____") and not cover("Names: x\n" + real) and not cover("nothing") and not cover(None)
    assert cover("Score:\n" + "\n".join(["line"] * 30 + ["_____"] * 3)) and not cover("Score:\n" + "\n".join(["line"] * 30))
    key = lambda t: one(spark, shape.is_key, t)
    assert key("Answer Key") and key("\n".join(f"{k}. x" for k in range(1, 6))) and not key("\n".join(f"{k}. x" for k in range(1, 5))) and not key(None)


def segments(spark, pages, **options):
    docs = spark.createDataFrame([("d", pages)], "doc string, pages array<string>")
    return [(r.number, r.body) for r in shape.segment_records(docs, "pages", COVER, NOISE, **options).orderBy("ord").collect()]


def test_segments(spark):
    pages = ["Names: __\nScore: __", "1. What is a resistor?\ncontinued here\n© noise\nQuestion 2: Explain the other thing\n3) tiny", None, " ", "12. Last one before the key", "Answer Key\n1. not a record at all"]
    assert segments(spark, pages) == [("1", "What is a resistor? continued here"), ("2", "Explain the other thing"), ("12", "Last one before the key")]
    inline = ["1. First question here? 2. Second question here. 3. Third question here"]
    assert segments(spark, inline) == [("1", "First question here?"), ("2", "Second question here."), ("3", "Third question here")]
    assert segments(spark, []) == [] and segments(spark, None) == []


def test_matching_rows_stay_in_their_record(spark):
    rows = ["5. Match each item in column A", "1. first row", "2. second row", "6. Next question text", "1. restarts here now"]
    want = [("5", "Match each item in column A 1. first row 2. second row"), ("6", "Next question text"), ("1", "restarts here now")]
    assert segments(spark, ["\n".join(rows)]) == want
    assert [n for n, _ in segments(spark, ["\n".join(rows)], absorb=False)] == ["5", "1", "2", "6", "1"]
    many = ["9. Match the following terms", *[f"{k}. row number {k}" for k in range(1, 28)]]
    assert [n for n, _ in segments(spark, ["\n".join(many)])] == ["9", "26", "27"]


def test_chunks(spark):
    def plain(text, most):
        if len(text) <= most:
            return [text]
        out, cur, used = [], [], 0
        import re

        for p in re.split(r"\n{2,}", text):
            if used + len(p) > most and cur:
                out.append("\n\n".join(cur))
                cur, used = [p], len(p)
            else:
                cur.append(p)
                used += len(p) + 2
        return [*out, "\n\n".join(cur)] if cur else out

    texts = ["", "x" * 50, "\n\n".join(["a" * 10] * 9), "a\n\n\n\nb\n\n" + "c" * 60 + "\n\nd", "\n\n" + "e" * 30 + "\n\n", "f" * 18 + "\n\n" + "g" * 20 + "\n\n" + "h" * 20]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "k int, t string")
    got = {}
    for r in shape.greedy_chunks(docs, "k", "t", 40).orderBy("k", "chunk_no").collect():
        got.setdefault(r.k, []).append(r.chunk)
    assert got == {k: plain(t, 40) for k, t in [*enumerate(texts), (99, "")]}


def test_chapters(spark):
    text = "Intro\nChapter 1: One\n## Page 2\nbody\n## Page 4\nUnit 2\nSection IV - x\n## Page 9\nend"
    got = shape.chapters(spark.createDataFrame([("d", text), ("e", "none"), ("f", None)], "d string, m string"), "d", "m").collect()
    assert [(r.title, r.start_page, r.end_page) for r in got] == [("Chapter 1: One", 1, 3), ("Unit 2", 4, 4), ("Section IV - x", 4, 9)]


def test_answers_need_sure_numbers(spark):
    items = spark.createDataFrame([("a", "1", None), ("a", "2", "matching"), ("b", "1", None), ("b", "1b", None), ("a", "3", None)], "doc string, number string, qtype string")
    answers = spark.createDataFrame([("a", "1", "ocr", 2), ("a", "1", "key", 0), ("a", "2", "x", 0), ("b", "1", "y", 0)], "doc string, number string, answer string, precedence int")
    got = {(r.doc, r.number): r.answer for r in shape.attach_answers(items, answers, "doc", "number").collect()}
    assert got == {("a", "1"): "key", ("a", "2"): "", ("a", "3"): "", ("b", "1"): "", ("b", "1b"): ""}


def test_images(spark):
    rows = [("d", 1, 0.0, "1", None), ("d", 1, 5.0, None, "a"), ("d", 1, 6.0, "2", None), ("d", 2, 1.0, None, "b"), ("d", 2, 2.0, "3", None), ("d", 2, 3.0, None, "c"), ("d", 2, 4.0, None, "e"), ("x", 1, 1.0, None, "z")]
    frame = spark.createDataFrame(rows, "doc string, page int, y double, number string, image string")
    said = spark.createDataFrame([("d", "c", "PREV"), ("d", "e", "9")], "doc string, image string, number string")
    call = lambda s: {r.image: r.number for r in layout.assign_images(frame, "doc", ["y", "image"], "page", F.col("number"), F.col("image"), s).collect()}
    assert call(None) == {"a": "1", "b": "2", "c": "3", "e": "3", "z": None} and call(said) == {"a": "1", "b": "2", "c": "2", "e": "9", "z": None}


def test_any_character_within_a_text(spark):
    body = "1. What \x00 is it?\nmore \x00\n2. Another question here"
    assert segments(spark, [body]) == [("1", "What \x00 is it? more \x00"), ("2", "Another question here")]
    assert options(one(spark, shape.explode_option_lines, "st\x00em\na. o\x00ne\nb. two")) == ("st\x00em", [("A", "o\x00ne"), ("B", "two")])
    assert one(spark, shape.merge_continuations, ["le\x00ad", "1. a\x00", "b"]) == ["le\x00ad", "1. a\x00 b"]
    docs = spark.createDataFrame([(1, "a\x00b\n\n" + "c" * 9 + "\n\nd\x00")], "k int, t string")
    assert [r.chunk for r in shape.greedy_chunks(docs, "k", "t", 12).orderBy("chunk_no").collect()] == ["a\x00b", "c" * 9 + "\n\nd\x00"]
    got = shape.chapters(spark.createDataFrame([("d", "## Page 2\nChapter 1: O\x00ne\n## Page 5\nend")], "d string, m string"), "d", "m").collect()
    assert [(r.title, r.start_page, r.end_page) for r in got] == [("Chapter 1: O\x00ne", 2, 5)]
