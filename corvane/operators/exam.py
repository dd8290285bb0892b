"""Publishing, grading and releasing of tests, in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.parts import dealt
from corvane.functions.products import product

#: States of a response that count as handed in.
HANDED_IN = ("submitted", "auto_submitted_late")


def item_type(qtype: Column, choices: Column) -> Column:
    """The stated type, else mcq where there are choices, else frq."""
    return F.coalesce(qtype, F.when(F.size(F.coalesce(choices, F.array())) > 0, "mcq").otherwise("frq"))


def choice_points(pick: Column, key: Column) -> Column:
    """1 where the trimmed upper-case pick is the first character of the trimmed upper-case key, else 0; an empty pick or key gives 0."""
    given, want = F.upper(F.trim(pick)), F.substring(F.upper(F.trim(key)), 1, 1)
    return F.when((given == want) & (given != ""), 1.0).otherwise(0.0)


def matching_points(left: Column, pairs: Column, picks: Column, max_points: Column) -> Column:
    """Left labels whose keyed answer was picked, over all keyed pairs, times max_points, at four places; 0 without keyed pairs."""
    right = F.size(F.filter(left, lambda label: F.coalesce(F.try_element_at(pairs, label) == F.try_element_at(picks, label), F.lit(False))))
    return F.when(F.size(pairs) > 0, F.round(right / F.size(pairs) * max_points, 4)).otherwise(0.0)


def text_points(given: Column, key: Column) -> Column:
    """1 where the trimmed texts are equal in either case and not empty, else 0."""
    return F.when((F.lower(F.trim(given)) == F.lower(F.trim(key))) & (F.trim(key) != ""), 1.0).otherwise(0.0)


def publish(kept: DataFrame, bank: DataFrame, contexts: DataFrame, keys: list[str], context: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapshot, contexts used per test, skipped): kept rows (test, keys, max_points) with the bank's content frozen.

    bank has one row per key; kept rows that it does not know are skipped, not failed. max_points defaults to 1.
    """
    points = F.coalesce(F.when(F.col("max_points") != 0, F.col("max_points")), F.lit(1.0))
    snapshot = kept.withColumn("max_points", points).join(bank, keys)
    skipped = kept.join(bank.select(*keys), keys, "left_anti").select("test", *keys)
    doc = keys[0]
    used = snapshot.where(F.col(context).isNotNull()).select("test", doc, context).distinct().join(contexts, [doc, context])
    return snapshot, used, skipped


def answer_free(snapshot: DataFrame, hidden: list[str], matching: str | None = None) -> DataFrame:
    """snapshot as a taker may see it: without the hidden columns and without the pairs of a matching struct."""
    out = snapshot.drop(*hidden)
    return out.withColumn(matching, F.col(matching).dropFields("pairs")) if matching else out


def auto_grade(answers: DataFrame, responses: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(test, student, number, points): choice and matching items answered in responses that are handed in.

    Unanswered items have no row; free-text ones wait for a manual grade. answers: test, student, number, picked, picks;
    snapshot: test, number, qtype, key, left, pairs, max_points.
    """
    done = responses.where(F.col("status").isin(*HANDED_IN)).select("test", "student")
    graded = answers.join(done, ["test", "student"], "left_semi").join(snapshot.where("qtype in ('mcq', 'matching')"), ["test", "number"])
    matched = matching_points(F.col("left"), F.col("pairs"), F.coalesce("picks", F.create_map().cast("map<string,string>")), F.col("max_points"))
    points = F.when(F.col("qtype") == "mcq", choice_points(F.col("picked"), F.col("key"))).otherwise(matched)
    return graded.where("picked is not null or picks is not null").select("test", "student", "number", points.alias("points"))


def grade_fault(qtype: Column, points: Column, max_points: Column) -> Column:
    """Why a manual grade of an item is rejected, null if it counts."""
    return F.when(F.coalesce(qtype, F.lit("")) != "frq", "not a free-response item").when(~F.coalesce(points.between(0, max_points), F.lit(False)), "out of range")


def merge_manual(feed: DataFrame, snapshot: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """(grades, rejected): the last grade of each test, student and number; grades outside 0..max_points or of other than a free-text item
    of the test are rejected with a reason."""
    items = snapshot.select("test", "number", "qtype", "max_points")
    joined = feed.join(items, ["test", "number"], "left")
    reason = grade_fault(F.col("qtype"), F.col("points"), F.col("max_points"))
    judged = joined.withColumn("reason", reason)
    grades = judged.where("reason is null").groupBy("test", "student", "number").agg(F.max_by(F.struct("points", "graded_by"), order).alias("g"))
    return grades.select("test", "student", "number", "g.*"), judged.where("reason is not null").select(*feed.columns, "reason")


def complete_tests(snapshot: DataFrame, responses: DataFrame, manual: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """(test, complete): true unless a handed-in response lacks a manual grade of a free-text item; counts of both, no pairs of them.

    whole (test, student, points, graded_by; at most a row per response) are grades given to whole responses: each stands for every free-text item without a grade of its own.
    """
    free = snapshot.where("qtype = 'frq'").select("test", "number")
    done = responses.where(F.col("status").isin(*HANDED_IN)).select("test", "student").distinct()
    if whole is not None:
        done = done.join(whole.where("points is not null").select("test", "student"), ["test", "student"], "left_anti")
    graded = manual.where("points is not null").select("test", "student", "number").distinct().join(free, ["test", "number"], "left_semi").join(done, ["test", "student"], "left_semi")
    one, none = F.lit(1), F.lit(0)
    rows = done.select("test", one.alias("student"), none.alias("grade")).union(graded.select("test", none, one))
    return _complete(snapshot, rows.groupBy("test").agg(F.sum("student").alias("students"), F.sum("grade").alias("grades")))


def _complete(snapshot: DataFrame, counts: DataFrame) -> DataFrame:
    """(test, complete) of each test of snapshot, from counts (test, students, grades) of handed-in responses and the grades of their free-text items; an item without number is one that
    nobody can grade."""
    items = snapshot.groupBy("test").agg(F.count_distinct(F.when(F.col("qtype") == "frq", F.struct("number"))).alias("items"))
    zero = F.lit(0)
    return items.join(counts, "test", "left").select("test", (F.col("items") * F.coalesce("students", zero) == F.coalesce("grades", zero)).alias("complete"))


def graded_responses(marks: DataFrame) -> DataFrame:
    """(test, student, graded): a row a response with how many of its items have a grade. marks (test, student, number, counts): an answer or a grade a row, counts being
    true for grades that do. A response's rows meet once, those without a grade as one; grades of a null student are nobody's."""
    number = F.when(F.col("counts") & F.col("student").isNotNull(), F.col("number"))
    return dealt(marks.select("test", "student", number.alias("number")), ["test", "student"]).groupBy("test", "student").agg(F.count_distinct("number").alias("graded"))


def complete_by_response(snapshot: DataFrame, responses: DataFrame) -> DataFrame:
    """complete_tests of responses (test, student, status, graded, each; a row a response) that say how many free-text items of theirs have a grade, and the grade of the whole response, if any."""
    waiting = responses.where(F.col("status").isin(*HANDED_IN) & F.col("each").isNull())
    return _complete(snapshot, waiting.groupBy("test").agg(F.count("*").alias("students"), F.sum("graded").alias("grades")))


def of_complete(rows: DataFrame, complete: DataFrame) -> DataFrame:
    """The rows of complete tests; complete (test, complete) is a row a test, so it goes to the rows."""
    return rows.join(F.broadcast(complete.where("complete").select("test").distinct()), "test", "left_semi")


def release(responses: DataFrame, complete: DataFrame) -> DataFrame:
    """responses with released set for the handed-in ones of complete tests; complete (test, complete) is a row a test, so it goes to the rows."""
    ready = F.broadcast(complete.where("complete").select("test", F.lit(True).alias("ready")))
    now = F.coalesce(F.col("ready") & F.col("status").isin(*HANDED_IN), F.lit(False)) | F.coalesce("released", F.lit(False))
    return responses.join(ready, "test", "left").withColumn("released", now).drop("ready")


def locked_tests(tests: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """(test) that may not be reopened: their window has opened or an answer is saved."""
    opened = tests.where(F.col("opens_at") <= now).select("test")
    return opened.union(tests.select("test").join(answers.select("test"), "test", "left_semi")).distinct()


def worklist(snapshot: DataFrame, responses: DataFrame, answers: DataFrame, manual: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """(test, student, number, answer, points): every free-text item of every handed-in response with its grade so far, if any; whole as in complete_tests.

    answers and manual have a row per test, student and number at most. The list is as long as responses and items multiplied, so it is made last: a response takes its own
    answers and grades along, as many as it has, and the list itself is never shuffled.
    """
    keys, done = ["test", "student"], responses.where(F.col("status").isin(*HANDED_IN)).select("test", "student")
    free = snapshot.where("qtype = 'frq'").select("test", "number")
    text, points = answers.schema["picked"].dataType, manual.schema["points"].dataType
    marks = answers.select(*keys, "number", F.col("picked").alias("answer"), F.lit(None).cast(points).alias("points"))
    marks = marks.union(manual.select(*keys, "number", F.lit(None).cast(text).alias("answer"), "points")).join(free, ["test", "number"], "left_semi")
    one = marks.groupBy(*keys, "number").agg(F.max("answer").alias("answer"), F.max("points").alias("points"))
    held = one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("number", F.struct("answer", "points")))).alias("marks"))
    rest = done.withColumn("each", F.lit(None).cast(points)) if whole is None else done.join(whole.select(*keys, F.col("points").alias("each")), keys, "left")
    rows = product(rest.join(held, keys, "left"), free, ["test"]).withColumn("mark", F.try_element_at("marks", "number"))
    return rows.select("test", "student", "number", F.col("mark.answer").alias("answer"), F.coalesce("mark.points", "each").alias("points"))


def score_totals(snapshot: DataFrame, responses: DataFrame, auto: DataFrame, manual: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """(test, student, earned, possible) of handed-in responses; automatic points shadow manual ones, 0 included.

    possible counts all items of the snapshot, answered or not; grades of other numbers do not count. whole, as in complete_tests, counts for the free-text items that have
    no points of their own, by their number.
    """
    possible = snapshot.groupBy("test").agg(F.sum("max_points").alias("possible"))
    keys = ["test", "student", "number"]
    own = auto.select(*keys, F.struct(F.lit(1).alias("first"), "points").alias("g")).union(manual.select(*keys, F.struct(F.lit(0).alias("first"), "points").alias("g")))
    items = snapshot.groupBy("test", "number").agg(F.bool_or(F.col("qtype") == "frq").alias("free"))
    best = own.groupBy(*keys).agg(F.max("g").alias("g")).join(items, ["test", "number"])
    earned = best.groupBy("test", "student").agg(F.sum("g.points").alias("earned"), F.count_if(F.col("free") & F.col("g.points").isNotNull()).alias("graded"))
    done = responses.where(F.col("status").isin(*HANDED_IN)).select("test", "student", "released")
    out = done.join(possible, "test").join(earned, ["test", "student"], "left").withColumn("earned", F.coalesce("earned", F.lit(0.0)))
    if whole is not None:
        rest = whole.select("test", "student", F.col("points").alias("each")).join(items.where("free").groupBy("test").agg(F.count("*").alias("items")), "test")
        out = out.join(rest, ["test", "student"], "left")
        out = out.withColumn("earned", F.col("earned") + F.coalesce(F.col("each") * (F.col("items") - F.coalesce("graded", F.lit(0))), F.lit(0.0)))
    return out.select("test", "student", "released", "possible", "earned")


def score_grid(totals: DataFrame, complete: DataFrame, roster: DataFrame, tests: list[str]) -> DataFrame:
    """One row per rostered student, takers of other rosters left out, and for each listed test earned, possible and pending (not released); only complete tests fill cells."""
    shown = totals.join(complete.where("complete").select("test"), "test", "left_semi")
    cells = []
    for k, t in enumerate(tests):
        here = F.col("test") == t
        cells += [F.max(F.when(here, F.col("earned"))).alias(f"earned_{k}"), F.max(F.when(here, F.col("possible"))).alias(f"possible_{k}"), F.max(F.when(here, ~F.coalesce("released", F.lit(False)))).alias(f"pending_{k}")]
    return roster.select("student").distinct().join(shown.where(F.col("test").isin(*tests)).groupBy("student").agg(*cells), "student", "left")


def score_cells(totals: DataFrame, complete: DataFrame, roster: DataFrame, visible: DataFrame, viewer: object, role: str) -> DataFrame:
    """(student, test, earned, possible, pending, detail_ok): the score page of one viewer, a row a cell; rostered students without one have a
    row of null test. Takers of other rosters are left out, and tests that are not complete. detail_ok says whether the viewer may open the
    response: coaches always, others by visible as visible_responses gives it. Repeated roster rows count once; a null student has no cells."""
    shown = totals.join(complete.where("complete").select("test").distinct(), "test", "left_semi")
    own = visible.where(F.col("viewer") == F.lit(viewer)).select("test", "student", F.lit(True).alias("opens")).distinct()
    cells = shown.join(own, ["test", "student"], "left").select(
        "student", "test", "earned", "possible", (~F.coalesce("released", F.lit(False))).alias("pending"), (F.lit(role == "coach") | F.coalesce("opens", F.lit(False))).alias("detail_ok")
    )
    return roster.select("student").distinct().join(cells, "student", "left")


def may_open(asked: DataFrame, visible: DataFrame, viewers: DataFrame) -> DataFrame:
    """asked (viewer, test, student) with may_open: coaches open every response, others what visible, as visible_responses gives it, lists for
    them. Viewers without a role, and null ones, open none; other columns of asked stay, repeated rows too."""
    coach = viewers.where("role = 'coach'").select("viewer", F.lit(True).alias("_coach")).distinct()
    own = visible.select("viewer", "test", "student", F.lit(True).alias("_own")).distinct()
    judged = asked.join(coach, "viewer", "left").join(own, ["viewer", "test", "student"], "left")
    return judged.withColumn("may_open", F.coalesce("_coach", "_own", F.lit(False))).select(*asked.columns, "may_open")


def practice_report(graded: DataFrame, taker: str, number: str, points: str) -> DataFrame:
    """(taker, answered, earned, percent, mistakes): percent is rounded; mistakes counts what is not fully correct, with the first hundred numbers as a preview of practice_mistakes."""
    wrong = F.col(points) < 1
    first = F.slice(F.array_sort(F.collect_set(F.when(wrong, F.col(number)))), 1, 100)
    out = graded.groupBy(taker).agg(F.count("*").alias("answered"), F.sum(points).alias("earned"), F.count_if(wrong).alias("mistakes"), first.alias("listed"))
    return out.withColumn("percent", F.round(F.lit(100) * F.col("earned") / F.col("answered"), 0))


def practice_mistakes(graded: DataFrame, points: str) -> DataFrame:
    """Every answer that is not fully correct, a row each, with its columns: what practice_report counts and lists the first of."""
    return graded.where(F.col(points) < 1)


def visible_responses(responses: DataFrame, manual: DataFrame, snapshot: DataFrame, assigned: DataFrame, viewers: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """(viewer, test, student) that viewers (viewer, role) may open: a student their own, a volunteer those they graded and, of tests
    without free-text items, those they are assigned to. Coaches see every response, so none are listed for them: may_open answers for all roles.
    A grade of whole, as in complete_tests, is one of each free-text item, so it counts where the test has any."""
    keys = responses.select("test", "student")
    own = keys.join(viewers.where("role = 'student'").select("viewer", F.col("viewer").alias("student")), "student")
    helper = viewers.where("role = 'volunteer'").select("viewer")
    graders = manual.select("test", "student", F.col("graded_by").alias("viewer"))
    if whole is not None:
        graders = graders.union(whole.join(snapshot.where("qtype = 'frq'").select("test"), "test", "left_semi").select("test", "student", "graded_by"))
    graded = graders.distinct().join(helper, "viewer", "left_semi").join(keys, ["test", "student"], "left_semi")
    closed = assigned.join(snapshot.where("qtype = 'frq'").select("test"), "test", "left_anti").join(helper, "viewer", "left_semi").join(keys, "test")
    pick = lambda d: d.select("viewer", "test", "student")
    return pick(own).union(pick(graded)).union(pick(closed)).distinct()
