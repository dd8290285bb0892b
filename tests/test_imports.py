"""Whole imports: rosters with blank usernames, model answers to numbered items, gathering kind by kind."""

import json
import re

from corvane.operators import similar
from corvane.sources import bank

SOUND = re.compile(r"[a-z][a-z0-9_]{1,31}")


def roster_by_loop(rows, users):
    """Names given in the file first, then the generated ones in order."""
    taken, errors, created = set(users), {}, {}
    plain = lambda n: (lambda s: s if s[0].isalpha() else "s" + s)(re.sub("[^a-z0-9]", "", n.lower()) or "student")[:32]
    bare = {plain(n) for _, n, u, _ in rows if n and not u}
    for row, name, user, _ in rows:
        if not name:
            errors[row] = "display_name is required"
        elif user and not SOUND.fullmatch(user.lower()) or not user and len(plain(name)) < 2:
            errors[row] = "username is malformed"
        elif user and user.lower() in taken:
            errors[row] = "username is taken"
        elif user:
            taken.add(user.lower())
            created[row] = user.lower()
    for row, name, user, _ in rows:
        if name and not user and row not in errors:
            want, k = plain(name), 1
            while (want in taken) or (k > 1 and want in bare):
                k += 1
                want = f"{plain(name)}{k}"
            taken.add(want)
            created[row] = want
    return created, errors


def test_rosters_with_blank_usernames(spark):
    rows = [
        (1, "Ann Lee", None, "a;b"), (2, "Ann Lee", "", "a"), (3, "ann-lee!", None, "zz"), (4, "Ann", "ANNLEE2", "b"), (5, "", None, "a"), (6, None, "x9", ""), (7, "7 up", None, None), (8, "李", "", "b ; b"),
        (9, "Q", None, "a"), (10, "Bo", "9bo", "a"), (11, "Bo", "bo", "a"), (12, "Bo", "BO", "a"), (13, "Ann Lee 3", None, "a"), (14, "李", None, ""), (15, "Bo", "b", ""), (16, "Kim", None, "a"), (17, "Kim", "bad name", "a"),
    ]
    users = ["kim", "student2"]
    frame = spark.createDataFrame(rows, "row long, display_name string, username string, events string")
    created, errors, rostered = bank.import_roster(frame, spark.createDataFrame([(u,) for u in users], "username string"), spark.createDataFrame([("a",), ("b",)], "slug string"))
    want, bad = roster_by_loop(rows, users)
    got = {r.row: r.username for r in created.collect()}
    assert got == want and {r.row: r.reason for r in errors.collect()} == bad
    assert got[1] == "annlee" and got[2] == "annlee4" and got[7] == "s7up" and got[8] == "student" and got[14] == "student3" and got[16] == "kim2"
    assert {r.slug: r.n for r in rostered.collect()} == {"a": 5, "b": 3}


def test_candidates_become_items(spark):
    def word(k):
        return " ".join(f"w{k}x{j}" for j in range(6))

    first = [{"text": word(1), "answer": "ﬁve (2 pts)", "choices": [{"letter": "q", "text": "(1 pt) x"}, {"text": " "}, {"letter": "b", "text": "２"}]}, {"text": "too short"}, {"text": None}, {"text": word(2), "topic": "Optics", "rationale": " since "}]
    second = {"candidates": [{"text": word(1) + " (3 points)"}, {"text": "In bank " + word(9), "topic": "none such"}, {"text": "A laser " + word(3), "topic": "none such", "type": "essay", "source_snippet": "s" * 300, "image_context": "a lens"}]}
    raw = [(20, json.dumps(second)), (10, "Sure:\n```json\n" + json.dumps(first) + "\n```"), (30, "no json"), (40, None), (50, "[]")]
    frame = spark.createDataFrame(raw, "k long, answer string")
    known = spark.createDataFrame([(77, "In bank " + word(9))], "item_id long, text string")
    topics = spark.createDataFrame([("Waves", 0, "sound", 1), ("Optics", 1, "laser", 1)], "topic string, topic_ord int, phrase string, weight int")
    items, rejected, quarantine, counts = bank.import_candidates(frame, "k", "answer", known, topics, 500)
    got = {(r.k, r.ord): r for r in items.collect()}
    assert {at: (r.number, r.topic, r.type) for at, r in got.items()} == {(10, 0): ("500", "Other / General", "mc"), (10, 3): ("501", "Optics", "short"), (20, 2): ("502", "Optics", "essay")}
    assert got[10, 0].answer == "five" and [tuple(c) for c in got[10, 0].choices] == [("A", "x"), ("B", "2")] and got[10, 0].validation is None
    assert tuple(got[10, 3].validation) == ("uncertain", "since", "LLM-derived") and got[20, 2].validation.source == "LLM-derived from: " + "s" * 80 and got[20, 2].pending_image == "a lens"
    assert sorted((r.k, r.ord, r.outcome, r.reason, r.matched) for r in rejected.collect() if r.reason) == [(20, 0, "duplicate", "batch", 1), (20, 1, "duplicate", "bank", 77)]
    assert sorted((r.k, r.ord) for r in rejected.where("outcome = 'invalid'").collect()) == [(10, 1), (10, 2)]
    assert sorted(r.k for r in quarantine.collect()) == [30, 40] and counts.first().asDict() == {"added": 3, "duplicate": 2, "invalid": 2, "quarantined": 2}
    again = bank.import_candidates(frame.where("k = 10"), "k", "answer", known, topics, 1, marked=True)[0].orderBy("ord").collect()
    assert [(r.validation.status, r.validation.rationale) for r in again] == [("correct", "Marked validated on import."), ("correct", "since")]
    none = bank.import_candidates(frame.where("k > 90"), "k", "answer", known, topics, 1)
    assert none[0].count() == 0 and none[3].first().asDict() == {"added": 0, "duplicate": 0, "invalid": 0, "quarantined": 0}


def test_gathering_kind_by_kind(spark):
    text = lambda k: f"alpha{k} beta{k} gamma{k} delta{k}"
    rows = [(k, "ab"[k % 2], k, text(k % 17 if k % 5 == 0 else k)) for k in range(60)] + [(90, None, 1, "x"), (91, "z", 1, "y"), (92, "b", -2, None), (93, "b", -1, " ")]
    frame = spark.createDataFrame(rows, "id long, kind string, place long, body string")
    known, stored = {4, 7}, {500: text(3)}

    def loop(kinds, count):
        quota, kept, rejected, skipped = min(3 * -(-count // len(kinds)) + 10, 50), [], [], []
        for kind in kinds:
            for k, _, _, body in sorted((r for r in rows if r[1] == kind), key=lambda r: r[2])[:quota]:
                if k in known:
                    skipped.append(k)
                elif (body or "").strip() and len(kept) < count:
                    (rejected if body in stored.values() or body in {b for _, b in kept} else kept).append((k, body))
        return [k for k, _ in kept], [k for k, _ in rejected], sorted(skipped)

    seen = spark.createDataFrame([(k,) for k in known], "id long")
    held = spark.createDataFrame(list(stored.items()), "item_id long, text string")
    for kinds, count in ((["b", "a"], 8), (["a"], 40), (["b", "a"], 200)):
        taken, rejected, skipped = similar.collect_kept(frame, "id", "kind", "place", "body", kinds, count, seen, held)
        got = [r.id for r in taken.orderBy("at").collect()], [r.id for r in rejected.orderBy("at").collect()], sorted(r.id for r in skipped.collect())
        assert got == loop(kinds, count)
