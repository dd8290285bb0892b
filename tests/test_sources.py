import json

from pyspark.sql import functions as F

from corvane.functions.storage import shared_folder
from corvane.operators import overlay, similar
from corvane.sources import bank, states


def test_states_of_all_versions(spark):
    path = shared_folder(spark, "states")
    lines = ['{"questions": {"d.pdf": [{"number": "1", "text": "a", "images": ["x"]}, {"number": "1b"}]}}', '{"_schema_version": 2, "annotations": {"k": "v"}}', '{"broken": ', ""]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    states = bank.read_states(spark, path).cache()
    sound = [(r._schema_version, r.annotations, r.pdf_meta) for r in states.where("_corrupt_record is null").collect()]
    assert len(sound) == 2 and (3, {}, {}) in sound and (3, {"k": "v"}, {}) in sound
    items = bank.bank_items(states).orderBy("ord").collect()
    assert [(r.doc, r.ord, r.number, r.images) for r in items] == [("d.pdf", 0, "1", ["x"]), ("d.pdf", 1, "1b", None)]
    assert states.where("_corrupt_record is not null").count() == 1


def test_candidates_are_repaired_or_quarantined(spark):
    raw = ['[{"text": "a"}]', '{"candidates": [{"text": "b", "choices": [{"letter": "A", "text": "x"}]}]}', '```json\n[{"text": “c”},]\n```', "Sure! [{'text': 'd'}] Done.", "no json", "", None, "[{\"text\": ", "[]"]
    rows, bad = bank.parse_candidates(spark.createDataFrame(list(enumerate(raw)), "k int, raw string"), "raw")
    assert sorted((r.k, r.text) for r in rows.collect()) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert sorted(r.k for r in bad.collect()) == [4, 5, 6, 7]


def test_html_to_text(spark):
    page = "<html><head><title>t</title></head><nav>menu</nav><div class='toc'>toc</div><p>a &amp; b<br>c</p>\n\n\n<script>x</script><!-- no --><p>d</p>"
    got = bank.html_to_text(spark.createDataFrame([(page, "T"), (None, None)], "html string, title string"), "html", "title").collect()
    assert got[0].text == "# T\n\n*Length: 10 chars*\n\n---\n\na & b\nc\n\nd" and got[1].text == "# \n\n*Length: 0 chars*\n\n---\n\n"


def test_snapshots(spark):
    path = shared_folder(spark, "snapshots")
    first = spark.createDataFrame([("d", "1"), ("e", "1")], "doc string, number string")
    for day, rows in (("2024-01-01", first), ("2024-03-01", first.where("doc = 'd'"))):
        bank.write_snapshot(rows, F.lit(day).cast("timestamp"), path)
    snaps = spark.read.parquet(path).select("doc", "number", "saved_at")
    assert [(r["items"], r["rank"]) for r in overlay.list_snapshots(snaps, "doc", "saved_at").where("doc = 'd'").orderBy("rank").collect()] == [(1, 1), (1, 2)]
    kept, counts = overlay.expire(snaps, "saved_at", 30, F.lit("2024-03-05").cast("timestamp"))
    assert kept.count() == 1 and tuple(counts.first()) == (2, 1)
    now = spark.createDataFrame([("d", "9"), ("f", "1")], "doc string, number string")
    back = overlay.restore(now, snaps, "doc", F.lit("d"), "saved_at", F.lit("2024-01-01").cast("timestamp"))
    assert sorted(map(tuple, back.collect())) == [("d", "1"), ("f", "1")]
    assert sorted(map(tuple, overlay.restore(now, snaps, "doc", F.lit("x"), "saved_at", F.lit("2024-01-01").cast("timestamp")).collect())) == [("d", "9"), ("f", "1")]


def test_greedy_dedup_of_chains(spark):
    base = [f"w{k}" for k in range(12)]
    texts = [" ".join(base[k : k + 8]) for k in range(5)] + ["short", None, " ".join(f"z{k}" for k in range(9)), " ".join(f"b{k}" for k in range(8))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(f"b{k}" for k in range(8)))], "item_id long, text string")
    sets = [set(zip(w, w[1:], w[2:])) if len(w) > 2 else set(w) for w in ((t or "").split() for t in texts)]
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] and sets[b] else 0
    want, kept = {}, []
    for k, t in enumerate(texts):
        if len((t or "").strip()) < 12:
            want[k] = (False, "too short", None)
        elif k == 8:
            want[k] = (False, "bank", 7)
        else:
            near = [j for j in kept if sim(j, k) >= 0.4]
            want[k] = (False, "batch", near[0]) if near else (True, None, None)
            kept += [] if near else [k]
    got = {r.doc_id: (r.kept, r.reason, r.matched) for r in similar.dedup_greedy(docs, items).collect()}
    assert got == want and any(w[1] == "batch" for w in want.values()) and len(kept) >= 3


def test_state_files_as_they_are_written(spark, tmp_path):
    state = {
        "questions": {"d.pdf": [{"number": "1", "text": "a\nb", "choices": [{"letter": "A", "text": "x"}], "year": 2024, "images": ["i.png"]}, {"number": "1b", "matching": {"left": [{"label": "1", "text": "l"}], "pairs": {"1": "A"}}}], "e.pdf": []},
        "annotations": {"d.pdf": {"contexts": [{"id": "c1", "title": "T", "text": "t"}, {"title": "no id"}], "deleted": ["3"], "field_overrides": {"1": {"topic": "x", "answer": None, "choices": [{"letter": "B"}]}}, "added": [{"number": "9", "text": "new"}], "image_overrides": {"assignments": {"a.png": "5", "b.png": ["5", "7"]}, "detached": ["c.png"]}}},
        "vision": {"ignored": [1]},
    }
    (tmp_path / "circuits.json").write_text(json.dumps(state, indent=2))
    (tmp_path / "broken.json").write_text(json.dumps(state, indent=2)[:300])
    (tmp_path / "old.json").write_text(json.dumps({"questions": {}, "vision": {}}, indent=2))
    read = states.read_state_files(spark, f"file://{tmp_path}").cache()
    assert sorted((r.collection, r._schema_version, r.pdf_meta) for r in read.where("_corrupt_record is null").collect()) == [("circuits", 3, {}), ("old", 3, {})]
    items = states.state_items(read).orderBy("ord").collect()
    assert [(r.collection, r.doc, r.ord, r.number, r.year) for r in items] == [("circuits", "d.pdf", 0, "1", "2024"), ("circuits", "d.pdf", 1, "1b", None)]
    assert items[0].text == "a\nb" and items[1].matching.pairs == {"1": "A"}
    assert [(r.key, r.title) for r in states.state_contexts(read).collect()] == [("d.pdf::c1", "T")]
    edits = {(r.kind, r.number, r.field): r.value for r in states.state_edits(read).collect()}
    assert json.loads(edits.pop(("override", "1", "choices"))) == [{"letter": "B"}] and json.loads(edits.pop(("add", "9", None)))["text"] == "new"
    assert edits == {("delete", "3", None): None, ("override", "1", "topic"): "x", ("override", "1", "answer"): None, ("attach", "5", "a.png"): None, ("attach", "5", "b.png"): None, ("attach", "7", "b.png"): None, ("detach", None, "c.png"): None}
