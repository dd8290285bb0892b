"""Human edits laid over extracted items: deletes, adds, overrides, images, verdicts, snapshots and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.parts import dealt


def apply_deletes(items: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    """items without those whose keys are deleted; a null key is never deleted."""
    return items.join(dealt(deletes.select(*keys), keys), keys, "left_anti")


def apply_adds(items: DataFrame, adds: DataFrame, keys: list[str], order: str, defaults: dict[str, Column]) -> DataFrame:
    """items and the first add by order of each key that is not there yet; a blank or missing field of an add takes its default.

    Adds without a key are left out; columns an add lacks become null.
    """
    rest = [c for c in adds.columns if c not in keys]
    held = adds.where(F.forall(F.array(*[F.col(k).cast("string") for k in keys]), lambda k: k.isNotNull()))
    first = held.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")
    for name, value in defaults.items():
        own = F.col(name) if name in first.columns else F.lit(None)
        first = first.withColumn(name, F.coalesce(F.when(own.cast("string") != "", own), value))
    new = first.drop(*[c for c in (order,) if c not in items.columns]).join(items.select(*keys), keys, "left_anti")
    return items.unionByName(new, allowMissingColumns=True)


def override_table(edits: DataFrame, keys: list[str], field: str, value: str, order: Column, fields: list[str]) -> DataFrame:
    """One row per key with a struct (v) for each field that any edit names: the last edit's value, which may be null.

    A field without an edit is a null struct, so that a present null and an absent field stay apart.
    """
    last = [F.max_by(F.struct(F.col(value).alias("v")), F.when(F.col(field) == f, order)).alias(f"edited_{f}") for f in fields]
    return edits.where(F.col(field).isin(*fields)).groupBy(*keys).agg(*last)


def apply_overrides(items: DataFrame, overrides: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """items with every field that override_table names replaced, by null too; fields without an edit keep their value."""
    joined = items.join(overrides, keys, "left")
    for f in fields:
        edited = F.col(f"edited_{f}")
        joined = joined.withColumn(f, F.when(edited.isNotNull(), edited["v"].cast(items.schema[f].dataType)).otherwise(F.col(f)))
    return joined.select(*items.columns)


def reassign_images(items: DataFrame, key: str, number: str, images: str, detached: DataFrame, assigned: DataFrame) -> DataFrame:
    """items with their images after edits: detached (key, image) and assigned (key, image, number, ord) ones leave every item
    of the key, then assigned ones join the items they name, once each and in order; unknown targets are ignored.
    """
    gone = detached.select(key, "image").union(assigned.select(key, "image")).distinct()
    held = items.select(key, number, F.posexplode(images).alias("at", "image")).join(gone, [key, "image"], "left_anti")
    target = assigned.join(items.select(key, number), [key, number], "left_semi")
    # what an item holds already comes before what is assigned to it
    both = held.select(key, number, "image", F.struct(F.lit(0).alias("new"), F.col("at").cast("long").alias("at")).alias("by"))
    both = both.unionByName(target.select(key, number, "image", F.struct(F.lit(1).alias("new"), F.col("ord").cast("long").alias("at")).alias("by")))
    first = both.groupBy(key, number, "image").agg(F.min("by").alias("by"))
    lists = first.groupBy(key, number).agg(F.transform(F.array_sort(F.collect_list(F.struct("by", "image"))), lambda x: x["image"]).alias("now"))
    return items.join(lists, [key, number], "left").withColumn(images, F.coalesce("now", F.array().cast("array<string>"))).drop("now")


def replay_verdicts(items: DataFrame, verdicts: DataFrame, keys: list[str], text: str, answer: str, head: int = 200) -> DataFrame:
    """items with status and stale of their verdict (keys, status, text_at, answer_at); null where there is none.

    Stale: the first characters of the text changed, both being non-empty, or the answer changed.
    """
    start = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, head)
    was, now = start(F.col("text_at")), start(F.col(text))
    stale = ((was != "") & (now != "") & (was != now)) | (F.coalesce("answer_at", F.lit("")) != F.coalesce(F.col(answer).cast("string"), F.lit("")))
    joined = items.join(verdicts.withColumn("judged", F.lit(True)), keys, "left")
    return joined.withColumn("stale", F.when(F.col("judged"), stale)).drop("judged", "text_at", "answer_at")


def delete_document(items: DataFrame, adds: DataFrame, deletes: DataFrame, key: str, number: str, doc: Column) -> tuple[DataFrame, DataFrame]:
    """(adds, deletes) after a whole document goes: its own adds are dropped, its other items are recorded as deletes."""
    here = adds.where(F.col(key) == doc).select(number)
    gone = items.where(F.col(key) == doc).select(key, number).join(here, number, "left_anti")
    return adds.where(~(F.col(key).eqNullSafe(doc))), deletes.select(key, number).union(gone.select(key, number)).distinct()


def patch_state(feed: DataFrame, keys: list[str], field: str, value: str, order: Column, deleted: Column) -> DataFrame:
    """(keys, field, value): the last value of each field since the item's last delete marker; deleted items have no rows."""
    rows = feed.select(*keys, F.col(field).alias("field"), F.col(value).alias("value"), order.alias("by"), deleted.alias("gone"))
    ends = rows.where("gone").groupBy(*keys).agg(F.max("by").alias("end"))
    live = rows.where("not gone and field is not null").join(ends, keys, "left").where("end is null or by > end")
    return live.groupBy(*keys, "field").agg(F.max_by("value", "by").alias("value"))


def changed_items(old: DataFrame, new: DataFrame, keys: list[str], stamp: str, editor: str) -> DataFrame:
    """(keys, editor) of items stamped in new whose stamp in old differs or is missing; removed items are not reported."""
    was = old.where(F.col(stamp).isNotNull()).groupBy(*keys).agg(F.max(stamp).alias("was"))
    now = new.where(F.col(stamp).isNotNull()).groupBy(*keys).agg(F.max(F.struct(F.col(stamp).alias("at"), F.col(editor).alias("editor"))).alias("now"))
    return now.join(was, keys, "left").where(~F.col("now.at").eqNullSafe(F.col("was"))).select(*keys, F.coalesce("now.editor", F.lit("unknown")).alias("editor"))


def change_summary(changed: DataFrame, group: str, number: str, listed: int = 8) -> DataFrame:
    """(group, summary): up to listed changes are named per editor, more are counted with the most frequent editor.

    The names are collected for small groups only, so no list grows with the number of changes.
    """
    per = changed.groupBy(group, "editor").agg(F.count("*").alias("n"))
    totals = per.groupBy(group).agg(F.sum("n").alias("n"), F.max_by("editor", F.struct("n", "editor")).alias("most"))
    few = changed.join(totals.where(F.col("n") <= listed).select(group), group, "left_semi")
    named = few.groupBy(group, "editor").agg(F.array_join(F.array_sort(F.collect_list(F.col(number).cast("string"))), ",").alias("q"))
    part = F.concat(F.lit("Q"), "q", F.lit(" edited by "), "editor")
    text = named.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(part)), "; ").alias("text"))
    many = F.concat(F.col("n").cast("string"), F.lit(" questions edited (mostly by "), "most", F.lit(")"))
    return totals.join(text, group, "left").select(group, F.coalesce("text", many).alias("summary"))


def effective_meta(docs: DataFrame, overrides: DataFrame, key: str, guesses: dict[str, Column]) -> DataFrame:
    """(key, fields): an override's value where it has one, an empty one too, else the guess."""
    own = overrides.select(key, *[F.col(f).alias(f"own_{f}") for f in guesses])
    guessed = docs.select(key, *[g.alias(f) for f, g in guesses.items()])
    return guessed.join(own, key, "left").select(key, *[F.coalesce(f"own_{f}", f).alias(f) for f in guesses])


def replace_docs(cached: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """cached rows of documents that the fresh run does not have, and the fresh rows."""
    return cached.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def restore(current: DataFrame, snapshots: DataFrame, key: str, doc: Column, saved_at: str, at: Column) -> DataFrame:
    """current with one document's rows replaced by those of its snapshot; without such a snapshot it stays as it is."""
    snapshot = snapshots.where((F.col(key) == doc) & (F.col(saved_at) == at)).drop(saved_at)
    return replace_docs(current, snapshot, key)


def restore_parts(current: dict[str, DataFrame], snapshots: dict[str, DataFrame], held: DataFrame, key: str, doc: Column, saved_at: str, at: Column) -> dict[str, DataFrame]:
    """Every part (a table: items, edits, manual choices) of current with one document's rows as they were in its snapshot at a time.

    held (key, saved_at, part) says which parts a snapshot has, empty ones too: those are replaced, by nothing if they were empty; others stay as they are.
    """
    asked = held.where((F.col(key) == doc) & (F.col(saved_at) == at))
    out = {}
    for part, rows in current.items():
        there = asked.where(F.col("part") == part).select(key).distinct()
        saved = snapshots[part].where((F.col(key) == doc) & (F.col(saved_at) == at)).drop(saved_at).join(there, key, "left_semi")
        out[part] = rows.join(there, key, "left_anti").unionByName(saved, allowMissingColumns=True)
    return out


def list_snapshots(snapshots: DataFrame, key: str, saved_at: str) -> DataFrame:
    """(key, saved_at, items, rank): the snapshots of each document, newest first."""
    per = snapshots.groupBy(key, saved_at).agg(F.count("*").alias("items"))
    newer = per.groupBy(key).agg(F.sort_array(F.collect_list(saved_at), asc=False).alias("all"))
    return per.join(newer, key).select(key, saved_at, "items", F.array_position("all", F.col(saved_at)).alias("rank"))


def expire(snapshots: DataFrame, saved_at: str, days: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): snapshots of the last days, and how many rows were removed and kept."""
    fresh = F.col(saved_at) >= now - F.make_interval(days=F.lit(days))
    counts = snapshots.agg(F.count_if(~fresh).alias("removed"), F.count_if(fresh).alias("kept"))
    return snapshots.where(fresh), counts


def backfill_audit(items: DataFrame, meta: DataFrame, key: str, by: str, at: str, user: Column, now: Column) -> DataFrame:
    """items with an editor and a time where they had none (null or empty): the user, and the document's time or else now."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    joined = items.join(meta.select(key, F.col(at).alias("doc_at")), key, "left")
    filled = joined.withColumns({by: F.when(blank(by), user).otherwise(F.col(by)), at: F.when(blank(at), F.coalesce("doc_at", now)).otherwise(F.col(at))})
    return filled.select(*items.columns)
