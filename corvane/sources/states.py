"""State files of collections as they are written: one indented JSON object a file, with items, the edits upon them and shared contexts by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW = "array<struct<label:string,text:string,image:string>>"
ITEM = (
    "struct<number:string,topic:string,focus:string,text:string,choices:array<struct<letter:string,text:string>>,answer:string,images:array<string>,source:string,year:string,division:string,"
    f"page:int,context_id:string,qtype:string,matching:struct<left:{_ROW},right:{_ROW},pairs:map<string,string>>,validation:struct<status:string,rationale:string>,lastEditedBy:string,lastEditedDateTime:string>"
)
_NOTES = (
    f"struct<contexts:array<struct<id:string,title:string,text:string,images:array<string>>>,added:array<{ITEM}>,deleted:array<string>,field_overrides:map<string,string>,"
    "image_overrides:struct<assignments:map<string,string>,detached:array<string>>,lastEditedBy:string,lastEditedDateTime:string>"
)
#: Sections that old files lack are null; what the engine does not read is left out.
STATE_FILE = f"_schema_version int, questions map<string,array<{ITEM}>>, annotations map<string,{_NOTES}>, manual map<string,string>, pdf_meta map<string,struct<year:string,tournament:string>>, _corrupt_record string"


def read_state_files(spark: SparkSession, path: str, collection: Column | None = None) -> DataFrame:
    """(collection, sections) of every file below path, upgraded to version 3: sections that came with versions 2 and 3 are empty where older files lack them.

    A file is one object over many lines, so one task reads it whole, as its writer wrote it whole; files go side by side. A file that is no such object has
    _corrupt_record and nothing else. collection comes from the file's name without its ending, or is an expression over _metadata.
    """
    name = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1) if collection is None else collection
    states = spark.read.schema(STATE_FILE).json(path, multiLine=True, mode="PERMISSIVE").withColumn("collection", name)
    sound = F.col("_corrupt_record").isNull()
    old = F.coalesce("_schema_version", F.lit(1))
    filled = {}
    for c, since in (("annotations", 2), ("manual", 2), ("pdf_meta", 3)):
        filled[c] = F.when(sound & (old < since), F.coalesce(c, F.create_map().cast(states.schema[c].dataType))).otherwise(F.col(c))
    return states.withColumns({**filled, "_schema_version": F.when(sound, F.lit(3))})


def state_items(states: DataFrame) -> DataFrame:
    """(collection, doc, ord, fields of the item), ord being the item's place in its document from 0."""
    docs = states.select("collection", F.explode("questions").alias("doc", "items"))
    return docs.select("collection", "doc", F.posexplode("items").alias("ord", "item")).select("collection", "doc", "ord", "item.*")


def state_contexts(states: DataFrame) -> DataFrame:
    """(collection, doc, context_id, key, title, text, images) of shared contexts; an id is unique within its document only, so key is doc::id. Contexts without an id are left out."""
    notes = states.select("collection", F.explode("annotations").alias("doc", "a")).select("collection", "doc", F.explode("a.contexts").alias("c"))
    kept = notes.where("coalesce(c.id, '') <> ''")
    return kept.select("collection", "doc", F.col("c.id").alias("context_id"), F.concat_ws("::", "doc", "c.id").alias("key"), "c.title", "c.text", "c.images")


def state_edits(states: DataFrame) -> DataFrame:
    """(collection, doc, kind, number, field, value) of the edits on extracted items: delete; override, a row per field, value as it is written or as JSON, a
    present null being null; add, value being the whole item as JSON; attach, field being the image, a row per target; detach, field being the image."""
    notes = states.select("collection", F.explode("annotations").alias("doc", "a"))
    none = F.lit(None).cast("string")

    def rows(kind: str, exploded: DataFrame, number: Column, field: Column, value: Column) -> DataFrame:
        return exploded.select("collection", "doc", F.lit(kind).alias("kind"), number.alias("number"), field.alias("field"), value.alias("value"))

    pair = lambda c: notes.select("collection", "doc", F.explode(c).alias("k", "v"))
    one = lambda c: notes.select("collection", "doc", F.explode(c).alias("k"))
    fields = pair("a.field_overrides").select("collection", "doc", F.col("k").alias("number"), F.explode(F.from_json("v", "map<string,string>")).alias("k", "v"))
    targets = F.when(F.trim("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array("v"))
    attached = pair("a.image_overrides.assignments").select("collection", "doc", F.col("k"), F.explode(targets).alias("number"))
    out = rows("delete", one("a.deleted"), F.col("k"), none, none)
    out = out.unionByName(rows("override", fields, F.col("number"), F.col("k"), F.col("v")))
    out = out.unionByName(rows("add", one("a.added"), F.col("k.number"), none, F.to_json("k")))
    out = out.unionByName(rows("attach", attached, F.col("number"), F.col("k"), none))
    return out.unionByName(rows("detach", one("a.image_overrides.detached"), none, F.col("k"), none))
