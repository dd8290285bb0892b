"""Images, lines and items by their place on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.lookup import needle, pages_with


def assign_images(rows: DataFrame, doc: str, order: list[str], page: str, number: Column, image: Column, explicit: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(doc, page, image, number): the item that each image belongs to.

    The item is that of explicit (doc, image, number) if given, where PREV means the last item before the page; else the last one that starts at
    or before the image in order, on earlier pages too. A page's items and images are sorted in one window of that page; what earlier pages
    end with is carried in as a row per page, so a long document is as many tasks as it has pages. With known (doc, number), an image whose number no item of
    its document has is left out; as starts carry numbers without suffixes, of repeated numbers it is the first item's.
    """
    base = rows.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.struct(*order).alias("by"), number.alias("number"), image.alias("image"))
    upto = Window.partitionBy("doc", "page").orderBy("by").rowsBetween(Window.unboundedPreceding, 0)
    own = base.withColumn("own", F.last("number", ignorenulls=True).over(upto)).where("image is not null")
    ends = base.groupBy("doc", "page").agg(F.max_by("number", F.when(F.col("number").isNotNull(), F.col("by"))).alias("end"))
    earlier = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("doc", "page", F.last("end", ignorenulls=True).over(earlier).alias("before"))
    out = own.join(carried, ["doc", "page"])
    if explicit is None:
        chosen = F.coalesce("own", "before")
    else:
        out = out.join(explicit.select(F.col(doc).alias("doc"), "image", F.col("number").alias("said")), ["doc", "image"], "left")
        chosen = F.when(F.col("said") == "PREV", F.col("before")).otherwise(F.coalesce("said", "own", "before"))
    out = out.select("doc", "page", "image", chosen.alias("number"))
    if known is not None:
        out = out.join(known.select(F.col(doc).alias("doc"), "number").distinct(), ["doc", "number"], "left_semi")
    return out.select(F.col("doc").alias(doc), F.col("page").alias(page), "image", "number")


def assign_interval(rows: DataFrame, points: DataFrame, keys: list[str], y: str, point_y: str) -> DataFrame:
    """rows with image: row i owns [y, the next row's y) within its keys and takes the first image whose point lies there, the lowest name of equals.

    A running last row over rows and points together, so no range join is needed.
    """
    starts = rows.select(*keys, F.col(y).alias("y"), F.lit(0).alias("kind"), F.col(y).alias("row_y"), F.lit(None).cast("string").alias("image"))
    marks = points.select(*keys, F.col(point_y).alias("y"), F.lit(1).alias("kind"), F.lit(None).cast(rows.schema[y].dataType).alias("row_y"), "image")
    within = Window.partitionBy(*keys).orderBy("y", "kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = starts.union(marks).withColumn("row_y", F.last("row_y", ignorenulls=True).over(within)).where("kind = 1 and row_y is not null")
    first = placed.groupBy(*keys, "row_y").agg(F.min(F.struct("y", "image"))["image"].alias("image"))
    return rows.join(first.withColumnRenamed("row_y", y), [*keys, y], "left")


def region_boxes(lines: DataFrame, keys: list[str], number: Column) -> DataFrame:
    """(keys, number, x0, y0, x1, y1): from each line with a number to the next such line: the outermost edges of the lines that start there, the lower
    one capped by the next region's start."""
    rows = lines.withColumn("number", number)
    order = Window.partitionBy(*keys).orderBy("y0", "x0", F.col("number").isNull())
    at = F.when(F.col("number").isNotNull(), F.struct("number", "y0"))
    rows = rows.withColumn("region", F.last(at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("region is not null")
    boxes = rows.groupBy(*keys, "region").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("y1").alias("low"))
    after = F.lead("region.y0").over(Window.partitionBy(*keys).orderBy("region.y0", "region.number"))
    return boxes.withColumn("next", after).select(*keys, "region.number", "x0", F.col("region.y0").alias("y0"), "x1", F.least("low", "next").alias("y1"))


def locate_pages(items: DataFrame, pages: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """(doc, order, page): the first page at or after the previous item's that holds the first 25 characters of the item's first 40, trimmed;
    else the first page with them; else the previous page. The first item starts from page 1.

    Items meet the pages of their own document that an index of runs of 25 characters names; the fold over a document's items runs within its row.
    """
    rows = items.select(F.col(doc).alias("doc"), F.col(order).alias("at"), needle(F.col(text)).alias("needle"))
    hits = pages_with(rows.where("needle != ''"), pages.select(F.col(doc).alias("doc"), "page", "text"))
    found = rows.join(hits.groupBy("doc", "at").agg(F.array_sort(F.collect_set("page")).alias("hits")), ["doc", "at"], "left")
    listed = found.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "hits"))).alias("items"))
    start = F.struct(F.lit(1).alias("page"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        later = F.try_element_at(F.filter(x["hits"], lambda p: p >= s["page"]), F.lit(1))
        page = F.coalesce(later, F.try_element_at(x["hits"], F.lit(1)), s["page"]).cast("int")
        return F.struct(page.alias("page"), F.concat(s["out"], page.cast("string"), F.lit(",")).alias("out"))

    located = F.split(F.aggregate("items", start, step, lambda s: s["out"]), ",")
    out = listed.select("doc", F.posexplode("items").alias("k", "x"), located.alias("located"))
    return out.select(F.col("doc").alias(doc), F.col("x.at").alias(order), F.try_element_at("located", F.col("k") + 1).cast("int").alias("page"))
