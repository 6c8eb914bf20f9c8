"""Boxes of evidence: of a review item's cell, of the cell's row and of its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.refs import cell_ref

TABLE = ["doc_id", "page_no", "provider", "table_id"]
ROW = [*TABLE, "row_start"]
SIDES = {"left": (F.min, "x"), "top": (F.min, "y"), "right": (F.max, "x"), "bottom": (F.max, "y")}


def points(text: Column) -> Column:
    """The points (x, y) of a box in JSON, a list of them or {"points": list}; those without x or y go. Broken text has none."""
    kind = "array<struct<x: double, y: double>>"
    plain = F.from_json(text, kind)
    found = F.when(F.ltrim(text).startswith("["), plain).otherwise(F.from_json(text, f"struct<points: {kind}>")["points"])
    return F.filter(F.coalesce(found, F.array().cast(kind)), lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def _sides(found: Column) -> dict[str, Column]:
    pick = {F.min: F.array_min, F.max: F.array_max}
    return {name: pick[how](F.transform(found, lambda p: p[axis])) for name, (how, axis) in ((n, s) for n, s in SIDES.items())}


def _whole(names: list[str]) -> Column:
    """A box of whole numbers; empty where nothing has points."""
    return F.when(F.col(names[0]).isNotNull(), F.array(*names)).otherwise(F.array().cast("array<long>"))


def boxes(reviews: DataFrame, cells: DataFrame) -> DataFrame:
    """reviews with status (bbox_only or no_bbox) and cell_bbox, row_bbox, table_bbox as [left, top, right, bottom], cut to whole numbers towards zero.

    reviews: meta_json holds source_cell_ref, which names a cell; broken or null JSON names none.
    cells: position, the parts of a reference, bbox_json; of cells with one reference the last by
    position, then bbox_json counts. Cells are shuffled once by table, narrow, and once by reference
    with their boxes. A table's cells meet in one task, in one sort that serves rows, tables and
    the choice among cells of one place, and windows spill what is too long for memory.
    """
    place, order = [*ROW, "row_end", "col_start", "col_end"], ["position", "bbox_json"]
    held = cells.select(*place, *order).repartition(*TABLE).sortWithinPartitions(*place, *order)
    # The points are a step of their own, so that JSON is read once.
    held = held.withColumn("__points", points(F.col("bbox_json")))
    held = held.withColumns(_sides(F.col("__points"))).drop("__points")
    last = F.lead(F.lit(1)).over(Window.partitionBy(*place).orderBy(*order)).isNull()
    names = {k: [f"__{k}_{n}" for n in SIDES] for k in ("cell", "row", "table")}
    made = {"__last": last} | dict(zip(names["cell"], map(F.col, SIDES)))
    for k, key in (("row", ROW), ("table", TABLE)):
        made |= {name: how(n).over(Window.partitionBy(*key)) for name, (n, (how, _)) in zip(names[k], SIDES.items())}
    sides = [n for k in names.values() for n in k]
    ref = cell_ref(*map(F.col, place))
    own = held.withColumns(made).filter("__last").select(ref.alias("__ref"), "position", F.coalesce(F.col("bbox_json") != "", F.lit(False)).alias("__filled"), *[F.col(n).cast("long").alias(n) for n in sides])
    # Names with colons can give two places one reference.
    alone = F.lead(F.lit(1)).over(Window.partitionBy("__ref").orderBy("position", "__filled", *sides)).isNull()
    found = own.withColumn("__last", alone).filter("__last AND __filled").select("__ref", *[_whole(names[k]).alias(f"{k}_bbox") for k in names], F.lit("bbox_only").alias("status"))
    asked = reviews.drop("cell_bbox", "row_bbox", "table_bbox", "status").withColumn("__ref", F.coalesce(F.get_json_object("meta_json", "$.source_cell_ref"), F.lit("")))
    return asked.join(found, "__ref", "left").withColumn("status", F.coalesce("status", F.lit("no_bbox"))).drop("__ref")


def box_coverage(cells: DataFrame, by: list[str]) -> DataFrame:
    """Tables, those with a cell that has points, and their share, by columns of the table key."""
    one = cells.groupBy(*TABLE).agg(F.max(F.size(points(F.col("bbox_json"))) > 0).alias("has"))
    return one.groupBy(*by).agg(F.count(F.lit(1)).alias("tables"), F.count_if("has").alias("with_boxes")).withColumn("coverage", F.round(F.col("with_boxes") / F.col("tables"), 4))
