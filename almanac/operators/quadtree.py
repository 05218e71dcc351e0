"""Which boxes hold a place, by a quadtree that is cut deeper only where it is crowded.

Cells are counted level by level.  A cell with few places and few boxes is a leaf; its places and boxes are joined on
the leaf.  Places and boxes of the other cells go on to the next level, where only cells with places are kept.  So no
leaf holds more than a bounded number of places however they crowd, and a wide box is copied to the leaves with places
only.  The tree is a frame at every level; nothing of it is on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.session import materialise

SIDE_DEG = 1.0  # of a cell of the first level
STEP = 4  # a crowded cell is cut into so many columns and rows
PLACES, BOXES = 2_000, 64  # a cell with more is cut
LEVELS, BOX_LEVELS = 12, 6  # most levels (cells of centimetres), and those that are cut for their boxes alone


def _cell(v: Column, level: int) -> Column:
    return F.floor(v * float(STEP**level) / SIDE_DEG).cast("bigint")


def leaves(places: DataFrame, boxes: DataFrame, most_places: int = PLACES, most_boxes: int = BOXES) -> list[tuple[DataFrame, DataFrame]]:
    """Per level the places (id, x, y) and the boxes (box and bounds) of its leaves, both with the cell (i, j)."""
    x, y = F.col("x"), F.col("y")
    rest = places.select("id", "x", "y")
    bounds = ["min_x", "max_x", "min_y", "max_y"]
    laid = (
        boxes.select("box", *bounds)
        .withColumn("i", F.explode(F.sequence(_cell(F.col("min_x"), 0), _cell(F.col("max_x"), 0))))
        .withColumn("j", F.explode(F.sequence(_cell(F.col("min_y"), 0), _cell(F.col("max_y"), 0))))
    )
    out = []
    for level in range(LEVELS):
        held = rest.withColumn("i", _cell(x, level)).withColumn("j", _cell(y, level))
        n = held.groupBy("i", "j").agg(F.count("*").alias("n"))
        laid = materialise(laid.join(n.select("i", "j"), ["i", "j"], "left_semi"), "laid")
        m = laid.groupBy("i", "j").agg(F.count("*").alias("m"))
        crowded = F.col("n") > most_places
        if level < BOX_LEVELS:
            crowded = crowded | ((F.col("m") > most_boxes) & (F.col("n") > 1))
        cells = materialise(n.join(m, ["i", "j"]).select("i", "j", (crowded & F.lit(level + 1 < LEVELS)).alias("open")), "cells")
        leaf, inner = (cells.where(F.col("open") == flag).select("i", "j") for flag in (False, True))
        out.append((held.join(leaf, ["i", "j"], "left_semi"), laid.join(leaf, ["i", "j"], "left_semi")))
        if inner.isEmpty():
            break
        rest = materialise(held.join(inner, ["i", "j"], "left_semi").select("id", "x", "y"), "places")

        def inside(at: str, axis: str, level: int = level) -> Column:
            """Columns or rows of the next level that the box reaches inside its cell."""
            first = F.greatest(F.col(at) * STEP, _cell(F.col(f"min_{axis}"), level + 1))
            last = F.least(F.col(at) * STEP + STEP - 1, _cell(F.col(f"max_{axis}"), level + 1))
            return F.explode(F.sequence(first, F.greatest(first, last)))

        below = laid.join(inner, ["i", "j"], "left_semi").withColumn("_i", inside("i", "x")).withColumn("_j", inside("j", "y"))
        laid = below.select("box", *bounds, F.col("_i").alias("i"), F.col("_j").alias("j"))
    return out


def in_boxes(places: DataFrame, boxes: DataFrame, most_places: int = PLACES, most_boxes: int = BOXES) -> DataFrame:
    """(id, x, y, the columns of ``boxes``) of every place and every box whose bounds hold it.

    ``places`` are distinct (id, x, y) without nulls, ``boxes`` have ``box`` (unique) and min_x, max_x, min_y, max_y; what
    else they carry is copied to each of their leaves.
    """
    carried = [c for c in boxes.columns if c not in ("min_x", "max_x", "min_y", "max_y")]
    whole = boxes.select(*carried)
    x, y = F.col("x"), F.col("y")
    found = None
    for held, laid in leaves(places, boxes, most_places, most_boxes):
        pairs = held.join(laid.join(whole, "box"), ["i", "j"])
        part = pairs.where(x.between(F.col("min_x"), F.col("max_x")) & y.between(F.col("min_y"), F.col("max_y"))).select("id", "x", "y", *carried)
        found = part if found is None else found.unionByName(part)
    return found
