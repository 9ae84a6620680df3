"""Boxes on a page or picture."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import ordered_fold
from .many import FEW, lists_of

BOX = "struct<x:int,y:int,width:int,height:int>"
PADDING, MIN_HEIGHT, HEIGHT_RATIO = 5, 12, 0.55


def box(x, y, w, h) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"),
                    w.cast("int").alias("width"), h.cast("int").alias("height"))


def polygon_to_bbox(points: Column) -> Column:
    """Bounding box of array<struct<x,y>>."""
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def normalize_bbox(struct: Column | None = None, items: Column | None = None) -> Column:
    """Box from a struct or a four-element list; anything incomplete is null."""
    out = []
    if struct is not None:
        full = struct["x"].isNotNull() & struct["y"].isNotNull() & struct["width"].isNotNull() & struct["height"].isNotNull()
        out.append(F.when(full, box(struct["x"], struct["y"], struct["width"], struct["height"])))
    if items is not None:
        out.append(F.when(F.size(items) == 4, box(*[F.get(items, F.lit(i)) for i in range(4)])))
    return F.coalesce(*out)


def mask_rectangle(b: Column, image_width: Column, image_height: Column) -> Column:
    """Padded rectangle to cover a box, its height limited by its width."""
    w, h = F.greatest(F.lit(1), b["width"]), F.greatest(F.lit(1), b["height"])
    most = F.greatest(F.lit(MIN_HEIGHT), F.floor(w * HEIGHT_RATIO).cast("int"))
    height = F.least(h, most)
    centred = F.greatest(F.lit(0), (b["y"] + h / 2 - height / 2).cast("int"))
    top = F.when(h > most, centred).otherwise(b["y"])
    x1, y1 = F.greatest(F.lit(0), b["x"] - PADDING), F.greatest(F.lit(0), top - PADDING)
    return F.struct(
        x1.alias("x1"), y1.alias("y1"),
        F.least(image_width, x1 + w + 2 * PADDING).alias("x2"),
        F.least(image_height, y1 + height + 2 * PADDING).alias("y2"))


def _kept_boxes(share: float):
    """Column function (x, y, width, height of a page's boxes in order): which stay.

    Kept boxes are filed under the cells of grids with doubling cells: in its own grid, whose cells are as large as the
    box, and in all coarser ones, where larger boxes look. A box looks at four cells of each grid at most.
    """
    # self-contained: workers need not have this package
    @F.pandas_udf("array<boolean>")
    def run(xs: pd.Series, ys: pd.Series, ws: pd.Series, hs: pd.Series) -> pd.Series:
        def page(x, y, w, h):
            if x is None:
                return None
            boxes = [None if any(v is None or v != v for v in b) else tuple(map(int, b)) for b in zip(x, y, w, h)]
            level = [max(b[2], b[3], 1).bit_length() if b else 0 for b in boxes]
            levels, upto, own, out = sorted(set(level)), {}, {}, []

            def cells(b, k):
                for cx in range(b[0] >> k, ((b[0] + max(b[2], 1) - 1) >> k) + 1):
                    for cy in range(b[1] >> k, ((b[1] + max(b[3], 1) - 1) >> k) + 1):
                        yield k, cx, cy

            def meets(a, b):
                dx = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
                dy = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
                return dx > 0 and dy > 0 and dx * dy > min(a[2] * a[3], b[2] * b[3]) * share

            for b, n in zip(boxes, level):
                if b is None:  # a box without a place overlaps nothing
                    out.append(True)
                    continue
                hit = any(meets(a, b) for k in levels if k >= n for c in cells(b, k) for a in (upto if k == n else own).get(c, ()))
                out.append(not hit)
                if not hit:
                    for k in levels:
                        if k >= n:
                            for c in cells(b, k):
                                upto.setdefault(c, []).append(b)
                                if k == n:
                                    own.setdefault(c, []).append(b)
            return out

        return pd.Series([page(*row) for row in zip(xs, ys, ws, hs)], dtype=object)

    return run


def drop_overlapping_boxes(boxes: DataFrame, page=("doc_id", "page"), order="box_no", share=0.5) -> DataFrame:
    """Per page, drop a box that covers, or is covered by, over half of a kept one.

    A page's boxes, a few dozen bytes each, meet in one row. A few are compared with all kept ones; of many, each only
    with those in the cells that it touches.
    """
    packed = F.array_sort(F.collect_list(F.struct(F.col(order), F.col("bbox").cast(BOX).alias("bbox"))))
    pages = boxes.groupBy(*page).agg(packed.alias("__boxes"))

    def overlap(a, b):
        dx = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
        dy = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
        smaller = F.least(a["width"] * a["height"], b["width"] * b["height"])
        return (dx > 0) & (dy > 0) & (dx * dy > smaller * share)

    def step(kept, r):
        hit = F.exists(kept, lambda k: overlap(k, r["bbox"]))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(r["bbox"]))), ~hit

    many = F.size("__boxes") > FEW
    few = ordered_fold(F.when(~many, F.col("__boxes")), F.array().cast(f"array<{BOX}>"), step, "boolean")
    side = lambda n: lists_of("int", F.transform("__boxes", lambda b: b["bbox"][n]), many)
    at_once = _kept_boxes(share)(*[side(n) for n in ("x", "y", "width", "height")])
    marked = pages.withColumn("__keep", F.when(many, at_once).otherwise(few))
    rows = marked.select(*page, F.explode_outer(F.arrays_zip("__boxes", "__keep")).alias("m"))
    return rows.filter("coalesce(m.__keep, m.__boxes IS NOT NULL)").select(*page, F.col(f"m.__boxes.{order}").alias(order), F.col("m.__boxes.bbox").alias("bbox"))


#: Characters of the grams by which blocks are found; a shorter value is a gram itself.
GRAM = 4


def _grams(text: Column, sizes, asked: Column | None = None) -> Column:
    """Hashes of the different pieces of the text of each size, or of those sizes that ``asked`` holds."""
    def of(n):
        last = F.length(text) - n + 1
        return F.transform(F.when(last > 0, F.sequence(F.lit(1), last)), lambda i: F.xxhash64(F.substring(text, i, n)))

    none = F.array().cast("array<bigint>")
    return F.array_distinct(F.concat(*[
        F.coalesce(of(n) if asked is None else F.when(F.array_contains(asked, n), of(n)), none) for n in sizes]))


def attach_bbox(hits: DataFrame, blocks: DataFrame, key="doc_id", hit="hit_no") -> DataFrame:
    """First block of the document, by line, whose text holds the value.

    Blocks are filed under the short pieces of their texts. A value looks under the rarest of its own pieces in that
    document, and only the blocks found there are tested; both joins are on (document, piece), so a document of many
    values and blocks is spread. An empty value lies in the first block. All joins sort and merge: their sides grow with
    the documents, and half a dozen tables that are each just small enough to be broadcast fill a driver together.
    """
    def merged(df):
        return df.hint("merge")

    values = hits.select(F.col(key).alias("__d"), "value").distinct()
    b = blocks.select(F.col(key).alias("__d"), "line_number", F.col("text").alias("__text"), "bbox")
    # only pieces of sizes that are asked for in the document: one size, where all values are of some length
    sizes = values.filter("value <> ''").groupBy("__d").agg(F.collect_set(F.least(F.length("value"), F.lit(GRAM))).alias("__sizes"))
    filed = b.join(merged(sizes), "__d").select("__d", F.col("line_number").alias("__line"), F.explode(
        _grams(F.col("__text"), range(1, GRAM + 1), F.col("__sizes"))).alias("__g"))
    common = filed.groupBy("__d", "__g").agg(F.count("*").alias("__n"))
    # pieces of the value, all of one size: up to GRAM characters
    pieces = F.when(F.length("value") >= GRAM, _grams(F.col("value"), [GRAM])).otherwise(F.array(F.xxhash64("value")))
    asked = values.filter("value <> ''").select("__d", "value", F.explode(pieces).alias("__g"))
    rare = asked.join(merged(common), ["__d", "__g"]).groupBy("__d", "value").agg(F.min_by("__g", "__n").alias("__g"))
    near = rare.join(merged(filed), ["__d", "__g"]).select("__d", "value", F.col("__line").alias("line_number"))
    empty = values.filter("value = ''").join(merged(b.select("__d", "line_number")), "__d")
    held = near.join(merged(b.select("__d", "line_number", "__text")), ["__d", "line_number"]).filter(F.contains("__text", "value"))
    first = held.select("__d", "value", "line_number").unionByName(empty).groupBy("__d", "value").agg(F.min("line_number").alias("line_number"))
    found = first.join(merged(b.groupBy("__d", "line_number").agg(F.first("bbox").alias("bbox"))), ["__d", "line_number"])
    return hits.join(merged(found.select(F.col("__d").alias(key), "value", "bbox")), [key, "value"], "left")
