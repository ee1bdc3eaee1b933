"""Layout strings of a page model as block rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, text

# Block types that a layout may name.
TYPES = (
    "text title table equation code algorithm aside_text ref_text phonetic list_item table_caption image_caption code_caption "
    "table_footnote image_footnote header footer page_number page_footnote image chart list image_block equation_block unknown"
).split()
ANGLES = {"up": 0, "right": 90, "down": 180, "left": 270}
SEGMENT = r"(?s)^(\d+)\s+(\d+)\s+(\d+)\s+(\d+)<\|box_end\|><\|ref_start\|>(\w+?)<\|ref_end\|>(?:<\|rotate_(up|right|down|left)\|>)?(.*)$"
#: Types that are never sent to the recognition model, and those that are not if images are not analysed.
SKIPPED, SKIPPED_IMAGES = ("list", "equation_block", "image_block"), ("image", "chart")


def _segment(s: Column) -> Column:
    """A segment's block; its corners and groups are computed once."""
    part = lambda i: F.regexp_extract(s, SEGMENT, i)
    groups = F.struct(*[part(i).try_cast("int").alias(c) for i, c in enumerate(("a1", "b1", "a2", "b2"), 1)], F.lower(part(5)).alias("kind"), part(6).alias("turn"), part(7).alias("rest"))
    return text.let(groups, _block)


def _block(g: Column) -> Column:
    x1, y1, x2, y2 = (g[c] for c in ("a1", "b1", "a2", "b2"))
    kind = F.when(g["kind"] == "unknown", F.lit("image")).otherwise(g["kind"])
    angle = F.lit(None).cast("int")
    for name, value in ANGLES.items():
        angle = F.when(g["turn"] == name, F.lit(value)).otherwise(angle)
    # a segment that does not match has empty groups: no corners, no kind
    return F.struct(
        kind.alias("type"),
        geometry.unit(F.least(x1, x2)).alias("x1"),
        geometry.unit(F.least(y1, y2)).alias("y1"),
        geometry.unit(F.greatest(x1, x2)).alias("x2"),
        geometry.unit(F.greatest(y1, y2)).alias("y2"),
        angle.alias("angle"),
        F.when(kind == "text", g["rest"].contains("txt_contd_tgt")).alias("merge_prev"),
        (x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull() & (F.greatest(x1, y1, x2, y2) <= 1000) & (x1 != x2) & (y1 != y2) & kind.isin(*TYPES)).alias("fine"),
    )


def parse(pages: DataFrame, layout: str = "layout") -> DataFrame:
    """pages without the layout column, a row for each valid block, with block_index counted over the valid ones.

    Arrays of a page are taken apart in place, so there is no shuffle.
    """
    segments = F.transform(F.split(F.col(layout), r"<\|box_start\|>"), lambda s: text.trim(s))
    blocks = F.filter(F.transform(F.filter(segments, lambda s: s != ""), _segment), lambda b: b["fine"])
    keep = [c for c in pages.columns if c != layout]
    rows = pages.select(*keep, F.posexplode(blocks).alias("block_index", "__b"))
    return rows.select(*keep, "block_index", *[F.col(f"__b.{c}").alias(c) for c in ("type", "x1", "y1", "x2", "y2", "angle", "merge_prev")])


def to_points(blocks: DataFrame, width: str = "point_w", height: str = "point_h") -> DataFrame:
    """Boxes in whole points; degenerate ones are dropped."""
    out = blocks
    for c, size in (("x1", width), ("y1", height), ("x2", width), ("y2", height)):
        out = out.withColumn(c, geometry.points(F.col(c), F.col(size)))
    return out.where("x2 > x1 and y2 > y1")


def to_thousandths(blocks: DataFrame, width: str = "point_w", height: str = "point_h") -> DataFrame:
    out = blocks
    for c, size in (("x1", width), ("y1", height), ("x2", width), ("y2", height)):
        out = out.withColumn(c, geometry.thousandths(F.col(c), F.col(size)))
    return out


def extract_jobs(blocks: DataFrame, image_analysis: bool = True) -> DataFrame:
    """Blocks that the recognition model gets, filtered before that stage."""
    return blocks.where(~F.col("type").isin(*SKIPPED, *(() if image_analysis else SKIPPED_IMAGES)))


def page_windows(documents: DataFrame, count: str, start: Column, end: Column, window: int) -> DataFrame:
    """Pages of each document from start to end (both from 0, end included), and the window each is in; documents without any are left out."""
    last = F.least(end, F.col(count) - 1)
    fine = (F.col(count) > 0) & (start <= end) & (start < F.col(count))
    rows = documents.where(fine).withColumn("page_idx", F.explode(F.sequence(start.cast("long"), last.cast("long"))))
    return rows.withColumn("window_id", F.floor((F.col("page_idx") - start) / max(1, window)).cast("long"))


def crop_box(page_w: Column, page_h: Column, point_w: Column, point_h: Column, box: list[Column]) -> list[Column]:
    """Pixel box of a crop, in single precision; it is empty where x2 <= x1 or y2 <= y1."""
    sx = (page_w.cast("float") / F.greatest(point_w, F.lit(1)).cast("float")).cast("float")
    sy = (page_h.cast("float") / F.greatest(point_h, F.lit(1)).cast("float")).cast("float")
    low = lambda c, s: F.greatest(F.floor((c.cast("float") * s).cast("float")), F.lit(0)).cast("long")
    high = lambda c, s, most: F.least(F.ceil((c.cast("float") * s).cast("float")), most).cast("long")
    return [low(box[0], sx), low(box[1], sy), high(box[2], sx, page_w), high(box[3], sy, page_h)]


# Size of the layout image, least edge and largest ratio of edges of a block image.
LAYOUT_PIXELS, LEAST_EDGE, MOST_RATIO = 1036, 28, 50


def block_image(page_w: Column, page_h: Column, box: list[Column], angle: Column) -> Column:
    """How a block's image is cut out and prepared, from its unit box: struct of the crop (x1, y1, x2, y2), its size after
    turning (width, height), the white canvas that long ones are laid on (canvas_w, canvas_h), the size that small ones are
    enlarged to (out_w, out_h), and error for an empty crop. Corners are computed in single precision."""
    low = lambda c, n: F.greatest(F.floor((c * n.cast("float")).cast("float")), F.lit(0)).cast("long")
    high = lambda c, n: F.least(F.ceil((c * n.cast("float")).cast("float")), n).cast("long")
    crop = F.struct(low(box[0], page_w).alias("x1"), low(box[1], page_h).alias("y1"), high(box[2], page_w).alias("x2"), high(box[3], page_h).alias("y2"), angle.alias("angle"))
    return text.let(crop, _turned)


def _turned(c: Column) -> Column:
    across, down = c["x2"] - c["x1"], c["y2"] - c["y1"]
    lies = c["angle"].isin(90, 270)
    lies = F.coalesce(lies, F.lit(False))
    sized = F.struct(F.when(lies, down).otherwise(across).alias("w"), F.when(lies, across).otherwise(down).alias("h"))
    fine = (across > 0) & (down > 0)

    def padded(s: Column) -> Column:
        short, long = F.greatest(F.least(s["w"], s["h"]), F.lit(1)), F.greatest(s["w"], s["h"])
        thin = long > short * MOST_RATIO
        other = F.ceil(long / MOST_RATIO).cast("long")
        canvas = F.struct(F.when(thin & (s["w"] <= s["h"]), other).otherwise(s["w"]).alias("w"), F.when(thin & (s["w"] > s["h"]), other).otherwise(s["h"]).alias("h"))
        return text.let(canvas, lambda k: out(s, k))

    def out(s: Column, k: Column) -> Column:
        edge = F.greatest(F.least(k["w"], k["h"]), F.lit(1))
        grown = lambda n: F.when(edge < LEAST_EDGE, F.round(n * LEAST_EDGE / edge)).otherwise(n).cast("long")
        return F.struct(
            c["x1"].alias("x1"), c["y1"].alias("y1"), c["x2"].alias("x2"), c["y2"].alias("y2"), s["w"].alias("width"), s["h"].alias("height"),
            k["w"].alias("canvas_w"), k["h"].alias("canvas_h"), grown(k["w"]).alias("out_w"), grown(k["h"]).alias("out_h"), F.when(~fine, F.lit("Invalid block crop bbox")).alias("error"),
        )

    return text.let(sized, padded)
