"""From recognised blocks to reading structure: captions, lists, merged paragraphs.

All joins are within a page (equal page keys first, the spatial or positional
condition as a residual), all windows are partitioned by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from . import tables

# Block and span type of each raw type.
BLOCK_TYPE = {
    "image_caption": "caption",
    "table_caption": "caption",
    "code_caption": "caption",
    "image_footnote": "footnote",
    "table_footnote": "footnote",
    "image": "image_body",
    "image_block": "image_block_body",
    "table": "table_body",
    "chart": "chart_body",
    "code": "code_body",
    "algorithm": "code_body",
    "equation": "interline_equation",
}
SPAN_TYPE = {"image": "image", "image_block": "image", "table": "table", "chart": "chart", "equation": "interline_equation"}
TEXT_TYPES = (
    "text title ref_text phonetic header footer page_number aside_text page_footnote list image_caption table_caption code_caption image_footnote table_footnote code algorithm"
).split()
DISCARDED = ("header", "footer", "page_number", "aside_text", "page_footnote")
MAIN = {"image_body": "image", "image_block_body": "image", "table_body": "table", "chart_body": "chart", "code_body": "code"}
CHILD = ("caption", "footnote")
BOX = ("x1", "y1", "x2", "y2")
SPAN = "struct<type:string,content:string,html:string,image_path:string>"


def _lookup(c: Column, table: dict[str, str], other: Column) -> Column:
    out = other
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def post_process(raw: DataFrame) -> DataFrame:
    """List items become text, tables HTML, equations bracketed, image contents cleaned; equation blocks go."""
    kind = F.col("type")
    content = F.col("content")
    content = (
        F.when(kind == "table", tables.otsl_to_html(content))
        .when(kind == "equation", text.bracket_equation(text.clean_equation(content)))
        .when(kind.isin("image", "chart"), text.clean_image_content(content))
        .otherwise(content)
    )
    return raw.withColumn("content", content).withColumn("type", F.when(kind == "list_item", F.lit("text")).otherwise(kind)).where("type <> 'equation_block'")


def spans(kind: Column, content: Column) -> Column:
    """The spans of a block's one line: array of SPAN."""
    whole = F.coalesce(content, F.lit(""))
    one = F.struct(
        F.when(kind.isin(*TEXT_TYPES), F.lit("text")).otherwise(_lookup(kind, SPAN_TYPE, F.lit("unknown"))).alias("type"),
        F.when(kind == "table", F.lit(None)).when(kind.isin("image", "chart"), whole).when(kind == "equation", text.clean_equation(whole)).otherwise(text.clean_text(kind, whole)).alias("content"),
        F.when(kind == "table", whole).alias("html"),
        F.lit(None).cast("string").alias("image_path"),
    )
    many = F.transform(text.inline_spans(whole), lambda s: F.struct(s["type"].alias("type"), s["content"].alias("content"), F.lit(None).cast("string").alias("html"), F.lit(None).cast("string").alias("image_path")))
    return F.when(kind.isin(*TEXT_TYPES) & text.has_inline_equations(whole), many).otherwise(F.array(one))


def to_blocks(raw: DataFrame, page: list[str]) -> DataFrame:
    """Typed blocks (points) with spans; pos is the place among the blocks of the page that are left.

    With a column page_md5 (of the page's pixels) spans that are cropped get the name of the crop.
    """
    kind = F.col("type")
    own = spans(kind, F.col("content"))
    if "page_md5" in raw.columns:
        box = [F.col(c) for c in BOX]
        named = lambda s: s.withField("image_path", F.when(s["type"].isin("image", "table", "chart", "interline_equation"), text.crop_name(s["type"], F.col("page_md5"), F.col(page[-1]), box)))
        own = F.transform(own, named)
    out = raw.withColumn("spans", own).withColumn("sub_type", F.when(kind.isin("code", "algorithm"), kind))
    out = out.withColumn("guess_lang", F.when(kind.isin("code", "algorithm"), F.lit("txt"))).withColumn("angle", F.coalesce("angle", F.lit(0)))
    out = out.withColumn("type", _lookup(kind, BLOCK_TYPE, kind)).drop("content")
    return out.withColumn("pos", F.row_number().over(Window.partitionBy(*page).orderBy("idx")) - 1)


def with_parents(blocks: DataFrame, page: list[str]) -> DataFrame:
    """blocks with v_idx: for each caption or footnote the index of its visual block, null if there is none, and for other blocks.

    A candidate has only captions (for a footnote: captions and footnotes)
    between it and the child, so it is the last visual block before or the
    first one after: counts of other blocks up to both places are equal. A
    footnote does not come before its parent. The nearer wins by place, then by
    distance of the boxes, then by index.
    """
    w = Window.partitionBy(*page).orderBy("pos")
    upto, kind = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), F.col("type")
    counted = blocks.withColumn("__nc", F.sum((kind != "caption").cast("int")).over(upto)).withColumn("__nf", F.sum((~kind.isin(*CHILD)).cast("int")).over(upto))
    main = F.when(kind.isin(*MAIN), F.struct("pos", "idx", *BOX, F.col("__nc").alias("nc"), F.col("__nf").alias("nf")))
    counted = counted.withColumn("__l", F.last(main, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__r", F.first(main, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    # neither a child nor the blocks between count; a visual block counts in both sums
    left = F.when(kind == "caption", F.col("__nc") == F.col("__l.nc")).otherwise((F.col("__nf") == F.col("__l.nf")) & (F.col("idx") > F.col("__l.idx")))
    right = F.when(kind == "caption", F.col("__r.nc") - 1 == F.col("__nc")).otherwise((F.col("__r.nf") - 1 == F.col("__nf")) & (F.col("idx") > F.col("__r.idx")))
    rank = lambda m: F.struct(F.abs(F.col(f"{m}.pos") - F.col("pos")).alias("gap"), geometry.distance([F.col(c) for c in BOX], [F.col(f"{m}.{c}") for c in BOX]).alias("away"), F.col(f"{m}.idx").alias("idx"))
    best = F.least(F.when(left, rank("__l")), F.when(right, rank("__r")))
    return counted.withColumn("v_idx", F.when(kind.isin(*CHILD), best["idx"])).drop("__nc", "__nf", "__l", "__r")


def visual_parents(blocks: DataFrame, page: list[str]) -> DataFrame:
    """(page, idx, type, parent_idx) of each caption and footnote; see with_parents."""
    return with_parents(blocks, page).where(F.col("type").isin(*CHILD)).select(*page, "idx", "type", F.col("v_idx").alias("parent_idx"))


def with_lists(blocks: DataFrame, page: list[str], least: float = 0.8) -> DataFrame:
    """blocks with list_idx: for each text or reference the first list of its page that covers `least` of it. A page's lists are one array."""
    lists = F.collect_list(F.when(F.col("type") == "list", F.struct("idx", *BOX))).over(Window.partitionBy(*page))
    held = blocks.withColumn("__lists", lists)
    covering = F.filter("__lists", lambda x: geometry.overlap([F.col(c) for c in BOX], [x[c] for c in BOX]) >= least)
    return held.withColumn("list_idx", F.when(F.col("type").isin("text", "ref_text"), F.array_min(F.transform(covering, lambda x: x["idx"])))).drop("__lists")


def list_items(blocks: DataFrame, page: list[str], least: float = 0.8) -> DataFrame:
    """(page, idx, list_idx): each text or reference that is in a list."""
    return with_lists(blocks, page, least).where("list_idx is not null").select(*page, "idx", "list_idx")


def list_kinds(items: DataFrame, page: list[str]) -> DataFrame:
    """The most frequent type of each list's items; ties: the type that comes first."""
    counts = items.groupBy(*page, "list_idx", "type").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    return counts.groupBy(*page, "list_idx").agg(F.max_by("type", F.struct("n", -F.col("first"))).alias("sub_type"), F.sum("n").alias("n_items"))


def merge_previous(blocks: DataFrame, page: list[str]) -> DataFrame:
    """group_idx of each text block: itself, or the nearest earlier text block that starts a paragraph.

    Gaps and islands over the text blocks of a page; other types in between do not end a paragraph.
    """
    w = Window.partitionBy(*page).orderBy("idx")
    starts = ~F.coalesce("merge_prev", F.lit(False)) | (F.row_number().over(w) == 1)
    return blocks.where("type = 'text'").withColumn("__s", starts).withColumn("group_idx", F.max(F.when(F.col("__s"), F.col("idx"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__s")


def assemble(blocks: DataFrame, page: list[str]) -> DataFrame:
    """One row for each top-level block: type, box, lines (array of spans arrays), children (array of blocks), discarded.

    Children are the body, captions and footnotes of a visual block, or the items of a list.
    """
    rows, kind = with_parents(blocks, page), F.col("type")
    lone = kind.isin(*CHILD) & F.col("v_idx").isNull()
    rows = rows.withColumn("__lone", lone).withColumn("type", F.when(lone, F.lit("text")).otherwise(kind)).withColumn("merge_prev", F.when(~F.col("__lone"), F.col("merge_prev"))).drop("__lone")
    main = _lookup(kind, MAIN, F.lit(None))
    rows = with_lists(rows, page).withColumn("owner", F.coalesce(F.when(main.isNotNull() | (kind == "list"), F.col("idx")), F.col("v_idx"), F.col("list_idx")))
    # windows within the page's partition: no join, and one shuffle for all of them
    own = F.struct("idx", kind, "spans", "sub_type", "guess_lang", *BOX, "angle")
    held = F.collect_list(F.when(F.col("owner").isNotNull() & (kind != "list"), own)).over(Window.partitionBy(*page, "owner"))
    top = rows.withColumn("children", F.array_sort(held)).where("v_idx is null and list_idx is null")
    count = lambda t: F.filter("children", lambda c: c["type"] == t)
    kinds = F.transform(F.array_distinct(F.transform("children", lambda c: c["type"])), lambda t: F.struct(F.size(count(t)).alias("n"), (-F.array_min(F.transform(count(t), lambda c: c["idx"]))).alias("first"), t.alias("type")))
    top = top.withColumn("list_kind", F.when(kind == "list", F.array_max(kinds)["type"])).withColumn("__text", kind == "text")
    w = Window.partitionBy(*page, "__text").orderBy("idx")
    starts = ~F.coalesce("merge_prev", F.lit(False)) | (F.row_number().over(w) == 1)
    top = top.withColumn("__starts", starts).withColumn("__group", F.max(F.when(F.col("__starts"), F.col("idx"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = F.array_sort(F.collect_list(F.when(F.col("__text"), F.struct("idx", "spans"))).over(Window.partitionBy(*page, "__text", "__group")))
    top = top.withColumn("merged", merged)
    none = F.array().cast("array<array<" + SPAN + ">>")
    own_lines = F.when(F.col("idx") == F.col("__group"), F.transform("merged", lambda x: x["spans"])).otherwise(none)
    out_lines = F.when(F.col("__text"), own_lines).when((kind == "list") | main.isNotNull(), none).otherwise(F.array("spans"))
    parent = F.coalesce(main, kind)
    named = F.transform(
        "children",
        lambda c: c.withField("type", F.when(c["type"] == "caption", F.concat(parent, F.lit("_caption"))).when(c["type"] == "footnote", F.concat(parent, F.lit("_footnote"))).when(c["type"] == "image_block_body", F.lit("image_body")).otherwise(c["type"])),
    )
    out = top.select(*page, "idx", parent.alias("type"), *BOX, "angle", out_lines.alias("lines"), named.alias("children"), F.coalesce("list_kind", "sub_type").alias("sub_type"), "guess_lang", "merge_prev", kind.isin(*DISCARDED).alias("discarded"))
    return out.where((F.col("type") != "list") | (F.size("children") > 0))
