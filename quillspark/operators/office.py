"""Rendering of Office blocks, and the relational rules of packages, slides and styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import saved
from . import tables
from .render import JSON, VERSION

FULL_SLIDE_PERCENT, TINY_EMU = 98, 91_440


def span_markdown(s: Column) -> Column:
    shown = text.styled(text.office_escape(s["content"]), s["style"])
    return F.when(s["type"] == "equation_inline", F.concat(F.lit("$"), text.trim(s["content"]), F.lit("$"))).when(s["type"] == "hyperlink", F.concat(F.lit("["), shown, F.lit("]("), text.link_target(s["url"]), F.lit(")"))).otherwise(shown)


def inline_markdown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, span_markdown), "")


def inline_v2(spans: Column) -> Column:
    """Spans of nested content lists: blank ones go, unless underline or strikethrough show them."""
    shown = lambda s: ~text.blank(s["content"]) | ((s["type"] == "text") & F.arrays_overlap(s["style"], F.array(F.lit("underline"), F.lit("strikethrough"))))
    return F.transform(F.filter(spans, shown), lambda s: F.struct(s["type"].alias("type"), s["content"].alias("content"), s["url"].alias("url"), F.when(F.size(s["style"]) > 0, s["style"]).alias("style")))


def block_markdown() -> Column:
    kind = F.col("kind")
    items = F.array_join(F.transform("item_spans", lambda i: F.concat(F.lit("- "), inline_markdown(i))), "\n")
    depth = F.least(F.greatest("level", F.lit(1)), F.lit(6))
    return (
        F.when(kind == "text", inline_markdown(F.col("spans")))
        .when(kind == "title", F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), inline_markdown(F.col("spans"))))
        .when(kind.isin("table", "chart"), text.office_embedded_html(F.col("html")))
        .when(kind == "image", F.concat(F.lit("!["), text.link_text(F.col("alt")), F.lit("]("), F.col("path"), F.lit(")")))
        .when(kind == "equation", F.concat(F.lit("$$\n"), text.trim(F.col("content")), F.lit("\n$$")))
        .when(kind == "list", items)
    )


def markdown(blocks: DataFrame) -> DataFrame:
    """file, markdown: parts with a blank line between, one line end last; empty for a file without blocks."""
    part = F.struct("page_idx", "idx", block_markdown().alias("md"))
    shown = F.filter(F.array_sort(F.collect_list(part)), lambda x: x["md"].isNotNull())
    joined = F.array_join(F.transform(shown, lambda x: x["md"]), "\n\n")
    return blocks.groupBy("file").agg(F.when(F.size(shown) > 0, F.concat(joined, F.lit("\n"))).otherwise(F.lit("")).alias("markdown"))


def content_list(blocks: DataFrame) -> DataFrame:
    """blocks with item: the flat content-list entry as JSON."""
    kind, page = F.col("kind"), F.col("page_idx")
    entry = lambda name, *fields: F.to_json(F.struct(F.lit(name).alias("type"), *fields, page), JSON)
    none = F.array().cast("array<string>")
    html = text.office_embedded_html(F.col("html"))
    items = F.filter(F.transform("item_spans", inline_markdown), lambda x: ~text.blank(x))
    item = (
        F.when(kind == "text", entry("text", inline_markdown(F.col("spans")).alias("text")))
        .when(kind == "title", entry("text", inline_markdown(F.col("spans")).alias("text"), F.col("level").alias("text_level")))
        .when(kind == "table", entry("table", none.alias("table_caption"), html.alias("table_body")))
        .when(kind == "image", entry("image", F.col("path").alias("img_path"), F.col("path").alias("image_path"), none.alias("image_caption"), none.alias("image_footnote"), F.col("alt").alias("content")))
        .when(kind == "chart", entry("chart", F.lit("").alias("img_path"), html.alias("content"), none.alias("chart_caption"), none.alias("chart_footnote")))
        .when(kind == "equation", entry("equation", F.col("content").alias("text"), F.lit("latex").alias("text_format")))
        .when(kind == "list", entry("list", items.alias("list_items")))
    )
    return blocks.withColumn("item", item)


def content_list_v2(blocks: DataFrame) -> DataFrame:
    """blocks with item: the nested content-list entry as JSON."""
    kind = F.col("kind")
    entry = lambda name, *fields: F.to_json(F.struct(F.lit(name).alias("type"), F.struct(*fields).alias("content")), JSON)
    none = F.array().cast("array<string>")
    html = text.office_embedded_html(F.col("html"))
    rows = F.transform(F.filter(F.transform("item_spans", inline_v2), lambda s: F.size(s) > 0), lambda s: F.struct(F.lit("text").alias("item_type"), F.lit(0).alias("ilevel"), F.lit("-").alias("prefix"), s.alias("item_content")))
    item = (
        F.when(kind == "text", entry("paragraph", inline_v2(F.col("spans")).alias("paragraph_content")))
        .when(kind == "title", entry("title", inline_v2(F.col("spans")).alias("title_content"), F.col("level")))
        .when(kind == "table", entry("table", none.alias("table_caption"), html.alias("html"), tables.table_kind(html).alias("table_type"), tables.nest_level(html).alias("table_nest_level")))
        .when(kind == "image", entry("image", F.struct(F.col("path")).alias("image_source"), none.alias("image_caption")))
        .when(kind == "chart", entry("chart", F.struct(F.lit("").alias("path")).alias("image_source"), html.alias("content"), none.alias("chart_caption")))
        .when(kind == "equation", entry("equation_interline", F.col("content").alias("math_content"), F.lit("latex").alias("math_type")))
        .when(kind == "list", entry("list", F.lit("text_list").alias("list_type"), F.lit("unordered").alias("attribute"), rows.alias("list_items")))
    )
    return blocks.withColumn("item", item)


_MIDDLE_SPAN = "struct<type:string,content:string,url:string,style:array<string>,html:string,image_path:string>"


def _middle_spans(spans: Column) -> Column:
    kind = lambda s: F.when(s["type"] == "equation_inline", F.lit("inline_equation")).otherwise(s["type"])
    null = F.lit(None).cast("string")
    return F.transform(spans, lambda s: F.struct(kind(s).alias("type"), s["content"].alias("content"), s["url"].alias("url"), F.when(F.size(s["style"]) > 0, s["style"]).alias("style"), null.alias("html"), null.alias("image_path")))


def middle_json(blocks: DataFrame) -> DataFrame:
    """file, middle_json: all pages of a file with their blocks and what was discarded.

    Blocks and discarded ones are numbered for themselves on each page. Warnings
    and errors are no blocks; a file that has nothing else has no pages.
    """
    kind = F.col("kind")
    null = lambda t="string": F.lit(None).cast(t)
    single = lambda name, content, html=None, path=None: F.array(F.struct(F.lit(name).alias("type"), F.col(content).alias("content"), null().alias("url"), null("array<string>").alias("style"), (F.col(html) if html else null()).alias("html"), (F.col(path) if path else null()).alias("image_path")))
    line = lambda spans: F.array(F.struct(spans.cast(f"array<{_MIDDLE_SPAN}>").alias("spans")))
    part = lambda name, spans, at=null("int"): F.struct(F.lit(name).alias("type"), at.alias("index"), line(spans).alias("lines"))
    lines = F.when(kind.isin("text", "title"), line(_middle_spans(F.col("spans")))).when(kind == "equation", line(single("interline_equation", "content")))
    inner = (
        F.when(kind == "table", F.array(part("table_body", single("table", "html", html="html"))))
        .when(kind == "chart", F.array(part("chart_body", single("chart", "html", html="html"))))
        .when(kind == "image", F.array(part("image_body", single("image", "alt", path="path"))))
        .when(kind == "list", F.transform("item_spans", lambda s, i: part("text", _middle_spans(s), i)))
    )
    name = F.when(kind == "equation", "interline_equation").otherwise(kind)
    # what follows is within a file: one exchange of the blocks, before they become wider
    rows = blocks.where(~kind.isin("warning", "error")).repartition("file")
    at = F.row_number().over(Window.partitionBy("file", "page_idx", kind == "discarded").orderBy("idx")) - 1
    rows = rows.withColumn("__at", at).select("file", "page_idx", "__at", "kind", F.struct(name.alias("type"), F.col("__at").alias("index"), F.when(kind == "title", F.col("level")).alias("level"), lines.alias("lines"), inner.alias("blocks")).alias("b"), F.struct(F.lit("discarded").alias("type"), F.col("__at").alias("index"), "reason", F.regexp_replace("content", "^[^:]*: ", "").alias("detail")).alias("d"))
    pick = lambda flag, c: F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == "discarded") == flag, F.struct("__at", c))), lambda x, y: x["__at"] - y["__at"]), lambda x: x[c])
    pages = rows.groupBy("file", "page_idx").agg(pick(False, "b").alias("para_blocks"), pick(True, "d").alias("discarded_blocks"))
    info = F.array_sort(F.collect_list(F.struct("page_idx", "para_blocks", "discarded_blocks")), lambda x, y: x["page_idx"] - y["page_idx"])
    return pages.groupBy("file").agg(F.to_json(F.struct(info.alias("pdf_info"), F.lit("office").alias("_backend"), F.lit(VERSION).alias("_version_name")), JSON).alias("middle_json"))


def merge_lists(blocks: DataFrame, document: list[str]) -> DataFrame:
    """Neighbouring list blocks as one, at the first one's idx (gaps and islands); columns kind, idx, items."""
    w = Window.partitionBy(*document).orderBy("idx")
    starts = (F.col("kind") != "list") | (F.coalesce(F.lag("kind").over(w), F.lit("")) != "list")
    grouped = blocks.withColumn("__s", starts).withColumn("__g", F.sum(F.col("__s").cast("int")).over(w))
    return grouped.groupBy(*document, "__g").agg(F.min("idx").alias("idx"), F.first("kind").alias("kind"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "items"))), lambda x: x["items"])).alias("items")).drop("__g")


def resolve_part(base_part: Column, target: Column) -> Column:
    """The part that a target means: absolute, or relative with . and .."""
    folder = F.when(base_part.contains("/"), F.regexp_replace(base_part, "/[^/]*$", "/")).otherwise(F.lit(""))
    pieces = F.split(F.concat(folder, target), "/")
    walked = F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda out, x: F.when(x.isin("", "."), out).when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x))),
    )
    return F.when(target.startswith("/"), F.replace(F.regexp_replace(target, "^/+", ""), F.lit("\\"), F.lit("/"))).otherwise(F.array_join(walked, "/"))


def rels_path(part: Column) -> Column:
    folder = F.when(part.contains("/"), F.regexp_replace(part, "/[^/]*$", "/")).otherwise(F.lit(""))
    return F.concat(folder, F.lit("_rels/"), F.substring_index(part, "/", -1), F.lit(".rels"))


def content_types(parts: DataFrame, by_part: DataFrame, by_extension: DataFrame) -> DataFrame:
    """parts with content_type: that of the part name, else that of the extension."""
    ext = F.lower(F.substring_index("part_name", ".", -1))
    out = parts.join(by_part.select("part_name", F.col("content_type").alias("__p")), "part_name", "left").withColumn("extension", ext)
    out = out.join(by_extension.select("extension", F.col("content_type").alias("__e")), "extension", "left")
    return out.withColumn("content_type", F.coalesce("__p", "__e")).drop("__p", "__e", "extension")


def lookup_relationship(rows: DataFrame, rels: DataFrame) -> DataFrame:
    """rows (base_part, rel_id) with the target of the first relationship of that id."""
    first = rels.groupBy("base_part", "rel_id").agg(F.min(F.struct("ord", "target", "target_mode")).alias("r"))
    return rows.join(first.select("base_part", "rel_id", "r.target", "r.target_mode"), ["base_part", "rel_id"], "left")


def resolve_styles(styles: DataFrame) -> DataFrame:
    """style_id with resolved level (the nearest one that is not null) and is_list (any) along based_on, of any depth.

    Chains are followed by doubling: after k joins 2**k ancestors are known. It
    ends when no style has an ancestor left to look at, or, as cycles never
    come to an end, when as many ancestors are known as there are styles.
    """
    now, step = styles.select("style_id", "based_on", "level", "is_list"), 1
    most = styles.count()
    while step < most and not now.where("based_on is not null").isEmpty():
        up = now.select(F.col("style_id").alias("__u"), F.col("based_on").alias("__b"), F.col("level").alias("__l"), F.col("is_list").alias("__i"))
        now = saved(now.join(up, F.col("based_on") == F.col("__u"), "left").select("style_id", F.col("__b").alias("based_on"), F.coalesce("level", "__l").alias("level"), (F.col("is_list") | F.coalesce("__i", F.lit(False))).alias("is_list")))
        step *= 2
    return now.select("style_id", "level", "is_list")


def is_decoration(x: Column, y: Column, w: Column, h: Column, slide_w: Column, slide_h: Column) -> Column:
    """Tiny pictures, and those that fill the slide."""
    tiny = (w <= TINY_EMU) & (h <= TINY_EMU)
    full = (F.abs(x) * 100 <= slide_w) & (F.abs(y) * 100 <= slide_h) & (w * 100 >= slide_w * FULL_SLIDE_PERCENT) & (h * 100 >= slide_h * FULL_SLIDE_PERCENT)
    return F.coalesce(tiny, F.lit(False)) | F.coalesce(full, F.lit(False))


def slide_order() -> list[Column]:
    """Items by y, then x, missing ones last, then by their sequence."""
    return [F.col("y").asc_nulls_last(), F.when(F.col("y").isNotNull(), F.col("x")).asc_nulls_last(), F.col("seq").asc()]
