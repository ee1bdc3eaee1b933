"""Tables: OTSL token text and sheet grids as HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

TOKENS = ("<nl>", "<fcel>", "<ecel>", "<lcel>", "<ucel>", "<xcel>")
_AT_TOKENS = f"(?={'|'.join(TOKENS)})|(?<={'|'.join(TOKENS)})"


def otsl_rows(c: Column) -> Column:
    """Rows of cells. Cell tokens take the text after them; span tokens count for nothing; a last row without a line end counts if it has cells."""
    parts = F.filter(F.transform(F.split(text.trim(c), _AT_TOKENS), text.trim), lambda x: x != "")
    state = F.struct(F.array().cast("array<array<string>>").alias("rows"), F.array().cast("array<string>").alias("row"), F.lit(False).alias("open"))

    def step(s: Column, x: Column) -> Column:
        ends, cell, span = x == "<nl>", x.isin("<fcel>", "<ecel>"), x.isin("<lcel>", "<ucel>", "<xcel>")
        # a text that begins with "<" does not fill the cell before it
        fills = s["open"] & ~x.startswith("<")
        row = (
            F.when(ends, F.array().cast("array<string>"))
            .when(cell, F.concat(s["row"], F.array(F.lit(""))))
            .when(span, s["row"])
            .when(fills, F.concat(F.slice(s["row"], 1, F.size(s["row"]) - 1), F.array(x)))
            .otherwise(F.concat(s["row"], F.array(x)))
        )
        return F.struct(F.when(ends, F.concat(s["rows"], F.array(s["row"]))).otherwise(s["rows"]).alias("rows"), row.alias("row"), cell.alias("open"))

    finish = lambda end: F.when(F.size(end["row"]) > 0, F.concat(end["rows"], F.array(end["row"]))).otherwise(end["rows"])
    return F.aggregate(parts, state, step, finish)


def otsl_to_html(c: Column) -> Column:
    """Token text as a table; rows are filled up to the longest one. A text without tokens, or a finished table, stays as it is."""
    cell = lambda x: F.concat(F.lit("<td>"), text.html_escape(x), F.lit("</td>"))
    line = lambda r, width: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.repeat(F.lit("<td></td>"), width - F.size(r)), F.lit("</tr>"))
    html = lambda b: F.concat(F.lit("<table>"), F.array_join(F.transform(b["rows"], lambda r: line(r, b["width"])), ""), F.lit("</table>"))
    sized = lambda rows: F.struct(rows.alias("rows"), F.array_max(F.transform(rows, lambda r: F.size(r))).alias("width"))
    whole = text.let(otsl_rows(c), lambda rows: F.when(F.size(rows) == 0, F.lit("")).otherwise(text.let(sized(rows), html)))
    return text.let(text.trim(c), lambda plain: F.when((plain.startswith("<table") & plain.endswith("</table>")) | ~plain.rlike("<nl>|<fcel>|<ecel>|<lcel>|<ucel>|<xcel>"), plain).otherwise(whole))


def table_kind(html: Column) -> Column:
    nested = F.regexp_count(html, F.lit("<table")) > 1
    return F.when(html.contains("colspan") | html.contains("rowspan") | nested, F.lit("complex_table")).otherwise(F.lit("simple_table"))


def nest_level(html: Column) -> Column:
    return F.when(F.regexp_count(html, F.lit("<table")) > 1, F.lit(2)).otherwise(F.lit(1))


def trim_grid(cells: DataFrame, sheet: list[str]) -> DataFrame:
    """Cells (row, col, text) within the bounding box of the filled ones, moved to 0, 0; with the box and the number of filled cells."""
    filled = ~text.blank(F.col("text"))
    box = cells.where(filled).groupBy(*sheet).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("filled"))
    inside = cells.join(box, sheet).where("row between r0 and r1 and col between c0 and c1")
    return inside.withColumn("row", F.col("row") - F.col("r0")).withColumn("col", F.col("col") - F.col("c0"))


def rebase_merges(merges: DataFrame, boxes: DataFrame, sheet: list[str]) -> DataFrame:
    """Merge rectangles (m_r0, m_c0, m_r1, m_c1) relative to the box and clipped to it; those outside, or of one cell, are dropped."""
    out = merges.join(boxes.select(*sheet, "r0", "r1", "c0", "c1").distinct(), sheet).where("m_r0 >= r0 and m_c0 >= c0 and m_r0 <= r1 and m_c0 <= c1")
    out = out.select(*sheet, (F.col("m_r0") - F.col("r0")).alias("m_r0"), (F.col("m_c0") - F.col("c0")).alias("m_c0"), (F.least("m_r1", "r1") - F.col("r0")).alias("m_r1"), (F.least("m_c1", "c1") - F.col("c0")).alias("m_c1"))
    return out.where("m_r1 > m_r0 or m_c1 > m_c0")


def covered_columns(merges: DataFrame, sheet: list[str]) -> DataFrame:
    """(sheet, row, col, reach): the columns of each row that a merge covers, its own cell left out. Merges are taken apart by rows, never by cells."""
    rows = merges.withColumn("row", F.explode(F.sequence("m_r0", "m_r1")))
    first = F.col("m_c0") + F.when(F.col("row") == F.col("m_r0"), 1).otherwise(0)
    return rows.select(*sheet, "row", first.alias("col"), F.col("m_c1").alias("reach")).where("reach >= col")


def _anchors(merges: DataFrame, sheet: list[str]) -> DataFrame:
    return merges.groupBy(*sheet, F.col("m_r0").alias("row"), F.col("m_c0").alias("col")).agg(F.max(F.struct((F.col("m_r1") - F.col("m_r0") + 1).alias("rowspan"), (F.col("m_c1") - F.col("m_c0") + 1).alias("colspan"))).alias("s"))


def _swept(sheet: list[str]) -> Window:
    """The intervals and cells of a row by their first column, intervals first."""
    return Window.partitionBy(*sheet, "row").orderBy("col", F.col("reach").isNull())


def sheet_cells(grid: DataFrame, merges: DataFrame, sheet: list[str]) -> DataFrame:
    """Cells that a merge does not cover, with rowspan and colspan at its anchor.

    A cell is covered if an interval that begins at or before it reaches it: the
    largest reach so far tells, in one pass over the sorted row.
    """
    both = grid.withColumn("reach", F.lit(None).cast("int")).unionByName(covered_columns(merges, sheet), allowMissingColumns=True)
    seen = F.max("reach").over(_swept(sheet).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    left = both.withColumn("__seen", seen).where("reach is null and coalesce(__seen, -1) < col").drop("reach", "__seen")
    return left.join(_anchors(merges, sheet), [*sheet, "row", "col"], "left").select(left["*"], F.coalesce("s.rowspan", F.lit(1)).alias("rowspan"), F.coalesce("s.colspan", F.lit(1)).alias("colspan"))


def whole_grid_html(cells: DataFrame, merges: DataFrame, boxes: DataFrame, sheet: list[str], caption: str) -> DataFrame:
    """(sheet, html) of the boxes (sheet, r0, r1, c0, c1, caption): every cell that no merge covers, also where there is none in cells.

    Cells that are missing between two others, and rows without any, are written
    as often as they are missing, so no table of empty or covered cells is made.
    """
    attribute = lambda name: F.when(F.col(f"s.{name}") > 1, F.concat(F.lit(f' {name}="'), F.col(f"s.{name}").cast("string"), F.lit('"'))).otherwise(F.lit(""))
    empty = "<td></td>"
    filled = cells.select(*sheet, "row", "col", "text", F.lit(None).cast("struct<rowspan:bigint,colspan:bigint>").alias("s"))
    spans = _anchors(merges, sheet).select(*sheet, "row", "col", F.lit(None).cast("string").alias("text"), F.col("s").cast("struct<rowspan:bigint,colspan:bigint>").alias("s"))
    own = filled.unionByName(spans).groupBy(*sheet, "row", "col").agg(F.max("text").alias("text"), F.max("s").alias("s"))
    items = own.withColumn("reach", F.lit(None).cast("long")).unionByName(covered_columns(merges, sheet), allowMissingColumns=True)
    before = _swept(sheet).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.max(F.coalesce("reach", "col")).over(before), F.lit(-1))
    shut = F.coalesce(F.max("reach").over(before), F.lit(-1))
    td = F.concat(F.lit("<td"), F.coalesce(attribute("rowspan"), F.lit("")), F.coalesce(attribute("colspan"), F.lit("")), F.lit(">"), text.html_escape(F.coalesce("text", F.lit(""))), F.lit("</td>"))
    gap = F.repeat(F.lit(empty), F.greatest(F.lit(0), F.col("col") - taken - 1).cast("int"))
    items = items.select(*sheet, "row", "col", F.coalesce("reach", "col").alias("reach"), F.concat(gap, F.when(F.col("reach").isNull() & (F.col("col") > shut), td).otherwise(F.lit(""))).alias("html"), F.col("reach").isNull().alias("last"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("col", "last", "html"))), lambda x: x["html"])
    rows = items.groupBy(*sheet, "row").agg(F.array_join(pieces, "").alias("tds"), F.max("reach").alias("reach"))
    width, height = F.col("c1") - F.col("c0") + 1, F.col("r1") - F.col("r0") + 1
    rows = rows.join(boxes.select(*sheet, "c0", "c1"), sheet).select(*sheet, "row", F.concat(F.lit("<tr>"), "tds", F.repeat(F.lit(empty), (width - 1 - F.col("reach")).cast("int")), F.lit("</tr>")).alias("tr"))
    blank = F.concat(F.lit("<tr>"), F.repeat(F.lit(empty), width.cast("int")), F.lit("</tr>"))
    rows = rows.withColumn("before", (F.col("row") - F.coalesce(F.lag("row").over(Window.partitionBy(*sheet).orderBy("row")), F.lit(-1)) - 1).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct("row", "before", "tr")))
    whole = boxes.join(rows.groupBy(*sheet).agg(listed.alias("rows"), F.max("row").alias("last")), sheet)
    body = F.array_join(F.transform("rows", lambda x: F.concat(F.repeat(blank, x["before"]), x["tr"])), "")
    head = F.concat(F.lit("<table><caption>"), text.html_escape(F.col(caption)), F.lit("</caption>"))
    return whole.select(*sheet, F.concat(head, body, F.repeat(blank, (height - 1 - F.col("last")).cast("int")), F.lit("</table>")).alias("html"))


def grid_html(cells: DataFrame, sheet: list[str], caption: str) -> DataFrame:
    """(sheet, filled, html) of each sheet from sheet_cells(); rows and columns in order, a row without cells stays empty."""
    attr = lambda name: F.when(F.col(name) > 1, F.concat(F.lit(f' {name}="'), F.col(name).cast("string"), F.lit('"'))).otherwise(F.lit(""))
    td = F.concat(F.lit("<td"), attr("rowspan"), attr("colspan"), F.lit(">"), text.html_escape(F.col("text")), F.lit("</td>"))
    rows = cells.groupBy(*sheet, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", td.alias("td")))), lambda x: x["td"]), "").alias("tds"), F.first("filled").alias("filled"), F.first("r0").alias("r0"), F.first("r1").alias("r1"))
    pages = rows.groupBy(*sheet).agg(F.map_from_entries(F.collect_list(F.struct("row", "tds"))).alias("m"), F.first("filled").alias("filled"), F.first(F.col("r1") - F.col("r0")).alias("last"))
    body = F.array_join(F.transform(F.sequence(F.lit(0).cast("int"), F.col("last").cast("int")), lambda r: F.concat(F.lit("<tr>"), F.coalesce(F.try_element_at("m", r), F.lit("")), F.lit("</tr>"))), "")
    head = F.concat(F.lit("<table><caption>"), text.html_escape(F.col(caption)), F.lit("</caption>"))
    return pages.select(*sheet, "filled", F.concat(head, body, F.lit("</table>")).alias("html"))

