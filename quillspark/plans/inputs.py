"""Inputs derived from the test tables, in SQL that Spark and DuckDB both read.

The tables have no page layouts, sheets or tasks of their own, so these are
computed from their integers. Backslashes are written as chr(92).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import configure

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_TYPES = (
    "text", "image", "image_caption", "text", "table", "table_footnote", "title", "list", "list_item", "table_caption", "equation", "header",
    "code", "image_footnote", "ref_text", "chart", "page_number", "algorithm", "phonetic", "image_block", "aside_text", "code_caption", "text", "equation_block",
)
_CASE = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES))
_B = "chr(92)"

#: Blocks of layouts: page of a document, place, type, corners 0..1000 (some over), rotation, continuation.
SEGMENTS = f"""
SELECT doc, page_idx, seg, type, a1, b1, a2, b2, rotation, contd, 612 AS point_w, 792 AS point_h, pk, sk FROM (
SELECT CAST(floor(l_orderkey / 16.0) AS BIGINT) AS doc, CAST(floor((l_orderkey % 16) / 4.0) AS INT) AS page_idx,
CAST(row_number() OVER (PARTITION BY CAST(floor(l_orderkey / 4.0) AS BIGINT) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS seg,
CASE l_partkey % {len(_TYPES) + 1} {_CASE} ELSE 'inline_formula' END AS type,
CAST((l_partkey * 7 + l_suppkey) % 1003 AS INT) AS a1, CAST((l_suppkey * 13 + l_linenumber * 97) % 1001 AS INT) AS b1,
CAST((l_partkey * 11 + l_linenumber * 101) % 1001 AS INT) AS a2, CAST((l_suppkey * 17 + 300) % 1001 AS INT) AS b2,
CASE l_suppkey % 5 WHEN 1 THEN 'up' WHEN 2 THEN 'right' WHEN 3 THEN 'down' ELSE '' END AS rotation,
CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS contd, l_partkey AS pk, l_suppkey AS sk
FROM lineitem) q"""

#: Recognised blocks in points, as they come out of layout and recognition.
BLOCKS = f"""
SELECT doc, page_idx, seg AS idx, pk, type, CAST(least(a1, a2) AS BIGINT) AS x1, CAST(least(b1, b2) AS BIGINT) AS y1, CAST(greatest(a1, a2) AS BIGINT) + 1 AS x2, CAST(greatest(b1, b2) AS BIGINT) + 1 AS y2,
CASE rotation WHEN 'right' THEN 90 WHEN 'down' THEN 180 ELSE 0 END AS angle,
CASE WHEN type = 'text' THEN contd = 1 END AS merge_prev, 1003 AS point_w, 1001 AS point_h,
CASE WHEN type = 'table' THEN concat('<fcel>', CAST(pk AS VARCHAR(20)), ' & <b<fcel>two<nl><ecel><lcel><fcel>x"y', CASE WHEN sk % 2 = 0 THEN '<nl>' ELSE '' END)
WHEN type = 'equation' THEN CASE sk % 3 WHEN 0 THEN concat({_B}, '[ x^', CAST(pk AS VARCHAR(20)), ' ', {_B}, ']') WHEN 1 THEN concat({_B}, '[y') ELSE ' z ' END
WHEN type IN ('image', 'chart') THEN CASE sk % 3 WHEN 0 THEN ' seen ' WHEN 1 THEN 'a<fcel>b' ELSE '  ' END
WHEN type = 'title' THEN concat(' Head ', CAST(sk AS VARCHAR(20)), ' ')
ELSE CASE sk % 9 WHEN 0 THEN concat('# mark ', CAST(pk AS VARCHAR(20))) WHEN 1 THEN concat('a*b_c ', {_B}, '* d$ line-') WHEN 2 THEN 'lower follows-' WHEN 3 THEN 'Upper follows' WHEN 4 THEN concat('so ', {_B}, '( x+1 ', {_B}, ') is ', {_B}, '(y', {_B}, ')')
WHEN 5 THEN concat('- item ', {_B}, '[1', {_B}, ']') WHEN 6 THEN concat('{chr(0x4E2D)}{chr(0x6587)} ', CAST(pk AS VARCHAR(20))) WHEN 7 THEN '   ' ELSE concat('plain ', CAST(pk AS VARCHAR(20))) END END AS content
FROM ({SEGMENTS}) s WHERE type <> 'inline_formula'"""

#: Sheet cells of each supplier's nation, with blank edges.
CELLS = """
SELECT CAST(s_nationkey AS BIGINT) AS sheet, CAST(s_suppkey % 7 AS INT) + 2 AS "row", CAST(floor(s_suppkey / 7.0) AS INT) % 5 + 1 AS "col",
max(CASE WHEN s_suppkey % 3 = 0 THEN '  ' ELSE concat(s_name, ' <', CAST(s_suppkey AS VARCHAR(20)), '>') END) AS "text" FROM supplier GROUP BY 1, 2, 3"""
MERGES = """
SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS sheet, CAST(s_suppkey % 7 AS INT) + 2 AS m_r0, CAST(floor(s_suppkey / 7.0) AS INT) % 5 + 1 AS m_c0,
CAST(s_suppkey % 7 AS INT) + 3 AS m_r1, CAST(floor(s_suppkey / 7.0) AS INT) % 5 + 2 AS m_c1 FROM supplier WHERE s_suppkey % 11 = 0"""

#: Orders as parse tasks: O pending, F completed or failed, P processing.
TASKS = """
SELECT o_orderkey AS task_id, CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' THEN 'processing' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'completed' END AS status,
o_orderpriority AS backend, o_orderkey AS submit_order, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS completed_at, CAST(o_custkey % 4 AS INT) AS active_readers FROM orders"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the above. Table names are replaced by the tables' files; quotes by backquotes."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"FROM {t}" in sql}
    text = sql.replace('"', "`").replace("VARCHAR(20)", "STRING") if '<b<fcel>' not in sql else sql.replace("VARCHAR(20)", "STRING")
    text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **used)
