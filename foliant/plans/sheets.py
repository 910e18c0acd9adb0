"""Queries of sheets and token budgets. A brand of parts stands for a sheet, an order
for a table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import sheets as s
from foliant.plans.documents import BLOCKS_SQL, doc_blocks
from foliant.plans.geometry import KEY
from foliant.registry import query, read

SHEET_SQL = "CASE WHEN p_brand LIKE '%3' THEN p_brand || ' Sheet' ELSE p_brand END"
ROWS_SQL = f"""r AS (SELECT {SHEET_SQL} AS sheet, row_number() OVER (PARTITION BY {SHEET_SQL} ORDER BY p_partkey) AS row, p_name AS a, CASE WHEN p_size % 3 = 0 THEN ' ' WHEN p_size % 3 = 1 THEN NULL ELSE '<' || p_size || '>' END AS b, p_type AS c FROM part)"""


def rows(spark, d):
    """Row 0 of a sheet has the headers name, size and none; every third size is blank."""
    part = read(spark, d, "part")
    sheet = F.when(part.p_brand.endswith("3"), F.concat("p_brand", F.lit(" Sheet"))).otherwise(F.col("p_brand"))
    size = F.when(F.col("p_size") % 3 == 0, " ").when(F.col("p_size") % 3 == 2, F.concat(F.lit("<"), "p_size", F.lit(">")))
    body = part.withColumn("sheet", sheet).select("sheet", F.row_number().over(Window.partitionBy("sheet").orderBy("p_partkey")).cast("long").alias("row"), F.array("p_name", size, "p_type").alias("cells"))
    top = part.select(sheet.alias("sheet")).distinct().select("sheet", F.lit(0).cast("long").alias("row"), F.array(F.lit("name"), F.lit("size"), F.lit("")).alias("cells"))
    return top.unionByName(body)


@query("sc15_sheet_sentences", f"WITH {ROWS_SQL} SELECT sheet, row, 'name：' || a || CASE WHEN trim(coalesce(b, '')) <> '' THEN '; size：' || b ELSE '' END || '; ' || c || CASE WHEN contains(lower(sheet), 'sheet') THEN '' ELSE ' ——' || sheet END AS line FROM r")
def sc15(spark, d):
    return s.sentences(rows(spark, d))


@query("sc16_sheet_rows", f"WITH {ROWS_SQL} SELECT sheet, count(*) + 1 AS n_rows FROM r GROUP BY sheet")
def sc16(spark, d):
    blank = rows(spark, d).groupBy("sheet").agg(F.max("row").alias("m")).select("sheet", (F.col("m") + 7).alias("row"), F.array(F.lit(" "), F.lit(None).cast("string")).alias("cells"))
    return s.actual_rows(rows(spark, d).unionByName(blank))


@query("sc17_sheet_html", f"""WITH {ROWS_SQL}, h AS (SELECT sheet, row, (row - 1) // 5 AS chunk, '<tr><td>' || a || '</td><td>' || replace(replace(trim(coalesce(b, '')), '<', '&lt;'), '>', '&gt;') || '</td><td>' || c || '</td></tr>' AS tr FROM r)
SELECT sheet, chunk, '<table><caption>' || sheet || '</caption><tr><th>name</th><th>size</th><th></th></tr>' || string_agg(tr, '' ORDER BY row) || '</table>' || chr(10) AS html FROM h GROUP BY sheet, chunk""")
def sc17(spark, d):
    return s.html_chunks(rows(spark, d), 5)


@query("sc18_sheet_markdown", f"WITH {ROWS_SQL} SELECT sheet, md5('| name | size |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || a || ' | ' || trim(coalesce(b, '')) || ' | ' || c || ' |', chr(10) ORDER BY row)) AS digest FROM r GROUP BY sheet")
def sc18(spark, d):
    return s.markdown(rows(spark, d)).select("sheet", F.md5("markdown").alias("digest"))


@query("sc11_html_packing", f"""WITH RECURSIVE {BLOCKS_SQL},
p AS (SELECT doc_id, pos, 0::BIGINT + CASE WHEN n > 24 THEN ceil(n / 24.0)::BIGINT - 1 ELSE 0 END AS last, 0::BIGINT AS chunk, CASE WHEN n > 24 THEN 0 ELSE n END AS used, n <= 24 AS open, CASE WHEN n > 24 THEN ceil(n / 24.0)::BIGINT ELSE 1 END AS pieces FROM n WHERE pos = 0
UNION ALL SELECT n.doc_id, n.pos, CASE WHEN n.n > 24 THEN p.last + ceil(n.n / 24.0)::BIGINT WHEN p.open AND p.used + n.n <= 24 THEN p.last ELSE p.last + 1 END, CASE WHEN n.n <= 24 AND p.open AND p.used + n.n <= 24 THEN p.last ELSE p.last + 1 END, CASE WHEN n.n > 24 THEN 0 WHEN p.open AND p.used + n.n <= 24 THEN p.used + n.n ELSE n.n END, n.n <= 24, CASE WHEN n.n > 24 THEN ceil(n.n / 24.0)::BIGINT ELSE 1 END
FROM p JOIN n ON n.doc_id = p.doc_id AND n.pos = p.pos + 1) SELECT doc_id, pos::BIGINT AS pos, chunk, pieces FROM p""")
def sc11(spark, d):
    return s.in_chunks(doc_blocks(spark, d), most=24)


@query("sc12_table_parts", """WITH RECURSIVE t AS (SELECT l_orderkey AS k, o, l_quantity::BIGINT AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY o, l_quantity) AS i FROM (SELECT *, l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS o FROM lineitem)),
p AS (SELECT k, o, i, n AS used, CASE WHEN n > 60 THEN 1 ELSE 0 END AS part FROM t WHERE i = 1 UNION ALL SELECT t.k, t.o, t.i, CASE WHEN p.used + t.n > 60 THEN t.n ELSE p.used + t.n END, p.part + CASE WHEN p.used + t.n > 60 THEN 1 ELSE 0 END FROM p JOIN t ON t.k = p.k AND t.i = p.i + 1)
SELECT k AS l_orderkey, o AS box_id, part::BIGINT AS part FROM p""")
def sc12(spark, d):
    rows_ = read(spark, d, "lineitem").select("l_orderkey", F.expr(KEY), F.col("l_quantity").cast("long").alias("n"))
    return s.in_parts(rows_, "l_orderkey", "box_id", "n", 60)


@query("bl03_table_assets", f"WITH {ROWS_SQL}, m AS (SELECT sheet, string_agg('| ' || a || ' | ' || trim(coalesce(b, '')) || ' | ' || c || ' |', chr(10) ORDER BY row) AS t, count(*) AS n FROM r GROUP BY sheet) SELECT sheet, n AS n_rows, 3 AS n_columns, 'table-' || substr(sha256(t), 1, 16) AS asset_id, 'block-0000' AS block_id, 'chunk-0000-' || substr(sha256(t), 1, 8) AS chunk_id FROM m")
def bl03(spark, d):
    return s.table_asset(rows(spark, d).filter("row > 0"), "sheet", "row").drop("markdown")
