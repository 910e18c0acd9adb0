"""Queries of the geometry plane. Lines of an order stand for boxes of a page, its
price and priority for its layouts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import geometry as g
from foliant.registry import query, read

BOX = "l_orderkey AS page, l_partkey AS part, l_quantity * 8.0D AS x0, l_quantity * 8.0D + 60.0D AS x1, l_linenumber * 14.0D AS top, l_linenumber * 14.0D + 10.0D AS bottom, l_returnflag || l_linestatus AS text"
KEY = "l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS box_id"
BOXES_SQL = "SELECT l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS box_id, l_orderkey AS page, l_partkey AS part, l_quantity * 8.0::DOUBLE AS x0, l_quantity * 8.0::DOUBLE + 60.0 AS x1, l_linenumber * 14.0::DOUBLE AS top, l_linenumber * 14.0::DOUBLE + 10.0 AS bottom, l_returnflag || l_linestatus AS text FROM lineitem"
LAYOUTS_SQL = "SELECT o_orderkey AS page, k AS layout_id, k * 130.0::DOUBLE AS x0, k * 130.0::DOUBLE + 160.0 AS x1, 10.0::DOUBLE AS top, 40.0::DOUBLE + (o_orderkey % 5) * 15.0 AS bottom FROM orders, range(4) r(k)"
INSIDE_SQL = f"""b AS ({BOXES_SQL}), l AS ({LAYOUTS_SQL}), j AS (SELECT b.box_id, l.layout_id, greatest(least(b.x1,l.x1)-greatest(b.x0,l.x0),0) * greatest(least(b.bottom,l.bottom)-greatest(b.top,l.top),0) AS c, (b.x1-b.x0)*(b.bottom-b.top) AS ab, (l.x1-l.x0)*(l.bottom-l.top) AS al FROM b JOIN l USING (page))"""


def boxes(spark, d):
    return read(spark, d, "lineitem").selectExpr(KEY, *BOX.split(", "))


def layouts(spark, d):
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return orders.selectExpr("page", "cast(k as bigint) AS layout_id", "k * 130.0D AS x0", "k * 130.0D + 160.0D AS x1", "10.0D AS top", "40.0D + (page % 5) * 15.0D AS bottom")


@query("jn08_best_layout", f"WITH {INSIDE_SQL} SELECT box_id, arg_max(layout_id, (c/ab, c/al, layout_id)) AS layout_id, round(max(c/ab), 6) AS inside FROM j WHERE c/ab >= 0.4 GROUP BY box_id")
def jn08(spark, d):
    return g.best_layout(boxes(spark, d), layouts(spark, d)).withColumn("inside", F.round("inside", 6))


@query("jn09_first_layout", f"WITH {INSIDE_SQL} SELECT box_id, arg_max(layout_id, (c/ab, c/al, -layout_id)) AS layout_id FROM j WHERE c/ab >= 0.2 GROUP BY box_id")
def jn09(spark, d):
    return g.best_layout(boxes(spark, d), layouts(spark, d), 0.2, last_wins=False).select("box_id", "layout_id")


@query("jn11_caption_asset", f"""WITH b AS ({BOXES_SQL}), l AS ({LAYOUTS_SQL}), j AS (SELECT b.box_id, l.layout_id, (least(b.x1,l.x1)-greatest(b.x0,l.x0))/least(b.x1-b.x0,l.x1-l.x0) AS over, greatest(l.top-b.bottom, b.top-l.bottom, 0) AS gap FROM b JOIN l USING (page))
SELECT box_id, arg_min(layout_id, (gap, layout_id)) AS layout_id FROM j WHERE over >= 0.15 AND gap <= 50 GROUP BY box_id""")
def jn11(spark, d):
    return g.nearest(boxes(spark, d), layouts(spark, d), F.lit(50.0))


@query("jn14_outside_regions", f"WITH {INSIDE_SQL} SELECT DISTINCT b.box_id, b.page FROM b WHERE b.box_id NOT IN (SELECT box_id FROM j WHERE c/ab >= 0.5)")
def jn14(spark, d):
    return g.uncovered(boxes(spark, d), layouts(spark, d)).select("box_id", "page").distinct()


@query("ag16_page_medians", f"SELECT page, median(bottom - top) AS height, median(x1 - x0) AS width, median(x0) AS left_edge FROM ({BOXES_SQL}) GROUP BY page")
def ag16(spark, d):
    return boxes(spark, d).groupBy("page").agg(F.median(F.col("bottom") - F.col("top")).alias("height"), F.median(F.col("x1") - F.col("x0")).alias("width"), F.median("x0").alias("left_edge"))


@query("ag17_page_offsets", "SELECT o_custkey AS doc, o_orderkey AS page, coalesce(sum(100.0 + o_orderkey % 7) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE AS \"offset\" FROM orders")
def ag17(spark, d):
    pages = read(spark, d, "orders").selectExpr("o_custkey AS doc", "o_orderkey AS page", "100.0D + o_orderkey % 7 AS height")
    return g.page_offsets(pages).select("doc", "page", "offset")


@query("ag18_table_bounds", f"SELECT page, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom FROM ({BOXES_SQL}) GROUP BY page")
def ag18(spark, d):
    return boxes(spark, d).groupBy("page").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))


@query("so09_artifact_order", f"SELECT DISTINCT page, box_id, printf('block-%04d', dense_rank() OVER (PARTITION BY page ORDER BY top, x0, box_id)) AS ordinal FROM ({BOXES_SQL})")
def so09(spark, d):
    from foliant.operators.blocks import artifact_order

    rows = boxes(spark, d).select("page", "top", F.col("x0").alias("left"), F.col("box_id").alias("block_id")).distinct()
    return artifact_order(rows, "page").select("page", F.col("block_id").alias("box_id"), "ordinal")


@query("so10_reading_order", f"SELECT DISTINCT page, box_id, dense_rank() OVER (PARTITION BY page ORDER BY col_id, top, x0, box_id) AS place FROM (SELECT *, CASE WHEN x0 < 200 THEN 0 ELSE 1 END AS col_id FROM ({BOXES_SQL}))")
def so10(spark, d):
    rows = boxes(spark, d).select("page", "box_id", "top", "x0").distinct().withColumn("col_id", F.when(F.col("x0") < 200, 0).otherwise(1))
    return g.reading_order(rows, columns=True).select("page", "box_id", F.col("place").cast("long").alias("place"))


@query("se02_distinct_words", f"SELECT page, text, round(x0, 2) AS x0, round(top, 2) AS top, min(box_id) AS box_id FROM ({BOXES_SQL}) GROUP BY page, text, round(x0, 2), round(x1, 2), round(top, 2), round(bottom, 2)")
def se02(spark, d):
    return g.distinct_words(boxes(spark, d)).select("page", "text", F.round("x0", 2).alias("x0"), F.round("top", 2).alias("top"), "box_id")


@query("fl09_margin_boxes", f"SELECT box_id, page FROM ({BOXES_SQL}) WHERE (top <= greatest(20.0, 6.0) OR bottom >= 100.0 - greatest(20.0, 6.0)) AND length(text) >= 2")
def fl09(spark, d):
    rows = boxes(spark, d).withColumn("text", F.concat("text", F.lit(" ")))
    return rows.filter(g.margin(rows, F.lit(100.0), F.lit(10.0))).select("box_id", "page")


@query("fl13_dirty_pages", "SELECT doc_id FROM (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|'))) AS n FROM documents) WHERE n <= 3")
def fl13(spark, d):
    """Pages without many lines that look like a table of contents."""
    marked = F.size(F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("|"))))
    return read(spark, d, "documents").filter(marked <= 3).select("doc_id")


@query("fl14_repeated_garbage", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), g AS (SELECT x FROM l GROUP BY x HAVING count(*) > 1) SELECT doc_id, count(*) AS n FROM l WHERE x NOT IN (SELECT x FROM g) GROUP BY doc_id")
def fl14(spark, d):
    """Lines of each document that stand nowhere else. The lines' owners are counted
    in one aggregate; no line is joined to its repeats."""
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    once = lines.groupBy("x").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1")
    return once.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("fl15_repeated_margins", f"""WITH b AS (SELECT DISTINCT page % 50 AS doc, page, text, top FROM ({BOXES_SQL})), k AS (SELECT doc, text FROM b WHERE top <= 20 GROUP BY doc, text HAVING count(DISTINCT page) >= 2)
SELECT doc, count(*) AS n FROM b WHERE NOT (top <= 20 AND (doc, text) IN (SELECT doc, text FROM k)) GROUP BY doc""")
def fl15(spark, d):
    rows = boxes(spark, d).select((F.col("page") % 50).alias("doc"), "page", "text", "top").distinct()
    return g.without_repeated(rows, F.col("top") <= 20).groupBy("doc").agg(F.count("*").alias("n"))


@query("wn10_same_mark_merge", """WITH l AS (SELECT doc_id, no, substr(x, 1, 1) AS mark FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)),
k AS (SELECT *, CASE WHEN lag(mark) OVER (PARTITION BY doc_id ORDER BY no) = mark THEN 0 ELSE 1 END AS new FROM l), s AS (SELECT doc_id, sum(new) OVER (PARTITION BY doc_id ORDER BY no) AS island FROM k)
SELECT doc_id, island::BIGINT AS island, count(*) AS n FROM s GROUP BY ALL""")
def wn10(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "x")).withColumn("mark", F.substring("x", 1, 1))
    w = Window.partitionBy("doc_id").orderBy("no")
    return g.islands(lines, ["doc_id"], ["no"], F.lag("mark").over(w) == F.col("mark")).groupBy("doc_id", "island").agg(F.count("*").alias("n"))


ROUTE_SQL = """SELECT page_id, CASE WHEN chars >= 80 AND font_share >= 0.8 AND NOT max_image_share >= 0.85 AND image_share < 0.3 THEN 'clean' WHEN NOT (chars >= 80 AND font_share >= 0.8) AND (max_image_share >= 0.85 OR chars < 20) THEN 'scanned' ELSE 'mixed' END AS route
FROM (SELECT page_id, length(html) % 200 AS chars, (page_id % 10) / 9.0 AS font_share, (page_id % 7) / 10.0 AS image_share, (page_id % 12) / 12.0 AS max_image_share FROM pages)"""


def routes(spark, d):
    features = read(spark, d, "pages").selectExpr("page_id", "length(html) % 200 AS chars", "(page_id % 10) / 9.0D AS font_share", "(page_id % 7) / 10.0D AS image_share", "(page_id % 12) / 12.0D AS max_image_share")
    return g.page_route(features)


@query("bl14_page_routes", ROUTE_SQL)
def bl14(spark, d):
    return routes(spark, d).select("page_id", "route")


@query("ag11_route_summary", f"SELECT count(*) AS n, count(*) FILTER (WHERE route='clean') AS clean, count(*) FILTER (WHERE route='mixed') AS mixed, count(*) FILTER (WHERE route='scanned') AS scanned, bool_and(route='clean') AS all_clean FROM ({ROUTE_SQL})")
def ag11(spark, d):
    r = F.col("route")
    return routes(spark, d).agg(F.count("*").alias("n"), *(F.count_if(r == x).alias(x) for x in ("clean", "mixed", "scanned")), F.bool_and(r == "clean").alias("all_clean"))


@query("tb01_aligned_rows", f"SELECT page, part % 3 AS lane, CASE WHEN count(*) > 4 THEN avg(top) ELSE min(top) END AS top, CASE WHEN count(*) > 4 THEN avg(bottom) ELSE max(bottom) END AS bottom FROM ({BOXES_SQL}) GROUP BY ALL")
def tb01(spark, d):
    many = F.count("*") > 4
    return boxes(spark, d).groupBy("page", (F.col("part") % 3).alias("lane")).agg(F.when(many, F.avg("top")).otherwise(F.min("top")).alias("top"), F.when(many, F.avg("bottom")).otherwise(F.max("bottom")).alias("bottom"))


@query("se04_suppression")
def se04(spark, d):
    rows = boxes(spark, d).withColumn("kind", F.substring("text", 1, 1)).withColumn("score", F.col("part") / 1000.0)
    return g.suppressed(rows.select("page", "kind", "box_id", "score", "x0", "top", "x1", "bottom")).select("page", "kind", "box_id")


@query("so08_threshold_order")
def so08(spark, d):
    return g.by_rows(boxes(spark, d).select("page", "box_id", "top", "x0"), 16.0).select("page", "box_id", "place")


@query("so11_page_columns")
def so11(spark, d):
    return g.columned(boxes(spark, d)).select("page", "box_id", "col_id")


LINES_OF_WORDS_SQL = f"""WITH RECURSIVE w AS (SELECT page, text, (top + bottom) / 2 AS mid, bottom - top AS h, row_number() OVER (PARTITION BY page ORDER BY top, x0, box_id, bottom) AS i FROM ({BOXES_SQL.replace('14.0::DOUBLE + 10.0', '5.0::DOUBLE + 10.0').replace('l_linenumber * 14.0::DOUBLE AS top', 'l_linenumber * 5.0::DOUBLE AS top')})),
r AS (SELECT page, i, 0 AS line, mid, h, text, 1 AS n_words FROM w WHERE i = 1
UNION ALL SELECT w.page, w.i, CASE WHEN near THEN r.line ELSE r.line + 1 END, CASE WHEN near THEN r.mid ELSE w.mid END, CASE WHEN near THEN greatest(r.h, w.h) ELSE w.h END, CASE WHEN near THEN r.text || ' ' || w.text ELSE w.text END, CASE WHEN near THEN r.n_words + 1 ELSE 1 END
FROM r JOIN w ON w.page = r.page AND w.i = r.i + 1, LATERAL (SELECT abs(w.mid - r.mid) <= greatest(2.0, r.h * 0.35) AS near))
SELECT page, line::INT AS line, arg_max(text, n_words) AS text, max(n_words)::INT AS n_words FROM r GROUP BY page, line"""


@query("wn07_text_lines", LINES_OF_WORDS_SQL)
def wn07(spark, d):
    """Rows 5 points apart, so that the first word's middle decides."""
    words = read(spark, d, "lineitem").selectExpr(KEY, *BOX.replace("l_linenumber * 14.0D", "l_linenumber * 5.0D").split(", "))
    return g.lines(words)
