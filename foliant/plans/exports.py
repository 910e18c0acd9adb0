"""Queries of records that leave the store. Lines of an order stand for its chunks,
parts for assets, orders for documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import exports as x
from foliant.plans.documents import BLOCKS_SQL, doc_blocks
from foliant.plans.geometry import KEY
from foliant.registry import query, read

CHUNK_SQL = "SELECT DISTINCT l_orderkey AS document_id, l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS chunk_id, [l_partkey, l_partkey + 7, l_partkey + 5000000, l_partkey] AS refs FROM lineitem"
ASSET_SQL = "SELECT p_partkey AS asset_id, lower(p_type) AS asset_type, CASE WHEN p_size > 10 THEN 'a/' || p_partkey END AS download_path, CASE WHEN p_size > 30 THEN 'http://s/' || p_partkey ELSE '' END AS resolved_url FROM part"
RECORD_SQL = f"""c AS ({CHUNK_SQL}), a AS ({ASSET_SQL}), e AS (SELECT chunk_id, unnest(refs) AS asset_id, generate_subscripts(refs, 1) AS no FROM c),
j AS (SELECT e.chunk_id, e.no, a.* FROM e JOIN a USING (asset_id))"""


def chunks(spark, d):
    refs = F.transform(F.array(F.col("l_partkey"), F.col("l_partkey") + 7, F.col("l_partkey") + 5000000, F.col("l_partkey")), lambda r: r.cast("string"))
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.expr(KEY.replace("box_id", "chunk_id")), refs.alias("asset_refs")).distinct()


def assets(spark, d):
    key = F.col("p_partkey").cast("string")
    return read(spark, d, "part").select(key.alias("asset_id"), F.lower("p_type").alias("asset_type"), F.when(F.col("p_size") > 10, F.concat(F.lit("a/"), key)).alias("download_path"), F.when(F.col("p_size") > 30, F.concat(F.lit("http://s/"), key)).otherwise("").alias("resolved_url"))


@query("pj07_chunk_records", f"WITH {RECORD_SQL} SELECT c.chunk_id, coalesce((list(j.asset_id::VARCHAR || '/' || j.asset_type || '/' || coalesce(j.download_path, '-') ORDER BY j.no) FILTER (WHERE j.no IS NOT NULL)), []) AS assets FROM c LEFT JOIN j USING (chunk_id) GROUP BY c.chunk_id")
def pj07(spark, d):
    told = F.transform("assets", lambda a: F.concat_ws("/", a["asset_id"], a["asset_type"], F.coalesce(a["download_path"], F.lit("-"))))
    return x.chunk_records(chunks(spark, d), assets(spark, d)).select("chunk_id", told.alias("assets"))


@query("pj08_ingest_records", f"""WITH {RECORD_SQL}, u AS (SELECT chunk_id, asset_type, no, CASE WHEN resolved_url <> '' THEN resolved_url ELSE coalesce(download_path, '') END AS url FROM j),
t AS (SELECT chunk_id, list(asset_type ORDER BY f) AS asset_types FROM (SELECT chunk_id, asset_type, min(no) AS f FROM u GROUP BY ALL) GROUP BY chunk_id),
w AS (SELECT chunk_id, list(url ORDER BY f) AS asset_urls FROM (SELECT chunk_id, url, min(no) AS f FROM u WHERE url <> '' GROUP BY ALL) GROUP BY chunk_id)
SELECT c.document_id || ':' || c.chunk_id AS record_id, coalesce(t.asset_types, []) AS asset_types, coalesce(w.asset_urls, []) AS asset_urls FROM c LEFT JOIN t USING (chunk_id) LEFT JOIN w USING (chunk_id)""")
def pj08(spark, d):
    return x.ingest_records(x.chunk_records(chunks(spark, d), assets(spark, d))).select("record_id", "asset_types", "asset_urls")


@query("pj10_manifests", """SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS block_count, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS asset_count, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25) AS chunk_count,
o_orderstatus AS status, o_orderpriority AS tenant FROM orders""")
def pj10(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity")
    meta = x.merged(F.create_map(F.lit("tenant"), F.lit("none"), F.lit("status"), F.col("o_orderstatus")), F.create_map(F.lit("tenant"), F.col("o_orderpriority")))
    docs = read(spark, d, "orders").select("o_orderkey", meta.alias("metadata"))
    out = x.manifests(docs, "o_orderkey", {"block_count": rows, "asset_count": rows.select("o_orderkey", "l_partkey").distinct(), "chunk_count": rows.filter("l_quantity > 25")})
    return out.select("o_orderkey", "block_count", "asset_count", "chunk_count", F.col("metadata")["status"].alias("status"), F.col("metadata")["tenant"].alias("tenant"))


SHAPE_SQL = r"""SELECT doc_id, list_filter(list_transform(list_filter(list_transform(string_split_regex(text, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^[\s]+|[\s]+$', '', 'g')), lambda x: contains(x, '|')), lambda x: list_transform(string_split(regexp_replace(x, '^[|]+|[|]+$', '', 'g'), '|'), lambda c: regexp_replace(c, '^[\s]+|[\s]+$', '', 'g'))),
lambda r: len(list_filter(r, lambda c: c <> '' AND NOT regexp_matches(c, '^:?-{2,}:?$'))) > 0) AS rows FROM documents"""


@query("bl11_table_shapes", f"SELECT doc_id, CASE WHEN len(rows) > 0 THEN len(rows)::INT END AS n_rows, CASE WHEN len(rows) > 0 THEN list_max(list_transform(rows, lambda r: len(r)))::INT END AS n_columns FROM ({SHAPE_SQL})")
def bl11_shapes(spark, d):
    return read(spark, d, "documents").select("doc_id", x.table_shape(F.col("text")).alias("s")).select("doc_id", "s.n_rows", "s.n_columns")


PAGES_SQL = "CASE p_partkey % 4 WHEN 0 THEN []::INT[] WHEN 1 THEN [3, 3] WHEN 2 THEN [2, 1, 0] ELSE [9, 4, 5, 6] END"
PHRASE_SQL = "CASE p_partkey % 4 WHEN 0 THEN 'unknown page' WHEN 1 THEN 'page 3' WHEN 2 THEN 'pages 1, 2' ELSE 'pages 4-9' END"


@query("bl11_asset_summaries", f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Table on ' || {PHRASE_SQL} || CASE WHEN p_size % 2 = 0 THEN ' with ' || p_size || ' rows' || CASE WHEN p_size % 4 = 0 THEN ' and 3 columns' ELSE '' END WHEN p_size % 4 = 0 THEN ' with 3 columns' ELSE '' END || '. Text: ' || p_name
WHEN 1 THEN 'Image on ' || {PHRASE_SQL} || ', 10x' || p_size || '. OCR text: ' || p_name ELSE 'Figure on ' || {PHRASE_SQL} || ', 10x' || p_size || '. Text: ' || p_name END || '.' AS summary FROM part""")
def bl11(spark, d):
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    pages = F.when(k == 0, F.array().cast("array<int>")).when(k == 1, F.array(F.lit(3), F.lit(3))).when(k == 2, F.array(F.lit(2), F.lit(1), F.lit(0))).otherwise(F.array(F.lit(9), F.lit(4), F.lit(5), F.lit(6)))
    kind = F.when(F.col("p_partkey") % 5 == 0, "table").when(F.col("p_partkey") % 5 == 1, "image").otherwise("figure")
    own = x.asset_summary(kind, F.col("p_name"), pages, F.when(size % 2 == 0, size), F.when(size % 4 == 0, F.lit(3)), F.lit(10), size)
    return read(spark, d, "part").select("p_partkey", own.alias("summary"))


@query("pj05_blocks_markdown", f"WITH {BLOCKS_SQL} SELECT doc_id, md5(string_agg(CASE WHEN block_type = 'title' THEN repeat('#', greatest(1, least(6, doc_id % 9))::INT) || ' ' || trim(text) ELSE trim(text) END, chr(10) || chr(10) ORDER BY pos)) AS digest FROM b WHERE trim(text) <> '' GROUP BY doc_id")
def pj05(spark, d):
    rows = doc_blocks(spark, d).withColumn("level", (F.col("doc_id") % 9).cast("int"))
    return x.blocks_markdown(rows).select("doc_id", F.md5("markdown").alias("digest"))


@query("pj01_results_markdown", """WITH p AS (SELECT l_orderkey AS k, l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS o, l_returnflag || l_linestatus || l_partkey AS s, l_linestatus = 'F' AS t FROM lineitem)
SELECT k AS l_orderkey, array_to_string(list_concat(coalesce(list(s ORDER BY o) FILTER (WHERE NOT t), []), CASE WHEN bool_or(t) THEN ['### Tables'] ELSE [] END, coalesce(list(s ORDER BY o) FILTER (WHERE t), [])), chr(10) || chr(10)) AS markdown FROM p GROUP BY k""")
def pj01(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", F.expr(KEY), F.concat("l_returnflag", "l_linestatus", "l_partkey").alias("s"), "l_linestatus")
    return x.results_markdown(rows, "l_orderkey", "box_id", "s", F.col("l_linestatus") == "F")


@query("pj14_position_tags", r"SELECT l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS box_id, printf('@@%d-%d' || chr(9) || '%.1f' || chr(9) || '%.1f' || chr(9) || '%.1f' || chr(9) || '%.1f##', l_linenumber, l_linenumber + 1, l_quantity * 8.0::DOUBLE, l_quantity * 8.0::DOUBLE + 60.0, l_linenumber * 14.0::DOUBLE, l_linenumber * 14.0::DOUBLE + 10.0) AS tag, [l_linenumber - 1, l_linenumber]::INT[] AS pages, l_quantity * 8.0::DOUBLE AS x0, l_linenumber * 14.0::DOUBLE + 10.0 AS bottom FROM lineitem")
def pj14(spark, d):
    """A tag written and read back."""
    line = F.col("l_linenumber").cast("int")
    tag = x.position_tag(F.array(line, line + 1), F.col("l_quantity") * 8.0, F.col("l_quantity") * 8.0 + 60.0, line * 14.0, line * 14.0 + 10.0)
    rows = read(spark, d, "lineitem").select(F.expr(KEY), tag.alias("tag")).withColumn("p", F.get(x.positions(F.concat(F.lit("some text"), "tag", F.lit(" more"))), 0))
    return rows.select("box_id", "tag", "p.pages", "p.x0", "p.bottom")


@query("bl09_content_list", """SELECT l_orderkey, l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS box_id, 0 AS no, CASE l_partkey % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' WHEN 2 THEN 'code' WHEN 3 THEN 'list' ELSE 'text' END AS block_type,
CASE l_partkey % 5 WHEN 0 THEN 'body' || l_suppkey || chr(10) || 'b' || 'foot' WHEN 1 THEN 'one' || chr(10) || 'note' WHEN 2 THEN 'x = ' || l_suppkey || 'cap' WHEN 3 THEN 'i' || chr(10) || 'j' ELSE 'plain' END AS text, l_linenumber::INT + 1 AS page, round(l_quantity / 1000.0 * 600, 6) AS x0, round(20.0 / 1000 * 800, 6) AS bottom FROM lineitem""")
def bl09(spark, d):
    k, sup = F.col("l_partkey") % 5, F.col("l_suppkey").cast("string")
    some = lambda v, c: F.when(k == v, c)
    one = F.struct(
        F.when(k == 0, "Table").when(k == 1, "image").when(k == 2, "code").when(k == 3, "list").otherwise("text").alias("type"), F.col("l_linenumber").cast("int").alias("page_idx"), F.array("l_quantity", F.lit(10.0), F.lit(50.0), F.lit(20.0)).alias("bbox"), some(4, F.lit(" plain ")).alias("text"), some(0, F.concat(F.lit("body"), sup)).alias("table_body"),
        some(0, F.array(F.lit("\na"), F.lit("b"))).alias("unused"), some(0, F.array(F.lit("\nb"))).alias("table_caption"), some(0, F.array(F.lit("foot"))).alias("table_footnote"), some(1, F.array(F.lit("o"), F.lit("ne"))).alias("image_caption"), some(1, F.array(F.lit("note"))).alias("image_footnote"), some(2, F.concat(F.lit("x = "), sup)).alias("code_body"), some(2, F.array(F.lit("cap"))).alias("code_caption"), some(3, F.array(F.lit("i"), F.lit("j"))).alias("list_items"),
    )
    rows = read(spark, d, "lineitem").select("l_orderkey", F.expr(KEY), F.to_json(F.array(one)).alias("json"))
    return x.content_list(rows, width=600.0, height=800.0).select("l_orderkey", "box_id", "no", "block_type", "text", "page", F.round("x0", 6).alias("x0"), F.round("bottom", 6).alias("bottom"))


@query("bl08_layout_results", """SELECT l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS box_id, 1 AS page, 0 AS no, CASE l_partkey % 4 WHEN 0 THEN 'seal' WHEN 1 THEN 'title' WHEN 2 THEN 'figure' ELSE 'text' END AS block_type, 't' || l_suppkey AS text, CASE WHEN l_partkey % 4 = 3 THEN 0.0 ELSE l_quantity / 2.0 END AS x0, CASE WHEN l_partkey % 4 = 3 THEN 0.0 ELSE 40.0 END AS bottom FROM lineitem""")
def bl08(spark, d):
    """Names of both styles, an unknown label and a box of three numbers."""
    k = F.col("l_partkey") % 4
    label = F.when(k == 0, "Stamp").when(k == 1, "doc_title").when(k == 2, "image").otherwise("other")
    box = F.when(k == 3, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).otherwise(F.array("l_quantity", F.lit(1.0), F.lit(2.0), F.lit(80.0)))
    body = F.concat(F.lit(" t"), "l_suppkey")
    old, new = F.struct(label.alias("block_label"), box.alias("block_bbox"), body.alias("block_content")), F.struct(label.alias("blockType"), box.alias("blockBbox"), body.alias("blockContent"))
    page = F.struct(F.when(k < 2, F.array(old)).alias("parsing_res_list"), F.when(k >= 2, F.array(new)).alias("parsingResList"))
    rows = read(spark, d, "lineitem").select(F.expr(KEY), F.to_json(F.array(page)).alias("json"))
    return x.layout_results(rows).select("box_id", "page", "no", "block_type", "text", "x0", "bottom")


@query("sc13_tables_apart", r"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [('| a | b |\n| --- | --- |\n| 1 | ' || p_size || ' |\n| 2 | x |'), ('a | b\n--- | ---\n3 | ' || p_size), ('<table><tr><td>' || p_size || '</td></tr></table>')] ELSE [] END AS tables, CASE WHEN p_size % 2 = 0 THEN 'Intro\n\n\nMiddle\n\n\nEnd \n\n' ELSE p_name || ' | ' || p_type END AS rest FROM part""".replace(r"\n", "' || chr(10) || '"))
def sc13(spark, d):
    made = F.concat(F.lit("Intro\n| a | b |\n| --- | --- |\n| 1 | "), "p_size", F.lit(" |\n| 2 | x |\n\nMiddle\na | b\n--- | ---\n3 | "), "p_size", F.lit("\n\nEnd <table><tr><td>"), "p_size", F.lit("</td></tr></table>"))
    text = F.when(F.col("p_size") % 2 == 0, made).otherwise(F.concat_ws(" | ", "p_name", "p_type"))
    return read(spark, d, "part").select("p_partkey", x.tables_apart(text).alias("t")).select("p_partkey", "t.tables", "t.rest")


@query("sc35_image_sources", "SELECT p_partkey, 'See ![one](' || CASE WHEN p_size % 2 = 0 THEN 'http://s/' || p_partkey ELSE 'a/' || p_partkey END || ') and ![two](b/1) and ![one](' || CASE WHEN p_size % 2 = 0 THEN 'http://s/' || p_partkey ELSE 'a/' || p_partkey END || ')' AS markdown FROM part")
def sc35(spark, d):
    own = F.concat(F.lit("a/"), "p_partkey")
    text = F.concat(F.lit("See ![one]("), own, F.lit(") and ![two](b/1) and ![one]("), own, F.lit(")"))
    known = F.when(F.col("p_size") % 2 == 0, F.create_map(own, F.concat(F.lit("http://s/"), "p_partkey"))).otherwise(F.create_map(F.lit("c"), F.lit("d")))
    return read(spark, d, "part").select("p_partkey", x.with_sources(text, known).alias("markdown"))


@query("bl07_renumbered_blocks", f"SELECT l_orderkey, box_id, printf('block-%04d', row_number() OVER (PARTITION BY l_orderkey ORDER BY top, x0, box_id) - 1) AS block_id FROM (SELECT l_orderkey, {KEY.replace(' AS box_id', '')} AS box_id, l_linenumber * 14.0 AS top, l_quantity * 8.0 AS x0 FROM lineitem)")
def bl07(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", F.expr(KEY), (F.col("l_linenumber") * 14.0).alias("top"), (F.col("l_quantity") * 8.0).alias("x0"))
    return x.renumbered(rows, "l_orderkey", ["top", "x0", "box_id"]).select("l_orderkey", "box_id", "block_id")
