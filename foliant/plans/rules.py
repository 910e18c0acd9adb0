"""Queries of rules, page features, profiles and further set operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import rules as r
from foliant.operators import pages as p
from foliant.plans.geometry import BOXES_SQL, LAYOUTS_SQL, boxes, layouts
from foliant.registry import query, read

LINES_SQL = "l AS (SELECT doc_id, trim(x) AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents))"
RANK_SQL = "CASE WHEN length(x) <= 2 THEN NULL WHEN regexp_matches(x, '" + r.NUMBERS_ONLY + "') THEN 0 " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN {k}" for p, k in r.BULLETS) + " END"
SECTION_SQL = f"(coalesce({RANK_SQL}, 0) > 0 OR (length(x) <= 80 AND regexp_matches(x, '{r.CAPITAL_HEADING}') AND NOT regexp_matches(x, '[.。!?！？]$')))"


def lines(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x")).select("doc_id", F.trim("x").alias("x"))


@query("fl10_section_starts", f"WITH {LINES_SQL} SELECT doc_id, count(*) FILTER (WHERE {SECTION_SQL}) AS n FROM l GROUP BY doc_id")
def fl10(spark, d):
    return lines(spark, d).groupBy("doc_id").agg(F.count_if(r.starts_section(F.col("x"), F.lit(None).cast("string"))).alias("n"))


@query("sc01_file_types", "SELECT ext, count(*) AS n FROM (SELECT CASE WHEN contains(url, '.') AND list_extract(string_split(url, '.'), -1) <> '' THEN lower(list_extract(string_split(url, '.'), -1)) END AS ext FROM pages) GROUP BY ext")
def sc01(spark, d):
    return read(spark, d, "pages").groupBy(r.file_extension(F.col("url")).alias("ext")).agg(F.count("*").alias("n"))


@query("se06_multiset_intersection", "SELECT x AS word, least(a, b) AS n FROM (SELECT p_brand AS x, count(*) AS a FROM part WHERE p_size <= 25 GROUP BY 1) JOIN (SELECT p_brand AS x, count(*) AS b FROM part WHERE p_size > 25 GROUP BY 1) USING (x)")
def se06(spark, d):
    part = read(spark, d, "part")
    n = part.groupBy(F.col("p_brand").alias("word")).agg(F.count_if(F.col("p_size") <= 25).alias("a"), F.count_if(F.col("p_size") > 25).alias("b"))
    return n.filter("a > 0 AND b > 0").select("word", F.least("a", "b").alias("n"))


@query("se10_keyword_sets", "SELECT p_partkey, list_filter(list_sort(list_distinct(string_split(p_name, ' '))), lambda x: length(x) > 1) AS words FROM part")
def se10(spark, d):
    return read(spark, d, "part").select("p_partkey", F.filter(F.array_sort(F.array_distinct(F.split("p_name", " "))), lambda x: F.length(x) > 1).alias("words"))


@query("dt03_repaired_dates", "SELECT o_orderkey, year(o_orderdate)::INT AS year, CASE WHEN month(o_orderdate) + 3 BETWEEN 1 AND 12 THEN (month(o_orderdate) + 3)::INT ELSE 1 END AS month, CASE WHEN day(o_orderdate) + 10 BETWEEN 1 AND 31 THEN (day(o_orderdate) + 10)::INT ELSE 1 END AS day FROM orders")
def dt03(spark, d):
    loose = F.concat_ws("/", F.year("o_orderdate"), F.month("o_orderdate") + 3, F.dayofmonth("o_orderdate") + 10)
    return read(spark, d, "orders").select("o_orderkey", r.repaired_date(loose).alias("p")).select("o_orderkey", "p.year", "p.month", "p.day")


# A heading of every rank, by the document; the last ones have none.
HEADS = ("第一章 ", "第二节 ", "三、", "（四）", "5、", "6.1 ", "7.1.2 ", "8.1.2.3 ", "Ask: ", "10）", "(11)", "十二是", "• ", "12, 34 ", "")
HEADED_SQL = "SELECT doc_id, CASE doc_id % 15 " + " ".join(f"WHEN {i} THEN {'left(x, 30) || chr(58)' if i == 8 else chr(39) + '12, 34' + chr(39) if i == 13 else chr(39) + h + chr(39) + ' || x'}" for i, h in enumerate(HEADS)) + " END AS x FROM l"


@query("fl11_bullet_ranks", f"WITH {LINES_SQL}, h AS ({HEADED_SQL}) SELECT doc_id % 15 AS head, {RANK_SQL} AS rank, count(*) AS n FROM h GROUP BY ALL")
def fl11(spark, d):
    k = (F.col("doc_id") % 15).cast("int")
    x = F.when(k == 8, F.concat(F.left("x", F.lit(30)), F.lit(":"))).when(k == 13, "12, 34").otherwise(F.concat(F.get(F.array(*map(F.lit, HEADS)), k), "x"))
    return lines(spark, d).select(F.col("doc_id") % 15, x.alias("x")).toDF("head", "x").groupBy("head", r.bullet_rank(F.col("x")).alias("rank")).agg(F.count("*").alias("n"))


@query("fl12_captions", f"WITH {LINES_SQL} SELECT doc_id, count(*) AS n FROM l WHERE doc_id % 7 = 3 OR regexp_matches(CASE doc_id % 4 WHEN 0 THEN '图 1: ' WHEN 1 THEN '图' WHEN 2 THEN ' 表12 ' ELSE '' END || x, '^\\s*[图表]+[ 0-9:：]{{2,}}') GROUP BY doc_id")
def fl12(spark, d):
    """Lines that begin as captions do, or nearly, and lines in the layout of one."""
    k = F.col("doc_id") % 4
    text = F.concat(F.when(k == 0, "图 1: ").when(k == 1, "图").when(k == 2, " 表12 ").otherwise(""), F.col("x"))
    layout = F.when(F.col("doc_id") % 7 == 3, "figure caption")
    return lines(spark, d).filter(r.is_caption(text, layout)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("fl17_doubled_text", f"WITH {LINES_SQL}, k AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(x, '(.)', '\\1\\1', 'g') WHEN doc_id % 3 = 1 THEN regexp_replace(x, '(.)', '\\1\\1', 'g') || '!' ELSE x END AS x FROM l) SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE length(x) >= 4 AND length(x) % 2 = 0 AND len(list_filter(range(0, length(x) // 2), lambda i: substr(x, (2*i+1)::BIGINT, 1) <> substr(x, (2*i+2)::BIGINT, 1))) = 0) AS doubled FROM k GROUP BY doc_id")
def fl17(spark, d):
    twice = F.regexp_replace("x", "(.)", "$1$1")
    x = F.when(F.col("doc_id") % 3 == 0, twice).when(F.col("doc_id") % 3 == 1, F.concat(twice, F.lit("!"))).otherwise(F.col("x"))
    return lines(spark, d).withColumn("x", x).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(r.is_doubled(F.col("x"))).alias("doubled"))


MESSAGES = [*r.ERROR_WHOLE, *(f"{m} x" for m in r.ERROR_START), "This is Not Supported by the active backend yet", "invalid json", "an invalid thing", "other", ""]
CODES = [*r.ERROR_WHOLE.values(), *r.ERROR_START.values(), "NOT_IMPLEMENTED", "INVALID_PAYLOAD", "INVALID_PAYLOAD", None, None]
STATUSES = [401, 403, 404, 409, 501, 503, 502, 400]
STATUS_SQL = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{r.ERROR_STATUS.get(n, 'INTERNAL_ERROR' if n >= 500 else 'BAD_REQUEST')}'" for i, n in enumerate(STATUSES)) + " END"
MESSAGE_SQL = f"CASE (event_id // 8) % {len(MESSAGES)} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES) if c) + " END"


@query("st12_error_codes", f"SELECT event_id, coalesce({MESSAGE_SQL}, {STATUS_SQL}) AS code FROM events")
def st12(spark, d):
    """Every message of the ladder with every status."""
    pick = lambda rows, n: F.get(F.array(*map(F.lit, rows)), n.cast("int"))
    message = F.concat(F.lit(" "), F.upper(pick(MESSAGES, F.floor(F.col("event_id") / 8) % len(MESSAGES))))
    return read(spark, d, "events").select("event_id", r.error_code(message, pick(STATUSES, F.col("event_id") % 8)).alias("code"))


@query("sc03_input_checks", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'no_name' WHEN 1 THEN 'no_type' WHEN 2 THEN 'unknown_type' ELSE CASE WHEN p_size % 5 = 0 THEN 'empty' WHEN p_size > 40 THEN 'too_large' ELSE 'ok' END END AS verdict FROM part")
def sc03(spark, d):
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, " ").when(k == 1, "readme").when(k == 2, "a.exe").when(k == 3, "a.b.PDF").when(k == 4, "x.csv").otherwise("y.Md")
    size = F.when(F.col("p_size") % 5 == 0, 0).otherwise(F.col("p_size"))
    return read(spark, d, "part").select("p_partkey", p.input_verdict(name, size, ("pdf", "csv", "md"), 40).alias("verdict"))


FONT_SQL = "SELECT lang, sum(n_chars)::BIGINT AS chars, round(sum(n_chars)::DOUBLE / greatest(count(*), 1), 6) AS per_page, round(count(*) FILTER (WHERE n_chars >= 800)::DOUBLE / greatest(count(*), 1), 6) AS text_share FROM documents GROUP BY lang"


@query("ag12_text_layer", f"SELECT *, CASE WHEN per_page >= 800 AND text_share >= 0.5 THEN 'text' ELSE 'image' END AS layer FROM ({FONT_SQL})")
def ag12(spark, d):
    out = p.text_layer(read(spark, d, "documents").select("lang", "n_chars"), "lang", "n_chars", 800)
    return out.withColumns({c: F.round(c, 6) for c in ("per_page", "text_share")})


@query("ag13_page_features", f"SELECT page, least(sum((x1-x0)*(bottom-top)) / 12000.0, 1.0) AS image_share, least(max((x1-x0)*(bottom-top)) / 12000.0, 1.0) AS max_image_share, max((x1-x0)*(bottom-top)) / 12000.0 >= 0.7 AS has_large FROM ({LAYOUTS_SQL}) GROUP BY page")
def ag13(spark, d):
    return p.image_features(layouts(spark, d), 12000.0, 0.7)


@query("ag15_first_mode", f"SELECT page, arg_max(text, (n, -first)) AS kind FROM (SELECT page, text, count(*) AS n, min(box_id) AS first FROM ({BOXES_SQL}) GROUP BY page, text) GROUP BY page")
def ag15(spark, d):
    return p.first_mode(boxes(spark, d), ["page"], "text", "box_id")


@query("ag23_store_totals", "SELECT l_shipdate::DATE AS day, count(*) AS n, round(sum(l_extendedprice), 2) AS l_extendedprice, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1")
def ag23(spark, d):
    return p.totals_by_day(read(spark, d, "lineitem"), "l_shipdate", ["l_extendedprice", "l_quantity"]).withColumn("l_extendedprice", F.round("l_extendedprice", 2))


@query("jn10_tightest_column", f"WITH b AS ({BOXES_SQL}), l AS ({LAYOUTS_SQL}) SELECT box_id, arg_min(layout_id, (d, layout_id)) AS column_id FROM (SELECT b.box_id, l.layout_id, least(abs(b.x0 - l.x0), abs(b.x1 - l.x1), abs(b.x0 + b.x1 - l.x0 - l.x1) / 2) AS d FROM b JOIN l ON l.page = b.page AND l.layout_id % 2 = b.part % 2) GROUP BY box_id")
def jn10(spark, d):
    own = boxes(spark, d).withColumn("layoutno", F.col("part") % 2)
    columns = layouts(spark, d).withColumn("layoutno", F.col("layout_id") % 2).withColumnRenamed("layout_id", "column_id")
    return p.tightest(own, columns)


@query("jn12_nearest_region", f"WITH b AS ({BOXES_SQL}), l AS ({LAYOUTS_SQL}) SELECT box_id, arg_min(layout_id, (d, layout_id)) AS region_id FROM (SELECT b.box_id, l.layout_id, pow((b.x0 + b.x1) / 2 - (l.x0 + l.x1) / 2, 2) + pow((b.top + b.bottom) / 2 - (l.top + l.bottom) / 2, 2) AS d FROM b JOIN l USING (page)) GROUP BY box_id")
def jn12(spark, d):
    return p.nearest_region(boxes(spark, d), layouts(spark, d).withColumnRenamed("layout_id", "region_id"))


NEAR_SQL = "SELECT DISTINCT l_orderkey, l_linenumber AS pos, l_returnflag = 'R' AS visual, CASE WHEN l_partkey % 5 = 0 THEN [] ELSE [l_suppkey % 3, 7 + l_partkey % 2] END AS pages FROM lineitem"


@query("jn07_page_neighbours", f"WITH b AS ({NEAR_SQL}) SELECT a.l_orderkey, a.pos, z.pos AS near_pos FROM b a JOIN b z ON a.l_orderkey = z.l_orderkey AND NOT a.visual AND z.visual AND a.pos <> z.pos AND abs(a.pos - z.pos) <= 2 AND (len(a.pages) = 0 OR len(z.pages) = 0 OR list_has_any(a.pages, z.pages))")
def jn07(spark, d):
    pages = F.when(F.col("l_partkey") % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array((F.col("l_suppkey") % 3).cast("long"), (7 + F.col("l_partkey") % 2).cast("long")))
    rows = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), (F.col("l_returnflag") == "R").alias("visual"), pages.alias("pages")).distinct()
    return p.page_neighbours(rows, "l_orderkey", 2)


@query("so12_keep_latest", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn > 20")
def so12(spark, d):
    return p.keep_latest(read(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("event_id")


@query("so13_best_orientation", """WITH s AS (SELECT user_id, event_id % 4 * 90 AS angle, round(avg(value / 200) * (1 + 0.1 * least(count(*), 50) / 50.0), 9) AS score FROM events GROUP BY ALL), b AS (SELECT user_id, arg_max(angle, (score, -angle)) AS a, max(score) AS m, max(score) FILTER (WHERE angle = 0) AS u FROM s GROUP BY user_id)
SELECT user_id, CASE WHEN u IS NULL OR m - u > 0.2 THEN a ELSE 0 END AS angle, CASE WHEN u IS NULL OR m - u > 0.2 THEN m ELSE u END AS score FROM b""")
def so13(spark, d):
    reads = read(spark, d, "events").select("user_id", (F.col("event_id") % 4 * 90).alias("angle"), (F.col("value") / 200).alias("value"))
    return p.best_orientation(reads, ["user_id"], "angle", "value")


@query("ag28_profile_facts", "SELECT o_custkey, count(*) AS n_jobs, round(avg(greatest(date_diff('day', o_orderdate::DATE, CASE WHEN o_orderkey % 4 = 0 THEN DATE '2024-01-31' ELSE (o_orderdate + INTERVAL 1 DAY * (o_orderkey % 90 - 5))::DATE END), 0)), 6) AS mean_days, max(o_totalprice) AS most_scale, min(o_orderdate)::DATE AS first_at, arg_max(o_orderpriority, (5 - substr(o_orderpriority, 1, 1)::INT, o_orderpriority)) AS highest FROM orders GROUP BY o_custkey")
def ag28(spark, d):
    """Orders stand for jobs; every fourth is still on, some spans are reversed."""
    end = F.when(F.col("o_orderkey") % 4 != 0, F.expr("date_add(cast(o_orderdate AS date), cast(o_orderkey % 90 - 5 AS int))"))
    jobs = read(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("start"), end.alias("end"), F.col("o_totalprice").alias("scale"), (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("degree_rank"), F.col("o_orderpriority").alias("degree"))
    return p.work_facts(jobs, "o_custkey", F.lit("2024-01-31").cast("date")).withColumn("mean_days", F.round("mean_days", 6))


@query("ag29_completeness", "SELECT c_custkey, round((1 + CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END + CASE WHEN c_nationkey % 3 > 0 THEN 1 ELSE 0 END) / 3.0 * CASE WHEN c_nationkey % 3 > 0 THEN 1 ELSE 0.5 END, 9) AS score FROM customer")
def ag29(spark, d):
    fields = {"name": F.col("c_name"), "balance": F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), "nation": F.when(F.col("c_nationkey") % 3 > 0, F.lit("n")).otherwise(" ")}
    return read(spark, d, "customer").select("c_custkey", F.round(p.completeness(fields, ["name", "nation"]), 9).alias("score"))


@query("ev05_readiness", "SELECT bool_and(n >= 40) AS ready, count(*) AS n, list_sort(coalesce(list(lang) FILTER (WHERE n < 40), [])) AS failed FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang HAVING lang IS NOT NULL AND lang <> 'fr')")
def ev05(spark, d):
    gates = read(spark, d, "documents").filter("lang IS NOT NULL").groupBy("lang").agg((F.count("*") >= 40).alias("passed")).select(F.col("lang").alias("name"), (F.col("lang") != "fr").alias("needed"), "passed")
    return p.readiness(gates)
