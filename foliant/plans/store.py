"""Queries of the ingest store. Documents stand for parses (lang: engine, source:
tenant), labels for publish states, orders with lineitem and part for documents,
links and assets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import store as s
from foliant.registry import query, read


@query("fl01_equality_filter", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src0'")
def fl01(spark, d):
    return s.where_equal(read(spark, d, "documents"), lang="en", source="src0", n_chars=None).select("doc_id", "lang", "source")


STATUS_SQL = "SELECT d.doc_id, d.lang, d.source, d.n_chars, CASE l.quality WHEN 1 THEN 'published' WHEN 0 THEN 'failed' ELSE 'disabled' END AS status, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def statuses(spark, d):
    docs, labels = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), read(spark, d, "labels")
    state = F.when(F.col("quality") == 1, "published").when(F.col("quality") == 0, "failed")
    return s.with_status(docs.join(labels, "doc_id", "left").withColumn("status", state), default="disabled")


@query("fl02_status_filter", f"SELECT doc_id, status FROM ({STATUS_SQL}) WHERE coalesce(status, '') = 'failed'")
def fl02(spark, d):
    return s.where_equal(statuses(spark, d), status="failed").select("doc_id", "status")


@query("fl03_block_filter", "SELECT p_partkey, p_name FROM part WHERE trim(p_name) <> '' OR p_size > 0")
def fl03(spark, d):
    return read(spark, d, "part").filter((F.trim("p_name") != "") | (F.col("p_size") > 0)).select("p_partkey", "p_name")


@query("jn01_documents_records", "SELECT o.o_orderkey, o.o_orderstatus, count(l.l_orderkey) AS n_records, coalesce(sum(l.l_quantity), 0) AS quantity FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL")
def jn01(spark, d):
    # One row for each order before the join, so that the join moves sums.
    each = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(each, orders.o_orderkey == each.l_orderkey, "left").select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).alias("n_records"), F.coalesce("q", F.lit(0.0)).alias("quantity"))


@query("jn02_links_assets", "SELECT p_type, count(*) AS n_links, count(p_partkey) AS n_assets, sum(l_quantity) AS quantity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY p_type")
def jn02(spark, d):
    each = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    part = read(spark, d, "part").select("p_partkey", "p_type")
    return each.join(part, each.l_partkey == part.p_partkey, "left").groupBy("p_type").agg(F.sum("n").alias("n_links"), F.sum(F.when(F.col("p_partkey").isNotNull(), F.col("n")).otherwise(0)).alias("n_assets"), F.sum("q").alias("quantity"))


ALIAS_SQL = "SELECT doc_id AS alias_id, first AS canonical_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents) WHERE doc_id <> first"


@query("jn03_alias_resolution", f"SELECT l.doc_id, coalesce(a.canonical_id, l.doc_id) AS canonical_id, l.quality FROM labels l LEFT JOIN ({ALIAS_SQL}) a ON a.alias_id = l.doc_id")
def jn03(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    _, rest = s.deduplicated(docs, ["key"], ["doc_id"])
    aliases = rest.select(F.col("doc_id").alias("alias_id"), F.col("canonical_doc_id").alias("canonical_id"))
    return s.canonical(read(spark, d, "labels"), aliases, "doc_id").select("doc_id", "canonical_id", "quality")


@query("jn04_key_lookup", "SELECT l.doc_id FROM labels l WHERE l.doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def jn04(spark, d):
    return read(spark, d, "labels").join(read(spark, d, "documents").filter("lang = 'de'").select("doc_id"), "doc_id", "left_semi").select("doc_id")


@query("jn05_array_refs", "SELECT o_orderkey, coalesce((SELECT list(l_partkey ORDER BY l_linenumber, l_partkey) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND p_size > 10), []) AS found FROM orders")
def jn05(spark, d):
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    rows = read(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.transform("l", lambda x: x["l_partkey"]).alias("refs"))
    return s.joined_refs(rows, "refs", read(spark, d, "part").filter("p_size > 10").select("p_partkey"), "p_partkey", "o_orderkey")


@query("jn06_reverse_refs", "SELECT p_partkey, count(l_orderkey) AS n_refs, min(l_orderkey) AS first_ref FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def jn06(spark, d):
    each = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_ref"))
    part = read(spark, d, "part").select("p_partkey")
    return part.join(each, part.p_partkey == each.l_partkey, "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n_refs"), "first_ref")


@query("jn21_unknown_refs", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 7)")
def jn21(spark, d):
    return s.unknown_refs(read(spark, d, "lineitem"), read(spark, d, "part").filter("p_size <> 7"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("jn22_parent_chain", "SELECT n_nationkey AS id, [r_name, n_name] AS path FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 1000 + r_regionkey, [r_name] FROM region")
def jn22(spark, d):
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    nodes = nation.selectExpr("n_nationkey AS id", "1000 + n_regionkey AS up", "n_name AS name").unionByName(region.selectExpr("1000 + r_regionkey AS id", "cast(null as int) AS up", "r_name AS name"))
    return s.chain(nodes, "id", "up", "name")


@query("jn23_name_or_alias", "SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'FRANCE' OR n_nationkey = 7")
def jn23(spark, d):
    nation = read(spark, d, "nation")
    hit = nation.filter("n_name = 'FRANCE'").select("n_nationkey").union(nation.filter("n_nationkey = 7").select("n_nationkey")).distinct()
    return read(spark, d, "customer").join(hit, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey")


@query("ag01_status_counts", f"SELECT count(*) AS n, count(*) FILTER (WHERE status='published') AS published, count(*) FILTER (WHERE status='failed') AS failed, count(*) FILTER (WHERE status='disabled') AS disabled FROM ({STATUS_SQL})")
def ag01(spark, d):
    state = lambda x: F.col("status") == x
    return statuses(spark, d).agg(F.count("*").alias("n"), *s.shares({x: state(x) for x in ("published", "failed", "disabled")}))


@query("ag02_record_stats", "SELECT source, count(*) AS n_docs, count(l.doc_id) AS n_records, count(*) FILTER (WHERE l.toxic = 1) AS n_flagged FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def ag02(spark, d):
    return statuses(spark, d).groupBy("source").agg(F.count("*").alias("n_docs"), F.count("quality").alias("n_records"), F.count_if(F.col("toxic") == 1).alias("n_flagged"))


@query("ag03_asset_stats", "SELECT p_type, count(*) AS n, count(*) FILTER (WHERE coalesce(nullif(p_brand,''), nullif(p_name,''), '') <> '') AS n_urls, count(*) FILTER (WHERE p_retailprice > 1000) AS n_stored FROM part GROUP BY p_type")
def ag03(spark, d):
    url = F.coalesce(F.nullif(F.col("p_brand"), F.lit("")), F.nullif(F.col("p_name"), F.lit("")), F.lit(""))
    return read(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.count_if(url != "").alias("n_urls"), F.count_if(F.col("p_retailprice") > 1000).alias("n_stored"))


@query("ag04_link_stats", "SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag='N') AS n_direct, count(*) FILTER (WHERE l_returnflag<>'N') AS n_context FROM lineitem")
def ag04(spark, d):
    return read(spark, d, "lineitem").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("n_direct"), F.count_if(F.col("l_returnflag") != "N").alias("n_context"))


@query("ag06_by_file_type", "SELECT regexp_extract(url, '\\.([a-z]+)/', 1) AS kind, count(DISTINCT url) AS n_urls, count(*) AS n, count(*) FILTER (WHERE length(html) > 2000) AS n_long FROM pages GROUP BY 1")
def ag06(spark, d):
    pages = read(spark, d, "pages").select("url", F.regexp_extract("url", r"\.([a-z]+)/", 1).alias("kind"), (F.length("html") > 2000).alias("long"))
    each = pages.groupBy("kind", "url").agg(F.count("*").alias("n"), F.count_if("long").alias("l"))
    return each.groupBy("kind").agg(F.count("*").alias("n_urls"), F.sum("n").alias("n"), F.sum("l").alias("n_long"))


@query("ag07_store_overview", "SELECT * FROM (SELECT count(*) AS n_documents, sum(n_chars)::BIGINT AS n_chars FROM documents) CROSS JOIN (SELECT count(*) AS n_links, count(DISTINCT l_partkey) AS n_linked FROM lineitem) CROSS JOIN (SELECT count(*) AS n_assets FROM part)")
def ag07(spark, d):
    docs = read(spark, d, "documents").agg(F.count("*").alias("n_documents"), F.sum("n_chars").alias("n_chars"))
    links = read(spark, d, "lineitem").groupBy("l_partkey").count().agg(F.sum("count").alias("n_links"), F.count("l_partkey").alias("n_linked"))
    # Three tables of one row each.
    return docs.crossJoin(links).crossJoin(read(spark, d, "part").agg(F.count("*").alias("n_assets")))


@query("so01_documents_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 20")
def so01(spark, d):
    return s.page_of(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 40, 20)


@query("so02_assets_page", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def so02(spark, d):
    return s.page_of(read(spark, d, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.asc("p_partkey")], 25)


@query("so04_links_page", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_partkey, l_linenumber LIMIT 60")
def so04(spark, d):
    links = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    return s.page_of(links, [F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_partkey"), F.asc("l_linenumber")], 60).drop("l_partkey")


@query("so07_point_get", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 33")
def so07(spark, d):
    return s.where_equal(read(spark, d, "orders"), o_orderkey=33).select("o_orderkey", "o_totalprice")


@query("sk07_upsert", "SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN 0.0 ELSE o_totalprice END AS total FROM orders")
def sk07(spark, d):
    orders = read(spark, d, "orders")
    old = orders.select("o_orderkey", F.col("o_totalprice").alias("total"))
    return s.upserted(old, orders.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit(0.0).alias("total")), ["o_orderkey"])


@query("sk12_jsonl", """SELECT doc_id, md5('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}') AS digest FROM documents""")
def sk12(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(F.to_json(F.struct("doc_id", "lang", "n_chars"))).alias("digest"))


@query("pj09_link_rows", "SELECT l_orderkey, l_partkey, CASE WHEN l_returnflag = 'N' THEN 'direct' ELSE 'context' END AS kind, row_number() OVER (PARTITION BY l_orderkey, CASE WHEN l_returnflag = 'N' THEN 'direct' ELSE 'context' END ORDER BY l_linenumber, l_partkey) - 1 AS ordinal FROM lineitem")
def pj09(spark, d):
    kind = F.when(F.col("l_returnflag") == "N", "direct").otherwise("context")
    links = read(spark, d, "lineitem").withColumn("kind", kind)
    return links.select("l_orderkey", "l_partkey", "kind", (F.row_number().over(Window.partitionBy("l_orderkey", "kind").orderBy("l_linenumber", "l_partkey")) - 1).cast("long").alias("ordinal"))


@query("pj12_alias_annotation", f"SELECT d.doc_id, a.canonical_id, CASE WHEN a.canonical_id IS NOT NULL THEN 'alias' ELSE 'canonical' END AS kind FROM documents d LEFT JOIN ({ALIAS_SQL}) a ON a.alias_id = d.doc_id")
def pj12(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    first, rest = s.deduplicated(docs, ["key"], ["doc_id"])
    return first.select("doc_id", F.lit(None).cast("long").alias("canonical_id"), F.lit("canonical").alias("kind")).union(rest.select("doc_id", "canonical_doc_id", F.lit("alias")))


@query("bl13_cache_lookup", "SELECT hit, count(*) AS n FROM (SELECT d.doc_id, count(*) OVER (PARTITION BY sha256(d.text)) > 1 AS hit FROM documents d) GROUP BY hit")
def bl13(spark, d):
    keys = read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("n"))
    return keys.groupBy((F.col("n") > 1).alias("hit")).agg(F.sum("n").alias("n"))
