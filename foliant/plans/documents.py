"""Queries from documents to blocks, chunks and records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.operators import blocks as b
from foliant.operators import chunking
from foliant.plans.text import TOKENS_SQL
from foliant.registry import query, read

BLOCKS_SQL = f"""l AS (SELECT doc_id, lang, source, unnest(string_split(coalesce(text,''), chr(10))) AS part, generate_subscripts(string_split(coalesce(text,''), chr(10)), 1) AS no FROM documents),
k AS (SELECT doc_id, lang, source, no, trim(part) AS body, CASE WHEN trim(part) LIKE '#%' THEN 'title' WHEN contains(part, '|') THEN 'table' ELSE 'text' END AS block_type FROM l WHERE trim(part) <> ''),
b AS (SELECT doc_id, lang, source, block_type, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS pos,
CASE WHEN block_type='title' THEN trim(regexp_replace(body, '^#+', '')) ELSE body END AS text FROM k),
n AS (SELECT doc_id, lang, source, block_type, pos, text, len({TOKENS_SQL}) AS n FROM b)"""


def doc_blocks(spark, d):
    return b.line_blocks(read(spark, d, "documents"))


@query("bl01_line_blocks", f"WITH {BLOCKS_SQL} SELECT doc_id, pos::BIGINT AS pos, block_type, md5(text) AS digest, n::BIGINT AS token_count FROM n")
def bl01(spark, d):
    return doc_blocks(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), "block_type", F.md5("text").alias("digest"), F.col("token_count").cast("long").alias("token_count"))


@query("pj06_rendered_blocks", f"WITH {BLOCKS_SQL} SELECT doc_id, pos::BIGINT AS pos, md5(CASE block_type WHEN 'title' THEN CASE WHEN text='' THEN '' ELSE '# ' || text END WHEN 'table' THEN '[Table]' || chr(10) || text ELSE text END) AS digest FROM b")
def pj06(spark, d):
    return doc_blocks(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(b.rendered(F.col("block_type"), F.col("text"))).alias("digest"))


PACK_SQL = f"""RECURSIVE {BLOCKS_SQL},
r AS (SELECT doc_id, pos, n, n AS used, 0 AS chunk FROM n WHERE pos = 0
UNION ALL SELECT n.doc_id, n.pos, n.n, CASE WHEN r.used + n.n > 128 OR r.used >= 128 THEN n.n ELSE r.used + n.n END, r.chunk + CASE WHEN r.used + n.n > 128 OR r.used >= 128 THEN 1 ELSE 0 END
FROM r JOIN n ON n.doc_id = r.doc_id AND n.pos = r.pos + 1)"""


@query("wn03_packed_chunks", f"WITH {PACK_SQL} SELECT doc_id, chunk::BIGINT AS chunk, count(*) AS n_blocks, sum(n)::BIGINT AS n_tokens FROM r GROUP BY ALL")
def wn03(spark, d):
    return chunking.packed(doc_blocks(spark, d), 128).groupBy("doc_id", F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("n_blocks"), F.sum("token_count").cast("long").alias("n_tokens"))


@query("ag05_chunks_by_engine", f"""WITH {PACK_SQL}, c AS (SELECT doc_id, chunk, sum(n) AS n FROM r GROUP BY ALL)
SELECT lang AS engine, count(DISTINCT d.doc_id) AS n_docs, count(c.chunk) AS n_chunks, count(*) FILTER (WHERE c.n >= 100) AS n_full, sum(c.n)::BIGINT AS n_tokens FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY lang""")
def ag05(spark, d):
    packed = chunking.packed(doc_blocks(spark, d), 128).groupBy("doc_id", "chunk").agg(F.sum("token_count").alias("n"))
    docs = read(spark, d, "documents").select("doc_id", "lang")
    joined = docs.join(packed, "doc_id", "left")
    # Sums by document first: a distinct count would double the rows of the shuffle.
    each = joined.groupBy("doc_id", "lang").agg(F.count("chunk").alias("c"), F.count_if(F.col("n") >= 100).alias("f"), F.sum("n").alias("n"))
    return each.groupBy(F.col("lang").alias("engine")).agg(F.count("*").alias("n_docs"), F.sum("c").alias("n_chunks"), F.sum("f").alias("n_full"), F.sum("n").cast("long").alias("n_tokens"))


@query("wn03_overlapping_chunks", f"""WITH RECURSIVE {BLOCKS_SQL},
c AS (SELECT doc_id, pos, n, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS cs, count(*) OVER (PARTITION BY doc_id) AS total FROM n),
nx AS (SELECT a.doc_id, a.pos, a.total, greatest(a.pos + 1, coalesce(max(z.pos + 1) FILTER (WHERE z.cs - a.cs + a.n <= 128), 0)) AS idx FROM c a JOIN c z ON z.doc_id = a.doc_id AND z.pos >= a.pos AND z.pos <= a.pos + 128 GROUP BY a.doc_id, a.pos, a.total),
cr AS (SELECT x.doc_id, x.pos, x.idx, x.total, coalesce(min(x.idx - z.pos) FILTER (WHERE e.cs - z.cs + z.n >= 32), x.idx - x.pos) AS carried FROM nx x JOIN c e ON e.doc_id = x.doc_id AND e.pos = x.idx - 1 JOIN c z ON z.doc_id = x.doc_id AND z.pos >= x.pos AND z.pos < x.idx GROUP BY x.doc_id, x.pos, x.idx, x.total),
w AS (SELECT doc_id, pos, idx, total, carried, 0 AS chunk FROM cr WHERE pos = 0 UNION ALL SELECT q.doc_id, q.pos, q.idx, q.total, q.carried, w.chunk + 1 FROM w JOIN cr q ON q.doc_id = w.doc_id AND q.pos = greatest(w.pos + 1, w.idx - w.carried) WHERE w.idx < w.total)
SELECT doc_id, chunk::BIGINT AS chunk, pos::BIGINT AS first_block, (idx - pos)::BIGINT AS n_blocks FROM w""")
def wn03_overlap(spark, d):
    blocks = doc_blocks(spark, d).select("doc_id", "pos", F.format_string("b%d", "pos").alias("block_id"), "block_type", "text", b.rendered(F.col("block_type"), F.col("text")).alias("rendered"), "token_count", F.array().cast("array<int>").alias("pages"), F.array().cast("array<string>").alias("asset_refs"), t.title_level(F.col("text")).alias("level"), F.lit("").alias("summary"))
    out = chunking.chunks(blocks, 128, 32)
    return out.select("doc_id", F.col("chunk_no").cast("long").alias("chunk"), F.expr("cast(substr(block_refs[0], 2) as bigint)").alias("first_block"), F.size("block_refs").cast("long").alias("n_blocks"))


@query("wn02_context_blocks", f"""WITH {BLOCKS_SQL} SELECT a.doc_id, a.pos::BIGINT AS pos, count(z.pos) AS n_near, coalesce(sum(z.pos), 0)::BIGINT AS pos_sum FROM b a LEFT JOIN b z ON z.doc_id = a.doc_id AND z.pos BETWEEN a.pos - 2 AND a.pos + 2 AND z.pos <> a.pos AND z.block_type NOT IN ('table') WHERE a.block_type = 'table' GROUP BY ALL""")
def wn02(spark, d):
    near = b.context(doc_blocks(spark, d)).filter("block_type = 'table'").withColumn("near", F.concat("before", "after"))
    return near.select("doc_id", F.col("pos").cast("long").alias("pos"), F.size("near").cast("long").alias("n_near"), F.aggregate("near", F.lit(0).cast("long"), lambda s, x: s + x).alias("pos_sum"))


@query("se01_distinct_in_order", "SELECT doc_id, len(l)::BIGINT AS n, md5(array_to_string(l, chr(10))) AS digest FROM (SELECT doc_id, list_filter(list_transform(list_distinct_keep(string_split(coalesce(text,''), chr(10))), lambda x: x), lambda x: x <> '') AS l FROM documents)".replace("list_distinct_keep(string_split(coalesce(text,''), chr(10)))", "list_filter(string_split(coalesce(text,''), chr(10)), lambda x, i: list_position(string_split(coalesce(text,''), chr(10)), x) = i)"))
def se01(spark, d):
    own = F.filter(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n")), lambda x: x != "")
    return read(spark, d, "documents").select("doc_id", F.size(own).cast("long").alias("n"), F.md5(F.array_join(own, "\n")).alias("digest"))


@query("se08_content_aliases", "SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS canonical_id, doc_id <> first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS is_alias FROM documents")
def se08(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    first = docs.groupBy("key").agg(F.min("doc_id").alias("canonical_id"))
    return docs.join(first, "key").select("doc_id", "canonical_id", (F.col("doc_id") != F.col("canonical_id")).alias("is_alias"))


@query("pj11_artifact_keys", """SELECT doc_id, sha256(sha256(text) || ':{"engine":"' || lang || '","type":"txt"}') AS artifact_key FROM documents""")
def pj11(spark, d):
    profile = F.concat(F.lit('{"engine":"'), "lang", F.lit('","type":"txt"}'))
    return read(spark, d, "documents").select("doc_id", F.sha2(F.concat(F.sha2("text", 256), F.lit(":"), profile), 256).alias("artifact_key"))


@query("pj02_table_markdown", r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text,''), chr(10))) AS part, generate_subscripts(string_split(coalesce(text,''), chr(10)), 1) AS no FROM documents)
SELECT doc_id, count(*) AS n_rows, md5(string_agg('| ' || array_to_string(list_transform(string_split(part, '|'), lambda x: trim(x)), ' | ') || ' |', chr(10) ORDER BY no)) AS digest FROM l WHERE contains(part, '|') GROUP BY doc_id""")
def pj02(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "part")).filter(F.contains("part", F.lit("|")))
    row = F.concat(F.lit("| "), F.array_join(F.transform(F.split("part", r"\|"), lambda x: F.trim(x)), " | "), F.lit(" |"))
    rows = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("no", row.alias("row")))).alias("r"))
    return rows.select("doc_id", F.size("r").cast("long").alias("n_rows"), F.md5(F.array_join(F.transform("r", lambda x: x["row"]), "\n")).alias("digest"))


@query("pj04_strict_text", r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '(?i)<img[^>]*>', '', 'g'), '<[^>]+>', '', 'g')) AS digest FROM pages""")
def pj04(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(t.without_html(t.without_images(F.col("html")))).alias("digest"))


CLEAN_SQL = r"regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"


@query("sc09_html_blocks", rf"SELECT page_id, regexp_extract(c, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS title, len(regexp_extract_all(c, '(?is)<p[^>]*>(.*?)</p>'))::BIGINT AS n_paragraphs, len(regexp_extract_all(c, '(?is)<li[^>]*>(.*?)</li>'))::BIGINT AS n_items, md5(trim(regexp_replace(regexp_replace(c, '<[^>]+>', ' ', 'g'), '[\s\x0B]+', ' ', 'g'))) AS digest FROM (SELECT page_id, {CLEAN_SQL} AS c FROM pages)")
def sc09(spark, d):
    clean = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""), r"(?s)<!--.*?-->", "")
    pages = read(spark, d, "pages").select("page_id", clean.alias("c"))
    n = lambda tag: F.regexp_count("c", F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>")).cast("long")
    return pages.select("page_id", F.regexp_extract("c", r"(?is)<h1[^>]*>(.*?)</h1>", 1).alias("title"), n("p").alias("n_paragraphs"), n("li").alias("n_items"), F.md5(t.collapsed(F.regexp_replace("c", r"<[^>]+>", " "))).alias("digest"))


@query("st22_search_match", rf"SELECT doc_id FROM documents WHERE list_contains(list_transform({TOKENS_SQL}, lambda x: lower(x)), 'the') AND list_contains(list_transform({TOKENS_SQL}, lambda x: lower(x)), 'licensed')")
def st22(spark, d):
    """Documents that hold every word of a query, as lower-case tokens."""
    own = F.transform(t.tokens(F.col("text")), lambda x: F.lower(x))
    return read(spark, d, "documents").filter(F.forall(F.array(F.lit("the"), F.lit("licensed")), lambda q: F.array_contains(own, q))).select("doc_id")


@query("so05_search_order", rf"""SELECT doc_id, hits::BIGINT AS hits, rank::BIGINT AS rank FROM (SELECT doc_id, hits, row_number() OVER (ORDER BY hits DESC, doc_id) AS rank FROM (
SELECT doc_id, len(list_filter({TOKENS_SQL}, lambda x: lower(x) = 'of')) AS hits FROM documents)) WHERE rank <= 50""")
def so05(spark, d):
    """The 50 best documents for a word; the report is the feature."""
    hits = F.size(F.filter(t.tokens(F.col("text")), lambda x: F.lower(x) == "of")).cast("long")
    top = read(spark, d, "documents").select("doc_id", hits.alias("hits")).orderBy(F.desc("hits"), "doc_id").limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), "doc_id")).cast("long"))
