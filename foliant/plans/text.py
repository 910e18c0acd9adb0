"""Queries of the text scalars over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.registry import query, read

TOKENS_SQL = r"regexp_extract_all(translate(coalesce(text,''), '" + t.FULL_WIDTH.replace("'", "''") + "', '" + t.HALF_WIDTH.replace("'", "''") + r"'), '" + t.TOKEN + "')"
FLAT_SQL = r"trim(regexp_replace(coalesce(text,''), '[\s\x0B]+', ' ', 'g'))"


@query("st01_position_tags", r"""SELECT doc_id, md5(regexp_replace('@@1-2' || chr(9) || '10.5' || chr(9) || '20##' || text, '@@[0-9-]+\t[0-9.\t]+##', '', 'g')) AS digest FROM documents""")
def st01(spark, d):
    tagged = F.concat(F.lit("@@1-2\t10.5\t20##"), "text")
    return read(spark, d, "documents").select("doc_id", F.md5(t.without_position_tags(tagged)).alias("digest"))


@query("st02_truncation", rf"""WITH f AS (SELECT doc_id, {FLAT_SQL} AS s FROM documents), h AS (SELECT doc_id, s, substr(s,1,80) AS head FROM f),
w AS (SELECT *, regexp_replace(regexp_replace(head, ' [^ ]*$', ''), '[ ,.;:，。；：]+$', '') AS word FROM h)
SELECT doc_id, CASE WHEN length(s) <= 80 THEN s ELSE rtrim(CASE WHEN word = '' THEN head ELSE word END) || '...' END AS short FROM w""")
def st02(spark, d):
    return read(spark, d, "documents").select("doc_id", t.truncated(F.col("text"), 80).alias("short"))


@query("st03_slugs", r"""SELECT page_id, CASE WHEN s='' THEN 'document' ELSE s END AS slug, CASE WHEN u='' THEN 'document' ELSE u END AS slug_unicode FROM (
SELECT page_id, regexp_replace(regexp_replace(trim(url), '[^0-9A-Za-z._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS s,
regexp_replace(regexp_replace(trim(url), '[^\p{L}\p{N}._-]', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS u FROM pages)""")
def st03(spark, d):
    return read(spark, d, "pages").select("page_id", t.slug(F.col("url")).alias("slug"), t.slug_unicode(F.col("url")).alias("slug_unicode"))


@query("st04_tokens", rf"SELECT doc_id, len({TOKENS_SQL})::BIGINT AS n_tokens, md5(array_to_string({TOKENS_SQL}, ' ')) AS digest FROM documents")
def st04(spark, d):
    own = t.tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(own).cast("long").alias("n_tokens"), F.md5(F.array_join(own, " ")).alias("digest"))


@query("st05_token_tags", rf"""SELECT tag, count(*) AS n, count(DISTINCT tok) AS kinds FROM (SELECT tok, CASE WHEN regexp_matches(tok,'^[\p{{Nd}}.,%]+$') THEN 'm' WHEN regexp_matches(tok,'^[\x{{4e00}}-\x{{9fff}}]+$') THEN 'n'
WHEN regexp_matches(tok,'^[\p{{L}}_-]+$') THEN 'eng' ELSE 'x' END AS tag FROM (SELECT unnest({TOKENS_SQL}) AS tok FROM documents)) GROUP BY tag""")
def st05(spark, d):
    tok = read(spark, d, "documents").select(F.explode(t.fine_tokens(F.col("text"))).alias("tok"))
    # Counts of tokens first, so that tags are taken once for each.
    kinds = tok.groupBy("tok").agg(F.count("*").alias("n")).withColumn("tag", t.token_tag(F.col("tok")))
    return kinds.groupBy("tag").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))


@query("st07_spaces_at_signs", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([^a-zA-Z0-9.,)>]) +([^\s])', '\1\2', 'g'), '([^\s]) +([^a-zA-Z0-9.,(<])', '\1\2', 'g')) AS digest FROM documents""")
def st07(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(t.without_spaces_at_signs(F.col("text"))).alias("digest"))


# Folded to ASCII: the other engine measures distances in bytes.
TURNS_SQL = r"SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM (SELECT conv_id, turn, regexp_replace(text, '[^ -~]', '?', 'g') AS text FROM conversations)"


@query("st08_edit_distance", f"""SELECT conv_id, turn, levenshtein(text, before)::BIGINT AS distance, CASE WHEN greatest(length(text), length(before)) = 0 THEN 0.0 ELSE levenshtein(text, before) / greatest(length(text), length(before)) END AS share,
levenshtein(text, before) / greatest(length(before), 1) AS cer FROM ({TURNS_SQL})""")
def st08(spark, d):
    from pyspark.sql import Window

    turns = read(spark, d, "conversations").withColumn("text", F.regexp_replace("text", "[^ -~]", "?")).withColumn("before", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    a, b = F.col("text"), F.col("before")
    return turns.select("conv_id", "turn", F.levenshtein(a, b).cast("long").alias("distance"), t.edit_share(a, b).alias("share"), t.error_rate(a, b).alias("cer"))


@query("st11_redaction", r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '(?i)\b(?:https?|redis|postgres(?:ql)?|s3)://[^\s"''<>]+', '<redacted>', 'g'), '(?i)(host=[''"]?)([^''",\s)]+)([''"]?)', '\1<redacted>\3', 'g'), '/(?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+', '<redacted>', 'g')) AS digest FROM pages""")
def st11(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(t.redacted(F.col("html"))).alias("digest"))


@query("st13_formula", r"""SELECT item_id, regexp_replace(regexp_replace(trim('$$ ' || text || ' $$'), '^\$\$|\$\$$|^\\\[|\\\]$|^\\\(|\\\)$|^\$|\$$', '', 'g'), '\s+', '', 'g') AS formula FROM benchmark""")
def st13(spark, d):
    return read(spark, d, "benchmark").select("item_id", t.formula(F.concat(F.lit("$$ "), "text", F.lit(" $$"))).alias("formula"))


@query("st14_match_text", rf"SELECT doc_id, md5(lower({FLAT_SQL})) AS digest FROM documents")
def st14(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(F.lower(t.collapsed(F.coalesce("text", F.lit(""))))).alias("digest"))


@query("st15_hash_buckets", "SELECT ('0x' || substr(sha1(url), 1, 8))::BIGINT % 97 AS bucket, count(*) AS n FROM pages GROUP BY 1")
def st15(spark, d):
    return read(spark, d, "pages").groupBy(t.bucket_of(F.col("url"), 97).alias("bucket")).agg(F.count("*").alias("n"))


@query("st17_tag_strip", "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest FROM pages")
def st17(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(t.without_html(F.col("html"))).alias("digest"))


@query("st19_identifiers", "SELECT p_partkey, coalesce(regexp_matches(p_brand, '^[A-Za-z_][A-Za-z0-9_]*$'), false) AS valid FROM part")
def st19(spark, d):
    return read(spark, d, "part").select("p_partkey", t.is_identifier(F.col("p_brand")).alias("valid"))


@query("st20_lists", "SELECT page_id, list_filter(list_transform(string_split(replace(url, '/', ','), ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM pages")
def st20(spark, d):
    return read(spark, d, "pages").select("page_id", t.listed(F.translate("url", "/", ",")).alias("parts"))


@query("st21_list_items", r"SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))) AS items FROM pages")
def st21(spark, d):
    items = F.regexp_extract_all("html", F.lit(r"(?is)<li[^>]*>(.*?)</li>"), 1)
    return read(spark, d, "pages").select("page_id", F.transform(items, lambda x: F.trim(t.without_html(x))).alias("items"))


@query("ag14_token_frequency", f"SELECT lower(tok) AS token, count(*) AS n FROM (SELECT unnest({TOKENS_SQL}) AS tok FROM documents) GROUP BY 1")
def ag14(spark, d):
    return read(spark, d, "documents").select(F.explode(t.tokens(F.col("text"))).alias("tok")).groupBy(F.lower("tok").alias("token")).agg(F.count("*").alias("n"))


CELLS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(trim(cell), '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in t.CELL_TYPES)


@query("tb05_cell_types", f"""WITH c AS (SELECT unnest(string_split(text, '|')) AS cell FROM documents WHERE text LIKE '%|%'),
k AS (SELECT cell, len(list_filter(regexp_extract_all(translate(trim(cell), '{t.FULL_WIDTH.replace("'", "''")}', '{t.HALF_WIDTH.replace("'", "''")}'), '{t.TOKEN}'), lambda x: length(x) > 1)) AS n FROM c)
SELECT kind, count(*) AS n FROM (SELECT {CELLS_SQL} WHEN n > 3 AND n < 12 THEN 'Tx' WHEN n >= 12 THEN 'Lx' ELSE 'Ot' END AS kind FROM k) GROUP BY kind""")
def tb05(spark, d):
    cells = read(spark, d, "documents").filter(F.contains("text", F.lit("|"))).select(F.explode(F.split("text", r"\|")).alias("cell"))
    return cells.groupBy(t.cell_type(F.col("cell")).alias("kind")).agg(F.count("*").alias("n"))


@query("wn01_title_levels", r"""SELECT conv_id, turn, least(CASE WHEN length(regexp_extract(s,'^(#+)',1)) > 0 THEN length(regexp_extract(s,'^(#+)',1)) WHEN regexp_extract(s,'^(\d+(?:\.\d+)*)',1) <> '' THEN length(regexp_extract(s,'^(\d+(?:\.\d+)*)',1)) - length(replace(regexp_extract(s,'^(\d+(?:\.\d+)*)',1),'.','')) + 1 ELSE 1 END, 6)::BIGINT AS level
FROM (SELECT conv_id, turn, trim(CASE turn % 3 WHEN 0 THEN repeat('#', (turn % 8 + 1)::INT) || ' ' WHEN 1 THEN '1.' || turn || '.2 ' ELSE '' END || text) AS s FROM conversations)""")
def wn01(spark, d):
    mark = F.when(F.col("turn") % 3 == 0, F.expr("repeat('#', cast(turn % 8 + 1 as int)) || ' '")).when(F.col("turn") % 3 == 1, F.expr("'1.' || turn || '.2 '")).otherwise("")
    return read(spark, d, "conversations").select("conv_id", "turn", t.title_level(F.concat(mark, "text")).cast("long").alias("level"))
