"""Queries of the evaluation metrics and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import evaluation as e
from foliant.operators import store as s
from foliant.plans.documents import BLOCKS_SQL, doc_blocks
from foliant.registry import query, read

SCORES_SQL = "coalesce(sum(least(coalesce(a,0), coalesce(b,0))), 0)::BIGINT AS hit, coalesce(sum(a),0)::BIGINT AS seen, coalesce(sum(b),0)::BIGINT AS true"


@query("ag19_item_scores", f"""WITH a AS (SELECT l_orderkey AS k, l_returnflag AS x, count(*) AS a FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL), b AS (SELECT l_orderkey AS k, l_returnflag AS x, count(*) AS b FROM lineitem GROUP BY ALL),
n AS (SELECT k, {SCORES_SQL} FROM a FULL JOIN b USING (k, x) GROUP BY k), p AS (SELECT *, CASE WHEN seen > 0 THEN hit / seen ELSE 0.0 END AS p, CASE WHEN "true" > 0 THEN hit / "true" ELSE 0.0 END AS r FROM n)
SELECT k AS l_orderkey, hit, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 9) AS f1 FROM p""")
def ag19(spark, d):
    true = read(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    out = e.multiset_scores(true.filter("l_linestatus = 'O'"), true, "l_orderkey", "l_returnflag")
    return out.select("l_orderkey", "hit", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("ag20_cell_scores", f"""WITH {BLOCKS_SQL}, c AS (SELECT doc_id, pos, trim(unnest(string_split(text, '|'))) AS x FROM b WHERE block_type = 'table'),
a AS (SELECT doc_id AS k, x, 1 AS a FROM c GROUP BY ALL), b2 AS (SELECT doc_id AS k, x, count(*) AS b FROM c GROUP BY ALL)
SELECT k AS doc_id, {SCORES_SQL} FROM a FULL JOIN b2 USING (k, x) GROUP BY k""")
def ag20(spark, d):
    cells = doc_blocks(spark, d).filter("block_type = 'table'").select("doc_id", "pos", F.explode(F.transform(F.split("text", r"\|"), lambda x: F.trim(x))).alias("x"))
    return e.multiset_scores(cells.select("doc_id", "x").distinct(), cells, "doc_id", "x").select("doc_id", "hit", "seen", "true")


@query("ag21_metric_means", "SELECT count(*) AS samples, round(avg(quality), 9) AS mean_quality, count(quality) AS n_quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def ag21(spark, d):
    rows = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    return e.summary(rows, ["quality"]).withColumn("mean_quality", F.round("mean_quality", 9))


@query("st09_word_error_rate")
def st09(spark, d):
    turns = read(spark, d, "conversations").withColumn("before", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    return turns.select("conv_id", "turn", e.word_error_rate("text", "before").alias("wer"))


@query("jn18_paired_by_place", "SELECT a.p_partkey, b.s_suppkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS no FROM part) a JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS no FROM supplier) b USING (no)")
def jn18(spark, d):
    part, supplier = read(spark, d, "part").select("p_partkey", "p_retailprice"), read(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return s.one_to_one(part, supplier, ["p_retailprice", "p_partkey"], ["s_acctbal", "s_suppkey"]).select("p_partkey", "s_suppkey")


@query("jn25_paired_reports", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS in_documents, l.doc_id IS NOT NULL AS in_labels FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id")
def jn25(spark, d):
    a = read(spark, d, "documents").select("doc_id", F.lit(True).alias("a"))
    b = read(spark, d, "labels").select("doc_id", F.lit(True).alias("b"))
    return a.join(b, "doc_id", "full").select("doc_id", F.coalesce("a", F.lit(False)).alias("in_documents"), F.coalesce("b", F.lit(False)).alias("in_labels"))


@query("ev01_dataset_problems", """SELECT doc_id, problem FROM (SELECT d.doc_id, unnest(list_filter([CASE WHEN coalesce(trim(text),'')='' THEN 'empty' END, CASE WHEN l.doc_id IS NULL THEN 'no_truth' END, CASE WHEN n_chars > 20000 THEN 'too_long' END], lambda x: x IS NOT NULL)) AS problem FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""")
def ev01(spark, d):
    docs = read(spark, d, "documents").select("doc_id", (F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty"), "n_chars")
    rows = docs.join(read(spark, d, "labels").select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    return e.problems(rows, "doc_id", {"empty": F.col("empty"), "no_truth": F.col("known").isNull(), "too_long": F.col("n_chars") > 20000})


@query("ev02_license_gate", "SELECT source, bool_and(contains(text, 'Apache License') OR NOT contains(text, 'Licensed under')) AS cleared, count(*) FILTER (WHERE contains(text, 'Licensed under')) AS n_licensed FROM documents GROUP BY source")
def ev02(spark, d):
    has = lambda x: F.contains("text", F.lit(x))
    return read(spark, d, "documents").groupBy("source").agg(F.bool_and(has("Apache License") | ~has("Licensed under")).alias("cleared"), F.count_if(has("Licensed under")).alias("n_licensed"))


@query("ev04_gates", """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS price FROM orders), b AS (SELECT o_orderkey AS k, o_totalprice * 0.5 AS price FROM orders)
SELECT 'price' AS metric, round(avg(a.price), 4) AS baseline, round(avg(b.price), 4) AS candidate, avg(b.price) <= avg(a.price) + 1e-6 AS passed FROM a JOIN b USING (k)""")
def ev04(spark, d):
    orders = read(spark, d, "orders")
    base, new = orders.selectExpr("o_orderkey AS k", "o_totalprice AS price"), orders.selectExpr("o_orderkey AS k", "o_totalprice * 0.5 AS price")
    return e.gates(base, new, "k", {"price": "less"}).select("metric", F.round("baseline", 4).alias("baseline"), F.round("candidate", 4).alias("candidate"), "passed")


@query("jn19_covered_texts", f"""WITH {BLOCKS_SQL} SELECT DISTINCT a.doc_id, a.pos::BIGINT AS pos FROM b a JOIN b z ON z.doc_id = a.doc_id AND z.pos % 2 = 1 AND contains(z.text, a.text) WHERE a.pos % 2 = 0""")
def jn19(spark, d):
    """Even blocks are expected, odd ones seen."""
    blocks = doc_blocks(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), "text")
    return e.covered(blocks.filter("pos % 2 = 0"), blocks.filter("pos % 2 = 1"), "doc_id", "text").select("doc_id", "pos")


FIELD_SQL = "f AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS no, l_returnflag || '  x' AS value, CASE WHEN l_partkey % 3 = 0 THEN [] ELSE [l_linenumber] END AS pages FROM lineitem), k AS (SELECT l_orderkey AS s, 'a ' || lower(l_returnflag || l_linestatus) || ' ' || lower(l_returnflag) || ' x' AS text, CASE WHEN l_suppkey % 4 = 0 THEN [] ELSE [l_linenumber, l_linenumber + 1] END AS pages FROM lineitem WHERE l_quantity > 20)"


@query("jn20_field_hits", f"WITH {FIELD_SQL} SELECT s, no, value, pages FROM f WHERE EXISTS (SELECT 1 FROM k WHERE k.s = f.s AND contains(k.text, lower(substr(f.value, 1, 1)) || ' x') AND (len(k.pages) = 0 OR len(f.pages) = 0 OR list_has_any(k.pages, f.pages)))")
def jn20(spark, d):
    rows, line, none = read(spark, d, "lineitem"), F.col("l_linenumber").cast("long"), F.array().cast("array<bigint>")
    fields = rows.select(F.col("l_orderkey").alias("s"), F.col("l_partkey").alias("no"), F.concat("l_returnflag", F.lit("  x")).alias("value"), F.when(F.col("l_partkey") % 3 == 0, none).otherwise(F.array(line)).alias("pages")).distinct()
    text = F.concat(F.lit("A  "), "l_returnflag", "l_linestatus", F.lit(" "), "l_returnflag", F.lit(" x"))
    blocks = rows.filter("l_quantity > 20").select(F.col("l_orderkey").alias("s"), text.alias("text"), F.when(F.col("l_suppkey") % 4 == 0, none).otherwise(F.array(line, line + 1)).alias("pages"))
    return e.field_hits(fields, blocks, "s")


@query("jn17_matched_blocks", """WITH RECURSIVE e AS (SELECT l_orderkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS no, l_linestatus AS kind, repeat('a', 1 + l_suppkey::INT % 3) || CASE WHEN l_partkey % 2 = 0 THEN 'b' ELSE '' END AS text FROM lineitem),
p AS (SELECT s, list(struct_pack(no, kind, text) ORDER BY no) AS free FROM (SELECT s, no, kind, CASE WHEN no % 3 = 0 THEN 'c' ELSE substr(text, 1, 2) END AS text FROM e WHERE no % 4 <> 3) GROUP BY s),
n AS (SELECT s, count(*) AS n FROM e GROUP BY s), r AS (SELECT n.s, 0::BIGINT AS i, coalesce(p.free, []) AS free FROM n LEFT JOIN p USING (s)
UNION ALL SELECT r.s, r.i + 1, CASE WHEN len(fit) > 0 THEN list_filter(r.free, lambda y: y.no <> fit[1].no) ELSE r.free END FROM r JOIN e ON e.s = r.s AND e.no = r.i + 1, LATERAL (SELECT list_filter(r.free, lambda y: y.kind = e.kind AND (contains(y.text, e.text) OR contains(e.text, y.text))) AS fit))
SELECT n.s, n.n::INT AS n_expected, len(coalesce(p.free, []))::INT AS n_seen, (len(coalesce(p.free, [])) - len(r.free))::INT AS n_matched FROM n JOIN r ON r.s = n.s AND r.i = n.n LEFT JOIN p ON p.s = n.s""")
def jn17(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    text = F.concat(F.repeat(F.lit("a"), (1 + F.col("l_suppkey") % 3).cast("int")), F.when(F.col("l_partkey") % 2 == 0, "b").otherwise(""))
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("s"), F.row_number().over(w).cast("long").alias("no"), F.col("l_linestatus").alias("kind"), text.alias("text"))
    seen = rows.filter("no % 4 <> 3").withColumn("text", F.when(F.col("no") % 3 == 0, "c").otherwise(F.substring("text", 1, 2)))
    return e.matched_blocks(rows, seen, "s")


@query("ev03_dataset_report", """WITH q AS (SELECT l_orderkey AS s, avg(l_quantity) AS quality FROM lineitem WHERE l_quantity > 10 GROUP BY 1), t AS (SELECT l_orderkey AS s, avg(l_tax) AS toxicity FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1)
SELECT count(*) AS samples, round(avg(quality), 6) AS mean_quality, round(avg(toxicity), 6) AS mean_toxicity, count(quality) AS n_quality, count(toxicity) AS n_toxicity FROM (SELECT o_orderkey AS s FROM orders) LEFT JOIN q USING (s) LEFT JOIN t USING (s)""")
def ev03(spark, d):
    rows, key = read(spark, d, "lineitem"), F.col("l_orderkey").alias("s")
    q = rows.filter("l_quantity > 10").groupBy(key).agg(F.avg("l_quantity").alias("quality"))
    t = rows.filter("l_partkey % 2 = 0").groupBy(key).agg(F.avg("l_tax").alias("toxicity"))
    _, out = e.dataset_report(read(spark, d, "orders").select(F.col("o_orderkey").alias("s")), ["quality", "toxicity"], [q, t], "s")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_quality", "mean_toxicity")})


def _planted(no: int):
    """Whether an order breaks the rule of a number; each rule meets every 37th."""
    return F.col("o_orderkey") % 37 == no


PROBLEMS = (
    "manifest missing", "manifest parse_id", "manifest chunk_count", "chunk records missing", "ingest records missing", "chunk records count", "ingest records count", "context version", "direct_block_refs missing", "context_block_refs missing",
    "direct_chunk_refs missing", "context_chunk_refs missing", "chunk_refs missing", "unknown direct_block_refs", "unknown context_block_refs", "unknown direct_chunk_refs", "unknown context_chunk_refs", "unknown chunk_refs", "context_texts missing", "summary version", "summary source",
    "summary empty", "summary facts missing", "empty chunk", "unknown block_refs", "unknown asset_refs", "strategy missing", "empty record", "record version", "record strategy missing", "empty ingest", "ingest version", "ingest chunk version",
)
# A broken context is reported for the asset and again for its record.


@query("bl15_quality_report", "WITH o AS (SELECT o_orderkey AS k, o_orderkey % 37 AS r FROM orders) SELECT 'p-' || k AS parse_id, unnest(CASE WHEN r BETWEEN 7 AND 22 THEN ['a-' || k, 'c-' || k || ':a-' || k] WHEN r < 7 THEN ['p-' || k] WHEN r >= 30 THEN ['r-' || k] ELSE ['c-' || k] END) AS label, CASE r " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PROBLEMS)) + f" END AS problem FROM o WHERE r < {len(PROBLEMS)}")
def bl15(spark, d):
    """Parses of which each breaks one of the rules, or none."""
    from foliant.operators import pages

    k, v, no = F.col("o_orderkey").cast("string"), pages.VERSIONS, {p: i for i, p in enumerate(PROBLEMS)}
    bad = lambda p: _planted(no[p])
    name = lambda x: F.concat(F.lit(f"{x}-"), k)
    ids = {"block": name("b"), "chunk": name("c")}
    pick = lambda p, broken, right: F.when(bad(p), broken).otherwise(right)
    one = lambda c: F.array(c).cast("array<string>")
    lists = [F.when(~bad(f"{x} missing"), one(pick(f"unknown {x}", "?", ids["block" if "block" in x else "chunk"]))).alias(x) for x in pages.CONTEXT_LISTS]
    context = F.struct(
        pick("context version", "v0", v["context"]).alias("schema_version"), *lists, F.when(~bad("context_texts missing"), one(F.lit("t"))).alias("context_texts"), pick("summary version", "v0", v["summary"]).alias("summary_version"),
        pick("summary source", "model", "local_rules").alias("summary_source"), pick("summary empty", " ", "s").alias("summary"), F.when(~bad("summary facts missing"), F.create_map(F.lit("n"), F.lit("1"))).alias("summary_facts"),
    )
    assets = F.array(F.struct(name("a").alias("asset_id"), context.alias("context")))
    chunk = F.struct(name("c").alias("chunk_id"), pick("empty chunk", "", "t").alias("text"), one(pick("unknown block_refs", "?", ids["block"])).alias("block_refs"), one(pick("unknown asset_refs", "?", name("a"))).alias("asset_refs"), pick("strategy missing", "", "plain").alias("strategy"))
    record = F.struct(name("c").alias("chunk_id"), pick("empty record", "", "t").alias("text"), pick("record version", "v0", v["chunk"]).alias("schema_version"), pick("record strategy missing", "", "plain").alias("strategy"), assets.alias("assets"))
    ingest = F.struct(name("r").alias("record_id"), pick("empty ingest", "", "t").alias("text"), pick("ingest version", "v0", v["ingest"]).alias("schema_version"), pick("ingest chunk version", "v0", v["chunk"]).alias("chunk_schema_version"))
    twice = lambda p, x: F.when(bad(p), F.array(x, x)).otherwise(F.array(x))
    manifest = F.struct(pick("manifest parse_id", "?", name("p")).alias("parse_id"), pick("manifest chunk_count", F.lit(9), F.lit(1)).alias("chunk_count"))
    rows = read(spark, d, "orders").select(
        name("p").alias("parse_id"), F.when(~bad("manifest missing"), manifest).alias("manifest"), F.array(ids["block"]).alias("block_ids"), F.array(ids["chunk"]).alias("chunk_ids"), F.array(name("a")).alias("asset_ids"),
        assets.alias("assets"), F.array(chunk).alias("chunks"), F.when(~bad("chunk records missing"), twice("chunk records count", record)).alias("chunk_records"), F.when(~bad("ingest records missing"), twice("ingest records count", ingest)).alias("ingest_records"),
    )
    return pages.quality_report(rows)
