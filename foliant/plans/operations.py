"""Queries of the operations plane over ``events``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import operations as o
from foliant.registry import query, read

def as_of():
    """The moment that time-dependent queries look from."""
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


T = "TIMESTAMP '2024-01-31 00:00:00'"


def events(spark, d):
    return read(spark, d, "events")


@query("fl04_audit_filter", "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error','purchase') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def fl04(spark, d):
    return events(spark, d).filter(F.col("event_type").isin("error", "purchase") & (F.col("ts") >= "2024-01-10") & (F.col("ts") < "2024-01-20")).select("event_id", "user_id", "event_type")


CALLBACK_SQL = "SELECT event_id, CASE WHEN props IS NULL OR event_type = 'view' THEN 'none' ELSE coalesce(nullif(CASE event_type WHEN 'purchase' THEN 'delivered' WHEN 'error' THEN 'failed' ELSE '' END, ''), 'pending') END AS callback FROM events"


@query("fl05_callback_filter", f"SELECT event_id, callback FROM ({CALLBACK_SQL}) WHERE callback IN ('pending', 'failed')")
def fl05(spark, d):
    known = F.when(F.col("event_type") == "purchase", "delivered").when(F.col("event_type") == "error", "failed")
    callback = F.when(F.col("props").isNull() | (F.col("event_type") == "view"), "none").otherwise(F.coalesce(known, F.lit("pending")))
    return events(spark, d).select("event_id", callback.alias("callback")).filter(F.col("callback").isin("pending", "failed"))


@query("fl06_retry_candidates", f"SELECT event_id FROM events WHERE event_type = 'error' AND NOT (value > 180) AND user_id % 2 = 0 AND ts + INTERVAL 1 DAY <= {T}")
def fl06(spark, d):
    rows = events(spark, d).select("event_id", F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), (F.col("value") > 180).alias("dead"), (F.col("user_id") % 2 == 0).alias("retryable"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("next_at"))
    return o.retry_due(rows, as_of()).select("event_id")


@query("fl07_retry_eligibility", f"""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS last_at FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN state IN ('view','click') THEN 'active' WHEN state = 'purchase' THEN 'succeeded' WHEN last_at > {T} - INTERVAL 6 HOUR THEN 'cooldown' ELSE 'eligible' END AS reason FROM l""")
def fl07(spark, d):
    last = o.latest(events(spark, d).select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    reason = F.when(F.col("event_type").isin("view", "click"), "active").when(F.col("event_type") == "purchase", "succeeded").when(F.col("ts") > as_of() - F.expr("INTERVAL 6 HOURS"), "cooldown").otherwise("eligible")
    return last.select("user_id", reason.alias("reason"))


@query("wn04_latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def wn04(spark, d):
    return o.latest(events(spark, d).select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "ts")


@query("wn05_fixed_window_limit", """SELECT event_id, used::BIGINT AS used, used <= 3 AS allowed, greatest(3 - used, 0)::BIGINT AS remaining FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 DAY, ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events)""")
def wn05(spark, d):
    return o.limited(events(spark, d), ["user_id"], 3, 86400).select("event_id", "used", "allowed", F.col("remaining").cast("long").alias("remaining"))


@query("wn12_stale_tasks", f"SELECT user_id, max(ts) AS heartbeat FROM events GROUP BY user_id HAVING {T} - max(ts) > INTERVAL 12 HOUR")
def wn12(spark, d):
    return o.freshness(events(spark, d), "user_id", "ts", as_of(), 12 * 3600).filter("NOT fresh").select("user_id", F.col("last").alias("heartbeat"))


@query("wn13_worker_freshness", f"SELECT event_type AS worker, date_diff('second', max(ts), {T}) AS age_s, date_diff('second', max(ts), {T}) <= 3600 AS fresh FROM events GROUP BY event_type")
def wn13(spark, d):
    return o.freshness(events(spark, d), "event_type", "ts", as_of(), 3600).select(F.col("event_type").alias("worker"), "age_s", "fresh")


@query("rt01_expired_artifacts", f"WITH k AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT event_id FROM k WHERE ts <= {T} - INTERVAL 7 DAY AND rn > 500")
def rt01(spark, d):
    rows = events(spark, d).select("event_id", "ts")
    return o.expired(rows, F.col("ts"), as_of(), 7, 500, [F.desc("ts"), F.desc("event_id")]).select("event_id")


@query("rt02_expired_tasks", f"SELECT event_id FROM events WHERE coalesce(CASE WHEN event_type = 'purchase' THEN ts + INTERVAL 1 HOUR END, ts) <= {T} - INTERVAL 14 DAY AND event_type <> 'view'")
def rt02(spark, d):
    finished = F.when(F.col("event_type") == "purchase", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    return o.expired(events(spark, d), F.coalesce(finished, "ts"), as_of(), 14, active=F.col("event_type") == "view").select("event_id")


@query("rt03_expired_audit", f"WITH f AS (SELECT event_id, ts FROM events WHERE ts < {T} - INTERVAL 10 DAY), k AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM f) SELECT event_id FROM k WHERE rn > 200")
def rt03(spark, d):
    rows = events(spark, d).select("event_id", "ts")
    return o.expired(rows, F.col("ts"), as_of(), 10, 200, [F.desc("ts"), F.desc("event_id")], strict=True, on_kept=True).select("event_id")


@query("rt04_expired_checks", f"SELECT event_id FROM events WHERE coalesce(CASE WHEN event_type <> 'click' THEN ts END <= {T} - INTERVAL 20 DAY, true)")
def rt04(spark, d):
    at = F.when(F.col("event_type") != "click", F.col("ts"))
    return o.expired(events(spark, d), at, as_of(), 20, bad_is_old=True).select("event_id")


@query("rt06_retry_attempts", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS source_id FROM events WHERE event_type = 'error'")
def rt06(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, d).filter("event_type = 'error'").select("event_id", "user_id", F.row_number().over(w).cast("long").alias("attempt"), F.lag("event_id").over(w).alias("source_id"))


@query("sm06_in_flight", "SELECT event_id, sum(CASE WHEN event_type IN ('view','signup') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS in_flight FROM events")
def sm06(spark, d):
    step = F.when(F.col("event_type").isin("view", "signup"), 1).otherwise(-1)
    return o.in_flight(events(spark, d).withColumn("step", step), "user_id", "ts", "event_id", "step").select("event_id", "in_flight")


@query("sm08_publish_state", """WITH e AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('purchase','error')),
l AS (SELECT user_id, max((ts, event_id)) FILTER (WHERE ok) AS last_ok FROM e GROUP BY user_id),
s AS (SELECT e.user_id, count(*) AS attempts, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok AND (last_ok IS NULL OR (ts, event_id) > last_ok)) AS failing, max(ts) AS last_at FROM e JOIN l USING (user_id) GROUP BY e.user_id)
SELECT user_id, attempts, succeeded, failing, CASE WHEN failing = 0 THEN 'published' ELSE 'failed' END AS status, failing >= 5 AS dead FROM s""")
def sm08(spark, d):
    tries = events(spark, d).filter(F.col("event_type").isin("purchase", "error"))
    return o.publish_state(tries, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", "ts").select("user_id", "attempts", "succeeded", "failing", "status", "dead")


@query("ag08_task_summary", "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed, list(event_id ORDER BY event_id) FILTER (WHERE event_type = 'error') AS failed_ids FROM events GROUP BY user_id")
def ag08(spark, d):
    bad = F.col("event_type") == "error"
    ids = F.array_sort(F.collect_list(F.when(bad, F.col("event_id"))))
    out = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"), ids.alias("failed_ids"))
    return out.withColumn("failed_ids", F.when(F.col("failed") > 0, F.col("failed_ids")))


@query("ag09_pool_totals", "SELECT event_type AS pool, sum(n)::BIGINT AS jobs, list(user_id ORDER BY user_id) AS devices FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def ag09(spark, d):
    each = events(spark, d).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return each.groupBy(F.col("event_type").alias("pool")).agg(F.sum("n").alias("jobs"), F.array_sort(F.collect_list("user_id")).alias("devices"))


@query("ag10_page_dispatch", "SELECT device, count(*) AS n, count(*) FILTER (WHERE length(html) > 1500) AS n_long FROM (SELECT html, (row_number() OVER (ORDER BY page_id) - 1) % 2 AS device FROM pages) GROUP BY device")
def ag10(spark, d):
    # Round-robin by place in the order of ids.
    from foliant.operators.store import numbered

    pages = read(spark, d, "pages").select("page_id", F.length("html").alias("n"))
    return numbered(pages, ["page_id"]).withColumn("device", F.col("place") % 2).groupBy("device").agg(F.count("*").alias("n"), F.count_if(F.col("n") > 1500).alias("n_long"))


@query("ag22_stage_timings", "SELECT event_type AS stage, round(total, 6) AS total, n, round(total / sum(total) OVER (), 9) AS share, row_number() OVER (ORDER BY total DESC, event_type) AS rank FROM (SELECT event_type, sum(value) AS total, count(*) AS n FROM events GROUP BY event_type)")
def ag22(spark, d):
    return o.stages(events(spark, d), "event_type", "value").select(F.col("event_type").alias("stage"), F.round("total", 6).alias("total"), "n", F.round("share", 9).alias("share"), F.col("rank").cast("long").alias("rank"))


@query("ag24_histogram", "SELECT event_type, count(value) AS n, round(sum(value), 6) AS total, count(*) FILTER (WHERE value <= 5) AS le_5, count(*) FILTER (WHERE value <= 25) AS le_25, count(*) FILTER (WHERE value <= 100) AS le_100 FROM events GROUP BY event_type")
def ag24(spark, d):
    return o.histogram(events(spark, d), ["event_type"], "value", [5, 25, 100]).withColumn("total", F.round("total", 6))


@query("ag25_state_gauges", "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{x}') AS \"{x}\"" for x in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
def ag25(spark, d):
    return events(spark, d).groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).count().na.fill(0)


@query("ag26_activity_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def ag26(spark, d):
    return events(spark, d).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("ag27_sweep_outcomes", "SELECT user_id, n, done, failed, CASE WHEN done + failed = 0 THEN 'noop' WHEN failed = 0 THEN 'ok' WHEN done = 0 THEN 'failed' ELSE 'partial' END AS outcome FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type='purchase') AS done, count(*) FILTER (WHERE event_type='error') AS failed FROM events GROUP BY user_id)")
def ag27(spark, d):
    return o.outcomes(events(spark, d), ["user_id"], F.col("event_type") == "purchase", F.col("event_type") == "error")


@query("se09_replay_dedup", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def se09(spark, d):
    rows = events(spark, d).select("event_id")
    return rows.union(rows).dropDuplicates(["event_id"]).agg(F.count("*").alias("n"), F.count("event_id").alias("ids"))


@query("sm05_window_counts", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def sm05(spark, d):
    from foliant.streaming.events import windowed

    return windowed(events(spark, d), "1 hour")


@query("dt01_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, date_part('year', ts) AS year, date_part('month', ts) AS month, date_part('day', ts) AS day FROM events")
def dt01(spark, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    back = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    part = lambda x: F.extract(F.lit(x), back).cast("long").alias(x)
    return events(spark, d).select("event_id", iso.alias("iso"), part("year"), part("month"), part("day"))


@query("dt02_ages", f"SELECT event_id, date_diff('second', ts, {T}) AS age_s FROM events")
def dt02(spark, d):
    return events(spark, d).select("event_id", (F.unix_timestamp(as_of()) - F.unix_timestamp("ts")).alias("age_s"))


@query("dt04_day_differences", f"SELECT o_orderkey, date_diff('day', o_orderdate::DATE, ({T})::DATE) AS days FROM orders")
def dt04(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.datediff(as_of(), "o_orderdate").cast("long").alias("days"))
