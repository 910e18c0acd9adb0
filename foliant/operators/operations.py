"""Operations over event logs: latest state, fixed windows, retention, retries,
publish state, admission, freshness, metrics and summaries.

Whatever depends on time takes ``as_of`` (a Column or literal timestamp)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key. An aggregate, not a window: each task sends one
    row a key, however many rows a key has."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_top"))
    return top.select(*keys, *(F.col(f"_top.{c}").alias(c) for c in rest))


def window_start(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)


def limited(events: DataFrame, identity: Sequence[str], limit: int, seconds: int, amount: Column | None = None, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``events`` with ``bucket``, ``used``, ``allowed``, ``remaining`` of a limit for
    each identity and fixed window. Denied events count as used."""
    cost = F.greatest(F.coalesce(amount if amount is not None else F.lit(1), F.lit(1)), F.lit(1)).cast("long")
    rows = events.withColumn("bucket", window_start(F.col(ts), seconds)).withColumn("_cost", cost)
    w = Window.partitionBy(*identity, "bucket").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    used = rows.withColumn("used", F.sum("_cost").over(w)).drop("_cost")
    return used.withColumn("allowed", F.col("used") <= limit).withColumn("remaining", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)))


def expired(df: DataFrame, age: Column, as_of: Column, days: int, keep_latest: int = 0, order: Sequence[Column] = (), strict: bool = False, active: Column | None = None, bad_is_old: bool = False, on_kept: bool = False) -> DataFrame:
    """Rows that retention removes: older than ``days`` (``strict``: not those at the
    bound) and, if ``keep_latest``, not among the newest, which are counted over all
    rows or (``on_kept``) over those that qualify; ``active`` rows never go."""
    cutoff = as_of - F.make_dt_interval(F.lit(max(0, days)))
    old = (age < cutoff) if strict else (age <= cutoff)
    old = F.coalesce(old, F.lit(bad_is_old))
    if active is not None:
        old = old & ~active
    rows = df.withColumn("_old", old)
    if on_kept:
        rows = rows.filter("_old")
    if keep_latest > 0:
        # The newest few come from a top-k, not from ordering all rows in one task. Nulls
        # are equal here, and of equal rows only as many stay as are among the newest.
        names = [f"_k{i}" for i in range(len(df.columns))]
        newest = rows.orderBy(*order).limit(keep_latest).groupBy(*df.columns).agg(F.count("*").alias("_stay")).toDF(*names, "_stay")
        same = [rows[c].eqNullSafe(newest[n]) for c, n in zip(df.columns, names, strict=True)]
        tied = rows.join(newest, same).withColumn("_no", F.row_number().over(Window.partitionBy(*df.columns).orderBy(F.lit(1))))
        rows = rows.join(newest, same, "left_anti").unionByName(tied.filter("_no > _stay").select(*rows.columns))
    return rows.filter("_old").drop("_old")


def retry_due(df: DataFrame, as_of: Column) -> DataFrame:
    """Failed rows that may be tried again now (status, dead, retryable, next_at)."""
    return df.filter((F.col("status") == "failed") & ~F.col("dead") & F.col("retryable") & (F.col("next_at").isNull() | (F.col("next_at") <= as_of)))


def publish_state(attempts: DataFrame, key: str, order: Sequence[str], ok: Column, at: str, most: int = 5, base: int = 60, cap: int = 3600) -> DataFrame:
    """State after all attempts of a key: how many failed since the last success,
    when the next is due (doubling delays) and whether it is given up."""
    rows = attempts.withColumn("_ok", ok).withColumn("_o", F.struct(*order))
    last_ok = rows.groupBy(key).agg(F.max(F.when(F.col("_ok"), F.col("_o"))).alias("_last_ok"))
    both = rows.join(last_ok, key)
    since = (~F.col("_ok")) & (F.col("_last_ok").isNull() | (F.col("_o") > F.col("_last_ok")))
    out = both.groupBy(key).agg(F.count("*").alias("attempts"), F.count_if("_ok").alias("succeeded"), F.count_if(since).alias("failing"), F.max(at).alias("last_at"))
    delay = F.least(F.lit(base) * F.pow(F.lit(2), F.least(F.col("failing") - 1, F.lit(20))), F.lit(cap)).cast("long")
    status = F.when(F.col("failing") == 0, "published").otherwise("failed")
    return out.withColumn("status", status).withColumn("dead", F.col("failing") >= most).withColumn("next_at", F.when((F.col("failing") > 0) & (F.col("failing") < most), F.timestamp_seconds(F.unix_timestamp("last_at") + delay)))


def in_flight(changes: DataFrame, pool: str, ts: str, tie: str, step: str) -> DataFrame:
    """``changes`` (+1, -1) with the number in flight after each."""
    w = Window.partitionBy(pool).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    return changes.withColumn("in_flight", F.sum(step).over(w))


def histogram(df: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Count, sum and cumulative buckets for each set of labels."""
    buckets = [F.count_if(F.col(value) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return df.groupBy(*labels).agg(F.count(value).alias("n"), F.sum(value).alias("total"), *buckets)


def freshness(beats: DataFrame, key: str, ts: str, as_of: Column, within: int) -> DataFrame:
    """(key, last, age_s, fresh) of each worker."""
    out = beats.groupBy(key).agg(F.max(ts).alias("last")).withColumn("age_s", F.unix_timestamp(as_of) - F.unix_timestamp("last"))
    return out.withColumn("fresh", F.col("age_s") <= within)


def stages(df: DataFrame, stage: str, seconds: str) -> DataFrame:
    """Totals of each stage with its share and rank; names break ties."""
    out = df.groupBy(stage).agg(F.sum(seconds).alias("total"), F.count("*").alias("n"))
    every = Window.partitionBy()
    return out.withColumn("share", F.col("total") / F.sum("total").over(every)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), stage)))


def outcomes(df: DataFrame, keys: Sequence[str], done: Column, failed: Column) -> DataFrame:
    """Counts of a sweep and its outcome: noop, ok, partial or failed."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(done).alias("done"), F.count_if(failed).alias("failed"))
    state = F.when(F.col("done") + F.col("failed") == 0, "noop").when(F.col("failed") == 0, "ok").when(F.col("done") == 0, "failed").otherwise("partial")
    return out.withColumn("outcome", state)
