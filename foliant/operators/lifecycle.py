"""Tasks, checks, audit, manifests and résumé rows: who may go on, what happened, and
what is left to do. ``as_of`` is always given."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: States in which a task is over.
TERMINAL = ("succeeded", "failed", "cancelled")
#: Codes of degrees and their names.
DEGREES = {
    "94": "EMBA", "6": "MBA", "95": "MPA", "92": "专升本", "4": "专科", "90": "中专", "91": "中技",
    "86": "初中", "3": "博士", "10": "博士后", "1": "本科", "2": "硕士", "87": "职高", "89": "高中",
}
#: What a company's name ends with, beside its own name.
CORP_TAIL = r"([—-]+.*| +co\..*|corp\..*| +inc\..*| +ltd.*)"
CORP_KIND = "(计算机|技术|(技术|科技|网络)*有限公司|公司|有限|研发中心|中国|总部)$"


def redrive_due(tasks: DataFrame, as_of: Column, cooldown: int) -> DataFrame:
    """Finished tasks with a callback that may be delivered again (status,
    has_callback, callback_status or null, next_retry_at, last_attempt_at, updated_at)."""
    state = F.lower(F.trim("callback_status"))
    state = F.when(state == "", "pending").otherwise(state)
    since = F.coalesce("last_attempt_at", "updated_at")
    # By the moments as they are: seconds cut off would end the wait too early.
    cool = F.lit(True) if cooldown <= 0 else F.coalesce(since <= as_of - F.make_dt_interval(secs=F.lit(cooldown)), F.lit(True))
    later = F.coalesce(F.col("next_retry_at") > as_of, F.lit(False))
    ready = F.col("callback_status").isNull() | (~state.isin("pending", "delivering") & ~later & cool)
    return tasks.filter(F.col("has_callback") & F.col("status").isin(*TERMINAL) & ready)


def cancelled(tasks: DataFrame, wanted: Column, as_of: Column) -> DataFrame:
    """``tasks`` after a cancellation of those ``wanted``: what waits is cancelled at
    once, what runs is asked to stop, what is over stays."""
    now = F.when(wanted & (F.col("status") == "queued"), "cancelled").when(wanted & (F.col("status") == "running"), "cancel_requested").otherwise(F.col("status"))
    rows = tasks.withColumn("_new", now)
    return rows.withColumns({"changed": F.col("_new") != F.col("status"), "finished_at": F.when((F.col("_new") == "cancelled") & (F.col("status") != "cancelled"), F.coalesce("finished_at", as_of)).otherwise(F.col("finished_at")), "status": F.col("_new")}).drop("_new")


def self_check(steps: DataFrame, run: str) -> DataFrame:
    """(run, no, name, status, verdict) of ordered steps (no, name, needs, ok): one
    with a need that hasn't passed is skipped; the run passes if all steps do."""
    start = F.array().cast("array<struct<no:int,name:string,status:string>>")

    def step(done: Column, x: Column) -> Column:
        passed = F.transform(F.filter(done, lambda y: y["status"] == "passed"), lambda y: y["name"])
        blocked = F.exists(x["needs"], lambda n: ~F.array_contains(passed, n))
        status = F.when(blocked, "skipped").when(x["ok"], "passed").otherwise("failed")
        return F.concat(done, F.array(F.struct(x["no"].alias("no"), x["name"].alias("name"), status.alias("status"))))

    rows = steps.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("no", "name", "needs", "ok"))).alias("s")).withColumn("d", F.aggregate("s", start, step))
    verdict = F.when(F.exists("d", lambda y: y["status"] == "failed"), "failed").when(F.exists("d", lambda y: y["status"] == "skipped"), "partial").otherwise("passed")
    return rows.select(run, verdict.alias("verdict"), F.inline("d"))


def janitor(planes: Mapping[str, DataFrame | None]) -> DataFrame:
    """(plane, status, expired) of one retention run; a plane without a rule is skipped."""
    out = []
    for name, rows in planes.items():
        spark = next(r for r in planes.values() if r is not None).sparkSession
        out.append(spark.range(1).select(F.lit(name).alias("plane"), F.lit("skipped").alias("status"), F.lit(0).cast("long").alias("expired")) if rows is None else rows.agg(F.count("*").alias("expired")).select(F.lit(name).alias("plane"), F.when(F.col("expired") > 0, "ok").otherwise("noop").alias("status"), "expired"))
    first, *rest = out
    for r in rest:
        first = first.unionByName(r)
    return first


def compared(local: DataFrame, remote: DataFrame, path: str = "path") -> DataFrame:
    """(path, status) of two manifests (path, size, sha): ok, missing, extra, size or sha."""
    a, b = local.select(F.col(path).alias("p"), F.col("size").alias("s1"), F.col("sha").alias("h1")), remote.select(F.col(path).alias("q"), F.col("size").alias("s2"), F.col("sha").alias("h2"))
    both = a.join(b, F.col("p") == F.col("q"), "full")
    status = F.when(F.col("q").isNull(), "missing").when(F.col("p").isNull(), "extra").when(~F.col("s1").eqNullSafe(F.col("s2")), "size").when(~F.col("h1").eqNullSafe(F.col("h2")), "sha").otherwise("ok")
    return both.select(F.coalesce("p", "q").alias(path), status.alias("status"))


def audit_event(rows: DataFrame, action: str, resource_type: str, resource_id: Column, status: Column, as_of: Column) -> DataFrame:
    """Audit rows about ``rows``; ids follow from what they say, so that a repeated
    append can be told."""
    out = rows.select(F.lit(action).alias("action"), F.lit(resource_type).alias("resource_type"), resource_id.cast("string").alias("resource_id"), status.alias("status"), as_of.alias("created_at"))
    return out.select(F.concat(F.lit("audit-"), F.substring(F.sha2(F.concat_ws("|", "action", "resource_type", "resource_id", "status", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")), 256), 1, 12)).alias("event_id"), "*")


def appended(log: DataFrame, new: DataFrame, key: str = "event_id") -> DataFrame:
    """A log with new events; those it holds already aren't added again."""
    return log.unionByName(new.dropDuplicates([key]).join(log.select(key), key, "left_anti"))


def dictionary_problems(lines: DataFrame, required: Sequence[str], name: str = "name", order: str = "no", entry: str = "entry") -> DataFrame:
    """(name, n, n_empty, n_repeated, missing, ok) of character dictionaries; an entry
    of blanks alone is empty, but a single blank is a character."""
    empty = (F.col(entry) == "") | ((F.trim(entry) == "") & (F.length(entry) > 1))
    each = lines.groupBy(name, entry).agg(F.count("*").alias("k"), F.max(empty).alias("e"))
    out = each.groupBy(name).agg(F.sum("k").alias("n"), F.sum(F.when(F.col("e"), F.col("k")).otherwise(0)).alias("n_empty"), F.sum(F.when(~F.col("e"), F.col("k") - 1).otherwise(0)).alias("n_repeated"), F.collect_set(F.when(F.col(entry).isin(*required), F.col(entry))).alias("_has"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, required)), "_has"))
    return out.select(name, "n", "n_empty", "n_repeated", missing.alias("missing"), ((F.col("n_empty") == 0) & (F.col("n_repeated") == 0) & (F.size(missing) == 0)).alias("ok"))


def latest_manifests(manifests: DataFrame, parsed: Column, limit: int, tenant: str | None = None) -> DataFrame:
    """The newest readable manifests of a tenant; the limit is the feature."""
    rows = manifests.filter(parsed)
    rows = rows if tenant is None else rows.filter(F.col("tenant_id") == tenant)
    return rows.orderBy(F.desc("created_at"), "parse_id").limit(max(1, limit))


def looked_up(keys: DataFrame, index: DataFrame, all_: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, found_by): by an index first, then among all rows; keys of neither
    have no value. An index is partitioned by the first two signs of its keys."""
    i = index.select(key, F.col(value).alias("_i")).groupBy(key).agg(F.min("_i").alias("_i"))
    s = all_.groupBy(key).agg(F.min(value).alias("_s"))
    rows = keys.select(key).distinct().join(i, key, "left").join(s, key, "left")
    by = F.when(F.col("_i").isNotNull(), "index").when(F.col("_s").isNotNull(), "scan")
    return rows.select(key, F.coalesce("_i", "_s").alias(value), by.alias("found_by"))


def samples(files: DataFrame, endings: Mapping[str, str], source: str = ".pdf") -> DataFrame:
    """(sample, path, one column for each ending) of a folder's files: each source file
    with the files beside it that have its stem and one of the endings."""
    paths = files.select("path")
    out = paths.filter(F.endswith(F.lower("path"), F.lit(source))).select(F.expr(f"substring(path, 1, length(path) - {len(source)})").alias("sample"), "path")
    for name, ending in endings.items():
        own = paths.filter(F.endswith("path", F.lit(ending))).select(F.expr(f"substring(path, 1, length(path) - {len(ending)})").alias("_s"), F.col("path").alias(name))
        out = out.join(own, F.col("sample") == F.col("_s"), "left").drop("_s")
    return out


def json_list(text: Column, names: Sequence[str]) -> Column:
    """The list in a JSON text: the text itself, or the first field of these names."""
    fields = [F.get_json_object(text, f"$.{n}") for n in names]
    own = F.coalesce(F.when(F.startswith(F.ltrim(text), F.lit("[")), text), *fields)
    return F.coalesce(F.from_json(own, "array<string>"), F.array().cast("array<string>"))


def ranked(items: DataFrame, ranks: DataFrame, name: str, rank: str, default: int) -> DataFrame:
    """A dimension's rows with the rank that a second file gives to their names."""
    r = ranks.select(F.lower(F.trim(name)).alias("_n"), F.col(rank).cast("int").alias("_r")).groupBy("_n").agg(F.min("_r").alias("_r"))
    return items.join(r, F.lower(F.trim(name)) == F.col("_n"), "left").withColumn(rank, F.coalesce("_r", F.lit(default))).drop("_n", "_r")


def schema_of(spark: SparkSession, tables: Mapping[str, str], database: str = "default") -> list[str]:
    """Creates the store's tables where they aren't; (name: columns) to Parquet tables."""
    for name, columns in tables.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    return sorted(tables)


def access_payload(tasks: DataFrame, public: Sequence[str], base: str) -> DataFrame:
    """A task as its owner may see it: public fields, addresses, redacted errors."""
    from foliant.functions import text as t

    return tasks.select(*public, t.redacted(F.coalesce("error", F.lit(""))).alias("error"), F.concat(F.lit(f"{base}/tasks/"), "task_id").alias("status_url"), F.when(F.col("status") == "succeeded", F.concat(F.lit(f"{base}/tasks/"), "task_id", F.lit("/result"))).alias("result_url"))


def degree_name(code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DEGREES.items() for x in kv]), code.cast("string")), F.lit(""))


def degree_code(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in DEGREES.items() for x in (v, k)]), F.upper(F.trim(name))), F.lit(""))


def without_noise(name: Column) -> Column:
    """A name without what stands in brackets, and without signs and blanks."""
    return F.regexp_replace(F.regexp_replace(name, r"[\(（][^()（）]+[)）]", ""), "[,. &（）()]+", "")


def corp_name(name: Column, regions: Sequence[str] = ()) -> Column:
    """A company's name in half width and small letters, without its legal form and,
    if any are given, without the names of regions in it."""
    from foliant.functions import text as t

    out = F.replace(F.lower(t.half_width(F.coalesce(name, F.lit("")))), F.lit("&amp;"), F.lit("&"))
    out = F.regexp_replace(out, r"[\(\)（）\+'\"\t \*\\【】-]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, f"(?i){CORP_TAIL}", ""), f"(?i){CORP_KIND}", "")
    words = F.filter(F.split(out, " "), lambda w: (w != "") & ~w.isin(*regions)) if regions else F.filter(F.split(out, " "), lambda w: w != "")
    return F.when(F.length(out) < 5, out).otherwise(F.array_join(words, " "))


def corp_lookup(names: DataFrame, corps: DataFrame, key: str, name: str) -> DataFrame:
    """(key, corp) of each name: latin names by equality, others by a corporation's
    name that it holds, the longest and then the first. Names under two signs find none."""
    rows = names.select(key, F.col(name).alias("_n")).filter(F.length("_n") >= 2)
    latin = F.rlike("_n", F.lit(r"^[a-z0-9 ,.&-]+$"))
    known = corps.select(F.col("corp")).filter(F.length("corp") >= 2).distinct()
    same = rows.filter(latin).join(known, F.col("_n") == F.col("corp")).select(key, "corp")
    # Held names are looked up by their substrings, so that the join stays one of equal keys.
    n = F.length("_n")
    pieces = rows.filter(~latin).select(key, "_n", F.explode(F.sequence(F.lit(1), n - 1)).alias("i")).select(key, F.explode(F.transform(F.sequence(F.lit(2), n - F.col("i") + 1), lambda k: F.substring(F.col("_n"), F.col("i"), k))).alias("_p"))
    held = pieces.join(known, F.col("_p") == F.col("corp")).groupBy(key).agg(F.min_by("corp", F.struct(-F.length("corp"), "corp")).alias("corp"))
    found = same.unionByName(held)
    return names.select(key).join(found, key, "left")


def resume_columns(json: Column, strings: Sequence[str], flags: Mapping[str, Mapping[str, str]], phone: str = "phone", tel: str = "tel") -> list[Column]:
    """A résumé's JSON as flat columns: strings trimmed, blanks null, flags mapped by
    their signs, and the second number where the first is missing."""
    value = lambda n: F.nullif(F.trim(F.get_json_object(json, f"$.{n}")), F.lit(""))
    out = [value(n).alias(n) for n in strings if n != phone]
    for n, signs in flags.items():
        out.append(F.try_element_at(F.create_map(*[F.lit(x) for kv in signs.items() for x in kv]), F.upper(value(n))).alias(n))
    return [*out, F.coalesce(value(phone), value(tel)).alias(phone)]


def assembled(rows: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Features under the names that a search index takes: ``_tks`` tokens, ``_kwd`` one
    keyword, ``_int`` a number, ``_dt`` a day; columns of no kind are left out, blank
    values are null, telephone numbers keep their digits alone."""
    from foliant.functions import text as t

    own = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    made = {
        "tks": lambda c: F.lower(F.array_join(t.tokens(own(c)), " ")),
        "kwd": own,
        "int": lambda c: F.expr(f"try_cast(`{c}` AS bigint)"),
        "dt": lambda c: F.date_format(F.expr(f"try_to_timestamp(`{c}`)"), "yyyy-MM-dd"),
        "phone": lambda c: F.nullif(F.regexp_replace(own(c), "[^0-9+]", ""), F.lit("")),
    }
    return rows.select(*(made[k](c).alias(f"{c}_{'kwd' if k == 'phone' else k}") for c, k in kinds.items()))
