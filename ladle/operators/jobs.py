"""Job queues, retries, limits and circuits over tables: batch forms of the stateful logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladle.functions import text as t
from ladle.operators import folds

# Limits and times.
MAX_RETRIES, BACKOFF_MS, CONCURRENT_JOBS = 3, 5_000, 3
RATE_WINDOW_MS, RATE_LIMIT = 60_000, 10
CIRCUIT_FAILURES, CIRCUIT_MS = 3, 60_000
ERROR_CHARS, STACK_CHARS = 2_000, 8_000


def new_jobs(scans: DataFrame, at: Column | None = None) -> DataFrame:
    """A queued job for each scan."""
    now = F.current_timestamp() if at is None else at
    return scans.select(F.uuid().alias("_id"), F.col("_id").alias("scan_id"), F.lit("queued").alias("status"), "items_count", F.lit(0).alias("retries"), F.lit(MAX_RETRIES).alias("max_retries"), F.lit(None).cast("timestamp").alias("retry_at"), now.alias("created_at"))


def eligible(jobs: DataFrame, now: Column) -> DataFrame:
    """Queued jobs whose retry time has come."""
    return jobs.filter((F.col("status") == "queued") & (F.col("retry_at").isNull() | (F.col("retry_at") <= now)))


def pick(jobs: DataFrame, now: Column, n: int = CONCURRENT_JOBS, scan_limit: int | None = None) -> DataFrame:
    """The oldest eligible jobs; with scan_limit, only among the first jobs inserted."""
    seen = jobs.orderBy("_pos").limit(scan_limit) if scan_limit else jobs
    return eligible(seen, now).orderBy("created_at", "_pos").limit(n)


def requeue_stale(jobs: DataFrame) -> DataFrame:
    """At start: jobs left in processing are queued again."""
    return jobs.withColumn("status", F.when(F.col("status") == "processing", "queued").otherwise(F.col("status")))


def retry_at(failed_at: Column, retries: Column, base_ms: int = BACKOFF_MS) -> Column:
    """base * 2^retries after the failure; null where no retry is left."""
    wait = F.make_dt_interval(secs=(F.pow(F.lit(2.0), retries.cast("double")) * base_ms / 1000).cast("decimal(18,6)"))
    return F.when(retries < MAX_RETRIES, failed_at + wait)


def fail(jobs: DataFrame, failed_at: Column, error: Column, stack: Column) -> tuple[DataFrame, DataFrame]:
    """Jobs after a failure, and the dead letters: jobs are queued again with a growing wait, or fail for good."""
    again = F.col("retries") < F.col("max_retries")
    jobs = jobs.withColumns({"_again": again, "_error": error, "_stack": stack, "retry_at": F.when(again, retry_at(failed_at, F.col("retries")))})
    dead = jobs.filter("NOT _again").select("scan_id", F.col("_id").alias("job_id"), F.lit("dlq").alias("status"), F.substring("_error", 1, ERROR_CHARS).alias("error"), F.substring("_stack", 1, STACK_CHARS).alias("error_stack"), "retries", "max_retries", F.col("created_at").alias("job_created_at"), failed_at.alias("created_at"))
    after = jobs.withColumns({"status": F.when(F.col("_again"), "queued").otherwise("failed"), "error": F.col("_error"), "last_attempt_at": failed_at, "retries": F.col("retries") + F.when(F.col("_again"), 1).otherwise(0)})
    return after.drop("_again", "_error", "_stack"), dead


def complete(jobs: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    done = ids.select(F.col("_id").alias("_done")).distinct()
    joined = jobs.join(done, F.col("_id") == F.col("_done"), "left")
    hit = F.col("_done").isNotNull()
    return joined.withColumns({"status": F.when(hit, "completed").otherwise(F.col("status")), "completed_at": F.when(hit, at).otherwise(F.col("completed_at"))}).drop("_done")


def admin_retry(jobs: DataFrame, job_id: str) -> DataFrame:
    """A failed or dead job is queued from the start."""
    hit = (F.coalesce(F.col("id"), F.col("_id")) == job_id) & F.col("status").isin("failed", "dlq") if "id" in jobs.columns else (F.col("_id") == job_id) & F.col("status").isin("failed", "dlq")
    return jobs.withColumns({"status": F.when(hit, "queued").otherwise(F.col("status")), "retries": F.when(hit, 0).otherwise(F.col("retries")), "retry_at": F.when(hit, None).otherwise(F.col("retry_at"))})


def process_next(jobs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The jobs with the oldest eligible one in processing, and that one."""
    job = pick(jobs, now, 1)
    at = job.select(F.col("_id").alias("_next"))
    marked = jobs.join(F.broadcast(at), F.col("_id") == F.col("_next"), "left")  # one row
    return marked.withColumn("status", F.when(F.col("_next").isNotNull(), "processing").otherwise(F.col("status"))).drop("_next"), job


def reset_failed(jobs: DataFrame) -> DataFrame:
    """Failed jobs are queued from the start, without their errors."""
    hit = F.col("status") == "failed"
    return jobs.withColumns({"retries": F.when(hit, 0).otherwise(F.col("retries")), "error": F.when(hit, "").otherwise(F.col("error")), "status": F.when(hit, "queued").otherwise(F.col("status"))})


def clear_finished(jobs: DataFrame) -> DataFrame:
    """Without completed and failed jobs."""
    return jobs.filter(~F.coalesce(F.col("status").isin("completed", "failed"), F.lit(False)))


def clear_failed(jobs: DataFrame) -> DataFrame:
    return jobs.filter(~F.col("status").isin("failed", "dlq"))


def dish_errors(results: DataFrame, job: str = "job_id") -> DataFrame:
    """map of dish to error for each job with failed dishes."""
    return results.filter(F.col("error").isNotNull()).groupBy(job, "dish").agg(F.first("error").alias("error")).groupBy(job).agg(F.map_from_entries(F.collect_list(F.struct("dish", "error"))).alias("dish_errors"))


def client_ip(forwarded: Column, real: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.get(F.split(forwarded, ","), F.lit(0))), F.lit("")), F.nullif(F.trim(real), F.lit("")), F.lit("unknown"))


def _ms(ts: str) -> Column:
    return (F.unix_micros(F.col(ts).cast("timestamp")) / 1000).alias("ms")


def _timed(rows: DataFrame, key: str, ts: str, *columns: Column | str) -> DataFrame:
    """key, columns and ms of the rows that have a key and a time."""
    return rows.select(key, *columns, _ms(ts)).filter(F.col(key).isNotNull() & F.col("ms").isNotNull())


def rate_limit(requests: DataFrame, key: str, ts: str, order: str, window_ms: float = RATE_WINDOW_MS, most: int = RATE_LIMIT) -> DataFrame:
    """key, order, allowed of each request (of a null key or time: none). Windows begin with a request, so requests are taken in order."""
    rows = folds.dealt_in_order(_timed(requests, key, ts, order), key, ["ms", order])
    return folds.fold(rows, key, [order], folds.Windows(window_ms)).select(key, order, (F.col("place") < most).alias("allowed"))


def circuit_breaker(calls: DataFrame, key: str, ts: str, order: str, ok: str, limit: int = CIRCUIT_FAILURES, open_ms: float = CIRCUIT_MS) -> DataFrame:
    """key, order, met of each call: what state the call met."""
    rows = folds.dealt_in_order(_timed(calls, key, ts, order, F.coalesce(F.col(ok), F.lit(False)).alias("ok")), key, ["ms", order])
    return folds.fold(rows, key, [order], folds.Circuit(limit, open_ms))


def first_success(calls: DataFrame, request: str, priority: str, ok: str) -> DataFrame:
    """The provider of the highest priority that answered each request."""
    return calls.filter(F.col(ok)).groupBy(request).agg(F.min(priority).alias(priority))


# What a limit, and a model that does not exist, answer.
LIMITED, MISSING = r"(?i)\b429\b|rate limit|quota", "404"


def provider_chain(calls: DataFrame, process: str, request: str, priority: str, model: str, access: str, ts: str, error: str, limit: int = CIRCUIT_FAILURES, open_ms: float = CIRCUIT_MS) -> DataFrame:
    """process, request, priority, model, outcome of each call: what becomes of it if providers are tried by priority until one answers.

    calls: a row for each provider that a request could use, with what it would answer (null error: an answer). Outcomes: answered,
    failed, open (the model's circuit), limited (a provider with the same access key met a limit in this request), missing (the
    model did not exist in this request), unused (the request has its answer). Circuits are a process's own.
    """
    e = F.col(error)
    columns = [F.col(request).alias("request"), F.col(priority).alias("priority"), F.col(model).alias("model"), F.col(access).alias("access"), e.isNull().alias("ok")]
    says = lambda test: F.coalesce(test, F.lit(False))
    columns += [says(t.is_transient(e)).alias("passing"), says(e.rlike(LIMITED)).alias("limited"), says(F.contains(e, F.lit(MISSING))).alias("missing")]
    rows = folds.dealt_in_order(_timed(calls.withColumnRenamed(process, "process"), "process", ts, *columns), "process", ["ms", "request"], ["priority"])
    out = folds.fold(rows, "process", ["request", "priority", "model"], folds.Chain(limit, open_ms))
    return out.select(F.col("process").alias(process), F.col("request").alias(request), F.col("priority").alias(priority), F.col("model").alias(model), "outcome")


def chain_answers(chain: DataFrame, request: str, priority: str, model: str) -> DataFrame:
    """request, model (that answered; null: all failed) and calls (made) of each request of provider_chain()."""
    made = F.col("outcome").isin("answered", "failed")
    return chain.groupBy(request).agg(F.max(F.when(F.col("outcome") == "answered", F.col(model))).alias(model), F.count_if(made).alias("calls"))


def attempts_delay(attempt: Column, base_ms: int = 500) -> Column:
    """Wait before a repeated request, in ms."""
    return (F.pow(F.lit(2.0), attempt.cast("double")) * base_ms).cast("long")


def debounce(events: DataFrame, key: str, ts: str, value: str, gap: str) -> DataFrame:
    """The last value of each burst of events that are less than `gap` apart."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.max_by(value, ts).alias(value), F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), value, "n")


def cached_hits(lookups: DataFrame, key: str, ts: str, order: str, ttl_s: int) -> DataFrame:
    """key, order, hit: whether the value that an earlier lookup of the key stored is still alive (each miss stores one)."""
    rows = folds.dealt_in_order(_timed(lookups, key, ts, order), key, ["ms", order])
    return folds.fold(rows, key, [order], folds.Windows(ttl_s * 1000, strict=False)).select(key, order, (F.col("place") > 0).alias("hit"))


# Lives of what was found and of what was not, and the number of entries.
FOUND_S, NOT_FOUND_S, CACHE_KEYS = 7 * 86_400, 600, 500


def bounded_cache(lookups: DataFrame, shard: str, key: str, ts: str, order: str, ttl_s: int = 300, most: int = 100, found: str | None = None, miss_ttl_s: int | None = None) -> DataFrame:
    """shard, order, hit of each lookup in caches (one a shard) of at most `most` keys: the key stored first goes first.

    found: what the lookup would find if it were made; its absence lives miss_ttl_s (ttl_s if none is given). A lookup of a
    stored key whose time has ended removes it and stores it anew; a full cache makes room before a key is stored.
    """
    known = F.lit(True) if found is None else F.coalesce(F.col(found), F.lit(False))
    rows = _timed(lookups.withColumn("_key", F.col(key).cast("string")), shard, ts, order, F.col("_key").alias("key"), known.alias("found"))
    lives = (ttl_s if miss_ttl_s is None else miss_ttl_s) * 1000, ttl_s * 1000
    return folds.fold(folds.dealt_in_order(rows, shard, ["ms", order]), shard, [order], folds.Cache(lives, most))


# Progress of a scan's steps.
PROGRESS = (5, 10, 20, 35, 50, 60, 65, 70, 100)


def progress_events(steps: DataFrame, job: str, step: str) -> DataFrame:
    """status events with their progress, a complete event for the last step, an error event for a failed one."""
    pct = F.element_at(F.array(*map(F.lit, PROGRESS)), F.least(F.col(step) + 1, F.lit(len(PROGRESS))))
    kind = F.when(F.col("error").isNotNull(), "error").when(pct == 100, "complete").otherwise("status")
    return steps.select(job, step, kind.alias("event"), pct.alias("progress"))


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; one row a key and task is shuffled."""
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("_last"))
    return last.select(*(F.col(c) if c == key else F.col(f"_last.{c}").alias(c) for c in df.columns))
