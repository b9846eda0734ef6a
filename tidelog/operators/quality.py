"""Quality of the collection from its log tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage_status(failed: Column | None = None) -> Column:
    """corrupted, partial or succeeded of a run; failed where the failure path says so."""
    base = F.when(F.col("corrupted"), "corrupted").when(F.col("truncated") | F.coalesce(F.col("reason").isin("time_budget", "frontier_missing"), F.lit(False)), "partial").otherwise("succeeded")
    return base if failed is None else F.when(failed, "failed").otherwise(base)


def failure_window(runs: DataFrame, since: Column, now: Column) -> DataFrame:
    """One row over runs finished in the window, closed at both ends."""
    w = runs.where(F.col("finished_at").between(since, now))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return w.agg(F.count("*").alias("runs"), total("pages_requested"), total("pages_succeeded"), total("request_errors"), total("parse_errors"))


def coverage_by_kind(runs: DataFrame) -> DataFrame:
    return runs.groupBy("task_kind", "status").agg(F.count("*").alias("runs"), F.sum("pages_requested").alias("pages_requested"), F.sum("pages_succeeded").alias("pages_succeeded"), F.count_if("truncated").alias("truncated"))


def queue_depth(tasks: DataFrame, now: Column) -> DataFrame:
    """Tasks by status and kind, with the age of the oldest in days."""
    return tasks.groupBy("status", "kind").agg(F.count("*").alias("tasks"), F.greatest(F.datediff(now, F.min("created_at")), F.lit(0)).alias("oldest_days"))


#: Keys of alerts of scheduled jobs begin like this.
JOB_ALERT = "scheduled_job_failure:"


def alert_drafts(totals: DataFrame, jobs: DataFrame, min_pages: int = 20, rate: float = 0.25, backlog: int = 1000, age: int = 900, failures: int = 3) -> DataFrame:
    """alert_key, severity and triggered of the failure rate, the backlog, the workers' heartbeat and each enabled job.

    totals: one row of pages, errors, pending, oldest_seconds and fresh_workers; jobs: job_key, enabled and
    consecutive_failures. Jobs that are gone get no draft: alert_transitions() resolves their alerts.
    """
    c = F.col
    failing = (c("pages") >= min_pages) & (F.try_divide(c("errors").cast("double"), c("pages").cast("double")) >= rate)
    behind = (c("pending") >= backlog) | (c("oldest_seconds") >= age)
    drafts = {"request_failure_rate": ("critical", failing), "task_backlog": ("warning", behind), "worker_heartbeat": ("critical", F.coalesce(c("fresh_workers"), F.lit(0)) == 0)}
    each = F.array(*(F.struct(F.lit(key).alias("alert_key"), F.lit(severity).alias("severity"), F.coalesce(on, F.lit(False)).alias("triggered")) for key, (severity, on) in drafts.items()))
    of_jobs = jobs.where("enabled").select(F.concat(F.lit(JOB_ALERT), "job_key").alias("alert_key"), F.lit("critical").alias("severity"), (c("consecutive_failures") >= failures).alias("triggered"))
    return totals.select(F.explode(each).alias("d")).select("d.*").unionByName(of_jobs)


def alert_transitions(state: DataFrame, drafts: DataFrame, now: Column, repeat_seconds: int = 3600) -> DataFrame:
    """triggered, repeated, resolved or none of each alert, with the next state.

    state: alert_key, active, occurrences, notified_at (epoch seconds; null: never told, so a repeat is due).
    Of keys without a draft, jobs' alerts are resolved and others stay as they are. A draft that isn't
    triggered makes no state.
    """
    j = state.withColumn("_known", F.lit(True)).join(drafts.select("alert_key", "triggered"), "alert_key", "full_outer")
    was = F.coalesce("active", F.lit(False))
    on = F.coalesce("triggered", was & ~F.col("alert_key").startswith(JOB_ALERT))
    told = F.col("triggered").isNotNull()
    j = j.where(F.col("_known") | on)
    due = F.coalesce(now - F.col("notified_at") >= repeat_seconds, F.lit(True))
    action = F.when(told & on & ~was, "triggered").when(told & on & was & due, "repeated").when(~on & was, "resolved").otherwise("none")
    on_now = told & on
    return j.select("alert_key", action.alias("action"), on.alias("active"), (F.coalesce("occurrences", F.lit(0)) + F.when(on_now, 1).otherwise(0)).alias("occurrences"), F.when(action.isin("triggered", "repeated"), now).otherwise(F.col("notified_at")).alias("notified_at"))


def failure_streaks(log: DataFrame, key: str, base_seconds: int = 300, most_seconds: int = 3600) -> DataFrame:
    """Failures since the last success of each key, and the wait that they ask for. log: key, at, id, failed, retry_after."""
    w = Window.partitionBy(key).orderBy("at", "id")
    g = log.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = g.groupBy(key, "island").agg(F.count_if("failed").alias("streak"), F.max_by("retry_after", F.struct("at", "id")).alias("retry_after")).groupBy(key).agg(F.max_by(F.struct("streak", "retry_after"), "island").alias("s")).select(key, "s.*")
    base = F.coalesce("retry_after", F.lit(base_seconds))
    return last.withColumn("backoff_seconds", F.when(F.col("streak") > 0, F.least(base * F.pow(F.lit(2), F.least(F.col("streak") - 1, F.lit(5))), F.lit(most_seconds)).cast("long")).otherwise(0)).drop("retry_after")


def failed_attempts(attempts: DataFrame, since: Column) -> DataFrame:
    """Failed or abandoned attempts with their duration in ms."""
    ms = F.greatest(F.round((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000), F.lit(0)).cast("long")
    return attempts.where((F.col("started_at") >= since) & F.col("outcome").isin("failed", "abandoned")).withColumn("duration_ms", ms).orderBy(F.desc("started_at"))


def raw_integrity(payloads: DataFrame, body: str, recorded_hash: Column, recorded_size: Column) -> DataFrame:
    """Payloads by outcome: ok, hash_mismatch, size_mismatch or missing."""
    outcome = F.when(F.col(body).isNull(), "missing").when(F.octet_length(body) != recorded_size, "size_mismatch").when(F.sha2(body, 256) != recorded_hash, "hash_mismatch").otherwise("ok")
    return payloads.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("payloads"), F.sum(F.octet_length(body)).alias("bytes"))


def page_chain_audit(pages: DataFrame) -> DataFrame:
    """For each crawl: pages, repeated cursors, broken successions, whether an anchor was reached, missing mark.

    pages: crawl, page_number, cursor, next_offset, rpids, anchors (at most five are looked at), is_end.
    """
    w = Window.partitionBy("crawl").orderBy("page_number")
    p = pages.withColumn("expected", F.lag("next_offset").over(w)).withColumn("again", F.row_number().over(Window.partitionBy("crawl", "cursor").orderBy("page_number")) > 1)
    hit = F.arrays_overlap("rpids", F.slice(F.array_distinct("anchors"), 1, 5))
    g = p.groupBy("crawl").agg(F.count("*").alias("pages"), F.count_if(F.col("again") & F.col("cursor").isNotNull()).alias("loops"), F.count_if(F.col("expected").isNotNull() & ~F.col("expected").eqNullSafe(F.col("cursor"))).alias("broken"), F.coalesce(F.bool_or(hit), F.lit(False)).alias("anchor_reached"), F.coalesce(F.bool_or("is_end"), F.lit(False)).alias("ended"))
    return g.withColumn("missing", F.col("ended") & ~F.col("anchor_reached"))


def run_summary(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("run_id").agg(F.count("*").alias("started"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"))
