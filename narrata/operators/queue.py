"""Work items and jobs as tables: states follow from rows, transitions give new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETRIES = 3


def enqueue(known: DataFrame, items: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """The items whose key is not known, one of each key: the first by priority, then by its other columns."""
    order = [F.col("priority"), *(F.col(c) for c in sorted(items.columns) if c not in (key, "priority"))]
    first = items.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return first.join(known.select(key).distinct(), key, "left_anti")


def dequeue(items: DataFrame, n: int) -> DataFrame:
    """The next n pending items: lowest priority number first, then oldest, then by key."""
    return items.where("status = 'pending'").orderBy("priority", "created_at", "dedupe_key").limit(n)


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by order (its later columns break ties)."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def after_fetch(status_code: Column, attempt: Column, retries: int = RETRIES) -> tuple[Column, Column]:
    """Status and attempt of an item after a fetch; attempts are kept, so a permanent failure ends."""
    ok = status_code.between(200, 299)
    status = F.when(ok, "completed").when(attempt + 1 < retries, "pending").otherwise("failed")
    return status, F.when(ok, attempt).otherwise(attempt + 1)


def claim_next(jobs: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The next n new jobs that are due and have attempts left, highest priority first, running now."""
    due = jobs.where((F.col("status") == "NEW") & (F.col("available_utc") <= now) & (F.col("attempt_count") < F.col("max_attempts")))
    first = due.orderBy(F.desc("priority"), "available_utc", "created_utc", "job_id").limit(n)
    return first.withColumns({"status": F.lit("RUNNING"), "attempt_count": F.col("attempt_count") + 1, "locked_utc": now})


def complete(jobs: DataFrame, outcome: str, error: str, now: str, backoff_seconds: int = 60) -> DataFrame:
    """Jobs after an outcome (SUCCEEDED or FAILED): failures wait longer each time, and die when attempts run out."""
    failed, left = F.col(outcome) == "FAILED", F.col("attempt_count") < F.col("max_attempts")
    wait = F.expr(f"timestampadd(SECOND, {backoff_seconds} * attempt_count, {now})")
    return jobs.withColumns(
        {
            "status": F.when(failed & left, "NEW").when(failed, "DEADLETTER").otherwise(F.col(outcome)),
            "available_utc": F.when(failed & left, wait).otherwise(F.col("available_utc")),
            "last_error": F.when(failed, F.col(error)),
        }
    )


def stats(items: DataFrame) -> DataFrame:
    return items.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def known_resources(items: DataFrame, **wanted: str | None) -> DataFrame:
    """The items with the wanted values; a wanted None is no condition."""
    for column, value in wanted.items():
        items = items if value is None else items.where(F.col(column) == value)
    return items


def reset_for_recrawl(items: DataFrame, **wanted: str | None) -> DataFrame:
    """Completed items of the wanted kind are pending again, with no attempt made."""
    hit = F.col("status") == "completed"
    for column, value in wanted.items():
        hit = hit if value is None else hit & (F.col(column) == value)
    return items.withColumns({"attempt": F.when(hit, F.lit(0)).otherwise(F.col("attempt")), "status": F.when(hit, F.lit("pending")).otherwise(F.col("status"))})


def run_metrics(jobs: DataFrame) -> DataFrame:
    """One row: jobs, those that succeeded or died, the success rate of those that ended, mean attempts."""
    return jobs.agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(F.col("status") == "SUCCEEDED").alias("succeeded"),
        F.count_if(F.col("status") == "DEADLETTER").alias("dead"),
        F.round(F.try_divide(F.count_if(F.col("status") == "SUCCEEDED"), F.count_if(F.col("status").isin("SUCCEEDED", "DEADLETTER"))), 6).alias("success_rate"),
        F.round(F.avg("attempt_count"), 6).alias("mean_attempts"),
    )


def new_jobs(requests: DataFrame, now: Column, priority: int = 100, max_attempts: int = 3) -> DataFrame:
    """Job rows of requests (job_id, job_type, payload, and priority where given): new, due now, never tried."""
    given = F.col("priority") if "priority" in requests.columns else F.lit(None).cast("int")
    return requests.select(
        "job_id",
        "job_type",
        "payload",
        F.lit("NEW").alias("status"),
        F.coalesce(given, F.lit(priority)).alias("priority"),
        F.lit(0).alias("attempt_count"),
        F.lit(max_attempts).alias("max_attempts"),
        now.alias("available_utc"),
        now.alias("created_utc"),
    )


def start_runs(claimed: DataFrame, now: Column) -> DataFrame:
    """A run for each claimed job: named by the job and the attempt, running since now."""
    run_id = F.concat_ws(":", F.col("job_id").cast("string"), F.col("attempt_count").cast("string"))
    return claimed.select(run_id.alias("run_id"), "job_id", F.lit("RUNNING").alias("status"), now.alias("started_utc"), F.lit(None).cast("timestamp_ntz").alias("completed_utc"), F.lit(None).cast("string").alias("error"))


def end_runs(runs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The runs after outcomes (run_id, outcome, message): those that ended have their status, time and, if they failed, error.

    A run that has ended stays as it is; of several outcomes of a run the worst counts (FAILED before SUCCEEDED).
    """
    last = outcomes.groupBy("run_id").agg(F.min_by(F.struct("outcome", "message"), F.struct("outcome", "message")).alias("o"))
    ends = (F.col("status") == "RUNNING") & F.col("o").isNotNull()
    return runs.join(last, "run_id", "left").select(
        "run_id",
        "job_id",
        F.when(ends, F.col("o.outcome")).otherwise(F.col("status")).alias("status"),
        "started_utc",
        F.when(ends, now).otherwise(F.col("completed_utc")).alias("completed_utc"),
        F.when(ends & (F.col("o.outcome") == "FAILED"), F.col("o.message")).otherwise(F.col("error")).alias("error"),
    )


def list_jobs(jobs: DataFrame, n: int = 20, status: str | None = None, job_type: str | None = None) -> DataFrame:
    """The n newest jobs of a status and type (None: any)."""
    return known_resources(jobs, status=status, job_type=job_type).orderBy(F.desc("created_utc"), "job_id").limit(n)


def inspect_jobs(jobs: DataFrame, now: Column, stuck_after: str = "INTERVAL 1 HOUR") -> DataFrame:
    """By status: jobs, the oldest one, mean attempts, those without attempts left, and those that run too long."""
    late = (F.col("status") == "RUNNING") & (F.col("available_utc") < now - F.expr(stuck_after))
    return jobs.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("created_utc").alias("oldest"),
        F.round(F.avg("attempt_count"), 6).alias("mean_attempts"),
        F.count_if(F.col("attempt_count") >= F.col("max_attempts")).alias("exhausted"),
        F.count_if(late).alias("stuck"),
    )
