"""Job events, as a stream or a batch: stages of jobs, each counted once, their state, expiry, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stages_once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """The first event of each job and stage; later ones within the time allowed are the same stage run again."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["job", "stage"])


def unfinished(tasks: DataFrame, outputs: DataFrame) -> DataFrame:
    """tasks (job, stage, ...) whose output isn't there yet (outputs: job, stage): the others are skipped. tasks may be a stream."""
    return tasks.join(outputs.select("job", "stage").distinct(), ["job", "stage"], "left_anti")


def stage_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "stage").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "stage", "n")


def job_state(events: DataFrame, failed: tuple[str, ...] = ("failed",), completed: tuple[str, ...] = ("completed",), queued: tuple[str, ...] = ("queued",)) -> DataFrame:
    """job, last_stage, n_stages, last_ts, status: by the job's last event, failed, completed or queued if it is one of those names, else
    processing. Works on a batch, and on a stream in complete or update mode. A job's distinct stage names are held together."""
    last = F.max_by("stage", F.struct("ts", "event_id"))
    state = events.groupBy("job").agg(last.alias("last_stage"), F.size(F.collect_set("stage")).cast("long").alias("n_stages"), F.max("ts").alias("last_ts"))
    status = F.when(F.col("last_stage").isin(*failed), "failed").when(F.col("last_stage").isin(*completed), "completed").when(F.col("last_stage").isin(*queued), "queued")
    return state.withColumn("status", status.otherwise("processing"))


def live(state: DataFrame, now: Column, job_seconds: int = 7200, result_seconds: int = 3600) -> DataFrame:
    """Jobs whose record hasn't expired at `now`, with has_result: completed, and its result not expired either."""
    age = F.unix_timestamp(now) - F.unix_timestamp("last_ts")
    return state.where(age < job_seconds).withColumn("has_result", (F.col("status") == "completed") & (age < result_seconds))


#: Queues by kind of task; parsing goes by its parser.
QUEUES = {"extract_text": "default", "extract_references": "llm-tasks", "parse_references/llm": "llm-tasks", "parse_references": "default", "link": "linking"}


def queued(tasks: DataFrame, queues: dict[str, str] | None = None) -> DataFrame:
    """tasks (kind, parser) with their queue: that of 'kind/parser', else of the kind; null without one. As a stream, each queue is a
    query of its own."""
    known = F.create_map(*(F.lit(x) for pair in (queues or QUEUES).items() for x in pair))
    return tasks.withColumn("queue", F.coalesce(F.element_at(known, F.concat_ws("/", "kind", "parser")), F.element_at(known, F.col("kind"))))


def ready(tasks: DataFrame, state: DataFrame) -> DataFrame:
    """tasks (job, depends_on) that depend on nothing, or on a completed job."""
    done = state.where("status = 'completed'").select(F.col("job").alias("__done"))
    return tasks.join(done, F.col("depends_on") == F.col("__done"), "left").where(F.col("depends_on").isNull() | F.col("__done").isNotNull()).drop("__done")


def reconciled(jobs: DataFrame, registry: DataFrame) -> DataFrame:
    """jobs (job, status, ...) with the status of the registry of failed and finished jobs (job, status, error), where it has one."""
    other = registry.select("job", F.col("status").alias("__status"), F.col("error").alias("error"))
    return jobs.join(other, "job", "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")
