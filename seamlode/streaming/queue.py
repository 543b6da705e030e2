"""Queues as folders of JSON files, stages chained by them, and the state of downloads, as Structured Streaming.

A queue's source is the folder, its cursor the checkpoint: a job is taken once, and a lost run takes it
again. Outputs are keyed, so that taking a job twice writes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seamlode.sources.sinks import Table

JOB = "job_id string, path string, stage string, enforce boolean, enqueued_at timestamp"


def enqueue(jobs: DataFrame, folder: str) -> None:
    """Add jobs to a queue."""
    jobs.select("job_id", "path", "stage", "enforce", "enqueued_at").write.mode("append").json(folder)


def reindex(paths: DataFrame, folder: str, stage: str, at) -> None:
    """A job for every path(path)."""
    enqueue(paths.select(F.sha2(F.concat_ws("|", "path", F.lit(stage)), 256).alias("job_id"), "path", F.lit(stage).alias("stage"), F.lit(True).alias("enforce"), F.lit(at).cast("timestamp").alias("enqueued_at")), folder)


def jobs(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """The stream of a queue's jobs."""
    return spark.readStream.schema(JOB).option("maxFilesPerTrigger", files).json(folder)


def run_stage(spark: SparkSession, queue: str, checkpoint: str, outputs: Table, failures: Table, work: Callable[[DataFrame], DataFrame], next_queue: str | None = None, next_stage: str = "") -> None:
    """Take what is in a queue: work(jobs) gives (path, body, error) of jobs that have no output yet, or are enforced.

    Bodies become outputs(path, body), errors failures(path, stage, error), and each job done one for the next queue.
    """

    def batch(rows: DataFrame, _: int) -> None:
        once = rows.groupBy("path").agg(F.max("enforce").alias("enforce"), F.min("enqueued_at").alias("enqueued_at"), F.min("stage").alias("stage"))
        there = outputs.read().select("path").withColumn("there", F.lit(True))
        todo = once.join(there, "path", "left").where(F.col("enforce") | F.col("there").isNull()).drop("there").persist()
        done = work(todo).persist()
        outputs.put(done.where("error is null").select("path", "body"))
        failures.put(done.where("error is not null").join(todo.select("path", "stage"), "path").select("path", "stage", "error"))
        if next_queue is not None:
            good = done.where("error is null").select("path").join(todo.select("path", "enforce", "enqueued_at"), "path")
            enqueue(good.select(F.sha2(F.concat_ws("|", "path", F.lit(next_stage)), 256).alias("job_id"), "path", F.lit(next_stage).alias("stage"), "enforce", "enqueued_at"), next_queue)
        done.unpersist()
        todo.unpersist()

    query = jobs(spark, queue).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


# Status -> rank; a file's status is that of least rank among its stages.
STATUS = {"failed": 0, "processing": 1, "queued": 2, "pending": 3, "done": 4}


def statuses(files: DataFrame, outputs: dict[str, DataFrame], failures: DataFrame, queued: DataFrame, locked: DataFrame) -> DataFrame:
    """(path, stage, status) of files(path) at each stage: failed, done, queued, processing or pending, in that order."""
    out = None
    for stage, done in outputs.items():
        mark = lambda df, name: df.select("path").distinct().withColumn(name, F.lit(True))
        rows = files.select("path").join(mark(failures.where(F.col("stage") == stage), "f"), "path", "left").join(mark(done, "d"), "path", "left")
        rows = rows.join(mark(queued.where(F.col("stage") == stage), "q"), "path", "left").join(mark(locked, "l"), "path", "left")
        status = F.when(F.col("f"), "failed").when(F.col("d"), "done").when(F.col("q"), "queued").when(F.col("l"), "processing").otherwise("pending")
        part = rows.select("path", F.lit(stage).alias("stage"), status.alias("status"))
        out = part if out is None else out.unionByName(part)
    return out


def stage_share(files: DataFrame, outputs: dict[str, DataFrame]) -> DataFrame:
    """One row: files, those done at each stage, and the share done at the last."""
    n = {s: F.count(F.when(F.col(f"_{i}"), 1)).alias(f"{s}_done") for i, s in enumerate(outputs)}
    rows = files.select("path").distinct()
    for i, done in enumerate(outputs.values()):
        rows = rows.join(done.select("path").distinct().withColumn(f"_{i}", F.lit(True)), "path", "left")
    last = f"_{len(outputs) - 1}"
    return rows.agg(F.count("*").alias("total"), *n.values(), F.coalesce(F.try_divide(F.count(F.when(F.col(last), 1)), F.count("*")), F.lit(0.0)).alias("coverage"))


# -- downloads ----------------------------------------------------------------------------

PAPER = "search_id string, paper_id string, event string, job_id string, at timestamp"
_TERMINAL = ("done", "failed", "skipped")


def step(status: str | None, event: str, job_id: str | None) -> str:
    """Next status of a paper: created with a job it is downloading, without one skipped; reports end a download; what has ended stays."""
    if status in _TERMINAL:
        return status
    if event == "created":
        return "downloading" if job_id else "skipped"
    return event if event in ("done", "failed") and status == "downloading" else status or "pending"


def paper_states(events: DataFrame, timeout: int = 180) -> DataFrame:
    """(search_id, paper_id, status) whenever a paper's status changes, of a stream of events(search_id, paper_id, event, job_id, at).

    A download that has not ended ``timeout`` seconds of event time after it began has failed.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        status = "failed" if state.hasTimedOut else before
        for b in batches:
            for r in b.sort_values("at").itertuples():
                status = step(status, r.event, r.job_id)
                if status == "downloading" and before != "downloading":
                    state.update((status,))
                    state.setTimeoutTimestamp(int(r.at.timestamp() * 1000) + timeout * 1000)
        state.update((status,))
        if status != before:
            yield pd.DataFrame([(*key, status)], columns=["search_id", "paper_id", "status"])

    marked = events.withWatermark("at", "0 seconds").groupBy("search_id", "paper_id")
    return marked.applyInPandasWithState(run, "search_id string, paper_id string, status string", "status string", "update", GroupStateTimeout.EventTimeTimeout)


def reconciled(papers: DataFrame, reports: DataFrame, now, timeout: int = 180) -> DataFrame:
    """The same over tables: papers(search_id, paper_id, status, job_id, created_at) with the reports(job_id, report), at a time."""
    rows = papers.join(reports, "job_id", "left")
    ended = F.when(F.col("report").isin("done", "failed"), F.col("report"))
    late = F.lit(now).cast("timestamp") > F.col("created_at") + F.make_dt_interval(secs=F.lit(float(timeout)))
    status = F.when(F.col("status") == "pending", "skipped").when(F.col("status") == "downloading", F.coalesce(ended, F.when(late, "failed"), F.lit("downloading"))).otherwise(F.col("status"))
    return rows.withColumn("status", status).select(*papers.columns)


def turns_done(papers: DataFrame) -> DataFrame:
    """(search_id, done): whether all papers of a search have ended."""
    return papers.groupBy("search_id").agg(F.bool_and(F.col("status").isin(*_TERMINAL)).alias("done"))


def claimed(searches: DataFrame, wanted: DataFrame, worker: str) -> DataFrame:
    """searches(search_id, status, worker) with those of wanted that are pending taken by the worker; a second claim takes none."""
    mine = wanted.select("search_id").distinct().withColumn("mine", F.lit(True))
    rows = searches.join(mine, "search_id", "left")
    take = F.coalesce("mine", F.lit(False)) & (F.col("status") == "pending")
    return rows.select("search_id", F.when(take, "running").otherwise(F.col("status")).alias("status"), F.when(take, worker).otherwise(F.col("worker")).alias("worker"))


def rate_limited(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """requests(key, id, at) with ``allowed``: at most ``limit`` in a window that a key's first request opens and that lasts ``seconds``."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "id"])
        opened, n, allowed = None, 0, []
        for at in pdf["at"]:
            if opened is None or (at - opened).total_seconds() >= seconds:
                opened, n = at, 0
            n += 1
            allowed.append(n <= limit)
        return pdf.assign(allowed=allowed)

    return requests.select("key", "id", "at").groupBy("key").applyInPandas(one, "key string, id long, at timestamp, allowed boolean")


def retries(attempt: int, base: float = 0.5, most: int = 3) -> float | None:
    """Seconds to wait before an attempt, growing with it; None once there have been ``most``."""
    return base * attempt if attempt < most else None
