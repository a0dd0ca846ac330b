"""Job events as streams: rate limits, latest states, expiry, progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quire.functions import text as T


def recent_jobs(jobs: DataFrame, k: int = 50) -> DataFrame:
    """The newest k jobs, ties by id, and whether a result is there."""
    return jobs.withColumn("available", F.col("status") == "purchase").orderBy(F.col("created").desc(), F.col("id")).limit(k)


def latest_state(jobs: DataFrame, key: str = "client") -> DataFrame:
    """ST04: the last state of each key."""
    return jobs.groupBy(key).agg(F.max(F.struct("created", "id", "status")).alias("m")).select(key, F.col("m.created").alias("created"), F.col("m.id").alias("id"), F.col("m.status").alias("status"))


def restart(jobs: DataFrame) -> DataFrame:
    """Jobs found running at a restart are errors."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "error").otherwise(F.col("status")))


def expired(jobs: DataFrame, now, hours: float = 168.0, live: tuple[str, ...] = ("queued", "running")) -> DataFrame:
    """ST02: jobs past their time, but for live ones."""
    return jobs.filter(~F.col("status").isin(*live) & (F.col("created") < F.lit(now) - F.expr(f"interval {int(hours * 3600)} seconds")))


def merged_jobs(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local jobs and the remote ones without a local twin."""
    return local.unionByName(remote.join(local.select("id"), "id", "left_anti"))


def progress(lines: DataFrame, key: str = "job", order: str = "ts", line: str = "line") -> DataFrame:
    """ST03/F21: the last stage of each job."""
    rows = lines.withColumn("e", T.progress_event(F.col(line))).filter("e.role is not null")
    return rows.groupBy(key).agg(F.max_by("e", order).alias("e")).select(key, "e.*")


def job_totals(jobs: DataFrame) -> DataFrame:
    """A23."""
    return jobs.groupBy("client").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "purchase").alias("done")).withColumn("low", F.col("done") < 0.9 * F.col("total"))


def stream_rate_limit(requests: DataFrame, client: str, created: str, limit: int = 30, seconds: float = 3600.0) -> DataFrame:
    """ST01: W16 on a stream: (client, us, accepted). The state is the client's accepted times, at most `limit` of them; it goes
    once the watermark has passed them all. `created` must carry a watermark; late rows beyond it are dropped."""
    span = int(seconds * 1e6)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        times = sorted(t for f in frames for t in f["us"].tolist())
        out = []
        for t in times:
            log = [x for x in log if x >= t - span]
            out.append(len(log) < limit)
            if out[-1]:
                log.append(t)
        state.update((log,))
        if log:
            state.setTimeoutTimestamp(max(log[-1] // 1000 + int(seconds * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": [key[0]] * len(times), "us": times, "accepted": out})

    rows = requests.select(F.col(client).alias("client"), F.col(created), F.unix_micros(created).alias("us"))
    kind = dict(rows.dtypes)["client"]
    return rows.groupBy("client").applyInPandasWithState(run, f"client {kind}, us bigint, accepted boolean", "log array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_latest(events: DataFrame, path: str, key: str = "id"):
    """ST04: a stream writer that keeps the latest row of each key under path; versions are folders, so a batch that runs twice writes the same one."""

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        try:
            old = spark.read.parquet(f"{path}/v{epoch - 1}")
        except AnalysisException as e:  # the first batch has none before it; any other fault must not forget the state
            if e.getCondition() != "PATH_NOT_FOUND" or epoch:
                raise
            old = df.limit(0)
        w = Window.partitionBy(key).orderBy(F.col("created").desc(), *[F.col(c).desc() for c in df.columns if c not in (key, "created")])
        old.unionByName(df).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return events.writeStream.outputMode("append").foreachBatch(batch)


def stream_states(events: DataFrame, created: str = "created", state: str = "status", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Jobs by state in windows of event time; rows later than the watermark are dropped."""
    return events.withColumn(created, F.col(created).cast("timestamp")).withWatermark(created, late).groupBy(F.window(created, width).alias("w"), state).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), state, "n")
