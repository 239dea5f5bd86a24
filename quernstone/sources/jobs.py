"""A control table of ingest jobs: (job_id, phase, status, message, at)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import latest_per_key

SCHEMA = "job_id string, phase string, status string, message string, at timestamp"
STATUSES = ("queued", "running", "done", "failed")


def record(spark: SparkSession, path: str, job_id: str, phase: str, status: str, message: str = "") -> None:
    """Adds a state; states are never overwritten."""
    if status not in STATUSES:
        raise ValueError(f"no such status: {status}")
    row = spark.range(1).select(*[F.lit(v).alias(n) for n, v in (("job_id", job_id), ("phase", phase), ("status", status), ("message", message))], F.current_timestamp().alias("at"))
    row.write.mode("append").parquet(path)


def jobs(spark: SparkSession, path: str, status: str | None = None) -> DataFrame:
    """The last state of each job, of one status if asked."""
    last = latest_per_key(spark.read.schema(SCHEMA).parquet(path), ["job_id"], [F.desc("at"), F.desc("phase")])
    return last if status is None else last.where(F.col("status") == status)


def unfinished(spark: SparkSession, path: str, phases: list[str]) -> DataFrame:
    """Jobs with the first phase that isn't done: (job_id, phase)."""
    own = spark.read.schema(SCHEMA).parquet(path)
    done = own.where("status = 'done'").groupBy("job_id").agg(F.collect_set("phase").alias("done"))
    left = F.filter(F.array(*map(F.lit, phases)), lambda p: ~F.array_contains(F.coalesce("done", F.array().cast("array<string>")), p))
    return own.select("job_id").distinct().join(done, "job_id", "left").select("job_id", F.get(left, F.lit(0)).alias("phase")).where("phase is not null")
