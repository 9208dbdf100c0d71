"""Job ledger: registration, details, closing, failures and health.

ledger (job_id, job_type, description, job_start, job_end, period_from, period_to).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import next_run
from tabloom.operators.ordered import position
from tabloom.operators.relational import union_rows

IDENTITY = ["job_type", "description", "period_from", "period_to"]


def job_register(ledger: DataFrame, requests: DataFrame, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """Ledger plus a start row for every request it does not hold yet, with the next ids.

    Null parts of the identity are equal. Of requests with one identity the
    smallest row counts, by the other columns in their order.
    """
    top = ledger.agg(F.max("job_id")).first()[0] or 0
    rest = [c for c in requests.columns if c not in identity]
    once = requests.groupBy(*identity).agg(F.min(F.struct(F.lit(0).alias("__one"), *rest)).alias("__row"))
    once = once.select(*identity, *[f"__row.{c}" for c in rest])
    held = ledger.select(*[F.col(c).alias(f"__{c}") for c in identity])
    same = [once[c].eqNullSafe(held[f"__{c}"]) for c in identity]
    fresh = once.join(held, same, "left_anti").select(*requests.columns)
    rows = position(fresh, [], list(identity), "__rn")
    rows = rows.withColumn("job_id", F.col("__rn") + F.lit(top)).drop("__rn")
    return union_rows(ledger, rows, allow_missing=True)


def job_detail_append(details: DataFrame, jobs: DataFrame, info: Column) -> DataFrame:
    return union_rows(details, jobs.select("job_id", info.alias("info")))


def job_close(ledger: DataFrame, done: DataFrame) -> DataFrame:
    """Stamp the end of finished jobs (done: job_id, ended)."""
    rows = ledger.join(done.select("job_id", "ended"), "job_id", "left")
    return rows.withColumn("job_end", F.coalesce("ended", "job_end")).select(*ledger.columns)


def job_failures(ledger: DataFrame, details: DataFrame, as_of: Column, days: int = 1) -> DataFrame:
    """Details of jobs started lately that never ended."""
    open_jobs = ledger.where(F.col("job_end").isNull() & (F.col("job_start") >= F.date_sub(as_of, days)))
    return open_jobs.select("job_id", "job_type", "job_start").join(details, "job_id")


def job_health(monitor: DataFrame, as_of: Column) -> DataFrame:
    """Error, missed and unfinished flags (unless ignored) with their message.

    monitor (job_type, file_type, frequency, last_job, last_start, last_end,
    has_error, grace_days, ignore_error, ignore_missed, ignore_open).
    """
    due = next_run(F.to_date("last_start"), F.col("frequency"))
    c = F.col
    error = c("has_error") & ~c("ignore_error")
    missed = F.coalesce(due < as_of, F.lit(False)) & ~c("ignore_missed")
    late = F.datediff(as_of, "last_start") > c("grace_days")
    unfinished = c("last_end").isNull() & late & ~c("ignore_open")
    name = F.concat_ws("-", "job_type", "file_type")
    text = F.concat_ws(
        "\n",
        F.when(error, F.concat(name, F.lit(": error in job "), c("last_job").cast("string"))),
        F.when(missed, F.concat(name, F.lit(": did not run, expected "), due.cast("string"))),
        F.when(unfinished, F.concat(name, F.lit(": not completed within "), c("grace_days").cast("string"), F.lit(" days"))),
    )
    one = lambda rule: F.when(rule, 1).otherwise(0)
    return monitor.select(
        "last_job", "job_type", "file_type", due.alias("next_start"), one(error).alias("report_error"),
        one(missed).alias("report_missed"), one(unfinished).alias("report_open"), text.alias("message"),
    )
