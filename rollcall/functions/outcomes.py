"""Task states, progress, error classes and retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States grouped by what they mean to the caller.
PENDING_STATES = ["PENDING", "RECEIVED", "STARTED", "RETRY"]
DONE_STATES = ["SUCCESS"]
FAILED_STATES = ["FAILURE", "REVOKED"]

# Answers of the extraction service worth another attempt.
RETRYABLE_STATUSES = ["RESOURCE_EXHAUSTED", "UNAVAILABLE", "DEADLINE_EXCEEDED", "INTERNAL"]
RETRYABLE_CODES = [429, 500, 502, 503, 504]

MAX_RETRIES = 5
MAX_DELAY_SECONDS = 600
BATCH_ATTEMPTS = 6


def task_status(state: Column) -> Column:
    """`done`, `failed` or `pending`; an unknown state has lost nothing yet."""
    return (
        F.when(state.isin(DONE_STATES), "done")
        .when(state.isin(FAILED_STATES), "failed")
        .otherwise("pending")
    )


def is_terminal(state: Column) -> Column:
    return F.coalesce(state.isin(DONE_STATES + FAILED_STATES), F.lit(False))


def progress(finished: Column, total: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(finished.cast("double"), total), 3), F.lit(0.0))


def is_complete(finished: Column, total: Column) -> Column:
    return (finished == total) & (total > 0)


def error_kind(kind: Column, code: Column, status: Column) -> Column:
    """`transient` or `permanent`, from the type, code and status of the failure.

    `kind` is `network` for a failure that never reached the service, `server` for the
    service's own 5xx family, `api` for its other answers and anything else otherwise.
    Message text is not looked at.
    """
    answered = kind == "api"
    retryable = code.isin(RETRYABLE_CODES) | status.isin(RETRYABLE_STATUSES)
    transient = kind.isin("network", "server") | (answered & F.coalesce(retryable, F.lit(False)))
    return F.when(transient, "transient").otherwise("permanent")


def unit_hash(*parts: Column) -> Column:
    """A repeatable number in [0, 1) from the parts."""
    digest = F.md5(F.concat_ws("|", *[part.cast("string") for part in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def base_delay(attempt: Column) -> Column:
    return F.pow(F.lit(2.0), attempt) + 2


def retry_delay(attempt: Column, *identity: Column) -> Column:
    """Capped exponential delay in whole seconds, spread by 20% each way.

    The spread comes from the file and attempt, so a replayed micro-batch schedules
    the same retry again.
    """
    capped = F.least(base_delay(attempt), F.lit(float(MAX_DELAY_SECONDS)))
    return F.floor(capped * (F.lit(0.8) + F.lit(0.4) * unit_hash(*identity, attempt))).cast("int")


def batch_delay(attempt: Column) -> Column:
    """Uncapped delay of the one-shot batch run, null once its attempts are used up."""
    return F.when(attempt < BATCH_ATTEMPTS - 1, base_delay(attempt).cast("int"))
