"""A resumable one-shot run over a folder of resumes."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollcall.functions.outcomes import BATCH_ATTEMPTS
from rollcall.operators.encode import Encoder, encode_candidates
from rollcall.operators.records import (
    TRANSIENT,
    Extractor,
    call_extractor,
    failures,
    records,
    validate_replies,
)
from rollcall.operators.tables import pending
from rollcall.plans.scratch import materialize
from rollcall.sources.files import read_json_lines, read_resumes, write_json_lines


def process_folder(
    spark: SparkSession,
    folder: str,
    results: str,
    extractor: Extractor,
    encoder: Encoder,
    attempts: int = BATCH_ATTEMPTS,
    wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Extract every file that `results` has no record of and append its record.

    Files that fail in passing are tried again together after 3, 4, 6, ... seconds, up to
    `attempts` times. Every attempt is saved before the next one, so an interrupted run
    repeats one attempt at most. Returns the files that failed, which are not recorded
    and are picked up by the next run.
    """
    waiting = pending(read_resumes(spark, folder), read_json_lines(spark, results))
    failed = None
    for attempt in range(attempts):
        answers = materialize(call_extractor(waiting, extractor), "replies")
        validated = validate_replies(answers)
        write_json_lines(encode_candidates(records(validated), encoder), results, mode="append")
        last = attempt == attempts - 1
        lost = failures(validated)
        again = lost.where(lost.error_class == TRANSIENT).select("source_file")
        done = lost if last else lost.where(lost.error_class != TRANSIENT)
        failed = done if failed is None else failed.unionByName(done)
        if last or again.isEmpty():
            break
        wait(2**attempt + 2)
        waiting = waiting.join(again, "source_file", "left_semi").select("source_file", "content")
    return failed
