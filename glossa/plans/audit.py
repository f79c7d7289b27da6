"""Row counts and timings of the stages of a job."""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def run_stage(stage: str, df: DataFrame, write: Callable[[DataFrame], None]) -> dict:
    """Write a stage and report its rows and seconds; rows are counted while they are written."""
    seen = Observation(stage)
    start = time.perf_counter()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    seconds = round(time.perf_counter() - start, 3)
    try:
        rows = seen.get["rows"]
    except Py4JJavaError:  # the count was planned away together with an input known to be empty
        rows = 0
    return {"stage": stage, "rows": rows, "seconds": seconds}
