"""Structured Streaming over audit and job events. An extension of this package: the model itself is batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.operators.relational import JOB_STATES


def deduplicated(events: DataFrame, key: str = "idempotency_key", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first event of each key, for as long as the watermark keeps it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, state, n in tumbling windows."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "state").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "state", "n")


def job_states(events: DataFrame) -> DataFrame:
    """Each event of a job with the state before it and whether the step is allowed; one small state a job."""
    first = next(iter(JOB_STATES))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        before = state.get[0] if state.exists else None
        out = []
        for r in rows.itertuples():
            out.append((key[0], r.event_id, before, r.state, r.state == first if before is None else r.state in JOB_STATES.get(before, ())))
            before = r.state
        state.update((before,))
        yield pd.DataFrame(out, columns=["job_id", "event_id", "previous", "state", "allowed"])

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id long, event_id long, previous string, state string, allowed boolean", "state string", "append", GroupStateTimeout.NoTimeout)
