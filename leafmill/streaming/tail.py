"""A job's log as it is followed: its lines, a sign of life in each silence, and the end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SENT = "job bigint, us bigint, event string, line string"


def follow(log: DataFrame, silence: float = 20.0, late: str = "1 hour") -> DataFrame:
    """job, us, event, line for the stream log(job, us, id, line, terminal), us being microseconds of 1970.

    Lines are data, in order of time and id.  After each silence seconds without anything a
    keepalive is due, also while nothing comes, as far as the watermark has got; those between
    two lines stand strictly before the second.  A terminal row drains the lines up to its time
    and sends done; what comes later is for nobody.  Rows more than late behind the latest are
    dropped.  State is two values a job; a job's new lines of a batch are sorted in one task.
    """
    step = round(silence * 1e6)

    def run(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, closed = state.get if state.exists else (None, False)
        out: list[tuple] = []

        def wait(until: int) -> None:
            nonlocal seen
            while seen is not None and seen + step < until:
                seen += step
                out.append((seen, "keepalive", None))

        if state.hasTimedOut:
            wait(state.getCurrentWatermarkMs() * 1000 + 1)
        else:
            rows = pd.concat(list(chunks)).sort_values(["us", "terminal", "id"], kind="stable")
            for r in rows.itertuples():
                if closed:
                    break
                wait(r.us)
                seen, closed = r.us, bool(r.terminal)
                out.append((r.us, "done", None) if closed else (r.us, "data", r.line))
        state.update((seen, closed))
        if not closed:
            state.setTimeoutTimestamp(max((seen + step) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"job": key[0], "us": [x[0] for x in out], "event": [x[1] for x in out], "line": [x[2] for x in out]})

    timed = log.withColumn("at", F.timestamp_micros("us")).withWatermark("at", late)
    return timed.groupBy("job").applyInPandasWithState(run, SENT, "seen bigint, closed boolean", "append", GroupStateTimeout.EventTimeTimeout)
