"""The limiter of requests as a stateful stream: the bucket of each key lives in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import LimiterConfig

OUTPUT = "key string, ts timestamp, allowed boolean, remaining int, retry_after int"
STATE = "used int, begin double"


def limit_stream(events: DataFrame, cfg: LimiterConfig = LimiterConfig()) -> DataFrame:
    """``events``: key string, ts timestamp.  Buckets that rest for two windows of event time
    are forgotten; events later than one window may come too late to count."""

    def bucket(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used, begin = state.get if state.exists else (0, None)
        for batch in batches:
            out = []
            for ts in batch["ts"].sort_values():
                at = ts.timestamp()
                if begin is None or at - begin >= cfg.seconds:
                    used, begin = 0, at
                allowed = used < cfg.most
                used += allowed
                out.append((key[0], ts, allowed, cfg.most - used if allowed else 0, 0 if allowed else int(cfg.seconds - (at - begin)) + 1))
            yield pd.DataFrame(out, columns=["key", "ts", "allowed", "remaining", "retry_after"])
        state.update((used, begin))
        state.setTimeoutTimestamp(max(int((begin + 2 * cfg.seconds) * 1000), state.getCurrentWatermarkMs() + 1))

    return events.withWatermark("ts", f"{cfg.seconds} seconds").groupBy("key").applyInPandasWithState(bucket, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
