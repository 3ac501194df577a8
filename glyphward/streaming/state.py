"""Structured Streaming forms: request dedup, sessions, and a consume-once mapping store with a TTL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_SECONDS, DEDUP_SECONDS, SESSION_SECONDS = 300, 30, 3600


def dedup_requests(stream: DataFrame, keys: list[str], ts: str = "ts", seconds: int = DEDUP_SECONDS) -> DataFrame:
    """The first request of each key within the window; ts is cast, as watermarks need TIMESTAMP."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{seconds} seconds").dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, user: str, ts: str = "ts", seconds: int = SESSION_SECONDS) -> DataFrame:
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{seconds} seconds")
    return s.groupBy(F.session_window(ts, f"{seconds} seconds").alias("session"), user).agg(F.count("*").alias("n"))


def restore_once(requests: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """Mapping store: rows (mapping_id, op put/get, payload, at long seconds) -> (mapping_id, payload, found).

    A get returns the payload once, if it is not older than the TTL; later gets find nothing.
    """

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        payload, at = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(list(pdfs)).sort_values("at", kind="stable").itertuples(index=False):
            if payload is not None and r.at - at > ttl:
                payload = None
            if r.op == "put":
                payload, at = r.payload, int(r.at)
            else:
                out.append((key[0], payload, payload is not None))
                payload = None
        if payload is None:
            state.remove()
        else:
            state.update((payload, at))
        yield pd.DataFrame(out, columns=["mapping_id", "payload", "found"])

    cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])
    return requests.groupBy("mapping_id").applyInPandasWithState(run, "mapping_id string, payload string, found boolean", "payload string, at long", "append", GroupStateTimeout.NoTimeout)
