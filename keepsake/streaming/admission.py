"""Trailing-window admission over a stream of requests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.admission import Replay

# Principals are dealt to this many rows of state.
BUCKETS = 4096


def admit_stream(requests: DataFrame, limit: int, window_seconds: float, late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """Decide requests (``request_id, principal, ts``) as they come; state is ``limit`` times a principal.

    Every request gets one row. Those of one micro-batch are taken in time order, ids
    deciding among equal times. A request behind the watermark (``late`` before the newest
    one of earlier micro-batches) is not admitted, changes nothing and says ``late``.

    Spark drops rows behind the watermark where event time ends state, so here nothing
    times out: principals share rows of state, and whenever one is touched, principals whose
    window the watermark has passed leave it. A task holds ids and times of the requests of one
    bucket in the micro-batch, whose size the source's rate limit sets.
    """
    window = int(window_seconds * 1_000_000)

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs() * 1000
        held = dict(zip(*state.get)) if state.exists else {}
        batch = pd.concat([frame[["request_id", "principal", "ts"]] for frame in frames], ignore_index=True)
        batch["stamp"] = batch["ts"].astype("datetime64[us]").astype("int64")
        batch = batch.sort_values(["stamp", "request_id"])
        batch["late"] = batch["stamp"] < watermark
        batch["admitted"] = False
        for principal, own in batch[~batch["late"]].groupby("principal", dropna=False, sort=False):
            name = None if pd.isna(principal) else principal
            player = Replay(limit, window, list(held.get(name, ())))
            # Requests of one time pass one by one, so that ids decide.
            places, _ = player.feed(own["stamp"].to_numpy(), np.ones(len(own), np.int64))
            batch.loc[own.index[places], "admitted"] = True
            held[name] = list(player.times)
        held = {name: times for name, times in held.items() if len(times) and times[-1] + window > watermark}
        if held:
            state.update((list(held), [list(times) for times in held.values()]))
        elif state.exists:
            state.remove()
        yield batch[["request_id", "principal", "ts", "admitted", "late"]]

    kinds = dict(requests.dtypes)
    schema = f"request_id {kinds['request_id']}, principal string, ts timestamp, admitted boolean, late boolean"
    return (
        requests.select("request_id", F.col("principal").cast("string").alias("principal"), "ts")
        .withColumn("bucket", F.pmod(F.xxhash64("principal"), F.lit(buckets))).withWatermark("ts", late)
        .groupBy("bucket")
        .applyInPandasWithState(decide, schema, "principals array<string>, times array<array<bigint>>", "append", GroupStateTimeout.NoTimeout)
    )
