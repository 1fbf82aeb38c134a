"""Admission over a stream: each request is let in or turned away by its key's minute, day and month."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PERIODS = ("minute", "day", "month")
_OUT = "id string, api_key_id string, created_at timestamp, denied_by string"
_STATE = "starts array<timestamp>, used array<long>"


def period_starts(at: datetime) -> list[datetime]:
    minute = at.replace(second=0, microsecond=0)
    day = minute.replace(hour=0, minute=0)
    return [minute, day, day.replace(day=1)]


def admit(at: datetime, limits: list[int], starts: list[datetime], used: list[int]) -> str | None:
    """The first full period, or null; moves the counters in place.

    A counter whose period has ended starts again. A request passes the shorter periods on its way to a longer one
    that is full, and counts against those, as in the batch form. One older than its counter's period, which can
    only be late, is judged by the counter as it is.
    """
    for i, start in enumerate(period_starts(at)):
        if start > starts[i]:
            starts[i], used[i] = start, 0
    for i, name in enumerate(PERIODS):
        if used[i] >= limits[i]:
            return name
        used[i] += 1
    return None


def _run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    starts, used = ([x for x in part] for part in state.get) if state.exists else ([datetime.min] * 3, [0] * 3)
    rows = pd.concat(list(batches)).sort_values(["created_at", "id"])
    out = []
    for r in rows.itertuples(index=False):
        out.append(admit(r.created_at.to_pydatetime(), [r.minute_limit, r.daily_limit, r.monthly_limit], starts, used))
    state.update((starts, used))
    yield pd.DataFrame({"id": rows["id"], "api_key_id": key[0], "created_at": rows["created_at"], "denied_by": pd.Series(out, rows.index, object)})


def decisions(logs: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, api_key_id, created_at, denied_by) of a stream of logs, each once (see ``counters.once_stream``).

    ``keys`` is static: id and the three limits, null for none. The state of a key is three counters.
    A micro-batch is taken in order of (time, id); across batches arrival decides.
    """
    most = 2**62
    limits = keys.select(F.col("id").alias("api_key_id"), *[F.col(f"{n}_limit").cast("long").alias(f"{n}_limit") for n in ("minute", "daily", "monthly")])
    x = logs.filter("api_key_id IS NOT NULL AND created_at IS NOT NULL").select("id", "api_key_id", "created_at").join(limits, "api_key_id", "left")
    x = x.fillna(most, ["minute_limit", "daily_limit", "monthly_limit"])
    return x.groupBy("api_key_id").applyInPandasWithState(_run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
