"""Sessions: runs of a user's events without a gap longer than the limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veloquent import session

_SCHEMA = "user string, first_at timestamp, last_at timestamp, first_id string, last_id string, n long, edge boolean"


def _scan(gap_us: int):
    """The linear scan over rows sorted by (user, time, id); holds one batch and one open session."""

    def emit(rows: list[tuple], edge: list[bool]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * 6
        ts = pa.timestamp("us", tz="UTC")
        return pa.record_batch(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()).cast(ts), pa.array(cols[2], pa.int64()).cast(ts), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.int64()), pa.array(edge, pa.bool_())],
            names=["user", "first_at", "last_at", "first_id", "last_id", "n", "edge"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the open session: user, first_at, last_at, first_id, last_id, n
        first = True  # whether the held session is the partition's first
        for b in batches:
            k = b.num_rows
            if not k:
                continue
            user, ids = b.column(0), b.column(2)
            at = np.asarray(b.column(1).cast(pa.int64()))
            same = np.zeros(k, bool)
            twin = np.zeros(k, bool)
            if k > 1:
                same[1:] = np.asarray(pc.equal(user.slice(1), user.slice(0, k - 1)).to_numpy(zero_copy_only=False))
                twin[1:] = same[1:] & (at[1:] == at[:-1]) & np.asarray(pc.equal(ids.slice(1), ids.slice(0, k - 1)).to_numpy(zero_copy_only=False))
            near = np.zeros(k, bool)
            near[1:] = same[1:] & (at[1:] - at[:-1] <= gap_us)
            if held and user[0].as_py() == held[0]:
                near[0] = at[0] - held[2] <= gap_us
                twin[0] = at[0] == held[2] and ids[0].as_py() == held[4]
            start = np.flatnonzero(~near)
            bounds = np.concatenate(([0], start if len(start) and start[0] else start[1:], [k])) if k else start
            count = np.add.reduceat(~twin, bounds[:-1])
            lo, hi = bounds[:-1], bounds[1:] - 1
            names, a, z = user.take(pa.array(lo)).to_pylist(), ids.take(pa.array(lo)).to_pylist(), ids.take(pa.array(hi)).to_pylist()
            out, edge = [], []
            for i in range(len(lo)):
                if i == 0 and near[0]:
                    held = (held[0], held[1], int(at[hi[0]]), held[3], z[0], held[5] + int(count[0]))
                    continue
                if held:
                    out.append(held)
                    edge.append(first)
                    first = False
                held = (names[i], int(at[lo[i]]), int(at[hi[i]]), a[i], z[i], int(count[i]))
            if out:
                yield emit(out, edge)
        if held:
            yield emit([held], [True])

    return run


def sessions(df: DataFrame, user: str, at: str, id_col: str, gap_seconds: int = 1800) -> DataFrame:
    """One row per session: user, session_start, session_end, duration_seconds, n_events, first_id, last_id.

    Events are range-partitioned and sorted by (user, time, id), so a user with any share of the rows is
    spread over as many partitions as that share needs; one linear scan per partition then emits sessions
    and holds no more than a batch and the open session. Only the first and last session of a partition
    can continue in a neighbour; those two per partition are joined by a window over them alone, and no other is
    shuffled. What the scan gives is staged, so that edges and inner sessions come from one and the same partitioning.

    An event more than the gap after the user's last one opens a session, one exactly the gap after does
    not. Rows without a user or time are in no session; rows repeated with the same user, time and id count
    once; ties in time go by id, a null id first.
    """
    rows = df.select(F.col(user).cast("string").alias("user"), F.col(at).alias("at"), F.col(id_col).cast("string").alias("id"))
    rows = rows.filter(F.col("user").isNotNull() & F.col("at").isNotNull()).withColumn("id", F.coalesce("id", F.lit("")))
    order = ["user", "at", "id"]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scan(gap_seconds * 1_000_000), _SCHEMA)
    # only a partition's first and last session can go on in a neighbour: those are joined, all others are ready
    parts = session.staged(parts, "sessions")
    w = Window.partitionBy("user").orderBy("first_at", "first_id")
    apart = F.col("first_at") > F.lag("last_at").over(w) + F.make_dt_interval(secs=F.lit(gap_seconds))
    edges = parts.filter("edge").withColumn("_new", F.when(apart, 1).otherwise(0)).withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edges.groupBy("user", "_no").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.min(F.struct("first_at", "first_id")).alias("_a"), F.max(F.struct("last_at", "last_id")).alias("_z"), F.sum("n").alias("n")
    )
    columns = ["user", "first_at", "last_at", "first_id", "last_id", "n"]
    whole = parts.filter("NOT edge").select(*columns).unionByName(joined.select("user", "first_at", "last_at", F.col("_a.first_id").alias("first_id"), F.col("_z.last_id").alias("last_id"), "n"))
    return whole.select(
        F.col("user").alias(user), F.col("first_at").alias("session_start"), F.col("last_at").alias("session_end"),
        ((F.unix_micros("last_at") - F.unix_micros("first_at")) / 1e6).alias("duration_seconds"), F.col("n").alias("n_events"), "first_id", "last_id",
    )
