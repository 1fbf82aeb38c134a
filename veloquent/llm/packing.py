"""Filling containers of fixed capacity with items, by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ROWS = 50_000
MOST_CAPACITIES = 1_000


class SumOfSquares:
    """Open bins counted by residual gap. An item goes where the sum of the squared counts ends up smallest.

    With N(g) open bins of gap g, moving a bin from g to g - s changes the sum by 2 (N(g-s) - N(g)) + 2; a bin
    that becomes full, or is new, changes one count only. Of equal choices the tightest gap wins.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # N(g) for 0 < g < capacity; both ends stay 0
        self.bins: dict[int, list[int]] = {}
        self.made = 0

    def place(self, size: int) -> int:
        """The bin of an item with 0 < size <= capacity."""
        c, n = self.capacity, self.count
        gaps = size + np.flatnonzero(n[size:c])
        best = c
        if len(gaps):
            rest = gaps - size
            cost = np.where(rest > 0, 2 * n[rest] + 1, 0) - 2 * n[gaps] + 1
            i = int(cost.argmin())
            new = 2 * int(n[c - size]) + 1 if size < c else 0
            if cost[i] <= new:
                best = int(gaps[i])
        if best == c:
            b, self.made = self.made, self.made + 1
        else:
            b = self.bins[best].pop()
            n[best] -= 1
        left = self.left = best - size
        if left:
            n[left] += 1
            self.bins.setdefault(left, []).append(b)
        return b


class Shard:
    """One shard's packing: a bin's items are given out when it is full; what is open at the end is packed once more.

    Items come in random order, in which the rule wastes least over many items. The rest bins are too few for
    that, so their items are packed anew by falling size, if that takes fewer bins.
    """

    def __init__(self, capacity: int) -> None:
        self.bins = SumOfSquares(capacity)
        self.open: dict[int, list[tuple]] = {}

    def add(self, item: tuple) -> list[tuple]:
        """The full bin's (name, *item) if the item, which ends in its size, fills one."""
        b = self.bins.place(item[-1])
        self.open.setdefault(b, []).append(item)
        return [] if self.bins.left else [(str(b), *x) for x in self.open.pop(b)]

    def rest(self) -> list[tuple]:
        again = SumOfSquares(self.bins.capacity)
        items = sorted((x for xs in self.open.values() for x in xs), key=lambda x: (-x[-1], x))
        anew = [(f"r{again.place(x[-1])}", *x) for x in items]
        return anew if again.made < len(self.open) else [(str(b), *x) for b, xs in self.open.items() for x in xs]


def pack(items: DataFrame, capacities: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Assign items (item_id bigint, size int) to containers of each capacity (name string, capacity int).

    Returns (name, container string, item_id, piece int, start int, tokens int). An item longer than the
    capacity is cut into full pieces, each a container of its own, and its remainder, which is packed; no other
    item is cut. Items of size 0 or null take no space: they go to container ``empty``. Capacities that are
    null or below 1 hold nothing and have no rows.

    Items are spread over shards of about ``shard_rows`` by a hash of their id, and each shard is packed on its own
    in the order of another hash, in one pass that holds its open bins only. A shard has each size in its share, so
    what sharding costs is the few bins that each shard leaves partly filled.
    """
    caps = capacities.filter(F.col("capacity") >= 1).select(F.col("name").cast("string").alias("name"), F.col("capacity").cast("int").alias("capacity"))
    sizes = [(r["name"], r["capacity"]) for r in caps.distinct().take(MOST_CAPACITIES + 1)]
    if len(sizes) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} kinds of containers")
    n = items.count()
    shards = max(1, -(-n // shard_rows))
    if not sizes:
        sizes_col = F.array().cast("array<struct<name:string,capacity:int>>")
    else:
        sizes_col = F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("capacity")) for a, b in sizes])
    x = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("size").cast("int"), F.lit(0)).alias("size"))
    x = x.select("*", F.explode(sizes_col).alias("c")).select("item_id", "size", "c.name", "c.capacity")
    pieces = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / F.col("capacity")).cast("int") - 1, F.lit(0)))).alias("piece")
    x = x.select("*", pieces).withColumn("start", F.col("piece") * F.col("capacity")).withColumn("tokens", F.least(F.col("capacity"), F.col("size") - F.col("start")))
    alone = F.when(F.col("tokens") <= 0, F.lit("empty")).when(F.col("tokens") == F.col("capacity"), F.concat_ws("-", F.lit("full"), "item_id", "piece"))
    x = x.withColumn("container", alone)
    out = ["name", "container", "item_id", "piece", "start", "tokens"]
    whole = x.filter(F.col("container").isNotNull()).select(*out)
    rest = x.filter(F.col("container").isNull()).withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int"))
    rest = rest.select("name", "shard", "tokens", "item_id", "piece", "start", "capacity")
    spark = items.sparkSession  # packing costs more than its bytes tell, so the tasks are not left to be merged by size
    tasks = min(max(1, shards * len(sizes)), 10 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    order = F.xxhash64(F.lit("order"), "item_id", "piece")
    rest = rest.repartition(tasks, "name", "shard").sortWithinPartitions("name", "shard", order, "item_id", "piece")
    schema = pa.schema([("name", pa.string()), ("container", pa.string()), ("item_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int32()), ("tokens", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, ready = None, None, []

        def give(found: list[tuple]) -> None:
            ready.extend((key[0], f"{key[1]}-{name}", *x) for name, *x in found)

        def batch() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*ready), schema)], schema=schema)
            ready.clear()
            return made

        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in ("name", "shard", "capacity", "item_id", "piece", "start", "tokens")}
            for name, number, capacity, *item in zip(*cols.values()):
                if (name, number, capacity) != key:
                    if shard:
                        give(shard.rest())
                    key, shard = (name, number, capacity), Shard(capacity)
                give(shard.add(tuple(item)))
            if len(ready) > 10_000:
                yield batch()
        if shard:
            give(shard.rest())
        if ready:
            yield batch()

    packed = rest.mapInArrow(run, "name string, container string, item_id long, piece int, start int, tokens int")
    return whole.unionByName(packed)
