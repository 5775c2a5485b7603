"""Filling windows of a fixed capacity with items, by multiway differencing.

Items are dealt by a hash into groups of about ``GROUP_TOKENS`` tokens (an item counts as
``ITEM_WEIGHT`` more), so no task ever holds more than that, however many items there are. Within a group Karmarkar-Karp multiway
differencing starts with a partition for each item, and again and again merges the two partitions
whose windows differ most, the fullest windows of one onto the emptiest of the other, so that the
imbalances cancel. The result is windows of nearly equal fill; their number is the least that the
sum allows and rises by one as long as a window exceeds the capacity.

An item larger than the capacity is the only kind that is cut: it fills whole windows of its own
and its rest is packed as an item.

Defined results: a null size counts as 0; items of size 0 take no room but are assigned; repeated
ids are items of their own; equal sizes go in the order of their ids; an empty table gives no rows.
Items' groups follow from their ids, sizes and repeats, not from the layout of the input.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.storage import write_table

CAPACITY = 4096
GROUP_TOKENS = 500_000
ITEM_WEIGHT = 32
REPEATS = 10_000  # of an item in one array

ASSIGNED = "item LONG, part INT, parts INT, start LONG, size LONG, grp LONG, win INT"


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition items into ``k`` windows: (window of each item, fill of each window)."""
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, dtype=np.int64), np.array([sizes.sum() if n else 0] * 1 + [0] * (k - 1))
    # A partition: its windows' fills in descending order, and for each window a linked list of items.
    nxt = np.full(n, -1, dtype=np.int64)
    fills: dict[int, np.ndarray] = {}
    heads: dict[int, np.ndarray] = {}
    tails: dict[int, np.ndarray] = {}
    heap = []
    for i in range(n):
        f = np.zeros(k, dtype=np.int64)
        f[0] = sizes[i]
        h = np.full(k, -1, dtype=np.int64)
        h[0] = i
        fills[i], heads[i], tails[i] = f, h, h.copy()
        heap.append((-int(sizes[i]), i))
    heapq.heapify(heap)
    fresh = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        fa, ha, ta = fills.pop(a), heads.pop(a), tails.pop(a)
        fb, hb, tb = fills.pop(b)[::-1], heads.pop(b)[::-1], tails.pop(b)[::-1]
        f = fa + fb
        both = (ha >= 0) & (hb >= 0)
        nxt[ta[both]] = hb[both]
        h, t = np.where(ha >= 0, ha, hb), np.where(hb >= 0, tb, ta)
        order = np.argsort(-f, kind="stable")
        f = f[order]
        fills[fresh], heads[fresh], tails[fresh] = f, h[order], t[order]
        heapq.heappush(heap, (-int(f[0] - f[-1]), fresh))
        fresh += 1
    ((_, last),) = heap
    window = np.zeros(n, dtype=np.int64)
    for w, i in enumerate(heads[last]):
        while i >= 0:
            window[i] = w
            i = nxt[i]
    return window, fills[last]


def fill_windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item; all sizes are at most the capacity."""
    k = max(1, int(-(-int(sizes.sum()) // capacity)))
    some = sizes > 0
    window = np.arange(len(sizes), dtype=np.int64) % k  # where items without size go
    while True:
        window[some], fills = differencing(sizes[some], k)
        if fills.max(initial=0) <= capacity:
            return window
        k += 1  # ends: with as many windows as items of any size each has its own


def _pack_group(capacity: int):
    schema = pa.schema([("item", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("start", pa.int64()), ("size", pa.int64()), ("grp", pa.int64()), ("win", pa.int32())])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("item", "ascending"), ("part", "ascending")])
        sizes = group["size"].to_numpy()
        full = sizes == capacity
        window = np.empty(len(sizes), dtype=np.int64)
        window[full] = np.arange(full.sum())
        window[~full] = fill_windows(sizes[~full], capacity) + full.sum()
        return group.append_column("win", pa.array(window, pa.int32())).select(schema.names).cast(schema)

    return run


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Assign every item, or its parts, to a window: (item, part, parts, start, size, grp, win).

    (grp, win) names a window. ``parts`` is above 1 only for items larger than the capacity.
    """
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    items = items.select(F.col(id_col).cast("long").alias("item"), size.alias("all"))
    sums = items.agg(F.sum("all").alias("tokens"), F.count(F.lit(1)).alias("items")).first()
    # Items count as well as tokens, so that many small or empty ones aren't one group.
    groups = max(1, -(-((sums["tokens"] or 0) + ITEM_WEIGHT * sums["items"]) // group_tokens))
    # Repeats of an item are numbered by their count, so that a group hangs on what its items are and
    # not on where they lay: a stage that runs again deals them as before.
    many = F.lit(REPEATS).cast("long")
    counted = items.groupBy("item", "all").agg(F.count(F.lit(1)).alias("times"))
    counted = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / many))))
    last = F.least(many, F.col("times") - F.col("block") * many) - 1
    counted = counted.select("item", "all", "block", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k")).withColumn("nth", F.col("block") * many + F.col("k"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("all") / F.lit(capacity))).cast("int")
    rows = counted.select("item", "all", "nth", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rows = rows.select(
        "item",
        "part",
        "parts",
        (F.col("part") * F.lit(capacity).cast("long")).alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("all") - F.col("part") * F.lit(capacity).cast("long")).alias("size"),
        F.pmod(F.xxhash64("item", "all", "nth", "part"), F.lit(groups)).alias("grp"),
    )
    return rows.groupBy("grp").applyInArrow(_pack_group(capacity), ASSIGNED)


def pack_documents(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """As ``pack``, of (doc_id, tokens); the sizes are written once, since they cost an encoding each."""
    return pack(write_table(sizes, "sizes"), "doc_id", "tokens", capacity)


def windows_report(assigned: DataFrame) -> DataFrame:
    """(grp, win, items, fill): what each window holds."""
    return assigned.groupBy("grp", "win").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("fill"))


def cut_items(assigned: DataFrame) -> DataFrame:
    """(item) of each item that lies in more than one window."""
    where = F.struct("grp", "win")
    return assigned.groupBy("item").agg(F.min(where).alias("a"), F.max(where).alias("b")).where("a <> b").select("item")
