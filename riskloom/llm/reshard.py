"""Resharding by minimum-cost flow.

Old shard sizes are supplies, new shard capacities are demands, and a byte that
changes its shard costs 1.  The flow that moves the fewest bytes gives, for each
old shard, how many bytes stay and how many go where.  Documents of an old shard
are ordered from large to small; the ones that stay come first, then one block
for each target.  So all cuts between blocks fall among small documents, and
shard sizes come out nearly equal.  Only files of shards that lose or receive a
block are written again.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_dir

ROW_BYTES = 8
BUCKETS = 64  # parts of a size class, so that a very common size is not one group
BUCKET_ROWS = 1 << 20


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Flow (source, target) to amount that meets all supplies at the least cost.

    Successive shortest paths with potentials; ``cost(s, t)`` is not negative.
    The work depends on the numbers of shards only.
    """
    ns, nt = len(supply), len(demand)
    if sum(supply) > sum(demand):
        raise ValueError("capacities are smaller than the data")
    left, room = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = {}
    price = [0] * (ns + nt)
    while any(left):
        dist = [0 if i < ns and left[i] else None for i in range(ns + nt)]
        prev: list[int | None] = [None] * (ns + nt)
        heap = [(0, i) for i in range(ns) if left[i]]
        done = [False] * (ns + nt)
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = True
            if u < ns:
                edges = [(ns + t, cost(u, t)) for t in range(nt)]
            else:
                edges = [(s, -cost(s, u - ns)) for s in range(ns) if flow.get((s, u - ns))]
            for v, c in edges:
                new = d + c + price[u] - price[v]
                if not done[v] and (dist[v] is None or new < dist[v]):
                    dist[v], prev[v] = new, u
                    heapq.heappush(heap, (new, v))
        ends = [ns + t for t in range(nt) if room[t] and dist[ns + t] is not None]
        end = min(ends, key=lambda v: (dist[v] + price[v], v))
        far = max(d for d in dist if d is not None)
        price = [p + (far if d is None else d) for p, d in zip(price, dist, strict=True)]
        path = [end]
        while prev[path[-1]] is not None:
            path.append(prev[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - ns])
        for u, v in zip(path, path[1:], strict=False):
            if u >= ns:
                amount = min(amount, flow[(v, u - ns)])
        for u, v in zip(path, path[1:], strict=False):
            key, sign = ((u, v - ns), 1) if u < ns else ((v, u - ns), -1)
            flow[key] = flow.get(key, 0) + sign * amount
        left[path[0]] -= amount
        room[end - ns] -= amount
    return {k: v for k, v in flow.items() if v}


def even(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


def target_of(flow: dict[tuple[int, int], int], old: Column, middle2: Column) -> Column:
    """New shard of a document whose middle is at ``middle2 / 2`` bytes in its old shard."""
    out = None
    for s in sorted({s for s, _ in flow}):
        at, pieces = 0, None
        own = sorted(((t, n) for (o, t), n in flow.items() if o == s), key=lambda x: (x[0] != s, x[0]))
        for t, n in own:
            at += n
            here = middle2 < F.lit(2 * at)
            pieces = F.when(here, t) if pieces is None else pieces.when(here, t)
        pieces = pieces.otherwise(own[-1][0])
        out = F.when(old == s, pieces) if out is None else out.when(old == s, pieces)
    return out if out is not None else F.lit(0)


def reshard(
    docs: DataFrame, old_shard: Column, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Move documents from their old shards to ``shards`` shards of nearly equal bytes.

    A document's size is its UTF-8 length plus 8 (a null text: 8).  ``old_shard``
    numbers the old shard from 0; null counts as 0.  Affected shards are written to
    ``path`` as ``shard=<n>`` folders of (doc_id, text, ...); the result is read
    from there: (doc_id, size, text_crc32, old_shard, shard, slot).  Slots count
    the documents of a shard from 0 without gaps.  Rows that equal each other keep
    their number; which of them comes first is open.  An empty table gives an
    empty result.  Only the named columns are used.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    base = docs.select(
        docs[id_col].alias("doc_id"),
        docs[text_col].alias("text"),
        F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"),
    ).withColumn("size", size)
    rows = base.count()
    buckets = max(BUCKETS, -(-rows // BUCKET_ROWS))
    # Eight classes for each doubling; the order inside an old shard is class, bucket, size, id.
    base = base.withColumn("class", F.floor(F.log2("size") * 8).cast("int")).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int")
    )
    cell = ["old_shard", "class", "bucket"]
    sums = base.groupBy(*cell).agg(F.sum("size").alias("bytes"))
    held = {r["old_shard"]: r["bytes"] for r in sums.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).collect()}
    supply = [held.get(s, 0) for s in range(max([*held, 0]) + 1)]
    flow = min_cost_flow(supply, even(sum(supply), shards), lambda s, t: int(s != t))

    order = Window.partitionBy("old_shard").orderBy(F.desc("class"), "bucket")
    before = sums.withColumn("before", F.sum("bytes").over(order) - F.col("bytes")).drop("bytes")
    inside = Window.partitionBy(*cell).orderBy(F.desc("size"), "doc_id", "text")
    placed = base.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(before, cell).withColumn(
        "shard", target_of(flow, F.col("old_shard"), 2 * (F.col("before") + F.col("upto")) - F.col("size"))
    )
    moved = {x for s, t in flow if s != t for x in (s, t)} | {s for s in range(len(supply)) if s >= shards}
    nth = Window.partitionBy(*cell, "shard").orderBy(F.desc("upto"))
    placed = placed.withColumn("nth", F.row_number().over(nth))
    keep = placed.select("doc_id", "text", *cell, "size", "nth", "shard")
    affected = F.col("shard").isin(sorted(moved)) if moved else F.lit(False)
    keep.where(affected).write.partitionBy("shard").parquet(path)
    out = spark.read.schema(keep.schema).parquet(path)
    if len(moved) < shards:
        out = out.unionByName(keep.where(~affected))
    out = out.select(
        "doc_id", *cell, "size", "nth", "shard", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")
    )
    counts = out.groupBy("shard", *cell).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("old_shard", "class", "bucket")
    first = counts.withColumn("first", F.sum("n").over(earlier) - F.col("n")).drop("n")
    return out.join(first, ["shard", *cell]).select(
        "doc_id",
        "size",
        "text_crc32",
        "old_shard",
        "shard",
        (F.col("first") + F.col("nth") - 1).alias("slot"),
    )


def reshard_digest(docs: DataFrame, shards: int = 24, old_shards: int = 16) -> DataFrame:
    """Reshard documents that lie by source in ``old_shards`` shards."""
    old = F.pmod(F.crc32(F.coalesce(docs["source"].cast("string"), F.lit(""))), F.lit(old_shards))
    return reshard(docs, old, shards, scratch_dir(docs.sparkSession)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )
