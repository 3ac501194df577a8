"""Operator 1: resharding by minimum-cost flow.

From the byte sizes of the old shards and the capacities of the new ones, a
transportation problem is solved that moves the fewest bytes; blocks of rows are
then dealt so that they realise the flow, and only affected shards are rewritten.

Law ``bytes``: the sizes of the new shards are near equal. What the driver holds is
bounded whatever the input: a row larger than a unit, total/(shards*HEAVY), is a block of
its own (at most shards*HEAVY of them can exist), all other rows hash into BLOCKS
blocks per old shard; a block that repeated rows swell to over SWOLLEN units is cut by row
into pieces of about a unit. Slots are counted in parts of a block of about PART_ROWS rows,
whose first slots are prefix sums, so that no task numbers more than a part.

Equal texts (a group of copies) may be dealt to several shards: near equal sizes leave no
choice where a group is larger than a shard, and smaller ones are not kept together.

Cases: null text counts 1 byte and has crc32 0; null ids, empty texts and repeated
rows are placed like any others, each by itself (ties inside a block get slots in any order);
very long texts are blocks of their own; a null source, or a shard number that is not an old
one, counts as source '' or shard 0; no row at all gives an empty result; extra columns are
carried along untouched (the stage replaces columns named shard and slot).
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphward.llm.common import materialize, maybe_broadcast, table, text_or_empty

BLOCKS, PART_ROWS = 512, 100_000
HEAVY, SWOLLEN = 1000, 4
SHARDS = 8
#: Old layout of a table that has none: crc32 of its source dealt over so many shards.
OLD_SHARDS = 12


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow x[i][j] with sum_j x = supply, sum_i x <= capacity and least total cost (successive shortest paths)."""
    m, n = len(supply), len(capacity)
    flow = [[0] * n for _ in range(m)]
    left, room = list(supply), list(capacity)
    while True:
        # Bellman-Ford from all old shards with rows left; residual arcs run back along positive flow.
        dist_old = [0 if s > 0 else None for s in left]
        dist_new: list[int | None] = [None] * n
        via_new: list[int] = [-1] * n
        via_old: list[int] = [-1] * m
        changed = True
        while changed:
            changed = False
            for i in range(m):
                if dist_old[i] is None:
                    continue
                for j in range(n):
                    d = dist_old[i] + cost[i][j]
                    if dist_new[j] is None or d < dist_new[j]:
                        dist_new[j], via_new[j], changed = d, i, True
            for j in range(n):
                if dist_new[j] is None:
                    continue
                for i in range(m):
                    if flow[i][j] > 0 and (dist_old[i] is None or dist_new[j] - cost[i][j] < dist_old[i]):
                        dist_old[i], via_old[i], changed = dist_new[j] - cost[i][j], j, True
        ends = [j for j in range(n) if room[j] > 0 and dist_new[j] is not None]
        if not ends:
            return flow
        j = min(ends, key=lambda e: (dist_new[e], e))
        path, amount, end = [], room[j], j
        while True:
            i = via_new[j]
            path.append((i, j, 1))
            if via_old[i] < 0:
                amount = min(amount, left[i])
                left[i] -= amount
                break
            j = via_old[i]
            path.append((i, j, -1))
            amount = min(amount, flow[i][j])
        for i, j, sign in path:
            flow[i][j] += sign * amount
        room[end] -= amount


@dataclass
class Plan:
    """Where each block goes; moved and total are bytes, affected the shards whose files change."""

    blocks: list[tuple[int, bool, int, int, int, int]]  # old shard, heavy, block, piece, new shard, first slot
    loads: list[int]
    moved: int
    total: int
    affected: list[int]


def solve(blocks: list[tuple[int, bool, int, int, int, int]], n_old: int, n_new: int) -> Plan:
    """Deal blocks (old shard, heavy, block, piece, bytes, rows) along the cheapest flow, then even out what is left."""
    total = sum(b[4] for b in blocks)
    supply = [0] * n_old
    for old, _, _, _, size, _ in blocks:
        supply[old] += size
    capacity = [total * (j + 1) // n_new - total * j // n_new for j in range(n_new)]
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(n_new)] for i in range(n_old)])
    dealt: list[list[tuple[int, int]]] = [[] for _ in range(n_new)]  # (bytes, index)
    loads, home = [0] * n_new, [0] * len(blocks)
    for k in sorted(range(len(blocks)), key=lambda k: (-blocks[k][4], blocks[k][:4])):
        old, size = blocks[k][0], blocks[k][4]
        j = max(range(n_new), key=lambda j: (flow[old][j] >= size, flow[old][j], j == old, -j))
        flow[old][j] -= size
        loads[j] += size
        home[k] = j
        dealt[j].append((size, k))
    for d in dealt:
        d.sort()
    for _ in range(4 * len(blocks)):
        hi, lo = max(range(n_new), key=lambda j: (loads[j], j)), min(range(n_new), key=lambda j: (loads[j], j))
        gap = loads[hi] - loads[lo]
        at = bisect.bisect_right(dealt[hi], (gap // 2, len(blocks)))
        near = [x for x in (at - 1, at) if 0 <= x < len(dealt[hi]) and 0 < dealt[hi][x][0] < gap]
        if not near:
            break
        size, k = dealt[hi].pop(min(near, key=lambda x: abs(2 * dealt[hi][x][0] - gap)))
        bisect.insort(dealt[lo], (size, k))
        loads[hi], loads[lo], home[k] = loads[hi] - size, loads[lo] + size, lo
    slots, placed, moved, affected = [0] * n_new, [], 0, set()
    for k, (old, heavy, block, piece, size, rows) in enumerate(blocks):
        j = home[k]
        placed.append((old, heavy, block, piece, j, slots[j]))
        slots[j] += rows
        if j != old:
            moved += size
            affected |= {j, old}
    return Plan(placed, loads, moved, total, sorted(affected))


def reshard(docs: DataFrame, n_new: int = SHARDS, old_shard: str | None = None, n_old: int = OLD_SHARDS, keep: list[str] | None = None) -> tuple[DataFrame, Plan]:
    """docs (its columns `keep`, or all) with __gw_old, __gw_size, __gw_crc, __gw_shard and __gw_slot, and the plan.

    old_shard names the column with each row's shard (0 to n_old-1); without it the
    source decides. A null or foreign value counts as shard 0.
    """
    old = F.col(old_shard) if old_shard else F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit(""))), F.lit(n_old))
    old = F.coalesce(F.when(old.between(0, n_old - 1), old), F.lit(0)).cast("int")
    size = (F.octet_length(text_or_empty()) + 1).cast("long")
    own = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    crc = F.crc32(text_or_empty())
    found = docs.select(*own, old.alias("__gw_old"), size.alias("__gw_size"), crc.alias("__gw_crc"), F.xxhash64("doc_id", crc, size).alias("__gw_hash"), F.monotonically_increasing_id().alias("__gw_uid"))
    rows = materialize(found)  # so that row numbers stay
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("__gw_size"), F.lit(0))).first()
    unit = max(1, total // (n_new * HEAVY))
    heavy = F.col("__gw_size") > unit
    rows = rows.withColumns({"__gw_heavy": heavy, "__gw_block": F.when(heavy, F.col("__gw_uid")).otherwise(F.pmod("__gw_hash", F.lit(BLOCKS)))})
    key = ["__gw_old", "__gw_heavy", "__gw_block"]
    sums = [F.sum("__gw_size").alias("bytes"), F.count("*").alias("rows")]
    # Blocks that hold equal rows alone, or nearly so: hashes over SWOLLEN units are cut by row.
    equal = rows.filter(~heavy).groupBy("__gw_hash").agg(*sums).filter(F.col("bytes") > SWOLLEN * unit)
    equal = equal.select("__gw_hash", F.ceil(F.col("bytes") / unit).cast("long").alias("__gw_pieces"))  # at most shards * HEAVY / SWOLLEN rows
    rows = rows.join(F.broadcast(equal), "__gw_hash", "left")
    rows = rows.withColumn("__gw_piece", F.coalesce(1 + F.pmod(F.xxhash64("__gw_uid"), F.col("__gw_pieces")), F.lit(0))).drop("__gw_pieces", "__gw_hash")
    key.append("__gw_piece")
    plan = solve(sorted(tuple(r) for r in rows.groupBy(*key).agg(*sums).collect()), n_old, n_new)
    where = docs.sparkSession.createDataFrame(plan.blocks, "__gw_old int, __gw_heavy boolean, __gw_block long, __gw_piece long, __gw_shard int, __gw_start long")
    parts = max(1, -(-n // (PART_ROWS * BLOCKS)))
    rows = rows.withColumn("__gw_part", F.pmod(F.xxhash64("__gw_uid", F.lit("part")), F.lit(parts)))
    before = Window.partitionBy(*key).orderBy("__gw_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*key, "__gw_part").count().withColumn("__gw_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    starts = starts.join(F.broadcast(where), key)
    inside = Window.partitionBy(*key, "__gw_part").orderBy("__gw_uid")
    out = rows.withColumn("__gw_at", F.row_number().over(inside) - 1).join(maybe_broadcast(starts), [*key, "__gw_part"])
    out = out.withColumn("__gw_slot", F.col("__gw_start") + F.col("__gw_before") + F.col("__gw_at"))
    return out.select(*own, *(f"__gw_{c}" for c in ("old", "size", "crc", "shard", "slot"))), plan


def rewrite(docs: DataFrame, path: str, **how) -> tuple[DataFrame, Plan]:
    """Write the shards whose contents change to path/shard=J; shards outside plan.affected keep their old files."""
    placed, plan = reshard(docs, **how)
    changed = placed.filter(F.col("__gw_shard").isin(plan.affected)) if plan.affected else placed.limit(0)
    kept = [c for c in changed.columns if not c.startswith("__gw_") and c not in ("shard", "slot")]
    changed.select(*kept, F.col("__gw_slot").alias("slot"), F.col("__gw_shard").alias("shard")).write.mode("overwrite").partitionBy("shard").parquet(path)
    return placed, plan


def op1_reshard_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 7, near equal in bytes, from the layout by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    placed, _ = reshard(docs, keep=["doc_id"])
    return placed.select(
        "doc_id",
        F.col("__gw_size").alias("size"),
        F.col("__gw_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("__gw_shard").alias("shard"),
        F.col("__gw_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("__gw_old").alias("old_shard"),
    )


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: the documents with their shard and their slot in it; columns of these names are replaced.

    Null, empty and very long texts, ties, repeated rows and an empty table are placed as by reshard().
    """
    placed, _ = reshard(docs)
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    return placed.select(*own, F.col("__gw_shard").alias("shard"), F.col("__gw_slot").alias("slot"))
