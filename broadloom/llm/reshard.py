"""Resharding that moves the fewest bytes.

A shard is a set of blocks (ranges of a hash of its documents), 4096 for each old shard whatever its size. From the old
shards' bytes and the new shards' capacities a minimum-cost flow says how many bytes go from where to where; each
transfer is then made up of whole blocks, the large ones first. A document's new shard follows from its old shard and
its block, so the map is a table of fixed size. Only shards that give or receive blocks are written anew.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from broadloom.session import durable

BLOCKS = 4096
MOST_BLOCKS = 1 << 21


def transfer_plan(supply: list[int], capacity: list[int], cost=None) -> dict[tuple[int, int], int]:
    """Bytes to send from old shard i to new shard j, at least total cost: successive shortest paths.

    Staying (i to i) is free, a byte moved costs 1, unless ``cost(i, j)`` says otherwise. Capacities must add up to
    the supplies or more.
    """
    cost = cost or (lambda i, j: 0 if i == j else 1)
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards hold less than the old ones")
    price = [[cost(i, j) for j in range(m)] for i in range(n)]
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        # Bellman-Ford over the residual graph from all old shards with bytes left.
        far = float("inf")
        d_old, d_new = [0 if left[i] else far for i in range(n)], [far] * m
        via_new, via_old = [-1] * m, [-1] * n
        changed = True
        while changed:
            changed = False
            for i in range(n):
                if d_old[i] < far:
                    for j in range(m):
                        if d_old[i] + price[i][j] < d_new[j] - 1e-12:
                            d_new[j], via_new[j], changed = d_old[i] + price[i][j], i, True
            for j in range(m):
                if d_new[j] < far:
                    for i in range(n):
                        if flow[i][j] and d_new[j] - price[i][j] < d_old[i] - 1e-12:
                            d_old[i], via_old[i], changed = d_new[j] - price[i][j], j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: (d_new[j], j))
        path, j = [], end
        while True:
            i = via_new[j]
            path.append((i, j, True))
            if via_old[i] < 0:
                break
            j = via_old[i]
            path.append((i, j, False))
        amount = min([left[i], room[end], *(flow[a][b] for a, b, forward in path if not forward)])
        for a, b, forward in path:
            flow[a][b] += amount if forward else -amount
        left[i] -= amount
        room[end] -= amount
    return {(i, j): f for i, row in enumerate(flow) for j, f in enumerate(row) if f}


def assign_blocks(blocks: list[tuple[int, int, int]], plan: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    """(old, block, new): each block, largest first, to the target of its shard that lacks the most bytes; staying
    comes first while the block fits there."""
    wants: dict[int, dict[int, int]] = {}
    for (i, j), amount in plan.items():
        wants.setdefault(i, {})[j] = amount
    out = []
    for old, block, size in sorted(blocks, key=lambda b: (-b[2], b[0], b[1])):
        to = wants.get(old) or {old: 0}
        new = old if to.get(old, 0) >= size else max(to, key=lambda j: (to[j], -j))
        to[new] = to.get(new, 0) - size
        out.append((old, block, new))
    return out


@dataclass
class Resharded:
    """rows: every row of the input with shard and slot, read from the files where its shard was rewritten."""
    rows: DataFrame
    plan: dict[tuple[int, int], int]
    rewritten: list[int]
    path: str


def _weights(placed: DataFrame) -> list[dict]:
    return placed.groupBy("_old", "_block").agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("n")).toArrow().to_pylist()


def _split_heavy(placed: DataFrame, weighed: list[dict], shard: int, blocks: int) -> tuple[DataFrame, list[dict]]:
    """Rows and weights with the blocks above a 128th of a shard cut into parts of about a 512th."""
    heavy = [b for b in weighed if b["n"] > 1 and b["bytes"] > max(1, shard // 128)]
    if not heavy:
        return placed, weighed
    parts = [(b["_old"], b["_block"], min(b["n"], -(-b["bytes"] // max(1, shard // 512)))) for b in heavy]
    marked, first = [], blocks
    for old, block, k in parts:
        marked.append((old, block, first, k))
        first += k
    # At most 128 rows for each new shard.
    marks = F.broadcast(placed.sparkSession.createDataFrame(marked, "_old int, _block int, _first int, _parts int"))
    # The number of a row is written down, since it may differ when the rows are read again.
    hot = placed.join(marks, ["_old", "_block"]).withColumn("_n", F.xxhash64(F.monotonically_increasing_id()))
    hot = durable(hot.select("_row", "_size", "_old", (F.col("_first") + F.pmod("_n", "_parts")).cast("int").alias("_block"),
                             F.pmod(F.xxhash64("_n", F.lit(1)), F.lit(1 << 20)).cast("int").alias("_h")))
    gone = {(b["_old"], b["_block"]) for b in heavy}
    light = placed.join(marks, ["_old", "_block"], "left_anti")
    return light.unionByName(hot), [b for b in weighed if (b["_old"], b["_block"]) not in gone] + _weights(hot)


def reshard(docs: DataFrame, old: Column, old_shards: int, new_shards: int, path: str, doc_id: str = "doc_id", text: str = "text",
            rows_per_file: int = 4096, blocks: int = BLOCKS) -> Resharded:
    """Deal ``docs`` from shards ``old`` (0 to old_shards - 1) to ``new_shards`` of near equal bytes, and write those that change.

    A document weighs its UTF-8 bytes (NULL: none) plus 8. The result has all columns of ``docs``, shard and slot
    (gapless from 0, by file chunk and id); columns already called so are replaced. A NULL id is an id. Rows that repeat id
    and text share a block until it is heavy. An empty table writes nothing. The difference between two shards is at most a few blocks,
    that is, about a thousandth of the largest old shard, or a document.

    Blocks above a 128th of a new shard, which only long documents or rows that repeat make, are written with a number of
    the row and dealt anew by it, in parts of a 512th of a shard.

    The driver sees old_shards x ``blocks`` sizes. Texts move once, to the file chunk they are written to; chunks follow
    a hash, so neither a hot source nor a hot old shard gathers in one task.
    """
    if old_shards * blocks > MOST_BLOCKS:
        raise ValueError("too many blocks for the driver")
    spark = docs.sparkSession
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")
    h = F.xxhash64(F.col(doc_id), F.col(text))
    placed = docs.select(F.struct(*keep).alias("_row"), size.alias("_size"), old.cast("int").alias("_old"), F.pmod(h, F.lit(blocks)).cast("int").alias("_block"),
                         F.pmod(F.xxhash64(h, F.lit(1)), F.lit(1 << 20)).cast("int").alias("_h"))
    weighed = _weights(placed)
    placed, weighed = _split_heavy(placed, weighed, sum(b["bytes"] for b in weighed) // new_shards, blocks)
    supply = [0] * old_shards
    for b in weighed:
        supply[b["_old"]] += b["bytes"]
    total = sum(supply)
    capacity = [total // new_shards + (j < total % new_shards) for j in range(new_shards)]
    plan = transfer_plan(supply, capacity)
    moves = assign_blocks([(b["_old"], b["_block"], b["bytes"]) for b in weighed], plan)
    counts, touched = [0] * new_shards, set()
    rows_of = {(b["_old"], b["_block"]): b["n"] for b in weighed}
    for i, b, j in moves:
        counts[j] += rows_of[i, b]
        if i != j:
            touched |= {i, j}
    rewritten = sorted(t for t in touched if t < new_shards)
    kinds = pa.schema([("_old", pa.int32()), ("_block", pa.int32()), ("shard", pa.int32()), ("_chunks", pa.int32())])
    table = pa.Table.from_arrays([pa.array(c, pa.int32()) for c in (list(zip(*[(i, b, j, -(-counts[j] // rows_per_file)) for i, b, j in moves]))
                                                                    or [[], [], [], []])], schema=kinds)
    # At most old_shards x blocks rows of 16 bytes, whatever the data.
    to = F.broadcast(spark.createDataFrame(table, "_old int, _block int, shard int, _chunks int"))
    dealt = placed.join(to, ["_old", "_block"]).withColumn("_chunk", (F.col("_h") % F.col("_chunks")).cast("int")).drop("_chunks")
    chunks = dealt.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("c"))
    chunks = chunks.select("shard", "_chunk", (F.sum("c").over(W.partitionBy("shard").orderBy("_chunk")) - F.col("c")).alias("_first"))
    within = F.row_number().over(W.partitionBy("shard", "_chunk").orderBy(F.col("_row")[doc_id], "_h", F.col("_row")[text])) - 1
    numbered = dealt.withColumn("_n", within).join(F.broadcast(chunks) if sum(counts) // rows_per_file < 100_000 else chunks,
                                                   ["shard", "_chunk"]).withColumn("slot", (F.col("_first") + F.col("_n")).cast("bigint"))
    final = numbered.select("_row.*", "shard", "slot")
    changed = F.col("shard").isin(rewritten) if rewritten else F.lit(False)
    final.filter(changed).write.partitionBy("shard").parquet(path)
    if not rewritten:
        return Resharded(final, plan, rewritten, path)
    written = spark.read.schema(final.schema).parquet(path).select(final.columns)
    still = [j for j in range(new_shards) if j not in touched]
    rows = written.union(final.filter(F.col("shard").isin(still))) if any(counts[j] for j in still) else written
    return Resharded(rows, plan, rewritten, path)
