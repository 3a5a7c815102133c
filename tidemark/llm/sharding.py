"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt into blocks by hash. How many rows each block sends to each shard in a uniform
shuffle follows a multivariate hypergeometric law, so these counts are drawn first: a small matrix
with exact row and column sums. Each block permutes its rows and cuts them at the drawn counts,
cells of the shards collect the pieces, and each permutes what it got. No task holds a shard: the
cells of one are as many as the session has shuffle partitions.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import table

BLOCKS_PER_PARTITION = 4
SEED = 42


def sharded(docs: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """``docs`` with ``shard`` (from 0) and ``slot`` (its place in the shard, without gaps from 0).

    Shards differ by one row at most. Columns of ``docs`` named so are replaced. Null ids and texts
    are hashed like any value; rows equal in all columns are told apart by their place in their
    block, so each gets a slot of its own. An empty table gives an empty result, and with fewer
    rows than shards some shards stay empty.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = BLOCKS_PER_PARTITION * partitions
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    key = F.xxhash64(*names, F.lit(seed))
    block = F.pmod(key, F.lit(blocks)).cast("int")
    counts = {r[0]: r[1] for r in docs.groupBy(block.alias("block")).count().collect()}
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], shards, seed)
    # Where the pieces of each block end, as one array per block; its size is blocks times shards.
    ends = table(matrix.cumsum(1).tolist(), "array<array<bigint>>")[F.col("_at.block")]
    cells = BLOCKS_PER_PARTITION * partitions // shards + 1
    own = docs.select(F.struct(*names).alias("_row"), F.struct(block.alias("block"), _order(key, seed + 1).alias("by"), key.alias("key")).alias("_at"))
    place = F.row_number().over(Window.partitionBy("_at.block").orderBy("_at.by", "_at.key"))
    own = own.withColumn("_place", place)
    shard = F.aggregate(ends, F.lit(0), lambda n, end: F.when(F.col("_place") > end, n + 1).otherwise(n))
    # The second permutation has keys of its own, which also say in which cell of the shard a row lands.
    again = F.xxhash64("_at.key", "_place", F.lit(seed + 2))
    own = own.select("_row", F.struct(shard.alias("shard"), F.pmod(again, F.lit(cells)).alias("cell"),
                                      _order(again, seed + 3).alias("by"), F.col("_place").alias("place")).alias("_at"))
    sizes = own.groupBy("_at.shard", "_at.cell").count().collect()
    before, sent = {}, [0] * shards
    for r in sorted(sizes, key=lambda r: (r["shard"], r["cell"])):
        before[r["shard"], r["cell"]] = sent[r["shard"]]
        sent[r["shard"]] += r["count"]
    starts = table([[before.get((s, c), 0) for c in range(cells)] for s in range(shards)], "array<array<bigint>>")
    rank = F.row_number().over(Window.partitionBy("_at.shard", "_at.cell").orderBy("_at.by", "_at.place"))
    own = own.withColumn("_rank", rank)
    slot = starts[F.col("_at.shard")][F.col("_at.cell").cast("int")] + F.col("_rank") - 1
    return own.select(*[F.col("_row").getField(n).alias(n) for n in names], F.col("_at.shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))


def _order(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """How many of each block's rows go to each shard: exact sums, drawn as a uniform shuffle would."""
    rng = random.Random(seed)
    total = sum(rows)
    free = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(rows), shards), np.int64)
    for b, n in enumerate(rows):
        room = sum(free)
        for s in range(shards):
            out[b, s] = hypergeometric(rng, free[s], room - free[s], n)
            room -= free[s]
            n -= out[b, s]
        free = [f - int(k) for f, k in zip(free, out[b])]
    return out


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` taken without replacement are among the ``good``.

    By inversion, going outward from the mode, so the cost is the spread and not the size; numpy's
    own generator takes at most a thousand million rows.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(max((good + 1) * (drawn + 1) // (good + bad + 2), low), high)
    top = math.exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(good + bad, drawn))
    u = rng.random() - top
    up = down = mode
    p = q = top
    while u > 0 and (up < high or down > low):
        if up < high:
            p *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            if (u := u - p) <= 0:
                return up
        if down > low:
            q *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            if (u := u - q) <= 0:
                return down
    return mode


def digests(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shard and slot of every document, with the size and CRC-32 of its text (null: as empty).

    Only ids, sizes and sums go through the shuffle; ``sharded`` itself carries any columns.
    """
    text = F.coalesce("text", F.lit(""))
    small = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharded(small, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                         F.lit(None).cast("int").alias("grown_shard"))
