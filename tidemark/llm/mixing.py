"""Mixing sources to target weights over a tree of domains, languages and sources.

The token budget goes down the tree. At each node it is shared among the children by weight, no
child getting more than the leaves under it hold in all allowed epochs; what a short child leaves
over goes to its siblings, and only what a whole subtree cannot take goes to the siblings of its
parent. A leaf then takes whole epochs of its documents and a prefix of the next one, in an order
seeded for each epoch. All amounts are whole tokens in 64-bit integers, so results are exact.

A prefix needs no sort of the leaf: documents fall into buckets by the leading bits of their order
key, bucket sums say which buckets are taken whole, and only the bucket where the prefix ends is
ranked. Rows outside these buckets are not shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD
from tidemark.storage import written

LEVELS = ("domain", "lang", "source")
EPOCHS = 4
SEED = 42


def tokens(text: Column) -> Column:
    """Words of a text as its count of tokens; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def leaf_budgets(leaves: DataFrame, budget: int, epochs: int = EPOCHS, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """``leaves`` (levels, weight, tokens) with ``budget``, the tokens each leaf shall give.

    The weight of a leaf is its share among its siblings at the lowest level, that of an inner node
    the sum of its leaves' weights. Weights are whole numbers of at most a million; null or negative
    ones count as 0 and get nothing. Amounts are rounded down at each level, so that the budgets
    sum to the budget less a token a node at most, or to all that the leaves hold if that is less.
    """
    held = leaves.withColumns({"_cap": F.col("tokens") * epochs, "_w": F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0)).cast("long")})
    # A leaf without weight gives nothing, so it doesn't count as room either.
    held = held.withColumn("_cap", F.when(F.col("_w") > 0, F.col("_cap")).otherwise(0))
    given, parent = held, []
    for level in levels:
        path = [*parent, level]
        nodes = held.groupBy(*path).agg(F.sum("_cap").alias("_cap"), F.sum("_w").alias("_w"))
        nodes = _joined(nodes, given, parent, "inner") if parent else nodes.withColumn("_given", F.lit(budget).cast("long"))
        given = _shared_out(nodes, parent, path).select(*path, "_given")
        parent = path
    return _joined(held, given, list(levels), "inner").select(*levels, "weight", "tokens", F.col("_given").alias("budget"))


def _joined(rows: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Joined on ``keys``, where null equals null."""
    named = other.select(*[F.col(k).alias(f"_other{i}") for i, k in enumerate(keys)], *[c for c in other.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_other{i}")) for i, k in enumerate(keys)])
    return rows.join(named, on, how).drop(*[f"_other{i}" for i in range(len(keys))])


def _shared_out(nodes: DataFrame, parent: list[str], path: list[str]) -> DataFrame:
    """Replaces each node's ``_given``, so far its parent's, by its own share.

    Children in order of capacity per weight: one that cannot take its share of what those before
    it left is full, and all after it share the rest by weight.
    """
    by = [F.col("_cap") / F.greatest("_w", F.lit(1)), *[F.asc_nulls_first(c) for c in path]]
    weighted = nodes.where("_w > 0")
    # Siblings meet in one window: their number is bounded by the weights that a user lists.
    order = Window.partitionBy(*parent).orderBy(*by) if parent else Window.partitionBy(F.lit(0)).orderBy(*by)
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = weighted.withColumns({"_full_before": F.coalesce(F.sum("_cap").over(before), F.lit(0)),
                                 "_left": F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))})
    rows = rows.withColumn("_fits", F.expr("cast(_cap as decimal(38, 0)) * _left <= cast(greatest(_given - _full_before, 0) as decimal(38, 0)) * _w"))
    # Beyond the first child that is not full, all share alike what the full ones left.
    rows = rows.withColumns({"_full": F.min(F.col("_fits").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1})
    rows = rows.withColumns({"_taken": F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(whole), F.lit(0)),
                             "_open": F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_w"))).over(whole), F.lit(1))})
    return rows.withColumn("_given", F.when(F.col("_full"), F.col("_cap")).otherwise(
        F.expr("cast(cast(_given - _taken as decimal(38, 0)) * _w div _open as bigint)")))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """32 hex digits that order a leaf's documents in an epoch; null ids have one key as well."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mixed(docs: DataFrame, weight: Column, budget: int | float, epochs: int = EPOCHS, seed: int = SEED,
          levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """The chosen documents: one row for each epoch that takes one, with ``epoch`` and ``n_tokens``.

    ``docs`` has ``doc_id``, ``text`` and the columns of ``levels`` (nulls are nodes of their own);
    ``weight`` is a whole number for each leaf as an expression of the levels. ``budget`` is a
    number of tokens, or as a float a share of all tokens there are. The prefix holds the documents
    that begin before the leaf's budget is spent, so it ends with the one that crosses it. Documents
    without tokens are in a prefix when they begin before its end. Rows of equal id are ordered by
    a hash of their text. Columns of ``docs`` that the result adds are replaced; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("epoch", "n_tokens")]
    # Columns go under numbers, so that no name can clash and those not asked for can be left out.
    held = [F.col(c).alias(f"c{i}") for i, c in enumerate(names)]
    keys = [f"k{i}" for i in range(len(levels))]
    rows = docs.select(*held, *[F.col(c).alias(k) for c, k in zip(levels, keys)], weight.cast("long").alias("weight"),
                       tokens(F.col("text")).alias("n_tokens"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"))
    leaves = written(rows.groupBy(*keys).agg(F.max("weight").alias("weight"), F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    goal = budget if isinstance(budget, int) else int(total * budget)
    # A row for each leaf. Written tables have a known size, so a join with them broadcasts them if
    # they are small, and splits skewed leaves if they are not.
    budgets = written(leaf_budgets(leaves, goal, epochs, tuple(keys)).select(
        *keys, F.expr("budget div greatest(tokens, 1)").alias("whole"), (F.col("budget") % F.greatest("tokens", F.lit(1))).alias("rest")), "budgets")
    buckets = max(256, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _joined(rows.drop("weight"), budgets, keys, "inner").where("whole > 0 or rest > 0")
    rows = rows.withColumn("order", order_key(seed, F.col("whole"), F.col("id")))
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)))
    sums = rows.where("rest > 0").groupBy(*keys, "bucket").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
    # One row for each leaf and bucket: as many as the leaves, not as their documents.
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket"))
    ends = written(sums.withColumn("upto", upto).where("upto - n < rest").groupBy(*keys)
                   .agg(F.max("bucket").alias("end"), F.max_by(F.col("rest") - F.col("upto") + F.col("n"), "bucket").alias("within")), "ends")
    rows = _joined(rows, ends, keys, "left")
    chosen = [f"c{i}" for i in range(len(names))] + ["n_tokens"]
    # A document that the prefix takes as well comes once more than there are whole epochs.
    times = F.col("whole").cast("int") + F.coalesce((F.col("bucket") < F.col("end")).cast("int"), F.lit(0))
    sure = rows.where(times > 0).select(*chosen, F.explode(F.sequence(F.lit(0), times - 1)).alias("epoch"))
    order = Window.partitionBy(*keys).orderBy("order", F.asc_nulls_first("id"), "tie").rowsBetween(Window.unboundedPreceding, -1)
    last = (rows.where("bucket = end").withColumn("begin", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
            .where("begin < within").select(*chosen, F.col("whole").cast("int").alias("epoch")))
    return sure.unionByName(last).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "epoch", "n_tokens")
