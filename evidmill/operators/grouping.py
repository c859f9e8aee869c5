"""Skew-safe building blocks: two-step roll-ups and a distributed row index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from evidmill.session import settle

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}

# Rows of one ordered group that a single window task may hold.
BLOCK_ROWS = 1 << 20


def roll_up(df: DataFrame, keys: list[str], partials: dict[str, tuple[str, Column]]) -> DataFrame:
    """Aggregate partials by ``keys``; partial aggregation combines before the shuffle."""
    return df.groupBy(*keys).agg(*[_MERGE[how](col).alias(n) for n, (how, col) in partials.items()])


def per_group(
    runs: DataFrame, child: DataFrame, partials: dict[str, tuple[str, Column]], key: str = "run_group"
) -> DataFrame:
    """Partials of a child table per run group.

    Children are combined per run first, so the join with ``runs`` and the shuffle
    on the group see one row per run, not one per child row.
    """
    per_run = roll_up(child, ["run_id"], partials)
    joined = runs.select("id", key).join(per_run, F.col("id") == F.col("run_id"), "left")
    out = joined.groupBy(key).agg(
        *[_MERGE[how](F.col(n)).alias(n) for n, (how, _) in partials.items()]
    )
    zero = [
        F.coalesce(F.col(n), F.lit(0)).alias(n) if how == "sum" else F.col(n)
        for n, (how, _) in partials.items()
    ]
    return out.select(key, *zero)


def global_index(df: DataFrame, order: list[Column], name: str = "index", start: int = 0) -> DataFrame:
    """Number the rows of ``df`` in a total order without a single-task window.

    ``order`` must be a total order. Rows are range-partitioned and sorted, the
    result is settled once (so a lost executor cannot change the range bounds), and
    per-partition counts give the offsets. A value that repeats often is still
    split, because the whole order key decides the range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    slot = F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition: the window below runs over the partition count only.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_base") + slot + start)
        .drop("_part", "_base", "_at")
    )


def carry_forward(
    df: DataFrame, keys: list[str], index: str, value: Column, name: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Running maximum of ``value`` in ``index`` order within ``keys``.

    A group is cut into blocks of ``block_rows`` index positions: a window runs per
    (group, block) and the block maxima, far fewer, carry the value across blocks.
    """
    cut = df.withColumn("_block", F.floor(F.col(index) / block_rows)).withColumn("_value", value)
    blocks = cut.groupBy(*keys, "_block").agg(F.max("_value").alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "_block", F.max("_top").over(earlier).alias("_carried"))
    inside = Window.partitionBy(*keys, "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn("_inside", F.max("_value").over(inside))
        .join(carried, [*keys, "_block"])
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_block", "_value", "_inside", "_carried")
    )


def next_value(
    df: DataFrame, index: str, value: Column, name: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Smallest ``value`` at a later ``index`` position, computed block by block.

    Positions are read backwards: Spark adds a row to a frame that grows, and starts over for one that shrinks.
    """
    cut = df.withColumn("_block", F.floor(F.col(index) / block_rows)).withColumn("_value", value)
    blocks = cut.groupBy("_block").agg(F.min("_value").alias("_low"))
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("_block", F.min("_low").over(later).alias("_carried"))
    inside = Window.partitionBy("_block").orderBy(F.desc(index)).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_inside", F.min("_value").over(inside))
        .join(carried, "_block")
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_block", "_value", "_inside", "_carried")
    )


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row per key as one aggregate (``max_by``), never a sorted group.

    ``order`` columns must not need NULL handling beyond NULLs sorting first.
    """
    rank = F.struct(*[F.struct(c.isNotNull().alias("has"), c.alias("v")) for c in order])
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, "_row.*")
