"""Order-dependent values over entities of any size.

A window partitioned by entity puts one entity into one task. Here rows are range-partitioned by (entity, order), so that a
large entity spans several blocks, and what a block needs of the blocks before it is carried over by a summary with one row
for each entity and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import written

BLOCK = "_cv_block"


def ordered_blocks(df: DataFrame, entity: str, order: list[Column], partitions: int | None = None) -> DataFrame:
    """``df`` with BLOCK: blocks follow each other in (entity, order); one block holds about rows / partitions rows.

    The result is a written table, because a block number must not change when a task is run again.
    """
    keys = [F.col(entity).asc(), *order]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return written(ranged.withColumn(BLOCK, F.spark_partition_id()))


def in_block(entity: str, order: list[Column]) -> Window:
    return Window.partitionBy(BLOCK, entity).orderBy(*order)


def _joined(rows: DataFrame, summary: DataFrame, entity: str, extra: list[Column], keep: list[str]) -> DataFrame:
    """``rows`` with the columns ``keep`` of the summary of their entity and block; null entities meet null entities."""
    side = summary.select(F.col(entity).alias("_cv_e"), F.col(BLOCK).alias("_cv_b"), *keep)
    return rows.join(side, rows[entity].eqNullSafe(side["_cv_e"]) & (rows[BLOCK] == side["_cv_b"])).select(*extra)


def running_sum(df: DataFrame, entity: str, order: list[Column], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the entity before this one; ``out``_total: over all its rows.

    Nulls in ``value`` count as 0. The order must be total. Rows of a null entity form an entity of their own.
    """
    blocks = ordered_blocks(df, entity, order)
    v = F.coalesce(F.col(value), F.lit(0))
    w = Window.partitionBy(entity).orderBy(BLOCK)
    sums = blocks.groupBy(entity, BLOCK).agg(F.sum(v).alias("_cv_sum"))
    sums = sums.select("*", (F.sum("_cv_sum").over(w) - F.col("_cv_sum")).alias("_cv_before"), F.sum("_cv_sum").over(Window.partitionBy(entity)).alias("_cv_total"))
    inner = F.sum(v).over(in_block(entity, order).rowsBetween(Window.unboundedPreceding, -1))
    rows = blocks.withColumn("_cv_in", F.coalesce(inner, F.lit(0)))
    columns = [F.col(c) for c in df.columns] + [(F.col("_cv_in") + F.col("_cv_before")).alias(out), F.col("_cv_total").alias(f"{out}_total")]
    return _joined(rows, sums, entity, columns, ["_cv_before", "_cv_total"])


def previous_rows(df: DataFrame, entity: str, order: list[Column], columns: list[str], count: int = 1, out: str = "previous") -> DataFrame:
    """``out``: the structs of ``columns`` of the last ``count`` rows of the entity before this one, the nearest first.

    What a lag gives, without putting an entity into one task: the last ``count`` rows of each block go on to the next.
    The order must be total; ``columns`` are enough to tell rows apart. Blocks shorter than ``count`` pass on what they got.
    """
    blocks = ordered_blocks(df, entity, order)
    w = in_block(entity, order)
    own = F.struct(*columns)
    lags = F.filter(F.array(*[F.lag(own, i).over(w) for i in range(1, count + 1)]), lambda x: x.isNotNull())
    numbered = blocks.withColumn("_cv_n", F.row_number().over(w)).withColumn("_cv_lags", lags)
    size = blocks.groupBy(entity, BLOCK).agg(F.count(F.lit(1)).alias("_cv_size"))
    sized = _joined(numbered, size, entity, [numbered["*"], F.col("_cv_size")], ["_cv_size"])
    # The last rows of a block, nearest first, are its last row and that row's lags.
    tails = sized.where(F.col("_cv_n") == F.col("_cv_size")).select(entity, BLOCK, F.slice(F.concat(F.array(own), F.col("_cv_lags")), 1, count).alias("_cv_tail"))
    by = Window.partitionBy(entity).orderBy(BLOCK)
    # Short blocks: the tails of up to ``count`` blocks before hold ``count`` rows at least, if there are as many.
    before = F.flatten(F.filter(F.array(*[F.lag("_cv_tail", i).over(by) for i in range(1, count + 1)]), lambda x: x.isNotNull()))
    carried = tails.select(entity, BLOCK, F.slice(before, 1, count).alias("_cv_carried"))
    columns_out = [F.col(c) for c in df.columns] + [F.slice(F.concat("_cv_lags", "_cv_carried"), 1, count).alias(out)]
    return _joined(numbered, carried, entity, columns_out, ["_cv_carried"])
