"""Building blocks that keep plans linear when one key holds a large part of the rows.

* ``cut_lineage`` writes an intermediate table to the shared checkpoint folder, so an iterative job neither grows its
  plan without bound nor loses its state with an executor.
* ``blocked`` / ``ranked`` / ``carried`` number and scan rows per key without putting a key into one task: rows are range
  partitioned on key *and* order, every partition works on its own part, and only one summary row per key and
  partition meets in a window.
* ``merged_if_large`` keeps Spark from a broadcast by its estimate of a table's size where that may be far too low.
* ``dealt`` bounds the rows of a task where rows, not bytes, decide its memory.
* ``percentiles`` are exact and come from a value histogram ranked that way.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = "_block"
ROWS_PER_TASK = 250_000


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only for local masters that name none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="zephra-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut_lineage(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and continue from the written table (in the session ``spark``, if given)."""
    spark = spark or df.sparkSession
    path = f"{checkpoint_root(spark)}/zephra-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Size check before a broadcast; reads no more than ``rows + 1`` rows."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """Broadcast hint behind a row check; otherwise the shuffle join (and AQE skew handling) stays in place."""
    return F.broadcast(df) if has_at_most(df, rows) else df


def merged_if_large(df: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """Merge-join hint for a table of more than ``rows`` rows; a smaller one is left to Catalyst.

    Catalyst knows a written table by the bytes of its compressed files and an explode by its input, so it may broadcast a
    table many times larger than its threshold; the driver would hold that twice.
    """
    return df if has_at_most(df, rows) else df.hint("merge")


def dealt(df: DataFrame, rows: int | None = None, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` over tasks of about ``per_task`` rows each, for work that makes much memory of few bytes.

    File splits and adaptive execution size tasks by bytes read, so a task of narrow rows could hold many millions. A table
    of at most ``per_task`` rows stays as it is. ``rows`` is its count, if known; otherwise it is counted.
    """
    n = df.count() if rows is None else rows
    if n <= per_task:
        return df
    return df.repartition(max(math.ceil(n / per_task), df.sparkSession.sparkContext.defaultParallelism))


def blocked(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range partition on ``keys + order`` and fix the partition number as ``_block``.

    The order columns are part of the range, so a key with a third of all rows spreads over a third of the blocks.
    No partition count is given: adaptive execution merges small neighbouring ranges, which keeps their order.
    The result is written before use: block numbers must not change between the two reads that follow.
    """
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn(BLOCK, F.spark_partition_id()))


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def _join_blocks(rows: DataFrame, per_block: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = [*keys, BLOCK]
    return rows.join(per_block, _same(rows, per_block, names), "left").drop(*[per_block[n] for n in names])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """1-based ``row_number`` per key; ``order`` must be unique within the key."""
    rows = blocked(df, keys, order)
    per_block = rows.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    base = per_block.select(*keys, BLOCK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    numbered = rows.withColumn("_rn", F.row_number().over(within))
    return _join_blocks(numbered, base, keys).withColumn(name, F.col("_rn") + F.col("_base")).drop("_rn", "_base", BLOCK)


def carried(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], lead: bool = False
) -> tuple[DataFrame, dict[str, str]]:
    """Blocked rows plus, per value column, the nearest non-NULL value of an earlier (or later) block.

    Returns the rows and the names of the carry columns; in-block windows combine with them.
    """
    rows = blocked(df, keys, order)
    at = F.struct(*order)
    pick = F.min_by if lead else F.max_by
    per_block = rows.groupBy(*keys, BLOCK).agg(
        *[pick(F.col(f"`{v}`"), F.when(F.col(f"`{v}`").isNotNull(), at)).alias(f"_in_{i}") for i, v in enumerate(values)]
    )
    span = Window.partitionBy(*keys).orderBy(BLOCK)
    if lead:
        span = span.rowsBetween(1, Window.unboundedFollowing)
        choose = F.first
    else:
        span = span.rowsBetween(Window.unboundedPreceding, -1)
        choose = F.last
    names = {v: f"_carry_{i}" for i, v in enumerate(values)}
    per_block = per_block.select(
        *keys, BLOCK, *[choose(f"_in_{i}", ignorenulls=True).over(span).alias(f"_carry_{i}") for i in range(len(values))]
    )
    return _join_blocks(rows, per_block, keys), names


def percentiles(df: DataFrame, value: str, points: dict[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation percentiles per group, one column per entry of ``points``."""
    groups = list(groups)
    hist = (
        df.select(*groups, F.col(f"`{value}`").alias("_v"))
        .filter(F.col("_v").isNotNull())
        .groupBy(*groups, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    rows = blocked(hist, groups, ["_v"])
    per_block = rows.groupBy(*groups, BLOCK).agg(F.sum("_c").alias("_n"))
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    base = per_block.select(
        *groups,
        BLOCK,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
        F.sum("_n").over(whole).alias("_total"),
    )
    running = Window.partitionBy(*groups, BLOCK).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = _join_blocks(rows.withColumn("_run", F.sum("_c").over(running)), base, groups).withColumn(
        "_end", F.col("_base") + F.col("_run")
    )
    aggs = []
    for i, p in enumerate(points.values()):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (pos < F.col("_end")) & (pos >= F.col("_end") - F.col("_c"))
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}{i}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_t{i}"))
    out = placed.groupBy(*groups).agg(*aggs)
    return out.select(
        *groups,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_t{i}")).alias(n)
            for i, n in enumerate(points)
        ],
    )
