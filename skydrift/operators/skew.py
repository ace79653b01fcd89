"""Per-key results when a handful of keys holds most rows.

Every aggregate here is algebraic: a task folds its own rows into one small state per key (Spark's
partial aggregation, a bounded hash or sort table that spills), and only those states are shuffled.
A key with a third of all rows then costs the reducer one state per map task, not a third of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def key_counts(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Rows per key with ``low <= key <= high``, and the rows of the whole table as ``total``.

    Keys outside the range, and nulls, are counted together under a null key, so that the result has at
    most ``high - low + 2`` rows whatever the data hold.
    """
    valid = F.when(F.col(key).between(low, high), F.col(key))
    counts = df.select(valid.alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))


def heavy_keys(df: DataFrame, key: str, low: int, high: int, share: int) -> DataFrame:
    """Keys holding more than one ``share``-th of all rows: fewer than ``share`` rows, hence small enough
    to broadcast by construction."""
    counts = key_counts(df, key, low, high)
    return counts.where(F.col(key).isNotNull() & (F.col("n") * share > F.col("total"))).select(key, "n", "total")


def best_per_key(df: DataFrame, keys: list[str], score: str, ident: str) -> DataFrame:
    """The row with the highest ``score`` of each key, ties by the lowest ``ident``.

    Null and NaN scores rank lowest. The state per key is one (score, ident) pair, merged before the shuffle.
    """
    s = F.when(~F.isnan(score), F.col(score).cast("double"))
    best = F.max(F.struct(s.alias("s"), (-F.col(ident)).alias("i")))
    out = df.groupBy(*keys).agg(best.alias("b"), F.count(F.lit(1)).alias("n_rows"))
    return out.select(*keys, (-F.col("b.i")).alias(ident), F.col("b.s").alias(score), "n_rows")


def heavy_key_best(df: DataFrame, key: str, sub: str, score: str, ident: str,
                   low: int = 0, high: int = 255, share: int = 50) -> DataFrame:
    """For each heavy key and each ``sub`` value under it the best row.

    Null ``sub`` values belong to no group and are left out; every other row counts. An empty table gives
    no rows. Columns: key, sub, ident, score, n_rows.
    """
    heavy = F.broadcast(heavy_keys(df, key, low, high, share).select(key))
    rows = df.select(key, sub, score, ident).where(F.col(sub).isNotNull())
    return best_per_key(rows.join(heavy, key, "left_semi"), [key, sub], score, ident)
