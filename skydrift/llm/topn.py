"""The N best items of each of millions of groups, by bisecting all groups at the same time.

(score, identifier) is written as an order-preserving code: a list of 56-bit words, the greater the better.
Each pass divides every open group's interval of codes into 2**STEPS cells, that is STEPS bisections at
once, and counts the rows per cell; the cell in which the N-th row falls is the next interval. A pass
shuffles one count per group, cell and map task. Rows outside the interval leave the working set, so no
group is ever sorted or collected, however many rows it has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skydrift.tables import discard, materialize

#: Bisections per pass, and bits of a code word.
STEPS, BITS = 6, 56
#: A group with more than one of so many parts of all rows is spread over as many keys where rows meet the state of their group.
PARTS = 32


@F.pandas_udf(T.LongType())
def sortable_bits(score: pd.Series) -> pd.Series:
    """The bits of a double as an integer that sorts as the double does; -0.0 counts as 0.0."""
    bits = (score.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, ~bits ^ np.int64(-(2**63)), bits))


def with_code(df: DataFrame, score: str, ident: str, code: str = "code") -> DataFrame:
    """Adds the code of (score descending, ident ascending as UTF-8 text).

    Two words hold the score, then come the bytes of the identifier, seven to a word and counted downwards;
    a word that begins past the end of the identifier is left out, so that a prefix ranks before what it begins.
    """
    top = 1 << BITS
    bits = sortable_bits(F.col(score).cast("double"))
    raw = F.hex(F.encode(F.col(ident), "UTF-8"))
    words = F.transform(
        F.sequence(F.lit(0), F.floor((F.length("_hex") - 1) / 14)),
        lambda i: F.lit(top) - 1 - F.conv(F.rpad(F.substring(F.col("_hex"), i * 14 + 1, F.lit(14)), 14, "0"), 16, 10).cast("long"),
    )
    # Identifiers may end in zero bytes: the number of bytes settles what padding would hide.
    return (
        df.withColumn("_bits", bits).withColumn("_hex", raw)
        .withColumn(code, F.concat(
            F.array(F.shiftright("_bits", 8) + (top >> 1), F.col("_bits").bitwiseAND(255)),
            F.when(F.length("_hex") == 0, F.array(F.lit(top - 1))).otherwise(words),
            F.array(F.lit(top - 1) - F.length("_hex")),
        )).drop("_bits", "_hex")
    )


def hot_groups(coded: DataFrame, group: str) -> list:
    """Groups with more than one in PARTS of all rows: fewer than PARTS."""
    counts = materialize(coded.groupBy(group).agg(F.count(F.lit(1)).alias("rows")))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    return [r[0] for r in counts.where(F.col("rows") * PARTS > total).select(group).collect()]


def _spread(group: str, hot: list, part: Column) -> Column:
    return F.when(F.col(group).isin(hot), part).otherwise(F.lit(0)) if hot else F.lit(0)


def with_part(rows: DataFrame, group: str, hot: list) -> DataFrame:
    """Adds the part of its group that each row goes to."""
    return rows.withColumn("_part", _spread(group, hot, F.pmod(F.xxhash64("code"), F.lit(PARTS)).cast("int")))


def for_parts(state: DataFrame, group: str, hot: list) -> DataFrame:
    """The state of a group once for each of its parts."""
    last = _spread(group, hot, F.lit(PARTS - 1))
    return state.withColumn("_part", F.explode(F.sequence(F.lit(0), last)))


def cutoffs(coded: DataFrame, group: str, n: int, hot: list = ()) -> DataFrame:
    """Per group the code at and above which exactly min(n, rows) rows lie; codes are distinct within a group.

    Columns: group, ``cut`` (a prefix of a code; a code is at or above it if it is not less as an array). hot: groups to be spread.
    """
    def word(i):
        return F.element_at("code", (i + 1).cast("int"))

    w0 = F.element_at("code", 1)
    state = materialize(
        coded.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.min(w0).alias("lo"), F.max(w0).alias("hi"))
        .select(group, F.lit(n).cast("long").alias("need"), "lo", "hi", F.array().cast("array<bigint>").alias("prefix"),
                F.when(F.col("rows") <= n, F.array().cast("array<bigint>")).alias("cut"))
    )
    done = [state.where("cut is not null").select(group, "cut")]
    rows = with_part(coded.select(group, "code"), group, hot)
    while True:
        open_ = state.where("cut is null").drop("cut")
        if open_.isEmpty():
            break
        # Rows still in their group's interval.
        depth = F.size("prefix")
        active = (
            rows.join(for_parts(open_, group, hot), [group, "_part"])
            .where((F.slice("code", F.lit(1), depth) == F.col("prefix")) & word(depth).between(F.col("lo"), F.col("hi")))
            .select(group, "_part", "code", "need", "lo", "hi", "prefix")
        )
        active = materialize(active)
        w, after = word(F.size("prefix")), F.try_element_at("code", F.size("prefix") + 2)
        cells = (
            active.withColumn("cell", F.expr(f"(element_at(code, size(prefix) + 1) - lo) div ((hi - lo) div {1 << STEPS} + 1)"))
            .groupBy(group, "cell")
            .agg(F.count(F.lit(1)).alias("rows"), F.min(w).alias("min"), F.max(w).alias("max"),
                 F.min(after).alias("min2"), F.max(after).alias("max2"), F.first("need").alias("need"),
                 F.first("lo").alias("lo0"), F.first("prefix").alias("prefix"))
        )
        # At most 2**STEPS cells a group.
        above = F.sum("rows").over(Window.partitionBy(group).orderBy(F.desc("cell")))
        hit = cells.withColumn("upto", above).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("rows") < F.col("need")))
        one = F.col("min") == F.col("max")
        exact = F.col("upto") == F.col("need")
        state = materialize(hit.select(
            group,
            (F.col("need") - F.col("upto") + F.col("rows")).alias("need"),
            F.when(one, F.col("min2")).otherwise(F.col("min")).alias("lo"),
            F.when(one, F.col("max2")).otherwise(F.col("max")).alias("hi"),
            F.when(one, F.concat("prefix", F.array("min"))).otherwise(F.col("prefix")).alias("prefix"),
            F.when(exact, F.concat("prefix", F.array("min"))).alias("cut"),
        ))
        done.append(state.where("cut is not null").select(group, "cut"))
        discard(rows)
        rows = active.select(group, "_part", "code")
        rows._skydrift_path = active._skydrift_path
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def top_n(df: DataFrame, group: str, score: str, ident: str, n: int) -> DataFrame:
    """The n rows of each group with the highest score, ties by the identifier ascending as text.

    Rows with a null group or identifier, or a score that is null, NaN or infinite, are left out. Repeated
    rows (same group, score and identifier) count once. A group of fewer than n rows is kept whole; an empty
    table gives no rows. Columns: group, ident, score.
    """
    s = F.col(score).cast("double")
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    rows = df.where(finite & F.col(group).isNotNull() & F.col(ident).isNotNull()).groupBy(group, s.alias(score), ident).agg(F.lit(1))
    coded = materialize(with_code(rows.select(group, score, ident), score, ident))
    hot = hot_groups(coded, group)
    cuts = for_parts(cutoffs(coded, group, n, hot), group, hot)
    return with_part(coded, group, hot).join(cuts, [group, "_part"]).where(F.col("code") >= F.col("cut")).select(group, ident, score)


def latest_versions(events: DataFrame) -> DataFrame:
    """Of each event the row with the latest ingested_at (null earliest): event_id, obs_id, score, freq_hz, row0."""
    keep = ["obs_id", "score", "freq_hz", "row0"]
    last = events.groupBy("event_id").agg(F.max(F.struct("ingested_at", *keep)).alias("m"))
    return last.select("event_id", *[F.col(f"m.{c}").alias(c) for c in keep])
