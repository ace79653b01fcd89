"""Ordered greedy choices without an ordered pass.

"Take items in order, skip what an earlier taken one excludes" has one result, and it can be found in rounds: an item is
taken once no earlier undecided item excludes it, and every item that a taken one excludes is out. A round is a few
joins; only chains of exclusions need several rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skydrift.tables import discard, materialize


def first_come(conflicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(taken, out) identifiers among those in ``conflicts`` (before, after): before comes first and excludes after if taken.

    Items without a conflict are in neither table: they are taken. The order must be acyclic. Null pairs are left out.
    """
    edges = materialize(conflicts.where("before is not null and after is not null and before <> after").select("before", "after").distinct())
    taken, out = [], []
    while not edges.isEmpty():
        free = materialize(edges.select(F.col("before").alias("id")).distinct().join(
            edges.select(F.col("after").alias("id")), "id", "left_anti"))
        lost = materialize(edges.join(free, edges["before"] == free["id"], "left_semi").select(F.col("after").alias("id")).distinct())
        gone = free.select("id").union(lost.select("id"))
        rest = edges.join(gone, edges["before"] == gone["id"], "left_anti").join(lost, edges["after"] == lost["id"], "left_anti")
        # What only waited for those that are out is free now, though it may have no conflict left: it is taken.
        waiting = edges.select(F.col("after").alias("id")).distinct().join(gone, "id", "left_anti")
        rest = materialize(rest)
        left = rest.select(F.col("before").alias("id")).union(rest.select(F.col("after").alias("id"))).distinct()
        taken += [free, materialize(waiting.join(left, "id", "left_anti"))]
        heads = edges.select(F.col("before").alias("id")).distinct().join(gone, "id", "left_anti").join(left, "id", "left_anti")
        taken.append(materialize(heads))
        out.append(lost)
        discard(edges)
        edges = rest
    empty = edges.select(F.col("before").alias("id"))
    t, o = empty, empty
    for x in taken:
        t = t.union(x.select("id"))
    for x in out:
        o = o.union(x.select("id"))
    return t.distinct(), o.distinct()


def assign(pairs: DataFrame, left: str, right: str, order: list[str]) -> DataFrame:
    """One-to-one assignment: pairs in ascending ``order`` (a total order), each taken if neither side is in a taken pair.

    A pair that is the first of both its sides is taken at once; what shares a side with it drops out; and so on.
    """
    rest, done = materialize(pairs), []
    first = rest.limit(0)
    while not rest.isEmpty():
        key = F.struct(*order)
        a = rest.groupBy(left).agg(F.min(key).alias("ka"))
        b = rest.groupBy(right).agg(F.min(key).alias("kb"))
        now = materialize(rest.join(a, left).join(b, right).where((key == F.col("ka")) & (key == F.col("kb"))).select(*pairs.columns))
        done.append(now)
        after = materialize(rest.join(now.select(left), left, "left_anti").join(now.select(right), right, "left_anti"))
        discard(rest)
        rest = after
    out = first
    for d in done:
        out = out.unionByName(d)
    return out
