"""Connected components of a table of links, by alternating star contraction on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skydrift.tables import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between identifiers to (node, root): root is the smallest identifier that node is linked
    to by any path. Self-links, repeated links and links with a null change nothing; a node without a link
    has no row.

    Every round hangs the neighbours of a node under the smallest of them, first the greater ones (large
    star), then the others (small star); the number of rounds grows with the logarithm of the longest path.
    A round's links are written to the shared folder, and rounds end when the links stay the same.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, print_ = materialize(e), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")
        ).select("x.*").where("u <> v").distinct()
        after = materialize(small)
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == print_:
            break
        discard(e)
        e, print_ = after, now
    return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        after.select("v", "v").distinct())
