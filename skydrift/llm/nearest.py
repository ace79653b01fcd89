"""Pairing each row with the nearest row in time of the same entity and line, within a tolerance.

Right rows get nearest-neighbour intervals, bounded by the midpoints to their neighbours and by the
tolerance; left times are range-joined with them through an index of equi-join keys (entity, frequency
bucket, time bucket). Since a left row has a frequency window of its own width, neighbours are taken per
frequency bucket, on a grid a fraction of the window wide. In buckets wholly inside the window the nearest
of the bucket is all that matters; the two buckets that the window cuts are matched by the tolerance and
each pair is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skydrift.tables import materialize

#: Length of a time segment within which neighbours are sought, in tolerances.
SEGMENT = 32
#: Widening of the intervals against rounding; the exact test follows.
SLACK = 1e-6


def _grid(tol):
    """Width of the buckets for a window of +-tol: a power of two between tol/8 and tol/4 (at least 2**-10)."""
    return F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(tol, F.lit(1e-9)) / 4)), F.lit(-10)).cast("double"))


def nearest_in_time(left: DataFrame, right: DataFrame, within: float) -> DataFrame:
    """For each left row the right row of the same entity, within its frequency tolerance, nearest in time.

    left: id, entity, t, freq, tol; right: rid, entity, t, freq. Rows with a null or NaN among these can't be
    paired; a negative tolerance pairs nothing. Times may differ by ``within`` at most, inclusive; ties go to
    the smaller rid. Repeated left rows count once, repeated right rows change nothing. One row per left id
    that has a partner: id, rid, dt.
    """
    def whole(df, names):
        for n in names:
            df = df.where(F.col(n).isNotNull())
            if n in ("t", "freq", "tol"):
                df = df.where(~F.isnan(n))
        return df

    probe = whole(left, ["id", "entity", "t", "freq", "tol"]).where("tol >= 0").dropDuplicates(["id"]).withColumn("w", _grid(F.col("tol")))
    first, last = F.floor((F.col("freq") - F.col("tol")) / F.col("w")), F.floor((F.col("freq") + F.col("tol")) / F.col("w"))
    probes = (
        probe.withColumn("first", first).withColumn("last", last)
        .withColumn("bucket", F.explode(F.sequence("first", "last")))
        .withColumn("inside", (F.col("bucket") > F.col("first")) & (F.col("bucket") < F.col("last")))
        .withColumn("tb", F.floor(F.col("t") / (2 * within)))
        .select("id", "entity", "t", "freq", "tol", "w", "bucket", "inside", "tb")
    )
    # Right rows are indexed by the widths that their entity is asked for, and in buckets that some window touches.
    widths = probe.groupBy("entity").agg(F.collect_set("w").alias("ws"))
    ev = whole(right, ["rid", "entity", "t", "freq"]).groupBy("entity", "t", "freq").agg(F.min("rid").alias("rid"))
    ev = ev.join(widths, "entity").withColumn("w", F.explode("ws")).drop("ws").withColumn("bucket", F.floor(F.col("freq") / F.col("w")))
    ev = materialize(ev.join(probes.select("entity", "w", "bucket").distinct(), ["entity", "w", "bucket"], "left_semi"))  # read twice

    # Nearest-neighbour intervals, found within segments of time that overlap by twice the tolerance.
    seg = within * SEGMENT
    home = F.floor(F.col("t") / seg)
    pooled = ev.groupBy("entity", "w", "bucket", "t").agg(F.min(F.struct("rid", "freq")).alias("e"))
    halo = pooled.withColumn("seg", F.explode(F.array_distinct(F.array(
        home, F.floor((F.col("t") - 2 * within) / seg), F.floor((F.col("t") + 2 * within) / seg)))))
    line = Window.partitionBy("entity", "w", "bucket", "seg").orderBy("t")
    inner = (
        halo.withColumn("prev", F.lag("t").over(line)).withColumn("next", F.lead("t").over(line)).where(F.col("seg") == home)
        .select("entity", "w", "bucket", F.col("e.rid").alias("rid"), F.col("e.freq").alias("rfreq"), F.col("t").alias("rt"),
                F.greatest(F.col("t") - within, (F.col("prev") + F.col("t")) / 2).alias("lo"),
                F.least(F.col("t") + within, (F.col("t") + F.col("next")) / 2).alias("hi"),
                F.lit(True).alias("inside"))
    )
    cut = ev.select("entity", "w", "bucket", "rid", F.col("freq").alias("rfreq"), F.col("t").alias("rt"),
                    (F.col("t") - within).alias("lo"), (F.col("t") + within).alias("hi"), F.lit(False).alias("inside"))
    index = inner.unionByName(cut).withColumn("lo", F.col("lo") - SLACK).withColumn("hi", F.col("hi") + SLACK)
    # An interval is at most 2 * within long, hence in two time buckets or three.
    index = index.withColumn("tb", F.explode(F.sequence(F.floor(F.col("lo") / (2 * within)), F.floor(F.col("hi") / (2 * within)))))

    pairs = probes.join(index, ["entity", "w", "bucket", "inside", "tb"]).where(F.col("t").between(F.col("lo"), F.col("hi")))
    dt = F.abs(F.col("t") - F.col("rt"))
    fits = pairs.where((dt <= within) & (F.abs(F.col("rfreq") - F.col("freq")) <= F.col("tol")))
    best = fits.groupBy("id").agg(F.min(F.struct(dt.alias("dt"), F.col("rid"))).alias("b"))
    return best.select("id", F.col("b.rid").alias("rid"), F.col("b.dt").alias("dt"))
