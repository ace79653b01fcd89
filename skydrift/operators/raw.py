"""Raw recordings: words, axes, segments and tiles. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skydrift.functions import exprs as X
from skydrift.params import Contract


def filename_metadata(df: DataFrame, path: str) -> DataFrame:
    """Fields of names like software_source_band_receiver_beam.dat; null where a name has fewer parts."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    p = F.split(stem, "_")
    part = lambda n: F.when(F.size(p) >= 5, F.element_at(p, n))
    return df.withColumns({"software": part(1), "source": part(2), "band_label": part(3), "receiver": part(4),
                           "beam_1based": F.when(part(5).rlike(r"^\d+$"), part(5).cast("int"))})


def channel_axis(observations: DataFrame, contract: Contract) -> DataFrame:
    """(obs_id, channel, mode, center_hz): absolute if both lo_hz and start_coarse_channel are known, else relative."""
    known = F.col("lo_hz").isNotNull() & F.col("start_coarse_channel").isNotNull()
    c = F.col("channel")
    center = F.when(known, F.col("lo_hz") + (F.col("start_coarse_channel") + c) * F.lit(contract.df_hz)).otherwise(c * F.lit(contract.df_hz))
    rows = observations.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(contract.channels - 1))))
    return rows.select("obs_id", "channel", F.when(known, "absolute").otherwise("relative").alias("mode"), center.alias("center_hz"))


def stitch(observations: DataFrame) -> DataFrame:
    """(obs_id, seg_idx, path, rows, row_start, row_stop) of the files of each observation in their order.

    Running totals are taken inside the observation's own arrays, so nothing is shuffled. A null or empty list gives no rows.
    """
    start = F.aggregate(F.slice("segment_rows", 1, F.col("seg_idx")), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = observations.select("obs_id", "segment_rows", F.posexplode(F.arrays_zip("dat_paths", "segment_rows")).alias("seg_idx", "s"))
    rows = rows.select("obs_id", "seg_idx", F.col("s.dat_paths").alias("path"), F.col("s.segment_rows").alias("rows"), start.alias("row_start"))
    return rows.withColumn("row_stop", F.col("row_start") + F.col("rows"))


def interval_read(segments: DataFrame, requests: DataFrame) -> DataFrame:
    """Parts of files to read for requests (obs_id, row0, row1 and others): requests' columns, path, file_row0, file_row1.

    Segments of an observation are few, so the equi-join on obs_id bounds the pairs; empty or reversed requests read nothing.
    """
    seg = segments.select("obs_id", "seg_idx", "path", "row_start", "row_stop")
    hit = requests.join(seg, "obs_id").where((F.col("row_start") < F.col("row1")) & (F.col("row_stop") > F.col("row0")) & (F.col("row1") > F.col("row0")))
    return hit.withColumns({"file_row0": F.greatest("row0", "row_start") - F.col("row_start"),
                            "file_row1": F.least("row1", "row_stop") - F.col("row_start")}).drop("row_start", "row_stop")


def tile_plan(observations: DataFrame, tile_rows: int, overlap: int) -> DataFrame:
    """(obs_id, tile, row0, row1): overlapping tiles; the last is cut at the end. No rows for an empty observation."""
    step = max(1, tile_rows - overlap)
    last = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("n_rows") - tile_rows) / step))
    t = observations.where("n_rows > 0").select("obs_id", "n_rows", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("tile"))
    row0 = F.col("tile") * step
    return t.select("obs_id", "tile", row0.alias("row0"), F.least(row0 + tile_rows, F.col("n_rows")).alias("row1"))


def select_channels(df: DataFrame, channel: str, low: int | None, high: int | None, chosen: tuple[int, ...] | None) -> DataFrame:
    """Rows of the wanted channels; a condition on the column, so it is pushed to the scan."""
    cond: Column = F.lit(True)
    if low is not None:
        cond = cond & (F.col(channel) >= low)
    if high is not None:
        cond = cond & (F.col(channel) <= high)
    if chosen is not None:
        cond = cond & F.col(channel).isin(list(dict.fromkeys(chosen)))
    return df.where(cond)


def decode(df: DataFrame, word: str) -> DataFrame:
    """Adds i and q of a 16-bit word."""
    return df.withColumns({"i": X.word_i(F.col(word)), "q": X.word_q(F.col(word))})
