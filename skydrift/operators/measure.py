"""Measurement of events on spectrograms: local signal-to-noise, cutouts and aligned profiles.

A spectrogram row is (keys, frame, power array). Rows are joined with their event; sums along a frame are folds in the
row, and only what needs a median over frames is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skydrift.functions import exprs as X
from skydrift.params import Contract, Measurement


def enbw_bins(nfft: int, kind: str) -> float:
    """Equivalent noise bandwidth of a window, in bins."""
    from skydrift.operators.spectra import window_values

    w = window_values(nfft, kind)
    return float(nfft * (w**2).sum() / w.sum() ** 2) if abs(w.sum()) > 1e-12 else 1.0


def snap_bias(half: int, statistic: str) -> float:
    """Expected brightest of the bins that a snap chooses from, over the noise statistic."""
    if half <= 0:
        return 1.0
    mean = sum(1.0 / k for k in range(1, 2 * half + 2))
    return mean if statistic == "mean" else mean / 0.6931471805599453


def ridge_width(width_hz: Column, event_bins: Column, df_hz: float, cfg: Measurement) -> Column:
    """Bins of a ridge: the true width where known and positive, else the event's, within limits."""
    w = F.when(width_hz > 0, F.ceil(width_hz / df_hz)).otherwise(F.coalesce(event_bins, F.lit(cfg.min_ridge_bins)))
    return F.greatest(F.lit(cfg.min_ridge_bins), F.least(F.lit(cfg.max_ridge_bins), w)).cast("int")


def choose_channel(representative: Column, freq: Column, lo_hz: Column, start_channel: Column, contract: Contract) -> Column:
    """Channel in which an event is measured: its representative one if in range, else the nearest to its frequency, else the middle."""
    at = F.ceil((freq - lo_hz) / F.lit(contract.df_hz) - start_channel - 0.5)
    near = F.greatest(F.lit(0), F.least(F.lit(contract.channels - 1), at))
    return F.coalesce(F.when(representative.between(0, contract.channels - 1), representative), near, F.lit(contract.channels // 2)).cast("int")


def nearest_bin(x: Column, n: Column) -> Column:
    """Bin nearest to a place in bins, the lower on ties, within 0..n-1."""
    return F.greatest(F.lit(0), F.least(n - 1, F.ceil(x - 0.5))).cast("int")


def _cut(a: str, lo: Column, hi: Column) -> Column:
    """Elements lo..hi-1 of an array column; empty if hi <= lo."""
    return F.slice(a, lo + 1, F.greatest(F.lit(0), hi - lo))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def local_snr(frames: DataFrame, events: DataFrame, keys: list[str], cfg: Measurement, enbw: float) -> DataFrame:
    """Ridge and background of each event, and its mean excess in dB.

    frames: keys, frame, power. events: keys, at (place in bins of the track in frame 0), slope (bins per frame), ridge
    (bins). The background is up to bg_half_width_bins on both sides without ridge and guard; if it has too few pixels it is
    widened to half the channel. Where it still has too few, or the noise isn't positive, the results are null, with the
    reason in ``warning``; a ratio that isn't positive is null as well. Events without frames have no row.
    """
    n = F.size("power")
    f = frames.join(events.where("at is not null"), keys).withColumn("n", n)
    f = f.withColumn("c", nearest_bin(F.col("at") + F.col("slope") * F.col("frame"), F.col("n")))
    s = cfg.ridge_snap_half_width_bins
    if s > 0:
        lo, hi = F.greatest(F.lit(0), F.col("c") - s), F.least(F.col("n"), F.col("c") + s + 1)
        near = _cut("power", lo, hi)
        f = f.withColumn("c", (lo + F.array_position(near, F.array_max(near)) - 1).cast("int"))
    half = F.floor((F.col("ridge") - 1) / 2).cast("int")
    f = f.withColumns({"r0": F.greatest(F.lit(0), F.col("c") - half), "r1": F.least(F.col("n"), F.col("c") + F.col("ridge") - half)})

    def background(reach: Column) -> Column:
        b0, b1 = F.greatest(F.lit(0), F.col("c") - reach), F.least(F.col("n"), F.col("c") + reach + 1)
        g0, g1 = F.greatest(F.lit(0), F.col("r0") - cfg.guard_bins), F.least(F.col("n"), F.col("r1") + cfg.guard_bins)
        return F.concat(_cut("power", b0, F.greatest(b0, g0)), _cut("power", F.least(b1, g1), b1))

    reach = F.greatest(F.lit(cfg.bg_half_width_bins), F.lit(cfg.guard_bins) + F.col("ridge") + 4)
    f = f.withColumns({"r": _cut("power", F.col("r0"), F.col("r1")), "near": background(reach), "far": background((F.col("n") / 2).cast("int"))})
    sums = f.groupBy(*keys).agg(F.sum(_sum(F.col("r"))).alias("ridge_sum"), F.sum(F.size("r")).alias("ridge_count"), F.sum(F.size("near")).alias("n_near"),
                                F.sum(F.size("far")).alias("n_far"), F.count(F.lit(1)).alias("frames_used"))
    sums = sums.withColumn("expanded", F.col("n_near") < cfg.min_background_pixels)
    stat = (lambda c: F.avg(c)) if cfg.noise_statistic == "mean" else (lambda c: F.percentile(c, F.lit(0.5)))
    pixels = f.join(sums.select(*keys, "expanded"), keys).select(*keys, F.explode(F.when(F.col("expanded"), F.col("far")).otherwise(F.col("near"))).alias("p"))
    m = sums.join(pixels.groupBy(*keys).agg(stat("p").alias("noise")), keys, "left")
    count = F.when(F.col("expanded"), F.col("n_far")).otherwise(F.col("n_near"))
    few, bad = count < cfg.min_background_pixels, ~(F.col("noise") > 0)
    ok = ~few & ~F.coalesce(bad, F.lit(True)) & (F.col("ridge_count") > 0)
    floor = F.col("noise") * snap_bias(s, cfg.noise_statistic)
    mean = F.col("ridge_sum") / F.col("ridge_count")
    ratio = (mean - floor) / F.col("noise")
    warning = (F.when(F.col("ridge_count") == 0, "ridge mask contained no pixels").when(few, "insufficient background pixels")
               .when(F.coalesce(bad, F.lit(True)), "invalid non-positive noise floor")
               .otherwise(F.concat_ws("; ", F.when(F.col("expanded"), "background window expanded"), F.when(ratio <= 0, "non-positive signal excess"))))
    return m.select(*keys, F.when(ok, X.safe_db(ratio)).alias("ridge_pixel_snr_db"), F.when(ok, X.safe_db(ratio * enbw)).alias("band_excess_snr_db"),
                    F.when(ok, F.col("noise")).alias("noise_floor"), F.when(ok, mean).alias("mean_ridge_power"),
                    F.when(ok, (F.col("ridge_sum") - floor * F.col("ridge_count")) / F.col("frames_used")).alias("signal_excess_power"),
                    F.col("ridge_count").cast("int").alias("ridge_pixels"), count.cast("int").alias("background_pixels"), warning.alias("warning"))


def aligned_profile(bins: DataFrame, events: DataFrame, keys: list[str], half: int) -> DataFrame:
    """(keys, offset, ratio): mean over frames of linear power with each frame shifted so that the track is at offset 0.

    bins: keys, frame, bin, db; what a shift leaves without a bin is missing, not zero. events: keys, at, slope, n_bins.
    """
    half = max(4, half)
    b = bins.join(events, keys).withColumn("offset", F.col("bin") - nearest_bin(F.col("at") + F.col("slope") * F.col("frame"), F.col("n_bins")))
    return b.where(F.col("offset").between(-half, half)).groupBy(*keys, "offset").agg(F.avg(X.ratio(F.col("db"))).alias("ratio"))


def profile_evidence(profile: DataFrame, keys: list[str], guard: int, min_peak_db: float = 0.0, min_center_db: float = -3.0) -> DataFrame:
    """Peak and centre of an aligned profile against its background, and whether they are visible evidence.

    Background: the median outside +-guard. Peak: the greatest within it, the lowest offset on ties; centre: the mean of the
    middle three. Excess is null where there is none; without a positive background all is null.
    """
    guard = max(1, guard)
    inside, mid = F.abs("offset") <= guard, F.abs("offset") <= 1
    p = profile.groupBy(*keys).agg(
        F.percentile(F.when(~inside, F.col("ratio")), F.lit(0.5)).alias("bg"),
        F.max(F.when(inside, F.struct("ratio", (-F.col("offset")).alias("o")))).alias("peak"), F.avg(F.when(mid, F.col("ratio"))).alias("center"))
    p = p.withColumn("bg", F.when(F.col("bg") > 0, F.col("bg")))
    excess = lambda v: X.safe_db((v - F.col("bg")) / F.col("bg"))
    total = lambda v: 10 * F.log10(F.greatest(v / F.col("bg"), F.lit(1e-12)))
    peak, center = F.col("peak.ratio"), F.col("center")
    out = p.select(*keys, excess(peak).alias("peak_excess_db"), excess(center).alias("center_excess_db"), total(peak).alias("peak_total_db"),
                   total(center).alias("center_total_db"), F.when(F.col("bg").isNotNull(), -F.col("peak.o")).alias("peak_offset"), X.safe_db(F.col("bg")).alias("background_db"))
    seen = F.coalesce(F.col("peak_excess_db") >= min_peak_db, F.lit(False)) | F.coalesce(F.col("center_excess_db") >= min_center_db, F.lit(False))
    return out.withColumn("visual_evidence", seen)


def cutout(bins: DataFrame, keys: list[str], at: Column, half_bins: int, first_frame: Column, n_frames: int, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """Part of a spectrogram around a place and from a frame, over its median in dB, and its display range.

    bins: keys, frame, bin, p; ``at`` and ``first_frame`` are columns of it.
    """
    part = bins.where(F.col("bin").between(at - half_bins, at + half_bins) & (F.col("frame") >= first_frame) & (F.col("frame") < first_frame + n_frames))
    mid = part.groupBy(*keys).agg(F.percentile("p", F.lit(0.5)).alias("m"))
    out = part.join(mid, keys).select(*keys, "frame", "bin", X.db(F.col("p") / (F.col("m") + X.EPS)).alias("db"))
    return out, out.groupBy(*keys).agg(F.percentile("db", F.lit(low / 100)).alias("low_db"), F.percentile("db", F.lit(high / 100)).alias("high_db"))


def predicted_track(events: DataFrame, times: Column) -> DataFrame:
    """Adds f_hz, the frequency of an event's track at times in seconds: freq_hz + drift_hz_per_s * (t - ref_s)."""
    return events.withColumn("t_s", F.explode(times)).withColumn("f_hz", F.col("freq_hz") + F.col("drift_hz_per_s") * (F.col("t_s") - F.col("ref_s")))


def select_records(events: DataFrame, scope: str, top: int | None, default: int = 100) -> DataFrame:
    """Events to review by falling score: the candidates, or all if there is none or all are asked for; ``top`` of them, by
    default ``default`` of the candidates. A report's top list, hence the limit."""
    chosen = events if scope == "all-events" or events.where("candidate_passed").isEmpty() else events.where("candidate_passed")
    chosen = chosen.orderBy(F.desc_nulls_last("score"), "event_id")
    n = top if top and top > 0 else (default if scope != "all-events" else 0)
    return chosen.limit(n) if n else chosen
