"""Injected truth against events: pairing, quality and calibration."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skydrift.operators.greedy import assign
from skydrift.tables import materialize


def event_times(events: DataFrame, dt_s: float) -> DataFrame:
    """Adds e0, e1 and peak_s, in seconds; the peak is the middle where its row is missing."""
    return events.withColumns({"e0": F.col("row0") * F.lit(dt_s), "e1": F.col("row1") * F.lit(dt_s)}).withColumn(
        "peak_s", F.coalesce(F.col("peak_row") * F.lit(dt_s), 0.5 * (F.col("e0") + F.col("e1"))))


def signal_times(signals: DataFrame, dt_s: float) -> DataFrame:
    """Fills a missing start of signals from start_row, and then a missing end from the duration. NaN counts as null."""
    known = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    return signals.withColumn("injected_start_s", F.coalesce(known("injected_start_s"), F.col("start_row") * F.lit(dt_s))).withColumn(
        "injected_end_s", F.coalesce(known("injected_end_s"), F.col("injected_start_s") + known("injected_duration_s")))


def expected_freq(t: Column) -> Column:
    """Frequency of an injected signal at t."""
    return F.col("injected_start_freq_hz") + F.col("injected_drift_hz_per_s") * (t - F.col("injected_start_s"))


def pairs(signals: DataFrame, events: DataFrame, bucket_s: float = 8.0) -> DataFrame:
    """Pairs of a signal and an event of one observation that overlap in time, with their errors and score.

    Both sides are cut into time buckets and joined on observation and bucket; a pair that shares several buckets is kept in
    the first only. Rows without times or frequency pair with nothing. ``within`` tells whether the event's path stays within
    the frequency tolerance; drift doesn't decide.
    """
    s = signals.where("injected_start_s is not null and injected_end_s > injected_start_s and injected_start_freq_hz is not null")
    e = events.where("e0 is not null and e1 > e0 and freq_hz is not null and not isnan(freq_hz)")
    cut = lambda df, a, b: df.withColumn("tb", F.explode(F.sequence(F.floor(F.col(a) / bucket_s), F.floor(F.col(b) / bucket_s))))
    p = cut(s, "injected_start_s", "injected_end_s").join(
        cut(e.select("obs_id", "event_id", "e0", "e1", "peak_s", "freq_hz", "drift_hz_per_s", "best_refined_snr"), "e0", "e1"), ["obs_id", "tb"])
    o0, o1 = F.greatest("injected_start_s", "e0"), F.least("injected_end_s", "e1")
    p = p.withColumns({"o0": o0, "o1": o1}).where((F.col("o1") > F.col("o0")) & (F.col("tb") == F.floor(F.col("o0") / bucket_s)))
    err = lambda t: F.abs(F.col("freq_hz") + F.col("drift_hz_per_s") * (t - F.col("peak_s")) - expected_freq(t))
    three = [err(F.col("o0")), err(0.5 * (F.col("o0") + F.col("o1"))), err(F.col("o1"))]
    tol = F.greatest(F.coalesce("freq_tolerance_hz", F.lit(120.0)), F.lit(1e-9))
    dtol = F.greatest(F.coalesce("drift_tolerance_hz_per_s", F.lit(6.0)), F.lit(1e-9))
    p = p.withColumns({
        "path_max_err_hz": F.greatest(*three), "path_rms_err_hz": F.sqrt((three[0] ** 2 + three[1] ** 2 + three[2] ** 2) / 3),
        "freq_err_hz": err(F.col("peak_s")), "drift_err_hz_per_s": F.abs(F.col("drift_hz_per_s") - F.col("injected_drift_hz_per_s")),
        "duration_err_s": F.abs(F.col("e1") - F.col("e0") - F.col("injected_duration_s")),
    })
    score = (F.col("path_rms_err_hz") / tol + 0.10 * F.least(F.col("drift_err_hz_per_s") / dtol, F.lit(5.0))
             + 0.05 * F.col("duration_err_s") / F.greatest("injected_duration_s", F.lit(1.0)))
    return p.withColumns({"match_score": score, "within": F.col("path_max_err_hz") <= tol})


def match(signals: DataFrame, events: DataFrame) -> DataFrame:
    """One-to-one pairs within tolerance, lowest score first; ties by signal and event."""
    p = pairs(signals, events).where("within").select("signal_id", "event_id", "match_score", "path_max_err_hz", "path_rms_err_hz", "freq_err_hz",
                                                      "drift_err_hz_per_s", "duration_err_s", "best_refined_snr")
    return assign(p, "signal_id", "event_id", ["match_score", "signal_id", "event_id"])


def truth_of_events(signals: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, signal_id, match_score): of each event the signal with the lowest score, ties by signal; tolerance doesn't decide."""
    best = pairs(signals, events).groupBy("event_id").agg(F.min(F.struct("match_score", "signal_id")).alias("b"))
    return best.select("event_id", "b.signal_id", "b.match_score")


def three_way(signals: DataFrame, events: DataFrame, matched: DataFrame) -> DataFrame:
    """(signal_id, event_id, match_status): every signal and every event once, matched or alone."""
    m = matched.select("signal_id", "event_id")
    left = signals.select("signal_id").join(m, "signal_id", "left")
    out = left.join(events.select("event_id"), "event_id", "full_outer")
    status = F.when(F.col("signal_id").isNull(), "unmatched_candidate").when(F.col("event_id").isNull(), "unmatched_injected").otherwise("matched")
    return out.select("signal_id", "event_id", status.alias("match_status"))


#: The SNR that a signal is compared by: the first of these that is known.
REFERENCES = ("realized_local_psd_snr_db", "requested_local_psd_snr_db", "requested_snr_db", "injected_snr_db")


def reference_snr(columns: list[str]) -> Column:
    """That SNR, of signals with some of the columns."""
    return F.coalesce(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in REFERENCES if c in columns])


def quality(recovered: Column, reference: Column) -> Column:
    """How well a matched signal's SNR was recovered."""
    err = recovered - reference
    name = lambda x: F.lit("geometry_match_" + x)
    return (F.when(recovered.isNull() | reference.isNull(), name("no_snr_measurement")).when((recovered <= 0) & (reference >= 2), name("low_measured_snr"))
            .when(F.abs(err) <= 3, name("measurement_consistent")).when(err < -3, name("measurement_low")).otherwise(name("measurement_high")))


def calibration(matched: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept_db, rms_residual_db, n_fit): least squares of y on x over rows with both; none below two rows.

    Where x doesn't vary the slope is 1. Residuals follow from the sums of squares, so the rows are read once.
    """
    ok = matched.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    a = ok.agg(F.count(F.lit(1)).alias("n_fit"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.regr_sxx(y, x).alias("sxx"),
               F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy")).where("n_fit >= 2")
    slope = F.when(F.col("sxx") > 1e-12, F.col("sxy") / F.col("sxx")).otherwise(1.0)
    left = F.greatest(F.lit(0.0), F.col("syy") - 2 * slope * F.col("sxy") + slope * slope * F.col("sxx"))
    return a.select(slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept_db"), F.sqrt(left / F.col("n_fit")).alias("rms_residual_db"), "n_fit")


def calibrated(rows: DataFrame, fit: DataFrame, y: str) -> DataFrame:
    """Adds calibrated_snr_db, the inverse of the fit; null without a fit or with a flat one. The fit is one row."""
    f = fit.select(F.struct("slope", "intercept_db").alias("f")).first()
    if f is None or abs(f["f"]["slope"]) < 1e-12:
        return rows.withColumn("calibrated_snr_db", F.lit(None).cast("double"))
    return rows.withColumn("calibrated_snr_db", (F.col(y) - f["f"]["intercept_db"]) / f["f"]["slope"])


def nominal_gain_db(n: int) -> float:
    """Gain of coherent processing of n samples."""
    return 10 * math.log10(max(n, 1))


def nearest_event(signals: DataFrame, events: DataFrame, bucket_hz: float = 4096.0) -> DataFrame:
    """(signal_id, event_id, freq_err_hz, drift_err_hz_per_s, detected): of each signal the event of its observation nearest in
    frequency and drift, and whether both are within tolerance. Frequency is that at the start of the signal.

    The cost is the distance in frequency plus ten times that in drift. Signals look in their own frequency bucket and the next ones; what is
    found there within a bucket's width can't be beaten from beyond. Others look on in buckets four times as wide, and so on.
    """
    s = signals.where("injected_start_freq_hz is not null").select(
        "signal_id", "obs_id", F.col("injected_start_freq_hz").alias("f0"), F.col("injected_drift_hz_per_s").alias("d0"), F.coalesce("freq_tolerance_hz", F.lit(120.0)).alias("ft"),
        F.coalesce("drift_tolerance_hz_per_s", F.lit(6.0)).alias("dt"))
    e = events.where("freq_hz is not null and not isnan(freq_hz)").select("obs_id", "event_id", "freq_hz", "drift_hz_per_s")
    span = s.select(F.col("f0").alias("f")).union(e.select("freq_hz")).agg(F.max("f") - F.min("f")).first()[0] or 0.0
    left, width, found = materialize(s), bucket_hz, []
    while not left.isEmpty():
        at = lambda c: F.floor(F.col(c) / F.lit(width))  # noqa: B023, E731
        near = left.withColumn("fb", F.explode(F.sequence(at("f0") - 1, at("f0") + 1))).join(e.withColumn("fb", at("freq_hz")), ["obs_id", "fb"])
        df, dd = F.abs(F.col("freq_hz") - F.col("f0")), F.abs(F.col("drift_hz_per_s") - F.col("d0"))
        best = near.groupBy("signal_id").agg(F.min(F.struct((df + 10 * dd).alias("c"), "event_id", df.alias("df"), dd.alias("dd"), "ft", "dt")).alias("b"))
        # The last round has everything within its three buckets.
        last = width > span
        sure = materialize(best.where(F.lit(last) | (F.col("b.c") <= width)))
        found.append(sure)
        if last:
            break
        left, width = materialize(left.join(sure.select("signal_id"), "signal_id", "left_anti")), width * 4
    out = reduce(DataFrame.unionByName, found) if found else s.limit(0).select("signal_id", F.lit(None).cast("struct<c:double,event_id:string,df:double,dd:double,ft:double,dt:double>").alias("b"))
    return out.select("signal_id", "b.event_id", F.col("b.df").alias("freq_err_hz"), F.col("b.dd").alias("drift_err_hz_per_s"),
                      ((F.col("b.df") <= F.col("b.ft")) & (F.col("b.dd") <= F.col("b.dt"))).alias("detected"))


def summary(rows: DataFrame) -> DataFrame:
    """One row about a comparison: rows by status and by quality of the match, and the lowest SNR of a matched and the highest of an unmatched
    signal, by the reference of each. rows: match_status, match_quality and what signals have of SNR columns."""
    have = [c for c in rows.columns if c.endswith("snr_db")]
    pick = lambda *names: F.coalesce(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in names if c in have], F.lit(None).cast("double"))
    local = F.col("snr_reference") == "local_psd" if "snr_reference" in rows.columns else F.lit(True)
    snr = F.when(local, pick("realized_local_psd_snr_db", "requested_local_psd_snr_db", "injected_snr_db")).otherwise(pick("injected_realized_snr_db", "injected_snr_db"))
    count = lambda c, *values: F.count_if(F.coalesce(F.col(c).isin(*values), F.lit(False)))
    q = lambda *names: count("match_quality", *["geometry_match_" + n for n in names])
    return rows.agg(
        count("match_status", "matched", "unmatched_injected").alias("n_signals"), count("match_status", "matched").alias("n_matched"),
        count("match_status", "unmatched_injected").alias("n_unmatched_injected"), count("match_status", "unmatched_candidate").alias("n_unmatched_candidates"),
        q("measurement_consistent").alias("n_consistent"), q("low_measured_snr", "measurement_low").alias("n_low"), q("measurement_high").alias("n_high"),
        F.min(F.when(F.col("match_status") == "matched", snr)).alias("lowest_matched_snr_db"), F.max(F.when(F.col("match_status") == "unmatched_injected", snr)).alias("highest_unmatched_snr_db"))
