"""Queries of measurement, injection and comparison with the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skydrift.functions import exprs as X
from skydrift.operators import compare as C
from skydrift.operators import inject as I
from skydrift.operators import measure as M
from skydrift.operators import nested, raw, spectra
from skydrift.params import Contract, Measurement
from skydrift.plans import data_problems as D
from skydrift.plans import spectral as S
from skydrift.plans import tracks as T
from skydrift.plans.spectral import KEYS, r
from skydrift.tables import canonical_obs, table

CONTRACT = Contract()
MEASURE = Measurement(bg_half_width_bins=12, guard_bins=2, min_background_pixels=32, ridge_snap_half_width_bins=1)


def _ridges(spark, sf_dir):
    """A track in every tile and channel of the vectors."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 64").alias("tile"), F.col("label").alias("channel")).distinct()
    return e.select(*KEYS, (20 + F.col("channel")).cast("double").alias("at"), F.lit(0.5).alias("slope"), F.lit(3).alias("ridge"), F.lit(64).alias("n_bins"))


def local_snr(spark, sf_dir):
    """Local signal-to-noise along a track."""
    out = M.local_snr(S.frames(spark, sf_dir).select(*KEYS, "frame", "power"), _ridges(spark, sf_dir).drop("n_bins"), KEYS, MEASURE, 1.5)
    return r(out.select(*KEYS, "ridge_pixel_snr_db", "band_excess_snr_db", "noise_floor", "ridge_pixels", "background_pixels", "warning"),
             "ridge_pixel_snr_db", "band_excess_snr_db", "noise_floor")


def _profile(spark, sf_dir):
    b = spectra.bins(S.frames(spark, sf_dir), KEYS).withColumn("db", X.db(F.col("p")))
    return M.aligned_profile(b, _ridges(spark, sf_dir), KEYS, 12)


def aligned_profile(spark, sf_dir):
    """Mean power around a track, with the track made upright."""
    return r(_profile(spark, sf_dir), "ratio", places=9)


def profile_evidence(spark, sf_dir):
    """Peak and centre of that profile against its background."""
    out = M.profile_evidence(_profile(spark, sf_dir), KEYS, 3)
    return r(out, "peak_excess_db", "center_excess_db", "peak_total_db", "center_total_db", "background_db")


def cutout_range(spark, sf_dir):
    """Display range of a cutout around a track."""
    b = spectra.bins(S.frames(spark, sf_dir), KEYS).join(_ridges(spark, sf_dir), KEYS)
    return r(M.cutout(b, KEYS, F.col("at"), 8, F.lit(1), 4, 3.0, 99.0)[1], "low_db", "high_db")


def predicted_tracks(spark, sf_dir):
    """Frequency of each event at its first and last row."""
    e = T.events(spark, sf_dir).where("freq_hz is not null").withColumn("ref_s", F.coalesce("peak_row", F.rint((F.col("row0") + F.col("row1")) / 2)) * F.lit(T.DT))
    out = M.predicted_track(e, F.array(F.col("row0") * F.lit(T.DT), F.col("row1") * F.lit(T.DT)))
    return r(out.select("event_id", "t_s", "f_hz"), "t_s", "f_hz", places=3)


def review_list(spark, sf_dir):
    """The hundred best candidates, for review."""
    return M.select_records(T.events(spark, sf_dir).where("score is not null and not isnan(score)"), "candidates", None).select("event_id", "score")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injected signals with a frequency as a plan, once each, with the axis of their observation; a missing start follows from start_row."""
    s = table(spark, sf_dir, "injected_signals").dropDuplicates(["signal_id"]).withColumn("obs_id", canonical_obs(F.col("obs_id")))
    o = table(spark, sf_dir, "observations").select("obs_id", F.coalesce("lo_hz", F.lit(1e9)).alias("lo_hz"), F.coalesce("start_coarse_channel", F.lit(512)).alias("start_channel"))
    odd = F.col("signal_id") % 3
    s = C.signal_times(s, T.DT).join(o, "obs_id").where("injected_start_freq_hz is not null").select(
        "signal_id", "obs_id", "lo_hz", "start_channel", "morphology", F.col("injected_start_freq_hz").alias("abs_freq_hz"), F.col("injected_snr_db").alias("snr_db"),
        F.col("injected_drift_hz_per_s").alias("drift_hz_per_s"), F.col("injected_start_s").alias("start_s"), F.col("injected_start_s").isNotNull().alias("timed"), F.col("injected_duration_s").alias("duration_s"),
        F.col("width_hz").alias("bandwidth_hz"), (-F.col("injected_drift_hz_per_s")).alias("piecewise_second_drift_hz_per_s"), F.lit(3.0).alias("quadratic_hz_per_s2"),
        F.lit(12.0).alias("wobble_hz"), F.lit(0.5).alias("wobble_rate_hz"), F.lit(0.5).alias("duty_cycle"), F.lit(1.0).alias("period_s"),
        F.when(odd == 0, "local_psd").otherwise("coarse_channel").alias("snr_reference"))
    s = I.complete(s)
    ch, base = I.nearest_channel(F.col("abs_freq_hz"), F.col("lo_hz"), F.col("start_channel"), CONTRACT)
    return s.withColumns({"base_channel": ch, "baseband_hz": base})


def nearest_channels(spark, sf_dir):
    """Channel of each signal and its frequency within it."""
    return r(signals(spark, sf_dir).select("signal_id", "base_channel", "baseband_hz"), "baseband_hz", places=3)


def target_channels(spark, sf_dir):
    """Channels that each signal would go to as a checkerboard or a contiguous band."""
    odd = F.col("signal_id") % 3
    s = signals(spark, sf_dir).withColumns({
        "morphology": F.when(odd == 0, "checkerboard").when(odd == 1, "broadband_contig").otherwise(F.col("morphology")), "coarse_channel_count": F.lit(7),
        "checkerboard_period": F.lit(3), "amplitude_taper": F.when(F.col("signal_id") % 2 == 0, "triangular").otherwise("alternating")})
    return r(I.target_channels(s, CONTRACT).select("signal_id", "no", "channel", "baseband_hz", "amp_scale"), "baseband_hz", "amp_scale", places=3)


def instant_frequency(spark, sf_dir):
    """Frequency of each signal at eight times."""
    s = signals(spark, sf_dir).where("timed").select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).withColumn("t", F.col("start_s") + F.col("duration_s") * F.col("k") / 8)
    s = s.withColumn("f", I.instant_frequency(F.col("t"), F.lit(100.0)) + 3.21e-7)  # off the ties of rounding
    return r(s.select("signal_id", "k", "f"), "f")


def signal_phase(spark, sf_dir):
    """Phase of each signal from the first row of its observation to its end, at eight rows a second, and whether it is on."""
    last = F.ceil((F.col("start_s") + F.col("duration_s")) * 8) + 1
    s = signals(spark, sf_dir).where("timed and duration_s is not null").select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("row"))
    s = s.withColumns({"cycles": I.phase_cycles(F.col("row"), F.lit(1.5), 8.0), "env": I.envelope(F.col("row"), 8.0)})
    # Shifted off the ties of rounding, since the comparison sums row by row.
    return r(s.select("signal_id", "row", (F.col("cycles") + 3.21e-6).alias("cycles"), "env"), "cycles", "env", places=4)


def signal_course(spark, sf_dir):
    """Phase of each signal over all its rows, at eight rows a second, and whether it is on."""
    s = signals(spark, sf_dir).where("timed").select("*", F.explode(I.active_rows(8.0)).alias("row"))
    s = s.withColumns({"cycles": I.phase_cycles(F.col("row"), F.lit(1.5), 8.0), "env": I.envelope(F.col("row"), 8.0)})
    return r(s.select("signal_id", "row", (F.col("cycles") + 3.21e-6).alias("cycles"), "env"), "cycles", "env", places=4)


def signal_tones(spark, sf_dir):
    """Tones that make up each signal, and its extent against its channel."""
    s = I.out_of_channel(signals(spark, sf_dir), CONTRACT)
    return r(s.select("signal_id", I.tone_count(F.col("bandwidth_hz"), F.col("n_tones")).alias("tones"), "excursion_hz", "fits"), "excursion_hz", places=3)


def power_plan(spark, sf_dir):
    """Power asked for each signal in a channel of RMS 20."""
    s = signals(spark, sf_dir).withColumns(I.power_plan(F.lit(20.0), F.lit(1.0), CONTRACT))
    return r(s.select("signal_id", "reference_bandwidth_hz", "requested_signal_power", "requested_local_psd_snr_db"),
             "reference_bandwidth_hz", "requested_signal_power", "requested_local_psd_snr_db", places=5)


def clip_summary(spark, sf_dir):
    """What would be clipped of the vectors' samples at three times their scale."""
    d = raw.decode(S.words(spark, sf_dir), "word").select(*KEYS, (F.col("i") * 3.0).alias("i"), (F.col("q") * 3.0).alias("q"))
    return r(I.clip_summary(d, KEYS), "clipped_share", "max_abs")


def injected_samples(spark, sf_dir):
    """The vectors' samples with one signal added to every even channel."""
    d = raw.decode(S.words(spark, sf_dir), "word").select(*KEYS, "row", "i", "q")
    t = d.select(*KEYS).distinct().where("channel % 2 = 0").select(
        *KEYS, F.col("channel").alias("signal_no"), F.lit("linear").alias("morphology"), F.lit(15.0).alias("snr_db"), F.lit(50.0).alias("drift_hz_per_s"),
        F.lit(0.0).alias("start_s"), F.lit(1.0).alias("duration_s"), F.lit(1000.0).alias("baseband_hz"), F.lit(1.0).alias("amp_scale"))
    return I.add_signals(d, I.complete(t), CONTRACT, ["tile"])[0]


def _truth(spark, sf_dir):
    """Injected signals once each, with the times that follow from other columns."""
    s = table(spark, sf_dir, "injected_signals").dropDuplicates(["signal_id"]).withColumn("obs_id", canonical_obs(F.col("obs_id")))
    return C.signal_times(s, T.DT)


def _found(spark, sf_dir):
    return C.event_times(T.events(spark, sf_dir), T.DT)


def truth_pairs(spark, sf_dir):
    """Signals and events that overlap in time, with path errors and score."""
    p = C.pairs(_truth(spark, sf_dir), _found(spark, sf_dir))
    return r(p.select("signal_id", "event_id", "path_max_err_hz", "path_rms_err_hz", "match_score", "within"), "path_max_err_hz", "path_rms_err_hz", "match_score", places=4)


def event_truth(spark, sf_dir):
    """Of each event the signal that it would be measured as."""
    return r(C.truth_of_events(_truth(spark, sf_dir), _found(spark, sf_dir)), "match_score", places=4)


def measured_channels(spark, sf_dir):
    """Channel in which each event is measured, and the width of its ridge."""
    o = table(spark, sf_dir, "observations").select("obs_id", F.coalesce("lo_hz", F.lit(1e9)).alias("lo_hz"), F.coalesce("start_coarse_channel", F.lit(512)).alias("start_channel"))
    e = T.events(spark, sf_dir).join(o, "obs_id")
    ch = M.choose_channel(F.col("representative_coarse_channel"), F.col("freq_hz"), F.col("lo_hz"), F.col("start_channel"), CONTRACT)
    width = F.when(F.col("n_hits") > 2, F.col("n_hits") * 4.0)
    return e.select("event_id", ch.alias("channel"), M.ridge_width(width, F.col("best_width_bins"), CONTRACT.df_hz / 2048, Measurement()).alias("ridge_bins"))


def truth_matches(spark, sf_dir):
    """One-to-one pairs, best score first."""
    return r(C.match(_truth(spark, sf_dir), _found(spark, sf_dir)).select("signal_id", "event_id", "match_score"), "match_score")


def truth_status(spark, sf_dir):
    """Every signal and event, matched or alone."""
    s, e = _truth(spark, sf_dir), _found(spark, sf_dir)
    return C.three_way(s, e, C.match(s, e))


def truth_summary(spark, sf_dir):
    """Counts of the comparison by status and quality, and the limits of what was found."""
    s, e = _truth(spark, sf_dir), _found(spark, sf_dir)
    m = C.match(s, e)
    rows = C.three_way(s, e, m).join(m.select("signal_id", "event_id", "best_refined_snr"), ["signal_id", "event_id"], "left").join(
        s.select("signal_id", "realized_local_psd_snr_db", "injected_snr_db"), "signal_id", "left")
    quality = C.quality(F.nanvl("best_refined_snr", F.lit(None).cast("double")), C.reference_snr(rows.columns))
    return C.summary(rows.withColumn("match_quality", F.when(F.col("match_status") == "matched", quality)))


def report_truth(spark, sf_dir):
    """Signals of the injection reports as truth, with all fallbacks."""
    return nested.truth_table(nested.report_tables(table(spark, sf_dir, "injection_reports")))


def truth_quality(spark, sf_dir):
    """How well the SNR was recovered in each pair within tolerance."""
    p = C.pairs(_truth(spark, sf_dir), _found(spark, sf_dir)).where("within")
    return p.select("signal_id", "event_id", C.quality(F.nanvl("best_refined_snr", F.lit(None).cast("double")), C.reference_snr(p.columns)).alias("quality"))


def truth_calibration(spark, sf_dir):
    """Fit of the refined SNR on the injected one over pairs within tolerance."""
    p = C.pairs(_truth(spark, sf_dir), _found(spark, sf_dir)).where("within")
    p = p.withColumn("x", C.reference_snr(p.columns))
    return r(C.calibration(p, "x", "best_refined_snr"), "slope", "intercept_db", "rms_residual_db", places=5)


def nearest_events(spark, sf_dir):
    """Event nearest to each signal in frequency and drift, and whether that is a detection."""
    return r(C.nearest_event(_truth(spark, sf_dir), _found(spark, sf_dir)), "freq_err_hz", "drift_err_hz_per_s", places=4)


QUERIES = {f.__name__: f for f in (local_snr, aligned_profile, profile_evidence, cutout_range, predicted_tracks, review_list, nearest_channels, target_channels,
                                   instant_frequency, signal_phase, signal_course, signal_tones, power_plan, clip_summary, injected_samples, truth_pairs, event_truth, measured_channels, truth_matches,
                                   truth_status, truth_summary, report_truth, truth_quality, truth_calibration, nearest_events)}

_DF = "(1e9::DOUBLE / 65536)"
_B = S._B
_CENTRE = "greatest(0, least(63, CAST(ceil(20 + channel + 0.5 * frame - 0.5) AS BIGINT)))"
_PROFILE = f"""WITH {_B}, o AS (SELECT *, bin - {_CENTRE} AS "offset" FROM b),
pr AS (SELECT tile, channel, "offset", avg(10 ** (log10(p + 1e-12))) AS ratio FROM o WHERE abs("offset") <= 12 GROUP BY ALL)"""
_SIG = f"""s AS (SELECT DISTINCT signal_id, i.obs_id, coalesce(lo_hz, 1e9::DOUBLE) AS lo, coalesce(start_coarse_channel, 512) AS st, morphology AS mo, injected_start_freq_hz AS f0, injected_snr_db AS snr,
    injected_drift_hz_per_s AS d, coalesce(injected_start_s, start_row * {T._DT}) AS s0, injected_duration_s AS du, width_hz AS bw FROM (SELECT * EXCLUDE obs_id, lower(trim(replace(obs_id, '-', '_'))) AS obs_id FROM injected_signals) i
  JOIN observations o ON i.obs_id = o.obs_id WHERE injected_start_freq_hz IS NOT NULL),
c AS (SELECT *, CAST(greatest(0, least(255, ceil((f0 - lo) / {_DF} - st - 0.5))) AS INTEGER) AS ch FROM s),
g AS (SELECT *, f0 - (lo + (st + ch) * {_DF}) AS base FROM c)"""
_F = lambda x, base: f"""CASE mo WHEN 'piecewise' THEN CASE WHEN {x} < du / 2 THEN {base} + d * {x} ELSE {base} + d * du / 2 + CASE WHEN d = 0 THEN d ELSE -d END * ({x} - du / 2) END
  WHEN 'wobble' THEN {base} + d * {x} + 12 * sin(2 * pi() * 0.5 * {x}) WHEN 'quadratic' THEN {base} + d * {x} + 1.5 * ({x}) * ({x}) ELSE {base} + d * {x} END"""  # noqa: E731
_PAIRS = f"""WITH {T._EV}, v AS (SELECT *, lower(trim(replace(obs_id, '-', '_'))) AS o, row0 * {T._DT} AS e0, row1 * {T._DT} AS e1,
    coalesce(peak_row * {T._DT}, 0.5 * (row0 + row1) * {T._DT}) AS pk FROM e WHERE freq_hz IS NOT NULL AND row1 > row0),
t0 AS (SELECT DISTINCT * REPLACE (lower(trim(replace(obs_id, '-', '_'))) AS obs_id, coalesce(injected_start_s, start_row * {T._DT}) AS injected_start_s) FROM injected_signals),
i AS (SELECT * REPLACE (coalesce(injected_end_s, injected_start_s + injected_duration_s) AS injected_end_s) FROM t0),
p AS (SELECT i.*, v.event_id, v.freq_hz AS ef, v.drift_hz_per_s AS ed, pk, e0, e1, best_refined_snr AS br, greatest(injected_start_s, e0) AS o0, least(injected_end_s, e1) AS o1,
    greatest(coalesce(freq_tolerance_hz, 120), 1e-9) AS ft, greatest(coalesce(drift_tolerance_hz_per_s, 6), 1e-9) AS dtol FROM i JOIN v ON v.o = i.obs_id
  WHERE least(injected_end_s, e1) > greatest(injected_start_s, e0) AND injected_start_freq_hz IS NOT NULL AND injected_end_s > injected_start_s),
q AS (SELECT *, abs((ef + ed * (o0 - pk)) - (injected_start_freq_hz + injected_drift_hz_per_s * (o0 - injected_start_s))) AS x1,
    abs((ef + ed * (0.5 * (o0 + o1) - pk)) - (injected_start_freq_hz + injected_drift_hz_per_s * (0.5 * (o0 + o1) - injected_start_s))) AS x2,
    abs((ef + ed * (o1 - pk)) - (injected_start_freq_hz + injected_drift_hz_per_s * (o1 - injected_start_s))) AS x3 FROM p),
z AS (SELECT *, greatest(x1, x2, x3) AS mx, sqrt((x1 * x1 + x2 * x2 + x3 * x3) / 3) AS rms, coalesce(CASE WHEN isnan(realized_local_psd_snr_db) THEN NULL ELSE realized_local_psd_snr_db END, injected_snr_db) AS x FROM q)"""

_SCORE = "rms / ft + 0.1 * least(abs(ed - injected_drift_hz_per_s) / dtol, 5) + 0.05 * abs(e1 - e0 - injected_duration_s) / greatest(injected_duration_s, 1)"
# Pair after pair of each observation, in order: a pair is taken if neither side is in a taken one.
_MATCHED = _PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", k AS (SELECT obs_id, signal_id, event_id, {_SCORE} AS sc FROM z WHERE mx <= ft),
n AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY sc, signal_id, event_id) AS n FROM k),
step AS (SELECT obs_id, 0::BIGINT AS n, []::BIGINT[] AS used, []::VARCHAR[] AS gone, CAST(NULL AS BIGINT) AS signal_id, CAST(NULL AS VARCHAR) AS event_id, CAST(NULL AS DOUBLE) AS sc
    FROM (SELECT DISTINCT obs_id FROM n)
  UNION ALL SELECT n.obs_id, n.n, CASE WHEN ok THEN list_append(used, n.signal_id) ELSE used END, CASE WHEN ok THEN list_append(gone, n.event_id) ELSE gone END,
      CASE WHEN ok THEN n.signal_id END, CASE WHEN ok THEN n.event_id END, CASE WHEN ok THEN n.sc END
    FROM (SELECT step.obs_id, step.n, used, gone, n.signal_id AS si, n.event_id AS ev, NOT list_contains(used, n.signal_id) AND NOT list_contains(gone, n.event_id) AS ok
          FROM step JOIN n ON n.obs_id = step.obs_id AND n.n = step.n + 1) x JOIN n ON n.obs_id = x.obs_id AND n.n = x.n + 1),
matched AS (SELECT signal_id, event_id, sc FROM step WHERE signal_id IS NOT NULL)"""

SQL = {
    "local_snr": f"""WITH {_B}, c0 AS (SELECT *, {_CENTRE} AS c0 FROM b),
cc AS (SELECT tile, channel, frame, arg_max(bin, {{'p': p, 'b': -bin}}) AS c FROM c0 WHERE abs(bin - c0) <= 1 GROUP BY ALL),
t AS (SELECT b.*, c, bin BETWEEN c - 1 AND c + 1 AS ridge, bin < greatest(0, c - 1) - 2 OR bin >= least(64, c + 2) + 2 AS clear FROM b JOIN cc USING (tile, channel, frame)),
n AS (SELECT tile, channel, sum(p) FILTER (ridge) AS rs, count(*) FILTER (ridge) AS rn, count(*) FILTER (clear AND abs(bin - c) <= 12) AS near, count(*) FILTER (clear AND abs(bin - c) <= 32) AS far,
  median(p) FILTER (clear AND abs(bin - c) <= 12) AS m12, median(p) FILTER (clear AND abs(bin - c) <= 32) AS m32 FROM t GROUP BY ALL),
z AS (SELECT *, near < 32 AS wide, CASE WHEN near < 32 THEN far ELSE near END AS bn, CASE WHEN near < 32 THEN m32 ELSE m12 END AS noise FROM n),
q AS (SELECT *, bn < 32 AS few, (rs / rn - noise * (1 + 1.0 / 2 + 1.0 / 3) / ln(2)) / noise AS ratio FROM z)
SELECT tile, channel, CASE WHEN few OR noise <= 0 OR ratio <= 0 THEN NULL ELSE round(10 * log10(ratio), 6) + 0.0 END AS ridge_pixel_snr_db,
  CASE WHEN few OR noise <= 0 OR ratio <= 0 THEN NULL ELSE round(10 * log10(ratio * 1.5), 6) + 0.0 END AS band_excess_snr_db,
  CASE WHEN few OR noise <= 0 THEN NULL ELSE round(noise, 6) + 0.0 END AS noise_floor, CAST(rn AS INTEGER) AS ridge_pixels, CAST(bn AS INTEGER) AS background_pixels,
  CASE WHEN few THEN 'insufficient background pixels' WHEN noise <= 0 THEN 'invalid non-positive noise floor'
    ELSE concat_ws('; ', CASE WHEN wide THEN 'background window expanded' END, CASE WHEN ratio <= 0 THEN 'non-positive signal excess' END) END AS warning FROM q""",
    "aligned_profile": _PROFILE + """ SELECT tile, channel, "offset", round(ratio, 9) + 0.0 AS ratio FROM pr""",
    "profile_evidence": _PROFILE + """, a AS (SELECT tile, channel, median(ratio) FILTER (abs("offset") > 3) AS bg, max(ratio) FILTER (abs("offset") <= 3) AS pk,
  arg_max("offset", {'r': ratio, 'o': -"offset"}) FILTER (abs("offset") <= 3) AS po, avg(ratio) FILTER (abs("offset") <= 1) AS ce FROM pr GROUP BY ALL)
SELECT tile, channel, CASE WHEN pk > bg THEN round(10 * log10((pk - bg) / bg), 6) + 0.0 END AS peak_excess_db, CASE WHEN ce > bg THEN round(10 * log10((ce - bg) / bg), 6) + 0.0 END AS center_excess_db,
  round(10 * log10(greatest(pk / bg, 1e-12)), 6) + 0.0 AS peak_total_db, round(10 * log10(greatest(ce / bg, 1e-12)), 6) + 0.0 AS center_total_db, po AS peak_offset,
  round(10 * log10(bg), 6) + 0.0 AS background_db, coalesce(pk > bg AND 10 * log10((pk - bg) / bg) >= 0, false) OR coalesce(ce > bg AND 10 * log10((ce - bg) / bg) >= -3, false) AS visual_evidence FROM a""",
    "cutout_range": f"""WITH {_B}, k AS (SELECT * FROM b WHERE abs(bin - (20 + channel)) <= 8 AND frame BETWEEN 1 AND 4),
z AS (SELECT tile, channel, 10 * log10(p / (median(p) OVER (PARTITION BY tile, channel) + 1e-12) + 1e-12) AS db FROM k)
SELECT tile, channel, round(quantile_cont(db, 0.03), 6) + 0.0 AS low_db, round(quantile_cont(db, 0.99), 6) + 0.0 AS high_db FROM z GROUP BY ALL""",
    "predicted_tracks": f"""WITH {T._EV}, z AS (SELECT *, coalesce(peak_row, round_even((row0 + row1) / 2, 0)) * {T._DT} AS ref, unnest([row0 * {T._DT}, row1 * {T._DT}]) AS t FROM e WHERE freq_hz IS NOT NULL)
SELECT event_id, round(t, 3) + 0.0 AS t_s, round(freq_hz + drift_hz_per_s * (t - ref), 3) + 0.0 AS f_hz FROM z""",
    "review_list": f"WITH {T._EV} SELECT event_id, score FROM e WHERE candidate_passed AND score IS NOT NULL AND NOT isnan(score) ORDER BY score DESC, event_id LIMIT 100",
    "nearest_channels": f"WITH {_SIG} SELECT signal_id, ch AS base_channel, round(base, 3) + 0.0 AS baseband_hz FROM g",
    "target_channels": f"""WITH {_SIG}, t AS (SELECT *, signal_id % 3 AS o, greatest(0, ch - 3) AS a, least(256, greatest(0, ch - 3) + 7) AS z FROM g),
u AS (SELECT *, unnest(CASE o WHEN 0 THEN range(a, z, 3) WHEN 1 THEN range(a, z) ELSE [ch] END) AS channel, unnest(range(CASE o WHEN 0 THEN len(range(a, z, 3)) WHEN 1 THEN len(range(a, z)) ELSE 1 END)) AS no FROM t)
SELECT signal_id, CAST(no AS INTEGER) AS no, CAST(channel AS INTEGER) AS channel, round(base + (ch - channel) * {_DF}, 3) + 0.0 AS baseband_hz,
  round(CASE WHEN o = 2 THEN 1 WHEN signal_id % 2 = 0 THEN greatest(0.25, 1 - abs(no - 3.0) / 3.0) WHEN no % 2 = 0 THEN 1 ELSE 0.55 END, 3) + 0.0::DOUBLE AS amp_scale FROM u""",
    "instant_frequency": f"""WITH {_SIG}, t AS (SELECT *, s0 + du * k / 8 - s0 AS x FROM (SELECT *, unnest(range(8)) AS k FROM g WHERE s0 IS NOT NULL))
SELECT signal_id, k, round(({_F('x', '100')}) + 3.21e-7, 6) + 0.0 AS f FROM t""",
    "signal_phase": f"""WITH {_SIG}, t AS (SELECT *, k / 8.0 - s0 AS x FROM (SELECT *, unnest(range(CAST(ceil((s0 + du) * 8) AS BIGINT) + 2)) AS k FROM g WHERE s0 IS NOT NULL AND du IS NOT NULL)),
w AS (SELECT *, sum({_F('x', '1.5')}) OVER (PARTITION BY signal_id ORDER BY k) / 8 AS cy, k >= floor(s0 * 8) AND k < floor(s0 * 8) + floor(du * 8) AS is_on FROM t)
SELECT signal_id, k AS "row", round(cy + 3.21e-6, 4) + 0.0 AS cycles, CAST(CASE WHEN mo = 'intermittent' THEN is_on AND (k - floor(s0 * 8)) / 8 - floor((k - floor(s0 * 8)) / 8) <= 0.5
  WHEN mo = 'dualburst' THEN is_on OR (k >= 6 AND k < 7) ELSE is_on END AS DOUBLE) AS env FROM w""",
    "signal_tones": f"""WITH {_SIG}, n AS (SELECT *, greatest(3, least(17, CAST(ceil(bw / 6) AS INTEGER) + 1)) AS n FROM g),
x AS (SELECT signal_id, bw, n, max(abs({_F('x', 'base')})) AS m FROM (SELECT *, du * unnest(range(128)) / 127 AS x FROM n) GROUP BY ALL)
SELECT signal_id, CASE WHEN bw <= 0 THEN 1 ELSE n + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END END AS tones, round(m + bw / 2, 3) + 0.0 AS excursion_hz,
  m + bw / 2 <= {_DF} / 2 - greatest(8, 2 * {_DF} / 2048) AS fits FROM x""",
    "power_plan": f"""WITH {_SIG}, n AS (SELECT *, CASE WHEN bw > 0 THEN bw ELSE {_DF} / 2048 END AS rb FROM g),
p AS (SELECT *, 400 / {_DF} * rb AS np, CASE WHEN signal_id % 3 = 0 THEN 400 / {_DF} * rb ELSE 400 END * 10 ** (snr / 10) AS pw FROM n)
SELECT signal_id, round(rb, 5) + 0.0 AS reference_bandwidth_hz, round(pw, 5) + 0.0 AS requested_signal_power, round(10 * log10(pw / np), 5) + 0.0 AS requested_local_psd_snr_db FROM p""",
    "clip_summary": f"""WITH {S._W}, x AS (SELECT tile, channel, i * 3.0 AS i, q * 3.0 AS q FROM d)
SELECT tile, channel, 2 * count(*) AS n_components, CAST(sum((i < -128 OR i > 127)::INT + (q < -128 OR q > 127)::INT) AS BIGINT) AS n_clipped,
  round(max(greatest(abs(i), abs(q))), 6) + 0.0::DOUBLE AS max_abs, round(sum((i < -128 OR i > 127)::INT + (q < -128 OR q > 127)::INT) / (2 * count(*)), 6) + 0.0 AS clipped_share FROM x GROUP BY ALL""",
    "truth_pairs": _PAIRS + """ SELECT signal_id, event_id, round(mx, 4) + 0.0 AS path_max_err_hz, round(rms, 4) + 0.0 AS path_rms_err_hz,
  round(rms / ft + 0.1 * least(abs(ed - injected_drift_hz_per_s) / dtol, 5) + 0.05 * abs(e1 - e0 - injected_duration_s) / greatest(injected_duration_s, 1), 4) + 0.0 AS match_score, mx <= ft AS within FROM z""",
    "event_truth": _PAIRS + """, k AS (SELECT *, rms / ft + 0.1 * least(abs(ed - injected_drift_hz_per_s) / dtol, 5) + 0.05 * abs(e1 - e0 - injected_duration_s) / greatest(injected_duration_s, 1) AS sc FROM z)
SELECT event_id, signal_id, round(sc, 4) + 0.0 AS match_score FROM k QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY sc, signal_id) = 1""",
    "truth_matches": _MATCHED + " SELECT signal_id, event_id, round(sc, 6) + 0.0 AS match_score FROM matched",
    "truth_status": _MATCHED + """ SELECT s.signal_id, coalesce(m.event_id, NULL) AS event_id, CASE WHEN m.event_id IS NULL THEN 'unmatched_injected' ELSE 'matched' END AS match_status
FROM (SELECT DISTINCT signal_id FROM injected_signals) s LEFT JOIN matched m USING (signal_id)
UNION ALL SELECT NULL, event_id, 'unmatched_candidate' FROM e WHERE event_id NOT IN (SELECT event_id FROM matched)""",
    "truth_summary": _MATCHED + """, w AS (SELECT DISTINCT z.signal_id, br, x FROM z JOIN matched USING (signal_id, event_id)),
u AS (SELECT DISTINCT signal_id, coalesce(CASE WHEN isnan(realized_local_psd_snr_db) THEN NULL ELSE realized_local_psd_snr_db END, injected_snr_db) AS x FROM injected_signals
  WHERE signal_id NOT IN (SELECT signal_id FROM matched))
SELECT (SELECT count(DISTINCT signal_id) FROM injected_signals) AS n_signals, count(*) AS n_matched, (SELECT count(*) FROM u) AS n_unmatched_injected,
  (SELECT count(*) FROM e WHERE event_id NOT IN (SELECT event_id FROM matched)) AS n_unmatched_candidates,
  count(*) FILTER (NOT (br <= 0 AND x >= 2) AND abs(br - x) <= 3) AS n_consistent, count(*) FILTER ((br <= 0 AND x >= 2) OR br - x < -3) AS n_low,
  count(*) FILTER (NOT (br <= 0 AND x >= 2) AND br - x > 3) AS n_high, min(x) AS lowest_matched_snr_db, (SELECT max(x) FROM u) AS highest_unmatched_snr_db
FROM (SELECT signal_id, CASE WHEN isnan(br) THEN NULL ELSE br END AS br, x FROM w)""",
    "report_truth": D._P4 + """, o AS (SELECT report_id, signal_no, sig, tc, CASE WHEN json_type(sig -> '$.resolved') = 'VARCHAR' THEN CAST(sig ->> '$.resolved' AS JSON) ELSE sig -> '$.resolved' END AS res,
    CASE WHEN json_type(sig -> '$.requested') = 'VARCHAR' THEN CAST(sig ->> '$.requested' AS JSON) ELSE sig -> '$.requested' END AS req FROM (SELECT g.*, t.tc FROM g JOIN t USING (report_id, signal_no))),
f AS (SELECT *, CASE WHEN json_type(tc) = 'ARRAY' THEN tc -> '$[0]' WHEN json_type(tc) = 'OBJECT' AND json_exists(tc, '$.channel_index') THEN tc
    WHEN json_type(tc) = 'OBJECT' THEN json_extract(tc, '$."' || list_sort(json_keys(tc))[1] || '"') END AS ch FROM o),
d AS (SELECT *, coalesce(TRY_CAST(res ->> '$.start_s' AS DOUBLE), TRY_CAST(req ->> '$.start_s' AS DOUBLE), 0) AS st,
    coalesce(TRY_CAST(res ->> '$.duration_s' AS DOUBLE), TRY_CAST(req ->> '$.duration_s' AS DOUBLE), 0) AS du FROM f)
SELECT report_id, CAST(signal_no AS INTEGER) AS signal_no, coalesce(sig ->> '$.name', req ->> '$.name', printf('signal_%03d', signal_no)) AS signal_name, st AS injected_start_s, du AS injected_duration_s,
  st + du AS injected_end_s, coalesce(TRY_CAST(res ->> '$.start_freq_hz' AS DOUBLE), TRY_CAST(req ->> '$.start_freq_hz' AS DOUBLE), TRY_CAST(req ->> '$.abs_freq_hz' AS DOUBLE), 0) AS injected_start_freq_hz,
  coalesce(TRY_CAST(res ->> '$.drift_hz_per_s' AS DOUBLE), TRY_CAST(req ->> '$.drift_hz_per_s' AS DOUBLE), 0) + 0.0 AS injected_drift_hz_per_s,
  coalesce(TRY_CAST(res ->> '$.snr_db' AS DOUBLE), TRY_CAST(req ->> '$.snr_db' AS DOUBLE), 0) + 0.0 AS injected_snr_db, TRY_CAST(ch ->> '$.realized_snr_db' AS DOUBLE) AS injected_realized_snr_db,
  coalesce(sig ->> '$.snr_reference', ch ->> '$.snr_reference', 'coarse_channel') AS snr_reference,
  coalesce(TRY_CAST(sig ->> '$.requested_snr_db' AS DOUBLE), TRY_CAST(ch ->> '$.requested_snr_db' AS DOUBLE)) AS requested_snr_db,
  coalesce(TRY_CAST(sig ->> '$.requested_local_psd_snr_db' AS DOUBLE), TRY_CAST(ch ->> '$.requested_local_psd_snr_db' AS DOUBLE)) AS requested_local_psd_snr_db,
  coalesce(TRY_CAST(sig ->> '$.realized_local_psd_snr_db' AS DOUBLE), TRY_CAST(ch ->> '$.realized_local_psd_snr_db' AS DOUBLE)) AS realized_local_psd_snr_db,
  coalesce(TRY_CAST(req ->> '$.freq_tolerance_hz' AS DOUBLE), 120) AS freq_tolerance_hz, coalesce(TRY_CAST(req ->> '$.drift_tolerance_hz_per_s' AS DOUBLE), 6) AS drift_tolerance_hz_per_s,
  CAST(TRY_CAST(ch ->> '$.channel_index' AS DOUBLE) AS INTEGER) AS target_channel_index FROM d""",
    "measured_channels": f"""WITH {T._EV} SELECT event_id, CAST(coalesce(CASE WHEN representative_coarse_channel BETWEEN 0 AND 255 THEN representative_coarse_channel END,
    greatest(0, least(255, ceil((freq_hz - coalesce(lo_hz, 1e9::DOUBLE)) / {_DF} - coalesce(start_coarse_channel, 512) - 0.5))), 128) AS INTEGER) AS channel,
  CAST(greatest(1, least(17, CASE WHEN n_hits > 2 THEN ceil(n_hits * 4.0 / ({_DF} / 2048)) ELSE best_width_bins END)) AS INTEGER) AS ridge_bins
FROM e JOIN observations o ON o.obs_id = lower(trim(replace(e.obs_id, '-', '_')))""",
    "truth_quality": _PAIRS + """ SELECT signal_id, event_id, 'geometry_match_' || CASE WHEN br IS NULL OR isnan(br) OR x IS NULL THEN 'no_snr_measurement' WHEN br <= 0 AND x >= 2 THEN 'low_measured_snr'
  WHEN abs(br - x) <= 3 THEN 'measurement_consistent' WHEN br - x < -3 THEN 'measurement_low' ELSE 'measurement_high' END AS quality FROM z WHERE mx <= ft""",
    "truth_calibration": _PAIRS + """, k AS (SELECT x, br AS y FROM z WHERE mx <= ft AND x IS NOT NULL AND br IS NOT NULL AND NOT isnan(br) AND NOT isnan(x)),
f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i, count(*) AS n FROM k)
SELECT round(s, 5) + 0.0 AS slope, round(i, 5) + 0.0 AS intercept_db, round((SELECT sqrt(avg((y - s * x - i) ** 2)) FROM k), 5) + 0.0 AS rms_residual_db, n AS n_fit FROM f WHERE n >= 2""",
    "nearest_events": f"""WITH {T._EV}, i AS (SELECT DISTINCT * FROM injected_signals),
p AS (SELECT i.signal_id, e.event_id, abs(e.freq_hz - injected_start_freq_hz) AS df, abs(e.drift_hz_per_s - injected_drift_hz_per_s) AS dd, coalesce(freq_tolerance_hz, 120) AS ft, coalesce(drift_tolerance_hz_per_s, 6) AS dt
  FROM i JOIN e ON lower(trim(replace(i.obs_id, '-', '_'))) = lower(trim(replace(e.obs_id, '-', '_'))) WHERE e.freq_hz IS NOT NULL AND injected_start_freq_hz IS NOT NULL)
SELECT signal_id, event_id, round(df, 4) + 0.0 AS freq_err_hz, round(dd, 4) + 0.0 AS drift_err_hz_per_s, df <= ft AND dd <= dt AS detected FROM p
QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY df + 10 * dd, event_id) = 1""",
}
