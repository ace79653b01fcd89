"""Queries of event formation: on ``hits`` as they are, and on the valid rows of ``track_events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skydrift.operators import events as E
from skydrift.params import Runtime
from skydrift.plans.spectral import r
from skydrift.tables import canonical_obs, table

CFG = Runtime()
DT = CFG.contract.dt_s
KEYS = ["obs_id", "coarse_channel", "session"]


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid hits with reference frequency, drift and time."""
    h = table(spark, sf_dir, "hits").withColumn("obs_id", canonical_obs(F.col("obs_id")))
    ok = F.col("coarse_channel").between(0, 255) & (F.col("row1") > F.col("row0"))
    return E.with_reference(h.where(ok), CFG)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid version of each event."""
    t = table(spark, sf_dir, "track_events")
    names = [c for c in t.columns if c not in ("event_id", "ingested_at")]
    last = t.groupBy("event_id").agg(F.max(F.struct("ingested_at", *names)).alias("m"))
    return last.select("event_id", *[F.col(f"m.{c}").alias(c) for c in names]).withColumn("obs_id", canonical_obs(F.col("obs_id")))


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in sessions of an observation and channel, cut at gaps of more than 2.5 s, in order."""
    s = E.sessions(hits(spark, sf_dir), E.rows_of(CFG.coincidence.max_row_gap_s, CFG), KEYS[:2])
    return s.withColumn("pos", F.row_number().over(Window.partitionBy(*KEYS).orderBy("row0", "row1", "hit_id")))


def hit_sessions(spark, sf_dir):
    """Session of each hit."""
    return grouped(spark, sf_dir).select("hit_id", *KEYS, "pos")


def best_hits(spark, sf_dir):
    """Best hit of each session."""
    b = grouped(spark, sf_dir).groupBy(*KEYS).agg(F.max(F.struct(E.rank_key().alias("k"), "hit_id", "anchor")).alias("b"))
    return b.select(*KEYS, "b.hit_id", F.col("b.anchor").alias("peak_row"))


def channel_modes(spark, sf_dir):
    """Most frequent channel of each observation and beam."""
    return E.channel_mode(hits(spark, sf_dir), ["obs_id", "beam_id"])


def robust_tracks(spark, sf_dir):
    """Frequency and drift of each session."""
    return r(E.robust_tracks(grouped(spark, sf_dir), KEYS), "freq_hz", "drift_hz_per_s", places=4)


def inlier_hits(spark, sf_dir):
    """Hits of each session that lie on its line."""
    return E.inliers(grouped(spark, sf_dir), KEYS, CFG.candidate).select(*KEYS, "hit_id", "n_raw")


def support_rows(spark, sf_dir):
    """Rows that the hits of each session support."""
    return E.support_rows(grouped(spark, sf_dir), KEYS, CFG, CFG.tile_step)


def support_rows_inferred(spark, sf_dir):
    """The same, with the tile step taken from the hits."""
    return E.support_rows(grouped(spark, sf_dir), KEYS, CFG, None)


def event_scores(spark, sf_dir):
    """Score of each hit as an event of one hit, and the reasons."""
    gain = F.nanvl("coherent_gain_db", F.lit(None).cast("double"))
    s, why = E.score(F.lit(1), F.col("refined_snr"), F.col("incoherent_snr"), F.col("support_fraction"), gain, F.col("width_bins"), F.col("edge_distance_bins"))
    return r(hits(spark, sf_dir).select("hit_id", s.alias("score"), F.concat_ws(",", why).alias("reasons")), "score")


def event_gates(spark, sf_dir):
    """Gate reasons of each valid event."""
    e = events(spark, sf_dir).withColumn("reasons", E.gate(CFG.candidate, DT))
    return e.select("event_id", F.concat_ws(",", "reasons").alias("reasons"), E.gate_passed(F.col("reasons")).alias("passed"))


def coincident_pairs(spark, sf_dir):
    """Pairs of events seen in different beams."""
    return E.coincident_pairs(events(spark, sf_dir), CFG.coincidence, DT, "event_id").select("a", "b")


def _candidates(spark, sf_dir):
    e = events(spark, sf_dir).where("score is not null and not isnan(score)")
    return e.withColumns({"seq": F.col("event_id"), "best_f": F.col("freq_hz"), "best_t": F.coalesce("peak_row", "row0") * F.lit(DT),
                          "best_channel": F.col("representative_coarse_channel")})


def shadow_pairs(spark, sf_dir):
    """Pairs of events of which the better one excludes the other."""
    return E.suppressed(_candidates(spark, sf_dir), CFG)


def kept_events(spark, sf_dir):
    """Events that no better kept one excludes."""
    return E.deduplicate(_candidates(spark, sf_dir), CFG).select("event_id")


def _found(spark, sf_dir):
    h = table(spark, sf_dir, "hits").withColumn("obs_id", canonical_obs(F.col("obs_id")))
    return E.find_events(h.where(F.col("coarse_channel").between(0, 255)), CFG)


def found_events(spark, sf_dir):
    """Events formed from all hits."""
    e = _found(spark, sf_dir)["events"]
    return r(e.select("event_id", "obs_id", "beam_id", "row0", "row1", "freq_hz", "drift_hz_per_s", "score", "n_hits", "best_refined_snr",
                      "representative_coarse_channel", "peak_row", "coincidence_group_id", "candidate_passed", "candidate_reasons", "notes"),
             "freq_hz", "drift_hz_per_s", "score")


def found_candidates(spark, sf_dir):
    """Candidates among them."""
    return _found(spark, sf_dir)["candidates"].select("event_id", "score")


def found_coincidences(spark, sf_dir):
    """Coincidences among them."""
    return _found(spark, sf_dir)["coincidences"]


QUERIES = {f.__name__: f for f in (hit_sessions, best_hits, channel_modes, robust_tracks, inlier_hits, support_rows, support_rows_inferred, event_scores,
                                   event_gates, coincident_pairs, shadow_pairs, kept_events, found_events, found_candidates, found_coincidences)}

_DT = "(65536 / 1e9::DOUBLE)"
_NAN = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
_H = f"""h AS (SELECT hit_id, lower(trim(replace(obs_id, '-', '_'))) AS obs_id, beam_id, coarse_channel, row0, row1, incoherent_snr, {_NAN('refined_snr')} AS refined_snr,
    coalesce({_NAN('refined_freq_hz')}, {_NAN('freq_hz')}) AS ref_f, coalesce({_NAN('refined_drift_hz_per_s')}, {_NAN('drift_hz_per_s')}, 0) AS ref_d,
    {_NAN('coherent_gain_db')} AS gain, support_fraction, width_bins, edge_distance_bins,
    CAST(round_even(row0 + anchor_frame * 1024 + 1024.0, 0) AS BIGINT) AS anchor
  FROM hits WHERE coarse_channel BETWEEN 0 AND 255 AND row1 > row0),
w AS (SELECT *, anchor * {_DT} AS t, max(row1) OVER (PARTITION BY obs_id, coarse_channel ORDER BY row0, row1, hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
g AS (SELECT *, sum(CASE WHEN row0 - reach > {E.rows_of(2.5, CFG)} THEN 1 ELSE 0 END) OVER (PARTITION BY obs_id, coarse_channel ORDER BY row0, row1, hit_id ROWS UNBOUNDED PRECEDING) AS session FROM w),
s AS (SELECT *, row_number() OVER (PARTITION BY obs_id, coarse_channel, session ORDER BY row0, row1, hit_id) AS pos,
  first_value({{0}}) OVER (PARTITION BY obs_id, coarse_channel, session ORDER BY coalesce(refined_snr, -1e9) DESC, incoherent_snr DESC, row0, hit_id) AS b FROM g)"""
_S = lambda best="hit_id": _H.format(best)
_K = "obs_id, coarse_channel, CAST(session AS INTEGER) AS session"
_BEST = "{'f': ref_f, 'd': ref_d, 't': t, 's': coalesce(refined_snr, incoherent_snr)}"
_EV = """e AS (SELECT * FROM track_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC NULLS LAST) = 1)"""
_SUPPORT = lambda step: f"""WITH {_S()}, d AS (SELECT *, row0 - lag(row0) OVER (PARTITION BY obs_id, coarse_channel, session ORDER BY row0) AS step FROM s),
a AS (SELECT obs_id, coarse_channel, session, min(row0) AS lo, max(row1) AS hi, min(anchor) AS a0, max(anchor) AS a1, count(*) AS n, median(step) FILTER (step > 0) AS med FROM d GROUP BY ALL),
p AS (SELECT *, greatest(1024, {step} // 2) AS pad FROM a),
z AS (SELECT *, greatest(lo, a0 - pad) AS st, least(hi, a1 + pad) AS en FROM p)
SELECT {_K}, CAST(CASE WHEN n = 1 OR en <= st THEN lo ELSE st END AS BIGINT) AS row0, CAST(CASE WHEN n = 1 OR en <= st THEN hi ELSE en END AS BIGINT) AS row1 FROM z"""  # noqa: E731

_SHADOWS = f"""{_EV}, c AS (SELECT *, lower(trim(replace(obs_id, '-', '_'))) AS o, coalesce(peak_row, row0) * {_DT} AS t, n_hits <= 3 OR (row1 - row0) * {_DT} <= 3 AS brief
  FROM e WHERE score IS NOT NULL AND NOT isnan(score)),
p AS (SELECT a.event_id AS before, b.event_id AS after, a.brief OR b.brief AS brief, least(a.row1, b.row1) - greatest(a.row0, b.row0) AS ov, least(a.row1 - a.row0, b.row1 - b.row0) AS sh,
    coalesce(a.freq_hz, 0) + a.drift_hz_per_s * (0.5 * (greatest(a.row0, b.row0) + least(a.row1, b.row1)) * {_DT} - a.t)
    - coalesce(b.freq_hz, 0) - b.drift_hz_per_s * (0.5 * (greatest(a.row0, b.row0) + least(a.row1, b.row1)) * {_DT} - b.t) AS off
  FROM c a JOIN c b ON a.o = b.o AND a.beam_id IS NOT DISTINCT FROM b.beam_id AND a.representative_coarse_channel = b.representative_coarse_channel
    AND (a.score > b.score OR (a.score = b.score AND a.event_id < b.event_id))),
shadow AS (SELECT before, after FROM p WHERE abs(off) <= CASE WHEN brief THEN 256 ELSE 128 END
  AND CASE WHEN ov > 0 THEN brief OR ov / greatest(sh, 1) >= 0.5 ELSE -ov <= CASE WHEN brief THEN {E.rows_of(35.0, CFG)} ELSE {E.rows_of(6.0, CFG)} END END)"""

SQL = {
    "hit_sessions": f"WITH {_S()} SELECT hit_id, {_K}, CAST(pos AS INTEGER) AS pos FROM s",
    "best_hits": f"WITH {_S()} SELECT {_K}, hit_id, anchor AS peak_row FROM s WHERE hit_id = b",
    "channel_modes": f"""WITH {_S()}, n AS (SELECT obs_id, beam_id, coarse_channel, count(*) AS n FROM h GROUP BY ALL)
SELECT obs_id, beam_id, coarse_channel AS representative_coarse_channel FROM n QUALIFY row_number() OVER (PARTITION BY obs_id, beam_id ORDER BY n DESC, coarse_channel) = 1""",
    "robust_tracks": f"""WITH {_S(_BEST)}, m AS (SELECT *, median(ref_d) FILTER (ref_f IS NOT NULL) OVER k AS md, count(ref_f) OVER k AS nf FROM s WINDOW k AS (PARTITION BY obs_id, coarse_channel, session))
SELECT {_K}, round(CASE WHEN any_value(nf) >= 2 THEN median(ref_f - md * (t - b.t)) ELSE coalesce(any_value(b.f), 0) END, 4) + 0.0 AS freq_hz,
  round(CASE WHEN any_value(nf) >= 2 THEN any_value(md) ELSE any_value(b.d) END, 4) + 0.0 AS drift_hz_per_s FROM m GROUP BY obs_id, coarse_channel, session""",
    "inlier_hits": f"""WITH {_S(_BEST)}, o AS (SELECT *, count(*) OVER (PARTITION BY obs_id, coarse_channel, session) AS n_raw,
    coalesce(coalesce(refined_snr, incoherent_snr) >= greatest(14, b.s - 6) AND abs(ref_f - (b.f + b.d * (t - b.t))) <= 60, false) AS on_line FROM s),
p AS (SELECT *, on_line AND abs(ref_d - b.d) <= 2 AS strict FROM o),
q AS (SELECT *, strict OR (on_line AND row_number() OVER (PARTITION BY obs_id, coarse_channel, session, row0, on_line ORDER BY pos) = 1
    AND NOT bool_or(strict) OVER (PARTITION BY obs_id, coarse_channel, session, row0)) AS keep FROM p),
z AS (SELECT *, sum(keep::INT) OVER (PARTITION BY obs_id, coarse_channel, session) < greatest(1, least(3, n_raw)) OR n_raw < 2 OR b.f IS NULL AS everything FROM q)
SELECT {_K}, hit_id, n_raw FROM z WHERE keep OR everything""",
    "support_rows": _SUPPORT("27154"),
    "support_rows_inferred": _SUPPORT("CAST(coalesce(round_even(med, 0), greatest(1024, round_even(0.5 * (hi - lo), 0))) AS BIGINT)"),
    "event_scores": f"""WITH {_S()}, v AS (SELECT hit_id, incoherent_snr AS i, support_fraction AS u, width_bins AS w, edge_distance_bins AS e, coalesce(refined_snr, 0) AS f, coalesce(gain, -10) AS g FROM h)
SELECT hit_id, round(0.75 * f + 0.25 * i + 1.2 + 2.5 * least(1.0, u) - 2 - CASE WHEN f >= 15 THEN 0 ELSE 2.5 END - CASE WHEN g < -1 THEN 1.5 ELSE 0 END
    - 0.75 * greatest(0, w - 3) - 0.15 * greatest(0, 8 - e), 6) + 0.0 AS score,
  concat_ws(',', 'singleton_penalty', CASE WHEN f >= 15 THEN 'strong_refine' ELSE 'weak_refine' END, CASE WHEN g < -1 THEN 'negative_gain_penalty' END,
    CASE WHEN w > 3 THEN 'broad_width_penalty' END, CASE WHEN e < 8 THEN 'edge_penalty' END) AS reasons FROM v""",
    "event_gates": f"""WITH {_EV}, v AS (SELECT *, coalesce(best_refined_snr, 0) AS f, greatest(0, (row1 - row0) * {_DT}) AS dur FROM e),
z AS (SELECT event_id, CASE WHEN score < 14 THEN 'score_below_threshold' WHEN f < 15.5 THEN 'refined_snr_below_threshold' WHEN best_width_bins > 3 THEN 'width_above_threshold'
  WHEN best_support_fraction < 0.18 THEN 'support_below_threshold' WHEN n_hits < 3 THEN 'insufficient_track_hits' WHEN dur < 4 THEN 'track_duration_below_threshold'
  WHEN (n_hits <= 2 OR dur <= 2.5) AND f < 14 THEN 'short_track_refined_snr_below_threshold' WHEN (n_hits <= 2 OR dur <= 2.5) AND score < 16 THEN 'short_track_score_below_threshold'
  WHEN n_hits < 2 THEN 'singleton_without_strong_refine' WHEN n_hits <= 2 OR dur <= 2.5 THEN 'short_track_strong_refine,multi_hit_event' ELSE 'multi_hit_event' END AS reasons FROM v)
SELECT event_id, reasons, reasons LIKE '%multi_hit_event' AS passed FROM z""",
    "coincident_pairs": f"""WITH {_EV}, m AS (SELECT *, 0.5 * (row0 + row1) * {_DT} AS m FROM e)
SELECT a.event_id AS a, b.event_id AS b FROM m a JOIN m b ON a.scan_id IS NOT DISTINCT FROM b.scan_id AND a.target_id IS NOT DISTINCT FROM b.target_id AND a.event_id < b.event_id
  AND a.beam_id IS DISTINCT FROM b.beam_id AND abs(a.m - b.m) <= 0.35 AND abs(a.freq_hz - b.freq_hz) <= 40 AND abs(a.drift_hz_per_s - b.drift_hz_per_s) <= 4""",
    "shadow_pairs": f"WITH {_SHADOWS} SELECT before, after FROM shadow",
    # Event after event of each observation, beam and channel, the best first: one is kept if none of the kept excludes it.
    "kept_events": f"""WITH RECURSIVE {_SHADOWS}, x AS (SELECT after, list(before) AS excl FROM shadow GROUP BY 1),
n AS (SELECT event_id, o, coalesce(beam_id, '~null') AS bm, coalesce(representative_coarse_channel, -999999) AS ch, coalesce(excl, []) AS excl,
    row_number() OVER (PARTITION BY o, beam_id, representative_coarse_channel ORDER BY score DESC, event_id) AS n FROM c LEFT JOIN x ON x.after = c.event_id),
step AS (SELECT o, bm, ch, n, CASE WHEN true THEN [event_id] END AS kept FROM n WHERE n = 1
  UNION ALL SELECT n.o, n.bm, n.ch, n.n, CASE WHEN list_has_any(kept, excl) THEN kept ELSE list_append(kept, event_id) END
    FROM step JOIN n ON n.o = step.o AND n.bm = step.bm AND n.ch = step.ch AND n.n = step.n + 1)
SELECT unnest(kept) AS event_id FROM (SELECT kept FROM step QUALIFY row_number() OVER (PARTITION BY o, bm, ch ORDER BY n DESC) = 1)""",
}
