"""Queries of tiling, spectrograms, seeds, drift paths and refinement.

The table ``embeddings`` stands for recorded data: its label is the channel, 64 consecutive vec_ids are a tile, and each
vector is a frame of 64 powers (its squares) or 32 complex samples (its pairs). ``observations`` and ``hits`` are used as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skydrift.functions import exprs as X
from skydrift.operators import raw, search, spectra
from skydrift.params import Contract, Drift, Refine
from skydrift.tables import canonical_obs, table

KEYS = ["tile", "channel"]
NFFT, HOP, SMOOTH = 32, 16, 9
SCALE, RATE = 400.0, 32.0
CFG = Drift(seed_top_k_mean_per_channel=3, seed_top_k_max_per_channel=3, seed_min_separation_bins=8, snr_threshold=5.0, trial_chunk_size=4)
SLOPES = np.arange(-6, 7) * 0.25
REFINE = Refine(drift_half_window_hz_per_s=8.0, drift_step_hz_per_s=4.0)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile, channel, frame, power, v): frames are numbered within their tile, which has at most 64."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 64").alias("tile"), F.col("label").alias("channel"), "vec_id",
                                                  F.col("embedding").cast("array<double>").alias("v"))
    frame = (F.row_number().over(Window.partitionBy(*KEYS).orderBy("vec_id")) - 1).cast("int")
    return e.select(*KEYS, frame.alias("frame"), F.transform("v", lambda x: x * x).alias("power"), "v")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile, channel, row, word): the pairs of each vector as 16-bit words."""
    f = frames(spark, sf_dir).select(*KEYS, "frame", "v", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("k"))
    i, q = F.element_at("v", 2 * F.col("k") + 1), F.element_at("v", 2 * F.col("k") + 2)
    return f.select(*KEYS, (F.col("frame") * 32 + F.col("k")).alias("row"), X.to_word(i * SCALE, q * SCALE).alias("word"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per tile and channel, with arrays i and q in row order; a tile has at most 2048 rows."""
    d = raw.decode(words(spark, sf_dir), "word")
    s = F.array_sort(F.collect_list(F.struct("row", "i", "q")))
    return d.groupBy(*KEYS).agg(s.alias("s")).select(*KEYS, F.col("s.i").alias("i"), F.col("s.q").alias("q"))


def _stats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = spectra.matrices(frames(spark, sf_dir), KEYS)
    base = spectra.smooth(spectra.bin_medians(m, KEYS), ["tile"], "channel", SMOOTH)
    return spectra.bin_stats(spectra.normalise(m, base, KEYS), KEYS), base


def r(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Rounds results for comparison; zeros lose their sign."""
    return df.withColumns({c: F.round(c, places) + 0.0 for c in cols})


def iq_words(spark, sf_dir):
    """16-bit words decoded, and encoded again."""
    d = raw.decode(words(spark, sf_dir), "word")
    return d.select(*KEYS, "row", "word", "i", "q", X.to_word(F.col("i"), F.col("q")).alias("again"))


def stft_power(spark, sf_dir):
    """Short-time power spectra of the samples."""
    p = spectra.bins(spectra.stft(samples(spark, sf_dir), KEYS, NFFT, HOP, "hann"), KEYS)
    t = X.frame_time_s(F.col("frame"), NFFT, HOP, 1 / RATE)
    return r(p.select(*KEYS, "frame", "bin", t.alias("t_s"), X.fine_offset_hz(F.col("bin"), NFFT, RATE).alias("offset_hz"), "p"), "p", places=3)


def bin_baseline(spark, sf_dir):
    """Median and running-median baseline per bin."""
    return r(spectra.by_bin(_stats(spark, sf_dir)[1], KEYS, "med_db", "base_db"), "med_db", "base_db")


def bin_excess(spark, sf_dir):
    """Mean, maximum and 90th percentile of the normalised power, without edge bins."""
    stats = spectra.by_bin(_stats(spark, sf_dir)[0], KEYS, "mean_db", "max_db", "p90_db")
    return r(spectra.inner_bins(stats, 64, 2), "mean_db", "max_db", "p90_db")


def qc_display(spark, sf_dir):
    """Display matrix, flattened in frequency and time."""
    out, _ = spectra.qc_display(frames(spark, sf_dir), ["tile"], "channel", SMOOTH, 5, 95)
    return r(out, "db")


def qc_range(spark, sf_dir):
    """Display range of each tile."""
    _, limits = spectra.qc_display(frames(spark, sf_dir), ["tile"], "channel", SMOOTH, 5, 95)
    return r(limits, "low_db", "high_db")


def _seeds(spark, sf_dir):
    return search.seeds(_stats(spark, sf_dir)[0], KEYS, CFG, 2)


def seed_picks(spark, sf_dir):
    """Greedy picks of bins with their seed score and anchor frame."""
    return r(_seeds(spark, sf_dir).select(*KEYS, F.inline("seeds")), "score")


def drift_hits(spark, sf_dir):
    """Best drift path and width of each seed above a threshold."""
    return r(search.drift_hits(_seeds(spark, sf_dir), KEYS, SLOPES, CFG).drop("trial"), "incoherent_snr", "support_fraction")


def refine_scan(spark, sf_dir):
    """Coherent refinement of each tile around zero drift."""
    hit = F.array(F.struct(F.lit(0).alias("fine_bin"), F.lit(0.0).alias("drift_hz_per_s"), F.lit(0.0).alias("incoherent_snr")))
    out = search.refine(samples(spark, sf_dir).withColumn("hits", hit), KEYS, RATE, REFINE)
    return r(out.drop("hit_no", "coherent_gain_db"), "refined_snr", "refined_freq_offset_hz", "refined_drift_hz_per_s", places=4)


def parabolic_peak(spark, sf_dir):
    """Place of the strongest bin of each channel, between bins."""
    s = r(spectra.by_bin(_stats(spark, sf_dir)[0], KEYS, "mean_db"), "mean_db", places=9)
    w = Window.partitionBy(*KEYS).orderBy("bin")
    s = s.withColumn("at", F.col("bin") + search.parabolic_offset(F.lag("mean_db").over(w), F.col("mean_db"), F.lead("mean_db").over(w)))
    top = s.groupBy(*KEYS).agg(F.max(F.struct("mean_db", (-F.col("bin")).alias("b"), "at")).alias("m"))
    return r(top.select(*KEYS, F.col("m.at").alias("at"), F.col("m.mean_db").alias("peak_db")), "at", "peak_db")


def refine_top(spark, sf_dir):
    """The three strongest hits of each tile and channel, which would be refined."""
    h = table(spark, sf_dir, "hits").select(canonical_obs(F.col("obs_id")).alias("obs_id"), "tile_row0", "hit_id", "incoherent_snr")
    return search.top_per_tile(h, ["obs_id", "tile_row0"], 3, [F.desc_nulls_last("incoherent_snr"), F.asc("hit_id")])


def channel_axis(spark, sf_dir):
    """Centre frequency of each channel of each observation."""
    return r(raw.channel_axis(table(spark, sf_dir, "observations"), Contract()), "center_hz", places=3)


def filename_parts(spark, sf_dir):
    """Parts of the recorded files' names."""
    p = table(spark, sf_dir, "observations").select("obs_id", "source_name", "beam_id", F.explode("dat_paths").alias("path"))
    named = p.withColumn("path", F.concat(F.lit("/arc/soft_"), F.regexp_replace("source_name", " ", "-"), F.lit("_L_rx1_"), "beam_id", F.lit(".dat")))
    return raw.filename_metadata(named, "path").drop("source_name", "beam_id")


def segment_stitch(spark, sf_dir):
    """Where each file begins and ends in its observation."""
    return raw.stitch(table(spark, sf_dir, "observations"))


def interval_read(spark, sf_dir):
    """File parts that hold the rows of each hit."""
    h = table(spark, sf_dir, "hits").select("hit_id", canonical_obs(F.col("obs_id")).alias("obs_id"), "row0", "row1")
    return raw.interval_read(raw.stitch(table(spark, sf_dir, "observations")), h).select("hit_id", "seg_idx", "path", "file_row0", "file_row1")


def tile_plan(spark, sf_dir):
    """Overlapping tiles of each observation."""
    return raw.tile_plan(table(spark, sf_dir, "observations"), 31250, 4096)


def channel_choice(spark, sf_dir):
    """Hits in a chosen list of channels within limits."""
    h = raw.select_channels(table(spark, sf_dir, "hits"), "coarse_channel", 5, 200, (117, 42, 5, 117, 201))
    return h.select("hit_id", "coarse_channel")


QUERIES = {f.__name__: f for f in (iq_words, stft_power, bin_baseline, bin_excess, qc_display, qc_range, seed_picks, drift_hits, refine_scan,
                                   parabolic_peak, refine_top, channel_axis, filename_parts, segment_stitch, interval_read, tile_plan, channel_choice)}

_E = """e AS (SELECT vec_id // 64 AS tile, label AS channel, row_number() OVER (PARTITION BY vec_id // 64, label ORDER BY vec_id) - 1 AS frame,
      embedding FROM embeddings)"""
_B = _E + ", b AS (SELECT tile, channel, frame, unnest(range(64)) AS bin, CAST(unnest(embedding) AS DOUBLE) ** 2 AS p FROM e)"
_BASE = _B + f"""
, m AS (SELECT tile, channel, bin, 10 * log10(median(p) + 1e-12) AS med_db FROM b GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY channel, bin) AS k, count(*) OVER (PARTITION BY tile) AS size FROM m),
base AS (SELECT a.tile, a.channel, a.bin, a.med_db, median(z.med_db) AS base_db
  FROM (SELECT *, unnest(range({-(SMOOTH // 2)}, {SMOOTH // 2 + 1})) AS d FROM n) a JOIN n z ON z.tile = a.tile AND z.k = greatest(1, least(a.size, a.k + a.d)) GROUP BY ALL)"""
_NORM = _BASE + """
, norm AS (SELECT b.*, p / (10 ** (base_db / 10) + 1e-12) AS norm FROM b JOIN base USING (tile, channel, bin)),
stats AS (SELECT tile, channel, bin, 10 * log10(avg(norm) + 1e-12) AS mean_db, 10 * log10(max(norm) + 1e-12) AS max_db,
  10 * log10(quantile_cont(norm, 0.9) + 1e-12) AS p90_db FROM norm GROUP BY ALL)"""
_SEEDS = _NORM + """
, st AS (SELECT tile, channel, bin, round(mean_db, 9) AS mean_db, round(max_db, 9) AS max_db, round(p90_db, 9) AS p90_db FROM stats WHERE bin >= 2 AND bin < 62),
f AS (SELECT tile, channel, 'mean' AS kind, list(bin ORDER BY mean_db DESC, bin) AS rest FROM st GROUP BY ALL
  UNION ALL SELECT tile, channel, 'max', list(bin ORDER BY max_db DESC, bin) FROM st GROUP BY ALL),
pick AS (SELECT tile, channel, kind, 0 AS n, rest, CAST(NULL AS BIGINT) AS bin FROM f
  UNION ALL SELECT tile, channel, kind, n + 1, list_filter(rest, lambda x: abs(x - rest[1]) >= 8), rest[1] FROM pick WHERE n < 3 AND len(rest) > 0),
sc AS (SELECT tile, channel, bin, kind, CASE kind WHEN 'mean' THEN 0.7 * mean_db + 0.2 * max_db + 0.1 * p90_db
    ELSE 0.25 * mean_db + 0.55 * max_db + 0.2 * p90_db END AS score FROM pick JOIN st USING (tile, channel, bin) WHERE n > 0),
one AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY tile, channel, bin ORDER BY score DESC, kind = 'max') = 1),
peak AS (SELECT tile, channel, bin, frame AS anchor FROM norm QUALIFY row_number() OVER (PARTITION BY tile, channel, bin ORDER BY norm DESC, frame) = 1),
seeds AS (SELECT * FROM one JOIN peak USING (tile, channel, bin))"""
_W = _E + f""", s AS (SELECT tile, channel, frame * 32 + unnest(range(32)) AS "row", unnest(list_transform(range(32), lambda k: CAST(embedding[2 * k + 1] AS DOUBLE))) AS a,
    unnest(list_transform(range(32), lambda k: CAST(embedding[2 * k + 2] AS DOUBLE))) AS c FROM e),
d AS (SELECT tile, channel, "row", CAST(greatest(-128, least(127, round_even(a * {SCALE}, 0))) AS INTEGER) AS i,
  CAST(greatest(-128, least(127, round_even(c * {SCALE}, 0))) AS INTEGER) AS q FROM s)"""
_ROUND = "round({0}, {1}) + 0.0 AS {0}"

SQL = {
    "iq_words": f"""WITH {_W}, w AS (SELECT *, ((q + 256) % 256) * 256 + (i + 256) % 256 AS word FROM d)
SELECT tile, channel, "row", word, i, q, word AS again FROM w""",
    "stft_power": f"""WITH {_W}, c AS (SELECT tile, channel, "row", i - avg(i) OVER w AS re, q - avg(q) OVER w AS im, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY tile, channel)),
x AS (SELECT tile, channel, "row" // {HOP} - z AS frame, "row" - ("row" // {HOP} - z) * {HOP} AS k, re, im, n
  FROM (SELECT *, unnest([0, 1]) AS z FROM c)),
y AS (SELECT tile, channel, frame, k, re * (0.5 - 0.5 * cos(2 * pi() * k / {NFFT - 1})) AS re, im * (0.5 - 0.5 * cos(2 * pi() * k / {NFFT - 1})) AS im
  FROM x WHERE frame >= 0 AND k < {NFFT} AND frame < 1 + (n - {NFFT}) // {HOP}),
t AS (SELECT tile, channel, frame, bin, sum(re * cos(g) + im * sin(g)) AS re, sum(im * cos(g) - re * sin(g)) AS im
  FROM (SELECT *, 2 * pi() * (bin - {NFFT // 2}) * k / {NFFT} AS g FROM (SELECT *, unnest(range({NFFT})) AS bin FROM y)) GROUP BY ALL)
SELECT tile, channel, frame, bin, (frame * {HOP} + {NFFT / 2}) / {RATE} AS t_s, (bin - {NFFT // 2}) * {RATE / NFFT} AS offset_hz, round(re * re + im * im, 3) + 0.0 AS p FROM t""",
    "bin_baseline": f"WITH {_BASE} SELECT tile, channel, bin, {_ROUND.format('med_db', 6)}, {_ROUND.format('base_db', 6)} FROM base",
    "bin_excess": f"""WITH {_NORM} SELECT tile, channel, bin, {_ROUND.format('mean_db', 6)}, {_ROUND.format('max_db', 6)}, {_ROUND.format('p90_db', 6)}
FROM stats WHERE bin >= 2 AND bin < 62""",
    "qc_display": f"""WITH {_BASE}, q AS (SELECT b.*, 10 * log10(p + 1e-12) - base_db AS x FROM b JOIN base USING (tile, channel, bin))
SELECT tile, channel, frame, bin, round(x - median(x) OVER (PARTITION BY tile, frame), 6) + 0.0 AS db FROM q""",
    "qc_range": f"""WITH {_BASE}, q AS (SELECT b.*, 10 * log10(p + 1e-12) - base_db AS x FROM b JOIN base USING (tile, channel, bin)),
z AS (SELECT tile, x - median(x) OVER (PARTITION BY tile, frame) AS db FROM q)
SELECT tile, round(quantile_cont(db, 0.05), 6) + 0.0 AS low_db, round(quantile_cont(db, 0.95), 6) + 0.0 AS high_db FROM z GROUP BY 1""",
    "seed_picks": f"WITH RECURSIVE {_SEEDS} SELECT tile, channel, bin, kind, {_ROUND.format('score', 6)}, anchor FROM seeds",
    "drift_hits": f"""WITH RECURSIVE {_SEEDS}
, trial AS (SELECT s.*, w, (d - 6) * 0.25 AS slope, d FROM seeds s, (SELECT unnest([1, 3, 5]) AS w), (SELECT unnest(range(13)) AS d)),
size AS (SELECT tile, channel, max(frame) + 1 AS frames FROM norm GROUP BY ALL),
cell AS (SELECT t.*, fr, CAST(round_even(t.bin + slope * (fr - anchor), 0) AS BIGINT) AS centre
  FROM (SELECT trial.*, unnest(range(frames)) AS fr FROM trial JOIN size USING (tile, channel)) t),
box AS (SELECT c.tile, c.channel, c.bin, c.kind, c.anchor, c.w, c.d, c.slope, c.fr, sum(n.norm / c.w) AS v
  FROM cell c JOIN norm n ON n.tile = c.tile AND n.channel = c.channel AND n.frame = c.fr AND n.bin BETWEEN c.centre - c.w // 2 AND c.centre + c.w // 2
  WHERE c.centre - c.w // 2 >= 0 AND c.centre + c.w // 2 < 64 GROUP BY ALL),
score AS (SELECT tile, channel, bin, kind, anchor, w, d, slope, avg(CASE WHEN v > 1.5 THEN 1.0 ELSE 0.0 END) AS support,
  10 * log10(0.65 * avg(v) + 0.35 * list_avg(list_slice(list(v ORDER BY v DESC), 1, greatest(1, count(*) // 3))) + 1e-12) AS snr FROM box GROUP BY tile, channel, bin, kind, anchor, w, d, slope)
SELECT tile, channel, bin AS fine_bin, anchor AS anchor_frame, kind AS seed_kind, slope, w AS width_bins, round(snr, 6) + 0.0 AS incoherent_snr,
  round(support, 6) + 0.0 AS support_fraction, least(bin, 63 - bin) AS edge_distance_bins FROM score
QUALIFY row_number() OVER (PARTITION BY tile, channel, bin ORDER BY round(snr, 9) DESC, d // 4, w, d) = 1 AND round(snr, 9) >= 5.0""",
    "refine_scan": f"""WITH {_W}, z AS (SELECT tile, channel, "row", i - avg(i) OVER w AS i, q - avg(q) OVER w AS q, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY tile, channel)),
y AS (SELECT tile, channel, n, "row" AS k, dr, h * (i * cos(g) - q * sin(g)) AS re, h * (q * cos(g) + i * sin(g)) AS im
  FROM (SELECT *, -pi() * dr * ("row" / {RATE}) ** 2 AS g, 0.5 - 0.5 * cos(2 * pi() * "row" / (n - 1)) AS h
    FROM (SELECT *, unnest([-8.0, -4.0, 0.0, 4.0, 8.0]) AS dr FROM z))),
t AS (SELECT tile, channel, n, dr, m, sum(re * cos(g) + im * sin(g)) AS re, sum(im * cos(g) - re * sin(g)) AS im
  FROM (SELECT *, 2 * pi() * (m - n // 2) * k / n AS g FROM (SELECT *, unnest(range(n)) AS m FROM y)) GROUP BY ALL),
mag AS (SELECT tile, channel, n, dr, m, sqrt(re * re + im * im) AS s FROM t),
l AS (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS c FROM mag WINDOW w AS (PARTITION BY tile, channel, dr ORDER BY m)),
best AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY tile, channel ORDER BY round(s, 7) DESC, dr, m) = 1),
noise AS (SELECT tile, channel, median(s) + 1e-6 AS noise FROM mag WHERE dr = 0 GROUP BY ALL)
SELECT tile, channel, round(20 * log10(s / noise), 4) + 0.0 AS refined_snr, round(dr, 4) + 0.0 AS refined_drift_hz_per_s,
  round((m - n // 2 + coalesce(CASE WHEN abs(a - 2 * s + c) > 1e-9 THEN greatest(-0.5, least(0.5, 0.5 * (a - c) / (a - 2 * s + c))) END, 0)) * {RATE} / n, 4) + 0.0 AS refined_freq_offset_hz
FROM best JOIN noise USING (tile, channel)""",
    "parabolic_peak": f"""WITH {_NORM}, st AS (SELECT tile, channel, bin, round(mean_db, 9) AS y FROM stats),
l AS (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS c FROM st WINDOW w AS (PARTITION BY tile, channel ORDER BY bin))
SELECT tile, channel, round(bin + coalesce(CASE WHEN abs(a - 2 * y + c) > 1e-9 THEN greatest(-0.5, least(0.5, 0.5 * (a - c) / (a - 2 * y + c))) END, 0), 6) + 0.0 AS "at",
  round(y, 6) + 0.0 AS peak_db FROM l QUALIFY row_number() OVER (PARTITION BY tile, channel ORDER BY y DESC, bin) = 1""",
    "refine_top": """SELECT lower(trim(replace(obs_id, '-', '_'))) AS obs_id, tile_row0, hit_id, incoherent_snr FROM hits
QUALIFY row_number() OVER (PARTITION BY lower(trim(replace(obs_id, '-', '_'))), tile_row0 ORDER BY incoherent_snr DESC NULLS LAST, hit_id) <= 3""",
    "channel_axis": """SELECT obs_id, CAST(c AS INTEGER) AS channel, CASE WHEN lo_hz IS NULL OR start_coarse_channel IS NULL THEN 'relative' ELSE 'absolute' END AS mode,
  round(CASE WHEN lo_hz IS NULL OR start_coarse_channel IS NULL THEN c * (1e9::DOUBLE / 65536) ELSE lo_hz + (start_coarse_channel + c) * (1e9::DOUBLE / 65536) END, 3) + 0.0 AS center_hz
FROM (SELECT *, unnest(range(256)) AS c FROM observations)""",
    "filename_parts": """SELECT obs_id, '/arc/soft_' || replace(source_name, ' ', '-') || '_L_rx1_' || beam_id || '.dat' AS path, 'soft' AS software,
  replace(source_name, ' ', '-') AS source, 'L' AS band_label, 'rx1' AS receiver, TRY_CAST(beam_id AS INTEGER) AS beam_1based
FROM (SELECT *, unnest(dat_paths) FROM observations)""",
    "segment_stitch": """WITH s AS (SELECT obs_id, unnest(range(len(dat_paths))) AS seg_idx, unnest(dat_paths) AS path, unnest(segment_rows) AS "rows" FROM observations)
SELECT *, CAST(sum("rows") OVER w - "rows" AS BIGINT) AS row_start, CAST(sum("rows") OVER w AS BIGINT) AS row_stop FROM s WINDOW w AS (PARTITION BY obs_id ORDER BY seg_idx)""",
    "interval_read": """WITH s AS (SELECT obs_id, unnest(range(len(dat_paths))) AS seg_idx, unnest(dat_paths) AS path, unnest(segment_rows) AS n FROM observations),
g AS (SELECT *, sum(n) OVER w - n AS a, sum(n) OVER w AS z FROM s WINDOW w AS (PARTITION BY obs_id ORDER BY seg_idx))
SELECT hit_id, seg_idx, path, CAST(greatest(row0, a) - a AS BIGINT) AS file_row0, CAST(least(row1, z) - a AS BIGINT) AS file_row1
FROM hits h JOIN g ON g.obs_id = lower(trim(replace(h.obs_id, '-', '_'))) AND a < row1 AND z > row0 AND row1 > row0""",
    "tile_plan": """SELECT obs_id, k AS tile, k * 27154 AS row0, least(k * 27154 + 31250, n_rows) AS row1
FROM (SELECT obs_id, n_rows, unnest(range(CAST(greatest(0, ceil((n_rows - 31250) / 27154.0)) AS BIGINT) + 1)) AS k FROM observations WHERE n_rows > 0)""",
    "channel_choice": "SELECT hit_id, coarse_channel FROM hits WHERE coarse_channel IN (117, 42, 5)",
}
