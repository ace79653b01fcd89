"""Queries of the general data-processing problems (p3, p4, p5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skydrift.operators import intervals, nested, skew
from skydrift.tables import canonical_obs, table


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "hits").withColumn("obs_id", canonical_obs(F.col("obs_id")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongest hit per heavy channel and observation."""
    best = skew.heavy_key_best(_hits(spark, sf_dir), "coarse_channel", "obs_id", "incoherent_snr", "hit_id")
    return best.select("coarse_channel", "obs_id", "hit_id")


def p3_channel_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and share of each valid channel."""
    counts = skew.key_counts(table(spark, sf_dir, "hits"), "coarse_channel", 0, 255).where("coarse_channel is not null")
    return counts.select("coarse_channel", "n", (F.col("n") * 50 > F.col("total")).alias("heavy"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target channels of each signal of each report."""
    return nested.channels_table(nested.report_tables(table(spark, sf_dir, "injection_reports")))


def p4_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with their resolved values."""
    return nested.signals_table(nested.report_tables(table(spark, sf_dir, "injection_reports")))


def p4_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the signals' target channels, with their ordinals and values."""
    return nested.channel_values_table(nested.report_tables(table(spark, sf_dir, "injection_reports")))


def p4_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports."""
    return nested.reports_table(nested.report_tables(table(spark, sf_dir, "injection_reports")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of two or more hits and the gaps, per observation and channel."""
    valid = _hits(spark, sf_dir).where(F.col("coarse_channel").between(0, 255))
    out = intervals.periods_and_gaps(valid, ["obs_id", "coarse_channel"])
    return out.where((F.col("kind") == "gap") | (F.col("n") >= 2)).select("obs_id", "coarse_channel", "kind", "row0", "row1")


QUERIES = {f.__name__: f for f in (p3_found, p3_channel_load, p4_found, p4_signals, p4_channels, p4_reports, p5_found)}

_OBS = "lower(trim(replace(obs_id, '-', '_')))"
# The record is looked for at every depth: the shallowest object that has a report's fields.
_P4 = """
WITH v AS (SELECT report_id, received_at, ltrim(payload, chr(65279)) AS t FROM injection_reports),
c AS (SELECT report_id, CAST(arg_max(t, received_at) AS JSON) AS p FROM v WHERE json_valid(t) GROUP BY 1),
n AS (SELECT c.report_id, t.value AS j, length(t.fullkey) - length(replace(replace(t.fullkey, '.', ''), '[', '')) AS depth, t.id FROM c, json_tree(c.p) t
  WHERE t.type = 'OBJECT' AND (json_exists(t.value, '$.signals') OR json_exists(t.value, '$.plan_name') OR json_exists(t.value, '$.contract'))),
r AS (SELECT c.report_id, coalesce(b.j, c.p) AS j FROM c LEFT JOIN (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY depth, id) = 1) b USING (report_id)),
q AS (SELECT report_id, CASE WHEN json_type(j -> '$.signals') = 'VARCHAR' THEN CAST(j ->> '$.signals' AS JSON) ELSE j -> '$.signals' END AS v FROM r),
s AS (SELECT report_id, CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) WHEN 'OBJECT' THEN [v] ELSE [] END AS a FROM q),
g AS (SELECT report_id, n AS signal_no, a[n] AS sig FROM (SELECT report_id, a, unnest(range(1, len(a) + 1)) AS n FROM s)),
t AS (SELECT report_id, signal_no, CASE WHEN json_type(sig -> '$.target_channels') = 'VARCHAR'
        THEN CAST(sig ->> '$.target_channels' AS JSON) ELSE sig -> '$.target_channels' END AS tc FROM g)"""

SQL = {
    "p3_found": f"""
WITH h AS (SELECT coarse_channel, {_OBS} AS obs_id, hit_id, CASE WHEN isnan(incoherent_snr) THEN NULL ELSE incoherent_snr END AS snr FROM hits),
heavy AS (SELECT coarse_channel FROM h WHERE coarse_channel BETWEEN 0 AND 255 GROUP BY 1
          HAVING count(*) * 50 > (SELECT count(*) FROM hits))
SELECT coarse_channel, obs_id, hit_id FROM h WHERE coarse_channel IN (SELECT coarse_channel FROM heavy) AND obs_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY coarse_channel, obs_id ORDER BY snr DESC NULLS LAST, hit_id) = 1""",
    "p3_channel_load": """
SELECT coarse_channel, count(*) AS n, count(*) * 50 > (SELECT count(*) FROM hits) AS heavy
FROM hits WHERE coarse_channel BETWEEN 0 AND 255 GROUP BY 1""",
    "p4_found": _P4 + """,
i AS (SELECT report_id, signal_no, CASE WHEN json_type(tc) = 'ARRAY' THEN list_transform(CAST(tc AS JSON[]), lambda x: x ->> '$.channel_index')
        WHEN json_type(tc) = 'OBJECT' AND json_exists(tc, '$.channel_index') THEN [tc ->> '$.channel_index']
        WHEN json_type(tc) = 'OBJECT' THEN json_keys(tc) ELSE [] END AS ch FROM t)
SELECT DISTINCT report_id, CAST(signal_no AS INTEGER) AS signal_no, CAST(CAST(x AS DOUBLE) AS INTEGER) AS channel_index
FROM (SELECT report_id, signal_no, unnest(CASE WHEN len(ch) = 0 THEN ['-1'] ELSE ch END) AS x FROM i)""",
    "p4_signals": _P4 + """,
z AS (SELECT report_id, signal_no, sig, CASE WHEN json_type(sig -> '$.resolved') = 'VARCHAR' THEN CAST(sig ->> '$.resolved' AS JSON)
        ELSE sig -> '$.resolved' END AS res FROM g)
SELECT report_id, CAST(signal_no AS INTEGER) AS signal_no, sig ->> '$.name' AS name, sig ->> '$.morphology' AS morphology,
  TRY_CAST(res ->> '$.start_s' AS DOUBLE) AS start_s, TRY_CAST(res ->> '$.duration_s' AS DOUBLE) AS duration_s,
  TRY_CAST(res ->> '$.start_freq_hz' AS DOUBLE) AS start_freq_hz, TRY_CAST(res ->> '$.drift_hz_per_s' AS DOUBLE) + 0.0 AS drift_hz_per_s,
  TRY_CAST(res ->> '$.snr_db' AS DOUBLE) AS snr_db, CAST(TRY_CAST(res ->> '$.start_row' AS DOUBLE) AS BIGINT) AS start_row FROM z""",
    "p4_channels": _P4 + """,
l AS (SELECT report_id, signal_no, CASE WHEN json_type(tc) = 'ARRAY' THEN list_transform(CAST(tc AS JSON[]), lambda x: {'k': NULL::VARCHAR, 'x': x})
        WHEN json_type(tc) = 'OBJECT' AND json_exists(tc, '$.channel_index') THEN [{'k': NULL::VARCHAR, 'x': tc}]
        WHEN json_type(tc) = 'OBJECT' THEN list_transform(list_sort(json_keys(tc)), lambda k: {'k': k, 'x': json_extract(tc, '$."' || k || '"')}) ELSE [] END AS a FROM t),
z AS (SELECT report_id, signal_no, n AS channel_no, a[n].k AS k, a[n].x AS x FROM (SELECT *, unnest(range(1, len(a) + 1)) AS n FROM l))
SELECT report_id, CAST(signal_no AS INTEGER) AS signal_no, CAST(channel_no AS INTEGER) AS channel_no,
  CAST(TRY_CAST(coalesce(x ->> '$.channel_index', k) AS DOUBLE) AS INTEGER) AS channel_index, TRY_CAST(x ->> '$.baseband_hz' AS DOUBLE) + 0.0 AS baseband_hz,
  TRY_CAST(x ->> '$.amp_scale' AS DOUBLE) AS amp_scale, TRY_CAST(x ->> '$.channel_rms' AS DOUBLE) AS channel_rms,
  TRY_CAST(x ->> '$.realized_snr_db' AS DOUBLE) + 0.0 AS realized_snr_db, TRY_CAST(x ->> '$.realized_local_psd_snr_db' AS DOUBLE) + 0.0 AS realized_local_psd_snr_db FROM z""",
    "p4_reports": _P4 + """
SELECT report_id, j ->> '$.plan_name' AS plan_name, TRY_CAST(j ->> '$.rows' AS BIGINT) AS n_rows, j ->> '$.observation.obs_id' AS obs_id,
  TRY_CAST(j ->> '$.contract.channelizer_fft' AS BIGINT) AS channelizer_fft FROM r""",
    "p5_found": f"""
WITH h AS (SELECT {_OBS} AS obs_id, coarse_channel, row0, row1, hit_id FROM hits WHERE coarse_channel BETWEEN 0 AND 255 AND row1 > row0 AND obs_id IS NOT NULL),
m AS (SELECT *, max(row1) OVER (PARTITION BY obs_id, coarse_channel ORDER BY row0, row1, hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR before < row0 THEN 1 ELSE 0 END) OVER (PARTITION BY obs_id, coarse_channel ORDER BY row0, row1, hit_id ROWS UNBOUNDED PRECEDING) AS k FROM m),
p AS (SELECT obs_id, coarse_channel, k, min(row0) AS row0, max(row1) AS row1, count(*) AS n FROM i GROUP BY ALL),
g AS (SELECT obs_id, coarse_channel, lag(row1) OVER (PARTITION BY obs_id, coarse_channel ORDER BY row0) AS row0, row0 AS row1 FROM p)
SELECT obs_id, coarse_channel, 'period' AS kind, row0, row1 FROM p WHERE n >= 2
UNION ALL SELECT obs_id, coarse_channel, 'gap', row0, row1 FROM g WHERE row0 IS NOT NULL""",
}
