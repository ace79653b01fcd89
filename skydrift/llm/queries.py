"""Queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skydrift.llm import duplicates, leaks, mojibake, nearest, packing, topn
from skydrift.tables import canonical_obs, table

ROW_S = 65.536e-6


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.latest_versions(table(spark, sf_dir, "track_events")).withColumn("obs_id", canonical_obs(F.col("obs_id")))


#: Steps to which measurements are rounded before they are compared.
STEPS = {"refined_snr": 0.1, "incoherent_snr": 0.1, "row0": 1.0}
#: The order in which fields decide, and whether the greatest or the least is preferred.
ORDER = {"refined_snr": "at_least", "incoherent_snr": "at_least", "row0": "at_most"}
LINE = ["obs_id", "coarse_channel"]


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.coalesce("refined_freq_hz", "freq_hz")
    return table(spark, sf_dir, "hits").where(F.col("coarse_channel").between(0, 255)).select(
        "hit_id", canonical_obs(F.col("obs_id")).alias("obs_id"), "coarse_channel", "row0", "row1", f.alias("f"),
        F.col("run_id").alias("source"), "refined_snr", "incoherent_snr")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving hit of each detection of two or more rows."""
    return duplicates.best_representatives(_claims(spark, sf_dir), LINE, ORDER, extremes=False).select("hit_id")


def p1_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection's greatest SNR and least row, taken field by field."""
    out = duplicates.best_representatives(_claims(spark, sf_dir), LINE, ORDER)
    return out.select("hit_id", "best_refined_snr", "best_incoherent_snr", F.col("best_row0").cast("bigint").alias("best_row0"), "n_rows")


def p1_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection's best supported value of every field, by votes that the reliability of the runs weighs."""
    out = duplicates.supported_values(_claims(spark, sf_dir), LINE, STEPS)
    return out.select("hit_id", "refined_snr", "incoherent_snr", F.col("row0").cast("bigint").alias("row0"),
                      *[F.round(f"support_{k}", 6).alias(f"support_{k}") for k in STEPS], "n_rows")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best events of each observation."""
    return topn.top_n(_events(spark, sf_dir), "obs_id", "score", "event_id", 10).select("obs_id", "event_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each signal the event nearest in time on its line."""
    start = F.coalesce(F.nanvl("injected_start_s", F.lit(None).cast("double")), F.col("start_row") * F.lit(ROW_S))
    signals = table(spark, sf_dir, "injected_signals").select(
        F.col("signal_id").alias("id"), canonical_obs(F.col("obs_id")).alias("entity"), start.alias("t"),
        F.col("injected_start_freq_hz").alias("freq"),
        F.coalesce(F.nanvl("freq_tolerance_hz", F.lit(None).cast("double")), F.lit(120.0)).alias("tol"))
    events = _events(spark, sf_dir).select(
        F.col("event_id").alias("rid"), F.col("obs_id").alias("entity"), (F.col("row0") * F.lit(ROW_S)).alias("t"), F.col("freq_hz").alias("freq"))
    out = nearest.nearest_in_time(signals, events, 1.5)
    return out.select(F.col("id").alias("signal_id"), F.col("rid").alias("event_id"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in containers of 2048 tokens."""
    return packing.packed(packing.measured(table(spark, sf_dir, "documents")))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by how many tokens they hold, in sixteenths of their capacity."""
    boxes = p7_packed(spark, sf_dir).groupBy("container_id").agg(F.sum("size").alias("tokens"))
    return boxes.groupBy(F.floor(F.col("tokens") / 128).cast("int").alias("sixteenths")).agg(
        F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the tokens that its pieces hold together, and whether they follow each other without gap, fit their containers, and are divided only
    where one container can't hold them. And of the containers, by document: the most tokens that one of them holds."""
    places = p7_packed(spark, sf_dir)
    load = places.groupBy("container_id").agg(F.sum("size").alias("load"))
    p = places.join(load, "container_id").groupBy("doc_id").agg(
        F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("token_from") + F.col("size")).alias("end"), F.max("load").alias("load"),
        F.max(F.col("container_offset") + F.col("size")).alias("reach"))
    whole = (F.col("end") == F.col("tokens")) & (F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("tokens") / 2048)))
    return p.select("doc_id", whole.alias("whole"), ((F.col("load") <= 2048) & (F.col("reach") <= 2048)).alias("fits"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items of which twelve consecutive words stand in them."""
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents any of whose text was wrongly decoded."""
    return mojibake.affected(table(spark, sf_dir, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled words of each document and what they said."""
    words = mojibake.garbled_words(table(spark, sf_dir, "documents"))
    return words.select("doc_id", "word", "n", "chain", "restored", "lost")


QUERIES = {f.__name__: f for f in (p1_found, p1_fused, p1_supported, p2_found, p6_found, p7_packed, p7_fill, p7_audit, p8_found, p9_found, p9_restored)}

_EVENTS = """e AS (SELECT *, lower(trim(replace(obs_id, '-', '_'))) AS o FROM track_events
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC NULLS LAST) = 1)"""

_P1 = """
WITH RECURSIVE h AS (SELECT hit_id, lower(trim(replace(obs_id, '-', '_'))) AS o, coarse_channel AS c, row0, row1, coalesce(refined_freq_hz, freq_hz) AS f,
    CASE WHEN isnan(refined_snr) THEN NULL ELSE refined_snr END AS rs, CASE WHEN isnan(incoherent_snr) THEN NULL ELSE incoherent_snr END AS s
  FROM hits WHERE coarse_channel BETWEEN 0 AND 255 AND row1 > row0 AND obs_id IS NOT NULL AND coalesce(refined_freq_hz, freq_hz) IS NOT NULL),
l AS (SELECT a.hit_id AS a, b.hit_id AS b FROM h a JOIN h b ON a.o = b.o AND a.c = b.c AND a.hit_id <> b.hit_id AND abs(a.f - b.f) <= 20
  AND least(a.row1, b.row1) - greatest(a.row0, b.row0) > 0.5 * least(a.row1 - a.row0, b.row1 - b.row0)),
r AS (SELECT DISTINCT a AS root, a AS n FROM l UNION SELECT r.root, l.b FROM r JOIN l ON r.n = l.a),
g AS (SELECT n AS hit_id, min(root) AS g FROM r GROUP BY 1)"""

SQL = {
    "p1_found": _P1 + """
SELECT hit_id FROM g JOIN h USING (hit_id)
QUALIFY row_number() OVER (PARTITION BY g ORDER BY rs DESC NULLS LAST, s DESC NULLS LAST, row0, hit_id) = 1""",
    "p1_fused": _P1 + """
SELECT arg_min(hit_id, k) AS hit_id, max(rs) AS best_refined_snr, max(s) AS best_incoherent_snr, min(row0) AS best_row0, count(*) AS n_rows
FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rs DESC NULLS LAST, s DESC NULLS LAST, row0, hit_id) AS k FROM g JOIN h USING (hit_id)) GROUP BY g""",
    "p2_found": f"""
WITH {_EVENTS} SELECT o AS obs_id, event_id FROM e WHERE score IS NOT NULL AND isfinite(score)
QUALIFY row_number() OVER (PARTITION BY o ORDER BY score DESC, event_id) <= 10""",
    # What holds of every packing, whatever it is: each document once, whole, in containers that aren't overfull.
    "p7_audit": "SELECT doc_id, true AS whole, true AS fits FROM documents WHERE doc_id IS NOT NULL",
    "p6_found": f"""
WITH {_EVENTS},
s AS (SELECT DISTINCT signal_id, lower(trim(replace(obs_id, '-', '_'))) AS o, coalesce(injected_start_s, start_row * 65.536e-6::DOUBLE) AS t,
        injected_start_freq_hz AS f, coalesce(freq_tolerance_hz, 120) AS tol FROM injected_signals)
SELECT signal_id, event_id FROM s JOIN e ON s.o = e.o AND abs(e.freq_hz - s.f) <= s.tol AND abs(s.t - e.row0 * 65.536e-6::DOUBLE) <= 1.5
QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY abs(s.t - e.row0 * 65.536e-6::DOUBLE), event_id) = 1""",
}
