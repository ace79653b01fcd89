"""From recordings to candidates, review tables, injections and benchmarks.

Rows of the source are channels of tiles. Spectrograms, seeds, drift paths and refinement are the operators that the queries
run, and give a bounded number of hits per tile. Events are formed from the hits.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skydrift.functions import exprs as X
from skydrift.operators import compare, events, inject, measure, nested, raw, search, spectra
from skydrift.params import Runtime
from skydrift.sources import iq_dat, tables_out
from skydrift.tables import materialize

def search_tiles(tiles: DataFrame, cfg: Runtime) -> DataFrame:
    """Hits of tiles as the source gives them, refined: the operators of ``spectra`` and ``search`` one after the other.

    Between scan and hits, one number per channel and bin is shuffled for the baseline, and meets its channel's samples again.
    """
    stft, base, drift, con = cfg.search_stft, cfg.baseline, cfg.drift, cfg.contract
    keys, tile = ["obs_id", "row0", "row1", "channel"], ["obs_id", "row0", "row1"]
    m = spectra.spectrograms(tiles, keys, stft.nfft, stft.hop, stft.window)
    level = materialize(spectra.smooth(spectra.bin_medians(m, keys), tile, "channel", base.smooth_bins))
    stats = spectra.bin_stats(spectra.normalise(m, level, keys), keys)
    grid = search.drift_grid(drift)
    fine = con.df_hz / stft.nfft
    found = search.drift_hits(search.seeds(stats, keys, drift, base.edge_bins_per_coarse), keys, grid * (stft.hop * con.dt_s / fine), drift)
    rate = F.element_at(F.array(*[F.lit(float(d)) for d in grid]), F.col("trial") + 1)
    found = materialize(found.withColumn("drift_hz_per_s", rate).drop("slope", "trial"))
    none = F.lit(None).cast("double")
    refined = {"refined_snr": none, "refined_offset_hz": none, "refined_drift_hz_per_s": none, "coherent_gain_db": none}
    if cfg.refine.enabled:
        best = search.top_per_tile(found, tile, cfg.refine.top_n, [F.desc("incoherent_snr"), F.asc("channel"), F.asc("fine_bin")])
        best = materialize(best.withColumn("hit_no", F.row_number().over(Window.partitionBy(*keys).orderBy("fine_bin")) - 1))
        lists = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("hit_no", "fine_bin", "drift_hz_per_s", "incoherent_snr"))).alias("hits"))
        again = search.refine(tiles.select(*keys, "i", "q").join(lists, keys), keys, con.df_hz, cfg.refine, ridge=True).where(F.col("refined_snr") >= cfg.refine.min_refined_snr)
        found = best.join(again.withColumnRenamed("refined_freq_offset_hz", "refined_offset_hz"), [*keys, "hit_no"])
        refined = {k: F.col(k) for k in refined}
    return found.select("obs_id", F.col("row0").alias("tile_row0"), F.col("row1").alias("tile_row1"), "row0", "row1", F.col("channel").alias("coarse_channel"), "fine_bin", "anchor_frame",
                        ((F.col("fine_bin") - stft.nfft // 2) * fine).alias("fine_offset_hz"), "drift_hz_per_s", "incoherent_snr", "width_bins", F.lit("spark").alias("backend"), "seed_kind",
                        "support_fraction", "edge_distance_bins", *[v.alias(k) for k, v in refined.items()])


def observations_table(spark: SparkSession, observations: list[dict], cfg: Runtime) -> DataFrame:
    """Observations of a manifest as a table; the axis falls back to the configuration's."""
    con = cfg.contract
    rows = [(o["obs_id"], [str(p) for p in o["dat_paths"]], [iq_dat.file_rows(p, con) for p in o["dat_paths"]], *[o.get(k) for k in ("beam_id", "pol_id", "scan_id", "target_id")],
             con.lo_hz if o.get("lo_hz") is None else o["lo_hz"], con.start_coarse_channel if o.get("start_coarse_channel") is None else o["start_coarse_channel"]) for o in observations]
    return spark.createDataFrame(rows, "obs_id string, dat_paths array<string>, segment_rows array<bigint>, beam_id string, pol_id string, scan_id string, target_id string, "
                                       "lo_hz double, start_coarse_channel int")


def find_hits(spark: SparkSession, observations: list[dict], cfg: Runtime) -> DataFrame:
    """Hits of recordings, with absolute frequencies where the axis is known."""
    d = cfg.drift
    chosen = [c for c in (dict.fromkeys(d.channel_list) if d.channel_list is not None else range(cfg.contract.channels))
              if (d.channel_min is None or c >= d.channel_min) and (d.channel_max is None or c <= d.channel_max)]
    tiles = iq_dat.load(spark, observations, cfg.contract, cfg.search_tile_rows, cfg.search_overlap_rows, chosen)
    h = search_tiles(tiles, cfg).join(observations_table(spark, observations, cfg).drop("dat_paths", "segment_rows"), "obs_id")
    known = F.col("lo_hz").isNotNull() & F.col("start_coarse_channel").isNotNull()
    centre = F.when(known, F.col("lo_hz") + (F.col("start_coarse_channel") + F.col("coarse_channel")) * F.lit(cfg.contract.df_hz)).otherwise(F.col("coarse_channel") * F.lit(cfg.contract.df_hz))
    h = h.withColumns({"freq_hz": centre + F.col("fine_offset_hz"), "refined_freq_hz": centre + F.col("refined_offset_hz"),
                       "hit_id": F.xxhash64("obs_id", "row0", "coarse_channel", "fine_bin")})
    return h.drop("fine_offset_hz", "refined_offset_hz", "lo_hz", "start_coarse_channel")


def search_run(spark: SparkSession, observations: list[dict], cfg: Runtime, run_dir: str | None = None) -> dict[str, DataFrame]:
    """Hits, events, candidates and coincidences of recordings; written as JSON lines if a folder is given."""
    hits = materialize(find_hits(spark, observations, cfg))
    out = {k: v for k, v in events.find_events(hits, cfg).items() if k != "hits"} | {"hits": hits}
    if run_dir:
        Path(run_dir).mkdir(parents=True, exist_ok=True)
        for name, df in out.items():
            tables_out.write_jsonl(df, f"{run_dir}/{name}.jsonl")
        tables_out.write_summary(f"{run_dir}/summary.json", {f"n_{k}": v.count() for k, v in out.items()})
        tables_out.write_summary(f"{run_dir}/run_metadata.json", {"observations": observations, "tile_rows": cfg.search_tile_rows, "nfft": cfg.search_stft.nfft})
    return out


def event_frames(spark: SparkSession, evts: DataFrame, observations: list[dict], cfg: Runtime) -> DataFrame:
    """(event_id, frame, power) over each event's rows and channel, widened to one frame at least; only those are read."""
    obs = observations_table(spark, observations, cfg)
    total = F.aggregate("segment_rows", F.lit(0).cast("long"), lambda a, x: a + x)
    nfft = cfg.search_stft.nfft
    e = evts.join(obs.select("obs_id", total.alias("total"), "lo_hz", "start_coarse_channel"), "obs_id")
    e = e.withColumn("channel", measure.choose_channel(F.col("representative_coarse_channel"), F.col("freq_hz"), F.col("lo_hz"), F.col("start_coarse_channel"), cfg.contract))
    row1 = F.least("total", F.greatest("row1", F.col("row0") + nfft))
    e = e.withColumn("row1", row1).withColumn("row0", F.greatest(F.lit(0), F.least("row0", F.col("row1") - nfft))).where(F.col("row1") - F.col("row0") >= nfft)
    parts = raw.interval_read(raw.stitch(obs), e.select("event_id", "obs_id", "channel", "row0", "row1"))
    one = parts.groupBy("event_id", "channel", "row0").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "path", F.col("file_row0").alias("a"), F.col("file_row1").alias("b")))).alias("parts"))
    s = iq_dat.samples_of_parts(one, ["event_id", "row0"], cfg.contract)
    return spectra.stft(s, ["event_id", "row0"], nfft, cfg.search_stft.hop, cfg.search_stft.window)


def review(spark: SparkSession, evts: DataFrame, observations: list[dict], cfg: Runtime) -> DataFrame:
    """Each event with its local signal-to-noise and the evidence of its aligned profile."""
    con, stft = cfg.contract, cfg.search_stft
    fine = con.df_hz / stft.nfft
    frames = materialize(event_frames(spark, evts, observations, cfg))
    obs = observations_table(spark, observations, cfg).select("obs_id", "lo_hz", "start_coarse_channel")
    known = F.col("lo_hz").isNotNull() & F.col("start_coarse_channel").isNotNull()
    centre = F.when(known, F.col("lo_hz") + (F.col("start_coarse_channel") + F.col("representative_coarse_channel")) * F.lit(con.df_hz)).otherwise(
        F.col("representative_coarse_channel") * F.lit(con.df_hz))
    first = frames.groupBy("event_id").agg(F.first("row0").alias("first_row"))
    t0 = (F.col("first_row") + stft.nfft / 2) * F.lit(con.dt_s) - F.col("peak_row") * F.lit(con.dt_s)
    track = evts.join(obs, "obs_id").join(first, "event_id").select(
        "event_id", ((F.col("freq_hz") + F.col("drift_hz_per_s") * t0 - centre) / fine + stft.nfft // 2).alias("at"),
        (F.col("drift_hz_per_s") * stft.hop * con.dt_s / fine).alias("slope"),
        measure.ridge_width(F.lit(None).cast("double"), F.col("best_width_bins"), fine, cfg.measurement).alias("ridge"), F.lit(stft.nfft).alias("n_bins"))
    snr = measure.local_snr(frames.drop("row0"), track.drop("n_bins"), ["event_id"], cfg.measurement, measure.enbw_bins(stft.nfft, stft.window))
    b = spectra.bins(frames, ["event_id"])
    mid = b.groupBy("event_id").agg(F.percentile("p", F.lit(0.5)).alias("m"))
    flat = b.join(mid, "event_id").withColumn("db", X.db(F.col("p") / (F.col("m") + X.EPS)))
    profile = measure.aligned_profile(flat, track, ["event_id"], cfg.review.aligned_half_width_bins)
    seen = measure.profile_evidence(profile, ["event_id"], cfg.review.aligned_profile_guard_bins, cfg.review.visual_evidence_min_peak_excess_db, cfg.review.visual_evidence_min_center_excess_db)
    return evts.join(snr, "event_id", "left").join(seen, "event_id", "left")


def report_signals(spark: SparkSession, report: str) -> DataFrame:
    """Signals of an injection report as truth."""
    payload = spark.read.text(report, wholetext=True).select(F.lit(0).cast("long").alias("report_id"), F.current_timestamp().alias("received_at"), F.col("value").alias("payload"))
    tables = nested.report_tables(payload)
    own = tables["signal"].select("signal_no", F.coalesce(F.try_variant_get("doc", "$.obs_id", "string"), F.lit("")).alias("obs_id"))
    return materialize(nested.truth_table(tables).join(own, "signal_no").withColumn("signal_id", F.col("signal_no").cast("long")).drop("report_id", "signal_no"))


def compare_with_truth(evts: DataFrame, signals: DataFrame, cfg: Runtime) -> DataFrame:
    """Every signal and event once, with errors, quality, and nominal and calibrated SNR of the matched."""
    e = compare.event_times(evts, cfg.contract.dt_s)
    m = materialize(compare.match(signals, e))
    rows = compare.three_way(signals, e, m).join(signals.drop("obs_id"), "signal_id", "left").join(m.drop("best_refined_snr"), ["signal_id", "event_id"], "left")
    extra = [c for c in ("best_refined_snr", "band_excess_snr_db") if c in evts.columns]
    rows = rows.join(evts.select("event_id", *extra), "event_id", "left")
    rows = rows.withColumns({"reference_snr_db": compare.reference_snr(rows.columns), "estimated_raw_snr_db": F.col("best_refined_snr") - compare.nominal_gain_db(cfg.search_tile_rows)})
    if "band_excess_snr_db" in extra:
        rows = rows.withColumn("match_quality", F.when(F.col("match_status") == "matched", compare.quality(F.col("band_excess_snr_db"), F.col("reference_snr_db"))))
    fit = compare.calibration(rows.where("match_status = 'matched'"), "reference_snr_db", "best_refined_snr")
    return compare.calibrated(rows, fit, "best_refined_snr")


def review_build(spark: SparkSession, run_dir: str, observations: list[dict], cfg: Runtime, scope: str = "candidates", top: int | None = None, report: str | None = None,
                 review_dir: str | None = None) -> DataFrame:
    """Measures the events or candidates of a run, and writes the index, and the comparison if there is a report."""
    evts = spark.read.json(f"{run_dir}/events.jsonl")
    for name, kind in (("best_refined_snr", "double"), ("coincidence_group_id", "string"), ("best_width_bins", "int")):
        evts = evts.withColumn(name, F.col(name).cast(kind)) if name in evts.columns else evts.withColumn(name, F.lit(None).cast(kind))
    done = materialize(review(spark, measure.select_records(evts, scope, top, cfg.review.top_k), observations, cfg))
    out = review_dir or f"{run_dir}/{'review_all_events' if scope == 'all-events' else 'review'}"
    Path(out).mkdir(parents=True, exist_ok=True)
    tables_out.write_jsonl(done, f"{out}/index.json")
    tables_out.write_csv(done, f"{out}/index.csv")
    tables_out.write_html(done, f"{out}/index.html", "events")
    if report:
        rows = materialize(compare_with_truth(done, report_signals(spark, report), cfg))
        tables_out.write_jsonl(rows, f"{out}/injection_comparison.json")
        tables_out.write_csv(rows, f"{out}/injection_comparison.csv")
        tables_out.write_html(rows, f"{out}/injection_comparison.html", "injected and found")
        tables_out.write_summary(f"{out}/injection_comparison_summary.json", compare.summary(rows).first().asDict())
    return done


def inject_signals(spark: SparkSession, base: str, plan: dict, cfg: Runtime, out_dir: str) -> dict:
    """Adds a plan's signals to a recording: writes files, report and manifest, and returns the report."""
    from skydrift.sources.config import save_manifest

    con = cfg.contract
    lo, first = 1e9 if con.lo_hz is None else con.lo_hz, 27392 if con.start_coarse_channel is None else con.start_coarse_channel
    names = sorted({k for s in plan["signals"] for k in s if k != "beams"})
    rows = [{k: (float(v) if isinstance(v, int) else v) for k, v in s.items() if k != "beams"} for s in plan["signals"]]
    kinds = {k: "string" if k in ("name", "morphology", "amplitude_taper", "snr_reference", "noise_estimator") else "double" for k in names}
    given = spark.createDataFrame([(n, *[r.get(k) for k in names]) for n, r in enumerate(rows)], "signal_no int, " + ", ".join(f"{k} {t}" for k, t in kinds.items()))
    s = inject.complete(given)
    ch, offset = inject.nearest_channel(F.col("abs_freq_hz"), F.lit(lo), F.lit(first), con)
    s = inject.out_of_channel(s.withColumns({"base_channel": ch, "baseband_hz": offset}), con)
    bad = s.where("not fits").select("name", "excursion_hz").first()
    if bad:
        raise ValueError(f"{bad['name']}: {bad['excursion_hz']:.1f} Hz don't fit into one channel")
    targets = materialize(inject.target_channels(s, con).withColumn("obs_id", F.lit("base")))
    touched = sorted(r[0] for r in targets.select("channel").distinct().collect())  # no more than the contract's channels
    tiles = iq_dat.load(spark, [{"obs_id": "base", "dat_paths": [base]}], con, 65536, 0, touched)
    cells = tiles.select("obs_id", "channel", "row0", F.posexplode(F.arrays_zip("i", "q")).alias("k", "x")).select(
        "obs_id", "channel", (F.col("row0") + F.col("k")).alias("row"), F.col("x.i").cast("double").alias("i"), F.col("x.q").cast("double").alias("q"))
    added, report = inject.add_signals(cells, targets, con, ["obs_id"], cfg.search_stft.nfft)
    name = plan["plan_name"]
    files = iq_dat.write_overlay(base, added, f"{out_dir}/{name}", con).orderBy("block").collect()  # one short row per file
    o = plan["observation"] | {"dat_paths": [f["path"] for f in files], "lo_hz": lo, "start_coarse_channel": first}
    save_manifest(f"{out_dir}/{name}.manifest.yaml", [o])
    details = [r.asDict() for r in report.drop("n_rows").collect()]  # one row per signal and channel of the plan
    signals = [{"name": p["name"], "morphology": p["morphology"], "obs_id": o["obs_id"], "requested": p,
                "resolved": {"start_s": p.get("start_s", 0.2), "duration_s": p.get("duration_s", 1.4), "start_freq_hz": p["abs_freq_hz"], "drift_hz_per_s": p.get("drift_hz_per_s", 0.0),
                             "snr_db": p["snr_db"], "freq_tolerance_hz": p.get("freq_tolerance_hz", 120.0), "drift_tolerance_hz_per_s": p.get("drift_tolerance_hz_per_s", 6.0)},
                "target_channels": [{"channel_index": d["channel"]} | {k: d[k] for k in ("baseband_hz", "amp_scale", "sigma", "channel_scale", "applied_amplitude", "realized_rms",
                                    "realized_snr_db", "realized_snr_db_vs_original", "realized_local_psd_snr_db", "requested_local_psd_snr_db", "channel_rescaled_for_headroom")}
                                    for d in details if d["signal_no"] == n]} for n, p in enumerate(plan["signals"])]
    out = {"plan_name": name, "observation": o, "notes": plan["notes"], "signals": signals}
    tables_out.write_summary(f"{out_dir}/{name}.inject.json", out)
    return out


def benchmark(spark: SparkSession, base: str, cases: list[dict], cfg: Runtime, out_dir: str) -> dict:
    """Injects each case, searches, and tells whether its nearest event is within tolerance; progress is written after each."""
    from dataclasses import replace

    widest = max([abs(c.get("drift_hz_per_s", 0.0)) for c in cases] + [abs(c.get("piecewise_second_drift_hz_per_s") or 0.0) for c in cases])
    cfg = replace(cfg, drift=replace(cfg.drift, min_hz_per_s=min(cfg.drift.min_hz_per_s, -widest), max_hz_per_s=max(cfg.drift.max_hz_per_s, widest)))
    done = []
    for case in cases:
        name = case["name"]
        plan = {"plan_name": name, "notes": [], "signals": [case], "observation": {"obs_id": name, "beam_id": "00", "pol_id": "00", "scan_id": name, "target_id": name}}
        report = inject_signals(spark, base, plan, cfg, f"{out_dir}/{name}")
        found = search_run(spark, [report["observation"]], cfg, f"{out_dir}/{name}/run")
        pool = found["events"] if found["candidates"].isEmpty() else found["candidates"]
        best = compare.nearest_event(report_signals(spark, f"{out_dir}/{name}/{name}.inject.json"), pool).first()
        done.append({"name": name, "detected": bool(best and best["detected"])} | ({k: best[k] for k in ("event_id", "freq_err_hz", "drift_err_hz_per_s")} if best else {}))
        tables_out.write_summary(f"{out_dir}/benchmark_progress.json", {"cases": done})
    out = {"n_cases": len(done), "n_detected": sum(c["detected"] for c in done), "cases": done}
    tables_out.write_summary(f"{out_dir}/benchmark_summary.json", out | {"detected_share": out["n_detected"] / max(1, len(done))})
    return out
