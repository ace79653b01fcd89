"""python -m skydrift.cli COMMAND ...: searches, reviews, injections and benchmarks of recordings."""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skydrift.operators import spectra
from skydrift.params import Runtime
from skydrift.plans import pipeline
from skydrift.sources import config, iq_dat, tables_out


def _observations(a) -> list[dict]:
    if a.manifest:
        return config.load_manifest(a.manifest)
    return [{"obs_id": a.obs_id, "dat_paths": a.dat, "beam_id": a.beam_id, "scan_id": a.scan_id, "target_id": a.target_id}]


def _runtime(a) -> Runtime:
    cfg = config.load_config(a.config) if a.config else Runtime()
    over = {"drift": ("snr_threshold", a.snr_threshold), "refine": ("min_refined_snr", a.min_refined_snr)}
    for part, (name, value) in over.items():
        if value is not None:
            cfg = replace(cfg, **{part: replace(getattr(cfg, part), **{name: value})})
    gate = {k: v for k, v in (("min_event_score", a.min_event_score), ("min_refined_snr", a.candidate_min_refined_snr)) if v is not None}
    return replace(cfg, candidate=replace(cfg.candidate, **gate)) if gate else cfg


def _waterfall(spark, a, cfg):
    con = cfg.contract
    tiles = iq_dat.load(spark, _observations(a), con, cfg.search_tile_rows, cfg.search_overlap_rows).where("tile = 0")
    frames = spectra.stft(tiles.withColumns({c: F.col(c).cast("array<double>") for c in "iq"}), ["obs_id", "channel"], cfg.search_stft.nfft, cfg.search_stft.hop, cfg.search_stft.window)
    base = cfg.baseline
    return spectra.qc_display(spectra.bins(frames, ["obs_id", "channel"]), ["obs_id"], "channel", base.qc_display_smooth_bins, base.qc_low_percentile, base.qc_high_percentile)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="skydrift")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("inspect-format", "qc-waterfall", "search-run", "review-build", "smoke-sample"):
        s = sub.add_parser(name)
        s.add_argument("--config")
        s.add_argument("--dat", nargs="*", default=[])
        s.add_argument("--manifest")
        for k in ("obs-id", "beam-id", "scan-id", "target-id"):
            s.add_argument(f"--{k}", default="obs" if k == "obs-id" else None)
        s.add_argument("--run-dir", default="run")
        for k in ("snr-threshold", "min-refined-snr", "min-event-score", "candidate-min-refined-snr"):
            s.add_argument(f"--{k}", type=float)
        s.add_argument("--scope", choices=("candidates", "all-events"), default="candidates")
        s.add_argument("--top-k", type=int)
        s.add_argument("--review-dir")
        s.add_argument("--report")
    s = sub.add_parser("dump-injection-suite")
    s.add_argument("--suite", required=True)
    s.add_argument("--names", help="separated by commas")
    s.add_argument("--out", required=True)
    s.add_argument("--config")
    for name in ("inject-signals", "benchmark-inject"):
        s = sub.add_parser(name)
        s.add_argument("--config")
        s.add_argument("--base", required=True)
        s.add_argument("--out", required=True)
        s.add_argument("--plan")
        s.add_argument("--suite", default="v018_full30")
        s.add_argument("--names")
        s.add_argument("--max-cases", type=int)
    a = p.parse_args(argv)
    names = [n.strip() for n in (getattr(a, "names", None) or "").split(",") if n.strip()] or None
    if a.command == "dump-injection-suite":
        cfg = config.load_config(a.config) if a.config else Runtime()
        config.save_plan(a.out, {"plan_name": a.suite, "signals": config.suite(a.suite, cfg.contract, names)})
        return 0
    if a.command == "inspect-format":
        con = _runtime(a).contract
        print(json.dumps([{"path": d, "n_rows": iq_dat.file_rows(d, con), "dt_s": con.dt_s, "channel_hz": con.df_hz} for o in _observations(a) for d in o["dat_paths"]], indent=2))
        return 0
    spark = SparkSession.builder.appName("skydrift").getOrCreate()
    if a.command in ("inject-signals", "benchmark-inject"):
        cfg = config.load_config(a.config) if a.config else Runtime()
        if a.command == "inject-signals":
            pipeline.inject_signals(spark, a.base, config.load_plan(a.plan, cfg.contract), cfg, a.out)
        else:
            pipeline.benchmark(spark, a.base, config.suite(a.suite, cfg.contract, names)[:a.max_cases], cfg, a.out)
        return 0
    cfg = _runtime(a)
    if a.command in ("qc-waterfall", "smoke-sample"):
        out, limits = _waterfall(spark, a, cfg)
        out.write.mode("overwrite").parquet(f"{a.run_dir}/qc_waterfall.parquet")
        tables_out.write_csv(limits, f"{a.run_dir}/qc_range.csv")
    if a.command in ("search-run", "smoke-sample"):
        pipeline.search_run(spark, _observations(a), cfg, a.run_dir)
    if a.command in ("review-build", "smoke-sample"):
        top = 1 if a.command == "smoke-sample" else a.top_k
        pipeline.review_build(spark, a.run_dir, _observations(a), cfg, a.scope, top, config.find_report(a.run_dir, a.report), a.review_dir)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
