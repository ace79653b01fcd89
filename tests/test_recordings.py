"""Recordings end to end: the source, injection, search, review and the command line."""

import json
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skydrift import cli
from skydrift.operators import inject, measure, search, spectra
from skydrift.params import Baseline, Candidate, Contract, Drift, Refine, Runtime, Stft, build
from skydrift.plans import pipeline
from skydrift.sources import config, iq_dat, tables_out
from skydrift.streaming import windows

CON = Contract(lo_hz=1e9, start_coarse_channel=27392)
SMALL = Runtime(contract=CON, search_tile_rows=8192, search_overlap_rows=2048, search_stft=Stft(1024, 512), baseline=Baseline(smooth_bins=101),
                drift=Drift(min_hz_per_s=-16, max_hz_per_s=16, step_hz_per_s=4, seed_top_k_mean_per_channel=2, seed_top_k_max_per_channel=2, snr_threshold=3.0, channel_list=(20, 40)),
                refine=Refine(top_n=8, drift_step_hz_per_s=1.0), candidate=Candidate(min_candidate_hits=2, min_candidate_duration_s=0.5, min_support_fraction=0.05, max_width_bins=5))


def record(path, rows, seed=7, sigma=6.0):
    rng = np.random.default_rng(seed)
    iq_dat.join_words(rng.normal(0, sigma, (rows, 256)), rng.normal(0, sigma, (rows, 256))).tofile(path)
    return str(path)


def test_words_decode_and_encode():
    i, q = iq_dat.split_words(np.array([65535, 32768, 127], "<u2"))
    assert i.tolist() == [-1, 0, 127] and q.tolist() == [-1, -128, 0]
    assert iq_dat.join_words(np.array([0.5, 1.5, 300]), np.array([-0.5, -200, 2.4])).tolist() == [0, 0x8002, 0x027F]


def test_reading_across_files(spark, tmp_path):
    for k in (1, 2):
        np.full((10, 256), k, "<u2").tofile(tmp_path / f"{k}.dat")
    paths = [str(tmp_path / "1.dat"), str(tmp_path / "2.dat")]
    parts = iq_dat.overlaps([(p, 10) for p in paths], 8, 12)
    assert iq_dat.read_words(parts, [3], CON)[:, 0].tolist() == [1, 1, 2, 2]
    with pytest.raises(ValueError):
        iq_dat.overlaps([(p, 10) for p in paths], 8, 21)
    df = iq_dat.load(spark, [{"obs_id": "a", "dat_paths": paths}], CON, 8, 2, [7, 3])
    assert [(r["tile"], r["row0"], r["row1"]) for r in df.where("channel = 3").orderBy("tile").collect()] == [(0, 0, 8), (1, 6, 14), (2, 12, 20)]
    assert df.where("obs_id = 'b'").count() == 0 and df.where("tile = 1").count() == 2
    (tmp_path / "bad.dat").write_bytes(b"123")
    with pytest.raises(ValueError):
        iq_dat.file_rows(str(tmp_path / "bad.dat"), CON)


def test_path_scores_equal_plain_loops():
    rng = np.random.default_rng(0)
    m = rng.normal(1, 0.1, (16, 128))
    slopes, widths = np.arange(-3, 4) * 0.5, (1, 3, 5)
    for b in (0, 20, 90, 127):
        got, _ = search.path_scores(m, b, 8, slopes, widths)
        for k, w in enumerate(widths):
            for d, s in enumerate(slopes):
                v = []
                for t in range(16):
                    c = int(np.rint(b + s * (t - 8)))
                    if c - w // 2 >= 0 and c + w // 2 + 1 <= 128:
                        v.append(m[t, c - w // 2:c + w // 2 + 1].mean())
                want = 10 * np.log10(0.65 * np.mean(v) + 0.35 * np.mean(sorted(v, reverse=True)[:max(1, len(v) // 3)]) + 1e-12) if v else -np.inf
                assert got[k, d] == pytest.approx(want, abs=1e-8)


def test_running_median_repeats_edges():
    x = np.random.default_rng(1).normal(size=57)
    p = np.pad(x, 4, mode="edge")
    assert np.allclose(spectra.running_median(x, 8), [np.median(p[i:i + 9]) for i in range(57)])
    assert len(spectra.running_median(x[:2], 9)) == 2 and len(spectra.running_median(x, 999)) == 57


def test_dechirp_finds_a_chirp(spark):
    n, rate = 8192, CON.df_hz
    t = np.arange(n) / rate
    x = np.exp(2j * np.pi * (2500 * t + 0.5 * 10 * t**2)) * 5 + np.random.default_rng(0).normal(0, 3, n)
    rows = [("a", x.real.tolist(), x.imag.tolist(), [(5000, 8.0, 5.0), (2, -3.0, 1.0)])]
    df = spark.createDataFrame(rows, "k string, i array<double>, q array<double>, hits array<struct<fine_bin int, drift_hz_per_s double, incoherent_snr double>>")
    r, other = search.refine(df, ["k"], rate, Refine()).orderBy("hit_no").collect()
    assert abs(r["refined_freq_offset_hz"] - 2500) < 3 and abs(r["refined_drift_hz_per_s"] - 10) < 2 and r["refined_snr"] > 30
    assert r["coherent_gain_db"] == pytest.approx(r["refined_snr"] - 5.0) and -11 <= other["refined_drift_hz_per_s"] <= 5
    assert search.refine(df.limit(0), ["k"], rate, Refine()).count() == 0
    # With the ridge: the slope of the strongest third of the pieces' peaks, spread evenly, by hand.
    y = x - x.mean()
    size = n // 64
    s = np.abs(np.fft.fftshift(np.fft.fft(y.reshape(64, size) * np.hanning(size), axis=1), axes=1))[:, :7]
    kept = s.argmax(axis=1)[np.argsort(s.max(axis=1))[::-1][:21]]
    want = np.polyfit(np.linspace(0, n - 1, 21), kept, 1)[0] * rate / n
    got = {x["hit_no"]: x["ridge_drift"] for x in search.ridge_drifts(search.ridge_peaks(df, ["k"]), ["k"], rate).collect()}
    assert set(got) == {1} and got[1] == pytest.approx(want)
    again = {x["hit_no"]: x for x in search.refine(df, ["k"], rate, Refine(), ridge=True).collect()}
    assert again[0]["refined_snr"] == r["refined_snr"] and abs(again[1]["refined_drift_hz_per_s"] - 0.5 * (want - 3)) <= 8.01


def test_local_snr_of_a_tone_and_of_nothing(spark):
    rng = np.random.default_rng(3)
    p = rng.exponential(1.0, (200, 256))
    p[:, 100] += 40.0
    frames = spark.createDataFrame([("a", k, r.tolist()) for k, r in enumerate(p)] + [("b", k, [0.0] * 256) for k in range(5)], "e string, frame int, power array<double>")
    ev = spark.createDataFrame([("a", 100.0, 0.0, 1), ("b", 100.0, 0.0, 1), ("c", None, 0.0, 1)], "e string, at double, slope double, ridge int")
    cfg = build(type(SMALL.measurement), {"bg_half_width_bins": 32, "min_background_pixels": 64})
    got = {r["e"]: r for r in measure.local_snr(frames, ev, ["e"], cfg, 1.0).collect()}
    assert abs(got["a"]["ridge_pixel_snr_db"] - 10 * np.log10(40 / np.log(2))) < 0.5
    assert got["b"]["ridge_pixel_snr_db"] is None and "noise" in got["b"]["warning"] and "c" not in got
    assert measure.snap_bias(0, "median") == 1.0 and measure.enbw_bins(2048, "hann") == pytest.approx(1.5, abs=1e-2)


def test_injected_power_and_headroom(spark):
    rng = np.random.default_rng(11)
    rows = [("o", 3, k, float(a), float(b)) for k, (a, b) in enumerate(np.rint(rng.normal(0, 32, (4000, 2))))] + [("o", 4, k, 1.0, 2.0) for k in range(10)]
    samples = spark.createDataFrame(rows, "obs_id string, channel int, row long, i double, q double")
    plan = spark.createDataFrame([("o", 3, 0, "linear", 26.0, 0.0, 0.2, 500.0, 1.0)], "obs_id string, channel int, signal_no int, morphology string, snr_db double, start_s double, duration_s double, baseband_hz double, amp_scale double")
    out, report = inject.add_signals(samples, inject.complete(plan), CON, ["obs_id"])
    r = report.first()
    assert r["channel_rescaled_for_headroom"] and 0 < r["channel_scale"] < 1
    assert r["realized_snr_db"] == pytest.approx(26.0, abs=1e-6)
    got = {(x["channel"], x["row"]): (x["i"], x["q"]) for x in out.collect()}
    assert len(got) == 4010 and got[4, 0] == (1, 2)
    # By hand: the waveform, its scale by bisection, and the sum.
    sigma = np.sqrt(np.mean([a * a + b * b for _, c, _, a, b in rows if c == 3]))
    n = np.arange(4000)
    on = (n < int(0.2 * CON.df_hz))
    x = np.array([a + 1j * b for _, c, _, a, b in rows if c == 3]) + np.where(on, sigma * 10 ** 1.3 * np.exp(2j * np.pi * np.cumsum(np.full(4000, 500.0)) / CON.df_hz), 0)
    clipped = lambda s: np.mean([(np.rint(v * s) < -128) | (np.rint(v * s) > 127) for v in (x.real, x.imag)])
    lo, hi = 0.0, 1.0
    for _ in range(28):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if clipped(mid) <= 1e-6 else (lo, mid)
    assert r["channel_scale"] == pytest.approx(lo, abs=1e-7)
    assert all(abs(got[3, k][0] - v.real * lo) <= 0.51 and abs(got[3, k][1] - v.imag * lo) <= 0.51 for k, v in enumerate(x))


def test_plans_aliases_and_errors(tmp_path):
    s = config.resolve_signal({"signal_name": "a", "kind": "LINEAR", "snr": 3, "channel_index": 4, "offset_hz": 10.0, "width_hz": 5.0}, CON)
    assert s["abs_freq_hz"] == pytest.approx(1e9 + (27392 + 4) * CON.df_hz + 10) and s["morphology"] == "linear" and s["bandwidth_hz"] == 5.0
    for bad in ({"name": "a", "morphology": "cw"}, {"name": "a", "morphology": "cw", "snr_db": 1, "what": 2, "channel_index": 1}, {"name": "a", "morphology": "cw", "snr_db": 1},
                {"name": "a", "morphology": "cw", "snr_db": 1, "channel_index": 999}, {"name": "a", "morphology": "cw", "snr_db": 1, "abs_freq_hz": 1.0},
                {"name": "a", "signal_name": "b", "morphology": "cw", "snr_db": 1, "channel_index": 1}, {"name": "a", "morphology": "cw", "snr_db": 1, "channel_index": 1, "snr_reference": "x"}):
        with pytest.raises(ValueError):
            config.resolve_signal(bad, CON)
    assert [len({s["name"] for s in config.suite(n, CON)}) for n in ("v017_10", "v018_phase1_5", "v018_full30", "unknown")] == [10, 5, 30, 30]
    with pytest.raises(ValueError):
        config.suite("v017_10", CON, ["none"])
    (tmp_path / "c.yaml").write_text("search_tile_rows: 100\ncontract: {lo_hz: 5}\ndrift: {widths: [1, 7], what: 3}\n")
    cfg = config.load_config(tmp_path / "c.yaml")
    assert cfg.search_tile_rows == 100 and cfg.drift.widths == (1, 7) and cfg.contract.lo_hz == 5


def test_inject_search_review_and_compare(spark, tmp_path):
    base = record(tmp_path / "base.dat", 49152)
    plan = {"plan_name": "p", "notes": [], "observation": {"obs_id": "p", "beam_id": "00", "scan_id": "s", "target_id": "t"},
            "signals": [config.resolve_signal({"name": "a", "morphology": "linear", "snr_db": -8.0, "channel_index": 20, "offset_hz": 1200.0, "drift_hz_per_s": 4.0, "start_s": 0.0, "duration_s": 3.2}, CON)]}
    report = pipeline.inject_signals(spark, base, plan, SMALL, str(tmp_path / "out"))
    assert report["signals"][0]["target_channels"][0]["channel_index"] == 20
    obs = config.load_manifest(tmp_path / "out/p.manifest.yaml")
    assert sum(iq_dat.file_rows(p, CON) for o in obs for p in o["dat_paths"]) == 49152
    words = iq_dat.read_words([(p, 0, iq_dat.file_rows(p, CON)) for p in obs[0]["dat_paths"]], [21], CON)
    assert (words == iq_dat.read_words([(base, 0, 49152)], [21], CON)).all()
    run_dir = str(tmp_path / "out/run")
    found = pipeline.search_run(spark, obs, SMALL, run_dir)
    near = [e for e in found["events"].collect() if e["representative_coarse_channel"] == 20 and abs(e["freq_hz"] - plan["signals"][0]["abs_freq_hz"]) < 40]
    assert near and max(e["n_hits"] for e in near) >= 3
    assert json.loads((tmp_path / "out/run/summary.json").read_text())["n_events"] == found["events"].count()
    done = pipeline.review_build(spark, run_dir, obs, SMALL, "all-events", None, config.find_report(run_dir))
    best = max(done.collect(), key=lambda r: r["score"])
    assert best["band_excess_snr_db"] > 3 and best["visual_evidence"]
    status = json.loads((tmp_path / "out/run/review_all_events/injection_comparison_summary.json").read_text())
    assert status["n_matched"] == 1 and status["n_signals"] == 1


def test_zero_recording_and_command_line(spark, tmp_path):
    np.zeros((4096, 256), "<u2").tofile(tmp_path / "z.dat")
    (tmp_path / "c.yaml").write_text("search_tile_rows: 4096\nsearch_overlap_rows: 1024\nsearch_stft: {nfft: 256, hop: 128}\nbaseline: {smooth_bins: 101}\ndrift: {channel_list: [1, 2], min_hz_per_s: -2, max_hz_per_s: 2}\n")
    common = ["--config", str(tmp_path / "c.yaml"), "--dat", str(tmp_path / "z.dat"), "--run-dir", str(tmp_path / "run")]
    assert cli.main(["inspect-format", *common]) == 0
    assert cli.main(["search-run", *common]) == 0
    assert json.loads((tmp_path / "run/summary.json").read_text())["n_hits"] == 0
    assert cli.main(["dump-injection-suite", "--suite", "v017_10", "--names", "v017_02_weak_cw", "--out", str(tmp_path / "s.yaml")]) == 0
    assert len(config.load_plan(tmp_path / "s.yaml", Contract())["signals"]) == 1
    assert tables_out.read_jsonl(spark, str(tmp_path / "missing"), "a int").count() == 0


def streamed(spark, folder, name, fn, schema):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    q = fn(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(folder / name)).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams_equal_batches(spark, sf, tmp_path):
    """In append mode: what the watermark has passed is given once, and equals the batch."""
    src = spark.read.parquet(f"{sf}/events.parquet").limit(400)
    src = src.union(src.limit(5))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    end = src.agg(F.max("ts")).first()[0] + timedelta(days=90)
    # A row long after the others lets the watermark pass them.
    src.limit(1).withColumn("ts", F.lit(end).cast(src.schema["ts"].dataType)).select(src.columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rounded = lambda d: sorted(tuple(round(v, 4) if isinstance(v, float) else str(v) for v in r) for r in d.collect())
    hop = lambda d, late=None: windows.hopping(d, "ts", "event_type", "value", "6 hours", "2 hours", late)
    assert rounded(streamed(spark, tmp_path, "hop", lambda d: hop(d, "40 days"), src.schema)) == rounded(hop(src))
    ses = lambda d, late=None: windows.sessions(d, "ts", "user_id", "6 hours", late)
    assert rounded(streamed(spark, tmp_path, "ses", lambda d: ses(d, "40 days"), src.schema)) == rounded(ses(src))
    once = streamed(spark, tmp_path, "once", lambda d: windows.latest_versions(d.select("user_id", "ts"), "user_id", "ts", "400 days"), src.schema)
    assert once.where(F.col("ts") < F.lit(end)).count() == src.select("user_id", "ts").distinct().count() < src.count()


def test_sidecar_and_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": [1]}')
    assert config.load_sidecar(str(tmp_path / "a.json")) == {"k": [1]}
    with pytest.raises(ValueError):
        config.load_sidecar(str(tmp_path / "a.txt"))
    tables_out.write_html(spark.range(2500).selectExpr("id", "'<&' AS t", "array(1, 2) AS a"), str(tmp_path / "p"), "x")
    page = "".join(p.read_text() for p in (tmp_path / "p").glob("part*"))
    assert page.count("<tr><td>") == 2500 and "&lt;&amp;" in page and "<td>2499</td>" in page and "[1,2]" in page
