"""Injected signals over all their rows, and those of which not all times are given."""

import math

from pyspark.sql import functions as F

from skydrift.plans import truth


def frequency(s, x):
    base, d = 1.5, s["drift_hz_per_s"]
    if s["morphology"] == "piecewise":
        half, d2 = s["duration_s"] / 2, s["piecewise_second_drift_hz_per_s"] or d
        return base + d * x if x < half else base + d * half + d2 * (x - half)
    if s["morphology"] == "wobble":
        return base + d * x + 12 * math.sin(math.pi * x)
    return base + d * x + (1.5 * x * x if s["morphology"] == "quadratic" else 0)


def course(s):
    first, n = math.floor(s["start_s"] * 8), math.floor(s["duration_s"] * 8)
    want = set(range(first, first + n + 1)) | ({6, 7} if s["morphology"] == "dualburst" else set())
    total, out = 0.0, {}
    for row in range(max(want) + 1):
        total += frequency(s, row / 8 - s["start_s"]) / 8
        on = first <= row < first + n
        if s["morphology"] == "intermittent":
            on = on and ((row - first) / 8) % 1.0 <= 0.5
        if s["morphology"] == "dualburst":
            on = on or row == 6
        if row in want:
            out[row] = total, float(on)
    return out


def test_course_covers_every_row_of_every_signal(spark, sf):
    signals = truth.signals(spark, sf).where("timed").collect()
    got = {}
    for r in truth.signal_course(spark, sf).collect():
        assert r["row"] not in got.setdefault(r["signal_id"], {})
        got[r["signal_id"]][r["row"]] = r["cycles"], r["env"]
    assert set(got) == {s["signal_id"] for s in signals} and any(s["start_s"] > 12 for s in signals)
    for s in signals:
        want, have = course(s), got[s["signal_id"]]
        assert set(want) == set(have)
        assert all(have[k][1] == on and math.isclose(have[k][0], c, rel_tol=1e-9, abs_tol=2e-4) for k, (c, on) in want.items())


def test_signals_without_start_are_matched_by_their_row(spark, sf, tmp_path):
    """Where no start or end is given, they follow from start_row and duration, and the same events are matched."""
    given = spark.read.parquet(f"{sf}/injected_signals.parquet").withColumn("start_row", F.round(F.col("injected_start_s") / 65.536e-6).cast("long"))
    nothing = F.lit(None).cast("double")
    bare = given.withColumns({"injected_start_s": nothing, "injected_end_s": nothing})
    for name, df in (("given", given), ("bare", bare)):
        df.write.parquet(str(tmp_path / name / "injected_signals.parquet"))
        (tmp_path / name / "track_events.parquet").symlink_to(f"{sf}/track_events.parquet")
    want, got = ({(r["signal_id"], r["event_id"]) for r in truth.truth_matches(spark, str(tmp_path / name)).collect()} for name in ("given", "bare"))
    assert want and got == want
    status = {r["signal_id"] for r in truth.truth_status(spark, str(tmp_path / "bare")).where("match_status = 'matched'").collect()}
    assert status == {s for s, _ in want}
