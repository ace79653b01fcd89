"""Synthetic signals: where they go, what they are, how strong they are made, and adding them to samples.

The phase of a signal at a row is a closed form of the row, so rows need nothing of each other: synthesis is an
expression, and only powers are aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skydrift.functions import exprs as X
from skydrift.params import Contract

MULTI = ("broadband_contig", "checkerboard")
DRIFTING = ("linear", "burst", "intermittent", "amp_mod", "cw", "cluster", "broadband_contig", "checkerboard", "dualburst", "wobble", "quadratic")
#: Share of components that may be clipped, and the steps to which a scale is rounded down.
CLIPPED, SCALE_STEPS = 1e-6, 1 << 28
#: Optional fields of a signal and what they are if missing.
DEFAULTS = {
    "drift_hz_per_s": 0.0, "start_s": 0.2, "duration_s": 1.4, "duty_cycle": 1.0, "period_s": 0.2, "bandwidth_hz": 0.0, "n_tones": 1,
    "piecewise_second_drift_hz_per_s": None, "quadratic_hz_per_s2": 0.0, "wobble_hz": 0.0, "wobble_rate_hz": 0.0, "amp_mod_depth": 0.0,
    "amp_mod_rate_hz": 0.0, "secondary_start_s": None, "secondary_duration_s": None, "freq_tolerance_hz": 120.0, "drift_tolerance_hz_per_s": 6.0,
    "coarse_channel_count": 1, "amplitude_taper": "flat", "checkerboard_period": 4, "snr_reference": "coarse_channel",
}
KINDS = {"n_tones": "int", "coarse_channel_count": "int", "checkerboard_period": "int", "amplitude_taper": "string", "snr_reference": "string"}


def complete(plan: DataFrame) -> DataFrame:
    """Fills missing fields of signals (columns or nulls) with their defaults."""
    for name, value in DEFAULTS.items():
        kind = KINDS.get(name, "double")
        given = F.col(name).cast(kind) if name in plan.columns else F.lit(None).cast(kind)
        plan = plan.withColumn(name, F.coalesce(given, F.lit(value).cast(kind)))
    return plan


def nearest_channel(freq: Column, lo_hz: Column, start_channel: Column, contract: Contract) -> tuple[Column, Column]:
    """Nearest coarse channel (the lower on ties, within the band) and the frequency against its centre."""
    x = (freq - lo_hz) / F.lit(contract.df_hz) - start_channel
    ch = F.greatest(F.lit(0), F.least(F.lit(contract.channels - 1), F.ceil(x - 0.5))).cast("int")
    return ch, freq - (lo_hz + (start_channel + ch) * F.lit(contract.df_hz))


def target_channels(signals: DataFrame, contract: Contract) -> DataFrame:
    """One row per signal and channel it goes to: base_channel, channel, no (place among them), baseband_hz, amp_scale.

    Checkerboards take every period-th channel of a block, contiguous bands all; others one. The absolute frequency stays, so
    far channels get a baseband beyond their width.
    """
    n, period = F.col("coarse_channel_count"), F.greatest(F.lit(1), F.col("checkerboard_period"))
    start = F.greatest(F.lit(0), F.col("base_channel") - F.floor(n / 2)).cast("int")
    stop = F.least(F.lit(contract.channels), start + n)
    block = F.when(F.col("morphology").isin(*MULTI) & (stop > start), F.sequence(start, stop - 1, F.when(F.col("morphology") == "checkerboard", period).otherwise(1)))
    block = F.when(F.col("morphology").isin(*MULTI), F.coalesce(block, F.array().cast("array<int>"))).otherwise(F.array("base_channel"))
    out = signals.select("*", F.posexplode(block).alias("no", "channel"))
    mid = F.greatest(n - 1, F.lit(1)) / 2.0
    taper = (F.when(~F.col("morphology").isin(*MULTI), 1.0)
             .when(F.col("amplitude_taper") == "alternating", F.when(F.col("no") % 2 == 0, 1.0).otherwise(0.55))
             .when(F.col("amplitude_taper") == "triangular", F.greatest(F.lit(0.25), 1.0 - F.abs(F.col("no") - mid) / F.greatest(mid, F.lit(1.0))))
             .otherwise(1.0))
    return out.withColumns({"baseband_hz": F.col("baseband_hz") + (F.col("base_channel") - F.col("channel")) * F.lit(contract.df_hz), "amp_scale": taper})


def tone_count(bandwidth: Column, n_tones: Column) -> Column:
    """Tones that make up a band: one without width, as many as asked for, else an odd number from 3 to 17 by width."""
    k = F.greatest(F.lit(3), F.least(F.lit(17), F.ceil(bandwidth / 6.0) + 1)).cast("int")
    return F.when(bandwidth <= 0, 1).when(n_tones > 1, n_tones).otherwise(k + F.when(k % 2 == 0, 1).otherwise(0))


def _second_drift() -> Column:
    d2 = F.col("piecewise_second_drift_hz_per_s")
    return F.when(d2.isNull() | (d2 == 0), F.col("drift_hz_per_s")).otherwise(d2)


def instant_frequency(t: Column, base: Column) -> Column:
    """Frequency of a signal at t seconds, by its morphology; unknown ones keep the base frequency."""
    x, d = t - F.col("start_s"), F.col("drift_hz_per_s")
    half = F.col("duration_s") / 2.0
    return (
        F.when(F.col("morphology") == "piecewise", F.when(x < half, base + d * x).otherwise(base + d * half + _second_drift() * (x - half)))
        .when(F.col("morphology") == "wobble", base + d * x + F.col("wobble_hz") * F.sin(2 * F.pi() * F.col("wobble_rate_hz") * x))
        .when(F.col("morphology") == "quadratic", base + d * x + 0.5 * F.col("quadratic_hz_per_s2") * x * x)
        .when(F.col("morphology").isin(*DRIFTING), base + d * x)
        .otherwise(base))


def phase_cycles(row: Column, base: Column, fs: float) -> Column:
    """Cycles up to and with a row: the sum of the instant frequency over rows 0..row, divided by fs, in closed form."""
    n = (row + 1).cast("double")
    s, d, r = F.col("start_s"), F.col("drift_hz_per_s"), F.lit(fs)
    sum_t = n * (n - 1) / (2 * r)
    sum_x = sum_t - n * s
    sum_x2 = (n - 1) * n * (2 * n - 1) / (6 * r * r) - 2 * s * sum_t + n * s * s
    line = base * n + d * sum_x
    # Sum of sines in arithmetic progression; a wobble of rate 0 adds nothing.
    a = 2 * F.pi() * F.col("wobble_rate_hz") / r
    b = -2 * F.pi() * F.col("wobble_rate_hz") * s
    wave = F.when(F.abs(F.sin(a / 2)) < 1e-15, n * F.sin(b)).otherwise(F.sin(n * a / 2) * F.sin(b + (n - 1) * a / 2) / F.sin(a / 2))
    # Rows at and after the middle of a piecewise signal run with the second drift: k counts those before it.
    half = s + F.col("duration_s") / 2.0
    k = F.greatest(F.lit(0.0), F.least(n, F.ceil(half * r).cast("double")))
    m = n - k
    sum_after = (sum_t - k * (k - 1) / (2 * r)) - m * half
    piece = base * n + d * (k * (k - 1) / (2 * r) - k * s) + m * d * F.col("duration_s") / 2.0 + _second_drift() * sum_after
    total = (F.when(F.col("morphology") == "piecewise", piece).when(F.col("morphology") == "wobble", line + F.col("wobble_hz") * wave)
             .when(F.col("morphology") == "quadratic", line + 0.5 * F.col("quadratic_hz_per_s2") * sum_x2)
             .when(F.col("morphology").isin(*DRIFTING), line).otherwise(base * n))
    return total / r


def envelope(row: Column, fs: float) -> Column:
    """Whether a signal is on at a row (1 or 0), times its amplitude modulation."""
    first = F.greatest(F.lit(0), F.floor(F.col("start_s") * fs))
    on = (row >= first) & (row < first + F.floor(F.col("duration_s") * fs))
    cycle = F.pmod((row - first) / F.lit(fs), F.col("period_s"))
    on = F.when(F.col("morphology") == "intermittent", on & (cycle <= F.col("period_s") * F.col("duty_cycle"))).otherwise(on)
    given = lambda c, other: F.when(F.col(c).isNull() | (F.col(c) == 0), F.lit(other)).otherwise(F.col(c))
    again = F.greatest(F.lit(0), F.floor(given("secondary_start_s", 0.8) * fs))
    stop = again + F.floor(given("secondary_duration_s", 0.2) * fs)
    on = F.when(F.col("morphology") == "dualburst", on | ((row >= again) & (row < stop))).otherwise(on)
    depth = F.when(F.col("morphology") == "amp_mod", F.greatest(F.lit(0.0), 1.0 + F.col("amp_mod_depth") * F.sin(
        2 * F.pi() * F.col("amp_mod_rate_hz") * (row / F.lit(fs) - F.col("start_s"))))).otherwise(1.0)
    return F.when(on, depth).otherwise(0.0)


def active_rows(fs: float) -> Column:
    """Rows from a signal's first to the one after its last, and those of a second burst with the one after it."""
    first = F.greatest(F.lit(0), F.floor(F.col("start_s") * fs))
    given = lambda c, other: F.when(F.col(c).isNull() | (F.col(c) == 0), F.lit(other)).otherwise(F.col(c))
    again = F.greatest(F.lit(0), F.floor(given("secondary_start_s", 0.8) * fs))
    span = lambda a, d: F.sequence(a, a + F.greatest(F.lit(0), F.floor(d * fs)))
    rows = span(first, F.col("duration_s"))
    return F.when(F.col("morphology") == "dualburst", F.array_union(rows, span(again, given("secondary_duration_s", 0.2)))).otherwise(rows)


def waveform(row: Column, base: Column, fs: float) -> tuple[Column, Column]:
    """Real and imaginary part of the unit signal at a row: the sum of its tones."""
    n = tone_count(F.col("bandwidth_hz"), F.col("n_tones"))
    tones = F.sequence(F.lit(0), n - 1)
    off = lambda k: F.when(n > 1, F.col("bandwidth_hz") * (k / F.greatest(F.lit(1), n - 1) - 0.5)).otherwise(0.0)
    cycles = phase_cycles(row, base, fs)
    angle = lambda k: 2 * F.pi() * F.pmod(cycles + off(k) * (row + 1) / F.lit(fs), F.lit(1.0))
    part = lambda fn: F.aggregate(tones, F.lit(0.0), lambda acc, k: acc + fn(angle(k)))
    return part(F.cos), part(F.sin)


def power_plan(sigma: Column, amp_scale: Column, contract: Contract, nfft: int = 2048) -> dict[str, Column]:
    """Noise and signal power for a signal in a channel of RMS sigma, by its SNR convention; an unknown one fails."""
    coarse = F.greatest(sigma, F.lit(0.0)) ** 2
    ref_bw = F.when(F.col("bandwidth_hz") > 0, F.col("bandwidth_hz")).otherwise(F.lit(contract.df_hz / nfft))
    noise = coarse / F.lit(contract.df_hz) * ref_bw
    ref = (F.when(F.col("snr_reference") == "local_psd", noise).when(F.col("snr_reference") == "coarse_channel", coarse)
           .otherwise(F.raise_error(F.lit("snr_reference must be coarse_channel or local_psd")).cast("double")))
    power = ref * X.ratio(F.col("snr_db")) * amp_scale**2
    return {"reference_bandwidth_hz": ref_bw, "reference_noise_power": noise, "requested_signal_power": power, "requested_target_rms": F.sqrt(power),
            "requested_local_psd_snr_db": X.safe_db(power / F.when(noise > 0, noise))}


def out_of_channel(signals: DataFrame, contract: Contract, points: int = 128) -> DataFrame:
    """Adds excursion_hz and fits: whether a one-channel signal stays in its channel, sampled while it is on."""
    ends = [F.col("start_s"), F.col("start_s") + F.col("duration_s"), F.col("secondary_start_s"), F.col("secondary_start_s") + F.col("secondary_duration_s")]
    t0, t1 = F.greatest(F.lit(0.0), F.least(*ends)), F.greatest(*ends)
    t1 = F.when(t1 <= t0, t0 + 1e-6).otherwise(t1)
    worst = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.abs(instant_frequency(t0 + (t1 - t0) * k / (points - 1), F.col("baseband_hz")))))
    limit = 0.5 * contract.df_hz - max(8.0, 2.0 * contract.df_hz / 2048)
    exempt = F.col("morphology").isin(*MULTI) | (F.col("coarse_channel_count") > 1)
    return signals.withColumn("excursion_hz", worst + 0.5 * F.col("bandwidth_hz")).withColumn("fits", exempt | (F.col("excursion_hz") <= limit))


def add_signals(samples: DataFrame, targets: DataFrame, contract: Contract, keys: list[str], nfft: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Samples with signals added, and a report of each signal and channel.

    samples: keys, channel, row, i, q. targets: keys, signal_no and the columns of ``target_channels``. A channel without
    signals stays as it is. The sum of a channel is scaled down so that no more than a millionth of its components leave the
    range of a signed byte. Only the rows of touched channels meet signals; powers and scales are aggregates.
    """
    fs, place = contract.df_hz, [*keys, "channel"]
    sigma = samples.groupBy(*place).agg(F.sqrt(F.avg(F.col("i") * F.col("i") + F.col("q") * F.col("q"))).alias("sigma"), F.count(F.lit(1)).alias("n_rows"))
    on = samples.select(*place, "row").join(targets, place).withColumn("env", envelope(F.col("row"), fs)).where("env > 0")
    re, im = waveform(F.col("row"), F.col("baseband_hz"), fs)
    on = on.withColumns({"re": re * F.col("env"), "im": im * F.col("env")})
    each = [*place, "signal_no"]
    rms = on.groupBy(*each).agg(F.sqrt(F.avg(F.col("re") ** 2 + F.col("im") ** 2)).alias("raw_rms"), F.count(F.lit(1)).alias("active_rows"))
    t = targets.join(sigma, place).join(rms, each, "left")
    t = t.withColumns(power_plan(F.col("sigma"), F.col("amp_scale"), contract, nfft))
    t = t.withColumn("amplitude", F.when(F.col("raw_rms") > 0, F.col("requested_target_rms") / F.col("raw_rms")).otherwise(0.0))
    delta = on.join(t.select(*each, "amplitude"), each).groupBy(*place, "row").agg(
        F.sum(F.col("amplitude") * F.col("re")).alias("di"), F.sum(F.col("amplitude") * F.col("im")).alias("dq"))
    summed = samples.join(targets.select(*place).distinct(), place, "left_semi").join(delta, [*place, "row"], "left").select(
        *place, "row", (F.col("i") + F.coalesce("di", F.lit(0.0))).alias("i"), (F.col("q") + F.coalesce("dq", F.lit(0.0))).alias("q"))
    # A component leaves the range above 127.5 and below -128.5: the scale that just keeps it.
    keeps = lambda c: F.when(F.col(c) > 0, 127.5 / F.col(c)).when(F.col(c) < 0, -128.5 / F.col(c))
    limits = summed.select(*place, F.explode(F.array(keeps("i"), keeps("q"))).alias("s")).where("s <= 1")
    allowed = F.floor(2 * F.col("n_rows") * CLIPPED)
    w = Window.partitionBy(*place).orderBy("s")
    nth = limits.withColumn("k", F.row_number().over(w)).join(sigma, place).where(F.col("k") == allowed + 1)
    scale = nth.select(*place, (F.floor(F.col("s") * SCALE_STEPS - 1e-6) / SCALE_STEPS).alias("scale"))
    scaled = summed.join(scale, place, "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    out = scaled.select(*place, "row", X.clip8(F.col("i") * F.col("scale")).alias("i"), X.clip8(F.col("q") * F.col("scale")).alias("q"))
    rest = samples.join(targets.select(*place).distinct(), place, "left_anti").select(*place, "row", F.col("i").cast("int"), F.col("q").cast("int"))
    r = t.join(scale, place, "left").withColumn("channel_scale", F.coalesce("scale", F.lit(1.0))).drop("scale")
    realized = F.col("raw_rms") * F.col("amplitude") * F.col("channel_scale")
    report = r.withColumns({
        "applied_amplitude": F.col("amplitude") * F.col("channel_scale"), "realized_rms": realized, "channel_rescaled_for_headroom": F.col("channel_scale") + 1e-12 < 1,
        "realized_snr_db": 2 * X.safe_db(realized / (F.col("channel_scale") * F.col("sigma"))), "realized_snr_db_vs_original": 2 * X.safe_db(realized / F.col("sigma")),
        "realized_local_psd_snr_db": X.safe_db(realized**2 / (F.col("reference_noise_power") * F.col("channel_scale") ** 2)),
    })
    return out.unionByName(rest), report


def clip_summary(samples: DataFrame, keys: list[str], i: str = "i", q: str = "q") -> DataFrame:
    """(keys, n_components, n_clipped, clipped_share, max_abs) of components before they are clipped."""
    out = lambda c: F.when((F.rint(c) < -128) | (F.rint(c) > 127), 1).otherwise(0)
    a = samples.groupBy(*keys).agg((2 * F.count(F.lit(1))).alias("n_components"), F.sum(out(i) + out(q)).alias("n_clipped"),
                                   F.max(F.greatest(F.abs(F.col(i)), F.abs(F.col(q)))).alias("max_abs"))
    return a.withColumn("clipped_share", F.col("n_clipped") / F.col("n_components"))
