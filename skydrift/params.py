"""Geometry and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass

# Names and defaults of the fields are those of the YAML files, so that a configuration can be loaded as it is.


@dataclass(frozen=True)
class Contract:
    channels: int = 256
    bytes_per_cell: int = 2
    frontend_fs_hz: float = 1e9
    channelizer_fft: int = 65536
    lo_hz: float | None = None
    start_coarse_channel: int | None = None

    @property
    def df_hz(self) -> float:
        """Spacing of coarse channels, and the complex sample rate of each."""
        return self.frontend_fs_hz / self.channelizer_fft

    @property
    def dt_s(self) -> float:
        """Duration of a raw row."""
        return 1.0 / self.df_hz


@dataclass(frozen=True)
class Stft:
    nfft: int = 2048
    hop: int = 1024
    window: str = "hann"


@dataclass(frozen=True)
class Baseline:
    smooth_bins: int = 1001
    edge_bins_per_coarse: int = 16
    qc_display_smooth_bins: int = 257
    qc_low_percentile: float = 5.0
    qc_high_percentile: float = 95.0


@dataclass(frozen=True)
class Drift:
    min_hz_per_s: float = -48.0
    max_hz_per_s: float = 48.0
    step_hz_per_s: float = 1.0
    seed_top_k_mean_per_channel: int = 8
    seed_top_k_max_per_channel: int = 8
    seed_min_separation_bins: int = 8
    snr_threshold: float = 1.5
    widths: tuple[int, ...] = (1, 3, 5)
    trial_chunk_size: int = 64
    support_threshold: float = 1.5
    channel_min: int | None = None
    channel_max: int | None = None
    channel_list: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Refine:
    enabled: bool = True
    top_n: int = 64
    drift_half_window_hz_per_s: float = 8.0
    drift_step_hz_per_s: float = 0.25
    min_refined_snr: float = 14.5


@dataclass(frozen=True)
class Coincidence:
    freq_tol_hz: float = 40.0
    drift_tol_hz_per_s: float = 4.0
    time_tol_s: float = 0.35
    max_row_gap_s: float = 2.5
    multibeam_penalty: float = 2.5


@dataclass(frozen=True)
class Candidate:
    min_event_score: float = 14.0
    min_refined_snr: float = 15.5
    min_hits_if_no_strong_refine: int = 2
    max_width_bins: int = 3
    min_support_fraction: float = 0.18
    allow_singleton_if_refined_snr_ge: float = 18.0
    allow_singleton_candidates: bool = False
    min_candidate_hits: int = 3
    min_candidate_duration_s: float = 4.0
    merge_max_gap_s: float = 35.0
    merge_freq_tol_hz: float = 96.0
    merge_singleton_freq_tol_hz: float = 192.0
    merge_singleton_drift_tol_hz_per_s: float = 16.0
    merge_short_max_hits: int = 3
    merge_short_max_duration_s: float = 3.0
    merge_short_max_overlap_fraction: float = 0.5
    merge_short_freq_tol_hz: float = 256.0
    merge_short_drift_tol_hz_per_s: float = 24.0
    merge_long_gap_s: float = 0.0
    merge_long_gap_min_hits: int = 4
    merge_long_gap_freq_tol_hz: float = 128.0
    merge_long_gap_drift_tol_hz_per_s: float = 3.0
    dedup_freq_tol_hz: float = 128.0
    dedup_time_overlap_fraction: float = 0.5
    dedup_max_gap_s: float = 6.0
    dedup_short_freq_tol_hz: float = 256.0
    track_inlier_filter_enabled: bool = True
    track_inlier_freq_tol_hz: float = 60.0
    track_inlier_drift_tol_hz_per_s: float = 2.0
    track_inlier_min_refined_snr: float = 14.0
    track_inlier_max_refined_drop_db: float = 6.0
    short_track_max_hits: int = 2
    short_track_max_duration_s: float = 2.5
    short_track_min_refined_snr: float = 14.0
    short_track_min_event_score: float = 16.0


@dataclass(frozen=True)
class Review:
    top_k: int = 100
    aligned_half_width_bins: int = 48
    aligned_profile_guard_bins: int = 4
    visual_evidence_min_peak_excess_db: float = 0.0
    visual_evidence_min_center_excess_db: float = -3.0


@dataclass(frozen=True)
class Measurement:
    enabled: bool = True
    bg_half_width_bins: int = 128
    guard_bins: int = 8
    min_background_pixels: int = 256
    noise_statistic: str = "median"
    min_ridge_bins: int = 1
    max_ridge_bins: int = 17
    ridge_snap_half_width_bins: int = 0


@dataclass(frozen=True)
class Runtime:
    contract: Contract = field(default_factory=Contract)
    search_tile_rows: int = 31250
    search_overlap_rows: int = 4096
    search_stft: Stft = field(default_factory=Stft)
    baseline: Baseline = field(default_factory=Baseline)
    drift: Drift = field(default_factory=Drift)
    refine: Refine = field(default_factory=Refine)
    coincidence: Coincidence = field(default_factory=Coincidence)
    candidate: Candidate = field(default_factory=Candidate)
    review: Review = field(default_factory=Review)
    measurement: Measurement = field(default_factory=Measurement)

    @property
    def tile_step(self) -> int:
        return max(1, self.search_tile_rows - self.search_overlap_rows)


def build(kind, values: dict | None):
    """A parameter class from nested dicts: missing keys keep their defaults, unknown ones are ignored, numbers and
    lists are brought to the type of the default."""
    given, out = values or {}, {}
    for f in fields(kind):
        if f.name not in given:
            continue
        v, default = given[f.name], getattr(kind(), f.name)
        if is_dataclass(default):
            v = build(type(default), v)
        elif isinstance(v, (list, tuple)):
            v = tuple(int(x) for x in v)
        elif v is not None and isinstance(default, (bool, int, float, str)):
            v = type(default)(v)
        out[f.name] = v
    return kind(**out)
