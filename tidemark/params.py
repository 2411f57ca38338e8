"""Default parameters.  Times are seconds; `micros` turns them into the integer microseconds that operators compare."""

from __future__ import annotations

from dataclasses import dataclass


def micros(seconds: float) -> int:
    return round(seconds * 1_000_000)


@dataclass(frozen=True)
class Evaluation:
    tolerance: float = 0.06
    nms: float = 0.06
    echo: float = 0.18
    recover_reach: float = 0.10
    recover_confidence: float = 0.15
    recover_apart: float = 0.03


@dataclass(frozen=True)
class CrossCheck:
    most: float = 0.15
    least: float = 0.04
    share: float = 0.5


@dataclass(frozen=True)
class Selection:
    cluster: float = 0.1
    #: With `dynamic`, the cluster window is share x the median gap of the candidates, held in the range.
    dynamic: bool = False
    dynamic_share: float = 0.4
    dynamic_range: tuple[float, float] = (0.08, 0.30)
    hard_gap: float = 0.1
    soft_gap: float = 0.25
    rate: float = 6.0
    hit_rate: float = 3.0
    #: Where a winner's time is put: "onset", "envelope_peak" or "none", within half of `refine` seconds on either side.
    align: str = "onset"
    refine: float = 0.06
    onset_share: float = 0.12
    fusion: float = 0.5


@dataclass(frozen=True)
class Stft:
    n_fft: int = 1024
    hop: int = 256
    low_hz: float = 80.0
    high_hz: float = 6000.0
    bands: tuple[tuple[float, float], ...] = ((50, 300), (300, 3000), (3000, 9000))


@dataclass(frozen=True)
class Candidates:
    #: "mad", "multi", or a percentile of the clip's onset curve.
    threshold: str | float = "mad"
    mad_k: float = 6.0
    window: float = 2.0
    min_distance: float = 0.05
    recovery_ratio: float = 0.5
    recovery_from: float = 0.04
    recovery_to: float = 0.20
    before: float = 0.025
    after: float = 0.040
    envelope: float = 0.003
    attack: float = 0.01


@dataclass(frozen=True)
class Energy:
    low_hz: float = 400.0
    high_hz: float = 6000.0
    threshold: float = 0.005
    min_distance: float = 0.08
    smooth: float = 0.01


@dataclass(frozen=True)
class Motion:
    least: float = 0.3
    distance: float = 0.10
    smooth: float = 0.05
    deviations: float = 2.0
    prominence: float = 0.1


@dataclass(frozen=True)
class Legacy:
    coef: float = 5.0
    percentile: float | None = None
    min_dist: float = 0.10
    prominence: float = 0.5
    smooth_ms: float = 6.0
    least: float = 0.0
    post_filter: bool = True
    band: tuple[float, float] = (400.0, 6000.0)
    envelope: float = 0.003
    gap: float = 0.15


@dataclass(frozen=True)
class Beep:
    low_hz: float = 1500.0
    high_hz: float = 5500.0
    tonal_low: float = 1250.0
    tonal_high: float = 5200.0
    analysis: float = 0.3
    head: float = 3.0
    search_from: float = 0.5
    search_to: float = 60.0
    height_share: float = 0.55
    isolated: float = 2.0
    smooth: float = 0.01
    #: Deviations above the head's mean that a peak must reach, and seconds between peaks.
    deviations: float = 2.0
    distance: float = 0.2
    tonal_span: float = 5.0
    #: Looking near a time: thresholds in turn, and seconds between peaks.
    ladder: tuple[float, ...] = (2.5, 2.0, 1.5, 1.0)
    near_distance: float = 0.15
    #: A first peak in this range without a candidate from `late` on is looked for near early_at; what is found in early_found counts, but not below early_floor.
    early: tuple[float, float] = (0.5, 1.0)
    late: float = 5.0
    early_at: float = 3.0
    early_window: float = 1.5
    early_found: tuple[float, float] = (2.0, 4.5)
    early_floor: float = 3.0
    #: A time in this range, or one before `late` with a candidate in it, is looked for near probe_at; None for no such probe.
    probe: tuple[float, float] | None = (6.5, 6.75)
    probe_at: float = 4.5
    probe_window: float = 2.0
    probe_to: float = 5.5
    #: The network's path: steps of its windows, the probability of a beep, and that of the best window taken without one.
    step: float = 0.15
    probability: float = 0.5
    fallback: float = 0.3
    refine: float = 0.5


#: The settings of the calibration search.
CALIBRATION_DISTANCES = [0.08, 0.10]
CALIBRATION_PROMINENCES = [0.15, 0.2, 0.25, 0.3, 0.4, 0.5]
CALIBRATION_COEFFICIENTS = [2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0]
CALIBRATION_PERCENTILES = [88, 90, 92, 95, 97]
CALIBRATION_SMOOTH_MS = [4.0, 6.0, 8.0]
CALIBRATION_SMOOTH_PROMINENCES = [0.2, 0.3]
CALIBRATION_SMOOTH_COEFFICIENTS = [2.5, 3.0, 3.5]
#: The settings of the beep search.
BEEP_HEIGHT_SHARES = [0.25, 0.35, 0.45, 0.55]
BEEP_PROBES = [5.5, 6.5, 8.0]
