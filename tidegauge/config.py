"""Settings of the engine, as plain dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

# Feature names of the entity window, in output order.
FEATURES = (
    "cnt_5m",
    "amt_sum_5m",
    "amt_mean_5m",
    "amt_std_5m",
    "uniq_merchant_5m",
    "uniq_country_5m",
    "time_since_last",
    "rate_per_min",
)

SCORE = "score"
BINS = 10


@dataclass(frozen=True)
class FeatureConfig:
    window_seconds: int = 300
    max_events: int = 500
    enabled: tuple[str, ...] = FEATURES
    # "reference": always 0, the entity clock is moved before it is read; "lag": real gap.
    since_last: str = "reference"
    # Width of the time slices an entity is split into, in windows.
    chunk_windows: int = 2


@dataclass(frozen=True)
class ModelConfig:
    kind: str = "isolation_forest"
    warmup_events: int = 1500
    n_trees: int = 200
    subsample: int = 256
    seed: int = 42


@dataclass(frozen=True)
class DriftConfig:
    reference_events: int = 2000
    window_size: int = 1000
    interval: int = 200
    min_samples: int = 200
    feature_ks_p: float = 0.001
    feature_psi: float = 0.25
    pred_ks_p: float = 0.001
    pred_psi: float = 0.25
    threshold_method: str = "adaptive"
    fixed_score_threshold: float = 0.8
    alert_cooldown_events: int = 6
    weight_psi: float = 0.5
    weight_ks: float = 0.3
    weight_pred: float = 0.2
    baseline_min_evals: int = 20
    history_evals: int = 5000
    mean_shift_z: float = 2.5
    feature_threshold_k: float = 1.5
    adaptive_quantile: float = 0.90
    feature_alert_score: float = 0.65
    norm_cap: float = 3.0
    warning_enter: float = 0.80
    warning_exit: float = 0.60
    critical_enter: float = 1.00
    critical_exit: float = 0.80
    warning_vote: float = 0.20
    critical_vote: float = 0.35
    warning_consecutive: int = 1
    critical_consecutive: int = 3
    adwin_enabled: bool = True
    adwin_delta: float = 0.002
    adwin_clock: int = 32
    # "reference": flags fall back to false between evaluations; "latched": they stay.
    mode: str = "reference"


@dataclass(frozen=True)
class ControlConfig:
    enabled: bool = True
    target_rate: float = 0.01
    initial_threshold: float = 0.9972
    min_threshold: float = 0.9971
    max_threshold: float = 0.999
    max_step: float = 0.0005
    cooldown_seconds: float = 5.0
    min_history: int = 200
    history: int = 2000
    interval: int = 25
    audit_min_delta: float = 0.001
    audit_cooldown_seconds: float = 30.0
    audit_sample_rate: float = 0.01
    adapt_during_drift: bool = False
    rate_feedback: bool = False
    tolerance: float = 0.0
    lag_limit_seconds: float = 5.0


@dataclass(frozen=True)
class EngineConfig:
    features: FeatureConfig = field(default_factory=FeatureConfig)
    model: ModelConfig = field(default_factory=ModelConfig)
    drift: DriftConfig = field(default_factory=DriftConfig)
    control: ControlConfig = field(default_factory=ControlConfig)
    dedupe: bool = True


# Default workload phases (name, seconds, label, pattern).
PHASES = (
    ("normal", 210, 0, "baseline"),
    ("gradual_drift", 150, 1, "gradual"),
    ("sudden_drift", 120, 1, "sudden"),
    ("noisy_non_drift", 120, 0, "noisy"),
)

# Expected label of each phase.
PHASE_LABELS = {
    "normal": 0,
    "stable_baseline": 0,
    "gradual_drift": 1,
    "sudden_drift": 1,
    "noisy_non_drift": 0,
}
