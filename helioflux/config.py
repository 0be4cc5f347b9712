"""Constants of the analysis; all are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    bin_s: float = 10.0
    bg_window: int = 120
    bg_least: int = 30
    min_dur_bins: int = 6
    merge_gap_s: float = 120.0
    focus_threshold: float = 300.0
    focus_curves: int = 64
    focus_window: int = 360
    rise_ratio: float = 1.4
    fred_fast: float = 0.5
    fred_slow: float = 0.9
    neupert_corr: float = 0.30
    heat_timing_s: float = 300.0
    qpp_agree: float = 0.30
    sig_ratio: float = 8.0
    lookback_min: int = 30
    lead_min: int = 30
    step_min: int = 5
    decay_min: int = 90
    decay_floor_min: int = 10
    decay_flux: float = 2.0
    time_cap_min: float = 1440.0
    history_tau_s: float = 21600.0
    energy_ratio: float = 5.0
    test_fraction: float = 0.3
    dense_min: int = 1
    rows_seen: float = 0.6


#: Driver tables are sparser than instrument data: wider bins and a narrower background frame
STAND_IN = Config(bin_s=600.0, bg_window=24, bg_least=6, min_dur_bins=2, merge_gap_s=1200.0, focus_threshold=25.0, lookback_min=180, step_min=30, sig_ratio=4.0, energy_ratio=3.0, rows_seen=0.0)
KEV_TO_JOULE = 1.602176634e-16
CM2_TO_M2 = 1e-4
KEV_PER_MK = 0.08617
