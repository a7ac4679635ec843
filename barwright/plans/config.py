"""All parameters of a run, and the fingerprint that cached results are kept under."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Config:
    swing_lookback: int = 3
    equal_tolerance: float = 0.0015
    gap_min_share: float = 0.0
    gap_min_atr: float = 0.5
    recent_bars: int = 3
    adx_threshold: float = 20.0
    horizon: int = 5
    warmup: int = 250
    thresholds: tuple[int, ...] = (35, 40, 45, 50, 55, 60, 65)
    min_trades: int = 30
    alpha: float = 0.05
    default_threshold: int = 50
    bars_per_year: int = 252
    stop_buffer_atr: float = 0.25
    atr_stop_mult: float = 1.5
    stop_risk_scale: float = 1.0
    fallback_target_r: float = 2.0
    min_rr: float = 0.5
    max_rr: float = 10.0
    exit_mode: str = "fixed"
    max_holding: int = 20
    trailing_max_holding: int = 250
    trail_atr_mult: float = 5.0
    entry_offset_atr: float = 0.5
    entry_valid_bars: int = 1
    entry_fallback: str = "market"
    broker_discount: float = 0.6
    spread: float = 0.0002
    regulatory: float = 0.00003
    commission: float = 0.0
    ml_enabled: bool = False
    ml_retrain_every: int = 10
    ml_min_train_rows: int = 80
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))

    def fingerprint(self) -> str:
        """Of every field, so that no change of a parameter meets a stale result."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


#: The default weight of each score component.
WEIGHTS = {
    "zone": 15, "order_block": 15, "fvg": 10, "choch": 15, "bos": 8, "sweep": 7,
    "rsi": 5, "macd": 5, "ema_stack": 5, "adx_di": 5, "ml": 20,
}
