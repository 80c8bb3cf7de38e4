"""Fixed domain values that results depend on."""

# Leverage tier -> share of positions.
LEVERAGE_SHARES = {5: 0.15, 10: 0.30, 25: 0.25, 50: 0.20, 100: 0.10}

# Fixed value: base maintenance margin rate.
BASE_MAINTENANCE_RATE = 0.004

# Fixed values: (max notional, maintenance rate, maintenance amount).
MAINTENANCE_TIERS = [
    (50_000.0, 0.004, 0.0),
    (250_000.0, 0.005, 50.0),
    (1_000_000.0, 0.01, 1_300.0),
    (10_000_000.0, 0.025, 16_300.0),
    (20_000_000.0, 0.05, 266_300.0),
    (50_000_000.0, 0.10, 1_266_300.0),
    (100_000_000.0, 0.125, 2_516_300.0),
    (200_000_000.0, 0.15, 5_016_300.0),
    (300_000_000.0, 0.25, 25_016_300.0),
    (500_000_000.0, 0.50, 100_016_300.0),
]

# Model confidences and ensemble weights.
MODEL_CONFIDENCE = {"standard": 0.95, "bias": 0.95, "funding": 0.75, "depth": 0.85, "ensemble": 0.85}

# Scorecard windows and tolerances.
TOUCH_BAND_BPS = 5
TOUCH_WINDOW_SECONDS = 4 * 3600
CONFIRM_WINDOW_SECONDS = 15 * 60
PATH_WINDOW_SECONDS = 3600

# Test weights and overall grade cut-offs.
TEST_WEIGHTS = {"funding_correlation": 0.40, "oi_conservation": 0.35, "directional_positioning": 0.25}
