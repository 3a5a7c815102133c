"""Values the results depend on. Everything here is a plain parameter."""

BAR_COLUMNS = ("timestamp", "ticker", "open", "high", "low", "close", "volume")
PRICE_COLUMNS = ("open", "high", "low", "close")

# Signal inputs, their thresholds and the flags they raise.
SIGNAL_FEATURES = (
    "drawdown_60d",
    "price_zscore_20d",
    "distance_from_low_20d",
    "relative_return_10d",
)
SIGNAL_COMPONENTS = (
    "dip_drawdown_component",
    "dip_price_zscore_component",
    "dip_low_proximity_component",
    "dip_relative_weakness_component",
)
LOOKBACK = 252
MIN_HISTORY = 126
QUANTILE = 0.2
REQUIRED_COMPONENTS = 3
ANNUALIZATION = 252.0

# Outcome horizons, barrier defaults and trading costs.
HORIZONS = (1, 3, 5, 10, 20)
HOLDING_BARS = 10
TAKE_PROFIT = 0.10
STOP_LOSS = 0.07
COMMISSION = 0.0001
SLIPPAGE = 0.0005
SPLITS = ("research", "validation", "test")

# Bootstrap settings.
BLOCK_SIZE = 20
DRAWS = 2000
SEED = 42
CONFIDENCE = 0.95

# Axes of the exit-policy catalogue, as the text used in its ids.
FIXED_PAIRS = (
    (2, 4), (3, 4), (3, 6), (4, 6), (4, 8), (5, 8), (5, 10), (6, 8), (6, 12), (7, 8),
    (7, 12), (8, 10), (8, 12), (8, 15), (10, 12), (10, 15), (10, 20), (12, 15), (12, 20), (15, 20),
)
STOP_MULTIPLIERS = ("0.75", "1", "1.25", "1.5", "2", "2.5", "3", "4")
TARGET_MULTIPLIERS = ("1", "1.5", "2", "2.5", "3", "4", "5")
REWARD_RISK_RATIOS = ("0.75", "1", "1.25", "1.5", "2", "2.5", "3")
STOP_BOUNDS = (0.01, 0.20)
TARGET_BOUNDS = (0.01, 0.30)
MINIMUM_TRAINING_TRADES = 200
PLATEAU_TOLERANCE = 0.0005
POLICY_FAMILIES = ("fixed", "atr", "r_multiple")
CONTROL_POLICIES = ("v1_control", "target_only", "stop_only", "time_only")

# Diagnosis bins (right-closed edges) and path levels.
DIAGNOSIS_EDGES = {
    "return_5d": (-0.05, 0.0),
    "atr_pct_14": (0.02, 0.04),
    "relative_volume_20d": (1.0, 2.0),
    "relative_return_10d": (-0.05, 0.0),
    "drawdown_change_5": (-0.05, 0.0),
    "benchmark_return_20d": (-0.05, 0.0),
    "benchmark_drawdown_20d": (-0.10, -0.05),
    "benchmark_volatility_20d": (0.15, 0.25),
    "entry_gap": (-0.01, 0.01),
}
REBOUND_LEVELS = (2, 5, 10)
PRIOR_RECOVERY = 0.05
MAXIMUM_AGE_DAYS = 365
ZONE_DISTANCE = 0.02
VOLATILITY_QUANTILES = (1 / 3, 2 / 3)
REGIME_WINDOW = 200

# What a context record and a decision record may hold.
CONTEXT_FIELDS = (
    "open", "high", "low", "close", "volume", "atr_14", "atr_pct_14",
    "return_5d", "return_10d", "drawdown_60d", "relative_volume_20d",
    "relative_return_10d", "benchmark_return_20d", "benchmark_drawdown_20d",
    "benchmark_volatility_20d",
)
SYMBOL_PATTERN = r"^[A-Z0-9^][A-Z0-9.^=-]{0,31}$"
RESERVED_SYMBOL_PATTERN = r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"
