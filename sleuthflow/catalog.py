"""Risk catalogs: field names, bounds, weights and thresholds used by every operator."""

from __future__ import annotations

# Results depend on these exact names, orders and numbers.

OPERATIONAL_BOUNDS = {
    "tx_count_total": (10.0, 2_000_000.0),
    "unique_counterparties": (2.0, 300_000.0),
    "new_clients_current": (1.0, 1_000_000.0),
    "new_clients_previous": (1.0, 1_000_000.0),
    "referred_clients_current": (0.0, 1_000_000.0),
    "incoming_funds": (1.0, 10_000_000_000.0),
    "payouts_total": (0.0, 10_000_000_000.0),
    "top1_wallet_share": (0.0, 1.0),
    "top10_wallet_share": (0.0, 1.0),
    "avg_holding_days": (1.0, 365.0),
    "repeat_investor_share": (0.0, 1.0),
    "max_referral_depth": (1.0, 30.0),
}

FEATURE_BOUNDS = {
    "growth_rate": (0.0, 1.2),
    "referral_ratio": (0.0, 1.0),
    "payout_dependency": (0.1, 1.9),
    "centralization_index": (0.0, 1.0),
    "avg_holding_time": (3.0, 120.0),
    "reinvestment_rate": (0.0, 1.0),
    "gini_coefficient": (0.1, 1.0),
    "transaction_entropy": (0.3, 5.0),
    "structural_depth": (2.0, 16.0),
}

THRESHOLD_POLICY = "fixed_0.4_0.7"

BORDERLINE_TARGET = 0.15
BORDERLINE_TOLERANCE = 0.02
MIN_CORRELATION = 0.2
MIN_OVERLAP = 0.05
LABEL_SHARE_RANGE = (0.48, 0.52)

TYPOLOGIES = [
    "LEGAL_LAYERING",
    "LEGAL_TO_CRYPTO_BRIDGE",
    "CRYPTO_MIXING",
    "STRUCTURED_SPLITTING",
    "CASH_OUT",
]

EVENT_FIELDS = [
    "event_id",
    "ts",
    "amount",
    "currency",
    "sender_id",
    "receiver_id",
    "sender_type",
    "receiver_type",
    "channel",
    "jurisdiction",
    "asset_type",
]
CHANNELS = ["crypto", "legal"]
PAYER_TYPES = ["company", "legal_entity", "merchant"]

CASE_BANDS = [(0.85, "CRITICAL"), (0.70, "HIGH"), (0.45, "MEDIUM")]
MODEL_BANDS = [(0.7, "High"), (0.4, "Medium")]
COMPANY_BANDS = [(0.70, "Critical"), (0.50, "High"), (0.30, "Medium")]

COMPANY_NORM_BOUNDS = {
    "dependency_ratio": (0.0, 1.5),
    "crypto_exposure_ratio": (0.0, 0.8),
    "concentration_index": (0.0, 0.7),
    "avg_holding_time": (1.0, 50.0),
    "entropy_of_flows": (0.0, 1.0),
}
COMPANY_METRIC_DEFAULTS = {
    "dependency_ratio": 0.0,
    "crypto_exposure_ratio": 0.0,
    "concentration_index": 0.0,
    "avg_holding_time": 90.0,
    "entropy_of_flows": 0.5,
}
COMPANY_WEIGHTS = {
    "dependency_ratio": 0.25,
    "crypto_exposure_ratio": 0.20,
    "concentration_index": 0.20,
    "inverse_holding_time": 0.20,
    "inverse_entropy": 0.15,
}
COMPANY_LEVEL_LABELS = [
    ("Low", "Низкий", "✅"),
    ("Medium", "Средний", "⚠️"),
    ("High", "Высокий", "🔶"),
    ("Critical", "Критический", "🚨"),
]
CONTRIBUTION_SEVERITY = [(0.15, "red"), (0.08, "orange"), (0.04, "yellow")]

# Longest case window a request may ask for.
MAX_WINDOW_HOURS = 720

# End of fixed values.

FEATURES = list(FEATURE_BOUNDS)
OPERATIONAL = list(OPERATIONAL_BOUNDS)

# Version tags stamped on case scores; callers may pass their own.
MODEL_VERSION = "case-fusion-v2"
CALIBRATION_VERSION = "iso-v1"
