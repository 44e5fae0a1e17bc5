"""Settings of every step. Values marked *fixed* define the results and must not drift."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: column roles and the words that hint at them -------------------------
ROLES = ("date", "sku", "quantity", "category", "price", "promo")
REQUIRED_ROLES = ("date", "sku", "quantity")
ROLE_KEYWORDS = {
    "date": ("date", "time", "timestamp", "period", "day", "week", "month", "year"),
    "sku": ("sku", "item", "product", "article", "code", "id", "upc", "ean"),
    "quantity": ("quantity", "qty", "sales", "demand", "units", "volume", "count"),
    "category": ("category", "group", "family", "class", "type", "segment"),
    "price": ("price", "cost", "value", "amount", "revenue"),
    "promo": ("promo", "promotion", "discount", "offer", "sale", "campaign"),
}
PROMO_WORDS = ("0", "1", "yes", "no", "true", "false", "y", "n")
ROLE_THRESHOLD = 0.7
DIALOG_THRESHOLD = 0.5

# --- fixed values: date formats, tried in this order ------------------------------------
# (strptime form, Spark form)
DATE_FORMATS = (
    ("%Y-%m-%d", "yyyy-M-d"),
    ("%d/%m/%Y", "d/M/yyyy"),
    ("%m/%d/%Y", "M/d/yyyy"),
    ("%Y/%m/%d", "yyyy/M/d"),
    ("%d-%m-%Y", "d-M-yyyy"),
    ("%m-%d-%Y", "M-d-yyyy"),
    ("%Y%m%d", "yyyyMMdd"),
    ("%d.%m.%Y", "d.M.yyyy"),
    ("%Y.%m.%d", "yyyy.M.d"),
    ("%b %d, %Y", "MMM d, yyyy"),
    ("%B %d, %Y", "MMMM d, yyyy"),
    ("%d %b %Y", "d MMM yyyy"),
    ("%d %B %Y", "d MMMM yyyy"),
)

# --- fixed values: quality bands --------------------------------------------------------
QUALITY_BANDS = (("excellent", 90), ("good", 75), ("fair", 60), ("poor", 40), ("critical", 0))
MIN_POINTS_PER_ITEM = 7

QUALITY_TEXTS = {  # issue (a format of the figure) and advice
    "missing": ("%.1f%% missing values detected", "fill missing values with forward fill or interpolation"),
    "duplicates": ("%,d duplicate entries found", "aggregate duplicates by sum or average"),
    "negatives": ("%,d negative quantity values", "review negative values - may indicate returns"),
    "points": (f"low data points per item: %.1f (minimum recommended: {MIN_POINTS_PER_ITEM})", "consider weekly or monthly aggregation"),
}

# --- fixed values: texts about columns --------------------------------------------------
DETECTION_TEXTS = {
    "unknown": "Could not determine type for '{name}'",
    "sure": "'{name}' looks like your {role} column",
    "unsure": "'{name}' might be your {role} column",
}
MAPPING_ERRORS = {
    "date": "Date column is required",
    "sku": "Item/SKU column is required",
    "quantity": "Quantity/Sales column is required",
    "absent": "Column '{name}' not found in data",
    "twice": "Column '{name}' is mapped twice",
}

# --- fixed values: cluster labels -------------------------------------------------------
TIERS = ("A", "B", "C")
PATTERNS = ("seasonal", "erratic", "variable", "steady")
TIER_LABELS = {"A": "High Volume", "B": "Medium Volume", "C": "Low Volume"}
PATTERN_LABELS = {
    "seasonal": "Seasonal",
    "erratic": "Erratic",
    "variable": "Variable",
    "steady": "Steady",
}

# --- fixed values: anomaly texts --------------------------------------------------------
ANOMALY_TEXTS = {
    "spike": "Unusual high value",
    "drop": "Unusual low value",
    "zero": "Unexpected zero sales",
    "negative": "Negative value detected",
    "gap": "Missing data period",
}

# --- fixed values: features -------------------------------------------------------------
FEATURE_TEXTS = {
    "lag_1": "yesterday's sales predict today",
    "lag_7": "last week's sales predict this week",
    "lag_28": "last month's sales predict this month",
    "rolling_mean_7": "average sales over past week",
    "rolling_mean_28": "average sales over past month",
    "rolling_std_7": "sales variability over past week",
    "rolling_std_28": "sales variability over past month",
    "year": "year number for trend detection",
    "month": "month of year for seasonality",
    "week_of_year": "week number for weekly patterns",
    "day_of_week": "weekday vs weekend patterns",
    "is_weekend": "saturday and sunday flag",
    "is_holiday": "holiday impact on sales",
    "days_to_holiday": "proximity to upcoming holiday",
    "price_change_pct": "price changes affect demand",
    "price_relative_to_avg": "price compared to average",
    "promo_flag": "promotion active indicator",
    "promo_intensity": "promotion strength measure",
    "seasonal_index": "seasonal pattern strength",
    "trend_component": "long-term trend direction",
}
ALL_20 = tuple(FEATURE_TEXTS)
TOP_10 = (
    "lag_1", "lag_7", "lag_28", "rolling_mean_7", "rolling_mean_28",
    "month", "week_of_year", "day_of_week", "seasonal_index", "trend_component",
)
BASIC_5 = ("lag_1", "lag_7", "rolling_mean_7", "month", "day_of_week")
FEATURE_SETS = {"all_20": ALL_20, "top_10": TOP_10, "basic_5": BASIC_5}
TIER_FEATURE_SET = {"A": "all_20", "B": "top_10", "C": "basic_5"}
IMPACT_LEVELS = {
    "High": ("lag_1", "lag_7", "rolling_mean_7", "seasonal_index", "trend_component"),
    "Medium": ("lag_28", "rolling_mean_28", "month", "day_of_week", "is_holiday"),
}

# --- fixed values: forecasting ----------------------------------------------------------
STRATEGIES = {
    "simple": ("naive", "seasonal_naive", "exponential_smoothing"),
    "balanced": ("exponential_smoothing", "arima", "theta", "additive"),
    "advanced": ("gbt_leaf", "gbt_depth", "ensemble"),
}
ENSEMBLE_MEMBERS = ("exponential_smoothing", "arima", "theta")
COMPARED_MODELS = ("naive", "seasonal_naive", "exponential_smoothing", "arima", "theta")
SEASON_LENGTH = {"D": 7, "W": 52, "M": 12}
SEASONAL_MIN_OBS = {"D": 14, "W": 104, "M": 24}
FREQUENCY_LABELS = {"D": "Daily", "W": "Weekly", "M": "Monthly"}
HORIZON_DAYS = {"short": 7, "medium": 30, "long": 90, "extended": 180}
BAND_Z = 1.96


@dataclass(frozen=True)
class ClusterConfig:
    """Thresholds of the rule clustering. Fixed volumes are used when they are given."""

    top_percentiles: tuple[float, float] = (80.0, 50.0)
    fixed_volumes: tuple[float, float] | None = None
    seasonal: float = 0.6
    erratic: float = 0.8
    variable: float = 0.3

    def with_volumes(self, a: float = 1000.0, b: float = 100.0) -> "ClusterConfig":
        return ClusterConfig(self.top_percentiles, (a, b), self.seasonal, self.erratic, self.variable)


@dataclass(frozen=True)
class AnomalyConfig:
    iqr_multiplier: float = 1.5
    z_threshold: float = 3.0
    rolling_window: int = 7
    rolling_threshold: float = 2.5
    min_zero_run: int = 3


@dataclass(frozen=True)
class SkewConfig:
    """Bounds for what one task may hold.

    An item with more than about ``hot_rows`` rows is cut into consecutive segments of that size.
    """

    hot_rows: int = 4_000_000


@dataclass(frozen=True)
class GridConfig:
    """Parameter grids searched by the folds (own choice, see README).

    With ``refine`` the best grid point is where a bounded search starts: smoothing then has no
    larger error than the grid's, and ARIMA maximises its exact likelihood.
    """

    alphas: tuple[float, ...] = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9)
    betas: tuple[float, ...] = (0.0, 0.01, 0.05, 0.1, 0.2)
    gammas: tuple[float, ...] = (0.01, 0.05, 0.1, 0.3, 0.5)
    phis: tuple[float, ...] = tuple(round(-0.9 + 0.2 * i, 2) for i in range(10))
    thetas: tuple[float, ...] = (-0.99, -0.95, -0.9, -0.8, -0.6, -0.4, -0.2, 0.0, 0.2, 0.4, 0.6, 0.8, 0.95)
    theta_alphas: tuple[float, ...] = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99)
    refine: bool = False


CLUSTER = ClusterConfig()
ANOMALY = AnomalyConfig()
SKEW = SkewConfig()
GRID = GridConfig()

SAMPLE_SEED = 42
