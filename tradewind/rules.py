"""Business rules: every threshold, keyword and table name in one place.

Operators take these as arguments whose defaults are the values below, so a
caller can run the same pipeline under other rules.
"""

from __future__ import annotations

from dataclasses import dataclass

# They decide results and must stay as they are.
PRODUCT_CODE = "ELF"
BLANK_SHARE_LIMIT = 0.8
NULL_PCT_HIGH = 20
NULL_PCT_MEDIUM = 5
HEALTHY_FROM = 90
WARNING_FROM = 70
NUMERIC_KEYWORDS = (
    "quantity", "amount", "price", "cost", "total", "stock", "unit", "reorder", "hand",
)
DATE_KEYWORDS = ("date", "time", "created", "updated")
SKU_KEYWORD = "sku"
TARIFF_RATES = {
    "estimated_tariff_cost": 0.15,
    "revenue_after_tariff": 0.85,
    "high_tariff_scenario": 0.60,
    "revenue_after_high_tariff": 0.40,
}
TARIFF_RISK = {"USA": "HIGH_RISK", "CHINA": "CRITICAL_RISK"}
TARIFF_RISK_DEFAULT = "LOW_RISK"
LOW_STOCK_FACTOR = 1.5
AT_RISK_TARGET_SHARE = 0.8
CHANNEL_TIERS = ((100, "HIGH_VALUE_CHANNEL"), (50, "MEDIUM_VALUE_CHANNEL"))
CHANNEL_TIER_DEFAULT = "LOW_VALUE_CHANNEL"
PRODUCT_TIERS = (
    (10000, "HERO_PRODUCT"), (5000, "STRONG_PRODUCT"), (1000, "GROWING_PRODUCT"),
)
PRODUCT_TIER_DEFAULT = "WEAK_PRODUCT"
CUSTOMER_SEGMENTS = ((10000, "VIP"), (5000, "LOYAL"), (1000, "REGULAR"))
CUSTOMER_SEGMENT_DEFAULT = "NEW"
ACTIVE_WITHIN_DAYS = 30
AT_RISK_WITHIN_DAYS = 90
RUNS_SHOWN, QUARANTINE_SHOWN, ALERTS_SHOWN, QUERIES_SHOWN = 20, 50, 50, 20
RESULT_SHOWN, CHART_ROWS, SERIES_ROWS = 50, 20, 10
SERIES_LABEL_CHARS = 15
CATALOG_COLUMNS_SHOWN = 10


def sku_pattern(code: str = PRODUCT_CODE) -> str:
    """Whole-string pattern of a valid SKU: the code, a dash, five digits."""
    return f"{code}-[0-9]{{5}}"


@dataclass(frozen=True)
class TableNames:
    """Warehouse table names, all derived from the product code."""

    code: str = PRODUCT_CODE

    def bronze(self, entity: str) -> str:
        return f"BRZ_MYSQL_{self.code}_{entity}".upper()

    def silver(self, entity: str) -> str:
        return f"SLV_{self.code}_{entity}".upper()

    def gold(self, model: str) -> str:
        return f"GOLD_{model}".upper()

    def brand_gold(self, model: str) -> str:
        return f"GOLD_{self.code}_{model}".upper()

    @property
    def product_history(self) -> str:
        return f"SCD2_{self.code}_PRODUCTS"
