"""Literals the recipes define and results depend on. They
are used as operator defaults and can be overridden by callers."""

# --- fixed values ------------------------------------------------------------
# aggregate (non-country) locations excluded from the per-location death totals
AGGREGATE_LOCATIONS = ("World", "European Union", "International")

# one discount per order: no delivered orders -> 15 %; order value above 500 -> 10 %;
# 5 or more delivered orders -> 5 %; otherwise 0 %
NEW_CUSTOMER_PCT = 15
BIG_ORDER_PCT = 10
BIG_ORDER_THRESHOLD = 500
LOYAL_PCT = 5
LOYAL_MIN_ORDERS = 5

# customer tiers by lifetime-value tercile, highest first
TIER_LABELS = ("Gold", "Silver", "Bronze")

# orphan labels, checked in this order
MISSING_ORDER = "Missing Order"
MISSING_PRODUCT = "Missing Product"

# sold-as-vacant flag recode
VACANT_RECODE = {"Y": "Yes", "N": "No"}

# age bands: below 35, 35 to 55 inclusive, above 55
BAND_CUTS = (35, 55)
BAND_LABELS = ("Young", "Middle", "Senior")

# text date format of the raw layoffs table (month/day without leading zeros)
US_DATE_FORMAT = "M/d/yyyy"

# zip code width
ZIP_WIDTH = 5

# share of each class held out for testing
TEST_FRACTION = "0.2"
