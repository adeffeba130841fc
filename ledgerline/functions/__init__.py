"""Column -> Column helpers. All are built-in Spark expressions
(whole-stage codegen, no Python in the data path)."""

from ledgerline.functions.text import (accent_fold, blank_to_null, fold_key,
                                       pad_code, recode, recode_prefix,
                                       split_first, split_right, strip_trailing,
                                       trim_lower)
from ledgerline.functions.dates import (day_start, month_start, parse_date,
                                        seconds_between, shift_months,
                                        to_date_only, week_start, year_text,
                                        year_month_text)
from ledgerline.functions.numeric import as_double_money, money, ratio_pct, sigmoid

__all__ = [
    "accent_fold", "blank_to_null", "fold_key", "pad_code", "recode",
    "recode_prefix", "split_first", "split_right", "strip_trailing",
    "trim_lower", "day_start", "month_start", "parse_date", "seconds_between",
    "shift_months", "to_date_only", "week_start", "year_text",
    "year_month_text", "as_double_money", "money", "ratio_pct", "sigmoid",
]
