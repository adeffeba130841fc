"""The order in which reports are presented (O1, O2): the last step of the
queries named here. Without it a result is a set; with it, rows come in the
report's order, sorted by range partitions. ``engine`` says where NULLs go: the
e-commerce reports count them as largest, the others as smallest."""

from __future__ import annotations

from functools import wraps

from ledgerline.operators import ordering

LARGEST, SMALLEST = "postgres", "smallest"

# report: (NULL placement, columns; a leading minus means descending)
ORDER = {
    "case_listing": (SMALLEST, ["location", "date"]),
    "case_listing_dashboard": (SMALLEST, ["location", "date"]),
    "death_pct_daily": (SMALLEST, ["location", "date"]),
    "infection_rate_daily": (SMALLEST, ["location", "date"]),
    "peak_infection_by_location": (SMALLEST, ["-infection_rate"]),
    "peak_infection_by_location_all": (SMALLEST, ["-percent_population_infected"]),
    "peak_infection_by_location_day": (SMALLEST, ["-percent_population_infected"]),
    "peak_by_continent": (SMALLEST, ["-highest_cases"]),
    "deaths_by_aggregate_location": (SMALLEST, ["-total_death_count"]),
    "rolling_vaccinations": (SMALLEST, ["location", "date"]),
    "max_vaccinations_daily": (SMALLEST, ["continent", "location", "date"]),
    "sold_as_vacant_histogram": (SMALLEST, ["n"]),
    "industry_domain": (SMALLEST, ["industry"]),
    "complete_shutdowns": (SMALLEST, ["-funds_raised_millions"]),
    "total_by_company": (SMALLEST, ["-total_laid_off"]),
    "total_by_industry": (SMALLEST, ["-total_laid_off"]),
    "total_by_stage": (SMALLEST, ["-total_laid_off"]),
    "total_by_year": (SMALLEST, ["-year"]),
    "rolling_total_by_year": (SMALLEST, ["period"]),
    "rolling_total_by_month": (SMALLEST, ["period"]),
    "top_companies_per_year": (SMALLEST, ["-total_laid_off"]),
    "seasonal_top_categories": (LARGEST, ["month", "ranking"]),
    "best_seller_per_seller_category": (LARGEST, ["seller_id", "-revenue"]),
    "bought_together": (LARGEST, ["-bought_together_count"]),
    "consecutive_month_streaks": (LARGEST, ["-consecutive_months"]),
    "moving_average_7": (LARGEST, ["order_date"]),
}


def keys(name: str):
    engine, columns = ORDER[name]
    out = []
    for c in columns:
        down = c.startswith("-")
        nulls = engine if engine == LARGEST else "last" if down else "first"
        out.append(ordering.key(c.lstrip("-"), descending=down, nulls=nulls))
    return out


def presented(name: str, query):
    """``query`` with its rows in the report's order."""
    @wraps(query)
    def report(spark, sf):
        return ordering.present(query(spark, sf), *keys(name))
    return report
