"""Daily case/death/vaccination analytics.

Inputs follow the epidemic fixture: ``facts(continent, location, date,
population, new_cases, total_cases, new_deaths, total_deaths)`` where the
death columns are text (cast before use), and ``vacc(location, date,
new_vaccinations text, total_vaccinations)``. Rows with a NULL continent are
aggregate locations (continents, ``World``, ...).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.fixed_values import AGGREGATE_LOCATIONS
from ledgerline.functions.numeric import ratio_pct


def _countries(f: DataFrame) -> DataFrame:
    return f.filter(F.col("continent").isNotNull())


def case_listing(f: DataFrame) -> DataFrame:
    return _countries(f).select("location", "date", "total_cases", "new_cases",
                                "total_deaths", "population")


def case_listing_dashboard(f: DataFrame) -> DataFrame:
    return _countries(f).select("location", "date", "population", "total_cases", "total_deaths")


def death_pct_daily(f: DataFrame) -> DataFrame:
    """Deaths per case in percent; a missing death count counts as 0, a
    missing or zero case count gives NULL."""
    deaths = F.coalesce(F.col("total_deaths").cast("double"), F.lit(0.0))
    return _countries(f).select("location", "date", "total_cases", "total_deaths",
                                ratio_pct(deaths, "total_cases").alias("death_percentage"))


def infection_rate_daily(f: DataFrame) -> DataFrame:
    cases = F.coalesce(F.col("total_cases").cast("double"), F.lit(0.0))
    return _countries(f).select("location", "date", "population", "total_cases",
                                ratio_pct(cases, "population").alias("infection_rate"))


def peak_infection_by_location(f: DataFrame) -> DataFrame:
    """Highest case count per country and that maximum over the population."""
    g = _countries(f).groupBy("location", "population").agg(
        F.max("total_cases").alias("highest_case"))
    return g.withColumn("infection_rate", ratio_pct("highest_case", "population"))


def peak_infection_by_location_all(f: DataFrame, by_date: bool = False) -> DataFrame:
    """Dashboard variant: every location, maximum of the daily ratio."""
    keys = ["location", "population"] + (["date"] if by_date else [])
    return f.groupBy(*keys).agg(
        F.max("total_cases").alias("highest_infection_count"),
        (F.max(F.try_divide(F.col("total_cases").cast("double"),
                            F.col("population").cast("double"))) * 100)
        .alias("percent_population_infected"))


def peak_by_continent(f: DataFrame) -> DataFrame:
    """Highest *case* count per continent (the recipe labels it deaths)."""
    return _countries(f).groupBy("continent").agg(
        F.max(F.col("total_cases").cast("double")).alias("highest_cases"))


def global_fatality(f: DataFrame, guarded: bool = True) -> DataFrame:
    cases = F.sum("new_cases")
    deaths = F.sum(F.col("new_deaths").cast("bigint"))
    pct = ratio_pct(deaths, cases) if guarded else deaths.cast("double") / cases * 100
    return _countries(f).agg(cases.alias("total_cases"), deaths.alias("total_deaths"),
                             pct.alias("death_percentage"))


def deaths_by_aggregate_location(f: DataFrame,
                                 exclude: Sequence[str] = AGGREGATE_LOCATIONS) -> DataFrame:
    g = f.filter(F.col("continent").isNull() & ~F.col("location").isin(*exclude))
    return g.groupBy("location").agg(
        F.sum(F.col("new_deaths").cast("bigint")).alias("total_death_count"))


def _joined(f: DataFrame, v: DataFrame, countries_only: bool) -> DataFrame:
    base = _countries(f) if countries_only else f
    return base.select("continent", "location", "date", "population") \
               .join(v, ["location", "date"])


def rolling_vaccinations(f: DataFrame, v: DataFrame, countries_only: bool = True,
                         as_integer: bool = False) -> DataFrame:
    """Running vaccinations per location (window per location; its length
    is bounded by the number of days). The counts are summed as DOUBLE, or
    as integers with ``as_integer`` (the dashboard variant)."""
    w = Window.partitionBy("location").orderBy("date")
    j = _joined(f, v, countries_only)
    value = F.col("new_vaccinations").cast("int" if as_integer else "double")
    return j.select("continent", "location", "date", "population", "new_vaccinations",
                    F.sum(value).over(w).alias("rolling_people_vaccinated"))


def rolling_vaccinations_pct(f: DataFrame, v: DataFrame, as_integer: bool = False) -> DataFrame:
    r = rolling_vaccinations(f, v, as_integer=as_integer)
    return r.withColumn("percent_people_vaccinated",
                        ratio_pct("rolling_people_vaccinated", "population"))


def pct_vaccinated_table(f: DataFrame, v: DataFrame,
                         view: str = "percent_pop_vaccinated") -> DataFrame:
    """Typed staging table (numeric(18,0) columns round on insert), all
    locations, registered as a temp view (re-created idempotently) and read
    back with the percentage."""
    r = rolling_vaccinations(f, v, countries_only=False)
    typed = r.select(F.col("continent").cast("string"), F.col("location").cast("string"),
                     F.col("date").cast("timestamp_ntz"),
                     F.col("population").cast("decimal(18,0)").alias("population"),
                     F.col("new_vaccinations").cast("decimal(18,0)").alias("new_vaccinations"),
                     F.col("rolling_people_vaccinated").cast("decimal(18,0)")
                     .alias("rolling_people_vaccinated"))
    typed.createOrReplaceTempView(view)
    t = f.sparkSession.table(view)
    return t.select("continent", "location", "date",
                    F.col("population").cast("bigint").alias("population"),
                    F.col("new_vaccinations").cast("bigint").alias("new_vaccinations"),
                    F.col("rolling_people_vaccinated").cast("bigint").alias("rolling_people_vaccinated"),
                    ratio_pct("rolling_people_vaccinated", "population")
                    .alias("percent_people_vaccinated"))


def pct_vaccinated_view(f: DataFrame, v: DataFrame,
                        view: str = "percent_pop_vaccinated_view") -> DataFrame:
    """Stored query: register the rolling figures as a view, read it back."""
    rolling_vaccinations(f, v).createOrReplaceTempView(view)
    return f.sparkSession.table(view)


def max_vaccinations_daily(f: DataFrame, v: DataFrame) -> DataFrame:
    j = _joined(f, v, True)
    return j.groupBy("continent", "location", "date", "population").agg(
        F.max("total_vaccinations").alias("rolling_people_vaccinated"))
