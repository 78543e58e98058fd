"""One wide row for each beneficiary and year: aggregates, joins, rates, bands, interactions, window ranks, lags and trends.

Derived columns are declared in layers; each layer is one projection, so the plan does not grow with the count of
columns. Windows run over one beneficiary's years; places within a year are found by range (``ranking``).
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.functions import scalars as s
from tallyframe.operators.cleaning import CHRONIC_FLAGS, COVERAGE
from tallyframe.operators.ranking import row_numbers, tile
from tallyframe.sources.scratch import saved

KEY = ["bene_id", "year"]
FEATURE_VERSION = "features-1"
SETTINGS = ("inpatient", "outpatient", "carrier", "pde")
COSTS = {"inpatient": "inpatient_total_cost", "outpatient": "outpatient_total_cost", "carrier": "carrier_total_cost", "rx": "rx_total_cost"}


def safe_sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def _whole(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def aggregate_inpatient(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEY).agg(F.count_distinct("claim_id").alias("inpatient_claim_count"), safe_sum("payment_amount").alias("inpatient_total_cost"), _whole("claim_days").alias("inpatient_claim_days"), safe_sum("payment_amount").alias("inpatient_paid_utilization"))


def aggregate_outpatient(df: DataFrame) -> DataFrame:
    emergency = F.when(F.col("emergency_department_claim_flag"), 1).otherwise(0)
    return df.groupBy(*KEY).agg(F.count_distinct("claim_id").alias("outpatient_claim_count"), safe_sum("payment_amount").alias("outpatient_total_cost"), _whole("claim_days").alias("outpatient_claim_days"), _whole("estimated_line_count").alias("outpatient_line_count"), _whole(emergency).alias("outpatient_ed_claim_count"))


def aggregate_carrier(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEY).agg(F.count_distinct("claim_id").alias("carrier_claim_count"), safe_sum("payment_amount").alias("carrier_total_cost"), _whole("estimated_line_count").alias("carrier_line_count"), safe_sum("allowed_amount").alias("carrier_allowed_total"))


def aggregate_drugs(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEY).agg(F.count_distinct("pde_id").alias("pde_claim_count"), safe_sum("drug_cost").alias("rx_total_cost"), _whole("days_supply").alias("rx_days_supply"), safe_sum("patient_pay_amount").alias("rx_patient_pay_total"))


def unique_providers(*claims: DataFrame) -> DataFrame:
    events = reduce(DataFrame.unionByName, (c.select(*KEY, "provider_id") for c in claims)).where("provider_id is not null")
    return events.groupBy(*KEY).agg(F.count_distinct("provider_id").alias("unique_provider_count"))


def base(beneficiaries: DataFrame) -> DataFrame:
    df = beneficiaries.withColumn("age_years", s.age_at_year_end("year", "birth_date"))
    return df.select(
        *KEY, "age_years", s.age_band("age_years").alias("age_band"), s.age_5yr_band("age_years").alias("age_5yr_band"), "sex", "race_code", "state_code",
        s.enrollment_months(COVERAGE).alias("enrollment_months_count"), "chronic_condition_count", s.burden_band("chronic_condition_count").alias("chronic_burden_band"),
        *(F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in CHRONIC_FLAGS),
    )


ZERO_COUNTS = ("inpatient_claim_count", "outpatient_claim_count", "carrier_claim_count", "pde_claim_count", "inpatient_claim_days", "outpatient_claim_days", "outpatient_line_count", "outpatient_ed_claim_count", "carrier_line_count", "rx_days_supply", "unique_provider_count")
ZERO_AMOUNTS = (*COSTS.values(), "carrier_allowed_total", "rx_patient_pay_total")


def joined(base_rows: DataFrame, *aggregates: DataFrame) -> DataFrame:
    """The base with all aggregates on one key (one exchange for each input, none between the joins), gaps filled with 0."""
    df = reduce(lambda a, b: a.join(b, KEY, "left"), aggregates, base_rows)
    return df.fillna({c: 0 for c in ZERO_COUNTS} | {c: 0.0 for c in ZERO_AMOUNTS})


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def _total(cs) -> Column:
    return reduce(lambda a, b: a + b, map(F.col, cs))


def totals() -> dict[str, Column]:
    return {
        "total_claim_days": _total(["inpatient_claim_days", "outpatient_claim_days"]), "annual_claim_cost": _total(COSTS.values()), "total_claim_count": _total(f"{x}_claim_count" for x in SETTINGS),
        **{f"{x}_positive_cost": s.positive(c) for x, c in COSTS.items()}, "age_years_imputed": F.coalesce("age_years", F.lit(75)),
    }


def rates_and_bands() -> dict[str, Column]:
    months = F.col("enrollment_months_count")
    per_month = {
        "cost_per_enrollment_month": "annual_claim_cost", "claims_per_enrollment_month": "total_claim_count", "claim_days_per_enrollment_month": "total_claim_days", "providers_per_enrollment_month": "unique_provider_count",
        **{f"{x}_claims_per_enrollment_month": f"{x}_claim_count" for x in ("inpatient", "outpatient", "carrier")}, "rx_fills_per_enrollment_month": "pde_claim_count", "outpatient_ed_claims_per_enrollment_month": "outpatient_ed_claim_count", "rx_days_supply_per_enrollment_month": "rx_days_supply",
    }
    ratios = {
        "provider_fragmentation_index": ("unique_provider_count", "total_claim_count"), **{f"avg_{x}_cost_per_claim": (COSTS[x], f"{x}_claim_count") for x in ("inpatient", "outpatient", "carrier")}, "avg_rx_cost_per_fill": ("rx_total_cost", "pde_claim_count"),
        "outpatient_lines_per_claim": ("outpatient_line_count", "outpatient_claim_count"), "carrier_lines_per_claim": ("carrier_line_count", "carrier_claim_count"),
    }
    return {
        **{name: s.rate(c, "enrollment_months_count") for name, c in per_month.items()}, **{name: s.rate(a, b) for name, (a, b) in ratios.items()},
        "annualized_cost_per_enrolled_month": s.rate("annual_claim_cost", "enrollment_months_count", 12.0), "annualized_claims_per_enrolled_month": s.rate("total_claim_count", "enrollment_months_count", 12.0),
        "full_year_enrolled_flag": _flag(months == 12), "partial_year_enrolled_flag": _flag((months > 0) & (months < 12)), "zero_enrollment_flag": _flag(months <= 0), "low_enrollment_flag": _flag((months > 0) & (months <= 3)),
        "enrollment_months_band": s.enrollment_band("enrollment_months_count"), "enrollment_fraction": months.cast("double") / 12.0,
        **{f"any_{x}_claim": _flag(F.col(f"{x}_claim_count") > 0) for x in (*SETTINGS, "outpatient_ed")}, "multiple_provider_flag": _flag(F.col("unique_provider_count") > 1),
        "multi_setting_utilization_flag": _flag(s.row_count(F.col(f"{x}_claim_count") > 0 for x in SETTINGS) >= 2),
        **{f"{x}_cost_log1p": s.amount_log1p(c) for x, c in COSTS.items()}, "annual_cost_log1p": s.amount_log1p("annual_claim_cost"),
        **{f"{c}_log1p": s.count_log1p(c) for c in (*(f"{x}_claim_count" for x in SETTINGS), "total_claim_count", "unique_provider_count", "total_claim_days")},
        "positive_cost_total": _total(f"{x}_positive_cost" for x in COSTS), "chronic_burden_age_band": s.cross("chronic_burden_band", "age_band"), "chronic_burden_age_5yr_band": s.cross("chronic_burden_band", "age_5yr_band"), "sex_chronic_burden_band": s.cross("sex", "chronic_burden_band"),
        **{f"age_over_{a}": F.greatest(F.col("age_years_imputed") - a, F.lit(0)) for a in (65, 75, 85)}, "age_squared": F.col("age_years_imputed") * F.col("age_years_imputed"), "chronic_condition_count_squared": F.col("chronic_condition_count") * F.col("chronic_condition_count"),
    }


PRODUCTS = {
    "claims_per_month_chronic_count_interaction": ("claims_per_enrollment_month", "chronic_condition_count"),
    "providers_per_month_chronic_count_interaction": ("providers_per_enrollment_month", "chronic_condition_count"),
    "age_inpatient_claim_interaction": ("age_years_imputed", "inpatient_claim_count"),
    "age_total_claim_interaction": ("age_years_imputed", "total_claim_count"),
    "age_chronic_count_interaction": ("age_years_imputed", "chronic_condition_count"),
    "enrollment_months_total_claim_interaction": ("enrollment_months_count", "total_claim_count"),
    "enrollment_months_inpatient_interaction": ("enrollment_months_count", "inpatient_claim_count"),
}


def shares_and_interactions() -> dict[str, Column]:
    def only(c: str, value: str) -> Column:
        return F.when(F.col(c) == value, F.col("chronic_condition_count")).otherwise(0)

    return {
        **{f"{x}_cost_share": s.rate(f"{x}_positive_cost", "positive_cost_total") for x in COSTS}, **{name: F.col(a) * F.col(b) for name, (a, b) in PRODUCTS.items()},
        **{f"sex_{x}_chronic_count_interaction": only("sex", x) for x in ("male", "female")}, **{f"chronic_count_age_{b}": only("age_band", b) for _, b in s.AGE_BANDS},
    }


def year_position(df: DataFrame, median_exact: bool = False) -> DataFrame:
    """(bene_id, year, annual_cost_year_percentile, annual_cost_year_decile, annual_cost_year_median): place of the annual cost within its year.

    Equal costs share a percentile and are told apart by id in the deciles. Only key and cost are ranked, by range.
    """
    ranked = row_numbers(df.select(*KEY, "annual_claim_cost"), ["year"], ["annual_claim_cost", "bene_id"])
    ties = ranked.groupBy("year", "annual_claim_cost").agg((F.min("row_no") - 1).alias("_below"))
    if median_exact:  # the rows are numbered already: the mean of the one or two in the middle
        half = F.col("group_rows") / 2
        middle = (F.col("row_no") >= F.ceil(half)) & (F.col("row_no") <= F.floor(half) + 1)
        medians = ranked.groupBy("year").agg(F.avg(F.when(middle, F.col("annual_claim_cost"))).alias("annual_cost_year_median"))
    else:
        medians = ranked.groupBy("year").agg(F.percentile_approx("annual_claim_cost", 0.5).alias("annual_cost_year_median"))
    out = ranked.join(ties, ["year", "annual_claim_cost"]).join(F.broadcast(medians), "year")  # one row for each year
    percentile = F.when(F.col("group_rows") > 1, F.col("_below") / (F.col("group_rows") - 1)).otherwise(0.0)
    return out.select(*KEY, percentile.alias("annual_cost_year_percentile"), tile(F.col("row_no"), F.col("group_rows"), 10).alias("annual_cost_year_decile"), "annual_cost_year_median").dropDuplicates(KEY)


def prior_year(consecutive: bool = False) -> dict[str, Column]:
    """Values of the beneficiary's row before; with ``consecutive`` only where it is of the year before."""
    own = W.partitionBy("bene_id").orderBy("year")
    there = F.lag("year").over(own).isNotNull()
    if consecutive:
        there = there & (F.lag("year").over(own) == F.col("year") - 1)
    before = lambda c: F.coalesce(F.when(there, F.lag(c).over(own)), F.lit(0))
    high = _flag(F.col("annual_cost_year_decile") == 10)
    return {
        "has_prior_year": _flag(F.coalesce(there, F.lit(False))), **{f"prior_year_{c}": before(c) for c in ("annual_claim_cost", "inpatient_claim_count", "total_claim_count", "enrollment_months_count")},
        "annual_cost_to_year_median": s.rate("annual_claim_cost", "annual_cost_year_median"), "current_year_high_cost_indicator": high, "prior_year_high_cost_indicator": before(high),
    }


def trends() -> dict[str, Column]:
    has, cost, was = F.col("has_prior_year"), F.col("annual_claim_cost"), F.col("prior_year_annual_claim_cost")
    change = F.col("total_claim_count") - F.col("prior_year_total_claim_count")
    high = F.col("current_year_high_cost_indicator") + F.col("prior_year_high_cost_indicator")
    return {
        "two_year_avg_annual_claim_cost": (cost + F.when(has == 1, was).otherwise(0.0)) / (has + 1), "cost_trend_difference": cost - was, "cost_trend_ratio": s.rate("annual_claim_cost", "prior_year_annual_claim_cost"),
        "inpatient_claim_count_change": F.col("inpatient_claim_count") - F.col("prior_year_inpatient_claim_count"), "total_claim_count_change": change,
        "utilization_trend": F.when(has == 0, "no_prior").when(change > 0, "rising").when(change < 0, "falling").otherwise("flat"),
        "high_cost_last_2yr_count": high, "high_cost_1_of_last_2yr": _flag(high >= 1), "high_cost_2_of_last_2yr": _flag(high >= 2),
    }


def engineer(df: DataFrame, median_exact: bool = False, consecutive: bool = False) -> DataFrame:
    """All derived columns from the joined measures, which are written once, as places within a year read them apart."""
    df = row_features(saved(df, "measures"))
    df = df.join(year_position(df, median_exact), KEY, "left")
    for layer in (prior_year(consecutive), trends()):
        df = df.withColumns(layer)
    return df


def row_features(df: DataFrame) -> DataFrame:
    """The derived columns that need one row only: what scoring of new profiles shares with the build."""
    for layer in (totals(), rates_and_bands(), shares_and_interactions()):
        df = df.withColumns(layer)
    return df


# The age that a profile without one has, by its band.
AGE_MIDPOINTS = {"under_65": 60, "65_74": 70, "75_84": 80, "85_plus": 88, "unknown": 75}


# The fields of a raw profile that derived columns rest on.
RAW_FIELDS = [
    "age_band", "age_years", "sex", "race_code", "state_code", "enrollment_months_count", "chronic_condition_count", *CHRONIC_FLAGS,
    "inpatient_claim_count", "outpatient_claim_count", "carrier_claim_count", "pde_claim_count", "outpatient_ed_claim_count", "outpatient_line_count", "carrier_line_count", "rx_days_supply", "total_claim_days", "unique_provider_count",
    "rx_total_cost", "inpatient_total_cost", "outpatient_total_cost", "carrier_total_cost", "carrier_allowed_total", "rx_patient_pay_total",
    "annual_cost_year_percentile", "annual_cost_year_decile", "annual_cost_to_year_median", "has_prior_year", "prior_year_annual_claim_cost", "prior_year_inpatient_claim_count", "prior_year_total_claim_count", "prior_year_enrollment_months_count",
    "current_year_high_cost_indicator", "prior_year_high_cost_indicator",
]


def served(profiles: DataFrame) -> DataFrame:
    """The derived columns of raw profiles, by the expressions of the feature table.

    A profile has its counts and costs, total_claim_days, age_band, and its place in the year and the year before as
    given values. Missing numbers are 0; a missing age is the middle of its band, which then is the five-year band too.
    """
    numbers = [c for c, t in profiles.dtypes if t in ("int", "bigint", "double", "float", "smallint") and c not in (*KEY, "age_years")]
    known, band = F.col("age_years").isNotNull(), F.coalesce("age_band", F.lit("unknown"))
    middle = F.coalesce(F.create_map(*(F.lit(x) for pair in AGE_MIDPOINTS.items() for x in pair))[band], F.lit(AGE_MIDPOINTS["unknown"]))
    high = F.greatest(F.col("current_year_high_cost_indicator"), _flag(F.col("annual_cost_year_decile") == 10))
    df = profiles.fillna(0, numbers)
    df = df.withColumns({
        "age_missing_flag": _flag(~known), "age_5yr_band": F.when(known, s.age_5yr_band("age_years")).otherwise(band), "age_band": band, "age_years": F.when(known, F.col("age_years")).otherwise(middle),
        "chronic_burden_band": s.burden_band("chronic_condition_count"), "inpatient_claim_days": F.col("total_claim_days"), "outpatient_claim_days": F.lit(0), "current_year_high_cost_indicator": high,
    })
    return row_features(df).withColumns(trends())


def build(beneficiaries: DataFrame, inpatient: DataFrame, outpatient: DataFrame, carrier: DataFrame, drugs: DataFrame, **options) -> DataFrame:
    """The feature table: ids first, then measures, then derived columns by name."""
    measures = joined(base(beneficiaries), aggregate_inpatient(inpatient), aggregate_outpatient(outpatient), aggregate_carrier(carrier), aggregate_drugs(drugs), unique_providers(inpatient, outpatient, carrier))
    df = engineer(measures, **options)
    helpers = {f"{x}_positive_cost" for x in COSTS} | {"positive_cost_total", "inpatient_claim_days", "outpatient_claim_days", "inpatient_paid_utilization"}
    return df.select(*KEY, "annual_claim_cost", *sorted(set(df.columns) - helpers - {*KEY, "annual_claim_cost"}))


CATEGORICAL = ("age_band", "sex", "race_code", "state_code", "chronic_burden_band", "chronic_burden_age_band", "age_5yr_band", "chronic_burden_age_5yr_band", "sex_chronic_burden_band", "enrollment_months_band", "utilization_trend")


def numeric_features(df: DataFrame) -> list[str]:
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [c for c, t in df.dtypes if (t in numeric or t.startswith("decimal")) and c not in {*KEY, "label"}]


def reject_leakage(columns: list[str]) -> list[str]:
    """The columns, or an error where one tells the target; values of this and earlier years are allowed."""
    bad = [c for c in columns if c == "label" or c.startswith("target_") or c in {"next_year_annual_claim_cost"}]
    if bad:
        raise ValueError(f"columns tell the target: {', '.join(bad)}")
    return columns


def contract(df: DataFrame, order: list[str], ints: Collection[str] = (), longs: Collection[str] = ()) -> DataFrame:
    """The columns in the model's order and types; an error where one is missing."""
    if missing := [c for c in order if c not in df.columns]:
        raise ValueError(f"missing model columns: {', '.join(missing)}")
    kinds = dict(df.dtypes)
    return df.select(*(F.col(c).cast("int" if c in ints else "bigint" if c in longs else kinds[c]).alias(c) for c in order))


def read_export(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A CSV export of the feature table under ``schema`` (names and types), or an error that names what its header lacks."""
    header = spark.read.option("header", True).csv(path).columns
    if missing := sorted(set(required) - set(header)):
        raise ValueError(f"the export lacks {', '.join(missing)}")
    types = dict(x.rsplit(" ", 1) for x in schema.split(", "))
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*(F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in header))


def rederived(df: DataFrame) -> DataFrame:
    """Squares, interactions and logarithms made again from the columns that they rest on, where these are there."""
    age, chronic, have = F.col("age_years_imputed"), F.col("chronic_condition_count"), set(df.columns)
    made = {
        "age_squared": (("age_years_imputed",), age * age), "chronic_condition_count_squared": (("chronic_condition_count",), chronic * chronic),
        "age_chronic_count_interaction": (("age_years_imputed", "chronic_condition_count"), age * chronic), "age_total_claim_interaction": (("age_years_imputed", "total_claim_count"), age * F.col("total_claim_count")),
        **{f"{x}_log1p": ((x,), F.log1p(F.greatest(F.col(x).cast("double"), F.lit(0.0)))) for x in ("total_claim_count", "unique_provider_count", "inpatient_claim_count", "outpatient_claim_count", "carrier_claim_count", "pde_claim_count")},
        "annual_cost_log1p": (("annual_claim_cost",), F.log1p(F.greatest(F.col("annual_claim_cost").cast("double"), F.lit(0.0)))),
    }
    return df.withColumns({n: c for n, (needs, c) in made.items() if have.issuperset(needs)})


def table_quality(df: DataFrame) -> DataFrame:
    """One row of counts over the feature table, and the first reason not to publish it (null: publish).

    Rows are counted by key first, so that one distinct count is left, over keys.
    """
    number = lambda c: F.count(F.when(c, 1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    months, chronic = F.col("enrollment_months_count"), F.col("chronic_condition_count")
    negative = F.coalesce(F.least(*COSTS.values()) < 0, F.lit(False))
    counts = {
        "nonpositive_enrollment_month_count": months <= 0, "invalid_enrollment_month_count": (months < 0) | (months > 12),
        "invalid_chronic_condition_count": (chronic < 0) | (chronic > 11), "negative_component_cost_count": negative,
    }
    keys = df.groupBy("bene_id", "year").agg(F.count("*").alias("row_count"), *(number(c).alias(n) for n, c in counts.items()))
    no_key = F.col("bene_id").isNull() | F.col("year").isNull()
    missing = F.coalesce(F.sum(F.when(no_key, F.col("row_count"))), F.lit(0)).alias("missing_bene_year_key_count")
    out = keys.agg(total("row_count"), F.count_distinct("bene_id").alias("distinct_bene_id_count"), number(~no_key).alias("distinct_bene_year_count"), missing, *(total(n) for n in counts))
    out = out.withColumn("duplicate_bene_year_count", F.col("row_count") - F.col("missing_bene_year_key_count") - F.col("distinct_bene_year_count"))
    reason = F
    for c in ("missing_bene_year_key_count", "duplicate_bene_year_count"):
        reason = reason.when(F.col(c) > 0, c)
    reason = reason.when(F.col("row_count") < 1, "row_count")
    for c in ("invalid_enrollment_month_count", "invalid_chronic_condition_count", "negative_component_cost_count"):
        reason = reason.when(F.col(c) > 0, c)
    return out.withColumn("blocking", reason)
