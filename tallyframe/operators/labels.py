"""Next-year labels without leakage: the year-to-year join, hash splits, thresholds and label sensitivity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import ranking
from tallyframe.sources.scratch import saved

#: The version of the split that audits name: a hash of the beneficiary in hundredths, 15 for test and 15 for validation.
SPLIT_VERSION = "beneficiary-hash-70-15-15"


def next_year(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row of year t with feature_year, target_year and the cost of the same beneficiary's year t + 1.

    Only the columns needed of year t + 1 are shuffled for the second side.
    """
    later = df.select("bene_id", (F.col("year") - 1).alias("year"), F.col("year").alias("target_year"), F.col("annual_claim_cost").alias("target_annual_claim_cost"), *(F.col(c).alias(f"target_{c}") for c in keep))
    return df.join(later, ["bene_id", "year"]).withColumn("feature_year", F.col("year"))


def xxhash_bucket(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(100)).cast("int")


def md5_bucket(c: str) -> Column:
    """The same for engines without that hash."""
    return (F.conv(F.substring(F.md5(F.col(c).cast("binary")), 1, 7), 16, 10).cast("long") % 100).cast("int")


def assign_split(df: DataFrame, id_col: str = "bene_id", bucket=xxhash_bucket) -> DataFrame:
    """split_name from a hash of the id alone, so all rows of an id are in one split. No shuffle; rows without id go."""
    b = bucket(id_col)
    return df.where(F.col(id_col).isNotNull()).withColumn("split_name", F.when(b < 15, "test").when(b < 30, "validation").otherwise("train"))


def split(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split_name") == name)


def quantile(df: DataFrame, by: list[str], c: str, q: float, name: str, exact: bool = False) -> DataFrame:
    """(by, name): an element of each group's values, approximate (in rank, by 1 / 10,000) or exact and discrete."""
    if exact:
        return ranking.quantiles(df, by, c, {name: q}, discrete=True)
    return df.groupBy(*by).agg(F.percentile_approx(c, q, F.lit(10_000)).alias(name))


def training_threshold(df: DataFrame, q: float = 0.9, exact: bool = False) -> DataFrame:
    """One row: the quantile of the target cost over training rows only."""
    return quantile(split(df, "train"), [], "target_annual_claim_cost", q, "target_high_cost_threshold", exact)


def label(df: DataFrame, threshold: DataFrame, strict: bool = False) -> DataFrame:
    """label 1.0 from the threshold upwards (``strict``: above it); threshold is one row, joined without a shuffle."""
    cost, limit = F.col("target_annual_claim_cost"), F.col("target_high_cost_threshold")
    return df.crossJoin(F.broadcast(threshold)).withColumn("label", (cost > limit if strict else cost >= limit).cast("double"))


def training_target(df: DataFrame, q: float = 0.9, exact: bool = False) -> DataFrame:
    return label(df, training_threshold(df, q, exact))


def labelled_splits(df: DataFrame, q: float = 0.9, exact: bool = False) -> DataFrame:
    """The frame of audits: all splits with the label by the training rows' threshold, united (one projection over one scan)."""
    return training_target(assign_split(df) if "split_name" not in df.columns else df, q, exact).where(F.col("split_name").isin("train", "validation", "test"))


def historical(df: DataFrame) -> DataFrame:
    """Rows whose target year is before the last one."""
    last = df.agg(F.max("target_year").alias("_last"))
    return df.crossJoin(F.broadcast(last)).where("target_year < _last").drop("_last")


# The label definitions that are compared.
DEFINITIONS = (
    {"target_definition": "fixed_train_threshold_top_decile", "quantile": 0.9, "within_year": False, "full_year_only": False},
    {"target_definition": "within_target_year_top_decile", "quantile": 0.9, "within_year": True, "full_year_only": False},
    {"target_definition": "within_target_year_top_decile_full_year_enrolled", "quantile": 0.9, "within_year": True, "full_year_only": True},
    {"target_definition": "within_target_year_top_5_percent", "quantile": 0.95, "within_year": True, "full_year_only": False},
)


def thresholds(df: DataFrame, definition: dict, exact: bool = False) -> DataFrame:
    """(target_year, target_threshold): within each year, or one value of the historical pool for all years."""
    q = definition["quantile"]
    if definition["within_year"]:
        pool = df.where("target_enrollment_months_count = 12") if definition["full_year_only"] else df
        return quantile(pool, ["target_year"], "target_annual_claim_cost", q, "target_threshold", exact)
    fixed = quantile(historical(df), [], "target_annual_claim_cost", q, "target_threshold", exact)
    return df.select("target_year").distinct().crossJoin(F.broadcast(fixed))


def sensitivity(df: DataFrame, exact: bool = False, definitions=DEFINITIONS) -> DataFrame:
    """Per definition and target year: rows, eligible rows, rates, positives, threshold and costs.

    The three columns it needs are written once, as every definition reads them several times.
    """
    df = saved(df.select("target_year", "target_annual_claim_cost", "target_enrollment_months_count"), "sensitivity")

    def one(definition: dict) -> DataFrame:
        full = F.col("target_enrollment_months_count") == 12 if definition["full_year_only"] else F.lit(True)
        marked = df.join(thresholds(df, definition, exact), "target_year", "left").withColumns({"label": ((F.col("target_annual_claim_cost") > F.col("target_threshold")) & full).cast("int"), "eligible": full.cast("int")})
        out = marked.groupBy("target_year").agg(
            F.lit(definition["target_definition"]).alias("target_definition"), F.count("*").alias("row_count"), F.sum("eligible").cast("long").alias("eligible_positive_denominator"), F.avg("label").alias("positive_rate_all_rows"), F.avg(F.when(F.col("eligible") == 1, F.col("label"))).alias("positive_rate_eligible_rows"),
            F.sum("label").cast("long").alias("positive_count"), F.max("target_threshold").alias("target_threshold"), F.avg("target_annual_claim_cost").alias("mean_target_annual_claim_cost"), F.avg("target_enrollment_months_count").alias("mean_target_enrollment_months"),
        )
        return out.join(medians, "target_year", "left")

    medians = quantile(df, ["target_year"], "target_annual_claim_cost", 0.5, "median_target_annual_claim_cost", exact)
    return reduce(DataFrame.unionByName, map(one, definitions))


def preconditions(df: DataFrame) -> DataFrame:
    """One row: rows, missing keys, missing costs, duplicate keys; by split, rows and classes where labels are there."""
    by_key = df.groupBy("bene_id", "year").agg(F.count("*").alias("n"), F.count(F.when(F.col("annual_claim_cost").isNull(), 1)).alias("no_cost"))
    no_key = F.col("bene_id").isNull() | F.col("year").isNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by_key.agg(total("n").alias("row_count"), total(F.when(no_key, F.col("n"))).alias("missing_key_count"), total("no_cost").alias("missing_cost_count"), total(F.when(~no_key, F.col("n") - 1)).alias("duplicate_key_count"))


def split_classes(df: DataFrame) -> DataFrame:
    """Per split: rows, positives, and whether both classes are there."""
    out = df.groupBy("split_name").agg(F.count("*").alias("row_count"), F.sum("label").cast("long").alias("positive_count"))
    return out.withColumn("both_classes", (F.col("positive_count") > 0) & (F.col("positive_count") < F.col("row_count")))
