"""Audits over many columns at once: columns are unpivoted, and one aggregation serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.functions.scalars import impossible
from tallyframe.operators import ranking

LEVELS = 50


def _unpivoted(df: DataFrame, keep: list[str], each: list[Column], fields: str) -> DataFrame:
    """A row for each of the structs; without any, none."""
    rows = F.array(*each) if each else F.array().cast(f"array<struct<{fields}>>")
    return df.select(*keep, F.explode(rows).alias("f")).select(*keep, "f.*")


def unpivot_numeric(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep, feature_name, value double, bad)."""
    each = [F.struct(F.lit(c).alias("feature_name"), F.col(c).cast("double").alias("value"), impossible(c).alias("bad")) for c in columns]
    return _unpivoted(df, keep, each, "feature_name: string, value: double, bad: boolean")


def unpivot_text(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    each = [F.struct(F.lit(c).alias("feature_name"), F.col(c).cast("string").alias("category_value")) for c in columns]
    return _unpivoted(df, keep, each, "feature_name: string, category_value: string")


def _number(c: Column) -> Column:
    return F.count(F.when(c, 1))


def feature_quality(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Per column: nulls, distinct values, zeros, negatives, impossible values, moments, severity.

    Values are counted by (column, value) first; the second step sees distinct values only.
    """
    v = F.col("value")
    numbers = unpivot_numeric(df, numeric).groupBy("feature_name", "value").agg(F.count("*").alias("n"), _number(F.col("bad")).alias("bad"))
    n = F.col("n")
    known = F.sum(F.when(v.isNotNull(), n))
    mean = F.sum(v * n) / F.nullif(known, F.lit(0))
    stats = numbers.groupBy("feature_name").agg(
        F.lit("numeric").alias("feature_type"), F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("null_count"), F.count("value").alias("unique_count"), F.coalesce(F.sum(F.when(v == 0, n)), F.lit(0)).alias("zero_count"),
        F.coalesce(F.sum(F.when(v < 0, n)), F.lit(0)).alias("negative_count"), F.sum("bad").alias("impossible_value_count"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), mean.alias("mean_value"), known.alias("_known"),
    )
    # squares about the mean in a second step over distinct values: differences of large sums of squares would lose digits
    apart = numbers.join(F.broadcast(stats.select("feature_name", "mean_value")), "feature_name").groupBy("feature_name").agg(F.sum(F.pow(v - F.col("mean_value"), 2) * n).alias("_apart"))
    stats = stats.join(F.broadcast(apart), "feature_name").withColumn("stddev_value", F.sqrt(F.col("_apart") / F.nullif(F.col("_known") - 1, F.lit(0)))).drop("_apart", "_known")
    texts = unpivot_text(df, categorical).groupBy("feature_name", "category_value").agg(F.count("*").alias("n"))
    levels = texts.groupBy("feature_name").agg(F.lit("categorical").alias("feature_type"), F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(F.col("category_value").isNull(), n)), F.lit(0)).alias("null_count"), F.count("category_value").alias("unique_count"), F.lit(0).cast("long").alias("impossible_value_count"))
    out = stats.unionByName(levels, allowMissingColumns=True)
    severity = F.when(F.col("impossible_value_count") > 0, "fail").when((F.col("unique_count") <= 1) | (F.col("null_count") > 0), "warn").otherwise("pass")
    return out.withColumns({"null_rate": F.col("null_count") / F.col("row_count"), "zero_variance_flag": F.col("unique_count") <= 1, "zero_rate": F.col("zero_count") / F.col("row_count"), "audit_severity": severity})


def numeric_by_year(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    each = unpivot_numeric(df, columns, ["year"])
    stats = {"row_count": F.count("*"), "mean_value": F.avg("value"), "stddev_value": F.stddev("value"), "min_value": F.min("value"), "max_value": F.max("value")}
    if not exact:
        stats["median_value"] = F.percentile_approx("value", 0.5)
    out = each.groupBy("year", "feature_name").agg(*(c.alias(n) for n, c in stats.items()))
    if exact:
        out = ranking.null_safe(out, ranking.quantiles(each, ["year", "feature_name"], "value", {"median_value": 0.5}, discrete=True), ["year", "feature_name"])
    return out.select("year", "feature_name", "row_count", "mean_value", "stddev_value", "min_value", "median_value", "max_value")


def _few(counts: DataFrame) -> DataFrame:
    """Levels of the columns that have at most LEVELS of them."""
    levels = counts.groupBy("feature_name").agg(F.count_distinct(F.coalesce("category_value", F.lit("\u0000"))).alias("_levels")).where(F.col("_levels") <= LEVELS)
    return counts.join(levels.select("feature_name"), "feature_name", "left_semi")


def categories_by_year(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = unpivot_text(df, columns, ["year"]).groupBy("year", "feature_name", "category_value").agg(F.count("*").alias("category_count"))
    total = F.sum("category_count").over(W.partitionBy("year", "feature_name"))
    return _few(counts).withColumn("row_count", total).withColumn("category_rate", F.col("category_count") / F.col("row_count"))


def target_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = unpivot_text(df, columns, ["label"]).groupBy("feature_name", "category_value").agg(F.count("*").alias("row_count"), F.sum("label").cast("long").alias("positive_count"), F.avg("label").alias("target_rate"))
    return _few(counts)


def numeric_drift(df: DataFrame, columns: list[str], split_col: str = "split_name", flag: float = 0.1) -> DataFrame:
    """Test against training mean over the pooled deviation (null where that is 0)."""
    of = lambda f, name: f(F.when(F.col(split_col) == name, F.col("value")))
    rows = lambda name: _number(F.col(split_col) == name)
    out = unpivot_numeric(df, columns, [split_col]).groupBy("feature_name").agg(rows("train").alias("train_row_count"), rows("test").alias("test_row_count"), of(F.avg, "train").alias("train_value"), of(F.avg, "test").alias("test_value"), of(F.stddev, "train").alias("_a"), of(F.stddev, "test").alias("_b"))
    pooled = F.sqrt((F.pow(F.coalesce("_a", F.lit(0.0)), 2) + F.pow(F.coalesce("_b", F.lit(0.0)), 2)) / 2)
    change = F.col("test_value") - F.col("train_value")
    out = out.withColumns({"absolute_difference": F.abs(change), "standardized_difference": change / F.nullif(pooled, F.lit(0.0))}).drop("_a", "_b")
    return out.withColumn("drift_flag", F.coalesce(F.abs("standardized_difference") >= flag, F.lit(False)))


def category_drift(df: DataFrame, columns: list[str], split_col: str = "split_name", flag: float = 0.05) -> DataFrame:
    """Rates by level; a level that a split lacks has rate 0."""
    in_ = lambda name: _number(F.col(split_col) == name)
    counts = _few(unpivot_text(df, columns, [split_col]).groupBy("feature_name", "category_value").agg(in_("train").alias("a"), in_("test").alias("b")))
    own = W.partitionBy("feature_name")
    out = counts.withColumns({"train_row_count": F.sum("a").over(own), "test_row_count": F.sum("b").over(own)}).where("a + b > 0")
    rate = lambda n, t: F.coalesce(F.col(n) / F.nullif(F.col(t), F.lit(0)), F.lit(0.0))
    out = out.withColumns({"train_value": rate("a", "train_row_count"), "test_value": rate("b", "test_row_count")}).drop("a", "b")
    out = out.withColumn("absolute_difference", F.abs(F.col("test_value") - F.col("train_value")))
    return out.withColumn("drift_flag", F.col("absolute_difference") >= flag)


SEVERITIES = ("fail", "warn", "pass")


def drifted(drift: DataFrame) -> DataFrame:
    """The features whose drift is flagged, the largest absolute difference first."""
    return drift.where("drift_flag").orderBy(F.desc_nulls_last("absolute_difference"), "feature_name")


def by_severity(quality: DataFrame) -> DataFrame:
    """Audited features, the gravest first."""
    return quality.orderBy(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("audit_severity")), F.desc_nulls_last("impossible_value_count"), "feature_name")


# --- exploration ---------------------------------------------------------------------------------------------


def rows_by_year(df: DataFrame) -> DataFrame:
    return df.groupBy("year").agg(F.count("*").alias("row_count"), F.count_distinct("bene_id").alias("bene_count"))


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    out = unpivot_text(df, columns).groupBy("feature_name").agg(_number(F.col("category_value").isNull()).alias("missing_count"), F.count("*").alias("row_count"))
    return out.withColumn("missing_rate", F.col("missing_count") / F.col("row_count"))


QUANTILES = (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


def quantiles(df: DataFrame, c: str, at: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(quantile, value), interpolated."""
    wide = ranking.quantiles(df, [], c, {f"q{i}": q for i, q in enumerate(at)})
    return wide.select(F.explode(F.array(*(F.struct(F.lit(q).alias("quantile"), F.col(f"q{i}").cast("double").alias("value")) for i, q in enumerate(at)))).alias("z")).select("z.*")


def class_balance(model: DataFrame, q: float = 0.9) -> DataFrame:
    """Per target year: the year's own cost threshold (interpolated), and rows above it."""
    cost = F.col("target_annual_claim_cost")
    limits = ranking.quantiles(model, ["target_year"], "target_annual_claim_cost", {"threshold": q})
    marked = model.join(F.broadcast(limits), "target_year", "left").where("target_year is not null")  # one row for each year
    out = marked.groupBy("target_year").agg(F.count("*").alias("row_count"), F.max("threshold").alias("threshold"), _number(cost > F.col("threshold")).alias("positive_count"))
    return out.withColumn("positive_rate", F.col("positive_count") / F.col("row_count"))


def cost_by(df: DataFrame, group: str, cost: str = "annual_claim_cost") -> DataFrame:
    means = df.groupBy(group).agg(F.count("*").alias("row_count"), F.avg(cost).alias("mean_cost"))
    places = ranking.quantiles(df, [group], cost, {"median_cost": 0.5, "p90_cost": 0.9})
    return ranking.null_safe(means, places, [group]).select(group, "row_count", "median_cost", "mean_cost", "p90_cost")


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    v, each = F.col("value"), unpivot_numeric(df, columns)
    counts = each.groupBy("feature_name").agg(F.avg((v == 0).cast("double")).alias("zero_rate"), _number(v < 0).alias("negative_count"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count_distinct("value").alias("unique_count"))
    places = ranking.quantiles(each, ["feature_name"], "value", {"median_value": 0.5, "p90_value": 0.9, "p99_value": 0.99})
    return counts.join(places, "feature_name", "left").select("feature_name", "zero_rate", "negative_count", "min_value", "median_value", "p90_value", "p99_value", "max_value", "unique_count")


def label_correlation(df: DataFrame, columns: list[str], y: str = "label") -> DataFrame:
    """Correlation of each column with the label; columns without variance are left out."""
    out = unpivot_numeric(df, columns, [y]).groupBy("feature_name").agg(F.corr("value", y).alias("correlation"), F.stddev_pop("value").alias("_sd"))
    return out.where("_sd > 0 and correlation is not null and not isnan(correlation)").drop("_sd").withColumn("absolute_correlation", F.abs("correlation"))


def integrity(df: DataFrame) -> DataFrame:
    """One row: duplicate and null keys, rows with any gap, without enrolment, with a negative cost, and without a next year."""
    gap = F.greatest(*(F.col(c).isNull().cast("int") for c in df.columns))
    later = df.select("bene_id", (F.col("year") - 1).alias("year")).distinct().withColumn("has_next", F.lit(1))
    by_key = df.withColumn("_gap", gap).join(later, ["bene_id", "year"], "left").groupBy("bene_id", "year").agg(F.count("*").alias("n"), F.sum("_gap").alias("gap"), _number(F.col("enrollment_months_count") <= 0).alias("months"), _number(F.least("inpatient_total_cost", "outpatient_total_cost", "carrier_total_cost", "rx_total_cost") < 0).alias("neg"), F.sum(F.when(F.col("has_next").isNull(), 1).otherwise(0)).alias("lost"))
    no_key = F.col("bene_id").isNull() | F.col("year").isNull()
    return by_key.agg(F.sum("n").alias("row_count"), F.sum(F.when(no_key, 0).otherwise(F.col("n") - 1)).alias("duplicate_key_count"), F.sum(F.when(no_key, F.col("n")).otherwise(0)).alias("null_key_count"), F.sum("gap").alias("any_missing_count"), F.sum("months").alias("nonpositive_months_count"), F.sum("neg").alias("negative_cost_count"), F.sum("lost").alias("lost_in_join_count"))


def distribution(df: DataFrame, c: str) -> DataFrame:
    counts = df.groupBy(c).agg(F.count("*").alias("row_count"))
    return counts.withColumn("row_rate", F.col("row_count") / F.sum("row_count").over(W.partitionBy()))


def log_histogram(df: DataFrame, c: str, bins: int = 50) -> DataFrame:
    """Counts of log1p(max(value, 0)) in equal bins from its least to its largest value."""
    x = df.where(F.col(c).isNotNull()).select(F.log1p(F.greatest(F.col(c), F.lit(0.0))).alias("x"))
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    at = F.least(F.coalesce(F.floor((F.col("x") - F.col("lo")) / width * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return x.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("row_count"))
