"""Batch decisions on scored rows: validation, percentile scores, prediction output, states and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import scalars as s
from tallyframe.operators.cleaning import CHRONIC_FLAGS
from tallyframe.operators.ranking import running

# Names, limits, costs and weights of the decision rules.
RISK_TIERS = ("low", "elevated", "high", "very_high")
LEVELS = ("low", "medium", "high")
PRIOR = ("none", "recent_low_touch", "recent_intensive")
ACTIONS = (("no_action", "No action", 0.0, 1.00), ("low_touch_outreach", "Low-touch outreach", 1.0, 0.95), ("care_coordination_call", "Care coordination call", 3.0, 0.88), ("intensive_case_management", "Intensive case management", 6.0, 0.80))
TIER_GAIN = {"low": 1.00, "elevated": 1.05, "high": 1.10, "very_high": 1.15}
PRIOR_FACTOR = {"none": 1.00, "recent_low_touch": 0.95, "recent_intensive": 0.85}
REWARD = {"high_cost": -12.0, "not_high_cost": 3.0, "better": 2.0, "worse": -2.0, "overtreatment": -2.0}
NONNEGATIVE = ("rx_total_cost", "inpatient_total_cost", "outpatient_total_cost", "carrier_total_cost", "carrier_allowed_total", "rx_patient_pay_total", "prior_year_annual_claim_cost", "inpatient_claim_count", "outpatient_claim_count", "carrier_claim_count", "pde_claim_count", "outpatient_ed_claim_count", "outpatient_line_count", "carrier_line_count", "rx_days_supply", "total_claim_days", "unique_provider_count", "prior_year_inpatient_claim_count", "prior_year_total_claim_count")
BOUNDS = {"enrollment_months_count": (0, 12), "chronic_condition_count": (0, 11), "age_years": (0, 115), "annual_cost_year_percentile": (0, 1), "annual_cost_year_decile": (1, 10), "has_prior_year": (0, 1), "prior_year_enrollment_months_count": (0, 12)}
ALLOWED = {"age_band": ("under_65", "65_74", "75_84", "85_plus", "unknown"), "sex": ("male", "female", "unknown"), "prior_intervention_status": PRIOR}


def profile_errors(df: DataFrame) -> DataFrame:
    """``errors``: the broken rules of each row, over the columns that are there; missing values break none."""
    have = set(df.columns)
    rules = [(F.col(c) < 0, f"{c} must be nonnegative") for c in NONNEGATIVE if c in have]
    rules += [(~F.col(c).between(*b), f"{c} must be in {b[0]}..{b[1]}") for c, b in BOUNDS.items() if c in have]
    rules += [(~F.col(c).isin(*v), f"{c} is not known") for c, v in ALLOWED.items() if c in have]
    flags = [F.col(c).cast("int") == 1 for c in CHRONIC_FLAGS if c in have]
    if flags and "chronic_condition_count" in have:
        rules.append((s.row_count(flags) > F.col("chronic_condition_count"), "chronic_condition_count is below the active flags"))
    return df.withColumn("errors", F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in rules))))


def valid_profiles(df: DataFrame) -> DataFrame:
    return profile_errors(df).where("size(errors) = 0").drop("errors")


def rejected_profiles(df: DataFrame) -> DataFrame:
    return profile_errors(df).where("size(errors) > 0")


def percentile_scores(df: DataFrame, reference: DataFrame, p: str = "predicted_probability", ref: str = "predicted_probability") -> DataFrame:
    """percentile_score: 100 times the share of reference values (clamped to 0..1) up to the row's, rounded half to even.

    Distinct values of both sides are counted and summed in order, by range.
    """
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    values = reference.where(F.col(ref).isNotNull()).select(clamp(ref).alias("_v"), F.lit(1).cast("long").alias("n"))
    asked = df.where(F.col(p).isNotNull()).select(clamp(p).alias("_v"), F.lit(0).cast("long").alias("n"))
    both = values.unionByName(asked).groupBy("_v").agg(F.sum("n").alias("n"))
    ranks = running(both, [], ["_v"], ["n"]).select("_v", "n_upto", "n_all")
    out = df.withColumn("_v", clamp(p)).join(ranks, "_v", "left")
    score = F.bround(100.0 * F.col("n_upto") / F.nullif(F.col("n_all"), F.lit(0)), 0).cast("int")
    return out.withColumn("percentile_score", score).drop("_v", "n_upto", "n_all")


def predictions(df: DataFrame, thresholds: dict[str, float], decision: float = 0.20, reference: DataFrame | None = None) -> DataFrame:
    """Score, tier, flag, reasons, drivers, review flags and cost mix of each scored row."""
    if reference is not None:
        df = percentile_scores(df, reference).withColumnRenamed("percentile_score", "risk_score")
    else:
        df = df.withColumn("risk_score", s.display_score("predicted_probability"))
    mix = F.struct(*(F.col(c).alias(n) for n, c in (("inpatient", "inpatient_total_cost"), ("outpatient", "outpatient_total_cost"), ("carrier", "carrier_total_cost"), ("prescription", "rx_total_cost"))))
    return df.withColumns({"risk_tier": s.score_tier("risk_score"), "intervention_flag": F.col("predicted_probability") >= decision, "reason_codes": s.reason_codes(thresholds), "risk_drivers": s.risk_drivers(), "review_flags": s.review_flags(), "cost_mix": mix})


def _index(c: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), c).cast("int") - 1


def probability_tier(p: Column) -> Column:
    return F.when(p < 0.20, "low").when(p < 0.40, "elevated").when(p < 0.60, "high").otherwise("very_high")


def states(df: DataFrame, p: str = "predicted_probability") -> DataFrame:
    """risk_tier_state, chronic_burden, utilization, prior status and their state_id."""
    chronic, claims, days = F.col("chronic_condition_count"), F.col("total_claim_count"), F.col("total_claim_days")
    prior = F.coalesce("prior_intervention_status", F.lit("none")) if "prior_intervention_status" in df.columns else F.lit("none")
    df = df.withColumns({
        "state_tier": probability_tier(F.col(p)), "state_burden": F.when(chronic <= 2, "low").when(chronic <= 5, "medium").otherwise("high"),
        "state_utilization": F.when((claims <= 8) & (days <= 5), "low").when((claims <= 20) & (days <= 15), "medium").otherwise("high"), "state_prior": prior,
    })
    number = ((_index(F.col("state_tier"), RISK_TIERS) * 3 + _index(F.col("state_burden"), LEVELS)) * 3 + _index(F.col("state_utilization"), LEVELS)) * 3 + _index(F.col("state_prior"), PRIOR)
    return df.withColumn("state_id", number)


def state_parts(state_id: Column) -> dict[str, Column]:
    """The names of a state from its id."""
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    return {"state_prior": pick(PRIOR, state_id % 3), "state_utilization": pick(LEVELS, F.floor(state_id / 3) % 3), "state_burden": pick(LEVELS, F.floor(state_id / 9) % 3), "state_tier": pick(RISK_TIERS, F.floor(state_id / 27))}


def _lookup(c: str, table: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(c))


# How well an action suits a state. Of each group the first line that fits gives a factor, else it is 1.
SUITABILITY = (
    (
        ("low_touch_outreach", "state_tier = 'low'", 0.45),
        ("low_touch_outreach", "state_tier in ('elevated', 'high')", 1.05),
        ("care_coordination_call", "state_tier = 'low' and state_burden = 'low'", 0.15),
        ("care_coordination_call", "state_utilization = 'high' or state_burden in ('medium', 'high')", 1.15),
        ("intensive_case_management", "state_tier = 'low'", 0.20),
        ("intensive_case_management", "state_tier = 'elevated'", 0.55),
        ("intensive_case_management", "state_tier = 'high'", 1.10),
        ("intensive_case_management", "true", 1.35),
    ),
    (("intensive_case_management", "state_burden = 'high'", 1.10),),
    (("intensive_case_management", "state_utilization = 'high'", 1.12),),
)


def action_table(spark) -> DataFrame:
    rows = [(i, *a) for i, a in enumerate(ACTIONS)]
    return spark.createDataFrame(rows, "action_no int, action string, action_label string, action_cost double, risk_multiplier double")


def all_actions(df: DataFrame, policy: DataFrame, p: str = "predicted_probability") -> DataFrame:
    """Each row with each action: adjusted next risk, expected reward, change of risk, value, and whether it is recommended.

    policy: state_id, action, q_value: 108 states by 4 actions. The recommended action has the largest value, the first of equals.
    """
    tier, fit = F.col("state_tier"), F.lit(1.0)
    for group in SUITABILITY:
        of_group = F
        for action, state, factor in group:
            of_group = of_group.when((F.col("action") == action) & F.expr(state), factor)
        fit = fit * of_group.otherwise(1.0)
    less = F.least(F.lit(0.85), F.greatest(F.lit(0.0), (1 - F.col("risk_multiplier")) * _lookup("state_tier", TIER_GAIN) * _lookup("state_prior", PRIOR_FACTOR) * fit))
    after = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col(p) * (1 - less)))
    steps = _index(probability_tier(F.col("next_risk")), RISK_TIERS) - _index(tier, RISK_TIERS)
    reward = -F.col("action_cost") + F.when(F.col("next_risk") >= 0.50, REWARD["high_cost"]).otherwise(REWARD["not_high_cost"]) + F.when(steps < 0, REWARD["better"]).when(steps > 0, REWARD["worse"]).otherwise(0.0)
    reward = reward + F.when((tier == "low") & (F.col("action") == "intensive_case_management"), REWARD["overtreatment"]).otherwise(0.0)
    best = policy.join(F.broadcast(action_table(df.sparkSession)), "action").groupBy("state_id").agg(F.max_by("action", F.struct("q_value", -F.col("action_no"))).alias("recommended_action"))
    wide = policy.join(F.broadcast(action_table(df.sparkSession)), "action").join(best, "state_id")
    out = df.join(F.broadcast(wide), "state_id")  # 432 rows
    out = out.withColumn("next_risk", after).withColumn("expected_reward", reward)
    return out.withColumns({"risk_delta": F.round(F.round("next_risk", 6) - F.col(p), 6), "next_risk": F.round("next_risk", 6), "expected_reward": F.round("expected_reward", 6), "is_recommended": F.col("action") == F.col("recommended_action")})


def best_actions(df: DataFrame, policy: DataFrame, p: str = "predicted_probability") -> DataFrame:
    return all_actions(df, policy, p).where("is_recommended")
