"""Column expressions: cleaning of raw strings, safe arithmetic, bands, scores and statuses. All stay in the JVM."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes, band limits and cut-offs that results depend on.
YES = ("Y", "YES", "TRUE", "T", "1")
NO = ("N", "NO", "FALSE", "F", "0", "2")
EMERGENCY_CODES = ("99281", "99282", "99283", "99284", "99285")
AGE_BANDS = ((65, "under_65"), (75, "65_74"), (85, "75_84"), (None, "85_plus"))
AGE_5YR_BANDS = ((65, "under_65"), (70, "65_69"), (75, "70_74"), (80, "75_79"), (85, "80_84"), (90, "85_89"), (None, "90_plus"))
BURDEN_BANDS = ((1, "0"), (3, "1_2"), (6, "3_5"), (None, "6_plus"))
ENROLLMENT_BANDS = ((1, "0"), (4, "1_3"), (7, "4_6"), (12, "7_11"), (None, "12"))
SCORE_TIERS = ((95, "very_high"), (90, "high"), (75, "elevated"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- raw strings ---------------------------------------------------------------------------------------------


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def to_date(c: Column | str) -> Column:
    """yyyyMMdd; null for anything else."""
    text = blank_to_null(c)
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def to_int(c: Column | str) -> Column:
    """Decimal text is cut off after the point; null where it is no number or does not fit."""
    return blank_to_null(c).try_cast("decimal(38,10)").try_cast("bigint").try_cast("int")


def to_double(c: Column | str) -> Column:
    return blank_to_null(c).try_cast("double")


def at_least_zero(value: Column) -> Column:
    """max(value, 0) that keeps null."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0).cast("int")))


def int_at_least_zero(c: Column | str) -> Column:
    return at_least_zero(to_int(c))


def double_at_least_zero(c: Column | str) -> Column:
    value = to_double(c)
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def yes_no(c: Column | str) -> Column:
    text = F.upper(blank_to_null(c))
    return F.when(text.isin(*YES), True).when(text.isin(*NO), False)


PARSERS = {"date": to_date, "int": to_int, "double": to_double}


def parse_failed(c: Column | str, kind: str) -> Column:
    """Whether there is text that is no date, int or double."""
    return blank_to_null(c).isNotNull() & PARSERS[kind](c).isNull()


def first_filled(cs: Iterable[Column | str]) -> Column:
    return F.coalesce(*map(blank_to_null, cs))


def row_sum(cs: Iterable[Column | str]) -> Column:
    return reduce(add, (F.coalesce(double_at_least_zero(c), F.lit(0.0)) for c in cs))


def row_count(conditions: Iterable[Column]) -> Column:
    """How many of the conditions hold; null does not."""
    return reduce(add, (F.coalesce(c, F.lit(False)).cast("int") for c in conditions), F.lit(0))


def filled_count(cs: Iterable[Column | str]) -> Column:
    return row_count(blank_to_null(c).isNotNull() for c in cs)


def distinct_filled(cs: Iterable[Column | str]) -> Column:
    return F.array_distinct(F.array_compact(F.array(*map(blank_to_null, cs))))


def any_in(cs: Iterable[Column | str], values: Iterable[str]) -> Column:
    """Null, not false, where no element matches and one is null."""
    return F.exists(F.array(*map(blank_to_null, cs)), lambda x: x.isin(*values))


def sex(c: Column | str) -> Column:
    code = to_int(c)
    return F.when(code == 1, "male").when(code == 2, "female").otherwise("unknown")


def day_span(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def dates_in_order(start: Column, end: Column) -> Column:
    return start <= end


def row_hash(columns: Iterable[str], skip: tuple[str, ...] = ("_bronze_", "_silver_")) -> Column:
    """SHA-256 of the columns in order of their names; columns with the given prefixes don't count."""
    kept = sorted(c for c in columns if not c.startswith(skip))
    return F.sha2(F.concat_ws("||", *(F.coalesce(F.col(c).cast("string"), F.lit("__NULL__")) for c in kept)), 256)


# --- arithmetic and bands ------------------------------------------------------------------------------------


def rate(numerator: Column | str, denominator: Column | str, scale: float = 1.0) -> Column:
    """numerator / denominator * scale; 0 where the denominator is null or 0."""
    n, d = col(numerator).cast("double"), col(denominator).cast("double")
    return F.when(d.isNull() | (d == 0), 0.0).otherwise(n / d * F.lit(scale))


def amount_log1p(c: Column | str) -> Column:
    return F.log1p(F.greatest(col(c), F.lit(0.0)))


def count_log1p(c: Column | str) -> Column:
    return F.log1p(F.greatest(F.coalesce(col(c), F.lit(0)), F.lit(0)).cast("double"))


def positive(c: Column | str) -> Column:
    return F.greatest(col(c), F.lit(0.0))


def banded(value: Column | str, bands: tuple, missing: str | int = "unknown") -> Column:
    """The label of the first band whose limit lies above the value."""
    value = col(value)
    value, out = (F.coalesce(value, F.lit(missing)), None) if isinstance(missing, int) else (value, F.when(value.isNull(), missing))
    for limit, label in bands[:-1]:
        out = F.when(value < limit, label) if out is None else out.when(value < limit, label)
    return out.otherwise(bands[-1][1])


def age_band(c: Column | str) -> Column:
    return banded(c, AGE_BANDS)


def age_5yr_band(c: Column | str) -> Column:
    return banded(c, AGE_5YR_BANDS)


def burden_band(c: Column | str) -> Column:
    return banded(c, BURDEN_BANDS, 0)


def enrollment_band(c: Column | str) -> Column:
    return banded(c, ENROLLMENT_BANDS, 0)


def age_at_year_end(year: Column | str, birth: Column | str) -> Column:
    return F.floor(F.months_between(F.make_date(col(year), F.lit(12), F.lit(31)), col(birth)) / 12).cast("int")


def enrollment_months(cs: Iterable[Column | str]) -> Column:
    return F.greatest(*(F.coalesce(col(c), F.lit(0)) for c in cs)).cast("int")


def cross(*cs: Column | str) -> Column:
    return F.concat_ws("__", *map(col, cs))


# --- scores and statuses -------------------------------------------------------------------------------------


def display_score(p: Column | str, scale: float = 0.10) -> Column:
    """0 to 100, rounded half to even, from a probability (clamped to 0..1)."""
    p = F.least(F.greatest(col(p), F.lit(0.0)), F.lit(1.0))
    return F.bround(100 * (1 - F.exp(-p / F.lit(scale))), 0).cast("int")


def score_tier(score: Column | str) -> Column:
    out = F
    for limit, label in SCORE_TIERS:
        out = out.when(col(score) >= limit, label)
    return out.otherwise("low")


# What applies to a row, and what is then said; told in this order. Words in braces are thresholds by column.
REASONS = (
    ("coalesce(chronic_condition_count, 0) >= 6", "High chronic condition burden"),
    ("coalesce(claims_per_enrollment_month, 0) >= {claims_per_enrollment_month}", "High claims per enrollment month"),
    ("coalesce(provider_fragmentation_index, 0) >= {provider_fragmentation_index}", "High provider fragmentation"),
    ("any_carrier_claim = 1", "Carrier claim activity present"),
    ("coalesce(total_claim_days_log1p, 0) >= {total_claim_days_log1p}", "High claim-day utilization"),
)
# What drives a risk, with the weight by which drivers are ordered.
DRIVERS = (
    ("chronic_condition_count >= 6", "high chronic condition count", 95),
    ("chronic_condition_count >= 3 and chronic_condition_count < 6", "moderate chronic condition burden", 70),
    ("inpatient_claim_count > 0", "prior inpatient utilization", 90),
    ("claims_per_enrollment_month >= 2 or total_claim_count >= 20", "high claims per enrollment month", 85),
    ("unique_provider_count >= 6", "high provider fragmentation", 75),
    ("prior_year_high_cost_indicator = 1", "prior high-cost year indicator", 80),
    ("cost_per_enrollment_month >= 1000", "high prior-year cost intensity", 65),
    ("enrollment_months_count > 0 and enrollment_months_count < 12", "partial-year enrollment requires review", 50),
)
NO_DRIVER = "routine utilization and chronic burden profile"
# What a reviewer is to look at.
REVIEWS = (
    ("coalesce(enrollment_months_count, 0) <= 0", "zero_enrollment"),
    ("coalesce(enrollment_months_count, 0) < 12", "partial_year_enrollment"),
    ("annualized_cost_per_enrolled_month > {cost}", "extreme_annualized_cost"),
    ("total_claim_count > {claims}", "extreme_claim_count"),
    ("provider_fragmentation_index > 1.0", "provider_count_exceeds_claim_count"),
)
# Names of columns and what their values keep to; the first pattern that fits a name holds.
BOUNDS = (
    (r"^(sex|age_band|age_5yr_band|race_code|state_code)$", None),
    (r"_flag$|_indicator$|^any_", "in (0, 1)"),
    (r"share|_fraction$|percentile", "between 0 and 1"),
    (r"_coverage_months$|_months_count$", "between 0 and 12"),
    (r"^age_years(_imputed)?$", "between 0 and 115"),
    (r"^(?!.*(change|difference)).*(count|cost|amount|total|days_supply)", "between 0 and double('Infinity')"),
)


def _applying(rules: tuple, values: dict[str, float] | None = None) -> Column:
    """The texts of the rules that apply, with their weights where rules have some."""
    limits = defaultdict(lambda: "double('Infinity')", {c: f"{float(v)!r}d" if math.isfinite(v) else f"double('{v}')" for c, v in (values or {}).items()})
    said = [F.struct(*(F.lit(x) for x in reversed(rest))) if len(rest) > 1 else F.lit(rest[0]) for _, *rest in rules]
    return F.array_compact(F.array(*(F.when(F.expr(rule[0].format_map(limits)), what) for rule, what in zip(rules, said, strict=True))))


def reason_codes(thresholds: dict[str, float]) -> Column:
    """The first three reasons that apply, in fixed order; measures without a threshold give none."""
    return F.slice(_applying(REASONS, thresholds), 1, 3)


def risk_drivers(most: int = 5) -> Column:
    """Labels of what drives the risk, heaviest first."""
    labels = F.transform(F.slice(F.sort_array(_applying(DRIVERS), asc=False), 1, most), lambda x: x["col2"])
    return F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit(NO_DRIVER)))


def review_flags(extreme_cost: float = 250_000.0, extreme_claims: int = 1_000) -> Column:
    return _applying(REVIEWS, {"cost": extreme_cost, "claims": extreme_claims})


def drift_status(psi: Column | str) -> Column:
    return F.when(col(psi) >= 0.25, "review_required").when(col(psi) >= 0.10, "monitor").otherwise("stable")


def gap_status(gap: Column | str) -> Column:
    return F.when(col(gap) >= 0.05, "review_required").when(col(gap) >= 0.02, "warning").otherwise("acceptable")


def capture_status(baseline: Column | str, current: Column | str) -> Column:
    drop = (col(baseline) - col(current)) / F.nullif(col(baseline), F.lit(0.0))
    return F.when(col(baseline) <= 0, "insufficient_baseline").when(drop > 0.20, "review_required").when(drop >= 0.10, "warning").otherwise("acceptable")


def impossible(name: str) -> Column:
    """Whether a value of the column cannot be, judged by the column's name."""
    bound = next((b for pattern, b in BOUNDS if re.search(pattern, name.lower())), None)
    return F.coalesce(~F.expr(f"`{name}` {bound}"), F.lit(False)) if bound else F.lit(False)
