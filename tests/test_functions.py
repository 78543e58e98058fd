from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import scalars as s


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression.alias("x")).first().x


@pytest.mark.parametrize(("text", "day"), [("20080131", date(2008, 1, 31)), (" 20080131 ", date(2008, 1, 31)), ("20081340", None), ("", None), (None, None), ("2008", None)])
def test_dates(spark, text, day):
    assert one(spark, text, s.to_date("c")) == day


@pytest.mark.parametrize(("text", "number", "clamped"), [("3.7", 3, 3), ("-2", -2, 0), ("abc", None, None), ("  ", None, None), ("99999999999", None, None)])
def test_ints(spark, text, number, clamped):
    assert one(spark, text, s.to_int("c")) == number
    assert one(spark, text, s.int_at_least_zero("c")) == clamped


@pytest.mark.parametrize(("text", "flag"), [("1", True), ("y", True), ("2", False), ("No", False), ("", None), ("maybe", None)])
def test_flags(spark, text, flag):
    assert one(spark, text, s.yes_no("c")) is flag


@pytest.mark.parametrize(("text", "failed"), [("x", True), ("", False), ("1", False), (None, False)])
def test_parse_failed(spark, text, failed):
    assert one(spark, text, s.parse_failed("c", "int")) is failed


def test_any_in_is_null_where_unknown(spark):
    row = spark.createDataFrame([("99281", None), ("1", None), ("1", "2")], "a string, b string").select(s.any_in(["a", "b"], s.EMERGENCY_CODES).alias("x")).collect()
    assert [r.x for r in row] == [True, None, False]


@pytest.mark.parametrize(("n", "d", "expected"), [(6.0, 3.0, 2.0), (6.0, 0.0, 0.0), (6.0, None, 0.0), (6.0, -3.0, -2.0)])
def test_rate(spark, n, d, expected):
    assert spark.createDataFrame([(n, d)], "n double, d double").select(s.rate("n", "d").alias("x")).first().x == expected


@pytest.mark.parametrize(("age", "band", "fine"), [(None, "unknown", "unknown"), (64, "under_65", "under_65"), (65, "65_74", "65_69"), (84, "75_84", "80_84"), (90, "85_plus", "90_plus")])
def test_age_bands(spark, age, band, fine):
    assert one(spark, age, s.age_band("c"), "int") == band
    assert one(spark, age, s.age_5yr_band("c"), "int") == fine


@pytest.mark.parametrize(("count", "band"), [(None, "0"), (0, "0"), (2, "1_2"), (5, "3_5"), (6, "6_plus")])
def test_burden(spark, count, band):
    assert one(spark, count, s.burden_band("c"), "int") == band


@pytest.mark.parametrize(("score", "tier"), [(95, "very_high"), (90, "high"), (75, "elevated"), (74, "low")])
def test_tiers(spark, score, tier):
    assert one(spark, score, s.score_tier("c"), "int") == tier


@pytest.mark.parametrize(("psi", "status"), [(0.05, "stable"), (0.12, "monitor"), (0.30, "review_required")])
def test_drift_status(spark, psi, status):
    assert one(spark, psi, s.drift_status("c"), "double") == status


def test_gap_and_capture_status(spark):
    assert [one(spark, x, s.gap_status("c"), "double") for x in (0.01, 0.03, 0.06)] == ["acceptable", "warning", "review_required"]
    assert one(spark, 0.30, s.capture_status(F.lit(0.40), "c"), "double") == "review_required"
    assert one(spark, 0.30, s.capture_status(F.lit(0.0), "c"), "double") == "insufficient_baseline"


def test_impossible_follows_the_name(spark):
    df = spark.createDataFrame([(2, 1.5, 13, -1, -1)], "any_flag int, cost_share double, x_months_count int, total_cost int, cost_change int")
    assert list(df.select(*(s.impossible(c) for c in df.columns)).first()) == [True, True, True, True, False]


def test_reason_codes_keep_order_and_stop_at_three(spark):
    row = spark.createDataFrame([(6, 9.0, 9.0, 1, 9.0)], "chronic_condition_count int, claims_per_enrollment_month double, provider_fragmentation_index double, any_carrier_claim int, total_claim_days_log1p double")
    got = row.select(s.reason_codes({"claims_per_enrollment_month": 2.0, "provider_fragmentation_index": 0.5, "total_claim_days_log1p": 1.0}).alias("r")).first().r
    assert got == ["High chronic condition burden", "High claims per enrollment month", "High provider fragmentation"]
