"""The registered queries of the library: operators on the supplied tables, each beside its SQL for DuckDB where SQL can say it.

Floating-point results are rounded on both sides, as sums depend on the order of their rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import scalars as s
from tallyframe.operators import audits, cleaning, contract, features, labels, logits, metrics, runs, scoring, training
from tallyframe.plans.roles import ctes, role
from tallyframe.sources import inventory, tables
from tallyframe.sources.scratch import saved, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, roles: tuple[str, ...] = ()):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            text = sql.strip()
            if roles:
                head = ctes(*roles)
                text = f"{head},\n{text[5:]}" if text.startswith("with ") else f"{head}\n{text}"
            ORACLE_SQL[f.__name__] = text
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- entities, features ----------------------------------------------------------------------------------------


def _claims(spark: SparkSession, sf_dir: str, setting: str) -> DataFrame:
    return role(spark, sf_dir, "claims").where(F.col("setting") == setting)


def _beneficiaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = role(spark, sf_dir, "beneficiaries")
    return df.withColumns({c: F.lit(None).cast("boolean") for c in cleaning.CHRONIC_FLAGS if c not in df.columns})


def _settings(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Claims of the four settings from one written table, as each of them and the providers read it."""
    claims = saved(role(spark, sf_dir, "claims"), "claims")
    parts = [claims.where(F.col("setting") == x) for x in ("inpatient", "outpatient", "carrier", "pde")]
    return [*parts[:3], parts[3].withColumnsRenamed({"claim_id": "pde_id", "payment_amount": "drug_cost", "claim_days": "days_supply"})]


def feature_table(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return features.build(_beneficiaries(spark, sf_dir), *_settings(spark, sf_dir), **options)


#: The measures of the feature table in SQL: what the queries below start from.
GOLD = """
with agg as (select bene_id, year,
        count(distinct claim_id) filter (setting = 'inpatient') ip_n, count(distinct claim_id) filter (setting = 'outpatient') op_n, count(distinct claim_id) filter (setting = 'carrier') ca_n, count(distinct claim_id) filter (setting = 'pde') rx_n,
        coalesce(sum(payment_amount) filter (setting = 'inpatient'), 0) ip_c, coalesce(sum(payment_amount) filter (setting = 'outpatient'), 0) op_c, coalesce(sum(payment_amount) filter (setting = 'carrier'), 0) ca_c, coalesce(sum(payment_amount) filter (setting = 'pde'), 0) rx_c,
        coalesce(sum(claim_days) filter (setting in ('inpatient', 'outpatient')), 0) dys, coalesce(sum(claim_days) filter (setting = 'pde'), 0) supply,
        coalesce(sum(estimated_line_count) filter (setting = 'outpatient'), 0) op_lines, coalesce(sum(estimated_line_count) filter (setting = 'carrier'), 0) ca_lines,
        count(*) filter (setting = 'outpatient' and emergency_department_claim_flag) ed_n, count(distinct provider_id) filter (setting <> 'pde') prov
      from claims group by 1, 2),
  m as (select b.bene_id, b.year, b.sex, b.race_code, b.state_code, b.chronic_condition_count ch, (b.year - year(b.birth_date))::int age,
        greatest(coalesce(hi_coverage_months, 0), coalesce(smi_coverage_months, 0), coalesce(hmo_coverage_months, 0), coalesce(plan_coverage_months, 0))::int mon,
        coalesce(diabetes_flag::int, 0) diabetes_flag,
        coalesce(ip_n, 0) ip_n, coalesce(op_n, 0) op_n, coalesce(ca_n, 0) ca_n, coalesce(rx_n, 0) rx_n, coalesce(ip_c, 0) ip_c, coalesce(op_c, 0) op_c, coalesce(ca_c, 0) ca_c, coalesce(rx_c, 0) rx_c,
        coalesce(dys, 0) dys, coalesce(supply, 0) supply, coalesce(op_lines, 0) op_lines, coalesce(ca_lines, 0) ca_lines, coalesce(ed_n, 0) ed_n, coalesce(prov, 0) prov
      from beneficiaries b left join agg using (bene_id, year)),
  t as (select *, ip_c + op_c + ca_c + rx_c cost, ip_n + op_n + ca_n + rx_n n,
        case when age is null then 'unknown' when age < 65 then 'under_65' when age < 75 then '65_74' when age < 85 then '75_84' else '85_plus' end age_band,
        case when ch <= 0 then '0' when ch <= 2 then '1_2' when ch <= 5 then '3_5' else '6_plus' end burden from m),
  w as (select *, percent_rank() over (partition by year order by round(cost, 2)) pct, ntile(10) over (partition by year order by round(cost, 2), bene_id) decile, quantile_cont(cost, 0.5) over (partition by year) med from t),
  gold as (select *, lag(year) over p is not null has, coalesce(lag(cost) over p, 0) cost1, coalesce(lag(n) over p, 0) n1, coalesce(lag(ip_n) over p, 0) ip1, coalesce(lag(mon) over p, 0) months1,
        (decile = 10)::int high, coalesce(lag((decile = 10)::int) over p, 0) high1 from w window p as (partition by bene_id order by year))
"""


def _gold(spark: SparkSession, sf_dir: str, ranks: bool = True) -> DataFrame:
    """The feature table with costs in whole cents (so that ranks agree between engines); without ``ranks`` no row meets another."""
    *claims, drugs = _settings(spark, sf_dir)
    parts = [features.base(_beneficiaries(spark, sf_dir)), features.aggregate_inpatient(claims[0]), features.aggregate_outpatient(claims[1]), features.aggregate_carrier(claims[2]), features.aggregate_drugs(drugs), features.unique_providers(*claims)]
    measures = features.joined(*parts).drop("inpatient_paid_utilization")
    measures = measures.withColumns({c: F.round(c, 2) for c in features.COSTS.values()})
    return features.engineer(measures, median_exact=True) if ranks else features.row_features(measures)


@query(GOLD + """
select bene_id, year, age age_years, age_band, burden chronic_burden_band, mon enrollment_months_count, ip_n inpatient_claim_count, op_n outpatient_claim_count, ca_n carrier_claim_count, rx_n pde_claim_count,
  dys::bigint total_claim_days, supply::bigint rx_days_supply, op_lines::bigint outpatient_line_count, ca_lines::bigint carrier_line_count, ed_n outpatient_ed_claim_count, prov unique_provider_count, n total_claim_count, diabetes_flag::int diabetes_flag,
  round(ip_c, 2) inpatient_total_cost, round(op_c, 2) outpatient_total_cost, round(ca_c, 2) carrier_total_cost, round(rx_c, 2) rx_total_cost, round(cost, 2) annual_claim_cost
from gold""", ("claims", "beneficiaries"))
def feature_measures(spark, sf_dir):
    names = "bene_id year age_years age_band chronic_burden_band enrollment_months_count inpatient_claim_count outpatient_claim_count carrier_claim_count pde_claim_count total_claim_days rx_days_supply outpatient_line_count carrier_line_count outpatient_ed_claim_count unique_provider_count total_claim_count diabetes_flag inpatient_total_cost outpatient_total_cost carrier_total_cost rx_total_cost annual_claim_cost"
    return rounded(_gold(spark, sf_dir, ranks=False).select(*names.split()), 2)


def _div(a: str, b: str, scale: str = "1.0") -> str:
    return f"round(case when {b} is null or {b} = 0 then 0.0 else {a}::double / {b} * {scale} end, 5)"


@query(GOLD + f"""
select bene_id, year, {_div('cost', 'mon')} cost_per_enrollment_month, {_div('n', 'mon')} claims_per_enrollment_month, {_div('dys', 'mon')} claim_days_per_enrollment_month, {_div('prov', 'mon')} providers_per_enrollment_month,
  {_div('prov', 'n')} provider_fragmentation_index, {_div('cost', 'mon', '12.0')} annualized_cost_per_enrolled_month, {_div('ip_c', 'ip_n')} avg_inpatient_cost_per_claim, {_div('rx_c', 'rx_n')} avg_rx_cost_per_fill, {_div('op_lines', 'op_n')} outpatient_lines_per_claim,
  (mon = 12)::int full_year_enrolled_flag, (mon > 0 and mon < 12)::int partial_year_enrolled_flag, (mon <= 0)::int zero_enrollment_flag, (mon > 0 and mon <= 3)::int low_enrollment_flag,
  case when mon <= 0 then '0' when mon <= 3 then '1_3' when mon <= 6 then '4_6' when mon <= 11 then '7_11' else '12' end enrollment_months_band, round(mon / 12.0, 5) enrollment_fraction,
  (ip_n > 0)::int any_inpatient_claim, (ed_n > 0)::int any_outpatient_ed_claim, (prov > 1)::int multiple_provider_flag, ((ip_n > 0)::int + (op_n > 0)::int + (ca_n > 0)::int + (rx_n > 0)::int >= 2)::int multi_setting_utilization_flag,
  round(ln(1 + greatest(cost, 0)), 5) annual_cost_log1p, round(ln(1 + n), 5) total_claim_count_log1p, {_div('ip_c', '(ip_c + op_c + ca_c + rx_c)')} inpatient_cost_share,
  concat_ws('__', burden, age_band) chronic_burden_age_band, concat_ws('__', sex, burden) sex_chronic_burden_band, coalesce(age, 75)::int age_years_imputed, greatest(coalesce(age, 75) - 75, 0)::int age_over_75, (coalesce(age, 75) * coalesce(age, 75))::int age_squared,
  (coalesce(age, 75) * n)::bigint age_total_claim_interaction, (mon * ip_n)::bigint enrollment_months_inpatient_interaction, case when sex = 'male' then ch else 0 end::int sex_male_chronic_count_interaction, case when age_band = '75_84' then ch else 0 end::int chronic_count_age_75_84
from gold""", ("claims", "beneficiaries"))
def feature_rates_and_interactions(spark, sf_dir):
    names = "bene_id year cost_per_enrollment_month claims_per_enrollment_month claim_days_per_enrollment_month providers_per_enrollment_month provider_fragmentation_index annualized_cost_per_enrolled_month avg_inpatient_cost_per_claim avg_rx_cost_per_fill outpatient_lines_per_claim full_year_enrolled_flag partial_year_enrolled_flag zero_enrollment_flag low_enrollment_flag enrollment_months_band enrollment_fraction any_inpatient_claim any_outpatient_ed_claim multiple_provider_flag multi_setting_utilization_flag annual_cost_log1p total_claim_count_log1p inpatient_cost_share chronic_burden_age_band sex_chronic_burden_band age_years_imputed age_over_75 age_squared age_total_claim_interaction enrollment_months_inpatient_interaction sex_male_chronic_count_interaction chronic_count_age_75_84"
    return rounded(_gold(spark, sf_dir, ranks=False).select(*names.split()), 5)


@query(GOLD + f"""
select bene_id, year, round(pct, 5) annual_cost_year_percentile, decile::int annual_cost_year_decile, {_div('cost', 'med')} annual_cost_to_year_median, has::int has_prior_year, round(cost1, 2) prior_year_annual_claim_cost, n1 prior_year_total_claim_count, ip1 prior_year_inpatient_claim_count, months1::int prior_year_enrollment_months_count,
  high::int current_year_high_cost_indicator, high1::int prior_year_high_cost_indicator, round((cost + cost1) / (has::int + 1), 3) two_year_avg_annual_claim_cost, round(cost - cost1, 2) cost_trend_difference, {_div('cost', 'cost1')} cost_trend_ratio, n - n1 total_claim_count_change,
  case when not has then 'no_prior' when n > n1 then 'rising' when n < n1 then 'falling' else 'flat' end utilization_trend, (high + high1)::int high_cost_last_2yr_count, (high + high1 >= 1)::int high_cost_1_of_last_2yr, (high + high1 >= 2)::int high_cost_2_of_last_2yr
from gold""", ("claims", "beneficiaries"))
def feature_ranks_and_trends(spark, sf_dir):
    names = "bene_id year annual_cost_year_percentile annual_cost_year_decile annual_cost_to_year_median has_prior_year prior_year_annual_claim_cost prior_year_total_claim_count prior_year_inpatient_claim_count prior_year_enrollment_months_count current_year_high_cost_indicator prior_year_high_cost_indicator two_year_avg_annual_claim_cost cost_trend_difference cost_trend_ratio total_claim_count_change utilization_trend high_cost_last_2yr_count high_cost_1_of_last_2yr high_cost_2_of_last_2yr"
    df = _gold(spark, sf_dir).select(*names.split())
    return rounded(df.withColumns({"prior_year_annual_claim_cost": F.round("prior_year_annual_claim_cost", 2), "cost_trend_difference": F.round("cost_trend_difference", 2), "two_year_avg_annual_claim_cost": F.round("two_year_avg_annual_claim_cost", 3)}), 5)


@query(GOLD + """
select count(*) row_count, count(distinct bene_id) distinct_bene_id_count, count(distinct (bene_id, year)) distinct_bene_year_count, 0::bigint missing_bene_year_key_count, count(*) filter (mon <= 0) nonpositive_enrollment_month_count,
  count(*) filter (mon < 0 or mon > 12) invalid_enrollment_month_count, count(*) filter (ch < 0 or ch > 11) invalid_chronic_condition_count, count(*) filter (least(ip_c, op_c, ca_c, rx_c) < 0) negative_component_cost_count, count(*) - count(distinct (bene_id, year)) duplicate_bene_year_count, null::varchar blocking
from gold""", ("claims", "beneficiaries"))
def feature_table_quality(spark, sf_dir):
    return features.table_quality(_gold(spark, sf_dir, ranks=False))


@query("""
select bene_id, year, count(distinct provider_id) unique_provider_count from claims where setting <> 'pde' and provider_id is not null group by 1, 2""", ("claims",))
def unique_providers(spark, sf_dir):
    return features.unique_providers(*(_claims(spark, sf_dir, x) for x in ("inpatient", "outpatient", "carrier")))


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and enrolment by beneficiary and year, for beneficiaries with claims."""
    return role(spark, sf_dir, "claims").groupBy("bene_id", "year").agg(F.round(F.sum("payment_amount"), 2).alias("annual_claim_cost")).join(role(spark, sf_dir, "activity").select("bene_id", "year", (F.col("n_months") * 3).cast("int").alias("enrollment_months_count")), ["bene_id", "year"])


COSTS = """
with c as (select bene_id, year, round(sum(payment_amount), 2) annual_claim_cost from claims group by 1, 2),
  k as (select c.*, (n_months * 3)::int mon from c join activity using (bene_id, year)),
  f as (select a.bene_id, a.year, a.year feature_year, b.year target_year, a.annual_claim_cost, b.annual_claim_cost target_cost, b.mon target_months from k a join k b on a.bene_id = b.bene_id and a.year + 1 = b.year),
  h as (select *, ('0x' || md5(bene_id)[1:7])::bigint % 100 bucket from f),
  p as (select *, case when bucket < 15 then 'test' when bucket < 30 then 'validation' else 'train' end split_name from h)
"""


@query(COSTS + """
, l as (select target_year, quantile_cont(target_cost, 0.9) threshold from f group by 1)
select f.target_year, count(*) row_count, round(max(threshold), 6) threshold, count(*) filter (target_cost > threshold) positive_count, round(count(*) filter (target_cost > threshold) / count(*)::double, 6) positive_rate
from f join l on f.target_year = l.target_year group by f.target_year""", ("claims", "activity"))
def class_balance_by_target_year(spark, sf_dir):
    return rounded(audits.class_balance(labels.next_year(_costs(spark, sf_dir))))


@query(COSTS + """
select bene_id, year, feature_year, target_year, annual_claim_cost, mon enrollment_months_count, target_cost target_annual_claim_cost, split_name
from p join (select bene_id, year, mon from k) using (bene_id, year)""", ("claims", "activity"))
def next_year_frame_with_split(spark, sf_dir):
    return labels.assign_split(labels.next_year(_costs(spark, sf_dir)), bucket=labels.md5_bucket)


@query(COSTS + """
, t as (select quantile_disc(target_cost, 0.9) threshold from p where split_name = 'train')
select bene_id, year, split_name, target_cost target_annual_claim_cost, threshold target_high_cost_threshold, (target_cost >= threshold)::int::double as "label" from p, t""", ("claims", "activity"))
def training_labels(spark, sf_dir):
    frame = labels.assign_split(labels.next_year(_costs(spark, sf_dir)), bucket=labels.md5_bucket)
    return labels.training_target(frame, exact=True).select("bene_id", "year", "split_name", "target_annual_claim_cost", "target_high_cost_threshold", "label")


@query(COSTS + """
, q as (select unnest([{'d': 'fixed_train_threshold_top_decile', 'q': 0.9, 'y': false, 'e': false}, {'d': 'within_target_year_top_decile', 'q': 0.9, 'y': true, 'e': false}, {'d': 'within_target_year_top_decile_full_year_enrolled', 'q': 0.9, 'y': true, 'e': true}, {'d': 'within_target_year_top_5_percent', 'q': 0.95, 'y': true, 'e': false}], recursive := true)),
  fixed as (select quantile_disc(target_cost, 0.9) v from f where target_year < (select max(target_year) from f)),
  yr as (select target_year, quantile_disc(target_cost, 0.9) a, quantile_disc(target_cost, 0.95) b, quantile_disc(target_cost, 0.9) filter (target_months = 12) c from f group by 1),
  z as (select f.*, d, e, case when not y then (select v from fixed) when e then c when q.q > 0.92 then b else a end thr from f cross join q join yr on yr.target_year = f.target_year),
  x as (select *, (target_cost > thr and (not e or target_months = 12))::int lab, (not e or target_months = 12)::int el from z)
select target_year, d target_definition, count(*) row_count, sum(el)::bigint eligible_positive_denominator, round(avg(lab), 6) positive_rate_all_rows, round(avg(lab) filter (el = 1), 6) positive_rate_eligible_rows, sum(lab)::bigint positive_count, max(thr) target_threshold,
  round(avg(target_cost), 4) mean_target_annual_claim_cost, quantile_disc(target_cost, 0.5) median_target_annual_claim_cost, round(avg(target_months), 6) mean_target_enrollment_months from x group by 1, 2""", ("claims", "activity"))
def target_sensitivity(spark, sf_dir):
    out = labels.sensitivity(labels.next_year(_costs(spark, sf_dir), ("enrollment_months_count",)), exact=True)
    return rounded(out.withColumn("mean_target_annual_claim_cost", F.round("mean_target_annual_claim_cost", 4)))


@query(COSTS + "select bene_id, target_year from f where target_year < (select max(target_year) from f)", ("claims", "activity"))
def historical_pool(spark, sf_dir):
    return labels.historical(labels.next_year(_costs(spark, sf_dir))).select("bene_id", "target_year")


@query(COSTS + """
select split_name, count(*) row_count, sum((target_cost > 400000)::int)::bigint positive_count, sum((target_cost > 400000)::int) between 1 and count(*) - 1 both_classes from p group by 1""", ("claims", "activity"))
def split_classes(spark, sf_dir):
    frame = labels.assign_split(labels.next_year(_costs(spark, sf_dir)), bucket=labels.md5_bucket)
    return labels.split_classes(frame.withColumn("label", (F.col("target_annual_claim_cost") > 400000).cast("int")))


@query(COSTS + "select count(*) row_count, 0::bigint missing_key_count, count(*) filter (annual_claim_cost is null) missing_cost_count, count(*) - count(distinct (bene_id, year)) duplicate_key_count from k", ("claims", "activity"))
def frame_preconditions(spark, sf_dir):
    return labels.preconditions(_costs(spark, sf_dir))


# --- raw strings -----------------------------------------------------------------------------------------------


def _raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a raw file would hold them: strings, some blank, malformed or out of order."""
    k = F.col("l_orderkey")
    day = F.date_format("l_shipdate", "yyyyMMdd")
    return parquet(spark, sf_dir, "lineitem").select(
        k.cast("string").alias("CLM_ID"), F.when(k % 50 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("l_suppkey").cast("string"))).alias("DESYNPUF_ID"), F.col("l_linenumber").cast("string").alias("SEGMENT"),
        F.when(k % 31 == 0, "20081340").otherwise(day).alias("CLM_FROM_DT"), F.when(k % 37 == 0, "").otherwise(day).alias("CLM_THRU_DT"), F.when(k % 29 == 0, "abc").when(k % 23 == 0, F.concat(F.lit("-"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))).otherwise(F.col("l_extendedprice").cast("decimal(12,2)").cast("string")).alias("CLM_PMT_AMT"),
        F.when(k % 19 == 0, "3.7").when(k % 41 == 0, "-2").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("CLM_UTLZTN_DAY_CNT"), F.upper("l_returnflag").alias("FLAG"), F.lit("lineitem.csv").alias("_bronze_source_file"), F.col("l_shipdate").alias("_bronze_loaded_at_utc"),
        *(F.lit(None).cast("string").alias(c) for c in ("CLM_ADMSN_DT", "NCH_BENE_DSCHRG_DT", "PRVDR_NUM", "CLM_DRG_CD", "ADMTNG_ICD9_DGNS_CD", "NCH_PRMRY_PYR_CLM_PD_AMT", "CLM_PASS_THRU_PER_DIEM_AMT", "NCH_BENE_IP_DDCTBL_AMT", "NCH_BENE_PTA_COINSRNC_LBLTY_AM", "NCH_BENE_BLOOD_DDCTBL_LBLTY_AM")),
    )


RAW = """
with r as (select l_orderkey k, l_linenumber seg, case when l_orderkey % 50 <> 0 then l_suppkey::varchar end bene_id, case when l_orderkey % 31 <> 0 then l_shipdate::date end d1, case when l_orderkey % 37 <> 0 then l_shipdate::date end d2,
  case when l_orderkey % 29 = 0 then null when l_orderkey % 23 = 0 then 0.0 else round(l_extendedprice, 2) end pay, case when l_orderkey % 19 = 0 then 3 when l_orderkey % 41 = 0 then 0 else l_quantity::int end dys, (l_orderkey % 31 = 0)::int + (l_orderkey % 29 = 0)::int bad, l_shipdate from lineitem)
"""


@query(RAW + "select k::varchar claim_id, bene_id, seg claim_segment, d1 claim_from_date, d2 claim_thru_date, pay::double payment_amount, dys::int claim_days, year(d2)::int as year, bad::int parse_failure_count from r")
def typed_inpatient_claims(spark, sf_dir):
    out = cleaning.typed(_raw_lines(spark, sf_dir), "inpatient_claims")
    return out.select("claim_id", "bene_id", "claim_segment", "claim_from_date", "claim_thru_date", "payment_amount", "claim_days", "year", F.col("_parse_failure_count").alias("parse_failure_count"))


@query(RAW + """
select count(*) row_count, count(*) filter (d2 is null) null_year_count, count(*) filter (d2 is null or bene_id is null) null_key_count, 0::bigint invalid_range_count, 0::bigint negative_amount_count, sum(bad)::bigint parse_failure_count, count(*) - count(distinct (k, coalesce(bene_id, ''), coalesce(year(d2), 0), seg)) duplicate_key_count,
  'null_year_count,null_key_count,parse_failure_count' as failed, 'failed' as status from r""")
def inpatient_quality_gate(spark, sf_dir):
    return cleaning.gate(cleaning.quality(cleaning.typed(_raw_lines(spark, sf_dir), "inpatient_claims"), "inpatient_claims"))


@query(RAW + """
, o as (select *, row_number() over (partition by k, bene_id, year(d2), seg order by l_shipdate desc) n from r where bene_id is not null and d2 is not null)
select k::varchar claim_id, bene_id, year(d2)::int as year, seg claim_segment, d2 claim_thru_date from o where n = 1""")
def latest_inpatient_rows(spark, sf_dir):
    keys = cleaning.ENTITIES["inpatient_claims"].keys
    typed = cleaning.with_keys(cleaning.typed(_raw_lines(spark, sf_dir), "inpatient_claims"), keys)
    return cleaning.latest_rows(typed, keys).select("claim_id", "bene_id", "year", "claim_segment", "claim_thru_date")


@query("""
select l_orderkey, l_linenumber, l_shipdate, case l_returnflag when 'N' then false end flag, l_returnflag in ('A', 'R') unknown_flag, coalesce(l_extendedprice, 0) + coalesce(greatest(l_quantity, 0), 0) total, (l_quantity > 25)::int + (l_discount > 0.05)::int conditions, [l_returnflag, l_linestatus] codes from lineitem""")
def row_functions(spark, sf_dir):
    df = parquet(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", "l_shipdate", s.yes_no("l_returnflag").alias("flag"), s.yes_no("l_returnflag").isNull().alias("unknown_flag"), s.row_sum(["l_extendedprice", "l_quantity"]).alias("total"), s.row_count([F.col("l_quantity") > 25, F.col("l_discount") > 0.05]).alias("conditions"), s.distinct_filled(["l_returnflag", "l_linestatus"]).alias("codes"))


@query("select count(*) row_count, 60000::bigint expected_row_count, true key_present, 0::bigint null_key_count, count(distinct o_orderkey) distinct_key_count from orders")
def raw_validation(spark, sf_dir):
    return cleaning.raw_validation(parquet(spark, sf_dir, "orders"), "o_orderkey", 60_000)


def _filled_raw(df: DataFrame, entity: str, columns: dict) -> DataFrame:
    """A raw frame of an entity: the given columns, null strings for its others, lineage."""
    e = cleaning.ENTITIES[entity]
    wanted = {*e.text.values(), *e.dates.values(), *e.ints.values(), *e.doubles.values(), *e.unlisted}
    extra = {"beneficiary_summary": {*cleaning.CHRONIC_FLAGS.values(), "BENE_ESRD_IND"}, "outpatient_claims": {f"HCPCS_CD_{i}" for i in range(1, 46)}, "carrier_claims": {f"{c}_{i}" for c in ("PRF_PHYSN_NPI", "HCPCS_CD") for i in range(1, 14)}}
    lineage = {"_bronze_source_file": F.lit("sample.csv"), "_bronze_loaded_at_utc": F.lit("2009-01-01").cast("timestamp"), "_bronze_source_year": F.lit(2008)}
    nulls = {c: F.lit(None).cast("string") for c in sorted((wanted | extra.get(entity, set())) - set(columns))}
    return df.select(*(c.alias(n) for n, c in (columns | nulls | lineage).items()))


def _text(c: str, kind: str = "string"):
    return F.col(c).cast(kind).cast("string")


@query("""
select c_custkey::varchar bene_id, 2008::int as year, case c_custkey % 3 when 0 then 'male' when 1 then 'female' else 'unknown' end sex, case when c_custkey % 7 > 0 then make_date(1930 + (c_custkey % 40)::int, 1 + (c_custkey % 12)::int, 15) end birth_date, (c_custkey % 13)::int hi_coverage_months,
  case c_custkey % 2 when 0 then true else false end diabetes_flag, case when c_custkey % 5 = 0 then null else c_custkey % 5 = 1 end cancer_flag, ((c_custkey % 2 = 0)::int + (c_custkey % 5 = 1)::int)::int chronic_condition_count, round(c_acctbal, 2) beneficiary_inpatient_reimbursement_amt, (c_custkey % 11 = 0) death_flag, (c_custkey % 7 = 0 and c_custkey % 2 = 0)::int parse_failure_count from customer""")
def typed_beneficiaries(spark, sf_dir):
    k = F.col("c_custkey")
    birth = F.when(k % 14 == 0, "19301399").when(k % 7 > 0, F.format_string("%d%02d15", 1930 + k % 40, 1 + k % 12))
    raw = _filled_raw(parquet(spark, sf_dir, "customer"), "beneficiary_summary", {
        "DESYNPUF_ID": F.concat(F.lit(" "), _text("c_custkey")), "BENE_BIRTH_DT": birth, "BENE_DEATH_DT": F.when(k % 11 == 0, "20081231"), "BENE_SEX_IDENT_CD": (k % 3 + 1).cast("string"), "BENE_HI_CVRAGE_TOT_MONS": (k % 13).cast("string"),
        "SP_DIABETES": F.when(k % 2 == 0, "1").otherwise("2"), "SP_CNCR": F.when(k % 5 == 1, "Y").when(k % 5 != 0, "N").otherwise(" "), "MEDREIMB_IP": F.round("c_acctbal", 2).cast("decimal(12,2)").cast("string"),
    })
    out = cleaning.typed(raw, "beneficiary_summary")
    return out.select("bene_id", "year", "sex", "birth_date", "hi_coverage_months", "diabetes_flag", "cancer_flag", "chronic_condition_count", "beneficiary_inpatient_reimbursement_amt", "death_flag", F.col("_parse_failure_count").alias("parse_failure_count"))


@query("""
select o_orderkey::varchar claim_id, o_custkey::varchar bene_id, o_orderdate::date claim_from_date, (o_orderdate::date + (o_orderkey % 5)::int - 1)::date claim_thru_date, (o_orderkey % 5)::int claim_days, o_orderkey % 5 > 0 claim_dates_valid,
  list_distinct(list_filter([case when o_orderkey % 4 = 0 then '99283' else (o_custkey % 100)::varchar end, case when o_orderkey % 2 = 0 then 'G1' end], lambda x: x is not null)).list_sort().array_to_string('|') codes, (1 + (o_orderkey % 2 = 0)::int)::int estimated_line_count, case when o_orderkey % 4 = 0 then true end emergency, o_totalprice payment_amount from orders""")
def typed_outpatient_claims(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    raw = _filled_raw(parquet(spark, sf_dir, "orders"), "outpatient_claims", {
        "CLM_ID": _text("o_orderkey"), "DESYNPUF_ID": _text("o_custkey"), "CLM_FROM_DT": F.date_format(day, "yyyyMMdd"), "CLM_THRU_DT": F.date_format(F.date_add(day, (k % 5).cast("int") - 1), "yyyyMMdd"),
        "HCPCS_CD_1": F.when(k % 4 == 0, "99283").otherwise((F.col("o_custkey") % 100).cast("string")), "HCPCS_CD_2": F.when(k % 2 == 0, " G1 "), "CLM_PMT_AMT": _text("o_totalprice", "decimal(14,2)"),
    })
    out = cleaning.typed(raw, "outpatient_claims")
    return out.select("claim_id", "bene_id", "claim_from_date", "claim_thru_date", "claim_days", "claim_dates_valid", F.array_join(F.array_sort("hcpcs_codes"), "|").alias("codes"), "estimated_line_count", F.col("emergency_department_claim_flag").alias("emergency"), "payment_amount")


@query("""
select o_orderkey::varchar claim_id, case when o_orderkey % 3 = 0 then 'p2' else (o_custkey % 50)::varchar end provider_id, case when o_orderkey % 3 = 0 then 1 else 2 end::int providers, greatest(1, 1 + (o_orderkey % 2 = 0)::int)::int estimated_line_count, round(o_totalprice + case when o_orderkey % 2 = 0 then 10.5 else 0 end, 2) payment_amount, round(o_totalprice, 2) allowed_amount, year(o_orderdate)::int as year from orders""")
def typed_carrier_claims(spark, sf_dir):
    k, day, pay = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd"), _text("o_totalprice", "decimal(14,2)")
    raw = _filled_raw(parquet(spark, sf_dir, "orders"), "carrier_claims", {
        "CLM_ID": _text("o_orderkey"), "DESYNPUF_ID": _text("o_custkey"), "CLM_FROM_DT": day, "CLM_THRU_DT": day, "PRF_PHYSN_NPI_1": F.when(k % 3 == 0, " ").otherwise((F.col("o_custkey") % 50).cast("string")), "PRF_PHYSN_NPI_2": F.lit("p2"), "HCPCS_CD_1": F.lit("x"),
        "LINE_NCH_PMT_AMT_1": pay, "LINE_NCH_PMT_AMT_2": F.when(k % 2 == 0, "10.5"), "LINE_ALOWD_CHRG_AMT_1": pay, "LINE_ALOWD_CHRG_AMT_2": F.lit("-5"),
    })
    out = cleaning.typed(raw, "carrier_claims")
    return rounded(out.select("claim_id", "provider_id", F.size("provider_ids").alias("providers"), "estimated_line_count", "payment_amount", "allowed_amount", "year"), 2)


@query("select o_orderkey::varchar pde_id, o_custkey::varchar bene_id, o_orderdate::date drug_fill_date, (o_orderkey % 30)::int days_supply, o_totalprice drug_cost, 0.0::double patient_pay_amount, year(o_orderdate)::int as year from orders")
def typed_drug_events(spark, sf_dir):
    raw = _filled_raw(parquet(spark, sf_dir, "orders"), "prescription_drug_events", {
        "PDE_ID": _text("o_orderkey"), "DESYNPUF_ID": _text("o_custkey"), "SRVC_DT": F.date_format("o_orderdate", "yyyyMMdd"), "DAYS_SUPLY_NUM": F.concat((F.col("o_orderkey") % 30).cast("string"), F.lit(".9")), "TOT_RX_CST_AMT": _text("o_totalprice", "decimal(14,2)"), "PTNT_PAY_AMT": F.lit("-1"),
    })
    return cleaning.typed(raw, "prescription_drug_events").select("pde_id", "bene_id", "drug_fill_date", "days_supply", "drug_cost", "patient_pay_amount", "year")


@query("select 'inpatient_claims' entity, 'published' status, count(*) rows_in, count(*) - count(distinct (l_orderkey, l_linenumber)) rows_removed from lineitem")
def silver_audit(spark, sf_dir):
    """The audit row of a published entity: its gate, the rows read, and those removed as not the latest of their key."""
    raw = parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_shipdate").alias("_bronze_loaded_at_utc"), F.lit("f").alias("_bronze_source_file"))
    kept = cleaning.latest_rows(raw, ["l_orderkey", "l_linenumber"])
    counts = {c: F.lit(0).cast("long") for c in cleaning.FATAL}
    metrics_row = kept.agg(F.count("*").alias("row_count")).withColumns(counts)
    return cleaning.audit(metrics_row, "inpatient_claims", "run1", raw.count(), kept.count()).select("entity", "status", "rows_in", "rows_removed")


# --- metrics of scores -----------------------------------------------------------------------------------------

RUN = ["model_name", "split_name"]


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role(spark, sf_dir, "scores")


@query("""
with c as (select model_name, split_name, count(*) row_count, avg("label") positive_rate, count(*) filter (predicted_probability >= 0.5 and "label" = 1) tp, count(*) filter (predicted_probability >= 0.5 and "label" = 0) fp, count(*) filter (predicted_probability < 0.5 and "label" = 1) fn, count(*) filter (predicted_probability < 0.5 and "label" = 0) tn, avg((predicted_probability - "label") ** 2) b from scores group by 1, 2)
select model_name, split_name, row_count, round(positive_rate, 6) positive_rate, tp true_positive, fp false_positive, fn false_negative, tn true_negative, round(b, 6) brier_score, round((tp + tn) / row_count, 6) accuracy, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) "precision", round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) recall,
  round(case when tn + fp = 0 then 0 else tn / (tn + fp) end, 6) specificity, round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) f1_score, round(1 - (tp + tn) / row_count, 6) misclassification_error from c""", ("scores",))
def classification_metrics(spark, sf_dir):
    return rounded(metrics.classification(_scores(spark, sf_dir), 0.5, RUN))


@query("""
with v as (select model_name, split_name, predicted_probability sc, count(*) n, sum("label") pos from scores group by 1, 2, 3),
  w as (select *, sum(n) over d cn, sum(pos) over d cp, sum(n) over a tn, sum(pos) over a tp from v window d as (partition by model_name, split_name order by sc desc), a as (partition by model_name, split_name))
select model_name, split_name, round(sum(pos * ((tn - tp) - (cn - cp) + (n - pos) / 2)) / (max(tp) * (max(tn) - max(tp))), 6) roc_auc, round(sum(pos / tp * cp / cn), 6) pr_auc from w group by 1, 2""", ("scores",))
def ranking_areas(spark, sf_dir):
    return rounded(metrics.auc(_scores(spark, sf_dir), RUN))


TOPK = """
with r as (select *, row_number() over (partition by model_name, split_name order by predicted_probability desc, id, "label") r, count(*) over (partition by model_name, split_name) n, sum("label") over (partition by model_name, split_name) pos from scores),
  f as (select unnest({fractions}) f),
  k as (select model_name, split_name, f selected_fraction, greatest(1, ceil(round(n * f, 9)))::bigint k, n, pos, "label", predicted_probability, r from r, f)
select model_name, split_name, selected_fraction, max(k) selected_count, sum("label")::bigint captured_positive_count, round(case when max(pos) = 0 then 0 else sum("label") / max(pos) end, 9) capture_rate, round(sum("label") / max(k), 9) precision_at_k, round(case when max(pos) = 0 then 0 else sum("label") / max(k) / (max(pos) / max(n)) end, 9) lift_at_k, round(sum(predicted_probability) / max(k), 9) average_predicted_probability
from k where r <= k group by 1, 2, 3"""


@query(TOPK.format(fractions="[0.01::double, 0.05::double, 0.1::double, 0.2::double]"), ("scores",))
def top_k_capture_and_lift(spark, sf_dir):
    return rounded(metrics.top_k(_scores(spark, sf_dir), [0.01, 0.05, 0.1, 0.2], RUN, "id"), 9)


@query(TOPK.format(fractions=str([f"{i / 100}::double" for i in range(1, 21)]).replace("'", "")), ("scores",))
def capture_curve(spark, sf_dir):
    return rounded(metrics.curve(_scores(spark, sf_dir), RUN, "id"), 9)


@query("""
select model_name, split_name, count(*) row_count, round(avg(predicted_probability), 6) mean_prediction, round(avg("label"), 6) observed_rate, round(avg((predicted_probability - "label") ** 2), 6) brier_score, round(abs(avg(predicted_probability) - avg("label")), 6) absolute_calibration_gap from scores group by 1, 2""", ("scores",))
def calibration_summary(spark, sf_dir):
    return rounded(metrics.calibration_summary(_scores(spark, sf_dir), RUN))


DECILES = """
with r as (select *, row_number() over (partition by model_name, split_name order by predicted_probability {order}, id) - 1 r, count(*) over (partition by model_name, split_name) n from scores),
  d as (select *, ({decile})::int score_decile from r)
select model_name, split_name, score_decile, count(*) row_count, round(avg("label"), 6) observed_rate, round(avg(predicted_probability), 6) mean_predicted_probability, min(predicted_probability) min_predicted_probability, max(predicted_probability) max_predicted_probability, round(avg(predicted_probability) - avg("label"), 6) calibration_gap from d group by 1, 2, 3"""


@query(DECILES.format(order="desc", decile="floor(r * 10 / n) + 1"), ("scores",))
def calibration_deciles_descending(spark, sf_dir):
    return rounded(metrics.calibration_deciles(_scores(spark, sf_dir), RUN, "id"))


@query(DECILES.format(order="asc", decile="greatest(1, ceil(r * 10 / greatest(n - 1, 1)))"), ("scores",))
def calibration_deciles_ascending(spark, sf_dir):
    return rounded(metrics.calibration_deciles(_scores(spark, sf_dir), RUN, "id", descending=False))


@query("""
with b as (select *, case when predicted_probability <= 0.1 then 0 when predicted_probability <= 0.2 then 1 when predicted_probability <= 0.3 then 2 when predicted_probability <= 0.4 then 3 when predicted_probability <= 0.5 then 4 when predicted_probability <= 0.6 then 5 when predicted_probability <= 0.7 then 6 when predicted_probability <= 0.8 then 7 when predicted_probability <= 0.9 then 8 else 9 end::int probability_bin from scores where predicted_probability between 0 and 1)
select model_name, split_name, probability_bin, count(*) row_count, round(avg("label"), 6) observed_rate, round(avg(predicted_probability), 6) mean_predicted_probability, round(probability_bin / 10, 6) bin_lower_bound, round((probability_bin + 1) / 10, 6) bin_upper_bound from b group by 1, 2, 3""", ("scores",))
def reliability_curve(spark, sf_dir):
    return rounded(metrics.reliability(_scores(spark, sf_dir), RUN))


@query("""
with t as (select unnest([round(0.1 + 0.05 * i, 2)::double for i in range(17)]) threshold),
  c as (select model_name, split_name, threshold, count(*) filter (predicted_probability >= threshold and "label" = 1) tp, count(*) filter (predicted_probability >= threshold) said, sum("label") pos from scores, t group by 1, 2, 3),
  f as (select *, case when said + pos = 0 then 0 else 2 * tp / (said + pos) end f1 from c),
  o as (select *, row_number() over (partition by model_name, split_name order by f1 desc, threshold) n from f)
select model_name, split_name, threshold decision_threshold, round(f1, 6) f1_score from o where n = 1""", ("scores",))
def best_thresholds(spark, sf_dir):
    return rounded(metrics.best_threshold(_scores(spark, sf_dir), RUN, metrics.coarse_grid()))


@query("""
with v as (select * from scores where split_name = 'validation'),
  q as (select model_name, run_id, unnest(quantile_cont(predicted_probability, [i / 100.0 for i in range(101)])) threshold from v group by 1, 2),
  t as (select distinct model_name, run_id, threshold from (select * from q union all select distinct model_name, run_id, unnest([(i / 100.0)::double for i in range(1, 100)]) from v)),
  c as (select model_name, run_id, threshold, count(*) filter (predicted_probability >= threshold and "label" = 1) tp, count(*) filter (predicted_probability >= threshold) said, sum("label") pos from v join t using (model_name, run_id) group by 1, 2, 3),
  f as (select *, case when said + pos = 0 then 0 else 2 * tp / (said + pos) end f1 from c)
select model_name, run_id, round(threshold, 6) decision_threshold, round(f1, 6) f1_score from f qualify row_number() over (partition by model_name, run_id order by f1 desc, threshold) = 1""", ("scores",))
def best_fine_thresholds(spark, sf_dir):
    """Of each run's 99 fixed thresholds and 101 percentiles of its validation scores, the one with the largest F1."""
    held, by = _scores(spark, sf_dir).where("split_name = 'validation'"), ["model_name", "run_id"]
    return rounded(metrics.best_of_thresholds(held, by, metrics.fine_thresholds(held, by)))


@query("""
with e as (select value x from events where ts < timestamp '2024-01-16'), a as (select value x from events where ts >= timestamp '2024-01-16'),
  q as (select list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) g from e),
  c as (select i, (select count(*) from e, q where x >= g[i] and (x < g[i + 1] or (i = len(g) - 1 and x = g[i + 1]))) ne, (select count(*) from a, q where x >= g[i] and (x < g[i + 1] or (i = len(g) - 1 and x = g[i + 1]))) na from (select unnest(range(1, len(g))) i from q)),
  s as (select greatest(ne / greatest(sum(ne) over (), 1), 1e-6) se, greatest(na / greatest(sum(na) over (), 1), 1e-6) sa from c)
select round(sum((sa - se) * ln(sa / se)), 8) psi from s""")
def population_stability(spark, sf_dir):
    events = parquet(spark, sf_dir, "events")
    half = F.timestamp_seconds(F.lit(1705363200))
    edge = F.lit("2024-01-16").cast("timestamp_ntz") if dict(events.dtypes)["ts"] == "timestamp_ntz" else half
    return rounded(metrics.stability_index(events.where(F.col("ts") < edge), events.where(F.col("ts") >= edge), "value"), 8)


# --- audits and exploration ------------------------------------------------------------------------------------

NUMERIC = ["c_acctbal", "c_nationkey"]


def _order_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = parquet(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("bene_id"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("total_cost"), (F.col("o_orderkey") % 7).cast("int").alias("week_count"), "o_orderstatus", "o_orderpriority", F.when(F.col("o_custkey") % 10 < 3, "test").otherwise("train").alias("split_name"), (F.col("o_orderstatus") == "F").cast("double").alias("label"))


VALUES = """
with v as (select o_custkey::varchar bene_id, year(o_orderdate)::int as year, o_totalprice total_cost, (o_orderkey % 7)::int week_count, o_orderstatus, o_orderpriority, case when o_custkey % 10 < 3 then 'test' else 'train' end split_name, (o_orderstatus = 'F')::int::double lab from orders),
  u as (select *, 'total_cost' feature_name, total_cost value from v union all select *, 'week_count', week_count from v),
  g as (select *, 'o_orderstatus' feature_name, o_orderstatus category_value from v union all select *, 'o_orderpriority', o_orderpriority from v)
"""
_NUM, _CAT = ["total_cost", "week_count"], ["o_orderstatus", "o_orderpriority"]


@query(VALUES + """
select feature_name, 'numeric' feature_type, count(*) row_count, 0::bigint null_count, count(distinct value) unique_count, count(*) filter (value = 0) zero_count, count(*) filter (value < 0) negative_count, 0::bigint impossible_value_count, min(value) min_value, max(value) max_value, round(avg(value), 4) mean_value, round(stddev(value), 4) stddev_value, 0.0::double null_rate, false zero_variance_flag, round(count(*) filter (value = 0) / count(*), 6) zero_rate, 'pass' audit_severity from u group by 1
union all select feature_name, 'categorical', count(*), 0, count(distinct category_value), null, null, 0, null, null, null, null, 0.0, false, null, 'pass' from g group by 1""")
def feature_quality(spark, sf_dir):
    out = audits.feature_quality(_order_values(spark, sf_dir), _NUM, _CAT)
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("mean_value", "stddev_value")}))


@query(VALUES + "select year, feature_name, count(*) row_count, round(avg(value), 4) mean_value, round(stddev(value), 4) stddev_value, min(value) min_value, quantile_disc(value, 0.5) median_value, max(value) max_value from u group by 1, 2")
def numeric_by_year(spark, sf_dir):
    return rounded(audits.numeric_by_year(_order_values(spark, sf_dir), _NUM, exact=True), 4)


@query(VALUES + ", c as (select year, feature_name, category_value, count(*) category_count from g group by 1, 2, 3) select *, (sum(category_count) over (partition by year, feature_name))::bigint row_count, round(category_count / sum(category_count) over (partition by year, feature_name), 6) category_rate from c")
def categories_by_year(spark, sf_dir):
    return rounded(audits.categories_by_year(_order_values(spark, sf_dir), _CAT))


@query(VALUES + "select feature_name, category_value, count(*) row_count, sum(lab)::bigint positive_count, round(avg(lab), 6) target_rate from g group by 1, 2")
def category_target_rate(spark, sf_dir):
    return rounded(audits.target_rate(_order_values(spark, sf_dir), _CAT))


@query(VALUES + """
, m as (select feature_name, count(*) filter (split_name = 'train') train_row_count, count(*) filter (split_name = 'test') test_row_count, avg(value) filter (split_name = 'train') a, avg(value) filter (split_name = 'test') b, stddev(value) filter (split_name = 'train') sa, stddev(value) filter (split_name = 'test') sb from u group by 1)
select feature_name, train_row_count, test_row_count, round(a, 4) train_value, round(b, 4) test_value, round(abs(b - a), 4) absolute_difference, round((b - a) / sqrt((sa ** 2 + sb ** 2) / 2), 4) standardized_difference, abs((b - a) / sqrt((sa ** 2 + sb ** 2) / 2)) >= 0.1 drift_flag from m""")
def numeric_drift(spark, sf_dir):
    return rounded(audits.numeric_drift(_order_values(spark, sf_dir), _NUM), 4)


@query(VALUES + """
, c as (select feature_name, category_value, count(*) filter (split_name = 'train') a, count(*) filter (split_name = 'test') b from g group by 1, 2),
  t as (select *, sum(a) over (partition by feature_name) ta, sum(b) over (partition by feature_name) tb from c)
select feature_name, category_value, ta::bigint train_row_count, tb::bigint test_row_count, round(a / ta, 6) train_value, round(b / tb, 6) test_value, round(abs(b / tb - a / ta), 6) absolute_difference, abs(b / tb - a / ta) >= 0.05 drift_flag from t""")
def category_drift(spark, sf_dir):
    return rounded(audits.category_drift(_order_values(spark, sf_dir), _CAT))


@query(VALUES + "select year, count(*) row_count, count(distinct bene_id) bene_count from v group by 1")
def rows_by_year(spark, sf_dir):
    return audits.rows_by_year(_order_values(spark, sf_dir))


@query("select 'birth_date' feature_name, count(*) filter (birth_date is null) missing_count, count(*) row_count, round(count(*) filter (birth_date is null) / count(*), 6) missing_rate from beneficiaries union all select 'sex', 0, count(*), 0 from beneficiaries", ("beneficiaries",))
def missing_values(spark, sf_dir):
    return rounded(audits.missing(role(spark, sf_dir, "beneficiaries"), ["birth_date", "sex"]))


@query("with q as (select unnest([0.0::double, 0.25::double, 0.5::double, 0.75::double, 0.9::double, 0.95::double, 0.99::double, 1.0::double]) \"quantile\", unnest(quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0])) value from orders) select \"quantile\", round(value, 4) value from q")
def cost_quantiles(spark, sf_dir):
    return rounded(audits.quantiles(parquet(spark, sf_dir, "orders"), "o_totalprice"), 4)


@query("select o_orderpriority, count(*) row_count, round(quantile_cont(o_totalprice, 0.5), 4) median_cost, round(avg(o_totalprice), 4) mean_cost, round(quantile_cont(o_totalprice, 0.9), 4) p90_cost from orders group by 1")
def cost_by_group(spark, sf_dir):
    return rounded(audits.cost_by(parquet(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"), 4)


@query("""
with u as (select 'c_acctbal' feature_name, c_acctbal value from customer union all select 'c_nationkey', c_nationkey from customer)
select feature_name, round(avg((value = 0)::int), 6) zero_rate, count(*) filter (value < 0) negative_count, min(value) min_value, round(quantile_cont(value, 0.5), 6) median_value, round(quantile_cont(value, 0.9), 6) p90_value, round(quantile_cont(value, 0.99), 6) p99_value, max(value) max_value, count(distinct value) unique_count from u group by 1""")
def numeric_summary(spark, sf_dir):
    return rounded(audits.numeric_summary(parquet(spark, sf_dir, "customer"), NUMERIC))


@query(VALUES + """
, c as (select feature_name, category_value, count(*) filter (split_name = 'train') a, count(*) filter (split_name = 'test') b from g group by 1, 2),
  t as (select *, sum(a) over (partition by feature_name) ta, sum(b) over (partition by feature_name) tb from c)
select feature_name, category_value, round(abs(b / tb - a / ta), 6) absolute_difference from t where abs(b / tb - a / ta) >= 0.002""")
def drifted_features(spark, sf_dir):
    return rounded(audits.drifted(audits.category_drift(_order_values(spark, sf_dir), _CAT, flag=0.002)).select("feature_name", "category_value", "absolute_difference"))


@query(GOLD + """
select bene_id, year, (coalesce(age, 75) * coalesce(age, 75))::bigint age_squared, (ch * ch)::bigint chronic_condition_count_squared, (coalesce(age, 75) * n)::bigint age_total_claim_interaction, round(ln(1 + n), 5) total_claim_count_log1p, round(ln(1 + greatest(round(cost, 2), 0)), 5) annual_cost_log1p from gold""", ("claims", "beneficiaries"))
def exported_features(spark, sf_dir):
    """A CSV export of feature columns, read back with its column check, and what is made again from them."""
    kept = "bene_id string, year int, age_years_imputed bigint, chronic_condition_count bigint, total_claim_count bigint, annual_claim_cost double"
    names, path = [x.split()[0] for x in kept.split(", ")], scratch_path(spark, "export")
    _gold(spark, sf_dir, ranks=False).select(*names[:-1], F.round("annual_claim_cost", 2).alias("annual_claim_cost")).write.option("header", True).csv(path)
    made = features.rederived(features.read_export(spark, path, kept, names))
    return rounded(made.select("bene_id", "year", "age_squared", "chronic_condition_count_squared", "age_total_claim_interaction", "total_claim_count_log1p", "annual_cost_log1p"), 5)


@query(GOLD + "select bene_id, year, 125::int model_columns, mon::int enrollment_months_count, burden chronic_burden_band from gold", ("claims", "beneficiaries"))
def model_contract(spark, sf_dir):
    """The feature table in the model's column order."""
    df = features.contract(feature_table(spark, sf_dir), ["bene_id", "year", *contract.ORDER], contract.INTS, contract.LONGS)
    return df.select("bene_id", "year", F.lit(len(df.columns) - 2).alias("model_columns"), "enrollment_months_count", "chronic_burden_band")


@query(VALUES + "select feature_name, round(corr(value, lab), 6) correlation, round(abs(corr(value, lab)), 6) absolute_correlation from u group by 1")
def label_correlation(spark, sf_dir):
    return rounded(audits.label_correlation(_order_values(spark, sf_dir), _NUM))


@query(GOLD + """
select count(*) row_count, 0::bigint duplicate_key_count, 0::bigint null_key_count, count(*) filter (age is null) any_missing_count, count(*) filter (mon <= 0) nonpositive_months_count, 0::bigint negative_cost_count, count(*) filter (not exists (select 1 from gold n where n.bene_id = gold.bene_id and n.year = gold.year + 1)) lost_in_join_count from gold""", ("claims", "beneficiaries"))
def table_integrity(spark, sf_dir):
    return audits.integrity(_gold(spark, sf_dir))


@query(GOLD + "select ch chronic_condition_count, count(*) row_count, round(count(*) / sum(count(*)) over (), 6) row_rate from gold group by 1", ("claims", "beneficiaries"))
def chronic_distribution(spark, sf_dir):
    return rounded(audits.distribution(_beneficiaries(spark, sf_dir), "chronic_condition_count"))


@query("""
with x as (select ln(1 + greatest(o_totalprice, 0)) x from orders), e as (select min(x) lo, max(x) hi from x)
select least(floor((x - lo) / (hi - lo) * 50), 49)::int bin, count(*) row_count from x, e group by 1""")
def cost_histogram(spark, sf_dir):
    return audits.log_histogram(parquet(spark, sf_dir, "orders"), "o_totalprice")


# --- runs and monitoring ---------------------------------------------------------------------------------------


@query("""
with r as (select model_name, run_id, max(processed_at_utc) latest from audit where split_name = 'test' group by 1, 2), o as (select *, row_number() over (partition by model_name order by latest desc, run_id desc) n from r)
select model_name, run_id, latest from o where n = 1""", ("audit",))
def latest_runs(spark, sf_dir):
    return runs.latest_run_ids(role(spark, sf_dir, "audit"))


@query("""
with r as (select model_name, run_id, max(processed_at_utc) latest from audit where split_name = 'test' group by 1, 2), o as (select *, row_number() over (partition by model_name order by latest desc, run_id desc) n from r)
select s.model_name, s.run_id, s.processed_at_utc, s.split_name, round(accuracy, 6) accuracy, round(1 - accuracy, 6) test_misclassification_error from audit s join o on o.n = 1 and s.model_name = o.model_name and s.run_id = o.run_id where s.split_name = 'test'""", ("audit",))
def run_comparison(spark, sf_dir):
    audit = role(spark, sf_dir, "audit").withColumn("decision_threshold_from_tuning_split", F.lit(0.5))
    out = runs.comparison_rows(audit, {"click": "web", "view": "web"})
    return rounded(out.select("model_name", "run_id", "processed_at_utc", "split_name", "accuracy", "test_misclassification_error"))


@query("select id, s.model_name, s.run_id from scores s where split_name = 'test' and run_id = 'run1'", ("scores",))
def selected_test_rows(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    chosen = scores.select("model_name", F.lit("run1").alias("run_id")).distinct()
    return runs.selected_rows(scores, chosen).select("id", "model_name", "run_id")


@query("select distinct model_name, 'run9' run_id from scores", ("scores",))
def missing_selected_runs(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    return runs.missing_runs(scores, scores.select("model_name", F.explode(F.array(F.lit("run1"), F.lit("run9"))).alias("run_id")).distinct())


@query("""
with m as (select model_name, count(*) row_count, avg(predicted_probability) p, avg("label") y, max(predicted_probability) max_prediction from scores where split_name = 'test' group by 1)
select model_name, row_count, round(p, 6) mean_prediction, round(y, 6) observed_rate, max_prediction, round(abs(p - y), 6) absolute_gap, case when abs(p - y) >= 0.05 then 'review_required' when abs(p - y) >= 0.02 then 'warning' else 'acceptable' end status from m""", ("scores",))
def score_monitoring(spark, sf_dir):
    return rounded(runs.monitoring(_scores(spark, sf_dir).where("split_name = 'test'")))


@query("""
select model_name, count(*) row_count, round(avg(predicted_probability), 6) mean_prediction, round(avg("label"), 6) observed_rate, max(predicted_probability) max_prediction from scores where split_name = 'test' and run_id = 'run1' group by 1""", ("scores",))
def selected_score_summary(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    return rounded(runs.score_summary(runs.selected_rows(scores, scores.select("model_name", F.lit("run1").alias("run_id")).distinct())))


@query(f"""
with c as ({ORACLE_SQL['classification_metrics']}), a as ({ORACLE_SQL['ranking_areas']}), k as ({ORACLE_SQL['top_k_capture_and_lift']}),
  w as (select model_name, max(capture_rate) filter (selected_fraction = 0.05) top_5_capture_rate, max(capture_rate) filter (selected_fraction = 0.1) top_10_capture_rate from k where split_name = 'test' group by 1),
  m as (select c.model_name, pr_auc area_under_pr, top_5_capture_rate, top_10_capture_rate, roc_auc area_under_roc, brier_score, round(1 - accuracy, 6) test_misclassification_error from c join a using (model_name, split_name) join w using (model_name) where split_name = 'test')
select *, row_number() over (order by area_under_pr desc nulls last, top_5_capture_rate desc nulls last, top_10_capture_rate desc nulls last, area_under_roc desc nulls last, brier_score nulls last, test_misclassification_error nulls last, model_name) place from m""")
def leaderboard(spark, sf_dir):
    test = _scores(spark, sf_dir).where("split_name = 'test'")
    top = metrics.top_k(test, [0.05, 0.1], ["model_name"], "id").groupBy("model_name").agg(*(F.max(F.when(F.col("selected_fraction") == f, F.col("capture_rate"))).alias(f"top_{n}_capture_rate") for f, n in ((0.05, 5), (0.1, 10))))
    areas = metrics.auc(test, ["model_name"]).withColumnsRenamed({"roc_auc": "area_under_roc", "pr_auc": "area_under_pr"})
    errors = metrics.classification(test, 0.5, ["model_name"]).select("model_name", "brier_score", F.round(F.col("misclassification_error"), 6).alias("test_misclassification_error"))
    board = rounded(areas.join(top, "model_name").join(errors, "model_name"))
    return runs.places(board.select("model_name", "area_under_pr", "top_5_capture_rate", "top_10_capture_rate", "area_under_roc", "brier_score", "test_misclassification_error"))


@query(GOLD + """
select 'required columns' check_name, 'pass' status, '' detail union all select 'property feature_version', 'pass', 'v2'
union all select 'unique keys', 'pass', '0 rows' union all select 'chronic range', case when count(*) filter (ch not between 0 and 11) = 0 then 'pass' else 'fail' end, concat(count(*) filter (ch not between 0 and 11), ' rows') from gold
union all select 'splits of m', 'warn', 'test,train'""", ("claims", "beneficiaries"))
def pipeline_consistency(spark, sf_dir):
    gold = _gold(spark, sf_dir)
    audit = role(spark, sf_dir, "scores").where("split_name <> 'validation'").select("split_name", F.lit(labels.SPLIT_VERSION).alias("shared_split_version"), F.lit(1).alias("processed_at_utc"))
    return runs.consistency(gold, ["bene_id", "year"], {"feature_version": "v2"}, {"feature_version": "v2"}, {"m": audit}, labels.SPLIT_VERSION)


PUBLISHED = ("sound", "other_version", "repeated", "absent")


@query("""
with c as (select unnest(['table exists', 'required columns', 'property feature_version', 'property grain', 'property key', 'unique keys', 'chronic range', 'splits of m']) check_name),
  n as (select count(*) filter (c_nationkey = 3) again from customer),
  t as (select unnest(['sound', 'other_version', 'repeated', 'absent']) table_name)
select table_name, check_name,
  case when check_name = 'splits of m' then 'pass' when table_name = 'absent' then 'fail' when check_name = 'property feature_version' and table_name = 'other_version' then 'fail'
       when check_name = 'unique keys' and table_name = 'repeated' and again > 0 then 'fail' else 'pass' end status,
  case check_name when 'splits of m' then 'test,train,validation' when 'table exists' then case when table_name = 'absent' then 'not there' else '' end when 'required columns' then ''
       when 'property feature_version' then case when table_name = 'other_version' then 'features-0' else 'features-1' end when 'property grain' then 'bene_id-year' when 'property key' then 'bene_id,year'
       when 'unique keys' then concat(case when table_name = 'repeated' then again else 0 end, ' rows') else '0 rows' end detail
from t, c, n where table_name <> 'absent' or check_name in ('table exists', 'splits of m')""", ("scores",))
def published_table_checks(spark, sf_dir):
    """Tables published by year with their properties, and one that is not there: what the checks read back of each."""
    rows = parquet(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("bene_id"), (F.col("c_nationkey") % 3 + 2000).alias("year"), (F.col("c_nationkey") % 12).alias("chronic_condition_count"), "c_nationkey")
    audit = role(spark, sf_dir, "scores").select("split_name", F.lit(labels.SPLIT_VERSION).alias("shared_split_version"), F.lit(1).alias("processed_at_utc"))
    expected = {"feature_version": features.FEATURE_VERSION, "grain": "bene_id-year", "key": "bene_id,year"}
    out = []
    for kind in PUBLISHED:
        name = f"tallyframe_{kind}_{uuid.uuid4().hex}"
        if kind != "absent":
            made = rows.unionByName(rows.where("c_nationkey = 3")) if kind == "repeated" else rows
            tables.publish_features(made.drop("c_nationkey"), name, "features-0" if kind == "other_version" else features.FEATURE_VERSION, "customer", "query")
        found = runs.published_consistency(spark, name, ["bene_id", "year"], expected, {"m": audit}, labels.SPLIT_VERSION)
        out.append(found.select(F.lit(kind).alias("table_name"), "check_name", "status", "detail"))
    return reduce(DataFrame.unionByName, out)


@query("""
with m as (select model_name, run_id, split_name, avg((predicted_probability - "label") ** 2) b, avg("label") y, avg(predicted_probability) c from scores group by 1, 2, 3)
select model_name, run_id, split_name, round(b, 6) brier_score, round(y, 6) positive_rate, round(c, 6) top_10_capture_rate, c >= 0.4 capture_ok, b <= 0.1 brier_ok, y between 0.08 and 0.12 rate_ok, c >= 0.4 and b <= 0.1 and y between 0.08 and 0.12 ready from m""", ("scores",))
def deployment_gates(spark, sf_dir):
    m = _scores(spark, sf_dir).groupBy("model_name", "run_id", "split_name").agg(F.avg(F.pow(F.col("predicted_probability") - F.col("label"), 2)).alias("brier_score"), F.avg("label").alias("positive_rate"), F.avg("predicted_probability").alias("top_10_capture_rate"))
    return rounded(runs.deployment_gates(m))


@query("select model_name, count(*) row_count, count(distinct run_id) run_count from audit where split_name = 'test' group by 1 having count(*) <> 1 or count(distinct run_id) <> 1", ("audit",))
def models_with_several_runs(spark, sf_dir):
    return runs.one_run_each(role(spark, sf_dir, "audit").where("split_name = 'test'"))


@query("select * exclude (last) from (select model_name, run_id, processed_at_utc, max(processed_at_utc) over () last from audit) where processed_at_utc = last", ("audit",))
def latest_audit_rows(spark, sf_dir):
    return runs.latest_rows(role(spark, sf_dir, "audit")).select("model_name", "run_id", "processed_at_utc")


# --- batch decisions -------------------------------------------------------------------------------------------


def _scored_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _gold(spark, sf_dir)
    return gold.withColumn("predicted_probability", F.round(F.least(F.lit(1.0), F.col("annual_claim_cost") / 1_000_000), 3) * 0.98765432)  # no ties when rounded


PROFILE = GOLD + ", pr as (select *, round(least(1.0, round(cost, 2) / 1000000), 3)::double * 0.98765432::double pp, coalesce(n / nullif(mon, 0)::double, 0) cpm, coalesce(prov / nullif(n, 0)::double, 0) pfi, coalesce(cost / nullif(mon, 0), 0) cm from gold)\n"


@query(PROFILE + """
select bene_id, year, pp predicted_probability, round_even(100 * (1 - exp(-pp / 0.10)), 0)::int risk_score, case when round_even(100 * (1 - exp(-pp / 0.10)), 0) >= 95 then 'very_high' when round_even(100 * (1 - exp(-pp / 0.10)), 0) >= 90 then 'high' when round_even(100 * (1 - exp(-pp / 0.10)), 0) >= 75 then 'elevated' else 'low' end risk_tier, pp >= 0.2 intervention_flag,
  array_to_string(list_filter([case when ch >= 6 then 'High chronic condition burden' end, case when cpm >= 2 then 'High claims per enrollment month' end, case when pfi >= 0.9 then 'High provider fragmentation' end, case when ca_n > 0 then 'Carrier claim activity present' end, case when ln(1 + dys) >= 2 then 'High claim-day utilization' end], lambda x: x is not null)[1:3], '|') reasons,
  array_to_string(list_filter([case when mon <= 0 then 'zero_enrollment' end, case when mon < 12 then 'partial_year_enrollment' end, case when 12 * cm > 250000 then 'extreme_annualized_cost' end, case when n > 1000 then 'extreme_claim_count' end, case when pfi > 1 then 'provider_count_exceeds_claim_count' end], lambda x: x is not null), '|') flags,
  coalesce(nullif(array_to_string(list_filter([case when ch >= 6 then 'high chronic condition count' end, case when ip_n > 0 then 'prior inpatient utilization' end, case when cpm >= 2 or n >= 20 then 'high claims per enrollment month' end, case when high1 = 1 then 'prior high-cost year indicator' end, case when prov >= 6 then 'high provider fragmentation' end, case when ch between 3 and 5 then 'moderate chronic condition burden' end, case when cm >= 1000 then 'high prior-year cost intensity' end, case when mon between 1 and 11 then 'partial-year enrollment requires review' end], lambda x: x is not null)[1:5], '|'), ''), 'routine utilization and chronic burden profile') drivers
from pr""", ("claims", "beneficiaries"))
def batch_predictions(spark, sf_dir):
    out = scoring.predictions(_scored_profiles(spark, sf_dir), {"claims_per_enrollment_month": 2.0, "provider_fragmentation_index": 0.9, "total_claim_days_log1p": 2.0})
    return out.select("bene_id", "year", "predicted_probability", "risk_score", "risk_tier", "intervention_flag", F.array_join("reason_codes", "|").alias("reasons"), F.array_join("review_flags", "|").alias("flags"), F.array_join("risk_drivers", "|").alias("drivers"))


@query(PROFILE + """
select bene_id, year, coalesce(age, 75)::int age_years_imputed, (age is null)::int age_missing_flag, n total_claim_count, round(cost, 2) annual_claim_cost, round(cpm, 5) claims_per_enrollment_month, round(pfi, 5) provider_fragmentation_index, round(cm, 5) cost_per_enrollment_month,
  burden chronic_burden_band, coalesce(age, 75)::bigint * coalesce(age, 75) age_squared from pr""", ("claims", "beneficiaries"))
def served_profiles(spark, sf_dir):
    """The feature table's raw fields, taken as profiles that are to be scored, derive its columns again."""
    made = features.served(_gold(spark, sf_dir).select("bene_id", "year", *features.RAW_FIELDS))
    return rounded(made.select("bene_id", "year", "age_years_imputed", "age_missing_flag", "total_claim_count", F.round("annual_claim_cost", 2).alias("annual_claim_cost"), "claims_per_enrollment_month", "provider_fragmentation_index", "cost_per_enrollment_month", "chronic_burden_band", "age_squared"), 5)


@query("""
with r as (select predicted_probability v from scores where split_name = 'train'), d as (select distinct predicted_probability v from scores), g as (select d.v, count(r.v) le from d left join r on r.v <= d.v group by 1)
select id, round_even(100.0 * le / (select count(*) from r), 0)::int percentile_score from scores join g on g.v = predicted_probability""", ("scores",))
def percentile_scores(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    return scoring.percentile_scores(scores, scores.where("split_name = 'train'")).select("id", "percentile_score")


@query("select c_custkey, case when c_acctbal < 0 then 'rx_total_cost must be nonnegative' else '' end || case when c_acctbal < 0 and c_nationkey > 12 then '|' else '' end || case when c_nationkey > 12 then 'enrollment_months_count must be in 0..12' else '' end errors from customer where c_acctbal < 0 or c_nationkey > 12")
def rejected_profiles(spark, sf_dir):
    df = parquet(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("rx_total_cost"), F.col("c_nationkey").alias("enrollment_months_count"))
    return scoring.rejected_profiles(df).select("c_custkey", F.array_join("errors", "|").alias("errors"))


STATE = PROFILE + """, st as (select *, case when pp < 0.2 then 0 when pp < 0.4 then 1 when pp < 0.6 then 2 else 3 end rt, case when ch <= 2 then 0 when ch <= 5 then 1 else 2 end cb, case when n <= 8 and dys <= 5 then 0 when n <= 20 and dys <= 15 then 1 else 2 end ut from pr)
"""


@query(STATE + "select bene_id, year, ['low', 'elevated', 'high', 'very_high'][rt + 1] state_tier, ['low', 'medium', 'high'][cb + 1] state_burden, ['low', 'medium', 'high'][ut + 1] state_utilization, (((rt * 3 + cb) * 3 + ut) * 3)::int state_id from st", ("claims", "beneficiaries"))
def decision_states(spark, sf_dir):
    return scoring.states(_scored_profiles(spark, sf_dir)).select("bene_id", "year", "state_tier", "state_burden", "state_utilization", "state_id")


def _policy(spark: SparkSession) -> DataFrame:
    """A policy table: values that depend on the state and action in a fixed way."""
    state = spark.range(0, 108).select(F.col("id").cast("int").alias("state_id"))
    value = F.round(((F.col("state_id") * 7 + F.col("action_no") * 13) % 11).cast("double") / 10, 6)
    return state.crossJoin(scoring.action_table(spark).select("action", "action_no")).select("state_id", "action", value.alias("q_value"))


@query(STATE + """
, ac as (select unnest([{'i': 0, 'action': 'no_action', 'spent': 0.0, 'mu': 1.0}, {'i': 1, 'action': 'low_touch_outreach', 'spent': 1.0, 'mu': 0.95}, {'i': 2, 'action': 'care_coordination_call', 'spent': 3.0, 'mu': 0.88}, {'i': 3, 'action': 'intensive_case_management', 'spent': 6.0, 'mu': 0.8}], recursive := true)),
  x as (select st.*, ac.*, ((rt * 3 + cb) * 3 + ut) * 3 sid, ((((rt * 3 + cb) * 3 + ut) * 3 * 7 + i * 13) % 11) / 10.0::double qv,
    case i when 0 then 1.0 when 1 then case when rt = 0 then 0.45 when rt in (1, 2) then 1.05 else 1.0 end when 2 then case when rt = 0 and cb = 0 then 0.15 when ut = 2 or cb > 0 then 1.15 else 1.0 end
      else case rt when 0 then 0.2 when 1 then 0.55 when 2 then 1.1 else 1.35 end * case when cb = 2 then 1.1 else 1.0 end * case when ut = 2 then 1.12 else 1.0 end end::double fit from st cross join ac),
  y as (select *, greatest(0.01, least(0.99, pp * (1 - least(0.85, greatest(0.0, (1 - mu::double) * [1.0, 1.05, 1.1, 1.15][rt + 1]::double * fit))))) nr from x),
  z as (select *, case when nr < 0.2 then 0 when nr < 0.4 then 1 when nr < 0.6 then 2 else 3 end nt, row_number() over (partition by bene_id, year order by qv desc, i) = 1 best from y)
select bene_id, year, action, round(qv, 6) q_value, round(nr::varchar::decimal(38, 20), 6)::double next_risk, round(-spent::double + case when nr >= 0.5 then -12 else 3 end + case when nt < rt then 2 when nt > rt then -2 else 0 end + case when rt = 0 and i = 3 then -2 else 0 end, 6) expected_reward, best is_recommended from z""", ("claims", "beneficiaries"))
def action_comparison(spark, sf_dir):
    out = scoring.all_actions(scoring.states(_scored_profiles(spark, sf_dir)), _policy(spark))
    return out.select("bene_id", "year", "action", "q_value", "next_risk", "expected_reward", "is_recommended")


# --- models ----------------------------------------------------------------------------------------------------

MODEL_NUMERIC = ["annual_claim_cost", "total_claim_count", "inpatient_claim_count", "outpatient_claim_count", "unique_provider_count", "enrollment_months_count", "chronic_condition_count", "age_years_imputed", "cost_per_enrollment_month", "annual_cost_year_percentile"]
MODEL_CATEGORICAL = ["sex", "age_band", "chronic_burden_band", "utilization_trend"]


def _model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = [*dict.fromkeys(["bene_id", "year", "annual_claim_cost", *MODEL_NUMERIC, *MODEL_CATEGORICAL, "total_claim_days"])]
    table = saved(feature_table(spark, sf_dir).select(*used), "features")  # both years and the threshold read it
    frame = labels.training_target(labels.assign_split(labels.next_year(table)))
    return frame.select("bene_id", "year", "split_name", "label", *MODEL_NUMERIC, *MODEL_CATEGORICAL, "total_claim_days")


#: What the registered queries search: every point of ``training.GRIDS`` over all folds. Boosted trees take steps 10 and 4 times
#: as large there, and so fewer rounds in that proportion, as a round is three to five passes whatever the data's size; forests
#: have a fifth of the trees.
SEARCHED = training.GRIDS | {
    "random_forest": training.GRIDS["random_forest"] | {"numTrees": [10, 30, 60]},
    "gradient_boosting": training.GRIDS["gradient_boosting"] | {"rounds": [50, 100], "rate": [0.1], "patience": [5]},
    "regularized_boosting": training.GRIDS["regularized_boosting"] | {"rounds": [250], "rate": [0.2], "patience": [12]},
}


def _trained(model: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return training.train_and_score(_model_frame(spark, sf_dir), model, MODEL_NUMERIC, MODEL_CATEGORICAL, "run1", ["bene_id", "year"], training.points(SEARCHED[model]))

    return run


for _name in training.GRIDS:
    QUERIES[f"scores_of_{_name}"] = _trained(_name)


def _cost_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs with next year's label, split by a hash that SQL engines share, and two factors by the id."""
    costs = saved(_costs(spark, sf_dir), "costs")  # both years and the threshold read it
    frame = labels.training_target(labels.assign_split(labels.next_year(costs), bucket=labels.md5_bucket), exact=True)
    number = F.col("bene_id").cast("long")
    return frame.select("bene_id", "year", "split_name", "label", "annual_claim_cost", "enrollment_months_count", (number % 5).cast("string").alias("race_code"), F.when(number % 3 > 0, (number % 3).cast("string")).alias("sex"))


COST_LABELS = COSTS + """
, t as (select quantile_disc(target_cost, 0.9) threshold from p where split_name = 'train'),
  y as (select p.*, k.mon, (target_cost >= threshold)::int "label", (bene_id::bigint % 5)::varchar race_code, coalesce(nullif((bene_id::bigint % 3)::varchar, '0'), 'unknown') sex from p join (select bene_id, year, mon from k) k using (bene_id, year), t)
"""


@query(COST_LABELS + """
select m.model_name, split_name, count(*) row_count, sum("label")::bigint positive_count, true in_range, true told_by_threshold, 1::bigint thresholds
from y, (select unnest(['gradient_boosting', 'logistic_regression', 'random_forest', 'regularized_boosting']) model_name) m group by 1, 2""", ("claims", "activity"))
def model_facts(spark, sf_dir):
    """Of each model at one point of its grid: every row of every split has one score from 0 to 1, and one threshold tells its label."""
    frame, out = saved(_cost_labels(spark, sf_dir), "cost-labels"), []
    one = {"logistic_regression": {"C": 1.0}, "random_forest": {"numTrees": 5, "maxDepth": 3}, "gradient_boosting": {"rounds": 4}, "regularized_boosting": {"rounds": 4}}
    for model, point in one.items():
        scores = training.train_and_score(frame, model, ["annual_claim_cost", "enrollment_months_count"], ["race_code", "sex"], "run1", ["bene_id", "year"], [point], 2)
        told = (F.col("predicted_probability") >= F.col("decision_threshold")) == (F.col("predicted_label") == 1)
        out.append(scores.groupBy("model_name", "split_name").agg(F.count("*").alias("row_count"), F.sum("label").cast("long").alias("positive_count"), F.min(F.col("predicted_probability").between(0, 1)).alias("in_range"), F.min(told).alias("told_by_threshold"), F.count_distinct("decision_threshold").alias("thresholds")))
    return reduce(DataFrame.unionByName, out)


@query(COST_LABELS + """
select 'race_code' factor, race_code level, count(*) row_count, sum("label")::double expected from y where split_name = 'train' group by 2
union all select 'sex', sex, count(*), sum("label")::double from y where split_name = 'train' group by 2""", ("claims", "activity"))
def logit_balance(spark, sf_dir):
    """A logit of two factors and a number: over each level of a factor the probabilities add up to the positives."""
    terms = [training.Term("race_code", factor=True), training.Term("sex", factor=True), training.Term("enrollment_months_count")]
    rows = saved(logits.values(labels.split(_cost_labels(spark, sf_dir), "train"), terms), "logit-rows")  # each Newton step reads it
    plan = logits.design(rows, terms)
    scored = logits.predicted(rows, plan, logits.fit_all(rows, plan, [[t.name for t in terms]])[0], ["race_code", "sex"])
    by = lambda c: scored.groupBy(F.lit(c).alias("factor"), F.col(c).alias("level")).agg(F.count("*").alias("row_count"), F.round(F.sum("predicted_probability"), 4).alias("expected"))
    return by("race_code").unionByName(by("sex"))


@query(COST_LABELS + """
, r as (select corr(annual_claim_cost, mon) r from y where split_name = 'train')
select 'pairwise_correlation' kind, 'annual_claim_cost' a, 'twice' b, 1.0::double correlation, null::double vif, true flag from r
union all select 'vif', 'annual_claim_cost', null, null, 'infinity'::double, true from r union all select 'vif', 'twice', null, null, 'infinity'::double, true from r
union all select 'vif', 'enrollment_months_count', null, null, round(1 / (1 - r * r), 6), 1 / (1 - r * r) >= 10 from r
union all select 'pairwise_correlation', x, 'enrollment_months_count', round(abs(r), 6), null, abs(r) >= 0.85 from r, (select unnest(['annual_claim_cost', 'twice']) x) where abs(r) >= 0.7""", ("claims", "activity"))
def collinear_terms(spark, sf_dir):
    """A cost, twice the cost less a bit, and months: the first two inflate without bound, months by their correlation with cost."""
    terms = [training.Term(c) for c in ("annual_claim_cost", "twice", "enrollment_months_count")]
    frame = labels.split(_cost_labels(spark, sf_dir), "train").withColumn("twice", F.col("annual_claim_cost") * 2 - 3.3)
    rows = saved(logits.values(frame, terms), "logit-rows")
    found = logits.collinearity(rows, logits.design(rows, terms), {"all": [t.name for t in terms]})
    out = spark.createDataFrame([tuple(r[c] for c in ("kind", "a", "b", "correlation", "vif", "flag")) for r in found], "kind string, a string, b string, correlation double, vif double, flag boolean")
    return rounded(out.where("a is not null"))


def _selected(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of a selection among the ten candidate terms, on training rows of the feature table."""
    used = ["bene_id", "year", "annual_claim_cost", "age_years_imputed", "sex", "race_code", "enrollment_months_count", "chronic_condition_count", "claims_per_enrollment_month", "total_claim_days", "provider_fragmentation_index", "any_carrier_claim"]
    table = saved(_gold(spark, sf_dir, ranks=False).select(*used), "features")  # both years and the threshold read it
    frame = labels.training_target(labels.assign_split(labels.next_year(table)))
    train = saved(labels.split(frame, "train"), "train")
    return training.selection_tables(training.derived_terms(train, train), "run1")


@query()
def logit_coefficients(spark, sf_dir):
    return _selected(spark, sf_dir)["coefficients"]


@query()
def logit_backward_selection(spark, sf_dir):
    return _selected(spark, sf_dir)["steps"]


@query()
def logit_likelihood_ratio(spark, sf_dir):
    return _selected(spark, sf_dir)["ratios"]


@query()
def logit_collinearity(spark, sf_dir):
    return _selected(spark, sf_dir)["diagnostics"]


@query()
def logit_selection_audit(spark, sf_dir):
    """The audit row of a selection of variables, beside the rows of its steps and coefficients."""
    made = _selected(spark, sf_dir)
    return made["audit"].crossJoin(made["steps"].agg(F.count("*").alias("step_rows"))).crossJoin(made["coefficients"].agg(F.count("*").alias("coefficient_rows")))


@query()
def training_audit_rows(spark, sf_dir):
    scores = _trained("logistic_regression")(spark, sf_dir)
    return training.training_audit(scores, "bene_id", labels.SPLIT_VERSION).drop("processed_at_utc")


# --- sources and sinks -----------------------------------------------------------------------------------------


@query("""
with o as (select o_orderkey::varchar o_orderkey, o_custkey::varchar o_custkey, o_orderstatus from orders)
select *, 'beneficiary_summary' entity, 2009::int source_year from o union all select *, 'orders', null from o""")
def raw_csv_round_trip(spark, sf_dir):
    """Two entities read from one folder: the yearly one takes the year of the last entry that its file names contain, the other none."""
    path = scratch_path(spark, "raw")
    parquet(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.option("header", True).csv(path)
    entries = [(0, "part-", "beneficiary_summary", "sample of 2008"), (1, "part-0", "beneficiary_summary", "sample of 2009"), (2, "absent", "beneficiary_summary", "sample of 2010"), (3, "part-", "orders", "sample of 2008")]
    listed = spark.createDataFrame(entries, "position int, file_name string, entity string, title string").withColumn("year", inventory.entry_year(["title"]))
    raw = [inventory.read_raw(spark, [path], entity, listed, "o_orderkey") for entity in ("beneficiary_summary", "orders")]
    return raw[0].unionByName(raw[1]).select("o_orderkey", "o_custkey", "o_orderstatus", F.col("_bronze_entity").alias("entity"), F.col("_bronze_source_year").alias("source_year"))


@query("select n_nationkey, n_name, n_regionkey::varchar n_regionkey, n_nationkey >= 12 has_region from nation where n_nationkey >= 12 union all select n_nationkey, n_name, null, false from nation where n_nationkey < 12")
def raw_files_of_two_headers(spark, sf_dir):
    """Files of one entity whose columns stand in another order, or are fewer, are united by the columns' names."""
    path, nation = scratch_path(spark, "raw"), parquet(spark, sf_dir, "nation")
    nation.where("n_nationkey < 12").select("n_name", "n_nationkey").write.option("header", True).csv(f"{path}/a")
    nation.where("n_nationkey >= 12").select("n_nationkey", "n_regionkey", "n_name").write.option("header", True).csv(f"{path}/b")
    raw = inventory.read_raw(spark, [path], "nations")
    return raw.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", "n_regionkey", F.col("n_regionkey").isNotNull().alias("has_region"))


@query("select n_nationkey, strlen(n_name) + 1 size, sha256(n_name || chr(10)) sha256 from nation")
def file_digests(spark, sf_dir):
    """Size and SHA-256 of one file for each nation; those above 8 bytes are read as streams."""
    path = scratch_path(spark, "files")
    parquet(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(path)
    found = inventory.file_digests(spark, path, whole=8).where("startswith(file_name, 'part-')")
    return found.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), "size", "sha256")


LISTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(" union all ".join(f"select '{t}' entity, count(*) row_count, true there, false missing from {t}" for t in LISTED) + " union all " + " union all ".join(f"select 'no_{t}', 0, false, true" for t in LISTED))
def manifest_and_exceptions(spark, sf_dir):
    """Of all files that Spark lists for the tables and as many names that are not there: rows by checksummed file, and exceptions."""
    listed = spark.createDataFrame([(f"{p}{t}.parquet", f"{p}{t}") for t in LISTED for p in ("", "no_")], "file_name string, entity string")
    files = reduce(DataFrame.unionByName, (inventory.list_files(spark, f"{sf_dir}/{t}.parquet").withColumn("table", F.lit(f"{t}.parquet")) for t in LISTED))
    sums = reduce(DataFrame.unionByName, (inventory.content_checksums(parquet(spark, sf_dir, t)).withColumn("table", F.lit(f"{t}.parquet")) for t in LISTED))
    whole = files.join(sums, ["table", "file_name"], "left").groupBy(F.col("table").alias("file_name")).agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"), (F.min("size") > 0).alias("there"))
    gone = inventory.exceptions(listed, whole).select("entity", F.lit(0).cast("long").alias("row_count"), F.lit(False).alias("there"), (F.col("reason") == "missing").alias("missing"))
    return listed.join(whole, "file_name").select("entity", "row_count", "there", F.lit(False).alias("missing")).unionByName(gone)


@query("select c_custkey, c_name, c_acctbal from customer union all select c_custkey, c_name, c_acctbal from customer")
def table_append_and_read(spark, sf_dir):
    name = f"tallyframe_{uuid.uuid4().hex}"
    df = parquet(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    tables.write_table(df, name)
    tables.write_table(df.select("c_acctbal", "c_custkey", "c_name"), name, "append")
    return tables.read_table(spark, name, ["c_custkey"])
