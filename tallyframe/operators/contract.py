"""The order in which models take the feature table's columns."""

from __future__ import annotations

from tallyframe.operators.cleaning import CHRONIC_FLAGS

# The model's columns in their order; the chronic flags stand where the braces are.
_NUMERIC = """
enrollment_months_count full_year_enrolled_flag partial_year_enrolled_flag zero_enrollment_flag low_enrollment_flag
enrollment_fraction annualized_cost_per_enrolled_month annualized_claims_per_enrolled_month
age_years age_years_imputed age_over_65 age_over_75 age_over_85 age_squared
chronic_condition_count_squared chronic_condition_count {chronic}
claims_per_month_chronic_count_interaction providers_per_month_chronic_count_interaction age_inpatient_claim_interaction
age_total_claim_interaction age_chronic_count_interaction sex_male_chronic_count_interaction sex_female_chronic_count_interaction
enrollment_months_total_claim_interaction enrollment_months_inpatient_interaction
chronic_count_age_under_65 chronic_count_age_65_74 chronic_count_age_75_84 chronic_count_age_85_plus
inpatient_claim_count outpatient_claim_count carrier_claim_count pde_claim_count outpatient_ed_claim_count
outpatient_line_count carrier_line_count rx_days_supply total_claim_days total_claim_count unique_provider_count
cost_per_enrollment_month claims_per_enrollment_month claim_days_per_enrollment_month providers_per_enrollment_month
provider_fragmentation_index inpatient_claims_per_enrollment_month outpatient_claims_per_enrollment_month
carrier_claims_per_enrollment_month rx_fills_per_enrollment_month outpatient_ed_claims_per_enrollment_month
rx_days_supply_per_enrollment_month avg_inpatient_cost_per_claim avg_outpatient_cost_per_claim avg_carrier_cost_per_claim
avg_rx_cost_per_fill outpatient_lines_per_claim carrier_lines_per_claim
any_inpatient_claim any_outpatient_claim any_carrier_claim any_pde_claim any_outpatient_ed_claim
multiple_provider_flag multi_setting_utilization_flag
rx_total_cost inpatient_total_cost outpatient_total_cost carrier_total_cost carrier_allowed_total rx_patient_pay_total
rx_cost_log1p inpatient_cost_log1p outpatient_cost_log1p carrier_cost_log1p annual_cost_log1p
inpatient_claim_count_log1p outpatient_claim_count_log1p carrier_claim_count_log1p pde_claim_count_log1p
total_claim_count_log1p unique_provider_count_log1p
annual_cost_year_percentile annual_cost_year_decile annual_cost_to_year_median has_prior_year prior_year_annual_claim_cost
prior_year_inpatient_claim_count prior_year_total_claim_count prior_year_enrollment_months_count
current_year_high_cost_indicator prior_year_high_cost_indicator two_year_avg_annual_claim_cost
cost_trend_difference cost_trend_ratio inpatient_claim_count_change total_claim_count_change
high_cost_last_2yr_count high_cost_1_of_last_2yr high_cost_2_of_last_2yr
inpatient_cost_share outpatient_cost_share carrier_cost_share rx_cost_share
"""
_CATEGORICAL = """
age_band sex race_code state_code chronic_burden_band chronic_burden_age_band age_5yr_band chronic_burden_age_5yr_band
sex_chronic_burden_band enrollment_months_band utilization_trend
"""

NUMERIC = _NUMERIC.format(chronic=" ".join(CHRONIC_FLAGS)).split()
CATEGORICAL = _CATEGORICAL.split()
ORDER = [*NUMERIC, *CATEGORICAL]

# The columns that models take as 32-bit and as 64-bit integers; other numbers are doubles.
INTS = """
enrollment_months_count full_year_enrolled_flag partial_year_enrolled_flag zero_enrollment_flag low_enrollment_flag
age_years age_missing_flag age_years_imputed age_over_65 age_over_75 age_over_85 chronic_condition_count chronic_condition_count_squared {chronic}
chronic_count_age_under_65 chronic_count_age_65_74 chronic_count_age_75_84 chronic_count_age_85_plus
annual_cost_year_decile has_prior_year prior_year_inpatient_claim_count prior_year_total_claim_count
prior_year_enrollment_months_count current_year_high_cost_indicator prior_year_high_cost_indicator
inpatient_claim_count_change total_claim_count_change high_cost_last_2yr_count high_cost_1_of_last_2yr high_cost_2_of_last_2yr
any_inpatient_claim any_outpatient_claim any_carrier_claim any_pde_claim any_outpatient_ed_claim
multiple_provider_flag multi_setting_utilization_flag
""".format(chronic=" ".join(CHRONIC_FLAGS)).split()
LONGS = """
age_squared age_inpatient_claim_interaction age_total_claim_interaction age_chronic_count_interaction
sex_male_chronic_count_interaction sex_female_chronic_count_interaction
enrollment_months_total_claim_interaction enrollment_months_inpatient_interaction
inpatient_claim_count outpatient_claim_count carrier_claim_count pde_claim_count outpatient_ed_claim_count
outpatient_line_count carrier_line_count rx_days_supply total_claim_days total_claim_count unique_provider_count
""".split()
