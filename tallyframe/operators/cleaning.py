"""Typed entities from raw strings: declared columns, parse-failure counts, quality gates and latest-row deduplication."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.functions import scalars as s

# The entities' raw columns, and what is made of each.
CHRONIC_FLAGS = {
    "alzheimers_flag": "SP_ALZHDMTA",
    "chf_flag": "SP_CHF",
    "chronic_kidney_disease_flag": "SP_CHRNKIDN",
    "cancer_flag": "SP_CNCR",
    "copd_flag": "SP_COPD",
    "depression_flag": "SP_DEPRESSN",
    "diabetes_flag": "SP_DIABETES",
    "ischemic_heart_disease_flag": "SP_ISCHMCHT",
    "osteoporosis_flag": "SP_OSTEOPRS",
    "rheumatoid_arthritis_oa_flag": "SP_RA_OA",
    "stroke_tia_flag": "SP_STRKETIA",
}
COVERAGE = {"hi_coverage_months": "BENE_HI_CVRAGE_TOT_MONS", "smi_coverage_months": "BENE_SMI_CVRAGE_TOT_MONS", "hmo_coverage_months": "BENE_HMO_CVRAGE_TOT_MONS", "plan_coverage_months": "PLAN_CVRG_MOS_NUM"}
_SIDES = {"inpatient": "IP", "outpatient": "OP", "carrier": "CAR"}
_PAYERS = {"reimbursement": "MEDREIMB", "responsibility": "BENRES", "primary_payer": "PPPYMT"}
PROCEDURES, LINES = 45, 13
#: Rows of wide tables that one task sorts or groups.
ROWS_OF_A_TASK = 1_250_000


@dataclass(frozen=True)
class Entity:
    """text, dates, ints, doubles: output column to raw column. kept: ints and doubles that stay below zero too."""

    keys: tuple[str, ...]
    text: dict[str, str]
    dates: dict[str, str] = field(default_factory=dict)
    ints: dict[str, str] = field(default_factory=dict)
    doubles: dict[str, str] = field(default_factory=dict)
    kept: bool = False
    order: tuple[tuple[str, str], ...] = (("claim_from_date", "claim_thru_date"),)
    unlisted: dict[str, str] = field(default_factory=dict)  # further raw columns whose parse failures count: raw column to kind
    ranges: dict[str, tuple[int, int]] = field(default_factory=dict)


_CLAIM = {"claim_id": "CLM_ID", "bene_id": "DESYNPUF_ID"}
_CLAIM_DATES = {"claim_from_date": "CLM_FROM_DT", "claim_thru_date": "CLM_THRU_DT"}
ENTITIES = {
    "beneficiary_summary": Entity(
        ("bene_id", "year"),
        {"bene_id": "DESYNPUF_ID", "race_code": "BENE_RACE_CD", "state_code": "SP_STATE_CODE", "county_code": "BENE_COUNTY_CD"},
        {"birth_date": "BENE_BIRTH_DT", "death_date": "BENE_DEATH_DT"},
        {"sex_code": "BENE_SEX_IDENT_CD"} | COVERAGE,
        {f"beneficiary_{side}_{what}_amt": f"{raw}_{end}" for what, raw in _PAYERS.items() for side, end in _SIDES.items()},
        kept=True, order=(("birth_date", "death_date"),), ranges={c: (0, 12) for c in COVERAGE},
    ),
    "inpatient_claims": Entity(
        ("claim_id", "bene_id", "year", "claim_segment"),
        _CLAIM | {"provider_id": "PRVDR_NUM", "drg_code": "CLM_DRG_CD", "admitting_diagnosis_code": "ADMTNG_ICD9_DGNS_CD"},
        _CLAIM_DATES | {"admit_date": "CLM_ADMSN_DT", "discharge_date": "NCH_BENE_DSCHRG_DT"},
        {"claim_days": "CLM_UTLZTN_DAY_CNT"},
        {"payment_amount": "CLM_PMT_AMT", "primary_payer_paid_amount": "NCH_PRMRY_PYR_CLM_PD_AMT", "pass_through_per_diem_amount": "CLM_PASS_THRU_PER_DIEM_AMT", "beneficiary_deductible_amount": "NCH_BENE_IP_DDCTBL_AMT", "beneficiary_coinsurance_amount": "NCH_BENE_PTA_COINSRNC_LBLTY_AM", "beneficiary_blood_deductible_amount": "NCH_BENE_BLOOD_DDCTBL_LBLTY_AM"},
        order=(("claim_from_date", "claim_thru_date"), ("admit_date", "discharge_date")), unlisted={"SEGMENT": "int"},
    ),
    "outpatient_claims": Entity(
        ("claim_id", "bene_id", "year", "claim_segment"),
        _CLAIM | {"provider_id": "PRVDR_NUM", "admitting_diagnosis_code": "ADMTNG_ICD9_DGNS_CD"},
        _CLAIM_DATES, {},
        {"payment_amount": "CLM_PMT_AMT", "primary_payer_paid_amount": "NCH_PRMRY_PYR_CLM_PD_AMT", "beneficiary_deductible_amount": "NCH_BENE_PTB_DDCTBL_AMT", "beneficiary_coinsurance_amount": "NCH_BENE_PTB_COINSRNC_AMT", "beneficiary_blood_deductible_amount": "NCH_BENE_BLOOD_DDCTBL_LBLTY_AM"},
        unlisted={"SEGMENT": "int"},
    ),
    "carrier_claims": Entity(
        ("claim_id", "bene_id", "year"), _CLAIM, _CLAIM_DATES,
        unlisted={f"{c}_{i}": "double" for c in ("LINE_NCH_PMT_AMT", "LINE_ALOWD_CHRG_AMT") for i in range(1, LINES + 1)},
    ),
    "prescription_drug_events": Entity(
        ("pde_id", "bene_id", "year"),
        {"pde_id": "PDE_ID", "bene_id": "DESYNPUF_ID", "product_service_id": "PROD_SRVC_ID"},
        {"drug_fill_date": "SRVC_DT"}, {"days_supply": "DAYS_SUPLY_NUM"},
        {"quantity_dispensed": "QTY_DSPNSD_NUM", "patient_pay_amount": "PTNT_PAY_AMT", "drug_cost": "TOT_RX_CST_AMT"}, order=(),
    ),
}


def _numbered(name: str, n: int) -> list[str]:
    return [f"{name}_{i}" for i in range(1, n + 1)]


def _extra(entity: str) -> dict[str, Column]:
    """Columns that are more than one parsed raw column."""
    start, end = s.to_date("CLM_FROM_DT"), s.to_date("CLM_THRU_DT")
    if entity == "beneficiary_summary":
        flags = {name: s.yes_no(raw) for name, raw in CHRONIC_FLAGS.items()}
        return {"year": F.col("_bronze_source_year").cast("int"), "sex": s.sex("BENE_SEX_IDENT_CD"), "esrd_flag": s.yes_no("BENE_ESRD_IND"), **flags, "chronic_condition_count": s.row_count(flags.values()), "death_flag": s.to_date("BENE_DEATH_DT").isNotNull()}
    if entity == "inpatient_claims":
        return {"claim_segment": s.to_int("SEGMENT"), "year": F.year(end)}
    if entity == "outpatient_claims":
        codes = _numbered("HCPCS_CD", PROCEDURES)
        return {
            "claim_segment": s.to_int("SEGMENT"), "hcpcs_codes": s.distinct_filled(codes), "estimated_line_count": s.filled_count(codes), "emergency_department_claim_flag": s.any_in(codes, s.EMERGENCY_CODES),
            "claim_days": s.day_span(start, end), "claim_dates_valid": s.dates_in_order(start, end), "year": F.year(end),
        }
    if entity == "carrier_claims":
        npi, paid = _numbered("PRF_PHYSN_NPI", LINES), _numbered("LINE_NCH_PMT_AMT", LINES)
        return {
            "provider_id": s.first_filled(npi), "provider_ids": s.distinct_filled(npi), "estimated_line_count": F.greatest(s.filled_count(_numbered("HCPCS_CD", LINES)), s.filled_count(paid)),
            "payment_amount": s.row_sum(paid), "allowed_amount": s.row_sum(_numbered("LINE_ALOWD_CHRG_AMT", LINES)), "year": F.year(end),
        }
    return {"year": F.year(s.to_date("SRVC_DT"))}


def typed(raw: DataFrame, entity: str, source: str = "") -> DataFrame:
    """The raw rows of an entity with typed columns, ``_parse_failure_count`` and lineage. One projection, no shuffle."""
    e = ENTITIES[entity]
    as_int, as_double = (s.to_int, s.to_double) if e.kept else (s.int_at_least_zero, s.double_at_least_zero)
    columns = {n: s.blank_to_null(r) for n, r in e.text.items()} | {n: s.to_date(r) for n, r in e.dates.items()}
    columns |= {n: as_int(r) for n, r in e.ints.items()} | {n: as_double(r) for n, r in e.doubles.items()} | _extra(entity)
    kinds = {r: "date" for r in e.dates.values()} | {r: "int" for r in e.ints.values()} | {r: "double" for r in e.doubles.values()} | e.unlisted
    columns["_parse_failure_count"] = s.row_count(s.parse_failed(r, kind) for r, kind in kinds.items())
    lineage = {c: F.col(c) for c in ("_bronze_source_file", "_bronze_loaded_at_utc")}
    made = {"_silver_source_table": F.lit(source or entity), "_silver_processed_at_utc": F.current_timestamp()}
    return raw.select(*(c.alias(n) for n, c in (columns | lineage | made).items()))


def with_keys(df: DataFrame, keys: tuple[str, ...] | list[str]) -> DataFrame:
    """The rows whose keys are all filled.

    The rows are numbered first, as a filter is not moved below a projection that numbers them: moved into the one that types the raw
    columns, it makes their generated method larger than the 8,000 bytes up to which the JVM compiles methods.
    """
    numbered = df.withColumn("_place", F.monotonically_increasing_id())
    return numbered.where(reduce(and_, (F.col(k).isNotNull() for k in keys), F.col("_place") >= 0)).drop("_place")


def dealt(df: DataFrame, keys: tuple[str, ...] | list[str], rows: int) -> DataFrame:
    """``df`` dealt out by key into tasks of about ROWS_OF_A_TASK of its ``rows``, so that what a task holds does not grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_OF_A_TASK)), *keys)


def latest_rows(df: DataFrame, keys: tuple[str, ...] | list[str]) -> DataFrame:
    """One row for each key: latest load, then last file name, then largest row hash.

    Rows are hashed only where several of a key share the load and the file.
    """
    own = W.partitionBy(*keys)
    last = own.orderBy(F.col("_bronze_loaded_at_utc").desc_nulls_last(), F.col("_bronze_source_file").desc_nulls_last())
    top = df.withColumn("_n", F.rank().over(last)).where("_n = 1").withColumn("_n", F.count("*").over(own))
    ranked = top.withColumn("_row_hash", F.when(F.col("_n") > 1, s.row_hash(df.columns))).withColumn("_n", F.row_number().over(own.orderBy(F.desc("_row_hash"))))
    return ranked.where("_n = 1").drop("_row_hash", "_n")


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def _number(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def quality(df: DataFrame, entity: str) -> DataFrame:
    """One row of counts, from one pass that groups by key first (so no key set is held anywhere)."""
    e = ENTITIES[entity]
    wrong_range = [F.col(a) > F.col(b) for a, b in e.order] + [(F.col(c) < low) | (F.col(c) > high) for c, (low, high) in e.ranges.items()]
    wrong_range += [F.col(c) < 0 for c in ("claim_days", "days_supply") if c in e.ints]
    amounts = [*e.doubles, *(["payment_amount", "allowed_amount"] if entity == "carrier_claims" else [])]
    counts = {
        "row_count": F.count("*"), "null_year_count": _number(F.col("year").isNull()), "null_key_count": _number(_any([F.col(k).isNull() for k in e.keys])), "invalid_range_count": _number(_any(wrong_range)),
        "negative_amount_count": _number(_any([F.col(c) < 0 for c in amounts])), "parse_failure_count": F.coalesce(F.sum("_parse_failure_count"), F.lit(0)),
    }
    by_key = df.groupBy(*e.keys).agg(*(c.alias(n) for n, c in counts.items()))
    return by_key.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts), (F.coalesce(F.sum("row_count"), F.lit(0)) - F.count("*")).alias("duplicate_key_count"))


FATAL = ("null_year_count", "null_key_count", "invalid_range_count", "parse_failure_count")


def gate(metrics: DataFrame, fatal: tuple[str, ...] = FATAL) -> DataFrame:
    """The metrics with ``failed`` (names of fatal counts above 0) and ``status``."""
    failed = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.lit(c)) for c in fatal)))
    return metrics.withColumn("failed", F.array_join(failed, ",")).withColumn("status", F.when(F.col("failed") == "", "published").otherwise("failed"))


def enforce(metrics: DataFrame, entity: str) -> dict:
    row = gate(metrics).first().asDict()
    if row["failed"]:
        raise ValueError(f"{entity} is not published: {', '.join(f'{c} {row[c]}' for c in row['failed'].split(','))}")
    return row


def raw_validation(df: DataFrame, key: str, expected_rows: int | None) -> DataFrame:
    """Rows against what was expected, whether the key column is there, null and distinct keys. Recorded, not enforced."""
    if key not in df.columns:
        return df.agg(F.count("*").alias("row_count"), F.lit(expected_rows).cast("long").alias("expected_row_count"), F.lit(False).alias("key_present"), F.lit(None).cast("long").alias("null_key_count"), F.lit(None).cast("long").alias("distinct_key_count"))
    return df.agg(F.count("*").alias("row_count"), F.lit(expected_rows).cast("long").alias("expected_row_count"), F.lit(True).alias("key_present"), _number(s.blank_to_null(key).isNull()).alias("null_key_count"), F.count_distinct(s.blank_to_null(key)).alias("distinct_key_count"))


def audit(metrics: DataFrame, entity: str, run_id: str, rows_in: int, rows_out: int | None) -> DataFrame:
    """The gate's row with what was read, and what was removed where it was published."""
    out = gate(metrics).withColumns({"entity": F.lit(entity), "run_id": F.lit(run_id), "rows_in": F.lit(rows_in).cast("long"), "processed_at_utc": F.current_timestamp()})
    return out.withColumn("rows_removed", F.when(F.col("status") == "published", F.lit(rows_in) - F.lit(rows_out)).cast("long"))
