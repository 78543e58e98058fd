"""Claims entities taken from the supplied sales tables. Each role is SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

ROLES = {
    "order_lines": """
        select l_orderkey, count(*) n_lines, min(l_suppkey) supp, sum(l_quantity) qty from {lineitem} group by l_orderkey""",
    "claims": """
        select cast(o_orderkey as string) claim_id, cast(o_custkey as string) bene_id, cast(year(o_orderdate) as int) as year,
               case o_orderpriority when '1-URGENT' then 'inpatient' when '2-HIGH' then 'outpatient' when '3-MEDIUM' then 'carrier' else 'pde' end setting,
               o_totalprice payment_amount, cast(day(o_orderdate) % 10 as int) claim_days, cast(coalesce(n_lines, 0) as int) estimated_line_count,
               cast(supp as string) provider_id, o_orderstatus = 'F' emergency_department_claim_flag, round(o_totalprice * 1.25, 2) allowed_amount, round(o_totalprice * 0.2, 2) patient_pay_amount
        from {orders} left join {order_lines} on l_orderkey = o_orderkey""",
    "years": "select distinct cast(year(o_orderdate) as int) as year from {orders}",
    "activity": """
        select cast(o_custkey as string) bene_id, cast(year(o_orderdate) as int) as year, cast(count(distinct month(o_orderdate)) as int) n_months,
               cast(least(11, count(distinct l_partkey % 25)) as int) chronic
        from {orders} left join {lineitem} on l_orderkey = o_orderkey group by 1, 2""",
    "beneficiaries": """
        select cast(c_custkey as string) bene_id, y.year,
               case when c_custkey % 17 <> 0 then make_date(cast(1925 + c_custkey % 50 as int), cast(1 + c_custkey % 12 as int), cast(1 + c_custkey % 28 as int)) end birth_date,
               case c_custkey % 3 when 0 then 'male' when 1 then 'female' else 'unknown' end sex, cast(c_custkey % 5 as string) race_code, cast(c_nationkey as string) state_code,
               n_months hi_coverage_months, cast(null as int) smi_coverage_months, cast(0 as int) hmo_coverage_months, cast(c_custkey % 3 as int) plan_coverage_months,
               cast(coalesce(chronic, 0) as int) chronic_condition_count, c_custkey % 2 = 0 diabetes_flag, c_custkey % 7 = 0 cancer_flag
        from {customer} c cross join {years} y left join {activity} a on a.bene_id = cast(c_custkey as string) and a.year = y.year""",
    "scores": """
        select cast(o_orderkey as string) id, o_orderpriority model_name, concat('run', cast(o_custkey % 2 as string)) run_id,
               case when o_custkey % 10 < 2 then 'test' when o_custkey % 10 < 4 then 'validation' else 'train' end split_name,
               cast(case when o_orderstatus = 'F' then 1 else 0 end as double) label, round(o_totalprice / 500000, 2) predicted_probability
        from {orders}""",
    "audit": """
        select event_type model_name, concat('run', cast(user_id as string)) run_id, case event_id % 3 when 0 then 'test' when 1 then 'validation' else 'train' end split_name,
               ts processed_at_utc, value / 1000 accuracy, value / 500 brier_score, value / 300 area_under_pr from {events}""",
}

#: What Spark reads in place of a part of a role, with the same rows. Its round() takes a double's shortest decimal, so it rounds
#: 0.285 up, where DuckDB rounds 100 times the value and divides. Distinct months and parts are bits of a number, one bit for each
#: value: all are combined by one aggregation before their shuffle, where distinct counts would send each line twice.
IN_SPARK = {
    "scores": [("round(o_totalprice / 500000, 2)", "round(o_totalprice / 500000 * 100) / 100")],
    "order_lines": [("sum(l_quantity) qty", "sum(l_quantity) qty, bit_or(shiftleft(1L, cast(l_partkey % 25 + 24 as int))) parts")],
    "activity": [
        ("count(distinct month(o_orderdate))", "coalesce(bit_count(bit_or(shiftleft(1, month(o_orderdate)))), 0)"),
        ("count(distinct l_partkey % 25)", "coalesce(bit_count(bit_or(parts)), 0)"),
        ("{lineitem}", "{order_lines}"),
    ],
}


def _in_spark(name: str) -> str:
    text = ROLES[name]
    for old, new in IN_SPARK.get(name, []):
        text = text.replace(old, new)
    return text


@cache
def _needs(name: str, text: Callable[[str], str] = ROLES.get) -> tuple[str, ...]:
    """The roles that a role is made of, in order, itself last."""
    out: list[str] = []
    for other in ROLES:
        if "{" + other + "}" in text(name):
            out += [x for x in _needs(other, text) if x not in out]
    return (*out, name)


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frames: dict[str, DataFrame] = {}
    for n in _needs(name, _in_spark):
        text = _in_spark(n)
        for t in (*TABLES, *ROLES):
            if "{" + t + "}" in text and t not in frames:
                frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        frames[n] = spark.sql(text, **{k: v for k, v in frames.items() if "{" + k + "}" in text})
    return frames[name]


def ctes(*names: str) -> str:
    """``with`` clause that defines roles for DuckDB."""
    order: list[str] = []
    for n in names:
        order += [x for x in _needs(n) if x not in order]
    plain = lambda text: text.format(**{t: t for t in (*TABLES, *ROLES)})
    return "with " + ",\n".join(f"{n} as ({plain(ROLES[n])})" for n in order)
