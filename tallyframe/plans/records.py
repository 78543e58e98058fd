"""Registered queries of the records that go with data: inventories, manifests, audits, publishing, statuses, calibration.

They are registered beside those of ``queries``, in its dictionaries.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.functions import scalars as s
from tallyframe.operators import audits, cleaning, features, labels, metrics, runs, training
from tallyframe.plans.queries import COST_LABELS, RUN, TOPK, _costs, _filled_raw, _raw_lines, _scores, _text, parquet, query, rounded
from tallyframe.plans.roles import ctes, role
from tallyframe.sources import inventory, tables
from tallyframe.sources.scratch import saved, scratch_path

# --- inventories and files ---------------------------------------------------------------------------------------


def _inventory(spark, sf_dir) -> DataFrame:
    """An inventory written as one JSON document for each region, whose files are its nations, and read back."""
    path = scratch_path(spark, "inventory")
    k, two = F.col("n_nationkey"), lambda n: F.lpad(n.cast("string"), 2, "0")
    listed = parquet(spark, sf_dir, "nation").join(parquet(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_regionkey", F.col("r_name").alias("entity"), F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit("_20"), two(k), F.lit(".csv")).alias("file_name"),
        F.when(k % 3 > 0, F.concat(F.lit("sample of 20"), two(k + 1))).otherwise("no year").alias("title"),
    )
    files = listed.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("file_name", "title", "entity"))).alias("files"))  # the nations of one region
    files.write.partitionBy("n_regionkey").json(path)
    return inventory.load_inventory(spark, path)


INVENTORY = """
with e as (select r_name entity, concat(lower(replace(n_name, ' ', '_')), '_20', lpad(n_nationkey::varchar, 2, '0'), '.csv') file_name,
    case when n_nationkey % 3 > 0 then concat('sample of 20', lpad((n_nationkey + 1)::varchar, 2, '0')) else 'no year' end title, n_nationkey from nation join region on n_regionkey = r_regionkey),
  i as (select *, row_number() over (partition by entity order by file_name) - 1 place from e)
"""


@query(INVENTORY + """select entity, place::int "position", file_name, title, (2000 + n_nationkey + (n_nationkey % 3 > 0)::int)::int as year from i""")
def inventory_entries(spark, sf_dir):
    """The files of an inventory with their position, and the first year that title or name tell."""
    return _inventory(spark, sf_dir).select("entity", "position", "file_name", "title", inventory.entry_year(["title", "file_name"]).alias("year"))


@query(INVENTORY + "select entity, count(*)::int entry_count, string_agg(file_name, '|' order by file_name) files, string_agg(title, '|' order by file_name) titles from i group by 1")
def inventory_groups(spark, sf_dir):
    """The entries of each entity."""
    grouped = inventory.grouped_entries(_inventory(spark, sf_dir))
    return grouped.select("entity", F.size("entries").alias("entry_count"), F.array_join("entries.file_name", "|").alias("files"), F.array_join("entries.title", "|").alias("titles"))


@query("""
select n_regionkey, count(*) expected_rows, sum(strlen(n_name) + 1)::bigint size, sha256(string_agg(n_name || chr(10), '' order by n_name)) sha256 from nation group by 1""")
def file_manifest(spark, sf_dir):
    """One text file of each region's nations: listed, with expected rows, size and the SHA-256 of its bytes; a listed file that is absent has no row."""
    path, nation = scratch_path(spark, "files"), parquet(spark, sf_dir, "nation")
    for r in parquet(spark, sf_dir, "region").select("r_regionkey").collect():  # the regions of the world
        nation.where(F.col("n_regionkey") == r.r_regionkey).select("n_name").coalesce(1).sortWithinPartitions("n_name").write.text(f"{path}/{r.r_regionkey}")
    found = inventory.list_files(spark, path, "part-*").select("file_name", F.element_at(F.split("path", "/"), -2).cast("int").alias("n_regionkey"))
    listed = found.join(nation.groupBy("n_regionkey").agg(F.count("*").alias("expected_rows")), "n_regionkey")
    listed = listed.unionByName(listed.select("n_regionkey", F.lit("absent").alias("file_name"), "expected_rows"))
    return inventory.manifest(spark, path, listed).select("n_regionkey", "expected_rows", "size", "sha256")


@query("""
with e as (select case when n_regionkey < 2 then 'customer' when n_regionkey < 4 then 'supplier' else 'orders' end entity, n_name from nation),
  a as (select *, row_number() over (partition by entity order by n_name) place from e), b as (select *, row_number() over (partition by entity order by n_name) place from e where strlen(n_name) > 6),
  v as (select 'customer' entity, count(*) row_count, 1500::bigint expected_row_count, true key_present, 0::bigint null_key_count, count(distinct c_custkey) distinct_key_count from customer
        union all select 'supplier', count(*), null, false, null, null from supplier)
select entity, a.n_name raw_name, b.n_name extracted_name, row_count, expected_row_count, key_present, null_key_count, distinct_key_count from a left join b using (entity, place) left join v using (entity)""")
def file_audit_rows(spark, sf_dir):
    """Raw and extracted names of each entity in pairs, with the entity's validation: one has its key, one lacks it, one was not validated."""
    entity = F.when(F.col("n_regionkey") < 2, "customer").when(F.col("n_regionkey") < 4, "supplier").otherwise("orders").alias("entity")
    nation = parquet(spark, sf_dir, "nation").select(entity, "n_name", F.when(F.length("n_name") > 6, F.col("n_name")).alias("extracted"))
    names = lambda c, to: F.sort_array(F.collect_list(c)).alias(to)
    entries = nation.groupBy("entity").agg(names("n_name", "raw_names"), names("extracted", "extracted_names"))
    checked = {"customer": ("c_custkey", 1_500), "supplier": ("absent_key", None)}
    validation = reduce(DataFrame.unionByName, (cleaning.raw_validation(parquet(spark, sf_dir, t), *of).withColumn("entity", F.lit(t)) for t, of in checked.items()))
    return inventory.audit_rows(entries, validation)


# --- typed rows and their audits -----------------------------------------------------------------------------------


@query("""
with r as (select o_orderkey::varchar pde_id, case when o_orderkey % 7 > 0 then o_custkey::varchar end bene_id, (o_orderkey % 30)::int days_supply, case when o_orderkey % 11 > 0 then o_orderdate::date end d from orders)
select pde_id, sha256(concat_ws('||', coalesce(bene_id, '__NULL__'), days_supply::varchar, coalesce(strftime(d, '%Y-%m-%d'), '__NULL__'), pde_id, coalesce(year(d)::varchar, '__NULL__'))) row_hash,
  'orders' _silver_source_table, true processed, 'sample.csv' _bronze_source_file from r""")
def row_metadata(spark, sf_dir):
    """Hashes of typed rows, in which neither lineage nor processing counts, and these columns."""
    k = F.col("o_orderkey")
    raw = _filled_raw(parquet(spark, sf_dir, "orders"), "prescription_drug_events", {
        "PDE_ID": _text("o_orderkey"), "DESYNPUF_ID": F.when(k % 7 > 0, _text("o_custkey")).otherwise(" "), "SRVC_DT": F.when(k % 11 > 0, F.date_format("o_orderdate", "yyyyMMdd")), "DAYS_SUPLY_NUM": (k % 30).cast("string"),
    })
    made = cleaning.typed(raw, "prescription_drug_events", "orders").select("pde_id", "bene_id", "drug_fill_date", "days_supply", "year", "_bronze_source_file", "_silver_source_table", "_silver_processed_at_utc")
    return made.select("pde_id", s.row_hash(made.columns).alias("row_hash"), "_silver_source_table", F.col("_silver_processed_at_utc").isNotNull().alias("processed"), "_bronze_source_file")


@query("""
with d as (select count(*) n, count(distinct l_orderkey) kept from lineitem), i as (select count(*) n, count(*) filter (l_orderkey % 37 = 0) no_date, count(*) filter (l_orderkey % 37 = 0 or l_orderkey % 50 = 0) no_key, sum((l_orderkey % 31 = 0)::int + (l_orderkey % 29 = 0)::int)::bigint unread from lineitem)
select 'prescription_drug_events' entity, 'published' status, '' failed, n rows_in, n - kept rows_removed, 0::bigint null_year_count, 0::bigint null_key_count, 0::bigint parse_failure_count from d
union all select 'inpatient_claims', 'failed', concat_ws(',', case when no_date > 0 then 'null_year_count' end, case when no_key > 0 then 'null_key_count' end, case when unread > 0 then 'parse_failure_count' end), n, null, no_date, no_key, unread from i""")
def entity_audits(spark, sf_dir):
    """Audit rows of two entities typed from raw rows: one is published with the latest row of each key, one fails its gate."""
    drugs = _filled_raw(parquet(spark, sf_dir, "lineitem"), "prescription_drug_events", {"PDE_ID": _text("l_orderkey"), "DESYNPUF_ID": F.lit("b"), "SRVC_DT": F.lit("20080515"), "QTY_DSPNSD_NUM": _text("l_quantity")})
    lines = saved(cleaning.typed(_raw_lines(spark, sf_dir), "inpatient_claims"), "typed")
    events, keys = saved(cleaning.typed(drugs, "prescription_drug_events"), "typed"), cleaning.ENTITIES["prescription_drug_events"].keys
    n_events, n_lines = events.count(), lines.count()
    latest = saved(cleaning.latest_rows(cleaning.dealt(cleaning.with_keys(events, keys), keys, n_events), keys), "latest")
    n_latest = latest.count()
    published = cleaning.audit(cleaning.quality(cleaning.dealt(latest, keys, n_latest), "prescription_drug_events"), "prescription_drug_events", "run1", n_events, n_latest)
    lines = cleaning.dealt(lines, cleaning.ENTITIES["inpatient_claims"].keys, n_lines)
    failed = cleaning.audit(cleaning.quality(lines, "inpatient_claims"), "inpatient_claims", "run1", n_lines, None)
    return published.unionByName(failed).select("entity", "status", "failed", "rows_in", "rows_removed", "null_year_count", "null_key_count", "parse_failure_count")


@query("""
with b as (select bene_id, year, (year - year(birth_date))::int age_years from beneficiaries)
select bene_id, year, age_years, case when age_years is null then 'unknown' when age_years < 65 then 'under_65' when age_years < 75 then '65_74' when age_years < 85 then '75_84' else '85_plus' end age_band,
  case when age_years is null then 'unknown' when age_years + 20 < 65 then 'under_65' when age_years + 20 >= 90 then '90_plus' else concat(65 + (age_years + 20 - 65) // 5 * 5, '_', 69 + (age_years + 20 - 65) // 5 * 5) end age_5yr_band_later from b""", ("beneficiaries",))
def age_bands(spark, sf_dir):
    """Age at the end of the year, its band, and the five-year band of twenty years later."""
    aged = role(spark, sf_dir, "beneficiaries").select("bene_id", "year", s.age_at_year_end("year", "birth_date").alias("age_years"))
    return aged.withColumns({"age_band": s.age_band("age_years"), "age_5yr_band_later": s.age_5yr_band(F.col("age_years") + 20)})


@query("""
with w as (select l_linenumber tax_flag, l_quantity hi_coverage_months, l_discount * 20 cost_share, l_quantity * 3 age_years, l_extendedprice - 40000 other_cost_total, l_extendedprice - 40000 cost_change from lineitem)
select c feature_name, count(*) row_count, (case c when 'tax_flag' then count(*) filter (tax_flag not in (0, 1)) when 'hi_coverage_months' then count(*) filter (hi_coverage_months not between 0 and 12) when 'cost_share' then count(*) filter (cost_share not between 0 and 1)
  when 'age_years' then count(*) filter (age_years not between 0 and 115) when 'other_cost_total' then count(*) filter (other_cost_total < 0) else 0 end)::bigint impossible_value_count
from w, (select unnest(['tax_flag', 'hi_coverage_months', 'cost_share', 'age_years', 'other_cost_total', 'cost_change']) c) group by 1""")
def impossible_values(spark, sf_dir):
    """Values that cannot be by their columns' names: flags, months, shares, ages, totals; changes may be below zero."""
    made = {"tax_flag": F.col("l_linenumber"), "hi_coverage_months": F.col("l_quantity"), "cost_share": F.col("l_discount") * 20, "age_years": F.col("l_quantity") * 3, "other_cost_total": F.col("l_extendedprice") - 40_000, "cost_change": F.col("l_extendedprice") - 40_000}
    rows = parquet(spark, sf_dir, "lineitem").select(*(c.alias(n) for n, c in made.items()))
    return audits.feature_quality(rows, list(made), []).select("feature_name", "row_count", "impossible_value_count")


# --- publishing ------------------------------------------------------------------------------------------------


@query("""
with n as (select count(*) n from customer)
select 'sound' run_id, 'succeeded' status, null reason, n published_rows, 'features-1' feature_version, 'customer' source from n
union all select 'repeated', 'failed_qc', 'duplicate_bene_year_count', 0, null, null
union all select 'unread', 'failed_runtime', 'ValueError: missing columns: absent', 0, null, null
union all select 'unaudited', 'published_audit_failed', 'OSError: no audit', n, 'features-1', 'customer' from n""")
def publishing_outcomes(spark, sf_dir):
    """A table published, one with repeated keys, one that cannot be built, and one whose audit could not be written: the audit, and what is in the catalog."""
    made = {"enrollment_months_count": F.lit(12), "chronic_condition_count": F.col("c_nationkey") % 12} | {c: F.abs("c_acctbal") for c in features.COSTS.values()}
    rows = parquet(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("bene_id"), (F.col("c_nationkey") % 3 + 2000).alias("year"), *(c.alias(n) for n, c in made.items()))
    mark = uuid.uuid4().hex
    audit_name, facts = f"tallyframe_audit_{mark}", []
    builds = {"sound": lambda: rows, "repeated": lambda: rows.unionByName(rows), "unread": lambda: tables.require_columns(rows, ["absent"]), "unaudited": lambda: rows}
    for run_id, build in builds.items():
        name = f"tallyframe_{run_id}_{mark}"

        def leave(row: DataFrame, run_id: str = run_id) -> None:
            if run_id == "unaudited" and row.first().status == "succeeded":
                raise OSError("no audit")
            tables.write_table(row, audit_name, "append")

        try:
            tables.publish_with_audit(spark, run_id, build, lambda df: features.table_quality(df).first().blocking, lambda df, name=name: tables.publish_features(df, name, features.FEATURE_VERSION, "customer", "query"), leave)
        except (ValueError, OSError):
            pass  # the audit tells
        there = spark.catalog.tableExists(name)
        count = spark.table(name).agg(F.count("*").alias("published_rows")) if there else spark.createDataFrame([(0,)], "published_rows long")
        stored = {c: F.lit(tables.table_property(spark, name, c) if there else None).cast("string") for c in ("feature_version", "source")}
        facts.append(count.withColumns({"run_id": F.lit(run_id), **stored}))
    return tables.read_table(spark, audit_name, ["run_id", "status"]).select("run_id", "status", "reason").join(reduce(DataFrame.unionByName, facts), "run_id")


# --- labels, statuses, curves, calibration -----------------------------------------------------------------------


@query(COST_LABELS + """select bene_id, year, split_name, target_cost target_annual_claim_cost, "label"::double "label" from y""", ("claims", "activity"))
def labelled_audit_frame(spark, sf_dir):
    """All splits with the label by the training rows' threshold."""
    frame = labels.assign_split(labels.next_year(_costs(spark, sf_dir)), bucket=labels.md5_bucket)
    return labels.labelled_splits(frame, exact=True).select("bene_id", "year", "split_name", "target_annual_claim_cost", "label")


@query("""
with c as (select case when l_discount * 3 >= 0.25 then 'review_required' when l_discount * 3 >= 0.1 then 'monitor' else 'stable' end drift, case when l_discount >= 0.05 then 'review_required' when l_discount >= 0.02 then 'warning' else 'acceptable' end gap,
    case when l_discount <= 0 then 'insufficient_baseline' when (l_discount - l_tax) / nullif(l_discount, 0) > 0.2 then 'review_required' when (l_discount - l_tax) / nullif(l_discount, 0) >= 0.1 then 'warning' else 'acceptable' end capture from lineitem)
select drift, gap, capture, count(*) row_count from c group by 1, 2, 3""")
def status_bands(spark, sf_dir):
    """Statuses of drift, of gaps between prediction and rate, and of capture that fell from a baseline."""
    made = {"drift": s.drift_status(F.col("l_discount") * 3), "gap": s.gap_status("l_discount"), "capture": s.capture_status("l_discount", "l_tax")}
    return parquet(spark, sf_dir, "lineitem").groupBy(*(c.alias(n) for n, c in made.items())).agg(F.count("*").alias("row_count"))


@query(f"""
with scores as (select * from ({ctes("scores")} select * from scores) where run_id = 'run1' and split_name = 'test'), c as ({TOPK.format(fractions=str([f"{i / 100}::double" for i in range(1, 21)]).replace("'", ""))})
select row_number() over (order by model_name, selected_fraction) place, model_name, selected_fraction, selected_count, captured_positive_count, capture_rate from c""")
def selected_curve_extract(spark, sf_dir):
    """The curves of selected runs on test rows, written as ordered JSON files and read back in the order of files and lines."""
    scores, path = _scores(spark, sf_dir), scratch_path(spark, "extract")
    curve = metrics.curve(scores, [*RUN, "run_id"], "id")
    chosen = runs.selected_curve(curve, scores.select("model_name", F.lit("run1").alias("run_id")).distinct())
    tables.extract(rounded(chosen.select("model_name", "selected_fraction", "selected_count", "captured_positive_count", "capture_rate"), 9), ["model_name", "selected_fraction"], path)
    read = spark.read.schema("model_name string, selected_fraction double, selected_count long, captured_positive_count long, capture_rate double").json(path)
    lines = read.withColumns({"_file": F.col("_metadata.file_name"), "_line": F.monotonically_increasing_id()})
    return lines.withColumn("place", F.row_number().over(W.orderBy("_file", "_line")).cast("long")).drop("_file", "_line")  # twenty rows for each model


@query("""
select m.method, model_name, count(*) row_count, round(sum("label"), 2) expected, round(sum("label"), 2) positive_count, true in_range, true in_order
from scores, (select unnest(['isotonic', 'sigmoid']) m) m(method) where split_name = 'validation' and model_name in ('1-URGENT', '3-MEDIUM') group by 1, 2""", ("scores",))
def calibration_balance(spark, sf_dir):
    """Probabilities calibrated either way add up to the positives of the rows they were fitted on, and keep the order of scores (a sigmoid
    may turn it round, where higher scores have fewer positives)."""
    out = []
    for model in ("1-URGENT", "3-MEDIUM"):
        rows = _scores(spark, sf_dir).where((F.col("split_name") == "validation") & (F.col("model_name") == model)).withColumn("raw", F.col("predicted_probability"))
        for method in ("isotonic", "sigmoid"):
            made = training.calibrate(rows, rows, method)
            by_score = made.groupBy("raw").agg(F.min("predicted_probability").alias("low"), F.max("predicted_probability").alias("high"), F.sum("predicted_probability").alias("expected"), F.sum("label").alias("positives"), F.count("*").alias("n"))
            before = F.lag("high").over(W.orderBy("raw"))  # scores are rounded: some hundred of them
            steps = by_score.withColumn("step", F.coalesce(F.col("low") - before, F.lit(0.0)))
            falls, rises = F.min("step") < -1e-12, F.max("step") > 1e-12
            out.append(steps.agg(
                F.lit(method).alias("method"), F.lit(model).alias("model_name"), F.sum("n").alias("row_count"), F.round(F.sum("expected"), 2).alias("expected"), F.sum("positives").alias("positive_count"),
                F.min((F.col("low") >= 0) & (F.col("high") <= 1)).alias("in_range"), (~falls | (F.lit(method == "sigmoid") & ~rises)).alias("in_order"),
            ))
    return reduce(DataFrame.unionByName, out)
