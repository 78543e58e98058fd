"""Where the filter on typed keys is evaluated."""

from pyspark.sql import functions as F

from tallyframe.operators import cleaning


def test_key_filter_stays_above_the_typing_projection(spark):
    """The filter reads typed columns and does not type them once more; its rows are those of dropna."""
    e = cleaning.ENTITIES["inpatient_claims"]
    names = sorted({*e.text.values(), *e.dates.values(), *e.ints.values(), *e.doubles.values(), *e.unlisted})
    k = F.col("id")
    made = {"CLM_ID": k.cast("string"), "DESYNPUF_ID": F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), k.cast("string"))), "SEGMENT": F.when(k % 7 > 0, "1"), "CLM_THRU_DT": F.when(k % 3 == 0, "20081340").otherwise(F.date_format(F.date_add(F.lit("2008-01-01"), k.cast("int")), "yyyyMMdd"))}
    raw = spark.range(200).select(*(made.get(n, F.lit(None).cast("string")).alias(n) for n in names), F.lit("a").alias("_bronze_source_file"), F.lit("2009-01-01").cast("timestamp").alias("_bronze_loaded_at_utc"))
    typed = cleaning.typed(raw, "inpatient_claims")
    kept = cleaning.with_keys(typed, e.keys)
    assert kept.columns == typed.columns
    assert sorted(r.claim_id for r in kept.collect()) == sorted(str(i) for i in range(200) if i % 5 and i % 7 and i % 3)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"isnotnull({key}#" in plan for key in e.keys)
