import math

import pytest

from tallyframe.operators import cleaning, features, labels, metrics, runs, scoring, training
from tallyframe.sources import inventory, tables

SCORES = "m string, id int, label double, predicted_probability double"


def test_classification_and_top_k(spark):
    rows = [("a", i, y, p) for i, (y, p) in enumerate(zip([0.0, 0.0, 1.0, 1.0, 1.0], [0.05, 0.2, 0.6, 0.8, 0.9], strict=True))]
    df = spark.createDataFrame(rows, SCORES)
    m = metrics.classification(df, 0.5, ["m"]).first()
    assert (m.precision, m.recall, m.accuracy) == (1.0, 1.0, 1.0)
    t = metrics.top_k(df, [0.4], ["m"], "id").first()
    assert (t.selected_count, t.captured_positive_count) == (2, 2)
    assert t.lift_at_k > 1


def test_top_k_with_ties_and_no_positives(spark):
    df = spark.createDataFrame([("a", i, 0.0, 0.5) for i in range(7)], SCORES)
    t = metrics.top_k(df, [0.01, 0.5, 1.0], ["m"], "id").orderBy("selected_fraction").collect()
    assert [(r.selected_count, r.capture_rate, r.lift_at_k) for r in t] == [(1, 0.0, 0.0), (4, 0.0, 0.0), (7, 0.0, 0.0)]
    assert metrics.top_k(df.limit(0), [0.1], ["m"], "id").count() == 0


def test_areas_with_ties_and_one_class(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 0.9), ("a", 2, 0.0, 0.5), ("a", 3, 1.0, 0.5), ("a", 4, 0.0, 0.1), ("b", 5, 1.0, 0.3)], SCORES)
    got = {r.m: r for r in metrics.auc(df, ["m"]).collect()}
    assert got["a"].roc_auc == pytest.approx(0.875)
    assert got["a"].pr_auc == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert got["b"].roc_auc is None


@pytest.mark.parametrize("n", [1, 10, 11, 23, 100])
def test_deciles_are_quantile_cuts(spark, n):
    import pandas as pd

    df = spark.createDataFrame([("a", i, 0.0, i / 1000) for i in range(n)], SCORES)
    got = [r.score_decile for r in metrics.score_deciles(df, ["m"], "id", False).orderBy("id").collect()]
    assert got == [1] if n == 1 else got == (pd.qcut(pd.Series(range(n)).rank(method="first"), q=10, labels=False) + 1).tolist()


def test_reliability_bins_are_closed_to_the_right(spark):
    df = spark.createDataFrame([("a", i, 0.0, p) for i, p in enumerate([0.0, 0.1, 0.10001, 0.3, 1.0, 1.2])], SCORES)
    assert {r.probability_bin: r.row_count for r in metrics.reliability(df, ["m"]).collect()} == {0: 2, 1: 1, 2: 1, 9: 1}


def test_stability_index(spark):
    a = spark.createDataFrame([(float(i),) for i in range(50)], "v double")
    assert metrics.stability_index(a, a, "v").first().psi == 0.0
    assert metrics.stability_index(a, a.where("v < 25"), "v").first().psi > 0.25
    assert metrics.stability_index(a, a.limit(0), "v").first().psi == 0.0
    assert metrics.stability_index(a.selectExpr("1.0D v"), a, "v").first().psi == 0.0


def test_best_threshold_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 0.9), ("a", 2, 0.0, 0.2)], SCORES)
    assert metrics.best_threshold(df, ["m"], [0.1, 0.3, 0.5]).first().decision_threshold == 0.3


def test_latest_rows_and_gate(spark):
    df = spark.createDataFrame([("k", 1, "a", "2020-01-01"), ("k", 2, "b", "2020-01-01"), ("k", 3, "a", "2019-01-01"), (None, 4, "a", "2020-01-01")], "k string, v int, _bronze_source_file string, t string").selectExpr("k", "v", "_bronze_source_file", "timestamp(t) _bronze_loaded_at_utc")
    assert [r.v for r in cleaning.latest_rows(cleaning.with_keys(df, ["k"]), ["k"]).collect()] == [2]


def test_next_year_splits_and_leakage(spark):
    df = spark.createDataFrame([("a", 2000, 1.0), ("a", 2001, 5.0), ("a", 2003, 9.0), (None, 2000, 1.0)], "bene_id string, year int, annual_claim_cost double")
    got = labels.next_year(df).collect()
    assert [(r.bene_id, r.feature_year, r.target_year, r.target_annual_claim_cost) for r in got] == [("a", 2000, 2001, 5.0)]
    assert labels.assign_split(df).count() == 3
    assert labels.next_year(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="label"):
        features.reject_leakage(["age_years", "label"])
    assert features.reject_leakage(["prior_year_annual_claim_cost", "current_year_high_cost_indicator"])


def test_runs(spark):
    audit = spark.createDataFrame([("m", "r1", "test", 1), ("m", "r2", "test", 2), ("m", "r3", "train", 3), ("n", "r1", "test", 1), ("n", "r2", "test", 1)], "model_name string, run_id string, split_name string, processed_at_utc int")
    assert {(r.model_name, r.run_id) for r in runs.latest_run_ids(audit).collect()} == {("m", "r2"), ("n", "r2")}
    wanted = spark.createDataFrame([("m", "r1"), ("m", "r9")], "model_name string, run_id string")
    assert [r.run_id for r in runs.missing_runs(audit, wanted).collect()] == ["r9"]
    with pytest.raises(ValueError, match="r9"):
        runs.require_selected(audit, wanted)


def test_states_invert(spark):
    df = spark.range(0, 108).select("id").withColumns(scoring.state_parts(__import__("pyspark.sql.functions", fromlist=["col"]).col("id")))
    rows = df.collect()
    assert len({(r.state_tier, r.state_burden, r.state_utilization, r.state_prior) for r in rows}) == 108
    for r in rows:
        i = ((scoring.RISK_TIERS.index(r.state_tier) * 3 + scoring.LEVELS.index(r.state_burden)) * 3 + scoring.LEVELS.index(r.state_utilization)) * 3 + scoring.PRIOR.index(r.state_prior)
        assert i == r.id


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b_2008.csv").write_text("k,v\n1,x\n2,\n")
    (tmp_path / "inv.json").write_text('{"files": [{"entity": "b", "file_name": "b_2008.csv"}, {"entity": "b", "file_name": "gone_2009.csv"}]}')
    listed = inventory.load_inventory(spark, str(tmp_path / "inv.json")).withColumn("year", inventory.entry_year(["file_name"]))
    raw = inventory.read_raw(spark, [str(tmp_path / "in" / "b_2008.csv")], "b", listed, "k", yearly=("b",))
    assert [(r.k, r.v, r._bronze_source_year) for r in raw.orderBy("k").collect()] == [("1", "x", 2008), ("2", None, 2008)]
    files = inventory.list_files(spark, str(tmp_path / "in"))
    assert [r.file_name for r in inventory.exceptions(listed, files).collect()] == ["gone_2009.csv"]
    assert inventory.list_files(spark, str(tmp_path / "no")).count() == 0
    with pytest.raises(ValueError):
        inventory.read_raw(spark, [], "b")


def test_tables(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    tables.write_table(df, "t_tables")
    tables.write_table(df.selectExpr("b", "a", "2 c"), "t_tables", "append")
    assert sorted(map(tuple, tables.read_table(spark, "t_tables").collect()), key=str) == [(1, "x", 2), (1, "x", None)]
    tables.set_properties(spark, "t_tables", {"feature_version": "v"})
    assert tables.table_property(spark, "t_tables", "feature_version") == "v"
    assert tables.table_property(spark, "t_tables", "none") is None
    with pytest.raises(ValueError):
        tables.read_table(spark, "t_absent")
    spark.sql("drop table t_tables")


def test_audit_rows_pair_names(spark):
    entries = spark.createDataFrame([("a", ["r1", "r2"], ["e1"]), ("b", [], None)], "entity string, raw_names array<string>, extracted_names array<string>")
    got = sorted(map(str, inventory.audit_rows(entries, spark.createDataFrame([("a", 5)], "entity string, row_count long")).collect()))
    assert [x.split("(")[1] for x in got] == ["entity='a', raw_name='r1', extracted_name='e1', row_count=5)", "entity='a', raw_name='r2', extracted_name=None, row_count=5)", "entity='b', raw_name=None, extracted_name=None, row_count=None)"]


def test_models_rank_held_out_rows(spark):
    rows = [(i, ["train", "validation", "test"][i % 3], float(i % 7 > 3), float(i % 7) + (i % 5) / 10, "x" if i % 2 else None) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, split_name string, label double, n double, c string")
    for model in ("logistic_regression", "gradient_boosting"):
        scores = training.train_and_score(frame, model, ["n"], ["c"], "r", ["id"], [{"rounds": 8, "rate": 0.3}] if model in training.BOOSTED else None)
        assert scores.count() == 300
        assert metrics.auc(scores.where("split_name = 'test'"), ["model_name"]).first().roc_auc > 0.95
    sigmoid = training.calibrate(scores.where("split_name = 'validation'"), scores.select("id", "label", "predicted_probability"), "sigmoid")
    assert sigmoid.where("predicted_probability between 0 and 1").count() == 300
    assert metrics.fine_thresholds(scores, []).count() >= 99


def test_folds_are_stratified(spark):
    df = spark.range(0, 2000).selectExpr("id", "cast(id % 4 = 0 as double) label")
    got = training.folds(df, "id").groupBy("fold").agg({"label": "avg", "id": "count"}).collect()
    assert len(got) == 5 and all(300 < r["count(id)"] < 500 and 0.15 < r["avg(label)"] < 0.35 for r in got)


def test_running_sums_cross_ranges(spark):
    from tallyframe.operators import ranking

    df = spark.range(0, 500).selectExpr("id", "case when id % 3 < 2 then id % 3 end g", "cast(id % 5 as long) v", "1L w").repartition(7)
    got = ranking.running(df, ["g"], ["v", "id"], ["w", "v"]).collect()
    by = {}
    for r in sorted(got, key=lambda r: (str(r.g), r.v, r.id)):
        n, s = by.get(r.g, (0, 0))
        by[r.g] = (n + 1, s + r.v)
        assert (r.w_upto, r.v_upto) == by[r.g]
    assert all((r.w_all, r.v_all) == by[r.g] for r in got)
    assert ranking.running(df.limit(0), ["g"], ["v"], ["w"]).count() == 0


@pytest.mark.parametrize("n", [1, 7, 10, 23])
def test_tiles(spark, n):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tallyframe.operators import ranking

    df = spark.range(1, n + 1).withColumn("want", F.ntile(10).over(Window.orderBy("id")))
    assert df.where(ranking.tile(F.col("id"), F.lit(n), 10) != F.col("want")).count() == 0


def test_contract_extract_and_publish(spark, tmp_path):
    df = spark.createDataFrame([("a", 2001, 1.9, 7), ("b", 2000, 2.0, 8)], "bene_id string, year int, x double, n int")
    model = features.contract(df, ["n", "x"], ints=("x",), longs=("n",))
    assert model.dtypes == [("n", "bigint"), ("x", "int")]
    with pytest.raises(ValueError, match="absent"):
        features.contract(df, ["absent"])
    tables.extract(df, ["year"], str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    tables.publish_features(df, "t_features", features.FEATURE_VERSION, "silver", "build")
    assert tables.table_property(spark, "t_features", "feature_version") == features.FEATURE_VERSION
    assert tables.read_table(spark, "t_features", ["bene_id"]).count() == 2
    spark.sql("drop table t_features")
    assert tables.failure_record(spark, "r", "failed_qc", "why").first().reason == "why"


def test_prior_year_can_require_the_year_before(spark):
    rows = [("a", 2000, 10.0), ("a", 2002, 20.0), ("a", 2003, 30.0)]
    df = spark.createDataFrame(rows, "bene_id string, year int, annual_claim_cost double").selectExpr("*", "0 inpatient_claim_count", "1 total_claim_count", "12 enrollment_months_count", "5 annual_cost_year_decile", "20.0D annual_cost_year_median")
    row = [(r.has_prior_year, r.prior_year_annual_claim_cost) for r in df.withColumns(features.prior_year()).orderBy("year").collect()]
    strict = [(r.has_prior_year, r.prior_year_annual_claim_cost) for r in df.withColumns(features.prior_year(consecutive=True)).orderBy("year").collect()]
    assert row == [(0, 0.0), (1, 10.0), (1, 20.0)]
    assert strict == [(0, 0.0), (0, 0.0), (1, 20.0)]


def test_year_positions_with_ties_and_nulls(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.range(0, 97).selectExpr("cast(id as string) bene_id", "cast(2000 + id % 2 as int) year", "case when id % 10 < 4 then 0.0D else cast(id as double) end annual_claim_cost")
    year = Window.partitionBy("year")
    want = df.select("bene_id", "year", F.percent_rank().over(year.orderBy("annual_claim_cost")).alias("p"), F.ntile(10).over(year.orderBy("annual_claim_cost", "bene_id")).alias("d"))
    got = features.year_position(df, median_exact=True)
    joined = want.join(got, ["bene_id", "year"])
    assert joined.count() == 97
    assert joined.where("abs(p - annual_cost_year_percentile) > 1e-12 or d <> annual_cost_year_decile").count() == 0
    assert features.year_position(df.limit(0)).count() == 0


def test_quality_of_features_and_checks(spark):
    df = spark.createDataFrame([("a", 2000, 13, 12, -1.0), ("a", 2000, 12, 3, 1.0), (None, 2000, 0, 1, 1.0)], "bene_id string, year int, enrollment_months_count int, chronic_condition_count int, inpatient_total_cost double").selectExpr("*", "0.0D outpatient_total_cost", "0.0D carrier_total_cost", "0.0D rx_total_cost")
    q = features.table_quality(df).first()
    assert (q.row_count, q.missing_bene_year_key_count, q.duplicate_bene_year_count, q.invalid_enrollment_month_count, q.invalid_chronic_condition_count, q.negative_component_cost_count, q.blocking) == (3, 1, 1, 1, 1, 1, "missing_bene_year_key_count")
    assert features.table_quality(df.limit(0)).first().blocking == "row_count"
    checks = {r.check_name: r.status for r in runs.consistency(df, ["absent"], {}, {"v": "1"}, {}, "s").collect()}
    assert checks == {"required columns": "fail", "property v": "fail", "unique keys": "fail", "chronic range": "fail"}


def test_percentile_scores(spark):
    ref = spark.createDataFrame([(0.1,), (0.2,), (0.2,), (1.4,)], "predicted_probability double")
    df = spark.createDataFrame([(1, 0.05), (2, 0.2), (3, 2.0), (4, None)], "id int, predicted_probability double")
    got = {r.id: r.percentile_score for r in scoring.percentile_scores(df, ref).collect()}
    assert got == {1: 0, 2: 75, 3: 100, 4: None}
    assert {r.percentile_score for r in scoring.percentile_scores(df, ref.limit(0)).collect()} == {None}


def test_quality_of_one_kind_of_column(spark):
    from tallyframe.operators import audits

    df = spark.createDataFrame([(1.0, "a"), (-1.0, None)], "total_cost double, state string")
    numbers, texts = audits.feature_quality(df, ["total_cost"], []).collect(), audits.feature_quality(df, [], ["state"]).collect()
    assert [(r.feature_name, r.impossible_value_count, r.audit_severity) for r in numbers] == [("total_cost", 1, "fail")]
    assert [(r.feature_name, r.null_count, r.audit_severity) for r in texts] == [("state", 1, "warn")]
    assert audits.feature_quality(df, [], []).count() == 0
