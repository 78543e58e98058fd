"""Searches, calibration, selections, exact quantiles, and audits with their states."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import audits, contract, features, labels, metrics, ranking, training
from tallyframe.sources import inventory, tables

NUMERIC, CATEGORICAL = ["x", "z"], ["group"]


@pytest.fixture(scope="module")
def frame(spark):
    r = np.random.default_rng(7)
    x, z = r.normal(size=(2, 600))
    y = (x + 0.3 * z + r.normal(size=600) > 0.8).astype(float)
    rows = [(f"b{i}", 2008, ["train", "train", "train", "validation", "test"][i % 5], float(y[i]), float(x[i]), float(z[i]), "ab"[i % 2]) for i in range(600)]
    return spark.createDataFrame(rows, "bene_id string, year int, split_name string, label double, x double, z double, group string").cache()


def average_precision(y, p):
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    return float((hits / np.arange(1, len(y) + 1) * y[order]).sum() / y.sum())


def test_grids_have_the_points_of_their_names():
    sizes = {m: len(training.points(g)) for m, g in training.GRIDS.items()}
    assert sizes == {"logistic_regression": 4, "random_forest": 24, "gradient_boosting": 16, "regularized_boosting": 32}


def test_search_prefers_the_point_with_the_best_folds(spark, frame):
    train = frame.where("split_name = 'train'")
    grid = training.points({"C": [1e-6, 1.0]})
    found = training.cross_validate(train, "logistic_regression", NUMERIC, CATEGORICAL, "bene_id", grid, k=3)
    assert len(found) == 2 and all(len(r["folds"]) == 3 for r in found)
    assert found[0]["mean"] >= found[1]["mean"] and found[0]["mean"] == pytest.approx(np.mean(found[0]["folds"]))
    table = training.search_table(spark, found, "logistic_regression", "r").orderBy("place").collect()
    assert [t.place for t in table] == [1, 2] and table[0].mean_average_precision > 0.6


def test_fold_precision_is_the_slow_one(frame):
    train = training.balanced(training.filled(frame.where("split_name = 'train'"), NUMERIC, CATEGORICAL))
    fitted = training.fit(frame.where("split_name = 'train'"), "logistic_regression", NUMERIC, CATEGORICAL, params={"C": 1.0})
    scored = training.score(fitted, train, NUMERIC, CATEGORICAL, ["label"]).collect()
    got = metrics.auc(training.score(fitted, train, NUMERIC, CATEGORICAL, ["label"]), []).first().pr_auc
    assert got == pytest.approx(average_precision(np.array([r.label for r in scored]), np.array([r.predicted_probability for r in scored])), abs=1e-9)


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_scores_of_a_search_are_calibrated_for_every_row(frame, method):
    grid = training.points({"C": [0.1, 1.0]})
    out = training.train_and_score(frame, "logistic_regression", NUMERIC, CATEGORICAL, "r1", ["bene_id", "year"], grid, 2, method)
    assert {r.split_name: r["count"] for r in out.groupBy("split_name").count().collect()} == {"train": 360, "validation": 120, "test": 120}
    facts = out.agg(F.min("predicted_probability").alias("a"), F.max("predicted_probability").alias("b"), F.avg(((F.col("predicted_probability") >= F.col("decision_threshold")) == (F.col("predicted_label") == 1)).cast("double")).alias("c")).first()
    assert 0 <= facts.a <= facts.b <= 1 and facts.c == 1
    ideal = frame.where("split_name = 'test'").select("label", (F.col("x") + 0.3 * F.col("z")).alias("predicted_probability"))
    got, best = (metrics.auc(d, []).first().roc_auc for d in (out.where("split_name = 'test'"), ideal))
    assert got > best - 0.05


def test_search_on_the_validation_split(frame):
    grid = training.points({"max_depth": [1, 2], "rounds": [6]})
    ranked, scores = training.boosted(frame, "regularized_boosting", NUMERIC, CATEGORICAL, ["bene_id", "split_name", "label"], grid)
    assert len(ranked) == 2 and ranked[0]["mean"] >= ranked[1]["mean"] > 0.4 and all(len(r["folds"]) == 1 for r in ranked)
    held = scores.where("split_name = 'validation'").collect()  # the best point's fit scores the rows as the search did
    assert average_precision(np.array([r.label for r in held]), np.array([r.predicted_probability for r in held])) == pytest.approx(ranked[0]["mean"], abs=0.02)


def test_search_over_folds_shares_rounds(frame):
    grid = training.points({"max_depth": [2], "rounds": [3, 8], "rate": [0.3], "patience": [50]})
    ranked, scores = training.boosted(frame, "gradient_boosting", NUMERIC, CATEGORICAL, ["bene_id", "split_name", "label"], grid, 3)
    assert [len(r["folds"]) for r in ranked] == [3, 3] and {r["params"]["rounds"] for r in ranked} == {3, 8}
    assert scores.count() == 600 and ranked[0]["mean"] > 0.5
    alone = training.boosted(frame, "gradient_boosting", NUMERIC, CATEGORICAL, ["bene_id", "split_name", "label"], [g for g in grid if g["rounds"] == 3], 3)[0]
    assert alone[0]["folds"] == next(r["folds"] for r in ranked if r["params"]["rounds"] == 3)


def test_larger_forests_hold_the_smaller_ones(frame):
    train = training.balanced(training.filled(frame.where("split_name = 'train'"), NUMERIC, CATEGORICAL))
    before = training.Pipeline(stages=training.preprocessor(NUMERIC, CATEGORICAL)).fit(train)
    learn = before.transform(train)
    common = {"maxDepth": 3, "minInstancesPerNode": 5, "featureSubsetStrategy": "sqrt"}
    df, (small, large) = training.learned("random_forest", [{**common, "numTrees": 4}, {**common, "numTrees": 10}], learn, 1.0)(learn)
    rows = df.select(small.alias("s"), large.alias("l"), F.col("p0__").alias("a"), F.col("p1__").alias("b")).collect()
    assert all(r.s == pytest.approx(r.a[1]) and r.l == pytest.approx(0.4 * r.a[1] + 0.6 * r.b[1]) for r in rows)
    alone, (p,) = training.learned("random_forest", [{**common, "numTrees": 4}], learn, 1.0)(learn)
    assert sorted(r.s for r in rows) == pytest.approx(sorted(r.p for r in alone.select(p.alias("p")).collect()))


def test_columns_that_tell_the_target_are_refused(frame):
    with pytest.raises(ValueError, match="label"):
        training.fit(frame, "logistic_regression", ["x", "label"], [])


def test_quantiles_are_exact_at_any_range(spark):
    r = np.random.default_rng(1)
    values = {g: np.round(r.normal(size=n) * 5) for g, n in (("a", 1), ("b", 2), ("c", 333), (None, 50))}
    rows = [(g, float(v)) for g, x in values.items() for v in x] + [("d", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    at = {"q0": 0.0, "q3": 0.3, "q5": 0.5, "q9": 0.9, "q1": 1.0}
    got = {x.g: [x[c] for c in at] for x in ranking.quantiles(df, ["g"], "v", at).collect()}
    assert set(got) == set(values)
    for g, x in values.items():
        assert got[g] == pytest.approx([float(np.quantile(x, q)) for q in at.values()])
    told = {x.g: [x[c] for c in at] for x in ranking.quantiles(df, ["g"], "v", at, discrete=True).collect()}
    for g, x in values.items():
        assert told[g] == [float(np.sort(x)[max(int(np.ceil(q * len(x))) - 1, 0)]) for q in at.values()]
    assert ranking.quantiles(df.where("v is null"), ["g"], "v", at).count() == 0


def test_approximate_thresholds_lie_near_in_rank(spark):
    df = spark.range(20_000).select((F.xxhash64("id") % 100_000).cast("double").alias("v"))
    near = labels.quantile(df, [], "v", 0.9, "q").first().q
    rank = df.where(F.col("v") <= near).count() / 20_000
    assert abs(rank - 0.9) <= 0.001


def test_order_of_drift_and_severity(spark):
    drift = spark.createDataFrame([("a", 0.1, True), ("b", 0.3, True), ("c", 0.9, False), ("d", 0.3, True)], "feature_name string, absolute_difference double, drift_flag boolean")
    assert [r.feature_name for r in audits.drifted(drift).collect()] == ["b", "d", "a"]
    quality = spark.createDataFrame([("a", "pass", 0), ("b", "fail", 1), ("c", "warn", 0), ("d", "fail", 5)], "feature_name string, audit_severity string, impossible_value_count long")
    assert [r.feature_name for r in audits.by_severity(quality).collect()] == ["d", "b", "c", "a"]


def test_publishing_leaves_one_audit_row_in_any_state(spark):
    df, rows, out = spark.range(3), [], []

    def run(build=lambda: df, check=lambda d: None, publish=out.append, audit=lambda r: rows.append(r.first().status)):
        return tables.publish_with_audit(spark, "r1", build, check, publish, audit)

    def broken(*_):
        raise RuntimeError("no")

    def once(r):
        rows.append(r.first().status)
        if rows[-1] == "succeeded":
            rows.pop()
            raise RuntimeError("audit table is away")

    assert run() == "succeeded" and len(out) == 1
    for options in ({"check": lambda d: "duplicate keys"}, {"build": broken}, {"audit": once}):
        with pytest.raises((ValueError, RuntimeError)):
            run(**options)
    assert rows == ["succeeded", "failed_qc", "failed_runtime", "published_audit_failed"]
    assert len(out) == 2


def test_export_is_checked_and_made_again(spark, tmp_path):
    path = str(tmp_path / "export")
    spark.createDataFrame([("a", 70, 3, 5, 100.5), ("b", None, 2, 0, -1.0)], "bene_id string, age_years_imputed int, chronic_condition_count int, total_claim_count int, annual_claim_cost double").write.option("header", True).csv(path)
    schema = "age_years_imputed int, chronic_condition_count int, total_claim_count int, annual_claim_cost double"
    with pytest.raises(ValueError, match="year"):
        features.read_export(spark, path, schema, ["bene_id", "year"])
    rows = {r.bene_id: r for r in features.rederived(features.read_export(spark, path, schema, ["bene_id"])).collect()}
    assert (rows["a"].age_squared, rows["a"].age_chronic_count_interaction, rows["b"].age_squared) == (4900, 210, None)
    assert rows["b"].annual_cost_log1p == 0.0 and rows["a"].total_claim_count_log1p == pytest.approx(np.log(6))


def test_years_of_files(spark, tmp_path):
    for name in ("DE_2008_sample.csv", "DE_2009_sample.csv", "other.csv"):
        (tmp_path / name).write_text("k\n1\n")
    entries = [(0, "DE_2008", "beneficiary_summary", 2008), (1, "DE_2009", "beneficiary_summary", 1999), (2, "2009_sample", "beneficiary_summary", 2009), (3, "DE_2008", "claims", 2008)]
    listed = spark.createDataFrame(entries, "position int, file_name string, entity string, year int")
    raw = inventory.read_raw(spark, [str(tmp_path)], "beneficiary_summary", listed)
    assert {r._bronze_source_file: r._bronze_source_year for r in raw.collect()} == {"DE_2008_sample.csv": 2008, "DE_2009_sample.csv": 2009, "other.csv": None}
    assert {r._bronze_source_year for r in inventory.read_raw(spark, [str(tmp_path)], "claims", listed).collect()} == {None}
    a, b = (inventory.content_checksums(spark.read.option("header", True).csv(str(tmp_path / n))).first() for n in ("DE_2008_sample.csv", "other.csv"))
    assert a.checksum == b.checksum and a.row_count == 1


def test_labelled_splits_and_contract(spark):
    rows = [(f"b{i}", 2008, float(i)) for i in range(400)] + [(None, 2008, 1.0)]
    df = labels.labelled_splits(spark.createDataFrame(rows, "bene_id string, year int, target_annual_claim_cost double"), exact=True)
    assert df.count() == 400 and {r.split_name for r in df.select("split_name").distinct().collect()} == {"train", "validation", "test"}
    train = df.where("split_name = 'train'")
    assert train.where("label = 1").count() == pytest.approx(train.count() * 0.1, abs=1.5)
    assert len(contract.NUMERIC) == 114 and len(contract.CATEGORICAL) == 11 and len(set(contract.ORDER)) == 125


def test_logits_of_all_points_and_folds_are_those_of_spark(monkeypatch, frame):
    passes, real = [], training.logits._summed
    monkeypatch.setattr(training.logits, "_summed", lambda *a: passes.append(1) or real(*a))
    train, grid = frame.where("split_name = 'train'"), training.points({"C": [0.01, 1.0]})
    found = training.cross_validate(train, "logistic_regression", NUMERIC, CATEGORICAL, "bene_id", grid, k=3)
    assert len(passes) < 12  # six fits of up to 50 passes each before
    monkeypatch.setattr(training, "_shares_passes", lambda *a: False)
    for a, b in zip(found, training.cross_validate(train, "logistic_regression", NUMERIC, CATEGORICAL, "bene_id", grid, k=3), strict=True):
        assert a["params"] == b["params"] and a["folds"] == pytest.approx(b["folds"], abs=2e-3)
    for c in (0.01, 1.0):
        fitted = training.fit(train, "logistic_regression", NUMERIC, CATEGORICAL, params={"C": c})
        want = {r.bene_id: r.predicted_probability for r in training.score(fitted, frame, NUMERIC, CATEGORICAL, ["bene_id"]).collect()}
        got = {r.bene_id: r.predicted_probability for r in training._logit_scores(frame, NUMERIC, CATEGORICAL, ["bene_id", "label"], c).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-4


def test_deep_forests_hold_those_of_fewer_levels(monkeypatch, frame):
    fits, real = [], training.configured
    train = training.balanced(training.filled(frame.where("split_name = 'train'"), NUMERIC, CATEGORICAL))
    learn = training.Pipeline(stages=training.preprocessor(NUMERIC, CATEGORICAL)).fit(train).transform(train).select("features", "label", "class_weight").cache()
    grid = training.points({"numTrees": [3, 7], "maxDepth": [2, 5], "minInstancesPerNode": [5], "featureSubsetStrategy": ["0.5"]})
    monkeypatch.setattr(training, "configured", lambda *a: fits.append(1) or real(*a))
    got = training._precision_of_points(learn, learn, "random_forest", grid, 42)
    assert len(fits) == 2  # a part of 3 trees and one of 4 further ones; each depth had its own before
    for p, area in zip(grid, got, strict=True):
        alike = [q for q in grid if q["maxDepth"] == p["maxDepth"]]
        df, probabilities = training.learned("random_forest", alike, learn, 1.0)(learn)
        alone = df.select("label", F.round(probabilities[alike.index(p)], 9).alias("predicted_probability"))
        fitted = training._parts("random_forest", [{**q, "maxDepth": 5} for q in alike], learn, 1.0, 42)[2]
        scored = training.forests.scores(learn, [training.forests.nodes(learn.sparkSession, f) for f in fitted], [(0, p["numTrees"], p["maxDepth"])])
        assert sorted(r.predicted_probability for r in scored.collect()) == pytest.approx(sorted(r.predicted_probability for r in alone.collect()), abs=1e-8)
        assert area == pytest.approx(metrics.auc(alone, []).first().pr_auc, abs=1e-6)
