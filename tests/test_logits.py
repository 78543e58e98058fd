"""Logits, selections and collinearity against numpy on all rows."""

import math
import random

import numpy as np
import pytest

from tallyframe.operators import logits, training
from tallyframe.operators.logits import Term

TERMS = [Term("a", core=True), Term("b"), Term("bb", parents=("b",)), Term("g", factor=True), Term("h", factor=True, core=True)]


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(4)
    rows = []
    for _ in range(900):
        a, b, g, h = r.gauss(50, 9), r.gauss(0, 1), r.choice(["x", "y", "z", None]), r.choice("mf")
        lift = 0.08 * (a - 50) + 0.9 * b + {"x": 0.0, "y": 1.0, "z": -1.0, None: 0.4}[g] - 0.5
        rows.append((a, b, b * b, g, h, float(r.random() < 1 / (1 + math.exp(-lift)))))
    rows[0] = (None, *rows[0][1:])
    return spark.createDataFrame(rows, "a double, b double, bb double, g string, h string, label double").repartition(3), rows


def matrix(rows, terms):
    """Intercept, factors without their first level, scaled numbers; and the labels."""
    at = dict(zip(("a", "b", "bb", "g", "h"), range(5), strict=True))
    out = [np.ones(len(rows))]
    for t in ("g", "h"):
        if t in terms:
            v = ["unknown" if r[at[t]] is None else r[at[t]] for r in rows]
            out += [np.array([x == level for x in v], float) for level in sorted(set(v))[1:]]
    for t in ("a", "b", "bb"):
        if t in terms:
            v = np.array([r[at[t]] or 0.0 for r in rows])
            out.append((v - v.mean()) / v.std())
    return np.stack(out, axis=1), np.array([r[5] for r in rows])


def slow(rows, terms):
    x, y = matrix(rows, terms)
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.pinv(x.T @ (x * (p * (1 - p))[:, None])) @ x.T @ (y - p)
    p = 1 / (1 + np.exp(-x @ beta))
    return beta, (y * np.log(p) + (1 - y) * np.log(1 - p)).sum(), np.linalg.pinv(x.T @ (x * (p * (1 - p))[:, None]))


@pytest.fixture(scope="module")
def fitted(data):
    rows = logits.values(data[0], TERMS)
    return rows, logits.design(rows, TERMS)


def test_many_models_in_the_same_passes(monkeypatch, fitted, data):
    passes, real = [], logits._summed
    monkeypatch.setattr(logits, "_summed", lambda *a: passes.append(1) or real(*a))
    subsets = [["a"], ["a", "b", "bb", "g", "h"], ["g"], ["b", "h"], []]
    fits = logits.fit_all(*fitted, subsets)
    assert len(passes) < 10
    for s, f in zip(subsets, fits, strict=True):
        beta, likelihood, covariance = slow(data[1], s)
        assert f.coefficients == pytest.approx(beta, abs=1e-5) and f.log_likelihood == pytest.approx(likelihood, abs=1e-6)
        assert f.aic == pytest.approx(2 * len(beta) - 2 * likelihood, abs=1e-6) and f.bic == pytest.approx(len(beta) * math.log(900) - 2 * likelihood)
        table = logits.coefficient_rows(f, fitted[1])
        assert [t["standard_error"] for t in table] == pytest.approx(np.sqrt(np.diag(covariance)), rel=1e-4)
    assert [t["term"] for t in logits.coefficient_rows(fits[1], fitted[1])] == ["intercept", "g_x", "g_y", "g_z", "h_m", "a", "b", "bb"]


def test_selection_keeps_core_terms_and_parents(fitted, data):
    steps, final = logits.backward_selection(*fitted)
    now, best = [t.name for t in TERMS], None
    for i, step in enumerate(steps):
        if i:
            free = [t for t in now if t in ("b", "bb", "g") and not (t == "b" and "bb" in now)]
            aic = {t: 2 * len(slow(data[1], [x for x in now if x != t])[0]) - 2 * slow(data[1], [x for x in now if x != t])[1] for t in free}
            gone = min(aic, key=aic.get)
            assert step["removed"] == gone and step["aic"] == pytest.approx(aic[gone], abs=1e-6) and aic[gone] < best
            now.remove(gone)
        best = step["aic"]
    assert {"a", "h", "b", "g"} <= set(final.terms) == set(now)
    with pytest.raises(ValueError, match="need others"):
        logits.backward_selection(fitted[0], logits.design(fitted[0], [t for t in TERMS if t.name != "b"]))


def test_blocks_of_columns(fitted, data):
    every = [t.name for t in TERMS]
    rows = {r["block"]: r for r in logits.likelihood_ratios(*fitted, every, {"g": ["g"], "b": ["b", "bb"], "orphan": ["b"], "absent": ["q"]})}
    assert set(rows) == {"g", "b"} and rows["g"]["degrees"] == 3 and rows["b"]["degrees"] == 2
    for name, rest in (("g", ["a", "b", "bb", "h"]), ("b", ["a", "g", "h"])):
        assert rows[name]["statistic"] == pytest.approx(2 * (slow(data[1], every)[1] - slow(data[1], rest)[1]), abs=1e-6)
    assert rows["g"]["p_value"] < 1e-6


@pytest.mark.parametrize(("x", "k", "tail"), [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (9.487729036781154, 4, 0.05), (23.209251158954356, 10, 0.01), (24.724970311318277, 11, 0.01), (0.0, 3, 1.0), (100.0, 1, 1.523970604832105e-23)])
def test_tails(x, k, tail):
    assert logits.chi_square_tail(x, k) == pytest.approx(tail, rel=1e-9)


def test_inflation_is_infinite_for_collinear_terms(spark):
    r = np.random.default_rng(2)
    a, b, c = r.normal(size=(3, 500))
    columns = {"a": a, "line": 2 * a - 3.3, "b": b, "near": b + 0.3 * c, "flat": np.full(500, 4.0)}
    df = spark.createDataFrame([(*map(float, row), 1.0) for row in zip(*columns.values(), strict=True)], [*columns, "label"])
    terms = [Term(t) for t in columns]
    rows = logits.values(df, terms)
    found = logits.collinearity(rows, logits.design(rows, terms), {"all": list(columns), "few": ["a", "b"], "one": ["a"]})
    vif = {(x["scope"], x["a"]): x for x in found if x["kind"] == "vif"}
    assert {k[0] for k in vif} == {"all", "few"}
    assert all(vif["all", t]["vif"] == math.inf and vif["all", t]["flag"] for t in ("a", "line")) and vif["all", "flat"]["vif"] == 1
    for t, others in (("b", ["a", "near"]), ("near", ["a", "b"])):
        x = np.stack([np.ones(500), *(columns[o] for o in others)], axis=1)
        rest = columns[t] - x @ np.linalg.lstsq(x, columns[t], rcond=None)[0]
        assert vif["all", t]["vif"] == pytest.approx(columns[t].var() / rest.var()) and vif["all", t]["flag"]
    assert vif["few", "a"]["vif"] == pytest.approx(1 / (1 - np.corrcoef(a, b)[0, 1] ** 2)) and not vif["few", "a"]["flag"]
    pairs = [(x["a"], x["b"], x["flag"]) for x in found if x["kind"] != "vif"]
    assert pairs == [("a", "line", True), ("b", "near", True)]


def test_tables_of_a_selection(spark, data):
    made = training.selection_tables(data[0], "r1", TERMS, {"g": ["g"], "none": ["other"]})
    audit = made["audit"].first()
    assert audit.row_count == 900 and audit.candidate_terms == "a,b,bb,g,h" and audit.parameters == made["coefficients"].count()
    assert [(r.block, r.degrees) for r in made["ratios"].collect()] == [("g", 3)] and made["steps"].count() == audit.removed_count + 1
    nothing = training.selection_tables(data[0], "r1", TERMS, {"none": ["other"]})["ratios"].collect()  # the run is there, without values
    assert [(r.run_id, r.block) for r in nothing] == [("r1", None)]


def test_separated_classes_end(spark):
    df = spark.createDataFrame([(float(i), float(i > 10)) for i in range(20)], "a double, label double")
    rows = logits.values(df, [Term("a")])
    fit = logits.fit_all(rows, logits.design(rows, [Term("a")]), [["a"]])[0]
    assert fit.log_likelihood > -1e-3 and np.isfinite(fit.coefficients).all()


def test_models_beside_a_fitted_one_take_few_passes(monkeypatch, fitted, data):
    whole = logits.fit_all(*fitted, [["a", "b", "bb", "g", "h"]])[0]
    passes, real = [], logits._summed
    monkeypatch.setattr(logits, "_summed", lambda *a: passes.append(1) or real(*a))
    subsets = [["a", "b", "g", "h"], ["a", "b", "bb", "h"]]
    for s, f in zip(subsets, logits.fit_all(*fitted, subsets, near=whole), strict=True):
        beta, likelihood, _ = slow(data[1], s)
        assert f.coefficients == pytest.approx(beta, abs=1e-6) and f.log_likelihood == pytest.approx(likelihood, abs=1e-6)
    assert len(passes) <= 5
    passes.clear()
    given = logits.likelihood_ratios(*fitted, whole.terms, {"g": ["g"]}, whole=whole)
    few = len(passes)
    alone = logits.likelihood_ratios(*fitted, whole.terms, {"g": ["g"]})
    assert given[0]["statistic"] == pytest.approx(alone[0]["statistic"], abs=1e-6) and few < len(passes) - few
