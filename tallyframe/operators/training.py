"""Classifiers and model statistics on pyspark.ml: rows never leave the executors; only coefficients and metrics do."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.operators import bagging, boosting, forests, logits, metrics
from tallyframe.operators.features import reject_leakage
from tallyframe.operators.logits import Term
from tallyframe.sources.scratch import drop, saved


def filled(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric} | {c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in categorical})


def preprocessor(numeric: list[str], categorical: list[str]) -> list:
    """Scaled numbers and one-hot categories; a level not seen in training is all zeros."""
    indexed, hot = [f"{c}__i" for c in categorical], [f"{c}__h" for c in categorical]
    stages = [VectorAssembler(inputCols=numeric, outputCol="numbers__"), StandardScaler(inputCol="numbers__", outputCol="scaled__", withMean=True)]
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep"), OneHotEncoder(inputCols=indexed, outputCols=hot, handleInvalid="keep")]
    return [*stages, VectorAssembler(inputCols=["scaled__", *hot], outputCol="features")]


def balanced(df: DataFrame) -> DataFrame:
    """class_weight: n / (2 n of the class), joined from two rows."""
    n = df.groupBy("label").agg(F.count("*").alias("_n"))
    weights = n.select("label", (F.sum("_n").over(W.partitionBy()) / (2 * F.col("_n"))).alias("class_weight"))
    return df.join(F.broadcast(weights), "label")


# The grids that are searched. C is the inverse strength of a penalty on the sum of losses.
GRIDS = {
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0]},
    "random_forest": {"numTrees": [50, 150, 300], "maxDepth": [8, 12], "minInstancesPerNode": [10, 20], "featureSubsetStrategy": ["sqrt", "0.5"]},
    "gradient_boosting": {"max_depth": [3, 5], "min_rows": [10, 20], "subsample": [0.8, 1.0], "rounds": [500, 1000]},
    "regularized_boosting": {"max_depth": [3, 4], "min_child_weight": [3.0, 5.0], "gamma": [0.0, 1.0], "subsample": [0.8], "colsample": [0.8], "reg_alpha": [0.0, 0.1], "reg_lambda": [1.0, 5.0]},
}
# What these grids leave open. Gradient boosting stops by the loss of a seventh of the rows it may learn from
# and keeps all its trees; regularized boosting stops by the held rows and ends at its lowest loss.
BOOSTED = {
    "gradient_boosting": {"max_depth": 3, "rate": 0.01, "min_child_weight": 0.0, "min_rows": 10, "reg_lambda": 0.0, "subsample": 0.8, "colsample": 1.0, "rounds": 1000, "patience": 50, "tolerance": 1e-4, "balanced": False, "best": False, "stop_share": 0.15},
    "regularized_boosting": {"max_depth": 4, "rate": 0.05, "min_child_weight": 5.0, "gamma": 0.0, "reg_lambda": 1.0, "reg_alpha": 0.0, "subsample": 0.8, "colsample": 0.8, "rounds": 1000, "patience": 50},
}
#: Fits of one fold that run side by side.
SIDE_BY_SIDE = 4


def points(grid: dict[str, list]) -> list[dict]:
    """All combinations of a grid's values."""
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def configured(model: str, params: dict, weight: float, seed: int = 42):
    """The estimator with these parameters. Spark averages losses where C scales their sum, so C is divided by the rows' total weight."""
    params = dict(params)
    if "C" in params:
        params["regParam"] = 1.0 / (params.pop("C") * max(weight, 1.0))
    estimator = estimators(seed)[model]
    return estimator.copy({estimator.getParam(k): v for k, v in params.items()})


def estimators(seed: int = 42) -> dict:
    """The configuration of each model of pyspark.ml that ``GRIDS`` varies."""
    common = {"labelCol": "label", "featuresCol": "features"}
    return {
        "logistic_regression": LogisticRegression(weightCol="class_weight", regParam=0.001, maxIter=50, **common),
        "random_forest": RandomForestClassifier(weightCol="class_weight", numTrees=40, maxDepth=8, seed=seed, cacheNodeIds=True, **common),
    }


def fit(train: DataFrame, model: str, numeric: list[str], categorical: list[str], seed: int = 42, params: dict | None = None):
    """A fitted pipeline of a model of pyspark.ml."""
    reject_leakage([*numeric, *categorical])
    data = balanced(filled(train, numeric, categorical))
    return Pipeline(stages=[*preprocessor(numeric, categorical), configured(model, params or {}, train.count() if params else 1.0, seed)]).fit(data)


def score(model, df: DataFrame, numeric: list[str], categorical: list[str], keep: list[str]) -> DataFrame:
    rows = filled(df.withColumns({f"_k{i}": F.col(c) for i, c in enumerate(keep)}), numeric, categorical)
    return model.transform(rows).select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), vector_to_array("probability")[1].alias("predicted_probability"))


def folds(df: DataFrame, id_col: str, k: int = 5) -> DataFrame:
    """Stratified folds without a global order: rows are numbered within label and a hash part of the id."""
    own = W.partitionBy("label", F.pmod(F.xxhash64(id_col), F.lit(256))).orderBy(id_col)
    return df.withColumn("fold", ((F.row_number().over(own) + F.pmod(F.xxhash64(id_col), F.lit(256))) % k).cast("int"))


def _parts(model: str, points_: list[dict], learn: DataFrame, weight: float, seed: int) -> tuple[list[int], list[int], list]:
    """The numbers of trees that points ask for, how many each part adds, and the fitted parts."""
    sizes = sorted({p.get("numTrees", 0) for p in points_})
    parts = [high - low for low, high in zip([0, *sizes], sizes, strict=False)] if sizes[0] else [1]
    fitted = []
    for i, n in enumerate(parts):
        estimator = configured(model, {**points_[0], **({"numTrees": n} if sizes[0] else {})}, weight, seed + i)
        fitted.append(estimator.setProbabilityCol(f"p{i}__").setRawPredictionCol(f"r{i}__").setPredictionCol(f"y{i}__").fit(learn))
    return sizes, parts, fitted


def learned(model: str, points_: list[dict], learn: DataFrame, weight: float, seed: int = 42) -> Callable[[DataFrame], tuple[DataFrame, list[Column]]]:
    """What scores rows with features: it returns them with more columns, and the probability of each point.

    Points of a forest may differ in numTrees: the larger forest is the smaller one and further trees. Each part is fitted
    with a seed of its own, and all trees' probability is the mean over the parts, weighted by their trees.
    """
    sizes, parts, fitted = _parts(model, points_, learn, weight, seed)

    def scores(df: DataFrame) -> tuple[DataFrame, list[Column]]:
        for f in fitted:
            df = f.transform(df)
        own = [vector_to_array(F.col(f"p{i}__"))[1] for i in range(len(parts))]
        upto = {size: sum((F.lit(n / size) * p for n, p in zip(parts[: k + 1], own, strict=False)), F.lit(0.0)) if size else own[0] for k, size in enumerate(sizes)}
        return df, [upto[p.get("numTrees", 0)] for p in points_]

    return scores


def _precision_of_points(learn: DataFrame, judge: DataFrame, model: str, grid: list[dict], seed: int) -> list[float | None]:
    """Average precision on ``judge`` of each point fitted on ``learn`` (both with features, label and class_weight)."""
    weight, shared = float(learn.count()), {}
    by_nodes = model == "random_forest" and all({"numTrees", "maxDepth"} <= p.keys() for p in grid)
    free = {"numTrees", "maxDepth"} if by_nodes else {"numTrees"}
    for i, p in enumerate(grid):
        shared.setdefault(json.dumps({k: v for k, v in p.items() if k not in free}, sort_keys=True), []).append(i)

    def one(places: list[int]) -> DataFrame:
        if by_nodes:  # trees of few levels are the upper levels of deep ones
            deep = max(grid[i]["maxDepth"] for i in places)
            fitted = _parts(model, [{**grid[i], "maxDepth": deep} for i in places], learn, weight, seed)[2]
            return forests.scores(judge, [forests.nodes(learn.sparkSession, f) for f in fitted], [(i, grid[i]["numTrees"], grid[i]["maxDepth"]) for i in places])
        df, probabilities = learned(model, [grid[i] for i in places], learn, weight, seed)(judge)
        each = F.array(*(F.struct(F.lit(i).alias("point"), p.alias("predicted_probability")) for i, p in zip(places, probabilities, strict=True)))
        return df.select("label", F.explode(each).alias("s")).select("label", "s.*")

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        scores = list(pool.map(one, shared.values()))
    found = {r.point: r.pr_auc for r in metrics.auc(reduce(DataFrame.unionByName, scores), ["point"]).collect()}
    return [found.get(i) for i in range(len(grid))]


def _ranked(grid: list[dict], by_fold: list[list[float | None]]) -> list[dict]:
    """Per point of the grid: params, folds (None where a fold has one class) and mean, best first; ties keep the grid's order."""
    rows = [{"params": p, "folds": list(f), "mean": sum(x for x in f if x is not None) / max(sum(x is not None for x in f), 1)} for p, f in zip(grid, zip(*by_fold, strict=True), strict=True)]
    return sorted(rows, key=lambda r: -r["mean"])


def _shares_passes(model: str, grid: list[dict]) -> bool:
    """Whether the points are logits that differ in C alone, which are fitted together (``logits.fit_penalized``)."""
    return model == "logistic_regression" and all(set(p) == {"C"} for p in grid)


def _terms(numeric: list[str], categorical: list[str]) -> list[Term]:
    return [Term(c) for c in numeric] + [Term(c, factor=True) for c in categorical]


def _logits_by_folds(data: DataFrame, numeric: list[str], categorical: list[str], grid: list[dict], k: int) -> list[list[float | None]]:
    """By fold the average precision of each point, all points and folds fitted in the same passes.

    The penalty goes by the spread of a column in the rows learnt from, and a level that these lack has no effect, so
    that one design of all rows serves every fold as preprocessing of its own would.
    """
    plan = logits.design(data, _terms(numeric, categorical), whole=True)
    tried = [logits.Penalty(p["C"], held) for held in range(k) for p in grid]
    scored = logits.predicted_by_folds(data, plan, tried, logits.fit_penalized(data, plan, tried, k))
    area = {r.point: r.pr_auc for r in metrics.auc(scored, ["point"]).collect()}
    return [[area.get(held * len(grid) + i) for i in range(len(grid))] for held in range(k)]


def _logit_scores(frame: DataFrame, numeric: list[str], categorical: list[str], keep: list[str], inverse: float) -> DataFrame:
    """``keep`` and predicted_probability of all rows by the penalized logit of the train split."""
    terms = _terms(numeric, categorical)
    learn = saved(logits.values(frame.where("split_name = 'train'"), terms).withColumn("fold", F.lit(0)), "logit-rows")
    plan = logits.design(learn, terms, whole=True)
    beta = logits.fit_penalized(learn, plan, [logits.Penalty(inverse)], 1)[0]
    drop(learn)
    names = {c: f"_k{i}" for i, c in enumerate(keep)}
    rows = filled(frame.withColumns({n: F.col(c) for c, n in names.items()}), numeric, categorical)
    fitted = logits.Fit([t.name for t in terms], beta, np.zeros((0, 0)), 0.0, 0.0)
    return logits.predicted(rows, plan, fitted, [*names.values()]).withColumnsRenamed({n: c for c, n in names.items()})


def cross_validate(df: DataFrame, model: str, numeric: list[str], categorical: list[str], id_col: str, grid: list[dict] | None = None, k: int = 5, seed: int = 42) -> list[dict]:
    """The grid's points (see ``_ranked``) of a model of pyspark.ml by average precision over k folds.

    Preprocessing is fitted on each fold's training part alone, once for all points. Logits that differ in C are fitted in
    the same passes, to the optimum of the loss that pyspark.ml comes near to.
    """
    reject_leakage([*numeric, *categorical])
    grid, found = grid or [{}], []
    data = saved(folds(filled(df, numeric, categorical), id_col, k).select(*numeric, *categorical, F.col("label").cast("double").alias("label"), "fold"), "folds")
    if _shares_passes(model, grid):
        found = _logits_by_folds(data, numeric, categorical, grid, k)
        drop(data)
        return _ranked(grid, found)
    for i in range(k):
        learn = balanced(data.where(F.col("fold") != i))
        before = Pipeline(stages=preprocessor(numeric, categorical)).fit(learn)
        parts = [saved(before.transform(x).select("features", "label", "class_weight"), "fold") for x in (learn, data.where(F.col("fold") == i).withColumn("class_weight", F.lit(1.0)))]
        found.append(_precision_of_points(*parts, model, grid, seed))
        for part in parts:
            drop(part)
    drop(data)
    return _ranked(grid, found)


# --- boosted trees -------------------------------------------------------------------------------------------------


def _binned(frame: DataFrame, numeric: list[str], categorical: list[str], keep: list[str], k: int, bins: int = boosting.BINS) -> tuple[DataFrame, list]:
    """Rows of all splits with key, fold and bins, and the bins' edges. Edges and levels come from the train split as a
    whole; they depend on no label. fold: 0 to k - 1 in train, k in validation, -1 elsewhere."""
    train = filled(frame.where("split_name = 'train'"), numeric, categorical)
    before = Pipeline(stages=preprocessor(numeric, categorical)).fit(train)
    split = F.when(F.col("split_name") == "validation", k).otherwise(-1).cast("int")
    rows = folds(frame.where("split_name = 'train'"), keep[0], k).unionByName(frame.where("split_name <> 'train' or split_name is null").withColumn("fold", split))
    rows = rows.withColumns({"key": F.xxhash64(*keep), **{f"_k{i}": F.col(c) for i, c in enumerate(keep)}})
    rows = before.transform(filled(rows, numeric, categorical))
    learn = before.transform(train)
    one = learn.select(F.size(vector_to_array("features")).alias("n")).first()
    cuts = boosting.cut_points(learn, "features", one.n if one else 0, bins)
    held = ["key", "fold", *(f"_k{i}" for i in range(len(keep)))]
    rows = boosting.binned(rows, "features", cuts, held).withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})
    return saved(rows.withColumn("label", F.col("label").cast("double")), "boosting-rows"), cuts


def boosted(frame: DataFrame, model: str, numeric: list[str], categorical: list[str], keep: list[str], grid: list[dict], k: int = 5, seed: int = 42) -> tuple[list[dict], DataFrame]:
    """(points of the grid, best first, as ``_ranked`` has them; scores of all rows by the best one: ``keep``, predicted_probability).

    Gradient boosting is searched over k folds of train; points that differ in their rounds are one fit, of which the
    shorter one is the beginning. Regularized boosting is searched on the validation split. All fits run side by side.
    """
    reject_leakage([*numeric, *categorical])
    base, by_folds = BOOSTED[model], model == "gradient_boosting"
    rows, cuts = _binned(frame, numeric, categorical, keep, k)
    tries = [{**base, **p} for p in grid]
    most = {}  # the most rounds of points that are alike but for these
    for t in tries:
        alike = json.dumps({**t, "rounds": 0}, sort_keys=True)
        most[alike] = max(most.get(alike, 0), t["rounds"])
    fits = [({**json.loads(alike), "rounds": n}, held) for alike, n in most.items() for held in (range(k) if by_folds else [k])]
    learn = rows.where(f"fold between 0 and {k - 1 if by_folds else k}")
    models = boosting.grow(learn, [boosting.Point(**p, held=held) for p, held in fits], cuts, seed)
    pairs = [(i, held, j) for i, t in enumerate(tries) for j, (p, held) in enumerate(fits) if {**p, "rounds": 0} == {**t, "rounds": 0}]
    found = boosting.scores(learn, [models[j] for _, _, j in pairs], ["fold", "label"], [tries[i]["rounds"] for i, _, _ in pairs])
    held = F.element_at(F.array(*(F.lit(h) for _, h, _ in pairs)), F.col("point") + 1)
    area = {r.point: r.pr_auc for r in metrics.auc(found.where(F.col("fold") == held), ["point"]).collect()}
    of_fold = [[next(area.get(n) for n, (i, h, _) in enumerate(pairs) if (i, h) == (own, fold)) for own in range(len(grid))] for fold in (range(k) if by_folds else [k])]
    ranked = _ranked(grid, of_fold)
    best = grid.index(ranked[0]["params"])
    if by_folds:  # no fold is held: trees learn from the whole of train
        final = boosting.grow(rows.where(f"fold between 0 and {k - 1}"), [boosting.Point(**tries[best], held=k)], cuts, seed)[0]
    else:
        final = next(models[j] for i, _, j in pairs if i == best)
    return ranked, boosting.scores(rows, [final], keep).drop("point")


# --- forests -------------------------------------------------------------------------------------------------------

# What a point of a forest's grid leaves open.
FOREST = {"numTrees": 40, "maxDepth": 8, "minInstancesPerNode": 1, "featureSubsetStrategy": "auto"}


def _forests(rows: DataFrame, grid: list[dict], layout: bagging.Layout, counts: dict[int, tuple[int, int]], held: int, seed: int) -> tuple[list, list]:
    """(forests, wanted) as ``bagging.scores`` takes them, of all points on the folds that are not held. Points with as many features tried
    at a node share their trees: the most that one has, with the most levels, in variants by the rows that a side must have."""
    learnt = [c for fold, c in counts.items() if fold != held]
    sums = [sum(c[i] for c in learnt) for i in (0, 1)]
    weights = tuple(sum(sums) / (2 * n) if n else 1.0 for n in sums)
    tries, shared = [{**FOREST, **p} for p in grid], {}
    for i, t in enumerate(tries):
        shared.setdefault(bagging.features_tried(t["featureSubsetStrategy"], len(layout.sizes), t["numTrees"]), []).append(i)
    least = {take: tuple(sorted({tries[i]["minInstancesPerNode"] for i in at})) for take, at in shared.items()}
    bags = [bagging.Bag(n, take, least[take], max(tries[i]["maxDepth"] for i in at), held, seed, weights) for take, at in shared.items() for n in range(max(tries[i]["numTrees"] for i in at))]
    trees, made, wanted = bagging.grow(rows, bags, layout, {held: sum(sums)}), [], []
    for take, at in shared.items():
        own = [t for t, b in zip(trees, bags, strict=True) if b.take == take]
        for variant, rows_least in enumerate(least[take]):
            mine = [i for i in at if tries[i]["minInstancesPerNode"] == rows_least]
            depths = sorted({tries[i]["maxDepth"] for i in mine})
            wanted += [(i, len(made), tries[i]["numTrees"], depths.index(tries[i]["maxDepth"])) for i in mine]
            made.append([(t.steps(variant), len(t.levels(variant)) - 1, [t.votes(variant, depth, weights) for depth in depths]) for t in own])
    return made, wanted


def bagged(frame: DataFrame, numeric: list[str], categorical: list[str], keep: list[str], grid: list[dict], k: int = 5, seed: int = 42) -> tuple[list[dict], DataFrame]:
    """(points of the grid, best first, as ``_ranked`` has them; scores of all rows by the best one: ``keep``, predicted_probability).

    A fold's points share trees and passes. One point is not searched. Bin edges and levels come from the whole train split.
    """
    reject_leakage([*numeric, *categorical])
    rows, cuts = _binned(frame, numeric, categorical, keep, k, bagging.BINS)
    layout, train = bagging.Layout([len(c) + 1 for c in cuts]), rows.where(f"fold between 0 and {k - 1}")
    counts, ranked = bagging.counts_by_fold(train), [{"params": p, "folds": [], "mean": None} for p in grid]
    if len(grid) > 1:
        found = []
        for held in range(k):
            scored = bagging.scores(train.where(F.col("fold") == held), ["label"], *_forests(train, grid, layout, counts, held, seed))
            area = {r.point: r.pr_auc for r in metrics.auc(scored, ["point"]).collect()}
            found.append([area.get(i) for i in range(len(grid))])
        ranked = _ranked(grid, found)
    final = _forests(train, [ranked[0]["params"]], layout, counts, -1, seed)
    return ranked, bagging.scores(rows, keep, *final).drop("point")


def calibrate(validation: DataFrame, scored: DataFrame, method: str = "isotonic") -> DataFrame:
    """``scored`` with calibrated predicted_probability, fitted on ``validation`` (predicted_probability, label)."""
    if method == "isotonic":
        model = IsotonicRegression(featuresCol="predicted_probability", labelCol="label", predictionCol="calibrated").fit(validation.select("predicted_probability", "label"))
        return model.transform(scored).drop("predicted_probability").withColumnRenamed("calibrated", "predicted_probability")
    assemble = VectorAssembler(inputCols=["predicted_probability"], outputCol="features__")
    model = LogisticRegression(featuresCol="features__", labelCol="label", probabilityCol="calibrated", rawPredictionCol="raw__", predictionCol="hard__").fit(assemble.transform(validation))
    out = model.transform(assemble.transform(scored)).withColumn("calibrated", vector_to_array("calibrated")[1])
    return out.drop("predicted_probability", "features__", "raw__", "hard__").withColumnRenamed("calibrated", "predicted_probability")


def train_and_score(frame: DataFrame, model: str, numeric: list[str], categorical: list[str], run_id: str, id_cols: list[str], grid: list[dict] | None = None, k: int = 5, method: str = "isotonic") -> DataFrame:
    """Scores of all splits: parameters chosen from the grid (default: one point), fitted on train, calibrated on validation,
    threshold chosen on validation. The frame is written once, as every pass of a fit reads it."""
    reject_leakage([*numeric, *categorical])
    keep, grid = [*id_cols, "split_name", "label"], grid or [{}]
    frame = saved(frame.select(*dict.fromkeys([*keep, *numeric, *categorical])), "model-frame")
    if model in BOOSTED:
        scored = boosted(frame, model, numeric, categorical, keep, grid, k)[1]
    elif model == "random_forest" and all(p.keys() <= FOREST.keys() for p in grid):
        scored = bagged(frame, numeric, categorical, keep, grid, k)[1]
    else:
        train = frame.where("split_name = 'train'")
        best = cross_validate(train, model, numeric, categorical, id_cols[0], grid, k)[0]["params"] if len(grid) > 1 else grid[0]
        if _shares_passes(model, [best]):
            scored = _logit_scores(frame, numeric, categorical, keep, best["C"])
        else:
            learn = balanced(filled(train, numeric, categorical))
            before = Pipeline(stages=preprocessor(numeric, categorical)).fit(learn)
            rows = filled(frame.withColumns({f"_k{i}": F.col(c) for i, c in enumerate(keep)}), numeric, categorical)
            rows, (p,) = learned(model, [best], before.transform(learn), float(train.count()))(before.transform(rows))
            scored = rows.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), p.alias("predicted_probability"))
    scored = saved(scored, "scores")
    drop(frame)
    scored = calibrate(scored.where("split_name = 'validation'"), scored, method)
    best = metrics.best_threshold(scored.where("split_name = 'validation'"), [], metrics.coarse_grid()).select("decision_threshold")
    out = scored.crossJoin(F.broadcast(best)).withColumn("predicted_label", (F.col("predicted_probability") >= F.col("decision_threshold")).cast("int"))
    return out.withColumns({"model_name": F.lit(model), "run_id": F.lit(run_id)})


def training_audit(scores: DataFrame, id_col: str, split_version: str) -> DataFrame:
    """One row for each model, run and split."""
    by = ["model_name", "run_id", "split_name"]
    top = metrics.top_k(scores, [0.05, 0.10], by, id_col)
    wide = top.groupBy(*by).agg(*(F.max(F.when(F.col("selected_fraction") == f, F.col(c))).alias(f"top_{n}_{short}") for f, n in ((0.05, 5), (0.10, 10)) for c, short in (("capture_rate", "capture_rate"), ("lift_at_k", "lift"))))
    base = metrics.classification(scores, F.col("decision_threshold"), [*by, "decision_threshold"])
    areas = metrics.auc(scores, by).withColumnsRenamed({"roc_auc": "area_under_roc", "pr_auc": "area_under_pr"})
    return base.join(wide, by).join(areas, by).withColumns({"shared_split_version": F.lit(split_version), "processed_at_utc": F.current_timestamp()})


# --- selection of variables ----------------------------------------------------------------------------------------

# The candidate terms of the selection, and the blocks that are tested together.
TERMS = [
    Term("age_years_imputed", core=True),
    Term("sex", factor=True, core=True),
    Term("race_code", factor=True, core=True),
    Term("enrollment_months_count", core=True),
    Term("chronic_condition_count_centered", core=True),
    Term("chronic_condition_count_centered_squared", parents=("chronic_condition_count_centered",)),
    Term("claims_per_enrollment_month"),
    Term("total_claim_days_log1p"),
    Term("provider_fragmentation_index"),
    Term("any_carrier_claim"),
]
BLOCKS = {
    "chronic_quadratic": ["chronic_condition_count_centered_squared"],
    "chronic_block": ["chronic_condition_count_centered", "chronic_condition_count_centered_squared"],
    "utilization_block": ["claims_per_enrollment_month", "total_claim_days_log1p", "provider_fragmentation_index", "any_carrier_claim"],
}


def derived_terms(df: DataFrame, train: DataFrame) -> DataFrame:
    """Chronic count centred by the training mean, its square, and log1p of claim days."""
    mean = train.agg(F.avg("chronic_condition_count").alias("_m"))
    centred = F.col("chronic_condition_count") - F.col("_m")
    days = F.log1p(F.greatest(F.col("total_claim_days").cast("double"), F.lit(0.0)))
    return df.crossJoin(F.broadcast(mean)).withColumns({"chronic_condition_count_centered": centred, "chronic_condition_count_centered_squared": centred * centred, "total_claim_days_log1p": days}).drop("_m")


STEPS = "run_id string, step int, removed string, aic double, bic double, parameters int, terms string"
RATIOS = "run_id string, block string, reduced_terms string, statistic double, degrees int, p_value double, full_aic double, reduced_aic double"
DIAGNOSTICS = "run_id string, scope string, kind string, a string, b string, correlation double, vif double, flag boolean"
ESTIMATES = "run_id string, term string, coefficient double, standard_error double, z double, p_value double, odds_ratio double, low double, high double"
SELECTION = "run_id string, row_count long, positive_count long, candidate_terms string, final_terms string, removed_count int, log_likelihood double, aic double, bic double, parameters int"


def _table(spark, rows: list[dict], schema: str, run_id: str) -> DataFrame:
    """The rows under a schema; where there are none, one row with the run alone, so that the run is seen to have had none."""
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple({"run_id": run_id, **r}.get(n) for n in names) for r in rows or [{}]], schema)


def selection_tables(df: DataFrame, run_id: str, terms: list[Term] = TERMS, blocks: dict[str, list[str]] = BLOCKS) -> dict[str, DataFrame]:
    """audit (one row), steps, diagnostics (of all candidates and of the selected terms), ratios and coefficients of one
    selection of variables: their rows follow the terms, not the data."""
    spark, rows = df.sparkSession, saved(logits.values(df, terms), "selection")
    plan = logits.design(rows, terms)
    steps, final = logits.backward_selection(rows, plan)
    counts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).cast("long").alias("p")).first()
    names = [t.name for t in terms]
    audit = {"row_count": counts.n, "positive_count": counts.p, "candidate_terms": ",".join(names), "final_terms": ",".join(final.terms), "removed_count": len(names) - len(final.terms), "log_likelihood": final.log_likelihood, "aic": final.aic, "bic": final.bic, "parameters": final.parameters}
    ratios = logits.likelihood_ratios(rows, plan, final.terms, blocks, whole=final)
    diagnostics = logits.collinearity(rows, plan, {"all_candidates": names, "selected": final.terms})
    drop(rows)
    made = {"audit": ([audit], SELECTION), "steps": (steps, STEPS), "diagnostics": (diagnostics, DIAGNOSTICS), "ratios": (ratios, RATIOS), "coefficients": (logits.coefficient_rows(final, plan), ESTIMATES)}
    return {n: _table(spark, r, schema, run_id) for n, (r, schema) in made.items()}


def search_table(spark, found: list[dict], model: str, run_id: str) -> DataFrame:
    """(run_id, model_name, place, params, mean_average_precision, fold_average_precision) of a search."""
    rows = [(run_id, model, i + 1, json.dumps(r["params"], sort_keys=True), float(r["mean"]), [None if x is None else float(x) for x in r.get("folds", [])]) for i, r in enumerate(found)]
    return spark.createDataFrame(rows, "run_id string, model_name string, place int, params string, mean_average_precision double, fold_average_precision array<double>")
