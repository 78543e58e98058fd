"""Metrics of scores as aggregations: classification, ranking, capture and lift, calibration, reliability, drift.

Rankings see one row for each distinct score (counts are aggregated first) and run by range, so no task holds a
whole model. ``by`` names the columns that tell models, runs and splits apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import ranking
from tallyframe.operators.ranking import row_numbers, running

Y, P = "label", "predicted_probability"


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b.cast("double"), F.lit(0.0)))


def _number(c: Column) -> Column:
    return F.count(F.when(c, 1))


def classification(df: DataFrame, threshold: float | Column, by: list[str], y: str = Y, p: str = P) -> DataFrame:
    """Counts of the confusion matrix and what follows from them; a ratio without cases is 0."""
    limit = F.lit(threshold) if isinstance(threshold, float) else threshold
    said, true = F.col(p) >= limit, F.col(y) == 1
    out = df.groupBy(*by).agg(F.count("*").alias("row_count"), F.avg(y).alias("positive_rate"), _number(said & true).alias("true_positive"), _number(said & ~true).alias("false_positive"), _number(~said & true).alias("false_negative"), _number(~said & ~true).alias("true_negative"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier_score"))
    tp, fp, fn, tn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative", "true_negative"))
    out = out.withColumns({"accuracy": _ratio(tp + tn, F.col("row_count")), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "specificity": _ratio(tn, tn + fp), "f1_score": _ratio(2 * tp, 2 * tp + fp + fn)})
    return out.withColumn("misclassification_error", 1 - F.col("accuracy"))


def _per_score(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    return df.groupBy(*by, F.col(p).alias("s")).agg(F.count("*").alias("n"), F.sum(y).cast("double").alias("pos"))


def auc(df: DataFrame, by: list[str], y: str = Y, p: str = P) -> DataFrame:
    """roc_auc (rank sum, ties shared) and pr_auc (sum of precision times gain in recall, ties together); null with one class."""
    run = running(_per_score(df, by, y, p), by, [F.desc("s")], ["n", "pos"]).withColumnsRenamed({"n_upto": "cn", "pos_upto": "cp", "n_all": "tn", "pos_all": "tp"})
    neg_below = (F.col("tn") - F.col("tp")) - (F.col("cn") - F.col("cp"))
    pairs = F.sum(F.col("pos") * (neg_below + (F.col("n") - F.col("pos")) / 2))
    area = F.sum(F.when(F.col("tp") > 0, F.col("pos") / F.col("tp") * F.col("cp") / F.col("cn")))
    tp, tn = F.first("tp"), F.first("tn")
    one_class = (tp == 0) | (tp == tn)
    return run.groupBy(*by).agg(F.when(~one_class, pairs / F.nullif(tp * (tn - tp), F.lit(0.0))).alias("roc_auc"), F.when(~one_class, area).alias("pr_auc"))


def top_k(df: DataFrame, fractions: list[float], by: list[str], id_col: str, y: str = Y, p: str = P) -> DataFrame:
    """Per fraction f: the max(1, ceil(n f)) highest scores (ties by id), what they capture, precision and lift.

    The rank of a row is the count of higher scores plus its rank among equals; ids are ordered within one score only.
    """
    # the small table of scores meets the fractions: whole scores count at once, only the score at the cut is ordered
    scores = running(_per_score(df, by, y, p), by, [F.desc("s")], ["n", "pos"])
    scores = scores.select(*by, "s", "n", "pos", (F.col("n_upto") - F.col("n")).alias("before"), F.col("n_all").alias("rows"), F.col("pos_all").alias("positives"))
    cuts = scores.withColumn("selected_fraction", F.explode(F.array(*map(F.lit, fractions)))).withColumn("k", F.greatest(F.lit(1), F.ceil(F.round(F.col("rows") * F.col("selected_fraction"), 9))).cast("long"))
    cuts = cuts.where("before < k")
    whole = cuts.where("before + n <= k").select(*by, "selected_fraction", "rows", "positives", "k", F.col("pos"), (F.col("n") * F.col("s")).alias("score"))
    split = cuts.where("before + n > k").select(*by, "s", "selected_fraction", "rows", "positives", "k", "before")
    ids = df.select(*by, F.col(p).alias("s"), F.col(y).cast("double").alias("pos"), F.col(id_col).alias("_id")).join(split.select(*by, "s").distinct(), [*by, "s"], "left_semi")
    ids = row_numbers(ids, [*by, "s"], ["_id", "pos"]).withColumnRenamed("row_no", "_r").drop("group_rows")
    part = ids.join(split, [*by, "s"]).where("_r <= k - before").select(*by, "selected_fraction", "rows", "positives", "k", "pos", F.col("s").alias("score"))
    out = whole.unionByName(part).groupBy(*by, "selected_fraction").agg(F.first("k").alias("selected_count"), F.sum("pos").cast("long").alias("captured_positive_count"), F.first("positives").alias("_all"), F.first("rows").alias("_rows"), F.sum("score").alias("_score"))
    observed = F.col("captured_positive_count") / F.col("selected_count")
    return out.select(*by, "selected_fraction", "selected_count", "captured_positive_count", _ratio(F.col("captured_positive_count"), F.col("_all")).alias("capture_rate"), observed.alias("precision_at_k"), _ratio(observed, F.col("_all") / F.col("_rows")).alias("lift_at_k"), (F.col("_score") / F.col("selected_count")).alias("average_predicted_probability"))


def curve(df: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """Capture and lift from 1 to 20 percent."""
    return top_k(df, [i / 100 for i in range(1, 21)], by, id_col)


def calibration_summary(df: DataFrame, by: list[str], y: str = Y, p: str = P) -> DataFrame:
    out = df.groupBy(*by).agg(F.count("*").alias("row_count"), F.avg(p).alias("mean_prediction"), F.avg(y).alias("observed_rate"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier_score"))
    return out.withColumn("absolute_calibration_gap", F.abs(F.col("mean_prediction") - F.col("observed_rate")))


def score_deciles(df: DataFrame, by: list[str], id_col: str, descending: bool, p: str = P) -> DataFrame:
    """score_decile 1 to 10. descending: floor((rank - 1) * 10 / n) + 1; ascending: as quantile cuts of the ranks do."""
    ranked = row_numbers(df, by, [F.desc(p) if descending else F.asc(p), id_col])
    r, n = F.col("row_no") - 1, F.col("group_rows")
    decile = F.floor(r * 10 / n) + 1 if descending else F.greatest(F.lit(1), F.ceil(r * 10 / F.greatest(n - 1, F.lit(1))))
    return ranked.withColumn("score_decile", decile.cast("int")).drop("row_no", "group_rows")


def calibration_deciles(df: DataFrame, by: list[str], id_col: str, descending: bool = True, y: str = Y, p: str = P) -> DataFrame:
    out = score_deciles(df, by, id_col, descending, p).groupBy(*by, "score_decile").agg(F.count("*").alias("row_count"), F.avg(y).alias("observed_rate"), F.avg(p).alias("mean_predicted_probability"), F.min(p).alias("min_predicted_probability"), F.max(p).alias("max_predicted_probability"))
    return out.withColumn("calibration_gap", F.col("mean_predicted_probability") - F.col("observed_rate"))


def reliability(df: DataFrame, by: list[str], y: str = Y, p: str = P, bins: int = 10) -> DataFrame:
    """Bins closed to the right, the first one to the left too; empty bins are absent, scores outside 0..1 fall out."""
    edges = [i / bins for i in range(1, bins + 1)]
    at = F
    for i, edge in enumerate(edges):
        at = at.when(F.col(p) <= F.lit(edge), i)
    out = df.where((F.col(p) >= 0) & (F.col(p) <= 1)).withColumn("probability_bin", at).groupBy(*by, "probability_bin").agg(F.count("*").alias("row_count"), F.avg(y).alias("observed_rate"), F.avg(p).alias("mean_predicted_probability"))
    return out.withColumns({"bin_lower_bound": F.col("probability_bin") / bins, "bin_upper_bound": (F.col("probability_bin") + 1) / bins})


def best_threshold(df: DataFrame, by: list[str], grid: list[float], y: str = Y, p: str = P) -> DataFrame:
    """The threshold of the grid with the largest F1, the smallest among equals. Scores are counted by grid cell first."""
    cells = F.array(*map(F.lit, sorted(grid)))
    at = F.size(F.filter(cells, lambda g: g <= F.col(p)))  # thresholds that the score reaches
    counts = df.groupBy(*by, at.alias("reach")).agg(F.count("*").alias("n"), F.sum(y).cast("double").alias("pos"))
    each = counts.select(*by, "n", "pos", "reach", F.posexplode(cells).alias("i", "threshold"))
    said = F.col("reach") > F.col("i")
    sums = each.groupBy(*by, "threshold").agg(F.sum(F.when(said, F.col("pos")).otherwise(0.0)).alias("tp"), F.sum(F.when(said, F.col("n")).otherwise(0)).alias("said"), F.sum("pos").alias("pos"))
    sums = sums.withColumn("f1_score", _ratio(2 * F.col("tp"), F.col("said") + F.col("pos")))
    best = F.max_by(F.struct("threshold", "f1_score"), F.struct("f1_score", -F.col("threshold")))
    return sums.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.threshold").alias("decision_threshold"), F.col("b.f1_score").alias("f1_score"))


def coarse_grid() -> list[float]:
    return [round(0.1 + 0.05 * i, 2) for i in range(17)]


def fine_thresholds(df: DataFrame, by: list[str], p: str = P) -> DataFrame:
    """(by, threshold): of each group 0.01 to 0.99, and the exact percentiles of its scores (101 values)."""
    wide = ranking.quantiles(df, by, p, {f"q{i:03}": i / 100 for i in range(101)})
    fixed = [F.lit(i / 100) for i in range(1, 100)]
    return wide.select(*by, F.explode(F.array_distinct(F.array(*fixed, *(F.col(c).cast("double") for c in wide.columns if c not in by)))).alias("threshold"))


def best_of_thresholds(df: DataFrame, by: list[str], thresholds: DataFrame, y: str = Y, p: str = P) -> DataFrame:
    """The threshold of each group's own ones with the largest F1, the smallest among equals.

    Distinct scores and thresholds are ranked together by range: what a threshold reaches is the running count before it.
    """
    scores = _per_score(df.where(F.col(p).isNotNull()), by, y, p).withColumn("cut", F.lit(0))
    cuts = thresholds.select(*by, F.col("threshold").alias("s"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("pos"), F.lit(1).alias("cut"))
    run = running(scores.unionByName(cuts), by, [F.desc("s"), "cut"], ["n", "pos"]).where("cut = 1 and n_all > 0")
    run = run.withColumn("f1_score", _ratio(2 * F.col("pos_upto"), F.col("n_upto") + F.col("pos_all")))
    best = F.max_by(F.struct("s", "f1_score"), F.struct("f1_score", -F.col("s")))
    return run.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.s").alias("decision_threshold"), F.col("b.f1_score").alias("f1_score"))


def stability_index(expected: DataFrame, actual: DataFrame, c: str, bins: int = 10) -> DataFrame:
    """One row, psi: edges are linear quantiles of the expected values, equal edges are one, the last bin is closed,
    values outside fall out, shares are at least 1e-6. 0 where a side is empty or all edges are equal."""
    wide = ranking.quantiles(expected, [], c, {f"e{i:03}": i / bins for i in range(bins + 1)})
    edges = wide.select(F.array_sort(F.array_distinct(F.array(*(F.col(x).cast("double") for x in wide.columns)))).alias("edges"))
    edges = edges.where(F.element_at("edges", 1).isNotNull())
    both = expected.select(F.col(c).alias("x"), F.lit(0).alias("side")).unionAll(actual.select(F.col(c).alias("x"), F.lit(1).alias("side"))).where("x is not null")
    reach = F.size(F.filter("edges", lambda e: e <= F.col("x")))
    last = F.size("edges")
    cell = F.when(F.col("x") == F.element_at("edges", -1), last - 1).otherwise(reach)
    placed = both.crossJoin(F.broadcast(edges)).where(last >= 2).withColumn("cell", cell).withColumn("bins", last - 1).where("cell between 1 and bins")
    counts = placed.groupBy("cell").agg(F.max("edges").alias("edges"), F.sum(1 - F.col("side")).alias("e"), F.sum("side").alias("a"))
    total = counts.agg(F.sum("e").alias("te"), F.sum("a").alias("ta"), F.max(F.size("edges") - 1).alias("bins"), F.collect_list(F.struct("cell", "e", "a")).alias("c"))
    filled = total.select("te", "ta", F.explode(F.sequence(F.lit(1), "bins")).alias("cell"), F.expr("map_from_entries(transform(c, x -> struct(x.cell, struct(x.e, x.a))))").alias("m")).withColumn("v", F.try_element_at("m", "cell"))
    share = lambda n, t: F.greatest(F.coalesce(n, F.lit(0)) / F.greatest(t, F.lit(1)), F.lit(1e-6))
    e, a = share(F.col("v.e"), F.col("te")), share(F.col("v.a"), F.col("ta"))
    sides = filled.agg(F.sum((a - e) * F.log(a / e)).alias("psi"), F.max("te").alias("te"), F.max("ta").alias("ta"))
    empty = both.agg(F.count(F.when(F.col("side") == 0, 1)).alias("ne"), F.count(F.when(F.col("side") == 1, 1)).alias("na"))
    return sides.crossJoin(F.broadcast(empty)).select(F.when((F.col("ne") == 0) | (F.col("na") == 0), 0.0).otherwise(F.coalesce("psi", F.lit(0.0))).alias("psi"))
