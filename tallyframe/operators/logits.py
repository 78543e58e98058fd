"""Logits of terms that are numbers or factors, all candidate models fitted by the same passes over the rows.

A design has one column for each number and one for each level of a factor but the first. A Newton step of any number of
models is one pass that sums their gradients and Hessians; sums have the size of the design, so rows stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands for a factor's missing value.
UNKNOWN = "unknown"
NEWTON_STEPS = 50
#: Tasks whose sums are added up in one step.
LANES = 64


@dataclass(frozen=True)
class Term:
    """A term of a model; one with ``core`` stays, and one with ``parents`` needs these to stay."""

    name: str
    factor: bool = False
    core: bool = False
    parents: tuple[str, ...] = ()


@dataclass(frozen=True)
class Design:
    """The columns of terms: numbers are centred and divided by their deviation, factors have a column for each level but the
    first, or with ``whole`` for each level."""

    terms: tuple[Term, ...]
    levels: dict[str, tuple[str, ...]]
    mean: dict[str, float]
    scale: dict[str, float]
    whole: bool = False

    def _shown(self, factor: str) -> tuple[str, ...]:
        return self.levels[factor] if self.whole else self.levels[factor][1:]

    def columns(self) -> list[tuple[str, str]]:
        """(term, column) after the intercept, in order."""
        return [(t.name, f"{t.name}_{level}") for t in self.terms if t.factor for level in self._shown(t.name)] + [(t.name, t.name) for t in self.terms if not t.factor]

    def select(self, terms: list[str]) -> np.ndarray:
        """Places of the intercept and these terms' columns."""
        return np.array([0, *(i for i, (t, _) in enumerate(self.columns(), 1) if t in terms)])

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        out = [np.ones(len(batch))]
        for t in self.terms:
            if t.factor:
                out += [pc.equal(batch.column(t.name), level).to_numpy(zero_copy_only=False).astype(float) for level in self._shown(t.name)]
        out += [(batch.column(t.name).to_numpy() - self.mean[t.name]) / self.scale[t.name] for t in self.terms if not t.factor]
        return np.stack(out, axis=1)


def values(df: DataFrame, terms: list[Term], label: str = "label") -> DataFrame:
    """Terms and label: missing numbers are 0, missing levels UNKNOWN."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))
    return df.select(*((level if t.factor else number)(t.name).alias(t.name) for t in terms), F.col(label).cast("double").alias(label))


def design(rows: DataFrame, terms: list[Term], whole: bool = False) -> Design:
    """The design of training rows (of ``values``). A number without spread is divided by 1; levels are in order."""
    numbers, factors = [t.name for t in terms if not t.factor], [t.name for t in terms if t.factor]
    got = rows.agg(F.count("*").alias("_n"), *(F.avg(c).alias(f"m_{c}") for c in numbers), *(F.stddev_pop(c).alias(f"s_{c}") for c in numbers), *(F.sort_array(F.collect_set(c)).alias(f"l_{c}") for c in factors)).first()
    return Design(tuple(terms), {c: tuple(got[f"l_{c}"]) for c in factors}, {c: got[f"m_{c}"] or 0.0 for c in numbers}, {c: got[f"s_{c}"] or 1.0 for c in numbers}, whole)


def _summed(rows: DataFrame, sizes: int, measure) -> np.ndarray:
    """The sum over all rows of an array that ``measure`` makes of a batch; added up by tasks, then by lanes of tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(sizes)
        for batch in batches:
            if len(batch):
                total += measure(batch)
        context = TaskContext.get()
        yield pa.RecordBatch.from_arrays([pa.array([(context.partitionId() if context else 0) % LANES], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["lane", "sums"])

    def add(group: pa.Table) -> pa.Table:
        return pa.table({"lane": group.column("lane")[:1], "sums": pa.array([sum(np.frombuffer(x.as_buffer(), np.float64) for x in group.column("sums")).tobytes()], pa.binary())})

    parts = rows.mapInArrow(partial, "lane int, sums binary").groupBy("lane").applyInArrow(add, "lane int, sums binary").collect()
    return sum((np.frombuffer(r.sums, np.float64) for r in parts), np.zeros(sizes))


@dataclass
class Fit:
    """One model: coefficients of the scaled design with the intercept first, and what its last pass summed."""

    terms: list[str]
    coefficients: np.ndarray
    information: np.ndarray
    log_likelihood: float
    rows: float

    @property
    def parameters(self) -> int:
        return len(self.coefficients)

    @property
    def aic(self) -> float:
        return 2 * self.parameters - 2 * self.log_likelihood

    @property
    def bic(self) -> float:
        return self.parameters * math.log(max(self.rows, 1)) - 2 * self.log_likelihood


def _begin(plan: Design, terms: list[str], near: Fit | None) -> np.ndarray:
    """Where a model's steps begin: 0, or what a fit of these and more terms comes to without the others, by its information."""
    places = plan.select(terms)
    if near is None or not set(terms) <= set(near.terms):
        return np.zeros(len(places))
    whole = plan.select(near.terms)
    kept = np.isin(whole, places)
    moved = near.information[np.ix_(kept, ~kept)] @ near.coefficients[~kept]
    return near.coefficients[kept] + np.linalg.pinv(near.information[np.ix_(kept, kept)], rcond=1e-10, hermitian=True) @ moved


def fit_all(rows: DataFrame, plan: Design, subsets: list[list[str]], label: str = "label", tolerance: float = 1e-9, near: Fit | None = None) -> list[Fit]:
    """A logit for each list of terms; a pass over the rows is one Newton step of all models that still move.

    A step that lowers the likelihood is halved. A step that promises a rise of less than a thousandth of the tolerance is
    the last one, and needs no pass to be seen. Collinear columns share their effect (least squares by pseudo-inverse),
    and a model that separates the classes ends after ``NEWTON_STEPS``. Models within ``near`` begin beside it.
    """
    places = [plan.select(s) for s in subsets]
    sizes = [2 + len(p) + len(p) ** 2 for p in places]
    now = [_begin(plan, s, near) for s in subsets]
    best: list[tuple[float, np.ndarray, np.ndarray] | None] = [None] * len(subsets)
    step = [np.zeros(len(p)) for p in places]
    moving, counted = list(range(len(subsets))), 0.0

    for _ in range(NEWTON_STEPS):
        at = {i: now[i] for i in moving}

        def measure(batch: pa.RecordBatch, at=at) -> np.ndarray:
            x, y, out = plan.matrix(batch), batch.column(label).to_numpy(), []
            for i, beta in at.items():
                part = x[:, places[i]]
                eta = part @ beta
                p = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                likelihood = (y * eta - np.logaddexp(0, eta)).sum()
                out += [[likelihood, len(y)], part.T @ (y - p), (part.T @ (part * (p * (1 - p))[:, None])).ravel()]
            return np.concatenate(out)

        sums, low, still = _summed(rows, sum(sizes[i] for i in moving), measure), 0, []
        for i in moving:
            k, found = len(places[i]), sums[low : low + sizes[i]]
            low += sizes[i]
            likelihood, counted = found[0], found[1]
            gradient, information = found[2 : 2 + k], found[2 + k :].reshape(k, k)
            least = tolerance * (abs(likelihood) + 1)
            if best[i] is not None and likelihood < best[i][0] - least:
                step[i] = step[i] / 2
                if np.abs(step[i]).max() > 1e-12:
                    now[i] = best[i][1] + step[i]
                    still.append(i)
                continue
            rise = math.inf if best[i] is None else likelihood - best[i][0]
            step[i] = np.linalg.pinv(information, rcond=1e-10, hermitian=True) @ gradient
            promised = float(step[i] @ gradient) / 2
            if promised <= least / 1000:
                best[i] = (likelihood + promised, now[i] + step[i], information)
                continue
            best[i] = (likelihood, now[i], information)
            if rise > least:
                now[i] = now[i] + step[i]
                still.append(i)
        moving = still
        if not moving:
            break
    return [Fit(list(s), b[1], b[2], float(b[0]), float(counted)) for s, b in zip(subsets, best, strict=True)]


def predicted(rows: DataFrame, plan: Design, fit: Fit, keep: list[str]) -> DataFrame:
    """``keep`` and predicted_probability of rows (of ``values``; they may have more columns). A level that the design lacks counts as the first one."""
    fields, places = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes), plan.select(fit.terms)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(plan.matrix(batch)[:, places] @ fit.coefficients, -500, 500))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p)], [*keep, "predicted_probability"])

    return rows.mapInArrow(scored, f"{fields}, predicted_probability double")


@dataclass(frozen=True)
class Penalty:
    """A logit of all terms whose rows weigh the same in either class. ``inverse`` (C) is the inverse strength of a penalty on the squares of
    coefficients, each in deviations of its column; ``held``: the fold that it does not learn from."""

    inverse: float
    held: int = -1


def _fold_sums(rows: DataFrame, plan: Design, folds: int, label: str) -> np.ndarray:
    """For each fold, class and column of the design: rows, sum and sum of squares."""
    wide = len(plan.columns()) + 1

    def measure(batch: pa.RecordBatch) -> np.ndarray:
        x, out = plan.matrix(batch), np.zeros((folds, 2, 2, wide))
        y, fold = batch.column(label).to_numpy() > 0, batch.column("fold").to_numpy()
        for f in range(folds):
            for c in (0, 1):
                part = x[(fold == f) & (y == c)]
                out[f, c] = part.sum(axis=0), (part**2).sum(axis=0)
        return out.ravel()

    return _summed(rows, folds * 4 * wide, measure).reshape(folds, 2, 2, wide)


def fit_penalized(rows: DataFrame, plan: Design, penalties: list[Penalty], folds: int, label: str = "label", tolerance: float = 1e-12) -> list[np.ndarray]:
    """Coefficients of all penalized logits on ``rows`` (of ``values``, with fold: 0 to folds - 1), from the same Newton passes.

    The intercept has no penalty. A column without spread in the rows that a model learns from has no effect there. Where
    these are of one class, the intercept alone tells it.
    """
    sums, wide = _fold_sums(rows, plan, folds, label), len(plan.columns()) + 1
    weights, ridge, active, now, moving = [], [], [], [], []
    for i, p in enumerate(penalties):
        learn = sums[[f for f in range(folds) if f != p.held]].sum(axis=0)
        n = learn[:, 0, 0]
        both = bool(n.min() > 0)
        w = n.sum() / (2 * np.maximum(n, 1))
        total, squares = (w * n).sum(), (w**2 * n).sum()
        mean = (w[:, None] * learn[:, 0]).sum(axis=0) / max(total, 1e-300)
        spread = np.maximum((w[:, None] * learn[:, 1]).sum(axis=0) - total * mean**2, 0.0)
        spread = np.where(spread > 1e-9 * np.maximum(total * mean**2, 1.0), spread / max(total - squares / max(total, 1e-300), 1e-300), 0.0)
        weights.append(w)
        active.append(np.array([0, *np.flatnonzero(spread[1:] > 0) + 1]))
        ridge.append(total / (p.inverse * max(n.sum(), 1)) * np.where(np.arange(wide) > 0, spread, 0.0))
        now.append(np.zeros(wide))
        if both:
            moving.append(i)
        else:
            now[i][0] = 30.0 if n[1] else -30.0
    best: list[tuple[float, np.ndarray] | None] = [None] * len(penalties)
    step = [np.zeros(wide) for _ in penalties]
    size = 1 + wide + wide**2
    for _ in range(NEWTON_STEPS):
        if not moving:
            break
        at = {i: now[i] for i in moving}

        def measure(batch: pa.RecordBatch, at=at) -> np.ndarray:
            x, y, fold, out = plan.matrix(batch), batch.column(label).to_numpy(), batch.column("fold").to_numpy(), {}
            for held in dict.fromkeys(penalties[i].held for i in at):
                learn = fold != held
                part, own = x[learn], y[learn]
                for i in (i for i in at if penalties[i].held == held):
                    eta, w = part @ at[i], np.where(own > 0, weights[i][1], weights[i][0])
                    p = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
                    likelihood = (w * (own * eta - np.logaddexp(0, eta))).sum()
                    out[i] = [[likelihood], part.T @ (w * (own - p)), (part.T @ (part * (w * p * (1 - p))[:, None])).ravel()]
            return np.concatenate([x for i in at for x in out[i]])

        found, still = _summed(rows, size * len(moving), measure).reshape(len(moving), size), []
        for i, got in zip(moving, found, strict=True):
            value = got[0] - (ridge[i] * now[i] ** 2).sum() / 2
            least = tolerance * (abs(value) + 1)
            if best[i] is not None and value < best[i][0] - least:
                step[i] = step[i] / 2
                if np.abs(step[i]).max() > 1e-12:
                    now[i] = best[i][1] + step[i]
                    still.append(i)
                else:
                    now[i] = best[i][1]
                continue
            gradient = got[1 : 1 + wide] - ridge[i] * now[i]
            information = got[1 + wide :].reshape(wide, wide) + np.diag(ridge[i])
            best[i], a = (value, now[i]), active[i]
            step[i] = np.zeros(wide)
            step[i][a] = np.linalg.pinv(information[np.ix_(a, a)], rcond=1e-14, hermitian=True) @ gradient[a]
            now[i] = now[i] + step[i]
            if step[i] @ gradient / 2 > least:
                still.append(i)
        moving = still
    return now


def predicted_by_folds(rows: DataFrame, plan: Design, penalties: list[Penalty], coefficients: list[np.ndarray], label: str = "label") -> DataFrame:
    """(point: place among ``penalties``, label, predicted_probability) of the rows that each model holds out."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y, fold = plan.matrix(batch), batch.column(label).to_numpy(), batch.column("fold").to_numpy()
            for i, (p, beta) in enumerate(zip(penalties, coefficients, strict=True)):
                own = fold == p.held
                score = 1 / (1 + np.exp(-np.clip(x[own] @ beta, -500, 500)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i, np.int32)), pa.array(y[own]), pa.array(score)], ["point", "label", "predicted_probability"])

    return rows.mapInArrow(scored, "point int, label double, predicted_probability double")


def violations(terms: list[str], specs: dict[str, Term]) -> list[tuple[str, str]]:
    """(term, parent that is missing)."""
    return [(t, p) for t in terms for p in specs[t].parents if p not in terms]


def backward_selection(rows: DataFrame, plan: Design, label: str = "label") -> tuple[list[dict], Fit]:
    """Steps of dropping the term whose loss lowers AIC most, until none does, and the last model.

    Core terms stay, and so do terms that others need. All terms of a step are tried in the same passes.
    """
    specs = {t.name: t for t in plan.terms}
    now = [t.name for t in plan.terms]
    if missing := violations(now, specs):
        raise ValueError(f"terms need others that are not there: {missing}")
    best = fit_all(rows, plan, [now], label)[0]
    steps = [{"step": 0, "removed": None, "aic": best.aic, "bic": best.bic, "parameters": best.parameters, "terms": ",".join(now)}]
    while True:
        needed = {p for t in now for p in specs[t].parents}
        free = sorted(t for t in now if not specs[t].core and t not in needed)
        if not free:
            return steps, best
        tried = fit_all(rows, plan, [[x for x in now if x != t] for t in free], label, near=best)
        gone, found = min(zip(free, tried, strict=True), key=lambda x: x[1].aic)
        if found.aic >= best.aic:
            return steps, best
        best, now = found, found.terms
        steps.append({"step": len(steps), "removed": gone, "aic": best.aic, "bic": best.bic, "parameters": best.parameters, "terms": ",".join(now)})


def chi_square_tail(x: float, k: int) -> float:
    """Upper tail of chi-square with k degrees of freedom: the finite sums of half-integer orders."""
    if x <= 0:
        return 1.0
    if k % 2:
        tail, term, i = 2 * (1 - NormalDist().cdf(math.sqrt(x))) if x < 30 else math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 3
    else:
        tail, term, i = math.exp(-x / 2), math.exp(-x / 2) * x / 2, 4
    while i <= k:
        tail, term, i = tail + term, term * x / i, i + 2
    return tail


def likelihood_ratios(rows: DataFrame, plan: Design, terms: list[str], blocks: dict[str, list[str]], label: str = "label", whole: Fit | None = None) -> list[dict]:
    """The model without each block of terms against the whole one (fitted here, if not given); degrees are columns, so a factor counts levels - 1.

    Blocks with a term that is not in the model, or whose loss would leave a term without its parent, are left out.
    """
    specs = {t.name: t for t in plan.terms}
    left = {name: [t for t in terms if t not in block] for name, block in blocks.items() if set(block) <= set(terms)}
    left = {name: rest for name, rest in left.items() if not violations(rest, specs)}
    whole = whole or fit_all(rows, plan, [terms], label)[0]
    reduced = fit_all(rows, plan, list(left.values()), label, near=whole) if left else []
    out = []
    for name, fit in zip(left, reduced, strict=True):
        statistic, degrees = 2 * (whole.log_likelihood - fit.log_likelihood), whole.parameters - fit.parameters
        out.append({"block": name, "reduced_terms": ",".join(fit.terms), "statistic": statistic, "degrees": degrees, "p_value": chi_square_tail(statistic, degrees) if degrees else None, "full_aic": whole.aic, "reduced_aic": fit.aic})
    return out


def coefficient_rows(fit: Fit, plan: Design) -> list[dict]:
    """Per column of a model (numbers by standard deviation): estimate, standard error, z, p, odds ratio and its 95 % interval."""
    names = ["intercept", *(c for t, c in plan.columns() if t in fit.terms)]
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(fit.information, rcond=1e-10, hermitian=True)), 0.0))
    ratio = lambda x: math.exp(max(-700.0, min(x, 700.0)))
    out = []
    for name, b, e in zip(names, fit.coefficients.tolist(), errors.tolist(), strict=True):
        z = b / e if e else math.nan
        out.append({"term": name, "coefficient": b, "standard_error": e, "z": z, "p_value": math.erfc(abs(z) / math.sqrt(2)), "odds_ratio": ratio(b), "low": ratio(b - 1.96 * e), "high": ratio(b + 1.96 * e)})
    return out


def r_squared(correlation: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """R² of each column on all others: the matrix of the others is swept pivot by pivot, one that has lost all its
    variance to those before is skipped, and what is left of the column's own variance is 1 - R²."""
    k, out = len(correlation), np.zeros(len(correlation))
    for own in range(k):
        a = np.array(correlation, float)
        for i in (i for i in range(k) if i != own):
            if a[i, i] > tolerance:
                a = a - np.outer(a[:, i], a[i]) / a[i, i]
        out[own] = 1 - max(a[own, own], 0.0)
    return out


def collinearity(rows: DataFrame, plan: Design, scopes: dict[str, list[str]]) -> list[dict]:
    """Of the numbers of each scope: pairs whose absolute correlation is 0.7 or more (flag from 0.85 on), and variance
    inflation 1 / (1 - R²), infinite from an R² of 0.999999 on (flag from 10 on). A number without spread has R² 0."""
    names = [t.name for t in plan.terms if not t.factor]
    k = len(names)
    at = [i for i, (_, c) in enumerate(plan.columns(), 1) if c in names]

    def measure(batch: pa.RecordBatch) -> np.ndarray:
        x = plan.matrix(batch)[:, at]
        return np.concatenate([(x.T @ x).ravel(), x.sum(axis=0), [len(x)]])

    sums = _summed(rows, k * k + k + 1, measure)
    n, mean = max(sums[-1], 1), sums[k * k : -1] / max(sums[-1], 1)
    covariance = sums[: k * k].reshape(k, k) / n - np.outer(mean, mean)
    spread = np.sqrt(np.diag(covariance))
    flat = spread < 1e-9
    correlation = covariance / np.where(np.outer(flat, flat) | flat[:, None] | flat, np.inf, np.outer(spread, spread))
    np.fill_diagonal(correlation, 1.0)
    out = []
    for scope, terms in scopes.items():
        own = [names.index(t) for t in terms if t in names]
        if len(own) < 2:
            continue
        part = correlation[np.ix_(own, own)]
        pairs = [(abs(part[i, j]), names[own[i]], names[own[j]]) for i in range(len(own)) for j in range(i + 1, len(own))]
        for r, a, b in sorted((p for p in pairs if p[0] >= 0.7), key=lambda p: (-p[0], p[1:])):
            out.append({"scope": scope, "kind": "pairwise_correlation", "a": a, "b": b, "correlation": float(r), "vif": None, "flag": bool(r >= 0.85)})
        inflation = [(math.inf if r2 >= 0.999999 else 1 / (1 - r2), names[i]) for r2, i in zip(r_squared(part).tolist(), own, strict=True)]
        out += [{"scope": scope, "kind": "vif", "a": t, "b": None, "correlation": None, "vif": v, "flag": v >= 10} for v, t in sorted(inflation, key=lambda x: (-x[0], x[1]))]
    return out
