"""Weighted least-squares fits of many keys at once, as rounds of aggregates over their points.

Each model is a sum of basis functions times coefficients (see models). For given shape parameters, the sums of products of the basis functions,
their slopes and the area, over a lake's points, tell all there is to tell: the best coefficients, the cost, and how the cost with the best coefficients
changes with the shape (variable projection). So a round proposes a few shapes for each lake and model - steps of Levenberg's and Marquardt's
method, stretched ones for long valleys and damped ones - sums over all levels once, and keeps the best. Lakes and models that
have converged leave the rounds. The points of a lake may be any number, in any tasks: what is shuffled is one row of sums a task, lake, model and proposal.
As a curve depends on the level alone, points are summed once for each lake and distinct level (see levels), and rounds go over these sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.operators.models import Extent, Model, by_model
from hydroseries.sources.shared import write_shared

#: Proposals of a round: how far a step is stretched, and by what its damping is multiplied.
PROPOSALS = ((1.0, 1.0), (16.0, 1.0), (1.0, 32.0), (1.0, 2048.0))
#: A round that lowers the cost by less than this share of it (and of round-off in the sums) is the last one.
GAIN, ROUND_OFF = 1e-10, 1e-15
DAMPING, LEAST_DAMPING, MOST_DAMPING = 1e-3, 1e-12, 1e16
#: Relative to the largest one, an eigenvalue of scaled sums this small is round-off.
SINGULAR = 1e-13

STATE = "lake_id string, model int, h_mean double, shape array<double>, sums array<double>, cost double, damping double, used int, done boolean, fitted boolean, proposals array<array<double>>"


def _solved(gram: np.ndarray, side: np.ndarray, damping: float = 0.0) -> np.ndarray:
    """The least-squares solution of gram x = side, scaled to a unit diagonal first."""
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    x = np.linalg.lstsq(gram * np.outer(scale, scale) + damping * np.eye(len(gram)), (side.T * scale).T, rcond=SINGULAR)[0]
    return (x.T * scale).T


class _Sums:
    """The sums of products of a model's columns and the area (last), and what they tell."""

    def __init__(self, model: Model, flat: Sequence[float]):
        n = model.n_basis * (1 + model.n_shape) + 1
        width = round((math.sqrt(8 * len(flat) + 1) - 1) / 2)
        whole = np.zeros((width, width))
        whole[np.triu_indices(width)] = flat
        whole += np.triu(whole, 1).T
        at = [*range(n - 1), width - 1]  # other models may have more columns
        self.model, self.all = model, whole[np.ix_(at, at)]
        self.gram, self.side = self.all[: model.n_basis, : model.n_basis], self.all[: model.n_basis, -1]
        self.c = _solved(self.gram, self.side)
        self.cost = float(self.all[-1, -1] - 2 * self.side @ self.c + self.c @ self.gram @ self.c)

    @property
    def determined(self) -> bool:
        scale = 1 / np.sqrt(np.maximum(np.diag(self.gram), 1e-300))
        return bool(np.linalg.eigvalsh(self.gram * np.outer(scale, scale))[0] > 10 * SINGULAR)

    def _slopes(self) -> np.ndarray:
        """Slopes of the curve by shape parameters, as combinations of the columns."""
        m = self.model
        out = np.zeros((len(self.all), m.n_shape))
        for k in range(m.n_shape):
            out[m.n_basis * (k + 1) : m.n_basis * (k + 2), k] = self.c
        return out

    def step(self, damping: float) -> np.ndarray:
        """The step of shape parameters, with the coefficients solved for along the way."""
        s, b = self._slopes(), self.model.n_basis
        cross = (self.all @ s)[:b]
        hess = s.T @ self.all @ s - cross.T @ _solved(self.gram, cross)
        down = (self.all @ s)[-1] - cross.T @ self.c
        out, free = np.zeros(self.model.n_shape), [k for k in range(self.model.n_shape) if k not in self.model.held]
        out[free] = _solved(hess[np.ix_(free, free)], down[free], damping)
        return out

    def covariance(self) -> np.ndarray:
        """Of coefficients and shape parameters."""
        s = np.eye(len(self.all))[:, : self.model.n_basis]
        s = np.concatenate((s, self._slopes()), 1)
        return np.linalg.pinv(s.T @ self.all @ s)


def _start(models: Sequence[Model]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                for i, model in enumerate(models):
                    shape = [float(x) for x in model.start(Extent(row.h_min, row.h_max, row.a_min, row.a_max))]
                    out.append((row.lake_id, i, row.h_mean, shape, [], math.inf, DAMPING, 0, False, False, [shape]))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in STATE.split(", ")])

    return run


def _advance(models: Sequence[Model], limit: int):
    """Takes each lake and model on by the sums of its proposals: told, an array of (k, sums)."""

    def one(row) -> tuple:
        model = models[row.model]
        shape, sums, cost, damping, used = list(row.shape), list(row.sums), row.cost, row.damping, row.used + len(row.proposals)
        found = []
        for k, flat in [] if row.told is None else sorted((r["k"], list(r["sums"])) for r in row.told):
            if np.isfinite(flat).all():
                told = _Sums(model, flat)
                if math.isfinite(told.cost) and told.cost <= cost:
                    found.append((told.cost, k, told))
        done = False
        if found:
            new, k, told = min(found, key=lambda x: x[:2])
            gain, shape, sums = cost - new, list(row.proposals[k]), told.all[np.triu_indices(len(told.all))].tolist()
            damping = min(1.0, max(damping * PROPOSALS[k][1] / 9, LEAST_DAMPING)) if math.isfinite(cost) else damping
            done = gain <= GAIN * abs(new) + ROUND_OFF * told.all[-1, -1]
            cost = new
        elif math.isfinite(cost):
            damping *= 4 * PROPOSALS[-1][1]
        fitted = math.isfinite(cost)
        if not model.n_shape:
            fitted = fitted and told.determined
        done = done or not fitted or not model.n_shape or damping > MOST_DAMPING or used >= limit
        proposals = []
        if not done:
            told = _Sums(model, sums)
            proposals = [(np.array(shape) + stretch * told.step(damping * times)).tolist() for stretch, times in PROPOSALS]
        return row.lake_id, row.model, row.h_mean, shape, sums, cost, damping, used, done, fitted, proposals

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(r) for r in pdf.itertuples(index=False)], columns=[c.split(" ")[0] for c in STATE.split(", ")])

    return run


def _finish(models: Sequence[Model]):
    """params and param_errors, as reported, of each fitted lake and model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                model = models[row.model]
                told = _Sums(model, row.sums)
                values, spread = np.concatenate((told.c, row.shape)), told.covariance()
                if model.turn:
                    turn = model.turn(row.h_mean)
                    values, spread = turn @ values, turn @ spread @ turn.T
                errors, places = np.sqrt(np.maximum(np.diag(spread), 0)), list(model.places)
                out.append((row.lake_id, row.model, values[places].tolist(), errors[places].tolist()))
            yield pd.DataFrame(out, columns=["lake_id", "model", "params", "param_errors"])

    return run


def levels(points: DataFrame) -> DataFrame:
    """One row for each lake_id and distinct h of points (lake_id, h, a, sigma, without nulls): all that a curve of h alone can be told from.

    n, a_mean and a_off (the squares of a about a_mean, summed), a_min, a_max; w, wa and waa: the weights summed, times a, and times a squared.
    """
    w, a = 1.0 / (F.col("sigma") * F.col("sigma")), F.col("a")
    sums = [F.sum(w).alias("w"), F.sum(w * a).alias("wa"), F.sum(w * a * a).alias("waa")]
    return points.groupBy("lake_id", "h").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("a_mean"), (F.var_pop("a") * F.count(F.lit(1))).alias("a_off"), F.min("a").alias("a_min"), F.max("a").alias("a_max"), *sums)


def fit(at: DataFrame, extents: DataFrame, models: Sequence[Model], limit: int) -> DataFrame:
    """lake_id, model (its place in models), params and param_errors, for each lake and model that could be fitted.

    at: see levels; it is read once a round, so it should be written. extents: one row a lake, with the ends and mean of h and the ends of a.
    limit: evaluations of one model for one lake. A lake with fewer points than coefficients gets what least squares of the smallest size gives.
    """
    n_basis, width = max(m.n_basis for m in models), max(m.n_basis * (1 + m.n_shape) for m in models)
    level = lambda m: F.col("h") - F.col("h_mean") if m.turn else F.col("h")
    shape = lambda m: [F.get("shape", F.lit(k)) for k in range(m.n_shape)]

    def column(j: int, of) -> Column:
        return by_model(models, F.col("model"), lambda m: dict(enumerate(of(m))).get(j, F.lit(0.0))).cast("double").alias(f"x{j}")

    def slopes(m: Model) -> list[Column]:
        """In their places behind the model's own basis; places that are the basis's stay as they are."""
        basis = [F.col(f"x{i}") for i in range(m.n_basis)]
        return basis + m.slope_columns(level(m), shape(m), basis)

    # The basis first: slopes are told from it.
    basis = [column(j, lambda m: m.basis(level(m), shape(m))) for j in range(n_basis)]
    every = [column(j, slopes) for j in range(width)]
    x = [F.col(f"x{i}") for i in range(width)]
    product = lambda i, j: F.col("waa") if i == width else F.col("wa") * x[i] if j == width else F.col("w") * x[i] * x[j]
    products = F.array(*[F.sum(product(i, j)) for i in range(width + 1) for j in range(i, width + 1)]).alias("sums")
    state = write_shared(extents.select("lake_id", "h_mean", "h_min", "h_max", "a_min", "a_max").mapInPandas(_start(models), STATE), "fits")
    while not (open_ := state.where(~F.col("done"))).isEmpty():
        proposed = open_.select("lake_id", "model", "h_mean", F.posexplode("proposals").alias("k", "shape"))
        rows = at.join(proposed, "lake_id").withColumns({f"x{j}": c for j, c in enumerate(basis)})
        seen = rows.select("lake_id", "model", "k", "w", "wa", "waa", *every)
        sums = seen.groupBy("lake_id", "model", "k").agg(products)
        told = sums.groupBy("lake_id", "model").agg(F.collect_list(F.struct("k", "sums")).alias("told"))  # one a proposal
        moved = open_.join(told, ["lake_id", "model"], "left").mapInPandas(_advance(models, limit), STATE)
        state = write_shared(state.where("done").unionByName(moved), "fits")
    return state.where("fitted").mapInPandas(_finish(models), "lake_id string, model int, params array<double>, param_errors array<double>")
