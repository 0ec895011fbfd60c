"""Logistic mixed models by marginal likelihood, several fits at a time.

The random effects of a participant are written ``L u`` with standard normal ``u``, so every
parameter (fixed effects and the entries of ``L``) enters the linear predictor linearly once
``u`` is given. The marginal likelihood is an integral over ``u``, taken by Gauss-Hermite
nodes laid around the mode of each participant. Its gradient and information follow from
moments over the nodes; the driver takes Newton steps on their sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.session import cut_lineage

from .models import CAUCHY_SCALE, INTERCEPT, glmm_cells

#: Quadrature nodes per random effect.
NODES = 9
#: Cells of participants that are worked on together inside a task.
CELLS = 4096
#: Steps of a participant's mode search, and of halving a Newton step.
MODE_STEPS, HALVINGS = 50, 12


def lower(size: int) -> list[tuple[int, int]]:
    """Places of the lower triangle, row by row."""
    return [(i, j) for i in range(size) for j in range(i + 1)]


def nodes(size: int, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Product nodes of ``size`` dimensions and their log weights for ``exp(-t't)``."""
    t, w = np.polynomial.hermite.hermgauss(each)
    grid = np.stack(np.meshgrid(*[t] * size, indexing="ij"), axis=-1).reshape(-1, size)
    weight = np.stack(np.meshgrid(*[np.log(w)] * size, indexing="ij"), axis=-1).reshape(-1, size).sum(axis=1)
    return grid, weight


@dataclass(frozen=True)
class Cells:
    """Cells of several participants, one after the other: design, trials, hits and their starts."""

    x: np.ndarray
    trials: np.ndarray
    hits: np.ndarray
    starts: np.ndarray
    owner: np.ndarray


def cells_of(pdf: pd.DataFrame, width: int) -> Iterator[Cells]:
    """Participants of a batch in groups of about ``CELLS`` cells."""
    sizes = pdf["trials"].map(len).to_numpy()
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + CELLS, "right")))
        part, own = pdf.iloc[start:stop], sizes[start:stop]
        join = lambda name: np.concatenate(part[name].to_numpy()).astype(float)  # noqa: E731, B023
        x = join("x").reshape(-1, width)
        yield Cells(
            np.column_stack([np.ones(len(x)), x]), join("trials"), join("hits"),
            np.cumsum(own) - own, np.repeat(np.arange(len(own)), own),
        )
        start = stop


def log_likelihood(cells: Cells, eta: np.ndarray) -> np.ndarray:
    """Binomial log-likelihood of cells at linear predictors, summed by participant."""
    trials, hits = (v.reshape(-1, *[1] * (eta.ndim - 1)) for v in (cells.trials, cells.hits))
    return np.add.reduceat(hits * eta - trials * np.logaddexp(0, eta), cells.starts, axis=0)


def modes(cells: Cells, fixed: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most likely ``u`` of every participant and a root of the inverse curvature there.

    The penalised log-likelihood is concave; a Newton step that does not raise it is halved.
    """
    size = z.shape[1]
    count = len(cells.starts)
    u = np.zeros((count, size))
    height = log_likelihood(cells, fixed)
    for _ in range(MODE_STEPS):
        eta = fixed + (z * u[cells.owner]).sum(axis=1)
        mu = 1 / (1 + np.exp(-eta))
        slope = np.add.reduceat(z * (cells.hits - cells.trials * mu)[:, None], cells.starts) - u
        curve = np.add.reduceat(
            (z[:, :, None] * z[:, None, :]) * (cells.trials * mu * (1 - mu))[:, None, None], cells.starts
        ) + np.eye(size)
        step = np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
        if np.abs(step).max() < 1e-9:
            break
        for _ in range(HALVINGS):
            tried = u + step
            eta = fixed + (z * tried[cells.owner]).sum(axis=1)
            reached = log_likelihood(cells, eta) - (tried**2).sum(axis=1) / 2
            worse = reached < height - 1e-12 * np.abs(height)
            if not worse.any():
                break
            step[worse] /= 2
        better = reached >= height
        u[better], height[better] = tried[better], reached[better]
    return u, np.linalg.cholesky(np.linalg.inv(curve))


def marginal_sums(cells: Cells, theta: np.ndarray, random: Sequence[int], each: int) -> dict[str, np.ndarray]:
    """Log marginal likelihood, its gradient and its information, summed over participants.

    ``theta`` holds the fixed effects, then ``L`` row by row; ``random`` the columns of the design
    with a random effect. Given ``u`` the complete-data score is a sum over cells and its
    derivative has no curvature term, so the information is the mean complete information
    less the variance of the complete score over the nodes.
    """
    p, q = cells.x.shape[1], len(random)
    places = lower(q)
    root = np.zeros((q, q))
    for value, place in zip(theta[p:], places, strict=True):
        root[place] = value
    base = cells.x[:, list(random)]
    fixed, z = cells.x @ theta[:p], base @ root
    mode, spread = modes(cells, fixed, z)
    grid, weight = nodes(q, each)
    u = mode[:, None, :] + np.sqrt(2) * np.einsum("gab,kb->gka", spread, grid)
    eta = fixed[:, None] + np.einsum("ia,ika->ik", z, u[cells.owner])
    level = log_likelihood(cells, eta) - (u**2).sum(axis=2) / 2 + weight + (grid**2).sum(axis=1)
    top = level.max(axis=1, keepdims=True)
    mass = np.exp(level - top)
    total = mass.sum(axis=1, keepdims=True)
    share = mass / total
    log_root = np.log(np.abs(np.diagonal(spread, axis1=1, axis2=2))).sum(axis=1)
    value = (top + np.log(total))[:, 0] + log_root - q / 2 * np.log(np.pi)

    mu = 1 / (1 + np.exp(-eta))
    rest = cells.hits[:, None] - cells.trials[:, None] * mu
    score = np.stack(
        [np.add.reduceat(rest * cells.x[:, j, None], cells.starts, axis=0) for j in range(p)], axis=2
    )
    # the entry (i, j) of L multiplies u_j and column i of the random design
    extra = [score[:, :, random[i]] * u[:, :, j] for i, j in places]
    score = np.concatenate([score, np.stack(extra, axis=2)], axis=2)
    mean = np.einsum("gk,gki->gi", share, score)
    variance = np.einsum("gk,gki,gkj->ij", share, score, score) - mean.T @ mean

    weighted = cells.trials[:, None] * mu * (1 - mu) * share[cells.owner]
    powers = np.concatenate([np.ones((*u.shape[:2], 1)), u], axis=2)[cells.owner]
    moment = np.einsum("ik,ika,ikb->iab", weighted, powers, powers)
    columns = [(j, 0) for j in range(p)] + [(random[i], 1 + j) for i, j in places]
    complete = np.empty((len(columns), len(columns)))
    for a, (i, k) in enumerate(columns):
        for b, (j, m) in enumerate(columns):
            complete[a, b] = (moment[:, k, m] * cells.x[:, i] * cells.x[:, j]).sum()
    return {"value": value.sum()[None], "score": mean.sum(axis=0), "information": (complete - variance).ravel()}


def grid_sums(
    stored: DataFrame, fit: str, thetas: dict, random: Sequence[int], each: int
) -> dict[object, dict[str, np.ndarray]]:
    """Sums of :func:`marginal_sums` of the fits in ``thetas``: one pass over their participants.

    Every task sends numbers of the size of the models, whatever its participants are.
    """
    size = len(next(iter(thetas.values())))
    width = size - len(lower(len(random))) - 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            for name, part in pdf.groupby("fit", sort=False):
                for cells in cells_of(part, width):
                    found = np.concatenate(list(marginal_sums(cells, thetas[name], random, each).values()))
                    total[name] = total.get(name, 0.0) + found
        for name, values in total.items():
            yield pd.DataFrame({"fit": name, "pos": np.arange(len(values)), "value": values})

    wanted = stored.filter(F.col(fit).isin(list(thetas))).withColumnRenamed(fit, "fit")
    fields = [wanted.schema["fit"], T.StructField("pos", T.LongType()), T.StructField("value", T.DoubleType())]
    parts = wanted.select("fit", "x", "trials", "hits").mapInPandas(sums, T.StructType(fields))
    out: dict = {name: np.zeros(1 + size + size * size) for name in thetas}
    for row in parts.groupBy("fit", "pos").agg(F.sum("value").alias("value")).collect():
        out[row["fit"]][row["pos"]] = row["value"]
    return {
        name: {"value": v[0], "score": v[1 : 1 + size], "information": v[1 + size :].reshape(size, size)}
        for name, v in out.items()
    }


@dataclass(frozen=True)
class MarginalFit:
    """Fixed effects, covariance of the random effects and the log-likelihood at the fit."""

    terms: tuple[str, ...]
    beta: np.ndarray
    std_error: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    score: np.ndarray
    iterations: int
    converged: bool


def with_prior(sums: dict, theta: np.ndarray, p: int, scale: float | None) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, score and information with Cauchy priors on the fixed effects; none if ``scale`` is null."""
    value, score, information = float(sums["value"]), sums["score"].copy(), sums["information"].copy()
    if scale is not None:
        beta, square = theta[:p], scale**2
        value -= float(np.log1p(beta**2 / square).sum())
        score[:p] -= 2 * beta / (square + beta**2)
        information[range(p), range(p)] += 2 * (square - beta**2) / (square + beta**2) ** 2
    return value, score, information


def uphill(score: np.ndarray, information: np.ndarray) -> np.ndarray:
    """Newton step; directions in which the information is not positive are climbed with its size."""
    values, vectors = np.linalg.eigh((information + information.T) / 2)
    floor = 1e-8 * max(1.0, np.abs(values).max())
    return vectors @ ((vectors.T @ score) / np.maximum(np.abs(values), floor))


def packed_cells(cells: DataFrame, fit: str, subject: str, terms: Sequence[str]) -> DataFrame:
    """One stored row per fit and participant with its cells as arrays ``x, trials, hits``.

    Equal design rows are one cell, so a row is as long as a participant's distinct designs.
    """
    cell = F.struct(*(F.col(f"t{i}") for i in range(len(terms))), "trials", "hits")
    rows = cells.groupBy(fit, subject).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    flat = F.flatten(F.transform("cells", lambda c: F.array(*(c[f"t{i}"] for i in range(len(terms))))))
    return cut_lineage(rows.select(
        fit, subject, flat.alias("x"), F.col("cells.trials").alias("trials"), F.col("cells.hits").alias("hits")
    ))


def glmm_grid(
    df: DataFrame, y: str, terms: Sequence[str], fit: str, subject: str, slope: str | None,
    prior_scale: float | None = CAUCHY_SCALE, each: int = NODES, tolerance: float = 1e-10, max_iterations: int = 60,
) -> dict[object, MarginalFit]:
    """Logistic mixed models of every value of ``fit``, with a random intercept and slope per participant.

    Maximum of the marginal likelihood, with Cauchy priors on the fixed effects; ``slope`` must be
    one of ``terms``, without it only the intercept varies. Every iteration is one job for
    all unfinished fits; a fit leaves when its squared Newton decrement falls below ``tolerance``. A step
    that does not raise a fit's likelihood is halved in the next iteration. Rows with a missing
    fit or a missing value are left out; no rows give no fits.
    """
    cells = glmm_cells(df.filter(F.col(fit).isNotNull()), y, terms, [fit, subject])
    stored = packed_cells(cells, fit, subject, terms).persist(StorageLevel.MEMORY_AND_DISK)
    names = [row[0] for row in stored.select(fit).distinct().collect()]
    p = 1 + len(terms)
    random = [0] if slope is None else [0, 1 + list(terms).index(slope)]
    start = np.concatenate([np.zeros(p), [0.7 * (i == j) for i, j in lower(len(random))]])
    tried = {name: start for name in names}
    state: dict = {}
    open_, done = set(names), set()
    for iteration in range(1, max_iterations + 1):
        if not open_:
            break
        found = grid_sums(stored, fit, {name: tried[name] for name in open_}, random, each)
        for name in list(open_):
            value, score, information = with_prior(found[name], tried[name], p, prior_scale)
            best = state.get(name)
            if best is not None and value < best["value"] - 1e-9 * abs(best["value"]) and best["cut"] < HALVINGS:
                best["cut"] += 1
                tried[name] = best["theta"] + best["step"] / 2 ** best["cut"]
                continue
            step = uphill(score, information)
            gain = float(score @ step)
            state[name] = {
                "theta": tried[name], "value": value, "score": score, "information": information,
                "step": step, "cut": 0, "iterations": iteration,
            }
            tried[name] = tried[name] + step
            if gain < tolerance:
                open_.discard(name)
                done.add(name)
    stored.unpersist()
    return {name: _marginal_fit(state[name], terms, random, name in done) for name in names}


def _marginal_fit(state: dict, terms: Sequence[str], random: Sequence[int], converged: bool) -> MarginalFit:
    p, theta = 1 + len(terms), state["theta"]
    root = np.zeros((len(random), len(random)))
    for value, place in zip(theta[p:], lower(len(random)), strict=True):
        root[place] = value
    error = np.sqrt(np.clip(np.diag(np.linalg.pinv(state["information"]))[:p], 0, None))
    return MarginalFit(
        (INTERCEPT, *terms), theta[:p], error, root @ root.T, state["value"], state["score"],
        state["iterations"], converged,
    )


def glmm_quadrature(
    df: DataFrame, y: str, terms: Sequence[str], subject: str, slope: str | None = None,
    prior_scale: float | None = CAUCHY_SCALE, each: int = NODES, tolerance: float = 1e-10, max_iterations: int = 60,
) -> MarginalFit:
    """One model of :func:`glmm_grid` over all rows."""
    one = df.withColumn("_fit", F.lit(0))
    fits = glmm_grid(one, y, terms, "_fit", subject, slope, prior_scale, each, tolerance, max_iterations)
    if not fits:
        raise ValueError("no complete rows to fit")
    return fits[0]


def grid_table(spark, fits: dict, fit: str, kind: T.DataType) -> DataFrame:
    """``fit, term, estimate, std_error, converged, iterations`` of fits by name."""
    rows = [
        (name, term, float(b), float(s), one.converged, one.iterations)
        for name, one in fits.items()
        for term, b, s in zip(one.terms, one.beta, one.std_error, strict=True)
    ]
    fields = [
        T.StructField(fit, kind), T.StructField("term", T.StringType()), T.StructField("estimate", T.DoubleType()),
        T.StructField("std_error", T.DoubleType()), T.StructField("converged", T.BooleanType()),
        T.StructField("iterations", T.IntegerType()),
    ]
    return spark.createDataFrame(rows, T.StructType(fields))
