"""Reduced forms of the model fits: intensity mixtures and cross-validated prediction."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.functions.numeric import array_sum, normal_pdf
from tessera.plans.runtime import ship


def responsibilities(value: Column, model: Sequence[tuple[float, float, float]], prior: Column | None = None) -> Column:
    """Posterior of each Gaussian (weight, mean, variance), times a spatial prior if given."""
    dens = [F.lit(w) * normal_pdf(value, F.lit(m), F.lit(math.sqrt(s))) for w, m, s in model]
    if prior is not None:
        dens = [d * F.element_at(prior, g + 1) for g, d in enumerate(dens)]
    dens = F.array(*dens)
    total = array_sum(dens) + 1e-300
    return F.transform(dens, lambda d: d / total)


def fit_mixture(voxels: DataFrame, start: Sequence[tuple[float, float, float]], value: str = "v", prior: str | None = None, rounds: int = 20, tolerance: float = 1e-3, least_variance: float = 1e-6) -> tuple[list[tuple[float, float, float]], float]:
    """Mixture of Gaussians by expectation maximisation. A round is one aggregation of sums
    of p, p x and p x^2 over the voxels; only those sums come to the driver."""
    model, last = list(start), -math.inf
    x = F.col(value)
    held = voxels.where(x.isNotNull() & ~F.isnan(x))
    for _ in range(rounds):
        weight = [F.lit(w) * normal_pdf(x, F.lit(m), F.lit(math.sqrt(s))) * (F.element_at(prior, g + 1) if prior else F.lit(1.0)) for g, (w, m, s) in enumerate(model)]
        p = held.select(x.alias("x"), responsibilities(x, model, F.col(prior) if prior else None).alias("p"), F.log(sum(weight, F.lit(1e-300))).alias("l"))
        sums = p.agg(F.count("*").alias("n"), F.sum("l").alias("l"), *(F.sum(F.element_at("p", g + 1) * e).alias(f"s{g}_{k}") for g in range(len(model)) for k, e in enumerate((F.lit(1.0), F.col("x"), F.col("x") * F.col("x"))))).first()
        if not sums["n"]:
            return model, last
        new = []
        for g in range(len(model)):
            s0, s1, s2 = (sums[f"s{g}_{k}"] or 0.0 for k in range(3))
            mean = s1 / s0 if s0 > 0 else model[g][1]
            new.append((s0 / sums["n"], mean, max(least_variance, s2 / s0 - mean * mean) if s0 > 0 else model[g][2]))
        model = new
        if abs(sums["l"] - last) <= tolerance * abs(sums["l"]):
            break
        last = sums["l"]
    return model, sums["l"]


def with_folds(rows: DataFrame, key: str, folds: int, by: Sequence[str] = ()) -> DataFrame:
    """Folds of nearly equal size, dealt in an order that a hash of the key gives."""
    w = Window.partitionBy(*by).orderBy(F.md5(F.col(key).cast("string")), key)
    return rows.withColumn("fold", ((F.row_number().over(w) - 1) % folds + 1).cast("int"))


def fold_count(n: int, most: int = 10) -> int:
    return max(1, min(most, n))


def _centred(x: np.ndarray, train: np.ndarray) -> np.ndarray:
    return x - x[train].mean(axis=0)


def kernel_ridge(k: np.ndarray, y: np.ndarray, train: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    mean = y[train].mean()
    alpha = np.linalg.solve(k[np.ix_(train, train)] + penalty * np.eye(train.sum()), y[train] - mean)
    return k[:, train] @ alpha + mean


def gaussian_process(k: np.ndarray, y: np.ndarray, train: np.ndarray, steps: int = 60) -> np.ndarray:
    """Linear-kernel regression; signal and noise by the marginal likelihood on a grid of
    their ratio, the scale in closed form."""
    own, target = k[np.ix_(train, train)], y[train] - y[train].mean()
    values, vectors = np.linalg.eigh(own)
    values, z = np.maximum(values, 0), vectors.T @ target
    best, ratio = math.inf, 1.0
    for r in np.logspace(-6, 6, steps):  # noise over signal
        d = values + r
        scale = (z * z / d).mean()
        cost = len(z) * math.log(max(scale, 1e-300)) + np.log(d).sum()
        if cost < best:
            best, ratio = cost, r
    return k[:, train] @ (vectors @ (z / (values + ratio))) + y[train].mean()


def gaussian_process_classifier(k: np.ndarray, y: np.ndarray, train: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Probability of label 1 by a Laplace approximation with a logistic likelihood."""
    own, t = k[np.ix_(train, train)] + 1e-6 * np.eye(train.sum()), np.where(y[train] > 0.5, 1.0, 0.0)
    f = np.zeros(len(t))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        root = np.sqrt(w)
        b = w * f + t - p
        a = b - root * np.linalg.solve(np.eye(len(t)) + root[:, None] * own * root[None, :], root * (own @ b))
        new = own @ a
        if np.abs(new - f).max() < 1e-6:
            f = new
            break
        f = new
    p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    return 1 / (1 + np.exp(-np.clip(k[:, train] @ (t - p), -30, 30)))


def relevance_vectors(k: np.ndarray, y: np.ndarray, train: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Sparse Bayesian regression over kernel columns; precisions are re-estimated and
    columns whose precision runs away are dropped."""
    phi, target = np.column_stack([np.ones(train.sum()), k[np.ix_(train, train)]]), y[train]
    scale = np.maximum(np.sqrt((phi * phi).sum(axis=0)), 1e-12)
    phi = phi / scale
    alpha, beta, live = np.full(phi.shape[1], 1e-2), 1.0 / max(target.var(), 1e-12), np.arange(phi.shape[1])
    for _ in range(rounds):
        sub = phi[:, live]
        cov = np.linalg.pinv(beta * sub.T @ sub + np.diag(alpha[live]))
        mean = beta * cov @ sub.T @ target
        gamma = 1 - alpha[live] * np.diag(cov)
        alpha[live] = np.clip(gamma / np.maximum(mean**2, 1e-12), 1e-12, 1e12)
        beta = max(len(target) - gamma.sum(), 1e-6) / max(((target - sub @ mean) ** 2).sum(), 1e-12)
        live = live[alpha[live] < 1e9]
        if not len(live):
            return np.full(len(y), target.mean())
    sub = phi[:, live]
    mean = beta * np.linalg.pinv(beta * sub.T @ sub + np.diag(alpha[live])) @ sub.T @ target
    return (np.column_stack([np.ones(len(y)), k[:, train]]) / scale)[:, live] @ mean


MACHINES = {"krr": kernel_ridge, "gp": gaussian_process, "gpc": gaussian_process_classifier, "rvr": relevance_vectors}

# The same fits by the features (rows x features, centred) instead of their kernel: with a
# linear kernel nothing that a fit needs is larger than the features, so memory grows with
# the rows and not with their square.


def _ridge(c: np.ndarray, target: np.ndarray, train: np.ndarray, penalty: float) -> np.ndarray:
    x = c[train]
    return c @ np.linalg.solve(x.T @ x + penalty * np.eye(c.shape[1]), x.T @ target)


def ridge_by_features(c: np.ndarray, y: np.ndarray, train: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    mean = y[train].mean()
    return _ridge(c, y[train] - mean, train, penalty) + mean


def gaussian_process_by_features(c: np.ndarray, y: np.ndarray, train: np.ndarray, steps: int = 60) -> np.ndarray:
    """Beyond the features' own directions the kernel's eigenvalues are 0: of the target
    only its length matters there."""
    x, target = c[train], y[train] - y[train].mean()
    values, vectors = np.linalg.eigh(x.T @ x)
    held = values > max(values.max(), 0.0) * len(target) * np.finfo(float).eps
    values, vectors = values[held], vectors[:, held]
    z = (x @ vectors / np.sqrt(values)).T @ target
    n, rest = len(target), max(float(target @ target - z @ z), 0.0)
    best, ratio = math.inf, 1.0
    for r in np.logspace(-6, 6, steps):  # noise over signal
        d = values + r
        scale = ((z * z / d).sum() + rest / r) / n
        cost = n * math.log(max(scale, 1e-300)) + np.log(d).sum() + (n - len(d)) * math.log(r)
        if cost < best:
            best, ratio = cost, r
    return _ridge(c, target, train, ratio) + y[train].mean()


def gaussian_process_classifier_by_features(c: np.ndarray, y: np.ndarray, train: np.ndarray, rounds: int = 30, jitter: float = 1e-6) -> np.ndarray:
    """The kernel with its jitter is inverted by Woodbury's formula."""
    x, t = c[train], np.where(y[train] > 0.5, 1.0, 0.0)
    f = np.zeros(len(t))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        own = 1 / (jitter + 1 / w)
        v = f + (t - p) / w
        beta = np.linalg.solve(np.eye(c.shape[1]) + (x * own[:, None]).T @ x, x.T @ (own * v))
        new = x @ beta + jitter * own * (v - x @ beta)
        if np.abs(new - f).max() < 1e-6:
            f = new
            break
        f = new
    p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    return 1 / (1 + np.exp(-np.clip(c @ (x.T @ (t - p)), -30, 30)))


def relevance_vectors_by_features(c: np.ndarray, y: np.ndarray, train: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Kernel columns are combinations ``b`` of the features and a constant: the posterior
    has the features' rank beyond its prior, and Woodbury's formula inverts it."""
    g, target = np.column_stack([np.ones(train.sum()), c[train]]), y[train]
    gram, told = g.T @ g, g.T @ target
    b = np.zeros((g.shape[1], len(target) + 1))
    b[0, 0], b[1:, 1:] = 1.0, c[train].T
    b /= np.maximum(np.sqrt(np.einsum("dn,dn->n", b, gram @ b)), 1e-12)
    # gram = root root', so that a column's part is root' b and a feature may be constant
    values, vectors = np.linalg.eigh(gram)
    held = values > values.max() * len(target) * np.finfo(float).eps
    root = vectors[:, held] * np.sqrt(values[held])
    h, seen = root.T @ b, (vectors[:, held] / np.sqrt(values[held])).T @ told
    alpha, beta, live = np.full(b.shape[1], 1e-2), 1.0 / max(target.var(), 1e-12), np.arange(b.shape[1])
    square = float(target @ target)

    def posterior():
        """Means, and how far each column's weight is told by the targets."""
        own = h[:, live]
        part = own / alpha[live]
        inner = np.linalg.inv(np.eye(len(h)) / beta + part @ own.T)
        return part.T @ (inner @ seen), np.einsum("kn,kn->n", part, inner @ own)

    for _ in range(rounds):
        mean, gamma = posterior()
        alpha[live] = np.clip(gamma / np.maximum(mean**2, 1e-12), 1e-12, 1e12)
        fitted = h[:, live] @ mean
        error = max(square - 2 * seen @ fitted + fitted @ fitted, 0.0)
        beta = max(len(target) - gamma.sum(), 1e-6) / max(error, 1e-12)
        live = live[alpha[live] < 1e9]
        if not len(live):
            return np.full(len(y), target.mean())
    weights = b[:, live] @ posterior()[0]
    return weights[0] + c @ weights[1:]


BY_FEATURES = {"krr": ridge_by_features, "gp": gaussian_process_by_features, "gpc": gaussian_process_classifier_by_features, "rvr": relevance_vectors_by_features}


def fitted(c: np.ndarray, y: np.ndarray, train: np.ndarray, machine: str) -> np.ndarray:
    """By the kernel where there are at most as many rows as features, else by the features."""
    if len(c) <= c.shape[1]:
        return MACHINES[machine](c @ c.T, y, train)
    return BY_FEATURES[machine](c, y, train)


def cross_validated(rows: DataFrame, by: Sequence[str], key: str, features: str, target: str, folds: int = 10, machine: str = "krr") -> DataFrame:
    """Out-of-fold predictions, a linear kernel in each group of subjects.

    A group (a method's cohort) is one task, whose memory is that of its features: a Gram
    matrix is made only where it is smaller. Needs folds in column ``fold``; feature means and kernels
    are of the training folds. Rows with a missing side are left out.
    """
    ship(rows.sparkSession)
    schema = T.StructType([*(rows.schema[c] for c in (*by, key)), T.StructField("fold", T.IntegerType()), T.StructField("y_true", T.DoubleType()), T.StructField("y_pred", T.DoubleType())])

    def predict(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        x, y = np.stack(pdf[features].to_numpy()).astype(float), pdf[target].to_numpy(dtype=float)
        out = np.full(len(y), np.nan)
        for fold in sorted(pdf["fold"].unique()):
            test = (pdf["fold"] == fold).to_numpy()
            if test.all():
                continue
            c = _centred(x, ~test)
            out[test] = fitted(c, y, ~test, machine)[test]
        return pd.DataFrame({**{c: pdf[c] for c in (*by, key)}, "fold": pdf["fold"].astype("int32"), "y_true": y, "y_pred": out})

    held = rows.where(F.col(features).isNotNull() & F.col(target).isNotNull()).select(*by, key, "fold", features, target)
    return held.groupBy(*by).applyInPandas(predict, schema)
