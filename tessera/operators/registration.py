"""Alignment, deformation and segmentation of volumes in tile form, in reduced form.

Each row's fit is numpy's work in the task that holds the row, so a cohort scales with its
subjects. Reduced means: rigid and affine alignment by normalised mutual information and a
pattern search; deformations by smoothed demons forces, also between several channels such
as tissue classes; segmentation by a mixture with tissue priors, several Gaussians a class
and a smooth bias, without deforming the priors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from tessera.operators.tiles import _at, _corners, grid_places, over_volumes

#: Parameters of a rigid and of an affine alignment: shifts, turns, sizes, shears.
KINDS = {"rigid": 6, "affine": 12}


def transform(p: Sequence[float], centre: Sequence[float]) -> np.ndarray:
    """The 4 x 4 matrix of up to 12 parameters about a centre: shifts, turns in radians about
    the axes, logarithms of sizes, shears."""
    t = np.concatenate([np.asarray(p, float), np.zeros(12 - len(p))])
    m = np.eye(4)
    for axis, angle in enumerate(t[3:6]):
        a, b = [(1, 2), (0, 2), (0, 1)][axis]
        turn = np.eye(4)
        turn[a, a] = turn[b, b] = np.cos(angle)
        turn[a, b], turn[b, a] = (np.sin(angle), -np.sin(angle)) if axis != 1 else (-np.sin(angle), np.sin(angle))
        m = m @ turn
    m = m @ np.diag([*np.exp(t[6:9]), 1.0])
    shear = np.eye(4)
    shear[0, 1], shear[0, 2], shear[1, 2] = t[9:12]
    m = m @ shear
    there, back = np.eye(4), np.eye(4)
    there[:3, 3], back[:3, 3] = np.asarray(centre, float) + t[:3], -np.asarray(centre, float)
    return there @ m @ back


def mutual_information(a: np.ndarray, b: np.ndarray, bins: int = 32) -> float:
    """Normalised: (H(a) + H(b)) / H(a, b) of two lists of values; 1 says nothing, 2 all."""
    if len(a) < 2 or a.min() == a.max() or b.min() == b.max():
        return 1.0
    cell = lambda x: np.minimum((x - x.min()) / (x.max() - x.min()) * bins, bins - 1).astype(np.int64)
    joint = np.bincount(cell(a) * bins + cell(b), minlength=bins * bins).reshape(bins, bins) / len(a)
    entropy = lambda p: -(p[p > 0] * np.log(p[p > 0])).sum()
    return float((entropy(joint.sum(axis=1)) + entropy(joint.sum(axis=0))) / max(entropy(joint), 1e-12))


def sample(image: np.ndarray, places: Sequence[np.ndarray], dim: Sequence[int]) -> np.ndarray:
    """One volume between eight voxels at places, 0 beyond; or each row's volume at its places."""
    if image.ndim == 1:
        return sum(w * image[at] for at, w in _corners(places, dim))
    return sum(w * np.take_along_axis(image, at, axis=1) for at, w in _corners(places, dim))


def transforms(p: np.ndarray, centre: Sequence[float]) -> np.ndarray:
    """``transform`` of each row of parameters."""
    t = np.concatenate([p, np.zeros((len(p), 12 - p.shape[1]))], axis=1)
    unit = lambda: np.repeat(np.eye(4)[None], len(t), axis=0)
    m = unit()
    for axis, angle in enumerate(t[:, 3:6].T):
        a, b = [(1, 2), (0, 2), (0, 1)][axis]
        turn = unit()
        turn[:, a, a] = turn[:, b, b] = np.cos(angle)
        up = np.sin(angle) if axis != 1 else -np.sin(angle)
        turn[:, a, b], turn[:, b, a] = up, -up
        m = m @ turn
    m = m * np.concatenate([np.exp(t[:, 6:9]), np.ones((len(t), 1))], axis=1)[:, None, :]
    shear = unit()
    shear[:, 0, 1], shear[:, 0, 2], shear[:, 1, 2] = t[:, 9:12].T
    m = m @ shear
    there, back = unit(), unit()
    there[:, :3, 3], back[:, :3, 3] = np.asarray(centre, float) + t[:, :3], -np.asarray(centre, float)
    return there @ m @ back


def mutual_informations(a: np.ndarray, b: np.ndarray, held: np.ndarray, bins: int = 32) -> np.ndarray:
    """``mutual_information`` of each row's held values."""
    n = held.sum(axis=1)
    cells, flat = [], n < 2
    for x in (a, b):
        low, high = np.where(held, x, np.inf).min(axis=1), np.where(held, x, -np.inf).max(axis=1)
        flat = flat | ~(high > low)
        low, wide = np.where(flat, 0.0, low), np.where(flat, 1.0, high - low)
        share = np.where(held & ~flat[:, None], (x - low[:, None]) / wide[:, None], 0.0)
        cells.append(np.minimum(share * bins, bins - 1).astype(np.int64))
    row = np.arange(len(a))[:, None] * (bins * bins)
    joint = np.bincount((row + cells[0] * bins + cells[1])[held], minlength=len(a) * bins * bins).reshape(-1, bins, bins)
    count = np.arange(a.shape[1] + 1.0)
    weigh = count * np.log(np.maximum(count, 1.0))  # n log n of whole counts
    most = np.maximum(n, 1)
    entropy = lambda c: np.log(most) - weigh[c].sum(axis=1) / most
    both = entropy(joint.reshape(len(a), -1))
    return np.where(flat, 1.0, (entropy(joint.sum(axis=2)) + entropy(joint.sum(axis=1))) / np.maximum(both, 1e-12))


#: Sampled voxels of volumes whose searches go on side by side.
SIDE_BY_SIDE = 1 << 17
#: No mutual information is greater than this, and a step is taken for a gain of so much.
MOST, GAIN = 2.0, 1e-9


def align_each(fixed: np.ndarray, moving: np.ndarray, dim: Sequence[int], moving_dim: Sequence[int], start: np.ndarray, kind: str = "rigid", strides: Sequence[int] = (4, 2), bins: int = 32, least: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the matrix from the fixed volume's voxels to the moving one's of the
    greatest mutual information, and that. ``start`` is where the search begins, as the
    headers have it. At each stride of sampled voxels the steps of a pattern search are
    halved until they are below ``least`` voxels, or nothing is left to gain. Rows' searches
    take their steps side by side, each with its own parameters and sizes."""
    fixed, moving = np.nan_to_num(fixed), np.nan_to_num(moving)
    centre, n = (np.asarray(dim) + 1) / 2, KINDS[kind]
    reach = max(dim) / 2
    unit = np.array([1, 1, 1, *[1 / reach] * 9])[:n]  # about a voxel at the rim
    p, best = np.zeros((len(fixed), n)), np.ones(len(fixed))
    for stride in strides:
        step = min(stride, max(1, min(dim) // 4))
        index = [x for x in grid_places(np.eye(4), dim)]
        some = np.logical_and.reduce([(x - 1) % step == step // 2 for x in index])
        at = np.stack([x[some] for x in index] + [np.ones(some.sum())])

        def score(rows, q, at=at, some=some):
            places = [c for c in np.moveaxis((start @ transforms(q, centre) @ at)[:, :3], 1, 0)]
            _, inside = _at(places, moving_dim)
            found = mutual_informations(fixed[np.ix_(rows, some)], sample(moving[rows], places, moving_dim), inside, bins)
            return np.where(inside.sum(axis=1) < max(8, 0.1 * at.shape[1]), 1.0, found)

        for rows in np.array_split(np.arange(len(fixed)), max(1, -(-len(fixed) * at.shape[1] // SIDE_BY_SIDE))):
            if not len(rows):
                continue
            best[rows] = score(rows, p[rows])
            size = np.full(len(fixed), float(2 * step))
            while len(rows := rows[(size[rows] >= least) & (best[rows] < MOST - GAIN)]):
                moved = np.zeros(len(rows), bool)
                for k in range(n):
                    for sign in (1, -1):
                        q = p[rows]
                        q[:, k] += sign * size[rows] * unit[k]
                        s = score(rows, q)
                        better = s > best[rows] + GAIN
                        p[rows[better]], best[rows[better]] = q[better], s[better]
                        moved |= better
                size[rows[~moved]] /= 2
    return start @ transforms(p, centre), best


def align(fixed: np.ndarray, moving: np.ndarray, dim: Sequence[int], moving_dim: Sequence[int], start: np.ndarray, kind: str = "rigid", strides: Sequence[int] = (4, 2), bins: int = 32, least: float = 0.02) -> tuple[np.ndarray, float]:
    """``align_each`` of one volume."""
    m, best = align_each(fixed[None], moving[None], dim, moving_dim, start, kind, strides, bins, least)
    return m[0], float(best[0])


def register(pairs: DataFrame, fixed: str, moving: str, dim: Sequence[int], affine, moving_dim: Sequence[int] | None = None, moving_affine=None, kind: str = "rigid", strides: Sequence[int] = (4, 2), bins: int = 32) -> DataFrame:
    """Add ``matrix`` (16 values, the fixed volume's voxels to the moving one's, by rows),
    ``score`` (one value) and ``resliced``, the moving volume on the fixed one's grid."""
    shape = moving_dim or dim
    ours = np.asarray(affine, float).reshape(4, 4)
    theirs = ours if moving_affine is None else np.asarray(moving_affine, float).reshape(4, 4)
    start = np.linalg.inv(theirs) @ ours

    def work(a, b):
        found, score = align_each(a, b, dim, shape, start, kind, strides, bins)
        sliced = [sample(np.nan_to_num(y), grid_places(m, dim), shape) for y, m in zip(b, found, strict=True)]
        return [found.reshape(len(a), 16), score[:, None], np.stack(sliced)]

    return over_volumes(pairs, [fixed, moving], work, ["matrix", "score", "resliced"])


def _smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * sigma)))
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    taps /= taps.sum()
    for axis in range(-3, 0):
        wide = np.pad(x, [(0, 0)] * (x.ndim - 3) + [(reach, reach) if a == axis else (0, 0) for a in range(-3, 0)], mode="edge")
        n = x.shape[axis]
        x = sum(t * np.take(wide, np.arange(s, s + n), axis=axis) for s, t in enumerate(taps))
    return x


def demons(fixed: np.ndarray, moving: np.ndarray, dim: Sequence[int], rounds: int = 60, sigma: float = 1.0, levels: Sequence[float] = (2.0, 0.0)) -> np.ndarray:
    """Places (3 x voxels) in the moving volume of the fixed one's voxels. Both are channels
    x voxels; at each level both are smoothed so much, and each round adds the demons force
    of all channels to the displacement, which is smoothed by ``sigma`` voxels."""
    shape = tuple(dim)[::-1]
    a, b = (np.nan_to_num(x).reshape(-1, *shape) for x in (fixed, moving))
    grid = np.stack(grid_places(np.eye(4), dim)).reshape(3, *shape)
    shift = np.zeros((3, *shape))
    for level in levels:
        f, m = (_smoothed(x, level) if level > 0 else x for x in (a, b))
        for _ in range(rounds):
            ends = [np.clip(c, 1, n).ravel() for c, n in zip(grid + shift, dim, strict=True)]
            warped = np.stack([sample(x.ravel(), ends, dim).reshape(shape) for x in m])
            gap = f - warped
            # np.gradient's axes are z, y, x
            slope = np.stack([np.gradient(warped, axis=ax) if shape[ax - 1] > 1 else np.zeros_like(warped) for ax in (3, 2, 1)])
            size = (slope**2).sum(axis=(0, 1)) + (gap**2).sum(axis=0)
            shift = _smoothed(shift + (slope * gap).sum(axis=1) / np.where(size > 1e-12, size, 1.0), sigma)
    return np.stack([np.clip(c, 1, n) for c, n in zip(grid + shift, dim, strict=True)]).reshape(3, -1)


def deform(pairs: DataFrame, fixed: str, moving: str, dim: Sequence[int], channels: int = 1, rounds: int = 60, sigma: float = 1.0, levels: Sequence[float] = (2.0, 0.0)) -> DataFrame:
    """Add ``x``, ``y``, ``z``: for each voxel of the fixed volume its place in the moving
    one, as ``tiles.pull`` takes them. With several channels (tissue classes, one after the
    other in the arrays) one deformation fits them all."""

    def work(a, b):
        found = [demons(x.reshape(channels, -1), y.reshape(channels, -1), dim, rounds, sigma, levels) for x, y in zip(a, b, strict=True)]
        return [np.stack([f[n] for f in found]) for n in range(3)]

    return over_volumes(pairs, [fixed, moving], work, ["x", "y", "z"])


def bias_basis(dim: Sequence[int], degree: int) -> np.ndarray:
    """Products of cosines along the axes up to a degree in all, but for the constant one."""
    waves = [np.stack([np.cos(np.pi * k * (np.arange(n) + 0.5) / n) for k in range(min(degree, n - 1) + 1)]) for n in dim]
    out = [np.einsum("k,j,i->kji", waves[2][c], waves[1][b], waves[0][a]).ravel() for a in range(len(waves[0])) for b in range(len(waves[1])) for c in range(len(waves[2])) if 0 < a + b + c <= degree]
    return np.array(out).reshape(len(out), int(np.prod(dim)))


def mixture(x: np.ndarray, prior: np.ndarray, gaussians: Sequence[int], basis: np.ndarray, rounds: int = 40, stiffness: float = 1e-3, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, float]:
    """Classes' responsibilities (classes x voxels), the bias, and the log-likelihood.

    ``prior`` has each class's probability at each voxel. A class has so many Gaussians; the
    bias is added to their means (give logarithms of intensities for a factor) and is a sum
    of the basis's waves, held back by ``stiffness``. Missing voxels belong to no class.
    """
    held = np.isfinite(x) & (prior.sum(axis=0) > 0)
    v, p = x[held], prior[:, held] / prior[:, held].sum(axis=0)
    owner = np.repeat(np.arange(len(gaussians)), gaussians)
    spread = max(v.var(), 1e-12) if len(v) else 1.0
    mean, share, width = np.zeros(len(owner)), np.zeros(len(owner)), np.full(len(owner), spread)
    for c, n in enumerate(gaussians):
        total = max(p[c].sum(), 1e-12)
        centre = (p[c] * v).sum() / total
        sd = np.sqrt(max((p[c] * (v - centre) ** 2).sum() / total, 1e-12))
        mean[owner == c] = centre + sd * (np.linspace(-1, 1, n) if n > 1 else 0.0)
        share[owner == c], width[owner == c] = 1 / n, max(sd * sd, 1e-3 * spread)
    waves, beta, last = basis[:, held], np.zeros(len(basis)), -np.inf
    post, like = np.zeros((len(owner), len(v))), 0.0
    for _ in range(rounds if len(v) else 0):
        y = v - beta @ waves
        log = np.log(p[owner] + 1e-300) + np.log(share + 1e-300)[:, None] - 0.5 * (np.log(2 * np.pi * width)[:, None] + (y - mean[:, None]) ** 2 / width[:, None])
        top = log.max(axis=0)
        post = np.exp(log - top)
        whole = post.sum(axis=0)
        post /= whole
        like = float((top + np.log(whole)).sum())
        if abs(like - last) <= tolerance * abs(like):
            break
        last = like
        n = post.sum(axis=1) + 1e-12
        mean = post @ y / n
        width = np.maximum((post * (y - mean[:, None]) ** 2).sum(axis=1) / n, 1e-4 * spread)
        share = n / np.array([n[owner == c].sum() for c in owner])
        if len(waves):
            weight = (post / width[:, None]).sum(axis=0)
            target = v - (post * (mean / width)[:, None]).sum(axis=0) / weight
            beta = np.linalg.solve((waves * weight) @ waves.T + stiffness * weight.sum() * np.eye(len(waves)), (waves * weight) @ target)
    out = np.zeros_like(prior, dtype=float)
    out[:, held] = np.stack([post[owner == c].sum(axis=0) for c in range(len(gaussians))])
    return out, beta @ basis, like


def segment(volumes: DataFrame, data: str, prior: str, dim: Sequence[int], gaussians: Sequence[int] = (1, 1, 2, 3, 4, 2), degree: int = 3, rounds: int = 40) -> DataFrame:
    """Add ``classes`` (responsibilities, a class's voxels one after the other, as the prior
    has them), ``bias`` and ``likelihood`` (one value)."""
    basis = bias_basis(dim, degree)

    def work(x, p):
        found = [mixture(a, b.reshape(len(gaussians), -1), gaussians, basis, rounds) for a, b in zip(x, p, strict=True)]
        return [np.stack([c.ravel() for c, _, _ in found]), np.stack([b for _, b, _ in found]), np.array([[like] for _, _, like in found])]

    return over_volumes(volumes, [data, prior], work, ["classes", "bias", "likelihood"])
