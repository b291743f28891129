"""Clean-up of tissue classes by conditional dilation, a volume (or slab) at a time.

Sixty-four stencil passes as windows would be 192 shuffles, so a volume's array goes to
numpy whole: one task holds one volume, whatever the cohort's size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.operators.tiles import VALUES
from tessera.plans.runtime import ship

ROUNDS = 32
FIRST_THRESHOLD, LATER = 0.6, {1: 0.15, 2: 0.2}
GATE = 0.05
KERNEL = (0.3, 0.4, 0.3)


def smooth(x: np.ndarray) -> np.ndarray:
    """The three-tap kernel along each of the last three axes, 0 beyond the volume."""
    for axis in range(x.ndim - 3, x.ndim):
        wide = np.pad(x, [(1, 1) if a == axis else (0, 0) for a in range(x.ndim)])
        at = lambda s: wide[tuple(slice(s, s + x.shape[axis]) if a == axis else slice(None) for a in range(x.ndim))]  # noqa: B023, E731
        x = KERNEL[0] * at(0) + KERNEL[1] * at(1) + KERNEL[2] * at(2)
    return x


def clean_tissue(p: np.ndarray, gm: Sequence[int] = (0,), wm: Sequence[int] = (1,), csf: Sequence[int] = (2,), level: int = 2) -> np.ndarray:
    """Responsibilities (x, y, z, class), also of several volumes along a first axis, with
    what is not connected to white matter removed.

    White matter grows into white and grey matter: in each round voxels above the threshold
    are kept, as far as those tissues support them, and smoothed. The result grows on into
    fluid. What neither reached loses its tissues and the rest is renormalised.
    """
    white, grey, fluid = (p[..., list(c)].sum(axis=-1) for c in (wm, gm, csf))
    later = LATER[2] if level == 2 else LATER[1]
    brain = white
    for n in range(ROUNDS):
        brain = smooth((brain > (FIRST_THRESHOLD if n < 2 else later)) * (white + grey))
    head = brain
    for _ in range(ROUNDS):
        head = smooth((head > later) * (white + grey + fluid))
    out = p.astype(float).copy()
    keep = ((brain > GATE) * (grey + white)) > GATE
    for c in (*gm, *wm):
        out[..., c] *= keep
    left = sum(out[..., c] for c in (*gm, *wm, *csf))
    keep = ((head > GATE) * left) > GATE
    for c in csf:
        out[..., c] *= keep
    return out / (out.sum(axis=-1, keepdims=True) + np.finfo(float).eps)


def map_volumes(stacks: DataFrame, hook, dim: Sequence[int], classes: int, data: str = "p", many: bool = False) -> DataFrame:
    """Apply ``hook`` to each row's (x, y, z, class) array; a row whose hook fails keeps a
    NULL array and says why in ``error``. Arrays hold a class's voxels one after the other,
    first axis fastest. A hook for ``many`` gets runs of rows along a first axis, and rows one
    by one where a run fails."""
    ship(stacks.sparkSession)
    kept = [f for f in stacks.schema.fields if f.name not in (data, "error")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(data, T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])

    size = int(np.prod(dim)) * classes
    shape, turn = (-1, classes, *reversed(dim)), (0, 4, 3, 2, 1)

    def together(part):
        flat = part.column(data).flatten().to_numpy(zero_copy_only=False).astype(float)
        done = np.asarray(hook(flat.reshape(shape).transpose(turn)), dtype=float)
        values = np.ascontiguousarray(done.transpose(turn)).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * size, pa.int32()), pa.array(values))
        return pa.RecordBatch.from_arrays([*(part.column(n) for n in names), lists, pa.nulls(len(part), pa.string())], [*names, data, "error"])

    def run(batches):
        for batch in batches:
            if many:
                step = max(1, VALUES // size)
                try:
                    found = [together(batch.slice(a, step)) for a in range(0, len(batch), step)]
                except Exception:  # then each row tells for itself
                    found = None
                if found is not None:
                    yield from found
                    continue
            for r in range(len(batch)):
                row = batch.slice(r, 1)
                try:
                    flat = np.asarray(row.column(data)[0].values.to_numpy(zero_copy_only=False), dtype=float)
                    done = np.asarray(hook(flat.reshape((*dim, classes), order="F")), dtype=float).ravel(order="F")
                    value, error = pa.ListArray.from_arrays(pa.array([0, len(done)], pa.int32()), pa.array(done)), None
                except Exception as e:  # one volume's failure is a row of the result
                    value, error = pa.array([None], pa.list_(pa.float64())), f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([*(row.column(n) for n in names), value, pa.array([error], pa.string())], [*names, data, "error"])

    return stacks.mapInArrow(run, schema)


def clean(stacks: DataFrame, dim: Sequence[int], classes: int, level: int = 2, data: str = "p") -> DataFrame:
    return map_volumes(stacks, lambda p: clean_tissue(p, level=level), dim, classes, data, many=True)
