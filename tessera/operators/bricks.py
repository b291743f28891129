"""Volumes as bricks with halos: one volume on many tasks.

A brick is a row: the volume's keys, its dimensions ``dim``, the nominal brick ``size``, the
brick's place ``at`` (0-based, in bricks) and arrays of its own voxels, first axis fastest.
``exchange`` sends every brick's edges to the bricks around it in one shuffle of bricks and
edges, by volume and brick, and works on each with its halo; no task holds more than a brick
and what is around it. A stencil of reach 1 that is repeated goes several rounds on a halo of
as many voxels before the next exchange: the halo's outer voxels go wrong one by one, those
of the brick stay right. Voxels beyond the volume are 0 in every round.

Cases: bricks at the far ends are smaller, and may be smaller than the halo; a size larger
than the volume gives one brick; missing voxels count as 0; a volume that lacks its array,
or whose array does not fit its dimensions, has no bricks; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.cleanup import FIRST_THRESHOLD, GATE, LATER, ROUNDS, smooth
from tessera.plans.runtime import ship

#: Voxels of a halo, that is rounds between two exchanges.
HALO = 4
SIZE = (64, 64, 64)
#: Rows and values of a batch that is handed on, about.
ROWS, VALUES = 1000, 1 << 20
_LIST = pa.list_(pa.float64())
Arrays = dict[str, np.ndarray]
#: Arrays of several bricks of one shape (brick, z, y, x), with their halos as far as the volume
#: goes, and where in them it is -> arrays of the same shape. What is beyond is 0.
Work = Callable[[Arrays, np.ndarray], Arrays]


def _schema(df: DataFrame, keys: Sequence[str], columns: Sequence[str], more: Sequence[str] = ()) -> T.StructType:
    ints = T.ArrayType(T.IntegerType())
    return T.StructType([*(df.schema[k] for k in keys), *(T.StructField(n, ints) for n in ("dim", "size", "at", *more)), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in columns)])


def _batch(rows: list[list], schema: T.StructType, types: Sequence[pa.DataType], lists: int) -> pa.RecordBatch:
    """Rows of keys, lists of ints and arrays of doubles."""
    n = len(types)
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
    columns += [pa.array([r[n + k] for r in rows], pa.list_(pa.int32())) for k in range(lists)]
    for k in range(n + lists, len(schema.names)):
        flat = [r[k].ravel() for r in rows]
        ends = np.cumsum([0, *map(len, flat)]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0))))
    return pa.RecordBatch.from_arrays(columns, schema.names)


def _batches(rows: Iterator[list], schema: T.StructType, types: Sequence[pa.DataType], lists: int) -> Iterator[pa.RecordBatch]:
    """Rows a bounded number of values at a time."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(x.size for x in row[len(types) + lists :])
        if len(held) >= ROWS or size >= VALUES:
            yield _batch(held, schema, types, lists)
            held, size = [], 0
    if held:
        yield _batch(held, schema, types, lists)


def _core(at: Sequence[int], size: Sequence[int], dim: Sequence[int]) -> tuple[list[int], list[int]]:
    """First voxel (0-based) and shape of a brick."""
    start = [a * s for a, s in zip(at, size, strict=True)]
    return start, [min(s, d - x) for s, d, x in zip(size, dim, start, strict=True)]


def _values(column: pa.Array, row: int, shape: Sequence[int]) -> np.ndarray:
    """A list as (z, y, x); missing values are 0."""
    return np.nan_to_num(np.array(column[row].values.to_numpy(zero_copy_only=False), float)).reshape(tuple(shape)[::-1])


def _box(x: np.ndarray, low: Sequence[int], shape: Sequence[int]) -> np.ndarray:
    """A view of (z, y, x) from a voxel (x, y, z) on."""
    return x[tuple(slice(a, a + n) for a, n in zip(tuple(low)[::-1], tuple(shape)[::-1], strict=True))]


def cut(tiles: DataFrame, keys: Sequence[str], columns: Sequence[str], dim: Sequence[int] | str, size: Sequence[int] = SIZE) -> DataFrame:
    """Each volume's arrays in bricks. Dimensions are literals or in a column."""
    ship(tiles.sparkSession)
    shape = F.col(dim) if isinstance(dim, str) else F.array(*(F.lit(int(n)) for n in dim))
    given = tiles.select(*keys, shape.cast("array<int>").alias("dim"), *(F.col(c).cast("array<double>").alias(c) for c in columns))
    schema, whole = _schema(given, keys, columns), [int(s) for s in size]

    def bricks_of(batch):
        own, dims = [batch.column(k).to_pylist() for k in keys], batch.column("dim").to_pylist()
        for r, d in enumerate(dims):
            if d is None or len(d) != 3 or any(n is None or n < 1 for n in d) or any(not batch.column(c)[r].is_valid or len(batch.column(c)[r]) != int(np.prod(d)) for c in columns):
                continue
            arrays = [_values(batch.column(c), r, d) for c in columns]
            for at in product(*(range(-(-n // s)) for n, s in zip(d, whole, strict=True))):
                start, core = _core(at, whole, d)
                yield [*(k[r] for k in own), d, whole, list(at), *(_box(x, start, core) for x in arrays)]

    def run(batches):
        for batch in batches:
            yield from _batches(bricks_of(batch), schema, [batch.column(k).type for k in keys], 3)

    return given.mapInArrow(run, schema)


def exchange(bricks: DataFrame, keys: Sequence[str], columns: Sequence[str], halo: int, work: Work, outputs: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``work`` on each brick's ``columns`` with a halo; the bricks' own part of ``outputs``
    and, as they were, of ``keep``."""
    ship(bricks.sparkSession)
    carried = [*columns, *(c for c in keep if c not in columns)]
    sent, out = _schema(bricks, keys, carried, ("low", "shape")), _schema(bricks, keys, [*outputs, *keep])
    own_only = [c for c in carried if c not in columns]

    def edges(batch):
        own, places = [batch.column(k).to_pylist() for k in keys], [batch.column(c).to_pylist() for c in ("dim", "size", "at")]
        for r, (dim, size, at) in enumerate(zip(*places, strict=True)):
            start, core = _core(at, size, dim)
            arrays = [_values(batch.column(c), r, core) for c in carried]
            reach = [-(-halo // s) + 1 for s in size]
            for step in product(*(range(max(-n, -a), n + 1) for n, a in zip(reach, at, strict=True))):
                to = [a + b for a, b in zip(at, step, strict=True)]
                if any(t * s >= d for t, s, d in zip(to, size, dim, strict=True)):
                    continue
                first, there = _core(to, size, dim)
                low = [max(x, f - halo) for x, f in zip(start, first, strict=True)]
                shape = [min(x + n, f + m + halo) - a for x, n, f, m, a in zip(start, core, first, there, low, strict=True)]
                if min(shape) < 1:
                    continue
                part = [_box(x, [a - b for a, b in zip(low, start, strict=True)], shape) for x in arrays]
                part = [x if c in columns or not any(step) else x[:0] for c, x in zip(carried, part, strict=True)]
                yield [*(k[r] for k in own), dim, size, to, low, shape, *part]

    def send(batches):
        for batch in batches:
            yield from _batches(edges(batch), sent, [batch.column(k).type for k in keys], 5)

    def brick(rows: list[tuple]) -> tuple:
        """One brick of all edges that came to it: its shape with the halo, where in it its own
        voxels are, (keys, dim, size, at), arrays."""
        own, dim, size, at, *_ = rows[0]
        start, core = _core(at, size, dim)
        first = [max(0, s - halo) for s in start]
        wide = tuple(min(d, s + n + halo) - f for d, s, n, f in zip(dim, start, core, first, strict=True))
        held = {c: np.zeros(wide[::-1]) for c in columns}
        kept: Arrays = {}
        for *_, low, shape, arrays in rows:
            for c, x in zip(carried, arrays, strict=True):
                if c in held:
                    _box(held[c], [a - f for a, f in zip(low, first, strict=True)], shape)[...] = x.reshape(tuple(shape)[::-1])
                elif len(x):
                    kept[c] = x.reshape(tuple(shape)[::-1])
        middle = tuple(s - f for s, f in zip(start, first, strict=True))
        kept |= {c: _box(held[c], middle, core) for c in keep if c in held}
        return (wide, middle, tuple(core)), [*own, dim, size, at], held, kept

    def worked(found: Iterator[tuple]) -> Iterator[list]:
        """Bricks of a shape are worked on at once, a bounded number of values at a time."""
        held: dict[tuple, list[tuple]] = {}
        size = 0

        def flush():
            for (wide, middle, core), some in held.items():
                made = work({c: np.stack([x[c] for _, x, _ in some]) for c in columns}, np.ones(wide[::-1], bool))
                for n, (row, _, kept) in enumerate(some):
                    yield [*row, *(_box(made[c][n], middle, core) for c in outputs), *(kept[c] for c in keep)]

        for shape, *one in found:
            held.setdefault(shape, []).append(one)
            size += int(np.prod(shape[0])) * (len(carried) + len(outputs))
            if size >= VALUES:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    def met(batches, types):
        """Bricks, one after the other, of rows in their order."""
        waiting: list[tuple] = []
        for batch in batches:
            types[:] = [batch.column(k).type for k in keys]
            own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            places = [batch.column(c).to_pylist() for c in ("dim", "size", "at", "low", "shape")]
            parts = [(batch.column(c).flatten().to_numpy(), batch.column(c).value_lengths().to_numpy()) for c in carried]
            ends = [(x, np.concatenate([[0], np.cumsum(n)])) for x, n in parts]
            for r, (k, *place) in enumerate(zip(own, *places, strict=True)):
                if waiting and (waiting[-1][0] != k or waiting[-1][3] != place[2]):
                    yield brick(waiting)
                    waiting = []
                waiting.append((k, *place, [x[e[r] : e[r + 1]] for x, e in ends]))
        if waiting:
            yield brick(waiting)

    def meet(batches):
        types: list[pa.DataType] = []
        yield from _batches(worked(met(batches, types)), out, types, 3)  # which are known with the first row

    edges_of = bricks.mapInArrow(send, sent)
    return edges_of.repartition(*keys, "at").sortWithinPartitions(*keys, "at").mapInArrow(meet, out)


def whole(bricks: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Volumes again, a row each: for those that fit a task."""
    ship(bricks.sparkSession)
    full = _schema(bricks, keys, columns)
    schema = T.StructType([f for f in full.fields if f.name not in ("size", "at")])

    def meet(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        made = [np.zeros(tuple(dim)[::-1]) for _ in columns]
        parts = [table.column(c).combine_chunks() for c in columns]
        for r in range(len(table)):
            start, core = _core(table.column("at")[r].as_py(), table.column("size")[r].as_py(), dim)
            for x, part in zip(made, parts, strict=True):
                _box(x, start, core)[...] = _values(part, r, core)
        return pa.Table.from_batches([_batch([[*(table.column(k)[0].as_py() for k in keys), dim, *made]], schema, [table.column(k).type for k in keys], 1)])

    return bricks.groupBy(*keys).applyInArrow(meet, schema)


def convolve(bricks: DataFrame, keys: Sequence[str], taps: Sequence[float], data: str = "data") -> DataFrame:
    """Separable convolution with symmetric taps (odd in number)."""
    reach = len(taps) // 2

    def work(arrays: Arrays, inside: np.ndarray) -> Arrays:
        x = arrays[data]
        for axis in range(1, 4):
            wide = np.pad(x, [(reach, reach) if a == axis else (0, 0) for a in range(4)])
            n = x.shape[axis]
            # What an axis has spread beyond the volume is taken back before the next one.
            x = inside * sum(t * wide[tuple(slice(s, s + n) if a == axis else slice(None) for a in range(4))] for s, t in enumerate(taps))
        return {data: x}

    return exchange(bricks, keys, [data], reach, work, [data])


def surface(bricks: DataFrame, keys: Sequence[str], above: float = 0.5, data: str = "data", out: str = "surface") -> DataFrame:
    """1 at voxels of the mask with any of their six neighbours outside it, 0 elsewhere."""

    def work(arrays: Arrays, inside: np.ndarray) -> Arrays:
        mask = (arrays[data] > above) & inside
        wide, inner = np.pad(mask, [(0, 0), (1, 1), (1, 1), (1, 1)]), mask.copy()
        for axis in range(1, 4):
            for step in (-1, 1):
                inner &= np.roll(wide, step, axis)[:, 1:-1, 1:-1, 1:-1]
        return {out: (mask & ~inner).astype(float)}

    return exchange(bricks, keys, [data], 1, work, [out])


def clean(bricks: DataFrame, keys: Sequence[str], tissues: Sequence[str] = ("gm", "wm", "csf"), others: Sequence[str] = (), level: int = 2, halo: int = HALO, rounds: int = ROUNDS) -> DataFrame:
    """The clean-up of ``cleanup.clean_tissue`` on bricks, whose columns are the classes'
    probabilities: ``rounds`` of conditional dilation from white matter, ``rounds`` more into
    fluid, ``halo`` of them between two exchanges; then the gates and the classes' new shares."""
    grey, white, fluid = tissues
    later, eps = LATER[2] if level == 2 else LATER[1], np.finfo(float).eps

    def grown(first: int, count: int, start: str | None, end: str, support: Sequence[str], thresholds: Callable[[int], float]) -> Work:
        def work(arrays: Arrays, inside: np.ndarray) -> Arrays:
            x, held = arrays[start or white], sum(arrays[c] for c in support)
            for n in range(first, first + count):
                x = inside * smooth((x > thresholds(n)) * held)
            return {end: x}

        return work

    classes = [*tissues, *others]
    at = "_brain"
    for first in range(0, rounds, halo):
        count = min(halo, rounds - first)
        take = [grey, white] if first == 0 else [at, grey, white]
        bricks = exchange(bricks, keys, take, count, grown(first, count, None if first == 0 else at, at, (white, grey), lambda n: FIRST_THRESHOLD if n < 2 else later), [at], classes)
    for first in range(0, rounds, halo):
        count = min(halo, rounds - first)
        begin = at if first == 0 else "_head"
        keep = [*classes, at]
        bricks = exchange(bricks, keys, [begin, grey, white, fluid], count, grown(first, count, begin, "_head", (white, grey, fluid), lambda n: later), ["_head"], keep)

    def gates(arrays: Arrays, inside: np.ndarray) -> Arrays:
        p = {c: arrays[c] for c in classes}
        keep = ((arrays[at] > GATE) * (p[grey] + p[white])) > GATE
        p |= {c: p[c] * keep for c in (grey, white)}
        keep = ((arrays["_head"] > GATE) * (p[grey] + p[white] + p[fluid])) > GATE
        p[fluid] = p[fluid] * keep
        total = sum(p.values()) + eps
        return {c: x / total for c, x in p.items()}

    return exchange(bricks, keys, [*classes, at, "_head"], 0, gates, classes)
