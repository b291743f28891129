"""Volumes that each have their own grid: dimensions and affines are columns of the table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.operators import affines as af
from tessera.operators import bricks
from tessera.operators import geometry as geo
from tessera.operators import tiles as tl
from tessera.operators import volumes as vol
from tessera.plans.runtime import Scratch, table
from tessera.queries.common import q6, r6
from tessera.sources import slices

#: Dimensions by the remainder of the volume's number.
DIMS = ((4, 4, 4), (5, 4, 3), (3, 5, 4), (8, 4, 2), (2, 3, 7))
#: The affine's twelve values of a volume's number ``n``, as SQL that Spark and DuckDB share.
VALUES = (
    "CASE WHEN n % 3 = 0 THEN -1 ELSE 1 END * (1.1D + 0.03D * (n % 7))", "0.11D", "0.0D", "n % 13 - 5.3D",
    "0.07D * (1 + n % 2)", "0.9D + 0.02D * (n % 5)", "0.05D", "2.21D - n % 7",
    "0.0D", "-0.04D", "1.7D + 0.05D * (n % 11)", "0.37D * (n % 17)",
)
NEW_SIZE = (1.5, 0.0, 2.0)


def volumes(spark, d) -> DataFrame:
    """Each embedding as a volume as long as its own dimensions take."""
    dim = F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in DIMS)), (F.col("vec_id") % len(DIMS) + 1).cast("int"))
    rows = table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.col("vec_id").alias("n"), dim.alias("dim"), "embedding")
    affine = F.array(*map(F.expr, VALUES), *map(F.lit, (0.0, 0.0, 0.0, 1.0)))
    size = F.get("dim", F.lit(0)) * F.get("dim", F.lit(1)) * F.get("dim", F.lit(2))
    return rows.select("vec_id", "dim", affine.alias("affine"), vol.doubles(F.slice("embedding", F.lit(1), size)).alias("data"))


def with_next(spark, d) -> DataFrame:
    """Each volume with the grid of the next one: an equi-join on the number."""
    v = volumes(spark, d)
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("dim").alias("next_dim"), F.col("affine").alias("next_affine")), "vec_id")


_LISTS = ", ".join("[" + ", ".join(map(str, x)) + "]" for x in DIMS)
_AFFINE = "[" + ", ".join(f"CAST({re.sub(r'([0-9.]+)D', r'CAST(\1 AS DOUBLE)', v)} AS DOUBLE)" for v in VALUES) + "]"
VOLS = f"""vols AS (
  SELECT vec_id, ([{_LISTS}])[vec_id % {len(DIMS)} + 1] AS dim, m, embedding FROM (SELECT vec_id, embedding, {_AFFINE} AS m FROM (SELECT *, vec_id AS n FROM embeddings WHERE embedding IS NOT NULL))
)"""
MIXED = f"""{VOLS}, mix AS (
  SELECT vec_id, CAST(p % dim[1] + 1 AS INTEGER) AS i, CAST((p // dim[1]) % dim[2] + 1 AS INTEGER) AS j,
         CAST(p // (dim[1] * dim[2]) + 1 AS INTEGER) AS k, CAST(embedding[p + 1] AS DOUBLE) AS v
  FROM vols, range(64) AS t(p) WHERE p < dim[1] * dim[2] * dim[3]
)"""


def product_sql(a: str, b: str) -> str:
    """Twelve values of a product, of lists of twelve."""
    row = lambda r, c: " + ".join(f"{a}[{4 * r + k + 1}] * {b}[{4 * k + c + 1}]" for k in range(3)) + (f" + {a}[{4 * r + 4}]" if c == 3 else "")
    return "[" + ", ".join(row(r, c) for r in range(3) for c in range(4)) + "]"


def determinant_sql(m: str) -> str:
    e = lambda r, c: f"{m}[{4 * r + c + 1}]"
    return " + ".join(f"{e(0, c)} * ({e(1, (c + 1) % 3)} * {e(2, (c + 2) % 3)} - {e(1, (c + 2) % 3)} * {e(2, (c + 1) % 3)})" for c in range(3))


def inverse_sql(m: str) -> str:
    """Columns of the inverse are cross products of rows over the determinant."""
    e = lambda r, c: f"{m}[{4 * r + c + 1}]"
    cross = lambda r, c: f"(({e((c + 1) % 3, (r + 1) % 3)} * {e((c + 2) % 3, (r + 2) % 3)} - {e((c + 1) % 3, (r + 2) % 3)} * {e((c + 2) % 3, (r + 1) % 3)}) / ({determinant_sql(m)}))"
    return "[" + ", ".join(", ".join([*(cross(r, c) for c in range(3)), "-(" + " + ".join(f"{cross(r, c)} * {e(c, 3)}" for c in range(3)) + ")"]) for r in range(3)) + "]"


def at_sql(m: str, at=("i", "j", "k")) -> list[str]:
    return [f"({m}[{4 * r + 1}] * {at[0]} + {m}[{4 * r + 2}] * {at[1]} + {m}[{4 * r + 3}] * {at[2]} + {m}[{4 * r + 4}])" for r in range(3)]


def _entries(named: dict, frame: DataFrame) -> DataFrame:
    """A row an entry of each named matrix."""
    upper = lambda m: F.slice(m, 1, 12)
    rows = frame.select("vec_id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), upper(m).alias("m")) for n, m in named.items()))).alias("s"))
    return rows.select("vec_id", "s.name", F.posexplode("s.m").alias("p", "x")).select("vec_id", "name", (F.floor(F.col("p") / 4) + 1).cast("int").alias("r"), (F.col("p") % 4 + 1).cast("int").alias("c"), r6(F.col("x"), "x"))


def _entries_sql(source: str) -> str:
    """The same of a table (vec_id, name, m)."""
    return f"SELECT vec_id, name, CAST(p // 4 + 1 AS INTEGER) AS r, CAST(p % 4 + 1 AS INTEGER) AS c, {q6('m[p + 1]', 'x')} FROM ({source}), range(12) AS t(p)"


def affine_algebra(spark, d):
    """Product, left and right division of each volume's affine and the next one's, and a
    shift of the origin."""
    a, b = "affine", "next_affine"
    return _entries({"A * B": af.product(a, b), "A \\ B": af.left_divide(a, b), "A / B": af.right_divide(a, b), "T * A": af.translated(a, (1.0, 2.0, 3.0))}, with_next(spark, d))


def _algebra_sql():
    pairs = "prs AS (SELECT a.vec_id, a.m AS a, b.m AS b FROM vols a JOIN vols b ON b.vec_id = a.vec_id + 1), inv AS (SELECT *, " + inverse_sql("a") + " AS ia, " + inverse_sql("b") + " AS ib FROM prs)"
    shift = "list_transform(a, lambda x, n: x + CASE n WHEN 4 THEN 1 WHEN 8 THEN 2 WHEN 12 THEN 3 ELSE 0 END)"
    made = [("A * B", product_sql("a", "b")), ("A \\ B", product_sql("ia", "b")), ("A / B", product_sql("a", "ib")), ("T * A", shift)]
    return f"WITH {VOLS}, {pairs} " + _entries_sql(" UNION ALL ".join(f"SELECT vec_id, '{n}' AS name, {m} AS m FROM inv" for n, m in made))


def origin_reset(spark, d):
    """Each grid's middle at 0, mirrored where the affine is; and what takes the old to it."""
    v = volumes(spark, d).withColumn("new", af.upright_origin("affine", "dim"))
    return _entries({"new": F.col("new"), "moved": af.right_divide("new", "affine")}, v)


SIZES_SQL = "[" + ", ".join(f"sqrt({' + '.join(f'm[{4 * r + c + 1}] * m[{4 * r + c + 1}]' for r in range(3))})" for c in range(3)) + "]"


def _origin_sql():
    middle = lambda c: f"-s[{c}] * (dim[{c}] + 1) / 2"
    sized = f"SELECT vec_id, dim, m, [sz[1] * CASE WHEN {determinant_sql('m')} < 0 THEN -1 ELSE 1 END, sz[2], sz[3]] AS s FROM (SELECT *, {SIZES_SQL} AS sz FROM vols)"
    new = f"[s[1], 0, 0, {middle(1)}, 0, s[2], 0, {middle(2)}, 0, 0, s[3], {middle(3)}]"
    both = f"up AS (SELECT vec_id, {new} AS new, {inverse_sql('m')} AS im FROM ({sized}))"
    return f"WITH {VOLS}, {both} " + _entries_sql(f"SELECT vec_id, 'new' AS name, new AS m FROM up UNION ALL SELECT vec_id, 'moved', {product_sql('new', 'im')} FROM up")


def voxel_resize(spark, d):
    """Another voxel size: affine, and dimensions rounded down (size 0 counts as 1)."""
    m, n = af.resized("affine", "dim", NEW_SIZE)
    return _entries({"affine": m, "dim": F.concat(n.cast("array<double>"), F.array_repeat(F.lit(0.0), 9))}, volumes(spark, d))


_RATIO = "[sz[1] / 1.5, sz[2] / 1.0, sz[3] / 2.0]"
RESIZED = f"""res AS (
  SELECT vec_id, embedding, dim, m, list_transform(m, lambda x, n: CASE WHEN n % 4 = 0 THEN x ELSE x / r[1 + (n - 1) % 4] END) AS new,
         [CAST(floor(r[1] * dim[1]) AS INTEGER), CAST(floor(r[2] * dim[2]) AS INTEGER), CAST(floor(r[3] * dim[3]) AS INTEGER)] AS shape
  FROM (SELECT *, {_RATIO} AS r FROM (SELECT *, {SIZES_SQL} AS sz FROM vols))
)"""


def corners_box(spark, d):
    low, high = af.corners_box("affine", "dim")
    v = volumes(spark, d).select("vec_id", F.posexplode(F.arrays_zip(low.alias("low"), high.alias("high"))).alias("p", "s"))
    return v.select("vec_id", F.element_at(F.array(*map(F.lit, "xyz")), F.col("p") + 1).alias("axis"), r6(F.col("s.low"), "low"), r6(F.col("s.high"), "high"))


def _corners_sql():
    ends = "(VALUES (0), (1)) a(x), (VALUES (0), (1)) b(y), (VALUES (0), (1)) c(z)"
    at = at_sql("m", tuple(f"CASE {n} WHEN 1 THEN dim[{a + 1}] ELSE 1 END" for a, n in enumerate("xyz")))
    return f"WITH {VOLS}, e AS (SELECT vec_id, {at[0]} AS x, {at[1]} AS y, {at[2]} AS z FROM vols, {ends}) " + " UNION ALL ".join(f"SELECT vec_id, '{c}' AS axis, {q6(f'round(min({c}))', 'low')}, {q6(f'round(max({c}))', 'high')} FROM e GROUP BY vec_id" for c in "xyz")


def identity_grid(spark, d):
    """All voxels of each volume's own grid."""
    v = volumes(spark, d).select("vec_id", "dim")
    for n, axis in enumerate(geo.AXES):
        v = v.withColumn(axis, F.explode(F.sequence(F.lit(1), F.get("dim", F.lit(n)))))
    return v.select("vec_id", *geo.AXES)


def _cells(out: DataFrame, dim: str = "dim") -> DataFrame:
    return vol.to_cells(out, dim, ["vec_id"]).where("v IS NOT NULL").select("vec_id", "i", "j", "k", r6(F.col("v"), "v"))


def _resized(spark, d) -> DataFrame:
    new, shape = af.resized("affine", "dim", NEW_SIZE)
    return volumes(spark, d).withColumns({"new_affine": new, "new_dim": shape}).withColumn("places", af.left_divide("affine", "new_affine"))


def mixed_resample(spark, d):
    """Each volume at voxels of 1.5 x 1 x 2 mm, between eight of its own, within its range."""
    return _cells(tl.pull(_resized(spark, d), "places", "dim", "new_dim", clamp=True), "new_dim")


def mixed_resample_nearest(spark, d):
    """Each volume on the grid of the next one, nearest voxels."""
    v = with_next(spark, d).withColumn("places", af.left_divide("affine", "next_affine"))
    return _cells(tl.pull(v, "places", "dim", "next_dim", order=0), "next_dim")


def grid_sql(source: str, dim: str, keep: str) -> str:
    """Voxels of each row's grid."""
    return f"SELECT {keep}, CAST(p % {dim}[1] + 1 AS INTEGER) AS i, CAST((p // {dim}[1]) % {dim}[2] + 1 AS INTEGER) AS j, CAST(p // ({dim}[1] * {dim}[2]) + 1 AS INTEGER) AS k FROM {source}, range(4096) AS t(p) WHERE p < {dim}[1] * {dim}[2] * {dim}[3]"


CORNERS = """cor AS (
  SELECT vec_id, i, j, k, CAST(floor(x) AS INTEGER) + a AS ci, CAST(floor(y) AS INTEGER) + b AS cj, CAST(floor(z) AS INTEGER) + c AS ck,
         CASE WHEN a = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END * CASE WHEN b = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE WHEN c = 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END AS w
  FROM pts, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b), (VALUES (0), (1)) r(c)
)"""


def _points_sql(source: str, dim: str, m: str) -> str:
    x, y, z = at_sql("t")
    return f"pts AS (SELECT vec_id, i, j, k, {x} AS x, {y} AS y, {z} AS z FROM ({grid_sql(f'(SELECT *, {m} AS t FROM {source})', dim, 'vec_id, t')}))"


def _resample_sql():
    inverse = f"rs AS (SELECT *, {inverse_sql('m')} AS im FROM res)"
    summed = "s AS (SELECT c.vec_id, c.i, c.j, c.k, coalesce(sum(w * q.v), 0) AS v FROM cor c LEFT JOIN mix q ON q.vec_id = c.vec_id AND q.i = ci AND q.j = cj AND q.k = ck GROUP BY ALL)"
    return f"WITH {MIXED}, {RESIZED}, {inverse}, {_points_sql('rs', 'shape', product_sql('im', 'new'))}, {CORNERS}, {summed}, e AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM mix GROUP BY 1) SELECT vec_id, i, j, k, {q6('least(hi, greatest(lo, v))', 'v')} FROM s JOIN e USING (vec_id)"


def _next_sql(columns: str) -> str:
    return f"prs AS (SELECT a.vec_id, a.dim, b.dim AS other, {columns} FROM vols a JOIN vols b ON b.vec_id = a.vec_id + 1)"


def _nearest_sql():
    pairs = _next_sql(f"{inverse_sql('a.m')} AS im, b.m AS bm")
    return f"WITH {MIXED}, {pairs}, {_points_sql('prs', 'other', product_sql('im', 'bm'))} SELECT p.vec_id, p.i, p.j, p.k, {q6('coalesce(q.v, 0)', 'v')} FROM pts p LEFT JOIN mix q ON q.vec_id = p.vec_id AND q.i = floor(x + 0.5) AND q.j = floor(y + 0.5) AND q.k = floor(z + 0.5)"


def mixed_fov(spark, d):
    """Voxels that the next volume's grid does not cover are -1."""
    v = with_next(spark, d)
    return _cells(v.withColumn("data", af.outside_view("data", "dim", "next_affine", "next_dim", "affine", -1.0)))


def _fov_sql():
    pairs = _next_sql(f"{inverse_sql('b.m')} AS ib, a.m AS am")
    inside = " AND ".join(f"{c} >= 1 AND {c} < other[{n + 1}]" for n, c in enumerate("xyz"))
    return f"WITH {MIXED}, {pairs}, {_points_sql('prs', 'dim', product_sql('ib', 'am'))} SELECT vec_id, i, j, k, {q6(f'CASE WHEN {inside} THEN v ELSE -1 END', 'v')} FROM pts JOIN mix USING (vec_id, i, j, k) JOIN prs USING (vec_id)"


def mixed_push(spark, d):
    """Each volume's values scattered to the next one's grid, as weighted means."""
    v = with_next(spark, d).withColumn("places", af.left_divide("next_affine", "affine"))
    return _cells(tl.push(v, "places", "dim", "next_dim"), "next_dim")


def _push_sql():
    pairs = _next_sql(f"{inverse_sql('b.m')} AS ib, a.m AS am")
    return f"WITH {MIXED}, {pairs}, {_points_sql('prs', 'dim', product_sql('ib', 'am'))}, {CORNERS} SELECT c.vec_id, ci AS i, cj AS j, ck AS k, {q6('sum(w * v) / sum(w)', 'v')} FROM cor c JOIN mix USING (vec_id, i, j, k) JOIN prs USING (vec_id) WHERE w > 0 AND ci BETWEEN 1 AND other[1] AND cj BETWEEN 1 AND other[2] AND ck BETWEEN 1 AND other[3] GROUP BY c.vec_id, ci, cj, ck"


def mixed_smooth(spark, d):
    return _cells(tl.convolve(volumes(spark, d), "dim", geo.SMOOTHING))


def _smooth_sql():
    at, out = "mix", []
    for n, axis in enumerate("ijk"):
        other = ", ".join(a for a in "ijk" if a != axis)
        out.append(f"c{n} AS (SELECT vec_id, i, j, k, CAST(0.3 AS DOUBLE) * coalesce(lag(v) OVER w, 0) + CAST(0.4 AS DOUBLE) * v + CAST(0.3 AS DOUBLE) * coalesce(lead(v) OVER w, 0) AS v FROM {at} WINDOW w AS (PARTITION BY vec_id, {other} ORDER BY {axis}))")
        at = f"c{n}"
    return f"WITH {MIXED}, {', '.join(out)} SELECT vec_id, i, j, k, {q6('v', 'v')} FROM c2"


def mixed_surface(spark, d):
    out = tl.surface(volumes(spark, d), "dim", 0.0)
    return vol.to_cells(out, "dim", ["vec_id"], "surface").where("v = 1").select("vec_id", "i", "j", "k")


def mixed_reorient(spark, d):
    """Each volume on its upright grid, nearest voxels; those beyond the old grid are absent."""
    new, shape = af.upright("affine", "dim")
    v = volumes(spark, d).withColumns({"new_affine": new, "new_dim": shape}).withColumn("places", af.left_divide("affine", "new_affine"))
    ones = v.withColumn("inside", F.transform("data", lambda _: F.lit(1.0)))
    out = tl.pull(tl.pull(ones, "places", "dim", "new_dim", order=0), "places", "dim", "new_dim", order=0, data="inside", out="inside")
    seen = F.zip_with("data", "inside", lambda x, there: F.when(there > 0, x))
    return _cells(out.withColumn("data", seen), "new_dim")


def _reorient_sql():
    ends = "(VALUES (0), (1)) a(x), (VALUES (0), (1)) b(y), (VALUES (0), (1)) c(z)"
    at = at_sql("m", tuple(f"CASE {n} WHEN 1 THEN dim[{a + 1}] ELSE 1 END" for a, n in enumerate("xyz")))
    box = f"e AS (SELECT vec_id, {', '.join(f'round(min({x})) AS lo{c}, round(max({x})) AS hi{c}' for c, x in zip('xyz', at, strict=True))} FROM vols, {ends} GROUP BY vec_id)"
    new = "[sz[1], 0, 0, lox - sz[1], 0, sz[2], 0, loy - sz[2], 0, 0, sz[3], loz - sz[3]]"
    shape = "[" + ", ".join(f"CAST(ceil((hi{c} - lo{c}) / sz[{n + 1}] + 1) AS INTEGER)" for n, c in enumerate("xyz")) + "]"
    up = f"up AS (SELECT vec_id, {new} AS new, {shape} AS shape, {inverse_sql('m')} AS im FROM (SELECT *, {SIZES_SQL} AS sz FROM vols) JOIN e USING (vec_id))"
    return f"WITH {MIXED}, {box}, {up}, {_points_sql('up', 'shape', product_sql('im', 'new'))} SELECT p.vec_id, p.i, p.j, p.k, {q6('q.v', 'v')} FROM pts p JOIN mix q ON q.vec_id = p.vec_id AND q.i = floor(x + 0.5) AND q.j = floor(y + 0.5) AND q.k = floor(z + 0.5)"


def mixed_slice_at(spark, d):
    """The voxel of each volume nearest to a point in millimetres, and the slice it is in."""
    v = volumes(spark, d).withColumn("at", af.slice_at("affine", (1.3, 4.1, 5.2), "dim"))
    nx, ny = (F.get("dim", F.lit(n)) for n in range(2))
    k = F.get("at", F.lit(2))
    cut = v.withColumn("data", F.slice("data", (k - 1) * nx * ny + 1, nx * ny))
    cells = vol.to_cells(cut.withColumn("z", k), "dim", ["vec_id", "z"])
    return cells.select("vec_id", "i", "j", F.col("z").alias("k"), r6(F.col("v"), "v"))


def _slice_sql():
    at = at_sql("im", ("CAST(1.3 AS DOUBLE)", "CAST(4.1 AS DOUBLE)", "CAST(5.2 AS DOUBLE)"))
    return f"WITH {MIXED}, s AS (SELECT vec_id, CAST(least(greatest(floor({at[2]} + 0.5), 1), dim[3]) AS INTEGER) AS z FROM (SELECT *, {inverse_sql('m')} AS im FROM vols)) SELECT vec_id, i, j, k, {q6('v', 'v')} FROM mix JOIN s USING (vec_id) WHERE k = z"


def table_grid(spark, d):
    """Each volume's voxels in millimetres, by a table function in SQL."""
    tables.register(spark)
    volumes(spark, d).createOrReplaceTempView("tessera_volumes")
    rows = spark.sql("SELECT vec_id, g.* FROM tessera_volumes, LATERAL voxel_grid(dim, affine) g")
    return rows.select("vec_id", "i", "j", "k", *(r6(F.col(c), c) for c in "xyz"))


def table_histogram(spark, d):
    """Ten bins of each volume's values."""
    tables.register(spark)
    volumes(spark, d).createOrReplaceTempView("tessera_volumes")
    return spark.sql("SELECT vec_id, h.bin, h.n FROM tessera_volumes, LATERAL histogram_bins(data, -0.3D, 0.3D, 10) h")


def stored_slices(spark, d):
    """Slice 3 of every volume that has one, from a table that is laid out by slice."""
    path = Scratch(spark, "slices").base
    slices.save_slices(volumes(spark, d), path, ["vec_id"], "dim")
    return slices.slice_voxels(slices.read_slices(spark, path, 3), ["vec_id"]).select("vec_id", "i", "j", "k", r6(F.col("v"), "v"))


def _in_bricks(spark, d):
    return bricks.cut(volumes(spark, d), ["vec_id"], ["data"], "dim", (4, 4, 2))


def bricks_smooth(spark, d):
    """Smoothing of volumes that are cut in bricks of up to 4 x 4 x 2 voxels."""
    return _cells(bricks.whole(bricks.convolve(_in_bricks(spark, d), ["vec_id"], geo.SMOOTHING), ["vec_id"], ["data"]))


def bricks_surface(spark, d):
    out = bricks.whole(bricks.surface(_in_bricks(spark, d), ["vec_id"], 0.0), ["vec_id"], ["surface"])
    return vol.to_cells(out, "dim", ["vec_id"], "surface").where("v = 1").select("vec_id", "i", "j", "k")


NEAR6 = "(VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(a, b, c)"

SURFACE_SQL = f"WITH {MIXED}, mask AS (SELECT vec_id, i, j, k FROM mix WHERE v > 0) SELECT m.vec_id, m.i, m.j, m.k FROM mask m, {NEAR6} LEFT JOIN mask n ON n.vec_id = m.vec_id AND n.i = m.i + a AND n.j = m.j + b AND n.k = m.k + c GROUP BY ALL HAVING count(n.vec_id) < 6"

QUERIES = {
    "affine_algebra": (affine_algebra, _algebra_sql()),
    "origin_reset": (origin_reset, _origin_sql()),
    "voxel_resize": (voxel_resize, f"WITH {VOLS}, {RESIZED} " + _entries_sql("SELECT vec_id, 'affine' AS name, new AS m FROM res UNION ALL SELECT vec_id, 'dim', list_concat(list_transform(shape, lambda x: CAST(x AS DOUBLE)), list_transform(range(9), lambda x: CAST(0 AS DOUBLE))) FROM res")),
    "corners_box": (corners_box, _corners_sql()),
    "identity_grid": (identity_grid, f"WITH {VOLS} {grid_sql('vols', 'dim', 'vec_id')}"),
    "mixed_resample": (mixed_resample, _resample_sql()),
    "mixed_resample_nearest": (mixed_resample_nearest, _nearest_sql()),
    "mixed_fov": (mixed_fov, _fov_sql()),
    "mixed_push": (mixed_push, _push_sql()),
    "mixed_smooth": (mixed_smooth, _smooth_sql()),
    "mixed_surface": (mixed_surface, SURFACE_SQL),
    "bricks_smooth": (bricks_smooth, _smooth_sql()),
    "table_grid": (table_grid, f"WITH {VOLS} SELECT vec_id, i, j, k, {q6(at_sql('m')[0], 'x')}, {q6(at_sql('m')[1], 'y')}, {q6(at_sql('m')[2], 'z')} FROM ({grid_sql('vols', 'dim', 'vec_id, m')})"),
    "table_histogram": (table_histogram, f"WITH {MIXED}, b AS (SELECT vec_id, CAST(1 + least(greatest(floor((v + 0.3) / (0.6 / 10)), 0), 9) AS INTEGER) AS bin FROM mix) SELECT v.vec_id, CAST(r AS INTEGER) AS bin, count(b.bin) AS n FROM vols v CROSS JOIN range(1, 11) t(r) LEFT JOIN b ON b.vec_id = v.vec_id AND b.bin = r GROUP BY ALL"),
    "stored_slices": (stored_slices, f"WITH {MIXED} SELECT vec_id, i, j, k, {q6('v', 'v')} FROM mix WHERE k = 3"),
    "bricks_surface": (bricks_surface, SURFACE_SQL),
    "mixed_reorient": (mixed_reorient, _reorient_sql()),
    "mixed_slice_at": (mixed_slice_at, _slice_sql()),
}
