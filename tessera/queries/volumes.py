"""Voxel-wise operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import numeric as num
from tessera.operators import metrics
from tessera.operators import volumes as vol
from tessera.queries.common import ATLAS, DIM, VOX, atlas, cells, q6, r6, tiles

SOFT = f"""{ATLAS}, e AS (SELECT vec_id, voxel, list_max(l) AS mx, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM atlas),
soft AS (SELECT vec_id, voxel, list_transform(e || [exp(-mx)], lambda x: x / (list_sum(e) + exp(-mx))) AS p FROM e)"""


def dice(spark, d):
    """The headline metric: overlap of two methods' masks for each subject, in tile form."""
    t = tiles(spark, d)
    subject = F.expr("vec_id div 2").alias("subject")
    a = t.where("vec_id % 2 = 0").select(subject, metrics.mask_of(F.col("data"), 0.0).alias("a"))
    b = t.where("vec_id % 2 = 1").select(subject, metrics.mask_of(F.col("data"), 0.0).alias("b"))
    return metrics.dice_masks(a.join(b, "subject"), ["subject"], "a", "b").select("subject", r6(F.col("dice"), "dice"))


DICE = f"""WITH {VOX}, m AS (
  SELECT vec_id // 2 AS subject, i, j, k, max(CASE WHEN vec_id % 2 = 0 THEN v > 0 END) AS a, max(CASE WHEN vec_id % 2 = 1 THEN v > 0 END) AS b
  FROM vox GROUP BY ALL
), s AS (
  SELECT subject, count(*) FILTER (a AND b) AS n_both, count(*) FILTER (a) AS na, count(*) FILTER (b) AS nb, count(a) AS has_a, count(b) AS has_b
  FROM m GROUP BY subject
)
SELECT subject, {q6("CASE WHEN na + nb = 0 THEN 1 ELSE 2.0 * n_both / CAST(na + nb AS DOUBLE) END", "dice")} FROM s WHERE has_a > 0 AND has_b > 0"""


def dice_cells(spark, d):
    c = cells(spark, d).withColumn("subject", F.expr("vec_id div 2"))
    a, b = (c.where(F.col("vec_id") % 2 == n).select("subject", "i", "j", "k", "v") for n in (0, 1))
    both = a.select("subject").intersect(b.select("subject"))
    found = metrics.dice_cells(a, b, ["subject"], 0.0)
    return found.join(both, "subject", "left_semi").select("subject", r6(F.col("dice"), "dice"))


def mask_range(spark, d):
    return tiles(spark, d).select("vec_id", vol.count_where(F.col("data"), lambda x: num.between_open(x, -0.1, 0.1)).alias("n_inside"), vol.count_where(F.col("data"), lambda x: x > 0.05).alias("n_above"))


def mask_assign(spark, d):
    t = tiles(spark, d)
    kept = vol.mask_assign(F.col("data"), F.transform("data", lambda x: x > 0.05), -1.0)
    return vol.to_cells(t.select("vec_id", kept.alias("data")), DIM, ["vec_id"]).select("vec_id", "i", "j", "k", r6(F.col("v"), "v"))


def clamp_window(spark, d):
    c = cells(spark, d)
    return c.select("vec_id", "i", "j", "k", r6(num.clamp(F.col("v"), -0.1, 0.1), "clamped"), r6(num.window_level(F.col("v"), -0.05, 0.1), "shown"))


def finite_or_zero(spark, d):
    hole = F.when(F.col("i") == 2, F.lit(float("nan"))).when(F.col("j") == 3, F.lit(float("inf"))).otherwise(F.col("v"))
    return cells(spark, d).select("vec_id", "i", "j", "k", r6(num.finite_or(hole), "v"))


def channel_duplicate(spark, d):
    doubled = num.channels(F.col("logp"), (1, 1, 2, 2, 3, 4))
    return atlas(spark, d).select("vec_id", "voxel", F.posexplode(doubled).alias("pos", "v")).select("vec_id", "voxel", (F.col("pos") + 1).cast("int").alias("channel"), r6(F.col("v"), "v"))


def index_remap(spark, d):
    """Gaussians of a class after its channel was doubled: 1 2 3 4, the rest moved by two."""
    n = F.col("n")
    return tiles(spark, d).select("vec_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("n")).select("vec_id", "n", F.when(n <= 4, n).otherwise(n + 2).alias("g"))


def linear_index(spark, d):
    return cells(spark, d).select("vec_id", "i", "j", "k", vol.linear_index(F.col("i"), F.col("j"), F.col("k"), DIM).alias("at"))


def tile_round_trip(spark, d):
    back = vol.to_tiles(cells(spark, d), DIM, ["vec_id"])
    return back.select("vec_id", r6(F.element_at("data", 7), "v7"), F.size("data").alias("n"))


def softmax_background(spark, d):
    p = num.softmax_background(F.col("logp"))
    return atlas(spark, d).select("vec_id", "voxel", F.posexplode(p).alias("pos", "p")).select("vec_id", "voxel", (F.col("pos") + 1).cast("int").alias("class"), r6(F.col("p"), "p"))


def softmax_plain(spark, d):
    p = num.softmax_plain(F.col("logp"))
    return atlas(spark, d).select("vec_id", "voxel", F.posexplode(p).alias("pos", "p")).select("vec_id", "voxel", (F.col("pos") + 1).cast("int").alias("class"), r6(F.col("p"), "p"))


def implicit_background(spark, d):
    return atlas(spark, d).select("vec_id", "voxel", r6(num.implicit_background(F.transform("logp", lambda x: F.abs(x) * 2)), "bg"))


def renormalise(spark, d):
    p = num.renormalise(F.transform(F.slice("data", 1, 6), F.abs))
    return tiles(spark, d).select("vec_id", F.posexplode(p).alias("pos", "p")).select("vec_id", (F.col("pos") + 1).cast("int").alias("class"), r6(F.col("p"), "p"))


def skull_strip(spark, d):
    p = num.renormalise(F.transform(F.slice("data", 1, 6), F.abs))
    return tiles(spark, d).select("vec_id", r6(vol.skull_strip(p, F.element_at("data", 9)), "v"))


def icv_mask(spark, d):
    return atlas(spark, d).select("vec_id", "voxel", vol.inside_mask(num.softmax_background(F.col("logp"))).cast("int").alias("inside"))


def hemisphere_split(spark, d):
    """Each voxel's first channel is its own value, the others the volume's next slots."""
    t = tiles(spark, d)
    first = F.slice("data", 1, 5)
    lowest = t.agg(F.min(F.array_min(first)).alias("lowest"))  # one row
    c = vol.to_cells(t, DIM, ["vec_id"]).join(t.select("vec_id", first.alias("p")), "vec_id").crossJoin(F.broadcast(lowest))
    split = num.hemisphere_split(F.concat(F.array("v"), F.slice("p", 2, 4)), F.col("i"), F.lit(4), F.col("lowest"))
    return c.select("vec_id", "i", "j", "k", F.posexplode(split).alias("pos", "x")).select("vec_id", "i", "j", "k", (F.col("pos") + 1).cast("int").alias("channel"), r6(F.col("x"), "x"))


def volumes_tbv_tiv(spark, d):
    t = tiles(spark, d).withColumn("tissue", F.element_at(F.array(F.lit("GM"), F.lit("WM"), F.lit("CSF"), F.lit("BONE")), (F.col("vec_id") % 4 + 1).cast("int"))).withColumn("subject", F.expr("vec_id div 4")).withColumn("data", F.transform("data", F.abs))
    found = metrics.volumes_ml(t, ["subject"], "tissue", "data", 1.5, ("GM", "WM"), ("GM", "WM", "CSF"))
    return found.select("subject", r6(F.col("tbv_ml"), "tbv_ml"), r6(F.col("tiv_ml"), "tiv_ml"))


def masked_volumes(spark, d):
    t = tiles(spark, d).withColumn("tissue", F.when(F.col("vec_id") % 2 == 0, "GM").otherwise("CSF")).withColumn("subject", F.expr("vec_id div 2")).withColumn("mask", F.transform("data", lambda x: x > 0))
    found = metrics.volumes_ml(t, ["subject"], "tissue", "data", 3.0, ("GM", "WM"), ("GM", "WM", "CSF"), "mask")
    return found.select("subject", r6(F.col("tbv_ml"), "tbv_ml"), r6(F.col("tiv_ml"), "tiv_ml"))


def _cov(spark, d):
    found = metrics.variation_arrays(tiles(spark, d), ["label"]).where("block = 0")  # volumes of 64 voxels
    cut = found.select("label", F.posexplode(F.arrays_zip("n", "mean", "var", "cov")).alias("p", "s")).where("s.n > 0")
    i, j, k = F.col("p") % 4 + 1, F.floor(F.col("p") / 4) % 4 + 1, F.floor(F.col("p") / 16) + 1
    return cut.select("label", i.alias("i"), j.cast("int").alias("j"), k.cast("int").alias("k"), "s.*")


def cov_map_cells(spark, d):
    c = cells(spark, d).join(tiles(spark, d).select("vec_id", "label"), "vec_id")
    return metrics.variation_map(c, ["label", "i", "j", "k"]).select("label", "i", "j", "k", "n", r6(F.col("mean"), "mean"), r6(F.col("var"), "var"), r6(F.col("cov"), "cov"))


def cov_map(spark, d):
    return _cov(spark, d).select("label", "i", "j", "k", "n", r6(F.col("mean"), "mean"), r6(F.col("var"), "var"), r6(F.col("cov"), "cov"))


def brain_cov(spark, d):
    found = metrics.brain_variation(_cov(spark, d), ["label"], 0.04, 0.06)
    return found.select("label", "n_voxels", r6(F.col("mean_cov"), "mean_cov"))


COV = f"""{VOX}, cov AS (
  SELECT label, i, j, k, count(*) AS n, avg(greatest(v, 0)) AS mean, greatest(var_samp(greatest(v, 0)), 0) AS var,
         sqrt(greatest(var_samp(greatest(v, 0)), 0)) / nullif(abs(avg(greatest(v, 0))), 0) AS cov
  FROM vox JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) WHERE v IS NOT NULL GROUP BY ALL
)"""


def quantise(kind):
    def run(spark, d):
        whole, slope = vol.quantise(F.col("data"), kind)
        t = tiles(spark, d).select("vec_id", whole.alias("data"), r6(slope * 1e6, "slope_e6"))
        return vol.to_cells(t, DIM, ["vec_id", "slope_e6"]).select("vec_id", "slope_e6", "i", "j", "k", F.col("v").cast("int").alias("q"))

    run.__name__ = f"quantise_{kind}"
    return run


def quantise_sql(slope, low, high):
    return f"""WITH {VOX}, s AS (SELECT vec_id, max(v) AS hi, min(v) AS lo FROM vox GROUP BY vec_id), m AS (SELECT vec_id, greatest({slope}, 0) AS slope FROM s)
SELECT vec_id, {q6("slope * 1e6", "slope_e6")}, i, j, k,
       CAST(CASE WHEN v IS NULL OR slope = 0 THEN 0 ELSE least(greatest(round(v / slope), {low}), {high}) END AS INTEGER) AS q
FROM vox JOIN m USING (vec_id)"""


def dequantise(spark, d):
    whole, slope = vol.quantise(F.col("data"), "int16")
    t = tiles(spark, d).select("vec_id", "data", vol.dequantise(whole, slope).alias("back"), slope.alias("slope"))
    off = F.array_max(F.zip_with("data", "back", lambda x, y: F.abs(x - y)))
    return t.select("vec_id", (off <= F.col("slope") * 0.5000001).alias("close"))


def class_sum(spark, d):
    return tiles(spark, d).select("vec_id", r6(vol.class_sum(F.col("data"), (1, 3, 4)), "total"))


def final_gate(spark, d):
    p = num.renormalise(F.transform(F.slice("data", 1, 6), F.abs))
    gated = vol.final_gate(F.element_at("data", 7) + 0.1, F.element_at("data", 8) + 0.1, p)
    return tiles(spark, d).select("vec_id", F.posexplode(gated).alias("pos", "p")).select("vec_id", (F.col("pos") + 1).cast("int").alias("class"), r6(F.col("p"), "p"))


FINAL_GATE = f"""WITH a AS (
  SELECT vec_id, list_transform(embedding[1:6], lambda x: abs(CAST(x AS DOUBLE))) AS e, CAST(embedding[7] AS DOUBLE) + 0.1 AS b, CAST(embedding[8] AS DOUBLE) + 0.1 AS c
  FROM embeddings WHERE embedding IS NOT NULL
), n AS (
  SELECT vec_id, b, c, list_transform(e, lambda x: x / (list_sum(e) + 1.1920928955078125e-07)) AS p FROM a
), g AS (
  SELECT *, CASE WHEN b > 0.05 AND p[1] + p[2] > 0.05 THEN 1.0 ELSE 0.0 END AS k1 FROM n
), h AS (
  SELECT *, CASE WHEN c > 0.05 AND p[1] * k1 + p[2] * k1 + p[3] > 0.05 THEN 1.0 ELSE 0.0 END AS k2 FROM g
), o AS (
  SELECT vec_id, [p[1] * k1, p[2] * k1, p[3] * k2, p[4], p[5], p[6]] AS q FROM h
)
SELECT vec_id, CAST(n AS INTEGER) AS class, {q6("q[n] / (list_sum(q) + 2.220446049250313e-16)", "p")} FROM o, range(1, 7) AS t(n)"""


def slice_rotated(spark, d):
    return vol.rotate_slice(vol.slice_cells(tiles(spark, d), 2, DIM, ["vec_id"]), 2, 4).select("vec_id", "row", "col", r6(F.col("v"), "v"))


def overlay(spark, d):
    shown = vol.overlay(num.window_level(F.col("v"), -0.5, 0.5), [(F.col("v") > 0, (1.0, 0.0, 0.0)), (F.col("i") > 2, (0.0, 0.0, 1.0))], 0.4)
    rgb = vol.slice_cells(tiles(spark, d), 2, DIM, ["vec_id"]).select("vec_id", "i", "j", shown.alias("c"))
    return rgb.select("vec_id", "i", "j", *(r6(F.col("c")[n], x) for n, x in enumerate(("red", "green", "blue"))))


def value_range(spark, d):
    return vol.value_range(tiles(spark, d), ["vec_id"]).select("vec_id", r6(F.col("v_min"), "v_min"), r6(F.col("v_max"), "v_max"))


def normal_pdf(spark, d):
    return cells(spark, d).select("vec_id", "i", "j", "k", r6(num.normal_pdf(F.col("v"), 0.05, 0.2), "density"))


def prior_table(spark, d):
    """Means and deviations of intensity priors held in slots 1 to 3."""
    m, n, w = (F.element_at("data", c) for c in (1, 2, 3))
    return tiles(spark, d).select("vec_id", r6(num.prior_mean_hu(m * 2000 + 1024), "mean_hu"), r6(num.prior_sd(F.abs(n) + 1, F.abs(w) + 0.01), "sd_hu"))


def voxel_size_det(spark, d):
    """Column norms and determinant of an affine held in columns."""
    m = [[F.element_at("data", 3 * r + c + 1) for c in range(3)] for r in range(3)]
    det = m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    norm = [F.sqrt(m[0][c] * m[0][c] + m[1][c] * m[1][c] + m[2][c] * m[2][c]) for c in range(3)]
    return tiles(spark, d).select("vec_id", r6(F.when(det < 0, -norm[0]).otherwise(norm[0]), "vx"), r6(norm[1], "vy"), r6(norm[2], "vz"), r6(det, "det"))


def _m(r, c):
    return f"CAST(embedding[{3 * r + c + 1}] AS DOUBLE)"


DET = f"({_m(0, 0)} * ({_m(1, 1)} * {_m(2, 2)} - {_m(1, 2)} * {_m(2, 1)}) - {_m(0, 1)} * ({_m(1, 0)} * {_m(2, 2)} - {_m(1, 2)} * {_m(2, 0)}) + {_m(0, 2)} * ({_m(1, 0)} * {_m(2, 1)} - {_m(1, 1)} * {_m(2, 0)}))"
NORM = [f"sqrt({_m(0, c)} * {_m(0, c)} + {_m(1, c)} * {_m(1, c)} + {_m(2, c)} * {_m(2, c)})" for c in range(3)]
ABS6 = "SELECT vec_id, list_transform(embedding[1:6], lambda x: abs(CAST(x AS DOUBLE))) AS e, CAST(embedding[9] AS DOUBLE) AS v9 FROM embeddings WHERE embedding IS NOT NULL"
EPS = "1.1920928955078125e-07"

QUERIES = {
    "dice": (dice, DICE),
    "dice_cells": (dice_cells, DICE),
    "mask_range": (mask_range, f"WITH {VOX} SELECT vec_id, count(*) FILTER (v > -0.1 AND v < 0.1) AS n_inside, count(*) FILTER (v > 0.05) AS n_above FROM vox GROUP BY vec_id"),
    "mask_assign": (mask_assign, f"WITH {VOX} SELECT vec_id, i, j, k, {q6('CASE WHEN v > 0.05 THEN v ELSE -1 END', 'v')} FROM vox"),
    "clamp_window": (clamp_window, f"WITH {VOX} SELECT vec_id, i, j, k, {q6('least(CAST(0.1 AS DOUBLE), greatest(CAST(-0.1 AS DOUBLE), v))', 'clamped')}, {q6('least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), (v + 0.05) / CAST(0.15 AS DOUBLE)))', 'shown')} FROM vox"),
    "finite_or_zero": (finite_or_zero, f"WITH {VOX} SELECT vec_id, i, j, k, {q6('CASE WHEN i = 2 OR j = 3 THEN 0 ELSE v END', 'v')} FROM vox"),
    "channel_duplicate": (channel_duplicate, f"WITH {ATLAS} SELECT vec_id, voxel, CAST(n AS INTEGER) AS channel, {q6('l[([1, 1, 2, 2, 3, 4])[n]]', 'v')} FROM atlas, range(1, 7) AS t(n)"),
    "index_remap": (index_remap, "SELECT vec_id, CAST(n AS INTEGER) AS n, CAST(CASE WHEN n <= 4 THEN n ELSE n + 2 END AS INTEGER) AS g FROM embeddings, range(1, 8) AS t(n) WHERE embedding IS NOT NULL"),
    "linear_index": (linear_index, f"WITH {VOX} SELECT vec_id, i, j, k, CAST((i - 1) + 4 * ((j - 1) + 4 * (k - 1)) AS INTEGER) AS at FROM vox"),
    "tile_round_trip": (tile_round_trip, f"SELECT vec_id, {q6('CAST(embedding[7] AS DOUBLE)', 'v7')}, CAST(64 AS INTEGER) AS n FROM embeddings WHERE embedding IS NOT NULL"),
    "softmax_background": (softmax_background, f"WITH {SOFT} SELECT vec_id, voxel, CAST(n AS INTEGER) AS class, {q6('p[n]', 'p')} FROM soft, range(1, 6) AS t(n)"),
    "softmax_plain": (softmax_plain, f"WITH {ATLAS}, e AS (SELECT vec_id, voxel, list_transform(l, lambda x: exp(x)) || [CAST(1 AS DOUBLE)] AS e FROM atlas) SELECT vec_id, voxel, CAST(n AS INTEGER) AS class, {q6('e[n] / list_sum(e)', 'p')} FROM e, range(1, 6) AS t(n)"),
    "implicit_background": (implicit_background, f"WITH {ATLAS} SELECT vec_id, voxel, {q6('greatest(CAST(1 AS DOUBLE) - list_sum(list_transform(l, lambda x: abs(x) * 2)), CAST(0 AS DOUBLE))', 'bg')} FROM atlas"),
    "renormalise": (renormalise, f"WITH a AS ({ABS6}) SELECT vec_id, CAST(n AS INTEGER) AS class, {q6(f'e[n] / (list_sum(e) + {EPS})', 'p')} FROM a, range(1, 7) AS t(n)"),
    "skull_strip": (skull_strip, f"WITH a AS ({ABS6}) SELECT vec_id, {q6(f'CASE WHEN e[1] / (list_sum(e) + {EPS}) + e[2] / (list_sum(e) + {EPS}) + e[3] / (list_sum(e) + {EPS}) >= 0.5 THEN v9 ELSE 0 END', 'v')} FROM a"),
    "icv_mask": (icv_mask, f"WITH {SOFT} SELECT vec_id, voxel, CAST(p[1] + p[2] + p[3] > 0.5 AS INTEGER) AS inside FROM soft"),
    "hemisphere_split": (
        hemisphere_split,
        f"""WITH {VOX}, lo AS (SELECT min(CAST(embedding[n] AS DOUBLE)) AS lowest FROM embeddings, range(1, 6) AS t(n) WHERE embedding IS NOT NULL)
SELECT vec_id, i, j, k, CAST(c AS INTEGER) AS channel,
       {q6("CASE WHEN (c IN (1, 3) AND i <= 2) OR (c IN (2, 4) AND i >= 2) THEN lowest WHEN c <= 2 THEN v ELSE CAST(embedding[([1, 1, 2, 2, 3, 4, 5])[c]] AS DOUBLE) END", "x")}
FROM vox JOIN embeddings USING (vec_id), lo, range(1, 8) AS b(c)""",
    ),
    "volumes_tbv_tiv": (
        volumes_tbv_tiv,
        f"WITH {VOX} SELECT vec_id // 4 AS subject, {q6('coalesce(sum(abs(v) * 1.5 / 1000) FILTER (vec_id % 4 IN (0, 1)), 0)', 'tbv_ml')}, {q6('coalesce(sum(abs(v) * 1.5 / 1000) FILTER (vec_id % 4 IN (0, 1, 2)), 0)', 'tiv_ml')} FROM vox GROUP BY 1",
    ),
    "masked_volumes": (
        masked_volumes,
        f"WITH {VOX} SELECT vec_id // 2 AS subject, {q6('coalesce(sum(CASE WHEN v > 0 THEN v * 3 / 1000 ELSE 0 END) FILTER (vec_id % 2 = 0), 0)', 'tbv_ml')}, {q6('coalesce(sum(CASE WHEN v > 0 THEN v * 3 / 1000 ELSE 0 END), 0)', 'tiv_ml')} FROM vox GROUP BY 1",
    ),
    "cov_map": (cov_map, f"WITH {COV} SELECT label, i, j, k, n, {q6('mean', 'mean')}, {q6('var', 'var')}, {q6('cov', 'cov')} FROM cov"),
    "cov_map_cells": (cov_map_cells, f"WITH {COV} SELECT label, i, j, k, n, {q6('mean', 'mean')}, {q6('var', 'var')}, {q6('cov', 'cov')} FROM cov"),
    "brain_cov": (brain_cov, f"WITH {COV} SELECT label, count(cov) AS n_voxels, {q6('avg(cov)', 'mean_cov')} FROM cov WHERE mean > 0.04 AND mean < 0.06 GROUP BY label"),
    "quantise_uint8": (quantise("uint8"), quantise_sql("hi / 255.0", 0, 255)),
    "quantise_int16": (quantise("int16"), quantise_sql("greatest(hi / 32767.0, -lo / 32768.0)", -32768, 32767)),
    "dequantise": (dequantise, "SELECT vec_id, true AS close FROM embeddings WHERE embedding IS NOT NULL"),
    "class_sum": (class_sum, f"SELECT vec_id, {q6('CAST(embedding[1] AS DOUBLE) + CAST(embedding[3] AS DOUBLE) + CAST(embedding[4] AS DOUBLE)', 'total')} FROM embeddings WHERE embedding IS NOT NULL"),
    "final_gate": (final_gate, FINAL_GATE),
    "slice_rotated": (slice_rotated, f"WITH {VOX} SELECT vec_id, j AS row, CAST(4 - i + 1 AS INTEGER) AS col, {q6('v', 'v')} FROM vox WHERE k = 2"),
    "overlay": (
        overlay,
        f"""WITH {VOX}, g AS (SELECT *, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), v + 0.5)) AS s FROM vox WHERE k = 2),
a AS (SELECT *, CASE WHEN v > 0 THEN 0.6 * s + 0.4 ELSE s END AS r1, CASE WHEN v > 0 THEN 0.6 * s ELSE s END AS g1 FROM g)
SELECT vec_id, i, j, {q6("CASE WHEN i > 2 THEN 0.6 * r1 ELSE r1 END", "red")}, {q6("CASE WHEN i > 2 THEN 0.6 * g1 ELSE g1 END", "green")}, {q6("CASE WHEN i > 2 THEN 0.6 * g1 + 0.4 ELSE g1 END", "blue")} FROM a""",
    ),
    "value_range": (value_range, f"WITH {VOX} SELECT vec_id, {q6('min(v)', 'v_min')}, {q6('max(v)', 'v_max')} FROM vox GROUP BY vec_id"),
    "normal_pdf": (normal_pdf, f"WITH {VOX} SELECT vec_id, i, j, k, {q6('exp(-((v - 0.05) / CAST(0.2 AS DOUBLE)) * ((v - 0.05) / CAST(0.2 AS DOUBLE)) / 2) / (0.2 * sqrt(2 * pi()))', 'density')} FROM vox"),
    "prior_table": (prior_table, f"SELECT vec_id, {q6('CAST(embedding[1] AS DOUBLE) * 2000 + 1024 - 1024', 'mean_hu')}, {q6('sqrt(abs(1 / ((abs(CAST(embedding[2] AS DOUBLE)) + 1) * (abs(CAST(embedding[3] AS DOUBLE)) + 0.01))))', 'sd_hu')} FROM embeddings WHERE embedding IS NOT NULL"),
    "voxel_size_det": (voxel_size_det, f"SELECT vec_id, {q6(f'CASE WHEN {DET} < 0 THEN -{NORM[0]} ELSE {NORM[0]} END', 'vx')}, {q6(NORM[1], 'vy')}, {q6(NORM[2], 'vz')}, {q6(DET, 'det')} FROM embeddings WHERE embedding IS NOT NULL"),
}
