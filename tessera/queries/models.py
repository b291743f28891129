"""Operators that need iteration or numerical libraries; SQL where there is an equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import numeric as num
from tessera.operators import bricks, cleanup, models, registration
from tessera.plans.runtime import table
from tessera.queries.common import DIM, VOX, cells, r6, tiles
from tessera.queries.geometry import MM


def clean_gwc(spark, d):
    """Four volumes after another as four classes of one stack."""
    t = tiles(spark, d).select(F.expr("vec_id div 4").alias("stack"), (F.col("vec_id") % 4).alias("c"), F.transform("data", lambda x: F.abs(x) * 3).alias("data"))
    whole = t.groupBy("stack").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c", "data"))), lambda s: s["data"])).alias("p"), F.count("*").alias("n")).where("n = 4")
    out = cleanup.clean(whole.select("stack", "p"), DIM, 4)
    return out.select("stack", F.posexplode("p").alias("at", "p")).select("stack", "at", r6(F.col("p"), "p"))


def bricks_clean(spark, d):
    """The same clean-up with each volume in four bricks."""
    t = tiles(spark, d).select(F.expr("vec_id div 4").alias("stack"), (F.col("vec_id") % 4).alias("c"), F.transform("data", lambda x: F.abs(x) * 3).alias("data"))
    names = ("gm", "wm", "csf", "rest")
    whole = t.groupBy("stack").agg(F.count("*").alias("n"), *(F.max_by("data", F.when(F.col("c") == n, 1)).alias(x) for n, x in enumerate(names))).where("n = 4")
    out = bricks.clean(bricks.cut(whole, ["stack"], names, DIM, (2, 4, 2)), ["stack"], others=["rest"])
    rows = bricks.whole(out, ["stack"], names).select("stack", F.posexplode(F.concat(*names)).alias("at", "p"))
    return rows.select("stack", "at", r6(F.col("p"), "p"))


def failing_hook(spark, d):
    """A hook that fails on some volumes: their errors are rows, the rest goes on."""

    def hook(p):
        if p[0, 0, 0, 0] < 0:
            raise ValueError("negative corner")
        return p * 2

    t = tiles(spark, d).select("vec_id", F.col("data").alias("p"))
    return cleanup.map_volumes(t, hook, DIM, 1).select("vec_id", F.col("p").isNotNull().alias("done"), F.coalesce("error", F.lit("")).alias("error"))


def gmm_em(spark, d):
    start = [(0.5, -0.1, 0.02), (0.5, 0.1, 0.02)]
    model, fit = models.fit_mixture(cells(spark, d).select("v"), start, rounds=5, tolerance=0.0)
    return spark.createDataFrame([(n + 1, *m) for n, m in enumerate(model)], "g int, weight double, mean double, variance double").select("g", *(r6(F.col(c), c) for c in ("weight", "mean", "variance")))


def gmm_responsibilities(spark, d):
    p = models.responsibilities(F.col("v"), [(0.4, -0.1, 0.02), (0.6, 0.1, 0.01)])
    return cells(spark, d).select("vec_id", "i", "j", "k", r6(p[0], "p1"), r6(p[1], "p2"))


def folds(spark, d):
    return models.with_folds(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 10, ["label"]).select("vec_id", "label", "fold")


def _prediction(machine):
    def run(spark, d):
        e = table(spark, d, "embeddings").where("embedding IS NOT NULL")
        y = F.col("embedding")[0].cast("double") + F.col("label") if machine != "gpc" else (F.col("embedding")[0] > 0).cast("double")
        rows = models.with_folds(e.select("vec_id", "label", num.channels(F.col("embedding"), range(1, 65)).alias("x"), y.alias("y")), "vec_id", 5, ["label"])
        return models.cross_validated(rows, ["label"], "vec_id", "x", "y", 5, machine).select("label", "vec_id", "fold", r6(F.col("y_true"), "y_true"), F.col("y_pred").isNotNull().alias("predicted"), r6(F.col("y_pred"), "y_pred"))

    run.__name__ = f"{machine}_cv"
    return run


def register_self(spark, d):
    """A volume aligned to itself stays where its header has it."""
    t = tiles(spark, d).select("vec_id", F.col("data").alias("fixed"), F.col("data").alias("moving"))
    out = registration.register(t, "fixed", "moving", DIM, MM, strides=(1,))
    rows = out.select("vec_id", F.col("score")[0].alias("score"), F.posexplode("matrix").alias("at", "x"))
    return rows.select("vec_id", "at", r6(F.col("x"), "x"), r6(F.col("score"), "score"))


def deform_self(spark, d):
    """Demons find no force between a volume and itself."""
    t = tiles(spark, d).select("vec_id", F.col("data").alias("fixed"), F.col("data").alias("moving"))
    out = registration.deform(t, "fixed", "moving", DIM, rounds=3)
    rows = out.select("vec_id", F.posexplode(F.arrays_zip("x", "y", "z")).alias("at", "p"))
    return rows.select("vec_id", "at", *(r6(F.col(f"p.{c}"), c) for c in "xyz"))


def segment_classes(spark, d):
    """The first round's classes of a volume, with the next volume's voxels as their prior."""
    t = tiles(spark, d).select("vec_id", "data")
    near = F.transform("_s", lambda x: 0.5 + F.greatest(F.lit(-0.4), F.least(F.lit(0.4), x)))
    met = t.join(t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("data").alias("_s")), "vec_id").select("vec_id", "data", near.alias("_p"))
    out = registration.segment(met.select("vec_id", "data", F.concat("_p", F.transform("_p", lambda p: 1 - p)).alias("prior")), "data", "prior", DIM, gaussians=(1, 1), degree=0, rounds=1)
    return out.select("vec_id", F.posexplode("classes").alias("at", "p")).select("vec_id", "at", r6(F.col("p"), "p"))


SEGMENT = f"""WITH {VOX}, met AS (
  SELECT a.vec_id, a.i + 4 * (a.j - 1) + 16 * (a.k - 1) - 1 AS n, a.v, 0.5 + greatest(CAST(-0.4 AS DOUBLE), least(CAST(0.4 AS DOUBLE), b.v)) AS p1
  FROM vox a JOIN vox b ON b.vec_id = a.vec_id + 1 AND a.i = b.i AND a.j = b.j AND a.k = b.k
), c AS (SELECT vec_id, n, v, t.c, CASE t.c WHEN 0 THEN p1 ELSE 1 - p1 END AS p FROM met, (VALUES (0), (1)) t(c)),
m AS (SELECT vec_id, c, sum(p * v) / sum(p) AS mean, sum(p) AS total FROM c GROUP BY ALL),
s AS (SELECT c.vec_id, c.c, any_value(mean) AS mean, greatest(sum(p * (v - mean) * (v - mean)) / any_value(total), 1e-3 * var_pop(v)) AS s FROM c JOIN m USING (vec_id, c) GROUP BY ALL),
d AS (SELECT vec_id, n, c, p * exp(-(v - mean) * (v - mean) / s / 2) / sqrt(s) AS d FROM c JOIN s USING (vec_id, c))
SELECT vec_id, CAST(64 * c + n AS INTEGER) AS at, (round(d / sum(d) OVER (PARTITION BY vec_id, n), 6) + 0.0) AS p FROM d"""


PDF = "{w} * exp(-((v - ({m})) / sqrt({s})) * ((v - ({m})) / sqrt({s})) / 2) / (sqrt({s}) * sqrt(2 * pi()))"
_A, _B = PDF.format(w="0.4", m="-0.1", s="CAST(0.02 AS DOUBLE)"), PDF.format(w="0.6", m="0.1", s="CAST(0.01 AS DOUBLE)")



def _smooth_sql(source):
    """Three taps along each axis of a list of 64 voxels, 0 beyond."""
    x = source
    for n, step in enumerate((1, 4, 16)):
        place = f"(((g - 1) // {step}) % 4)"
        near = lambda ok, at: f"CASE WHEN {ok} THEN x{n}[{at}] ELSE 0 END"  # noqa: B023, E731
        x = f"SELECT * EXCLUDE (x{n}), list_transform(range(1, 65), lambda g: CAST(0.3 AS DOUBLE) * {near(f'{place} > 0', f'g - {step}')} + CAST(0.4 AS DOUBLE) * x{n}[g] + CAST(0.3 AS DOUBLE) * {near(f'{place} < 3', f'g + {step}')}) AS x{n + 1} FROM ({x})"
    return x


_ROUND = "SELECT stack, k, gw, gwc, list_transform(range(1, 65), lambda g: CASE WHEN b[g] > CASE WHEN k < 2 THEN 0.6 ELSE 0.2 END THEN CASE WHEN k < 32 THEN gw[g] ELSE gwc[g] END ELSE CAST(0 AS DOUBLE) END) AS x0 FROM grow WHERE k < 64"
_CLASS = lambda c: f"first(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) * 3)) FILTER (vec_id % 4 = {c}) AS p{c}"
CLEAN = f"""WITH RECURSIVE s AS (SELECT vec_id // 4 AS stack, {", ".join(map(_CLASS, range(4)))} FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1 HAVING count(*) = 4),
grow AS (
  SELECT stack, 0 AS k, list_transform(range(1, 65), lambda g: p1[g] + p0[g]) AS gw, list_transform(range(1, 65), lambda g: p1[g] + p0[g] + p2[g]) AS gwc, p1 AS b FROM s
  UNION ALL SELECT stack, k + 1, gw, gwc, x3 FROM ({_smooth_sql(_ROUND)})
), o AS (
  SELECT s.stack, g, p0[g] AS p0, p1[g] AS p1, p2[g] AS p2, p3[g] AS p3, CASE WHEN brain.b[g] > 0.05 AND p0[g] + p1[g] > 0.05 THEN 1 ELSE 0 END AS k1, head.b[g] AS h
  FROM s JOIN grow brain ON brain.stack = s.stack AND brain.k = 32 JOIN grow head ON head.stack = s.stack AND head.k = 64, range(1, 65) AS t(g)
), n AS (
  SELECT stack, g, [p0 * k1, p1 * k1, CASE WHEN h > 0.05 AND p0 * k1 + p1 * k1 + p2 > 0.05 THEN p2 ELSE 0 END, p3] AS q FROM o
)
SELECT stack, CAST(64 * (c - 1) + g - 1 AS INTEGER) AS at, (round(q[c] / (list_sum(q) + 2.220446049250313e-16), 6) + 0.0) AS p FROM n, range(1, 5) AS t(c)"""


def _em_sql(start, rounds):
    """Rounds of expectation maximisation, one after another."""
    out = [f"{VOX}, m0 AS (SELECT " + ", ".join(f"CAST({x} AS DOUBLE) AS {n}{g}" for g, row in enumerate(start) for n, x in zip("wms", row, strict=True)) + ")"]
    for k in range(rounds):
        dens = [f"w{g} * exp(-(v - m{g}) * (v - m{g}) / s{g} / 2) / sqrt(2 * pi() * s{g})" for g in range(len(start))]
        parts = ", ".join(f"d{g} / ({' + '.join(f'd{h}' for h in range(len(start)))} + 1e-300) AS p{g}" for g in range(len(start)))
        sums = ", ".join(f"avg(p{g}) AS w{g}, sum(p{g} * v) / sum(p{g}) AS m{g}, greatest(sum(p{g} * v * v) / sum(p{g}) - pow(sum(p{g} * v) / sum(p{g}), 2), 1e-6) AS s{g}" for g in range(len(start)))
        out.append(f"m{k + 1} AS MATERIALIZED (SELECT {sums} FROM (SELECT v, {parts} FROM (SELECT v, {', '.join(f'{x} AS d{g}' for g, x in enumerate(dens))} FROM vox, m{k} WHERE v IS NOT NULL)))")
    rows = " UNION ALL ".join(f"SELECT CAST({g + 1} AS INTEGER) AS g, (round(w{g}, 6) + 0.0) AS weight, (round(m{g}, 6) + 0.0) AS mean, (round(s{g}, 6) + 0.0) AS variance FROM m{rounds}" for g in range(len(start)))
    return f"WITH {', '.join(out)} {rows}"


QUERIES = {
    "clean_gwc": (clean_gwc, CLEAN),
    "bricks_clean": (bricks_clean, CLEAN),
    "failing_hook": (failing_hook, "SELECT vec_id, embedding[1] >= 0 AS done, CASE WHEN embedding[1] < 0 THEN 'ValueError: negative corner' ELSE '' END AS error FROM embeddings WHERE embedding IS NOT NULL"),
    "gmm_em": (gmm_em, _em_sql([(0.5, -0.1, 0.02), (0.5, 0.1, 0.02)], 5)),
    "gmm_responsibilities": (
        gmm_responsibilities,
        f"WITH {VOX}, p AS (SELECT vec_id, i, j, k, {_A} AS a, {_B} AS b FROM vox) SELECT vec_id, i, j, k, (round(a / (a + b), 6) + 0.0) AS p1, (round(b / (a + b), 6) + 0.0) AS p2 FROM p",
    ),
    "register_self": (register_self, "SELECT vec_id, CAST(n AS INTEGER) AS at, CAST(CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS x, CAST(2 AS DOUBLE) AS score FROM embeddings, range(16) AS t(n) WHERE embedding IS NOT NULL"),
    "deform_self": (deform_self, f"WITH {VOX} SELECT vec_id, CAST(i + 4 * (j - 1) + 16 * (k - 1) - 1 AS INTEGER) AS at, CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y, CAST(k AS DOUBLE) AS z FROM vox"),
    "segment_classes": (segment_classes, SEGMENT),
    "folds": (folds, "SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1) % 10 + 1 AS INTEGER) AS fold FROM embeddings"),
    "krr_cv": (_prediction("krr"), None),
    "gp_cv": (_prediction("gp"), None),
    "gpc_cv": (_prediction("gpc"), None),
    "rvr_cv": (_prediction("rvr"), None),
}
