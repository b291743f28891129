"""Stated semantics and published figures, on hand-made volumes and measurements."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import distributions as dist
from tessera.functions import numeric as num
from tessera.operators import cleanup, cohort, geometry, metrics, models, statistics
from tessera.operators import volumes as vol


def one(df):
    return df.first()[0]


def ball(n, centre, radius):
    g = np.indices((n, n, n)).transpose(1, 2, 3, 0) + 1
    return {tuple(map(int, x)) for x in g.reshape(-1, 3) if ((x - centre) ** 2).sum() <= radius**2}


def mask(spark, cells, key=1):
    return spark.createDataFrame([(key, *c) for c in sorted(cells)] or [], "s int, i int, j int, k int")


def test_dice_of_empty_masks(spark):
    df = spark.createDataFrame([(1, [0.0] * 8, [0.0] * 8), (2, [1.0] * 8, [0.0] * 8), (3, [1.0, None] * 4, [1.0] * 8)], "s int, a array<double>, b array<double>")
    got = {r.s: r.dice for r in metrics.dice_tiles(df, ["s"], "a", "b").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: pytest.approx(2 / 3)}


def test_distances_equal_brute_force(spark):
    a, b = ball(9, (4, 4, 4), 3), ball(9, (6, 5, 5), 2.5)
    size = (1.0, 1.0, 3.0)

    def surface(m):
        return [c for c in m if any(tuple(np.add(c, o)) not in m for o in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))]

    def near(p, m):
        return min(math.sqrt(sum(((x - y) * s) ** 2 for x, y, s in zip(p, q, size, strict=True))) for q in m)

    ab, ba = [near(p, b) for p in surface(a)], [near(p, a) for p in surface(b)]
    both = sorted(ab + ba)
    h = min(max(0.95 * len(both) + 0.5, 1), len(both))
    lo = math.floor(h)
    hd = both[lo - 1] + (h - lo) * (both[min(lo, len(both) - 1)] - both[lo - 1])
    row = geometry.surface_distances(mask(spark, a), mask(spark, b), ["s"], size).first()
    assert row.hd95 == pytest.approx(hd) and row.assd == pytest.approx((np.mean(ab) + np.mean(ba)) / 2)
    dense = [np.array([[[(i, j, k) in m for k in range(1, 10)] for j in range(1, 10)] for i in range(1, 10)]) for m in (a, b)]
    assert metrics.distances_of(*dense, size) == pytest.approx((row.hd95, row.assd))
    assert metrics.distances_of(dense[0], dense[0] & False, size) is None


def test_inner_mask_has_distance_zero_to_the_filled_outer(spark):
    inner, outer = ball(9, (5, 5, 5), 1), ball(9, (5, 5, 5), 3)
    d = geometry.nearest_distance(geometry.perimeter(mask(spark, inner), ["s"]), mask(spark, outer), ["s"], (1, 1, 1))
    assert {r.distance for r in d.collect()} == {0.0}


def test_far_targets_and_keys_without_target(spark):
    points = spark.createDataFrame([(1, 1, 1, 1), (2, 1, 1, 1)], "s int, i int, j int, k int")
    targets = spark.createDataFrame([(1, 40, 1, 1), (1, 1, 90, 1)], "s int, i int, j int, k int")
    got = {r.s: r.distance for r in geometry.nearest_distance(points, targets, ["s"], (2.0, 1.0, 1.0)).collect()}
    assert got == {1: 78.0, 2: None}


def test_percentiles_interpolate_at_half(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (3, 1, 2, 4)] + [(2, 7.0), (3, None), (4, 1.0), (4, 1.0), (4, 5.0)], "g int, x double")
    got = {r.g: (r.a, r.b, r.c) for r in statistics.hazen(df, ["g"], "x", (0.25, 0.75, 0.99), ("a", "b", "c")).collect()}
    assert got == {1: (1.5, 3.5, 4.0), 2: (7.0, 7.0, 7.0), 4: (1.0, 4.0, 5.0)}


def test_nan_never_passes_a_comparison(spark):
    df = spark.createDataFrame([(1, [float("nan"), 0.6, 0.4])], "s int, data array<double>")
    df = df.withColumn("data", vol.doubles(F.col("data")))
    assert one(df.select(vol.count_where(F.col("data"), lambda x: x > 0.5))) == 1
    assert one(df.select(F.array_max("data"))) == 0.6


def test_field_of_view_is_half_open(spark):
    cells = spark.createDataFrame([(i, 1, 1, 5.0) for i in range(1, 6)], "i int, j int, k int, v double")
    out = geometry.mask_outside_view(cells, np.eye(4), (4, 2, 2), np.eye(4), -1.0)
    assert [r.v for r in out.orderBy("i").collect()] == [5.0, 5.0, 5.0, -1.0, -1.0]


def test_softmax_is_finite_for_large_logs(spark):
    df = spark.createDataFrame([([100.0, -100.0, 0.0],)], "p array<double>")
    p = one(df.select(num.softmax_background(F.col("p"))))
    assert len(p) == 4 and sum(p) == pytest.approx(1) and all(map(math.isfinite, p))


@pytest.mark.parametrize("nx,blank", [(4, {0: {1, 2}, 1: {2, 3, 4}}), (5, {0: {1, 2}, 1: {3, 4, 5}})])
def test_hemisphere_split(spark, nx, blank):
    df = spark.range(1, nx + 1).select(F.col("id").cast("int").alias("i"), F.array(*(F.lit(float(c)) for c in range(1, 6))).alias("p"))
    got = df.select("i", num.hemisphere_split(F.col("p"), F.col("i"), F.lit(nx), F.lit(-9.0)).alias("q")).collect()
    for channel, planes in blank.items():
        assert {r.i for r in got if r.q[channel] == -9.0} == planes


def test_quantisation(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, None, float("inf")],), ([-4.0, 2.0, 1.0, 0.0, 0.5],), ([0.0] * 5,)], "d array<double>")
    for kind, low, high in (("uint8", 0, 255), ("int16", -32768, 32767)):
        whole, slope = vol.quantise(F.col("d"), kind)
        rows = df.select(whole.alias("q"), slope.alias("s")).collect()
        assert all(low <= q <= high for r in rows for q in r.q)
        assert rows[2].q == [0] * 5 and rows[2].s == 0 and rows[0].q[3:] == [0, 0]
    assert df.select(vol.quantise(F.col("d"), "int16")[0].alias("q")).collect()[1].q[0] == -32768


def test_resampling_by_identity_is_identity_and_pull_equals_numpy(spark):
    r = np.random.default_rng(1)
    image = r.normal(size=(4, 5, 3))
    cells = spark.createDataFrame([(1, i + 1, j + 1, k + 1, float(image[i, j, k])) for i, j, k in np.ndindex(image.shape)], "s int, i int, j int, k int, v double")
    for order in (0, 1):
        same = geometry.pull(cells.select("s", "i", "j", "k", *(F.col(a).cast("double").alias(x) for a, x in zip("ijk", "xyz", strict=True))), cells, ["s"], order)
        assert same.exceptAll(cells.select(same.columns)).count() == 0
    at = (2.25, 3.5, 1.75)
    want = sum(image[1 + a, 2 + b, 0 + c] * (0.25 if a else 0.75) * 0.5 * (0.75 if c else 0.25) for a in (0, 1) for b in (0, 1) for c in (0, 1))
    points = spark.createDataFrame([(1, *at), (1, 99.0, 1.0, 1.0)], "s int, x double, y double, z double").withColumn("n", F.monotonically_increasing_id())
    got = sorted(r.v for r in geometry.pull(points, cells, ["s"], 1).collect())
    assert got == [pytest.approx(x) for x in sorted([0.0, float(want)])]


def test_affines(spark):
    m = np.diag([-2.0, 3.0, 4.0, 1.0])
    new, change = geometry.reset_origin(m, (11, 21, 31))
    assert np.allclose(new @ [6, 11, 16, 1], [0, 0, 0, 1]) and new[0, 0] == -2 and np.allclose(change @ m, new)
    again, dim = geometry.resized(np.diag([1.0, 1.0, 3.0, 1.0]), (10, 10, 5), (1, 0, 1.5))
    assert dim == [10, 10, 10] and np.allclose(geometry.voxel_size(again), (1, 1, 1.5))
    assert np.allclose(geometry.translated(np.eye(4), (1, 2, 3))[:3, 3], (1, 2, 3))


def test_tiles_and_cells_are_one_volume(spark):
    df = spark.createDataFrame([(1, [float(x) for x in range(24)])], "s int, data array<double>")
    cells = vol.to_cells(df, (2, 3, 4), ["s"])
    assert cells.where("i = 2 AND j = 3 AND k = 4").first().v == 23.0
    assert vol.to_tiles(cells, (2, 3, 4), ["s"]).first().data == df.first().data


def test_clean_up_removes_islands_and_keeps_the_brain():
    p = np.zeros((24, 24, 24, 4))
    p[..., 3] = 1
    p[6:18, 6:18, 6:18] = [0.2, 0.8, 0, 0]
    p[5, 6:18, 6:18] = [0.9, 0, 0.1, 0]
    p[1:3, 1:3, 1:3] = [0.9, 0, 0.1, 0]
    out = cleanup.clean_tissue(p)
    assert set(np.round(out.sum(axis=-1), 9).ravel()) <= {0.0, 1.0} and out[12, 12, 12, 1] > 0.7
    assert out[1, 1, 1, 0] == 0 and out[5, 12, 12, 0] > 0.5
    assert np.allclose(cleanup.smooth(np.pad(np.ones((1, 1, 1)), 1)).sum(), 1)


def test_f_quantile_and_published_intervals(spark):
    assert dist.f_quantile(0.975, 58, 58) == pytest.approx(1.68170, abs=1e-5)
    for icc, low, high in ((0.829, 0.728, 0.895), (0.650, 0.474, 0.776), (0.798, 0.682, 0.875), (0.821, 0.716, 0.890)):
        q, f = dist.f_quantile(0.975, 58, 58), (1 + icc) / (1 - icc)
        assert (f / q - 1) / (f / q + 1) == pytest.approx(low, abs=1e-3)
        assert (f * q - 1) / (f * q + 1) == pytest.approx(high, abs=1e-3)
    r = np.random.default_rng(2)
    x = r.normal(size=30)
    y = x + r.normal(size=30)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "g int, x double, y double")
    data = np.stack([x, y], axis=1)
    rows, cols, total = data.mean(axis=1), data.mean(axis=0), data.mean()
    ssr, ssc = 2 * ((rows - total) ** 2).sum(), 30 * ((cols - total) ** 2).sum()
    mse = (((data - total) ** 2).sum() - ssr - ssc) / 29
    assert statistics.icc(df, ["g"], "x", "y").first().icc == pytest.approx((ssr / 29 - mse) / (ssr / 29 + mse))


def test_published_prediction_figures():
    for rmse, sd, bias in ((10.82, 10.90, -0.48), (10.30, 10.39, 0.04), (10.52, 10.62, 0.06)):
        assert math.sqrt(sd**2 * 57 / 58 + bias**2) == pytest.approx(rmse, abs=0.01)
    assert [round(100 * k / 58, 1) for k in (49, 50, 51)] == [84.5, 86.2, 87.9]


def test_signed_rank(spark):
    assert dist.signed_rank_p(0, 5) == pytest.approx(0.0625)
    assert dist.signed_rank_p(0, 0) is None
    same = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 2.0)], "g int, x double, y double")
    assert statistics.signed_rank_test(same, ["g"], "x", "y").count() == 0
    ways = sum(1 for m in range(1 << 8) if sum(r + 1 for r in range(8) if m >> r & 1) <= 6)
    assert dist.signed_rank_p(6, 8) == pytest.approx(2 * ways / 256)


def test_auc_of_negated_scores_ties_and_one_class(spark):
    rows = [(1, t, float(s)) for t, s in ((1, 3), (1, 2), (0, 2), (0, 1), (1, 1))] + [(2, 1, 1.0)]
    df = spark.createDataFrame(rows, "g int, t int, s double")
    up = {r.g: r.auc for r in statistics.auc_by_ranks(df, ["g"], "t", "s").collect()}
    down = {r.g: r.auc for r in statistics.auc_by_ranks(df.withColumn("s", -F.col("s")), ["g"], "t", "s").collect()}
    area = {r.g: r.auc for r in statistics.roc_area(df, ["g"], "t", "s").collect()}
    assert up[1] == pytest.approx(4 / 6) and up[1] + down[1] == pytest.approx(1) and area[1] == pytest.approx(up[1])
    assert up[2] is None and area[2] is None


def test_single_values_and_missing_pairs(spark):
    df = spark.createDataFrame([(1, 2.0, None), (1, 3.0, 4.0), (2, 5.0, 5.0)], "g int, x double, y double")
    got = {r.g: r.sd for r in statistics.summary(df, ["g"], "x").collect()}
    assert got == {1: pytest.approx(math.sqrt(0.5)), 2: 0.0}
    assert {r.g: (r.n, r.bias) for r in statistics.bland_altman(df, ["g"], "x", "y").collect()} == {1: (1, 1.0), 2: (1, 0.0)}


def test_first_match_and_fallback(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    other = spark.createDataFrame([("a", 9), ("b", 8)], "k string, v int")
    assert [(r.k, r.v) for r in cohort.first_match(rows, "k", ["v"]).collect()] == [("a", 1)]
    got = {r.k: (r.v, r.source) for r in cohort.fallback(cohort.first_match(rows, "k", ["v"]), other, "k", ["v"]).collect()}
    assert got == {"a": (1, 0), "b": (8, 1)}
    with pytest.raises(ValueError):
        cohort.only(rows.withColumnRenamed("k", "subject"), spark.createDataFrame([("z",)], "subject string"))


def test_configuration_grid_has_twelve_rows(spark):
    grid = cohort.configurations(spark, {"m": ["gp", "krr", "rvr"], "f": [4, 8, 12], "n": [50, 100]}, {"n": ("m", ["gp"])})
    assert grid.count() == 12


def test_mixture_and_ridge(spark):
    r = np.random.default_rng(4)
    values = np.concatenate([r.normal(0, 1, 3000), r.normal(8, 0.5, 1000)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    model, _ = models.fit_mixture(df, [(0.5, 1.0, 4.0), (0.5, 6.0, 4.0)])
    assert model[0][0] == pytest.approx(0.75, abs=0.02) and model[1][1] == pytest.approx(8, abs=0.1)
    x = r.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + 3
    k = (x - x[:50].mean(axis=0)) @ (x - x[:50].mean(axis=0)).T
    train = np.arange(60) < 50
    for name in ("krr", "gp", "rvr"):
        got = models.MACHINES[name](k, y, train)
        assert np.corrcoef(got[~train], y[~train])[0, 1] > 0.98, name
    label = (y > 3).astype(float)
    assert ((models.gaussian_process_classifier(k, label, train) > 0.5) == label)[~train].mean() > 0.8


@pytest.mark.parametrize("degree", [2, 3, 4, 5])
def test_spline_passes_through_the_voxels_and_keeps_lines(degree):
    r = np.random.default_rng(degree)
    image = r.normal(size=(6, 5, 4))
    at = np.array([[i + 1, j + 1, k + 1] for i, j, k in np.ndindex(image.shape)], float)
    assert geometry.spline_values(image, at, degree) == pytest.approx(image.ravel())
    flat = np.full((6, 5, 4), 2.5)
    some = np.array([[1.3, 2.7, 3.1], [5.5, 4.2, 1.9], [0.5, 1, 1], [6.1, 1, 1]])
    assert geometry.spline_values(flat, some, degree) == pytest.approx([2.5, 2.5, 0, 0])


def test_upright_grid_crop_and_slices(spark):
    new, dim = geometry.upright(np.array([[0, 2.0, 0, 0], [1.0, 0, 0, 0], [0, 0, 3.0, 0], [0, 0, 0, 1]]), (4, 5, 6))
    assert np.allclose(new @ [1, 1, 1, 1], [2, 1, 3, 1]) and np.allclose(np.diag(new)[:3], (1, 2, 3))
    assert geometry.relative_slice(60, 0.45) == 27 and geometry.relative_slice(3, 0.01) == 1
    assert geometry.slice_at(np.diag([2.0, 2.0, 2.0, 1.0]), (5.0, -3.0, 99.0), (10, 10, 10)) == [3, 1, 10]
    cells = spark.createDataFrame([(i, 1, 1, 1.0) for i in range(1, 5)], "i int, j int, k int, v double")
    assert geometry.crop(cells, np.eye(4), None).count() == 4
    with pytest.raises(ValueError):
        num.eight_classes(5)


def test_isotropic_distances_take_masks_of_resampled_values(spark, tmp_path):
    import duckdb

    from tessera.queries import geometry as q

    rng = np.random.default_rng(8)
    x = rng.normal(size=(4, 64))
    x[:, ::9] = 3e-7  # 0 as a value of six decimals
    spark.createDataFrame([(n, n, v.tolist()) for n, v in enumerate(x)], "vec_id long, label int, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(q.QUERIES["hd95_assd_isotropic"][1]).fetchall())
    got = sorted(tuple(r) for r in q.hd95_assd_isotropic(spark, str(tmp_path)).collect())
    np.testing.assert_allclose(got, want, atol=1e-6)


def test_signed_ranks_do_not_depend_on_files(spark, sf_dir, tmp_path):
    import duckdb
    import pyarrow.parquet as pq

    from tessera.queries import statistics as q

    lines = pq.read_table(f"{sf_dir}/lineitem.parquet")
    lines = lines.take(np.resize(np.arange(len(lines)), 8 * len(lines)))
    (tmp_path / "lineitem.parquet").mkdir()
    for n in range(7):
        size = len(lines) // 6
        pq.write_table(lines.slice(n * size, size), tmp_path / "lineitem.parquet" / f"part-{n}.parquet", row_group_size=size // 3)
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("wilcoxon_w", "wilcoxon_p"):
        query, sql = q.QUERIES[name]
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        want = sorted(cursor.fetchall())
        assert sorted(tuple(r[c] for c in names) for r in query(spark, str(tmp_path)).collect()) == want


def test_classes_are_counted_before_they_are_mapped(spark, sf_dir):
    from tessera.queries import cohort as q

    plan = q.class_map(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert "Aggregate" in plan[join:] and "strategy=broadcast" in plan[join:]


def test_splines_of_many_volumes_are_worked_on_at_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    images, points = rng.normal(size=(30, 4, 5, 3)), rng.uniform(0.5, 5.5, size=(30, 11, 3))
    got = geometry.spline_values_each(images, points, 4)
    for n in range(30):
        assert got[n] == pytest.approx(geometry.spline_values(images[n], points[n], 4))
    rows = [(n, images[n].ravel(order="F").tolist(), *(points[n, : 11 - n % 2, a].tolist() for a in range(3))) for n in range(30)]
    df = spark.createDataFrame(rows, "n int, data array<double>, x array<double>, y array<double>, z array<double>")
    for r in geometry.pull_spline(df.select("n", "x", "y", "z"), df.select("n", "data"), ["n"], (4, 5, 3)).collect():
        assert r.v == pytest.approx(got[r.n][: 11 - r.n % 2])
