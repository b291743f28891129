"""Running totals over ranges and selection by counted cells, against plain code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ordered, statistics


def plain_percentile(values, p):
    x = sorted(values)
    h = min(max(p * len(x) + 0.5, 1), len(x))
    low = int(np.floor(h))
    return x[low - 1] * (1 - (h - low)) + x[min(low, len(x) - 1)] * (h - low)


def groups_of(seed):
    r = np.random.default_rng(seed)
    return {
        "normal": r.normal(size=700),
        "ties": r.integers(0, 4, 500).astype(float),
        "same": np.full(300, 2.5),
        "wide": np.concatenate([10.0 ** r.uniform(-300, 300, 200), -(10.0 ** r.uniform(-300, 300, 200))]),
        "far apart": np.concatenate([r.normal(size=200), [1.7e308, -1.7e308]]),
        "close": 1.0 + np.arange(60) * 2.0**-52,
        "tiny": np.array([5e-324, 1e-323, 0.0, -5e-324] * 8),
        "one": np.array([4.0]),
        "two": np.array([1.0, 3.0]),
        None: r.normal(size=90),
    }


@pytest.mark.parametrize("whole,cells", [(1 << 20, 1024), (10, 256)])
def test_selection_equals_sorting(spark, whole, cells):
    data = groups_of(whole)
    rows = [(g, float(v)) for g, xs in data.items() for v in xs] + [("normal", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares, names = (0.0, 0.01, 0.25, 0.5, 0.5, 0.95, 1.0), [f"p{n}" for n in range(7)]
    got = {r.g: r for r in ordered.selected(df, ["g"], "v", shares, names, whole, cells).collect()}
    assert set(got) == set(data)
    for g, xs in data.items():
        np.testing.assert_allclose([got[g][n] for n in names], [plain_percentile(xs, p) for p in shares], rtol=1e-12)
    whole_table = ordered.selected(df.where("g = 'normal'"), [], "v", (0.5,), ("m",), whole, cells).collect()
    assert [r.m for r in whole_table] == [pytest.approx(plain_percentile(data["normal"], 0.5))]
    assert ordered.selected(df.limit(0), ["g"], "v", (0.5,), ("m",), whole, cells).collect() == []


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_plain_sums(spark, parts, descending):
    r = np.random.default_rng(parts)
    rows = [(g, float(s), int(r.integers(0, 5)), int(r.integers(0, 9))) for g, n in (("hot", 900), ("small", 3), (None, 40)) for s in r.choice(10_000, n, replace=False)]
    df = spark.createDataFrame(rows, "g string, s double, a long, b long").repartition(5)
    bounds = ordered.range_bounds(df, "s", parts)
    assert len(bounds) <= parts - 1
    got = {(x.g, x.s): (x.ca, x.cb) for x in ordered.running_totals(df, ["g"], "s", {"ca": "a", "cb": "b"}, bounds, descending).collect()}
    assert len(got) == len(rows)
    for g in ("hot", "small", None):
        a = b = 0
        for x in sorted((x for x in rows if x[0] == g), key=lambda x: x[1], reverse=descending):
            a, b = a + x[2], b + x[3]
            assert got[g, x[1]] == (a, b)


def test_a_hot_group_is_dealt_out(spark):
    """Ranges of one group of 50,000 scores hold about equally many, so tasks do."""
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_021 / 50_021.0).alias("s"))
    bounds = ordered.range_bounds(df, "s", 16)
    sizes = [r["count"] for r in df.groupBy(ordered.range_number(F.col("s"), bounds).alias("k")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 50_000 / 16


def test_range_numbers():
    assert str(ordered.range_number(F.lit(1.0), [])).count("CASE") == 0


def test_statistics_of_many_ties_and_missing_keys(spark):
    r = np.random.default_rng(5)
    rows = [(g, int(r.integers(0, 2)), float(r.integers(0, 12)), float(r.integers(-3, 4))) for g in ("a", None) for _ in range(300)]
    rows += [("one class", 1, 2.0, 1.0), ("one class", 1, 3.0, 0.0), ("a", None, 1.0, 1.0), ("a", 1, None, None)]
    df = spark.createDataFrame(rows, "g string, t int, s double, d double").withColumn("z", F.lit(0.0))
    auc = {x.g: x for x in statistics.auc_by_ranks(df, ["g"], "t", "s").collect()}
    area = {x.g: x.auc for x in statistics.roc_area(df, ["g"], "t", "s").collect()}
    curve = {}
    for x in statistics.roc_curve(df, ["g"], "t", "s").collect():
        curve.setdefault(x.g, []).append((x.score, x.fpr, x.tpr))
    ranks = {x.g: x for x in statistics.signed_rank(df, ["g"], "d", "z").collect()}
    for g in ("a", None):
        own = [x for x in rows if x[0] == g and x[1] is not None and x[2] is not None]
        pos, neg = ([x[2] for x in own if x[1] == c] for c in (1, 0))
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
        assert auc[g].auc == pytest.approx(want) and area[g] == pytest.approx(want)
        assert len(curve[g]) == 1 + len({x[2] for x in own})
        for score, fpr, tpr in curve[g]:
            at = np.inf if score is None else score
            assert fpr == pytest.approx(np.mean([n >= at for n in neg])) and tpr == pytest.approx(np.mean([p >= at for p in pos]))
        d = [x[3] for x in rows if x[0] == g and x[3] is not None and x[3] != 0]
        size = sorted(map(abs, d))
        rank = {a: np.mean([n + 1 for n, b in enumerate(size) if b == a]) for a in set(size)}
        assert ranks[g].w_plus == pytest.approx(sum(rank[abs(x)] for x in d if x > 0)) and ranks[g].n == len(d)
        assert ranks[g].ties == sum(c**3 - c for c in (size.count(a) for a in set(size)))
    assert auc["one class"].auc is None and area["one class"] is None
