"""The NIfTI format of readers and writers: what is read, and what a job leaves behind."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import nifti_source as ns
from tessera.sources import volume_files

SCHEMA = "name string, dim array<int>, affine array<double>, data array<float>"
AFFINE = np.diag([1.0, 2.0, 3.0, 1.0]).ravel().tolist()
BIG = [20, 15, 12]


def volume(n, dim=(4, 3, 5), name=None):
    return (name or f"s{n}/v{n}", list(dim), AFFINE, [float(x + 1000 * n) for x in range(int(np.prod(dim)))])


@pytest.fixture(scope="module")
def nifti(spark):
    ns.register(spark)
    return spark


def write(spark, rows, folder, mode="append", **options):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.format("nifti").mode(mode).options(**options).save(str(folder))


def read(spark, folder, **options):
    return spark.read.format("nifti").options(**options).load(str(folder))


def files_below(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


@pytest.mark.parametrize("compress", [False, True])
def test_round_trip_with_own_grids(nifti, tmp_path, compress):
    rows = [volume(1), volume(2, (2, 2, 2)), volume(3, (7, 1, 3, 2)), ("odd", [2, 1, 1], AFFINE, [1.5, None])]
    write(nifti, rows, tmp_path / "v", compress=compress)
    got = {r.name.split(".nii")[0]: r for r in read(nifti, tmp_path / "v").collect()}
    assert len(got) == 4
    for name, dim, affine, data in rows:
        assert got[name].dim == dim and got[name].data == data and got[name].error is None and np.allclose(got[name].affine, affine)
    plain = {r.path: r.data for r in volume_files.scan(nifti, str(tmp_path / "v")).collect()}
    assert sorted(map(repr, plain.values())) == sorted(repr(r.data) for r in got.values())


@pytest.mark.parametrize("compress,most", [(False, 352), (True, 1500)])
def test_headers_alone_read_a_small_share(nifti, tmp_path, compress, most):
    r = np.random.default_rng(1)
    rows = [(f"v{n}", BIG, AFFINE, r.normal(size=3600).tolist()) for n in range(9)]
    write(nifti, rows, tmp_path / "v", compress=compress)
    head = nifti.read.format("nifti").schema(ns.HEADERS).load(str(tmp_path / "v"))
    assert "data" not in head.columns
    got = head.collect()
    assert len(got) == 9 and all(x.dim == BIG and x.bytes_read <= most for x in got)
    whole = sum(os.path.getsize(tmp_path / "v" / x.name) for x in got)
    assert sum(x.bytes_read for x in got) < whole / 8


def test_slices_read_their_bytes(nifti, tmp_path):
    rows = [(f"v{n}", BIG, AFFINE, [float(x) for x in range(3600)]) for n in range(5)]
    write(nifti, rows, tmp_path / "v", kind="int16")
    slices = read(nifti, tmp_path / "v", layout="slices")
    every = slices.collect()
    assert len(every) == 60 and {(r.name, r.k) for r in every} == {(f"v{n}.nii", k) for n in range(5) for k in range(1, 13)}
    for k, ks in (("7", [7]), ("2, 3", [2, 3]), ("11-20", [11, 12]), ("1-2,4", [1, 2, 4]), ("13", [])):
        got = sorted(read(nifti, tmp_path / "v", layout="slices", k=k, names="v3.nii").collect(), key=lambda r: r.k)
        assert [r.k for r in got] == ks and {r.name for r in got} <= {"v3.nii"}
        assert all(r.bytes_read == 352 + 2 * 300 * (1 + n) for n, r in enumerate(got))
        for r in got:
            np.testing.assert_allclose(r.data, np.arange(300) + 300 * (r.k - 1), atol=0.06)
    assert slices.where("k % 5 = 0").count() == 10 and slices.where("k = 7").count() == 5 and slices.count() == 60
    with pytest.raises(Exception, match="layout slices"):
        read(nifti, tmp_path / "v", k="1").collect()
    cut = read(nifti, tmp_path / "v", layout="slices", partitionBytes=2000)
    assert sorted((r.name, r.k) for r in cut.collect()) == sorted((r.name, r.k) for r in every)
    assert cut.rdd.getNumPartitions() > slices.rdd.getNumPartitions()
    packed = tmp_path / "z"
    write(nifti, rows[:1], packed, compress=True)
    assert [r.data for r in read(nifti, packed, layout="slices", k="2").collect()] == [[float(x) for x in range(300, 600)]]


def test_broken_and_foreign_files(nifti, tmp_path):
    good = volume_files.write_nifti(np.arange(24.0), [2, 3, 4], AFFINE)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.nii").write_bytes(good)
    (tmp_path / "b.nii").write_bytes(good[:400])
    (tmp_path / "c.nii").write_bytes(b"short")
    (tmp_path / "d.nii.gz").write_bytes(gzip.compress(good)[:-30])
    (tmp_path / "e.nii").write_bytes(b"")
    (tmp_path / "f.nii.gz").write_bytes(gzip.compress(good[:200]) + gzip.compress(good[200:]))
    (tmp_path / "g.txt").write_bytes(b"other")
    got = {r.name: r for r in read(nifti, tmp_path).collect()}
    assert set(got) == {"sub/a.nii", "b.nii", "c.nii", "d.nii.gz", "e.nii", "f.nii.gz"}
    assert got["sub/a.nii"].data == got["f.nii.gz"].data == [float(x) for x in range(24)]
    assert "ends before" in got["b.nii"].error and got["b.nii"].dim == [2, 3, 4] and got["b.nii"].data is None
    assert got["c.nii"].error and got["d.nii.gz"].error and got["e.nii"].error
    heads = {r.name: r for r in nifti.read.format("nifti").schema(ns.HEADERS).load(str(tmp_path)).collect()}
    assert heads["b.nii"].error is None and heads["b.nii"].dim == [2, 3, 4]
    assert {r.name for r in read(nifti, tmp_path, pattern="*.gz").collect()} == {"d.nii.gz", "f.nii.gz"}
    assert read(nifti, tmp_path / "nowhere").collect() == []
    with pytest.raises(Exception, match="no odd"):
        nifti.read.format("nifti").schema("odd int").load(str(tmp_path)).collect()


def test_failed_job_leaves_nothing_and_a_rerun_the_set(nifti, tmp_path):
    folder = tmp_path / "v"
    write(nifti, [volume(0)], folder)
    before = files_below(folder)
    broken = [*(volume(n) for n in range(1, 40)), ("bad", [4, 4, 4], AFFINE, [1.0])]
    with pytest.raises(Exception, match="does not fit"):
        write(nifti, broken, folder)
    assert files_below(folder) == before
    assert [r.name for r in read(nifti, folder).collect()] == ["s0/v0.nii"]
    for _ in range(2):
        write(nifti, broken[:-1], folder)
        assert files_below(folder) == sorted([ns.MANIFEST, *(f"s{n}/v{n}.nii" for n in range(40))])
        assert sorted(r.data[0] for r in read(nifti, folder).collect()) == [1000.0 * n for n in range(40)]


@pytest.mark.parametrize("name", [None, "../out", "/abs", "_hidden", "a//b"])
def test_unusable_names_fail(nifti, tmp_path, name):
    rows = [volume(1), (name, *volume(2)[1:])]
    with pytest.raises(Exception, match="volume"):
        write(nifti, rows, tmp_path / "v")
    assert files_below(tmp_path / "v") == []


def test_two_rows_of_one_name_fail(nifti, tmp_path):
    with pytest.raises(Exception, match="named|twice"):
        write(nifti, [volume(1), volume(2), volume(1)] * 3, tmp_path / "v")
    assert files_below(tmp_path / "v") == []


def test_append_replaces_and_overwrite_removes(nifti, tmp_path):
    folder = tmp_path / "v"
    write(nifti, [volume(1), volume(2)], folder)
    write(nifti, [volume(7, name="s2/v2"), volume(3)], folder)
    assert {r.name: r.data[0] for r in read(nifti, folder).collect()} == {"s1/v1.nii": 1000.0, "s2/v2.nii": 7000.0, "s3/v3.nii": 3000.0}
    (folder / "stray.nii").write_bytes(b"not of the set")
    assert read(nifti, folder).count() == 3 and read(nifti, folder, manifest="false").count() == 4
    write(nifti, [volume(9)], folder, "overwrite")
    assert {r.name for r in read(nifti, folder).collect()} == {"s9/v9.nii"}
    assert files_below(folder) == [ns.MANIFEST, "s9/v9.nii", "stray.nii"]
    nifti.createDataFrame([], SCHEMA).write.format("nifti").mode("overwrite").save(str(folder))
    assert read(nifti, folder).count() == 0


class Dies(Exception):
    pass


@pytest.mark.parametrize("steps", [0, 1, 3])
def test_a_commit_that_dies_counts_and_is_finished(nifti, tmp_path, monkeypatch, steps):
    """The driver is lost after the intent and after some files were moved."""
    folder = tmp_path / "v"
    write(nifti, [volume(n) for n in range(3)], folder)
    writer = ns.NiftiWriter({"path": str(folder)}, overwrite=True)
    batch = nifti.createDataFrame([volume(n + 50, name=f"s{n}/v{n}") for n in range(2, 6)], SCHEMA).toArrow().to_batches()
    message = writer.write(iter(batch))
    local = ns.fs.LocalFileSystem()

    class Store:
        moved = 0

        def __getattr__(self, name):
            return getattr(local, name)

        def move(self, a, b):
            if "/_staging" in a:
                if Store.moved == steps:
                    raise Dies
                Store.moved += 1
            local.move(a, b)

    with monkeypatch.context() as m:
        m.setattr(ns, "store_of", lambda path: (Store(), str(folder)))
        m.setattr(ns, "MOVERS", 1)
        with pytest.raises(Dies):
            writer.commit([message])
        writer.abort([message])  # as Spark does; the set counts already
    want = {f"s{n}/v{n}.nii": 1000.0 * (n + 50) for n in range(2, 6)}
    seen = lambda: {r.name: r.data[0] for r in read(nifti, folder).collect()}
    assert seen() == want
    if steps == 1:
        write(nifti, [volume(8)], folder)  # the next writer finishes it first
        assert seen() == want | {"s8/v8.nii": 8000.0}
    else:
        assert ns.recover(str(folder)) == 1 and ns.recover(str(folder)) == 0
        assert seen() == want
    assert not [f for f in files_below(folder) if f.startswith("_") and f != ns.MANIFEST]


def test_attempts_that_were_given_up_are_not_in_the_set(nifti, tmp_path):
    """A task's first attempt is lost after it wrote; only the second's message arrives."""
    folder = tmp_path / "v"
    writer = ns.NiftiWriter({"path": str(folder)}, overwrite=False)
    batches = nifti.createDataFrame([volume(1)], SCHEMA).toArrow().to_batches()
    writer.write(iter(batches))
    writer.commit([writer.write(iter(batches)), None])
    assert files_below(folder) == [ns.MANIFEST, "s1/v1.nii"]


def test_filters_and_uris(nifti, tmp_path):
    write(nifti, [volume(1), volume(2)], tmp_path / "v")
    for path in (f"file://{tmp_path}/v", f"file:{tmp_path}/v", f"{tmp_path}/v/"):
        rows = nifti.read.format("nifti").load(path).where(F.col("name") == "s2/v2.nii").collect()
        assert [r.data[0] for r in rows] == [2000.0] and rows[0].path.endswith("/v/s2/v2.nii")


def test_stream_gives_each_volume_once_and_changed_ones_again(nifti, tmp_path):
    folder, out, state = tmp_path / "v", str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = nifti.readStream.format("nifti").load(str(folder)).select("name", F.element_at("data", 1).alias("first"), "error")
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.name, r.first) for r in nifti.read.parquet(out).collect())

    write(nifti, [volume(1), volume(2)], folder)
    first = [("s1/v1.nii", 1000.0), ("s2/v2.nii", 2000.0)]
    assert run() == first and run() == first  # started again: nothing new
    write(nifti, [volume(3), volume(8, name="s2/v2")], folder)
    write(nifti, [volume(4)], folder)
    with pytest.raises(Exception, match="does not fit"):
        write(nifti, [volume(5), ("bad", [4, 4, 4], AFFINE, [1.0])], folder)
    more = sorted([*first, ("s2/v2.nii", 8000.0), ("s3/v3.nii", 3000.0), ("s4/v4.nii", 4000.0)])
    assert run() == more and run() == more


def test_very_many_files_make_a_bounded_number_of_partitions(spark):
    reader = ns.NiftiReader({"path": "/x"}, ns.StructType.fromDDL(ns.VOLUMES))
    held = [ns.Held(f"v{n}.nii", 608, (f"/x/v{n}.nii",)) for n in range(100_000)]
    parts = reader.packed(held)
    assert len(parts) <= ns.OPEN_PARTITIONS + 2  # 1,588 by the cost of opening alone
    assert [h for p in parts for h, _, _ in p.items] == held
    assert len(reader.packed(held[:640])) == 11  # of few files nothing changes
    large = [ns.Held(f"v{n}.nii", 64 << 20, ()) for n in range(300)]
    assert len(reader.packed(large)) == 300
