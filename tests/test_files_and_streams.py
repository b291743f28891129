"""Files written and read again, incremental steps, streams and the study."""

import gzip
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import study
from tessera.sources import files, volume_files
from tessera.streaming import incremental

AFFINE = [float(x) for x in (-1.5, 0, 0, 20, 0, 2, 0, -30, 0, 0, 3, 5, 0, 0, 0, 1)]


@pytest.mark.parametrize("kind,most", [("float32", 1e-6), ("float64", 1e-6), ("int16", 2e-4), ("uint8", 0.02)])
def test_nifti_round_trip(spark, tmp_path, kind, most):
    x = np.abs(np.random.default_rng(1).normal(size=24)).astype(np.float32)
    df = spark.createDataFrame([("a", [2, 3, 4], AFFINE, x.tolist()), ("b", [2, 3, 4], AFFINE, [0.0] * 24)], "name string, dim array<int>, affine array<double>, data array<float>")
    out = tmp_path / "out"
    assert volume_files.save(df, str(out), "name", kind, compress=True).count() == 2
    got = {r.path.rsplit("/", 1)[1]: r for r in volume_files.scan(spark, str(out)).collect()}
    a = got["a.nii.gz"]
    assert a.error is None and a.dim == [2, 3, 4] and a.dtype == kind and np.allclose(a.affine, AFFINE, atol=1e-5)
    assert np.abs(np.array(a.data) - x).max() <= most * max(1, x.max())
    assert got["b.nii.gz"].data == [0.0] * 24
    assert volume_files.scan(spark, str(out), headers_only=True).where("data IS NOT NULL").count() == 0


def test_mha_unsigned_compressed_and_broken_files(spark, tmp_path):
    x = np.arange(24, dtype="<u2") + 60000
    head = "ObjectType = Image\nNDims = 3\nDimSize = 2 3 4\nElementSpacing = 1 2 3\nOffset = 5 6 7\nElementType = {}\n{}ElementDataFile = LOCAL\n"
    (tmp_path / "a.mha").write_bytes(head.format("MET_USHORT", "").encode() + x.tobytes())
    (tmp_path / "b.mha").write_bytes(head.format("MET_USHORT", "CompressedData = True\n").encode() + zlib.compress(x.tobytes()))
    (tmp_path / "c.mha").write_bytes(head.format("MET_ODD", "").encode())
    (tmp_path / "d.nii").write_bytes(b"short")
    (tmp_path / "e.nii.gz").write_bytes(gzip.compress(volume_files.write_nifti([1.0, float("nan")], [2, 1, 1], np.eye(4).ravel())))
    got = {r.path.rsplit("/", 1)[1]: r for r in volume_files.scan(spark, str(tmp_path)).collect()}
    assert got["a.mha"].data == got["b.mha"].data == x.astype(float).tolist()
    m = np.array(got["a.mha"].affine).reshape(4, 4)
    assert np.allclose(m @ [1, 1, 1, 1], [-5, -6, 7, 1]) and np.allclose(np.abs(np.diag(m))[:3], (1, 2, 3))
    assert "MET_ODD" in got["c.mha"].error and got["d.nii"].error and got["e.nii.gz"].data == [1.0, None]


def test_listing_demographics_atlas_and_failures(spark, tmp_path):
    for s in ("s1", "s2", ".hidden", "results"):
        (tmp_path / "data" / s).mkdir(parents=True)
        (tmp_path / "data" / s / "pp_ct.nii.gz").write_bytes(b"x")
    (tmp_path / "data" / "s1" / "pp_ct.nii").write_bytes(b"x")
    found = files.list_files(spark, str(tmp_path / "data"), "pp_*")
    assert {r.subject_id for r in files.list_subjects(found).collect()} == {"s1", "s2"}
    pick = {r.folder.rsplit("/", 1)[1]: r.path.rsplit("/", 1)[1] for r in files.plain_or_compressed(found, "pp_ct").collect()}
    assert pick["s1"] == "pp_ct.nii" and pick["s2"] == "pp_ct.nii.gz"
    assert files.first_by_pattern(found, "^pp_").count() == 3
    gone = files.remove_outputs(spark, found, [r"^pp_.*\.nii$"], dry_run=False)
    assert gone.count() == 1 and not (tmp_path / "data/s1/pp_ct.nii").exists() and (tmp_path / "data/s1/pp_ct.nii.gz").exists()
    (tmp_path / "d.csv").write_text("ID,PatientAge,PatientSex\na,073Y,M\na,050Y,F\nb,7 months,F\nc,xxY,O\n")
    got = {r.subject_id: (r.age, r.sex) for r in files.read_demographics(spark, str(tmp_path / "d.csv")).collect()}
    assert got == {"a": (73.0, 1), "b": (None, 0), "c": (None, None)}
    with pytest.raises(FileNotFoundError):
        files.resolve_atlas("mu", {"mu": str(tmp_path / "none")})
    bad = spark.createDataFrame([("a", "boom"), ("b", None)], "subject string, error string")
    for step in ("one", "two"):
        files.log_failures(bad, str(tmp_path / "log"), step)
    assert {(r.subject, r.step) for r in spark.read.parquet(str(tmp_path / "log")).collect()} == {("a", "one"), ("a", "two")}
    text = files.latex_table(spark.createDataFrame([("x_1", 0.5), ("y", 0.7), ("z", 0.7)], "m string, d double"), [("m", "Method"), ("d", "Dice")], {"d": True})
    assert r"x\_1 & 0.500" in text and text.count(r"\textbf{0.700}") == 1
    files.save_results(bad, str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res")).count() == 2


def test_step_runs_once_and_retries_failures(spark, tmp_path):
    work = spark.createDataFrame([("a", "x"), ("b", "x")], "subject string, input string")
    step = lambda df: df.withColumn("error", F.when(F.col("subject") == "b", "no"))
    counts = [incremental.run_step(work, str(tmp_path / "done"), ["subject", "input"], "seg", step, force).count() for force in (False, False, True)]
    assert counts == [2, 1, 2]


def test_stream_takes_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(5).write.parquet(str(src))
    for _ in range(2):
        incremental.stream_new(spark, str(src), "id long", lambda df: df.withColumn("twice", F.col("id") * 2), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    spark.range(5, 8).write.mode("append").parquet(str(src))
    incremental.stream_new(spark, str(src), "id long", lambda df: df.withColumn("twice", F.col("id") * 2), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.twice for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2 * n for n in range(8)]


def test_running_moments(spark, tmp_path):
    spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "k int, v double").write.parquet(str(tmp_path / "in"))
    stream = incremental.running_moments(spark.readStream.schema("k int, v double").parquet(str(tmp_path / "in")), ["k"], "v")
    stream.writeStream.format("memory").queryName("moments").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {r.k: (r.mean, r.cov) for r in incremental.variation_of_moments(spark.table("moments")).collect()}
    assert got[1] == (2.0, pytest.approx(2**0.5 / 2)) and got[2] == (5.0, 0.0)


def test_study_end_to_end(spark, tmp_path):
    r = np.random.default_rng(6)
    rows = []
    for s in range(8):
        for t in ("GM", "WM", "CSF"):
            base = r.random(64)
            for m, noise in (("mr", 0), ("ct_plain", 0.4), ("ct_new", 0.1)):
                for space in ("native", "modulated"):
                    if s != 7 or m != "ct_plain":
                        rows.append((f"s{s}", m, t, space, np.clip(base + r.normal(0, noise + 1e-9, 64), 0, 1).tolist()))
    spark.createDataFrame(rows, "subject string, method string, tissue string, space string, data array<double>").write.parquet(str(tmp_path / "t/volume"))
    spark.createDataFrame([("s0",)], "subject string").write.parquet(str(tmp_path / "t/exclusion"))
    study.run(spark, str(tmp_path / "t"), str(tmp_path / "o"), study.Study(dim=(4, 4, 4)))
    read = lambda n: spark.read.parquet(str(tmp_path / "o" / n))
    assert {x.subject for x in read("subjects").collect()} == {f"s{n}" for n in range(1, 7)}
    assert all(x.y50 > x.x50 for x in read("comparison").where("metric = 'dice'").collect()) and read("overlap").count() == 6 * 3 * 2 * 3
    assert {x.method for x in read("agreement").collect()} == {"ct_plain", "ct_new"}


def test_files_of_a_batch_are_written_together(spark, monkeypatch):
    rows = [(f"v{n}", [2, 2, 1], [float(x) for x in (1, 0, 0, n, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)], [float(n + k) for k in range(4)] if n != 7 else None) for n in range(60)]
    df = spark.createDataFrame(rows, "name string, dim array<int>, affine array<double>, data array<double>").coalesce(1)
    batch = df.toArrow().combine_chunks().to_batches()[0]
    found = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: found.append(run))
    volume_files.encode(df)
    whole = list(found[0](iter([batch])))
    monkeypatch.setattr(volume_files, "FILE_BYTES", 3 * 368)
    parts = list(found[0](iter([batch])))
    assert len(whole) == 1 and 20 <= len(parts) < 30
    for out in (whole, parts):
        got = {n: raw for b in out for n, raw in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True)}
        assert got == {n: None if x is None else volume_files.write_nifti(np.array(x), d, a, "float32", "", False) for n, d, a, x in rows}


def test_files_are_deleted_by_tasks_and_folders_listed_by_few(spark, tmp_path, monkeypatch):
    for n in range(120):
        (tmp_path / "data" / f"s {n}%20").mkdir(parents=True)
        for name in ("a.nii", "a.nii.gz", ".a.nii.crc"):
            (tmp_path / "data" / f"s {n}%20" / name).write_bytes(b"x")
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, tracker = spark.conf.get(name), spark.sparkContext.statusTracker()
    found = files.list_files(spark, str(tmp_path / "data"), "*.nii*")
    assert spark.conf.get(name) == before and found.count() == 240
    assert max((i.numTasks for j in tracker.getJobIdsForGroup(None)[:3] for s in tracker.getJobInfo(j).stageIds if (i := tracker.getStageInfo(s))), default=0) <= files.TASKS * spark.sparkContext.defaultParallelism
    by_driver = []
    monkeypatch.setattr(files, "ThreadPoolExecutor", lambda n: by_driver.append(n) or _Pool(by_driver))
    gone = files.remove_outputs(spark, found, [r"\.nii$"], dry_run=False)
    assert gone.count() == 120 and by_driver == [files.REMOVERS]  # no path came to the driver
    assert {p.name for p in (tmp_path / "data").rglob("*") if p.is_file()} == {"a.nii.gz"}


class _Pool:
    def __init__(self, calls):
        self.calls = calls

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def map(self, f, rows):
        self.calls += rows
        return map(f, rows)


def test_paths_of_unknown_stores_are_left_to_the_driver(tmp_path):
    import pyarrow as pa

    (tmp_path / "x").write_bytes(b"x")
    paths = ["odd://host/a/b", f"file:{tmp_path}/x", f"file:{tmp_path}/gone", f"file://{tmp_path}/none"]
    (out,) = files._remove(iter([pa.RecordBatch.from_arrays([pa.array(paths)], ["path"])]))
    assert out.column("path").to_pylist() == ["odd://host/a/b"] and not (tmp_path / "x").exists()
