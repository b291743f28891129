"""Files written to the shared folder and read again, incremental steps, and grid arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import numeric as num
from tessera.functions import strings
from tessera.operators import geometry as geo
from tessera.operators import statistics as st
from tessera.operators import volumes as vol
from tessera.plans.runtime import Scratch, dealt, ship, table
from tessera.queries.common import DIM, VOX, cells, q6, r6, tiles
from tessera.sources import files, mat_source, nifti_source, volume_files
from tessera.streaming import incremental


def _folder(spark, name):
    return Scratch(spark, name).base


def _done(paths: DataFrame) -> None:
    """Carry out a write whose rows nobody asks for."""
    paths.write.format("noop").mode("overwrite").save()


def _number(path="path"):
    """The number in a file's name."""
    return F.regexp_extract(path, r"(\d+)[^/]*$", 1).cast("long")


def _volumes(spark, d):
    """Volumes with an affine whose shift along x is the volume's number."""
    rows = dealt(table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding"), "vec_id")
    affine = F.array(F.lit(1.5), F.lit(0.0), F.lit(0.0), F.col("vec_id").cast("double"), *map(F.lit, (0.0, 1.0, 0.0, -3.0, 0.0, 0.0, 2.0, 0.5, 0.0, 0.0, 0.0, 1.0)))
    return rows.select("vec_id", F.concat(F.lit("v"), "vec_id").alias("name"), F.array(*map(F.lit, DIM)).alias("dim"), affine.alias("affine"), F.col("embedding").alias("data"))


def _scanned(spark, folder):
    found = volume_files.scan(spark, folder).where("error IS NULL")
    return vol.to_cells(found.select(_number().alias("vec_id"), "data"), DIM, ["vec_id"]).select("vec_id", "i", "j", "k", r6(F.col("v"), "v"))


def _nifti(kind, compress):
    def run(spark, d):
        folder = _folder(spark, "nifti")
        _done(volume_files.save(_volumes(spark, d), folder, "name", kind, compress))
        return _scanned(spark, folder)

    run.__name__ = f"nifti_{kind}"
    return run


def _nifti_sql(slope, low, high):
    """Whole numbers of a slope that the file holds in single precision."""
    return f"""WITH {VOX}, s AS (SELECT vec_id, max(v) AS hi, min(v) AS lo FROM vox GROUP BY vec_id), m AS (SELECT vec_id, greatest({slope}, 0) AS slope FROM s)
SELECT vec_id, i, j, k, {q6(f"CASE WHEN slope = 0 THEN 0 ELSE CAST(least(greatest(round(v / slope), {low}), {high}) * CAST(CAST(slope AS FLOAT) AS DOUBLE) AS FLOAT) END", "v")} FROM vox JOIN m USING (vec_id)"""


def nifti_headers(spark, d):
    """Headers alone: shape, type and affine; of each file 352 bytes are read."""
    folder = _folder(spark, "headers")
    _written(_volumes(spark, d), folder, kind="int16")
    h = spark.read.format("nifti").schema(nifti_source.HEADERS).load(folder).where("error IS NULL")
    at = lambda n: F.element_at("affine", n + 1)
    return h.select(_number().alias("vec_id"), "bytes_read", *(F.element_at("dim", n + 1).alias(f"n{a}") for n, a in enumerate("xyz")), "dtype", *(r6(at(5 * n), f"s{a}") for n, a in enumerate("xyz")), *(r6(at(4 * n + 3), f"t{a}") for n, a in enumerate("xyz")))


def _written(volumes, folder, mode="append", **options):
    nifti_source.register(volumes.sparkSession)
    volumes.select("name", "dim", "affine", "data").write.format("nifti").mode(mode).options(**options).save(folder)


def nifti_slices(spark, d):
    """Slices 2 and 3 of every file: headers and those slices' bytes are read, no others.
    Bytes of all slices that were made of a file so far."""
    folder = _folder(spark, "slices")
    _written(_volumes(spark, d), folder)
    s = spark.read.format("nifti").option("layout", "slices").option("k", "2,3").load(folder)
    rows = s.select(_number("name").alias("vec_id"), "k", "bytes_read", F.posexplode("data").alias("p", "v"))
    return rows.select("vec_id", (F.col("p") % 4 + 1).cast("int").alias("i"), (F.floor(F.col("p") / 4) + 1).cast("int").alias("j"), "k", "bytes_read", r6(F.col("v").cast("double"), "v"))


def mat_round_trip(spark, d):
    """Each volume as a MATLAB file with a structure of results, deflated or not; of the files
    the arrays are read that are asked for."""
    mat_source.register(spark)
    folder, source = _folder(spark, "mat"), table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", "label", "embedding")

    def run(batches):
        for batch in batches:
            names, raws = [], []
            for n, (i, label) in enumerate(zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), strict=True)):
                x = batch.column("embedding")[n].values.to_numpy(zero_copy_only=False).astype(float)
                raws.append(mat_source.write_mat({"unread": x, "volume": x.reshape(DIM, order="F"), "results": {"label": np.array([[label]], np.int16), "name": f"v{i}"}}, i % 2 == 0))
                names.append(f"v{i}.mat")
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(raws, pa.binary())], ["name", "content"])

    _done(files.write_files(source.mapInArrow(run, "name string, content binary"), folder))
    rows = spark.read.format("mat").option("variables", "volume,results").load(folder).where("error IS NULL")
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    return rows.select(_number("name").alias("vec_id"), "variable", F.col("class").alias("kind"), F.array_join("dims", "x").alias("dims"), r6(total, "total"), r6(F.element_at("values", 1), "first"), "text")


def nifti_sets(spark, d):
    """A folder's set after each of four jobs: files are added, some of the same names
    replaced, a job fails (and leaves nothing), the set is replaced by another."""
    folder, v = _folder(spark, "sets"), _volumes(spark, d)
    first = v.where("vec_id % 3 <> 0")
    doubled = v.where("vec_id % 2 = 0").withColumn("data", F.transform("data", lambda x: x * 2))
    broken = v.withColumn("data", F.when(F.col("vec_id") % 7 == 3, F.slice("data", 1, 5)).otherwise(F.col("data")))
    out = None
    for n, (rows, mode) in enumerate(((first, "append"), (doubled, "append"), (broken, "append"), (doubled, "overwrite"))):
        try:
            _written(rows, folder, mode)
        except PySparkException:
            if rows is not broken:
                raise
        held = spark.read.format("nifti").load(folder).where("error IS NULL").select(F.lit(n).alias("job"), _number("name").alias("vec_id"), r6(vol.class_sum(vol.doubles(F.col("data")), range(1, 65)), "total"))
        held = Scratch(spark, "sets").save(held, "held")  # read before the next job
        out = held if out is None else out.unionByName(held)
    return out


def nifti_header_update(spark, d):
    """Every file is given another shift along y; its voxels stay as they were."""
    folder, volumes = _folder(spark, "update"), _volumes(spark, d)
    _done(volume_files.save(volumes, folder, "name", "float32", compress=True))
    moved = F.transform("affine", lambda x, n: F.when(n == 7, F.col("vec_id") / 4).otherwise(x))
    _done(volume_files.rewrite_headers(spark, folder, volumes.select(F.concat("name", F.lit(".nii.gz")).alias("name"), moved.alias("affine"))))
    found = volume_files.scan(spark, folder).where("error IS NULL")
    return found.select(_number().alias("vec_id"), r6(F.element_at("affine", 4), "tx"), r6(F.element_at("affine", 8), "ty"), r6(vol.class_sum(vol.doubles(F.col("data")), range(1, 65)), "total"))


ELEMENTS = tuple(volume_files.MHA_TYPES)


def mha_elements(spark, d):
    """All element types, deflated or not, in both byte orders."""
    ship(spark)
    folder, source = _folder(spark, "mha"), _volumes(spark, d).select("vec_id", "name", "dim", "affine", "data")

    def run(batches):
        for batch in batches:
            for n in range(len(batch)):
                i, element = batch.column("vec_id")[n].as_py(), ELEMENTS[batch.column("vec_id")[n].as_py() % 8]
                x = batch.column("data")[n].values.to_numpy(zero_copy_only=False).astype(float)
                x = x if element in ("MET_FLOAT", "MET_DOUBLE") else np.abs(x) * 100 if "_U" in element else x * 100
                raw = volume_files.write_mha(x, batch.column("dim")[n].as_py(), batch.column("affine")[n].as_py(), element, i % 3 == 0, i % 5 == 0)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("name")[n].as_py() + ".mha"]), pa.array([raw], pa.binary())], ["name", "content"])

    _done(files.write_files(source.mapInArrow(run, "name string, content binary"), folder))
    return _scanned(spark, folder)


def _subject_files(spark, d):
    """Subjects' folders: compressed images for all, expanded ones for some, and folders
    that are no subjects."""
    s = dealt(table(spark, d, "supplier").select(F.col("s_suppkey").alias("n")), "n")
    folder = F.concat(F.lit("data/s"), F.col("n"))
    content = F.encode(F.concat(F.lit("image "), "n"), "utf-8")
    every = s.select(F.concat(folder, F.lit("/pp_ct.nii.gz")).alias("name"), content.alias("content"))
    some = s.where("n % 2 = 0").select(F.concat(folder, F.lit("/pp_ct.nii")).alias("name"), content.alias("content"))
    more = s.where("n % 3 = 0").select(F.concat(folder, F.lit("/a_log.txt")).alias("name"), content.alias("content"))
    others = spark.createDataFrame([("data/overviews/pp_ct.nii.gz", b"x"), ("data/results/pp_ct.nii.gz", b"x")], "name string, content binary")
    base = _folder(spark, "subjects")
    _done(files.write_files(every.unionByName(some).unionByName(more).unionByName(others), base))
    return f"{base}/data"


def _subject(path="path"):
    return F.element_at(F.split(path, "/"), -2)


def subject_listing(spark, d):
    return files.list_subjects(files.list_files(spark, _subject_files(spark, d), "pp_*")).orderBy("subject_id")


def plain_or_compressed(spark, d):
    """Each subject's image: the expanded file where there is one."""
    found = files.plain_or_compressed(files.list_files(spark, _subject_files(spark, d)), "pp_ct")
    return found.select(F.element_at(F.split("folder", "/"), -1).alias("subject"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"))


def first_by_pattern(spark, d):
    found = files.first_by_pattern(files.list_files(spark, _subject_files(spark, d)), "^(pp|a)_")
    return found.select(F.element_at(F.split("folder", "/"), -1).alias("subject"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"))


def outputs_removed(spark, d):
    """What is left once expanded images and logs are deleted; a dry run deletes nothing."""
    folder = _subject_files(spark, d)
    files.remove_outputs(spark, files.list_files(spark, folder), [r"\.gz$"], dry_run=True)
    files.remove_outputs(spark, files.list_files(spark, folder), [r"\.nii$", "_log"], dry_run=False)
    return files.list_files(spark, folder).groupBy(F.regexp_extract("path", r"([^/]*)$", 1).alias("file")).agg(F.count("*").alias("n"))


def outputs_copied(spark, d):
    folder, target = _subject_files(spark, d), _folder(spark, "copies")
    _done(files.copy_outputs(spark, folder, [r"_log\.txt$"], target))
    copies = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(target)
    return copies.select(_subject().alias("subject"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), F.decode("content", "utf-8").alias("text"))


def results_store(spark, d):
    """A result table is replaced whole, and then only the partitions of new rows."""
    path = f"{_folder(spark, 'results')}/table"
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("key"), F.lit(1).alias("version"))
    files.save_results(o.where("status <> 'O'"), path, ["status"])
    files.save_results(o, path, ["status"])
    files.save_results(o.where("status = 'P'").withColumn("version", F.lit(2)), path, ["status"])
    return spark.read.parquet(path).groupBy("status", "version").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


def failures_appended(spark, d):
    """Two steps' failures in one log; rows that went well are not in it."""
    path = f"{_folder(spark, 'log')}/failures"
    e = table(spark, d, "events").select(F.col("user_id").alias("subject"), F.when(F.col("event_type") == "error", F.concat(F.lit("event "), "event_id")).alias("error"))
    for step in ("segment", "measure"):
        files.log_failures(e, path, step)
    return spark.read.parquet(path).groupBy("step", "subject").agg(F.count("*").alias("n"), F.min("error").alias("first_error"))


def latex_report(spark, d):
    """The lines of a table of a few rows; the best of each column is bold."""
    by = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("tissue")).agg(F.avg(F.col("l_quantity").cast("double")).alias("dice"), F.avg(F.col("l_tax").cast("double")).alias("hd95"))
    text = files.latex_table(by.orderBy("tissue"), [("tissue", "Tissue"), ("dice", "Dice"), ("hd95", "HD95")], {"dice": True, "hd95": False})
    return spark.createDataFrame(list(enumerate(text.strip().split("\n"))), "n int, line string")


_REPORT = r"""WITH t AS (SELECT l_returnflag AS tissue, avg(CAST(l_quantity AS DOUBLE)) AS dice, avg(CAST(l_tax AS DOUBLE)) AS hd95 FROM lineitem GROUP BY 1),
b AS (SELECT *, row_number() OVER (ORDER BY tissue) AS n, row_number() OVER (ORDER BY dice DESC, tissue) AS d, row_number() OVER (ORDER BY hd95, tissue) AS h, count(*) OVER () AS all_rows FROM t),
r AS (SELECT n + 3 AS n, tissue || ' & ' || CASE WHEN d = 1 THEN '\textbf{' || printf('%.3f', dice) || '}' ELSE printf('%.3f', dice) END || ' & ' || CASE WHEN h = 1 THEN '\textbf{' || printf('%.3f', hd95) || '}' ELSE printf('%.3f', hd95) END || ' \\' AS line FROM b)
SELECT CAST(n AS INTEGER) AS n, line FROM (
  SELECT * FROM (VALUES (0, '\begin{tabular}{lrr}'), (1, '\toprule'), (2, 'Tissue & Dice & HD95 \\'), (3, '\midrule')) x(n, line)
  UNION ALL SELECT * FROM r UNION ALL SELECT max(n) + 1, '\bottomrule' FROM r UNION ALL SELECT max(n) + 2, '\end{tabular}' FROM r)"""


def atlas_registry(spark, d):
    """Registered atlases by name: one that is there, and one that would need a download."""
    folder = f"{_folder(spark, 'atlas')}/mu"
    table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.col("embedding")[0].cast("double").alias("logp")).write.parquet(folder)
    registry, found = {"mine": folder, "other": "/nowhere/mu.nii"}, []
    for name in sorted(registry):
        try:
            found.append((name, spark.read.parquet(files.resolve_atlas(name, registry)).count()))
        except FileNotFoundError:
            found.append((name, None))
    return spark.createDataFrame(found, "name string, n_rows long")


def _customers(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    age = F.when(key % 11 == 0, key.cast("string")).otherwise(F.concat(F.lpad((key % 100).cast("string"), 3, "0"), F.lit("Y")))
    sex = F.when(key % 3 == 0, "M").when(key % 3 == 1, "F").otherwise("<?>")
    return c.select(key.cast("string").alias("ID"), age.alias("PatientAge"), sex.alias("PatientSex"), key.alias("_key"))


def _demographics(df):
    return df.select(F.col("subject_id").cast("long").alias("subject_id"), r6(F.col("age"), "age"), "sex")


def demographics_csv(spark, d):
    path = f"{_folder(spark, 'csv')}/people"
    _customers(spark, d).drop("_key").write.option("header", "true").csv(path)
    return _demographics(files.read_demographics(spark, path))


def demographics_sheet(spark, d):
    """One workbook, which one task writes, as a workbook is one file."""
    ship(spark)
    folder, names = _folder(spark, "sheet"), ("ID", "PatientAge", "PatientSex")

    def run(key, t):
        t = t.sort_by("_key")
        raw = files.sheet_bytes(names, list(zip(*(t[c].to_pylist() for c in names), strict=True)))
        return pa.table({"name": ["people.xlsx"], "content": pa.array([raw], pa.binary())})

    book = _customers(spark, d).withColumn("_book", F.lit("people")).groupBy("_book").applyInArrow(run, "name string, content binary")
    _done(files.write_files(book, folder))
    return _demographics(files.read_demographics(spark, f"{folder}/people.xlsx"))


_DEMOGRAPHICS = f"SELECT CAST(c_custkey AS BIGINT) AS subject_id, CASE WHEN c_custkey % 11 <> 0 THEN {q6('CAST(c_custkey % 100 AS DOUBLE)')} END AS age, CAST(CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS INTEGER) AS sex FROM customer"


def window_nonzero(spark, d):
    """A window from percentiles of the voxels that are not 0; voxels below 0.05 are set to 0."""
    c = cells(spark, d).withColumn("v", F.when(F.col("v") > 0.05, F.col("v")).otherwise(0.0))
    ends = st.hazen(c.where("v <> 0"), ["vec_id"], "v", (0.1, 0.9), ("lo", "hi"))
    met = c.join(ends, "vec_id")
    shown = F.when(F.col("hi") > F.col("lo"), num.clamp((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")), 0.0, 1.0))
    return met.select("vec_id", "i", "j", "k", r6(shown, "shown"))


_H = lambda p: f"least(greatest({p} * n + 0.5, 1), n)"
_AT = lambda p: f"sum(CASE WHEN r = floor({_H(p)}) THEN v * (1 - ({_H(p)} - floor({_H(p)}))) WHEN r = floor({_H(p)}) + 1 THEN v * ({_H(p)} - floor({_H(p)})) ELSE 0 END)"
_WINDOW = f"""WITH {VOX}, held AS (SELECT vec_id, v FROM vox WHERE v > 0.05), ranked AS (SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS r, count(*) OVER (PARTITION BY vec_id) AS n FROM held),
e AS (SELECT vec_id, {_AT(0.1)} AS lo, {_AT(0.9)} AS hi FROM ranked GROUP BY vec_id)
SELECT vec_id, i, j, k, CASE WHEN hi > lo THEN {q6("least(greatest((CASE WHEN v > 0.05 THEN v ELSE 0 END - lo) / (hi - lo), 0), 1)")} END AS shown FROM vox JOIN e USING (vec_id)"""

_MM = np.diag([1.5, 1.0, 2.0, 1.0])


def slices_shown(spark, d):
    """The slice at 45 % of the volume, and the one that holds a point in millimetres."""
    share, point = geo.relative_slice(DIM[2], 0.45), geo.slice_at(_MM, (3.2, 9.0, 6.9), DIM)
    both = F.explode(F.array(*(F.struct(F.lit(n).alias("view"), F.lit(k).alias("at")) for n, k in (("share", share), ("point", point[2])))))
    shown = tiles(spark, d).select("vec_id", both.alias("s"), "data").select("vec_id", "s.view", "s.at", "data")
    return vol.slice_cells(shown, F.col("at"), DIM, ["vec_id", "view"]).select("vec_id", "view", "i", "j", "k", r6(F.col("v"), "v"))


def stream_moments(spark, d):
    """Running count, sum and sum of squares of a stream of files, as means and variations."""
    folder, e = _folder(spark, "moments"), table(spark, d, "events").select("event_type", F.col("value").cast("double").alias("value"))
    e.repartition(3, "event_type").write.parquet(f"{folder}/in")
    moments = incremental.running_moments(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), ["event_type"], "value")
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out")
    moments.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found = incremental.variation_of_moments(spark.read.parquet(f"{folder}/out"))
    return found.select("event_type", "n", r6(F.col("mean"), "mean"), r6(F.col("cov"), "cov"))


def stream_once(spark, d):
    """Files of a folder are processed once, also when the stream starts again."""
    folder, o = _folder(spark, "stream"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    o.where("o_orderstatus <> 'P'").write.parquet(f"{folder}/in")
    twice = lambda: incremental.stream_new(spark, f"{folder}/in", o.schema, lambda s: s.withColumn("twice", F.col("o_orderkey") * 2), f"{folder}/out", f"{folder}/state").awaitTermination()
    twice()
    o.where("o_orderstatus = 'P'").write.mode("append").parquet(f"{folder}/in")
    twice()
    twice()
    return spark.read.parquet(f"{folder}/out").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("twice").alias("twice"))


def stream_volumes(spark, d):
    """Volumes of a folder's sets as a stream that is started three times: how often each came,
    and the sum of its voxels' totals."""
    folder, v = _folder(spark, "sets"), _volumes(spark, d)
    doubled = v.where("vec_id % 2 = 0").withColumn("data", F.transform("data", lambda x: x * 2))
    total = lambda rows: rows.select(_number("name").alias("vec_id"), vol.class_sum(vol.doubles(F.col("data")), range(1, 65)).alias("total"))
    start = lambda: incremental.stream_volumes(spark, folder, total, f"{folder}-out", f"{folder}-state").awaitTermination()
    _written(v.where("vec_id % 3 <> 0"), folder)
    start()
    _written(doubled, folder)
    start()
    start()
    return spark.read.parquet(f"{folder}-out").groupBy("vec_id").agg(F.count("*").alias("times"), r6(F.sum("total"), "total"))


def step_once(spark, d):
    """A step's rounds: all inputs, then those that failed, then all of them by force."""
    path = f"{_folder(spark, 'steps')}/done"
    work = table(spark, d, "supplier").select(F.col("s_suppkey").alias("subject"), F.lit("ct").alias("input"))
    process = lambda df: df.withColumn("error", F.when(F.col("subject") % 10 == 0, "failed"))
    rounds = [(n, incremental.run_step(work, path, ["subject", "input"], "segment", process, force).count()) for n, force in enumerate((False, False, True))]
    return spark.createDataFrame(rounds, "round int, n_processed long")


def parsed_headers(spark, d):
    """Lines 'key = value' of image headers, one a supplier."""
    line = F.concat(F.lit(" ElementSpacing = "), (F.col("s_suppkey") / 4).cast("string"), F.lit(" = x "))
    key, value = strings.key_value(line)
    return table(spark, d, "supplier").select("s_suppkey", key.alias("key"), value.alias("value"))


QUERIES = {
    "nifti_float32": (_nifti("float32", False), f"WITH {VOX} SELECT vec_id, i, j, k, {q6('v', 'v')} FROM vox"),
    "nifti_gz_uint8": (_nifti("uint8", True), _nifti_sql("hi / 255.0", 0, 255)),
    "nifti_int16": (_nifti("int16", False), _nifti_sql("greatest(hi / 32767.0, -lo / 32768.0)", -32768, 32767)),
    "nifti_headers": (
        nifti_headers,
        f"SELECT vec_id, CAST(352 AS BIGINT) AS bytes_read, CAST(4 AS INTEGER) AS nx, CAST(4 AS INTEGER) AS ny, CAST(4 AS INTEGER) AS nz, 'int16' AS dtype, {q6('CAST(1.5 AS DOUBLE)', 'sx')}, {q6('CAST(1 AS DOUBLE)', 'sy')}, {q6('CAST(2 AS DOUBLE)', 'sz')}, {q6('CAST(vec_id AS DOUBLE)', 'tx')}, {q6('CAST(-3 AS DOUBLE)', 'ty')}, {q6('CAST(0.5 AS DOUBLE)', 'tz')} FROM embeddings WHERE embedding IS NOT NULL",
    ),
    "nifti_slices": (nifti_slices, f"WITH {VOX} SELECT vec_id, i, j, k, CAST(352 + 64 * (k - 1) AS BIGINT) AS bytes_read, {q6('v', 'v')} FROM vox WHERE k IN (2, 3)"),
    "mat_round_trip": (
        mat_round_trip,
        f"""WITH {VOX}, t AS (SELECT vec_id, sum(v) AS total, sum(CASE WHEN i = 1 AND j = 1 AND k = 1 THEN v END) AS first FROM vox GROUP BY vec_id)
SELECT vec_id, 'volume' AS variable, 'double' AS kind, '4x4x4' AS dims, {q6('total', 'total')}, {q6('first', 'first')}, CAST(NULL AS VARCHAR) AS text FROM t
UNION ALL SELECT vec_id, 'results.label', 'int16', '1x1', {q6('CAST(label AS DOUBLE)')}, {q6('CAST(label AS DOUBLE)')}, NULL FROM embeddings WHERE embedding IS NOT NULL
UNION ALL SELECT vec_id, 'results.name', 'char', '1x' || length('v' || vec_id), NULL, NULL, 'v' || vec_id FROM embeddings WHERE embedding IS NOT NULL""",
    ),
    "nifti_sets": (
        nifti_sets,
        f"""WITH {VOX}, t AS (SELECT vec_id, sum(v) AS total FROM vox GROUP BY vec_id), kept AS (SELECT *, vec_id % 3 <> 0 AS first, vec_id % 2 = 0 AS again FROM t)
SELECT CAST(job AS INTEGER) AS job, vec_id, {q6('CASE WHEN job > 0 AND again THEN 2 * total ELSE total END', 'total')} FROM kept, (VALUES (0), (1), (2), (3)) j(job) WHERE CASE job WHEN 0 THEN first WHEN 3 THEN again ELSE first OR again END""",
    ),
    "nifti_header_update": (nifti_header_update, f"WITH {VOX} SELECT vec_id, {q6('CAST(vec_id AS DOUBLE)', 'tx')}, {q6('vec_id / CAST(4 AS DOUBLE)', 'ty')}, {q6('sum(v)', 'total')} FROM vox GROUP BY vec_id"),
    "mha_elements": (mha_elements, f"WITH {VOX} SELECT vec_id, i, j, k, {q6('CASE WHEN vec_id % 8 IN (6, 7) THEN v WHEN vec_id % 2 = 1 THEN floor(abs(v) * 100 + 0.5) ELSE floor(v * 100 + 0.5) END', 'v')} FROM vox"),
    "subject_listing": (subject_listing, "SELECT 's' || s_suppkey AS subject_id FROM supplier"),
    "plain_or_compressed": (plain_or_compressed, "SELECT 's' || s_suppkey AS subject, CASE WHEN s_suppkey % 2 = 0 THEN 'pp_ct.nii' ELSE 'pp_ct.nii.gz' END AS file FROM supplier UNION ALL SELECT s, 'pp_ct.nii.gz' FROM (VALUES ('overviews'), ('results')) t(s)"),
    "first_by_pattern": (first_by_pattern, "SELECT 's' || s_suppkey AS subject, CASE WHEN s_suppkey % 3 = 0 THEN 'a_log.txt' WHEN s_suppkey % 2 = 0 THEN 'pp_ct.nii' ELSE 'pp_ct.nii.gz' END AS file FROM supplier UNION ALL SELECT s, 'pp_ct.nii.gz' FROM (VALUES ('overviews'), ('results')) t(s)"),
    "outputs_removed": (outputs_removed, "SELECT 'pp_ct.nii.gz' AS file, count(*) + 2 AS n FROM supplier"),
    "outputs_copied": (outputs_copied, "SELECT 's' || s_suppkey AS subject, 'a_log.txt' AS file, 'image ' || s_suppkey AS text FROM supplier WHERE s_suppkey % 3 = 0"),
    "results_store": (results_store, "SELECT o_orderstatus AS status, CAST(CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS INTEGER) AS version, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1, 2"),
    "failures_appended": (failures_appended, "SELECT step, user_id AS subject, count(*) AS n, min('event ' || event_id) AS first_error FROM events, (VALUES ('segment'), ('measure')) s(step) WHERE event_type = 'error' GROUP BY 1, 2"),
    "latex_report": (latex_report, _REPORT),
    "atlas_registry": (atlas_registry, "SELECT 'mine' AS name, count(*) AS n_rows FROM embeddings WHERE embedding IS NOT NULL UNION ALL SELECT 'other', NULL"),
    "demographics_csv": (demographics_csv, _DEMOGRAPHICS),
    "demographics_sheet": (demographics_sheet, _DEMOGRAPHICS),
    "window_nonzero": (window_nonzero, _WINDOW),
    "slices_shown": (slices_shown, f"WITH {VOX} SELECT vec_id, view, i, j, k, {q6('v', 'v')} FROM vox JOIN (VALUES ('share', 2), ('point', 3)) s(view, z) ON k = z"),
    "stream_moments": (
        stream_moments,
        f"SELECT event_type, count(value) AS n, {q6('avg(CAST(value AS DOUBLE))', 'mean')}, {q6('stddev_samp(CAST(value AS DOUBLE)) / abs(avg(CAST(value AS DOUBLE)))', 'cov')} FROM events WHERE value IS NOT NULL GROUP BY event_type",
    ),
    "stream_once": (stream_once, "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey * 2) AS BIGINT) AS twice FROM orders GROUP BY 1"),
    "stream_volumes": (
        stream_volumes,
        f"""WITH {VOX}, t AS (SELECT vec_id, sum(v) AS total, vec_id % 3 <> 0 AS first, vec_id % 2 = 0 AS again FROM vox GROUP BY vec_id)
SELECT vec_id, CAST(first AS BIGINT) + CAST(again AS BIGINT) AS times, {q6('CASE WHEN first THEN total ELSE 0 END + CASE WHEN again THEN 2 * total ELSE 0 END', 'total')} FROM t WHERE first OR again""",
    ),
    "step_once": (step_once, "SELECT CAST(r AS INTEGER) AS round, count(*) FILTER (r <> 1 OR s_suppkey % 10 = 0) AS n_processed FROM supplier, (VALUES (0), (1), (2)) x(r) GROUP BY r"),
    "parsed_headers": (parsed_headers, "SELECT s_suppkey, 'ELEMENTSPACING' AS key, CAST(s_suppkey / CAST(4 AS DOUBLE) AS VARCHAR) || ' = x' AS value FROM supplier"),
}
