"""Subjects, demographics, atlases and results as files."""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.strings import age_years, file_folder, file_stem, sex_code, subject_names
from tessera.operators.cohort import fallback, first_match
from tessera.plans.runtime import Scratch, ship

#: Files that the driver deletes at once, where tasks don't know the store.
REMOVERS = 32
#: Tasks a core that list folders, and that go through what they found.
TASKS = 8


def files_below(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Spark's ``binaryFile`` rows of all files below a folder. Folders are listed by a
    bounded number of tasks, where Spark would take one for each, up to 10,000."""
    name, tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism", TASKS * spark.sparkContext.defaultParallelism
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), tasks)))
    try:  # the folders are listed here, not when rows are asked for
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    finally:
        spark.conf.set(name, before)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Paths, sizes and times below a folder; contents are not read."""
    return files_below(spark, folder, pattern).select("path", "length", "modificationTime").coalesce(TASKS * spark.sparkContext.defaultParallelism)


def list_subjects(files: DataFrame, depth: int = 1) -> DataFrame:
    """Subjects from paths: the folder so many levels above the file."""
    parts = F.split("path", "/")
    return subject_names(files.select(F.element_at(parts, -1 - depth).alias("subject_id")).distinct())


def first_by_pattern(files: DataFrame, regex: str) -> DataFrame:
    """For each folder its first file, by name, that matches."""
    hit = files.where(file_stem(F.col("path")).rlike(regex)).withColumn("folder", file_folder(F.col("path")))
    return hit.groupBy("folder").agg(F.min("path").alias("path"))


def plain_or_compressed(files: DataFrame, name: str) -> DataFrame:
    """For each folder the file ``name.nii``, or ``name.nii.gz`` where that is missing."""
    at = files.withColumn("folder", file_folder(F.col("path")))
    pick = lambda suffix: at.where(F.col("path").endswith(f"/{name}{suffix}")).select("folder", "path")
    return fallback(pick(".nii"), pick(".nii.gz"), "folder", ["path"])


def read_demographics(spark: SparkSession, path: str) -> DataFrame:
    """From CSV or a spreadsheet (.xlsx) with ID, PatientAge ('073Y') and PatientSex; the
    first row of an ID counts."""
    if path.lower().endswith(".xlsx"):
        raw = read_sheet(spark, path, ("ID", "PatientAge", "PatientSex"))
    else:
        raw = spark.read.option("header", "true").csv(path).withColumn("_row", F.monotonically_increasing_id())
    return parse_demographics(first_match(raw, "ID", ["_row"]))


def parse_demographics(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("ID").alias("subject_id"), age_years(F.col("PatientAge")).alias("age"), sex_code(F.col("PatientSex")).alias("sex"))


def resolve_atlas(name: str, registry: Mapping[str, str]) -> str:
    """A registered atlas's path, or the path itself, looked for in the file system that Spark
    would read it from (one without a scheme: the session's default). Nothing is downloaded."""
    path = registry.get(name, name)
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"atlas {name!r}: {path} is not there, and atlases are not downloaded")
    return path


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write each row's ``content`` to ``folder`` under its ``name`` (which may have folders
    of its own); returns the paths. The folder is a path or URI that every executor reaches.
    A file is written under another name and renamed, so it appears whole or not."""
    ship(files.sparkSession)

    def run(batches):
        made = set()
        store, base = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            done = []
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                if raw.is_valid:
                    final = posixpath.join(base, name)
                    at = posixpath.dirname(final)
                    own = posixpath.join(at, f".{uuid.uuid4().hex}")
                    if at not in made:
                        store.create_dir(at, recursive=True)
                        made.add(at)
                    with store.open_output_stream(own) as f:
                        f.write(raw.as_buffer())
                    store.move(own, final)
                    done.append(final)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    return files.select("name", "content").mapInArrow(run, "path string")


def copy_outputs(spark: SparkSession, folder: str, patterns: Sequence[str], target: str) -> DataFrame:
    """Copy files whose name matches a pattern (regular expressions) from below ``folder`` to
    ``target``, each to where it was relative to ``folder``; returns the new paths."""
    root = folder.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    files = files_below(spark, folder)
    chosen = files.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike("|".join(f"(?:{p})" for p in patterns)))
    return write_files(chosen.select(F.element_at(F.split("path", re.escape(root) + "/", 2), -1).alias("name"), "content"), target)


def _sheet_rows(raw: bytes):
    """The cells of a workbook's first sheet, a dictionary of column letters a row."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    book = zipfile.ZipFile(io.BytesIO(raw))
    text = lambda e: "".join(t.text or "" for t in e.iter(main + "t"))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = [text(e) for e in ElementTree.parse(book.open("xl/sharedStrings.xml")).getroot().iter(main + "si")]
    first = next(ElementTree.parse(book.open("xl/workbook.xml")).getroot().iter(main + "sheet"))
    targets = {e.get("Id"): e.get("Target") for e in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
    at = targets[first.get(link)]
    for _, row in ElementTree.iterparse(book.open(at.lstrip("/") if at.startswith("/") else f"xl/{at}")):
        if row.tag != main + "row":
            continue
        cells = {}
        for n, c in enumerate(row.iter(main + "c")):
            value, kind = c.find(main + "v"), c.get("t", "n")
            found = text(c) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else value.text
            cells[re.match("[A-Z]+", c.get("r")).group() if c.get("r") else n] = found or None
        row.clear()
        yield cells


def read_sheet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Named columns of the first sheet of a workbook (.xlsx) as strings, and ``_row``, their
    order. The first row has the names; a column that is not there is missing."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for raw in batch.column("content"):
                rows = _sheet_rows(raw.as_py())
                places = {name: letter for letter, name in next(rows, {}).items()}
                found = [[r.get(places.get(c)) for c in columns] for r in rows]
                yield pa.RecordBatch.from_arrays([*(pa.array([r[n] for r in found], pa.string()) for n in range(len(columns))), pa.array(range(len(found)), pa.int64())], [*columns, "_row"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"`{c}` string" for c in columns) + ", _row long")


def sheet_bytes(columns: Sequence[str], rows: Sequence[Sequence[str | None]]) -> bytes:
    """A workbook (.xlsx) with one sheet of strings."""
    main, document = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/"
    cell = lambda c, n, v: "" if v is None else f'<c r="{c}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
    letters = [chr(65 + n) if n < 26 else chr(64 + n // 26) + chr(65 + n % 26) for n in range(len(columns))]
    body = "".join(f'<row r="{n}">' + "".join(cell(c, n, v) for c, v in zip(letters, r, strict=True)) + "</row>" for n, r in enumerate([columns, *rows], 1))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}relationships"><Relationship Id="rId1" Type="{document}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{document}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}relationships"><Relationship Id="rId1" Type="{document}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def save_results(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Replace a result table, or only the partitions that the rows are in."""
    out = df.write.mode("overwrite")
    (out.partitionBy(*by).option("partitionOverwriteMode", "dynamic") if by else out).parquet(path)


def remove_outputs(spark: SparkSession, files: DataFrame, patterns: Sequence[str], dry_run: bool = True) -> DataFrame:
    """Outputs by file-name pattern (regular expressions), for each subject; deleted where
    they are unless it is a dry run. Tasks delete in the stores that ``pyarrow.fs`` opens; in
    others the driver does, through Spark's file system, so in any store that it knows."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    chosen = files.where(name.rlike("|".join(f"(?:{p})" for p in patterns)))
    if not dry_run:
        ship(spark)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        # The choice is written first: once files are gone, a listing would not find them again.
        scratch = Scratch(spark, "removed")
        chosen = scratch.save(chosen, "chosen")
        # A file is a file operation, so rows are dealt out by number and not by size.
        dealt = chosen.select("path").repartition(TASKS * spark.sparkContext.defaultParallelism)
        left = scratch.save(dealt.mapInArrow(_remove, "path string"), "left")

        def remove(row):
            path = jvm.org.apache.hadoop.fs.Path(row["path"])
            path.getFileSystem(conf).delete(path, False)

        with ThreadPoolExecutor(REMOVERS) as pool:
            rows = left.toLocalIterator()
            while some := list(islice(rows, 100 * REMOVERS)):  # no more paths at once
                list(pool.map(remove, some))
        scratch.drop("left")
    return chosen


def _remove(batches):
    """Delete files; returns the paths of those in stores that are not known here. A file
    that is gone counts as deleted: a task may run again."""
    stores: dict[str, tuple[fs.FileSystem, str] | None] = {}

    def store_of(root):
        try:
            store, base = (fs.LocalFileSystem(), "") if root in ("", "file://") else fs.FileSystem.from_uri(f"{root}/")
            return store, base.rstrip("/")
        except (ValueError, NotImplementedError, OSError):
            return None

    for batch in batches:
        left = []
        for path in batch.column("path").to_pylist():
            scheme, rest = path.split(":", 1) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else ("", path)
            host, at = re.fullmatch(r"(//[^/]*)?(.*)", rest, re.S).groups(default="")
            root = "" if scheme == "" else "file://" if scheme == "file" else f"{scheme}:{host}"
            if root not in stores:
                stores[root] = store_of(root)
            if stores[root] is None:
                left.append(path)
                continue
            store, base = stores[root]
            places = [base + at]
            if store.type_name == "local":  # Hadoop keeps a file's checksums beside it
                places.append(posixpath.join(posixpath.dirname(at), f".{posixpath.basename(at)}.crc"))
            for place in places:
                with suppress(FileNotFoundError):
                    store.delete_file(place)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.string())], ["path"])


def log_failures(failures: DataFrame, path: str, step: str) -> None:
    """Append (subject, step, error) of rows whose error is not missing."""
    failures.where(F.col("error").isNotNull()).select("subject", F.lit(step).alias("step"), "error").write.mode("append").parquet(path)


def latex_table(df: DataFrame, columns: Sequence[tuple[str, str]], best: Mapping[str, bool] | None = None, most: int = 200) -> str:
    """A booktabs table of a report's few rows; ``best`` names columns whose largest (True)
    or smallest (False) value is bold, the first of equal ones."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    strong: dict[str, int] = {}
    for name, highest in (best or {}).items():
        held = [(r[name], n) for n, r in enumerate(rows) if r[name] is not None]
        if held:
            strong[name] = min(held, key=lambda x: (-x[0] if highest else x[0], x[1]))[1]
    show = lambda v: "--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("_", r"\_").replace("%", r"\%")
    lines = [r"\begin{tabular}{" + "l" + "r" * (len(columns) - 1) + "}", r"\toprule", " & ".join(title for _, title in columns) + r" \\", r"\midrule"]
    for n, r in enumerate(rows):
        lines.append(" & ".join(rf"\textbf{{{show(r[c])}}}" if strong.get(c) == n else show(r[c]) for c, _ in columns) + r" \\")
    return "\n".join([*lines, r"\bottomrule", r"\end{tabular}", ""])
