"""Text, typed records, delimited files, listings, previews and staged writes."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import fixed_values as fixed
from millrace.operators import blocks, ordering
from millrace.operators.rows import check_schema, tagged_union  # noqa: F401
from millrace.session import few_listing_tasks, spread, written, written_counting


def _given(path: str | None, what: str) -> str:
    if path is None:
        raise ValueError(f"{what} path is missing")
    return path


def _paths(paths: str | Sequence[str]) -> list[str]:
    """Comma-separated paths, or a list of them."""
    return [p.strip() for p in paths.split(",")] if isinstance(paths, str) else list(paths)


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def _child(spark: SparkSession, parent: str, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{parent.rstrip('/')}/{name}")


# text ------------------------------------------------------------------------------------------------

def read_text(spark: SparkSession, path: str | None, offsets: bool = False) -> DataFrame:
    """(line), or (source, offset, line) with the file of each line and the byte at which it starts there."""
    path = _given(path, "input")
    if not offsets:
        return spark.read.text(_paths(path)).withColumnRenamed("value", "line")
    # Lines end in a newline alone here, so that a return before it still counts as a byte of its line.
    rows = _in_file_order(spark.read.option("lineSep", "\n").text(_paths(path)), F.col("value"))
    size = (F.octet_length("line") + 1).cast("bigint")
    ended = blocks.running_sum(rows, ["source"], "pos", size, "_end", width="block")
    return ended.select("source", (F.col("_end") - size).alias("offset"), F.regexp_replace("line", "\r$", "").alias("line"))


def write_text(df: DataFrame, path: str | None, key: str, value: str, mode: str = "error") -> None:
    """One line per row: key, tab, value; a null is left out together with the tab."""
    df.select(F.concat_ws("\t", F.col(key).cast("string"), F.col(value).cast("string")).alias("value")) \
        .write.mode(mode).text(_given(path, "output"))


# typed records ---------------------------------------------------------------------------------------

def read_records(spark: SparkSession, paths: str | Sequence[str] | None, recursive: bool = False,
                 pick: str = "last") -> DataFrame:
    """Self-describing rows from one or more paths. A path with the latest marker is resolved first."""
    found = [latest(spark, p, pick) for p in _paths(_given(paths, "input"))]
    return spark.read.option("recursiveFileLookup", str(recursive).lower()).parquet(*found)


def write_records(df: DataFrame, path: str | None, schema: T.StructType, mode: str = "error") -> None:
    """Rows in the declared schema; a table that does not fit it fails before anything runs."""
    check_schema(df, schema).write.mode(mode).parquet(_given(path, "output"))


def schema_of(spark: SparkSession, path: str) -> DataFrame:
    """(position, name, type) of the columns of a record file: read from its footer, no rows are touched."""
    fields = spark.read.parquet(path).schema.fields
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)],
                                 "position int, name string, type string")


def latest(spark: SparkSession, path: str, pick: str = "last") -> str:
    """``dir#LATEST`` as the child of dir with the greatest name (``pick='first'``: the smallest).

    What follows the marker is dropped; an empty directory is an error; other paths stay as they are.
    """
    if fixed.LATEST_MARKER not in path:
        return path
    parent = path[:path.index(fixed.LATEST_MARKER)]
    fs, hadoop_path = file_system(spark, parent)
    names = sorted((s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(hadoop_path))
    if not names:
        raise FileNotFoundError(f"nothing under {parent}")
    return names[-1 if pick == "last" else 0][1]


def union_paths(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One scan over several paths."""
    return spark.read.parquet(*_paths(paths))


# delimited -------------------------------------------------------------------------------------------

def read_delimited(spark: SparkSession, path: str, schema: str, separator: str = "\t") -> DataFrame:
    """Delimited text under declared columns; compressed files are told by their suffix."""
    return (spark.read.schema(schema)
            .options(sep=separator, header=False, quote="", mode="PERMISSIVE").csv(path))


def write_delimited(df: DataFrame, path: str, separator: str = "\t", compression: str | None = None,
                    mode: str = "error") -> None:
    writer = df.write.mode(mode).options(sep=separator, quote="", emptyValue="", nullValue="")
    (writer if compression is None else writer.option("compression", compression)).csv(path)


# pairs -----------------------------------------------------------------------------------------------

def read_pairs(spark: SparkSession, path: str, schema: str = "key string, value string") -> DataFrame:
    """Key/value pairs of sequence files. ``toLocalIterator`` on the result reads them lazily on the client."""
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), schema)


def write_pairs(df: DataFrame, path: str, key: str, value: str) -> None:
    df.select(key, value).rdd.map(tuple).saveAsSequenceFile(path)


# avro ------------------------------------------------------------------------------------------------

def has_avro(spark: SparkSession) -> bool:
    """Is the Avro connector on the class path? It is a package of its own."""
    try:
        spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource(
            "avro", spark._jsparkSession.sessionState().conf())
        return True
    except Exception:  # the lookup fails when there is none
        return False


def read_as_json(spark: SparkSession, path: str, format: str = "avro") -> DataFrame:
    """(source, block, pos, line): each record of each file as a JSON text."""
    if format == "avro" and not has_avro(spark):
        raise ModuleNotFoundError("the Avro connector is not on the class path")
    return _in_file_order(spark.read.format(format).load(path), F.to_json(F.struct("*")))


def _in_file_order(scan: DataFrame, line: Column) -> DataFrame:
    # A task may read splits of one file in any order, so the place of a row is (start of split, row in task).
    return scan.select(plain_path(F.col("_metadata.file_path")).alias("source"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("pos"), line.alias("line"))


def preview(spark: SparkSession, path: str, start: int = 1, end: int = fixed.PREVIEW_ROWS) -> DataFrame:
    """(source, row, line): rows start .. end of each file, by the first reader that takes the path."""
    kind = _first_kind(spark, path)
    text = kind == "text"
    rows = _in_file_order(spark.read.text(path), F.col("value")) if text else read_as_json(spark, path, kind)
    return (ordering.row_slice(rows, start, end, inclusive=not text, chars_of="line" if text else None, width="block")
            .select("source", "row", "line"))


# What files of records begin with.
MAGIC = {b"PAR1": "parquet", b"Obj\x01": "avro", b"ORC": "orc"}


def _first_kind(spark: SparkSession, path: str) -> str:
    """What the first visible file under a path is, by its first bytes; anything else is text."""
    fs, hadoop_path = file_system(spark, path)
    files = fs.listFiles(hadoop_path, True)
    while files.hasNext():
        file = files.next().getPath()
        if not file.getName().startswith(("_", ".")):
            stream = fs.open(file)
            try:
                head = bytes(b for b in (stream.read() for _ in range(4)) if b >= 0)
            finally:
                stream.close()
            return next((kind for magic, kind in MAGIC.items() if head.startswith(magic)), "text")
    return "text"


# listings --------------------------------------------------------------------------------------------

def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of all files under a path; contents are not read, and filters on the path leave files
    out before they are looked at."""
    with few_listing_tasks(spark):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_size").alias("length"),
                        F.col("_metadata.file_modification_time").alias("modified"))


def list_directory(spark: SparkSession, path: str, hidden: bool = False, page: int = 100_000) -> DataFrame:
    """(name, is_dir, length) of the direct children of a directory; a directory has a slash and no length.

    The file system lists the one directory, page by page, so what lies below costs nothing and folders without files
    are shown. Beyond ``page`` entries each page is written out, so the driver holds one at a time. Names that begin with
    ``_`` or ``.`` are left out unless ``hidden`` is set.
    """
    fs, hadoop_path = file_system(spark, path)
    schema = "name string, is_dir boolean, length bigint"
    found, entries, pages = fs.listStatusIterator(hadoop_path), [], []
    while found.hasNext():
        status = found.next()
        name = status.getPath().getName()
        if hidden or not name.startswith(("_", ".")):
            entries.append((name + "/", True, None) if status.isDirectory() else (name, False, status.getLen()))
        if len(entries) == page:
            pages.append(written(spark.createDataFrame(entries, schema), "listing"))
            entries = []
    out = spark.createDataFrame(entries, schema)
    for full in pages:
        out = out.unionByName(full)
    return out


def plain_path(c: Column) -> Column:
    """A path as it is, out of one that is escaped as in an URL (Spark gives those of ``_metadata`` so)."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def root_of(spark: SparkSession, path: str) -> str:
    """What the plain paths below a folder begin with, behind scheme and host; ends in a slash."""
    fs, hadoop_path = file_system(spark, path)
    return fs.makeQualified(hadoop_path).toUri().getPath().rstrip("/") + "/"


def below(path: Column, root: str) -> Column:
    """The part of a plain path below a root."""
    return F.substr(path, F.instr(path, F.lit(root)) + F.lit(len(root)))


# trees of many small files ---------------------------------------------------------------------------

def _place(spark: SparkSession, root: str) -> tuple[str, str]:
    """Scheme and host of a folder, for Arrow, and its plain path without a slash at its end."""
    fs, hadoop_path = file_system(spark, root)
    uri = fs.makeQualified(hadoop_path).toUri()
    return f"{uri.getScheme()}://{uri.getHost() or ''}/", uri.getPath().rstrip("/")


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files below a folder, plain paths. Tasks list the folders, a level of the tree at a time, and write
    what they find, so the driver holds no names. Hidden names are left out, as Spark's readers do."""
    host, base = _place(spark, root)

    def children(folder: str) -> Iterator[tuple[str, bool]]:
        if host == "file:///":
            with os.scandir(folder) as entries:
                yield from ((e.name, e.is_dir()) for e in entries)
        else:
            from pyarrow.fs import FileSelector, FileSystem, FileType
            store, _ = FileSystem.from_uri(host)
            yield from ((e.base_name, e.type == FileType.Directory) for e in store.get_file_info(FileSelector(folder)))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str, bool]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()),
                                               pa.array([f[1] for f in found], pa.bool_())], ["path", "is_dir"])

        for rows in batches:
            for folder in rows.column(0).to_pylist():
                for name, is_dir in children(folder or "/"):
                    if not (name.startswith(".") or name.startswith("_") and "=" not in name):
                        found.append((f"{folder}/{name}", is_dir))
                        if len(found) == 10_000:
                            yield batch()
                            found.clear()
        if found:
            yield batch()

    level, out = spark.createDataFrame([(base,)], "path string"), None
    while True:
        entries, seen = written_counting(spread(level).mapInArrow(listed, "path string, is_dir boolean"), "level",
                                         folders=F.count_if("is_dir"))
        own = entries.filter("NOT is_dir").select("path")
        out = own if out is None else out.unionByName(own)
        if not seen["folders"]:
            return out
        level = entries.filter("is_dir").select("path")


def small_file_lines(spark: SparkSession, root: str, whole: bool = False):
    """A function from a plain path below a folder to the lines of that file (``whole``: its text as the one line), for
    many files that each fit a value many times over. It is a column, so a filter on the path leaves files unopened."""
    host, _ = _place(spark, root)

    @F.pandas_udf("array<string>")
    def read(paths: pd.Series) -> pd.Series:
        from pyarrow.fs import FileSystem
        store, _ = FileSystem.from_uri(host)
        out = []
        for path in paths:
            with store.open_input_stream(path, compression=None) as stream:
                text = stream.read().decode("utf-8", "replace")
            if whole:
                out.append([text])
            else:
                lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                out.append(lines if lines[-1] else lines[:-1])
        return pd.Series(out, dtype=object)

    return read


# named files -----------------------------------------------------------------------------------------

def write_named(files: DataFrame, root: str, name: str = "name", text: str = "text") -> int:
    """Write each row's text to the file ``<root>/<name>``, folders made as needed; returns how many there are.

    Tasks write through Arrow's file systems, each file under another name first, so that a task that is run again
    leaves whole files only. For many small files of given names; tables are better written by Spark.
    """
    host, base = _place(files.sparkSession, root)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        store, _ = FileSystem.from_uri(host)
        made = None
        for batch in batches:
            for own, content in zip(*(c.to_pylist() for c in batch.columns)):
                target = f"{base}/{own}"
                folder = target.rpartition("/")[0]
                if folder != made:
                    store.create_dir(folder, recursive=True)
                    made = folder
                begun = f"{target}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(begun) as out:
                    out.write((content or "").encode())
                store.move(begun, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return spread(files.select(name, text)).mapInArrow(put, "n bigint").agg(F.sum("n")).first()[0] or 0


def ready_for(spark: SparkSession, path: str, mode: str) -> bool:
    """Is a folder to be written, by the mode of a writer? An old one is deleted for ``overwrite``."""
    fs, folder = file_system(spark, path)
    if mode not in ("error", "errorifexists", "ignore", "overwrite", "append"):
        raise ValueError(f"unknown mode {mode}")
    there = fs.exists(folder)
    if there and mode.startswith("error"):
        raise FileExistsError(f"{path} exists")
    if there and mode == "overwrite":
        fs.delete(folder, True)
    fs.mkdirs(folder)
    return not there or mode != "ignore"


def write_runs(rows: DataFrame, root: str, key: str, line: str) -> int:
    """Write rows that lie together by a key, in their order, to a file ``<root>/<key>=<value>/part-<id>.txt`` for each
    value, under another name first; returns how many there are. Lines stream into the open file."""
    host, base = _place(rows.sparkSession, root)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        store, _ = FileSystem.from_uri(host)
        now = out = target = begun = None
        count = 0
        try:
            for batch in batches:
                for own, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if own != now:
                        if out is not None:
                            out.close()
                            store.move(begun, target)
                        now, count, folder = own, count + 1, f"{base}/{key}={own}"
                        store.create_dir(folder, recursive=True)
                        target, begun = f"{folder}/part-{run}.txt", f"{folder}/_{uuid.uuid4().hex}.tmp"
                        out = store.open_output_stream(begun, compression=None)
                    out.write(text.encode() + b"\n")
        finally:
            if out is not None:
                out.close()
        if out is not None:
            store.move(begun, target)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["n"])

    run = uuid.uuid4().hex  # the same for a task that is run again
    return rows.select(key, line).mapInArrow(put, "n bigint").agg(F.sum("n")).first()[0] or 0


# staged writes ---------------------------------------------------------------------------------------

def staged_overwrite(df: DataFrame, target: str, staging: str, job: str, format: str = "parquet") -> None:
    """Write to ``<staging>/<job>/<millis>/staged``, then put it in the place of the target.

    If the write fails the target is as before. The old target is renamed aside, not deleted, until the new
    one is in place. On object stores a rename is a copy, and neither step is atomic there.
    """
    base = f"{staging.rstrip('/')}/{job}/{int(time.time() * 1000)}"
    staged = f"{base}/staged"
    df.write.format(format).save(staged)
    spark = df.sparkSession
    fs, final = file_system(spark, target)
    _, new = file_system(spark, staged)
    old = _child(spark, base, "replaced")
    fs.mkdirs(final.getParent())
    had_old = fs.exists(final)
    if had_old and not fs.rename(final, old):
        raise OSError(f"cannot move {target} aside")
    if not fs.rename(new, final):
        if had_old:
            fs.rename(old, final)
        raise OSError(f"cannot move {staged} to {target}")
    if had_old:
        fs.delete(old, True)
