"""Files that a workflow leaves behind: run records, execution documents, job definitions, schedules, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace import fixed_values as fixed
from millrace.functions import json_text, times
from millrace.operators.rows import level_and_message
from millrace.session import few_listing_tasks, spread
from millrace.sources import files

# Shape of an execution document.
FLOW_SCHEMA = """
type string,
flow struct<
  jobs: map<string, struct<type: string, name: string, status: string, id: string,
                           overrideProps: map<string,string>, returnProps: map<string,string>,
                           startTime: string, endTime: string>>,
  root: array<string>, dependencies: map<string, array<string>>, id: string>,
parentProps map<string,string>
"""


# Letters that stand for a character behind a backslash.
ESCAPED = (("t", "\t"), ("n", "\n"), ("r", "\r"), ("f", "\f"))


def _left_trimmed(line: str) -> Column:
    return F.regexp_replace(line, r"^[ \t\f]+", "")


def logical_lines(lines: DataFrame, path: str = "path", pos: str = "pos", line: str = "line") -> DataFrame:
    """(path, pos, line): lines that end in an odd number of backslashes joined with the next one of their file.

    The white space that begins the next line is dropped. Comments are never continued.
    """
    comment = _left_trimmed(line).rlike("^[#!]")
    open_end = ~comment & (F.length(F.regexp_extract(line, r"(\\*)\z", 1)) % 2 == 1)
    in_file = W.partitionBy(path).orderBy(pos)
    tied = F.coalesce(F.lag("_open").over(in_file), F.lit(False))
    pieces = (lines.withColumn("_open", open_end).withColumn("_tied", tied)
              .withColumn("_group", F.sum(F.when(F.col("_tied"), 0).otherwise(1)).over(in_file))
              .withColumn("_piece", F.when(F.col("_open"), F.expr(f"left({line}, length({line}) - 1)")).otherwise(F.col(line)))
              .withColumn("_piece", F.when(F.col("_tied"), _left_trimmed("_piece")).otherwise(F.col("_piece"))))
    parts = F.array_sort(F.collect_list(F.struct(pos, "_piece")))
    return (pieces.groupBy(path, "_group").agg(F.min(pos).alias(pos), parts.alias("_parts"))
            .select(path, pos, F.array_join(F.transform("_parts", lambda x: x["_piece"]), "").alias(line)))


def unescaped(c: Column) -> Column:
    """A key or value without its escapes: unicode, tab, newline, return, form feed, and any other character."""
    kept = F.replace(c, F.lit("\\\\"), F.lit("\x01"))  # an escaped backslash escapes nothing itself
    # Characters beyond the basic plane are two codes that only make sense together.
    for pattern in (r"(\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})", r"(\\u[0-9a-fA-F]{4})"):
        codes = F.array_distinct(F.regexp_extract_all(kept, F.lit(pattern), F.lit(1)))
        kept = F.aggregate(codes, kept, lambda text, code: F.replace(text, code, F.decode(
            F.unhex(F.replace(code, F.lit("\\u"), F.lit(""))), "UTF-16BE")))
    for sign, meant in ESCAPED:
        kept = F.replace(kept, F.lit("\\" + sign), F.lit(meant))
    return F.replace(F.regexp_replace(kept, r"\\(.)", "$1"), F.lit("\x01"), F.lit("\\"))


def escaped(c: Column, key: bool) -> Column:
    """The inverse of ``unescaped``: signs with a meaning behind a backslash, what is not plain ASCII by its code. All
    spaces of a key are escaped, of a value the first if the value begins with it."""
    def sign(x: Column) -> Column:
        plain = F.when(x.isin("\\", "=", ":", "#", "!"), F.concat(F.lit("\\"), x))
        for letter, meant in ESCAPED:
            plain = plain.when(x == meant, F.lit("\\" + letter))
        if key:
            plain = plain.when(x == " ", F.lit("\\ "))
        code = F.regexp_replace(F.hex(F.encode(x, "UTF-16BE")), "(.{4})", r"\\u$1")
        return plain.when(x.rlike("^[ -~]$"), x).otherwise(code)

    text = F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)(.)"), F.lit(1)), sign), "")
    return text if key else F.when(F.startswith(text, F.lit(" ")), F.concat(F.lit("\\"), text)).otherwise(text)


def property_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``key`` and ``value`` of ``key=value``, ``key: value`` or ``key value`` lines, without escapes; comments and
    blank lines drop out. Lines that go on in the next one have to be joined first (``logical_lines``)."""
    text = _left_trimmed(line)
    pattern = r"^((?:\\.|[^\\=:\s])+)\s*(?:[=:]\s*|\s+|$)(.*)$"
    return (lines.filter((text != "") & ~text.rlike("^[#!]"))
            .withColumn("key", unescaped(F.regexp_extract(text, pattern, 1)))
            .withColumn("value", unescaped(F.regexp_extract(text, pattern, 2))))


def run_directory_time(name: Column | str) -> Column:
    """The time a run directory is named after; null for any other name."""
    c = F.col(name) if isinstance(name, str) else name
    return F.try_to_timestamp(c, F.lit(fixed.RUN_DIR_FORMAT)).cast("timestamp_ntz")


def from_millis(c: Column) -> Column:
    return F.timestamp_millis(c.try_cast("bigint")).cast("timestamp_ntz")


def property_file_lines(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """(path, pos, line) of all files below a path whose names fit a pattern; ``pos`` is the order of a file's lines."""
    with few_listing_tasks(spark):
        scan = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names).text(path)
    return scan.select(files.plain_path(F.col("_metadata.file_path")).alias("path"), *_places())


def small_property_lines(spark: SparkSession, path: str, names: str = r".*") -> DataFrame:
    """(path, pos, line) of all files below a folder whose whole names fit a regular expression: many small ones, which
    tasks find and read."""
    return _lines_of(files.tree(spark, path).filter(F.element_at(F.split("path", "/"), -1).rlike(f"^(?:{names})$")), spark, path)


def _lines_of(found: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    read = files.small_file_lines(spark, path)
    return spread(found).select("path", F.posexplode(read("path")).alias("pos", "line"))


def _places() -> tuple[Column, Column]:
    """``pos``, the order of a file's lines, and ``line``."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return place.alias("pos"), F.col("value").alias("line")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(job, started, ended, succeeded, log) from the run directories ``<path>/<job>/<time>/``.

    A filter on ``job`` reaches the scans, which then open the files of that job only.
    """
    found = files.tree(spark, path)
    named = found.filter(F.element_at(F.split("path", "/"), -1) == fixed.RUN_PROPERTIES_FILE)
    return runs_of_files(found, _lines_of(named, spark, path).select("path", "line"))


def runs_of_files(found: DataFrame, lines: DataFrame) -> DataFrame:
    """The same out of a listing ``found(path)`` and the ``lines(path, line)`` of the properties files.

    Hidden and unparsable directories are skipped. A run without its properties file has started at the time
    in its directory's name, has no end and no success; it is found by its other files, such as its log.
    """
    parts = F.split("path", "/")
    job, folder = F.element_at(parts, -3).alias("job"), F.element_at(parts, -2).alias("dir")
    runs = (found.select(job, folder).distinct().withColumn("dir_time", run_directory_time("dir"))
            .filter(F.col("dir_time").isNotNull()))

    def entry(name: str) -> Column:
        return F.max(F.when(F.col("key") == name, F.col("value"))).alias(f"_{name}")

    values = property_lines(lines).groupBy(job, folder).agg(entry("start"), entry("end"), entry("succeeded"))
    log = F.concat_ws("/", "job", "dir", F.concat_ws(".", "job", "dir", F.lit("log")))
    return (runs.join(values, ["job", "dir"], "left")
            .select("job", F.coalesce(from_millis(F.col("_start")), "dir_time").alias("started"),
                    from_millis(F.col("_end")).alias("ended"),
                    F.coalesce(F.lower(F.trim("_succeeded")) == "true", F.lit(False)).alias("succeeded"),
                    log.alias("log")))


def parse_flows(documents: DataFrame, column: str = "document") -> DataFrame:
    """(id, jobs, root, dependencies, parent_props) out of execution documents."""
    doc = F.from_json(column, FLOW_SCHEMA)
    return (documents.select(doc.alias("_d"))
            .select(F.col("_d.flow.id").alias("id"), F.col("_d.flow.jobs").alias("jobs"),
                    F.col("_d.flow.root").alias("root"), F.col("_d.flow.dependencies").alias("dependencies"),
                    F.col("_d.parentProps").alias("parent_props")))


def read_flows(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """One document per file ``<id>.json``, or one per line of such files; other files are not read."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=one_per_file)
    return parse_flows(files.withColumnRenamed("value", "document"))


def read_job_definitions(spark: SparkSession, path: str) -> DataFrame:
    """(scope, parent, kind, key, value, name) from a tree of job and config files."""
    return definitions_of_lines(small_property_lines(spark, path), files.root_of(spark, path))


def definitions_of_lines(lines: DataFrame, root_path: str) -> DataFrame:
    """The same out of ``lines(path, pos, line)`` of files below a root.

    A directory is a scope under the directory above; a job is a scope under its directory. Files under
    excluded or hidden names are left out. In one directory, config files later in name order win.
    """
    relative = files.below(F.col("path"), root_path.rstrip("/").split("://")[-1] + "/")
    parts = F.split(relative, "/")
    name = F.element_at(parts, -1)
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    is_job = name.endswith(fixed.JOB_SUFFIX)
    is_config = F.lit(False)
    for suffix in fixed.CONFIG_SUFFIXES:
        is_config = is_config | name.endswith(suffix)
    hidden = F.exists(parts, lambda p: p.isin(*fixed.SKIPPED_NAMES) | p.startswith("."))
    job = F.substr(name, F.lit(1), F.length(name) - len(fixed.JOB_SUFFIX))
    upper = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), "/")
    tagged = (logical_lines(lines.filter(~hidden & (is_job | is_config)))
              .withColumn("scope", F.when(is_job, F.concat(F.lit("job:"), relative)).otherwise(F.concat(F.lit("dir:"), folder)))
              .withColumn("parent", F.when(is_job, F.concat(F.lit("dir:"), folder))
                          .when(F.size(parts) > 1, F.concat(F.lit("dir:"), upper)))
              .withColumn("kind", F.when(is_job, F.lit("job")).otherwise(F.lit("config")))
              .withColumn("name", F.when(is_job, job)))
    pairs = property_lines(tagged)
    return (pairs.groupBy("scope", "key")
            .agg(F.max_by(F.struct("parent", "kind", "value", "name"), F.struct("path", "pos")).alias("_r"))
            .select("scope", F.col("_r.parent").alias("parent"), F.col("_r.kind").alias("kind"), "key",
                    F.col("_r.value").alias("value"), F.col("_r.name").alias("name")))


def duplicate_definitions(definitions: DataFrame) -> DataFrame:
    """Job names defined in more than one place."""
    return (definitions.filter("kind = 'job'").select("name", "scope").distinct()
            .groupBy("name").agg(F.count(F.lit(1)).alias("places")).filter("places > 1"))


def parse_schedules(lines: DataFrame, now: Column, key: str = "key", value: str = "value") -> DataFrame:
    """(name, start, period, ignore_dep, problem) out of ``name=<time> <period> <bool>`` entries.

    The start is moved forward by whole periods to ``now``. Entries without exactly three pieces are dropped, and
    so are those without a period whose time is past. ``problem`` is ``time`` or ``period`` where that piece can't
    be read, else null; such an entry stays as it is.
    """
    pieces = F.split(F.col(value), r"\s+", -1)
    start = F.try_to_timestamp(F.get(pieces, F.lit(0)), F.lit(fixed.SCHEDULE_FORMAT)).cast("timestamp_ntz")
    period = F.get(pieces, F.lit(1))
    readable = (period == "n") | times.parse_period(period, strict=False).isNotNull()
    problem = F.when(start.isNull(), "time").when(~readable, "period")
    parsed = (lines.filter(F.size(pieces) == 3)
              .select(F.col(key).alias("name"), start.alias("start"), period.alias("period"),
                      (F.lower(F.get(pieces, F.lit(2))) == "true").alias("ignore_dep"), problem.alias("problem")))
    step = times.parse_period("period", strict=False)
    return (parsed.filter(F.col("problem").isNotNull() | step.isNotNull() | (F.col("start") > now))
            .withColumn("start", F.when(F.col("problem").isNotNull(), F.col("start"))
                        .otherwise(times.next_run("start", step, now))))


def parse_log_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ts, logger, level and message of log lines in the fixed layout; null where a line does not fit it."""
    def piece(i: int) -> Column:
        return F.nullif(F.regexp_extract(line, fixed.LOG_LINE_PATTERN, i), F.lit(""))

    return (lines.withColumn("ts", F.try_to_timestamp(piece(1), F.lit(fixed.LOG_TIME_FORMAT)).cast("timestamp_ntz"))
            .withColumn("logger", piece(2)).withColumn("level", piece(3)).withColumn("message", piece(4)))


def parse_child_lines(lines: DataFrame, line: str = "line", default: str = "INFO") -> DataFrame:
    """Add level and message of lines that a child process printed."""
    return lines.select("*", *level_and_message(line, default))


def config_lines(entries: DataFrame) -> DataFrame:
    """(scope, key, line): entries as lines ``key=value`` of a properties file, with escapes. Effective entries give a
    flattened file, local entries a local one."""
    return entries.select("scope", "key", F.concat(escaped(F.col("key"), True), F.lit("="), escaped(
        F.coalesce("value", F.lit("")), False)).alias("line"))


def write_config(entries: DataFrame, path: str, mode: str = "error") -> None:
    """One properties file for each scope, its entries in the order of their keys, in a folder ``scope=<name>``.

    Tasks write the files, as ``files.write_named`` does, so no list of scopes is kept and nothing is renamed at the end;
    ``mode`` is that of Spark's writers.
    """
    lines = config_lines(entries)
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.repartition(tasks, "scope").sortWithinPartitions("scope", "key").select(
        F.coalesce(_folder_name(F.nullif("scope", F.lit(""))), F.lit(NO_SCOPE)).alias("scope"), "line")
    if files.ready_for(entries.sparkSession, path, mode):
        files.write_runs(rows, path, "scope", "line")


#: What Spark names the folder of a null.
NO_SCOPE = "__HIVE_DEFAULT_PARTITION__"


def _folder_name(c: Column) -> Column:
    """A name as Spark puts it into that of a folder: signs with a meaning there by their code."""
    signs = F.regexp_extract_all(c, F.lit(r"(?s)(.)"), F.lit(1))
    special = r"""^[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]$"""
    return F.array_join(F.transform(signs, lambda x: F.when(
        x.rlike(special), F.concat(F.lit("%"), F.lpad(F.hex(F.encode(x, "UTF-8")), 2, "0"))).otherwise(x)), "")


def config_file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, scope, pos, line) of the files that ``write_config`` writes."""
    return small_property_lines(spark, path).withColumn("scope", _scope_of("path"))


def _scope_of(path: str) -> Column:
    return F.nullif(files.plain_path(F.regexp_extract(path, "/scope=([^/]*)/[^/]*$", 1)), F.lit(NO_SCOPE))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """(scope, key, value) of such files; of lines with one key the last counts."""
    entries = property_lines(logical_lines(small_property_lines(spark, path))).groupBy("path", "key").agg(
        F.max_by("value", "pos").alias("value"))
    return entries.select(_scope_of("path").alias("scope"), "key", "value")


def read_schedules(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """(name, start, period, ignore_dep, problem) of the entries of schedule files."""
    return parse_schedules(property_lines(logical_lines(small_property_lines(spark, path))), now)


def read_logs(spark: SparkSession, path: str, names: str = "*.log") -> DataFrame:
    """(path, pos, line, ts, logger, level, message) of all lines of the log files below a path."""
    return parse_log_lines(property_file_lines(spark, path, names))


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """(job, key, value) of the output files below a path: a document a file, named after its job."""
    read = files.small_file_lines(spark, path, whole=True)
    name = F.element_at(F.split("path", "/"), -1)
    return output_entries(spread(files.tree(spark, path)).select(F.regexp_replace(name, r"\.[^.]*$", "").alias("job"),
                                                                 F.explode(read("path")).alias("document")))


def output_entries(documents: DataFrame, job: str = "job", document: str = "document") -> DataFrame:
    """(job, key, value) out of the output document of each job."""
    return documents.select(F.col(job).alias("job"), F.explode(json_text.output_pairs(document)).alias("key", "value"))
