"""Files: written from the provided tables, read back, and compared with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import fixed_values as fixed
from millrace.catalog.registry import query
from millrace.functions import numbers
from millrace.operators import config as cfg
from millrace.operators.rows import schema_from_text
from millrace.session import scratch_path
from millrace.sources import files, records


@query("scan_text", """
    SELECT line, count(*) AS copies, true AS in_place FROM lines GROUP BY line""", ("lines",))
def scan_text(t):
    """Lines with their offsets; in place if the lines of a file lie without a gap from its first byte to its last."""
    path = scratch_path(t.spark, "text")
    t.lines.select("line").write.text(path)
    lines = files.read_text(t.spark, path, offsets=True)
    size = F.octet_length("line") + 1
    found = lines.groupBy("source").agg(F.min("offset").alias("first"), F.max(F.col("offset") + size).alias("end"),
                                        F.sum(size).alias("total"), F.count_distinct("offset").alias("places"),
                                        F.count(F.lit(1)).alias("n"))
    whole = (found.join(files.list_files(t.spark, path), F.regexp_extract("source", "[^/]+$", 0) == F.regexp_extract("path", "[^/]+$", 0))
             .filter("first = 0 AND end = length AND total = length AND places = n").select("source"))
    return (lines.join(whole.withColumn("whole", F.lit(True)), "source", "left").groupBy("line")
            .agg(F.count(F.lit(1)).alias("copies"), F.every(F.coalesce("whole", F.lit(False))).alias("in_place")))


@query("sink_text", "SELECT c_custkey || chr(9) || c_name AS line FROM customer")
def sink_text(t):
    path = scratch_path(t.spark, "text")
    files.write_text(t.customer, path, "c_custkey", "c_name")
    return files.read_text(t.spark, path)


@query("scan_records", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_records(t):
    old, new = scratch_path(t.spark, "old"), scratch_path(t.spark, "new")
    columns = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    split = F.lit("1998-01-01").cast("timestamp_ntz")
    columns.filter(F.col("o_orderdate") < split).write.parquet(old)
    columns.filter(F.col("o_orderdate") >= split).write.parquet(new)
    return files.read_records(t.spark, f"{old},{new}").drop("o_orderdate")


@query("sink_records", """SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_quantity AS INTEGER) AS l_quantity
                          FROM lineitem""")
def sink_records(t):
    schema = schema_from_text("{'l_orderkey':'int64', 'l_linenumber':'int32', 'l_returnflag':'string', 'l_quantity':'int32'}")
    path = scratch_path(t.spark, "records")
    files.write_records(t.lineitem.select(*schema.names), path, schema)
    return files.read_records(t.spark, path)


@query("schema_of", """
    SELECT ordinal_position - 1 AS position, column_name AS name,
           CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
                WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS type
    FROM information_schema.columns WHERE table_name = 'orders'""")
def schema_of(t):
    return files.schema_of(t.spark, t.path("orders"))


@query("scan_recursive", "SELECT c_custkey, c_name FROM customer")
def scan_recursive(t):
    path = scratch_path(t.spark, "nested")
    t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey").write.partitionBy(
        "c_mktsegment", "c_nationkey").parquet(path)
    return files.read_records(t.spark, path, recursive=True)


@query("latest_snapshot", """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)""")
def latest_snapshot(t):
    path = scratch_path(t.spark, "snapshots")
    t.orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("dt")).write.partitionBy("dt").parquet(path)
    return files.read_records(t.spark, path + fixed.LATEST_MARKER)


@query("scan_tagged_union", """
    SELECT 0 AS index, o_custkey AS custkey, o_totalprice AS price, CAST(NULL AS VARCHAR) AS name FROM orders
    UNION ALL SELECT 1, c_custkey, NULL, c_name FROM customer""")
def scan_tagged_union(t):
    orders = t.orders.select(F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("price"))
    customers = t.customer.select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"))
    return files.tagged_union([orders, customers])


@query("staged_overwrite", "SELECT p_partkey, p_name FROM part")
def staged_overwrite(t):
    target, staging = scratch_path(t.spark, "target"), scratch_path(t.spark, "staging")
    files.staged_overwrite(t.part.select("p_partkey"), target, staging, "parts")
    files.staged_overwrite(t.part.select("p_partkey", "p_name"), target, staging, "parts")
    return files.read_records(t.spark, target)


@query("scan_pairs_lazy", "SELECT c_custkey AS key, c_name AS value FROM customer")
def scan_pairs_lazy(t):
    path = scratch_path(t.spark, "pairs")
    files.write_pairs(t.customer, path, "c_custkey", "c_name")
    return files.read_pairs(t.spark, path, "key bigint, value string")


@query("scan_delimited", 'SELECT "user", "time", query FROM query_log', ("query_log",))
def scan_delimited(t):
    path = scratch_path(t.spark, "log")
    files.write_delimited(t.query_log, path, compression="bzip2")
    return files.read_delimited(t.spark, path, "user string, time string, query string")


@query("sink_delimited", "SELECT hour || chr(9) || ngram || chr(9) || \"count\" AS line FROM frequency", ("frequency",))
def sink_delimited(t):
    from millrace.plans import phrases
    path = scratch_path(t.spark, "out")
    files.write_delimited(phrases.hour_frequency(phrases.hourly_ngrams(t.query_log)).select("hour", "ngram", "count"), path)
    return files.read_text(t.spark, path)


@query("scan_avro_as_json", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def scan_avro_as_json(t):
    # The Avro connector is a package of its own; without it the same rows pass through record files.
    format = "avro" if files.has_avro(t.spark) else "parquet"
    path = scratch_path(t.spark, "records")
    t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority").write.format(format).save(path)
    lines = files.read_as_json(t.spark, path, format)
    return lines.select(F.from_json("line", "o_orderkey bigint, o_orderstatus string, o_orderpriority string").alias("r")) \
        .select("r.*")


@query("preview_file", f"""
    SELECT row, o_orderkey FROM (SELECT row_number() OVER () AS row, o_orderkey FROM orders) WHERE row <= {fixed.PREVIEW_ROWS}""")
def preview_file(t):
    rows = files.preview(t.spark, t.path("orders"))
    return rows.select("row", F.get_json_object("line", "$.o_orderkey").cast("bigint").alias("o_orderkey"))


@query("scan_run_history", """
    SELECT job, CASE WHEN ended IS NULL THEN date_trunc('millisecond', started) ELSE to_ms(started) END AS started,
           to_ms(ended) AS ended, succeeded AND ended IS NOT NULL AS succeeded,
           job || '/' || dir || '/' || job || '.' || dir || '.log' AS log
    FROM (SELECT *, strftime(started, '%m-%d-%Y.%H.%M.%S.%g') AS dir FROM runs)""".replace(
        "to_ms(started)", "date_trunc('millisecond', started)").replace("to_ms(ended)", "date_trunc('millisecond', ended)"),
       ("runs",))
def scan_run_history(t):
    folder = F.concat(F.lit("file:/logs/"), "job", F.lit("/"), F.date_format("started", fixed.RUN_DIR_FORMAT), F.lit("/"))
    runs = t.runs.withColumn("folder", folder)
    logs = runs.select(F.concat("folder", F.lit("run.log")).alias("path"))
    # A run that has not ended has no properties file yet.
    props = runs.filter("ended IS NOT NULL").withColumn("path", F.concat("folder", F.lit(fixed.RUN_PROPERTIES_FILE)))

    def millis(c):
        return F.unix_millis(F.col(c).cast("timestamp")).cast("string")

    lines = props.select("path", F.explode(F.array(
        F.lit("#written at the end"), F.concat(F.lit("start="), millis("started")), F.concat(F.lit("end="), millis("ended")),
        F.concat(F.lit("succeeded="), F.col("succeeded").cast("string")))).alias("line"))
    return records.runs_of_files(logs.unionByName(props.select("path")), lines)


@query("scan_flow_json", """
    SELECT CAST(flow AS VARCHAR) AS id, job, status, strftime(start_time, '%Y-%m-%dT%H:%M:%S') AS started FROM node_status""",
       ("node_status",))
def scan_flow_json(t):
    path = scratch_path(t.spark, "executions")
    t.flow_documents.select(F.from_json("document", records.FLOW_SCHEMA).alias("d")).select("d.*").write.json(path)
    flows = records.read_flows(t.spark, path, one_per_file=False)
    return flows.select("id", F.explode("jobs").alias("job", "s")).select(
        "id", "job", F.col("s.status").alias("status"), F.col("s.startTime").alias("started"))


@query("scan_job_defs", """
    SELECT 'dir:seg' || c_mktsegment AS scope, 'dir:' AS parent, 'config' AS kind, 'zone' AS key, c_mktsegment AS value,
           CAST(NULL AS VARCHAR) AS name FROM customer GROUP BY c_mktsegment
    UNION ALL SELECT 'job:seg' || c_mktsegment || '/' || c_name || '.job', 'dir:seg' || c_mktsegment, 'job',
           unnest(['type', 'dependencies', 'the path']),
           unnest(['java', 'Customer#' || lpad(CAST(c_custkey // 2 AS VARCHAR), 9, '0') || ',seg' || c_mktsegment, 'C:\\é=1']), c_name
    FROM customer""")
def scan_job_defs(t):
    c = t.customer
    folder = F.concat(F.lit("file:/jobs/seg"), "c_mktsegment")
    before = F.concat(F.lit("Customer#"), F.lpad(F.expr("c_custkey div 2").cast("string"), 9, "0"))
    jobs = c.select(F.concat(folder, F.lit("/"), "c_name", F.lit(".job")).alias("path"), F.posexplode(F.array(
        F.lit("# a job\\"), F.lit("type=java"), F.concat(F.lit("dependencies = "), before, F.lit(",\\")),
        F.concat(F.lit("    seg"), "c_mktsegment"), F.lit(r"the\ path : C\:\\\u00e9\=1"))).alias("pos", "line"))
    config = c.select("c_mktsegment").distinct().select(
        F.concat(folder, F.lit("/common.properties")).alias("path"), F.lit(0).alias("pos"),
        F.concat(F.lit("zone="), "c_mktsegment").alias("line"))
    skipped = c.select("c_mktsegment").distinct().select(
        F.concat(folder, F.lit("/__MACOSX/x.job")).alias("path"), F.lit(0).alias("pos"), F.lit("type=none").alias("line"))
    return records.definitions_of_lines(jobs.unionByName(config).unionByName(skipped), "/jobs")


@query("scan_schedule", f"""
    SELECT name, CASE WHEN c % 11 = 0 THEN NULL WHEN c % 17 = 0 OR secs IS NULL OR start >= now_at THEN start
             ELSE start + to_seconds(CAST(ceil((epoch(now_at) - epoch(start)) / secs) AS BIGINT) * secs) END AS start,
           CASE WHEN c % 17 = 0 THEN '3w' ELSE period END AS period, c % 2 = 0 AS ignore_dep,
           CASE WHEN c % 11 = 0 THEN 'time' WHEN c % 17 = 0 THEN 'period' END AS problem
    FROM (SELECT *, CAST(substr(name, 4) AS BIGINT) AS c FROM timed)
    WHERE c % 13 <> 0 AND (c % 11 = 0 OR c % 17 = 0 OR period <> 'n' OR start > now_at)""", ("timed",))
def scan_schedule(t):
    c = F.substring("name", 4, 20).cast("bigint")
    # Some entries have a time or a unit that can't be read; they are told apart, not dropped.
    start = F.when(c % 11 == 0, "tomorrow").otherwise(F.date_format("start", fixed.SCHEDULE_FORMAT))
    text = F.concat_ws(" ", start, F.when(c % 17 == 0, "3w").otherwise(F.col("period")),
                       F.when(c % 13 != 0, (c % 2 == 0).cast("string")))
    lines = t.schedules.select(F.col("name").alias("key"), text.alias("value"))
    return records.parse_schedules(lines, t.now)


@query("scan_log_lines", """
    SELECT event_id, date_trunc('second', ts) AS ts, 'job' || user_id AS logger, level,
           level || ' ' || event_type AS message, CASE WHEN event_id % 3 = 0 THEN level ELSE 'INFO' END AS child_level,
           CASE WHEN event_id % 3 = 0 THEN '' ELSE 'said ' END || event_type AS child_message
    FROM (SELECT *, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'DEBUG' END AS level FROM events)""")
def scan_log_lines(t):
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("DEBUG")
    e = t.events.withColumn("lv", level)
    line = F.concat(F.date_format("ts", fixed.LOG_TIME_FORMAT), F.lit(" job"), "user_id", F.lit(" "), "lv", F.lit(" - "),
                    "lv", F.lit(" "), "event_type")
    child = F.when(F.col("event_id") % 3 == 0, F.concat("lv", "event_type")).otherwise(F.concat(F.lit("said "), "event_type"))
    parsed = records.parse_log_lines(e.select("event_id", line.alias("line"), child.alias("child")))
    from millrace.operators.rows import level_and_message
    child_level, child_message = level_and_message("child")
    return parsed.select("event_id", "ts", "logger", "level", "message", child_level.alias("child_level"),
                         child_message.alias("child_message"))


@query("sink_config", r"SELECT scope, key || '=' || replace(value, '#', '\#') AS line FROM effective", ("effective",))
def sink_config(t):
    """The lines of the files: a number sign has a backslash before it."""
    path = scratch_path(t.spark, "config")
    records.write_config(cfg.effective(t.config, cfg.chains(t.scopes)), path)
    return records.config_file_lines(t.spark, path).select("scope", "line")


@query("scan_output_props", r"""
    SELECT CAST(event_id AS VARCHAR) AS job, 'k' AS key, regexp_extract(props, '\d+') AS value FROM events WHERE event_id % 4 > 1""")
def scan_output_props(t):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit("{oops "), "props")).otherwise(F.col("props"))
    return records.output_entries(t.events.select(F.col("event_id").cast("string").alias("job"), text.alias("document")))


@query("list_files", """
    SELECT DISTINCT 'status=' || o_orderstatus || '/' AS name, true AS is_dir, false AS sized FROM orders
    UNION ALL SELECT 'part', false, true""")
def list_files(t):
    """Folders by name and, of files, what their names begin with (Spark chooses the rest) and whether a size is shown."""
    path = scratch_path(t.spark, "listed")
    t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status")).write.partitionBy("status").parquet(path)
    t.orders.select("o_orderkey").write.mode("append").parquet(path)
    listing = files.list_directory(t.spark, path)
    return listing.select(F.when(F.col("is_dir"), F.col("name")).otherwise(F.substring("name", 1, 4)).alias("name"), "is_dir",
                          numbers.display_bytes("length").isNotNull().alias("sized")).distinct()


# Trees of files under names that need care: spaces, percent signs, plus signs, letters beyond ASCII.

def _named(c):
    return F.concat(F.lit("jöb %41+"), c.cast("string"), F.lit(" ü"))


_JOB = "'jöb %41+' || c_custkey || ' ü'"


@query("run_history_files", f"""
    SELECT job, date_trunc('millisecond', started) AS started, CASE WHEN c % 3 <> 0 THEN started + to_seconds(c) END AS ended,
           c % 3 = 1 AS succeeded, job || '/' || dir || '/' || job || '.' || dir || '.log' AS log
    FROM (SELECT *, strftime(started, '%m-%d-%Y.%H.%M.%S.%g') AS dir FROM (
      SELECT c_custkey AS c, {_JOB} AS job, TIMESTAMP '2024-01-01' + to_milliseconds(c_custkey * 1001) AS started FROM customer))""")
def run_history_files(t):
    """Run folders in a tree: every third run has no properties yet and is told by its log, folders of other names are
    no runs."""
    c = F.col("c_custkey")
    started = F.timestamp_add("MILLISECOND", c * 1001, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    runs = t.customer.select(c.alias("c"), _named(c).alias("job"), started.alias("started"))
    folder = F.concat("job", F.lit("/"), F.date_format("started", fixed.RUN_DIR_FORMAT), F.lit("/"))

    def millis(at):
        return F.unix_millis(at.cast("timestamp")).cast("string")

    props = F.concat(F.lit("#at the end\nstart="), millis(F.col("started")), F.lit("\nend : "),
                     millis(F.timestamp_add("SECOND", F.col("c"), F.col("started"))), F.lit("\nsucceeded "),
                     F.when(F.col("c") % 3 == 1, "TRUE").otherwise("false"), F.lit("\n"))
    root = scratch_path(t.spark, "runs of jobs")
    files.write_named(runs.select(F.concat(folder, F.lit("run.log")).alias("name"), F.lit("started\n").alias("text")).unionByName(
        runs.filter("c % 3 <> 0").select(F.concat(folder, F.lit(fixed.RUN_PROPERTIES_FILE)).alias("name"), props.alias("text")))
        .unionByName(runs.filter("c % 7 = 0").select(F.concat("job", F.lit("/notes/run.log")).alias("name"), F.lit("").alias("text"))),
        root)
    return records.read_runs(t.spark, root)


@query("job_definition_files", f"""
    SELECT 'dir:seg ' || c_mktsegment AS scope, 'dir:' AS parent, 'config' AS kind, 'zone' AS key, c_mktsegment || ' +%' AS value,
           CAST(NULL AS VARCHAR) AS name FROM customer GROUP BY c_mktsegment
    UNION ALL SELECT 'job:seg ' || c_mktsegment || '/' || {_JOB} || '.job', 'dir:seg ' || c_mktsegment, 'job',
           unnest(['type', 'dependencies', 'the key']), unnest(['java', 'a,b', ' C:\\é=' || c_custkey]), {_JOB}
    FROM customer""")
def job_definition_files(t):
    c = t.customer
    folder = F.concat(F.lit("seg "), "c_mktsegment", F.lit("/"))
    text = F.concat(F.lit("# a job\ntype=java\ndependencies = a,\\\n    b\nthe\\ key : \\ C:\\\\\\u00e9\\="), F.col("c_custkey").cast("string"))
    segments = c.select("c_mktsegment").distinct()
    root = scratch_path(t.spark, "jobs + more")
    files.write_named(
        c.select(F.concat(folder, _named(F.col("c_custkey")), F.lit(".job")).alias("name"), text.alias("text"))
        .unionByName(segments.select(F.concat(folder, F.lit("common.properties")).alias("name"),
                                     F.concat(F.lit("zone="), "c_mktsegment", F.lit(" +%\r\n")).alias("text")))
        .unionByName(segments.select(F.concat(folder, F.lit("__MACOSX/x.job")).alias("name"), F.lit("type=none").alias("text"))), root)
    return records.read_job_definitions(t.spark, root)


@query("config_files", """
    SELECT scope, key, value FROM effective
    UNION ALL SELECT 'é+%20 ' || n_nationkey, unnest(['a key', '=:#!', 'k\\', chr(9)]),
           unnest([' ' || n_name || ' ', 'C:\\new' || chr(10) || '#é😀', '', chr(13) || '  x']) FROM nation""", ("effective",))
def config_files(t):
    """Effective entries, and keys and values full of signs with a meaning, written as properties files and read back."""
    odd = t.nation.select(F.concat(F.lit("é+%20 "), F.col("n_nationkey").cast("string")).alias("scope"), F.explode(F.map_from_arrays(
        F.array(*map(F.lit, ("a key", "=:#!", "k\\", "\t"))),
        F.array(F.concat(F.lit(" "), "n_name", F.lit(" ")), F.lit("C:\\new\n#é😀"), F.lit(""), F.lit("\r  x")))).alias("key", "value"))
    path = scratch_path(t.spark, "config files")
    records.write_config(cfg.effective(t.config, cfg.chains(t.scopes)).unionByName(odd), path)
    return records.read_config(t.spark, path)


@query("schedule_files", f"""
    SELECT name, CASE WHEN secs IS NULL OR start >= now_at THEN start
             ELSE start + to_seconds(CAST(ceil((epoch(now_at) - epoch(start)) / secs) AS BIGINT) * secs) END AS start,
           period, true AS ignore_dep, CAST(NULL AS VARCHAR) AS problem
    FROM timed WHERE period <> 'n' OR start > now_at""", ("timed",))
def schedule_files(t):
    root = scratch_path(t.spark, "schedule of jobs")
    entry = F.concat("name", F.lit(" = "), F.date_format("start", fixed.SCHEDULE_FORMAT), F.lit(" \\\n    "), "period", F.lit(" TRUE\n"))
    files.write_named(t.schedules.select(F.concat("period", F.lit(" é/"), "name", F.lit(".schedule")).alias("name"),
                                         entry.alias("text")), root)
    return records.read_schedules(t.spark, root, t.now)


@query("log_files", """
    SELECT 'job' || user_id AS logger, date_trunc('second', ts) AS ts, 'INFO' AS level, event_type || ' ' || event_id AS message
    FROM events UNION ALL SELECT NULL, NULL, NULL, NULL FROM events WHERE event_id % 10 = 0""")
def log_files(t):
    """Log files of jobs; lines of another layout have no parts."""
    line = F.concat(F.date_format("ts", fixed.LOG_TIME_FORMAT), F.lit(" job"), F.col("user_id").cast("string"), F.lit(" INFO - "),
                    "event_type", F.lit(" "), F.col("event_id").cast("string"))
    both = F.array_compact(F.array(line, F.when(F.col("event_id") % 10 == 0, F.lit("  at some place"))))
    root = scratch_path(t.spark, "logs")
    t.events.select(F.col("event_id") % 20, F.explode(both).alias("value")).select("value").write.option("compression", "none").text(root)
    return records.read_logs(t.spark, root, "*.txt").select("logger", "ts", "level", "message")


@query("output_files", f"""
    SELECT {_JOB} AS job, unnest(['n', 'who']) AS key, unnest([CAST(c_custkey AS VARCHAR), c_name]) AS value FROM customer
    WHERE c_custkey % 4 <> 0""")
def output_files(t):
    """A document of its own for each job; some are empty or are none."""
    c = F.col("c_custkey")
    text = F.when(c % 8 == 0, "").when(c % 4 == 0, "{oops").otherwise(F.to_json(F.struct(c.alias("n"), F.col("c_name").alias("who"))))
    root = scratch_path(t.spark, "outputs")
    files.write_named(t.customer.select(F.concat(_named(c), F.lit(".json")).alias("name"), text.alias("text")), root)
    return records.read_outputs(t.spark, root)


@query("list_folders", """
    SELECT 'n ' || n_nationkey || '%/' AS name, true AS is_dir, CAST(NULL AS BIGINT) AS length FROM nation
    UNION ALL SELECT 'top é.txt', false, count(*) FROM nation""")
def list_folders(t):
    """One folder with folders in it, the empty ones too, and a file."""
    root = scratch_path(t.spark, "folders")
    folder = F.concat(F.lit("n "), F.col("n_nationkey").cast("string"), F.lit("%/"))
    files.write_named(t.nation.select(F.concat(folder, F.lit("deep/er.txt")).alias("name"), F.lit("x").alias("text")).unionByName(
        t.nation.agg(F.lit("top é.txt").alias("name"), F.repeat(F.lit("x"), F.count("*").cast("int")).alias("text"))), root)
    fs, path = files.file_system(t.spark, root)
    for status in list(fs.listStatus(path))[:3]:  # some folders lose what was in them
        if status.isDirectory():
            fs.delete(t.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "deep"), True)
    return files.list_directory(t.spark, root)
