"""Run records and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.derived import NOW
from millrace.catalog.functions import _ELAPSED
from millrace.catalog.registry import query
from millrace.operators import history

_NOW = f"TIMESTAMP '{NOW}'"


@query("run_elapsed", f"""
    SELECT job, strftime(started, '%m-%d-%Y %H:%M:%S') AS started, coalesce(strftime(ended, '%m-%d-%Y %H:%M:%S'), '–') AS ended,
           CASE WHEN ended IS NULL THEN '–' ELSE {_ELAPSED} END AS elapsed,
           CASE WHEN ended IS NULL THEN '–' WHEN succeeded THEN 'yes' ELSE 'no' END AS success
    FROM (SELECT *, (epoch_us(ended) - epoch_us(started)) // 60000000 AS m FROM runs)""", ("runs",))
def run_elapsed(t):
    return history.elapsed_rows(t.runs)


@query("flow_elapsed", f"""
    SELECT run, {_ELAPSED} AS elapsed FROM (SELECT run, (epoch_us(coalesce(ended, {_NOW})) - epoch_us(started)) // 60000000 AS m FROM runs)""",
       ("runs",))
def flow_elapsed(t):
    return history.elapsed_so_far(t.runs, t.now).select("run", "elapsed")


_NEXT = """CASE WHEN secs IS NULL OR start >= now_at THEN start
      ELSE start + to_seconds(CAST(ceil((epoch(now_at) - epoch(start)) / secs) AS BIGINT) * secs) END"""


@query("next_run", f"""
    SELECT name, start, period, {_NEXT} AS next_run FROM (
      SELECT name, start, now_at, CASE WHEN period LIKE '%s' THEN '5s' ELSE period END AS period,
             CASE WHEN period LIKE '%s' THEN 5 ELSE secs END AS secs FROM timed)""", ("timed",))
def next_run(t):
    # Every five seconds since then: many thousand steps, worked out at once.
    period = F.when(F.col("period").endswith("s"), "5s").otherwise(F.col("period"))
    return history.next_runs(t.schedules.withColumn("period", period), t.now)


@query("next_run_partial", """
    SELECT name, CASE WHEN start >= now_at THEN start WHEN secs IS NULL THEN start + INTERVAL 1 DAY
      ELSE start + to_seconds(CAST(ceil((epoch(now_at) - epoch(start)) / secs) AS BIGINT) * secs) END AS next_run
    FROM (SELECT name, secs, now_at + INTERVAL 12 HOUR AS now_at,
                 now_at + to_hours(CAST(substr(name, 4) AS BIGINT) % 24) AS start FROM timed)""", ("timed",))
def next_run_partial(t):
    hour = F.substring("name", 4, 20).cast("bigint") % 24
    at = F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00:00"))
    noon = F.timestamp_add("HOUR", F.lit(12), t.now)
    return history.next_runs_of_partial(t.schedules.select("name", "period", at.alias("at")), noon).select("name", "next_run")


@query("expand_schedule", """
    SELECT name, unnest(CASE WHEN secs IS NULL THEN [start] ELSE generate_series(start, until, to_seconds(secs)) END) AS run
    FROM (SELECT *, TIMESTAMP '2024-01-08' AS until FROM timed) WHERE start <= until""", ("timed",))
def expand_schedule(t):
    return history.upcoming(t.schedules, F.lit("2024-01-08 00:00:00").cast("timestamp_ntz"))


@query("late_schedules", f"""
    SELECT name, start < {_NOW} - INTERVAL 1 SECOND AS late,
           CASE WHEN start < {_NOW} - INTERVAL 1 SECOND THEN {_NOW} ELSE start END AS run_at FROM schedules""", ("schedules",))
def late_schedules(t):
    return history.late(t.schedules, t.now).select("name", "late", "run_at")


@query("fail_report", r"""
    WITH failures AS (SELECT DISTINCT run % 50 AS flow, unnest([job, 'never run']) AS job FROM runs WHERE NOT succeeded),
    tails AS (SELECT source, string_agg(line || chr(10), '' ORDER BY pos) AS tail FROM (
        SELECT * FROM lines WHERE length(trim(line)) > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY pos DESC) <= 60) GROUP BY source)
    SELECT flow, CAST(row_number() OVER (PARTITION BY flow ORDER BY f.job) AS BIGINT) AS number, f.job,
           ' Job ' || row_number() OVER (PARTITION BY flow ORDER BY f.job) || '. ' || f.job || ':' || chr(10) || 'failed' || chr(10)
           || coalesce('See log in http://logs/' || l.log || chr(10) || chr(10) || 'The last 60 lines in the log are:' || chr(10) || t.tail,
                       'Job execution object is null for jobId:' || f.job || chr(10) || chr(10) || 'Log path is null. ' || chr(10) || chr(10)) AS text
    FROM failures f LEFT JOIN latest l ON l.job = f.job LEFT JOIN tails t ON t.source = l.log""", ("latest", "lines"))
def fail_report(t):
    jobs = F.explode(F.array("job", F.lit("never run")))
    errors = t.runs.filter("NOT succeeded").select((F.col("run") % 50).alias("flow"), jobs.alias("job"), F.lit("failed").alias("error")).distinct()
    return history.fail_report(errors, t.runs, t.lines.withColumnRenamed("source", "log"), "http://logs/")


@query("activity_now", f"""
    WITH worded AS (SELECT name, start, CASE right(period, 1) WHEN 'n' THEN '-' WHEN 's' THEN '0 minutes'
             WHEN 'm' THEN left(period, -1) || CASE period WHEN '1m' THEN ' minute' ELSE ' minutes' END
             WHEN 'h' THEN left(period, -1) || CASE period WHEN '1h' THEN ' hour' ELSE ' hours' END || ', 0 minutes'
             ELSE left(period, -1) || CASE period WHEN '1d' THEN ' day' ELSE ' days' END || ', 0 minutes' END AS words FROM schedules)
    SELECT 'scheduled' AS kind, name, strftime(start, '%m-%d-%Y %H:%M:%S') AS "time", '' AS detail, words AS period FROM worded
    UNION ALL SELECT 'executing', job, strftime(started, '%m-%d-%Y %H:%M:%S'), {_ELAPSED} || ' ago', coalesce(words, '-')
    FROM (SELECT *, (epoch_us({_NOW}) - epoch_us(started)) // 60000000 AS m FROM runs WHERE ended IS NULL) r
    LEFT JOIN worded ON worded.name = r.job""", ("runs", "schedules"))
def activity_now(t):
    return history.activity(t.schedules, t.runs, t.now)
