"""Queries over run records ``runs(job, started, ended, succeeded)`` and schedules ``(name, start, period)``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import fixed_values as fixed
from millrace.functions import times
from millrace.operators import ordering
from millrace.operators.joins import equal_keys
from millrace.session import spread

BLANK = "–"


def _newest(runs: DataFrame) -> list[Column]:
    """Newest first; of runs of one time, those of the first job, then by whatever else tells them apart."""
    rest = [F.col(c).desc_nulls_last() for c in ("log", "run", "id", "ended", "succeeded") if c in runs.columns]
    return [F.col("started").desc_nulls_last(), F.col("job").asc(), *rest]


def recent_runs(runs: DataFrame, count: int) -> DataFrame:
    """The newest ``count`` runs over all jobs."""
    # No job can bring more than `count` rows to the result, so the overall top rows are all it takes.
    return ordering.top_overall(runs, _newest(runs), count)


def runs_of_each_job(runs: DataFrame, count: int) -> DataFrame:
    """The newest ``count`` runs of every job, numbered from 1."""
    return ordering.top_per_key(runs, ["job"], _newest(runs), count)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The most recent run of each job."""
    return runs_of_each_job(runs, 1).drop("rank")


def success_stats(runs: DataFrame) -> DataFrame:
    """(job, runs, successes)."""
    return runs.groupBy("job").agg(F.count(F.lit(1)).alias("runs"), F.count_if("succeeded").alias("successes"))


def runtime_series(runs: DataFrame) -> DataFrame:
    """(job, day, minutes, started) of successful runs, for jobs with more than one of them, oldest first."""
    good = runs.filter("succeeded")
    enough = good.groupBy("job").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("job")
    return (good.join(enough, "job", "left_semi")
            .select("job", F.to_date("started").alias("day"),
                    times.minutes_between("started", "ended").alias("minutes"), "started")
            .orderBy("job", "started"))


def elapsed_rows(runs: DataFrame) -> DataFrame:
    """History rows as shown: start, end, elapsed and outcome as texts, dashes for what is not known yet."""
    def shown(value: Column) -> Column:
        return F.coalesce(value, F.lit(BLANK))

    return runs.select(
        "job", shown(times.format_time("started")).alias("started"), shown(times.format_time("ended")).alias("ended"),
        shown(times.format_between("started", "ended")).alias("elapsed"),
        F.when(F.col("ended").isNull(), F.lit(BLANK)).when(F.col("succeeded"), F.lit("yes"))
        .otherwise(F.lit("no")).alias("success"))


def elapsed_so_far(runs: DataFrame, now: Column) -> DataFrame:
    """Run time to the end, or to ``now`` where there is none yet."""
    return runs.withColumn("elapsed", times.format_between("started", F.coalesce("ended", now)))


def max_execution_id(names: DataFrame, name: str = "name") -> DataFrame:
    """The greatest number among file names ``<number>.json``; 0 if there is none."""
    number = F.nullif(F.regexp_extract(name, r"^([+-]?[0-9]+)\.json$", 1), F.lit("")).try_cast("bigint")
    return names.agg(F.greatest(F.coalesce(F.max(number), F.lit(0)), F.lit(0)).alias("max_id"))


def with_jobs(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each run with the description of its job; a run of a job that is gone keeps nulls."""
    return runs.join(jobs, "job", "left")


def failed_with_tail(failed: DataFrame, runs: DataFrame, logs: DataFrame, lines: int = fixed.TAIL_LINES) -> DataFrame:
    """(job, started, rank, line): the last log lines of the latest run of each failed job.

    ``failed(job)``; ``logs(log, pos, line)``, where ``log`` names the log of a run.
    """
    latest = latest_runs(runs.join(failed.select("job").distinct(), "job", "left_semi"))
    wanted = latest.select("job", "started", "log")
    mine = logs.join(wanted.select("log").distinct(), "log", "left_semi")
    tails = ordering.tail_lines(mine, lines, source="log")
    return wanted.join(tails, "log", "left").select("job", "started", "log", "rank", "line")


def fail_report(errors: DataFrame, runs: DataFrame, logs: DataFrame, url: str,
                lines: int = fixed.TAIL_LINES) -> DataFrame:
    """(flow, number, job, text): one piece of report per failed job of a failed flow, numbered by name.

    ``errors(flow, job, error)``. A text holds at most ``lines`` log lines; pieces in order make up a report.
    """
    tails = failed_with_tail(errors, runs, logs, lines)
    # Grouped are at most `lines` lines of one job.
    told = F.concat("line", F.lit("\n"))
    logged = (tails.groupBy("job").agg(
        F.max("log").alias("log"), F.lit(True).alias("has_run"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", told.alias("line")))), lambda x: x["line"]), "")
        .alias("tail")))
    numbered = number_in_flow(errors)
    head = _filled(fixed.REPORT_JOB, number=F.col("number").cast("string"), job=F.col("job"), error=F.col("error"))
    no_run = F.when(F.col("has_run").isNull(), _filled(fixed.REPORT_NO_RUN, job=F.col("job"))).otherwise(F.lit(""))
    log = F.when(F.col("log").isNull(), F.lit(fixed.REPORT_NO_LOG)).otherwise(F.concat(
        _filled(fixed.REPORT_LOG, url=F.lit(url), log=F.col("log"), lines=F.lit(str(lines))), F.coalesce("tail", F.lit(""))))
    return numbered.join(logged, "job", "left").select("flow", "number", "job", F.concat(head, no_run, log).alias("text"))


def _filled(wording: str, **values: Column) -> Column:
    """A wording with its ``{name}`` places filled in."""
    pieces = re.split(r"\{(\w+)\}", wording)
    return F.concat(*[values[p] if n % 2 else F.lit(p) for n, p in enumerate(pieces)])


def number_in_flow(errors: DataFrame) -> DataFrame:
    """Number the errors of each flow from 1 by job name."""
    return ordering.ranked(errors, ["flow"], ["job"], "number")


def next_runs(schedules: DataFrame, now: Column) -> DataFrame:
    """Add ``next_run``. ``period`` is the text of a period."""
    return schedules.withColumn("next_run", times.next_run("start", times.parse_period("period"), now))


def next_runs_of_partial(schedules: DataFrame, now: Column) -> DataFrame:
    """Add ``next_run`` for schedules that give only a time of day (``at``, a text HH:mm:ss)."""
    today = F.concat(F.date_format(now, "yyyy-MM-dd"), F.lit(" "), F.col("at")).cast("timestamp_ntz")
    period = times.parse_period("period")
    once = F.when(today < now, F.timestamp_add("DAY", F.lit(1), today)).otherwise(today)
    return schedules.withColumn("next_run", F.when(period.isNull(), once)
                                .otherwise(times.next_run(today, period, now)))


def upcoming(schedules: DataFrame, until: Column) -> DataFrame:
    """(name, run): every occurrence from the start up to ``until``; one without a period occurs once."""
    seconds = times.period_seconds(times.parse_period("period"))
    span = F.call_function("div", times.micros_between("start", until), F.lit(1_000_000))
    steps = F.when(seconds.isNull(), F.lit(0)).otherwise(F.call_function("div", span, seconds))
    # Few bytes of schedules become many runs, so they are dealt out by number: a table of one row group has one reader.
    return (spread(schedules.filter(F.col("start") <= until))
            .select("name", "start", F.coalesce(seconds, F.lit(0)).alias("_seconds"),
                    F.explode(F.sequence(F.lit(0).cast("bigint"), steps.cast("bigint"))).alias("_k"))
            .select("name", F.timestamp_add("SECOND", F.col("_k") * F.col("_seconds"), F.col("start")).alias("run")))


def late(schedules: DataFrame, now: Column) -> DataFrame:
    """Add ``late`` and ``run_at``: what is due more than a second ago starts now, other times stay."""
    behind = times.micros_between("start", now)
    is_late = behind > fixed.LATE_AFTER_SECONDS * 1_000_000
    return (schedules.withColumn("late", is_late)
            .withColumn("run_at", F.when(is_late, now).otherwise(F.col("start"))))


def activity(schedules: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """(kind, name, time, detail, period): what is scheduled and what is running, as shown."""
    period = F.coalesce(times.format_period(times.parse_period("period")), F.lit("-"))
    planned = schedules.select(F.lit("scheduled").alias("kind"), "name", times.format_time("start").alias("time"),
                               F.lit("").alias("detail"), period.alias("period"))
    open_runs = runs.filter("ended IS NULL").alias("r")
    plans = schedules.select(F.col("name").alias("job"), "period").alias("s")
    running = (open_runs.join(plans, equal_keys("r", "s", ["job"], False), "left")
               .select(F.lit("executing").alias("kind"), F.col("r.job").alias("name"),
                       times.format_time("started").alias("time"),
                       F.concat(times.format_between("started", now), F.lit(" ago")).alias("detail"),
                       period.alias("period")))
    return planned.unionByName(running)
