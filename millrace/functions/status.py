"""State labels and the two-stage state table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace import fixed_values as fixed
from millrace.functions.text import _col


def label(c: Column | str) -> Column:
    """Display label of a state: lower case, ``disabled`` for IGNORED, ``normal`` for anything unknown."""
    s = _col(c)
    return (F.when(s == "IGNORED", F.lit("disabled"))
            .when(s.isin(*fixed.STATUSES), F.lower(s)).otherwise(F.lit("normal")))


def after_restart(c: Column | str) -> Column:
    """State of a saved execution once it is loaded again: what was running has to run again."""
    s = _col(c)
    return F.when(s == "RUNNING", F.lit("READY")).otherwise(s)


def is_done(c: Column | str, ignored_counts: bool = False) -> Column:
    names = ["SUCCEEDED", "COMPLETED"] + (["IGNORED"] if ignored_counts else [])
    return _col(c).isin(*names)


def composed(job: Column | str, before: Column | str) -> Column:
    """State of a job taken together with what has to run before it."""
    job, before = _col(job), _col(before)
    waiting = job.isin("IGNORED", "READY")
    return (F.when(~waiting, job)
            .when(before.isin("RUNNING", "FAILED"), before)
            .otherwise(F.lit("READY")))


def composed_start(job, before, job_start, before_start) -> Column:
    """Start of the pair: that of the first stage, else that of the job; none while nothing has begun."""
    waiting = _col(job).isin("IGNORED", "READY")
    idle = waiting & _col(before).isin("IGNORED", "READY")
    return (F.when(idle, F.lit(None)).when(waiting, _col(before_start))
            .otherwise(F.coalesce(_col(before_start), _col(job_start))))


def composed_end(job, before, job_end, before_end) -> Column:
    """End of the pair: set only once the pair has ended, by its failed first stage or by its job."""
    waiting = _col(job).isin("IGNORED", "READY")
    return (F.when(waiting & (_col(before) == "FAILED"), _col(before_end))
            .when(_col(job).isin("COMPLETED", "SUCCEEDED", "FAILED"), _col(job_end)))
