"""Grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.functions import numbers
from millrace.operators import config as cfg
from millrace.operators import graph, groups, history, status
from millrace.plans import phrases, words


@query("group_fold", """
    SELECT l_suppkey, min(l_linenumber) AS lowest, max(l_returnflag) AS flag, CAST(count(*) AS BIGINT) AS n
    FROM lineitem GROUP BY l_suppkey""")
def group_fold(t):
    return groups.group_fold(t.lineitem, ["l_suppkey"], [
        ("lowest", F.col("l_linenumber"), "min", "int"), ("flag", F.col("l_returnflag"), "max", "string"),
        ("n", F.lit(1), "+", "bigint")])


@query("group_combine", """
    SELECT l_returnflag, l_linestatus, CAST(count(*) AS INTEGER) AS items, round(sum(l_quantity), 2) AS quantity,
           round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
    FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def group_combine(t):
    out = groups.group_fold(t.lineitem, ["l_returnflag", "l_linestatus"], [
        ("items", F.lit(1), "+", "int"), ("quantity", F.col("l_quantity"), "+", "double"),
        ("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")), "+", "double")])
    return out.withColumn("quantity", F.round("quantity", 2)).withColumn("revenue", F.round("revenue", 4))


@query("group_no_combine", """
    SELECT o_custkey, CAST(count(*) AS INTEGER) AS orders, max(o_orderdate) AS latest FROM orders GROUP BY o_custkey""")
def group_no_combine(t):
    return groups.group_no_combine(t.orders, ["o_custkey"], [
        ("orders", F.lit(1), "+", "int"), ("latest", F.col("o_orderdate"), "max", "timestamp_ntz")])


@query("combine_partial", """
    SELECT l_suppkey, bit_xor(l_partkey) AS mixed FROM lineitem GROUP BY l_suppkey""")
def combine_partial(t):
    keyed = t.lineitem.select("l_suppkey", F.col("l_partkey").alias("mixed"))
    return groups.merge_by_key(keyed, ["l_suppkey"], groups.pairwise(["l_suppkey"], {"mixed": np.bitwise_xor}))


@query("reduce_group", """
    SELECT user_id, unnest(['least', 'greatest']) AS name, unnest([min(value), max(value)]) AS value
    FROM events GROUP BY user_id HAVING count(*) > 1""")
def reduce_group(t):
    def start(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.groupby("user_id", as_index=False, dropna=False).agg(n=("value", "size"), low=("value", "min"), high=("value", "max"))

    def merge(states: pd.DataFrame) -> pd.DataFrame:
        return states.groupby("user_id", as_index=False, dropna=False).agg({"n": "sum", "low": "min", "high": "max"})

    def finish(states: pd.DataFrame) -> pd.DataFrame:
        kept = states[states["n"] > 1].rename(columns={"low": "least", "high": "greatest"})
        return kept.melt(id_vars="user_id", value_vars=["least", "greatest"], var_name="name", value_name="value")

    return groups.reduce_groups(t.events.select("user_id", "value"), ["user_id"], start,
                                "user_id bigint, n bigint, low double, high double", merge, finish,
                                "user_id bigint, name string, value double")


GAP = 6 * 3600 * 1_000_000


def _sessions(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every stretch of a user's events without a gap above the limit, in microseconds."""
    number, began, last, n = 0, None, None, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"user_id": [key[0]], "session": [number], "began": [began], "ended": [last], "events": [n]})

    for batch in batches:
        at = batch.column("micros").to_numpy()
        cuts = {*np.flatnonzero(np.diff(at, prepend=at[0] if last is None else last) > GAP).tolist()}
        starts = sorted({0, *cuts})
        for a, b in zip(starts, [*starts[1:], len(at)]):
            if last is None or a in cuts:
                if last is not None:
                    yield row()
                number, began, n = number + 1, int(at[a]), 0
            last, n = int(at[b - 1]), n + b - a
    if last is not None:
        yield row()


@query("reduce_ordered", """
    WITH marked AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 6 HOUR, false) AS new FROM events
                    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (SELECT *, 1 + sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                                               ROWS UNBOUNDED PRECEDING) AS session FROM marked)
    SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS began, max(ts) AS ended, count(*) AS events
    FROM numbered GROUP BY user_id, session""")
def reduce_ordered(t):
    """Sessions: a gap above six hours between a user's events begins a new one."""
    events = t.events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    out = groups.reduce_ordered(events, ["user_id"], ["micros", "event_id"], _sessions,
                                "user_id bigint, session bigint, began bigint, ended bigint, events bigint")
    return out.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("began", "ended")})


@query("shuffle_identity", "SELECT user_id, event_id, event_type FROM events")
def shuffle_identity(t):
    return groups.grouped_order(t.events.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("sum_of_squares", """
    SELECT l_orderkey, CAST(sum(l_linenumber * l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey""")
def sum_of_squares(t):
    return groups.group_fold(t.lineitem, ["l_orderkey"], [
        ("total", F.col("l_linenumber") * F.col("l_linenumber"), "+", "bigint")])


@query("friends_by_profile", """
    SELECT profile_id, num_friends, (place - 1) // 1000 AS piece, string_agg(c_name, '' ORDER BY place) AS friends_names_mashed
    FROM (SELECT c_nationkey AS profile_id, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS place,
                 CAST(count(*) OVER (PARTITION BY c_nationkey) AS INTEGER) AS num_friends
          FROM customer WHERE c_mktsegment <> 'MACHINERY') GROUP BY ALL""")
def friends_by_profile(t):
    friends = t.customer.filter("c_mktsegment <> 'MACHINERY'").select(
        F.col("c_nationkey").alias("profile_id"), "c_custkey", "c_name")
    counts = groups.group_fold(friends, ["profile_id"], [("num_friends", F.lit(1), "+", "int")])
    # At most a thousand names are gathered at a time.
    names = (groups.in_pieces(friends, ["profile_id"], ["c_name", "c_custkey"], 1000).groupBy("profile_id", "piece")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "c_name"))).alias("names")))
    mashed = F.array_join(F.transform("names", lambda x: x["c_name"]), "")
    return counts.join(names, "profile_id").select("profile_id", "num_friends", "piece", mashed.alias("friends_names_mashed"))


@query("word_count", r"""
    SELECT word, CAST(count(*) AS BIGINT) AS "count"
    FROM (SELECT unnest(string_split_regex(text, '[ \t\n\r\f]+')) AS word FROM documents) WHERE word <> '' GROUP BY word""")
def word_count(t):
    return words.word_count(t.documents, "text")


@query("group_status", """
    SELECT flow, status, start_time, CASE WHEN status IN ('FAILED', 'SUCCEEDED') THEN e END AS end_time FROM (
      SELECT flow, CASE WHEN bool_or(status = 'FAILED') THEN 'FAILED'
                        WHEN bool_and(status IN ('SUCCEEDED', 'COMPLETED')) THEN 'SUCCEEDED'
                        WHEN bool_and(status = 'RUNNING') THEN 'RUNNING' ELSE 'READY' END AS status,
             min(start_time) AS start_time, max(end_time) AS e FROM node_status GROUP BY flow)""", ("node_status",))
def group_status(t):
    return status.group_status(t.node_status, ["flow"])


@query("composed_status", """
    SELECT e.job, e.dep, CASE WHEN j.status NOT IN ('READY', 'IGNORED') THEN j.status
                WHEN b.status IN ('RUNNING', 'FAILED') THEN b.status ELSE 'READY' END AS status,
           CASE WHEN j.status NOT IN ('READY', 'IGNORED') THEN coalesce(b.start_time, j.start_time)
                WHEN b.status NOT IN ('READY', 'IGNORED') THEN b.start_time END AS start_time,
           CASE WHEN j.status IN ('SUCCEEDED', 'COMPLETED', 'FAILED') THEN j.end_time
                WHEN j.status IN ('READY', 'IGNORED') AND b.status = 'FAILED' THEN b.end_time END AS end_time
    FROM edges e JOIN node_status j ON j.job = e.job JOIN node_status b ON b.job = e.dep""", ("edges", "node_status"))
def composed_status(t):
    s = t.node_status
    job = s.select("job", F.col("status").alias("job_status"), F.col("start_time").alias("job_start"),
                   F.col("end_time").alias("job_end"))
    before = s.select(F.col("job").alias("dep"), F.col("status").alias("before_status"),
                      F.col("start_time").alias("before_start"), F.col("end_time").alias("before_end"))
    return (status.composed_status(t.edges.join(job, "job").join(before, "dep"))
            .select("job", "dep", "status", "start_time", "end_time"))


@query("merge_return_props", """
    SELECT flow, key, arg_max(value, p_partkey) AS value FROM (
      SELECT p_partkey // 3 AS flow, p_partkey, unnest(['brand', 'type', 'own' || p_partkey % 3]) AS key,
             unnest([p_brand, p_type, p_name]) AS value FROM part) GROUP BY flow, key""")
def merge_return_props(t):
    k = F.col("p_partkey")
    returned = t.part.select(F.expr("p_partkey div 3").alias("flow"), k.alias("position"), F.explode(F.array(
        F.struct(F.lit("brand").alias("key"), F.col("p_brand").alias("value")),
        F.struct(F.lit("type").alias("key"), F.col("p_type").alias("value")),
        F.struct(F.concat(F.lit("own"), k % 3).alias("key"), F.col("p_name").alias("value")))).alias("e")) \
        .select("flow", "position", "e.*")
    return groups.last_wins(returned, ["flow", "key"], "position").drop("position")


@query("merge_exceptions", """
    SELECT flow, job, arg_max(error, event_id) AS error FROM (
      SELECT event_id % 50 AS flow, 'job' || user_id AS job, event_id, props AS error FROM events WHERE event_type = 'error')
    GROUP BY flow, job""")
def merge_exceptions(t):
    errors = t.events.filter("event_type = 'error'").select(
        (F.col("event_id") % 50).alias("flow"), F.concat(F.lit("job"), "user_id").alias("job"), "event_id",
        F.col("props").alias("error"))
    return groups.last_wins(errors, ["flow", "job"], "event_id").drop("event_id")


@query("merge_first_wins", """
    SELECT j.flow, j.job, j.state, d.dep
    FROM (SELECT flow, job, arg_min(state, position) AS state FROM (
            SELECT o_custkey AS flow, o_orderpriority AS job, o_orderstatus AS state, o_orderkey AS position FROM orders)
          GROUP BY flow, job) j
    JOIN (SELECT DISTINCT o_custkey AS flow, o_orderpriority AS job, o_orderstatus AS dep FROM orders) d
      ON d.flow = j.flow AND d.job = j.job""")
def merge_first_wins(t):
    children = t.orders.select(F.col("o_custkey").alias("flow"), F.col("o_orderpriority").alias("job"),
                               F.col("o_orderstatus").alias("state"), F.col("o_orderkey").alias("position"))
    jobs = groups.first_wins(children, ["flow", "job"], "position").drop("position")
    # The union of dependency sets, one row per member; sorted when shown.
    dependencies = children.select("flow", "job", F.col("state").alias("dep")).distinct()
    return jobs.join(dependencies, ["flow", "job"])


@query("distinct_rows", 'SELECT "user", hour, ngram FROM hourly', ("hourly",))
def distinct_rows(t):
    return phrases.hourly_ngrams(t.query_log)


@query("hour_frequency", 'SELECT ngram, hour, "count" FROM frequency', ("frequency",))
def hour_frequency(t):
    return phrases.hour_frequency(phrases.hourly_ngrams(t.query_log))


@query("phrase_score", 'SELECT hour, ngram, round(score, 6) AS score, "count", round(mean, 6) AS mean FROM scored', ("scored",))
def phrase_score(t):
    scores = phrases.phrase_scores(phrases.hour_frequency(phrases.hourly_ngrams(t.query_log)))
    return scores.withColumn("score", F.round("score", 6)).withColumn("mean", F.round("mean", 6))


@query("job_success_stats", """
    SELECT job, CAST(count(*) AS BIGINT) AS runs, CAST(count(*) FILTER (WHERE succeeded) AS BIGINT) AS successes
    FROM runs GROUP BY job""", ("runs",))
def job_success_stats(t):
    return history.success_stats(t.runs)


@query("max_execution_id", """
    SELECT max(CASE WHEN event_id % 9 > 1 THEN event_id END) AS max_id FROM events""")
def max_execution_id(t):
    k = F.col("event_id")
    name = F.when(k % 9 == 0, F.concat(F.lit("x"), k, F.lit(".json"))).when(k % 9 == 1, F.concat(k, F.lit(".txt"))) \
        .otherwise(F.concat(k, F.lit(".json")))
    return history.max_execution_id(t.events.select(name.alias("name")))


@query("count_distinct_keys", """
    SELECT scope, CAST(count(DISTINCT key) FILTER (WHERE depth = 0) AS BIGINT) AS local_keys,
           CAST(count(DISTINCT key) AS BIGINT) AS all_keys FROM seen GROUP BY scope""", ("seen",))
def count_distinct_keys(t):
    return cfg.key_counts(t.config, cfg.chains(t.scopes))


@query("fold_left", r"""
    SELECT doc_id, CAST(list_sum(list_transform(ws, lambda w: length(w))) AS BIGINT) AS total,
           CAST(list_max(list_transform(ws, lambda w: length(w))) AS INTEGER) AS longest
    FROM (SELECT doc_id, string_split_regex(text, '\s+') AS ws FROM documents)""")
def fold_left(t):
    sizes = F.transform(F.split("text", r"\s+"), lambda w: F.length(w))
    return t.documents.select(
        "doc_id", numbers.folded(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
        numbers.folded_from_first(sizes, lambda a, x: F.greatest(a, x)).alias("longest"))


@query("folder_listing", """
    SELECT folder, job, CAST(count(*) OVER (PARTITION BY folder) AS BIGINT) AS in_folder FROM (
      SELECT CASE WHEN p_partkey % 4 = 0 THEN 'default' ELSE p_brand END AS folder, 'p' || p_partkey AS job
      FROM part WHERE 'p' || p_partkey IN (SELECT job FROM roots))""", ("roots",))
def folder_listing(t):
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, F.lit("top")).when(k % 4 == 1, F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type")) \
        .otherwise(F.concat("p_brand", F.lit("/"), "p_type"))
    paths = t.part.select(F.concat(F.lit("p"), k).alias("job"), path.alias("path"))
    return graph.folders(graph.roots(paths, t.edges))
