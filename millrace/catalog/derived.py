"""Tables in the shapes the operators take, derived from the provided ones, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One moment that stands for now, so that results repeat.
NOW = "2024-03-01 00:00:00"


class Tables:
    """The provided tables as attributes, and tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    @property
    def now(self):
        return F.lit(NOW).cast("timestamp_ntz")

    @property
    def query_log(self) -> DataFrame:
        """(user, time, query): each document as a search, whole text, at an hour of one day."""
        return self.documents.select(
            F.col("source").alias("user"),
            F.concat(F.lit("240101"), F.lpad((F.col("doc_id") % 24).cast("string"), 2, "0"), F.lit("0000")).alias("time"),
            F.replace("text", F.lit("\n"), F.lit(" ")).alias("query"))

    @property
    def lines(self) -> DataFrame:
        """(source, pos, line): document lines as logs of 20 sources."""
        return (self.documents.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
                .select("source", (F.col("doc_id") * 1048576 + F.col("i")).alias("pos"), "line"))

    @property
    def runs(self) -> DataFrame:
        """(run, job, started, ended, succeeded, log): events as runs of one job per user."""
        millis = F.round(F.col("value") * 1000).cast("bigint")
        return self.events.select(
            F.col("event_id").alias("run"), F.concat(F.lit("job"), "user_id").alias("job"),
            F.col("ts").alias("started"),
            F.when(F.col("event_id") % 11 != 0, F.timestamp_add("MILLISECOND", millis * 60, F.col("ts"))).alias("ended"),
            (F.col("event_type") != "error").alias("succeeded"),
            F.concat(F.lit("src"), F.col("event_id") % 20).alias("log"))

    @property
    def nodes(self) -> DataFrame:
        """(job): parts as jobs."""
        return self.part.select(F.concat(F.lit("p"), "p_partkey").alias("job"))

    @property
    def edges(self) -> DataFrame:
        """(job, dep): part k needs parts k div 2 and k div 3; no cycles."""
        k = F.col("p_partkey")
        deps = F.array_distinct(F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3")))
        return (self.part.filter(k >= 2).select(k, F.explode(deps).alias("d"))
                .select(F.concat(F.lit("p"), k).alias("job"), F.concat(F.lit("p"), "d").alias("dep")))

    @property
    def looped_edges(self) -> DataFrame:
        """The same with an edge back from k div 2 to k for some k, and jobs that need themselves."""
        k = F.col("p_partkey")
        back = self.part.filter((k >= 2) & (k % 97 == 5)).select(
            F.concat(F.lit("p"), F.expr("p_partkey div 2")).alias("job"), F.concat(F.lit("p"), k).alias("dep"))
        own = self.part.filter(k % 101 == 7).select(F.concat(F.lit("p"), k).alias("job"),
                                                    F.concat(F.lit("p"), k).alias("dep"))
        return self.edges.unionByName(back).unionByName(own)

    @property
    def node_status(self) -> DataFrame:
        """(flow, job, status, start_time, end_time): parts in flows of three."""
        n = (F.col("p_partkey") * 7 + F.col("p_size")) % 6
        status = F.element_at(F.array(*[F.lit(s) for s in STATUS_ORDER]), (n + 1).cast("int"))
        start = F.timestamp_add("MINUTE", F.col("p_partkey"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
        df = self.part.select(F.expr("p_partkey div 3").alias("flow"), F.concat(F.lit("p"), "p_partkey").alias("job"),
                              status.alias("status"), start.alias("start_time"), F.col("p_size"))
        end = F.timestamp_add("MINUTE", F.col("p_size"), F.col("start_time"))
        return df.select("flow", "job", "status", F.when(F.col("status") != "READY", F.col("start_time")).alias("start_time"),
                         F.when(F.col("status").isin("SUCCEEDED", "COMPLETED", "FAILED"), end).alias("end_time"))

    @property
    def scopes(self) -> DataFrame:
        """(scope, parent): customers under nations under regions."""
        return (self.region.select(F.concat(F.lit("r"), "r_regionkey").alias("scope"), F.lit(None).cast("string").alias("parent"))
                .unionByName(self.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("scope"),
                                                F.concat(F.lit("r"), "n_regionkey").alias("parent")))
                .unionByName(self.customer.select(F.concat(F.lit("c"), "c_custkey").alias("scope"),
                                                  F.concat(F.lit("n"), "c_nationkey").alias("parent"))))

    @property
    def config(self) -> DataFrame:
        """(scope, key, value) at the three levels, some keys set at more than one."""
        def entries(df: DataFrame, scope, pairs) -> DataFrame:
            return df.select(scope.alias("scope"), F.explode(F.array(
                *[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])).alias("e")).select("scope", "e.*")

        region = entries(self.region, F.concat(F.lit("r"), "r_regionkey"), [
            ("owner", F.col("r_name")), ("env.zone", F.col("r_name")), ("env.tier", F.lit("gold")),
            ("greeting", F.lit("hello ${owner} of ${env.zone}"))])
        nation = entries(self.nation, F.concat(F.lit("n"), "n_nationkey"), [
            ("owner", F.col("n_name")), ("env.site", F.col("n_name"))])
        customer = entries(self.customer, F.concat(F.lit("c"), "c_custkey"), [
            ("segment", F.col("c_mktsegment")), ("label", F.lit("${greeting}, ${segment} at ${env.site}"))])
        own = self.customer.filter(F.col("c_custkey") % 5 == 0).select(
            F.concat(F.lit("c"), "c_custkey").alias("scope"), F.lit("owner").alias("key"), F.col("c_name").alias("value"))
        return region.unionByName(nation).unionByName(customer).unionByName(own)

    @property
    def schedules(self) -> DataFrame:
        """(name, start, period): one per customer, every unit of period and none."""
        k = F.col("c_custkey")
        n = (k % 7 + 1)
        period = (F.when(k % 5 == 0, F.lit("n")).when(k % 5 == 1, F.concat(n.cast("string"), F.lit("d")))
                  .when(k % 5 == 2, F.concat(n.cast("string"), F.lit("h")))
                  .when(k % 5 == 3, F.concat((n * 10).cast("string"), F.lit("m")))
                  .otherwise(F.concat((n * 600).cast("string"), F.lit("s"))))
        return self.customer.select(
            F.concat(F.lit("job"), k).alias("name"),
            F.timestamp_add("HOUR", k % 168, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("start"),
            period.alias("period"))

    @property
    def flow_documents(self) -> DataFrame:
        """(document): one JSON document per flow of three jobs; the first job needs the other two."""
        state = F.struct(F.lit("job").alias("type"), F.col("job").alias("name"), "status",
                         F.col("flow").cast("string").alias("id"), F.create_map(F.lit("given"), F.col("job")).alias("overrideProps"),
                         F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss").alias("startTime"),
                         F.date_format("end_time", "yyyy-MM-dd'T'HH:mm:ss").alias("endTime"))
        # A flow has three jobs by construction.
        def by_name(a, b):
            return F.when(a["job"] < b["job"], -1).when(a["job"] > b["job"], 1).otherwise(0)

        flows = self.node_status.groupBy("flow").agg(
            F.array_sort(F.collect_list(F.struct("job", state.alias("state"))), by_name).alias("m"))
        names = F.transform("m", lambda x: x["job"])
        first = F.get(names, F.lit(0))
        rest = F.slice(names, 2, 2)
        flow = F.struct(F.map_from_entries("m").alias("jobs"), F.array(first).alias("root"),
                        F.create_map(first, rest).alias("dependencies"), F.col("flow").cast("string").alias("id"))
        return flows.select(F.to_json(F.struct(
            F.lit("flow").alias("type"), flow.alias("flow"),
            F.create_map(F.lit("flow"), F.col("flow").cast("string")).alias("parentProps"))).alias("document"))


# The order in which parts are given states.
STATUS_ORDER = ("SUCCEEDED", "FAILED", "READY", "RUNNING", "COMPLETED", "IGNORED")

_STATUS_SQL = "[" + ", ".join(f"'{s}'" for s in STATUS_ORDER) + "]"

# name -> (tables it needs, SQL, heading with column names where the table is recursive)
SQL: dict[str, tuple[tuple[str, ...], str, str | None]] = {
    "query_log": ((), """
        SELECT source AS "user", '240101' || lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') || '0000' AS "time",
               replace(text, chr(10), ' ') AS query FROM documents""", None),
    "hourly": (("query_log",), r"""
        SELECT DISTINCT "user", substr("time", 7, 2) AS hour, unnest(grams) AS ngram FROM (
          SELECT "user", "time", list_concat(words, list_transform(range(1, len(words)),
                   lambda i: words[i] || ' ' || words[i + 1])) AS grams
          FROM (SELECT "user", "time", list_filter(string_split_regex(lower(query), '\s+'), lambda w: w <> '') AS words
                FROM query_log WHERE length(trim(query)) > 0
                  AND NOT regexp_matches(query, '(?i)^\s*(https?://|ftp://|www\.)\S*')))""", None),
    "frequency": (("hourly",), """SELECT ngram, hour, count(*) AS "count" FROM hourly GROUP BY ngram, hour""", None),
    "scored": (("frequency",), """
        SELECT hour, ngram, "count", sum("count") OVER w / count(*) OVER w AS mean,
               (count(*) OVER w * "count" - sum("count") OVER w)
                 / nullif(sqrt(count(*) OVER w * sum("count" * "count") OVER w - sum("count") OVER w * sum("count") OVER w), 0) AS score
        FROM frequency WINDOW w AS (PARTITION BY ngram)""", None),
    "lines": ((), """
        SELECT source, doc_id * 1048576 + generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS line
        FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents)""", None),
    "runs": ((), """
        SELECT event_id AS run, 'job' || user_id AS job, ts AS started,
               CASE WHEN event_id % 11 <> 0 THEN ts + to_milliseconds(CAST(round(value * 1000) AS BIGINT) * 60) END AS ended,
               event_type <> 'error' AS succeeded, 'src' || (event_id % 20) AS log FROM events""", None),
    "latest": (("runs",), """
        SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY job ORDER BY started DESC) = 1""", None),
    "nodes": ((), "SELECT 'p' || p_partkey AS job FROM part", None),
    "edges": ((), """
        SELECT DISTINCT 'p' || p_partkey AS job, 'p' || unnest([p_partkey // 2, p_partkey // 3]) AS dep
        FROM part WHERE p_partkey >= 2""", None),
    "looped": (("edges",), """
        SELECT job, dep FROM edges
        UNION ALL SELECT 'p' || (p_partkey // 2), 'p' || p_partkey FROM part WHERE p_partkey >= 2 AND p_partkey % 97 = 5
        UNION ALL SELECT 'p' || p_partkey, 'p' || p_partkey FROM part WHERE p_partkey % 101 = 7""", None),
    "roots": (("nodes", "edges"), "SELECT job FROM nodes WHERE job NOT IN (SELECT dep FROM edges)", None),
    "node_status": ((), f"""
        SELECT flow, job, status, CASE WHEN status <> 'READY' THEN t END AS start_time,
               CASE WHEN status IN ('SUCCEEDED', 'COMPLETED', 'FAILED') THEN t + to_minutes(p_size) END AS end_time
        FROM (SELECT p_partkey // 3 AS flow, 'p' || p_partkey AS job, p_size,
                     ({_STATUS_SQL})[(p_partkey * 7 + p_size) % 6 + 1] AS status,
                     TIMESTAMP '2024-01-01' + to_minutes(p_partkey) AS t FROM part)""", None),
    "scopes": ((), """
        SELECT 'r' || r_regionkey AS scope, CAST(NULL AS VARCHAR) AS parent FROM region
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer""", None),
    "config": ((), """
        SELECT 'r' || r_regionkey AS scope, unnest(['owner', 'env.zone', 'env.tier', 'greeting']) AS key,
               unnest([r_name, r_name, 'gold', 'hello ${owner} of ${env.zone}']) AS value FROM region
        UNION ALL SELECT 'n' || n_nationkey, unnest(['owner', 'env.site']), unnest([n_name, n_name]) FROM nation
        UNION ALL SELECT 'c' || c_custkey, unnest(['segment', 'label']),
               unnest([c_mktsegment, '${greeting}, ${segment} at ${env.site}']) FROM customer
        UNION ALL SELECT 'c' || c_custkey, 'owner', c_name FROM customer WHERE c_custkey % 5 = 0""", None),
    "chain": (("scopes",), """
        SELECT scope, scope, 0 FROM scopes
        UNION ALL SELECT c.scope, s.parent, c.depth + 1 FROM chain c JOIN scopes s ON s.scope = c.ancestor
        WHERE s.parent IS NOT NULL""", "chain(scope, ancestor, depth)"),
    "seen": (("chain", "config"), """
        SELECT chain.scope, key, value, depth FROM chain JOIN config ON config.scope = chain.ancestor""", None),
    "effective": (("seen",), """
        SELECT scope, key, value FROM seen QUALIFY row_number() OVER (PARTITION BY scope, key ORDER BY depth) = 1""", None),
    "schedules": ((), """
        SELECT 'job' || c_custkey AS name, TIMESTAMP '2024-01-01' + to_hours(c_custkey % 168) AS start,
               CASE c_custkey % 5 WHEN 0 THEN 'n' WHEN 1 THEN (c_custkey % 7 + 1) || 'd'
                 WHEN 2 THEN (c_custkey % 7 + 1) || 'h' WHEN 3 THEN (c_custkey % 7 + 1) * 10 || 'm'
                 ELSE (c_custkey % 7 + 1) * 600 || 's' END AS period FROM customer""", None),
    "timed": (("schedules",), f"""
        SELECT name, start, period, TIMESTAMP '{NOW}' AS now_at,
               CASE WHEN period <> 'n' THEN CAST(left(period, -1) AS BIGINT) *
                 CASE right(period, 1) WHEN 'd' THEN 86400 WHEN 'h' THEN 3600 WHEN 'm' THEN 60 ELSE 1 END END AS secs
        FROM schedules""", None),
}
