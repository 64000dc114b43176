"""Layered config."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.operators import config as cfg


def _effective(t):
    return cfg.effective(t.config, cfg.chains(t.scopes))


@query("config_effective", "SELECT scope, key, value FROM effective", ("effective",))
def config_effective(t):
    return _effective(t)


@query("config_prefix_map", "SELECT scope, substr(key, 5) AS key, value FROM effective WHERE starts_with(key, 'env.')", ("effective",))
def config_prefix_map(t):
    return cfg.by_prefix(_effective(t), "env.")


@query("config_interpolate", """
    SELECT e.scope, e.key, CASE WHEN e.key = 'label' AND g.scope IS NOT NULL
             THEN 'hello ' || o.value || ' of ' || z.value || ', ' || s.value || ' at ' || w.value
           WHEN e.key = 'greeting' THEN 'hello ' || o.value || ' of ' || z.value ELSE e.value END AS value,
           CAST(NULL AS VARCHAR) AS problem
    FROM effective e LEFT JOIN effective g ON g.scope = e.scope AND g.key = 'greeting'
      LEFT JOIN effective o ON o.scope = e.scope AND o.key = 'owner' LEFT JOIN effective z ON z.scope = e.scope AND z.key = 'env.zone'
      LEFT JOIN effective s ON s.scope = e.scope AND s.key = 'segment' LEFT JOIN effective w ON w.scope = e.scope AND w.key = 'env.site'
    """, ("effective",))
def config_interpolate(t):
    return cfg.interpolate(_effective(t))


@query("config_merge", """
    SELECT scope, key, arg_min(value, position) AS value FROM (
      SELECT 'm' || p_partkey % 100 AS scope, p_partkey AS position, unnest(['size', 'brand', p_type]) AS key,
             unnest([CAST(p_size AS VARCHAR), p_brand, p_name]) AS value FROM part) GROUP BY scope, key""")
def config_merge(t):
    sets = t.part.select(
        F.concat(F.lit("m"), F.col("p_partkey") % 100).alias("scope"), F.col("p_partkey").alias("position"), F.explode(F.array(
            F.struct(F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value")),
            F.struct(F.lit("brand").alias("key"), F.col("p_brand").alias("value")),
            F.struct(F.col("p_type").alias("key"), F.col("p_name").alias("value")))).alias("e")) \
        .select("scope", "position", "e.*")
    return cfg.merge(sets)


@query("config_pass_on", """
    SELECT job, key, arg_min(value, depth) AS value FROM (
      SELECT 'p' || p_partkey AS job, 'brand' AS key, p_brand AS value, 0 AS depth FROM part WHERE p_partkey % 2 = 0
      UNION ALL SELECT job, key, arg_max(value, dep), 1 FROM (
        SELECT edges.job, edges.dep, o.key, o.value FROM edges JOIN (
          SELECT 'p' || p_partkey AS job, unnest(['brand', 'type']) AS key, unnest([p_brand, p_type]) AS value FROM part) o
        ON o.job = edges.dep) GROUP BY job, key) GROUP BY job, key""", ("edges",))
def config_pass_on(t):
    named = t.part.withColumn("job", F.concat(F.lit("p"), "p_partkey"))
    outputs = named.select("job", F.explode(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")))
                           .alias("key", "value"))
    own = named.filter("p_partkey % 2 = 0").select("job", F.lit("brand").alias("key"), F.col("p_brand").alias("value"))
    return cfg.pass_on(t.edges, outputs, own)


@query("config_contains_value", """
    SELECT DISTINCT scope FROM seen WHERE value = (SELECT r_name FROM region WHERE r_regionkey = 2)""", ("seen",))
def config_contains_value(t):
    wanted = t.region.filter("r_regionkey = 2").select("r_name").first()["r_name"]
    return cfg.contains_value(t.config, cfg.chains(t.scopes), wanted)
