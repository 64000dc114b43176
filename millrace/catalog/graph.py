"""Dependency graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.functions import status as status_fn
from millrace.operators import graph, trees
from millrace.sources import records

# Everything that failed jobs need, the seed of several queries.
_REACHED = """WITH reached(job) AS (SELECT job FROM node_status WHERE status = 'FAILED' AND job IN (SELECT job FROM roots)
    UNION SELECT edges.dep FROM reached JOIN edges ON edges.job = reached.job)"""


def _selected(t):
    failed = t.node_status.filter("status = 'FAILED'").select("job")
    return graph.roots(t.nodes, t.edges).join(failed, "job", "left_semi")


@query("dep_edges", """
    SELECT DISTINCT c_name AS job, unnest(['Customer' || c_custkey // 2, 'Customer' || c_custkey // 3]) AS dep FROM customer""")
def dep_edges(t):
    listed = F.concat(F.lit(" Customer"), F.expr("c_custkey div 2"), F.lit(" ,, Customer"), F.expr("c_custkey div 3"), F.lit(" , "))
    return graph.dependency_edges(t.customer.select(F.col("c_name").alias("id"), listed.alias("dependencies")))


@query("subflow_closure", """
    WITH reached(root, job) AS (SELECT job, job FROM roots UNION SELECT root, edges.dep FROM reached JOIN edges ON edges.job = reached.job)
    SELECT root, job FROM reached""", ("roots",))
def subflow_closure(t):
    seeds = graph.roots(t.nodes, t.edges).select(F.col("job").alias("root"), "job")
    return graph.closure(seeds, t.edges, tags=("root",))


_LEVELS = """WITH walk(job, level) AS (SELECT job, 0 FROM nodes WHERE job NOT IN (SELECT {up} FROM edges)
    UNION SELECT edges.{up}, level + 1 FROM walk JOIN edges ON edges.{down} = walk.job)
    SELECT job, CAST(max(level) AS INTEGER) AS level FROM walk GROUP BY job"""


@query("node_levels", _LEVELS.format(up="job", down="dep"), ("nodes", "edges"))
def node_levels(t):
    return graph.levels(t.nodes, t.edges)


@query("node_levels_from_sinks", _LEVELS.format(up="dep", down="job"), ("nodes", "edges"))
def node_levels_from_sinks(t):
    return graph.levels_from_sinks(t.nodes, t.edges)


@query("detect_cycles", """
    WITH paths(a, b) AS (SELECT job, dep FROM looped UNION SELECT a, dep FROM paths JOIN looped ON looped.job = paths.b),
    looping AS (SELECT DISTINCT a AS job FROM paths WHERE a = b)
    SELECT job, CASE WHEN job IN (SELECT job FROM looped WHERE job = dep) THEN 'self' ELSE 'cycle' END AS problem
    FROM (SELECT job FROM looping UNION SELECT a FROM paths WHERE b IN (SELECT job FROM looping))""", ("looped",))
def detect_cycles(t):
    return graph.cycles(t.nodes, t.looped_edges)


@query("cycle_members", """
    WITH paths(a, b) AS (SELECT job, dep FROM looped UNION SELECT a, dep FROM paths JOIN looped ON looped.job = paths.b),
    mutual AS (SELECT p.a AS job, min(p.b) AS cycle FROM paths p JOIN paths q ON q.a = p.b AND q.b = p.a AND p.a <> p.b GROUP BY p.a),
    looping AS (SELECT DISTINCT a AS job FROM paths WHERE a = b),
    stuck AS (SELECT job FROM looping UNION SELECT a FROM paths WHERE b IN (SELECT job FROM looping))
    SELECT s.job, CASE WHEN m.job IS NOT NULL THEN least(m.cycle, s.job) WHEN l.job IS NOT NULL THEN s.job END AS cycle,
           CASE WHEN m.job IS NOT NULL THEN 'member' WHEN l.job IS NOT NULL THEN 'self' ELSE 'above' END AS problem
    FROM stuck s LEFT JOIN mutual m ON m.job = s.job LEFT JOIN (SELECT DISTINCT job FROM looped WHERE job = dep) l ON l.job = s.job""",
       ("looped",))
def cycle_members(t):
    return graph.cycle_members(t.nodes, t.looped_edges)


@query("dep_pairs", "SELECT dep AS dependency, job AS dependent FROM edges", ("edges",))
def dep_pairs(t):
    return graph.pairs(t.edges, t.nodes)


@query("dep_tree_json", """
    WITH walk(job) AS (SELECT job FROM roots UNION SELECT dep FROM walk JOIN edges ON edges.job = walk.job),
    needs AS (SELECT job, list_sort(list(DISTINCT dep)) AS deps FROM edges GROUP BY job)
    SELECT w.job, w.job IN (SELECT job FROM roots) AS is_root,
           '{"name":"' || w.job || '","dependencies":[' || coalesce('"' || array_to_string(deps, '","') || '"', '') || ']}' AS json
    FROM walk w LEFT JOIN needs n ON n.job = w.job""", ("roots", "edges"))
def dep_tree_json(t):
    return graph.tree(t.nodes, t.edges)


@query("dep_tree_pieces", """
    WITH walk(job, depth) AS (SELECT job, 0 FROM roots UNION SELECT dep, depth + 1 FROM walk JOIN edges ON edges.job = walk.job),
    met AS (SELECT job, min(depth) AS depth FROM walk GROUP BY job),
    first AS (SELECT m.job, (SELECT min(e.job) FROM edges e JOIN met p ON p.job = e.job WHERE e.dep = m.job AND p.depth = m.depth - 1) AS parent
              FROM met m),
    ways(job, root, way) AS (SELECT job, job, [job] FROM roots
      UNION ALL SELECT f.job, w.root, list_append(w.way, f.job) FROM ways w JOIN first f ON f.parent = w.job),
    parts AS (
      SELECT root, list_append(way, '') AS place, job, 'open' AS kind, way[len(way) - 1] AS above FROM ways
      UNION ALL SELECT root, list_append(way, '~'), job, 'close', NULL FROM ways
      UNION ALL SELECT w.root, list_append(list_append(w.way, e.dep), ''), e.dep, 'named', w.job
      FROM ways w JOIN edges e ON e.job = w.job JOIN first f ON f.job = e.dep WHERE f.parent IS DISTINCT FROM e.job)
    SELECT root, row_number() OVER (PARTITION BY root ORDER BY place) - 1 AS pos,
           CASE kind WHEN 'close' THEN ']}' ELSE
             CASE WHEN above IS NOT NULL AND job > (SELECT min(dep) FROM edges WHERE edges.job = above) THEN ',' ELSE '' END
             || '{"name":"' || job || '"' || CASE kind WHEN 'open' THEN ',"dependencies":[' ELSE '}' END END AS piece
    FROM parts""", ("roots", "edges"))
def dep_tree_pieces(t):
    return trees.tokens(t.nodes, t.edges)


@query("flow_json", """
    SELECT flow, '{"name":"' || job || '","status":"' || status || '"}' AS line, 'node' AS part FROM node_status
    UNION ALL SELECT a.flow, '{"job":"' || e.job || '","dep":"' || e.dep || '"}', 'dependency'
    FROM edges e JOIN node_status a ON a.job = e.job JOIN node_status b ON b.job = e.dep AND b.flow = a.flow""", ("edges", "node_status"))
def flow_json(t):
    return graph.flow_documents(t.node_status, t.edges)


@query("restart_set", _REACHED + """
    SELECT job, CASE WHEN status = 'FAILED' AND job IN (SELECT job FROM reached) THEN 'READY' ELSE status END AS status FROM node_status""",
       ("roots", "node_status"))
def restart_set(t):
    return graph.restart(t.node_status.select("job", "status"), _selected(t), t.edges)


@query("disable_set", _REACHED + """
    SELECT job, CASE WHEN CAST(substr(job, 2) AS BIGINT) % 7 = 0 THEN 'IGNORED' ELSE 'READY' END AS status
    FROM node_status WHERE job IN (SELECT job FROM reached)""", ("roots", "node_status"))
def disable_set(t):
    disabled = t.part.filter("p_partkey % 7 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("job"))
    return graph.restart_disabled(t.node_status.select("job", "status"), _selected(t), disabled, t.edges)


@query("ready_frontier", """
    SELECT job FROM node_status WHERE status = 'READY' AND job NOT IN (
      SELECT e.job FROM edges e JOIN node_status s ON s.job = e.dep WHERE s.status NOT IN ('SUCCEEDED', 'COMPLETED', 'IGNORED'))""",
       ("edges", "node_status"))
def ready_frontier(t):
    return graph.ready(t.node_status, t.edges)


@query("crash_recovery_state", """
    SELECT CAST(flow AS VARCHAR) AS flow, job, CASE status WHEN 'RUNNING' THEN 'READY' ELSE status END AS status FROM node_status""",
       ("node_status",))
def crash_recovery_state(t):
    nodes, _, _ = graph.rebuilt(records.parse_flows(t.flow_documents))
    return nodes.withColumn("status", status_fn.after_restart("status"))


@query("flow_rebuild", """
    SELECT CAST(flow AS VARCHAR) AS flow, 'node' AS kind, job, status AS detail FROM node_status
    UNION ALL SELECT CAST(flow AS VARCHAR), 'edge', head, job FROM (
      SELECT flow, job, min(job) OVER (PARTITION BY flow) AS head FROM node_status) WHERE job <> head
    UNION ALL SELECT CAST(flow AS VARCHAR), 'missing', 'gone' || flow, NULL FROM node_status WHERE flow % 5 = 0 GROUP BY flow""",
       ("node_status",))
def flow_rebuild(t):
    flows = records.parse_flows(t.flow_documents)
    # Some documents name a root that is not among their jobs.
    flows = flows.withColumn("root", F.when(F.col("id").cast("bigint") % 5 == 0,
                                            F.array(F.concat(F.lit("gone"), "id"))).otherwise(F.col("root")))
    nodes, edges, missing = graph.rebuilt(flows)
    return (nodes.select("flow", F.lit("node").alias("kind"), "job", F.col("status").alias("detail"))
            .unionByName(edges.select("flow", F.lit("edge").alias("kind"), "job", F.col("dep").alias("detail")))
            .unionByName(missing.select("flow", F.lit("missing").alias("kind"), "job",
                                        F.lit(None).cast("string").alias("detail"))))


@query("duplicate_jobs", "SELECT p_name AS id, CAST(count(*) AS BIGINT) AS copies FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_jobs(t):
    return graph.duplicates(t.part.select(F.col("p_name").alias("id")))


@query("ancestor_disable", _REACHED + " SELECT job, flow FROM node_status WHERE job IN (SELECT job FROM reached)",
       ("roots", "node_status"))
def ancestor_disable(t):
    return graph.with_everything_needed(t.node_status.select("job", "flow"), _selected(t), t.edges)
