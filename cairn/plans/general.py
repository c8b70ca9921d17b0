"""Queries of the general operators (hierarchies, snapshots) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import hierarchy, snapshots
from cairn.session import load


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.related_pairs(hierarchy.parent_links(load(spark, sf_dir, "parsed_inheritance")))


def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hierarchy.hierarchy(hierarchy.parent_links(load(spark, sf_dir, "parsed_inheritance")))
    return rows.withColumn("path", F.array_join("path", " > "))


def p2_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hierarchy.hierarchy(hierarchy.parent_links(load(spark, sf_dir, "parsed_inheritance")))
    return rows.where("in_cycle").select("node")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.version_runs(load(spark, sf_dir, "snapshot_nodes"), load(spark, sf_dir, "snapshots"))


def p3_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.attribute_history(load(spark, sf_dir, "snapshot_nodes"), load(spark, sf_dir, "snapshots"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_changes(load(spark, sf_dir, "snapshot_nodes"), load(spark, sf_dir, "snapshots"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_hierarchy, p2_cycles, p3_found, p3_history, p6_found)}


_LINKS = r"""
WITH RECURSIVE named AS (
  SELECT nullif(list_last(string_split(regexp_replace(regexp_replace(class_name, '[\[<(].*$', ''), '\s+', '', 'g'), '.')), '') AS node,
         nullif(list_last(string_split(regexp_replace(regexp_replace(base, '[\[<(].*$', ''), '\s+', '', 'g'), '.')), '') AS parent
  FROM parsed_inheritance),
one AS (SELECT node, min(parent) AS parent FROM named WHERE node IS NOT NULL GROUP BY node),
links AS (SELECT node, parent FROM one UNION ALL
  SELECT DISTINCT parent, NULL FROM one WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM one)),
reach(node, other) AS (
  SELECT node, parent FROM links WHERE parent IS NOT NULL
  UNION SELECT r.node, l.parent FROM reach r JOIN links l ON l.node = r.other WHERE l.parent IS NOT NULL)
"""

_SETTLED = """
WITH listed AS (SELECT snapshot_id, row_number() OVER (ORDER BY snapshot_id) - 1 AS pos, created_at
  FROM (SELECT snapshot_id, max(created_at) AS created_at FROM snapshots WHERE snapshot_id IS NOT NULL GROUP BY snapshot_id)),
best AS (SELECT node_id, pos, attrs FROM snapshot_nodes JOIN listed USING (snapshot_id) WHERE node_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY node_id, pos ORDER BY recorded_at DESC NULLS LAST) = 1),
settled AS (SELECT node_id, pos, attrs, CASE WHEN attrs IS NULL THEN 'null' WHEN NOT json_valid(attrs) THEN 'no json ' || attrs ELSE
  array_to_string(list_sort(list_transform(
    list_filter(json_keys(attrs), lambda k: k <> 'last_seen' AND json_type(attrs, '$."' || k || '"') <> 'NULL'),
    lambda k: k || '=' || CASE WHEN json_type(attrs, '$."' || k || '"') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
      THEN CAST(CAST(json_extract_string(attrs, '$."' || k || '"') AS DOUBLE) AS VARCHAR)
      ELSE CAST(json_extract(attrs, '$."' || k || '"') AS VARCHAR) END)), chr(1)) END AS value FROM best),
sides AS (SELECT node_id, pos, value AS new, NULL AS old FROM settled UNION ALL SELECT node_id, pos + 1, NULL, value FROM settled),
pairs AS (SELECT node_id, pos, max(new) AS new, max(old) AS old FROM sides
  WHERE pos <= (SELECT max(pos) FROM listed) GROUP BY node_id, pos),
changes AS (SELECT node_id, pos, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'modified' END AS kind
  FROM pairs WHERE old IS DISTINCT FROM new),
spans AS (SELECT node_id, pos, kind, lead(pos) OVER (PARTITION BY node_id ORDER BY pos) AS next FROM changes),
runs AS (SELECT node_id, pos AS pos_from, coalesce(next - 1, (SELECT max(pos) FROM listed)) AS pos_to FROM spans WHERE kind <> 'removed')
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _LINKS + "SELECT DISTINCT least(node, other) AS class_a, greatest(node, other) AS class_b FROM reach",
        "p2_hierarchy": _LINKS
        + """, walk(node, above, last_) AS (
               SELECT node, [parent], parent FROM links WHERE parent IS NOT NULL
               UNION ALL SELECT w.node, list_append(w.above, l.parent), l.parent FROM walk w JOIN links l ON l.node = w.last_
               WHERE l.parent IS NOT NULL AND NOT list_contains(w.above, l.parent)),
             whole AS (SELECT l.node, coalesce(arg_max(above, len(above)), []) AS above FROM links l LEFT JOIN walk w ON w.node = l.node GROUP BY l.node),
             ended AS (SELECT w.node, w.above, list_contains(w.above, w.node) AS in_cycle, coalesce(w.above[-1], w.node) AS top, l.parent IS NOT NULL AS round_
               FROM whole w JOIN links l ON l.node = coalesce(w.above[-1], w.node))
             SELECT node, array_to_string(CASE WHEN in_cycle THEN list_reverse(above) ELSE list_append(list_reverse(above), node) END, ' > ') AS path,
               CASE WHEN NOT round_ THEN len(above) END AS depth, CASE WHEN NOT round_ THEN top END AS root, in_cycle, round_ AND NOT in_cycle AS below_cycle FROM ended""",
        "p2_cycles": _LINKS + "SELECT node FROM reach WHERE node = other",
        "p3_found": _SETTLED
        + """SELECT node_id, a.snapshot_id AS snapshot_from, b.snapshot_id AS snapshot_to
             FROM runs JOIN listed a ON a.pos = pos_from JOIN listed b ON b.pos = pos_to""",
        "p3_history": _SETTLED
        + """SELECT r.node_id, row_number() OVER (PARTITION BY r.node_id ORDER BY pos_from) AS version,
               a.snapshot_id AS snapshot_from, b.snapshot_id AS snapshot_to, a.created_at AS valid_from, c.created_at AS valid_to,
               c.created_at IS NULL AS is_current, f.attrs, CAST(json_extract_string(f.attrs, '$.first_seen') AS DOUBLE) AS first_seen,
               CAST(json_extract_string(l.attrs, '$.last_seen') AS DOUBLE) AS last_seen
             FROM runs r JOIN listed a ON a.pos = pos_from JOIN listed b ON b.pos = pos_to LEFT JOIN listed c ON c.pos = pos_to + 1
             JOIN settled f ON f.node_id = r.node_id AND f.pos = pos_from JOIN settled l ON l.node_id = r.node_id AND l.pos = pos_to""",
        "p6_found": _SETTLED
        + """SELECT a.snapshot_id AS snapshot_from, b.snapshot_id AS snapshot_to, node_id, kind AS change_kind
             FROM changes c JOIN listed a ON a.pos = c.pos - 1 JOIN listed b ON b.pos = c.pos""",
    }
