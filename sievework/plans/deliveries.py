"""Queries p4 and p6: changes between deliveries, and per-key results under skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import keyed_chunks as chunks
from sievework.operators import snapshot_diff as diff
from sievework.shared import table

SHARE = 0.04
CHUNK_ROWS = 50_000


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of each repository's findings between consecutive deliveries. A row without fingerprint is no record."""
    raw = table(spark, folder, "finding_snapshots")
    rows = raw.select("repo", "snapshot_no", F.lower("fingerprint").alias("fingerprint"), "loaded_at", "severity", "confidence", diff.squeezed(F.col("message")).alias("message"), diff.canonical_json(F.col("metadata_json")).alias("metadata_json"))
    # a delivery whose rows all lack a fingerprint is still a delivery: its rows are kept under a null key
    content = ["severity", "confidence", "message", "metadata_json"]
    keyed = rows.withColumns({c: F.when(F.col("fingerprint").isNotNull(), F.col(c)) for c in content})
    return diff.snapshot_changes(keyed, ["repo"], "snapshot_no", ["fingerprint"], content, loaded="loaded_at").where(F.col("fingerprint").isNotNull())


def _fields(spark: SparkSession, folder: str, *others: str) -> DataFrame:
    """Each finding twice: under its rule and under its file; only the needed columns are read."""
    findings = table(spark, folder, "findings")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("key_field"), F.col(c).alias("key_value")) for c in ("rule_id", "file_path")]))
    return findings.select(pairs.alias("_pair"), *others).select("_pair.key_field", "_pair.key_value", *others)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values that hold at least 4 % of all rows, read off the exact row numbers of the chunking."""
    total = table(spark, folder, "findings").count()
    numbered = chunks.numbered_rows(_fields(spark, folder, "finding_id"), ["key_field", "key_value"], ["finding_id"], CHUNK_ROWS)
    return chunks.heavy_keys(numbered, ["key_field", "key_value"], total, SHARE).select("key_field", "key_value")


def p6_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Per rule and per file: rows, and runs of equal severity in the order of emission."""
    order = ["emitted_at", "finding_id", "received_at", "severity"]
    numbered = chunks.numbered_rows(_fields(spark, folder, *order), ["key_field", "key_value"], order, CHUNK_ROWS)
    return chunks.run_profile(numbered, ["key_field", "key_value"], "severity").drop("n_chunks")


P4_SQL = r"""
WITH c AS (
  SELECT repo, snapshot_no, lower(fingerprint) AS fingerprint, loaded_at, severity, confidence,
         trim(regexp_replace(message, '\s+', ' ', 'g')) AS message,
         CASE WHEN metadata_json IS NULL THEN NULL ELSE (SELECT string_agg(k || '=' || json_extract_string(metadata_json, '$.' || k), ',' ORDER BY k) FROM (SELECT unnest(json_keys(metadata_json)) AS k)) END AS meta
  FROM finding_snapshots),
r AS (SELECT * FROM c WHERE fingerprint IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY repo, snapshot_no, fingerprint ORDER BY loaded_at DESC, severity DESC, confidence DESC, message DESC, meta DESC) = 1),
d AS (SELECT repo, snapshot_no, lag(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT repo, snapshot_no FROM finding_snapshots)),
n AS (SELECT d.repo, d.snapshot_no AS later, r.* EXCLUDE (repo) FROM d JOIN r ON r.repo = d.repo AND r.snapshot_no = d.snapshot_no WHERE d.prev IS NOT NULL),
o AS (SELECT d.repo, d.snapshot_no AS later, r.* EXCLUDE (repo) FROM d JOIN r ON r.repo = d.repo AND r.snapshot_no = d.prev WHERE d.prev IS NOT NULL)
SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.later, o.later) AS snapshot_no, coalesce(n.fingerprint, o.fingerprint) AS fingerprint,
       CASE WHEN o.fingerprint IS NULL THEN 'added' WHEN n.fingerprint IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM n FULL JOIN o ON n.repo = o.repo AND n.later = o.later AND n.fingerprint = o.fingerprint
WHERE o.fingerprint IS NULL OR n.fingerprint IS NULL OR n.severity IS DISTINCT FROM o.severity OR n.confidence IS DISTINCT FROM o.confidence
   OR n.message IS DISTINCT FROM o.message OR n.meta IS DISTINCT FROM o.meta
"""

P6_SQL = """
WITH k AS (SELECT 'rule_id' AS key_field, rule_id AS key_value FROM findings UNION ALL SELECT 'file_path', file_path FROM findings)
SELECT key_field, key_value FROM k WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.04 * (SELECT count(*) FROM findings)
"""

P6_PROFILE_SQL = """
WITH k AS (SELECT 'rule_id' AS key_field, rule_id AS key_value, * FROM findings UNION ALL SELECT 'file_path', file_path, * FROM findings),
l AS (SELECT key_field, key_value, severity, row_number() OVER w AS rn, lag(severity) OVER w AS before
      FROM k WINDOW w AS (PARTITION BY key_field, key_value ORDER BY emitted_at, finding_id, received_at, severity NULLS FIRST)),
s AS (SELECT *, CASE WHEN rn = 1 OR severity IS DISTINCT FROM before THEN 1 ELSE 0 END AS is_start FROM l),
g AS (SELECT *, sum(is_start) OVER (PARTITION BY key_field, key_value ORDER BY rn) AS run FROM s),
c AS (SELECT key_field, key_value, run, count(*) AS len FROM g GROUP BY ALL)
SELECT key_field, key_value, sum(len)::BIGINT AS n_rows, count(*) AS n_runs, max(len) AS longest_run FROM c GROUP BY ALL
"""

QUERIES = {"p4_found": p4_found, "p6_found": p6_found, "p6_profile": p6_profile}
SQL = {"p4_found": P4_SQL, "p6_found": P6_SQL, "p6_profile": P6_PROFILE_SQL}
