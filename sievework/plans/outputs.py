"""Queries that render all findings: workflow commands, lines of JSON and SARIF results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import scalars as S
from sievework.shared import table
from sievework.sinks import reports


def annotation_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = reports.annotations(table(spark, folder, "findings"))
    return lines.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def sarif_lines(spark: SparkSession, folder: str) -> DataFrame:
    return reports.sarif_results(table(spark, folder, "findings"))


def finding_lines(spark: SparkSession, folder: str) -> DataFrame:
    return reports.json_lines(table(spark, folder, "findings"))


def baseline_rows(spark: SparkSession, folder: str) -> DataFrame:
    from sievework.sources.baseline import baseline_lines

    return baseline_lines(table(spark, folder, "findings")).distinct()


def path_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Folder, name and stem of each path."""
    paths = table(spark, folder, "files").select(F.col("display_path").alias("p")).distinct()
    return paths.select("p", S.dir_name(F.col("p")).alias("folder"), S.base_name(F.col("p")).alias("name"), S.file_stem(F.col("p")).alias("stem"))


QUERIES = {"annotation_lines": annotation_lines, "sarif_lines": sarif_lines, "finding_lines": finding_lines, "baseline_rows": baseline_rows, "path_parts": path_parts}
ESCAPE = "replace(replace(replace(coalesce({0}, ''), '%', '%25'), chr(13), '%0D'), chr(10), '%0A')"
PROPERTY = "replace(replace(" + ESCAPE + ", ':', '%3A'), ',', '%2C')"


def _json(**fields: str) -> str:
    """An object of the fields that are not null, in their order; a value that ends in JSON is taken as it is."""
    pairs = [f"CASE WHEN ({v}) IS NOT NULL THEN '\"{k}\":' || {v if v.startswith('(/*json*/') else f'to_json({v})::VARCHAR'} END" for k, v in fields.items()]
    return "'{' || array_to_string(list_filter([" + ", ".join(pairs) + "], lambda x: x IS NOT NULL), ',') || '}'"


def _nested(value: str) -> str:
    return f"(/*json*/{value})"


URI = "replace(replace(url_encode(file_path), '%2F', '/'), '+', '%20')"
REGION = _nested(f"CASE WHEN line > 0 THEN {_json(startLine='line')} END")
PLACE = _nested(_json(physicalLocation=_nested(_json(artifactLocation=_nested(_json(uri=URI)), region=REGION))))
LEVEL = "CASE severity WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END"
SQL = {
    "finding_lines": f"SELECT {_json(rule_id='rule_id', message='message', file_path='file_path', line='line', severity='severity', pillar='pillar', confidence='confidence', symbol='symbol', fingerprint='fingerprint')} AS value FROM findings",
    "baseline_rows": f"SELECT DISTINCT {_json(fingerprint='fingerprint', ruleId='rule_id', filePath='file_path', line='line', symbol='symbol', message='message')} AS value FROM findings",
    "sarif_lines": f"SELECT {_json(ruleId='rule_id', level=LEVEL, message=_nested(_json(text='message')), locations=_nested(f"'[' || {PLACE} || ']'"), partialFingerprints=_nested(_json(primary='fingerprint')))} AS value FROM findings",
    "annotation_lines": f"""SELECT '::' || CASE severity WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'notice' END || ' file=' || {PROPERTY.format('file_path')} || ',line=' || coalesce(line, 1) || ',title=' || {PROPERTY.format('rule_id')} || '::' || {ESCAPE.format('message')} AS value, count(*) AS n FROM findings GROUP BY value""",
    "path_parts": r"""SELECT DISTINCT display_path AS p, CASE WHEN contains(display_path, '/') THEN regexp_replace(display_path, '/[^/]*$', '') ELSE '.' END AS folder, regexp_extract(display_path, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(display_path, '([^/]*)$', 1), '\.[^.]+$', '') AS stem FROM files""",
}
