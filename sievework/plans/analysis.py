"""Queries that run the rules over the tables of files, lines and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import analyse as A
from sievework.operators import scoring as G
from sievework.operators.rules import blocks as B
from sievework.operators.rules import graph
from sievework.operators.rules import lines as L
from sievework.plans import rule_sql
from sievework.shared import table


def deliveries(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(all deliveries of files, those that another of the same path has replaced).

    A delivery is told by its time and key. One that is repeated as it is stays repeated; findings become distinct later.
    """
    rows = table(spark, folder, "files").select("repo", F.col("display_path").alias("file_path"), "is_script", "text", "mode", F.concat_ws(" ", F.date_format(F.col("ingested_at").cast("timestamp"), "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("file_id").cast("string"), 20, "0")).alias("delivery"))
    last = rows.groupBy("repo", "file_path").agg(F.max("delivery").alias("_last"), F.collect_set("delivery").alias("_all")).where(F.size("_all") > 1)
    return rows, last.select("repo", "file_path", "_last", F.explode("_all").alias("delivery")).where(F.col("delivery") != F.col("_last")).drop("_last")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of the tables, each path by its last delivery: an anti join with the few deliveries that are not the last,
    which the planner sends around as long as they are small."""
    rows, stale = deliveries(spark, folder)
    return rows.join(stale, ["repo", "file_path", "delivery"], "left_anti").drop("delivery")


def _analysed(spark: SparkSession, folder: str, **options) -> DataFrame:
    rows, stale = deliveries(spark, folder)
    return A.analyse(rows, stale=stale, **options)


def analysis(spark: SparkSession, folder: str) -> DataFrame:
    return _analysed(spark, folder).select("repo", "file_path", "line", "rule_id", "symbol", "severity", "pillar", "confidence", "message", "fingerprint")


def analysis_by_rule(spark: SparkSession, folder: str) -> DataFrame:
    return G.severity_counts(_analysed(spark, folder), "rule_id")


def file_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the rules that raw text decides, without masks: on documentation blocks, overviews, lengths and manifests."""
    return _analysed(spark, folder).where(F.col("rule_id").isin(*rule_sql.FILE_RULES)).select("repo", "file_path", "line", "rule_id", "symbol")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "code_lines").distinct().select("repo", F.col("display_path").alias("file_path"), "n", "line", F.col("code_line").alias("code"))


def line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return L.line_findings(_lines(spark, folder)).select("repo", "file_path", "line", "rule_id", "symbol")


def secret_rules(spark: SparkSession, folder: str) -> DataFrame:
    return L.secret_findings(_lines(spark, folder)).select("repo", "file_path", "line", "rule_id", "metadata_json")


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    repo = table(spark, folder, "files").select("file_id", "repo").distinct()
    return table(spark, folder, "blocks").distinct().join(repo, "file_id").withColumnRenamed("display_path", "file_path")


def block_rules(spark: SparkSession, folder: str) -> DataFrame:
    return B.block_findings(_blocks(spark, folder)).select("repo", "file_path", "line", "rule_id", "symbol")


def block_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters and branches of each block."""
    code = F.coalesce("code_body", "body")
    rows = table(spark, folder, "blocks").where(F.col("body").isNotNull())
    return rows.select("block_id", "start_line", B.cyclomatic(code).cast("long").alias("cyclomatic"), B.parameter_count(F.coalesce("params", F.lit(""))).cast("long").alias("n_params"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    own = files(spark, folder)
    imports = A.scanned(own.where("is_script"), rules=False).select("repo", "file_path", F.inline("imports"))
    return graph.edges(imports, own.select("repo", "file_path"))


def import_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder)


def import_cycles(spark: SparkSession, folder: str) -> DataFrame:
    return graph.cycles(_edges(spark, folder)).select("repo", F.array_join("files", " -> ").alias("files"))


def comments(spark: SparkSession, folder: str) -> DataFrame:
    return A.scanned(files(spark, folder).where("is_script"), rules=False).select("repo", "file_path", F.inline("comments"))


def extracted_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return A.scanned(files(spark, folder).where("is_script"), rules=False).select("repo", "file_path", F.inline("blocks"))


def masked_files(spark: SparkSession, folder: str) -> DataFrame:
    return A.scanned(files(spark, folder).where("is_script"), rules=False).select("repo", "file_path", F.sha2("code", 256).alias("code_hash"), F.length("code").alias("n_chars"))


def diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    return A.diagnostics(files(spark, folder))


QUERIES = {
    "analysis": analysis, "analysis_by_rule": analysis_by_rule, "file_rules": file_rules, "line_rules": line_rules, "secret_rules": secret_rules, "block_rules": block_rules, "block_metrics": block_metrics,
    "import_edges": import_edges, "import_cycles": import_cycles, "comments": comments, "extracted_blocks": extracted_blocks, "masked_files": masked_files, "diagnostics": diagnostics,
}
SQL = {
    "import_edges": rule_sql.IMPORT_EDGES_SQL, "import_cycles": rule_sql.IMPORT_CYCLES_SQL,
    "file_rules": rule_sql.FILE_RULES_SQL, "line_rules": rule_sql.LINE_RULES_SQL, "secret_rules": rule_sql.SECRET_RULES_SQL, "block_rules": rule_sql.BLOCK_RULES_SQL,
    "block_metrics": r"""SELECT block_id, start_line, 1 + len(regexp_extract_all(regexp_replace(coalesce(code_body, body), '[^A-Za-z0-9_?&|]', '  ', 'g'), '(?:(?:^| )(?:if|switch|case|for|while|catch)(?: |$))')) + length(coalesce(code_body, body)) - length(replace(coalesce(code_body, body), '?', ''))
        + len(regexp_extract_all(coalesce(code_body, body), '&&')) + len(regexp_extract_all(coalesce(code_body, body), '\|\|')) AS cyclomatic,
        len(list_filter(string_split(coalesce(params, ''), ','), lambda p: trim(p) <> '')) AS n_params FROM blocks WHERE body IS NOT NULL""",
}
