"""Baselines and histories of runs as files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "sievework.baseline.v1"
ENTRY = "struct<fingerprint string, ruleId string, filePath string, line int, symbol string, message string>"
KEPT_RUNS = 100


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a baseline file as findings; another version raises."""
    raw = spark.read.schema(f"schemaVersion string, entries array<{ENTRY}>").json(path, multiLine=True)
    versions = [r[0] for r in raw.select("schemaVersion").distinct().limit(2).collect()]
    if versions != [VERSION]:
        raise ValueError(f"{path} is no baseline of version {VERSION}")
    rows = raw.select(F.inline("entries"))
    return rows.select("fingerprint", F.col("ruleId").alias("rule_id"), F.col("filePath").alias("file_path"), "line", "symbol", "message")


def baseline_lines(findings: DataFrame) -> DataFrame:
    """Entries of a baseline as JSON rows, for a table of its own where one document would be too large."""
    return findings.select(F.to_json(F.struct("fingerprint", F.col("rule_id").alias("ruleId"), F.col("file_path").alias("filePath"), "line", "symbol", "message")).alias("value"))


def write_baseline(findings: DataFrame, path: str, most: int = 1_000_000) -> int:
    """One document with all findings before any filter; more than ``most`` raise, and belong into a table."""
    rows = baseline_lines(findings).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many findings for one document; write baseline_lines() as a table")
    entries = sorted((json.loads(r[0]) for r in rows), key=lambda e: (e.get("filePath") or "", e.get("line") or 0, e["ruleId"]))
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"schemaVersion": VERSION, "entries": entries}, f, indent=2)
        f.write("\n")
    return len(entries)


def append_history(path: str, recorded_at: str, findings: int, score: float) -> list[dict]:
    """Adds a run and keeps the last hundred."""
    runs = []
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            runs = json.load(f)
    runs = [*runs, {"recordedAt": recorded_at, "findings": findings, "score": score}][-KEPT_RUNS:]
    with open(path, "w", encoding="utf-8") as f:
        json.dump(runs, f, indent=2)
        f.write("\n")
    return runs
