"""Problem 3: source files that do not parse, per file and as rates per repository and language."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.data_parsers import json_errors, yaml_errors
from sievework.llm.files import per_file
from sievework.llm.script_parser import DIALECTS, script_errors
from sievework.shared import table

LANGUAGES = [*DIALECTS, "json", "yml", "yaml"]
EXTENSION = r"\.([^./]+)$"


def errors_of(text: str, path: str) -> list[tuple[int, str]]:
    """All errors of a file as (offset, message); empty for a valid file and for an extension that has no language."""
    m = re.search(EXTENSION, path)
    extension = m.group(1).lower() if m else ""
    if extension in DIALECTS:
        return script_errors(text, extension, path)
    if extension == "json":
        return json_errors(text, relaxed=path.rsplit("/", 1)[-1] == "tsconfig.json")
    if extension in ("yml", "yaml"):
        return yaml_errors(text)
    return []


def language(path: str = "display_path"):
    return F.lower(F.regexp_extract(path, EXTENSION, 1))


# One extension for each language, in the order in which a file that is invalid is tried as another. The typed script
# languages read plain scripts too.
FAMILIES = ("json", "cjs", "mjs", "jsx", "ts", "tsx", "yaml")


def accepted_by(text: str) -> list[str]:
    """The languages for which a text is valid, whatever its extension says."""
    return [x for x in FAMILIES if not (script_errors(text, x, f"a.{x}", 1) if x in DIALECTS else errors_of(text, f"a.{x}"))]


def _parsed(text: str | None, path: str | None) -> dict:
    if text is None or path is None:
        return {"n_errors": None, "first_line": None, "first_cause": None, "errors": None, "accepted_by": None}
    errors, line, last = [], 1, 0
    for at, cause in errors_of(text, path):
        line += text.count("\n", last, at) if at >= last else -text.count("\n", at, last)
        last = at
        errors.append({"line": line, "cause": cause})
    first = errors[0] if errors else {"line": None, "cause": None}
    return {"n_errors": len(errors), "first_line": first["line"], "first_cause": first["cause"], "errors": errors, "accepted_by": accepted_by(text) if errors else None}


def parsed_files(files: DataFrame) -> DataFrame:
    """Per file with a language and a text: how many errors it has, line and cause of the first, and of all in the order found;
    of an invalid file also the languages that accept it.

    Files are parsed where they are read, one batch at a time; only the small outcome is shuffled, to let the last of
    repeated deliveries hold. Each file is parsed whole. A file whose last delivery has no text, and one without path or
    language, gives no row; an empty file is valid (but no valid JSON). Extra columns are ignored.
    """
    typed = files.withColumn("language", language()).where(F.col("language").isin(LANGUAGES))
    rows = per_file(typed, _parsed, "n_errors int, first_line int, first_cause string, errors array<struct<line: int, cause: string>>, accepted_by array<string>", keep=["repo", "language"])
    return rows.where(F.col("n_errors").isNotNull() | F.col("error").isNotNull())


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return parsed_files(table(spark, folder, "files")).where("n_errors > 0").select("file_id")


def p3_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per file: number of errors, line and cause of the first, and ``errors`` with line and cause of each."""
    return parsed_files(table(spark, folder, "files"))


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Per repository and language: files, invalid files and their share."""
    rows = parsed_files(table(spark, folder, "files")).groupBy("repo", "language")
    counted = rows.agg(F.count(F.lit(1)).alias("n_files"), F.sum((F.col("n_errors") > 0).cast("long")).alias("n_invalid"))
    return counted.withColumn("invalid_share", F.col("n_invalid") / F.col("n_files"))


def p3_accepted(spark: SparkSession, folder: str) -> DataFrame:
    """Per language and language that accepts them: how many of its invalid files; null for files that none accepts."""
    rows = parsed_files(table(spark, folder, "files")).where("n_errors > 0")
    return rows.select("language", F.explode_outer("accepted_by").alias("accepted_by")).groupBy("language", "accepted_by").agg(F.count(F.lit(1)).alias("n_files"))


QUERIES = {"p3_found": p3_found, "p3_files": p3_files, "p3_rates": p3_rates, "p3_accepted": p3_accepted}
SQL: dict[str, str] = {}
