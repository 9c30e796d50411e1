"""The findings relation: projection, order, distinct-on, baseline, and scoping to changed regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import scalars as S

COLUMNS = ("rule_id", "message", "file_path", "line", "severity", "pillar", "confidence", "symbol", "metadata_json", "emit_seq")
# The rule that is told apart by its symbol and not by its fingerprint.
BY_SYMBOL = "docs.missing-public-doc"


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", S.fingerprint(F.col("rule_id"), F.col("file_path"), F.col("line"), F.col("symbol")))


def canonical_order(collated: bool = True) -> list[Column]:
    """File (by the collation of the Unicode standard), line (null as 0), rule, message, and order of emission."""
    path = F.collate("file_path", "UNICODE") if collated else F.col("file_path")
    return [path, F.coalesce("line", F.lit(0)), F.col("rule_id"), F.col("message"), F.col("emit_seq")]


def distinct_findings(findings: DataFrame, scope: list[str] = (), collated: bool = True) -> DataFrame:
    """The first finding of each fingerprint in canonical order; within ``scope`` columns if there are any. Nulls come first.

    An aggregate that combines before the shuffle, so that repeats are neither sorted nor moved; a file or rule that holds
    a third of all rows is spread by the fingerprint.
    """
    key = F.when(F.col("rule_id") == BY_SYMBOL, F.concat_ws("\0", "rule_id", "file_path", F.coalesce("symbol", F.lit("")))).otherwise(F.col("fingerprint"))
    names = findings.columns
    order = F.struct(*[F.struct(c.isNotNull(), c) for c in canonical_order(collated)])
    keyed = findings.select(*[F.col(c).alias(f"_scope{i}") for i, c in enumerate(scope)], key.alias("_key"), F.struct(*names).alias("_row"), order.alias("_order"))
    first = keyed.groupBy(*[f"_scope{i}" for i in range(len(scope))], "_key").agg(F.min_by("_row", "_order").alias("_row"))
    return first.select(*[F.col(f"_row.{c}").alias(c) for c in names])


def not_in_baseline(findings: DataFrame, baseline: DataFrame, keys: tuple[str, ...] = ("fingerprint", "rule_id", "file_path")) -> DataFrame:
    """Findings that the baseline does not list; messages are not compared. Which side is broadcast, if any, is left to
    the planner and its size threshold."""
    return findings.join(baseline.select(*keys).distinct(), list(keys), "left_anti")


def enabled(findings: DataFrame, disabled_rules: list[str]) -> DataFrame:
    return findings.where(~F.col("rule_id").isin(disabled_rules)) if disabled_rules else findings


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings at or above a severity; "none" lets nothing pass."""
    if severity == "none":
        return findings.where(F.lit(False))
    return findings.where(S.severity_rank(F.col("severity")) >= S.SEVERITIES.index(severity))


def merged_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping and adjacent ranges [start, end] of each key as one: gaps and islands by a running maximum."""
    ordered = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", (reach.isNull() | (F.col("start") > reach + 1)).cast("int"))
    island = marked.withColumn("_island", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def in_changed_ranges(findings: DataFrame, ranges: DataFrame, whole_files: DataFrame | None = None, keys: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """Findings whose lines overlap a changed range of their file, or whose file is changed as a whole.

    An equi join on the file with the overlap as residual. A finding without line belongs to the whole file.
    """
    f, r = findings.alias("f"), ranges.alias("r")
    same = [F.col(f"f.{k}") == F.col(f"r.{k}") for k in keys]
    hit = f.join(r, [*same, F.col("f.line") <= F.col("r.end"), F.col("f.line") >= F.col("r.start")], "left_semi")
    if whole_files is None:
        return hit
    w = whole_files.alias("w")
    whole = [F.col(f"f.{k}") == F.col(f"w.{k}") for k in keys]
    return f.join(w, whole, "left_semi").unionByName(hit.alias("f").join(w, whole, "left_anti"))


# Rules whose findings on line 1 speak of the whole file. Fixed values.
FILE_WIDE = ("design.large-module-concentration", "docs.missing-file-overview", "size.file-length")


def in_scope(findings: DataFrame, ranges: DataFrame, whole_files: DataFrame | None = None, regions: DataFrame | None = None, keys: tuple[str, ...] = ("repo", "file_path")) -> DataFrame:
    """Findings that a change touches: whose file is new as a whole, whose lines overlap a changed range (a finding without
    line stands on line 1), that speak of the whole of a changed file, or, with ``regions``, whose innermost declaration
    overlaps a changed range. Findings have a fingerprint, unique within ``keys``."""
    placed = findings.withColumn("_line", F.col("line")).withColumn("line", F.coalesce("line", F.lit(1)))
    wide = F.col("rule_id").isin(*FILE_WIDE) & (F.col("_line") == 1) & F.col("symbol").isNull()
    hit = in_changed_ranges(placed, ranges, whole_files, keys).unionByName(placed.where(wide).join(ranges.select(*keys).distinct(), list(keys), "left_semi"))
    if regions is not None:
        around = enclosing_region(placed, regions, "fingerprint", keys).select(*keys, F.col("fingerprint"), F.col("region_start").alias("start"), F.col("region_end").alias("end"))
        d, r = around.alias("d"), ranges.alias("r")
        changed = d.join(r, [*[F.col(f"d.{k}") == F.col(f"r.{k}") for k in keys], F.col("d.start") <= F.col("r.end"), F.col("d.end") >= F.col("r.start")], "left_semi").select(*keys, "fingerprint")
        hit = hit.unionByName(placed.join(changed, [*keys, "fingerprint"], "left_semi"))
    names = [*keys, "fingerprint"]
    return findings.join(hit.select(*names).distinct(), names, "left_semi")


def enclosing_region(findings: DataFrame, regions: DataFrame, key: str, keys: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """The declaration around each finding: one of the same name first, else the narrowest. Findings outside of all
    regions are left out. Regions: keys, name, start, end; ``key`` tells findings apart."""
    f, r = findings.alias("f"), regions.alias("r")
    same = [*[F.col(f"f.{k}") == F.col(f"r.{k}") for k in keys], F.col("f.line").between(F.col("r.start"), F.col("r.end"))]
    span = F.col("r.end") - F.col("r.start")
    named = F.coalesce((F.col("f.symbol") == F.col("r.name")).cast("int"), F.lit(0))
    best = F.min_by(F.struct(F.col("r.name").alias("name"), F.col("r.start").alias("start"), F.col("r.end").alias("end")), F.struct(-named, span, F.col("r.start"), F.col("r.name")))
    scope = [k for k in keys if k != key]
    return f.join(r, same).groupBy(F.col(f"f.{key}").alias(key), *[F.col(f"f.{k}").alias(k) for k in scope]).agg(best.alias("_r")).select(key, *scope, F.col("_r.name").alias("region"), F.col("_r.start").alias("region_start"), F.col("_r.end").alias("region_end"))


def leading_comments(declarations: DataFrame, comments: DataFrame, blank_lines: DataFrame, keys: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """As-of join: the latest comment that ends above a declaration with nothing but blank lines between.

    ``declarations``: keys, line; ``comments``: keys, end_line, text; ``blank_lines``: keys, n. Each gap has to be filled
    by blank lines, of which there are as many as the distance says.
    """
    both = declarations.select(*keys, F.col("line").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("text"))
    both = both.unionByName(comments.select(*keys, F.col("end_line").alias("_at"), F.lit(0).alias("_kind"), "text"))
    both = both.unionByName(blank_lines.select(*keys, F.col("n").alias("_at"), F.lit(-1).alias("_kind"), F.lit(None).cast("string").alias("text")))
    up = Window.partitionBy(*keys).orderBy("_at", F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    is_comment = F.col("_kind") == 0
    seen = both.withColumns(
        {
            "_end": F.last(F.when(is_comment, F.col("_at")), True).over(up),
            "comment": F.last(F.when(is_comment, F.col("text")), True).over(up),
            "_blank": F.sum(F.when(F.col("_kind") == -1, 1).otherwise(0)).over(up),
        }
    )
    seen = seen.withColumn("_blank_at_end", F.last(F.when(is_comment, F.coalesce("_blank", F.lit(0))), True).over(up))
    rows = seen.where("_kind = 1")
    filled = F.col("_at") - F.col("_end") - 1 == F.col("_blank") - F.col("_blank_at_end")
    return rows.where(filled).select(*keys, F.col("_at").alias("line"), "comment")
