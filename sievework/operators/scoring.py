"""Scores, grades, pivots and rankings of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import scalars as S


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings per key, and by severity; counts combine before the shuffle, so hot keys do no harm."""
    counted = findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("advisory", "warning", "error")])
    return counted


def penalties(findings: DataFrame, correlated: tuple[str, ...] | Column = S.CORRELATED) -> DataFrame:
    """Adds ``penalty``: the weight of the severity; correlated findings on one symbol and line of a file share the largest.

    ``correlated`` names the rules that correlate, or is a condition. Files of different repositories are different files:
    where there is a column ``repo``, it belongs to the place, and a finding whose repository, file, symbol or line is null
    or empty shares with none. The shares come from an aggregate over the places of correlated findings, which alone are
    joined with it; all others pass by, neither sorted nor moved.
    """
    own = S.weight(F.col("severity"))
    place = [c for c in ("repo", "file_path", "symbol", "line") if c in findings.columns]
    known = F.col("line").isNotNull() & (F.col("line") != 0) & (F.col("symbol") != "")
    for c in place:
        known = known & F.col(c).isNotNull()
    rule = correlated if isinstance(correlated, Column) else F.col("rule_id").isin(*correlated)
    shares = F.coalesce(rule & known, F.lit(False))
    shared = findings.where(shares).groupBy(*place).agg((F.max(own) / F.count(F.lit(1))).alias("_shared"), F.count(F.lit(1)).alias("_n")).where("_n >= 2").drop("_n")
    joined = findings.where(shares).join(shared, place, "left").withColumn("penalty", F.coalesce("_shared", own)).drop("_shared")
    return findings.where(~shares).withColumn("penalty", own).unionByName(joined.select(*findings.columns, "penalty"))


def scores(penalised: DataFrame, *keys: str) -> DataFrame:
    """100 less all penalties of the key, but not below 0."""
    return penalised.groupBy(*keys).agg(F.greatest(F.lit(0.0), 100 - F.sum("penalty")).alias("score"))


def composite(pillar_scores: DataFrame) -> DataFrame:
    """Mean of the scores of pillars that have findings; 100 if none has."""
    mean = F.coalesce(F.avg("score"), F.lit(100.0))
    return pillar_scores.agg(mean.alias("score")).withColumn("grade", S.grade(F.col("score")))


def pillar_rows(penalised: DataFrame) -> DataFrame:
    """One row for each pillar of the catalogue, also for those without findings (A, 100, no penalty)."""
    spark = penalised.sparkSession
    domain = spark.createDataFrame([(p,) for p in S.PILLARS], "pillar string")
    counted = penalised.groupBy("pillar").agg(F.count(F.lit(1)).alias("findings"), F.sum("penalty").alias("penalty"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("advisory", "warning", "error")])
    rows = domain.join(counted, "pillar", "left").na.fill(0)
    score = F.greatest(F.lit(0.0), 100 - F.col("penalty"))
    return rows.withColumns({"score": score, "grade": S.grade(score), "is_applicable": F.col("findings") > 0})


def severity_grades(findings: DataFrame) -> DataFrame:
    """Per severity: findings and the grade of 100 less their weights; nothing is shared here."""
    spark = findings.sparkSession
    domain = spark.createDataFrame([(s, float(w)) for s, w in S.WEIGHTS.items()], "severity string, weight double")
    counted = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))
    score = F.greatest(F.lit(0.0), 100 - F.col("findings") * F.col("weight"))
    return domain.join(counted, "severity", "left").na.fill(0).select("severity", "findings", score.alias("score"), S.grade(score).alias("grade"))


def offenders(penalised: DataFrame, *keys: str) -> DataFrame:
    """Files by score, the worst first; ties in the order of the path."""
    return scores(penalised, *keys).orderBy("score", *keys)


def top_rules(findings: DataFrame, n: int = 10) -> DataFrame:
    """A report of the n rules with most findings; ties by rule id."""
    return findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings")).orderBy(F.desc("findings"), "rule_id").limit(n)


def complexity_clusters(findings: DataFrame, correlated: tuple[str, ...] | Column = S.CORRELATED) -> DataFrame:
    """Symbols of a file on which at least two of the correlated rules meet, whatever the line."""
    rule = correlated if isinstance(correlated, Column) else F.col("rule_id").isin(*correlated)
    some = findings.where(rule & F.col("symbol").isNotNull())
    place = [c for c in ("repo", "file_path", "symbol") if c in findings.columns]
    return some.groupBy(*place).agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids")).where(F.size("rule_ids") >= 2)


def exit_code(findings: DataFrame, diagnostics: DataFrame, threshold: str) -> DataFrame:
    """2 with any diagnostic, else 1 with any finding at or above the threshold, else 0."""
    at_or_above = F.lit(False) if threshold == "none" else S.severity_rank(F.col("severity")) >= S.SEVERITIES.index(threshold)
    hit = findings.agg(F.coalesce(F.max(F.when(at_or_above, 1)), F.lit(0)).alias("code"))
    bad = diagnostics.agg(F.when(F.count(F.lit(1)) > 0, 2).otherwise(0).alias("code"))
    return hit.unionByName(bad).agg(F.max("code").alias("exit_code"))


def verdict(findings: DataFrame) -> DataFrame:
    """Warnings and errors, and the pillars they lie in."""
    grave = F.col("severity").isin("warning", "error")
    return findings.agg(F.count_if(grave).alias("grave"), F.count_distinct(F.when(grave, F.col("pillar"))).alias("pillars"))


def severity_cube(findings: DataFrame) -> DataFrame:
    """Counts for each pillar and severity with all subtotals in one pass."""
    return findings.cube("pillar", "severity").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("findings"))


def history_tail(runs: DataFrame, keys: list[str], order: str, keep: int = 100) -> DataFrame:
    """The last ``keep`` runs of each key; a bounded history is the feature."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return runs.withColumn("_n", last).where(F.col("_n") <= keep).drop("_n")


def histogram(values: DataFrame, column: str, edges: list[int]) -> DataFrame:
    """Counts of a number in buckets up to each edge and one beyond; empty buckets are listed with 0."""
    spark = values.sparkSession
    labels = [*[f"<= {e}" for e in edges], f"> {edges[-1]}"]
    bucket = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        bucket = F.when(F.col(column) <= edges[i], i).otherwise(bucket)
    counted = values.where(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    domain = spark.createDataFrame(list(enumerate(labels)), "bucket int, label string")
    return domain.join(counted, "bucket", "left").na.fill(0).select("bucket", "label", "n")
