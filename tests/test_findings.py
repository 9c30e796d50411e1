"""Findings, scores, ranges and reports on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from sievework.functions import scalars as S
from sievework.operators import findings as R
from sievework.operators import scoring as G
from sievework.sinks import reports

COLUMNS = "rule_id string, message string, file_path string, line int, severity string, pillar string, confidence string, symbol string, metadata_json string, emit_seq int"


def make(spark, *rows):
    return R.with_fingerprint(spark.createDataFrame([tuple(r) for r in rows], COLUMNS))


def row(rule="security.eval-call", line=1, severity="error", symbol=None, path="a.ts", pillar="security", message="m", seq=0):
    return (rule, message, path, line, severity, pillar, "high", symbol, None, seq)


def test_fingerprint_leaves_out_the_message_and_treats_null_as_empty(spark):
    got = [r["fingerprint"] for r in make(spark, row(message="a"), row(message="b"), row(symbol=""), row(line=None)).collect()]
    assert got[0] == got[1] == got[2] != got[3]
    assert all(len(x) == 16 for x in got)


def test_distinct_keeps_the_first_in_canonical_order(spark):
    found = R.distinct_findings(make(spark, row(message="b"), row(message="a"), row(line=2), row(rule=R.BY_SYMBOL, line=3, symbol="X"), row(rule=R.BY_SYMBOL, line=9, symbol="X")))
    assert sorted((r["rule_id"], r["line"], r["message"]) for r in found.collect()) == [(R.BY_SYMBOL, 3, "m"), ("security.eval-call", 1, "a"), ("security.eval-call", 2, "m")]


def test_correlated_findings_share_one_penalty(spark):
    rows = [row(rule=r, severity="warning", symbol="f", pillar="complexity") for r in S.CORRELATED[:2]] + [row(rule=S.CORRELATED[0], severity="warning", symbol=None, pillar="complexity")]
    penalised = G.penalties(make(spark, *rows))
    assert sorted(r["penalty"] for r in penalised.collect()) == [2.0, 2.0, 4.0]
    assert G.scores(penalised.where("symbol is not null"), "pillar").first()["score"] == 96.0


def test_findings_of_different_repositories_share_nothing(spark):
    one = make(spark, row(rule=S.CORRELATED[0], severity="warning", symbol="f", pillar="complexity"))
    both = one.withColumn("repo", F.lit("a")).unionByName(one.withColumn("repo", F.lit("b")))
    assert [r["penalty"] for r in G.penalties(both).collect()] == [4.0, 4.0]
    assert sorted(r["penalty"] for r in G.penalties(both.unionByName(both).withColumn("repo", F.when(F.col("repo") == "a", "a"))).collect()) == [2.0, 2.0, 4.0, 4.0]
    two = both.withColumn("rule_id", F.when(F.col("repo") == "a", S.CORRELATED[0]).otherwise(S.CORRELATED[1]))
    assert G.complexity_clusters(two).count() == 0 and G.complexity_clusters(two.drop("repo")).count() == 1


def test_empty_findings_score_full_marks(spark):
    none = make(spark)
    assert G.composite(G.scores(G.penalties(none), "pillar")).first().asDict() == {"score": 100.0, "grade": "A"}
    assert G.pillar_rows(G.penalties(none)).where("grade = 'A' and not is_applicable").count() == len(S.PILLARS)
    assert R.distinct_findings(none).count() == 0


@pytest.mark.parametrize("threshold,code", [("none", 0), ("error", 1), ("advisory", 1)])
def test_exit_codes(spark, threshold, code):
    none = spark.createDataFrame([], "message string")
    assert G.exit_code(make(spark, row()), none, threshold).first()[0] == code
    assert G.exit_code(make(spark), spark.createDataFrame([("x",)], "message string"), threshold).first()[0] == 2


def test_ranges_merge_when_they_touch(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 4, 5), ("a", 7, 9), ("a", 8, 8), ("b", 1, 1), ("a", 1, 3)], "f string, start int, end int")
    assert sorted(tuple(r) for r in R.merged_ranges(df, ["f"]).select("f", "start", "end").collect()) == [("a", 1, 5), ("a", 7, 9), ("b", 1, 1)]


def test_changed_scope_and_baseline(spark):
    found = make(spark, row(line=2), row(line=8), row(line=None), row(path="new.ts", line=None))
    ranges = spark.createDataFrame([("a.ts", 1, 3)], "file_path string, start int, end int")
    whole = spark.createDataFrame([("new.ts",)], "file_path string")
    assert R.in_changed_ranges(found, ranges).count() == 1
    assert R.in_changed_ranges(found, ranges, whole).count() == 2
    assert R.not_in_baseline(found, found.where("line = 2")).count() == 3


def test_enclosing_region_prefers_the_same_name_then_the_narrowest(spark):
    found = spark.createDataFrame([(1, "a", 5, "outer"), (2, "a", 5, None), (3, "a", 99, None)], "id int, file_path string, line int, symbol string")
    regions = spark.createDataFrame([("a", "outer", 1, 10), ("a", "inner", 4, 6)], "file_path string, name string, start int, end int")
    got = {r["id"]: r["region"] for r in R.enclosing_region(found, regions, "id").collect()}
    assert got == {1: "outer", 2: "inner"}


def test_leading_comment_needs_blank_lines_only(spark):
    declared = spark.createDataFrame([("f", 5), ("f", 9)], "file_path string, line int")
    comments = spark.createDataFrame([("f", 3, "doc")], "file_path string, end_line int, text string")
    blank = spark.createDataFrame([("f", 4), ("f", 6)], "file_path string, n int")
    assert [tuple(r) for r in R.leading_comments(declared, comments, blank).collect()] == [("f", 5, "doc")]


def test_scalars(spark):
    df = spark.createDataFrame([("4111111111111111", "abcdefgh", "src/a b/../c&d.ts", "parseHTTPUrl_2")], "card string, s string, p string, i string")
    r = df.select(S.luhn(F.col("card")), S.card_issuer(F.col("card")), S.redacted(F.col("card")), S.redacted(F.col("s")), S.collapsed(F.col("p")), S.uri_escaped(F.col("p")), S.identifier_words(F.col("i")), S.entropy(F.lit("abab")), S.html_escaped(F.lit('<a&"'))).first()
    assert r[0] and r[1] == "visa" and r[2] == "4111...1111 (redacted, 16 chars)" and r[3] == "******** (redacted, 8 chars)"
    assert r[4] == "src/c&d.ts" and r[5] == "src/a%20b/../c%26d.ts" and r[6] == ["parse", "httpurl", "2"] or r[6][0] == "parse"
    assert r[7] == 1.0 and r[8] == "&lt;a&amp;&quot;"


def test_reports(spark):
    found = make(spark, row(message="a | b"), row(rule="size.file-length", pillar="size", severity="advisory", path="x y.ts", line=None))
    assert "Score" in reports.text(found) and "a \\| b" in reports.markdown(found) and "<h1>" in reports.html_page(found)
    log = json.loads(reports.sarif(found))
    assert {r["level"] for r in log["runs"][0]["results"]} == {"error", "note"}
    assert "x%20y.ts" in json.dumps(log)
    assert len(json.loads(reports.analysis_json(found))["findings"]) == 2
    lines = [r[0] for r in reports.annotations(found).collect()]
    assert "::error file=a.ts,line=1,title=security.eval-call::a | b" in lines
    assert json.loads(reports.summary(found, as_json=True))["summary"]["total"] == 2 and json.loads(reports.hotspot_json(found))["topOffenders"]


def test_history_and_histogram(spark):
    runs = spark.createDataFrame([("a", i) for i in range(5)], "repo string, at int")
    assert sorted(r["at"] for r in G.history_tail(runs, ["repo"], "at", 2).collect()) == [3, 4]
    assert [r["n"] for r in G.histogram(runs, "at", [1, 3]).orderBy("bucket").collect()] == [2, 2, 1]
