"""Queries over the findings, their deliveries and their places in code, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import scalars as S
from sievework.operators import findings as R
from sievework.operators import scoring as G
from sievework.shared import table

WEIGHT_SQL = "CASE severity WHEN 'advisory' THEN 1.5::DOUBLE WHEN 'warning' THEN 4.0::DOUBLE WHEN 'error' THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END"
GRADE_SQL = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END"
# The tables' rules are invented, so the pillars of the correlated rules stand in for these: places where they meet exist.
CORRELATED_PILLARS = ("complexity", "size", "maintainability", "test-quality", "security")
PILLARS_SQL = ", ".join(f"'{p}'" for p in CORRELATED_PILLARS)
PENALTY_SQL = f"""w AS (SELECT row_number() OVER () AS i, {WEIGHT_SQL} AS own, * FROM findings),
  g AS (SELECT repo, file_path, symbol, line, count(*) AS n, max(own) AS most FROM w
        WHERE pillar IN ({PILLARS_SQL}) AND repo IS NOT NULL AND file_path IS NOT NULL AND symbol <> '' AND line <> 0 GROUP BY ALL HAVING count(*) > 1),
  p AS (SELECT w.*, CASE WHEN g.n IS NULL THEN own ELSE most / n END AS penalty FROM w LEFT JOIN g
        ON w.pillar IN ({PILLARS_SQL}) AND g.repo = w.repo AND g.file_path = w.file_path AND g.symbol = w.symbol AND g.line = w.line)"""


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "findings")


def _penalised(spark: SparkSession, folder: str) -> DataFrame:
    return G.penalties(_findings(spark, folder), F.col("pillar").isin(*CORRELATED_PILLARS))


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    own = S.fingerprint(F.col("rule_id"), F.col("file_path"), F.col("line"), F.col("symbol"))
    return _findings(spark, folder).groupBy(own.alias("place")).agg(F.count(F.lit(1)).alias("n"))


def distinct_findings(spark: SparkSession, folder: str) -> DataFrame:
    rows = _findings(spark, folder).withColumn("emit_seq", F.struct("emit_seq", "received_at"))
    return R.distinct_findings(rows, ["repo"], collated=False).select("repo", "fingerprint", "finding_id", "rule_id", "file_path", "line")


def severity_summary(spark: SparkSession, folder: str) -> DataFrame:
    return G.severity_counts(_findings(spark, folder))


def rule_severities(spark: SparkSession, folder: str) -> DataFrame:
    return G.severity_counts(_findings(spark, folder), "rule_id")


def pillar_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = G.pillar_rows(_penalised(spark, folder))
    return rows.select("pillar", "grade", "score", "penalty", "is_applicable", "findings", "advisory", "warning", "error")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return pillar_table(spark, folder).orderBy(F.desc("findings"), "pillar")


def composite_score(spark: SparkSession, folder: str) -> DataFrame:
    return G.composite(G.scores(_penalised(spark, folder), "pillar"))


def severity_grades(spark: SparkSession, folder: str) -> DataFrame:
    return G.severity_grades(_findings(spark, folder))


def top_offenders(spark: SparkSession, folder: str) -> DataFrame:
    return G.scores(_penalised(spark, folder), "repo", "file_path").withColumn("grade", S.grade(F.col("score")))


def top_rules(spark: SparkSession, folder: str) -> DataFrame:
    return G.top_rules(_findings(spark, folder))


def complexity_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols of a file on which several rules meet. All of the tables' invented rules take part: symbols hardly repeat."""
    return G.complexity_clusters(_findings(spark, folder), F.col("rule_id").isNotNull()).withColumn("rule_ids", F.array_join("rule_ids", ","))


def rule_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Findings whose severity differs from their rule's, and those of unknown rules, per rule."""
    rules = table(spark, folder, "rules").select("rule_id", F.col("severity").alias("listed"), "description")
    joined = _findings(spark, folder).join(rules, "rule_id", "left")
    differs = ~F.col("severity").eqNullSafe(F.col("listed"))
    return joined.groupBy("rule_id", "listed", "description").agg(F.count(F.lit(1)).alias("n"), F.count_if(differs).alias("n_differs"))


def new_since_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Findings that the first delivery of their repository's snapshots does not list."""
    snapshots = table(spark, folder, "finding_snapshots")
    first = snapshots.groupBy("repo").agg(F.min("snapshot_no").alias("snapshot_no"))
    baseline = snapshots.join(first, ["repo", "snapshot_no"], "left_semi").where(F.col("fingerprint").isNotNull()).withColumn("fingerprint", F.lower("fingerprint"))
    fresh = R.not_in_baseline(_findings(spark, folder), baseline, ("repo", "fingerprint", "rule_id", "file_path"))
    return fresh.groupBy("repo").agg(F.count(F.lit(1)).alias("n_new"))


def _ranges(spark: SparkSession, folder: str) -> DataFrame:
    blocks = table(spark, folder, "blocks").join(table(spark, folder, "files").select("file_id", "repo").distinct(), "file_id")
    return blocks.select("repo", F.col("display_path").alias("file_path"), F.col("start_line").alias("start"), (F.col("start_line") + F.col("line_count") - 1).alias("end"), "name").distinct()


def merged_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return R.merged_ranges(_ranges(spark, folder).drop("name"), ["repo", "file_path"])


def changed_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Findings on lines of known blocks."""
    return R.in_changed_ranges(_findings(spark, folder), _ranges(spark, folder), keys=("repo", "file_path")).select("finding_id", "received_at", "repo", "file_path", "line")


def enclosing_blocks(spark: SparkSession, folder: str) -> DataFrame:
    unique = _findings(spark, folder).select("finding_id", "repo", "file_path", "line", "symbol").distinct()
    return R.enclosing_region(unique, _ranges(spark, folder).where(F.col("name").isNotNull()), "finding_id", ("repo", "file_path")).drop("repo", "file_path")


def severity_cube(spark: SparkSession, folder: str) -> DataFrame:
    return G.severity_cube(_findings(spark, folder))


def history(spark: SparkSession, folder: str) -> DataFrame:
    """The last 20 days with findings of each repository, as runs of a history."""
    runs = _findings(spark, folder).groupBy("repo", F.to_date("emitted_at").alias("day")).agg(F.count(F.lit(1)).alias("findings"))
    return G.history_tail(runs, ["repo"], "day", 20)


def exit_codes(spark: SparkSession, folder: str) -> DataFrame:
    none = spark.createDataFrame([], "message string")
    rows = [G.exit_code(_findings(spark, folder), none, t).withColumn("threshold", F.lit(t)) for t in ("none", "warning", "error")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def verdict(spark: SparkSession, folder: str) -> DataFrame:
    return G.verdict(_findings(spark, folder))


def line_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return G.histogram(_findings(spark, folder), "line", [50, 100, 200, 400])


def leading_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Declarations of lines of code with the comment line right above them, blank lines apart."""
    lines = table(spark, folder, "code_lines").select("file_id", "n", "line").distinct()
    text = F.trim(F.regexp_replace("line", "[\r\t]", " "))
    slim = lines.select("file_id", "n", text.alias("t"))
    comments = slim.where(F.col("t").startswith("//")).select("file_id", F.col("n").alias("end_line"), F.col("t").alias("text"))
    blank = slim.where(F.col("t") == "").select("file_id", "n")
    declared = slim.where(F.col("t").startswith("export ") | F.col("t").startswith("function ")).select("file_id", F.col("n").alias("line"))
    return R.leading_comments(declared, comments, blank, ("file_id",))


def secret_previews(spark: SparkSession, folder: str) -> DataFrame:
    """Redacted previews, length and entropy of symbols, as for secrets."""
    symbols = _findings(spark, folder).where(F.col("symbol").isNotNull()).select("symbol").distinct()
    return symbols.select("symbol", S.redacted(F.col("symbol")).alias("preview"), F.round(S.entropy(F.col("symbol")), 6).alias("bits"))


def identifier_words(spark: SparkSession, folder: str) -> DataFrame:
    words = F.explode(S.identifier_words(F.col("symbol")))
    return _findings(spark, folder).where(F.col("symbol").isNotNull()).select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def card_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Card numbers in texts, by issuer; check digit and prefix decide."""
    runs = F.explode(F.regexp_extract_all("text", F.lit(r"([0-9](?:[ -]?[0-9]){12,18})"), F.lit(1)))
    numbers = table(spark, folder, "documents").select(runs.alias("raw")).select(F.regexp_replace("raw", "[ -]", "").alias("number"))
    issued = numbers.where(S.luhn(F.col("number"))).withColumn("issuer", S.card_issuer(F.col("number")))
    return issued.where(F.col("issuer").isNotNull()).groupBy("issuer").agg(F.count(F.lit(1)).alias("n"))


def file_lengths(spark: SparkSession, folder: str) -> DataFrame:
    lines = F.regexp_count("text", F.lit("\n")) + 1
    return table(spark, folder, "files").where(F.col("text").isNotNull()).select("file_id", "ingested_at", lines.cast("long").alias("n_lines"))


def casing_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of texts that a source spells in several ways, as the naming rules look at identifiers."""
    rows = table(spark, folder, "documents").where(F.col("lang").isNotNull() & F.col("source").isNotNull())
    grouped = rows.groupBy("source", S.normal_identifier(F.col("lang")).alias("key")).agg(F.count_distinct("lang").alias("spellings"))
    return grouped.where("spellings >= 2")


def metadata_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers in the metadata of findings, per field."""
    parsed = F.from_json("metadata_json", "map<string,long>")
    pairs = _findings(spark, folder).where(F.col("metadata_json").isNotNull()).select(F.explode(parsed).alias("field", "value"))
    return pairs.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def undocumented_params(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters without tag and tags without parameter, per documented export."""
    rows = table(spark, folder, "doc_exports")
    missing = F.explode_outer(F.array_except("params", "param_tags"))
    stale = F.explode_outer(F.array_except("param_tags", "params"))
    a = rows.select("file_id", "name", "line", F.lit("missing").alias("kind"), missing.alias("param"))
    b = rows.select("file_id", "name", "line", F.lit("stale").alias("kind"), stale.alias("param"))
    return a.unionByName(b).where(F.col("param").isNotNull()).distinct()


QUERIES = {
    "fingerprints": fingerprints, "distinct_findings": distinct_findings, "severity_summary": severity_summary, "rule_severities": rule_severities, "pillar_table": pillar_table, "composite_score": composite_score,
    "severity_grades": severity_grades, "top_offenders": top_offenders, "top_rules": top_rules, "complexity_clusters": complexity_clusters, "rule_metadata": rule_metadata, "new_since_baseline": new_since_baseline,
    "merged_ranges": merged_ranges, "changed_scope": changed_scope, "enclosing_blocks": enclosing_blocks, "severity_cube": severity_cube, "history": history, "exit_codes": exit_codes, "verdict": verdict,
    "line_histogram": line_histogram, "leading_comments": leading_comments, "secret_previews": secret_previews, "identifier_words": identifier_words, "card_numbers": card_numbers, "file_lengths": file_lengths,
    "casing_groups": casing_groups, "metadata_fields": metadata_fields, "undocumented_params": undocumented_params,
}

RANGES_SQL = "r AS (SELECT DISTINCT f.repo, b.display_path AS file_path, b.start_line AS s, b.start_line + b.line_count - 1 AS e, b.name FROM blocks b JOIN (SELECT DISTINCT file_id, repo FROM files) f USING (file_id))"
COUNTS_SQL = "count(*) AS total, count_if(severity = 'advisory')::BIGINT AS advisory, count_if(severity = 'warning')::BIGINT AS warning, count_if(severity = 'error')::BIGINT AS error"
DOMAIN_SQL = ", ".join(f"('{p}')" for p in S.PILLARS)

SQL = {
    "fingerprints": "SELECT substr(sha256(concat_ws(chr(0), coalesce(rule_id, ''), coalesce(file_path, ''), coalesce(line::VARCHAR, ''), coalesce(symbol, ''))), 1, 16) AS place, count(*) AS n FROM findings GROUP BY ALL",
    "distinct_findings": """SELECT repo, fingerprint, finding_id, rule_id, file_path, line FROM findings
        QUALIFY row_number() OVER (PARTITION BY repo, fingerprint ORDER BY file_path NULLS FIRST, coalesce(line, 0), rule_id NULLS FIRST, message NULLS FIRST, emit_seq, received_at) = 1""",
    "severity_summary": f"SELECT {COUNTS_SQL} FROM findings",
    "rule_severities": f"SELECT rule_id, {COUNTS_SQL} FROM findings GROUP BY rule_id",
    "pillar_table": f"""WITH {PENALTY_SQL}, c AS (SELECT pillar, count(*) AS findings, sum(penalty) AS penalty, count_if(severity = 'advisory')::BIGINT AS advisory, count_if(severity = 'warning')::BIGINT AS warning, count_if(severity = 'error')::BIGINT AS error FROM p GROUP BY pillar),
        d AS (SELECT * FROM (VALUES {DOMAIN_SQL}) AS v(pillar)),
        j AS (SELECT d.pillar, coalesce(findings, 0) AS findings, coalesce(penalty, 0.0::DOUBLE) AS penalty, coalesce(advisory, 0) AS advisory, coalesce(warning, 0) AS warning, coalesce(error, 0) AS error FROM d LEFT JOIN c USING (pillar)),
        s AS (SELECT *, greatest(0.0, 100 - penalty) AS score FROM j)
        SELECT pillar, {GRADE_SQL} AS grade, score, penalty, findings > 0 AS is_applicable, findings, advisory, warning, error FROM s""",
    "composite_score": f"WITH {PENALTY_SQL}, s AS (SELECT pillar, greatest(0.0, 100 - sum(penalty)) AS score FROM p GROUP BY pillar), c AS (SELECT coalesce(avg(score), 100.0) AS score FROM s) SELECT score, {GRADE_SQL} AS grade FROM c",
    "severity_grades": f"WITH d AS (SELECT * FROM (VALUES ('advisory', 1.5::DOUBLE), ('warning', 4.0::DOUBLE), ('error', 8.0::DOUBLE)) AS v(severity, w)), j AS (SELECT d.severity, count(f.finding_id) AS findings, greatest(0.0, 100 - count(f.finding_id) * any_value(w)) AS score FROM d LEFT JOIN findings f USING (severity) GROUP BY d.severity) SELECT severity, findings, score, {GRADE_SQL} AS grade FROM j",
    "top_offenders": f"WITH {PENALTY_SQL}, s AS (SELECT repo, file_path, greatest(0.0, 100 - sum(penalty)) AS score FROM p GROUP BY repo, file_path) SELECT *, {GRADE_SQL} AS grade FROM s",
    "top_rules": "SELECT rule_id, count(*) AS findings FROM findings GROUP BY rule_id ORDER BY findings DESC, rule_id LIMIT 10",
    "complexity_clusters": "SELECT repo, file_path, symbol, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rule_ids FROM findings WHERE symbol IS NOT NULL AND rule_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT rule_id) >= 2",
    "rule_metadata": "SELECT f.rule_id, r.severity AS listed, r.description, count(*) AS n, count_if(f.severity IS DISTINCT FROM r.severity)::BIGINT AS n_differs FROM findings f LEFT JOIN rules r USING (rule_id) GROUP BY ALL",
    "new_since_baseline": """WITH b AS (SELECT s.repo, lower(fingerprint) AS fp, rule_id, file_path FROM finding_snapshots s JOIN (SELECT repo, min(snapshot_no) AS m FROM finding_snapshots GROUP BY repo) x ON s.repo = x.repo AND s.snapshot_no = x.m WHERE fingerprint IS NOT NULL)
        SELECT f.repo, count(*) AS n_new FROM findings f WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.repo = f.repo AND b.fp = f.fingerprint AND b.rule_id = f.rule_id AND b.file_path = f.file_path) GROUP BY f.repo""",
    "merged_ranges": f"""WITH {RANGES_SQL}, u AS (SELECT DISTINCT repo, file_path, s, e FROM r),
        m AS (SELECT *, max(e) OVER (PARTITION BY repo, file_path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u),
        i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY repo, file_path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
        SELECT repo, file_path, min(s) AS start, max(e) AS "end" FROM i GROUP BY repo, file_path, island""",
    "changed_scope": f"WITH {RANGES_SQL} SELECT finding_id, received_at, repo, file_path, line FROM findings f WHERE EXISTS (SELECT 1 FROM r WHERE r.repo = f.repo AND r.file_path = f.file_path AND f.line BETWEEN r.s AND r.e)",
    "enclosing_blocks": f"""WITH {RANGES_SQL}, f AS (SELECT DISTINCT finding_id, repo, file_path, line, symbol FROM findings)
        SELECT f.finding_id, r.name AS region, r.s AS region_start, r.e AS region_end FROM f JOIN r ON r.repo = f.repo AND r.file_path = f.file_path AND f.line BETWEEN r.s AND r.e WHERE r.name IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY f.finding_id ORDER BY coalesce((f.symbol = r.name)::INT, 0) DESC, r.e - r.s, r.s, r.name) = 1""",
    "severity_cube": "SELECT pillar, severity, grouping_id(pillar, severity) AS level, count(*) AS findings FROM findings GROUP BY CUBE (pillar, severity)",
    "history": "SELECT * FROM (SELECT repo, emitted_at::DATE AS day, count(*) AS findings FROM findings GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY day DESC) <= 20",
    "exit_codes": "SELECT 'none' AS threshold, 0 AS exit_code UNION ALL SELECT 'warning', (count_if(severity IN ('warning', 'error')) > 0)::INT FROM findings UNION ALL SELECT 'error', (count_if(severity = 'error') > 0)::INT FROM findings",
    "verdict": "SELECT count_if(severity IN ('warning', 'error'))::BIGINT AS grave, count(DISTINCT pillar) FILTER (severity IN ('warning', 'error')) AS pillars FROM findings",
    "line_histogram": "WITH d AS (SELECT * FROM (VALUES (0, '<= 50', -1, 50), (1, '<= 100', 50, 100), (2, '<= 200', 100, 200), (3, '<= 400', 200, 400), (4, '> 400', 400, 2000000000)) AS v(bucket, label, lo, hi)) SELECT bucket, label, count(f.line) AS n FROM d LEFT JOIN findings f ON f.line > lo AND f.line <= hi GROUP BY bucket, label",
    "leading_comments": r"""WITH l AS (SELECT DISTINCT file_id, n, line FROM code_lines), t AS (SELECT file_id, n, trim(regexp_replace(line, '[\r\t]', ' ', 'g')) AS t FROM l),
        d AS (SELECT file_id, n FROM t WHERE t LIKE 'export %' OR t LIKE 'function %'), c AS (SELECT file_id, n, t FROM t WHERE t LIKE '//%'), b AS (SELECT file_id, n FROM t WHERE t = ''),
        j AS (SELECT d.file_id, d.n AS line, max_by(c.t, c.n) AS comment, max(c.n) AS above FROM d JOIN c ON c.file_id = d.file_id AND c.n < d.n GROUP BY ALL)
        SELECT file_id, line, comment FROM j WHERE line - above - 1 = (SELECT count(*) FROM b WHERE b.file_id = j.file_id AND b.n > j.above AND b.n < j.line)""",
    "secret_previews": """WITH s AS (SELECT DISTINCT symbol FROM findings WHERE symbol IS NOT NULL), c AS (SELECT symbol, unnest(string_split(symbol, '')) AS ch FROM s), k AS (SELECT symbol, ch, count(*) AS n FROM c GROUP BY ALL), e AS (SELECT symbol, round(-sum(n / length(symbol) * log2(n / length(symbol))), 6) AS bits FROM k GROUP BY symbol)
        SELECT symbol, CASE WHEN length(symbol) <= 8 THEN repeat('*', length(symbol)) ELSE left(symbol, 4) || '...' || right(symbol, 4) END || ' (redacted, ' || length(symbol) || ' chars)' AS preview, bits FROM s JOIN e USING (symbol)""",
    "identifier_words": r"SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(regexp_replace(symbol, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+')) AS word FROM findings WHERE symbol IS NOT NULL) WHERE word <> '' GROUP BY word",
    "card_numbers": """WITH n AS (SELECT regexp_replace(unnest(regexp_extract_all(text, '[0-9](?:[ -]?[0-9]){12,18}')), '[ -]', '', 'g') AS d FROM documents),
        c AS (SELECT d, list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN substr(d, i, 1)::INT ELSE (substr(d, i, 1)::INT * 2) // 10 + (substr(d, i, 1)::INT * 2) % 10 END)) AS total FROM n),
        i AS (SELECT CASE WHEN d LIKE '4%' AND length(d) IN (13, 16, 19) THEN 'visa' WHEN length(d) = 16 AND (left(d, 2)::INT BETWEEN 51 AND 55 OR left(d, 4)::INT BETWEEN 2221 AND 2720) THEN 'mastercard' WHEN length(d) = 15 AND left(d, 2) IN ('34', '37') THEN 'amex'
          WHEN length(d) IN (16, 19) AND (d LIKE '6011%' OR d LIKE '65%' OR left(d, 3)::INT BETWEEN 644 AND 649) THEN 'discover' WHEN length(d) = 14 AND (left(d, 3)::INT BETWEEN 300 AND 305 OR left(d, 2) IN ('36', '38', '39')) THEN 'diners' WHEN length(d) BETWEEN 16 AND 19 AND left(d, 4)::INT BETWEEN 3528 AND 3589 THEN 'jcb' END AS issuer FROM c WHERE total % 10 = 0)
        SELECT issuer, count(*) AS n FROM i WHERE issuer IS NOT NULL GROUP BY issuer""",
    "file_lengths": "SELECT file_id, ingested_at, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM files WHERE text IS NOT NULL",
    "casing_groups": "SELECT source, lower(regexp_replace(lang, '[^A-Za-z0-9]', '', 'g')) AS key, count(DISTINCT lang) AS spellings FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL HAVING count(DISTINCT lang) >= 2",
    "metadata_fields": "SELECT field, count(*) AS n, sum(json_extract(metadata_json, '$.' || field)::BIGINT)::BIGINT AS total FROM (SELECT metadata_json, unnest(json_keys(metadata_json)) AS field FROM findings WHERE metadata_json IS NOT NULL) GROUP BY field",
    "undocumented_params": "SELECT DISTINCT file_id, name, line, 'missing' AS kind, unnest(list_filter(params, lambda x: NOT list_contains(param_tags, x))) AS param FROM doc_exports UNION SELECT DISTINCT file_id, name, line, 'stale', unnest(list_filter(param_tags, lambda x: NOT list_contains(params, x))) FROM doc_exports",
}
